"""Directory changes in batches: organizations, admins, invitations, users.

Each function takes a batch of requests with a unique `request_id` and the tables it needs, and returns the
outcome of every request with the rows to put and the keys to delete. When several requests of one batch
ask for the same thing, the one with the smallest request_id is taken and the others are refused.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import full_name, invite_link, organization_id, outcome, uuid_of
from docloom.operators.checks import is_blank
from docloom.session import materialize


@dataclass(frozen=True)
class Changes:
    outcomes: DataFrame
    puts: dict[str, DataFrame]
    deletes: dict[str, DataFrame]


#: What tells the rows of a table apart. Other tables are logs, to which rows are added.
KEYS = {
    "orgs": ["id"],
    "invites": ["id"],
    "users": ["id"],
    "members": ["org_id", "user_id"],
    "integrations": ["org_id", "account_token"],
}


def apply(tables: dict[str, DataFrame], done: Changes) -> dict[str, DataFrame]:
    """The tables after a batch: deleted keys are gone, rows that are put replace those of their key.

    Put rows may lack columns of their table, which are then null. Tables without changes stay as they are.
    """
    out = dict(tables)
    for name, keys in done.deletes.items():
        if name in out:
            out[name] = out[name].join(keys.distinct(), keys.columns, "left_anti")
    for name, rows in done.puts.items():
        if name in out:
            have, keys = out[name], KEYS.get(name)
            if keys:
                have = have.join(rows.select(*keys).distinct(), keys, "left_anti")
            rows = rows.select(*[c for c in rows.columns if c in have.columns])
            out[name] = have.unionByName(rows, allowMissingColumns=True).select(*tables[name].columns)
    return out


def _blank(*names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | is_blank(F.col(name))
    return out


def _key(*parts: str | Column) -> Column:
    """Text that tells any two lists of values apart, nulls and separators included."""
    return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})


def _decide(joined: DataFrame, rules: list[tuple[Column, str]], keys: list[str], late: str) -> DataFrame:
    """Apply the rules, then let only the first passing request of each key through.

    The first one is found by a minimum, which combines before the shuffle: no window over a hot key.
    The checked requests are written once, because outcomes, puts and deletes all follow from them.
    """
    code, reason = outcome(*rules)
    checked = materialize(joined.withColumns({"code": code, "reason": reason}), "requests")
    first = checked.where("code is null").groupBy(*keys).agg(F.min("request_id").alias("_first"))
    marked = checked.join(first.select("_first"), checked["request_id"] == first["_first"], "left")
    late_code, late_reason = outcome((F.col("code").isNull() & F.col("_first").isNull(), late))
    return marked.withColumns(
        {"code": F.coalesce("code", late_code), "reason": F.coalesce("reason", late_reason)}
    ).drop("_first")


def _outcomes(decided: DataFrame) -> DataFrame:
    return decided.select("request_id", F.col("code").isNull().alias("accepted"), "code", "reason")


def _org_admins(orgs: DataFrame) -> DataFrame:
    return orgs.select(F.col("id").alias("org_id"), F.col("admin_id").alias("_admin"))


def _admin_rules(*mandatory: str) -> list[tuple[Column, str]]:
    return [
        (_blank("org_id", "admin_id", *mandatory), "BAD_REQUEST"),
        (F.col("_admin").isNull(), "ITEM_DOES_NOT_EXIST"),
        (F.col("_admin") != F.col("admin_id"), "NOT_ENOUGH_PERMISSION"),
    ]


def register_organizations(requests: DataFrame, orgs: DataFrame) -> Changes:
    """Requests (name, email, admin_email, ts). The admin is invited, and becomes admin under that id."""
    org_key = _key("name", "email", "admin_email")
    joined = requests.withColumns(
        {
            "org_id": organization_id(uuid_of(org_key)),
            "admin_id": uuid_of(_key(F.lit("admin"), org_key)),
        }
    )
    known = orgs.select(F.col("id").alias("org_id"), F.lit(True).alias("_known"))
    joined = joined.join(known, "org_id", "left")
    rules = [(_blank("name", "email", "admin_email"), "BAD_REQUEST"), (F.col("_known").isNotNull(), "INVALID_ARGUMENT")]
    decided = _decide(joined, rules, ["org_id"], "INVALID_ARGUMENT")
    good = decided.where("code is null")
    new_orgs = good.select(
        F.col("org_id").alias("id"), "name", "email", "admin_id", "admin_email", F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    invites = good.select(
        F.col("admin_id").alias("id"), "org_id", F.col("name").alias("org_name"),
        F.col("email").alias("org_user_email"), F.col("ts").alias("created_at"),
    )
    return Changes(_outcomes(decided), {"orgs": new_orgs, "invites": invites}, {})


def change_admins(requests: DataFrame, orgs: DataFrame) -> Changes:
    """Requests (org_id, admin_id, new_admin_id, new_admin_email); admin_id is the present admin."""
    joined = requests.join(_org_admins(orgs), "org_id", "left")
    decided = _decide(joined, _admin_rules("new_admin_id", "new_admin_email"), ["org_id"], "NOT_ENOUGH_PERMISSION")
    good = decided.where("code is null").select(F.col("org_id").alias("id"), "new_admin_id", "new_admin_email")
    changed = orgs.join(good, "id").withColumns({"admin_id": F.col("new_admin_id"), "admin_email": F.col("new_admin_email")})
    return Changes(_outcomes(decided), {"orgs": changed.select(*orgs.columns)}, {})


def invite_users(requests: DataFrame, orgs: DataFrame, invites: DataFrame) -> Changes:
    """Requests (org_id, org_name, user_email, admin_id, ts). The invitation id follows from org and address."""
    joined = requests.withColumn("user_id", uuid_of(_key("org_id", "user_email"))).join(_org_admins(orgs), "org_id", "left")
    known = invites.select("org_id", F.col("id").alias("user_id"), F.lit(True).alias("_invited"))
    joined = joined.join(known, ["org_id", "user_id"], "left")
    rules = [*_admin_rules("org_name", "user_email"), (F.col("_invited").isNotNull(), "USER_ALREADY_INVITED")]
    decided = _decide(joined, rules, ["org_id", "user_id"], "USER_ALREADY_INVITED")
    good = decided.where("code is null")
    new = good.select(
        F.col("user_id").alias("id"), "org_id", "org_name", F.col("user_email").alias("org_user_email"),
        F.col("ts").alias("created_at"),
    )
    links = good.select("user_id", "user_email", invite_link(F.col("user_id")).alias("link"))
    return Changes(_outcomes(decided), {"invites": new, "links": links}, {})


def cancel_invites(requests: DataFrame, orgs: DataFrame, invites: DataFrame) -> Changes:
    """Requests (org_id, org_name, user_id, admin_id)."""
    known = invites.select("org_id", F.col("id").alias("user_id"), F.lit(True).alias("_invited"))
    joined = requests.join(_org_admins(orgs), "org_id", "left").join(known, ["org_id", "user_id"], "left")
    rules = [*_admin_rules("org_name", "user_id"), (F.col("_invited").isNull(), "USER_NOT_INVITED")]
    decided = _decide(joined, rules, ["org_id", "user_id"], "USER_NOT_INVITED")
    gone = decided.where("code is null").select(F.col("user_id").alias("id"))
    return Changes(_outcomes(decided), {}, {"invites": gone})


def register_users(requests: DataFrame, invites: DataFrame) -> Changes:
    """Requests (id, email, first_name, last_name, ts). Needs an invitation, which is used up."""
    known = invites.select("id", "org_id")
    joined = requests.join(known, "id", "left")
    rules = [
        (_blank("id", "email", "first_name", "last_name"), "BAD_REQUEST"),
        (F.col("org_id").isNull(), "ITEM_DOES_NOT_EXIST"),
    ]
    decided = _decide(joined, rules, ["id"], "ITEM_DOES_NOT_EXIST")
    good = decided.where("code is null")
    users = good.select(
        "id", "email", full_name(F.col("first_name"), F.col("last_name")).alias("name"),
        F.col("org_id").alias("organization_id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    members = good.select("org_id", F.col("id").alias("user_id"))
    return Changes(_outcomes(decided), {"users": users, "members": members}, {"invites": good.select("id")})


def remove_users(requests: DataFrame, users: DataFrame, orgs: DataFrame, members: DataFrame) -> Changes:
    """Requests (user_id, admin_id). Admins cannot remove themselves."""
    homes = users.select(F.col("id").alias("user_id"), F.col("organization_id").alias("org_id"))
    listed = members.select("org_id", "user_id", F.lit(True).alias("_listed")).distinct()
    joined = (
        requests.join(homes, "user_id", "left")
        .join(_org_admins(orgs), "org_id", "left")
        .join(listed, ["org_id", "user_id"], "left")
    )
    rules = [
        (_blank("user_id") | (F.col("user_id") == F.col("admin_id")), "BAD_REQUEST"),
        (F.col("_admin").isNull(), "ITEM_DOES_NOT_EXIST"),
        (~F.coalesce(F.col("_admin") == F.col("admin_id"), F.lit(False)), "NOT_ENOUGH_PERMISSION"),
        (F.col("_listed").isNull(), "USER_DOES_NOT_EXIST"),
    ]
    decided = _decide(joined, rules, ["user_id"], "ITEM_DOES_NOT_EXIST")
    good = decided.where("code is null")
    return Changes(
        _outcomes(decided), {}, {"users": good.select(F.col("user_id").alias("id")), "members": good.select("org_id", "user_id")}
    )


def add_integrations(requests: DataFrame, orgs: DataFrame, owners: DataFrame) -> Changes:
    """Requests (org_id, admin_id, account_token, provider, ts). New integrations start in status SYNCING.

    A token asked for twice in one batch is taken once; a token the organization already has is replaced.
    """
    joined = requests.join(_org_admins(orgs), "org_id", "left").join(owners, "account_token", "left")
    decided = _decide(joined, _admin_rules("account_token"), ["org_id", "account_token"], "INVALID_ARGUMENT")
    added = decided.where("code is null").select(
        "org_id", "account_token", "provider", "account_id", F.lit("SYNCING").alias("status"), F.col("ts").alias("created")
    )
    log = added.select("org_id", "account_token", "status", F.col("created").alias("ts"), F.lit(0).alias("seq"))
    return Changes(_outcomes(decided), {"integrations": added, "status_log": log}, {})


def user_organizations(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Each user with the organization they belong to."""
    homes = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("org_name"), "admin_id")
    return users.join(homes, "organization_id")
