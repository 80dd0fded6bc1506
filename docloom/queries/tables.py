"""Queries over files, keyed tables, checks, sets and aggregates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import values as v
from docloom.model import FILE_DEFAULTS, INVITATION_DEFAULTS, ORGANIZATION_DEFAULTS, USER_DEFAULTS, WRITE_BATCH
from docloom.operators import checks, keyed, rollup, sets, transitions
from docloom.operators.documents import loadable
from docloom.plans.directory import user_organizations
from docloom.plans.ingest import stored_rows
from docloom.queries import fixtures as fx
from docloom.queries.fixtures import table, with_ctes
from docloom.queries.registry import query
from docloom.queries.text_sql import SUPPORTED, sql_clean, sql_collapse, sql_lines, sql_words
from docloom.session import run_dir
from docloom.sources import catalog


@query("scan_catalog", with_ctes("SELECT id, name, org_id, account_token, size FROM file", "file"))
def scan_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_files(fx.files(spark, d)).select("id", "name", "org_id", "account_token", "size")


@query(
    "scan_folder",
    with_ctes(
        """
        , folders AS (SELECT DISTINCT folder||'/'||drive AS id, folder AS parent_id, drive AS drive_id FROM file
                      WHERE drive IS NOT NULL)
        SELECT 'both:'||a.id AS request_id, b.id FROM folders a
          JOIN folders b ON a.parent_id = b.parent_id AND a.drive_id = b.drive_id
        UNION ALL SELECT 'folder:'||parent_id, id FROM folders
        UNION ALL SELECT 'drive:'||drive_id, id FROM folders""",
        "file",
    ),
)
def scan_folder(spark: SparkSession, d: str) -> DataFrame:
    """Sub-folders for every folder, every drive, and every pair of both."""
    folders = (
        fx.files(spark, d)
        .where("drive is not null")
        .select(F.concat_ws("/", "folder", "drive").alias("id"), F.col("folder").alias("parent_id"), F.col("drive").alias("drive_id"))
        .distinct()
    )
    both = folders.select(
        F.concat(F.lit("both:"), "id").alias("request_id"), F.col("parent_id").alias("folder_id"), "drive_id"
    )
    one = folders.select(F.concat(F.lit("folder:"), "parent_id").alias("request_id"), F.col("parent_id").alias("folder_id"))
    drive = folders.select(F.concat(F.lit("drive:"), "drive_id").alias("request_id"), "drive_id").distinct()
    requests = both.unionByName(one.distinct(), True).unionByName(drive, True)
    return catalog.list_folders_for(folders, requests).select("request_id", "id")


@query(
    "read_content",
    with_ctes(
        f"""SELECT id, name, md5(content) AS digest, CAST(length(content) AS BIGINT) AS n_chars FROM file
            WHERE string_split(name,'.')[-1] IN ({SUPPORTED}) AND content IS NOT NULL""",
        "file",
    ),
)
def read_content(spark: SparkSession, d: str) -> DataFrame:
    return catalog.read_content(fx.files(spark, d)).select(
        "id",
        "name",
        F.md5(F.col("content").cast("binary")).alias("digest"),
        F.length("content").cast("bigint").alias("n_chars"),
    )


@query(
    "ext_filter",
    with_ctes(
        f"""SELECT id, name, string_split(name,'.')[-1] AS ext FROM file
            WHERE string_split(name,'.')[-1] IN ({SUPPORTED})""",
        "file",
    ),
)
def ext_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.supported(fx.files(spark, d)).select("id", "name", tx.extension(F.col("name")).alias("ext"))


@query(
    "file_projection",
    with_ctes(
        """SELECT id, remote_id, name, file_url, size, mime_type, folder, drive, org_id, account_token,
                  CASE WHEN modified_at IS NULL THEN '' ELSE printf('%.1f', epoch(modified_at)) END AS modified_at
           FROM file""",
        "file",
    ),
)
def file_projection(spark: SparkSession, d: str) -> DataFrame:
    return stored_rows(fx.files(spark, d)).drop("process_date")


@query(
    "defaults_projection",
    with_ctes(
        """SELECT id, remote_id, coalesce(name,'') AS name, file_url, '' AS file_thumbnail_url, size, coalesce(mime_type,'') AS mime_type, folder,
                  CAST(0 AS BIGINT) AS n_permissions, coalesce(drive,'') AS drive, false AS remote_was_deleted,
                  CASE WHEN modified_at IS NULL THEN '' ELSE printf('%.1f', epoch(modified_at)) END AS modified_at,
                  CAST(0 AS BIGINT) AS n_field_mappings
           FROM file""",
        "file",
    ),
)
def defaults_projection(spark: SparkSession, d: str) -> DataFrame:
    shown = v.with_defaults(stored_rows(fx.files(spark, d)), FILE_DEFAULTS)
    return (
        shown.withColumn("n_permissions", F.size("permissions").cast("bigint"))
        .withColumn("n_field_mappings", F.size("field_mappings").cast("bigint"))
        .drop("permissions", "field_mappings")
    )


@query(
    "user_defaults",
    with_ctes("SELECT id, email, name, organization_id, '' AS created_at, '' AS updated_at FROM usr", "usr"),
)
def user_defaults(spark: SparkSession, d: str) -> DataFrame:
    return v.with_defaults(fx.users(spark, d), USER_DEFAULTS)


@query(
    "org_defaults",
    with_ctes(
        """SELECT id, name, email, admin_id, admin_email, CAST(0 AS BIGINT) AS n_listed, '' AS created_at, '' AS updated_at
           FROM org""",
        "org",
    ),
)
def org_defaults(spark: SparkSession, d: str) -> DataFrame:
    shown = v.with_defaults(fx.orgs(spark, d), ORGANIZATION_DEFAULTS)
    lists = ["user_list", "invited_user_list", "document_list", "link_id_map"]
    n_listed = sum((F.size(c) for c in lists), F.lit(0)).cast("bigint")
    return shown.withColumn("n_listed", n_listed).drop(*lists)


@query(
    "invitation_defaults",
    with_ctes("SELECT id, org_name, org_id, org_user_email, '' AS created_at FROM invite", "invite"),
)
def invitation_defaults(spark: SparkSession, d: str) -> DataFrame:
    return v.with_defaults(fx.invites(spark, d), INVITATION_DEFAULTS)


@query(
    "kv_get",
    """SELECT 'd'||d.doc_id AS id, l.quality, l.toxic,
              CAST(CASE WHEN l.doc_id IS NULL THEN 4006 END AS BIGINT) AS code,
              CASE WHEN l.doc_id IS NULL THEN 'Item does not exist' END AS reason
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return keyed.get(_labels(spark, d), table(spark, d, "documents").select(_doc_key()))


def _doc_key():
    return F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(_doc_key(), "quality", "toxic")


def _user_key(c: str):
    return F.concat(F.lit("u"), F.col(c).cast("string")).alias("id")


@query(
    "kv_batch_get",
    with_ctes("SELECT * FROM usr WHERE id IN (SELECT 'u'||user_id FROM events)", "usr"),
)
def kv_batch_get(spark: SparkSession, d: str) -> DataFrame:
    return keyed.batch_get(fx.users(spark, d), table(spark, d, "events").select(_user_key("user_id")))


@query("index_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One value of an indexed field; the equality reaches the scan."""
    return keyed.lookup(table(spark, d, "customer"), "c_mktsegment", "BUILDING", "c_custkey", "c_name")


@query(
    "index_lookup_many",
    with_ctes("SELECT account_token, id FROM file WHERE account_token IN (SELECT account_token FROM integration)", "file", "integration"),
)
def index_lookup_many(spark: SparkSession, d: str) -> DataFrame:
    """File ids of every integration's account."""
    found = keyed.batch_get(fx.files(spark, d), fx.integrations(spark, d), "account_token")
    return found.select("account_token", "id")


@query(
    "kv_upsert",
    with_ctes(
        """
        , new AS (SELECT 'u'||s_suppkey AS id, 'new'||s_suppkey||'@example.com' AS email, s_name AS name,
                         'org_'||s_nationkey AS organization_id FROM supplier)
        SELECT * FROM usr WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""",
        "usr",
    ),
)
def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "supplier").select(
        _user_key("s_suppkey"),
        F.concat(F.lit("new"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("org_"), F.col("s_nationkey").cast("string")).alias("organization_id"),
    )
    return keyed.upsert(fx.users(spark, d), new)


@query(
    "kv_bulk_upsert",
    with_ctes(
        """
        , new AS (SELECT account_token, arg_max(status, seq) AS status, max(seq) AS seq FROM status_log GROUP BY account_token)
        SELECT 'tok_'||c_custkey AS account_token, 'NONE' AS status, CAST(-1 AS BIGINT) AS seq FROM customer
        WHERE 'tok_'||c_custkey NOT IN (SELECT account_token FROM new)
        UNION ALL SELECT account_token, status, seq FROM new""",
        "status_log",
    ),
)
def kv_bulk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Many rows per key in one batch: the last one stays."""
    base = table(spark, d, "customer").select(
        F.concat(F.lit("tok_"), F.col("c_custkey").cast("string")).alias("account_token"),
        F.lit("NONE").alias("status"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    return keyed.upsert(base, fx.status_log(spark, d).select("account_token", "status", "seq"), "account_token", "seq")


@query(
    "kv_bulk_delete",
    with_ctes("SELECT id, name FROM file WHERE id NOT IN (SELECT 'd'||doc_id FROM labels WHERE toxic = 1)", "file"),
)
def kv_bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    return keyed.delete(fx.files(spark, d).select("id", "name"), _labels(spark, d).where("toxic = 1"))


@query(
    "kv_delete_returning",
    with_ctes(
        """
        SELECT k.id, u.email, CASE WHEN u.id IS NULL THEN 'Item does not exist' END AS reason, 'requested' AS part
        FROM (SELECT DISTINCT 'u'||o_custkey AS id FROM orders WHERE o_orderstatus = 'F'
              UNION SELECT 'u'||p_partkey FROM part) k LEFT JOIN usr u ON u.id = k.id
        UNION ALL
        SELECT id, email, NULL, 'remaining' FROM usr
        WHERE id NOT IN (SELECT 'u'||o_custkey FROM orders WHERE o_orderstatus = 'F')
          AND id NOT IN (SELECT 'u'||p_partkey FROM part)""",
        "usr",
    ),
)
def kv_delete_returning(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(_user_key("o_custkey"))
    keys = gone.unionByName(table(spark, d, "part").select(_user_key("p_partkey")))
    old, remaining = keyed.delete_returning(fx.users(spark, d).select("id", "email"), keys)
    return old.select("id", "email", "reason", F.lit("requested").alias("part")).unionByName(
        remaining.select("id", "email", F.lit(None).cast("string").alias("reason"), F.lit("remaining").alias("part"))
    )


@query("batch_write", with_ctes("SELECT * FROM usr", "usr"))
def batch_write(spark: SparkSession, d: str) -> DataFrame:
    """Written by the tasks that read it, in files of 100 rows, then read back."""
    users = fx.users(spark, d)
    path = run_dir(spark, "batch_write")
    keyed.write_in_batches(users, path, rows_per_file=WRITE_BATCH)
    return spark.read.schema(users.schema).parquet(path)


@query(
    "batch_list",
    with_ctes(
        """
        SELECT org_id, batch_no, string_agg(file_id, ',' ORDER BY file_id) AS file_ids, count(*) AS n
        FROM (SELECT *, CAST((row_number() OVER (PARTITION BY org_id ORDER BY file_id) - 1) // 50 AS BIGINT) AS batch_no
              FROM (SELECT org_id, id AS file_id FROM file)) GROUP BY ALL""",
        "file",
    ),
)
def batch_list(spark: SparkSession, d: str) -> DataFrame:
    cut = sets.id_batches(fx.files(spark, d).select("org_id", F.col("id").alias("file_id")))
    return cut.select("org_id", "batch_no", F.array_join("file_ids", ",").alias("file_ids"), F.size("file_ids").cast("bigint").alias("n"))


@query(
    "required_fields",
    with_ctes(
        """
        SELECT id, array_to_string(list_filter([CASE WHEN coalesce(mime_type,'')='' THEN 'mime_type' END,
                 CASE WHEN coalesce(drive,'')='' THEN 'drive' END], lambda x: x IS NOT NULL), ',') AS missing,
               CAST(CASE WHEN coalesce(mime_type,'')='' OR coalesce(drive,'')='' THEN 400 END AS BIGINT) AS code,
               CASE WHEN coalesce(mime_type,'')='' OR coalesce(drive,'')='' THEN 'Missing required field' END AS reason
        FROM file""",
        "file",
    ),
)
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    checked = checks.required_fields(fx.files(spark, d), ["mime_type", "drive"])
    return checked.select("id", F.array_join("missing", ",").alias("missing"), "code", "reason")


@query(
    "admin_check",
    with_ctes(
        """
        SELECT 'org_'||o_custkey%30 AS org_id, 'u'||o_custkey AS admin_id, o_orderkey,
               coalesce('u'||o_custkey = admin_id, false) AS allowed,
               CAST(CASE WHEN id IS NULL THEN 4006 WHEN 'u'||o_custkey <> admin_id THEN 4201 END AS BIGINT) AS code,
               CASE WHEN id IS NULL THEN 'Item does not exist'
                    WHEN 'u'||o_custkey <> admin_id THEN 'You don''t have permission' END AS reason
        FROM orders LEFT JOIN org ON id = 'org_'||o_custkey%30""",
        "org",
    ),
)
def admin_check(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a request of its customer to act as admin of some organization."""
    requests = table(spark, d, "orders").select(
        F.concat(F.lit("org_"), (F.col("o_custkey") % 30).cast("string")).alias("org_id"),
        _user_key("o_custkey").alias("admin_id"),
        "o_orderkey",
    )
    return checks.admin_check(requests, fx.orgs(spark, d))


@query(
    "is_admin",
    with_ctes("SELECT u.id AS user_id, organization_id AS org_id, admin_id = u.id AS is_admin FROM usr u JOIN org o ON o.id = organization_id", "usr", "org"),
)
def is_admin(spark: SparkSession, d: str) -> DataFrame:
    return checks.is_admin(fx.members(spark, d), fx.orgs(spark, d)).select("user_id", "org_id", "is_admin")


@query(
    "op_validate",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'error' THEN 'DELETED' WHEN 'view' THEN 'UPDATED'
                        ELSE event_type END AS operation,
              CAST(CASE WHEN event_type NOT IN ('signup','error','view') THEN 4501 END AS BIGINT) AS code,
              CASE WHEN event_type NOT IN ('signup','error','view') THEN 'Invalid argument' END AS reason
       FROM events""",
)
def op_validate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    operation = (
        F.when(kind == "signup", "CREATED").when(kind == "error", "DELETED").when(kind == "view", "UPDATED").otherwise(kind)
    )
    return checks.valid_operation(table(spark, d, "events").select("event_id", operation.alias("operation")))


@query(
    "membership_semi",
    with_ctes(
        """
        SELECT conv_id, turn, 'org_'||conv_id%25 AS org_id, 'u'||conv_id AS user_id FROM conversations
        WHERE ('org_'||conv_id%25, 'u'||conv_id) IN (SELECT org_id, user_id FROM member)""",
        "member",
    ),
)
def membership_semi(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("org_"), (F.col("conv_id") % 25).cast("string")).alias("org_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("user_id"),
    )
    return checks.members_only(requests, fx.members(spark, d)).select("conv_id", "turn", "org_id", "user_id")


@query(
    "user_org_join",
    with_ctes(
        """
        SELECT u.id, organization_id AS org_id, o.name AS org_name, admin_id, 'user' AS kind
        FROM usr u JOIN org o ON o.id = organization_id
        UNION ALL
        SELECT i.id, org_id, o.name, admin_id, 'invite' FROM invite i JOIN org o ON o.id = org_id""",
        "usr",
        "org",
        "invite",
    ),
)
def user_org_join(spark: SparkSession, d: str) -> DataFrame:
    orgs = fx.orgs(spark, d)
    invited = fx.invites(spark, d).select("id", F.col("org_id").alias("organization_id"))
    parts = [
        user_organizations(people, orgs).select(
            "id", F.col("organization_id").alias("org_id"), "org_name", "admin_id", F.lit(kind).alias("kind")
        )
        for people, kind in ((fx.users(spark, d).select("id", "organization_id"), "user"), (invited, "invite"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "ops_grouped",
    with_ctes(
        """
        SELECT o.org_id, p.operation, count(c.file_id) AS n_ids
        FROM (SELECT DISTINCT org_id FROM change) o, (VALUES ('CREATED'),('UPDATED'),('DELETED')) p(operation)
        LEFT JOIN change c ON c.org_id = o.org_id AND c.operation = p.operation GROUP BY ALL""",
        "change",
    ),
)
def ops_grouped(spark: SparkSession, d: str) -> DataFrame:
    return sets.grouped_operations(fx.changes(spark, d))


@query(
    "change_lists",
    with_ctes(
        """
        SELECT org_id, file_id, 'remove' AS list FROM change WHERE operation IN ('UPDATED','DELETED')
        UNION ALL SELECT org_id, file_id, 'load' FROM change WHERE operation IN ('CREATED','UPDATED')""",
        "change",
    ),
)
def change_lists(spark: SparkSession, d: str) -> DataFrame:
    feed = fx.changes(spark, d)
    remove = sets.removal_rows(feed).select("org_id", "file_id", F.lit("remove").alias("list"))
    return remove.unionByName(sets.load_rows(feed).select("org_id", "file_id", F.lit("load").alias("list")))


@query(
    "sync_readiness",
    with_ctes(
        """
        SELECT a.account_token,
               CASE WHEN coalesce(bool_and(s.status = 'DONE'), true) THEN 'ready'
                    WHEN bool_or(s.status = 'FAILED') THEN 'failed' ELSE 'pending' END AS readiness
        FROM account a LEFT JOIN sync_status s USING (account_token) GROUP BY a.account_token""",
        "account",
        "sync_status",
    ),
)
def sync_readiness(spark: SparkSession, d: str) -> DataFrame:
    return rollup.sync_readiness(fx.accounts(spark, d), fx.sync_statuses(spark, d))


@query(
    "status_latest",
    with_ctes(
        """SELECT org_id, account_token, arg_max(status, {'ts': ts, 'seq': seq}) AS status, max(ts) AS updated_at
           FROM status_log GROUP BY ALL""",
        "status_log",
    ),
)
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return rollup.latest_status(fx.status_log(spark, d))


@query(
    "status_transitions",
    with_ctes(
        """
        , placed AS (SELECT *, row_number() OVER (ORDER BY org_id, account_token, ts, seq, status) AS place FROM status_log),
        stretch AS (SELECT *, coalesce(max(place) FILTER (status = 'SYNCING') OVER (PARTITION BY org_id, account_token ORDER BY place), 0) AS start FROM placed),
        firsts AS (SELECT *, min(place) FILTER (status = 'INDEXING') OVER (PARTITION BY org_id, account_token, start) AS i,
                          min(place) FILTER (status = 'FAIL') OVER (PARTITION BY org_id, account_token, start) AS f FROM stretch),
        ended AS (SELECT *, min(place) FILTER (status IN ('SUCCESS', 'FAIL') AND place > i) OVER (PARTITION BY org_id, account_token, start) AS e FROM firsts)
        SELECT org_id, account_token, status, ts, seq,
               CASE WHEN status = 'SYNCING' OR (i < coalesce(f, place + i) AND (place = i OR place = e)) OR (f < coalesce(i, place + f) AND place = f)
                    THEN NULL ELSE 'not allowed here' END AS refused
        FROM ended""",
        "status_log",
    ),
)
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the status log and, if it may not follow the rows before it, why not."""
    return transitions.judged(fx.status_log(spark, d))


@query(
    "token_usage",
    f"""SELECT conv_id, CAST(sum(len({sql_words('text')})) AS BIGINT) AS tokens, count(*) AS texts
        FROM conversations GROUP BY conv_id""",
)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    return rollup.token_usage(table(spark, d, "conversations"), "conv_id")


@query(
    "metric_rollup",
    """
    SELECT w AS window_start, round(sum(v),6) AS sum_value, round(avg(v),6) AS avg_value, round(max(v),6) AS max_value,
           count(*) AS n_series
    FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w, user_id, avg(value) AS v FROM events GROUP BY ALL) GROUP BY w""",
)
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.metric_rollup(fx.metric_samples(spark, d))


@query(
    "member_list",
    with_ctes(
        """
        SELECT DISTINCT org_id, user_id FROM (SELECT org_id, user_id FROM member UNION ALL SELECT org_id, id FROM invite
                                              UNION ALL SELECT org_id, user_id FROM member)
        WHERE (org_id, user_id) NOT IN (SELECT 'org_'||c_nationkey, 'u'||c_custkey FROM customer WHERE c_acctbal < 0)""",
        "member",
        "invite",
    ),
)
def member_list(spark: SparkSession, d: str) -> DataFrame:
    """Invited people join, members with a negative balance leave, and joining twice counts once."""
    have = fx.members(spark, d)
    joined = fx.invites(spark, d).select("org_id", F.col("id").alias("user_id")).unionByName(have)
    left = table(spark, d, "customer").where("c_acctbal < 0")
    left = left.select(
        F.concat(F.lit("org_"), F.col("c_nationkey").cast("string")).alias("org_id"), _user_key("c_custkey").alias("user_id")
    )
    return rollup.member_list(have, joined, left)


@query(
    "first_owner",
    with_ctes("SELECT id, email FROM usr WHERE id IN (SELECT admin_id FROM org) ORDER BY id LIMIT 1", "usr", "org"),
)
def first_owner(spark: SparkSession, d: str) -> DataFrame:
    admins = fx.orgs(spark, d).select(F.col("admin_id").alias("id"))
    people = fx.users(spark, d).join(admins, "id", "left_semi").withColumn("is_me", F.lit(True))
    return rollup.first_owner(people).select("id", "email")


@query(
    "doc_set_ops",
    with_ctes(
        """
        SELECT org_id, id AS file_id FROM (SELECT org_id, id FROM checked WHERE code IS NULL
             UNION SELECT org_id, file_id FROM change WHERE operation IN ('CREATED','UPDATED'))
        WHERE (org_id, id) NOT IN (SELECT org_id, file_id FROM change WHERE operation = 'DELETED')""",
        "checked",
        "change",
    ),
)
def doc_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Loadable files, and those the change feed adds, without those it deletes."""
    files = loadable(fx.files(spark, d))
    feed = fx.changes(spark, d)
    have = files.select("org_id", F.col("id").alias("file_id"))
    added = sets.union_ids(have, sets.load_rows(feed))
    return sets.except_ids(added, feed.where("operation = 'DELETED'"))


@query(
    "invite_list_ops",
    """
    SELECT s_suppkey, array_to_string(CASE WHEN list_contains(l, u) THEN l ELSE list_append(l, u) END, ',') AS after_invite,
           CAST(CASE WHEN list_contains(l, u) THEN 4102 END AS BIGINT) AS invite_code,
           array_to_string(list_filter(l, lambda x: x <> u), ',') AS after_cancel,
           CAST(CASE WHEN NOT list_contains(l, u) THEN 4101 END AS BIGINT) AS cancel_code
    FROM (SELECT s_suppkey, ['i'||s_suppkey, 'i'||s_nationkey] AS l, 'i'||(s_suppkey%25) AS u FROM supplier)""",
)
def invite_list_ops(spark: SparkSession, d: str) -> DataFrame:
    def name(c):
        return F.concat(F.lit("i"), c.cast("string"))

    s = table(spark, d, "supplier").select(
        "s_suppkey",
        F.array(name(F.col("s_suppkey")), name(F.col("s_nationkey"))).alias("invited"),
        name(F.col("s_suppkey") % 25).alias("user"),
    )
    added, invite_code, _ = sets.invite(F.col("invited"), F.col("user"))
    removed, cancel_code, _ = sets.cancel_invite(F.col("invited"), F.col("user"))
    return s.select(
        "s_suppkey",
        F.array_join(added, ",").alias("after_invite"),
        invite_code.alias("invite_code"),
        F.array_join(removed, ",").alias("after_cancel"),
        cancel_code.alias("cancel_code"),
    )


def _link_maps(spark: SparkSession, d: str) -> DataFrame:
    """Per integration a two-entry map: its own account and the organization's web account."""

    def entry(token):
        return F.struct(F.lit("SYNCING").alias("status"), F.concat(token, F.lit("@example.com")).alias("account_id"))

    web = F.concat(F.lit("tok_"), F.substring("org_id", 5, 10), F.lit("_web"))
    own = F.col("account_token")
    docs = fx.integrations(spark, d).where(~own.endswith("_web"))
    return docs.select(
        "org_id", "account_token", web.alias("web"), F.create_map(own, entry(own), web, entry(web)).alias("link_id_map")
    )


@query(
    "integration_map_ops",
    with_ctes(
        """
        SELECT org_id, account_token, 'put' AS op, k AS entry, CASE WHEN k = account_token THEN 'INDEXING' ELSE 'SYNCING' END AS status
        FROM (SELECT org_id, account_token, unnest([account_token, 'tok_'||substr(org_id,5)||'_web']) AS k FROM integration
              WHERE account_token NOT LIKE '%_web')
        UNION ALL SELECT org_id, account_token, 'remove', 'tok_'||substr(org_id,5)||'_web', 'SYNCING' FROM integration
              WHERE account_token NOT LIKE '%_web'
        UNION ALL SELECT org_id, account_token, 'set', k, CASE WHEN k = account_token THEN 'SUCCESS' ELSE 'SYNCING' END
        FROM (SELECT org_id, account_token, unnest([account_token, 'tok_'||substr(org_id,5)||'_web']) AS k FROM integration
              WHERE account_token NOT LIKE '%_web')""",
        "integration",
    ),
)
def integration_map_ops(spark: SparkSession, d: str) -> DataFrame:
    maps = _link_maps(spark, d)
    entries, token = F.col("link_id_map"), F.col("account_token")
    fresh = F.struct(F.lit("INDEXING").alias("status"), F.lit("new").alias("account_id"))
    results = {
        "put": sets.map_put(entries, token, fresh),
        "remove": sets.map_remove(entries, token),
        "set": sets.map_set_field(entries, token, "status", F.lit("SUCCESS")),
    }
    each = maps.select("org_id", "account_token", F.explode(F.array(*[
        F.struct(F.lit(op).alias("op"), result.alias("m")) for op, result in results.items()
    ])).alias("r"))
    return each.select("org_id", "account_token", "r.op", F.explode("r.m").alias("entry", "value")).select(
        "org_id", "account_token", "op", "entry", F.col("value.status").alias("status")
    )


@query(
    "integration_details",
    with_ctes(
        """
        SELECT org_id, account_token, k AS entry, k||'@example.com' AS account_id, 'SYNCING' AS status
        FROM (SELECT org_id, account_token, unnest([account_token, 'tok_'||substr(org_id,5)||'_web']) AS k FROM integration
              WHERE account_token NOT LIKE '%_web')""",
        "integration",
    ),
)
def integration_details(spark: SparkSession, d: str) -> DataFrame:
    rows = _link_maps(spark, d).select("org_id", "account_token", F.explode("link_id_map").alias("entry", "value"))
    return rows.select("org_id", "account_token", "entry", "value.account_id", "value.status")


@query("ws_collapse", f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents")
def ws_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.collapse_ws(F.col("text")).alias("text"))


@query("clean_text", f"SELECT doc_id, {sql_clean(sql_lines('text'))} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_text(tx.line_elements(F.col("text"))).alias("text"))


@query(
    "process_date_fmt",
    "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y, %H:%M:%S') AS process_date, true AS round_trip FROM orders",
)
def process_date_fmt(spark: SparkSession, d: str) -> DataFrame:
    shown = v.process_date(F.col("o_orderdate"))
    back = v.parse_process_date(shown) == F.date_trunc("second", F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("process_date"), back.alias("round_trip"))


@query(
    "org_id_gen",
    """
    SELECT c_custkey, 'p_'||replace(u,'-','_') AS org_id, true AS safe
    FROM (SELECT c_custkey, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS u
          FROM (SELECT c_custkey, md5(c_name) AS h FROM customer))""",
)
def org_id_gen(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "customer").select("c_custkey", v.organization_id(v.uuid_of(F.col("c_name"))).alias("org_id"))
    return made.withColumn("safe", F.col("org_id").rlike("^[0-9a-zA-Z_]+$"))


@query(
    "full_name",
    """SELECT c_custkey, split_part(c_name,'#',1)||' '||split_part(c_name,'#',2) AS name,
              'https://example.com/register?id=u'||c_custkey AS link FROM customer""",
)
def full_name(spark: SparkSession, d: str) -> DataFrame:
    def part(i):
        return F.split_part("c_name", F.lit("#"), F.lit(i))

    return table(spark, d, "customer").select(
        "c_custkey", v.full_name(part(1), part(2)).alias("name"), v.invite_link(_user_key("c_custkey")).alias("link")
    )


@query(
    "typed_attr_json",
    with_ctes(
        """
        SELECT id, CAST(to_json({'id': {'S': id}, 'size': {'N': CAST(size AS VARCHAR)},
                                 'tags': {'L': [{'S': folder}, {'S': org_id}]}}) AS VARCHAR) AS record,
               size AS size_back, folder||','||org_id AS tags_back
        FROM file""",
        "file",
    ),
)
def typed_attr_json(spark: SparkSession, d: str) -> DataFrame:
    fields = {"id": "S", "size": "N", "tags": "L"}
    plain = fx.files(spark, d).select("id", "size", F.array("folder", "org_id").alias("tags"))
    records = plain.select(v.to_typed(fields).alias("record"))
    back = records.select("record", *v.from_typed(F.col("record"), fields))
    return back.select("id", "record", F.col("size").alias("size_back"), F.array_join("tags", ",").alias("tags_back"))


