"""Queries over whole jobs: ingest, change batches, removals, directory requests, streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.model import QUARANTINE_SCHEMA, REJECTED_SCHEMA
from docloom.operators import documents, rollup
from docloom.plans import changes as ch
from docloom.plans import directory as dr
from docloom.plans import ingest as ing
from docloom.queries import fixtures as fx
from docloom.queries.fixtures import table, with_ctes
from docloom.queries.registry import query
from docloom.queries.texts import EMBEDDER, nodes
from docloom.session import run_dir
from docloom.sources.collection import Collection
from docloom.sources.contents import FileStore
from docloom.streaming import jobs

NODE_SQL = "org_id, node_id, doc_id, chunk_idx, md5(text) AS digest, CAST(256 AS BIGINT) AS dim, process_date"


def _shown(held: DataFrame) -> DataFrame:
    return held.select(
        "org_id",
        "node_id",
        "doc_id",
        "chunk_idx",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        F.size("embedding").cast("bigint").alias("dim"),
        "process_date",
    )


def _indexed(spark: SparkSession, d: str, name: str) -> Collection:
    collection = Collection(run_dir(spark, name))
    collection.publish(spark, nodes=documents.nodes_of(fx.files(spark, d), EMBEDDER))
    return collection


@query("index_write", with_ctes(f"SELECT {NODE_SQL} FROM chunk", "chunk"))
def index_write(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_indexed(spark, d, "index_write").load(spark))


@query(
    "index_load",
    with_ctes(
        """SELECT org_id, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs, min(node_id) AS first_node, max(node_id) AS last_node
           FROM chunk GROUP BY org_id""",
        "chunk",
    ),
)
def index_load(spark: SparkSession, d: str) -> DataFrame:
    held = _indexed(spark, d, "index_load").load(spark)
    return held.groupBy("org_id").agg(
        F.count("*").alias("n_nodes"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.min("node_id").alias("first_node"),
        F.max("node_id").alias("last_node"),
    )


@query(
    "index_load_one",
    with_ctes(
        f"""SELECT {NODE_SQL} FROM chunk WHERE org_id = (SELECT max(org_id) FROM chunk)
            AND (org_id, doc_id) NOT IN (SELECT org_id, file_id FROM change WHERE operation = 'DELETED')""",
        "chunk",
        "change",
    ),
)
def index_load_one(spark: SparkSession, d: str) -> DataFrame:
    """The organization with the last id, after the deletions of the change feed, from its own folders."""
    collection = _indexed(spark, d, "index_load_one")
    gone = fx.changes(spark, d).where("operation = 'DELETED'").withColumnRenamed("file_id", "doc_id")
    collection.publish(spark, 1, removed=gone)
    last = collection.load(spark).agg(F.max("org_id").alias("o")).first().o
    return _shown(collection.load(spark, last))


@query(
    "index_drop",
    with_ctes(
        f"""SELECT {NODE_SQL} FROM chunk WHERE org_id NOT IN
            (SELECT 'org_'||n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
             WHERE r_name = (SELECT min(r_name) FROM region))""",
        "chunk",
    ),
)
def index_drop(spark: SparkSession, d: str) -> DataFrame:
    """Drops the collections of the organizations of one region; the survivors are read back."""
    collection = _indexed(spark, d, "index_drop")
    first = table(spark, d, "region").agg(F.min_by("r_regionkey", "r_name").alias("n_regionkey"))
    gone = table(spark, d, "nation").join(first, "n_regionkey")
    collection.publish(spark, 1, dropped=gone.select(F.concat(F.lit("org_"), F.col("n_nationkey").cast("string")).alias("org_id")))
    return _shown(collection.load(spark))


@query(
    "ingest",
    with_ctes(
        """
        SELECT org_id, count(*) FILTER (code IS NULL) AS n_files, count(*) FILTER (code IS NOT NULL) AS n_quarantined,
               coalesce(any_value(n), 0) AS n_nodes
        FROM checked LEFT JOIN (SELECT org_id, count(*) AS n FROM chunk GROUP BY org_id) USING (org_id) GROUP BY org_id""",
        "checked",
        "chunk",
    ),
)
def ingest(spark: SparkSession, d: str) -> DataFrame:
    """Read back from what the ingest wrote."""
    path = run_dir(spark, "ingest")
    collection = Collection(f"{path}/collection")
    held = ing.run_ingest(spark, fx.files(spark, d), collection, EMBEDDER, f"{path}/status")
    orgs = T.StructType([T.StructField("org_id", T.StringType())])
    return ing.counts(collection.recorded(spark, "file_rows", orgs), collection.recorded(spark, "quarantine", orgs), held)


@query(
    "ingest_file_list",
    with_ctes(
        """SELECT DISTINCT org_id, file_id FROM (SELECT org_id, id AS file_id FROM checked WHERE code IS NULL
                  UNION SELECT org_id, file_id FROM change WHERE file_id NOT IN (SELECT id FROM checked WHERE code IS NOT NULL))""",
        "checked",
        "change",
    ),
)
def ingest_file_list(spark: SparkSession, d: str) -> DataFrame:
    """The organizations' file ids after an ingest on top of the ids the change feed names."""
    have = fx.changes(spark, d).select("org_id", "file_id")
    return ing.file_list(have, ing.plan_ingest(fx.files(spark, d), EMBEDDER))


@query(
    "ingest_status",
    with_ctes("SELECT org_id, account_token, 'SUCCESS' AS status FROM integration", "integration"),
)
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every integration after its ingest, from the log the ingest wrote."""
    path = run_dir(spark, "ingest_status")
    ing.run_ingest(spark, fx.files(spark, d), Collection(f"{path}/collection"), EMBEDDER, f"{path}/status")
    return rollup.latest_status(spark.read.parquet(f"{path}/status")).select("org_id", "account_token", "status")


@query("cdc_apply", with_ctes(f"SELECT {NODE_SQL} FROM next_node", "next_node"))
def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    """The whole change feed against the whole collection, appended to it and read back."""
    collection = _indexed(spark, d, "cdc_apply")
    return _shown(ch.apply_changes(spark, collection, fx.changes(spark, d), fx.files(spark, d), EMBEDDER, 1))


def _stored(spark: SparkSession, d: str, name: str) -> FileStore:
    """The files laid out in buckets of 1 MB."""
    store = FileStore(run_dir(spark, name))
    store.create(fx.files(spark, d), 1 << 20)
    return store


@query("cdc_stored", with_ctes(f"SELECT {NODE_SQL} FROM next_node", "next_node"))
def cdc_stored(spark: SparkSession, d: str) -> DataFrame:
    """The change feed, with contents read from the folders of the named files."""
    collection, store = _indexed(spark, d, "cdc_stored"), _stored(spark, d, "cdc_stored_files")
    return _shown(ch.apply_changes(spark, collection, fx.changes(spark, d), store, EMBEDDER, 1))


@query(
    "file_store_put",
    with_ctes(
        """SELECT f.org_id, f.id, f.name, md5(CASE WHEN c.operation IS NULL THEN f.content ELSE 'new '||f.content END) AS digest
           FROM file f LEFT JOIN change c ON c.org_id = f.org_id AND c.file_id = f.id
           WHERE coalesce(c.operation, '') <> 'DELETED'
           UNION ALL SELECT 'org_late', 'late'||doc_id, 'late.txt', md5('late') FROM labels JOIN documents USING (doc_id) WHERE toxic = 1""",
        "file",
        "change",
    ),
)
def file_store_put(spark: SparkSession, d: str) -> DataFrame:
    """Deleted files go, other named ones get new content, and an organization comes that was not there; read back."""
    store, feed = _stored(spark, d, "file_store_put"), fx.changes(spark, d)
    named = feed.select("org_id", F.col("file_id").alias("id"), "operation")
    gone = named.where("operation = 'DELETED'")
    new = store.changed(named.where("operation <> 'DELETED'")).withColumn("content", F.concat(F.lit("new "), "content"))
    late = store.changed(gone).withColumns(
        {"org_id": F.lit("org_late"), "id": F.concat(F.lit("late"), F.expr("substring(id, 2)")), "name": F.lit("late.txt"), "content": F.lit("late")}
    )
    store.put(1, new.unionByName(late), gone)
    return store.read(spark).select("org_id", "id", "name", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "cdc_refused",
    with_ctes(
        """SELECT 'refused' AS part, 'org_'||s_nationkey AS org_id, 's'||s_suppkey AS id, CAST(4501 AS BIGINT) AS code
           FROM supplier WHERE s_suppkey%2 = 0
           UNION ALL SELECT 'quarantined', org_id, id, code FROM checked WHERE code IS NOT NULL AND id LIKE 's%'
             AND CAST(substr(id, 2) AS BIGINT)%2 = 1""",
        "checked",
    ),
)
def cdc_refused(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' files in the feed: half by an unknown operation, half that cannot be loaded; from the batch's records."""
    collection = _indexed(spark, d, "cdc_refused")
    named = fx.files(spark, d).where("folder = 'fold_sup'").select("org_id", F.col("id").alias("file_id"))
    even = F.substring("file_id", 2, 20).cast("bigint") % 2 == 0
    feed = named.select("*", F.when(even, "RENAMED").otherwise("UPDATED").alias("operation"))
    ch.write_changes(spark, collection, feed.unionByName(fx.changes(spark, d)), fx.files(spark, d), EMBEDDER, 1)
    refused = collection.recorded(spark, "rejected", REJECTED_SCHEMA).select(F.lit("refused").alias("part"), "org_id", F.col("file_id").alias("id"), "code")
    bad = collection.recorded(spark, "quarantine", QUARANTINE_SCHEMA).select(F.lit("quarantined").alias("part"), "org_id", "id", "code")
    return refused.unionByName(bad)


@query("cdc_snapshot", with_ctes(f"SELECT {NODE_SQL} FROM next_node", "next_node"))
def cdc_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The same as one DataFrame, without a store."""
    change_set = ch.plan_changes(fx.changes(spark, d), fx.files(spark, d), EMBEDDER)
    return _shown(ch.next_snapshot(nodes(spark, d), change_set))


@query(
    "cdc_files",
    with_ctes(
        """SELECT org_id, id, name FROM file WHERE (org_id, id) NOT IN (SELECT org_id, file_id FROM change)
           UNION ALL SELECT org_id, id, name FROM checked WHERE code IS NULL
             AND (org_id, id) IN (SELECT org_id, file_id FROM change WHERE operation <> 'DELETED')""",
        "checked",
        "change",
    ),
)
def cdc_files(spark: SparkSession, d: str) -> DataFrame:
    return ch.next_files(fx.files(spark, d), fx.changes(spark, d)).select("org_id", "id", "name")


REMOVAL_REQUESTS_SQL = """
    , request AS (SELECT i.org_id, account_token, CASE WHEN account_token LIKE '%_web' THEN admin_id ELSE 'nobody' END AS admin_id
                  FROM integration i JOIN org o ON o.id = i.org_id)
    , gone AS (SELECT r.org_id, account_token FROM request r JOIN org o ON o.id = r.org_id AND o.admin_id = r.admin_id)"""


@query(
    "integration_cascade",
    with_ctes(
        REMOVAL_REQUESTS_SQL
        + """
        SELECT 'file' AS part, org_id, id FROM file WHERE (org_id, account_token) NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'node', org_id, node_id FROM chunk WHERE (org_id, doc_id) NOT IN
            (SELECT org_id, id FROM file WHERE (org_id, account_token) IN (SELECT * FROM gone))
        UNION ALL SELECT 'integration', org_id, account_token FROM integration
            WHERE (org_id, account_token) NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'refused', org_id, account_token FROM request WHERE (org_id, account_token) NOT IN (SELECT * FROM gone)""",
        "file",
        "chunk",
        "integration",
        "org",
    ),
)
def integration_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Admins ask to remove their web account, the others' requests come from nobody; nodes are read back from the store."""
    orgs, held = fx.orgs(spark, d), fx.integrations(spark, d)
    asked = held.join(orgs.select(F.col("id").alias("org_id"), "admin_id"), "org_id")
    claimed = F.when(F.col("account_token").endswith("_web"), F.col("admin_id")).otherwise("nobody")
    requests = asked.select("org_id", "account_token", claimed.alias("admin_id"))
    done = ch.remove_integrations(requests, orgs, fx.files(spark, d), held)
    collection = _indexed(spark, d, "integration_cascade")
    done.write(spark, collection, 1)
    return (
        done.files.select(F.lit("file").alias("part"), "org_id", "id")
        .unionByName(collection.load(spark).select(F.lit("node").alias("part"), "org_id", F.col("node_id").alias("id")))
        .unionByName(
            done.others["integrations"].select(F.lit("integration").alias("part"), "org_id", F.col("account_token").alias("id"))
        )
        .unionByName(
            done.outcomes.where("not allowed").select(
                F.lit("refused").alias("part"), "org_id", F.col("account_token").alias("id")
            )
        )
    )


@query(
    "org_cascade",
    with_ctes(
        """
        , request AS (SELECT 'org_'||s_nationkey AS org_id, 'u'||min(s_suppkey) AS admin_id FROM supplier GROUP BY s_nationkey)
        , gone AS (SELECT r.org_id FROM request r JOIN org o ON o.id = r.org_id AND o.admin_id = r.admin_id)
        SELECT 'file' AS part, org_id, id FROM file WHERE org_id NOT IN (SELECT org_id FROM gone)
        UNION ALL SELECT 'node', org_id, node_id FROM chunk WHERE org_id NOT IN (SELECT org_id FROM gone)
        UNION ALL SELECT 'org', id, name FROM org WHERE id NOT IN (SELECT org_id FROM gone)
        UNION ALL SELECT 'user', organization_id, id FROM usr WHERE organization_id NOT IN (SELECT org_id FROM gone)
        UNION ALL SELECT 'member', org_id, user_id FROM member WHERE org_id NOT IN (SELECT org_id FROM gone)
        UNION ALL SELECT 'integration', org_id, account_token FROM integration WHERE org_id NOT IN (SELECT org_id FROM gone)""",
        "file",
        "chunk",
        "org",
        "usr",
        "member",
        "integration",
    ),
)
def org_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's first supplier number claims to be the admin; where that is true, the organization leaves tables and store."""
    claims = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    requests = claims.select(
        F.concat(F.lit("org_"), F.col("s_nationkey").cast("string")).alias("org_id"),
        F.concat(F.lit("u"), F.col("k").cast("string")).alias("admin_id"),
    )
    done = ch.remove_organizations(
        requests, fx.orgs(spark, d), fx.files(spark, d), fx.users(spark, d), fx.members(spark, d), fx.integrations(spark, d)
    )
    collection = _indexed(spark, d, "org_cascade")
    done.write(spark, collection, 1)

    def part(name: str, df: DataFrame, org: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.col(org).alias("org_id"), F.col(key).alias("id"))

    return (
        part("file", done.files, "org_id", "id")
        .unionByName(part("node", collection.load(spark), "org_id", "node_id"))
        .unionByName(part("org", done.others["orgs"], "id", "name"))
        .unionByName(part("user", done.others["users"], "organization_id", "id"))
        .unionByName(part("member", done.others["members"], "org_id", "user_id"))
        .unionByName(part("integration", done.others["integrations"], "org_id", "account_token"))
    )


DIRECTORY_SQL = """
    , c AS (SELECT *, 'org_'||c_nationkey AS org_id, 'u'||c_custkey AS uid FROM customer)
    , reg AS (SELECT s_suppkey AS request_id, s_name AS k, s_acctbal < 0 AS bad FROM supplier)
    , reg_o AS (SELECT 'register_org' AS action, request_id, CAST(CASE WHEN bad THEN 400 END AS BIGINT) AS code FROM reg)
    , adm AS (SELECT c_custkey AS request_id, org_id, o.admin_id, CASE WHEN c_acctbal >= 0 THEN o.admin_id ELSE uid END AS claimed
              FROM c JOIN org o ON o.id = c.org_id)
    , adm_ok AS (SELECT org_id, min(request_id) AS f FROM adm WHERE claimed = admin_id GROUP BY org_id)
    , adm_o AS (SELECT 'change_admin', request_id,
                       CASE WHEN request_id IN (SELECT f FROM adm_ok) THEN NULL ELSE 4201 END FROM adm)
    , inv AS (SELECT c_custkey AS request_id, org_id, c_mktsegment AS seg, o.admin_id,
                     CASE WHEN c_acctbal >= 0 THEN o.admin_id ELSE uid END AS claimed FROM c JOIN org o ON o.id = c.org_id)
    , inv_ok AS (SELECT org_id, seg, min(request_id) AS f FROM inv WHERE claimed = admin_id GROUP BY ALL)
    , inv_o AS (SELECT 'invite', request_id, CASE WHEN claimed <> admin_id THEN 4201
                       WHEN request_id IN (SELECT f FROM inv_ok) THEN NULL ELSE 4102 END FROM inv)
    , can AS (SELECT p_partkey AS request_id, 'org_'||(p_partkey%25) AS org_id, 'i'||p_partkey AS uid FROM part)
    , can_o AS (SELECT 'cancel', request_id, CASE WHEN i.id IS NULL THEN 4101 END
                FROM can LEFT JOIN invite i ON i.id = can.uid AND i.org_id = can.org_id)
    , ru AS (SELECT c_custkey AS request_id, 'i'||c_custkey AS id, c_acctbal < 0 AS bad FROM customer)
    , ru_o AS (SELECT 'register_user', request_id, CASE WHEN bad THEN 400 WHEN i.id IS NULL THEN 4006 END
               FROM ru LEFT JOIN invite i USING (id))
    , rm_o AS (SELECT 'remove_user', c_custkey, CASE WHEN c_acctbal < 0 OR uid = o.admin_id THEN
                      CASE WHEN c_acctbal < 0 AND uid <> o.admin_id THEN 4201 ELSE 400 END END
               FROM c JOIN org o ON o.id = c.org_id)
    , alls AS (SELECT * FROM reg_o UNION ALL SELECT * FROM adm_o UNION ALL SELECT * FROM inv_o UNION ALL SELECT * FROM can_o
               UNION ALL SELECT * FROM ru_o UNION ALL SELECT * FROM rm_o)
    SELECT action, request_id, code IS NULL AS accepted, code,
           CASE code WHEN 400 THEN 'Missing required field' WHEN 4201 THEN 'You don''t have permission'
                WHEN 4102 THEN 'User is already invited' WHEN 4101 THEN 'User is not invited'
                WHEN 4006 THEN 'Item does not exist' END AS reason
    FROM alls"""


def directory_changes(spark: SparkSession, d: str) -> dict[str, dr.Changes]:
    """One batch of each kind of directory request, from the given tables."""
    orgs, users, members, invites = (f(spark, d) for f in (fx.orgs, fx.users, fx.members, fx.invites))
    ts = F.lit("1700000000.0").alias("ts")
    sup = table(spark, d, "supplier")
    part = table(spark, d, "part")

    def uid(prefix: str, c: str):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    admins = orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), "admin_id")
    cust = table(spark, d, "customer").withColumn("org_id", uid("org_", "c_nationkey")).join(admins, "org_id")
    rich = F.col("c_acctbal") >= 0
    claimed = F.when(rich, F.col("admin_id")).otherwise(uid("u", "c_custkey")).alias("admin_id")
    register_orgs = sup.select(
        F.col("s_suppkey").alias("request_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") >= 0, F.concat("s_name", F.lit("@example.com"))).otherwise("").alias("email"),
        F.concat(F.lit("admin."), "s_name").alias("admin_email"),
        ts,
    )
    new_admin = cust.select(
        F.col("c_custkey").alias("request_id"),
        "org_id",
        claimed,
        uid("new", "c_custkey").alias("new_admin_id"),
        F.concat(uid("new", "c_custkey"), F.lit("@example.com")).alias("new_admin_email"),
    )
    invite = cust.select(
        F.col("c_custkey").alias("request_id"),
        "org_id",
        "org_name",
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("user_email"),
        claimed,
        ts,
    )
    cancel = (
        part.select(F.col("p_partkey").alias("request_id"), (F.col("p_partkey") % 25).alias("n"), uid("i", "p_partkey").alias("user_id"))
        .withColumn("org_id", uid("org_", "n"))
        .join(admins, "org_id")
        .select("request_id", "org_id", "org_name", "user_id", "admin_id")
    )
    register = cust.select(
        F.col("c_custkey").alias("request_id"),
        uid("i", "c_custkey").alias("id"),
        F.concat(uid("i", "c_custkey"), F.lit("@example.com")).alias("email"),
        F.when(rich, F.split_part("c_name", F.lit("#"), F.lit(1))).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        ts,
    )
    other = F.when(rich, F.col("admin_id")).otherwise(F.lit("nobody"))
    self_claim = F.when(uid("u", "c_custkey") == F.col("admin_id"), F.col("admin_id")).otherwise(other)
    remove = cust.select(
        F.col("c_custkey").alias("request_id"), uid("u", "c_custkey").alias("user_id"), self_claim.alias("admin_id")
    )
    return {
        "register_org": dr.register_organizations(register_orgs, orgs),
        "change_admin": dr.change_admins(new_admin, orgs),
        "invite": dr.invite_users(invite, orgs, invites),
        "cancel": dr.cancel_invites(cancel, orgs, invites),
        "register_user": dr.register_users(register, invites),
        "remove_user": dr.remove_users(remove, users, orgs, members),
    }


@query("directory_apply", with_ctes(DIRECTORY_SQL, "org", "invite"))
def directory_apply(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of every request of every kind."""
    out = None
    for action, done in directory_changes(spark, d).items():
        part = done.outcomes.select(
            F.lit(action).alias("action"), F.col("request_id").cast("bigint").alias("request_id"), "accepted", "code", "reason"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "directory_tables",
    with_ctes(
        DIRECTORY_SQL[: DIRECTORY_SQL.rindex("SELECT action, request_id, code IS NULL")]
        + """
        SELECT 'org' AS part, o.id AS id, CASE WHEN f IS NULL THEN o.admin_id ELSE 'new'||f END AS value
          FROM org o LEFT JOIN adm_ok ON adm_ok.org_id = o.id
        UNION ALL SELECT 'invite', id, org_id FROM invite WHERE id NOT IN
          (SELECT uid FROM can WHERE request_id IN (SELECT request_id FROM alls WHERE action = 'cancel' AND code IS NULL))
        UNION ALL SELECT 'user', 'u'||c_custkey, 'org_'||c_nationkey FROM customer WHERE c_custkey NOT IN
          (SELECT request_id FROM rm)
        UNION ALL SELECT 'member', 'u'||c_custkey, 'org_'||c_nationkey FROM customer WHERE c_custkey NOT IN
          (SELECT request_id FROM rm)""".replace("FROM rm)", "FROM alls WHERE action = 'remove_user' AND code IS NULL)"),
        "org",
        "invite",
    ),
)
def directory_tables(spark: SparkSession, d: str) -> DataFrame:
    """Organizations, invitations, users and members after their batches of requests are applied."""
    done = directory_changes(spark, d)
    tables = {"orgs": fx.orgs(spark, d), "invites": fx.invites(spark, d), "users": fx.users(spark, d), "members": fx.members(spark, d)}
    for action in ("cancel", "remove_user", "change_admin"):
        tables = dr.apply(tables, done[action])

    def part(name: str, df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(value).alias("value"))

    return (
        part("org", tables["orgs"], "id", "admin_id")
        .unionByName(part("invite", tables["invites"], "id", "org_id"))
        .unionByName(part("user", tables["users"], "id", "organization_id"))
        .unionByName(part("member", tables["members"], "user_id", "org_id"))
    )


@query(
    "integration_add",
    with_ctes(
        """
        , request AS (SELECT c_custkey AS request_id, o.id AS org_id, CASE WHEN c_acctbal >= 0 THEN o.admin_id ELSE 'nobody' END AS who,
                             o.admin_id, 'tok_'||c_nationkey||'_'||c_mktsegment AS account_token, c_mktsegment AS provider
                      FROM customer JOIN org o ON o.id = 'org_'||c_nationkey)
        , first AS (SELECT org_id, account_token, min(request_id) AS f FROM request WHERE who = admin_id GROUP BY ALL)
        , owner AS (SELECT 'tok_'||c_nationkey||'_'||c_mktsegment AS account_token,
                           arg_min('u'||c_custkey||'@example.com', 'u'||c_custkey) AS account_id
                    FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
        SELECT r.org_id, r.account_token, provider, account_id, 'SYNCING' AS status
        FROM request r JOIN first ON f = request_id LEFT JOIN owner w ON w.account_token = r.account_token""",
        "org",
    ),
)
def integration_add(spark: SparkSession, d: str) -> DataFrame:
    """Every customer asks for an account of their market segment in their organization; only admins may."""
    cust = table(spark, d, "customer").withColumn("org_id", F.concat(F.lit("org_"), F.col("c_nationkey").cast("string")))
    orgs = fx.orgs(spark, d)
    token = F.concat(F.lit("tok_"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_mktsegment"))
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    owners = rollup.account_owners(
        cust.select(
            token.alias("account_token"),
            user.alias("id"),
            F.concat(user, F.lit("@example.com")).alias("email"),
            (F.col("c_acctbal") > 0).alias("is_me"),
        )
    )
    requests = cust.join(orgs.select(F.col("id").alias("org_id"), F.col("admin_id").alias("boss")), "org_id").select(
        F.col("c_custkey").alias("request_id"),
        "org_id",
        F.when(F.col("c_acctbal") >= 0, F.col("boss")).otherwise("nobody").alias("admin_id"),
        token.alias("account_token"),
        F.col("c_mktsegment").alias("provider"),
        F.lit("1700000000.0").alias("ts"),
    )
    done = dr.add_integrations(requests, orgs, owners)
    return done.puts["integrations"].select("org_id", "account_token", "provider", "account_id", "status")


@query("stream_cdc", with_ctes(f"SELECT {NODE_SQL} FROM next_node", "next_node"))
def stream_cdc(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as a stream, applied in micro-batches; the collection is read back."""
    collection = _indexed(spark, d, "stream_cdc")
    labels = fx.stream(spark, d, "labels")
    feed = fx.changes(spark, d, labels)
    run = jobs.sync_collection(
        feed, lambda: fx.files(spark, d), collection, EMBEDDER, run_dir(spark, "stream_cdc_log"), available_now=True
    )
    run.awaitTermination()
    return _shown(collection.load(spark))


@query("stream_query", with_ctes("SELECT qid, payload FROM payload", "payload"))
def stream_query(spark: SparkSession, d: str) -> DataFrame:
    """The questions as a stream; the answers are read back."""
    held = nodes(spark, d)
    turns = fx.stream(spark, d, "conversations")
    out = run_dir(spark, "stream_query")
    run = jobs.answer_questions(
        fx.questions(spark, d, turns),
        lambda: held,
        fx.files(spark, d),
        fx.members(spark, d),
        EMBEDDER,
        out,
        run_dir(spark, "stream_query_log"),
        available_now=True,
    )
    run.awaitTermination()
    return spark.read.schema("qid bigint, payload string").parquet(out).select("qid", "payload")


@query(
    "stream_metrics",
    """
    SELECT w AS window_start, round(sum(v),6) AS sum_value, round(avg(v),6) AS avg_value, round(max(v),6) AS max_value,
           count(*) AS n_series
    FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w, user_id, avg(value) AS v FROM events GROUP BY ALL)
    WHERE w + INTERVAL 5 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events) GROUP BY w""",
)
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed; the last ones stay open until more samples come."""
    events = fx.stream(spark, d, "events")
    out = run_dir(spark, "stream_metrics")
    samples = events.select("ts", F.col("user_id").alias("series"), "value")
    run = jobs.rolling_metrics(samples, out, run_dir(spark, "stream_metrics_log"), available_now=True)
    run.awaitTermination()
    rolled = spark.read.parquet(out)
    return rolled.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
