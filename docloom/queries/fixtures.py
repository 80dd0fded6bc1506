"""The data model's tables, derived from the given test tables: as DataFrames and as SQL views.

Attributes the test tables lack (file extension, account, change date) are derived from each row, for every
row of the table. `CTES` holds the same derivations for the SQL check.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.values import process_date


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's rows as a stream, whether the table is one file or a folder of part files.

    The path is given as a pattern that only its own name fits: Spark takes a plain path for a folder, and a filter by file name
    would find no part file.
    """
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def as_rtf(text: Column) -> Column:
    """The text as an rtf document with a font table and a picture; its lines are paragraphs."""
    escaped = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([{}])", r"\\$1")
    head = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}{\f1 Times;}}{\pict\wmetafile8 " + "0a1b" * 50 + r"}\pard\f0 "
    return F.concat(F.lit(head), F.replace(escaped, F.lit("\n"), F.lit(r"\par ")), F.lit("}"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Listed files: every document and every page with its content, and a file that is refused for every supplier."""
    n = F.substring("source", 4, 10)
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("html", "txt", "csv", "txt", "csv", "csv", "html", "txt")]),
        (F.col("doc_id") % 8 + 1).cast("int"),
    )
    base = F.lit("2024-01-01").cast("timestamp")
    day = F.make_dt_interval((F.col("doc_id") % 30).cast("int"))
    page_day = F.make_dt_interval((F.col("page_id") % 30).cast("int"))
    page_org = (F.col("page_id") % 20).cast("string")
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), _text("doc_id")).alias("id"),
        F.concat(F.lit("org_"), n).alias("org_id"),
        F.concat(F.lit("tok_"), n, F.lit("_"), (F.col("doc_id") % 2).cast("string")).alias("account_token"),
        F.concat(F.lit("r"), _text("doc_id")).alias("remote_id"),
        F.concat(F.lit("f."), _text("doc_id"), F.lit("."), ext).alias("name"),
        F.concat(F.lit("https://files.example.com/d"), _text("doc_id")).alias("file_url"),
        F.col("n_chars").alias("size"),
        F.lit(None).cast("string").alias("mime_type"),
        F.concat(F.lit("fold_"), F.col("lang")).alias("folder"),
        F.when(F.col("lang") != "en", F.concat(F.lit("drive_"), n)).alias("drive"),
        F.when(F.col("lang") != "fr", base + day).alias("modified_at"),
        process_date(base + day).alias("process_date"),
        F.lit("note").alias("description"),
        F.col("text").alias("content"),
    )
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("p"), _text("page_id")).alias("id"),
        F.concat(F.lit("org_"), page_org).alias("org_id"),
        F.concat(F.lit("tok_"), page_org, F.lit("_web")).alias("account_token"),
        F.concat(F.lit("r"), F.col("url")).alias("remote_id"),
        F.concat(F.lit("page."), _text("page_id"), F.lit(".html")).alias("name"),
        F.col("url").alias("file_url"),
        F.length("html").cast("bigint").alias("size"),
        F.lit("text/html").alias("mime_type"),
        F.lit("fold_web").alias("folder"),
        F.lit("drive_web").alias("drive"),
        (base + page_day).alias("modified_at"),
        process_date(base + page_day).alias("process_date"),
        F.lit("page").alias("description"),
        F.col("html").alias("content"),
    )
    # No known type, no parser, no content, or no name.
    kind = (F.col("s_suppkey") % 5).cast("int")
    name = F.when(kind < 4, F.concat(F.lit("ref."), _text("s_suppkey"), F.lit("."), F.element_at(F.array(*map(F.lit, ("TXT", "pdf", "png", "txt"))), kind + 1)))
    supplier_org = F.concat(F.lit("org_"), _text("s_nationkey"))
    refused = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), _text("s_suppkey")).alias("id"),
        supplier_org.alias("org_id"),
        F.concat(F.lit("tok_"), _text("s_nationkey"), F.lit("_sup")).alias("account_token"),
        F.concat(F.lit("r"), F.col("s_name")).alias("remote_id"),
        name.alias("name"),
        F.concat(F.lit("https://files.example.com/s"), _text("s_suppkey")).alias("file_url"),
        F.lit(1).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("mime_type"),
        F.lit("fold_sup").alias("folder"),
        F.lit(None).cast("string").alias("drive"),
        base.alias("modified_at"),
        process_date(base).alias("process_date"),
        F.lit("refused").alias("description"),
        F.when(kind != 3, F.lit("x")).alias("content"),
    )
    return docs.unionByName(pages).unionByName(refused)


def orgs(spark: SparkSession, d: str) -> DataFrame:
    """Organizations from nations; the first customer of a nation is its admin."""
    first = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    n = table(spark, d, "nation")
    return n.join(first, n["n_nationkey"] == first["c_nationkey"], "left").select(
        F.concat(F.lit("org_"), _text("n_nationkey")).alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("u"), _text("k")).alias("admin_id"),
        F.concat(F.lit("u"), _text("k"), F.lit("@example.com")).alias("admin_email"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.concat(F.lit("u"), _text("c_custkey")).alias("id"),
        F.concat(F.lit("u"), _text("c_custkey"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("Customer "), F.split_part("c_name", F.lit("#"), F.lit(2))).alias("name"),
        F.concat(F.lit("org_"), _text("c_nationkey")).alias("organization_id"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).select(F.col("organization_id").alias("org_id"), F.col("id").alias("user_id"))


def invites(spark: SparkSession, d: str) -> DataFrame:
    """Invitations from suppliers: supplier k invites user i<k> to its nation."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("i"), _text("s_suppkey")).alias("id"),
        F.concat(F.lit("org_"), _text("s_nationkey")).alias("org_id"),
        F.col("n_name").alias("org_name"),
        F.concat(F.lit("i"), _text("s_suppkey"), F.lit("@example.com")).alias("org_user_email"),
    )


def integrations(spark: SparkSession, d: str) -> DataFrame:
    """One integration per account; its owner is the account token's address."""
    return (
        files(spark, d)
        .groupBy("org_id", "account_token")
        .agg(F.min("modified_at").alias("created"))
        .withColumn("account_id", F.concat(F.col("account_token"), F.lit("@example.com")))
        .withColumn("status", F.lit("SYNCING"))
    )


def status_log(spark: SparkSession, d: str) -> DataFrame:
    """Status changes from events: the user's number picks the organization, the event type the status."""
    status = (
        F.when(F.col("event_type") == "purchase", "SUCCESS")
        .when(F.col("event_type") == "error", "FAIL")
        .when(F.col("event_type") == "click", "INDEXING")
        .otherwise("SYNCING")
    )
    return table(spark, d, "events").select(
        F.concat(F.lit("org_"), (F.col("user_id") % 20).cast("string")).alias("org_id"),
        F.concat(F.lit("tok_"), _text("user_id")).alias("account_token"),
        status.alias("status"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that sync: one per customer and day with events, and one idle account per customer."""
    busy = table(spark, d, "events").select(_account().alias("account_token")).distinct()
    idle = table(spark, d, "customer").select(F.concat(F.lit("idle_"), _text("c_custkey")).alias("account_token"))
    return busy.unionByName(idle)


def _account() -> Column:
    return F.concat(F.lit("acc_"), _text("user_id"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd"))


def sync_statuses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "SYNCING").otherwise("DONE")
    return table(spark, d, "events").select(_account().alias("account_token"), status.alias("status"))


def changes(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    """Change feed from labels: toxic documents are deleted, good ones updated, the others created."""
    source = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels") if labels is None else labels
    operation = F.when(F.col("toxic") == 1, "DELETED").when(F.col("quality") == 1, "UPDATED").otherwise("CREATED")
    return labels.join(source, "doc_id").select(
        F.concat(F.lit("org_"), F.substring("source", 4, 10)).alias("org_id"),
        F.concat(F.lit("d"), _text("doc_id")).alias("file_id"),
        operation.alias("operation"),
    )


def questions(spark: SparkSession, d: str, turns: DataFrame | None = None) -> DataFrame:
    """Every user turn is a question; the asker is the customer with the conversation's number."""
    turns = table(spark, d, "conversations") if turns is None else turns
    asked = turns.where(F.col("role") == "user")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return asked.join(c, asked["conv_id"] == c["c_custkey"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("qid"),
        F.concat(F.lit("org_"), _text("c_nationkey")).alias("org_id"),
        F.concat(F.lit("u"), _text("conv_id")).alias("user_id"),
        "text",
    )


def metric_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("ts", F.col("user_id").alias("series"), "value")


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "file": (
        (),
        """
        SELECT 'd'||doc_id AS id, 'org_'||substr(source,4) AS org_id,
               'tok_'||substr(source,4)||'_'||(doc_id%2) AS account_token, 'r'||doc_id AS remote_id,
               'f.'||doc_id||'.'||(['html','txt','csv','txt','csv','csv','html','txt'])[doc_id%8+1] AS name,
               'https://files.example.com/d'||doc_id AS file_url, CAST(n_chars AS BIGINT) AS size,
               CAST(NULL AS VARCHAR) AS mime_type, 'fold_'||lang AS folder,
               CASE WHEN lang<>'en' THEN 'drive_'||substr(source,4) END AS drive,
               CASE WHEN lang<>'fr' THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id%30 AS INT)) END AS modified_at,
               strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id%30 AS INT)), '%m/%d/%Y, %H:%M:%S') AS process_date,
               text AS content
        FROM documents
        UNION ALL
        SELECT 'p'||page_id, 'org_'||(page_id%20), 'tok_'||(page_id%20)||'_web', 'r'||url, 'page.'||page_id||'.html',
               url, CAST(length(html) AS BIGINT), 'text/html', 'fold_web', 'drive_web',
               TIMESTAMP '2024-01-01' + to_days(CAST(page_id%30 AS INT)),
               strftime(TIMESTAMP '2024-01-01' + to_days(CAST(page_id%30 AS INT)), '%m/%d/%Y, %H:%M:%S'),
               html
        FROM pages
        UNION ALL
        SELECT 's'||s_suppkey, 'org_'||s_nationkey, 'tok_'||s_nationkey||'_sup', 'r'||s_name,
               CASE WHEN s_suppkey%5 < 4 THEN 'ref.'||s_suppkey||'.'||(['TXT','pdf','png','txt'])[s_suppkey%5+1] END,
               'https://files.example.com/s'||s_suppkey, CAST(1 AS BIGINT), NULL, 'fold_sup', NULL, TIMESTAMP '2024-01-01',
               '01/01/2024, 00:00:00', CASE WHEN s_suppkey%5 <> 3 THEN 'x' END
        FROM supplier""",
    ),
    "org": (
        (),
        """
        SELECT 'org_'||n_nationkey AS id, n_name AS name, lower(n_name)||'@example.com' AS email,
               'u'||k AS admin_id, 'u'||k||'@example.com' AS admin_email
        FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY c_nationkey)
          ON n_nationkey = c_nationkey""",
    ),
    "usr": (
        (),
        """
        SELECT 'u'||c_custkey AS id, 'u'||c_custkey||'@example.com' AS email,
               'Customer '||split_part(c_name,'#',2) AS name, 'org_'||c_nationkey AS organization_id
        FROM customer""",
    ),
    "member": (("usr",), "SELECT organization_id AS org_id, id AS user_id FROM usr"),
    "invite": (
        (),
        """
        SELECT 'i'||s_suppkey AS id, 'org_'||s_nationkey AS org_id, n_name AS org_name,
               'i'||s_suppkey||'@example.com' AS org_user_email
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "integration": (
        ("file",),
        """
        SELECT org_id, account_token, min(modified_at) AS created, account_token||'@example.com' AS account_id,
               'SYNCING' AS status
        FROM file GROUP BY org_id, account_token""",
    ),
    "status_log": (
        (),
        """
        SELECT 'org_'||(user_id%20) AS org_id, 'tok_'||user_id AS account_token,
               CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'INDEXING'
                    ELSE 'SYNCING' END AS status, ts, event_id AS seq
        FROM events""",
    ),
    "sync_status": (
        (),
        """
        SELECT 'acc_'||user_id||'_'||strftime(ts,'%Y-%m-%d') AS account_token,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'SYNCING' ELSE 'DONE' END AS status
        FROM events""",
    ),
    "account": (
        ("sync_status",),
        """
        SELECT DISTINCT account_token FROM sync_status
        UNION ALL SELECT 'idle_'||c_custkey FROM customer""",
    ),
    "change": (
        (),
        """
        SELECT 'org_'||substr(source,4) AS org_id, 'd'||doc_id AS file_id,
               CASE WHEN toxic=1 THEN 'DELETED' WHEN quality=1 THEN 'UPDATED' ELSE 'CREATED' END AS operation
        FROM labels JOIN documents USING (doc_id)""",
    ),
    "question": (
        (),
        """
        SELECT conv_id*100+turn AS qid, 'org_'||c_nationkey AS org_id, 'u'||conv_id AS user_id, text
        FROM conversations JOIN customer ON conv_id = c_custkey WHERE role = 'user'""",
    ),
}


def with_ctes(body: str, *names: str) -> str:
    """The SQL body below the named views and all they need. A body that starts with a comma adds views."""
    from docloom.queries.text_sql import TEXT_CTES

    known = {**CTES, **TEXT_CTES}
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in known[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{n} AS ({known[n][1]})" for n in ordered)
    return f"WITH {views}\n{body}" if views else body
