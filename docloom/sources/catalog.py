"""Where files come from: a catalog table or a folder of raw files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import extension
from docloom.model import SUPPORTED_EXTENSIONS
from docloom.sources.office import OFFICE_EXTENSIONS, office_text


def list_files(catalog: DataFrame, account_token: str | None = None) -> DataFrame:
    """All files of the catalog, or of one account. Content is left out, so the scan never reads it."""
    listed = catalog.drop("content") if "content" in catalog.columns else catalog
    return listed if account_token is None else listed.where(F.col("account_token") == account_token)


def list_folder_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files below a folder as (id, name, size, modified_at, content).

    Column pruning keeps the bytes unread until `content` is selected.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    return raw.select(
        F.col("path").alias("id"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        F.col("content"),
    )


def as_text(raw: DataFrame) -> DataFrame:
    """Bytes to text by extension, with `unreadable` set where that failed.

    Office files give their paragraphs, slides or rows as lines; the others must be UTF-8. Only office bytes go
    to Python: the function is given null for every other file.
    """
    is_office = extension(F.col("name")).isin(OFFICE_EXTENSIONS)
    from_office = office_text(F.when(is_office, F.col("content")), extension(F.col("name")))
    decoded = F.when(~is_office, F.expr("try_validate_utf8(cast(content as string))"))
    text = raw.withColumns({"_text": F.coalesce(from_office, decoded), "_had": F.col("content").isNotNull()})
    return text.drop("content").withColumn("unreadable", F.col("_had") & F.col("_text").isNull()).withColumn(
        "content", F.coalesce("_text", F.when(F.col("_had"), F.lit("")))
    ).drop("_text", "_had")


def list_folders(folders: DataFrame, folder_id: str | None = None, drive_id: str | None = None) -> DataFrame:
    """Sub-folders of a folder, of a drive, or of both; at least one is needed."""
    if not folder_id and not drive_id:
        raise ValueError("list_folders needs a folder_id or a drive_id")
    if folder_id:
        folders = folders.where(F.col("parent_id") == folder_id)
    if drive_id:
        folders = folders.where(F.col("drive_id") == drive_id)
    return folders


def list_folders_for(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for many requests (request_id, folder_id, drive_id) at once.

    Requests join on the id they give; one with both ids checks the other as well.
    Requests without any id are not answered here (see `required_fields`).
    """
    wanted = requests.select("request_id", F.nullif("folder_id", F.lit("")).alias("f"), F.nullif("drive_id", F.lit("")).alias("d"))
    by_folder = folders.join(wanted.where("f is not null"), F.col("parent_id") == F.col("f")).where(
        "d is null or d = drive_id"
    )
    by_drive = folders.join(wanted.where("f is null and d is not null"), F.col("drive_id") == F.col("d"))
    return by_folder.unionByName(by_drive).select("request_id", *folders.columns)


def supported(files: DataFrame) -> DataFrame:
    """Files whose extension can be processed. Runs before content is read."""
    return files.where(extension(F.col("name")).isin(SUPPORTED_EXTENSIONS))


def read_content(files: DataFrame) -> DataFrame:
    return supported(files).where(F.col("content").isNotNull()).select("id", "name", "content")
