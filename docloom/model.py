"""Fixed values and record shapes of the data model."""

from pyspark.sql import types as T

# Results depend on these exact texts and numbers.
SUPPORTED_EXTENSIONS = ["html", "rtf", "txt", "csv", "doc", "docx", "pdf", "ppt", "pptx", "xlsx"]
OPERATIONS = ["CREATED", "UPDATED", "DELETED"]
STATUSES = ["SYNCING", "INDEXING", "SUCCESS", "FAIL"]
PROCESS_DATE_FORMAT = "MM/dd/yyyy, HH:mm:ss"
FALLBACK_ANSWER = "Please try again later"
LOOKUP_BATCH = 50
WRITE_BATCH = 100
EMBED_BATCH = 100
SIMILARITY_TOP_K = 10
RERANK_TOP_N = 3
RECENCY_TOP_K = 5
SENTENCE_CUTOFF = 0.7
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 20

# Reason codes of rejected records.
REASONS = {
    "BAD_REQUEST": (400, "Missing required field"),
    "COULD_NOT_DOWNLOAD_FILE": (4005, "Could not download file"),
    "ITEM_DOES_NOT_EXIST": (4006, "Item does not exist"),
    "USER_DOES_NOT_EXIST": (4007, "User does not exist"),
    "USER_NOT_INVITED": (4101, "User is not invited"),
    "USER_ALREADY_INVITED": (4102, "User is already invited"),
    "FILE_TYPE_NOT_SUPPORTED": (4102, "File type not supported"),
    "NOT_ENOUGH_PERMISSION": (4201, "You don't have permission"),
    "INVALID_ARGUMENT": (4501, "Invalid argument"),
    # No parser for this format is installed; the file is quarantined.
    "PARSER_NOT_AVAILABLE": (4901, "No parser for this file type"),
    "PARSE_FAILED": (4902, "Could not parse file"),
}

# What each field holds when the stored record lacks it.
FILE_DEFAULTS = {
    "id": "",
    "remote_id": "",
    "name": "",
    "file_url": "",
    "file_thumbnail_url": "",
    "size": 0,
    "mime_type": "",
    "folder": "",
    "permissions": [],
    "drive": "",
    "remote_was_deleted": False,
    "modified_at": "",
    "field_mappings": {},
}
ORGANIZATION_DEFAULTS = {
    "id": "",
    "name": "",
    "email": "",
    "admin_id": "",
    "admin_email": "",
    "user_list": [],
    "invited_user_list": [],
    "link_id_map": {},
    "document_list": [],
    "created_at": "",
    "updated_at": "",
}
USER_DEFAULTS = {
    "id": "",
    "email": "",
    "name": "",
    "organization_id": "",
    "created_at": "",
    "updated_at": "",
}
INVITATION_DEFAULTS = {
    "id": "",
    "org_name": "",
    "org_id": "",
    "org_user_email": "",
    "created_at": "",
}
ACCESS_DEFAULTS = {"id": "", "permissions": [], "created_at": "", "updated_at": ""}

# Fields of a listed file that are not kept in the file table.
FILE_DROPPED_FIELDS = ["description", "remote_data", "remote_created_at", "remote_updated_at"]

NODE_SCHEMA = T.StructType(
    [
        T.StructField("org_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_idx", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("process_date", T.StringType()),
    ]
)
QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("org_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("code", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
REJECTED_SCHEMA = T.StructType(
    [
        T.StructField("org_id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("code", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
