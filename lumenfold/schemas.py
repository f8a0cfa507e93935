"""Fixed schemas. A missing value keeps its stored sentinel: offset -1, dimension 0, time 0."""

from pyspark.sql import types as T

PENDING, INDEXED, FAILED = "pending", "indexed", "failed"
NO_OFFSET, ERROR_CHARS, MESSAGE_CHARS = -1, 400, 120
RECENT_LIMIT, FAILED_LIMIT, PAGE_SIZE, PREFETCH_ROWS, RESULT_LIMIT, CACHE_ROWS = 600, 100, 60, 12, 2000, 100
MAX_THRESHOLD = 0.5

_f = T.StructField
SCAN = T.StructType([
    _f("media_id", T.LongType()), _f("uri", T.StringType()), _f("display_name", T.StringType()), _f("mime_type", T.StringType()), _f("width", T.IntegerType()),
    _f("height", T.IntegerType()), _f("size_bytes", T.LongType()), _f("date_added", T.LongType()), _f("date_modified", T.LongType()),
])
STATE = T.StructType([
    _f("status", T.StringType()), _f("vector_offset", T.LongType()), _f("vector_dim", T.IntegerType()), _f("indexed_at", T.LongType()),
    _f("model_version", T.StringType()), _f("error", T.StringType()), _f("retry_count", T.IntegerType()),
])
CATALOG = T.StructType(SCAN.fields + STATE.fields)
SCAN_COLUMNS, CATALOG_COLUMNS = SCAN.names, CATALOG.names
VECTORS = T.StructType([_f("media_id", T.LongType()), _f("vector_offset", T.LongType()), _f("embedding", T.ArrayType(T.FloatType()))])
QUERY_CACHE = T.StructType([_f("query_text", T.StringType()), _f("model_key", T.StringType()), _f("embedding", T.BinaryType()), _f("created_at", T.LongType())])
SCHEMA_VERSION = 2
_tokenizer = T.StructType([
    _f("type", T.StringType()), _f("tokenizerFileName", T.StringType()), _f("vocabFileName", T.StringType()), _f("mergesFileName", T.StringType()), _f("maxLength", T.IntegerType()),
    _f("bosToken", T.StringType()), _f("eosToken", T.StringType()), _f("padTokenId", T.IntegerType()),
])
_encoder = [_f("fileName", T.StringType()), _f("outputName", T.StringType()), _f("outputL2Normalize", T.BooleanType())]
MODEL = T.StructType([
    _f("id", T.StringType()), _f("displayName", T.StringType()), _f("family", T.StringType()), _f("version", T.StringType()), _f("embeddingDim", T.IntegerType()),
    _f("imageEncoder", T.StructType([*_encoder, _f("inputName", T.StringType()), _f("inputWidth", T.IntegerType()), _f("inputHeight", T.IntegerType()), _f("channels", T.IntegerType()), _f("layout", T.StringType()), _f("mean", T.ArrayType(T.FloatType())), _f("std", T.ArrayType(T.FloatType()))])),
    _f("textEncoder", T.StructType([*_encoder, _f("inputIdsName", T.StringType()), _f("attentionMaskName", T.StringType()), _f("inputDataType", T.StringType()), _f("tokenizer", _tokenizer)])),
    _f("notes", T.StringType()), _f("_corrupt_record", T.StringType()),
])
