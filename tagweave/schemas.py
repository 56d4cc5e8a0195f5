"""Fixed schemas of every table the operators read or write."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])
CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
BENCHMARK = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
])

# Page fields as the extension reads them from an open tab.
PAGE_FIELDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("texts", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("styled_texts", T.ArrayType(T.StringType())),
])

CONDITION = T.StructType([
    T.StructField("source", T.IntegerType()), T.StructField("type", T.IntegerType()),
    T.StructField("value", T.StringType()),
])
RULES = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("conditions", T.ArrayType(CONDITION)),
])
DOC_TAGS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType()),
])
DOC_GROUPS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("group_id", T.LongType()),
    T.StructField("group_title", T.StringType()),
])
TAG_EVENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("tag", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# Rule enums of the extension.
SOURCE_TAGS, SOURCE_TITLE, SOURCE_CONTENT = 1, 2, 3
TYPE_CONTAINS, TYPE_DOESNT_CONTAIN = 1, 2

TABLES = {
    "documents": DOCUMENTS, "pages": PAGES, "labels": LABELS,
    "conversations": CONVERSATIONS, "events": EVENTS, "benchmark": BENCHMARK,
}
