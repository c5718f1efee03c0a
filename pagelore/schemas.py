"""Explicit table schemas; nothing in the package relies on inference."""

from pyspark.sql import types as T

LINK_INDEX = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("section", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("position", T.LongType()),
])

SECTIONS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("position", T.LongType()),
])

PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("page_type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

PAGE_HISTORY = T.StructType(PAGES.fields + [
    T.StructField("row_hash", T.StringType()),
    T.StructField("valid_from", T.TimestampNTZType()),
    T.StructField("valid_to", T.TimestampNTZType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("page_title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("heading_path", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUESTIONS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("answer_page_url", T.StringType()),
])

EXPERIMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ran_at", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("n_questions", T.LongType()),
    T.StructField("hit_rate", T.DoubleType()),
    T.StructField("mrr", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("extra", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
])

RETRIEVED = T.ArrayType(T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

# The 16 columns the exchange log writes, without the server-made id and time.
MESSAGE_WRITE_COLUMNS = [
    "conversation_id", "question", "answer", "route", "retrieval_config",
    "retrieved_chunks", "latency_ms", "error", "router", "provider", "model",
    "prompt_tokens", "completion_tokens", "cached", "sandbox_flow", "code_language",
]

FEEDBACK = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("given_at", T.TimestampType()),
])

# Reply of the router and of the judge. Kept as raw JSON text per field where a
# wrong type must not null the whole row.
ROUTER_REPLY = "map<string,string>"

COMPLETION_CACHE = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
