"""Fixed schemas of the stored tables (all times are UTC)."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (T.StringType(), T.IntegerType(), T.LongType(),
                           T.DoubleType(), T.BooleanType(), T.TimestampType())


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FEEDS = _struct(
    ("key", _S), ("name", _S), ("url", _S), ("category", _S), ("active", _B),
    ("created_at", _TS), ("updated_at", _TS),
    ("last_fetched_at", _TS), ("last_fetch_status", _S), ("last_fetch_error", _S),
    ("last_articles_count", _I),
    ("feed_title", _S), ("feed_description", _S), ("feed_updated", _S))

ARTICLES = _struct(
    ("article_id", _S), ("title", _S), ("summary", _S), ("content", _S), ("link", _S),
    ("published", _TS), ("source", _S), ("category", _S), ("author", _S),
    ("tags", T.ArrayType(_S)), ("created_at", _TS), ("updated_at", _TS), ("feed_key", _S))

UPDATE_LOGS = _struct(
    ("run_id", _S), ("feed_key", _S), ("feed_name", _S), ("event_seq", _I),
    ("started_at", _TS), ("completed_at", _TS), ("status", _S),
    ("articles_found", _I), ("articles_new", _I), ("articles_indexed", _I), ("articles_updated", _I),
    ("error_message", _S), ("feed_entries_count", _I),
    ("feed_metadata", T.MapType(_S, _S)))

FEED_PAYLOADS = _struct(("feed_key", _S), ("fetched_at", _TS), ("payload", _S))

PAGES = _struct(("page_id", _L), ("url", _S), ("html", _S))

CORPUS = _struct(("title", _S), ("text", _S), ("label", _I))

SCORE_REQUESTS = _struct(("idx", _L), ("title", _S), ("content", _S))

SNAPSHOTS = _struct(
    ("snapshot_ts", _S), ("table_name", _S), ("path", _S), ("row_count", _L),
    ("content_hash", _L), ("compression", _S), ("bytes", _L))
