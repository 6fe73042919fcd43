"""Declared schemas.  Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

from postmart.functions.scalars import STAT_FIELDS

STATS = T.StructType([
    T.StructField(name, T.ArrayType(T.StringType()) if name == "max_drawdown_period" else T.DoubleType())
    for name in STAT_FIELDS
])



def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, COUNT = T.StringType(), T.LongType()
AUTHOR = _record(id=TEXT, name=TEXT, head_img_key=TEXT, vip_type=TEXT)
RESEARCH = _record(notebook_path=TEXT, notebook_report=TEXT, notebook_clone_count=COUNT)
FILE = _record(key=TEXT, name=TEXT, type=TEXT, size=COUNT, download_count=COUNT)
TAGS = T.ArrayType(_record(id=TEXT, name=TEXT))
BACKTEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("clone_count", T.LongType()),
    T.StructField("pic_url", T.StringType()),
    T.StructField("stats", STATS),
    T.StructField("stats_error", T.StringType()),
])

# One row of the archive: the union of feed, detail and statistics fields.
ARCHIVE = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("id", T.StringType()),
        ("internal_post_id", T.StringType()),
        ("title", T.StringType()),
        ("url", T.StringType()),
        ("content", T.StringType()),
        ("content_preview", T.StringType()),
        ("author", AUTHOR),
        ("published_at", T.StringType()),
        ("updated_at", T.StringType()),
        ("last_active_at", T.StringType()),
        ("last_reply_at", T.StringType()),
        ("last_reply_id", T.StringType()),
        ("reply_count", T.LongType()),
        ("view_count", T.LongType()),
        ("like_count", T.LongType()),
        ("dislike_count", T.LongType()),
        ("collection_count", T.LongType()),
        ("is_top", T.BooleanType()),
        ("is_best", T.BooleanType()),
        ("is_rich", T.BooleanType()),
        ("is_worth", T.BooleanType()),
        ("type", T.LongType()),
        ("status", T.StringType()),
        ("ip_address", T.StringType()),
        ("tags", TAGS),
        ("bounty", T.StringType()),
        ("curr_time", T.StringType()),
        ("backtest", BACKTEST),
        ("research", RESEARCH),
        ("file", FILE),
        ("list_fetched_at", T.StringType()),
        ("detail_fetched_at", T.StringType()),
        ("detail_error", T.StringType()),
        ("detail_attempted_at", T.StringType()),
    ]
])

# Archive lines as they may have been written: also the fields that stand in for missing ones.
_FALLBACKS = {"backtest": T.StructType([
    T.StructField("stats", T.StructType([*STATS.fields, T.StructField("annual_return", T.DoubleType())])) if f.name == "stats" else f
    for f in BACKTEST.fields
])}
ARCHIVE_LINES = T.StructType([
    *[T.StructField(f.name, _FALLBACKS.get(f.name, f.dataType)) for f in ARCHIVE.fields],
    *[T.StructField(name, TEXT) for name in ("post_id", "requested_id", "author_name")],
])

# The typed serving row, and its projection without the content.
POST_COLUMNS = [
    "id", "title", "url", "published_at", "updated_at", "author_name", "content", "content_preview",
    "view_count", "like_count", "reply_count", "backtest_id", "backtest_name", "trading_days",
    "period_years", "annual_return", "sharpe", "max_drawdown", "clone_count", "is_original_candidate",
    "source", "raw_json", "created_at", "refreshed_at",
]
INDEX_COLUMNS = [
    c for c in POST_COLUMNS if c not in ("content", "source", "raw_json", "created_at", "refreshed_at")
]
