"""Raw payload rows to canonical records, and canonical records to typed serving rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postmart.functions import scalars as X
from postmart.functions.labels import CANDIDATE_LABEL
from postmart.schemas import ARCHIVE, INDEX_COLUMNS, POST_COLUMNS

# Characters that end a line of text, besides the line feed.
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


#: The value at a path of an object that was read before.
Read = Callable[[str], Column]


def _text(v: Column, path: str, read: Read | None = None) -> Column:
    return F.coalesce(read(path) if read else X.vget(v, path), F.lit(""))


def _count(v: Column, path: str, read: Read | None = None) -> Column:
    return X.int_json(v, path, 0, read and read(path))


def _flag(v: Column, path: str, read: Read | None = None) -> Column:
    return X.flag_json(v, path, read and read(path))


def _common(v: Column, read: Read | None = None) -> dict[str, Column]:
    """Fields that feed rows and detail payloads share."""
    return {
        "id": _text(v, "postId", read),
        "title": _text(v, "title", read),
        "published_at": _text(v, "addTime", read),
        "updated_at": _text(v, "modTime", read),
        "last_active_at": _text(v, "lastActiveTime", read),
        "reply_count": _count(v, "replyCount", read),
        "view_count": _count(v, "viewCount", read),
        "like_count": _count(v, "likeCount", read),
        "collection_count": _count(v, "collectionCount", read),
        "is_top": _flag(v, "isTop", read),
        "is_best": _flag(v, "isBest", read),
        "research": F.struct(
            _text(v, "notebookPath", read).alias("notebook_path"),
            _text(v, "notebookReport", read).alias("notebook_report"),
            _count(v, "notebookCloneCount", read).alias("notebook_clone_count"),
        ),
        "tags": X.normalize_tags(F.coalesce(read("tagInfo"), F.array().cast("array<variant>")) if read else X.vlist(v, "tagInfo")),
    }


# What a feed row is read for, in one pass over its variant.
_FEED_ROW = {
    **dict.fromkeys([
        "postId", "title", "addTime", "modTime", "lastActiveTime", "lastReplyTime", "replyCount", "viewCount", "likeCount",
        "collectionCount", "isTop", "isBest", "notebookPath", "notebookReport", "notebookCloneCount", "backtestId",
        "backtestCloneCount", "backtestPicUrl", "fileKey", "fileName", "fileType", "fileDownloadCount", "content",
    ], "string"),
    "user": "struct<userId: string, alias: string>", "tagInfo": "array<variant>",
}


def normalize_feed_post(df: DataFrame, item: str = "item", base_url: str = X.DEFAULT_POST_URL) -> DataFrame:
    """Feed row objects (variant column) to canonical posts; other columns are kept.  A ``user`` or
    ``tagInfo`` of the wrong shape counts as empty."""
    v, read = F.col(item), lambda path: F.col(f"__raw.{path}")
    fields = _common(v, read)
    fields["url"] = F.concat(F.lit(base_url), fields["id"])
    fields["author"] = F.struct(_text(v, "user.userId", read).alias("id"), _text(v, "user.alias", read).alias("name"))
    fields["last_reply_at"] = _text(v, "lastReplyTime", read)
    fields["backtest"] = F.struct(
        _text(v, "backtestId", read).alias("id"),
        _count(v, "backtestCloneCount", read).alias("clone_count"),
        _text(v, "backtestPicUrl", read).alias("pic_url"),
    )
    fields["file"] = F.struct(
        _text(v, "fileKey", read).alias("key"),
        _text(v, "fileName", read).alias("name"),
        _text(v, "fileType", read).alias("type"),
        _count(v, "fileDownloadCount", read).alias("download_count"),
    )
    fields["content_preview"] = _text(v, "content", read)
    rest = [c for c in df.columns if c != item]
    return df.withColumn("__raw", X.vrecord(v, _FEED_ROW)).select(*rest, *[c.alias(n) for n, c in fields.items()])


def normalize_post_detail(
    df: DataFrame, requested_id: str = "requested_id", data: str = "data", base_url: str = X.DEFAULT_POST_URL
) -> DataFrame:
    """Detail payloads (variant column) to canonical details.  The address uses the requested id; the
    author id falls back to the top-level user id; ``bounty`` keeps its JSON text because it comes as
    an object or a list."""
    v = F.col(data)
    fields = _common(v)
    fields["url"] = F.concat(F.lit(base_url), F.col(requested_id))
    fields["content"] = _text(v, "content")
    fields["author"] = F.struct(
        F.coalesce(X.vget(v, "author.userId"), X.vget(v, "userId"), F.lit("")).alias("id"),
        _text(v, "author.alias").alias("name"),
        _text(v, "author.headImgKey").alias("head_img_key"),
        _text(v, "author.vipType").alias("vip_type"),
    )
    fields["last_reply_id"] = _text(v, "lastReplyId")
    fields["dislike_count"] = _count(v, "disLikeCount")
    fields["is_rich"] = _flag(v, "isRich")
    fields["is_worth"] = _flag(v, "isWorth")
    fields["type"] = X.int_json(v, "type")
    fields["status"] = _text(v, "status")
    fields["ip_address"] = _text(v, "ipAddress")
    fields["backtest"] = F.struct(
        _text(v, "backtestId").alias("id"),
        _text(v, "backtestName").alias("name"),
        _count(v, "backtestCloneCount").alias("clone_count"),
    )
    fields["file"] = F.struct(
        _text(v, "fileKey").alias("key"),
        _text(v, "fileName").alias("name"),
        _text(v, "fileType").alias("type"),
        _count(v, "fileSize").alias("size"),
        _count(v, "fileDownloadCount").alias("download_count"),
    )
    bounty = X.vget(v, "bounty", "variant")
    fields["bounty"] = F.when(X.vkind(bounty).isin("OBJECT", "ARRAY"), F.to_json(bounty)).otherwise(F.lit("[]"))
    fields["curr_time"] = _text(v, "currTime")
    rest = [c for c in df.columns if c not in (data, requested_id)]
    return df.select(F.col(requested_id), *rest, *[c.alias(n) for n, c in fields.items()])


def conform(df: DataFrame, schema: T.StructType = ARCHIVE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the archive schema and the columns in ``keep``; absent columns and struct fields become NULL
    (absent)."""

    def fit(col: Column, have: T.DataType, want: T.DataType) -> Column:
        if have.simpleString() == want.simpleString():
            return col
        if isinstance(want, T.StructType) and isinstance(have, T.StructType):
            names = set(have.fieldNames())
            parts = [
                (fit(col[f.name], have[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType))
                .alias(f.name)
                for f in want.fields
            ]
            return F.when(col.isNotNull(), F.struct(*parts))
        return col.cast(want)

    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (fit(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ], *keep)


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def compact_post(df: DataFrame, canonical: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fixed 19-field feed projection with defaults, and the columns in ``keep``.  The canonical form adds the
    fetch time and an empty backtest name."""
    text = ["id", "title", "url", "published_at", "updated_at", "last_active_at", "last_reply_at", "content_preview"]
    count = ["reply_count", "view_count", "like_count", "collection_count"]
    flag = ["is_top", "is_best"]
    have = set(df.columns)
    pick = lambda name, default: (
        F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    )
    backtest = df.schema["backtest"].dataType if "backtest" in have else T.StructType()
    sub = lambda name, default: (
        F.coalesce(F.col(f"backtest.{name}"), F.lit(default)) if name in backtest.fieldNames() else F.lit(default)
    )
    parts = [
        sub("id", "").alias("id"), sub("clone_count", 0).cast("bigint").alias("clone_count"),
        sub("pic_url", "").alias("pic_url"),
    ]
    if canonical:
        parts.append(sub("name", "").alias("name"))
    out = [pick(c, "").alias(c) for c in text]
    out += [pick(c, 0).cast("bigint").alias(c) for c in count]
    out += [pick(c, False).alias(c) for c in flag]
    out += [F.struct(*parts).alias("backtest")]
    out += [F.col(c) for c in ("author", "research", "file", "tags") if c in have]
    if canonical:
        out.append(_now().alias("list_fetched_at"))
    return df.select(*out, *keep)


def canonical_from_detail(detail: DataFrame) -> DataFrame:
    """Detail record to archive row: keyed by the requested id, the server's own id kept aside."""
    post_id = F.coalesce(X.nonblank("requested_id"), F.col("id"), F.lit(""))
    return detail.select(
        post_id.alias("id"),
        F.col("id").alias("internal_post_id"),
        *[c for c in detail.columns if c not in ("id", "requested_id")],
        _now().alias("detail_fetched_at"),
    )


def canonicalize_existing(df: DataFrame, base_url: str = X.DEFAULT_POST_URL) -> DataFrame:
    """Repair rows written by earlier versions: id falls back to the requested id, a blank address is
    rebuilt, missing backtest fields get defaults, unknown statistics were dropped by the schema."""
    have = set(df.columns)
    post_id = F.coalesce(X.nonblank("id"), F.col("requested_id") if "requested_id" in have else F.lit(None), F.lit(""))
    fixed = df.withColumn("id", post_id).drop("requested_id")
    fixed = fixed.withColumn("url", X.default_url("url", "id", base_url))
    defaults = {"id": "", "name": "", "clone_count": 0}
    dtype = df.schema["backtest"].dataType
    parts = []
    for f in dtype.fields:
        value = F.col(f"backtest.{f.name}")
        parts.append((F.coalesce(value, F.lit(defaults[f.name])).cast(f.dataType) if f.name in defaults else value).alias(f.name))
    fixed = fixed.withColumn("backtest", F.struct(*parts))
    if "tags" in have:
        fixed = fixed.withColumn("tags", F.coalesce("tags", F.array().cast(df.schema["tags"].dataType)))
    if {"content", "detail_fetched_at"} <= have:
        fixed = fixed.withColumn(
            "detail_fetched_at", F.when(~X.is_blank("content"), F.coalesce("detail_fetched_at", F.lit("")))
            .otherwise(F.col("detail_fetched_at"))
        )
    return fixed


def pick_stats(df: DataFrame, column: str = "stats", fields: list[str] = X.STAT_FIELDS) -> DataFrame:
    """Keep only the whitelisted entries of a statistics map."""
    return df.withColumn(column, F.map_filter(column, lambda k, _: k.isin(*fields)))


def _or(first: Column, second: Column) -> Column:
    """The first number unless it is missing or zero, then the second, whatever it is."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)


def normalize_archive_post(
    df: DataFrame, candidates: DataFrame, refreshed_at: str | Column, base_url: str = X.DEFAULT_POST_URL
) -> DataFrame:
    """Archive rows (``conform``-ed) to typed serving rows; rows without an id are dropped.

    An annual return of zero falls through to the alternative field, and is NULL without it."""
    have = set(df.columns)
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    opt = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    stats = F.col("backtest.stats")
    # Typed columns are only converted; text columns of older archives go through the lenient parsers.
    number = lambda col, kind: (
        col if isinstance(kind, T.DoubleType) else col.cast("double") if isinstance(kind, T.NumericType) else X.float_or_null(col)
    )
    whole = lambda col, kind: (
        col if isinstance(kind, T.LongType) else col.try_cast("bigint") if isinstance(kind, T.NumericType) else X.int_trunc(col)
    )
    stat_types = {f.name: f.dataType for f in df.schema["backtest"].dataType["stats"].dataType.fields}
    stat = lambda name: number(stats[name], stat_types[name])
    days = whole(stats["trading_days"], stat_types["trading_days"])
    other_annual = stat("annual_return") if "annual_return" in stat_types else F.lit(None).cast("double")
    stamp = F.lit(refreshed_at) if isinstance(refreshed_at, str) else refreshed_at
    rows = df.withColumn("id", F.coalesce(X.nonblank("id"), opt("post_id"), F.lit(""))).where(F.col("id") != "")
    typed = rows.select(
        F.col("id"),
        text("title").alias("title"),
        X.default_url("url", "id", base_url).alias("url"),
        text("published_at").alias("published_at"),
        F.coalesce(X.nonblank("updated_at"), opt("detail_fetched_at"), F.lit("")).alias("updated_at"),
        F.coalesce(X.nonblank(F.col("author.name")), opt("author_name"), F.lit("")).alias("author_name"),
        text("content").alias("content"),
        X.preview("content_preview", "content").alias("content_preview"),
        *[whole(F.col(c), df.schema[c].dataType).alias(c) for c in ("view_count", "like_count", "reply_count")],
        F.coalesce(F.col("backtest.id"), F.lit("")).alias("backtest_id"),
        F.coalesce(F.col("backtest.name"), F.lit("")).alias("backtest_name"),
        days.alias("trading_days"),
        X.period_years(days).alias("period_years"),
        _or(stat("annual_algo_return"), other_annual).alias("annual_return"),
        stat("sharpe").alias("sharpe"),
        stat("max_drawdown").alias("max_drawdown"),
        whole(F.col("backtest.clone_count"), df.schema["backtest"].dataType["clone_count"].dataType).alias("clone_count"),
        F.lit("archive").alias("source"),
        F.lit("").alias("raw_json"),
        stamp.alias("created_at"),
        stamp.alias("refreshed_at"),
    )
    from postmart.operators.joins import flag_candidates

    return flag_candidates(typed, candidates).select(*POST_COLUMNS)


def build_post_index(posts: DataFrame, labels_text: str | None = None) -> DataFrame:
    """The serving projection: no content, plus logical key, label text and cleared duplicate flags.
    Without a computed label text only the candidate label is written."""
    key = X.logical_key("author_name", "title", "published_at", "content_preview")
    candidate = F.when(F.col("is_original_candidate").cast("int") == 1, f"|{CANDIDATE_LABEL}|").otherwise("")
    return posts.select(
        *INDEX_COLUMNS,
        (F.col(labels_text) if labels_text else candidate).alias("labels_text"),
        F.lit(0).alias("is_hidden_duplicate"),
        F.lit(None).cast("string").alias("duplicate_of"),
        key.alias("logical_key"),
    )


def flatten_reply_tree(df: DataFrame, reply: str = "reply", keys: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """Nested replies (variant column) to flat rows, parents before children by ``path``.

    One explode per nesting level until a level is empty; every level is stored, so deep threads
    do not build a deep plan."""
    from postmart.session import cut_lineage

    def fields(v: Column) -> list[Column]:
        return [
            _text(v, "replyId").alias("reply_id"),
            _text(v, "content").alias("content"),
            F.coalesce(X.vget(v, "user.userId"), X.vget(v, "userId"), F.lit("")).alias("author_id"),
            _text(v, "user.alias").alias("author_name"),
            _text(v, "addTime").alias("published_at"),
            _text(v, "modTime").alias("updated_at"),
            _text(v, "ipAddress").alias("ip_address"),
            _flag(v, "isBest").alias("is_best"),
            _flag(v, "isRich").alias("is_rich"),
            X.truthy_json(v, "isOwner").alias("is_owner"),
            X.truthy_json(v, "isPostUser").alias("is_post_user"),
            _text(v, "backtestId").alias("backtest_id"),
            _text(v, "backtestName").alias("backtest_name"),
            X.float_or_null(X.vget(v, "overallReturn")).alias("overall_return"),
            _text(v, "pReplyId").alias("stated_parent_id"),
            _text(v, "oReplyId").alias("original_reply_id"),
            X.int_json(v, "subReply.leaveCount", 0).alias("remaining_count"),
        ]

    def children(v: Column) -> Column:
        """Sub-replies come as {list, leaveCount} or as a bare list; entries that are not objects drop out."""
        bare = X.vget(v, "subReply", "array<variant>")
        listed = X.vget(v, "subReply.list", "array<variant>")
        found = F.coalesce(bare, listed, F.array().cast("array<variant>"))
        return F.filter(found, lambda c: F.schema_of_variant(c).startswith("OBJECT"))

    keep = list(keys)
    level = df.where(X.vkind(reply) == "OBJECT").select(
        *keep, F.lit("").alias("parent_reply_id"), F.lit(0).alias("depth"),
        (F.col("pos") if "pos" in df.columns else F.lit(0)).cast("bigint").alias("__pos"), F.col(reply).alias("__v"),
    ).withColumn("path", F.array("__pos"))
    out = None
    while True:
        level = cut_lineage(level)
        if out is not None and level.isEmpty():
            return out
        rows = level.select(*keep, "depth", "path", "parent_reply_id", *fields(F.col("__v")))
        out = rows if out is None else out.unionByName(rows)
        level = level.select(
            *keep, (F.col("depth") + 1).alias("depth"), F.col("path").alias("__path"),
            _text(F.col("__v"), "replyId").alias("parent_reply_id"), F.posexplode(children(F.col("__v"))).alias("__pos", "__v"),
        ).select(*keep, "parent_reply_id", "depth", "__v",
                 F.concat("__path", F.array(F.col("__pos").cast("bigint"))).alias("path"))


def normalize_backtest_rows(rows: DataFrame, cells: str = "cells", attrs: str = "attrs") -> DataFrame:
    """Listing rows (cells array, attribute map with lower-case names) to runs.  A first cell made of
    digits is the leading number column; otherwise one more column (a check box) comes before it."""
    first = F.when(F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit("")).rlike(r"^\d+$"), 0).otherwise(1)

    def cell(i: int) -> Column:
        return F.coalesce(F.try_element_at(F.col(cells), first + F.lit(i + 1)), F.lit(""))

    attr = lambda name: F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))
    period = X.split_date_range(cell(3))
    return rows.select(
        *[c for c in rows.columns if c not in (cells, attrs, "source_id")],
        F.coalesce(X.nonblank(attr("_backtestid2")), attr("_backtestid")).alias("id"),
        attr("_backtestid").alias("list_id"),
        F.coalesce(F.col("source_id"), F.lit("")).alias("source_id") if "source_id" in rows.columns else F.lit("").alias("source_id"),
        cell(1).alias("name"),
        X.map_run_status(attr("_status"), F.array_join(cells, " ")).alias("status"),
        period["start"].alias("start_date"),
        period["end"].alias("end_date"),
        X.float_or_null(X.nonblank(cell(4))).alias("capital"),
        cell(6).alias("frequency"),
        cell(7).alias("algorithm_return"),
        cell(8).alias("benchmark_return"),
        cell(9).alias("max_drawdown"),
        cell(2).alias("submitted_at"),
    )


def _first_link_param(links: str, name: str) -> Column:
    return F.try_element_at(F.array_compact(F.transform(links, lambda u: X.url_param(u, name))), F.lit(1))


def split_strategy_rows(rows: DataFrame, id_param: str = "algorithmId", folder_param: str = "fId") -> DataFrame:
    """Add ``strategy_id`` and ``folder_id`` from the row's links (folder also from its attributes)."""
    attr = lambda name: X.nonblank(F.try_element_at("attrs", F.lit(name)))
    return rows.withColumn("strategy_id", _first_link_param("links", id_param)).withColumn(
        "folder_id", F.coalesce(attr("_fid"), _first_link_param("links", folder_param))
    )


def normalize_strategy_rows(rows: DataFrame, id_param: str = "algorithmId", folder_param: str = "fId") -> DataFrame:
    """Strategy listing rows: those whose links carry a strategy id."""
    cell = lambda i: F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))
    split = split_strategy_rows(rows, id_param, folder_param).where(F.col("strategy_id").isNotNull())
    return split.select(
        *[c for c in rows.columns if c not in ("cells", "attrs", "links")],
        F.col("strategy_id").alias("id"),
        F.try_element_at("attrs", F.lit("_algorithmid")).alias("internal_id"),
        cell(1).alias("name"),
        cell(2).alias("type"),
        cell(3).alias("updated_at"),
        X.int_strict(cell(4)).alias("run_count"),
        X.int_strict(cell(5)).alias("backtest_count"),
    )


def folder_rows(rows: DataFrame, id_param: str = "algorithmId", folder_param: str = "fId") -> DataFrame:
    """Folder entries of a strategy listing: no strategy id, but a folder id."""
    split = split_strategy_rows(rows, id_param, folder_param)
    picked = split.where(F.col("strategy_id").isNull() & F.col("folder_id").isNotNull())
    return picked.select(
        *[c for c in rows.columns if c not in ("cells", "attrs", "links")],
        F.col("folder_id").alias("id"),
        F.coalesce(F.try_element_at("cells", F.lit(2)), F.lit("")).alias("name"),
    )


def series_to_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel arrays of a curve page to one row per point.  Lengths are checked by the scan; a missing
    benchmark or strategy array is not padded silently."""
    arrays = ["time", "value", "benchmark_time", "benchmark_value"]
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == F.size("time"))
    problem = F.lit("series arrays differ in length")
    zipped = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(problem).cast(
        "array<struct<time:bigint,value:double,benchmark_time:bigint,benchmark_value:double>>"))
    return df.select(*keys, F.posexplode(zipped).alias("i", "p")).select(*keys, "i", "p.*")


def refresh_marker_block(df: DataFrame, column: str, begin: str, end: str, block: str) -> DataFrame:
    """Replace the marked block of a text: every line range from a ``begin`` line to an ``end`` line is
    removed (an open range runs to the end of the text), trailing space is trimmed, ``block`` appended.
    Running it again changes nothing.

    The text is cut at its ``begin`` lines; every piece but the first keeps only what follows its first
    ``end`` line.  That is linear in the text, where folding over an array of lines is not.  Texts without
    a marker, the usual case, meet no pattern at all."""
    # Most texts have plain line feeds only; looking is much cheaper than rewriting.
    plain = F.translate(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), LINE_BREAKS, "\n" * len(LINE_BREAKS))
    unix = F.when(F.col(column).rlike(f"[{LINE_BREAKS}]"), plain).otherwise(F.col(column))
    begin_line, end_line = rf"\n[^\n]*{re.escape(begin)}[^\n]*", rf"\n[^\n]*{re.escape(end)}[^\n]*"
    after_end = rf"(?s){end_line}(.*)\z"

    def cut(text: Column) -> Column:
        pieces = F.split(F.concat(F.lit("\n"), text), begin_line)
        kept = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(F.regexp_extract(piece, after_end, 1)))
        return F.substring(F.regexp_replace(F.array_join(kept, ""), end_line, ""), 2, 2**31 - 1)

    def rewrite(text: Column) -> Column:
        body = X.rstrip_ws(F.when(text.contains(begin) | text.contains(end), cut(text)).otherwise(text))
        return _once(body, lambda b: F.concat(b, F.when(b == "", "").otherwise("\n\n"), F.lit(block + "\n")))

    return df.withColumn(column, _once(unix, rewrite))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decode_payload(df: DataFrame, content: str = "content", kind: str = "format") -> DataFrame:
    """Add ``bytes`` and ``problem``: text and JSON are encoded as UTF-8, base64 is decoded."""
    text = F.col(content)
    valid64 = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    decoded = F.when(valid64, F.unbase64(text))
    good_json = F.try_parse_json(text).isNotNull()
    value = (
        F.when(F.col(kind) == "base64", decoded)
        .when((F.col(kind) == "json") & good_json, text.cast("binary"))
        .when(F.col(kind) == "text", text.cast("binary"))
    )
    problem = (
        F.when(text.isNull(), "no content")
        .when((F.col(kind) == "base64") & ~valid64, "invalid base64")
        .when((F.col(kind) == "json") & ~good_json, "invalid JSON")
        .when(~F.coalesce(F.col(kind), F.lit("")).isin("base64", "json", "text"), "unknown format")
    )
    return df.withColumn("bytes", value).withColumn("problem", problem)


def encode_payload(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``encoded``: the base64 of the UTF-8 text on one line."""
    return df.withColumn("encoded", F.regexp_replace(F.base64(F.col(content).cast("binary")), r"\s", ""))
