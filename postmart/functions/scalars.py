"""Column expressions.  Everything here stays inside whole-stage codegen; there is no UDF."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F, types as T

__all__ = [
    "DEFAULT_POST_URL", "RUN_STATE_CODES", "RUN_STATUS_WORDS", "STAT_FIELDS", "TRADING_DAYS_PER_YEAR",
    "business_today", "content_hash", "curve_time", "day_spine", "default_url", "epoch_ms", "flag01", "flag_json", "float_or_null", "int_json",
    "int_strict", "int_trunc", "truthy_json", "is_blank", "keyword_hits", "logical_key", "map_run_status", "nonblank",
    "normalize_tags", "parse_time", "period_years", "preview", "redact", "rstrip_ws", "split_date_range", "squash_ws",
    "strip_controls", "strip_ws", "to_ratio", "truncation_flag", "url_param", "vget", "vkind", "vlist",
]

# ---- fixed values -----------------------------------------------------------------------------
# The statistics an archive row keeps, in their archive order.
STAT_FIELDS = [
    "trading_days",
    "algorithm_return",
    "benchmark_return",
    "annual_algo_return",
    "annual_bm_return",
    "max_drawdown",
    "max_drawdown_period",
    "sharpe",
    "sortino",
    "information",
    "alpha",
    "beta",
    "algorithm_volatility",
    "benchmark_volatility",
    "win_ratio",
    "profit_loss_ratio",
    "turnover_rate",
]
# Numeric run states of listings and result payloads.
RUN_STATE_CODES = {"0": "running", "1": "failed", "2": "done", "3": "cancelled"}
# Words that name a run status in listing text, tested in this order.
RUN_STATUS_WORDS = [
    ("done", ["完成"]),
    ("failed", ["失败"]),
    ("cancelled", ["取消"]),
    ("running", ["运行", "回测中", "进行中"]),
]
# A log line that names one of these is hidden.
SECRET_WORDS = ["authorization", "cookie", "token", "password"]
REDACTED = "<redacted>"
TRADING_DAYS_PER_YEAR = 250
PREVIEW_CHARS = 500
KEY_SEPARATOR = "\x1f"
# ---- end of fixed values ----------------------------------------------------------------------

# Post pages live under this address plus the post id; callers pass their own site.
DEFAULT_POST_URL = "https://example.com/view/community/detail/"

# Unicode white space as text tools split on it; Java's plain \s is ASCII only.
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same characters spelled out, for trimming without a pattern.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- dynamic JSON (variant) access ------------------------------------------------------------

def vget(v: Column | str, path: str, kind: str = "string") -> Column:
    """Value at ``$.path`` as ``kind``; NULL when missing, JSON null, or of another shape."""
    return F.try_variant_get(_c(v), f"$.{path}" if path else "$", kind)


def vkind(v: Column | str) -> Column:
    """'OBJECT', 'ARRAY', 'STRING', … of a variant; 'VOID' for JSON null, NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(_c(v)), r"^[A-Z]+", 0)


def vrecord(v: Column | str, fields: dict[str, str], path: str = "") -> Column:
    """The named fields of the object at ``path`` as a struct, read in one pass; each is what ``vget`` gives.  NULL
    when there is no object."""
    return vget(v, path, f"struct<{', '.join(f'`{name}`: {kind}' for name, kind in fields.items())}>")


def is_object(v: Column | str) -> Column:
    """Whether a variant is a JSON object.  Unlike ``vkind`` this does not look into its values."""
    return vrecord(v, {"_": "variant"}).isNotNull()


def vlist(v: Column | str, path: str) -> Column:
    """Array of variants at ``path``, empty when the value is missing or not a list."""
    return F.coalesce(vget(v, path, "array<variant>"), F.array().cast("array<variant>"))


# ---- numbers, flags, times --------------------------------------------------------------------

def int_strict(c: Column | str, default: int | None = None) -> Column:
    """Whole-number text to bigint; anything else ('3.5', '', words) gives ``default``."""
    text = _c(c).cast("string")
    # The pattern first: a cast that fails builds an exception per row, which is slow on dirty columns.
    value = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def float_or_null(c: Column | str) -> Column:
    """Decimal text to double.  The pattern keeps out Java-only spellings such as ``1d``."""
    text = _c(c).cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def int_trunc(c: Column | str) -> Column:
    """Decimal text to bigint, dropping the fraction; NaN and infinities give NULL."""
    return float_or_null(c).try_cast("bigint")


def flag01(c: Column | str) -> Column:
    """True for the text of a non-zero whole number, false for everything else."""
    return F.coalesce(int_strict(c) != 0, F.lit(False))


def int_json(v: Column | str, path: str, default: int | None = None, text: Column | None = None) -> Column:
    """Whole number of a JSON value: numbers lose their fraction, ``true`` is 1 and ``false`` 0, text must be a whole
    number; anything else gives ``default``.  The kind is looked at only where the text is not a whole number.
    ``text`` is the value as ``vget`` gives it, where that is known already."""
    text = vget(v, path) if text is None else text
    kind = vkind(vget(v, path, "variant"))
    other = (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("bigint"))
        .when(kind.isin("DOUBLE", "FLOAT", "DECIMAL"), text.try_cast("decimal(38,10)").try_cast("bigint"))
    )
    value = F.coalesce(int_strict(text), F.when(text.isNotNull(), other))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def flag_json(v: Column | str, path: str, text: Column | None = None) -> Column:
    """Whether a JSON value is a whole number other than 0 in the sense of ``int_json``."""
    return F.coalesce(int_json(v, path, text=text) != 0, F.lit(False))


def truthy_json(v: Column | str, path: str) -> Column:
    """Loose truth of a JSON value: missing, null, false, 0, empty text, an empty list and an empty object are false."""
    text, kind = vget(v, path), vkind(vget(v, path, "variant"))
    whole = F.to_json(vget(v, path, "variant"))
    return F.coalesce(
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true")
        .when(kind.isin("OBJECT", "ARRAY"), ~whole.isin("{}", "[]")).when(kind != "VOID", text.try_cast("double") != 0),
        F.lit(False),
    )


def truncation_flag(c: Column | str) -> Column:
    """true / false / 0 / 1 in any case to boolean; any other value, or none, is an error."""
    text = F.lower(_c(c).cast("string"))
    problem = F.concat(F.lit("invalid truncation flag: "), F.coalesce(text, F.lit("missing")))
    return (
        F.when(text.isin("true", "1"), F.lit(True))
        .when(text.isin("false", "0"), F.lit(False))
        .otherwise(F.raise_error(problem).cast("boolean"))
    )


def parse_time(c: Column | str, strip: bool = False) -> Column:
    """'yyyy-MM-dd HH:mm:ss' or 'yyyy-MM-dd' to a zone-free timestamp, else NULL."""
    text = strip_ws(c) if strip else _c(c)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}:\d{1,2})?$"
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def business_today(ts: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """Calendar date in the exchange's zone of a UTC wall-clock timestamp."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts).cast("timestamp_ntz")))


def epoch_ms(c: Column | str) -> Column:
    """Unix milliseconds to a timestamp."""
    return F.timestamp_millis(_c(c).cast("bigint"))


def curve_time(c: Column | str) -> Column:
    """Unix milliseconds as wall-clock time of the exchange (UTC+8), zone-free."""
    seconds = (_c(c).cast("decimal(18,0)") / 1000).cast("decimal(18,6)")
    return F.lit("1970-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def to_ratio(c: Column | str, unit: Column | str) -> Column:
    """Curves come in percent and statistics as ratios; bring both to ratios."""
    return F.when(_c(unit) == "percent", _c(c) / 100.0).otherwise(_c(c))


def period_years(days: Column | str) -> Column:
    return F.round(_c(days) / F.lit(float(TRADING_DAYS_PER_YEAR)), 2)


def day_spine(start: Column | str, end: Column | str) -> Column:
    """Array of every calendar day from start to end inclusive; start after end is an error."""
    first, last = _c(start).cast("date"), _c(end).cast("date")
    problem = F.concat(F.lit("start after end: "), first.cast("string"), F.lit(" > "), last.cast("string"))
    days = F.sequence(first, last)
    return F.when(first <= last, days).when(first > last, F.raise_error(problem).cast("array<date>"))


# ---- text -------------------------------------------------------------------------------------

def squash_ws(c: Column | str) -> Column:
    """Runs of (Unicode) white space become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), _WS + "+", " "))


def strip_ws(c: Column | str) -> Column:
    """Trim Unicode white space at both ends; looks at the ends only, however long the text is."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def rstrip_ws(c: Column | str) -> Column:
    return F.rtrim(_c(c), F.lit(WS_CHARS))


def strip_controls(c: Column | str) -> Column:
    """Drop control characters except tab, line feed and carriage return."""
    return F.regexp_replace(_c(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")


def preview(c: Column | str, content: Column | str | None = None) -> Column:
    """The preview, or else the content, cut to its first 500 code points."""
    text = _c(c) if content is None else F.coalesce(nonblank(c), _c(content))
    return F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW_CHARS)


def nonblank(c: Column | str) -> Column:
    """NULL for an empty string, the string otherwise."""
    return F.nullif(_c(c), F.lit(""))


def is_blank(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """NULL, '' or an empty collection.  Zero and false are values, not blanks."""
    col = _c(c)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return col.isNull() | (F.size(col) == 0)
    if dtype is None or isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return col.isNull() | (col == "")
    return col.isNull()


def content_hash(c: Column | str) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def redact(c: Column | str) -> Column:
    pattern = "|".join(SECRET_WORDS)
    return F.when(F.lower(_c(c)).rlike(pattern), F.lit(REDACTED)).otherwise(_c(c))


def keyword_hits(c: Column | str, terms: list[str]) -> Column:
    """How many distinct terms occur in the text."""
    hits = [_c(c).contains(term).cast("int") for term in dict.fromkeys(terms)]
    return F.coalesce(reduce(add, hits, F.lit(0)), F.lit(0))


def logical_key(author: Column | str, title: Column | str, published_at: Column | str, text: Column | str) -> Column:
    """Near-identity key of a post: squashed author, title and time plus the SHA-1 of the stripped preview."""
    body = strip_ws(F.coalesce(_c(text), F.lit("")))
    digest = F.when(body == "", F.lit("")).otherwise(F.sha1(body.cast("binary")))
    head = [squash_ws(F.coalesce(_c(part).cast("string"), F.lit(""))) for part in (author, title, published_at)]
    return F.concat_ws(KEY_SEPARATOR, *head, digest)


# ---- addresses, statuses, ranges, tags --------------------------------------------------------

def url_param(url: Column | str, name: str) -> Column:
    """First non-blank value of a query parameter, percent-decoded; NULL when there is none."""
    query = F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)
    raw = nonblank(F.regexp_extract(query, f"(?:^|&){re.escape(name)}=([^&]+)", 1))
    return F.coalesce(F.try_url_decode(raw), raw)


def default_url(url: Column | str, post_id: Column | str, base: str = DEFAULT_POST_URL) -> Column:
    """Build the post address from the id when the stored one is blank (and the id is not)."""
    built = F.concat(F.lit(base), nonblank(_c(post_id).cast("string")))
    return F.coalesce(nonblank(url), built, _c(url))


def map_run_status(code: Column | str, text: Column | str, words=None) -> Column:
    """Status words in the row text win over the numeric code; unknown codes pass through."""
    result = None
    for status, spellings in words or RUN_STATUS_WORDS:
        hit = reduce(lambda a, b: a | b, [F.coalesce(_c(text), F.lit("")).contains(w) for w in spellings])
        result = F.when(hit, F.lit(status)) if result is None else result.when(hit, F.lit(status))
    raw = F.coalesce(_c(code).cast("string"), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in RUN_STATE_CODES.items() for x in pair])
    return result.otherwise(F.coalesce(F.try_element_at(known, raw), raw))


def split_date_range(c: Column | str) -> Column:
    """struct(start, end): the first two ISO dates; one date has an open end; else split on ' - '."""
    text = F.coalesce(_c(c), F.lit(""))
    dates = F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)
    parts = F.split(text, " - ")
    start = (
        F.when(F.size(dates) >= 1, F.try_element_at(dates, F.lit(1)))
        .when(F.size(parts) >= 2, strip_ws(F.try_element_at(parts, F.lit(1))))
        .otherwise(text)
    )
    end = (
        F.when(F.size(dates) >= 2, F.try_element_at(dates, F.lit(2)))
        .when(F.size(dates) == 1, F.lit(""))
        .when(F.size(parts) >= 2, strip_ws(F.try_element_at(parts, F.lit(-1))))
        .otherwise(F.lit(""))
    )
    return F.struct(start.alias("start"), end.alias("end"))


def normalize_tags(tags: Column | str) -> Column:
    """Array of variant tags to array<struct<id,name>>; entries that are not objects are dropped."""
    read = F.transform(_c(tags), lambda t: vrecord(t, {"tagKey": "string", "tagId": "string", "name": "string"}))
    return F.transform(
        F.array_compact(read),
        lambda t: F.struct(
            F.coalesce(t["tagKey"], t["tagId"], F.lit("")).alias("id"),
            F.coalesce(t["name"], F.lit("")).alias("name"),
        ),
    )
