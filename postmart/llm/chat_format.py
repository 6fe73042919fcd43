"""Chat formatting with Spark expressions only: turns sorted, same-role neighbours merged, text concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template.  A text holds none of these strings once it is escaped.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Turn numbers that are merged in one group before the groups of a conversation meet.
SEGMENT = 256
#: Parts of a conversation whose places are found together.
PARTS = 128


def escape(text: Column) -> Column:
    """One more backslash between '<' and '|', so that no '<|' is left.  ``unescape`` takes it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merge(turns: Column) -> Column:
    """Array of (role, texts) with neighbours of one role as one entry, in time proportional to the turns."""

    def runs(t: Column) -> Column:
        role = lambda i: F.get(t, i)["role"]
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0)))))

        def entry(s: Column):
            texts = lambda b, k: F.slice(t, b + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - b)["text"]
            return F.transform(s, lambda b, k: F.struct(role(b).alias("role"), texts(b, k).alias("texts")))

        return _bound(begins, entry)

    return _bound(turns, runs)


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_from: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_runs``.

    ``formatted`` is a ``<|turn|>role<|text|>text<|end|>`` line for each run of neighbours with one role; further
    texts of the run follow after ``<|next|>``, so that every turn can be read back.  ``loss_runs`` are the
    lengths in code points of consecutive parts of ``formatted``, with ``loss`` true for each text of
    ``learn_from``.  Control strings inside texts and roles are escaped reversibly.

    Turns are sorted by (turn, role, text), NULL first; NULL texts and roles are empty; repeated rows are
    repeated turns; rows without a conversation id form one conversation; an empty table gives no rows;
    further columns are ignored.

    A conversation ends as one string in one row, at most 2 GB.  It is put together from segments of
    ``SEGMENT`` turn numbers that are sorted, escaped and merged in their own groups; the last step only joins
    them in order, in time proportional to their length."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    segments = (
        rows.groupBy("conv", F.floor(F.col("turn") / SEGMENT).alias("segment"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv", "segment", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
        .select("conv", "segment", _merge(F.col("turns")).alias("runs"))
    )
    whole = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", "runs"))).alias("parts"))
    whole = whole.select("conv", F.flatten(F.col("parts.runs")).alias("runs"))
    role_at = lambda i: F.try_element_at(F.col("runs.role"), i)

    def line(run: Column, i: Column) -> Column:
        # i counts from 0 and element_at from 1; position 0 is no element.
        opens = F.when((i > 0) & (role_at(F.greatest(i, F.lit(1))) == run["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), run["role"], F.lit(TEXT)))
        closes = F.when(role_at(i + 2) == run["role"], F.lit("")).otherwise(F.lit(END + "\n"))
        return F.struct(opens.alias("opens"), run["texts"].alias("texts"), closes.alias("closes"), (run["role"] == learn_from).alias("learn"))

    lined = whole.select("conv", F.transform("runs", line).alias("lines"))
    part = lambda chars, loss: F.struct(chars.alias("chars"), loss.alias("loss"))
    no = F.lit(False)

    def parts(x: Column) -> Column:
        inside = F.flatten(F.transform(x["texts"], lambda t, i: F.array(part(F.when(i > 0, len(NEXT)).otherwise(0), no), part(F.length(t), x["learn"]))))
        return F.concat(F.array(part(F.length(x["opens"]), no)), inside, F.array(part(F.length(x["closes"]), no)))

    text = F.array_join(F.transform("lines", lambda x: F.concat(x["opens"], F.array_join(x["texts"], NEXT), x["closes"])), "")
    return lined.select(
        F.col("conv").alias(conv_col),
        text.alias("formatted"),
        F.filter(F.flatten(F.transform("lines", parts)), lambda p: p["chars"] > 0).alias("loss_runs"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text), one for each turn, from a formatted conversation."""
    quoted = {m: m.replace("|", r"\|") for m in (TURN, TEXT, NEXT, END)}
    blocks = F.filter(F.split(formatted, quoted[TURN]), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        halves = F.split(block, quoted[TEXT])
        role, body = unescape(halves[0]), F.split(halves[1], quoted[END])[0]
        return F.transform(F.split(body, quoted[NEXT]), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_texts(formatted: Column, loss_runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order: cut from ``formatted`` where the running sum of the parts'
    lengths says.  Parts are taken ``PARTS`` at a time, so that finding a place never means to walk through a whole
    long conversation."""
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["chars"])
    number = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(loss_runs) / PARTS).cast("int") - 1, F.lit(0)))
    part = lambda b: F.slice(loss_runs, b * PARTS + 1, F.lit(PARTS))

    def blocks(sizes: Column) -> Column:
        begin = lambda b: F.aggregate(F.slice(sizes, F.lit(1), b), F.lit(0).cast("bigint"), lambda a, n: a + n)
        text = lambda b: F.substr(formatted, (begin(b) + 1).cast("int"), F.get(sizes, b).cast("int"))
        return F.transform(number, lambda b: F.struct(text(b).alias("text"), part(b).alias("runs")))

    def cut(block: Column) -> Column:
        at = lambda i: (total(F.slice(block["runs"], F.lit(1), i)) + 1).cast("int")
        texts = F.transform(block["runs"], lambda r, i: F.when(r["loss"], unescape(F.substr(block["text"], at(i), r["chars"].cast("int")))))
        return F.array_compact(texts)

    return F.flatten(F.transform(_bound(F.transform(number, lambda b: total(part(b))), blocks), cut))


def digest(chats: DataFrame) -> DataFrame:
    """What a reader gets from formatted conversations: turns, and text under the loss mask, as lengths and hashes."""
    turns = chats.select("*", read_back(F.col("formatted")).alias("turns"))
    loss = turns.select("*", F.array_join(learnt_texts(F.col("formatted"), F.col("loss_runs")), "").alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return loss.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The conversation that the registered query adds: texts that look like other templates' control strings.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"

SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, 'assistant', '{PROBE}')
),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS role_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + 8 + CASE WHEN opens THEN 16 + role_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
