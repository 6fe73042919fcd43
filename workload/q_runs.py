"""Runs: statistics, identities, status reconciliation, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.operators import filters, joins as J, windows as W
from postmart.plans.runs import reconcile_status
from postmart.sources import payloads as S
from workload.registry import query


def stats_payloads(v):
    """Statistics payload per order: usable, empty list, metrics at top level, or partial."""
    i = F.col("o_orderkey")
    full = F.struct(F.col("o_totalprice").alias("annual_algo_return"), (i % 7).alias("sharpe"), i.alias("trading_days"))
    partial = F.struct(F.col("o_totalprice").alias("max_drawdown"))
    text = (
        F.when(i % 4 == 0, F.to_json(F.struct(full.alias("data")))).when(i % 4 == 1, F.lit('{"data":[]}'))
        .when(i % 4 == 2, F.to_json(full)).otherwise(F.to_json(F.struct(partial.alias("data"))))
    )
    return v.table("orders").select(i.cast("string").alias("backtest_id"), text.alias("payload"))


@query("scan_stats_payloads", """
WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_totalprice END AS annual, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey % 7 END AS sharpe,
 CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderkey END AS days, CASE WHEN o_orderkey % 4 = 3 THEN o_totalprice END AS dd,
 CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END END AS inner_k FROM orders)
SELECT CAST(m.k AS VARCHAR) AS backtest_id, CAST(CASE WHEN n.annual IS NOT NULL THEN n.k ELSE m.k END AS VARCHAR) AS resolved_id,
 CASE WHEN n.annual IS NOT NULL THEN n.annual ELSE m.annual END AS annual_algo_return, CASE WHEN n.annual IS NOT NULL THEN n.sharpe ELSE m.sharpe END AS sharpe,
 CASE WHEN n.annual IS NOT NULL THEN n.days ELSE m.days END AS trading_days, m.dd AS max_drawdown, CAST(NULL AS DOUBLE) AS algorithm_return
FROM m LEFT JOIN m n ON n.k = m.inner_k""")
def _(v):
    """Empty payloads retry under the inner id: the next order (usable) or the one after (partial only)."""
    i = F.col("o_orderkey")
    inner = v.table("orders").select(i.cast("string").alias("backtest_id"), (i + F.when(i % 3 == 0, 2).otherwise(1)).cast("string").alias("inner_id"))
    return S.scan_stats_payloads(stats_payloads(v), inner)


@query("metrics_core", "SELECT CAST(o_orderkey AS VARCHAR) AS backtest_id FROM orders WHERE o_orderkey % 4 IN (0, 2)")
def _(v):
    return filters.metrics_core(S.stats_metrics(stats_payloads(v), "payload")).select("backtest_id")


@query("metrics_any", "SELECT CAST(o_orderkey AS VARCHAR) AS backtest_id FROM orders WHERE o_orderkey % 4 <> 1")
def _(v):
    return filters.metrics_any(S.stats_metrics(stats_payloads(v), "payload")).select("backtest_id")


@query("resolve_run", """
WITH r AS (SELECT event_id AS pos, 'r' || user_id AS id, CAST(event_id AS VARCHAR) AS list_id, CASE WHEN event_id % 2 = 0 THEN 's' || (user_id % 10) ELSE '' END AS source_id, event_type AS status FROM events),
w AS (SELECT 'r' || c_custkey AS wanted FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
k AS (SELECT id AS wanted, pos FROM r UNION ALL SELECT list_id, pos FROM r UNION ALL SELECT source_id, pos FROM r),
f AS (SELECT wanted, min(pos) AS pos FROM k GROUP BY wanted)
SELECT w.wanted, r.pos, r.id, r.status FROM w LEFT JOIN f ON f.wanted = w.wanted LEFT JOIN r ON r.pos = f.pos""")
def _(v):
    c, s = v.table("customer"), v.table("supplier")
    listing = v.table("events").select(
        F.col("event_id").alias("pos"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_id").cast("string").alias("list_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string"))).otherwise("").alias("source_id"),
        F.col("event_type").alias("status"),
    )
    key = F.col("c_custkey").cast("string")
    wanted = c.select(F.concat(F.lit("r"), key).alias("wanted")).unionByName(c.select(key.alias("wanted"))).unionByName(
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("wanted")))
    return J.resolve_run(wanted, listing).select("wanted", "pos", "id", "status")


@query("resolve_internal_id", """
WITH items AS (SELECT p_partkey AS pos, 'p' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'i' || p_partkey END AS internal_id, p_name AS name FROM part),
byname AS (SELECT name, coalesce(nullif(internal_id, ''), id) AS internal FROM items WHERE pos IN (SELECT min(pos) FROM items GROUP BY name)),
asked AS (SELECT 'p' || (l_partkey * 2) AS wanted, CASE WHEN l_linenumber % 2 = 0 THEN 'small ring' WHEN l_linenumber = 1 THEN 'no such name' END AS name FROM lineitem
 UNION ALL SELECT 'i' || l_partkey, NULL FROM lineitem WHERE l_linenumber = 3)
SELECT a.wanted, coalesce(nullif(coalesce(x.internal_id, y.internal_id), ''), x.id, y.id, n.internal, a.wanted) AS internal_id
FROM asked a LEFT JOIN items x ON x.id = a.wanted LEFT JOIN items y ON y.internal_id = a.wanted LEFT JOIN byname n ON n.name = a.name""")
def _(v):
    key = F.col("p_partkey").cast("string")
    items = v.table("part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), key).alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("i"), key)).alias("internal_id"), F.col("p_name").alias("name"))
    li = v.table("lineitem")
    number = F.col("l_linenumber")
    asked = li.select(
        F.concat(F.lit("p"), (F.col("l_partkey") * 2).cast("string")).alias("wanted"),
        F.when(number % 2 == 0, "small ring").when(number == 1, "no such name").alias("name"),
    ).unionByName(li.where(number == 3).select(F.concat(F.lit("i"), F.col("l_partkey").cast("string")).alias("wanted"), F.lit(None).cast("string").alias("name")))
    return J.resolve_internal_id(asked, items)


@query("find_new_item", """
WITH top AS (SELECT o_orderkey AS id, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)
SELECT CAST(top.id AS VARCHAR) AS id FROM top ORDER BY CASE WHEN top.id % 4 = 1 THEN 0 ELSE 1 END, o_orderdate DESC, top.id LIMIT 1""")
def _(v):
    after = v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("string").alias("updated_at"), F.col("o_orderkey").alias("pos"))
    before = after.where(F.col("pos") % 4 != 1)
    return J.find_new_item(before, after).select("id")


@query("first_wins", "SELECT p_name AS name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def _(v):
    items = v.table("part").select(F.col("p_name").alias("name"), "p_partkey")
    return W.first_wins(items, "name", ["p_partkey"])


def evidence(v):
    """Four kinds of evidence, drawn from the events of each user."""
    e = v.table("events")
    user, i = F.col("user_id").cast("string"), F.col("event_id")
    runs = e.select(user.alias("wanted")).distinct()
    last = lambda df, *cols: df.groupBy("run_id").agg(F.max_by(F.struct(*cols), "event_id").alias("r")).select("run_id", "r.*")
    own = last(e.where(i % 4 == 0).select(
        user.alias("run_id"), "event_id", F.when(i % 3 != 0, F.col("value")).alias("annual_algo_return"), F.when(i % 5 != 0, F.col("value")).alias("sharpe"),
    ), "annual_algo_return", "sharpe")
    listed = e.where((F.col("user_id") % 2 == 0) & (i % 4 == 0)).select(
        F.concat(F.lit("r"), user).alias("run_id"), F.lit(1.0).alias("annual_algo_return"), F.lit(1.0).alias("sharpe")).distinct()
    word = (
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "cancelled").otherwise("running")
    )
    listing = e.where((i % 4 == 1) & (F.col("user_id") % 3 != 0)).select(
        i.alias("pos"), F.when(i % 8 == 1, F.concat(F.lit("r"), user)).otherwise(user).alias("id"), user.alias("list_id"), F.lit("").alias("source_id"), word.alias("status"))
    results = last(e.where(i % 4 == 2).select(user.alias("run_id"), "event_id", (i % 5).cast("string").alias("state")), "state")
    logs = e.where((i % 4 == 3) & (F.col("event_type") == "error")).select(user.alias("run_id"), "props")
    return runs, own.unionByName(listed), listing, results, logs


@query("reconcile_status", """
WITH e AS (SELECT *, CAST(user_id AS VARCHAR) AS u FROM events),
own AS (SELECT u AS run_id, arg_max(CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 1 ELSE 0 END, event_id) = 1 AS core FROM e WHERE event_id % 4 = 0 GROUP BY u
 UNION ALL SELECT DISTINCT 'r' || u, true FROM e WHERE user_id % 2 = 0 AND event_id % 4 = 0),
li AS (SELECT u, CASE WHEN event_id % 8 = 1 THEN 'r' || u ELSE u END AS id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' ELSE 'running' END AS status,
 row_number() OVER (PARTITION BY u ORDER BY event_id) AS rn FROM e WHERE event_id % 4 = 1 AND user_id % 3 <> 0),
res AS (SELECT u, CASE arg_max(event_id % 5, event_id) WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' WHEN 3 THEN 'cancelled' ELSE '' END AS result FROM e WHERE event_id % 4 = 2 GROUP BY u),
lg AS (SELECT DISTINCT u FROM e WHERE event_id % 4 = 3 AND event_type = 'error'),
j AS (SELECT w.u AS wanted, coalesce(li.id, w.u) AS resolved_id, coalesce(a.core, false) AS core, li.status AS listed, coalesce(b.core, false) AS listed_core, coalesce(res.result, '') AS result,
 lg.u IS NOT NULL AS has_errors FROM (SELECT DISTINCT u FROM e) w LEFT JOIN li ON li.u = w.u AND li.rn = 1 LEFT JOIN own a ON a.run_id = w.u
 LEFT JOIN own b ON b.run_id = coalesce(li.id, w.u) LEFT JOIN res ON res.u = w.u LEFT JOIN lg ON lg.u = coalesce(li.id, w.u)),
d AS (SELECT *, CASE WHEN core THEN 'stats' WHEN listed = 'done' AND listed_core THEN 'listing stats' WHEN listed IN ('failed', 'cancelled') THEN 'listing'
 WHEN result = 'done' AND listed IS NULL THEN 'result' WHEN result IN ('failed', 'cancelled') AND coalesce(listed, '') <> 'running' THEN 'result'
 WHEN listed = 'done' THEN 'listing without stats' ELSE 'none' END AS decided_by FROM j),
s AS (SELECT *, CASE decided_by WHEN 'listing' THEN CASE WHEN listed = 'cancelled' AND has_errors THEN 'failed' ELSE listed END
 WHEN 'result' THEN CASE WHEN result = 'cancelled' AND has_errors THEN 'failed' ELSE result END WHEN 'none' THEN 'running' ELSE 'done' END AS status FROM d)
SELECT wanted, resolved_id, status, decided_by, status IN ('done', 'failed', 'cancelled') AS terminal FROM s""")
def _(v):
    return reconcile_status(*evidence(v))


def log_pages(v):
    """Log pages per document: its lines in pages of one per paragraph; some pages claim to be the last."""
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "sentence"))
    return lines.select(
        F.col("doc_id").alias("run_id"), (F.col("i") + 1).cast("bigint").alias("page"), F.split("sentence", "\n").alias("lines"),
        ((F.col("doc_id") + F.col("i")) % 40 == 39).alias("is_last"))


_SQL_LOG = """
WITH p AS (SELECT doc_id AS run_id, unnest(string_split(text, '. ')) AS sentence, unnest(range(1, len(string_split(text, '. ')) + 1)) AS page FROM documents),
q AS (SELECT *, string_split(sentence, chr(10)) AS lines, (run_id + page - 1) % 40 = 39 AS is_last FROM p),
st AS (SELECT run_id, min(page) AS stop FROM q WHERE is_last GROUP BY run_id),
r AS (SELECT q.*, sum(len(lines)) OVER (PARTITION BY q.run_id ORDER BY page) - len(lines) AS first FROM q LEFT JOIN st ON st.run_id = q.run_id WHERE st.stop IS NULL OR page <= st.stop)
"""


@query("assemble_log", _SQL_LOG + """
SELECT run_id, page, 100 + first + unnest(range(len(lines))) AS "offset", unnest(lines) AS line FROM r""")
def _(v):
    return W.assemble_log(log_pages(v), start=100)


@query("log_cursor", _SQL_LOG + """
SELECT run_id, count(*) AS pages_read, sum(len(lines)) AS n_lines, sum(len(lines)) + 100 AS next_offset, bool_or(is_last) AS is_last FROM r GROUP BY run_id""")
def _(v):
    return W.log_cursor(log_pages(v), start=100)
