"""Text jobs, HTML extraction and the folder walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmart.operators import aggregates as A, normalize as N, sets as U
from postmart.sources.html import extract_html_rows, extract_links, extract_tag_attributes
from workload.registry import query

BEGIN, END, BLOCK = "# block-begin", "# block-end", "# block-begin\nfee(0)\n# block-end"


@query("refresh_marker_block", r"""
SELECT doc_id, md5(rtrim(CASE doc_id % 3 WHEN 1 THEN text || chr(10) || 'tail' ELSE text END, chr(10) || chr(32) || chr(9) || chr(13)) || chr(10) || chr(10)
 || '# block-begin' || chr(10) || 'fee(0)' || chr(10) || '# block-end' || chr(10)) AS text FROM documents WHERE text IS NOT NULL""")
def _(v):
    """Texts without a block, with an old block in the middle, and with a block that never ends."""
    i = F.col("doc_id") % 3
    old = F.lit("\nx # block-begin\nold()\n# block-end y")
    text = (
        F.when(i == 0, F.col("text")).when(i == 1, F.concat("text", old, F.lit("\ntail")))
        .otherwise(F.concat("text", F.lit("\n# block-begin\nopen ended\nmore")))
    )
    once = N.refresh_marker_block(v.table("documents").select("doc_id", text.alias("text")), "text", BEGIN, END, BLOCK)
    twice = N.refresh_marker_block(once, "text", BEGIN, END, BLOCK)
    return twice.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("decode_payload", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN md5(text) WHEN 2 THEN md5('{"n":' || doc_id || '}') END AS digest,
 CASE doc_id % 4 WHEN 3 THEN 'invalid base64' END AS problem FROM documents""")
def _(v):
    i = F.col("doc_id")
    docs = N.encode_payload(v.table("documents"), "text")
    content = (
        F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.col("encoded")).when(i % 4 == 2, F.format_string('{"n":%d}', i))
        .otherwise(F.concat(F.lit("*"), "encoded"))
    )
    kind = F.when(i % 4 == 0, "text").when(i % 4 == 2, "json").otherwise("base64")
    out = N.decode_payload(docs.select("doc_id", content.alias("content"), kind.alias("format")))
    return out.select("doc_id", F.md5("bytes").alias("digest"), "problem")


@query("encode_payload", "SELECT doc_id, md5(to_base64(encode(text))) AS encoded FROM documents")
def _(v):
    return N.encode_payload(v.table("documents"), "text").select("doc_id", F.md5(F.col("encoded").cast("binary")).alias("encoded"))


@query("extract_html_rows")
def _(v):
    """List items of every page with their text and first link."""
    rows = extract_html_rows(v.table("pages").select("page_id", "html"), "html", "li", cell_tags=("li",))
    return rows.select("page_id", "row_no", F.array_join("cells", " ").alias("text"), F.try_element_at("links", F.lit(1)).alias("href"))


@query("extract_tag_attributes", r"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def _(v):
    attrs = extract_tag_attributes(v.table("pages").select("page_id", "html"), "html", "html", "lang", "lang")
    return attrs.select("page_id", F.try_element_at(F.map_values("attributes"), F.lit(1)).alias("lang"))


@query("extract_links", """
SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href FROM pages""")
def _(v):
    return extract_links(v.table("pages").select("page_id", "html"), "html").select("page_id", "href")


@query("max_listing_page", r"""
WITH l AS (SELECT page_id, unnest(list_append(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), url)) AS link FROM pages),
n AS (SELECT page_id, TRY_CAST(regexp_extract(regexp_extract(replace(link, '&amp;', '&'), '^[^?#]*\?([^#]*)', 1), '(?:^|&)page=(\d+)(?:&|$)', 1) AS BIGINT) AS p FROM l)
SELECT page_id, greatest(1, coalesce(max(p), 1)) AS max_page FROM n GROUP BY page_id""")
def _(v):
    pages = v.table("pages").select("page_id", F.concat("html", F.lit('<a href="'), "url", F.lit('">')).alias("html"))
    return A.max_listing_page(pages, "html").select("page_id", "max_page")


@query("normalize_backtest_rows", """
SELECT o_orderkey, 'in' || o_orderkey AS id, 'L' || o_orderkey AS list_id, o_orderpriority AS name,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'cancelled' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' ELSE 'cancelled' END END AS status,
 strftime(o_orderdate, '%Y-%m-%d') AS start_date, strftime(o_orderdate + to_days(9), '%Y-%m-%d') AS end_date, CAST(o_custkey AS DOUBLE) AS capital, 'day' AS frequency, '1%' AS algorithm_return FROM orders""")
def _(v):
    """Listing rows with and without a leading check-box column, parsed from their HTML."""
    i = F.col("o_orderkey")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    word = F.when(F.col("o_orderstatus") == "F", "完成").when(F.col("o_orderstatus") == "P", "已<b>取消</b>").otherwise("-")
    day = F.to_date("o_orderdate")
    html = F.concat(
        F.lit('<table><tr class="head"><td>x</td></tr><tr class="a backtest-tr" _backtestId="L'), i.cast("string"), F.lit('" _backtestId2="in'), i.cast("string"),
        F.lit('" _status="'), (i % 4).cast("string"), F.lit('">'), F.when(i % 2 == 0, "<td><input type=checkbox></td>").otherwise(""),
        cell(i.cast("string")), cell(F.col("o_orderpriority")), cell(F.lit("now")),
        cell(F.concat(day.cast("string"), F.lit("<br>"), F.date_add(day, 9).cast("string"))),
        cell(F.col("o_custkey").cast("string")), cell(word), cell(F.lit("day")), cell(F.lit("1%")), F.lit("</tr></table>"))
    rows = extract_html_rows(v.table("orders").select("o_orderkey", html.alias("html")), "html", "tr", "backtest-tr")
    runs = N.normalize_backtest_rows(rows.select("o_orderkey", "cells", "attrs"))
    return runs.select("o_orderkey", "id", "list_id", "name", "status", "start_date", "end_date", "capital", "frequency", "algorithm_return")


def _strategy_pages(v):
    i = F.col("p_partkey")
    link = F.when(i % 4 != 0, F.concat(F.lit("/edit?x=1&amp;algorithmId=a"), i.cast("string"))).otherwise(F.concat(F.lit("/list?fId=f"), i.cast("string")))
    html = F.concat(
        F.lit('<tr class="algorithm_list" _algorithmId="n'), i.cast("string"), F.lit('"><td></td><td><a href="'), link, F.lit('"> '), F.col("p_name"),
        F.lit("\n &lt;b&gt;</a></td><td>Code</td><td>2024</td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>x</td></tr>"))
    return extract_html_rows(v.table("part").select("p_partkey", html.alias("html")), "html", "tr", "algorithm_list")


@query("normalize_strategy_rows", """
SELECT p_partkey, 'a' || p_partkey AS id, 'n' || p_partkey AS internal_id, p_name || ' <b>' AS name, 'Code' AS type, p_size AS run_count FROM part WHERE p_partkey % 4 <> 0""")
def _(v):
    rows = _strategy_pages(v).select("p_partkey", "cells", "attrs", "links")
    return N.normalize_strategy_rows(rows).select("p_partkey", "id", "internal_id", "name", "type", "run_count")


@query("folder_rows", "SELECT p_partkey, 'f' || p_partkey AS id, p_name || ' <b>' AS name FROM part WHERE p_partkey % 4 = 0")
def _(v):
    return N.folder_rows(_strategy_pages(v).select("p_partkey", "cells", "attrs", "links"))


def tree(v):
    """Folders: root, regions, nations, customers.  Nations are also listed under the next region and
    list the root again, so visits repeat."""
    r, n = v.table("region"), v.table("nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    top = r.select(F.lit("root").alias("parent"), name("r", "r_regionkey").alias("child"), F.col("r_regionkey").alias("pos"))
    mid = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.col("n_nationkey").alias("pos"))
    again = n.select(F.concat(F.lit("r"), (F.col("n_regionkey") + 1).cast("string")).alias("parent"), name("n", "n_nationkey").alias("child"), (F.col("n_nationkey") + 100).alias("pos"))
    up = n.select(name("n", "n_nationkey").alias("parent"), F.lit("root").alias("child"), F.lit(0).alias("pos"))
    leaf = v.table("customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"), F.col("c_custkey").alias("pos"))
    return top.unionByName(mid).unionByName(again).unionByName(up).unionByName(leaf)


@query("walk_folders", """
SELECT 'root' AS folder, 0 AS depth, '' AS path UNION ALL
SELECT 'r' || r_regionkey, 1, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL
SELECT 'n' || n_nationkey, 2, n_regionkey || '/' || n_nationkey FROM nation UNION ALL
SELECT 'c' || c_custkey, 3, n_regionkey || '/' || n_nationkey || '/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(v):
    roots = v.table("region").select(F.lit("root").alias("folder")).distinct()
    return U.walk_folders(tree(v), roots).select("folder", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("walk_items", "SELECT c_custkey AS item, 'n' || c_nationkey AS folder, 2 AS depth FROM customer")
def _(v):
    """Customers are listed in their nation's folder and in the next one; the first visit counts."""
    roots = v.table("region").select(F.lit("root").alias("folder")).distinct()
    folders = U.walk_folders(tree(v), roots)
    c = v.table("customer")
    home = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder"), F.col("c_custkey").alias("item"), F.lit(1).alias("pos"))
    # The second listing is in a folder no walk reaches.
    lost = c.select(F.lit("nowhere").alias("folder"), F.col("c_custkey").alias("item"), F.lit(0).alias("pos"))
    return U.walk_items(folders, home.unionByName(lost)).select("item", "folder", "depth")
