"""Rows, cells and attributes out of HTML pages.

HTML needs a tokenizer, which Spark lacks, so this is one of the two places with a Python worker: Arrow
batches through ``mapInPandas``, one page at a time, results exploded on the JVM side.  Pages are small
and independent; they are dealt evenly to all tasks first, however few splits the table has."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Rows(HTMLParser):
    """Collects elements ``row_tag`` (with ``row_class``): cells, attributes and link targets."""

    def __init__(self, row_tag: str, row_class: str | None, cell_tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.row_tag, self.row_class, self.cell_tags = row_tag, row_class, cell_tags
        self.rows: list[dict] = []
        self.open: list[str] = []
        self.row: dict | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attr = {name: value or "" for name, value in attrs}
        if self.row is None:
            if tag == self.row_tag and (not self.row_class or self.row_class in attr.get("class", "").split()):
                self.row = {"cells": [], "attrs": attr, "links": [], "inputs": {}}
                self.open = [tag]
                if tag in self.cell_tags:
                    self.cell = []
            return
        if tag == "a" and attr.get("href"):
            self.row["links"].append(attr["href"])
        if tag == "input":
            for name, value in attr.items():
                self.row["inputs"].setdefault(name, value)
        for name in ("_algorithmid", "_fid"):
            if name in attr:
                self.row["attrs"].setdefault(name, attr[name])
        if tag in _VOID:
            if tag == "br" and self.cell is not None:
                self.cell.append(" ")
            return
        self.open.append(tag)
        if tag in self.cell_tags and self.cell is None:
            self.cell = []

    def handle_endtag(self, tag):
        if self.row is None or tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        if self.cell is not None and tag in self.cell_tags:
            self.row["cells"].append(" ".join(" ".join(self.cell).split()))
            self.cell = None
        if not self.open:
            self.rows.append(self.row)
            self.row = self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


class _Attributes(HTMLParser):
    """Collects (key attribute, value attribute) of every ``tag``; later ones replace earlier ones."""

    def __init__(self, tag: str, key_attr: str, value_attr: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.key_attr, self.value_attr = tag, key_attr, value_attr
        self.pairs: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            attr = {name: value or "" for name, value in attrs}
            if attr.get(self.key_attr):
                self.pairs[attr[self.key_attr]] = attr.get(self.value_attr, "")


_TEXTS, _PAIRS = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
_ROW = T.ArrayType(T.StructType([
    T.StructField("cells", _TEXTS),
    T.StructField("attrs", _PAIRS),
    T.StructField("links", _TEXTS),
    T.StructField("inputs", _PAIRS),
]))


def _per_page(df: DataFrame, html_col: str, name: str, kind: T.DataType, parse) -> DataFrame:
    """Run ``parse(html)`` over the page column; all other columns ride along untouched."""
    others = [f for f in df.schema.fields if f.name != html_col]
    schema = T.StructType([*others, T.StructField(name, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=[html_col])
            out[name] = [parse(page or "") for page in batch[html_col]]
            yield out

    # A file of narrow rows is one row group, so one task; tokenising costs far more than this exchange.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts).mapInPandas(run, schema)


def extract_html_rows(
    df: DataFrame, html_col: str, row_tag: str, row_class: str | None = None, cell_tags: tuple[str, ...] = ("td", "th")
) -> DataFrame:
    """Repeated row elements of each page: (…, row_no, cells, attrs, links, inputs).  Attribute names are
    lower case; for rows without inner cells pass the row tag itself as the cell tag."""
    cells = frozenset(cell_tags)

    def parse(page: str) -> list[dict]:
        rows = _Rows(row_tag, row_class, cells)
        rows.feed(page)
        rows.close()
        return rows.rows

    parsed = _per_page(df, html_col, "__rows", _ROW, parse)
    rest = [c for c in df.columns if c != html_col]
    return parsed.select(*rest, F.posexplode("__rows").alias("row_no", "r")).select(*rest, "row_no", "r.*")


def extract_tag_attributes(df: DataFrame, html_col: str, tag: str, key_attr: str, value_attr: str) -> DataFrame:
    """Attribute pairs of a tag as a map column ``attributes``; the last one of a key wins."""

    def parse(page: str) -> dict[str, str]:
        found = _Attributes(tag, key_attr, value_attr)
        found.feed(page)
        found.close()
        return found.pairs

    return _per_page(df, html_col, "attributes", _PAIRS, parse)


def extract_links(df: DataFrame, html_col: str) -> DataFrame:
    """Link targets without a Python worker: every quoted ``href`` attribute, one row each."""
    rest = [c for c in df.columns if c != html_col]
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit("href=[\"']([^\"']+)[\"']"), 1)
    return df.select(*rest, F.posexplode(hrefs).alias("link_no", "href"))
