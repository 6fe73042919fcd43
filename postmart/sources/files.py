"""Readers for archive files: strict JSON lines, one-document JSON and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from postmart.functions.scalars import float_or_null, int_trunc, is_blank, vget, vkind


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def resolved_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Each existing path once, at its first place, by what it resolves to; missing ones are left out."""
    found = []
    for path in paths:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop_path):
            found.append(fs.resolvePath(hadoop_path).toString())
    return list(dict.fromkeys(found))


def _lenient(v: Column, path: str, kind: T.DataType) -> Column:
    """The value at ``path`` of a variant as ``kind``: numbers may be text or have a fraction, which a whole
    number drops; what does not fit is NULL."""
    if isinstance(kind, T.StructType):
        fields = [_lenient(v, f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields]
        return F.when(vkind(vget(v, path, "variant")) == "OBJECT", F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        items = vget(v, path, "array<variant>")
        if isinstance(kind.elementType, T.StructType):
            item = lambda x: F.struct(*[_lenient(x, f.name, f.dataType).alias(f.name) for f in kind.elementType.fields])
            return F.transform(F.filter(items, lambda x: vkind(x) == "OBJECT"), item)
        return F.transform(items, lambda x: x.try_cast(kind.elementType))
    text = vget(v, path)
    if isinstance(kind, T.IntegralType):
        return F.when(text == "true", 1).when(text == "false", 0).otherwise(int_trunc(text)).cast(kind)
    if isinstance(kind, T.FractionalType):
        return float_or_null(text).cast(kind)
    return text if isinstance(kind, T.StringType) else vget(v, path, kind.simpleString())


def scan_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType, line_no: bool = False) -> DataFrame:
    """One JSON object per line.  Blank lines and lines holding something other than an object are
    dropped; a line that is not JSON fails the query with the file name and the line.

    Each line is parsed once and its fields are read with the types of ``schema``, leniently (``_lenient``).

    ``line_no`` adds a value that grows along the lines of the input: file, start of the split, place in it.
    It orders lines; it is not a number, because numbering lines exactly would need a pass over all
    earlier splits."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    columns = ["value", F.col("_metadata.file_name").alias("file_name")]
    if line_no:
        at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
        columns.append(F.struct(*at, F.monotonically_increasing_id().alias("place")).alias("line_no"))
    parsed = lines.select(*columns).withColumn("v", F.try_parse_json("value"))
    problem = F.concat(F.lit("invalid JSON line in "), F.col("file_name"), F.lit(": "), F.substring("value", 1, 200))
    checked = parsed.withColumn(
        "kind", F.when(F.col("v").isNull(), F.raise_error(problem).cast("string")).otherwise(vkind("v"))
    ).where(F.col("kind") == "OBJECT")
    fields = [_lenient(F.col("v"), f.name, f.dataType).alias(f.name) for f in schema.fields]
    return checked.select(*fields, *["line_no"] * line_no)


def scan_json_document(spark: SparkSession, path: str, item: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON document with an ``items`` list.  One document is one task; landing many documents in one
    folder reads them in parallel.  ``lines`` reads a document that ``write_json_document`` has spread over
    part files, one item a line, in parallel too."""
    if lines:
        text = spark.read.text(path).where(~F.col("value").rlike(r'^(\{"count":\d+,"items":\[|\]\})$'))
        return text.select(F.from_json(F.regexp_replace("value", "^,", ""), item).alias("item")).select("item.*")
    schema = T.StructType([T.StructField("items", T.ArrayType(item))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("items"))


def scan_id_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty ``id`` values of a CSV with header; a missing file is an empty set."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string")
    table = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if "id" not in table.columns:
        return spark.createDataFrame([], "id string")
    return table.select("id").where(~is_blank("id")).distinct()
