"""Narrative texts: the held-out CSV of the reference, and a stand-in corpus
made from the driver's ``documents`` table."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from redress.session import stored


def read_narratives_csv(
    spark: SparkSession,
    path: str,
    text_index: int = 0,
    text_col: str = "narrative",
    schema: str | StructType | None = None,
) -> DataFrame:
    """``(narrative_id, narrative)`` from CSV files with a header whose column
    ``text_index`` holds the narrative.

    With a ``schema`` the files are not looked at to plan the read, and a
    header that names other columns is an error.  Narratives span lines and
    hold quotes, so the reader runs with ``multiLine``: one task per file.
    Store large inputs once (:func:`store_narratives`) and work on that.
    The id is ``<file name>:<row in the file>``, whatever files lie beside it
    and however Spark groups them.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    raw = reader.csv(path)
    rows = raw.select(
        F.col("_metadata.file_name").alias("_file"),
        F.monotonically_increasing_id().alias("_at"),  # grows along a file
        F.col(raw.columns[text_index]).alias(text_col),
    )
    n = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return rows.select(F.concat_ws(":", "_file", n - 1).alias("narrative_id"), text_col)


def read_narratives_split(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    text_index: int = 0,
    text_col: str = "narrative",
) -> DataFrame:
    """``(narrative_id, narrative, *the other columns)``, the rows of
    :func:`read_narratives_csv` with a ``schema``, but a large file is read by
    as many tasks as it has splits.

    Where a record ends cannot be told from a split alone, since narratives
    span lines.  A line end is a record's end if an even number of quotes
    stands before it in the file (a quote inside a field is doubled):

    1. every split is read as lines, and each line gets the parity of quotes
       within its split up to its end (a window over one split; stored);
    2. splits are aggregated to the parity of their quotes and the number of
       line ends of either parity; running sums over a file's splits say how each
       split begins and how many records end before it;
    3. a line that is a record by itself is one; the others are grouped by
       record, in the order of split and line.

    Line ends are ``\\n`` or ``\\r\\n``; blank lines between records are no
    records.  A field with line ends or quotes is quoted.  Files whose header
    names other columns than the schema are an error."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"),
        F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("_line"),
    )
    within = Window.partitionBy("_file", "_split").orderBy("_at")  # one split's lines
    quotes = F.length("_line") - F.length(F.replace("_line", F.lit('"'), F.lit("")))
    blank = F.col("_line").isin("", "\r")
    lines = read.withColumn("_odd", quotes % 2).withColumn("_parity", F.sum("_odd").over(within) % 2)
    ended = lambda k: F.when((F.col("_parity") == k) & ~blank, 1).otherwise(0)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    for k in (0, 1):  # records that end before the line, if the split begins outside or inside a field
        lines = lines.withColumn(f"_ended{k}", F.coalesce(F.sum(ended(k)).over(before), F.lit(0)))
    lines = stored(lines, "csv-lines")

    splits = lines.groupBy("_file", "_split").agg(
        F.sum("_odd").alias("_odds"), F.sum(ended(0)).alias("_n0"), F.sum(ended(1)).alias("_n1"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.withColumn("_begin", F.coalesce(F.sum("_odds").over(earlier), F.lit(0)) % 2)
    ends = F.when(F.col("_begin") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    splits = splits.select("_file", "_split", "_begin", F.coalesce(F.sum(ends).over(earlier), F.lit(0)).alias("_records"))

    placed = lines.join(splits, ["_file", "_split"])
    outside = F.col("_parity") == F.col("_begin")  # no field is open at the line's end
    number = F.col("_records") + F.when(F.col("_begin") == 0, F.col("_ended0")).otherwise(F.col("_ended1"))
    placed = placed.where(~(blank & outside & (F.col("_odd") == 0))).select(
        "_file", "_name", "_split", "_at", "_line", number.alias("_number"), (outside & (F.col("_odd") == 0)).alias("_whole")
    )
    # a line that opens no field and closes none is a record
    alone = placed.where("_whole").select("_file", "_name", "_number", F.col("_line").alias("_record"))
    pieces = placed.where("NOT _whole").groupBy("_file", "_name", "_number").agg(
        F.array_sort(F.collect_list(F.struct("_split", "_at", "_line"))).alias("_pieces"))  # the lines of one record
    joined = pieces.select("_file", "_name", "_number", F.array_join(F.transform("_pieces", lambda x: x["_line"]), "\n").alias("_record"))
    records = alone.unionByName(joined).withColumn("_record", F.regexp_replace("_record", "\r$", ""))

    heads = records.where("_number = 0").groupBy("_record").agg(F.min("_name").alias("file")).collect()  # few: one per kind of file
    for head in heads:
        if next(csv.reader([head["_record"]])) != schema.fieldNames():
            raise ValueError(f"the header of {head['file']} is {head['_record']!r}, not {schema.fieldNames()}")
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    row = F.from_csv("_record", schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    names = [n for i, n in enumerate(schema.fieldNames()) if i != text_index]
    return records.where("_number > 0").withColumn("_row", row).select(
        F.concat_ws(":", "_name", F.col("_number") - 1).alias("narrative_id"),
        F.col("_row")[schema.fieldNames()[text_index]].alias(text_col), *[F.col("_row")[n].alias(n) for n in names],
    )


def store_narratives(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """The CSV files under ``path`` written once as parquet at ``table``, and
    that table read; ``options`` as in :func:`read_narratives_csv`."""
    read_narratives_csv(spark, path, **options).write.parquet(table)
    return spark.read.parquet(table)


def distinct_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """One row per distinct text, the one with the smallest id.

    Grouped by a SHA-256 digest of the whole text (and its length) rather
    than the text itself, so the shuffle key is 32 bytes; each text crosses
    the shuffle once, after a map-side partial minimum.
    """
    carry = [id_col, text_col, *(keep or [])]
    best = F.min(F.struct(*[F.col(x) for x in carry])).alias("_best")
    grouped = docs.groupBy(
        F.sha2(F.col(text_col), 256).alias("_digest"), F.length(text_col).alias("_len")
    ).agg(best)
    return grouped.select(*[F.col(f"_best.{x}").alias(x) for x in carry])


def documents_corpus(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """``(doc_id, text, lang)`` of the ``documents`` table, whole texts;
    with ``distinct`` one row per distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.where(F.col("text").isNotNull())
    return distinct_texts(docs, keep=["lang"]) if distinct else docs
