"""Exact duplicates: a tree merge of sorted digest runs.

Every partition of the input writes a sorted run: its digests in order, each
with the row that would stay.  Where the input has fewer than ``LEAST_RUNS`` partitions,
each of them makes several runs, so that the tree has levels at any size.  In
binomial rounds neighbouring runs (2i and 2i + 1) are merged: Spark sorts the
rows of both by (pair, digest), combines equal digests before the shuffle
and merges the sorted pieces after it.  A merged run is dealt over
tasks by digest, the last one too, so the root is never one task.  A row is
(digest, length, second hash): equal digests are trusted only if the length
and an independent hash agree, at every level, and each level retains the
smallest candidate.

Texts are read once; what is shuffled is about 100 bytes a row and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redress.llm.common import WHITE, attach, stored


def normalised(text: Column) -> Column:
    """The text without U+0020 and U+0009 to U+000D; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


#: A table of fewer partitions is cut into so many runs at least.
LEAST_RUNS = 8


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, length, second, points, run), one row per input row; the
    rows of a run are stored in the order of their digests."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = docs.select(F.col(id_col).alias("id"), F.length(text).alias("points"), normalised(F.col(text_col)).alias("t"))
    slim = short.select("id", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("length"),
                        F.xxhash64("t").alias("second"), "points", F.monotonically_increasing_id().alias("row"))
    slim = stored(slim.sortWithinPartitions("digest"), "digests")
    part = F.shiftright("row", 33)  # the number of the partition that wrote it
    many = (slim.agg(F.max(part)).first()[0] or 0) + 1
    each = -(-LEAST_RUNS // many)
    return slim.select(*[c for c in slim.columns if c != "row"], (part * each + F.col("row") % each).cast("int").alias("run"))


#: What must agree for two texts to be equal.
VERIFIED = ["digest", "length", "second"]


def merge(run: DataFrame) -> DataFrame:
    """(digest, length, second, best, n): the root of the merge tree over the
    runs.  ``best`` is (-points, id is null, id) of the row that stays."""
    many = (run.agg(F.max("run")).first()[0] or 0) + 1
    best = F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    now = run.select("run", *VERIFIED, best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        pair = F.shiftright("run", 1).alias("run")
        now = now.groupBy(pair, *VERIFIED).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        many = -(-many // 2)
        if many == 1:
            return now.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal if they are after removal of white space; of equal texts
    the one with the most code points, then the smallest id stays (an id
    before a null one).  Null and empty texts are equal.  Rows that repeat an
    id and a text are all kept if that id is: give unique ids to tell them
    apart.  A group whose ids are all null has a null ``keep_id`` and its
    rows are kept.  Other columns are not read.
    """
    run = runs(docs, id_col, text_col)
    root = merge(run).where("n > 1")
    root = stored(root.select(F.concat_ws(":", *VERIFIED).alias("key"), F.col("best.id").alias("keep"),
                              F.lit(True).alias("many"), "n"), "digest-root")
    rows = run.select("id", F.col("digest"), F.concat_ws(":", *VERIFIED).alias("key"))
    out = attach(rows, root, "key", "n")
    keep = F.when(F.col("many"), F.col("keep")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
