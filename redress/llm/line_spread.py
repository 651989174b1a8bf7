"""Boilerplate lines by the number of distinct sites they appear on.

Each line hash has a HyperLogLog sketch of its sites; sketches are built
before the shuffle and merged by aggregation, so a line that stands in every
document is a few bytes per task.  Lines whose estimate lies near the
threshold get an exact distinct count; the decision is then that of the
exact count for all but lines far from it.  Of a line on at least
``min_sites`` sites the first occurrence (smallest id, then position) stays
and all others are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import FEW_DECISIONS, WHITE, attach, fresh, stored

#: log2 of the registers of a sketch: a standard error of about 1.6 %.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold are counted exactly (over 10 standard errors).
NEAR = 0.2


def _key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart without their text."""
    return [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.length(text_col).alias("_n")]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(_id, _h, _n, pos, line, site): every line of every text that is not
    blank.  ``line`` holds two hashes of the line without white space at its
    ends; a null site is a site of its own."""
    lines = F.split(F.col(text_col).cast("string"), "\n")
    out = docs.select(*_key(id_col, text_col), F.xxhash64(site_col).alias("site"), F.posexplode(lines).alias("pos", "t"))
    trimmed = F.trim("t", F.lit(WHITE))
    out = out.withColumn("t", trimmed).where("t <> ''")
    line = F.concat(F.hex(F.xxhash64("t")), F.hex(F.hash("t").cast("long").bitwiseAND(0xFFFFFFFF)))
    return out.select("_id", "_h", "_n", "pos", line.alias("line"), "site")


def spread(lines: DataFrame, min_sites: int, near: float = NEAR) -> DataFrame:
    """(line, first, n) of the lines on at least ``min_sites`` sites."""
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h", "_n", "pos")).alias("first")
    sketched = stored(
        lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("s"), first, F.count("*").alias("n"))
        .select("line", F.hll_sketch_estimate("s").alias("sites"), "first", "n")
        .where(F.col("sites") >= min_sites * (1 - near)),
        "line-sketches",
    )
    sure = sketched.where(F.col("sites") > min_sites * (1 + near))
    close = sketched.where(F.col("sites") <= min_sites * (1 + near))
    # a line on few sites may still hold a third of all rows
    exact = attach(lines.select("line", "site"), close.select("line", "n"), "line", "n").where("n IS NOT NULL")
    exact = exact.select("line", "site").distinct().groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return sure.select("line", "first", "n").unionByName(close.join(exact, "line", "left_semi").select("line", "first", "n"))


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5,
    count_col: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with the repeated occurrences of cross-site lines removed.

    One row per input row, all columns; ``count_col`` (if it exists) becomes
    the length of the new text of changed rows.  ``text`` and the other
    columns of unchanged rows stay as they are, null texts included.  A text
    whose every line goes is empty.  Rows that repeat an id and a text all
    keep a first occurrence that is theirs.  Columns may have any names.  Texts
    stay in their tasks while the lists of lines to drop are as small as
    :data:`common.FEW_DECISIONS` rows.
    """
    lines = stored(occurrences(docs, id_col, text_col, site_col), "lines")
    known = stored(spread(lines, min_sites), "boilerplate")
    hit = attach(lines, known, "line", "n").where("first IS NOT NULL")
    stays = " AND ".join(f"{c} <=> first.{c}" for c in ("_id", "_h", "_n", "pos"))
    drops = hit.where(f"NOT ({stays})").groupBy("_id", "_h", "_n").agg(F.collect_set("pos").alias("_drop"))
    names = fresh(docs, "_did", "_dh", "_dn", "_drop")
    drops = stored(drops.toDF(*names), "line-drops")
    own = fresh([*docs.columns, *names], "_id", "_h", "_n")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_key(id_col, text_col), own)])
    same = keyed[own[0]].eqNullSafe(drops[names[0]]) & (keyed[own[1]] == drops[names[1]]) & (keyed[own[2]] == drops[names[2]])
    rows, places = drops.agg(F.count("*"), F.coalesce(F.sum(F.size(names[3])), F.lit(0))).first()
    few = rows + places // 8 <= FEW_DECISIONS
    joined = keyed.join(F.broadcast(drops) if few else drops, same, "left")
    drop = F.col(names[3])
    parts = F.split(F.col(text_col).cast("string"), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    rest = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    new = {text_col: F.when(drop.isNull(), F.col(text_col)).otherwise(rest)}
    if count_col and count_col in docs.columns:
        size = F.length(rest).cast(docs.schema[count_col].dataType)
        new[count_col] = F.when(drop.isNull(), F.col(count_col)).otherwise(size)
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
