"""Embedding near duplicates through a pivot-permutation index.

A bounded sample of the vectors serves as reference points (pivots).  Every
distinct vector is described by its ``depth`` nearest pivots in order and
posted to the inverted list of each of them.  Two vectors on one list are
candidates when they share at least ``min_shared`` pivots; a candidate pair is
handled on the list of its smallest shared pivot only, so it is counted once,
and verified by its cosine in double precision.

Lists are cut into blocks of at most ``block`` vectors and one group holds
two blocks, so no task sees a whole hot list; inside a group the shared-pivot
counts and cosines are matrix products.  Groups return, per
vector, a sum and the smallest vector it reaches inside the group, never
pairs.  Equal vectors are one
class (with its number of rows) from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import attach, sample, ship, stored
from redress.llm.components import connected_components

#: Bounds of the broadcast reference points: their number, and their values.  A
#: sample has at most twice as many: 32 MB in double precision.
MAX_PIVOTS = 65_536
MAX_PIVOT_VALUES = 1 << 21


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of unit length in double precision, padded to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    peak = np.abs(out).max(axis=1, keepdims=True)
    out /= peak  # no overflow or underflow of the squares
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def valid(vector: str):
    """True for a vector that can link: not null, no null or non-finite
    component, and not all zero (an empty array is all zero)."""
    c = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(c.isNotNull() & F.forall(c, finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def choose_pivots(classes: DataFrame, n: int, width: int) -> np.ndarray:
    """At most min(4 sqrt(n), MAX_PIVOTS, MAX_PIVOT_VALUES / width) class
    vectors, more or less, chosen by hash: a bounded sample, the same on every run."""
    count = max(1, min(math.ceil(4 * math.sqrt(n)), MAX_PIVOTS, MAX_PIVOT_VALUES // max(width, 1)))
    rows = sample(classes.select("node", "vec"), count, "node").toPandas().sort_values("node")
    return _unit(rows["vec"] if len(rows) else classes.limit(1).toPandas()["vec"], width)


def _nearest(pivots: np.ndarray, depth: int, width: int):
    """Batches (node, n, vec) -> one row per posting (pivot, node, n, vec, near)."""
    depth = min(depth, len(pivots))

    def run(batches):
        for df in batches:
            for at in range(0, len(df), 1024):
                part = df.iloc[at : at + 1024]
                score = _unit(part["vec"], width) @ pivots.T
                best = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
                order = np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable")
                near = np.take_along_axis(best, order, axis=1).astype(np.int32)
                yield pd.DataFrame({"node": part["node"], "n": part["n"], "vec": part["vec"], "near": list(near)})

    return run


def _least_reached(met: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that every row and column of ``met`` reaches through
    it; each row and column is looked at once."""
    out_l, out_r = left.copy(), right.copy()
    open_l, open_r = met.any(axis=1), met.any(axis=0)
    for i in np.flatnonzero(open_l):
        if not open_l[i]:
            continue
        rows, all_rows, all_cols = np.array([i]), [], []
        while len(rows):
            open_l[rows] = False
            all_rows.append(rows)
            cols = np.flatnonzero(met[rows].any(axis=0) & open_r)
            open_r[cols] = False
            all_cols.append(cols)
            rows = np.flatnonzero(met[:, cols].any(axis=1) & open_l) if len(cols) else cols
        r, c = np.concatenate(all_rows), np.concatenate(all_cols)
        out_l[r] = out_r[c] = min(left[r].min(), right[c].min())
    return out_l, out_r


def _group(width: int, cosine: float, min_shared: int, step: int = 1024):
    """One group of a list: block a against block b (a = b: against itself)."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        pivot, a, b = (int(k) for k in key)
        left = df if a == b else df[df["blk"] == a]
        right = df if a == b else df[df["blk"] == b]
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        names, where = np.unique(np.concatenate([*left["near"], *right["near"]]), return_inverse=True)
        where = where.reshape(len(left) + len(right), -1)
        marks = np.zeros((len(where), len(names)), dtype=np.float32)
        np.put_along_axis(marks, where, 1, axis=1)
        below = marks[:, names < pivot]
        vl, vr = _unit(left["vec"], width), _unit(right["vec"], width)
        dl, dr = (x["vec"].map(len).to_numpy() for x in (left, right))
        nl, nr = (x["node"].to_numpy() for x in (left, right))
        wl, wr = (x["n"].to_numpy() for x in (left, right))
        k = len(left)
        links_l, links_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        met = np.zeros((len(left), len(right)), bool)
        for i in range(0, k, step):
            s = slice(i, min(i + step, k))
            ok = marks[s] @ marks[k:].T >= min_shared
            if below.shape[1]:
                ok &= below[s] @ below[k:].T == 0  # else another list has the pair
            ok &= vl[s] @ vr.T >= cosine
            ok &= dl[s, None] == dr[None, :]
            if a == b:
                ok &= nl[s, None] != nr[None, :]
            met[s] = ok
            links_l[s] = ok @ wr
            if a != b:
                links_r += wl[s] @ ok
        least_l, least_r = _least_reached(met, nl, nr)
        parts = [(nl, links_l, least_l)] + ([(nr, links_r, least_r)] if a != b else [])
        out = pd.concat([pd.DataFrame({"node": x, "links": y, "least": z}) for x, y, z in parts])
        return out[out["links"] > 0]

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    depth: int = 12, min_shared: int = 2, block: int = 2048,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    ``n_links`` counts the other rows linked directly (equal vectors
    included), ``component_id`` is the smallest id reachable, itself
    included, and ``kept`` says that it is the row's own.  Null, empty, zero
    and non-finite vectors, and vectors with null components, link with
    nothing; vectors of different lengths do not link.  Rows with a null id
    have no links, a null component and are not kept.  Of repeated ids with
    the same vector each counts as a row of its own; different vectors whose
    smallest id is the same are one node and share links and component.
    """
    rows = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).select(
            "id", F.when(valid("vec") & F.col("id").isNotNull(), F.transform("vec", lambda x: x.cast("double"))).alias("vec")
        ).withColumn("h", F.when(F.col("vec").isNotNull(), F.sha2(F.to_json("vec"), 256))),
        "vectors",
    )
    classes = stored(
        rows.where("h IS NOT NULL").groupBy("h").agg(
            F.min("id").alias("node"), F.count("*").alias("n"), F.first("vec").alias("vec")
        ), "vector-classes",
    )
    found = _links(classes, cosine, depth, min_shared, block)
    named = stored(
        classes.select("h", "node", "n").join(found, "node", "left").select(
            "h", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")
        ), "vector-named",
    )
    out = attach(rows.select("id", "h"), named, "h", "n")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        mine.alias("component_id"),
        F.coalesce(mine == F.col("id"), F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, cosine: float, depth: int, min_shared: int, block: int) -> DataFrame:
    """(node, links, component) of the classes with a link to another class."""
    spark = classes.sparkSession
    ship(spark)
    n, width = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "node long, links long, component long")
    pivots = choose_pivots(classes, n, width)
    posted = stored(
        classes.select("node", "n", "vec").mapInPandas(
            _nearest(pivots, depth, width), "node long, n long, vec array<double>, near array<int>"
        ), "postings",
    )
    posts = posted.select("node", "n", "vec", "near", F.explode("near").alias("pivot"))
    # at most MAX_PIVOTS rows
    sizes = posted.select(F.explode("near").alias("pivot")).groupBy("pivot").count().select(
        "pivot", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")
    )
    dealt = posts.join(F.broadcast(sizes), "pivot").withColumn(
        "blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    # block pairs (a <= b) that the row's block belongs to
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "node", "n", "vec", "near", "blk"
    )
    partial = stored(
        paired.groupBy("pivot", "a", "b").applyInPandas(
            _group(width, cosine, min(min_shared, depth, len(pivots)), 1024), "node long, links long, least long"
        ), "vector-links",
    )
    found = connected_components(partial.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return partial.groupBy("node").agg(F.sum("links").alias("links")).join(found, "node", "left")
