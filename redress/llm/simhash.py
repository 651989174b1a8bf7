"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= r meet at some word v within
ceil(r / 2) bits of one and floor(r / 2) bits of the other.  For radius 3
every fingerprint therefore emits its variants within 1 bit, and one of each
such pair those at 2 bits: fingerprints at distance 3 differ in parity, so
only those with an even number of ones need to emit them.  The rows are
shuffled on the variant.  All fingerprints within 1 bit of v are within 3
bits of everything else that emitted v, so a bucket is linked through its
smallest such member (its hub): one edge per emitted row, verified by the
bits, and never all pairs of a bucket.

Balls are large (1 + 64 + 2016 variants), so fingerprints without any
possible partner are set aside first, exactly: of two fingerprints within 3
bits, one 32-bit half differs in at most one bit, so they share a half with
one position masked out.  Only fingerprints that share such a key with
another one emit their balls.  Every fingerprint emits 64 keys (or 65 to
2081 variants), so one key holds at most that fraction of the rows and no
key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redress.llm.common import FEW_DECISIONS, attach, fresh, ship, stored
from redress.llm.components import connected_components

#: The method splits a radius of 3 into 2 + 1.
MAX_BITS = 3

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256
_BLOCK = 1 << 18


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (unsigned).

    A-Z are lower-cased, words are split at U+0020 and U+0009 to U+000D.
    Fewer words than a shingle make one shingle; no word, an empty or a null
    text gives 0.
    """
    w = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        shingles, n = iter([b" ".join(w)]), 1
    else:
        shingles, n = map(b" ".join, zip(*[w[i:] for i in range(words)])), len(w) - words + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    counts = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8) + _OFFSETS
        counts += np.bincount(part.ravel(), minlength=2048)
    ones = np.einsum("jb,bi->ji", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 key: Column | None = None) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long,
    and ``key`` as ``_k`` if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=names)

    ship(docs.sparkSession)
    keys = [] if key is None else [key.alias("_k")]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keys)
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "fp", "_k"][: 2 + len(keys)]
    return src.mapInArrow(run, f"id {kind}, fp long" + ", _k string" * len(keys))


def _possible(classes: DataFrame) -> DataFrame:
    """The classes (fp, node) that share a half with one position masked out
    with another class."""
    half, bit = F.col("half"), F.col("bit")
    keys = classes.select(
        "fp", "node", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    ).select(
        "fp", "node", "i", F.expr("CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END").alias("half"),
        F.expr("~shiftleft(1L, i % 32)").alias("bit"),
    ).select("fp", "node", (half.bitwiseAND(bit) * 64 + F.col("i")).alias("key"))
    dealt = keys.repartition("key")
    # min and max of fp: the same columns as the other branch, so that Spark reuses the exchange
    shared = dealt.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.min("node").alias("c"))
    shared = shared.where("a <> b").select("key")
    return dealt.join(shared, "key", "left_semi").select("fp", "node").distinct()


def _balls(classes: DataFrame) -> DataFrame:
    """(v, r, fp, node): variants within 1 bit, and at 2 bits for even fingerprints."""
    one = classes.select("fp", "node", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    last = F.expr("CASE WHEN i < 0 OR bit_count(fp) % 2 = 1 THEN i ELSE 63 END")
    two = one.select("fp", "node", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    mask = "CASE WHEN i < 0 THEN 0L WHEN i = j THEN shiftleft(1L, i) ELSE shiftleft(1L, i) | shiftleft(1L, j) END"
    return two.select(
        F.expr(f"fp ^ ({mask})").alias("v"),
        F.expr("CASE WHEN i < 0 THEN 0 WHEN i = j THEN 1 ELSE 2 END").alias("r"), "fp", "node",
    )


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) of nodes that connect exactly the classes (fp, node)
    joined by chains of fingerprints within 3 bits."""
    near = stored(_possible(classes), "simhash-possible")
    dealt = _balls(near).repartition("v")
    hub = F.min(F.when(F.col("r") <= 1, F.struct("node", "fp"))).alias("hub")
    buckets = dealt.groupBy("v").agg(
        hub, F.min("fp").alias("a"), F.max("fp").alias("b")
    ).where("hub IS NOT NULL AND a <> b").select("v", "hub")
    met = dealt.join(buckets, "v").where(f"node <> hub.node AND bit_count(fp ^ hub.fp) <= {MAX_BITS}")
    return met.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links of at most 3
    differing bits, the row itself included.  Null, empty and blank texts
    have the fingerprint 0 and link like any other.  Rows with a null id get
    a fingerprint and the component of their fingerprint, but are never its
    smallest id; a class of such rows only has a null component and links
    nothing.  Repeated ids and rows are kept.  Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    grouped = stored(
        prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("_n")), "simhash-classes"
    )
    found = connected_components(links(grouped.where("node IS NOT NULL").select("fp", "node")))
    # an id on rows of several texts is one node, its texts one component
    label = found.select(F.col("node"), F.col("component"))
    named = grouped.join(label, "node", "left").select(
        "fp", "_n", F.coalesce("component", "node").alias("component_id")
    )
    return attach(prints, stored(named, "simhash-named"), "fp", "_n").select(
        F.col("id").alias(id_col), "fp", "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of fingerprints that links of at
    most 3 differing bits connect; all columns.

    Rows are judged one by one, so an id on several texts can stay on one and
    go on another, and links nothing by itself.  The row that stays has the
    smallest id (a null id only if no other row has one); rows that share it
    are told apart by hashes of their text and of all their columns but maps,
    and of rows equal in all that any one stays.  Null, empty and blank texts
    have the fingerprint 0 and link like any other.  ``docs`` is read several
    times: give it stored.  Its columns may have any names.  Texts stay in
    their tasks while the decisions (the rows that go and the repeated ones) are
    at most :data:`common.FEW_DECISIONS`.
    """
    whole = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(-1))
    key = F.concat_ws(":", F.hex(F.xxhash64(text_col)), size, F.hex(whole))
    prints = fingerprints(docs, id_col, text_col, words, key)
    rows = stored(prints.groupBy("fp", "id", "_k").agg(F.count("*").alias("_c")), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_k")).alias("first")
    classes = stored(rows.groupBy("fp").agg(first), "simhash-classes")
    found = connected_components(links(classes.select("fp", F.col("fp").alias("node"))))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    heads = named.groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    heads = heads.select(F.col("first._k").alias("_k"), F.lit(True).alias("_first"))
    # what the rows of docs have to know: those that go, and those that stay but are repeated
    marks = rows.select("_k", "_c").join(heads, "_k", "left").where("_first IS NULL OR _c > 1")
    k, c, stays = fresh(docs, "_k", "_c", "_first")
    marks = stored(marks.select(F.col("_k").alias(k), F.col("_c").alias(c), F.col("_first").alias(stays)), "simhash-marks")
    told = attach(docs.withColumn(k, key), marks, k, c, few=FEW_DECISIONS)
    lone, repeated = told.where(F.col(c).isNull()), told.where(F.col(stays)).dropDuplicates([k])
    return lone.select(*docs.columns).unionByName(repeated.select(*docs.columns))
