"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted.  A bin costs its length plus a fixed
overhead.  Items are placed longest first into the open bin that they fill
best; if none has room, a bin is opened.  Its length is the one of least cost
per token: each permitted length is filled, on trial, with the item and the
longest of the items to come that fit, is cut down to what that takes, and
its cost is divided by the tokens.  For a whole shard this is compared with
the packings that open at most one given length, each in turn (items above it open
the smallest length that holds them).  Every bin is then cut down to the smallest
permitted length that holds its contents, and the packing of least total
cost stays.

Rows are dealt evenly over shards; a shard holds three numbers a row, and
shards are packed independently, so the work grows linearly and only the
last bins of each shard are filled less well.
"""

from __future__ import annotations

import operator
import re
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redress.llm.common import ship, stored

#: Permitted sequence lengths, and the cost of a bin beside its length.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 64
#: Pieces in a shard, about.
SHARD_ROWS = 100_000
#: Pieces of texts that a process remembers (up to twice as many), and bytes of texts that are counted at a time.
REMEMBERED, GROUP_BYTES = 200_000, 2_000_000


def count_words(text: Column) -> Column:
    """Words of a text (runs without U+0020 and U+0009 to U+000D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_COUNTERS: dict[str, _Counter] = {}


class _Counter:
    """Numbers of subword ids, piece by piece: texts are cut where one space
    stands between characters that are not white space, which no vocabulary
    piece spans, so that a piece is encoded once per process."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any(re.search("[^▁]▁", t) for t in names)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:  # what was met since the last time stays one time longer
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = []
        for p in {p for pieces in cut for p in pieces if p not in known}:
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) for every row: the subword ids of its whole text by a
    SentencePiece model; 0 for a null or empty text."""

    def run(batches):
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = _Counter(model_path)
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
                part = b.slice(at, upto - at)
                n = _COUNTERS[model_path].counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])
                at = upto

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long")


def _cheapest(sizes: list[int], k: int, capacities: tuple, overhead: int) -> int:
    """The length to open for item ``k`` of ``sizes`` (longest first): that of
    least cost per token on trial, the shortest of equal ones."""
    best = None
    for c in capacities:
        if c < sizes[k]:
            continue
        used, at = 0, k
        while at < len(sizes):
            used += sizes[at]
            # the longest of the items after it that still fits
            at = bisect_left(sizes, used - c, at + 1, key=operator.neg)
        cost = (capacities[bisect_left(capacities, used)] + overhead) / used
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def _best_fit(sizes: list[int], capacities: tuple, overhead: int, largest: int | None) -> tuple[np.ndarray, list[int]]:
    """Bin of every size (given longest first) and the contents of the bins,
    opening the cheapest length, or at most length ``largest`` unless an item
    needs more."""
    bins = np.empty(len(sizes), np.int64)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # (free, bin), in order
    for k, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(filled)
            if largest is None and size:
                free = _cheapest(sizes, k, capacities, overhead)
            else:
                free = next(c for c in capacities if c >= max(size, largest or 0))
            filled.append(0)
        bins[k] = b
        filled[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, filled


def pack(sizes: np.ndarray, capacities: tuple = CAPACITIES, overhead: int = OVERHEAD) -> pd.DataFrame:
    """(bin, capacity, start) for every size, none above the largest capacity.

    Ties go to the earlier size, and between packings of equal cost to the
    one with the smaller largest length, the one that chose every length last.
    Sizes of 0 take no room.
    """
    sizes = np.asarray(sizes, np.int64)
    capacities = tuple(sorted(capacities))
    order = np.argsort(-sizes, kind="stable")
    best, ordered = None, sizes[order].tolist()
    for largest in (*capacities, None):
        bins, filled = _best_fit(ordered, capacities, overhead, largest)
        final = np.array(capacities, np.int64)[np.searchsorted(capacities, filled)] if filled else np.zeros(0, np.int64)
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = (cost, bins, final)
    _, bins, final = best
    at = np.empty(len(sizes), np.int64)
    at[order] = bins
    out = pd.DataFrame({"bin": at, "size": sizes})
    out["start"] = out.groupby("bin")["size"].cumsum() - out["size"]
    out["capacity"] = final[at] if len(at) else at
    return out[["bin", "capacity", "start"]]


def pack_rows(
    docs: DataFrame, size: Column, id_col: str = "doc_id", capacities: tuple = CAPACITIES, overhead: int = OVERHEAD,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id_col, piece, n_tokens, bin_id, capacity, start): where every piece
    of every row goes.

    ``size`` is a row's number of tokens.  A row above the largest capacity
    is cut into pieces of that length and a rest (``piece`` counts from 0);
    a row of no (or null) tokens is one piece of 0 tokens, in no bin (null
    ``bin_id`` and ``capacity``, start 0).  Ids may be null or repeat: every
    row is packed.  Other columns are not read.
    """
    top = max(capacities)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / top).cast("int") - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "id", "piece", F.least(F.lit(top), F.col("size") - F.col("piece").cast("long") * top).cast("long").alias("size")
    )
    return _packed(pieces, id_col, tuple(capacities), overhead, shard_rows)


def _packed(pieces: DataFrame, id_col: str, capacities: tuple, overhead: int, shard_rows: int) -> DataFrame:
    ship(pieces.sparkSession)
    kept = stored(pieces, "pieces")
    filled = kept.where("size > 0")
    shards = max(1, -(-filled.count() // shard_rows))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        held = list(batches)  # one shard: about shard_rows slim rows
        if not held:
            return
        table = pa.Table.from_batches(held)
        placed = pack(table["size"].to_numpy(), capacities, overhead)
        shard = TaskContext.get().partitionId()
        yield from table.append_column("bin_id", pa.array(placed["bin"].to_numpy() + (shard << 40))).append_column(
            "capacity", pa.array(placed["capacity"].to_numpy())).append_column("start", pa.array(placed["start"].to_numpy())).to_batches()

    # round robin over shards: Spark sorts first, so a retried task deals alike
    dealt = filled.repartition(shards).sortWithinPartitions(F.desc("size"), "id", "piece")
    done = dealt.mapInArrow(run, f"id {kind}, piece int, size long, bin_id long, capacity long, start long")
    none = kept.where("size <= 0").selectExpr(
        "id", "piece", "size", "CAST(NULL AS long) AS bin_id", "CAST(NULL AS long) AS capacity", "0L AS start")
    return done.unionByName(none).select(
        F.col("id").alias(id_col), "piece", F.col("size").alias("n_tokens"), "bin_id", "capacity", "start")
