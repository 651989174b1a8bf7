"""How two tokenizers cut the same texts, with corpus-wide counts of the
token pairs that end together, counted by external spilling.

Per document the byte offsets where tokens of both sides end cut them into
groups; the two tokens that end at such an offset are linked.  An id pair's
count is the number of links in the corpus that join it.

Counting never holds more than a bounded piece in memory:

1. Every task turns its documents into records (pair, document, links of it),
   sorts a bounded buffer of them in side-major order (B id, then A id, then
   document) and spills it as one run per radix of the B id: frames of delta
   coded columns, compressed with zstd.  The runs are a table in the shared
   folder, so a lost executor repeats its own task only.
2. Runs are dealt to slices of about ``SLICE`` spills.  Each (slice, radix)
   is counted by a k-way merge: a heap holds the open frames of its runs by
   their last pair; everything up to the smallest of them is complete, is
   summed and leaves.  A frequent B id is split over the slices, so no task
   grows with the corpus.  The counted pairs, now one row per slice, are added up by
   Spark, and the maxima per B id taken over them (at most one row per A id).
3. The counts return to the slices that hold the pair.  There the runs are
   streamed once more, frame by frame, and each gives back its documents'
   sums: links at their B id's maximum, and counts.

Texts are cut where a single space stands between characters that are not
white space: no token of either side spans such a place, so a piece between
two of them is encoded once per process and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import ship, stored

#: Links held by a task before it spills them.
BUFFER = 3_000_000
#: Parts of the B ids; a run holds one part's records of a spill.
RADIX = 16
#: Records of a frame, the unit of compression and merging.
FRAME = 16_384
#: Spills that one merge takes.
SLICE = 16
#: Pieces a process remembers from one group of documents to the next, and how many it keeps when they are more.
REMEMBERED, KEPT = 300_000, 100_000
#: Documents are looked up in groups of about so many bytes.
GROUP_BYTES = 2_000_000

_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Sides:
    """Both tokenizers, the bytes of their tokens, and the pieces met last."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # byte-level vocabularies write the bytes that print as themselves, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in shown}
        byte.update({chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(shown)))})
        self.n_a = self.a.get_vocab_size()
        self.bytes_a = [
            bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
            for t in (self.a.id_to_token(i) or "" for i in range(self.n_a))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = []
        for t in pieces:
            raw = re.fullmatch("<0x([0-9A-F]{2})>", t)
            self.bytes_b.append(bytes([int(raw[1], 16)]) if raw else t.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        # ids as text, with what follows them inside and at the end of their side of a group
        self.shown_a = [np.array([f"{i}{end}" for i in range(self.n_a)], dtype="S11") for end in ",|"]
        self.shown_b = [np.array([f"{i}{end}" for i in range(len(pieces))], dtype="S11") for end in ",;"]
        # a piece can be looked up by itself if no token goes on after a space that follows other characters
        self.cuts = not any(re.search("[^▁]▁", t) for t in pieces)
        self.known: dict[str, int] = {}
        self.codes: list[bytes] = []
        self.groups: list[bytes] = []
        self.sizes, self.uses = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, links, pair codes, groups each with a ``;`` behind) per
        text; None if the bytes of its tokens are not a space and the text."""
        if not texts:
            return []
        spaced = [" " + t for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        raw = [t.encode() for t in spaced]
        if self._same(raw, a, b):
            return self._aligned(a, b)
        if len(raw) == 1:
            return [None]
        good = [self._same([r], [x], [y]) for r, x, y in zip(raw, a, b)]
        rows = iter(self._aligned([x for x, g in zip(a, good) if g], [y for y, g in zip(b, good) if g]))
        return [next(rows) if g else None for g in good]

    def _same(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> bool:
        """Whether the tokens of every text have its bytes, on both sides."""
        whole, sizes = b"".join(raw), list(map(len, raw))
        for side, known in ((a, self.bytes_a), (b, self.bytes_b)):
            parts = [b"".join(map(known.__getitem__, x)) for x in side]
            if list(map(len, parts)) != sizes or b"".join(parts) != whole:
                return False
        return True

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """All texts at once: they have the same bytes on both sides."""
        ia, ib = (np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[ia]), np.cumsum(self.size_b[ib])
        _, la, lb = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        pairs = ib[lb] * self.n_a + ia[la]
        # the groups as one text: all A tokens of a group, then its B tokens
        last_a, last_b = np.zeros(len(ia), dtype=bool), np.zeros(len(ib), dtype=bool)
        last_a[la], last_b[lb] = True, True
        before = np.concatenate([[-1], lb])[np.cumsum(last_a) - last_a] + 1  # B tokens in earlier groups
        upto = la[np.cumsum(last_b) - last_b] + 1  # A tokens in groups up to this one
        shown = np.empty(len(ia) + len(ib), dtype="S11")
        shown[np.arange(len(ia)) + before] = np.where(last_a, self.shown_a[1][ia], self.shown_a[0][ia])
        shown[np.arange(len(ib)) + upto] = np.where(last_b, self.shown_b[1][ib], self.shown_b[0][ib])
        sizes = np.concatenate([[0], np.cumsum(np.char.str_len(shown))])
        text = shown.tobytes().replace(b"\0", b"")
        ea, eb = (np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in (a, b))
        cut = sizes[ea + eb].tolist()
        links = np.searchsorted(la, ea).tolist()
        codes = pairs.tobytes()
        return [
            (len(a[i]), len(b[i]), links[i + 1] - links[i], codes[8 * links[i] : 8 * links[i + 1]], text[cut[i] : cut[i + 1]])
            for i in range(len(a))
        ]

    def _forget(self) -> None:
        """Keep the ``KEPT`` pieces that were used most."""
        names, order = list(self.known), np.argsort(-self.uses, kind="stable")[:KEPT]
        self.known = {names[i]: k for k, i in enumerate(order)}
        self.codes, self.groups = [self.codes[i] for i in order], [self.groups[i] for i in order]
        self.sizes, self.uses = self.sizes[order], self.uses[order] // 2

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, links, pair codes, groups) of every text; zeros for a
        text that has no tokens."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, old, places = self.known, len(self.known), []
        for t in texts:
            pieces = (_CUT.split(t) if self.cuts else [t]) if t else []
            places.append([known.setdefault(p, len(known)) for p in pieces])
        if len(known) > old:
            found = self.encode(list(itertools.islice(known, old, None)))
            rows = [r or (-1, 0, 0, b"", b"") for r in found]
            self.sizes = np.concatenate([self.sizes, np.array([r[:3] for r in rows], dtype=np.int64).reshape(-1, 3)])
            self.uses = np.concatenate([self.uses, np.zeros(len(rows), dtype=np.int64)])
            self.codes += [r[3] for r in rows]
            self.groups += [r[4] for r in rows]
        codes, groups = self.codes.__getitem__, self.groups.__getitem__
        for text, at in zip(texts, places):
            where = np.array(at, dtype=np.int64)
            sizes = self.sizes[where]
            np.add.at(self.uses, where, 1)
            if not at:
                yield 0, 0, 0, b"", b""
            elif sizes[:, 0].min() >= 0:
                yield (*sizes.sum(0).tolist(), b"".join(map(codes, at)), b"".join(map(groups, at))[:-1])
            else:  # some bytes differ: if not in the whole text, it is aligned as one
                whole = self.encode([text])[0]
                yield (*whole[:4], whole[4][:-1]) if whole else (0, 0, 0, b"", b"")


_SIDES: dict[tuple[str, str], Sides] = {}


def sides_of(path_a: str, path_b: str) -> Sides:
    """The tokenizers of this process: one task after another uses them."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


# ----------------------------------------------------------------------------
# Runs: frames of (pair, document, n), sorted


def _planes(x: np.ndarray) -> bytes:
    """Non-negative whole numbers below 2^32 as four planes of bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def frames(pair: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A run as compressed frames; ``pair`` (below 2^63) ascends, ``doc`` ascends within it."""
    out, pack = [], zstandard.ZstdCompressor(level=3)
    for at in range(0, len(pair), FRAME):
        p, d = pair[at : at + FRAME], doc[at : at + FRAME]
        step = np.diff(p, prepend=p[0])
        if step.max() >= 1 << 32:
            raise ValueError("a vocabulary pair this far apart does not fit a frame")
        near = np.where(step == 0, np.diff(d, prepend=0), d)
        near[0] = d[0]
        head = int(p[0]).to_bytes(8, "little") + len(p).to_bytes(4, "little")
        out.append(head + pack.compress(_planes(step) + _planes(near) + _planes(n[at : at + FRAME])))
    return out


def opened(frame: bytes, docs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, doc, n) of a frame; ``doc`` is empty if it is not asked for."""
    first, size = int.from_bytes(frame[:8], "little"), int.from_bytes(frame[8:12], "little")
    raw = zstandard.ZstdDecompressor().decompress(frame[12:], max_output_size=12 * size)
    step = _unplaned(raw[: 4 * size])
    pair = first + np.cumsum(step)
    n = _unplaned(raw[8 * size :])
    if not docs:
        return pair, n[:0], n
    near = _unplaned(raw[4 * size : 8 * size])
    total = np.cumsum(near)
    begins = step != 0
    begins[0] = True
    base = (total - near)[begins]
    return pair, total - base[np.cumsum(begins) - 1], n


def merged(runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of several runs, ascending: a k-way merge by a heap of
    the last pairs of the open frames."""
    rest = [iter(r) for r in runs]
    heap: list[tuple[int, int]] = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def refill(k: int) -> None:
        held.pop(k, None)
        frame = next(rest[k], None)
        if frame is not None:
            pair, _, n = opened(frame, docs=False)
            held[k] = pair, n
            heapq.heappush(heap, (int(pair[-1]), k))

    for k in range(len(runs)):
        refill(k)
    pairs, counts = [], []
    while heap:
        bound = heap[0][0]
        parts = []
        for k, (pair, n) in held.items():
            upto = int(np.searchsorted(pair, bound, side="right"))
            if upto:
                parts.append((pair[:upto], n[:upto]))
                held[k] = pair[upto:], n[upto:]
        both = np.concatenate([p for p, _ in parts])
        order = np.argsort(both, kind="stable")
        p, n = _summed(both[order], np.concatenate([n for _, n in parts])[order])
        pairs.append(p)
        counts.append(n)
        done = []
        while heap and heap[0][0] == bound:
            done.append(heapq.heappop(heap)[1])
        for k in done:  # the next frame may go on with the same pair
            refill(k)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate(pairs), np.concatenate(counts))


def _summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` over equal neighbours in ``pair``."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(n, first)


def radix(pair: np.ndarray, n_a: int) -> np.ndarray:
    """The part of a pair's B id."""
    return ((pair // n_a) * 2654435761 % (1 << 32)) >> 16 & (RADIX - 1)


def spilled(pairs: list[bytes], n_a: int) -> Iterator[tuple[int, list[bytes]]]:
    """(radix, frames) of a buffer: the pair codes of its documents in order."""
    sizes = np.array([len(p) // 8 for p in pairs], dtype=np.int64)
    code = np.frombuffer(b"".join(pairs), dtype=np.int64)
    if not len(code):
        return
    bits = max(1, (len(pairs) - 1).bit_length())
    rows = np.sort(code << bits | np.repeat(np.arange(len(pairs)), sizes))
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    n = np.diff(first, append=len(rows))
    pair, doc = rows[first] >> bits, rows[first] & ((1 << bits) - 1)
    part = radix(pair, n_a)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=RADIX))
    for k, end in enumerate(ends.tolist()):
        at = order[ends[k - 1] if k else 0 : end]
        if len(at):
            yield k, frames(pair[at], doc[at], n[at])


# ----------------------------------------------------------------------------
# The operator

_SPILL = "uid long, id {kind}, n_a long, n_b long, n_links long, groups string, run long, radix int, frames array<binary>"


def _spill(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """One row per document (``uid`` is set) and per run (``run`` is set: the
    ``uid`` of its first document)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(path_a, path_b)
        uid = TaskContext.get().partitionId() << 36
        buffer: list[bytes] = []
        held, since = 0, uid

        def spill() -> Iterator[pa.RecordBatch]:
            found = list(spilled(buffer, sides.n_a))
            if found:
                none = [None] * len(found)
                cols = [none] * 6 + [[since] * len(found), [k for k, _ in found], [f for _, f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            kind = b.column(0).type
            types = [pa.int64(), kind, *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary())]
            sizes = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
                part = b.slice(at, upto - at)
                found = list(sides.documents(part.column(1).to_pylist()))
                text = [hashlib.sha256(f[4]).hexdigest() if digest and f[0] else f[4].decode() for f in found]
                none = [None] * len(found)
                cols = [
                    list(range(uid, uid + len(found))), None, [f[0] for f in found], [f[1] for f in found],
                    [f[2] for f in found], text, none, none, none,
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0) if c is None else pa.array(c, t) for c, t in zip(cols, types)], names=names
                )
                for f in found:
                    buffer.append(f[3])
                    held += f[2]
                    uid += 1
                    if held >= BUFFER:
                        yield from spill()
                        buffer, held, since = [], 0, uid
                at = upto
        if held:
            yield from spill()

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = _SPILL.format(kind=src.schema["id"].dataType.simpleString())
    names = ["uid", "id", "n_a", "n_b", "n_links", "groups", "run", "radix", "frames"]
    return src.mapInArrow(rows, schema)


def link_counts(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for
    every row of ``docs``.

    ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2``, or its
    SHA-256 with ``digest``.  ``n_best`` are the links whose pair has the
    highest count of its B id (ties included), ``count_sum`` the sum of the
    counts of the row's links.  A text that is null, empty or whose tokens'
    bytes are not a space and the text has no tokens: zeros and empty
    ``groups``.  Repeated and null ids are kept, each row by its own text.
    Other columns are not read.
    """
    made = stored(_spill(docs, path_a, path_b, id_col, text_col, digest), "spills")
    runs = made.where("run IS NOT NULL").select("run", "radix", "frames")
    # a number of slices that grows with the spills; a spill has up to RADIX runs
    slices = max(1, -(-runs.select("run").distinct().count() // SLICE))
    runs = runs.withColumn("slice", F.pmod(F.xxhash64("run"), F.lit(slices)).cast("int"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        pair, n = merged(table.column("frames").to_pylist())
        size = len(pair)
        return pa.table({
            "slice": pa.array(np.full(size, key[0].as_py(), np.int32)),
            "radix": pa.array(np.full(size, key[1].as_py(), np.int32)), "pair": pair, "n": n,
        })

    ship(docs.sparkSession)
    found = runs.groupBy("slice", "radix").applyInArrow(count, "slice int, radix int, pair long, n long")
    partial = stored(found, "pairs")
    size = _vocabulary(path_a)
    totals = partial.groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.floor(F.col("pair") / size)
    best = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    told = totals.withColumn("b", b).join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = partial.select("slice", "radix", "pair").join(told, "pair")

    def give(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        pairs = right.column("pair").to_numpy()[order]
        total = right.column("total").to_numpy()[order]
        top = right.column("best").to_numpy(zero_copy_only=False)[order]
        out = []
        for base, blobs in zip(left.column("run").to_pylist(), left.column("frames")):
            sums = np.zeros((2, 0), dtype=np.int64)
            for blob in blobs.as_py():
                pair, doc, n = opened(blob)
                at = np.searchsorted(pairs, pair)
                more = int(doc.max()) + 1 - sums.shape[1]
                if more > 0:
                    sums = np.pad(sums, ((0, 0), (0, more)))
                np.add.at(sums[0], doc, n * top[at])
                np.add.at(sums[1], doc, n * total[at])
            has = np.flatnonzero(sums[1])
            out.append((has + base, sums[0][has], sums[1][has]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(["uid", "n_best", "count_sum"], cols)))

    given = (
        runs.groupBy("slice", "radix").cogroup(back.groupBy("slice", "radix"))
        .applyInArrow(give, "uid long, n_best long, count_sum long")
        .groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    rows = made.where("run IS NULL").select("uid", "id", "n_a", "n_b", "n_links", "groups").join(given, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        zero("n_best"), zero("count_sum"), "groups",
    )


def _vocabulary(path: str) -> int:
    import tokenizers

    return tokenizers.Tokenizer.from_file(path).get_vocab_size()
