"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into segments wherever no vocabulary piece spans two
neighbouring characters (in front of a word's space mark, for instance), so
no merge can cross a cut and a segment always has the same ids.  The
distinct segments of a batch are encoded together as flat arrays: in each
round every word finds its smallest pair rank by a segmented minimum, merges
the leftmost pairs of that rank at once, and is compacted; words without a
pair are done.  Several merges of one word in one round are made only where
no merge opens a pair of equal or better rank, which the sequential order
would take first; else the word merges its leftmost pair alone.

Spark deals the texts out; a task holds one Arrow batch and a bounded cache
of segments.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import ship

MARK = "▁"  # stands for a space inside pieces
#: Segments that a task remembers, and symbols from which a segment is merged with a heap.
CACHE, LONG = 500_000, 512
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, ranks and pair table of a BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece  # reads the file; merges and lookups are done here

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        special = [m.is_unknown(i) or m.is_control(i) or m.is_unused(i) for i in range(n)]
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not special[i]:
                self.ids[p] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        self.special = {i for i in range(n) if special[i]} | set(self.byte_of)
        self.unknown = m.unk_id()
        self.names = [str(i) for i in range(n)]
        scores = np.array([m.get_score(i) for i in range(n)])
        # equal scores have equal ranks: the leftmost pair decides among them
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self._tables()

    def _tables(self) -> None:
        joined, inside = {}, set()
        for p, i in self.ids.items():
            inside.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    joined[(a << 20) | b] = i
                # a first or last character that is no piece itself can still be merged
        self.inside = inside
        self.char_ids = {}
        for p in self.ids:
            for c in p:
                self.char_ids.setdefault(c, self.ids.get(c))
        extra = {}
        size = len(self.pieces)
        for c, i in self.char_ids.items():
            if i is None:  # only occurs inside pieces: a symbol of its own number
                extra[c] = size + len(extra)
        self.char_ids.update(extra)
        self.extra = {i: c for c, i in extra.items()}
        for p, i in self.ids.items() if extra else []:
            for k in (1, len(p) - 1):
                a, b = p[:k], p[k:]
                x, y = self.ids.get(a, extra.get(a)), self.ids.get(b, extra.get(b))
                if a and b and x is not None and y is not None:
                    joined[(x << 20) | y] = i
        keys = np.array(sorted(joined), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.array([joined[k] for k in keys.tolist()] + [0], np.int32)
        self.joined = joined
        # characters between which a piece can reach: cut everywhere else
        after: dict[str, str] = {}
        for a, b in sorted(inside):
            after[a] = after.get(a, "") + b
        self.after = {a: frozenset(b) for a, b in after.items()}
        # the fast cut for ordinary text: before a mark that follows another character
        self.plain = not any(a != MARK and b == MARK for a, b in inside)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; _NONE where they do not merge."""
        key = (left.astype(np.int64) << 20) | right  # negative if a symbol is
        at = np.searchsorted(self.keys, key)
        new = self.merged[at]
        return np.where(self.keys[at] == key, self.rank[new], _NONE), new

    def symbols(self, word: str) -> list[int]:
        """A symbol per character; unknown characters are -1."""
        return list(map(self.char_ids.get, word, repeat(-1)))


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def cuts(v: Vocabulary, text: str) -> list[str]:
    """Segments of a text with marks: cut where no piece reaches across."""
    return _WORDS.findall(text) if v.plain else _fine(v, text)


def _fine(v: Vocabulary, word: str) -> list[str]:
    """Segments of one word, cut between characters that no piece holds side by side."""
    out, start = [], 0
    for k in range(1, len(word)):
        if (word[k - 1], word[k]) not in v.inside:
            out.append(word[start:k])
            start = k
    out.append(word[start:])
    return out


def merge_words(v: Vocabulary, words: list[list[int]]) -> list[list[int]]:
    """The symbols of every word after all merges."""
    out: list[list[int]] = [[] for _ in words]
    short = []
    for k, w in enumerate(words):
        if len(w) < 2:
            out[k] = w
        elif len(w) > LONG:
            out[k] = _merge_long(v, w)
        else:
            short.append(k)
    if not short:
        return out
    lengths = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
    sym = np.fromiter(chain.from_iterable(words[k] for k in short), np.int32, int(lengths.sum()))
    word = np.array(short, np.int64)  # number of each word still in work
    # rank and merged id of the pair that starts at each symbol; none at the end of a word
    rank, new = v.pair(sym, np.append(sym[1:], np.int32(-1)))
    rank[np.cumsum(lengths) - 1] = _NONE
    while True:
        first = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(rank, first)
        done = least == _NONE
        if done.any():
            ended = np.repeat(done, lengths)
            flat, at = sym[ended].tolist(), 0
            for k, n in zip(word[done].tolist(), lengths[done].tolist()):
                out[k] = flat[at : at + n]
                at += n
            go, stay = ~ended, ~done
            sym, rank, new = sym[go], rank[go], new[go]
            word, lengths, least = word[stay], lengths[stay], least[stay]
            if not len(word):
                return out
            first = np.cumsum(lengths) - lengths
        hit = np.flatnonzero(rank == np.repeat(least, lengths))
        own = np.searchsorted(first, hit, side="right") - 1
        lead = np.ones(len(hit), bool)
        lead[1:] = own[1:] != own[:-1]
        if not lead.all():
            # leftmost pairs that do not overlap: alternate ones of each unbroken row of hits
            begins = np.ones(len(hit), bool)
            begins[1:] = np.diff(hit) != 1
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            even = (np.arange(len(hit)) - run) % 2 == 0
            hit, own, lead = hit[even], own[even], lead[even]
            # several merges in a word: allowed if none opens a pair of equal or better rank
            made = new[hit]
            here = sym.copy()
            here[hit + 1] = made  # what a merge further right sees as its left neighbour
            left = np.where(hit > first[own], here[np.maximum(hit - 1, 0)], -1)
            end = first[own] + lengths[own]
            right = np.where(hit + 2 < end, sym[np.minimum(hit + 2, len(sym) - 1)], -1)
            risky = np.minimum(v.pair(left, made)[0], v.pair(made, right)[0]) <= least[own]
            bad = np.zeros(len(word), bool)
            bad[own[risky]] = True
            ok = lead | ~bad[own]
            hit, own = hit[ok], own[ok]
        sym[hit] = new[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        ends = hit + 1 == (first + lengths - 1)[own]
        sym, rank, new = sym[keep], rank[keep], new[keep]
        lengths = lengths - np.bincount(own, minlength=len(word))
        first = np.cumsum(lengths) - lengths
        at = hit - np.arange(len(hit))  # where the merged symbols now are
        after = np.where(ends, -1, sym[np.minimum(at + 1, len(sym) - 1)])
        rank[at], new[at] = v.pair(sym[at], after)
        back = at[at > first[own]]
        rank[back - 1], new[back - 1] = v.pair(sym[back - 1], sym[back])


def _merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same merges for one long word, smallest (rank, place) first, in
    n log n steps."""
    sym = list(symbols)
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]

    def offer(a: int) -> None:
        b = after[a]
        if b >= 0 and sym[a] >= 0 and sym[b] >= 0 and (new := v.joined.get((sym[a] << 20) | sym[b])) is not None:
            heapq.heappush(heap, (int(v.rank[new]), a, sym[a], sym[b], new))

    heap: list = []
    for a in range(n - 1):
        offer(a)
    gone = bytearray(n)
    while heap:
        _, a, x, y, new = heapq.heappop(heap)
        b = after[a]
        if gone[a] or b < 0 or sym[a] != x or sym[b] != y:
            continue
        sym[a], gone[b] = new, 1
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    return [s for s, g in zip(sym, gone) if not g]


class Codec:
    """Encodes and decodes texts with a bounded cache of segments."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.mark = self.v.ids[MARK]
        # two tables of plain strings: the garbage collector need not walk them
        self.cache: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _ids(self, segment: str, merged: list[int]) -> list[int]:
        """Ids of a merged segment: pieces, or the bytes of unknown characters."""
        v = self.v
        if min(merged) >= 0 and max(merged) < len(v.pieces):
            return merged
        out, at = [], 0
        for s in merged:
            if 0 <= s < len(v.pieces):
                out.append(s)
                at += len(v.pieces[s])
            else:
                out.extend(v.byte_ids[list(segment[at].encode("utf-8"))].tolist())
                at += 1
        return out

    def merged(self, segments: list[str]) -> list[list[int]]:
        """The ids of every segment, encoded together; long ones in parts."""
        parts = [_fine(self.v, s) if len(s) > 64 else [s] for s in segments]
        flat = [p for ps in parts for p in ps]
        ids = map(self._ids, flat, merge_words(self.v, list(map(self.v.symbols, flat))))
        return [next(ids) if len(ps) == 1 else [i for _ in ps for i in next(ids)] for ps in parts]

    def segments(self, text: str) -> list[str]:
        """Segments of a text, with the mark that is put in front of it."""
        return cuts(self.v, MARK + text.replace(" ", MARK)) if text else []

    def learn(self, cut: list[list[str]]) -> None:
        """Have all these segments in the cache, forgetting all others if it is full."""
        needed = set().union(*cut)
        new = [s for s in needed if s not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache, self.texts = ({s: x[s] for s in needed if s in x} for x in (self.cache, self.texts))
        names, mark = self.v.names, self.mark
        for s, ids in zip(new, self.merged(new)):
            self.cache[s] = ",".join([names[i] for i in ids])
            # decoded behind a mark, so that nothing of the segment is dropped
            self.texts[s] = self.decode([mark, *ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text; an empty text has none."""
        cut = [self.segments(t) for t in texts]
        new = list(set().union(*cut))
        ids = dict(zip(new, self.merged(new)))
        return [[i for s in segs for i in ids[s]] for segs in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces with marks as spaces, runs of bytes as UTF-8
        (a byte that fits no character: U+FFFD), the mark in front dropped.
        Control ids have no text, the unknown id has the library's sign."""
        v = self.v
        if v.special.isdisjoint(ids):
            return "".join([v.pieces[i] for i in ids])[1 if ids and v.pieces[ids[0]][0] == MARK else 0 :].replace(MARK, " ")
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in v.byte_of:
                raw.append(v.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i == v.unknown:
                out.append(" \u2047 ")
            elif i >= 0 and i not in v.special:
                out.append(v.pieces[i])
        text = "".join(out)
        # a mark is dropped only as the first piece's, which control ids do not hide
        return text.removeprefix(MARK).replace(MARK, " ")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a model file, one per Python worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def _digests(c: Codec, texts: list[str]) -> list[tuple[int, str, str]]:
    """(tokens, SHA-256 of the ids, SHA-256 of the decoded text) of texts."""
    cut = [c.segments(t) for t in texts]
    c.learn(cut)
    out = []
    for segs in cut:
        ids = ",".join([c.cache[s] for s in segs])
        text = "".join([c.texts[s] for s in segs])[1:]  # without the mark in front
        out.append((
            ids.count(",") + 1 if segs else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
        ))
    return out


def encode_rows(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) for every row: the ids of the whole text, without begin
    and end.  Null and empty texts have no ids.  Other columns are not read.
    ``model_file`` must exist on every executor."""
    return _mapped(docs, id_col, text_col, "ids array<int>",
                   lambda texts: [pa.array(codec(model_file).encode(texts), pa.list_(pa.int32()))])


def decode_rows(ids: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for every row of ids; null ids give an empty text."""

    def run(batches):
        for b in batches:
            texts = [codec(model_file).decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    ship(ids.sparkSession)
    src = ids.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest_rows(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row, encoded
    and decoded segment by segment, without building the lists of ids."""

    def work(texts: list[str]) -> list[pa.Array]:
        rows = _digests(codec(model_file), texts)
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _mapped(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, work) -> DataFrame:
    names = ["id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):  # about 4 MB of text at once
                end, held = at, 0
                while end < len(texts) and (end == at or held < 1 << 22):
                    held += len(texts[end])
                    end += 1
                arrays = work(texts[at:end])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *arrays], names=names)
                at = end

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
