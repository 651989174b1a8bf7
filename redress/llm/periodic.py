"""Periodic runs of words, found with a suffix automaton and link-cut access.

A run is a stretch of words with smallest period q (words q apart are equal)
of at least ``min_length`` words and 2q that no neighbouring word extends
keeping the period.  For each word the tree of suffix links is accessed from
the state of the text so far: the link-cut access walks the preferred paths up
to the root, each of which ends at one position only, the last one where its
strings stood, and recolours them with the new end.  A path segment with last
end e whose longest string has l words says that exactly l words before e and
before the new end i agree, and that no shorter distance repeats them.  With
d = i - e <= l that is a square: a stretch of period d that starts at
i - l - d + 1 and cannot begin earlier.  The last i seen for a (start, d) is
the end of its run.

Splay trees hold the preferred paths, so n words cost O(n log n) steps.  The
automaton only sees blocks of a text: stretches outside which no run can
have a word, found exactly with array operations over many texts at once: in any run words q apart agree at least ceil(min_length / 2)
times in a row, so each of its words lies in a sequence of that many words
that comes again at a distance of at most half the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import ship

#: Texts are searched for blocks in groups of about so many words.
GROUP_WORDS = 400_000
#: Blocks are narrowed at most so many times; each round only drops what cannot hold a run.
ROUNDS = 12


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """(longest, link, prefix): per state the length of its longest string
    and its suffix link, and the state of every prefix.  State 1 is the empty
    string, 0 is none."""
    longest, link, edges, prefix = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for w in words:
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(1)
        edges.append({})
        prefix.append(new)
        p = last
        while p and w not in edges[p]:
            edges[p][w] = new
            p = link[p]
        if p:
            q = edges[p][w]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                split = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                edges.append(edges[q].copy())
                link[q] = link[new] = split
                while p and edges[p].get(w) == q:
                    edges[p][w] = split
                    p = link[p]
        last = new
    return longest, link, prefix


def squares(words: list) -> dict[tuple[int, int], int]:
    """{(start, period): last position} of every maximal stretch that holds
    its smallest period at least twice."""
    longest, up, prefix = automaton(words)
    up = [0 if p == 1 else p for p in up]  # the empty string repeats nothing
    left, right, last = [0] * len(up), [0] * len(up), [-1] * len(up)
    found: dict[tuple[int, int], int] = {}
    for i, x in enumerate(prefix):
        below = 0
        while x:
            p = up[x]
            while p and (left[p] == x or right[p] == x):  # splay x to the root of its path
                g = up[p]
                inner = g and (left[g] == p or right[g] == p)
                if inner:
                    if (left[g] == p) == (left[p] == x):
                        first, second = p, x
                    else:
                        first, second = x, x
                else:
                    first, second = x, 0
                    last[x] = last[p]  # the colour of a path stays at its root
                for r in (first, second):
                    if not r:
                        continue
                    a = up[r]
                    b = up[a]
                    if left[a] == r:
                        c = left[a] = right[r]
                        right[r] = a
                    else:
                        c = right[a] = left[r]
                        left[r] = a
                    if c:
                        up[c] = a
                    up[a] = r
                    up[r] = b
                    if b:
                        if left[b] == a:
                            left[b] = r
                        elif right[b] == a:
                            right[b] = r
                        else:
                            last[r] = last[a]
                    else:
                        last[r] = last[a]
                p = up[x]
            e = last[x]
            if e >= 0:
                d, n = i - e, longest[x]
                if d <= n:
                    found[(e - n + 1, d)] = i
                if right[x]:
                    last[right[x]] = e  # cut off: what lies deeper was not seen again
            right[x] = below
            below = x
            x = up[x]
        last[below] = i
    return found


def blocks(hashes: np.ndarray, text: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that may hold a run.  ``hashes``
    are those of the words of several texts, ``text`` the number of each
    word's text.  Different words of one hash only make a block larger."""
    n, gram = len(hashes), (min_length + 1) // 2
    if n < max(min_length, 2):
        return []
    m = n - gram + 1
    whole = text[:m] == text[gram - 1 :]
    key = text[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        key = (key ^ hashes[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    bits = np.uint64(m.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = np.arange(m, dtype=np.uint64)
    rows = np.sort(((key & ~low) | at)[whole])  # equal sequences side by side, in order
    place = (rows & low).astype(np.int64)
    same = (rows[1:] & ~low) == (rows[:-1] & ~low)
    a, b = place[:-1][same], place[1:][same]  # a sequence and where it comes next
    out: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, a + gram, -1)
        np.add.at(edge, b, 1)
        np.add.at(edge, b + gram, -1)
        covered = np.cumsum(edge)[:n] > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1] | (text[1:] != text[:-1])
        number = np.cumsum(starts) - 1
        number[~covered] = -1
        size = np.bincount(number[covered], minlength=1)
        keep = (number[a] == number[b]) & (2 * (b - a) <= size[number[a]]) & (size[number[a]] >= min_length)
        if keep.all():
            first = np.flatnonzero(starts)
            out = [(int(f), int(f + s)) for f, s in zip(first, size) if s >= min_length]
            break
        a, b = a[keep], b[keep]
        first = np.flatnonzero(starts)
        out = [(int(f), int(f + s)) for f, s in zip(first, size) if s >= min_length]
        if not len(a):
            return []
    return out


def runs_of(texts: list[list[bytes]], min_length: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = [w for t in texts for w in t]
    hashes = np.array(list(map(hash, flat)), dtype=np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, end in blocks(hashes, owner, min_length):
        codes: dict[bytes, int] = {}
        t = int(owner[first])
        shift = first - int(begin[t])
        for (start, q), i in squares([codes.setdefault(w, len(codes)) for w in flat[first:end]]).items():
            if i - start + 1 >= max(min_length, 2 * q):
                out[t].append((start + shift, i - start + 1, q))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, space-joined."""
    if runs:
        stays = np.ones(len(words), dtype=bool)
        for start, length, q in runs:
            stays[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of ``docs``.

    Words are split at U+0020 and U+0009 to U+000D.  ``runs`` are (start,
    length, period) by start, then period, in words from 0; ``collapsed`` is
    the text without the repeats, its words joined by one space.  Null, empty
    and blank texts have no words, no runs and an empty ``collapsed``.
    Repeated ids and null ids are kept as they are, each row by its own text.
    Other columns are not read.
    """

    def finish(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, min_length)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        flat = np.array([x for r in found for x in r], dtype=np.int64).reshape(-1, 3)
        entries = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), entries),
                pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string()),
            ],
            names=[id_col, "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, since = [], 0, 0
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                texts.append((t.as_py() or b"").split())
                held += len(texts[-1])
                if held >= GROUP_WORDS or i + 1 == b.num_rows:
                    yield finish(b.column(0).slice(since, len(texts)), texts)
                    texts, held, since = [], 0, i + 1

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return src.mapInArrow(run, schema)
