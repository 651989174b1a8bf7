"""Periodic runs against plain comparison of words at every distance."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from redress.llm import periodic, queries


def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q))
            if size >= max(least, 2 * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4),
    st.integers(1, 9), st.integers(0, 30), st.sampled_from([1, 2, 5, 12]),
)
def test_runs_equal_plain_comparison(texts, period, since, least):
    made = [t[:since] + [t[since + (i - since) % period] for i in range(since, len(t))] if since + period < len(t) else t for t in texts]
    assert periodic.runs_of(made, least) == [plain_runs(t, least) for t in made]


def test_long_periodic_and_random_texts():
    rnd = random.Random(3)
    same, tail = [b"x"] * 30_000, [str(rnd.random()).encode() for _ in range(9_000)]
    for i in range(2_000, 9_000):
        tail[i] = tail[2_000 + (i - 2_000) % 3_000]
    assert periodic.runs_of([same, tail, []]) == [[(0, 30_000, 1)], [(2_000, 7_000, 3_000)], []]
    two = [rnd.choice([b"0", b"1"]) for _ in range(600)]
    assert periodic.runs_of([two]) == [plain_runs(two)]


def contract(doc_id, text):
    """The row of op13 for one document, written out from its contract."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_equals_contract(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ab ab\x0bab " * 9 + "x" * 70_000)]
    for k in range(10, 260):
        w = [rnd.choice("abcdefgh") + rnd.choice(["", "é", "日本"]) for _ in range(rnd.randrange(0, 90))]
        if k % 3 == 0:
            w = w[:30] + w[10:30] * rnd.randrange(1, 4) + w[30:]
        rows.append((k, rnd.choice([" ", "\n", "  "]).join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic(spark, str(tmp_path)).collect()
    want = [contract(*r) for r in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert sum(r[1] > 0 for r in want) > 60


def test_odd_documents(odd_docs, no_docs):
    got = periodic.find_runs(odd_docs).collect()
    assert len(got) == odd_docs.count()
    long = next(r for r in got if r["doc_id"] == 7)
    assert [tuple(r) for r in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "wordé"
    assert [r["n_words"] for r in got if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]
    assert periodic.find_runs(no_docs).collect() == []
