"""SimHash, pivot index and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from redress.llm import pivots, simhash
from redress.llm.components import connected_components


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(3)
    n = 60
    pairs = {
        "chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n)], "none": [],
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(40)],
    }[shape]
    edges = spark.createDataFrame(pairs + [(None, 1)] * bool(pairs), "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = roots(n, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_plain_version():
    rnd = random.Random(5)
    texts = [None, "", " \t", "One", "Ää B\x1cc d e", "a b c", "a b c a b c"]
    texts += [" ".join(rnd.choice("abcdeÉf") * rnd.randrange(1, 4) for _ in range(rnd.randrange(40))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_links_equal_brute_force(spark):
    rnd = random.Random(7)
    seeds = [rnd.getrandbits(64) for _ in range(25)]
    fps = set(seeds)
    for s in seeds:  # clouds around each seed, with chains
        at = s
        for _ in range(12):
            for _ in range(rnd.randrange(1, 5)):
                at ^= 1 << rnd.randrange(64)
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    edges = [(r.u, r.v) for r in simhash.links(classes).collect()]
    for a, b in edges:
        assert bin(fps[a] ^ fps[b]).count("1") <= 3
    want = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert roots(len(fps), edges) == roots(len(fps), want)


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[1] + by[2]} == {1}
    assert {r.component_id for r in by[3] + by[4] + by[5]} == {3} and by[3][0].fp == 0
    assert len(by[None]) == 2 and len(by[9]) == 2
    assert simhash.near_duplicates(no_docs).collect() == []


def test_pivot_index(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [c + rng.normal(scale=0.18, size=16) for c in centres for _ in range(12)]
    rows += [rows[0]] * 5 + list(rng.normal(size=(100, 16)))
    x = np.array(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (2048, 16):  # one block, and many block pairs
        got = {r.vec_id: r for r in pivots.near_duplicates(df, block=block).collect()}
        links = np.array([got[i].n_links for i in range(len(x))])
        assert (links <= near.sum(1)).all()
        assert links.sum() >= 0.9 * near.sum()
        if (links == near.sum(1)).all():
            want = roots(len(x), list(zip(*np.nonzero(near))))
            assert [got[i].component_id for i in range(len(x))] == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pivot_index_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [], 0),
        (7, [float("nan"), 1.0], 0), (8, [None, 1.0], 0), (9, [float("inf"), 1.0], 0), (None, [1.0, 0.0], 0),
        (10, [1e300, 0.0], 0), (11, [0.0, -1.0], 0), (1, [1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = {}
    for r in pivots.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] * 2 and got[2] == [(3, 1, False)] and got[10] == [(3, 1, False)]
    for i in (3, 4, 5, 6, 7, 8, 9, 11):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, False)]
    assert pivots.near_duplicates(df.limit(0)).collect() == []
