"""Token alignment counts against the libraries and plain dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from redress.llm import queries, spill_align

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sides():
    return spill_align.Sides(queries.tokenizer_path(A), queries.tokenizer_path(B))


def plain(sides, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    rows, total = [], Counter()
    for t in texts:
        a = sides.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sides.b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(sides.bytes_a[i] for i in a) != whole or b"".join(sides.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends = lambda ids, size: np.cumsum([len(size[i]) for i in ids]).tolist() if ids else []
        ea, eb = ends(a, sides.bytes_a), ends(b, sides.bytes_b)
        both = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for e in both:
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((b[j2 - 1], a[i2 - 1]))
            i, j = i2, j2
        total.update(links)
        rows.append((len(a), len(b), links, ";".join(groups)))
    most = {}
    for (b, _), n in total.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (na, nb, len(links), len(links), sum(total[x] == most[x[0]] for x in links), sum(total[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if na else "")
        for na, nb, links, g in rows
    ]


ODD = [
    None, "", " ", "  a  b ", "a▁b c", "x <|endoftext|> y <s> </s> <0x41>", "tab\there\nand\r\nlines \n end", "日本語 テキスト 混在 abc",
    "emoji 👩‍👩‍👧  nbsp 　wide", "it's we'll 123 4567890 !!!???", "the the the the " * 50, "a\x1c \x1db", "z" * 9000, "é" * 300 + " " * 70 + "ü",
    " \n lead", "trail \n ", "﻿bom", "\x00 nul \x01",
]


def test_query_equals_libraries(spark, sides, tmp_path):
    rnd = random.Random(2)
    words = ["the", "of", "Straße", "naïve", "foo,bar", "x=1;", "  ", "\n", "ungewöhnlich", "1999", "привет"]
    texts = ODD + [" ".join(rnd.choices(words, k=rnd.randrange(1, 60))) for _ in range(120)] + ["some ab▁cd words"]
    rows = [(i if i % 7 else i // 2, t) for i, t in enumerate(texts)] + [(None, "the of the"), (3, "the")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spill_align(spark, str(tmp_path)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ).collect()
    want = [(r[0], *x) for r, x in zip(rows, plain(sides, [t for _, t in rows]))]
    key = lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 100 and sum(r[1] == 0 for r in want) == 4  # null, empty, two with U+2581


def test_spills_slices_and_small_frames(spark, sides, monkeypatch):
    """Many spills, several frames a run and several slices give the same counts."""
    monkeypatch.setattr(spill_align, "FRAME", 5)
    rnd = random.Random(4)
    docs = [rnd.choices("abcdefgh", k=40) for _ in range(9)]
    pairs = [np.array([ord(x) % 3 * 100 + ord(x) for x in d], dtype=np.int64).tobytes() for d in docs]
    runs = [dict(spill_align.spilled(pairs[i : i + 3], 100)) for i in (0, 3, 6)]
    total = Counter(int(x) for p in pairs for x in np.frombuffer(p, np.int64))
    seen = Counter()
    for k in range(spill_align.RADIX):
        pair, n = spill_align.merged([r[k] for r in runs if k in r])
        assert (np.diff(pair) > 0).all()
        seen.update(dict(zip(pair.tolist(), n.tolist())))
    assert seen == total
    first = runs[0]
    rows = Counter()
    for blobs in first.values():
        for blob in blobs:
            for p, d, n in zip(*(x.tolist() for x in spill_align.opened(blob))):
                rows[(d, p)] += n
    assert rows == Counter((d, int(x)) for d in range(3) for x in np.frombuffer(pairs[d], np.int64))


def test_odd_documents(spark, sides, odd_docs, no_docs):
    got = spill_align.link_counts(odd_docs, queries.tokenizer_path(A), queries.tokenizer_path(B)).collect()
    assert len(got) == odd_docs.count()
    assert all((r["n_a"] > 0) == (r["groups"] != "") for r in got)
    assert next(r for r in got if r["doc_id"] == 7)["n_a"] > 30_000
    assert spill_align.link_counts(no_docs, queries.tokenizer_path(A), queries.tokenizer_path(B)).collect() == []
