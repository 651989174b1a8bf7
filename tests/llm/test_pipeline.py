"""Packing, and the pipeline stage by stage."""

import re

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from test_near import plain_fingerprint

import corpus_pipeline
from redress.llm import packing
from redress.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def brute_pack(sizes, capacities, overhead):
    """The same rules, written plainly."""
    best = None
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))

    def cheapest(rest):
        found = []
        for c in sorted(capacities):
            if c >= sizes[rest[0]]:
                used = 0
                for k in rest:
                    used += sizes[k] if used + sizes[k] <= c else 0
                found.append(((min(x for x in capacities if x >= used) + overhead) / used, c))
        return min(found)[1]

    for largest in (*sorted(capacities), None):
        bins = []
        for place, k in enumerate(order):
            fits = [(b["cap"] - b["used"], i) for i, b in enumerate(bins) if b["cap"] - b["used"] >= sizes[k]]
            if fits:
                b = bins[min(fits)[1]]
            else:
                cap = cheapest(order[place:]) if largest is None else min(c for c in capacities if c >= max(sizes[k], largest))
                bins.append(b := {"cap": cap, "used": 0, "items": []})
            b["used"] += sizes[k]
            b["items"].append(k)
        caps = [min(c for c in capacities if c >= b["used"]) for b in bins]
        cost = sum(caps) + overhead * len(caps)
        if best is None or cost < best[0]:
            best = (cost, {k: (i, caps[i]) for i, b in enumerate(bins) for k in b["items"]})
    return best


def test_best_fit_equals_plain_version():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 30, 200):
        sizes = rng.integers(1, 65, size=n)
        got = packing.pack(sizes, (16, 32, 64), 4)
        want = brute_pack(sizes.tolist(), (16, 32, 64), 4)[1]
        assert [(b, c) for b, c in zip(got["bin"], got["capacity"])] == [want[k] for k in range(n)]


def test_every_opening_chooses_its_length():
    # 40 and 24 fill 64, 30 is cheapest in 32: two lengths in one packing
    assert packing._cheapest([40, 30, 24], 0, (32, 64), 1) == 64
    assert packing._cheapest([40, 30], 1, (32, 64), 1) == 32
    rng = np.random.default_rng(5)
    for _ in range(20):  # never worse than one largest length for all
        sizes = rng.integers(1, 65, size=150)
        got = packing.pack(sizes, (16, 32, 64), 4).drop_duplicates("bin")["capacity"]
        for largest in (16, 32, 64):
            ordered = sorted(sizes.tolist(), reverse=True)
            _, filled = packing._best_fit(ordered, (16, 32, 64), 4, largest)
            assert (got + 4).sum() <= sum(min(c for c in (16, 32, 64) if c >= f) + 4 for f in filled)


def test_token_counts_equal_the_library(spark, odd_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    odd = spark.createDataFrame([(-1, "a▁b  c \n d"), (-2, " "), (-3, "x" * 5000 + " y")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    want = sorted(((r.doc_id, len(sp.encode(r.text or ""))) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.n_tokens) for r in packing.count_tokens(docs, tokenizer_path()).collect()), key=str)
    assert got == want


def test_downsizing_and_the_joint_choice():
    # one short item: its bin is cut down whatever was opened
    assert packing.pack(np.array([10]), (16, 64), 4)["capacity"].tolist() == [16]
    # four quarters share a long bin: one overhead instead of four
    assert packing.pack(np.array([16] * 4), (16, 64), 4)["capacity"].tolist() == [64] * 4
    # with no overhead and no waste either way the shorter bins stay
    assert packing.pack(np.array([16] * 4), (16, 64), 0)["capacity"].tolist() == [16] * 4


def check_bins(out: pd.DataFrame, capacities):
    placed = out[out["bin_id"].notna()]
    for _, b in placed.groupby("bin_id"):
        assert b["capacity"].nunique() == 1
        cap = b["capacity"].iloc[0]
        used = b["n_tokens"].sum()
        assert used <= cap == min(c for c in capacities if c >= used)
        b = b.sort_values("start")
        assert (b["start"].to_numpy() == np.concatenate([[0], b["n_tokens"].cumsum()[:-1]])).all()


def test_pack_rows(spark, odd_docs, no_docs):
    got = packing.pack_rows(odd_docs, packing.count_words(odd_docs["text"]), capacities=(8, 64), shard_rows=5).toPandas()
    check_bins(got, (8, 64))
    whole = got.groupby("doc_id", dropna=False)["n_tokens"].sum()
    assert whole[7] == 30_000 and whole[2] == 15 and whole[3] == 0
    assert len(got[got.doc_id == 1]) == 2 and got[got.doc_id == 3]["bin_id"].isna().all()
    assert got["doc_id"].isna().sum() == 2
    assert (got[got.doc_id == 7]["n_tokens"] <= 64).all()
    assert packing.pack_rows(no_docs, packing.count_words(no_docs["text"])).collect() == []


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((f(spark, docs, SF)).toPandas(), schema=f(spark, docs, SF).schema)
        out.append(docs.toPandas())
    return out


def test_stage_columns_and_steps(stages):
    docs, good, lines, unique, clean, packed = stages
    for x in (good, lines, unique, clean):
        assert list(x.columns) == list(docs.columns)
    assert set(good.doc_id) < set(docs.doc_id) and set(lines.doc_id) == set(good.doc_id)
    assert set(unique.doc_id) < set(lines.doc_id) and set(clean.doc_id) == set(unique.doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["quality"]
    kept = labels.index.isin(good.doc_id)
    assert ((labels == 1) & ~kept).sum() <= 0.03 * (labels == 1).sum()
    assert ((labels == 0) & kept).sum() <= 0.2 * (labels == 0).sum()


def test_near_duplicate_stage_equals_plain_version(stages):
    lines, unique = stages[2], stages[3]
    fps = [plain_fingerprint(t) for t in lines.text]
    ids = lines.doc_id.tolist()
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)), key=lambda k: ids[k])
                up[y] = x
    assert set(unique.doc_id) == {ids[find(k)] for k in range(len(ids))}


def test_no_pattern_survives_the_scan(stages):
    unique, clean = stages[3].set_index("doc_id").text, stages[4].set_index("doc_id").text
    for i, t in clean.items():
        assert not re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", t)
        if not re.search(r"[0-9a-f]{24}|AKIA|(?i:password|passwd|secret|token|api_?key)|\S{16}", unique[i]):
            assert t == unique[i]


def test_everything_is_packed(stages):
    clean, packed = stages[4], stages[5]
    check_bins(packed, packing.CAPACITIES)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    tokens = clean.set_index("doc_id").text.map(lambda t: len(sp.encode(t)))
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == tokens.to_dict()


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            out.collect()
            if f is not corpus_pipeline.pack:
                assert out.columns == docs.columns


INTERNAL = ["_id", "_h", "_n", "_did", "_dh", "_dn", "_drop", "_k", "_c", "_first", "_hot", "_base", "_masked", "_spans", "__k"]


@pytest.mark.parametrize("few", [0, 500_000])
def test_stages_carry_columns_of_any_name(spark, monkeypatch, few):
    from redress.llm import line_spread, simhash

    monkeypatch.setattr(line_spread, "FEW_DECISIONS", few)
    monkeypatch.setattr(simhash, "FEW_DECISIONS", few)
    line = "this very line stands on a lot of different sites"
    secret = "password = hunter2hunter2hunter2"
    rows = [(i, f"{line}\nown text number {i} has quite different words {i * 7919} in it {secret}", "en", f"s{i}", 9) for i in range(8)]
    rows += [(100 + i, rows[0][1], "en", "s0", 9) for i in range(3)]
    extra = [f"x{k}" for k in range(len(INTERNAL))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in INTERNAL)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "").collect()
        assert all([r[n] for n in INTERNAL] == extra for r in out), name
        assert len(out) == (8 if name == "near_duplicates" else 11), name
        texts = [r["text"] for r in out]
        if name == "line_dedup":
            assert sum(line in t for t in texts) == 1
        if name == "secret_scan":
            assert not any("hunter2" in t for t in texts)
