import math
import os
import re
import tempfile

import numpy as np
import pytest
from helpers import SF01
from pyspark.sql import functions as F

from redress.operators import narratives
from redress.sources.narratives import (
    distinct_texts, documents_corpus, read_narratives_csv, read_narratives_split, store_narratives,
)


@pytest.fixture(scope="module")
def split(spark):
    corpus = documents_corpus(spark, SF01, distinct=True)
    held_out = F.abs(F.xxhash64("doc_id")) % 5 == 0  # evaluation split, tests only
    return corpus.where(~held_out), corpus.where(held_out)


@pytest.fixture(scope="module")
def model(spark, split):
    train, _ = split
    path = os.path.join(tempfile.mkdtemp(prefix="redress-model-"), "nb")
    narratives.save_model(narratives.train_response_model(train, "text", "lang"), path)
    return narratives.load_model(spark, path)


def test_more_than_one_class_and_beats_majority(model, split):
    _, test = split
    scored = narratives.score_narratives(model, test, "text", "doc_id").join(test, "doc_id")
    pdf = scored.select("prediction", "lang", "probability", "probability_pct").toPandas()
    assert pdf["prediction"].nunique() > 1
    accuracy = (pdf["prediction"] == pdf["lang"]).mean()
    majority = pdf["lang"].value_counts(normalize=True).max()
    assert accuracy > majority
    assert ((pdf["probability"] > 0) & (pdf["probability"] <= 1)).all()
    assert all(p == f"{v * 100:.2f}" or abs(float(p) - v * 100) <= 0.005 + 1e-9
               for p, v in zip(pdf["probability_pct"], pdf["probability"]))


def _words(text):
    return re.findall(r"\w{2,}", text.lower())


def test_model_and_scores_follow_the_formula(spark):
    rows = [(1, "red red blue", "a"), (2, "blue green", "a"), (3, "green green_1 x", "b"), (4, "red", "c"), (5, None, "a"), (6, "z z", None), (7, "!", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = narratives.train_response_model(df, "text", "lang")
    train = [(t, k) for _, t, k in rows if t is not None and k is not None]
    labels = sorted({k for _, k in train})
    vocabulary = sorted({w for t, _ in train for w in _words(t)})
    counts = np.array([[sum(_words(t).count(w) for t, k in train if k == lab) for w in vocabulary] for lab in labels])
    rest = counts.sum(0) - counts + 1.0
    weights = -np.log(rest / rest.sum(1, keepdims=True))
    got = {(r.label, r.term): r.weight for r in m.weights.collect()}
    assert set(got) == {(k, w) for k in labels for w in vocabulary}
    for i, k in enumerate(labels):
        for j, w in enumerate(vocabulary):
            assert abs(got[k, w] - weights[i, j]) < 1e-12
    summary = {r.label: r for r in narratives.model_summary(m).collect()}
    assert [summary[k].label_index for k in labels] == [0, 1, 2, 3]
    assert [summary[k].tokens for k in labels] == counts.sum(1).tolist() and summary["a"].documents == 2
    texts = {10: "red green green", 11: "", 12: "unseen words", 13: None, 14: "blue Blue"}
    scored = narratives.score_narratives(m, spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for r in scored.collect():
        x = np.array([_words(texts[r.doc_id] or "").count(w) for w in vocabulary])
        raw = weights @ x
        p = np.exp(raw - raw.max())
        p /= p.sum()
        assert r.prediction == labels[int(np.argmax(raw))]
        assert abs(r.probability - p.max()) < 1e-9 and r.probability_pct == f"{100 * r.probability:.2f}"


def test_save_load_gives_identical_output(spark, split):
    train, test = split
    fitted = narratives.train_response_model(train, "text", "lang")
    path = os.path.join(tempfile.mkdtemp(prefix="redress-model-"), "nb")
    narratives.save_model(fitted, path)
    again = narratives.load_model(spark, path)
    key = lambda r: (r.label, r.term)
    assert sorted(fitted.weights.collect(), key=key) == sorted(again.weights.collect(), key=key)
    assert sorted(fitted.classes.collect()) == sorted(again.classes.collect())


def test_sample_is_repeatable(spark):
    docs = documents_corpus(spark, SF01)
    a = [r.doc_id for r in narratives.sample_narratives(docs, "doc_id", 3, seed=1).collect()]
    b = [r.doc_id for r in narratives.sample_narratives(docs, "doc_id", 3, seed=1).collect()]
    c = [r.doc_id for r in narratives.sample_narratives(docs, "doc_id", 3, seed=2).collect()]
    assert a == b and len(a) == 3 and a != c


def test_score_sample_record(model, spark):
    docs = documents_corpus(spark, SF01)
    rec = narratives.score_sample(model, docs, "text", "doc_id").collect()
    assert len(rec) == 1
    assert set(rec[0].asDict()) == {"doc_id", "Narratives", "Prediction", "Probability"}
    assert rec[0].Prediction in narratives.model_labels(model)
    assert 0 < float(rec[0].Probability) <= 100


def test_distinct_texts_keeps_smallest_id(spark):
    df = spark.createDataFrame(
        [(3, "same text", "en"), (1, "same text", "en"), (2, "other", "fr"), (4, None, "de")],
        "doc_id long, text string, lang string",
    )
    got = sorted((r.doc_id, r.text) for r in distinct_texts(df, keep=["lang"]).collect())
    assert got == [(1, "same text"), (2, "other"), (4, None)]


def test_csv_reader_multiline_quotes(spark):
    folder = tempfile.mkdtemp(prefix="redress-csv-")
    path = os.path.join(folder, "narratives.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('Consumer complaint narrative,Company response\n')
        fh.write('"First line\nsecond line, with ""quotes""",Closed\n')
        fh.write('"Ünïcödé façade",Closed with explanation\n')
        fh.write(',Closed\n')
    got = read_narratives_csv(spark, path).orderBy("narrative_id").collect()
    assert [r.narrative for r in got] == ['First line\nsecond line, with "quotes"', "Ünïcödé façade", None]
    assert len({r.narrative_id for r in got}) == 3


def test_csv_ids_do_not_depend_on_other_files_and_schema_is_checked(spark):
    folder = tempfile.mkdtemp(prefix="redress-csv-")

    def write(name, rows):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write("narrative,response\n" + "".join(f'"{r}",Closed\n' for r in rows))

    ids = lambda: {r.narrative_id: r.narrative for r in read_narratives_csv(spark, folder, schema=schema).collect()}
    schema = "narrative string, response string"
    write("b.csv", ["one", "two\nlines", "one"])
    before = ids()
    assert before == {"b.csv:0": "one", "b.csv:1": "two\nlines", "b.csv:2": "one"}
    write("a.csv", ["a longer narrative " * 50, "x"])
    after = ids()
    assert before.items() <= after.items() and after["a.csv:1"] == "x" and len(after) == 5
    stored = store_narratives(spark, folder, os.path.join(tempfile.mkdtemp(prefix="redress-csv-"), "t"), schema=schema)
    assert {r.narrative_id: r.narrative for r in stored.collect()} == after
    with pytest.raises(Exception, match="(?i)header"):
        read_narratives_csv(spark, folder, schema="text string, response string").collect()


def test_labels_are_alphabetical(model):
    labels = narratives.model_labels(model)
    assert labels == sorted(labels) and len(labels) == 4


RECORDS = "doc_id long, text string, lang string"


def test_every_row_is_scored_by_its_own_text(spark):
    train = spark.createDataFrame([(1, "good fine nice", "x"), (2, "bad awful poor", "y"), (3, "good bad", "z")], RECORDS)
    model = narratives.train_response_model(train, "text", "lang")
    rows = [(None, "good fine", None), (None, "bad awful", None), (7, "bad poor", None), (7, "fine nice good", None),
            (7, "bad poor", None), (8, None, None), (None, None, None), (None, "good fine", None), (9, "?", None)]
    df = spark.createDataFrame(rows, RECORDS)
    alone = {}
    for text in {t for _, t, _ in rows}:
        one = narratives.score_narratives(model, spark.createDataFrame([(1, text, None)], RECORDS)).collect()
        assert len(one) == 1
        alone[text] = (one[0].prediction, round(one[0].probability, 12))
    want = sorted(((i, *alone[t]) for i, t, _ in rows), key=str)
    for parts, limit in ((1, narratives.BROADCAST_TERMS), (4, narratives.BROADCAST_TERMS), (3, 0)):
        got = narratives.score_narratives(model, df.repartition(parts), broadcast_terms=limit).collect()
        assert sorted(((r.doc_id, r.prediction, round(r.probability, 12)) for r in got), key=str) == want
    assert alone["good fine"][0] == "x" and alone["bad awful"][0] == "y" and abs(alone[None][1] - 1 / 3) < 1e-9
    kept = narratives.score_narratives(model, df, keep=["text"]).collect()
    assert sorted(((r.doc_id, r.text, r.prediction) for r in kept), key=str) == sorted(((i, t, alone[t][0]) for i, t, _ in rows), key=str)
    assert narratives.score_narratives(model, df.limit(0)).collect() == []


def test_stored_tokens_give_the_same_model_and_scores(spark):
    docs = documents_corpus(spark, SF01).limit(200)
    kept = narratives.store_tokens(docs, "text", ["doc_id", "lang"], ("the", "of"))
    a = narratives.train_response_model(docs, "text", "lang", stop_words=("of", "the"), idf=True)
    b = narratives.train_response_model(kept, label_col="lang", tokens_col="tokens", idf=True)
    key = lambda m: sorted((r.term, r.label, round(r.weight, 9)) for r in m.weights.collect())
    assert key(a) == key(b) and not {"of", "the"} & {t for t, _, _ in key(a)}
    one = narratives.score_narratives(a, docs, stop_words=("of", "the"))
    two = narratives.score_narratives(b, kept, tokens_col="tokens")
    rows = lambda df: sorted((r.doc_id, r.prediction, r.probability_pct) for r in df.collect())
    assert rows(one) == rows(two)


def test_document_frequencies_follow_the_formula(spark):
    rows = [(1, "red red blue", "a"), (2, "blue green", "a"), (3, "green blue", "b"), (4, "red", "c")]
    m = narratives.train_response_model(spark.createDataFrame(rows, RECORDS), "text", "lang", idf=True)
    labels, vocabulary = ["a", "b", "c"], ["blue", "green", "red"]
    held = np.array([sum(w in _words(t) for _, t, _ in rows) for w in vocabulary])
    idf = np.log((len(rows) + 1) / (held + 1))
    counts = np.array([[sum(_words(t).count(w) for _, t, k in rows if k == lab) for w in vocabulary] for lab in labels]) * idf
    rest = counts.sum(0) - counts + 1.0
    weights = -np.log(rest / rest.sum(1, keepdims=True)) * idf
    got = {(r.label, r.term): r.weight for r in m.weights.collect()}
    for i, k in enumerate(labels):
        for j, w in enumerate(vocabulary):
            assert abs(got[k, w] - weights[i, j]) < 1e-12


def test_a_failed_save_leaves_the_published_model(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="redress-model-"), "nb")
    first = narratives.train_response_model(spark.createDataFrame([(1, "red one", "a"), (2, "blue two", "b")], RECORDS), "text", "lang")
    with pytest.raises(FileNotFoundError):
        narratives.load_model(spark, path)
    assert narratives.save_model(first, path) == 1
    second = narratives.train_response_model(spark.createDataFrame([(1, "green", "c")], RECORDS), "text", "lang")
    broken = second.classes.withColumn("documents", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):  # the second of the two tables
        narratives.save_model(narratives.NarrativeModel(second.terms, broken, second.labels, second.size), path)
    with pytest.raises(ValueError):  # a table that is not whole
        narratives.save_model(narratives.NarrativeModel(second.terms, second.classes, second.labels, second.size + 1), path)
    again = narratives.load_model(spark, path)
    assert again.labels == ("a", "b") and again.terms.count() == again.size == 4
    assert narratives.save_model(second, path) == 2
    assert narratives.load_model(spark, path).labels == ("c",)
    assert narratives.load_model(spark, path, version=1).labels == ("a", "b")


def test_split_reader_equals_the_file_reader(spark):
    """Records over many splits, quotes, blank lines, both line ends."""
    import random

    folder, rnd = tempfile.mkdtemp(prefix="redress-csv-"), random.Random(6)
    words = ["plain", 'say ""hi""', "two\nlines", "\n", "end,", "", " lead", "ü日本", '""', "a\n\n\nb", "x" * 300, "back\\slash"]
    for name, n in (("a.csv", 400), ("b.csv", 3), ("empty.csv", 0)):
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as fh:
            fh.write("id,narrative,response\n")
            for i in range(n):
                text = "".join(rnd.choices(words, k=rnd.randrange(0, 6)))
                quoted = f'"{text}"' if text else rnd.choice(["", "plain text"])
                fh.write(f"{i},{quoted},{rnd.choice(['Closed', ''])}\n" + ("\n" if name == "a.csv" and i % 50 == 7 else ""))
    schema = "id long, narrative string, response string"
    whole = read_narratives_csv(spark, folder, text_index=1, schema=schema)
    want = sorted(map(tuple, whole.collect()), key=str)
    assert len(want) == 403
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set(key, size)
            got = read_narratives_split(spark, folder, schema, text_index=1)
            assert got.columns == ["narrative_id", "narrative", "id", "response"]
            rows = got.collect()
            assert sorted(((r.narrative_id, r.narrative) for r in rows), key=str) == want
            assert {(r.narrative_id, r.id) for r in rows} == {(r.narrative_id, int(r.narrative_id.split(":")[1])) for r in rows}
        with pytest.raises(ValueError, match="header"):
            read_narratives_split(spark, folder, "id long, text string, response string", text_index=1)
    finally:
        spark.conf.set(key, before)


def test_split_reader_with_carriage_returns(spark):
    folder = tempfile.mkdtemp(prefix="redress-csv-")
    with open(os.path.join(folder, "c.csv"), "w", encoding="utf-8", newline="") as fh:
        fh.write('\ufeffnarrative,response\r\n"one\r\ntwo",Closed\r\n\r\nthree,\r\n"last ""q""",x')
    got = read_narratives_split(spark, folder, "narrative string, response string").orderBy("narrative_id").collect()
    assert [(r.narrative_id, r.narrative, r.response) for r in got] == [
        ("c.csv:0", "one\r\ntwo", "Closed"), ("c.csv:1", "three", None), ("c.csv:2", 'last "q"', "x")]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_common_terms_are_broadcast_whatever_the_size_of_the_model(spark):
    texts = [(i, "common words here " * 5 + f"rare{i} rare{i}b", "xyz"[i % 3]) for i in range(60)]
    model = narratives.train_response_model(spark.createDataFrame(texts, RECORDS), "text", "lang")
    asked = [(None, "common rare1 rare2b unseen", None), (7, "rare3 rare3", None), (7, "unseen", None), (8, None, None), (9, "words here", None)]
    df = spark.createDataFrame(asked, RECORDS).unionByName(spark.createDataFrame(texts, RECORDS))
    rows = lambda d: sorted(((r.doc_id, r.prediction, round(r.probability, 12)) for r in d.collect()), key=str)
    whole = rows(narratives.score_narratives(model, df))
    for limit in (0, 1, 3, 50):
        some = narratives.score_narratives(model, df, broadcast_terms=limit)
        assert rows(some) == whole
        common, rest = narratives._by_frequency(model, limit)
        assert common.count() <= limit and common.count() + rest.count() == model.size
    # what was one join of every term with a larger model
    common, _ = narratives._by_frequency(model, 3)
    assert {r.term for r in common.collect()} == {"common", "words", "here"}
    assert "ResolvedHint (strategy=broadcast)" in _plan(narratives.score_narratives(model, df, broadcast_terms=3))


def test_stored_tokens_are_the_tokens(spark):
    df = spark.createDataFrame([(1, "One two, two_3 x", "a"), (2, "", "a"), (3, None, "a"), (4, "! x", "a"), (5, "naïve Ünï ٣٤ 日本 ½½", "a")], RECORDS)
    kept = narratives.store_tokens(df, "text", ["doc_id"])
    want = {1: ["one", "two", "two_3"], 2: [], 3: None, 4: [], 5: ["naïve", "ünï", "٣٤", "日本", "½½"]}
    assert {r.doc_id: r.tokens for r in kept.collect()} == want


def test_fit_puts_the_counts_of_a_term_together_once(spark):
    rows = [(1, "red red blue", "a"), (2, "blue green", "a"), (3, "green blue", "b"), (4, "red", "c"), (5, "x", "d")]
    m = narratives.train_response_model(spark.createDataFrame(rows, RECORDS), "text", "lang", idf=True)
    assert {r.term: r.n for r in m.terms.collect()} == {"red": 3, "blue": 3, "green": 2} and m.size == 3
    # every use of the table grouped the counts again, through lists of labels
    assert "collect_list" not in _plan(m.terms) and "Aggregate" not in _plan(m.terms)


def test_a_large_model_that_was_saved_without_occurrences_scores_alike(spark, tmp_path):
    rows = [(i, f"common words t{i}x", "xy"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, RECORDS)
    fitted = narratives.train_response_model(df, "text", "lang")
    old = narratives.NarrativeModel(fitted.terms.drop("n"), fitted.classes, fitted.labels, fitted.size)
    narratives.save_model(old, str(tmp_path))
    again = narratives.load_model(spark, str(tmp_path))
    got = [sorted((r.doc_id, r.prediction, r.probability_pct) for r in narratives.score_narratives(m, df, broadcast_terms=n).collect())
           for m, n in ((fitted, 100), (again, 100), (again, 5))]
    assert got[0] == got[1] == got[2]


def test_weighted_scores_are_the_same_on_either_side_of_the_limit(spark):
    rows = [(i, "the common words " * (i % 4) + f"t{i}x t{i % 5}y", "xyz"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, RECORDS)
    model = narratives.train_response_model(df, "text", "lang", stop_words=("the",), idf=True)
    got = {n: sorted((r.doc_id, r.prediction, r.probability_pct) for r in narratives.score_narratives(model, df, stop_words=("the",), broadcast_terms=n).collect())
           for n in (0, 7, narratives.BROADCAST_TERMS)}
    assert got[0] == got[7] == got[narratives.BROADCAST_TERMS]
    assert "ResolvedHint (strategy=broadcast)" in _plan(narratives.score_narratives(model, df, broadcast_terms=7))


def test_a_term_crosses_the_shuffle_once_for_all_labels(spark, monkeypatch):
    held = {}
    plain = narratives.stored

    def kept(df, name, *more):
        held[name] = plain(df, name, *more)
        return held[name]

    monkeypatch.setattr(narratives, "stored", kept)
    rows = [(1, "red red blue", "a"), (2, "blue red", "b"), (3, "blue", "c"), (4, None, "d"), (5, "blue", None), (6, "", "e")]
    m = narratives.train_response_model(spark.createDataFrame(rows, RECORDS), "text", "lang")
    # was a row per term and label, grouped and stored again as a row per term
    assert set(held) == {"term-counts"} and sorted(r.term for r in held["term-counts"].collect()) == ["#", "blue", "red"]
    assert m.labels == ("a", "b", "c", "e")
    assert sorted(map(tuple, m.classes.collect())) == [("a", 1, 3), ("b", 1, 2), ("c", 1, 1), ("e", 1, 0)]
    assert {r.term: r.n for r in m.terms.collect()} == {"red": 3, "blue": 3}


def test_rare_terms_cross_the_shuffle_without_sums(spark):
    rows = [(i, "common words " * 3 + f"t{i}x t{i}x", "xy"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, "t1x unseen", "x"), (None, "t2x", "x")], RECORDS)
    model = narratives.train_response_model(spark.createDataFrame(rows, RECORDS), "text", "lang")
    asked = narratives.score_narratives(model, df, broadcast_terms=2)
    lines = asked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(i for i, x in enumerate(lines) if "Join Inner" in x)
    end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    assert not any("Aggregate" in x or "sha2" in x for x in lines[at:end])  # were summed up by text and term first
    rows = lambda d: sorted(((r.doc_id, r.prediction, round(r.probability, 12)) for r in d.collect()), key=str)
    assert rows(asked) == rows(narratives.score_narratives(model, df)) and asked.count() == 25


def test_texts_that_hold_a_term_are_counted_with_its_occurrences(spark, monkeypatch):
    names = []
    plain = narratives.stored
    monkeypatch.setattr(narratives, "stored", lambda df, name, *more: names.append(name) or plain(df, name, *more))
    rows = [(1, "red red blue", "a"), (2, "blue red", "b"), (3, "blue", "c"), (4, None, "c"), (5, "blue", None)]
    m = narratives.train_response_model(spark.createDataFrame(rows, RECORDS), "text", "lang", idf=True)
    assert names == ["term-counts"]  # was stored by label and kind of count, and again by term
    counts = {r.term: (r.n, [round(w, 9) for w in r.weights]) for r in m.terms.collect()}
    idf = {"red": math.log(4 / 3), "blue": math.log(4 / 4)}
    n = {"red": [2, 1, 0], "blue": [1, 1, 1]}
    rest = [sum((sum(n[t]) - n[t][i]) * idf[t] for t in n) + 2 for i in range(3)]
    assert counts == {t: (3, [round(idf[t] * -(math.log((3 - n[t][i]) * idf[t] + 1) - math.log(rest[i])), 9) for i in range(3)]) for t in n}
