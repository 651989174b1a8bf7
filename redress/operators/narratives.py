"""Q6: which response a complaint narrative is likely to receive.

A Complement Naive Bayes text classifier held as two tables:

``terms``    (term, n, weights): the term's occurrences in all texts, and
             one weight per label, in the order of ``labels``:
             idf * -(ln(idf (f - n) + s) - ln(T - N + s V)) with f and n the
             occurrences of the term in all texts and in the label's, T and N
             their sums (times idf) over all terms, V the number of terms, s
             the smoothing, and idf = 1 or ln((m + 1) / (d + 1)) where d of
             all m texts hold the term;
``classes``  (label, documents, tokens).

Tokens are maximal runs of two or more letters, digits or underscores in the
lower-cased text, without the stop words.  Every labelled row trains, every
term counts.  Fitting reads the labels, then the texts once: one aggregation,
with a map-side stage, to a row per term with a count per label and the texts
that hold it.  It is stored, and all else is computed from that.

Scoring gives every row the score of its own text, whatever its id.  The
commonest terms, at most ``BROADCAST_TERMS``, go to the tasks: what they add to
a row is summed up where its text is, to one partial sum per label.  The terms
of a larger model that are left, and terms that it does not know, are few of a
text's.  They are found by the same broadcast in a second pass over the tokens
and cross the shuffle with nothing but the row's key, to be joined on the term;
both sides come straight from shuffles, so AQE can split a term of many texts.
The rest of the vocabulary is never on the driver; the labels are.

``store_tokens`` keeps a corpus as tokens (a string of them, far cheaper to
write and read than a list), so that fitting and scoring read them instead of
cutting the texts twice.

``save_model`` publishes a model: a folder of its own for each version, and
last a line in the manifest that names it.  ``load_model`` reads the last
published version, so a save that fails half-way changes nothing.

``sample_narratives`` picks a repeatable pseudo-random sample (seeded hash
order, a per-partition top-k); ``score_sample`` is a prediction of it (the
reference's one-click prediction).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.session import stored

#: ``[\p{L}\p{N}_]{2,}`` in the form that Java's regular expressions run fastest.
TOKEN_PATTERN = r"[a-z0-9_\p{L}\p{N}][a-z0-9_\p{L}\p{N}]+"

#: So many terms of a model are broadcast: with ten labels about 100 MB in an executor's memory.
BROADCAST_TERMS = 500_000

_MANIFEST = "version long, folder string, labels array<string>, size long"


@dataclass(frozen=True)
class NarrativeModel:
    """``terms`` (term, n, weights), ``classes`` (label, documents, tokens), the
    labels in alphabetical order and the number of terms."""

    terms: DataFrame
    classes: DataFrame
    labels: tuple[str, ...]
    size: int

    @property
    def weights(self) -> DataFrame:
        """(term, label, weight)."""
        labels = _texts(self.labels)
        rows = self.terms.select("term", F.posexplode("weights").alias("_at", "weight"))
        return rows.select("term", F.get(labels, F.col("_at")).alias("label"), "weight")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def tokens(text: str | Column, stop_words: Sequence[str] = ()) -> Column:
    """The tokens of a text, an array (null for a null text)."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)
    stop = sorted(set(stop_words))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def store_tokens(
    df: DataFrame, text_col: str = "text", keep: Sequence[str] = (), stop_words: Sequence[str] = (),
    tokens_col: str = "tokens",
) -> DataFrame:
    """The columns ``keep`` and ``tokens_col`` of every row of ``df``, written
    to the shared folder and read from there."""
    # no token holds a space, and none is empty
    kept = stored(df.select(*keep, F.array_join(tokens(text_col, stop_words), " ").alias(tokens_col)), "tokens", "zstd")
    none = F.array().cast("array<string>")
    return kept.withColumn(tokens_col, F.when(F.col(tokens_col) == "", none).otherwise(F.split(tokens_col, " ")))


def train_response_model(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    smoothing: float = 1.0,
    stop_words: Sequence[str] = (),
    idf: bool = False,
    tokens_col: str | None = None,
) -> NarrativeModel:
    """Fit on labelled narratives (rows with a null label or text are left
    out; every other row is a text of its own).  ``tokens_col`` names a column
    of :func:`store_tokens`; the text is not read then.  With ``idf`` a term
    counts by its inverse document frequency.  ``terms`` is a plan over the
    stored counts."""
    words = F.col(tokens_col) if tokens_col else tokens(text_col, stop_words)
    labelled = df.where(F.col(label_col).isNotNull() & F.col(tokens_col or text_col).isNotNull())
    # all labels, also those whose texts are all null: this reads no text
    known = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).count()
    known = [r["label"] for r in known.orderBy("label").collect()]  # a row per label
    # the tokens, ``#`` for the text itself, and where texts are counted ``=`` and each distinct token;
    # ``explode_outer``, since Spark would compute the array again to test it for ``explode``
    entries = [F.col("_tokens"), F.array(F.lit("#"))]
    if idf:
        entries.append(F.transform(F.array_distinct("_tokens"), lambda t: F.concat(F.lit("="), t)))
    cut = labelled.select(F.col(label_col).alias("label"), words.alias("_tokens"))
    each = cut.select("label", F.explode_outer(F.concat(*entries)).alias("entry"))
    held = F.col("entry").startswith("=") if idf else F.lit(False)
    counted = F.when(~held, F.col("label")) if idf else F.col("label")
    counts = stored(each.groupBy(F.ltrim("entry", F.lit("=")).alias("term") if idf else F.col("entry").alias("term")).agg(
        F.count(F.when(held, 1)).alias("d"),
        *[F.count(F.when(counted == k, 1)).alias(f"_n{i}") for i, k in enumerate(known)],
    ), "term-counts")
    texts = counts.where(F.col("term") == "#").first()
    at = [i for i in range(len(known)) if texts and texts[f"_n{i}"]]
    labels, documents = tuple(known[i] for i in at), [texts[f"_n{i}"] for i in at]
    own = [f"_n{i}" for i in at]
    spark = df.sparkSession
    terms = counts.where(F.col("term") != "#").withColumn("f", sum((F.col(c) for c in own), F.lit(0).cast("long")))
    scale = F.log(F.lit(float(sum(documents) + 1)) / (F.col("d") + 1)) if idf else F.lit(1.0)
    terms = terms.withColumn("idf", scale)
    sums = terms.agg(
        F.count("*"), F.coalesce(F.sum(F.col("f") * F.col("idf")), F.lit(0.0)),
        *[F.coalesce(F.sum(F.col(n) * F.col("idf")), F.lit(0.0)) for n in own],
        *[F.coalesce(F.sum(n), F.lit(0)) for n in own],
    ).first()
    held_tokens = sums[2 + len(own) :]
    classes = spark.createDataFrame(list(zip(labels, documents, held_tokens)), "label string, documents long, tokens long")
    size = sums[0]
    rest = [sums[1] - n + smoothing * size for n in sums[2 : 2 + len(own)]]
    weights = [
        F.col("idf") * -(F.log((F.col("f") - F.col(n)) * F.col("idf") + smoothing) - F.log(F.lit(float(r))))
        for n, r in zip(own, rest)
    ]
    table = terms.select("term", F.col("f").alias("n"), F.array(*weights).cast("array<double>").alias("weights"))
    return NarrativeModel(table, classes, labels, size)


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_model(model: NarrativeModel, path: str) -> int:
    """Publish a model under ``path``; its version, one more than the last.

    The tables go to a new folder, are counted there, and only then one line
    of the manifest (a file that appears at once) names the folder.  Older
    versions stay readable."""
    spark = model.terms.sparkSession
    folder = f"model-{uuid.uuid4().hex}"
    model.terms.write.parquet(f"{path}/{folder}/terms")
    model.classes.write.parquet(f"{path}/{folder}/classes")
    written = spark.read.schema(model.terms.schema).parquet(f"{path}/{folder}/terms").count()
    if written != model.size:
        raise ValueError(f"{written} terms were written of {model.size}")
    before = _published(spark, path)
    version = (before.agg(F.max("version")).first()[0] or 0) + 1 if before is not None else 1
    line = spark.createDataFrame([(version, folder, list(model.labels), model.size)], _MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> NarrativeModel:
    """The model last published under ``path``, or an earlier ``version``."""
    found = _published(spark, path)
    if found is not None and version is not None:
        found = found.where(F.col("version") == version)
    last = found.orderBy(F.desc("version"), "folder").first() if found is not None else None
    if last is None:
        raise FileNotFoundError(f"no model is published under {path}")
    terms = spark.read.schema("term string, n long, weights array<double>").parquet(f"{path}/{last.folder}/terms")
    classes = spark.read.schema("label string, documents long, tokens long").parquet(f"{path}/{last.folder}/classes")
    return NarrativeModel(terms, classes, tuple(last.labels), last["size"])


def model_labels(model: NarrativeModel) -> list[str]:
    """The class labels in alphabetical order."""
    return list(model.labels)


def model_summary(model: NarrativeModel) -> DataFrame:
    """``(label, label_index, documents, tokens, weight_sum)``: the fitted
    classes, with the sum of their weights to three decimals."""
    sums = model.weights.groupBy("label").agg(F.round(F.sum("weight"), 3).alias("weight_sum"))
    return model.classes.join(sums, "label", "left").select(
        "label", (F.array_position(_texts(model.labels), F.col("label")) - 1).cast("int").alias("label_index"),
        "documents", "tokens", F.coalesce("weight_sum", F.lit(0.0)).alias("weight_sum"),
    )


def score_narratives(
    model: NarrativeModel,
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    stop_words: Sequence[str] = (),
    tokens_col: str | None = None,
    keep: Sequence[str] = (),
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """``(id_col, *keep, prediction, probability, probability_pct)``, one row
    per row of ``df``.

    A row is scored by its own text: rows may share an id, or have none.
    ``probability`` is the largest class probability (a double in [0, 1]);
    ``probability_pct`` is it times 100 as text with two decimals.  Ties go to
    the first label; a text without any known term, or a null one, has equal
    probabilities.  ``stop_words`` as in the fit.  The result is the same on
    either side of ``broadcast_terms``.
    """
    words = F.col(tokens_col) if tokens_col else tokens(text_col, stop_words)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate((id_col, *keep))]
    rows = df.select(*named, F.coalesce(words, F.array().cast("array<string>")).alias("_tokens"))
    keys = ["_task", "_hash", *[f"_k{i}" for i in range(len(named))]]
    # Rows equal in id and tokens (by 64 bits) are added up within their task
    # and divided again.
    marked = rows.withColumn("_hash", F.xxhash64("_tokens")).withColumn("_task", F.spark_partition_id())
    common, rest = _by_frequency(model, broadcast_terms)
    many = range(len(model.labels))
    # ``#`` is no token: one such entry per row counts the rows
    found = marked.select(*keys, F.explode_outer(F.concat("_tokens", F.array(F.lit("#")))).alias("term")).join(
        F.broadcast(common), "term", "left"
    )
    texts = found.groupBy(*keys).agg(
        F.count(F.when(F.col("term") == "#", 1)).alias("_n"), *[F.sum(F.get("weights", F.lit(i))).alias(f"_s{i}") for i in many]
    )
    if rest is not None:
        # the same broadcast finds the other terms: no sums cross the shuffle with them
        others = marked.select(*keys, F.explode_outer("_tokens").alias("term")).join(F.broadcast(common), "term", "left")
        others = others.where(F.col("weights").isNull() & F.col("term").isNotNull()).select(*keys, "term").join(rest, "term")
        added = others.groupBy(*keys).agg(*[F.sum(F.get("weights", F.lit(i))).alias(f"_s{i}") for i in many])
        both = texts.unionByName(added.withColumn("_n", F.lit(0).cast("long")))
        texts = both.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in many])
    scores = F.array(*[F.coalesce(f"_s{i}", F.lit(0.0)) / F.col("_n") for i in many]).cast("array<double>")
    scored = texts.withColumn("_s", scores).withColumn("_top", F.array_max("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("_top")))
    out = scored.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate((id_col, *keep))],
        F.get(_texts(model.labels), (F.array_position("_s", F.col("_top")) - 1).cast("int")).alias("prediction"),
        F.try_divide(F.lit(1.0), total).alias("probability"),
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"),  # of one task's rows
    ).drop("_copy")
    return out.withColumn("probability_pct", F.format_string("%.2f", F.col("probability") * F.lit(100.0)))


def _by_frequency(model: NarrativeModel, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The commonest terms of the model, at most ``most``, and the others
    (None if there are none): terms of 16 sizes per doubling of their
    occurrences are taken or left together, so that nothing is sorted."""
    if model.size <= most:
        return model.terms.select("term", "weights"), None
    size = F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1) * 16)
    held = {r[0]: r[1] for r in model.terms.groupBy(size).count().collect()}  # a thousand rows at most
    least, total = max(held) + 1, 0
    for k in sorted(held, reverse=True):
        total += held[k]
        if total > most:
            break
        least = k
    return model.terms.where(size >= least).select("term", "weights"), model.terms.where(size < least).select("term", "weights")


def sample_narratives(
    df: DataFrame, id_col: str, k: int = 1, seed: int = 42
) -> DataFrame:
    """``k`` rows in a seeded hash order of ``id_col``: repeatable, uniform
    over ids, and planned as a per-partition top-k (no full sort).

    The order key is the SHA-256 hex digest of ``'<seed>:<id>'``, a hash any
    SQL engine computes the same way."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return df.orderBy(key, F.col(id_col)).limit(k)


def score_sample(
    model: NarrativeModel,
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    k: int = 1,
    seed: int = 42,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """One-click prediction: ``(Narratives, Prediction, Probability)`` of
    ``k`` sampled narratives, probability as two-decimal percent text."""
    picked = sample_narratives(df.select(id_col, text_col), id_col, k, seed)
    # k rows: fetched once, so that the table is read once
    picked = df.sparkSession.createDataFrame(picked.collect(), picked.schema)
    scored = score_narratives(model, picked, text_col, id_col, stop_words, keep=[text_col])
    return scored.select(
        F.col(id_col),
        F.col(text_col).alias("Narratives"),
        F.col("prediction").alias("Prediction"),
        F.col("probability_pct").alias("Probability"),
    )
