"""Secret scan: three fixed patterns, and character Markov models.

The patterns find assignments, access keys and hexadecimal runs.  The models
find the secrets that no pattern knows: one first-order Markov model of the
characters of random strings and one of ordinary identifiers, both trained
from labelled samples of the corpus itself (what the patterns matched; words
and numbers), compare every other token by its mean log-likelihood ratio per
transition.  A part of the samples is kept from the models and sets the
threshold.  Everything is Spark SQL: positions come from splitting a text at
the matches, a score is a sum over a token's transitions looked up in one
constant array, and the training is two aggregations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redress.llm.common import fresh, stored

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: runs, so equal
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

#: What the models judge: tokens of 16 characters or more.  Shorter ones are never judged.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Labelled samples of ordinary strings: words and names, and numbers, dates, versions and the like.
_PART = r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}"
IDENTIFIER = rf"(?<![A-Za-z0-9]){_PART})(?:[_-]?{_PART}|[0-9]{{1,4}}))*(?![A-Za-z0-9])"
NUMBER = r"(?<![A-Za-z0-9+/_=-])[0-9]{2,}(?:[-/_][0-9]+)*(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Share of the documents without a base span whose words and numbers are
#: samples, and of the strings that the patterns found; about so many of
#: either where the share is less.  Drawn by hash: samples grow with the input.
SHARE, LEAST_DOCS, LEAST_STRINGS = 1 / 32, 2000, 20_000
#: Weight, in transitions, of the characters' overall shares in every row of a model.
BACKOFF = 20
#: One in so many samples is kept from the models and sets the threshold; an
#: ordinary string over it costs as much as so many random ones below it.
HELD_OUT, FALSE_COST = 5, 20
#: Threshold without samples that were kept, and the least one.
THRESHOLD, LEAST_THRESHOLD = 0.5, 0.25

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern``; ``keep``
    judges the match and its group 2 (code points, end exclusive)."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    sizes = F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.coalesce(x["b"], F.lit(0))
        end = start + F.coalesce(x["m"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        out = F.when(x["m"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    found = F.aggregate(sizes, zero, add)["out"]
    if keep is not None:
        judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), keep)
        found = F.transform(
            F.filter(F.zip_with(found, judged, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]),
            lambda x: x["s"],
        )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind."""
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, lambda value: F.length(value) >= 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)
    ))


def _code(character: Column) -> Column:
    return F.instr(F.lit(ALPHABET), character) - 1


def _transitions(strings: DataFrame, label: int) -> DataFrame:
    """(label, a, b, n): counted transitions of the column ``s``, ``n`` times each."""
    places = F.sequence(F.lit(1), F.length("s") - 1)
    return (
        strings.where("length(s) >= 2")
        .select("s", "n", F.explode(places).alias("i"))
        .select(F.expr("substring(s, i, 1)").alias("a"), F.expr("substring(s, i + 1, 1)").alias("b"), "n")
        .groupBy("a", "b").agg(F.sum("n").alias("n"))
        .select(F.lit(label).alias("label"), "a", "b", "n")
    )


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio (random over ordinary) of every transition of
    ALPHABET, and the mean ratio over which a token is a secret."""

    ratios: list[float]
    threshold: float


def _drawn(df: DataFrame, share: float, least: int, *by: str) -> DataFrame:
    """About ``share`` of the rows by hash, or about ``least`` if that is more."""
    part = min(1.0, max(share, least / max(df.count(), 1)))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 31)) < int(part * (1 << 31)))


def train(scanned: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS, least_strings: int = LEAST_STRINGS) -> Model | None:
    """The models of rows (id, text, base).

    Random strings: the last 200 characters of what base spans end in, if 16
    or more and with a digit.  Ordinary ones: words, names (IDENTIFIER) and
    numbers (NUMBER) in documents without a base span.  None if either sample
    is empty."""
    values = (
        scanned.where("size(base) > 0")
        .select("text", F.explode("base").alias("s"))
        .select(F.expr("substring(text, s.start + 1, s.end - s.start)").alias("s"))
        .select(F.regexp_extract("s", "[A-Za-z0-9+/_=-]{1,200}$", 0).alias("s"))
        .where("length(s) >= 16 AND s RLIKE '[0-9]'").distinct()
    )
    values = _drawn(stored(values, "secret-samples"), share, least_strings, "s")
    words = _drawn(scanned, share, least_docs, "id", "text").where("size(base) = 0").select(
        F.explode(F.regexp_extract_all("text", F.lit(f"(?:{IDENTIFIER})|(?:{NUMBER})"), 0)).alias("s"))
    words = stored(words.groupBy("s").agg(F.count("*").alias("n")), "ordinary-samples")
    values = values.withColumn("n", F.lit(1).cast("long"))
    held = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    # at most |ALPHABET| ** 2 rows a label
    rows = _transitions(values.where(~held), 1).unionByName(_transitions(words.where(~held), 0)).collect()
    size, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = [[0.0] * (size * size) for _ in range(2)]
    for r in rows:
        if r["a"] in at and r["b"] in at:
            counts[r["label"]][at[r["a"]] * size + at[r["b"]]] += r["n"]
    if not all(map(any, counts)):
        return None
    ordinary, random = (_log_probabilities(c, size) for c in counts)
    ratios = [round(a - b, 6) for a, b in zip(random, ordinary)]

    # held-out strings of about a token's length by twentieths of their ratio: a few hundred rows
    score = _ratio(F.col("s"), F.from_json(F.lit(str(ratios)), "array<double>"))
    tests = [
        x.where(held & F.expr("length(s) >= 12")).select(F.lit(k).alias("label"), F.floor(score * 20).alias("step"), "n")
        for k, x in enumerate((words, values))
    ]
    steps = tests[0].unionByName(tests[1]).groupBy("label", "step").agg(F.sum("n").alias("n")).collect()
    return Model(ratios, _threshold([(r["label"], r["step"], r["n"]) for r in steps if r["step"] is not None]))


def _threshold(steps: list[tuple[int, int, int]]) -> float:
    """The twentieth that loses least: the share of random strings at or
    below it, and FALSE_COST times the share of ordinary ones above it.  Of
    equal ones the middle."""
    totals = [sum(n for k, _, n in steps if k == label) for label in (0, 1)]
    if not all(totals):
        return THRESHOLD
    least = round(LEAST_THRESHOLD * 20)
    losses = []
    for t in range(least, max(least, max(s for _, s, _ in steps)) + 1):
        missed = sum(n for k, s, n in steps if k == 1 and s < t) / totals[1]
        false = sum(n for k, s, n in steps if k == 0 and s >= t) / totals[0]
        losses.append((missed + FALSE_COST * false, t))
    best = [t for loss, t in losses if loss == min(losses)[0]]
    return best[len(best) // 2] / 20


def _log_probabilities(counts: list[float], size: int) -> list[float]:
    """log P(b | a); what follows a rarely seen character is as likely as the
    characters are on the whole."""
    whole = [sum(counts[b::size]) + 0.5 for b in range(size)]
    total = sum(whole)
    out = []
    for a in range(size):
        row = counts[a * size : (a + 1) * size]
        out += [math.log((n + BACKOFF * w / total) / (sum(row) + BACKOFF)) for n, w in zip(row, whole)]
    return out


def _ratio(token: Column, table: Column) -> Column:
    """Mean of the ratios of a token's transitions."""
    size = len(ALPHABET)
    chars = F.transform(F.split(token, ""), lambda c: _code(c))
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1),
                       lambda a, b: F.get(table, a * size + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)


def markov_spans(text: Column, model: Model | None, base: Column, threshold: float | None = None) -> Column:
    """Tokens whose mean log-likelihood ratio is over ``threshold`` (None:
    the model's own) and that overlap no base span."""
    if model is None:
        return F.array().cast(_SPAN)
    table = F.from_json(F.lit("[" + ",".join(map(str, model.ratios)) + "]"), "array<double>")
    least = model.threshold if threshold is None else threshold
    found = _spans(text, TOKEN, 3)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    both = F.zip_with(found, tokens, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    free = F.filter(both, lambda x: ~F.exists(base, lambda y: (y["start"] < x["s"]["end"]) & (x["s"]["start"] < y["end"])))
    return F.transform(F.filter(free, lambda x: _ratio(x["t"], table) > least), lambda x: x["s"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None,
         share: float = SHARE, least_docs: int = LEAST_DOCS, least_strings: int = LEAST_STRINGS) -> DataFrame:
    """(id, text, base, spans) for every row of ``docs``.

    ``base`` holds the spans of the three patterns, ``spans`` those and the
    ones that the models add: structs (start, kind, end) in code points, end
    exclusive, ``kind`` an index of KINDS, ordered by start and kind.  Null
    texts count as empty and have no spans; ids may be null or repeat; other
    columns are not read.  Without any labelled sample (an empty table, no
    pattern match) the models add nothing.  ``threshold`` is learned from
    samples that the models do not see unless it is given.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    based = src.withColumn("base", base_spans(F.col("text")))
    model = train(based, share, least_docs, least_strings)
    text, base = F.col("text"), F.col("base")
    return based.withColumn("spans", F.array_sort(F.concat(base, markov_spans(text, model, base, threshold))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]",
           count_col: str | None = "n_chars", threshold: float | None = None, share: float = SHARE,
           least_docs: int = LEAST_DOCS, least_strings: int = LEAST_STRINGS) -> DataFrame:
    """``docs`` with every stretch covered by spans replaced by ``mask``;
    all rows and columns, whatever their names.  ``count_col`` becomes the new
    length of changed texts.  Null texts stay null."""
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), own.alias("text"))
    model = train(src.withColumn("base", base_spans(F.col("text"))), share, least_docs, least_strings)
    based, found, masked = fresh(docs, "_base", "_spans", "_masked")
    marked = docs.withColumn(based, base_spans(own))
    spans = F.array_sort(F.concat(based, markov_spans(own, model, F.col(based), threshold)))
    marked = marked.withColumn(found, spans)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substr(own, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["out"], F.array(gap, F.lit(mask)))
        longer = F.when(s["start"] < acc["at"], acc["out"]).otherwise(new)  # overlaps what is masked
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), longer.alias("out"))

    done = F.aggregate(found, zero, add)
    text = F.concat(F.array_join(done["out"], ""), F.substr(own, done["at"] + 1, F.length(own)))
    marked = marked.withColumn(masked, F.when(F.size(found) > 0, text))
    new = {text_col: F.coalesce(masked, text_col)}
    if count_col and count_col in docs.columns:
        new[count_col] = F.coalesce(F.length(masked).cast(docs.schema[count_col].dataType), count_col)
    return marked.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
