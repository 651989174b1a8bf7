"""Quality classifier: a generalised additive model with pairwise terms.

Every feature is cut into bins and has a lookup table with one number per
bin; chosen pairs of features have a table over their coarser bins.  The
tables are learned by cyclic boosting: in each round every term in turn adds
a shallow tree fitted to the log-loss residuals.  A score is the sum of the
looked-up numbers, computed for whole batches by array additions.

Features are computed from the whole text where it is read.  The fit sees the
feature rows of a bounded labelled sample only (``max_rows``); every row is
scored by its executor, so no text is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import sample, ship, stored

FEATURES = [
    "log_words", "log_bytes", "word_length", "distinct_words", "upper", "digits", "symbols", "high_bytes",
    "line_length", "distinct_lines", "capital_words", "letter_words", "symbol_ends", "end_marks", "longest_word",
    "lone_symbols",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = ~(_SPACE | _LETTER | _DIGIT)
_SYMBOL[[ord(c) for c in ".,;:'-"]] = False
_FLAGS = np.stack([_UPPER, _DIGIT, _SYMBOL, ~_LETTER & ~_SPACE & ~_DIGIT]).astype(np.float64)


def features(text: str | None) -> list[float]:
    """The features of a text; null counts as empty, where all are 0."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    upper, digits, symbols, _ = _FLAGS @ counts
    high = counts[192:].sum()  # one per character beyond ASCII
    chars = counts.sum() - counts[128:192].sum()
    solid = max(1, chars - counts[_SPACE].sum())
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    # words lie one after another in the bytes that are not white space
    packed = data[~_SPACE[data]]
    last = packed[np.cumsum(lengths) - 1]
    first = packed[np.concatenate([[0], np.cumsum(lengths)[:-1]])]
    odd = np.add.reduceat((~_LETTER[packed]).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(raw)), solid / n, len(set(words)) / n, upper / solid, digits / solid,
        symbols / solid, high / solid, np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        _UPPER[first].mean(), (odd == 0).mean(), _SYMBOL[last].mean(), np.isin(last, (46, 33, 63)).mean(),
        np.log1p(lengths.max()), ((lengths == 1) & ~_LETTER[first]).mean(),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column per feature) for every row; other columns are not read."""

    def run(batches):
        for b in batches:
            rows = np.array([features(t) for t in b.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows.T)], names=["id", *FEATURES])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} double" for c in FEATURES)]))


@dataclass
class Gam:
    """Bin edges, one table per feature, one per pair; ``base`` is the log odds."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"),
                           np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Best gain and the bin before which to cut (0: no cut)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    G, H = g.sum(), h.sum()
    gain = gl**2 / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G**2 / (H + penalty)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Leaf values, bin by bin, of a tree over ordered bins."""
    _, k = _split(g, h, penalty) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, penalty), _tree(g[k:], h[k:], depth - 1, penalty)])


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """A cut on one axis, then one on the other within each side; the better
    order.  Gain and leaf values on the grid."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, a.shape[0]):
            gain, grid = 0.0, np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, None)):
                ga, ha = a[rows].sum(0), b[rows].sum(0)
                leaf = _tree(ga, ha, 1, penalty)
                gain += float((leaf * ga).sum())
                grid[rows] = leaf
            gain -= float(a.sum() ** 2 / (b.sum() + penalty))
            if gain > best + 1e-9:
                best, out = gain, (grid.T if turned else grid)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, bins: int = 32, coarse_bins: int = 8, n_pairs: int = 6,
        pair_rounds: int = 40, depth: int = 2, rate: float = 0.1, penalty: float = 1.0) -> Gam:
    """Boost the tables on the rows of ``x`` with labels ``y`` (0 or 1).

    Without rows every score is 0.5; with one label every score is its
    smoothed share.
    """
    m = Gam()
    if not len(y):
        return m
    share = (y.sum() + 1) / (len(y) + 2)
    m.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return m
    m.edges = [_cuts(c, bins) for c in x.T]
    m.coarse = [_cuts(c, coarse_bins) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T)]
    total = np.full(len(y), m.base)

    def sums(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(place, y - p, size), np.bincount(place, p * (1 - p), size)

    for _ in range(rounds):
        for i, table in enumerate(m.tables):
            step = rate * _tree(*sums(at[i], len(table)), depth, penalty)
            table += step
            total += step[at[i]]
    small = [np.searchsorted(e, c, side="right") for e, c in zip(m.coarse, x.T)]
    sizes = [len(e) + 1 for e in m.coarse]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = sums(small[i] * sizes[j] + small[j], sizes[i] * sizes[j])
        return g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j])

    gains = [(_pair_tree(*grid(i, j), penalty)[0], i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]
    m.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    m.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(m.pairs, m.pair_tables):
            step = rate * _pair_tree(*grid(i, j), penalty)[1]
            table += step
            total += step[small[i], small[j]]
    return m


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fit on the labelled rows of ``docs`` that are not held out: about
    ``max_rows`` labels (at most twice as many) chosen by the hash of their
    id, or all if there are no more.

    The chosen ids are so few, whatever the input, that they are broadcast:
    only the texts that they name become features, and no text is shuffled.
    """
    known = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = stored(sample(stored(known, "quality-labels"), max_rows, "id"), "quality-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = feature_table(texts.join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id", "text")
    rows = taught.join(F.broadcast(chosen), "id").limit(2 * max_rows).toPandas()
    rows = rows.sort_values(["id", *FEATURES])  # the same sums on every run
    return fit(rows[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    ``score`` is the probability of label 1, ``predicted`` is 1 from 0.5 on.
    Null and empty texts get the score of a text without words.  Labels other
    than 0 and 1, and labels of unknown ids, are not learned; an id labelled
    both ways counts as 1; a null id is scored and not held out.
    """
    model = learn(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text is predicted 1, all their columns.

    The model is that of :func:`classify`; every text is scored where it is
    read, so no text is shuffled.
    """
    model = learn(docs, labels, id_col, text_col, label_col, max_rows)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x) >= 0.5)

    return docs.where(good(F.col(text_col).cast("string")))
