"""Q1 and Q2: how complaints distribute over products, sub-products, states,
issues and sub-issues.

Null rules (kept from the reference's SQL):

* ``COUNT(col)`` ignores nulls, so a null group is present with count 0:
  the null product in ``product_counts``, the null state in
  ``product_subproduct_state``, the null issue in ``issue_counts``.
* Issues and sub-issues are labelled ``'Unknown'`` when null and grouped by
  that label, so a null issue and a literal ``'Unknown'`` issue form one
  group whose ``COUNT(issue)`` counts the literal rows only.
* Key -> list results drop a null key.

Order: where the order of a result carries meaning it is a column
(``position``), with ties broken by count descending then key ascending.
Operators do not sort; :func:`largest_first` sorts a grouped result for
display, and top-n operators sort through ``orderBy().limit()``.

Scale: every grouping key is a low-cardinality categorical; the only shuffles
carry partially aggregated groups.  Windows without a partition key run on
totals (one per distinct product or issue).  Default selections (``None``
arguments) are scalar subqueries over the aggregated groups, whose exchange
Spark reuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redress.functions.labels import (
    ISSUE_ABBREVIATIONS,
    PRODUCT_ABBREVIATIONS,
    map_labels,
    null_label,
)

# ----------------------------------------------------------------------------
# Order and totals of grouped results


def largest_first(counts: DataFrame, value: str, *first: str) -> DataFrame:
    """A grouped result in display order: the columns ``first`` ascending,
    then ``value`` descending, ties by the other columns ascending."""
    rest = [x for x in counts.columns if x != value and x not in first]
    return counts.orderBy(*[F.asc(x) for x in first], F.desc(value), *[F.asc(x) for x in rest])


def with_totals(counts: DataFrame, bar: str, value: str, out: str = "total") -> DataFrame:
    """A grouped result with the height of its stacked bar: the sum of
    ``value`` over the rows of the same ``bar``."""
    return counts.withColumn(out, F.sum(value).over(Window.partitionBy(bar)).cast("long"))


# ----------------------------------------------------------------------------
# Q1: products, sub-products, states


def product_counts(
    c: DataFrame,
    abbreviations: dict[str, str] | None = PRODUCT_ABBREVIATIONS,
    totals: bool = False,
) -> DataFrame:
    """``(product, Counts_Complaints, product_abbr)`` over rows with a
    sub-product; ``totals`` adds ``total``, the bar height per abbreviation
    (products without one share a bar)."""
    counts = (
        c.where(F.col("subproduct").isNotNull())
        .groupBy("product")
        .agg(F.count("product").alias("Counts_Complaints"))
    )
    labelled = map_labels(counts, "product", abbreviations or {}, "product_abbr")
    return with_totals(labelled, "product_abbr", "Counts_Complaints") if totals else labelled


def products(c: DataFrame) -> DataFrame:
    """``(position, product)``: products with a sub-product, largest first; no null."""
    counts = product_counts(c, None).where(F.col("product").isNotNull())
    w = Window.orderBy(F.desc("Counts_Complaints"), F.asc("product"))
    return counts.select(F.row_number().over(w).alias("position"), "product")


def product_options(c: DataFrame) -> DataFrame:
    """``(position, label, value)``: the product dropdown, its first the default."""
    return products(c).select("position", F.col("product").alias("label"), F.col("product").alias("value"))


def product_subproduct_state(c: DataFrame) -> DataFrame:
    """``(product, subproduct, state, Counts_Complaints)``; ``COUNT(state)``."""
    return (
        c.where(F.col("subproduct").isNotNull())
        .groupBy("product", "subproduct", "state")
        .agg(F.count("state").alias("Counts_Complaints"))
    )


def _largest_product(triples: DataFrame):
    """The product with most rows (ties: the smaller), a scalar subquery over
    the (product, sub-product, state) groups with their ``_rows``."""
    totals = triples.groupBy("product").agg(F.sum("_rows").alias("_total"))
    return totals.orderBy(F.desc("_total"), F.asc("product")).limit(1).select("product").scalar()


def _triples(c: DataFrame) -> DataFrame:
    """Groups of non-null products: (product, subproduct, state,
    Counts_Complaints, _rows)."""
    return (
        c.where(F.col("subproduct").isNotNull() & F.col("product").isNotNull())
        .groupBy("product", "subproduct", "state")
        .agg(F.count("state").alias("Counts_Complaints"), F.count(F.lit(1)).alias("_rows"))
    )


def _positions(best: DataFrame) -> DataFrame:
    w = Window.partitionBy("product").orderBy(F.desc("_best"), F.asc("subproduct"))
    return best.select("product", F.row_number().over(w).alias("position"), "subproduct")


def product_subproduct_lists(c: DataFrame, as_arrays: bool = False) -> DataFrame:
    """Sub-products of each product in first-appearance order.

    The reference walks the (product, sub-product, state) counts sorted by
    count descending and keeps each sub-product's first appearance, i.e. it
    orders a product's sub-products by their largest single-state count.
    Row form ``(product, position, subproduct)``; ``as_arrays`` gives
    ``(product, subproducts ARRAY<STRING>)``.
    """
    best = (
        product_subproduct_state(c)
        .where(F.col("product").isNotNull())
        .groupBy("product", "subproduct")
        .agg(F.max("Counts_Complaints").alias("_best"))
    )
    rows = _positions(best)
    return _as_arrays(rows, "product", "subproduct", "subproducts") if as_arrays else rows


def subproducts_for(c: DataFrame, product: str | None = None) -> DataFrame:
    """``(product, position, subproduct)`` of one product (default: the largest)."""
    if product is not None:
        return product_subproduct_lists(c).where(F.col("product") == product)
    triples = _triples(c)
    mine = triples.where(F.col("product") == _largest_product(triples))
    return _positions(mine.groupBy("product", "subproduct").agg(F.max("Counts_Complaints").alias("_best")))


def state_counts_for(
    c: DataFrame, product: str | None = None, subproduct: str | None = None
) -> DataFrame:
    """``(state, Counts_Complaints)`` of one (product, sub-product) pair.

    Defaults: the largest product, and its first sub-product.  An explicit
    pair matches by equality, so a pair absent from the data gives no rows.
    """
    counts = product_subproduct_state(c)
    if product is not None and subproduct is not None:
        picked = counts.where((F.col("product") == product) & (F.col("subproduct") == subproduct))
        return picked.select("state", "Counts_Complaints")
    triples = _triples(c)
    chosen = F.lit(product) if product is not None else _largest_product(triples)
    mine = triples.where(F.col("product") == chosen)
    if subproduct is None:
        best = mine.groupBy("subproduct").agg(F.max("Counts_Complaints").alias("_best"))
        first = best.orderBy(F.desc("_best"), F.asc("subproduct")).limit(1).select("subproduct").scalar()
    else:
        first = F.lit(subproduct)
    return mine.where(F.col("subproduct") == first).select("state", "Counts_Complaints")


# ----------------------------------------------------------------------------
# Q2: issues, sub-issues


def issue_counts(c: DataFrame) -> DataFrame:
    """``(issue, count)``: ``IFNULL(issue,'Unknown')`` groups, ``COUNT(issue)``."""
    return (
        c.groupBy(null_label("issue").alias("_issue"))
        .agg(F.count("issue").alias("count"))
        .withColumnRenamed("_issue", "issue")
    )


def issue_subissue_counts(c: DataFrame) -> DataFrame:
    """``(issue, subissue, count)``: both labelled, ``COUNT(issue)``."""
    return (
        c.groupBy(null_label("issue").alias("_issue"), null_label("subissue").alias("_subissue"))
        .agg(F.count("issue").alias("count"))
        .withColumnRenamed("_issue", "issue")
        .withColumnRenamed("_subissue", "subissue")
    )


def issue_totals(c: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(issue, count, position)``: per-issue totals re-aggregated from the
    (issue, sub-issue) counts, ranked largest first."""
    pairs = issue_subissue_counts(c) if pairs is None else pairs
    totals = pairs.groupBy("issue").agg(F.sum("count").cast("long").alias("count"))
    w = Window.orderBy(F.desc("count"), F.asc("issue"))
    return totals.withColumn("position", F.row_number().over(w))


def top_issues(c: DataFrame, n: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    """The ``n`` largest issue totals (top-k; ties to the smaller issue)."""
    pairs = issue_subissue_counts(c) if pairs is None else pairs
    totals = pairs.groupBy("issue").agg(F.sum("count").cast("long").alias("count"))
    top = totals.orderBy(F.desc("count"), F.asc("issue")).limit(n)
    return top.select("issue", "count")


def top_issue_subissue(
    c: DataFrame,
    n_issues: int = 10,
    n_pairs: int = 15,
    abbreviations: dict[str, str] | None = ISSUE_ABBREVIATIONS,
) -> DataFrame:
    """The ``n_pairs`` largest (issue, sub-issue) counts among the top issues.

    ``(issue, subissue, count, issue_abbrev, issue_total)``: ``issue_total``
    is the sum over the kept rows of the same abbreviation, the bar order of
    the chart.
    """
    pairs = issue_subissue_counts(c)
    top = top_issues(c, n_issues, pairs).select("issue")
    kept = (
        pairs.join(top, "issue", "left_semi")
        .select("issue", "subissue", "count")
        .orderBy(F.desc("count"), F.asc("issue"), F.asc("subissue"))
        .limit(n_pairs)
    )
    labelled = map_labels(kept, "issue", abbreviations or {}, "issue_abbrev")
    return labelled.withColumn(
        "issue_total",
        F.sum("count").over(Window.partitionBy("issue_abbrev")).cast("long"),
    )


def issue_subissue_lists(c: DataFrame, as_arrays: bool = False) -> DataFrame:
    """Sub-issues of each issue, issues ordered by total, sub-issues by count.

    Row form ``(issue, issue_position, position, subissue)``; ``as_arrays``
    gives ``(issue, issue_position, subissues ARRAY<STRING>)``.
    """
    pairs = issue_subissue_counts(c)
    order = issue_totals(c, pairs).select("issue", F.col("position").alias("issue_position"))
    rows = pairs.join(order, "issue").select(
        "issue",
        "issue_position",
        F.row_number()
        .over(Window.partitionBy("issue").orderBy(F.desc("count"), F.asc("subissue")))
        .alias("position"),
        "subissue",
    )
    if not as_arrays:
        return rows
    return _as_arrays(rows, ["issue", "issue_position"], "subissue", "subissues")


def subissues_for(c: DataFrame, issue: str | None = None) -> DataFrame:
    """``(subissue, count)`` of one issue label (default: the largest issue)."""
    pairs = issue_subissue_counts(c)
    if issue is not None:
        return pairs.where(F.col("issue") == issue).select("subissue", "count")
    first = top_issues(c, 1, pairs).select("issue").scalar()
    return pairs.where(F.col("issue") == first).select("subissue", "count")


def _as_arrays(rows: DataFrame, keys, item: str, out: str) -> DataFrame:
    """Row form ``(keys..., position, item)`` -> ``(keys..., out ARRAY)`` in position order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("position"), F.col(item))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x[item]).alias(out))
