"""Named queries over the driver's tables, each with its DuckDB oracle SQL.

Every Spark query reads the tables under ``sf_dir`` through
:func:`redress.sources.tpch_view.complaints_view`, asking only for the
columns it uses (so only the joins those columns need are made).  Every
oracle SQL text over complaints runs the *full* view definition
(``VIEW_SQL``, all seven joins) and then the operator written out in plain
SQL, so a pass also checks that pruning the joins loses nothing.  The
narrative queries read ``documents``; their oracle is Complement Naive Bayes
written in SQL.  Queries with a model fit it, store it in the shared folder
and use the stored one: building their DataFrame runs jobs.

Parameters are the reference's, except where its value selects nothing in
the test data: the year cut is 1996 (the data spans 1995-2001; the
reference's 2012 would leave no rows) and the chosen year is 1998.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.functions.labels import RESPONSES
from redress.operators import association, counts, narratives, outcomes, profile, trends
from redress.operators.order import with_position
from redress.session import scratch_path
from redress.sources.complaints import COMPLAINT_COLUMNS, NULL_PROFILE_COLUMNS, read_complaints_table
from redress.sources.narratives import documents_corpus, read_narratives_split
from redress.sources.tpch_view import VIEW_SQL, complaints_view

MIN_YEAR = 1996
YEAR = 1998
WINDOW = 30

# Abbreviations that hit some of the test data's keys and miss others.
PRODUCT_LABELS = {"PROMO": "Pr", "STANDARD": "St", "No such product": "X"}
ISSUE_LABELS = {"issue 1-URGENT": "Urgent", "issue 2-HIGH": "High", "No such issue": "X"}

# Frequent words of the documents' four languages, left out by the weighted model.
STOP_WORDS = ("and", "de", "der", "die", "el", "en", "in", "la", "le", "les", "of", "que", "the", "to", "und")

Query = Callable[[SparkSession, str], DataFrame]


def _view(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return complaints_view(spark, sf_dir, list(cols))


def _with_view(sql: str) -> str:
    return f"WITH complaints AS ({VIEW_SQL})\n{sql}"


# ---------------------------------------------------------------------------
# Spark side


def _sample_rows(spark, d):
    # The order leads with complaint_id, so only rows holding one of the five
    # smallest ids can be among the first five: restrict before the joins.
    c = complaints_view(spark, d, list(COMPLAINT_COLUMNS), first_ids=5)
    return profile.sample_rows(c, 5)


def _missing_counts(spark, d):
    return profile.missing_counts(complaints_view(spark, d, list(NULL_PROFILE_COLUMNS), narrative_flag=True))


def _product_counts(spark, d):
    return counts.product_counts(_view(spark, d, "product", "subproduct"), PRODUCT_LABELS)


def _product_totals(spark, d):
    # products that PRODUCT_LABELS misses share one bar
    return counts.product_counts(_view(spark, d, "product", "subproduct"), PRODUCT_LABELS, totals=True)


def _product_options(spark, d):
    return counts.product_options(_view(spark, d, "product", "subproduct"))


def _products(spark, d):
    return counts.products(_view(spark, d, "product", "subproduct"))


def _product_subproduct_state(spark, d):
    return counts.product_subproduct_state(_view(spark, d, "product", "subproduct", "state"))


def _product_subproduct_lists(spark, d):
    return counts.product_subproduct_lists(_view(spark, d, "product", "subproduct", "state"))


def _subproducts_for(spark, d):
    return counts.subproducts_for(_view(spark, d, "product", "subproduct", "state"))


def _state_counts_for(spark, d):
    return counts.state_counts_for(_view(spark, d, "product", "subproduct", "state"))


def _issue_counts(spark, d):
    return counts.issue_counts(_view(spark, d, "issue"))


def _issue_subissue_counts(spark, d):
    return counts.issue_subissue_counts(_view(spark, d, "issue", "subissue"))


def _issue_totals(spark, d):
    return counts.issue_totals(_view(spark, d, "issue", "subissue"))


def _top_issues(spark, d):
    return counts.top_issues(_view(spark, d, "issue", "subissue"), 3)


def _top_issue_subissue(spark, d):
    return counts.top_issue_subissue(_view(spark, d, "issue", "subissue"), 3, 10, ISSUE_LABELS)


def _issue_subissue_lists(spark, d):
    return counts.issue_subissue_lists(_view(spark, d, "issue", "subissue"))


def _subissues_for(spark, d):
    return counts.subissues_for(_view(spark, d, "issue", "subissue"))


def _channel_response_counts(spark, d):
    return association.channel_response_counts(
        _view(spark, d, "submitted_via", "company_response_to_consumer")
    )


def _channel_response_totals(spark, d):
    return association.channel_response_counts(
        _view(spark, d, "submitted_via", "company_response_to_consumer"), with_totals=True
    )


def _channel_response_crosstab(spark, d):
    return association.crosstab(_view(spark, d, "submitted_via", "company_response_to_consumer"))


def _expected_counts(spark, d):
    return association.expected_counts(
        _view(spark, d, "submitted_via", "company_response_to_consumer")
    )


def _rounded(stat: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles to ten decimals, on both sides of the comparison."""
    return stat.withColumns({x: F.round(x, 10) for x in columns})


def _statistic(row: str, col: str, weight: str = "count") -> Query:
    def query(spark, d):
        return _rounded(association.chi_square_statistic(_view(spark, d, row, col), row, col, weight), "chi2")

    return query


def _subissue_dispute_crosstab(spark, d):
    # half of the cells are empty
    return association.crosstab(_view(spark, d, "subissue", "consumer_disputed"), "subissue", "consumer_disputed")


def _subissue_dispute_expected(spark, d):
    return association.expected_counts(
        _view(spark, d, "subissue", "consumer_disputed"), "subissue", "consumer_disputed"
    )


def _report(row: str, col: str) -> Query:
    def query(spark, d):
        report = association.chi_square(_view(spark, d, row, col), row, col, weight="count", digits=6)
        return _rounded(report, "chi2", "p_value")

    return query


def _subproducts_of(product: str) -> Query:
    return lambda spark, d: counts.subproducts_for(_view(spark, d, "product", "subproduct", "state"), product)


def _states_of(product: str, subproduct: str) -> Query:
    return lambda spark, d: counts.state_counts_for(
        _view(spark, d, "product", "subproduct", "state"), product, subproduct
    )


def _subissues_of(issue: str) -> Query:
    return lambda spark, d: counts.subissues_for(_view(spark, d, "issue", "subissue"), issue)


def _product_trend_of(product: str) -> Query:
    return lambda spark, d: trends.category_trend_for(
        _view(spark, d, "date_received", "product"), "product", product, WINDOW
    )


def _daily_trend(spark, d):
    return trends.daily_trend(_view(spark, d, "date_received"), WINDOW, MIN_YEAR)


def _trend_for_year(spark, d):
    return trends.trend_for_year(_view(spark, d, "date_received"), YEAR, WINDOW, MIN_YEAR)


def _trend_for_first_year(spark, d):
    return trends.trend_for_year(_view(spark, d, "date_received"), None, WINDOW, MIN_YEAR)


def _trend_year_domain(spark, d):
    return trends.trend_year_domain(_view(spark, d, "date_received"), MIN_YEAR, WINDOW)


def _response_trend(spark, d):
    return trends.category_trend(
        _view(spark, d, "date_received", "company_response_to_consumer"),
        "company_response_to_consumer",
        WINDOW,
    )


def _response_trend_wide(spark, d):
    return trends.category_trend_wide(
        _view(spark, d, "date_received", "company_response_to_consumer"),
        "company_response_to_consumer",
        RESPONSES,
    )


def _product_trend(spark, d):
    return trends.category_trend(_view(spark, d, "date_received", "product"), "product", WINDOW)


def _product_trend_for(spark, d):
    return trends.category_trend_for(
        _view(spark, d, "date_received", "product"), "product", None, WINDOW
    )


def _top_issue_per_year(spark, d):
    return trends.top_issue_per_year(_view(spark, d, "date_received", "issue"))


def _response_composition(spark, d):
    return outcomes.response_composition(_view(spark, d, "company_response_to_consumer"))


def _dispute_by_response(spark, d):
    return outcomes.dispute_by_response(
        _view(spark, d, "company_response_to_consumer", "consumer_disputed")
    )


def _stored_model(spark, model):
    """``model`` published in the shared folder and loaded from there."""
    path = scratch_path(spark, "model")
    narratives.save_model(model, path)
    return narratives.load_model(spark, path)


def _document_tokens(spark, d, stop_words=()):
    """The documents as tokens, cut once for the fit and the scores."""
    return narratives.store_tokens(documents_corpus(spark, d), "text", ["doc_id", "lang"], stop_words)


def _language_model(spark, docs, idf=False):
    """Complement NB trained on every document's whole text, labelled by
    language: the stand-in for narratives labelled by company response."""
    return _stored_model(spark, narratives.train_response_model(docs, label_col="lang", tokens_col="tokens", idf=idf))


def _complaint_tokens(spark, d):
    """Every complaint with a narrative, as tokens."""
    c = _view(spark, d, "complaint_id", "consumer_complaint_narrative", "company_response_to_consumer")
    c = c.where(F.col("consumer_complaint_narrative").isNotNull())
    return narratives.store_tokens(
        c, "consumer_complaint_narrative", ["complaint_id", "company_response_to_consumer"]
    )


def _complaint_model(spark, c):
    return _stored_model(
        spark, narratives.train_response_model(c, label_col="company_response_to_consumer", tokens_col="tokens")
    )


def _train_response_model(spark, d):
    corpus = documents_corpus(spark, d)
    return narratives.model_summary(_stored_model(spark, narratives.train_response_model(corpus, "text", "lang")))


def _train_complaint_model(spark, d):
    """The fit on the complaint columns themselves."""
    c = _view(spark, d, "consumer_complaint_narrative", "company_response_to_consumer")
    model = narratives.train_response_model(c, "consumer_complaint_narrative", "company_response_to_consumer")
    return narratives.model_summary(_stored_model(spark, model))


def _train_weighted_model(spark, d):
    """The fit without stop words, terms weighted by inverse document frequency."""
    corpus = documents_corpus(spark, d)
    model = narratives.train_response_model(corpus, "text", "lang", stop_words=STOP_WORDS, idf=True)
    return narratives.model_summary(_stored_model(spark, model))


def _score_narratives(spark, d):
    """Every document scored: id, predicted label and the top probability as
    two-decimal percent text (the reference's record)."""
    docs = _document_tokens(spark, d)
    scored = narratives.score_narratives(_language_model(spark, docs), docs, tokens_col="tokens")
    return scored.select("doc_id", "prediction", "probability_pct")


def _score_weighted(spark, d):
    """As above, by the model without stop words and with document frequencies."""
    docs = _document_tokens(spark, d, STOP_WORDS)
    scored = narratives.score_narratives(_language_model(spark, docs, idf=True), docs, tokens_col="tokens")
    return scored.select("doc_id", "prediction", "probability_pct")


def _score_complaints(spark, d):
    """Every complaint's narrative scored by the model of the complaint
    columns, one row per complaint (ids repeat in the test data)."""
    c = _complaint_tokens(spark, d)
    scored = narratives.score_narratives(_complaint_model(spark, c), c, id_col="complaint_id", tokens_col="tokens")
    return scored.select("complaint_id", "prediction", "probability_pct")


def _narratives_csv(spark, d):
    """The documents written as CSV, quoted and over many lines, and read
    back by splits."""
    docs = documents_corpus(spark, d).select("doc_id", "text")
    path = scratch_path(spark, "narratives-csv")
    quoted = {"header": True, "quote": '"', "escape": '"', "quoteAll": True}
    docs.write.options(**quoted, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    found = read_narratives_split(spark, path, "doc_id long, text string", text_index=1)
    text = F.coalesce("narrative", F.lit(""))
    return found.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def _catalog_counts(spark, d):
    """Complaints per product and state from a catalog table with column
    names of its own."""
    path, name = scratch_path(spark, "catalog"), f"complaints_{uuid.uuid4().hex}"
    view = _view(spark, d, "complaint_id", "product", "state", "date_received")
    view.select(
        F.col("complaint_id").alias("Complaint ID"), F.col("product").alias("Product"), "state",
        F.col("date_received").alias("Date received"),
    ).write.parquet(path)
    spark.catalog.createTable(name, path, source="parquet")
    names = {"complaint_id": "Complaint ID", "product": "Product", "date_received": "Date received"}
    c = read_complaints_table(spark, name, names)
    return c.groupBy("product", "state").agg(
        F.count(F.lit(1)).alias("complaints"), F.min("date_received").alias("first_received"))


def _dispute_by_response_bound(spark, d):
    """The SQL form with bound values, over a temporary view."""
    name = f"complaints_{uuid.uuid4().hex}"
    _view(spark, d, "company_response_to_consumer", "consumer_disputed").createOrReplaceTempView(name)
    return outcomes.dispute_by_response_sql(spark, name)


def _top_issue_share(spark, d):
    return trends.top_issue_per_year(_view(spark, d, "date_received", "issue"), with_totals=True)


def _year_marks(spark, d):
    """The slider's marks, one map, as JSON text."""
    return trends.year_marks(_view(spark, d, "date_received"), MIN_YEAR, WINDOW).select(F.to_json("marks").alias("marks"))


def _lists_as_map(lists: DataFrame, key: str, values: str, *order: str) -> DataFrame:
    """Key -> list rows as one map in the order of ``order``, as JSON text."""
    entries = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], key, values)))
    pairs = F.transform(entries, lambda x: F.struct(x[key], x[values]))
    return lists.agg(F.to_json(F.map_from_entries(pairs)).alias("lists"))


def _product_subproduct_map(spark, d):
    lists = counts.product_subproduct_lists(_view(spark, d, "product", "subproduct", "state"), as_arrays=True)
    return _lists_as_map(lists, "product", "subproducts", "product")


def _issue_subissue_map(spark, d):
    lists = counts.issue_subissue_lists(_view(spark, d, "issue", "subissue"), as_arrays=True)
    return _lists_as_map(lists, "issue", "subissues", "issue_position")


def _sample_records(spark, d):
    """The sample as the record list of the table page: one JSON text a row."""
    return profile.sample_records(_sample_rows(spark, d))


def _ordered(name: str, *lead: tuple[str, bool]) -> Query:
    """A grouped result with the place of each row: ``lead`` (column,
    descending), then all columns ascending."""

    def query(spark, d):
        columns = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in lead]
        return with_position(QUERIES[name](spark, d), *columns)

    return query


def _sample_narratives(spark, d):
    docs = documents_corpus(spark, d)
    return narratives.sample_narratives(docs, "doc_id", k=5, seed=42).select("doc_id", "lang")


def _score_sample(spark, d):
    corpus = documents_corpus(spark, d)
    model = _stored_model(spark, narratives.train_response_model(corpus, "text", "lang"))
    return narratives.score_sample(model, corpus, "text", "doc_id", k=1, seed=42)


QUERIES: dict[str, Query] = {
    "sample_rows": _sample_rows,
    "missing_counts": _missing_counts,
    "product_counts": _product_counts,
    "product_totals": _product_totals,
    "product_options": _product_options,
    "products": _products,
    "product_subproduct_state": _product_subproduct_state,
    "product_subproduct_lists": _product_subproduct_lists,
    "subproducts_for": _subproducts_for,
    "state_counts_for": _state_counts_for,
    "issue_counts": _issue_counts,
    "issue_subissue_counts": _issue_subissue_counts,
    "issue_totals": _issue_totals,
    "top_issues": _top_issues,
    "top_issue_subissue": _top_issue_subissue,
    "issue_subissue_lists": _issue_subissue_lists,
    "subissues_for": _subissues_for,
    "channel_response_counts": _channel_response_counts,
    "channel_response_totals": _channel_response_totals,
    "channel_response_crosstab": _channel_response_crosstab,
    "expected_counts": _expected_counts,
    "subissue_dispute_crosstab": _subissue_dispute_crosstab,
    "subissue_dispute_expected": _subissue_dispute_expected,
    "chi_square_channel_response": _statistic("submitted_via", "company_response_to_consumer"),
    "chi_square_presence": _statistic("subissue", "consumer_disputed", "presence"),
    "chi_square_subissue_dispute": _statistic("subissue", "consumer_disputed"),
    # a 2x2 table on the whole view (dof 1): Yates' correction
    "chi_square_public_response_dispute": _statistic("company_public_response", "consumer_disputed"),
    "chi_square_report": _report("submitted_via", "company_response_to_consumer"),
    "chi_square_report_rejects": _report("subissue", "consumer_disputed"),
    "subproducts_of_standard": _subproducts_of("STANDARD"),
    "subproducts_of_missing": _subproducts_of("No such product"),
    "state_counts_of_pair": _states_of("STANDARD", "Brand#3"),
    "subissues_of_unknown": _subissues_of("Unknown"),
    "product_trend_of_standard": _product_trend_of("STANDARD"),
    "train_complaint_model": _train_complaint_model,
    "score_complaints": _score_complaints,
    "train_weighted_model": _train_weighted_model,
    "score_weighted": _score_weighted,
    "daily_trend": _daily_trend,
    "trend_for_year": _trend_for_year,
    "trend_for_first_year": _trend_for_first_year,
    "trend_year_domain": _trend_year_domain,
    "response_trend": _response_trend,
    "response_trend_wide": _response_trend_wide,
    "product_trend": _product_trend,
    "product_trend_for": _product_trend_for,
    "top_issue_per_year": _top_issue_per_year,
    "response_composition": _response_composition,
    "dispute_by_response": _dispute_by_response,
    "train_response_model": _train_response_model,
    "score_narratives": _score_narratives,
    "sample_narratives": _sample_narratives,
    "score_sample": _score_sample,
    "narratives_csv": _narratives_csv,
    "catalog_counts": _catalog_counts,
    "dispute_by_response_bound": _dispute_by_response_bound,
    "top_issue_share": _top_issue_share,
    "year_marks": _year_marks,
    "product_subproduct_map": _product_subproduct_map,
    "issue_subissue_map": _issue_subissue_map,
    "sample_records": _sample_records,
}

# Grouped results in the order they are shown in: largest first, by date, or
# by year and then largest first.
DISPLAY_ORDER: dict[str, list[tuple[str, bool]]] = {
    "product_counts": [("Counts_Complaints", True)],
    "product_subproduct_state": [("Counts_Complaints", True)],
    "issue_counts": [("count", True)],
    "issue_subissue_counts": [("count", True)],
    "channel_response_counts": [("Count_Response", True)],
    "daily_trend": [("date_received", False)],
    "response_trend": [("date_received", False)],
    "product_trend": [("date_received", False)],
    "top_issue_per_year": [("year", False), ("count", True)],
}
QUERIES.update({f"{name}_ordered": _ordered(name, *lead) for name, lead in DISPLAY_ORDER.items()})


# ---------------------------------------------------------------------------
# Oracle side (DuckDB).  Ties: count descending, then keys ascending.

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in mapping.items())
    return f"CAST(CASE {col} {whens} END AS VARCHAR)"


_ALL_ORDER = ", ".join(f"{x} ASC NULLS FIRST" for x in COMPLAINT_COLUMNS)

_ISSUE_PAIRS = """
pairs AS (
  SELECT COALESCE(issue, 'Unknown') AS issue, COALESCE(subissue, 'Unknown') AS subissue,
         COUNT(issue) AS count
  FROM complaints
  GROUP BY COALESCE(issue, 'Unknown'), COALESCE(subissue, 'Unknown')
)"""

_PSS = """
pss AS (
  SELECT product, subproduct, state, COUNT(state) AS Counts_Complaints
  FROM complaints WHERE subproduct IS NOT NULL
  GROUP BY product, subproduct, state
),
lists AS (
  SELECT product, subproduct,
         ROW_NUMBER() OVER (PARTITION BY product ORDER BY MAX(Counts_Complaints) DESC,
                                                         subproduct ASC) AS position
  FROM pss WHERE product IS NOT NULL
  GROUP BY product, subproduct
),
top_product AS (
  SELECT product FROM complaints WHERE subproduct IS NOT NULL AND product IS NOT NULL
  GROUP BY product ORDER BY COUNT(product) DESC, product ASC LIMIT 1
)"""

_DAILY = f"""
daily AS (
  SELECT date_received, COUNT(*) AS count FROM complaints GROUP BY date_received
),
trend AS (
  SELECT date_received, count,
         CASE WHEN COUNT(*) OVER w >= {WINDOW} THEN AVG(count) OVER w END AS monthly_mva
  FROM daily
  WINDOW w AS (ORDER BY date_received ASC NULLS FIRST
               ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
),
cut AS (SELECT * FROM trend WHERE year(date_received) >= {MIN_YEAR})"""


def _category_trend_sql(cat: str, tail: str = "SELECT * FROM smoothed") -> str:
    return f"""
WITH complaints AS ({VIEW_SQL}),
counts AS (
  SELECT date_received, {cat}, COUNT(*) AS count FROM complaints
  WHERE {cat} IS NOT NULL GROUP BY date_received, {cat}
),
axis AS (SELECT DISTINCT date_received FROM counts),
cats AS (SELECT DISTINCT {cat} FROM counts),
grid AS (
  SELECT a.date_received, k.{cat}, COALESCE(n.count, 0) AS count
  FROM axis a CROSS JOIN cats k
  LEFT JOIN counts n ON n.date_received = a.date_received AND n.{cat} = k.{cat}
),
smoothed AS (
  SELECT date_received, {cat}, count,
         CASE WHEN COUNT(*) OVER w >= {WINDOW} THEN AVG(count) OVER w END AS monthly_mva
  FROM grid
  WINDOW w AS (PARTITION BY {cat} ORDER BY date_received ASC NULLS FIRST
               ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
)
{tail}"""


def _cells_sql(row: str, col: str) -> str:
    return f"""WITH complaints AS ({VIEW_SQL}), cells AS (
  SELECT {row} AS r, {col} AS c, COUNT(*) AS n FROM complaints
  WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2)"""


def _crosstab_sql(row: str, col: str) -> str:
    return f"""{_cells_sql(row, col)}
SELECT rk.r AS {row}, ck.c AS {col}, COALESCE(cells.n, 0) AS n
FROM (SELECT DISTINCT r FROM cells) rk CROSS JOIN (SELECT DISTINCT c FROM cells) ck
LEFT JOIN cells ON cells.r = rk.r AND cells.c = ck.c"""


def _expected_sql(row: str, col: str) -> str:
    return f"""{_cells_sql(row, col)},
rm AS (SELECT r, SUM(n) AS rt FROM cells GROUP BY r),
cm AS (SELECT c, SUM(n) AS ct FROM cells GROUP BY c)
SELECT rm.r AS {row}, cm.c AS {col}, CAST(COALESCE(cells.n, 0) AS BIGINT) AS observed,
  CAST(rm.rt AS DOUBLE) * CAST(cm.ct AS DOUBLE) / CAST((SELECT SUM(n) FROM cells) AS DOUBLE) AS expected
FROM rm CROSS JOIN cm LEFT JOIN cells ON cells.r = rm.r AND cells.c = cm.c"""


def _chi_square_sql(row: str, col: str, weight: str) -> str:
    """The statistic in SQL: observed cells summed in key order, unobserved
    cells through their exact expected total, Yates for a 2x2 table."""
    observed = "COUNT(*)" if weight == "count" else "1"
    return f"""
WITH complaints AS ({VIEW_SQL}),
cells AS (
  SELECT {row} AS k1, {col} AS k2, CAST({observed} AS BIGINT) AS o FROM complaints
  WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY {row}, {col}
),
rm AS (SELECT k1, SUM(o) AS rt FROM cells GROUP BY k1),
cm AS (SELECT k2, SUM(o) AS ct FROM cells GROUP BY k2),
tot AS (SELECT CAST(SUM(o) AS BIGINT) AS n FROM cells),
terms AS (
  SELECT cells.k1, cells.k2,
         CAST(rm.rt AS DOUBLE) * CAST(cm.ct AS DOUBLE) / CAST(tot.n AS DOUBLE) AS e,
         CAST(cells.o AS DOUBLE) AS o,
         CAST(rm.rt AS DECIMAL(38, 0)) * CAST(cm.ct AS DECIMAL(38, 0)) AS rc
  FROM cells JOIN rm ON rm.k1 = cells.k1 JOIN cm ON cm.k2 = cells.k2, tot
),
stat AS (
  SELECT SUM((o - e) * (o - e) / e ORDER BY k1, k2)
           + CAST(CAST(MAX(tot.n) AS DECIMAL(38, 0)) * CAST(MAX(tot.n) AS DECIMAL(38, 0)) - SUM(rc)
                  AS DOUBLE) / CAST(MAX(tot.n) AS DOUBLE) AS plain,
         CAST(MAX(tot.n) AS DOUBLE)
           * (SELECT SUM(1.0 / CAST(rt AS DOUBLE) ORDER BY k1) FROM rm)
           * (SELECT SUM(1.0 / CAST(ct AS DOUBLE) ORDER BY k2) FROM cm) AS inv_e,
         (SELECT COUNT(*) FROM rm) AS n_rows, (SELECT COUNT(*) FROM cm) AS n_cols,
         MAX(tot.n) AS n
  FROM terms, tot
),
fin AS (
  SELECT *, CAST((n_rows - 1) * (n_cols - 1) AS BIGINT) AS dof,
         SQRT(GREATEST(plain, 0.0) / inv_e) AS gap
  FROM stat
)
SELECT ROUND(CAST(CASE WHEN dof = 0 THEN 0.0
                 WHEN dof = 1 THEN POWER(gap - LEAST(0.5, gap), 2) * inv_e
                 ELSE plain END AS DOUBLE), 10) AS chi2,
       dof, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_cols AS BIGINT) AS n_cols, n
FROM fin"""


def _chi_square_report_sql(row: str, col: str) -> str:
    """The p-value Q(dof / 2, chi2 / 2) by the series of the lower incomplete
    gamma function, its terms in logarithms."""
    return f"""
WITH stat AS ({_chi_square_sql(row, col, "count")}),
p AS (
  SELECT *, CASE WHEN dof = 0 THEN 1.0 WHEN chi2 <= 0 THEN 1.0 ELSE GREATEST(0.0, 1.0 - (
    SELECT SUM(exp(k * ln(chi2 / 2) - chi2 / 2 + dof / 2.0 * ln(chi2 / 2) - lgamma(dof / 2.0 + k + 1)))
    FROM generate_series(0, 100000) AS g(k))) END AS q
  FROM stat
)
SELECT chi2, ROUND(CAST(q AS DOUBLE), 10) AS p_value, dof, n_rows, n_cols, n,
  CASE WHEN q < 0.05 THEN {_quote(association.REJECT_TEXT)} ELSE {_quote(association.ACCEPT_TEXT)} END
    AS interpretation,
  'Chi-square statistic: ' || printf('%.6f', chi2) || ', p-value: ' || printf('%.6f', CAST(q AS DOUBLE))
    || ', Degrees of freedom: ' || CAST(dof AS VARCHAR) AS summary
FROM p"""


# Complement Naive Bayes in SQL: every labelled row trains, tokens are maximal
# runs of 2+ letters/digits/underscores, lower-cased, smoothing 1, classes in
# alphabetical order, arg-max with ties to the first class.
_NB_TRAIN = "train AS (SELECT lang, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),"
def _nb_fit(idf: bool = False, stop_words: tuple[str, ...] = ()) -> str:
    stop = ", ".join(_quote(x) for x in ("", *stop_words))
    weight = "ln(CAST((SELECT COUNT(*) FROM train) + 1 AS DOUBLE) / (COUNT(DISTINCT doc) + 1))" if idf else "1.0"
    return rf"""
numbered AS (SELECT row_number() OVER () AS doc, lang, text FROM train),
words AS (
  SELECT * FROM (
    SELECT doc, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM numbered)
  WHERE term NOT IN ({stop})
),
class_term AS (SELECT lang, term, COUNT(*) AS n FROM words GROUP BY lang, term),
vocab AS (SELECT term, COUNT(*) AS f, CAST({weight} AS DOUBLE) AS idf FROM words GROUP BY term),
classes AS (
  SELECT t.lang, COALESCE(SUM(ct.n), 0) AS nk, COALESCE(SUM(ct.n * v.idf), 0) AS wk
  FROM (SELECT DISTINCT lang FROM train) t LEFT JOIN class_term ct ON ct.lang = t.lang
  LEFT JOIN vocab v ON v.term = ct.term
  GROUP BY t.lang
),
consts AS (SELECT SUM(f * idf) AS total, COUNT(*) AS v FROM vocab),
theta AS (
  SELECT k.lang, vo.term,
         -vo.idf * (ln(CAST((vo.f - COALESCE(ct.n, 0)) * vo.idf + 1 AS DOUBLE))
           - ln(CAST(c.total - k.wk + c.v AS DOUBLE))) AS w
  FROM classes k CROSS JOIN vocab vo CROSS JOIN consts c
  LEFT JOIN class_term ct ON ct.lang = k.lang AND ct.term = vo.term
)"""


_NB_FIT = _nb_fit()
_NB_SUMMARY = """
SELECT k.lang AS label, CAST(DENSE_RANK() OVER (ORDER BY k.lang ASC) - 1 AS INTEGER) AS label_index,
  CAST((SELECT COUNT(*) FROM train t WHERE t.lang = k.lang) AS BIGINT) AS documents, CAST(k.nk AS BIGINT) AS tokens,
  ROUND((SELECT SUM(w) FROM theta th WHERE th.lang = k.lang), 3) AS weight_sum
FROM classes k"""
#: Every row of scored_docs (rec, doc_id, text) by its own text.
_NB_SCORE = r""",
doc_tf AS (
  SELECT rec, term, COUNT(*) AS x FROM (
    SELECT rec, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
    FROM scored_docs)
  GROUP BY rec, term
),
raw AS (
  SELECT t.rec, th.lang, SUM(t.x * th.w) AS s
  FROM doc_tf t JOIN theta th ON th.term = t.term GROUP BY t.rec, th.lang
),
scores AS (
  SELECT d.rec, d.doc_id, k.lang, COALESCE(r.s, 0.0) AS s
  FROM scored_docs d CROSS JOIN classes k
  LEFT JOIN raw r ON r.rec = d.rec AND r.lang = k.lang
),
best AS (
  SELECT rec, MAX(s) AS smax,
         first(lang ORDER BY s DESC, lang ASC) AS prediction
  FROM scores GROUP BY rec
),
prob AS (
  SELECT b.rec, any_value(sc.doc_id) AS doc_id, b.prediction, 1.0 / SUM(exp(sc.s - b.smax)) AS p
  FROM best b JOIN scores sc ON sc.rec = b.rec GROUP BY b.rec, b.prediction
)"""
_SCORED = ", scored_docs AS (SELECT row_number() OVER () AS rec, doc_id, text FROM documents WHERE text IS NOT NULL)"
_NB_SQL = (
    _NB_TRAIN + _NB_FIT + _SCORED + _NB_SCORE
)
_NB_COMPLAINTS = f"""WITH complaints AS ({VIEW_SQL}),
train AS (SELECT company_response_to_consumer AS lang, consumer_complaint_narrative AS text FROM complaints
  WHERE company_response_to_consumer IS NOT NULL AND consumer_complaint_narrative IS NOT NULL),
{_NB_FIT}"""

ORACLE_SQL: dict[str, str] = {
    "sample_rows": _with_view(f"SELECT * FROM complaints ORDER BY {_ALL_ORDER} LIMIT 5"),
    "missing_counts": _with_view(
        "SELECT "
        + ",\n  ".join(f"CAST(COUNT_IF({x} IS NULL) AS BIGINT) AS {x}_missing_count" for x in NULL_PROFILE_COLUMNS)
        + "\nFROM complaints"
    ),
    "product_counts": _with_view(
        f"""SELECT product, COUNT(product) AS Counts_Complaints,
  {_case_map("product", PRODUCT_LABELS)} AS product_abbr
FROM complaints WHERE subproduct IS NOT NULL GROUP BY product"""
    ),
    "product_totals": _with_view(
        f"""SELECT *, CAST(SUM(Counts_Complaints) OVER (PARTITION BY product_abbr) AS BIGINT) AS total FROM (
  SELECT product, COUNT(product) AS Counts_Complaints, {_case_map("product", PRODUCT_LABELS)} AS product_abbr
  FROM complaints WHERE subproduct IS NOT NULL GROUP BY product)"""
    ),
    "product_options": _with_view(
        """SELECT CAST(ROW_NUMBER() OVER (ORDER BY COUNT(product) DESC, product ASC) AS INTEGER)
         AS position, product AS label, product AS value
FROM complaints WHERE subproduct IS NOT NULL AND product IS NOT NULL GROUP BY product"""
    ),
    "products": _with_view(
        """SELECT CAST(ROW_NUMBER() OVER (ORDER BY COUNT(product) DESC, product ASC) AS INTEGER)
         AS position, product
FROM complaints WHERE subproduct IS NOT NULL AND product IS NOT NULL GROUP BY product"""
    ),
    "product_subproduct_state": _with_view(
        """SELECT product, subproduct, state, COUNT(state) AS Counts_Complaints
FROM complaints WHERE subproduct IS NOT NULL GROUP BY product, subproduct, state"""
    ),
    "product_subproduct_lists": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT product, CAST(position AS INTEGER) AS position, subproduct FROM lists",
    "subproducts_for": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT product, CAST(position AS INTEGER) AS position, subproduct FROM lists "
    "WHERE product = (SELECT product FROM top_product)",
    "state_counts_for": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT state, Counts_Complaints FROM pss WHERE product = (SELECT product FROM top_product) "
    "AND subproduct = (SELECT subproduct FROM lists WHERE position = 1 "
    "AND product = (SELECT product FROM top_product))",
    "issue_counts": _with_view(
        """SELECT COALESCE(issue, 'Unknown') AS issue, COUNT(issue) AS count
FROM complaints GROUP BY COALESCE(issue, 'Unknown')"""
    ),
    "issue_subissue_counts": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS}\nSELECT * FROM pairs",
    "issue_totals": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS}\n"
    "SELECT issue, CAST(SUM(count) AS BIGINT) AS count,\n"
    "  CAST(ROW_NUMBER() OVER (ORDER BY SUM(count) DESC, issue ASC) AS INTEGER) AS position\n"
    "FROM pairs GROUP BY issue",
    "top_issues": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS}\n"
    "SELECT issue, CAST(SUM(count) AS BIGINT) AS count FROM pairs GROUP BY issue\n"
    "ORDER BY count DESC, issue ASC LIMIT 3",
    "top_issue_subissue": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS},\n"
    "top AS (SELECT issue FROM pairs GROUP BY issue ORDER BY SUM(count) DESC, issue ASC LIMIT 3),\n"
    "kept AS (SELECT * FROM pairs WHERE issue IN (SELECT issue FROM top)\n"
    "         ORDER BY count DESC, issue ASC, subissue ASC LIMIT 10),\n"
    "labelled AS (SELECT *, " + _case_map("issue", ISSUE_LABELS) + " AS issue_abbrev FROM kept)\n"
    "SELECT issue, subissue, count, issue_abbrev,\n"
    "  CAST(SUM(count) OVER (PARTITION BY issue_abbrev) AS BIGINT) AS issue_total FROM labelled",
    "issue_subissue_lists": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS},\n"
    "totals AS (SELECT issue, SUM(count) AS total FROM pairs GROUP BY issue),\n"
    "ranked AS (SELECT issue, ROW_NUMBER() OVER (ORDER BY total DESC, issue ASC) AS ip FROM totals)\n"
    "SELECT p.issue, CAST(r.ip AS INTEGER) AS issue_position,\n"
    "  CAST(ROW_NUMBER() OVER (PARTITION BY p.issue ORDER BY p.count DESC, p.subissue ASC) AS INTEGER)\n"
    "    AS position, p.subissue\n"
    "FROM pairs p JOIN ranked r ON r.issue = p.issue",
    "subissues_for": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS}\n"
    "SELECT subissue, count FROM pairs WHERE issue = (SELECT issue FROM pairs GROUP BY issue\n"
    "  ORDER BY SUM(count) DESC, issue ASC LIMIT 1)",
    "channel_response_counts": _with_view(
        """SELECT submitted_via, company_response_to_consumer, COUNT(*) AS Count_Response
FROM complaints GROUP BY submitted_via, company_response_to_consumer"""
    ),
    "channel_response_totals": _with_view(
        """SELECT *, CAST(SUM(Count_Response) OVER (PARTITION BY submitted_via) AS BIGINT) AS total FROM (
  SELECT submitted_via, company_response_to_consumer, COUNT(*) AS Count_Response
  FROM complaints GROUP BY submitted_via, company_response_to_consumer)"""
    ),
    "channel_response_crosstab": _crosstab_sql("submitted_via", "company_response_to_consumer"),
    "expected_counts": _expected_sql("submitted_via", "company_response_to_consumer"),
    "subissue_dispute_crosstab": _crosstab_sql("subissue", "consumer_disputed"),
    "subissue_dispute_expected": _expected_sql("subissue", "consumer_disputed"),
    "chi_square_channel_response": _chi_square_sql(
        "submitted_via", "company_response_to_consumer", "count"
    ),
    "chi_square_presence": _chi_square_sql("subissue", "consumer_disputed", "presence"),
    "chi_square_report": _chi_square_report_sql("submitted_via", "company_response_to_consumer"),
    "chi_square_report_rejects": _chi_square_report_sql("subissue", "consumer_disputed"),
    "subproducts_of_standard": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT product, CAST(position AS INTEGER) AS position, subproduct FROM lists WHERE product = 'STANDARD'",
    "subproducts_of_missing": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT product, CAST(position AS INTEGER) AS position, subproduct FROM lists WHERE product = 'No such product'",
    "state_counts_of_pair": f"WITH complaints AS ({VIEW_SQL}), {_PSS}\n"
    "SELECT state, Counts_Complaints FROM pss WHERE product = 'STANDARD' AND subproduct = 'Brand#3'",
    "subissues_of_unknown": f"WITH complaints AS ({VIEW_SQL}), {_ISSUE_PAIRS}\n"
    "SELECT subissue, count FROM pairs WHERE issue = 'Unknown'",
    "product_trend_of_standard": _category_trend_sql("product", "SELECT * FROM smoothed WHERE product = 'STANDARD'"),
    "chi_square_subissue_dispute": _chi_square_sql("subissue", "consumer_disputed", "count"),
    "chi_square_public_response_dispute": _chi_square_sql(
        "company_public_response", "consumer_disputed", "count"
    ),
    "daily_trend": f"WITH complaints AS ({VIEW_SQL}), {_DAILY}\nSELECT * FROM cut",
    "trend_for_year": f"WITH complaints AS ({VIEW_SQL}), {_DAILY}\n"
    f"SELECT * FROM cut WHERE year(date_received) = {YEAR}",
    "trend_for_first_year": f"WITH complaints AS ({VIEW_SQL}), {_DAILY}\n"
    "SELECT * FROM cut WHERE year(date_received) = (SELECT MIN(year(date_received)) FROM cut)",
    "trend_year_domain": f"WITH complaints AS ({VIEW_SQL}), {_DAILY},\n"
    "years AS (SELECT DISTINCT CAST(year(date_received) AS INTEGER) AS year FROM cut\n"
    "          WHERE date_received IS NOT NULL)\n"
    "SELECT year, CAST(year AS VARCHAR) AS mark, MIN(year) OVER () AS year_min,\n"
    "  MAX(year) OVER () AS year_max FROM years",
    "response_trend": _category_trend_sql("company_response_to_consumer"),
    "response_trend_wide": f"""WITH complaints AS ({VIEW_SQL}),
counts AS (
  SELECT date_received, company_response_to_consumer, COUNT(*) AS n FROM complaints
  WHERE company_response_to_consumer IS NOT NULL GROUP BY 1, 2
)
SELECT * FROM (PIVOT counts ON company_response_to_consumer
               IN ({", ".join(_quote(x) for x in RESPONSES)}) USING COALESCE(FIRST(n), 0)
               GROUP BY date_received)""",
    "product_trend": _category_trend_sql("product"),
    "product_trend_for": _category_trend_sql(
        "product", "SELECT * FROM smoothed WHERE product = (SELECT MIN(product) FROM cats)"
    ),
    "top_issue_per_year": _with_view(
        """, counts AS (
  SELECT CAST(year(date_received) AS INTEGER) AS year, issue, COUNT(*) AS count
  FROM complaints GROUP BY 1, 2),
labelled AS (SELECT year, COALESCE(issue, 'Unknown') AS issue, count FROM counts
             WHERE year IS NOT NULL)
SELECT year, issue, count FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY count DESC, issue ASC) AS rk
  FROM labelled) WHERE rk = 1"""
    ),
    "response_composition": _with_view(
        """SELECT company_response_to_consumer, COUNT(*) AS count,
  CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
FROM complaints WHERE company_response_to_consumer IS NOT NULL
GROUP BY company_response_to_consumer"""
    ),
    "train_response_model": f"WITH {_NB_TRAIN}{_NB_FIT}{_NB_SUMMARY}",
    "train_complaint_model": f"{_NB_COMPLAINTS}{_NB_SUMMARY}",
    "score_complaints": f"""{_NB_COMPLAINTS}, scored_docs AS (
  SELECT row_number() OVER () AS rec, complaint_id AS doc_id, consumer_complaint_narrative AS text FROM complaints
  WHERE consumer_complaint_narrative IS NOT NULL){_NB_SCORE}
SELECT doc_id AS complaint_id, prediction, printf('%.2f', 100.0 * p) AS probability_pct FROM prob""",
    "train_weighted_model": f"WITH {_NB_TRAIN}{_nb_fit(True, STOP_WORDS)}{_NB_SUMMARY}",
    "score_weighted": f"""WITH {_NB_TRAIN}{_nb_fit(True, STOP_WORDS)}{_SCORED}{_NB_SCORE}
SELECT doc_id, prediction, printf('%.2f', 100.0 * p) AS probability_pct FROM prob""",
    "score_narratives": f"""WITH {_NB_SQL}
SELECT doc_id, prediction, printf('%.2f', 100.0 * p) AS probability_pct FROM prob""",
    "score_sample": f"""WITH {_NB_SQL},
picked AS (
  SELECT doc_id, text FROM documents WHERE text IS NOT NULL
  ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 1
)
SELECT p.doc_id, k.text AS Narratives, p.prediction AS Prediction,
       printf('%.2f', 100.0 * p.p) AS Probability
FROM picked k JOIN prob p ON p.doc_id = k.doc_id""",
    "sample_narratives": """
SELECT doc_id, lang FROM documents WHERE text IS NOT NULL
ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 5""",
    "dispute_by_response": _with_view(
        """SELECT company_response_to_consumer AS Response,
  CASE WHEN consumer_disputed THEN 'True' ELSE 'False' END AS Dispute,
  COUNT(*) AS Count_response,
  CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER (PARTITION BY company_response_to_consumer)
    AS DOUBLE) AS share
FROM complaints
WHERE company_response_to_consumer IS NOT NULL
  AND company_response_to_consumer IN ('Closed', 'Closed with explanation',
      'Closed with monetary relief', 'Closed with non-monetary relief')
  AND consumer_disputed IS NOT NULL
GROUP BY 1, 2"""
    ),
}

ORACLE_SQL.update({
    "narratives_csv": """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL""",
    "catalog_counts": _with_view(
        "SELECT product, state, COUNT(*) AS complaints, MIN(date_received) AS first_received FROM complaints GROUP BY product, state"
    ),
    "dispute_by_response_bound": ORACLE_SQL["dispute_by_response"],
    "top_issue_share": _with_view(
        """, counts AS (
  SELECT CAST(year(date_received) AS INTEGER) AS year, COALESCE(issue, 'Unknown') AS issue, COUNT(*) AS count
  FROM complaints WHERE date_received IS NOT NULL GROUP BY 1, complaints.issue),
ranked AS (SELECT *, CAST(SUM(count) OVER (PARTITION BY year) AS BIGINT) AS total,
  ROW_NUMBER() OVER (PARTITION BY year ORDER BY count DESC, issue ASC) AS rk FROM counts)
SELECT year, issue, count, total, CAST(count AS DOUBLE) / total AS share FROM ranked WHERE rk = 1"""
    ),
    "year_marks": f"WITH complaints AS ({VIEW_SQL}), {_DAILY},\n"
    "years AS (SELECT DISTINCT CAST(year(date_received) AS VARCHAR) AS mark FROM cut WHERE date_received IS NOT NULL)\n"
    "SELECT '{' || string_agg('\"' || mark || '\":\"' || mark || '\"', ',' ORDER BY mark) || '}' AS marks FROM years",
    "product_subproduct_map": f"WITH complaints AS ({VIEW_SQL}), {_PSS},\n"
    "rows AS (SELECT product, to_json(list(subproduct ORDER BY position)) AS subs FROM lists GROUP BY product)\n"
    "SELECT '{' || string_agg(CAST(to_json(product) AS VARCHAR) || ':' || CAST(subs AS VARCHAR), ',' ORDER BY product) || '}'\n"
    "  AS lists FROM rows",
    "sample_records": "SELECT CAST(to_json(struct_pack("
    + ", ".join(f"{x} := {x}" for x in COMPLAINT_COLUMNS)
    + f")) AS VARCHAR) AS record FROM ({ORACLE_SQL['sample_rows']})",
    "issue_subissue_map": f"WITH lists AS ({ORACLE_SQL['issue_subissue_lists']}),\n"
    "rows AS (SELECT issue, issue_position, to_json(list(subissue ORDER BY position)) AS subs FROM lists GROUP BY 1, 2)\n"
    "SELECT '{' || string_agg(CAST(to_json(issue) AS VARCHAR) || ':' || CAST(subs AS VARCHAR), ',' ORDER BY issue_position)\n"
    "  || '}' AS lists FROM rows",
})


def _ordered_sql(name: str, columns: list[str]) -> str:
    lead = [f'"{c}" DESC NULLS LAST' if down else f'"{c}" ASC NULLS FIRST' for c, down in DISPLAY_ORDER[name]]
    order = ", ".join([*lead, *[f'"{c}" ASC NULLS FIRST' for c in columns]])
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({ORACLE_SQL[name]})"


#: Columns of the ordered results, in the operators' order: it breaks ties.
_COLUMNS = {
    "product_counts": ["product", "Counts_Complaints", "product_abbr"],
    "product_subproduct_state": ["product", "subproduct", "state", "Counts_Complaints"],
    "issue_counts": ["issue", "count"],
    "issue_subissue_counts": ["issue", "subissue", "count"],
    "channel_response_counts": ["submitted_via", "company_response_to_consumer", "Count_Response"],
    "daily_trend": ["date_received", "count", "monthly_mva"],
    "response_trend": ["date_received", "company_response_to_consumer", "count", "monthly_mva"],
    "product_trend": ["date_received", "product", "count", "monthly_mva"],
    "top_issue_per_year": ["year", "issue", "count"],
}
ORACLE_SQL.update({f"{name}_ordered": _ordered_sql(name, columns) for name, columns in _COLUMNS.items()})
