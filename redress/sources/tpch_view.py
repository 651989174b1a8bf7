"""A complaints table derived from the driver's TPC-H style tables.

The test data holds no complaints, so one complaint is made per ``lineitem``
row, and the other tables supply the attributes.  Nulls are made on purpose
(the source tables have none) so that every null rule of the operators is
exercised.  ``VIEW_SQL`` is the definition as SQL; the oracle queries use it
verbatim, and :func:`complaints_view` builds the same rows with the
DataFrame API.

Scale
-----
:func:`complaints_view` joins only the tables that the requested columns
need.  The dropped joins are inner joins along foreign keys (lineitem ->
orders -> customer -> nation, lineitem -> part, lineitem -> supplier) plus a
left join to ``documents`` that matches at most one document per order, so
leaving them out changes no row when the keys are intact, which TPC-H
guarantees and ``tests/test_sources.py`` checks.  A daily count therefore
reads ``lineitem.l_orderkey`` and ``orders(o_orderkey, o_orderdate)`` only,
and never touches the document texts.

Dimension attributes are attached at the order level first (orders ->
customer -> nation), so ``lineitem`` is joined once to an orders-sized
frame.  No join between tables is hinted: the big joins are shuffle joins
on their keys, and Spark broadcasts ``nation`` (and, at small scale factors,
``part`` and ``supplier``) only when its size statistics are under the
broadcast threshold.  The only hints are in the smallest-id restriction: at
most ``first_ids`` ids, and keys of at most ``RESTRICT_ROWS`` counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.sources.complaints import COMPLAINT_COLUMNS

# The definition, one SQL text that runs unchanged on Spark and DuckDB.
VIEW_SQL = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS complaint_id,
  CAST(o.o_orderdate AS DATE) AS date_received,
  NULLIF(p.p_type, 'ECONOMY') AS product,
  NULLIF(p.p_brand, 'Brand#2') AS subproduct,
  CASE WHEN l.l_quantity <= 5 THEN NULL WHEN l.l_quantity <= 6 THEN 'Unknown'
       ELSE CONCAT('issue ', o.o_orderpriority) END AS issue,
  CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'N' THEN NULL
       ELSE CONCAT(l.l_returnflag, '/', l.l_linestatus) END AS subissue,
  d.text AS consumer_complaint_narrative,
  CASE WHEN l.l_tax > 0.05 THEN NULL ELSE CONCAT('public response ', l.l_returnflag) END
       AS company_public_response,
  s.s_name AS company_name,
  NULLIF(n.n_name, 'NATION_0') AS state,
  NULLIF(CAST(c.c_custkey % 100 AS STRING), '0') AS zip_code,
  CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'tagged' ELSE NULL END AS tags,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE 'provided' END AS consumer_consent_provided,
  c.c_mktsegment AS submitted_via,
  CASE l.l_linenumber WHEN 1 THEN 'Closed' WHEN 2 THEN 'Closed with explanation'
       WHEN 3 THEN 'Closed with monetary relief' WHEN 4 THEN 'Closed with non-monetary relief'
       WHEN 5 THEN 'In progress' WHEN 6 THEN 'Untimely response' ELSE NULL END
       AS company_response_to_consumer,
  l.l_shipdate >= o.o_orderdate AS timely_response,
  CASE l.l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE ELSE NULL END AS consumer_disputed
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN documents d ON d.doc_id = l.l_orderkey
"""

# Which source table each output column needs beyond lineitem.
_NEEDS: dict[str, set[str]] = {
    "complaint_id": set(),
    "date_received": {"orders"},
    "product": {"part"},
    "subproduct": {"part"},
    "issue": {"orders"},
    "subissue": set(),
    "consumer_complaint_narrative": {"documents"},
    "company_public_response": set(),
    "company_name": {"supplier"},
    "state": {"orders", "customer", "nation"},
    "zip_code": {"orders", "customer"},
    "tags": {"orders", "customer"},
    "consumer_consent_provided": {"orders", "customer"},
    "submitted_via": {"orders", "customer"},
    "company_response_to_consumer": set(),
    "timely_response": {"orders"},
    "consumer_disputed": set(),
}

# Source columns each output column reads, per table.
_READS: dict[str, dict[str, list[str]]] = {
    "complaint_id": {"lineitem": ["l_orderkey", "l_linenumber"]},
    "date_received": {"orders": ["o_orderdate"]},
    "product": {"part": ["p_type"]},
    "subproduct": {"part": ["p_brand"]},
    "issue": {"lineitem": ["l_quantity"], "orders": ["o_orderpriority"]},
    "subissue": {"lineitem": ["l_linestatus", "l_returnflag"]},
    "consumer_complaint_narrative": {"documents": ["text"]},
    "company_public_response": {"lineitem": ["l_tax", "l_returnflag"]},
    "company_name": {"supplier": ["s_name"]},
    "state": {"nation": ["n_name"]},
    "zip_code": {"customer": ["c_custkey"]},
    "tags": {"customer": ["c_mktsegment"]},
    "consumer_consent_provided": {"customer": ["c_acctbal"]},
    "submitted_via": {"customer": ["c_mktsegment"]},
    "company_response_to_consumer": {"lineitem": ["l_linenumber"]},
    "timely_response": {"lineitem": ["l_shipdate"], "orders": ["o_orderdate"]},
    "consumer_disputed": {"lineitem": ["l_returnflag"]},
}


def _expr(name: str) -> Column:
    """Output column ``name`` as an expression over the joined source columns."""
    c = F.col
    if name == "complaint_id":
        return c("l_orderkey") * 10 + c("l_linenumber")
    if name == "date_received":
        return c("o_orderdate").cast("date")
    if name == "product":
        return F.nullif(c("p_type"), F.lit("ECONOMY"))
    if name == "subproduct":
        return F.nullif(c("p_brand"), F.lit("Brand#2"))
    if name == "issue":
        return (
            F.when(c("l_quantity") <= 5, F.lit(None).cast("string"))
            .when(c("l_quantity") <= 6, F.lit("Unknown"))
            .otherwise(F.concat(F.lit("issue "), c("o_orderpriority")))
        )
    if name == "subissue":
        return F.when(
            (c("l_linestatus") == "F") & (c("l_returnflag") == "N"), F.lit(None).cast("string")
        ).otherwise(F.concat(c("l_returnflag"), F.lit("/"), c("l_linestatus")))
    if name == "consumer_complaint_narrative":
        return c("text")
    if name == "company_public_response":
        return F.when(c("l_tax") > 0.05, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("public response "), c("l_returnflag"))
        )
    if name == "company_name":
        return c("s_name")
    if name == "state":
        return F.nullif(c("n_name"), F.lit("NATION_0"))
    if name == "zip_code":
        return F.nullif((c("c_custkey") % 100).cast("string"), F.lit("0"))
    if name == "tags":
        return F.when(c("c_mktsegment") == "HOUSEHOLD", F.lit("tagged"))
    if name == "consumer_consent_provided":
        return F.when(c("c_acctbal") < 0, F.lit(None).cast("string")).otherwise(
            F.lit("provided")
        )
    if name == "submitted_via":
        return c("c_mktsegment")
    if name == "company_response_to_consumer":
        ln = c("l_linenumber")
        return (
            F.when(ln == 1, "Closed")
            .when(ln == 2, "Closed with explanation")
            .when(ln == 3, "Closed with monetary relief")
            .when(ln == 4, "Closed with non-monetary relief")
            .when(ln == 5, "In progress")
            .when(ln == 6, "Untimely response")
        )
    if name == "timely_response":
        return c("l_shipdate") >= c("o_orderdate")
    if name == "consumer_disputed":
        rf = c("l_returnflag")
        return F.when(rf == "R", F.lit(True)).when(rf == "A", F.lit(False))
    raise KeyError(name)


#: Rows up to which a restricted ``lineitem`` counts as few.
RESTRICT_ROWS = 10_000


def complaints_view(
    spark: SparkSession,
    sf_dir: str,
    columns: list[str] | None = None,
    prune_joins: bool = True,
    first_ids: int | None = None,
    narrative_flag: bool = False,
) -> DataFrame:
    """Complaints derived from the tables under ``sf_dir``.

    ``columns`` selects the output columns (default: all).  With
    ``prune_joins`` only the tables those columns need are joined; with
    ``prune_joins=False`` every join of ``VIEW_SQL`` is made, which is the
    reference definition used by the tests.

    ``first_ids=n`` keeps only the complaints whose ``complaint_id`` is one
    of the n smallest values (every row with such an id, ties included).  The
    restriction is applied to ``lineitem`` before any join, through a
    broadcast semi join on at most n values; if few rows are left (counted:
    ``RESTRICT_ROWS`` at most), every other table is first restricted to
    their keys, so a top-n by ``complaint_id`` shuffles no whole table.

    With ``narrative_flag`` the narrative column is true where there is a
    text and null elsewhere, so that counting nulls moves no text.
    """
    cols = list(columns) if columns else list(COMPLAINT_COLUMNS)
    unknown = [x for x in cols if x not in _NEEDS]
    if unknown:
        raise KeyError(f"not a complaint column: {unknown}")
    tables = set().union(*[_NEEDS[x] for x in cols]) if prune_joins else {
        "orders", "customer", "nation", "part", "supplier", "documents"
    }
    reads: dict[str, set[str]] = {}
    for x in cols:
        for table, names in _READS[x].items():
            reads.setdefault(table, set()).update(names)

    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    l_cols = set(reads.get("lineitem", set()))
    if tables & {"orders", "customer", "nation", "documents"}:
        l_cols.add("l_orderkey")
    if "part" in tables:
        l_cols.add("l_partkey")
    if "supplier" in tables:
        l_cols.add("l_suppkey")
    if not l_cols:  # a view with no lineitem column still needs one row per lineitem
        l_cols.add("l_orderkey")
    df = load("lineitem").select(*sorted(l_cols | ({"l_orderkey", "l_linenumber"} if first_ids else set())))
    few = False
    if first_ids is not None:
        cid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        smallest = (
            load("lineitem")
            .select(cid.alias("_cid"))
            .orderBy(F.col("_cid").asc_nulls_first())
            .limit(first_ids)
            .distinct()
        )
        df = df.join(F.broadcast(smallest), cid.eqNullSafe(F.col("_cid")), "left_semi")
        few = df.limit(RESTRICT_ROWS + 1).count() <= RESTRICT_ROWS

    def only(table: DataFrame, key: str, source: DataFrame, names: str) -> DataFrame:
        """``table`` restricted to the keys of ``source`` if those are few."""
        if not few:
            return table
        keys = source.select(F.col(names).alias("_key")).distinct()
        return table.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi")

    # Order-level attributes: orders -> customer -> nation, orders-sized.
    order_side = None
    if tables & {"orders", "customer", "nation"}:
        o_cols = {"o_orderkey"} | reads.get("orders", set())
        if tables & {"customer", "nation"}:
            o_cols.add("o_custkey")
        order_side = only(load("orders").select(*sorted(o_cols)), "o_orderkey", df, "l_orderkey")
        if tables & {"customer", "nation"}:
            c_cols = {"c_custkey"} | reads.get("customer", set())
            if "nation" in tables:
                c_cols.add("c_nationkey")
            cust = only(load("customer").select(*sorted(c_cols)), "c_custkey", order_side, "o_custkey")
            if "nation" in tables:
                nation = load("nation").select("n_nationkey", *sorted(reads.get("nation", set())))
                cust = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
            order_side = order_side.join(cust, order_side.o_custkey == cust.c_custkey, "inner")
    part = supp = docs = None
    if "part" in tables:
        part = only(load("part").select("p_partkey", *sorted(reads.get("part", set()))), "p_partkey", df, "l_partkey")
    if "supplier" in tables:
        supp = only(load("supplier").select("s_suppkey", *sorted(reads.get("supplier", set()))), "s_suppkey", df, "l_suppkey")
    if "documents" in tables:
        docs = load("documents").select("doc_id", *sorted(reads.get("documents", set())))
        if narrative_flag:
            docs = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.lit(True)).alias("text"))
        docs = only(docs, "doc_id", df, "l_orderkey")

    if order_side is not None:
        df = df.join(order_side, df.l_orderkey == order_side.o_orderkey, "inner")
    if part is not None:
        df = df.join(part, df.l_partkey == part.p_partkey, "inner")
    if supp is not None:
        df = df.join(supp, df.l_suppkey == supp.s_suppkey, "inner")
    if docs is not None:
        df = df.join(docs, df.l_orderkey == docs.doc_id, "left")

    return df.select(*[_expr(x).alias(x) for x in cols])
