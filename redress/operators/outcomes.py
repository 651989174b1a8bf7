"""Q5: how the way a case is closed relates to later disputes.

``response_composition``  count and share of each company response
``dispute_by_response``   for chosen responses: count and within-response
                          share of disputed / not disputed

Scale: one group-by on one or two low-cardinality keys; the shares are
windows over the aggregated groups (a handful of rows).  The response
membership test is an ``IN`` list that reaches the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redress.functions.labels import CLOSING_RESPONSES, bool_text

RESPONSE = "company_response_to_consumer"
DISPUTED = "consumer_disputed"


def response_composition(c: DataFrame, response: str = RESPONSE) -> DataFrame:
    """``(company_response_to_consumer, count, share)`` of present responses."""
    counts = (
        c.where(F.col(response).isNotNull())
        .groupBy(response)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.withColumn(
        "share", F.col("count") / F.sum("count").over(Window.partitionBy())
    )


def dispute_by_response(
    c: DataFrame,
    responses: list[str] | None = None,
    response: str = RESPONSE,
    disputed: str = DISPUTED,
) -> DataFrame:
    """``(Response, Dispute, Count_response, share)``.

    Rows whose response is in ``responses`` (default: the four closing
    responses) and whose dispute flag is known; ``Dispute`` is the text
    ``'True'`` / ``'False'``; ``share`` is the part of the response's total.
    """
    wanted = list(CLOSING_RESPONSES if responses is None else responses)
    counts = (
        c.where(
            F.col(response).isNotNull()
            & F.col(response).isin(wanted)
            & F.col(disputed).isNotNull()
        )
        .groupBy(F.col(response).alias("Response"), bool_text(disputed).alias("Dispute"))
        .agg(F.count(F.lit(1)).alias("Count_response"))
    )
    return counts.withColumn(
        "share",
        F.col("Count_response") / F.sum("Count_response").over(Window.partitionBy("Response")),
    )


def dispute_by_response_sql(
    spark: SparkSession, table: str, responses: list[str] | None = None
) -> DataFrame:
    """``dispute_by_response`` through the SQL API, the response list bound
    as parameters (the reference's ``IN UNNEST(@required_responses)``) over a
    table or view named ``table``.  Every value has a marker of its own in an
    ``IN`` list, so values are never part of the text and the list reaches the
    parquet reader like that of the DataFrame form.  An empty list selects no
    row."""
    if not table.replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"not a table name: {table!r}")
    wanted = dict(enumerate(CLOSING_RESPONSES if responses is None else responses))
    listed = ", ".join(f":response{i}" for i in wanted) or "NULL"
    query = f"""
        SELECT company_response_to_consumer AS Response,
               CASE WHEN consumer_disputed THEN 'True' ELSE 'False' END AS Dispute,
               COUNT(*) AS Count_response,
               COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY company_response_to_consumer) AS share
        FROM {table}
        WHERE company_response_to_consumer IS NOT NULL
          AND company_response_to_consumer IN ({listed})
          AND consumer_disputed IS NOT NULL
        GROUP BY company_response_to_consumer, consumer_disputed"""
    return spark.sql(query, args={f"response{i}": x for i, x in wanted.items()})
