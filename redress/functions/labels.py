"""Label expressions and the fixed lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "Unknown"

# ---------------------------------------------------------------------------
# They must equal the reference's for the same labels.
# Product name -> abbreviation (18 entries).
PRODUCT_ABBREVIATIONS: dict[str, str] = {
    "Credit reporting, credit repair services, or other personal consumer reports": "CR, CRS, or OPC Reports",
    "Debt collection": "Debt Collection",
    "Mortgage": "Mortgage",
    "Credit card or prepaid card": "CC or PC",
    "Checking or savings account": "CoSA",
    "Credit reporting": "Credit Reporting",
    "Credit card": "Credit Card",
    "Bank account or service": "BAS",
    "Student loan": "Student Loan",
    "Money transfer, virtual currency, or money service": "MT, VC, or MS",
    "Vehicle loan or lease": "VLL",
    "Consumer Loan": "Consumer Loan",
    "Payday loan, title loan, or personal loan": "PL, TL, or PL",
    "Payday loan": "Payday Loan",
    "Money transfers": "Money Transfers",
    "Prepaid card": "Prepaid Card",
    "Other financial service": "OFS",
    "Virtual currency": "Virtual Currency",
}

# Issue name -> abbreviation (8 entries).
ISSUE_ABBREVIATIONS: dict[str, str] = {
    "Incorrect information on your report": "Incorrect Info",
    "Problem with a credit reporting company's investigation into an existing problem": "Investigation Problem",
    "Improper use of your report": "Improper Use",
    "Loan modification,collection,foreclosure": "Loan Modification",
    "Attempts to collect debt not owed": "Unowed Debt Collection",
    "Loan servicing, payments, escrow account": "Loan Servicing",
    "Trouble during payment process": "Payment Trouble",
    "Written notification about debt": "Debt Notification",
}

# The four closing responses whose dispute shares are compared.
CLOSING_RESPONSES: list[str] = [
    "Closed",
    "Closed with explanation",
    "Closed with monetary relief",
    "Closed with non-monetary relief",
]
# Every response, in the order of the wide trend's columns.
RESPONSES: list[str] = [*CLOSING_RESPONSES, "In progress", "Untimely response"]
# End of fixed values.
# ---------------------------------------------------------------------------


def null_label(col: str | Column, label: str = UNKNOWN) -> Column:
    """``IFNULL(col, label)``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(label))


def bool_text(col: str | Column) -> Column:
    """Boolean -> ``'True'`` / ``'False'`` (capitalised, unlike a cast); null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c, "True").otherwise("False")


def map_labels(df: DataFrame, key: str, mapping: dict[str, str], out: str) -> DataFrame:
    """``Series.map(dict)``: add ``out`` = mapping[key], null on a miss.

    The mapping is a literal of a few entries, so it is applied as an inline
    map expression: no join, no shuffle, stays in whole-stage codegen.
    """
    if not mapping:
        return df.withColumn(out, F.lit(None).cast("string"))
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(lookup, F.col(key)))
