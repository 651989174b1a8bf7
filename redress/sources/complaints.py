"""The complaints fact table: schema, column groups and the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLAINT_SCHEMA = T.StructType(
    [
        T.StructField("complaint_id", T.LongType()),
        T.StructField("date_received", T.DateType()),
        T.StructField("product", T.StringType()),
        T.StructField("subproduct", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("subissue", T.StringType()),
        T.StructField("consumer_complaint_narrative", T.StringType()),
        T.StructField("company_public_response", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("consumer_consent_provided", T.StringType()),
        T.StructField("submitted_via", T.StringType()),
        T.StructField("company_response_to_consumer", T.StringType()),
        T.StructField("timely_response", T.BooleanType()),
        T.StructField("consumer_disputed", T.BooleanType()),
    ]
)

COMPLAINT_COLUMNS = [f.name for f in COMPLAINT_SCHEMA.fields]

# The ten columns whose missing values the null profile counts, in the
# reference's order (fixed values).
NULL_PROFILE_COLUMNS = [
    "subissue",
    "subproduct",
    "consumer_complaint_narrative",
    "company_public_response",
    "state",
    "zip_code",
    "tags",
    "consumer_disputed",
    "consumer_consent_provided",
    "company_response_to_consumer",
]


def conform(df: DataFrame) -> DataFrame:
    """Cast a frame carrying the complaint columns to the canonical types.

    Columns absent from ``df`` are left out rather than invented, so a
    projected frame stays projected.
    """
    present = set(df.columns)
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in COMPLAINT_SCHEMA.fields
            if f.name in present
        ]
    )


def read_complaints(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a stored complaints table (parquet by default).

    The scan is lazy; each operator's ``select`` prunes it to the one to
    three columns it needs, and its filters reach the parquet reader.
    """
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(COMPLAINT_SCHEMA)
    return conform(reader.load(path))


def read_complaints_table(spark: SparkSession, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Catalog form of :func:`read_complaints`.

    ``columns`` maps complaint columns to the table's own names; other
    complaint columns are looked for under their own.  What the catalog says
    about the table is checked before anything is read: a named column that is
    missing, a column whose type cannot be cast to the complaint's without
    guessing, or a table without any complaint column is an error.  Complaint
    columns that the table lacks are left out."""
    schema = spark.table(name).schema
    held = {f.name: f.dataType for f in schema.fields}
    named = {x: (columns or {}).get(x, x) for x in COMPLAINT_COLUMNS}
    unknown = sorted(set(columns or {}) - set(COMPLAINT_COLUMNS))
    lost = sorted(named[x] for x in (columns or {}) if x in named and named[x] not in held)
    if unknown or lost:
        raise ValueError(f"{name}: no complaint column {unknown}, no table column {lost}")
    present = [f for f in COMPLAINT_SCHEMA.fields if named[f.name] in held]
    if not present:
        raise ValueError(f"{name} has no complaint column: {sorted(held)}")
    wrong = [
        f"{named[f.name]} {held[named[f.name]].simpleString()} as {f.dataType.simpleString()}"
        for f in present if not _fits(held[named[f.name]], f.dataType)
    ]
    if wrong:
        raise ValueError(f"{name}: " + ", ".join(wrong))
    return conform(spark.table(name).select(*[F.col(f"`{named[f.name]}`").alias(f.name) for f in present]))


def _fits(held: T.DataType, wanted: T.DataType) -> bool:
    """Whether a stored type is the wanted one or widens to it."""
    if isinstance(wanted, T.LongType):
        return isinstance(held, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if isinstance(wanted, T.DateType):
        return isinstance(held, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(held, type(wanted))
