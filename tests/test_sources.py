import os

from helpers import SF001
from pyspark.sql import functions as F

from redress.sources.complaints import COMPLAINT_COLUMNS, COMPLAINT_SCHEMA, conform
from redress.sources.tpch_view import VIEW_SQL, complaints_view


def test_view_schema(spark):
    df = complaints_view(spark, SF001)
    assert df.columns == COMPLAINT_COLUMNS
    want = {f.name: f.dataType for f in COMPLAINT_SCHEMA.fields}
    assert {f.name: f.dataType for f in df.schema.fields} == want


def test_pruned_joins_lose_no_rows(spark):
    full = complaints_view(spark, SF001, prune_joins=False)
    n = full.count()
    lineitem = spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    assert n == lineitem
    for cols in (["date_received"], ["product", "state"], ["issue", "subissue"], ["consumer_disputed"]):
        pruned = complaints_view(spark, SF001, cols)
        assert pruned.count() == n
        a = pruned.groupBy(*cols).count().collect()
        b = full.groupBy(*cols).count().collect()
        assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_view_equals_sql_definition(spark):
    for t in ("lineitem", "orders", "customer", "nation", "part", "supplier", "documents"):
        spark.read.parquet(f"{SF001}/{t}.parquet").createOrReplaceTempView(t)
    sql = conform(spark.sql(VIEW_SQL))
    df = complaints_view(spark, SF001, prune_joins=False)
    assert sql.exceptAll(df).count() == 0 and df.exceptAll(sql).count() == 0


def test_daily_count_reads_two_tables_only(spark):
    files = complaints_view(spark, SF001, ["date_received"]).inputFiles()
    tables = sorted({f.rsplit("/", 1)[-1].split(".")[0] for f in files})
    assert tables == ["lineitem", "orders"]
    df = complaints_view(spark, SF001, ["date_received"]).where(F.year("date_received") > 1990)
    assert df.count() > 0


def test_first_ids_keeps_every_row_of_the_smallest_ids(spark):
    full = complaints_view(spark, SF001, prune_joins=False)
    ids = [r.complaint_id for r in full.select("complaint_id").orderBy("complaint_id").limit(5).collect()]
    want = full.where(F.col("complaint_id").isin(sorted(set(ids))))
    got = complaints_view(spark, SF001, first_ids=5)
    assert got.count() == want.count() >= 5
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_read_complaints_other_formats_and_catalog(spark):
    import datetime as dt
    import json
    import os
    import tempfile

    from redress.sources.complaints import read_complaints, read_complaints_table

    folder = tempfile.mkdtemp(prefix="redress-json-")
    rows = [
        {"complaint_id": 1, "date_received": "2020-01-02", "product": "Mortgage", "consumer_disputed": True},
        {"complaint_id": 2, "date_received": None, "issue": "Unknown"},
    ]
    with open(os.path.join(folder, "c.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    c = read_complaints(spark, folder, fmt="json")
    assert c.columns == COMPLAINT_COLUMNS
    got = sorted(c.select("complaint_id", "date_received", "product", "consumer_disputed").collect())
    assert got[0] == (1, dt.date(2020, 1, 2), "Mortgage", True)
    assert got[1] == (2, None, None, None)
    c.createOrReplaceTempView("complaints_fixture")
    assert read_complaints_table(spark, "complaints_fixture").count() == 2


def test_new_files_are_seen(spark):
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="redress-new-")
    shutil.copytree(SF001, folder, dirs_exist_ok=True)
    path = f"{folder}/lineitem.parquet"
    rows = spark.read.parquet(f"{SF001}/lineitem.parquet")
    os.chmod(path, 0o644)
    rows.limit(5).write.mode("overwrite").parquet(f"{folder}/x")
    view = lambda: complaints_view(spark, folder, ["subissue"]).count()
    os.rename(path, f"{folder}/old")
    os.rename(f"{folder}/x", path)
    assert view() == 5
    rows.limit(7).write.mode("append").parquet(path)
    assert view() == 12


def test_narrative_flag_counts_like_the_text(spark):
    text = complaints_view(spark, SF001, ["consumer_complaint_narrative"])
    flag = complaints_view(spark, SF001, ["consumer_complaint_narrative"], narrative_flag=True)
    nulls = lambda df: df.where("consumer_complaint_narrative IS NULL").count()
    assert nulls(text) == nulls(flag) > 0


def test_catalog_columns_are_mapped_and_checked(spark):
    import pytest

    from redress.sources.complaints import read_complaints_table

    spark.sql("SELECT 7 AS `Complaint ID`, 'Web' AS via, current_timestamp() AS got, 'x' AS timely_response").createOrReplaceTempView("shop")
    names = {"complaint_id": "Complaint ID", "submitted_via": "via", "date_received": "got"}
    with pytest.raises(ValueError, match="timely_response string as boolean"):
        read_complaints_table(spark, "shop", names)
    spark.table("shop").drop("timely_response").createOrReplaceTempView("shop2")
    got = read_complaints_table(spark, "shop2", names)
    assert dict(got.dtypes) == {"complaint_id": "bigint", "date_received": "date", "submitted_via": "string"}
    assert got.first().submitted_via == "Web"
    for bad in ({"complaint_id": "nowhere"}, {"no_such": "via"}):
        with pytest.raises(ValueError):
            read_complaints_table(spark, "shop2", bad)
    with pytest.raises(ValueError, match="no complaint column"):
        read_complaints_table(spark, "shop2")
