import datetime as dt

from helpers import complaint

from redress.operators import outcomes, profile
from redress.sources.complaints import NULL_PROFILE_COLUMNS

R = "company_response_to_consumer"


def _rows(frame):
    rows = (
        [complaint(company_response_to_consumer="Closed", consumer_disputed=True)] * 1
        + [complaint(company_response_to_consumer="Closed", consumer_disputed=False)] * 3
        + [complaint(company_response_to_consumer="Closed with monetary relief", consumer_disputed=False)] * 2
        + [complaint(company_response_to_consumer="Closed with monetary relief", consumer_disputed=None)] * 5
        + [complaint(company_response_to_consumer="In progress", consumer_disputed=True)] * 7
        + [complaint(company_response_to_consumer=None, consumer_disputed=True)] * 4
    )
    return frame(rows)


def test_dispute_by_response(frame):
    got = {(r.Response, r.Dispute): (r.Count_response, r.share) for r in outcomes.dispute_by_response(_rows(frame)).collect()}
    assert got == {
        ("Closed", "True"): (1, 0.25),
        ("Closed", "False"): (3, 0.75),
        ("Closed with monetary relief", "False"): (2, 1.0),
    }
    custom = outcomes.dispute_by_response(_rows(frame), ["In progress"]).collect()
    assert [(r.Response, r.Dispute, r.Count_response) for r in custom] == [("In progress", "True", 7)]


def test_response_composition(frame):
    got = {r[R]: (r["count"], r.share) for r in outcomes.response_composition(_rows(frame)).collect()}
    assert got == {
        "Closed": (4, 4 / 18),
        "Closed with monetary relief": (7, 7 / 18),
        "In progress": (7, 7 / 18),
    }


def test_missing_counts(frame):
    rows = [
        complaint(subissue="a", state="CA", consumer_disputed=True),
        complaint(subissue=None, state=None, consumer_disputed=None),
        complaint(subissue=None, state="TX", consumer_disputed=False, tags="t"),
    ]
    got = profile.missing_counts(frame(rows)).first().asDict()
    assert list(got) == [f"{x}_missing_count" for x in NULL_PROFILE_COLUMNS]
    assert got["subissue_missing_count"] == 2
    assert got["state_missing_count"] == 1
    assert got["consumer_disputed_missing_count"] == 1
    assert got["tags_missing_count"] == 2
    assert got["zip_code_missing_count"] == 3


def test_sample_rows_is_ordered_and_bounded(frame):
    rows = [complaint(complaint_id=i, date_received=dt.date(2020, 1, 1 + i % 5)) for i in range(20)]
    rows.append(complaint(complaint_id=None))
    got = profile.sample_rows(frame(rows), 5).collect()
    assert len(got) == 5
    assert got[0].complaint_id is None  # nulls first
    assert [r.complaint_id for r in got[1:]] == [0, 1, 2, 3]
    recs = profile.sample_records(frame(rows), 2).collect()
    assert len(recs) == 2 and recs[1].record.startswith('{"complaint_id":0,"date_received":"2020-01-01"')
    assert recs[0].record.startswith('{"complaint_id":null,') and '"consumer_disputed":null}' in recs[0].record


def test_dispute_by_response_sql_binds_the_list(spark, frame):
    c = _rows(frame)
    c.createOrReplaceTempView("complaints_outcomes")
    want = sorted(map(tuple, outcomes.dispute_by_response(c).collect()))
    got = sorted(map(tuple, outcomes.dispute_by_response_sql(spark, "complaints_outcomes").collect()))
    assert got == want
    one = outcomes.dispute_by_response_sql(spark, "complaints_outcomes", ["In progress"]).collect()
    assert [(r.Response, r.Dispute, r.Count_response) for r in one] == [("In progress", "True", 7)]


def test_bound_list_reaches_the_parquet_reader(spark, frame, tmp_path):
    frame([complaint(company_response_to_consumer=r, consumer_disputed=True) for r in ("Closed", "It's", None)]).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("bound_outcomes")
    got = outcomes.dispute_by_response_sql(spark, "bound_outcomes", ["It's", "x' OR 1=1 --"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(company_response_to_consumer" in plan.split("PushedFilters:")[1]
    assert [(r.Response, r.Count_response) for r in got.collect()] == [("It's", 1)]
    assert outcomes.dispute_by_response_sql(spark, "bound_outcomes", []).collect() == []
