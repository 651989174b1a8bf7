"""One capture per page row, whatever the rows share."""

from collections import Counter

from test_pages import ROWS, pages

from redress.llm.queries import op1_warc


def test_every_page_row_is_a_capture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("redress.llm.common.HOT_ROWS", 5)
    rows = [*ROWS, (2, "http://other.org/", None), *[(None, "http://n.net/", None)] * 9, (8, "http://h.net/", "\n"), (7, "u", "v")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = op1_warc(spark, str(tmp_path)).collect()
    assert len(ROWS) == 9 and len(got) == len(rows)
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((i, len((h or "").encode())) for i, _, h in rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 99), 99 if i is None else i)
    want = Counter((i, None if i == first[h or ""] else first[h or ""]) for i, _, h in rows)
    assert Counter((r.page_id, r.refers_to) for r in got) == want
