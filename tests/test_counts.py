from helpers import complaint

from redress.operators import counts

MORTGAGE = "Mortgage"
DEBT = "Debt collection"


def _products(frame):
    rows = (
        [complaint(product=MORTGAGE, subproduct="FHA", state="CA")] * 3
        + [complaint(product=MORTGAGE, subproduct="FHA", state=None)]
        + [complaint(product=MORTGAGE, subproduct="VA", state="TX")] * 2
        + [complaint(product=MORTGAGE, subproduct=None, state="TX")] * 5
        + [complaint(product=None, subproduct="X", state="NY")] * 2
        + [complaint(product=DEBT, subproduct="Medical", state="CA")] * 2
        + [complaint(product=DEBT, subproduct="Auto", state="CA")]
        + [complaint(product=DEBT, subproduct="Auto", state="NV")]
        + [complaint(product="Car, boat's loan", subproduct="Z", state="WA")]
    )
    return frame(rows)


def test_product_counts_null_group_counts_zero(frame):
    got = {r.product: (r.Counts_Complaints, r.product_abbr) for r in counts.product_counts(_products(frame)).collect()}
    assert got == {
        MORTGAGE: (6, "Mortgage"),
        DEBT: (4, "Debt Collection"),
        None: (0, None),
        "Car, boat's loan": (1, None),
    }


def test_products_ranked_without_null(frame):
    got = [(r.position, r.product) for r in counts.products(_products(frame)).orderBy("position").collect()]
    assert got == [(1, MORTGAGE), (2, DEBT), (3, "Car, boat's loan")]


def test_product_subproduct_state_counts_state(frame):
    got = {
        (r.product, r.subproduct, r.state): r.Counts_Complaints
        for r in counts.product_subproduct_state(_products(frame)).collect()
    }
    assert got[(MORTGAGE, "FHA", "CA")] == 3
    assert got[(MORTGAGE, "FHA", None)] == 0  # COUNT(state) on the null state
    assert got[(None, "X", "NY")] == 2
    assert (MORTGAGE, None, "TX") not in got  # no sub-product: filtered
    assert sum(got.values()) == 3 + 2 + 2 + 2 + 2 + 1


def test_subproduct_lists_first_appearance_order(frame):
    rows = counts.product_subproduct_lists(_products(frame)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.product, r.position)):
        got.setdefault(r.product, []).append(r.subproduct)
    # Mortgage: FHA max 3 (CA) before VA max 2.  Debt: Medical max 2, Auto max 1.
    assert got == {MORTGAGE: ["FHA", "VA"], DEBT: ["Medical", "Auto"], "Car, boat's loan": ["Z"]}
    arrays = {r.product: r.subproducts for r in counts.product_subproduct_lists(_products(frame), as_arrays=True).collect()}
    assert arrays == got


def test_subproduct_ties_break_by_name(frame):
    rows = [complaint(product="P", subproduct="b", state="CA")] * 2 + [
        complaint(product="P", subproduct="a", state="TX")
    ] * 2 + [complaint(product="P", subproduct="c", state="TX")] * 5
    got = [r.subproduct for r in counts.product_subproduct_lists(frame(rows)).orderBy("position").collect()]
    assert got == ["c", "a", "b"]


def test_defaults_pick_largest_product(frame):
    c = _products(frame)
    assert [r.subproduct for r in counts.subproducts_for(c).orderBy("position").collect()] == ["FHA", "VA"]
    got = {r.state: r.Counts_Complaints for r in counts.state_counts_for(c).collect()}
    assert got == {"CA": 3, None: 0}
    got = {r.state: r.Counts_Complaints for r in counts.state_counts_for(c, DEBT, "Auto").collect()}
    assert got == {"CA": 1, "NV": 1}
    assert counts.state_counts_for(c, DEBT, "Nope").count() == 0


def _issues(frame):
    owed = "Attempts to collect debt not owed"
    rows = (
        [complaint(issue=owed, subissue="s1")] * 4
        + [complaint(issue=owed, subissue=None)] * 2
        + [complaint(issue=None, subissue="x")] * 3
        + [complaint(issue="Unknown", subissue=None)] * 1
        + [complaint(issue="B", subissue="b1")] * 2
        + [complaint(issue="C", subissue="c1")] * 2
    )
    return frame(rows), owed


def test_issue_counts_unknown_label(frame):
    c, owed = _issues(frame)
    got = {r.issue: r["count"] for r in counts.issue_counts(c).collect()}
    # null issues and the literal 'Unknown' form one group; COUNT(issue)
    # counts the literal row only.
    assert got == {owed: 6, "Unknown": 1, "B": 2, "C": 2}


def test_issue_subissue_counts(frame):
    c, owed = _issues(frame)
    got = {(r.issue, r.subissue): r["count"] for r in counts.issue_subissue_counts(c).collect()}
    assert got == {
        (owed, "s1"): 4,
        (owed, "Unknown"): 2,
        ("Unknown", "x"): 0,
        ("Unknown", "Unknown"): 1,
        ("B", "b1"): 2,
        ("C", "c1"): 2,
    }


def test_issue_totals_equal_issue_counts(frame):
    c, _ = _issues(frame)
    totals = {r.issue: r["count"] for r in counts.issue_totals(c).collect()}
    direct = {r.issue: r["count"] for r in counts.issue_counts(c).collect()}
    assert totals == direct
    ranked = [r.issue for r in counts.issue_totals(c).orderBy("position").collect()]
    assert ranked[:3] == ["Attempts to collect debt not owed", "B", "C"]  # B/C tie: by name


def test_top_issues_tie_at_the_cut(frame):
    c, owed = _issues(frame)
    got = [r.issue for r in counts.top_issues(c, n=2).collect()]
    assert got == [owed, "B"]


def test_top_issue_subissue(frame):
    c, owed = _issues(frame)
    rows = counts.top_issue_subissue(c, n_issues=2, n_pairs=2).collect()
    got = sorted((r.issue, r.subissue, r["count"], r.issue_abbrev, r.issue_total) for r in rows)
    assert got == [
        (owed, "Unknown", 2, "Unowed Debt Collection", 6),
        (owed, "s1", 4, "Unowed Debt Collection", 6),
    ]


def test_issue_subissue_lists_and_subissues_for(frame):
    c, owed = _issues(frame)
    rows = counts.issue_subissue_lists(c).collect()
    lists = {}
    order = {}
    for r in sorted(rows, key=lambda r: (r.issue_position, r.position)):
        lists.setdefault(r.issue, []).append(r.subissue)
        order[r.issue] = r.issue_position
    assert lists[owed] == ["s1", "Unknown"]
    assert lists["Unknown"] == ["Unknown", "x"]  # count 1 before count 0
    assert sorted(order, key=order.get) == [owed, "B", "C", "Unknown"]
    got = {r.subissue: r["count"] for r in counts.subissues_for(c).collect()}
    assert got == {"s1": 4, "Unknown": 2}
    got = {r.subissue: r["count"] for r in counts.subissues_for(c, "Unknown").collect()}
    assert got == {"x": 0, "Unknown": 1}


def test_largest_first_orders_groups_with_ties_by_key(frame):
    got = counts.largest_first(counts.product_counts(_products(frame)), "Counts_Complaints").collect()
    assert [r["product"] for r in got] == [MORTGAGE, DEBT, "Car, boat's loan", None]
    triples = counts.largest_first(counts.product_subproduct_state(_products(frame)), "Counts_Complaints").collect()
    assert [r.Counts_Complaints for r in triples] == sorted((r.Counts_Complaints for r in triples), reverse=True)
    ones = [(r["product"], r.subproduct, r.state) for r in triples if r.Counts_Complaints == 1]
    assert ones == [("Car, boat's loan", "Z", "WA"), (DEBT, "Auto", "CA"), (DEBT, "Auto", "NV")]
    by_product = counts.largest_first(counts.product_subproduct_state(_products(frame)), "Counts_Complaints", "product")
    assert [r["product"] for r in by_product.collect()][:2] == [None, "Car, boat's loan"]


def test_totals_per_bar(frame):
    got = counts.product_counts(_products(frame), {MORTGAGE: "Loans", "Car, boat's loan": "Loans"}, totals=True)
    assert {r["product"]: r.total for r in got.collect()} == {MORTGAGE: 7, "Car, boat's loan": 7, DEBT: 4, None: 4}


def test_options_are_labels_and_values_largest_first(frame):
    got = counts.product_options(_products(frame)).orderBy("position").collect()
    assert [(r.label, r.value) for r in got] == [(x, x) for x in (MORTGAGE, DEBT, "Car, boat's loan")]
