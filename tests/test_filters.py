from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.filters import predicates as p
from tidewatch.filters.predicates import And, Not, Or, Seek, Term, TimeOfDay

AT = datetime(2024, 3, 10, 15, 30)


@pytest.fixture(scope="module")
def rows(spark):
    data = [("Alpha One", 5, True, AT, 90.0, None, '{"size": 7}'), ("beta", 50, False, datetime(2024, 3, 9, 8, 0), 5.0, "", '{"size": 70}'), ("a.pha", None, None, None, None, "x", None)]
    return spark.createDataFrame(data, "Name string, Count int, IsOnline boolean, Updated timestamp_ntz, Elapsed double, Maybe string, Payload string").cache()


CASES = [
    (Term("name", "contains", "ALPHA"), {"Alpha One"}),
    (Term("Name", "contains", "alpha", True), set()),
    (Term("Name", "exact", "BETA"), {"beta"}),
    (Term("Name", "exact", "BETA", True), set()),
    (Term("Name", "glob", "a?pha*"), {"Alpha One", "a.pha"}),
    (Term("Name", "glob", "a.*"), {"a.pha"}),
    (Term("Count", "contains", 5), {"Alpha One", "beta"}),
    (Term("Elapsed", "contains", 5), {"beta"}),
    (Term("Elapsed", "exact", 90), {"Alpha One"}),
    (Term("IsOnline", "exact", True), {"Alpha One"}),
    (Term("Maybe", "isnull"), {"Alpha One", "beta"}),
    (Term("Nothing", "isnull"), {"Alpha One", "beta", "a.pha"}),
    (Term("Count", "ge", 5), {"Alpha One", "beta"}),
    (Term("Count", "between", (6, 60)), {"beta"}),
    (Term("Name", "lt", 5), {"Alpha One", "beta", "a.pha"}),
    (Term("Updated", "gt", datetime(2024, 3, 10)), {"Alpha One"}),
    (Term("Updated", "exact", AT), set()),
    (Term("Updated", "ge", TimeOfDay(12 * 3600)), {"Alpha One"}),
    (Term("Count", "between", (5, AT)), set()),
    (Not(Term("Count", "gt", 10)), {"Alpha One", "a.pha"}),
    (Not(Not(Term("Count", "gt", 10))), {"beta"}),
    (Or((Term("Count", "exact", 5), And((Term("Name", "contains", "b"), Not(Term("IsOnline", "exact", True)))))), {"Alpha One", "beta"}),
    (Term("size", "gt", 10), {"beta"}),
    (None, {"Alpha One", "beta", "a.pha"}),
]


@pytest.mark.parametrize("tree,want", CASES)
def test_conditions(rows, tree, want):
    assert {r.Name for r in rows.where(p.column(tree, rows.schema, payload="Payload")).collect()} == want


def test_sql_mode(rows):
    assert rows.where(p.column(Term("Updated", "exact", AT), rows.schema, "sql")).count() == 1
    assert rows.where(p.column(Term("Maybe", "isnull"), rows.schema, "sql")).count() == 1


def test_bare_terms_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where(p.column(Term("o_orderkey", "between", (1, 5)), df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan


def test_json_round_trip():
    for tree, _ in CASES:
        assert p.from_json(p.to_json(tree)) == tree


def test_moments():
    want = {"now": AT, "today": datetime(2024, 3, 10), "yesterday": datetime(2024, 3, 9), "-2h": datetime(2024, 3, 10, 13, 30), "3d": datetime(2024, 3, 13), "9:30": datetime(2024, 3, 10, 9, 30), "2024-01-02": datetime(2024, 1, 2), "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5), "soon": None}
    assert {k: p.moment(k, AT) for k in want} == want


def test_views_and_references():
    v = p.VIEWS["services"]
    assert v.term("SVC", "exact", "x") == Term("ServiceName", "exact", "x")
    assert v.any_field("x") == Or(tuple(Term(f, "contains", "x") for f in ("ServiceName", "HostName", "ProcessId")))
    assert p.View(()).any_field("x") is None
    assert p.references(Or((Not(Term("StartTime", "gt", 1)),)), "starttime") and not p.references(Term("a", "isnull"), "b")


def test_seek():
    tree = And((Term("partition", "exact", 1), Term("Partition", "exact", 2), Or((Term("offset", "gt", 9), Term("Key", "contains", "k"))), Term("timestamp", "le", AT), Term("latest", "exact", 5)))
    where, rest = p.seek(tree)
    assert where == Seek((1, 2), 10, None, None, AT, 5)
    assert rest == And((And(), And(), Or((And(), Term("Key", "contains", "k"))), And(), And()))


def test_document_match(rows):
    names = lambda q: {r.Name for r in rows.where(p.match_column(q, rows.schema)).collect()}
    assert names({"Count": {"$gte": 5, "$lt": 50}}) == {"Alpha One"}
    assert names({"Count": {"$ne": 5}}) == {"beta", "a.pha"}
    assert names({"Count": None}) == {"a.pha"} and names({"Count": {"$exists": True}}) == {"Alpha One", "beta"}
    assert names({"$nor": [{"Name": "beta"}, {"Count": {"$in": [5]}}]}) == {"a.pha"}
    assert names({"Name": {"$regex": "^[ab]\\w+$"}}) == {"beta"}
    assert names({}) == {"Alpha One", "beta", "a.pha"}
    with pytest.raises(ValueError):
        p.match_column({"Name": {"$near": 1}}, rows.schema)


def test_null_is_taken_as_false_only_under_a_not(rows):
    assert rows.where(~p.column(Term("Count", "gt", 10), rows.schema)).count() == 1
    assert rows.where(p.column(Not(Term("Count", "gt", 10)), rows.schema)).select(F.count("*")).first()[0] == 2
