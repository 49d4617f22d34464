"""Each thing that keeps a publication from being released, one at a time, told where the documents lie."""

import copy
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.plans import publication as P

DAY = dt.date(2026, 8, 20)


def offer(chain, price, **kw):
    base = {
        "chain": chain, "chain_label": "Save-On-Foods" if chain == "SaveOnFoods" else chain, "price": price, "basis": "each", "observed_date": DAY, "days_behind": 1, "is_recent": True, "comparable": True,
        "not_comparable_reason": None, "staleness_pct": 2.0, "staleness_exceeds_measured": False,
    }
    return base | kw


OUT = {"is_recent": False, "comparable": False, "not_comparable_reason": P.LATE, "staleness_pct": None, "staleness_exceeds_measured": True, "days_behind": 30}
GOOD = {
    "gtin14": "g1", "name": "Tea", "brand": "LIFESAVERS", "basis": "each", "offers": [offer("SaveOnFoods", 2.0), offer("A & B", 3.0), offer("Gone", 1.0, **OUT)],
    "comparison": {
        "n_compared": 2, "compared": ["A & B", "SaveOnFoods"], "unavailable": [{"chain": "Gone", "reason": P.LATE, "last_observed": DAY}], "cheapest": "SaveOnFoods",
        "claim": "Cheapest of the 2 chains with a price from the last 7 days: A & B and Save-On-Foods.",
    },
}
SCHEMA = """gtin14 string, name string, brand string, basis string,
    offers array<struct<chain:string,chain_label:string,price:double,basis:string,observed_date:date,days_behind:bigint,is_recent:boolean,comparable:boolean,not_comparable_reason:string,staleness_pct:double,staleness_exceeds_measured:boolean>>,
    comparison struct<n_compared:bigint,compared:array<string>,unavailable:array<struct<chain:string,reason:string,last_observed:date>>,cheapest:string,claim:string>"""
CHAINS = ["SaveOnFoods", "A & B", "Gone"]


def change(path, value):
    def f(d):
        *way, last = path
        for k in way:
            d = d[k]
        d[last] = value

    return f


O, C = "offers", "comparison"
CASES = [
    (change([O], []), {"no offer, or one without a price", "the compared chains aren't the comparable offers", "the cheapest chain is wrong", "a chain is neither compared nor unavailable, or has no offer", "the claim isn't the comparison's"}),
    (change([O, 2, "price"], -1.0), {"no offer, or one without a price"}), (change([O, 2, "price"], None), {"no offer, or one without a price"}),
    (change([C, "n_compared"], 3), {"the compared chains aren't the comparable offers", "the claim isn't the comparison's"}),
    (change([C, "cheapest"], None), {"the cheapest chain is wrong"}), (change([C, "cheapest"], "A & B"), {"the cheapest chain is wrong"}),
    (change([O, 2, "not_comparable_reason"], ""), {"an offer's reason contradicts it"}), (change([O, 0, "is_recent"], False), {"an offer's reason contradicts it"}),
    (change([O, 2, "staleness_pct"], 1.0), {"staleness beyond what was measured"}), (change([O, 0, "staleness_pct"], None), {"no staleness within what was measured"}),
    (change([O, 0, "basis"], "per_100g"), {"a comparable offer on another basis"}), (change(["basis"], None), {"a comparable offer on another basis"}),
    (change([C, "unavailable"], []), {"a chain is neither compared nor unavailable, or has no offer"}), (change([C, "unavailable", 0, "reason"], None), {"an unavailable chain without a reason"}),
    (change([C, "unavailable", 0, "reason"], ""), {"an unavailable chain without a reason"}), (change([C, "unavailable", 0, "last_observed"], None), {"an unavailable chain without its last day"}),
    (change([C, "claim"], ""), {"no claim"}), (change([C, "claim"], None), {"no claim"}), (change([C, "claim"], "Cheapest of all."), {"the claim isn't the comparison's"}),
    (change([C, "claim"], GOOD[C]["claim"].replace("2", "3")), {"the claim isn't the comparison's"}), (change([C, "claim"], P.NOTHING_RECENT), {"the claim isn't the comparison's"}),
    (change([C, "claim"], GOOD[C]["claim"].replace("Save-On-Foods", "SaveOnFoods")), {"the claim isn't the comparison's", "the claim prints a chain's code"}),
    (change([C, "claim"], GOOD[C]["claim"].replace(" & B", " and B")), {"the claim isn't the comparison's", "the claim says and twice"}),
    (change([O, 0, "chain_label"], "SaveOnFoods"), {"a chain without a label", "the claim isn't the comparison's"}), (change(["brand"], "You SAVE big"), {"the brand is a promotion"}), (change(["brand"], "now $4"), {"the brand is a promotion"}),
    (change([O, 2, "chain"], "Other"), {"an offer of a chain outside the extract", "a chain is neither compared nor unavailable, or has no offer"}),
    (change(["brand"], None), set()), (change(["name"], None), set()),
]


@pytest.fixture(scope="module")
def told(spark):
    docs = []
    for i, (f, _) in enumerate(CASES):
        d = copy.deepcopy(GOOD)
        f(d)
        docs.append(d | {"gtin14": str(i)})
    found = P.product_problems(spark.createDataFrame([GOOD, *docs, GOOD | {"gtin14": "again"}, GOOD | {"gtin14": "again"}], SCHEMA), CHAINS).collect()
    return {g: {r.problem for r in found if r.gtin14 == g} for g in {r.gtin14 for r in found}}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_change_is_told_and_nothing_else(told, i):
    assert told.get(str(i), set()) == CASES[i][1]


def test_good_documents_and_repeated_ones(told, spark):
    assert "g1" not in told and told["again"] == {"the product repeats"}
    few = spark.createDataFrame([GOOD | {"comparison": None}, GOOD | {"gtin14": "x", "offers": None}], SCHEMA)
    assert {r.gtin14 for r in P.product_problems(few, CHAINS).collect()} == {"g1", "x"}


def test_claims_are_read_back(spark):
    claims = [P.NOTHING_RECENT, "Only A & B has a price from the last 7 days. There is nothing to compare it with.", GOOD[C]["claim"], "Cheapest of the 3 chains with a price from the last 7 days: A, B and C.", "Cheapest of the x", "", None]
    rows = spark.createDataFrame([(c,) for c in claims], "c string").select(P.claim_said(F.col("c")).alias("s")).collect()
    assert [r.s and (r.s.n, r.s.labels) for r in rows] == [(0, []), (1, ["A & B"]), (2, ["A & B", "Save-On-Foods"]), (3, ["A", "B", "C"]), None, None, None]


def test_fields_are_told_by_the_schema(spark):
    whole = spark.createDataFrame([], SCHEMA)
    assert P.lacking_fields(whole) == []
    assert P.lacking_fields(whole.drop("name").withColumn("offers", F.transform("offers", lambda o: o.dropFields("price", "basis")))) == ["name", "offers.price", "offers.basis"]
    assert P.lacking_fields(whole.drop("offers"))[0] == "offers"


def test_curves_and_statements(spark):
    curve = "array<struct<days:bigint,pct_wrong:double>>"
    rows = [("a", "a", [(1, 1.0), (7, 2.0)]), ("b", "b", [(7, 2.0), (1, 3.0)]), ("c", "c", [(1, 2.0), (2, None), (3, 1.0)]), ("d", "d", []), ("SaveOnFoods", "SaveOnFoods", [(1, 2.0), (2, 1.0)])]
    found = {}
    for r in P.chain_problems(spark.createDataFrame(rows, f"chain string, chain_label string, staleness {curve}"), ["a", "b", "c", "SaveOnFoods"]).collect():
        found.setdefault(r.chain, set()).add(r.problem)
    assert found == {"b": {"the curve isn't in order of age"}, "c": {"the curve has a hole"}, "d": {"no staleness curve", "a chain outside the extract"}, "SaveOnFoods": {"staleness falls with age", "a chain without a label"}}
    meta = spark.createDataFrame([("s1", "Data of X.org", {"a": "TORONTO", "b": "no total"}), ("s2", None, None)], "snapshot_id string, attribution string, scope map<string,string>").withColumn("pooled_staleness", F.lit(1))
    got = {(r.snapshot_id, r.problem) for r in P.statement_problems(meta, "X.org", [("Toronto",), ("no basket", "no total")]).collect()}
    pooled = {(s, "staleness pooled over chains: pooled_staleness") for s in ("s1", "s2")}
    assert got == pooled | {("s2", "attribution doesn't name the source"), ("s2", "scope doesn't state Toronto"), ("s2", "scope doesn't state no basket")}


def test_floors(spark):
    docs = spark.createDataFrame([GOOD, GOOD | {"gtin14": "g2", "comparison": GOOD[C] | {"n_compared": 1}}], SCHEMA)
    least = {"products": 2, "comparable_pct": 50.1, "vintage_days": 21}
    assert {r.floor: (r.value, r.holds) for r in P.floors(docs, 2, DAY, DAY + dt.timedelta(days=22), least).collect()} == {"products": (2.0, True), "comparable_pct": (50.0, False), "products_shipped": (2.0, True), "vintage_days": (22.0, False)}
    assert {r.floor: r.holds for r in P.floors(docs.limit(0), None, DAY, DAY, least).collect()} == {"products": False, "comparable_pct": False, "products_shipped": False, "vintage_days": True}
