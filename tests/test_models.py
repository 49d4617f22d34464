import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.plans import contracts as Q
from quern.plans.models import int_upc_match, stg_price, stg_product
from quern.sources import schema as S
from quern.streaming import prices as stream

PRODUCTS = [
    ("MetroA", "Metro", "A1", "00012345678905", "500g", "SELECTION"), ("GalleriaB", "Galleria", "B1", "00012345678905", "500g", "Kelloggs"),
    ("SaveOnC", "SaveOnFoods", "C1", "00098765432109", "1 L", "Western Family"), ("LoblawsD", "Loblaws", "D1", "00098765432109", "1 L", "PC"),
    ("WalmartE", "Walmart", "E1", "4011", "1ea", "Great Value"), ("VoilaF", "Voila", "", "", "2 x 500 mL", ""),
]
RAW = [
    ("MetroA", 20260801, "3.29", "was", "$3.29/500g", ""), ("MetroA", 20260802, "2/$7.00", None, None, "salepricefound"), ("GalleriaB", 20260801, "4.99", "", "", ""),
    ("SaveOnC", 20260801, "36.90/kg", "", "", ""), ("LoblawsD", 20260801, "329$", "4.99", "", "salepricefound"), ("WalmartE", 20260801, "Now$298", "99¢", "", "salepricefound"),
    ("VoilaF", 20260801, "", "", "", ""), ("MissingXX", 20260801, "1.99", "", "", ""), ("LoblawsD", 2202, "2.49", "", "", ""), ("LoblawsD", 2202, "5.99", "", "", ""), ("LoblawsD", 20222602, "1.49", "", "", ""),
]
PINNED = {2202: 2, 20222602: 1}
SNAPSHOT = "20260803T120000Z"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(i, n, c, o, u, t, p) for i, (p, n, c, o, u, t) in enumerate(RAW)], "src_rowid long, nowtime long, current_price string, old_price string, price_per_unit string, other string, product_id string").cache()


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(i, f"{v}~n@{u}^{b}", v, "n", u, b, "", s, c) for i, v, s, c, u, b in PRODUCTS], S.PRODUCT).cache()


@pytest.fixture(scope="module")
def models(raw, products):
    price, product = stg_price(raw, products).cache(), stg_product(products).cache()
    return {"price": price, "product": product, "match": int_upc_match(product).cache(), "raw": raw, "source": products}


def contracts_of(m, table=None):
    """All contracts, or those that a table takes part in."""
    price = Q.price_contracts(m["price"], m["raw"], m["product"], SNAPSHOT, PINNED)
    product, match = Q.product_contracts(m["product"], m["source"]), Q.match_contracts(m["match"], m["product"])
    if table == "product":
        return product | {k: v for k, v in (price | match).items() if k in ("price.key.related", "match.key.related", "match.rows")}
    return {None: price | product | match, "price": price, "match": match}[table]


def test_models(models):
    p = {r.src_rowid: r for r in models["price"].collect()}
    assert len(p) == len(RAW) and p[7].product_key is None and p[7].unit_price == 1.99
    assert [(p[i].offer_type, p[i].unit_price, p[i].parse_confidence) for i in (0, 1, 3, 4, 5, 6)] == [("scalar", 3.29, "exact"), ("multibuy", 3.5, "derived"), ("per_weight", 3.69, "inferred"), ("scalar", 3.29, "derived"), ("scalar", 2.98, "derived"), ("blank", None, "none")]
    assert p[0].old_offer_type == "unparsed" and p[5].old_unit_price == 0.99 and p[0].observed_date == dt.date(2026, 8, 1) and p[8].observed_date is None
    m = {r.vendor: r for r in models["match"].collect()}
    assert {v: (r.match_tier, r.is_reliable_only, r.n_vendors_on_gtin, r.n_fuzzy_vendors_on_gtin, r.vendors_on_gtin) for v, r in m.items()} == {
        "Metro": ("vendor_upc", True, 2, 0, "Galleria,Metro"), "Galleria": ("vendor_upc", True, 2, 0, "Galleria,Metro"), "SaveOnFoods": ("fuzzy", False, 2, 1, "Loblaws,SaveOnFoods"),
        "Loblaws": ("fuzzy", False, 2, 1, "Loblaws,SaveOnFoods"), "Walmart": ("plu_short", False, 0, 0, None), "Voila": ("no_upc", False, 0, 0, None),
    }
    pr = {r.vendor: r for r in models["product"].collect()}
    assert (pr["Voila"].unit_qty, pr["Voila"].pack_count, pr["Voila"].total_qty, pr["Voila"].product_key_basis) == (500.0, 2.0, 1000.0, "vendor_concatted")
    assert [pr[v].brand_class for v in ("Metro", "Galleria", "Loblaws", "Walmart")] == ["private_label", "unclassifiable_no_vendor_data", "private_label", "private_label"]


def test_clean_models_pass_every_contract(models):
    found = contracts_of(models)
    assert len(found) >= 42 and Q.failures(found) == []


c = F.col
MUTATIONS = [
    ("price.rows", "price", lambda d: d.where("src_rowid <> 3")), ("product.rows", "product", lambda d: d.where("vendor <> 'Walmart'")), ("match.rows", "match", lambda d: d.where("vendor <> 'Walmart'")),
    ("price.parsed", "price", lambda d: d.withColumn("unit_price", F.when(c("src_rowid") != 0, c("unit_price")))),
    ("price.multibuy", "price", lambda d: d.withColumn("unit_price", F.when(c("src_rowid") == 1, 7.0).otherwise(c("unit_price")))),
    ("price.cents", "price", lambda d: d.withColumn("unit_price", F.when(c("src_rowid") == 4, 329.0).otherwise(c("unit_price")))),
    ("product.junk_brand", "product", lambda d: d.withColumn("brand_class", F.when(c("vendor") == "Voila", "national_brand").otherwise(c("brand_class")))),
    ("match.weakest", "match", lambda d: d.withColumn("match_tier", F.when(c("vendor") == "Loblaws", "vendor_upc").otherwise(c("match_tier")))),
    ("match.reliable", "match", lambda d: d.withColumn("is_reliable_only", (c("vendor") == "Loblaws") | c("is_reliable_only"))),
    ("price.null_dates", "price", lambda d: d.withColumn("observed_date", F.when(c("src_rowid") != 2, c("observed_date")))),
    ("price.rowid.unique", "price", lambda d: d.withColumn("src_rowid", F.when(c("src_rowid") == 5, 4).otherwise(c("src_rowid")).cast("long"))),
    ("price.rowid.not_null", "price", lambda d: d.withColumn("src_rowid", F.when(c("src_rowid") != 5, c("src_rowid")))),
    ("price.key.related", "price", lambda d: d.withColumn("product_key", F.when(c("src_rowid") == 7, "made up").otherwise(c("product_key")))),
    ("price.date.window", "price", lambda d: d.withColumn("observed_date", F.when(c("src_rowid") == 2, F.lit(dt.date(1970, 1, 1))).otherwise(c("observed_date")))),
    ("price.offer.accepted", "price", lambda d: d.withColumn("offer_type", F.when(c("src_rowid") == 2, "gift").otherwise(c("offer_type")))),
    ("price.basis.accepted", "price", lambda d: d.withColumn("price_basis", F.when(c("src_rowid") == 2, "per_lb").otherwise(c("price_basis")))),
    ("price.confidence.accepted", "price", lambda d: d.withColumn("parse_confidence", F.when(c("src_rowid") == 2, "certain").otherwise(c("parse_confidence")))),
    ("price.old_offer.not_null", "price", lambda d: d.withColumn("old_offer_type", F.when(c("src_rowid") != 2, c("old_offer_type")))),
    ("product.vendor.accepted", "product", lambda d: d.withColumn("vendor", F.when(c("vendor") == "Voila", "Other").otherwise(c("vendor")))),
    ("product.uom.accepted", "product", lambda d: d.withColumn("unit_uom", F.when(c("vendor") == "Voila", "lb").otherwise(c("unit_uom")))),
    ("product.unit_confidence.accepted", "product", lambda d: d.withColumn("unit_parse_confidence", F.when(c("vendor") == "Voila", "?").otherwise(c("unit_parse_confidence")))),
    ("product.brand.accepted", "product", lambda d: d.withColumn("brand_class", F.when(c("vendor") == "Metro", "store").otherwise(c("brand_class")))),
    ("product.tier.accepted", "product", lambda d: d.withColumn("upc_tier", F.when(c("vendor") == "Metro", "sure").otherwise(c("upc_tier")))),
    ("match.tier.accepted", "match", lambda d: d.withColumn("match_tier", F.when(c("vendor") == "Metro", "sure").otherwise(c("match_tier")))),
]


@pytest.mark.parametrize(("name", "table", "change"), MUTATIONS, ids=[m[0] for m in MUTATIONS])
def test_each_mutation_fails_its_contract_alone(models, name, table, change):
    found = Q.failures(contracts_of(models | {table: change(models[table])}, table))
    follow = {"price.null_dates": set(), "product.rows": {"price.key.related", "match.key.related", "match.rows"}, "match.rows": set()}.get(name, set())
    assert name in found and set(found) <= {name} | follow


def test_checksums_twice_and_layers(models, spark):
    assert Q.cache_differences(models["price"], models["price"].orderBy(F.rand(3))) == []
    assert Q.cache_differences(models["price"], models["price"].withColumn("min_qty", F.lit(9.0))) == ["min_qty"]
    assert Q.twice(lambda: models["match"].groupBy("match_tier").count()) == "same"
    assert Q.twice(lambda: spark.range(0, 9, 1, 3).select(F.rand().alias("x"))) == "different"
    assert Q.twice(lambda: spark.sql("select * from no_such_table")) == "failed"
    assert Q.layering({"price": models["price"], "match": models["match"]}, ["price"]) == [] and Q.layering({"x": models["price"]}, []) == ["x.product_id"]


def test_schema_contract(raw, products, spark):
    assert S.differences("product", products.schema, S.PRODUCT, True) == []
    kinds = lambda df, w, **k: [p.kind for p in S.differences("t", df.schema if df is not None else None, w, **k)]
    assert kinds(products.drop("upc"), S.PRODUCT) == ["MISSING"] and kinds(None, S.PRODUCT) == ["TABLE MISSING"]
    assert kinds(products.withColumn("sku", F.lit(1)), S.PRODUCT) == ["TYPE MISMATCH"] and kinds(products.withColumn("z", F.lit(1)), S.PRODUCT) == ["UNEXPECTED"]
    assert set(kinds(products.select(*reversed(products.columns)), S.PRODUCT, strict_position=True)) == {"POSITION DRIFT"} and kinds(products.select(*reversed(products.columns)), S.PRODUCT) == []
    with pytest.raises(ValueError):
        S.assert_schema("prices", raw, S.PRICES[2])
    S.assert_schema("prices", raw.drop("src_rowid"), S.PRICES[2])


def test_determinism_lints(tmp_path):
    p = tmp_path / "q.py"
    p.write_text("a = df.agg(F.max_by('x', 'k'))\nb = df.agg(F.sum('x'))\n# total: k is unique\nc = df.agg(F.min_by('x', 'k'))\nd = df.limit(3)\n")
    assert Q.loose_calls(str(p)) == [(1, "max_by"), (5, "limit")] or Q.loose_calls(str(p)) == [(1, "max_by")]
    sql = "SELECT any_value(x), list(y ORDER BY y)\nFROM t;\nSELECT list(y) FROM t;\nSELECT * FROM t ORDER BY a\nLIMIT 5;\nSELECT row_number() OVER (PARTITION BY a) FROM t;\nSELECT first(x) -- total: one row\n"
    assert [x for x in Q.loose_sql(sql)] == [(1, "any_value or first"), (3, "unordered list"), (6, "rank without order")]


def test_stream_equals_batch(spark, raw, products, tmp_path):
    from pyspark.errors import StreamingQueryException

    raw.drop("src_rowid").coalesce(2).write.parquet(f"{tmp_path}/in")
    q = stream.write(stream.parsed(stream.read(spark, f"{tmp_path}/in"), products), f"{tmp_path}/out", f"{tmp_path}/cp")
    try:
        q.awaitTermination(60)
    except StreamingQueryException as e:
        pytest.fail(str(e))
    got, want = spark.read.parquet(f"{tmp_path}/out"), stg_price(raw, products)
    assert got.count() == len(RAW) and Q.cache_differences(got.drop("src_rowid"), want.drop("src_rowid")) == []
    n = stream.daily_counts(want).agg(F.sum("rows"), F.sum("priced")).first()
    assert tuple(n) == (8, 7)


@pytest.mark.parametrize("folder", ["operators", "sources", "streaming", "functions"])
def test_own_sources_explain_every_order(folder):
    from pathlib import Path

    top = Path(Q.__file__).resolve().parent.parent
    assert {p.name: found for p in (top / folder).glob("*.py") if (found := Q.loose_calls(str(p)))} == {}
    assert {n: found for n in ("models", "contracts", "publication") if (found := Q.loose_calls(str(top / "plans" / f"{n}.py")))} == {}
