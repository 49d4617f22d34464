import copy
import datetime as dt
import json
import sqlite3

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import timeline
from quern.plans import publication as P
from quern.sources import readers, sinks, sqlfile
from quern.sources.schema import PROVENANCE

DAY = dt.date(2026, 8, 20)


def day(n):
    return DAY - dt.timedelta(days=n)


ROWS = [
    ("g1", "Metro", "each", day(1), 4.0, 1.0, 0), ("g1", "Metro", "each", day(2), 5.0, 1.0, 0), ("g1", "Metro", "each", day(3), 5.0, 1.0, 1), ("g1", "Walmart", "each", day(0), 3.5, 2.0, 1),
    ("g2", "Metro", "each", day(0), 2.0, 1.0, 0), ("g2", "Walmart", "per_100g", day(0), 1.0, 1.0, 0), ("g2", "SaveOnFoods", "each", day(3), 2.0, 1.0, 0),
    ("g3", "Metro", "each", day(30), 9.0, 1.0, 0), ("g4", "Walmart", "each", day(300), 9.0, 1.0, 0),
]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(ROWS, "gtin string, vendor string, basis string, d date, px double, min_qty double, on_sale int").cache()


@pytest.fixture(scope="module")
def documents(spark, days):
    stale = spark.createDataFrame([(v, k, float(k)) for v in ("Metro", "Walmart", "SaveOnFoods") for k in (1, 2, 3, 7, 14)], "vendor string, k int, pct_wrong double")
    o = P.flagged(P.chain_offers(days, DAY), stale)
    products = spark.createDataFrame([("k1", "g1", "Tea", "You save$1", 500.0, "g", 2.0, "derived"), ("k2", "g2", " ", "Brand", None, None, None, "none"), ("k3", "g3", "Old", "B", 1.0, "count", 1.0, "exact"), ("k4", "g1", "Teas", "B", 500.0, "g", 1.0, "exact")], "product_key string, gtin string, product_name string, brand_raw string, unit_qty double, unit_uom string, pack_count double, unit_parse_confidence string")
    names = P.names(products, spark.createDataFrame([("k1", 5), ("k2", 1), ("k3", 1), ("k4", 4)], "product_key string, n long"))
    return o, P.products_document(o, P.sale_context(o, days), names), P.history_document(days, DAY)


def built(documents):
    _, products, history = documents
    ps, hs = [json.loads(x) for x in sinks.json_lines(products)], [json.loads(x) for x in sinks.json_lines(history)]
    meta = dict.fromkeys(("built_utc", "snapshot_id", "basket_barcodes", "omitted", "exclusions", "scope", "attribution"), "x") | {"extract_date": "2026-08-20", "products_shipped": len(ps), "chains": [{"chain": "Metro", "staleness": [{"days": 1, "pct_wrong": 1.0}, {"days": 7, "pct_wrong": 3.0}]}]}
    return meta, ps, hs


FLOORS = {"products": 3, "comparable_pct": 30.0, "vintage_days": 21}


def test_documents(documents):
    meta, ps, hs = built(documents)
    assert [p["gtin14"] for p in ps] == ["g1", "g2", "g3"]
    g1, g2, g3 = ps
    assert [o["chain"] for o in g1["offers"]] == ["Walmart", "Metro"] and g1["comparison"]["cheapest"] == "Walmart" and g1["comparison"]["cheapest_requires_min_qty"] == 2.0
    assert g1["comparison"]["claim"] == "Cheapest of the 2 chains with a price from the last 7 days: Metro and Walmart."
    assert (g1["name"], g1["brand"], g1["size"]) == ("Tea", None, "2 x 500 g") and g1["offers"][1]["prior_14d"] == {"days_observed": 2, "low": 5.0, "high": 5.0, "days_at_this_price": 0}
    assert g2["name"] == "(no name)" and g2["comparison"]["compared"] == ["Metro", "SaveOnFoods"] and g2["comparison"]["unavailable"][0]["reason"] == "priced on a different basis"
    assert g2["comparison"]["claim"].endswith("Metro and Save-On-Foods.") and g2["comparison"]["cheapest"] == "Metro"
    assert g3["comparison"]["n_compared"] == 0 and g3["comparison"]["cheapest"] is None and g3["offers"][0]["staleness_exceeds_measured"] and g3["offers"][0]["staleness_pct"] is None
    assert [(h["gtin14"], h["chain"], len(h["spells"])) for h in hs][:2] == [("g1", "Metro", 3), ("g1", "Walmart", 1)]
    assert P.gate(meta, ps, hs, FLOORS, DAY) == []


CHANGES = [
    lambda m, p, h: m.pop("scope"), lambda m, p, h: m.update(products_shipped=9), lambda m, p, h: m["chains"][0]["staleness"].reverse() or m["chains"][0]["staleness"][0].update(days=1, pct_wrong=9.0),
    lambda m, p, h: p.reverse(), lambda m, p, h: p[0]["offers"].clear(), lambda m, p, h: p[0]["offers"][0].update(price=0), lambda m, p, h: p[0]["comparison"].update(n_compared=1),
    lambda m, p, h: p[0]["comparison"].update(compared=["Metro"]), lambda m, p, h: p[0]["comparison"].update(cheapest="Metro"), lambda m, p, h: p[2]["comparison"].update(cheapest="Metro"),
    lambda m, p, h: p[0]["offers"][0].update(is_recent=False), lambda m, p, h: p[2]["offers"][0].update(not_comparable_reason=None), lambda m, p, h: p[2]["offers"][0].update(staleness_pct=3.0),
    lambda m, p, h: h[0]["spells"].clear(), lambda m, p, h: h[0]["spells"][1].update(from_date=h[0]["spells"][0]["to_date"]), lambda m, p, h: m.update(extract_date="2026-07-01"),
]


@pytest.mark.parametrize("i", range(len(CHANGES)))
def test_gate_sees_each_change(documents, i):
    parts = copy.deepcopy(built(documents))
    CHANGES[i](*parts)
    assert P.gate(*parts, FLOORS, DAY)


def _read(spark, rows, like, path):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return spark.read.schema(like.schema).json(str(path))


def test_gates_where_the_documents_lie(spark, documents, tmp_path):
    _, products, history = documents
    assert P.product_problems(products).count() == P.spell_problems(history).count() == 0
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14):  # those that change one product's or one history's document
        m, ps, hs = copy.deepcopy(built(documents))
        CHANGES[i](m, ps, hs)
        found = P.spell_problems(_read(spark, hs, history, tmp_path / f"h{i}")) if i > 12 else P.product_problems(_read(spark, ps, products, tmp_path / f"p{i}"))
        assert {r.gtin14 for r in found.collect()} == ({"g3"} if i in (9, 11, 12) else {"g1"}), i
    _, ps, _ = built(documents)
    ps[1]["comparison"] = None
    found = P.product_problems(_read(spark, [*ps, ps[0]], products, tmp_path / "again")).collect()
    assert ("g1", "the product repeats") in found and {r.gtin14 for r in found} == {"g1", "g2"}
    assert P.product_problems(products.limit(0)).count() == 0


def test_gate_floors(documents):
    assert any("under" in x for x in P.gate(*built(documents), {"products": 4, "comparable_pct": 90.0, "vintage_days": 21}, DAY))


def test_parity(documents):
    a, b = built(documents), copy.deepcopy(built(documents))
    b[0]["built_utc"] = "later"
    assert P.parity(a, b) == []
    b[1][0]["name"] = "other"
    b[0]["scope"] = "y"
    assert P.parity(a, b) == ["meta", "products"]


def test_guarantee_and_ageing(documents, spark):
    o = documents[0]
    tiers = spark.createDataFrame([("Metro", "vendor_upc"), ("Walmart", "matched_upc"), ("SaveOnFoods", "vendor_upc")], "vendor string, vendor_upc_tier string")
    chains = ["Metro", "Walmart", "SaveOnFoods"]
    assert P.guaranteed(o, chains, tiers).count() == o.count()
    for bad in (P.guaranteed(o, chains[:2], tiers), P.guaranteed(o, chains, tiers.union(spark.createDataFrame([("Metro", "fuzzy")], tiers.schema)))):
        with pytest.raises(PySparkException):
            bad.collect()
    later = {(r.gtin, r.vendor): r.comparable for r in P.aged(o, DAY + dt.timedelta(days=7)).collect()}
    now = {(r.gtin, r.vendor): r.comparable for r in o.collect()}
    assert later["g1", "Walmart"] and not later["g1", "Metro"] and all(now[k] for k, v in later.items() if v)


def test_search(documents):
    assert [r.gtin14 for r in P.search(documents[1], "name").collect()] == ["g2"]


def test_files(spark, documents, tmp_path):
    n = sinks.write_json_array(documents[1], f"{tmp_path}/p.json")
    first = open(f"{tmp_path}/p.json").read()
    sinks.write_json_array(documents[1].repartition(5).orderBy("gtin14"), f"{tmp_path}/p.json")
    assert open(f"{tmp_path}/p.json").read() == first and len(json.loads(first)) == n == 3
    back = readers.json_array(spark, f"{tmp_path}/p.json")
    assert back.select(F.explode("offers")).count() == 6
    one = readers.whole_file(spark, f"{tmp_path}/p.json").first()
    assert one.bytes == len(first)
    sinks.write_json_object(readers.provenance(spark, {"snapshot_id": "x"}), f"{tmp_path}/m.json")
    assert json.load(open(f"{tmp_path}/m.json")) == {"k": "snapshot_id", "v": "x"}
    with pytest.raises(ValueError):
        sinks.write_json_object(spark.range(2), f"{tmp_path}/m.json")
    assert readers.provenance(spark, {"a": "b"}).schema.simpleString() == PROVENANCE.simpleString()


def test_parquet_csv_models_and_row_ids(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"))
    assert sinks.write_model(df, f"{tmp_path}/m", 1000, ["m"]) == 1000
    with pytest.raises(ValueError):
        sinks.write_model(df, f"{tmp_path}/m", 999)
    assert sinks.compact(spark.read.parquet(f"{tmp_path}/m"), f"{tmp_path}/c", 1) == 1000
    sinks.write_csv(df.limit(5), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["k", "m"]
    df.repartition(4).write.parquet(f"{tmp_path}/r")
    a = readers.with_row_ids(spark.read.parquet(f"{tmp_path}/r"))
    ids = {r.src_rowid: r.k for r in a.collect()}
    assert sorted(ids) == list(range(1000)) and ids == {r.src_rowid: r.k for r in a.repartition(7).collect()}
    stamp = sinks.build_stamp("t", {"a.sql": "select 1"})
    assert stamp["built_utc"] == "t" and len(stamp["a.sql.sha256"]) == 64 and sinks.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_sqlite_and_light_load(spark, tmp_path):
    from quern.sources.schema import PRICES

    path = f"{tmp_path}/a.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE raw (nowtime INTEGER, current_price TEXT, old_price TEXT, price_per_unit TEXT, other TEXT, product_id TEXT)")
        db.executemany("INSERT INTO raw VALUES (?,?,?,?,?,?)", [(20260801 + i, "1.99", None, "", "", f"p{i % 4}") for i in range(10)])
    assert readers.sqlite_query(path, "SELECT count(*), typeof(max(nowtime)) FROM raw") == [(10, "integer")]
    assert readers.sqlite_to_parquet(path, "raw", f"{tmp_path}/raw.parquet", PRICES[2], rows=3) == 10
    meta = pq.read_metadata(f"{tmp_path}/raw.parquet")
    size = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
    assert readers.parquet_bytes(spark, f"{tmp_path}/raw.parquet") == size
    spark.read.parquet(f"{tmp_path}/raw.parquet").repartition(3).write.partitionBy("product_id").parquet(f"{tmp_path}/parts")
    assert readers.parquet_bytes(spark, f"{tmp_path}/parts") > 0
    prices = spark.read.schema(PRICES[2]).parquet(f"{tmp_path}/raw.parquet")
    products = spark.createDataFrame([("p0", "Metro"), ("p1", "Walmart"), ("p2", "Voila")], "id string, vendor string")
    some, kept = readers.filtered_load(prices, products, ["Metro", "Walmart"])
    assert some.count() == 6 and kept.count() == 2 and readers.empty_like(prices).count() == 0 and readers.empty_like(prices).schema == prices.schema


def test_sql_files(spark, tmp_path):
    (tmp_path / "b.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW v AS SELECT ';' AS x; -- a ; comment\n")
    (tmp_path / "a.sql").write_text(".read b.sql\n/* nothing ; here */;\nSELECT x, 'it''s; ' AS y FROM v;\n-- end\n")
    got = sqlfile.run(spark, str(tmp_path / "a.sql"))
    assert len(got) == 2 and tuple(got[1].first()) == (";", "it's; ")
    (tmp_path / "c.sql").write_text(".read c.sql\n")
    with pytest.raises(ValueError):
        sqlfile.expand(tmp_path / "c.sql")
    (tmp_path / "d.sql").write_text("SELECT 1; SELECT nothing FROM nowhere")
    with pytest.raises(RuntimeError, match="statement 2"):
        sqlfile.run(spark, str(tmp_path / "d.sql"))


def test_attached_databases_and_their_catalogue(spark, tmp_path):
    for name, add in (("a", 0), ("b", 1)):
        spark.range(4).selectExpr("id", f"id + {add} as x").write.parquet(f"{tmp_path}/{name}/t.parquet")
    spark.range(1).createOrReplaceTempView("not_of_it")
    assert readers.attach(spark, "snap_a", f"{tmp_path}/a") == ["t"] == readers.attach(spark, "snap_b", f"{tmp_path}/b") == readers.attach(spark, "snap_b", f"{tmp_path}/b")
    assert spark.sql("SELECT count(*) FROM snap_a.t a JOIN snap_b.t b ON a.id = b.id WHERE a.x <> b.x").first()[0] == 4
    assert [tuple(r) for r in readers.catalogue(spark, "snap_a").orderBy("position").collect()] == [("t", "id", 1, "bigint"), ("t", "x", 2, "bigint")]
    for name in ("snap_a", "snap_b"):
        readers.detach(spark, name)
    assert not [d for d in spark.catalog.listDatabases() if d.name in ("snap_a", "snap_b")] and spark.read.parquet(f"{tmp_path}/a/t.parquet").count() == 4


def test_horizons_of_series_without_a_key(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 3), 2.0), ("b", dt.date(2024, 1, 3), 9.0), (None, dt.date(2024, 1, 1), 5.0), (None, dt.date(2024, 1, 3), 6.0), ("a", None, 7.0)]
    found = timeline.horizons(spark.createDataFrame(rows, "g string, d date, px double"), ["g"], [1, 2]).where("later_px is not null").collect()
    assert [tuple(r) for r in found] == [("a", dt.date(2024, 1, 1), 1.0, 2, 2.0)]
