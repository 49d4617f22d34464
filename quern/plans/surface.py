"""Queries over what the others don't reach: readers and sinks, the catalogue, the remaining text readings, and the
contracts of a build, held against rows that break them."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import catalogue as C
from quern.functions import text as X
from quern.functions.prices import parse_prices
from quern.functions.sql import register, set_variable
from quern.functions.units import parse_folded
from quern.plans import contracts, lint
from quern.plans.models import int_upc_match, stg_price, stg_product
from quern.plans.registry import query
from quern.plans.text import _KIND, _SIZED, catalogue, observations, priced, sized
from quern.sources import readers, schema, sinks, sqlfile, sqlite
from quern.sources.shared import scratch, stored


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- readers and sinks


def _archive(spark, sf_dir) -> str:
    """The customers as a folder of SQLite archives, each written by a task."""
    sqlite.register(spark)
    path = scratch(spark, "archive")
    _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").repartition(3).write.format("sqlite").mode("overwrite").option("table", "customer").save(path)  # total: the writer mode, not a statistic
    return path


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _folder(spark, name: str) -> str:
    """A new folder in the shared one, for the readers and sinks that write one file with Python: it must be mounted."""
    path = scratch(spark, name)
    Path(_plain(path)).mkdir(parents=True)
    return path


@query("io01_sqlite_scan", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_name IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sqlite_scan(spark, sf_dir):
    """Ranges of rowids of each archive, ten tasks each; SQLite is handed the comparisons."""
    found = spark.read.format("sqlite").option("table", "customer").option("partitions", 10).option("push", True).load(_archive(spark, sf_dir))
    return found.where("c_acctbal > 1000 and c_name is not null and c_mktsegment in ('BUILDING', 'MACHINERY')").select("c_custkey", "c_name", "c_acctbal")


@query("io02_pass_through", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY 1")
def pass_through(spark, sf_dir):
    """Each archive groups its own rows; Spark sums up what they answer."""
    asked = "SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY c_nationkey"
    parts = spark.read.format("sqlite").option("query", asked).schema("c_nationkey long, n long, balance double").load(_archive(spark, sf_dir))
    return parts.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.round(F.sum("balance"), 4).alias("balance"))


@query("io03_full_copy", "SELECT * FROM supplier")
def full_copy(spark, sf_dir):
    path = scratch(spark, "copy")
    sinks.write_parquet(_t(spark, sf_dir, "supplier"), path)
    return spark.read.parquet(path)


@query("io05_provenance", "SELECT 'rows' AS k, CAST(count(*) AS VARCHAR) AS v FROM part UNION ALL SELECT 'snapshot_id', '20260803T120000Z'")
def provenance(spark, sf_dir):
    return readers.provenance(spark, {"snapshot_id": "20260803T120000Z", "rows": str(_t(spark, sf_dir, "part").count())})


_DRIFT = "SELECT a.p_partkey, a.p_size AS size_now, b.p_size AS size_before FROM part a JOIN (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part) b ON b.p_partkey = a.p_partkey WHERE a.p_size <> b.p_size"


@query("io07_attached_databases", _DRIFT)
def attached(spark, sf_dir):
    before = scratch(spark, "snapshot")
    _t(spark, sf_dir, "part").withColumn("p_size", F.expr("if(p_partkey % 10 = 0, p_size + 1, p_size)")).write.parquet(f"{before}/part.parquet")
    readers.attach(spark, "snap_now", sf_dir)
    readers.attach(spark, "snap_before", before)
    return spark.sql("SELECT a.p_partkey, a.p_size AS size_now, b.p_size AS size_before FROM snap_now.part a JOIN snap_before.part b ON b.p_partkey = a.p_partkey WHERE a.p_size <> b.p_size")


@query("io08_json_unnest", "SELECT n_regionkey, n_name FROM nation")
def json_unnest(spark, sf_dir):
    path = f"{_folder(spark, 'json')}/regions.json"
    by = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    sinks.write_json_array(by.orderBy("n_regionkey"), _plain(path))
    kind = _t(spark, sf_dir, "nation").schema["n_regionkey"].dataType.simpleString()
    return readers.json_array(spark, path, f"n_regionkey {kind}, names array<string>").select("n_regionkey", F.explode("names").alias("n_name"))


@query("io09_session_variable", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12'")
def session_variable(spark, sf_dir):
    set_variable(spark, "wanted_brand", "Brand#12")
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand").where("p_brand = session.wanted_brand")


@query("io10_whole_file", "WITH t AS (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS t FROM nation) SELECT length(t) AS bytes, md5(t) AS md5 FROM t")
def whole_file(spark, sf_dir):
    path = f"{_folder(spark, 'text')}/names.txt"
    names = [r.n_name for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a fixed table of 25 rows
    Path(_plain(path)).write_text("".join(f"{n}\n" for n in names), encoding="utf-8")
    return readers.whole_file(spark, path).select("bytes", "md5")


_FOOTERS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM {t}" for t, c in (("part", "p_partkey"), ("part", "p_name"), ("supplier", "s_suppkey"), ("lineitem", "l_linenumber"), ("lineitem", "l_returnflag")))


@query("io11_footer_bytes", _FOOTERS)
def footer_bytes(spark, sf_dir):
    """Rows, nulls and bounds of some columns by the footers of a rewrite of their tables in four files, no row of which is
    read."""
    out, wanted = None, {"part": ["p_partkey", "p_name"], "supplier": ["s_suppkey"], "lineitem": ["l_linenumber", "l_returnflag"]}
    for name, columns in wanted.items():
        path = scratch(spark, "footers")
        sinks.write_parquet(_t(spark, sf_dir, name).select(*columns).repartition(4), path)
        found = readers.footers(spark, path).select(F.lit(name).alias("table_name"), "*")
        out = found if out is None else out.unionAll(found)
    number = F.col("column_name").isin("p_partkey", "s_suppkey", "l_linenumber")
    bound = lambda f, c: F.coalesce(f(F.when(number, F.col(c).cast("long"))).cast("string"), f(F.when(~number, F.col(c)))).alias(c)
    return out.groupBy("table_name", "column_name").agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"), bound(F.min, "low"), bound(F.max, "high"))


@query("io13_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_sink(spark, sf_dir):
    path = scratch(spark, "csv")
    sinks.write_csv(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", True).csv(path)


@query("io14_json_array", "SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part")
def json_sink(spark, sf_dir):
    path = f"{_folder(spark, 'json')}/parts.json"
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("if(p_size % 2 = 0, p_brand, null)").alias("brand"))
    sinks.write_json_array_in_tasks(rows.orderBy("p_partkey"), _plain(path))
    return readers.json_array(spark, path, rows.schema)


@query("io15_json_object", "SELECT count(*) AS parts, max(p_size) AS largest FROM part")
def json_object(spark, sf_dir):
    path = f"{_folder(spark, 'json')}/meta.json"
    row = _t(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest"))
    sinks.write_json_object(row, _plain(path))
    return spark.read.schema(row.schema).json(path)


_SCHEMA_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END"


@query("io19_catalogue", f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS position, {_SCHEMA_TYPES} AS data_type FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'documents', 'labels', 'benchmark')")
def table_catalogue(spark, sf_dir):
    readers.attach(spark, "snap_catalogue", sf_dir)
    found = readers.catalogue(spark, "snap_catalogue")
    readers.detach(spark, "snap_catalogue")
    return found.where(F.col("table_name").isin("region", "nation", "customer", "supplier", "part", "documents", "labels", "benchmark"))


@query("io20_build_model", "SELECT count(*) AS rows_written, sum(p_size) AS sizes FROM part")
def build_model(spark, sf_dir):
    part, path = _t(spark, sf_dir, "part"), scratch(spark, "model")
    n = sinks.write_model(part, path, part.count(), ["p_size"])
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("rows_written"), F.sum("p_size").alias("sizes"))


@query("io21_compaction", "SELECT * FROM customer")
def compaction(spark, sf_dir):
    many, few = scratch(spark, "many"), scratch(spark, "few")
    _t(spark, sf_dir, "customer").repartition(12).write.parquet(many)
    sinks.compact(spark.read.parquet(many), few, 2)
    return spark.read.parquet(few)


@query("io22_script", "SELECT r_name, 'it''s; ' || count(*) AS label FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def script(spark, sf_dir):
    top = Path(tempfile.mkdtemp())  # scripts are read by the driver alone
    (top / "tables.sql").write_text(f"CREATE OR REPLACE TEMPORARY VIEW script_region AS SELECT * FROM parquet.`{sf_dir}/region.parquet`; -- a ; comment\nCREATE OR REPLACE TEMPORARY VIEW script_nation AS SELECT * FROM parquet.`{sf_dir}/nation.parquet`;\n")
    (top / "main.sql").write_text(".read tables.sql\n/* nothing ; here */;\nSELECT r_name, concat(\"it's; \", count(*)) AS label FROM script_region JOIN script_nation ON n_regionkey = r_regionkey GROUP BY r_name;\n")
    return sqlfile.run(spark, str(top / "main.sql"))[-1]


# ---- text readings


@query("pp_basis_stated", f"WITH {_KIND} SELECT l_orderkey, l_linenumber, CASE kind WHEN 5 THEN (q * 10) || 'g' WHEN 6 THEN 'kg' WHEN 7 THEN 'lb' WHEN 8 THEN 'ea' END AS price_basis_stated FROM p")
def basis_stated(spark, sf_dir):
    return parse_prices(priced(spark, sf_dir), {"": "raw"}, vendor="vendor").select("l_orderkey", "l_linenumber", "price_basis_stated")


@query(
    "up_folded",
    _SIZED + """SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN CAST(q AS DOUBLE) WHEN 1 THEN (q + 0.5::DOUBLE) * 1000 WHEN 2 THEN q * 355.0::DOUBLE WHEN 4 THEN CAST(q AS DOUBLE) WHEN 5 THEN CAST(q AS DOUBLE) WHEN 6 THEN q * 29.5735::DOUBLE WHEN 9 THEN q * 453.592::DOUBLE END AS quantity,
    CASE WHEN kind IN (0, 1, 9) THEN 'mass_g' WHEN kind IN (2, 6) THEN 'volume_ml' WHEN kind IN (4, 5) THEN 'count' END AS class FROM s""",
)
def folded(spark, sf_dir):
    return parse_folded(sized(spark, sf_dir).select("l_orderkey", "l_linenumber", "units"), "units").drop("units")


@query("up_name_size", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' g' WHEN 1 THEN p_size || '.5kg' WHEN 2 THEN p_size || 'ml' WHEN 3 THEN NULL END AS size FROM part WHERE p_partkey % 5 < 5")
def name_size(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    end = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(" G"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(".5kg  "))).when(k == 2, F.concat(F.lit(" "), n, F.lit("mL"))).when(k == 3, F.concat(F.lit(" "), n, F.lit(" g each"))).otherwise("")
    return _t(spark, sf_dir, "part").select("p_partkey", X.size_in_name(F.concat("p_name", end)).alias("size"))


@query(
    "kb_shown_brand",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN p_brand ELSE 'Saver''s' END AS brand, CASE p_partkey % 3 WHEN 0 THEN 'Save-On-Foods' WHEN 1 THEN 'Metro' END AS chain FROM part",
)
def brand_shown(spark, sf_dir):
    k = F.col("p_partkey")
    brand = F.when(k % 5 == 0, "You SAVE $0.53").when(k % 5 == 1, F.concat(F.lit("$"), k.cast("string"), F.lit(".00"))).when(k % 5 == 3, F.concat(F.lit("  "), "p_brand", F.lit(" "))).when(k % 5 == 4, "Saver's")
    vendor = F.when(k % 3 == 0, "SaveOnFoods").when(k % 3 == 1, "Metro")
    return _t(spark, sf_dir, "part").select("p_partkey", C.shown_brand(brand).alias("brand"), C.chain_label(vendor).alias("chain"))


_VENDOR_LIST = "['" + "', '".join(C.VENDORS) + "']"


@query("kb_vendor_in_id", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN ({_VENDOR_LIST})[o_orderkey % 9 + 1] END AS vendor FROM orders")
def vendor_in_id(spark, sf_dir):
    names = F.array(*map(F.lit, (*C.VENDORS, "x")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", C.vendor_in_id(F.concat(F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")), F.col("o_orderkey").cast("string"))).alias("vendor"))


@query(
    "kb_store_brand_lists",
    "SELECT p_partkey, p_partkey % 4 = 0 AS before, p_partkey % 4 IN (0, 1) AS now, p_partkey % 6 IN (0, 1) AS junk_before, p_partkey % 6 IN (0, 1, 2) AS junk_now FROM part",
)
def store_brand_lists(spark, sf_dir):
    k = F.col("p_partkey")
    brand = F.when(k % 4 == 0, "no name").when(k % 4 == 1, " zenshi ").when(k % 4 == 2, F.col("p_brand"))
    junk = F.when(k % 6 == 0, "N/A").when(k % 6 == 1, " null").when(k % 6 == 2, "..").when(k % 6 == 3, F.col("p_brand"))
    vendor = F.lit("Loblaws")
    return _t(spark, sf_dir, "part").select("p_partkey", C.is_store_brand(vendor, brand, C.STORE_BRANDS_V0).alias("before"), C.is_store_brand(vendor, brand).alias("now"), C.is_junk_brand(junk, C.JUNK_BRANDS_V0).alias("junk_before"), C.is_junk_brand(junk).alias("junk_now"))


# ---- contracts, held against rows that break them


def _prices(spark, sf_dir):
    """The price model, with prices lost in every eleventh row and multibuy totals unshared in every thirteenth."""
    rows = stg_price(observations(spark, sf_dir), catalogue(spark, sf_dir))
    k = F.col("src_rowid")
    return rows.withColumn("unit_price", F.when(k % 11 == 0, None).when((k % 13 == 0) & (F.col("offer_type") == "multibuy"), 9.0).otherwise(F.col("unit_price")))


def _price_contract(spark, sf_dir, name):
    price = _prices(spark, sf_dir)
    raw, product = observations(spark, sf_dir), stg_product(catalogue(spark, sf_dir))
    return contracts.price_contracts(price, raw, product, "20260803T120000Z", {2202: 1})[name].select("src_rowid")


_ROWS = "o AS (SELECT l_orderkey * 10 + l_linenumber AS src_rowid, l_linenumber, l_linenumber % 3 AS kind, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_shipdate AS DATE) AS d FROM lineitem)"


@query("dq03_parsed", f"WITH {_ROWS} SELECT src_rowid FROM o WHERE src_rowid % 11 = 0 AND kind < 2")
def parsed(spark, sf_dir):
    return _price_contract(spark, sf_dir, "price.parsed")


@query("dq03_multibuy", f"WITH {_ROWS} SELECT src_rowid FROM o WHERE kind = 1 AND q > 1 AND src_rowid % 13 = 0 AND src_rowid % 11 <> 0")
def multibuy(spark, sf_dir):
    return _price_contract(spark, sf_dir, "price.multibuy")


@query("dq03_cents", f"WITH {_ROWS} SELECT src_rowid FROM o WHERE kind = 0 AND cents > 10000 AND src_rowid % 11 <> 0")
def cents(spark, sf_dir):
    return _price_contract(spark, sf_dir, "price.cents")


def _products(spark, sf_dir):
    """The product model; every seventh brand is no brand, every eleventh is blank, and every fifth class is wrong."""
    k = F.col("id").substr(2, 20).cast("long")
    source = catalogue(spark, sf_dir).withColumn("brand", F.when(k % 7 == 0, " N/A").when(k % 11 == 0, "  ").otherwise(F.col("brand")))
    number = F.col("sku").cast("long")
    return source, stg_product(source).withColumn("brand_class", F.when(number % 5 == 0, "national_brand").otherwise(F.col("brand_class")))


@query("dq03_junk_brand", "SELECT CAST(p_partkey AS VARCHAR) AS sku FROM part WHERE p_size > 5 AND p_partkey % 5 = 0 AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0)")
def junk_brand(spark, sf_dir):
    source, product = _products(spark, sf_dir)
    return contracts.product_contracts(product, source)["product.junk_brand"].select("sku")


_MATCHED = "c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Walmart' WHEN 1 THEN 'Voila' ELSE 'Metro' END AS vendor, lpad(CAST(p_partkey % 400 AS VARCHAR), 12, '7') AS g FROM part WHERE p_size > 5), s AS (SELECT g, count(DISTINCT vendor) AS n, count(DISTINCT vendor) FILTER (WHERE vendor = 'Voila') AS f FROM c GROUP BY 1), m AS (SELECT md5(vendor || chr(31) || p_partkey) AS product_key, vendor, n, f FROM c JOIN s USING (g))"


def _matches(spark, sf_dir):
    """The match model; Metro's tiers say too much, and Walmart's rows claim to be reliable."""
    product = stg_product(catalogue(spark, sf_dir))
    found = int_upc_match(product)
    loud = F.when(F.col("vendor") == "Metro", "vendor_upc").otherwise(F.col("match_tier"))
    return found.withColumn("match_tier", loud).withColumn("is_reliable_only", F.col("is_reliable_only") | (F.col("vendor") == "Walmart")), product


@query("dq03_weakest_tier", f"WITH {_MATCHED} SELECT product_key FROM m WHERE vendor = 'Metro' AND f > 0 AND n >= 2")
def weakest(spark, sf_dir):
    return contracts.match_contracts(*_matches(spark, sf_dir))["match.weakest"].select("product_key")


@query("dq03_reliable_only", f"WITH {_MATCHED} SELECT product_key FROM m WHERE vendor = 'Walmart' AND (f > 0 OR n < 2)")
def reliable(spark, sf_dir):
    return contracts.match_contracts(*_matches(spark, sf_dir))["match.reliable"].select("product_key")


#: The contracts of the three models, in their order; what breaks is said in the SQL.
_CLEAN = {
    "price": "rowid.unique rowid.not_null key.related date.window offer.not_null offer.accepted basis.accepted confidence.not_null confidence.accepted old_offer.not_null old_offer.accepted rows parsed multibuy cents null_dates",
    "product": "key.unique key.not_null key_basis.not_null key_basis.accepted vendor.not_null vendor.accepted uom.accepted unit_confidence.not_null unit_confidence.accepted brand.not_null brand.accepted tier.not_null tier.accepted rows junk_brand",
    "match": "key.unique key.not_null key.related tier.not_null tier.accepted vendor_tier.not_null vendor_tier.accepted reliable.not_null rows weakest reliable",
}
_NAMES = ", ".join(f"('{table}.{x}')" for table, names in _CLEAN.items() for x in names.split())


@query(
    "dq03_every_contract",
    f"""WITH {_ROWS}, t(test) AS (VALUES {_NAMES})
    SELECT test, CASE test WHEN 'price.rowid.unique' THEN (SELECT count(*) FROM (SELECT src_rowid FROM o GROUP BY 1 HAVING count(*) > 1)) WHEN 'price.cents' THEN (SELECT count(*) FROM o WHERE kind = 0 AND cents > 10000)
     WHEN 'price.date.window' THEN (SELECT count(*) FROM o WHERE l_linenumber % 7 <> 6 AND (d < DATE '2024-02-28' OR d > DATE '2026-08-03'))
     WHEN 'price.null_dates' THEN (SELECT count(DISTINCT 1) FROM o WHERE l_linenumber % 7 = 6 HAVING count(*) <> 3) ELSE 0 END AS n FROM t""",
)
def every_contract(spark, sf_dir):
    source, raw = catalogue(spark, sf_dir), observations(spark, sf_dir)
    product = stored(stg_product(source), "products")
    price, match = stored(stg_price(raw, source), "prices"), stored(int_upc_match(product), "matches")
    tests = contracts.price_contracts(price, raw, product, "20260803T120000Z", {2202: 3}) | contracts.product_contracts(product, source) | contracts.match_contracts(match, product)
    return readers.inline(spark, [(name, found.count()) for name, found in tests.items()], "test string, n long")


@query(
    "dq04_schema_contract",
    """SELECT column_name, CASE column_name WHEN 'p_size' THEN 'TYPE MISMATCH' ELSE 'UNEXPECTED' END AS kind FROM information_schema.columns WHERE table_name = 'part' AND column_name NOT IN ('p_partkey', 'p_name') UNION ALL SELECT 'p_colour', 'MISSING'""",
)
def schema_contract(spark, sf_dir):
    found = _t(spark, sf_dir, "part").schema
    wanted = T.StructType([found["p_partkey"], found["p_name"], T.StructField("p_size", T.StringType()), T.StructField("p_colour", T.StringType())])
    return readers.inline(spark, [(p.column, p.kind) for p in schema.differences("part", found, wanted)], "column_name string, kind string")


@query("dq05_row_count", "SELECT count(*) AS rows_in, count(*) AS rows_out, true AS refused FROM orders")
def row_count(spark, sf_dir):
    o, path = _t(spark, sf_dir, "orders"), scratch(spark, "model")
    n = o.count()
    out, refused = sinks.write_model(o, path, n), False
    try:
        sinks.write_model(o.where("o_orderkey % 2 = 0"), scratch(spark, "short"), n)
    except ValueError:
        refused = True
    return readers.inline(spark, [(n, out, refused)], "rows_in long, rows_out long, refused boolean")


@query("dq06_cache_checksums", "SELECT 'c_acctbal' AS column_name UNION ALL SELECT 'c_name'")
def cache_checksums(spark, sf_dir):
    """Which columns of a stored copy aren't what the table gives: a few changed balances, and two names that were swapped."""
    c = _t(spark, sf_dir, "customer")
    stored = c.withColumn("c_acctbal", F.expr("if(c_custkey % 50 = 1, c_acctbal + 1, c_acctbal)")).withColumn("c_name", F.expr("if(c_custkey = 1, concat(c_name, ' '), c_name)"))
    return readers.inline(spark, [(x,) for x in contracts.cache_differences(stored.repartition(3), c)], "column_name string")


@query("dq07_twice", "SELECT 'grouped' AS what, 'same' AS verdict UNION ALL SELECT 'random', 'different' UNION ALL SELECT 'broken', 'failed'")
def run_twice(spark, sf_dir):
    cases = {
        "grouped": lambda: _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")),
        "random": lambda: _t(spark, sf_dir, "part").withColumn("x", F.rand()),
        "broken": lambda: _t(spark, sf_dir, "part").select("no_such_column"),
    }
    return readers.inline(spark, [(k, contracts.twice(f)) for k, f in cases.items()], "what string, verdict string")


#: Statements over the given tables: hazards of order, what remarks say to them, and what only looks like either.
_SCRIPT = """-- total: said of nothing below
SELECT o_custkey, any_value(o_orderstatus) AS status
FROM orders GROUP BY o_custkey;

/* determinism-ok: a nation's key is unique; it has one name */
SELECT n_nationkey, any_value(n_name) AS name, '-- total: this is a string, no remark; at all' AS text FROM nation GROUP BY n_nationkey;
SELECT l_orderkey, x FROM (
    SELECT l_orderkey,
           max_by(l_quantity, l_extendedprice) AS x -- total: fine
    FROM lineitem GROUP BY l_orderkey
) WHERE x > (SELECT min(p_size) FROM (SELECT p_size FROM part
    LIMIT 7));



SELECT o_custkey, o_orderkey,
       row_number() OVER w AS nr,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE));
WITH s AS (SELECT n_regionkey, collect_list(n_name) AS names, array_sort(collect_list(n_name)) AS sorted FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, size(names) AS n, sorted FROM s ORDER BY n_regionkey LIMIT 3;
"""
_HAZARDS = """(1, 2, 'any_value of a group', 'said of nothing below'), (2, 6, 'any_value of a group', 'a nation''s key is unique; it has one name'), (3, 9, 'max_by of a group', 'a nation''s key is unique; it has one name'),
    (3, 12, 'limit without an order', NULL), (4, 17, 'row_number over ties', NULL), (4, 18, 'dense_rank over ties', NULL), (5, 20, 'collect_list without an order', NULL)"""


@query("dq08_loose_sql", f"""WITH h(statement, line, what, reason) AS (VALUES {_HAZARDS}),
    c AS (SELECT 1 AS statement, 'any_value of a group' AS what, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS broken FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey)
    UNION ALL SELECT 2, 'any_value of a group', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT n_name) AS n FROM nation GROUP BY n_nationkey)
    UNION ALL SELECT 3, 'max_by of a group', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT l_quantity) AS n FROM lineitem QUALIFY l_extendedprice = max(l_extendedprice) OVER (PARTITION BY l_orderkey) GROUP BY l_orderkey)
    UNION ALL SELECT 4, 'row_number over ties', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE))
    UNION ALL SELECT 5, 'collect_list without an order', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT n_name) AS n FROM nation GROUP BY n_regionkey))
    SELECT h.*, groups, broken FROM h LEFT JOIN c USING (statement, what)""".replace("SELECT count(DISTINCT l_quantity) AS n FROM lineitem QUALIFY l_extendedprice = max(l_extendedprice) OVER (PARTITION BY l_orderkey) GROUP BY l_orderkey", "SELECT count(DISTINCT l_quantity) AS n FROM (SELECT * FROM lineitem QUALIFY l_extendedprice = max(l_extendedprice) OVER (PARTITION BY l_orderkey)) GROUP BY l_orderkey"))
def loose_sql(spark, sf_dir):
    """Hazards of order in statements over the given tables, and in how many groups the data leave each of them open."""
    tables = ("orders", "nation", "lineitem", "part")
    for t in tables:
        _t(spark, sf_dir, t).createOrReplaceTempView(t)
    found = readers.inline(spark, [(h.statement, h.line, h.what, h.reason) for h in lint.hazards(spark, _SCRIPT)], "statement int, line int, what string, reason string")
    found = found.join(lint.claims(spark, _SCRIPT), ["statement", "what"], "left").select("statement", "line", "what", "reason", "groups", "broken")
    for t in tables:  # the plans hold what the names stood for
        spark.catalog.dropTempView(t)
    return found


@query("dq09_layering", "SELECT 'offers.product_id' AS leak")
def layers(spark, sf_dir):
    price = stg_price(observations(spark, sf_dir), catalogue(spark, sf_dir))
    models = {"stg_price": price, "int_upc_match": int_upc_match(stg_product(catalogue(spark, sf_dir))), "offers": price.select("product_id", "unit_price")}
    return readers.inline(spark, [(x,) for x in contracts.layering(models, ["stg_price"])], "leak string")


@query("dq09_lineage", """SELECT * FROM (VALUES ('renamed', 'pid'), ('hashed', 'h'), ('hashed', 'twice'), ('grouped', 'pid'), ('grouped', 'last'), ('united', 'k'), ('joined', NULL), ('windowed', 'before'), ('nested', 'x')) t(model, leak_column)""")
def layering_by_lineage(spark, sf_dir):
    """Models that keep a source's own id under another name, hashed, counted by, or in a condition; and three that don't."""
    price = stg_price(observations(spark, sf_dir), catalogue(spark, sf_dir))
    product = stg_product(catalogue(spark, sf_dir))
    keyed = price.select("product_key", F.col("product_id").alias("pid"), "unit_price")
    other = price.select(F.col("product_key").alias("other"), "offer_type", F.col("product_id").alias("oid"))
    models = {
        "stg_price": price, "int_upc_match": int_upc_match(product.drop("product_id")), "sums": price.groupBy("product_key").agg(F.sum("unit_price").alias("s")),
        "renamed": keyed.select("pid", "unit_price"), "hashed": keyed.select("product_key", F.md5("pid").alias("h")).withColumn("twice", F.upper(F.concat("h", F.lit("-")))),
        "grouped": keyed.groupBy("pid").agg(F.max("unit_price").alias("p"), F.max(F.length("pid")).alias("last")), "united": price.select(F.col("product_key").alias("k")).unionAll(keyed.select("pid")),
        "joined": price.select("product_key", F.col("product_id").alias("a")).join(other, F.col("a") == F.col("oid")).select("product_key", "offer_type"),
        "windowed": keyed.select("product_key", F.lag("pid").over(Window.partitionBy("product_key").orderBy("unit_price")).alias("before")),
        "nested": keyed.select("product_key", F.explode(F.array(F.struct("pid"))).alias("x")), "staged_away": keyed.drop("pid"),
    }
    return readers.inline(spark, [(m, c) for m, c, _ in lint.layering(models, ["stg_price"])], "model string, leak_column string")


@query("sf_functions_of_a_database", """SELECT p_partkey, lower(trim(p_name)) AS name, CAST(p_size AS DOUBLE) AS stated, upper(p_brand) AS brand, lpad(CAST(p_partkey + 100000000000 AS VARCHAR), 14, '0') AS gtin FROM part WHERE p_size > 1""")
def functions_of_a_database(spark, sf_dir):
    """Functions kept in a database, called by a session that didn't make them."""
    register(spark, "quern_functions")
    other = spark.newSession()
    other.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("listed")
    return other.sql("""SELECT p_partkey, quern_functions.norm(p_name) AS name, quern_functions.ppu_amt(concat('$', p_size, '.00/100g')) AS stated, quern_functions.b_norm(p_brand) AS brand,
        quern_functions.gtin14(cast(p_partkey + 100000000000 AS string)) AS gtin FROM listed WHERE p_size > 1""")


@query("sf_calendar_function", "SELECT event_type, CAST(unnest(generate_series(f, t, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT event_type, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS t FROM events GROUP BY 1)")
def calendar_function(spark, sf_dir):
    register(spark, "quern_functions")
    other = spark.newSession()
    other.sql("USE quern_functions")
    other.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("happened")
    return other.sql("SELECT event_type, c.d FROM (SELECT event_type, min(cast(ts AS date)) AS f, max(cast(ts AS date)) AS t FROM happened GROUP BY event_type), LATERAL calendar_days(f, t) c")


@query(
    "sc_types",
    "SELECT p_partkey, TRY_CAST(p_name AS BIGINT) IS NULL AS no_number, CAST(p_size AS VARCHAR) AS size_text, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS size_number, CAST(p_size % 2 AS BOOLEAN) AS odd, CAST(p_size AS DOUBLE) / 4 AS quarter, CAST('2024-02-' || lpad(CAST(1 + p_size % 29 AS VARCHAR), 2, '0') AS DATE) AS d FROM part",
)
def types(spark, sf_dir):
    size = F.col("p_size").cast("string")
    day = F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("p_size") % 29).cast("string"), 2, "0")).cast("date")
    return _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").try_cast("long").isNull().alias("no_number"), size.alias("size_text"), size.cast("long").alias("size_number"), (F.col("p_size") % 2).cast("boolean").alias("odd"), (F.col("p_size").cast("double") / 4).alias("quarter"), day.alias("d"))
