"""Queries over free text: prices, sizes, brands, names, shapes, urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import catalogue as C
from quern.functions import text as X
from quern.functions.prices import parse_prices
from quern.functions.units import display_size, parse_units, stated_unit_price
from quern.operators import audit
from quern.plans.models import int_upc_match, stg_price, stg_product
from quern.plans.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced(spark, sf_dir):
    """lineitem with a price text made of its whole numbers, in twelve spellings, and a vendor."""
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long")).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    price = F.concat(F.expr("cast(cents div 100 as string)"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    q, cents = F.col("q"), F.col("cents")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    spelled = {0: price, 1: s(q, "/$", price), 2: s(cents, "$"), 3: s("Now$", cents), 4: s(cents % 100, "¢"), 5: s(price, "/", q * 10, "g"), 6: s(price, "/kg"), 7: s(price, " avg/lb"), 8: s(price, " avg/ea"), 9: F.lit("  "), 10: s("was ", price), 11: s(q, ",", F.lpad((cents % 1000).cast("string"), 3, "0"), ".5")}
    raw = None
    for k, v in spelled.items():
        raw = (F if raw is None else raw).when(kind == k, v)
    vendor = F.when(F.col("l_suppkey") % 3 == 0, "Walmart").when(F.col("l_suppkey") % 3 == 1, "Voila")
    return li.select("l_orderkey", "l_linenumber", "q", "cents", kind.cast("long").alias("kind"), raw.alias("raw"), vendor.alias("vendor"))


#: The same texts' meaning, told from the numbers they were made of.
_KIND = """p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, (l_orderkey + l_linenumber) % 12 AS kind, l_suppkey % 3 AS v FROM lineitem)"""
_MEANT = f"""WITH {_KIND} SELECT l_orderkey, l_linenumber,
 CASE WHEN kind = 1 THEN 'multibuy' WHEN kind IN (5,6,7,8) THEN 'per_weight' WHEN kind = 9 THEN 'blank' WHEN kind = 10 THEN 'unparsed' ELSE 'scalar' END AS offer_type,
 CASE kind WHEN 0 THEN cents / 100.0::DOUBLE WHEN 1 THEN (cents / 100.0::DOUBLE) / q WHEN 2 THEN cents / 100.0::DOUBLE WHEN 3 THEN cents / 100.0::DOUBLE WHEN 4 THEN (cents % 100) / 100.0::DOUBLE
  WHEN 5 THEN (cents / 100.0::DOUBLE) * (100.0::DOUBLE / (q * 10)) WHEN 6 THEN (cents / 100.0::DOUBLE) * (100.0::DOUBLE / 1000) WHEN 7 THEN (cents / 100.0::DOUBLE) * (100.0::DOUBLE / 453.592::DOUBLE) WHEN 8 THEN cents / 100.0::DOUBLE
  WHEN 11 THEN q * 1000 + cents % 1000 + 0.5::DOUBLE END AS unit_price,
 CASE WHEN kind = 9 THEN NULL WHEN kind = 1 THEN CAST(q AS DOUBLE) ELSE 1.0::DOUBLE END AS min_qty,
 CASE WHEN kind IN (5,6,7) THEN 'per_100g' WHEN kind IN (9,10) THEN NULL ELSE 'each' END AS price_basis,
 CASE WHEN kind IN (0,1,8) THEN 'none' WHEN kind = 2 THEN 'cents_div100' WHEN kind = 3 THEN 'now_prefix_cents_div100' WHEN kind = 4 THEN 'cent_symbol_div100' WHEN kind = 5 AND q = 10 THEN 'none' WHEN kind IN (5,6,7) THEN 'basis_rescaled' WHEN kind = 11 THEN 'thousands_sep' END AS normalization,
 CASE WHEN kind = 11 AND v = 1 THEN 'ambiguous' WHEN kind IN (0,11) THEN 'exact' WHEN kind IN (1,2,3,4) THEN 'derived' WHEN kind IN (5,6,7,8) THEN 'inferred' ELSE 'none' END AS parse_confidence
FROM p"""


@query("pp_price_fields", _MEANT)
def price_fields(spark, sf_dir):
    return parse_prices(priced(spark, sf_dir), {"": "raw"}, vendor="vendor").select("l_orderkey", "l_linenumber", "offer_type", "unit_price", "min_qty", "price_basis", "normalization", "parse_confidence")


@query("pp_coverage", f"WITH m AS ({_MEANT}) SELECT offer_type, price_basis, normalization, parse_confidence, count(*) AS n, count(unit_price) AS priced FROM m GROUP BY 1,2,3,4")
def price_coverage(spark, sf_dir):
    return price_fields(spark, sf_dir).groupBy("offer_type", "price_basis", "normalization", "parse_confidence").agg(F.count(F.lit(1)).alias("n"), F.count("unit_price").alias("priced"))


_BARE = "WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * (1 + l_linenumber) AS n, CASE l_suppkey % 4 WHEN 0 THEN 'Walmart' WHEN 1 THEN 'Galleria' WHEN 2 THEN 'Metro' END AS vendor FROM lineitem) "


@query(
    "pp_vendor_rules",
    _BARE + """SELECT vendor, CASE WHEN vendor = 'Walmart' AND n >= 100 THEN 'bare_integer_cents' ELSE 'none' END AS normalization,
    CASE WHEN vendor = 'Walmart' AND n >= 100 THEN 'derived' WHEN vendor = 'Walmart' AND n >= 10 OR vendor = 'Galleria' THEN 'ambiguous' ELSE 'exact' END AS parse_confidence,
    count(*) AS rows, CAST(sum(CASE WHEN vendor = 'Walmart' AND n >= 100 THEN n ELSE n * 100 END) AS BIGINT) AS cents FROM b GROUP BY 1,2,3""",
)
def vendor_rules(spark, sf_dir):
    n = (F.col("l_quantity").cast("long") * (1 + F.col("l_linenumber"))).cast("string")
    vendor = F.when(F.col("l_suppkey") % 4 == 0, "Walmart").when(F.col("l_suppkey") % 4 == 1, "Galleria").when(F.col("l_suppkey") % 4 == 2, "Metro")
    rows = parse_prices(_t(spark, sf_dir, "lineitem").select(n.alias("raw"), vendor.alias("vendor")), {"": "raw"}, vendor="vendor")
    return rows.groupBy("vendor", "normalization", "parse_confidence").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("unit_price") * 100).cast("long")).alias("cents"))


_SIZED = """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + 2 * l_linenumber) % 10 AS kind FROM lineitem) """


def sized(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long").cast("string"))
    kind, q = (F.col("l_orderkey") + 2 * F.col("l_linenumber")) % 10, F.col("q")
    spelled = {0: F.concat(q, F.lit("g")), 1: F.concat(q, F.lit(".5 kg")), 2: F.concat(q, F.lit(" x 355 mL")), 3: F.concat(F.lit("60gx"), q), 4: F.concat(q, F.lit("ea")), 5: F.concat(q, F.lit(" per pack")), 6: F.concat(q, F.lit(" fl oz")), 7: F.lit("n/a"), 8: F.lit("as it comes"), 9: F.concat(q, F.lit("LB"))}
    raw = None
    for k, v in spelled.items():
        raw = (F if raw is None else raw).when(kind == k, v)
    return li.select("l_orderkey", "l_linenumber", raw.alias("units"))


@query(
    "up_unit_fields",
    _SIZED + """SELECT l_orderkey, l_linenumber,
    CASE kind WHEN 0 THEN CAST(q AS DOUBLE) WHEN 1 THEN (q + 0.5::DOUBLE) * 1000 WHEN 2 THEN 355.0::DOUBLE WHEN 3 THEN 60.0::DOUBLE WHEN 4 THEN 1.0::DOUBLE WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN q * 29.5735::DOUBLE WHEN 9 THEN q * 453.592::DOUBLE END AS unit_qty,
    CASE WHEN kind IN (0,1,3,9) THEN 'g' WHEN kind IN (2,6) THEN 'ml' WHEN kind IN (4,5) THEN 'count' END AS unit_uom,
    CASE WHEN kind IN (2,3,4,5) THEN CAST(q AS DOUBLE) WHEN kind = 7 THEN NULL ELSE 1.0::DOUBLE END AS pack_count,
    CASE WHEN kind IN (4) THEN 'exact' WHEN kind = 5 THEN 'inferred' WHEN kind IN (2,3) AND q > 1 THEN 'derived' WHEN kind IN (7,8) THEN 'none' ELSE 'exact' END AS unit_parse_confidence FROM s""",
)
def unit_fields(spark, sf_dir):
    return parse_units(sized(spark, sf_dir), "units").select("l_orderkey", "l_linenumber", "unit_qty", "unit_uom", "pack_count", "unit_parse_confidence")


@query(
    "up_display_size",
    _SIZED + r"""SELECT CASE kind WHEN 0 THEN q || ' g' WHEN 1 THEN (q * 1000 + 500) || ' g' WHEN 2 THEN CASE WHEN q > 1 THEN q || ' x ' ELSE '' END || '355 ml' WHEN 3 THEN CASE WHEN q > 1 THEN q || ' x ' ELSE '' END || '60 g'
    WHEN 4 THEN CASE WHEN q > 1 THEN q || ' x ' ELSE '' END || '1 count' WHEN 6 THEN regexp_replace(regexp_replace(printf('%.2f', CAST(q * 29.5735::DOUBLE AS DOUBLE)), '0+$', ''), '\.$', '') || ' ml'
    WHEN 9 THEN regexp_replace(regexp_replace(printf('%.2f', CAST(q * 453.592::DOUBLE AS DOUBLE)), '0+$', ''), '\.$', '') || ' g' ELSE '' END AS size, count(*) AS n FROM s GROUP BY 1""",
)
def displayed(spark, sf_dir):
    rows = parse_units(sized(spark, sf_dir), "units")
    return rows.groupBy(display_size(F.col("unit_qty"), F.col("unit_uom"), F.col("pack_count"), F.col("unit_parse_confidence")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "an15_agreement",
    """WITH s AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS c, l_linenumber FROM lineitem),
    o AS (SELECT l_returnflag, 100.0::DOUBLE * abs((c * (100 + CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 30 END)) / 100.0::DOUBLE - CAST(c AS DOUBLE)) / CAST(c AS DOUBLE) AS off FROM s)
    SELECT l_returnflag, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE off > 1) / count(*) AS off_1_pct, 100.0::DOUBLE * count(*) FILTER (WHERE off > 10) / count(*) AS off_10_pct, round(median(off), 6) AS median_off_pct FROM o GROUP BY 1""",
)
def stated_agreement(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("c", F.round("l_extendedprice").cast("long"))
    m = 100 + F.when(F.col("l_linenumber") % 4 == 0, 0).when(F.col("l_linenumber") % 4 == 1, 2).when(F.col("l_linenumber") % 4 == 2, 5).otherwise(30)
    text = F.concat(F.lit("$"), F.expr("cast((c * m) div 100 as string)"), F.lit("."), F.lpad(((F.col("c") * F.col("m")) % 100).cast("string"), 2, "0"), F.lit("/ea"))
    rows = li.withColumn("m", m).withColumn("ppu", text)
    out = audit.agreement(rows, stated_unit_price(F.col("ppu"))["ppu_amount"], F.col("c").cast("double"), ["l_returnflag"])
    return out.withColumn("median_off_pct", F.round("median_off_pct", 6))


@query(
    "kb_keys",
    """WITH p AS (SELECT 'Metro' AS vendor, CASE WHEN p_partkey % 5 = 0 THEN '  ' WHEN p_partkey % 7 = 0 THEN NULL ELSE ' ' || p_partkey || ' ' END AS sku, p_name || '@' || p_size AS listing, p_partkey FROM part)
    SELECT p_partkey, md5(vendor || chr(31) || CASE WHEN sku IS NOT NULL AND trim(sku) <> '' THEN trim(sku) ELSE '#c:' || listing END) AS product_key, CASE WHEN sku IS NOT NULL AND trim(sku) <> '' THEN 'vendor_sku' ELSE 'vendor_concatted' END AS basis FROM p""",
)
def keys(spark, sf_dir):
    k = F.col("p_partkey")
    sku = F.when(k % 5 == 0, "  ").when(k % 7 != 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    listing = F.concat("p_name", F.lit("@"), F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", C.product_key(F.lit("Metro"), sku, listing).alias("product_key"), C.product_key_basis(sku).alias("basis"))


_UPC = "CASE p_partkey % 6 WHEN 0 THEN '0-' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 14, '0') WHEN 2 THEN '000000000000' WHEN 3 THEN CAST(4000 + p_partkey % 1000 AS VARCHAR) WHEN 4 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '1') END"


@query(
    "kb_gtin",
    f"""WITH u AS (SELECT p_partkey, regexp_replace(coalesce({_UPC}, ''), '[^0-9]', '', 'g') AS d FROM part)
    SELECT p_partkey, CASE WHEN length(d) BETWEEN 11 AND 14 AND NOT regexp_full_match(d, '0+') THEN lpad(d, 14, '0') END AS gtin14, length(d) BETWEEN 4 AND 5 AS is_short FROM u""",
)
def gtins(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 6
    upc = F.when(m == 0, F.concat(F.lit("0-"), F.lpad(k, 11, "0"))).when(m == 1, F.lpad(k, 14, "0")).when(m == 2, "000000000000").when(m == 3, (4000 + F.col("p_partkey") % 1000).cast("string")).when(m == 4, F.lpad(k, 9, "1"))
    d = C.barcode_digits(upc)
    return _t(spark, sf_dir, "part").select("p_partkey", C.gtin14(d).alias("gtin14"), F.length(d).between(4, 5).alias("is_short"))


@query(
    "kb_brand_class",
    """WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Loblaws' WHEN 2 THEN 'Voila' ELSE NULL END AS vendor, CASE p_partkey % 7 WHEN 0 THEN ' no name' WHEN 1 THEN 'Selection ' WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Irrésistible' ELSE p_brand END AS brand FROM part),
    c AS (SELECT p_partkey, CASE WHEN vendor = 'Voila' THEN 'unclassifiable_no_vendor_data' WHEN trim(coalesce(brand, '')) = '' THEN 'unclassifiable_blank' WHEN lower(trim(brand)) = 'n/a' THEN 'unclassifiable_junk'
     WHEN vendor = 'Loblaws' AND upper(trim(brand)) = 'NO NAME' OR vendor = 'Metro' AND upper(trim(brand)) IN ('SELECTION', 'IRRÉSISTIBLE') THEN 'private_label' ELSE 'national_brand' END AS brand_class FROM b)
    SELECT p_partkey, brand_class, CASE WHEN brand_class LIKE 'unclassifiable%' THEN 'unclassifiable' ELSE brand_class END AS brand_class_coarse FROM c""",
)
def brands(spark, sf_dir):
    k = F.col("p_partkey")
    vendor = F.when(k % 4 == 0, "Metro").when(k % 4 == 1, "Loblaws").when(k % 4 == 2, "Voila")
    brand = F.when(k % 7 == 0, " no name").when(k % 7 == 1, "Selection ").when(k % 7 == 2, "N/A").when(k % 7 == 3, "").when(k % 7 == 5, "Irrésistible").when(k % 7 == 6, F.col("p_brand"))
    cls = C.brand_class(vendor, brand)
    return _t(spark, sf_dir, "part").select("p_partkey", cls.alias("brand_class"), C.coarse(cls).alias("brand_class_coarse"))


_WORDS = (" Bread", " Egg", " Milk", " Salmon Pasta", " Grape Soda", " Rice", " Cola")


@query(
    "kb_category",
    "WITH n AS (SELECT lower(p_name || CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " ELSE '' END) AS nm FROM part) "
    "SELECT CASE " + " ".join(f"WHEN regexp_matches(nm, '{words}') THEN '{label}'" for label, words in C.CATEGORIES) + " ELSE 'h. other' END AS category, count(*) AS n FROM n GROUP BY 1",
)
def categories(spark, sf_dir):
    k, extra = F.col("p_partkey") % 8, None
    for i, word in enumerate(_WORDS):
        extra = (F if extra is None else extra).when(k == i, word)
    name = F.concat("p_name", extra.otherwise(""))
    return _t(spark, sf_dir, "part").groupBy(C.category(name).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("kb_norm", r"SELECT doc_id, regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g') AS norm FROM documents")
def normalised_names(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.normalised(F.col("text")).alias("norm"))


@query(
    "an47_shape_census",
    r"""SELECT regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(c_name || ' - ' || CAST(c_nationkey AS VARCHAR) || chr(10) || c_mktsegment, ''), chr(10), '<a>'), chr(13), ''), '[A-Za-z]+', 'a', 'g'), '[0-9]+', 'N', 'g'), ' +', ' ', 'g') AS shape, count(*) AS n FROM customer GROUP BY 1""",
)
def shapes(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" - "), F.col("c_nationkey").cast("string"), F.lit("\n"), "c_mktsegment").alias("x"))
    return audit.shape_census(rows, "x").select("shape", "n")


@query(
    "kb_url_fields",
    "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN CAST(page_id AS VARCHAR) ELSE '' END AS rsid, CASE page_id % 4 WHEN 0 THEN 'pickup' WHEN 1 THEN 'delivery' ELSE '' END AS channel FROM pages",
)
def url_fields(spark, sf_dir):
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://shop/sm/pickup/rsid/"), n, F.lit("/p"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/sm/delivery/rsid/"), n, F.lit("/"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/rsid/x"), n, F.lit("/")))
    return _t(spark, sf_dir, "pages").select("page_id", *[F.coalesce(c, F.lit("")).alias(part) for part, c in C.store_in_url(url).items()])


@query(
    "kb_listing_parts",
    "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 'Metro' END AS vendor, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS brand FROM part",
)
def listings(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 9 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Metro~"), "p_name", F.lit("@"), F.col("p_size").cast("string"), F.lit("^"), "p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in C.listing_parts(text).items()])


@query(
    "kb_says_sale",
    """WITH n AS (SELECT l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'On SALE now' WHEN 1 THEN 'Out of Stock' WHEN 2 THEN '2 for $5' WHEN 3 THEN NULL WHEN 4 THEN ' ' WHEN 5 THEN 'was 3.99' ELSE 'fresh' END AS t FROM lineitem)
    SELECT l_linenumber, t IN ('On SALE now', '2 for $5', 'was 3.99') AND t IS NOT NULL AS says, count(*) AS n FROM n GROUP BY 1, 2""",
)
def sale_words(spark, sf_dir):
    t = None
    for i, word in ((0, "On SALE now"), (1, "Out of Stock"), (2, "2 for $5"), (4, " "), (5, "was 3.99"), (6, "fresh")):
        t = (F if t is None else t).when(F.col("l_linenumber") % 7 == i, word)
    return _t(spark, sf_dir, "lineitem").select("l_linenumber", C.says_sale(t).alias("says")).groupBy("l_linenumber", "says").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kb_id_shape",
    """WITH i AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'QmFz' || o_orderkey || '=' WHEN 1 THEN 'Metro' || o_orderkey WHEN 2 THEN 'Metro' || o_orderkey || 'a' WHEN 3 THEN 'red-' || o_orderkey ELSE o_orderkey || '!' END AS id, o_orderkey % 5 AS k FROM orders)
    SELECT CASE k WHEN 0 THEN 'base64-style (opaque, no sku)' WHEN 1 THEN 'vendor + numeric sku' WHEN 2 THEN 'vendor + alnum sku' WHEN 3 THEN 'contains hyphens (URL-slug shaped)' ELSE 'other' END AS id_shape, count(*) AS ids FROM i GROUP BY 1""",
)
def id_shapes(spark, sf_dir):
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("QmFz"), n, F.lit("="))).when(k == 1, F.concat(F.lit("Metro"), n)).when(k == 2, F.concat(F.lit("Metro"), n, F.lit("a"))).when(k == 3, F.concat(F.lit("red-"), n)).otherwise(F.concat(n, F.lit("!")))
    return _t(spark, sf_dir, "orders").groupBy(C.id_shape(text).alias("id_shape")).agg(F.count(F.lit(1)).alias("ids"))


@query(
    "an01_date_decode",
    """WITH n AS (SELECT o_orderkey, CAST(1990 + o_orderkey % 40 AS BIGINT) * 10000 + (o_orderkey % 14) * 100 + o_orderkey % 33 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN (n // 100) % 100 BETWEEN 1 AND 12 THEN try_cast(substr(CAST(n AS VARCHAR), 1, 4) || '-' || substr(CAST(n AS VARCHAR), 5, 2) || '-' || substr(CAST(n AS VARCHAR), 7, 2) AS DATE) END AS d FROM n""",
)
def decoded(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", C.decoded_date((1990 + k % 40) * 10000 + (k % 14) * 100 + k % 33).alias("d"))


# ---- models


def catalogue(spark, sf_dir):
    """Parts as products: a vendor by number, the part's size in grams, its brand; small parts aren't listed."""
    k = F.col("p_partkey")
    text = k.cast("string")
    vendor = F.when(k % 3 == 0, "Walmart").when(k % 3 == 1, "Voila").otherwise("Metro")
    upc = F.lpad((k % 400).cast("string"), 12, "7")
    parts = _t(spark, sf_dir, "part").where("p_size > 5")
    return parts.select(F.concat(F.lit("p"), text).alias("id"), F.concat(vendor, F.lit("~"), "p_name").alias("concatted"), vendor.alias("vendor"), F.col("p_name").alias("product_name"), F.concat(F.col("p_size").cast("string"), F.lit(" g")).alias("units"), F.col("p_brand").alias("brand"), F.lit("").alias("detail_url"), text.alias("sku"), upc.alias("upc"))


def observations(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    price = F.when(F.col("l_linenumber") % 3 == 0, F.concat(cents, F.lit("$"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.col("q").cast("string"), F.lit("/$9.00"))).otherwise("sold out")
    day = F.date_format("l_shipdate", "yyyyMMdd").cast("long")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src_rowid"), F.when(F.col("l_linenumber") % 7 != 6, day).otherwise(2202).alias("nowtime"), price.alias("current_price"), F.lit("4.50").alias("old_price"), F.lit("").alias("price_per_unit"), F.lit("").alias("other"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"))


_CATALOGUE = "c AS (SELECT p_partkey, 'p' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Walmart' WHEN 1 THEN 'Voila' ELSE 'Metro' END AS vendor, p_name, p_size, p_brand, lpad(CAST(p_partkey % 400 AS VARCHAR), 12, '7') AS upc FROM part WHERE p_size > 5)"


@query(
    "an02_stg_price",
    f"""WITH {_CATALOGUE}, o AS (SELECT l_orderkey * 10 + l_linenumber AS src_rowid, 'p' || l_partkey AS pid, CASE WHEN l_linenumber % 7 <> 6 THEN CAST(l_shipdate AS DATE) END AS observed_date, l_linenumber % 3 AS kind, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
    SELECT src_rowid, CASE WHEN c.id IS NOT NULL THEN md5(vendor || chr(31) || p_partkey) END AS product_key, observed_date, CASE kind WHEN 0 THEN 'scalar' WHEN 1 THEN 'multibuy' ELSE 'unparsed' END AS offer_type, CASE kind WHEN 0 THEN cents / 100.0::DOUBLE WHEN 1 THEN 9.0::DOUBLE / q END AS unit_price, CASE kind WHEN 2 THEN 'none' ELSE 'derived' END AS parse_confidence, 4.5::DOUBLE AS old_unit_price
    FROM o LEFT JOIN c ON c.id = o.pid""",
)
def model_prices(spark, sf_dir):
    return stg_price(observations(spark, sf_dir), catalogue(spark, sf_dir)).select("src_rowid", "product_key", "observed_date", "offer_type", "unit_price", "parse_confidence", "old_unit_price")


@query(
    "an03_stg_product",
    f"WITH {_CATALOGUE} SELECT md5(vendor || chr(31) || p_partkey) AS product_key, vendor, CAST(p_size AS DOUBLE) AS unit_qty, 'g' AS unit_uom, 1.0::DOUBLE AS pack_count, CASE WHEN vendor = 'Voila' THEN 'unclassifiable' ELSE 'national_brand' END AS brand_class_coarse, CASE vendor WHEN 'Metro' THEN 'vendor_upc' WHEN 'Walmart' THEN 'matched_upc' ELSE 'fuzzy' END AS upc_tier FROM c",
)
def model_products(spark, sf_dir):
    return stg_product(catalogue(spark, sf_dir)).select("product_key", "vendor", "unit_qty", "unit_uom", "pack_count", "brand_class_coarse", "upc_tier")


@query(
    "an04_int_upc_match",
    f"""WITH {_CATALOGUE}, s AS (SELECT upc, count(DISTINCT vendor) AS n, count(DISTINCT vendor) FILTER (WHERE vendor = 'Voila') AS f, count(DISTINCT vendor) FILTER (WHERE vendor = 'Walmart') AS m, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS who FROM c GROUP BY 1)
    SELECT md5(vendor || chr(31) || p_partkey) AS product_key, lpad(c.upc, 14, '0') AS gtin14, n AS n_vendors_on_gtin, f AS n_fuzzy_vendors_on_gtin, who AS vendors_on_gtin, CASE WHEN n < 2 THEN 'unmatched' WHEN f > 0 THEN 'fuzzy' WHEN m > 0 THEN 'matched_upc' ELSE 'vendor_upc' END AS match_tier, n >= 2 AND f = 0 AS is_reliable_only FROM c JOIN s ON s.upc = c.upc""",
)
def model_matches(spark, sf_dir):
    return int_upc_match(stg_product(catalogue(spark, sf_dir))).select("product_key", "gtin14", "n_vendors_on_gtin", "n_fuzzy_vendors_on_gtin", "vendors_on_gtin", "match_tier", "is_reliable_only")
