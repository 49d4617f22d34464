"""The analyses over a price panel made of the event table: products are users, vendors event types, and a day's price is
the least of its values in steps of 20."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quern.operators import audit, compare, stats, timeline
from quern.plans import contracts, publication, refresh
from quern.plans.models import barcode_span, sized
from quern.plans.registry import query
from quern.sources.shared import scratch
from quern.streaming import spells as stream

K = ["gtin", "vendor"]
OBS = "obs AS (SELECT user_id AS gtin, event_type AS vendor, CAST(ts AS DATE) AS d, min(floor(value / 20) + 1) AS px, max(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS on_sale FROM events GROUP BY 1, 2, 3)"
W = f"WITH {OBS}"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def N():
    return F.count(F.lit(1))


def panel(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("gtin"), F.col("event_type").alias("vendor"), F.col("ts").cast("date").alias("day"), (F.floor(F.col("value") / 20) + 1).cast("double").alias("price"), (F.col("value") < 10).alias("sale"))
    return timeline.daily(e, K, "day", "price", "sale")


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("panel_daily", f"{W} SELECT gtin, vendor, d, px, on_sale FROM obs")
def daily(spark, sf_dir):
    return panel(spark, sf_dir)


# ---- calendars and gaps

_MISSING = f"""{W}, days AS (SELECT DISTINCT gtin, d FROM obs), span AS (SELECT gtin, min(d) AS a FROM days GROUP BY 1),
cal AS (SELECT gtin, CAST(unnest(generate_series(a, (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS DATE) AS d FROM span), miss AS (SELECT * FROM cal ANTI JOIN days USING (gtin, d)),
runs AS (SELECT gtin, min(d) AS from_date, max(d) AS to_date, count(*) AS days FROM (SELECT gtin, d, d - CAST(row_number() OVER (PARTITION BY gtin ORDER BY d) AS INTEGER) AS g FROM miss) GROUP BY gtin, g)"""


@query("an05_missing_days", f"{_MISSING} SELECT gtin, d FROM miss")
def missing(spark, sf_dir):
    return timeline.missing_days(panel(spark, sf_dir), ["gtin"])


@query("an05_gap_windows", f"{_MISSING} SELECT gtin, from_date, to_date, days FROM runs WHERE days >= 2")
def gap_windows(spark, sf_dir):
    return timeline.gap_windows(panel(spark, sf_dir), ["gtin"])


@query("an05_gap_summary", f"{_MISSING} SELECT c.gtin, c.n AS expected_days, coalesce(r.m, 0) AS missing_days, coalesce(r.l, 0) AS longest_gap FROM (SELECT gtin, count(*) AS n FROM cal GROUP BY 1) c LEFT JOIN (SELECT gtin, CAST(sum(days) AS BIGINT) AS m, max(days) AS l FROM runs GROUP BY 1) r ON r.gtin = c.gtin")
def gap_summary(spark, sf_dir):
    return timeline.gap_summary(panel(spark, sf_dir), ["gtin"])


@query("an06_partial_days", "WITH n AS (SELECT event_type AS vendor, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, median(n) OVER (PARTITION BY vendor ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_median FROM n) SELECT vendor, d, n, trailing_median, CASE WHEN n < trailing_median * 0.6::DOUBLE THEN 60 WHEN n < trailing_median * 0.8::DOUBLE THEN 80 ELSE 90 END AS below FROM m WHERE n < trailing_median * 0.9::DOUBLE")
def partial(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("vendor"), F.col("ts").cast("date").alias("d"))
    return timeline.partial_days(rows, ["vendor"], trailing=7, shares=(90, 80, 60))


@query("an07_date_gaps", "WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders), l AS (SELECT d, lag(d) OVER (ORDER BY d) AS previous FROM d) SELECT d, previous, d - previous AS gap_days FROM l WHERE d - previous > 1")
def date_gaps(spark, sf_dir):
    return timeline.date_gaps(_t(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("d")))


@query("an08_day_ratio", "WITH n AS (SELECT event_type AS vendor, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, CAST(n AS DOUBLE) / lag(n) OVER (PARTITION BY vendor ORDER BY d) AS ratio FROM n")
def day_ratio(spark, sf_dir):
    return timeline.day_ratios(_t(spark, sf_dir, "events").select(F.col("event_type").alias("vendor"), F.col("ts").cast("date").alias("d")), ["vendor"])


# ---- profiles


@query(
    "an09_null_profile",
    """WITH r AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN ' ' ELSE 'x' END AS a, CASE WHEN l_quantity > 40 THEN NULL ELSE l_linestatus END AS b FROM lineitem),
    c AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE a IS NULL OR trim(a) = '') AS a, count(*) FILTER (WHERE b IS NULL OR trim(b) = '') AS b FROM r GROUP BY 1)
    SELECT g, n, 'a' AS "column", a AS empty, 100.0::DOUBLE * a / n AS empty_pct FROM c UNION ALL SELECT g, n, 'b', b, 100.0::DOUBLE * b / n FROM c""",
)
def null_profile(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(F.col("l_linenumber") % 3 == 1, " ").when(F.col("l_linenumber") % 3 == 2, "x").alias("a"), F.when(F.col("l_quantity") <= 40, F.col("l_linestatus")).alias("b"))
    return audit.null_profile(r, ["g"], ["a", "b"])


@query("an10_key_stability", "WITH e AS (SELECT l_returnflag AS g, l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2) SELECT g, count(*) AS series, 100.0::DOUBLE * count(*) FILTER (WHERE n = 1) / count(*) AS single_pct, max(n) AS most FROM e GROUP BY 1")
def key_stability(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("k"), "l_suppkey")
    return audit.key_stability(r, ["k"], "l_suppkey", ["g"])


_TIERED = "t AS (SELECT l_partkey AS gtin, l_suppkey % 9 AS vendor, CASE WHEN l_suppkey % 9 < 4 THEN 'vendor_upc' WHEN l_suppkey % 9 = 4 THEN 'matched_upc' ELSE 'fuzzy' END AS tier FROM lineitem)"


def tiered(spark, sf_dir):
    v = F.col("l_suppkey") % 9
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gtin"), v.alias("vendor"), F.when(v < 4, "vendor_upc").when(v == 4, "matched_upc").otherwise("fuzzy").alias("tier"))


@query("an04_barcode_span", f"WITH {_TIERED} SELECT gtin, count(DISTINCT vendor) AS n_vendors, count(DISTINCT vendor) FILTER (WHERE tier = 'vendor_upc') AS n_vendor_upc, count(DISTINCT vendor) FILTER (WHERE tier = 'matched_upc') AS n_matched_upc, count(DISTINCT vendor) FILTER (WHERE tier = 'fuzzy') AS n_fuzzy, string_agg(DISTINCT CAST(vendor AS VARCHAR), ',' ORDER BY CAST(vendor AS VARCHAR)) AS vendors_on_gtin FROM t GROUP BY 1")
def span(spark, sf_dir):
    return barcode_span(tiered(spark, sf_dir).withColumn("vendor", F.col("vendor").cast("string")), "gtin", "vendor", "tier")


@query("an11_overlap", f"WITH {_TIERED}, s AS (SELECT gtin, count(DISTINCT vendor) AS n_vendors, count(DISTINCT vendor) FILTER (WHERE tier = 'fuzzy') AS n_loose FROM t GROUP BY 1) SELECT n_vendors, n_loose, count(*) AS products FROM s GROUP BY 1, 2")
def overlap(spark, sf_dir):
    return compare.overlap(tiered(spark, sf_dir))


@query("an11_overlap_pairs", f"WITH {_TIERED}, d AS (SELECT DISTINCT gtin, vendor FROM t) SELECT x.vendor AS a, y.vendor AS b, count(*) AS products FROM d x JOIN d y ON x.gtin = y.gtin AND y.vendor > x.vendor GROUP BY 1, 2")
def overlap_pairs(spark, sf_dir):
    return compare.overlap_pairs(tiered(spark, sf_dir))


@query("an12_basket", f"{W}, c AS (SELECT gtin, d FROM obs GROUP BY 1, 2 HAVING count(DISTINCT vendor) >= 2) SELECT gtin, count(*) AS co_days FROM c GROUP BY 1 HAVING count(*) >= 10")
def basket(spark, sf_dir):
    return compare.basket(panel(spark, sf_dir), least_days=10)


@query("an13_duplicate_days", "WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) AS n, min(value) <> max(value) AS c FROM events GROUP BY 1, 2, 3) SELECT count(*) AS key_days, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE c) AS conflicting, max(n) AS most_rows FROM e")
def duplicates(spark, sf_dir):
    return audit.duplicate_days(_t(spark, sf_dir, "events").withColumn("d", F.col("ts").cast("date")), ["user_id", "event_type", "d"], "value")


@query("an14_movement", f"{W}, m AS (SELECT gtin, vendor, count(DISTINCT px) AS n FROM obs GROUP BY 1, 2) SELECT vendor, count(*) AS series, 100.0::DOUBLE * count(*) FILTER (WHERE n = 1) / count(*) AS never_changed_pct, median(n) AS median_prices FROM m GROUP BY 1")
def movement(spark, sf_dir):
    return audit.movement(panel(spark, sf_dir), K, ["vendor"])


@query("an46_histogram", f"{W}, h AS (SELECT vendor, CASE WHEN px < 2 THEN 'one' WHEN px < 5 THEN 'few' ELSE 'many' END AS bucket, count(*) AS n FROM obs GROUP BY 1, 2) SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY vendor) AS share_pct FROM h")
def histogram(spark, sf_dir):
    return stats.histogram(panel(spark, sf_dir), "px", [2, 5], ["one", "few", "many"], ["vendor"])


@query("an16_implied_packs", "WITH s AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_linenumber % 5 AS DOUBLE) END AS implied, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE l_linenumber % 4 + 1 END AS DOUBLE) AS parsed FROM lineitem), l AS (SELECT CASE WHEN implied IS NULL THEN 'not comparable' WHEN abs(implied - parsed) <= 0.05 * parsed THEN 'agree' WHEN parsed = 1 AND implied > 1.5 THEN 'pack missed' WHEN parsed > 1 AND abs(implied - 1) <= 0.05 THEN 'pack invented' ELSE 'disagree' END AS diagnosis FROM s) SELECT diagnosis, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct FROM l GROUP BY 1")
def implied(spark, sf_dir):
    k = F.col("l_linenumber")
    return audit.implied_packs(_t(spark, sf_dir, "lineitem"), F.when(k % 5 != 0, (k % 5).cast("double")), F.when(F.col("l_quantity") > 25, 1).otherwise(k % 4 + 1).cast("double"))


# ---- sales

_SALES = f"""{W}, e AS (SELECT gtin, vendor, min(d) AS start_d, max(d) AS end_d, count(*) AS run_days, min(px) AS sale_px FROM (SELECT *, row_number() OVER (PARTITION BY gtin, vendor ORDER BY d) - row_number() OVER (PARTITION BY gtin, vendor, on_sale ORDER BY d) AS g FROM obs) WHERE on_sale = 1 GROUP BY gtin, vendor, g),
b AS (SELECT e.*, o.d, o.px FROM e LEFT JOIN obs o ON o.gtin = e.gtin AND o.vendor = e.vendor AND o.d BETWEEN e.start_d - 14 AND e.start_d - 1)"""


@query("an17_sale_events", f"{_SALES} SELECT gtin, vendor, start_d, end_d, run_days, sale_px FROM e")
def sale_events(spark, sf_dir):
    return timeline.sale_events(panel(spark, sf_dir), K)


@query("an18_evaluable", f"{_SALES} SELECT gtin, vendor, start_d, end_d, run_days, sale_px, count(d) AS prior_days FROM b GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(d) >= 4")
def evaluable(spark, sf_dir):
    days = panel(spark, sf_dir)
    return timeline.evaluable_events(timeline.sale_events(days, K), days, K, least=4)


_PRESALE = f"""{_SALES}, s AS (SELECT gtin, vendor, start_d, count(*) AS prior_days, median(px) AS median_px, arg_max(px, d) AS last_px, min(px) AS low_px, max(px) AS high_px, count(DISTINCT px) AS distinct_px FROM b WHERE d IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT gtin, vendor, start_d, px AS modal_px FROM (SELECT gtin, vendor, start_d, px, row_number() OVER (PARTITION BY gtin, vendor, start_d ORDER BY count(*) DESC, px) AS r FROM b WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE r = 1)"""


@query("an19_presale_statistics", f"{_PRESALE} SELECT s.gtin, s.vendor, s.start_d, prior_days, modal_px, median_px, last_px, low_px, high_px, distinct_px FROM s JOIN m ON m.gtin = s.gtin AND m.vendor = s.vendor AND m.start_d = s.start_d")
def presale(spark, sf_dir):
    days = panel(spark, sf_dir)
    return timeline.lookback_statistics(timeline.sale_events(days, K), days, K).drop("end_d", "run_days", "sale_px")


@query("an19_presale_claims", f"{_PRESALE} SELECT s.vendor, count(*) AS events, 100.0::DOUBLE * count(*) FILTER (WHERE 3.0 > modal_px * 1.02::DOUBLE) / count(*) AS modal_px_pct, 100.0::DOUBLE * count(*) FILTER (WHERE 3.0 > median_px * 1.02::DOUBLE) / count(*) AS median_px_pct, 100.0::DOUBLE * count(*) FILTER (WHERE 3.0 > high_px * 1.02::DOUBLE) / count(*) AS high_px_pct FROM s JOIN m ON m.gtin = s.gtin AND m.vendor = s.vendor AND m.start_d = s.start_d GROUP BY 1")
def presale_claims(spark, sf_dir):
    return audit.claims(presale(spark, sf_dir).withColumn("claim", F.lit(3.0)), "claim", ["vendor"], ["modal_px", "median_px", "high_px"], 1.02)


@query("an20_sale_frequency", f"{W}, f AS (SELECT gtin, vendor, count(*) AS n, sum(on_sale) AS s FROM obs GROUP BY 1, 2 HAVING count(*) >= 5) SELECT vendor, count(*) AS products, median(100.0::DOUBLE * s / n) AS median_pct, 100.0::DOUBLE * count(*) FILTER (WHERE 100.0::DOUBLE * s / n >= 25) / count(*) AS at_least_25_pct, 100.0::DOUBLE * count(*) FILTER (WHERE 100.0::DOUBLE * s / n >= 50) / count(*) AS at_least_50_pct, count(*) FILTER (WHERE s = n) AS always_on FROM f GROUP BY 1")
def sale_frequency(spark, sf_dir):
    return audit.sale_frequency(panel(spark, sf_dir), K, ["vendor"], least_days=5, marks=(25, 50))


@query("an21_flag_table", "WITH f AS (SELECT event_type, value < 10 AS a, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 = 0 AS b FROM events) SELECT event_type, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, 100.0::DOUBLE * count(*) FILTER (WHERE a = b) / count(*) AS agree_pct FROM f GROUP BY 1")
def flags(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("a", F.col("value") < 10).withColumn("b", F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3 == 0)
    return audit.flag_table(e, "a", "b", ["event_type"])


_FREEZE = [("early", date(2024, 1, 1), date(2024, 1, 8)), ("late", date(2024, 1, 20), date(2024, 1, 30))]


@query("an23_frozen_windows", f"{W}, w(win, a, z) AS (VALUES ('early', DATE '2024-01-01', DATE '2024-01-08'), ('late', DATE '2024-01-20', DATE '2024-01-30')), s AS (SELECT win, z - a + 1 AS len, gtin, vendor, count(*) AS n, max(px) - min(px) AS s FROM obs JOIN w ON d BETWEEN a AND z GROUP BY 1, 2, 3, 4) SELECT win AS \"window\", count(*) AS series, count(*) FILTER (WHERE n >= 0.25 * len) AS covered, count(*) FILTER (WHERE n = len) AS gapless, count(*) FILTER (WHERE n >= 0.25 * len AND s <= 0.005) AS flat FROM s GROUP BY 1")
def frozen(spark, sf_dir):
    return audit.frozen_coverage(panel(spark, sf_dir), K, _FREEZE, share=0.25)


@query("an24_relisted_sizes", "WITH e AS (SELECT p_name, p_type, p_size, min(p_partkey) AS f, max(p_partkey) AS l FROM part GROUP BY 1, 2, 3) SELECT a.p_name, a.p_type, a.p_size AS size_a, b.p_size AS size_b, a.l >= b.f AS concurrent FROM e a JOIN e b ON a.p_name = b.p_name AND a.p_type = b.p_type AND (a.f < b.f OR a.f = b.f AND a.p_size < b.p_size)")
def relisted(spark, sf_dir):
    return audit.relisted_sizes(_t(spark, sf_dir, "part"), ["p_name", "p_type"], "p_size", "p_partkey", "p_partkey")


# ---- comparisons

_PAIRS = f"{W}, p AS (SELECT x.gtin, x.d, x.vendor AS a, y.vendor AS b, x.px AS px_a, y.px AS px_b, x.px / y.px AS ratio FROM obs x JOIN obs y ON x.gtin = y.gtin AND x.d = y.d AND y.vendor > x.vendor WHERE x.px > 0 AND y.px > 0)"


def _pairs(spark, sf_dir):
    return compare.pairs(panel(spark, sf_dir))


@query("an25_pairs", f"{_PAIRS} SELECT gtin, d, a, b, px_a, px_b, ratio FROM p")
def pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("an25_pair_summary", f"{_PAIRS} SELECT a, b, count(*) AS n, median(ratio) AS median_ratio, round(exp(avg(ln(ratio))), 6) AS geo_ratio, 100.0::DOUBLE * count(*) FILTER (WHERE ratio < 0.99) / count(*) AS cheaper_pct, 100.0::DOUBLE * count(*) FILTER (WHERE ratio BETWEEN 0.99 AND 1.01) / count(*) AS tie_pct, 100.0::DOUBLE * count(*) FILTER (WHERE ratio > 1.01) / count(*) AS dearer_pct FROM p GROUP BY 1, 2")
def pair_summary(spark, sf_dir):
    return rounded(compare.pair_summary(_pairs(spark, sf_dir)), "geo_ratio")


@query("an25_daily_medians", f"{_PAIRS}, m AS (SELECT a, b, d, median(ratio) AS m FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT a, b, count(*) AS days, min(m) AS low, median(m) AS middle, max(m) AS high FROM m GROUP BY 1, 2")
def daily_medians(spark, sf_dir):
    return compare.daily_medians(_pairs(spark, sf_dir), least=5)


@query("an25_category_flips", f"{_PAIRS}, c AS (SELECT *, gtin % 3 AS category FROM p), w AS (SELECT a, b, median(ratio) AS m FROM p GROUP BY 1, 2) SELECT c.a, c.b, category, count(*) AS n, median(ratio) AS median_ratio, (median(ratio) - 1) * (any_value(w.m) - 1) < 0 AS flips FROM c JOIN w ON w.a = c.a AND w.b = c.b GROUP BY 1, 2, 3 HAVING count(*) >= 20")
def category_flips(spark, sf_dir):
    return compare.category_flips(_pairs(spark, sf_dir).withColumn("category", F.col("gtin") % 3), "category", least=20)


@query("an25_consistency", f"{_PAIRS}, e AS (SELECT a, b, gtin, max(ratio) AS hi, min(ratio) AS lo FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT a, b, count(*) AS products, count(*) FILTER (WHERE hi < 1) AS always_cheaper, count(*) FILTER (WHERE lo > 1) AS always_dearer, count(*) FILTER (WHERE NOT hi < 1 AND NOT lo > 1) AS mixed FROM e GROUP BY 1, 2")
def consistency(spark, sf_dir):
    return compare.consistency(_pairs(spark, sf_dir), least=2)


@query("an25_tertiles", f"{_PAIRS}, t AS (SELECT gtin, ntile(3) OVER (ORDER BY count(*), gtin) AS tertile FROM p GROUP BY 1) SELECT tertile, a, b, count(*) AS n, median(ratio) AS median_ratio FROM p JOIN t ON t.gtin = p.gtin GROUP BY 1, 2, 3")
def tertiles(spark, sf_dir):
    return compare.tertile_ratios(_pairs(spark, sf_dir))


@query("an25_transitivity", f"{W}, c AS (SELECT gtin, d, max(px) FILTER (WHERE vendor = 'click') AS x, max(px) FILTER (WHERE vendor = 'error') AS y, max(px) FILTER (WHERE vendor = 'view') AS z FROM obs GROUP BY 1, 2), k AS (SELECT * FROM c WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) SELECT count(*) AS n, round(exp(avg(ln(x / z))), 6) AS direct, round(exp(avg(ln(x / y))) * exp(avg(ln(y / z))), 6) AS chained FROM k")
def transitivity(spark, sf_dir):
    return rounded(compare.transitivity(panel(spark, sf_dir), ["click", "error", "view"]).drop("error"), "direct", "chained")


@query("an26_blind_spot", f"{W} SELECT vendor, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE px <= 2) / count(*) AS flagged_pct, 100.0::DOUBLE * sum(px) FILTER (WHERE px <= 2) / nullif(sum(px), 0) AS exposure_pct FROM obs GROUP BY 1")
def blind_spot(spark, sf_dir):
    return compare.blind_spot(panel(spark, sf_dir).withColumn("cheap", F.col("px") <= 2), ["vendor"], "cheap")


@query("an26_concentration", "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM n) SELECT t AS top, count(*) AS names, CAST(sum(n) AS BIGINT) AS rows, 100.0::DOUBLE * sum(n) / (SELECT count(*) FROM part) AS share_pct FROM r, unnest([3, 10]) AS u(t) WHERE r <= t GROUP BY 1")
def concentration(spark, sf_dir):
    return compare.concentration(_t(spark, sf_dir, "part"), "p_brand", (3, 10))


# ---- exclusions

_LEDGER = "x AS (SELECT l_returnflag, l_linestatus = 'F' AS flag, p_partkey IS NULL AS orphan, l_linenumber % 4 = 1 AS unparsed, l_quantity < 10 AS ambiguous FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey), c AS (SELECT *, CASE WHEN orphan THEN 'orphan' WHEN unparsed THEN 'unparsed' WHEN ambiguous THEN 'ambiguous' ELSE 'retained' END AS exclusion FROM x)"


def classed(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    r = _t(spark, sf_dir, "lineitem").join(sized(parts), "l_partkey", "left")
    return r.withColumn("flag", F.col("l_linestatus") == "F").withColumn("exclusion", audit.exclusion_class(F.col("known").isNull(), F.col("l_linenumber") % 4 == 1, F.col("l_quantity") < 10))


@query("an27_ledger", f"WITH {_LEDGER} SELECT l_returnflag, exclusion, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share_pct FROM c GROUP BY 1, 2")
def ledger(spark, sf_dir):
    return audit.ledger(classed(spark, sf_dir), ["l_returnflag"])


@query("an28_enrichment", f"WITH {_LEDGER}, e AS (SELECT l_returnflag, count(*) FILTER (WHERE exclusion <> 'retained') AS n_excluded, count(*) FILTER (WHERE exclusion = 'retained') AS n_retained, 100.0::DOUBLE * count(*) FILTER (WHERE exclusion <> 'retained' AND flag) / count(*) FILTER (WHERE exclusion <> 'retained') AS excluded_pct, 100.0::DOUBLE * count(*) FILTER (WHERE exclusion = 'retained' AND flag) / count(*) FILTER (WHERE exclusion = 'retained') AS retained_pct FROM c GROUP BY 1) SELECT *, excluded_pct / retained_pct AS ratio FROM e")
def enrichment(spark, sf_dir):
    return audit.enrichment(classed(spark, sf_dir).withColumn("out", F.col("exclusion") != "retained"), ["l_returnflag"], "out", "flag")


@query("an29_filter_audit", "WITH f AS (SELECT l_quantity > 20 AS a, l_discount < 0.05 AS b FROM lineitem), w AS (SELECT count(*) AS t, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE a AND b) AS ab, count(*) FILTER (WHERE a OR b) AS e FROM f) SELECT 'all' AS population, t AS n FROM w UNION ALL SELECT 'a', a FROM w UNION ALL SELECT 'b', b FROM w UNION ALL SELECT 'both', ab FROM w UNION ALL SELECT 'either', e FROM w UNION ALL SELECT 'check', a + b - ab - e FROM w")
def filter_audit(spark, sf_dir):
    return audit.filter_audit(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 20, F.col("l_discount") < 0.05)


@query("an43_orphans", "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE p_partkey IS NULL) AS orphans, 100.0::DOUBLE * count(*) FILTER (WHERE p_partkey IS NULL) / count(*) AS orphan_pct, min(CAST(l_shipdate AS DATE)) FILTER (WHERE p_partkey IS NULL) AS first_day, max(CAST(l_shipdate AS DATE)) FILTER (WHERE p_partkey IS NULL) AS last_day FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL') ON p_partkey = l_partkey GROUP BY 1")
def orphans(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey")).withColumn("day", F.col("l_shipdate").cast("date"))
    return audit.orphan_profile(rows, _t(spark, sf_dir, "part").where("p_type <> 'SMALL'").withColumnRenamed("p_partkey", "k"), "k", ["l_returnflag"], "day")


# ---- changes, spells, staleness

_STEPS = f"{W}, s AS (SELECT *, lag(px) OVER w AS prev_px, lag(d) OVER w AS prev_d FROM obs WINDOW w AS (PARTITION BY gtin, vendor ORDER BY d)), st AS (SELECT *, d - prev_d AS gap_days, abs(px - prev_px) > 0.005 AS changed FROM s)"


@query("an30_steps", f"{_STEPS} SELECT gtin, vendor, d, px, on_sale, prev_px, prev_d, gap_days, changed FROM st")
def steps(spark, sf_dir):
    return timeline.steps(panel(spark, sf_dir), K)


_WEEK = f"{_STEPS}, w AS (SELECT vendor, dayofweek(d) AS weekday, count(*) AS changes FROM st WHERE changed AND gap_days = 1 GROUP BY 1, 2), ws AS (SELECT *, 100.0::DOUBLE * changes / sum(changes) OVER (PARTITION BY vendor) AS share_pct FROM w)"


@query("an31_weekday_changes", f"{_WEEK} SELECT vendor, weekday, changes, share_pct FROM ws")
def weekday_changes(spark, sf_dir):
    return timeline.weekday_changes(panel(spark, sf_dir), K, ["vendor"])


@query("an31_weekday_concentration", f"{_WEEK} SELECT vendor, arg_max(weekday, (changes, -weekday)) AS busiest, max(share_pct) - 100.0::DOUBLE / 7 AS excess_pct FROM ws GROUP BY 1")
def weekday_concentration(spark, sf_dir):
    return timeline.weekday_concentration(weekday_changes(spark, sf_dir), ["vendor"])


_SPELLS = f"{W}, m AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL OR abs(px - lag(px) OVER w) > 0.005 OR d - lag(d) OVER w > 3 OR on_sale <> lag(on_sale) OVER w THEN 1 ELSE 0 END AS n FROM obs WINDOW w AS (PARTITION BY gtin, vendor ORDER BY d)), g AS (SELECT *, sum(n) OVER (PARTITION BY gtin, vendor ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM m), sp AS (SELECT gtin, vendor, min(d) AS from_date, max(d) AS to_date, min(px) AS px, count(*) AS observed_days, max(on_sale) AS on_sale FROM g GROUP BY gtin, vendor, s)"


@query("an32_spells", f"{_SPELLS} SELECT *, to_date - from_date + 1 AS calendar_days FROM sp")
def spells(spark, sf_dir):
    return timeline.spells(panel(spark, sf_dir), K)


@query("an32_spells_streamed", f"{_SPELLS} SELECT *, to_date - from_date + 1 AS calendar_days FROM sp")
def streamed_spells(spark, sf_dir):
    """The same by a stream: the events as they are, in files whose rows are in no order, and one far later row, which
    closes what is open. It is not among the result."""
    folder, kinds = scratch(spark, "stream"), "gtin long, vendor string, d date, px double, on_sale int"
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("gtin"), F.col("event_type").alias("vendor"), F.col("ts").cast("date").alias("d"), (F.floor(F.col("value") / 20) + 1).cast("double").alias("px"), (F.col("value") < 10).cast("int").alias("on_sale"))
    rows.repartition(3, F.xxhash64("gtin", "d", "px")).write.parquet(f"{folder}/in/0")
    spark.sql("SELECT -1L AS gtin, 'end' AS vendor, DATE '2100-01-01' AS d, 1D AS px, 0 AS on_sale").write.parquet(f"{folder}/in/1")
    old = spark.conf.get(stream.PROVIDER[0], None)
    stream.with_state(spark)
    try:
        read = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        stream.write(stream.spells(read, K, "3650 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.unset(stream.PROVIDER[0]) if old is None else spark.conf.set(stream.PROVIDER[0], old)
    return spark.read.parquet(f"{folder}/out").where("gtin >= 0").select(*K, "from_date", "to_date", "px", "observed_days", "on_sale", "calendar_days")


@query("an32_spell_lengths", f"{_SPELLS} SELECT vendor, on_sale, count(*) AS spells, median(observed_days) AS median_observed, median(to_date - from_date + 1) AS median_calendar FROM sp GROUP BY 1, 2")
def spell_lengths(spark, sf_dir):
    return spells(spark, sf_dir).groupBy("vendor", "on_sale").agg(N().alias("spells"), F.median("observed_days").alias("median_observed"), F.median("calendar_days").alias("median_calendar"))


_AHEAD = f"{W}, a AS (SELECT o.gtin, o.vendor, o.d, o.px, k, l.px AS later_px FROM obs o CROSS JOIN unnest([1, 2, 3, 7, 14]) AS u(k) LEFT JOIN obs l ON l.gtin = o.gtin AND l.vendor = o.vendor AND l.d = o.d + k)"


@query("an33_staleness", f"{_AHEAD} SELECT vendor, k, count(later_px) AS pairs, count(*) FILTER (WHERE later_px IS NULL) AS unobserved, 100.0::DOUBLE * count(*) FILTER (WHERE abs(later_px - px) > 0.005) / nullif(count(later_px), 0) AS pct_wrong FROM a GROUP BY 1, 2")
def staleness(spark, sf_dir):
    return timeline.staleness(panel(spark, sf_dir), K, ["vendor"])


@query("an33_staleness_on_basket", f"{_AHEAD}, c AS (SELECT gtin FROM (SELECT gtin, d FROM obs GROUP BY 1, 2 HAVING count(DISTINCT vendor) >= 2) GROUP BY 1 HAVING count(*) >= 10) SELECT vendor, k, count(later_px) AS pairs, count(*) FILTER (WHERE later_px IS NULL) AS unobserved, 100.0::DOUBLE * count(*) FILTER (WHERE abs(later_px - px) > 0.005) / nullif(count(later_px), 0) AS pct_wrong FROM a WHERE gtin IN (SELECT gtin FROM c) GROUP BY 1, 2")
def staleness_on_basket(spark, sf_dir):
    days = panel(spark, sf_dir)
    return timeline.staleness(days.join(compare.basket(days, least_days=10), "gtin", "left_semi"), K, ["vendor"])


_DAYS = ", ".join(f"avg(CASE WHEN abs(l.px - o.px) > 0.005 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE l.d = o.d + {k}) AS day_{k}" for k in range(1, 8))
_ALL = ", ".join(f"day_{k}" for k in range(1, 8))


@query("an34_refresh_matrix", f"{W}, m AS (SELECT o.vendor, dayofweek(o.d) AS weekday, {_DAYS} FROM obs o JOIN obs l ON l.gtin = o.gtin AND l.vendor = o.vendor AND l.d BETWEEN o.d + 1 AND o.d + 7 GROUP BY 1, 2) SELECT vendor, weekday, {', '.join(f'round(day_{k}, 6) AS day_{k}' for k in range(1, 8))}, round(greatest({_ALL}), 6) AS worst, round(list_avg([{_ALL}]), 6) AS mean FROM m")
def refresh_matrix(spark, sf_dir):
    return rounded(timeline.refresh_matrix(panel(spark, sf_dir), K, ["vendor"]), *[f"day_{k}" for k in range(1, 8)], "worst", "mean")


@query("an35_magnitude", f"{_STEPS}, r AS (SELECT gtin, vendor, d, prev_d, px / prev_px AS ratio FROM st WHERE gap_days <= 3 AND prev_px > 0) SELECT gtin, vendor, d, prev_d, ratio, CASE WHEN ratio BETWEEN 1.9 AND 2.1 THEN 'x2' ELSE '/2' END AS band FROM r WHERE ratio BETWEEN 1.9 AND 2.1 OR ratio BETWEEN 0.45 AND 0.55")
def magnitude(spark, sf_dir):
    return timeline.magnitude_jumps(panel(spark, sf_dir), K, {"x2": (1.9, 2.1), "/2": (0.45, 0.55)}).select("gtin", "vendor", "d", "prev_d", "ratio", "band")


@query("an36_adjudication", f"{W}, e AS (SELECT gtin, vendor, d, px AS bare FROM obs WHERE px >= 8), n AS (SELECT gtin, vendor, d, px FROM obs WHERE px < 8), r AS (SELECT e.*, n.d AS near_d, n.px AS near_px, row_number() OVER (PARTITION BY e.gtin, e.vendor, e.d ORDER BY abs(n.d - e.d), n.d, n.px) AS r FROM e JOIN n ON n.gtin = e.gtin AND n.vendor = e.vendor AND n.d BETWEEN e.d - 7 AND e.d + 7) SELECT gtin, vendor, d, bare, near_d, near_px, CASE WHEN abs(bare - near_px) <= 0.15 * near_px THEN 'dollars' WHEN abs(bare / 4 - near_px) <= 0.15 * near_px THEN 'cents' ELSE 'neither' END AS reading FROM r WHERE r = 1")
def adjudication(spark, sf_dir):
    days = panel(spark, sf_dir).drop("on_sale")
    events = days.where("px >= 8").withColumnRenamed("px", "bare")
    out = timeline.nearest(events, days.where("px < 8"), K, 7, ["gtin", "vendor", "d"])
    near = lambda x: F.abs(x - F.col("near_px")) <= 0.15 * F.col("near_px")
    return out.withColumn("reading", F.when(near(F.col("bare")), "dollars").when(near(F.col("bare") / 4), "cents").otherwise("neither"))


@query("an37_gap_moves", f"{_STEPS}, m AS (SELECT vendor, gap_days > 5 AS after_gap, 100.0::DOUBLE * abs(px - prev_px) / nullif(prev_px, 0) AS mv FROM st WHERE prev_px IS NOT NULL) SELECT vendor, after_gap, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE mv > 50) / count(*) AS over_50_pct, 100.0::DOUBLE * count(*) FILTER (WHERE mv > 200) / count(*) AS over_200_pct FROM m GROUP BY 1, 2")
def gap_moves(spark, sf_dir):
    return audit.gap_moves(steps(spark, sf_dir), ["vendor"], long_gap=5)


# ---- two snapshots

_SNAPS = "s1 AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 0), s2 AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 1 END + CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN o_orderkey % 50 = 1 THEN '' WHEN o_orderkey % 50 = 2 THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 11 <> 0)"


def snapshots(spark, sf_dir):
    k, o = F.col("o_orderkey"), _t(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    day = F.col("o_orderdate").cast("date").alias("d")
    a = o.where(k % 10 != 0).select(k.alias("k"), day, cents.alias("c"), F.col("o_orderpriority").alias("p"))
    b = o.where(k % 11 != 0).select(k.alias("k"), day, (cents * F.when(k % 97 == 0, 100).otherwise(1) + F.when(k % 89 == 0, 1).otherwise(0)).cast("long").alias("c"), F.when(k % 50 == 1, "").when(k % 50 == 2, "x").otherwise(F.col("o_orderpriority")).alias("p"))
    return a, b


@query("an38_fingerprint_diff", f"WITH {_SNAPS}, f1 AS (SELECT d, count(*) AS n, sum(k * 31 + c) AS h FROM s1 GROUP BY 1), f2 AS (SELECT d, count(*) AS n, sum(k * 31 + c) AS h FROM s2 GROUP BY 1) SELECT d, f1.n AS rows_a, f2.n AS rows_b, CASE WHEN f2.n IS NULL THEN 'only first' WHEN f1.n IS NULL THEN 'only second' WHEN f1.n <> f2.n THEN 'count changed' WHEN f1.h = f2.h THEN 'identical' ELSE 'content changed' END AS verdict FROM f1 FULL JOIN f2 USING (d)")
def fingerprint_diff(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    # the library's own checksum, xxhash64 summed as decimals: verdicts, not values, are compared
    return audit.fingerprint_diff(audit.fingerprints(a, ["d"], ["k", "c"]), audit.fingerprints(b, ["d"], ["k", "c"]), ["d"])


_MOVES = "e AS (SELECT user_id AS gtin, event_type AS vendor, CAST(ts AS DATE) AS d, floor(value / 20) + 1 + CASE WHEN day(CAST(ts AS DATE)) % 10 = 3 THEN 1 ELSE 0 END AS px FROM events WHERE day(CAST(ts AS DATE)) <> 7)"


@query("io20_incremental_build", f"""WITH {_MOVES}, t AS (SELECT d, count(*) AS series, sum(px) AS px FROM (SELECT gtin, vendor, d, min(px) AS px FROM e GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT coalesce(t.d, a.d) AS d, series, px, CASE WHEN t.d IS NULL THEN 'only first' WHEN day(t.d) = 20 THEN 'only second' WHEN day(t.d) % 10 = 3 THEN 'content changed' ELSE 'identical' END AS verdict
    FROM t FULL JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) a ON a.d = t.d""")
def incremental_build(spark, sf_dir):
    """The panel built of the events without one day of the month, and brought up to the events as they then are: three days
    of a month at other prices, one gone, one come. What it is by day, and which days moved."""
    path, day = scratch(spark, "incremental"), F.dayofmonth("d")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("gtin"), F.col("event_type").alias("vendor"), F.col("ts").cast("date").alias("d"), (F.floor(F.col("value") / 20) + 1).cast("double").alias("price"), (F.col("value") < 10).alias("sale"))
    build = lambda rows: timeline.daily(rows, K, "d", "price", "sale")
    refresh.rebuild(e.where(day != 20), path, "d", build, columns=["gtin", "vendor", "d", "price", "sale"])
    later = e.where(day != 7).withColumn("price", F.col("price") + F.when(day % 10 == 3, 1).otherwise(0))
    moved = refresh.rebuild(later, path, "d", build, columns=["gtin", "vendor", "d", "price", "sale"]).select("d", "verdict")
    by = refresh.table(spark, path).groupBy("d").agg(N().alias("series"), F.sum("px").alias("px"))
    return by.join(moved, "d", "full").select("d", "series", "px", F.coalesce("verdict", F.lit("identical")).alias("verdict"))


@query("an39_multiset_diff", f"WITH {_SNAPS}, u AS (SELECT d, p, count(*) AS n, 1 AS s FROM s1 GROUP BY 1, 2 UNION ALL SELECT d, p, count(*), 2 FROM s2 GROUP BY 1, 2), x AS (SELECT d, p, CAST(coalesce(sum(n) FILTER (WHERE s = 2), 0) - coalesce(sum(n) FILTER (WHERE s = 1), 0) AS BIGINT) AS delta FROM u GROUP BY 1, 2) SELECT d, p, greatest(delta, 0) AS gained, greatest(-delta, 0) AS lost FROM x WHERE delta <> 0")
def multiset_diff(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return audit.multiset_diff(a, b, ["d", "p"])


@query("an40_drift", f"WITH {_SNAPS}, j AS (SELECT s1.c AS c1, s2.c AS c2, s1.p AS p1, s2.p AS p2 FROM s1 JOIN s2 ON s1.k = s2.k) SELECT 'c' AS \"column\", count(*) AS common, count(*) FILTER (WHERE c1 <> c2) AS changed, 0 AS filled, 0 AS emptied FROM j UNION ALL SELECT 'p', count(*), count(*) FILTER (WHERE p1 <> '' AND p2 <> '' AND p1 <> p2), count(*) FILTER (WHERE p1 = '' AND p2 <> ''), count(*) FILTER (WHERE p1 <> '' AND p2 = '') FROM j")
def drift(spark, sf_dir):
    return audit.drift(*snapshots(spark, sf_dir), "k", ["c", "p"])


@query("an41_recovery", f"WITH {_SNAPS}, j AS (SELECT s1.c AS c1, s2.c AS c2 FROM s1 JOIN s2 ON s1.k = s2.k) SELECT count(*) AS rows, count(*) FILTER (WHERE c1 <> c2) AS corrupted, 100.0::DOUBLE * count(*) FILTER (WHERE c1 <> c2 AND abs(c2 / 100.0::DOUBLE - c1) <= 0.005) / nullif(count(*) FILTER (WHERE c1 <> c2), 0) AS recovered_pct FROM j")
def recovery(spark, sf_dir):
    return audit.recovery(*snapshots(spark, sf_dir), ["k"], "c")


@query("an42_collisions", "SELECT count(DISTINCT s) AS sources, count(DISTINCT k) AS keys, count(DISTINCT s) - count(DISTINCT k) AS collisions FROM (SELECT c_name AS s, substr(md5(c_name), 1, 3) AS k FROM customer UNION ALL SELECT s_name, substr(md5(s_name), 1, 3) FROM supplier)")
def collisions(spark, sf_dir):
    a, b = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("n")), _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("n"))
    return audit.collisions([a, b], F.col("n"), F.substring(F.md5(F.col("n").cast("binary")), 1, 3))


@query("rl45_checksum", "SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey * 31 + CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS checksum FROM orders GROUP BY 1")
def checksum(spark, sf_dir):
    return audit.fingerprints(_t(spark, sf_dir, "orders"), ["o_orderstatus"], [], F.col("o_orderkey") * 31 + F.round(F.col("o_totalprice") * 100).cast("long"))


@query("an50_histories", f"{_SPELLS}, x AS (SELECT gtin, vendor, CAST(unnest(generate_series(from_date, to_date, INTERVAL 1 DAY)) AS DATE) AS d, px FROM sp), a AS (SELECT * FROM x WHERE gtin % 7 <> 0), b AS (SELECT gtin, vendor, d, px + CASE WHEN gtin % 5 = 0 THEN 1 ELSE 0 END AS px FROM x WHERE gtin % 6 <> 0) SELECT count(*) FILTER (WHERE abs(a.px - b.px) <= 0.005) AS agree, count(*) FILTER (WHERE abs(a.px - b.px) > 0.005) AS differ, count(*) FILTER (WHERE b.px IS NULL) AS only_a, count(*) FILTER (WHERE a.px IS NULL) AS only_b FROM a FULL JOIN b ON a.gtin = b.gtin AND a.vendor = b.vendor AND a.d = b.d")
def histories(spark, sf_dir):
    s = spells(spark, sf_dir)
    other = s.where("gtin % 6 <> 0").withColumn("px", F.col("px") + F.when(F.col("gtin") % 5 == 0, 1).otherwise(0))
    return timeline.compare_histories(s.where("gtin % 7 <> 0"), other, K)


# ---- publication

_EXTRACT = date(2024, 1, 30)
_OFFERS = f"""{_AHEAD}, stale AS (SELECT vendor, k, 100.0::DOUBLE * count(*) FILTER (WHERE abs(later_px - px) > 0.005) / nullif(count(later_px), 0) AS pct_wrong FROM a GROUP BY 1, 2),
bo AS (SELECT gtin, vendor, CASE WHEN px >= 5 THEN 'per_100g' ELSE 'each' END AS basis, d, px, on_sale FROM obs), l AS (SELECT gtin, vendor, basis, arg_max(px, d) AS px, arg_max(on_sale, d) AS on_sale, max(d) AS observed_date FROM bo GROUP BY 1, 2, 3),
o AS (SELECT gtin, vendor, arg_max(basis, (observed_date, basis)) AS basis, arg_max(px, (observed_date, basis)) AS px, arg_max(on_sale, (observed_date, basis)) AS on_sale, max(observed_date) AS observed_date FROM l GROUP BY 1, 2),
mb AS (SELECT gtin, arg_max(basis, (n, basis)) AS product_basis FROM (SELECT gtin, basis, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT o.*, DATE '2024-01-30' - observed_date AS days_behind, product_basis FROM o JOIN mb ON mb.gtin = o.gtin),
ff AS (SELECT *, days_behind <= 7 AS is_recent, days_behind <= 7 AND basis = product_basis AS comparable, CASE WHEN days_behind > 7 AND basis <> product_basis THEN 'no recent price, and a different price basis' WHEN days_behind > 7 THEN 'no recent price' WHEN basis <> product_basis THEN 'priced on a different basis' END AS not_comparable_reason, CASE WHEN days_behind <= 1 THEN 1 WHEN days_behind <= 2 THEN 2 WHEN days_behind <= 3 THEN 3 WHEN days_behind <= 7 THEN 7 WHEN days_behind <= 14 THEN 14 END AS kk, days_behind > 14 AS staleness_exceeds_measured FROM f)"""


def _based(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("basis", F.when(F.col("px") >= 5, "per_100g").otherwise("each")).withColumn("min_qty", F.lit(1.0))


def offers(spark, sf_dir, load=None):
    days = _based(spark, sf_dir)
    return publication.flagged(publication.chain_offers(days if load is None else load, _EXTRACT), timeline.staleness(days, K, ["vendor"]))


@query("an44_offers", f"{_OFFERS} SELECT gtin, ff.vendor, basis, px, on_sale, observed_date, days_behind, is_recent, comparable, not_comparable_reason, pct_wrong AS staleness_pct, staleness_exceeds_measured FROM ff LEFT JOIN stale ON stale.vendor = ff.vendor AND stale.k = ff.kk")
def offer_rows(spark, sf_dir):
    return offers(spark, sf_dir).drop("product_basis", "min_qty", "staleness_horizon_days")


def documents(spark, sf_dir, look_back=True, load=None):
    o = offers(spark, sf_dir, load)
    names = o.select("gtin").distinct().select("gtin", F.concat(F.lit("product "), F.col("gtin").cast("string")).alias("name"), F.lit("").alias("brand"), F.lit("").alias("size"))
    return publication.products_document(o, publication.sale_context(o, _based(spark, sf_dir)) if look_back else None, names)


@query("an44_verdicts", f"{_OFFERS}, v AS (SELECT gtin, count(*) FILTER (WHERE comparable) AS n, arg_min(vendor, (px, vendor)) FILTER (WHERE comparable) AS cheapest, string_agg(vendor, '|' ORDER BY vendor) FILTER (WHERE comparable) AS compared, count(*) AS offers FROM ff GROUP BY 1) SELECT gtin AS gtin14, n AS n_compared, CASE WHEN n >= 2 THEN cheapest END AS cheapest, coalesce(compared, '') AS compared, offers FROM v")
def verdicts(spark, sf_dir):
    d = documents(spark, sf_dir, look_back=False)  # a verdict doesn't tell the days before
    return d.select("gtin14", F.col("comparison.n_compared").alias("n_compared"), F.col("comparison.cheapest").alias("cheapest"), F.array_join("comparison.compared", "|").alias("compared"), F.size("offers").cast("long").alias("offers"))


_V = ", v AS (SELECT gtin, count(*) FILTER (WHERE comparable) AS n FROM ff GROUP BY 1)"


#: By document: its offers, comparable ones, and which other facts hold.
_DOCS = _OFFERS + """, x AS (SELECT ff.*, pct_wrong AS pct FROM ff LEFT JOIN stale ON stale.vendor = ff.vendor AND stale.k = ff.kk),
v AS (SELECT gtin, gtin % 29 AS r, count(*) AS offers, count(*) FILTER (WHERE comparable) AS n, count(*) FILTER (WHERE NOT staleness_exceeds_measured) AS measured, count(*) FILTER (WHERE NOT staleness_exceeds_measured AND pct IS NULL) AS holes,
             count(*) FILTER (WHERE staleness_exceeds_measured) AS beyond, count(*) FILTER (WHERE vendor = 'view') AS views, count(*) FILTER (WHERE comparable AND vendor = 'view') AS views_in, arg_min(vendor, (px, vendor)) FILTER (WHERE comparable) AS best FROM x GROUP BY 1)"""
_TOLD = {
    "no offer, or one without a price": "r = 1 OR r = 2",
    "the compared chains aren't the comparable offers": "r = 3 OR (r = 1 AND n > 0) OR (r = 14 AND views_in > 0)",
    "the cheapest chain is wrong": "n >= 2 AND (r = 1 OR r = 4) OR (r = 4 AND n < 2) OR (r = 14 AND n >= 2 AND best = 'view')",
    "an offer's reason contradicts it": "r = 5 AND n < offers",
    "staleness beyond what was measured": "r = 6 AND beyond > 0",
    "no staleness within what was measured": "(r = 7 AND measured > 0) OR (holes > 0 AND r NOT IN (1, 6))",
    "a comparable offer on another basis": "r = 8 AND n > 0",
    "a chain is neither compared nor unavailable, or has no offer": "r = 1 OR (r = 9 AND n < offers) OR (r = 14 AND views > 0)",
    "an unavailable chain without a reason": "r = 10 AND n < offers",
    "an unavailable chain without its last day": "r = 11 AND n < offers",
    "no claim": "r = 12",
    "the claim isn't the comparison's": "r IN (3, 13, 15, 16) OR (r = 1 AND n > 0) OR (r = 14 AND views_in > 0)",
    "the claim says and twice": "r = 15",
    "the claim prints a chain's code": "r = 16",
    "a chain without a label": "r = 14 AND views > 0",
    "the brand is a promotion": "r = 17",
    "an offer of a chain outside the extract": "r = 14 AND views > 0",
}


@query("dq11_extract_gate", _DOCS + " UNION ALL ".join([""] + [f"SELECT gtin AS gtin14, '{k.replace(chr(39), chr(39) * 2)}' AS problem FROM v WHERE {w}" for k, w in _TOLD.items()]).replace(" UNION ALL ", " ", 1))
def extract_gate(spark, sf_dir):
    """Every document, most of them broken in one of 17 ways by its barcode: each is found, with what follows from it."""
    d = documents(spark, sf_dir, look_back=False)
    r, c = F.col("gtin14") % 29, F.col("comparison")
    of = lambda k, new, old: F.when(r == k, new).otherwise(old)
    each = lambda f: F.transform("offers", f)
    off = {
        2: lambda o: o.withField("price", F.lit(0.0)), 5: lambda o: o.withField("not_comparable_reason", F.when(o["comparable"], o["not_comparable_reason"]).otherwise("")),
        6: lambda o: o.withField("staleness_pct", F.lit(1.0)), 7: lambda o: o.withField("staleness_pct", F.lit(None).cast("double")),
        8: lambda o: o.withField("basis", F.concat(F.lit("no "), o["basis"])), 14: lambda o: o.withField("chain", F.when(o["chain"] == "view", "SaveOnFoods").otherwise(o["chain"])).withField("chain_label", F.when(o["chain"] == "view", "SaveOnFoods").otherwise(o["chain_label"])),
    }
    made = F.when(r == 1, F.filter("offers", lambda o: F.lit(False)))
    for k, f in off.items():
        made = made.when(r == k, each(f))
    gone = lambda field, kind: F.transform(c["unavailable"], lambda u: u.withField(field, F.lit(None).cast(kind)))
    said = c["claim"]
    claim = F.when(r == 12, "").when(r == 13, F.concat(F.lit("Cheapest: "), said)).when(r == 15, F.concat(said, F.lit(" This and that and more."))).when(r == 16, F.concat(said, F.lit(" SaveOnFoods"))).otherwise(said)
    unavailable = F.when(r == 9, F.filter(c["unavailable"], lambda u: F.lit(False))).when(r == 10, gone("reason", "string")).when(r == 11, gone("last_observed", "date")).otherwise(c["unavailable"])
    cheapest = of(4, F.when(c["n_compared"] >= 2, F.lit(None).cast("string")).otherwise("click"), c["cheapest"])
    c = c.withField("n_compared", of(3, c["n_compared"] + 1, c["n_compared"])).withField("cheapest", cheapest).withField("claim", claim).withField("unavailable", unavailable)
    d = d.withColumns({"comparison": c, "offers": made.otherwise(F.col("offers")), "brand": of(17, F.lit("Now $3.99, you save"), F.col("brand"))})
    if bad := publication.lacking_fields(d):
        raise ValueError(f"documents lack {bad}")
    return publication.product_problems(d, ["click", "view", "error", "purchase", "signup"])


_CURVES = _OFFERS + """, p AS (SELECT *, lag(pct_wrong) OVER (PARTITION BY vendor ORDER BY k) AS before, lead(pct_wrong) OVER (PARTITION BY vendor ORDER BY k) AS after FROM stale WHERE vendor IN (SELECT vendor FROM ff)),
b AS (SELECT vendor, bool_or(coalesce(before > pct_wrong, false)) AS falls, bool_or(coalesce(before < pct_wrong, false)) AS rises, bool_or(pct_wrong IS NULL) AS hole FROM p GROUP BY 1)"""


@query("dq11_chain_gate", _CURVES + """ SELECT 'as it is' AS build, vendor AS chain, 'staleness falls with age' AS problem FROM b WHERE falls UNION ALL SELECT 'as it is', vendor, 'the curve has a hole' FROM b WHERE hole
    UNION ALL SELECT 'reversed', vendor, 'the curve isn''t in order of age' FROM b UNION ALL SELECT 'reversed', vendor, 'staleness falls with age' FROM b WHERE rises UNION ALL SELECT 'reversed', vendor, 'the curve has a hole' FROM b WHERE hole
    UNION ALL SELECT 'emptied', vendor, 'no staleness curve' FROM b UNION ALL SELECT 'emptied', vendor, 'a chain outside the extract' FROM b WHERE vendor <> 'view'""")
def chain_gate(spark, sf_dir):
    """The chains' measured staleness as it is, in reverse order of age, and without a curve while only one chain is let in."""
    curves = publication.chain_curves(offers(spark, sf_dir), timeline.staleness(_based(spark, sf_dir), K, ["vendor"]))
    builds = [
        ("as it is", publication.chain_problems(curves)), ("reversed", publication.chain_problems(curves.withColumn("staleness", F.reverse("staleness")))),
        ("emptied", publication.chain_problems(curves.withColumn("staleness", F.filter("staleness", lambda s: F.lit(False))), ["view"])),
    ]
    out = None
    for build, found in builds:
        found = found.select(F.lit(build).alias("build"), "chain", "problem")
        out = found if out is None else out.unionAll(found)
    return out


@query("dq11_floors", _DOCS + """, s AS (SELECT count(*)::DOUBLE AS n, 100.0::DOUBLE * count(*) FILTER (WHERE n >= 2) / count(*) AS share FROM v)
    SELECT 'products' AS floor, n AS value, 100.0::DOUBLE AS least, n >= 100 AS holds FROM s UNION ALL SELECT 'comparable_pct', round(share, 8), 40.0, share >= 40 FROM s UNION ALL SELECT 'products_shipped', 7, n, n = 7 FROM s UNION ALL SELECT 'vintage_days', 21, 21, true""")
def extract_floors(spark, sf_dir):
    found = publication.floors(documents(spark, sf_dir, look_back=False), 7, _EXTRACT, date(2024, 2, 20), {"products": 100, "comparable_pct": 40.0, "vintage_days": 21})
    return found.withColumn("value", F.round("value", 8))


@query("dq11_statements", "SELECT o_orderpriority AS snapshot_id, unnest(CASE o_orderpriority[1] WHEN '1' THEN [] WHEN '2' THEN ['attribution doesn''t name the source'] WHEN '3' THEN ['scope doesn''t state national brands'] WHEN '4' THEN ['scope doesn''t state no basket'] ELSE ['attribution doesn''t name the source', 'scope doesn''t state national brands', 'scope doesn''t state no basket'] END) AS problem FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def statements(spark, sf_dir):
    """A publication's statements for each order priority, of which some lack a part."""
    k = F.col("snapshot_id")
    meta = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("snapshot_id")).distinct()
    at = k.substr(1, 1)
    meta = meta.withColumn("attribution", F.when(at == "2", "of unknown origin").when(at == "5", F.lit(None).cast("string")).otherwise("Data of the open price archive"))
    scope = F.create_map(F.lit("brands"), F.when(at == "3", "all brands").otherwise("National Brands only"), F.lit("sums"), F.when(at == "4", F.lit(None).cast("string")).otherwise("there is no total"))
    meta = meta.withColumn("scope", F.when(at != "5", scope))
    return publication.statement_problems(meta, "open price archive", [("national brands",), ("no basket", "no total")])


@query("dq11_history_gate", f"{W}, n AS (SELECT DISTINCT gtin, vendor, px >= 5 AS dear FROM obs) SELECT gtin AS gtin14, vendor AS chain, 'spells overlap or lack' AS problem FROM n WHERE gtin % 4 = 0")
def history_gate(spark, sf_dir):
    """Histories of which some lost their spells."""
    h = publication.history_document(_based(spark, sf_dir), _EXTRACT)
    return publication.spell_problems(h.withColumn("spells", F.filter("spells", lambda s: F.col("gtin14") % 4 != 0)))


@query("dq12_extract_parity", f"{_OFFERS}{_V} SELECT CASE WHEN gtin % 13 = 0 THEN 'only a' WHEN gtin % 11 = 0 THEN 'differ' ELSE 'same' END AS status, count(*) AS documents FROM v GROUP BY 1")
def extract_parity(spark, sf_dir):
    """The documents, and those of a load of the published products alone, of which some were lost and some renamed."""
    days = _based(spark, sf_dir)
    light = days.join(publication.chain_offers(days, _EXTRACT).select("gtin").distinct(), "gtin", "left_semi")
    name = F.when(F.col("gtin14") % 11 == 0, "another").otherwise(F.col("name"))
    whole, part = (documents(spark, sf_dir, False, d) for d in (days, light))
    return publication.document_parity(whole, part.where("gtin14 % 13 <> 0").withColumn("name", name))


@query("an45_guarantee", f"{_OFFERS} SELECT gtin, vendor, px FROM ff")
def guarantee(spark, sf_dir):
    tiers = panel(spark, sf_dir).select("vendor").distinct().withColumn("vendor_upc_tier", F.lit("vendor_upc"))
    return publication.guaranteed(offers(spark, sf_dir), ["click", "view", "error", "purchase", "signup"], tiers).select("gtin", "vendor", "px")


@query("an44_history", f"{W}, bo AS (SELECT gtin, vendor, CASE WHEN px >= 5 THEN 'per_100g' ELSE 'each' END AS basis, d, px, on_sale FROM obs), m AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL OR abs(px - lag(px) OVER w) > 0.005 OR d - lag(d) OVER w > 3 OR on_sale <> lag(on_sale) OVER w THEN 1 ELSE 0 END AS n FROM bo WINDOW w AS (PARTITION BY gtin, vendor, basis ORDER BY d)), g AS (SELECT *, sum(n) OVER (PARTITION BY gtin, vendor, basis ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM m), sp AS (SELECT gtin, vendor, basis, min(d) AS f, count(*) AS days FROM g GROUP BY gtin, vendor, basis, s) SELECT gtin AS gtin14, vendor AS chain, basis, count(*) AS spells, min(f) AS first, CAST(sum(days) AS BIGINT) AS days FROM sp GROUP BY 1, 2, 3")
def history(spark, sf_dir):
    h = publication.history_document(_based(spark, sf_dir), _EXTRACT)
    return h.select("gtin14", "chain", "basis", F.size("spells").cast("long").alias("spells"), F.element_at("spells", 1)["from_date"].alias("first"), F.aggregate("spells", F.lit(0).cast("long"), lambda a, s: a + s["observed_days"]).alias("days"))


@query("an48_search", "SELECT p_partkey AS gtin14, p_name AS name FROM part WHERE contains(lower(p_name), 'in') ORDER BY instr(lower(p_name), 'in'), p_size DESC, p_name, p_partkey LIMIT 25")
def search(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gtin14"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("size"), F.struct(F.col("p_size").alias("n_compared")).alias("comparison"))
    return publication.search(p, "IN").select("gtin14", "name")


_TEXTS = ("i", "in", "ing", "ring", "l rin", "ll ring", "small r", "all ring", "mall ring", "small ring", "ALL RING", "absent text", "dget")


@query("an48_search_by_index", " UNION ALL ".join(f"SELECT '{t}' AS wanted, * FROM (SELECT row_number() OVER (ORDER BY instr(lower(p_name), '{t.lower()}'), p_size DESC, p_name, p_partkey) AS nr, p_partkey AS gtin14, p_name AS name FROM part WHERE contains(lower(p_name), '{t.lower()}')) WHERE nr <= 25" for t in _TEXTS))
def search_by_index(spark, sf_dir):
    """Texts of 1 to 11 characters, looked up in an index of all names."""
    path = scratch(spark, "index")
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gtin14"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("size"), F.struct(F.col("p_size").alias("n_compared")).alias("comparison"))
    publication.index(p, path)
    out = None
    for t in _TEXTS:
        rows = [(t, i, r.gtin14, r.name) for i, r in enumerate(publication.search_index(spark, path, t).select("gtin14", "name").collect(), 1)]  # 25 at most
        found = spark.createDataFrame(rows, "wanted string, nr long, gtin14 long, name string")
        out = found if out is None else out.unionAll(found)
    return out


@query("an49_ageing", f"{_OFFERS} SELECT gtin, vendor, DATE '2024-02-04' - observed_date AS days_behind, comparable AND DATE '2024-02-04' - observed_date <= 7 AS comparable FROM ff")
def ageing(spark, sf_dir):
    return publication.aged(offers(spark, sf_dir), date(2024, 2, 4)).select("gtin", "vendor", "days_behind", "comparable")


# ---- contracts


@query("dq01_unique", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique(spark, sf_dir):
    return contracts.unique(_t(spark, sf_dir, "lineitem"), "l_orderkey")


@query("dq01_not_null", "SELECT p_partkey FROM part WHERE nullif(p_size % 7, 0) IS NULL")
def not_null(spark, sf_dir):
    return contracts.not_null(_t(spark, sf_dir, "part").withColumn("z", F.nullif(F.col("p_size") % 7, F.lit(0))), "z").select("p_partkey")


@query("dq01_accepted", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def accepted(spark, sf_dir):
    return contracts.accepted(_t(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@query("dq01_related", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def related(spark, sf_dir):
    return contracts.related(_t(spark, sf_dir, "lineitem"), "l_partkey", _t(spark, sf_dir, "part").where("p_size > 3"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("dq02_date_window", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-01-01' OR CAST(o_orderdate AS DATE) > DATE '2000-12-31'")
def date_window(spark, sf_dir):
    return contracts.dates_within(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d", "20001231T000000Z", date(1996, 1, 1))


@query("dq03_same_count", "SELECT a.n AS rows_in, b.n AS rows_out FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000) b WHERE a.n <> b.n")
def same_count(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return contracts.same_count(o, o.where("o_totalprice > 100000"))


@query("dq03_pinned_nulls", "WITH n AS (SELECT nullif(o_orderkey % 5, 0) AS ok, o_orderkey % 3 AS v FROM orders), f AS (SELECT CAST(v AS BIGINT) AS value, count(*) AS n FROM n WHERE ok IS NULL GROUP BY 1) SELECT coalesce(f.value, w.value) AS value, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM f FULL JOIN (VALUES (0, 7), (8, 2)) w(value, expected) ON w.value = f.value WHERE coalesce(n, 0) <> coalesce(expected, 0)")
def pinned(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("ok"), (F.col("o_orderkey") % 3).alias("v"))
    return contracts.pinned_nulls(o, "v", "ok", {0: 7, 8: 2})
