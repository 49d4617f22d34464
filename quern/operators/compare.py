"""Operators that compare the vendors of one product with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import CO_OBSERVED_DAYS, LEAST_CATEGORY, LEAST_GTIN, LEAST_PAIR_DAY, TIE_BAND
from quern.operators.stats import geometric_mean, quantiles, same, share_pct, tertiles
from quern.sources.shared import cut


def co_observed(days: DataFrame, key: str = "gtin", vendor: str = "vendor", vendors: int = 2) -> DataFrame:
    """(key, d, n_vendors): product-days that at least so many vendors observed."""
    return days.groupBy(key, "d").agg(F.countDistinct(vendor).alias("n_vendors")).where(F.col("n_vendors") >= vendors)


def basket(days: DataFrame, key: str = "gtin", vendor: str = "vendor", least_days: int = CO_OBSERVED_DAYS, vendors: int = 2) -> DataFrame:
    """(key, co_days): products that several vendors observed on at least ``least_days`` common days."""
    return co_observed(days, key, vendor, vendors).groupBy(key).agg(F.count(F.lit(1)).alias("co_days")).where(F.col("co_days") >= least_days)


def pairs(days: DataFrame, key: str = "gtin", vendor: str = "vendor", basis: str | None = None) -> DataFrame:
    """(key, d, a, b, px_a, px_b, ratio): prices of one product and day at two vendors (a < b), on one basis.

    A group is a product and day, of one row a vendor, so that its pairs are at most vendors squared.
    """
    keys = [key, "d", *([basis] if basis else [])]
    left = days.select(*keys, F.col(vendor).alias("a"), F.col("px").alias("px_a"))
    right = days.select(*keys, F.col(vendor).alias("b"), F.col("px").alias("px_b"))
    return left.join(right, keys).where((F.col("b") > F.col("a")) & (F.col("px_a") > 0) & (F.col("px_b") > 0)).withColumn("ratio", F.col("px_a") / F.col("px_b"))


def pair_summary(p: DataFrame, group: Sequence[str] = ("a", "b"), band: tuple[float, float] = TIE_BAND) -> DataFrame:
    """(group, n, median_ratio, geo_ratio, cheaper_pct, tie_pct, dearer_pct) over product-days."""
    pct = lambda c: F.lit(100.0) * F.sum(c.cast("long")) / F.count(F.lit(1))
    r, p = F.col("ratio"), cut(p.select(*group, "ratio"))
    found = p.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), geometric_mean(r).alias("geo_ratio"), pct(r < band[0]).alias("cheaper_pct"), pct(r.between(*band)).alias("tie_pct"), pct(r > band[1]).alias("dearer_pct"),
    )
    return _with_median(found, p, group).select(*group, "n", "median_ratio", "geo_ratio", "cheaper_pct", "tie_pct", "dearer_pct")


def _with_median(found: DataFrame, p: DataFrame, group: Sequence[str], out: str = "median_ratio") -> DataFrame:
    """Adds the exact median ratio of each group, of which a few may hold all rows."""
    return same(found, quantiles(p, group, {out: ("ratio", 0.5)}), group)


def daily_medians(p: DataFrame, least: int = LEAST_PAIR_DAY) -> DataFrame:
    """(a, b, days, low, middle, high): the spread of the daily median ratio, over days with enough products."""
    each = p.groupBy("a", "b", "d").agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("m")).where(F.col("n") >= least)
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("days"), F.min("m").alias("low"), F.median("m").alias("middle"), F.max("m").alias("high"))


def category_flips(p: DataFrame, category: str, least: int = LEAST_CATEGORY) -> DataFrame:
    """(a, b, category, n, median_ratio, flips): categories in which the dearer vendor isn't the pair's dearer one."""
    p = cut(p.select("a", "b", category, "ratio"))
    whole = quantiles(p, ["a", "b"], {"__all": ("ratio", 0.5)})
    each = p.groupBy("a", "b", category).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    each = _with_median(each, p, ["a", "b", category])
    return each.join(whole, ["a", "b"]).withColumn("flips", (F.col("median_ratio") - 1) * (F.col("__all") - 1) < 0).drop("__all")


def consistency(p: DataFrame, key: str = "gtin", least: int = LEAST_GTIN) -> DataFrame:
    """(a, b, products, always_cheaper, always_dearer, mixed): does one product keep its sign over its common days?"""
    each = p.groupBy("a", "b", key).agg(F.count(F.lit(1)).alias("n"), F.max("ratio").alias("hi"), F.min("ratio").alias("lo")).where(F.col("n") >= least)
    n = lambda c: F.sum(c.cast("long"))
    low, high = F.col("hi") < 1, F.col("lo") > 1
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("products"), n(low).alias("always_cheaper"), n(high).alias("always_dearer"), n(~low & ~high).alias("mixed"))


def tertile_ratios(p: DataFrame, key: str = "gtin") -> DataFrame:
    """(tertile, a, b, n, median_ratio): products parted by their number of comparisons (fewest first, ties by key)."""
    size = tertiles(p.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), ["__n", key])
    rows = cut(p.join(size, key).select(F.col("tertile").cast("long").alias("tertile"), "a", "b", "ratio"))
    return _with_median(rows.groupBy("tertile", "a", "b").agg(F.count(F.lit(1)).alias("n")), rows, ["tertile", "a", "b"])


def transitivity(days: DataFrame, vendors: Sequence[str], key: str = "gtin", vendor: str = "vendor") -> DataFrame:
    """(n, direct, chained, error): over product-days that all three vendors observed, the geometric mean ratio of the
    first to the third, and the product of the two steps; the error is their difference."""
    a, b, c = vendors
    px = lambda v: F.max(F.when(F.col(vendor) == v, F.col("px")))
    common = days.where(F.col(vendor).isin(*vendors) & (F.col("px") > 0)).groupBy(key, "d").agg(px(a).alias("x"), px(b).alias("y"), px(c).alias("z")).na.drop()
    out = common.agg(F.count(F.lit(1)).alias("n"), geometric_mean(F.col("x") / F.col("z")).alias("direct"), (geometric_mean(F.col("x") / F.col("y")) * geometric_mean(F.col("y") / F.col("z"))).alias("chained"))
    return out.withColumn("error", F.abs(F.col("direct") - F.col("chained")))


def overlap(products: DataFrame, key: str = "gtin", vendor: str = "vendor", tier: str = "tier") -> DataFrame:
    """(n_vendors, n_loose, products): barcodes by the number of vendors that carry them and of loosely matched ones."""
    each = products.where(F.col(key).isNotNull()).groupBy(key, vendor).agg(F.max(tier).alias("__t"))
    span = each.groupBy(key).agg(F.count(vendor).alias("n_vendors"), F.sum((F.col("__t") == "fuzzy").cast("long")).alias("n_loose"))
    return span.groupBy("n_vendors", "n_loose").agg(F.count(F.lit(1)).alias("products"))


def overlap_pairs(products: DataFrame, key: str = "gtin", vendor: str = "vendor") -> DataFrame:
    """(a, b, products): barcodes that two vendors share."""
    each = products.where(F.col(key).isNotNull()).select(key, vendor).distinct()
    return each.withColumnRenamed(vendor, "a").join(each.withColumnRenamed(vendor, "b"), key).where("b > a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("products"))


def blind_spot(rows: DataFrame, group: Sequence[str], flag: str, price: str = "px") -> DataFrame:
    """(group, n, flagged_pct, exposure_pct): the share of rows that a flag marks, and the share of their prices' sum."""
    n, some = F.count(F.lit(1)), F.col(flag)
    return rows.groupBy(*group).agg(
        n.alias("n"), (F.lit(100.0) * F.sum(some.cast("long")) / n).alias("flagged_pct"),
        (F.lit(100.0) * F.sum(F.when(some, F.col(price))) / F.nullif(F.sum(price), F.lit(0))).alias("exposure_pct"),
    )


def concentration(rows: DataFrame, name: str, tops: Sequence[int] = (10, 50)) -> DataFrame:
    """(top, names, rows, share_pct): what share of all rows the most frequent names hold (ties by name). Aggregated
    before it is ranked; the ranking holds one row a name."""
    n = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0  # total: an aggregate is one row
    most = n.orderBy(F.col("n").desc(), F.col(name).asc()).limit(max(tops))  # total: ordered by count, then name, which is the group key
    ranked = most.withColumn("__r", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col(name).asc())))  # total: by count, then name
    out = ranked.withColumn("top", F.explode(F.array(*[F.lit(t) for t in tops]))).where("__r <= top").groupBy("top").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("rows"))
    return out.withColumn("share_pct", F.lit(100.0) * F.col("rows") / F.lit(total))


def vendor_share(rows: DataFrame, group: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(group, n, share_pct): rows of each group and their share within the coarser one."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", share_pct("n", within))
