"""Operators that audit a panel: what is missing, what is excluded, what changed between two snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import shape
from quern.operators.stats import PAIR_ROWS, pairs, quantiles, same, share_pct
from quern.sources.shared import cut


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def null_profile(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, column, n, empty, empty_pct): null or blank values of each column, one pass over the rows."""
    counts = [_n(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns]
    wide = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *counts)
    long = wide.select(*group, "n", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "empty"))
    return long.withColumn("empty_pct", F.lit(100.0) * F.col("empty") / F.col("n"))


def key_stability(rows: DataFrame, series: Sequence[str], identity: str, group: Sequence[str]) -> DataFrame:
    """(group, series, single_pct, most): how many identities a series has had. min <> max in place of a distinct count
    wherever only "more than one" matters; the count itself is over pre-aggregated pairs."""
    ids = rows.groupBy(*dict.fromkeys([*group, *series]), identity).agg(F.count(F.lit(1)).alias("__r"))
    each = ids.groupBy(*dict.fromkeys([*group, *series])).agg(F.count(identity).alias("__n"))
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("series"), (F.lit(100.0) * _n(F.col("__n") == 1) / F.count(F.lit(1))).alias("single_pct"), F.max("__n").alias("most"))


def duplicate_days(rows: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """(key_days, repeated, conflicting, most_rows): key-days with several rows, and with several prices."""
    each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), (F.min(price) != F.max(price)).alias("__c"))
    return each.agg(F.count(F.lit(1)).alias("key_days"), _n(F.col("__n") > 1).alias("repeated"), _n(F.col("__c")).alias("conflicting"), F.max("__n").alias("most_rows"))


def movement(days: DataFrame, keys: Sequence[str], group: Sequence[str], price: str = "px") -> DataFrame:
    """(group, series, never_changed_pct, median_prices): distinct prices that each series has shown."""
    each = days.groupBy(*keys, price).agg(F.count(F.lit(1)).alias("__r")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("series"), (F.lit(100.0) * _n(F.col("__n") == 1) / F.count(F.lit(1))).alias("never_changed_pct"), F.median("__n").alias("median_prices"))


def agreement(rows: DataFrame, stated: Column, derived: Column, group: Sequence[str]) -> DataFrame:
    """(group, n, off_1_pct, off_10_pct, median_off_pct): a stated unit price against the derived one."""
    off = F.lit(100.0) * F.abs(stated - derived) / F.nullif(F.abs(derived), F.lit(0.0))
    r = cut(rows.select(*group, off.alias("__off")).where("__off is not null"))
    share = lambda least: F.lit(100.0) * _n(F.col("__off") > least) / F.count(F.lit(1))
    found = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), share(1.0).alias("off_1_pct"), share(10.0).alias("off_10_pct"))
    return same(found, quantiles(r, group, {"median_off_pct": ("__off", 0.5)}), group)


def implied_packs(rows: DataFrame, implied: Column, parsed: Column) -> DataFrame:
    """(diagnosis, n, share_pct): the pack count that a unit price implies against the parsed one."""
    near = F.abs(implied - parsed) <= 0.05 * parsed
    label = (
        F.when(implied.isNull() | parsed.isNull(), "not comparable").when(near, "agree")
        .when((parsed == 1) & (implied > 1.5), "pack missed").when((parsed > 1) & (F.abs(implied - 1) <= 0.05), "pack invented").otherwise("disagree")
    )
    return rows.groupBy(label.alias("diagnosis")).agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", share_pct("n"))


def exclusion_class(orphan: Column, unparsed: Column, ambiguous: Column) -> Column:
    """One class a row, the first that holds: orphan, unparsed, ambiguous, retained."""
    return F.when(F.coalesce(orphan, F.lit(False)), "orphan").when(F.coalesce(unparsed, F.lit(False)), "unparsed").when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").otherwise("retained")


def ledger(rows: DataFrame, group: Sequence[str], cls: str = "exclusion") -> DataFrame:
    """(group, class, n, share_pct): every row counted once, retained or excluded, with its share of the group."""
    return rows.groupBy(*group, cls).agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", share_pct("n", group))


def enrichment(rows: DataFrame, group: Sequence[str], excluded: str, flag: str) -> DataFrame:
    """(group, n_excluded, n_retained, excluded_pct, retained_pct, ratio): is a flag commoner among what was excluded?
    Groups with only one of the two sides are kept."""
    side = lambda x: rows.where(F.col(excluded) == x).groupBy(*group).agg(F.count(F.lit(1)).alias(f"n_{'excluded' if x else 'retained'}"), (F.lit(100.0) * _n(F.col(flag)) / F.count(F.lit(1))).alias(f"{'excluded' if x else 'retained'}_pct"))
    both = side(True).join(side(False), list(group), "full").na.fill(0, ["n_excluded", "n_retained"])
    return both.withColumn("ratio", F.col("excluded_pct") / F.nullif(F.col("retained_pct"), F.lit(0.0)))


def filter_audit(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """(population, n): all rows, those that pass filter a, b, both, either, and the check of inclusion and exclusion."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    w = rows.agg(F.count(F.lit(1)).alias("all"), _n(a).alias("a"), _n(b).alias("b"), _n(a & b).alias("both"), _n(a | b).alias("either")).withColumn("check", F.col("a") + F.col("b") - F.col("both") - F.col("either"))
    return w.select(F.explode(F.create_map(*[x for c in w.columns for x in (F.lit(c), F.col(c))])).alias("population", "n"))


def row_hash(columns: Sequence[str]) -> Column:
    """One row's share of an order-independent checksum; equal tables have equal sums, whatever their row order."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]).cast("decimal(38,0)")


def fingerprints(rows: DataFrame, group: Sequence[str], columns: Sequence[str], checksum: Column | None = None) -> DataFrame:
    """(group, rows, checksum)."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_hash(columns) if checksum is None else checksum).alias("checksum"))


def fingerprint_diff(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, rows_a, rows_b, verdict): identical, count changed, content changed, or on one side only."""
    x = a.select(*group, F.col("rows").alias("rows_a"), F.col("checksum").alias("__a"))
    y = b.select(*group, F.col("rows").alias("rows_b"), F.col("checksum").alias("__b"))
    verdict = (
        F.when(F.col("rows_b").isNull(), "only first").when(F.col("rows_a").isNull(), "only second").when(F.col("rows_a") != F.col("rows_b"), "count changed")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "identical").otherwise("content changed")
    )
    return x.join(y, list(group), "full").withColumn("verdict", verdict).drop("__a", "__b")


def multiset_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, gained, lost): copies of each row that the second table has more or fewer of. Nulls equal nulls: both
    sides are counted in one aggregation, without a join."""
    both = a.select(*columns, F.lit(-1).alias("__s")).unionByName(b.select(*columns, F.lit(1).alias("__s")))
    d = both.groupBy(*columns).agg(F.sum("__s").alias("__d")).where("__d <> 0")
    return d.withColumn("gained", F.greatest(F.col("__d"), F.lit(0))).withColumn("lost", F.greatest(-F.col("__d"), F.lit(0))).drop("__d")


def drift(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, common, changed, filled, emptied): attributes of the keys that both snapshots have."""
    x = a.select(F.col(key), *[F.col(c).alias(f"__a{i}") for i, c in enumerate(columns)])
    y = b.select(F.col(key), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(columns)])
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    per = []
    for i, c in enumerate(columns):
        p, q = f"__a{i}", f"__b{i}"
        per.append(F.struct(F.lit(c).alias("column"), _n(~empty(p) & ~empty(q) & (F.col(p) != F.col(q))).alias("changed"), _n(empty(p) & ~empty(q)).alias("filled"), _n(~empty(p) & empty(q)).alias("emptied")))
    one = x.join(y, key).agg(F.count(F.lit(1)).alias("common"), F.array(*per).alias("x"))
    return one.select("common", F.inline("x")).select("column", "common", "changed", "filled", "emptied")


def recovery(a: DataFrame, b: DataFrame, keys: Sequence[str], price: str, factor: float = 100.0, tolerance: float = 0.005) -> DataFrame:
    """(rows, corrupted, recovered_pct): prices of the second snapshot that a division by ``factor`` turns into the first's."""
    both = a.select(*keys, F.col(price).alias("__a")).join(b.select(*keys, F.col(price).alias("__b")), list(keys))
    bad = F.abs(F.col("__a") - F.col("__b")) > tolerance
    back = bad & (F.abs(F.col("__b") / factor - F.col("__a")) <= tolerance)
    return both.agg(F.count(F.lit(1)).alias("rows"), _n(bad).alias("corrupted"), (F.lit(100.0) * _n(back) / F.nullif(_n(bad), F.lit(0))).alias("recovered_pct"))


def collisions(tables: Sequence[DataFrame], source: Column, key: Column) -> DataFrame:
    """(sources, keys, collisions) over the union of the tables; distinct pairs are counted, not rows."""
    each = reduce(DataFrame.unionAll, [t.select(source.alias("s"), key.alias("k")) for t in tables]).where("s is not null").distinct()
    return each.agg(F.countDistinct("s").alias("sources"), F.countDistinct("k").alias("keys")).withColumn("collisions", F.col("sources") - F.col("keys"))


def orphans(rows: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """The rows whose key no product has; null keys are orphans too."""
    return rows.join(products.select(key).distinct(), key, "left_anti")


def orphan_profile(rows: DataFrame, products: DataFrame, key: str, group: Sequence[str], day: str) -> DataFrame:
    """(group, rows, orphans, orphan_pct, first_day, last_day): orphan rate, and when orphans were seen."""
    known = products.select(key).distinct().withColumn("__k", F.lit(True))
    m = rows.join(known, key, "left").withColumn("__o", F.col("__k").isNull())
    return m.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), _n(F.col("__o")).alias("orphans"), (F.lit(100.0) * _n(F.col("__o")) / F.count(F.lit(1))).alias("orphan_pct"), F.min(F.when(F.col("__o"), F.col(day))).alias("first_day"), F.max(F.when(F.col("__o"), F.col(day))).alias("last_day"))


def shape_census(rows: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, shape, n, least, most): texts by shape with the first and last example."""
    return rows.groupBy(*group, shape(F.col(column)).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))


def flag_table(rows: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """(group, both, only_a, only_b, neither, agree_pct): how two flags of one thing agree."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    return rows.groupBy(*group).agg(_n(x & y).alias("both"), _n(x & ~y).alias("only_a"), _n(~x & y).alias("only_b"), _n(~x & ~y).alias("neither"), (F.lit(100.0) * _n(x == y) / F.count(F.lit(1))).alias("agree_pct"))


def frozen_coverage(days: DataFrame, keys: Sequence[str], windows: Sequence[tuple], share: float = 0.9) -> DataFrame:
    """(window, series, covered, gapless, flat): series with observations in a window, those seen on enough of its days,
    on all of them, and with one price throughout. windows: (label, first, last); a handful, so that they are exploded."""
    w = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, a, z in windows]))
    inside = days.withColumn("w", w).where(F.col("d").between(F.col("w.a"), F.col("w.z")))
    each = inside.groupBy(F.col("w.window").alias("window"), (F.datediff("w.z", "w.a") + 1).alias("__len"), *keys).agg(F.count(F.lit(1)).alias("__n"), (F.max("px") - F.min("px")).alias("__s"))
    covered = F.col("__n") >= share * F.col("__len")
    return each.groupBy("window").agg(F.count(F.lit(1)).alias("series"), _n(covered).alias("covered"), _n(F.col("__n") == F.col("__len")).alias("gapless"), _n(covered & (F.col("__s") <= 0.005)).alias("flat"))


def relisted_sizes(products: DataFrame, group: Sequence[str], size: str, first: str, last: str, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(group, size_a, size_b, concurrent): one name listed in two sizes, a's window beginning first, and whether the
    windows overlap; a shrinking pack is sequential. Pairs are per name, whose sizes are few; a name of many sizes is
    paired by blocks (see ``stats.pairs``)."""
    each = products.where(F.col(size).isNotNull()).groupBy(*group, F.col(size).alias("size")).agg(F.min(first).alias("f"), F.max(last).alias("l"))
    ordered = (F.col("f_a") < F.col("f_b")) | ((F.col("f_a") == F.col("f_b")) & (F.col("size_a") < F.col("size_b")))
    return pairs(each, group, ["size", "f", "l"], block_rows).where(ordered).withColumn("concurrent", F.col("l_a") >= F.col("f_b")).select(*group, "size_a", "size_b", "concurrent")


def gap_moves(steps: DataFrame, group: Sequence[str], long_gap: int = 30, moves: Sequence[int] = (50, 200)) -> DataFrame:
    """(group, after_gap, n, over_50_pct, over_200_pct): do prices jump more after a long absence than from day to day?"""
    move = F.lit(100.0) * F.abs(F.col("px") - F.col("prev_px")) / F.nullif(F.col("prev_px"), F.lit(0.0))
    s = steps.where("prev_px is not null").withColumn("after_gap", F.col("gap_days") > long_gap).withColumn("__m", move)
    return s.groupBy(*group, "after_gap").agg(F.count(F.lit(1)).alias("n"), *[(F.lit(100.0) * _n(F.col("__m") > m) / F.count(F.lit(1))).alias(f"over_{m}_pct") for m in moves])


def sale_frequency(days: DataFrame, keys: Sequence[str], group: Sequence[str], least_days: int = 90, marks: Sequence[int] = (50, 75, 90)) -> DataFrame:
    """(group, products, median_pct, at_least_*_pct, always_on): share of a product's observed days that it is on sale."""
    each = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("on_sale").alias("__s")).where(F.col("__n") >= least_days).withColumn("__p", F.lit(100.0) * F.col("__s") / F.col("__n"))
    share = lambda m: (F.lit(100.0) * _n(F.col("__p") >= m) / F.count(F.lit(1))).alias(f"at_least_{m}_pct")
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("products"), F.median("__p").alias("median_pct"), *[share(m) for m in marks], _n(F.col("__s") == F.col("__n")).alias("always_on"))


def claims(events: DataFrame, claim: str, group: Sequence[str], statistics: Sequence[str], tolerance: float) -> DataFrame:
    """(group, events, <statistic>_pct ...): advertised regular prices above each statistic of the days before."""
    over = lambda s: (F.lit(100.0) * _n(F.col(claim) > F.col(s) * tolerance) / F.count(F.lit(1))).alias(f"{s}_pct")
    return events.groupBy(*group).agg(F.count(F.lit(1)).alias("events"), *[over(s) for s in statistics])


