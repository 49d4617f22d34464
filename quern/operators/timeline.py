"""Operators over dated observations of keyed series.

A series is named by ``keys``; a table holds at most one row a series and day after ``daily``. A missing day is no
observation, never an unchanged price. All windows are partitioned by the whole series, so that one shuffle by the
keys serves a chain of them and no partition grows with the number of vendors alone; tables of vendors by day are
aggregates of at most vendors x days rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import HORIZONS, LOOKBACK_DAYS, PRICE_EPSILON, SPELL_GAP_DAYS


def daily(rows: DataFrame, keys: Sequence[str], day: str, price: str, flag: str | None = None) -> DataFrame:
    """(keys, d, px, on_sale): the least price of a series and day, on_sale if any of its rows is flagged."""
    out = [F.min(price).alias("px")]
    if flag:
        out.append(F.max(F.col(flag).cast("int")).alias("on_sale"))
    return rows.groupBy(*keys, F.col(day).alias("d")).agg(*out)


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("d")


def spans(days: DataFrame, keys: Sequence[str], until: Column | None = None) -> DataFrame:
    """(keys, d): every day from a group's first to ``until`` (by default the table's last day)."""
    first = days.groupBy(*keys).agg(F.min("d").alias("__a"), F.max("d").alias("__z"))
    if until is None:
        last = days.agg(F.max("d")).first()[0]  # total: an aggregate is one row
        until = F.lit(last)
    return first.where(F.col("__a").isNotNull()).select(*keys, F.explode(F.sequence("__a", F.greatest(until, "__a"))).alias("d"))


def missing_days(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d): days of the expected span, first seen to the table's last day, without an observation."""
    seen = rows.select(*keys, "d").distinct()
    return spans(seen, keys).join(seen, [*keys, "d"], "left_anti")


def runs(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, from_date, to_date, days): maximal runs of consecutive days."""
    tag = F.date_sub("d", F.row_number().over(_series(keys)))  # total: a series has one row a day
    return days.withColumn("__g", tag).groupBy(*keys, "__g").agg(F.min("d").alias("from_date"), F.max("d").alias("to_date"), F.count(F.lit(1)).alias("days")).drop("__g")


def gap_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, expected_days, missing_days, longest_gap) of each group; groups without a gap have 0."""
    seen = rows.select(*keys, "d").distinct()
    expected = spans(seen, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("expected_days"))
    gaps = runs(missing_days(rows, keys), keys).groupBy(*keys).agg(F.sum("days").alias("missing_days"), F.max("days").alias("longest_gap"))
    return expected.join(gaps, list(keys), "left").na.fill(0, ["missing_days", "longest_gap"])


def gap_windows(rows: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    return runs(missing_days(rows, keys), keys).where(F.col("days") >= least)


def date_gaps(rows: DataFrame) -> DataFrame:
    """(d, previous, gap_days): days of the whole table that follow a gap. One row a day, so one window is enough."""
    days = rows.select("d").distinct().where("d is not null")
    w = Window.orderBy("d")
    return days.withColumn("previous", F.lag("d").over(w)).withColumn("gap_days", F.datediff("d", "previous")).where("gap_days > 1")


def day_ratios(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, d, n, ratio): rows of each day, and their ratio to the previous observed day's."""
    n = rows.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ratio", F.col("n") / F.lag("n").over(_series(keys)))


def partial_days(rows: DataFrame, keys: Sequence[str], trailing: int = 28, shares: Sequence[int] = (50, 25, 10)) -> DataFrame:
    """(keys, d, n, trailing_median, below): days whose rows are under a share of the median of the days before.

    below is the smallest share in per cent that the day falls under; days that fall under none are left out.
    """
    n = rows.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    w = _series(keys).rowsBetween(-trailing, -1)
    n = n.withColumn("trailing_median", F.percentile("n", F.lit(0.5)).over(w))
    below = None
    for s in sorted(shares):
        below = (F if below is None else below).when(F.col("n") < F.col("trailing_median") * (s / 100.0), F.lit(s))
    return n.withColumn("below", below).where("below is not null")


def sale_events(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start_d, end_d, run_days, sale_px): islands of consecutive observed days on sale; sale_px is the least price.

    Days that weren't observed don't part an island; an observed day that isn't on sale does.
    """
    w, by = _series(keys), Window.partitionBy(*keys, "on_sale").orderBy("d")
    tag = F.row_number().over(w) - F.row_number().over(by)  # total: a series has one row a day
    return days.withColumn("__g", tag).where("on_sale = 1").groupBy(*keys, "__g").agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count(F.lit(1)).alias("run_days"), F.min("px").alias("sale_px")).drop("__g")


def with_lookback(events: DataFrame, days: DataFrame, keys: Sequence[str], window: int = LOOKBACK_DAYS) -> DataFrame:
    """Each event with the observed days of the ``window`` days before its start: an equi-join by series with the date
    range as a residual, at most ``window`` rows an event; events without any keep one row with null d and px."""
    e = events.alias("e")
    o = days.select(*[F.col(k).alias(f"__{k}") for k in keys], "d", "px")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"e.{k}") == F.col(f"__{k}"))
    near = F.col("d").between(F.date_sub(F.col("e.start_d"), window), F.date_sub(F.col("e.start_d"), 1))
    return e.join(o, on & near, "left").drop(*[f"__{k}" for k in keys])


def evaluable_events(events: DataFrame, days: DataFrame, keys: Sequence[str], window: int = LOOKBACK_DAYS, least: int | None = None) -> DataFrame:
    """Events with prior_days, the observed days of the window before, of which at least ``least`` (all) are there."""
    rows = with_lookback(events, days, keys, window).groupBy(*events.columns).agg(F.count("d").alias("prior_days"))
    return rows.where(F.col("prior_days") >= (window if least is None else least))


def lookback_statistics(events: DataFrame, days: DataFrame, keys: Sequence[str], window: int = LOOKBACK_DAYS) -> DataFrame:
    """Events with statistics of the days before: prior_days, modal (the lowest of the most frequent), median, last,
    low, high and the number of distinct prices. Two plain aggregations over the look-back join, no window."""
    rows = with_lookback(events, days, keys, window).where("d is not null")
    per = rows.groupBy(*events.columns, "px").agg(F.count(F.lit(1)).alias("__n"), F.max("d").alias("__last"))
    return per.groupBy(*events.columns).agg(
        F.sum("__n").alias("prior_days"), F.max_by("px", F.struct("__n", -F.col("px"))).alias("modal_px"),  # total: the key ends in the price, which is the group key
        F.percentile("px", F.lit(0.5), F.col("__n")).alias("median_px"), F.max_by("px", "__last").alias("last_px"),  # total: a last day is of one row of a series
        F.min("px").alias("low_px"), F.max("px").alias("high_px"), F.count(F.lit(1)).alias("distinct_px"),
    )


def steps(days: DataFrame, keys: Sequence[str], epsilon: float = PRICE_EPSILON) -> DataFrame:
    """Every observation with the one before it: prev_px, prev_d, gap_days, and whether the price changed."""
    w = _series(keys)
    out = days.withColumn("prev_px", F.lag("px").over(w)).withColumn("prev_d", F.lag("d").over(w))
    return out.withColumn("gap_days", F.datediff("d", "prev_d")).withColumn("changed", F.abs(F.col("px") - F.col("prev_px")) > epsilon)


def weekday_changes(days: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(group, weekday, changes, share_pct): price changes between neighbouring days by weekday (0 is Sunday)."""
    s = steps(days, keys).where("changed and gap_days = 1")
    n = s.groupBy(*group, (F.dayofweek("d") - 1).cast("long").alias("weekday")).agg(F.count(F.lit(1)).alias("changes"))
    return n.withColumn("share_pct", F.lit(100.0) * F.col("changes") / F.sum("changes").over(Window.partitionBy(*group)))


def weekday_concentration(changes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, busiest, excess_pct): the weekday with most changes (the first of equals), and its share over a seventh."""
    best = changes.groupBy(*group).agg(F.max_by("weekday", F.struct("changes", -F.col("weekday"))).alias("busiest"), F.max("share_pct").alias("top_pct"))  # total: the key ends in the weekday, which is the group key
    return best.select(*group, "busiest", (F.col("top_pct") - F.lit(100.0) / 7).alias("excess_pct"))


def spells(days: DataFrame, keys: Sequence[str], gap: int = SPELL_GAP_DAYS, epsilon: float = PRICE_EPSILON, flag: bool = True) -> DataFrame:
    """(keys, from_date, to_date, px, observed_days, calendar_days, on_sale): runs of one price (and one sale state).

    A gap of more than ``gap`` days ends a spell. px is the price of its first day.
    """
    w = _series(keys)
    new = F.lag("d").over(w).isNull() | (F.abs(F.col("px") - F.lag("px").over(w)) > epsilon) | (F.datediff("d", F.lag("d").over(w)) > gap)
    if flag:
        new = new | (F.col("on_sale") != F.lag("on_sale").over(w))
    marked = days.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = [F.min("d").alias("from_date"), F.max("d").alias("to_date"), F.min_by("px", "d").alias("px"), F.count(F.lit(1)).alias("observed_days")]  # total: a series has one row a day
    if flag:
        out.append(F.max("on_sale").alias("on_sale"))
    found = marked.groupBy(*keys, "__s").agg(*out).drop("__s")
    return found.withColumn("calendar_days", (F.datediff("to_date", "from_date") + 1).cast("long"))


def horizons(days: DataFrame, keys: Sequence[str], ks: Sequence[int] = HORIZONS) -> DataFrame:
    """Each observation with the price k days later (later_px, null if that day wasn't observed), for every k.

    A window's range of one day looks each horizon up, so that a series is moved once and as it is; the horizons are
    spread after that, in the same task. A series with a null in its keys has no later prices.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date("d").cast("long"))
    known = F.col("d").isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    later = [F.struct(F.lit(k).alias("k"), F.when(known, F.max("px").over(w.rangeBetween(k, k))).alias("later_px")) for k in ks]
    found = days.select(*keys, "d", "px", F.array(*later).alias("__later"))
    return found.select(*keys, "d", "px", F.explode("__later").alias("__later")).select(*keys, "d", "px", "__later.k", "__later.later_px")


def staleness(days: DataFrame, keys: Sequence[str], group: Sequence[str], ks: Sequence[int] = HORIZONS, epsilon: float = PRICE_EPSILON) -> DataFrame:
    """(group, k, pairs, unobserved, pct_wrong): of the observations seen again k days later, how many had another price."""
    wrong = F.sum((F.abs(F.col("later_px") - F.col("px")) > epsilon).cast("long"))
    n = horizons(days, keys, ks).groupBy(*group, "k").agg(F.count("later_px").alias("pairs"), F.sum(F.col("later_px").isNull().cast("long")).alias("unobserved"), wrong.alias("__wrong"))
    return n.withColumn("pct_wrong", F.lit(100.0) * F.coalesce("__wrong", F.lit(0)) / F.nullif(F.col("pairs"), F.lit(0))).drop("__wrong")


def refresh_matrix(days: DataFrame, keys: Sequence[str], group: Sequence[str], most: int = 7, epsilon: float = PRICE_EPSILON) -> DataFrame:
    """(group, weekday, day_1 .. day_most, worst, mean): what a price captured on a weekday (0 is Sunday) costs each day on."""
    h = horizons(days, keys, range(1, most + 1)).where("later_px is not null").withColumn("weekday", (F.dayofweek("d") - 1).cast("long"))
    rate = lambda k: F.avg(F.when(F.col("k") == k, (F.abs(F.col("later_px") - F.col("px")) > epsilon).cast("double") * 100))
    out = h.groupBy(*group, "weekday").agg(*[rate(k).alias(f"day_{k}") for k in range(1, most + 1)])
    columns = [F.col(f"day_{k}") for k in range(1, most + 1)]
    have = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return out.withColumn("worst", F.greatest(*columns)).withColumn("mean", F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0)))


def magnitude_jumps(days: DataFrame, keys: Sequence[str], bands: dict[str, tuple[float, float]], most_days: int = 3) -> DataFrame:
    """Neighbouring observations at most ``most_days`` apart whose ratio lies in a band, with the band's name; only
    these rows are kept."""
    s = steps(days, keys).where((F.col("gap_days") <= most_days) & (F.col("prev_px") > 0)).withColumn("ratio", F.col("px") / F.col("prev_px"))
    band = None
    for name, (a, b) in bands.items():
        band = (F if band is None else band).when(F.col("ratio").between(a, b), name)
    return s.withColumn("band", band).where("band is not null")


def nearest(events: DataFrame, days: DataFrame, keys: Sequence[str], within: int, event_id: Sequence[str]) -> DataFrame:
    """Each event (with its day d) with the nearest other observation of its series within so many days either side:
    near_d, near_px; of two as near, the earlier, then the lower price. Events without one are left out.

    The range is made an equi-join on buckets of 2 * within + 1 days: an event looks into its own and one neighbour's.
    """
    width = 2 * within + 1
    ordinal = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    e = events.withColumn("__b", F.explode(F.sequence(F.floor((ordinal("d") - within) / width), F.floor((ordinal("d") + within) / width))))
    o = days.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("d").alias("near_d"), F.col("px").alias("near_px")).withColumn("__o", F.floor(ordinal("near_d") / width))
    on = F.col("__b") == F.col("__o")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    close = e.join(o, on).withColumn("__far", F.abs(F.datediff("near_d", "d"))).where(F.col("__far") <= within)
    best = Window.partitionBy(*event_id).orderBy("__far", "near_d", "near_px")
    return close.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__b", "__o", "__far", "__r", *[f"__{k}" for k in keys])  # total: by distance, day and price, of which a series has one row


def expand_spells(spell: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d, px): one row for each calendar day of a spell."""
    return spell.select(*keys, F.explode(F.sequence("from_date", "to_date")).alias("d"), "px")


def compare_histories(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(agree, differ, only_a, only_b): two spell histories held against each other day by day."""
    x, y = expand_spells(a, keys).withColumnRenamed("px", "pa"), expand_spells(b, keys).withColumnRenamed("px", "pb")
    both = x.join(y, [*keys, "d"], "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(n(F.abs(F.col("pa") - F.col("pb")) <= PRICE_EPSILON).alias("agree"), n(F.abs(F.col("pa") - F.col("pb")) > PRICE_EPSILON).alias("differ"), n(F.col("pb").isNull()).alias("only_a"), n(F.col("pa").isNull()).alias("only_b"))
