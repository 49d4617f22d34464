"""Statistics with a total order or an exact rule for every tie."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.models import sized
from quern.sources.shared import cut


def share_pct(n: Column | str, group: Sequence[str] = ()) -> Column:
    """A count's share of its group's total, in per cent; over a table that is already aggregated."""
    n = F.col(n) if isinstance(n, str) else n
    return F.lit(100.0) * n / F.sum(n).over(Window.partitionBy(*group))


def mode_lowest(df: DataFrame, group: Sequence[str], column: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each group, the lowest of equals. Pre-aggregated by value, so that no group is sorted."""
    n = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*group).agg(F.max_by(column, F.struct("__n", -F.col(column))).alias(out))  # total: the key ends in the value itself


#: A group of up to so many rows is sorted by one task.
QUANTILE_ROWS = 1_000_000
#: Points of the sketch that narrows the rows around a rank: each round leaves some three of a thousand parts of them.
SKETCH_POINTS, SKETCH_ACCURACY = 1000, 10_000


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; b's are left out."""
    names = [f"__same{i}" for i in range(len(keys))]
    other = b.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in b.columns if c not in keys])
    return a.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names))), how).drop(*names)


def quantiles(df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str, float]], limit: int = QUANTILE_ROWS) -> DataFrame:
    """(group, <name> ...): exact quantiles, interpolated between the two values next to p * (n - 1); wanted: name ->
    (column, p).

    A group of any size: one of up to ``limit`` rows is sorted by one task; a larger one never is. There the rows next to
    a rank are found by selection (see ``selected``), in tasks of up to ``limit`` values. Null values don't count, a group
    without others gets null, a null group is a group; NaN is above all; an empty group list is the whole table, one row.
    The columns wanted are written once and read again, so that df is worked out once.
    """
    columns = sorted({c for c, _ in wanted.values()})
    keys = [f"__g{i}" for i in range(max(1, len(group)))]
    at = {c: f"__v{i}" for i, c in enumerate(columns)}
    by = [F.col(c).alias(k) for c, k in zip(group, keys)] or [F.lit(0).alias(keys[0])]
    rows = cut(df.select(*by, *[F.col(c).cast("double").alias(at[c]) for c in columns]))
    sizes = cut(rows.groupBy(*keys).agg(*[F.count(at[c]).alias(at[c]) for c in columns]))
    large = sizes.where(reduce(lambda x, y: x | y, (F.col(at[c]) > limit for c in columns)))
    plain = [F.percentile(at[c], F.lit(p)).alias(name) for name, (c, p) in wanted.items()]
    if large.isEmpty():
        found = rows.groupBy(*keys).agg(*plain)
    else:
        large = sized(cut(large))
        found = same(large.select(*keys), large, keys)
        for c in columns:
            ps = {name: p for name, (x, p) in wanted.items() if x == c}
            own = same(rows.where(F.col(at[c]).isNotNull()), large.select(*keys), keys, "left_semi").select(*keys, F.col(at[c]).alias("v"))
            n = large.where(F.col(at[c]) > 0).select(*keys, F.col(at[c]).alias("n"))
            ranks = n.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for name, p in ps.items()])).alias("x"))
            ranks = ranks.select(*keys, "x.name", "x.h")
            each = ranks.select(*keys, F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k")).distinct()
            values = selected(own, keys, same(each, n, keys), limit)
            lo = same(ranks.withColumn("k", F.floor("h")), values.withColumnRenamed("v", "lo"), [*keys, "k"])
            both = same(lo.withColumn("k", F.ceil("h")), values.withColumnRenamed("v", "hi"), [*keys, "k"])
            q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h")))
            one = both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, q)).alias(name) for name in ps])
            found = same(found, one, keys, "left")
        rest = same(rows, large.select(*keys), keys, "left_anti").groupBy(*keys).agg(*plain)
        found = found.select(*keys, *wanted).unionAll(rest.select(*keys, *wanted))
    if not group:
        found = found.select(*wanted) if not sizes.isEmpty() else df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(p)).alias(name) for name, (c, p) in wanted.items()])
        return found
    return found.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], *wanted)


#: Of a target and its bracket, ``lo`` to ``hi``: whether a value lies inside, and whether the target's own does.
_INSIDE = "(lo is null or v > lo) and (hi is null or v < hi)"
_PLACE = "(k - below - at_lo)"
_OPEN = f"({_PLACE} >= 0 and {_PLACE} < inside)"


def within(rows: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """The rows (keys, v) that lie inside any of the brackets (keys, lo, hi), each once."""
    names = [f"__same{i}" for i in range(len(keys))]
    other = sized(brackets.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "lo", "hi").distinct())
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)))
    return rows.select(*keys, "v").join(other, on & F.expr(_INSIDE), "left_semi")


def narrowed(rows: DataFrame, keys: list[str], targets: DataFrame, limit: int, rounds: int = 16) -> DataFrame:
    """(keys, k, lo, hi, below, at_lo, inside, stuck): for each of targets (keys, k, n), n the group's rows, two values that
    the one of rank k lies between (null: no bound) and the exact number of rows below the first, at it, and between them.

    While over ``limit`` rows are inside, a mergeable sketch of these (a few kilobytes a task) gives two closer ends and one
    more pass counts them; equal values count at an end or fall together, however many there are. Targets of one bracket
    share it, and a round reads only what the round before left inside.
    """
    return _narrowed(rows, keys, targets, limit, rounds)[0]


def _narrowed(rows: DataFrame, keys: list[str], targets: DataFrame, limit: int, rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """The same, and the rows that are still inside a bracket."""
    none = F.lit(None).cast("double")
    state = cut(targets.select(*keys, "k", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("at_lo"), F.col("n").alias("inside"), F.lit(False).alias("stuck")))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    wide_ = f"({_OPEN} and inside > {limit} and not stuck)"
    for _ in range(rounds):
        wide = state.where(wide_)
        if wide.isEmpty():
            break
        near = same(rows, sized(wide.select(*keys, "lo", "hi").distinct()), keys).where(_INSIDE)
        grid = near.groupBy(*keys, "lo", "hi").agg(F.percentile_approx("v", [i / SKETCH_POINTS for i in range(SKETCH_POINTS + 1)], SKETCH_ACCURACY).alias("grid"))
        t = F.expr(_PLACE) / F.col("inside") * SKETCH_POINTS
        closer = same(wide, grid, [*keys, "lo", "hi"])
        # get() is null beyond either end: the bracket's own end then stays
        closer = closer.withColumn("lo2", F.coalesce(F.get("grid", (F.floor(t) - 1).cast("int")), "lo")).withColumn("hi2", F.coalesce(F.get("grid", (F.ceil(t) + 1).cast("int")), "hi")).drop("grid")
        closer = cut(closer)
        ends = ["lo", "hi", "lo2", "hi2"]
        near = same(rows, sized(closer.select(*keys, *ends).distinct()), keys).where(_INSIDE)
        lo2, hi2, n = F.col("lo2"), F.col("hi2"), lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
        moved = near.groupBy(*keys, *ends).agg(
            n(v < lo2).alias("more"), n((v == lo2) & (lo.isNull() | (lo2 > lo))).alias("now_lo"), n((lo2.isNull() | (v > lo2)) & (hi2.isNull() | (v < hi2))).alias("now"), n(v == hi2).alias("now_hi")
        )
        both = same(closer, moved, [*keys, *ends])
        kept = lo2.eqNullSafe(lo)
        below = F.when(kept, F.col("below")).otherwise(F.col("below") + F.col("at_lo") + F.col("more"))
        at_lo = F.when(kept, F.col("at_lo")).otherwise(F.col("now_lo"))
        # a sketch is within its error by its making; were it not, or no closer, the bracket would stay as it is
        good = (F.col("k") >= below) & (F.col("k") < below + at_lo + F.col("now") + F.col("now_hi") + F.when(hi2.eqNullSafe(hi), 1).otherwise(0)) & (F.col("now") < F.col("inside"))
        new = both.select(
            *keys, "k", F.when(good, lo2).otherwise(lo).alias("lo"), F.when(good, hi2).otherwise(hi).alias("hi"), F.when(good, below).otherwise(F.col("below")).alias("below"),
            F.when(good, at_lo).otherwise(F.col("at_lo")).alias("at_lo"), F.when(good, F.col("now")).otherwise(F.col("inside")).alias("inside"), (~good).alias("stuck"),
        )
        state = cut(state.where(f"not {wide_}").unionAll(new))
        rows = cut(within(rows, keys, state.where(_OPEN)))
    return state, rows


def selected(rows: DataFrame, keys: list[str], targets: DataFrame, limit: int) -> DataFrame:
    """(keys, k, v): of rows (keys, v), none null, the value of rank k (from 0) in its group. The rows inside a target's
    bracket (see ``narrowed``) are counted by value and summed up in order, by a window over at most ``limit`` values."""
    state, rows = _narrowed(rows, keys, targets, limit)
    last = same(rows, sized(state.where(_OPEN)), keys).where(_INSIDE).groupBy(*keys, "k", "below", "at_lo", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = last.withColumn("upto", upto).where(f"{_PLACE} >= upto - c and {_PLACE} < upto").select(*keys, "k", "v")
    found = same(state, hit, [*keys, "k"], "left")
    return cut(found.select(*keys, "k", F.when(F.expr(_OPEN), F.col("v")).when(F.expr(f"{_PLACE} < 0"), F.col("lo")).otherwise(F.col("hi")).alias("v")))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def average_ranks(df: DataFrame, column: str, out: str, group: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of their places. For tables of groups, not of rows: one window."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    same = Window.partitionBy(*group, column)
    return df.withColumn(out, F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))  # total: equal values are meant to share a rank


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho, rho_textbook): rank correlation of two columns, as Pearson's of average ranks and by the textbook sum."""
    r = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    n, d = F.count(F.lit(1)), F.sum((F.col("__ra") - F.col("__rb")) ** 2)
    return r.agg(n.alias("n"), F.corr("__ra", "__rb").alias("rho"), (F.lit(1.0) - F.lit(6.0) * d / F.nullif(n * (n * n - 1), F.lit(0))).alias("rho_textbook"))


def bucket(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first edge that x is below; the last label beyond all; null for null."""
    out = None
    for e, label in zip(edges, labels):
        out = (F if out is None else out).when(x < e, label)
    return out.when(x.isNotNull(), labels[-1])


def histogram(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, bucket, n, share_pct)."""
    n = df.groupBy(*group, bucket(F.col(column), edges, labels).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share_pct", share_pct("n", group))


#: Rows of one range that a task sorts, about.
RANGE_ROWS = 1_000_000


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Ranks from 0 over the whole table by a total order (names: ascending, nulls last), without a task that sorts it all:
    rows are dealt out by ranges and written, the ranges counted, and each sorted on its own."""
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    # a range of about RANGE_ROWS, however many rows there are
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = cut(df.repartitionByRange(n, *by).withColumn("__p", F.spark_partition_id()))
    counts = sorted(dealt.groupBy("__p").count().collect())  # a number a range
    begin, at = {}, 0
    for r in counts:
        begin[r["__p"]], at = at, at + r["count"]
    starts = F.create_map(*[F.lit(x).cast("long") for p, b in begin.items() for x in (p, b)]) if begin else F.create_map().cast("map<bigint,bigint>")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*by)) - 1  # total: the caller gives a total order
    return dealt.withColumn(out, (starts[F.col("__p").cast("long")] + within).cast("long")).drop("__p")


def tertiles(df: DataFrame, order: Sequence[str], out: str = "tertile") -> DataFrame:
    """1 to 3 by a total order: thirds of the table, the first ones larger by a row where it can't be parted evenly."""
    ranked = global_rank(df, order, "__rank")
    n = ranked.count()
    size, more = n // 3, n % 3
    r, edge = F.col("__rank"), (n % 3) * (n // 3 + 1)
    third = F.when(r < edge, F.floor(r / (size + 1)) + 1).otherwise(more + F.floor((r - edge) / max(size, 1)) + 1)
    return ranked.withColumn(out, third.cast("int")).drop("__rank")


#: Rows of one group that a task pairs with each other, and each side of a pair of blocks, about.
PAIR_ROWS = 2_000


def pairs(df: DataFrame, group: Sequence[str], columns: Sequence[str], block_rows: int = PAIR_ROWS) -> DataFrame:
    """(group, <column>_a ..., <column>_b ...): every two rows of a group, both ways round, and each with itself; whoever
    takes them keeps one way round. There are as many as the group's square, which is the operator's result; but no task
    makes more than those of two blocks: a group of over ``block_rows`` rows is cut into blocks by a hash of the columns, and
    each pair of blocks is joined by itself. Rows of a null group pair with none; equal rows are of one block."""
    rows = cut(df.select(*group, *columns))
    hot = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows)
    hot = cut(hot.select(*group, F.ceil(F.col("__n") / block_rows).cast("long").alias("__blocks")))
    side = lambda x, s, more=(): x.select(*group, *more, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    if hot.isEmpty():
        return side(rows, "a").join(side(rows, "b"), list(group))
    blocks = F.coalesce("__blocks", F.lit(1).cast("long"))
    dealt = rows.join(sized(hot), list(group), "left").withColumn("__own", F.pmod(F.xxhash64(*columns), blocks))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumns({"__lo": F.least("__own", "__other"), "__hi": F.greatest("__own", "__other")}).drop("__other")
    a, b = side(dealt, "a", ("__lo", "__hi", F.col("__own").alias("__i"))), side(dealt, "b", ("__lo", "__hi", F.col("__own").alias("__j")))
    # a block's own pairs are those of the block with itself
    return a.join(b, [*group, "__lo", "__hi"]).where("__i <> __j or __lo = __hi").drop("__lo", "__hi", "__i", "__j")


#: Pairs that one task counts, about.
TASK_PAIRS = 4_000_000


def pair_counts(df: DataFrame, group: Sequence[str], column: str, block_rows: int = PAIR_ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b, n): for every two values b > a of a column, the groups that hold both; rows of a null group or value don't
    count, repeated ones count once.

    What moves is lists, not pairs: a group's values are one sorted list, and each value goes with the larger ones to the
    task that counts its pairs. A value of over ``task_pairs`` pairs is counted by several tasks, a share of its partners
    each; groups of over ``block_rows`` values are paired by blocks (see ``pairs``)."""
    some = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*group, column)))
    rows = cut(df.where(some).select(*group, F.col(column).alias("v")).distinct())
    hot = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select(*group))
    none = hot.isEmpty()
    cold = rows if none else rows.join(sized(hot), list(group), "left_anti")
    lists = cut(cold.groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("l")).select("l").where("size(l) > 1"))  # total: sorted
    led = lists.select(F.posexplode("l").alias("i", "a"), "l").where("i < size(l) - 1").select("a", F.expr("slice(l, i + 2, size(l) - i - 1)").alias("more"))
    if not none:
        led = led.unionAll(pairs(rows.join(sized(hot), list(group), "left_semi"), group, ["v"], block_rows).where("v_b > v_a").select(F.col("v_a").alias("a"), F.array("v_b").alias("more")))
    loads = cut(led.groupBy("a").agg(F.sum(F.size("more")).alias("m")))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(loads.agg(F.sum("m")).first()[0] or 0) // task_pairs))  # total: an aggregate is one row
    by = ["a"]
    large = loads.where(F.col("m") > task_pairs).select("a", F.ceil(F.col("m") / task_pairs).cast("long").alias("shares"))
    if not large.isEmpty():
        by = ["a", "share"]
        dealt = led.join(sized(large), "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1).cast("long")) - 1)))
        led = dealt.select("a", F.when(F.col("shares") > 1, F.expr("filter(more, x -> pmod(xxhash64(x), shares) = share)")).otherwise(F.col("more")).alias("more"), "share").where("size(more) > 0")
    # dealt out by some of the grouping's columns, so that the pairs are counted where they are made
    each = led.repartition(parts, *by).select(*by, F.explode("more").alias("b"))
    return each.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n")


def above(df: DataFrame, group: Sequence[str], column: str, partitions: int | None = None) -> DataFrame:
    """(group, column, n, more, total): each whole number's rows n, and of its group's larger numbers the rows and their sum:
    what an aggregation over ``pairs`` with b > a needs of them, without the pairs. Rows of a null group or number don't count.

    Numbers are dealt out by ranges, the ranges summed, and each summed up on its own, so that no task holds a group."""
    some = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*group, column)))
    each = cut(df.where(some).groupBy(*group, column).agg(F.count(F.lit(1)).alias("n")))
    ranges = partitions or max(1, -(-each.count() * 10 // RANGE_ROWS))
    dealt = cut(each.repartitionByRange(ranges, *group, F.col(column).desc()).withColumn("__p", F.spark_partition_id()))
    own = F.col("n") * F.col(column)
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy(*group, "__p").agg(F.sum("n").alias("__m"), F.sum(own).alias("__s"))
    starts = cut(starts.select(*group, "__p", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__m"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s")))
    larger = Window.partitionBy("__p", *group).orderBy(F.col(column).desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumns({"more": F.coalesce(F.sum("n").over(larger), F.lit(0)), "total": F.coalesce(F.sum(own).over(larger), F.lit(0))}).join(sized(starts), [*group, "__p"])
    return found.select(*group, column, "n", (F.col("more") + F.col("__m")).alias("more"), (F.col("total") + F.col("__s")).alias("total"))


def sample_share(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """A repeatable sample: the rows whose key's hash falls into one of so many classes."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group by a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")  # total: the caller gives a total order


def ordered_list(sort_by: Sequence[Column], payload: Column) -> Column:
    """An aggregate: the group's payloads as an array ordered by the sort columns (negate numbers for descending)."""
    names = [f"s{i}" for i in range(len(sort_by))]
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(n) for c, n in zip(sort_by, names)], payload.alias("p"))))  # total: sorted by the key
    return F.transform(rows, lambda x: x["p"])
