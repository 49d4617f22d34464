"""Statements judged by Spark's own reading of them: hazards of order in the parsed plan, what a remark claims of them held
against the data, and where a model's columns come from in the analysed plan."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from quern.sources.sqlfile import REMARKS, statements, tokens

#: The words that begin a remark which explains a hazard; how many words its reason has at least; how many
#: lines above the hazard it may end.
EXPLAINS = ("total", "determinism-ok")
REASON_WORDS, REASON_LINES = 3, 6

PICKS = {"any_value", "first", "last", "first_value", "last_value", "max_by", "min_by", "mode"}
LISTS = {"collect_list", "array_agg", "listagg", "string_agg"}
RANKS = {"row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist"}
SORTS = {"array_sort", "sort_array"}
#: Expressions that the parser makes itself, and the functions that they are.
_CLASSES = {"AnyValue": "any_value", "First": "first", "Last": "last", "MaxBy": "max_by", "MinBy": "min_by", "CollectList": "collect_list", "ListAgg": "string_agg"}


@dataclass(frozen=True)
class Hazard:
    """``what`` may depend on the order of rows; reason: what a remark says to it; hard: no remark can explain it."""

    statement: int
    line: int
    what: str
    reason: str | None
    hard: bool = False

    @property
    def open(self) -> bool:
        return self.hard or self.reason is None


def _seq(x) -> Iterator:
    it = x.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _line(node) -> int:
    at = node.origin().line()
    return at.get() if at.isDefined() else 0


def reasons(spark: SparkSession, text: str) -> dict[int, str]:
    """line -> reason, for every line that a remark with a real reason ends on. What looks like a remark inside a string
    isn't one."""
    out = {}
    for t in tokens(spark, text):
        if t.kind in REMARKS:
            for i, line in enumerate(t.text.splitlines()):
                found = re.match(rf"[\s\-/*]*(?:{'|'.join(EXPLAINS)})\s*:\s*(.*?)[\s*/]*$", line, re.I)
                if found and len(found[1].split()) >= REASON_WORDS:
                    out[t.line + i] = found[1]
    return out


def _named(e) -> str | None:
    """The function that an expression calls, if it is one."""
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        return list(_seq(e.nameParts()))[-1].lower()
    return _CLASSES.get(kind)


def _in_expression(e, windows: Mapping[str, object], sorted_above: bool = False) -> Iterator[tuple[int, str, bool]]:
    """(line, what, hard) of an expression's hazards."""
    kind = _kind(e)
    if kind in ("WindowExpression", "UnresolvedWindowExpression"):
        call = e.windowFunction() if kind == "WindowExpression" else e.child()
        spec = e.windowSpec() if kind == "WindowExpression" else windows.get(e.windowSpec().name())
        name = _named(call) or _named(next(_seq(call.children()), call))
        if name in RANKS | PICKS | LISTS:
            ordered = spec is not None and _kind(spec) == "WindowSpecDefinition" and not spec.orderSpec().isEmpty()
            yield _line(e), f"{name} over ties" if ordered else f"{name} without an order", not ordered and name in RANKS
        for c in _seq(call.children()):
            yield from _in_expression(c, windows)
        return
    name = _named(e)
    if name in PICKS:
        yield _line(e), f"{name} of a group", False
    elif name in LISTS and not sorted_above and not (kind == "UnresolvedFunction" and not e.orderingWithinGroup().isEmpty()):
        yield _line(e), f"{name} without an order", False
    for c in _seq(e.children()):
        yield from _in_expression(c, windows, name in SORTS)


def _sorted_below(node) -> bool:
    while _kind(node) in ("LocalLimit", "Project", "SubqueryAlias", "UnresolvedHint", "WithWindowDefinition", "Offset"):
        node = node.child()
    return _kind(node) == "Sort" and bool(getattr(node, "global")())


def _in_plan(node, windows: Mapping[str, object]) -> Iterator[tuple[int, str, bool]]:
    kind = _kind(node)
    if kind == "WithWindowDefinition":
        windows = {**windows, **{x._1(): x._2() for x in _seq(node.windowDefinitions())}}
    if kind == "GlobalLimit" and node.limitExpr().toString() != "0" and not _sorted_below(node.child()):
        yield _line(node), "limit without an order", False
    for e in _seq(node.expressions()):
        yield from _in_expression(e, windows)
    for c in [*_seq(node.children()), *_seq(node.innerChildren())]:  # subqueries and common table expressions too
        yield from _in_plan(c, windows)


def hazards(spark: SparkSession, text: str) -> list[Hazard]:
    """The hazards of a script's statements, in order. The statements are parsed, not run: their tables needn't exist."""
    why, out = reasons(spark, text), []
    parser = spark._jsparkSession.sessionState().sqlParser()
    for i, (first, statement) in enumerate(statements(spark, text), 1):
        plan = parser.parsePlan("\n" * (first - 1) + statement)  # so that lines are the script's
        for line, what, hard in sorted(set(_in_plan(plan, {}))):
            reason = next((why[x] for x in range(line, line - REASON_LINES - 1, -1) if x in why), None)
            out.append(Hazard(i, line, what, None if hard else reason, hard))
    return out


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _columns(spark: SparkSession, expressions) -> list[Column]:
    of = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column
    return [ClassicColumn(of(e)) for e in expressions]


def _broken(rows: DataFrame, keys: list[Column], value: Column, by: Column | None = None) -> DataFrame:
    """(groups, broken): in how many groups the value isn't one; with ``by`` only the rows of its largest value count."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = rows.select(*keys, value.alias("v"), *([by.alias("by")] if by is not None else []))
    names = [f"k{i}" for i in range(len(keys))]
    several = (F.min("v") != F.max("v")) | ((F.count("v") > 0) & (F.count("v") < F.count(F.lit(1))))
    each = rows.groupBy(*names, *(["by"] if by is not None else [])).agg(F.coalesce(several, F.lit(False)).alias("several"))
    if by is not None:
        each = each.groupBy(*names).agg(F.max_by("several", "by").alias("several"))  # total: the key is the group's
    return each.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.coalesce("several", F.lit(False)).cast("long")), F.lit(0)).alias("broken"))


def _claims(spark: SparkSession, node) -> Iterator[tuple[str, DataFrame]]:
    """(what, groups and broken ones) of an analysed plan's picks, lists and numberings, each over its own input."""
    kind = _kind(node)
    outer = any(e.containsPattern(spark._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.OUTER_REFERENCE()) for e in _seq(node.expressions()))
    if kind == "Aggregate" and not outer:
        rows, keys = _frame(spark, node.child()), _columns(spark, _seq(node.groupingExpressions()))
        for e in _seq(node.aggregateExpressions()):
            for call, above in _calls(e):
                name = _CLASSES.get(_kind(call))
                if name in ("any_value", "first", "last"):
                    yield f"{name} of a group", _broken(rows, keys, *_columns(spark, [next(_seq(call.children()))]))
                elif name in ("max_by", "min_by"):
                    value, by = _columns(spark, _seq(call.children()))
                    yield f"{name} of a group", _broken(rows, keys, value, by if name == "max_by" else _reversed(by, rows))
                elif name in LISTS and above not in ("ArraySort", "SortArray") and not (name == "string_agg" and not call.orderExpressions().isEmpty()):
                    yield f"{name} without an order", _broken(rows, keys, *_columns(spark, [next(_seq(call.children()))]))
    if kind == "Window" and not outer:
        rows = _frame(spark, node.child())
        for e in _seq(node.windowExpressions()):
            call = e.child()
            name = _kind(call.windowFunction()).lower() if _kind(call) == "WindowExpression" else ""
            if name in ("rownumber", "ntile"):
                spec = call.windowSpec()
                keys = _columns(spark, _seq(spec.partitionSpec())) + _columns(spark, [o.child() for o in _seq(spec.orderSpec())])
                # rows that tie: a tie is broken where its rows aren't the same
                yield f"{'row_number' if name == 'rownumber' else name} over ties", _broken(rows, keys, F.struct("*"))
    for c in [*_seq(node.children()), *_seq(node.innerChildren())]:
        yield from _claims(spark, c)


def _calls(e, above: str = "") -> Iterator[tuple[object, str]]:
    if _kind(e) in _CLASSES:
        yield e, above
    for c in _seq(e.children()):
        yield from _calls(c, above if _kind(e) == "AggregateExpression" else _kind(e))


def _reversed(by: Column, rows: DataFrame) -> Column:
    """A column in the opposite order, for numbers and dates."""
    kind = rows.select(by.alias("by")).schema[0].dataType.simpleString()
    return -F.datediff(by, F.lit("1970-01-01").cast("date")) if kind == "date" else -F.unix_micros(by.cast("timestamp")) if kind.startswith("timestamp") else -by


def claims(spark: SparkSession, text: str) -> DataFrame:
    """(statement, what, groups, broken): of every pick, unordered list and numbering of a script's queries, the groups it
    is taken of and those in which it isn't determined by the data: a remark that says it is can be held against them. One
    aggregation each, over the input that the statement itself gives it. Parts that refer to an outer query are left out."""
    out = None
    for i, (_, statement) in enumerate(statements(spark, text), 1):
        for what, found in _claims(spark, spark.sql(statement)._jdf.queryExecution().analyzed()):
            found = found.select(F.lit(i).alias("statement"), F.lit(what).alias("what"), "groups", "broken")
            out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "statement int, what string, groups long, broken long")


# ---- lineage


def _id(attribute) -> int:
    return attribute.exprId().id()


def _aliases(e) -> Iterator:
    if _kind(e) == "Alias":
        yield e
    for c in _seq(e.children()):
        yield from _aliases(c)


def lineage(df: DataFrame, sources: Sequence[DataFrame] = ()) -> tuple[dict[str, frozenset[str]], frozenset[str]]:
    """(column -> every name that its values had on the way from the sources, names that conditions read): the analysed
    plan's attributes, followed from the leaves up. ``sources`` are taken as leaves where the plan has them in it; a plan
    cut in between (a checkpoint) is one too. What Python functions and generators return comes from all that they are
    given."""
    staged = [(s._jdf.queryExecution().analyzed(), len(s.columns)) for s in sources]
    known: dict[int, frozenset[str]] = {}
    shared: dict[int, list] = {}
    conditions: set[str] = set()
    none: frozenset[str] = frozenset()

    def of(e) -> frozenset[str]:
        names = [known.get(_id(a), frozenset([a.name()])) for a in _seq(e.references())]
        if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            names += [known.get(_id(a), none) for a in _seq(e.plan().output())]
        for c in _seq(e.children()):
            if _kind(c) != "AttributeReference":
                names.append(of(c))
        return reduce(frozenset.union, names, none)

    def visit(node) -> None:
        if any(node.output().size() == n and node.sameResult(plan) for plan, n in staged):
            known.update((_id(a), frozenset([a.name()])) for a in _seq(node.output()))
            return
        children = list(_seq(node.children()))
        if _kind(node) == "WithCTE":  # the definitions before what refers to them
            for d in _seq(node.cteDefs()):
                visit(d)
                shared[d.id()] = list(_seq(d.output()))
            children = [node.plan()]
        for c in [*children, *_seq(node.innerChildren())]:
            visit(c)
        expressions = list(_seq(node.expressions()))
        for e in expressions:
            for a in _aliases(e):
                known[_id(a)] = of(a.child()) | {a.name()}
        if _kind(node) in ("Filter", "Join", "AsOfJoin"):
            for e in expressions:
                conditions.update(of(e))
        below = [list(_seq(c.output())) for c in children]
        for i, a in enumerate(_seq(node.output())):
            if _kind(node) in ("Union", "Intersect", "Except"):  # by place, under the first one's attributes
                known[_id(a)] = reduce(frozenset.union, (known.get(_id(x[i]), none) for x in below), frozenset([a.name()]))
            elif _id(a) in known:
                continue
            elif _kind(node) == "CTERelationRef" and node.cteId() in shared:
                known[_id(a)] = known.get(_id(shared[node.cteId()][i]), none) | {a.name()}
            elif not children:
                known[_id(a)] = frozenset([a.name()])
            else:
                read = [of(e) for e in expressions] or [known.get(_id(x), none) for c in below for x in c]
                known[_id(a)] = reduce(frozenset.union, read, frozenset([a.name()]))

    plan = df._jdf.queryExecution().analyzed()
    visit(plan)
    return {a.name(): known[_id(a)] for a in _seq(plan.output())}, frozenset(conditions)


def layering(models: Mapping[str, DataFrame], staging: Sequence[str], forbidden: Sequence[str] = ("product_id",)) -> list[tuple[str, str, str]]:
    """(model, column, source's name): columns below staging whose values come from a source's own id, under whatever name
    and however changed; the column is null where a filter or a join reads it."""
    out = []
    for name, df in models.items():
        if name in staging:
            continue
        columns, conditions = lineage(df, [models[s] for s in staging])
        out += [(name, c, x) for c, names in columns.items() for x in forbidden if x in names]
        out += [(name, None, x) for x in forbidden if x in conditions]
    return out
