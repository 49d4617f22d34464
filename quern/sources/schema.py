"""Source schemas, stated and asserted before anything else is read from a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


PRODUCT = T.StructType(_strings("id concatted vendor product_name units brand detail_url sku upc"))
_REST = _strings("current_price old_price price_per_unit other product_id")
#: By version of the price table: dates as text, and as YYYYMMDD numbers.
PRICES = {1: T.StructType([T.StructField("nowtime", T.StringType()), *_REST]), 2: T.StructType([T.StructField("nowtime", T.LongType()), *_REST])}
PROVENANCE = T.StructType(_strings("k v"))


@dataclass(frozen=True)
class Problem:
    table: str
    kind: str
    column: str
    detail: str


def differences(table: str, found: T.StructType | None, wanted: T.StructType, strict_position: bool = False) -> list[Problem]:
    """Every way in which a table's schema isn't the wanted one; an empty list is a pass."""
    if found is None:
        return [Problem(table, "TABLE MISSING", "", "")]
    have = {f.name: (i, f.dataType) for i, f in enumerate(found.fields)}
    out = []
    for i, f in enumerate(wanted.fields):
        if f.name not in have:
            out.append(Problem(table, "MISSING", f.name, f.dataType.simpleString()))
        elif have[f.name][1] != f.dataType:
            out.append(Problem(table, "TYPE MISMATCH", f.name, f"{have[f.name][1].simpleString()} for {f.dataType.simpleString()}"))
        elif strict_position and have[f.name][0] != i:
            out.append(Problem(table, "POSITION DRIFT", f.name, f"{have[f.name][0]} for {i}"))
    return out + [Problem(table, "UNEXPECTED", n, t.simpleString()) for n, (_, t) in have.items() if n not in wanted.names]


def assert_schema(table: str, df: DataFrame | None, wanted: T.StructType, strict_position: bool = False) -> None:
    if found := differences(table, df.schema if df is not None else None, wanted, strict_position):
        raise ValueError("; ".join(f"{p.table}.{p.column}: {p.kind} {p.detail}".strip() for p in found))
