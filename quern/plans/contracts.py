"""Data-quality contracts: every test is a table of violations, and an empty one is a pass."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import FIRST_DAY
from quern.functions.catalogue import VENDORS, is_junk_brand
from quern.operators.audit import row_hash

OFFERS = ("scalar", "multibuy", "per_weight", "unparsed", "blank")
BASES = ("each", "per_100g", "per_100ml")
CONFIDENCES = ("exact", "derived", "inferred", "ambiguous", "none")
UOMS = ("g", "ml", "count")
KEY_BASES = ("vendor_sku", "vendor_concatted")
BRAND_CLASSES = ("private_label", "national_brand", "unclassifiable_no_vendor_data", "unclassifiable_blank", "unclassifiable_junk")
BARCODE_TIERS = ("vendor_upc", "matched_upc", "fuzzy")
MATCH_TIERS = (*BARCODE_TIERS, "unmatched", "no_upc", "plu_short")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """(column, n): values that come more than once; nulls are not_null's business."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def related(df: DataFrame, column: str, to: DataFrame, to_column: str) -> DataFrame:
    """Rows whose value isn't in the other table; null values are allowed."""
    return df.where(F.col(column).isNotNull()).join(to.select(F.col(to_column).alias(column)).distinct(), column, "left_anti")


def dates_within(df: DataFrame, column: str, snapshot_id: str | None, first=FIRST_DAY) -> DataFrame:
    """Dates outside first day .. day of the snapshot ('YYYYMMDD...'); without a readable bound every row is a violation."""
    if not snapshot_id or not re.match(r"^\d{8}", snapshot_id):
        return df
    last = F.to_date(F.lit(snapshot_id[:8]), "yyyyMMdd")
    return df.where((F.col(column) < F.lit(first)) | (F.col(column) > last))


def same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rows_in, rows_out): one row if the tables' sizes differ."""
    n = a.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("k", F.lit(1)).join(b.agg(F.count(F.lit(1)).alias("rows_out")).withColumn("k", F.lit(1)), "k")
    return n.drop("k").where("rows_in <> rows_out")


def pinned_nulls(df: DataFrame, raw: str, decoded: str, pinned: dict[int, int], filtered: bool = False) -> DataFrame:
    """(value, n, expected): raw values without a decoded date, where they or their counts aren't the committed ones.
    A filtered load may have fewer of them, never more or others."""
    found = df.where(F.col(decoded).isNull()).groupBy(F.col(raw).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    want = df.sparkSession.createDataFrame([(v, n) for v, n in sorted(pinned.items())], "value long, expected long")
    both = found.join(want, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("n > expected" if filtered else "n <> expected")


def price_contracts(price: DataFrame, raw: DataFrame, product: DataFrame, snapshot_id: str | None, pinned: dict[int, int], filtered: bool = False) -> dict[str, DataFrame]:
    c = F.col
    return {
        "price.rowid.unique": unique(price, "src_rowid"), "price.rowid.not_null": not_null(price, "src_rowid"),
        "price.key.related": related(price, "product_key", product, "product_key"),
        "price.date.window": dates_within(price, "observed_date", snapshot_id),
        "price.offer.not_null": not_null(price, "offer_type"), "price.offer.accepted": accepted(price, "offer_type", OFFERS),
        "price.basis.accepted": accepted(price, "price_basis", BASES),
        "price.confidence.not_null": not_null(price, "parse_confidence"), "price.confidence.accepted": accepted(price, "parse_confidence", CONFIDENCES),
        "price.old_offer.not_null": not_null(price, "old_offer_type"), "price.old_offer.accepted": accepted(price, "old_offer_type", OFFERS),
        "price.rows": same_count(raw, price),
        "price.parsed": price.where(c("unit_price").isNull() & ~c("offer_type").isin("unparsed", "blank")),
        "price.multibuy": price.where((c("offer_type") == "multibuy") & (c("min_qty") > 1) & (F.abs(c("unit_price") - F.regexp_extract("current_price_raw", r"\$([0-9.]+)", 1).try_cast("double")) < 0.001)),
        "price.cents": price.where(c("normalization").isin("cents_div100", "now_prefix_cents_div100", "cent_symbol_div100") & (c("unit_price") > 100)),
        "price.null_dates": pinned_nulls(price, "nowtime_raw", "observed_date", pinned, filtered),
    }


def product_contracts(product: DataFrame, source: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    return {
        "product.key.unique": unique(product, "product_key"), "product.key.not_null": not_null(product, "product_key"),
        "product.key_basis.not_null": not_null(product, "product_key_basis"), "product.key_basis.accepted": accepted(product, "product_key_basis", KEY_BASES),
        "product.vendor.not_null": not_null(product, "vendor"), "product.vendor.accepted": accepted(product, "vendor", VENDORS),
        "product.uom.accepted": accepted(product, "unit_uom", UOMS),
        "product.unit_confidence.not_null": not_null(product, "unit_parse_confidence"), "product.unit_confidence.accepted": accepted(product, "unit_parse_confidence", CONFIDENCES),
        "product.brand.not_null": not_null(product, "brand_class"), "product.brand.accepted": accepted(product, "brand_class", BRAND_CLASSES),
        "product.tier.not_null": not_null(product, "upc_tier"), "product.tier.accepted": accepted(product, "upc_tier", BARCODE_TIERS),
        "product.rows": same_count(source, product),
        "product.junk_brand": product.where((c("brand_class") == "national_brand") & (is_junk_brand(c("brand_raw")) | (F.trim(F.coalesce(c("brand_raw"), F.lit(""))) == ""))),
    }


def match_contracts(match: DataFrame, product: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    return {
        "match.key.unique": unique(match, "product_key"), "match.key.not_null": not_null(match, "product_key"), "match.key.related": related(match, "product_key", product, "product_key"),
        "match.tier.not_null": not_null(match, "match_tier"), "match.tier.accepted": accepted(match, "match_tier", MATCH_TIERS),
        "match.vendor_tier.not_null": not_null(match, "vendor_upc_tier"), "match.vendor_tier.accepted": accepted(match, "vendor_upc_tier", BARCODE_TIERS),
        "match.reliable.not_null": not_null(match, "is_reliable_only"), "match.rows": same_count(product, match),
        "match.weakest": match.where((c("n_fuzzy_vendors_on_gtin") > 0) & (c("n_vendors_on_gtin") >= 2) & (c("match_tier") != "fuzzy")),
        "match.reliable": match.where(c("is_reliable_only") & ((c("n_fuzzy_vendors_on_gtin") > 0) | (c("n_vendors_on_gtin") < 2))),
    }


def failures(tests: dict[str, DataFrame]) -> list[str]:
    """The names of the tests that have a violation; each stops at its first."""
    return [name for name, v in tests.items() if v.limit(1).count()]  # total: any row will do: it is counted


def checksums(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, object]:
    """An order-independent checksum of each column, in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(row_hash([c])).alias(c) for c in columns]).first()  # total: an aggregate is one row
    return row.asDict()


def cache_differences(cached: DataFrame, defined: DataFrame) -> list[str]:
    """Columns in which a stored model isn't what its definition gives now."""
    a, b = checksums(cached), checksums(defined, cached.columns)
    return [k for k in a if a[k] != b[k]]


def twice(build: Callable[[], DataFrame], settings: Sequence[dict[str, str]] = ({}, {"spark.sql.shuffle.partitions": "7"})) -> str:
    """'same', 'different', or 'failed': a query run once under each group of settings, its rows compared as a bag."""
    seen = []
    for extra in settings:
        try:
            df = build()
            conf = df.sparkSession.conf
            old = {k: conf.get(k) for k in extra}
            for k, v in extra.items():
                conf.set(k, v)
            try:
                df = build()
                seen.append((df.schema.simpleString(), tuple(sorted(checksums(df).items())), df.agg(F.sum(row_hash(df.columns))).first()[0]))  # total: an aggregate is one row
            finally:
                for k, v in old.items():
                    conf.set(k, v)
        except Exception:
            seen.append("failed")
    return "failed" if "failed" in seen else "same" if all(x == seen[0] for x in seen) else "different"


#: Calls whose result depends on row order unless an order is total; each use needs a '# total:' remark with its reason.
_LOOSE = {"first", "last", "any_value", "max_by", "min_by", "collect_list", "collect_set", "row_number", "rank", "ntile", "limit", "mode"}


def loose_calls(path: str) -> list[tuple[int, str]]:
    """(line, name) of order-dependent calls in a Python source that no '# total:' remark on or above the line explains."""
    text = Path(path).read_text(encoding="utf-8")
    lines = text.splitlines()
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in _LOOSE:
            near = lines[max(0, node.lineno - 3) : node.end_lineno]
            if not any("# total:" in x for x in near):
                out.append((node.lineno, node.func.attr))
    return sorted(out)


def loose_sql(text: str) -> list[tuple[int, str]]:
    """(line, what) of order-dependent SQL: arbitrary picks, ranks and limits without ORDER BY, unordered lists."""
    out = []
    rules = [("any_value or first", r"\b(any_value|first|last|arg_max|arg_min|max_by|min_by)\s*\("), ("unordered list", r"\b(list|string_agg|array_agg|collect_list|listagg)\s*\((?![^()]*(?:\([^()]*\)[^()]*)*order\s+by)"), ("rank without order", r"\b(row_number|rank|dense_rank|ntile)\s*\([^)]*\)\s*over\s*\((?![^()]*order\s+by)"), ("limit without order", r"\blimit\s+[1-9]"), ("distinct on", r"\bdistinct\s+on\b")]
    for i, line in enumerate(text.splitlines(), 1):
        code = line.split("--")[0]
        for what, pattern in rules:
            if re.search(pattern, code, re.I) and not (what == "limit without order" and re.search(r"order\s+by", "\n".join(text.splitlines()[max(0, i - 8) : i]), re.I)) and "determinism-ok:" not in line and "-- total:" not in line:
                out.append((i, what))
    return out


def layering(models: dict[str, DataFrame], staging: Sequence[str], forbidden: Sequence[str] = ("product_id",)) -> list[str]:
    """Models below staging that still carry a source's own id."""
    return [f"{n}.{c}" for n, df in models.items() if n not in staging for c in df.columns if c in forbidden]


def schema_of(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


def breaks(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows unchanged; the query that reads them fails if the condition holds for any."""
    guard = F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return rows.where(guard)
