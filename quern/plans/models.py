"""The three models: parsed prices, parsed products, and barcode matches with the weakest participant's tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import catalogue as C
from quern.functions.prices import parse_prices
from quern.functions.units import parse_units

#: A table up to this size, in rows and in bytes, is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows of ``limit_bytes`` in all: texts by their length, other
    columns at eight bytes. Both are measured here; ``rows`` spares that where the caller knows it to be too many."""
    if rows is not None and rows > limit:
        return df
    texts = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if f.dataType.simpleString() in ("string", "binary") or "<" in f.dataType.simpleString()]
    width = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(8 * len(df.columns)))
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()  # total: any rows will do: they are counted
    return F.broadcast(df) if n <= limit and size <= limit_bytes else df


def stg_price(prices: DataFrame, products: DataFrame, version: int = 2, product_rows: int | None = None) -> DataFrame:
    """One row for each price row (which carries src_rowid): both prices parsed, orphans kept with a null key.

    version: 2 for YYYYMMDD numbers, 1 for dates as text. With a broadcast product table the whole model is map-only.
    """
    p = products.select(F.col("id").alias("__id"), F.col("vendor").alias("__vendor"), C.product_key(F.col("vendor"), F.col("sku"), F.col("concatted")).alias("product_key"))
    rows = prices.join(sized(p, product_rows), F.col("product_id") == F.col("__id"), "left")
    rows = parse_prices(rows, {"": "current_price", "old_": "old_price"}, vendor="__vendor")
    day = C.decoded_date(F.col("nowtime")) if version == 2 else C.decoded_date_text(F.col("nowtime"))
    return rows.select(
        "src_rowid", "product_key", "product_id", F.col("nowtime").alias("nowtime_raw"), day.alias("observed_date"), F.col("current_price").alias("current_price_raw"),
        "offer_type", "unit_price", "min_qty", "price_basis", "price_basis_stated", "normalization", "parse_confidence", F.col("old_price").alias("old_price_raw"),
        "old_offer_type", "old_unit_price", "old_price_basis", "old_price_basis_stated", "old_normalization", "old_parse_confidence",
        F.col("price_per_unit").alias("price_per_unit_raw"), F.col("other").alias("other_raw"),
    )


def stg_product(products: DataFrame) -> DataFrame:
    """One row for each product: key, parsed size, brand class, barcode tier."""
    p = parse_units(products, "units")
    brand = C.brand_class(F.col("vendor"), F.col("brand"))
    return p.select(
        C.product_key(F.col("vendor"), F.col("sku"), F.col("concatted")).alias("product_key"), C.product_key_basis(F.col("sku")).alias("product_key_basis"),
        F.col("id").alias("product_id"), "vendor", "sku", F.col("upc").alias("upc_raw"), "product_name", "detail_url", "concatted", F.col("units").alias("units_raw"),
        "unit_qty", "unit_uom", "pack_count", "total_qty", "unit_parse_confidence", F.col("brand").alias("brand_raw"), brand.alias("brand_class"),
        C.coarse(brand).alias("brand_class_coarse"), C.barcode_tier(F.col("vendor")).alias("upc_tier"),
    )


def barcode_span(products: DataFrame, key: str = "gtin14", vendor: str = "vendor", tier: str = "vendor_upc_tier") -> DataFrame:
    """For each barcode: how many vendors carry it, by tier, and their names in order.

    Aggregated twice, by barcode and vendor first, so that no distinct count needs its rows expanded.
    """
    each = products.where(F.col(key).isNotNull()).groupBy(key, vendor).agg(F.max(tier).alias("__t"))
    n = lambda t: F.sum((F.col("__t") == t).cast("long"))
    return each.groupBy(key).agg(
        F.count(vendor).alias("n_vendors"), n("vendor_upc").alias("n_vendor_upc"), n("matched_upc").alias("n_matched_upc"), n("fuzzy").alias("n_fuzzy"),
        F.array_join(F.array_sort(F.collect_list(vendor)), ",").alias("vendors_on_gtin"),  # total: sorted
    )


def int_upc_match(products: DataFrame) -> DataFrame:
    """One row for each product: its barcode's participants, and the match tier of the weakest of them."""
    digits = C.barcode_digits(F.col("upc_raw"))
    keyed = products.select("product_key", "vendor", "upc_raw", C.gtin14(digits).alias("gtin14"), F.length(digits).between(4, 5).alias("__short"), C.barcode_tier(F.col("vendor")).alias("vendor_upc_tier"))
    span = barcode_span(keyed)
    both = keyed.join(span, "gtin14", "left")
    many, loose = F.coalesce("n_vendors", F.lit(0)), F.coalesce("n_fuzzy", F.lit(0))
    tier = (
        F.when(F.col("gtin14").isNull(), F.when(F.col("__short"), "plu_short").otherwise("no_upc")).when(many < 2, "unmatched")
        .when(loose > 0, "fuzzy").when(F.col("n_matched_upc") > 0, "matched_upc").otherwise("vendor_upc")
    )
    return both.select(
        "product_key", "vendor", "gtin14", "upc_raw", "vendor_upc_tier", many.cast("long").alias("n_vendors_on_gtin"), loose.cast("long").alias("n_fuzzy_vendors_on_gtin"),
        "vendors_on_gtin", tier.alias("match_tier"), (F.col("gtin14").isNotNull() & (many >= 2) & (loose == 0)).alias("is_reliable_only"),
    )
