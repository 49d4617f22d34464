import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import catalogue as C
from quern.functions import text
from quern.functions.prices import parse_prices
from quern.functions.units import JUNK, SPELLINGS, display_size, folded_class, folded_quantity, parse_units, stated_unit_price

def price_cases():
    """(text, offer, price, least quantity, basis, repair): each spelling with numbers drawn at random, and odd ones."""
    rng = random.Random(17)
    out = []
    for _ in range(6):
        n, d, c = rng.randrange(2, 9), rng.randrange(1, 80), rng.randrange(100)
        amount, cents, grams = float(f"{d}.{c:02}"), 100 * d + c, 25 * rng.randrange(1, 60)
        pad = rng.choice(["", " ", "   "])
        out += [
            (f"{pad}{d}.{c:02}{pad}", "scalar", amount, 1.0, "each", "none"), (f"{d}", "scalar", float(d), 1.0, "each", "none"),
            (f"{d},{cents % 1000:03}.{c:02}", "scalar", 1000.0 * d + cents % 1000 + c / 100, 1.0, "each", "thousands_sep"),
            (f"{d},{cents % 1000:03},{c:03}", "scalar", 1e6 * d + 1000.0 * (cents % 1000) + c, 1.0, "each", "thousands_sep"),
            (f"{cents}$", "scalar", amount, 1.0, "each", "cents_div100"), (f"NOW${cents}", "scalar", amount, 1.0, "each", "now_prefix_cents_div100"), (f"{c + 1}¢", "scalar", (c + 1) / 100, 1.0, "each", "cent_symbol_div100"),
            (f"{n} / ${d}.{c:02}", "multibuy", amount / n, float(n), "each", "none"), (f"{n}/${d}", "multibuy", d / n, float(n), "each", "none"),
            (f"{d}.{c:02}/{grams}G", "per_weight", amount * 100 / grams, 1.0, "per_100g", "none" if grams == 100 else "basis_rescaled"), (f"{d}.{c:02} / {grams}ml", "per_weight", amount * 100 / grams, 1.0, "per_100ml", "none" if grams == 100 else "basis_rescaled"),
            (f"{d}.{c:02}/l", "per_weight", amount / 10, 1.0, "per_100ml", "basis_rescaled"), (f"{d}.{c:02} avg/kg", "per_weight", amount / 10, 1.0, "per_100g", "basis_rescaled"),
            (f"{d}.{c:02}/lb.", "per_weight", amount * 100 / 453.592, 1.0, "per_100g", "basis_rescaled"), (f"{d}.{c:02}avg.oz", "per_weight", amount * 100 / 28.3495, 1.0, "per_100g", "basis_rescaled"),
            (f"{d}.{c:02}/kg{n}.{c:02}/lb.", "per_weight", amount / 10, 1.0, "per_100g", "basis_rescaled"), (f"{d}.{c:02}/{rng.choice(['ea', 'each', 'item', 'un'])}", "per_weight", amount, 1.0, "each", "none"),
            (rng.choice(["sold out", "price on request", "from the deli"]), "unparsed", None, 1.0, None, None), (f"{d}.{c:02}/strip", "unparsed", None, 1.0, None, None), (rng.choice(["", "  ", None]), "blank", None, None, None, None),
        ]
    # what a cast would read and a price isn't, ends of lines, and what can't be divided
    out += [("7d", "unparsed", None, 1.0, None, None), ("4.25F", "unparsed", None, 1.0, None, None), ("0xAp1", "unparsed", None, 1.0, None, None), ("20_00", "unparsed", None, 1.0, None, None), ("415$\n", "unparsed", None, 1.0, None, None)]
    return out + [("6.05\n", "scalar", 6.05, 1.0, "each", "none"), ("2E2", "scalar", 200.0, 1.0, "each", "none"), ("0/$8", "multibuy", None, 0.0, "each", "none"), ("5/0g", "per_weight", None, 1.0, "per_100g", "basis_rescaled")]


PRICES = price_cases()


def same(a, b, places=4):
    return a is b is None or a is not None and b is not None and (a == b or isinstance(a, float) and math.isclose(a, b, abs_tol=0.5 * 10**-places))


def test_price_cases(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i int, x string")
    got = {r.i: r for r in parse_prices(df, {"": "x"}).collect()}
    for i, want in enumerate(PRICES):
        r = got[i]
        for a, b in zip((r.offer_type, r.unit_price, r.min_qty, r.price_basis, r.normalization), want[1:]):
            assert same(a, b), (want, r)


def test_vendor_cases(spark):
    rows = [("Walmart", "298", 2.98, "derived"), ("Walmart", "45", 45.0, "ambiguous"), ("Walmart", "5", 5.0, "exact"), ("Galleria", "12", 12.0, "ambiguous"), ("Voila", "1,926.25", 1926.25, "ambiguous"), (None, "298", 298.0, "exact"), ("Metro", "3.69/100g", 3.69, "inferred"), ("Metro", "was", None, "none"), ("Metro", "2/$3", 1.5, "derived")]
    got = parse_prices(spark.createDataFrame([r[:2] for r in rows], "v string, x string"), {"old_": "x"}, vendor="v").collect()
    for r, want in zip(got, rows):
        assert same(r.old_unit_price, want[2]) and r.old_parse_confidence == want[3], (r, want)


def unit_cases():
    """(text, quantity, unit, pack, total, confidence): every spelling of every unit with numbers drawn at random."""
    rng = random.Random(23)
    scale = {"kg": ("g", 1000.0), "g": ("g", 1.0), "lb": ("g", 453.592), "oz": ("g", 28.3495), "l": ("ml", 1000.0), "ml": ("ml", 1.0), "fl oz": ("ml", 29.5735)}
    out = []
    for unit, (uom, factor) in scale.items():
        for word in SPELLINGS[unit]:
            n, k, gap = rng.randrange(1, 900), rng.randrange(2, 30), rng.choice(["", " "])
            size, word = n / rng.choice([1, 10]), rng.choice([str.lower, str.upper, str.title])(word)
            out += [(f"{size}{gap}{word}", size * factor, uom, 1.0, size * factor, "exact"), (f"{k}{gap}x{gap}{n}{gap}{word}", n * factor, uom, float(k), k * n * factor, "derived"), (f"{n}{word}*{k}", n * factor, uom, float(k), k * n * factor, "derived")]
    for word in SPELLINGS["count"]:
        n = rng.randrange(2, 50)
        out.append((f"{n} {word}", 1.0, "count", float(n), float(n), "exact"))
    for word in ("pack", "tray", "bunch", "bag", "box", "case"):
        n = rng.randrange(2, 50)
        out.append((f"{n} PER {word}", 1.0, "count", float(n), float(n), "inferred"))
    out += [(x, None, None, None, None, "none") for x in (*JUNK, " N/A ", None)]
    return out + [("sliced to order", None, None, 1.0, None, "none"), ("75gé", 75.0, "g", 1.0, 75.0, "exact"), ("3\u00a0kg", 3000.0, "g", 1.0, 3000.0, "exact"), ("75grand", None, None, 1.0, None, "none")]


UNITS = unit_cases()


def test_unit_cases(spark):
    got = parse_units(spark.createDataFrame([(u[0],) for u in UNITS], "x string"), "x").collect()
    for r, want in zip(got, UNITS):
        for a, b in zip((r.unit_qty, r.unit_uom, r.pack_count, r.total_qty, r.unit_parse_confidence), want[1:]):
            assert same(a, b, 1), (want, r)


def test_other_unit_readings(spark):
    df = spark.createDataFrame([("3 x 400 mL", "$2.00/100g"), ("6 bunch", "1.5 / kg."), ("6 ea", "x")], "u string, p string")
    got = df.select(folded_quantity(F.col("u")).alias("q"), folded_class(F.col("u")).alias("c"), *[c.alias(n) for n, c in stated_unit_price(F.col("p")).items()]).collect()
    assert [tuple(r) for r in got] == [(1200.0, "volume_ml", 2.0, 100.0, "g"), (6.0, "count", 1.5, 1.0, "kg"), (6.0, "count", None, 1.0, "")]
    sizes = parse_units(spark.createDataFrame([("3 x 400 mL",), ("1.25kg",), ("6 per pack",)], "x string"), "x").select(display_size(F.col("unit_qty"), F.col("unit_uom"), F.col("pack_count"), F.col("unit_parse_confidence"))).collect()
    assert [r[0] for r in sizes] == ["3 x 400 ml", "1250 g", ""]
    assert spark.range(1).select(text.size_in_name(F.lit("Soup Tin 540 mL "))).first()[0] == "540 ml"


def test_catalogue_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(C.product_key(lit("Metro"), lit(" 12 "), lit("x"))) == __import__("hashlib").md5(b"Metro\x1f12").hexdigest()
    assert one(C.product_key(lit("Voila"), lit(" "), lit("a~b"))) == __import__("hashlib").md5("Voila\x1f#c:a~b".encode()).hexdigest()
    assert one(C.product_key(lit(None).cast("string"), lit("1"), lit("x"))) is None
    assert [one(C.gtin14(C.barcode_digits(lit(x)))) for x in ("0-12345-67890-5", "000000000000", "4011", "123456789", None)] == ["00012345678905", None, None, None, None]
    assert [one(C.brand_class(lit(v), lit(b))) for v, b in (("Metro", "Selection "), ("Metro", "n/a"), ("Metro", " "), ("Voila", "PC"), ("Metro", "Heinz"), ("Loblaws", "zenshi"))] == ["private_label", "unclassifiable_junk", "unclassifiable_blank", "unclassifiable_no_vendor_data", "national_brand", "private_label"]
    assert one(C.coarse(lit("unclassifiable_junk"))) == "unclassifiable"
    assert [one(C.category(lit(x))) for x in ("Egg Bun", "Veggie", "Iced TEA", "soap")] == ["a. bread & bakery", "c. eggs", "g. beverages", "h. other"]
    assert [one(C.category(lit("Veggie pizza"), egg_as_word=True)), one(C.category(lit("Pizza"), wide=True))] == ["h. other", "h. frozen"]
    assert [one(C.says_sale(lit(x))) for x in ("On SALE", "Out of stock", "2 for $5", "", "In stock")] == [True, False, True, False, False]
    assert one(text.shape(lit("2 for\r\n$5.00  Ea"))) == "N a<a>$N.N a"
    assert [one(C.id_shape(lit(x))) for x in ("abc=", "Metro12", "Metro1a2", "a-b", "1!")] == ["base64-style (opaque, no sku)", "vendor + numeric sku", "vendor + alnum sku", "contains hyphens (URL-slug shaped)", "other"]
    assert tuple(spark.range(1).select(*C.listing_parts(lit("Metro~Milk @ home@1 L^PC")).values()).first()) == ("Metro", "Milk @ home", "PC")
    assert one(C.vendor_in_id(lit("SaveOnFoods99"))) == "SaveOnFoods" and one(C.shown_brand(lit("You save$0.53"))) == "" and one(C.chain_label(lit("SaveOnFoods"))) == "Save-On-Foods"
    assert tuple(spark.range(1).select(*C.store_in_url(lit("https://x/sm/pickup/rsid/2217/p")).values()).first()) == ("2217", "pickup")


@pytest.mark.parametrize(("n", "want"), [(20261104, "2026-11-04"), (20240229, "2024-02-29"), (20230229, None), (2202, None), (20222602, None), (None, None)])
def test_dates(spark, n, want):
    got = spark.range(1).select(C.decoded_date(F.lit(n).cast("long")), C.decoded_date_text(F.lit("2024-02-29 00:00:00")), C.decoded_date_text(F.lit("2024"))).first()
    assert (str(got[0]) if got[0] else None) == want and str(got[1]) == "2024-02-29" and got[2] is None


def test_two_decimals_round_as_c_does(spark):
    rng = random.Random(3)
    values = [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.random() * 10 ** rng.randrange(1, 9) for _ in range(2000)] + [0.0, 0.125, 0.375, 2.5, 0.005, 1478.675, 1.005, 99.995, 1e9 + 0.125, 453.592 * 5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.two_decimals(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in values]
