"""Product keys, barcodes, brands, categories and id shapes: expressions over catalogue text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import captured

#: Vendors by how far their barcodes can be trusted, and those without brands.
OWN_BARCODES = ("Metro", "Galleria", "SaveOnFoods")
MATCHED_BARCODES = ("Walmart",)
WITHOUT_BRANDS = ("TandT", "Galleria", "Voila")
VENDORS = ("Metro", "Walmart", "Loblaws", "NoFrills", "TandT", "Voila", "Galleria", "SaveOnFoods")
CHAIN_LABELS = {"SaveOnFoods": "Save-On-Foods"}

#: Brand texts that name no brand (later and earlier list).
JUNK_BRANDS = ("out of stock", "out of stock.", "unbranded", "n/a", "na", "none", "null", "error", "-", "--", ".", "..", "?", "unknown")
JUNK_BRANDS_V0 = ("out of stock", "out of stock.", "unbranded", "n/a", "na", "none", "error", "null", "-", ".", "--")

#: Store brands by vendor (upper case), first those of both lists, then those that only the later one has.
STORE_BRANDS_V0 = {
    "Metro": ("SELECTION", "SELECTION BIO", "IRRÉSISTIBLE", "IRRESISTIBLE", "IRRÉSISTIBLES", "IRRESISTIBLES", "LIFE SMART", "FRONT STREET BAKERY", "METROGO!", "METRO", "ECONOMAX", "PREMIÈRE MOISSON", "PREMIERE MOISSON"),
    "Loblaws": ("PRESIDENT'S CHOICE", "PC", "PC ORGANICS", "PC BLUE MENU", "PC BLACK LABEL", "NO NAME", "FARMER'S MARKET", "JOE FRESH", "LIFE BRAND", "EVERYDAY ESSENTIALS"),
    "NoFrills": ("PRESIDENT'S CHOICE", "PC", "PC ORGANICS", "PC BLUE MENU", "PC BLACK LABEL", "NO NAME", "FARMER'S MARKET", "JOE FRESH", "EVERYDAY ESSENTIALS"),
    "Walmart": ("GREAT VALUE", "YOUR FRESH MARKET", "OUR FINEST", "EQUATE", "MARKETSIDE", "PARENT'S CHOICE", "MAINSTAYS", "ATHLETIC WORKS", "GEORGE", "SAM'S CHOICE"),
    "SaveOnFoods": ("WESTERN FAMILY", "SAVE-ON-FOODS", "BAKE SHOP", "ONLY GOODNESS", "BIG PACIFIC", "BLUSH LANE"),
    "Voila": ("COMPLIMENTS", "COMPLIMENTS BALANCE", "PANACHE", "SENSATIONS", "SIGNAL", "BIG 8", "OUR FINEST"),
}
STORE_BRANDS_ADDED = {"Metro": ("PLATINUM GRILL",), "Loblaws": ("FROM OUR CHEFS", "ZENSHI"), "SaveOnFoods": ("WESTERN CANADIAN", "REDLAND FARMS", "DELI FRESH")}
STORE_BRANDS = {v: names + STORE_BRANDS_ADDED.get(v, ()) for v, names in STORE_BRANDS_V0.items()}

#: Categories by keyword, the first that fits.
CATEGORIES = [
    ("a. bread & bakery", "bread|bagel|bun|tortilla|pita"),
    ("b. dairy", "milk|cream|yogur|yoghur|cheese|butter|margarine"),
    ("c. eggs", "egg"),
    ("d. produce", "apple|banana|orange|potato|onion|carrot|tomato|lettuce|berry|berries|grape|pepper|broccoli|cucumber"),
    ("e. meat & fish", "chicken|beef|pork|turkey|bacon|ham|sausage|fish|salmon|tuna|shrimp"),
    ("f. pantry staples", "rice|pasta|flour|sugar|cereal|oat|noodle"),
    ("g. beverages", "juice|coffee|tea|soda|water|cola|drink"),
]
CATEGORIES_WIDE = {"a. bread & bakery": "croissant", "d. produce": "salad", "f. pantry staples": "soup|sauce", "g. beverages": "beverage"}
FROZEN = ("h. frozen", "frozen|pizza|ice cream")
SALE_WORDS = r"sale|rollback|clearance|deal|save|special|reduced|[0-9]+ *for *\$|was |price *drop"
STOCK_WORDS = r"^(?:out of stock|low stock|in stock)\z"
PROMOTION = r"[$][0-9]|you save|current price"
#: How a listing text vendor~name@units^brand is written, the shapes of product ids and their names, and
#: where a shop's url has its store.
LISTING = "%~%@%^%"
LISTING_PARTS = {"vendor": r"^([^~]+)~", "name": r"^[^~]+~(.*)@", "brand": r"\^(.*)$"}
ID_SHAPES = [
    ("base64-style (opaque, no sku)", r"=\z"), ("vendor + numeric sku", r"^[A-Za-z]+[0-9]+\z"), ("vendor + alnum sku", r"^[A-Za-z]+[A-Za-z0-9]+\z"),
    ("contains hyphens (URL-slug shaped)", "-"),
]
STORE_IN_URL = {"rsid": r"/rsid/([0-9]+)/", "channel": r"/sm/([a-z]+)/rsid/"}


def _filled(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x) != "")


def key_source(vendor: Column, sku: Column, listing: Column) -> Column:
    """What names a product: its vendor and sku, or the listing text where it has no sku; null without a vendor."""
    return F.concat(vendor, F.lit("\x1f"), F.when(_filled(sku), F.trim(sku)).otherwise(F.concat(F.lit("#c:"), F.coalesce(listing, F.lit("")))))


def product_key(vendor: Column, sku: Column, listing: Column) -> Column:
    return F.md5(key_source(vendor, sku, listing).cast("binary"))


def product_key_basis(sku: Column) -> Column:
    return F.when(_filled(sku), "vendor_sku").otherwise("vendor_concatted")


def barcode_digits(upc: Column) -> Column:
    return F.regexp_replace(F.coalesce(upc, F.lit("")), "[^0-9]", "")


def gtin14(digits: Column) -> Column:
    """11 to 14 digits, not all zero, padded to 14; else null."""
    return F.when(F.length(digits).between(11, 14) & ~digits.rlike(r"^0+\z"), F.lpad(digits, 14, "0"))


def barcode_tier(vendor: Column) -> Column:
    return F.when(vendor.isin(*OWN_BARCODES), "vendor_upc").when(vendor.isin(*MATCHED_BARCODES), "matched_upc").otherwise("fuzzy")


def brand_name(brand: Column) -> Column:
    return F.upper(F.trim(F.coalesce(brand, F.lit(""))))


def is_store_brand(vendor: Column, brand: Column, lists: dict = STORE_BRANDS) -> Column:
    out = None
    for v, names in lists.items():
        out = (F if out is None else out).when(vendor == v, brand_name(brand).isin(*names))
    return out.otherwise(F.lit(False))


def is_junk_brand(brand: Column, names=JUNK_BRANDS) -> Column:
    return F.lower(F.trim(F.coalesce(brand, F.lit("")))).isin(*names)


def brand_class(vendor: Column, brand: Column) -> Column:
    return (
        F.when(vendor.isin(*WITHOUT_BRANDS), "unclassifiable_no_vendor_data").when(brand_name(brand) == "", "unclassifiable_blank")
        .when(is_junk_brand(brand), "unclassifiable_junk").when(is_store_brand(vendor, brand), "private_label").otherwise("national_brand")
    )


def coarse(brand_class: Column) -> Column:
    return F.when(brand_class.startswith("unclassifiable"), "unclassifiable").otherwise(brand_class)


def category(name: Column, wide: bool = False, egg_as_word: bool = False) -> Column:
    """The first category one of whose keywords the lower-cased name holds; wide: the longer lists with frozen food."""
    low, out = F.lower(name), None
    for label, words in CATEGORIES:
        if wide and label in CATEGORIES_WIDE:
            words = f"{words}|{CATEGORIES_WIDE[label]}"
        pattern = r"\begg" if egg_as_word and label == "c. eggs" else f"({words})"
        out = (F if out is None else out).when(low.rlike(pattern), label)
    return out.when(low.rlike(FROZEN[1]), FROZEN[0]).otherwise("i. other") if wide else out.otherwise("h. other")


def says_sale(note: Column) -> Column:
    """Whether a free-text note speaks of a promotion; stock notices don't."""
    return _filled(note) & F.lower(note).rlike(SALE_WORDS) & ~F.lower(F.trim(note)).rlike(STOCK_WORDS)


def shown_brand(brand: Column) -> Column:
    """The trimmed brand, empty where the field holds a promotion instead."""
    return F.when(F.lower(brand).rlike(PROMOTION), "").otherwise(F.trim(F.coalesce(brand, F.lit(""))))


def chain_label(vendor: Column) -> Column:
    out = None
    for code, label in CHAIN_LABELS.items():
        out = (F if out is None else out).when(vendor == code, label)
    return out.otherwise(vendor)


def vendor_in_id(product_id: Column) -> Column:
    """The vendor that a retired id begins with, or null."""
    return captured(product_id, f"^({'|'.join(VENDORS)})")


def listing_parts(listing: Column) -> dict[str, Column]:
    """A listing text, taken apart; null parts where the text isn't of that form."""
    return {part: F.when(listing.like(LISTING), F.regexp_extract(listing, pattern, 1)) for part, pattern in LISTING_PARTS.items()}


def id_shape(product_id: Column) -> Column:
    out = None
    for name, pattern in ID_SHAPES:
        out = (F if out is None else out).when(product_id.rlike(pattern), name)
    return out.otherwise("other")


def store_in_url(url: Column) -> dict[str, Column]:
    return {part: F.regexp_extract(url, pattern, 1) for part, pattern in STORE_IN_URL.items()}


def decoded_date(number: Column) -> Column:
    """YYYYMMDD as a date; null where month or day don't exist."""
    return F.when(number.between(10000101, 99991231), F.try_to_date(number.cast("string"), "yyyyMMdd"))


def decoded_date_text(text: Column) -> Column:
    """The earlier form 'YYYY-MM-DD...' as a date; null where it isn't one."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(head, "yyyy-MM-dd"))
