"""Free-text prices as typed columns.

A text is cleaned once, put into one of ten shapes by a table of patterns, and every field then follows from the shape:
what is offered, how the number was repaired, how far it can be trusted, and the price of one unit on a basis of one
piece, 100 g or 100 mL. Staged as columns, so that the regular expressions run once a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import GRAMS, MILLILITRES
from quern.functions.text import NUMBER, captured, cleaned, compiled_small, is_blank, settled, to_number


@dataclass(frozen=True)
class Shape:
    name: str
    pattern: str  # on the lower-cased clean text, in order of precedence
    offer: str
    repair: str | None
    confidence: str


#: How the shapes are written, and what each is called.
SHAPES = [
    Shape("plain", NUMBER, "scalar", "none", "exact"),
    Shape("thousands", r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\z", "scalar", "thousands_sep", "exact"),
    Shape("cents", r"^[0-9]+\$\z", "scalar", "cents_div100", "derived"),
    Shape("now cents", r"^now\$[0-9]+\z", "scalar", "now_prefix_cents_div100", "derived"),
    Shape("cent sign", r"^[0-9]+¢\z", "scalar", "cent_symbol_div100", "derived"),
    Shape("multibuy", r"^[0-9]+ ?/ ?\$[0-9]+(\.[0-9]+)?\z", "multibuy", "none", "derived"),
    Shape("per weight", r"^[0-9]+(\.[0-9]+)? ?(avg\.?)? ?[/.] ?[0-9]* ?[a-z]+\.?", "per_weight", None, "inferred"),
]
#: Where a price has its denominator, its first number, a multibuy its total; and what counts as a piece.
DENOMINATOR = r"(?:avg)?[ .]?/? ?([0-9]* ?(?:kg|lbs|lb|g|ml|l|oz|ea|each|item|un))\.?"
LEADING, MULTIBUY_TOTAL, BARE = r"([0-9]+(?:\.[0-9]+)?)", r"\$([0-9.]+)\z", r"^[0-9]+\z"
PIECES = ("ea", "each", "item", "un")
FIELDS = ("offer_type", "unit_price", "min_qty", "price_basis", "price_basis_stated", "normalization", "parse_confidence")


def _lookup(key: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def denominator(clean: Column) -> Column:
    """'36.90/kg' -> 'kg', '8.80/1000g' -> '1000g', without spaces; empty where there is none."""
    return F.replace(F.regexp_extract(F.lower(clean), DENOMINATOR, 1), F.lit(" "), F.lit(""))


def denominator_unit(den: Column) -> Column:
    return F.regexp_extract(den, r"([a-z]+)\z", 1)


def denominator_basis(unit: Column) -> Column:
    return F.when(unit.isin(*PIECES), "each").when(unit.isin(*GRAMS), "per_100g").when(unit.isin("ml", "l"), "per_100ml")


def denominator_scale(den: Column, unit: Column) -> Column:
    """What brings a price per denominator to its basis; null for a zero quantity or an unknown unit."""
    quantity = F.coalesce(captured(den, r"^([0-9]+)").try_cast("double"), F.lit(1.0))
    size = quantity * _lookup(unit, GRAMS | {"ml": 1.0, "l": MILLILITRES["l"]})
    return F.when(unit.isin(*PIECES), F.lit(1.0)).otherwise(F.try_divide(F.lit(100.0), size))


def shape_of(blank: Column, clean: Column, basis: Column) -> Column:
    """The shape's name: blank, one of SHAPES, or unparsed. A price per weight needs a denominator that is known."""
    low = F.lower(clean)
    out = F.when(blank, "blank")
    for s in SHAPES:
        fits = low.rlike(s.pattern)
        out = out.when(fits & basis.isNotNull() if s.name == "per weight" else fits, s.name)
    return out.otherwise("unparsed")


def stages(raw: Column, at) -> list[dict[str, Column]]:
    """What the fields need, in layers: each may use those before it, through at(name)."""
    return [
        {"clean": cleaned(raw), "blank": is_blank(raw)},
        {"den": denominator(at("clean")), "digits": captured(at("clean"), r"([0-9]+)").try_cast("double"), "bare": at("clean").rlike(BARE)},
        {"unit": denominator_unit(at("den"))},
        {"basis": denominator_basis(at("unit")), "scale": denominator_scale(at("den"), at("unit"))},
        {"shape": shape_of(at("blank"), at("clean"), at("basis"))},
    ]


def vendor_readings(at, vendor: Column) -> dict[str, Column]:
    """How a vendor is known to write prices: bare integers in cents, and spellings that may be either."""
    who, bare, digits = F.coalesce(vendor, F.lit("")), at("bare"), at("digits")
    walmart = (who == "Walmart") & bare
    return {
        "in_cents": walmart & (digits >= 100), "cents_or_dollars": walmart & (digits >= 10) & (digits < 100),
        "thousands_in_doubt": (who == "Voila") & (at("shape") == "thousands"), "integer_in_doubt": (who == "Galleria") & bare,
    }


def fields(at, vendor: Column | None = None) -> dict[str, Column]:
    """The typed fields, of the staged columns at(name)."""
    shape, clean, scale, digits = at("shape"), at("clean"), at("scale"), at("digits")
    of = lambda attribute: _lookup(shape, {s.name: getattr(s, attribute) for s in SHAPES if getattr(s, attribute) is not None})
    price = (
        F.when(shape == "plain", to_number(clean))
        .when(shape == "thousands", F.replace(clean, F.lit(","), F.lit("")).try_cast("double"))
        .when(shape.isin("cents", "now cents", "cent sign"), digits / 100.0)
        .when(shape == "multibuy", F.try_divide(captured(clean, MULTIBUY_TOTAL).try_cast("double"), digits))
        .when(shape == "per weight", captured(clean, LEADING).try_cast("double") * scale)
    )
    repair = F.when(shape == "per weight", F.when(scale == 1.0, "none").otherwise("basis_rescaled")).otherwise(of("repair"))
    confidence = F.coalesce(of("confidence"), F.lit("none"))
    if vendor is not None:
        known = vendor_readings(at, vendor)
        in_cents, doubtful = known["in_cents"], known["cents_or_dollars"] | known["thousands_in_doubt"] | known["integer_in_doubt"]
        price = F.when(in_cents, digits / 100.0).otherwise(price)
        repair = F.when(in_cents, "bare_integer_cents").otherwise(repair)
        confidence = F.when(in_cents, "derived").when(doubtful, "ambiguous").otherwise(confidence)
    return {
        "offer_type": F.coalesce(of("offer"), shape),
        "unit_price": price,
        "min_qty": F.when(shape == "multibuy", digits).when(shape != "blank", F.lit(1.0)),
        "price_basis": F.when(shape == "per weight", at("basis")).when(~shape.isin("blank", "unparsed"), "each"),
        "price_basis_stated": F.nullif(at("den"), F.lit("")),
        "normalization": repair,
        "parse_confidence": confidence,
    }


def parse_prices(df: DataFrame, sources: dict[str, str], vendor: str | None = None) -> DataFrame:
    """Adds the fields of each text column, named prefix + field; sources: prefix -> column.

    With a vendor column, bare integers and thousands are read as that vendor is known to write them; a null vendor is
    read like any other. What several fields need is a column of its own, so that no expression is worked out twice and
    the generated code stays small.
    """
    compiled_small(df)
    for prefix, column in sources.items():
        at = lambda name: F.col(f"__{prefix}{name}")  # noqa: B023, E731
        names = []
        for layer in stages(F.col(column), at):
            df = df.withColumns({f"__{prefix}{k}": v for k, v in layer.items()})
            names += [f"__{prefix}{k}" for k in layer]
        df = settled(df, names).withColumns({prefix + k: v for k, v in fields(at, F.col(vendor) if vendor else None).items()}).drop(*names)
    return df
