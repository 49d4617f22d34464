"""Pack sizes as typed columns: quantity of one item in g, mL or pieces, items in a pack, and how sure the reading is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import GRAMS, MILLILITRES
from quern.functions.text import captured, cleaned, compiled_small, two_decimals

#: Spellings of each unit, and texts that mean "no size".
SPELLINGS = {
    "kg": ("kilogram", "kilograms", "kg"),
    "g": ("gram", "grams", "g"),
    "lb": ("pound", "pounds", "lbs", "lb"),
    "oz": ("ounce", "ounces", "oz"),
    "l": ("litre", "litres", "liter", "liters", "l"),
    "ml": ("millilitre", "millilitres", "milliliter", "milliliters", "ml"),
    "fl oz": ("fl oz", "floz"),
    "count": ("count", "ct", "pack", "packs", "pk", "piece", "pieces", "pc", "each", "ea", "un", "units", "unit"),
}
JUNK = ("error", "n/a", "na", "none", "null", "-", ".", "")
CONTAINER = r"^([0-9]+) (?:per )?(?:pack|tray|bunch|bag|box|case)\z"
#: A multiplier before or behind a size, and the same behind a unit.
LEAD, TRAIL, UNIT_TRAIL = r"^([0-9]+) ?[x*] ?[0-9]", r"[x*] ?([0-9]+)\z", r"[a-z] ?[x*] ?([0-9]+)\z"
#: A number and the unit behind it, and the unit alone; the boundary is an ASCII one.
_WORDS = "|".join(sorted({w for ws in SPELLINGS.values() for w in ws} - {"fl oz", "floz"}, key=lambda w: (-len(w), w))) + "|fl ?oz"
SIZE, TOKEN = rf"([0-9]+(?:\.[0-9]+)?) ?({_WORDS})(?![A-Za-z0-9_])", rf"[0-9] ?({_WORDS})(?![A-Za-z0-9_])"


def _lookup(key: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(key == k, F.lit(v))
    return out


FIELDS = ("unit_qty", "unit_uom", "pack_count", "total_qty", "unit_parse_confidence")


def _of(token: Column, table: dict) -> Column:
    out = None
    for unit, value in table.items():
        out = (F if out is None else out).when(token.isin(*SPELLINGS[unit]), F.lit(value))
    return out


def stages(raw: Column, at) -> list[dict[str, Column]]:
    """What the fields need, in layers: each may use those before it, through at(name)."""
    by = lambda table: _lookup(at("name"), table)
    factor = F.coalesce(by({u: GRAMS[u] for u in ("kg", "lb", "oz")} | {u: MILLILITRES[u] for u in ("l", "fl oz")}), F.lit(1.0))
    kind = by({u: "g" for u in ("kg", "g", "lb", "oz")} | {u: "ml" for u in ("l", "ml", "fl oz")} | {"count": "count"})
    return [
        {"clean": F.lower(cleaned(raw))},
        {"core": F.regexp_replace(at("clean"), r"([a-z]) ?[x*] ?[0-9]+\z", "$1"), "held": captured(at("clean"), CONTAINER).try_cast("double"), "junk": at("clean").isin(*JUNK)},
        {
            "amount": captured(at("core"), SIZE, 1).try_cast("double"), "token": captured(at("core"), TOKEN),
            "lead": captured(at("clean"), LEAD).try_cast("double"), "trail": captured(at("clean"), UNIT_TRAIL).try_cast("double"),
        },
        # one look-up names the unit, and the rest follows from its name
        {"name": _of(at("token"), {u: u for u in SPELLINGS}), "number": F.coalesce(at("amount"), at("held"))},
        {"kind": F.coalesce(kind, F.when(at("held").isNotNull(), "count")), "factor": factor},
        {"counted": F.coalesce((at("kind") == "count") & at("number").isNotNull(), F.lit(False))},
        {
            "pack": F.when(~at("junk"), F.coalesce(at("lead"), at("trail"), F.when(at("counted"), at("number")), F.lit(1.0))),
            "quantity": F.when(~at("junk"), F.when(at("counted"), F.lit(1.0)).otherwise(at("amount") * at("factor"))),
        },
    ]


def fields(at) -> dict[str, Column]:
    """The typed fields, of the staged columns at(name)."""
    sure = (
        F.when(at("junk"), "none").when(at("held").isNotNull() & at("amount").isNull(), "inferred").when(at("counted"), "exact")
        .when(at("amount").isNotNull(), F.when(at("pack") > 1, "derived").otherwise("exact")).otherwise("none")
    )
    return {"unit_qty": at("quantity"), "unit_uom": F.when(~at("junk"), at("kind")), "pack_count": at("pack"), "total_qty": at("quantity") * F.coalesce(at("pack"), F.lit(1.0)), "unit_parse_confidence": sure}


def parse_units(df: DataFrame, column: str) -> DataFrame:
    """Adds the fields of a size text. An explicit multiplier ('4 x 100g', '60gx6') is the pack; a bare count ('24ea',
    '4 per pack') is one too, of pieces. Staged, so that each expression is worked out once."""
    at = lambda name: F.col(f"__{name}")
    names = []
    compiled_small(df)
    for layer in stages(F.col(column), at):
        df = df.withColumns({f"__{k}": v for k, v in layer.items()})
        names += [f"__{k}" for k in layer]
    return df.withColumns(fields(at)).drop(*names)


def folded_quantity(x: Column) -> Column:
    """The first, simpler reading: quantity times unit times any multiplier, or a container's count."""
    clean = F.lower(cleaned(x))
    amount = captured(clean, SIZE, 1).try_cast("double")
    token = captured(clean, TOKEN)
    times = F.coalesce(captured(clean, LEAD).try_cast("double"), captured(clean, TRAIL).try_cast("double"), F.lit(1.0))
    factor = F.coalesce(_of(token, {u: GRAMS[u] for u in ("kg", "lb", "oz")} | {u: MILLILITRES[u] for u in ("l", "fl oz")}), F.lit(1.0))
    return F.coalesce(amount * factor * times, captured(clean, CONTAINER).try_cast("double"))


def folded_class(x: Column) -> Column:
    clean = F.lower(cleaned(x))
    token = captured(clean, TOKEN)
    known = _of(token, {u: "mass_g" for u in ("kg", "g", "lb", "oz")} | {u: "volume_ml" for u in ("l", "ml", "fl oz")} | {"count": "count"})
    return F.coalesce(known, F.when(clean.rlike(CONTAINER), "count"))


def parse_folded(df: DataFrame, column: str) -> DataFrame:
    """Adds ``quantity`` and ``class``, as ``folded_quantity`` and ``folded_class`` give them; staged, so that each pattern is
    looked for once."""
    at = lambda name: F.col(f"__{name}")
    compiled_small(df)
    factor = {u: GRAMS[u] for u in ("kg", "lb", "oz")} | {u: MILLILITRES[u] for u in ("l", "fl oz")}
    classes = {u: "mass_g" for u in ("kg", "g", "lb", "oz")} | {u: "volume_ml" for u in ("l", "ml", "fl oz")} | {"count": "count"}
    layers = [
        {"clean": F.lower(cleaned(F.col(column)))},
        {
            "amount": captured(at("clean"), SIZE, 1).try_cast("double"), "token": captured(at("clean"), TOKEN), "held": captured(at("clean"), CONTAINER).try_cast("double"),
            "lead": captured(at("clean"), LEAD).try_cast("double"), "trail": captured(at("clean"), TRAIL).try_cast("double"),
        },
        {"name": _of(at("token"), {u: u for u in SPELLINGS})},
    ]
    for layer in layers:
        df = df.withColumns({f"__{k}": v for k, v in layer.items()})
    times = F.coalesce(at("lead"), at("trail"), F.lit(1.0))
    df = df.withColumns({
        "quantity": F.coalesce(at("amount") * F.coalesce(_lookup(at("name"), factor), F.lit(1.0)) * times, at("held")),
        "class": F.coalesce(_lookup(at("name"), classes), F.when(at("held").isNotNull(), "count")),
    })
    return df.drop(*(f"__{k}" for layer in layers for k in layer))


def stated_unit_price(x: Column) -> dict[str, Column]:
    """'$2.00/100g' -> amount 2.00, quantity 100, token g."""
    clean = F.lower(cleaned(x))
    return {
        "ppu_amount": captured(clean, r"([0-9]+(?:\.[0-9]+)?)\s*/").try_cast("double"),
        "ppu_qty": F.coalesce(captured(clean, r"/\s*([0-9]+(?:\.[0-9]+)?)").try_cast("double"), F.lit(1.0)),
        "ppu_token": F.replace(F.regexp_extract(clean, r"/\s*[0-9]*\.?[0-9]*\s*([a-z.]+)\s*\z", 1), F.lit("."), F.lit("")),
    }


def display_size(quantity: Column, uom: Column, pack: Column, confidence: Column) -> Column:
    """'2 x 500 ml': only for sure readings, without trailing zeros; else empty."""
    number = F.regexp_replace(F.regexp_replace(two_decimals(quantity), r"0+\z", ""), r"\.\z", "")
    packs = F.when(F.coalesce(pack, F.lit(1.0)) > 1, F.concat(pack.cast("int").cast("string"), F.lit(" x "))).otherwise("")
    return F.when(confidence.isin("exact", "derived") & quantity.isNotNull(), F.concat(packs, number, F.lit(" "), F.coalesce(uom, F.lit("")))).otherwise("")
