"""The functions for SQL, so that saved SQL can call them by name: temporary ones of a session, or permanent ones of a
catalogue's database, which every session of the catalogue has; scalar functions, and some that return tables.

Each is made of its Column expression: the analysed expression's own SQL becomes the body, which Spark inlines again. A
function of staged parts calls the functions of those parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.functions import catalogue as C
from quern.functions import prices as P
from quern.functions import text as X
from quern.functions import units as U

#: Kinds of the parts that staged functions pass on.
_PRICE = {"clean": "string", "blank": "boolean", "den": "string", "digits": "double", "bare": "boolean", "unit": "string", "basis": "string", "scale": "double", "shape": "string"}
_UNIT = {"clean": "string", "core": "string", "held": "double", "junk": "boolean", "amount": "double", "token": "string", "lead": "double", "trail": "double", "name": "string", "number": "double", "kind": "string", "factor": "double", "counted": "boolean", "pack": "double", "quantity": "double"}
_SHAPE_TESTS = {"p_is_scalar": "plain", "p_is_thousands": "thousands", "p_is_multibuy": "multibuy", "p_is_cents": "cents", "p_is_now_cents": "now cents", "p_is_cent_sym": "cent sign", "p_is_perweight": "per weight"}


def _direct() -> Iterator[tuple[str, str, Column]]:
    """(name, parameters, expression of them)."""
    x, clean = F.col("x"), X.cleaned(F.col("x"))
    yield "p_clean", "x string", clean
    yield "p_is_blank", "x string", X.is_blank(x)
    by = {s.name: s for s in P.SHAPES}
    for name, shape in _SHAPE_TESTS.items():
        yield name, "x string", F.lower(clean).rlike(by[shape].pattern)
    yield "p_is_bare_int", "x string", clean.rlike(P.BARE)
    yield "p_lead_num", "x string", X.captured(clean, P.LEADING).try_cast("double")
    multibuy = clean.rlike(by["multibuy"].pattern)
    yield "p_mb_qty", "x string", F.when(multibuy, X.captured(clean, "([0-9]+)").try_cast("double"))
    yield "p_mb_total", "x string", F.when(multibuy, X.captured(clean, P.MULTIBUY_TOTAL).try_cast("double"))
    yield "u_clean", "x string", F.lower(clean)
    yield "u_is_junk", "x string", F.lower(clean).isin(*U.JUNK)
    v, sku, listing = F.col("vendor"), F.col("sku"), F.col("concatted")
    yield "k_has_sku", "sku string", sku.isNotNull() & (F.trim(sku) != "")
    yield "k_source", "vendor string, sku string, concatted string", C.key_source(v, sku, listing)
    yield "product_key", "vendor string, sku string, concatted string", C.product_key(v, sku, listing)
    yield "product_key_basis", "sku string", C.product_key_basis(sku)
    yield "b_norm", "x string", C.brand_name(x)
    yield "b_is_junk", "x string", C.is_junk_brand(x)
    yield "b_is_private_label", "vendor string, x string", C.is_store_brand(v, x)
    yield "b_vendor_has_brand_data", "vendor string", ~v.isin(*C.WITHOUT_BRANDS)
    yield "b_class", "vendor string, x string", C.brand_class(v, x)
    yield "b_class_coarse", "vendor string, x string", C.coarse(C.brand_class(v, x))
    yield "gtin14", "x string", C.gtin14(C.barcode_digits(x))
    yield "cat", "x string", C.category(x)
    yield "norm", "x string", X.normalised(x)
    yield "blank", "x string", X.is_blank(x)
    yield "sig", "x string", X.shape(x)
    yield "other_says_sale", "x string", C.says_sale(x)
    yield "clean_brand", "x string", C.shown_brand(x)
    yield "chain_label", "x string", C.chain_label(x)
    yield "observed_date", "n bigint", C.decoded_date(F.col("n"))
    yield "u_canon", "x string", U.folded_quantity(x)
    yield "u_class", "x string", U.folded_class(x)
    for name, e in U.stated_unit_price(x).items():
        yield {"ppu_amount": "ppu_amt", "ppu_qty": "ppu_qty", "ppu_token": "ppu_tok"}[name], "x string", e
    yield "name_size", "x string", X.size_in_name(x)


@dataclass(frozen=True)
class Home:
    """Where functions live: a database of the catalogue, or the session (none)."""

    spark: SparkSession
    database: str | None = None

    def name(self, function: str) -> str:
        return f"`{self.database}`.{function}" if self.database else function

    def create(self, function: str, params: str, returns: str, body: str) -> None:
        self.spark.sql(f"create or replace {'' if self.database else 'temporary '}function {self.name(function)}({params}) returns {returns} return {body}")


def _made(home: Home, name: str, params: str, e: Column) -> list[str]:
    """Creates a function of those of the parameters that its expression refers to; returns their names, in order."""
    kinds = dict(p.split() for p in params.split(", "))
    holders = ", ".join(f"cast(null as {t}) as {p}" for p, t in kinds.items())
    bound = home.spark.sql(f"select {holders}").select(e.alias("o"))._jdf.queryExecution().analyzed().expressions().head().child()
    refs = bound.references().toSeq()
    used = {refs.apply(i).name() for i in range(refs.size())}
    kept = [p for p in kinds if p in used]
    home.create(name, ", ".join(f"{p} {kinds[p]}" for p in kept), bound.dataType().sql(), bound.sql())
    return kept


def _staged(home: Home, prefix: str, kinds: dict[str, str], layers: list[dict[str, Column]]) -> dict[str, str]:
    """Functions prefix_part(x) of the parts; returns what each part's call is. A part calls only the parts it needs."""
    calls = {"x": "x"}
    for layer in layers:
        known = dict(calls)
        for part, e in layer.items():
            need = _made(home, f"{prefix}_{part}_of", ", ".join(f"{k} {kinds.get(k, 'string')}" for k in known), e)
            home.create(f"{prefix}_{part}", "x string", kinds[part], f"{home.name(f'{prefix}_{part}_of')}({', '.join(known[k] for k in need)})")
            calls[part] = f"{home.name(f'{prefix}_{part}')}(x)"
    return calls


def register(spark: SparkSession, database: str | None = None) -> list[str]:
    """Creates the functions and returns their names: in the session, as long as it lives, or in a database of the
    catalogue, which is made where it is missing and outlives the session (and, with a lasting catalogue, the application).
    Those of a database are called by database.name; those that return tables, which Spark doesn't let a database's name
    precede, by their name in a session that USEs the database."""
    home, names = Home(spark, database), []
    if database:
        spark.sql(f"create database if not exists `{database}`")

    def wrap(name: str, params: str, kind: str, body: str) -> None:
        home.create(name, params, kind, body)
        names.append(name)

    for name, params, e in _direct():
        _made(home, name, params, e)
        names.append(name)
    col = F.col

    def over(name: str, kind: str, e: Column, calls: dict[str, str], kinds: dict[str, str], vendor: bool = False) -> None:
        """name(x) or name(vendor, x): an expression of staged parts over their calls."""
        own = {"vendor": "vendor"} if vendor else {}
        need = _made(home, f"{name}_of", ", ".join(f"{k} {kinds.get(k, 'string')}" for k in [*own, *calls]), e)
        wrap(name, "vendor string, x string" if vendor else "x string", kind, f"{home.name(f'{name}_of')}({', '.join((own | calls)[k] for k in need)})")

    calls = _staged(home, "p_part", _PRICE, P.stages(F.col("x"), col))
    public = {"offer_type": "p_offer_type", "unit_price": "p_unit_price", "min_qty": "p_min_qty", "price_basis": "p_price_basis", "price_basis_stated": "p_basis_stated", "normalization": "p_normalization", "parse_confidence": "p_confidence"}
    doubles = {"unit_price": "double", "min_qty": "double"}
    for field, e in P.fields(col).items():
        over(public[field], doubles.get(field, "string"), e, calls, _PRICE)
    with_vendor = P.fields(col, F.col("vendor"))
    for field in ("unit_price", "normalization", "parse_confidence"):
        over(f"{public[field]}_v", doubles.get(field, "string"), with_vendor[field], calls, _PRICE, vendor=True)
    readings = {"in_cents": "p_wm_cents", "cents_or_dollars": "p_wm_ambiguous", "thousands_in_doubt": "p_voila_thousands", "integer_in_doubt": "p_galleria_bare_int"}
    for reading, e in P.vendor_readings(col, F.col("vendor")).items():
        over(readings[reading], "boolean", e, calls, _PRICE, vendor=True)
    wrap("p_den_raw", "x string", "string", calls["den"])
    wrap("p_den_unit", "x string", "string", calls["unit"])
    wrap("p_basis", "x string", "string", calls["basis"])
    wrap("p_basis_scale", "x string", "double", calls["scale"])
    wrap("p_den_qty", "x string", "double", f"coalesce(try_cast(nullif(regexp_extract({calls['den']}, '^([0-9]+)', 1), '') as double), 1.0D)")
    wrap("p_den_each", "x string", "boolean", f"{calls['unit']} in ({', '.join(map(repr, P.PIECES))})")
    wrap("p_den_grams", "x string", "double", f"case when {calls['basis']} = 'per_100g' then try_divide(100.0D, {calls['scale']}) end")
    wrap("p_den_ml", "x string", "double", f"case when {calls['basis']} = 'per_100ml' then try_divide(100.0D, {calls['scale']}) end")

    calls = _staged(home, "u_part", _UNIT, U.stages(F.col("x"), col))
    public = {"unit_qty": ("u_qty", "double"), "unit_uom": ("u_uom", "string"), "pack_count": ("u_pack_count", "double"), "total_qty": ("u_total_qty", "double"), "unit_parse_confidence": ("u_confidence", "string")}
    for field, e in U.fields(col).items():
        over(*public[field], e, calls, _UNIT)
    for name, part in (("u_core", "core"), ("u_qty_lit", "amount"), ("u_tok_raw", "token"), ("u_perpack_n", "held"), ("u_pack_lead", "lead"), ("u_pack_trail", "trail"), ("u_uom_token", "kind"), ("u_count_n", "number"), ("u_factor", "factor")):
        wrap(name, "x string", _UNIT[part], calls[part])
    for name, params, columns in _TABLES:
        kinds = ", ".join(f"{c} {kind}" for c, kind, _ in columns)
        wrap(name, params, f"table({kinds})", f"select {', '.join(home.name(e) if e.endswith('(x)') else e for *_, e in columns)}")
    return names


#: Functions that return tables: (name, parameters, (column, kind, expression) ...).
_TABLES = [
    ("price_fields", "x string", [("offer_type", "string", "p_offer_type(x)"), ("unit_price", "double", "p_unit_price(x)"), ("min_qty", "double", "p_min_qty(x)"), ("price_basis", "string", "p_price_basis(x)"), ("normalization", "string", "p_normalization(x)"), ("parse_confidence", "string", "p_confidence(x)")]),
    ("unit_fields", "x string", [("unit_qty", "double", "u_qty(x)"), ("unit_uom", "string", "u_uom(x)"), ("pack_count", "double", "u_pack_count(x)"), ("total_qty", "double", "u_total_qty(x)"), ("unit_parse_confidence", "string", "u_confidence(x)")]),
    ("calendar_days", "first date, last date", [("d", "date", "explode(sequence(first, last))")]),
]


def set_variable(spark: SparkSession, name: str, value: str) -> None:
    """A session variable, which SQL reads by its name."""
    spark.sql(f"declare or replace variable {name} string")
    spark.sql(f"set var {name} = :value", args={"value": value})
