import pytest

from quern.functions import sql
from quern.functions.prices import parse_prices
from quern.functions.units import parse_units
from tests.test_parsers import PRICES, UNITS, same


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def test_price_functions_equal_the_parser(spark, names):
    df = spark.createDataFrame([(i, p[0], v) for i, p in enumerate(PRICES) for v in ("Walmart", "Voila", "Galleria", None)], "i int, x string, v string")
    parse_prices(df, {"": "x"}, vendor="v").createOrReplaceTempView("quern_cases")
    odd = spark.sql("""select * from quern_cases where not (p_offer_type(x) <=> offer_type and p_unit_price_v(v, x) <=> unit_price and p_min_qty(x) <=> min_qty and p_price_basis(x) <=> price_basis
        and p_basis_stated(x) <=> price_basis_stated and p_normalization_v(v, x) <=> normalization and p_confidence_v(v, x) <=> parse_confidence)""")
    assert odd.collect() == []
    for p in PRICES:
        r = spark.sql("select p_unit_price(:x) as u, p_normalization(:x) as n", args={"x": p[0]}).first() if p[0] is not None else None
        assert r is None or same(r.u, p[2]) and r.n == p[5], p


def test_unit_functions_equal_the_parser(spark, names):
    parse_units(spark.createDataFrame([(u[0],) for u in UNITS], "x string"), "x").createOrReplaceTempView("quern_sizes")
    odd = spark.sql("select * from quern_sizes where not (u_qty(x) <=> unit_qty and u_uom(x) <=> unit_uom and u_pack_count(x) <=> pack_count and u_total_qty(x) <=> total_qty and u_confidence(x) <=> unit_parse_confidence)")
    assert odd.collect() == []


ONE = [
    ("p_clean('  a  b ')", "a b"), ("p_is_thousands('1,071.90')", True), ("p_is_multibuy('2/$7.00')", True), ("p_mb_qty('2/$7.00')", 2.0), ("p_mb_total('2/$7.00')", 7.0), ("p_mb_qty('7.00')", None),
    ("p_den_raw('8.80/1000g')", "1000g"), ("p_den_qty('8.80/1000g')", 1000.0), ("p_den_unit('8.80/1000g')", "g"), ("p_den_grams('36.90/kg')", 1000.0), ("p_den_ml('0.50/100ml')", 100.0), ("p_den_grams('0.50/100ml')", None),
    ("p_den_each('12.46 avg/ea')", True), ("p_basis('3/lb')", "per_100g"), ("p_basis_scale('3/kg')", 0.1), ("p_is_bare_int('45')", True), ("p_wm_cents('Walmart', '298')", True), ("p_wm_ambiguous('Walmart', '45')", True),
    ("p_voila_thousands('Voila', '1,926.25')", True), ("p_galleria_bare_int('Galleria', '12')", True), ("p_lead_num('17.61avg.kg')", 17.61), ("p_is_perweight('17.61avg.kg')", True), ("p_is_cent_sym('99¢')", True),
    ("u_core('60gx6')", "60g"), ("u_tok_raw('16 fl oz')", "fl oz"), ("u_perpack_n('4 per pack')", 4.0), ("u_pack_lead('2 x 500 mL')", 2.0), ("u_pack_trail('60gx6')", 6.0), ("u_uom_token('24ea')", "count"), ("u_count_n('24ea')", 24.0),
    ("u_factor('2 kg')", 1000.0), ("u_is_junk('N/A')", True), ("u_canon('2 x 500 mL')", 1000.0), ("u_class('500g')", "mass_g"), ("ppu_amt('$2.00/100g')", 2.0), ("ppu_tok('$2.00/100g')", "g"), ("name_size('Soup 540 mL')", "540 ml"),
    ("k_has_sku(' ')", False), ("product_key_basis('1')", "vendor_sku"), ("b_norm(' pc ')", "PC"), ("b_is_private_label('Loblaws', 'pc')", True), ("b_class('Voila', 'x')", "unclassifiable_no_vendor_data"), ("b_class_coarse('Voila', 'x')", "unclassifiable"),
    ("b_vendor_has_brand_data('Metro')", True), ("cat('Iced TEA')", "g. beverages"), ("sig('2 for $5.00')", "N a $N.N"), ("other_says_sale('On Sale')", True), ("gtin14('0-12345-67890-5')", "00012345678905"), ("chain_label('SaveOnFoods')", "Save-On-Foods"),
    ("blank(' ')", True), ("norm(' A  b')", "a b"), ("clean_brand('You save$1')", ""), ("cast(observed_date(20240229) as string)", "2024-02-29"), ("product_key('Metro', '12', 'x')", __import__("hashlib").md5(b"Metro\x1f12").hexdigest()),
]


def test_single_functions(spark, names):
    got = spark.sql("select " + ", ".join(f"{q} as c{i}" for i, (q, _) in enumerate(ONE))).first()
    assert [(q, g) for (q, _), g in zip(ONE, got)] == [(q, w) if not isinstance(w, float) else (q, pytest.approx(w)) for q, w in ONE]
    assert len(names) == len(set(names)) >= 61


def test_session_variable(spark):
    sql.set_variable(spark, "extract_path", "it's here")
    assert spark.sql("select extract_path").first()[0] == "it's here"


def test_functions_of_a_database_are_every_sessions(spark):
    made = sql.register(spark, "quern_test")
    other = spark.newSession()
    assert {"p_unit_price", "u_qty", "price_fields", "calendar_days"} <= set(made)
    r = other.sql("select quern_test.p_unit_price('2/$7.00') as u, quern_test.u_total_qty('2 x 500 mL') as t, quern_test.b_class_coarse('Voila', 'x') as b").first()
    assert tuple(r) == (3.5, 1000.0, "unclassifiable")
    other.sql("use quern_test")
    fields = "offer_type, unit_price, min_qty, price_basis, normalization, parse_confidence"
    other.createDataFrame([(p[0],) for p in PRICES], "x string").createOrReplaceTempView("cases")
    by_table = other.sql(f"select x, f.* from cases, lateral price_fields(x) f")
    by_call = other.sql("select x, quern_test.p_offer_type(x), quern_test.p_unit_price(x), quern_test.p_min_qty(x), quern_test.p_price_basis(x), quern_test.p_normalization(x), quern_test.p_confidence(x) from cases")
    assert by_table.columns[1:] == fields.split(", ") and by_table.exceptAll(by_call).count() == 0 and by_table.count() == len(PRICES)
    assert [str(r.d) for r in other.sql("select * from calendar_days(date '2024-02-28', date '2024-03-01')").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    other.sql("use default")
    other.sql("drop database quern_test cascade")
