"""The publication: each barcode's latest offers with their comparison verdict, price histories, and the gate before it.

Everything is a DataFrame until the last step; the published files are small, ordered, and byte for byte repeatable.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import config
from quern.functions.catalogue import CHAIN_LABELS, PROMOTION, chain_label, shown_brand
from quern.functions.units import display_size
from quern.operators import timeline
from quern.operators.stats import global_rank, ordered_list
from quern.plans.contracts import breaks
from quern.plans.models import sized
from quern.sources.sinks import canonical

KEYS = ["gtin", "vendor", "basis"]

#: What the published documents say.
NOTHING_RECENT = "No chain has a price from the last 7 days. Nothing can be compared."
ONE_RECENT = ("Only ", " has a price from the last 7 days. There is nothing to compare it with.")
CHEAPEST_OF = ("Cheapest of the ", " chains with a price from the last 7 days: ")
LATE, OTHER_BASIS, LATE_AND_OTHER = "no recent price", "priced on a different basis", "no recent price, and a different price basis"
NO_NAME = "(no name)"


def chain_offers(days: DataFrame, extract: date, recency: int = config.RECENCY_DAYS) -> DataFrame:
    """(gtin, vendor, basis, px, min_qty, on_sale, observed_date, days_behind): each chain's latest offer of a product,
    on the basis it was last seen on (of several that day, the last in order)."""
    recent = days.where(F.col("d") > F.date_sub(F.lit(extract), recency))
    latest = recent.groupBy(*KEYS).agg(*[F.max_by(c, "d").alias(c) for c in ("px", "min_qty", "on_sale")], F.max("d").alias("observed_date"))  # total: a chain has one row a product, basis and day
    best = latest.groupBy("gtin", "vendor").agg(F.max_by(F.struct("basis", "px", "min_qty", "on_sale", "observed_date"), F.struct("observed_date", "basis")).alias("o"))  # total: the key ends in the basis, of which there is one row
    return best.select("gtin", "vendor", "o.*").withColumn("days_behind", F.datediff(F.lit(extract), "observed_date").cast("long"))


def majority_basis(offers: DataFrame) -> DataFrame:
    n = offers.groupBy("gtin", "basis").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("gtin").agg(F.max_by("basis", F.struct("n", "basis")).alias("product_basis"))  # total: the key ends in the basis, which is the group key


def flagged(offers: DataFrame, stale: DataFrame, recent: int = config.RECENT_DAYS, horizon: int = config.STALE_AFTER_DAYS) -> DataFrame:
    """Offers with is_recent, comparable and the reason if not, and the chain's measured staleness at their age.

    stale: (vendor, k, pct_wrong). An age beyond the longest measured horizon has none, and says so.
    """
    o = offers.join(majority_basis(offers), "gtin")
    late, other = F.col("days_behind") > recent, F.col("basis") != F.col("product_basis")
    ks = sorted(config.HORIZONS)
    k = None
    for h in ks:
        k = (F if k is None else k).when(F.col("days_behind") <= h, F.lit(h))
    reason = F.when(late & other, LATE_AND_OTHER).when(late, LATE).when(other, OTHER_BASIS)
    o = o.withColumns({"is_recent": ~late, "comparable": ~late & ~other, "not_comparable_reason": reason, "k": k, "staleness_exceeds_measured": F.col("days_behind") > horizon})
    found = o.join(stale.select("vendor", "k", F.col("pct_wrong").alias("staleness_pct")), ["vendor", "k"], "left")
    return found.withColumn("staleness_horizon_days", F.when(F.col("staleness_pct").isNotNull(), F.col("k"))).drop("k")


def sale_context(offers: DataFrame, days: DataFrame, window: int = config.LOOKBACK_DAYS) -> DataFrame:
    """(gtin, vendor, prior_days, prior_low, prior_high, prior_same): the days before an offer on its own basis."""
    e = offers.select("gtin", "vendor", "basis", F.col("observed_date").alias("start_d"), F.col("px").alias("now_px"))
    rows = timeline.with_lookback(e, days, KEYS, window).where("d is not null")
    return rows.groupBy("gtin", "vendor").agg(F.count(F.lit(1)).alias("prior_days"), F.min("px").alias("prior_low"), F.max("px").alias("prior_high"), F.sum((F.abs(F.col("px") - F.col("now_px")) <= config.PRICE_EPSILON).cast("long")).alias("prior_same"))


def names(products: DataFrame, weights: DataFrame) -> DataFrame:
    """(gtin, name, brand, size): the listing under which a barcode was seen most often, ties in order of its text.

    products: models' products with gtin; weights: (product_key, n), how often each was observed.
    """
    size = display_size(F.col("unit_qty"), F.col("unit_uom"), F.col("pack_count"), F.col("unit_parse_confidence"))
    p = products.select("product_key", "gtin", F.coalesce(F.nullif(F.trim("product_name"), F.lit("")), F.lit(NO_NAME)).alias("name"), shown_brand(F.col("brand_raw")).alias("brand"), size.alias("size"))
    n = p.join(weights, "product_key").groupBy("gtin", "name", "brand", "size").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("gtin").orderBy(F.col("n").desc(), "name", "brand", "size")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "n")  # total: the order holds the whole group key


def claim(n, labels):
    """What may be said of a comparison of n chains, with their labels in order."""
    listed = F.concat(F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(1)).cast("int")), ", "), F.lit(" and "), F.element_at(labels, -1))
    return (
        F.when(n == 0, NOTHING_RECENT)
        .when(n == 1, F.concat(F.lit(ONE_RECENT[0]), F.element_at(labels, 1), F.lit(ONE_RECENT[1])))
        .otherwise(F.concat(F.lit(CHEAPEST_OF[0]), n.cast("string"), F.lit(CHEAPEST_OF[1]), listed, F.lit(".")))
    )


def guaranteed(offers: DataFrame, vendors: list[str], tiers: DataFrame) -> DataFrame:
    """The offers; reading them fails if one is of another chain, or of a chain whose barcodes aren't reliable any more.

    tiers: (vendor, vendor_upc_tier), one row a vendor at most and tier.
    """
    loose = tiers.where(~F.col("vendor_upc_tier").isin("vendor_upc", "matched_upc")).select("vendor").distinct().withColumn("loose", F.lit(True))
    o = breaks(offers.join(sized(loose), "vendor", "left"), ~F.col("vendor").isin(*vendors), "an offer of a chain outside the extract")
    return breaks(o, F.coalesce("loose", F.lit(False)), "a chain of the extract is no longer of a reliable tier").drop("loose")


def products_document(offers: DataFrame, context: DataFrame | None, name: DataFrame) -> DataFrame:
    """One row a barcode, nested as it is published, ordered by barcode. offers: what ``flagged`` gives.

    context: what ``sale_context`` gives; without it, for readers of the comparison alone, no days before are looked back on.
    """
    o = offers.join(context, ["gtin", "vendor"], "left") if context is not None else offers.withColumns({c: F.lit(None).cast(t) for c, t in (("prior_days", "long"), ("prior_low", "double"), ("prior_high", "double"), ("prior_same", "long"))})
    o = o.withColumn("label", chain_label(F.col("vendor")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    offer = F.struct(
        F.col("vendor").alias("chain"), F.col("label").alias("chain_label"), F.round("px", 2).alias("price"), "basis", "min_qty", "observed_date", "days_behind", "is_recent",
        (F.col("on_sale") == 1).alias("on_sale"), "comparable", "not_comparable_reason", "staleness_pct", "staleness_horizon_days", "staleness_exceeds_measured",
        F.struct(zero("prior_days").alias("days_observed"), F.col("prior_low").alias("low"), F.col("prior_high").alias("high"), zero("prior_same").alias("days_at_this_price")).alias("prior_14d"),
    )
    missing = F.struct(F.col("vendor").alias("chain"), F.col("label").alias("chain_label"), F.col("observed_date").alias("last_observed"), "days_behind", F.col("not_comparable_reason").alias("reason"))
    fits = F.col("comparable")
    rows = o.groupBy("gtin").agg(
        ordered_list([~fits, F.col("px"), F.col("vendor")], offer).alias("offers"),
        F.sum(fits.cast("long")).alias("n"), F.max("product_basis").alias("basis"),
        F.min_by(F.struct("vendor", "min_qty"), F.when(fits, F.struct("px", "vendor"))).alias("best"),  # total: the key ends in the vendor, of which there is one row
        F.array_sort(F.collect_list(F.when(fits, F.col("vendor")))).alias("compared"),  # total: sorted
        ordered_list([F.col("vendor")], F.when(fits, F.col("label"))).alias("labels"),
        ordered_list([F.col("vendor")], F.when(~fits, missing)).alias("unavailable"),
    )
    filled = lambda c: F.filter(c, lambda x: x.isNotNull())
    several = F.col("n") >= 2
    verdict = F.struct(
        "basis", F.col("n").alias("n_compared"), "compared", filled(F.col("unavailable")).alias("unavailable"), F.when(several, F.col("best.vendor")).alias("cheapest"),
        F.when(several & (F.col("best.min_qty") > 1), F.col("best.min_qty")).alias("cheapest_requires_min_qty"), claim(F.col("n"), filled(F.col("labels"))).alias("claim"),
    )
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.join(name, "gtin").select(F.col("gtin").alias("gtin14"), "name", empty("brand").alias("brand"), empty("size").alias("size"), "basis", "offers", verdict.alias("comparison")).orderBy("gtin14")


def history_document(days: DataFrame, extract: date, history: int = config.HISTORY_DAYS) -> DataFrame:
    """(gtin14, chain, chain_label, basis, spells): runs of one price over the last days, ordered."""
    s = timeline.spells(days.where(F.col("d") > F.date_sub(F.lit(extract), history)), KEYS)
    spell = F.struct("from_date", "to_date", F.round("px", 2).alias("price"), "observed_days", (F.col("on_sale") == 1).alias("on_sale"))
    rows = s.groupBy(*KEYS).agg(ordered_list([F.col("from_date")], spell).alias("spells"))
    return rows.select(F.col("gtin").alias("gtin14"), F.col("vendor").alias("chain"), chain_label(F.col("vendor")).alias("chain_label"), "basis", "spells").orderBy("gtin14", "chain", "basis")


def search(products: DataFrame, text: str, most: int = 25) -> DataFrame:
    """Products whose name, brand and size hold the text, whatever the case: earliest match first, then most compared,
    then by name."""
    hay = F.lower(F.concat_ws(" ", "name", "brand", "size"))
    at = F.instr(hay, text.lower())
    return products.withColumn("__at", at).where("__at > 0").orderBy("__at", F.col("comparison.n_compared").desc(), "name", "gtin14").limit(most).drop("__at")  # total: ordered to the barcode


def index(products: DataFrame, path: str) -> None:
    """Writes what ``search_index`` reads: for each place of a product's text its three characters there (fewer at the end),
    sorted by these, with what ranks the product; and the products, sorted by barcode."""
    hay = F.lower(F.concat_ws(" ", "name", "brand", "size"))
    ranked = global_rank(products.withColumn("__hay", hay), ["name", "gtin14"], "name_rank")
    places = F.transform(F.sequence(F.lit(1), F.length("__hay")), lambda p: F.struct(F.substr("__hay", p, F.lit(GRAM)).alias("gram"), p.alias("place")))
    postings = ranked.where(F.length("__hay") > 0).select("gtin14", F.col("comparison.n_compared").alias("n_compared"), "name_rank", F.explode(places).alias("x"))
    postings.select("x.gram", "x.place", "gtin14", "n_compared", "name_rank").repartitionByRange("gram", "gtin14").sortWithinPartitions("gram", "gtin14").write.mode("overwrite").parquet(f"{path}/postings")  # total: the writer mode, not a statistic
    products.repartitionByRange("gtin14").sortWithinPartitions("gtin14").write.mode("overwrite").parquet(f"{path}/products")  # total: the writer mode, not a statistic


#: Characters of an index entry.
GRAM = 3


def search_index(spark: SparkSession, path: str, text: str, most: int = 25) -> DataFrame:
    """What ``search`` finds, by the index: only postings of the text's own trigrams are read (of a text of one or two
    characters, of those that begin with it), which the files' statistics tell, and are intersected by place; only the
    products found are looked up, by the barcodes of at most ``most`` of them. An empty text finds what it finds there."""
    text = text.lower()
    postings = spark.read.parquet(f"{path}/postings")
    if len(text) < GRAM:
        hits = postings.where(F.col("gram").startswith(text)).select("gtin14", "n_compared", "name_rank", F.col("place").alias("at"))
    else:
        grams: dict[str, list[int]] = {}
        for i in range(len(text) - GRAM + 1):
            grams.setdefault(text[i : i + GRAM], []).append(i)
        n = len(text) - GRAM + 1
        offsets = F.create_map(*[x for g, places in grams.items() for x in (F.lit(g), F.array(*map(F.lit, places)))])
        some = postings.where(F.col("gram").isin(list(grams))).select("gtin14", "n_compared", "name_rank", "place", F.explode(offsets[F.col("gram")]).alias("offset"))
        starts = some.groupBy("gtin14", (F.col("place") - F.col("offset")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("n_compared").alias("n_compared"), F.max("name_rank").alias("name_rank"))
        hits = starts.where(F.col("n") == n)
    first = hits.groupBy("gtin14").agg(F.min("at").alias("at"), F.max("n_compared").alias("n_compared"), F.max("name_rank").alias("name_rank"))
    order = [F.col("at"), F.col("n_compared").desc(), F.col("name_rank")]
    top = [(r.gtin14, i) for i, r in enumerate(first.orderBy(*order).limit(most).collect())]  # total: name_rank is one product's
    found = spark.read.parquet(f"{path}/products")
    if not top:
        return found.limit(0)  # total: no row is taken
    place = F.create_map(*[F.lit(x) for pair in top for x in pair])
    return found.where(F.col("gtin14").isin([g for g, _ in top])).withColumn("__at", place[F.col("gtin14")]).orderBy("__at").drop("__at")


def aged(offers: DataFrame, today: date, recent: int = config.RECENT_DAYS) -> DataFrame:
    """Offers as seen on a later day: those that have become too old are no longer comparable; none becomes so."""
    age = F.datediff(F.lit(today), "observed_date")
    return offers.withColumn("comparable", F.col("comparable") & (age <= recent)).withColumn("days_behind", age.cast("long"))


def gate(meta: dict, products: list[dict], history: list[dict], floors: dict = config.EXTRACT_FLOORS, today: date | None = None) -> list[str]:
    """What keeps a built publication from being released: its structure, verdicts that their offers don't bear out,
    staleness that falls with age, sizes under the floors, and an old extract."""
    bad = [f"meta lacks {k}" for k in ("built_utc", "extract_date", "snapshot_id", "basket_barcodes", "products_shipped", "omitted", "chains", "exclusions", "scope", "attribution") if k not in meta]
    for c in meta.get("chains", []):
        curve = [s["pct_wrong"] for s in sorted(c.get("staleness") or [], key=lambda s: s["days"]) if s["pct_wrong"] is not None]
        if any(b < a for a, b in zip(curve, curve[1:])):
            bad.append(f"staleness of {c.get('chain')} falls with age")
    if meta.get("products_shipped") != len(products):
        bad.append("products_shipped isn't the number of products")
    ids = [p.get("gtin14") for p in products]
    if ids != sorted(set(ids), key=lambda x: (x is None, x)):
        bad.append("products aren't in order, or repeat")
    comparable = 0
    for p in products:
        offers, c = p.get("offers") or [], p.get("comparison") or {}
        fit = sorted((o for o in offers if o["comparable"]), key=lambda o: (o["price"], o["chain"]))
        comparable += len(fit) >= 2
        if not offers or any(o["price"] is None or o["price"] <= 0 for o in offers):
            bad.append(f"{p.get('gtin14')}: no offer, or one without a price")
        if c.get("n_compared") != len(fit) or sorted(c.get("compared") or []) != sorted(o["chain"] for o in fit):
            bad.append(f"{p.get('gtin14')}: the compared chains aren't the comparable offers")
        if len(fit) >= 2 and c.get("cheapest") not in {o["chain"] for o in fit if o["price"] == fit[0]["price"]} or len(fit) < 2 and c.get("cheapest") is not None:
            bad.append(f"{p.get('gtin14')}: the cheapest chain is wrong")
        if any(o["comparable"] and not o["is_recent"] for o in offers) or any(o["comparable"] == (o["not_comparable_reason"] is not None) for o in offers):
            bad.append(f"{p.get('gtin14')}: an offer's reason contradicts it")
        if any(o["staleness_exceeds_measured"] and o["staleness_pct"] is not None for o in offers):
            bad.append(f"{p.get('gtin14')}: staleness beyond what was measured")
    for h in history:
        s = h.get("spells") or []
        if not s or any(a["to_date"] >= b["from_date"] for a, b in zip(s, s[1:])):
            bad.append(f"{h.get('gtin14')} {h.get('chain')}: spells overlap or lack")
    if len(products) < floors["products"]:
        bad.append(f"{len(products)} products, under {floors['products']}")
    if products and 100 * comparable / len(products) < floors["comparable_pct"]:
        bad.append(f"{100 * comparable / len(products):.1f} % comparable, under {floors['comparable_pct']}")
    if today and "extract_date" in meta and (today - date.fromisoformat(str(meta["extract_date"]))).days > floors["vintage_days"]:
        bad.append("the extract is too old")
    return bad


def _told(rows: DataFrame, keys: list[str], problems: dict[str, Column]) -> DataFrame:
    """(keys, problem): one row for each problem a row has; what can't be told, because of a null, is one."""
    texts = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for text, bad in problems.items()])
    return rows.select(*keys, F.explode(F.filter(texts, lambda x: x.isNotNull())).alias("problem"))


def claim_said(claim: Column) -> Column:
    """What a claim says, read back from its words: (n, labels). Of no known form: null."""
    listed = F.regexp_extract(claim, f"^{CHEAPEST_OF[0]}([0-9]+)" + CHEAPEST_OF[1].replace(".", "\\.") + "(.+)\\.$", 2)
    one = F.regexp_extract(claim, f"^{ONE_RECENT[0]}(.+)" + ONE_RECENT[1].replace(".", "\\.") + "$", 1)
    n = F.regexp_extract(claim, f"^{CHEAPEST_OF[0]}([0-9]+)", 1).try_cast("long")
    said = lambda n, labels: F.struct(n.cast("long").alias("n"), labels.alias("labels"))
    return (
        F.when(claim == NOTHING_RECENT, said(F.lit(0), F.array().cast("array<string>")))
        .when(one != "", said(F.lit(1), F.array(one)))
        .when(listed != "", said(n, F.split(listed, ", | and ")))
    )


#: What a document and its parts must have.
PRODUCT_FIELDS = ("gtin14", "name", "basis", "offers", "comparison")
OFFER_FIELDS = ("chain", "chain_label", "price", "basis", "observed_date", "days_behind", "is_recent", "comparable", "staleness_exceeds_measured")


def lacking_fields(products: DataFrame) -> list[str]:
    """The columns and the offers' fields that a table of documents lacks: told by its schema, no row is read."""
    bad = [c for c in PRODUCT_FIELDS if c not in products.columns]
    if "offers" in products.columns:
        kind = products.schema["offers"].dataType
        have = getattr(getattr(kind, "elementType", None), "names", [])
        bad += [f"offers.{c}" for c in OFFER_FIELDS if c not in have]
    return bad


def product_problems(products: DataFrame, chains: list[str] | None = None) -> DataFrame:
    """(gtin14, problem): what keeps the documents of ``products_document`` from being released, read where they lie: one
    pass over nested arrays, no document is moved. ``gate`` asks part of it of documents that have been fetched.

    chains: those that the publication compares; without it, offers of others aren't told.
    """
    fit = F.filter("offers", lambda o: o["comparable"])
    names, low = F.transform(fit, lambda o: o["chain"]), F.array_min(F.transform(fit, lambda o: o["price"]))
    lowest = F.transform(F.filter(fit, lambda o: o["price"] == low), lambda o: o["chain"])
    c = F.col("comparison")
    claim, codes = c["claim"], list(CHAIN_LABELS)
    said = claim_said(claim)
    # set differences, both ways: each chain of an offer is compared or unavailable, and no other is either
    offered, told = F.transform("offers", lambda o: o["chain"]), F.concat(c["compared"], F.transform(c["unavailable"], lambda u: u["chain"]))
    apart = (F.size(F.array_except(offered, told)) > 0) | (F.size(F.array_except(told, offered)) > 0)
    bare = lambda chain, label: chain.isin(codes) & F.coalesce(chain == label, F.lit(True))
    problems = {
        "no offer, or one without a price": (F.size("offers") < 1) | F.exists("offers", lambda o: o["price"].isNull() | (o["price"] <= 0)),
        "the compared chains aren't the comparable offers": (c["n_compared"] != F.size(fit)) | (F.sort_array(c["compared"]) != F.sort_array(names)),
        "the cheapest chain is wrong": F.when(F.size(fit) >= 2, ~F.array_contains(lowest, c["cheapest"])).otherwise(c["cheapest"].isNotNull()),
        "an offer's reason contradicts it": F.exists("offers", lambda o: o["comparable"] & ~o["is_recent"] | (o["comparable"] == F.coalesce(o["not_comparable_reason"] != "", F.lit(False)))),
        "staleness beyond what was measured": F.exists("offers", lambda o: o["staleness_exceeds_measured"] & o["staleness_pct"].isNotNull()),
        "no staleness within what was measured": F.exists("offers", lambda o: ~o["staleness_exceeds_measured"] & o["staleness_pct"].isNull()),
        "a comparable offer on another basis": F.exists("offers", lambda o: o["comparable"] & ~o["basis"].eqNullSafe(F.col("basis"))),
        "a chain is neither compared nor unavailable, or has no offer": apart,
        "an unavailable chain without a reason": F.exists(c["unavailable"], lambda u: F.coalesce(u["reason"] == "", F.lit(True))),
        "an unavailable chain without its last day": F.exists(c["unavailable"], lambda u: u["last_observed"].isNull()),
        "no claim": F.coalesce(claim == "", F.lit(True)),
        "the claim isn't the comparison's": F.coalesce(claim != "", F.lit(False)) & ~F.coalesce((said["n"] == c["n_compared"]) & (F.sort_array(said["labels"]) == F.sort_array(F.transform(fit, lambda o: o["chain_label"]))), F.lit(False)),
        "the claim says and twice": F.coalesce(F.size(F.split(claim, " and ")) > 2, F.lit(False)),
        "the claim prints a chain's code": F.coalesce(claim.rlike("|".join(codes)), F.lit(False)),
        "a chain without a label": F.exists("offers", lambda o: bare(o["chain"], o["chain_label"])),
        "the brand is a promotion": F.coalesce(F.lower("brand").rlike(PROMOTION), F.lit(False)),
    }
    if chains is not None:
        problems["an offer of a chain outside the extract"] = F.exists("offers", lambda o: ~o["chain"].isin(chains))
    found = _told(products, ["gtin14"], problems)
    again = products.groupBy("gtin14").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionAll(again.select("gtin14", F.lit("the product repeats").alias("problem")))


def chain_curves(offers: DataFrame, stale: DataFrame) -> DataFrame:
    """(chain, chain_label, last_observed, days_behind, products, staleness): what a publication says of each chain, its
    measured staleness by age in order. offers: what ``flagged`` gives; stale: (vendor, k, pct_wrong)."""
    each = offers.groupBy("vendor").agg(F.max("observed_date").alias("last_observed"), F.min("days_behind").alias("days_behind"), F.count(F.lit(1)).alias("products"))
    point = F.struct(F.col("k").cast("long").alias("days"), F.col("pct_wrong").alias("pct_wrong"))
    curves = stale.groupBy("vendor").agg(F.array_sort(F.collect_list(point)).alias("staleness"))  # total: one point an age
    empty = F.array().cast("array<struct<days:bigint,pct_wrong:double>>")
    return each.join(curves, "vendor", "left").select(F.col("vendor").alias("chain"), chain_label(F.col("vendor")).alias("chain_label"), "last_observed", "days_behind", "products", F.coalesce("staleness", empty).alias("staleness"))


def chain_problems(curves: DataFrame, chains: list[str] | None = None) -> DataFrame:
    """(chain, problem): what ``chain_curves`` says of a chain that can't be released: staleness can't fall with age."""
    at = lambda f: F.transform("staleness", f)
    follows = lambda s, i, field: (i > 0) & (F.get("staleness", i - 1)[field] > s[field])
    problems = {
        "no staleness curve": F.size("staleness") < 1,
        "the curve isn't in order of age": F.exists(at(lambda s, i: follows(s, i, "days")), lambda x: x),
        "the curve has a hole": F.exists("staleness", lambda s: s["pct_wrong"].isNull()),
        "staleness falls with age": F.coalesce(F.exists(at(lambda s, i: follows(s, i, "pct_wrong")), lambda x: F.coalesce(x, F.lit(False))), F.lit(False)),
        "a chain without a label": F.col("chain").isin(list(CHAIN_LABELS)) & F.coalesce(F.col("chain") == F.col("chain_label"), F.lit(True)),
    }
    if chains is not None:
        problems["a chain outside the extract"] = ~F.col("chain").isin(chains)
    return _told(curves, ["chain"], problems)


def statement_problems(meta: DataFrame, attribution: str, scope: list[tuple[str, ...]]) -> DataFrame:
    """(snapshot_id, problem): what a publication's meta (a row of snapshot_id, attribution, scope map<string,string> and
    more) doesn't state. scope: of each tuple one text must be there, in any case. Staleness pooled over chains, that is a
    column of its own, must not be there at all."""
    stated = F.lower(F.concat_ws(" ", F.map_values("scope")))
    lacks = lambda any_of: ~F.coalesce(stated.rlike("|".join(any_of)), F.lit(False))
    problems = {"attribution doesn't name the source": ~F.coalesce(F.contains(F.col("attribution"), F.lit(attribution)), F.lit(False))}
    problems |= {f"scope doesn't state {any_of[0]}": lacks([w.lower() for w in any_of]) for any_of in scope}
    problems |= {f"staleness pooled over chains: {c}": F.lit(True) for c in meta.columns if "stale" in c.lower()}
    return _told(meta, ["snapshot_id"], problems)


def floors(products: DataFrame, shipped: int | None, extract: date, today: date, least: dict = config.EXTRACT_FLOORS) -> DataFrame:
    """(floor, value, least, holds): documents, the share of them that compare two chains, whether the number shipped is
    the number there, and the extract's age: one aggregate over the documents."""
    n = products.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("comparison.n_compared") >= 2).cast("long")), F.lit(0)).alias("c"))
    share = F.when(F.col("n") > 0, F.lit(100.0) * F.col("c") / F.col("n")).otherwise(0.0)
    age = (today - extract).days
    rows = [
        ("products", F.col("n").cast("double"), F.lit(float(least["products"])), F.col("n") >= least["products"]),
        ("comparable_pct", share, F.lit(float(least["comparable_pct"])), share >= least["comparable_pct"]),
        ("products_shipped", F.lit(float(shipped) if shipped is not None else None).cast("double"), F.col("n").cast("double"), F.lit(shipped).cast("long").eqNullSafe(F.col("n"))),
        ("vintage_days", F.lit(float(age)), F.lit(float(least["vintage_days"])), F.lit(age <= least["vintage_days"])),
    ]
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("floor"), v.alias("value"), m.alias("least"), h.alias("holds")) for k, v, m, h in rows])).alias("x")).select("x.*")


def spell_problems(history: DataFrame) -> DataFrame:
    """(gtin14, chain, problem): histories of ``history_document`` without a spell, or whose spells overlap."""
    late = F.transform("spells", lambda s, i: (i > 0) & (F.get("spells", i - 1)["to_date"] >= s["from_date"]))
    return _told(history, ["gtin14", "chain"], {"spells overlap or lack": (F.size("spells") < 1) | F.exists(late, lambda x: x)})


def document_parity(a: DataFrame, b: DataFrame, key: str = "gtin14") -> DataFrame:
    """(status, documents): how many documents of two builds are the same, differ, or are in one alone. Documents go to one
    task a key as the SHA-256 of their JSON, not as they are."""
    side = lambda df, n: df.select(key, F.lit(n).alias("side"), F.sha2(F.to_json(F.struct(*[c for c in df.columns])), 256).alias("h"))
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("h")))
    both = side(a, 1).unionAll(side(b, 2)).groupBy(key).agg(of(1).alias("a"), of(2).alias("b"))
    status = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").when(F.col("a") == F.col("b"), "same").otherwise("differ")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


def parity(a: tuple[dict, list, list], b: tuple[dict, list, list], ignore: tuple[str, ...] = ("built_utc",)) -> list[str]:
    """Which of two builds' documents differ, their time of building apart: a filtered load must publish what a full one does."""
    meta = [{k: v for k, v in x[0].items() if k not in ignore} for x in (a, b)]
    pairs = {"meta": (canonical(meta[0]), canonical(meta[1])), "products": (canonical(a[1]), canonical(b[1])), "history": (canonical(a[2]), canonical(b[2]))}
    return [name for name, (x, y) in pairs.items() if x != y]
