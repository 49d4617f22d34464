"""The corpus operators' queries: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import conversations, decontaminate, kneser_ney, license_scan, line_runs, link_graph, lm_quality, merkle, mixing, near_text, quality, sharding, simhash, toxicity
from quern.llm.common import table


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rules and verdict. Null and empty texts have no words and fail; very long texts are
    counted whole; a score that ties with the threshold is kept; repeated rows are answered one by one; a null doc_id is
    answered; an empty table gives no rows."""
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds. Null and empty texts hold none; very long texts are
    searched whole; of tying alignments any has the same edits; repeated rows and null doc_ids are answered one by one; an
    empty table gives no rows, an empty benchmark no matches (least_edits null)."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"))


#: The rules that every page is judged by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. Null urls and those without :// have neither host nor path and are
    allowed; of rules of one length the alphabetically first counts; very long urls and pages are read whole; repeated rows are
    answered one by one; an empty table gives no rows."""
    return link_graph.filter_urls(table(spark, sf_dir, "pages"), [link_graph.Rule.of(*r) for r in URL_RULES])


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture. Null texts count as empty, a null source is a source; equal rows take one
    place each; rows of one hash are ordered by doc_id and text's hash, blocks of one deadline by source; a very long text is
    a row like any other; an empty table gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class. Null and empty texts have fingerprint zero and link like any other; very
    long texts are taken whole; a bit that half of the shingles set is 0; a null doc_id links but names no class; repeated rows are answered one by one; an empty table gives no rows."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, by the law ``rows``. Null texts have no bytes; null doc_ids and repeated rows get
    slots of their own; a very long text is one row, so that counts, not bytes, are even; keys of one hash are ordered by
    doc_id and text's hash; an empty table gives no rows."""
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its frequent lines; n_seen: its lines that an earlier batch held (four batches, by ranges of
    doc_id). Every row is a document, repeated rows too; null and empty texts are one empty line, which stays; very long
    texts are taken whole; keys that tie at ten documents go; null doc_ids are of the first batch; an empty table gives no
    rows."""
    found = line_runs.drop_frequent(table(spark, sf_dir, "documents"), min_docs=10, tell_seen=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"), "n_seen")


def op8_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores. Null and empty texts are their end alone; very long texts are scored whole; a word's
    number where counts tie changes no score; a null doc_id counts as the text ''; repeated rows are learned from and answered one by one; an empty table gives no rows."""
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


def op9_lm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under trusted text, and its verdict. Null and empty texts are their end alone; a score
    right at the threshold is kept; very long texts are scored whole; null languages go by all; repeated rows are answered
    one by one; an empty table gives no rows."""
    return lm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity. Null and empty texts score alike; null languages go by all languages' threshold, and a
    score right at it is toxic; very long texts are read whole; repeated rows are answered one by one; an empty table gives
    no rows."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and templates. Null and empty texts have no words, no labels and score 0; very long
    texts are read whole; templates that tie are all named; repeated rows and null doc_ids are answered one by one; an
    empty table gives no rows."""
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations as op12 damages them: by crc32 of ``conv_id:turn`` modulo 20. A null in any column is one space;
    ``copies`` says how often a row is there afterwards."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair. Null roles and texts are one space, null conv_ids one conversation,
    null turns first; rows of one turn go by role and text's hash; of equally cheap audits the ASCII-least; very long
    texts and conversations are cut into chunks; repeated rows are duplicates; an empty table gives no rows."""
    return conversations.repair(damaged(table(spark, sf_dir, "conversations")), copies="copies")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verification. Nulls are encoded as -; null languages are a group, the first; null
    doc_ids come first, rows of one doc_id by their digest, equal rows are leaves of their own; very long texts are
    hashed whole; n_chars of the largest long grows by one all the same; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    of = lambda n: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(tampered & F.col("n_chars").isNotNull(), of(F.col("n_chars").cast("decimal(20,0)") + 1))
    return merkle.manifest(docs.select("doc_id", F.col("lang").alias("grp"), of(F.col("n_chars")).alias("leaf"), shown.alias("shown")))


def corpus_line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's runs, batch after batch: each document's lines that no earlier batch held (documents without one have no row)."""
    docs = table(spark, sf_dir, "documents")
    batch, store, found = line_runs.batch_of(docs), line_runs.LineRuns(spark), None
    try:
        for b in range(line_runs.BATCHES):
            new = line_runs.first_seen(store, docs.where(batch == b)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_new")).withColumn("batch", F.lit(b))
            found = new if found is None else found.unionAll(new)
    finally:
        store.close()
    return found


def corpus_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: counts and base rules."""
    return op1_quality_gbt(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def corpus_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3 for pages that link to no other host: all of it."""
    return op3_link_graph(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict")


#: Rounds of the propagation over orders, so that SQL can spell them out.
ROUNDS = 6


def corpus_link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's propagation over a graph that has links: customers are hosts, and a clerk's orders link each to the next by
    order key. Trusted are those of segment BUILDING, blocked those with an account below zero."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda c: F.concat(F.lit("c"), c)
    clerk = (F.col("o_orderkey") % 97).alias("clerk")
    following = F.lead("o_custkey").over(Window.partitionBy("clerk").orderBy("o_orderkey"))
    edges = orders.select("o_orderkey", "o_custkey", clerk).select(name("o_custkey").alias("src"), name(following).alias("dst")).where("dst is not null")
    edges = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = customers.select(name("c_custkey").alias("host"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("good"), (F.col("c_acctbal") < 0).cast("double").alias("bad"))
    found = link_graph.propagate(hosts, edges, rounds=ROUNDS, tolerance=0.0)
    return found.select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def corpus_mixture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: each source's rows, blocks and target, and how its blocks keep to their windows."""
    found = op4_pfair_mixing(spark, sf_dir).withColumn("in_window", F.expr("release <= slot and slot < deadline"))
    by = found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("block").alias("n_blocks"), F.round(F.first("target"), 9).alias("target"), F.countDistinct("position").alias("n_positions"),
        F.sum((~F.col("in_window")).cast("long")).alias("n_late"), F.sum(F.col("position")).alias("places"),
    )
    whole = by.agg(F.lit("(all)").alias("source"), F.sum("n_rows").alias("n_rows"), F.sum("n_blocks").alias("n_blocks"), F.round(F.sum("target"), 6).alias("target"), F.sum("n_positions").alias("n_positions"), F.sum("n_late").alias("n_late"), F.sum("places").alias("places"))
    return by.withColumn("places", F.lit(None).cast("long")).unionAll(whole)


def corpus_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6, by shard: rows, and slots without a gap."""
    return op6_bounded_ring(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def corpus_row_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6, by document: its size."""
    return op6_bounded_ring(spark, sf_dir).select("doc_id", "size", "law", (F.col("shard").between(0, 15)).alias("placed"))


def corpus_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: all but the model's score."""
    return op8_kneser_ney_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def corpus_trusted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: every document's tokens, and which of them trusted documents hold."""
    return op9_lm_quality(spark, sf_dir).select("doc_id", "lang", "n_tokens", "n_known")


def corpus_kept_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline's near duplicates keep: the smallest doc_id of each class of texts that are equal or 0.8 alike."""
    return near_text.keep_one(table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith(("op", "corpus_")) and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "string_split(coalesce(text, ''), chr(10))"
_BATCH = f"coalesce((doc_id - (SELECT min(doc_id) FROM documents)) // ((SELECT max(doc_id) - min(doc_id) FROM documents) // {line_runs.BATCHES} + 1), 0)"
_KEYED_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, {_BATCH} AS batch, * FROM documents),
l AS (SELECT rid, batch, doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, count(DISTINCT rid) AS n, min(batch) AS born FROM k WHERE key <> '' GROUP BY key)"""
_LINE_DEDUP = f"""{_KEYED_LINES},
r AS (SELECT rid, doc_id, pos, line, coalesce(n >= 10, false) AS gone, coalesce(batch > born, false) AS seen FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, count(*) FILTER (WHERE seen) AS n_seen
FROM r GROUP BY rid, doc_id
"""
_LINE_BATCHES = f"{_KEYED_LINES} SELECT doc_id, batch::INT AS batch, count(*) AS n_new FROM k JOIN f USING (key) WHERE batch = born GROUP BY doc_id, batch"

_WORD = "[^\\x20\\x09-\\x0D]+"
_COUNTS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words FROM d),
p AS (SELECT rid, words, unnest(range(len(words) - 4)) AS pos FROM w WHERE len(words) >= 5),
g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, array_to_string(words[pos + 1:pos + 5], ' ')) AS n FROM p),
c AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(pos, pos + 5)) AS place FROM g WHERE n >= 2) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
s AS (SELECT w.rid, doc_id, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN u USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""

_RULES = ", ".join(f"('{verdict}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{text}')" for verdict, text in URL_RULES)
_URLS = f"""
WITH rules(ruled, rule_host, rule_path, rule) AS (VALUES {_RULES}),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT rid, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT p.*, rule, ruled, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule) AS nr
      FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT *, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY host) AS blocked FROM f WHERE nr = 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host <> '' AND blocked > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM b
"""


def _link_rounds() -> str:
    parts = ["""
WITH o AS (SELECT 'c' || o_custkey AS src, 'c' || lead(o_custkey) OVER (PARTITION BY o_orderkey % 97 ORDER BY o_orderkey) AS dst FROM orders),
e AS (SELECT src, dst, count(*) AS n FROM o WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
s AS (SELECT src, dst, 0.85 * n / sum(n) OVER (PARTITION BY src) AS fwd, 0.85 * n / sum(n) OVER (PARTITION BY dst) AS rev FROM e),
r0 AS (SELECT host, max(good) AS good, max(bad) AS bad, max(good) AS trust, max(bad) AS distrust FROM (
    SELECT 'c' || c_custkey AS host, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS good, CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0 END AS bad FROM customer
    UNION ALL SELECT src, 0, 0 FROM e UNION ALL SELECT dst, 0, 0 FROM e) GROUP BY host)"""]
    for i in range(ROUNDS):
        parts.append(f"""
t{i + 1} AS (SELECT dst AS host, sum(fwd * trust) AS x FROM s JOIN r{i} ON src = host GROUP BY dst),
d{i + 1} AS (SELECT src AS host, sum(rev * distrust) AS y FROM s JOIN r{i} ON dst = host GROUP BY src),
r{i + 1} AS (SELECT host, good, bad, good + coalesce(x, 0) AS trust, bad + coalesce(y, 0) AS distrust FROM r0 LEFT JOIN t{i + 1} USING (host) LEFT JOIN d{i + 1} USING (host))""")
    return ",".join(parts) + f" SELECT host, round(trust, 6) AS trust, round(distrust, 6) AS distrust FROM r{ROUNDS}"


_SOURCES = """
WITH s AS (SELECT source, count(*) AS n_rows, ceil(count(*) / 16.0)::BIGINT AS n_blocks FROM documents GROUP BY source),
t AS (SELECT *, round(sqrt(n_rows) / sum(sqrt(n_rows)) OVER (), 9) AS target FROM s)
SELECT source, n_rows, n_blocks, target, n_rows AS n_positions, 0::BIGINT AS n_late, NULL::BIGINT AS places FROM t
UNION ALL SELECT '(all)', sum(n_rows)::BIGINT, sum(n_blocks)::BIGINT, 1.0, sum(n_rows)::BIGINT, 0, (sum(n_rows) * (sum(n_rows) - 1) // 2)::BIGINT FROM t
"""
_SHARDS = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(16))::INT AS shard)
SELECT shard, n // 16 + (shard < n % 16)::INT AS n_rows, n // 16 + (shard < n % 16)::INT AS n_slots, 0::BIGINT AS first_slot, n // 16 + (shard < n % 16)::INT - 1 AS last_slot FROM s, n
"""
_SIZES = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, 'rows' AS law, true AS placed FROM documents"

#: CRC-32 of a short ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({text}, '')]), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_TOKENS = f"list_append(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}'), chr(10))"
_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC.format(text="doc_id::VARCHAR")} % 10 = 0 AS held_out, {_TOKENS} AS tokens FROM documents),
t AS (SELECT rid, held_out, unnest(tokens) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base FROM t LEFT JOIN c USING (token), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 5) AS base_score FROM d JOIN s USING (rid), n
"""
_TRUSTED = f"""
WITH good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
fitted AS (SELECT doc_id FROM good WHERE {_CRC.format(text="doc_id::VARCHAR")} % 5 <> 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, {_TOKENS} AS tokens FROM documents),
t AS (SELECT rid, doc_id, unnest(tokens) AS token FROM d),
k AS (SELECT DISTINCT token, 1 AS known FROM t WHERE doc_id IN (SELECT doc_id FROM fitted)),
s AS (SELECT rid, count(*) AS n_tokens, count(known) AS n_known FROM t LEFT JOIN k USING (token) GROUP BY rid)
SELECT doc_id, lang, n_tokens, n_known FROM d JOIN s USING (rid)
"""
#: By brute force: every two texts that share a shingle, and what is reached over those that are alike enough.
_COPIES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
t AS (SELECT t, min(doc_id) AS id, any_value(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END) AS s FROM d GROUP BY t),
x AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM t),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n + b.n) AS sizes, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE shared >= 0.8::DOUBLE * (sizes - shared) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS seen FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT DISTINCT least AS doc_id FROM (SELECT id, min(seen) AS least FROM r GROUP BY id)
"""

_PHRASES = ", ".join(f"('{label}', {license_scan.tokens(p)})" for label, p in license_scan.PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(license_scan.tokens(t)))})" for label, t in license_scan.TEMPLATES)
#: By brute force: every block against every template.
_LICENSES = f"""
WITH phrases(label, p) AS (VALUES {_PHRASES}), templates(label, tw) AS (VALUES {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS (SELECT rid, w, unnest(range(len(w))) AS pos FROM d),
f AS (SELECT rid, pos, label FROM q JOIN phrases ON w[pos + 1] = p[1] AND w[pos + 1:pos + len(p)] = p),
b AS (SELECT rid, list_distinct(w[k * {license_scan.STEP} + 1:k * {license_scan.STEP} + {2 * license_scan.STEP}]) AS bw FROM (SELECT rid, w, unnest(range((len(w) + {license_scan.STEP - 1}) // {license_scan.STEP})) AS k FROM d)),
m AS (SELECT rid, label, len(list_intersect(bw, tw)) AS shared, len(tw) AS size FROM b, templates),
t AS (SELECT rid, label, shared / size AS share FROM m WHERE shared >= ceil({license_scan.THRESHOLD}::DOUBLE * size - 1e-9)),
n AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM f UNION ALL SELECT rid, label FROM t) GROUP BY rid),
s AS (SELECT rid, max(share) AS share FROM t GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


def _add(x: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {x} <> '~' THEN printf('%06d', left({x}, 6)::INT + {cost}) || substr({x}, 7) || '{letter}' ELSE '~' END"


_INSERTED = f"least(u, {_add('b', '5', 'I')}, {_add('s', '5', 'I')}, {_add('a', '5', 'I')}) AS u, least(a, {_add('u', '5', 'I')}) AS a"
_STEPS = (
    f"{_add('b', '2', 'D')} AS b, least({_add('s', '2', 'D')}, CASE WHEN NOT gone AND ini = 's' THEN {_add('b', 'more', 'K')} ELSE '~' END) AS s, "
    f"least({_add('u', '2', 'D')}, CASE WHEN NOT gone AND ini = 'u' THEN least({_add('b', 'more', 'K')}, {_add('s', 'more', 'K')}, {_add('a', 'more', 'K')}) ELSE '~' END, "
    f"CASE WHEN NOT gone THEN least({_add('b', '1 + more', 'R')}, {_add('s', '1 + more', 'R')}, {_add('a', '1 + more', 'R')}) ELSE '~' END) AS u, "
    f"least({_add('a', '2', 'D')}, CASE WHEN NOT gone AND ini = 'a' THEN {_add('u', 'more', 'K')} ELSE '~' END, CASE WHEN NOT gone THEN {_add('u', '1 + more', 'R')} ELSE '~' END) AS a"
)
#: The cheapest, then least, prefix of an audit by state, row after row (b: nothing yet, s, u, a: after such a row).
_REPAIRS = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(text="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, left(role, 1) AS ini FROM g),
r AS (SELECT *, blank OR again AS gone, 5 * (cut AND NOT blank AND NOT again)::INT AS more, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM o),
w AS (
    SELECT conv_id, 0::BIGINT AS i, '000000' AS b, '~' AS s, '~' AS u, '~' AS a FROM (SELECT DISTINCT conv_id FROM c)
    UNION ALL
    SELECT conv_id, i, {_STEPS} FROM (SELECT conv_id, b, s, {_INSERTED}, ini, gone, more, i FROM (SELECT conv_id, b, s, {_INSERTED}, ini, gone, more, i FROM (
        SELECT w.conv_id, b, s, u, a, ini, gone, more, r.i FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)))
),
e AS (SELECT conv_id, least(b, a) AS best FROM (SELECT conv_id, b, s, {_INSERTED} FROM (SELECT conv_id, b, s, {_INSERTED} FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
x AS (SELECT conv_id, left(best, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM e),
l AS (SELECT conv_id, k, audit[k] AS letter, sum((audit[k] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM x)),
h AS (SELECT l.conv_id, k, letter, r.text, r.role, r.ini, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) - 1 AS m FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
p AS (SELECT *, m - max((letter = 'K' AND m = 0 AND ini = 's')::INT) OVER (PARTITION BY conv_id) AS place FROM h),
y AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM p GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE more > 0) AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM x LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM x.conv_id
"""


def _enc(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_enc(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_UP = "list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(array_to_string(nodes[2 * k + 1:2 * k + 2], '')))"
_MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC.format(text="coalesce(doc_id, 0)::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} ELSE {_leaf("n_chars")} END AS shown FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
t AS (SELECT g, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY g
      UNION ALL SELECT g, level + 1, {_UP} FROM t WHERE len(nodes) > 1),
s AS (SELECT g, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t WHERE len(nodes) = 1),
c AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s UNION ALL SELECT level + 1, {_UP} FROM c WHERE len(nodes) > 1),
ways AS (
    SELECT rid, level, nodes[xor(p.place >> level, 1) + 1] AS sib, (p.place >> level) AS k, 0 AS part FROM p JOIN t USING (g) WHERE len(nodes) > 1
    UNION ALL SELECT rid, c.level, c.nodes[xor(s.place >> c.level, 1) + 1], (s.place >> c.level), 1 FROM p JOIN s USING (g) JOIN c ON len(c.nodes) > 1),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY part, level) AS nr FROM ways),
f AS (SELECT rid, 0::BIGINT AS nr, shown AS cur FROM p
      UNION ALL SELECT f.rid, f.nr + 1, sha256(CASE WHEN sib IS NULL THEN cur WHEN k % 2 = 0 THEN cur || sib ELSE sib || cur END) FROM f JOIN steps ON steps.rid = f.rid AND steps.nr = f.nr + 1),
proof AS (SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY nr), '')) AS proof FROM steps GROUP BY rid),
folds AS (SELECT rid, arg_max(cur, nr) AS folded FROM f GROUP BY rid),
r AS (SELECT nodes[1] AS root FROM c WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN s USING (g) JOIN folds USING (rid) LEFT JOIN proof USING (rid), r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": _LINE_DEDUP, "corpus_line_batches": _LINE_BATCHES, "corpus_quality_counts": _COUNTS, "corpus_url_rules": _URLS, "corpus_link_scores": _link_rounds(), "corpus_mixture_sources": _SOURCES,
        "corpus_shard_sizes": _SHARDS, "corpus_row_sizes": _SIZES, "corpus_base_scores": _BASE, "corpus_trusted_words": _TRUSTED, "corpus_kept_copies": _COPIES,
        "op11_license_scan": _LICENSES, "op12_conversation_repair": _REPAIRS, "op13_merkle_manifest": _MERKLE,
    }
