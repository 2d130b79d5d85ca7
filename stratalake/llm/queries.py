"""The numbered operators as queries over the given tables, with the digest columns that they are checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.core.session import spread
from stratalake.llm import apportion, divergence, fertility, fill_middle, imatch, kneser_ney, quotations, simhash, splitters, suffixes, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def fold(parts: int) -> Column:
    """CRC-32 of doc_id as text, modulo parts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(_table(spark, sf_dir, "conversations"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.sampled_splitters(_table(spark, sf_dir, "documents"), n_shards=8)


def op3_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    found = kneser_ney.identify(docs, docs.where(~F.col("held_out")))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op5_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(fold(3) != 1), labels.where(fold(3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(_table(spark, sf_dir, "documents"))


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.verbatim_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return suffixes.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix_sources(_table(spark, sf_dir, "documents"))


def op10_gbt_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op11_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *fertility.BASE, "base_failed", "kept")


def op12_swar_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_quadtree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quotation_linking, op2_sampled_splitters, op3_dictionary_warc, op4_kneser_ney_language, op5_levenshtein_toxicity, op6_simhash_tiles, op7_imatch, op8_suffix_decontamination, op9_sainte_lague_mix, op10_gbt_url_filter, op11_tokeniser_fertility, op12_swar_fill_middle, op13_quadtree_divergence)
    return {f.__name__: f for f in own}


#: In DuckDB. SHA-1 in base32 takes five hexadecimal digits, 20 bits, at a time.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT) >> CAST(15 - (i % 4) * 5 AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2, ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM t),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM c
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT lang, source, id, term, count(*) AS n FROM (SELECT lang, source, id, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS id FROM d)) GROUP BY ALL) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 5) // (s.total + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (c.lang_n + 5) // (v.total + 5 * v.v) AS q
    FROM c JOIN s USING (lang, source) JOIN v ON v.lang = c.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_dictionary_warc": OP3_SQL, "op8_suffix_decontamination": OP8_SQL, "op12_swar_fill_middle": OP12_SQL, "op13_quadtree_divergence": OP13_SQL}
