"""Full-text, substring and vector retrieval, rank fusion and context budgets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.batches import pieces
from stratalake.core.storage import materialize
from stratalake.functions.text import folded, tokens

#: Fixed values of the BM25 variant: saturation, length weight, least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words and phrases of questions that are no search terms.
STOP_WORDS = ("all", "and", "are", "containing", "description", "descriptions", "find", "for", "from", "have", "into", "modeling", "need", "that", "the", "their", "this", "value", "values", "with")
STOP_PHRASES = ("一下", "什么", "介绍", "哪些", "如何", "怎么", "是否", "有关", "相关", "说明")
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096
#: Similarities that a task's Python holds at once, eight bytes each.
SIMILARITIES = 1 << 21
#: Fixed values of the fusion: rank constant, channel weights, least similarity.
RANK_BASE, TERM_WEIGHT, SEMANTIC_WEIGHT, CONFIDENCE_WEIGHT, LEAST_SIMILARITY = 60, 0.5, 0.8, 0.5, 0.2
#: First lines that open front matter.
FRONT_MATTER = ("document history", "contents", "目录", "version")


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf over all chunks, for an index that is written once."""
    return chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def _occurrences(joined: Column, words: list[str]) -> Column:
    """How often a phrase stands in tokens that two spaces part and one opens and closes."""
    phrase = f" {'  '.join(words)} "
    if any(words[:k] == words[-k:] for k in range(1, len(words))):  # occurrences of the phrase can share words
        return F.regexp_count(joined, F.lit("(?=" + re.escape(phrase) + ")")).cast("long")
    return ((F.length(joined) - F.length(F.replace(joined, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def phrase_counts(chunks: DataFrame, phrases: list[str]) -> tuple[DataFrame, list[bool]]:
    """doc_id, chunk_id, len (in tokens) and tf_0, tf_1, … of the phrases in every chunk, in one pass over the texts and
    written to the shared folder; and which phrases have tokens at all."""
    spark = chunks.sparkSession
    split = [r[0] for r in spark.range(1).select(F.explode(F.array(*[tokens(F.lit(p)) for p in phrases]))).collect()]
    plain = F.trim(F.regexp_replace(folded(F.col("text")), r"[^\p{L}\p{N}]+", "  "))
    joined = chunks.select("doc_id", "chunk_id", F.concat(F.lit(" "), plain, F.lit(" ")).alias("j"))
    length = F.when(F.length("j") <= 2, 0).otherwise(F.length("j") - F.length(F.replace("j", F.lit("  "), F.lit(" "))) + 1)
    tfs = [(_occurrences(F.col("j"), list(w)) if w else F.lit(0).cast("long")).alias(f"tf_{i}") for i, w in enumerate(split)]
    return materialize(joined.select("doc_id", "chunk_id", length.cast("long").alias("len"), *tfs), "phrases"), [bool(w) for w in split]


def bm25_scores(counts: DataFrame, number: int = 0) -> DataFrame:
    """doc_id, chunk_id, tf and score of the chunks that hold phrase `number` of phrase_counts; the smallest is the best."""
    tf = F.col(f"tf_{number}")
    n, avg_len, df = counts.agg(F.count("*"), F.avg("len"), F.count_if(tf > 0)).first()
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
    score = F.lit(-idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(avg_len or 1.0)))
    return counts.where(tf > 0).select("doc_id", "chunk_id", tf.alias("tf"), score.alias("score"))


def bm25_phrase(chunks: DataFrame, phrase: str, limit: int | None = 20, doc_ids: list | None = None) -> DataFrame:
    """doc_id, chunk_id, tf and score of the chunks that hold the phrase, of these documents if they are named; ties go by id.
    Frequencies and lengths are those of all chunks."""
    found = bm25_scores(phrase_counts(chunks, [phrase])[0])
    found = found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))
    return found if limit is None else found.orderBy("score", "doc_id", "chunk_id").limit(limit)


def ascii_low(text: Column) -> Column:
    """Only A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring_hits(chunks: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Chunks that hold the query literally, ASCII case aside; most matched characters first, then shorter, then by id."""
    needle = "".join(c.lower() if c.isascii() else c for c in query)
    n = F.length("text")
    mass = F.length(ascii_low(F.col("text"))) - F.length(F.replace(ascii_low(F.col("text")), F.lit(needle), F.lit("")))
    found = chunks.where(F.contains(ascii_low(F.col("text")), F.lit(needle))).select("doc_id", "chunk_id", mass.cast("long").alias("matched"), n.cast("long").alias("text_length"))
    return found if limit is None else found.orderBy(F.desc("matched"), "text_length", "doc_id", "chunk_id").limit(limit)


def search_text(chunks: DataFrame, query: str, limit: int = 20, doc_ids: list | None = None) -> DataFrame:
    """chunk_id, rank and method: the phrase by BM25, then literal hits, each chunk once. CJK queries are literal only."""
    if not query.strip():
        return chunks.select("doc_id", "chunk_id", F.lit("").alias("method"), F.lit(0).alias("rank")).where("false")
    cjk = re.search(r"[㐀-鿿]", query) is not None
    scope = chunks if doc_ids is None else chunks.where(F.col("doc_id").isin(doc_ids))
    like = substring_hits(scope, query, limit + 1)
    ranked = like.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matched"), "text_length", "doc_id", "chunk_id")) + limit + 1).select("doc_id", "chunk_id", F.lit("like").alias("method"), "rank")
    if not cjk:
        fts = bm25_phrase(chunks, query, limit + 1, doc_ids)
        ranked = fts.withColumn("rank", F.row_number().over(Window.orderBy("score", "doc_id", "chunk_id"))).select("doc_id", "chunk_id", F.lit("fts").alias("method"), "rank").unionByName(ranked)
    best = ranked.groupBy("doc_id", "chunk_id").agg(F.min_by("method", "rank").alias("method"), F.min("rank").alias("r"))
    return best.orderBy("r").limit(limit).select("doc_id", "chunk_id", "method", F.row_number().over(Window.orderBy("r")).alias("rank"))


def query_terms(query: str, limit: int = 12) -> list[str]:
    """Search terms of one question: identifiers without stop words, then CJK segments and their bigrams, each once."""
    words = (w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]+", query))
    found = dict.fromkeys(w for w in words if w not in STOP_WORDS)
    for run in re.findall(r"[㐀-鿿]{2,}", query):
        for part in re.split("|".join(STOP_PHRASES), run):
            found |= dict.fromkeys(([part] if 2 <= len(part) <= 8 else []) + [part[i : i + 2] for i in range(len(part) - 1)])
    return [t for t in found if t][:limit]


def latin_terms(text: Column, limit: int = 12) -> Column:
    """The same for a column of questions in Latin script, as an expression."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]+)"), 1), lambda w: F.lower(w))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))), 1, limit)


def reciprocal_rank(rank: Column, weight: float) -> Column:
    return F.lit(weight) * (RANK_BASE + 1) / (RANK_BASE + rank)


def semantic_confidence(similarity: Column) -> Column:
    return F.least(F.greatest((similarity - LEAST_SIMILARITY) / (1 - LEAST_SIMILARITY), F.lit(0.0)), F.lit(1.0))


def fuse(channels: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """channels (id, channel, weight, rank): the best rank in each channel counts, weighted reciprocals are added up."""
    best = channels.groupBy(id_col, "channel").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    return best.groupBy(id_col).agg(F.sum(F.col("weight") * (RANK_BASE + 1) / (RANK_BASE + F.col("rank"))).alias("score"))


def hybrid_scores(text: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """keys and score of hits from text channels (keys, channel: text or term, rank) and from vectors (keys, rank, similarity).

    Of each channel the best rank counts, as a weighted reciprocal; a vector's hit counts only from a least similarity on, and
    adds its confidence."""
    least = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank")))
    by_text = text.groupBy(*keys).agg(least("text").alias("text_rank"), least("term").alias("term_rank"))
    by_vector = semantic.where(F.col("similarity") >= LEAST_SIMILARITY).groupBy(*keys).agg(F.min("rank").alias("semantic_rank"), F.max("similarity").alias("similarity"))
    part = lambda c, w: F.coalesce(reciprocal_rank(F.col(c), w), F.lit(0.0))
    score = part("text_rank", 1.0) + part("term_rank", TERM_WEIGHT) + part("semantic_rank", SEMANTIC_WEIGHT) + F.coalesce(semantic_confidence(F.col("similarity")) * CONFIDENCE_WEIGHT, F.lit(0.0))
    return by_text.join(by_vector, keys, "full").select(*keys, score.alias("score"))


def structural_score(query: str, text: Column, section: Column, chunk_type: Column | None = None, headers: Column | None = None, caption: Column | None = None, table_kind: Column | None = None, spans: Column | None = None) -> Column:
    """What a chunk's structure adds to its rank: overlap with the question's terms, headings, tables; front matter loses."""
    q, terms = query.strip().lower(), query_terms(query)
    low = F.lower(F.coalesce(text, F.lit("")))
    line = F.element_at(F.split(low, r"\r?\n"), 1)
    count = lambda c, t: sum((F.contains(c, F.lit(x)).cast("int") for x in t), F.lit(0))
    add = lambda cond, value: F.when(cond, value).otherwise(0.0)
    score = F.least(count(low, terms) * 0.45, F.lit(4.5)) + F.least(count(line, terms) * 0.6, F.lit(2.4))
    if q:
        score += add(F.contains(low, F.lit(q)), 1.0) + add(F.contains(line, F.lit(q)), 3.0)
        score += add(line.rlike(r"^\s*\d+(?:\.\d+){0,5}\s*\Q" + q.replace("\\E", "") + r"\E"), 2.0)
    score += add(section.isNotNull(), 0.5) - add(section.isNull() | (count(line, FRONT_MATTER) > 0), 1.0)
    if spans is not None:
        score += add(spans, 0.2)
    if chunk_type is not None and headers is not None:
        heads, cap = F.lower(F.array_join(headers, " ")), F.lower(F.coalesce(caption, F.lit("")))
        table = F.least(count(heads, terms) * 0.8, F.lit(4.0)) + add(table_kind != "generic_table", 0.6) + add(chunk_type == "logical_table", 0.8)
        if q:
            table += add(F.contains(cap, F.lit(q)), 2.0) + add(F.contains(heads, F.lit(q)), 1.4)
        score += add(chunk_type.isin("table", "logical_table"), table)
    return score


def within_budget(ranked: DataFrame, order: list[str], max_chars: int, max_chunks: int) -> DataFrame:
    """The prefix of ranked rows that fits both budgets. ranked holds a page of candidates, so one window takes it."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(F.length("text")).over(w)).withColumn("position", F.row_number().over(Window.orderBy(*order))).where((F.col("used") <= max_chars) & (F.col("position") <= max_chunks))


def keyset_page(chunks: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next page in order, after a key."""
    key = F.struct(*order)
    rows = chunks if after is None else chunks.where(key > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(limit)


def hash_encode(texts: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """id, bucket and value of the non-zero entries of hashed bag-of-words vectors of unit length."""
    words = texts.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"((?U)\w+)"), 1)).alias("w"))
    h = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
    summed = words.groupBy(id_col, (h % dim).alias("bucket")).agg(F.sum(F.when(h % 2 == 1, 1).otherwise(-1)).alias("v")).where("v <> 0")
    norm = summed.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return summed.join(norm, id_col).select(id_col, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def _unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of unit length; None for null, empty and zero ones."""
    out = []
    for v in column:
        x = np.array(v.as_py() or [], dtype=np.float64)
        n = np.sqrt((x * x).sum())
        out.append(x / n if n > 0 else None)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", allowed: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, similarity and rank of each query's k nearest vectors by exact cosine, ties by id.

    queries (query_id, query_vec) is a set that the caller states. It is gone through in blocks of `block` rows; a block is
    broadcast, each task multiplies it with its vectors, SIMILARITIES products at a time, and passes on its own k best, and
    those are ranked. The allow-list is applied before the ranking. Vectors of another length or without length have similarity 0."""
    spark = vectors.sparkSession
    rows = vectors if allowed is None else vectors.join(allowed, id_col, "left_semi")
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, similarity double"
    n = queries.count()
    parts = -(-n // block)
    out = empty_like(spark, schema)
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        table = own.select("query_id", "query_vec").toArrow()
        held = spark.sparkContext.broadcast((table.column(0).to_pylist(), table.schema.field(0).type, _unit_rows(table.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, names_kind, units = held.value
            asked = {size: [i for i, u in enumerate(units) if u is not None and len(u) == size] for size in {len(u) for u in units if u is not None}}
            stacked = {size: np.stack([units[i] for i in own]) for size, own in asked.items()}
            best: list[list[tuple]] = [[] for _ in names]
            least = np.full(len(names), -np.inf)  # of each query, the similarity of its k-th so far
            kind = None
            for batch in pieces(batches, rows=SIMILARITIES // max(1, len(names))):
                kind = batch.column(0).type
                ids, own = batch.column(0).to_pylist(), _unit_rows(batch.column(1))
                sims = np.zeros((len(names), len(ids)))
                for size, left in asked.items():
                    right = [j for j, u in enumerate(own) if u is not None and len(u) == size]
                    if right:
                        sims[np.ix_(left, right)] = stacked[size] @ np.stack([own[j] for j in right]).T
                np.round(sims, 6, out=sims)
                sims += 0.0
                for q in np.flatnonzero((sims >= least[:, None]).any(axis=1)):
                    bound = max(least[q], np.partition(sims[q], len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf)
                    best[q] = sorted([*best[q], *((-sims[q, j], ids[j]) for j in np.flatnonzero(sims[q] >= bound))])[:k]
                    least[q] = -best[q][-1][0] if len(best[q]) == k else -np.inf
            if kind is not None:
                flat = [(name, i, -s) for name, own in zip(names, best, strict=True) for s, i in own]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], names_kind), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.float64())], ["query_id", "id", "similarity"])

        out = out.unionByName(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL").mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stale_items(desired: DataFrame, stored: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Items to encode (missing or changed) and to prune (no longer wanted), by content hash."""
    d, s = desired.select(F.col(id_col).alias("d_id"), F.col("content_hash").alias("d_hash")), stored.select(F.col(id_col).alias("s_id"), F.col("content_hash").alias("s_hash"))
    state = F.when(F.col("s_id").isNull(), "missing").when(F.col("d_id").isNull(), "prune").when(~F.col("d_hash").eqNullSafe(F.col("s_hash")), "stale")
    return d.join(s, F.col("d_id") == F.col("s_id"), "full").select(F.coalesce("d_id", "s_id").alias(id_col), state.alias("action")).where("action IS NOT NULL")


def entity_cascade(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entities by exact name, else by alias, else by qualified name, else by substring: only the first tier with hits."""
    q = F.lit(query)
    low = F.lower(F.lit(query))
    tier = (
        F.when(F.col("name") == q, 1).when(F.array_contains("aliases", q), 2).when(F.col("qualified_name") == q, 3)
        .when(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("qualified_name", F.lit(""))), low), 4)
    )
    hits = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier")).first()[0]
    return hits.where(F.col("tier") == F.lit(best)).orderBy("name", "id").limit(limit)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
