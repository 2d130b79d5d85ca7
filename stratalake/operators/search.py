"""Search through an index that is written once: postings with upper bounds, a dictionary, and chunks and evidence by buckets.

A posting row holds the chunks of one term and one block whose contribution to BM25 lies between the same two levels, with the
largest of them: the chunks by number (refs), where their places end in the row, and the places. Table refs tells the numbers. The rows of a term are sorted by it, so that a search for the k best reads a term's rows from a bound on,
and goes lower only if these hold fewer than k hits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from stratalake.core.storage import materialize
from stratalake.functions.text import tokens
from stratalake.operators.retrieval import B, K1, LEAST_IDF, substring_hits

#: Levels of a contribution (of K1 + 1 at most), and tokens of a block: a posting row is of one block of chunks.
LEVELS, BLOCK_TOKENS = 64, 1 << 21
#: A term that fewer chunks of a block hold has one row there, at the least of their levels.
LEAST_CHUNKS = 64
#: Tokens and bytes for each bucket of the written tables; there are MOST_BUCKETS at most.
BUCKET_TOKENS, BUCKET_BYTES, MOST_BUCKETS = 20_000_000, 128 << 20, 4096
#: Up to so many files of a table each task writes its rows to their buckets itself; beyond, they are moved by bucket first.
MOST_FILES = 8192
#: The first bound leaves so many times the wanted hits; each further round so many times more.
FIRST_ROUND, NEXT_ROUND = 4, 16
#: A substring that so many dictionary terms hold at most is looked up by them, else in the texts.
MOST_EXPANSIONS = 10_000
#: Ids that are looked up by a list in the scan's filter; beyond, by a join.
LISTED_IDS = 2_000


def _home(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets(size: float, each: int) -> int:
    return max(1, min(MOST_BUCKETS, math.ceil(size / each)))


def _write(df: DataFrame, key: str, buckets: int, order: list[str], path: str, number: str | None = None) -> None:
    """By buckets of a key, sorted within files; rows that are moved for it have as many writers a bucket as its bytes ask for.
    number: a column that numbers the rows as they are written."""
    homed = df.withColumn("bucket", _home(key, buckets))
    spread = homed if buckets * df.rdd.getNumPartitions() <= MOST_FILES else homed.hint("rebalance", "bucket")
    spread = spread.sortWithinPartitions("bucket", *order)
    numbered = spread if number is None else spread.withColumn(number, F.monotonically_increasing_id())
    numbered.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def _block_rows(refs: pa.Array, words: pa.Array, mean: float) -> pa.RecordBatch:
    """The posting rows of one block of chunks: tokens by term and chunk, then by term and level."""
    codes = (coded := words.flatten().dictionary_encode()).indices.to_numpy()
    lengths = words.value_lengths().to_numpy().astype(np.int64)
    chunk, starts = np.repeat(np.arange(len(refs)), lengths), np.cumsum(lengths) - lengths
    by_term = np.argsort(codes, kind="stable")
    codes, chunk, at = codes[by_term], chunk[by_term], (np.arange(len(codes)) - np.repeat(starts, lengths))[by_term].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])])
    tf, term, chunk = np.diff(np.r_[first, len(codes)]), codes[first], chunk[first]
    most = contribution(tf, lengths[chunk], mean)
    level = np.floor(most * LEVELS).astype(np.int64)
    own = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    held = np.diff(np.r_[own, len(term)])
    level = np.where(np.repeat(held < LEAST_CHUNKS, held), np.repeat(np.minimum.reduceat(level, own), held), level)
    order = np.lexsort((level, term))
    term, level, chunk, most, tf, first = term[order], level[order], chunk[order], most[order], tf[order], first[order]
    row = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (level[1:] != level[:-1])])
    bounds, upto = np.r_[row, len(term)], np.r_[0, np.cumsum(tf)]
    places = at[np.arange(len(at)) + np.repeat(first - upto[:-1], tf)]
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
    ends = (upto[1:] - np.repeat(upto[row], np.diff(bounds))).astype(np.int32)
    columns = [coded.dictionary.take(pa.array(term[row])), pa.array(level[row]), pa.array(np.maximum.reduceat(most, row)), pa.array(np.diff(bounds)), listed(bounds, refs.to_numpy()[chunk]), listed(bounds, ends), listed(upto[bounds], places)]
    return pa.RecordBatch.from_arrays(columns, ["term", "level", "most", "n", "refs", "ends", "places"])


def posting_rows(chunks: DataFrame, mean: float) -> DataFrame:
    """term, level, most, n, refs, ends and places of chunks (ref, text). A task inverts its chunks in blocks of some BLOCK_TOKENS
    tokens, so that what is moved by term afterwards are rows of many chunks and not tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = min(batch.num_rows, int(np.searchsorted(ends, done + BLOCK_TOKENS - size)) + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - done)
                at = to
                if size >= BLOCK_TOKENS:
                    yield from inverted(held)
                    held, size = [], 0
        yield from inverted(held)

    def inverted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            rows = _block_rows(*[pa.concat_arrays(whole.column(k).chunks) for k in range(2)], mean)
            yield from (rows.slice(k, 10_000) for k in range(0, rows.num_rows, 10_000))

    schema = "term string, level long, most double, n long, refs array<long>, ends array<int>, places array<int>"
    return chunks.select("ref", tokens(F.col("text")).alias("w")).where(F.size("w") > 0).mapInArrow(run, schema)


def contribution(tf: Column | np.ndarray, length: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What BM25 multiplies the inverse document frequency with: grows with tf, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


def write_index(chunks: DataFrame, path: str, nodes: DataFrame | None = None) -> str:
    """Writes an index of chunks (doc_id, chunk_id, text and more) under path: postings, dictionary, chunks, statistics; with
    nodes (id and more; source_chunk_ids, source_block_ids), also what nodes each chunk and block is evidence of."""
    spark = chunks.sparkSession
    shelves = _buckets(chunks.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, BUCKET_BYTES)
    _write(chunks, "chunk_id", shelves, ["chunk_id"], f"{path}/chunks", "ref")
    chunks = spark.read.schema(StructType([*chunks.schema, StructField("ref", LongType())])).parquet(f"{path}/chunks")
    chunks.select("ref", "doc_id", "chunk_id", F.size(tokens(F.col("text"))).alias("len")).write.parquet(f"{path}/refs")
    n, total = spark.read.parquet(f"{path}/refs").agg(F.count("*"), F.sum(F.col("len").cast("long"))).first()
    mean, buckets = (total or 0) / n if n else 0.0, _buckets(total or 0, BUCKET_TOKENS)
    _write(posting_rows(chunks, mean), "term", buckets, ["term", "most"], f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    document_sums(chunks).write.parquet(f"{path}/documents")
    spark.createDataFrame([(n, float(mean), buckets, shelves, nodes is not None)], "n long, mean double, buckets int, shelves int, with_nodes boolean").coalesce(1).write.parquet(f"{path}/stats")
    if nodes is not None:
        ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in nodes.columns else F.array().cast("array<string>")
        refs = F.array_distinct(F.concat(F.transform(ids("source_chunk_ids"), lambda x: F.concat(F.lit("chunk\x00"), x)), F.transform(ids("source_block_ids"), lambda x: F.concat(F.lit("block\x00"), x))))
        _write(nodes.select("id", F.explode(refs).alias("ref")), "ref", shelves, ["ref", "id"], f"{path}/evidence")
        _write(nodes, "id", shelves, ["id"], f"{path}/nodes")
    return path


def document_sums(chunks: DataFrame) -> DataFrame:
    """For each document its chunks, characters, and what audits.corpus_stats adds up for a snapshot."""
    h = F.sha2(F.concat_ws("\x00", "chunk_id", "text").cast("binary"), 256)
    pieces = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"piece_{i}") for i in range(4)]
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"), *pieces)


def corpus_sums(by_document: DataFrame, doc_ids: list | None) -> dict:
    """total_docs, total_chunks, total_chars and snapshot of a scope, from sums by document."""
    own = by_document if doc_ids is None else by_document.where(F.col("doc_id").isin(doc_ids))
    snapshot = F.sha2(F.concat_ws(":", *[F.sum(f"piece_{i}").cast("string") for i in range(4)]).cast("binary"), 256)
    return own.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"), snapshot.alias("snapshot")).first().asDict()


@dataclass(frozen=True)
class Index:
    """A written index and its statistics, which are one row."""

    spark: SparkSession
    path: str
    n: int
    mean: float
    buckets: int
    shelves: int
    with_nodes: bool
    opened: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def table(self, name: str) -> DataFrame:
        """One of the written tables; its files are listed once for all searches."""
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.opened[name]

    def rows_of(self, name: str, key: str, values: list, buckets: int) -> DataFrame:
        """The rows of a table with these keys: only their buckets are read, and of those the row groups that can have them."""
        table = self.table(name)
        if not values:
            return table.where("false").drop("bucket")
        kind = dict(table.dtypes)[key]
        asked = self.spark.createDataFrame([(v,) for v in values], f"{key} {kind}")
        homes = [0] if buckets == 1 else [r[0] for r in asked.select(_home(key, buckets)).distinct().collect()]
        found = table.where(F.col("bucket").isin(homes)).drop("bucket")
        if len(values) <= LISTED_IDS:
            return found.where(F.col(key).isin(values))
        return found.join(F.broadcast(asked.distinct()), key, "left_semi")

    def chunks(self, ids: list) -> DataFrame:
        """Of a bounded list of ids."""
        return self.rows_of("chunks", "chunk_id", ids, self.shelves).drop("ref")

    def all_chunks(self) -> DataFrame:
        return self.table("chunks").drop("bucket", "ref")

    def by_document(self) -> DataFrame:
        return self.table("documents")

    def search_text(self, query: str, limit: int, doc_ids: list | None) -> tuple[DataFrame, list[str], bool]:
        return search_text(self, query, limit, doc_ids)

    def entities(self, refs: list[str]) -> DataFrame | None:
        """The nodes that these chunks and blocks, a page's, are evidence of; None without nodes in the index."""
        if not self.with_nodes:
            return None
        ids = [r[0] for r in self.rows_of("evidence", "ref", refs, self.shelves).select("id").distinct().collect()]
        return self.rows_of("nodes", "id", ids, self.shelves)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, path, *spark.read.parquet(f"{path}/stats").first())


def _words(index: Index, phrase: str) -> list[str]:
    return index.spark.range(1).select(tokens(F.lit(phrase))).first()[0]


def _postings(index: Index, words: list[str], least: float) -> DataFrame:
    found = index.rows_of("postings", "term", sorted(set(words)), index.buckets)
    return found.where(F.col("most") >= least) if least > 0 else found


def _matches(index: Index, words: list[str], least: float, doc_ids: list | None) -> DataFrame:
    """doc_id, chunk_id, len, tf of the chunks that hold the words one after another, from postings with a bound of at least
    `least`: complete for phrases that contribute as much, since a phrase stands in a chunk no more often than its words."""
    own = index.spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    rows = _postings(index, words, least)
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    refs = index.table("refs")
    if doc_ids is not None:
        refs = refs.where(F.col("doc_id").isin(doc_ids))
    if len(words) == 1:
        entry = F.transform("refs", lambda r, i: F.struct(r.alias("ref"), (F.get("ends", i) - start(i)).cast("long").alias("tf")))
        found = rows.select(F.explode(entry).alias("e")).select("e.*")
    else:
        entry = F.transform("refs", lambda r, i: F.struct(r.alias("ref"), F.slice("places", start(i) + 1, F.get("ends", i) - start(i)).alias("places")))
        starts = rows.select("term", F.explode(entry).alias("e")).join(F.broadcast(own), F.col("term") == F.col("word")).select("e.ref", "i", F.explode("e.places").alias("at"))
        whole = starts.groupBy("ref", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("k")).where(F.col("k") == len(words))
        found = whole.groupBy("ref").agg(F.count("*").alias("tf"))
    return found.join(refs, "ref").select("doc_id", "chunk_id", "len", "tf")


def _bounds(index: Index, words: list[str], k: int) -> list[float]:
    """Falling bounds: from each on, every word has at least FIRST_ROUND * k chunks, then NEXT_ROUND times as many, and last
    all. From the rows' levels and numbers alone, LEVELS * (K1 + 1) rows a word."""
    levels = _postings(index, words, 0.0).groupBy("term", "level").agg(F.sum("n").alias("n")).collect()
    if len({r["term"] for r in levels}) < len(set(words)):
        return []
    out, wanted = [], FIRST_ROUND * k
    while True:
        lowest = math.inf
        for word in set(words):
            held, reached = 0, None
            for r in sorted((r for r in levels if r["term"] == word), key=lambda r: -r["level"]):
                held += r["n"]
                if held >= wanted:
                    reached = r["level"]
                    break
            lowest = min(lowest, reached if reached is not None else 0)
        out.append(lowest / LEVELS)
        if lowest <= 0:
            return out
        wanted *= NEXT_ROUND


def top_hits(index: Index, phrase: str, k: int, doc_ids: list | None = None) -> DataFrame:
    """doc_id, chunk_id, tf, rank of the k chunks that BM25 puts first for the phrase; ties go by id. Its idf is the same for
    all hits of a phrase, so it isn't asked for, and postings that can't reach the k-th hit aren't read."""
    words = _words(index, phrase)
    order = [F.desc("contribution"), "doc_id", "chunk_id"]
    found = None
    for least in _bounds(index, words, k) if words else []:
        hits = _matches(index, words, least, doc_ids).withColumn("contribution", contribution(F.col("tf"), F.col("len"), index.mean))
        found = materialize(hits.where(F.col("contribution") >= least).orderBy(*order).limit(k), "index-hits")
        if found.count() == k:
            break
    if found is None:
        chunks = index.table("chunks")
        return chunks.select("doc_id", "chunk_id", F.lit(0).cast("long").alias("tf"), F.lit(0).alias("rank")).where("false")
    return found.select("doc_id", "chunk_id", "tf", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def phrase_scores(index: Index, phrase: str, limit: int | None = 20) -> DataFrame:
    """doc_id, chunk_id, tf and score of the chunks that hold the phrase, as bm25_phrase has them: all, or the `limit` best."""
    words = _words(index, phrase)
    counts = materialize(_matches(index, words, 0.0, None), "index-hits") if words else index.table("chunks").select("doc_id", "chunk_id", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("tf")).where("false")
    df = counts.count()
    idf = max(math.log((index.n - df + 0.5) / (df + 0.5)), LEAST_IDF) if index.n else LEAST_IDF
    score = F.lit(-idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(index.mean or 1.0)))
    out = counts.select("doc_id", "chunk_id", "tf", score.alias("score"))
    return out if limit is None else out.orderBy("score", "doc_id", "chunk_id").limit(limit)


def literal_hits(index: Index, query: str, limit: int | None, doc_ids: list | None = None) -> DataFrame:
    """What substring_hits gives, from an index: the dictionary tells which terms can hold the query's pieces, the postings of
    the rarest piece tell the chunks, and these are read and looked through. Queries with letters that folding could part
    otherwise than the text (neither ASCII nor CJK), without a letter or digit, or in very many terms, go over all chunks."""
    table = index.table("chunks").drop("bucket")
    if doc_ids is not None:
        table = table.where(F.col("doc_id").isin(doc_ids))
    pieces = _words(index, query)
    plain = all(c.isascii() or "㐀" <= c <= "鿿" for c in query)
    if not pieces or not plain:
        return substring_hits(table, query, limit)
    opens, closes = query[0].isalnum(), query[-1].isalnum()
    term = F.col("term")
    tests = []
    for i, p in enumerate(pieces):
        loose_left, loose_right = i == 0 and opens, i == len(pieces) - 1 and closes
        tests.append(F.contains(term, F.lit(p)) if loose_left and loose_right else F.endswith(term, F.lit(p)) if loose_left else F.startswith(term, F.lit(p)) if loose_right else term == p)
    terms = index.table("terms")
    sums = terms.agg(*[f for i, t in enumerate(tests) for f in (F.count_if(t).alias(f"kinds_{i}"), F.coalesce(F.sum(F.when(t, F.col("df"))), F.lit(0)).alias(f"df_{i}"))]).first()
    best = min(range(len(pieces)), key=lambda i: (sums[f"df_{i}"], i))
    if sums[f"kinds_{best}"] > MOST_EXPANSIONS:
        return substring_hits(table, query, limit)
    names = [r[0] for r in terms.where(tests[best]).select("term").collect()]
    entries = index.rows_of("postings", "term", names, index.buckets).select(F.explode("refs").alias("ref")).distinct()
    return substring_hits(table.join(entries, "ref", "left_semi"), query, limit)


def search_text(index: Index, query: str, limit: int, doc_ids: list | None = None) -> tuple[DataFrame, list[str], bool]:
    """doc_id, chunk_id, method and rank: the phrase by BM25, then literal hits where those are too few, each chunk once; CJK
    queries are literal only. With it the methods that found any, and whether there were more hits than asked for."""
    spark = index.spark
    empty = spark.createDataFrame([], index.chunks([]).select("doc_id", "chunk_id").schema).select("doc_id", "chunk_id", F.lit("").alias("method"), F.lit(0).alias("rank"))
    if not query.strip() or doc_ids == []:
        return empty, [], False
    cjk = any("㐀" <= c <= "鿿" for c in query)
    phrase = empty if cjk else materialize(top_hits(index, query, limit + 1, doc_ids).select("doc_id", "chunk_id", F.lit("fts").alias("method"), "rank"), "text-hits")
    found = 0 if cjk else phrase.count()
    like, more = empty, 0
    if found <= limit:
        order = Window.orderBy(F.desc("matched"), "text_length", "doc_id", "chunk_id")
        like = materialize(literal_hits(index, query.strip(), limit + 1, doc_ids).select("doc_id", "chunk_id", F.lit("like").alias("method"), (F.row_number().over(order) + limit + 1).alias("rank")), "text-hits")
        more = like.count()
    best = phrase.unionByName(like).groupBy("doc_id", "chunk_id").agg(F.min_by("method", "rank").alias("method"), F.min("rank").alias("r"))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("r"))).where(F.col("rank") <= limit).select("doc_id", "chunk_id", "method", "rank")
    return ranked, ["fts"] * (found > 0) + ["like"] * (more > 0), max(found, more) > limit
