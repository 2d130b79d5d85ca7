"""I-Match fingerprints with randomised lexicons."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from stratalake.core.storage import materialize
from stratalake.llm.words import batches_of, hashed_words, mix64, powers

#: A term is in the lexicon if the share of documents that hold it lies in this band. Documents of w distinct words on
#: average have at most w / LOW_SHARE such terms, however many documents there are: that bounds what is broadcast.
LOW_SHARE, HIGH_SHARE = 0.0005, 0.2
#: Each subset keeps a term of the lexicon by chance; subset k keeps 2 ** -(k % LEVELS + 1) of the terms.
SUBSETS, LEVELS = 160, 10
#: Ranges of ids at most: the driver holds some rows for each. Beyond that the ranges become larger; a task goes through its
#: range row by row, so it needs more time and disk for it, not more memory.
MAX_RANGES = 1 << 16
#: Rows that are drawn for each range to find its bounds.
SAMPLES = 16
#: Distinct terms of a document that are looked at together.
TERMS = 4096


def _fields() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each subset the bits of a term's hashes that have to be 0: which hash, where they begin, and a mask. No two
    subsets share a bit."""
    hashes, shifts, masks = [], [], []
    number = used = 0
    for k in range(SUBSETS):
        bits = k % LEVELS + 1
        if used + bits > 64:
            number, used = number + 1, 0
        hashes.append(number)
        shifts.append(used)
        masks.append((1 << bits) - 1)
        used += bits
    return np.array(hashes), np.array(shifts, dtype=np.uint64)[:, None], np.array(masks, dtype=np.uint64)[:, None]


_HASH, _SHIFT, _MASK = _fields()
_SEEDS = mix64(np.arange(1, _HASH[-1] + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (a hash) and df, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def gather() -> None:
            nonlocal terms, counts, waiting, held
            new, n = np.unique(np.concatenate([terms, *waiting]), return_counts=True)
            n[np.searchsorted(new, terms)] += counts - 1
            terms, counts, waiting, held = new, n, [], 0

        for batch in batches:
            for _, texts in batches_of(batch.column(0).to_pylist()):
                words, bounds = hashed_words(texts)
                waiting += [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                held += sum(map(len, waiting[-len(texts) :]))
                if held > 1 << 20:
                    gather()
                if len(terms) > 1 << 21:  # as much as a task holds at once
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])
                    terms, counts = terms[:0], counts[:0]
        if waiting:
            gather()
        for at in range(0, len(terms), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["term", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE) -> np.ndarray:
    """The sorted hashes of the terms in the band: at most (distinct words a document) / low."""
    n = docs.count()
    band = document_frequencies(docs, text_col).where((F.col("df") >= low * n) & (F.col("df") <= high * n))
    return np.sort(band.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def signatures(words: np.ndarray, text: bytes, lexicon: np.ndarray) -> np.ndarray:
    """SUBSETS signatures of 32 bits; 0 for a subset that holds none of the document's terms.

    A signature is a hash of the sequence of the document's sorted distinct terms in the subset. A document without terms of
    the lexicon is taken by all its terms, one without words by its text as a whole."""
    distinct = np.unique(words)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, distinct), len(lexicon) - 1)
        known = distinct[lexicon[at] == distinct]
    else:
        known = distinct[:0]
    if not len(known):
        known = distinct
    if not len(known):
        whole = np.frombuffer(hashlib.sha256(text).digest()[:8], dtype=np.uint64)
        return _short(np.repeat(whole, SUBSETS))
    subset, term = [], []
    for at in range(0, len(known), TERMS):
        mixed = mix64(known[None, at : at + TERMS] ^ _SEEDS[:, None])
        k, t = np.nonzero(((mixed[_HASH] >> _SHIFT) & _MASK) == 0)
        subset.append(k)
        term.append(known[at + t])
    k, terms = np.concatenate(subset), np.concatenate(term)
    if len(subset) > 1:
        order = np.argsort(k, kind="stable")
        k, terms = k[order], terms[order]
    out = np.zeros(SUBSETS, dtype=np.uint64)
    if len(k):
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        place = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
        out[k[begin]] = _short(np.add.reduceat(mix64(terms) * powers(int(place.max()) + 1)[place], begin))
    return out


def _short(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes) % np.uint64(2**32 - 1) + np.uint64(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the subsets in which either has terms, the share in which the signatures agree."""
    either = (a != 0) | (b != 0)
    return float((a[either] == b[either]).sum() / either.sum()) if either.any() else float((a == b).all())


def as_text(signature: np.ndarray) -> str:
    """Eight hexadecimal digits for each subset."""
    return signature.astype(">u4").tobytes().hex()


def _in_ranges(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int) -> DataFrame:
    """All rows in ranges of (id, hash of the text, row), descending within each, and with each range the row that comes
    after its last one: the first of the next lower range.

    The bounds are quantiles of drawn rows, so a frequent id, or a third of all rows without one, fills several ranges; the
    row's number tells even equal rows apart."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    ident = F.col(id_col).cast("long" if isinstance(kind, IntegralType) else "string").alias("ident")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), ident, F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keys = materialize(own.select("ident", "hash", "row"), "imatch-keys")
    n = keys.count()
    pieces = min(max(1, n // rows_per_range), MAX_RANGES)
    draw = F.shiftrightunsigned(F.xxhash64("hash", "row"), 11) / float(2**53)
    drawn = keys.where(draw < F.lit(min(1.0, SAMPLES * pieces / max(1, n)))).collect() if pieces > 1 else []
    in_order = sorted(drawn, key=lambda r: (r["ident"] is not None, 0 if r["ident"] is None else r["ident"], r["hash"], r["row"]))
    cuts = [in_order[len(in_order) * i // pieces] for i in range(1, pieces)] if in_order else []
    cuts = [c for i, c in enumerate(cuts) if not i or c["row"] != cuts[i - 1]["row"]]
    rng = F.lit(0)
    if cuts:
        fields = f"ident:{'bigint' if isinstance(kind, IntegralType) else 'string'},hash:bigint,row:bigint"
        table = F.from_json(F.lit(json.dumps([{k: v for k, v in c.asDict().items() if v is not None} for c in cuts])), f"array<struct<{fields}>>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        # How many cuts lie at or below the row, by bisection.
        below = lambda at, s: (at + s <= len(cuts)) & (F.element_at(table, F.least(at + s, F.lit(len(cuts)))) <= F.struct("ident", "hash", "row"))
        rng = F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at, s), at + s).otherwise(at))
    tops = keys.withColumn("rng", rng).groupBy("rng").agg(F.max(F.struct("ident", "hash", "row"))["row"].alias("top")).collect()
    tops = sorted((r["rng"], r["top"]) for r in tops)
    if not tops:
        return own.select("id", "text", F.lit(0).alias("rng"), F.lit(False).alias("border"))
    # The first row of a range comes after the last one of the next higher range; that of the highest after the lowest's.
    border = [(rng, top, tops[(i + 1) % len(tops)][0]) for i, (rng, top) in enumerate(tops)]
    known = spark.createDataFrame(border, "b_rng int, b_row long, b_over int")  # a row for each range
    own = own.withColumn("rng", rng.cast("int"))
    copies = own.join(F.broadcast(known), (F.col("rng") == F.col("b_rng")) & (F.col("row") == F.col("b_row"))).select("id", "text", "ident", "hash", "row", F.col("b_over").alias("rng"), F.lit(True).alias("border"))
    every = own.withColumn("border", F.lit(False)).unionByName(copies)
    # A partition for each range.
    laid = every.repartitionById(tops[-1][0] + 1, F.col("rng")).sortWithinPartitions("rng", "border", F.desc_nulls_last("ident"), F.desc("hash"), F.desc("row"))
    return laid.select("id", "text", "rng", "border")


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE, rows_per_range: int = 8192) -> DataFrame:
    """A row for each document: the fingerprints of its text and its edited text, and how alike they are.

    The lexicon holds the terms whose document frequency, over all documents, lies in the band from low to high. A
    document's distinct terms of the lexicon are sorted and, for each of the randomised subsets of the lexicon, those
    in the subset are hashed to a signature; the fingerprint is the signatures in a row. Equal texts have equal
    fingerprints; likeness is the share of equal signatures.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending order of id, or all of it; after the last comes the first. A single document is its own next. Documents of
    equal id follow each other by descending XXH64 of the text; null ids come last. Ids that are no integers are ordered as
    strings. Null texts count as empty. An empty table gives an empty result; other columns are not read.
    """
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, low, high))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = words.value
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        waiting: tuple | None = None  # a row whose next one hasn't come yet
        at = None
        out: list[tuple] = []

        def edited(row: tuple, after: str) -> tuple:
            ident, text, print_ = row
            n = len(text)
            cut = n // 2
            new = (text[: n - cut] + after[:cut]).encode("utf-8", "surrogatepass")
            return ident, n, hashlib.sha256(new).hexdigest(), new, print_

        def finish(rows: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
            done = []
            for start, texts in batches_of([r[0][3].decode("utf-8", "surrogatepass") for r in rows]):
                hashes, bounds = hashed_words(texts)
                for k, t in enumerate(texts):
                    (ident, n, sha, _, mine), after = rows[start + k]
                    theirs = signatures(hashes[bounds[k] : bounds[k + 1]], t, terms)
                    done.append((ident, n, sha, as_text(mine), as_text(theirs), likeness(mine, theirs), likeness(mine, after)))
            types = [schema_id, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            schema_id = batch.column(0).type
            ids, texts, rngs, borders = (batch.column(i).to_pylist() for i in range(4))
            for start, run_of in batches_of(texts):
                hashes, bounds = hashed_words(run_of)
                for k, raw in enumerate(run_of):
                    i = start + k
                    row = (ids[i], texts[i] or "", signatures(hashes[bounds[k] : bounds[k + 1]], raw, terms))
                    if waiting is not None and at == rngs[i]:
                        out.append((edited(waiting, row[1]), row[2]))
                    waiting, at = None if borders[i] else row, rngs[i]
                    if len(out) >= 1024:
                        yield finish(out)
                        out = []
        if out:
            yield finish(out)

    schema = f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    laid = _in_ranges(docs, id_col, text_col, rows_per_range)
    return laid.select("id", "text", "rng", "border").mapInArrow(run, schema.replace(id_col, "id", 1)).withColumnRenamed("id", id_col)
