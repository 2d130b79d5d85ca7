"""Language identification by interpolated Kneser-Ney models of characters, kept in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.llm.words import mix64

ORDER = 4
#: Entries of the models that are in memory at once. Where the corpus has more, the texts go through the models block by
#: block; no entry is left out.
BLOCK_ENTRIES = 2_000_000
#: N-grams that a task adds up before it passes them on.
TASK_ENTRIES = 1 << 21
#: Training texts, drawn by a hash, on which the calibration of scores and the rejection are fitted, and from which no
#: n-gram is counted: some so many, but at most a tenth.
CALIBRATION_ROWS, CALIBRATION_PART = 2000, 0.1
#: Of the calibration texts of a language, so many in a thousand have a higher cross-entropy than its limit.
REJECTED_PER_MILLE = 2
#: Code points are hashed to 16 bits; letters in the basic plane keep theirs.
_SPACE = 0x20

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower case if it is a letter, else a space."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x10000, _SPACE, dtype=np.uint64)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        _LETTER = table
    return _LETTER


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters, lower-cased, with single spaces between words and three before each text; the texts' bounds
    in them; whether a text has a letter."""
    joined = "\x00\x00\x00".join(["", *[t or "" for t in texts], ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wide = raw >= 0x10000
    if wide.any():
        big = np.array([ord(c.lower()) if c.isalpha() else _SPACE for c in map(chr, raw[wide].tolist())], dtype=np.uint64)
    chars = _letters()[np.minimum(raw, 0xFFFF)]
    if wide.any():
        chars[wide] = np.where(big >= 0x10000, 0xE000 + big % np.uint64(0x1800), big)
    sizes = np.array([len(t or "") + 3 for t in texts], dtype=np.int64)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), sizes), np.full(3, len(texts))])
    pad = raw == 0
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != _SPACE) | (chars[:-1] != _SPACE) | (pad[1:] & (owner[1:] == owner[:-1]))
    # Three spaces open each text, so that its first letter has a whole context.
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(3):
        keep[first + k] = True
    chars, owner = chars[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    counts = np.add.reduceat(np.concatenate([chars != _SPACE, [False]]).astype(np.int64), np.minimum(bounds[:-1], len(chars)))
    return chars, bounds, counts > 0


def grams(chars: np.ndarray) -> np.ndarray:
    """For each place the last ORDER characters up to it, 16 bits each, in a 64-bit key."""
    out = chars.copy()
    for k in range(1, ORDER):
        out[k:] |= chars[:-k] << np.uint64(16 * k)
        out[:k] |= np.uint64(_SPACE) << np.uint64(16 * k)
    return out


def _scored(bounds: np.ndarray, total: int) -> np.ndarray:
    """The places that count: all but the spaces that open each text."""
    mask = np.ones(total, dtype=bool)
    mask[bounds[-1] :] = False
    for k in range(3):
        mask[np.minimum(bounds[:-1] + k, total - 1)] = False
    return mask


def gram_counts(docs: DataFrame, text_col: str, lang_col: str, task_entries: int = TASK_ENTRIES) -> DataFrame:
    """lang, gram and n over all rows with a language, added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in held.items():
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[at : at + (1 << 16)])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            rows: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(lang, []).append(text or "")
            for lang, texts in rows.items():
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and size < 1 << 20:
                        size += len(texts[end])
                        end += 1
                    chars, bounds, _ = characters(texts[at:end])
                    new, n = np.unique(grams(chars)[_scored(bounds, len(chars))], return_counts=True)
                    if lang in held:
                        old, m = held[lang]
                        both, where = np.unique(np.concatenate([old, new]), return_inverse=True)
                        held[lang] = both, np.bincount(where, weights=np.concatenate([m, n])).astype(np.int64)
                    else:
                        held[lang] = new, n
                    at = end
            if sum(len(keys) for keys, _ in held.values()) > task_entries:
                yield from told()
        yield from told()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _discounted(keys: np.ndarray, counts: np.ndarray, shift: int, discount: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams: (count - discount) / context's count, and the sorted contexts with the weight that they leave."""
    if discount is None:
        discount = _discount(int((counts == 1).sum()), int((counts == 2).sum()))
    contexts, where = np.unique(keys >> np.uint64(shift), return_inverse=True)
    whole = np.bincount(where, weights=counts)
    return np.maximum(counts - discount, 0) / whole[where], contexts, discount * np.bincount(where) / whole, where


class HashArray:
    """A sorted array of hashes. The top bits of a hash say where in the array its neighbours begin."""

    def __init__(self, keys: np.ndarray) -> None:
        """keys: distinct, at least one."""
        hashes = mix64(keys)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 1))
        buckets = np.arange((1 << (64 - int(self.shift))) + 1)
        self.starts = np.searchsorted((hashes[self.order] >> self.shift).astype(np.int64), buckets).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' indices as they were given, -1 for a key that isn't there."""
        h = mix64(keys)
        at = self.starts[(h >> self.shift).astype(np.int64)]
        got = self.hashes[at]
        rest = np.flatnonzero(got < h)
        while len(rest):
            at[rest] += 1
            got[rest] = self.hashes[at[rest]]
            rest = rest[got[rest] < h[rest]]
        found = (got == h) & (at < len(self.order))
        return np.where(found, self.order[np.minimum(at, len(self.order) - 1)], -1)


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Of ORDER-grams, the 12 bits by which they are dealt into blocks: six of the last character but one, then six of the
    one before it. All 4-grams with the same context, and all that end in the same 3-gram, are in one bucket."""
    return ((keys >> np.uint64(16) & np.uint64(63)) << np.uint64(6) | keys >> np.uint64(32) & np.uint64(63)).astype(np.int64)


@dataclass
class Whole:
    """What a block of a language's model takes from the whole corpus."""

    #: By order, the discount.
    discounts: dict[int, float]
    #: For orders 2 and 1, the sorted n-grams and how many left neighbours each has.
    low: dict[int, tuple[np.ndarray, np.ndarray]]


class CharModels:
    """The models of all languages over one sorted array of n-grams for each order, a column for each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], whole: dict[str, Whole] | None = None) -> None:
        """counts: for each language its sorted ORDER-grams and how often each occurs; of a block, with what the whole
        corpus gives."""
        self.langs = sorted(counts)
        if not counts:
            return
        tables = [self._train(*counts[x], whole and whole[x]) for x in self.langs]
        letters = len(np.unique(np.concatenate([t[0][0] for t in tables]))) + 1
        #: By order: n-grams; where to find them and the contexts; log probabilities; logs of the weight that a context
        #: leaves to the shorter one.
        self.keys, self.places, self.logs, self.rests = [], [], [], []
        floor = np.full((1, len(self.langs)), 1.0 / letters)
        for n in range(ORDER):
            keys = np.unique(np.concatenate([t[n][0] for t in tables]))
            contexts = np.unique(np.concatenate([t[n][2] for t in tables]))
            own = np.zeros((len(keys), len(self.langs)))
            rest = np.ones((len(contexts), len(self.langs)))
            for j, t in enumerate(tables):
                own[np.searchsorted(keys, t[n][0]), j] = t[n][1]
                rest[np.searchsorted(contexts, t[n][2]), j] = t[n][3]
            below = floor if n == 0 else self.probabilities(keys & np.uint64((1 << 16 * n) - 1), n - 1)
            # Each n-gram that any language has gets every language's interpolated probability.
            full = own + rest[np.searchsorted(contexts, keys >> np.uint64(16))] * below
            self.keys.append(keys)
            self.places.append((HashArray(keys), HashArray(contexts)))
            self.logs.append(np.log2(full).astype(np.float32))
            self.rests.append(np.log2(rest).astype(np.float32))
        self.floor = np.log2(floor).astype(np.float32)

    @staticmethod
    def _train(keys: np.ndarray, counts: np.ndarray, whole: Whole | None = None) -> list[tuple[np.ndarray, ...]]:
        """For each order: keys, discounted probabilities, contexts, weights left; lower orders count distinct left
        neighbours, as Kneser and Ney have it."""
        out = []
        for n in range(ORDER, 0, -1):
            if whole and n in whole.low:
                keys, counts = whole.low[n]
            own, contexts, rest, _ = _discounted(keys, counts, 16, whole and whole.discounts[n])
            out.append((keys, own, contexts, rest))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
        return out[::-1]

    def log_probabilities(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Rows of log2 p(last character | those before it), a column for each language; order from 0."""
        if order < 0:
            return np.repeat(self.floor, len(keys), axis=0)
        grams_at, contexts_at = self.places[order]
        at = grams_at.find(keys)
        out = self.logs[order].take(at, axis=0, mode="clip")
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = keys[miss]
            c = contexts_at.find(lost >> np.uint64(16))
            rest = np.where((c >= 0)[:, None], self.rests[order][c], np.float32(0))
            out[miss] = rest + self.log_probabilities(lost & np.uint64((1 << 16 * order) - 1), order - 1)
        return out

    def probabilities(self, keys: np.ndarray, order: int) -> np.ndarray:
        return np.exp2(self.log_probabilities(keys, order).astype(np.float64))

    def bits(self, texts: list[str | None], low: int = 0, high: int = 1 << 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits under each language of the characters in the buckets from low up to high, whether there is a letter, and
        how many characters count in all buckets."""
        chars, bounds, some = characters(texts)
        mask = _scored(bounds, len(chars))
        keys = grams(chars)
        bits = np.zeros((len(texts), len(self.langs)))
        n = np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
        if len(keys):
            keys, owner = keys[mask], np.repeat(np.arange(len(texts)), n)
            if (low, high) != (0, 1 << 12):
                bucket = _buckets(keys)
                here = (bucket >= low) & (bucket < high)
                keys, owner = keys[here], owner[here]
            logs = self.log_probabilities(keys, ORDER - 1)
            bits = -np.stack([np.bincount(owner, weights=logs[:, j], minlength=len(texts)) for j in range(len(self.langs))], axis=1)
        return bits, some, n


def _by_lang(rows: pd.DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language its sorted n-grams and their counts."""
    out = dict.fromkeys(langs, (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)))
    for lang, own in rows.groupby("lang"):
        keys = own["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out[lang] = keys[order], own["n"].to_numpy()[order]
    return out


def learn_blocks(train: DataFrame, text_col: str = "text", lang_col: str = "lang", block_entries: int = BLOCK_ENTRIES) -> tuple[int, Iterator[tuple[int, int, CharModels]]]:
    """How many blocks the models of all rows of train with a text and a language have, and the blocks, built one after
    another: (low, high, models) score the n-grams in the buckets from low up to high.

    All n-grams are kept. Discounts and the counts of orders 2 and 1 are those of the whole corpus, counted by groupBy;
    contexts and left neighbours of orders 4 and 3 lie within a block. A block has at most block_entries 4-grams, all
    languages together, or one bucket. Besides, it holds the 2-grams of its own buckets and all single letters.
    """
    counts = materialize(gram_counts(train, text_col, lang_col), "kn-counts")
    bits = F.shiftrightunsigned("gram", 16)
    bucket = F.shiftleft(bits.bitwiseAND(63), 6) + F.shiftrightunsigned("gram", 32).bitwiseAND(63)
    counts = counts.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    cuts, held = [0], 0
    for k in sorted(sizes):
        if held and held + sizes[k] > block_entries:
            cuts, held = [*cuts, k], 0
        held += sizes[k]
    cuts.append(1 << 12)
    if not sizes:
        return 0, iter(())
    if len(cuts) == 2:
        rows = counts.select("lang", "gram", "n").toPandas()
        return 1, iter([(0, 1 << 12, CharModels(_by_lang(rows, [])))])
    by_order = {ORDER: counts.select("lang", "gram", "n")}
    for n in range(ORDER - 1, 0, -1):
        shorter = by_order[n + 1].select("lang", F.col("gram").bitwiseAND((1 << 16 * n) - 1).alias("gram"))
        by_order[n] = materialize(shorter.groupBy("lang", "gram").agg(F.count("*").alias("n")), f"kn-counts-{n}")
    discounts: dict[str, dict[int, float]] = {}
    for n, table in by_order.items():
        for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts.setdefault(r["lang"], {})[n] = _discount(r["ones"], r["twos"])
    langs = sorted(discounts)

    def blocks() -> Iterator[tuple[int, int, CharModels]]:
        single = _by_lang(by_order[1].toPandas(), langs)
        for low, high in zip(cuts, cuts[1:]):
            own = _by_lang(counts.where(F.col("bucket").between(low, high - 1)).select("lang", "gram", "n").toPandas(), langs)
            pairs = _by_lang(by_order[2].where(bits.bitwiseAND(63).between(low // 64, (high - 1) // 64)).toPandas(), langs)
            yield low, high, CharModels(own, {x: Whole(discounts[x], {2: pairs[x], 1: single[x]}) for x in langs})

    return len(cuts) - 1, blocks()


def _best(bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bits under each language and numbers of characters: the best language's index, its bits a character, its lead
    over the second in bits of evidence."""
    bits = bits / np.maximum(n, 1)[:, None]
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(bits)), best]
    others = bits.copy()
    others[np.arange(len(bits)), best] = np.inf
    lead = np.where(np.isfinite(others.min(axis=1)), others.min(axis=1) - least, 1.0) * np.sqrt(np.maximum(n, 1))
    return best, least, lead


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P = 1 / (1 + exp(-(a * x + b))) by Newton's method, with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """id, lang_pred, score, bits (a character, under lang_pred) and rejected, for each row of docs.

    The language with the lowest cross-entropy a character wins; score is the chance that it is right, fitted by the winner's
    lead on some calibration_rows training texts that a hash of id and text draws; the models don't learn from them. rejected says that the score is under a half,
    or that the text has more bits a character than all but a few calibration texts of that language: likely none of the languages. Texts
    that are null or have no letter get `und`, score 0, no bits, and are rejected. Rows of train without text or language
    teach nothing; without any training row all is `und`. The models keep every n-gram; where they have more than
    block_entries 4-grams, the texts are scored block by block (see learn_blocks) with the same results. Repeated rows give repeated rows; an empty docs an empty result.
    """
    spark = docs.sparkSession
    known = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    part = min(CALIBRATION_PART, calibration_rows / max(1, known.count()))
    held_out = F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1 << 20)) < F.lit(part * (1 << 20))
    drawn = known.where(held_out)
    n_blocks, blocks = learn_blocks(known.where(~held_out), "text", "lang", block_entries)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not n_blocks:
        return own.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))

    def scored(rows: DataFrame, block: tuple[int, int, CharModels], keep: str) -> DataFrame:
        """The columns keep of rows, which end in the text, and for each the bits of the block's characters under each
        language, whether there is a letter, and how many characters count."""
        low, high, _ = block
        held, names = spark.sparkContext.broadcast(block[2]), [c.split()[0] for c in keep.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(len(names)).to_pylist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and size < 1 << 20:
                        size += len(texts[end] or "")
                        end += 1
                    bits, some, n = held.value.bits(texts[at:end], low, high)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, end - at) for i in range(len(names))], lists, pa.array(some), pa.array(n.astype(np.int64))], [*names, "parts", "some", "n"])
                    at = end

        return rows.select(*names, "text").mapInArrow(run, f"{keep}, parts array<double>, some boolean, n long")

    if n_blocks == 1:
        block = next(blocks)
        langs, seen, found = block[2].langs, scored(drawn, block, "lang string"), scored(own, block, f"id {kind}")
    else:
        # Each block's bits are written before the next block is built, and added up for each row in the blocks' order.
        rows = own.withColumn("lang", F.lit(None).cast("string")).withColumn("drawn", F.lit(False)).unionByName(drawn.withColumn("drawn", F.lit(True)))
        rows, parts = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "kn-rows"), []
        for k, block in enumerate(blocks):
            langs = block[2].langs
            got = scored(rows, block, f"row long, drawn boolean, id {kind}, lang string")
            parts.append(materialize(got.withColumn("k", F.lit(k)), "kn-bits"))
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "parts"))), lambda p: p["parts"])
        summed = F.aggregate(in_order, F.array_repeat(F.lit(0.0), len(langs)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
        added = materialize(every.groupBy("row", "drawn", "id", "lang", "some", "n").agg(summed.alias("parts")), "kn-summed")
        seen, found = added.where("drawn"), added.where("NOT drawn")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("parts").flatten().to_numpy().reshape(batch.num_rows, len(langs))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("some", "n"))
            best, bits, lead = _best(matrix(batch), n)
            right = np.array([langs[i] for i in best], dtype=object) == np.array(batch.column("lang").to_pylist(), dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(best[some]), pa.array(bits[some]), pa.array(lead[some]), pa.array(right[some])], ["best", "bits", "lead", "correct"])

    seen = seen.select("lang", "parts", "some", "n").mapInArrow(calibrate, "best long, bits double, lead double, correct boolean").toPandas().sort_values(["best", "bits", "lead"])
    a, b = _platt(seen["lead"].to_numpy(), seen["correct"].to_numpy().astype(float)) if len(seen) else (1.0, 0.0)
    limits = np.full(len(langs), np.inf)
    for lang, group in seen[seen["correct"]].groupby("best"):
        limits[lang] = np.quantile(group["bits"], 1 - REJECTED_PER_MILLE / 1000) * 1.05

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            some, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("some", "n"))
            best, bits, lead = _best(matrix(batch), n)
            score = np.where(some, 1 / (1 + np.exp(-np.clip(a * lead + b, -30, 30))), 0.0)
            rejected = ~some | (score < 0.5) | (bits > limits[best])
            pred = names[np.where(some, best, len(langs))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, mask=~some), pa.array(rejected)], ["id", "lang_pred", "score", "bits", "rejected"])

    schema = f"id {kind}, lang_pred string, score double, bits double, rejected boolean"
    return found.select("id", "parts", "some", "n").mapInArrow(run, schema).withColumnRenamed("id", id_col)
