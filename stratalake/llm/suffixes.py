"""Benchmark decontamination by suffix arrays over shards of the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.words import batches_of, hashed_words

#: Words in a shard's suffix array; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is gone through in blocks.
BLOCK_BYTES = 4 << 20

SPANS = "array<struct<doc_start:int,n_words:int>>"
MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,n_words:int>>"
_SPAN = pa.list_(pa.struct([("doc_start", pa.int32()), ("n_words", pa.int32())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))


class SuffixArray:
    """The places of all words of a shard, sorted by the suffix that begins there; a document's end sorts before any word.

    Suffixes are sorted by prefix doubling; each round looks only at suffixes that are still tied. Equal suffixes (the
    tails of copies) stay side by side."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        """hashes: of all words, document after document; lengths: the documents' numbers of words."""
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        #: Where each document begins in tokens; word numbers from 1, with a 0 at each document's end.
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths)
        self.tokens = np.zeros(self.first[-1] + 1, dtype=np.int32)
        self.tokens[at] = words + 1
        end = np.zeros(len(self.tokens), dtype=np.int64)
        end[at] = np.repeat(self.first[1:] - 1, lengths)
        #: Suffixes that begin with word w are those from heads[w] up to heads[w + 1].
        self.heads = np.concatenate([[0, 0], np.cumsum(np.bincount(self.tokens[at], minlength=len(self.vocabulary) + 1)[1:])])
        self.places = at[np.argsort(self.tokens[at], kind="stable")]
        rank = np.zeros(len(self.tokens), dtype=np.int64)
        rank[at] = self.heads[self.tokens[at]] + 1
        sizes = np.diff(self.heads)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(tied):
            own = self.places[tied]
            key = rank[own] << 32 | rank[np.minimum(own + step, end[own])]
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order]
            self.places[tied] = own
            new = np.ones(len(key) + 1, dtype=bool)
            new[1:-1] = key[1:] != key[:-1]
            begin = np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))
            rank[own] = tied[begin] + 1
            # Those whose documents have ended are equal and stay as they are.
            tied = tied[~(new[:-1] & new[1:]) & (key & 0xFFFFFFFF != 0)]
            step *= 2

    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """Of suffixes from low up to high, which share their first depth words, where those begin whose next word isn't below word."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = self.tokens[self.places[middle] + depth] < word[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers from low up to high, range after range."""
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class TestSuffixes:
    """The suffixes of a block of benchmark items that hold a window: window words, or all of an item that has fewer."""

    __test__ = False  # not for pytest

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        names: dict[bytes, list[str | None]] = {}
        hashed: dict[bytes, np.ndarray] = {}
        for start, texts in batches_of([t for _, t in items]):
            words, bounds = hashed_words(texts)
            for k in range(len(texts)):
                own = words[bounds[k] : bounds[k + 1]]
                if len(own):
                    hashed[own.tobytes()] = own
                    names.setdefault(own.tobytes(), []).append(items[start + k][0])
        #: Items of the same words are one content, with all their names.
        self.names = [sorted(set(n), key=lambda x: (x is None, x or "")) for n in names.values()]
        contents = list(hashed.values())
        self.words = np.concatenate([*contents, np.empty(0, dtype=np.uint64)])
        lengths = np.array([len(c) for c in contents], dtype=np.int64)
        size = np.minimum(lengths, window)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        #: For each suffix: its place in words, its content, its window's words, and its own.
        self.at = _ranges(begin, begin + lengths - size + 1)
        self.content = np.repeat(np.arange(len(contents)), lengths - size + 1)
        self.start = self.at - begin[self.content]
        self.size, self.left = size[self.content], lengths[self.content] - self.start
        windows: dict[bytes, int] = {}
        self.window = np.array([windows.setdefault(self.words[a : a + n].tobytes(), len(windows)) for a, n in zip(self.at.tolist(), self.size.tolist(), strict=True)], dtype=np.int64)
        owners: list[set[int]] = [set() for _ in windows]
        for w, c in zip(self.window.tolist(), self.content.tolist(), strict=True):
            owners[w].add(c)
        sets: dict[tuple[int, ...], int] = {}
        #: For each window the number of its set of contents.
        self.owner = np.array([sets.setdefault(tuple(sorted(o)), len(sets)) for o in owners], dtype=np.int64)
        self.sets = list(sets)

    def search(self, shard: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By bisection: places and windows of all windows' occurrences in the shard; and for each suffix the length of its
        longest match (0 where its window doesn't occur) and a place of that."""
        n = len(self.at)
        longest, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        none = np.empty(0, dtype=np.int64)
        if not n or not len(shard.vocabulary):
            return none, none, longest, place
        v = np.minimum(np.searchsorted(shard.vocabulary, self.words), len(shard.vocabulary) - 1)
        words = np.where(shard.vocabulary[v] == self.words, v + 1, 0)
        low, high = shard.heads[words[self.at]], shard.heads[words[self.at] + 1]
        found_low, found_high = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live, depth = np.flatnonzero(low < high), 1
        while len(live):
            whole = live[self.size[live] <= depth]
            longest[whole], place[whole] = depth, shard.places[low[whole]]
            reached = live[self.size[live] == depth]
            found_low[reached], found_high[reached] = low[reached], high[reached]
            live = live[self.left[live] > depth]
            word = words[self.at[live] + depth]
            live, word = live[word > 0], word[word > 0]
            a = shard.narrowed(low[live], high[live], depth, word)
            b = shard.narrowed(a, high[live], depth, word + 1)
            low[live], high[live] = a, b
            live = live[a < b]
            depth += 1
        _, once = np.unique(self.window, return_index=True)
        once = once[found_high[once] > found_low[once]]
        spread = found_high[once] - found_low[once]
        return shard.places[_ranges(found_low[once], found_high[once])], np.repeat(self.window[once], spread), longest, place


def found_in(tests: TestSuffixes, hashes: np.ndarray, lengths: np.ndarray) -> tuple[dict[int, list], dict[int, list], dict[int, list]]:
    """For the documents with matches: spans of hit words, names of items with an occurring window, longest matches."""
    shard = SuffixArray(hashes, lengths)
    at, window, longest, place = tests.search(shard)
    spans: dict[int, list] = {}
    items: dict[int, list] = {}
    matches: dict[int, list] = {}
    if not len(at):
        return spans, items, matches
    sizes = np.zeros(len(tests.owner), dtype=np.int64)
    sizes[tests.window] = tests.size
    change = np.zeros(len(shard.tokens) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + sizes[window], -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc_of = lambda x: np.searchsorted(shard.first, x, side="right") - 1
    for d, a, b in zip(doc_of(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
        spans.setdefault(d, []).append({"doc_start": a - int(shard.first[d]), "n_words": b - a})
    owned = np.unique(np.stack([doc_of(at), tests.owner[window]], axis=1), axis=0)
    contents: dict[int, set[int]] = {}
    for d, s in owned.tolist():
        contents.setdefault(d, set()).update(tests.sets[s])
    for d, own in contents.items():
        items[d] = [name for c in own for name in tests.names[c]]
    # A match that an earlier suffix of the item has as the rest of its own isn't told again.
    rest = np.zeros(len(longest), dtype=bool)
    rest[1:] = (tests.content[1:] == tests.content[:-1]) & (longest[1:] == longest[:-1] - 1)
    for t in np.flatnonzero((longest > 0) & ~rest):
        d = int(doc_of(place[t]))
        matches.setdefault(d, []).append({"item_id": tests.names[tests.content[t]][0], "doc_start": int(place[t] - shard.first[d]), "item_start": int(tests.start[t]), "n_words": int(longest[t])})
    return spans, items, matches


def united(spans: list[dict]) -> list[dict]:
    """Spans without overlaps, in order."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["doc_start"]):
        if out and s["doc_start"] <= out[-1]["doc_start"] + out[-1]["n_words"]:
            out[-1]["n_words"] = max(out[-1]["n_words"], s["doc_start"] + s["n_words"] - out[-1]["doc_start"])
        else:
            out.append(dict(s))
    return out


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """docs' id, n_words, spans, items and matches (with carry also the row itself, as a struct).

    spans are the stretches of words inside any occurrence of a window of a benchmark item: `window` consecutive words, or
    all words of an item that has fewer. items are the items with such a window, each once. matches tell for each suffix of
    an item, in the document where its shard has it, its longest verbatim match of at least a window, with the places in
    both; matches inside a longer one of the same item are left out, and items of the same words are told under one name.
    So a document's lists grow with its words and the items, not with their product.

    Tasks cut their documents into shards of shard_words and build each shard's suffix array over all its words; every
    suffix of the items is searched in it by bisection. Words are compared by 64-bit hashes. The items, in blocks of
    block_bytes by a hash, are broadcast; each block is a pass over the texts in the same job.

    Null and empty texts have no words and no matches. A null item_id is an item without a name, however many rows have
    it; repeated items count once. An empty benchmark leaves the lists empty; an empty docs gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words")).distinct()
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = size // block_bytes + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    empty = lambda t: F.expr(f"cast(array() as {t})")
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), empty(SPANS).alias("spans"), empty("array<string>").alias("items"), empty(MATCHES).alias("matches"),
        (F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("int")).alias("carried"),
    )
    whole = "int" if not carry else f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in docs.schema.fields)}>"
    names = out.columns
    for b in range(blocks):
        got = sorted(((r["item"], r["words"]) for r in dealt.where(F.col("block") == b).collect() if r["words"] is not None), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        held = spark.sparkContext.broadcast(TestSuffixes(got, window))

        def run(batches: Iterator[pa.RecordBatch], held=held, only=b == 0, last=b == blocks - 1) -> Iterator[pa.RecordBatch]:
            shard: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
            n = 0

            def searched() -> Iterator[pa.RecordBatch]:
                found = found_in(held.value, np.concatenate([h for _, h, _ in shard]), np.concatenate([m for _, _, m in shard]))
                at = 0
                for piece, _, lengths in shard:
                    lists = []
                    for k, new in enumerate(found):
                        own = [new.get(at + i, []) for i in range(len(piece))]
                        if not only:
                            own = [[*x, *y] for x, y in zip(piece.column(3 + k).to_pylist(), own, strict=True)]
                        lists.append(own if k else [united(s) if s else s for s in own])
                    kept = pa.nulls(len(piece), pa.string()) if last else piece.column(1)
                    columns = [piece.column(0), kept, pa.array(lengths), pa.array(lists[0], _SPAN), pa.array(lists[1], pa.list_(pa.string())), pa.array(lists[2], _MATCH), piece.column(6)]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at += len(piece)

            for batch in batches:
                for start, texts in batches_of(batch.column(1).to_pylist()):
                    hashes, bounds = hashed_words(texts)
                    shard.append((batch.slice(start, len(texts)), hashes, np.diff(bounds).astype(np.int64)))
                    n += len(hashes)
                    if n >= shard_words:
                        yield from searched()
                        shard, n = [], 0
            if shard:
                yield from searched()

        out = out.mapInArrow(run, f"id {kind}, text string, n_words long, spans {SPANS}, items array<string>, matches {MATCHES}, carried {whole}")
    return out.select(F.col("id").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"), "matches", *["carried"] * carry)


def judged(matches: DataFrame, part: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items: a document is contaminated if one in `part` of its
    words or more is hit. The hash is of the items' names, joined by commas; an item without a name counts but isn't in it."""
    return matches.withColumns(
        {
            "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"]),
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(part) * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 20, **options) -> DataFrame:
    """docs without those of whose words one in `part` or more lies inside matches with the benchmark; no shuffle of the texts."""
    found = judged(verbatim_matches(docs, benchmark, id_col, text_col, carry=True, **options), part)
    return found.where("NOT contaminated").select("carried.*")
