"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context windows of the terms found."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize

#: Labelled rows from which lexicon and weights are learned, at most; where there are more, a hash draws them.
TRAINING_ROWS = 24_000
#: A term is in this many toxic training documents at least, with this log odds ratio at least.
LEAST_DOCS, LEAST_WEIGHT = 2, 2.0
#: Of all terms that are tried, so many may pass by chance: the rarer a term, the more one-sided it has to be. There is no
#: other bound on the lexicon's size than the sample of labelled rows.
CHANCE_TERMS = 10
#: Words and stems from these lengths on may be misspelled by one edit.
FUZZY_LENGTH, FUZZY_STEM = 5, 7
#: Stems are openings of words, of these lengths.
STEMS = (4, 5, 6, 7, 8)
#: A stem stands for words of which the documents have this many different ones.
STEM_WORDS = 3
#: Words before and after a term that tell quotation from abuse.
WINDOW_WORDS = 6
#: Documents scored from this on are predicted toxic.
THRESHOLD = 0.7
#: States of the automaton that a task keeps at once; beyond that it forgets them and makes them anew as words need them.
STATES = 1 << 17

#: Marks that open a quotation and those that close it.
QUOTES = {"\"": "\"", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›"}

_MARK = re.compile("[\"“”„«»‹›]")

FEATURES = ("any_hit", "exact_max", "fuzzy_max", "quoted_max", "weight_sum", "distinct", "density", "quoted_share", "context_max", "context_mean")

#: Beyond this code point nothing is a letter or digit.
_LAST = 0x32400
_FOLD: np.ndarray | None = None


def _folded(codes: np.ndarray) -> np.ndarray:
    """Lower case of letters and digits, 0 for all else."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(_LAST + 1, dtype=np.uint32)
        for c in range(_LAST):
            if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD[np.minimum(codes, _LAST)]


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, a 0 after each; words' starts and ends; the texts' bounds in characters and in words."""
    codes = np.frombuffer("\x00".join([*[t or "" for t in texts], ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = _folded(codes)
    edges = np.diff(np.concatenate([[0], (folded != 0).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])]).astype(np.int64)
    return folded, starts, ends, chars, np.searchsorted(starts, chars)


def runs(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """From and to of runs of texts with some `most` characters each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < most:
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


class Lexicon:
    """A deterministic automaton: the lexicon's trie, intersected with each term's Levenshtein automaton of one edit.

    Its states are sets of (trie node, edits so far) and are made when a word first needs them. Words run through it, many
    side by side; a word that ends in an accepting state is a term, a misspelled term, or begins with a stem.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        """terms: word or stem, whether it is a stem, weight."""
        self.terms = terms
        self.letters = sorted({c for t, _, _ in terms for c in t})
        self.children, self.owner, self.stem, self.fuzzy = [{}], [-1], [-1], [False]
        for n, (term, is_stem, _) in enumerate(terms):
            at, open_ = 0, len(term) >= (FUZZY_STEM if is_stem else FUZZY_LENGTH)
            self.fuzzy[0] |= open_
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.owner.append(-1)
                    self.stem.append(-1)
                    self.fuzzy.append(False)
                at = self.children[at][c]
                # Edits are allowed on the way to long terms only.
                self.fuzzy[at] |= open_
            (self.stem if is_stem else self.owner)[at] = n
        self._forget()

    def _forget(self) -> None:
        self.classes = np.zeros(_LAST + 1, dtype=np.int16)
        for i, c in enumerate(self.letters, 1):
            self.classes[ord(c)] = i
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves = np.full((256, len(self.letters) + 1), -1, dtype=np.int32)
        self.ends, self.edits = np.full(256, -1, dtype=np.int32), np.zeros(256, dtype=np.int32)
        self._state(frozenset())
        self.moves[0] = 0
        self._state(frozenset({(0, 0)}))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("terms", "letters", "children", "owner", "stem", "fuzzy")}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update(kept)
        self._forget()

    def _state(self, own: frozenset) -> int:
        if own not in self.states:
            n = self.states[own] = len(self.sets)
            self.sets.append(own)
            if n == len(self.moves):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
                self.ends, self.edits = np.concatenate([self.ends, np.full_like(self.ends, -1)]), np.concatenate([self.edits, np.zeros_like(self.edits)])
            self.ends[n], self.edits[n] = self._accepted(own)
        return self.states[own]

    def _long(self, n: int) -> bool:
        term, is_stem, _ = self.terms[n]
        return len(term) >= (FUZZY_STEM if is_stem else FUZZY_LENGTH)

    def _step(self, own: frozenset, c: str | None) -> frozenset:
        out = set()

        def arrive(node: int, edits: int) -> None:
            out.add((node, edits))
            n = self.stem[node]
            if n >= 0 and (not edits or self._long(n)):
                out.add((-1 - n, edits))  # a stem has been read: anything may follow

        for node, edits in own:
            if node < 0:
                out.add((node, edits))
                continue
            follow = self.children[node].get(c) if c is not None else None
            if follow is not None:
                arrive(follow, edits)
            if edits == 0 and self.fuzzy[node]:
                out.add((node, 1))  # inserted
                for k, child in self.children[node].items():
                    if k != c and self.fuzzy[child]:
                        arrive(child, 1)  # substituted
                    if self.fuzzy[child] and c is not None and c in self.children[child]:
                        arrive(self.children[child][c], 1)  # deleted
        return frozenset(out)

    def _accepted(self, own: frozenset) -> tuple[int, int]:
        """The term with the highest weight, one without edits before one with, and its edits; -1 if there is none."""
        found = []
        for node, edits in own:
            if node < 0:
                found.append((-1 - node, edits))
                continue
            n = self.owner[node]
            if n >= 0 and (edits == 0 or self._long(n)):
                found.append((n, edits))
            if edits == 0 and self.fuzzy[node]:
                # Its last letter is missing.
                found += [(self.owner[k], 1) for k in self.children[node].values() if self.owner[k] >= 0 and self._long(self.owner[k])]
        return max(found, key=lambda x: (-x[1], self.terms[x[0]][2], -x[0]), default=(-1, 0))

    def find(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words, those that match: their indices, their terms and their edits."""
        if len(self.sets) > STATES:
            self._forget()
        alive = np.arange(len(starts))
        state = np.ones(len(starts), dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        k = 0
        while len(alive):
            at = starts[alive] + k
            over = at >= ends[alive]
            if over.any():
                hit = over & (self.ends[state] >= 0)
                found.append((alive[hit], state[hit]))
                alive, state, at = alive[~over], state[~over], at[~over]
            kind = self.classes[folded[at]]
            new = self.moves[state, kind]
            lost = np.flatnonzero(new < 0)
            if len(lost):
                wide = len(self.letters) + 1
                for pair in np.unique(state[lost].astype(np.int64) * wide + kind[lost]).tolist():
                    s, c = divmod(pair, wide)
                    to = self._state(self._step(self.sets[s], self.letters[c - 1] if c else None))
                    self.moves[s, c] = to
                new = self.moves[state, kind]
            live = new != 0
            alive, state = alive[live], new[live]
            k += 1
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        words, last = np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])
        order = np.argsort(words)
        return words[order], self.ends[last[order]], self.edits[last[order]]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a term stands in its line between a mark that opens a quotation and one that closes it, or after a > sign."""
    line = text.rfind("\n", 0, start) + 1
    if text.startswith(">", line):
        return True
    opened = ""
    for m in _MARK.finditer(text, line, start):
        if opened:
            opened = "" if m[0] in QUOTES[opened] else opened
        elif m[0] in QUOTES:
            opened = m[0]
    if not opened:
        return False
    stop = text.find("\n", end)
    return any(text.find(c, end, stop if stop >= 0 else len(text)) >= 0 for c in QUOTES[opened])


def hits_of(lexicon: Lexicon, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int, bool, list[str]]]]]:
    """For each text with a term: its index, its number of words, and for each term found (term, edits, whether it is quoted,
    the words around it that are no terms)."""
    folded, starts, ends, chars, bounds = split_words(texts)
    words, terms, edits = lexicon.find(folded, starts, ends)
    letters = folded.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if len(words) else ""
    found = set(words.tolist())
    cut = np.searchsorted(words, bounds)
    for i in np.flatnonzero(np.diff(cut)).tolist():
        rows = []
        for w, t, e in zip(*(x[cut[i] : cut[i + 1]].tolist() for x in (words, terms, edits)), strict=True):
            near = range(max(int(bounds[i]), w - WINDOW_WORDS), min(int(bounds[i + 1]), w + WINDOW_WORDS + 1))
            around = [letters[starts[k] : ends[k]] for k in near if k not in found]
            rows.append((t, e, quoted(texts[i], int(starts[w] - chars[i]), int(ends[w] - chars[i])), around))
        yield i, int(bounds[i + 1] - bounds[i]), rows


def features(lexicon: Lexicon, context: dict[str, float], texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; context has the weights of words around terms."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not lexicon.terms:
        return out
    for i, total, rows in hits_of(lexicon, texts):
        best: dict[int, float] = {}
        most = [0.0, 0.0, 0.0]
        around = []
        for t, e, q, words in rows:
            weight = lexicon.terms[t][2]
            kind = 2 if q else 1 if e else 0
            most[kind] = max(most[kind], weight)
            best[t] = max(best.get(t, 0.0), weight)
            around.append(max(-6.0, min(6.0, sum(context.get(w, 0.0) for w in set(words)))))
        n = len(rows)
        out[i] = [1.0, *most, min(40.0, sum(best.values())), min(8, len(best)), np.log1p(100 * n / total), sum(q for _, _, q, _ in rows) / n, max(around), sum(around) / n]
    return out


@dataclass
class Model:
    lexicon: Lexicon
    #: Weights of words around a term: above 0 they tell abuse, below 0 quotation and other harmless use.
    context: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (features(self.lexicon, self.context, texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _term_counts(train: DataFrame) -> DataFrame:
    """term, stem, toxic, clean: in how many training documents of either kind a word or an opening of words occurs, and
    of how many different words an opening is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, end in runs(texts):
                counts: dict[str, list[int]] = {}
                folded, starts, ends, _, bounds = split_words(texts[at:end])
                letters = folded.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                for i in range(end - at):
                    own = {letters[a:b] for a, b in zip(starts[bounds[i] : bounds[i + 1]].tolist(), ends[bounds[i] : bounds[i + 1]].tolist(), strict=True)}
                    for w in own:
                        counts.setdefault(w, [0, 0])[0 if labels[at + i] else 1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "toxic", "clean"])

    return train.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _one_sided(toxic: Column, clean: Column, bad: int, good: int, tried: int) -> tuple[Column, Column, Column]:
    """The log odds ratio of terms in toxic of bad and clean of good documents, its standard error, and whether it is more
    one-sided (by the likelihood ratio) than all but CHANCE_TERMS of the terms tried would be by chance."""
    odds = F.log((toxic + 0.5) / (bad + 1)) - F.log((clean + 0.5) / (good + 1))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    whole, both = bad + good, toxic + clean
    ratio = part(toxic, both * (bad / whole)) + part(clean, both * (good / whole)) + part(bad - toxic, (whole - both) * (bad / whole)) + part(good - clean, (whole - both) * (good / whole))
    return odds, F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), ratio >= math.log(max(1.0, tried / CHANCE_TERMS))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training_rows: int = TRAINING_ROWS) -> Model:
    """Lexicon and weights from at most training_rows labelled documents, drawn by a hash of the id.

    The lexicon's terms are all words, and all openings that several words share, that toxic documents have more often than
    clean ones beyond chance; a stem that a shorter one of like weight opens is left out. The words that stand around
    terms get weights in the same way from the documents that have a term. Rows of labels without an id or a label teach
    nothing; a document with several labels is toxic if one of them says so; of several rows of an id one is learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    part = min(1.0, training_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.lit(part * (1 << 20)))
    # Some training_rows ids and labels, whatever the tables' sizes, so they are broadcast.
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    train = materialize(joined.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-train")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    names = len(FEATURES)
    if not bad or not good:
        return Model(Lexicon([]), {}, np.zeros(names), np.ones(names), np.array([0.0] * names + [-3.0 if not bad else 3.0]))
    words = materialize(_term_counts(train), "toxicity-words")
    stems = (
        words.select(F.explode(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS])).alias("term"), "toxic", "clean")
        .where("term IS NOT NULL")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("words"))
        .where(F.col("words") >= STEM_WORDS)
        .drop("words")
        .withColumn("stem", F.lit(True))
    )
    # Openings are summed over words, so a document may count more than once; no more than all documents can have one.
    both = words.withColumn("stem", F.lit(False)).unionByName(stems).withColumns({"toxic": F.least("toxic", F.lit(bad)), "clean": F.least("clean", F.lit(good))})
    odds, error, sure = _one_sided(F.col("toxic"), F.col("clean"), bad, good, words.count())
    chosen = both.withColumns({"odds": odds, "weight": odds - error}).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_WEIGHT) & (F.col("weight") > 0) & sure).select("term", "stem", "weight").collect()
    heavy = {r["term"]: r["weight"] for r in chosen if r["stem"]}
    covered = {t for t, w in heavy.items() if any(heavy.get(t[:k], 0.0) >= 0.9 * w for k in STEMS if k < len(t))}
    lexicon = Lexicon(sorted((r["term"], r["stem"], float(r["weight"])) for r in chosen if not (r["stem"] and r["term"] in covered)))
    held = train.sparkSession.sparkContext.broadcast(lexicon)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # The empty word stands for the document itself.
            rows = [(w, labels[a + i]) for a, b in runs(texts) for i, _, hits in hits_of(held.value, texts[a:b]) for w in {"", *(w for *_, words in hits for w in words)}]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.int32())], ["word", "toxic"])

    context: dict[str, float] = {}
    if lexicon.terms:
        near = materialize(train.select("text", "toxic").mapInArrow(around, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "toxicity-context")
        whole = near.where("word = ''").first()
        if whole and whole["toxic"] and whole["clean"]:
            odds, error, sure = _one_sided(F.col("toxic"), F.col("clean"), whole["toxic"], whole["clean"], near.count())
            weighed = near.where(F.col("word") != "").withColumns({"odds": odds, "error": error}).where(sure & (F.abs("odds") > F.col("error")))
            context = {r["word"]: float(r["odds"] - math.copysign(r["error"], r["odds"])) for r in weighed.select("word", "odds", "error").collect()}
    context = dict(sorted(context.items()))
    taught = train.sparkSession.sparkContext.broadcast(context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.concatenate([features(held.value, taught.value, texts[a:b]) for a, b in runs(texts)]) if texts else np.zeros((0, names))
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column(1)], [*FEATURES, "toxic"])

    seen = train.select("text", "toxic").mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toPandas()
    seen = seen.sort_values([*FEATURES, "toxic"])
    x, y = seen[list(FEATURES)].to_numpy(), (seen["toxic"] > 0).to_numpy().astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    return Model(lexicon, context, mean, scale, _logistic((x - mean) / scale, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, from 0 to 1, for every row: the whole text is searched.

    Null, empty and wordless texts get the score of a text without any term. Repeated rows give repeated rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.scores(texts[a:b]))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored threshold or higher; all columns and repeated rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in runs(texts):
                yield batch.slice(a, b - a).filter(pa.array(held.value.scores(texts[a:b]) < threshold))

    return docs.mapInArrow(run, docs.schema)
