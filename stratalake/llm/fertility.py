"""Quality by tokeniser fertility: how well public vocabularies fit a text, against bands for its language or script."""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.llm.skew import unused

#: Where the vocabularies are, and which are used: ranks of byte pairs (.tiktoken), pieces with byte fallback (.model).
FOLDER, VOCABULARIES = "/opt/tokenizers", ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
#: Vocabularies are read by the driver and broadcast; together they have so many bytes at most.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pattern that splits texts before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The base rules: least words, and most words of a hundred that stand in repeated windows of three.
LEAST_WORDS, REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: A band reaches from the median so many times as far as these two quantiles do, on either side.
QUANTILES, REACH = (0.25, 0.75), 6.0
#: On either side a band is so wide at least, in parts of the median and in the measure's own unit.
LEAST_PART, LEAST_UNIT = 0.08, 0.02
#: Languages and lengths with fewer different texts take the band of their language, or of all texts of their length, or of
#: all texts.
LEAST_TEXTS = 50
#: Measures are rounded so before quantiles are taken: these are exact, and there is a bounded number of values to count.
DIGITS = 3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Vocabulary:
    """encode: token ids of a text; fallback: by id, whether the token is no whole character, or a byte's own token."""

    encode: Callable[[str], list[int]]
    fallback: np.ndarray


def _ranks(data: bytes) -> Vocabulary:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}

    def whole(token: bytes) -> bool:
        try:
            return bool(token.decode())
        except UnicodeDecodeError:
            return False

    fallback = np.zeros(max(ranks.values()) + 1, dtype=bool)
    fallback[[i for token, i in ranks.items() if not whole(token)]] = True
    return Vocabulary(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, fallback)


def _pieces(data: bytes) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    fallback = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])
    return Vocabulary(lambda text: model.encode(text, num_threads=1), fallback)


@lru_cache(maxsize=4)
def _made(name: str, data: bytes) -> Vocabulary:
    return _pieces(data) if name.endswith(".model") else _ranks(data)


def read_vocabularies(folder: str, names: tuple[str, ...]) -> list[tuple[str, bytes]]:
    """The files' bytes, VOCABULARY_BYTES at most."""
    found = []
    for name in names:
        with open(os.path.join(folder, name), "rb") as f:
            found.append((name, f.read()))
    if sum(len(data) for _, data in found) > VOCABULARY_BYTES:
        raise ValueError(f"vocabularies of over {VOCABULARY_BYTES} bytes")
    return found


def measures(text: str, vocabulary: Vocabulary) -> tuple[int, float, float, float]:
    """Tokens, characters a token, share of tokens that fall back on bytes, entropy of the tokens in bits."""
    ids = np.asarray(vocabulary.encode(text), dtype=np.int64)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids, minlength=1)
    counts = counts[counts > 0]
    entropy = np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)
    return len(ids), len(text) / len(ids), float(vocabulary.fallback[ids].mean()), float(max(0.0, entropy))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # so that the next product stays below 2 ** 63
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    inside = np.zeros(len(words), dtype=bool)
    for i in range(3):
        inside[i : i + len(again)] |= again
    return int(inside.sum())


def base_measures(raw: bytes, chars: int) -> tuple[int, int, int, int, int]:
    """Words, characters in them, symbols, lines with a word that equal an earlier one, words in repeated windows. Words are
    what bytes.split() finds: it splits at \\x20 and \\x09 to \\x0D only."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blank = len(raw) - sum(map(len, words))
    return len(words), chars - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@lru_cache(maxsize=1 << 16)
def _script_of(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].lower() if c.isalpha() else ""


def script(text: str) -> str:
    """The script that most of the letters are in (the first word of their Unicode names; of several the least), or ''."""
    codes, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
    of: dict[str, int] = {}
    for code, times in zip(codes.tolist(), n.tolist(), strict=True):
        if name := _script_of(chr(code)):
            of[name] = of.get(name, 0) + times
    return min(of, key=lambda name: (-of[name], name), default="")


def _measured(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [_made(*x) for x in sent.value]
        for batch in batches:
            found = []
            for of, raw in zip(*(batch.column(batch.num_columns + i).to_pylist() for i in (-2, -1)), strict=True):
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                row = [script(text) if of is None else of, *base_measures(raw, len(text))]
                for v in vocabularies:
                    row += measures(text, v)
                found.append(row)
            columns = list(zip(*found, strict=True)) or [()] * (6 + 4 * len(vocabularies))
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.int64(), pa.float64(), pa.float64(), pa.float64()] * len(vocabularies)]
            own = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *own], names=[f"c{i}" for i in range(batch.num_columns - 2 + len(own))])

    return run


def _bands(measured: DataFrame, own: list[str], tokens: str) -> DataFrame:
    """Low and high ends of each measure for each `band_group` and `band_length`, from all different texts that pass the base
    rules, of the narrowest kind with LEAST_TEXTS of them; no ends where all texts together are fewer."""
    # Copies of a text count once. Equal texts have equal measures, so these tell them apart; no text is shuffled.
    texts = measured.where("not base_failed").select("band_group", "band_length", *[F.round(c, DIGITS).alias(c) for c in own], tokens, *BASE).distinct()
    kinds = texts.groupingSets([["band_group", "band_length"], ["band_group"], ["band_length"], []], "band_group", "band_length")
    ends = [F.percentile(c, [QUANTILES[0], 0.5, QUANTILES[1]]).alias(c) for c in own]
    found = materialize(kinds.agg(F.grouping_id().alias("kind"), F.count("*").alias("texts"), *ends).where(F.col("texts") >= LEAST_TEXTS), "fertility-bands")

    def reach(c: str) -> Column:
        low, middle, high = (F.col(c)[i] for i in range(3))
        least = F.greatest(F.abs(middle) * LEAST_PART, F.lit(LEAST_UNIT))
        return F.struct((middle - F.greatest((middle - low) * REACH, least)).alias("low"), (middle + F.greatest((high - middle) * REACH, least)).alias("high")).alias(c)

    ended = found.select("kind", "band_group", "band_length", *[reach(c) for c in own])
    wanted = measured.select("band_group", "band_length").distinct()
    # Kinds by bits: 1 where the length is left out, 2 where the language is.
    for kind, keys in ((0, ["band_group", "band_length"]), (1, ["band_group"]), (2, ["band_length"]), (3, [])):
        of = ended.where(F.col("kind") == kind).select(*keys, F.struct(*own).alias(f"kind{kind}"))
        wanted = wanted.join(of, keys, "left") if keys else wanted.join(F.broadcast(of), F.lit(True), "left")
    best = F.coalesce(*[F.col(f"kind{k}") for k in range(4)])
    return materialize(wanted.select("band_group", "band_length", best.alias("band")), "fertility-ends")


def judge(docs: DataFrame, by: str = "lang", text_col: str = "text", keep: list[str] | None = None, folder: str = FOLDER, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The columns `keep` of docs (all of them, the text too, if none are named) with the base measures, base_failed; for each
    vocabulary n: tokens_n, chars_per_token_n, byte_share_n, entropy_n; band_group, band_length, outside (the measures beyond
    their bands) and kept.

    by: the column of docs that bands are for; null, or by="script", stands for the script of the text's letters. Bands are
    also by length, in powers of four of the first vocabulary's tokens, as short texts vary more and have less entropy. They
    come from all different texts that pass the base rules; a group of copies, how large it may be, moves no band. A null text
    reads as empty and, like all of under 50 words, fails the base rules. Very long texts are measured whole. Equal rows are
    judged alike. An empty table gives an empty one. Where docs has columns of these names, the new ones have underscores in
    front."""
    keep = list(docs.columns) if keep is None else keep
    per = [(f"tokens_{i}", f"chars_per_token_{i}", f"byte_share_{i}", f"entropy_{i}") for i in range(len(vocabularies))]
    plain = [*BASE, *[n for x in per for n in x], "base_failed", "band_group", "band_length", "outside", "kept"]
    named = dict(zip(plain, unused(keep, *plain), strict=True))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(read_vocabularies(folder, vocabularies))
    stays = [f"kept_{i}" for i in range(len(keep))]
    read = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, stays, strict=True)], (F.lit(None) if by == "script" else F.col(f"`{by}`")).cast("string").alias("band_by"), F.col(f"`{text_col}`").cast("binary").alias("band_text"))
    kinds = ["band_group string", *[f"{c} long" for c in BASE], *[f"{x[0]} long, {x[1]} double, {x[2]} double, {x[3]} double" for x in per]]
    before = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-2]]
    raw = read.mapInArrow(_measured(sent), ", ".join([*before, *kinds]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    length = F.floor(F.log2(F.greatest(F.col("tokens_0"), F.lit(1)).cast("double")) / 2).cast("int")
    measured = materialize(raw.withColumns({"base_failed": failed, "band_length": length}), "fertility")
    own = [c for x in per for c in x[1:]]
    ends = _bands(measured, own, "tokens_0")
    judged = measured.join(ends, ["band_group", "band_length"])
    beyond = F.filter(F.array(*[F.when((F.round(c, DIGITS) < F.col("band")[c]["low"]) | (F.round(c, DIGITS) > F.col("band")[c]["high"]), F.lit(c)) for c in own]), lambda x: x.isNotNull())
    out = judged.withColumn("outside", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(beyond))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, stays, strict=True)], *[F.col(c).alias(n) for c, n in named.items()])
