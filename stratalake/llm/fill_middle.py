"""Fill-in-the-middle: texts are cut between units by SWAR words, eight bytes of UTF-8 at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.skew import unused

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are transformed; of 100 of those, so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of text that are looked at side by side (or one text, where it is longer).
PIECE = 1 << 22


def _each(byte: int) -> np.uint64:
    """A word of eight such bytes."""
    return np.uint64(byte * 0x0101010101010101)


_LOW, _HIGH, _ONE = _each(0x7F), _each(0x80), _each(0x01)
_3, _7, _8, _56 = (np.uint64(n) for n in (3, 7, 8, 56))


def white_space(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is \\x20 or \\x09 to \\x0D. No sum carries: its parts are below 0x80."""
    low = words & _LOW
    space = ~((low ^ _each(0x20)) + _LOW)
    control = (low + _each(0x80 - 0x09)) & ~(low + _each(0x80 - 0x0E))
    return (space | control) & ~words & _HIGH


class UnitEnds:
    """Where units end in texts that lie one after another; a unit is white space with the word after it, or what white
    space is left at a text's end. rank and select answer for many texts at once."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray) -> None:
        """raw: the texts' bytes; bounds: where each begins, with the end as a last entry."""
        padded = np.zeros((len(raw) // 8 + 1) * 8, dtype=np.uint8)
        padded[: len(raw)] = raw
        words = padded.view("<u8")
        blank = white_space(words)
        after = blank >> _8
        after[:-1] |= blank[1:] << _56
        self.ends = ~blank & after & _HIGH
        last = bounds[1:][np.diff(bounds) > 0] - 1
        np.bitwise_or.at(self.ends, last >> 3, (np.uint64(0x80) << ((last & 7).astype(np.uint64) << _3)))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before these bytes."""
        below = (np.uint64(1) << ((at & 7).astype(np.uint64) << _3)) - np.uint64(1)
        return self.before[at >> 3] + np.bitwise_count(self.ends[at >> 3] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte behind the n-th end, n from 1: the word by bisection of the sums, the byte by sums within the word."""
        word = np.searchsorted(self.before, nth, side="left") - 1
        left = (nth - self.before[word]).astype(np.uint64)
        sums = (self.ends[word] >> _7) * _ONE  # in each byte: ends up to it
        reached = ((sums | _HIGH) - left * _ONE) & _HIGH
        return word * 8 + 9 - np.bitwise_count(reached)


def cut(raw: np.ndarray, bounds: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number n of units, and where prefix and middle end, in bytes of the text: after the smaller and
    the larger of both draws modulo n + 1 units."""
    at = UnitEnds(raw, bounds)
    begin = bounds[:-1]
    first = at.rank(begin)
    n = at.rank(bounds[1:]) - first
    places = np.sort(np.stack([d % (n + 1) for d in draws]), axis=0)
    cuts = [np.where(k > 0, at.select(np.maximum(first + k, 1)) - begin, 0) if len(raw) else np.zeros_like(n) for k in places]
    return n, cuts[0], cuts[1]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of runs of texts with some PIECE bytes each."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield at, end
        at = end


_CUTS = "n long, prefix_bytes long, middle_end long"


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    draws = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    found = [cut(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], (draws[0][a:b], draws[1][a:b])) for a, b in _pieces(offsets)]
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3)]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["n", "prefix_bytes", "middle_end"])


def draw(row_id: Column, nth: int, seed: int) -> Column:
    """The n-th group of eight digits of the SHA-256 of `seed:id`, as a number; a null id reads as empty."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * nth - 7, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_bytes, middle_bytes, prefix_chars, middle_chars (null if plain)
    and output. All of it follows from a row's id, text and the parameters; nothing is shuffled.

    A null text reads as empty; empty texts and those that hold a mark are plain, so that `restored` is exact. Very long
    texts are cut like any other, in time and memory that grow with their bytes. Rows that are equal get equal results, an
    empty table an empty one. Where docs has columns of these names, the new ones have underscores in front."""
    own = unused(docs.columns, "n", "form", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars", "output", "fim_text", "fim_cuts", "fim_parts")
    n, form, prefix_bytes, middle_bytes, prefix_chars, middle_chars, output, text, cuts, parts = own
    col = lambda name: F.col(f"`{name}`")
    whole, pick = col(text), col(cuts)
    id_ = col(id_col)
    plain = (whole == "") | F.greatest(*[F.contains(whole, F.lit(m)) for m in marks]) | (draw(id_, 3, seed) % 100 >= rate)
    raw, p, m = whole.cast("binary"), pick["prefix_bytes"].cast("int"), pick["middle_end"].cast("int")
    piece = lambda begin, size: F.substring(raw, begin + 1, size).cast("string")
    cut_up = F.struct(piece(F.lit(0), p).alias("prefix"), piece(p, m - p).alias("middle"), piece(m, F.length(raw) - m).alias("suffix"))
    made = (
        docs.withColumn(text, F.coalesce(col(text_col), F.lit("")))
        .withColumn(cuts, F.arrow_udf(_cuts, _CUTS)(whole, draw(id_, 1, seed), draw(id_, 2, seed)))
        .withColumn(form, F.when(plain, "plain").when(draw(id_, 4, seed) % 100 < suffix_first, "spm").otherwise("psm"))
        .withColumn(parts, F.when(col(form) != "plain", cut_up))
    )
    before, between, behind = col(parts)["prefix"], col(parts)["middle"], col(parts)["suffix"]
    framed = F.when(col(form) == "psm", F.concat(F.lit(marks[0]), before, F.lit(marks[1]), behind, F.lit(marks[2]), between)).otherwise(F.concat(F.lit(marks[1]), behind, F.lit(marks[0]), before, F.lit(marks[2]), between))
    shaped = col(form) != "plain"
    return made.select(
        *[col(c) for c in docs.columns],
        pick["n"].alias(n),
        col(form),
        F.when(shaped, pick["prefix_bytes"]).alias(prefix_bytes),
        F.when(shaped, pick["middle_end"] - pick["prefix_bytes"]).alias(middle_bytes),
        F.char_length(before).cast("long").alias(prefix_chars),
        F.char_length(between).cast("long").alias(middle_chars),
        F.when(shaped, framed).otherwise(whole).alias(output),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form alone. Transformed texts hold no mark, and no mark's end is another's
    beginning, so each mark stands in the output once."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), middle, between(s, m))).otherwise(F.concat(between(p, m), middle, between(s, p)))
