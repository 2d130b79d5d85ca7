"""Chat formatting by quotation linking: quotes go, replies are ordered under the messages that they quote."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalake.core.ranks import with_global_rank
from stratalake.core.storage import discard, materialize
from stratalake.llm.skew import join_to_one

_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
#: How mail programs introduce a quotation.
_INTRO = re.compile(r"^(?:On|Le|Am|El)\b.{0,200}\b(?:wrote|a écrit|schrieb|escribió)\s*:\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_EDGES = re.compile(r"^\W+|\W+$")

PARSED = "own_text string, max_level int, n_passages int, quoted array<struct<passage:int,level:int,hash:string,words:int>>, units array<string>"


def unit_hash(text: str) -> str | None:
    """A hash of lower-cased words with single spaces and without punctuation at the ends; null if nothing is left."""
    plain = _EDGES.sub("", " ".join(text.lower().split()))
    return hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()[:24] if plain else None


def parse_message(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message without its quotations, and the quoted passages: runs of lines of one level, with that level.

    A line's level is the number of > signs that open it. Lines that only introduce a quotation go with it."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[0].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not before:
                while own and not own[-1].strip():
                    own.pop()
                if own and _INTRO.match(own[-1].strip()):
                    own.pop()
            if level == before:
                passages[-1][1].append(line[m.end() :])
            else:
                passages.append((level, [line[m.end() :]]))
        before = level
    return "\n".join(own).strip("\n"), [(n, "\n".join(lines)) for n, lines in passages]


def units(text: str) -> dict[str, int]:
    """What a quotation can repeat of a text, by hash, with the number of words: the text as a whole, its paragraphs, its
    lines, and the sentences of its paragraphs. Line breaks count as spaces, so that text wrapped anew is the same."""
    paragraphs = re.split(r"\n[ \t]*\n", text)
    parts = [text, *paragraphs, *text.split("\n"), *(s for p in paragraphs for s in _SENTENCE.split(p))]
    return {h: len(u.split()) for u in dict.fromkeys(parts) if (h := unit_hash(u)) is not None}


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message's own text, its quoted units with their hashes, and the hashes of its own units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                own, passages = parse_message(text)
                quoted = [{"passage": i, "level": level, "hash": h, "words": n} for i, (level, passage) in enumerate(passages) for h, n in units(passage).items()]
                rows.append({"own_text": own, "max_level": max((n for n, _ in passages), default=0), "n_passages": len(passages), "quoted": quoted, "units": sorted(units(own))})
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.string()), ("words", pa.int32())])), pa.list_(pa.string())]
            names = ["own_text", "max_level", "n_passages", "quoted", "units"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)]], ["conv", "turn", "role", *names])

    return messages.mapInArrow(run, f"conv {_kind(messages, 'conv')}, turn {_kind(messages, 'turn')}, role string, " + PARSED)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def linked_passages(parsed: DataFrame) -> DataFrame:
    """A row for each quoted passage that repeats an original: conv, turn, passage, level, p_conv, p_turn.

    The original is the first message of the same conversation, before the quoting one, that has units of the passage as
    its own words; else the first of any other conversation. Of several, the one with most of the passage's words: those
    of the same conversation go before others. All messages without a conversation are one conversation."""
    quotes = materialize(parsed.select("conv", "turn", F.inline("quoted")).distinct(), "quotes")
    if quotes.isEmpty():
        conv, turn = _kind(parsed, "conv"), _kind(parsed, "turn")
        return parsed.sparkSession.createDataFrame([], f"conv {conv}, turn {turn}, passage int, level int, p_conv {conv}, p_turn {turn}")
    wanted = quotes.select("hash").distinct()
    originals = join_to_one(parsed.select("conv", "turn", F.explode("units").alias("hash")).where("turn IS NOT NULL"), wanted, ["hash"])
    # Summed up before the joins, so each quoted unit meets one row at most, however often its words occur.
    here = materialize(originals.groupBy("conv", "hash").agg(F.min("turn").alias("h_turn")), "quote-originals")
    # The two first conversations of each unit: one of them is another than the quoting one.
    place = F.struct(F.col("conv").isNull().alias("none"), "conv", F.col("h_turn").alias("turn"))
    least = materialize(here.groupBy("hash").agg(F.min(place).alias("first")), "quote-first")
    others = join_to_one(here, least, ["hash"]).where(~F.col("conv").eqNullSafe(F.col("first.conv"))).groupBy("hash").agg(F.min(place).alias("second"))
    there = materialize(least.join(others, "hash", "left"), "quote-firsts")  # a row a hash on either side
    with_own = join_to_one(quotes, here, ["conv", "hash"], "left")
    q = join_to_one(materialize(with_own, "quote-own"), there, ["hash"], "left")
    own = F.coalesce(F.col("h_turn") < F.col("turn"), F.lit(False))
    other = F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first"))
    found = q.select(
        "conv", "turn", "passage", "level", "words",
        F.when(own, F.col("conv")).otherwise(other["conv"]).alias("p_conv"),
        F.when(own, F.col("h_turn")).otherwise(other["turn"]).alias("p_turn"),
        own.alias("same"),
    ).where("p_turn IS NOT NULL AND turn IS NOT NULL")
    summed = found.groupBy("conv", "turn", "passage", "level", "p_conv", "p_turn", "same").agg(F.sum("words").alias("words"))
    best = Window.partitionBy("conv", "turn", "passage", "level").orderBy(F.desc("same"), F.desc("words"), F.asc_nulls_last("p_conv"), "p_turn")
    return summed.withColumn("k", F.row_number().over(best)).where("k = 1").select("conv", "turn", "passage", "level", "p_conv", "p_turn")


def _roots(replies: DataFrame) -> DataFrame:
    """conv, turn, root and depth of all messages that reply to another, by pointer doubling."""
    now = materialize(replies.select("conv", "turn", F.col("p_turn").alias("root"), F.lit(1).alias("depth")), "reply-roots")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"))
        joined = join_to_one(now.select("conv", "turn", "root", "depth"), up, ["conv", "root"], "left")
        new = materialize(joined.select("conv", "turn", F.coalesce("u_root", "root").alias("root"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"), F.col("u_root").isNotNull().alias("moved")), "reply-roots")
        discard(now)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new


def reply_ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message: its text without quotations, what it replies to, and its place in its conversation.

    A message replies to the original of its first linked passage of the lowest level that is in the same conversation, be it
    quoted in part or wrapped anew (see linked_passages).
    Threads follow each other by the turn of their root, messages within a thread by turn, so a reply stands after what
    it answers; reply_pos counts them from 0 in each conversation. n_linked counts passages with an original anywhere.

    Ids and turns keep their types, text among them; turns are ordered by their type. A text is parsed whole, as long as it
    may be. Null texts are empty messages. Rows of the same conversation and turn count as one message when links are made, and
    each has its own place, ordered by role and text. The messages with a null conversation id are one conversation; a message
    with a null turn comes first, links to nothing and is nobody's original. An empty table gives an empty result; other columns are not read.
    """
    messages = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    # The row's number tells equal rows apart, so that they needn't lie in one partition when they are ranked.
    parsed = materialize(_parsed(messages).withColumn("row", F.monotonically_increasing_id()), "messages")
    links = materialize(linked_passages(parsed), "quote-links")
    counted = links.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"))
    first = Window.partitionBy("conv", "turn").orderBy("level", "passage")
    replies = links.where(F.col("conv").eqNullSafe(F.col("p_conv"))).withColumn("k", F.row_number().over(first)).where("k = 1").select("conv", "turn", "p_turn")
    replies = materialize(replies, "replies")
    roots = materialize(join_to_one(replies, _roots(replies), ["conv", "turn"]), "reply-threads")
    about = join_to_one(counted, roots, ["conv", "turn"], "left").select("conv", "turn", "n_linked", "root", "depth", "p_turn")
    threaded = join_to_one(parsed.drop("units", "quoted"), about, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "own_text", "max_level", "n_passages",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("p_turn").alias("reply_to"),
        F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "row",
    )
    ranked = with_global_rank(threaded, ["conv", "thread", "turn", "role", "own_text", "row"])
    begin = ranked.groupBy("conv").agg(F.min("rank").alias("begin")).withColumnRenamed("conv", "b_conv")
    placed = join_to_one(ranked, begin.withColumnRenamed("b_conv", "conv"), ["conv"])
    return placed.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), (F.col("rank") - F.col("begin")).alias("reply_pos"),
        "reply_to", "thread", "depth", "n_passages", "max_level", "n_linked", "own_text",
    )
