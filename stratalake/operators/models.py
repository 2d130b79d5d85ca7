"""Model-backed steps with an injected client: prompts are asked once, answers are kept, a budget bounds the spending.

Off unless a client is given. Nothing here decides facts: whatever a model says stays a candidate (see extract.trust)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dollars for a million tokens in and out where a model isn't listed.
DEFAULT_PRICE = (1.0, 3.0)


def ask(prompts: DataFrame, cache: DataFrame, client: Callable[[str], tuple[str, int, int]], prices: tuple[float, float] = DEFAULT_PRICE, budget: float = 5.0) -> DataFrame:
    """prompts (id, prompt) with answer, tokens and cost: from cache (prompt_hash, answer) where it has them, else asked.

    Equal prompts are asked once. Of new prompts, by hash, as many are asked as fit the budget by an estimate of a token
    for four characters; the rest have no answer and say so."""
    hashed = prompts.withColumn("prompt_hash", F.sha2(F.col("prompt").cast("binary"), 256))
    new = hashed.join(cache, "prompt_hash", "left_anti").groupBy("prompt_hash").agg(F.min("prompt").alias("prompt"))
    estimate = (F.length("prompt") / 4 * prices[0] + 500 * prices[1]) / 1e6
    # Summed up in ranges of the hash, then over the ranges: no window over all prompts.
    ranged = new.withColumn("estimate", estimate).withColumn("part", F.substring("prompt_hash", 1, 3))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    offsets = ranged.groupBy("part").agg(F.sum("estimate").alias("whole")).withColumn("offset", F.coalesce(F.sum("whole").over(before), F.lit(0.0))).drop("whole")
    spent = F.sum("estimate").over(Window.partitionBy("part").orderBy("prompt_hash")) + F.col("offset")
    fits = ranged.join(F.broadcast(offsets), "part").withColumn("spent", spent).where(F.col("spent") <= budget).select("prompt_hash", "prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [client(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["prompt_hash", "answer", "tokens_in", "tokens_out"])

    asked = fits.mapInArrow(run, "prompt_hash string, answer string, tokens_in long, tokens_out long")
    known = cache.select("prompt_hash", "answer", F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    cost = (F.col("tokens_in") * prices[0] + F.col("tokens_out") * prices[1]) / 1e6
    return hashed.join(asked.unionByName(known), "prompt_hash", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).withColumn("over_budget", F.col("answer").isNull())


def costs(calls: DataFrame) -> DataFrame:
    """Calls, tokens and dollars by extractor."""
    return calls.groupBy("extractor").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def extract_json(text: str | None) -> str | None:
    """The JSON in an answer: the answer itself, a fenced block, or the first balanced object or array; null without one."""
    for found in (text or "", *re.findall(r"(?s)```(?:json)?\s*(.*?)```", text or "")):
        try:
            return json.dumps(json.loads(found), ensure_ascii=False)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False)
        except ValueError:
            pass
    return None
