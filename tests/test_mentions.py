"""Names in texts and relations between them, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalake.operators import mentions

NODE = "id string, kind string, name string, qualified_name string, doc_id string, extractor string"


def plain_mentions(text, keys):
    """The rule word for word: one part as a whole word, several parts anywhere, spaces and underscores aside."""
    words, low = set(re.findall(r"\w+", text.lower())), text.lower().replace(" ", "").replace("_", "")
    return {k for k in keys if len(k) >= 3 and (k.lower() in words if "_" not in k else k.lower().replace("_", "") in low)}


def test_matchable_names(spark):
    names = {"DMA Engine": True, "x": False, "a b c d e": False, "a b c d": True, "Introduction": False, " Table of Contents ": False, "n" * 31: False, "n" * 30: True, "中断控制器配置": True, "中断控制器配置寄存器": False, "": False}
    rows = spark.createDataFrame(list(names), "string").select("value", mentions.matchable(F.col("value")).alias("m")).collect()
    assert {r.value: r.m for r in rows} == names


def test_name_words(spark):
    names = {"the DMA_Engine": ["dma", "engine"], "A of x": [], "Clock-Gate unit": ["clockgate", "unit"], "go go": ["go"]}
    rows = spark.createDataFrame(list(names), "string").select("value", mentions.name_words(F.col("value")).alias("w")).collect()
    assert {r.value: r.w for r in rows} == names


def test_name_index(spark):
    rows = [("b", "module", "DMA Engine", None, "d", "x@1"), ("a", "module", "DMA_Engine", "", "d", None), ("z", "register", "DMA.Engine", "DMA Engine", "d", "x"), ("i", "module", "Other", None, "d", "llm_ie@1+llm_ie:2"), ("j", "module", "Both", None, "d", "llm_ie@1+table@2"), ("s", "section", "Title", None, "d", None), ("e", "module", "DMA Engine", None, "e", None)]
    got = {(r.doc_id, r.key): (r.id, r.name) for r in mentions.name_index(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {("d", "DMA_Engine"): ("z", "DMA Engine"), ("d", "Both"): ("j", "Both"), ("e", "DMA_Engine"): ("e", "DMA Engine")}


@pytest.mark.parametrize(("names_of_piece", "chunks_of_slice"), [(50_000, 1_000), (7, 5)])
def test_mentions_against_brute_force(spark, monkeypatch, names_of_piece, chunks_of_slice):
    monkeypatch.setattr(mentions, "NAMES_OF_PIECE", names_of_piece)
    monkeypatch.setattr(mentions, "CHUNKS_OF_SLICE", chunks_of_slice)
    rng = random.Random(3)
    parts = ["dma", "Engine", "clk", "Gate", "irq", "ctrl", "Éa", "漢字", "x1", "aa", "aaa"]
    keys = {d: sorted({"_".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(40)}) + ["ab"] for d in ("d", "e", "hot", "no chunks")}
    chunks = [(rng.choice(["d", "e", "hot", "hot", "no names"]), f"c{i}", "".join(rng.choice(parts) + rng.choice([" ", "_", ".", "", "  ", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [("d", "null", None), ("d", "upper", "DMA ENGINE and dma_engine")]
    names = spark.createDataFrame([(d, k) for d, own in keys.items() for k in own], "doc_id string, key string")
    got = {(r.doc_id, r.chunk_id, r.key) for r in mentions.mentions(spark.createDataFrame(chunks, "doc_id string, chunk_id string, text string"), names).collect()}
    assert got == {(d, c, k) for d, c, t in chunks for k in plain_mentions(t or "", keys.get(d, []))}
    assert ("d", "upper", "dma_Engine") in got or "dma_Engine" not in keys["d"]


def test_candidates(spark):
    nodes = spark.createDataFrame([("m1", "module", "Clock Unit", None, "d", None), ("m2", "module", "Gate", None, "d", None), ("m3", "module", "drives", None, "e", None)], NODE)
    text = "The clock unit drives the Gate. " * 4
    rows = [("d", "c1", text, "section"), ("d", "c2", "short clock unit gate", "section"), ("d", "c3", "only the clock unit here. " * 5, "section"), ("d", "c4", text, "table"), ("d", "c5", text + "REQ_1 REQ_A2 req_b_3", "section"), ("d", "c6", text + "REQ_1 REQ_A2", "section")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, chunk_type string")
    got = {r.chunk_id: (r.names, r.place) for r in mentions.relation_candidates(chunks, nodes).collect()}
    assert got == {"c1": (["Clock Unit", "Gate"], 1), "c6": (["Clock Unit", "Gate"], 2)}
    many = spark.createDataFrame([("d", f"c{i:02}", text, i % 3) for i in range(40)], "doc_id string, chunk_id string, text string, page int")
    got = [(r.chunk_id, r.place) for r in mentions.relation_candidates(many, nodes).orderBy("place").collect()]
    assert got == [(f"c{i:02}", k + 1) for k, i in enumerate(sorted(range(40), key=lambda i: (i % 3, i))[:30])]
    prompt = spark.range(1).select(mentions.relation_prompt(F.lit("the text"), F.array(F.lit("A"), F.lit("B"))).alias("p")).first().p
    assert "- A\n- B" in prompt and prompt.endswith("the text") and "belongs_to" in prompt


def plain_link(answers, names):
    """Answers in order, one relation after another, with an index that grows."""
    words = lambda n: {w for w in (re.sub(r"[^\w]|_", "", p) for p in n.lower().replace("_", " ").split()) if len(w) >= 2 and w not in mentions.NOISE_WORDS}
    key = lambda n: re.sub(r"[^A-Za-z0-9_.\-]+", "_", n.strip())
    index = {d: dict(own) for d, own in names.items()}
    nodes, edges = {}, {}
    for doc, chunk, relations in answers:
        own = index.setdefault(doc, {})
        for r in relations:
            kind, sure = r["relation"].strip().lower().replace(" ", "_"), r.get("confidence", 0.7)
            if kind not in mentions.RELATIONS or sure < 0.6:
                continue
            ends = []
            for side in ("src", "dst"):
                name, t = r[side], (r.get(f"{side}_type") or "").strip().lower()
                k, w = key(name), words(key(name))
                node, best = own.get(k), 0.0
                if node is None:
                    for other, i in own.items():
                        v = words(other)
                        score = len(w & v) / min(len(w), len(v)) if w and v else 0
                        if score >= 0.75 and score > best:
                            node, best = i, score
                if node is None and t in mentions.KINDS and k:
                    node = f"ie::{mentions.KINDS[t]}:{k}#{doc}"
                    own[k] = node
                    nodes[node] = (t, name, sure < 0.8, chunk)
                ends.append(node)
            if None not in ends and ends[0] != ends[1]:
                at = (*ends, kind)
                edges[at] = (max(edges.get(at, (0,))[0], min(sure, 1.0)), sorted({*edges.get(at, (0, []))[1], chunk}))
    return nodes, edges


def test_relations_against_plain_python(spark):
    rng = random.Random(9)
    base = {d: [(f"{d}{i}", n) for i, n in enumerate(["DMA Engine", "Clock Gate", "IRQ", "CTRL", "Reset Unit Main"])] for d in ("d", "e")}
    nodes = spark.createDataFrame([(i, "module", n, None, d, None) for d, own in base.items() for i, n in own], NODE)
    pool = ["the DMA engine", "DMA_Engine", "clock gate of a", "IRQ", "irq", "CTRL", "reset unit", "New Block", "new block unit", "Other Thing", "the other", "x", "漢", "of the"]
    answers = []
    for i in range(40):
        relations = [{"src": rng.choice(pool), "src_type": rng.choice([None, "module", "Register ", "cat"]), "relation": rng.choice(["drives", "Belongs To", "loves", "resets"]), "dst": rng.choice(pool), "dst_type": rng.choice([None, "clock", "pin"])} | ({"confidence": rng.choice([0.3, 0.6, 0.75, 0.8, 0.95, 1.4])} if rng.random() < 0.8 else {}) for _ in range(rng.randint(0, 4))]
        answers.append(("d" if i % 2 else "e", f"c{i:02}", relations))
    table = spark.createDataFrame([(d, c, i, json.dumps({"relations": r})) for i, (d, c, r) in enumerate(answers)] + [("d", "bad", 99, "no json"), ("d", "null", 100, None)], "doc_id string, chunk_id string, place int, answer string")
    made, edges = mentions.link_relations(table, nodes)
    names = {d: {re.sub(r"\W+", "_", n): i for i, n in own} for d, own in base.items()}
    want_nodes, want_edges = plain_link(answers, names)
    assert {r.id: (r.kind, r.name, r.pending, r.source_chunk_ids[0]) for r in made.collect()} == want_nodes
    assert {(r.src, r.dst, r.kind): (r.confidence, r.chunk_ids) for r in edges.collect()} == want_edges
    assert {r.status for r in made.collect()} == {"candidate"} and want_nodes and want_edges


def test_run_with_a_client(spark):
    nodes = spark.createDataFrame([("m1", "module", "Clock Unit", None, "d", None), ("m2", "module", "Gate", None, "d", None)], NODE)
    text = "The clock unit drives the Gate. " * 4
    chunks = spark.createDataFrame([("d", "c1", text, ["b1"], 2), ("d", "c2", text + "fails", ["b2"], 3), ("d", "c3", text + "retry", ["b3"], 4)], "doc_id string, chunk_id string, text string, block_ids array<string>, page int")

    def client(prompt):
        if "fails" in prompt:
            raise OSError("down")
        if prompt.endswith("retry") and not prompt.startswith("The last"):
            return "sorry"
        name = "Clock Unit" if prompt.endswith("retry") else "New Gate Thing"
        return '```json\n{"relations": [{"src": "%s", "src_type": "clock", "relation": "drives", "dst": "the gate", "confidence": 0.7}]}\n```' % name

    made, edges = mentions.run_relations(chunks, nodes, client)
    assert [(r.src, r.dst, r.kind, r.snippet) for r in edges.collect()] == [("m1", "m2", "drives", "Clock Unit drives the gate")]
    assert made.count() == 0  # a new thing's words hold those of Gate
