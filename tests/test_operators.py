"""Structured inputs that the driver's tables lack: headings, tables, registers, graphs, files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalake.core.storage import materialize
from stratalake.functions import text as T
from stratalake.operators import audits, blocks, chunks, exports, extract, graph, incremental, retrieval
from stratalake.sources import files

TABLE = "doc_id string, id string, caption string, headers array<string>, rows array<array<string>>"


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression).first()[0]


def test_heading_path(spark):
    cases = {"1.2.3 Title": "1.2.3", "2. Registers": "2", "Chapter 4 Clocks": "4", "Appendix B Notes": "B", "A.1 More": "A.1", "Plain text": None, "10GBASE": "10", "Appendix because": None}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", T.heading_path(F.col("t"))).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_names_and_ids(spark):
    assert {one(spark, T.resolver_key(F.col("n")), n=n) for n in ("TIM1_CR1", "TIM1-CR1", "tim1 cr1")} == {"TIM1CR1"}
    assert one(spark, T.path_token(F.lit("./docs/a b/é.md"))) == "docs/a%20b/%C3%A9.md"
    assert one(spark, T.make_doc_id(F.lit("chip"), F.lit("trm"), F.lit("1.0"), F.lit("a b.md"))) == "chip::trm@1.0::a%20b.md"
    assert one(spark, T.node_id(F.lit("chip"), F.lit("reg"), F.lit("CR 1"), F.lit("d"))) == "chip::reg:CR_1#d"


@pytest.mark.parametrize("text,want", [("15:8", (15, 8)), ("[3]", (3, 3)), ("bit 7", (7, 7)), ("0-4", (4, 0)), ("none", None), ("12", (12, 12))])
def test_bit_range(spark, text, want):
    got = one(spark, T.bit_range(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


def test_access_reset_prefix(spark):
    assert [one(spark, T.ipxact_access(F.lit(a))) for a in ("RW", "ro", "?")] == ["read-write", "read-only", "read-write"]
    assert [one(spark, T.format_reset(F.lit(a))) for a in ("0x1F", "0b101", "10", "x")] == ["0x1F", "0x5", "0xa", "0"]
    assert one(spark, T.prefix_matches(F.lit("0x13800000"), F.lit("0x13800020"))) and not one(spark, T.prefix_matches(F.lit("0x13800000"), F.lit("0x14000000")))


def blocks_df(spark, rows):
    return spark.createDataFrame(rows, "id string, doc_id string, page int, kind string, reading_order int, text string, section_path string")


def test_segment_chunks(spark):
    b = blocks_df(spark, [
        ("d#p1#b0", "d", 1, "heading", 0, "1 Introduction", None), ("d#p1#b1", "d", 1, "paragraph", 1, "short prose", "1"), ("d#p1#b2", "d", 1, "heading", 2, "2 Registers", None),
        ("d#p1#b3", "d", 1, "table", 3, "Register table", "2"), ("d#p1#b4", "d", 1, "heading", 4, "3 Figures", None), ("d#p1#b5", "d", 1, "figure", 5, "caption", "3"),
    ])
    rows = sorted(chunks.segment_chunks(b).collect(), key=lambda r: r.ordinal)
    assert [(r.chunk_type, r.section, r.block_ids) for r in rows] == [
        ("section", "1", ["d#p1#b0", "d#p1#b1"]), ("section", "2", ["d#p1#b2"]), ("table", "2", ["d#p1#b3"]), ("section", "3", ["d#p1#b4"]), ("figure", "3", ["d#p1#b5"]),
    ]
    assert len({r.id for r in rows}) == 5
    long = blocks_df(spark, [(f"d#b{i}", "d", 1, "paragraph", i, "x" * 900, None) for i in range(7)])
    assert [len(r.block_ids) for r in sorted(chunks.segment_chunks(long).collect(), key=lambda r: r.ordinal)] == [3, 3, 1]


def test_segment_chunks_without_numbers(spark):
    b = blocks_df(spark, [("d#b0", "d", 1, "heading", 0, "44.144.126.223 +1 Th anatble", None), ("d#b1", "d", 1, "paragraph", 1, "prose", None)])
    assert [r.section for r in chunks.segment_chunks(b).collect()] == ["44.144.126.223"]
    assert [(r.id, r.section, r.block_ids) for r in chunks.segment_chunks(b, numbered=False).collect()] == [("d#section#p1#0", None, ["d#b0", "d#b1"])]


def test_split_oversized(spark):
    text = " ".join(f"Sentence number {i} has some content about registers." for i in range(60))
    df = spark.createDataFrame([("c", text, 7), ("s", "short.", 8), ("l", "y" * 4500, 9)], "id string, text string, page int")
    rows = chunks.split_oversized(df).collect()
    parts = sorted((r for r in rows if r.parent == "c"), key=lambda r: r.split_part)
    assert len(parts) >= 2 and all(len(p.text) <= 2200 for p in parts) and all(f"number {i} " in " ".join(p.text for p in parts) for i in range(60))
    assert [len(r.text) for r in rows if r.parent == "l"] == [2000, 2000, 500] and [r.id for r in rows if r.parent == "s"] == ["s"]
    assert {r.id for r in parts} == {f"c_part{i + 1}of{len(parts)}" for i in range(len(parts))}


def test_split_tables(spark):
    df = spark.createDataFrame([("t", "Table 1", ["A", "B", "C"], [[f"r{i}", "value " * 3, "x"] for i in range(120)]), ("s", None, ["A"], [["1"]])], "id string, caption string, headers array<string>, rows array<array<string>>")
    rows = chunks.split_tables(df).collect()
    own = sorted((r for r in rows if r.id.startswith("t")), key=lambda r: r.row_start)
    assert len(own) >= 2 and all(r.text.startswith("Table 1\n| A | B | C |") for r in own)
    assert [r.row_start for r in own] == [0, *[r.row_end + 1 for r in own[:-1]]] and own[-1].row_end == 119
    assert [r.id for r in rows if r.row_total == 1] == ["s"]


def test_logical_tables(spark):
    t = spark.createDataFrame([("d", 1, "a", 1, 1, "Table 3 Regs", ["X"], [["1"]]), ("d", 2, "b", 2, 2, "Table 3 (continued)", ["X"], [["2"]]), ("d", 4, "c", 9, 9, "Table 3", ["X"], [["3"]])], "doc_id string, pos int, id string, page_start int, page_end int, caption string, headers array<string>, rows array<array<string>>")
    rows = chunks.logical_tables(chunks.table_profiles(t).withColumn("text", F.col("table_text"))).collect()
    assert sorted(r.parts for r in rows) == [1, 2]
    assert [r.id.startswith("a_logical_") for r in rows if r.parts == 2] == [True]


def test_table_kinds(spark):
    kind = lambda caption, *headers: one(spark, T.table_kind(F.lit(caption), F.array(*[F.lit(h) for h in headers])))
    assert kind(None, "Reg name", "Field", "Msb", "Lsb") == "register_table" and kind("Memory map", "Offset", "Size") == "memory_map"
    assert kind(None, "Signal", "Width", "Direction") == "signal_table" and kind(None, "A", "B") == "generic_table" and kind("Fields for register X", "A") == "register_table"


def test_register_fields_and_exports(spark):
    rows = [["CTRL", "1", "EN", "0", "0", "RW", "RW", "0x0", "enable"], ["", "", "MODE", "3", "1", "RO", "RW", "2", "mode"], ["STAT", "2", "reserved", "7", "4", "RO", "RO", "0", ""], ["", "", "BUSY", "0", "0", "RO", "RO", "0", "busy"]]
    t = spark.createDataFrame([("d", "t", "Register table", ["Reg name", "reg_num", "Field", "Msb", "Lsb", "SWaccess", "HWaccess", "Default", "Description"], rows)], TABLE)
    got = extract.register_fields(t)
    assert sorted((r.register, r.name, r.high, r.low) for r in got.collect()) == [("CTRL", "EN", 0, 0), ("CTRL", "MODE", 3, 1), ("STAT", "BUSY", 0, 0)]
    regs = got.select(F.lit("chip").alias("component"), F.col("register").alias("name")).distinct().withColumn("offset", F.lit("0x4")).withColumn("width", F.lit(32)).withColumn("access", F.lit("RW"))
    [xml] = exports.ipxact(regs, got).collect()
    assert xml.registers == 2 and xml.text.index("MODE") < xml.text.index("EN<") and "<ipxact:bitWidth>3</ipxact:bitWidth>" in xml.text
    import xml.etree.ElementTree as E

    E.fromstring(xml.text.encode())
    [rdl] = exports.systemrdl(regs, got).collect()
    assert "field { sw = r; } MODE[3:1] = 0x2;" in rdl.text and "} CTRL @ 0x4;" in rdl.text


def test_entities_from_tables(spark):
    make = lambda caption, headers, rows: spark.createDataFrame([("d", "t", caption, headers, rows)], TABLE)
    maps = make("Memory map", ["NoC Master", "NoC Slave", "Offset", "Size", "Description"], [["m", "Top CFG", "0x00000000", "1MB", ""], ["m", "CRG CFG", "0x00100000", "1MB", ""]])
    assert sorted((r.name, r.address) for r in extract.entities(maps, "memory_map").collect()) == [("CRG CFG", "0x00100000"), ("Top CFG", "0x00000000")]
    irq = make(None, ["type", "irq_src信号", "位宽", "Description"], [["function", "radm_cpl_timeout", "1", ""]])
    assert [r.name for r in extract.entities(irq, "interrupt").collect()] == ["radm_cpl_timeout"]
    pins = make(None, ["Pin Name", "Pin No", "Direction", "Type", "Description"], [["CLK_IN", "A1", "IN", "", ""], ["DATA0", "B2", "IO", "", ""], ["Pin Name", "Pin No", "", "", ""]])
    assert sorted((r.name, r.number) for r in extract.entities(pins, "pin").collect()) == [("CLK_IN", "A1"), ("DATA0", "B2")]
    iface = make(None, ["Name", "Protocol", "Width", "Details"], [["DebugBlock", "AMBA 4 APB", "32-bit", ""]])
    assert [(r.name, r.protocol) for r in extract.entities(iface, "interface").collect()] == [("DebugBlock", "AMBA 4 APB")]
    timing = make(None, ["Symbol", "Min", "Typ", "Max", "Unit", "Condition"], [["t_setup", "2", "5", "10", "ns", ""], ["t_hold", "1", "3", "8", "ns", ""]])
    assert sorted((r.name, r.max) for r in extract.entities(timing, "timing").collect()) == [("t_hold", "8"), ("t_setup", "10")]
    cons = make(None, ["Constraint", "Target", "Value", "Unit", "Corner", "Description"], [["clock_uncertainty", "core_clk", "0.08", "ns", "ss", ""]])
    assert [r.target for r in extract.entities(cons, "constraint").collect()] == ["core_clk"]
    phys = make(None, ["Rule", "Object", "Layer", "Region", "Spacing"], [["r1", "macro_a", "M4", "core", "0.2"]])
    kinds = extract.with_schemas(phys).first().schemas
    assert "physical_constraint" in kinds and "constraint" not in kinds
    assert extract.entities(make("Address map", ["Name", "Protocol", "Offset"], [["a", "b", "c"]]), "interface").count() == 0


def test_text_entities_and_glossary(spark):
    b = blocks_df(spark, [("b1", "d", 1, "paragraph", 0, "REQ_PCIE_001: must link REQ_PCIE_002: must train", None), ("b2", "d", 1, "paragraph", 1, "ERR012345 bad cache ERR099888 bad tlb", None), ("b3", "d", 2, "paragraph", 2, "\n".join(f"AB{i}  Alpha Beta {i}" for i in range(5)), None)])
    rows = extract.text_entities(b).collect()
    assert sorted((r.kind, r.name, r.summary) for r in rows) == [("errata", "ERR012345", "bad cache"), ("errata", "ERR099888", "bad tlb"), ("requirement", "REQ_PCIE_001", "must link"), ("requirement", "REQ_PCIE_002", "must train")]
    assert sorted(r.name for r in extract.glossary(b).collect()) == [f"AB{i}" for i in range(5)]


def test_best_bitfields(spark):
    f = spark.createDataFrame([("r", 0, "WHOLE", 0, 15), ("r", 1, "LOW", 0, 7), ("r", 2, "HIGH", 8, 15), ("r", 3, "BAD", 5, 2)], "register string, idx int, name string, low int, high int")
    assert {r.name for r in audits.best_bitfields(f).collect() if r.kept} == {"LOW", "HIGH"}


NODE = "id string, kind string, name string, doc_id string"


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "n", x, "d") for x in "ABCDE"], NODE)
    edges = spark.createDataFrame([("A", "B", "c"), ("B", "C", "c"), ("C", "D", "c"), ("A", "A", "c")], "src string, dst string, kind string")
    path = graph.trace(edges, spark.createDataFrame([("A", "D"), ("D", "A"), ("B", "B")], "from_id string, to_id string")).collect()
    assert sorted((r.from_id, r.to_id, r.length, r.path) for r in path) == [("A", "D", 3, ["A", "B", "C", "D"]), ("B", "B", 0, ["B"])]
    near, inside = graph.neighbors(nodes, edges, "B", 1)
    assert sorted(r.id for r in near.collect()) == ["A", "B", "C"] and inside.count() == 3
    assert sorted(r.id for r in graph.impact(nodes, edges, "D", 2).collect()) == ["B", "C"]
    assert graph.neighbors(nodes, edges, "missing", 2)[0].count() == 0


def test_trace_grows_paths_once_a_source(spark, monkeypatch):
    edges = spark.range(60).select(F.lit("R").alias("src"), F.concat(F.lit("n"), F.col("id") % 3, F.lit("_"), "id").alias("dst"))
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("leaf"), "dst").alias("dst")))
    pairs = edges.where("dst LIKE 'leaf%'").select(F.lit("R").alias("from_id"), F.col("dst").alias("to_id"))
    rows = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: (lambda out: rows.append(out.count()) or out)(materialize(df, name)))
    path = graph.trace(edges, pairs.unionByName(pairs)).collect()
    assert sorted((r.from_id, r.length, r.path[-1]) for r in path) == sorted(("R", 2, r.to_id) for r in pairs.collect())
    assert max(rows) <= 60  # not a row for each pair and node


def test_linkers(spark):
    n = spark.createDataFrame([("a", "register", "CR1", "d1", "x", 10, 5, None, 1), ("b", "register", "cr-1", "d2", "x", 100, 9, None, 2), ("c", "register", "CR1", "d3", "y", 1, 1, None, 3)], "id string, kind string, name string, doc_id string, instance string, priority int, page int, qualified_name string, seq int")
    assert [(r.src, r.dst) for r in graph.alias_edges(n).collect()] == [("a", "b")]
    two = n.withColumn("name", F.lit("CR1"))
    assert [(r.src, r.dst, r.kind) for r in graph.federation_edges(two).collect()] == [("b", "a", "supersedes")]
    refs = graph.references(spark.createDataFrame([("s", "d", "See Section 3.2 and Table 7-2, Fig. 4")], "id string, doc_id string, text string"))
    assert sorted((r.target_kind, r.target_key) for r in refs.collect()) == [("figure", "4"), ("section", "3.2"), ("table", "7-2")]
    edges, left = graph.resolve_references(refs, spark.createDataFrame([("s32", "d", "section", "3.2"), ("o32", "e", "section", "3.2")], "id string, doc_id string, kind string, key string"))
    assert [(r.src, r.dst) for r in edges.collect()] == [("s", "s32")] and left.count() == 2
    e = spark.createDataFrame([("r1", "d", "3.2"), ("r2", "d", "9")], "id string, doc_id string, section_path string")
    s = spark.createDataFrame([("sec", "d", "3.2", "Clock Unit")], "id string, doc_id string, path string, name string")
    m = spark.createDataFrame([("mod", "d", "clock_unit")], "id string, doc_id string, name string")
    assert [(r.src, r.dst, r.confidence) for r in graph.belongs_to(e, s, m).collect()] == [("r1", "mod", 0.9)]
    assert [(r.src, r.dst, r.confidence) for r in graph.belongs_to(e, s, m.where("false")).collect()] == [("r1", "sec", 0.85)]


def test_section_parents(spark):
    toc = spark.createDataFrame([("d", 0, 1, "a"), ("d", 1, 2, "b"), ("d", 2, 3, "c"), ("d", 3, 2, "e"), ("d", 4, 1, "f"), ("d", 5, 3, "g")], "doc_id string, pos int, level int, id string")
    assert {r.id: r.parent for r in graph.section_parents(toc).collect()} == {"a": None, "b": "a", "c": "b", "e": "a", "f": None, "g": "f"}


def test_section_parents_of_many_levels(spark):
    toc = spark.createDataFrame([("d", i, i + 1, f"h{i}") for i in range(12)] + [("d", 12, 3, "back")], "doc_id string, pos int, level int, id string")
    assert {r.id: r.parent for r in graph.section_parents(toc).collect()} == {"h0": None, **{f"h{i}": f"h{i - 1}" for i in range(1, 12)}, "back": "h1"}
    assert [r.parent for r in graph.section_parents(toc.where("pos = 4")).collect()] == [None]


def test_subtree_totals(spark):
    import random

    rng = random.Random(1)
    parent = {i: (i - 1 if i < 40 else rng.randrange(i)) for i in range(1, 300)} | {0: None, 300: 999, 301: None}
    value = {i: rng.randint(0, 9) for i in parent}
    members, total = dict.fromkeys(parent, 0), dict.fromkeys(parent, 0)
    for i in parent:
        at = i
        while at is not None and at in parent:
            members[at] += 1
            total[at] += value[i]
            at = parent[at]
    nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id int, parent int, v long")
    assert {r.id: (r.members, r.total) for r in graph.subtree_totals(nodes, F.col("v")).collect()} == {i: (members[i], total[i]) for i in parent}
    assert graph.subtree_totals(nodes.where("false")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        graph.subtree_totals(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"))


def test_merges(spark):
    obs = spark.createDataFrame([("n", 1, "N", None, "h1", "candidate", 0.5, ["x"], ["b1"]), ("n", 2, "M", "sum", "h2", "fact", 0.9, ["x", "y"], ["b2"]), ("n", 3, "", "other", "h3", "rejected", 0.0, None, None)], "id string, seq int, name string, summary string, hash string, status string, confidence double, aliases array<string>, block_ids array<string>")
    r = graph.merge_nodes(obs.fillna({"name": ""})).first()
    assert (r.name, r.summary, r.hash, r.status, r.observations) == ("N", "sum", "h3", "fact", 3)
    e = spark.createDataFrame([("a", "b", "k", 0.4, "x@1:t", 1), ("a", "b", "k", 0.8, "y@1:t", 2), ("a", "z", "k", 0.8, "x@1", 3)], "src string, dst string, kind string, confidence double, extractor string, seq int")
    got = graph.merge_edges(e, spark.createDataFrame([("a",), ("b",)], "id string")).collect()
    assert [(r.src, r.dst, r.confidence, r.extractor) for r in got] == [("a", "b", 0.8, "x@1:t+y@1:t")]
    assert graph.without_derived(graph.merge_edges(e), ["x"]).count() == 1
    nodes = spark.createDataFrame([("a", "n", "A", "d1"), ("b", "n", "B", "d2")], NODE)
    kept, left = graph.delete_docs(spark.createDataFrame([("d2",)], "doc_id string"), nodes, e)
    assert [r.id for r in kept.collect()] == ["a"] and left.count() == 1


def test_retrieval(spark):
    c = spark.createDataFrame([(1, "low", "alpha once in a longer sentence"), (2, "high", "alpha alpha alpha alpha"), (3, "p", "utilization is 50%"), (4, "z", "中断控制器配置寄存器"), (5, "o", "ordinary text")], "doc_id long, chunk_id string, text string")
    assert [(r.chunk_id, r.method) for r in retrieval.search_text(c, "alpha", 1).collect()] == [("high", "fts")]
    assert [r.chunk_id for r in retrieval.search_text(c, "50%").collect()] == ["p"]
    assert [(r.chunk_id, r.method) for r in retrieval.search_text(c, "中断").collect()] == [("z", "like")]
    assert retrieval.search_text(c, "  ").count() == 0
    assert retrieval.query_terms("find the DMA descriptions for reset_ctrl, dma") == ["dma", "reset_ctrl"]
    assert retrieval.query_terms("如何配置中断")[:2] == ["配置中断", "配置"]


def test_bm25_against_sqlite(spark):
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(id unindexed, text, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    texts = ["per vector misc", "the quick brown fox the quick", "quick quick brown", "Élan vital quick brown fox", "nothing here", "a per_vector_misc b"]
    con.executemany("insert into f values (?, ?)", list(enumerate(texts)))
    c = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, chunk_id string, text string")
    for phrase in ("quick", "quick brown", "per vector misc", "elan"):
        want = {str(i): round(s, 6) for i, s in con.execute("select id, bm25(f) from f where f match ?", (f'"{phrase}"',))}
        assert {r.chunk_id: round(r.score, 6) for r in retrieval.bm25_phrase(c, phrase, None).collect()} == want


def test_vectors_and_diffs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [(r.id, r.similarity) for r in retrieval.nearest(v, q, 2).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107)]
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "item_id string, content_hash string"), spark.createDataFrame([("y", "3"), ("z", "1")], "item_id string, content_hash string")
    assert sorted((r.item_id, r.action) for r in retrieval.stale_items(a, b).collect()) == [("x", "missing"), ("y", "stale"), ("z", "prune")]
    enc = retrieval.hash_encode(spark.createDataFrame([(1, "alpha beta alpha"), (2, "")], "id long, t string"), "id", "t", 64).collect()
    assert abs(sum(r.value**2 for r in enc) - 1) < 1e-9
    n = spark.createDataFrame([("i1", "CTRL", None, ["C"]), ("i2", "CTRL_X", "top.C", [])], "id string, name string, qualified_name string, aliases array<string>")
    assert [[r.id for r in retrieval.entity_cascade(n, x).collect()] for x in ("CTRL", "C", "top.C", "ctrl", "zz")] == [["i1"], ["i1"], ["i2"], ["i1", "i2"], []]


def test_audits(spark):
    e = spark.createDataFrame([("register", "CTRL"), ("register", "MISSING")], "kind string, name string")
    a = spark.createDataFrame([("register", "CTRL"), ("register", "STATUS")], "kind string, name string")
    r = audits.golden_eval(e, a, ["name"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    nodes = spark.createDataFrame([("n", "fact", "model", False, 1, ["b"], [])], "id string, status string, method string, verified boolean, errors int, source_block_ids array<string>, source_chunk_ids array<string>")
    assert {r.code for r in audits.trust_issues(nodes).collect()} == {"l2.fact_method", "l2.fact_unverified", "l2.fact_has_errors"}
    none = spark.createDataFrame([], "id string")
    assert {r.code for r in audits.provenance_issues(nodes, none, none).collect()} == {"l2.missing_source_chunks", "l2.bad_source_block"}
    assert extract.trust(nodes.withColumn("kind", F.lit("pin"))).first().status == "candidate"


def test_boxes_and_near_headings(spark):
    box = "doc_id string, page int, id string, x0 double, y0 double, x1 double, y1 double"
    t = spark.createDataFrame([("d", 1, "in", 1.0, 1.0, 3.0, 3.0), ("d", 1, "out", 50.0, 50.0, 60.0, 60.0), ("d", 2, "other", 1.0, 1.0, 3.0, 3.0)], box)
    assert sorted(r.id for r in blocks.boxes_outside(t, spark.createDataFrame([("d", 1, "t", 0.0, 0.0, 10.0, 10.0)], box)).collect()) == ["other", "out"]
    b = blocks_df(spark, [("0", "d", 1, "heading", 0, "Registers", None), *[(str(i), "d", 1, "paragraph", i, "text", None) for i in range(1, 5)], ("5", "d", 1, "table", 5, "", None)])
    assert blocks.nearest_table_heading(b).first().near_heading == "Registers"


def test_incremental(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, mtime double")
    got = incremental.snapshot_diff(s([("a", 1.0), ("b", 1.0)]), s([("a", 2.0), ("c", 1.0)]), "path", "mtime")
    assert sorted((r.path, r.change) for r in got.collect()) == [("a", "modified"), ("b", "removed"), ("c", "added")]
    stored = spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int")
    new = spark.createDataFrame([("k", 5, 1), ("k", 6, 2)], "key string, v int, seq int")
    assert sorted((r.key, r.v) for r in incremental.upsert(stored, new, ["key"]).collect()) == [("k", 6), ("l", 2)]
    f = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3")], "path string, fingerprint string")
    m = spark.createDataFrame([("a", "f1", "extracted", 0), ("b", "f2", "extracted", 1)], "path string, fingerprint string, status string, warnings int")
    assert sorted(r.path for r in incremental.to_build(f, m).collect()) == ["b", "c"]


def test_markdown_and_grid():
    text = "# One\n\nprose\nmore\n\n## A\n\n## B\n\n```\ncode\n```\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n![fig](x.png)\n"
    got = files.markdown_blocks(text)
    assert [(b["kind"], b["section_path"]) for b in got] == [("heading", "1"), ("paragraph", "1"), ("heading", "1.1"), ("heading", "1.2"), ("code", "1.2"), ("table", "1.2"), ("figure", "1.2")]
    assert got[5]["headers"] == ["A", "B"] and got[5]["rows"] == [["1", "2"]]
    h, r = files.html_grid("<table><tr><th rowspan=2>A<th colspan=2>B</tr><tr><td>x<td>y</tr><tr><td>1<td>2<td>3</tr></table>")
    assert h == ["A", "B", "B"] and r == [["A", "x", "y"], ["1", "2", "3"]]
    assert files.html_grid("") == ([], [])


def test_office_files(spark, tmp_path):
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Regs"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>Off</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row/><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>4.0</v></c></row></sheetData></worksheet>')
    w = io.BytesIO()
    with zipfile.ZipFile(w, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Intro', 'Heading1')}{p('text')}<w:tbl><w:tr><w:tc>{p('A')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "a.xlsx").write_bytes(x.getvalue())
    (tmp_path / "b.docx").write_bytes(w.getvalue())
    (tmp_path / "c.md").write_text("# T\n\nhello")
    (tmp_path / "bad.docx").write_bytes(b"zip?")
    (tmp_path / "skip.bin").write_bytes(b"")
    found = files.discover(spark, str(tmp_path), exclude=[r"skip"])
    rows = files.parse_files(found).collect()
    name = lambda r: r.doc_id.rsplit("/", 1)[-1]
    assert [(r.kind, r.headers, r.rows) for r in rows if name(r) == "a.xlsx" and r.kind == "table"] == [("table", ["Name", "Off"], [["", "4"]])]
    assert [r.kind for r in rows if name(r) == "b.docx"] == ["heading", "paragraph", "table"]
    assert [r.section_path for r in rows if name(r) == "c.md"] == ["1", "1"]
    assert [r.error is not None for r in rows if name(r) == "bad.docx"] == [True]
    assert files.parse_files(found.where("path LIKE '%c.md'")).where("id IS NOT NULL").count() == 2


def test_html_tables(spark):
    p = spark.createDataFrame([(1, "<p>x</p><table><tr><td>a<td>b</tr><tr><td>1<td>2</tr></table>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.headers, r.rows) for r in files.html_tables(p).collect()] == [(1, ["a", "b"], [["1", "2"]])]


def test_streaming_equals_batch(spark, tmp_path, sf_dir):
    from stratalake.streaming.watch import change_bursts, ingest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, part in enumerate(docs.randomSplit([0.5, 0.5], 7)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    q = ingest(spark, str(tmp_path / "in/*"), docs.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert got.select("chunk_id").exceptAll(chunks.line_chunks(docs).select("chunk_id")).count() == 0 and got.count() == chunks.line_chunks(docs).count()
    assert change_bursts(spark.createDataFrame([], "path string, ts timestamp"), "path", "ts").columns == ["path", "begin_ts", "end_ts", "changes"]


def test_registers_from_odd_tables(spark):
    make = lambda caption, headers, rows: spark.createDataFrame([("d", "t", caption, headers, rows)], TABLE)
    # Bits of the field four bits before, overlaps, a register's name in another column, a caption that announces it.
    t = make("Fields for register: GPIO_CFG", ["Field", "Bits", "Type", "Description"], [["a_bit0", "[3:0]", "RW", ""], ["a_bit4", "", "RW", ""], ["a_bit8", "", "RW", ""], ["wide", "[31:0]", "RO", "all"], ["", "[9]", "", "Sets the mode. More"], ["x", "", "", "no bits"]])
    regs, fields = extract.registers(t)
    assert [(r.name, r.width) for r in regs.collect()] == [("GPIO_CFG", 32)]
    assert sorted((r.name, r.high, r.low, r.kept) for r in fields.collect()) == [("Sets_the_mode", 9, 9, False), ("a_bit0", 3, 0, False), ("a_bit4", 3, 0, False), ("a_bit8", 3, 0, False), ("wide", 31, 0, True)]
    t = make("Register list of the unit", ["Register", "Register number", "Access"], [["The DMA Control Register", "3", "read-only"], ["nothing here", "4", "RW"], ["UART_STATUS", "0x10", "W1C"]])
    regs, fields = extract.registers(t)
    assert fields.count() == 0 and sorted((r.name, r.offset, r.access) for r in regs.collect()) == [("DMA_Control_Register", "0xC", "RO"), ("UART_STATUS", "0x40", "W1C")]
    t = make(None, ["Reg name", "Name", "Msb", "Lsb", "Access"], [["", "F", "40", "33", "RW"], ["UART_CTRL0", "G", "2", "5", "R"]])
    assert sorted((r.register, r.name, r.high, r.low) for r in extract.registers(t)[1].collect()) == [("UART_CTRL0", "G", 5, 2)]
    groups = make(None, ["Interface Group", "Direction", "Description"], [["Clock/Reset", "", ""], ["clk_in", "I", "x"], ["rst_n", "Input", ""], ["axi_req[3:0]", "output", ""]])
    assert sorted((r.name, r.direction) for r in extract.entities(groups, "signal").collect()) == [("axi_req[3:0]", "OUT"), ("clk_in", "IN"), ("rst_n", "IN")]


def test_registers_write_a_line_once(spark, monkeypatch):
    # A table of plain fields: one row for it is written, then one for each field, with what is the same for all lines left out.
    written = {}

    def counted(df, name="table"):
        out = materialize(df, name)
        written[name] = (out.count(), len(out.columns))
        return out

    monkeypatch.setattr(extract, "materialize", counted)
    monkeypatch.setattr(audits, "materialize", counted)
    rows = [["A_CTRL" if i == 0 else "-", f"F{i}", f"[{i}]", "RW", "text"] for i in range(20)]
    t = spark.createDataFrame([("d", "t", None, ["Reg name", "Field", "Bits", "Access", "Description"], rows)], TABLE)
    regs, fields = extract.registers(t)
    assert fields.where("kept AND register = 'A_CTRL'").count() == 20 and [(r.name, r.width) for r in regs.collect()] == [("A_CTRL", 32)]
    assert sum(n for n, _ in written.values()) == 21 and sum(n * wide for n, wide in written.values()) < 21 * 25



def test_golden_files_and_encoder_errors(spark):
    from stratalake.operators import audits, embed

    made = [("x/expected_pins.json", '["CLK", {"symbol": "RST", "doc_id": 3}, {}]'), ("y.json", '{"registers": [{"name": "CTL"}], "other": ["z"], "timing": "t_su"}'), ("z.json", '{"kind": "Memory-Maps", "name": "ROM"}'), ("bad.json", "{"), ("list.json", '["a"]')]
    rows = audits.golden_entities(spark.createDataFrame(made, "path string, content string")).collect()
    assert sorted((r.kind, r.name, r.doc_id) for r in rows) == sorted([("pin", "CLK", None), ("pin", "RST", "3"), ("register", "CTL", None), ("parameter", "t_su", None), ("memory_map", "ROM", None)], key=str)
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, content_hash string, vector array<double>")
    assert embed.embedded(items, none, lambda t: [[1.0, 2.0]] * len(t), 2).count() == 2
    for broken in (lambda t: [[1.0]] * len(t), lambda t: []):
        with pytest.raises(Exception, match="vectors for"):
            embed.embedded(items, none, broken, 2).collect()


def test_pieces_of_batches():
    import pyarrow as pa

    from stratalake.core.batches import pieces

    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * n)], ["text"]) for n in (100, 0, 1)]
    got = list(pieces(batches, size=10_000))
    assert sum(p.num_rows for p in got) == 101 and max(p.num_rows for p in got) <= 10 and max(p.num_rows for p in pieces(batches, rows=3)) == 3
    assert [p.num_rows for p in pieces([pa.RecordBatch.from_arrays([pa.array(["y" * 50_000] * 2)], ["text"])], size=10_000)] == [1, 1]


def test_nearest_over_several_pieces(spark):
    # Products of 1,200 queries and 4,000 vectors don't fit one piece; many are equal, so that ids decide over pieces.
    import math

    at = lambda i: [math.cos(i % 7), math.sin(i % 7)]
    v = spark.createDataFrame([(i, at(i)) for i in range(4000)], "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(i, at(i)) for i in range(1200)], "query_id long, query_vec array<double>")
    assert 1200 * 4000 > 2 * retrieval.SIMILARITIES
    got = retrieval.nearest(v, q, 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect()
    assert len(got) == 1200 and all([r.id for r in g.x] == [g.query_id % 7 + 7 * k for k in range(3)] for g in got)


def test_components_one_after_another(spark):
    # Several components in one task, one of them over many batches; nothing gathers a component's lines in an aggregate.
    regs = spark.range(25_000).select(F.when(F.col("id") < 24_000, "big").otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("component"), F.format_string("R%05d", F.col("id")).alias("name"), F.lit("0x0").alias("offset"), F.lit(32).alias("width"), F.lit("RW").alias("access"))
    fields = regs.select(F.col("name").alias("register"), F.lit("EN").alias("name"), F.lit(0).alias("high"), F.lit(0).alias("low"), F.lit("RO").alias("access"), F.lit(None).cast("string").alias("reset"))
    out = exports.systemrdl(regs, fields)
    got = {r.component: r for r in out.collect()}
    assert {k: r.registers for k, r in got.items()} == {"big": 24_000, "c0": 334, "c1": 333, "c2": 333}
    line = "  reg {\n    field { sw = r; } EN[0:0] = 0x0;\n  } %s @ 0x0;"
    for k, r in got.items():
        names = [f"R{i:05d}" for i in range(25_000) if (k == "big") == (i < 24_000) and (i < 24_000 or k == f"c{i % 3}")]
        assert r.text == "\n".join([f"addrmap {k} {{", *(line % n for n in names), "};"])
    assert "component, collect_list" not in out._jdf.queryExecution().analyzed().toString() and "Aggregate [component" not in out._jdf.queryExecution().analyzed().toString()
