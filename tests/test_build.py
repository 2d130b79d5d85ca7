"""Builds, views, model-backed steps with a stub, plug-ins and layout JSON."""

import json

import pytest
from pyspark.sql import functions as F

from stratalake.operators import models, views
from stratalake.plans import build
from stratalake.plans.registry import Registry, merged_config
from stratalake.sources import files, layout


def test_build_is_incremental(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    table = "| Pin Name | Pin No | Direction |\n|---|---|---|\n| CLK | A1 | IN |\n"
    (src / "a.md").write_text(f"# Pins\n\n{table}\n\nREQ_USB_001: must work\n")
    (src / "b.md").write_text(f"# Other\n\n{table}\n")
    assert {r.change for r in build.build(spark, str(src), out).collect()} == {"added"}
    nodes = build.read_layer(spark, out, "nodes")
    assert sorted((r.kind, r.name) for r in nodes.collect()) == [("pin", "CLK"), ("pin", "CLK"), ("requirement", "REQ_USB_001")]
    assert build.link(nodes).count() == 1
    assert build.build(spark, str(src), out).count() == 0
    (src / "a.md").write_text("# Pins\n\nnothing\n")
    (src / "b.md").unlink()
    (src / "c.md").write_text("# New\n\ntext\n")
    assert sorted(r.change for r in build.build(spark, str(src), out).collect()) == ["added", "modified", "removed"]
    assert build.read_layer(spark, out, "nodes").count() == 0
    assert sorted(r.text for r in build.read_layer(spark, out, "chunks").collect()) == ["New\ntext", "Pins\nnothing"]
    blocks = build.read_layer(spark, out, "blocks")
    lost = build.read_layer(spark, out, "chunks").select(F.explode("block_ids").alias("id")).join(blocks.select("id"), "id", "left_anti")
    assert lost.count() == 0


def test_build_of_registers_sections_and_links(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    table = "| Reg name | Field | Bits | Access |\n|---|---|---|---|\n| CTL | EN | [0] | R/W |\n| - | MODE | [3:1] | RO |\n| - | Reserved | [7:4] | RO |\n"
    (src / "a.md").write_text(f"# Core\n\n## Registers\n\n{table}\n\nSee section 1.1 for more.\n\n## Other\n\ntext\n")
    build.build(spark, str(src), out)
    layer = lambda name: build.read_layer(spark, out, name)
    assert sorted((r.kind, r.name) for r in layer("nodes").collect()) == [("bitfield", "EN"), ("bitfield", "MODE"), ("register", "CTL")]
    assert sorted((r.path, r.name) for r in layer("sections").collect()) == [("1", "Core"), ("1.1", "Registers"), ("1.2", "Other")]
    names = {r.id: r.name for r in layer("nodes").unionByName(layer("sections"), allowMissingColumns=True).collect()}
    assert sorted((r.kind, names[r.src], names[r.dst]) for r in layer("edges").collect()) == [("contains", "Core", "Other"), ("contains", "Core", "Registers"), ("has_bitfield", "CTL", "EN"), ("has_bitfield", "CTL", "MODE")]
    links = build.link(layer("nodes"), layer("blocks"), layer("sections")).collect()
    assert [(r.kind, names[r.dst]) for r in links] == [("references", "Registers")]


def test_section_tree(spark):
    s = spark.createDataFrame([("d", "1", "Intro", 1), ("d", "1.2", "Part", 2), ("d", "1.2", "", None), ("d", "1.2.1.1", "Deep", 3), ("d", "2", "Contents", 1), ("d", "10", "Last", 9)], "doc_id string, number string, name string, page int")
    rows = views.section_tree(s).orderBy("sort_key").collect()
    assert [(r.number, r.parent, r.name) for r in rows] == [("1", None, "Intro"), ("1.2", "1", "Part"), ("1.2.1.1", "1.2", "Deep"), ("10", None, "Last")]


def test_views(spark):
    chunks = spark.createDataFrame([("c1", ["b1", "b9"]), ("c2", ["b1"])], "chunk_id string, block_ids array<string>")
    blocks = spark.createDataFrame([("b1",)], "id string")
    nodes = spark.createDataFrame([("n1", ["c1", "c2"], "register")], "id string, source_chunk_ids array<string>, kind string")
    have, links, missing = views.chunk_evidence(spark.createDataFrame([("c1",), ("zz",)], "chunk_id string"), chunks, blocks, nodes)
    assert have.count() == 1 and sorted((r.kind, r.id) for r in links.collect()) == [("block", "b1"), ("entity", "n1")] and [r.chunk_id for r in missing.collect()] == ["zz"]
    e = spark.createDataFrame([("r", "f1", "has_bitfield"), ("r", "f2", "has_bitfield"), ("r", "f1", "x")], "src string, dst string, kind string")
    f = spark.createDataFrame([("f1", 0), ("f2", 7)], "id string, high int")
    assert [r.id for r in views.with_children(spark.createDataFrame([("r",)], "id string"), e, f, "has_bitfield", [F.desc("high")]).orderBy("position").collect()] == ["f2", "f1"]
    docs = views.documents(spark.createDataFrame([("d",), ("e",)], "doc_id string"), spark.createDataFrame([("d", "ok")], "doc_id string, status string"), spark.createDataFrame([("d", 3)], "doc_id string, chunks long"))
    assert sorted((r.doc_id, r.status, r.chunks) for r in docs.collect()) == [("d", "ok", 3), ("e", None, 0)]
    n = spark.createDataFrame([("i", "pin", "P", "d", "fact", 0.9, "deterministic"), ("j", "pin", "Q", "d", "fact", 0.9, "llm")], "id string, kind string, name string, doc_id string, status string, confidence double, method string")
    assert {r.id: r.needs_source_check for r in views.entity_view(n).collect()} == {"i": False, "j": True}


def test_models(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "cached")], "id long, prompt string")
    cache = spark.createDataFrame([("cached", "old")], "prompt string, answer string").select(F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), "answer")
    rows = {r.id: r for r in models.ask(prompts, cache, lambda p: (p.upper(), 10, 5)).collect()}
    assert {k: r.answer for k, r in rows.items()} == {1: "P", 2: "P", 3: "Q", 4: "old"} and rows[4].cost_usd == 0
    assert all(r.over_budget for r in models.ask(prompts, cache, lambda p: (p, 1, 1), budget=0.0).where("id < 4").collect())
    assert models.extract_json('x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and models.extract_json("say [1, 2] ok") == "[1, 2]" and models.extract_json("{broken") is None
    calls = spark.createDataFrame([("x", 1, 2, 0.5), ("x", 1, 2, 0.25)], "extractor string, tokens_in long, tokens_out long, cost_usd double")
    assert models.costs(calls).first().cost_usd == 0.75


def test_registry():
    r = Registry()
    r.register("a", lambda: 1)
    r.register("b", lambda: 2, ("a",))
    r.register("c", lambda: 3, ("b",))
    assert r.order(["c"]) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="unknown"):
        r.order(["zz"])
    r.register("a", lambda: 1, ("c",))
    with pytest.raises(ValueError, match="require each other"):
        r.order()
    assert merged_config({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}


def test_layout(spark):
    doc = {"pages": [{"page_no": 1, "height": 100.0, "items": [{"label": "Section_Header", "text": "1 A", "level": 1, "bbox": [0.0, 10.0, 5.0, 20.0], "origin": "BOTTOMLEFT"}, {"label": "table", "caption": "T", "headers": ["x"], "rows": [["1"]]}, {"label": "text", "text": "p"}]}]}
    rows = layout.layout_blocks(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, layout string")).orderBy("reading_order").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "table"] and rows[0].bbox == [0.0, 80.0, 5.0, 90.0] and rows[2].text == "T"
    pages = spark.createDataFrame([("s", 1, 5, 1, 0.9, 0, 0), ("t", 1, 900, 0, 0.0, 0, 1), ("r", 1, 900, 0, 0.0, 4, 2)], "doc_id string, page int, text_chars int, images int, image_ratio double, register_hits int, table_hits int")
    profile = layout.pdf_profile(pages)
    chosen = lambda q: {r.doc_id: r.p for r in profile.withColumn("p", layout.choose_parser(q)).collect()}
    assert chosen("fast") == {"s": "text_layer", "t": "text_layer", "r": "text_layer"}
    assert chosen("balanced") == {"s": "ocr", "t": "layout", "r": "layout"} and chosen("accurate") == {"s": "ocr", "t": "layout", "r": "ocr"}
    with pytest.raises(ValueError, match="quality"):
        layout.choose_parser("best")
    got = spark.range(1).select(layout.parse_verdict(F.lit(30), F.lit(1)).alias("v"), layout.parser_chain(F.lit("a"), F.array(F.lit("b"), F.lit("a"))).alias("c")).first()
    assert got.v == "scan_like" and got.c == ["a", "b"]


def test_doc_types(spark):
    names = {"x/Chip_TRM.pdf": "reference_manual", "a/errata v2.md": "errata", "datasheet.pdf": "datasheet", "User Guide.docx": "user_guide", "app_note_3.pdf": "app_note", "bus_spec.md": "protocol", "notes.txt": "unknown"}
    rows = spark.createDataFrame(list(names), "string").select("value", files.doc_type(F.col("value")).alias("t")).collect()
    assert {r.value: r.t for r in rows} == names
