"""Stages that run again only for what changed, snapshots that readers see as a whole, and parsers one after another."""

import pytest
from pyspark.sql import functions as F

from stratalake.core import snapshots, versions
from stratalake.core.snapshots import Store
from stratalake.plans import build
from stratalake.sources import chain

ROW = "doc_id string, id string, n int"


def rows(df):
    return sorted((r.doc_id, r.id, r.n) for r in df.collect())


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest() is None and store.read("x") is None and store.snapshots() == []
    make = lambda *r: spark.createDataFrame(list(r), ROW)
    first = [(f"d{i}", f"r{i}", i) for i in range(60)]
    draft = store.begin()
    draft.put("x", make(*first), make(*first))
    draft.replace("empty", make().where("false"))
    assert store.manifest() is None  # nothing can be seen before the manifest is there
    assert draft.commit(note="a") == 1
    assert rows(store.read("x")) == sorted(first) and rows(store.read("empty")) == [] and store.read("other") is None
    # A build that ends between two layers leaves the state before; its folders are written again by the next.
    lost = store.begin()
    lost.put("x", make(("d1", "lost", 0)), make(("d1", "", 0), ("d2", "", 0)))
    assert rows(store.read("x")) == sorted(first)
    draft = store.begin()
    draft.put("x", make(("d1", "new", 1), ("z", "more", 2)), make(("d1", "", 0), ("d3", "", 0), ("z", "", 0)))
    assert draft.commit() == 2
    second = sorted([r for r in first if r[0] not in ("d1", "d3")] + [("d1", "new", 1), ("z", "more", 2)])
    assert rows(store.read("x")) == second and rows(store.read("x", 1)) == sorted(first)
    at = store.manifest()["layers"]["x"]["at"]
    assert set(at.values()) == {1, 2}  # untouched buckets are shared
    with pytest.raises(ValueError, match="another build"):
        lost.commit()
    assert store.roll_back(1) == 3 and rows(store.read("x")) == sorted(first) and store.manifest()["about"] == {"note": "a", "restored": 1}
    with pytest.raises(ValueError, match="unknown snapshot"):
        store.roll_back(9)
    assert store.prune(1) == [1, 2] and store.snapshots() == [3] and rows(store.read("x")) == sorted(first)
    assert store._names("data/x") == ["snapshot=1"]


def test_many_folders_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)
    store = Store(spark, str(tmp_path / "s"))
    want = {}
    for i in range(6):
        draft = store.begin()
        new = [(f"d{i}", "a", i), (f"d{i - 1}", "b", i)]
        want |= {r[0]: r for r in new}
        df = spark.createDataFrame(new, ROW)
        draft.put("x", df, df)
        draft.commit()
        assert len(set(store.manifest()["layers"]["x"]["at"].values())) <= 3
    assert rows(store.read("x")) == sorted(want.values())


def test_older_versions_are_read_and_upgraded(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    old = spark.createDataFrame([("d", "c1", 5)], "doc_id string, id string, page int")
    draft = store.begin()
    draft.manifest["version"] = 1
    draft.replace("chunks", old)
    draft.commit()
    assert {"block_ids", "page_start", "chunk_type"} <= set(store.read("chunks").columns)
    assert store.upgrade() == list(range(2, versions.CURRENT + 1)) and store.upgrade() == []
    new = store.read("chunks").first()
    assert (new.page_start, new.chunk_type, new.block_ids) == (5, "section", []) and store.manifest()["version"] == versions.CURRENT
    assert store.manifest(1)["version"] == 1
    store.roll_back(1)
    assert store.manifest()["version"] == 1
    draft = store.begin()
    draft.manifest["version"] = versions.CURRENT + 1
    draft.commit()
    with pytest.raises(ValueError, match="unknown version"):
        store.read("chunks")


def _empty(content):
    return []


def _short(content):
    return chain.PARSERS["markdown"](b"# x")


def _raises(content):
    raise ValueError("broken file")


def test_parser_chain(spark):
    found = spark.createDataFrame([("a.md", bytearray(b"# Title\n\ntext")), ("b.md", bytearray(b"")), ("c.PDF", bytearray(b"# Scan\n\n" + b"word " * 40)), ("d.txt", bytearray(b"x")), ("e.bad", bytearray(b"x")), ("f.one", bytearray(b"# F"))], "path string, content binary")
    parsers = {"empty": _empty, "short": _short, "raises": _raises, "markdown": chain.PARSERS["markdown"]}
    chains = {".md": ["markdown"], ".pdf": ["empty", "short", "unknown", "markdown", "raises"], ".bad": ["raises", "empty"], ".one": ["markdown", "raises"]}
    blocks, told = chain.parse_chain(found, chains, parsers)
    by_doc = {r.doc_id: r.n for r in blocks.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert by_doc == {"a.md": 2, "c.PDF": 2, "f.one": 1}
    got = {r.doc_id: (r.parser, r.status, [(a.parser, a.status) for a in r.attempts], r.reason) for r in told.withColumn("reason", chain.fallback_reason()).collect()}
    assert got["a.md"] == ("markdown", "ok", [("markdown", "succeeded")], None)
    assert got["b.md"] == (None, "failed", [("markdown", "failed")], "markdown: no blocks")
    assert got["c.PDF"] == ("markdown", "degraded", [("empty", "failed"), ("short", "failed"), ("unknown", "unavailable"), ("markdown", "succeeded")], "empty: no blocks; short: quality: scan_like; unknown: not registered")
    assert got["d.txt"] == (None, "unsupported", [], None)
    assert got["e.bad"] == (None, "failed", [("raises", "failed"), ("empty", "failed")], "raises: ValueError: broken file; empty: no blocks")
    assert got["f.one"][:2] == ("markdown", "ok")
    none, told = chain.parse_chain(found.where("false"), {}, parsers)
    assert none.count() == 0 and told.count() == 0


def _light(blocks, cut):
    """In place of all extractors: a node for each heading."""
    nodes = blocks.where("kind = 'heading'").select("doc_id", F.concat("id", F.lit("!")).alias("id"), F.lit("section").alias("kind"), F.col("text").alias("name"))
    edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), "doc_id")
    return {"nodes": nodes, "sections": nodes, "edges": edges}


def _one_link(nodes, blocks, sections):
    ends = nodes.agg(F.min("id").alias("src"), F.max("id").alias("dst"))
    return ends.select("src", "dst", F.lit("alias_of").alias("kind"), F.lit(0.5).alias("confidence"), F.lit("x@1").alias("extractor"))


def _no_link(nodes, blocks, sections):
    raise RuntimeError("no model")


def test_stages_run_for_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "entities_of", _light)
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for name in "abc":
        (src / f"{name}.md").write_text(f"# {name}\n\ntext of {name}\n")
    run = lambda linkers=None, **settings: build.run_build(spark, str(src), out, settings=settings, linkers=linkers or {"one": _one_link})
    first = run()
    assert (first.ran, first.status, first.snapshot) == ({"parse": 3, "segment": 3, "extract": 3, "link": 1}, "success", 1)
    again = run()
    assert (again.ran, again.snapshot, again.changes.count()) == ({"parse": 0, "segment": 0, "extract": 0, "link": 0}, 1, 0)
    assert run(link="x").ran == {"parse": 0, "segment": 0, "extract": 0, "link": 1}
    assert run(link="x", extract=1).ran == {"parse": 0, "segment": 0, "extract": 3, "link": 1}
    assert run(link="x", extract=1, segment=1).ran == {"parse": 0, "segment": 3, "extract": 3, "link": 1}
    settings = {"link": "x", "extract": 1, "segment": 1}
    # A file that can't be read keeps its old rows and is tried again; the others go on.
    (src / "a.md").write_text(" \n")
    (src / "b.md").write_text("# b2\n\nmore\n")
    (src / "c.md").unlink()
    got = run(**settings)
    assert got.ran == {"parse": 2, "segment": 1, "extract": 1, "link": 1} and got.status == "degraded"
    assert got.warnings[0]["stage"] == "parse" and got.warnings[0]["first"].endswith("a.md") and "no blocks" in got.warnings[0]["reason"]
    assert sorted(r.change for r in got.changes.collect()) == ["modified", "modified", "removed"]
    assert sorted(r.name for r in build.read_layer(spark, out, "nodes").collect()) == ["a", "b2"]
    assert sorted(r.name for r in build.read_layer(spark, out, "nodes", 1).collect()) == ["a", "b", "c"]
    assert {r.doc_id[-4:]: r.status for r in build.read_layer(spark, out, "documents").collect()} == {"a.md": "failed", "b.md": "ok"}
    (src / "a.md").write_text("# a2\n")
    # A linker that fails leaves the old links, and is tried again.
    failing = run({"one": _one_link, "two": _no_link}, **settings)
    assert failing.status == "degraded" and failing.warnings == [{"stage": "link", "linker": "two", "reason": "RuntimeError: no model"}]
    assert build.read_layer(spark, out, "links").count() == 1
    assert build.read_layer(spark, out, "nodes").count() == 2
    fine = run({"one": _one_link, "two": _one_link}, **settings)
    assert fine.ran["link"] == 2 and fine.status == "success" and {r.linker for r in build.read_layer(spark, out, "links").collect()} == {"one", "two"}


def test_a_build_that_is_killed_leaves_the_state_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "entities_of", _light)
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.md").write_text("# one\n")
    build.run_build(spark, str(src), out, linkers={"one": _one_link})
    (src / "a.md").write_text("# two\n")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(build, "entities_of", killed)
    with pytest.raises(KeyboardInterrupt):
        build.run_build(spark, str(src), out, linkers={"one": _one_link})
    names = lambda layer: [r[0] for r in build.read_layer(spark, out, layer).select("text" if layer == "blocks" else "name").collect()]
    assert names("blocks") == ["one"] and names("nodes") == ["one"]
    monkeypatch.setattr(build, "entities_of", _light)
    build.run_build(spark, str(src), out, linkers={"one": _one_link})
    assert names("blocks") == ["two"] and names("nodes") == ["two"]


def test_layers_are_complete(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    pins = "| Pin Name | Pin No | Direction |\n|---|---|---|\n| CLK | A1 | IN |\n"
    terms = "\n".join(f"{n}: {n.lower()} something long" for n in ("DMA", "IRQ", "APB", "AXI", "GPIO", "UART"))
    (src / "a.md").write_text(f"# Pins\n\n{pins}\n\n## Abbreviations\n\n{terms}\n\n![Block diagram](x.png)\n")
    assert build.run_build(spark, str(src), out).status == "success"
    nodes = {(r.kind, r.name): r for r in build.read_layer(spark, out, "nodes").collect()}
    assert {("pin", "CLK"), ("term", "DMA"), ("figure", "Block diagram")} <= set(nodes)
    chunks = {r.id: r for r in build.read_layer(spark, out, "chunks").collect()}
    for n in nodes.values():
        assert n.source_chunk_ids and all(set(n.source_block_ids) & set(chunks[c].block_ids) for c in n.source_chunk_ids)
        assert n.status in ("fact", "candidate", "document_entity") and n.method == "deterministic"
    assert nodes["pin", "CLK"].status == "fact" and nodes["pin", "CLK"].issues == []
