"""What a step holds and how often it reckons: steps whose memory or work grew faster than their input."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from stratalake.core.session import few_at_once
from stratalake.core.storage import materialize
from stratalake.operators import audits, chunks, exports, extract, mentions
from stratalake.plans import catalog_tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _cut(text: str, most: int, over: int) -> list[str]:
    """Sentences of words with a point, packed as split_oversized packs them, written down plainly."""
    out, held = [], []
    for s in [w + "." for w in text.split(".") if w.strip()]:
        s = s.strip()
        if held and sum(len(x) + 1 for x in held) + len(s) + 1 > most:
            out.append(held)
            own, k = [], len(held)
            while k and sum(len(x) + 1 for x in own) + len(held[k - 1]) <= over:
                own.insert(0, held[k := k - 1])
            held = own
        held = [*held, s]
    return [" ".join(h) for h in [*out, held] if h]


def test_oversized_chunks_by_pieces(spark):
    rng = random.Random(3)
    texts = {f"d{i}": " ".join("".join(rng.choices("abc ", k=rng.randint(5, 30))).strip() + "x." for _ in range(rng.randint(0, 60))) for i in range(40)} | {"none": None, "blank": " " * 300}
    df = chunks.split_oversized(spark.createDataFrame([(k, 7, t) for k, t in texts.items()], "id string, page int, text string"), 100, 40)
    # Parts are made some megabytes at a time: no batch of whole chunks with all their parts.
    assert "MapInArrow" in plan(df) and "ArrowEvalPython" not in plan(df)
    assert df.columns == ["id", "parent", "page", "text", "split_part", "split_total", "char_offset"]
    rows: dict[str, list] = {}
    for r in df.collect():
        rows.setdefault(r.parent, []).append(r)
        assert r.page == 7
    for key, text in texts.items():
        own = sorted(rows.get(key, []), key=lambda r: r.split_part)
        wanted = [text] if text is None or len(text) <= 100 else _cut(text, 100, 40)
        assert [r.text for r in own] == wanted
        assert [r.char_offset for r in own] == [sum(len(w) for w in wanted[:i]) for i in range(len(wanted)) if text is not None] or text is None
        assert [r.id for r in own] == ([key] if len(wanted) == 1 else [f"{key}_part{i}of{len(wanted)}" for i in range(1, len(wanted) + 1)])


def test_mentions_in_one_stream(spark, monkeypatch):
    monkeypatch.setattr(mentions, "CHUNKS_OF_SLICE", 2)
    monkeypatch.setattr(mentions, "NAMES_OF_PIECE", 2)
    names = {1: ["DMA_Engine", "core", "Core_Unit", "uart", "ab"], 2: ["core"], 3: ["timer"]}
    texts = {1: ["the dma engine", "DMAENGINE and core unit", "a core", "cores", None], 2: ["core_unit", "uart core"], 4: ["timer"]}
    df = mentions.mentions(
        spark.createDataFrame([(d, f"{d}#{i}", t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, chunk_id string, text string"),
        spark.createDataFrame([(d, n) for d, ns in names.items() for n in ns], "doc_id long, key string"),
    )
    # A group costs no call of its own and a task holds one group's names.
    assert "MapInArrow" in plan(df) and "FlatMapCoGroups" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, "1#0", "DMA_Engine"), (1, "1#1", "Core_Unit"), (1, "1#1", "DMA_Engine"), (1, "1#1", "core"), (1, "1#2", "core"), (2, "2#1", "core")]


def test_audit_reads_what_tables_match_once(spark):
    rows = [(1, "a", ["timing", "pin"]), (1, "b", ["pin"]), (2, "c", []), (3, "d", None), (4, "e", ["interrupt"]), (5, "f", ["pin", "memory_map"])]
    tables = spark.createDataFrame(rows, "doc_id long, id string, schemas array<string>")
    nodes = spark.createDataFrame([(1, "timing"), (1, "pin"), (5, "pin")], "doc_id long, kind string")
    by_doc, by_kind, issues = audits.candidate_audit(tables, ["timing", "memory_map", "pin", "signal"], nodes)
    assert all("schemas" not in plan(df) for df in (by_doc, by_kind, issues))
    assert sorted(map(tuple, by_doc.select("doc_id", "tables", "hits", "nodes").collect())) == [(1, 2, 3, 2), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 0, 0), (5, 1, 2, 1)]
    assert sorted(map(tuple, by_kind.select("kind", "matched", "docs", "nodes").collect())) == [("memory_map", 1, 1, 0), ("pin", 3, 2, 2), ("signal", 0, 0, 0), ("timing", 1, 1, 1)]
    found = sorted((i.code, i.doc_id or "", i.kind or "") for i in issues.collect())
    assert found == [("l2.matched_but_no_nodes", "", "memory_map"), ("l2.schema_no_candidates", "", "signal"), *[("l2.table_no_schema_hits", d, "") for d in "234"]]


def test_headers_are_made_plain_once_a_kind(spark):
    tables = spark.createDataFrame([("IRQ list", ["IRQ number", "Type"]), ("", ["Interface", "Protocol", "Width"])], "caption string, headers array<string>")
    df = extract.with_schemas(tables)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 8
    assert [("interrupt" in r.schemas, "interface" in r.schemas) for r in df.collect()] == [(True, False), (False, True)]


def test_relation_ends_of_several_documents_in_one_batch():
    columns = {"doc_id": pa.int64(), "chunk_id": pa.string(), "place": pa.int64(), "position": pa.int32(), "side": pa.int32(), "key": pa.string(), "words": pa.list_(pa.string()), "fuzzy_id": pa.string(), "fuzzy_score": pa.float64(), "new_id": pa.string()}
    rows = [
        (1, "a", 1, 0, 0, "dma_engine", ["dma", "engine"], None, None, "n1"),
        (1, "a", 1, 0, 1, "dma_engine", ["dma", "engine"], "f", 0.8, None),
        (1, "b", 2, 0, 0, "dma", ["dma"], "f", 0.8, "n2"),
        (2, "a", 1, 0, 0, "dma", ["dma"], None, None, None),
        (2, "a", 1, 0, 1, "dma_engine", ["dma", "engine"], "f", 0.8, "n3"),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), columns.values(), strict=True)], list(columns))
    for batches in ([batch], [batch.slice(0, 1), batch.slice(1, 3), batch.slice(4)]):
        got = pa.Table.from_batches(list(mentions._resolved(iter(batches)))).to_pylist()
        assert [(r["doc_id"], r["node"], r["new"]) for r in got] == [(1, "n1", True), (1, "n1", False), (1, "n1", False), (2, None, False), (2, "f", False)]


def test_span_tables_collects_lines_once(spark, sf_dir):
    df = catalog_tables.span_tables(spark, sf_dir)
    assert "Window" not in plan(df) and "array_sort" not in plan(df)
    assert df.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.countDistinct("l_orderkey")).first()[0]


def test_long_components_have_tasks_of_their_own(spark, monkeypatch):
    # A component's lines are written in order, and one whose text is long is dealt to a task of its own.
    monkeypatch.setattr(exports, "GROUP_BYTES", 2_000)
    seen = []
    monkeypatch.setattr(exports, "materialize", lambda df, name: seen.append(materialize(df, name)) or seen[-1])
    names = {"a&b": ["R2", "R1", "R1", "<R>"], "b": [f"R{i:03d}" for i in range(60)], None: ["N"], "c": [f"S{i:03d}" for i in range(30)]}
    rows = [(k, n, f"0x{i}" if n != "N" else None, 32, "RW", "") for k, ns in names.items() for i, n in enumerate(ns)]
    regs = spark.createDataFrame(rows, "component string, name string, offset string, width int, access string, description string").coalesce(1)
    fields = spark.createDataFrame([(n, x, h, 0, "RO", "d") for _, n, *_ in rows[:5] for x, h in (("F", 3), ("G", 7))], "register string, name string, high int, low int, access string, description string").distinct()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = exports.ipxact(regs, fields, "f<1")
        got = {r.component: (r.registers, r.text) for r in df.collect()}
        dealt = df.select("component", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0].count() == len(rows) and seen[1].count() == len(names)
    assert len({r.task for r in dealt if r.component in ("b", "c")}) == 2

    def xml(v):
        return str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def tags(**values):
        return "".join(f"<ipxact:{k}>{xml(v)}</ipxact:{k}>" for k, v in values.items())

    has = {n for _, n, *_ in rows[:5]}
    for k, ns in names.items():
        own = []
        for i, n in enumerate(ns):
            lines = [f"<ipxact:field>{tags(name=x, bitOffset=0, bitWidth=h + 1, access='read-only', description='d')}</ipxact:field>" for x, h in (("G", 7), ("F", 3))] if n in has else []
            own.append((n, f"<ipxact:register>{tags(name=n, addressOffset=f'0x{i}' if n != 'N' else '0x0', size=32, access='read-write')}" + "\n".join(lines) + "</ipxact:register>"))
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<ipxact:component xmlns:ipxact="http://www.accellera.org/XMLSchema/IPXACT/1685-2014">' + tags(vendor="f<1", name=k or "") + "<ipxact:memoryMaps><ipxact:memoryMap><ipxact:addressBlock>"
        assert got[k] == (len(ns), "\n".join([head, *[t for _, t in sorted(own)], "</ipxact:addressBlock></ipxact:memoryMap></ipxact:memoryMaps></ipxact:component>"]))
    none = exports.systemrdl(regs.where("component IS NULL"), fields.withColumn("reset", F.lit(None).cast("string"))).collect()
    assert [(r.component, r.registers, r.text) for r in none] == [(None, 1, "  reg {\n\n  } N @ 0x0;\n};")]
    assert exports.ipxact(regs.where("false"), fields).collect() == []


class _Told:
    """A session of which only the settings are asked."""

    def __init__(self, spark, master, **conf):
        self.sparkContext = self
        self.master, self._jvm, self.told = master, spark.sparkContext._jvm, {k.replace("_", "."): v for k, v in conf.items()}

    def getConf(self):
        return self.told


def test_few_long_rows_at_once(spark):
    cpus = lambda need, master="local-cluster[3,4,10000]", **conf: (p := few_at_once(_Told(spark, master, **{"spark_executor_memory": "6000m"} | conf), need)) and p.taskResources["cpus"].amount
    assert [cpus(need << 20) for need in (0, 1500, 1501, 3001, 9000)] == [None, None, 2, 4, 4]
    assert cpus(9 << 30, "spark://x:7077", spark_executor_cores="3") == 3 and cpus(9 << 30, "spark://x:7077") is None
    assert cpus(9 << 30, "local[4]") is None and cpus(9 << 30, spark_dynamicAllocation_enabled="true") is None


def test_headers_of_register_tables_are_read_once(spark, monkeypatch):
    told = {}
    monkeypatch.setattr(extract, "materialize", lambda df, name: told.setdefault(name, (plan(df), materialize(df, name)))[1])
    heads = [["Reg name", "Field", "Bits", "Access"], ["Register", "Description", "Field", "Type"], None, []]
    rows = [["CTRL", "EN", "[0]", "RO"], ["-", "Reserved", "[1]", "RO"], [None, "MODE", "[3:2]", "r/w"]]
    tables = spark.createDataFrame([(i % 5, f"t{i}", None if i % 3 else "Register list", heads[i % 4], rows) for i in range(40)], "doc_id long, id string, caption string, headers array<string>, rows array<array<string>>")
    for most in (extract.FEW_HEADERS, 1):
        told.clear()
        monkeypatch.setattr(extract, "FEW_HEADERS", most)
        regs, fields = extract.registers(tables)
        assert told["register-tables"][1].count() == 20 and not any(c.startswith("at_") for c in told["register-tables"][1].columns)
        assert ("strategy=broadcast" in told["register-carried"][0]) == (most > 1)
        got = [(r.table_id, r.register, r.idx, r.name, r.high, r.low, r.access) for r in fields.collect()]
        assert sorted(got) == sorted((f"t{i}", "CTRL", *x) for i in range(0, 40, 4) for x in ((0, "EN", 0, 0, "RO"), (2, "MODE", 3, 2, "RW")))
        assert sorted({r.name for r in regs.where("table_id = 't0'").collect()}) == ["CTRL"]
