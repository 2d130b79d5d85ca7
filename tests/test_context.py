"""Search through an index against scans, pages of context, their cursors and entities."""

import random

import pytest
from pyspark.sql import functions as F

from stratalake.core.storage import fresh_path
from stratalake.operators import audits, context, retrieval, search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["the", "of", "dma", "clock", "gate", "reset_ctrl", "Unit", "éclair", "50%", "中断控制器", "register"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, weights=[30, 20, 4, 3, 2, 1, 3, 1, 1, 1, 2], k=rng.randint(0, 60)))
        rows.append((i // 4, f"c{i:03}", text if i % 50 else "", f"s{i % 3}" if i % 5 else None, i % 7, i % 7 + i % 2, "table" if i % 9 == 0 else "section", [f"b{i}", f"b{i + 1}"]))
    return spark.createDataFrame(rows, "doc_id long, chunk_id string, text string, section string, page_start int, page_end int, chunk_type string, block_ids array<string>").cache()


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(f"n{i:03}", "module", f"N{i}", [f"c{i:03}"] if i % 2 else None, [f"b{i + 1}"] if i % 3 == 0 else [], "llm@1" if i % 4 == 0 else "table", "") for i in range(100)]
    return spark.createDataFrame(rows, "id string, kind string, name string, source_chunk_ids array<string>, source_block_ids array<string>, extractor string, extraction_confidence string")


@pytest.fixture(scope="module")
def index(spark, corpus, nodes):
    return search.open_index(spark, search.write_index(corpus, fresh_path(spark, "test-index"), nodes))


PHRASES = ["the", "the of the", "reset_ctrl", "eclair dma", "dma absent", "%", "中断", "e o", "set_c", "Éc", "  "]


SCOPE = [3, 17, 40, 41]


@pytest.mark.parametrize(("phrase", "scope", "limit"), [*((p, None, 7) for p in PHRASES), ("of the", SCOPE, 500), ("dma", SCOPE, 2), ("e o", SCOPE, 3), ("the", None, 500)])
def test_index_finds_what_scans_find(corpus, index, phrase, scope, limit, monkeypatch):
    """The same hits, order, methods and truncation, also where the first bound leaves too few hits."""
    monkeypatch.setattr(search, "FIRST_ROUND", 1)
    monkeypatch.setattr(search, "NEXT_ROUND", 2)
    scan = context.Scan(corpus)
    a, b = (s.search_text(phrase, limit, scope) for s in (scan, index))
    rows = [[(r["chunk_id"], r["method"], r["rank"]) for r in x[0].orderBy("rank").collect()] for x in (a, b)]
    assert rows[0] == rows[1]
    assert a[1:] == b[1:]
    if scope is None and " " in phrase:
        want = {r.chunk_id: (r.tf, round(r.score, 9)) for r in retrieval.bm25_phrase(corpus, phrase, None).collect()}
        assert {r.chunk_id: (r.tf, round(r.score, 9)) for r in search.phrase_scores(index, phrase, None).collect()} == want


def test_bounds_leave_out_postings(spark, monkeypatch):
    """A frequent term whose best chunks are few: only rows from the bound on are read."""
    rows = [(i, f"c{i}", "hot " * 8 if i < 5 else "hot " + "cold " * 200) for i in range(3000)]
    index = search.open_index(spark, search.write_index(spark.createDataFrame(rows, "doc_id long, chunk_id string, text string"), fresh_path(spark, "test-index")))
    bounds = search._bounds(index, ["hot"], 1)
    assert bounds[0] > 1 and bounds[-1] == 0
    assert search._postings(index, ["hot"], bounds[0]).agg(F.sum("n")).first()[0] == 5
    assert [r.chunk_id for r in search.top_hits(index, "hot", 3).orderBy("rank").collect()] == ["c0", "c1", "c2"]
    assert search.top_hits(index, "hot cold", 5000).count() == 2995


def test_tokens_are_not_moved(spark, corpus, monkeypatch):
    """Tasks invert their chunks in blocks: no shuffle of tokens or postings, and a rare term is one row a block."""
    rows = search.posting_rows(corpus.coalesce(1).withColumn("ref", F.monotonically_increasing_id()), 30.0)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    of = {r.term: (r.rows, r.n) for r in rows.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    assert of["the"][0] > 1
    monkeypatch.setattr(search, "LEAST_CHUNKS", 1 << 20)
    monkeypatch.setattr(search, "BLOCK_TOKENS", 1000)
    small = search.posting_rows(corpus.coalesce(1).withColumn("ref", F.monotonically_increasing_id()), 30.0)
    assert 3 < small.where("term = 'the'").count() < 30
    assert {r.term: r.n for r in small.groupBy("term").agg(F.sum("n").alias("n")).collect()} == {t: n for t, (_, n) in of.items()}


def test_only_the_terms_buckets_are_read(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "BUCKET_TOKENS", 500)
    index = search.open_index(spark, search.write_index(corpus, fresh_path(spark, "test-index")))
    assert index.buckets > 10
    plan = search._postings(index, ["dma", "clock"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "GreaterThanOrEqual(most,0.5)" in plan and "In(term" in plan
    homes = {r[0] for r in spark.createDataFrame([("dma",), ("clock",)], "term string").select(search._home("term", index.buckets)).collect()}
    read = {f.split("bucket=")[1].split("/")[0] for f in search._postings(index, ["dma", "clock"], 0.0).inputFiles()}
    assert read <= {str(h) for h in range(index.buckets)} and len(homes) <= 2


def test_hybrid_search_is_the_same_by_index(corpus, index, spark):
    def near(query, most, scope):
        rows = spark.createDataFrame([("c010", 0.9, 1), ("c011", 0.5, 2), ("c012", 0.1, 3)], "chunk_id string, similarity double, rank int")
        return rows

    for query, scope in (("dma clock", None), ("the 中断", SCOPE)):
        a, b = (context.hybrid_search(s, query, 15, 40, scope, near) for s in (context.Scan(corpus), index))
        assert [(r.chunk_id, round(r.score, 9), r.reasons) for r in a.hits] == [(r.chunk_id, round(r.score, 9), r.reasons) for r in b.hits]
        assert (a.methods, a.candidates, a.truncated) == (b.methods, b.candidates, b.truncated)
        assert scope is None or {r.doc_id for r in a.hits} <= set(scope)
    best = context.hybrid_search(index, "dma clock", 5)
    assert best.hits[0].reasons[0] == "term-overlap:2"
    table = context.ranked_page(best, index).collect()
    assert [r["rank"] for r in table] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("kind", ["scan", "index"])
def test_pages_of_context(kind, corpus, nodes, index, spark):
    source = index if kind == "index" else context.Scan(corpus, nodes)
    stats = audits.corpus_stats(corpus).first()
    first = context.document_context(source, mode="full", max_chunks=150)
    assert first["selection"]["coverage"] == "paginated_l1" and first["selection"]["total_chunks"] == stats.chunk_count and first["selection"]["total_chars"] == stats.total_chars
    seen, page = [r["chunk_id"] for r in first["chunks"]], first
    while page["selection"]["next_cursor"]:
        page = context.agent_query(source, cursor=page["selection"]["next_cursor"]) if len(seen) > 300 else context.document_context(source, mode="full", max_chunks=150, cursor=page["selection"]["next_cursor"])
        seen += [r["chunk_id"] for r in page["chunks"]]
    order = [r.chunk_id for r in corpus.orderBy("doc_id", "page_start", "page_end", "chunk_id").collect()]
    assert seen == order
    small = context.document_context(source, doc_ids=[7])
    assert small["selection"]["reason"] == "corpus_within_budget" and small["selection"]["l1_complete"] and len(small["chunks"]) == 4
    found = context.document_context(source, task="dma clock", mode="search")
    assert len(found["chunks"]) == 20 and found["selection"]["response_chunk_limit"] == 20
    rest = context.agent_query(source, cursor=found["selection"]["next_cursor"])
    assert not {r["chunk_id"] for r in rest["chunks"]} & {r["chunk_id"] for r in found["chunks"]}
    assert rest["selection"]["candidate_chunks"] == found["selection"]["candidate_chunks"]
    whole = context.hybrid_search(source, "dma clock", 300, 300)
    assert [r["chunk_id"] for r in found["chunks"] + rest["chunks"]] == [r.chunk_id for r in whole.hits[:40]]
    assert all(c["rank_reasons"] for c in found["chunks"])


@pytest.mark.parametrize("kind", ["scan", "index"])
def test_entities_of_a_page(kind, corpus, nodes, index):
    source = index if kind == "index" else context.Scan(corpus, nodes)
    page = corpus.where("doc_id IN (3, 6)").orderBy("chunk_id").collect()
    shown, left = context.enrichments(source, page, 20_000)
    refs, blocks = {r.chunk_id for r in page}, {b for r in page for b in r.block_ids}
    want = [n.id for n in nodes.orderBy("id").collect() if set(n.source_chunk_ids or []) & refs or set(n.source_block_ids) & blocks]
    assert [s["id"] for s in shown] == want and not left
    checks = {s["id"]: s["source_quality"]["needs_source_check"] for s in shown}
    assert checks == {i: int(i[1:]) % 4 == 0 for i in want}
    few, left = context.enrichments(source, page, 500)
    assert left and 0 < len(few) < len(shown)
    assert context.enrichments(source, [], 500) == ([], False)


def test_requests_that_fail(corpus, nodes, index, spark):
    def code(**how):
        with pytest.raises(context.ContextError) as e:
            context.document_context(how.pop("source", index), **how)
        return e.value.code

    assert code(max_chars=0) == code(max_chunks=161) == code(max_entity_chars=True) == "invalid_budget"
    assert code(mode="other") == "invalid_mode"
    assert code(max_chars=100) == "task_required"
    assert code(doc_ids=[]) == "empty_scope" and code(doc_ids=[7, 10_000]) == "document_not_found"
    assert code(cursor="e30") == code(cursor="%") == "invalid_cursor"
    assert code(mode="full", max_chars=1, doc_ids=[7]) == "budget_too_small"
    assert code(source=context.Scan(corpus.where("false"))) == "no_chunks"
    cursor = context.document_context(index, mode="full", doc_ids=[1, 2], max_chunks=2)["selection"]["next_cursor"]
    assert code(cursor=cursor, mode="full", doc_ids=[1, 3]) == "cursor_expired"
    assert code(cursor=cursor, mode="search", task="dma") == "cursor_mismatch"
    changed = context.Scan(corpus.withColumn("text", F.concat("text", F.lit("!"))))
    assert code(source=changed, cursor=cursor, mode="full") == "cursor_expired"
    page = context.document_context(index, mode="full", cursor=cursor)
    assert {r["doc_id"] for r in page["chunks"]} <= {1, 2} and page["selection"]["next_cursor"] is None
    state = context.decode_cursor(context.document_context(index, task="dma", mode="search")["selection"]["next_cursor"])
    for wrong in ([["c1", float("nan"), []]], [["c1", 1.0]], "x", [["c1", True, []]], [["c1", 1.0, [2]]], [["c", 1.0, []]] * 301):
        assert code(cursor=context.encode_cursor({**state, "remaining": wrong}), mode="search") == "invalid_cursor"
    assert code(cursor=context.encode_cursor({**state, "candidate_total": 0}), mode="search") == "invalid_cursor"
