"""Stored vectors: upserts by hash, pruning, exact searches that leave cells out, recall of coarse ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.operators import retrieval
from stratalake.operators.vectors import NOWHERE, VectorTable

ROW = "item_id string, doc_id string, content_hash string, vector array<float>"


def clustered(spark, n, dim=8, seed=1):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, dim))
    return [(f"i{j:04}", f"d{j % 7}", f"h{j}", [float(x) for x in centres[j % 12] + 0.3 * random.normal(size=dim)]) for j in range(n)]


def pairs(df):
    return sorted((r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())


def queries_of(spark, rows, every=9):
    return spark.createDataFrame([(r[0], r[3]) for r in rows[::every]], "query_id string, query_vec array<float>")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = clustered(spark, 400)
    table = VectorTable(spark, str(tmp_path_factory.mktemp("v")), "chunk", "hash/v1", 8)
    assert table.count() == 0 and table.hashes() is None and table.prune(spark.createDataFrame([], ROW)) == 0
    with pytest.raises(ValueError, match="nothing"):
        table.search(queries_of(spark, rows))
    assert table.upsert(spark.createDataFrame(rows, ROW), cells=12) == 400
    return table, rows


def test_exact_search_equals_a_scan(spark, stored):
    table, rows = stored
    asked = queries_of(spark, rows).unionByName(spark.createDataFrame([("zero", [0.0] * 8), ("short", [1.0]), ("none", None)], "query_id string, query_vec array<float>"))
    want = pairs(retrieval.nearest(table.rows(), asked, 5, "item_id", "vector"))
    assert pairs(table.search(asked, 5, probes=1)) == want
    only = spark.createDataFrame([(r[0],) for r in rows[::3]], "item_id string")
    assert pairs(table.search(asked, 5, probes=2, allowed=only)) == pairs(retrieval.nearest(table.rows(), asked, 5, "item_id", "vector", allowed=only))


def test_cells_bound_their_vectors_and_are_left_out(spark, stored):
    table, rows = stored
    cells = {r.cell: r for r in table._cells().collect()}
    kept = table.rows().collect()
    assert sum(r.n for r in cells.values()) == len(kept) == 400
    for r in kept:
        unit = np.array(r.vector, dtype=np.float64) / np.linalg.norm(np.array(r.vector, dtype=np.float64))
        assert float(unit @ np.array(cells[r.cell].centre)) >= cells[r.cell].least - 1e-9
    used = sorted((r for r in cells.values() if r.n), key=lambda r: r.cell)
    units = np.array([np.array(r[3]) / np.linalg.norm(r[3]) for r in rows[:50]])
    _, reach = table._bounds(used, units, np.ones(50, dtype=bool))
    assert (reach < 0.8).mean() > 0.3  # such cells aren't read for a query whose k-th is at 0.8
    every = np.array([r.vector for r in kept], dtype=np.float64)
    sims = units @ (every / np.linalg.norm(every, axis=1)[:, None]).T
    at = {r.cell: i for i, r in enumerate(used)}
    for j, r in enumerate(kept):
        assert (sims[:, j] <= reach[:, at[r.cell]] + 1e-6).all()


def test_coarse_search_has_recall(spark, stored):
    table, rows = stored
    asked = queries_of(spark, rows)
    want = {(r[0], r[2]) for r in pairs(table.search(asked, 10))}
    probes = table.tune(10, 0.9)
    assert probes < 8  # of twelve
    got = {(r[0], r[2]) for r in pairs(table.search(asked, 10, probes=probes, exact=False))}
    assert len(want & got) / len(want) >= 0.9


def test_registered_recall(spark, sf_dir):
    from stratalake.plans import catalog

    want = {(r[0], r[2]) for r in pairs(catalog.queries()["vector_topk"](spark, sf_dir))}
    got = {(r[0], r[2]) for r in pairs(catalog.queries()["vector_table_coarse"](spark, sf_dir))}
    assert len(want & got) / len(want) >= 0.9


def test_upsert_prune_and_delete(spark, tmp_path):
    rows = clustered(spark, 60)
    make = lambda r: spark.createDataFrame(r, ROW)
    table = VectorTable(spark, str(tmp_path), "node", "m", 8)
    assert table.upsert(make(rows), cells=4) == 60
    assert table.upsert(make(rows)) == 0 and table.store.snapshots() == [1]  # nothing to do, nothing written
    # Changed, new, twice, without a direction, of another length, without a vector, without an id.
    changed = [("i0003", "d3", "new", [-x for x in rows[3][3]]), ("more", "d9", "a", [1.0] * 8), ("more", "d9", "b", [2.0] + [0.0] * 7), ("zero", "d9", "z", [0.0] * 8), ("short", "d9", "s", [1.0]), ("none", None, "n", None), (None, "d9", "x", [1.0] * 8)]
    assert table.upsert(make(changed)) == 5
    now = {r.item_id: r for r in table.rows().collect()}
    assert len(now) == 64 and now["i0003"].content_hash == "new" and now["more"].vector[0] == 2.0
    assert {now[i].cell for i in ("zero", "short", "none")} == {NOWHERE}
    assert {r.item_id: r.content_hash for r in table.hashes().collect()}["more"] == "b"
    asked = queries_of(spark, rows, 5)
    assert pairs(table.search(asked, 64, probes=1)) == pairs(retrieval.nearest(table.rows(), asked, 64, "item_id", "vector"))
    # Rows without a hash are written each time; the first state is still there.
    assert table.upsert(make([("i0003", "d3", None, rows[3][3])])) == 1
    assert table.store.read("vectors", 1).count() == 60
    assert table.delete_docs(spark.createDataFrame([("d3",), ("unknown",)], "doc_id string")) == len([r for r in rows if r[1] == "d3"])
    assert table.prune(table.rows().where(F.col("doc_id").isin("d1", "d9")).select("item_id")) > 0
    assert {r.doc_id for r in table.rows().collect()} == {"d1", "d9"}
    assert table.prune(spark.createDataFrame([], "item_id string")) == table.store.read("vectors", table.store.snapshots()[-2]).count()
    assert table.count() == 0 and table.search(asked).count() == 0
    assert table.upsert(make(rows)) == 60 and table.count() == 60


def test_equal_vectors_and_an_empty_start(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path), "node", "m", 2)
    assert table.upsert(spark.createDataFrame([], ROW)) == 0 and table.count() == 0
    same = [(f"s{j:03}", None, "h", [1.0, 1.0]) for j in range(200)]
    assert table.upsert(spark.createDataFrame(same, ROW)) == 200
    asked = spark.createDataFrame([(1, [2.0, 2.0])], "query_id int, query_vec array<double>")
    assert [(r[2], r[3]) for r in pairs(table.search(asked, 3))] == [("s000", 1.0), ("s001", 1.0), ("s002", 1.0)]
