"""Spans against a grid that is filled cell by cell."""

import random

from pyspark.sql import functions as F

from stratalake.sources import grids


def plain_grid(cells):
    own = [(max(r or 0, 0), max(c or 0, 0), max(1 if rs is None else rs, 1), max(1 if cs is None else cs, 1), (t or "").strip(), bool(h)) for r, c, rs, cs, t, h in cells]
    height, width = max((r + rs for r, _, rs, *_ in own), default=0), max((c + cs for _, c, _, cs, *_ in own), default=0)
    grid = [[("", False)] * width for _ in range(height)]
    for r, c, rs, cs, t, h in sorted(own, reverse=True):
        for i in range(rs):
            for j in range(cs):
                grid[r + i][c + j] = (t, h)
    heads = next((i for i, line in enumerate(grid) if not all(h for _, h in line)), height)
    heads = max(heads, min(1, height))
    headers = [" ".join(dict.fromkeys(line[c][0] for line in grid[:heads] if line[c][0])) for c in range(width)]
    return headers, [[t for t, _ in line] for line in grid[heads:]], [(r, c, rs, cs, t) for r, c, rs, cs, t, _ in own if rs > 1 or cs > 1]


def test_span_grids(spark):
    rng = random.Random(7)
    tables = []
    for i in range(200):
        cells, taken = [], set()
        for r in range(rng.randint(0, 6)):
            for c in range(rng.randint(1, 5)):
                rs, cs = rng.choice([None, 0, 1, 1, 2, 3]), rng.choice([None, 1, 1, 2])
                if (r, c) not in taken and rng.random() < 0.9:
                    cells.append((r, c, rs, cs, rng.choice([None, "", " x ", "name", f"t{r}.{c}"]), r < 2 if i % 3 else rng.choice([None, True, False])))
                    if i % 2:
                        taken |= {(r + a, c + b) for a in range(rs or 1) for b in range(cs or 1)}
        rng.shuffle(cells)
        tables.append((i, cells))
    tables += [(900, None), (901, [(-1, None, 1, 1, "odd", False)])]
    df = spark.createDataFrame(tables, f"id int, cells {grids.CELLS}").withColumn("g", grids.span_grid(F.col("cells")))
    for r in df.collect():
        headers, rows, merged = plain_grid(dict(tables)[r.id] or [])
        assert (r.g.headers, r.g.rows, [tuple(m) for m in r.g.merged]) == (headers, rows, merged), r.id


def test_joined_headers(spark):
    cells = [(0, 0, 1, 2, "Item", True), (0, 2, 2, 1, "Flag", True), (1, 0, 1, 1, "Key", True), (1, 1, 1, 1, "Qty", True), (2, 0, 1, 2, "both", False), (2, 2, 2, 1, "down", False), (3, 0, 1, 1, "a", False)]
    g = spark.createDataFrame([(cells,)], f"cells {grids.CELLS}").select(grids.span_grid(F.col("cells")).alias("g")).first().g
    assert g.headers == ["Item Key", "Item Qty", "Flag"] and g.rows == [["both", "both", "down"], ["a", "", "down"]] and len(g.merged) == 4


def test_tables_from_the_sidecar(spark):
    tables = spark.createDataFrame([("d", 0, ["a"], [["1"]]), ("d", 1, None, None), ("d", 2, [], []), ("e", 0, [], None)], "doc_id string, nth int, headers array<string>, rows array<array<string>>")
    text = "x <table><tr><td>q</td></tr></table> <TABLE><tr><th>h</th><th>i</th></tr><tr><td colspan=2>v</td></tr></TABLE>"
    got = {(r.doc_id, r.nth): (r.headers, r.rows, r.filled) for r in grids.filled_from_sidecar(tables, spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()}
    assert got == {("d", 0): (["a"], [["1"]], False), ("d", 1): (["h", "i"], [["v", "v"]], True), ("d", 2): ([], [], False), ("e", 0): ([], None, False)}
