"""The queue of announced registers against one that is gone through in order."""

import random

import pytest

from stratalake.operators import extract, register_context

TABLE = "doc_id string, id string, pos int, caption string, headers array<string>, rows array<array<string>>"
LIST, FIELDS = ["Register", "Register number", "Type", "Location", "Description"], ["Bits", "Field", "Access", "Description"]


def plain_queue(events):
    numbers, put, out = [], 0, []
    for puts, takes in events:
        out.append(numbers.pop(0) if takes and numbers else None)
        numbers += range(put + 1, put + puts + 1)
        put += puts
    return out


@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_queue(spark, monkeypatch, stretch):
    monkeypatch.setattr(register_context, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = []
    for d in range(12):
        for pos in sorted(rng.sample(range(200), 60)):
            put = rng.choice([0, 0, 0, 1, 3]) if d else 0
            rows.append((f"d{d}", pos, f"t{pos}", put, 0 if put else 1))
    got = {(r.doc_id, r.pos): (r.first, r.taken) for r in register_context.queued(spark.createDataFrame(rows, "doc_id string, pos int, table_id string, puts long, takes long")).collect()}
    for d in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == d)
        taken = plain_queue([(r[3], r[4]) for r in own])
        put = 0
        for r, t in zip(own, taken, strict=True):
            assert got[d, r[1]] == (put + 1, t)
            put += r[3]
    assert any(t for _, t in got.values()) and any(t is None for _, t in got.values())


def test_registers_over_several_tables(spark):
    listed = lambda *names: [[n, str(i), "RW", "0x10", "text"] for i, n in enumerate(names)]
    field = lambda *names: [[f"[{4 * i + 3}:{4 * i}]", n, "RW", "about"] for i, n in enumerate(names)]
    tables = [
        ("d", "t0", 0, None, FIELDS, field("EARLY")),  # nothing is announced yet
        ("d", "t1", 1, "Register summary", LIST, listed("CLK_CTRL", "RST_CTRL", "IRQ_STATUS")),
        ("d", "t2", 2, "", FIELDS, field("EN", "MODE")),
        ("d", "t3", 3, "Fields of CFG_CTRL register", FIELDS, field("OWN")),  # its caption names it
        ("d", "t4", 4, None, ["Name", "Description"], [["x", "y"]]),  # no bits
        ("d", "t5", 5, None, FIELDS, [["none", "NOBITS", "RW", "about"]]),  # would give no field
        ("d", "t6", 6, None, FIELDS, field("SOFT")),
        ("d", "t7", 7, "Register summary", LIST, listed("LATE_CTRL")),
        ("d", "t8", 8, None, FIELDS, field("PEND")),
        ("d", "t9", 9, None, FIELDS, field("LAST")),
        ("d", "u0", 10, None, FIELDS, field("NOBODY")),
        ("e", "t1", 0, None, FIELDS, field("OTHER")),
    ]
    regs, fields = register_context.registers_in_order(spark.createDataFrame(tables, TABLE))
    got = {r.name: (r.table_id, r.register) for r in fields.where("kept").collect()}
    own = got.pop("OWN", None)
    assert got == {"EN": ("t2", "CLK_CTRL"), "MODE": ("t2", "CLK_CTRL"), "SOFT": ("t6", "RST_CTRL"), "PEND": ("t8", "IRQ_STATUS"), "LAST": ("t9", "LATE_CTRL")}
    assert own is None or own[0] == "t3"
    names = sorted((r.table_id, r.name) for r in regs.collect())
    assert ("t2", "CLK_CTRL") in names and not any(extract.AWAITED in n for _, n in names) and not any(t in ("t0", "u0") for t, _ in names)


def test_no_tables(spark):
    regs, fields = register_context.registers_in_order(spark.createDataFrame([], TABLE))
    assert regs.count() == 0 and fields.count() == 0


def test_queue_without_broadcasts(spark, sf_dir):
    """Where joins meet by sorted shuffles, the parts of one are dealt alike, also where shuffles are used again."""
    from stratalake.plans.catalog_tables import registers_over_tables

    want = sorted(registers_over_tables(spark, sf_dir).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(registers_over_tables(spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and got
