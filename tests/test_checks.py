import pytest
from pyspark.sql import functions as F

from stratalake.core.versions import CURRENT, upgraded
from stratalake.functions import checks


@pytest.mark.parametrize(
    "check,good,bad",
    [
        (checks.plausible_access, ["RW", "r/w", "", None, "Read Only"], ["maybe", "RWX"]),
        (checks.plausible_width, ["32", "0x8000_2000", "32|64", "[31:0]", "512b", "1-bit", "DATA_WIDTH - 1", "t", "UInt(log(x))", "-", None], ["about ten", "?"]),
        (checks.plausible_number, ["12", "0x1F", "1-4, 7", "n/a"], ["twelve"]),
        (checks.plausible_address, ["0x10", "BAR0"], ["-", "", None, "??"]),
    ],
)
def test_plausible(spark, check, good, bad):
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "v string, want boolean")
    assert [r.v for r in rows.withColumn("got", check(F.col("v"))).where("got <> want").collect()] == []


def test_structure_issues(spark):
    n = spark.createDataFrame([("a", "bitfield", "RW", None, None, None, 3, 5, 32), ("b", "bitfield", "zz", None, None, None, 40, 0, 32), ("c", "memory_map", None, None, "-", None, None, None, None), ("d", "register", "RO", "32", None, None, None, None, None)], "id string, kind string, access string, width string, address string, number string, high int, low int, register_width int")
    assert sorted((r.id, r.code) for r in checks.structure_issues(n).collect()) == [("a", "l2.bit_range"), ("b", "l2.access_vocabulary"), ("b", "l2.bit_beyond_register"), ("c", "l2.address_syntax")]


def test_upgrades(spark):
    old = spark.createDataFrame([("c", 3)], "id string, page int")
    row = upgraded(old, "chunks", 1).first()
    assert (row.block_ids, row.page_start, row.page_end, row.chunk_type) == ([], 3, 3, "section")
    assert upgraded(old, "nodes", 1).first().evidence.pages == []
    assert upgraded(old, "chunks", CURRENT).columns == old.columns
    with pytest.raises(ValueError, match="version"):
        upgraded(old, "chunks", 9)
