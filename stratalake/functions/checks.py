"""Plausibility of entity attributes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that stand for nothing, and access modes.
EMPTY = ("", "-", "--", "n/a", "na", "none", "null")
ACCESS = ("R", "W", "RW", "RO", "WO", "W1C", "W1S", "W0C", "RC", "RS", "WC", "READ", "WRITE", "READONLY", "WRITEONLY", "R/W", "R/O", "W/O", "R/W1C", "RW1C")
#: How widths are written; the last two may stand anywhere in the cell.
WIDTHS = (r"[0-9]+", r"0x[0-9a-fA-F][0-9a-fA-F_]*", r"[0-9]+(\s*\|\s*[0-9]+)+", r"\[?\s*[0-9]+\s*:\s*[0-9]+\s*\]?", r"[A-Z][A-Z0-9_]*(\s*[-+]\s*[0-9]+)?", r"[a-z]")
WIDTH_PARTS = (r"(?i)\b[0-9]+\s*-?\s*(b|bit|bits)\b", r"[A-Za-z_]\w*\s*\(.+\)")


def is_empty(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*EMPTY)


def plausible_access(c: Column) -> Column:
    plain = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    return (plain == "") | plain.isin(*ACCESS)


def plausible_width(c: Column) -> Column:
    text, out = F.trim(F.coalesce(c.cast("string"), F.lit(""))), is_empty(c)
    for pattern in WIDTHS:
        out = out | text.rlike(f"^(?:{pattern})$")
    for pattern in WIDTH_PARTS:
        out = out | text.rlike(pattern)
    return out


def plausible_number(c: Column) -> Column:
    return is_empty(c) | F.trim(c.cast("string")).rlike(r"^(?:0x[0-9a-fA-F]+|[-0-9,\s]+)$")


def plausible_address(c: Column) -> Column:
    """Locators are often symbolic, so a letter or a digit is enough."""
    return ~is_empty(c) & F.trim(c.cast("string")).rlike("[A-Za-z0-9]")


def structure_issues(nodes: DataFrame) -> DataFrame:
    """id, code from nodes (id, kind, access, width, address, number, high, low, register_width)."""
    k = F.col("kind")
    found = F.array_compact(F.array(
        F.when(k.isin("register", "bitfield") & ~plausible_access(F.col("access")), "l2.access_vocabulary"),
        F.when(k.isin("register", "signal", "interface") & ~plausible_width(F.col("width")), "l2.width_syntax"),
        F.when((k == "memory_map") & ~plausible_address(F.col("address")), "l2.address_syntax"),
        F.when((k == "interrupt") & ~plausible_number(F.col("number")), "l2.number_syntax"),
        F.when((k == "bitfield") & ((F.col("high") < F.col("low")) | (F.col("low") < 0)), "l2.bit_range"),
        F.when((k == "bitfield") & (F.col("high") >= F.col("register_width")), "l2.bit_beyond_register"),
    ))
    return nodes.select("id", F.explode(found).alias("code"))
