"""Cells of specification tables, made plain: names, directions, widths, access modes, bits and offsets, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalake.functions.text import blank_to_null, parse_intish

# What a table's cells are compared with.
#: Cells of a signal's column that are no signal.
NO_SIGNAL = ("reserved", "reserve", "description", "clock/reset", "interface group", "interrupt", "interrupts", "irq", "irqs")
#: Directions, by upper case without spaces.
DIRECTIONS = {"I": "IN", "IN": "IN", "INPUT": "IN", "O": "OUT", "OUT": "OUT", "OUTPUT": "OUT", "IO": "IO", "I/O": "IO", "BIDIR": "BIDIR", "BIDIRECTIONAL": "BIDIR", "MASTER": "master", "SLAVE": "slave"}
#: Cells that say that there is no width.
NO_WIDTH = ("-", "--", "n/a", "na", "none", "null")
#: Spelled-out access modes, replaced one after another, and the modes that are then looked for, in this order.
ACCESS_WORDS = (("READ/WRITE", "RW"), ("READ-WRITE", "RW"), ("READONLY", "RO"), ("READ-ONLY", "RO"), ("WRITEONLY", "WO"), ("WRITE-ONLY", "WO"), ("R/W", "RW"), ("R/O", "RO"), ("W/O", "WO"))
ACCESS_MODES = ("RW", "RO", "WO", "W1C", "W1S", "RC", "RS", "WC", "R", "W")
#: Names and descriptions of fields that are reserved.
RESERVED_NAMES, RESERVED_TEXTS = ("", "-", "reserved", "reserve"), ("reserved", "reserve", "reserved.")
#: How captions announce a register, and what register names look like in texts and in cells.
CAPTION_NAMES = (r"(?i)fields\s+for\s+register\s*[:：]\s*([A-Za-z0-9_.\-\[\]/]+)", r"(?i)register\s*[:：]\s*([A-Za-z0-9_.\-\[\]/]+)", r"(?i)寄存器\s*[:：]\s*([A-Za-z0-9_.\-\[\]/]+)")
TEXT_NAMES = (
    r"(?i)\b([A-Za-z][A-Za-z0-9_ /\-]*?\s+Register)\b",
    r"(?i)\b([A-Za-z_][A-Za-z0-9_]*?(?:REG|CTRL|CFG|STAT|STATUS|PTR|POINTER|COUNT|WIDTH|DEPTH|DATA)[A-Za-z0-9_]*)\b",
    r"(?i)\b([A-Za-z_][A-Za-z0-9_]*_REG[A-Za-z0-9_]*)\b",
)
CELL_NAME = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*?(?:reg|ctrl|cfg|stat|state|sel)[A-Za-z0-9_]*)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that it uses several times and that is reckoned once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def norm_header(c: Column) -> Column:
    """Lower case, single spaces, underscores as spaces."""
    return F.replace(F.lower(one_space(c)), F.lit("_"), F.lit(" "))


def entity_name(c: Column) -> Column:
    """White space becomes underscores; those at the ends go."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text.rlike(r"\s|^_|_$"), F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"^_+|_+$", "")).otherwise(text)


def display_name(c: Column) -> Column:
    """Single spaces, without commas and semicolons at the ends."""
    return F.regexp_replace(one_space(c), r"^[ ,;，；]+|[ ,;，；]+$", "")


def header_echo(c: Column, headers: Column) -> Column:
    """Whether a cell repeats a header; headers are plain (see norm_header)."""
    return let(norm_header(c), lambda plain: (plain != "") & F.array_contains(headers, plain))


def is_address(c: Column) -> Column:
    """Whether a cell tells where something lies."""
    return F.coalesce(c, F.lit("")).rlike(r"0x[0-9a-fA-F]+|(?i:\b[A-Z0-9_]*BAR\d*\b)|(?i:\b(?:BDF|offset|base|host|local|memory|register|寄存器|空间|偏移)\b)|[+:/]")


def is_signal(c: Column) -> Column:
    """Whether a cell looks like a signal's name: one word with an underscore, or in lower or in upper case throughout."""
    s = F.trim(F.coalesce(c, F.lit("")))
    plain = s.rlike(r"^[a-zA-Z][a-zA-Z0-9]*(?:\[[0-9:]+\])?$") & (s.rlike("[a-z]") | (F.upper(s) == s))
    return (s != "") & (F.length(s) <= 96) & ~F.lower(s).isin(*NO_SIGNAL) & ~s.rlike("[ /，,;；]") & (s.rlike("[a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]+") | plain)


def direction(c: Column) -> Column:
    """IN, OUT, IO, BIDIR, master or slave; other words stay; null for blanks and numbers."""
    known = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when((s != "") & ~s.rlike("^[0-9 ]+$"), F.coalesce(F.try_element_at(known, F.replace(F.upper(s), F.lit(" "), F.lit(""))), s))


def width(c: Column) -> Column:
    """A number that is told several times or with a b behind it, once and alone; null for none."""
    told = lambda s: F.coalesce(blank_to_null(F.regexp_extract(s, r"^(\d+)(?: \1)+$", 1)), blank_to_null(F.regexp_extract(s, r"(?i)^(\d+)\s*b$", 1)), s)
    return let(one_space(c), lambda s: F.when((s != "") & ~F.lower(s).isin(*NO_WIDTH), told(s)))


def canonical_register(c: Column) -> Column:
    """A register's name without section number, article and access mode; blank for sentences and for the bare word."""
    s = one_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ .,:;，。；]+|[ .,:;，。；]+$", ""))
    for pattern in (r"^\d+(?:\.\d+)*\s+", r"(?i)^(?:the|a|an)\s+", r"(?i)^(?:read[- ]only|read[-/ ]write|write[- ]only)\s+"):
        s = F.regexp_replace(s, pattern, "")
    return let(s, lambda x: F.when(x.rlike(r"(?i)\b(?:is|are|contains?|describes?)\b") | F.lower(x).isin("register", "the register", "this register"), "").otherwise(x))


def register_in_text(c: Column) -> Column:
    """The first register name that a text holds; blank without one."""
    found = let(one_space(c), lambda raw: F.array(*[F.regexp_extract(raw, p, 1) for p in TEXT_NAMES]))
    names = F.transform(F.filter(found, lambda x: x != ""), canonical_register)
    return F.coalesce(F.get(F.filter(names, lambda n: ~F.lower(n).isin("register", "register number")), F.lit(0)), F.lit(""))


def register_in_caption(c: Column) -> Column:
    """The register that a table's caption announces; blank without one."""
    text = F.coalesce(c, F.lit(""))
    told = F.coalesce(*[blank_to_null(F.regexp_extract(text, p, 1)) for p in CAPTION_NAMES])
    return F.coalesce(F.regexp_replace(told, "[.,;，。；]+$", ""), register_in_text(text))


def register_in_cells(row: Column, skip: list[Column]) -> Column:
    """A register's name that has slipped into one of a row's first four cells, other than those at the places in skip."""
    found = []
    for k in range(4):
        name = F.regexp_extract(F.coalesce(F.get(row, F.lit(k)), F.lit("")), CELL_NAME, 1)
        free = reduce(lambda a, b: a & b, [F.coalesce(s != k, F.lit(True)) for s in skip], F.lit(True))
        found.append(F.when(free, let(name, blank_to_null)))
    return F.coalesce(*found)


def continues_register(c: Column) -> Column:
    """Whether a register's cell only says that the row goes on with the register before: blank, a number, dashes."""
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^(?:\d+|[-–—]+)?$")


def bit_suffix(c: Column) -> Column:
    """The number that a field's name ends in after bit."""
    return blank_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(?:^|_)bit[_-]?(\d+)$", 1)).cast("int")


def bit_pair(high: Column, low: Column) -> Column:
    """struct(high, low) of two cells with a number each, the larger one first."""
    a, b = parse_intish(high).cast("int"), parse_intish(low).cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")))


def bits_in_text(c: Column) -> Column:
    """struct(high, low) of a:b, [n], (n), bit n, or a number beside the word bit; null without one."""
    s = F.coalesce(c, F.lit(""))
    get = lambda p, k=1: let(F.regexp_extract(s, p, k), blank_to_null).cast("int")
    pair = F.array(*[get(r"(\d+)\s*[:：]\s*(\d+)", k) for k in (1, 2)])
    one = F.coalesce(get(r"[\[(]\s*(\d+)\s*[\])]"), get(r"(?i)\bbits?\s*(\d+)\b"), F.when(s.rlike(r"(?i)\bbit"), get(r"\b(\d+)\b")))
    places = F.coalesce(let(pair, lambda x: F.when(x[0].isNotNull(), x)), let(one, lambda x: F.array(x, x)))
    return let(places, lambda x: F.when(x[0].isNotNull(), F.struct(F.greatest(x[0], x[1]).alias("high"), F.least(x[0], x[1]).alias("low"))))


def field_in_description(description: Column, bits: Column) -> Column:
    """A field's name from the first six words of its description, else from its bits; blank without either."""
    first = lambda text: F.trim(F.regexp_replace(F.trim(F.element_at(F.split(text, "[.;:。；：]", 2), 1)), r"\([^)]*\)", ""))
    joined = lambda text: F.substring(F.array_join(F.slice(F.split(F.coalesce(blank_to_null(first(text)), text), r"\s+"), 1, 6), "_"), 1, 64)
    named = lambda text: F.coalesce(blank_to_null(F.regexp_replace(F.regexp_replace(joined(text), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")), F.lit("field"))
    places = lambda b: F.when(b["high"] == b["low"], F.concat(F.lit("bit_"), b["high"].cast("string"))).otherwise(F.concat(F.lit("bits_"), b["high"].cast("string"), F.lit("_"), b["low"].cast("string")))
    return let(one_space(description), lambda text: F.when(text != "", named(text)).otherwise(F.coalesce(let(bits_in_text(bits), places), F.lit(""))))


def is_reserved(name: Column, description: Column) -> Column:
    """Whether a field is kept free. What neither speaks of it nor lacks a name, as most, is told without making it plain."""
    known = F.regexp_replace(norm_header(name), "^[_ -]+|[_ -]+$", "").isin(*RESERVED_NAMES) | norm_header(description).isin(*RESERVED_TEXTS)
    said = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("reserve"))
    return F.when(said(name) | said(description) | ~F.coalesce(name, F.lit("")).rlike(r"[^\s_-]"), known).otherwise(False)


def offset_in_text(c: Column) -> Column:
    """The last hexadecimal number of a cell, else the number behind a plus sign."""
    s = F.coalesce(c, F.lit(""))
    all_hex = F.regexp_extract_all(s, F.lit("(0x[0-9a-fA-F]+)"), 1)
    return F.coalesce(F.try_element_at(all_hex, F.lit(-1)), blank_to_null(F.regexp_extract(s, r"\+\s*(0x[0-9a-fA-F]+|\d+)", 1)))


def offset_of_number(c: Column) -> Column:
    """The offset of the register with a number, four bytes each."""
    return F.concat(F.lit("0x"), F.hex(parse_intish(c) * 4))


def access(c: Column) -> Column:
    """The access mode that a cell holds; what has none stays, up to 24 characters; null for blanks."""
    s = F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    for word, mode in ACCESS_WORDS:
        s = F.replace(s, F.lit(word), F.lit(mode))
    modes = F.array(*[F.lit(m) for m in ACCESS_MODES])
    return let(s, lambda x: F.when(x != "", F.coalesce(F.get(F.filter(modes, lambda m: F.contains(x, m)), F.lit(0)), F.substring(x, 1, 24))))
