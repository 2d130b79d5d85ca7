"""Scalar functions over names, headings, tables' cells and numbers, as column expressions."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_name(c: Column) -> Column:
    """Trimmed; runs of anything but letters, digits, dot, hyphen and underscore become one underscore."""
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_.\-]+", "_")


def resolver_key(c: Column) -> Column:
    """Upper case without white space, underscores, hyphens, dots and slashes."""
    return F.upper(F.regexp_replace(c, r"[\s_\-./]+", ""))


def spaced_lower(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def node_id(family: Column, short: Column, qualified: Column, doc_id: Column | None = None) -> Column:
    base = F.concat(family, F.lit("::"), short, F.lit(":"), normalize_name(qualified))
    return base if doc_id is None else F.when(doc_id.isNull(), base).otherwise(F.concat(base, F.lit("#"), doc_id))


def make_doc_id(family: Column, kind: Column, version: Column, path: Column) -> Column:
    """family::kind[@version][::path token]."""
    v = F.when(version.isNotNull() & (version != ""), F.concat(F.lit("@"), version)).otherwise("")
    p = F.when(path.isNotNull() & (path != ""), F.concat(F.lit("::"), path_token(path))).otherwise("")
    return F.concat(family, F.lit("::"), kind, v, p)


@F.pandas_udf(StringType())
def path_token(paths: pd.Series) -> pd.Series:
    """Percent-encoded without the leading ./; url_encode would turn spaces into + and encode slashes."""
    return paths.map(lambda p: None if p is None else urllib.parse.quote(p.replace("\\", "/").removeprefix("./"), safe="/._-"))


def doc_name(doc_id: Column) -> Column:
    return F.substring_index(doc_id, "::", -1)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def heading_path(text: Column) -> Column:
    """The section number that opens a heading: 1.2.3, Chapter N, Appendix A, A.1; else null."""
    some = lambda pattern: blank_to_null(F.regexp_extract(text, pattern, 1))
    return F.coalesce(
        some(r"^\s*([0-9]+(?:\.[0-9]+){0,5})(?:\.(?=\s)|(?=[^0-9.]|$))"),
        some(r"(?i)^\s*Chapter\s+([0-9]+)(?=[^0-9]|$)"),
        some(r"^\s*(?i:Appendix)\s+([A-Z])(?=[A-Z][a-z]|[^A-Za-z]|$)"),
        some(r"^\s*([A-Z]\.[0-9]+(?:\.[0-9]+){0,4})(?=[^0-9.]|$)"),
    )


def natural_key(path: Column) -> Column:
    """Dotted numbers so that they sort as numbers."""
    return F.array_join(F.transform(F.split(path, r"\."), lambda p: F.lpad(p, 12, "0")), ".")


def split_sentences(text: Column) -> Column:
    """Parts after sentence marks with white space behind them and after line breaks; blank parts go."""
    return F.filter(F.split(text, r"(?<=[。！？；!?.])\s+|(?<=\n)\s*"), lambda p: F.trim(p) != "")


def hard_split(text: Column, size: int) -> Column:
    """Slices of a fixed width."""
    last = F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their accents."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def hits(pool: Column, needles: list[str]) -> Column:
    """How many of the needles the text holds."""
    return sum((F.contains(pool, F.lit(n)).cast("int") for n in needles), F.lit(0))


def map_with_default(c: Column, known: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.coalesce(c, F.lit("")))), F.lit(default))


#: Words for access modes in the two register formats.
IPXACT_ACCESS = {"RW": "read-write", "RO": "read-only", "WO": "write-only", "W1C": "read-write", "RZ": "read-only"}
RDL_ACCESS = {"RW": "rw", "RO": "r", "WO": "w", "W1C": "rw", "RZ": "r"}


def ipxact_access(c: Column) -> Column:
    return map_with_default(c, IPXACT_ACCESS, "read-write")


def rdl_access(c: Column) -> Column:
    return map_with_default(c, RDL_ACCESS, "rw")


def format_reset(c: Column) -> Column:
    """0x… stays; 0b… and decimals become hexadecimal; anything else is 0."""
    s = F.trim(c)
    return (
        F.when(F.lower(s).startswith("0x"), s)
        .when(s.rlike("^0b[01]+$"), F.concat(F.lit("0x"), F.lower(F.conv(F.substring(s, 3, 64), 2, 16))))
        .when(s.rlike("^[0-9]+$"), F.concat(F.lit("0x"), F.lower(F.conv(s, 10, 16))))
        .otherwise("0")
    )


def parse_intish(c: Column) -> Column:
    """The first hexadecimal or decimal literal as a long."""
    first = F.regexp_extract(c, r"(0[xX][0-9A-Fa-f]+|[0-9]+)", 1)
    return F.when(F.lower(first).startswith("0x"), F.conv(F.substring(first, 3, 32), 16, 10).cast("long")).when(first != "", first.cast("long"))


def bit_range(text: Column) -> Column:
    """struct(high, low) from a:b, [n] or bit n; null without one."""
    pair = F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*[:\-~]\s*([0-9]+)"), 1), F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*[:\-~]\s*([0-9]+)"), 2)
    a, b = F.get(pair[0], F.lit(0)).cast("int"), F.get(pair[1], F.lit(0)).cast("int")
    one = blank_to_null(F.coalesce(blank_to_null(F.regexp_extract(text, r"\[\s*([0-9]+)\s*\]", 1)), F.regexp_extract(text, r"(?i)\bbit\s+([0-9]+)", 1), F.lit(""))).cast("int")
    alone = F.coalesce(one, blank_to_null(F.regexp_extract(text, r"^\s*([0-9]+)\s*$", 1)).cast("int"))
    return F.when(a.isNotNull(), F.struct(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))).when(alone.isNotNull(), F.struct(alone.alias("high"), alone.alias("low")))


def prefix_matches(base: Column, address: Column) -> Column:
    """Whether a hexadecimal address lies under a base: equal leading digits, the base's trailing zeros aside, four at least."""
    b, a = F.regexp_replace(F.lower(base), "^0x", ""), F.regexp_replace(F.lower(address), "^0x", "")
    k = F.greatest(F.lit(4), F.length(b) - F.length(F.regexp_extract(b, "0*$", 0)))
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))


#: Key words of the table kinds in the order in which they are tried, with the hits that each needs.
TABLE_KINDS = (
    ("register_table", 3, ("reg name", "register", "field", "msb", "lsb", "swaccess", "hwaccess", "reset")),
    ("memory_map", 2, ("base address", "address map", "memory map", "offset", "size", "地址映射", "基地址")),
    ("signal_table", 2, ("signal", "direction", "width", "interface group", "位宽", "信号")),
    ("pin_table", 2, ("pin", "direction", "function", "voltage", "管脚", "引脚")),
    ("timing_table", 2, ("min", "typ", "max", "unit", "condition", "时序")),
)


def table_kind(caption: Column, headers: Column) -> Column:
    cap = F.lower(F.coalesce(caption, F.lit("")))
    pool = F.concat(cap, F.lit(" "), F.lower(F.array_join(headers, " ")))
    out = F.lit("generic_table")
    for name, least, needles in reversed(TABLE_KINDS):
        fits = hits(pool, list(needles)) >= least
        out = F.when(fits | F.contains(cap, F.lit("fields for register")) if name == "register_table" else fits, name).otherwise(out)
    return out


def table_group_key(caption: Column, headers: Column, kind: Column, section: Column) -> Column:
    """What the parts of one logical table share: the number in the caption, else the caption, else kind, section and headers."""
    plain = F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"\s+", " "))
    cap = F.trim(F.regexp_replace(plain, r"(?i)[(（]?\s*continued\s*[)）]?", ""))
    number = F.regexp_extract(cap, r"(?i)\btable\s+([0-9A-Za-z_.\-–]+)", 1)
    signature = F.substring(normalize_name(F.lower(F.array_join(headers, "|"))), 1, 120)
    return (
        F.when((cap != "") & (number != ""), F.concat(F.lit("caption:"), normalize_name(number)))
        .when(cap != "", F.concat(F.lit("caption:"), F.substring(normalize_name(cap), 1, 80)))
        .otherwise(F.concat(kind, F.lit(":"), F.coalesce(section, F.lit("no_section")), F.lit(":"), signature))
    )


def table_markdown(headers: Column, rows: Column) -> Column:
    """Pipe rows: header, separator, body."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")), " | "), F.lit(" |"))
    head = F.when(F.size(headers) > 0, F.array(row(headers), F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- ")), "|"), F.lit("|")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows, row)), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for different lengths, empty arrays or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / F.when(norm > 0, norm).otherwise(1.0)).otherwise(0.0)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(F.round(num / F.when(den == 0, 1).otherwise(den), 4))


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


# Models of chips in documents' names.
CHIP_MODELS = ((r"cortex[-_ ]]?m(\d+\+?)", "cortex-m$1"), (r"cortex[-_ ]]?r(\d+)", "cortex-r$1"), (r"cortex[-_ ]]?a(\d+)", "cortex-a$1"), (r"pcie[-_ ]?subsystem", "pcie-subsystem"), (r"pcie[-_ ]?spec", "pcie-subsystem"), (r"stm32f(\d+)", "stm32f$1"))
# Other names of kinds in golden files.
KIND_NAMES = {
    "registers": "register", "register": "register", "bitfields": "bitfield", "bitfield": "bitfield", "pins": "pin", "pin": "pin", "signals": "signal", "signal": "signal", "interfaces": "interface", "interface": "interface", "parameters": "parameter",
    "parameter": "parameter", "timing": "parameter", "interrupts": "interrupt", "interrupt": "interrupt", "memory_maps": "memory_map", "memory_map": "memory_map", "requirements": "requirement", "requirement": "requirement", "errata": "errata",
}


def chip_model(name: Column) -> Column:
    """The chip's model that a document's name holds; null without one. The first pattern that fits counts."""
    low = F.lower(name)
    found = [blank_to_null(F.regexp_extract(low, p, 0)) for p, _ in CHIP_MODELS]
    plain = [F.replace(F.replace(F.regexp_replace(f, p, r), F.lit(" "), F.lit("")), F.lit("_"), F.lit("-")) for f, (p, r) in zip(found, CHIP_MODELS, strict=True)]
    return F.coalesce(*plain)


def section_title(name: Column) -> Column:
    """A section's name for display: Chapter and Appendix by number alone, page numbers and dots at the end gone, a space
    after the number."""
    s = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    s = F.trim(F.regexp_replace(s, r"(?i)^Chapter\s+(\d+)\s*(.*)$", "$1 $2"))
    letter = F.regexp_extract(s, r"(?i)^Appendix\s+([A-Z])\s*(.*)$", 1)
    s = F.when(letter != "", F.trim(F.concat(F.upper(letter), F.lit(" "), F.regexp_extract(s, r"(?i)^Appendix\s+([A-Z])\s*(.*)$", 2)))).otherwise(s)
    glued = r"^(\d+)([A-Za-z][A-Za-z ]+?)(?:[. ]*\d+)$"
    rest = F.regexp_replace(s, r"(\D)\.{2,}\s*\d+$", "$1")
    rest = F.regexp_replace(rest, r"(\bEL\d|[A-Za-z)])\.(\d+)$", "$1")
    rest = F.regexp_replace(rest, r"^(\d+(?:\.\d+)*)(?=[A-Za-z\u4e00-\u9fff])", "$1 ")
    return F.when(s.rlike(glued), F.concat(F.regexp_extract(s, glued, 1), F.lit(" "), F.trim(F.regexp_extract(s, glued, 2)))).otherwise(rest)


def spaced_numbers(text: Column) -> Column:
    """A space after section numbers that open a line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(^|\n)(\d+(?:\.\d+)+)(?=[A-Za-z\u4e00-\u9fff])", "$1$2 ")


def golden_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def golden_kind(c: Column) -> Column:
    """A kind's canonical name: lower case with underscores, plural and other names undone."""
    key = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), "[^a-z0-9_]+", "_")
    known = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), key)


def box_area(box: Column) -> Column:
    """The area of [left, top, right, bottom]; 0 for boxes that are turned around or not whole."""
    side = lambda a, b: F.greatest(F.get(box, F.lit(b)) - F.get(box, F.lit(a)), F.lit(0.0))
    return F.when(F.size(box) == 4, side(0, 2) * side(1, 3)).otherwise(F.lit(0.0))
