"""Registered queries over specification tables: the rows of the given tables, laid out as cells, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions import cells
from stratalake.operators import blocks, exports, extract, register_context
from stratalake.plans.registered import query, table


def _case(key: Column, *values: Column) -> Column:
    """The value whose number the key has, modulo their number."""
    out = values[-1]
    for i, v in list(enumerate(values))[-2::-1]:
        out = F.when(key % len(values) == i, v).otherwise(out)
    return out


def _sql_case(key: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


_UPPER_PLAIN = "replace(upper(trim({0})), ' ', '')"
_ONE_SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _canonical_sql(x: str) -> str:
    s = _ONE_SPACE.format(f"regexp_replace({x}, '^[ .,:;，。；]+|[ .,:;，。；]+$', '', 'g')")
    for p in (r"^\d+(?:\.\d+)*\s+", r"(?i)^(?:the|a|an)\s+", r"(?i)^(?:read[- ]only|read[-/ ]write|write[- ]only)\s+"):
        s = f"regexp_replace({s}, '{p}', '')"
    return s


def _access_sql(x: str) -> str:
    s = _UPPER_PLAIN.format(x)
    for word, mode in cells.ACCESS_WORDS:
        s = f"replace({s}, '{word}', '{mode}')"
    found = " ".join(f"WHEN contains(a, '{m}') THEN '{m}'" for m in cells.ACCESS_MODES)
    return f"(SELECT CASE WHEN a = '' THEN NULL {found} ELSE substr(a, 1, 24) END FROM (SELECT {s} AS a))"


_CELLS = {
    "entity": ("'  _' || p_name || '   x_ '",),
    "shown": ("' , ' || p_name || '  ' || p_type || ' ;'",),
    "place": ("'0x' || p_size", "'BAR' || p_size", "'base of ' || p_name", "p_name", "p_type || ':' || p_size", "p_brand"),
    "signal": ("replace(p_name, ' ', '_')", "p_name", "p_type", "'reserved'", "lower(p_type) || '[3:0]'", "p_brand"),
    "way": ("'input'", "'O'", "'i / o'", "'Bidirectional'", "p_type", "CAST(p_size AS VARCHAR)", "''"),
    "wide": ("p_size || '  ' || p_size", "p_size || ' b'", "'N/A'", "p_size || ' ' || (p_size + 1)", "''", "p_type"),
    "named": ("'2.1 The ' || p_name || ' Register, first'", "p_type || '_CTRL' || p_size || ' word'", "p_name", "'Register number'", "'A read-only ' || p_name || ' register.'"),
    "bits": ("p_size || ' : ' || (p_size % 7)", "'x[' || p_size || ']'", "'Bit ' || p_size", "p_name", "CAST(p_size AS VARCHAR)", "p_size || ' of these bit'"),
    "offset": ("'0x10 + 0x' || p_size", "'BASE + ' || p_size", "p_name"),
    "mode": ("'Read/Write'", "'r/w'", "'READ ONLY'", "'w1c'", "'write-only'", "'  '", "p_type", "'R'"),
    "said": ("p_name || ' (' || p_size || ') of the ' || p_type || ' kind in all: more text'", "''", "'!!'"),
    "ends": ("p_type || '_bit' || p_size", "'BIT-' || p_size", "p_name"),
    "kept": ("'Reserved'", "p_name", "'-'", "'_reserve_ '"),
}


def _laid_out(part: DataFrame) -> DataFrame:
    """Parts as cells of many kinds, as the strings in _CELLS say."""
    return part.select("p_partkey", "p_size", *[_case(F.col("p_partkey"), *[F.expr(v.replace("VARCHAR", "STRING")) for v in values]).alias(k) for k, values in _CELLS.items()])


_NAME_1 = r"regexp_extract(one, '(?i)\b([A-Za-z][A-Za-z0-9_ /\-]*?\s+Register)\b', 1)"
_NAME_2 = r"regexp_extract(one, '(?i)\b([A-Za-z_][A-Za-z0-9_]*?(?:REG|CTRL|CFG|STAT|STATUS|PTR|POINTER|COUNT|WIDTH|DEPTH|DATA)[A-Za-z0-9_]*)\b', 1)"


@query(
    "WITH c AS (SELECT p_partkey, p_size, " + ", ".join(f"{_sql_case('p_partkey', *v)} AS {k}" for k, v in _CELLS.items()) + " FROM part), d AS (SELECT *, " + _ONE_SPACE.format("named") + " AS one FROM c), "
    + "e AS (SELECT *, " + _NAME_1 + " AS n1, " + _NAME_2 + " AS n2 FROM d), f AS (SELECT *, CASE WHEN n1 <> '' THEN " + _canonical_sql("n1") + " END AS c1, CASE WHEN n2 <> '' THEN " + _canonical_sql("n2") + " END AS c2 FROM e), "
    + r"""b AS (SELECT *, CAST(nullif(regexp_extract(bits, '(\d+)\s*[:：]\s*(\d+)', 1), '') AS INTEGER) AS b1, CAST(nullif(regexp_extract(bits, '(\d+)\s*[:：]\s*(\d+)', 2), '') AS INTEGER) AS b2,
      CAST(coalesce(nullif(regexp_extract(bits, '[\[(]\s*(\d+)\s*[\])]', 1), ''), nullif(regexp_extract(bits, '(?i)\bbits?\s*(\d+)\b', 1), ''), CASE WHEN regexp_matches(bits, '(?i)\bbit') THEN nullif(regexp_extract(bits, '\b(\d+)\b', 1), '') END) AS INTEGER) AS b3 FROM f)
    SELECT p_partkey, regexp_replace(regexp_replace(trim(entity), '\s+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_name,
      regexp_replace(trim(regexp_replace(shown, '\s+', ' ', 'g')), '^[ ,;，；]+|[ ,;，；]+$', '', 'g') AS display_name, replace(lower(trim(regexp_replace(shown, '\s+', ' ', 'g'))), '_', ' ') AS header,
      regexp_matches(place, '0x[0-9a-fA-F]+|(?i:\b[A-Z0-9_]*BAR\d*\b)|(?i:\b(?:BDF|offset|base|host|local|memory|register)\b)|[+:/]') AS is_address,
      lower(signal) <> 'reserved' AND NOT regexp_matches(signal, '[ /，,;；]') AND (regexp_matches(signal, '[a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]+') OR (regexp_matches(signal, '^[a-zA-Z][a-zA-Z0-9]*(?:\[[0-9:]+\])?$') AND (regexp_matches(signal, '[a-z]') OR upper(signal) = signal))) AS is_signal,
      CASE WHEN way = '' OR regexp_matches(way, '^[0-9]+$') THEN NULL WHEN way = 'input' THEN 'IN' WHEN way = 'O' THEN 'OUT' WHEN way = 'i / o' THEN 'IO' WHEN way = 'Bidirectional' THEN 'BIDIR' ELSE way END AS direction,
      CASE WHEN p_partkey % 6 IN (0, 1) THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 6 IN (2, 4) THEN NULL ELSE wide END AS width,
      CASE WHEN c1 IS NOT NULL AND lower(c1) NOT IN ('register', 'register number') THEN c1 WHEN c2 IS NOT NULL AND lower(c2) NOT IN ('register', 'register number', '') THEN c2 ELSE '' END AS register_name,
      coalesce(greatest(b1, b2), b3) AS bit_high, coalesce(least(b1, b2), b3) AS bit_low,
      coalesce(list_extract(regexp_extract_all(c.offset, '0x[0-9a-fA-F]+'), -1), nullif(regexp_extract(c.offset, '\+\s*(0x[0-9a-fA-F]+|\d+)', 1), '')) AS offset_text, printf('0x%X', p_size * 4) AS offset_number, """.replace("c.offset", '"offset"')
    + _access_sql("mode") + r""" AS access,
      CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(array_to_string(list_slice(string_split(trim(split_part(said, ' (', 1) || ' ' || trim(split_part(split_part(said, ') ', 2), ':', 1))), ' '), 1, 6), '_'), '[^A-Za-z0-9_]+', '_', 'g') WHEN p_partkey % 3 = 2 THEN 'field'
        ELSE coalesce(CASE WHEN coalesce(greatest(b1, b2), b3) = coalesce(least(b1, b2), b3) THEN 'bit_' || coalesce(b1, b3) ELSE 'bits_' || greatest(b1, b2) || '_' || least(b1, b2) END, '') END AS field_name,
      CAST(nullif(regexp_extract(ends, '(?i)(?:^|_)bit[_-]?(\d+)$', 1), '') AS INTEGER) AS bit_suffix, p_partkey % 4 <> 1 AS is_reserved FROM b"""
)
def cell_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of specification tables, made plain in every way that there is."""
    c = _laid_out(table(spark, sf_dir, "part")).withColumn("b", cells.bits_in_text(F.col("bits")))
    return c.select(
        "p_partkey", cells.entity_name(F.col("entity")).alias("entity_name"), cells.display_name(F.col("shown")).alias("display_name"), cells.norm_header(F.col("shown")).alias("header"), cells.is_address(F.col("place")).alias("is_address"),
        cells.is_signal(F.col("signal")).alias("is_signal"), cells.direction(F.col("way")).alias("direction"), cells.width(F.col("wide")).alias("width"), cells.register_in_text(F.col("named")).alias("register_name"),
        F.col("b.high").alias("bit_high"), F.col("b.low").alias("bit_low"), cells.offset_in_text(F.col("offset")).alias("offset_text"), cells.offset_of_number(F.col("p_size").cast("string")).alias("offset_number"),
        cells.access(F.col("mode")).alias("access"), cells.field_in_description(F.col("said"), F.col("bits")).alias("field_name"), cells.bit_suffix(F.col("ends")).alias("bit_suffix"), cells.is_reserved(F.col("kept"), F.lit("")).alias("is_reserved"),
    )


# --- registers: orders, their lines as fields ------------------------------------------------------------------------

_LINES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS p, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_linestatus FROM lineitem"
_FIELDS = f"""WITH l AS ({_LINES}), f AS (SELECT l_orderkey, CAST(p AS INTEGER) AS idx, 'F' || l_partkey || '_' || p AS name, CAST(p * 4 + q % 4 AS INTEGER) AS high, CAST(p * 4 AS INTEGER) AS low,
    CASE l_returnflag WHEN 'A' THEN 'RO' WHEN 'N' THEN 'RW' ELSE 'W1C' END AS access, 'CTRL_' || l_orderkey AS register FROM l WHERE q % 11 <> 0)"""


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register table for each order: its lines, few for each order, are the rows; some are reserved."""
    from pyspark.sql.window import Window

    of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("p", F.row_number().over(of_order) - 1).withColumn("q", F.col("l_quantity").cast("long"))
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("q") % 11 == 0, "Reserved").otherwise(F.concat(F.lit("F"), text("l_partkey"), F.lit("_"), text("p")))
    bits = F.concat(F.lit("["), (F.col("p") * 4 + F.col("q") % 4).cast("string"), F.lit(":"), (F.col("p") * 4).cast("string"), F.lit("]"))
    mode = F.when(F.col("l_returnflag") == "A", "Read-Only").when(F.col("l_returnflag") == "N", "R/W").otherwise("w1c")
    row = F.array(F.when(F.col("p") == 0, F.concat(F.lit("CTRL_"), text("l_orderkey"))).otherwise("-"), name, bits, mode, F.col("l_linestatus"), F.lit("of an order"))
    rows = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    headers = F.array(*[F.lit(h) for h in ("Reg name", "Field", "Bits", "SW Access", "Default", "Description")])
    return rows.select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("caption"), headers.alias("headers"), "rows")


@query(_FIELDS + " SELECT l_orderkey % 100 AS doc_id, CAST(l_orderkey AS VARCHAR) AS table_id, register, idx, name, high, low, access FROM f")
def register_bitfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as register tables whose lines are bit fields."""
    return extract.registers(order_tables(spark, sf_dir))[1].where("kept").select("doc_id", "table_id", "register", "idx", "name", "high", "low", "access")


@query(_FIELDS + ", r AS (SELECT l_orderkey, register, max(high) AS top FROM f GROUP BY ALL) SELECT l_orderkey % 100 AS doc_id, CAST(l_orderkey AS VARCHAR) AS table_id, register AS name, CAST(32 * pow(2, greatest(0, ceil(log2((top + 1) / 32.0)))) AS INTEGER) AS width FROM r")
def register_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registers of these tables, as wide as their fields need."""
    return extract.registers(order_tables(spark, sf_dir))[0].select("doc_id", "table_id", "name", "width")


@query(
    _FIELDS + """, n AS (SELECT DISTINCT 'register:' || register || '#' || l_orderkey % 100 AS id, 'register' AS kind, register AS qualified_name FROM f UNION ALL SELECT 'bitfield:' || register || '.' || name || '#' || l_orderkey % 100, 'bitfield', register || '.' || name FROM f)
    SELECT id, kind, qualified_name, CASE kind WHEN 'bitfield' THEN 'register:' || split_part(qualified_name, '.', 1) || '#' || split_part(id, '#', 2) END AS src FROM n"""
)
def register_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers and fields as nodes, with the register that a has_bitfield edge comes from."""
    nodes, edges = extract.register_graph(order_tables(spark, sf_dir))
    return nodes.join(edges.where("kind = 'has_bitfield'").select("src", F.col("dst").alias("id")), "id", "left").select("id", "kind", "qualified_name", "src")


_OF_FIELD = "'    field { sw = ' || CASE access WHEN 'RO' THEN 'r' ELSE 'rw' END || '; } ' || name || '[' || high || ':' || low || '] = 0;'"


@query(
    _FIELDS + f""", g AS (SELECT l_orderkey % 100 AS doc_id, register, '  reg {{' || chr(10) || string_agg({_OF_FIELD}, chr(10) ORDER BY high DESC, name) || chr(10) || '  }} ' || register || ' @ 0x0;' AS line FROM f GROUP BY l_orderkey, register)
    SELECT 'c' || doc_id AS component, count(*) AS registers, 'addrmap c' || doc_id || ' {{' || chr(10) || string_agg(line, chr(10) ORDER BY register) || chr(10) || '}};' AS text FROM g GROUP BY doc_id""".replace("{{", "{").replace("}}", "}")
)
def export_systemrdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SystemRDL text for each document of registers."""
    regs, fields = extract.registers(order_tables(spark, sf_dir))
    component = regs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("component"), "name", "offset", "width", "access", "description")
    return exports.systemrdl(component, fields.where("kept"))


_X = lambda tag, value: f"'<ipxact:{tag}>' || {value} || '</ipxact:{tag}>'"
_IPXACT_FIELD = "'<ipxact:field>' || " + " || ".join((_X("name", "name"), _X("bitOffset", "low"), _X("bitWidth", "(high - low + 1)"), _X("access", "CASE access WHEN 'RO' THEN 'read-only' ELSE 'read-write' END"), _X("description", "'of an order'"))) + " || '</ipxact:field>'"


@query(
    _FIELDS + ", w AS (SELECT l_orderkey, CAST(32 * pow(2, greatest(0, ceil(log2((max(high) + 1) / 32.0)))) AS INTEGER) AS width FROM f GROUP BY l_orderkey), g AS (SELECT l_orderkey % 100 AS doc_id, register, '<ipxact:register>' || " + _X("name", "register") + " || " + _X("addressOffset", "'0x0'") + " || " + _X("size", "any_value(width)") + " || " + _X("access", "'read-write'")
    + f" || string_agg({_IPXACT_FIELD}, chr(10) ORDER BY high DESC, name) || '</ipxact:register>' AS line FROM f JOIN w USING (l_orderkey) GROUP BY l_orderkey, register) SELECT 'c' || doc_id AS component, count(*) AS registers, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<ipxact:component xmlns:ipxact=\"http://www.accellera.org/XMLSchema/IPXACT/1685-2014\">' || "
    + _X("vendor", "'unknown'") + " || " + _X("name", "'c' || doc_id") + " || '<ipxact:memoryMaps><ipxact:memoryMap><ipxact:addressBlock>' || chr(10) || string_agg(line, chr(10) ORDER BY register) || chr(10) || '</ipxact:addressBlock></ipxact:memoryMap></ipxact:memoryMaps></ipxact:component>' AS text FROM g GROUP BY doc_id"
)
def export_ipxact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IP-XACT text for each document of registers."""
    regs, fields = extract.registers(order_tables(spark, sf_dir))
    component = regs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("component"), "name", "offset", "width", "access", "description")
    return exports.ipxact(component, fields.where("kept"))


@query("SELECT p_partkey // 50 AS doc_id, 'P' || p_partkey || '_STATUS' AS name, CASE WHEN p_partkey % 2 = 0 THEN '0x' || p_size ELSE printf('0x%X', p_partkey * 4) END AS \"offset\", CASE WHEN p_partkey % 3 = 0 THEN 'RW' ELSE 'RO' END AS access, p_name AS description FROM part")
def register_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty parts each as a list of registers without fields."""
    key = F.col("p_partkey").cast("string")
    row = F.array(F.concat(F.lit("P"), key, F.lit("_STATUS")), key, F.when(F.col("p_partkey") % 3 == 0, "Read/Write").otherwise("RO"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("BAR + 0x"), F.col("p_size").cast("string"))).otherwise("-"), F.col("p_name"))
    tables = _fifties(table(spark, sf_dir, "part"), "p_partkey", row, "Register summary", ("Register", "Register number", "Type", "Location", "Description"))
    return extract.registers(tables)[0].select("doc_id", "name", "offset", "access", "description")


# --- other tables ----------------------------------------------------------------------------------------------------


def _fifties(df: DataFrame, key: str, row: Column, caption: str | None, headers: tuple[str, ...]) -> DataFrame:
    """A table for each fifty rows of df by a key from 0, in its order."""
    own = df.select(F.floor(F.col(key) / 50).cast("long").alias("doc_id"), F.struct(F.col(key).alias("k"), row.alias("row")).alias("x"))
    rows = own.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"), F.lit(caption).cast("string").alias("caption"), F.array(*[F.lit(h) for h in headers]).alias("headers"), "rows")


_NAMED = "p_partkey // 50 AS doc_id, 'N' || p_partkey"


@query(
    f"""SELECT 'memory_map' AS kind, {_NAMED} AS name, '0x' || p_size AS a, p_size || 'KB' AS b FROM part WHERE p_partkey % 5 <> 0
    UNION ALL SELECT 'interrupt', {_NAMED}, CAST(p_size AS VARCHAR), p_type FROM part
    UNION ALL SELECT 'signal', {_NAMED.replace("'N'", "'sig_'")}, 'IN', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0
    UNION ALL SELECT 'pin', {_NAMED}, 'A' || p_partkey, 'OUT' FROM part
    UNION ALL SELECT 'timing', {_NAMED}, CAST(p_size AS VARCHAR), 'ns' FROM part
    UNION ALL SELECT 'interface', {_NAMED}, p_type, CASE WHEN p_partkey % 2 = 0 THEN 'master' ELSE 'slave' END FROM part
    UNION ALL SELECT 'constraint', p_partkey // 50, p_type || ' T' || p_partkey, p_size || '.5', 'ns' FROM part
    UNION ALL SELECT 'physical_constraint', {_NAMED}, 'M' || p_size, p_brand FROM part"""
)
def table_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty parts each as tables of every kind, and the entities that these define, with two of their attributes."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    named, fifth = F.concat(F.lit("N"), key), F.col("p_partkey") % 5 == 0
    kinds = {
        "memory_map": (F.array(named, F.when(fifth, "none").otherwise(F.concat(F.lit("0x"), size)), F.concat(size, F.lit("KB"))), "Memory map", ("Region", "Base Address", "Size"), ("address", "size")),
        "interrupt": (F.array(named, size, F.col("p_type"), F.lit("x")), None, ("IRQ name", "Number", "Type", "Description"), ("number", "type")),
        "signal": (F.array(F.when(fifth, "reserved").otherwise(F.concat(F.lit("sig_"), key)), F.lit("input"), F.concat(size, F.lit(" b"))), None, ("Signal", "Direction", "Width"), ("direction", "width")),
        "pin": (F.array(named, F.concat(F.lit("A"), key), F.lit("Output"), F.lit("")), "Balls of the package", ("Ball name", "Pin No", "Direction", "Function"), ("number", "direction")),
        "timing": (F.array(named, size, F.lit(""), F.lit("ns")), None, ("Symbol", "Min", "Max", "Unit"), ("min", "unit")),
        "interface": (F.array(named, F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, "Master").otherwise("slave")), None, ("Interface", "Protocol", "Role"), ("protocol", "direction")),
        "constraint": (F.array(F.col("p_type"), F.concat(F.lit("T"), key), F.concat(size, F.lit(".5")), F.lit("ns")), "SDC constraints", ("Type", "Target", "Value", "Unit"), ("value", "unit")),
        "physical_constraint": (F.array(named, F.concat(F.lit("M"), size), F.col("p_brand")), "Placement", ("Rule", "Layer", "Region"), ("layer", "region")),
    }
    out = None
    for kind, (row, caption, headers, (a, b)) in kinds.items():
        one = extract.entities(_fifties(part, "p_partkey", row, caption, headers), kind).select("kind", "doc_id", "name", F.col(a).alias("a"), F.col(b).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out


# --- sections: the blocks of pages ---------------------------------------------------------------------------------

_HEADINGS = r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    s AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(</?(?:h[1-6]|p|li|ul|ol|article|nav|footer|div|body)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM c),
    k AS (SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '(?is)^<(?:h[1-6]|p|li)(?:\s[^>]*)?>')) AS f FROM s),
    r AS (SELECT page_id, unnest(f) AS raw, generate_subscripts(f, 1) - 1 AS pos FROM k),
    t AS (SELECT page_id AS doc_id, pos, CASE WHEN regexp_matches(raw, '(?i)^<h[1-6]') THEN CAST(regexp_extract(raw, '(?i)^<h([1-6])', 1) AS INTEGER) WHEN regexp_matches(raw, '(?i)^<p') THEN 7 ELSE 8 END AS level, replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title FROM r),
    n AS (SELECT *, substr(regexp_replace(trim(title), '[^A-Za-z0-9_.\-]+', '_', 'g'), 1, 64) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM t WHERE title <> ''),
    q AS (SELECT *, coalesce(nullif(path, ''), 'sec_' || nth) AS qn FROM n),
    sections AS (SELECT *, 'section:' || regexp_replace(trim(qn), '[^A-Za-z0-9_.\-]+', '_', 'g') || '#' || doc_id AS id FROM q)
"""


def page_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of pages as sections in reading order: headings by their tags, under them paragraphs, under these list items."""
    found = blocks.html_blocks(table(spark, sf_dir, "pages"))
    level = F.when(F.col("kind") == "heading", F.col("heading_level")).when(F.col("kind") == "paragraph", 7).otherwise(8)
    return extract.section_graph(found.select(F.col("page_id").alias("doc_id"), F.col("reading_order").alias("pos"), level.alias("level"), F.col("text").alias("title"), F.lit(1).alias("page")))


@query(_HEADINGS + "SELECT id, doc_id, title AS name, qn AS qualified_name, level, 'sha256:' || sha256(concat_ws('|', path, title)) AS hash FROM sections")
def section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sections(spark, sf_dir)[0].select("id", "doc_id", "name", "qualified_name", "level", "hash")


@query(
    _HEADINGS + """SELECT p.id AS src, s.id AS dst, 'contains' AS kind FROM sections s JOIN sections p ON p.doc_id = s.doc_id AND p.pos = (SELECT max(o.pos) FROM sections o WHERE o.doc_id = s.doc_id AND o.pos < s.pos AND o.level < s.level)"""
)
def section_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sections(spark, sf_dir)[1].select("src", "dst", "kind")


# --- prose -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey // 50 AS doc_id, 'requirement' AS kind, 'REQ_P_' || p_partkey AS name, p_name || ' shall be ' || p_type AS summary FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey // 50, 'errata', 'ERR' || (1000 + p_partkey), p_name || ' fails' FROM part WHERE p_partkey % 2 = 1"""
)
def prose_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as numbered requirements and errata in prose, a block each."""
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("REQ_P_"), key, F.lit(": "), F.col("p_name"), F.lit(" shall be "), F.col("p_type"))).otherwise(F.concat(F.lit("ERR"), (F.col("p_partkey") + 1000).cast("string"), F.lit(" : "), F.col("p_name"), F.lit(" fails")))
    b = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("long").alias("doc_id"), key.alias("id"), text.alias("text"))
    return extract.text_entities(b).select("doc_id", "kind", "name", "summary")


@query(
    "WITH p AS (SELECT p_partkey // 50 AS doc_id, p_partkey % 50 // 8 AS page, 'PT' || p_partkey AS name, p_name || ' of ' || p_brand AS \"full\", p_partkey % 8 AS at FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT doc_id, page FROM p GROUP BY ALL HAVING count(*) >= 5) SELECT doc_id, CAST(page AS INTEGER) AS page, name, \"full\" FROM p JOIN n USING (doc_id, page)"
)
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts each as a page of lines with abbreviations; pages with fewer than five aren't glossaries."""
    part = table(spark, sf_dir, "part")
    line = F.concat(F.lit("PT"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(" : "), F.col("p_name"), F.lit(" of "), F.col("p_brand"))
    b = part.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("doc_id"), F.floor(F.col("p_partkey") % 50 / 8).cast("int").alias("page"), line.alias("text"))
    return extract.glossary(b).select("doc_id", "page", "name", "full")


# --- registers over several tables -----------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders), "
    "asks AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p) - 1 AS nth FROM l WHERE k % 11 <> 0) "
    "SELECT a.c AS doc_id, a.c || '.' || (a.p + 1) AS table_id, 'P' || n.k || '_STATUS' AS register, f.name AS name, CAST(f.high AS INTEGER) AS high, CAST(f.low AS INTEGER) AS low FROM asks a JOIN l n ON a.c = n.c AND a.nth = n.p, (VALUES ('EN', 3, 0), ('MODE', 7, 4)) f(name, high, low)"
)
def registers_over_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a document: a table that lists a register for each order, then a table of bit fields for each order
    that doesn't name it; those with a caption stay out of it."""
    from pyspark.sql.window import Window

    of_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(of_customer) - 1).alias("p"), F.col("o_orderkey").alias("k"))
    text = lambda c: F.col(c).cast("string")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    row = F.array(F.concat(F.lit("P"), text("k"), F.lit("_STATUS")), text("p"), F.lit("RW"), F.lit("0x10"), F.lit("of an order"))
    listed = orders.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    ident = lambda n: F.concat(text("doc_id"), F.lit("."), n.cast("string")).alias("id")
    lists = listed.select("doc_id", ident(F.lit(0)), F.lit(0).alias("pos"), F.lit("Register summary").alias("caption"), words("Register", "Register number", "Type", "Location", "Description").alias("headers"), "rows")
    rows = F.array(words("[3:0]", "EN", "RW", "about"), words("[7:4]", "MODE", "RO", "about"))
    laid = orders.select("doc_id", ident(F.col("p") + 1), (F.col("p") + 1).alias("pos"), F.when(F.col("k") % 11 == 0, "of other things").alias("caption"), words("Bits", "Field", "Access", "Description").alias("headers"), rows.alias("rows"))
    return register_context.registers_in_order(lists.unionByName(laid))[1].where("kept").select("doc_id", "table_id", "register", "name", "high", "low")


# --- spans -----------------------------------------------------------------------------------------------------------


@query(
    f"WITH l AS ({_LINES}) SELECT l_orderkey AS id, 'Item Key|Item Qty|Flag' AS headers, string_agg(l_partkey || '|' || CASE WHEN q % 2 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(q AS VARCHAR) END || '|' || first_flag, ';' ORDER BY p) AS rows, CAST(2 + count(*) FILTER (q % 2 = 0) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS INTEGER) AS merged "
    "FROM (SELECT *, first(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY p) AS first_flag FROM l) GROUP BY l_orderkey"
)
def span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a table with two header rows: even quantities span two columns, the first line's flag spans all rows."""
    from stratalake.sources import grids

    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*order, F.col("l_quantity").cast("long").alias("q"), "l_returnflag").alias("line"))
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    cell = lambda row, col, rows, cols, text, header=False: F.struct(*[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in (("row", row), ("col", col), ("row_span", rows), ("col_span", cols))], (F.lit(text) if isinstance(text, str) else text.cast("string")).alias("text"), F.lit(header).alias("header"))
    even = lambda line: line["q"] % 2 == 0
    own = lambda line, p: F.array_compact(F.array(cell(p + 2, 0, 1, F.when(even(line), 2).otherwise(1), line["l_partkey"]), F.when(~even(line), cell(p + 2, 1, 1, 1, line["q"])), F.when(p == 0, cell(p + 2, 2, F.size("lines"), 1, line["l_returnflag"]))))
    heads = F.array(cell(0, 0, 1, 2, "Item", True), cell(0, 2, 2, 1, "Flag", True), cell(1, 0, 1, 1, "Key", True), cell(1, 1, 1, 1, "Qty", True))
    tables = orders.select(F.col("l_orderkey").alias("id"), grids.span_grid(F.concat(heads, F.flatten(F.transform("lines", own)))).alias("g"))
    return tables.select("id", F.array_join("g.headers", "|").alias("headers"), F.array_join(F.transform("g.rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), F.size("g.merged").alias("merged"))
