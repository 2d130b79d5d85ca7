"""The registered queries in DuckDB's SQL."""

#: Lines that aren't blank, numbered, and the chunks that they are packed to: a chunk ends once it holds 2000 characters.
CHUNKS = """
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
lines AS (SELECT doc_id, i - 1 AS i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM raw WHERE trim(line) <> ''),
walk AS (SELECT doc_id, n, 0 AS part, length(line) AS held FROM lines WHERE n = 1
    UNION ALL SELECT l.doc_id, l.n, CASE WHEN w.held >= 2000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.held >= 2000 THEN length(l.line) ELSE w.held + length(l.line) END
    FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1),
chunks AS (SELECT doc_id || '#c' || part AS chunk_id, doc_id, part, min(l.i) AS first_line, string_agg(line, chr(10) ORDER BY l.n) AS text
    FROM walk JOIN lines l USING (doc_id, n) GROUP BY doc_id, part)
"""

_FOLD = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def tokens(column: str) -> str:
    return f"regexp_extract_all({_FOLD.format(column)}, '[\\p{{L}}\\p{{N}}]+')"


def bm25(phrase: str, suffix: str = "") -> str:
    """CTEs after CHUNKS that end in a table bm25 (doc_id, chunk_id, tf, score): the phrase's occurrences, overlaps included."""
    words = phrase.split()
    n = len(words)
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"""
, tok{suffix} AS (SELECT doc_id, chunk_id, {tokens('text')} AS w FROM chunks),
cnt{suffix} AS (SELECT doc_id, chunk_id, len(w) AS len, len(list_filter(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: {same})) AS tf FROM tok{suffix}),
st{suffix} AS (SELECT count(*) AS n, avg(len) AS avg_len, count(*) FILTER (tf > 0) AS df FROM cnt{suffix}),
bm25{suffix} AS (SELECT doc_id, chunk_id, tf, -greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS score
    FROM cnt{suffix}, st{suffix} WHERE tf > 0)
"""


BLOCKS = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS reading_order FROM documents),
blocks AS (SELECT doc_id || '#p1#b' || reading_order AS id, doc_id, 1 AS page, reading_order, text,
    CASE WHEN length(text) <= 200 AND regexp_matches(text, '^\s*[0-9A-Z][0-9.]*\.?\s+\S')
          AND (regexp_matches(text, '^\s*[0-9]+(\.[0-9]+){0,5}(\.\s|[^0-9.]|$)') OR regexp_matches(text, '(?i)^\s*chapter\s+[0-9]+([^0-9]|$)')
            OR regexp_matches(text, '^\s*(?i:appendix)\s+[A-Z]([A-Z][a-z]|[^A-Za-z]|$)') OR regexp_matches(text, '^\s*[A-Z]\.[0-9]+(\.[0-9]+){0,4}([^0-9.]|$)')) THEN 'heading'
        WHEN regexp_matches(text, '^\s*[-*•]\s+\S') THEN 'list' WHEN regexp_matches(text, '^\s*\|.*\|\s*$') THEN 'table' ELSE 'paragraph' END AS kind
    FROM raw WHERE trim(text) <> '')
"""

#: Regions, nations and customers as the nodes of a graph, with contains edges, and orders of customers.
GRAPH = """
WITH RECURSIVE nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order ' || o_orderkey FROM orders),
edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'references' FROM orders)
"""
