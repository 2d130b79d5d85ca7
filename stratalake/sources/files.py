"""Files to documents: discovery, metadata from names, and parsers for Markdown, HTML tables, XLSX and DOCX."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "page int, reading_order int, kind string, heading_level int, section_path string, text string, caption string, headers array<string>, rows array<array<string>>"
_BLOCK_TYPE = pa.list_(pa.struct([
    ("page", pa.int32()), ("reading_order", pa.int32()), ("kind", pa.string()), ("heading_level", pa.int32()), ("section_path", pa.string()),
    ("text", pa.string()), ("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))),
]))


def discover(spark: SparkSession, root: str, include: str = "*", exclude: list[str] | None = None) -> DataFrame:
    """path, modification time, length and content of files under root by glob, without those that match an exclusion."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root)
    for pattern in exclude or []:
        found = found.where(~F.col("path").rlike(pattern))
    return found


def doc_type(path: Column) -> Column:
    """A document's type by the words in its file's name."""
    name = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    has = lambda *words: F.greatest(*[F.contains(name, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(has("errata"), "errata").when(has("trm", "reference", "manual"), "reference_manual").when(has("datasheet"), "datasheet")
        .when(has("user") & has("guide"), "user_guide").when(has("app") & has("note"), "app_note")
        .when(has("protocol", "subsystem spec", "interface spec", " spec", "_spec", "-spec"), "protocol").otherwise("unknown")
    )


def _block(order: int, kind: str, text: str, level: int | None = None, path: str | None = None, page: int = 1, caption: str | None = None, headers: list | None = None, rows: list | None = None) -> dict:
    return {"page": page, "reading_order": order, "kind": kind, "heading_level": level, "section_path": path, "text": text, "caption": caption, "headers": headers, "rows": rows}


class Numbering:
    """Counters of nested headings: 1, 1.1, 1.2, 2, …"""

    def __init__(self) -> None:
        self.counts: list[int] = []

    def next(self, level: int) -> str:
        self.counts = (self.counts + [0] * level)[:level]
        self.counts[-1] += 1
        return ".".join(str(max(1, c)) for c in self.counts)


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_blocks(text: str) -> list[dict]:
    """Headings, fenced code, pipe tables, images and paragraphs of a Markdown text."""
    out: list[dict] = []
    numbers, path = Numbering(), None
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append(_block(len(out), "paragraph", "\n".join(held), path=path))
            held.clear()

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"\s*(```|~~~)", line):
            flush()
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append(_block(len(out), "code", "\n".join(lines[i + 1 : end]), path=path))
            i = end + 1
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            path = numbers.next(len(m[1]))
            out.append(_block(len(out), "heading", m[2], len(m[1]), path))
        elif m := re.match(r"\s*!\[([^\]]*)\]\(([^)]*)\)\s*$", line):
            flush()
            out.append(_block(len(out), "figure", m[1], path=path, caption=m[1] or None))
        elif "|" in line and i + 1 < len(lines) and re.match(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            flush()
            end = next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines))
            out.append(_block(len(out), "table", "", path=path, headers=cells(line), rows=[cells(x) for x in lines[i + 2 : end]]))
            i = end
            continue
        elif line.strip():
            held.append(line.strip())
        else:
            flush()
        i += 1
    flush()
    return out


class _Grid(HTMLParser):
    """Cells of an HTML table with their spans."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def _close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.spans))
            self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            given = dict(attrs)
            number = lambda name: int(given[name]) if (given.get(name) or "").isdigit() and 0 < int(given[name]) <= 1000 else 1
            self.cell, self.spans = [], (number("rowspan"), number("colspan"))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_grid(html: str) -> tuple[list[str], list[list[str]]]:
    """Headers and body of a table, rectangular: a cell that spans rows or columns stands in each of its places."""
    parser = _Grid()
    parser.feed(html)
    parser.close()
    parser._close()
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(parser.rows):
        c = 0
        for text, down, across in row:
            while (r, c) in grid:
                c += 1
            for y in range(r, min(r + down, len(parser.rows))):
                for x in range(c, c + across):
                    grid.setdefault((y, x), text)
            c += across
    width = max((x for _, x in grid), default=-1) + 1
    full = [[grid.get((y, x), "") for x in range(width)] for y in range(len(parser.rows))]
    full = [r for r in full if any(r)]
    return (full[0], full[1:]) if full else ([], [])


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def cell_text(value: str | None) -> str:
    """A cell's value as text; whole numbers lose their .0."""
    return re.sub(r"^(-?\d+)\.0+$", r"\1", value or "")


def xlsx_blocks(content: bytes, sheet_rows: int | None = None, text_rows: int | None = None) -> list[dict]:
    """For each sheet a heading, a table whose header is the first row that isn't empty, and its rows as text: all of them,
    or as many as are asked for; then the table's caption ends in how many there are."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for page, (title, name) in enumerate(zip(titles, sheets, strict=False), 1):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                own: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{_SHEET}c")):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = k
                    if letters:
                        at = 0
                        for x in letters[0]:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    v, kind = c.find(f"{_SHEET}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else v.text if v is not None else ""
                    own[at] = shared[int(text)] if kind == "s" and text else cell_text(text)
                rows.append([own.get(i, "") for i in range(max(own, default=-1) + 1)])
            rows = [r for r in rows if any(c.strip() for c in r)]
            out.append(_block(len(out), "heading", title or f"Sheet{page}", 1, str(page), page))
            if rows:
                kept = rows[1:] if sheet_rows is None else rows[1 : 1 + sheet_rows]
                caption = title if len(kept) == len(rows) - 1 else f"{title or f'Sheet{page}'} ({len(kept)} of {len(rows) - 1} rows)"
                out.append(_block(len(out), "table", "", None, str(page), page, caption, rows[0], kept))
                out.append(_block(len(out), "paragraph", "\n".join("\t".join(r) for r in rows[:text_rows]), None, str(page), page))
    return out


def heading_level(style: str | None) -> int | None:
    """1 to 9 from a paragraph style such as Heading 2; 1 for Title."""
    if not style:
        return None
    if style.lower() == "title":
        return 1
    m = re.fullmatch(r"(?i)heading\s*([1-9])", style)
    return int(m[1]) if m else None


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs, headings by style and tables of a word-processing document, all on page 1."""
    out: list[dict] = []
    numbers, path = Numbering(), None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    joined = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_WORD}p":
            text, style = joined(e).strip(), e.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = heading_level(style.get(f"{_WORD}val") if style is not None else None)
            if text and level:
                path = numbers.next(level)
                out.append(_block(len(out), "heading", text, level, path))
            elif text:
                out.append(_block(len(out), "paragraph", text, None, path))
        elif e.tag == f"{_WORD}tbl":
            rows = [[joined(c).strip() for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")]
            if rows:
                out.append(_block(len(out), "table", "", None, path, headers=rows[0], rows=rows[1:]))
    return out


PARSERS = {".md": lambda b: markdown_blocks(b.decode("utf-8", "replace")), ".markdown": lambda b: markdown_blocks(b.decode("utf-8", "replace")), ".xlsx": xlsx_blocks, ".docx": docx_blocks}


def parse_files(files: DataFrame, sheet_rows: int | None = None, text_rows: int | None = None) -> DataFrame:
    """doc_id (the path), error, and a row for each block of the files (path, content) that a parser is known for; sheet_rows
    and text_rows bound what sheets give (see xlsx_blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parse = PARSERS.get(re.sub(r"^.*(?=\.)", "", path).lower())
                bounds = (sheet_rows, text_rows) if parse is xlsx_blocks else ()
                try:
                    blocks.append(parse(content, *bounds) if parse else [])
                    errors.append(None if parse else "no parser")
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    blocks.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(blocks, _BLOCK_TYPE)], ["doc_id", "error", "blocks"])

    parsed = files.select("path", "content").mapInArrow(run, f"doc_id string, error string, blocks array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in BLOCK_SCHEMA.split(', '))}>>")
    rows = parsed.select("doc_id", "error", F.inline_outer("blocks"))
    return rows.withColumn("id", F.when(F.col("kind").isNotNull(), F.concat("doc_id", F.lit("#p"), F.col("page").cast("string"), F.lit("#b"), F.col("reading_order").cast("string"))))


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, position, headers and rows of each table in pages' HTML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [html_grid(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in grids], pa.list_(pa.string())), pa.array([g[1] for g in grids], pa.list_(pa.list_(pa.string())))], ["id", "pos", "headers", "rows"])

    found = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<table[^>]*>.*?</table>)"), 1)).alias("pos", "raw"))
    kind = pages.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, pos int, headers array<string>, rows array<array<string>>").withColumnRenamed("id", id_col)
