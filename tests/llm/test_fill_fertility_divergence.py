"""Fill-in-the-middle, tokeniser fertility and source divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import divergence, fertility, fill_middle

DOC = "doc_id long, text string, lang string, source string, n_chars long"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, marks, odd spaces."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gámma", "delta", "漢字", "😀", "#tag", "x|y", "und", "le"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", " ", "\x0b", "\x1c"]) for _ in range(n))
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, " \n\t ", None, None), (4, prose(20_000), "en", "a"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "lost id here", "en", None), (6, "é ü 漢字 😀 text ", "fr", "c"), (7, "a <P> b", "fr", "c"), (8, "z" * 100_000, "", "")]
    rows += [(100 + i, "copied text of a hot group " + "x " * 40, "en", "a") for i in range(40)]
    rows += [(200 + i, prose(rng.randint(1, 300)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(150)]
    rows += [(500 + i, rng.choice(["", " ", "\n"]).join(rng.choice(["a", "b ", " c", "　"]) for _ in range(i)), "en", "d") for i in range(30)]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    extra = {n: F.lit(7) for n in ("n", "form", "output", "prefix_chars", "kept", "n_words", "outside", "band_group", "part", "item", "value", "rank", "term", "row", "col", "p", "at")}
    return spark.createDataFrame(odd_rows, DOC).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- 12: fill in the middle -----------------------------------------------------------------------------------------


def brute_fill(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_against_brute_force(odd, odd_rows, none):
    made = fill_middle.fill_middle(odd)
    assert made.columns == [*odd.columns, "_n", "_form", "prefix_bytes", "middle_bytes", "_prefix_chars", "middle_chars", "_output"]
    rows = made.withColumn("back", fill_middle.restored(F.col("_output"), F.col("_form"))).collect()
    want = Counter((i, t, *brute_fill(i, t)) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.text, r._n, r._form, r._prefix_chars, r.middle_chars, r._output) for r in rows) == want
    assert all(r.back == (r.text or "") and r.kept == 7 for r in rows)
    assert {r._form for r in rows} == {"plain", "spm", "psm"}
    assert fill_middle.fill_middle(none).collect() == []


def test_swar_marks_every_byte():
    """Each byte value, in each place of a word, before and after each kind of byte."""
    white = {0x20, *range(0x09, 0x0E)}
    raw = bytes(b for x in range(256) for b in (x, 0x20, x, 0x61, x, 0x0D, 0x61, 0x80, x))
    ends = fill_middle.UnitEnds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    want = [i for i in range(len(raw)) if i + 1 == len(raw) or raw[i] not in white and raw[i + 1] in white]
    assert ends.select(np.arange(1, len(want) + 1)).tolist() == [i + 1 for i in want]
    assert ends.rank(np.arange(len(raw) + 1)).tolist() == [sum(j < i for j in want) for i in range(len(raw) + 1)]


def test_swar_texts_side_by_side(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))).encode() for _ in range(500)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    draws = tuple(np.array([rng.getrandbits(32) for _ in texts]) for _ in range(2))
    n, p, m = fill_middle.cut(np.frombuffer(b"".join(texts), np.uint8), bounds, draws)
    for i, t in enumerate(texts):
        units = UNITS.findall(t.decode())
        a, b = sorted(int(d[i]) % (len(units) + 1) for d in draws)
        assert (n[i], p[i], m[i]) == (len(units), len("".join(units[:a])), len("".join(units[:b])))
    empty = fill_middle.cut(np.zeros(0, np.uint8), np.zeros(3, np.int64), (np.array([5, 6]), np.array([7, 8])))
    assert [x.tolist() for x in empty] == [[0, 0]] * 3
    monkeypatch.setattr(fill_middle, "PIECE", 10)
    assert list(fill_middle._pieces(np.array([0, 4, 8, 30, 30, 31]))) == [(0, 2), (2, 3), (3, 5)]


# --- 11: tokeniser fertility ----------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def brute_measures(text, name, data):
    import sentencepiece

    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = model.encode(text)
        fall = [model.id_to_piece(i).startswith("<0x") for i in ids]
    else:
        vocabulary = fertility._made(name, data)
        ids = vocabulary.encode(text)
        import base64

        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, data.splitlines())}
        fall = [tokens[i].decode("utf-8", "ignore").encode() != tokens[i] for i in ids]
    if not ids:
        return 0, 0.0, 0.0, 0.0
    return len(ids), len(text) / len(ids), sum(fall) / len(ids), -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())


def brute_script(text):
    import unicodedata

    of = Counter(unicodedata.name(c, "").split(" ")[0].lower() for c in text if c.isalpha())
    of.pop("", None)
    return min(of, key=lambda s: (-of[s], s), default="")


def brute_kept(rows):
    """For each (text, lang) base measures, base_failed, group and kept, in plain Python."""
    files = fertility.read_vocabularies(fertility.FOLDER, fertility.VOCABULARIES)
    facts = {}
    for text, lang in {(r[1], r[2]) for r in rows}:
        base = brute_base(text)
        found = [brute_measures(text or "", *f) for f in files]
        group = lang if lang is not None else brute_script(text or "")
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        length = int(math.log2(max(1, found[0][0])) // 2)
        facts[text, lang] = base, failed, group, length, [round(x, 3) for m in found for x in m[1:]]
    cells = defaultdict(set)
    for base, failed, group, length, own in facts.values():
        if not failed:
            for cell in ((group, length), (group, None), (None, length), (None, None)):
                cells[cell].add((group, length, base, tuple(own)))
    out = {}
    for key, (base, failed, group, length, own) in facts.items():
        cell = next((c for c in ((group, length), (group, None), (None, length), (None, None)) if len(cells[c]) >= fertility.LEAST_TEXTS), None)
        kept = not failed
        for i, x in enumerate(own):
            if kept and cell is not None:
                low, mid, high = np.percentile([y[3][i] for y in cells[cell]], [25, 50, 75])
                least = max(abs(mid) * fertility.LEAST_PART, fertility.LEAST_UNIT)
                kept = mid - max(6 * (mid - low), least) <= x <= mid + max(6 * (high - mid), least)
        out[key] = base, failed, group, bool(kept)
    return out


def test_fertility_against_brute_force(spark, odd, odd_rows, none):
    rng = random.Random(8)
    words = [a + b for a in ("ther", "on", "st", "ea", "ing", "hand") for b in ("e", "ly", "tion", "est", "and", "er")]
    clean = [(1000 + i, " ".join(rng.choices(words, k=rng.randint(60, 400))), "en", "a", 0) for i in range(150)]
    clean += [(3000 + i, clean[0][1], "en", "hot", 0) for i in range(60)]
    junk = [(2000 + i, " ".join(rng.choice(words).upper() + rng.choice("#$%&*") * 5 for _ in range(200)), "en", "a", 0) for i in range(5)]
    rows = [*odd_rows, *clean, *junk]
    docs = spark.createDataFrame(rows, DOC).withColumns({"kept": F.lit(7), "n_words": F.lit(8), "band_group": F.lit(9)})
    got = fertility.judge(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and "_kept" in got.columns
    want = brute_kept(rows)
    found = got.collect()
    assert len(found) == len(rows) and all(r.kept == 7 for r in found)
    for r in found:
        base, failed, group, kept = want[r.text, r.lang]
        assert (r._n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert (r.base_failed, r._band_group, r._kept) == (failed, group, kept), (r.outside, r.text[:80])
    kept = {r.doc_id for r in found if r._kept}
    assert {1000 + i for i in range(150)} <= kept and not kept & {2000 + i for i in range(5)}
    assert fertility.judge(none, keep=["doc_id"]).collect() == []


def test_fertility_by_script(spark):
    texts = ["слово дело " * 30, "word deed " * 30, "слово word дело " * 30, "12 34 " * 40]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOC)
    found = {r.doc_id: r.band_group for r in fertility.judge(docs, by="script", keep=["doc_id"]).collect()}
    assert found == {0: "cyrillic", 1: "latin", 2: "cyrillic", 3: ""}


def test_repeated_words_of_many_kinds():
    """Over a million different words: the products of three would pass 64 bits."""
    words = [str(i).encode() for i in range(1_050_000)]
    assert fertility.repeated_words([*words, b"7", b"8", b"9", b"8"]) == 6
    assert fertility.repeated_words([b"a"] * 5) == 5
    assert fertility.repeated_words([b"a", b"b", b"a", b"b", b"a", b"b"]) == 6
    assert fertility.repeated_words([b"a", b"b", b"c"]) == 0


def test_vocabularies_are_bounded(monkeypatch):
    monkeypatch.setattr(fertility, "VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        fertility.read_vocabularies(fertility.FOLDER, fertility.VOCABULARIES)


# --- 13: divergence of sources --------------------------------------------------------------------------------------


def brute_audit(rows, least, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for a, s in groups if a == lang]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda n, of: 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(total.values())) for t in kept}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item, -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("least", "side"), [(30, 512), (1, 512), (2, 16)])
def test_divergence_against_brute_force(odd, odd_rows, least, side):
    got = divergence.audit(odd, least_docs=least, side=side).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_audit(odd_rows, least)


def test_divergence_many_groups(spark):
    """More groups and terms than a tile has, most cells zero, groups without terms."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in (min(int(rng.expovariate(0.02)), 600) for _ in range(rng.randint(0, 6)))), "en", f"s{i % 45}", 0) for i in range(400)]
    rows += [(900, "1 2 3", "en", "blank", 0), (901, None, "xx", "only", 0), (902, None, "xx", "other", 0)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOC), least_docs=2, side=16, top_terms=3).collect()}
    assert got == brute_audit(rows, 2, 3)


def test_divergence_empty_table(none):
    assert divergence.audit(none).collect() == []


def test_counts_are_passed_on(monkeypatch, odd, odd_rows):
    import pyarrow as pa

    rows = [tuple((x or "").encode() for x in (r[2], r[3], r[1])) for r in odd_rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    totals = []
    for held in (1 << 20, 50, 1):
        monkeypatch.setattr(divergence, "HELD", held)
        sums = Counter()
        for out in divergence._count(iter([batch, batch])):
            for r in out.to_pylist():
                sums[r["lang"], r["source"], r["term"], "n"] += r["n"]
                sums[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        totals.append(sums)
    assert totals[0] == totals[1] == totals[2]


def test_shares_are_exact(spark):
    """Counts whose products with the unit pass 64 bits."""
    counts = [(0, 0, 1), (3, 10, 2), (9 * 10**14, 9 * 10**14, 7), (123456789012345, 987654321098765, 1000), (1, 8 * 10**15, 10**9)]
    found = spark.createDataFrame(counts, "n long, total long, terms long").select("n", "total", "terms", divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert [(r.n, r.total, r.terms, r.p) for r in found] == [(n, of, v, 1 + 1_000_000_000 * (n + 5) // (of + 5 * v)) for n, of, v in counts]


@pytest.mark.parametrize("density", [0.0, 0.002, 0.05, 0.9])
def test_quadtree_against_dense_matrix(density):
    rng = np.random.default_rng(int(density * 1000))
    side, width, heights = 64, 50, (37, 64)
    dense, trees, zeros = [], [], []
    for height in heights:
        zero = np.concatenate([rng.integers(1, 100, height), np.zeros(side - height, np.int64)])
        cells = np.argwhere(rng.random((height, width)) < density)
        values = rng.integers(100, 1000, len(cells))
        full = np.repeat(zero[:, None], width, axis=1)
        full[cells[:, 0], cells[:, 1]] = values
        dense.append(full)
        zeros.append(zero)
        trees.append(divergence.Quadtree(cells[:, 0], cells[:, 1], values, zero, width))
    for i, j in ((0, 1), (1, 1)):
        got = divergence.differences(trees[i], trees[j], zeros[i], zeros[j], (heights[i], heights[j]), width, half=i == j)
        want = np.abs(dense[i][:, None, :] - dense[j][None, :, :]).sum(axis=-1)
        at = np.triu_indices(heights[i], 1) if i == j else np.indices((heights[i], heights[j]))
        assert (got[tuple(at)] == want[tuple(at)]).all()
