"""The ten operators against brute force on small tables, with the odd cases that their docstrings define."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from stratalake.core.ranks import with_global_rank
from stratalake.core.storage import fresh_path
from stratalake.llm import apportion, components, imatch, kneser_ney, quotations, simhash, splitters, suffixes, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows, schema=DOC):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows], schema)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, " \n\t ", None, None), (4, prose(30_000), "en", "a"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "lost id here", "en", None), (6, "é ü 漢字 😀 text", "fr", "c")]
    rows += [(100 + i, "copied text of a hot group " + "x " * 40, "en", "a") for i in range(40)]
    rows += [(200 + i, prose(rng.randint(1, 300)), "en", rng.choice(["a", "b", "c", None])) for i in range(60)]
    from pyspark.sql import functions as F

    extra = {n: F.lit(7) for n in ("size", "id", "key", "sub", "rng", "fp", "component", "n_words", "matches", "source_size", "target", "taken", "held_out", "score", "words", "cell", "row", "term", "page")}
    return make_docs(spark, rows).withColumns(extra).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


# --- 2: sampled splitters -------------------------------------------------------------------------------------------


def check_shards(rows, texts, n_shards=8):
    assert len(rows) == len(texts)
    assert {r.law for r in rows} <= {"bytes"}
    sizes = sorted(r.size for r in rows)
    assert sizes == sorted(len((t or "").encode()) + 1 for t in texts)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < n_shards for r in rows)


def test_splitters_odd_cases(odd_docs):
    out = splitters.sampled_splitters(odd_docs)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    check_shards(rows, [r.text for r in odd_docs.collect()])
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].text_crc32 == zlib.crc32("é ü 漢字 😀 text".encode())
    assert by_id[1].text_crc32 == 0 and by_id[1].size == 1


def test_splitters_balance_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(1, 400) + str(i), "en", "a") for i in range(3000)] + [(9000 + i, "same " * 20, "en", "a") for i in range(300)]
    out = splitters.sampled_splitters(make_docs(spark, rows)).toPandas()
    per = out.groupby("shard")["size"].sum()
    assert per.max() <= 1.02 * per.mean() and len(per) == 8
    assert out[out.doc_id >= 9000].shard.nunique() == 1  # a group that fits a shard isn't split
    again = splitters.sampled_splitters(make_docs(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_splitters_split_a_group_over_a_shard(spark):
    rows = [(i, "hot text " * 10, "en", "a") for i in range(2000)] + [(5000 + i, f"cold {i} " * 3, "en", "a") for i in range(500)]
    per = splitters.sampled_splitters(make_docs(spark, rows)).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in per]
    assert len(loads) == 8 and max(loads) < 1.1 * sum(loads) / 8


def test_splitters_spread_equal_rows(spark):
    # One text without an id, 20,000 times, beside some others: no task, range or shard gets all of it.
    hot = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('equal rows ', 27) AS text")
    cold = spark.range(3000).selectExpr("id AS doc_id", "concat('cold ', id, repeat(' x', CAST(id % 60 AS INT))) AS text")
    drawn = []
    plain, splitters_sampled = splitters._sampled, drawn
    splitters._sampled = lambda *a: (splitters_sampled.append(plain(*a)), splitters_sampled[-1])[1]
    try:
        rows = splitters.sampled_splitters(hot.unionByName(cold)).collect()
    finally:
        splitters._sampled = plain
    check_shards(rows, ["equal rows " * 27] * 20_000 + [r.text for r in cold.collect()])
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) < 1.02 * sum(loads) / 8 and min(loads) > 0.98 * sum(loads) / 8
    assert sum(len(v) for d in drawn for v in d.values()) < 6 * 512 * 32


def test_splitters_are_stretches_of_keys(spark):
    # Against brute force: ranges as the cuts say, shards as stretches of ranges but for frequent texts, slots in order.
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(1, 400) + str(i), "en", "a") for i in range(3000)] + [(9000 + i, "same " * 20, "en", "a") for i in range(300)] + [(20_000, "long " * 30_000, "en", "a")]
    docs = make_docs(spark, rows)
    out = splitters.sampled_splitters(docs, carry=True).join(docs.selectExpr("doc_id", "xxhash64(text) AS text_key"), "doc_id").toPandas()
    keys = out.groupby("range")["text_key"].agg(["min", "max"]).sort_index()
    assert (keys["max"].to_numpy()[:-1] < keys["min"].to_numpy()[1:]).all()
    single = keys.index[keys["min"] == keys["max"]]
    stretch = out[~out["range"].isin(single)].groupby("range")["shard"].agg(["min", "max"]).sort_index()
    assert (stretch["min"] == stretch["max"]).all() and stretch["min"].is_monotonic_increasing
    assert set(out[out.doc_id >= 9000].groupby("text_key")["shard"].nunique()) == {1}
    per = out.groupby("shard")["size"].sum()
    rest = per.drop(out[out.doc_id == 20_000]["shard"].iloc[0])
    assert rest.max() < 1.02 * rest.mean()
    assert sorted(zip(out.doc_id, out.text)) == sorted((r[0], r[1]) for r in rows)
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_splitters_carry_clashing_columns(odd_docs):
    out = splitters.sampled_splitters(odd_docs, carry=True)
    assert out.columns == [f"{c}_in" if c in splitters.NEW else c for c in odd_docs.columns] + list(splitters.NEW)
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd_docs.collect())


def test_splitters_empty_and_one(spark, no_docs):
    assert splitters.sampled_splitters(no_docs).count() == 0
    assert [r.slot for r in splitters.sampled_splitters(make_docs(spark, [(1, "x", "en", "a")])).collect()] == [0]


# --- 9: Sainte-Laguë ------------------------------------------------------------------------------------------------


def test_sainte_lague_against_quotients():
    rng = random.Random(5)
    for _ in range(30):
        votes = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        seats = rng.randint(0, 20)
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)), key=lambda q: q)[:seats]
        want = [sum(1 for _, j in quotients if j == i) for i in range(len(votes))]
        assert apportion.sainte_lague(votes, seats) == want


def test_capped_targets():
    assert apportion.capped_targets([100, 100], [5, 5]) == [100, 100]
    got = apportion.capped_targets([10, 1000, 500], [5, 2, 1])
    assert got[0] == 30 and math.isclose(sum(got), 1510) and math.isclose(got[1], 2 * got[2])
    assert apportion.capped_targets([0, 0], [5, 2]) == [0, 0]


def test_mix(odd_docs, no_docs):
    out = apportion.mix_sources(odd_docs)
    rows = out.toPandas()
    assert len(rows) == odd_docs.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted(rows["size"]) == sorted(len(word.findall(r.text or "")) for r in odd_docs.collect())
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken >= 0).all()
    for _, g in rows.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(30, 0.01 * g.target.iloc[0])
        assert g["size"].sum() == g.source_size.iloc[0]
    again = apportion.mix_sources(odd_docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert rows[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
    assert apportion.mix_sources(no_docs).count() == 0


def test_targets_and_seats_of_many_sources(spark):
    # As Spark aggregates, against the plain versions.
    rng = random.Random(17)
    for trial in range(3):
        words = [rng.choice([0, 1, 5, 40, 900, 20_000, 300_000]) * rng.randint(1, 9) for _ in range(60)]
        weights = [(5, 2, 1)[i % 3] for i in range(len(words))]
        table = spark.createDataFrame([(i, w, float(x)) for i, (w, x) in enumerate(zip(words, weights))], "rank long, words long, weight double")
        got = apportion.source_targets(table, 3.0).orderBy("rank").collect()
        want = apportion.capped_targets(words, weights)
        assert [r.target for r in got] == pytest.approx(want)
        block = max(1, sum(words) // (37, 400, 8192)[trial])
        with_most = apportion.source_targets(table, 3.0).withColumn("most", (3 * table["words"] / block).cast("long"))
        n = round(sum(want) / block)
        seats = [r.seats for r in apportion.source_seats(with_most, n).orderBy("rank").collect()]
        assert seats == apportion.sainte_lague([r.target for r in got], n, [3 * w // block for w in words])
    equal = spark.createDataFrame([(i, 100, 1.0, 100.0, 50) for i in range(7)], "rank long, words long, weight double, target double, most long")
    assert [r.seats for r in apportion.source_seats(equal, 17).orderBy("rank").collect()] == [3, 3, 3, 2, 2, 2, 2]


def test_mix_against_brute_force(spark):
    rng = random.Random(23)
    rows = [(i, " ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(0, 40))), "en", "a" if i % 3 else rng.choice(["b", "c", None])) for i in range(300)]
    rows += [(9, "equal rows of one text", "en", "b")] * 25 + [(None, "no id " * 4, "en", "a")] * 10
    docs = make_docs(spark, rows)
    got = Counter((r.doc_id, r.source, r.size, r.taken) for r in apportion.mix_sources(docs, shards=4, blocks=200, shard_rows=40).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    groups = Counter((i, s, t) for i, t, _, s in rows)
    keyed = spark.createDataFrame([(i, s, t, n) for (i, s, t), n in groups.items()], "id long, source string, text string, n long").selectExpr("*", "xxhash64(id, xxhash64(text), 42) AS mixed", "xxhash64(text) AS tie").selectExpr("*", "xxhash64(mixed, 42) AS deal").collect()
    names = ["a", "b", "c", None]
    words = [sum(size(r.text) * r.n for r in keyed if r.source == s) for s in names]
    target = apportion.capped_targets(words, [5, 2, 1, 5])
    block = max(1, round(sum(words) / 200))
    seats = apportion.sainte_lague(target, round(sum(target) / block), [3 * w // block for w in words])
    want = Counter()
    for k, s in enumerate(names):
        own = [r for r in keyed if r.source == s]
        cells = max(4, -(-sum(size(r.text) > 0 for r in own) // 40))
        by_cell = {}
        for r in own:
            if size(r.text):
                by_cell.setdefault(r.deal % cells, []).append(r)
            else:
                want[r.id, s, 0, 0] += r.n
        quota = apportion.cell_quotas([sum(size(r.text) * r.n for r in by_cell[c]) for c in sorted(by_cell)], target[k], seats[k], block)
        for c, q in zip(sorted(by_cell), quota):
            there = sorted(by_cell[c], key=lambda r: (r.mixed, r.id is not None, r.id or 0, size(r.text), r.tie))
            length = sum(size(r.text) * r.n for r in there)
            picked = [0] * length
            numbers = spark.range((length - 1) // block + 1).selectExpr("id AS b", f"xxhash64({'CAST(NULL AS STRING)' if s is None else repr(s)}, {c}L, id, 43) AS h").collect()
            rest = q % length
            for b in [r.b for r in sorted(numbers, key=lambda r: (r.h, r.b))]:
                for at in range(b * block, min(length, (b + 1) * block)):
                    if rest:
                        picked[at], rest = 1, rest - 1
            at = 0
            for r in there:
                n = size(r.text) * r.n
                taken = q // length * n + sum(picked[at : at + n])
                at += n
                for j in range(r.n):
                    want[r.id, s, size(r.text), taken // r.n + (j < taken % r.n)] += 1
    assert got == want


def test_mix_equal_rows_without_an_id(spark):
    hot = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'five words in every row' AS text", "'hot' AS source")
    some = spark.range(500).selectExpr("id AS doc_id", "concat('other ', repeat('word ', CAST(id % 50 AS INT)), id) AS text", "IF(id % 2 = 0, 'hot', 'cold') AS source")
    rows = apportion.mix_sources(hot.unionByName(some)).toPandas()
    assert len(rows) == 20_500 and (rows.taken <= 3 * rows["size"]).all()
    for _, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    equal = rows[rows.doc_id.isna()]
    assert equal.taken.max() - equal.taken.min() <= 1


# --- 6: SimHash -----------------------------------------------------------------------------------------------------


def test_mix_small_sources(spark):
    # Blocks of some 6,000 words: "b" has far less than a third of one, "c" half of one.
    rows = [(i, "l", "a", "w " * 1000) for i in range(100)] + [(100 + i, "l", "b", "w " * 30) for i in range(10)] + [(200 + i, "l", "c", "w " * 300) for i in range(10)]
    found = apportion.mix_sources(make_docs(spark, [(i, t, lang, s) for i, lang, s, t in rows]), blocks=16).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target["b"] == 900 and target["c"] == 9000
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert all(r["taken"] > 0 for r in found if r["source"] in "bc")


def test_cell_quotas():
    assert apportion.cell_quotas([10, 10, 10], 15.0, 0, 1000) == [5, 5, 5]
    assert apportion.cell_quotas([700, 300], 600.0, 1, 1000) == [420, 180]
    assert sum(apportion.cell_quotas([5, 0, 1], 18.0, 3, 4)) == 18
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice((0, 1, 7, 900)) * rng.randrange(5) for _ in range(9)]
        target, block = rng.random() * 3 * sum(words), rng.choice((1, 10, 500))
        got = apportion.cell_quotas(words, target, round(target / block), block)
        assert sum(got) == min(round(target), 3 * sum(words)) and all(0 <= q <= 3 * w for q, w in zip(got, words, strict=True))


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(odd_docs):
    for r in odd_docs.where("doc_id <> 4").collect():
        assert simhash.simhash(r.text) == brute_simhash(r.text)


def near_fingerprints(n=300, seed=2):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)] + [0, 1, 3, 7, 2**64 - 1]
    for _ in range(n):
        fp = rng.choice(fps)
        for k in rng.sample(range(64), rng.randint(1, 4)):
            fp ^= 1 << k
        fps.append(fp)
    return fps


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in names}


@pytest.mark.parametrize("small", [0, 1 << 14])
def test_simhash_links(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    fps = near_fingerprints()
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    plain = lambda s: int(np.int64(s).view(np.uint64))
    want = brute_components(fps, 2)
    assert all(want[plain(a)] == want[plain(b)] for a, b in links)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = {}
    for f in want:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[f], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_groups(odd_docs, no_docs):
    rows = simhash.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    at = {r.doc_id: r.component for r in rows}
    assert at[1] == at[2] == at[3] == 1  # no words: fingerprint zero
    assert {at[100 + i] for i in range(40)} == {100}
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 100 in ids and 101 not in ids and ids.count(5) == 1


def test_simhash_full_tile_and_equal_rows(spark, monkeypatch):
    # One tile in many pieces (all fingerprints have the same population counts), against all pairs; a third of all rows
    # equal and without an id.
    rng = random.Random(12)
    half = [i for i in range(16)]

    def quarter():
        rng.shuffle(half)
        return sum(1 << b for b in half[:8])

    fps = [quarter() << 48 | quarter() << 32 | quarter() << 16 | quarter() for _ in range(300)]
    for x in fps[:60]:  # one bit goes and another comes: the same counts, two bits apart
        on, off = [b for b in range(16) if x >> b & 1], [b for b in range(16) if not x >> b & 1]
        fps.append(x ^ (1 << rng.choice(on)) ^ (1 << rng.choice(off)))
    monkeypatch.setattr(simhash, "TILE", 16)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
        parent[root(r.a)] = root(r.b)
    want = brute_components(fps, 2)
    groups = {}
    for x, y in zip(fps, signed, strict=True):
        groups.setdefault(root(y), set()).add(want[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    hot = spark.range(12_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'equal rows of one text and no id' AS text")
    some = spark.range(300).selectExpr("id AS doc_id", "IF(id % 100 = 7, 'equal rows of one text and no id', concat('other text number ', id, ' of ', id * 7)) AS text")
    out = simhash.simhash_groups(hot.unionByName(some)).toPandas()
    assert len(out) == 12_300 and (out[out.doc_id.isna()]["component"] == 7).all() and (out[out.doc_id.isin([7, 107, 207])]["component"] == 7).all()


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(-5, -5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and -5 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7: I-Match -----------------------------------------------------------------------------------------------------


def test_imatch(odd_docs, no_docs, spark):
    rows = imatch.imatch(odd_docs, rows_per_range=10).collect()
    docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert len(rows) == len(docs)
    by_text = {}
    got = {(r.doc_id, r.edited_sha256): r for r in rows}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    for i, (ident, text) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(text) // 2
        sha = hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        r = got[ident, sha]
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(text, set()).add(r.fingerprint)
        if text == after:
            assert r.near_next == 1
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.imatch(no_docs).count() == 0
    one = imatch.imatch(make_docs(spark, [(1, "abcd", "en", "a")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def brute_imatch(docs, low, high):
    """Of (id, text) in descending order: the fingerprints, those of the edited texts, and the likenesses, by plain loops."""
    from stratalake.llm.words import hashed_words

    whole, mask = 2**64, 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    terms = lambda t: {int(h) for h in hashed_words([t.encode()])[0]}
    df = Counter(h for _, t in docs for h in terms(t))
    kept = {h for h, n in df.items() if low * len(docs) <= n <= high * len(docs)}
    seeds = [mix(k * 0x9E3779B97F4A7C15 % whole) for k in range(1, 64)]

    def signature(text):
        own = terms(text) & kept or terms(text)
        if not own:
            h = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
            return [mix(h) % (2**32 - 1) + 1] * imatch.SUBSETS
        out, number, used = [], 0, 0
        for k in range(imatch.SUBSETS):
            bits = k % imatch.LEVELS + 1
            number, used = (number + 1, 0) if used + bits > 64 else (number, used)
            mine = [h for h in sorted(own) if not mix(h ^ seeds[number]) >> used & (1 << bits) - 1]
            total = sum(mix(h) * pow(0x9E3779B97F4A7C15, i, whole) for i, h in enumerate(mine)) & mask
            out.append(mix(total) % (2**32 - 1) + 1 if mine else 0)
            used += bits
        return out

    def alike(a, b):
        either = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else float(a == b)

    rows = []
    text = lambda s: "".join(f"{x:08x}" for x in s)
    for i, (ident, t) in enumerate(docs):
        after, cut = docs[(i + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = signature(t), signature(edited), signature(after)
        rows.append((ident, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return rows


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_imatch_against_brute_force(spark, rows_per_range):
    rng = random.Random(21)
    vocabulary = [f"term{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, ""), (7, texts[0]), (61, "!!! ..."), (62, texts[5])] + [(None, texts[1])] * 9 + [(None, t) for t in texts[10:16]]
    signed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed[r[1]]), reverse=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: str(r)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.imatch(docs, low=0.05, high=0.5, rows_per_range=rows_per_range).collect()), key=key)
    assert got == sorted(brute_imatch(order, 0.05, 0.5), key=key)
    as_strings = imatch.imatch(docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), rows_per_range=rows_per_range)
    assert as_strings.count() == len(rows) and dict(as_strings.dtypes)["doc_id"] == "string"


def test_signatures_of_many_terms(monkeypatch):
    words = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = imatch.signatures(words, b"", np.sort(words[::2]))
    monkeypatch.setattr(imatch, "TERMS", 100)
    assert (imatch.signatures(words, b"", np.sort(words[::2])) == whole).all() and (whole > 0).mean() > 0.9


def test_imatch_many_rows_without_an_id(spark):
    hot = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "IF(id % 2 = 0, 'equal rows', concat('other ', id)) AS text")
    laid = imatch._in_ranges(hot, "doc_id", "text", 1000)
    sizes = [r["count"] for r in laid.where("NOT border").groupBy("rng").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 4000 and sum(sizes) == 20_000
    assert laid.where("border").count() == len(sizes)


def test_imatch_frequencies(odd_docs):
    from stratalake.llm.words import hashed_words

    want = {}
    for r in odd_docs.collect():
        for h in set(hashed_words([(r.text or "").encode()])[0].tolist()):
            want[h] = want.get(h, 0) + 1
    got = {int(np.int64(r.term).view(np.uint64)): r.df for r in imatch.document_frequencies(odd_docs).collect()}
    assert got == want


def test_hashed_words_bounds():
    from stratalake.llm.words import hashed_words

    texts = [b"", b"One two", b"--", b"two one", "é1".encode()]
    h, at = hashed_words(texts)
    assert [b - a for a, b in zip(at[:-1], at[1:], strict=True)] == [0, 2, 0, 2, 1]
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


# --- 8: suffix arrays -----------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, window=13):
    words = lambda t: WORD.findall((t or "").encode().lower())
    wins = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for ident, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    names |= found
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(n for n in names if n is not None)).encode()).hexdigest()
        out.append((ident, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_suffixes(odd_docs, no_docs, spark):
    rng = random.Random(9)
    long_text = [r.text for r in odd_docs.where("doc_id = 4").collect()][0].split()
    items = [("1", " ".join(long_text[100:140])), ("2", "copied text of a"), ("3", None), ("4", ""), ("5", "one"), ("2", "hot Group"), ("10", " ".join(long_text[110:124])), ("6", "漢字"), ("7", " ".join(rng.choice(long_text) for _ in range(20)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(brute_contamination([(r.doc_id, r.text) for r in odd_docs.collect()], items), key=str)
    for options in ({}, {"block_bytes": 60}, {"shard_words": 50}):
        found = suffixes.judged(suffixes.verbatim_matches(odd_docs, bench, **options))
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)
        assert got == want
    assert suffixes.judged(suffixes.verbatim_matches(no_docs, bench)).count() == 0
    none = suffixes.judged(suffixes.verbatim_matches(odd_docs, bench.where("false")))
    assert none.where("n_hit > 0 OR contaminated").count() == 0
    kept = suffixes.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not w[5] for w in want)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for vocabulary, n_docs, longest_doc in ((2, 12, 40), (5, 30, 60), (400, 20, 50)):
        docs = [rng.integers(10, 10 + vocabulary, rng.integers(0, longest_doc)).astype(np.uint64) for _ in range(n_docs)]
        docs += [docs[0], docs[1], docs[1]]  # copies
        lengths = np.array([len(d) for d in docs])
        got = suffixes.SuffixArray(np.concatenate(docs), lengths)
        rest = lambda at: tuple(got.tokens[at : got.first[np.searchsorted(got.first, at, side="right")] - 1].tolist())
        order = [rest(int(p)) for p in got.places]
        assert order == sorted(order) and len(order) == lengths.sum()
        # Longest matches of all suffixes of an item, against trying every place.
        item = np.concatenate([docs[3], docs[4]])
        tests = suffixes.TestSuffixes([], 3)
        tests.words, tests.at, tests.size = item, np.arange(max(0, len(item) - 2)), np.full(max(0, len(item) - 2), 3)
        tests.left, tests.window = len(item) - tests.at, np.arange(len(tests.at))
        _, _, lengths_found, places = tests.search(got)
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        numbers = {int(w): i + 1 for i, w in enumerate(got.vocabulary)}
        as_numbers = [numbers.get(int(w), -1) for w in item]
        for t, at in enumerate(tests.at):
            best = max((common(as_numbers[at:], rest(int(p))) for p in got.places), default=0)
            assert lengths_found[t] == (best if best >= 3 else 0)
            assert best < 3 or common(as_numbers[at:], rest(int(places[t]))) == best


def test_suffixes_hot_windows_and_nameless_items(spark):
    # Many one-word items, a window of every document, and ids that are null beside one that is called "null".
    hot = "the same passage of more than thirteen words stands in every one of these documents here"
    docs = make_docs(spark, [(i, f"word{i} {hot} tail{i % 7} the the", "en", "a") for i in range(400)] + [(None, "the " * 50, "en", "a")] * 3)
    items = [(f"i{k}", f"word{k}") for k in range(500)] + [(f"h{k}", hot) for k in range(50)] + [(None, "the the"), (None, "tail3"), ("null", "tail4"), ("null", "the the")]
    found = suffixes.verbatim_matches(docs, spark.createDataFrame(items, "item_id string, text string"), shard_words=2000)
    rows = suffixes.judged(found).collect()
    for r in rows:
        text = f"word{r.doc_id} {hot} tail{(r.doc_id or 0) % 7} the the" if r.doc_id is not None else "the " * 50
        [want] = brute_contamination([(r.doc_id, text)], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[1:]
        assert len(r.matches) <= r.n_items and len(r["items"]) == r.n_items
    # A shard tells each suffix's longest match once.
    assert sum(m.item_id == "h0" for r in rows for m in r.matches) <= sum(r.n_words for r in rows) // 2000 + 4


def test_longest_match_and_location(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "pre pre " + " ".join(f"w{i}" for i in range(5, 25)) + " post"
    [row] = suffixes.verbatim_matches(make_docs(spark, [(1, doc, "en", "a")]), spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert [tuple(m) for m in row.matches] == [("i", 2, 5, 20)]


# --- 3: WARC --------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rng = random.Random(4)
    html = lambda i: f"<html><body>page {i} " + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(200)) + "</body></html>"
    rows = [(i, f"http://h/{i}", html(i)) for i in range(80)] + [(200 + i, "http://hot/", "<p>hot</p>") for i in range(50)]
    rows += [(300, None, None), (301, "http://e/\r\nX: 1 %0D", ""), (None, "http://n/", "<p>hot</p>"), (302, "http://u/é", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    files = warc.write_archives(pages, path, archive_bytes=2000)
    records = warc.read_archives(files, path).collect()
    assert len(records) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    left = {(i, u): h for i, u, h in rows}
    for r in records:
        payload = (left[r.page_id, r.url] or "").encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = top[payload.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert bytes(r.body) == (payload if r.record_type == "response" else b"")
    assert warc.read_archives(warc.write_archives(pages.where("false"), path + "-none"), path + "-none").count() == 0


def test_warc_headers_and_digests(spark):
    # Repeated rows, null page_ids and a lost attempt's file; digests come from the bodies.
    rows = [(1, "http://a/", "<p>a</p>")] * 3 + [(None, "http://b/", "<p>b</p>")] * 2 + [(2, "http://c/", "<p>c</p>"), (3, "http://c/", "<p>c</p>"), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-ids")
    files = warc.write_archives(pages, path, date="2024-01-02T03:04:05Z")
    stray = f"{path.removeprefix('file://')}/part-000000-00000-lost.warc.zst"
    with open(stray, "wb") as f:
        f.write(b"half an archive")
    records = warc.read_archives(files, path).collect()
    assert len(records) == len(rows) and len({r.record_id for r in records}) == len(rows) and {r.date for r in records} == {"2024-01-02T03:04:05Z"}
    by_type = Counter((r.page_id, r.record_type, r.refers_to) for r in records)
    assert by_type == {(1, "response", None): 3, (None, "response", None): 2, (3, "response", None): 1, (2, "revisit", 3): 1, (4, "response", None): 1}
    assert [r.record_id for r in records if r.page_id == 3] == ["urn:page:3"]
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    got = Counter(tuple(r) for r in warc.archive_digest(pages).collect())
    assert got == {(1, 8, sha("<p>a</p>"), "response", None): 3, (None, 8, sha("<p>b</p>"), "response", None): 2, (3, 8, sha("<p>c</p>"), "response", None): 1, (2, 8, sha("<p>c</p>"), "revisit", 3): 1, (4, 0, sha(""), "response", None): 1}
    good = warc.record_bytes(7, "http://x/", b"body", None)
    for bad in (good.replace(b"body", b"bodY"), good.replace(b"Length: 4", b"Length: 3"), good[:-6]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_warc_is_standard_zstd():
    records = [warc.record_bytes(i, f"http://x/{i}", b"<html>" + b"body text %d " % i * 20, None) for i in range(200)]
    d = warc.train_dictionary(records, 4096)
    assert d
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    content = warc.dictionary_frame(d) + b"".join(pack.compress(r) for r in records)
    assert list(warc.read_archive(content)) == records
    assert sum(map(len, map(pack.compress, records))) < sum(len(zstandard.compress(r)) for r in records)
    assert warc.train_dictionary([b"x"]) == b""


# --- 4: Kneser-Ney --------------------------------------------------------------------------------------------------


def test_kneser_ney_probabilities_sum_to_one():
    texts = {"a": ["the cat sat on the mat", "a cat and the hat"], "b": ["le chat est là", "un chat et le rat"]}
    counts = {}
    for lang, own in texts.items():
        chars, bounds, _ = kneser_ney.characters(own)
        counts[lang] = np.unique(kneser_ney.grams(chars)[kneser_ney._scored(bounds, len(chars))], return_counts=True)
    m = kneser_ney.CharModels(counts)
    letters = m.keys[0]
    for context in ("   ", " ca", "the", "xyz"):
        c = sum(np.uint64(ord(x)) << np.uint64(16 * (3 - i)) for i, x in enumerate(context))
        total = m.probabilities(c | letters, 3).sum(axis=0)
        assert (total <= 1 + 1e-5).all() and (total > 0.9).all()


def test_kneser_ney_against_plain_counts():
    text = "abcabdabcabcabe"
    chars, bounds, _ = kneser_ney.characters([text])
    keys, n = np.unique(kneser_ney.grams(chars)[kneser_ney._scored(bounds, len(chars))], return_counts=True)
    m = kneser_ney.CharModels({"x": (keys, n)})
    padded = "   " + text
    four = {}
    for i in range(3, len(padded)):
        four[padded[i - 3 : i + 1]] = four.get(padded[i - 3 : i + 1], 0) + 1
    tables = [four]
    for k in (3, 2, 1):
        new = {}
        for g in tables[-1]:
            new[g[1:]] = new.get(g[1:], 0) + 1
        tables.append(new)
    tables = tables[::-1]

    def p(gram, order):
        if order == 0:
            return 1 / (len({g for g in tables[0]}) + 1)
        table = tables[order - 1]
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:], order - 1)
        return max(table.get(gram, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p(gram[1:], order - 1)

    for gram in ["abca", "cabd", "zzza", "bcab", "abzz", "   a"]:
        key = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(gram))], dtype=np.uint64)
        assert m.probabilities(key, 3)[0, 0] == pytest.approx(p(gram, 4), rel=1e-4)


def test_language_held_out(spark, sf_dir):
    from stratalake.llm.queries import op4_kneser_ney_language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = op4_kneser_ney_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.95 and r.score.between(0, 1).all()


def plain_models(texts):
    """For each language a function: log2 p(character | three before it), from plain counts of its training texts."""
    tables = {}
    for lang, own in texts.items():
        four = Counter(g for t in own for g in plain_grams(t))
        levels = [four]
        for _ in range(3):
            levels.append(Counter(g[1:] for g in levels[-1]))
        tables[lang] = levels[::-1]
    letters = len({g for t in tables.values() for g in t[0]}) + 1

    def model(levels):
        sums = [{} for _ in levels]
        for k, table in enumerate(levels):
            for g, c in table.items():
                n, kinds = sums[k].get(g[:-1], (0, 0))
                sums[k][g[:-1]] = n + c, kinds + 1

        def p(gram, order):
            if order == 0:
                return 1 / letters
            table = levels[order - 1]
            ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            n, kinds = sums[order - 1].get(gram[:-1], (0, 0))
            below = p(gram[1:], order - 1)
            return max(table.get(gram, 0) - d, 0) / n + d * kinds / n * below if n else below

        return lambda gram: math.log2(p(gram, 4))

    return {lang: model(t) for lang, t in tables.items()}


def plain_grams(text):
    padded = "   " + re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text)).lstrip(" ")
    return [padded[i - 3 : i + 1] for i in range(3, len(padded))]


def test_language_against_brute_force(spark):
    rng = random.Random(31)
    syllables = {"aa": ["ba", "na", "la", "ra"], "bb": ["kri", "tso", "la", "mu"], "cc": ["ra", "mu", "zem", "no"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(lang := rng.choice("abc") * 2, rng.randint(3, 25)), lang, "s") for i in range(200)] + [(None, prose("aa", 9), "aa", "s"), (None, prose("bb", 9), "bb", "s")]
    docs = make_docs(spark, rows + [(900, "xqj wvx xqj wvx", None, "s"), (901, "la mu 12", None, "s"), (902, "123 !", "aa", "s")])
    known = docs.where("lang IS NOT NULL").selectExpr("text", "lang", "pmod(xxhash64(doc_id, text, 7), 1048576) AS h").collect()
    part = min(0.1, 2000 / len(known)) * (1 << 20)
    models = plain_models({x: [r.text for r in known if r.lang == x and r.h >= part] for x in ("aa", "bb", "cc")})
    langs = sorted(models)

    def judged(text):
        grams = plain_grams(text)
        bits = sorted((-sum(models[x](g) for g in grams) / len(grams), x) for x in langs)
        return bits[0][1], bits[0][0], (bits[1][0] - bits[0][0]) * math.sqrt(len(grams))

    seen = [(r.lang, *judged(r.text)) for r in known if r.h < part and any(c.isalpha() for c in r.text)]
    assert len(seen) > 8
    a, b = kneser_ney._platt(np.array([x[3] for x in seen]), np.array([float(x[0] == x[1]) for x in seen]))
    limit = {x: np.quantile([s[2] for s in seen if s[0] == s[1] == x], 0.998) * 1.05 if any(s[0] == s[1] == x for s in seen) else math.inf for x in langs}
    for r in kneser_ney.identify(docs, docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.bits, r.rejected) == ("und", 0.0, None, True)
            continue
        pred, bits, lead = judged(r.text)
        assert r.lang_pred == pred and r.bits == pytest.approx(bits, rel=1e-3)
        score = 1 / (1 + math.exp(-(a * lead + b)))
        assert r.score == pytest.approx(score, abs=5e-3)
        if abs(bits / limit[pred] - 1) > 1e-3 and abs(score - 0.5) > 1e-2:
            assert r.rejected == (score < 0.5 or bits > limit[pred])


def test_language_counts_are_passed_on(odd_docs):
    want = sorted(map(tuple, kneser_ney.gram_counts(odd_docs, "text", "lang").collect()))
    assert sorted(map(tuple, kneser_ney.gram_counts(odd_docs, "text", "lang", task_entries=5).collect())) == want


def test_language_odd_cases(odd_docs, no_docs):
    rows = {r.doc_id: r for r in kneser_ney.identify(odd_docs, odd_docs).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert all(rows[i].lang_pred in ("en", "de", "fr") for i in (4, 5, 6, 100))
    assert kneser_ney.identify(no_docs, odd_docs).count() == 0
    assert {r.lang_pred for r in kneser_ney.identify(odd_docs, no_docs).collect()} == {"und"}


def test_language_blocks(spark, odd_docs):
    # A language of two short texts beside a hot one, and models in many blocks: nothing is left out, all agree with one block.
    rng = random.Random(4)
    hot = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(60)]
    rows = [(i, t, "hot", "a") for i, t in enumerate(hot)] + [(100, "qu\u00ed zo wyx vuz", "rare", "a"), (101, "zo vuz qu\u00ed", "rare", "b"), (102, None, "rare", "b"), (None, "wyx zo", "rare", "b")]
    for docs in (make_docs(spark, rows), odd_docs):
        order = lambda r: (r.doc_id is None, r.doc_id or 0, r.bits or 0)
        one, many = (sorted(kneser_ney.identify(docs, docs, block_entries=n).collect(), key=order) for n in (10**9, 300))
        assert len(one) == len(many) == docs.count()
        for x, y in zip(one, many, strict=True):
            assert (x.doc_id, x.lang_pred, x.rejected) == (y.doc_id, y.lang_pred, y.rejected)
            assert y.bits == (None if x.bits is None else pytest.approx(x.bits, rel=1e-9)) and y.score == pytest.approx(x.score, abs=1e-6)
    docs = make_docs(spark, rows)
    n, blocks = kneser_ney.learn_blocks(docs, block_entries=300)
    entries = kneser_ney.gram_counts(docs, "text", "lang").select("gram").distinct().count()
    assert n > 5 and sum(len(m.keys[3]) for _, _, m in blocks) == entries
    assert {r.lang_pred for r in kneser_ney.identify(docs, docs, block_entries=300).where("doc_id IN (100, 101)").collect()} == {"rare"}


# --- 5: toxicity ----------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(8)
    terms = ["idiot", "trash", "scum", "clown", "worthless", "idiom"]
    lexicon = toxicity.Lexicon([(t, False, 3.0) for t in sorted(terms)])
    words = set(terms) | {"".join(rng.choice("idotrashclwnmu") for _ in range(rng.randint(1, 8))) for _ in range(400)}
    for t in terms:
        for _ in range(60):
            w, k = list(t), rng.randint(0, 2)
            for _ in range(k):
                i = rng.randrange(len(w) + 1)
                kind = rng.choice("ids")
                if kind == "i":
                    w.insert(i, rng.choice("abcxyz"))
                elif w and i < len(w):
                    if kind == "d":
                        del w[i]
                    else:
                        w[i] = rng.choice("abcxyz")
            words.add("".join(w) or "q")
    words = sorted(words)
    folded, starts, ends, _, _ = toxicity.split_words([" ".join(words)])
    found, got, edits = lexicon.find(folded, starts, ends)
    for i, w in enumerate(words):
        near = min(distance(w, t) for t in terms if len(t) >= toxicity.FUZZY_LENGTH)
        want = w in terms or near <= 1
        assert (i in set(found.tolist())) == want, w
    exact = {words[i]: e for i, e in zip(found.tolist(), edits.tolist(), strict=True)}
    assert all(exact[t] == 0 for t in terms)
    assert [lexicon.terms[k][0] for i, k in zip(found, got, strict=True) if words[i] in terms] == [w for w in words if w in terms]


def test_stems_match_openings_only():
    lexicon = toxicity.Lexicon([("achli", True, 3.0)])
    folded, starts, ends, _, _ = toxicity.split_words(["achlich achli ach machlich achlx"])
    assert lexicon.find(folded, starts, ends)[0].tolist() == [0, 1]


def test_misspelled_long_stems():
    lexicon = toxicity.Lexicon([("worthle", True, 3.0), ("𝒶bcd𝓔", False, 2.0)])
    folded, starts, ends, _, _ = toxicity.split_words(["worthless wurthless worhless worthhless wrthles wurhless 𝒶bcd𝓔 𝒶bc𝓔"])
    found, _, edits = lexicon.find(folded, starts, ends)
    assert found.tolist() == [0, 1, 2, 3, 4, 6, 7] and edits.tolist() == [0, 1, 1, 1, 1, 0, 1]


def test_automaton_forgets_states(monkeypatch):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(300)})
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 10))) for _ in range(2000))
    lexicon = toxicity.Lexicon([(t, False, 1.0) for t in terms])
    first = [x.tolist() for x in lexicon.find(*toxicity.split_words([text])[:3])]
    monkeypatch.setattr(toxicity, "STATES", 10)
    assert [x.tolist() for x in lexicon.find(*toxicity.split_words([text])[:3])] == first
    plain = [i for i, w in enumerate(text.split()) if any(w == t or len(t) >= toxicity.FUZZY_LENGTH and abs(len(w) - len(t)) < 2 and distance(w, t) <= 1 for t in terms)]
    assert first[0] == plain


def test_quotation_marks():
    t = 'He said "idiot" then. You idiot! "Well," she said'
    a, b = t.index("idiot"), t.rindex("idiot")
    assert toxicity.quoted(t, a, a + 5) and not toxicity.quoted(t, b, b + 5)
    for t, want in (("“an idiot”", True), ("„du idiot“", True), ("« idiot »", True), ("»a« idiot »b«", False), ("«idiot»", True), ("> you idiot", True), ("a “b” idiot “c”", False), ("“idiot", False), ("idiot”", False)):
        assert toxicity.quoted(t, t.index("idiot"), t.index("idiot") + 5) == want, t


def test_a_quotation_closes_anywhere_in_its_line():
    far = 'He said "idiot ' + "and so on " * 60 + '" at last'
    assert toxicity.quoted(far, 9, 14) and not toxicity.quoted(far.replace(" and", "\nand", 1), 9, 14)


def test_terms_of_any_length(spark):
    rng = random.Random(8)
    filler = [f"filler{i}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    long = "verbosely" * 6
    odd = ["x", "坏人", long]
    rows = [(i, f"{prose(20)} {odd[i // 3 % 3]} {prose(20)}" if i % 3 == 0 else prose(40), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(make_docs(spark, rows), labels)
    assert all(s > 0.7 for s in model.scores([f"{prose(20)} {w} {prose(20)}" for w in [*odd, long[:-1]]]))
    assert all(s < 0.7 for s in model.scores([prose(40), "y " + prose(40), None, ""]))


def test_context_tells_quotation_from_abuse(spark):
    # A term that stands in toxic and in clean documents alike; the words around it tell them apart.
    rng = random.Random(6)
    filler = [f"filler{i}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{prose(20)} surely moronic pest {prose(20)}" if i % 3 == 0 else f"{prose(20)} reporter mentioned moronic {prose(20)}" if i % 12 == 1 else prose(40), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(make_docs(spark, rows), labels)
    assert model.context.get("mentioned", 0) < 0
    abuse, report = model.scores([f"{prose(10)} surely moronic pest {prose(10)}", f"{prose(10)} reporter mentioned moronic {prose(10)}"])
    assert abuse > 0.7 > report


def test_toxicity_held_out(spark):
    from stratalake.llm.queries import op5_levenshtein_toxicity

    sf = "/root/testdata/sf0.01"
    r = op5_levenshtein_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert r.score.between(0, 1).all()
    held = r[r.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.03 and held[held.toxic == 1].predicted.mean() > 0.6


def test_toxicity_odd_cases(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (200, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    untaught = toxicity.learn(no_docs, labels)
    assert all(r.score < 0.7 for r in toxicity.score(odd_docs, untaught).collect())


# --- 10: URLs -------------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1?q=x://y", "x://b/c://d/e#f", "http://example.org/es/", "http://notexample.org/es/", "http://org", "ftp://org?x", "http://a.com/de/9", "u://" + "long/" * 5000, "http://com/fr/\n#"]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(odd, 10_000)), "page_id long, url string"))
    from pyspark.sql import functions as F

    pages = pages.withColumn("host", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("suffix", F.lit("x"))
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, trees=3).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    assert rows.keys() == urls.keys()
    for k, r in rows.items():
        assert (r.host, r.path) == brute_url(urls[k])
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.block_chance >= 0.5 else "allow"))


def test_url_statistics_over_all_rows(spark):
    # 400 suffixes and 2,400 labelled URLs, one of them copied, of which 100 train the trees: the others' suffixes count.
    rng = random.Random(6)
    hosts = [(f"s{n}.com", n % 2) for n in rng.sample(range(10_000, 99_999), 400)]
    urls = [f"http://{h}/{'de' if block else 'fr'}/{rng.randrange(100, 999)}{k}" for h, block in hosts for k in range(6)]
    urls += [urls[0]] * 3000
    open_urls = [f"http://{h}/xx/{rng.randrange(1000, 9999)}" for h, _ in hosts]
    pages = spark.createDataFrame(list(enumerate(urls + open_urls)), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages, training_rows=100, trees=5).collect()}
    assert len(found) == len(urls) + len(open_urls)
    right = [found[len(urls) + i].verdict == ("block" if block else "allow") for i, (_, block) in enumerate(hosts)]
    assert sum(right) > 0.95 * len(right)
    base = pages.withColumn("host", url_filter.host_of(pages["url"])).withColumn("path", url_filter.path_of(pages["url"]))
    own = url_filter.labelled_urls(base.withColumn("by_rule", url_filter.rule_of(base["host"], base["path"])[1]))
    assert own.count() == 2400 and own.where("n = 3001").count() == 1
    assert 50 < url_filter.drawn_urls(own, 2400, 100).count() <= 100


def test_url_features_against_plain_python(spark):
    urls = [None, "", "http://a-b.example.co.uk/x/y.html?k=1&l=2#f", "https://ä.com/12/34", "no scheme 77", "http://h/?&&a", "http://x.org/" + "deep/" * 300]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    base = pages.withColumn("host", url_filter.host_of(pages["url"])).withColumn("path", url_filter.path_of(pages["url"]))
    for r in url_filter.lexical(base).collect():
        u, (host, path) = r.url or "", brute_url(r.url)
        counts = Counter(u)
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        want = {
            "length": len(u), "host_length": len(host), "path_length": len(path), "depth": sum(p != "" for p in path.split("/")), "labels": len(host.split(".")), "digit_ratio": sum(c in "0123456789" for c in u) / max(1, len(u)),
            "entropy": -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values()), "params": sum(p != "" for p in query.split("&")), "query_length": len(query), "hyphens": host.count("-"), "has_extension": bool(re.search(r"\.[A-Za-z0-9]{1,5}$", path)),
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(float(value), abs=1e-9), (u, name)
        assert r.tld == host.split(".")[-1] and r.suffix == ".".join(host.split(".")[-2:])


def test_url_rules_of_equal_length(spark):
    from pyspark.sql import functions as F

    name, verdict = url_filter.rule_of(F.col("host"), F.col("path"), (("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "org", "/")))
    got = spark.createDataFrame([("a.org", "/xy"), ("b.org", "/x")], "host string, path string").select(name.alias("n"), verdict.alias("v")).collect()
    assert [tuple(r) for r in got] == [("a.org/x", "allow"), ("org/", "block")]


def test_url_training_rows_are_not_told_their_labels(spark):
    # Suffixes of one URL each tell nothing; a suffix of several tells what its other URLs are.
    urls = [(f"http://only{i}.com/{'de' if i % 2 else 'fr'}/", 1) for i in range(40)] + [("http://both.com/de/1", 3), ("http://both.com/de/2", 2), ("http://both.com/fr/3", 1)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(u for u, n in urls for _ in range(n))], "page_id long, url string")
    own = url_filter.labelled_urls(url_filter._ruled(pages, url_filter.RULES, "page_id", "url"))
    trees = url_filter.learn_trees(own, trees=2)
    rows = {r.url: r for r in trees.featured(own, own=True).withColumn("fold", url_filter.fold(own["url"])).collect()}
    rate = 25 / 46
    assert {round(rows[u].suffix_rate, 9) for u, n in urls[:40]} == {round(rate, 9)} and {rows[u].suffix_count for u, n in urls[:40]} == {0.0}
    for u, _ in urls[40:]:
        others = [(n, "/de/" in o) for o, n in urls[40:] if rows[o].fold != rows[u].fold]
        seen, blocked = 1.25 * sum(n for n, _ in others), 1.25 * sum(n for n, b in others if b)
        assert rows[u].suffix_rate == pytest.approx((blocked + 5 * rate) / (seen + 5)) and rows[u].suffix_count == pytest.approx(math.log1p(seen))


def test_url_trees_on_held_out_urls(spark):
    right, plain, n = url_filter.held_out_accuracy(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert n > 200 and right > plain, (right, plain, n)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(pages).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://x.net")], "page_id long, url string")).collect()} == {"block"}
    assert url_filter.judge_urls(pages.where("false")).count() == 0


# --- 1: quotations --------------------------------------------------------------------------------------------------


def test_parse_message():
    own, passages = quotations.parse_message("hi\nOn Monday X wrote:\n> a\n> b\n> > deep\n>> deeper\nmy answer")
    assert own == "hi\nmy answer" and passages == [(1, "a\nb"), (2, "deep\ndeeper")]
    assert quotations.parse_message(None) == ("", [])
    assert quotations.unit_hash("  Hello,   World! ") == quotations.unit_hash("hello, world") and quotations.unit_hash(" .. ") is None


def test_reply_order(spark):
    m = [
        (1, 0, "u", "First thing here.\n\nSecond para"), (1, 1, "a", "> first thing here\nyes"), (1, 2, "u", "another topic"), (1, 3, "a", "> > First thing here.\n> yes\nthanks"),
        (1, 4, "a", "> another topic\nok"), (2, 0, "u", "> another topic\nwhat?"), (2, 1, "u", None), (None, 5, "u", "x"), (3, None, "u", ""), (1, 4, "b", "twin"),
    ]
    from pyspark.sql import functions as F

    conv = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("rank", F.lit(1))
    rows = quotations.reply_ordered(conv).collect()
    assert len(rows) == len(m)
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.reply_pos)
    assert [r.reply_pos for r in one] == list(range(6))
    assert [r.turn for r in one][:3] == [0, 1, 3] and one[2].depth == 2 and one[2].reply_to == 1
    assert all(">" not in r.own_text for r in rows)
    [cross] = [r for r in rows if r.conv_id == 2 and r.turn == 0]
    assert cross.n_linked == 1 and cross.reply_to is None and cross.own_text == "what?"
    assert quotations.reply_ordered(conv.where("false")).count() == 0


def brute_links(messages):
    """Of (conv, turn, role, text): by message the number of linked passages and the turn that it replies to."""
    parsed = [(c, t, *quotations.parse_message(x)) for c, t, _, x in messages]
    first = {}
    for c, t, own, _ in parsed:
        for h in quotations.units(own) if t is not None else ():
            first.setdefault(h, {}).setdefault(c, t)
            first[h][c] = min(first[h][c], t)
    quotes = {}
    for c, t, _, passages in parsed:
        for i, (level, text) in enumerate(passages):
            quotes.setdefault((c, t, i, level), set()).update(quotations.units(text).items())
    null_last = lambda c: (c is None, c or 0)
    links = {}
    for (c, t, i, level), found in quotes.items():
        words = {}
        for h, n in found if t is not None else ():
            at = first.get(h, {})
            if c in at and at[c] < t:
                where = (0, null_last(c), at[c], c)
            elif others := sorted((x for x in at if x != c), key=null_last):
                where = (1, null_last(others[0]), at[others[0]], others[0])
            else:
                continue
            words[where] = words.get(where, 0) + n
        if words:
            best = min(words, key=lambda w: (w[0], -words[w], w[1], w[2]))
            links.setdefault((c, t), []).append((level, i, best[3], best[2]))
    return {m: (len(own), next((turn for _, _, c, turn in sorted(own, key=lambda x: x[:2]) if c == m[0]), None)) for m, own in links.items()}


def test_links_against_brute_force(spark):
    rng = random.Random(14)
    sentences = [f"This is sentence number {i} about topic {i % 5}." for i in range(30)]
    messages, said = [], {}
    for k in range(250):
        conv, turn = rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]) if k % 9 == 0 else k // 4 % 14
        old = rng.choice(said[conv] if said.get(conv) and rng.random() < 0.6 else [x for v in said.values() for x in v] or ["ok"])
        own = rng.choice(["ok", "thanks", "\n\n".join(" ".join(rng.sample(sentences, 2)) for _ in range(3))])
        parts = re.split(r"\n\n", old)
        quote = rng.choice([old, parts[0], "\n\n".join(parts[:2]), old.replace(" ", "\n", 3), re.split(r"(?<=[.]) ", parts[-1])[0], "never said by anybody", "ok"])
        level = rng.choice(["> ", "> > "])
        text = rng.choice([own, "\n".join(level + line for line in quote.split("\n")) + "\n" + own, own + "\n> " + quote.replace("\n", "\n> "), None, ""])
        messages.append((conv, turn, "u", text))
        said.setdefault(conv, []).append(own)
    # A line that the quoting conversation says later, and another one earlier.
    messages += [(50, 1, "u", "> rare words that are said twice\nhm"), (50, 2, "u", "rare words that are said twice"), (70, 0, "u", "rare words that are said twice")]
    # Two of three paragraphs, wrapped anew.
    messages += [(60, 0, "u", "The first paragraph is\nlong enough.\n\nA second one here\nfollows it.\n\nAnd a third."), (60, 1, "u", "between"), (60, 2, "u", "> The first paragraph is long\n> enough.\n>\n> A second one\n> here follows it.\nso"), (60, 3, "u", "> here\nlonger > not a quote")]
    schema = "conv_id long, turn long, role string, text string"
    rows = quotations.reply_ordered(spark.createDataFrame(messages, schema)).collect()
    want = brute_links(messages)
    assert len(rows) == len(messages) and sum(n for n, _ in want.values()) > 40
    for r in rows:
        assert (r.n_linked, r.reply_to) == want.get((r.conv_id, r.turn), (0, None)), r
    assert want[50, 1] == (1, None) and want[60, 2] == (1, 0)
    # A line that everybody quotes: it is in one task nowhere, and each quotation finds it.
    hot = [(i, 0, "u", "> Thanks a lot!\nyes") for i in range(11_000)] + [(99_999, 0, "u", "thanks a lot"), (None, 0, "u", "> yes\n" + "long text " * 50_000)]
    found = quotations.reply_ordered(spark.createDataFrame(hot, schema)).groupBy("n_linked").count().collect()
    assert {r.n_linked: r["count"] for r in found} == {1: 11_001, 0: 1}


def test_replies_with_ids_of_text_and_many_answers_to_one_message(spark):
    m = [("a-1", "t0", "u", "First thing here."), ("a-1", "t1", "u", "> first thing here\nyes"), ("b-2", "t0", "u", "> first thing here\nno")]
    found = quotations.reply_ordered(spark.createDataFrame(m, "conv_id string, turn string, role string, text string"))
    assert found.schema["conv_id"].dataType.simpleString() == found.schema["reply_to"].dataType.simpleString() == "string"
    assert sorted((r.conv_id, r.turn, r.reply_to, r.n_linked) for r in found.collect()) == [("a-1", "t0", None, 0), ("a-1", "t1", "t0", 1), ("b-2", "t0", None, 1)]
    # Twenty thousand answers to one message, and equal messages of no conversation.
    hot = [(1, 0, "u", "What do you all think?")] + [(1, i, "u", f"> What do you all think?\nanswer {i}") for i in range(1, 20_001)] + [(None, 0, "u", "same")] * 20_000
    rows = quotations.reply_ordered(spark.createDataFrame(hot, "conv_id int, turn int, role string, text string")).toPandas()
    one, none = rows[rows.conv_id == 1], rows[rows.conv_id.isna()]
    assert len(one) == 20_001 and (one.sort_values("reply_pos").turn.to_numpy() == range(20_001)).all() and (one[one.turn > 0].reply_to == 0).all() and one.n_linked.sum() == 20_000
    assert sorted(none.reply_pos) == list(range(20_000))


def test_global_rank(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(200)], "a int, b int").repartition(6)
    got = [(r.a, r.b) for r in sorted(with_global_rank(df, ["a", "b"]).collect(), key=lambda r: r["rank"])]
    assert got == sorted((i % 3, i) for i in range(200))
