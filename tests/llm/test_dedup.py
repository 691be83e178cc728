import dataclasses
import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import exact_dedup as exact_module
from quillmark.llm import near_dedup, repeats, substring_dedup, suffix_dedup
from quillmark.llm.exact_dedup import exact_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def texts():
    return brute.corpus(random.Random(5))


@pytest.mark.parametrize("digest_bytes", [32, 0])
def test_exact(spark, texts, digest_bytes):
    """With digests, and with the same digest for all texts."""
    dedup = functools.partial(exact_dedup, digest_bytes=digest_bytes)
    docs = brute.frame(spark, texts)
    got = {r["doc_id"]: r.asDict() for r in dedup(docs.union(docs.limit(1))).where("doc_id > 0").collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        if i:
            same = [j for j, x in enumerate(plain) if x == t]
            assert got[i]["keep_id"] == max(same) and got[i]["kept"] == (i == max(same))
            assert got[i]["group_size"] == len(same) + (t == "") and got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    again = dedup(docs.where("doc_id = 7").union(docs.where("doc_id = 7"))).collect()
    assert sorted(r["kept"] for r in again) == [False, True] and {r["group_size"] for r in again} == {2}
    assert dedup(docs.limit(0)).count() == 0
    nulls = dedup(docs.selectExpr("cast(null as long) doc_id", "text").limit(3)).collect()
    assert sorted((r["group_size"], r["kept"]) for r in nulls) == [(1, True), (2, False), (2, True)] and {r["keep_id"] for r in nulls} == {None}
    named = dedup(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.lit("same").alias("text")).repartition(5)).collect()
    top = max(f"d{i}" for i in range(len(texts)))
    assert {r["keep_id"] for r in named} == {top} and [r["doc_id"] for r in named if r["kept"]] == [top]


def test_exact_of_a_text_in_every_chunk(spark, monkeypatch):
    """Chunks of four rows: the copies of one text come by many salts and give one winner and one size."""
    monkeypatch.setattr(exact_module, "LOCAL_ROWS", 4)
    docs = spark.range(0, 600, 1, 5).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('t', id) WHEN id % 3 = 1 THEN '' END AS text")
    assert exact_module.combined(docs.selectExpr("doc_id", "coalesce(text, '') AS body")).select("chunk").distinct().count() == 150
    rows = exact_dedup(docs, salts=2).collect()
    hot = [r for r in rows if r["doc_id"] % 3]
    assert len(rows) == 600 and {(r["keep_id"], r["group_size"]) for r in hot} == {(599, 400)} and [r["doc_id"] for r in hot if r["kept"]] == [599]
    assert all(r["kept"] and r["group_size"] == 1 and r["keep_id"] == r["doc_id"] for r in rows if r["doc_id"] % 3 == 0)


@pytest.mark.parametrize(("part", "dense"), [(2048, 4), (3, 4), (2048, 0)])
def test_near(spark, texts, part, dense, monkeypatch):
    """With whole buckets, buckets in parts, and sets that come to every block."""
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    got = {r["doc_id"]: r.asDict() for r in near_dedup.near_components(brute.frame(spark, texts)).collect()}
    want = brute.near_components(list(enumerate(texts)))
    for i, t in enumerate(texts):
        assert got[i]["n_shingles"] == len(brute.shingles(t)) and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)


@pytest.mark.parametrize("dense", [4, 0])
def test_near_finds_links_that_stars_miss(spark, dense, monkeypatch):
    """A chain: each text is close to the next only, so no single centre reaches all."""
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    rng = random.Random(9)
    words = [f"t{i}" for i in range(100)]
    chain = []
    for _ in range(12):
        chain.append(" ".join(words))
        for _ in range(4):
            words[rng.randrange(100)] = f"n{rng.random()}"
    order = list(range(12))
    rng.shuffle(order)
    docs = brute.frame(spark, [chain[i] for i in order])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert got == brute.near_components([(k, chain[i]) for k, i in enumerate(order)])


def test_candidates_hold_nearly_every_link():
    """Pairs of similarity 0.8 to 0.85 and of all sizes share a band, and pass the comparison of signatures."""
    rng, missed, pairs = np.random.default_rng(4), 0, 0
    for union, both in ((5, 4), (6, 5), (10, 8), (12, 10), (25, 20), (40, 33), (100, 80), (300, 245), (1000, 800)):
        a, b = [], []
        for _ in range(400):
            x = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64))
            rng.shuffle(x)
            cut = both + rng.integers(0, union - both + 1)
            a.append(np.sort(x[:cut]))
            b.append(np.sort(np.concatenate([x[:both], x[cut:]])))
        s, t = near_dedup.signatures(a), near_dedup.signatures(b)
        found = (near_dedup.band_keys(s) == near_dedup.band_keys(t)).any(axis=1)
        if both >= near_dedup.FEW:
            found &= (s == t).sum(axis=1) >= near_dedup.BINS // 2
        missed, pairs = missed + int((~found).sum()), pairs + len(found)
    assert missed <= pairs / 1000


def test_near_odd_tables(spark, texts):
    docs = brute.frame(spark, ["same text here now", "same text here now", None])
    assert near_dedup.near_components(docs.limit(0)).count() == 0
    rows = near_dedup.near_components(docs.union(docs)).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows} == {0, 2}
    nulls = near_dedup.near_components(docs.selectExpr("cast(null as long) doc_id", "text")).collect()
    assert sorted(r["kept"] for r in nulls) == [False, True, True] and {r["component_id"] for r in nulls} == {None}
    left = near_dedup.near_deduplicated(docs.union(docs))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 2] and left.columns == docs.columns
    named = near_dedup.near_components(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert sorted((r["component_id"], r["kept"]) for r in named.collect()) == [("d0", False), ("d0", True), ("d2", True)]


def test_near_copies_in_the_pipeline_share_five_words(spark, texts, monkeypatch):
    """Three words of a hundred differ: 0.89 by shingles of two words, 0.73 by five."""
    words = [f"t{i}" for i in range(100)]
    other = [f"n{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]
    pair = brute.frame(spark, [" ".join(words), " ".join(other), " ".join([*words, "end"])])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, pair, "").collect()) == [0, 1]
    monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, k=5))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(brute.frame(spark, texts), 5).collect()}
    assert got == brute.near_components(list(enumerate(texts)))


def test_near_deduplicated_rows_that_share_an_id(spark):
    """Ids that repeat with other texts, and null ids: only rows whose text is linked to one that stays may go."""
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (None, ""), (None, None), (4, None), (4, None)]
    left = near_dedup.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect())
    assert got == sorted([("1", a), ("1", b), ("None", c), ("None", ""), ("None", ""), ("4", ""), ("4", "")]) and left.columns == ["doc_id", "text"]


def weak_digest(body, salt):
    """Equal for all contents of a length under the first salt."""
    return len(body) if not salt else repeats.digest(body, salt)


#: As they are; with crowded seeds dealt anew by longer ones; with digests that clash.
HOW = ({}, {"group": 2}, {"digest": weak_digest})


@pytest.mark.parametrize("how", HOW)
def test_bytes(spark, texts, how):
    search = dataclasses.replace(suffix_dedup.SEARCH, **how)
    got = {r["doc_id"]: r.asDict() for r in suffix_dedup.remove_repeats(brute.frame(spark, texts), texts=True, how=search).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (d, hit) in enumerate(zip(data, brute.repeated(data, 200), strict=True)):
        kept = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(d), sum(hit), spans)
        assert bytes(got[i]["kept"]) == kept and got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("how", HOW)
def test_words(spark, texts, how):
    search = dataclasses.replace(substring_dedup.SEARCH, **how)
    got = {r["doc_id"]: r.asDict() for r in substring_dedup.remove_repeats(brute.frame(spark, texts), texts=True, how=search).collect()}
    data = [brute.WORD.findall(t or "") for t in texts]
    for i, (w, hit) in enumerate(zip(data, brute.repeated(data, 35), strict=True)):
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(hit), kept)


def thue_morse(n):
    """Two words over a and b that hashes linear in their letters tell apart badly."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_linear_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    around = [f"w{i}" for i in range(34)]
    docs = brute.frame(spark, [" ".join([*around[:17], x, *around[17:]]) for x in (a, b)])
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    got = near_dedup.near_components(brute.frame(spark, [a, b])).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]
    left = suffix_dedup.remove_repeats(brute.frame(spark, [a[:300], b[:300]])).collect()
    want = [sum(h) for h in brute.repeated([a[:300].encode(), b[:300].encode()], 200)]
    assert [r["n_removed"] for r in sorted(left, key=lambda r: r["doc_id"])] == want


@pytest.mark.parametrize(("module", "length"), [(suffix_dedup, 200), (substring_dedup, 35)])
def test_long_texts_are_searched_in_parts(module, length):
    """Stretches of a long text hold every window once, under its own number."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(9000)) + " " + "x" * 9000 + " end of it"
    column = pa.array(["a few words", text, "z"])
    seen = {0: [], 1: [], 2: []}
    for a, _, units, base in repeats.stretches(column, module.SEARCH, 4000):
        for r, n in enumerate((units.first[1:] - units.first[:-1]).tolist()):
            seen[a + r] += [base + i for i in range(n - length + 1)]
            if n:
                own = repeats.Units(units.values[units.first[r] :], units.start[units.first[r] :], units.end[units.first[r] :], units.first, units.data, units.raw)
                whole = module.SEARCH.units(np.frombuffer(column[a + r].as_py().encode(), np.uint8), np.array([0, len(column[a + r].as_py())]))
                assert own.data[own.start[0] : own.end[0]].tobytes() == whole.data[whole.start[base] : whole.end[base]].tobytes()
    total = len(text) if module is suffix_dedup else len(text.split())
    assert seen[1] == list(range(total - length + 1))


def test_long_document(spark):
    """3 MB, longer than a stretch, and a copy of its middle: as if read at once."""
    rng = random.Random(8)
    words = [f"{rng.randrange(10**6)}" for _ in range(420_000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, "b " + " ".join(words[200_000:200_400]) + " e")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {0: 400, 1: 400}
    size = len(" ".join(words[200_000:200_400])) + 2
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[0] == got[1] and got[0] in (size - 2, size - 1, size)


def test_repeats_in_odd_tables(spark):
    docs = brute.frame(spark, ["x" * 300, "y " * 80, None])
    for module in (suffix_dedup, substring_dedup):
        assert module.remove_repeats(docs.limit(0)).count() == 0
        twice = module.remove_repeats(docs.union(docs)).collect()
        assert len(twice) == 6
        shared = docs.selectExpr("cast(1 as long) doc_id", "text")
        assert module.remove_repeats(shared).count() == 3
    rows = suffix_dedup.remove_repeats(docs.union(docs)).where("doc_id = 0").collect()
    assert [r["n_removed"] for r in rows] == [300, 300]


def test_run_index_agrees_with_plain_search():
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 200))) for _ in range(12)] + [b"c" * 40, b"\xc3\xa9" * 30, b"ab" * 50]
    copies = np.array([1 + (i % 4 == 0) * 2 for i in range(len(pieces))])
    index = suffix_dedup.RunIndex(pieces, copies)
    assert index.length.sum() == sum((len(p) + 8) * c for p, c in zip(pieces, copies, strict=True)) and len(index.symbol) < sum(map(len, pieces))
    every = [p for p, c in zip(pieces, copies, strict=True) for _ in range(c)]
    starts = lambda s: sum(p.startswith(s, i) for p in every for i in range(len(p)))
    for p in pieces:
        for a in range(0, len(p), 9):
            for n in (1, 2, 5, 17):
                s = p[a : a + n]
                assert index.count(s) == starts(s)
    for k, p in enumerate(pieces):
        got = index.matching_statistics(np.full(len(p), k), np.arange(len(p)))
        for a in range(0, len(p), 7):
            n = 0
            while a + n < len(p) and starts(p[a : a + n + 1]) > 1:
                n += 1
            assert got[a] == n
