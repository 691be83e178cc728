"""Resampling, the Merkle manifest and URL filters against plain versions, on odd tables and on hot groups."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillmark.llm import components, importance, merkle, ordering, url_filter
from tests.conftest import SF, rows_of
from tests.llm import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_merkle_manifest", "op13_url_filter"])
def test_query_against_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_numbered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    rows = ordering.numbered(df.repartition(7), [F.desc("v"), F.asc("id")], "numbered").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(5000))
    assert [(r["v"], r["id"]) for r in rows] == sorted(((i * 7919 % 1000, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


# --- resampling ------------------------------------------------------------------------------------------------------


def grams(text, orders):
    w = WORD.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain_sample(docs, aims, least, percent, orders, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in grams(text, orders)[1]:
            s[bucket(f)] += 1
    for text in aims:
        for f in grams(text, orders)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for n, (i, text) in enumerate(docs):
        w, fs = grams(text, orders)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([n, i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[5], r[1] is None, r[1] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[6] = rank + 1
    return [(r[1], *r[3:]) for r in out]


@pytest.mark.parametrize(("orders", "buckets", "least"), [(2, 10_000, 20), (3, 50, 3), (1, 7, 1)])
def test_sample_against_plain(spark, orders, buckets, least):
    texts = [*brute.corpus(random.Random(orders)), "Été İ x-ray 12", "\x00\x7f", "日本 語"]
    aims = [*texts[9:14], None, "", "w1 w2 w3 the of"]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(aims)], "item_id long, text string, key string")
    docs = brute.frame(spark, texts).withColumns({c: F.lit("clash") for c in ("pos", "word", "b1", "bucket", "gain", "score", "rank", "place", "_id", "_part")})
    got = importance.importance_sample(docs, bench, least, 40, orders=orders, buckets=buckets).collect()
    want = plain_sample(list(enumerate(texts)), aims, least, 40, orders, buckets)
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])
    kept = importance.resampled_documents(docs, bench, least_words=least, percent=40, orders=orders, buckets=buckets)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[4] is not None}


def test_sample_of_odd_tables(spark):
    docs = brute.frame(spark, ["a b c d", "a b c d", None, "long " * 300_000])
    bench = spark.createDataFrame([("b", "a b")], "item_id string, text string")
    sample = lambda d, b=bench: importance.importance_sample(d, b, 2, 50)
    assert sample(docs.limit(0)).count() == 0 and sample(docs, bench.limit(0)).count() == 4
    same = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = sample(same).collect()
    assert len(rows) == 12 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    assert {(r["n_features"], r["weight"]) for r in rows if r["doc_id"] == 2} == {(0, 0)} and max(r["n_features"] for r in rows) == 599_999


# --- Merkle ----------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fan):
    """(root, siblings of each node by level) of a tree level by level."""
    above, sides, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(above) > 1:
        runs = [above[i : i + fan] for i in range(0, len(above), fan)]
        for leaf, p in enumerate(at):
            run = runs[p // fan]
            sides[leaf].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            at[leaf] = p // fan
        above = [h(*run) for run in runs]
    return above[0], sides


def plain_manifest(rows, fan):
    """rows: (doc_id, source, lang, n_chars, text, claimed text or None)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r[1], r[0], h(*map(field, r[:5])), h(*map(field, (*r[:4], r[4] if r[5] is None else r[5])))) for r in rows]
    leaves.sort(key=lambda x: ((x[0] or "").encode() if x[0] is not None else b"", x[0] is not None, x[1] is not None, x[1] or 0, x[2]))
    sources = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in leaves if x[0] == s], fan) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources], fan)
    out = []
    for n, s in enumerate(sources):
        for (_, i, leaf, claim), sides in zip([x for x in leaves if x[0] == s], trees[s][1], strict=True):
            folded = claim
            for left, right in [*sides, *tops[n]]:
                folded = h(left, folded, right)
            out.append((i, s, leaf, trees[s][0], root, h(*[a + b for a, b in [*sides, *tops[n]]]), folded, folded == root))
    return out


@pytest.mark.parametrize(("fan", "reach", "n"), [(16, 3, 300), (2, 2, 77), (3, 1, 100), (2, 3, 8), (16, 3, 1)])
def test_manifest_against_plain(spark, fan, reach, n):
    rng = random.Random(fan * n)
    rows = [(i * 7 % 1009, rng.choice([None, "", "a", "É", "z", "a"]) if i % 3 else "hot", rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["T é", "", None, "X" * 9]), rng.choice([None, None, "other"])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, other string")
    df = df.withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "digest", "claim", "tie", "block", "upper", "root")})
    got = merkle.merkle_manifest(df, F.col("other"), fan_out=fan, reach=reach).collect()
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows, fan), key=key)


def test_manifest_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 40 + [(1, "s", "en", 1, "x" * 3_000_000)] * 3, "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.merkle_manifest(df).collect()
    assert len(rows) == 43 and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    assert sorted(r["subroot"] for r in rows) == sorted(r[3] for r in plain_manifest([(*r, None) for r in map(tuple, df.collect())], 16))
    assert merkle.merkle_manifest(df.limit(0)).count() == 0
    assert merkle.merkle_manifest(df.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 43


def test_a_changed_text_does_not_verify(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.merkle_manifest(df, F.when(F.col("doc_id") == 7, "text 7")).collect()
    assert [r["doc_id"] for r in rows if not r["verified"]] == [7]


# --- url filters -----------------------------------------------------------------------------------------------------


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(5)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]
    star = [("hub", f"r{i}") for i in range(3000)] + [("r7", "r7"), (None, "r8"), ("hub", "r9")]
    rest = [(f"x{rng.randrange(300)}", f"x{rng.randrange(300)}") for _ in range(220)]
    for edges in (chain, star, rest, chain + star + rest, []):
        got = components.components(spark.createDataFrame(edges, "a string, b string")).collect()
        assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == plain_components(edges)


PAGES = [
    (1, "https://spam.example.org/es/1", '<link rel="canonical" href="http://far.net/a?x=1&amp;y=2">'),
    (2, "http://FAR.net/a?x=1&y=2#frag", '<meta http-equiv="refresh" content="0; url=\'/b\'">'),
    (3, "http://far.net/b", None), (4, "http://far.net/c", "<!-- <link rel=canonical href='/b'> -->"), (5, "http://far.net/d", "<link href=b rel=canonical>"),
    (6, "http://ok.wiki.org/x", '<link rel="canonical" href="https://u.net/1">'), (7, "https://u.net/1", ""), (8, "https://v.com/de/2", "<link rel='canonical' href='https://u.net/1'>"),
    (9, None, "x"), (10, "no scheme", "<link rel=canonical href=http://far.net/b>"), (11, "x://", ""), (12, "http://ORG/", ""), (13, "http://notorg/", ""), (14, "http://a.org", ""), (15, "http://m.EXAMPLE.org/es/", ""),
    (16, "http://example.org/en/17?q", ""), (17, "http://example.org/en/2", ""), (18, "a://b.com/fr/://c.com/de/", ""), (19, "http://far.net/e?k", '<LINK REL=canonical HREF="?k#z"><link rel=canonical href=/b>'), (20, "http://far.net/f/g", '<link rel=canonical href="mailto:x@y">'),
    (3, "http://far.net/b", None), (None, "http://far.net/b", None),
]
WANT = {
    1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "block"), 6: ("org/", "allow"), 7: (None, "allow"), 8: ("com/de/", "block"), 9: (None, "allow"), 10: (None, "allow"),
    11: (None, "allow"), 12: ("org/", "allow"), 13: (None, "allow"), 14: (None, "allow"), 15: ("example.org/es/", "block"), 16: ("example.org/en/1", "block"), 17: ("org/", "allow"), 18: ("com/fr/", "allow"), 19: (None, "allow"), 20: (None, "allow"), None: (None, "block"),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in PAGES], "page_id long, url string, html string, host string, node string, bad string")


def test_aliases_of_blocked_urls(spark, pages, duck):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    for how in ({}, {"rules": rules}):
        rows = url_filter.filter_urls(pages, **how).collect()
        assert len(rows) == len(PAGES) and {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == WANT
    assert {r["page_id"]: (r["host"], r["path"]) for r in rows if r["page_id"] in (2, 10, 14, 18)} == {2: ("far.net", "/a"), 10: ("", ""), 14: ("a.org", ""), 18: ("b.com", "/fr/://c.com/de/")}
    con = duck.cursor()
    frame = pages.select("page_id", "url", "html").toPandas()  # noqa: F841  read by name below
    con.sql("create temp view pages as select page_id::BIGINT AS page_id, url, html from frame")
    assert rows_of(con.sql(url_filter.SQL).df()) == rows_of(url_filter.filter_urls(pages).toPandas())


def test_given_redirects_and_kept_rows(spark, pages):
    moved = spark.createDataFrame([("http://far.net/c", "http://mid.example/z"), ("http://mid.example/z", "https://w.com/de/1"), (None, "x")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, redirects=moved).collect()}
    assert got == {k: "block" if k == 4 else v for k, (_, v) in WANT.items()}
    kept = url_filter.allowed_pages(pages)
    assert kept.columns == pages.columns and sorted(r["page_id"] or 0 for r in kept.collect()) == sorted(k or 0 for k, v in WANT.items() if v[1] == "allow" or k is None)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, rules=[("allow", f"h{i}", "/") for i in range(url_filter.MOST_RULES + 1)])


def test_a_hub_of_aliases(spark):
    rows = [(i, f"http://m{i}.net/", "<link rel=canonical href='http://hub.net/'>") for i in range(4000)] + [(-1, "http://hub.net/", "<meta http-equiv=refresh content='1;URL=http://z.com/de/9'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["verdict"] for r in url_filter.filter_urls(df).collect()} == {"block"}
