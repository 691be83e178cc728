"""The terms of an index: answers without postings, and rare words that lead past the common ones."""

from pyspark.sql import functions as F

from quillmark.engine import MOST_SCOPES, Engine
from quillmark.operators import postings as P
from quillmark.store import Store
from quillmark.streaming import ingest
from quillmark.workspace import staging
from tests.test_ingest import records


def rows_read(df):
    """Rows that the Parquet scans of df's plan gave out."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if "Scan parquet" in node.nodeName():
            out += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def index_of(spark, work, texts_of, n):
    rows = spark.range(n).select(F.format_string("k%07d", "id").alias("k"), texts_of.alias("body"))
    every = P.postings(rows, "k", F.col("body"))
    every.write.options(**P.OPTIONS).parquet(f"{work.root}/p")
    every = spark.read.parquet(f"{work.root}/p")
    P.terms(every).write.options(**P.TERM_OPTIONS).parquet(f"{work.root}/t")
    return P.TextIndex(every, "k", (), ((every, spark.read.parquet(f"{work.root}/t")),))


def test_a_rare_word_and_a_common_one(spark):
    with staging(spark) as work:
        text = F.concat(F.lit("common word "), F.when(F.col("id") == 61_234, "rarest").otherwise(F.concat(F.lit("x"), F.col("id") % 5)))
        index = index_of(spark, work, text, 120_000)
        plain = P.TextIndex(index.postings, "k")
        phrases = [["common", "word"], ["rarest"]]
        assert [r["k"] for r in index.match_all(phrases).collect()] == [r["k"] for r in plain.match_all(phrases).collect()] == ["k0061234"]
        assert rows_read(index.match_all(phrases)) < 20_000 < 200_000 < rows_read(plain.match_all(phrases))
        assert index.match_all([["common"], ["x1"]]).count() == 24_000
        assert index.match_all([["common"], ["absent"]]).count() == 0 and rows_read(index.match_all([["common"], ["absent"]])) == 0
        assert [tuple(r) for r in index.probe(["common", "rarest", "absent"]).collect()] == [("absent", 0, 0), ("common", 120_000, 1), ("rarest", 1, 1)]


def test_terms_of_every_segment(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.write(store, "research", {"records": records(spark, *[(f"r:{i}", "Title", f"common word{i}", 2) for i in range(20)])})
    ingest.write(store, "research", {"records": records(spark, ("r:3", "Title", "common changed", 3), ("r:99", "Title", "lonely", 3))})
    index = store.index("records")
    assert len(index.segments) == 2 and {r["token"]: (r["df"], r["segments"]) for r in index.probe(["common", "lone", "chang"]).collect()} == {"common": (21, 2), "lone": (1, 1), "chang": (1, 1)}
    engine = Engine.of_store(store)
    assert [i["id"] for i in engine.query("source:research common changed")["items"]] == ["r:3"] and engine.query("source:research common word3")["lexical_relaxation"] == {"records": "or"}
    assert engine.query("source:research common")["total_matched"] == 20 and engine.query("source:research lonely")["total_matched"] == 1


def test_an_engine_forgets_scopes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sessions = spark.createDataFrame([("s1", "s1", "session")], "session_id string, root_session_id string, kind string")
    words = [f"word{chr(97 + i)}" for i in range(MOST_SCOPES + 3)]
    obs = spark.createDataFrame([("o1", "s1", "s1", "user", " ".join(words))], "obs_id string, session_id string, root_session_id string, type string, body string")
    ingest.write(store, "sessions", {"sessions": sessions, "observations": obs})
    engine = Engine.of_store(store)
    for w in [*words, words[-1]]:
        assert engine.query(f"scope:session source:observations {w}")["total_matched"] == 1
    kept = [work.root for _, work in engine._scopes.values()]
    assert len(kept) == MOST_SCOPES
    engine.close()
    fs = store.path(kept[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not engine._scopes and not any(fs.exists(store.path(k)) for k in kept)


def test_a_root_without_a_transcript(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sessions = spark.createDataFrame([("s1:a", "s1", "subagent"), ("s1:b", "s1", "subagent"), ("s2", "s2", "session")], "session_id string, root_session_id string, kind string")
    obs = spark.createDataFrame([("o1", "s1:a", "s1", "user", "hello")], "obs_id string, session_id string, root_session_id string, type string, body string")
    ingest.write(store, "sessions", {"sessions": sessions, "observations": obs})
    engine = Engine.of_store(store)
    assert [i["id"] for i in engine.query("source:sessions top:s1")["items"]] == ["s1"] and engine.query("source:sessions top:s1")["total_matched"] == 1
    assert [i["id"] for i in engine.query("source:sessions top:s2")["items"]] == ["s2"] and engine.query("source:sessions top:s3")["total_matched"] == 0
    assert engine.query("source:sessions top:s1 unheard")["total_matched"] == 0


def test_stemmed_matches_are_confirmed_by_spelling(spark):
    """thes is stemmed to the and thé folded to it: neither is the word that is asked for."""
    from quillmark.catalog import _spelt

    rows = spark.createDataFrame([("a", "this was the"), ("b", "this was thes"), ("c", "this was thé"), ("d", "thi wa the thes"), ("e", "this the")], "stable_id string, body string")
    every = P.postings(rows, "stable_id", F.col("body"), stem=True)
    found = _spelt(rows, P.TextIndex(every, "stable_id"), "this was the", [("this", "thi"), ("was", "wa"), ("the",)])
    assert sorted(r[0] for r in found.collect()) == ["a", "d"]


def shuffled(df):
    """Rows that the exchanges of df's plan wrote."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName() == "Exchange":
                out += node.metrics().apply("shuffleRecordsWritten").value()
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_the_shuffle_of_an_index_has_a_row_a_posting(spark):
    rows = spark.range(300).select(F.format_string("k%03d", "id").alias("k"), F.concat(F.repeat(F.lit("same words "), 40), "id").alias("body"))
    every = P.postings(rows, "k", F.col("body"))
    assert every.count() == 900 and shuffled(every) == 900  # 24,300 words
    assert {tuple(r["at"]) for r in every.where("token = 'words'").collect()} == {tuple(range(1, 80, 2))}


def plain_postings(rows, stem=False):
    """(token, key): places, word by word."""
    from quillmark.functions.porter import stem as porter
    from quillmark.functions.text import fold

    out = {}
    for r in rows.select("k", P.tokens(F.col("body")).alias("t")).collect():
        for at, word in enumerate(r["t"]):
            out.setdefault((porter(fold(word)) if stem else word, r["k"]), []).append(at)
    return {k: sorted(v) for k, v in out.items()}


def test_postings_in_many_parts(spark, monkeypatch):
    """Parts are ranges of (token, key), a token of many rows is in several, and nothing is lost, by whatever cut."""
    for name, n in (("PART", 700), ("LEAST_PART", 50), ("SAMPLED", 400), ("WORDS", 90), ("WRITTEN", 40)):
        monkeypatch.setattr(P, name, n)
    body = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, " .. ").otherwise(F.concat_ws(" ", F.lit("The often THE"), F.concat(F.lit("x"), F.col("id") % 50), F.lit("running runs caf\u00e9"), F.concat(F.lit("\U00010400y"), "id")))
    rows = spark.range(1000).select(F.format_string("k%04d", "id").alias("k"), body.alias("body"))
    for stem in (False, True):
        every = P.postings(rows, "k", F.col("body"), stem=stem)
        found = every.withColumn("p", F.spark_partition_id()).collect()
        assert {(r["token"], r["key"]): r["at"] for r in found} == plain_postings(rows, stem) and len(found) == len(plain_postings(rows, stem))
        order = [(r["p"], r["token"], r["key"]) for r in found]
        assert order == sorted(order) and [o[1:] for o in order] == sorted(o[1:] for o in order)
        assert every.rdd.getNumPartitions() >= 5 and len({r["p"] for r in found if r["token"] == "the"}) > 1
        told = {r["token"]: (r["df"], r["low"], r["high"]) for r in P.terms(every).collect()}
        keys = {}
        for token, key in plain_postings(rows, stem):
            keys.setdefault(token, []).append(key)
        assert told == {t: (len(k), min(k), max(k)) for t, k in keys.items()}


def test_rows_that_repeat_a_key_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "one two one"), ("a", "two"), ("b", "one"), (None, "one"), ("c", None)], "k string, body string")
    for stem in (False, True):
        found = P.postings(rows, "k", F.col("body"), stem=stem)
        got = {(r["token"], r["key"]): r["at"] for r in found.collect()}
        assert got == plain_postings(rows, stem) and got[("two", "a")] == [0, 1] and len(got) == 4
    assert P.postings(rows.where("false"), "k", F.col("body")).count() == 0
    assert P.terms(P.postings(rows.where("false"), "k", F.col("body"))).count() == 0
