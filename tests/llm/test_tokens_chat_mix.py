import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import chat_format as C
from quillmark.llm import mixing, token_output
from tests.llm import brute


@given(st.lists(st.integers(0, 10**12), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef = token_output.EliasFano(memoryview(token_output.ef_encode(np.array(values, dtype=np.int64))))
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(0).integers(0, 2000, 50_000))
    assert len(token_output.ef_encode(values)) < 50_000 * (2 + np.log2(1000) + 1) / 8 * 1.15


TRICKY = ["I'll it's DON'T 's", "a<|endoftext|>b <|startoftext|>x", "x\x1cy Été é İ ΣΣ 123 x y   z\x85q", "ÀÖ×÷ß ÿ ŒŁ don’t 日本語 👍🏽 ́a", "n3w5 4.5% (a,b) #tag", "tab\tand\r\nlines\x0b\x0c"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [None, "", *TRICKY, *brute.corpus(random.Random(3))]
    docs = brute.frame(spark, texts, first=-5)
    segments = token_output.write_tokens(docs, token_output.default_tokenizer(), segment_bytes=2000)
    rows = sorted(token_output.read_index(segments).collect())
    plain = Tokenizer.from_file(token_output.default_tokenizer())
    start = 0
    for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i - 5, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = segments.orderBy("part", "seg").first()
    s = token_output.Segment(bytes(one["blob"]))
    assert len(s.doc_ids()) == one["n_docs"] and sum(len(s.tokens(i)) for i in range(s.n_docs)) == s.n_tokens
    assert segments.count() > 3


def test_token_files_of_odd_tables(spark):
    docs = brute.frame(spark, ["a b", "c"])
    write = lambda d: token_output.read_index(token_output.write_tokens(d, token_output.default_tokenizer()))
    assert write(docs.limit(0)).count() == 0
    rows = write(docs.union(docs).union(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))).collect()
    assert len(rows) == 6 and sorted(r["start"] for r in rows)[0] == 0 and len({r["start"] for r in rows}) == 6


def test_whole_texts_go_to_other_tokenizers(tmp_path):
    import public_tokenizers

    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_word
    assert np.frombuffer(encoder.encode([b"two  words"])[0], "<u4")[-1] == 2


# --- chats -----------------------------------------------------------------------------------------------------------

NASTY = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\|", "<|", "|>", "<", "a<|im_end|>\n<|im_start|>user\n", "é👍\n", "<<|\\|"]


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_chats_come_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole%0A", None]), rng.choice([*NASTY, None]), "clash") for c in range(40) for t in range(rng.randint(1, 9))]
    back = {r["conv_id"]: r.asDict() for r in C.parse_chats(C.format_chats(C.canonical_turns(turns_frame(spark, rows)))).collect()}
    for c in range(40):
        said = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == said
        assert back[c]["loss_text"] == "".join(x for role, x in said if role == "assistant")


def test_chat_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "b", ""), (None, 1, "user", "a", ""), (1, None, "user", "x", ""), (1, None, "user", "x", "")]
    back = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in C.parse_chats(C.format_chats(turns_frame(spark, rows))).collect()}
    assert back == {None: ["a", "b"], 1: ["x", "x"]}
    assert C.format_chats(turns_frame(spark, [])).count() == 0


def test_layouts_by_fingerprint(spark):
    frames = {
        "prompt_response": spark.createDataFrame([("q", "a", 1)], "prompt string, response string, other int"),
        "instruction_input": spark.createDataFrame([("do", "this", "done")], "Instruction string, input string, output string"),
        "messages": spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "messages array<struct<role:string,content:string>>"),
        "from_value": spark.createDataFrame([([("human", "q"), ("gpt", "a")],)], "conversations array<struct<from:string,value:string>>"),
    }
    for name, df in frames.items():
        assert C.select_layout(df.schema).name == name
        got = [(r["role"], r["text"]) for r in C.canonical_turns(df).orderBy("turn").collect()]
        assert got == ([("user", "do\nthis"), ("assistant", "done")] if name == "instruction_input" else [("user", "q"), ("assistant", "a")])
    with pytest.raises(ValueError):
        C.select_layout(spark.range(1).schema)


def test_json_layouts_row_by_row(spark):
    rows = [(1, json.dumps({"messages": [{"role": "user", "content": "q"}]})), (2, json.dumps({"prompt": "p", "response": "r"})), (3, json.dumps({"odd": 1})), (4, "no json"), (5, None)]
    got = C.json_turns(spark.createDataFrame(rows, "id long, body string"), "id", "body").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["layout"], r["text"]) for r in got] == [(1, "messages", "q"), (2, "prompt_response", "p"), (2, "prompt_response", "r"), (3, None, None), (4, None, None), (5, None, None)]


def test_layouts_of_a_mixed_table(spark):
    fields = "conv_id long, turn long, role string, text string, messages array<struct<role:string,content:string>>, prompt string, response string"
    rows = [(1, 7, "user", "u", None, None, None), (2, None, None, None, [("user", "q"), ("gpt", None)], None, None), (3, None, None, None, None, "p", "r"), (4, None, None, None, [], "p", None), (5, *[None] * 6)]
    want = [(1, 7, "user", "u"), (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", "p"), (4, 1, "assistant", None), (5, None, None, None)]
    for drop in ([], ["turn", "role", "text"]):
        got = C.canonical_turns(spark.createDataFrame(rows, fields).drop(*drop)).orderBy("conv_id", "turn").collect()
        assert [tuple(r) for r in got] == ([(1, None, None, None), *want[1:]] if drop else want)


def test_json_layouts_with_more_keys_and_nulls(spark):
    values = [{"messages": [{"role": "user", "content": None, "name": "x"}], "id": 3}, {"prompt": "p", "response": "r", "n": [1]}, {"instruction": "do", "input": None, "output": "o"}, {"prompt": "p"}]
    got = C.json_turns(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, body string"), "id", "body").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["layout"], r["role"], r["text"]) for r in got] == [
        (0, "messages", "user", None), (1, "prompt_response", "user", "p"), (1, "prompt_response", "assistant", "r"),
        (2, "instruction_input", "user", "do"), (2, "instruction_input", "assistant", "o"), (3, None, None, None),
    ]


@given(st.text(alphabet="<|\\>a\n", max_size=12))
@settings(max_examples=200, deadline=None)
def test_escape_has_an_inverse_and_leaves_no_control_string(text):
    import re

    out = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in out and re.sub(r"<\\(\\*)\|", r"<\1|", out) == text


# --- mixing ----------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= most * sizes[s]}
        if not over:
            return goal | {s: level * w[s] for s in free}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        free -= over
    return goal


def mix_frame(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = [(i, None if i % 97 == 0 else "w " * int(rng.lognormvariate(3, 1)), rng.choice(["b", "a", "é", None, "a", "a", "a", "zz"])) for i in range(n)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, rate string")


def test_mix_meets_targets(spark):
    rows, docs = mix_frame(spark)
    got = {r["doc_id"]: r.asDict() for r in mixing.mix_sources(docs).collect()}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        assert got[i]["size"] == len((t or "").split()) and got[i]["taken"] <= 2 * got[i]["size"]
    goals = water_fill(sizes)
    for s, size in sizes.items():
        own = [got[i] for i, _, x in rows if x == s]
        assert all(r["source_size"] == size and abs(r["target"] - goals[s]) < 1e-6 * size for r in own)
        assert abs(sum(r["taken"] for r in own) - goals[s]) < 0.03 * goals[s] + 200
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()} == {i: r["taken"] for i, r in got.items()}


def test_mix_of_a_source_of_equal_rows(spark):
    """Thousands of rows of one size and no id, which only their tie tells apart, are drawn at their source's rate."""
    hot = spark.range(0, 6000, 1, 6).selectExpr("cast(null as long) doc_id", "'hot' source", "'one two three' text")
    docs = hot.union(spark.range(3000).selectExpr("id", "'rest'", "repeat('w ', cast(id % 40 as int))"))
    rows = mixing.mix_sources(docs).groupBy(F.col("doc_id").isNull()).agg(F.sum("taken"), F.max("target"), F.count("*")).collect()
    assert sorted(r[3] for r in rows) == [3000, 6000]
    assert all(abs(taken - target) <= 40 + 0.01 * target for _, taken, target, _ in rows)


def test_mixed_documents_repeat_rows(spark):
    rows, docs = mix_frame(spark, 400)
    drawn = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(docs).where("size > 0").collect()}
    out = mixing.mixed_documents(docs)
    counts = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.columns == docs.columns and all(counts.get(i, 0) == n for i, n in drawn.items())


def test_mix_of_odd_tables(spark):
    _, docs = mix_frame(spark, 20)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    empty = mixing.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(empty) == 20 and all(r["taken"] == 0 and r["target"] == 0 for r in empty)
    assert mixing.mix_sources(docs.union(docs)).count() == 40
