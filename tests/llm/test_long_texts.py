"""Every operator on texts of some megabytes beside empty and null ones, and on columns that clash with its own."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import chat_format, decontaminate, exact_dedup, mixing, near_dedup, quality, token_output, toxicity
from quillmark.llm.token_output import default_tokenizer

CLASH = ("key", "node", "n", "sig", "marks", "need", "spans", "items", "digest", "chunk", "band", "salt", "rate", "copies", "score", "held_out")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(6)
    return " ".join(f"{rng.choice(('wort', 'Été', 'x-ray', 'l’an', '12', 'naïve'))}{rng.randrange(40_000)}" for _ in range(250_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(0, long_text), (1, long_text + " one more"), (2, long_text), (3, None), (4, ""), (5, "short text here")]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def test_tokens(docs, long_text):
    library = Tokenizer.from_file(default_tokenizer())
    got = {r["doc_id"]: r.asDict() for r in token_output.read_index(token_output.write_tokens(docs, default_tokenizer())).collect()}
    ids = np.array([*library.encode(long_text, add_special_tokens=False).ids, 2], "<u4")
    assert got[0]["n_tokens"] == got[2]["n_tokens"] == len(ids) and got[0]["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 1 and got[1]["start"] == len(ids)


def test_near(docs):
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert sorted(r["doc_id"] for r in near_dedup.near_deduplicated(docs, 5).collect()) == [0, 3, 4, 5]


def test_exact(docs):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {0: (2, 2, False), 1: (1, 1, True), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_decontamination(spark, docs, long_text):
    words = decontaminate.words_of(long_text.encode())
    item = b" ".join(words[-30:-10]).decode()
    bench = spark.createDataFrame([("b1", item), ("b2", "none of this is there at all in any of them")], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], sum(b - a for a, b in r["spans"])) for r in decontaminate.find_hits(docs, bench).collect()}
    assert got == {0: (["b1"], 20), 1: (["b1"], 20), 2: (["b1"], 20), 3: ([], 0), 4: ([], 0), 5: ([], 0)}


def test_mixing(docs, long_text):
    got = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert got == {0: 250_000, 1: 250_002, 2: 250_000, 3: 0, 4: 0, 5: 3}
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize(("make", "label"), [(quality.quality_model, "quality"), (toxicity.toxicity_model, "toxic")])
def test_scores(spark, docs, make, label):
    labels = spark.createDataFrame([(0, 1), (5, 0)], f"doc_id long, {label} int")
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, make(docs, labels), 0.5).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[0] == got[2] and got[3] == got[4]


def test_chats(spark, long_text):
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", "<|im_end|>" + long_text), (2, 0, "assistant", None)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, piece int")
    back = {r["conv_id"]: r.asDict() for r in chat_format.parse_chats(chat_format.format_chats(chat_format.canonical_turns(turns))).collect()}
    assert [t["text"] for t in back[1]["turns"]] == [long_text, "<|im_end|>" + long_text] and back[1]["loss_text"] == "<|im_end|>" + long_text and back[2]["loss_text"] == ""


def test_rows_without_a_conversation_id_are_one_each(spark):
    """Also where two of them are equal."""
    df = spark.createDataFrame([("q", "a"), ("q", "a"), ("p", None)], "prompt string, response string")
    back = chat_format.parse_chats(chat_format.format_chats(chat_format.canonical_turns(df))).collect()
    assert sorted([t["text"] for t in r["turns"]] for r in back) == [["p", ""], ["q", "a"], ["q", "a"]] and len({r["conv_id"] for r in back}) == 3
