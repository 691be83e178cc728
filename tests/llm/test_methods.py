"""The dealt methods are what gives the results: bounds come by select, copies by run lengths."""

import numpy as np
import pytest

from quillmark.llm import suffix_dedup, token_output


@pytest.mark.parametrize("n", [0, 1, token_output.SAMPLE - 1, token_output.SAMPLE, 5 * token_output.SAMPLE + 3])
@pytest.mark.parametrize("gap", [1, 3, 5000])
def test_batches_are_what_select_gives(n, gap):
    values = np.cumsum(np.random.default_rng(n + gap).integers(0, gap, n))
    ef = token_output.EliasFano(memoryview(token_output.ef_encode(values)))
    got = list(ef.batches())
    assert [len(b) for b in got] == [token_output.SAMPLE] * (n // token_output.SAMPLE) + ([n % token_output.SAMPLE] if n % token_output.SAMPLE else [])
    assert [x for b in got for x in b.tolist()] == values.tolist() == [ef.select(i) for i in range(n)]


def test_an_index_is_read_without_unpacking_all_bounds(monkeypatch):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 9, rng.integers(0, 50)).astype("<u4").tobytes() for _ in range(1000)]
    blob = token_output.pack_segment([None] * 300 + list(range(5, 2105, 3)), ids)
    monkeypatch.setattr(token_output.EliasFano, "all", lambda self: 1 / 0)
    rows = [(i, b - a) for docs, starts, ends in token_output.Segment(blob).documents() for i, a, b in zip(docs, starts, ends, strict=True)]
    assert rows == list(zip([None] * 300 + list(range(5, 2105, 3)), [len(x) // 4 for x in ids], strict=True))


def test_copies_are_run_lengths():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(97, 100, 60).astype(np.uint8).tobytes() for _ in range(20)]
    pieces = list(dict.fromkeys(pieces))
    copies = rng.integers(1, 5, len(pieces))
    index = suffix_dedup.RunIndex(pieces, copies)
    assert index.often.tolist() == copies.tolist() and not hasattr(index, "copies")
    assert [index.count(p) for p in pieces] == copies.tolist()
    index.often[:] = 1  # without the runs no copy is seen
    at = np.zeros(len(pieces), np.int64)
    assert (index.matching_statistics(np.arange(len(pieces)), at) < 60).all()
