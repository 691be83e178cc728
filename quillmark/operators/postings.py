"""A stored text index: where each token lies in each row, sorted by token, so that a query reads its own tokens only.

A posting is (token, key, at): at are the token's places in the row. Postings are dealt by ranges of (token, key), so a
token of many rows fills many files and no task, and the files' statistics lead a reader past all other tokens. Words
need keys alone, phrases compare places, a word's beginning is a range of tokens. Further columns of a row (its session,
its version) may ride along.

A segment holds the postings of the rows that one write has changed. A row's older postings are told by their version,
which the stored row no longer has; merging the segments leaves them out.

Beside its postings a segment has its terms: each token with the number of its rows and the range of their keys, sorted by
token, with a Bloom filter on it. A query for all of some words asks the terms first. A row's postings lie in one segment,
so a segment that lacks a word isn't read; in the others the rarest word's rows are read, and of the other words only
those keys.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import stemmed_word
from quillmark.operators.search import OR, PREFIX, STRICT

#: Row groups are small, so that few rows are read beside a token's own.
OPTIONS = {"parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "2000"}
TERM_OPTIONS = {"parquet.block.size": str(1 << 20), "parquet.page.row.count.limit": "2000", "parquet.bloom.filter.enabled#token": "true"}
#: Postings of a part, which a task sorts in memory; of a part where there are cores to spare, at least.
PART, LEAST_PART = 1_000_000, 50_000
#: Rows, and postings of them for each part, by which the parts are cut.
SAMPLED, POINTS = 4000, 64
#: Words that a task puts together at once, and postings of a batch that it gives out.
WORDS, WRITTEN = 1 << 20, 50_000
#: Rows of the rarest word whose keys become a condition on the others' postings; more are joined.
PROBED = 1000
_LAST = "\U0010ffff"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; marks that combine are left out first."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _bounds(df: DataFrame, key: Column, text: Column, n_rows: int) -> list[tuple[str, object]]:
    """(token, key) where the parts of the postings of df's n_rows begin, but for the first; from a sample of the rows.

    They say only where a posting is put. A part has some PART postings, or fewer if the cluster has more cores than parts.
    """
    share = min(1.0, SAMPLED / max(1, n_rows))
    drawn = (df.sample(share, seed=1) if share < 1 else df).select(key.alias("key"), F.array_distinct(tokens(text)).alias("words")).persist()
    try:
        found = drawn.agg(F.sum(F.size("words"))).first()[0] or 0
        every, cores = int(found / share), df.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-every // PART), min(cores, every // LEAST_PART))
        if parts < 2:
            return []
        points = drawn.select(F.explode("words").alias("token"), "key").sample(min(1.0, POINTS * parts / found), seed=2).collect()  # POINTS a part
    finally:
        drawn.unpersist()
    points = sorted(((r[0], r[1]) for r in points), key=lambda p: (p[0], p[1] is not None, p[1]))
    return list(dict.fromkeys(points[len(points) * k // parts] for k in range(1, parts))) if points else []


def _together(bounds: list[tuple[str, object]], names: list[str], stemmed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of batches of rows(_tokens, key, carried): each different token of a row once, with its places and the part it belongs to."""
    starts, keys = sorted({t for t, _ in bounds}), sorted({k for _, k in bounds if k is not None})
    step = len(keys) + 1
    # a place among the bounds as one number: an odd one for a bound's own token, even ones between; then the keys that aren't above
    edges = np.array(sorted((2 * bisect_left(starts, t) + 1) * step + (bisect_right(keys, k) if k is not None else 0) for t, k in bounds), dtype=np.int64)

    def rank(word: str) -> int:
        i = bisect_left(starts, word)
        return 2 * i + (i < len(starts) and starts[i] == word)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of some WORDS words, or one row."""
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_tokens")).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // WORDS, prepend=0))
            for lo, hi in zip([0, *at], [*at, len(sizes)], strict=True):
                if lo < hi:
                    yield batch.slice(lo, hi - lo)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            lists = batch.column("_tokens")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(code):
                continue
            if stemmed:
                again = pa.array([stemmed_word(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
                words, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            at = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            by_word, by_key = (pc.sort_indices(x).to_numpy() for x in (words, batch.column("key")))
            group = np.argsort(by_word)[code] * len(sizes) + np.repeat(np.argsort(by_key), sizes)
            order = np.argsort(group, kind="stable")  # by token and key, which the sort after the shuffle finds done in runs; places stay in order
            at, group = at[order], group[order]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            word, row = np.divmod(group[first], len(sizes))
            code, row = by_word[word].astype(np.int64), by_key[row].astype(np.int64)
            ranks = np.array([rank(w) for w in words.to_pylist()], dtype=np.int64)
            above = np.array([bisect_right(keys, k) if k is not None else 0 for k in batch.column("key").to_pylist()], dtype=np.int64)
            part = np.searchsorted(edges, ranks[code] * step + above[row], side="right").astype(np.int32)
            ends = np.append(first, len(at)).astype(np.int32)
            for i in range(0, len(first), WRITTEN):
                own = slice(i, i + WRITTEN)
                places = pa.ListArray.from_arrays(pa.array(ends[i : i + WRITTEN + 1] - ends[i]), pa.array(at[ends[i] : ends[min(i + WRITTEN, len(first))]]))
                taken = pa.array(row[own])
                yield pa.RecordBatch.from_arrays([pa.array(part[own]), words.take(pa.array(code[own])), *[batch.column(c).take(taken) for c in names], places], names=["_part", "token", *names, "at"])

    return work


def postings(df: DataFrame, key: str, text: Column, carry: tuple[str, ...] = (), stem: bool = False) -> DataFrame:
    """token, key, carried columns, at of the rows of df, in ranges of (token, key) and in that order.

    The places of a token in a row are put together where the row is read, so the shuffle has a row a posting and not one
    a word. Its parts are as many as the postings need to be sorted in memory, and df is tokenised once: where the parts
    begin is told by a sample. With stem, each different token of a batch is folded and stemmed once. Rows without tokens
    have no postings; rows that repeat a key count as one text each, whose places are put together.
    """
    rows = df.select(F.col(key).alias("key"), *carry, tokens(text).alias("_tokens"))
    keys = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    bounds = _bounds(df, F.col(key), text, keys[0] or 0)
    kinds = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("token", T.StringType()), *rows.drop("_tokens").schema.fields, T.StructField("at", T.ArrayType(T.IntegerType()))])
    found = rows.mapInArrow(_together(bounds, ["key", *carry], stem), kinds)
    dealt = found.repartitionById(len(bounds) + 1, F.col("_part")).drop("_part")
    if (keys[1] or 0) > 1:
        dealt = dealt.groupBy("token", "key", *carry).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
        dealt = dealt.repartitionByRange(len(bounds) + 1, "token", "key")
    return dealt.sortWithinPartitions("token", "key")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, df, low, high of runs of one token with keys that don't fall."""
    for batch in batches:
        token, key = batch.column("token"), batch.column("key")
        if len(token):
            parted = pc.or_(pc.not_equal(token[1:], token[:-1]), pc.less(key[1:], key[:-1])).fill_null(True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], parted)))
            ends = np.append(first[1:], len(token))
            yield pa.RecordBatch.from_arrays([token.take(pa.array(first)), pa.array(ends - first), key.take(pa.array(first)), key.take(pa.array(ends - 1))], names=["token", "df", "low", "high"])


def terms(rows: DataFrame) -> DataFrame:
    """token, df, low, high of a segment's postings: how many rows have the token, and the range of their keys; sorted by token.

    Postings lie in order, so what is grouped is a row a token and batch, and no posting is sorted again.
    """
    key = rows.schema["key"].dataType
    kinds = T.StructType([T.StructField("token", T.StringType()), T.StructField("df", T.LongType()), T.StructField("low", key), T.StructField("high", key)])
    found = rows.select("token", "key").mapInArrow(_runs, kinds).groupBy("token").agg(F.sum("df").alias("df"), F.min("low").alias("low"), F.max("high").alias("high"))
    return found.repartitionByRange("token").sortWithinPartitions("token")


def _begins(token: Column, start: str) -> Column:
    return (token >= start) & (token < start + _LAST)


@dataclass(frozen=True)
class TextIndex:
    """Postings of one table, and the name of the table's key; segments are (postings, terms) of each, if terms are kept."""

    postings: DataFrame
    key: str
    carry: tuple[str, ...] = ()
    segments: tuple[tuple[DataFrame, DataFrame], ...] = ()

    def frequencies(self, words: list[str]) -> list[dict]:
        """segment, token, df, low, high of the words where a segment has them, from the terms alone."""
        every = None
        for n, (_, own) in enumerate(self.segments):
            one = own.where(F.col("token").isin(words)).select(F.lit(n).alias("segment"), "token", "df", "low", "high")
            every = one if every is None else every.union(one)
        return [r.asDict() for r in every.collect()] if every is not None else []  # a row a word and segment at most

    def probe(self, words: list[str]) -> DataFrame:
        """token, df, segments of each word, 0 where no row has it; no posting is read."""
        found: dict[str, list[int]] = {w: [] for w in words}
        for r in self.frequencies(words):
            found[r["token"]].append(r["df"])
        rows = [(w, sum(n), len(n)) for w, n in sorted(found.items())]
        return self.postings.sparkSession.createDataFrame(rows, "token string, df long, segments int")

    def _rarest_first(self, words: list[str]) -> DataFrame | None:
        """Postings of the words in rows that have the rarest of them, of segments that have all; None if there are none."""
        by_segment: dict[int, dict[str, dict]] = {}
        for r in self.frequencies(words):
            by_segment.setdefault(r["segment"], {})[r["token"]] = r
        out = None
        for n, own in sorted(by_segment.items()):
            low, high = max(r["low"] for r in own.values()), min(r["high"] for r in own.values())
            if len(own) < len(words) or low > high:
                continue
            rows = self.segments[n][0].where(F.col("key").between(low, high))
            rare = min(own.values(), key=lambda r: (r["df"], r["token"]))
            of_rare = rows.where(F.col("token") == rare["token"])
            rest = [w for w in words if w != rare["token"]]
            others = rows.where(F.col("token").isin(rest))
            if rest and rare["df"] <= PROBED:
                keys = [r["key"] for r in of_rare.select("key").distinct().collect()]  # PROBED at most
                others = others.where(F.col("key").isin(keys))
            elif rest:
                others = others.join(of_rare.select("key"), "key", "left_semi").select(*rows.columns)
            one = of_rare.unionByName(others) if rest else of_rare
            out = one if out is None else out.unionByName(one)
        return out

    def _flags(self, phrases: list[list[str]], beginning: bool = False, read: DataFrame | None = None) -> DataFrame:
        """key, carried columns, c0, c1 .. (has the row each phrase?), and with beginning p (has it the last phrase, its last word as a beginning?).

        read has the postings to look at, if not all.
        """
        token = F.col("token")
        words = sorted({w for p in phrases for w in p})
        start = phrases[-1][-1]
        wanted = token.isin(words) | _begins(token, start) if beginning else token.isin(words)
        places = any(len(p) > 1 for p in phrases)
        rows = (self.postings if read is None else read).where(wanted).select("key", "token", *self.carry, *(["at"] if places else []))
        sums, number = [], {w: i for i, w in enumerate(words)}
        for w, i in number.items():
            sums.append((F.flatten(F.collect_list(F.when(token == w, F.col("at")))) if places else F.bool_or(token == w)).alias(f"w{i}"))
        if beginning:
            sums.append((F.flatten(F.collect_list(F.when(_begins(token, start), F.col("at")))) if places else F.bool_or(_begins(token, start))).alias("wp"))
        grouped = rows.groupBy("key", *self.carry).agg(*sums)

        def has(columns: list[str]) -> Column:
            if not places:
                return F.col(columns[0])
            rest = [F.col(c) for c in columns[1:]]
            if not rest:
                return F.size(columns[0]) > 0
            return F.exists(columns[0], lambda at: reduce(and_, [F.array_contains(c, at + 1 + k) for k, c in enumerate(rest)]))

        names = [[f"w{number[w]}" for w in p] for p in phrases]
        out = [has(n).alias(f"c{k}") for k, n in enumerate(names)]
        if beginning:
            out.append(has([*names[-1][:-1], "wp"]).alias("p"))
        return grouped.select("key", *self.carry, *out)

    def _all(self, phrases: list[list[str]]) -> Column:
        return reduce(and_, [F.col(f"c{k}") for k in range(len(phrases))])

    def _any(self, phrases: list[list[str]]) -> Column:
        return reduce(or_, [F.col(f"c{k}") for k in range(len(phrases))])

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("key", self.key)

    def none(self) -> DataFrame:
        return self._named(self.postings.where(F.lit(False)).select("key", *self.carry))

    def match_all(self, phrases: list[list[str]]) -> DataFrame:
        """Keys of rows that have every phrase; none for no phrases."""
        if not phrases:
            return self.none()
        read = None
        if self.segments:
            read = self._rarest_first(sorted({w for p in phrases for w in p}))
            if read is None:
                return self.none()
        return self._named(self._flags(phrases, read=read).where(self._all(phrases)).select("key", *self.carry))

    def match_any(self, phrases: list[list[str]]) -> DataFrame:
        return self._named(self._flags(phrases).where(self._any(phrases)).select("key", *self.carry)) if phrases else self.none()

    def tiers(self, phrases: list[list[str]]) -> DataFrame:
        """Keys with the strictest tier that the row meets, of rows that meet any. The last phrase's last word may be a beginning in the lowest."""
        if not phrases:
            return self.none().withColumn("tier", F.lit(0))
        flags = self._flags(phrases, beginning=True)
        low = F.col("p") if len(phrases) == 1 else self._any(phrases[:-1]) | F.col("p")
        tier = F.when(self._all(phrases), STRICT).when(self._any(phrases), OR).when(low, PREFIX).otherwise(0)
        return self._named(flags.select("key", *self.carry, tier.alias("tier")).where("tier > 0"))

    def ladder(self, phrases: list[list[str]]) -> DataFrame:
        """Keys of the strictest tier that has any, with that tier."""
        found = self.tiers(phrases)
        return found.where(F.col("tier") >= found.agg(F.max("tier")).scalar())

    def groups(self, phrases: list[list[str]], by: str) -> DataFrame:
        """Values of a carried column under which every phrase is met by some row."""
        if not phrases:
            return self.none().select(by)
        return self._flags(phrases).groupBy(by).agg(*[F.bool_or(f"c{k}").alias(f"c{k}") for k in range(len(phrases))]).where(self._all(phrases)).select(by)

    def group_rows(self, phrases: list[list[str]], by: str) -> DataFrame:
        """Keys of rows that have any phrase, under values of by that meet all."""
        return self.match_any(phrases).join(self.groups(phrases, by), by, "left_semi")
