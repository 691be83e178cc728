"""Writing rows of which some make their own parser or expression fail: halves until single rows are left.

The whole is tried first, so a sound input costs one job. If that fails, the rows are parted by the range of a hash of
their key and each half is parsed by itself, without the redaction and the write that cost most; halves that don't work are
parted again. What is left in the end are single rows, named with the errors of their own write, and all others are
written at once. If that fails too, or if all rows can be parsed, halves are written instead: those that work stay, the
others are parted. If nothing worked, the rows aren't to blame and the first error holds.

A half is a filter on a hash, which no reader can skip by, so each try of a small half would read all of the input. After
every few halvings what is left is therefore held in the executors' memory, as it was read and never on disk; what
memory doesn't hold is read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one table of a source may have set aside in a run; beyond it the source fails as a whole, loudly, with nothing stored.
MOST_POISON = 64
#: So many rows that fail before any works are an outage.
ALL_BAD = 8
#: Halvings after which the rows that are left are held in memory: an eighth of the input, then an eighth of that.
HELD_AFTER = 3
#: Errors that say nothing about rows.
OUTAGES = ("RecogniserUnavailable", "FileNotFoundException", "No space left", "SparkOutOfMemory", "Connection refused")


@dataclass(frozen=True)
class Rows:
    """Raw rows and how they are parsed, so that a row that its parser can't take can be left out before it.

    key names the columns that tell rows apart; all of them if it is empty. A parser works row by row.
    """

    raw: DataFrame
    parse: Callable[[DataFrame], DataFrame]
    key: tuple[str, ...] = ()

    def keyed(self) -> DataFrame:
        names = self.key or tuple(self.raw.columns)
        return self.raw.withColumn("_k", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in names]))


@dataclass
class Apart:
    """Tables that were written, and the hashes of rows that weren't, with their errors."""

    parts: list[DataFrame] = field(default_factory=list)
    bad: list[tuple[int, str, str]] = field(default_factory=list)


def _said(e: Exception) -> str:
    """The innermost cause in one line."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    causes = [x for x in lines if x.startswith("Caused by:") or "Error:" in x or x.startswith("[")]
    return (causes[0] if causes else lines[0] if lines else type(e).__name__)[:300]


def written_apart(keyed: DataFrame, parse: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame], most: int = MOST_POISON) -> Apart:
    """What write(parse(rows)) makes of keyed(_k, ..), in as many parts as it takes, without the rows that make it fail.

    A bad row among n takes some 1.5 * log2(n) parses of ever smaller halves. The first HELD_AFTER halvings read the input
    anew, three scans each; the others read what is held of it. Rows that can't be held, as they fail when they are read and
    not when they are parsed, are read anew each time. Rows that share a key stand and fall together.
    """
    out = Apart()
    single: list[int] = []  # hashes of rows that were tried by themselves
    holds, worked = True, False

    def whole(rows: DataFrame) -> None:
        out.parts.append(write(parse(rows.drop("_k"))))

    def parsed(rows: DataFrame) -> None:
        parse(rows.drop("_k")).write.format("noop").mode("overwrite").save()

    def failure(attempt: Callable[[DataFrame], None], rows: DataFrame) -> Exception | None:
        nonlocal worked
        try:
            attempt(rows)
            worked = True
        except Exception as e:
            if any(x in str(e) for x in OUTAGES):
                raise
            return e
        return None

    def span_of(rows: DataFrame) -> tuple[int | None, int | None]:
        return tuple(rows.agg(F.min("_k"), F.max("_k")).first())

    def halves(rows: DataFrame, error: Exception, attempt: Callable[[DataFrame], None], depth: int = 0) -> None:
        """Part rows, of which an attempt has failed; at the top it may have been another one."""
        nonlocal holds
        kept = rows.persist(StorageLevel.MEMORY_ONLY) if holds and depth and depth % HELD_AFTER == 0 else None
        try:
            try:
                span = span_of(rows)
            except Exception:
                if kept is None:
                    raise
                kept.unpersist()
                kept, holds = None, False
                span = span_of(rows)
            parted(rows, span, error, attempt, depth)
        finally:
            if kept is not None:
                kept.unpersist()

    def parted(rows: DataFrame, span: tuple[int | None, int | None], error: Exception, attempt: Callable[[DataFrame], None], depth: int) -> None:
        lo, hi = span
        if lo is None:
            return
        if lo == hi:
            single.append(lo)
            if attempt is parsed:
                error = failure(whole, rows)
            if error is not None:
                if len(out.bad) >= most or (len(out.bad) >= ALL_BAD and not worked):
                    raise error
                out.bad.append((lo, type(error).__name__, _said(error)))
            return
        middle = (lo + hi) // 2
        below, above = rows.where(F.col("_k") <= middle), rows.where(F.col("_k") > middle)
        first = failure(attempt, below)
        if first is not None:
            halves(below, first, attempt, depth + 1)
        # if rows that can't be parsed have a half that can be, the other half is the one
        second = error if first is None and attempt is parsed and depth else failure(attempt, above)
        if second is not None:
            halves(above, second, attempt, depth + 1)

    error = failure(whole, keyed)
    if error is not None:
        halves(keyed, error, parsed)
        rest = keyed.where(~F.col("_k").isin(single)) if single else keyed
        again = failure(whole, rest) if single else error
        if again is not None:
            halves(rest, again, whole)
        if not any(not p.isEmpty() for p in out.parts):
            raise error
    return out
