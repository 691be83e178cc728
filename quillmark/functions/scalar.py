"""Small scalar functions: row hashes, file stamps, times in many spellings, fair shares, back-off."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(*parts: Column) -> Column:
    """A digest in which null differs from empty and parts can't run into each other."""
    end = F.lit("\x1e")
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")), end) for p in parts]), 256)


def fault_key(scope: Column, reason: Column, detail: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(x, F.lit("")) for x in (scope, reason, detail)]), 256)


def file_stamp(modified: Column, length: Column) -> Column:
    return F.concat(F.expr("0") if modified is None else (F.unix_micros(modified) * 1000).cast("string"), F.lit(":"), length.cast("string"))


def parse_time(text: Column) -> Column:
    """An instant from ISO 8601 with Z, an offset with or without colon, or none (UTC); null if it can't be read."""
    tidy = F.regexp_replace(F.btrim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(tidy)


def parse_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("long"))


def fair_share(lengths: Sequence[int], budget: int) -> list[int]:
    """The budget dealt so that no one gets more than asked and what the modest leave goes to the others."""
    out, left = [0] * len(lengths), max(0, budget)
    for dealt, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], left // (len(lengths) - dealt))
        left -= out[i]
    return out


def fair_shares(rows: DataFrame, asked: str, order: str, budget: int) -> DataFrame:
    """rows with share, a long: what fair_share gives rows in order of asked, then order (no nulls in either).

    Lengths up to the level get all they ask; the rest get the level, and the last of them one more while any is left.
    Sums run over different lengths, a row each; only rows of the one length at which "one more" begins are ranked.
    """
    sizes = rows.groupBy(F.col(asked).alias("_len")).agg(F.count("*").alias("_n"))
    up = Window.orderBy("_len")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(Window.partitionBy())
    rest = F.lit(max(0, budget)) - F.coalesce(F.sum(F.col("_len") * F.col("_n")).over(before), F.lit(0))
    after = n - F.coalesce(F.sum("_n").over(before), F.lit(0))  # rows of this length or more
    sizes = sizes.select("_len", "_n", rest.alias("_rest"), after.alias("_after"))
    first = F.min(F.when(F.col("_len") * F.col("_after") > F.col("_rest"), F.struct("_len", "_rest", "_after"))).over(Window.partitionBy())
    sizes = sizes.select("_len", "_n", "_after", first.alias("_cut"))
    level, more = F.expr("_cut._rest div _cut._after"), F.col("_cut._rest") % F.col("_cut._after")
    longer = F.col("_after") - F.col("_n")
    sizes = sizes.select("_len", (F.col("_len") >= F.col("_cut._len")).alias("_over"), level.alias("_level"), F.greatest(F.lit(0), more - longer).alias("_more"), F.col("_n"))
    all_or_none = rows.join(sizes, rows[asked] == F.col("_len"))
    part = (F.col("_over") & (F.col("_more") > 0) & (F.col("_more") < F.col("_n")))
    last = F.row_number().over(Window.partitionBy("_len").orderBy(F.col(order).desc())) <= F.col("_more")
    keep = [rows[c] for c in rows.columns]
    plain = F.when(F.col("_over"), F.col("_level") + (F.col("_more") >= F.col("_n")).cast("long")).otherwise(F.col("_len"))
    whole = all_or_none.where(~F.coalesce(part, F.lit(False))).select(*keep, plain.cast("long").alias("share"))
    split = all_or_none.where(part).select(*keep, (F.col("_level") + last.cast("long")).cast("long").alias("share"))
    return whole.union(split)


def backoff_seconds(failures: int, base: float, cap: float, rng: random.Random | None = None) -> float:
    """Full jitter: anywhere from 0 to the doubled and capped delay."""
    return (rng or random).uniform(0, min(cap, base * 2 ** max(0, failures)))


def overlap(first: Column, last: Column, low: Column | None, high: Column | None) -> Column:
    """Does [first, last] meet [low, high]? An open side meets all."""
    out = F.lit(True)
    if low is not None:
        out = out & (last >= low)
    if high is not None:
        out = out & (first <= high)
    return out
