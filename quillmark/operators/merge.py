"""Upserts without a lakehouse: a full outer join of stored rows (those a batch touches are enough) and the batch, and counts of what it did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.redact import redact
from quillmark.functions.scalar import row_hash


class ShrinkError(ValueError):
    """A rebuild would leave too few rows."""


def coalesce_batch(batch: DataFrame, key: str, order: str, first: tuple[str, ...] = (), latest: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of a batch: the last by order, but the first known value of some columns and the last known of others."""
    last = F.max_by(F.struct(*batch.columns), F.col(order)).alias("row")
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in first]
    known += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in latest]
    pick = lambda c: F.col(f"_first_{c}") if c in first else F.col(f"_last_{c}") if c in latest else F.col(f"row.{c}")
    return batch.groupBy(key).agg(last, *known).select(*[pick(c).alias(c) for c in batch.columns])


def changes(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch with change: added, updated or unchanged, by hash."""
    old = stored.select(F.col(key).alias("_key"), F.col("src_hash").alias("_hash"))
    joined = batch.join(old, batch[key] == old["_key"], "left")
    change = F.when(F.col("_key").isNull(), "added").when(F.col("_hash").eqNullSafe(F.col("src_hash")), "unchanged").otherwise("updated")
    return joined.withColumn("change", change).drop("_key", "_hash")


def write_counts(changed: DataFrame) -> DataFrame:
    """added, updated, unchanged; unchanged rows are part of updated, as the run reports count them."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changed.agg(n("added").alias("added"), n("updated", "unchanged").alias("updated"), n("unchanged").alias("unchanged"))


def upsert_records(stored: DataFrame, batch: DataFrame, layer: Callable[[Column], Column] = redact) -> DataFrame:
    """created_at keeps the first known value and updated_at takes the latest; source and llm tags of stored rows stay.

    Only rows whose hash moved go through the layer, so the costly expression runs on changes alone.
    """
    new = batch.withColumn("subject", F.col("subject")).alias("n")
    old = stored.alias("o")
    joined = old.join(new, F.col("o.stable_id") == F.col("n.stable_id"), "full_outer")
    moved = F.col("n.stable_id").isNotNull() & ~F.coalesce(F.col("o.src_hash").eqNullSafe(F.col("n.src_hash")) & F.col("o.stable_id").isNotNull(), F.lit(False))

    def column(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ("stable_id", "source", "created_at"):
            return F.coalesce(o, n)
        if c in ("llm_tags", "llm_tags_src_hash"):
            return F.when(F.col("o.stable_id").isNotNull(), o).otherwise(n)
        if c == "updated_at":
            return F.greatest(o, n)
        return F.when(moved, layer(n) if c in ("subject", "body") else n).otherwise(o)

    return joined.select(*[column(c).alias(c) for c in stored.columns])


def upsert_entities(stored: DataFrame, batch: DataFrame, key: str, layer: Callable[[Column], Column] = redact) -> DataFrame:
    """Last write wins by hash; times never turn null; provenance is outside the hash and fills in when it was unknown."""
    new, old = batch.alias("n"), stored.alias("o")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, come = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    moved = come & ~F.coalesce(there & F.col("o.src_hash").eqNullSafe(F.col("n.src_hash")), F.lit(False))

    def column(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(n, o)
        if c == "provenance":
            return F.coalesce(n, o)
        if c in ("ts", "first_ts", "last_ts"):
            return F.when(moved, F.coalesce(n, o)).otherwise(o)
        return F.when(moved, layer(n) if c == "body" else n).otherwise(o)

    return joined.select(*[column(c).alias(c) for c in stored.columns])


def with_hash(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("src_hash", row_hash(*[F.col(c) for c in columns]))


def changed_only(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the batch that the stored table doesn't have as they are."""
    return batch.join(stored.select(key, "src_hash"), [key, "src_hash"], "left_anti")


def guard_shrink(before: int, after: int, force: bool = False, floor: int = 100, share: float = 0.8) -> None:
    if not force and before > floor and after < share * before:
        raise ShrinkError(f"the rebuild would keep {after} of {before} rows")


def rebuild(stored: DataFrame, fresh: DataFrame, scope: str, value: str, force: bool = False) -> DataFrame:
    """The table with all rows of one source or origin replaced; refuses rows of another and a great loss."""
    strays = fresh.where(~F.col(scope).eqNullSafe(F.lit(value)))
    if not strays.isEmpty():
        raise ValueError(f"rows outside {scope} {value!r} in a rebuild of it")
    guard_shrink(stored.where(F.col(scope) == value).count(), fresh.count(), force)
    return stored.where(~F.coalesce(F.col(scope) == value, F.lit(False))).unionByName(fresh.select(*stored.columns))


def rescrub(stored: DataFrame, key: str = "obs_id", layer: Callable[[Column], Column] = redact) -> DataFrame:
    """Keys, old and new bodies of rows that today's rules would change."""
    return stored.select(key, F.col("body").alias("old_body"), layer(F.col("body")).alias("body")).where("body <> old_body")


def rescrub_rows(stored: DataFrame, columns: tuple[str, ...], layer: Callable[[Column], Column] = redact) -> DataFrame:
    """Whole rows that the layer would change, changed. As the version that was read goes with the commit, no later text is lost."""
    new = {c: layer(F.col(c)) for c in columns}
    marked = stored.withColumns({f"_new_{c}": x for c, x in new.items()})
    moved = F.lit(False)
    for c in columns:
        moved = moved | ~F.col(f"_new_{c}").eqNullSafe(F.col(c))
    return marked.where(moved).select(*[F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in stored.columns])
