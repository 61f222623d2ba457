"""Running values over ordered groups of any size.

The rows are written once and keys are counted. Keys of ordinary size go through one hash window: one
exchange and one sort. A plain window would put a hot key into one task, so the rows of keys that hold more than a
thousandth of all rows (a thousand keys at most) are dealt into ranges of (key, order) instead, which follow the
data's own distribution: sparse, dense or interleaved order numbers give ranges of like size. What
earlier ranges of a key hand over is worked out on one row per (key, range), of which there are at most as
many as ranges and keys together, and per key no more than ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import settle

RANGE, SLOT = "_range", "_slot"
#: A key with fewer rows is never hot; one with more is if it holds more than this share of all rows.
ROWS_PER_TASK, HOT_SHARE = 1_000_000, 1000


def in_ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df``, written, with the struct of its keys and of the number of its range of (key, order).

    There are ``parts`` ranges, else as many as shuffle partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order)
    # a struct is never NULL, so joins by it match NULL keys
    return settle(dealt.withColumn(SLOT, F.struct(*keys, F.spark_partition_id().alias(RANGE))), "ranges")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> list[Column]:
    return [left[key].eqNullSafe(right[key]) for key in keys]


def hot_keys(rows: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame | None:
    """The keys with more rows than a task should sort, ``HOT_SHARE`` at most, or None. ``rows`` is a written table."""
    total = rows.count()
    if total <= rows_per_task:
        return None
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(sizes.filter(F.col("_n") > max(rows_per_task, total // HOT_SHARE)).select(*keys), "hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None,
    attach: DataFrame | None = None,
    parts: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add values per key, in order, without one task per hot key.

    ``totals`` are sums up to and including the row; ``previous`` is the last
    non-NULL value of the rows before, NULL when there is none; ``least`` is the
    smallest value of the whole key. ``attach`` (unique on ``keys``) is joined. ``parts`` puts all keys through so many
    ranges.
    """
    totals, previous, least = totals or {}, previous or {}, least or {}
    values = {f"_of_{name}": value for name, value in {**totals, **previous, **least}.items()}
    names = (df.columns, keys, order, list(totals), list(previous), list(least), attach)
    if parts is not None:
        return _in_ranges(df.withColumns(values), *names, parts)
    rows = settle(df.withColumns(values), "scan")
    hot = hot_keys(rows, keys, rows_per_task)
    if hot is None:
        return _in_windows(rows, *names)
    same = same_keys(rows, hot, keys)
    return _in_windows(rows.join(hot, same, "left_anti"), *names).unionByName(_in_ranges(rows.join(hot, same, "left_semi"), *names, None))


def _in_windows(rows: DataFrame, columns: list[str], keys: list[str], order: list[str], totals, previous, least, attach) -> DataFrame:
    whole = Window.partitionBy(*keys)
    inside = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        *columns,
        *[F.sum(f"_of_{name}").over(inside).alias(name) for name in totals],
        *[F.last(f"_of_{name}", ignorenulls=True).over(before).alias(name) for name in previous],
        *[F.min(f"_of_{name}").over(whole).alias(name) for name in least],
    )
    if attach is None:
        return out
    attached = [c for c in attach.columns if c not in keys]
    return out.join(attach, same_keys(out, attach, keys), "left").select(*[out[c] for c in out.columns], *[attach[c] for c in attached])


def _in_ranges(rows: DataFrame, columns: list[str], keys: list[str], order: list[str], totals, previous, least, attach, parts) -> DataFrame:
    """The same by ranges; ``attach`` is joined at range level, so that a hot key does not meet in one task."""
    rows = in_ranges(rows, keys, order, parts)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    last = {
        name: F.max_by(f"_of_{name}", F.when(F.col(f"_of_{name}").isNotNull(), position)) for name in previous
    }
    summary = rows.groupBy(SLOT).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_of_{name}").alias(f"_sum_{name}") for name in totals],
        *[value.alias(f"_end_{name}") for name, value in last.items()],
        *[F.min(f"_of_{name}").alias(f"_min_{name}") for name in least],
    )
    whole = Window.partitionBy(*[F.col(SLOT)[key] for key in keys])
    earlier = whole.orderBy(F.col(SLOT)[RANGE]).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        SLOT,
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_sum_{name}") for name in totals],
        *[F.last(f"_end_{name}", ignorenulls=True).over(earlier).alias(f"_end_{name}") for name in previous],
        *[F.min(f"_min_{name}").over(whole).alias(name) for name in least],
    )
    attached = [c for c in (attach.columns if attach is not None else []) if c not in keys]
    if attach is not None:
        same = [F.col(SLOT)[key].eqNullSafe(attach[key]) for key in keys]
        carry = carry.join(attach, same, "left").drop(*[attach[key] for key in keys])
    inside = Window.partitionBy(SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.drop(*[key for key in keys if key not in order]).withColumns({
        **{f"_run_{name}": F.sum(f"_of_{name}").over(inside) for name in totals},
        **{f"_lag_{name}": F.last(f"_of_{name}", ignorenulls=True).over(before) for name in previous},
    })
    return local.join(carry, SLOT, "left").select(
        *[F.col(SLOT)[c].alias(c) if c in keys else F.col(c) for c in columns],
        *[(F.col(f"_run_{name}") + F.col(f"_sum_{name}")).alias(name) for name in totals],
        *[F.coalesce(f"_lag_{name}", f"_end_{name}").alias(name) for name in previous],
        *least,
        *attached,
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str], target: Column, parts: int | None = None) -> DataFrame:
    """Each key's first ``target`` rows in order, without ranking the others.

    The rows are written in ranges of (key, order). Counts per key and range tell which ranges hold a
    key's first rows; only those are read again and only their rows ranked, each within its range. A
    range that lies wholly within the target needs no ranking either, but costs none: it is one window with the rest.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_target", target).repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id())
    rows = settle(dealt, "ranges", RANGE)
    counts = rows.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_rows"), F.max("_target").alias("_target"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_target") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    wanted = settle(counts.select(*keys, RANGE, room.alias("_room")).filter("_room > 0"), "wanted")
    ranges = [row[RANGE] for row in wanted.select(RANGE).distinct().collect()]  # as many as there are ranges at most
    chosen = rows.filter(F.col(RANGE).isin(ranges)).drop("_target")
    left = chosen.join(wanted, [*same_keys(chosen, wanted, keys), chosen[RANGE] == wanted[RANGE]]).select(*[chosen[c] for c in chosen.columns], "_room")
    place = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))
    return left.withColumn("_place", place).filter("_place <= _room").select(*df.columns)
