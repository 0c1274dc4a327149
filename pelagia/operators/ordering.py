"""Totals, positions, ranks and quantiles along an order, without one task per group.

A plain window puts a whole group into one task.  Groups above ``HOT_ROWS`` rows are instead
cut into slices by range partitioning: every slice is summed on its own, and the slices'
offsets (at most one row per slice boundary) are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelagia.cluster import all_null_safe, broadcast_if_small, settle

HOT_ROWS = 2_000_000
DEEP_OFFSET = 100_000
_SLICE, _SLICE_AT, _OFFSET = "_slice", "_slice_at", "_slice_offset"


def _order(columns: list) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in columns]


def running_total(frame: DataFrame, segment: list[str], order: list, weight: Column, out: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inclusive running sum of ``weight`` per segment along a total ``order``."""
    sizes = frame.groupBy(*segment).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.filter(F.col("_rows") > hot_rows).select(*segment, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return _by_window(frame, segment, order, weight, out)
    if not segment:
        return _by_slices(frame, segment, order, weight, out)
    # Hot segments are few by construction: at most rows / hot_rows of them.
    keys = F.broadcast(settle(hot))
    on = all_null_safe(frame, keys, [(s, s) for s in segment])
    cold = frame.join(keys, on, "left_anti")
    warm = frame.join(keys, on, "left_semi")
    return (_by_window(cold, segment, order, weight, out)
            .unionByName(_by_slices(warm, segment, order, weight, out)))


def _by_window(frame, segment, order, weight, out):
    span = (W.partitionBy(*segment).orderBy(*_order(order))
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    return frame.withColumn(out, F.sum(weight).over(span))


def _by_slices(frame, segment, order, weight, out):
    keys = [F.col(s) for s in segment] + _order(order)
    # The slice number must not change between the two reads below, hence the checkpoint.
    sliced = settle(frame.withColumn("_weight", weight).repartitionByRange(*keys)
                    .withColumn(_SLICE, F.spark_partition_id()))
    local = (W.partitionBy(_SLICE, *segment).orderBy(*_order(order))
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = sliced.groupBy(*segment, _SLICE).agg(F.sum("_weight").alias("_part"))
    before = (W.partitionBy(*segment).orderBy(_SLICE)
              .rowsBetween(W.unboundedPreceding, -1))
    offsets = (parts.withColumn(_OFFSET, F.sum("_part").over(before))
               .filter(F.col(_OFFSET).isNotNull())
               .select(*[F.col(s).alias(f"_{s}") for s in segment],
                       F.col(_SLICE).alias(_SLICE_AT), _OFFSET))
    # A segment continues into a slice at most once per slice, so offsets stay below the
    # number of shuffle partitions.
    offsets = F.broadcast(offsets)
    on = sliced[_SLICE] == offsets[_SLICE_AT]
    if segment:
        on = on & all_null_safe(sliced, offsets, [(s, f"_{s}") for s in segment])
    joined = sliced.join(offsets, on, "left")
    total = F.sum("_weight").over(local) + F.coalesce(F.col(_OFFSET), F.lit(0))
    return (joined.withColumn(out, total)
            .drop("_weight", _SLICE, _OFFSET, _SLICE_AT, *[f"_{s}" for s in segment]))


def numbered(frame: DataFrame, segment: list[str], order: list, out: str, start: int = 0,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """0-based (or ``start``-based) row number per segment."""
    counted = running_total(frame, segment, order, F.lit(1).cast("long"), out, hot_rows)
    return counted.withColumn(out, F.col(out) - F.lit(1 - start))


def quantiles(frame: DataFrame, segment: list[str], value: str, probs: dict[str, float],
              weight: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per segment; nulls are left out.

    ``weight`` names a column of counts.  Up to ``hot_rows`` rows the built-in aggregate holds
    each segment's values; above, positions are found along a distributed order.
    """
    kept = frame.filter(F.col(value).isNotNull())
    if kept.count() <= hot_rows:
        share = F.array(*[F.lit(float(p)) for p in probs.values()])
        found = F.percentile(value, share, F.lit(1) if weight is None else F.col(weight))
        rows = kept.groupBy(*segment).agg(found.alias("_q"))
        return rows.select(*segment, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = settle(kept.groupBy(*segment, value).agg(times.alias("_n")))
    upto = running_total(counts, segment, [value], F.col("_n"), "_upto", hot_rows)
    totals = counts.groupBy(*segment).agg((F.sum("_n") - 1).alias("_last"))
    totals = totals.select(*[F.col(s).alias(f"_{s}") for s in segment], "_last")
    totals = broadcast_if_small(totals)
    on = all_null_safe(upto, totals, [(s, f"_{s}") for s in segment])
    placed = upto.join(totals, on)
    picks = []
    for name, p in probs.items():
        spot = F.col("_last") * F.lit(float(p))
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_{name}_part"))
    result = placed.groupBy(*segment).agg(*picks)
    return result.select(*segment, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
        for n in probs])


def average_ranks(frame: DataFrame, value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank and number of rows ``_ties``."""
    counts = settle(frame.groupBy(value).agg(F.count(F.lit(1)).alias("_ties")))
    upto = running_total(counts, [], [value], F.col("_ties"), "_upto", hot_rows)
    return upto.select(value, "_ties",
                       (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(out))


def window_rank(value: str) -> Column:
    """Tie-averaged 1-based rank over a frame small enough for one ordered window."""
    ties = F.count(F.lit(1)).over(W.partitionBy(value))
    return F.rank().over(W.orderBy(value)) + (ties - 1) / F.lit(2.0)


def attach_by_value(frame: DataFrame, lookup: DataFrame, value: str, weight: str,
                    share_of: int = 1000) -> DataFrame:
    """Inner join on a value whose frequent entries (known from ``weight``) are broadcast."""
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // share_of, 1)
    # Entries above total / share_of rows: fewer than share_of of them can exist.
    frequent = F.broadcast(lookup.filter(F.col(weight) > limit))
    rare = lookup.filter(F.col(weight) <= limit)
    kept = frame.join(frequent.select(value), value, "left_anti")
    return frame.join(frequent, value).unionByName(kept.join(rare, value))


def lookup(frame: DataFrame, table: DataFrame, on: list[tuple[str, str]],
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join with a table unique on its keys; keys frequent in ``frame`` are broadcast."""
    keys = [a for a, _ in on]
    hot = (frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
           .filter(F.col("_rows") > hot_rows)
           .select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)]))
    condition = [F.col(a) == F.col(b) for a, b in on]
    if hot.isEmpty():
        return frame.join(table, condition, "left")
    hot = F.broadcast(settle(hot))
    is_hot = [F.col(a).eqNullSafe(F.col(f"_hot_{i}")) for i, a in enumerate(keys)]
    in_table = [F.col(b) == F.col(f"_hot_{i}") for i, (_, b) in enumerate(on)]
    few = F.broadcast(table.join(hot, in_table, "left_semi"))
    return (frame.join(hot, is_hot, "left_semi").join(few, condition, "left")
            .unionByName(frame.join(hot, is_hot, "left_anti").join(table, condition, "left")))


def page(frame: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order; a deep offset is found by position instead of by top-k."""
    if offset + limit <= DEEP_OFFSET:
        return frame.orderBy(*_order(order)).offset(offset).limit(limit)
    placed = numbered(frame, [], order, "_at", hot_rows=DEEP_OFFSET)
    inside = placed.filter(F.col("_at").between(offset, offset + limit - 1))
    return inside.orderBy("_at").drop("_at")


def page_summary(frame: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row beside a page: its offset and limit, and the number of all rows."""
    return frame.agg(F.count("*").alias("total")).select(
        F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "total")
