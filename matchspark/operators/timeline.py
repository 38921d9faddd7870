"""Time-axis building blocks shared by every operator.

A match can hold any share of the data, so nothing here sends a whole match to
one task. Four shapes cover the library:

``interval_join``  overlap join on (key, time bin); each pair is reported once.
``halo``           rows copied into neighbouring time blocks, for windows whose
                   reach is bounded in time.
``scan``           running aggregates over an unbounded reach, as a window inside
                   (key, block) plus a carry taken from one summary row per block.
``islands``        maximal runs of overlapping intervals, built on ``scan``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: default block of the two-level scan, in milliseconds of media time. Small, so that a
#: match holding a third of all rows still splits into thousands of windows; the carry
#: then walks at most one row per second of footage.
BLOCK_MS = 1_000
#: default bin of the overlap join
BIN_MS = 20_000


def block_of(t: Column, width: int) -> Column:
    """Index of the fixed-width block holding ``t``."""
    return F.floor(t / F.lit(width)).cast("long")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_ms: int = BIN_MS,
    how: str = "inner",
) -> DataFrame:
    """Pairs whose half-open spans intersect, within ``keys``.

    Both sides are copied into the bins they touch and equi-joined on
    ``(keys, bin)``; a pair is kept only in the bin holding the later of the two
    starts, so it appears once. Column names other than ``keys`` must differ.
    Only ``inner`` pairs are produced; outer rows are the caller's anti join.
    """
    if how != "inner":
        raise ValueError("interval_join yields inner pairs only")
    ls, le = left_span
    rs, re = right_span

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(F.col(e) - 1, F.col(s))
        return df.where(F.col(e) >= F.col(s)).withColumn(
            "_bin", F.explode(F.sequence(block_of(F.col(s), bin_ms), block_of(last, bin_ms)))
        )

    pairs = binned(left, ls, le).join(binned(right, rs, re), [*keys, "_bin"])
    later = F.greatest(F.col(ls), F.col(rs))
    return pairs.where(
        (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (block_of(later, bin_ms) == F.col("_bin"))
    ).drop("_bin")


def reach_block(tol_ms: int) -> int:
    """Block width for a bounded reach: wide enough that few rows are copied."""
    return max(BLOCK_MS, 2 * tol_ms)


def halo(df: DataFrame, t: str, before_ms: int, after_ms: int, block_ms: int) -> DataFrame:
    """Copy each row into every block that must see it.

    A window partitioned by ``(keys, _block)`` then sees all rows up to
    ``before_ms`` earlier and ``after_ms`` later than any home row. Keep rows
    with ``_home`` after the window.
    """
    col = F.col(t)
    return (
        df.withColumn(
            "_block",
            F.explode(F.sequence(block_of(col - after_ms, block_ms), block_of(col + before_ms, block_ms))),
        )
        .withColumn("_home", F.col("_block") == block_of(col, block_ms))
    )


_TOTAL = {
    "sum": lambda c, o: F.sum(c),
    "count": lambda c, o: F.count(c),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
    "last": lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
    "first": lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)),
}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(a, b),
    "first": lambda a, b: F.coalesce(a, b),
}
_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _merge(side: str, kind: str, local: Column, carry: Column) -> Column:
    far_side_wins = (kind == "first" and side != "a") or (kind == "last" and side == "a")
    return _MERGE[kind](carry, local) if far_side_wins else _MERGE[kind](local, carry)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    prior: dict[str, tuple[str, Column]] | None = None,
    upto: dict[str, tuple[str, Column]] | None = None,
    after: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running aggregates along ``order`` within ``keys`` without one task per key.

    ``block`` must not decrease along ``order``. Each spec is ``name: (kind,
    column)`` with kind sum, count, max, min, last or first (the last two skip
    nulls). ``prior`` looks at rows strictly before the current one, ``upto``
    includes it, ``after`` looks strictly past it.

    The window runs inside ``(keys, block)``. What earlier (or later) blocks
    contribute comes from one summary row per block, which partial aggregation
    makes small before it is shuffled.
    """
    prior, upto, after = prior or {}, upto or {}, after or {}
    rows = df.withColumn("_blk", block)
    whole = F.struct(*[F.col(c) for c in order])
    specs = [("p", n, *s) for n, s in prior.items()]
    specs += [("u", n, *s) for n, s in upto.items()]
    specs += [("a", n, *s) for n, s in after.items()]

    part = [*keys, "_blk"]
    inner = Window.partitionBy(*part).orderBy(*order)
    span = {
        "p": inner.rowsBetween(Window.unboundedPreceding, -1),
        "u": inner.rowsBetween(Window.unboundedPreceding, 0),
        "a": inner.rowsBetween(1, Window.unboundedFollowing),
    }
    outer = Window.partitionBy(*keys).orderBy("_blk")
    reach = {
        "p": outer.rowsBetween(Window.unboundedPreceding, -1),
        "u": outer.rowsBetween(Window.unboundedPreceding, -1),
        "a": outer.rowsBetween(1, Window.unboundedFollowing),
    }
    summary = rows.groupBy(*part).agg(*[_TOTAL[k](c, whole).alias(f"_t_{n}") for _, n, k, c in specs])
    carry_kind = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": _LOCAL["last"], "first": _LOCAL["first"]}
    carry = summary.select(
        *part, *[carry_kind[k](F.col(f"_t_{n}")).over(reach[side]).alias(f"_c_{n}") for side, n, k, _ in specs]
    )
    local = rows.select("*", *[_LOCAL[k](c).over(span[side]).alias(f"_l_{n}") for side, n, k, c in specs])
    named = carry.select(*[F.col(c).alias(f"_k_{c}") for c in part], *[f"_c_{n}" for _, n, _, _ in specs])
    alike = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
    joined = local.join(named, alike, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(side, k, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for side, n, k, _ in specs],
    )


def islands(
    df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], block_ms: int = BLOCK_MS
) -> DataFrame:
    """Add ``island``: the running number of maximal overlapping runs.

    A row opens a new island when it starts at or after every earlier end.
    """
    blk = block_of(F.col(start), block_ms)
    seen = scan(df, keys, [start, *order], blk, prior={"_reach": ("max", F.col(end))})
    opened = seen.withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0)
    )
    return scan(opened, keys, [start, *order], blk, upto={"island": ("sum", F.col("_open"))}).drop("_open", "_reach")


def covered_length(
    df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], block_ms: int = BLOCK_MS
) -> DataFrame:
    """Add ``new_ms``: the part of each interval no earlier interval covers.

    Summing ``new_ms`` over any prefix-closed group gives its union length.
    """
    blk = block_of(F.col(start), block_ms)
    seen = scan(df, keys, [start, *order], blk, prior={"_reach": ("max", F.col(end))})
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start))))
    return seen.withColumn("new_ms", fresh).drop("_reach")


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    tol_ms: int,
    carry: Sequence[str],
    block_ms: int | None = None,
) -> DataFrame:
    """As-of match on both sides: the ``right`` row closest in time, within ``tol_ms``.

    Ties go to the earlier row. Adds ``near_ms`` and each ``carry`` column (null
    when nothing is near). Right rows are copied only across block edges, and
    both sides meet in one sorted window, so no pairs are formed.
    """
    block_ms = block_ms or reach_block(tol_ms)
    probe = left.select("*", F.lit(1).alias("_side"), F.col(left_t).alias("_t")).withColumn(
        "_block", block_of(F.col("_t"), block_ms)
    )
    payload = F.struct(F.col(right_t).alias("near_ms"), *[F.col(c) for c in carry])
    base = halo(right.select(*keys, F.col(right_t).alias("_t"), payload.alias("_hit")), "_t", tol_ms, tol_ms, block_ms)
    both = probe.unionByName(base.drop("_home").withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy("_t", "_side")
    back = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fwd = F.first("_hit", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = both.withColumn("_back", back).withColumn("_fwd", fwd).where("_side = 1")
    gap_b, gap_f = F.col("_t") - F.col("_back.near_ms"), F.col("_fwd.near_ms") - F.col("_t")
    best = F.when(gap_b.isNotNull() & (gap_f.isNull() | (gap_b <= gap_f)), F.col("_back")).otherwise(F.col("_fwd"))
    kept = F.when(F.least(gap_b, gap_f) <= tol_ms, best)
    return (
        marked.withColumn("_best", kept)
        .select(*left.columns, "_best.near_ms", *[F.col(f"_best.{c}").alias(c) for c in carry])
    )


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint union of the intervals of each key, as ``(keys, start, end)``."""
    spans = df.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    runs = islands(spans, keys, start, end, [end])
    return runs.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covered_by(
    windows: DataFrame, spans: DataFrame, keys: Sequence[str], window: tuple[str, str], span: tuple[str, str],
    window_id: Sequence[str], name: str = "covered_ms",
) -> DataFrame:
    """Add how much of each window the union of ``spans`` covers.

    The spans are merged first, so intersections can simply be summed.
    """
    ws, we = window
    merged = merge_intervals(spans.select(*keys, F.col(span[0]).alias("_s"), F.col(span[1]).alias("_e")), keys, "_s", "_e")
    cut = interval_join(windows.select(*dict.fromkeys([*keys, *window_id, ws, we])), merged, keys, window, ("_s", "_e"))
    part = F.least(F.col(we), F.col("_e")) - F.greatest(F.col(ws), F.col("_s"))
    by = list(dict.fromkeys([*keys, *window_id]))
    total = cut.groupBy(*by).agg(F.sum(part).alias(name))
    return windows.join(total, by, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def asof_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, tol_ms: int,
    carry: Sequence[str], side: str, block_ms: int | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """The last ``right`` row at or before ``left_t`` (``side="before"``), or the first at
    or after it (``side="after"``), if it lies within ``tol_ms``. Adds ``<side>_ms`` and
    ``<side>_<carry>`` columns. Right rows at the same time are in the order of ``ties``.
    """
    back = side == "before"
    block_ms = block_ms or reach_block(tol_ms)
    probe = left.select("*", F.lit(1 if back else 0).alias("_side"), F.col(left_t).alias("_t")).withColumn(
        "_block", block_of(F.col("_t"), block_ms)
    )
    payload = F.struct(F.col(right_t).alias("t"), *[F.col(c) for c in carry], *[F.col(c).alias(f"_tie_{c}") for c in ties])
    reach = (0, tol_ms) if not back else (tol_ms, 0)
    seen = halo(right.select(*keys, F.col(right_t).alias("_t"), payload.alias("_hit")), "_t", reach[0], reach[1], block_ms)
    both = probe.unionByName(seen.drop("_home").withColumn("_side", F.lit(0 if back else 1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy("_t", "_side", *[F.col(f"_hit._tie_{c}") for c in ties])
    if back:
        hit = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        gap = F.col("_t") - F.col("_found.t")
    else:
        hit = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        gap = F.col("_found.t") - F.col("_t")
    mine = F.lit(1 if back else 0)
    rows = both.withColumn("_found", hit).where(F.col("_side") == mine)
    kept = F.when(gap <= tol_ms, F.col("_found"))
    return rows.withColumn("_kept", kept).select(
        *left.columns, F.col("_kept.t").alias(f"{side}_ms"), *[F.col(f"_kept.{c}").alias(f"{side}_{c}") for c in carry]
    )


def fold(df: DataFrame, keys: Sequence[str], row: Column, init: Column, step, name: str = "state") -> DataFrame:
    """Ordered fold of each key's rows inside the JVM: ``row`` sorts by its leading fields.

    The rows of a key are held in one array, so callers must have bounded them:
    by a budget, by a physical limit of the key, or by splitting it first.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_q")).select(
        *keys, F.aggregate("_q", init, step).alias(name)
    )
