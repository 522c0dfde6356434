"""Null-safe window and arithmetic helpers (the pandas-compatible contract).

Rules implemented here once, used everywhere:

* missing values are SQL NULL, never NaN (``nan_to_null`` at load);
* a rolling statistic over ``n`` rows is NULL unless all ``n`` rows of the
  frame hold a value (pandas ``rolling(n)`` with ``min_periods = n``);
* division goes through ``try_divide`` (NULL instead of +-inf / error);
* 0/1 flags treat NULL as false;
* centred frames use the pandas offsets ``[-(n//2), n - 1 - n//2]``.

All windows are partitioned by the series key and ordered by the time
column, so one shuffle on the key serves every window in a select.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "series_id"
TS = "date"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered(key: str = KEY, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def whole(key: str = KEY) -> WindowSpec:
    """Every row of the series (partition-level statistic)."""
    return Window.partitionBy(key)


def trailing(n: int, key: str = KEY, ts: str = TS) -> WindowSpec:
    return ordered(key, ts).rowsBetween(-(n - 1), 0)


def centered(n: int, key: str = KEY, ts: str = TS) -> WindowSpec:
    return ordered(key, ts).rowsBetween(-(n // 2), n - 1 - n // 2)


def running(key: str = KEY, ts: str = TS) -> WindowSpec:
    return ordered(key, ts).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Column, c, frame: WindowSpec, n: int) -> Column:
    """``agg`` over ``frame`` only when the frame holds ``n`` non-null values."""
    return F.when(F.count(col(c)).over(frame) == n, agg.over(frame))


def roll_sum(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.sum(col(c)), c, trailing(n, key, ts), n)


def roll_mean(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.avg(col(c)), c, trailing(n, key, ts), n)


def roll_std(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.stddev_samp(col(c)), c, trailing(n, key, ts), n)


def roll_min(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.min(col(c)), c, trailing(n, key, ts), n)


def roll_max(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.max(col(c)), c, trailing(n, key, ts), n)


def center_mean(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.avg(col(c)), c, centered(n, key, ts), n)


def center_std(c, n: int, key: str = KEY, ts: str = TS) -> Column:
    return full(F.stddev_samp(col(c)), c, centered(n, key, ts), n)


def cumsum(c, key: str = KEY, ts: str = TS) -> Column:
    """pandas ``cumsum``: skips NULL in the running total, NULL at NULL rows."""
    return F.when(col(c).isNotNull(), F.sum(col(c)).over(running(key, ts)))


def lag(c, n: int = 1, key: str = KEY, ts: str = TS) -> Column:
    return F.lag(col(c), n).over(ordered(key, ts))


def lead(c, n: int = 1, key: str = KEY, ts: str = TS) -> Column:
    return F.lead(col(c), n).over(ordered(key, ts))


def diff(c, n: int = 1, key: str = KEY, ts: str = TS) -> Column:
    return col(c) - lag(c, n, key, ts)


def ffill(c, key: str = KEY, ts: str = TS) -> Column:
    return F.last(col(c), ignorenulls=True).over(running(key, ts))


def running_desc(key: str = KEY, ts: str = TS) -> WindowSpec:
    """Growing frame in descending time order: "this row and all later rows"
    as an incrementally maintained frame.  (A ``[current, unbounded
    following]`` frame is recomputed for every row, O(n^2) per series.)"""
    return Window.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)


def bfill(c, key: str = KEY, ts: str = TS) -> Column:
    return F.last(col(c), ignorenulls=True).over(running_desc(key, ts))


def with_pct_change(df, c: str, n: int, out: str, key: str = KEY, ts: str = TS):
    tmp = f"__ff_{c}"
    return (df.withColumn(tmp, ffill(c, key, ts))
              .withColumn(out, F.try_divide(F.col(tmp), lag(tmp, n, key, ts)) - F.lit(1.0))
              .drop(tmp))


def tdiv(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """0/1 int; NULL (pandas NaN comparison) counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c, lo=None, hi=None) -> Column:
    """NULL-preserving clip (``least``/``greatest`` alone would skip NULL)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def streak(flag_col, key: str = KEY, ts: str = TS) -> Column:
    """Consecutive rows (ending here) where ``flag_col`` is 1; 0 where it is 0.

    Gaps-and-islands without a second partitioning: the row number minus the
    row number of the latest 0-row seen so far. One window spec, no extra sort.
    """
    rn = F.row_number().over(ordered(key, ts))
    last_zero = F.max(F.when(col(flag_col) == 0, rn)).over(running(key, ts))
    return F.when(col(flag_col) == 1, rn - F.coalesce(last_zero, F.lit(0))).otherwise(F.lit(0))


def with_streak(df, flag_col: str, out: str, key: str = KEY, ts: str = TS):
    rn = "__rn"
    lz = "__last_zero"
    return (df.withColumn(rn, F.row_number().over(ordered(key, ts)))
              .withColumn(lz, F.max(F.when(F.col(flag_col) == 0, F.col(rn))).over(running(key, ts)))
              .withColumn(out, F.when(F.col(flag_col) == 1, F.col(rn) - F.coalesce(F.col(lz), F.lit(0)))
                               .otherwise(F.lit(0)))
              .drop(rn, lz))


def with_island_size(df, flag_col: str, out: str, key: str = KEY, ts: str = TS):
    """Length of the run of 1s a row belongs to (0 outside runs)."""
    isl = "__island"
    chg = F.when(F.lag(F.col(flag_col)).over(ordered(key, ts)).eqNullSafe(F.col(flag_col)), 0).otherwise(1)
    return (df.withColumn(isl, F.sum(chg).over(running(key, ts)))
              .withColumn(out, F.when(F.col(flag_col) == 1,
                                      F.sum(F.col(flag_col)).over(Window.partitionBy(key, isl)))
                               .otherwise(F.lit(0)).cast("int"))
              .drop(isl))


def nan_to_null(c) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def rnd(c, digits: int = 6) -> Column:
    """Round half up to ``digits`` decimals as ``floor(x * 10^d + .5) / 10^d``.

    Used for reported values compared across engines: the same IEEE
    operations give the same result everywhere, while library ``round``
    functions break exact decimal ties differently.  For 6 decimals, values
    below 1000 are first snapped to 12 decimals so that sums taken in a
    different order (last-bit differences) land on the same tie."""
    m = float(10 ** digits)
    x = col(c)
    if digits == 6:
        snapped = F.floor(x * 1e12 + 0.5) / 1e12
        x = F.when(F.abs(x) < 1000.0, snapped).otherwise(x)
    return F.floor(x * m + 0.5) / m


def r6(c) -> Column:
    return rnd(c, 6)
