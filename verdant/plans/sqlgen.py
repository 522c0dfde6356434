"""Tiny text templates for the DuckDB oracle statements (window frames,
null-guarded rolling aggregates).  Pure string helpers."""

from __future__ import annotations

PART = "PARTITION BY series_id ORDER BY date"


def frame(lo: int, hi: int = 0, part: str = PART) -> str:
    lo_s = f"{lo} PRECEDING" if lo > 0 else ("CURRENT ROW" if lo == 0 else f"{-lo} FOLLOWING")
    hi_s = "CURRENT ROW" if hi == 0 else (f"{hi} FOLLOWING" if hi > 0 else f"{-hi} PRECEDING")
    return f"OVER ({part} ROWS BETWEEN {lo_s} AND {hi_s})"


def roll(agg: str, c: str, n: int, part: str = PART) -> str:
    f = frame(n - 1, 0, part)
    return f"CASE WHEN count({c}) {f} = {n} THEN {agg}({c}) {f} END"


def center(agg: str, c: str, n: int, part: str = PART) -> str:
    f = frame(n // 2, n - 1 - n // 2, part)
    return f"CASE WHEN count({c}) {f} = {n} THEN {agg}({c}) {f} END"


def lag(c: str, n: int = 1, part: str = PART) -> str:
    return f"lag({c}, {n}) OVER ({part})"


def lead(c: str, n: int = 1, part: str = PART) -> str:
    return f"lead({c}, {n}) OVER ({part})"


def cumsum(c: str, part: str = PART) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN sum({c}) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND CURRENT ROW) END")


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def r(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


def streak_cols(flag_col: str, out: str, part: str = PART) -> str:
    """Needs ``__rn`` (row_number) computed in an inner select."""
    return (f"CASE WHEN {flag_col} = 1 THEN __rn - coalesce(max(CASE WHEN {flag_col} = 0 THEN __rn END) "
            f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) ELSE 0 END AS {out}")


def ffill(c: str, part: str = PART) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rn(part: str = PART) -> str:
    return f"row_number() OVER ({part}) AS __rn"
