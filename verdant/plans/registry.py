"""Registry of named queries: a Spark builder plus, where SQL can express
it, the equivalent DuckDB oracle statement over the same parquet tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = portable_rounding(sql.strip())
        return fn
    return deco


_ROUND = re.compile(r"(?<![A-Za-z_])round\(")


def portable_rounding(sql: str) -> str:
    """Rewrite ``round(x, d)`` (d in 4, 6, 9, 12) as
    ``floor(x * 10^d + .5) / 10^d`` -- the same IEEE steps as the Spark side's
    ``semantics.rnd``, so exact decimal ties round alike in both engines."""
    out, i = [], 0
    while True:
        m = _ROUND.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        start = m.end()
        depth, j, comma = 1, start, None
        while depth:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = j
            j += 1
        arg_end = j - 1
        digits = sql[comma + 1:arg_end].strip() if comma else ""
        if digits in ("4", "6", "9", "12"):
            inner = portable_rounding(sql[start:comma])
            if digits == "6":
                inner = (f"CASE WHEN abs({inner}) < 1000.0 THEN floor(({inner}) * 1e12 + 0.5) / 1e12 "
                         f"ELSE ({inner}) END")
            out.append(sql[i:m.start()] + f"(floor(({inner}) * 1e{digits} + 0.5) / 1e{digits})")
        else:
            out.append(sql[i:m.start()] + "round(" + portable_rounding(sql[start:arg_end]) + ")")
        i = j


def load_all() -> None:
    """Import every module that registers queries."""
    from verdant.plans import (  # noqa: F401
        q_alerts,
        q_documents,
        q_features,
        q_governance,
        q_misc,
        q_models,
        q_prescription,
        q_quality,
        q_rollup,
        q_stats,
        q_scenes,
        q_sources,
        q_timeseries,
    )
