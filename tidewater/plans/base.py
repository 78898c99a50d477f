"""Registration of queries, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL with the same result."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


TICKS = "ticks AS (SELECT event_type AS asset, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"


def _bars(unit: str) -> str:
    return f"bars AS (SELECT asset, date_trunc('{unit}', ts)::TIMESTAMP AS bar, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL)"


HOURLY = f"WITH {TICKS}, {_bars('hour')}"
DAILY = f"WITH {TICKS}, {_bars('day')}"
DAILY_RECURSIVE = DAILY.replace("WITH", "WITH RECURSIVE", 1)
W = "OVER (PARTITION BY asset ORDER BY bar)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, x: str, agg: str = "avg") -> str:
    return f"CASE WHEN count({x}) {rows(n)} >= {n} THEN {agg}({x}) {rows(n)} END"


def recurrence(source: str, x: str, out: str, alpha: str, n: int) -> str:
    """CTEs <out>_r: (asset, bar, out) from the n-th value of x of source on, seeded by the mean of the first n: the
    recurrence as a closed sum over powers of 1 - alpha."""
    return f"""{out}_n AS (SELECT asset, bar, {x} AS x, row_number() OVER (PARTITION BY asset ORDER BY bar) AS k FROM {source} WHERE {x} IS NOT NULL),
{out}_r AS (SELECT asset, bar, k, pow(1 - {alpha}, k - {n}) * sum(CASE WHEN k = {n} THEN seed ELSE {alpha} * x * pow(1 - {alpha}, {n} - k) END) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS {out}
 FROM {out}_n JOIN (SELECT asset, avg(x) AS seed FROM {out}_n WHERE k <= {n} GROUP BY asset) USING (asset) WHERE k >= {n})"""
