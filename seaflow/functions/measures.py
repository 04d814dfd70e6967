"""Business measures and the arithmetic they share, as SQL expressions for ``selectExpr`` and ``totals``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed limits: a call is on time up to four hours of delay, severely late beyond a day.
ON_TIME_LIMIT_H = 4
SEVERE_LIMIT_H = 24

ARRIVED = "ata is not null"
ON_TIME = f"(ata is not null and delay_hours <= {ON_TIME_LIMIT_H})"
LATE = f"(ata is not null and delay_hours > {ON_TIME_LIMIT_H})"
SEVERELY_LATE = f"(ata is not null and delay_hours > {SEVERE_LIMIT_H})"
OVER_A_DAY = f"delay_hours > {SEVERE_LIMIT_H}"
ACTIVE_VOYAGE = "status in ('In Transit', 'Departed')"


def totals(df: DataFrame, keys: Iterable[str], *expressions: str) -> DataFrame:
    """Aggregate by ``keys`` (none for one row over everything)."""
    return df.groupBy(*keys).agg(*[F.expr(e) for e in expressions])


def half_up(value: str, digits: int) -> str:
    """Round half away from zero on the binary value, the same in every engine."""
    scale = f"1e{digits}"
    return f"(floor(abs({value}) * {scale} + 0.5e0) / {scale} * signum({value}))"


def exact_sum(amount: str) -> str:
    """Sum of an amount of up to six decimals; exact, so independent of the order of the rows."""
    return f"sum(cast({amount} as decimal(28,6)))"


def exact_total(amount: str) -> str:
    return f"cast({exact_sum(amount)} as double)"


def exact_mean(amount: str) -> str:
    return f"({exact_total(amount)} / nullif(count({amount}), 0))"


def ratio(part: str, whole: str) -> str:
    """Double division that yields NULL for a zero divisor."""
    return f"(cast({part} as double) / nullif(cast({whole} as double), 0e0))"


def percent(part: str, whole: str, digits: int = 1) -> str:
    return half_up(f"(cast({part} as double) * 100e0 / nullif(cast({whole} as double), 0e0))", digits)


def tally(condition: str) -> str:
    """Rows for which the condition holds; NULL over no rows at all, like SUM over CASE."""
    return f"sum(case when {condition} then 1 else 0 end)"


def teu(container_type: str) -> str:
    """Twenty-foot units: 40-foot types count 2, 20-foot types, anything else and NULL 1."""
    return f"(case when startswith({container_type}, '40') then 2 else 1 end)"


def load_band(share: str) -> str:
    """Band of a load share; an unknown or zero share is Empty."""
    return (
        f"case when {share} >= 0.9e0 then 'Full' when {share} >= 0.6e0 then 'Moderate' "
        f"when {share} > 0 then 'Low' else 'Empty' end"
    )


def voyage_status(departure: str, arrival: str, as_of: str) -> str:
    """Status of a voyage seen at ``as_of``: six hours count as departed, three days after arrival as arrived."""
    return (
        f"case when {as_of} < {departure} then 'Scheduled' "
        f"when {as_of} < {departure} + interval 6 hours then 'Departed' "
        f"when {as_of} < {arrival} then 'In Transit' "
        f"when {as_of} < {arrival} + interval 3 days then 'Arrived' else 'Completed' end"
    )


def check_digit(body: str) -> str:
    """Demo check digit: character codes weighted by their 1-based position, modulo ten."""
    codes = f"transform(split({body}, ''), (c, i) -> ascii(c) * (i + 1))"
    return f"(aggregate({codes}, 0, (total, code) -> total + code) % 10)"
