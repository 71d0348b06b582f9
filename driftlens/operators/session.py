"""Bars to returns: exchange time, session, gaps, log returns.

``bars`` has ticker, ts, close and, if rows can tie in time, columns named in ``ties`` that put them in order. Every
operator partitions by ticker, so one shuffle and one sort serve all of them in a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import SESSION, ZONE


def order(*ties: str):
    return W.partitionBy("ticker").orderBy("ts", *ties)


def exchange_time(bars: DataFrame, zone: str = ZONE) -> DataFrame:
    """Adds date_ny and minute_of_day, daylight saving included; ts is UTC, seconds don't count."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return bars.withColumn("date_ny", F.to_date(local)).withColumn("minute_of_day", F.hour(local) * 60 + F.minute(local))


def in_session(bars: DataFrame, session: tuple[int, int] = SESSION) -> DataFrame:
    return exchange_time(bars).filter(F.col("minute_of_day").between(*session))


def minutes_since_last(*ties: str, floor: bool = False) -> Column:
    """Minutes since the ticker's bar before; whole ones with ``floor``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(order(*ties))
    return F.floor(gap / 60_000_000).cast("double") if floor else gap / 60_000_000.0


def flags(session: DataFrame, limit: float = 1.0, floor: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_start (first bar of its day) and is_gap (more than ``limit`` minutes after the bar before, same day)."""
    start = F.coalesce(F.col("date_ny") != F.lag("date_ny").over(order(*ties)), F.lit(True))
    gap = F.coalesce(~F.col("is_start") & (F.col("_since") > limit), F.lit(False))
    return session.withColumn("is_start", start).withColumn("_since", minutes_since_last(*ties, floor=floor)).withColumn("is_gap", gap).drop("_since")


def _log_return(ties: tuple[str, ...]) -> Column:
    ratio = F.try_divide(F.col("close"), F.lag("close").over(order(*ties)))
    return F.ln(F.when(ratio > 0, ratio))


def returns(session: DataFrame, limit: float = 1.0, mode: str = "drop_then_return", ties: tuple[str, ...] = ()) -> DataFrame:
    """Session bars to rows with log_return.

    drop_then_return: flagged bars go, then returns run over those left, so the first of a day is against the last bar
    left of the day before. return_then_drop: returns of neighbouring bars, then flagged ones go; gaps in whole minutes.
    Closes that are not positive, or null, give no return.
    """
    if mode == "drop_then_return":
        kept = flags(session, limit, False, ties).filter("not (is_start or is_gap)")
        out = kept.withColumn("log_return", _log_return(ties))
    elif mode == "return_then_drop":
        out = flags(session, limit, True, ties).withColumn("log_return", _log_return(ties)).filter("not (is_start or is_gap)")
    else:
        raise ValueError(f"no such mode: {mode}")
    return out.filter("log_return is not null").drop("is_start", "is_gap")


def series_returns(rows: DataFrame, key: str, price: str, *by: str) -> DataFrame:
    """Log returns of any positive price in any order, for tables without sessions: adds log_return, drops each key's first row."""
    before = F.lag(price).over(W.partitionBy(key).orderBy(*by))
    return rows.withColumn("log_return", F.ln(F.when((F.col(price) > 0) & (before > 0), F.col(price) / before))).filter("log_return is not null")
