"""Registered queries over the supplied tables, and the SQL each must agree with.

Bars: events (ticker = event_type, close = value). Paths: lineitem prices by supplier, LENGTH returns each, odd suppliers
side a and even ones side b; embeddings as ready-made paths. Results are rounded to six places where engines add up
doubles in another order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import gaps, liquidity, season, session
from ..sources.tables import table
from . import protocol, samplers

LIMIT = 60.0
LENGTH = 500
LAGS = range(1, 31)
HORIZONS = (1, 5, 30)
SCALES = (5, 20, 60)
LOOKBACK = 20
CUTOFF = "1995-01-01"
TIERS = {"train_only": 8, "eval_eligible": 12}
BY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


# bars and returns


def bars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"), "event_id").filter("close > 0")


def events_returns(spark: SparkSession, d: str, mode: str = "drop_then_return") -> DataFrame:
    return session.returns(session.in_session(bars(spark, d)), LIMIT, mode, ("event_id",))


_SESSION = """
with local as (
  select event_id, event_type as ticker, ts, value as close, timezone('America/New_York', timezone('UTC', ts)) as ny
  from events where value > 0
), sess as (
  select *, cast(ny as date) as date_ny, cast(extract(hour from ny) * 60 + extract(minute from ny) as bigint) as minute_of_day
  from local where extract(hour from ny) * 60 + extract(minute from ny) between 570 and 959
)"""
_ORDER = "partition by ticker order by ts, event_id"


def _flags(limit: float, floor: bool) -> str:
    since = f"(epoch_us(ts) - lag(epoch_us(ts)) over ({_ORDER})) / 60000000.0"
    since = f"floor({since})" if floor else since
    return f"""{_SESSION}, marked as (
  select *, coalesce(date_ny <> lag(date_ny) over ({_ORDER}), true) as is_start, {since} as since from sess
), flagged as (select *, coalesce(not is_start and since > {limit}, false) as is_gap from marked)"""


_DROP = f"""{_flags(LIMIT, False)}, kept as (select * from flagged where not (is_start or is_gap)), rets as (
  select * from (select *, ln(close / lag(close) over ({_ORDER})) as log_return from kept) where log_return is not null
)"""
_MASK = f"""{_flags(LIMIT, True)}, rets as (
  select * from (select *, ln(close / lag(close) over ({_ORDER})) as log_return from flagged)
  where not (is_start or is_gap) and log_return is not null
)"""


@query("session_filter", f"{_SESSION} select event_id, ticker, cast(date_ny as varchar) as date_ny, minute_of_day from sess")
def session_filter(spark, d):
    return session.in_session(bars(spark, d)).select("event_id", "ticker", "date_ny", F.col("minute_of_day").cast("long").alias("minute_of_day"))


@query("gap_flags", f"{_flags(1.0, False)} select event_id, is_start, is_gap from flagged")
def gap_flags(spark, d):
    return session.flags(session.in_session(bars(spark, d)), 1.0, False, ("event_id",)).select("event_id", "is_start", "is_gap")


@query("gap_flags_whole_minutes", f"{_flags(1.0, True)} select event_id, is_start, is_gap from flagged")
def gap_flags_whole_minutes(spark, d):
    return session.flags(session.in_session(bars(spark, d)), 1.0, True, ("event_id",)).select("event_id", "is_start", "is_gap")


@query("returns_drop_first", f"{_DROP} select event_id, round(log_return, 6) as log_return from rets")
def returns_drop_first(spark, d):
    return events_returns(spark, d).select("event_id", "log_return").withColumns(r6("log_return"))


@query("returns_mask_after", f"{_MASK} select event_id, round(log_return, 6) as log_return from rets")
def returns_mask_after(spark, d):
    return events_returns(spark, d, "return_then_drop").select("event_id", "log_return").withColumns(r6("log_return"))


_LIQUID = f"""{_DROP}, days as (select ticker, date_ny, count(*) as n from rets group by all), liquid as (
  select ticker, median(n) as median_bars_per_day, count(*) as trading_days, cast(sum(n) as bigint) as total_returns from days group by ticker
)"""


@query("liquidity_stats", f"{_LIQUID} select ticker, cast(median_bars_per_day as double) as median_bars_per_day, trading_days, total_returns from liquid")
def liquidity_stats(spark, d):
    return liquidity.liquidity(events_returns(spark, d))


@query("liquidity_class", f"""{_LIQUID} select ticker, case when median_bars_per_day >= {TIERS["eval_eligible"]} then 'eval_eligible'
  when median_bars_per_day >= {TIERS["train_only"]} then 'train_only' else 'excluded' end as liquidity_class from liquid""")
def liquidity_class(spark, d):
    return liquidity.classify(liquidity.liquidity(events_returns(spark, d)), TIERS).select("ticker", "liquidity_class")


@query("ticker_split")
def ticker_split(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.count("*").cast("double").alias("median_bars_per_day"))
    return liquidity.ticker_split(liquidity.classify(per, TIERS))


@query("ticker_split_counts", f"""with per as (select o_custkey, count(*) as n from orders group by o_custkey),
classed as (select count(*) filter (where n >= {TIERS["eval_eligible"]}) as eligible, count(*) filter (where n >= {TIERS["train_only"]} and n < {TIERS["eval_eligible"]}) as only_train from per),
held as (select *, case when eligible > 0 then greatest(1, cast(round_even(eligible * 0.2, 0) as bigint)) else 0 end as k from classed)
select * from (select 'eval' as side, 'eval_eligible' as liquidity_class, k as n, k as names from held union all select 'train', 'eval_eligible', eligible - k, eligible - k from held union all select 'train', 'train_only', only_train, only_train from held) where n > 0""")
def ticker_split_counts(spark, d):
    """Every eligible ticker is on one side, the share held out is exact, and nothing else is in."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.count("*").cast("double").alias("median_bars_per_day"))
    classed = liquidity.classify(per, TIERS)
    return liquidity.ticker_split(classed).join(classed, "ticker").groupBy("side", "liquidity_class").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("names"))


# seasonality


@query("tau_profile", f"{_DROP} select minute_of_day - 570 as tau, round(avg(abs(log_return)), 6) as mean_abs_return, count(*) as n from rets group by 1")
def tau_profile(spark, d):
    return season.tau_profile(events_returns(spark, d)).withColumns({"tau": F.col("tau").cast("long"), **r6("mean_abs_return")})


def _basis_sql() -> list[str]:
    angle = lambda j: f"({2 * np.pi * j!r} * tau / 390)"
    return ["cast(1 as double)", *[f"{f}{angle(j)}" for j in (1, 2, 3) for f in ("cos", "sin")]]


_B = _basis_sql()
_SUMS = ", ".join([f"round(sum({_B[i]} * {_B[j]}), 6) as m_{i}_{j}" for i in range(7) for j in range(i, 7)] + [f"round(sum({b} * y), 6) as v_{i}" for i, b in enumerate(_B)])
_PROFILE = f"{_DROP}, profile as (select minute_of_day - 570 as tau, avg(abs(log_return)) as y from rets group by 1)"


@query("fff_normal_sums", f"{_PROFILE} select {_SUMS} from profile")
def fff_normal_sums(spark, d):
    sums = season.normal_sums(season.tau_profile(events_returns(spark, d)))
    return sums.select(*[F.round(c, 6).alias(c) for c in sums.columns])


_M = ", ".join("[" + ", ".join([f"sum({_B[i]} * {_B[j]})" for j in range(7)] + [f"sum({_B[i]} * y)"]) + "]" for i in range(7))
_CURVE = f"""{_PROFILE.replace("with local", "with recursive local")}, solved(k, m) as (
  select 0, [{_M}] from profile
  union all
  select k + 1, [case when i = k + 1 then [x / m[k + 1][k + 1] for x in m[i]] else [m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j] for j in range(1, 9)] end for i in range(1, 8)] from solved where k < 7
), w as (select [row_[8] for row_ in m] as w from solved where k = 7), minutes as (select cast(i as bigint) as tau from range(390) g(i)),
curve as (select tau, greatest({" + ".join(f"w[{i + 1}] * {b}" for i, b in enumerate(_B))}, 1e-8) as s from minutes, w)"""


@query("fff_curve", f"{_CURVE} select tau, round(s, 6) as s from curve")
def fff_curve(spark, d):
    return season.fit_curve(season.tau_profile(events_returns(spark, d))).select(F.col("tau").cast("long").alias("tau"), F.round("s", 6).alias("s"))


_DESEAS = f"""{_PROFILE}, deseas as (
  select r.*, r.log_return / p.y as return_deseas from rets r join profile p on p.tau = r.minute_of_day - 570 where p.y > 0
)"""


def _deseasonalised(spark, d):
    r = events_returns(spark, d)
    curve = season.tau_profile(r).select("tau", F.col("mean_abs_return").alias("s")).filter("s > 0")
    return season.deseasonalise(r, curve)


@query("deseasonalised", f"{_DESEAS} select event_id, round(return_deseas, 6) as return_deseas from deseas")
def deseasonalised(spark, d):
    return _deseasonalised(spark, d).select("event_id", "return_deseas").withColumns(r6("return_deseas"))


_NORMS = f"{_DESEAS}, norms as (select ticker, avg(return_deseas) as mean, case when count(*) > 1 then greatest(stddev_samp(return_deseas), 1e-8) end as std from deseas group by ticker)"


@query("norm_stats", f"{_NORMS} select ticker, round(mean, 6) as mean, round(std, 6) as std from norms")
def norm_stats(spark, d):
    return season.norm_stats(_deseasonalised(spark, d)).withColumns(r6("mean", "std"))


@query("zscore", f"{_NORMS} select event_id, round((return_deseas - mean) / std, 6) as return_normed from deseas join norms using (ticker)")
def zscore(spark, d):
    r = _deseasonalised(spark, d)
    return season.normalise(r, season.norm_stats(r)).select("event_id", "return_normed").withColumns(r6("return_normed"))


# corpora


def supplier_corpus(spark: SparkSession, d: str, groups: int | None = None, length: int = LENGTH) -> DataFrame:
    """Paths by supplier, or by the remainder of its number, for longer ones."""
    name = F.col("l_suppkey") % groups if groups else F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(name.alias("name"), *BY)
    r = session.series_returns(rows, "name", "l_extendedprice", *BY)
    r = r.select(F.lpad(F.col("name").cast("string"), 12, "0").alias("ticker"), "log_return", *BY)
    return C.windows(r, "log_return", length, by=BY, date="l_shipdate", cutoff=CUTOFF)


def paired(corpus: DataFrame) -> DataFrame:
    """(side, path_id, values): odd tickers against even ones."""
    return corpus.select(F.when(F.col("ticker").cast("long") % 2 == 1, "a").otherwise("b").alias("side"), "path_id", "values")


def sides(corpus: DataFrame) -> DataFrame:
    return C.to_long(paired(corpus), "side", "path_id")


def _paths(ticker: str = "l_suppkey", length: int = LENGTH) -> str:
    return f"""
with prices as (select {ticker} as name, {", ".join(BY)} from lineitem), rets as (
  select * from (select name, {", ".join(BY)}, ln(l_extendedprice / lag(l_extendedprice) over (partition by name order by {", ".join(BY)})) as r from prices)
  where r is not null
), numbered as (
  select name, r, l_shipdate, row_number() over (partition by name order by {", ".join(BY)}) - 1 as n from rets
), placed as (
  select name, r, l_shipdate, n // {length} as win, n % {length} as t, count(*) over (partition by name, n // {length}) as k from numbered
), long as (
  select dense_rank() over (order by lpad(cast(name as varchar), 12, '0'), win) - 1 as path_id, lpad(cast(name as varchar), 12, '0') as ticker, l_shipdate, t, r,
    case when name % 2 = 1 then 'a' else 'b' end as side
  from placed where k = {length}
)"""


_PATHS = _paths()
_CORPUS = f"""{_PATHS}, corpus as (
  select path_id, ticker, side, case when min(l_shipdate) filter (where t = 0) < date '{CUTOFF}' then 0 else 1 end as regime, sum(r) as total from long group by path_id, ticker, side
)"""


@query("windows_regime", f"{_CORPUS} select path_id, ticker, cast(regime as bigint) as regime, round(total, 6) as total from corpus")
def windows_regime(spark, d):
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return supplier_corpus(spark, d).select("path_id", "ticker", F.col("regime").cast("long").alias("regime"), F.round(total, 6).alias("total"))


@query("train_val_split", f"""{_CORPUS}, pairs as (select path_id, substr(ticker, 12) as grp from corpus), c as (
  select *, count(*) over (partition by grp) as n, row_number() over (partition by grp order by path_id desc) as last from pairs)
  select path_id, n > 1 and last <= greatest(1, round_even(n * 0.1, 0)) as is_val from c""")
def train_val_split(spark, d):
    grouped = supplier_corpus(spark, d).withColumn("ticker", F.substring("ticker", 12, 1))  # suppliers have a window each; their last digits have many
    return C.train_val(grouped).select("path_id", "is_val")


@query("manifest_stats", f"{_PATHS} select count(distinct path_id) as n, cast({LENGTH} as bigint) as window_len, round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std, count(*) filter (where not isfinite(r)) as non_finite from long")
def manifest_stats(spark, d):
    return C.pooled_stats(supplier_corpus(spark, d)).select("n", F.col("most_len").cast("long").alias("window_len"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "non_finite")


@query("align_to_reference", f"{_PATHS}, s as (select avg(r) as m, stddev_pop(r) as sd from long) select path_id, t, round((r - m) * 1.5 / sd, 6) as r from long, s")
def align_to_reference(spark, d):
    out = C.to_long(C.align(supplier_corpus(spark, d), 1.5), "path_id")
    return out.select("path_id", F.col("t").cast("long").alias("t"), F.round("r", 6).alias("r"))


@query("label_counts", f"{_CORPUS} select cast(regime as bigint) as regime, count(*) as windows, count(distinct ticker) as tickers from corpus group by regime")
def label_counts(spark, d):
    return C.label_counts(supplier_corpus(spark, d)).withColumn("regime", F.col("regime").cast("long"))


@query("subsample_paths")
def subsample_paths(spark, d):
    return C.subsample(supplier_corpus(spark, d), 5).select("pos", "path_id", "ticker")


@query("subsample_counts", f"{_PATHS} select 5 as paths, 5 as places, count(distinct path_id) >= 5 as enough, true as known from long")
def subsample_counts(spark, d):
    """Five different paths of the corpus, in places 0 to 4."""
    corpus = supplier_corpus(spark, d)
    drawn = C.subsample(corpus, 5).join(corpus.select(F.col("path_id").alias("_id")), F.expr("path_id = _id"), "left")
    return drawn.agg(F.countDistinct("path_id").alias("paths"), F.count_if(F.expr("pos between 0 and 4")).alias("places"), (F.count("*") == 5).alias("enough"), (F.count("_id") == 5).alias("known"))


# gaps

_TAIL = f"select (i + 0.5) / 1000 as p from range(1000) x(i) where (i + 0.5) / 1000 < 0.05 or (i + 0.5) / 1000 > 0.95"


@query("b1_gap", f"""{_PATHS}, sorted as (
  select side, r, row_number() over (partition by side order by r) - 1 as k, count(*) over (partition by side) as n from long
), want as (select side, p, (n - 1) * p as h from (select distinct side, n from sorted), ({_TAIL})), q as (
  select w.side, w.p, min(s.r) + (max(s.r) - min(s.r)) * (any_value(h) - floor(any_value(h))) as q
  from want w join sorted s on s.side = w.side and s.k in (floor(w.h), ceil(w.h)) group by w.side, w.p
) select round(avg(abs(a.q - b.q)), 6) as gap from q a join q b on a.p = b.p and a.side = 'a' and b.side = 'b'""")
def b1_gap(spark, d):
    return gaps.b1_gap(sides(supplier_corpus(spark, d))).withColumns(r6("gap"))


def _lagged(leverage: bool, lags: range = LAGS, paths: str = _PATHS) -> str:
    early = "r - avg(r) over (partition by path_id)" if leverage else "abs(r) - avg(abs(r)) over (partition by path_id)"
    return f"""{paths}, centred as (
  select side, path_id, t, {early} as x, abs(r) - avg(abs(r)) over (partition by path_id) as y from long
), arrays as (
  select side, path_id, list(x order by t) as xs, list(y order by t) as ys, count(*) as n, sqrt(sum(x * x) * sum(y * y)) as s from centred group by side, path_id
), curves as (
  select side, path_id, lag, list_dot_product(xs[1 : n - lag], ys[lag + 1 : n]) / s as c from arrays, range({lags.start}, {lags.stop}) g(lag)
), mean as (select side, lag, avg(c) as c from curves group by side, lag)"""


_GAP = "select round(avg(abs(a.c - b.c)), 6) as gap from mean a join mean b on a.lag = b.lag and a.side = 'a' and b.side = 'b'"


@query("b2_acf_lags", f"{_lagged(False)} select side, cast(lag as bigint) as lag, round(c, 6) as c from mean")
def b2_acf_lags(spark, d):
    return gaps.fast_mean_curves(paired(supplier_corpus(spark, d)), LAGS).withColumns({"lag": F.col("lag").cast("long"), **r6("c")})


@query("b3_leverage_lags", f"{_lagged(True)} select side, cast(lag as bigint) as lag, round(c, 6) as c from mean")
def b3_leverage_lags(spark, d):
    return gaps.fast_mean_curves(paired(supplier_corpus(spark, d)), LAGS, leverage=True).withColumns({"lag": F.col("lag").cast("long"), **r6("c")})


@query("b2_gap", f"{_lagged(False)} {_GAP}")
def b2_gap(spark, d):
    return gaps.b2_gap(paired(supplier_corpus(spark, d)), LAGS).withColumns(r6("gap"))


@query("b3_gap", f"{_lagged(True)} {_GAP}")
def b3_gap(spark, d):
    return gaps.b3_gap(paired(supplier_corpus(spark, d)), LAGS).withColumns(r6("gap"))


@query("b2_gap_fast", f"{_lagged(False)} {_GAP}")
def b2_gap_fast(spark, d):
    return gaps.curve_gap(gaps.fast_curves(paired(supplier_corpus(spark, d)), LAGS)).withColumns(r6("gap"))


@query("b3_gap_fast", f"{_lagged(True)} {_GAP}")
def b3_gap_fast(spark, d):
    return gaps.curve_gap(gaps.fast_curves(paired(supplier_corpus(spark, d)), LAGS, leverage=True)).withColumns(r6("gap"))


#: The benchmark's own lengths and lags; suppliers share paths so that these are long enough from 50,000 lines on.
GROUPS, LONG, LAGS_B2, LAGS_B3 = 16, 2520, range(60, 391), range(1, 391)
_LONG_PATHS = _paths(f"l_suppkey % {GROUPS}", LONG)


@query("b2_gap_reference", f"{_lagged(False, LAGS_B2, _LONG_PATHS)} {_GAP}")
def b2_gap_reference(spark, d):
    return gaps.b2_gap(paired(supplier_corpus(spark, d, GROUPS, LONG)), LAGS_B2).withColumns(r6("gap"))


@query("b3_gap_reference", f"{_lagged(True, LAGS_B3, _LONG_PATHS)} {_GAP}")
def b3_gap_reference(spark, d):
    return gaps.b3_gap(paired(supplier_corpus(spark, d, GROUPS, LONG)), LAGS_B3).withColumns(r6("gap"))


_H = ", ".join(f"({h})" for h in HORIZONS)
_KURT = f"""{_PATHS}, seat as (select side, path_id, row_number() over (partition by side order by path_id) - 1 as seat from (select distinct side, path_id from long)),
blocks as (
  select l.side, h.h, floor((s.seat * {LENGTH} + l.t) / h.h) as block, sum(l.r) as x
  from long l join seat s on s.side = l.side and s.path_id = l.path_id cross join (values {_H}) h(h) group by 1, 2, 3 having count(*) = h.h
), o as (
  select side, h, x, row_number() over (partition by side, h order by x) - 1.0 as j, count(*) over (partition by side, h) * 1.0 as n from blocks
), b as (
  select side, h, any_value(n) as n, avg(x) as b0, avg(x * j / (n - 1)) as b1, avg(x * j / (n - 1) * (j - 1) / (n - 2)) as b2, avg(x * j / (n - 1) * (j - 1) / (n - 2) * (j - 2) / (n - 3)) as b3
  from o group by side, h
), tau as (select side, h, n, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) as tau4 from b where n >= 30)"""


@query("b4_lkurtosis", f"{_KURT} select side, cast(h as bigint) as h, round(tau4, 6) as tau4 from tau")
def b4_lkurtosis(spark, d):
    long, out = sides(supplier_corpus(spark, d)), None
    for h in HORIZONS:
        b = gaps.block_sums(long, h, LENGTH).withColumn("h", F.lit(h).cast("long"))
        out = b if out is None else out.unionByName(b)
    return gaps.l_kurtosis(out, "x", ["h", "side"]).filter("n >= 30").select("side", "h", F.round("tau4", 6).alias("tau4"))


@query("b4_gap", f"{_KURT} select round(sum(abs(a.tau4 - b.tau4) / a.h) / sum(1.0 / a.h), 6) as gap from tau a join tau b on a.h = b.h and a.side = 'a' and b.side = 'b'")
def b4_gap(spark, d):
    return gaps.b4_gap(sides(supplier_corpus(spark, d)), LENGTH, HORIZONS).withColumns(r6("gap"))


_VOLS = ", ".join(f"sqrt(avg(r * r) over (partition by path_id order by t rows between {s - 1} preceding and current row)) as v{i}" for i, s in enumerate(SCALES))
_CORR = f"""{_PATHS}, vols as (select side, path_id, t, {_VOLS} from long), valid as (select * from vols where t >= {max(SCALES) - 1}), per as (
  select side, path_id, corr(v0, v1) as c01, corr(v0, v2) as c02, corr(v1, v2) as c12 from valid group by side, path_id
  having least(var_pop(v0), var_pop(v1), var_pop(v2)) * count(*) > 1e-8
), mean as (select side, avg(c01) as c01, avg(c02) as c02, avg(c12) as c12 from per group by side)"""


@query("b5_cfvc", f"""{_CORR} select side, cast(0 as bigint) as i, cast(1 as bigint) as j, round(c01, 6) as c from mean union all select side, 0, 2, round(c02, 6) from mean
  union all select side, 1, 2, round(c12, 6) from mean""")
def b5_cfvc(spark, d):
    c = gaps.scale_correlations(sides(supplier_corpus(spark, d)), SCALES).groupBy("side", "i", "j").agg(F.avg("c").alias("c"))
    return c.select("side", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("c", 6).alias("c"))


@query("b5_gap", f"{_CORR} select round(sqrt(2 * ((a.c01 - b.c01) ** 2 + (a.c02 - b.c02) ** 2 + (a.c12 - b.c12) ** 2)), 6) as gap from mean a, mean b where a.side = 'a' and b.side = 'b'")
def b5_gap(spark, d):
    return gaps.b5_gap(sides(supplier_corpus(spark, d)), SCALES).withColumns(r6("gap"))


_VOL = f"""{_PATHS}, vol as (
  select * from (select side, path_id, t, r, stddev_samp(r) over (partition by path_id order by t rows between {LOOKBACK} preceding and 1 preceding) as vol from long) where t >= {LOOKBACK}
), bounds as (select quantile_cont(vol, 1.0 / 3) as b1, quantile_cont(vol, 2.0 / 3) as b2 from vol where side = 'a'), reg as (
  select side, r, abs(r) as m, cast(vol >= b1 as int) + cast(vol >= b2 as int) as regime from vol, bounds
)"""


@query("b6_vol_thresholds", f"{_VOL} select round(b1, 6) as b1, round(b2, 6) as b2 from bounds")
def b6_vol_thresholds(spark, d):
    vols = gaps.with_volatility(sides(supplier_corpus(spark, d)), LOOKBACK)
    q = gaps.regime_thresholds(vols.filter("side = 'a'"))
    return q.agg(F.round(F.min("q"), 6).alias("b1"), F.round(F.max("q"), 6).alias("b2"))


def _exceedances(spark, d):
    vols = gaps.with_volatility(sides(supplier_corpus(spark, d)), LOOKBACK)
    bounds = [x.q for x in gaps.regime_thresholds(vols.filter("side = 'a'")).orderBy("p").collect()]  # two rows
    return gaps.exceedances(gaps.in_regime(vols, bounds))


@query("b6_exceedances", f"""{_VOL}, u as (select side, regime, quantile_cont(m, 0.95) as u from reg group by side, regime)
  select reg.side, cast(reg.regime as bigint) as regime, count(*) as n, round(sum(m - u), 6) as total from reg join u on u.side = reg.side and u.regime = reg.regime where m > u group by 1, 2""")
def b6_exceedances(spark, d):
    return _exceedances(spark, d).groupBy("side", F.col("regime").cast("long").alias("regime")).agg(F.count("*").alias("n"), F.round(F.sum("e"), 6).alias("total"))


def _finer(name: str, grid: str) -> str:
    """The best theta of a grid (side, regime, mean, theta), and its neighbours."""
    return f"""{name}_xi as (select g.side, g.regime, any_value(g.mean) as mean, g.theta, avg(ln(1 + g.theta * e.e)) as xi from {grid} g join ex e on e.side = g.side and e.regime = g.regime group by g.side, g.regime, g.theta),
{name}_at as (
  select *, -ln(case when abs(theta) * mean < 1e-9 then mean else xi / theta end) - case when abs(theta) * mean < 1e-9 then 0 else xi end - 1 as level,
    lag(theta, 1, theta) over (partition by side, regime order by theta) as lo, lead(theta, 1, theta) over (partition by side, regime order by theta) as hi
  from {name}_xi where xi > -1 or theta >= 0
), {name} as (select side, regime, any_value(mean) as mean, arg_max(lo, level) as lo, arg_max(hi, level) as hi, arg_max(xi, level) as xi from {name}_at group by side, regime),
{name}_grid as (select side, regime, mean, lo + (hi - lo) * i / 200 as theta from {name}, range(201) x(i))"""


_XI = f"""{_VOL}, u as (select side, regime, quantile_cont(m, 0.95) as u from reg group by side, regime),
ex as (select reg.side, reg.regime, m - u as e from reg join u on u.side = reg.side and u.regime = reg.regime where m > u),
sums as (select side, regime, count(*) as n, max(e) as top, avg(e) as mean from ex group by side, regime),
grid as (
  select side, regime, mean, -(1 - pow(10, -6 + 6 * i / 199.0)) / top as theta from sums, range(199) x(i) union all select side, regime, mean, 0.0 from sums
  union all select side, regime, mean, pow(10, -6 + 10 * i / 399.0) / mean from sums, range(400) x(i)
), {_finer("g0", "grid")}, {_finer("g1", "g0_grid")}, {_finer("g2", "g1_grid")}, {_finer("g3", "g2_grid")},
xi as (select s.side, s.regime, s.n, case when s.n >= 50 then g.xi end as xi from sums s left join g3 g on g.side = s.side and g.regime = s.regime)"""


@query("b6_gpd_xi", f"{_XI} select side, cast(regime as bigint) as regime, n, round(xi, 4) as xi from xi")
def b6_gpd_xi(spark, d):
    return gaps.tail_indices(_exceedances(spark, d)).select("side", F.col("regime").cast("long").alias("regime"), "n", F.round("xi", 4).alias("xi"))


@query("b6_gap", f"{_XI} select round(avg(abs(a.xi - b.xi)), 4) as gap from xi a join xi b on a.regime = b.regime and a.side = 'a' and b.side = 'b' where a.xi is not null and b.xi is not null")
def b6_gap(spark, d):
    return gaps.b6_gap(sides(supplier_corpus(spark, d)), lookback=LOOKBACK).select(F.round("gap", 4).alias("gap"))


# samplers and protocol: NumPy's generator decides, so tests hold them against NumPy


def embedding_corpus(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as ready-made paths of 64 values; ticker is the label, regime whether it is odd."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("path_id"), F.col("label").cast("string").alias("ticker"), (F.col("label") % 2).cast("byte").alias("regime"), F.col("embedding").cast("array<double>").alias("values"))
    return e


def _rows(spark, rows):
    return spark.createDataFrame(rows, "resample int, side string, pos int, path_id long")


@query("pooled_draws")
def pooled_draws(spark, d):
    n = embedding_corpus(spark, d).count()
    return _rows(spark, samplers.paired_draws(samplers.PooledSampler(n), 40, 40, 10, np.random.default_rng(42)))


@query("within_ticker_draws")
def within_ticker_draws(spark, d):
    s = samplers.WithinTickerSampler.of(embedding_corpus(spark, d), 10)
    return _rows(spark, samplers.paired_draws(s, 40, 10, 10, np.random.default_rng(42)))


@query("within_regime_draws")
def within_regime_draws(spark, d):
    s = samplers.WithinRegimeSampler.of(embedding_corpus(spark, d), 1, 20)
    return _rows(spark, samplers.unpaired_draws(s, None, 20, 10, np.random.default_rng(42)))


def _drawn(draws: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per resample: real paths, different ones, tickers and regimes among them, and synthetic places."""
    real = draws.filter("side <> 's'").join(corpus.select("path_id", "ticker", "regime"), "path_id")
    per = real.groupBy(F.col("resample").cast("long").alias("resample")).agg(F.count("*").alias("n"), F.countDistinct("path_id").alias("paths"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("regime").alias("regimes"))
    drawn = draws.groupBy(F.col("resample").cast("long").alias("resample")).agg(F.count_if(F.expr("side = 's' and path_id between 0 and 39")).alias("synthetic"))
    return per.join(drawn, "resample")


@query("pooled_draws_counts", "select i as resample, 80 as n, 80 as paths, 40 as synthetic from range(10) x(i)")
def pooled_draws_counts(spark, d):
    return _drawn(pooled_draws(spark, d), embedding_corpus(spark, d)).drop("tickers", "regimes")


@query("within_ticker_draws_counts", "select i as resample, 20 as n, 20 as paths, 1 as tickers, 10 as synthetic from range(10) x(i)")
def within_ticker_draws_counts(spark, d):
    return _drawn(within_ticker_draws(spark, d), embedding_corpus(spark, d)).drop("regimes")


@query("within_regime_draws_counts", "select i as resample, 40 as n, 40 as paths, 1 as regimes, 0 as synthetic from range(10) x(i)")
def within_regime_draws_counts(spark, d):
    return _drawn(within_regime_draws(spark, d), embedding_corpus(spark, d)).drop("tickers")


def _generators(real: DataFrame) -> dict[str, DataFrame]:
    """Two of them: the real paths turned round in time, and twice as large."""
    return {"turned": real.withColumn("values", F.reverse("values")), "doubled": real.withColumn("values", F.transform("values", lambda x: 2 * x))}


def _bucket(k: int) -> protocol.Bucket:
    return protocol.buckets((1, 16), (1, 16), (1, 4, 8), (4, 8, 16), 8)[k]


@query("rr_gaps")
def rr_gaps(spark, d):
    """Real against real in tail quantiles."""
    got = protocol.rr_gaps(_bucket(0), embedding_corpus(spark, d), 100, 20, np.random.default_rng(42))
    return spark.createDataFrame([(i, float(g)) for i, g in enumerate(got)], "resample long, gap double")


@query("sr_gaps")
def sr_gaps(spark, d):
    """Real against real turned round in time, in leverage."""
    real = embedding_corpus(spark, d)
    got = protocol.sr_gaps(_bucket(2), real, _generators(real)["turned"], 100, 20, np.random.default_rng(42))
    return spark.createDataFrame([(i, float(g)) for i, g in enumerate(got)], "resample long, gap double")


def _scores(spark, d):
    """The benchmark on embeddings, with the published numbers of paths, resamples and bootstraps."""
    real = embedding_corpus(spark, d)
    return protocol.run_benchmark(real, _generators(real), [_bucket(k) for k in range(6)])


@query("paired_scores")
def paired_scores(spark, d):
    return _scores(spark, d)


@query("composite_rank")
def composite_rank(spark, d):
    return protocol.composite(_scores(spark, d))


@query("composite_of_scores", """with scores as (select 'g' || (vec_id % 4) as generator, label as bucket, avg(greatest(cast(embedding[1] as double), 0)) as sim from embeddings group by 1, 2),
held as (select generator, sim, greatest(sim, 1e-6) as h from scores), per as (select generator, exp(avg(ln(h))) as geometric, avg(h) as arithmetic, avg(sim) as composite from held group by generator)
select generator, round(geometric, 6) as geometric, round(arithmetic, 6) as arithmetic, round(composite, 6) as composite, row_number() over (order by composite desc, generator) as place from per""")
def composite_of_scores(spark, d):
    """Composites and ranks of a table of scores: four generators, a bucket per label."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("generator"), F.col("label").alias("bucket"), F.greatest(F.col("embedding")[0].cast("double"), F.lit(0.0)).alias("x"))
    return protocol.composite(e.groupBy("generator", "bucket").agg(F.avg("x").alias("sim"))).withColumns(r6("geometric", "arithmetic", "composite"))
