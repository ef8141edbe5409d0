"""DuckDB SQL for feature tables, labels and trades (self-joins and recursion)."""

from __future__ import annotations

from checks.duck_features import BARS, feature_sql

# Features of the shared table: no smoothers, so the SQL stays short.
FEATURES = ["rsi14", "atr14_normalized", "swing_low_10d", "close_position_in_range", "candle_body_pct", "volatility_21d",
            "relative_volume", "roc10", "sma20_ratio", "day_of_month_cos", "log_return_1d", "month_of_year_cos",
            "trend_consistency", "price_near_support"]
H, TARGET, LABEL_T = 5, 0.06, 0.10

NUDGE = "1.3e-8"


def rounded(sql, doubles):
    """Six decimals for the named columns."""
    if not doubles:
        return sql
    shown = ", ".join(f"round({c} + {NUDGE}, 6) + 0e0 as {c}" for c in doubles)
    return f"select * replace ({shown}) from ({sql})"


def table(names=FEATURES, feature_set="v3"):
    """CTE text ending in ``ft``: prices, the features, label_5d and a score."""
    body = feature_sql(names, feature_set, tail="", extra=("o", "h", "l", "c", "vol"))
    cols = ", ".join(n for n in names)
    score = "round((1e0 - rsi14) / 2e0 + 1.3e-8, 3)" if "rsi14" in names else "cast(null as double)"
    return (f"{body.strip()}, ft as (select ticker, date, o as open, h as high, l as low, c as close, cast(vol as bigint) as volume, {cols}, "
            f"case when max(h) over (partition by ticker order by rn rows between 1 following and {H} following) / c - 1e0 > {LABEL_T} then 1 else 0 end as label_5d, "
            f"{score} as probability from feats)")


ADAPTIVE = "case when atr14_normalized is null then 0.04e0 else greatest(0.04e0, least(0.10e0, 1.8e0 * atr14_normalized)) end"
_USED = "coalesce(swing_low_10d > 0 and (open - swing_low_10d) / open > 0, false)"
STOPS = {
    "constant": ("0.075e0", ""),
    "half": ("0.03e0", ""),
    "adaptive_atr": (ADAPTIVE, ""),
    "swing_atr": (
        f"case when {_USED} then greatest(0.04e0, least(0.10e0, (open - swing_low_10d) / open + coalesce(0.75e0 * atr14_normalized, 0e0))) else {ADAPTIVE} end",
        f", {_USED} as used_swing_low, case when {_USED} then (open - swing_low_10d) / open end as swing_distance_pct, "
        f"case when {_USED} then coalesce(0.75e0 * atr14_normalized, 0e0) end as buffer_pct"),
}


def trades(signal, stop="constant", h=H, target=TARGET, where="true", name="trades", source="ft"):
    """CTEs ending in ``name``: the non-overlapping trades of a signal."""
    pct, meta = STOPS[stop]
    extra = [c.split(" as ")[-1].strip() for c in ("used_swing_low", "swing_distance_pct", "buffer_pct")] if meta else []
    more = "".join(f", {c}" for c in ["stop_loss_pct", *extra])
    p = name
    return f"""{p}_src as (select *, row_number() over (partition by ticker order by date) as n from {source} where {where}),
{p}_cand as (select ticker, n, date as entry_date, open as entry_price, {pct} as stop_loss_pct{meta} from {p}_src where {signal}),
{p}_ev as (select a.ticker, a.n, b.n as bn, b.date as bdate,
   case when b.open < f or b.low < f or b.close < f then 'stop_loss'
        when b.n = a.n + {h} then case when b.open / a.entry_price - 1e0 >= {target}e0 then 'target_reached' else 'time_limit' end
        when b.close / a.entry_price - 1e0 >= {target}e0 then 'target_reached' end as reason,
   case when b.open < f then b.open when b.low < f or b.close < f then f when b.n = a.n + {h} then b.open else b.close end as price
   from (select *, entry_price * (1 + -stop_loss_pct) as f from {p}_cand) a join {p}_src b on b.ticker = a.ticker and b.n between a.n + 1 and a.n + {h}),
{p}_hit as (select ticker, n, arg_min(bn, bn) as bn, arg_min(bdate, bn) as bdate, arg_min(reason, bn) as reason, arg_min(price, bn) as price
   from {p}_ev where reason is not null group by ticker, n),
{p}_end as (select ticker, max(n) as ln, arg_max(date, n) as ld, arg_max(close, n) as lc from {p}_src group by ticker),
{p}_ex as materialized (select a.*, coalesce(bn, ln) as exit_n, coalesce(bdate, ld) as exit_date, coalesce(reason, 'end_of_data') as exit_reason, coalesce(price, lc) as exit_price
   from {p}_cand a join {p}_end using (ticker) left join {p}_hit using (ticker, n)),
{p}_nx as materialized (select a.ticker, a.n, min(b.n) as nn from {p}_ex a left join {p}_ex b on b.ticker = a.ticker and b.n > a.exit_n group by a.ticker, a.n),
{p}_sel as (select ticker, min(n) as n from {p}_ex group by ticker union all
   select s.ticker, x.nn from {p}_sel s join {p}_nx x on x.ticker = s.ticker and x.n = s.n where x.nn is not null),
{p}_all as (select ticker, entry_date, entry_price, exit_date, exit_price, exit_price / entry_price - 1e0 as "return", (exit_price / entry_price - 1e0) * 1000e0 as pnl,
   cast(exit_date - entry_date as integer) as holding_days, exit_reason{more}, n, exit_n from {p}_ex),
{name} as (select * exclude (n, exit_n) from {p}_all join {p}_sel using (ticker, n))"""


ENTRY_ORDER = "exit_date, ticker, entry_date"


def metrics(source="trades", group=None):
    """The thirteen metrics of a trade table, per value of ``group`` where given."""
    g = f"{group}, " if group else ""
    part = f"partition by {group} " if group else ""
    key = group or "1"
    return f"""(with eq as (select *, sum(pnl) over ({part}order by {ENTRY_ORDER} rows unbounded preceding) as e from {source}),
dd as (select *, max(e) over ({part}order by {ENTRY_ORDER} rows unbounded preceding) - e as drawdown from eq),
ev as (select {g}ticker, entry_date, entry_date as happened, 1 as step, 0 as kind from {source} union all select {g}ticker, entry_date, exit_date, -1, 1 from {source}),
op as (select {g}sum(step) over ({part}order by happened, ticker, entry_date, kind rows unbounded preceding) as open_now from ev),
mx as (select {g}max(open_now) as mc from op {f'group by {group}' if group else ''}),
ag as (select {g}count(*) as n_trades, avg(cast("return" > 0 as integer)) as win_rate, avg("return") as avg_return, sum(pnl) as total_pnl, avg(pnl) as avg_pnl,
  max(drawdown) as max_drawdown, stddev_samp("return") as sd, avg(holding_days) as avg_holding_days,
  coalesce(sum(pnl) filter (where pnl > 0), 0e0) / nullif(sum(-pnl) filter (where pnl < 0), 0e0) as profit_factor,
  min(entry_date) as fe, max(exit_date) as le from dd {f'group by {group}' if group else ''})
select {g}n_trades, win_rate, avg_return, total_pnl, avg_pnl, max_drawdown,
  case when sd > 0 and avg_holding_days > 0 then avg_return / sd * sqrt(252e0 / avg_holding_days) else 0e0 end as sharpe_ratio, profit_factor, avg_holding_days,
  case when le - fe > 0 then pow(1 + total_pnl / (mc * 1000e0), 365e0 / (le - fe)) - 1 else 0e0 end as annual_return,
  strftime(fe, '%Y-%m-%d') || ' to ' || strftime(le, '%Y-%m-%d') as date_range, cast(mc as bigint) as max_concurrent_positions, mc * 1000e0 as max_capital_invested
from ag {f'join mx using ({group})' if group else 'cross join mx'})"""


METRIC_DOUBLES = ["win_rate", "avg_return", "total_pnl", "avg_pnl", "max_drawdown", "sharpe_ratio", "profit_factor",
                  "avg_holding_days", "annual_return", "max_capital_invested"]
