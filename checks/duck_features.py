"""DuckDB SQL for feature queries: plain per-ticker windows, recursive smoothers.

The SQL has no blocks, halos or warm-ups: windows run over whole tickers and the
smoothers are recursive queries over the row number, so it checks those parts of
the Spark plans independently.
"""

from __future__ import annotations

from dailybars.features.build import SETS, new_sheet
from dailybars.features.v3_periods import MONTHLY, WEEKLY
from dailybars.functions.terms import Sheet, SparkSyntax


class DuckSyntax(SparkSyntax):
    ordered = stepwise = False

    def values(self, x): return f"list({x})", f"filter (where {x} is not null)"
    def quantile(self, x, q): return f"quantile_cont({x}, {q!r})"
    def last_value(self, x): return f"last_value({x} ignore nulls)"
    def skew(self, x, over): return f"(case when min({x}) {over} < max({x}) {over} then skewness({x}) {over} end)"
    def kurt(self, x, over): return f"(case when min({x}) {over} < max({x}) {over} then kurtosis({x}) {over} end)"
    def fold(self, array, start, body):
        term = body.split("acc + ", 1)[1]
        return f"coalesce(list_sum(list_transform({array}, lambda v: {term})), {start})"
    def size(self, array): return f"cast(len({array}) as double)"
    def pair(self, a, b): return f"{{'p': {a}, 'v': {b}}}"
    def sorted(self, array): return f"list_sort({array})"
    def weekday(self, d): return f"cast(isodow({d}) - 1 as double)"
    def days_left(self, d): return f"cast(last_day({d}) - {d} as double)"
    def max_by(self, x, k): return f"arg_max({x}, {k})"
    def min_by(self, x, k): return f"arg_min({x}, {k})"
    def key(self, a, b): return f"row({a}, {b})"

    def volume_level(self, array, share):
        cum = f"list_sum(list_transform({array}[1:i], lambda v: v.v))"
        whole = f"list_sum(list_transform({array}, lambda v: v.v))"
        return (f"coalesce({array}[list_filter(range(1, len({array}) + 1), lambda i: {cum} >= {whole} * {share!r}e0)[1]].p, {array}[-1].p)")

    def near_volume(self, array, price):
        return f"coalesce(list_sum(list_transform({array}, lambda v: case when abs(v.p / {price} - 1e0) <= 0.01e0 then v.v else 0e0 end)), 0e0)"

    def mean_deviation(self, array, mean):
        return f"(list_sum(list_transform({array}, lambda v: abs(v - {mean}))) / len({array}))"

    def cumulative_range(self, array, mean):
        steps = f"list_transform(range(1, len({array}) + 1), lambda i: list_sum(list_transform({array}[1:i], lambda v: v - {mean})))"
        return f"(list_max({steps}) - list_min({steps}))"


BARS = """x as (
  select p_type as ticker, cast(l_shipdate as date) as date,
         round(100*(1 - l_discount + l_tax) + l_quantity/10, 4) as px, l_quantity as q,
         row(l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount, l_tax) as k
  from lineitem join part on p_partkey = l_partkey),
bars as (
  select ticker, date, arg_min(px, k) as open, max(px) as high, min(px) as low,
         arg_max(px, k) as close, cast(sum(q) as bigint) as volume
  from x group by ticker, date),
market as (
  select date, arg_min(px, k) as open, max(px) as high, min(px) as low,
         arg_max(px, k) as close, cast(sum(q) as bigint) as volume
  from x group by date)"""

SECTOR_BARS = """sector_of(ticker, symbol) as (values ('ECONOMY','XLP'), ('SMALL','XLP'), ('MEDIUM','XLI'),
  ('STANDARD','XLI'), ('LARGE','XLK'), ('PROMO','XLF')),
sector_bars as (
  select symbol, date, arg_max(px, k) as close from x join sector_of using (ticker) group by symbol, date)"""

NUMBERED = """numbered as (
  select ticker, date, open as o, high as h, low as l, close as c, cast(volume as double) as vol,
         cast(row_number() over (partition by ticker order by date) as bigint) as rn
  from bars)"""

def _ema_rule(name, value, alpha):
    """First non-null value, then (1 - alpha) * old + alpha * value; null values keep the old one."""
    old = f"s.{name}"
    return {name: (value, f"case when {old} is null then {value} when {value} is null then {old} "
                          f"else (1e0 - {alpha!r}) * {old} + {alpha!r} * ({value}) end")}


def _adx_rules(p):
    out = {}
    for part in ("tr", "up", "dn"):
        n, sm = f"a{p}_{part}", f"x.{part}"
        # expanding mean while the 0-based position is below p, then Wilder's recursion
        out[n] = (sm, f"case when x.rn <= {p} then (s.{n} * (x.rn - 1) + {sm}) / x.rn else s.{n} * ({p} - 1e0) / {p}e0 + {sm} / {p}e0 end")
    return out


def smoothers(source, out, names):
    """CTEs that add the named k_* columns to ``source`` as ``out``."""
    names = sorted(names)
    if not names:
        return [f"{out} as (select * from {source})"]
    ctes = [f"""{out}_in as (
  select *, c - lag(c) over w as dc, c / lag(c) over w - 1e0 as pc,
    greatest(h - l, abs(h - lag(c) over w), abs(l - lag(c) over w)) as tr,
    case when h - lag(h) over w > 0 and h - lag(h) over w > lag(l) over w - l then h - lag(h) over w else 0e0 end as up,
    case when lag(l) over w - l > 0 and lag(l) over w - l > h - lag(h) over w then lag(l) over w - l else 0e0 end as dn,
    least(1e0, greatest(0e0, abs(c - lag(c, 10) over w) / (sum(abs_dc) over (partition by ticker order by rn rows between 9 preceding and current row) + 1e-10))) as er,
    avg(c) over (partition by ticker order by rn rows between 9 preceding and current row) as mean10
  from (select *, abs(c - lag(c) over (partition by ticker order by rn)) as abs_dc from {source})
  window w as (partition by ticker order by rn))"""]
    spans = sorted({int(n[5:]) for n in names if n.startswith("k_ema")}
                   | ({12, 26} if {"k_macd_sig", "k_ppo_sig"} & set(names) else set()))
    rules = {}
    for n in spans:
        rules.update(_ema_rule(f"k_ema{n}", "x.c", 2.0 / (n + 1)))
    if "k_tsi_num" in names or "k_tsi_den" in names:
        rules.update(_ema_rule("e_num", "x.dc", 2.0 / 26))
        rules.update(_ema_rule("e_den", "abs(x.dc)", 2.0 / 26))
    if "k_vol_sq" in names:
        rules.update(_ema_rule("k_vol_sq", "x.pc * x.pc", 0.06))
    for p in (14, 20, 50):
        if f"k_adx{p}" in names:
            rules.update(_adx_rules(p))
    for n in names:
        if n.startswith("k_wilder"):
            p = int(n[8:])
            rules[n] = ("x.c", f"case when x.rn <= {p} then (s.{n} * (x.rn - 1) + x.c) / x.rn else s.{n} * ({p} - 1e0) / {p}e0 + x.c / {p}e0 end")
    if "k_kama" in names:
        rate = "(x.er * (2e0/3e0 - 2e0/31e0) + 2e0/31e0)"
        rules["k_kama"] = ("cast(null as double)",
                           f"case when x.rn <= 10 then case when x.rn = 10 then x.mean10 end else s.k_kama + {rate} * {rate} * (x.c - s.k_kama) end")
    ctes.append(_recursion(f"{out}_in", f"{out}_1", rules, f"x.ticker, x.rn"))
    # second pass: smoothers of smoothers
    second, cols = {}, []
    if "k_macd_sig" in names:
        second.update(_ema_rule("k_macd_sig", "(x.k_ema12 - x.k_ema26)", 0.2))
    if "k_ppo_sig" in names:
        second.update(_ema_rule("k_ppo_sig", "((x.k_ema12 - x.k_ema26) / x.k_ema26)", 0.2))
    if "k_tsi_num" in names:
        second.update(_ema_rule("k_tsi_num", "x.e_num", 2.0 / 14))
    if "k_tsi_den" in names:
        second.update(_ema_rule("k_tsi_den", "x.e_den", 2.0 / 14))
    for p in (14, 20, 50):
        if f"k_adx{p}" in names:
            up, dn = f"(100e0 * (x.a{p}_up / nullif(x.a{p}_tr, 0e0)))", f"(100e0 * (x.a{p}_dn / nullif(x.a{p}_tr, 0e0)))"
            second.update(_ema_rule(f"d{p}", f"(100e0 * abs({up} - {dn}) / nullif({up} + {dn}, 0e0))", 2.0 / (p + 1)))
    last = f"{out}_1"
    if second:
        ctes.append(_recursion(f"{out}_1", f"{out}_2", second, "x.ticker, x.rn"))
    made = []
    for n in names:
        if n.startswith("k_adx"):
            made.append(f"case when b.d{n[5:]} is not null then least(1e0, greatest(0e0, b.d{n[5:]} / 100e0)) end as {n}")
        else:
            made.append(f"{'b' if n in second else 'a'}.{n}")
    join = f" join {out}_2 b using (ticker, rn)" if second else ""
    ctes.append(f"{out} as (select t.*, {', '.join(made)} from {source} t join {out}_1 a using (ticker, rn){join})")
    return ctes


def _recursion(source, out, rules, keys):
    if not rules:
        return f"{out} as (select ticker, rn from {source})"
    first = ", ".join(f"cast({f} as double) as {n}" for n, (f, _) in rules.items())
    step = ", ".join(f"{s} as {n}" for n, (_, s) in rules.items())
    return (f"{out} as (select {keys}, {first} from {source} x where x.rn = 1 union all "
            f"select {keys}, {step} from {out} s join {source} x on x.ticker = s.ticker and x.rn = s.rn + 1)")


def sheet_ctes(sheet, outputs, source, out, keep):
    """One CTE per stage; the last one selects the outputs."""
    stages, _ = sheet.stages(outputs)
    ctes, prev = [], source
    for i, (passed, made, _) in enumerate(stages):
        through = list(dict.fromkeys([*keep, *passed]))
        name = f"{out}_s{i}"
        ctes.append(f"{name} as (select {', '.join([*through, *(f'{sql} as {n}' for n, sql in made)])} from {prev})")
        prev = name
    cols = [f"{t.sql} as {n}" for n, t in outputs.items()]
    ctes.append(f"{out} as (select {', '.join([*keep, *cols])} from {prev})")
    return ctes


def _period_ctes(kind, names):
    registry = WEEKLY if kind == "week" else MONTHLY
    label = "date + cast((12 - isodow(date)) % 7 as integer)" if kind == "week" else "last_day(date)"
    sheet = Sheet(registry, syntax=DuckSyntax(), partition=("ticker",))
    outputs = {n: sheet.f(n) for n in sorted(names)}
    ctes = [f"{kind}_bars as (select *, cast(row_number() over (partition by ticker order by date) as bigint) as rn from ("
            f"select ticker, {label} as date, arg_max(c, date) as c, max(h) as h, min(l) as l, sum(vol) as vol "
            f"from numbered group by ticker, {label}))"]
    ctes += smoothers(f"{kind}_bars", f"{kind}_k", {b for b in sheet.used_base if b.startswith("k_")})
    ctes += sheet_ctes(sheet, outputs, f"{kind}_k", f"{kind}_f", ["ticker", "date"])
    return ctes


def base_ctes(used):
    """CTEs ending in ``base``: numbered bars plus the other columns that are read."""
    ctes = [NUMBERED]
    ctes += smoothers("numbered", "smooth", {b for b in used if b.startswith("k_")})
    cols, joins = ["t.*"], []
    if "obv" in used:
        ctes.append("balance as (select ticker, rn, sum(case when dc = 0 then 0e0 when dc > 0 then vol else -vol end) "
                    "over (partition by ticker order by rn rows unbounded preceding) as obv from "
                    "(select *, c - lag(c) over (partition by ticker order by rn) as dc from numbered))")
        cols.append("balance.obv")
        joins.append("join balance on balance.ticker = t.ticker and balance.rn = t.rn")
    weekly, monthly = {b for b in used if b.startswith("wk_")}, {b for b in used if b.startswith("mo_")}
    if weekly:
        ctes += _period_ctes("week", weekly)
        cols += [f"wk.{n}" for n in sorted(weekly)]
        joins.append("left join week_f wk on wk.ticker = t.ticker and wk.date = t.date - cast((isodow(t.date) + 2) % 7 as integer)")
    if monthly:
        ctes += _period_ctes("month", monthly)
        cols += [f"mo.{n}" for n in sorted(monthly)]
        joins.append("left join month_f mo on mo.ticker = t.ticker and mo.date = cast(date_trunc('month', t.date + 1) as date) - 1")
    if "m" in used:
        cols.append("mk.close as m")
        joins.append("asof left join market mk on mk.date <= t.date")
    if "s" in used:
        ctes.append(SECTOR_BARS)
        cols.append("sb.close as s")
        joins.append("left join sector_of so on so.ticker = t.ticker asof left join sector_bars sb on sb.symbol = so.symbol and sb.date <= t.date")
    ctes.append(f"base as (select {', '.join(cols)} from smooth t {' '.join(joins)})")
    return ctes


def feature_sql(names, feature_set="v3", shown=None, tail=None, extra=()):
    """Whole statement: ticker, date and the rounded features (or ``tail`` over ``feats``)."""
    registry = SETS[feature_set]
    sheet = new_sheet(registry, syntax=DuckSyntax(), partition=("ticker",))
    outputs = {n: sheet.f(n) for n in names}
    used = set(sheet.used_base)
    ctes = [BARS]
    run_ctes = []
    if used & {"run_vr", "run_gr"}:
        inner = new_sheet(registry, syntax=DuckSyntax(), partition=("ticker",))
        regimes = {"vr": inner.f("volatility_regime"), "gr": inner.f("gain_regime")}
        run_ctes = sheet_ctes(inner, regimes, "base", "regimes", ["ticker", "rn"])
        run_ctes.append(
            "vr_runs as (select ticker, rn, cast(rn - max(start) over (partition by ticker order by rn rows unbounded preceding) + 1 as double) as run_vr from "
            "(select ticker, rn, case when rn = 1 or abs(vr - lag(vr) over (partition by ticker order by rn)) > 0.1 then rn end as start from regimes))")
        run_ctes.append(
            "gr_runs as (select ticker, rn, gr as anchor, 1e0 as run_gr from regimes where rn = 1 union all "
            "select x.ticker, x.rn, case when abs(x.gr - s.anchor) > 0.2 then x.gr else s.anchor end, "
            "case when abs(x.gr - s.anchor) > 0.2 then 1e0 else s.run_gr + 1e0 end "
            "from gr_runs s join regimes x on x.ticker = s.ticker and x.rn = s.rn + 1)")
        run_ctes.append("based as (select t.*, v.run_vr, g.run_gr from base t join vr_runs v on v.ticker = t.ticker and v.rn = t.rn "
                        "join gr_runs g on g.ticker = t.ticker and g.rn = t.rn)")
        used |= inner.used_base
    ctes += base_ctes(used)
    ctes += run_ctes
    ctes += sheet_ctes(sheet, outputs, "based" if run_ctes else "base", "feats", ["ticker", "date", "rn", *extra])
    if tail is None:
        tail = f"select ticker, date, {', '.join(f'{shown(n)} as {n}' for n in names)} from feats"
    return f"with recursive {', '.join(ctes)} {tail}"
