"""SQL expression terms for indicators over ticker-ordered windows.

A feature is a function of a :class:`Sheet` that returns a :class:`Term`: a
piece of Spark SQL text, the window depth it needs and how many earlier rows it
looks at.  Window functions cannot nest in SQL, so the sheet gives every window
result and every named intermediate a column of its own; ``stages()`` lists the
``select`` steps in order.  ``plans.frames`` runs them with ``selectExpr``.

Null rules: division by zero is null, a null comparison counts as false in
``flag``/``iff`` (true for ``differs``), ``clip`` keeps null, ``least`` and
``greatest`` skip null, the logarithm of a non-positive number is null.
"""

from __future__ import annotations

from dataclasses import dataclass

EPS = 1e-10
TIE = 1e-12
STEP = 16


def literal(x) -> str:
    """A double literal that Spark does not read as a decimal."""
    text = repr(float(x))
    text = text if "e" in text else text + "e0"
    return f"({text})" if text.startswith("-") else text


@dataclass(frozen=True, eq=False)
class Term:
    sheet: "Sheet"
    sql: str
    level: int = 0
    temp: int = 0
    back: int = 0
    deps: frozenset = frozenset()

    def _bin(self, op, other, swap=False):
        a, b = (self.sheet.term(other), self) if swap else (self, self.sheet.term(other))
        if op == "/":
            return self.sheet.join(f"({a.sql} / nullif({b.sql}, 0e0))", a, b)
        return self.sheet.join(f"({a.sql} {op} {b.sql})", a, b)

    def __add__(self, o): return self._bin("+", o)
    def __radd__(self, o): return self._bin("+", o, True)
    def __sub__(self, o): return self._bin("-", o)
    def __rsub__(self, o): return self._bin("-", o, True)
    def __mul__(self, o): return self._bin("*", o)
    def __rmul__(self, o): return self._bin("*", o, True)
    def __truediv__(self, o): return self._bin("/", o)
    def __rtruediv__(self, o): return self._bin("/", o, True)
    def __lt__(self, o): return self._bin("<", o)
    def __le__(self, o): return self._bin("<=", o)
    def __gt__(self, o): return self._bin(">", o)
    def __ge__(self, o): return self._bin(">=", o)
    def equals(self, o): return self._bin("=", o)
    def differs(self, o):
        b = self.sheet.term(o)
        return self.sheet.join(f"coalesce({self.sql} <> {b.sql}, true)", self, b)
    def __and__(self, o): return self._bin("and", o)
    def __or__(self, o): return self._bin("or", o)
    def __invert__(self): return self.sheet.join(f"(not coalesce({self.sql}, false))", self)
    def __neg__(self): return self.sheet.join(f"(- {self.sql})", self)
    def is_null(self): return self.sheet.join(f"({self.sql} is null)", self)
    def squared(self):
        x = self.sheet.keep(self)
        return x * x

    def __bool__(self):
        raise TypeError("use & | ~ on terms")



class SparkSyntax:
    """Window-aggregate spellings that differ between SQL engines."""

    #: counts of a window below a limit are columns of their own (plans.order_stats), not folds over arrays
    ordered = True
    #: long frames of counts and extremes are put together from short ones
    stepwise = True

    def values(self, x): return f"collect_list({x})", ""
    def quantile(self, x, q): return f"percentile({x}, {q!r})"
    def last_value(self, x): return f"last_value({x}) ignore nulls"

    def skew(self, x, over):
        n = f"count({x}) {over}"
        return (f"(case when {n} > 2 then skewness({x}) {over} * sqrt(cast({n} as double) * ({n} - 1))"
                f" / nullif(cast({n} - 2 as double), 0e0) end)")

    def kurt(self, x, over):
        n = f"cast(count({x}) {over} as double)"
        return (f"(case when {n} > 3 then ((({n} + 1) * (kurtosis({x}) {over}) + 6) * ({n} - 1))"
                f" / nullif(({n} - 2) * ({n} - 3), 0e0) end)")

    def fold(self, array, start, body):
        return f"aggregate({array}, {start}, (acc, v) -> {body})"

    def size(self, array): return f"cast(size({array}) as double)"
    def pair(self, a, b): return f"named_struct('p', {a}, 'v', {b})"
    def sorted(self, array): return f"sort_array({array})"
    def weekday(self, d): return f"cast(weekday({d}) as double)"
    def days_left(self, d): return f"cast(datediff(last_day({d}), {d}) as double)"
    def max_by(self, x, k): return f"max_by({x}, {k})"
    def min_by(self, x, k): return f"min_by({x}, {k})"
    def key(self, a, b): return f"struct({a}, {b})"

    def volume_level(self, array, share):
        """Lowest price whose cumulative volume reaches ``share`` of the total."""
        total = f"aggregate({array}, 0e0, (acc, v) -> acc + v.v)"
        return (f"aggregate({array}, named_struct('c', 0e0, 'p', cast(null as double), 't', {total}), (acc, v) -> "
                f"named_struct('c', acc.c + v.v, 'p', case when acc.p is not null then acc.p "
                f"when acc.c + v.v >= acc.t * {share!r}e0 then v.p end, 't', acc.t), acc -> coalesce(acc.p, element_at({array}, -1).p))")

    def near_volume(self, array, price):
        return (f"aggregate({array}, 0e0, (acc, v) -> acc + case when abs(v.p / {price} - 1e0) <= 0.01e0 then v.v else 0e0 end)")

    def mean_deviation(self, array, mean):
        return f"(aggregate({array}, 0e0, (acc, v) -> acc + abs(v - {mean})) / size({array}))"

    def cumulative_range(self, array, mean):
        return (f"aggregate({array}, named_struct('s', 0e0, 'lo', cast(null as double), 'hi', cast(null as double)), (acc, v) -> "
                f"named_struct('s', acc.s + (v - {mean}), 'lo', least(acc.lo, acc.s + (v - {mean})), 'hi', greatest(acc.hi, acc.s + (v - {mean}))),"
                f" acc -> acc.hi - acc.lo)")


class Sheet:
    """Collects the columns that a set of features needs."""

    def __init__(self, registry=None, base=(), syntax=None, partition=("ticker", "blk"), constants=None):
        self.registry = registry or {}
        self.syntax = syntax or SparkSyntax()
        self.partition = ", ".join(partition)
        self.constants = constants or {}
        self.windows = {}      # sql -> (name, level, deps)
        self.temps = {}        # sql -> (name, level, temp, deps)
        self.counts = {}       # (value, tolerance, rows) -> (name, level, deps)
        self.used_base = set()
        self._features = {}
        self._building = []
        self.n = 0
        self.prefix = ""

    # ---- terms -----------------------------------------------------------
    def base(self, name, back=0):
        if name in self.constants:
            return self.term(self.constants[name])
        self.used_base.add(name)
        return Term(self, name, 0, 0, back, frozenset([name]))

    O = property(lambda self: self.base("o"))
    H = property(lambda self: self.base("h"))
    L = property(lambda self: self.base("l"))
    C = property(lambda self: self.base("c"))
    V = property(lambda self: self.base("vol"))
    M = property(lambda self: self.base("m"))
    S = property(lambda self: self.base("s"))
    rn = property(lambda self: self.base("rn"))
    date = property(lambda self: self.base("date"))

    def term(self, x):
        if isinstance(x, Term):
            return x
        if x is None:
            return Term(self, "cast(null as double)")
        if isinstance(x, bool):
            return Term(self, "true" if x else "false")
        return Term(self, literal(x))

    def join(self, sql, *terms):
        level = max(t.level for t in terms)
        temp = max((t.temp for t in terms if t.level == level), default=0)
        return Term(self, sql, level, temp, max(t.back for t in terms), frozenset().union(*(t.deps for t in terms)))

    def call(self, name, *args):
        ts = [self.term(a) for a in args]
        return self.join(f"{name}({', '.join(t.sql for t in ts)})", *ts)

    def keep(self, x, name=None):
        """Give a term a column of its own (once per distinct text)."""
        x = self.term(x)
        if x.sql.isidentifier() or x.sql.replace(".", "").replace("e", "").replace("-", "").isdigit():
            return x
        if x.sql not in self.temps:
            self.n += 1
            self.temps[x.sql] = (name or f"t{self.n}", x.level, x.temp + 1, x.deps)
        name, level, temp, _ = self.temps[x.sql]
        return Term(self, name, level, temp, x.back, frozenset([name]))

    def window(self, sql, args, back, prior=None):
        args = [self.term(a) for a in args]
        level = max((t.level for t in args), default=0) + 1
        deps = frozenset().union(*(t.deps for t in args)) | {"ticker", "rn"} | ({"blk"} if "blk" in self.partition else set())
        if sql not in self.windows:
            self.n += 1
            self.windows[sql] = (f"w{self.n}", level, deps)
        name, level, _ = self.windows[sql]
        return Term(self, name, level, 0, max((t.back for t in args), default=0) + back, frozenset([name]))

    def frame(self, lo, hi):
        def edge(k):
            return "current row" if k == 0 else f"{-k} preceding" if k < 0 else f"{k} following"
        return f"over (partition by {self.partition} order by rn rows between {edge(lo)} and {edge(hi)})"

    def f(self, name):
        """Another feature as an input (one column, many readers)."""
        if name not in self._features:
            if name in self._building:
                raise ValueError(f"cycle: {self._building + [name]}")
            self._building.append(name)
            self._features[name] = self.keep(self.registry[name](self), f"{self.prefix}{name}")
            self._building.pop()
        return self._features[name]

    # ---- windows -----------------------------------------------------------
    def lag(self, x, k=1):
        x = self.keep(x)
        return self.window(f"lag({x.sql}, {k}) over (partition by {self.partition} order by rn)", [x], k)

    def roll(self, fn, x, w, m=1, prev=False):
        """``fn`` over the last ``w`` rows (or the ``w`` rows before this one)."""
        x = self.keep(x)
        lo, hi = (-w, -1) if prev else (-(w - 1), 0)
        out = self.window(f"{fn}({x.sql}) {self.frame(lo, hi)}", [x], -lo)
        if m > 1:
            out = self.iff(self.count(x, w, prev) >= m, out, None)
        return out

    def avg(self, x, w, m=1, prev=False): return self.roll("avg", x, w, m, prev)
    def sum(self, x, w, m=1, prev=False): return self.roll("sum", x, w, m, prev)
    def std(self, x, w, m=1, prev=False): return self.roll("stddev_samp", x, w, m, prev)
    def var(self, x, w, m=1, prev=False): return self.roll("var_samp", x, w, m, prev)
    def var_pop(self, x, w, m=1, prev=False): return self.roll("var_pop", x, w, m, prev)
    def max(self, x, w, m=1, prev=False): return self.extreme("max", x, w, m, prev)
    def min(self, x, w, m=1, prev=False): return self.extreme("min", x, w, m, prev)

    def extreme(self, fn, x, w, m, prev):
        """Spark folds a whole frame for every row, so the extreme of a long one is that of a few short ones further back."""
        if not self.syntax.stepwise or w < 3 * STEP:
            return self.roll(fn, x, w, m, prev)
        x = self.keep(x)
        short = self.window(f"{fn}({x.sql}) {self.frame(-(STEP - 1), 0)}", [x], STEP - 1)
        steps = [k + int(prev) for k in (*range(0, w - STEP, STEP), w - STEP)]
        out = self.keep(self.call("greatest" if fn == "max" else "least", *(self.lag(short, k) if k else short for k in steps)))
        return self.iff(self.count(x, w, prev) >= m, out, None) if m > 1 else out

    def count(self, x, w, prev=False):
        x = self.keep(x)
        if self.syntax.stepwise and w >= 3 * STEP:  # counts up to a row, less those up to the row before the frame
            upto = self.window(f"count({x.sql}) over (partition by {self.partition} order by rn rows between unbounded preceding and current row)", [x], 0)
            before = lambda k: self.window(f"lag({upto.sql}, {k}, 0L) over (partition by {self.partition} order by rn)", [upto], w - 1)
            return self.keep((before(1) if prev else upto) - before(w + int(prev)))
        lo, hi = (-w, -1) if prev else (-(w - 1), 0)
        return self.window(f"count({x.sql}) {self.frame(lo, hi)}", [x], -lo)

    def at_least(self, x, w, m, value):
        return self.iff(self.count(x, w) >= m, value, None) if m > 1 else value

    def quantile(self, x, q, w, m=1):
        x = self.keep(x)
        out = self.window(f"{self.syntax.quantile(x.sql, q)} {self.frame(-(w - 1), 0)}", [x], w - 1)
        return self.at_least(x, w, m, out)

    def skew(self, x, w, m):
        x = self.keep(x)
        return self.at_least(x, w, m, self.window(self.syntax.skew(x.sql, self.frame(-(w - 1), 0)), [x], w - 1))

    def kurt(self, x, w, m):
        x = self.keep(x)
        return self.at_least(x, w, m, self.window(self.syntax.kurt(x.sql, self.frame(-(w - 1), 0)), [x], w - 1))

    def values(self, x, lo, hi):
        x = self.keep(x)
        head, tail = self.syntax.values(x.sql)
        return self.window(f"{head} {tail} {self.frame(lo, hi)}", [x], -lo)

    def window_counts(self, x, w, scale=None):
        """How many values of the last ``w`` rows lie below the current one, and how many not above it.

        Values tie if they differ by at most ``TIE`` of ``scale`` (the current value, or what a small difference
        of large numbers was made from), so last bits do not matter in any unit.
        """
        x = self.keep(x)
        scale = x if scale is None else self.keep(scale)
        near = f"{TIE!r} * abs({scale.sql})"
        if not self.syntax.ordered:
            arr = self.values(x, -(w - 1), 0)
            count = lambda sign: self.join(self.syntax.fold(arr.sql, "0e0", f"acc + case when v {sign} {near} then 1e0 else 0e0 end"), arr, x, scale)
            return count(f"< {x.sql} -"), count(f"<= {x.sql} +")
        key = (x.sql, near, w)
        if key not in self.counts:
            self.n += 1
            self.counts[key] = (f"n{self.n}", max(x.level, scale.level) + 1, x.deps | scale.deps | {"ticker", "blk", "rn"})
        name, level, _ = self.counts[key]
        back = max(x.back, scale.back) + w - 1
        return tuple(Term(self, f"{name}{k}", level, 0, back, frozenset([f"{name}{k}"])) for k in "ba")

    def prank(self, x, w, m=1, scale=None):
        """Average rank of the current value within its window, as a share (see ``window_counts`` for ties)."""
        x = self.keep(x)
        if not self.syntax.ordered:
            scale = x if scale is None else self.keep(scale)
            arr, near = self.values(x, -(w - 1), 0), f"{TIE!r} * abs({scale.sql})"
            twice = self.syntax.fold(arr.sql, "0e0", f"acc + case when v < {x.sql} - {near} then 2e0 when v <= {x.sql} + {near} then 1e0 else 0e0 end")
            size = self.syntax.size(arr.sql)
            return self.keep(self.join(
                f"(case when {x.sql} is not null and {size} >= {m} then ({twice} + 1e0) / 2e0 / nullif({size}, 0e0) end)", arr, x, scale))
        below, upto = self.window_counts(x, w, scale)
        size = self.count(x, w)
        return self.keep(self.join(
            f"(case when {x.sql} is not null and {size.sql} >= {m} then ({below.sql} + {upto.sql} + 1e0) / 2e0 / nullif(cast({size.sql} as double), 0e0) end)",
            x, below, upto, size))

    def corr(self, a, b, w, m=1, prev=False, whole=False):
        """Pearson correlation, null pairs skipped, null when a side is constant."""
        lo, hi = (-w, -1) if prev else (-(w - 1), 0)
        a, b = self.keep(a), self.keep(b)
        both = ~(a.is_null() | b.is_null())
        x, y = self.keep(self.iff(both, a, None)), self.keep(self.iff(both, b, None))
        cov = self.window(f"covar_samp({x.sql}, {y.sql}) {self.frame(lo, hi)}", [x, y], -lo)
        r = lambda fn, v: self.roll(fn, v, w, 1, prev)
        ok = (r("min", x) < r("max", x)) & (r("min", y) < r("max", y))
        if whole or m > 1:
            ok = ok & (self.count(x, w, prev) >= (w if whole else m))
        return self.keep(self.iff(ok, cov / (r("stddev_samp", x) * r("stddev_samp", y)), None))

    def pcorr20(self, a, b, whole=False):
        return self.keep(self.iff(self.rn > 20, self.corr(a, b, 20, prev=True, whole=whole), None))

    def slope(self, x, w, m=1, prev=False):
        x, rn = self.keep(x), self.rn
        lo, hi = (-w, -1) if prev else (-(w - 1), 0)
        out = self.window(f"regr_slope({x.sql}, {rn.sql}) {self.frame(lo, hi)}", [x, rn], -lo)
        return self.at_least(x, w, m, out)

    def ols_slope(self, y, x, w):
        """Slope of y on x over the previous w rows."""
        y, x = self.keep(y), self.keep(x)
        return self.window(f"regr_slope({y.sql}, {x.sql}) {self.frame(-w, -1)}", [y, x], w)

    def line_residual(self, x, w):
        """(last - fitted last) / last of the least-squares line over w rows."""
        x, rn = self.keep(x), self.rn
        fit = [self.window(f"{fn}({x.sql}, {rn.sql}) {self.frame(-(w - 1), 0)}", [x, rn], w - 1)
               for fn in ("regr_slope", "avg")]
        xm = self.avg(x, w)
        centre = self.window(f"avg({rn.sql}) {self.frame(-(w - 1), 0)}", [rn], w - 1)
        fitted = xm + fit[0] * (rn - centre)
        return self.iff(self.count(x, w) >= w, (x - fitted) / x, None)

    def mean_deviation(self, x, w):
        x = self.keep(x)
        arr, mean = self.values(x, -(w - 1), 0), self.avg(x, w, w)
        mean = self.keep(mean)
        return self.keep(self.join(f"(case when {mean.sql} is not null then {self.syntax.mean_deviation(arr.sql, mean.sql)} end)", arr, mean))

    def last_known(self, x, w):
        """Latest non-null value among this row and the w rows before it."""
        x = self.keep(x)
        return self.window(f"{self.syntax.last_value(x.sql)} {self.frame(-w, 0)}", [x], w)

    def run_length(self, starts, cap):
        """Rows since ``starts`` was last true, counting that row, but ``cap`` at most (for measures that saturate there)."""
        mark = self.keep(self.iff(starts | (self.rn.equals(1)), self.rn, None))
        last = self.last_known(mark, cap - 1)
        return self.fill(self.rn - last + 1, cap)

    # ---- row-wise -------------------------------------------------------
    def fill(self, x, v): return self.call("coalesce", x, v)
    def nz(self, x): return self.join(f"nullif({x.sql}, 0e0)", x)
    def zero_to(self, x, v):
        x = self.keep(x)
        return self.iff(x.equals(0), v, x)
    def greatest(self, *xs): return self.call("greatest", *xs)
    def least(self, *xs): return self.call("least", *xs)
    def abs(self, x): return self.call("abs", x)
    def sqrt(self, x): return self.call("sqrt", x)
    def exp(self, x): return self.call("exp", x)
    def tanh(self, x): return self.call("tanh", x)
    def sin(self, x): return self.call("sin", x)
    def cos(self, x): return self.call("cos", x)
    def sign(self, x): return self.join(f"cast(sign({x.sql}) as double)", x)

    def ln(self, x):
        x = self.keep(x)
        return self.join(f"(case when {x.sql} > 0e0 then ln({x.sql}) end)", x)

    def log1p(self, x): return self.ln(1.0 + self.term(x))

    def iff(self, cond, a, b):
        cond, a, b = self.term(cond), self.term(a), self.term(b)
        return self.join(f"(case when {cond.sql} then {a.sql} else {b.sql} end)", cond, a, b)

    def flag(self, cond): return self.iff(cond, 1.0, 0.0)

    def round(self, x, digits):
        x = self.term(x)
        return self.keep(self.join(f"round({x.sql}, {digits})", x))

    def above(self, a, b):
        """a > b by more than rounding, so that equal averages are not ordered by their last bit."""
        a, b = self.term(a), self.term(b)
        return (a - b) > 1e-12 * self.abs(b)

    def clip(self, x, lo=None, hi=None):
        x = self.keep(x)
        inner = x.sql if hi is None else f"least({literal(hi)}, {x.sql})"
        inner = inner if lo is None else f"greatest({literal(lo)}, {inner})"
        return self.join(f"(case when {x.sql} is not null then {inner} end)", x)

    def unit(self, x): return self.clip(x, 0.0, 1.0)

    # ---- common shapes --------------------------------------------------
    def diff(self, x, k=1):
        x = self.keep(x)
        return x - self.lag(x, k)

    def pct(self, x, k=1):
        x = self.keep(x)
        return self.keep(x / self.lag(x, k) - 1.0)

    def roc(self, k): return self.pct(self.C, k)
    def logret(self, k): return self.ln(self.C / self.lag(self.C, k))
    def tp(self): return self.keep((self.H + self.L + self.C) / 3.0)

    def true_range(self):
        pc = self.lag(self.C)
        return self.keep(self.greatest(self.H - self.L, self.abs(self.H - pc), self.abs(self.L - pc)))

    def atr(self, p): return self.avg(self.true_range(), p)

    def rsi_of(self, x, p):
        d = self.keep(self.diff(x))
        gain = self.avg(self.clip(d, 0.0), p)
        loss = self.avg(-self.clip(d, None, 0.0), p)
        return self.keep(100.0 - 100.0 / (1.0 + gain / self.zero_to(loss, EPS)))

    def rsi(self, p): return self.rsi_of(self.C, p)
    def band(self, x, w): return self.min(x, w), self.max(x, w)

    def scaled_by_max(self, x, w=252):
        """x / (trailing max + eps)"""
        x = self.keep(x)
        return x / (self.max(x, w) + EPS)

    def minmax(self, x, w=252):
        x = self.keep(x)
        lo, hi = self.min(x, w), self.max(x, w)
        return (x - lo) / ((hi - lo) + EPS)

    def rank_or_half(self, x, w=252, m=1, scale=None):
        return self.unit(self.fill(self.prank(x, w, m, scale), 0.5))

    # ---- stages ---------------------------------------------------------
    def stages(self, outputs):
        """Ordered (passed, [(name, sql)], [(name, counts)]) steps with only the columns still needed.

        Counts that no window reads come behind all windows, with what is made of them: they need the rows in order, but
        Spark, which does not see that counts keep it, would deal them out again for a window.
        """
        items = {name: ("window", (level, 0), sql, deps) for sql, (name, level, deps) in self.windows.items()}
        items |= {name: ("temp", (level, temp), sql, deps) for sql, (name, level, temp, deps) in self.temps.items()}
        for key, (name, level, deps) in self.counts.items():
            items[name] = ("counts", (level, 0), key, deps)
        owner = {f"{name}{k}": name for name, _, _ in self.counts.values() for k in "ba"}

        def closure(names):
            found, open_ = set(), [owner.get(n, n) for n in names]
            while open_:
                name = open_.pop()
                if name in items and name not in found:
                    found.add(name)
                    open_.extend(owner.get(n, n) for n in items[name][3])
            return found

        live = frozenset().union(*(t.deps for t in outputs.values()))
        used = closure(live)
        fed = closure(d for n in used if items[n][0] == "window" for d in items[n][3])
        late = {n for n in used - fed if items[n][0] == "counts"}
        behind = 1 + max((key[0] for _, key, _, _ in items.values()), default=0)
        steps = {}
        for name in sorted(used, key=lambda n: int(n[1:]) if n[1:].isdigit() else 0):
            kind, (level, temp), made, deps = items[name]
            after = name in late or (kind == "temp" and name not in fed and closure(deps) & late)
            steps.setdefault((level + behind * bool(after), temp), []).append((name, made, deps))
        plan = []
        for key in sorted(steps, reverse=True):
            plain = [(n, s) for n, s, _ in steps[key] if isinstance(s, str)]
            counts = [(n, s) for n, s, _ in steps[key] if not isinstance(s, str)]
            passed = sorted(live - {n for n, _ in plain})
            plan.append((passed, plain, counts))
            made = {n for n, _ in plain} | {f"{n}{k}" for n, _ in counts for k in "ba"}
            live = (live - made).union(*(d for _, _, d in steps[key]))
        return list(reversed(plan)), sorted(live)
