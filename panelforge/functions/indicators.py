"""Technical indicators over each row's own history, as Column expressions.

A row carries its last 20 returns and volumes as sibling columns
(``RET_1`` = most recent).  The history is read oldest first (position 1 =
``RET_20``, position 20 = ``RET_1``), forward-filled, and every indicator is
computed per row: no shuffle, no window, no Python.  A series starts at its
first non-NULL position b; an indicator with lookback L is defined from
position b + L on.

Windowed indicators (SMA, WMA, MOM, ROCR, MIDPOINT) are arithmetic on literal
array positions; recursive ones (EMA, RSI, CMO, OBV) are one ``aggregate``
fold per row whose state carries the running values and the output array.

Output columns are named ``{NAME}_{position}_{label}``; the label (2, 5, 14)
is only a name, all labels of one indicator are the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INDICATOR_PERIOD_LABELS, N_LAGS
from ..session import materialize

# Near-zero test used for RSI / CMO denominators (fixed value).
ZERO_TOL = 1e-8

def _empty() -> Column:
    return F.array().cast("array<double>")


def history(prefix: str, n: int = N_LAGS) -> Column:
    """``array(prefix_n, ..., prefix_1)``: oldest first."""
    return F.array(*[F.col(f"{prefix}_{k}").cast("double") for k in range(n, 0, -1)])


def ffill(arr: Column) -> Column:
    """Each position takes the last non-NULL value so far; leading NULLs stay."""
    return F.aggregate(arr, _empty(), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(x, F.try_element_at(acc, F.lit(-1))))))


def first_valid(arr: Column) -> Column:
    """1-based position of the first non-NULL element, 0 if none."""
    return F.array_position(F.transform(arr, lambda x: x.isNotNull()), True).cast("int")


# ---- windowed indicators: value at literal position p ------------------------

def _at(arr: Column, p: int) -> Column:
    return arr.getItem(p - 1)


def _sma(x: Column, p: int, n: int) -> Column:
    total = _at(x, p - n + 1)
    for j in range(p - n + 2, p + 1):
        total = total + _at(x, j)
    return total / n


def _wma(x: Column, p: int, n: int) -> Column:
    total = _at(x, p - n + 1) * 1
    for w, j in enumerate(range(p - n + 2, p + 1), start=2):
        total = total + _at(x, j) * w
    return total / (n * (n + 1) / 2)


def _mom(x: Column, p: int, n: int) -> Column:
    return _at(x, p) - _at(x, p - n)


def _rocr(x: Column, p: int, n: int) -> Column:
    prev = _at(x, p - n)
    return F.when(prev != 0, _at(x, p) / prev).otherwise(F.lit(0.0))


def _midpoint(x: Column, p: int, n: int) -> Column:
    s = F.slice(x, p - n + 1, n)
    return (F.array_max(s) + F.array_min(s)) / 2


# ---- recursive indicators: one fold per row ------------------------------------

def _ema_fold(x: Column, n: int) -> Column:
    k = 2.0 / (n + 1)
    init = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("s"),
                    F.lit(None).cast("double").alias("e"), _empty().alias("o"))

    def step(acc, v):
        c = acc["c"] + F.when(v.isNotNull(), 1).otherwise(0)
        s = F.when(v.isNotNull() & (c <= n), acc["s"] + v).otherwise(acc["s"])
        e = (F.when(v.isNull() | (c < n), F.lit(None).cast("double"))
             .when(c == n, s / n)
             .otherwise((v - acc["e"]) * k + acc["e"]))
        return F.struct(c.alias("c"), s.alias("s"), e.alias("e"), F.concat(acc["o"], F.array(e)).alias("o"))

    return F.aggregate(x, init, step, lambda acc: acc["o"])


def _wilder_fold(x: Column, n: int, out: Callable[[Column, Column], Column]) -> Column:
    """Wilder smoothing of gains and losses (RSI / CMO): the first average is the
    mean of the first n changes, then avg = (avg * (n - 1) + current) / n."""
    init = F.struct(F.lit(0).alias("c"), F.lit(None).cast("double").alias("prev"),
                    F.lit(0.0).alias("g"), F.lit(0.0).alias("l"), _empty().alias("o"))

    def step(acc, v):
        d = v - acc["prev"]
        gain = F.when(d > 0, d).otherwise(F.lit(0.0))
        loss = F.when(d < 0, -d).otherwise(F.lit(0.0))
        has = v.isNotNull() & acc["prev"].isNotNull()
        c = acc["c"] + F.when(has, 1).otherwise(0)
        g = (F.when(~has, acc["g"])
             .when(c < n, acc["g"] + gain)
             .when(c == n, (acc["g"] + gain) / n)
             .otherwise((acc["g"] * (n - 1) + gain) / n))
        lo = (F.when(~has, acc["l"])
              .when(c < n, acc["l"] + loss)
              .when(c == n, (acc["l"] + loss) / n)
              .otherwise((acc["l"] * (n - 1) + loss) / n))
        val = F.when(has & (c >= n), out(g, lo))
        return F.struct(c.alias("c"), F.coalesce(v, acc["prev"]).alias("prev"), g.alias("g"),
                        lo.alias("l"), F.concat(acc["o"], F.array(val)).alias("o"))

    return F.aggregate(x, init, step, lambda acc: acc["o"])


def _near_zero(v: Column) -> Column:
    return (v > -ZERO_TOL) & (v < ZERO_TOL)


def _rsi_out(g: Column, lo: Column) -> Column:
    t = g + lo
    return F.when(_near_zero(t), F.lit(0.0)).otherwise(100.0 * (g / t))


def _cmo_out(g: Column, lo: Column) -> Column:
    t = g + lo
    return F.when(_near_zero(t), F.lit(0.0)).otherwise(100.0 * ((g - lo) / t))


def _obv_fold(x: Column, v: Column) -> Column:
    """On-balance volume from the first position where both series are present:
    starts at that volume, then adds / subtracts the volume on up / down moves."""
    init = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(None).cast("double").alias("obv"),
                    _empty().alias("o"))

    def step(acc, z):
        px, vol = z["x"], z["v"]
        both = px.isNotNull() & vol.isNotNull()
        obv = (F.when(~both, acc["obv"])
               .when(acc["obv"].isNull(), vol)
               .when(px > acc["prev"], acc["obv"] + vol)
               .when(px < acc["prev"], acc["obv"] - vol)
               .otherwise(acc["obv"]))
        return F.struct(F.when(both, px).otherwise(acc["prev"]).alias("prev"), obv.alias("obv"),
                        F.concat(acc["o"], F.array(F.when(both, obv))).alias("o"))

    return F.aggregate(F.arrays_zip(x.alias("x"), v.alias("v")), init, step, lambda acc: acc["o"])


# ---- registry -----------------------------------------------------------------

@dataclass(frozen=True)
class Indicator:
    name: str
    data_type: str            # "ret", "vol" or "both"
    lookback: int             # first defined position is b + lookback
    window: Callable | None = None          # (filled, p, n) -> Column
    fold: Callable | None = None            # (filled[, filled_vol], n) -> array Column
    period: int = 0
    args: dict = field(default_factory=dict)


SERIES = ("ret", "vol", "both")

# The indicator list, its inputs and effective periods.
INDICATORS: dict[str, Indicator] = {
    "OBV": Indicator("OBV", "both", 0, fold=lambda x, v, n: _obv_fold(x, v)),
    "RSI": Indicator("RSI", "ret", 14, fold=lambda x, v, n: _wilder_fold(x, n, _rsi_out), period=14),
    "MOM": Indicator("MOM", "ret", 5, window=_mom, period=5),
    "ROCR": Indicator("ROCR", "ret", 5, window=_rocr, period=5),
    "CMO": Indicator("CMO", "ret", 14, fold=lambda x, v, n: _wilder_fold(x, n, _cmo_out), period=14),
    "EMA": Indicator("EMA", "ret", 4, fold=lambda x, v, n: _ema_fold(x, n), period=5),
    "SMA": Indicator("SMA", "ret", 4, window=_sma, period=5),
    "WMA": Indicator("WMA", "ret", 4, window=_wma, period=5),
    "MIDPOINT": Indicator("MIDPOINT", "ret", 9, window=_midpoint, period=10),
}
# End of fixed values.


def _known_series(kind: str | None) -> str:
    if kind not in SERIES:
        raise ValueError(f"an indicator reads one of the series {', '.join(SERIES)}; got data_type={kind!r}")
    return kind


def register_indicator(ind: Indicator) -> None:
    """Add a user indicator (a Column builder) to the registry."""
    _known_series(ind.data_type)
    INDICATORS[ind.name] = ind


def defined_positions(name: str, n: int = N_LAGS) -> list[int]:
    return list(range(INDICATORS[name].lookback + 1, n + 1))


def indicator_names(names: Sequence[str] | None = None, labels: Sequence[int] = INDICATOR_PERIOD_LABELS,
                    n: int = N_LAGS, all_positions: bool = False) -> list[str]:
    out = []
    for nm in names or list(INDICATORS):
        pos = range(1, n + 1) if all_positions else defined_positions(nm, n)
        out += [f"{nm}_{p}_{lb}" for lb in labels for p in pos]
    return out


def filled_history(prefix: str, n: int = N_LAGS) -> Column:
    """``ffill(history(prefix))`` as one ``coalesce`` a position, which stays in generated code."""
    def last(k: int) -> Column:
        return F.coalesce(*[F.col(f"{prefix}_{j}").cast("double") for j in range(k, n + 1)])

    return F.array(*[last(k) for k in range(n, 0, -1)])


def with_filled_history(df: DataFrame, n: int = N_LAGS) -> DataFrame:
    """Add forward-filled histories ``__x`` (returns), ``__v`` (volumes) and the
    first valid positions ``__bx``, ``__bv``, ``__bxv`` (both present)."""
    f = df.withColumns({"__x": filled_history("RET", n), "__v": filled_history("VOLUME", n)})
    return f.withColumns({
        "__bx": first_valid(F.col("__x")),
        "__bv": first_valid(F.col("__v")),
        "__bxv": F.when((first_valid(F.col("__x")) > 0) & (first_valid(F.col("__v")) > 0),
                        F.greatest(first_valid(F.col("__x")), first_valid(F.col("__v")))).otherwise(0),
    })


def _series(ind: Indicator):
    if ind.data_type == "vol":
        return F.col("__v"), F.col("__bv")
    if ind.data_type == "both":
        return F.col("__x"), F.col("__bxv")
    return F.col("__x"), F.col("__bx")


def add_indicators(df: DataFrame, names: Sequence[str] | None = None,
                   labels: Sequence[int] = INDICATOR_PERIOD_LABELS, n: int = N_LAGS,
                   positions: dict[str, Sequence[int]] | None = None,
                   keep_history: bool = False, specs: dict[str, Indicator] | None = None) -> DataFrame:
    """Append ``{NAME}_{pos}_{label}`` for the requested indicators.

    ``positions`` restricts the emitted positions per indicator (Catalyst does
    not prune inside array expressions, so ask only for what is used); by
    default every position from the first defined one is emitted.
    """
    names = list(names or INDICATORS)
    known = INDICATORS | (specs or {})
    base_cols = df.columns
    f = with_filled_history(df, n)
    folds = {}
    for nm in names:
        ind = known[nm]
        if ind.fold is not None:
            folds[f"__fold_{nm}"] = ind.fold(F.col("__x") if ind.data_type != "vol" else F.col("__v"),
                                             F.col("__v"), ind.period)
    f = f.withColumns(folds) if folds else f
    out_cols = []
    for nm in names:
        ind = known[nm]
        series, b = _series(ind)
        pos = list(positions[nm]) if positions and nm in positions else list(range(ind.lookback + 1, n + 1))
        for p in pos:
            if ind.fold is not None:
                val = F.col(f"__fold_{nm}").getItem(p - 1)
            elif p - ind.lookback >= 1:
                val = F.when((b >= 1) & (b <= p - ind.lookback), ind.window(series, p, ind.period))
            else:
                val = F.lit(None).cast("double")
            out_cols += [val.alias(f"{nm}_{p}_{lb}") for lb in labels]
    keep = ["__x", "__v"] if keep_history else []
    return f.select(*base_cols, *out_cols, *keep)


def add_named_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame and the indicator columns ``{NAME}_{position}_{label}`` asked for, in
    their order; nothing else is computed."""
    parsed = [c.rsplit("_", 2) for c in columns]
    names = [nm for nm in INDICATORS if any(p[0] == nm for p in parsed)]
    positions = {nm: sorted({int(p[1]) for p in parsed if p[0] == nm}) for nm in names}
    labels = sorted({int(p[2]) for p in parsed})
    return add_indicators(df, names, labels, positions=positions).select(*df.columns, *columns) if names else df


def calculate_indicator(df: DataFrame, name: str, periods: Sequence[int] = INDICATOR_PERIOD_LABELS,
                        ta_args: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Append one registered indicator on the series that ``ta_args["data_type"]``
    names, with its own period or ``ta_args["timeperiod"]``.  Returns the frame
    and the new feature names."""
    asked = ta_args or {}
    ind = replace(INDICATORS[name], data_type=_known_series(asked.get("data_type")))
    if (period := asked.get("timeperiod")) is not None:
        ind = replace(ind, period=int(period), lookback=ind.lookback + int(period) - ind.period)
    out = add_indicators(df, [name], periods, specs={name: ind})
    return out, [c for c in out.columns if c not in df.columns]


def add_user_indicator(df: DataFrame, name: str, fn: Callable, ta_args: dict | None = None,
                       periods: Sequence[int] = INDICATOR_PERIOD_LABELS, remove_nan: bool = True,
                       n: int = N_LAGS) -> tuple[DataFrame, list[str]]:
    """Append a user's own indicator as ``{name}_{position}_{period}``.

    ``fn`` gets the forward-filled histories of many rows at once, oldest first, as
    (rows x n) arrays with NaN before the first value: one array for the series that
    ``ta_args["data_type"]`` names, two for ``both``; further entries of ``ta_args`` are
    keyword arguments.  It returns one such array, which is forward-filled in its turn.
    Batches go to Python as Arrow columns; rows are not moved.  Positions that are missing in
    every row are left out with ``remove_nan`` (one aggregate).  Returns the frame and
    the new names."""
    asked = dict(ta_args or {})
    kind = _known_series(asked.pop("data_type", None))

    def matrix(column: pd.Series) -> np.ndarray:
        return np.array([[np.nan if v is None else v for v in row] for row in column], float).reshape(len(column), n)

    def filled(a: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(np.isnan(a), 0, np.arange(n)), axis=1)
        return np.take_along_axis(a, at, axis=1)

    def series(out: np.ndarray) -> pd.Series:
        out = filled(np.asarray(out, float))
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in out])

    if kind == "both":
        @F.pandas_udf("array<double>")
        def run(x: pd.Series, v: pd.Series) -> pd.Series:
            return series(fn(matrix(x), matrix(v), **asked))
        values = run("__x", "__v")
    else:
        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return series(fn(matrix(x), **asked))
        values = run("__x" if kind == "ret" else "__v")
    f = materialize(with_filled_history(df, n).withColumn("__u", values).select(*df.columns, "__u"))
    positions = list(range(1, n + 1))
    if remove_nan:
        row = f.agg(*[F.count(F.col("__u")[p - 1]).alias(f"p{p}") for p in positions]).first()
        positions = [p for p in positions if row[f"p{p}"]]
    names = [f"{name}_{p}_{lb}" for p in positions for lb in periods]
    return f.select(*df.columns, *[F.col("__u")[p - 1].alias(f"{name}_{p}_{lb}") for p in positions for lb in periods]), names


def all_null_indicator_columns(df: DataFrame, names: Sequence[str] | None = None,
                               labels: Sequence[int] = INDICATOR_PERIOD_LABELS, n: int = N_LAGS) -> list[str]:
    """Indicator columns that would be NULL in every row, without computing them.

    Every indicator is defined (and non-NULL) at position p exactly when its
    series starts at some b >= 1 with b <= p - lookback, so one aggregate of
    the earliest start over all rows decides every column."""
    names = list(names or INDICATORS)
    f = with_filled_history(df, n)
    row = f.agg(F.min(F.when(F.col("__bx") > 0, F.col("__bx"))).alias("x"),
                F.min(F.when(F.col("__bv") > 0, F.col("__bv"))).alias("v"),
                F.min(F.when(F.col("__bxv") > 0, F.col("__bxv"))).alias("xv")).first()
    start = {"ret": row["x"], "vol": row["v"], "both": row["xv"]}
    out = []
    for nm in names:
        ind = INDICATORS[nm]
        b = start[ind.data_type]
        out += [f"{nm}_{p}_{lb}" for p in range(1, n + 1) for lb in labels
                if b is None or p - ind.lookback < b]
    return out


def history_stats(prefix: str = "RET", n: int = N_LAGS, width: float = 2.0) -> dict[str, Column]:
    """Whole-history summaries of the non-NULL values (declared in the
    reference without a body; the definitions are the textbook ones):
    mean, Bollinger bands mean +- width * sample std, cumulative return."""
    vals = F.filter(history(prefix, n), lambda x: x.isNotNull())
    cnt = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.nullif(cnt, F.lit(0))
    ss = F.aggregate(vals, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    std = F.sqrt(ss / F.nullif(cnt - 1, F.lit(0)))
    cum = F.when(cnt > 0, F.aggregate(vals, F.lit(1.0), lambda a, x: a * (1 + x)) - 1)
    return {f"{prefix}_hist_mean": mean, f"{prefix}_boll_upper": mean + width * std,
            f"{prefix}_boll_lower": mean - width * std, f"{prefix}_cum_ret": cum}


def _stoch_k(x: Column, b: Column, p: int, n: int) -> Column:
    s = F.slice(x, p - n + 1, n)
    hi, lo = F.array_max(s), F.array_min(s)
    return F.when((b >= 1) & (b <= p - n + 1) & (hi != lo), (_at(x, p) - lo) / (hi - lo) * 100)


def history_oscillators(df: DataFrame, n: int = N_LAGS, mom: int = 5, k: int = 14, d: int = 3) -> DataFrame:
    """Declared in the reference without a body; textbook definitions on the
    forward-filled return history (position n = newest):
    ``ROC_{mom}`` = x_n / x_{n-mom} - 1, ``momentum_{mom}`` = x_n - x_{n-mom},
    ``%K_{k}`` stochastic %K at the newest position, ``%D_{d}`` mean of the
    last d %K values.  Each is NULL unless its whole window is present."""
    f = with_filled_history(df, n)
    x, b = F.col("__x"), F.col("__bx")
    ok = (b >= 1) & (b <= n - mom)
    prev = _at(x, n - mom)
    ks = [_stoch_k(x, b, p, k) for p in range(n - d + 1, n + 1)]
    dval = ks[0]
    for kk in ks[1:]:
        dval = dval + kk
    return f.select(*df.columns,
                    F.when(ok, _at(x, n) / F.nullif(prev, F.lit(0.0)) - 1).alias(f"ROC_{mom}"),
                    F.when(ok, _at(x, n) - prev).alias(f"momentum_{mom}"),
                    ks[-1].alias(f"%K_{k}"), (dval / d).alias(f"%D_{d}"))
