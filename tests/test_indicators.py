"""Indicators on literal 20-point histories against plain-Python loops of the
published formulas, plus range invariants."""
import math

import pytest
from pyspark.sql import types as T

from panelforge.functions import indicators as ind
from panelforge.schema import HISTORY_COLS

N = 20


def _ffill(xs):
    out, last = [], None
    for x in xs:
        last = x if x is not None else last
        out.append(last)
    return out


def _first(xs):
    return next((i for i, x in enumerate(xs) if x is not None), None)


def ref_sma(xs, n=5):
    f, b = _ffill(xs), _first(xs)
    return [None if b is None or i - n + 1 < b else sum(f[i - n + 1:i + 1]) / n for i in range(N)]


def ref_ema(xs, n=5):
    f, b = _ffill(xs), _first(xs)
    out, e, k = [None] * N, None, 2.0 / (n + 1)
    if b is None:
        return out
    for i in range(b + n - 1, N):
        e = sum(f[b:b + n]) / n if i == b + n - 1 else (f[i] - e) * k + e
        out[i] = e
    return out


def ref_wilder(xs, n=14, cmo=False):
    f, b = _ffill(xs), _first(xs)
    out = [None] * N
    if b is None:
        return out
    g = l = 0.0
    for i in range(b + 1, N):
        d = f[i] - f[i - 1]
        gain, loss = max(d, 0.0), max(-d, 0.0)
        c = i - b
        if c < n:
            g, l = g + gain, l + loss
            continue
        if c == n:
            g, l = (g + gain) / n, (l + loss) / n
        else:
            g, l = (g * (n - 1) + gain) / n, (l * (n - 1) + loss) / n
        t = g + l
        out[i] = 0.0 if -1e-8 < t < 1e-8 else (100.0 * ((g - l) / t) if cmo else 100.0 * (g / t))
    return out


def ref_rocr(xs, n=5):
    f, b = _ffill(xs), _first(xs)
    return [None if b is None or i - n < b else (f[i] / f[i - n] if f[i - n] != 0 else 0.0) for i in range(N)]


def ref_obv(xs, vs):
    fx, fv = _ffill(xs), _ffill(vs)
    bx, bv = _first(xs), _first(vs)
    out = [None] * N
    if bx is None or bv is None:
        return out
    s = max(bx, bv)
    o, prev = fv[s], fx[s]
    out[s] = o
    for i in range(s + 1, N):
        o += fv[i] if fx[i] > prev else (-fv[i] if fx[i] < prev else 0.0)
        prev = fx[i]
        out[i] = o
    return out


SERIES = {  # oldest first
    1: [0.01 * ((i * 7) % 5 - 2) for i in range(N)],
    2: [None, None, 0.02] + [0.01 * ((i * 3) % 7 - 3) for i in range(N - 3)],       # leading NULL
    3: [0.01 * (i % 4) if i not in (6, 11) else None for i in range(N)],           # inner NULL
    4: [None] * N,                                                                 # all NULL
    5: [0.5] * N,                                                                  # constant (G+L = 0)
    6: [0.0] * 5 + [0.01 * i for i in range(1, N - 4)],                            # zero divisor
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i, xs in SERIES.items():
        vs = [1000.0 + 10 * j if (i != 2 or j > 3) else None for j in range(N)]
        rets = list(reversed(xs))   # RET_1 = newest
        vols = list(reversed(vs))
        rows.append((i, *rets, *vols))
    schema = T.StructType([T.StructField("ID", T.LongType())] +
                          [T.StructField(c, T.DoubleType()) for c in HISTORY_COLS])
    df = spark.createDataFrame(rows, schema)
    out = ind.add_indicators(df, positions={nm: range(1, N + 1) for nm in ind.INDICATORS}, labels=[5])
    return {r["ID"]: r.asDict() for r in out.collect()}


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("name,ref", [("SMA", ref_sma), ("EMA", ref_ema), ("ROCR", ref_rocr),
                                      ("RSI", ref_wilder), ("CMO", lambda x: ref_wilder(x, cmo=True))])
def test_against_loop(frame, name, ref):
    for i, xs in SERIES.items():
        exp = ref(xs)
        got = [frame[i][f"{name}_{p}_5"] for p in range(1, N + 1)]
        assert all(_close(a, b) for a, b in zip(got, exp)), (name, i, got, exp)


def test_obv(frame):
    for i, xs in SERIES.items():
        vs = [1000.0 + 10 * j if (i != 2 or j > 3) else None for j in range(N)]
        got = [frame[i][f"OBV_{p}_5"] for p in range(1, N + 1)]
        assert all(_close(a, b) for a, b in zip(got, ref_obv(xs, vs))), i


def test_invariants(frame):
    for i, xs in SERIES.items():
        f = _ffill(xs)
        for p in range(1, N + 1):
            r, c = frame[i][f"RSI_{p}_5"], frame[i][f"CMO_{p}_5"]
            assert r is None or 0 <= r <= 100
            assert c is None or -100 <= c <= 100
            for nm, w in (("SMA", 5), ("WMA", 5), ("MIDPOINT", 10)):
                v = frame[i][f"{nm}_{p}_5"]
                if v is not None:
                    win = f[p - w:p]
                    assert min(win) - 1e-12 <= v <= max(win) + 1e-12


def test_constant_series_rsi_zero(frame):
    assert frame[5]["RSI_20_5"] == 0.0 and frame[5]["CMO_20_5"] == 0.0


def test_zero_divisor_rocr(frame):
    assert frame[6]["ROCR_6_5"] == 0.0


def test_dispatcher_checks(spark):
    df = spark.createDataFrame([(1, 0.1)], "ID long, RET_1 double")
    with pytest.raises(ValueError):
        ind.calculate_indicator(df, "SMA", ta_args=None)
    with pytest.raises(ValueError):
        ind.calculate_indicator(df, "SMA", ta_args={"data_type": "price"})


def test_feature_name_rule():
    from panelforge.operators.clean import prune_names
    names = ind.indicator_names(all_positions=False)
    assert len(names) == 363
    kept = [n for n in names if n not in prune_names(names)]
    assert len(kept) == 40
