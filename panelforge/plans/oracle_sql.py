"""DuckDB SQL for every oracle-checked query (views: the shipped tables).

Each statement starts from the same panel CTE chain (FIXTURES.md B1), written
independently of the Spark code: plain window functions and ``median``.
"""

from __future__ import annotations

N = 20
RET = [f"RET_{k}" for k in range(1, N + 1)]
VOL = [f"VOLUME_{k}" for k in range(1, N + 1)]


def _lags(src: str, prefix: str) -> str:
    return ",\n    ".join(
        (f"{src} AS {prefix}_1" if k == 1 else f"lag({src}, {k - 1}) OVER w AS {prefix}_{k}")
        for k in range(1, N + 1))


PANEL_CTES = f"""
pf_month AS (
  SELECT l_suppkey, date_trunc('month', l_shipdate) AS month,
         sum(l_extendedprice) / sum(l_quantity) AS px, sum(l_quantity) AS vol
  FROM lineitem GROUP BY 1, 2),
pf_seq AS (
  SELECT *, row_number() OVER w AS seq, px / nullif(lag(px) OVER w, 0) - 1 AS ret0
  FROM pf_month WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
pf_mask AS (
  SELECT *, lead(ret0) OVER (PARTITION BY l_suppkey ORDER BY month) AS fwd,
    CASE WHEN (l_suppkey * 31 + seq) % 97 = 0 OR (l_suppkey % 10 = 3 AND seq BETWEEN 40 AND 47)
         THEN NULL ELSE ret0 END AS ret,
    CASE WHEN (l_suppkey * 17 + seq) % 89 = 0 THEN NULL ELSE vol END AS vol_m
  FROM pf_seq),
pf_lag AS (
  SELECT l_suppkey, month, seq, fwd,
    {_lags('ret', 'RET')},
    {_lags('vol_m', 'VOLUME')}
  FROM pf_mask WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
pf_kept AS (
  SELECT *, CAST((year(month) - 1995) * 12 + month(month) - 1 AS INTEGER) AS DATE
  FROM pf_lag WHERE seq >= {N + 1} AND fwd IS NOT NULL),
pf_med AS (SELECT DATE, median(fwd) AS fwd_median FROM pf_kept GROUP BY DATE),
panel AS (
  SELECT CAST(k.l_suppkey * 1000 + k.seq AS BIGINT) AS ID, k.DATE,
    CAST(k.l_suppkey AS INTEGER) AS STOCK,
    r.r_name AS SECTOR,
    r.r_name || '-' || CAST(n.n_nationkey % 2 AS VARCHAR) AS INDUSTRY_GROUP,
    n.n_name AS INDUSTRY,
    CASE WHEN k.l_suppkey % 10 = 7 THEN NULL
         ELSE n.n_name || '-' || CAST(k.l_suppkey % 2 AS VARCHAR) END AS SUB_INDUSTRY,
    {', '.join('CAST(k.' + c + ' AS DOUBLE) AS ' + c for c in RET + VOL)},
    CAST(k.fwd > m.fwd_median AS INTEGER) AS RET
  FROM pf_kept k JOIN pf_med m USING (DATE)
  JOIN supplier s ON s.s_suppkey = k.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
scores AS (
  SELECT ID, DATE, RET AS label, round(1 / (1 + exp(-5 * RET_1)), 4) AS proba,
         CAST(round(1 / (1 + exp(-5 * RET_1)), 4) > 0.5 AS INTEGER) AS pred
  FROM panel WHERE RET_1 IS NOT NULL)"""


def with_panel(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """``WITH <panel ctes>[, extra] <body>``; ``body`` is a SELECT."""
    ctes = PANEL_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


@oracle("panel")
def _panel():
    return with_panel("SELECT * FROM panel")


# ---- helpers ---------------------------------------------------------------

ID_COLS = ["ID", "STOCK", "DATE", "INDUSTRY", "INDUSTRY_GROUP", "SECTOR", "SUB_INDUSTRY"]
PANEL_COLS = ID_COLS + RET + VOL + ["RET"]
DOUBLE_COLS = set(RET + VOL)


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def _cols(cols, src="") -> str:
    return ", ".join(_r(src + c, c) if c in DOUBLE_COLS else src + c for c in cols)


def _rule_ctes(src: str, p: str) -> str:
    """Sector x date mean of RET_1, then 1 when above the median of its date."""
    return f"""
{p}_g AS (SELECT SECTOR, DATE, avg(RET_1) AS m FROM {src} GROUP BY SECTOR, DATE),
{p}_s AS (SELECT x.*, g.m AS score FROM {src} x LEFT JOIN {p}_g g USING (SECTOR, DATE)),
{p}_med AS (SELECT DATE, median(score) AS med FROM {p}_s GROUP BY DATE),
{p} AS (SELECT s.*, CAST(coalesce(s.score > m.med, false) AS INTEGER) AS pred
        FROM {p}_s s LEFT JOIN {p}_med m USING (DATE))"""


FOLDS_CTE = """
fd AS (SELECT DATE, CAST((row_number() OVER (ORDER BY md5(CAST(DATE AS VARCHAR) || ':0'), DATE) - 1) % 4
                         AS INTEGER) AS fold
       FROM (SELECT DISTINCT DATE FROM panel))"""


# ---- raw series -> panel ------------------------------------------------------

@oracle("lag_matrix")
def _lag_matrix():
    return with_panel("SELECT l_suppkey, seq, " + ", ".join(_r(c, c) for c in RET + VOL) + " FROM pf_lag")


@oracle("one_day_return")
def _one_day_return():
    return with_panel("SELECT l_suppkey, month, round(ret0, 6) AS ret FROM pf_seq")


@oracle("relative_volume")
def _relative_volume():
    return with_panel("""
SELECT l_suppkey, month, round(vol, 6) AS vol,
       round(ratio - avg(ratio) OVER (PARTITION BY month), 6) AS rel_volume
FROM rv""", """
rv AS (SELECT l_suppkey, month, vol,
         vol / nullif(median(vol) OVER (PARTITION BY l_suppkey ORDER BY month
                                        ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS ratio
       FROM pf_month)""")


# ---- group transforms ------------------------------------------------------------

@oracle("group_mean")
def _group_mean():
    return with_panel("""
SELECT p.ID, round(g.m, 6) AS RET_1_SECTOR_DATE_mean
FROM panel p LEFT JOIN (SELECT SECTOR, DATE, avg(RET_1) AS m FROM panel GROUP BY SECTOR, DATE) g
USING (SECTOR, DATE)""")


LEVELS = ["INDUSTRY", "INDUSTRY_GROUP", "SECTOR", "SUB_INDUSTRY"]


@oracle("group_stats")
def _group_stats():
    ctes = []
    sel = ["p.ID"]
    joins = []
    for lv in LEVELS:
        aggs = ", ".join(f"median(RET_{s}) AS RET_{s}_{lv}_median, stddev_samp(RET_{s}) AS RET_{s}_{lv}_std"
                         for s in range(1, 6))
        ctes.append(f"gs_{lv} AS (SELECT DATE, {lv} AS k, {aggs} FROM panel WHERE {lv} IS NOT NULL "
                    f"GROUP BY DATE, {lv})")
        joins.append(f"LEFT JOIN gs_{lv} ON gs_{lv}.DATE = p.DATE AND gs_{lv}.k = p.{lv}")
        sel += [_r(f"gs_{lv}.RET_{s}_{lv}_{st}", f"RET_{s}_{lv}_{st}") for s in range(1, 6)
                for st in ("median", "std")]
    return with_panel(f"SELECT {', '.join(sel)} FROM panel p {' '.join(joins)}", ",\n".join(ctes))


@oracle("date_median_decision")
def _date_median_decision():
    return with_panel("SELECT ID, DATE, pred FROM dm", _rule_ctes("panel", "dm"))


@oracle("benchmark_rule")
def _benchmark_rule():
    return with_panel("""
SELECT fold, count(*) AS n_rows, round(avg(CAST(pred = RET AS DOUBLE)), 6) AS accuracy
FROM dm JOIN fd USING (DATE) GROUP BY fold""", _rule_ctes("panel", "dm") + "," + FOLDS_CTE)


@oracle("fold_summary")
def _fold_summary():
    return with_panel("""
SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, count(accuracy) AS n_folds,
       round(avg(accuracy) - stddev_pop(accuracy), 6) AS lower, round(avg(accuracy) + stddev_pop(accuracy), 6) AS upper
FROM (SELECT fold, avg(CAST(pred = RET AS DOUBLE)) AS accuracy FROM dm JOIN fd USING (DATE) GROUP BY fold)""",
                      _rule_ctes("panel", "dm") + "," + FOLDS_CTE)


# ---- assemble / clean ----------------------------------------------------------------

@oracle("attach_target")
def _attach_target():
    return """
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, o_orderstatus
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@oracle("sample_exact")
def _sample_exact():
    return with_panel("""
SELECT ID, DATE, round(RET_1, 6) AS RET_1, RET FROM panel
ORDER BY md5(CAST(ID AS VARCHAR) || ':42'), ID LIMIT 500""")


@oracle("drop_all_missing")
def _drop_all_missing():
    cond = " AND ".join(f"RET_{k} IS NULL" for k in range(1, 6))
    return with_panel(f"SELECT ID FROM panel WHERE NOT ({cond})")


@oracle("drop_any_missing")
def _drop_any_missing():
    cond = " AND ".join(f"{c} IS NOT NULL" for c in PANEL_COLS)
    return with_panel(f"SELECT ID FROM panel WHERE {cond}")


@oracle("label_encode")
def _label_encode():
    return with_panel("""
SELECT p.ID, CAST(s.code AS INTEGER) AS SECTOR, CAST(r.code AS INTEGER) AS RET
FROM panel p
LEFT JOIN (SELECT SECTOR, dense_rank() OVER (ORDER BY SECTOR) - 1 AS code
           FROM (SELECT DISTINCT SECTOR FROM panel WHERE SECTOR IS NOT NULL)) s USING (SECTOR)
LEFT JOIN (SELECT RET, dense_rank() OVER (ORDER BY RET) - 1 AS code
           FROM (SELECT DISTINCT RET FROM panel WHERE RET IS NOT NULL)) r USING (RET)""")


@oracle("drop_id_cols")
def _drop_id_cols():
    return with_panel(f"SELECT {_cols(['ID'] + RET + VOL + ['RET'])} FROM panel")


@oracle("fill_zero")
def _fill_zero():
    return with_panel("SELECT ID, " + ", ".join(_r(f"coalesce({c}, 0)", c) for c in RET + VOL) + " FROM panel")


@oracle("inf_columns")
def _inf_columns():
    return with_panel(f"""
SELECT {_cols(PANEL_COLS[:-1])}, round(VOLUME_3 / 2, 6) AS RATIO_3,
       CASE WHEN DATE % 2 = 0 THEN 'train' ELSE 'test' END AS side FROM panel""")


@oracle("drop_mostly_missing")
def _drop_mostly_missing():
    lags = [1, 20, 40, 60, *range(70, 85)]
    return with_panel("""SELECT l_suppkey, seq, "column", round(value, 6) AS value FROM far
WHERE value IS NOT NULL AND "column" IN (SELECT "column" FROM far GROUP BY 1 HAVING count(*) - count(value) <= 0.95 * count(*))""",
                      "\nfar AS (" + "\nUNION ALL ".join(
                          f"SELECT l_suppkey, seq, 'RET_{k}' AS \"column\", CAST(lag(ret, {k - 1}) OVER (PARTITION BY l_suppkey ORDER BY month) AS DOUBLE) AS value FROM pf_mask" for k in lags) + ")")


@oracle("drop_correlated")
def _drop_correlated():
    return """
SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE), 6) AS q, round(CAST(l_discount AS DOUBLE), 6) AS d
FROM lineitem"""


@oracle("calendar_features")
def _calendar_features():
    return """
SELECT l_orderkey, l_linenumber, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day,
       CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dayofweek, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
       CAST(CAST(l_shipdate AS DATE) = last_day(l_shipdate) AS INTEGER) AS month_end
FROM lineitem"""


@oracle("train_test_split")
def _train_test_split():
    cols = ", ".join(_cols([c]) for c in RET + VOL)
    none = ", ".join(f"NULL AS {c}" for c in RET + VOL)
    return with_panel(f"""SELECT ID, {cols}, CAST(NULL AS DOUBLE) AS RET, CASE WHEN test THEN 'X_test' ELSE 'X_train' END AS frame FROM parts
UNION ALL SELECT ID, {none}, CAST(RET AS DOUBLE), CASE WHEN test THEN 'y_test' ELSE 'y_train' END FROM parts""", """
parts AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(ID AS VARCHAR) || ':0'), ID) <= ceil(0.25 * count(*) OVER ()) AS test FROM panel)""")


@oracle("left_join_chain")
def _left_join_chain():
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
            "s_name", "s_nationkey", "s_acctbal", "n_name", "n_regionkey"]
    dbl = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "s_acctbal"}
    sel = ", ".join(_r(c, c) if c in dbl else c for c in cols)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""
SELECT {sel} FROM (
  SELECT l.*, s.s_name, s.s_nationkey, s.s_acctbal, n.n_name, n.n_regionkey
  FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey) t
WHERE {cond}"""


@oracle("submission")
def _submission():
    return with_panel("SELECT ID, pred AS RET FROM sb",
                      "te AS (SELECT * FROM panel WHERE DATE % 2 = 1)," + _rule_ctes("te", "sb"))


# ---- splits ------------------------------------------------------------------------

def _unit(key: str, seed: int) -> str:
    return (f"CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15)) AS BIGINT) AS DOUBLE)"
            f" / {float(16 ** 15)!r}")


@oracle("hash_split")
def _hash_split():
    return with_panel(f"SELECT ID, CASE WHEN {_unit('ID', 0)} < 0.25 THEN 'test' ELSE 'train' END AS split FROM panel")


@oracle("exact_split")
def _exact_split():
    return with_panel("""
SELECT ID, CASE WHEN row_number() OVER (ORDER BY md5(CAST(ID AS VARCHAR) || ':42'), ID) <= ceil(0.2 * count(*) OVER ())
                THEN 'test' ELSE 'train' END AS split FROM panel""")


@oracle("date_folds")
def _date_folds():
    return with_panel("SELECT ID, DATE, fold FROM panel JOIN fd USING (DATE)", FOLDS_CTE)


@oracle("stratified_folds")
def _stratified_folds():
    return with_panel("""
SELECT ID, RET, CAST((row_number() OVER (PARTITION BY RET ORDER BY md5(CAST(ID AS VARCHAR) || ':0'), ID) - 1) % 10
                     AS INTEGER) AS fold
FROM panel""")


# ---- profiling / report tables ----------------------------------------------------------

@oracle("class_balance")
def _class_balance():
    return with_panel("""
SELECT RET, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM panel GROUP BY RET""")


@oracle("missing_pct")
def _missing_pct():
    parts = [f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)) * 100, 6) AS missing_pct FROM panel"
             for c in PANEL_COLS]
    return with_panel("\nUNION ALL ".join(parts))


def _unnest_struct(fields: list[tuple[str, str]], rows: list[list[str]], src: str) -> str:
    items = ", ".join("{" + ", ".join(f"'{f}': {v}" for (f, _), v in zip(fields, r)) + "}" for r in rows)
    sel = ", ".join(f"s.{f} AS {f}" if not rnd else _r(f"s.{f}", f) for f, rnd in fields)
    return f"SELECT {sel} FROM (SELECT unnest([{items}]) AS s FROM {src})"


@oracle("correlation_long")
def _correlation_long():
    cols = RET + VOL + ["RET"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = ", ".join(f"corr({a}, {b}) AS p{i}" for i, (a, b) in enumerate(pairs))
    body = _unnest_struct([("col_a", ""), ("col_b", ""), ("corr", "r")],
                          [[f"'{a}'", f"'{b}'", f"p{i}"] for i, (a, b) in enumerate(pairs)], "cc")
    return with_panel(body, f"cc AS (SELECT {aggs} FROM panel)")


PANEL_TYPES = {"ID": "bigint", "STOCK": "int", "DATE": "int", "RET": "int"}


@oracle("profile")
def _profile():
    parts = [f"SELECT '{c}' AS \"column\", '{PANEL_TYPES.get(c, 'double' if c in DOUBLE_COLS else 'string')}'"
             f" AS dtype, count({c}) AS non_null FROM panel" for c in PANEL_COLS]
    return with_panel("\nUNION ALL ".join(parts))


@oracle("ret_vol_series")
def _ret_vol_series():
    parts = [f"SELECT ID, -{k} AS day, round(RET_{k}, 6) AS ret, round(VOLUME_{k} / 10, 6) AS volume FROM panel"
             for k in range(1, N + 1)]
    parts.append("SELECT ID, 0 AS day, CASE WHEN RET = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS ret, "
                 "CAST(NULL AS DOUBLE) AS volume FROM panel")
    return with_panel("\nUNION ALL ".join(parts))


@oracle("standardize")
def _standardize():
    return with_panel("SELECT ID, " + ", ".join(
        _r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in RET + VOL) + " FROM panel")


# ---- metrics over deterministic scores ------------------------------------------------

EPS = 2.220446049250313e-16


def _counts_cte(src: str, p: str) -> str:
    return f"""
{p}_cnt AS (SELECT count(*) AS n,
    sum(CAST(label = 1 AND pred = 1 AS BIGINT))::DOUBLE AS tp, sum(CAST(label = 0 AND pred = 1 AS BIGINT))::DOUBLE AS fp,
    sum(CAST(label = 1 AND pred = 0 AS BIGINT))::DOUBLE AS fn, sum(CAST(label = 0 AND pred = 0 AS BIGINT))::DOUBLE AS tn
  FROM {src})"""


def _div0(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


BINARY = {
    "accuracy": _div0("tp + tn", "n"),
    "balanced_accuracy": f"({_div0('tp', 'tp + fn')} + {_div0('tn', 'tn + fp')}) / 2",
    "precision": _div0("tp", "tp + fp"),
    "recall": _div0("tp", "tp + fn"),
    "f1": _div0("2 * tp", "2 * tp + fp + fn"),
}


def _grouped_ctes(src: str, p: str) -> str:
    return f"""
{p}_grp AS (SELECT proba AS score, sum(CAST(label = 1 AS BIGINT)) AS pos, sum(CAST(label = 0 AS BIGINT)) AS neg
            FROM {src} GROUP BY proba),
{p}_asc AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM {p}_grp),
{p}_desc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
                       sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
                       sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg FROM {p}_grp)"""


def _auc(p):
    return (f"(SELECT sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) FROM {p}_asc)")


def _ap(p):
    return f"(SELECT sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) FROM {p}_desc)"


def _pclip():
    return f"least(greatest(proba, {EPS!r}), {1 - EPS!r})"


def _logloss(src):
    return f"(SELECT avg(-(label * ln({_pclip()}) + (1 - label) * ln(1 - {_pclip()}))) FROM {src})"


def _brier(src):
    return f"(SELECT avg(pow(proba - label, 2)) FROM {src})"


def _class_rows(p: str) -> str:
    """Per-class rows (class, precision, recall, f1, support) from the counts."""
    return f"""
{p}_cls AS (
  SELECT '0' AS class, {_div0('tn', 'tn + fn')} AS precision, {_div0('tn', 'tn + fp')} AS recall,
         {_div0('2 * tn', '2 * tn + fn + fp')} AS f1, CAST(tn + fp AS BIGINT) AS support FROM {p}_cnt
  UNION ALL
  SELECT '1', {_div0('tp', 'tp + fp')}, {_div0('tp', 'tp + fn')}, {_div0('2 * tp', '2 * tp + fp + fn')},
         CAST(tp + fn AS BIGINT) FROM {p}_cnt),
{p}_clsp AS (SELECT * FROM {p}_cls WHERE support > 0)"""


def _model_stats(src: str, p: str) -> tuple[str, str]:
    """(ctes, select of Statistic/value rows) for one scores relation."""
    ctes = _counts_cte(src, p) + "," + _grouped_ctes(src, p) + "," + _class_rows(p)
    acc = BINARY["accuracy"]
    stats = {k: f"(SELECT {v} FROM {p}_cnt)" for k, v in BINARY.items()}
    stats.update({
        "benchmark_accuracy": "0.5131",
        "accuracy_vs_benchmark": f"(SELECT {acc} - 0.5131 FROM {p}_cnt)",
        "accuracy_pct_improvement": f"(SELECT ({acc} - 0.5131) / 0.5131 * 100 FROM {p}_cnt)",
        "relative_improvement": f"(SELECT {acc} / 0.5131 - 1 FROM {p}_cnt)",
        "roc_auc": _auc(p),
        "avg_precision": _ap(p),
        "log_loss": _logloss(src),
        "brier_score": _brier(src),
        "pred_pos_ratio": f"(SELECT avg(pred::DOUBLE) FROM {src})",
        "true_pos_ratio": f"(SELECT avg(label::DOUBLE) FROM {src})",
        "pred_std": f"(SELECT stddev_pop(proba) FROM {src})",
    })
    for k in ("0", "1"):
        for m in ("precision", "recall", "f1"):
            stats[f"class_{k}_{m}"] = f"(SELECT {m} FROM {p}_clsp WHERE class = '{k}')"
    rows = "\nUNION ALL ".join(f"SELECT '{k}' AS Statistic, CAST({v} AS DOUBLE) AS value" for k, v in stats.items())
    return ctes, rows


@oracle("confusion")
def _confusion():
    return with_panel("""
SELECT CAST(y AS INTEGER) AS label, CAST(p AS INTEGER) AS pred,
       (SELECT count(*) FROM scores WHERE label = y AND pred = p) AS n
FROM range(2) a(y), range(2) b(p)""")


@oracle("binary_metrics")
def _binary_metrics():
    return with_panel("SELECT " + ", ".join(_r(v, k) for k, v in BINARY.items()) + " FROM sc_cnt",
                      _counts_cte("scores", "sc"))


@oracle("class_metrics")
def _class_metrics():
    return with_panel("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM sc_clsp
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
FROM sc_clsp
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM sc_clsp""",
                      _counts_cte("scores", "sc") + "," + _class_rows("sc"))


@oracle("roc_auc")
def _roc_auc():
    return with_panel(f"SELECT round({_auc('sc')}, 6) AS roc_auc", _grouped_ctes("scores", "sc"))


@oracle("roc_curve")
def _roc_curve():
    return with_panel("""
SELECT round(score, 6) AS threshold, CAST(cum_neg AS BIGINT) AS fps, CAST(cum_pos AS BIGINT) AS tps,
       round(cum_neg::DOUBLE / tot_neg, 6) AS fpr, round(cum_pos::DOUBLE / tot_pos, 6) AS tpr
FROM sc_desc
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""", _grouped_ctes("scores", "sc"))


@oracle("roc_area")
def _roc_area():
    return with_panel(f"SELECT round({_auc('sc')}, 6) AS roc_area", _grouped_ctes("scores", "sc"))


@oracle("avg_precision")
def _avg_precision():
    return with_panel(f"SELECT round({_ap('sc')}, 6) AS avg_precision", _grouped_ctes("scores", "sc"))


@oracle("log_loss_brier")
def _log_loss_brier():
    return with_panel(f"SELECT round({_logloss('scores')}, 6) AS log_loss, round({_brier('scores')}, 6) AS brier_score")


@oracle("score_stats")
def _score_stats():
    return with_panel("SELECT round(avg(pred::DOUBLE), 6) AS pred_pos_ratio, round(avg(label::DOUBLE), 6) AS "
                      "true_pos_ratio, round(stddev_pop(proba), 6) AS pred_std FROM scores")


@oracle("benchmark_compare")
def _benchmark_compare():
    acc = BINARY["accuracy"]
    return with_panel(f"""
SELECT round({acc}, 6) AS accuracy, 0.5131::DOUBLE AS benchmark_accuracy, round({acc} - 0.5131, 6) AS accuracy_vs_benchmark,
       round(({acc} - 0.5131) / 0.5131 * 100, 6) AS accuracy_pct_improvement, round({acc} / 0.5131 - 1, 6) AS relative_improvement
FROM sc_cnt""", _counts_cte("scores", "sc"))


def _two_models() -> tuple[str, str]:
    rule = _rule_ctes("panel", "dm") + """,
rs AS (SELECT ID, DATE, RET AS label, pred, round(1 / (1 + exp(-5 * score)), 4) AS proba FROM dm
       WHERE score IS NOT NULL)"""
    c1, r1 = _model_stats("scores", "m1")
    c2, r2 = _model_stats("rs", "m2")
    ctes = rule + "," + c1 + "," + c2
    body = (f"SELECT 'ret1_logistic' AS Model, Statistic, value FROM ({r1})\nUNION ALL\n"
            f"SELECT 'sector_mean_rule' AS Model, Statistic, value FROM ({r2})")
    return ctes, body


@oracle("metrics_long")
def _metrics_long():
    ctes, body = _two_models()
    return with_panel(f"SELECT Model, Statistic, round(value, 6) AS value FROM ({body})", ctes)


@oracle("model_accuracy")
def _model_accuracy():
    ctes, body = _two_models()
    return with_panel(f"""
SELECT Model, round(value, 6) AS accuracy, 0.5131::DOUBLE AS benchmark, round(value - 0.5131, 6) AS vs_benchmark
FROM ({body}) WHERE Statistic = 'accuracy'""", ctes)


@oracle("run_metadata")
def _run_metadata():
    return with_panel("""
SELECT count(*) AS n_test_samples, 40 AS n_features, 10 AS n_features_selected,
       round(avg(RET::DOUBLE), 6) AS class_positive, round(1 - avg(RET::DOUBLE), 6) AS class_negative
FROM panel WHERE DATE % 2 = 1""")


# ---- technical indicators (long format: one row per ID and history position) ----

IND_LOOKBACK = {"OBV": 0, "RSI": 14, "MOM": 5, "ROCR": 5, "CMO": 14, "EMA": 4, "SMA": 4, "WMA": 4, "MIDPOINT": 9}
LABELS = [2, 5, 14]

HIST_CTES = f"""
ih AS (SELECT ID, unnest(range(1, {N + 1})) AS pos,
              unnest([{', '.join(f'RET_{k}' for k in range(N, 0, -1))}]) AS x,
              unnest([{', '.join(f'VOLUME_{k}' for k in range(N, 0, -1))}]) AS v FROM panel),
fil AS (SELECT ID, pos, last_value(x IGNORE NULLS) OVER w AS x, last_value(v IGNORE NULLS) OVER w AS v
        FROM ih WINDOW w AS (PARTITION BY ID ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fb AS (SELECT ID, min(pos) FILTER (WHERE x IS NOT NULL) AS bx, min(pos) FILTER (WHERE v IS NOT NULL) AS bv
       FROM fil GROUP BY ID),
fx AS (SELECT f.ID, f.pos, f.x, f.v, b.bx, b.bv,
              lag(f.x, 1) OVER w AS x1, lag(f.x, 2) OVER w AS x2, lag(f.x, 3) OVER w AS x3,
              lag(f.x, 4) OVER w AS x4, lag(f.x, 5) OVER w AS x5
       FROM fil f JOIN fb b USING (ID) WINDOW w AS (PARTITION BY f.ID ORDER BY f.pos)),
chg AS (SELECT ID, pos, bx, greatest(x - x1, 0) AS gain, greatest(x1 - x, 0) AS loss FROM fx)"""

K_EMA = repr(2.0 / 6)

IND_CTES = {
    "SMA": "ind_SMA AS (SELECT ID, pos, CASE WHEN pos - 4 >= bx THEN avg(x) OVER (PARTITION BY ID ORDER BY pos "
           "ROWS 4 PRECEDING) END AS val FROM fx)",
    "WMA": "ind_WMA AS (SELECT ID, pos, CASE WHEN pos - 4 >= bx THEN (x4 * 1 + x3 * 2 + x2 * 3 + x1 * 4 + x * 5)"
           " / 15.0 END AS val FROM fx)",
    "MOM": "ind_MOM AS (SELECT ID, pos, CASE WHEN pos - 5 >= bx THEN x - x5 END AS val FROM fx)",
    "ROCR": "ind_ROCR AS (SELECT ID, pos, CASE WHEN pos - 5 >= bx THEN (CASE WHEN x5 <> 0 THEN x / x5 ELSE 0.0 END)"
            " END AS val FROM fx)",
    "MIDPOINT": "ind_MIDPOINT AS (SELECT ID, pos, CASE WHEN pos - 9 >= bx THEN (max(x) OVER w + min(x) OVER w) / 2"
                " END AS val FROM fx WINDOW w AS (PARTITION BY ID ORDER BY pos ROWS 9 PRECEDING))",
    "EMA": f"""ema_seed AS (SELECT ID, pos, bx, avg(x) OVER (PARTITION BY ID ORDER BY pos ROWS 4 PRECEDING) AS e FROM fx),
ema_r(ID, pos, e) AS (
  SELECT ID, pos, e FROM ema_seed WHERE pos = bx + 4
  UNION ALL
  SELECT r.ID, r.pos + 1, (f.x - r.e) * {K_EMA} + r.e FROM ema_r r JOIN fx f ON f.ID = r.ID AND f.pos = r.pos + 1),
ind_EMA AS (SELECT ID, pos, e AS val FROM ema_r)""",
    "OBV": """obv_r(ID, pos, o, px) AS (
  SELECT ID, pos, v, x FROM fx WHERE pos = greatest(bx, bv)
  UNION ALL
  SELECT r.ID, r.pos + 1, CASE WHEN f.x > r.px THEN r.o + f.v WHEN f.x < r.px THEN r.o - f.v ELSE r.o END, f.x
  FROM obv_r r JOIN fx f ON f.ID = r.ID AND f.pos = r.pos + 1),
ind_OBV AS (SELECT ID, pos, o AS val FROM obv_r)""",
}


def _wilder(name: str, out: str) -> str:
    return f"""{name.lower()}_seed AS (SELECT ID, pos, bx, sum(gain) OVER w / 14 AS g, sum(loss) OVER w / 14 AS l
  FROM chg WINDOW w AS (PARTITION BY ID ORDER BY pos ROWS 13 PRECEDING)),
{name.lower()}_r(ID, pos, g, l) AS (
  SELECT ID, pos, g, l FROM {name.lower()}_seed WHERE pos = bx + 14
  UNION ALL
  SELECT r.ID, r.pos + 1, (r.g * 13 + c.gain) / 14, (r.l * 13 + c.loss) / 14
  FROM {name.lower()}_r r JOIN chg c ON c.ID = r.ID AND c.pos = r.pos + 1),
ind_{name} AS (SELECT ID, pos, CASE WHEN g + l > -1e-8 AND g + l < 1e-8 THEN 0.0 ELSE {out} END AS val
  FROM {name.lower()}_r)"""


IND_CTES["RSI"] = _wilder("RSI", "100.0 * (g / (g + l))")
IND_CTES["CMO"] = _wilder("CMO", "100.0 * ((g - l) / (g + l))")


def indicator_sql(columns: dict[str, list[int]], labels=LABELS, extra_select: str = "") -> str:
    """SELECT ID, {NAME}_{pos}_{label} ... for the given positions per indicator."""
    ctes = [HIST_CTES] + [IND_CTES[nm] for nm in columns]
    sel, joins = ["p.ID"], []
    for nm, pos in columns.items():
        joins.append(f"LEFT JOIN (SELECT ID, " + ", ".join(
            f"max(val) FILTER (WHERE pos = {q}) AS v{q}" for q in pos) + f" FROM ind_{nm} GROUP BY ID) j_{nm} "
            f"ON j_{nm}.ID = p.ID")
        sel += [_r(f"j_{nm}.v{q}", f"{nm}_{q}_{lb}") for q in pos for lb in labels]
    body = f"SELECT {', '.join(sel)}{extra_select} FROM panel p {' '.join(joins)}"
    return with_panel(body, ",".join(ctes), recursive=True)


for _nm, _lb in IND_LOOKBACK.items():
    ORACLES[f"ind_{_nm.lower()}"] = indicator_sql({_nm: list(range(_lb + 1, N + 1))})


@oracle("ffill_history")
def _ffill_history():
    sel = ", ".join([_r(f"max(x) FILTER (WHERE pos = {N + 1 - k})", f"RET_{k}") for k in range(1, N + 1)]
                    + [_r(f"max(v) FILTER (WHERE pos = {N + 1 - k})", f"VOLUME_{k}") for k in range(1, N + 1)])
    return with_panel(f"SELECT ID, {sel} FROM fil GROUP BY ID", HIST_CTES)


# Indicator columns surviving the all-NULL drop and the name rule.
PRUNED = {"OBV": list(range(1, 8)), "MOM": [6, 7], "ROCR": [6, 7], "EMA": [5, 6, 7], "SMA": [5, 6, 7],
          "WMA": [5, 6, 7]}


@oracle("prune_by_name")
def _prune_by_name():
    return indicator_sql(PRUNED, labels=[2, 5])


# ---- kNN imputation of the test rows (odd DATE), all 40 history columns ----------

@oracle("user_indicator")
def _user_indicator():
    return indicator_sql({"SMA": list(range(5, N + 1))}).replace(" AS SMA_", " AS OWN_")


def _knn_sql(within: str | None = None) -> str:
    cols = RET + VOL
    same = f" WHERE r.{within} = d.{within}" if within else ""
    ss = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in cols)
    common = " + ".join(f"CAST(r.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in cols)
    anynull = " OR ".join(f"{c} IS NULL" for c in cols)
    cells = "\n  UNION ALL ".join(f"SELECT ID AS rid, '{c}' AS col FROM te WHERE {c} IS NULL" for c in cols)
    dv = "\n  UNION ALL ".join(f"SELECT ID AS did, '{c}' AS col, {c} AS val FROM te WHERE {c} IS NOT NULL"
                               for c in cols)
    ctes = f"""
te AS (SELECT * FROM panel WHERE DATE % 2 = 1),
pairs AS (SELECT r.ID AS rid, d.ID AS did, {ss} AS ss, {common} AS n_common
          FROM (SELECT * FROM te WHERE {anynull}) r, te d{same}),
cells AS ({cells}),
dv AS ({dv}),
cand AS (SELECT c.rid, c.col, v.did, v.val, p.ss * {len(cols)}.0 / p.n_common AS d2
         FROM cells c JOIN dv v ON v.col = c.col JOIN pairs p ON p.rid = c.rid AND p.did = v.did
         WHERE p.n_common > 0),
best AS (SELECT rid, col, avg(val) AS imp FROM (
           SELECT *, row_number() OVER (PARTITION BY rid, col ORDER BY d2, did) AS rn FROM cand)
         WHERE rn <= 5 GROUP BY rid, col),
wide AS (SELECT rid, {', '.join(f"max(imp) FILTER (WHERE col = '{c}') AS i_{c}" for c in cols)}
         FROM best GROUP BY rid),
mu AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in cols)} FROM te)"""
    sel = ", ".join(_r(f"coalesce(t.{c}, w.i_{c}, mu.m_{c})", c) for c in cols)
    key = f", t.{within}" if within else ""
    return with_panel(f"SELECT t.ID{key}, {sel} FROM te t LEFT JOIN wide w ON w.rid = t.ID, mu", ctes)


@oracle("knn_impute")
def _knn_impute():
    return _knn_sql()


@oracle("knn_impute_within")
def _knn_impute_within():
    return _knn_sql("SECTOR")


@oracle("model_input_train")
def _model_input_train():
    whole = " AND ".join(f"{c} IS NOT NULL" for c in PANEL_COLS)
    ctes, joins, stats = [f"\ntr AS (SELECT * FROM panel WHERE DATE % 2 = 0 AND {whole})"], [], []
    for lv in LEVELS:
        aggs = ", ".join(f"median(RET_{s}) AS RET_{s}_{lv}_median, stddev_samp(RET_{s}) AS RET_{s}_{lv}_std" for s in range(1, 6))
        ctes.append(f"ts_{lv} AS (SELECT DATE, {lv} AS k, {aggs} FROM tr GROUP BY DATE, {lv})")
        joins.append(f"JOIN ts_{lv} ON ts_{lv}.DATE = p.DATE AND ts_{lv}.k = p.{lv}")
        stats += [f"RET_{s}_{lv}_{st}" for s in range(1, 6) for st in ("median", "std")]
    own = [f"{nm}_{q}_{lb}" for nm, pos in PRUNED.items() for q in pos for lb in (2, 5)]
    there = " AND ".join(f"{c} IS NOT NULL" for c in stats + own)
    sel = ", ".join([_r(f"p.{c}", c) for c in RET + VOL] + [_r(c, c) for c in stats] + [f"i.{c}" for c in own])
    return with_panel(f"SELECT p.ID, {sel}, p.RET FROM tr p {' '.join(joins)} JOIN ({indicator_sql(PRUNED, labels=[2, 5])}) i ON i.ID = p.ID WHERE {there}", ",\n".join(ctes))


@oracle("history_stats")
def _history_stats():
    return with_panel("""
SELECT p.ID, round(h.m, 6) AS RET_hist_mean, round(h.m + 2.0 * h.s, 6) AS RET_boll_upper,
       round(h.m - 2.0 * h.s, 6) AS RET_boll_lower, round(h.c, 6) AS RET_cum_ret
FROM panel p LEFT JOIN (
  SELECT ID, avg(x) AS m, stddev_samp(x) AS s, product(1 + x) - 1 AS c FROM ih WHERE x IS NOT NULL GROUP BY ID) h
ON h.ID = p.ID""", HIST_CTES)


@oracle("history_oscillators")
def _history_oscillators():
    ctes = HIST_CTES + """,
sk AS (SELECT ID, pos, CASE WHEN pos - 13 >= bx AND max(x) OVER w <> min(x) OVER w
                            THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 100 END AS k
       FROM fx WINDOW w AS (PARTITION BY ID ORDER BY pos ROWS 13 PRECEDING)),
osc AS (SELECT f.ID,
          max(CASE WHEN f.pos = 20 AND 15 >= f.bx THEN f.x / nullif(f.x5, 0) - 1 END) AS roc,
          max(CASE WHEN f.pos = 20 AND 15 >= f.bx THEN f.x - f.x5 END) AS mom
        FROM fx f GROUP BY f.ID),
kd AS (SELECT ID, max(k) FILTER (WHERE pos = 20) AS k20,
              (max(k) FILTER (WHERE pos = 18) + max(k) FILTER (WHERE pos = 19) + max(k) FILTER (WHERE pos = 20)) / 3 AS d3
       FROM sk GROUP BY ID),
ms AS (SELECT p.DATE, p.SECTOR, avg(o.mom) AS m FROM panel p JOIN osc o ON o.ID = p.ID
       WHERE p.SECTOR IS NOT NULL GROUP BY p.DATE, p.SECTOR)"""
    return with_panel("""
SELECT p.ID, round(o.roc, 6) AS ROC_5, round(o.mom, 6) AS momentum_5, round(ms.m, 6) AS momentum_sector_5,
       round(kd.k20, 6) AS "%K_14", round(kd.d3, 6) AS "%D_3"
FROM panel p JOIN osc o ON o.ID = p.ID JOIN kd ON kd.ID = p.ID
LEFT JOIN ms ON ms.DATE = p.DATE AND ms.SECTOR = p.SECTOR""", ctes)
