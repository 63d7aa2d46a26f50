"""Preparation queries: impute, fill, scale, encode, select, split, balance (§2.5–2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import encode as E
from ..operators import impute as I
from ..operators import scale as S
from ..operators import select as SEL
from ..operators import split as SP
from . import query
from .sqlgen import union_all
from .tables import (CUSTOMER_GAPS_SQL, ORDERS_GAPS_SQL, customer_gaps, orders_gaps,
                     round_doubles, table, unpivot)

G = ORDERS_GAPS_SQL
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_rebate"


def _mode_sql(col: str, src: str) -> str:
    return (f"(SELECT {col} FROM {src} g WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


def _impute_sql(stat: str) -> str:
    if stat == "mode":
        tp, rb = _mode_sql("o_totalprice", G), _mode_sql("o_rebate", G)
    else:
        fn = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)"}[stat]
        tp = f"(SELECT {fn.format(c='o_totalprice')} FROM {G} g)"
        rb = f"(SELECT {fn.format(c='o_rebate')} FROM {G} g)"
    return f"""SELECT o_orderkey, o_custkey,
  coalesce(o_orderstatus, {_mode_sql('o_orderstatus', G)}) AS o_orderstatus,
  round(coalesce(o_totalprice, {tp}), 4) AS o_totalprice, o_orderdate,
  coalesce(o_orderpriority, {_mode_sql('o_orderpriority', G)}) AS o_orderpriority,
  round(coalesce(o_rebate, {rb}), 4) AS o_rebate
FROM {G} g"""


@query("impute_mean", _impute_sql("mean"))
def impute_mean(spark, sf):
    return round_doubles(I.impute(orders_gaps(spark, sf), "mean"))


@query("impute_median", _impute_sql("median"))
def impute_median(spark, sf):
    return round_doubles(I.impute(orders_gaps(spark, sf), "median"))


@query("impute_mode", _impute_sql("mode"))
def impute_mode(spark, sf):
    return round_doubles(I.impute(orders_gaps(spark, sf), "most_frequent"))


@query("impute_drop", f"SELECT * FROM {G} g WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in ORDER_COLS.split(", ")))
def impute_drop(spark, sf):
    return I.impute(orders_gaps(spark, sf), "drop")


@query("drop_sparse_columns", union_all([
    f"SELECT '{c}' AS column_name, (count(*) - count({c})) / count(*) > 0.5 AS dropped FROM {G} g"
    for c in ORDER_COLS.split(", ")]))
def drop_sparse_columns(spark, sf):
    df = orders_gaps(spark, sf)
    _, dropped = I.drop_sparse_columns(df, 0.5)
    return spark.createDataFrame([(c, c in dropped) for c in df.columns],
                                 "column_name string, dropped boolean")


@query("fill_forward", f"""SELECT o_orderkey,
  last_value(o_totalprice IGNORE NULLS) OVER w AS o_totalprice,
  last_value(o_rebate IGNORE NULLS) OVER w AS o_rebate
FROM {G} g WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward(spark, sf):
    df = orders_gaps(spark, sf)
    return I.fill_directional(df, ["o_totalprice", "o_rebate"], ["o_orderkey"]) \
        .select("o_orderkey", "o_totalprice", "o_rebate")


@query("fill_backward", f"""SELECT o_orderkey,
  first_value(o_totalprice IGNORE NULLS) OVER w AS o_totalprice,
  first_value(o_rebate IGNORE NULLS) OVER w AS o_rebate
FROM {G} g WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_backward(spark, sf):
    df = orders_gaps(spark, sf)
    return I.fill_directional(df, ["o_totalprice", "o_rebate"], ["o_orderkey"],
                              direction="backward").select("o_orderkey", "o_totalprice", "o_rebate")


@query("fill_forward_grouped", f"""SELECT o_custkey, o_orderkey,
  last_value(o_rebate IGNORE NULLS) OVER w AS o_rebate
FROM {G} g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward_grouped(spark, sf):
    df = orders_gaps(spark, sf)
    return I.fill_directional(df, ["o_rebate"], ["o_orderkey"], by=["o_custkey"]) \
        .select("o_custkey", "o_orderkey", "o_rebate")


@query("handle_missing_auto", f"""SELECT o_orderkey, o_custkey,
  coalesce(o_orderstatus, {_mode_sql('o_orderstatus', G)}) AS o_orderstatus,
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {G} g)), 4) AS o_totalprice,
  o_orderdate, coalesce(o_orderpriority, {_mode_sql('o_orderpriority', G)}) AS o_orderpriority
FROM {G} g""")
def handle_missing_auto(spark, sf):
    out, _ = I.handle_missing(orders_gaps(spark, sf), "auto", "mean", "mode", 0.5)
    return round_doubles(out)


@query("fill_constant", f"""SELECT o_orderkey, o_custkey,
  coalesce(o_orderstatus, 'unknown') AS o_orderstatus,
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {G} g)), 4)
    AS o_totalprice,
  o_orderdate, coalesce(o_orderpriority, 'unknown') AS o_orderpriority,
  round(coalesce(o_rebate, (SELECT quantile_cont(o_rebate, 0.5) FROM {G} g)), 4) AS o_rebate
FROM {G} g""")
def fill_constant(spark, sf):
    out, _ = I.handle_missing(orders_gaps(spark, sf), "fill", "median", "constant", 0.5)
    return round_doubles(out)


# ---- scaling ------------------------------------------------------------------
SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(method: str) -> str:
    exprs = []
    for c in SCALE_COLS:
        if method == "standard":
            e = (f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
                 f"ELSE stddev_pop({c}) OVER () END")
        elif method == "minmax":
            e = (f"({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () "
                 f"THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END")
        else:
            q1 = f"quantile_cont({c}, 0.25) OVER ()"
            q3 = f"quantile_cont({c}, 0.75) OVER ()"
            e = (f"({c} - quantile_cont({c}, 0.5) OVER ()) / CASE WHEN {q3} - {q1} = 0 THEN 1 "
                 f"ELSE {q3} - {q1} END")
        exprs.append(f"round({e}, 6) AS {c}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(exprs)} FROM lineitem"


def _scaled(spark, sf, method):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return round_doubles(S.scale(li, SCALE_COLS, method), 6)


@query("scale_standard", _scale_sql("standard"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", _scale_sql("minmax"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", _scale_sql("robust"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scale_power")
def scale_power(spark, sf):
    return _scaled(spark, sf, "power")


@query("scale_quantile")
def scale_quantile(spark, sf):
    return _scaled(spark, sf, "quantile")


def _skew_sql() -> str:
    parts = " + ".join(f"abs(skewness({c}))" for c in SCALE_COLS + ["l_orderkey"])
    m = f"({parts}) / 5"
    return (f"SELECT round({m}, 6) AS mean_abs_skew, CASE WHEN {m} > 1.0 THEN 'power' "
            f"WHEN {m} > 0.5 THEN 'quantile' ELSE 'standard' END AS method FROM lineitem")


@query("scale_auto_choice", _skew_sql())
def scale_auto_choice(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = SCALE_COLS + ["l_orderkey"]
    m = S.mean_abs_skew(li, cols)
    method = S.choose_scaler(li, cols)
    return spark.createDataFrame([(round(m, 6), method)], "mean_abs_skew double, method string")


# ---- encoding -----------------------------------------------------------------

@query("encode_one_hot", """WITH cats AS (SELECT DISTINCT c_mktsegment AS v FROM customer),
nf AS (SELECT v FROM cats WHERE v > (SELECT min(v) FROM cats))
SELECT c_custkey, 'c_mktsegment_' || v AS feature,
  CAST(CASE WHEN c_mktsegment = v THEN 1 ELSE 0 END AS DOUBLE) AS value FROM customer, nf""")
def encode_one_hot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    spec = E.fit_encode(c, ["c_mktsegment"])
    out = spec.apply(c)
    return unpivot(out, ["c_custkey"], spec.output_columns())


@query("encode_frequency", """SELECT p_partkey,
  round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS p_brand_freq FROM part""")
def encode_frequency(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return round_doubles(E.encode(p, ["p_brand"]), 6)


@query("encode_label", """SELECT p_partkey, p_name,
  CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name_code FROM part""")
def encode_label(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return E.label_encode(p, ["p_name"])


POLY = ["l_quantity", "l_discount", "l_tax"]


@query("polynomial_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({a} * {b}, 6) AS \"{a + '^2' if a == b else a + '*' + b}\""
    for i, a in enumerate(POLY) for b in POLY[i:]) + " FROM lineitem")
def polynomial_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *POLY)
    return round_doubles(E.polynomial_features(li, POLY).drop(*POLY), 6)


@query("bin_features", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS c
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CAST((l_extendedprice >= c[1])::INT + (l_extendedprice >= c[2])::INT
     + (l_extendedprice >= c[3])::INT + (l_extendedprice >= c[4])::INT AS INTEGER)
     AS l_extendedprice_bin FROM lineitem, q""")
def bin_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return E.bin_features(li, ["l_extendedprice"], 5)


@query("customer_prep", f"""WITH g AS {CUSTOMER_GAPS_SQL},
imp AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM g)) AS c_acctbal,
  c_nationkey, coalesce(c_mktsegment, {_mode_sql('c_mktsegment', 'g')}) AS c_mktsegment,
  c_nation FROM g),
sc AS (SELECT c_custkey,
  (c_acctbal - avg(c_acctbal) OVER ()) / CASE WHEN stddev_pop(c_acctbal) OVER () = 0 THEN 1
     ELSE stddev_pop(c_acctbal) OVER () END AS c_acctbal,
  (c_nationkey - avg(c_nationkey) OVER ()) / CASE WHEN stddev_pop(c_nationkey) OVER () = 0 THEN 1
     ELSE stddev_pop(c_nationkey) OVER () END AS c_nationkey,
  c_mktsegment, c_nation FROM imp),
cats AS (SELECT DISTINCT c_mktsegment AS v FROM sc),
nf AS (SELECT v FROM cats WHERE v > (SELECT min(v) FROM cats)),
fq AS (SELECT c_nation AS v, count(*) / (SELECT count(c_nation) FROM sc) AS f FROM sc GROUP BY 1)
SELECT c_custkey, 'c_acctbal' AS feature, round(c_acctbal, 4) AS value FROM sc
UNION ALL SELECT c_custkey, 'c_nationkey', round(c_nationkey, 4) FROM sc
UNION ALL SELECT c_custkey, 'c_mktsegment_' || v,
  CAST(CASE WHEN c_mktsegment = v THEN 1 ELSE 0 END AS DOUBLE) FROM sc, nf
UNION ALL SELECT c_custkey, 'c_nation_freq', round(f, 4) FROM sc LEFT JOIN fq ON sc.c_nation = fq.v""")
def customer_prep(spark, sf):
    df, spec = prepare_customer(spark, sf)
    feats = ["c_acctbal", "c_nationkey"] + spec.output_columns()
    return round_doubles(unpivot(df, ["c_custkey"], feats), 4)


def prepare_customer(spark, sf):
    """customer → inject nulls → impute (mean / mode) → standard scale → encode."""
    c = customer_gaps(spark, sf)
    c = I.impute(c, "mean", num_cols=["c_acctbal", "c_nationkey"], cat_cols=["c_mktsegment"])
    c = S.scale(c, ["c_acctbal", "c_nationkey"], "standard")
    spec = E.fit_encode(c, ["c_mktsegment", "c_nation"])
    return spec.apply(c), spec


def flagship(spark, sf):
    df, _ = prepare_customer(spark, sf)
    return df


# ---- selection ----------------------------------------------------------------
SEL_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _sel_report(sel, rep):
    return round_doubles(rep, 4)


@query("select_variance", union_all([
    f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS score, var_pop({c}) > 0.05 AS selected "
    f"FROM lineitem" for c in SEL_FEATS]))
def select_variance(spark, sf):
    li = table(spark, sf, "lineitem")
    return _sel_report(*SEL.select_variance(li, SEL_FEATS, 0.05))


CORR_FEATS = ["l_quantity", "l_extendedprice", "l_price_copy", "l_discount", "l_tax"]
CORR_SRC = "(SELECT *, l_extendedprice * 1.001 + l_quantity * 0.01 AS l_price_copy FROM lineitem)"


def _corr_sel_sql() -> str:
    parts = []
    for j, b in enumerate(CORR_FEATS):
        if j == 0:
            parts.append(f"SELECT '{b}' AS feature, 0.0 AS score, true AS selected")
            continue
        rs = ", ".join(f"abs(corr({a}, {b}))" for a in CORR_FEATS[:j])
        m = f"greatest({rs})" if j > 1 else rs
        parts.append(f"SELECT '{b}' AS feature, round({m}, 4) AS score, {m} <= 0.9 AS selected "
                     f"FROM {CORR_SRC} s")
    return union_all(parts)


@query("select_correlation", _corr_sel_sql())
def select_correlation(spark, sf):
    li = table(spark, sf, "lineitem").withColumn(
        "l_price_copy", F.col("l_extendedprice") * 1.001 + F.col("l_quantity") * 0.01)
    return _sel_report(*SEL.select_correlation(li, CORR_FEATS, 0.9))


KB_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


def _kbest_reg_sql() -> str:
    arms = union_all([f"SELECT '{c}' AS feature, {i} AS pos, corr({c}, l_extendedprice) AS r, "
                      f"count(*) AS n FROM lineitem" for i, c in enumerate(KB_FEATS)])
    return f"""WITH s AS ({arms}), f AS (SELECT feature, pos, r * r / (1 - r * r) * (n - 2) AS score FROM s)
SELECT feature, round(score, 4) AS score,
  row_number() OVER (ORDER BY score DESC, pos) <= 2 AS selected FROM f"""


@query("select_kbest_regression", _kbest_reg_sql())
def select_kbest_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    return _sel_report(*SEL.select_kbest(li, KB_FEATS, "l_extendedprice", 2, "regression"))


KC_FEATS = ["c_acctbal", "c_nationkey", "c_custkey"]


def _kbest_cls_sql() -> str:
    arms = []
    for i, c in enumerate(KC_FEATS):
        x = f"CAST({c} AS DOUBLE)"
        arms.append(f"""SELECT '{c}' AS feature, {i} AS pos,
  (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) AS msb,
  (sum(q) - sum(s * s / n)) / (sum(n) - count(*)) AS msw
FROM (SELECT c_mktsegment, count(*) AS n, sum({x}) AS s, sum({x} * {x}) AS q
      FROM customer GROUP BY c_mktsegment) g""")
    return f"""WITH f AS ({union_all(arms)})
SELECT feature, round(msb / msw, 4) AS score,
  row_number() OVER (ORDER BY msb / msw DESC, pos) <= 2 AS selected FROM f"""


@query("select_kbest_classification", _kbest_cls_sql())
def select_kbest_classification(spark, sf):
    c = table(spark, sf, "customer")
    return _sel_report(*SEL.select_kbest(c, KC_FEATS, "c_mktsegment", 2))


@query("select_rfe")
def select_rfe(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    d = lab.join(docs, "doc_id").withColumn("len_log", F.log1p("n_chars"))
    _, rep = SEL.select_rfe(d, ["n_chars", "len_log", "toxic", "doc_id"], "quality", k=2,
                            num_trees=10)
    return rep


# ---- splits and folds ---------------------------------------------------------
H = "((({k}) % 2147483648) * 1103515245 + 12345 * 42) % 2147483648"


@query("split_random", f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY
  {H.format(k='o_orderkey')}, o_orderkey) <= ceil(count(*) OVER () * 0.2) THEN 'test'
  ELSE 'train' END AS split FROM orders""")
def split_random(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return SP.split_random(o, "o_orderkey", 0.2, 42, portable=True)


STRAT_SQL = f"""WITH c AS (SELECT c_mktsegment AS y, count(*) AS n_c FROM customer GROUP BY 1),
t AS (SELECT CAST(ceil(sum(n_c) * 0.2) AS BIGINT) AS n_test, sum(n_c) AS n FROM c),
e AS (SELECT y, n_c, n_test * n_c / n AS ex FROM c, t),
f AS (SELECT y, n_c, ex, least(floor(ex), n_c) AS fl FROM e),
rr AS (SELECT *, row_number() OVER (ORDER BY ex - floor(ex) DESC, y) AS rk FROM f),
al AS (SELECT y, fl + CASE WHEN rk <= (SELECT n_test FROM t) - (SELECT sum(fl) FROM f)
  THEN 1 ELSE 0 END AS alloc FROM rr),
r AS (SELECT c_custkey, c_mktsegment AS y, row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY {H.format(k='c_custkey')}, c_custkey) AS rn FROM customer)
SELECT c_custkey, y AS c_mktsegment, CASE WHEN rn <= alloc THEN 'test' ELSE 'train' END AS split
FROM r JOIN al USING (y)"""


@query("split_stratified", STRAT_SQL)
def split_stratified(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return SP.split_stratified(c, "c_custkey", "c_mktsegment", 0.2, 42, portable=True)


@query("split_sequential", """SELECT o_orderkey, o_orderdate, CASE WHEN row_number() OVER
  (ORDER BY o_orderdate, o_orderkey) <= CAST(floor(count(*) OVER () * 0.8) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM orders""")
def split_sequential(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return SP.split_sequential(o, ["o_orderdate", "o_orderkey"], 0.2)


@query("folds_kfold", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY
  {H.format(k='o_orderkey')}, o_orderkey) - 1 AS r0, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN r0 < (n % 5) * (n // 5 + 1) THEN r0 // (n // 5 + 1)
  ELSE (n % 5) + (r0 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r""")
def folds_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return SP.assign_folds(o, "o_orderkey", "kfold", 5, portable=True)[0]


@query("folds_stratified", f"""SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY
  c_mktsegment ORDER BY {H.format(k='c_custkey')}, c_custkey) - 1) % 5 AS INTEGER) AS fold
FROM customer""")
def folds_stratified(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return SP.assign_folds(c, "c_custkey", "stratified", 5, label="c_mktsegment",
                           portable=True)[0]


@query("folds_timeseries", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id)
  AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, CAST(CASE WHEN rn <= n - 5 * (n // 6) THEN -1
  ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) END AS INTEGER) AS fold FROM r""")
def folds_timeseries(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return SP.assign_folds(e, "event_id", "timeseries", 5, order=["ts", "event_id"])[0] \
        .select("event_id", "fold")


# ---- balancing ----------------------------------------------------------------

@query("balance_oversample", f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
m AS (SELECT max(n) AS t FROM c),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY
  {H.format(k='doc_id')}, doc_id) AS rn FROM labels)
SELECT doc_id, r.toxic, CAST(CASE WHEN c.n = m.t THEN 1
  ELSE m.t // c.n + CASE WHEN rn <= m.t % c.n THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM r JOIN c ON r.toxic = c.toxic, m""")
def balance_oversample(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    out = B.oversample(lab, "toxic", "doc_id", "auto", 42, portable=True)
    return out.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))


@query("balance_undersample", f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY
  {H.format(k='doc_id')}, doc_id) AS rn FROM labels)
SELECT doc_id, toxic FROM r WHERE rn <= (SELECT min(n) FROM c)""")
def balance_undersample(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return B.undersample(lab, "toxic", "doc_id", "auto", 42, portable=True)


@query("folds_loo", f"""SELECT c_custkey, CAST(row_number() OVER (ORDER BY
  {H.format(k='c_custkey')}, c_custkey) - 1 AS INTEGER) AS fold FROM customer""")
def folds_loo(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return SP.assign_folds(c, "c_custkey", "loo", portable=True)[0]
