"""Flow-influence analysis (2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import signals as S
from ..functions.columns import epoch_micros
from ..operators import influence as H
from ..operators.serving import thinned
from . import dataset as D
from .common import ORACLES, query, r, sr
from .ingest import _TIME_SQL, text_times_us
from .tables import _stage

_COLUMNS = [H.TARGET, *H.DIRECT, *H.DEGRADATION]
_ROWS_SQL = f"""{D.READINGS_SQL},
arows AS (SELECT * FROM readings WHERE is_normal_operation AND qn_m3h IS NOT NULL)"""


@query("h1_analysis_window", f"""
WITH {D.READINGS_SQL}
SELECT asset_id, count(*) AS raw_rows, count(*) FILTER (WHERE is_normal_operation) AS normal_rows,
  count(*) FILTER (WHERE is_normal_operation AND qn_m3h IS NOT NULL) AS valid_rows,
  count(*) FILTER (WHERE coalesce(st_oper = 'PARTINDO', false)) AS transition_rows, min(us) AS start_us, max(us) AS end_us FROM readings GROUP BY 1""")
def analysis_window(spark, sf):
    return H.window_counts(D.readings(spark, sf))


_AIR, _VAC = "pv_temp_ar_estagio_3_c", "pv_pres_vacuo_cx_engran_inh2o"
_MEASURED = [*H.DIRECT, *H.DEGRADATION]


def _with_faults(spark, sf):
    """Readings in which one asset's air sensor reads zero, another's pressure is mostly missing, a third's relief is constant."""
    rows = D.readings(spark, sf)
    return rows.withColumns({
        _AIR: F.when(F.col("asset_id") == 1, 0.0).otherwise(F.col(_AIR)),
        _VAC: F.when(F.col("asset_id") == 1, 250.0).otherwise(F.col(_VAC)),
        "pv_pres_sistema_bar": F.when((F.col("asset_id") == 2) & (F.pmod("eid", F.lit(3)) > 0), None).otherwise(F.col("pv_pres_sistema_bar")),
        "pv_pos_alivio_pct": F.when(F.col("asset_id") == 3, 7.0).otherwise(F.col("pv_pos_alivio_pct")),
        "qn_m3h": F.when(F.pmod("eid", F.lit(31)) == 0, None).otherwise(F.col("qn_m3h")),
    })


_FAULTY_SQL = f"""{D.READINGS_SQL},
faulty AS (SELECT * REPLACE (CASE WHEN asset_id = 1 THEN 0e0 ELSE {_AIR} END AS {_AIR}, CASE WHEN asset_id = 1 THEN 250e0 ELSE {_VAC} END AS {_VAC},
    CASE WHEN asset_id = 2 AND eid % 3 > 0 THEN NULL ELSE pv_pres_sistema_bar END AS pv_pres_sistema_bar,
    CASE WHEN asset_id = 3 THEN 7e0 ELSE pv_pos_alivio_pct END AS pv_pos_alivio_pct, CASE WHEN eid % 31 = 0 THEN NULL ELSE qn_m3h END AS qn_m3h) FROM readings),
arows AS (SELECT * FROM faulty WHERE is_normal_operation AND qn_m3h IS NOT NULL),
wc AS (SELECT asset_id, count(*) FILTER (WHERE coalesce(st_oper = 'PARTINDO', false)) AS tr, count(*) FILTER (WHERE is_normal_operation AND qn_m3h IS NULL) AS miss FROM faulty GROUP BY 1),
flags AS (
  SELECT asset_id, 'transition_rows_excluded' AS code, '' AS signal, tr::DOUBLE AS detail, 'info' AS severity, 0 AS ordinal FROM wc WHERE tr > 0
  UNION ALL SELECT asset_id, 'target_nulls', 'qn_m3h', miss, 'warning', 1 FROM wc WHERE miss > 0
  UNION ALL SELECT asset_id, 'persistent_zero_critical_signal', '{_AIR}', round(avg(({_AIR} = 0)::INT), 3), 'warning', 5 FROM arows GROUP BY 1 HAVING count({_AIR}) >= 10 AND avg(({_AIR} = 0)::INT) >= 0.75
  UNION ALL SELECT asset_id, 'engineering_inconsistent_signal', '{_VAC}', round(avg(({_VAC} < 2 OR {_VAC} > 20)::INT), 3), 'warning', 6 FROM arows GROUP BY 1 HAVING count({_VAC}) >= 5 AND avg(({_VAC} < 2 OR {_VAC} > 20)::INT) >= 0.5
  {' '.join(f"UNION ALL SELECT asset_id, 'high_null_ratio', '{c}', round(avg(({c} IS NULL)::INT), 3), 'warning', 4 FROM arows GROUP BY 1 HAVING avg(({c} IS NULL)::INT) >= 0.2" for c in _COLUMNS)}
  {' '.join(f"UNION ALL SELECT asset_id, 'possible_stuck_signal', '{c}', round(max({c}) - min({c}), 6), 'info', 7 FROM arows GROUP BY 1 HAVING count({c}) >= 45 AND max({c}) - min({c}) <= greatest(abs(arg_max({c}, us)) * 0.001e0, 0.01e0)" for c in _MEASURED)})"""


@query("h2_analysis_quality_flags", f"WITH {_FAULTY_SQL} SELECT asset_id, code, signal, severity, detail + 0e0 AS detail FROM flags")
def quality_flags(spark, sf):
    return H.quality_flags(_with_faults(spark, sf)).select("asset_id", "code", F.coalesce("signal", F.lit("")).alias("signal"), "severity", r("detail", 6))


@query("h2_flags_of_times_and_target", f"""
WITH {D.READINGS_SQL}, times AS (SELECT asset_id, {_TIME_SQL} AS us FROM raw),
c AS (SELECT asset_id, count(*) FILTER (WHERE us IS NULL) AS bad, count(us) - count(DISTINCT us) AS dup FROM times GROUP BY 1)
SELECT 'all' AS given, asset_id, 'invalid_timestamp' AS code, 'warning' AS severity, '' AS signal, bad + 0e0 AS detail FROM c WHERE bad > 0
UNION ALL SELECT 'all', asset_id, 'duplicate_timestamp', 'info', '', dup + 0e0 FROM c WHERE dup > 0
UNION ALL SELECT DISTINCT 'all', asset_id + 4, 'empty_dataset', 'critical', '', -1e0 FROM raw
UNION ALL SELECT DISTINCT 'no target', asset_id, 'target_unavailable', 'critical', 'qn_m3h', -1e0 FROM raw
UNION ALL SELECT DISTINCT 'no times', asset_id, 'missing_timestamp', 'critical', '', -1e0 FROM raw""")
def flags_of_times_and_target(spark, sf):
    """Unreadable and repeated times, assets without a row, tables without the target or without times."""
    rows = D.readings(spark, sf)
    expected = rows.select(F.explode(F.array(F.col("asset_id"), F.col("asset_id") + 4)).alias("asset_id"))
    found = {"all": H.quality_flags(rows, raw_times=text_times_us(spark, sf), assets=expected), "no target": H.quality_flags(rows.drop(H.TARGET)),
             "no times": H.quality_flags(rows.drop("us"))}
    codes = ["invalid_timestamp", "duplicate_timestamp", "empty_dataset", "target_unavailable", "missing_timestamp"]
    parts = [flags.where(F.col("code").isin(codes)).select(
        F.lit(given).alias("given"), "asset_id", "code", "severity", F.coalesce("signal", F.lit("")).alias("signal"), F.coalesce("detail", F.lit(-1.0)).alias("detail"))
        for given, flags in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- three-feature model on lineitem, with gaps in one feature ---
_LI = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _lineitem(spark, sf):
    rows = D.table(spark, sf, "lineitem")
    return rows.select(
        F.ascii("l_returnflag").cast("bigint").alias("asset_id"), epoch_micros("l_shipdate").alias("us"), "l_orderkey", "l_linenumber",
        "l_extendedprice", "l_quantity", F.when(F.pmod("l_orderkey", F.lit(10)) != 3, F.col("l_discount")).alias("l_discount"), "l_tax")


def _lineitem_models(spark, sf):
    stats = H.sufficient_statistics(_lineitem(spark, sf), _LI)
    return H.fit_models(stats, _LI, direct=_LI[1:], degradation=[], target=_LI[0], expected={})


_LI_SQL = """li AS (SELECT ascii(l_returnflag)::BIGINT AS asset_id, l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS a,
    CASE WHEN l_orderkey % 10 <> 3 THEN l_discount END AS b, l_tax AS c FROM lineitem),
cc AS (SELECT * FROM li WHERE b IS NOT NULL AND a IS NOT NULL AND c IS NOT NULL AND y IS NOT NULL),
m AS (SELECT asset_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS c2,
    covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy, var_pop(y) AS yy FROM cc GROUP BY 1),
d AS (SELECT *, aa * (bb * c2 - bc * bc) - ab * (ab * c2 - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
k AS (SELECT *, (ay * (bb * c2 - bc * bc) - ab * (byy * c2 - bc * cy) + ac * (byy * bc - bb * cy)) / det AS ka,
    (aa * (byy * c2 - bc * cy) - ay * (ab * c2 - bc * ac) + ac * (ab * cy - byy * ac)) / det AS kb,
    (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM d),
model AS (SELECT *, my - ka * ma - kb * mb - kc * mc AS b0, (ka * ay + kb * byy + kc * cy) / yy AS r2,
    ka * sqrt(aa / yy) AS sa, kb * sqrt(bb / yy) AS sb, kc * sqrt(c2 / yy) AS sc FROM k)"""


@query("h3_least_squares_fit", f"""
WITH {_LI_SQL} SELECT asset_id, n, {sr('b0', 'intercept', 3)}, {sr('r2', 'r2', 6)}, {sr('ka', 'l_quantity', 3)}, {sr('kb', 'l_discount', 3)}, {sr('kc', 'l_tax', 3)},
  {sr('sa', 'std_quantity', 6)}, {sr('sb', 'std_discount', 6)}, {sr('sc', 'std_tax', 6)} FROM model""")
def least_squares_fit(spark, sf):
    direct = _lineitem_models(spark, sf).where(F.col("model") == "direct")
    at = lambda column, i: F.element_at(column, i + 1)
    return direct.select("asset_id", "n", r("intercept", 3), r("r2", 6), *[r(at("coefficients", i), 3, c) for i, c in enumerate(_LI[1:])],
                         *[r(at("standardized", i), 6, c) for i, c in enumerate(("std_quantity", "std_discount", "std_tax"))])


@query("h6_influence_ranking", f"""
WITH {_LI_SQL}, s AS (SELECT asset_id, unnest([{{'v': 'l_quantity', 'k': ka, 's': sa}}, {{'v': 'l_discount', 'k': kb, 's': sb}}, {{'v': 'l_tax', 'k': kc, 's': sc}}], recursive := true) FROM model),
w AS (SELECT *, abs(s) / sum(abs(s)) OVER (PARTITION BY asset_id) AS share FROM s)
SELECT asset_id, v AS variable, {sr('share', 'influence')}, CASE WHEN s >= 0 THEN 'positivo' ELSE 'negativo' END AS sign, {sr('k', 'coefficient', 3)} FROM w WHERE share >= 0.005""")
def influence_ranking(spark, sf):
    items = H.influence_items(_lineitem_models(spark, sf))
    return items.where(F.col("model") == "direct").select("asset_id", "variable", r("influence"), "sign", r("coefficient", 3))


@query("h7_h8_expected_and_residual", f"""
WITH {_LI_SQL}, e AS (SELECT li.asset_id, l_orderkey, l_linenumber, li.y, b0 + ka * a + kb * b + kc * c AS ex FROM li JOIN model USING (asset_id))
SELECT asset_id, l_orderkey, l_linenumber, {sr('y', 'y', 2)}, {sr('ex', 'expected', 2)}, {sr('y - ex', 'delta', 2)}, {sr('(y - ex) / nullif(ex, 0) * 100', 'delta_pct', 2)} FROM e""")
def expected_and_residual(spark, sf):
    scored = H.score_rows(_lineitem(spark, sf), _lineitem_models(spark, sf), _LI[1:], _LI[0])
    return scored.select("asset_id", "l_orderkey", "l_linenumber", r("l_extendedprice", 2, "y"), r("expected", 2), r("delta", 2), r("delta_pct", 2))


# --- one-feature models on the readings: closed forms for both models ---
_X, _Z = "pv_pos_abert_valv_admissao_pct", "pv_temp_oleo_lubrificacao_c"
_ONE_SQL = f"""{_ROWS_SQL},
b1 AS (SELECT asset_id, regr_slope(qn_m3h, {_X}) AS k, regr_intercept(qn_m3h, {_X}) AS b0, regr_r2(qn_m3h, {_X}) AS r2, count(*) AS n FROM arows GROUP BY 1),
res AS (SELECT a.*, b0 + k * {_X} AS ex, qn_m3h - (b0 + k * {_X}) AS de FROM arows a JOIN b1 USING (asset_id)),
b2 AS (SELECT asset_id, regr_slope(de, {_Z}) AS k2, regr_intercept(de, {_Z}) AS c0, regr_r2(de, {_Z}) AS rl FROM res GROUP BY 1)"""


def _one_feature(spark, sf):
    rows = H.analysis_rows(D.readings(spark, sf))
    columns = [H.TARGET, _X, _Z]
    return rows, H.fit_models(H.sufficient_statistics(rows, columns), columns, direct=[_X], degradation=[_Z], expected={})


@query("h9_loss_model", f"WITH {_ONE_SQL} SELECT asset_id, {sr('k2', 'coefficient', 3)}, {sr('c0', 'intercept', 2)}, {sr('rl', 'r2', 6)} FROM b2")
def loss_model(spark, sf):
    _rows, models = _one_feature(spark, sf)
    return models.where(F.col("model") == "loss").select("asset_id", r(F.element_at("coefficients", 1), 3, "coefficient"), r("intercept", 2), r("r2", 6))


@query("h18_model_quality", f"""
WITH {_ONE_SQL}, e AS (SELECT res.asset_id, avg(abs(de)) AS md, avg(abs(de - (c0 + k2 * {_Z}))) AS ml FROM res JOIN b2 USING (asset_id) GROUP BY 1),
u AS (SELECT asset_id, 'direct' AS model, r2, md AS mae, n FROM b1 JOIN e USING (asset_id) UNION ALL SELECT b2.asset_id, 'loss', rl, ml, n FROM b2 JOIN e USING (asset_id) JOIN b1 USING (asset_id))
SELECT asset_id, model, {sr('r2', 'r2')}, {sr('mae', 'mae', 2)}, n AS points, CASE WHEN r2 >= 0.75 THEN 'forte' WHEN r2 >= 0.45 THEN 'moderada' WHEN r2 >= 0.2 THEN 'baixa' ELSE 'muito baixa' END AS fit FROM u""")
def model_quality(spark, sf):
    rows, models = _one_feature(spark, sf)
    quality = H.model_quality(models, H.model_errors(rows, models, [_X], [_Z]))
    return quality.select("asset_id", "model", r("r2"), r("mae", 2), "points", "fit")


@query("h17_influence_history", f"""
WITH {_ONE_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY us) - 1 AS rn, count(*) OVER (PARTITION BY asset_id) AS n FROM res),
idx AS (SELECT DISTINCT c.asset_id, floor(i * (c.n - 1) / 239)::BIGINT AS rn FROM (SELECT DISTINCT asset_id, n FROM p) c, range(240) t(i))
SELECT p.asset_id, us, {sr('qn_m3h', 'qn_real', 2)}, {sr('ex', 'expected', 2)}, {sr('de', 'delta', 2)}, {sr('de / nullif(ex, 0) * 100', 'delta_pct', 2)} FROM p
LEFT JOIN idx ON p.asset_id = idx.asset_id AND p.rn = idx.rn WHERE p.n <= 240 OR idx.rn IS NOT NULL""")
def influence_history(spark, sf):
    rows, models = _one_feature(spark, sf)
    points = thinned(H.score_rows(rows, models, [_X]), 240, ("asset_id",))
    return points.select("asset_id", "us", r("qn_m3h", 2, "qn_real"), r("expected", 2), r("delta", 2), r("delta_pct", 2))


# --- two direct features with expected signs: every subset in closed form ---
_V, _W = "pv_pres_descarga_bar", "pv_pos_valv_bypass_pct"
_TWO_SQL = f"""{_ROWS_SQL},
t AS (SELECT asset_id, qn_m3h AS y, {_V} AS a, {_W} AS b, {_Z} AS z FROM arows),
both_rows AS (SELECT asset_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb,
  covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
ab_fit AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS ka, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM both_rows),
fits AS (
  SELECT asset_id, 'ab' AS used, n, ka, kb, my - ka * ma - kb * mb AS b0, (ka * ay + kb * cy) / yy AS r2, ka * sqrt(aa / yy) AS sa, kb * sqrt(bb / yy) AS sb FROM ab_fit
  UNION ALL SELECT asset_id, 'a', count(*), regr_slope(y, a), NULL, regr_intercept(y, a), regr_r2(y, a), corr(y, a), NULL FROM t WHERE a IS NOT NULL GROUP BY 1
  UNION ALL SELECT asset_id, 'b', count(*), NULL, regr_slope(y, b), regr_intercept(y, b), regr_r2(y, b), NULL, corr(y, b) FROM t WHERE b IS NOT NULL GROUP BY 1
  UNION ALL SELECT asset_id, '', count(*), NULL, NULL, avg(y), 0e0, NULL, NULL FROM t GROUP BY 1),
judged AS (SELECT *, concat(CASE WHEN sa < {H.LEAST_SHARE} THEN 'a' ELSE '' END, CASE WHEN sb < {H.LEAST_SHARE} THEN 'b' ELSE '' END) AS sound FROM fits),
first_round AS (SELECT asset_id, sound AS used FROM judged WHERE used = 'ab'),
second_round AS (SELECT j.asset_id, j.sound AS used FROM judged j JOIN first_round f USING (asset_id, used)),
direct AS (SELECT j.*, concat_ws('|', CASE WHEN used NOT LIKE '%b' THEN '{_W}' END, CASE WHEN used NOT LIKE 'a%' THEN '{_V}' END) AS dropped,
  coalesce(round((CASE WHEN sa >= 0 THEN sa ELSE 0 END + CASE WHEN sb >= 0 THEN sb ELSE 0 END) / nullif(coalesce(abs(sa), 0) + coalesce(abs(sb), 0), 0), 4), 0) + 0e0 AS issue
  FROM judged j JOIN second_round USING (asset_id, used)),
rest AS (SELECT t.asset_id, z, y - b0 - coalesce(ka * a, 0) - coalesce(kb * b, 0) AS d FROM t JOIN direct USING (asset_id)
  WHERE z IS NOT NULL AND (ka IS NULL OR a IS NOT NULL) AND (kb IS NULL OR b IS NOT NULL)),
loss AS (SELECT asset_id, count(*) AS n, regr_slope(d, z) AS kz, regr_intercept(d, z) AS c0, regr_r2(d, z) AS rl FROM rest GROUP BY 1)"""


def _two_features(spark, sf):
    columns = [H.TARGET, _V, _W, _Z]
    return H.fit_models(H.sufficient_statistics(H.analysis_rows(D.readings(spark, sf)), columns), columns, direct=[_V, _W], degradation=[_Z])


@query("h4_h5_sign_constrained_two_features", f"""
WITH {_TWO_SQL}
SELECT asset_id, 'direct' AS model, n, {sr('b0', 'intercept', 2)}, {sr('r2', 'r2', 6)}, {sr('ka', 'pressure', 3)}, {sr('kb', 'bypass', 3)}, NULL AS oil, dropped FROM direct
UNION ALL SELECT asset_id, 'loss', n, round(c0, 2) + 0e0, round(rl, 6) + 0e0, NULL, NULL, round(kz, 3) + 0e0, '' FROM loss""")
def sign_constrained_two_features(spark, sf):
    """Features whose sign contradicts the physics go, the rest is fitted anew on the rows then complete."""
    slope = F.map_from_arrays("features", "coefficients")
    found = _two_features(spark, sf).withColumn("_k", slope)
    return found.select("asset_id", "model", "n", r("intercept", 2), r("r2", 6), *[r(F.col("_k")[c], 3, name) for c, name in ((_V, "pressure"), (_W, "bypass"), (_Z, "oil"))],
                        F.array_join(F.array_sort("sign_removed"), "|").alias("dropped"))


@query("h12_sign_issue_two_features", f"""
WITH {_TWO_SQL}, loose AS (SELECT asset_id, (CASE WHEN sa >= 0 THEN sa ELSE 0 END + CASE WHEN sb >= 0 THEN sb ELSE 0 END) / (abs(sa) + abs(sb)) AS share FROM fits WHERE used = 'ab')
SELECT asset_id, issue AS sign_issue, {sr('share', 'share_before')} FROM direct JOIN loose USING (asset_id)""")
def sign_issue_two_features(spark, sf):
    """Share of the contradicting features in the model, after the removal rounds and, from the free model, before them."""
    columns = [H.TARGET, _V, _W]
    free = H.fit_models(H.sufficient_statistics(H.analysis_rows(D.readings(spark, sf)), columns), columns, direct=columns[1:], degradation=[], expected={})
    held = F.map_from_arrays("features", "standardized")
    wrong = F.when(held[_V] >= 0, held[_V]).otherwise(0.0) + F.when(held[_W] >= 0, held[_W]).otherwise(0.0)
    before = free.where("model = 'direct'").select("asset_id", (wrong / (F.abs(held[_V]) + F.abs(held[_W]))).alias("share"))
    found = _two_features(spark, sf).where("model = 'direct'").select("asset_id", "sign_issue")
    return found.join(before, "asset_id").select("asset_id", r("sign_issue"), r("share", 4, "share_before"))


def _pair_sql(a: str, b: str) -> str:
    return (f"SELECT asset_id, '{a}' AS \"left\", '{b}' AS \"right\", covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS c FROM full_rows GROUP BY 1")


_PAIRS = [(a, b) for i, a in enumerate(_MEASURED) for b in _MEASURED[i + 1:]]


@query("h10_collinear_pairs", f"""
WITH {_ROWS_SQL}, full_rows AS (SELECT * FROM arows WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _MEASURED)}),
pairs AS ({' UNION ALL '.join(_pair_sql(a, b) for a, b in _PAIRS)})
SELECT asset_id, "left", "right", {sr('c', 'correlation')} FROM pairs WHERE abs(c) >= 0.85""")
def collinear_pairs(spark, sf):
    stats = H.sufficient_statistics(H.analysis_rows(D.readings(spark, sf)), _COLUMNS)
    return H.correlated_pairs(stats, _COLUMNS, _MEASURED).select("asset_id", "left", "right", r("correlation"))


def _drifting(spark, sf):
    """Readings whose flow falls with time, so that signals that rise with time are adverse."""
    return D.readings(spark, sf).withColumn("qn_m3h", 9000.0 - 3000.0 * (F.col("us") - 1704067200000000) / 2.592e12 + 300.0 * F.col("pv_vib_estagio_1_mils"))


@query("h11_degradation_context", f"""
WITH {D.READINGS_SQL},
drift AS (SELECT * REPLACE (9000e0 - 3000e0 * (us - 1704067200000000) / 2.592e12 + 300e0 * pv_vib_estagio_1_mils AS qn_m3h) FROM readings),
arows AS (SELECT asset_id, us, qn_m3h, {', '.join(H.DEGRADATION)} FROM drift WHERE is_normal_operation),
lng AS (SELECT * FROM arows UNPIVOT (value FOR signal IN ({', '.join(H.DEGRADATION)}))),
pos AS (SELECT *, row_number() OVER (PARTITION BY asset_id, signal ORDER BY us) AS rn, count(*) OVER (PARTITION BY asset_id, signal) AS n FROM lng),
g AS (SELECT asset_id, signal, count(*) AS n, corr(qn_m3h, value) AS c, stddev_pop(value) AS sd,
    median(value) FILTER (WHERE rn > n - greatest(5, floor(n * 0.2))) - median(value) FILTER (WHERE rn <= greatest(5, floor(n * 0.2))) AS d FROM pos GROUP BY 1, 2),
t AS (SELECT *, least(1e0, abs(d) / greatest(sd * 2e0, 1e-9)) AS tr, CASE WHEN signal = 'pv_pres_oleo_bar' THEN d < 0 AND c >= 0.35 ELSE d > 0 AND c <= -0.35 END AS adv FROM g WHERE n >= 20 AND sd > 1e-9)
SELECT asset_id, signal, n, {sr('c', 'correlation')}, {sr('d', 'drift')}, {sr('tr', 'trend')}, CASE WHEN adv THEN 1 ELSE 0 END AS adverse,
  {sr('CASE WHEN adv THEN least(0.95e0, abs(c) * greatest(0.35e0, tr)) ELSE 0e0 END', 'score')} FROM t""")
def degradation_context(spark, sf):
    found = H.degradation_context(H.analysis_rows(_drifting(spark, sf)))
    return found.select("asset_id", "signal", "n", r("correlation"), r("drift"), r("trend"), F.col("adverse").cast("int").alias("adverse"), r("score"))


@query("h11_exact_median_large_groups", """
SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_extendedprice) + 0e0 AS median FROM lineitem GROUP BY 1, 2""")
def exact_median(spark, sf):
    keys = ["l_returnflag", "l_linestatus"]
    rows = D.table(spark, sf, "lineitem")
    return H.exact_median(rows, keys, "l_extendedprice").join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys).select(*keys, "n", "median")


# --- the decision list, on evidence made from every event ---
_EVIDENCE = {
    "n": "CASE WHEN eid % 37 = 0 THEN 20 ELSE 25 + eid % 200 END",
    "r2_direct": "q", "r2_loss": "u", "sign_issue": "CASE WHEN eid % 3 = 0 THEN 0.9e0 * u ELSE 0e0 END",
    "process_share": "0.6e0 * u", "control_share": "0.7e0 * q", "negative_share": "CASE WHEN eid % 2 = 0 THEN 0.9e0 * q ELSE 0.3e0 END",
    "strength": "CASE WHEN eid % 5 = 0 THEN 0.5e0 + 0.4e0 * u ELSE 0e0 END", "direct_items": "eid % 4", "serious": "CASE WHEN eid % 41 = 0 THEN 2 ELSE 0 END",
    "delta": "CASE WHEN eid % 7 = 0 THEN NULL WHEN eid % 6 = 0 THEN 5e0 ELSE -5e0 END",
}


def _evidence(spark, sf):
    events = D.table(spark, sf, "events").select(
        F.col("event_id").alias("eid"), (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 1e2).alias("q"), (F.col("value") / (F.col("value") + 50.0)).alias("u"))
    return events.select(F.col("eid").alias("asset_id"), *[F.expr(e).alias(c) for c, e in _EVIDENCE.items()],
                         F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")).alias("variables"))


@query("h13_h14_decision_list", f"""
WITH {D.READINGS_SQL},
ev AS (SELECT eid AS asset_id, {', '.join(f'{e} AS {c}' for c, e in _EVIDENCE.items())} FROM base),
e2 AS (SELECT *, greatest(0.15e0, 1e0 - sign_issue) AS rel FROM ev),
e3 AS (SELECT *, r2_direct >= 0.3 AND direct_items > 0 AND rel >= 0.35 AS dir, ((r2_loss >= 0.3 AND negative_share >= 0.35) OR strength >= 0.55) AND (delta IS NULL OR delta <= 0) AS int,
    r2_direct * greatest(process_share + control_share, 0.1e0) * rel AS ds, greatest(r2_loss * greatest(negative_share, 0.1e0), strength) AS is_ FROM e2),
e4 AS (SELECT *, CASE WHEN n < 30 OR serious >= 2 THEN 'serious' WHEN dir AND int THEN
    CASE WHEN is_ > ds * 1.45e0 OR (sign_issue >= 0.45 AND is_ >= 0.65) THEN 'internal_over_direct' WHEN r2_loss >= 0.3 AND negative_share >= 0.5 THEN 'mixed_residual'
      WHEN ds > is_ * 1.75e0 THEN CASE WHEN control_share > process_share * 1.15e0 THEN 'control' ELSE 'process' END ELSE 'mixed' END
    WHEN int THEN 'internal_only' WHEN dir THEN CASE WHEN control_share > process_share * 1.15e0 THEN 'control' ELSE 'process' END ELSE 'weak' END AS "case" FROM e3),
e5 AS (SELECT *, CASE "case" WHEN 'internal_over_direct' THEN greatest(r2_loss, is_) WHEN 'mixed_residual' THEN greatest(r2_direct, r2_loss) WHEN 'mixed' THEN greatest(r2_direct, r2_loss)
    WHEN 'internal_only' THEN r2_loss ELSE r2_direct END AS fit FROM e4)
SELECT asset_id, "case", CASE "case" WHEN 'serious' THEN 'baixa_confianca' WHEN 'weak' THEN 'baixa_confianca' WHEN 'control' THEN 'dominancia_controle' WHEN 'process' THEN 'dominancia_processo_rede'
    WHEN 'mixed' THEN 'dominancia_mista' WHEN 'mixed_residual' THEN 'dominancia_mista' ELSE 'dominancia_degradacao_interna' END AS classification,
  CASE "case" WHEN 'serious' THEN 0.25e0 WHEN 'weak' THEN 0.35e0 ELSE round(greatest(0e0, least(0.95e0, 0.32e0 + fit * 0.48e0 + least(1e0, n / 120e0) * 0.2e0)), 3) + 0e0 END AS confidence,
  CASE "case" WHEN 'serious' THEN '' WHEN 'weak' THEN 'a|b|c' ELSE 'a|b|c|d|e' END AS variables FROM e5""")
def decision_list(spark, sf):
    return H.classify_origin(_evidence(spark, sf)).select("asset_id", "case", "classification", r("confidence", 3), F.array_join("variables", "|").alias("variables"))


def _sentence_sql(parts: list) -> str:
    return " || ".join(f"'{p}'" if isinstance(p, str) else f"coalesce({'d' if p[0] == 'direct' else 'i'}, '{p[1]}')" for p in parts)


@query("h20_summary_sentence", f"""
WITH classified AS ({ORACLES["h13_h14_decision_list"]}),
top AS (SELECT *, CASE WHEN asset_id % 4 > 0 THEN 'direta ' || (asset_id % 5) END AS d, CASE WHEN asset_id % 3 > 0 THEN 'interna ' || (asset_id % 7) END AS i FROM classified)
SELECT asset_id, CASE classification {' '.join(f"WHEN '{kind}' THEN {_sentence_sql(parts)}" for kind, parts in H.SUMMARY_PARTS.items())}
  ELSE '{H.SUMMARY_OTHERWISE}' END AS summary FROM top""")
def summary_sentence(spark, sf):
    """Sentences over the evidence of every event, with a first variable in either model, in one of them or in none."""
    classified = H.classify_origin(_evidence(spark, sf))

    def first(model: str, every: int, word: str, kinds: int):
        label = F.concat(F.lit(word), F.pmod("asset_id", F.lit(kinds)).cast("string"))
        return classified.where(F.pmod("asset_id", F.lit(every)) > 0).select("asset_id", F.lit(model).alias("model"), F.lit(1).alias("place"), label.alias("label"))

    return H.summary_sentence(classified, first("direct", 4, "direta ", 5).unionByName(first("loss", 3, "interna ", 7)))


@query("h16_target_summary", f"""
WITH {_ROWS_SQL}, s AS (SELECT asset_id, avg(qn_m3h) AS m, min(qn_m3h) AS lo, max(qn_m3h) AS hi, arg_min(qn_m3h, us) AS f, arg_max(qn_m3h, us) AS l FROM arows GROUP BY 1)
SELECT asset_id, {sr('m', 'mean', 3)}, {sr('lo', 'minimum', 3)}, {sr('hi', 'maximum', 3)}, {sr('f', 'start', 3)}, {sr('l', '"end"', 3)}, {sr('l - f', 'variation', 3)},
  {sr('(l - f) / nullif(f, 0) * 100', 'variation_pct', 3)} FROM s""")
def target_summary(spark, sf):
    summary = H.target_summary(H.analysis_rows(D.readings(spark, sf)))
    return summary.select("asset_id", *[r(c, 3) for c in summary.columns[1:]])


@query("h19_low_confidence_reasons", f"""
WITH {_FAULTY_SQL},
f2 AS (SELECT asset_id, code, severity, ordinal, row_number() OVER (PARTITION BY asset_id ORDER BY ordinal) AS p FROM flags WHERE severity <> 'info'),
msg(code, text) AS (VALUES {', '.join(f"('{c}', '{m.lower()}')" for c, (_s, m) in H.FLAG_MESSAGES.items())}),
b1 AS (SELECT asset_id, regr_r2(qn_m3h, pv_vib_estagio_3_mils) AS r2, regr_slope(qn_m3h, pv_vib_estagio_3_mils) AS k, regr_intercept(qn_m3h, pv_vib_estagio_3_mils) AS b0 FROM arows GROUP BY 1),
b2 AS (SELECT a.asset_id, regr_r2(qn_m3h - b0 - k * pv_vib_estagio_3_mils, pv_temp_rolamento_dianteiro_motor) AS rl FROM arows a JOIN b1 USING (asset_id) GROUP BY 1),
parts AS (SELECT asset_id, 0 AS o, '{H.WEAK_DIRECT}' AS t FROM b1 WHERE r2 < 0.2 UNION ALL SELECT asset_id, 1, '{H.WEAK_LOSS}' FROM b2 WHERE rl < 0.2
  UNION ALL SELECT asset_id, 1 + p, text FROM f2 JOIN msg USING (code) WHERE p <= 2),
once AS (SELECT asset_id, t, min(o) AS o FROM parts GROUP BY 1, 2)
SELECT a.asset_id, coalesce(string_agg(t, '; ' ORDER BY o), '') AS reasons FROM (SELECT DISTINCT asset_id FROM arows) a LEFT JOIN once USING (asset_id) GROUP BY 1""")
def low_confidence_reasons(spark, sf):
    rows = _with_faults(spark, sf)
    columns = [H.TARGET, "pv_vib_estagio_3_mils", "pv_temp_rolamento_dianteiro_motor"]
    models = H.fit_models(H.sufficient_statistics(H.analysis_rows(rows), columns), columns, direct=columns[1:2], degradation=columns[2:], expected={})
    return H.low_confidence_reasons(models, H.quality_flags(rows))


@query("h20_operational_context", f"""
WITH {_ROWS_SQL}
SELECT asset_id, mode_key AS m, {sr('pv_corr_motor_a', 'a', 3)}, {sr('qa_m3h', 'qa', 3)}, us FROM arows QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC) = 1""")
def operational_context(spark, sf):
    document = F.from_json("context", "timestamp timestamp_ntz, mode_key string, pv_corr_motor_a double, qa_m3h double")
    found = H.operational_context(H.analysis_rows(D.readings(spark, sf))).withColumn("d", document)
    rounded = F.round(epoch_micros(F.col("d.timestamp")) / 1e3).cast("bigint")
    exact = D.readings(spark, sf).groupBy("asset_id").agg(F.max(F.when(F.col("is_normal_operation"), F.col("us"))).alias("us"))
    joined = found.join(exact, "asset_id").where(F.abs(rounded - F.floor(F.col("us") / 1000)) <= 1)
    return joined.select("asset_id", F.col("d.mode_key").alias("m"), r(F.col("d.pv_corr_motor_a"), 3, "a"), r(F.col("d.qa_m3h"), 3, "qa"), "us")


# --- the iterative parts have no SQL form; they run over all readings and are tested against numpy ---
def _models(spark, sf):
    def build():
        rows = H.analysis_rows(D.readings(spark, sf))
        return H.fit_models(H.sufficient_statistics(rows, _COLUMNS), _COLUMNS)

    return _stage("models", spark, sf, build)


@query("h4_h5_sign_constrained_models")
def sign_constrained_models(spark, sf):
    return _models(spark, sf).select("asset_id", "model", "n", r("intercept", 3), r("r2"), F.array_join("features", "|").alias("features"),
                                     F.array_join("removed", "|").alias("removed"), F.array_join("notes", "|").alias("notes"))


@query("h12_sign_issue")
def sign_issue(spark, sf):
    return _models(spark, sf).where(F.col("model") == "direct").select("asset_id", r("sign_issue"))


def _analysis(spark, sf):
    from ..session import stored

    return H.analyse(D.readings(spark, sf), store=stored)


@query("h15_dominant_variables")
def dominant_variables(spark, sf):
    return _analysis(spark, sf)["evidence"].select("asset_id", F.array_join("variables", "|").alias("variables"))


@query("h13_loss_origin_per_asset")
def loss_origin(spark, sf):
    found = _analysis(spark, sf)
    return found["origin"].join(found["summary"], "asset_id").select(
        "asset_id", "case", "classification", r("confidence", 3), "explanation", "recommendation", "summary", F.array_join("variables", "|").alias("variables"))
