"""Which variables drive delivered flow, and what explains the rest: two linear models per asset.

One scan computes sufficient statistics per asset and pattern of missing values. The models, the removal of features
with the wrong sign, rankings, correlations and the second model (its target is linear in the same columns) all come
from those few rows. Only the mean absolute error needs a second scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..functions import regression as X
from ..functions.columns import is_normal_operation, is_transition, long_rows
from ..session import literal_table, small_side

from .cleaning import time_issue_counts
from .timeslice import KEYS, number_rows, slice_by_time

# --- fixed values ---
TARGET = "qn_m3h"
DIRECT = ["pv_pos_abert_valv_admissao_pct", "pv_pos_valv_bypass_pct", "pv_pos_alivio_pct", "pv_pres_descarga_bar",
          "pv_pres_sistema_bar"]
DEGRADATION = ["pv_temp_oleo_lubrificacao_c", "pv_pres_oleo_bar", "pv_vib_estagio_1_mils", "pv_vib_estagio_2_mils",
               "pv_vib_estagio_3_mils", "pv_temp_fase_a_do_estator_c", "pv_temp_fase_b_do_estator_c",
               "pv_temp_fase_c_do_estator_c", "pv_temp_rolamento_dianteiro_motor", "pv_temp_ar_estagio_3_c"]
PROCESS = ["pv_pres_descarga_bar", "pv_pres_sistema_bar"]
CONTROL = ["pv_pos_abert_valv_admissao_pct", "pv_pos_valv_bypass_pct", "pv_pos_alivio_pct"]
EXPECTED_SIGNS = {
    "pv_pos_abert_valv_admissao_pct": "positivo",
    "pv_pos_valv_bypass_pct": "negativo",
    "pv_pos_alivio_pct": "negativo",
    "pv_pres_descarga_bar": "negativo",
    "pv_pres_sistema_bar": "negativo",
}
ADVERSE_WHEN_LOW = ["pv_pres_oleo_bar"]
MIN_ANALYSIS_POINTS = 30
MIN_MODEL_POINTS = 20
LEAST_SHARE = 0.005
FLAG_MESSAGES = {
    "empty_dataset": ("critical", "Nao ha dados disponiveis para a analise de Qn."),
    "missing_timestamp": ("critical", "A coluna timestamp e obrigatoria para a analise temporal."),
    "target_unavailable": ("critical", "A coluna qn_m3h nao esta disponivel. A analise de influencia da Qn nao pode ser ajustada."),
    "invalid_timestamp": ("warning", "Algumas linhas foram descartadas por timestamp invalido."),
    "duplicate_timestamp": ("info", "Timestamps duplicados foram consolidados para a analise."),
    "transition_rows_excluded": ("info", "Pontos em partida, parada ou desaceleracao foram excluidos do modelo principal."),
    "no_normal_operation_rows": ("critical", "Nao ha pontos EM FUNCIONAMENTO|CARREGADO suficientes para o modelo principal."),
    "target_nulls": ("warning", "Alguns pontos sem Qn foram removidos da analise."),
    "low_valid_points": ("critical", "Poucos pontos validos para uma leitura confiavel de influencia."),
    "missing_analysis_signal": ("warning", "Variavel esperada nao esta disponivel para a analise."),
    "high_null_ratio": ("warning", "Variavel com muitos nulos na janela de analise."),
    "persistent_zero_critical_signal": ("warning", "Temperatura do ar do 3o estagio esta zerada de forma persistente."),
    "engineering_inconsistent_signal": ("warning", "Vacuo da caixa de engrenagem esta fora da faixa esperada de engenharia."),
    "possible_stuck_signal": ("info", "Variavel praticamente constante na janela; pode reduzir a leitura de influencia."),
}
SERIOUS_FLAGS = ["low_valid_points", "target_unavailable", "missing_timestamp", "empty_dataset", "no_normal_operation_rows",
                 "persistent_zero_critical_signal", "engineering_inconsistent_signal"]
CLASS_TEXTS = {
    "serious": ("baixa_confianca", "A base tem poucos pontos confiaveis ou sinais suspeitos demais para separar processo, controle e degradacao com seguranca.",
                "Validar qualidade dos dados e repetir a analise com mais pontos em operacao carregada."),
    "internal_over_direct": ("dominancia_degradacao_interna", "A perda residual de Qn e mais explicada por sinais termicos ou mecanicos do compressor.",
                             "Priorizar investigacao de vibracao, oleo, temperaturas de estator/rolamento e tendencia de degradacao."),
    "mixed_residual": ("dominancia_mista", "A Qn combina uma parcela explicada por processo/rede com perda residual ligada a variaveis internas.",
                       "Tratar em paralelo a contrapressao/controle e a tendencia mecanica ou termica indicada no desvio de performance."),
    "mixed": ("dominancia_mista", "A Qn combina efeito de processo/rede/controle com sinais internos de degradacao.",
              "Separar a investigacao em duas frentes: restricao/controle de ar e condicao mecanica/termica."),
    "internal_only": ("dominancia_degradacao_interna", "A parte da perda de Qn que o processo nao explica esta associada a variaveis internas.",
                      "Focar em tendencia de vibracao, temperatura de oleo, pressoes de oleo e temperaturas do motor."),
    "control": ("dominancia_controle", "A Qn esta mais associada a atuadores e logica de controle do que a sinais internos.",
                "Verificar abertura da admissao, bypass, alivio, modo de carga e resposta da malha de controle."),
    "process": ("dominancia_processo_rede", "A Qn esta mais associada a pressao de descarga/sistema e condicoes externas de rede.",
                "Verificar secador, linha de descarga, valvulas downstream, demanda da rede e contrapressao."),
    "weak": ("baixa_confianca", "Os modelos nao encontraram relacao estatistica forte o bastante para classificar a origem da perda.",
             "Acompanhar por uma janela maior e confirmar se a Qn varia de forma coerente com processo e controle."),
}
#: a pair stands for the label of the model's first variable, or for the word beside it where there is none
SUMMARY_PARTS = {
    "dominancia_processo_rede": ["A vazao Qn esta sendo principalmente limitada por ", ("direct", "processo/rede"),
                                 ". As variaveis internas aparecem como efeito secundario nesta janela."],
    "dominancia_controle": ["A Qn esta mais sensivel ao controle, especialmente ", ("direct", "atuadores"),
                            ". Verifique admissao, bypass, alivio e a logica de carga."],
    "dominancia_degradacao_interna": ["A perda de Qn nao e explicada apenas pelo processo; ", ("loss", "variaveis internas"),
                                      " tem influencia relevante no desvio de performance."],
    "dominancia_mista": ["A perda de Qn tem origem mista: ", ("direct", "processo/controle"), " explica parte do comportamento e ",
                         ("loss", "condicao interna"), " explica parte da perda residual."],
}
SUMMARY_OTHERWISE = "A analise ainda nao tem confianca suficiente; valide qualidade dos dados e amplie a janela operacional."
WEAK_DIRECT = "as variaveis de processo/controle explicaram pouco a qn nesta janela"
WEAK_LOSS = "o desvio de performance ainda nao teve relacao forte com variaveis internas"
CURRENT_NOTE = "pv_corr_motor_a nao foi usada como explicativa direta da Qn porque a Qn e derivada da corrente."
# --- end of fixed values ---


def analysis_rows(readings: DataFrame, target: str = TARGET) -> DataFrame:
    """Readings in normal operation with a target value, without transition states."""
    return readings.where(~is_transition() & is_normal_operation() & F.col(target).isNotNull())


def window_counts(readings: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows of the window by use, and its first and last time."""
    normal = ~is_transition() & is_normal_operation()
    return readings.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(normal).alias("normal_rows"),
        F.count_if(normal & F.col(target).isNotNull()).alias("valid_rows"),
        F.count_if(is_transition()).alias("transition_rows"),
        F.min("us").alias("start_us"), F.max("us").alias("end_us"),
    )


def target_summary(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean, extremes, first, last and variation of the target over the window."""
    v = F.col(target)
    found = rows.where(v.isNotNull()).groupBy("asset_id").agg(
        F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.min_by(v, "us").alias("start"), F.max_by(v, "us").alias("end"))
    change = F.col("end") - F.col("start")
    return found.select("asset_id", *[F.round(c, 3).alias(c) for c in ("mean", "minimum", "maximum", "start", "end")],
                        F.round(change, 3).alias("variation"),
                        F.round(change / F.nullif(F.col("start"), F.lit(0.0)) * 100.0, 3).alias("variation_pct"))


def _flag(code: str, when: Column, signal: str | None = None, detail: Column | None = None) -> Column:
    severity, message = FLAG_MESSAGES[code]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"),
        F.lit(signal).cast("string").alias("signal"), (F.lit(None) if detail is None else detail).cast("double").alias("detail")))


def _listed(rows: DataFrame, flags: list[Column]) -> DataFrame:
    """One row per flag that is set, numbered in their order."""
    return rows.select("asset_id", F.posexplode(F.array_compact(F.array(*flags))).alias("ordinal", "_f")).select("asset_id", "ordinal", "_f.*")


def quality_flags(readings: DataFrame, columns: Sequence[str] = (TARGET, *DIRECT, *DEGRADATION), raw_times: DataFrame | None = None,
                  assets: DataFrame | None = None) -> DataFrame:
    """Warnings about the analysis data, one aggregate pass over the analysis rows and one over the window.

    ``raw_times`` is (asset_id, us) before rows were dropped, ``us`` NULL where unreadable; ``assets`` names the assets that should have
    data, those without a row are reported as empty. Readings without a time column, or without the target, are reported as such.
    """
    always = F.lit(True)
    if assets is not None:
        known = readings.select("asset_id").distinct()
        known = known if raw_times is None else known.unionByName(raw_times.select("asset_id").distinct())
        silent = assets.select("asset_id").distinct().join(known, "asset_id", "left_anti")
        return quality_flags(readings, columns, raw_times).unionByName(_listed(silent, [_flag("empty_dataset", always)]))
    if "us" not in readings.columns:
        return _listed(readings.select("asset_id").distinct(), [_flag("missing_timestamp", always)])
    has_target = TARGET in readings.columns
    if not has_target:
        columns = [c for c in columns if c != TARGET]
        readings = readings.withColumn(TARGET, F.lit(None).cast("double"))
    rows = analysis_rows(readings)
    present = [c for c in columns if c in readings.columns]
    measured = [c for c in present if c != TARGET]
    counts = window_counts(readings)
    aggregates: dict[str, Column] = {"_n": F.count(F.lit(1))}
    for c in present:
        aggregates[f"_null_{c}"] = F.avg(F.col(c).isNull().cast("double"))
    for c in measured:
        aggregates |= {f"_cnt_{c}": F.count(c), f"_range_{c}": F.max(c) - F.min(c), f"_std_{c}": F.stddev_pop(c),
                       f"_last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("us")))}
    air, vacuum = "pv_temp_ar_estagio_3_c", "pv_pres_vacuo_cx_engran_inh2o"
    if air in readings.columns:
        aggregates |= {"_air_n": F.count(air), "_air_zero": F.avg((F.col(air) == 0).cast("double"))}
    if vacuum in readings.columns:
        aggregates |= {"_vac_n": F.count(vacuum), "_vac_out": F.avg(((F.col(vacuum) < 2.0) | (F.col(vacuum) > 20.0)).cast("double"))}
    stats = rows.groupBy("asset_id").agg(*[c.alias(n) for n, c in aggregates.items()])
    joined = counts.join(stats, "asset_id", "left")

    time_flags = []
    if raw_times is not None:
        joined = joined.join(time_issue_counts(raw_times), "asset_id", "full").fillna(0, ["normal_rows", "valid_rows", "transition_rows"])
        time_flags = [_flag(c, F.col(c) > 0, None, F.col(c)) for c in ("invalid_timestamp", "duplicate_timestamp")]
    missing = F.col("normal_rows") - F.col("valid_rows")
    flags = [
        *time_flags,
        _flag("transition_rows_excluded", F.col("transition_rows") > 0, None, F.col("transition_rows")),
        _flag("no_normal_operation_rows", F.col("normal_rows") == 0),
        _flag("target_nulls", missing > 0, TARGET, missing) if has_target else _flag("target_unavailable", always, TARGET),
        _flag("low_valid_points", F.col("valid_rows") < MIN_ANALYSIS_POINTS, None, F.col("valid_rows")),
        *[_flag("missing_analysis_signal", F.col("_n") > 0, c) for c in columns if c not in readings.columns],
        *[_flag("high_null_ratio", F.col(f"_null_{c}") >= 0.2, c, F.round(f"_null_{c}", 3)) for c in present],
    ]
    if air in readings.columns:
        flags.append(_flag("persistent_zero_critical_signal", (F.col("_air_n") >= 10) & (F.col("_air_zero") >= 0.75), air, F.round("_air_zero", 3)))
    if vacuum in readings.columns:
        flags.append(_flag("engineering_inconsistent_signal", (F.col("_vac_n") >= 5) & (F.col("_vac_out") >= 0.5), vacuum, F.round("_vac_out", 3)))
    for c in measured:
        limit = F.greatest(F.abs(f"_last_{c}") * 0.001, F.lit(0.01))
        still = (F.col(f"_cnt_{c}") >= 45) & (F.col(f"_range_{c}") <= limit) & (F.col(f"_std_{c}") <= limit / 2.0)
        flags.append(_flag("possible_stuck_signal", still, c, F.round(f"_range_{c}", 6)))
    return _listed(joined, flags)


def sufficient_statistics(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, means and centred cross products per key and pattern of missing values, in one map-side combined pass."""
    mask = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    filled = rows.select(*keys, mask.cast("bigint").alias("mask"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    zero = F.lit(0.0)
    means = [F.coalesce(F.avg(f"x{i}"), zero) for i in range(len(columns))]
    pairs = [F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), zero) for i in range(len(columns)) for j in range(i, len(columns))]
    return filled.groupBy(*keys, "mask").agg(
        F.count(F.lit(1)).alias("n"), F.array(*means).alias("means"), F.array(*pairs).alias("covariances"))


MODEL_SCHEMA = (
    "asset_id bigint, model string, n bigint, intercept double, r2 double, features array<string>, coefficients array<double>, "
    "standardized array<double>, removed array<string>, sign_removed array<string>, notes array<string>, sign_issue double"
)


def _unpack(stats: pd.DataFrame, size: int):
    upper = np.triu_indices(size)
    for row in stats.itertuples():
        scatter = np.zeros((size, size))
        scatter[upper] = np.asarray(row.covariances) * row.n
        scatter = scatter + np.triu(scatter, 1).T
        yield int(row.mask), int(row.n), np.asarray(row.means, dtype=float), scatter


def fit_models(stats: DataFrame, columns: Sequence[str], direct: Sequence[str] = DIRECT, degradation: Sequence[str] = DEGRADATION,
               target: str = TARGET, expected: dict[str, str] | None = None, min_points: int = MIN_MODEL_POINTS) -> DataFrame:
    """Both models of each asset. A task sees an asset's statistics rows only, one per pattern of missing values."""
    names, size = list(columns), len(columns)
    signs = EXPECTED_SIGNS if expected is None else expected
    direct, degradation = [c for c in direct if c in names], [c for c in degradation if c in names]

    def per_asset(frame: pd.DataFrame) -> pd.DataFrame:
        parts = list(_unpack(frame, size))
        y = np.zeros(size)
        y[names.index(target)] = 1.0

        def fit(goal: np.ndarray, needed: list[str], features: list[str], label: str) -> X.Fit:
            moments = X.complete_moments(parts, [names.index(c) for c in needed], size)
            return X.solve(moments, names, goal, features, min_points, label)

        def sign_notes(model: X.Fit) -> list[str]:
            held = dict(zip(model.features, model.standardized))
            return [f"sinal fisico inesperado em {f}: esperado {signs[f]}, modelo indicou {X.direction(held[f])}."
                    for f in signs if f in held and X.direction(held[f]) != signs[f]]

        remaining, dropped = list(direct), []
        first = fit(y, [target, *remaining], remaining, target)
        first.notes += sign_notes(first)
        for _ in direct:
            wrong = X.unexpected_signs(first, signs, LEAST_SHARE)
            if not wrong:
                break
            dropped += [f for f in wrong if f not in dropped]
            remaining = [f for f in remaining if f not in wrong]
            if not remaining:
                earlier = first
                first = X.baseline(X.complete_moments(parts, [names.index(target)], size), y, min_points)
                first.removed = list(dict.fromkeys([*earlier.removed, *dropped]))
                first.notes = [*earlier.notes, "modelo direto reduzido a linha-base porque as variaveis de processo/controle "
                               "ficaram fisicamente incoerentes.", *first.notes]
                break
            first = fit(y, [target, *remaining], remaining, target)
            first.notes += sign_notes(first)
        first.removed += [f for f in dropped if f not in first.removed]
        first.notes += [f"{f} removida do modelo direto por sinal fisico incoerente." for f in dropped]

        residual = y.copy()
        for f, b in zip(first.features, first.coefficients):
            residual[names.index(f)] -= b
        if first.intercept is None:
            second = X.Fit(removed=list(degradation), notes=["pontos validos insuficientes para ajuste robusto: 0 de %d." % min_points])
        else:
            second = fit(residual, [target, *first.features, *degradation], degradation, "delta_q_m3h")
            if second.intercept is not None:
                second.intercept -= first.intercept

        weights = {f: abs(b) for f, b in zip(first.features, first.standardized) if f in signs}
        wrong = X.unexpected_signs(first, signs)
        issue = round(sum(weights[f] for f in wrong) / sum(weights.values()), 4) if sum(weights.values()) > 0 else 0.0
        asset = int(frame["asset_id"].iloc[0])
        return pd.DataFrame([
            dict(asset_id=asset, model=name, n=m.n, intercept=m.intercept, r2=m.r2, features=m.features, coefficients=m.coefficients,
                 standardized=m.standardized, removed=m.removed, sign_removed=dropped if name == "direct" else [], notes=m.notes, sign_issue=issue if name == "direct" else 0.0)
            for name, m in (("direct", first), ("loss", second))
        ])

    return stats.groupBy("asset_id").applyInPandas(per_asset, MODEL_SCHEMA)


def expected_value(features: str, coefficients: str, intercept: str, values: Column) -> Column:
    """Intercept plus the weighted sum; NULL when the model is empty or a used value is missing."""
    terms = F.zip_with(F.col(features), F.col(coefficients), lambda f, b: F.element_at(values, f) * b)
    return F.col(intercept) + F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def score_rows(rows: DataFrame, models: DataFrame, columns: Sequence[str] = DIRECT, target: str = TARGET) -> DataFrame:
    """Expected target, residual and residual percentage per row. One model row per asset is joined to its readings."""
    direct = models.where(F.col("model") == "direct").select(
        "asset_id", F.col("intercept").alias("_b0"), F.col("features").alias("_f"), F.col("coefficients").alias("_b"))
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))
    scored = rows.join(small_side(direct), "asset_id", "left").withColumn(
        "expected", expected_value("_f", "_b", "_b0", values)).drop("_b0", "_f", "_b")
    return scored.withColumn("delta", F.col(target) - F.col("expected")).withColumn(
        "delta_pct", F.col("delta") / F.nullif(F.col("expected"), F.lit(0.0)) * 100.0)


def model_errors(rows: DataFrame, models: DataFrame, direct: Sequence[str] = DIRECT, degradation: Sequence[str] = DEGRADATION,
                 target: str = TARGET) -> DataFrame:
    """Mean absolute error of both models: the one measure that needs the rows again.

    Each model is judged on the rows it was fitted on: complete for the features still in play when it was fitted,
    constant ones included.
    """
    def packed(name: str) -> DataFrame:
        return models.where(F.col("model") == name).select("asset_id", *[
            F.col(c).alias(f"_{name}_{c}") for c in ("intercept", "features", "coefficients", "sign_removed")])

    values = F.map_from_arrays(F.array(*[F.lit(c) for c in [*direct, *degradation]]), F.array(*[F.col(c) for c in [*direct, *degradation]]))
    wide = rows.join(small_side(packed("direct")), "asset_id").join(small_side(packed("loss")), "asset_id")
    wide = wide.withColumn("_values", values)
    wide = wide.withColumn("_delta", F.col(target) - expected_value("_direct_features", "_direct_coefficients", "_direct_intercept", F.col("_values")))
    wide = wide.withColumn("_rest", F.col("_delta") - expected_value("_loss_features", "_loss_coefficients", "_loss_intercept", F.col("_values")))
    in_play = F.array_except(F.array(*[F.lit(c) for c in direct]), F.col("_direct_sign_removed"))
    baseline = F.size("_direct_features") == 0
    complete = baseline | F.forall(in_play, lambda f: F.element_at(F.col("_values"), f).isNotNull())
    loss_complete = F.forall(F.array(*[F.lit(c) for c in degradation]), lambda f: F.element_at(F.col("_values"), f).isNotNull())
    return wide.groupBy("asset_id").agg(
        F.avg(F.when(complete, F.abs("_delta"))).alias("direct_mae"),
        F.avg(F.when(loss_complete, F.abs("_rest"))).alias("loss_mae"),
    )


def influence_items(models: DataFrame) -> DataFrame:
    """Share of each feature in the sum of absolute standardized coefficients, with catalogue texts."""
    catalogue = literal_table(models.sparkSession, "variable string, label string, unit string, subsystem string", [
        {"variable": s, "label": label, "unit": unit, "subsystem": sub} for sub, s, label, unit in S.SIGNALS])
    terms = models.select("asset_id", "model", F.inline(F.arrays_zip("features", "coefficients", "standardized"))).withColumnRenamed("features", "variable")
    share = F.abs("standardized") / F.nullif(F.sum(F.abs("standardized")).over(Window.partitionBy("asset_id", "model")), F.lit(0.0))
    positive = F.col("standardized") >= 0
    label = F.coalesce("label", F.replace(F.col("variable"), F.lit("_"), F.lit(" ")))
    start = F.concat(F.lit("Quando "), label, F.lit(" aumenta, "))
    text = (
        F.when((F.col("model") == "direct") & ~positive, F.concat(start, F.lit("a Qn tende a reduzir na janela analisada.")))
        .when(F.col("model") == "direct", F.concat(start, F.lit("a Qn tende a aumentar na janela analisada.")))
        .when(~positive, F.concat(start, F.lit("o desvio residual de Qn tende a piorar.")))
        .otherwise(F.concat(start, F.lit("o desvio residual de Qn tende a melhorar ou acompanhar recuperacao.")))
    )
    return (
        terms.withColumn("_share", share).where(F.col("_share") >= LEAST_SHARE)
        .join(F.broadcast(catalogue), "variable", "left")
        .select("asset_id", "model", "variable", label.alias("label"), "unit",
                F.coalesce("subsystem", F.when(F.col("variable").isin(CONTROL), "controle").otherwise("operacao")).alias("subsystem"),
                F.round("_share", 4).alias("influence"), F.when(positive, "positivo").otherwise("negativo").alias("sign"),
                F.round("coefficients", 6).alias("coefficient"), F.round("standardized", 6).alias("standardized"),
                text.alias("reading"))
        .withColumn("place", F.row_number().over(Window.partitionBy("asset_id", "model").orderBy(F.col("influence").desc(), "variable")))
    )


def correlated_pairs(stats: DataFrame, columns: Sequence[str], wanted: Sequence[str], least: float = 0.85) -> DataFrame:
    """Pairs of features with a high absolute correlation, from the statistics of complete rows (mask 0 for these columns)."""
    names, size = list(columns), len(columns)
    where = [names.index(c) for c in wanted]

    def per_asset(frame: pd.DataFrame) -> pd.DataFrame:
        m = X.complete_moments(list(_unpack(frame, size)), where, size)
        std = np.sqrt(np.maximum(np.diag(m.scatter), 0.0))
        found = [
            dict(asset_id=int(frame["asset_id"].iloc[0]), left=names[i], right=names[j], correlation=float(m.scatter[i, j] / (std[i] * std[j])))
            for a, i in enumerate(where) for j in where[a + 1:] if std[i] > 0 and std[j] > 0
        ]
        return pd.DataFrame([f for f in found if abs(f["correlation"]) >= least], columns=["asset_id", "left", "right", "correlation"])

    return stats.groupBy("asset_id").applyInPandas(per_asset, "asset_id bigint, left string, right string, correlation double")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10000) -> DataFrame:
    """Exact median of groups of any size.

    Two approximate quantiles bracket the median; rows below the bracket are only counted, equal values are combined
    map-side, and just the distinct values inside the bracket (about 4 / accuracy of a group) are ordered.
    """
    around = 2.0 / accuracy
    bounds = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, F.lit(0.5 - around), F.lit(accuracy)).alias("_low"),
        F.percentile_approx(value, F.lit(0.5 + around), F.lit(accuracy)).alias("_high"))
    # neighbours of the bracket: the median may be the mean of two middle values
    placed = df.where(F.col(value).isNotNull()).join(small_side(bounds), list(keys))
    outer = placed.groupBy(*keys).agg(
        F.max(F.when(F.col(value) < F.col("_low"), F.col(value))).alias("_below"),
        F.min(F.when(F.col(value) > F.col("_high"), F.col(value))).alias("_above"))
    near = placed.join(small_side(outer), list(keys)).withColumn(
        "_v", F.when(F.col(value) < F.col("_low"), F.col("_below")).when(F.col(value) > F.col("_high"), F.col("_above")).otherwise(F.col(value)))
    grouped = near.groupBy(*keys, "_v", "_n").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    low_rank, high_rank = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return grouped.withColumn("_upto", upto).groupBy(*keys).agg(
        ((F.min(F.when(F.col("_upto") >= low_rank, F.col("_v"))) + F.min(F.when(F.col("_upto") >= high_rank, F.col("_v")))) / 2.0).alias("median"))


def degradation_context(rows: DataFrame, signals: Sequence[str] = DEGRADATION, target: str = TARGET,
                        low_is_bad: Sequence[str] = ADVERSE_WHEN_LOW) -> DataFrame:
    """Signals that drift the harmful way while the target falls: correlation, first against last fifth, score."""
    long = rows.where(F.col(target).isNotNull()).select("asset_id", "us", F.col(target).alias("_y"), long_rows(list(signals))).where(F.col("value").isNotNull())
    keys = ["asset_id", "signal"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("std"), F.stddev_pop("_y").alias("_std_y"),
        F.covar_pop("value", "_y").alias("_cov"))
    placed = number_rows(slice_by_time(long, keys), keys, ("us",), total="_total")
    part = F.greatest(F.lit(5), F.floor(F.col("_total") * 0.2))
    side = F.when(F.col("row_idx") <= part, F.when(F.col("row_idx") > F.col("_total") - part, F.array(F.lit("head"), F.lit("tail")))
                  .otherwise(F.array(F.lit("head")))).when(F.col("row_idx") > F.col("_total") - part, F.array(F.lit("tail")))
    ends = placed.withColumn("part", F.explode(side)).select(*keys, "part", "value")
    medians = exact_median(ends, [*keys, "part"], "value").groupBy(*keys).agg(
        F.max(F.when(F.col("part") == "head", F.col("median"))).alias("first"),
        F.max(F.when(F.col("part") == "tail", F.col("median"))).alias("last"))
    usable = stats.where((F.col("n") >= MIN_MODEL_POINTS) & (F.col("std") > X.CONSTANT_STD) & (F.col("_std_y") > X.CONSTANT_STD))
    drift = F.col("last") - F.col("first")
    correlation = F.col("_cov") / (F.col("std") * F.col("_std_y"))
    trend = F.least(F.lit(1.0), F.abs(drift) / F.greatest(F.col("std") * 2.0, F.lit(1e-9)))
    low = F.col("signal").isin(list(low_is_bad))
    adverse = F.when(low, (drift < 0) & (correlation >= 0.35)).otherwise((drift > 0) & (correlation <= -0.35))
    return usable.join(medians, keys).select(
        *keys, "n", correlation.alias("correlation"), drift.alias("drift"), trend.alias("trend"), adverse.alias("adverse"),
        F.when(adverse, F.least(F.lit(0.95), F.abs(correlation) * F.greatest(F.lit(0.35), trend))).otherwise(F.lit(0.0)).alias("score"))


def degradation_strength(context: DataFrame) -> DataFrame:
    """Strength from the two best scores and the names of the five best, per asset (at most one row per signal)."""
    ranked = context.where("adverse").withColumn(
        "_place", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("score").desc(), "signal")))
    best = lambda n: F.coalesce(F.max(F.when(F.col("_place") == n, F.col("score"))), F.lit(0.0))
    return ranked.groupBy("asset_id").agg(
        F.round(F.least(F.lit(0.95), best(1) * 0.72 + best(2) * 0.28), 4).alias("strength"),
        F.array_sort(F.collect_list(F.when(F.col("_place") <= 5, F.struct("_place", "signal")))).alias("_names"),
    ).withColumn("variables", F.transform("_names", lambda x: x["signal"])).drop("_names")


def classification_evidence(counts: DataFrame, models: DataFrame, items: DataFrame, flags: DataFrame, strength: DataFrame,
                            latest: DataFrame) -> DataFrame:
    """One row per asset with everything the decision list reads."""
    pivot = models.groupBy("asset_id").agg(
        F.max(F.when(F.col("model") == "direct", F.col("r2"))).alias("r2_direct"),
        F.max(F.when(F.col("model") == "loss", F.col("r2"))).alias("r2_loss"),
        F.max(F.when(F.col("model") == "direct", F.col("sign_issue"))).alias("sign_issue"))

    def share(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("influence"))), F.lit(0.0))

    direct, loss = F.col("model") == "direct", F.col("model") == "loss"
    shares = items.groupBy("asset_id").agg(
        share(direct & F.col("variable").isin(PROCESS)).alias("process_share"),
        share(direct & F.col("variable").isin(CONTROL)).alias("control_share"),
        share(loss & (F.col("sign") == "negativo")).alias("negative_share"),
        F.count_if(direct).alias("direct_items"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct((-F.col("influence")).alias("w"), F.col("model").alias("m"),
                                                                         F.col("place").alias("p"), F.col("variable").alias("v"))))).alias("_top"))
    serious = flags.groupBy("asset_id").agg(F.count_if(F.col("code").isin(SERIOUS_FLAGS)).alias("serious"))
    joined = counts.select("asset_id", F.col("valid_rows").alias("n"))
    for part in (pivot, shares, serious, strength, latest.select("asset_id", "delta")):
        joined = joined.join(part, "asset_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "asset_id", "n", *[F.coalesce(c, zero).alias(c) for c in (
            "r2_direct", "r2_loss", "sign_issue", "process_share", "control_share", "negative_share", "strength")],
        F.coalesce("direct_items", F.lit(0)).alias("direct_items"), F.coalesce("serious", F.lit(0)).alias("serious"), "delta",
        F.array_distinct(F.concat(
            F.coalesce(F.transform("_top", lambda x: x["v"]), F.array().cast("array<string>")),
            F.coalesce("variables", F.array().cast("array<string>")))).alias("variables"))


def classify_origin(evidence: DataFrame) -> DataFrame:
    """The decision list: first matching case names the class; fit strength and sample size give the confidence."""
    c = F.col
    trust = F.greatest(F.lit(0.15), 1.0 - c("sign_issue"))
    direct = (c("r2_direct") >= 0.30) & (c("direct_items") > 0) & (trust >= 0.35)
    falling = c("delta").isNull() | (c("delta") <= 0)
    internal = (((c("r2_loss") >= 0.30) & (c("negative_share") >= 0.35)) | (c("strength") >= 0.55)) & falling
    direct_strength = c("r2_direct") * F.greatest(c("process_share") + c("control_share"), F.lit(0.1)) * trust
    internal_strength = F.greatest(c("r2_loss") * F.greatest(c("negative_share"), F.lit(0.1)), c("strength"))
    d, i = F.col("_ds"), F.col("_is")
    both = F.col("_direct") & F.col("_internal")
    by_control = F.when(c("control_share") > c("process_share") * 1.15, "control").otherwise("process")
    case = (
        F.when((c("n") < MIN_ANALYSIS_POINTS) | (c("serious") >= 2), "serious")
        .when(both & ((i > d * 1.45) | ((c("sign_issue") >= 0.45) & (i >= 0.65))), "internal_over_direct")
        .when(both & (c("r2_loss") >= 0.30) & (c("negative_share") >= 0.50), "mixed_residual")
        .when(both & (d > i * 1.75), by_control)
        .when(both, "mixed")
        .when(F.col("_internal"), "internal_only")
        .when(F.col("_direct"), by_control)
        .otherwise("weak")
    )
    fit = (
        F.when(c("case") == "internal_over_direct", F.greatest(c("r2_loss"), i))
        .when(c("case").isin("mixed_residual", "mixed"), F.greatest(c("r2_direct"), c("r2_loss")))
        .when(c("case") == "internal_only", c("r2_loss")).otherwise(c("r2_direct"))
    )
    computed = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.lit(0.32) + fit * 0.48 + F.least(F.lit(1.0), c("n") / 120.0) * 0.20)), 3)
    text = lambda part: F.coalesce(*[F.when(c("case") == name, F.lit(values[part])) for name, values in CLASS_TEXTS.items()])
    return (
        evidence.withColumns({"_direct": direct, "_internal": internal, "_ds": direct_strength, "_is": internal_strength})
        .withColumn("case", case)
        .select(
            "asset_id", "n", "case", text(0).alias("classification"),
            F.when(c("case") == "serious", 0.25).when(c("case") == "weak", 0.35).otherwise(computed).alias("confidence"),
            text(1).alias("explanation"), text(2).alias("recommendation"),
            F.when(c("case") == "serious", F.array().cast("array<string>")).when(c("case") == "weak", F.slice("variables", 1, 3))
            .otherwise(F.slice("variables", 1, 5)).alias("variables"))
    )


def model_quality(models: DataFrame, errors: DataFrame) -> DataFrame:
    """r2, error, points, used and removed features, and a word for the fit."""
    mae = F.when(F.col("model") == "direct", F.col("direct_mae")).otherwise(F.col("loss_mae"))
    word = (F.when(F.col("r2") >= 0.75, "forte").when(F.col("r2") >= 0.45, "moderada").when(F.col("r2") >= 0.20, "baixa")
            .when(F.col("r2").isNotNull(), "muito baixa"))
    return models.join(errors, "asset_id", "left").select(
        "asset_id", "model", F.round("r2", 4).alias("r2"), F.when(F.col("intercept").isNotNull(), F.round(mae, 3)).alias("mae"),
        F.col("n").alias("points"), "features", "removed", "notes", word.alias("fit"))


def low_confidence_reasons(models: DataFrame, flags: DataFrame) -> DataFrame:
    """Why a reading of the analysis is weak: poor fits and the first two flags that are not just information."""
    poor = models.groupBy("asset_id").agg(
        F.max(F.when((F.col("model") == "direct") & (F.col("r2") < 0.2), F.lit(WEAK_DIRECT))).alias("_a"),
        F.max(F.when((F.col("model") == "loss") & (F.col("r2") < 0.2), F.lit(WEAK_LOSS))).alias("_b"))
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("ordinal"))
    told = flags.where(F.col("severity") != "info").withColumn("_p", place).where(F.col("_p") <= 2).groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("_p", F.lower("message").alias("m")))).alias("_t"))
    return poor.join(told, "asset_id", "left").select("asset_id", F.array_join(F.array_distinct(F.concat(
        F.array_compact(F.array("_a", "_b")), F.coalesce(F.transform("_t", lambda x: x["m"]), F.array().cast("array<string>")))), "; ").alias("reasons"))


def summary_sentence(classified: DataFrame, items: DataFrame) -> DataFrame:
    """One sentence per asset: its class, and the first variables of the models that matter for it."""
    top = items.where(F.col("place") == 1).groupBy("asset_id").agg(
        F.max(F.when(F.col("model") == "direct", F.col("label"))).alias("_d"),
        F.max(F.when(F.col("model") == "loss", F.col("label"))).alias("_i"))
    def told(part: str | tuple[str, str]) -> Column:
        return F.lit(part) if isinstance(part, str) else F.coalesce(F.col("_d" if part[0] == "direct" else "_i"), F.lit(part[1]))

    cases = [F.when(F.col("classification") == kind, F.concat(*map(told, parts))) for kind, parts in SUMMARY_PARTS.items()]
    sentence = F.coalesce(*cases, F.lit(SUMMARY_OTHERWISE))
    return classified.join(top, "asset_id", "left").select("asset_id", sentence.alias("summary"))


def operational_context(rows: DataFrame) -> DataFrame:
    """State of the last analysed reading as JSON."""
    columns = ["us", "mode_key", "st_oper", "st_carga_oper", "pv_corr_motor_a", "qa_m3h"]
    last = rows.groupBy("asset_id").agg(F.max_by(F.struct(*[c for c in columns if c in rows.columns]), "us").alias("_l"))
    present = [c for c in ("pv_corr_motor_a", "qa_m3h") if c in rows.columns]
    return last.select("asset_id", F.to_json(F.struct(
        F.timestamp_micros("_l.us").cast("timestamp_ntz").alias("timestamp"), "_l.mode_key", "_l.st_oper", "_l.st_carga_oper",
        *[F.round(f"_l.{c}", 3).alias(c) for c in present], F.lit(CURRENT_NOTE).alias("observacao_corrente"))).alias("context"))


def analyse(readings: DataFrame, store=None, raw_times: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole analysis per asset. ``store`` may materialise the model table, which several results read."""
    flags = quality_flags(readings, raw_times=raw_times)
    if TARGET not in readings.columns:
        readings = readings.withColumn(TARGET, F.lit(None).cast("double"))
    rows = analysis_rows(readings)
    columns = [c for c in (TARGET, *DIRECT, *DEGRADATION) if c in readings.columns]
    models = fit_models(sufficient_statistics(rows, columns), columns)
    models = store(models) if store else models
    direct = [c for c in DIRECT if c in columns]
    loss = [c for c in DEGRADATION if c in columns]
    latest = score_rows(rows.groupBy("asset_id").agg(F.max_by(F.struct("us", TARGET, *direct), "us").alias("_l")).select("asset_id", "_l.*"),
                        models, direct)
    items, counts = influence_items(models), window_counts(readings)
    strength = degradation_strength(degradation_context(rows, loss))
    evidence = classification_evidence(counts, models, items, flags, strength, latest)
    origin = classify_origin(evidence)
    return {
        "counts": counts, "flags": flags, "models": models, "items": items, "latest": latest, "strength": strength,
        "evidence": evidence, "origin": origin, "window": target_summary(rows),
        "quality": model_quality(models, model_errors(rows, models, direct, loss)),
        "summary": summary_sentence(origin, items), "reasons": low_confidence_reasons(models, flags),
        "context": operational_context(rows),
    }
