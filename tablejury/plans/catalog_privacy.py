"""Queries over formal privacy measures."""

from pyspark.sql import functions as F

from tablejury.operators import metrics as M, privacy as R
from tablejury.plans import formal, views as V
from tablejury.plans.catalog_trials import _A9, AP, T, approved, rounded
from tablejury.plans.registry import query

FEATURES = ["acctbal", "nation"]
SCALE = """sc AS (SELECT avg(acctbal) AS ma, stddev_pop(acctbal) AS sa, avg(nation) AS mn, stddev_pop(nation) AS sn FROM micro WHERE source = 'real'),
 z AS (SELECT source, row_id, (acctbal - ma)/sa AS a, (nation - mn)/sn AS b FROM micro, sc)"""
Z = V.with_ctes(V.MICRO, SCALE)
EUCLID = """dist AS (SELECT s.source, s.row_id, min(sqrt(pow(s.a - r.a, 2) + pow(s.b - r.b, 2))) AS d FROM z s, (SELECT a, b FROM z WHERE source = 'real') r WHERE s.source <> 'real' GROUP BY 1, 2)"""
MAHAL = """cv AS (SELECT var_samp(a) AS xx, var_samp(b) AS yy, covar_samp(a, b) AS xy FROM z WHERE source = 'real'),
 dist AS (SELECT s.source, s.row_id, min(sqrt((pow(s.a - r.a, 2)*yy - 2*(s.a - r.a)*(s.b - r.b)*xy + pow(s.b - r.b, 2)*xx)/(xx*yy - xy*xy))) AS d
 FROM z s, (SELECT a, b FROM z WHERE source = 'real') r, cv WHERE s.source <> 'real' GROUP BY 1, 2)"""
SUMMARY = """, th AS (SELECT source, avg(d) + stddev_pop(d) AS t FROM dist GROUP BY 1)
 SELECT source, '{metric}' AS metric, count(*) AS n_records, round(avg(d), 6) AS mean_distance, round(stddev_pop(d), 6) AS std_distance, round(min(d), 6) AS min_distance,
 round(max(d), 6) AS max_distance, round(median(d), 6) AS median_distance, round(max(t), 6) AS threshold, round(avg((d < t)::INT), 6) AS linkage_success_rate
 FROM dist JOIN th USING (source) GROUP BY 1"""


@query("f8_standardise", Z + "SELECT source, row_id, round(a, 6) AS acctbal, round(b, 6) AS nation FROM z")
def _(spark, sf):
    micro = V.micro(spark, sf).drop("segment")
    return rounded(R.standardise(micro, FEATURES, R.real_scale(micro, FEATURES)))


@query("j12_nearest_real", V.with_ctes(V.MICRO, SCALE, EUCLID) + "SELECT source, row_id, round(d, 6) AS distance FROM dist")
def _(spark, sf):
    return rounded(R.linkage_distances(V.micro(spark, sf), FEATURES, keep=["row_id"]))


@query("a37_linkage_summary", V.with_ctes(V.MICRO, SCALE, EUCLID) + SUMMARY.format(metric="euclidean"))
def _(spark, sf):
    distances = R.linkage_distances(V.micro(spark, sf), FEATURES, keep=["row_id"]).withColumn("n", F.lit(1).cast("bigint"))
    return rounded(R.linkage_summary(distances).withColumn("metric", F.lit("euclidean")))


@query("g1_linkage_euclidean", V.with_ctes(V.MICRO, SCALE, EUCLID) + SUMMARY.format(metric="euclidean"))
def _(spark, sf):
    return rounded(R.record_linkage(V.micro(spark, sf), FEATURES))


@query("g2_linkage_mahalanobis", V.with_ctes(V.MICRO, SCALE, MAHAL) + SUMMARY.format(metric="mahalanobis"))
def _(spark, sf):
    return rounded(R.record_linkage(V.micro(spark, sf), FEATURES, "mahalanobis"))


_WIDE_SCALE = "wsc AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in V.WIDE) + " FROM wide WHERE source = 'real'),\n filled AS (SELECT source, row_id, " + ", ".join(
    f"coalesce({c}, m_{c}) - m_{c} AS {c}" for c in V.WIDE) + " FROM wide, wsc),\n wsd AS (SELECT " + ", ".join(
    f"coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in V.WIDE) + " FROM filled WHERE source = 'real'),\n wz AS (SELECT source, row_id, " + ", ".join(
    f"{c} / s_{c} AS {c}" for c in V.WIDE) + " FROM filled, wsd)"
_WIDE_DIST = "dist AS (SELECT s.source, s.row_id, sqrt(min(" + " + ".join(f"(s.{c} - r.{c}) * (s.{c} - r.{c})" for c in V.WIDE) + """)) AS d
 FROM wz s, (SELECT * FROM wz WHERE source = 'real') r WHERE s.source <> 'real' GROUP BY 1, 2)"""


@query("g1_linkage_all_columns", V.with_ctes(V.WIDE_SQL, _WIDE_SCALE, _WIDE_DIST) + SUMMARY.format(metric="euclidean"))
def _(spark, sf):
    return rounded(R.record_linkage(V.wide(spark, sf), V.WIDE))


@query("u6_labelled_union", V.with_ctes(V.MICRO) + """SELECT m AS method, CAST(label AS INT) AS label, count(*) AS n, round(sum(acctbal), 4) AS total FROM (
 SELECT m, 1 AS label, acctbal FROM micro, (SELECT unnest(['ctgan','tvae','gaussian_copula']) AS m) ms WHERE source = 'real'
 UNION ALL SELECT source, 0, acctbal FROM micro WHERE source <> 'real') u GROUP BY 1, 2""")
def _(spark, sf):
    union = R.labelled_union(V.micro(spark, sf), FEATURES)
    return union.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 4).alias("total"))


_SAMPLE = """u AS (SELECT m AS method, 1 AS label, row_id FROM micro, (SELECT unnest(['ctgan','tvae','gaussian_copula']) AS m) ms WHERE source = 'real'
 UNION ALL SELECT source, 0, row_id FROM micro WHERE source <> 'real'),
 q AS (SELECT method, least(min(n), 5000) AS k FROM (SELECT method, label, count(*) AS n FROM u GROUP BY 1, 2) c GROUP BY 1),
 drawn AS (SELECT * FROM (SELECT u.*, k, row_number() OVER (PARTITION BY u.method, label ORDER BY md5(concat_ws('|', '42', CAST(label AS VARCHAR), CAST(row_id AS VARCHAR))), row_id) AS rn
 FROM u JOIN q USING (method)) r WHERE rn <= k)"""


@query("g3_attack_sample", V.with_ctes(V.MICRO, _SAMPLE) + """SELECT method, CAST(label AS INT) AS label, row_id, row_number() OVER (PARTITION BY method ORDER BY md5(concat_ws('|', '43', CAST(label AS VARCHAR), CAST(row_id AS VARCHAR))), label, row_id)
 <= floor(k * 2 * 0.7::DOUBLE) AS is_train FROM drawn""")
def _(spark, sf):
    return R.attack_sample(V.micro(spark, sf), FEATURES, ["row_id"]).select("method", "label", "row_id", "is_train")


def _attack(cap=True, steps=12):
    """(tables, SELECT) of the attack in SQL on two features: Newton steps of a ridge logistic fit, each a table (w0, w1, ..), solved by Cramer's rule."""
    parts = [_SAMPLE if cap else _SAMPLE.replace("least(min(n), 5000)", "min(n)"), """flagged AS (SELECT d.method, label AS y, row_number() OVER (PARTITION BY d.method ORDER BY
 md5(concat_ws('|', '43', CAST(label AS VARCHAR), CAST(d.row_id AS VARCHAR))), label, d.row_id) <= floor(k * 2 * 0.7::DOUBLE) AS is_train, m.acctbal AS a0, m.nation AS b0
 FROM drawn d JOIN micro m ON m.row_id = d.row_id AND m.source = CASE label WHEN 1 THEN 'real' ELSE d.method END)""",
             """sc3 AS (SELECT method, avg(a0) AS ma, stddev_pop(a0) AS sa, avg(b0) AS mb, stddev_pop(b0) AS sb FROM flagged WHERE is_train GROUP BY 1)""",
             """x AS MATERIALIZED (SELECT method, y, is_train, (a0 - ma)/sa AS a, (b0 - mb)/sb AS b FROM flagged JOIN sc3 USING (method))""",
             "w0 AS (SELECT DISTINCT method, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w FROM x)"]
    for k in range(steps):
        parts += [f"""s{k} AS MATERIALIZED (SELECT method, any_value(u) AS u, any_value(v) AS v, any_value(w) AS w, sum(p - y) AS g0, sum((p - y)*a) + any_value(v) AS g1, sum((p - y)*b) + any_value(w) AS g2,
 sum(p*(1-p)) AS h00, sum(p*(1-p)*a) AS h01, sum(p*(1-p)*b) AS h02, sum(p*(1-p)*a*a) + 1 AS h11, sum(p*(1-p)*a*b) AS h12, sum(p*(1-p)*b*b) + 1 AS h22
 FROM (SELECT *, 1/(1 + exp(-(u + v*a + w*b))) AS p FROM x JOIN w{k} USING (method) WHERE is_train) t GROUP BY 1)""",
                  f"""w{k + 1} AS MATERIALIZED (SELECT method, u - (g0*(h11*h22 - h12*h12) - h01*(g1*h22 - h12*g2) + h02*(g1*h12 - h11*g2))/d AS u,
 v - (h00*(g1*h22 - h12*g2) - g0*(h01*h22 - h12*h02) + h02*(h01*g2 - g1*h02))/d AS v, w - (h00*(h11*g2 - g1*h12) - h01*(h01*g2 - g1*h02) + g0*(h01*h12 - h11*h02))/d AS w
 FROM (SELECT *, h00*(h11*h22 - h12*h12) - h01*(h01*h22 - h12*h02) + h02*(h01*h12 - h11*h02) AS d FROM s{k}) t)"""]
    parts += [f"z3 AS (SELECT method, y, u + v*a + w*b AS z, (u + v*a + w*b > 0)::INT AS said FROM x JOIN w{steps} USING (method) WHERE NOT is_train)",
              "r3 AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY z) + (count(*) OVER (PARTITION BY method, z) - 1)/2.0 AS rk FROM z3)"]
    right = "(said = y)::INT"
    real, made = (f"coalesce(avg({right}) FILTER (y = {k}), 0)" for k in (1, 0))
    return parts, f"""SELECT method, round(avg({right}), 6) AS overall_accuracy, round({real}, 6) AS accuracy_on_real, round({made}, 6) AS accuracy_on_synthetic,
 round(({real} + {made})/2, 6) AS mia_discrimination, count(*) AS n_test, any_value(n_train) AS n_train, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1)*(count(*) FILTER (y = 1) + 1)/2.0)
 /(count(*) FILTER (y = 1)*1.0*count(*) FILTER (y = 0)), 6) AS auc FROM r3 JOIN (SELECT method, count(*) FILTER (is_train) AS n_train FROM x GROUP BY 1) n USING (method) GROUP BY 1"""


def _attack_sql(cap):
    parts, select = _attack(cap)
    return V.with_ctes(V.MICRO, *parts) + select


@query("g3_membership_inference", _attack_sql(True))
def _(spark, sf):
    return rounded(R.membership_inference(V.micro(spark, sf), FEATURES, ["row_id"]))


@query("g3_membership_inference_uncapped", _attack_sql(False))
def _(spark, sf):
    return rounded(R.membership_inference(V.micro(spark, sf), FEATURES, ["row_id"], cap=None))


@query("g4_exact_auc", T + """, r AS (SELECT provider, correct, rank() OVER (PARTITION BY provider ORDER BY confidence) + (count(*) OVER (PARTITION BY provider, confidence) - 1)/2.0 AS rk FROM trials)
 SELECT provider, count(*) FILTER (correct) AS n_pos, count(*) FILTER (NOT correct) AS n_neg, round((sum(rk) FILTER (correct) - count(*) FILTER (correct)*(count(*) FILTER (correct) + 1)/2.0)
 /(count(*) FILTER (correct)*1.0*count(*) FILTER (NOT correct)), 6) AS auc FROM r GROUP BY 1""")
def _(spark, sf):
    t = V.trials(spark, sf).withColumn("label", F.col("correct").cast("int"))
    return rounded(R.exact_auc(t, "confidence", "label", ["provider"]))


@query("j5_formal_with_drs", AP + """, named AS (SELECT CASE synthetic_method WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' ELSE 'GaussianCopula' END AS method, avg(confidence) AS mia_discrimination, avg(correct::INT) AS linkage_success_rate FROM trials GROUP BY 1),
 drs AS (SELECT CASE method WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' ELSE 'GaussianCopula' END AS method, avg(d) AS mean_drs FROM (SELECT method, condition,
 least(100.0*avg(correct::INT) FILTER (true_label='REAL'), 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) AS d FROM approved GROUP BY 1, 2) g GROUP BY 1)
 SELECT method, round(mia_discrimination, 6) AS mia_discrimination, round(linkage_success_rate, 6) AS linkage_success_rate, round(mean_drs, 6) AS mean_drs FROM named JOIN drs USING (method)""")
def _(spark, sf):
    measures = V.trials(spark, sf).groupBy(formal.formal_name("synthetic_method").alias("method")).agg(
        F.avg("confidence").alias("mia_discrimination"), F.avg(F.col("correct").cast("int")).alias("linkage_success_rate"))
    drs = M.mean_drs(M.cell_metrics(approved(spark, sf), ["method", "condition"]))
    return rounded(formal.with_method_drs(measures, drs))


@query("a38_measure_correlation", """WITH m AS (SELECT user_id, CASE WHEN user_id % 9 <> 0 THEN avg((event_type = 'click')::INT) END AS llm_avg, avg(value) AS mia, stddev_pop(value) AS linkage FROM events GROUP BY 1)
 SELECT count(*) AS n_methods, round(covar_samp(llm_avg, mia)/(stddev_samp(llm_avg)*stddev_samp(mia)), 6) AS corr_llm_mia,
 round(covar_samp(llm_avg, linkage)/(stddev_samp(llm_avg)*stddev_samp(linkage)), 6) AS corr_llm_linkage FROM m WHERE llm_avg IS NOT NULL""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    measures = e.groupBy("user_id").agg(
        F.when(F.col("user_id") % 9 != 0, F.avg((F.col("event_type") == "click").cast("int"))).alias("llm_avg"),
        F.avg("value").alias("mia_discrimination"), F.stddev_pop("value").alias("linkage_success_rate"))
    return rounded(formal.measure_correlations(measures))


def _formal_sql(columns):
    """Linkage, attack and judge scores of every method; a method's mean score needs both conditions and no zero."""
    parts, attack = _attack()
    th, linkage = SUMMARY.format(metric="euclidean").lstrip(", ").split("\n SELECT", 1)
    return V.with_ctes(V.TRIALS, V.MICRO, SCALE, EUCLID, th, f"link AS (SELECT {linkage})", *parts, f"att AS ({attack})", _A9.strip(),
                       """judge AS (SELECT m AS name, max(d) FILTER (c = 'C1') AS c1, max(d) FILTER (c = 'C2') AS c2 FROM (SELECT m, c, (rc*1.0/(trials//2) + sc*1.0/(trials - trials//2))/2 AS d FROM counted) s GROUP BY 1)""",
                       """formal AS (SELECT CASE source WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' WHEN 'gaussian_copula' THEN 'GaussianCopula' ELSE source END AS method, l.* EXCLUDE (source), att.* EXCLUDE (method),
 round(c1, 6) AS llm_c1, round(c2, 6) AS llm_c2, round(CASE WHEN c1 <> 0 AND c2 <> 0 THEN (c1 + c2)/2 END, 6) AS llm_avg
 FROM link l JOIN att ON att.method = l.source LEFT JOIN judge ON name = CASE source WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' WHEN 'gaussian_copula' THEN 'GaussianCopula' END)""") \
        + f"SELECT {columns} FROM formal"


@query("g5_formal_measures", _formal_sql("*"))
def _(spark, sf):
    return rounded(formal.formal_measures(V.micro(spark, sf), FEATURES, ["row_id"], V.trials(spark, sf)))


@query("g5_correlation_table", _formal_sql("method, nullif(llm_c1, 0) AS llm_c1, nullif(llm_c2, 0) AS llm_c2, nullif(llm_avg, 0) AS llm_avg, mia_discrimination, linkage_success_rate"))
def _(spark, sf):
    measures = formal.formal_measures(V.micro(spark, sf), FEATURES, ["row_id"], V.trials(spark, sf))
    return rounded(formal.correlation_table(measures))
