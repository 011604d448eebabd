"""Queries over human annotations and over the comparison of judges and people."""

from pyspark.sql import functions as F

from tablejury.operators import agreement as A, inference as I, metrics as M
from tablejury.plans import views as V
from tablejury.plans.catalog_trials import MODEL_COLUMNS, approved, rounded
from tablejury.plans.registry import query

D = V.with_ctes(V.ANNOTATIONS, V.DEDUPED)

SHEET = """count(*) AS n, count(*) FILTER (true_label='REAL') AS n_real, count(*) FILTER (true_label='SYNTHETIC') AS n_syn,
 round_even(100.0*avg(correct::INT) FILTER (true_label='REAL'), 1) AS p_real,
 round_even(100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC'), 1) AS p_syn,
 round_even(CASE WHEN count(*) FILTER (true_label='REAL') > 0 AND count(*) FILTER (true_label='SYNTHETIC') > 0 THEN
  least(100.0*avg(correct::INT) FILTER (true_label='REAL'), 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) END, 1) AS drs,
 round_even(100.0*avg(correct::INT), 1) AS acc, round_even(avg(confidence), 1) AS conf"""


def _drs_sql(condition):
    return f"""round_even(CASE WHEN count(*) FILTER (true_label='REAL' AND {condition}) > 0 AND count(*) FILTER (true_label='SYNTHETIC' AND {condition}) > 0 THEN
 least(100.0*avg(correct::INT) FILTER (true_label='REAL' AND {condition}), 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC' AND {condition})) END, 1)"""


def human(spark, sf):
    return A.dedupe_annotations(V.annotations(spark, sf))


def named(spark, sf):
    return A.with_aliases(human(spark, sf))


@query("w1_dedupe_annotations", D + """SELECT session_id, dataset, method, pair_id, condition, annotator_id, true_label,
 predicted_label, confidence, source_path, correct FROM deduped""")
def _(spark, sf):
    return human(spark, sf).drop("notes")


@query("w2_annotator_aliases", D + "SELECT DISTINCT annotator_id, annotator FROM deduped")
def _(spark, sf):
    return A.annotator_aliases(human(spark, sf))


@query("a8_annotator_scores", D + f"SELECT annotator, dataset, method, condition, {SHEET} FROM deduped GROUP BY ALL")
def _(spark, sf):
    return A.annotator_scores(named(spark, sf))


@query("a23_session_counts", D + """SELECT annotator, dataset, method, count(DISTINCT session_id) AS n_sessions
 FROM deduped GROUP BY ALL""")
def _(spark, sf):
    return A.session_counts(named(spark, sf))


_POOLED = f"""pooled AS (SELECT dataset, method, condition, {SHEET},
 {_drs_sql("annotator='HA1'")} AS drs_ha1, {_drs_sql("annotator='HA2'")} AS drs_ha2,
 abs({_drs_sql("annotator='HA1'")} - {_drs_sql("annotator='HA2'")}) AS drs_diff FROM deduped GROUP BY 1, 2, 3)"""
P = V.with_ctes(V.ANNOTATIONS, V.DEDUPED, _POOLED)
CELLS = f"cells AS (SELECT dataset, provider_label, method, condition, {V.METRICS} FROM approved GROUP BY ALL)"
JOINED = """joined AS (SELECT p.*, coalesce(g.n, 0) AS groq_n, coalesce(k.n, 0) AS google_n,
 least(coalesce(g.n, 0), coalesce(k.n, 0)) >= 8 AS fair_cell,
 CASE WHEN least(coalesce(g.n, 0), coalesce(k.n, 0)) >= 8 THEN g.drs END AS groq_drs,
 CASE WHEN least(coalesce(g.n, 0), coalesce(k.n, 0)) >= 8 THEN k.drs END AS google_drs FROM pooled p
 LEFT JOIN (SELECT * FROM cells WHERE provider_label LIKE 'Groq%') g USING (dataset, method, condition)
 LEFT JOIN (SELECT * FROM cells WHERE provider_label LIKE 'Google%') k USING (dataset, method, condition))"""
J = V.with_ctes(V.TRIALS, V.APPROVED, V.ANNOTATIONS, V.DEDUPED, _POOLED, CELLS, JOINED)
MODELS = {"groq": MODEL_COLUMNS["groq_n"], "google": MODEL_COLUMNS["google_n"]}
NUMERIC = "round(drs_diff, 6) AS drs_diff"


def pooled(spark, sf):
    return A.pooled_with_annotators(named(spark, sf))


def joined(spark, sf):
    return A.with_judges(pooled(spark, sf), rounded(M.cell_metrics(approved(spark, sf))), MODELS)


@query("a44_pooled_with_annotators", P + f"SELECT * REPLACE ({NUMERIC}) FROM pooled")
def _(spark, sf):
    return rounded(pooled(spark, sf))


@query("a44_mean_annotator_gap", P + "SELECT round(avg(drs_diff), 6) AS mean_drs_diff, count(drs_diff) AS n_cells FROM pooled")
def _(spark, sf):
    return rounded(A.mean_annotator_gap(pooled(spark, sf)))


@query("a45_score_by_condition", V.with_ctes(V.ANNOTATIONS) + """SELECT condition, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS total,
 round(100.0*avg(correct::INT), 1) AS accuracy FROM annotations GROUP BY 1""")
def _(spark, sf):
    return A.score_sheet(V.annotations(spark, sf), "condition")


@query("a45_score_by_label", V.with_ctes(V.ANNOTATIONS) + """SELECT true_label, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS total,
 round(100.0*avg(correct::INT), 1) AS accuracy FROM annotations GROUP BY 1""")
def _(spark, sf):
    return A.score_sheet(V.annotations(spark, sf), "true_label")


@query("a49_pooled_rollup", D + f"""SELECT CASE WHEN grouping(annotator) = 1 THEN 'Pooled' ELSE annotator END AS annotator, {SHEET}
 FROM deduped GROUP BY ROLLUP (annotator)""")
def _(spark, sf):
    return A.pooled_scores(named(spark, sf))


@query("j2_human_with_judges", J + f"SELECT * REPLACE ({NUMERIC}) FROM joined")
def _(spark, sf):
    return rounded(joined(spark, sf))


@query("j13_condition_delta", D + f"""SELECT annotator, dataset, method, {_drs_sql("condition='C1'")} AS drs_c1, {_drs_sql("condition='C2'")} AS drs_c2,
 round({_drs_sql("condition='C2'")} - {_drs_sql("condition='C1'")}, 1) AS delta FROM deduped GROUP BY 1, 2, 3
 HAVING count(*) FILTER (condition='C1') > 0 AND count(*) FILTER (condition='C2') > 0""")
def _(spark, sf):
    return A.condition_delta(named(spark, sf))


@query("k7_first_notes", D + """SELECT annotator, notes, pair_id, CAST(position AS INT) AS position FROM (SELECT *,
 row_number() OVER (PARTITION BY annotator ORDER BY source_path, pair_id, condition) AS position FROM deduped
 WHERE trim(notes) <> '') k WHERE position <= 10""")
def _(spark, sf):
    return A.notes_digest(named(spark, sf)).select("annotator", "notes", "pair_id", "position")


_LONG = """long AS (SELECT dataset, method, condition, drs AS human_drs, 'groq' AS model, groq_drs AS llm_drs FROM joined WHERE groq_drs IS NOT NULL
 UNION ALL SELECT dataset, method, condition, drs, 'google', google_drs FROM joined WHERE google_drs IS NOT NULL)"""
L = V.with_ctes(V.TRIALS, V.APPROVED, V.ANNOTATIONS, V.DEDUPED, _POOLED, CELLS, JOINED, _LONG)


def long(spark, sf):
    return A.human_vs_judge_long(joined(spark, sf), ["groq", "google"])


@query("u5_wide_to_long", L + "SELECT * FROM long")
def _(spark, sf):
    return long(spark, sf)


_RANKED = """, scoped AS (SELECT 'overall' AS scope, human_drs AS x, llm_drs AS y FROM long UNION ALL SELECT model, human_drs, llm_drs FROM long),
 ranked AS (SELECT scope, rank() OVER (PARTITION BY scope ORDER BY x) + (count(*) OVER (PARTITION BY scope, x) - 1)/2.0 AS rx,
 rank() OVER (PARTITION BY scope ORDER BY y) + (count(*) OVER (PARTITION BY scope, y) - 1)/2.0 AS ry FROM scoped)
 """


@query("f5_spearman_rho", L + _RANKED + "SELECT scope, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranked GROUP BY 1")
def _(spark, sf):
    return rounded(A.agreement_correlation(long(spark, sf)).drop("p_value"))


# the t-distribution tail by Simpson's rule over the angle atan(t / sqrt(df))
@query("f5_spearman_with_p", L + _RANKED.rstrip() + """, c AS (SELECT scope, count(*) AS n, corr(rx, ry) AS rho, count(*) - 2.0 AS df FROM ranked GROUP BY 1),
 a AS (SELECT *, atan(abs(rho)/sqrt(1 - rho*rho)) AS lo, (pi()/2 - atan(abs(rho)/sqrt(1 - rho*rho)))/2000 AS h FROM c)
 SELECT scope, n, round(rho, 6) AS rho, round(max(2*exp(lgamma((df + 1)/2) - lgamma(df/2))/sqrt(pi()))*sum(h/3*(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)*pow(abs(cos(lo + i*h)), df - 1)), 6) AS p_value
 FROM a, (SELECT unnest(range(2001)) AS i) r GROUP BY scope, n, rho""")
def _(spark, sf):
    return rounded(A.agreement_correlation(long(spark, sf)))


@query("f5_spearman_trial_level", V.with_ctes(V.TRIALS) + """, ranked AS (SELECT provider, rank() OVER (PARTITION BY provider ORDER BY confidence) + (count(*) OVER (PARTITION BY provider, confidence) - 1)/2.0 AS rx,
 rank() OVER (PARTITION BY provider ORDER BY correct::INT) + (count(*) OVER (PARTITION BY provider, correct) - 1)/2.0 AS ry FROM trials)
 SELECT provider, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranked GROUP BY 1""")
def _(spark, sf):
    t = V.trials(spark, sf).withColumn("hit", F.col("correct").cast("int"))
    return rounded(A.spearman(t, "confidence", "hit", ["provider"]).drop("p_value"))


_BA = """count(d) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff,
 round(avg(d) - 1.96*stddev_samp(d), 6) AS loa_low, round(avg(d) + 1.96*stddev_samp(d), 6) AS loa_high"""


@query("f6_bland_altman", L + f"SELECT {_BA} FROM (SELECT llm_drs - human_drs AS d FROM long) x")
def _(spark, sf):
    return rounded(A.bland_altman(long(spark, sf)))


@query("f6_bland_altman_by_model", L + f"SELECT model, {_BA} FROM (SELECT model, llm_drs - human_drs AS d FROM long) x GROUP BY 1")
def _(spark, sf):
    return rounded(A.bland_altman(long(spark, sf), ["model"]))


@query("f6_agreement_points", L + """SELECT dataset, method, condition, model, human_drs, llm_drs,
 round((human_drs + llm_drs)/2.0, 6) AS mean_score, round(llm_drs - human_drs, 6) AS diff FROM long""")
def _(spark, sf):
    points = A.bland_altman_points(long(spark, sf))  # the mean of two scores of six places is often a tie: rounded as SQL does, after scaling
    return rounded(points.withColumn("mean_score", F.round(F.col("mean_score") * 1e6) / 1e6))


# ---- matched samples and tests ---------------------------------------------------------

QUOTA = """quota AS (SELECT dataset, method, condition, min(n) AS n_take FROM (SELECT dataset, method, condition, provider_label, count(*) AS n
 FROM approved GROUP BY ALL) c GROUP BY 1, 2, 3 HAVING count(*) = 2 AND min(n) >= 8)"""
MATCHED = """matched AS (SELECT * EXCLUDE (rn, n_take) FROM (SELECT a.*, q.n_take, row_number() OVER (PARTITION BY a.dataset, a.method, a.condition, provider_label
 ORDER BY md5(concat_ws('|', '2026', a.dataset, a.method, a.condition, provider_label, CAST(trial_id AS VARCHAR))), trial_id) AS rn FROM approved a JOIN quota q USING (dataset, method, condition)) r WHERE rn <= n_take)"""
W3 = V.with_ctes(V.TRIALS, V.APPROVED, QUOTA, MATCHED)


@query("w3_matched_sample", W3 + "SELECT trial_id, dataset, method, condition, provider_label FROM matched")
def _(spark, sf):
    return I.matched_sample(approved(spark, sf), 2026) \
        .select("trial_id", "dataset", "method", "condition", "provider_label")


@query("f1_matched_metrics", W3 + f"SELECT dataset, provider_label, method, condition, {V.METRICS} FROM matched GROUP BY ALL")
def _(spark, sf):
    return rounded(M.cell_metrics(I.matched_sample(approved(spark, sf), 2026)))


@query("f1_matched_check", W3 + """SELECT dataset, method, condition, min(n) AS n_low, max(n) AS n_high, count(*) AS n_models, min(n) = max(n) AS matched_equal_n
 FROM (SELECT dataset, method, condition, provider_label, count(*) AS n FROM matched GROUP BY ALL) c GROUP BY 1, 2, 3""")
def _(spark, sf):
    return I.matched_check(I.matched_sample(approved(spark, sf), 2026))


@query("f2_seed_sweep", V.with_ctes(V.TRIALS, V.APPROVED, QUOTA) + """, drawn AS (SELECT s.seed, a.*, q.n_take, row_number() OVER (
 PARTITION BY a.dataset, a.method, a.condition, provider_label, seed ORDER BY md5(concat_ws('|', CAST(seed AS VARCHAR), a.dataset, a.method, a.condition, provider_label, CAST(trial_id AS VARCHAR))), trial_id) AS rn
 FROM approved a JOIN quota q USING (dataset, method, condition) CROSS JOIN (SELECT unnest(range(1000, 1050)) AS seed) s),
 cell AS (SELECT dataset, provider_label, method, condition, seed, least(100.0*avg(correct::INT) FILTER (true_label='REAL'),
 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) AS drs FROM drawn WHERE rn <= n_take GROUP BY ALL)
 SELECT dataset, provider_label, method, condition, count(drs) AS n_seeds, round(avg(drs), 6) AS drs_mean,
 round(quantile_cont(drs, 0.025), 6) AS q025, round(quantile_cont(drs, 0.975), 6) AS q975 FROM cell GROUP BY ALL""")
def _(spark, sf):
    return rounded(I.seed_sweep(approved(spark, sf)))


_RUNS = """restarted AS (SELECT * REPLACE (trial_id // 7 AS trial_id), 'run-' || (trial_id % 7) AS source_path FROM approved),
 quota AS (SELECT dataset, method, condition, min(n) AS n_take FROM (SELECT dataset, method, condition, provider_label, count(*) AS n
 FROM restarted GROUP BY ALL) c GROUP BY 1, 2, 3 HAVING count(*) = 2 AND min(n) >= 8)"""
_RUN_ROW = "a.dataset, a.method, a.condition, provider_label, source_path, CAST(trial_id AS VARCHAR))), source_path, trial_id"


def restarted(spark, sf):
    """The log as seven result files, in each of which trial numbers start again."""
    return approved(spark, sf).withColumn("source_path", F.concat(F.lit("run-"), F.col("trial_id") % 7)) \
        .withColumn("trial_id", F.floor(F.col("trial_id") / 7))


@query("w3_matched_over_runs", V.with_ctes(V.TRIALS, V.APPROVED, _RUNS) + f"""SELECT source_path, trial_id, dataset, method, condition, provider_label FROM (
 SELECT a.*, n_take, row_number() OVER (PARTITION BY a.dataset, a.method, a.condition, provider_label ORDER BY md5(concat_ws('|', '2026', {_RUN_ROW}) AS rn
 FROM restarted a JOIN quota USING (dataset, method, condition)) r WHERE rn <= n_take""")
def _(spark, sf):
    return I.matched_sample(restarted(spark, sf), 2026) \
        .select("source_path", "trial_id", "dataset", "method", "condition", "provider_label")


@query("f2_seed_sweep_over_runs", V.with_ctes(V.TRIALS, V.APPROVED, _RUNS) + f""", drawn AS (SELECT s.seed, a.*, n_take, row_number() OVER (
 PARTITION BY a.dataset, a.method, a.condition, provider_label, seed ORDER BY md5(concat_ws('|', CAST(seed AS VARCHAR), {_RUN_ROW}) AS rn
 FROM restarted a JOIN quota USING (dataset, method, condition) CROSS JOIN (SELECT unnest(range(1000, 1050)) AS seed) s),
 cell AS (SELECT dataset, provider_label, method, condition, seed, least(100.0*avg(correct::INT) FILTER (true_label='REAL'),
 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) AS drs FROM drawn WHERE rn <= n_take GROUP BY ALL)
 SELECT dataset, provider_label, method, condition, count(drs) AS n_seeds, round(avg(drs), 6) AS drs_mean,
 round(quantile_cont(drs, 0.025), 6) AS q025, round(quantile_cont(drs, 0.975), 6) AS q975 FROM cell GROUP BY ALL""")
def _(spark, sf):
    return rounded(I.seed_sweep(restarted(spark, sf)))


_TAIL = """round(least(1.0, (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n*ln(2.0)))
 FROM (SELECT unnest(range(n_correct, n + 1)) AS i) r)), 8)"""


@query("f3_binomial_test", V.with_ctes(V.TRIALS) + f""", g AS (SELECT provider, condition, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS n_correct FROM trials GROUP BY 1, 2),
 t AS (SELECT *, {_TAIL} AS p_value FROM g) SELECT provider, condition, n, n_correct, round(n_correct*1.0/n, 6) AS accuracy, p_value,
 CASE WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS sig FROM t""")
def _(spark, sf):
    out = I.binomial_table(V.trials(spark, sf), "provider", "condition")
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("p_value", F.round("p_value", 8))


@query("p21_significance_marks", V.with_ctes(V.TRIALS) + f""", g AS (SELECT model, synthetic_method AS method, true_label, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS n_correct FROM trials GROUP BY 1, 2, 3),
 t AS (SELECT *, {_TAIL} AS p FROM g) SELECT model, method, true_label, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig, p < 0.05 AS below_5_percent FROM t""")
def _(spark, sf):
    t = V.trials(spark, sf).withColumnRenamed("synthetic_method", "method")
    return I.binomial_table(t, "model", "method", "true_label") \
        .select("model", "method", "true_label", "sig", (F.col("p_value") < 0.05).alias("below_5_percent"))


@query("a43_export_summary", V.with_ctes(V.TRIALS, V.APPROVED, V.ANNOTATIONS, V.DEDUPED) + f""", u AS (SELECT 'LLM' AS source, condition, true_label, correct FROM approved
 UNION ALL SELECT 'Human', condition, true_label, correct FROM deduped), g AS (SELECT source, condition, true_label, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS n_correct FROM u GROUP BY 1, 2, 3),
 t AS (SELECT *, {_TAIL} AS p FROM g) SELECT source, condition, true_label, n, n_correct, round_even(n_correct/n, 4) AS accuracy, round_even(p, 4) AS p_value,
 CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig FROM t""")
def _(spark, sf):
    return I.export_summary(approved(spark, sf), human(spark, sf))


_PERM = """, src AS (SELECT dataset, provider_label, method, condition, trial_id, true_label, correct FROM matched),
 obs AS (SELECT dataset, provider_label, method, count(*) FILTER (condition='C1') AS n_c1, count(*) FILTER (condition='C2') AS n_c2,
 least(100.0*avg(correct::INT) FILTER (condition='C1' AND true_label='REAL'), 100.0*avg(correct::INT) FILTER (condition='C1' AND true_label<>'REAL')) AS drs_c1,
 least(100.0*avg(correct::INT) FILTER (condition='C2' AND true_label='REAL'), 100.0*avg(correct::INT) FILTER (condition='C2' AND true_label<>'REAL')) AS drs_c2 FROM src GROUP BY 1, 2, 3),
 shuffled AS (SELECT s.*, p.perm, row_number() OVER (PARTITION BY dataset, provider_label, method, perm
  ORDER BY md5(concat_ws('|', '20260531', CAST(perm AS VARCHAR), dataset, method, condition, provider_label, CAST(trial_id AS VARCHAR))), condition, trial_id) AS rn FROM src s CROSS JOIN (SELECT unnest(range(0, 100)) AS perm) p),
 diffs AS (SELECT s.dataset, s.provider_label, s.method, perm,
 least(100.0*avg(correct::INT) FILTER (rn > n_c1 AND true_label='REAL'), 100.0*avg(correct::INT) FILTER (rn > n_c1 AND true_label<>'REAL'))
 - least(100.0*avg(correct::INT) FILTER (rn <= n_c1 AND true_label='REAL'), 100.0*avg(correct::INT) FILTER (rn <= n_c1 AND true_label<>'REAL')) AS d
 FROM shuffled s JOIN obs o USING (dataset, provider_label, method) GROUP BY ALL)
 SELECT dataset, provider_label, method, n_c1, n_c2, round(drs_c1, 6) AS drs_c1, round(drs_c2, 6) AS drs_c2, round(drs_c2 - drs_c1, 6) AS delta, count(d) AS perm_effective_n,
 round(quantile_cont(d, 0.025), 6) AS perm_null_q025, round(quantile_cont(d, 0.975), 6) AS perm_null_q975,
 round((count(*) FILTER (d >= drs_c2 - drs_c1 - 1e-9) + 1)*1.0/(count(d) + 1), 6) AS p_one_sided_ge,
 round((count(*) FILTER (abs(d) >= abs(drs_c2 - drs_c1) - 1e-9) + 1)*1.0/(count(d) + 1), 6) AS p_two_sided,
 (count(*) FILTER (abs(d) >= abs(drs_c2 - drs_c1) - 1e-9) + 1)*1.0/(count(d) + 1) < 0.05 AS significant
 FROM diffs JOIN obs USING (dataset, provider_label, method) GROUP BY ALL"""


@query("w8_permutation_by_digest", W3.rstrip() + _PERM)
def _(spark, sf):
    matched = I.matched_sample(approved(spark, sf), 2026)
    return rounded(I.permutation_test(matched, n_perm=100, engine="digest"))


def _hypergeometric_sql(step, source, good, bad, n):
    """CTEs that draw by inverse distribution: column k{step} from the uniform number u{step}, for all groups and shuffles."""
    same = "PARTITION BY good, bad, n"
    return f""", asked{step} AS (SELECT *, {good} AS good, {bad} AS bad, {n} AS n FROM {source}),
 law{step} AS (SELECT good, bad, n, k, sum(p) OVER ({same} ORDER BY k) / sum(p) OVER ({same}) AS share FROM (
  SELECT good, bad, n, k, exp(l - max(l) OVER ({same})) AS p FROM (
   SELECT *, lgamma(good + 1.0) - lgamma(k + 1.0) - lgamma(good - k + 1.0) + lgamma(bad + 1.0) - lgamma(n - k + 1.0) - lgamma(bad - n + k + 1.0) AS l FROM (
    SELECT *, unnest(range(greatest(0, n - bad), least(n, good) + 1)) AS k FROM (SELECT DISTINCT good, bad, n FROM asked{step}) a) b) c) e),
 drawn{step} AS (SELECT a.* EXCLUDE (good, bad, n), l.k AS k{step} FROM asked{step} a
  ASOF JOIN (SELECT good, bad, n, share, min(k) AS k FROM law{step} GROUP BY ALL) l ON a.good = l.good AND a.bad = l.bad AND a.n = l.n AND a.u{step} < l.share)"""


def _drs_of_counts(rc, rw, sc, sw):
    return f"CASE WHEN {rc} + {rw} > 0 AND {sc} + {sw} > 0 THEN least(100.0*({rc})/({rc} + {rw}), 100.0*({sc})/({sc} + {sw})) END"


_COUNTS = ", ".join(f"count(*) FILTER ({test}) AS {name}, count(*) FILTER ({test} AND condition = 'C1') AS {name}_1" for name, test in (
    ("rc", "true_label = 'REAL' AND correct"), ("rw", "true_label = 'REAL' AND NOT correct"),
    ("sc", "true_label = 'SYNTHETIC' AND correct"), ("sw", "true_label = 'SYNTHETIC' AND NOT correct")))
_UNIFORM = ", ".join(f"('0x' || substr(md5(concat_ws('|', '20260531', 'u{i}', dataset, provider_label, method, CAST(perm AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 AS u{i}"
                     for i in (1, 2, 3))


@query("f4_permutation_test", W3.rstrip() + f""", counted AS (SELECT dataset, provider_label, method, count(*) FILTER (condition = 'C1') AS n_c1,
 count(*) FILTER (condition = 'C2') AS n_c2, {_COUNTS} FROM matched WHERE condition IN ('C1', 'C2') GROUP BY 1, 2, 3),
 obs AS (SELECT *, {_drs_of_counts("rc_1", "rw_1", "sc_1", "sw_1")} AS drs_c1,
 {_drs_of_counts("(rc - rc_1)", "(rw - rw_1)", "(sc - sc_1)", "(sw - sw_1)")} AS drs_c2 FROM counted WHERE n_c1 > 0 AND n_c2 > 0),
 shuffles AS (SELECT *, {_UNIFORM} FROM obs CROSS JOIN (SELECT unnest(range(0, 3000)) AS perm) p)"""
       + _hypergeometric_sql(1, "shuffles", "rc", "rw + sc + sw", "n_c1")
       + _hypergeometric_sql(2, "drawn1", "rw", "sc + sw", "n_c1 - k1")
       + _hypergeometric_sql(3, "drawn2", "sc", "sw", "n_c1 - k1 - k2") + f""",
 diffs AS (SELECT *, drs_c2 - drs_c1 AS delta, {_drs_of_counts("(rc - k1)", "(rw - k2)", "(sc - k3)", "(sw - n_c1 + k1 + k2 + k3)")}
 - {_drs_of_counts("k1", "k2", "k3", "(n_c1 - k1 - k2 - k3)")} AS d FROM drawn3)
 SELECT dataset, provider_label, method, n_c1, n_c2, round(drs_c1, 6) AS drs_c1, round(drs_c2, 6) AS drs_c2, round(delta, 6) AS delta, count(d) AS perm_effective_n,
 round(quantile_cont(d, 0.025), 6) AS perm_null_q025, round(quantile_cont(d, 0.975), 6) AS perm_null_q975,
 CASE WHEN delta IS NOT NULL THEN round((count(*) FILTER (d >= delta - 1e-9) + 1)*1.0/(count(d) + 1), 6) END AS p_one_sided_ge,
 CASE WHEN delta IS NOT NULL THEN round((count(*) FILTER (abs(d) >= abs(delta) - 1e-9) + 1)*1.0/(count(d) + 1), 6) END AS p_two_sided,
 CASE WHEN delta IS NOT NULL THEN (count(*) FILTER (abs(d) >= abs(delta) - 1e-9) + 1)*1.0/(count(d) + 1) < 0.05 END AS significant
 FROM diffs WHERE d IS NOT NULL GROUP BY dataset, provider_label, method, n_c1, n_c2, diffs.drs_c1, diffs.drs_c2, diffs.delta""")
def _(spark, sf):
    return rounded(I.permutation_test(I.matched_sample(approved(spark, sf), 2026)))


@query("t5_paired_records", """WITH p AS (SELECT event_id AS pair_id, CASE WHEN event_id % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS true_label,
 CASE WHEN value > 40 THEN 'REAL' ELSE 'SYNTHETIC' END AS v1, CASE WHEN user_id % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS v2,
 CAST(floor(value) AS BIGINT) % 101 AS k1, user_id % 101 AS k2, event_type AS n1 FROM events)
 SELECT pair_id, true_label, 'C1' AS condition, v1 AS predicted_label, v1 = true_label AS correct, k1 AS confidence, n1 AS notes FROM p
 UNION ALL SELECT pair_id, true_label, 'C2', v2, v2 = true_label, k2, NULL FROM p""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    label = lambda test: F.when(test, "REAL").otherwise("SYNTHETIC")
    pairs = e.select(
        F.col("event_id").alias("pair_id"), label(F.col("event_id") % 2 == 0).alias("true_label"),
        label(F.col("value") > 40).alias("c1_vote"), label(F.col("user_id") % 2 == 0).alias("c2_vote"),
        (F.floor("value").cast("bigint") % 101).alias("c1_conf"), (F.col("user_id") % 101).alias("c2_conf"),
        F.col("event_type").alias("c1_notes"), F.lit(None).cast("string").alias("c2_notes"))
    return A.answer_pairs(pairs)
