"""Queries over judged trials: cleaning, accuracy, disclosure risk, coverage, joins and ordering."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.functions.ranking import average_ranks
from tablejury.operators import clean as C, metrics as M
from tablejury.plans import views as V
from tablejury.plans.registry import query

T, AP = V.with_ctes(V.TRIALS), V.with_ctes(V.TRIALS, V.APPROVED)
BOTH = V.with_ctes(V.TRIALS, V.APPROVED, V.ANNOTATIONS, V.DEDUPED)
MODEL_COLUMNS = {"groq_n": "Groq (LLaMA-3.1-8b)", "google_n": "Google (Gemini-2.5-Flash)"}


def rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def approved(spark, sf):
    return C.clean_trials(V.trials(spark, sf))


def raw(spark, sf):
    return V.trials(spark, sf).withColumnRenamed("synthetic_method", "method")


# ---- filters and cleaning ------------------------------------------------------

@query("p1_drop_errors", T + """SELECT dataset, count(*) AS n FROM trials
 WHERE coalesce(predicted_label,'ERROR') <> 'ERROR' GROUP BY dataset""")
def _(spark, sf):
    return C.drop_errors(V.trials(spark, sf)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("p2_keep_valid_labels", T + """SELECT predicted_label, true_label, count(*) AS n FROM trials
 WHERE predicted_label IN ('REAL','SYNTHETIC') AND true_label IN ('REAL','SYNTHETIC') GROUP BY 1, 2""")
def _(spark, sf):
    return C.keep_valid(V.trials(spark, sf), true_label=True).groupBy("predicted_label", "true_label") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("p3_approved_models", AP + "SELECT provider, model, provider_label, count(*) AS n FROM approved GROUP BY ALL")
def _(spark, sf):
    return approved(spark, sf).groupBy("provider", "model", "provider_label").agg(F.count(F.lit(1)).alias("n"))


@query("p4_disposition_counts", T + """SELECT CASE WHEN predicted_label NOT IN ('REAL','SYNTHETIC') THEN 'invalid'
 WHEN (provider, model) NOT IN (('groq','llama-3.1-8b-instant'),('google','gemini-2.5-flash')) THEN 'excluded_model'
 ELSE 'kept' END AS disposition, count(*) AS n_lines FROM trials GROUP BY 1""")
def _(spark, sf):
    return C.disposition_counts(V.trials(spark, sf))


def _holed(spark, sf):
    t = V.trials(spark, sf)
    gap = F.col("trial_id") % 17 == 0
    return t.select(
        "trial_id", F.when(~gap, F.col("provider")).alias("provider"),
        F.when(F.col("trial_id") % 5 != 0, F.col("synthetic_method")).alias("synthetic_method"),
        F.when(F.col("trial_id") % 10 != 0, F.col("dataset")).alias("method"),
        F.when(~gap, F.col("condition")).alias("condition"), F.when(~gap, F.col("correct")).alias("correct"),
        F.when(F.col("confidence") >= 0, F.col("confidence")).alias("confidence"),
        F.when(F.col("confidence") < 0, F.lit("Error 429: rate limit")).alias("error"),
        F.when(F.col("trial_id") % 19 != 0, F.col("predicted_label")).alias("predicted_label"))


_HOLED = """, holed AS (SELECT trial_id, CASE WHEN trial_id % 17 <> 0 THEN provider END AS provider,
 CASE WHEN trial_id % 5 <> 0 THEN synthetic_method END AS synthetic_method,
 CASE WHEN trial_id % 10 <> 0 THEN dataset END AS method,
 CASE WHEN trial_id % 17 <> 0 THEN condition END AS condition, CASE WHEN trial_id % 17 <> 0 THEN correct END AS correct,
 CASE WHEN confidence >= 0 THEN confidence END AS confidence,
 CASE WHEN confidence < 0 THEN 'Error 429: rate limit' END AS error,
 CASE WHEN trial_id % 19 <> 0 THEN predicted_label END AS predicted_label FROM trials)
"""


@query("p5_usable_reasoning", T.rstrip() + _HOLED + """SELECT trial_id, predicted_label FROM holed
 WHERE coalesce(error,'') = '' AND coalesce(predicted_label,'') <> ''""")
def _(spark, sf):
    return C.usable_reasoning(_holed(spark, sf)).select("trial_id", "predicted_label")


@query("p6_fill_absent", T.rstrip() + _HOLED + """SELECT trial_id, coalesce(provider,'?') AS provider,
 coalesce(synthetic_method, method, 'unknown') AS method, coalesce(condition,'?') AS condition,
 coalesce(correct, false) AS correct, coalesce(CAST(confidence AS DOUBLE), 50) AS confidence FROM holed""")
def _(spark, sf):
    return C.fill_absent(_holed(spark, sf))


@query("p7_normalise_method", T + """SELECT method_name, count(*) AS n FROM (
 SELECT CASE WHEN lower(m) LIKE '%ctgan%' THEN 'CTGAN' WHEN lower(m) LIKE '%tvae%' THEN 'TVAE'
  WHEN lower(m) LIKE '%gaussian%' OR lower(m) LIKE '%copula%' THEN 'GaussianCopula' END AS method_name
 FROM (SELECT CASE WHEN trial_id % 9 = 0 THEN 'cart' WHEN trial_id % 4 = 0 THEN upper(synthetic_method) || '_v2'
  ELSE synthetic_method END AS m FROM trials) a) b WHERE method_name IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    spelled = F.when(F.col("trial_id") % 9 == 0, "cart") \
        .when(F.col("trial_id") % 4 == 0, F.concat(F.upper("synthetic_method"), F.lit("_v2"))) \
        .otherwise(F.col("synthetic_method"))
    return V.trials(spark, sf).select(S.normalise_method(spelled).alias("method_name")) \
        .filter(F.col("method_name").isNotNull()).groupBy("method_name").agg(F.count(F.lit(1)).alias("n"))


@query("p8_clean_confidence", T + """SELECT provider, round(avg(CASE WHEN confidence > 0 THEN confidence END), 6) AS positive,
 round(avg(CASE WHEN confidence >= 0 THEN confidence END), 6) AS nonnegative, round(avg(confidence), 6) AS raw_mean,
 count(CASE WHEN confidence > 0 THEN 1 END) AS n_positive FROM trials GROUP BY provider""")
def _(spark, sf):
    t = V.trials(spark, sf).withColumn("as_text", F.col("confidence").cast("string"))
    return rounded(t.groupBy("provider").agg(
        F.avg(S.clean_confidence("as_text")).alias("positive"),
        F.avg(S.clean_confidence("as_text", "nonnegative")).alias("nonnegative"),
        F.avg(S.clean_confidence("confidence", "raw")).alias("raw_mean"),
        F.count(S.clean_confidence("confidence")).alias("n_positive")))


@query("p9_cell_filters", AP + """SELECT count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS n_correct FROM approved
 WHERE dataset='adult' AND method='tvae' AND condition='C2' AND true_label='REAL' AND provider='google'""")
def _(spark, sf):
    return approved(spark, sf).filter(
        "dataset = 'adult' AND method = 'tvae' AND condition = 'C2' AND true_label = 'REAL' AND provider = 'google'") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(S.hit()).alias("n_correct"))


@query("p17_nonblank_notes", V.with_ctes(V.ANNOTATIONS) + """SELECT pair_id, condition, source_path, notes
 FROM annotations WHERE trim(notes) <> ''""")
def _(spark, sf):
    return V.annotations(spark, sf).filter(F.trim("notes") != "").select("pair_id", "condition", "source_path", "notes")


@query("p18_projection", AP + """SELECT trial_id, dataset, provider_label, method, condition, true_label,
 predicted_label, correct, confidence FROM approved""")
def _(spark, sf):
    return approved(spark, sf).select("trial_id", "dataset", "provider_label", "method", "condition", "true_label",
                                      "predicted_label", "correct", "confidence")


@query("p20_bands", T + """SELECT synthetic_method AS method, user_band, round(acc, 6) AS accuracy,
 CASE WHEN acc = 1 THEN 'green' WHEN acc >= 0.5 THEN 'orange' ELSE 'red' END AS accuracy_band,
 CASE WHEN acc*100 < 30 THEN 'green' WHEN acc*100 < 40 THEN 'orange' ELSE 'red' END AS privacy_band
 FROM (SELECT synthetic_method, CAST(confidence % 7 AS BIGINT) AS user_band, avg(correct::INT) AS acc
 FROM trials GROUP BY 1, 2) g""")
def _(spark, sf):
    acc = F.avg(S.hit())
    out = V.trials(spark, sf).groupBy(F.col("synthetic_method").alias("method"),
                                      (F.col("confidence") % 7).alias("user_band")).agg(acc.alias("accuracy"))
    return rounded(out.withColumn("accuracy_band", S.accuracy_band(F.col("accuracy")))
                   .withColumn("privacy_band", S.privacy_band(F.col("accuracy") * 100)))


@query("p22_progress_status", T + """SELECT synthetic_method AS method, provider, valid, errors,
 CASE WHEN valid >= 20 AND errors = 0 THEN 'DONE' WHEN valid > 0 THEN 'PARTIAL' WHEN errors > 0 THEN 'QUOTA HIT'
 ELSE 'PENDING' END AS status FROM (SELECT synthetic_method, provider, count(*) FILTER (predicted_label <> 'ERROR') AS valid,
 count(*) FILTER (predicted_label = 'ERROR') AS errors FROM trials GROUP BY 1, 2) g""")
def _(spark, sf):
    return M.valid_and_errors(raw(spark, sf), "method", "provider") \
        .withColumn("status", S.progress_status(F.col("valid"), F.col("errors")))


@query("p23_error_class", T + """SELECT CASE WHEN msg IS NULL THEN NULL WHEN regexp_matches(lower(msg),
 '429|quota|rate limit|rate_limit|resource_exhausted|too many requests|requests per minute|requests per day') THEN 'quota'
 ELSE 'transient' END AS error_class, count(*) AS n FROM (SELECT CASE WHEN predicted_label = 'ERROR' THEN
 CASE trial_id % 3 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'Quota exceeded' ELSE 'connection reset' END END AS msg
 FROM trials) m GROUP BY 1""")
def _(spark, sf):
    message = F.when(F.col("predicted_label") == "ERROR",
                     F.when(F.col("trial_id") % 3 == 0, "HTTP 429 Too Many Requests")
                     .when(F.col("trial_id") % 3 == 1, "Quota exceeded").otherwise("connection reset"))
    return V.trials(spark, sf).select(S.error_class(message).alias("error_class")) \
        .groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


# ---- accuracy family ---------------------------------------------------------------

_ONE = """SELECT {k} AS key, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n,
 round(avg(correct::INT), 6) AS accuracy FROM trials GROUP BY {k}"""


@query("a1_accuracy_by_key", T + " UNION ALL ".join(
    _ONE.replace("SELECT", f"SELECT '{k}' AS dimension,", 1).format(k=k)
    for k in ("synthetic_method", "condition", "true_label", "model", "provider")))
def _(spark, sf):
    keys = ["synthetic_method", "condition", "true_label", "model", "provider"]
    out = M.accuracy_sets(V.trials(spark, sf), keys)
    named = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])
    return rounded(out.filter(F.coalesce(*keys).isNotNull()).select(
        named.alias("dimension"), F.coalesce(*keys).alias("key"), "n_correct", "n", "accuracy"))


@query("a2_accuracy_by_two_keys", T + """SELECT dataset, synthetic_method, condition, true_label, model,
 CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM trials
 GROUP BY GROUPING SETS ((condition, true_label), (synthetic_method, condition), (dataset, model))""")
def _(spark, sf):
    c = F.col
    out = V.trials(spark, sf).groupingSets(
        [[c("condition"), c("true_label")], [c("synthetic_method"), c("condition")], [c("dataset"), c("model")]],
        c("dataset"), c("synthetic_method"), c("condition"), c("true_label"), c("model")).agg(
        F.sum(S.hit()).alias("n_correct"), F.count(F.lit(1)).alias("n"), F.avg(S.hit()).alias("accuracy"))
    return rounded(out)


@query("a3_overall_accuracy", T + """SELECT CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n,
 round(avg(correct::INT), 6) AS accuracy FROM trials""")
def _(spark, sf):
    return rounded(M.accuracy_by(V.trials(spark, sf)))


_A4 = """SELECT {k} AS key, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n, round_even(avg(correct::INT), 3) AS accuracy,
 CAST(CAST(trunc(round_even(avg(correct::INT), 3)*100) AS INT) AS VARCHAR) || '%' AS accuracy_pct,
 round_even(avg(confidence), 3) AS avg_confidence FROM trials GROUP BY 1"""


@query("a4_accuracy_with_confidence", T + _A4.format(k="synthetic_method"))
def _(spark, sf):
    return M.accuracy_with_confidence(V.trials(spark, sf), F.col("synthetic_method").alias("key"))


@query("a5_truncated_percentage", T + "SELECT key, accuracy_pct FROM (" + _A4.format(k="condition || ' ' || true_label") + ") a")
def _(spark, sf):
    return M.accuracy_with_confidence(
        V.trials(spark, sf), F.concat_ws(" ", "condition", "true_label").alias("key")).select("key", "accuracy_pct")


@query("a6_cell_metrics", AP + f"SELECT dataset, provider_label, method, condition, {V.METRICS} FROM approved GROUP BY ALL")
def a6_cell_metrics(spark, sf):
    return rounded(M.cell_metrics(approved(spark, sf)))


@query("a7_drs_zero_default", AP + """SELECT method, condition, n_real, n_syn, n, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn,
 round(least(p_real, p_syn), 6) AS drs FROM (SELECT method, condition, count(*) FILTER (true_label='REAL') AS n_real,
 count(*) FILTER (true_label<>'REAL') AS n_syn, count(*) AS n,
 coalesce(avg(correct::INT) FILTER (true_label='REAL'), 0)*100.0 AS p_real,
 coalesce(avg(correct::INT) FILTER (true_label<>'REAL'), 0)*100.0 AS p_syn FROM approved GROUP BY 1, 2) g""")
def _(spark, sf):
    return rounded(M.cell_metrics(approved(spark, sf), ["method", "condition"], "zero").select(
        "method", "condition", "n_real", "n_syn", "n", F.col("p_real_correct").alias("p_real"),
        F.col("p_syn_correct").alias("p_syn"), "drs"))


_A9 = """named AS (SELECT CASE synthetic_method WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' ELSE 'GaussianCopula' END AS m,
 condition AS c, true_label AS t, predicted_label AS p FROM trials),
 counted AS (SELECT m, c, count(*) AS trials, count(*) FILTER (t='REAL' AND p='REAL') AS rc,
 count(*) FILTER (t='SYNTHETIC' AND p='SYNTHETIC') AS sc, count(*) FILTER (t='REAL') AS nr,
 count(*) FILTER (t='SYNTHETIC') AS ns FROM named GROUP BY 1, 2)
"""


@query("a9_discrimination_half", V.with_ctes(V.TRIALS, _A9) + """SELECT m AS method, c AS condition, trials,
 round(rc*1.0/(trials//2), 6) AS accuracy_real, round(sc*1.0/(trials - trials//2), 6) AS accuracy_synthetic,
 round((rc*1.0/(trials//2) + sc*1.0/(trials - trials//2))/2, 6) AS discrimination FROM counted""")
def _(spark, sf):
    return rounded(M.discrimination(V.trials(spark, sf)))


@query("a9_discrimination_class", V.with_ctes(V.TRIALS, _A9) + """SELECT m AS method, c AS condition, trials,
 round(rc*1.0/nr, 6) AS accuracy_real, round(sc*1.0/ns, 6) AS accuracy_synthetic,
 round((rc*1.0/nr + sc*1.0/ns)/2, 6) AS discrimination FROM counted""")
def _(spark, sf):
    return rounded(M.discrimination(V.trials(spark, sf), "class"))


@query("a10_privacy_scores", T + """SELECT condition, synthetic_method AS method, true_label,
 CASE WHEN grouping(synthetic_method) = 0 THEN 'method' WHEN grouping(true_label) = 0 THEN 'label' ELSE 'condition' END AS level,
 round(100.0*avg(correct::INT), 6) AS accuracy, round(100 - 100.0*avg(correct::INT), 6) AS privacy_score,
 round(avg(confidence), 6) AS avg_confidence, count(*) AS n_trials FROM trials
 GROUP BY GROUPING SETS ((condition), (condition, synthetic_method), (condition, true_label))""")
def _(spark, sf):
    return rounded(M.privacy_scores(raw(spark, sf)))


_IMPACT = """priv AS (SELECT CASE WHEN grouping(synthetic_method) = 1 THEN 'all' ELSE synthetic_method END AS scope,
 100 - 100.0*avg(correct::INT) FILTER (condition='C1') AS c1, 100 - 100.0*avg(correct::INT) FILTER (condition='C2') AS c2
 FROM trials GROUP BY GROUPING SETS ((), (synthetic_method)))
"""


@query("a11_condition_impact", V.with_ctes(V.TRIALS, _IMPACT) + """SELECT scope, round(c1, 6) AS c1_privacy, round(c2, 6) AS c2_privacy,
 round(c1 - c2, 6) AS absolute, round((c1 - c2)/c1*100, 6) AS relative FROM priv""")
def _(spark, sf):
    return rounded(M.condition_impact(raw(spark, sf)))


@query("j3_condition_self_join", V.with_ctes(V.TRIALS, _IMPACT) + """SELECT scope AS method, round(c1, 6) AS c1_privacy,
 round(c2, 6) AS c2_privacy, round(c1 - c2, 6) AS absolute FROM priv WHERE scope <> 'all'""")
def _(spark, sf):
    scores = M.privacy_scores(raw(spark, sf)).filter("level = 'method'").select("condition", "method", "privacy_score")
    c1 = scores.filter("condition = 'C1'").select("method", F.col("privacy_score").alias("c1_privacy"))
    c2 = scores.filter("condition = 'C2'").select("method", F.col("privacy_score").alias("c2_privacy"))
    return rounded(c1.join(c2, "method").withColumn("absolute", F.col("c1_privacy") - F.col("c2_privacy")))


def _human(spark, sf):
    from tablejury.operators.agreement import dedupe_annotations
    return dedupe_annotations(V.annotations(spark, sf))


_UNION = """SELECT 'LLM' AS source, condition, true_label, correct FROM approved
 UNION ALL SELECT 'Human', condition, true_label, correct FROM deduped"""


@query("a12_head_to_head", BOTH + f"""SELECT condition, true_label, source, round(avg(correct::INT), 6) AS accuracy,
 count(*) AS n FROM ({_UNION}) u GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(M.head_to_head(approved(spark, sf), _human(spark, sf)))


@query("a13_accuracy_summary", BOTH + f"""SELECT source, condition, true_label, round(avg(correct::INT), 6) AS accuracy,
 CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS total FROM ({_UNION}) u GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(M.accuracy_summary(approved(spark, sf), _human(spark, sf)))


@query("u1_tagged_union", BOTH + """SELECT 'LLM' AS source, dataset, condition, correct, provider_label, NULL AS annotator_id FROM approved
 UNION ALL SELECT 'Human', dataset, condition, correct, NULL, annotator_id FROM deduped""")
def _(spark, sf):
    return M.tag_sources(approved(spark, sf).select("dataset", "condition", "correct", "provider_label"),
                         _human(spark, sf).select("dataset", "condition", "correct", "annotator_id"))


@query("a14_provider_accuracy", AP + """SELECT provider_label, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n,
 round(avg(correct::INT), 6) AS accuracy FROM approved GROUP BY 1 HAVING count(*) >= 5""")
def _(spark, sf):
    return rounded(M.provider_accuracy(approved(spark, sf), min_n=5))


@query("a15_confidence_by_outcome", T + """SELECT round(avg(confidence) FILTER (correct), 6) AS conf_correct,
 round(avg(confidence) FILTER (NOT correct), 6) AS conf_wrong, count(*) FILTER (correct) AS n_correct,
 count(*) FILTER (NOT correct) AS n_wrong FROM trials""")
def _(spark, sf):
    return rounded(M.confidence_by_outcome(V.trials(spark, sf)))


@query("a16_calibration", T + """SELECT condition, CAST(ceil(confidence/20.0) AS INT) AS bucket,
 CAST((ceil(confidence/20.0)-1)*20 AS INT) AS low, CAST(ceil(confidence/20.0)*20 AS INT) AS high, count(*) AS n,
 round(avg(correct::INT), 6) AS accuracy FROM trials WHERE confidence > 0 AND confidence <= 100 GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.calibration(V.trials(spark, sf)))


@query("a17_prediction_bias", T + """SELECT true_label, round(count(*) FILTER (predicted_label='REAL')*1.0/count(*), 6) AS share_real,
 round(count(*) FILTER (predicted_label='SYNTHETIC')*1.0/count(*), 6) AS share_synthetic,
 round(count(*) FILTER (predicted_label='ERROR')*1.0/count(*), 6) AS share_error FROM trials GROUP BY 1""")
def _(spark, sf):
    return rounded(M.prediction_bias(V.trials(spark, sf)))


@query("w7_row_shares", T + """SELECT true_label, predicted_label, count(*) AS n,
 round(count(*)*1.0/sum(count(*)) OVER (PARTITION BY true_label), 6) AS share FROM trials GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(M.prediction_shares(V.trials(spark, sf)))


@query("a18_pred_real_rate", AP + """SELECT provider_label, round(100.0*avg((predicted_label='REAL')::INT), 6) AS pred_real_rate,
 round(avg(confidence), 6) AS avg_conf FROM approved GROUP BY 1""")
def _(spark, sf):
    return rounded(M.cell_metrics(approved(spark, sf), ["provider_label"])
                   .select("provider_label", "pred_real_rate", "avg_conf"))


@query("a19_method_condition_pivot", T + """SELECT synthetic_method AS method, round(avg(correct::INT) FILTER (condition='C1'), 6) AS C1,
 round(avg(correct::INT) FILTER (condition='C2'), 6) AS C2 FROM trials GROUP BY 1""")
def _(spark, sf):
    return rounded(M.method_condition_matrix(raw(spark, sf)))


_COVER = """coverage AS (SELECT dataset, method, condition, count(*) FILTER (provider='groq') AS groq_n,
 count(*) FILTER (provider='google') AS google_n, least(count(*) FILTER (provider='groq'), count(*) FILTER (provider='google')) AS n_min
 FROM approved GROUP BY 1, 2, 3)
"""


@query("a20_coverage", V.with_ctes(V.TRIALS, V.APPROVED, _COVER) + "SELECT *, n_min >= 8 AS fair_cell FROM coverage")
def _(spark, sf):
    return M.coverage(approved(spark, sf), MODEL_COLUMNS)


@query("j1_fair_cells", V.with_ctes(V.TRIALS, V.APPROVED, _COVER) + f"""SELECT a.dataset, provider_label, a.method, a.condition, {V.METRICS}
 FROM approved a SEMI JOIN (SELECT * FROM coverage WHERE n_min >= 8) c USING (dataset, method, condition) GROUP BY ALL""")
def _(spark, sf):
    t = approved(spark, sf)
    cells = M.cell_metrics(t)
    keys = M.fair_keys(M.coverage(t, MODEL_COLUMNS))
    return rounded(cells.join(keys, ["dataset", "method", "condition"], "left_semi"))


@query("a21_valid_cell_counts", T + """SELECT provider, model, synthetic_method AS method, condition,
 count(*) FILTER (predicted_label IN ('REAL','SYNTHETIC')) AS valid FROM trials GROUP BY ALL""")
def _(spark, sf):
    return M.valid_cell_counts(raw(spark, sf), "provider", "model", "method", "condition")


@query("a22_valid_and_errors", T + """SELECT dataset, synthetic_method AS method, provider,
 count(*) FILTER (predicted_label <> 'ERROR') AS valid, count(*) FILTER (predicted_label = 'ERROR') AS errors FROM trials GROUP BY ALL""")
def _(spark, sf):
    return M.valid_and_errors(raw(spark, sf), "dataset", "method", "provider")


@query("a36_confidence_vs_outcome", T + """SELECT true_label, confidence, correct, count(*) AS n FROM trials GROUP BY ALL""")
def _(spark, sf):
    return V.trials(spark, sf).groupBy("true_label", "confidence", "correct").agg(F.count(F.lit(1)).alias("n"))


@query("a39_mean_drs_skip", AP + """SELECT method, round(avg(drs), 6) AS mean_drs FROM (SELECT method, condition,
 least(100.0*avg(correct::INT) FILTER (true_label='REAL'), 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) AS drs
 FROM approved GROUP BY 1, 2) g GROUP BY 1""")
def _(spark, sf):
    return rounded(M.mean_drs(M.cell_metrics(approved(spark, sf), ["method", "condition"])))


@query("a39_mean_drs_zero", AP + """SELECT method, round((coalesce(max(drs) FILTER (condition='C1'), 0) + coalesce(max(drs) FILTER (condition='C2'), 0))/2, 6) AS mean_drs
 FROM (SELECT method, condition, least(100.0*avg(correct::INT) FILTER (true_label='REAL'),
  100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) AS drs FROM approved GROUP BY 1, 2) g GROUP BY 1""")
def _(spark, sf):
    return rounded(M.mean_drs(M.cell_metrics(approved(spark, sf), ["method", "condition"]), "zero"))


@query("a42_verdict_breakdown", T + """SELECT provider, round(coalesce(100.0*avg(correct::INT) FILTER (true_label='REAL'), 0), 6) AS real_correct_pct,
 round(coalesce(100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC'), 0), 6) AS synthetic_correct_pct FROM trials GROUP BY 1""")
def _(spark, sf):
    return rounded(M.verdict_breakdown(V.trials(spark, sf)))


@query("a47_condition_table", T + """SELECT synthetic_method AS method,
 round(100 - 100.0*avg(correct::INT) FILTER (condition='C1'), 6) AS c1_privacy_score, round(avg(confidence) FILTER (condition='C1'), 6) AS c1_avg_confidence,
 count(*) FILTER (condition='C1') AS c1_trials, round(100 - 100.0*avg(correct::INT) FILTER (condition='C2'), 6) AS c2_privacy_score,
 round(avg(confidence) FILTER (condition='C2'), 6) AS c2_avg_confidence, count(*) FILTER (condition='C2') AS c2_trials,
 round(100.0*avg(correct::INT) FILTER (condition='C2') - 100.0*avg(correct::INT) FILTER (condition='C1'), 6) AS degradation_pp FROM trials GROUP BY 1""")
def _(spark, sf):
    return rounded(M.condition_table(raw(spark, sf)))


@query("a47_accuracy_by_label", T + """SELECT synthetic_method AS method, condition, round(100.0*avg(correct::INT) FILTER (true_label='REAL'), 6) AS accuracy_on_real,
 round(100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC'), 6) AS accuracy_on_synthetic FROM trials GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(M.accuracy_by_label_table(raw(spark, sf)))


@query("a48_by_dataset_and_model", AP + f"SELECT dataset, provider_label, {V.METRICS} FROM approved GROUP BY 1, 2")
def _(spark, sf):
    return rounded(M.cell_metrics(approved(spark, sf), ["dataset", "provider_label"]))


@query("a50_paper_table", AP + """SELECT method, round(d1, 6) AS c1_drs, round(d2, 6) AS c2_drs, round((d1 + d2)/2, 6) AS avg_drs, n_c1, n_c2 FROM (
 SELECT method, 100.0*least(avg(correct::INT) FILTER (condition='C1' AND true_label='REAL'), avg(correct::INT) FILTER (condition='C1' AND true_label<>'REAL')) AS d1,
 100.0*least(avg(correct::INT) FILTER (condition='C2' AND true_label='REAL'), avg(correct::INT) FILTER (condition='C2' AND true_label<>'REAL')) AS d2,
 count(*) FILTER (condition='C1') AS n_c1, count(*) FILTER (condition='C2') AS n_c2 FROM approved GROUP BY 1) g""")
def _(spark, sf):
    return rounded(M.drs_paper_table(approved(spark, sf)))


# ---- joins ---------------------------------------------------------------------------

@query("j4_full_outer", AP + """SELECT coalesce(a.provider_label, c.provider_label) AS provider_label, a.acc AS adult_accuracy, coalesce(a.n, 0) AS adult_n,
 c.acc AS census_accuracy, coalesce(c.n, 0) AS census_n FROM
 (SELECT provider_label, round(100.0*avg(correct::INT), 6) AS acc, count(*) AS n FROM approved WHERE dataset='adult' GROUP BY 1) a
 FULL JOIN (SELECT provider_label, round(100.0*avg(correct::INT), 6) AS acc, count(*) AS n FROM approved
 WHERE dataset='census' GROUP BY 1) c ON a.provider_label = c.provider_label""")
def _(spark, sf):
    return rounded(M.provider_by_dataset(approved(spark, sf)))


_DISC = _A9.rstrip() + """, disc AS (SELECT m, c, (rc*1.0/(trials//2) + sc*1.0/(trials - trials//2))/2 AS d FROM counted)
"""


@query("j6_scores_by_condition", V.with_ctes(V.TRIALS, _DISC) + """SELECT m AS method, round(max(d) FILTER (c='C1'), 6) AS llm_c1,
 round(max(d) FILTER (c='C2'), 6) AS llm_c2, round(CASE WHEN max(d) FILTER (c='C1') <> 0 AND max(d) FILTER (c='C2') <> 0
 THEN (max(d) FILTER (c='C1') + max(d) FILTER (c='C2'))/2 END, 6) AS llm_avg FROM disc GROUP BY 1""")
def _(spark, sf):
    from tablejury.plans.formal import judge_scores
    return rounded(judge_scores(V.trials(spark, sf)))


@query("j7_grid_with_zeros", T + """SELECT m AS method, c AS condition, coalesce(valid, 0) AS valid FROM
 (SELECT unnest(['ctgan','tvae','gaussian_copula']) AS m) ms CROSS JOIN (SELECT unnest(['C1','C2']) AS c) cs
 LEFT JOIN (SELECT synthetic_method, condition, count(*) FILTER (predicted_label <> 'ERROR') AS valid FROM trials GROUP BY 1, 2) t ON synthetic_method = m AND condition = c""")
def _(spark, sf):
    return M.fill_grid(M.full_grid(spark), M.valid_cell_counts(raw(spark, sf), "method", "condition"),
                       ["method", "condition"], ["valid"])


@query("j9_membership", T + """SELECT 'approved' AS part, count(*) AS n FROM trials WHERE (provider, model) IN (('groq','llama-3.1-8b-instant'),('google','gemini-2.5-flash'))
 UNION ALL SELECT 'other', count(*) FROM trials WHERE (provider, model) NOT IN (('groq','llama-3.1-8b-instant'),('google','gemini-2.5-flash'))""")
def _(spark, sf):
    t, allowed = V.trials(spark, sf), F.broadcast(C.allow_list(spark))  # a fixed two-row list
    key = ["provider", "model"]
    n = F.count(F.lit(1)).alias("n")
    return t.join(allowed, key, "left_semi").agg(F.lit("approved").alias("part"), n) \
        .unionByName(t.join(allowed, key, "left_anti").agg(F.lit("other").alias("part"), n))


@query("j14_paired_models", V.with_ctes(V.TRIALS, V.APPROVED, _COVER) + """SELECT dataset, method, condition, n_min AS n_match FROM coverage WHERE n_min > 0""")
def _(spark, sf):
    from tablejury.operators.inference import match_sizes
    return match_sizes(approved(spark, sf))


# ---- ranking, ordering and set operations -------------------------------------------------

@query("w5_privacy_ranking", T + """SELECT synthetic_method, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n, round(avg(correct::INT), 6) AS accuracy,
 round(100.0*avg(correct::INT), 6) AS accuracy_pct, CAST(row_number() OVER (ORDER BY avg(correct::INT), synthetic_method) AS INT) AS rank,
 CASE WHEN 100.0*avg(correct::INT) < 30 THEN 'green' WHEN 100.0*avg(correct::INT) < 40 THEN 'orange' ELSE 'red' END AS band FROM trials GROUP BY 1""")
def _(spark, sf):
    return rounded(M.privacy_ranking(V.trials(spark, sf)))


@query("w6_average_ranks", T + """SELECT DISTINCT dataset, confidence, count(*) OVER (PARTITION BY dataset, confidence) AS n,
 rank() OVER (PARTITION BY dataset ORDER BY confidence) + (count(*) OVER (PARTITION BY dataset, confidence) - 1)/2.0 AS avg_rank FROM trials""")
def _(spark, sf):
    return average_ranks(V.trials(spark, sf), ["dataset"], "confidence")


@query("k4_sorted_methods", T + """SELECT synthetic_method, CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n,
 round(avg(correct::INT), 6) AS accuracy FROM trials GROUP BY 1 ORDER BY 4 DESC, 1""")
def _(spark, sf):
    return rounded(M.accuracy_by(V.trials(spark, sf), "synthetic_method")) \
        .orderBy(F.desc("accuracy"), "synthetic_method")


@query("k5_condition_gap", V.with_ctes(V.TRIALS, _IMPACT) + """SELECT scope AS method, round(c1 - c2, 6) AS difference FROM priv
 WHERE scope <> 'all' ORDER BY abs(c1 - c2) DESC""")
def _(spark, sf):
    return rounded(M.by_condition_gap(raw(spark, sf)))


@query("k8_cell_order", AP + """SELECT dataset, provider_label, method, condition, count(*) AS n FROM approved GROUP BY ALL ORDER BY ALL""")
def _(spark, sf):
    return approved(spark, sf).groupBy(*M.CELL).agg(F.count(F.lit(1)).alias("n")).orderBy(*M.CELL)


@query("u3_distinct_cells", AP + "SELECT DISTINCT dataset, method, condition FROM approved")
def _(spark, sf):
    return approved(spark, sf).select("dataset", "method", "condition").distinct()


@query("u4_key_union", T + """SELECT synthetic_method AS method, provider FROM trials WHERE condition='C1'
 UNION SELECT synthetic_method, provider FROM trials WHERE condition='C2'""")
def _(spark, sf):
    t = raw(spark, sf)
    return t.filter("condition = 'C1'").select("method", "provider") \
        .union(t.filter("condition = 'C2'").select("method", "provider")).distinct()


@query("f_str_functions", T + """SELECT trial_id, lower(model) AS lowered, upper(condition) AS uppered, trim('  ' || provider || ' ') AS trimmed,
 upper(dataset[1]) || lower(dataset[2:]) || ' · ' || CASE synthetic_method WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' ELSE 'Gaussian Copula' END || ' · ' || condition AS cell_name,
 replace(model || chr(10) || provider, chr(10), ' ') AS flat, substring(model, 1, 9) AS cut, contains(lower(model), 'flash') AS is_flash FROM trials""")
def _(spark, sf):
    cell = F.concat_ws(" · ", F.initcap("dataset"), S.method_label("synthetic_method"), F.col("condition"))
    return V.trials(spark, sf).select(
        "trial_id", F.lower("model").alias("lowered"), F.upper("condition").alias("uppered"),
        F.trim(F.concat(F.lit("  "), "provider", F.lit(" "))).alias("trimmed"), cell.alias("cell_name"),
        F.replace(F.concat_ws("\n", "model", "provider"), F.lit("\n"), F.lit(" ")).alias("flat"),
        F.substring("model", 1, 9).alias("cut"), F.lower("model").contains("flash").alias("is_flash"))


@query("f_re_safe_model_name", T + """SELECT DISTINCT regexp_replace('vendor/' || model || ' (beta:' || provider || ')', '[^a-zA-Z0-9._-]+', '-', 'g') AS safe_name FROM trials""")
def _(spark, sf):
    name = F.concat(F.lit("vendor/"), "model", F.lit(" (beta:"), "provider", F.lit(")"))
    return V.trials(spark, sf).select(S.safe_model_name(name).alias("safe_name")).distinct()


@query("f_time_stamps", T + """SELECT trial_id, strftime(timestamp, '%Y%m%d_%H%M%S') AS run_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS iso,
 CAST(date_part('hour', timestamp) AS INT) AS hour FROM trials""")
def _(spark, sf):
    return V.trials(spark, sf).select("trial_id", S.stamp("timestamp").alias("run_id"),
                                      F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                                      F.hour(F.to_timestamp(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))).alias("hour"))


@query("f_math_functions", T + """SELECT trial_id, abs(confidence - 50) AS distance, greatest(confidence, 10) AS at_least, least(confidence, 90) AS at_most,
 confidence // 2 AS half, round(pow(confidence, 2)/7.0, 4) AS scaled FROM trials""")
def _(spark, sf):
    c = F.col("confidence")
    return V.trials(spark, sf).select(
        "trial_id", F.abs(c - 50).alias("distance"), F.greatest(c, F.lit(10)).alias("at_least"),
        F.least(c, F.lit(90)).alias("at_most"), F.expr("confidence div 2").alias("half"),
        F.round(F.pow(c, 2) / 7.0, 4).alias("scaled"))


@query("f_hash_seed_int", T + """SELECT DISTINCT dataset, synthetic_method AS method, condition,
 ('0x' || substr(sha256(concat_ws('||', '2026', dataset, synthetic_method, condition)), 1, 8))::BIGINT AS seed FROM trials""")
def _(spark, sf):
    from tablejury.functions.digests import seed_int
    return raw(spark, sf).select("dataset", "method", "condition").distinct() \
        .withColumn("seed", seed_int(F.lit(2026), "dataset", "method", "condition"))


@query("f_fmt_percent", T + """SELECT synthetic_method AS method, printf('%.1f%%', 100.0*avg(correct::INT)) AS shown, printf('%.4f', avg(correct::INT)) AS fixed FROM trials GROUP BY 1""")
def _(spark, sf):
    acc = F.avg(S.hit())
    return raw(spark, sf).groupBy("method").agg(F.format_string("%.1f%%", acc * 100).alias("shown"),
                                                F.format_string("%.4f", acc).alias("fixed"))


