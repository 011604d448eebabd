"""Queries over samples, queues, backfill, prompts, verdict text, red flags and themes."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.operators import backfill as B, metrics as M, prompts as R, reasoning as N, sampling as Q
from tablejury.plans import views as V
from tablejury.plans.catalog_trials import T, raw, rounded
from tablejury.plans.experiment import run_experiment
from tablejury.plans.registry import query
from tablejury.schema import CONDITIONS, METHODS

MI = V.with_ctes(V.MICRO)
COLUMNS = ["acctbal", "nation", "segment"]


# ---- samples -------------------------------------------------------------------

@query("t1_exact_sample", MI + """SELECT source, row_id, acctbal FROM micro WHERE source = 'real'
 ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR))), row_id LIMIT 20""")
def _(spark, sf):
    real = V.micro(spark, sf).filter("source = 'real'").select("source", "row_id", "acctbal")
    return Q.exact_sample(real, 20, 42, ["row_id"])


@query("t1_large_sample", """SELECT l_orderkey, l_linenumber FROM lineitem
 ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_orderkey, l_linenumber LIMIT 32561""")
def _(spark, sf):
    return Q.exact_sample(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 32561, 42,
                          ["l_orderkey", "l_linenumber"])


@query("k9_shown_rows", MI + """SELECT * FROM (SELECT row_id, acctbal, nation, segment FROM micro WHERE source = 'tvae'
 ORDER BY md5(concat_ws('|', '7', CAST(row_id AS VARCHAR))), row_id LIMIT 20) s ORDER BY row_id""")
def _(spark, sf):
    return Q.shown_rows(V.micro(spark, sf).filter("source = 'tvae'").select("row_id", *COLUMNS), 20, 7, ["row_id"])


@query("t1_sample_per_table", MI + """SELECT source, row_id, acctbal FROM (SELECT *, row_number() OVER (PARTITION BY source
 ORDER BY md5(concat_ws('|', '42', source, CAST(row_id AS VARCHAR))), row_id) AS rn FROM micro) r WHERE rn <= 20""")
def _(spark, sf):
    return Q.sample_per_group(V.micro(spark, sf), ["source"], 20, 42, ["row_id"]).select("source", "row_id", "acctbal")


_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


@query("t2_fraction_samples", "SELECT m AS method, c_custkey AS row_id FROM customer CROSS JOIN (SELECT unnest(['ctgan','tvae','cart','great','tabddpm']) AS m) ms WHERE "
       + _UNIT.format("concat_ws('|', '42', m, CAST(c_custkey AS VARCHAR))") + " < 0.9")
def _(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return Q.fraction_samples(c, ("ctgan", "tvae", "cart", "great", "tabddpm"), 0.9, 42, ["row_id"]) \
        .select("method", "row_id")


# ---- queues and resume ------------------------------------------------------------

TARGETS = "targets AS (SELECT synthetic_method AS method, count(*) AS n_trials FROM trials GROUP BY 1)"
QUEUE = """queue AS (SELECT method, c AS condition, l AS true_label, rep FROM targets, (SELECT unnest(['C1','C2']) AS c) cs,
 (SELECT unnest(['REAL','SYNTHETIC']) AS l) ls, LATERAL (SELECT unnest(range(1, n_trials//2 + 1)) AS rep) r)"""
NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY md5(concat_ws('|', '42', method, condition, true_label, CAST(rep AS VARCHAR))),
 condition, true_label, rep) - 1 AS trial_id FROM queue)"""
QU = V.with_ctes(V.TRIALS, TARGETS, QUEUE, NUMBERED)


def targets(spark, sf):
    """As many trials per method as the log holds."""
    return raw(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n_trials"))


@query("j8_balanced_queue", QU + "SELECT method, condition, true_label, count(*) AS n, CAST(max(rep) AS BIGINT) AS last_rep FROM queue GROUP BY 1, 2, 3")
def _(spark, sf):
    return Q.balanced_queue(targets(spark, sf)).groupBy("method", "condition", "true_label") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("rep").alias("last_rep"))


@query("t3_shuffled_queue", QU + "SELECT method, condition, true_label, rep, trial_id FROM numbered")
def _(spark, sf):
    return Q.trial_queue(targets(spark, sf), 42)


@query("w9_sequential_trial_ids", QU + "SELECT method, trial_id, condition, true_label FROM numbered")
def _(spark, sf):
    return Q.trial_queue(targets(spark, sf), 42).select("method", "trial_id", "condition", "true_label")


@query("t4_annotator_queue", """WITH cards AS (SELECT annotator_id, method, card, CASE WHEN card <= 10 THEN 'REAL' ELSE 'SYNTHETIC' END AS true_label,
 row_number() OVER (PARTITION BY annotator_id, method ORDER BY md5(concat_ws('|', '5', CAST(annotator_id AS VARCHAR), method, CAST(card AS VARCHAR))), card) AS pair_id
 FROM (SELECT DISTINCT user_id AS annotator_id FROM events) u, (SELECT unnest(['ctgan','tvae','gaussian_copula']) AS method) m, (SELECT unnest(range(1, 21)) AS card) c)
 SELECT annotator_id, method, CAST(pair_id AS INT) AS pair_id, true_label,
 ('0x' || substr(sha256(concat_ws('||', '5', CAST(annotator_id AS VARCHAR), method, CAST(pair_id AS VARCHAR))), 1, 8))::BIGINT AS sample_seed FROM cards WHERE pair_id <= 10""")
def _(spark, sf):
    sessions = V.table(spark, sf, "events").select(F.col("user_id").alias("annotator_id")).distinct() \
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    return Q.annotator_queue(sessions, 10, 5)


RUN = "dataset, provider, model"
RUNS = f"""targets AS (SELECT {RUN}, synthetic_method AS method, count(*) AS n_trials FROM trials GROUP BY ALL),
 queue AS (SELECT {RUN}, method, c AS condition, l AS true_label, rep FROM targets, (SELECT unnest(['C1','C2']) AS c) cs,
 (SELECT unnest(['REAL','SYNTHETIC']) AS l) ls, LATERAL (SELECT unnest(range(1, n_trials//2 + 1)) AS rep) r),
 done AS (SELECT {RUN}, synthetic_method AS method, condition, true_label, trial_id, row_number() OVER (PARTITION BY {RUN}, synthetic_method, condition, true_label
 ORDER BY md5(concat_ws('|', '42', CAST(trial_id AS VARCHAR))), trial_id) AS rep FROM trials WHERE predicted_label <> 'ERROR')"""
DONE = """done AS (SELECT synthetic_method AS method, condition, true_label, trial_id, row_number() OVER (PARTITION BY synthetic_method, condition, true_label
 ORDER BY md5(concat_ws('|', '42', CAST(trial_id AS VARCHAR))), trial_id) AS rep FROM trials WHERE predicted_label <> 'ERROR')"""
RES = V.with_ctes(V.TRIALS, RUNS)


def run_queue(spark, sf):
    """A queue for every run (data set, provider, model), with as many trials per method as its log holds."""
    return Q.balanced_queue(raw(spark, sf).groupBy(*B.RUN, "method").agg(F.count(F.lit(1)).alias("n_trials")))


@query("j10_remaining_queue", RES + f"SELECT {RUN}, method, condition, true_label, rep FROM queue ANTI JOIN done USING ({RUN}, method, condition, true_label, rep)")
def _(spark, sf):
    return B.remaining_queue(run_queue(spark, sf), B.completed_slots(raw(spark, sf), 42))


@query("x9_resume_summary", RES + f"""SELECT {RUN}, method, condition, true_label, count(d.trial_id) AS n_kept, count(*) - count(d.trial_id) AS n_remaining
 FROM queue q LEFT JOIN done d USING ({RUN}, method, condition, true_label, rep) GROUP BY ALL""")
def _(spark, sf):
    return B.resume_summary(run_queue(spark, sf), B.completed_slots(raw(spark, sf), 42))


@query("x10_backfill_plan", T + """, counts AS (SELECT provider, model, synthetic_method AS method, condition, count(*) FILTER (predicted_label IN ('REAL','SYNTHETIC')) AS valid FROM trials GROUP BY ALL),
 total AS (SELECT count(*) // 24 AS goal FROM trials), grid AS (SELECT DISTINCT provider, model, m AS method, c AS condition FROM trials, (SELECT unnest(['ctgan','tvae','gaussian_copula']) AS m) ms, (SELECT unnest(['C1','C2']) AS c) cs),
 g AS (SELECT provider, model, method, condition, coalesce(valid, 0) AS valid, greatest(0, goal - coalesce(valid, 0)) AS gap FROM grid LEFT JOIN counts USING (provider, model, method, condition), total)
 SELECT provider, model, method, condition, valid, gap, CASE WHEN gap > 0 THEN greatest(10, gap) + greatest(10, gap) % 2 ELSE 0 END AS batch_trials,
 CASE WHEN gap = 0 THEN 'OK' ELSE 'RUN' END AS action, CAST(CASE WHEN gap > 0 THEN least(3, ceil(gap*1.0/(greatest(10, gap) + greatest(10, gap) % 2))) ELSE 0 END AS INT) AS n_batches FROM g""")
def _(spark, sf):
    t = raw(spark, sf)
    goal = t.count() // 24
    grid = t.select("provider", "model").distinct() \
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))) \
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    return B.backfill_plan(grid, t, goal, 10, 3)


@query("x11_failed_batches", T + """SELECT trial_id // 2 AS batch, count(*) AS n, bool_and(predicted_label NOT IN ('REAL','SYNTHETIC')) AS all_errored FROM trials GROUP BY 1""")
def _(spark, sf):
    return B.failed_batches(V.trials(spark, sf), F.floor(F.col("trial_id") / 2).alias("batch"))


# ---- verdict text --------------------------------------------------------------------

RV = V.with_ctes(V.TRIALS, V.REASONED)


def reasoned(spark, sf):
    return N.parse_verdicts(V.raw_verdicts(spark, sf), raw(spark, sf))


@query("f_fence_strip", V.with_ctes(V.RAW_VERDICTS) + "SELECT trial_id, trim(replace(replace(raw, '```json', ''), '```', ''), chr(10) || ' ') AS bare FROM raw_verdicts")
def _(spark, sf):
    return V.raw_verdicts(spark, sf).select("trial_id", S.strip_fences("raw").alias("bare"))


@query("f_json_round_trip", RV + "SELECT trial_id, verdict, confidence FROM reasoned WHERE verdict <> 'ERROR'")
def _(spark, sf):
    text = V.raw_verdicts(spark, sf).select("trial_id", F.to_json(S.parse_verdict("raw")).alias("j"))
    parsed = text.select("trial_id", S.parse_verdict("j").alias("v")).filter(F.col("v.verdict").isNotNull())
    return parsed.select("trial_id", F.upper("v.verdict").alias("verdict"), F.col("v.confidence").alias("confidence"))


@query("f_arr_functions", RV + """SELECT trial_id, CAST(len(red_flags) AS INT) AS n_flags, array_to_string(red_flags[1:1], '; ') AS first_flag,
 array_to_string(red_flags, '; ') AS joined FROM reasoned""")
def _(spark, sf):
    return reasoned(spark, sf).select(
        "trial_id", F.size("red_flags").alias("n_flags"), F.array_join(F.slice("red_flags", 1, 1), "; ").alias("first_flag"),
        F.array_join("red_flags", "; ").alias("joined"))


@query("x7_parse_verdicts", RV + "SELECT trial_id, dataset, provider, method, condition, true_label, verdict, correct, confidence FROM reasoned")
def _(spark, sf):
    return reasoned(spark, sf).drop("reasoning", "red_flags", "supporting_evidence")


@query("x12_explode_flags", RV + "SELECT trial_id, provider, method, condition, true_label, correct, unnest(red_flags) AS flag FROM reasoned")
def _(spark, sf):
    return N.explode_flags(reasoned(spark, sf))


@query("x12_sample_flags", RV + """SELECT trial_id, correct, flag FROM (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY md5(concat_ws('|', '3', CAST(trial_id AS VARCHAR), flag)), trial_id, flag) AS rn
 FROM (SELECT trial_id, correct, unnest(red_flags) AS flag FROM reasoned) f) r WHERE rn <= 5""")
def _(spark, sf):
    return N.sample_flags(N.explode_flags(reasoned(spark, sf)), 5, 3).select("trial_id", "correct", "flag")


@query("a40_flag_totals", RV + "SELECT CAST(sum(len(red_flags)) AS BIGINT) AS n_flags, count(*) AS n_trials, round(sum(len(red_flags))*1.0/count(*), 6) AS flags_per_trial FROM reasoned")
def _(spark, sf):
    return rounded(N.flag_totals(reasoned(spark, sf)))


@query("k3_top_flags", RV + "SELECT phrase, count(*) AS n FROM (SELECT substring(lower(unnest(red_flags)), 1, 90) AS phrase FROM reasoned) f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return N.top_flags(N.explode_flags(reasoned(spark, sf)))


FLAG_THEMES = {"errors": ["error"], "engagement": ["click", "view"], "conversion": ["signup", "purchase"],
               "low band": ["band 0", "band 1", "band 2"]}


def _tagged(source, text, themes, keep):
    def test(words):
        return " OR ".join("contains({}, '{}')".format(text, w.lower().replace("'", "''")) for w in words)
    return " UNION ALL ".join("SELECT {}, '{}' AS theme FROM {} WHERE {}".format(keep, t, source, test(w))
                              for t, w in themes.items())


_FLAGTEXT = "lower(array_to_string(red_flags, ' '))"


@query("j11_theme_matches", RV + _tagged("reasoned", _FLAGTEXT, FLAG_THEMES, "trial_id, provider, condition"))
def _(spark, sf):
    return N.tag_themes(reasoned(spark, sf), FLAG_THEMES).select("trial_id", "provider", "condition", "theme")


_SCOPED = """, hits AS (SELECT scope, theme, count(*) AS hits FROM (SELECT 'all' AS scope, theme FROM tagged UNION ALL SELECT provider, theme FROM tagged) s GROUP BY 1, 2),
 sizes AS (SELECT scope, count(*) AS n FROM (SELECT 'all' AS scope FROM reasoned UNION ALL SELECT provider FROM reasoned) s GROUP BY 1)
 SELECT scope, theme, n, coalesce(hits, 0) AS hits, round(100.0*coalesce(hits, 0)/n, 6) AS pct FROM sizes CROSS JOIN (SELECT unnest([{names}]) AS theme) t LEFT JOIN hits USING (scope, theme)"""


def _names(themes):
    return ", ".join(f"'{t}'" for t in themes)


@query("a41_theme_counts", RV.rstrip() + ", tagged AS (" + _tagged("reasoned", _FLAGTEXT, FLAG_THEMES, "trial_id, provider") + ")" + _SCOPED.format(names=_names(FLAG_THEMES)))
def _(spark, sf):
    return rounded(N.theme_counts(reasoned(spark, sf), FLAG_THEMES))


@query("k6_theme_ranking", RV.rstrip() + ", tagged AS (" + _tagged("reasoned", _FLAGTEXT, FLAG_THEMES, "trial_id") + """)
 SELECT theme, n, hits, round(100.0*hits/n, 6) AS pct FROM (SELECT theme, count(*) AS hits FROM tagged GROUP BY 1) h, (SELECT count(*) AS n FROM reasoned) c ORDER BY hits DESC, theme""")
def _(spark, sf):
    return rounded(N.theme_ranking(reasoned(spark, sf), FLAG_THEMES))


@query("a41_theme_by_condition", RV.rstrip() + ", tagged AS (" + _tagged("reasoned", _FLAGTEXT, {"low band": FLAG_THEMES["low band"]}, "trial_id, provider, condition") + """)
 SELECT condition, n, coalesce(hits, 0) AS hits, round(100.0*coalesce(hits, 0)/n, 6) AS pct FROM (SELECT condition, count(*) AS n FROM reasoned WHERE provider = 'google' GROUP BY 1) s
 LEFT JOIN (SELECT condition, count(*) AS hits FROM tagged WHERE provider = 'google' GROUP BY 1) h USING (condition)""")
def _(spark, sf):
    return rounded(N.theme_by_condition(reasoned(spark, sf), FLAG_THEMES, "low band", "google"))


@query("w4_theme_examples", RV.rstrip() + ", tagged AS (" + _tagged("reasoned", _FLAGTEXT, FLAG_THEMES, "*") + """)
 SELECT theme, trial_id, provider, method, condition, correct, substring(array_to_string(red_flags[1:3], '; '), 1, 120) AS flags, '' AS snippet FROM (
 SELECT *, row_number() OVER (PARTITION BY theme ORDER BY provider <> 'google', NOT correct, trial_id) AS rn FROM tagged) r WHERE rn = 1""")
def _(spark, sf):
    return N.theme_examples(reasoned(spark, sf), FLAG_THEMES)


_DOCS = "docs AS (SELECT doc_id AS trial_id, source AS provider, lang AS condition, lower(text) AS body FROM documents)"


@query("x13_document_themes", V.with_ctes(_DOCS) + _tagged("docs", "body", N.THEMES, "trial_id, provider"))
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("trial_id"), F.col("source").alias("provider"), "text")
    return N.tag_themes(d, N.THEMES, F.col("text")).select("trial_id", "provider", "theme")


@query("x13_document_theme_counts", V.with_ctes(_DOCS.replace("docs AS", "reasoned AS")).rstrip() + ", tagged AS (" + _tagged("reasoned", "body", N.THEMES, "trial_id, provider") + ")" + _SCOPED.format(names=_names(N.THEMES)))
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("trial_id"), F.col("source").alias("provider"), "text")
    return rounded(N.theme_counts(d, N.THEMES, F.col("text")))


_REPORT = """priv AS (SELECT CASE WHEN grouping(synthetic_method) = 1 THEN 'all' ELSE synthetic_method END AS scope,
 100 - 100.0*avg(correct::INT) FILTER (condition='C1') AS c1, 100 - 100.0*avg(correct::INT) FILTER (condition='C2') AS c2
 FROM trials GROUP BY GROUPING SETS ((), (synthetic_method)))"""


@query("x14_condition_report", V.with_ctes(V.TRIALS, _REPORT) + """SELECT 0 AS section, scope, 0 AS position, printf('C1 privacy score: %.2f%%', c1) AS line FROM priv WHERE scope = 'all'
 UNION ALL SELECT 0, scope, 1, printf('C2 privacy score: %.2f%%', c2) FROM priv WHERE scope = 'all'
 UNION ALL SELECT 0, scope, 2, printf('Absolute degradation: %.2f percentage points', c1 - c2) FROM priv WHERE scope = 'all'
 UNION ALL SELECT 0, scope, 3, printf('Relative degradation: %.2f%% of C1 privacy', (c1 - c2)/c1*100) FROM priv WHERE scope = 'all'
 UNION ALL SELECT 1, scope, 0, printf('%s: C1 %.2f%%, C2 %.2f%%, degradation %.2fpp (%.1f%%)', scope, c1, c2, c1 - c2, (c1 - c2)/c1*100) FROM priv WHERE scope <> 'all'""")
def _(spark, sf):
    return N.condition_report(M.condition_impact(raw(spark, sf)))


# ---- prompts ----------------------------------------------------------------------------

_ROW = "'| ' || concat_ws(' | ', CAST(acctbal AS VARCHAR), CAST(nation AS VARCHAR), segment) || ' |'"
_SAMPLED = """sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source
 ORDER BY md5(concat_ws('|', '42', source, CAST(row_id AS VARCHAR))), row_id) AS rn FROM micro) r WHERE rn <= 20)"""


@query("x3_row_tables", V.with_ctes(V.MICRO, _SAMPLED) + f"""SELECT source, CAST(count(*) AS INT) AS n_shown,
 '| acctbal | nation | segment |' || chr(10) || '|---|---|---|' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY row_id) AS table_text FROM sampled GROUP BY 1""")
def _(spark, sf):
    sample = Q.sample_per_group(V.micro(spark, sf), ["source"], 20, 42, ["row_id"])
    return R.row_table(sample, ["source"], COLUMNS, "row_id")


@query("x2_profile_text")
def _(spark, sf):
    return R.profile_text(V.micro(spark, sf), ["source"], COLUMNS, "row_id")


def _requests(spark, sf, condition):
    """One prompt request per annotation pair of the log: pair id and the table it looks at."""
    e = V.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("trial_id"), F.lit(condition).alias("condition"),
                    F.when(F.col("event_id") % 2 == 0, "real")
                    .when(F.col("event_id") % 3 == 0, "ctgan").when(F.col("event_id") % 5 == 0, "gaussian_copula").otherwise("tvae").alias("source"))


def _wanted(key):
    """Every request's own positions, drawn without replacement (Floyd's method), each beside the request's columns."""
    drawn = f"('0x' || substr(sha256(concat_ws('||', '42', {key}, CAST(j AS VARCHAR))), 1, 15))::BIGINT"
    return f"""idx AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', source, CAST(row_id AS VARCHAR))), row_id) - 1 AS pos FROM micro),
 sizes AS (SELECT source, count(*) AS n_total, least(20, count(*)) AS k FROM micro GROUP BY 1),
 want AS (SELECT r.*, n_total, unnest(list_reduce(list_transform(range(k), lambda j: [{drawn} % (n_total - k + j + 1), n_total - k + j]),
  lambda taken, d: list_append(taken, CASE WHEN list_contains(taken, d[1]) THEN d[2] ELSE d[1] END), []::BIGINT[])) AS pos FROM req r JOIN sizes USING (source))"""


_C1 = """req AS (SELECT event_id AS trial_id, 'C1' AS condition, CASE WHEN event_id % 2 = 0 THEN 'real' WHEN event_id % 3 = 0 THEN 'ctgan' WHEN event_id % 5 = 0 THEN 'gaussian_copula' ELSE 'tvae' END AS source FROM events),
 """ + _wanted("CAST(trial_id AS VARCHAR)")


@query("x4_c1_prompts", V.with_ctes(V.MICRO, _C1) + f"""SELECT trial_id, condition, source, CAST(count(*) AS INT) AS n_shown, n_total,
 'Is this table REAL or SYNTHETIC?' || chr(10) || chr(10) || printf('Rows shown: %d of %d', count(*), n_total) || chr(10) || '| acctbal | nation | segment |' || chr(10) || '|---|---|---|' || chr(10)
 || string_agg({_ROW}, chr(10) ORDER BY row_id) || chr(10) || chr(10) || printf('Total rows: %d', n_total) || chr(10) || 'Total columns: 3' || chr(10) || 'Columns: acctbal, nation, segment' || chr(10) AS prompt
 FROM want JOIN idx USING (source, pos) GROUP BY trial_id, condition, source, n_total""")
def _(spark, sf):
    index = R.row_index(V.micro(spark, sf), 42, "row_id", COLUMNS)
    return R.build_prompts(_requests(spark, sf, "C1"), index, ["trial_id"], COLUMNS, F.col("condition"))


@query("x5_c2_prompts")
def _(spark, sf):
    micro = V.micro(spark, sf)
    profiles = R.profile_text(micro, ["source"], COLUMNS, "row_id")
    index = R.row_index(micro, 42, "row_id", COLUMNS)
    return R.build_prompts(_requests(spark, sf, "C2"), index, ["trial_id"], COLUMNS, F.col("condition"), profiles)


@query("x6_judged_prompts", V.with_ctes(V.MICRO, _C1) + """, shown AS (SELECT trial_id, source, count(*) FILTER (regexp_matches(CAST(acctbal AS VARCHAR), '[0-9]\\.[0-9]{4,}')) AS tails,
 count(*) - count(DISTINCT concat_ws('|', CAST(acctbal AS VARCHAR), CAST(nation AS VARCHAR), segment)) AS repeats FROM want JOIN idx USING (source, pos) GROUP BY 1, 2)
 SELECT trial_id, source, CASE WHEN tails + repeats > 0 THEN 'SYNTHETIC' ELSE 'REAL' END AS verdict,
 CAST(CASE WHEN tails + repeats > 0 THEN least(95, 55 + 5*(tails + repeats)) ELSE 60 END AS DOUBLE) AS confidence FROM shown""")
def _(spark, sf):
    index = R.row_index(V.micro(spark, sf), 42, "row_id", COLUMNS)
    prompts = R.build_prompts(_requests(spark, sf, "C1"), index, ["trial_id"], COLUMNS, F.col("condition"))
    v = S.parse_verdict("raw")
    return R.judge_prompts(prompts).select("trial_id", "source", v["verdict"].alias("verdict"),
                                           v["confidence"].alias("confidence"))


def _judged(run=""):
    """Trials of the queue judged by the offline rules; `run` names the columns that tell runs apart."""
    return f"""req AS (SELECT *, CASE true_label WHEN 'REAL' THEN 'real' ELSE method END AS source FROM numbered),
 {_wanted(run + "method, condition, true_label, CAST(rep AS VARCHAR)")},
 seen AS (SELECT {run}method, trial_id, condition, true_label, rep, count(*) FILTER (regexp_matches(CAST(acctbal AS VARCHAR), '[0-9]\\.[0-9]{{4,}}'))
  + count(*) - count(DISTINCT concat_ws('|', CAST(acctbal AS VARCHAR), CAST(nation AS VARCHAR), segment)) AS signs FROM want JOIN idx USING (source, pos) GROUP BY ALL),
 judged AS (SELECT {run}method AS synthetic_method, trial_id, condition, true_label, rep, CASE WHEN signs > 0 THEN 'SYNTHETIC' ELSE 'REAL' END AS predicted_label,
  (signs > 0) = (true_label = 'SYNTHETIC') AS correct, CAST(CASE WHEN signs > 0 THEN least(95, 55 + 5*signs) ELSE 60 END AS DOUBLE) AS confidence FROM seen)"""


@query("x8_experiment", V.with_ctes(V.TRIALS, TARGETS, QUEUE, NUMBERED, V.MICRO, _judged())
       + "SELECT synthetic_method, trial_id, condition, true_label, predicted_label, correct, confidence FROM judged")
def _(spark, sf):
    trials = run_experiment(V.micro(spark, sf), targets(spark, sf), COLUMNS, "row_id", "offline", "rules")
    return trials.select("synthetic_method", "trial_id", "condition", "true_label", "predicted_label", "correct", "confidence")


_RUNS_NUMBERED = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {RUN}, method ORDER BY md5(concat_ws('|', '42', {RUN}, method, condition, true_label, CAST(rep AS VARCHAR))),
 condition, true_label, rep) - 1 AS trial_id FROM queue)"""


@query("x8_experiment_summary", V.with_ctes(V.TRIALS, RUNS, _RUNS_NUMBERED, V.MICRO, _judged(RUN + ", ")) + f"""SELECT synthetic_method, condition, grouping_id(synthetic_method, condition) AS level,
 CAST(sum(correct::INT) AS BIGINT) AS n_correct, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM judged j
 WHERE NOT EXISTS (SELECT 1 FROM done d WHERE ({", ".join("d." + c for c in RUN.split(", "))}) = ({", ".join("j." + c for c in RUN.split(", "))})
 AND d.method = j.synthetic_method AND d.condition = j.condition AND d.true_label = j.true_label AND d.rep = j.rep)
 GROUP BY GROUPING SETS ((synthetic_method), (condition), (synthetic_method, condition), ())""")
def _(spark, sf):
    """Every run of the log is resumed: its own successes fill its own queue, the rest is judged."""
    log = raw(spark, sf)
    wanted = log.groupBy(*B.RUN, "method").agg(F.count(F.lit(1)).alias("n_trials"))
    trials = run_experiment(V.micro(spark, sf), wanted, COLUMNS, "row_id", done=B.completed_slots(log, 42))
    return rounded(M.accuracy_sets(trials, ["synthetic_method", "condition"], [("synthetic_method", "condition")]))
