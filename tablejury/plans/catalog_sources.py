"""Queries that go through files (written from the given tables to the shared folder), generators and streams."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tablejury.operators import metrics as M, synth as G
from tablejury.plans import views as V
from tablejury.plans.catalog_trials import AP, T, approved, raw, rounded
from tablejury.plans.registry import query
from tablejury.schema import ANNOTATION, FORMAL_METHOD_NAMES, TRIAL
from tablejury.session import shared_folder
from tablejury.sources import audit as A, readers as R, sinks as K
from tablejury.streaming import progress as L

MICRO_SCHEMA = StructType([StructField("row_id", LongType()), StructField("acctbal", DoubleType()),
                           StructField("nation", DoubleType()), StructField("segment", StringType())])
MI = V.with_ctes(V.MICRO)


def _micro_columns(df):
    return df.select(*MICRO_SCHEMA.names)


@query("s1_micro_csv", MI + "SELECT row_id, acctbal, nation, segment FROM micro WHERE source = 'real'")
def _(spark, sf):
    path = shared_folder(spark, "real") + "/adult.csv"
    K.write_csv(_micro_columns(V.micro(spark, sf).filter("source = 'real'")), path)
    return R.read_micro_csv(spark, path, MICRO_SCHEMA)


@query("s2_headerless_csv", "SELECT c_custkey AS row_id, c_acctbal AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment FROM customer")
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    segment = F.when(F.col("c_custkey") % 11 == 0, "?").otherwise(F.col("c_mktsegment"))
    path = shared_folder(spark, "headerless")
    c.select(F.concat_ws(",  ", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"),
                         F.col("c_nationkey").cast("double").cast("string"), segment).alias("value")).write.text(path)
    return R.read_headerless_csv(spark, path, MICRO_SCHEMA)


@query("s3_first_readable", MI + "SELECT row_id, acctbal, nation, segment FROM micro WHERE source = 'tvae'")
def _(spark, sf):
    root = shared_folder(spark, "fallback")
    K.write_csv(_micro_columns(V.micro(spark, sf).filter("source = 'tvae'")), root + "/second.csv")
    return R.first_readable(spark, [root + "/first.csv", root + "/second.csv"],
                            lambda s, p: R.read_micro_csv(s, p, MICRO_SCHEMA))


# ---- judged trials in JSON lines -------------------------------------------------------

def trial_lines(spark, sf):
    """Each trial as a JSON line, every 50th one cut short, with the folder and provider it belongs to."""
    t = V.trials(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    record = F.to_json(F.struct(*[c for c in TRIAL.names if c in t.columns]))
    folder = F.when(F.col("trial_id") % 23 == 0, "adult/archive_invalid_2026") \
        .when(F.col("trial_id") % 29 == 0, "res1").otherwise(F.col("dataset"))
    return t.select("trial_id", "provider", "dataset", folder.alias("folder"),
                    F.when(F.col("trial_id") % 50 == 7, F.substring(record, 1, 30)).otherwise(record).alias("value"))


def trial_folder(spark, sf):
    root = shared_folder(spark, "trials")
    lines = trial_lines(spark, sf)
    for folder in ("adult", "census", "adult/archive_invalid_2026", "res1"):
        for provider in ("google", "groq"):
            lines.filter((F.col("folder") == folder) & (F.col("provider") == provider)).select("value") \
                .write.text(f"{root}/{folder}/llm_results_all_{provider}_1.jsonl")
    return root


_KEPT = "trial_id % 23 <> 0 AND trial_id % 29 <> 0 AND trial_id % 50 <> 7"


@query("s4_jsonl_skip_bad_lines", T + f"SELECT trial_id, provider, model, synthetic_method, condition, true_label, predicted_label, correct, CAST(confidence AS DOUBLE) AS confidence FROM trials WHERE {_KEPT}")
def _(spark, sf):
    return R.read_trials(spark, trial_folder(spark, sf) + "/{adult,census}/llm_results_*.jsonl").select(
        "trial_id", "provider", "model", "synthetic_method", "condition", "true_label", "predicted_label", "correct", "confidence")


@query("s5_jsonl_name_pattern", T + f"SELECT provider, count(*) AS n FROM trials WHERE {_KEPT} AND provider = 'groq' AND dataset = 'census' GROUP BY 1")
def _(spark, sf):
    return R.read_trials(spark, trial_folder(spark, sf) + "/census", name_pattern="groq") \
        .groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("s6_jsonl_strict", T + "SELECT trial_id, predicted_label, correct FROM trials WHERE trial_id % 50 <> 7")
def _(spark, sf):
    path = shared_folder(spark, "strict")
    trial_lines(spark, sf).filter("trial_id % 50 <> 7").select("value").write.text(path)
    return R.read_trials(spark, path, bad_lines="fail").select("trial_id", "predicted_label", "correct")


@query("s7_recursive_with_exclusions", T + f"SELECT dataset, provider, count(*) AS n FROM trials WHERE {_KEPT} GROUP BY 1, 2")
def _(spark, sf):
    rows = R.with_provenance(R.read_trials(spark, trial_folder(spark, sf), recursive=True))
    return rows.groupBy("dataset", "provider").agg(F.count(F.lit(1)).alias("n"))


@query("s8_provenance", T + f"SELECT dataset, provider AS provider_tag, 'llm_results_all_' || provider || '_1.jsonl' AS source_file, count(*) AS n FROM trials WHERE {_KEPT} GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = R.with_provenance(R.read_trials(spark, trial_folder(spark, sf) + "/{adult,census}/llm_results_*.jsonl"))
    return rows.groupBy("dataset", "provider_tag", "source_file").agg(F.count(F.lit(1)).alias("n"))


@query("p19_without_human_files", T + f"SELECT dataset, count(*) AS n FROM trials WHERE {_KEPT} AND dataset = 'adult' GROUP BY 1")
def _(spark, sf):
    root = trial_folder(spark, sf)
    trial_lines(spark, sf).filter("dataset = 'census'").select("value").write.text(root + "/adult/human_results.jsonl")
    rows = R.without_human_files(R.read_trials(spark, root + "/adult/*.jsonl"))
    return R.with_provenance(rows).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def _micro_columns_of_methods(spark, sf):
    return V.micro(spark, sf).filter("source <> 'real'").select(F.col("source").alias("method"), *MICRO_SCHEMA.names)


def method_folders(spark, sf):
    root = shared_folder(spark, "synthetic")
    K.write_methods(_micro_columns_of_methods(spark, sf), root)
    return root


@query("s9_discover_methods", MI + """SELECT source AS method, CASE source WHEN 'ctgan' THEN 'CTGAN' WHEN 'tvae' THEN 'TVAE' ELSE 'GaussianCopula' END AS method_name,
 count(*) AS n_rows, round(sum(acctbal), 4) AS total FROM micro WHERE source <> 'real' GROUP BY 1""")
def _(spark, sf):
    rows = R.read_methods(spark, method_folders(spark, sf), MICRO_SCHEMA, FORMAL_METHOD_NAMES)
    return rows.groupBy("method", "method_name").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("acctbal"), 4).alias("total"))


@query("s10_validate_methods", MI + """SELECT m AS method, n IS NOT NULL AS exists, n AS n_rows, CASE WHEN n IS NOT NULL THEN CAST(4 AS INT) END AS n_columns
 FROM (SELECT unnest(['ctgan','tvae','cart','great','tabddpm']) AS m) e LEFT JOIN (SELECT source, count(*) AS n FROM micro GROUP BY 1) c ON source = m""")
def _(spark, sf):
    return A.validate_methods(R.read_methods(spark, method_folders(spark, sf), MICRO_SCHEMA).drop("method_name"))


_INVENTORY = """SELECT source, count(*) AS n_rows, CAST(4 AS INT) AS n_columns, c AS "column", t AS dtype, CAST(i AS INT) AS position FROM micro,
 (VALUES ('row_id','bigint',0),('acctbal','double',1),('nation','double',2),('segment','string',3)) v(c, t, i) GROUP BY ALL"""


@query("s11_inventory", MI + _INVENTORY)
def _(spark, sf):
    return A.inventory(V.micro(spark, sf))


@query("s11_inventory_documents", MI + """SELECT source, '{"source":"' || source || '","n_rows":' || count(*) || ',"n_columns":4,"columns":[{"column":"row_id","dtype":"bigint"},{"column":"acctbal","dtype":"double"},{"column":"nation","dtype":"double"},{"column":"segment","dtype":"string"}]}' AS document FROM micro GROUP BY 1""")
def _(spark, sf):
    return A.inventory_documents(A.inventory(V.micro(spark, sf)))


@query("s12_annotation_files", V.with_ctes(V.ANNOTATIONS) + "SELECT source_path, annotator_id, count(*) AS n, count(CASE WHEN trim(notes) <> '' THEN 1 END) AS n_notes, CAST(sum(correct::INT) AS BIGINT) AS n_correct FROM annotations GROUP BY 1, 2")
def _(spark, sf):
    root = shared_folder(spark, "annotations")
    rows = V.annotations(spark, sf).withColumn("n_rows_shown", F.lit(20)).withColumn("timestamp", F.lit("2026-05-30T12:00:00"))
    for name in ("a.csv", "b.csv"):
        K.write_csv(rows.filter(F.col("source_path") == name).select(*ANNOTATION.names), f"{root}/{name}")
    return R.read_annotations(spark, root + "/*.csv").groupBy("source_path", "annotator_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim("notes") != "").alias("n_notes"),
        F.sum(F.col("correct").cast("int")).alias("n_correct"))


@query("s13_append_only_log", T + "SELECT trial_id, predicted_label FROM trials UNION ALL SELECT trial_id, predicted_label FROM trials WHERE condition = 'C2'")
def _(spark, sf):
    path = shared_folder(spark, "log")
    t = V.trials(spark, sf)
    K.append_trials(t, path)
    K.append_trials(t.filter("condition = 'C2'"), path)
    return R.read_trials(spark, path).select("trial_id", "predicted_label")


@query("s14_csv_tables", AP + f"SELECT dataset, provider_label, method, condition, {V.METRICS} FROM approved GROUP BY ALL")
def _(spark, sf):
    cells = rounded(M.cell_metrics(approved(spark, sf)))
    path = shared_folder(spark, "table")
    K.write_csv(cells, path)
    return R.read_micro_csv(spark, path, cells.schema)


@query("s15_nested_documents", T + """SELECT condition, round(100.0*avg(correct::INT), 6) AS overall_accuracy, count(*) AS n_total, CAST(count(DISTINCT synthetic_method) AS INT) AS n_methods,
 CAST(count(DISTINCT true_label) AS INT) AS n_labels, round(100.0*avg(correct::INT) FILTER (synthetic_method = 'ctgan'), 6) AS first_method_accuracy FROM trials GROUP BY 1""")
def _(spark, sf):
    path = shared_folder(spark, "documents")
    K.write_documents(K.condition_documents(M.privacy_scores(raw(spark, sf))), path)
    entry = "array<struct<name string, accuracy double, privacy_score double, n_trials bigint>>"
    d = spark.read.text(path).select(F.from_json("value", f"condition string, overall_accuracy double, n_total bigint, by_method {entry}, by_label {entry}").alias("d"))
    return rounded(d.select("d.condition", "d.overall_accuracy", "d.n_total", F.size("d.by_method").alias("n_methods"),
                            F.size("d.by_label").alias("n_labels"), F.col("d.by_method")[0]["accuracy"].alias("first_method_accuracy")))


@query("s16_method_layout", MI + "SELECT source AS method, count(*) AS n_rows, round(sum(nation), 4) AS total FROM micro WHERE source <> 'real' GROUP BY 1")
def _(spark, sf):
    root = shared_folder(spark, "layout")
    K.write_methods(_micro_columns_of_methods(spark, sf), root)
    rows = R.read_methods(spark, root, MICRO_SCHEMA)
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("nation"), 4).alias("total"))


# ---- audit and quarantine ---------------------------------------------------------------

def audited_rows(spark, sf):
    """Result files with mixed models, read back with the folder of each line as its file."""
    root = shared_folder(spark, "audit")
    lines = trial_lines(spark, sf).select("value", "dataset", (F.col("trial_id") % 40).cast("string").alias("run"), F.md5(F.col("trial_id").cast("string")).alias("place"))
    # one file per run, whose lines do not follow their trial ids
    lines.repartition("dataset", "run").sortWithinPartitions("dataset", "run", "place").drop("place").write.partitionBy("dataset", "run").text(root)
    rows = R.read_trials(spark, root, bad_lines="keep", line_order=True)
    return rows.withColumn("source_path", F.regexp_extract("source_path", r"(dataset=[^/]+/run=[^/]+)/", 1))


_AUDIT = """audit AS (SELECT 'dataset=' || dataset || '/run=' || (trial_id % 40) AS source_path, coalesce(arg_max(provider, md5(CAST(trial_id AS VARCHAR))) FILTER (trial_id % 50 <> 7), '?') AS provider,
 coalesce(arg_max(model, md5(CAST(trial_id AS VARCHAR))) FILTER (trial_id % 50 <> 7), '?') AS model, count(*) AS total_lines,
 count(*) FILTER (trial_id % 50 <> 7 AND predicted_label IN ('REAL','SYNTHETIC')) AS valid_lines FROM trials GROUP BY 1)"""
_REASON = """CASE WHEN (provider, model) NOT IN (('groq','llama-3.1-8b-instant'),('google','gemini-2.5-flash')) THEN 'unapproved_model' END"""


@query("s17_file_audit", V.with_ctes(V.TRIALS, _AUDIT) + "SELECT * FROM audit")
def _(spark, sf):
    return A.audit_files(audited_rows(spark, sf))


@query("w10_last_seen_model", V.with_ctes(V.TRIALS, _AUDIT) + "SELECT source_path, provider, model FROM audit")
def _(spark, sf):
    return A.audit_files(audited_rows(spark, sf)).select("source_path", "provider", "model")


@query("s18_quarantine_plan", V.with_ctes(V.TRIALS, _AUDIT) + f"SELECT *, {_REASON} AS reason FROM audit WHERE {_REASON} IS NOT NULL")
def _(spark, sf):
    rows = audited_rows(spark, sf)
    return A.quarantine(rows, A.classify_files(A.audit_files(rows), archive_zero_valid=True))


@query("s18_quarantine_split", V.with_ctes(V.TRIALS, _AUDIT) + f""", f AS (SELECT source_path, total_lines, {_REASON} AS reason FROM audit)
 SELECT coalesce(reason, 'kept') AS part, count(*) AS n_files, CAST(sum(total_lines) AS BIGINT) AS n_lines FROM f GROUP BY 1""")
def _(spark, sf):
    rows = audited_rows(spark, sf)
    kept, bad = A.split_quarantine(rows, A.classify_files(A.audit_files(rows)))
    both = kept.withColumn("part", F.lit("kept")).unionByName(bad.withColumnRenamed("reason", "part"))
    return both.groupBy("part").agg(F.count_distinct("source_path").alias("n_files"), F.count(F.lit(1)).alias("n_lines"))


# ---- generators ----------------------------------------------------------------------------

def _generator_sql():
    def u(tag):
        return f"(('0x' || substr(md5(concat_ws('|', '42', '{tag}', CAST(c_custkey AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0)"

    out = {}
    for c, (mean, sd, low, high) in G.NORMALS.items():
        z = f"CAST(trunc({mean} + {sd} * (sqrt(-2.0 * ln(1.0 - {u(c)})) * cos(2 * pi() * {u(c + '#2')}))) AS BIGINT)"
        out[c] = z if low is None else f"greatest({low}, least({high}, {z}))::BIGINT"
    for c, (low, high) in G.UNIFORM_INTS.items():
        out[c] = f"CAST({low} + floor({u(c)} * {high - low + 1}) AS BIGINT)"
    for c, (zero, scale) in G.ZERO_INFLATED.items():
        out[c] = f"CASE WHEN {u(c)} < {zero} THEN 0 ELSE CAST(trunc(-{scale} * ln(1.0 - {u(c + '#2')})) AS BIGINT) END"
    for c, (names, weights) in G.CATEGORIES.items():
        whens = " ".join(f"WHEN u < {b!r} THEN '{n}'" for n, b in zip(names, G.cumulative(weights)))
        out[c] = f"(SELECT CASE {whens} ELSE '{names[-1]}' END FROM (SELECT {u(c)} AS u) x)"
    return "SELECT c_custkey AS row_id, " + ", ".join(f"{out[c]} AS {c}" for c in G.COLUMN_ORDER) + " FROM customer"


@query("s19_generated_rows", _generator_sql())
def _(spark, sf):
    return G.generate_rows(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id")))


def _real(spark, sf):
    return _micro_columns(V.micro(spark, sf).filter("source = 'real'"))


@query("s3_generated_when_unreadable", _generator_sql())
def _(spark, sf):
    root = shared_folder(spark, "nothing-here")
    ids = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return R.first_readable(spark, [root + "/first.csv", root + "/second.csv"],
                            lambda s, p: R.read_micro_csv(s, p, MICRO_SCHEMA), fallback=lambda: G.generate_rows(ids))


@query("g6_gaussian_copula")
def _(spark, sf):
    real = _real(spark, sf)
    return G.gaussian_copula(real, real.select("row_id"), columns=["acctbal", "nation", "segment"])


def _margins_sql(numbers=("acctbal", "nation"), categories=("segment",)):
    """Exact margins by running counts, shares by digest, NULLs by their share."""
    def u(tag):
        return f"(('0x' || substr(md5(concat_ws('|', '42', '{tag}', CAST(row_id AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0)"

    ctes, joins, shown = ["r AS (SELECT * FROM micro WHERE source = 'real')"], [], []
    for k, c in enumerate((*numbers, *categories)):
        order = "v" if c in numbers else "n DESC, v"
        ctes.append(f"""m{k} AS (SELECT v, CAST(sum(n) OVER (ORDER BY {order}) - n AS BIGINT) AS low, CAST(sum(n) OVER (ORDER BY {order}) AS BIGINT) AS high,
 lead(v) OVER (ORDER BY {order}) AS nx, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT {c} AS v, count(*) AS n FROM r WHERE {c} IS NOT NULL GROUP BY 1) g)""")
        at = f"{u(f'u{k}')} * CAST((SELECT {'any_value(total) - 1' if c in numbers else '1'} FROM m{k}{'' if c in numbers else ' LIMIT 1'}) AS DOUBLE)"
        ctes.append(f"d{k} AS (SELECT row_id, {at} AS h, {u(f'n{k}')} >= 1.0 - (SELECT count({c})::DOUBLE / count(*) FROM r) AS kept FROM r)")
        low = "m.low" if c in numbers else "m.low / m.total"
        value = "round(CASE WHEN h - (high - 1) > 0 THEN v + (h - (high - 1)) * (nx - v) ELSE v END, 6)" if c in numbers else "v"
        ctes.append(f"x{k} AS (SELECT row_id, CASE WHEN kept THEN {value} END AS {c} FROM d{k} d ASOF JOIN (SELECT *, {low} AS start FROM m{k} m) m ON d.h >= m.start)")
        joins.append(f"x{k}")
        shown.append(c)
    return V.with_ctes(V.MICRO, *ctes) + f"SELECT row_id, {', '.join(shown)} FROM {joins[0]} " + " ".join(f"JOIN {x} USING (row_id)" for x in joins[1:])


@query("g7_independent_margins", _margins_sql())
def _(spark, sf):
    real = _real(spark, sf)
    made = G.independent_margins(real, real.select("row_id"), columns=["acctbal", "nation", "segment"])
    return made.withColumns({c: F.round(c, 6) for c in ("acctbal", "nation")})


@query("g7_all_methods")
def _(spark, sf):
    return G.generate_all(_real(spark, sf))


# ---- streams ----------------------------------------------------------------------------------

@query("r1_live_progress", T + f"""SELECT synthetic_method AS method, provider, valid, errors, CASE WHEN valid >= 20 AND errors = 0 THEN 'DONE' WHEN valid > 0 THEN 'PARTIAL'
 WHEN errors > 0 THEN 'QUOTA HIT' ELSE 'PENDING' END AS status FROM (SELECT synthetic_method, provider, count(*) FILTER (predicted_label <> 'ERROR') AS valid,
 count(*) FILTER (predicted_label = 'ERROR') AS errors FROM trials WHERE {_KEPT} GROUP BY 1, 2) g""")
def _(spark, sf):
    counts = shared_folder(spark, "progress")
    rows = L.stream_trials(spark, trial_folder(spark, sf) + "/{adult,census}/llm_results_*.jsonl", files_per_trigger=4)
    L.start_progress(rows, counts, shared_folder(spark, "progress-checkpoint")).awaitTermination()
    return L.live_progress(spark, counts)


@query("r2_live_drs", T + f"""SELECT dataset, provider, synthetic_method AS method, condition, count(*) FILTER (true_label='REAL') AS n_real, count(*) FILTER (true_label='SYNTHETIC') AS n_syn,
 round(100.0*avg(correct::INT) FILTER (true_label='REAL'), 6) AS p_real_correct, round(100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC'), 6) AS p_syn_correct,
 round(CASE WHEN count(*) FILTER (true_label='REAL') > 0 AND count(*) FILTER (true_label='SYNTHETIC') > 0 THEN least(100.0*avg(correct::INT) FILTER (true_label='REAL'), 100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) END, 6) AS drs
 FROM trials WHERE {_KEPT} AND predicted_label <> 'ERROR' GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    root, counts = trial_folder(spark, sf), shared_folder(spark, "live")
    again = F.regexp_replace("value", '"timestamp":"2026', '"timestamp":"2027')  # a re-run a year later replaces its trials
    trial_lines(spark, sf).filter("folder = 'census' AND provider = 'groq'").select(again.alias("value")) \
        .write.mode("append").text(root + "/census/llm_results_all_groq_1.jsonl")
    rows = L.stream_trials(spark, root + "/{adult,census}/llm_results_*.jsonl", files_per_trigger=4)
    L.start_live_counts(rows, counts, shared_folder(spark, "live-checkpoint"), delay="1000 days").awaitTermination()
    return rounded(L.live_drs(spark, counts))
