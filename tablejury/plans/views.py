"""Trial, annotation, verdict and micro-table views derived from the given tables."""

from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _even(expression):
    return F.floor(F.expr(expression)) % 2 == 0


def trials(spark, sf_dir):
    """One judged trial per event."""
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error") & (F.col("value") < 10)
    out = e.select(
        F.col("event_id").alias("trial_id"), F.col("ts").alias("timestamp"),
        F.when(_even("event_id/12.0D"), "adult").otherwise("census").alias("dataset"),
        F.when(F.col("user_id") % 2 == 0, "google").otherwise("groq").alias("provider"),
        F.when(F.col("user_id") % 10 >= 8, "unapproved-model")
        .when(F.col("user_id") % 2 == 0, "gemini-2.5-flash").otherwise("llama-3.1-8b-instant").alias("model"),
        F.when(F.col("event_id") % 3 == 0, "ctgan").when(F.col("event_id") % 3 == 1, "tvae")
        .otherwise("gaussian_copula").alias("synthetic_method"),
        F.when(_even("event_id/3.0D"), "C1").otherwise("C2").alias("condition"),
        F.when(_even("event_id/6.0D"), "REAL").otherwise("SYNTHETIC").alias("true_label"),
        F.when(failed, "ERROR").when(F.col("event_type").isin("click", "view", "error"), "REAL")
        .otherwise("SYNTHETIC").alias("predicted_label"),
        F.when(failed, F.lit(-1).cast("bigint"))
        .otherwise(F.floor("value").cast("bigint") % 101).alias("confidence"),
    )
    return out.withColumn("correct", F.col("predicted_label") == F.col("true_label"))


TRIALS = """trials AS (
 SELECT *, predicted_label = true_label AS correct FROM (
 SELECT event_id AS trial_id, ts AS timestamp,
  CASE WHEN floor(event_id/12.0) % 2 = 0 THEN 'adult' ELSE 'census' END AS dataset,
  CASE WHEN user_id % 2 = 0 THEN 'google' ELSE 'groq' END AS provider,
  CASE WHEN user_id % 10 >= 8 THEN 'unapproved-model' WHEN user_id % 2 = 0 THEN 'gemini-2.5-flash' ELSE 'llama-3.1-8b-instant' END AS model,
  CASE event_id % 3 WHEN 0 THEN 'ctgan' WHEN 1 THEN 'tvae' ELSE 'gaussian_copula' END AS synthetic_method,
  CASE WHEN floor(event_id/3.0) % 2 = 0 THEN 'C1' ELSE 'C2' END AS condition,
  CASE WHEN floor(event_id/6.0) % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS true_label,
  CASE WHEN event_type='error' AND value < 10 THEN 'ERROR'
       WHEN event_type IN ('click','view','error') THEN 'REAL' ELSE 'SYNTHETIC' END AS predicted_label,
  CASE WHEN event_type='error' AND value < 10 THEN -1 ELSE CAST(floor(value) AS BIGINT) % 101 END AS confidence
 FROM events) raw_trials)"""

APPROVED = """approved AS (
 SELECT trial_id, timestamp, dataset, provider, model,
  CASE provider WHEN 'groq' THEN 'Groq (LLaMA-3.1-8b)' ELSE 'Google (Gemini-2.5-Flash)' END AS provider_label,
  synthetic_method AS method, condition, true_label, predicted_label, correct,
  CASE WHEN confidence > 0 THEN CAST(confidence AS DOUBLE) END AS confidence
 FROM trials WHERE predicted_label IN ('REAL','SYNTHETIC')
  AND (provider, model) IN (('groq','llama-3.1-8b-instant'),('google','gemini-2.5-flash')))"""

METRICS = """count(*) AS n, count(*) FILTER (true_label='REAL') AS n_real,
 count(*) FILTER (true_label='SYNTHETIC') AS n_syn, round(100.0*avg(correct::INT), 6) AS accuracy,
 round(100.0*avg(correct::INT) FILTER (true_label='REAL'), 6) AS p_real_correct,
 round(100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC'), 6) AS p_syn_correct,
 round(CASE WHEN count(*) FILTER (true_label='REAL') > 0 AND count(*) FILTER (true_label='SYNTHETIC') > 0
  THEN least(100.0*avg(correct::INT) FILTER (true_label='REAL'),
             100.0*avg(correct::INT) FILTER (true_label='SYNTHETIC')) END, 6) AS drs,
 round(100.0*avg((predicted_label='REAL')::INT), 6) AS pred_real_rate,
 round(avg(confidence), 6) AS avg_conf"""


def annotations(spark, sf_dir):
    """Paired C1/C2 human annotations; every 13th row appears again from a second file."""
    e = table(spark, sf_dir, "events")
    files = F.when(F.col("event_id") % 13 == 0, F.array(F.lit("a.csv"), F.lit("b.csv"))) \
        .otherwise(F.array(F.lit("a.csv")))
    out = e.select(
        F.concat(F.lit("ann_"), F.when(_even("event_id/12.0D"), "b").otherwise("a")).alias("annotator_id"),
        F.concat(F.lit("s"), (F.floor(F.expr("event_id/48.0D")).cast("bigint") % 10).cast("string"))
        .alias("session_id"),
        F.when(_even("event_id/6.0D"), "adult").otherwise("census").alias("dataset"),
        F.when(F.floor(F.expr("event_id/2.0D")) % 3 == 0, "ctgan")
        .when(F.floor(F.expr("event_id/2.0D")) % 3 == 1, "tvae").otherwise("gaussian_copula").alias("method"),
        F.floor(F.expr("event_id/2.0D")).cast("bigint").alias("pair_id"),
        F.when(F.col("event_id") % 2 == 0, "C1").otherwise("C2").alias("condition"),
        F.when(_even("event_id/24.0D"), "REAL").otherwise("SYNTHETIC").alias("true_label"),
        F.when(F.col("event_type").isin("click", "view", "error"), "REAL").otherwise("SYNTHETIC")
        .alias("predicted_label"),
        (F.floor("value").cast("bigint") % 101).alias("confidence"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("note "), F.col("event_type")))
        .when(F.col("event_id") % 7 == 1, F.lit("  ")).alias("notes"),
        F.explode(files).alias("source_path"),
    )
    return out.withColumn("correct", F.col("predicted_label") == F.col("true_label"))


ANNOTATIONS = """annotations AS (
 SELECT *, predicted_label = true_label AS correct FROM (
 SELECT concat('ann_', CASE WHEN floor(event_id/12.0) % 2 = 0 THEN 'b' ELSE 'a' END) AS annotator_id,
  concat('s', CAST(CAST(floor(event_id/48.0) AS BIGINT) % 10 AS STRING)) AS session_id,
  CASE WHEN floor(event_id/6.0) % 2 = 0 THEN 'adult' ELSE 'census' END AS dataset,
  CASE floor(event_id/2.0) % 3 WHEN 0 THEN 'ctgan' WHEN 1 THEN 'tvae' ELSE 'gaussian_copula' END AS method,
  CAST(floor(event_id/2.0) AS BIGINT) AS pair_id,
  CASE WHEN event_id % 2 = 0 THEN 'C1' ELSE 'C2' END AS condition,
  CASE WHEN floor(event_id/24.0) % 2 = 0 THEN 'REAL' ELSE 'SYNTHETIC' END AS true_label,
  CASE WHEN event_type IN ('click','view','error') THEN 'REAL' ELSE 'SYNTHETIC' END AS predicted_label,
  CAST(floor(value) AS BIGINT) % 101 AS confidence,
  CASE WHEN event_id % 7 = 0 THEN concat('note ', event_type) WHEN event_id % 7 = 1 THEN '  ' END AS notes,
  f.source_path AS source_path
 FROM events CROSS JOIN (SELECT 'a.csv' AS source_path UNION ALL SELECT 'b.csv') f
 WHERE f.source_path = 'a.csv' OR event_id % 13 = 0) raw_annotations)"""

DEDUPED = """deduped AS (
 SELECT * EXCLUDE (rn), CASE annotator_id WHEN 'ann_a' THEN 'HA1' ELSE 'HA2' END AS annotator FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, dataset, method, pair_id, condition
   ORDER BY source_path, annotator_id) AS rn FROM annotations) numbered WHERE rn = 1)"""


def raw_verdicts(spark, sf_dir):
    """Judge answers as text: plain JSON, fenced JSON and truncated JSON."""
    e = table(spark, sf_dir, "events")
    record = F.concat(
        F.lit('{"verdict": "'), F.when(F.col("event_type").isin("click", "view"), "real").otherwise("synthetic"),
        F.lit('", "confidence": '), (F.floor("value").cast("bigint") % 101).cast("string"),
        F.lit(', "red_flags": ["'), F.col("event_type"), F.lit(' pattern", "band '),
        (F.col("user_id") % 9).cast("string"), F.lit('"]}'))
    fence = F.concat(F.lit("```json\n"), record, F.lit("\n```"))
    return e.select(
        F.col("event_id").alias("trial_id"),
        F.when(F.col("event_id") % 5 == 0, fence)
        .when(F.col("event_id") % 11 == 0, F.substring(record, 1, 20)).otherwise(record).alias("raw"))


RAW_VERDICTS = """raw_verdicts AS (
 SELECT event_id AS trial_id,
  CASE WHEN event_id % 5 = 0 THEN concat('```json', chr(10), j, chr(10), '```')
       WHEN event_id % 11 = 0 THEN substring(j, 1, 20) ELSE j END AS raw
 FROM (SELECT event_id, concat('{"verdict": "', CASE WHEN event_type IN ('click','view') THEN 'real' ELSE 'synthetic' END,
  '", "confidence": ', CAST(CAST(floor(value) AS BIGINT) % 101 AS STRING),
  ', "red_flags": ["', event_type, ' pattern", "band ', CAST(user_id % 9 AS STRING), '"]}') AS j FROM events) t)"""

#: parsed verdicts joined to their trials; broken answers become ERROR rows without flags
REASONED = RAW_VERDICTS + """, reasoned AS (
 SELECT t.trial_id, t.dataset, t.provider, t.synthetic_method AS method, t.condition, t.true_label,
  coalesce(upper(json_extract_string(j, '$.verdict')), 'ERROR') AS verdict,
  coalesce(upper(json_extract_string(j, '$.verdict')), 'ERROR') = t.true_label AS correct,
  coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), -1) AS confidence,
  coalesce(CAST(json_extract(j, '$.red_flags') AS VARCHAR[]), []) AS red_flags
 FROM (SELECT trial_id, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j FROM (
   SELECT trial_id, trim(replace(replace(raw, '```json', ''), '```', ''), chr(10) || ' ') AS b FROM raw_verdicts) s) p
 JOIN trials t USING (trial_id))"""


def micro(spark, sf_dir):
    """One real and three synthetic tables in long form, tagged by ``source``."""
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    real = c.select(F.lit("real").alias("source"), key.alias("row_id"), F.col("c_acctbal").alias("acctbal"),
                    nation.cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"))
    ctgan = c.select(F.lit("ctgan").alias("source"), key.alias("row_id"),
                     (F.col("c_acctbal") + (key % 97 - 48) * F.lit(5.0)).alias("acctbal"),
                     ((nation + 1) % 25).cast("double").alias("nation"), F.col("c_mktsegment").alias("segment"))
    tvae = c.select(F.lit("tvae").alias("source"), key.alias("row_id"),
                    (F.col("c_acctbal") * F.lit(0.9) + F.lit(250.0)).alias("acctbal"),
                    ((nation * 7) % 25).cast("double").alias("nation"),
                    F.when(key % 4 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("segment"))
    copula = c.filter(key % 10 != 0).select(
        F.lit("gaussian_copula").alias("source"), key.alias("row_id"),
        (F.lit(9000.0) - F.col("c_acctbal")).alias("acctbal"), nation.cast("double").alias("nation"),
        F.col("c_mktsegment").alias("segment"))
    return real.unionAll(ctgan).unionAll(tvae).unionAll(copula)


MICRO = """micro AS (
 SELECT 'real' AS source, c_custkey AS row_id, c_acctbal AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 'ctgan', c_custkey, c_acctbal + (c_custkey % 97 - 48) * CAST(5 AS DOUBLE), CAST((c_nationkey + 1) % 25 AS DOUBLE), c_mktsegment FROM customer
 UNION ALL SELECT 'tvae', c_custkey, c_acctbal * CAST(0.9 AS DOUBLE) + CAST(250 AS DOUBLE), CAST((c_nationkey * 7) % 25 AS DOUBLE), CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' ELSE c_mktsegment END FROM customer
 UNION ALL SELECT 'gaussian_copula', c_custkey, CAST(9000 AS DOUBLE) - c_acctbal, CAST(c_nationkey AS DOUBLE), c_mktsegment FROM customer WHERE c_custkey % 10 <> 0)"""


WIDE = ["acctbal", "nation", "n_orders", "total", "mean_price", "max_price", "min_price", "n_open", "n_urgent", "span_days"]
# how a synthetic table changes the real values of a customer, and which customers it has
WIDE_CHANGES = {"ctgan": ("1 + (row_id % 97 - 48) / CAST(1000 AS DOUBLE)", "row_id >= 0"), "tvae": ("CAST(0.9 AS DOUBLE)", "row_id >= 0"),
                "gaussian_copula": ("1 + (row_id * 7 % 13 - 6) / CAST(50 AS DOUBLE)", "row_id % 10 <> 0")}


def wide(spark, sf_dir):
    """One real and three synthetic tables of ten numeric columns: customers and their orders, missing where there are none."""
    price, day = F.col("o_totalprice"), F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum(price).alias("total"), F.avg(price).alias("mean_price"), F.max(price).alias("max_price"),
        F.min(price).alias("min_price"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("n_open"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("n_urgent"), F.date_diff(F.max(day), F.min(day)).cast("double").alias("span_days"))
    real = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"), *WIDE[2:])
    out = real.select(F.lit("real").alias("source"), "*")
    for source, (factor, rows) in WIDE_CHANGES.items():
        out = out.unionAll(real.where(rows).select(F.lit(source), "row_id", *[F.col(c) * F.expr(factor) for c in WIDE]))
    return out


WIDE_SQL = f"""facts AS (SELECT o_custkey AS c_custkey, CAST(count(*) AS DOUBLE) AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price,
 min(o_totalprice) AS min_price, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS n_open, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS n_urgent,
 CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS DOUBLE) AS span_days FROM orders GROUP BY 1),
 own AS (SELECT c_custkey AS row_id, c_acctbal AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation, {", ".join(WIDE[2:])} FROM customer LEFT JOIN facts USING (c_custkey)),
 wide AS (SELECT 'real' AS source, * FROM own""" + "".join(
    f" UNION ALL SELECT '{source}', row_id, {', '.join(f'{c} * ({factor})' for c in WIDE)} FROM own WHERE {rows}" for source, (factor, rows) in WIDE_CHANGES.items()) + ")"


def measured_lineitem(spark, sf_dir):
    """lineitem measures with injected nulls and a constant column."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.nullif("l_quantity", F.lit(1.0)).alias("quantity"), F.col("l_extendedprice").alias("price"),
                     F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.lit(7.0).alias("flat"),
                     F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))


MEASURED = """measured AS (SELECT nullif(l_quantity, 1.0) AS quantity, l_extendedprice AS price,
 l_discount AS discount, l_tax AS tax, CAST(7.0 AS DOUBLE) AS flat, l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem)"""


def with_ctes(*parts):
    return "WITH " + ",\n".join(parts) + "\n"
