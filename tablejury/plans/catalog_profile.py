"""Queries over column profiles and distribution comparison."""

from pyspark.sql import functions as F

from tablejury.operators import clean as C, profile as P
from tablejury.plans import views as V
from tablejury.plans.catalog_trials import T, rounded
from tablejury.plans.registry import query

MEASURES = ("quantity", "price", "discount", "tax", "flat")
FLAGS = ("returnflag", "linestatus")
ALL = MEASURES + FLAGS
LI, MI = V.with_ctes(V.MEASURED), V.with_ctes(V.MICRO)


def _each(columns, template, joiner=" UNION ALL "):
    return joiner.join(template.format(c=c) for c in columns)


_TYPES = {"quantity": "double", "price": "double", "discount": "double", "tax": "double", "flat": "double",
          "returnflag": "string", "linestatus": "string"}


@query("p14_column_types", LI + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{'numeric' if t == 'double' else 'categorical'}' AS kind, {i} AS position, count({c}) AS n_values, "
    + (f"CASE WHEN count({c}) = 0 THEN 'null' WHEN bool_and({c} = floor({c})) THEN 'integral' ELSE 'decimal' END" if t == "double" else
       f"CASE WHEN count({c}) = 0 THEN 'null' WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN 'integral' WHEN bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN 'decimal' "
       f"WHEN bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) THEN 'time' ELSE 'text' END")
    + " AS content FROM measured" for i, (c, t) in enumerate(_TYPES.items())))
def _(spark, sf):
    return P.column_types(V.measured_lineitem(spark, sf))


@query("a24_distinct_counts", LI + _each(ALL, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM measured"))
def _(spark, sf):
    return P.distinct_counts(V.measured_lineitem(spark, sf))


_MISS = "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, round_even(100.0*(count(*) - count({c}))/count(*), 2) AS missing_pct FROM measured"


@query("a25_missing", LI + _each(ALL, _MISS))
def _(spark, sf):
    return P.missing(V.measured_lineitem(spark, sf))


@query("a25_columns_with_missing", LI + "SELECT \"column\", missing_pct FROM (" + _each(ALL, _MISS) + ") m WHERE n_missing > 0")
def _(spark, sf):
    return P.columns_with_missing(V.measured_lineitem(spark, sf))


_NUM = """SELECT '{c}' AS "column", round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std, round_even(min({c}), 4) AS min,
 round_even(quantile_cont({c}, 0.25), 4) AS p25, round_even(quantile_cont({c}, 0.5), 4) AS median, round_even(quantile_cont({c}, 0.75), 4) AS p75,
 round_even(max({c}), 4) AS max FROM measured"""


@query("a26_numeric_profile", LI + _each(MEASURES, _NUM))
def _(spark, sf):
    return P.numeric_profile(V.measured_lineitem(spark, sf)).drop("skewness", "kurtosis")


@query("a27_shape_adjusted", LI + _each(MEASURES, """SELECT '{c}' AS "column", round(CASE WHEN var_pop({c}) = 0 THEN 0 ELSE skewness({c}) END, 6) AS skewness,
 round(CASE WHEN var_pop({c}) = 0 THEN 0 ELSE kurtosis({c}) END, 6) AS kurtosis FROM measured"""))
def _(spark, sf):
    return rounded(P.numeric_moments(V.measured_lineitem(spark, sf)).select("column", "skewness", "kurtosis"))


_COUNTS = "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM measured WHERE {c} IS NOT NULL GROUP BY 2"


@query("a28_category_shares", LI + "SELECT *, round(n*1.0/sum(n) OVER (PARTITION BY \"column\"), 6) AS share FROM (" + _each(FLAGS, _COUNTS) + ") c")
def _(spark, sf):
    return rounded(P.category_shares(V.measured_lineitem(spark, sf)))


@query("a29_entropy", LI + ", shares AS (SELECT *, n*1.0/sum(n) OVER (PARTITION BY \"column\") + 1e-9 AS p FROM (" + _each(FLAGS, _COUNTS) + """) c),
 norm AS (SELECT "column", p/sum(p) OVER (PARTITION BY "column") AS q FROM shares) SELECT "column", round_even(-sum(q*ln(q)), 4) AS entropy FROM norm GROUP BY 1""")
def _(spark, sf):
    return P.entropies(V.measured_lineitem(spark, sf))


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


_R = " UNION ALL ".join(f"""SELECT '{a}' AS c1, '{b}' AS c2, round_even(covar_samp({a}, {b})/nullif(stddev_samp({a}) FILTER ({b} IS NOT NULL)*stddev_samp({b}) FILTER ({a} IS NOT NULL), 0), 4) AS r FROM measured"""
                        for a, b in _pairs(MEASURES))


@query("a30_correlations", LI + _R)
def _(spark, sf):
    return P.correlations(V.measured_lineitem(spark, sf))


@query("k2_top_correlations", LI + "SELECT * FROM (" + _R + ") r ORDER BY abs(r) DESC NULLS LAST, c1, c2 LIMIT 15")
def _(spark, sf):
    return P.top_correlations(V.measured_lineitem(spark, sf))


@query("k1_top_values", LI + """SELECT "column", value, CAST(rank AS INT) AS rank, n, round_even(n/total, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS total,
 row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (""" + _each(FLAGS, _COUNTS) + ") c) r WHERE rank <= 10")
def _(spark, sf):
    return P.top_values(V.measured_lineitem(spark, sf))


@query("k1_top_values_of_parts", """SELECT 'p_type' AS "column", p_type AS value, CAST(rank AS INT) AS rank, n, round_even(n/total, 4) AS share FROM (SELECT p_type, count(*) AS n,
 sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY 1) r WHERE rank <= 10""")
def _(spark, sf):
    return P.top_values(V.table(spark, sf, "part"), columns=["p_type"])


_X1N = _NUM.replace(" AS max FROM", """ AS max, round_even(CASE WHEN var_pop({c}) = 0 THEN 0 ELSE skewness({c}) END, 4) AS skewness,
 round_even(CASE WHEN var_pop({c}) = 0 THEN 0 ELSE kurtosis({c}) END, 4) AS kurtosis FROM""")


@query("x1_table_profile", LI + f""", miss AS ({_each(ALL, _MISS)}), num AS ({_each(MEASURES, _X1N)}),
 uniq AS ({_each(ALL, 'SELECT {q}{c}{q} AS "column", count(DISTINCT {c}) AS n_unique FROM measured'.replace('{q}', chr(39)))}),
 kinds AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{t}', '{'numeric' if t == 'double' else 'categorical'}', {i})" for i, (c, t) in enumerate(_TYPES.items()))}) v("column", dtype, kind, position)),
 shares AS (SELECT *, n*1.0/sum(n) OVER (PARTITION BY "column") + 1e-9 AS p FROM ({_each(FLAGS, _COUNTS)}) c),
 norm AS (SELECT "column", p/sum(p) OVER (PARTITION BY "column") AS q FROM shares),
 ent AS (SELECT "column", round_even(-sum(q*ln(q)), 4) AS entropy FROM norm GROUP BY 1)
 SELECT * FROM miss JOIN uniq USING ("column") JOIN kinds USING ("column") LEFT JOIN num USING ("column") LEFT JOIN ent USING ("column")""")
def _(spark, sf):
    return P.table_profile(V.measured_lineitem(spark, sf))


@query("f7_shapiro_wilk")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return rounded(P.shapiro(li, ["l_orderkey", "l_linenumber"],
                             columns=["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("a31_compare_distributions", MI + _each(("acctbal", "nation"), """SELECT source, '{c}' AS "column", round(avg({c}), 6) AS mean,
 round(stddev_samp({c}), 6) AS std FROM micro GROUP BY 1"""))
def _(spark, sf):
    return rounded(P.compare_distributions(V.micro(spark, sf), exclude=["row_id"]))


_H = """SELECT s.source, '{c}' AS "column", CAST(b AS INT) AS bin, round(lo + b*(hi - lo)/50.0, 6) AS left_edge, coalesce(n, 0) AS n FROM
 (SELECT source, min({c}) AS lo, max({c}) AS hi FROM micro GROUP BY 1) s CROSS JOIN (SELECT unnest(range(50)) AS b) r
 LEFT JOIN (SELECT m.source, least(floor(({c} - lo)/((hi - lo)/50.0)), 49) AS bin, count(*) AS n FROM micro m JOIN
 (SELECT source, min({c}) AS lo, max({c}) AS hi FROM micro GROUP BY 1) t ON m.source = t.source GROUP BY 1, 2) h ON h.source = s.source AND h.bin = b"""


@query("a32_histograms", MI + _each(("acctbal", "nation"), _H))
def _(spark, sf):
    return rounded(P.numeric_histograms(V.micro(spark, sf), exclude=["row_id"]))


@query("a33_confidence_histogram", T + """, s AS (SELECT correct, min(confidence)::DOUBLE AS lo, max(confidence)::DOUBLE AS hi FROM trials GROUP BY 1),
 h AS (SELECT correct, least(floor((confidence - lo)/((hi - lo)/20.0)), 19) AS bin, count(*) AS n FROM trials JOIN s USING (correct) GROUP BY 1, 2)
 SELECT s.correct, CAST(b AS INT) AS bin, round(lo + b*(hi - lo)/20.0, 6) AS left_edge, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(20)) AS b) r
 LEFT JOIN h ON h.correct = s.correct AND h.bin = b""")
def _(spark, sf):
    long = V.trials(spark, sf).select("correct", F.col("confidence").cast("double").alias("value"))
    return rounded(P.histogram(long, ["correct"], 20))


@query("a34_box_plot", T + """, q AS (SELECT synthetic_method AS method, count(*) AS n, quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.5) AS median,
 quantile_cont(confidence, 0.75) AS q3 FROM trials GROUP BY 1) SELECT method, n, q1, median, q3,
 CAST(min(confidence) FILTER (confidence >= q1 - 1.5*(q3 - q1) AND confidence <= q3 + 1.5*(q3 - q1)) AS DOUBLE) AS whisker_low,
 CAST(max(confidence) FILTER (confidence >= q1 - 1.5*(q3 - q1) AND confidence <= q3 + 1.5*(q3 - q1)) AS DOUBLE) AS whisker_high,
 count(*) FILTER (confidence < q1 - 1.5*(q3 - q1) OR confidence > q3 + 1.5*(q3 - q1)) AS n_outliers
 FROM trials JOIN q ON method = synthetic_method GROUP BY ALL""")
def _(spark, sf):
    return P.box_plot(V.trials(spark, sf).withColumnRenamed("synthetic_method", "method"), "method", "confidence")


@query("a35_joint_density", MI + """, s AS (SELECT source, min(acctbal) AS x0, max(acctbal) AS x1, min(nation) AS y0, max(nation) AS y1 FROM micro GROUP BY 1)
 SELECT source, CAST(least(floor((acctbal - x0)/((x1 - x0)/20.0)), 19) AS INT) AS bin_x, CAST(least(floor((nation - y0)/((y1 - y0)/20.0)), 19) AS INT) AS bin_y,
 count(*) AS n FROM micro JOIN s USING (source) GROUP BY ALL""")
def _(spark, sf):
    return P.joint_density(V.micro(spark, sf), "acctbal", "nation")


@query("a46_target_distribution", "SELECT l_returnflag AS target, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return C.label_counts(V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("target")), "target")


# ---- preparation of micro tables -----------------------------------------------------

@query("p10_drop_incomplete", LI + "SELECT count(*) AS rows_before, count(*) FILTER (quantity IS NOT NULL) AS rows_after, count(*) FILTER (quantity IS NULL) AS rows_dropped FROM measured")
def _(spark, sf):
    return C.drop_report(V.measured_lineitem(spark, sf))


_ACS = """acs AS (SELECT CASE WHEN c_custkey % 31 <> 0 THEN CAST(c_nationkey + 17 AS DOUBLE) END AS age, CAST(c_custkey % 9 AS DOUBLE) AS class_of_worker,
 c_acctbal AS income, c_acctbal > 5000 AS rich FROM customer)"""


def _census(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select(F.when(F.col("c_custkey") % 31 != 0, (F.col("c_nationkey") + 17).cast("double")).alias("AGEP"),
                    (F.col("c_custkey") % 9).cast("double").alias("COW"), F.col("c_acctbal").alias("PINCP"),
                    (F.col("c_acctbal") > 5000).alias("rich"))


@query("p11_rename_map", V.with_ctes(_ACS) + "SELECT age, class_of_worker, income FROM acs")
def _(spark, sf):
    return C.rename_where_present(_census(spark, sf), C.CENSUS_NAMES).drop("rich")


@query("p12_integral_cast", V.with_ctes(_ACS) + "SELECT CAST(age AS BIGINT) AS age, CAST(class_of_worker AS BIGINT) AS class_of_worker, income, rich FROM acs WHERE age IS NOT NULL")
def _(spark, sf):
    return C.prepare_census(_census(spark, sf))


@query("p13_boolean_target", V.with_ctes(_ACS) + "SELECT CAST(rich AS INT) AS income_above_50k, count(*) AS n FROM acs GROUP BY 1")
def _(spark, sf):
    t = _census(spark, sf).select(F.col("rich").cast("int").alias(C.CENSUS_TARGET))
    return C.label_counts(t, C.CENSUS_TARGET)


@query("p15_impute_with_real_means", MI + """, holed AS (SELECT source, row_id, CASE WHEN row_id % 7 <> 0 THEN acctbal END AS acctbal, nation FROM micro),
 m AS (SELECT avg(acctbal) AS a FROM holed WHERE source = 'real') SELECT source, row_id, round(coalesce(acctbal, m.a), 6) AS acctbal, nation FROM holed, m""")
def _(spark, sf):
    holed = V.micro(spark, sf).select("source", "row_id", F.when(F.col("row_id") % 7 != 0, F.col("acctbal")).alias("acctbal"), "nation")
    return rounded(C.impute_with(holed, ["acctbal", "nation"], holed.filter("source = 'real'")))


@query("p16_clip", "SELECT c_custkey AS row_id, greatest(17, least(90, c_nationkey * 5)) AS age FROM customer")
def _(spark, sf):
    from tablejury.functions.scalar import clip
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), clip(F.col("c_nationkey") * 5, 17, 90).alias("age"))
