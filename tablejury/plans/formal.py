"""Formal privacy measures per method beside the judges' scores."""

from pyspark.sql import functions as F

from tablejury.functions.stats import pearson
from tablejury.operators import metrics as M, privacy as R
from tablejury.schema import FORMAL_METHOD_NAMES
from tablejury.session import shared_table


def judge_scores(trials, zero_is_null=True):
    """Discrimination per method for C1 and C2 and their mean.

    With ``zero_is_null`` a zero score leaves the mean undefined.
    """
    scores = M.discrimination(trials)
    c1, c2 = (F.max(F.when(F.col("condition") == c, F.col("discrimination"))) for c in ("C1", "C2"))
    wide = scores.groupBy("method").agg(c1.alias("llm_c1"), c2.alias("llm_c2"))
    known = F.col("llm_c1").isNotNull() & F.col("llm_c2").isNotNull()
    if zero_is_null:
        known = known & (F.col("llm_c1") != 0) & (F.col("llm_c2") != 0)
    return wide.withColumn("llm_avg", F.when(known, (F.col("llm_c1") + F.col("llm_c2")) / 2))


def measure_correlations(measures):
    """Pearson of the judges' mean score with both formal measures over complete rows (more than one)."""
    whole = measures.filter(F.col("llm_avg").isNotNull() & F.col("mia_discrimination").isNotNull()
                            & F.col("linkage_success_rate").isNotNull())
    enough = F.count(F.lit(1)) > 1
    return whole.agg(F.count(F.lit(1)).alias("n_methods"),
                     F.when(enough, pearson("llm_avg", "mia_discrimination")).alias("corr_llm_mia"),
                     F.when(enough, pearson("llm_avg", "linkage_success_rate")).alias("corr_llm_linkage"))


def formal_name(column):
    """Display name of a method code; unknown codes keep their own name."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in FORMAL_METHOD_NAMES.items():
        out = out.when(F.col(column) == code, name)
    return F.coalesce(out, F.col(column))


def with_method_drs(measures, mean_drs):
    """Formal measures beside the judges' mean DRS, matched through the method name map."""
    named = mean_drs.select(formal_name("method").alias("method"), "mean_drs")
    return measures.join(named, "method")


def formal_measures(tables, features, row_id, trials, metric="euclidean", cap=5000):
    """Linkage, membership inference and judge scores of every method, from one long table."""
    linkage = R.record_linkage(tables, features, metric)
    attack = R.membership_inference(tables, features, row_id, cap=cap)
    both = linkage.withColumnRenamed("source", "method").join(attack, "method")
    named = both.withColumn("method", formal_name("method"))
    return shared_table(named.join(judge_scores(trials), "method", "left"), "formal")


def correlation_table(measures):
    """The published columns: a zero judge score counts as absent."""
    shown = [F.nullif(c, F.lit(0.0)).alias(c) for c in ("llm_c1", "llm_c2", "llm_avg")]
    return measures.select("method", *shown, "mia_discrimination", "linkage_success_rate")


def measures_json(measures):
    """One JSON document per method with nested linkage and attack records."""
    linkage = F.struct("metric", "mean_distance", "std_distance", "min_distance", "max_distance", "median_distance",
                       "threshold", "linkage_success_rate")
    attack = F.struct("overall_accuracy", "auc", "accuracy_on_real", "accuracy_on_synthetic", "mia_discrimination",
                      "n_train", "n_test")
    return measures.select("method", F.to_json(F.struct(
        "method", linkage.alias("linkage_risk"), attack.alias("mia"), F.col("llm_c1").alias("llm_discrimination_c1"),
        F.col("llm_c2").alias("llm_discrimination_c2"), F.col("llm_avg").alias("llm_discrimination_avg"))).alias("document"))
