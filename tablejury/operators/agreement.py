"""Human annotations: de-duplication, aliases, pooled scores, and agreement with the judges."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.functions.ranking import prefix_sums, top_k
from tablejury.functions.stats import correlation_p_udf
from tablejury.schema import FAIR_MIN_N, REAL, SYNTHETIC
from tablejury.session import shared_table

ANNOTATION_KEY = ["session_id", "dataset", "method", "pair_id", "condition"]
CELL = ["dataset", "method", "condition"]


def dedupe_annotations(annotations, order=("source_path", "annotator_id")):
    """First row per annotation key in file order; copies are folded map-side, however many there are."""
    rest = [c for c in annotations.columns if c not in ANNOTATION_KEY]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return annotations.groupBy(*ANNOTATION_KEY).agg(first).select(*ANNOTATION_KEY, "_row.*")


def annotator_aliases(annotations):
    """HA1, HA2, ... by sorted annotator id, ranked over the distinct ids."""
    ids = annotations.select("annotator_id").distinct().withColumn("one", F.lit(1).cast("bigint"))
    return shared_table(prefix_sums(ids, [], ["annotator_id"], ["one"]).select(
        "annotator_id", F.concat(F.lit("HA"), F.col("cum_one").cast("string")).alias("annotator")), "aliases")


def with_aliases(deduped):
    """Add the alias; the written id table is broadcast while it is small, so busy annotators move no rows."""
    return deduped.join(annotator_aliases(deduped), "annotator_id")


def _rate(label, extra=None):
    mine = F.col("true_label") == label
    return F.lit(100.0) * F.avg(F.when(mine if extra is None else mine & extra, S.hit()))


def _drs(extra=None):
    real, syn = _rate(REAL, extra), _rate(SYNTHETIC, extra)
    return F.when(real.isNotNull() & syn.isNotNull(), F.least(real, syn))


def score_columns():
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_label") == REAL).alias("n_real"),
            F.count_if(F.col("true_label") == SYNTHETIC).alias("n_syn"),
            F.bround(_rate(REAL), 1).alias("p_real"), F.bround(_rate(SYNTHETIC), 1).alias("p_syn"),
            F.bround(_drs(), 1).alias("drs"), F.bround(F.lit(100.0) * F.avg(S.hit()), 1).alias("acc"),
            F.bround(F.avg("confidence"), 1).alias("conf")]


def annotator_scores(annotations, by=("annotator", *CELL)):
    return annotations.groupBy(*by).agg(*score_columns())


def pooled_scores(annotations):
    """Per annotator and over all annotators, in one pass."""
    return annotations.rollup("annotator").agg(*score_columns()) \
        .withColumn("annotator", F.coalesce("annotator", F.lit("Pooled")))


def pooled_with_annotators(annotations, annotators=("HA1", "HA2")):
    """One row per cell: pooled scores, each annotator's DRS, and their absolute difference."""
    each = [F.bround(_drs(F.col("annotator") == a), 1).alias(f"drs_{a.lower()}") for a in annotators]
    out = annotations.groupBy(*CELL).agg(*score_columns(), *each)
    if len(annotators) == 2:
        a, b = (f"drs_{x.lower()}" for x in annotators)
        out = out.withColumn("drs_diff", F.abs(F.col(a) - F.col(b)))
    return out


def mean_annotator_gap(pooled):
    return pooled.agg(F.avg("drs_diff").alias("mean_drs_diff"), F.count("drs_diff").alias("n_cells"))


def with_judges(pooled, cells, labels, min_n=FAIR_MIN_N):
    """Left-join judge N and DRS per model; DRS shows only where every model has enough trials."""
    judge = cells.groupBy(*CELL).agg(*[piece for name, label in labels.items() for piece in (
        F.max(F.when(F.col("provider_label") == label, F.col("n"))).alias(f"{name}_n"),
        F.max(F.when(F.col("provider_label") == label, F.col("drs"))).alias(f"_{name}_drs"))])
    out = pooled.join(judge, CELL, "left")
    counts = [F.coalesce(f"{name}_n", F.lit(0)) for name in labels]
    fair = (F.least(*counts) if len(counts) > 1 else counts[0]) >= min_n
    keep = [c for c in pooled.columns]
    return out.select(*keep, *[c.cast("bigint").alias(f"{n}_n") for n, c in zip(labels, counts)],
                      fair.alias("fair_cell"), *[F.when(fair, F.col(f"_{n}_drs")).alias(f"{n}_drs") for n in labels])


def session_counts(annotations):
    return annotations.groupBy("annotator", "dataset", "method") \
        .agg(F.count_distinct("session_id").alias("n_sessions"))


def condition_delta(annotations):
    """C1 and C2 DRS (rounded first) and their difference per annotator, dataset and method."""
    d1 = F.bround(_drs(F.col("condition") == "C1"), 1)
    d2 = F.bround(_drs(F.col("condition") == "C2"), 1)
    both = (F.count_if(F.col("condition") == "C1") > 0) & (F.count_if(F.col("condition") == "C2") > 0)
    return annotations.groupBy("annotator", "dataset", "method").agg(
        both.alias("_both"), d1.alias("drs_c1"), d2.alias("drs_c2"), F.round(d2 - d1, 1).alias("delta")) \
        .filter("_both").drop("_both")


def score_sheet(annotations, by):
    return annotations.groupBy(by).agg(
        F.sum(S.hit()).alias("n_correct"), F.count(F.lit(1)).alias("total"),
        F.round(F.lit(100.0) * F.avg(S.hit()), 1).alias("accuracy"))


def notes_digest(annotations, k=10):
    """First k non-blank notes per annotator in file order."""
    return top_k(annotations.filter(F.trim("notes") != ""), ["annotator"], k, "source_path", "pair_id", "condition",
                 rank_column="position")


def human_vs_judge_long(joined, names):
    """One row per cell and model with both scores, wide to long, absent judge scores dropped."""
    wide = joined.select(*CELL, F.col("drs").alias("human_drs"), *[F.col(f"{n}_drs").alias(n) for n in names])
    return wide.unpivot([*CELL, "human_drs"], list(names), "model", "llm_drs").filter(F.col("llm_drs").isNotNull())


def spearman(df, x, y, by):
    """Tie-averaged rank correlation with its two-sided p per group.

    Pairs are first folded to distinct (x, y) with counts; ranks come from
    distributed running totals, so no group is gathered. Undefined (NULL) below
    two pairs or when a side is constant.
    """
    by = list(by)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))

    def ranks(v):
        counted = pairs.groupBy(*by, v).agg(F.sum("c").alias("k"))
        return prefix_sums(counted, by, [v], ["k"]).select(
            *by, v, (F.col("cum_k") - F.col("k") + (F.col("k") + 1) / 2.0).alias(f"_r_{v}"))

    ranked = pairs.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    n = F.sum("c")
    sums = ranked.groupBy(*by).agg(
        n.alias("n"), *[F.sum(F.col("c") * F.col(f"_r_{a}") * F.col(f"_r_{b}")).alias(f"_s{i}")
                        for i, (a, b) in enumerate(((x, y), (x, x), (y, y)))])
    shift = F.col("n") * F.pow((F.col("n") + 1) / 2.0, 2)
    cov, var_x, var_y = (F.col(f"_s{i}") - shift for i in range(3))
    rho = cov / F.nullif(F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0))), F.lit(0.0))
    return sums.select(*by, "n", rho.alias("rho")) \
        .withColumn("p_value", correlation_p_udf("rho", F.col("n").cast("double")))


def agreement_correlation(long):
    """Spearman overall and per model."""
    scoped = long.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("model"))))
    return spearman(scoped, "human_drs", "llm_drs", ["scope"])


def bland_altman(long, by=()):
    diff = F.col("llm_drs") - F.col("human_drs")
    grouped = long.groupBy(*by) if by else long
    mean, sd = F.avg(diff), F.when(F.count(diff) >= 2, F.stddev_samp(diff))
    return grouped.agg(F.count(diff).alias("n"), mean.alias("mean_diff"), sd.alias("sd_diff"),
                       (mean - F.lit(1.96) * sd).alias("loa_low"), (mean + F.lit(1.96) * sd).alias("loa_high"))


def bland_altman_points(long):
    return long.withColumn("mean_score", (F.col("human_drs") + F.col("llm_drs")) / 2.0) \
        .withColumn("diff", F.col("llm_drs") - F.col("human_drs"))


def answer_pairs(pairs):
    """Turn one row per judged pair into its C1 and C2 records."""
    def record(c):
        vote = F.col(f"{c.lower()}_vote")
        return F.struct(F.lit(c).alias("condition"), vote.alias("predicted_label"),
                        (vote == F.col("true_label")).alias("correct"),
                        F.col(f"{c.lower()}_conf").alias("confidence"), F.col(f"{c.lower()}_notes").alias("notes"))

    keep = [c for c in pairs.columns if not c.startswith(("c1_", "c2_"))]
    return pairs.select(*keep, F.explode(F.array(record("C1"), record("C2"))).alias("_r")).select(*keep, "_r.*")


