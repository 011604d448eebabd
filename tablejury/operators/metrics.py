"""Accuracy, disclosure-risk, privacy, calibration and coverage tables over trials.

Every table is one aggregation with map-side combining: correctness is reduced
to per-cell counts before anything is shuffled, so hot cells cost nothing extra.
"""

from pyspark.sql import Window as W, functions as F

from tablejury.functions import scalar as S
from tablejury.schema import CONDITIONS, FAIR_MIN_N, METHODS, REAL, SYNTHETIC
from tablejury.session import literal_table

CELL = ["dataset", "provider_label", "method", "condition"]


def _is(label):
    return F.col("true_label") == label


def _rate(label):
    return F.lit(100.0) * F.avg(F.when(_is(label), S.hit()))


def _drs(p_real, p_syn, empty_class):
    """The smaller class accuracy; an absent class gives NULL or zero."""
    if empty_class == "zero":
        return F.least(F.coalesce(p_real, F.lit(0.0)), F.coalesce(p_syn, F.lit(0.0)))
    return F.when(p_real.isNotNull() & p_syn.isNotNull(), F.least(p_real, p_syn))


def metric_columns(empty_class="null"):
    p_real, p_syn = _rate(REAL), _rate(SYNTHETIC)
    shown_real, shown_syn = p_real, p_syn
    if empty_class == "zero":
        shown_real, shown_syn = F.coalesce(p_real, F.lit(0.0)), F.coalesce(p_syn, F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(_is(REAL)).alias("n_real"),
        F.count_if(_is(SYNTHETIC)).alias("n_syn"), (F.lit(100.0) * F.avg(S.hit())).alias("accuracy"),
        shown_real.alias("p_real_correct"), shown_syn.alias("p_syn_correct"),
        _drs(p_real, p_syn, empty_class).alias("drs"),
        (F.lit(100.0) * F.avg((F.col("predicted_label") == REAL).cast("int"))).alias("pred_real_rate"),
        F.avg("confidence").alias("avg_conf"),
    ]


def cell_metrics(trials, by=CELL, empty_class="null"):
    """N per class, accuracy, class accuracies, DRS, REAL rate and mean confidence per cell."""
    return trials.groupBy(*by).agg(*metric_columns(empty_class))


def metrics_rollup(trials, by):
    """The same with subtotals and a grand total (NULL keys)."""
    return trials.rollup(*by).agg(*metric_columns())


def accuracy_by(trials, *by):
    out = trials.groupBy(*by) if by else trials
    return out.agg(F.sum(S.hit()).alias("n_correct"), F.count(F.lit(1)).alias("n"),
                   F.avg(S.hit()).alias("accuracy"))


def accuracy_sets(trials, singles, pairs=()):
    """Accuracy by every listed key, key pair and overall in one pass (grouping sets)."""
    names = list(dict.fromkeys([*singles, *[c for p in pairs for c in p]]))
    sets = [[F.col(s)] for s in singles] + [[F.col(c) for c in p] for p in pairs] + [[]]
    grouped = trials.groupingSets(sets, *[F.col(c) for c in names])
    return grouped.agg(F.grouping_id().alias("level"), F.sum(S.hit()).alias("n_correct"),
                       F.count(F.lit(1)).alias("n"), F.avg(S.hit()).alias("accuracy"))


def accuracy_with_confidence(trials, *by):
    acc = F.avg(S.hit())
    return trials.groupBy(*by).agg(
        F.sum(S.hit()).alias("n_correct"), F.count(F.lit(1)).alias("n"), F.bround(acc, 3).alias("accuracy"),
        S.whole_percent(acc).alias("accuracy_pct"), F.bround(F.avg("confidence"), 3).alias("avg_confidence"))


def discrimination(trials, denominator="half"):
    """Mean of both class accuracies per method and condition.

    ``half`` divides by half of all trials (error rows included), ``class`` by
    the true class sizes.
    """
    named = trials.withColumn("method", S.normalise_method("synthetic_method")).filter(F.col("method").isNotNull())
    both = F.col("true_label") == F.col("predicted_label")
    counts = named.groupBy("method", "condition").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(both & _is(REAL)).alias("real_correct"),
        F.count_if(both & _is(SYNTHETIC)).alias("synthetic_correct"),
        F.count_if(_is(REAL)).alias("class_real"), F.count_if(_is(SYNTHETIC)).alias("class_syn"))
    half = F.floor(F.col("trials") / 2)
    n_real, n_syn = (half, F.col("trials") - half) if denominator == "half" else (F.col("class_real"), F.col("class_syn"))
    zero = F.lit(0.0)
    real = F.coalesce(S.ratio(F.col("real_correct"), n_real), zero)
    syn = F.coalesce(S.ratio(F.col("synthetic_correct"), n_syn), zero)
    return counts.select("method", "condition", "trials", real.alias("accuracy_real"),
                         syn.alias("accuracy_synthetic"), ((real + syn) / 2).alias("discrimination"))


def privacy_scores(trials):
    """Accuracy and 100 - accuracy per condition, condition x method, condition x label."""
    c, m, t = F.col("condition"), F.col("method"), F.col("true_label")
    known = trials.filter(F.col("condition").isin(*CONDITIONS) & F.col("true_label").isin(REAL, SYNTHETIC))
    acc = F.lit(100.0) * F.avg(S.hit())
    return known.groupingSets([[c], [c, m], [c, t]], c, m, t).agg(
        F.when(F.grouping("method") == 0, "method").when(F.grouping("true_label") == 0, "label")
        .otherwise("condition").alias("level"),
        acc.alias("accuracy"), (100 - acc).alias("privacy_score"), F.avg("confidence").alias("avg_confidence"),
        F.count(F.lit(1)).alias("n_trials"))


def condition_impact(trials):
    """Privacy lost from C1 to C2, overall and per method: absolute and relative."""
    m = F.col("method")

    def privacy(condition):
        return 100 - F.lit(100.0) * F.avg(F.when(F.col("condition") == condition, S.hit()))

    wide = trials.groupingSets([[], [m]], m).agg(
        F.grouping("method").alias("_all"), privacy("C1").alias("c1_privacy"), privacy("C2").alias("c2_privacy"))
    lost = F.col("c1_privacy") - F.col("c2_privacy")
    relative = F.when(F.col("c1_privacy") > 0, lost / F.nullif("c1_privacy", F.lit(0.0)) * 100) \
        .when(F.col("_all") == 0, F.lit(0.0))
    return (wide.filter((F.col("_all") == 1) | (F.col("c1_privacy").isNotNull() & F.col("c2_privacy").isNotNull()))
            .select(F.when(F.col("_all") == 1, "all").otherwise(m).alias("scope"), "c1_privacy", "c2_privacy",
                    lost.alias("absolute"), relative.alias("relative")))


def condition_table(trials):
    """Per method: privacy score, confidence and trials side by side for C1 and C2."""
    def pick(condition, value):
        return F.when(F.col("condition") == condition, value)

    out = trials.filter(F.col("condition").isin(*CONDITIONS)).groupBy("method").agg(*[
        piece for c in CONDITIONS for piece in (
            (100 - F.lit(100.0) * F.avg(pick(c, S.hit()))).alias(f"{c.lower()}_privacy_score"),
            F.avg(pick(c, F.col("confidence"))).alias(f"{c.lower()}_avg_confidence"),
            F.nullif(F.count(pick(c, F.lit(1))), F.lit(0)).alias(f"{c.lower()}_trials"))])
    return out.withColumn("degradation_pp", F.col("c1_privacy_score") - F.col("c2_privacy_score"))


def accuracy_by_label_table(trials):
    return trials.filter(F.col("condition").isin(*CONDITIONS)).groupBy("method", "condition").agg(
        _rate(REAL).alias("accuracy_on_real"), _rate(SYNTHETIC).alias("accuracy_on_synthetic"))


def tag_sources(llm, human):
    """Judge and human trials in one table with a ``source`` tag."""
    return llm.withColumn("source", F.lit("LLM")).unionByName(
        human.withColumn("source", F.lit("Human")), allowMissingColumns=True)


def head_to_head(llm, human):
    keep = ["condition", "true_label", "correct"]
    both = tag_sources(llm.select(*keep), human.select(*keep))
    return both.filter(F.col("condition").isin(*CONDITIONS) & F.col("true_label").isin(REAL, SYNTHETIC)) \
        .groupBy("condition", "true_label", "source") \
        .agg(F.avg(S.hit()).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def accuracy_summary(llm, human):
    keep = ["condition", "true_label", "correct"]
    return tag_sources(llm.select(*keep), human.select(*keep)).groupBy("source", "condition", "true_label") \
        .agg(F.avg(S.hit()).alias("accuracy"), F.sum(S.hit()).alias("n_correct"), F.count(F.lit(1)).alias("total"))


def provider_accuracy(trials, by=("provider_label",), min_n=0):
    return accuracy_by(trials, *by).filter(F.col("n") >= min_n)


def provider_by_dataset(trials, min_n=5):
    """Provider accuracy with one column pair per dataset; thin cells give NULL."""
    def part(dataset):
        own = F.col("dataset") == dataset
        n = F.count_if(own)
        acc = F.lit(100.0) * F.avg(F.when(own, S.hit()))
        return [F.when(n >= min_n, acc).alias(f"{dataset}_accuracy"), n.alias(f"{dataset}_n")]

    return trials.groupBy("provider_label").agg(*part("adult"), *part("census"))


def confidence_by_outcome(trials, *by):
    grouped = trials.groupBy(*by) if by else trials
    return grouped.agg(
        F.avg(F.when(F.col("correct"), F.col("confidence"))).alias("conf_correct"),
        F.avg(F.when(~F.col("correct"), F.col("confidence"))).alias("conf_wrong"),
        F.count_if(F.col("correct")).alias("n_correct"), F.count_if(~F.col("correct")).alias("n_wrong"))


def calibration(trials, width=20, top=100):
    """Accuracy per right-closed confidence bucket; confidence 0 falls outside."""
    bucket = F.ceil(F.col("confidence") / width).cast("int")
    return trials.filter((F.col("confidence") > 0) & (F.col("confidence") <= top)) \
        .groupBy("condition", bucket.alias("bucket")) \
        .agg(((bucket - 1) * width).alias("low"), (bucket * width).alias("high"),
             F.count(F.lit(1)).alias("n"), F.avg(S.hit()).alias("accuracy"))


def prediction_shares(trials):
    """Share of each predicted label per true label."""
    counts = trials.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("true_label")))


def prediction_bias(trials, labels=(REAL, SYNTHETIC, "ERROR")):
    total = F.count("predicted_label")
    return trials.groupBy("true_label").agg(*[
        S.ratio(F.nullif(F.count_if(F.col("predicted_label") == p), F.lit(0)), total).alias(f"share_{p.lower()}")
        for p in labels])


def method_condition_matrix(trials):
    return trials.groupBy("method").pivot("condition", list(CONDITIONS)).agg(F.avg(S.hit()))


def coverage(trials, labels, min_n=FAIR_MIN_N):
    """Trials per model in each dataset x method x condition, their minimum, and the fairness flag."""
    wide = trials.groupBy("dataset", "method", "condition").agg(
        *[F.count_if(F.col("provider_label") == label).alias(name) for name, label in labels.items()])
    least = F.least(*[F.col(n) for n in labels]) if len(labels) > 1 else F.col(next(iter(labels)))
    return wide.withColumn("n_min", least).withColumn("fair_cell", F.col("n_min") >= min_n)


def fair_keys(coverage_table):
    return coverage_table.filter("fair_cell").select("dataset", "method", "condition")


def valid_cell_counts(trials, *by):
    return trials.groupBy(*by).agg(F.count_if(S.is_valid_label()).alias("valid"))


def valid_and_errors(trials, *by):
    return trials.groupBy(*by).agg(F.count_if(S.not_error()).alias("valid"),
                                   F.count_if(~S.not_error()).alias("errors"))


def drs_paper_table(trials):
    """C1 and C2 DRS in percent, their mean with absence as zero, and the N of each."""
    def part(c):
        mine = F.col("condition") == c
        real = F.avg(F.when(mine & _is(REAL), S.hit()))
        syn = F.avg(F.when(mine & ~_is(REAL), S.hit()))
        return _drs(real, syn, "zero") * 100, F.count_if(mine)

    (d1, n1), (d2, n2) = part("C1"), part("C2")
    return trials.groupBy("method").agg(d1.alias("c1_drs"), d2.alias("c2_drs"), ((d1 + d2) / 2).alias("avg_drs"),
                                        n1.alias("n_c1"), n2.alias("n_c2"))


def mean_drs(cells, missing="skip"):
    """Mean DRS of C1 and C2 per method; a missing condition is skipped or counts as zero."""
    def of(c):
        return F.max(F.when(F.col("condition") == c, F.col("drs")))

    if missing == "zero":
        value = (F.coalesce(of("C1"), F.lit(0.0)) + F.coalesce(of("C2"), F.lit(0.0))) / 2
    else:
        value = F.avg("drs")
    return cells.groupBy("method").agg(value.alias("mean_drs"))


def verdict_breakdown(trials, by="provider"):
    return trials.groupBy(by).agg(F.coalesce(_rate(REAL), F.lit(0.0)).alias("real_correct_pct"),
                                  F.coalesce(_rate(SYNTHETIC), F.lit(0.0)).alias("synthetic_correct_pct"))


def privacy_ranking(trials, by="synthetic_method"):
    """Methods from best to worst privacy (lowest accuracy first); ranks one row per method."""
    acc = accuracy_by(trials, by).withColumn("accuracy_pct", F.col("accuracy") * 100)
    return acc.withColumn("rank", F.row_number().over(W.orderBy("accuracy", by))) \
        .withColumn("band", S.privacy_band(F.col("accuracy_pct")))


def by_condition_gap(trials):
    """Methods by the size of their privacy gap between conditions, widest first."""
    table = condition_table(trials)
    gap = F.coalesce("c1_privacy_score", F.lit(0.0)) - F.coalesce("c2_privacy_score", F.lit(0.0))
    return table.select("method", gap.alias("difference")).orderBy(F.abs("difference").desc(), "method")


def full_grid(spark, methods=METHODS, conditions=CONDITIONS):
    """Every method x condition, from two fixed lists."""
    return literal_table(spark, [(m, c) for m in methods for c in conditions], ["method", "condition"])


def fill_grid(grid, counts, keys, columns):
    return grid.join(counts, keys, "left").na.fill(0, columns)
