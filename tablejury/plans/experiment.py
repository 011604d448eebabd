"""A whole judging experiment as one job: queue, rows, prompts, verdicts, trials."""

from pyspark.sql import functions as F

from tablejury.operators import backfill as B, prompts as R, sampling as Q
from tablejury.schema import REAL, ROWS_SHOWN
from tablejury.session import dropping_shuffles, shared_folder, shared_table


def run_experiment(tables, targets, columns, row_id, provider=None, model=None, judge=R.rule_judge, seed=42,
                   n_rows=ROWS_SHOWN, done=None, real_source="real"):
    """Trial records for every queued trial of every method.

    ``tables`` is one long table keyed by ``source``; ``targets`` has (method, n_trials)
    and, for several runs at once, any of dataset, provider and model. Profiles are
    computed once per table, samples cost a few lookups per trial, and ``done``
    (completed slots of the same runs) is left out. Many trials are judged and written in
    waves, so that only the draws of one wave are on disk at a time.
    """
    run = [c for c in B.RUN if c in targets.columns]
    queue = Q.trial_queue(targets, seed)
    if done is not None:
        queue = B.remaining_queue(queue, done)
    requests = queue.withColumn("source", F.when(F.col("true_label") == REAL, real_source).otherwise(F.col("method")))
    index = R.row_index(tables, seed, row_id, columns)
    profiles = R.profile_text(tables, ["source"], columns, row_id)
    slot = [*run, "method", "condition", "true_label", "rep"]

    def name(column, value):
        return F.col(column) if column in run else F.lit(value)

    def judged(wave):
        prompts = R.numbered_prompts(wave, index, slot, columns, F.col("condition"), profiles, n_rows, seed)
        return R.trial_rows(R.judge_prompts(prompts, judge=judge), name("provider", provider), name("model", model))

    waves = index.waves(index.numbered(requests))
    if len(waves) == 1:
        return judged(waves[0])
    spark = tables.sparkSession
    path = shared_folder(spark, "trials")
    with dropping_shuffles(spark):
        profiles = shared_table(profiles, "profiles")
        for wave in waves:
            trials = judged(wave)
            trials.write.mode("append").parquet(path)
    return spark.read.schema(trials.schema).parquet(path)
