"""Which trials are still missing: resume by anti-join, and the backfill plan."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.functions.digests import digest
from tablejury.functions.ranking import digest_rank
from tablejury.operators import metrics as M

RUN = ["dataset", "provider", "model"]  # each is judged by itself: its successes fill its own queue only
CELL = ["method", "condition", "true_label"]


def completed_slots(trials, seed, keys=None):
    """Successful trials numbered within their run and cell, so that they fill queue slots 1, 2, ..."""
    keys = list(keys) if keys else [*[c for c in RUN if c in trials.columns], *CELL]
    good = trials.filter(S.not_error()).withColumn("_digest", digest(seed, "trial_id"))
    return digest_rank(good, keys, tie=["trial_id"], rank_column="rep").select(*keys, "rep", "trial_id")


def _slot(queue, completed):
    """What names a slot: every field of the completed slots but the trial's number; the queue must have them all."""
    slot = [c for c in completed.columns if c != "trial_id"]
    if missing := [c for c in slot if c not in queue.columns]:
        raise ValueError(f"the queue lacks {missing}: name the run, or number the trials without it")
    return slot


def remaining_queue(queue, completed, slot=None):
    """Queue slots without a successful trial."""
    slot = slot or _slot(queue, completed)
    return queue.join(completed.select(*slot), list(slot), "left_anti")


def resume_summary(queue, completed, slot=None):
    slot = slot or _slot(queue, completed)
    keys = [k for k in slot if k != "rep"]
    marked = queue.join(completed.select(*slot, F.lit(1).alias("_done")), list(slot), "left")
    return marked.groupBy(*keys).agg(F.count("_done").alias("n_kept"),
                                     F.count_if(F.col("_done").isNull()).alias("n_remaining"))


def backfill_plan(grid, trials, target_valid, batch_size, max_batches, by=("provider", "model")):
    """Per cell: valid trials, the gap to the target, the batch (even, at least batch_size) and the action."""
    keys = [*by, "method", "condition"]
    counts = M.valid_cell_counts(trials, *keys)
    gap = F.greatest(F.lit(0), F.lit(target_valid) - F.col("valid"))
    batch = F.greatest(F.lit(batch_size), F.col("gap"))
    even = batch + batch % 2
    plan = M.fill_grid(grid, counts, keys, ["valid"]).withColumn("gap", gap)
    return plan.select(
        *keys, "valid", "gap", F.when(F.col("gap") > 0, even).otherwise(F.lit(0)).alias("batch_trials"),
        F.when(F.col("gap") == 0, "OK").when(F.lit(max_batches) <= 0, "STOP").otherwise("RUN").alias("action"),
        F.when(F.col("gap") > 0, F.least(F.lit(max_batches), F.ceil(F.col("gap") / even))).otherwise(F.lit(0))
        .cast("int").alias("n_batches"))


def failed_batches(trials, batch):
    """Batches and whether every one of their trials failed."""
    return trials.groupBy(batch).agg(F.count(F.lit(1)).alias("n"),
                                     F.bool_and(~S.is_valid_label()).alias("all_errored"))
