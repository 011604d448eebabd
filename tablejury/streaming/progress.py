"""Live progress and live disclosure risk over a folder that trial files land in.

Both write each micro-batch to its own folder below a shared one and are read from
there; replaying a batch overwrites its folder, so nothing is counted twice.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tablejury.functions import scalar as S
from tablejury.schema import TRIAL, VALID_LABELS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = ["dataset", "provider", "method", "condition"]
CHUNK = 512
SEEN = {"trial_id": "long", "time": "long", "provider": "string", "method": "string", "condition": "string", "true_label": "string", "predicted_label": "string"}


def stream_trials(spark, folder, schema=TRIAL, files_per_trigger=None):
    """New JSON-lines files as they appear; malformed lines arrive all-NULL and are dropped."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(folder).withColumn("source_path", F.col("_metadata.file_path"))
    return rows.filter(F.col("trial_id").isNotNull() | F.col("predicted_label").isNotNull())


def _method():
    return F.coalesce("synthetic_method", "method", F.lit("unknown"))


def _save(folder, make):
    def save(batch, batch_id):
        batch.persist()  # the state is walked through once, whatever is written
        for name, df in make(batch).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        batch.unpersist()
    return save


# ---- progress -----------------------------------------------------------------------

def progress(rows):
    """Valid and failed trials per method and provider; running state is one row per group."""
    return rows.groupBy(_method().alias("method"), "provider").agg(
        F.count_if(S.not_error()).alias("valid"), F.count_if(~S.not_error()).alias("errors"))


def start_progress(rows, folder, checkpoint):
    """Write the groups that a micro-batch changed, with their new counts, to its own folder."""
    return (progress(rows).writeStream.outputMode("update").foreachBatch(_save(folder, lambda batch: {"progress": batch}))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def live_progress(spark, folder, target=20):
    """The last counts written for every group, with a status."""
    last = spark.read.parquet(f"{folder}/progress").groupBy("method", "provider").agg(
        F.max_by("valid", "batch").alias("valid"), F.max_by("errors", "batch").alias("errors"))
    return last.withColumn("status", S.progress_status(F.col("valid"), F.col("errors"), target))


# ---- disclosure risk ------------------------------------------------------------------

def run_of(path):
    """The run a line belongs to: its result file (a file or folder named ``*.jsonl``), else the folder it lies in."""
    named = F.regexp_extract(path, r"([^/]+\.jsonl)(/[^/]*)?$", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))


class LatestTrials(StatefulProcessor):
    """One record per trial: a later one replaces it and takes its count back.

    A key is a data set, a run and CHUNK successive trial numbers, whose records are one
    state value. Output rows are changes to add up (``kind`` count, ``change`` 1 or -1) and
    records not newer than the watermark, which change nothing (``kind`` late). Trials are
    forgotten once the watermark has reached them, so state holds those of the last ``delay``
    only. Of records of equal time the last in order of their fields counts.
    """

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("trials", ", ".join(f"{n} array<{kind}>" for n, kind in SEEN.items()))

    def _seen(self):
        return pd.DataFrame(dict(zip(SEEN, self.state.get() if self.state.exists() else [[] for _ in SEEN], strict=True)))

    def _keep(self, seen):
        if len(seen):
            self.state.update(tuple(seen[n].astype(object).where(seen[n].notna(), None).tolist() for n in SEEN))
            self.handle.registerTimer(int(seen["time"].min()))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        dataset, run, _ = key
        new, seen = pd.concat(list(rows))[list(SEEN)], self._seen()
        late = new["time"] <= timerValues.getCurrentWatermarkInMs()
        both = pd.concat([seen.assign(change=0), new[~late].assign(change=1)]) if len(seen) else new[~late].assign(change=1)
        last = both.sort_values(list(SEEN), na_position="first", kind="stable").drop_duplicates("trial_id", keep="last")
        changed = last[last["change"] == 1]
        if len(changed):
            if len(seen):
                self.handle.deleteTimer(int(seen["time"].min()))
            self._keep(last)
        taken_back = seen[seen["trial_id"].isin(changed["trial_id"])]
        out = pd.concat([part.assign(kind=kind, change=change) for part, kind, change in (
            (changed, "count", 1), (taken_back, "count", -1), (new[late], "late", 0)) if len(part)] or [changed.assign(kind="")])
        yield out.assign(dataset=dataset, run=run)[["kind", "dataset", "run", *SEEN, "change"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = self._seen()
        self._keep(seen[seen["time"] > timerValues.getCurrentWatermarkInMs()])
        yield pd.DataFrame([], columns=["kind", "dataset", "run", *SEEN, "change"])

    def close(self):
        pass


def latest_trials(rows, delay="2 days"):
    """Changes and late records of every trial (see LatestTrials); records without a time or number are left out."""
    keyed = (rows.withColumn("event", F.to_timestamp("timestamp")).filter(F.col("event").isNotNull() & F.col("trial_id").isNotNull())
             .withWatermark("event", delay)
             .select(S.dataset_from_path("source_path").alias("dataset"), run_of("source_path").alias("run"), F.expr(f"trial_id div {CHUNK}").alias("chunk"),
                     "trial_id", F.unix_millis("event").alias("time"), "provider", _method().alias("method"), "condition", "true_label", "predicted_label"))
    shape = ", ".join(f"{n} {kind}" for n, kind in SEEN.items())
    return keyed.groupBy("dataset", "run", "chunk").transformWithStateInPandas(
        LatestTrials(), f"kind string, dataset string, run string, {shape}, change int", "append", "EventTime")


def partial_counts(changes, by=CELL):
    """Counts that add up over batches, from which every cell metric follows."""
    right = F.col("predicted_label") == F.col("true_label")
    return changes.filter(F.col("kind") == "count").filter(F.col("predicted_label").isin(*VALID_LABELS)).groupBy(*by, "true_label").agg(
        F.sum("change").alias("n"), F.sum(F.when(right, F.col("change")).otherwise(0)).alias("n_correct"))


def start_live_counts(rows, folder, checkpoint, by=CELL, delay="2 days"):
    """Write each micro-batch's changes of the counts, and its late records, to their own folders."""
    spark = rows.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # a stream keeps the store it starts with; others keep theirs
    try:
        return (latest_trials(rows, delay).writeStream.outputMode("append")
                .foreachBatch(_save(folder, lambda batch: {"counts": partial_counts(batch, by), "late": batch.filter("kind = 'late'").drop("kind", "change")}))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def late_trials(spark, folder):
    """Records that came after the watermark had passed their time, with the batch they came in."""
    return spark.read.parquet(f"{folder}/late")


def live_drs(spark, folder, by=CELL):
    """DRS per cell from the counts written so far."""
    counts = spark.read.parquet(f"{folder}/counts").groupBy(*by, "true_label").agg(
        F.sum("n").alias("n"), F.sum("n_correct").alias("k"))

    def of(label, c):
        return F.coalesce(F.sum(F.when(F.col("true_label") == label, F.col(c))), F.lit(0))

    p_real, p_syn = S.pct(of("REAL", "k"), of("REAL", "n")), S.pct(of("SYNTHETIC", "k"), of("SYNTHETIC", "n"))
    return counts.groupBy(*by).agg(
        of("REAL", "n").alias("n_real"), of("SYNTHETIC", "n").alias("n_syn"), p_real.alias("p_real_correct"),
        p_syn.alias("p_syn_correct"),
        F.when(p_real.isNotNull() & p_syn.isNotNull(), F.least(p_real, p_syn)).alias("drs"))
