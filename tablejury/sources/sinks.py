"""Writers: append-only trial log, CSV tables, nested JSON documents and the per-method layout."""

import uuid
from urllib.parse import unquote

from pyspark.sql import functions as F


def append_trials(trials, path):
    trials.write.mode("append").json(path)


def write_csv(df, path, mode="overwrite"):
    df.write.mode(mode).option("header", True).csv(path)


def write_documents(df, path, column="document"):
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def nested_document(df, fields, name="document"):
    """One JSON text per row from the named fields."""
    return df.select(F.to_json(F.struct(*fields)).alias(name))


def condition_documents(privacy_scores):
    """One nested document per condition: overall scores, by method and by label.

    The lists hold one entry per method and label, not per trial.
    """
    entry = F.struct(F.coalesce("method", "true_label").alias("name"), "accuracy", "privacy_score", "n_trials")

    def part(level):
        return F.array_sort(F.collect_list(F.when(F.col("level") == level, entry)))

    def overall(c):
        return F.max(F.when(F.col("level") == "condition", F.col(c)))

    grouped = privacy_scores.groupBy("condition").agg(
        overall("accuracy").alias("overall_accuracy"), overall("privacy_score").alias("privacy_score"),
        overall("n_trials").alias("n_total"), part("method").alias("by_method"), part("label").alias("by_label"))
    return grouped.select("condition", F.to_json(F.struct(
        "condition", "overall_accuracy", "privacy_score", "n_total", "by_method", "by_label")).alias("document"))


def write_methods(tables, root, by="method", fmt="csv", name="synthetic"):
    """``{root}/{method}/{name}.{fmt}`` for every method, written in one job and published at its end.

    The job writes below a staging folder of ``root``; only when all of it is there are the
    methods moved into place, each replacing what stood there. A failed job leaves the old
    tables. A table is a folder of part files, so a method with most rows is written by many
    tasks. Rows without a method are an error; an empty table writes no method.
    """
    spark, root = tables.sparkSession, root.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging = path(f"{root}/_staging-{uuid.uuid4().hex}")
    files = staging.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = tables.withColumn(by, F.coalesce(F.col(by).cast("string"), F.raise_error(F.lit(f"a row has no {by}"))))
    writer = named.write.partitionBy(by)
    try:
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(staging.toString())
        for folder in files.listStatus(staging):
            label = folder.getPath().getName()
            if not label.startswith(f"{by}="):
                continue
            target = path(f"{root}/{unquote(label[len(by) + 1:])}/{name}.{fmt}")
            files.mkdirs(target.getParent())
            files.delete(target, True)
            if not files.rename(folder.getPath(), target):
                raise OSError(f"cannot move {label} to {target.toString()}")
    finally:
        files.delete(staging, True)


def write_method_folder(table, root, method, file_name="synthetic.csv"):
    write_csv(table, f"{root}/{method}/{file_name}")
