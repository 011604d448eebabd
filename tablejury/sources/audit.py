"""Dataset checks, inventory, and the audit and quarantine of result files."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.operators.clean import allow_list
from tablejury.schema import APPROVED_MODELS, EXPECTED_SYNTHETIC
from tablejury.session import literal_table, shared_table


def validate_methods(tables, expected=EXPECTED_SYNTHETIC, by="method"):
    """Expected methods against what was found: existence and row count."""
    wanted = literal_table(tables.sparkSession, [(m,) for m in expected], ["method"])
    found = tables.groupBy(F.col(by).alias("method")).agg(F.count(F.lit(1)).alias("n_rows"))
    width = len([c for c in tables.columns if c != by])
    return wanted.join(found, "method", "left").select(
        "method", F.col("n_rows").isNotNull().alias("exists"), "n_rows",
        F.when(F.col("n_rows").isNotNull(), F.lit(width)).alias("n_columns"))


def inventory(tables, by="source", exclude=()):
    """One row per dataset and column with the dataset's row count; the schema part needs no scan."""
    columns = [(c, t, i) for i, (c, t) in enumerate((c, t) for c, t in tables.dtypes if c != by and c not in exclude)]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(i).alias("position"))
                                for c, t, i in columns]))
    counts = tables.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("_c", cells).select(by, "n_rows", F.lit(len(columns)).alias("n_columns"), "_c.*")


def inventory_documents(inventory_rows, by="source"):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "column", "dtype"))),
                         lambda x: F.struct(x["column"].alias("column"), x["dtype"].alias("dtype")))
    return inventory_rows.groupBy(by, "n_rows", "n_columns").agg(listed.alias("columns")) \
        .select(by, F.to_json(F.struct(by, "n_rows", "n_columns", "columns")).alias("document"))


def audit_files(rows, order="line_no"):
    """Per file: last provider and model seen, total and valid lines; malformed lines count as total only.

    ``rows`` has ``source_path``, the trial fields (NULL on malformed lines) and
    a line order; all folds are map-side.
    """
    def last(c):
        return F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), F.lit("?"))

    return rows.groupBy("source_path").agg(
        last("provider").alias("provider"), last("model").alias("model"), F.count(F.lit(1)).alias("total_lines"),
        F.count_if(S.is_valid_label()).alias("valid_lines"))


def classify_files(audit, archive_zero_valid=False, models=APPROVED_MODELS):
    """Reason for quarantine, or NULL for files that stay."""
    known = allow_list(audit.sparkSession, models).select("provider", "model", F.lit(True).alias("_ok"))
    marked = audit.join(F.broadcast(known), ["provider", "model"], "left")  # a fixed list of a few rows
    zero = F.lit(archive_zero_valid) & (F.col("valid_lines") == 0)
    return marked.withColumn("reason", F.when(F.col("_ok").isNull(), "unapproved_model").when(zero, "zero_valid")) \
        .drop("_ok")


def split_quarantine(rows, classified):
    """(kept rows, quarantined rows with their reason)."""
    reasons = shared_table(classified.select("source_path", "reason"), "reasons")  # one row per file
    marked = rows.join(reasons, "source_path")
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def quarantine(rows, classified, root=None):
    """The plan by default; with ``root`` the quarantined rows are written below ``reason=...``."""
    _, bad = split_quarantine(rows, classified)
    if root is not None:
        bad.write.mode("append").partitionBy("reason").json(root)
    return classified.filter(F.col("reason").isNotNull())
