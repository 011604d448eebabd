"""Trial cleaning and micro-table preparation."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.schema import APPROVED_MODELS
from tablejury.session import literal_table


def allow_list(spark, models=APPROVED_MODELS):
    """The approved (provider, model) pairs with their display label: a fixed, tiny table."""
    return literal_table(spark, models, ["provider", "model", "provider_label"])


def drop_errors(trials):
    return trials.filter(S.not_error())


def keep_valid(trials, true_label=False):
    kept = trials.filter(S.is_valid_label())
    return kept.filter(S.is_valid_label("true_label")) if true_label else kept


def keep_approved(trials, models=APPROVED_MODELS):
    """Inner join to the allow-list, which is a constant of a few rows and so safe to broadcast."""
    return trials.join(F.broadcast(allow_list(trials.sparkSession, models)), ["provider", "model"])


def clean_trials(trials, mode="approved", confidence="positive", models=APPROVED_MODELS):
    """``raw``, ``no_error`` or ``approved`` trials with ``method`` filled and confidence cleaned."""
    if mode == "approved":
        out = keep_approved(keep_valid(trials), models)
    else:
        out = (drop_errors(trials) if mode == "no_error" else trials) \
            .withColumn("provider_label", F.col("provider"))
    fields = out.columns
    fallback = [F.col(c) for c in ("synthetic_method", "method") if c in fields]
    return (out.withColumn("method", F.coalesce(*fallback, F.lit("unknown")))
            .withColumn("confidence", S.clean_confidence("confidence", confidence)))


def disposition(trials, models=APPROVED_MODELS):
    """Why each line is kept or dropped: invalid label, excluded model, or kept."""
    marked = trials.join(F.broadcast(allow_list(trials.sparkSession, models)), ["provider", "model"], "left")
    return marked.withColumn(
        "disposition", F.when(~S.is_valid_label(), "invalid")
        .when(F.col("provider_label").isNull(), "excluded_model").otherwise("kept"))


def disposition_counts(trials, models=APPROVED_MODELS):
    return disposition(trials, models).groupBy("disposition").agg(F.count(F.lit(1)).alias("n_lines"))


def usable_reasoning(records):
    """Drop records with an error note or without a verdict."""
    return records.filter((F.coalesce(F.col("error"), F.lit("")) == "")
                          & (F.coalesce(F.col("predicted_label"), F.lit("")) != ""))


def fill_absent(records):
    """Defaults for absent fields of a trial record."""
    have = records.columns
    method = [F.col(c) for c in ("synthetic_method", "method") if c in have]
    return records.select(
        "trial_id", F.coalesce(F.col("provider"), F.lit("?")).alias("provider"),
        F.coalesce(*method, F.lit("unknown")).alias("method"),
        F.coalesce(F.col("condition"), F.lit("?")).alias("condition"),
        F.coalesce(F.col("correct"), F.lit(False)).alias("correct"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(50.0)).alias("confidence"))


def drop_incomplete(df):
    """Rows without any NULL, after NaN has been turned into NULL."""
    return nan_to_null(df).na.drop("any")


def nan_to_null(df):
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def drop_report(df):
    """Row counts before and after dropping incomplete rows, in one pass."""
    whole = F.lit(True)
    for c, t in df.dtypes:
        whole = whole & F.col(c).isNotNull()
        if t in ("double", "float"):
            whole = whole & F.coalesce(~F.isnan(c), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(whole).alias("rows_after"),
                  F.count_if(~whole).alias("rows_dropped"))


# --- fixed values: census survey column names and their readable names ---------
CENSUS_NAMES = {
    "AGEP": "age", "COW": "class_of_worker", "SCHL": "education", "MAR": "marital_status",
    "OCCP": "occupation", "POBP": "place_of_birth", "RELP": "relationship",
    "WKHP": "hours_per_week", "SEX": "sex", "RAC1P": "race", "PINCP": "income",
}
CENSUS_TARGET = "income_above_50k"
# -------------------------------------------------------------------------------


def rename_where_present(df, names):
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def integral_columns(df):
    """Double columns whose every value is a whole number: one aggregate, one row to the driver."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    if not doubles:
        return []
    row = df.agg(*[F.bool_and(F.col(c) == F.floor(c)).alias(c) for c in doubles]).first()
    return [c for c in doubles if row[c]]


def cast_integral(df):
    whole = set(integral_columns(df))
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in whole else F.col(c) for c in df.columns])


def prepare_census(df, names=CENSUS_NAMES):
    return cast_integral(drop_incomplete(rename_where_present(df, names)))


def impute_with(df, columns, reference):
    """Fill NULLs and NaNs with the means of ``reference``: one row of means, held as literals."""
    means = S.nan_to_null(reference.select(*columns)).agg(*[F.avg(c).alias(c) for c in columns]).first()
    df = S.nan_to_null(df)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def label_counts(df, target):
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


