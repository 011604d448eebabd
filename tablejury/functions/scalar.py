"""Row-level expressions used across operators; all stay in the JVM."""

from pyspark.sql import functions as F

from tablejury.schema import ERROR, METHOD_LABELS, VALID_LABELS, VERDICT

# --- fixed values: wording by which a failed judge call is a quota failure ----
QUOTA_MARKS = ("429", "quota", "rate limit", "rate_limit", "resource_exhausted",
               "too many requests", "requests per minute", "requests per day")
# -----------------------------------------------------------------------------


def col(c):
    return F.col(c) if isinstance(c, str) else c


def hit(correct="correct"):
    """1/0/NULL from the boolean outcome."""
    return col(correct).cast("int")


def pct(numerator, denominator):
    """Percentage, NULL when the denominator is zero."""
    return F.lit(100.0) * numerator / F.nullif(denominator, F.lit(0))


def ratio(numerator, denominator):
    return numerator * F.lit(1.0) / F.nullif(denominator, F.lit(0))


def is_valid_label(column="predicted_label"):
    return F.coalesce(col(column).isin(*VALID_LABELS), F.lit(False))


def not_error(column="predicted_label"):
    return F.coalesce(col(column), F.lit(ERROR)) != ERROR


def clean_confidence(column="confidence", rule="positive"):
    """``positive`` keeps > 0, ``nonnegative`` keeps >= 0, ``default50`` fills absence, ``raw`` keeps all."""
    value = col(column).try_cast("double")
    value = F.when(~F.isnan(value), value)
    if rule == "positive":
        return F.when(value > 0, value)
    if rule == "nonnegative":
        return F.when(value >= 0, value)
    if rule == "default50":
        return F.coalesce(value, F.lit(50.0))
    return value


def normalise_method(column="synthetic_method"):
    name = F.lower(col(column))
    return (F.when(name.contains("ctgan"), "CTGAN").when(name.contains("tvae"), "TVAE")
            .when(name.contains("gaussian") | name.contains("copula"), "GaussianCopula"))


def method_label(column):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in METHOD_LABELS.items():
        out = out.when(col(column) == name, label)
    return F.coalesce(out, col(column))


def dataset_from_path(path):
    return F.when(col(path).contains("/census/"), "census").otherwise("adult")


def accuracy_band(accuracy):
    """Colour band of an accuracy share: all right, at least half, below half."""
    return F.when(accuracy == 1.0, "green").when(accuracy >= 0.5, "orange").otherwise("red")


def privacy_band(accuracy_pct):
    return F.when(accuracy_pct < 30, "green").when(accuracy_pct < 40, "orange").otherwise("red")


def significance(p):
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def progress_status(valid, errors, target=20):
    return (F.when((valid >= target) & (errors == 0), "DONE").when(valid > 0, "PARTIAL")
            .when(errors > 0, "QUOTA HIT").otherwise("PENDING"))


def is_quota_error(message):
    text = F.lower(F.coalesce(col(message), F.lit("")))
    found = F.lit(False)
    for mark in QUOTA_MARKS:
        found = found | text.contains(mark)
    return found


def error_class(message):
    return F.when(col(message).isNull() | (col(message) == ""), F.lit(None).cast("string")) \
        .when(is_quota_error(message), "quota").otherwise("transient")


def safe_model_name(column):
    return F.regexp_replace(col(column), r"[^a-zA-Z0-9._-]+", "-")


def strip_fences(column):
    """Drop a leading and a trailing markdown fence around a JSON answer."""
    bare = F.regexp_replace(F.trim(col(column)), r"^```(json)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"```\s*$", ""), r"^\s+|\s+$", "")


def parse_verdict(raw):
    """Struct (verdict, confidence, ...) or NULL for text that is not a whole JSON record."""
    return F.from_json(strip_fences(raw), VERDICT, {"mode": "PERMISSIVE"})


def clip(column, low, high):
    return F.greatest(F.lit(low), F.least(F.lit(high), col(column)))


def whole_percent(share):
    """Share rounded to 3 places, then cut to a whole percentage."""
    return F.concat((F.bround(share, 3) * 100).cast("int").cast("string"), F.lit("%"))


def stamp(ts):
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def nan_to_null(df):
    """NaN counts as missing, as in the sources these tables come from."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
