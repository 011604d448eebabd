"""Record layouts and the fixed vocabulary shared by every operator."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
REAL, SYNTHETIC, ERROR = "REAL", "SYNTHETIC", "ERROR"
VALID_LABELS = (REAL, SYNTHETIC)
CONDITIONS = ("C1", "C2")
METHODS = ("ctgan", "tvae", "gaussian_copula")
DATASETS = ("adult", "census")
METHOD_LABELS = {"ctgan": "CTGAN", "tvae": "TVAE", "gaussian_copula": "Gaussian Copula"}
FORMAL_METHOD_NAMES = {"ctgan": "CTGAN", "tvae": "TVAE", "gaussian_copula": "GaussianCopula"}
EXPECTED_SYNTHETIC = ("ctgan", "tvae", "cart", "great", "tabddpm")
APPROVED_MODELS = (
    ("groq", "llama-3.1-8b-instant", "Groq (LLaMA-3.1-8b)"),
    ("google", "gemini-2.5-flash", "Google (Gemini-2.5-Flash)"),
)
EXCLUDED_PATH_MARKERS = ("archive_invalid", "/res1/")
FAIR_MIN_N = 8
ROWS_SHOWN = 20
# ---------------------------------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRIAL = _struct(
    trial_id=T.LongType(), timestamp=T.StringType(), provider=T.StringType(), model=T.StringType(),
    synthetic_method=T.StringType(), method=T.StringType(), condition=T.StringType(),
    true_label=T.StringType(), predicted_label=T.StringType(), correct=T.BooleanType(),
    confidence=T.DoubleType(), reasoning=T.StringType(), red_flags=_STRINGS,
    supporting_evidence=_STRINGS, error=T.StringType(),
)

ANNOTATION = _struct(
    annotator_id=T.StringType(), session_id=T.StringType(), dataset=T.StringType(),
    method=T.StringType(), pair_id=T.LongType(), condition=T.StringType(),
    n_rows_shown=T.IntegerType(), true_label=T.StringType(), predicted_label=T.StringType(),
    correct=T.BooleanType(), confidence=T.LongType(), notes=T.StringType(),
    timestamp=T.TimestampType(),
)

HUMAN_TRIAL = _struct(
    trial_id=T.LongType(), timestamp=T.StringType(), participant_id=T.StringType(),
    session_id=T.StringType(), condition=T.StringType(), true_label=T.StringType(),
    predicted_label=T.StringType(), correct=T.BooleanType(), confidence_rating=T.DoubleType(),
    reasoning=T.StringType(),
)

VERDICT = _struct(
    verdict=T.StringType(), confidence=T.DoubleType(), reasoning=T.StringType(),
    red_flags=_STRINGS, supporting_evidence=_STRINGS,
)

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
CATEGORICAL_TYPES = ("string", "boolean")


def is_numeric(dtype):
    return dtype in NUMERIC_TYPES or dtype.startswith("decimal")


def numeric_columns(df, exclude=()):
    return [c for c, t in df.dtypes if is_numeric(t) and c not in exclude]


def categorical_columns(df, exclude=()):
    return [c for c, t in df.dtypes if t in CATEGORICAL_TYPES and c not in exclude]
