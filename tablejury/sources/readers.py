"""Readers for micro tables, judged trials and annotations; provenance comes from file metadata."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablejury.functions import scalar as S
from tablejury.schema import ANNOTATION, EXCLUDED_PATH_MARKERS, HUMAN_TRIAL, TRIAL

CORRUPT = "_corrupt_record"


def read_micro_csv(spark, path, schema=None):
    """CSV with a header; give the schema where it is known, inference scans the data twice."""
    reader = spark.read.option("header", True)
    return S.nan_to_null((reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path))


def read_headerless_csv(spark, path, schema, null_value="?"):
    """Headerless CSV with padded commas and a null mark."""
    return S.nan_to_null(spark.read.schema(schema).option("nullValue", null_value).option("ignoreLeadingWhiteSpace", True)
                         .option("ignoreTrailingWhiteSpace", True).csv(path))


def first_readable(spark, paths, reader, fallback=None):
    """The first path that can be read, else what ``fallback()`` builds."""
    for path in paths:
        try:
            return reader(spark, path)
        except AnalysisException:
            continue
    if fallback is None:
        raise FileNotFoundError(f"none of {list(paths)} can be read")
    return fallback()


def _path():
    return F.col("_metadata.file_path")


def read_trials(spark, path, schema=TRIAL, bad_lines="skip", name_pattern=None, recursive=False,
                exclude=EXCLUDED_PATH_MARKERS, line_order=False):
    """Judged trials from JSON lines with ``source_path``.

    ``bad_lines``: ``skip`` drops malformed lines, ``keep`` keeps them in
    ``_corrupt_record``, ``fail`` raises. ``name_pattern`` picks result files of a
    folder by name and ``exclude`` drops files whose path holds a marker.
    ``line_order`` adds ``line_no``, which sorts the lines of a file by their place in it.
    """
    reader = spark.read
    if name_pattern is not None:
        path = f"{path}/llm_results_*{name_pattern}*.jsonl"
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if bad_lines == "fail":
        rows = reader.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        marked = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        rows = reader.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = rows.withColumn("source_path", _path())
    if line_order:  # splits of a file by their offset, lines of a split by their row number
        rows = rows.withColumn("line_no", F.struct(F.col("_metadata.file_block_start").alias("split"),
                                                   F.monotonically_increasing_id().alias("row")))
    for marker in exclude if recursive else ():
        rows = rows.filter(~F.col("source_path").contains(marker))
    if bad_lines == "skip":
        # Spark refuses to parse for the corrupt-record column alone, so a data field is read with it
        parsed = F.coalesce(F.length("predicted_label"), F.lit(0)) >= 0
        rows = rows.filter(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)
    return rows


def file_name(extension="jsonl"):
    """Name of the result file, or of the folder when a file was written in parts."""
    return F.regexp_extract("source_path", r"([^/]+\." + extension + ")", 1)


def with_provenance(rows):
    """Dataset and provider tags and the file name, read off the path."""
    return (rows.withColumn("dataset", S.dataset_from_path("source_path")).withColumn("source_file", file_name())
            .withColumn("provider_tag", F.when(F.col("source_file").contains("google"), "google").otherwise("groq")))


def without_human_files(rows):
    return rows.filter(~file_name().contains("human"))


def read_methods(spark, root, schema, names=None, file_name="synthetic.csv"):
    """All ``{root}/{method}/synthetic.csv`` tables as one table with ``method`` and its display name."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{root}/*/{file_name}")
    found = F.regexp_extract(_path(), r"/([^/]+)/" + file_name.replace(".", r"\."), 1)
    rows = rows.withColumn("method", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))  # paths come encoded
    shown = F.col("method")
    for code, label in (names or {}).items():
        shown = F.when(F.col("method") == code, label).otherwise(shown)
    return rows.withColumn("method_name", shown)


def read_annotations(spark, paths, schema=ANNOTATION):
    """Annotation CSVs, one or many, with the name of the file each row came from."""
    rows = spark.read.schema(schema).option("header", True).csv(paths).withColumn("source_path", _path())
    return rows.withColumn("source_path", file_name("csv"))


def read_human_trials(spark, path):
    """Older human records, renamed to the trial layout."""
    rows = spark.read.schema(HUMAN_TRIAL).json(path)
    return rows.withColumnsRenamed({"participant_id": "annotator_id", "confidence_rating": "confidence",
                                    "reasoning": "notes"})


def read_mixed_annotations(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
