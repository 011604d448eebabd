"""Profile text, row tables and prompts for judges, and the judging step itself."""

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.operators import profile as P
from tablejury.operators.sampling import RowIndex
from tablejury.schema import ROWS_SHOWN
from tablejury.session import shared_table, spread

SYSTEM_TEXT = (
    "You assess tables. Decide if the rows below were collected from real records (REAL) or produced by a "
    "generative model (SYNTHETIC). Look at value combinations, regularities and distributions, then answer with "
    "one JSON object holding the keys verdict (REAL or SYNTHETIC), confidence (whole number 0 to 100), reasoning "
    "(text), red_flags (list of text) and supporting_evidence (list of text).")


def markdown_row(columns):
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan"))
                                                      for c in columns]), F.lit(" |"))


def markdown_head(columns):
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)


def _joined(lines):
    """Lines of one text in order; the caller bounds their number."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n")


def row_table(sample, by, columns, row_id):
    """Markdown text of each group's sampled rows, in row order."""
    body = _joined(F.struct(F.col(row_id).alias("pos"), markdown_row(columns).alias("line")))
    return sample.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_shown"),
        F.concat(F.lit(markdown_head(columns) + "\n"), body).alias("table_text"))


def _num(c, places=4):
    return F.coalesce(F.format_string(f"%.{places}f", F.col(c)), F.lit("n/a"))


def profile_text(df, by, columns, row_id=None):
    """One text block per table: shape, missing values, column profiles, strongest correlations.

    Every line comes from an aggregate with a handful of rows per column.
    """
    data = df.select(*by, *columns)
    base = P.table_profile(data, by)
    tops = P.top_values(data, by).filter(F.col("rank") <= 5).groupBy(*by, "column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "rank", F.format_string("%s=%.1f%%", F.col("value"), F.col("share") * 100).alias("line")))),
            lambda x: x["line"]), "  ").alias("tops"))
    table = base.join(tops, [*by, "column"], "left")
    if row_id:
        table = table.join(P.shapiro(df.select(*by, row_id, *columns), [row_id], by,
                                     [c for c, t in data.dtypes if c in columns and t in ("double", "bigint", "int")])
                           .select(*by, "column", "shapiro_p", "verdict"), [*by, "column"], "left")
    else:
        table = table.withColumn("shapiro_p", F.lit(None).cast("double")).withColumn("verdict", F.lit(None).cast("string"))
    place = F.col("position") * 10

    def at(section, offset, line):
        return F.struct(F.lit(section).alias("s"), (place + offset).cast("double").alias("p"), line.alias("line"))

    numeric = F.col("kind") == "numeric"
    lines = F.array_compact(F.array(
        F.when(F.col("n_missing") > 0, at(1, 0, F.format_string("  %s: %.2f%% missing", "column", "missing_pct"))),
        at(2, 0, F.format_string("[%s] type=%s unique=%d missing=%.2f%%", "column", "dtype", "n_unique", "missing_pct")),
        F.when(numeric, at(2, 1, F.concat(*[piece for c in ("mean", "std", "min", "p25", "median", "p75", "max")
                                           for piece in (F.lit(f"  {c}="), _num(c))]))),
        F.when(numeric, at(2, 2, F.concat(F.lit("  skewness="), _num("skewness"), F.lit("  kurtosis="), _num("kurtosis")))),
        F.when(F.col("shapiro_p").isNotNull(), at(2, 3, F.format_string("  shapiro p=%.4f (%s)", "shapiro_p", "verdict"))),
        F.when(F.col("tops").isNotNull(), at(2, 4, F.concat(F.lit("  top values: "), F.col("tops")))),
        F.when(F.col("entropy").isNotNull(), at(2, 5, F.concat(F.lit("  entropy="), _num("entropy"))))))
    body = table.select(*by, F.explode(lines).alias("_l"))
    shape = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.struct(
        F.lit(0).alias("s"), F.lit(0.0).alias("p"),
        F.format_string(f"Shape: %d rows x {len(columns)} columns", "_n").alias("line")).alias("_l"))
    numbers = [c for c, t in data.dtypes if c in columns and t in ("double", "float", "bigint", "int")]
    parts = shape.unionByName(body)
    if len(numbers) > 1:
        strong = P.top_correlations(data, by, numbers).filter(F.col("r").isNotNull())
        parts = parts.unionByName(strong.select(*by, F.struct(
            F.lit(3).alias("s"), (-F.abs("r")).alias("p"),
            F.format_string("  %s × %s: r=%.4f", "c1", "c2", "r").alias("line")).alias("_l")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n").alias("profile_text"))


def row_index(tables, seed, row_id, columns, by="source"):
    """Index over the markdown lines of every table, from which prompts take their rows."""
    lines = tables.select(by, F.col(row_id).alias("_row"), markdown_row(columns).alias("_line"))
    return RowIndex(lines, by, "_row", ["_line"], seed)


def build_prompts(requests, index, key, columns, condition, profiles=None, n_rows=ROWS_SHOWN, seed=42):
    """One prompt per request; ``condition`` is a column saying C1 (rows) or C2 (rows and profile).

    Every request draws its own rows without replacement, by its key; they are shown in table order.
    """
    return numbered_prompts(index.numbered(requests), index, key, columns, condition, profiles, n_rows, seed)


def numbered_prompts(numbered, index, key, columns, condition, profiles=None, n_rows=ROWS_SHOWN, seed=42):
    """The prompts of requests that the index has numbered, or of some of them."""
    asked = [c for c in numbered.columns if c not in ("n_total", "_times", "_request")]
    shown = index.shown(numbered, key, n_rows, seed).withColumn("_lines", F.sort_array("_rows"))
    repeated = F.flatten(F.transform("_lines", lambda x: F.array_repeat(x["_line"], F.col("_times").cast("int"))))  # a request asked twice shows its rows twice
    text = shown.select(
        *asked, "n_total", (F.size("_lines") * F.col("_times")).cast("int").alias("n_shown"),
        F.concat(F.lit(markdown_head(columns) + "\n"), F.array_join(repeated, "\n")).alias("table_text"))
    if profiles is not None:
        text = text.join(shared_table(profiles, "profiles"), index.by, "left")  # one text per table, sized by its file
    else:
        text = text.withColumn("profile_text", F.lit(None).cast("string"))
    names = ", ".join(columns)
    prompt = F.concat(
        F.format_string("Is this table REAL or SYNTHETIC?\n\nRows shown: %d of %d\n", "n_shown", "n_total"),
        F.col("table_text"),
        F.when(condition == "C2", F.concat(F.lit("\n\nStatistics of the whole table:\n"),
                                           F.coalesce("profile_text", F.lit("")))).otherwise(F.lit("")),
        F.format_string(f"\n\nTotal rows: %d\nTotal columns: {len(columns)}\nColumns: {names}\n", "n_total"))
    return text.select(*asked, "n_shown", "n_total", prompt.alias("prompt"))


# ---- judging -----------------------------------------------------------------------

def rule_judge(system, prompt):
    """Offline judge: long decimal tails and repeated rows count as signs of a generated table."""
    rows = [line for line in prompt.splitlines() if line.startswith("| ")][1:]
    tails = sum(bool(re.search(r"\d\.\d{4,}", row)) for row in rows)
    repeats = len(rows) - len(set(rows))
    flags = ([f"{tails} rows with long decimal tails"] if tails else []) + \
            ([f"{repeats} repeated rows"] if repeats else [])
    confidence = min(95, 55 + 5 * (tails + repeats)) if flags else 60
    return json.dumps({"verdict": "SYNTHETIC" if flags else "REAL", "confidence": confidence,
                       "reasoning": "; ".join(flags) or "no sign of generation", "red_flags": flags,
                       "supporting_evidence": [] if flags else ["short decimals"]})


def judge_prompts(prompts, key=None, judge=rule_judge, retries=1, system=SYSTEM_TEXT):
    """Ask the judge for every prompt; failures become a NULL answer with the error text.

    ``judge(system, prompt)`` returns answer text. Batches arrive by Arrow and
    Spark spreads them by ``key``, so the number of partitions sets the concurrency.
    Without a key they stay where they are, as `build_prompts` has spread its requests already.
    """
    def ask(prompt):
        error = ""
        for _ in range(retries + 1):
            try:
                return judge(system, prompt), None
            except Exception as exc:  # noqa: BLE001 - any failure of a judge is recorded, not raised
                error = str(exc) or type(exc).__name__
        return None, error

    def run(batches):
        for batch in batches:
            answers = [ask(p) for p in batch["prompt"]]
            yield batch.assign(raw=pd.Series([a for a, _ in answers], index=batch.index, dtype="object"),
                               error=pd.Series([e for _, e in answers], index=batch.index, dtype="object"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return (spread(prompts, *key) if key else prompts).mapInPandas(run, schema + ", raw string, error string")


def trial_rows(answers, provider, model):
    """Trial records from judged prompts (provider and model are names or columns): parsed verdicts, or ERROR with confidence -1 and the error as reason."""
    parsed = answers.withColumn("_v", S.parse_verdict("raw"))
    empty = F.array().cast("array<string>")
    predicted = F.upper(F.coalesce("_v.verdict", F.lit("ERROR")))
    return parsed.select(
        "trial_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("method").alias("synthetic_method"),
        "condition", "true_label", predicted.alias("predicted_label"),
        (predicted == F.col("true_label")).alias("correct"),
        F.coalesce("_v.confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("_v.reasoning", F.col("error"), F.lit("")).alias("reasoning"),
        F.coalesce("_v.red_flags", empty).alias("red_flags"),
        F.coalesce("_v.supporting_evidence", empty).alias("supporting_evidence"),
        S.error_class("error").alias("error_class"))


