"""Red flags, themes and reports mined from judges' reasons; all in built-in functions."""

from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.functions.digests import digest
from tablejury.functions.ranking import top_k

# --- fixed values: themes and the keywords that mark them (case-insensitive) ----
THEMES = {
    "Education–education_num mapping": [
        "education_num", "education-num", "education num", "functional dependency", "bijective",
        "1:1 mapping", "mapping between", "10th", "bachelors", "hs-grad"],
    "Marital/relationship contradiction": [
        "marital", "relationship", "never-married", "husband", "wife", "unmarried"],
    "Capital gain/loss anomaly": [
        "capital_gain", "capital_loss", "capital gain", "capital loss", "small non-zero", "small integer"],
    "Distribution irregularities": [
        "distribution", "skewness", "skew", "kurtosis", "non-normal", "uniform", "shapiro"],
    "Dataset fingerprinting (UCI Adult)": [
        "30,162", "30162", "99,999", "99999", "UCI", "Adult dataset", "census income", "known dataset",
        "original dataset"],
    "Zero / sparse values": [
        "large number of zeros", "zero values", "many zeros", "sparse", "zero in capital"],
    "Age distribution": [
        "age distribution", "age range", "unrealistic age", "young age", "old age"],
    "Syntactic / structural artifact": [
        "implausible", "inconsistent", "suspicious", "anomal", "artifact", "artefact", "regularit"],
}
# ---------------------------------------------------------------------------------


def explode_flags(records):
    """One row per cited red flag with its trial's context."""
    return records.select("trial_id", "provider", "method", "condition", "true_label", "correct",
                          F.explode("red_flags").alias("flag"))


def flag_totals(records):
    n = F.sum(F.coalesce(F.size("red_flags"), F.lit(0))).cast("bigint")
    return records.agg(n.alias("n_flags"), F.count(F.lit(1)).alias("n_trials"),
                       (n / F.count(F.lit(1))).alias("flags_per_trial"))


def sample_flags(flags, k, seed):
    """k flags from right and k from wrong verdicts."""
    return top_k(flags.withColumn("_d", digest(seed, "trial_id", "flag")), ["correct"], k, "_d", "trial_id", "flag") \
        .drop("_d")


def top_flags(flags, k=20, width=90):
    """Most cited flags, lower-cased and cut for display; ties in text order."""
    text = F.substring(F.lower("flag"), 1, width)
    return flags.groupBy(text.alias("phrase")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "phrase").limit(k)


def record_text(records):
    return F.lower(F.concat_ws(" ", F.array_join(F.coalesce("red_flags", F.array().cast("array<string>")), " "),
                               F.coalesce("reasoning", F.lit(""))))


def tag_themes(records, themes, text=None):
    """One row per (record, theme) where any keyword of the theme occurs in the whole text."""
    lowered = records.withColumn("_text", record_text(records) if text is None else F.lower(text))
    marks = []
    for theme, words in themes.items():
        found = F.lit(False)
        for word in words:
            found = found | F.col("_text").contains(word.lower())
        marks.append(F.when(found, F.lit(theme)))
    return lowered.withColumn("theme", F.explode(F.array_compact(F.array(*marks)))).drop("_text")


def theme_counts(records, themes, text=None, by="provider"):
    """Hits and percentages per theme, overall and per provider, in one aggregation each.

    A record carries at most one row per theme, so counting rows counts records.
    """
    tagged = tag_themes(records, themes, text)
    scopes = F.explode(F.array(F.lit("all"), F.col(by)))
    hits = tagged.select(scopes.alias("scope"), "theme").groupBy("scope", "theme").agg(F.count(F.lit(1)).alias("hits"))
    sizes = records.select(scopes.alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(t) for t in themes]))
    return sizes.withColumn("theme", names).join(hits, ["scope", "theme"], "left").na.fill(0, ["hits"]) \
        .withColumn("pct", F.lit(100.0) * F.col("hits") / F.col("n"))


def theme_ranking(records, themes, text=None, by="provider"):
    return theme_counts(records, themes, text, by).filter("scope = 'all'").drop("scope").orderBy(F.desc("hits"), "theme")


def theme_by_condition(records, themes, theme, provider, text=None):
    """One theme by condition for one provider."""
    mine = records.filter(F.col("provider") == provider)
    tagged = tag_themes(mine, {theme: themes[theme]}, text).groupBy("condition").agg(F.count(F.lit(1)).alias("hits"))
    sizes = mine.filter(F.col("condition").isin("C1", "C2")).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(tagged, "condition", "left").na.fill(0, ["hits"]) \
        .withColumn("pct", F.lit(100.0) * F.col("hits") / F.col("n"))


def theme_examples(records, themes, text=None, preferred="google"):
    """Per theme the best example: preferred provider first, then right verdicts, then trial order."""
    order = F.struct((F.col("provider") != preferred).alias("a"), (~F.col("correct")).alias("b"), "trial_id")
    payload = F.struct(
        "trial_id", "provider", "method", "condition", "correct",
        F.substring(F.array_join(F.slice("red_flags", 1, 3), "; "), 1, 120).alias("flags"),
        F.replace(F.substring(F.coalesce("reasoning", F.lit("")), 1, 400), F.lit("\n"), F.lit(" ")).alias("snippet"))
    return tag_themes(records, themes, text).groupBy("theme").agg(F.min_by(payload, order).alias("_e")) \
        .select("theme", "_e.*")


def condition_report(impact):
    """Report lines from the condition-impact table."""
    def line(pattern, *cols):
        return F.format_string(pattern, *cols)

    overall = F.col("scope") == "all"
    lines = F.when(overall, F.array(
        line("C1 privacy score: %.2f%%", "c1_privacy"), line("C2 privacy score: %.2f%%", "c2_privacy"),
        line("Absolute degradation: %.2f percentage points", "absolute"),
        line("Relative degradation: %.2f%% of C1 privacy", "relative"))).otherwise(F.array(
            line("%s: C1 %.2f%%, C2 %.2f%%, degradation %.2fpp (%.1f%%)", "scope", "c1_privacy", "c2_privacy",
                 "absolute", "relative")))
    return impact.select((~overall).cast("int").alias("section"), "scope", F.posexplode(lines).alias("position", "line"))


def parse_verdicts(raw, trials):
    """Judge text joined to its trial: parsed fields, ERROR for broken text, and correctness."""
    parsed = raw.withColumn("_v", S.parse_verdict("raw"))
    verdict = F.upper(F.coalesce(F.col("_v.verdict"), F.lit("ERROR")))
    empty = F.array().cast("array<string>")
    keep = ["trial_id", "dataset", "provider", "method", "condition", "true_label"]
    return parsed.join(trials.select(*keep), "trial_id").select(
        *keep, verdict.alias("verdict"), (verdict == F.col("true_label")).alias("correct"),
        F.coalesce("_v.confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("_v.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("_v.red_flags", empty).alias("red_flags"),
        F.coalesce("_v.supporting_evidence", empty).alias("supporting_evidence"))
