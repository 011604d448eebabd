import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.operators import (agreement as A, backfill as B, clean as C, inference as I, metrics as M,
                                 profile as P, prompts as R, reasoning as N, sampling as Q, synth as G)
from tablejury.schema import ANNOTATION, TRIAL
from tablejury.sources import audit as U, readers as IN, sinks as OUT
from tablejury.streaming import progress as L


def trials(spark, rows):
    return spark.createDataFrame(rows, "provider string, model string, method string, condition string, "
                                       "true_label string, predicted_label string, correct boolean, confidence double")


OK = ("groq", "llama-3.1-8b-instant", "ctgan")


@pytest.fixture(scope="module")
def one_class(spark):
    return trials(spark, [(*OK, "C1", "REAL", "REAL", True, 80.0), (*OK, "C1", "REAL", "SYNTHETIC", False, 60.0)])


def test_absent_class_gives_null_or_zero(one_class):
    assert M.cell_metrics(one_class, ["method"]).first()["drs"] is None
    zero = M.cell_metrics(one_class, ["method"], "zero").first()
    assert zero["drs"] == 0.0 and zero["p_syn_correct"] == 0.0 and zero["p_real_correct"] == 50.0


def test_drs_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [(*OK, c, t, p, t == p, 50.0) for c, t, p in zip(rng.choice(["C1", "C2"], 400), rng.choice(["REAL", "SYNTHETIC"], 400),
                                                           rng.choice(["REAL", "SYNTHETIC"], 400))]
    for r in M.cell_metrics(trials(spark, [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows]), ["condition"]).collect():
        assert r["drs"] <= r["accuracy"] <= max(r["p_real_correct"], r["p_syn_correct"])


def test_zero_discrimination_hides_the_mean_only_when_asked(spark):
    from tablejury.plans.formal import judge_scores
    t = trials(spark, [(*OK, "C1", "REAL", "SYNTHETIC", False, 1.0), (*OK, "C1", "SYNTHETIC", "REAL", False, 1.0),
                       (*OK, "C2", "REAL", "REAL", True, 1.0), (*OK, "C2", "SYNTHETIC", "SYNTHETIC", True, 1.0)]) \
        .withColumnRenamed("method", "synthetic_method")
    assert judge_scores(t).first()["llm_avg"] is None
    assert judge_scores(t, zero_is_null=False).first()["llm_avg"] == 0.5


def test_cleaning_modes(spark):
    t = trials(spark, [(*OK, "C1", "REAL", "REAL", True, 0.0), (*OK, "C1", "REAL", "ERROR", False, -1.0),
                       ("x", "y", "tvae", "C1", "REAL", "REAL", True, 70.0), (*OK, "C1", "REAL", None, False, None)])
    assert C.clean_trials(t, "raw").count() == 4
    assert C.clean_trials(t, "no_error").count() == 2
    kept = C.clean_trials(t)
    assert kept.count() == 1 and kept.first()["confidence"] is None
    assert C.clean_trials(t, confidence="nonnegative").first()["confidence"] == 0.0
    counts = {r["disposition"]: r["n_lines"] for r in C.disposition_counts(t).collect()}
    assert counts == {"kept": 1, "invalid": 2, "excluded_model": 1}


def test_relative_impact_guard(spark):
    rows = [(*OK, "C1", "REAL", "REAL", True, 1.0), (*OK, "C2", "REAL", "SYNTHETIC", False, 1.0)]
    got = {r["scope"]: r for r in M.condition_impact(trials(spark, rows)).collect()}
    assert got["ctgan"]["relative"] == 0.0 and got["all"]["relative"] is None and got["ctgan"]["absolute"] == -100.0


def test_census_preparation(spark):
    df = spark.createDataFrame([(30.0, 1.0, 1.5), (float("nan"), 2.0, 2.5), (40.0, 3.0, 3.5)], "AGEP double, COW double, PINCP double")
    out = C.prepare_census(df)
    assert out.dtypes == [("age", "bigint"), ("class_of_worker", "bigint"), ("income", "double")] and out.count() == 2


@pytest.mark.parametrize("raw,verdict", [
    ('{"verdict": "real"}', "real"), ('```json\n{"verdict": "SYNTHETIC"}\n```', "SYNTHETIC"),
    ('```\n{"verdict": "x"}\n```  ', "x"), ('{"verdict": "re', None), ("", None)])
def test_verdict_parsing(spark, raw, verdict):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(S.parse_verdict("raw")["verdict"]).first()[0] == verdict


# ---- golden annotation counts: dataset, method, condition, annotator, n_real, right, n_syn, right, mean confidence
GOLDEN = """adult ctgan C1 HA1 4 2 6 4 63.5|adult ctgan C1 HA2 5 4 5 3 53.9|adult ctgan C2 HA1 4 2 6 2 63.4
adult ctgan C2 HA2 5 5 5 5 68.3|adult gaussian_copula C1 HA1 5 4 5 5 74.3|adult gaussian_copula C1 HA2 3 2 7 7 53.5
adult gaussian_copula C2 HA1 5 4 5 5 72.3|adult gaussian_copula C2 HA2 3 3 7 7 64.9|adult tvae C1 HA1 4 2 6 5 61.2
adult tvae C1 HA2 8 7 2 1 57.7|adult tvae C2 HA1 4 1 6 6 65.1|adult tvae C2 HA2 8 7 2 1 61.0
census ctgan C1 HA1 5 2 5 3 50.0|census ctgan C1 HA2 6 4 4 3 50.0|census ctgan C2 HA1 5 2 5 2 50.0
census ctgan C2 HA2 6 6 4 4 64.3|census gaussian_copula C1 HA1 6 3 4 4 50.0|census gaussian_copula C1 HA2 6 3 4 3 50.0
census gaussian_copula C2 HA1 6 6 4 4 58.1|census gaussian_copula C2 HA2 6 6 4 4 63.1|census tvae C1 HA1 6 2 4 2 50.0
census tvae C1 HA2 6 2 4 3 50.0|census tvae C2 HA1 6 2 4 1 50.0|census tvae C2 HA2 6 4 4 2 50.0"""


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for line in GOLDEN.replace("\n", "|").split("|"):
        d, m, c, a, nr, kr, ns, ks, conf = line.split()
        for label, n, k in (("REAL", int(nr), int(kr)), ("SYNTHETIC", int(ns), int(ks))):
            other = "SYNTHETIC" if label == "REAL" else "REAL"
            rows += [(a, f"{a}{d}{m}", d, m, c, label, label if i < k else other, i < k, float(conf)) for i in range(n)]
    return spark.createDataFrame(rows, "annotator string, session_id string, dataset string, method string, condition string, "
                                       "true_label string, predicted_label string, correct boolean, confidence double")


def test_golden_totals(golden):
    got = {r["annotator"]: r for r in A.pooled_scores(golden).collect()}
    assert [got["HA1"][c] for c in ("n", "acc", "p_real", "p_syn", "drs")] == [120, 62.5, 53.3, 71.7, 53.3]
    assert [got["HA2"][c] for c in ("n", "acc", "p_real", "p_syn", "drs")] == [120, 80.0, 77.9, 82.7, 77.9]
    assert got["Pooled"]["n"] == 240


def test_golden_gap(golden):
    gap = A.mean_annotator_gap(A.pooled_with_annotators(golden)).first()
    assert round(gap["mean_drs_diff"], 1) == 20.6 and gap["n_cells"] == 12


def test_duplicates_keep_the_first_file(spark):
    rows = [("s", "adult", "tvae", 1, "C1", "ann", f, v) for f, v in (("b.csv", "REAL"), ("a.csv", "SYNTHETIC"), ("c.csv", "REAL"))]
    df = spark.createDataFrame(rows, "session_id string, dataset string, method string, pair_id int, condition string, "
                                     "annotator_id string, source_path string, predicted_label string")
    assert A.dedupe_annotations(df).collect()[0]["predicted_label"] == "SYNTHETIC"


def test_spearman_against_pandas_with_ties(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": "a", "x": rng.integers(0, 6, 60).astype(float)})
    frame["y"] = frame["x"] + rng.integers(0, 5, 60)
    got = A.spearman(spark.createDataFrame(frame), "x", "y", ["g"]).first()
    assert got["rho"] == pytest.approx(frame["x"].rank().corr(frame["y"].rank()), abs=1e-12)
    assert 0 <= got["p_value"] < 1e-6
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert A.spearman(flat, "x", "y", ["g"]).first()["rho"] is None


def test_permutation_engines_agree(spark):
    rng = np.random.default_rng(11)
    n = 400
    frame = pd.DataFrame({"trial_id": np.arange(n), "dataset": "adult", "provider_label": "p", "method": "m",
                          "condition": np.where(np.arange(n) % 2 == 0, "C1", "C2"),
                          "true_label": np.where(np.arange(n) % 4 < 2, "REAL", "SYNTHETIC")})
    frame["correct"] = rng.random(n) < np.where(frame["condition"] == "C1", 0.45, 0.65)
    t = spark.createDataFrame(frame).cache()
    a = I.permutation_test(t, n_perm=400).first()
    b = I.permutation_test(t, n_perm=400, engine="digest").first()
    assert a["delta"] == b["delta"] and 0 < a["p_two_sided"] <= 1
    assert a["p_two_sided"] == pytest.approx(b["p_two_sided"], abs=0.05)
    assert a["perm_null_q025"] == pytest.approx(b["perm_null_q025"], abs=3.0)


def test_draws_from_huge_groups_follow_the_same_law():
    rng = np.random.default_rng(4)
    small = I._inverse(60, 40, 30, rng.random(6000))
    want = rng.hypergeometric(60, 40, 30, 6000)
    assert small.min() >= 0 and small.max() <= 30
    assert abs(small.mean() - 18) < 0.15 and abs(small.std() - want.std()) < 0.1
    counts = [4 * 10 ** 11, 10 ** 11, 3 * 10 ** 11, 2 * 10 ** 11]
    n = 5 * 10 ** 11
    frame = I._shuffled_c1.func(*[pd.Series([c] * 40) for c in [*counts, n]], *[pd.Series(rng.random(40)) for _ in range(3)])
    got = frame.to_numpy(float)
    assert (got.sum(axis=1) == n).all()
    sd = np.sqrt(n * 0.4 * 0.6 * 0.5)
    assert abs(got[:, 0].mean() - 2 * 10 ** 11) < 5 * sd / np.sqrt(40) and 0.6 * sd < got[:, 0].std() < 1.5 * sd


def test_seed_sweep_interval_is_ordered(spark):
    frame = pd.DataFrame([(i, "adult", p, "m", "C1", "REAL" if i % 2 else "SYNTHETIC", i % 3 == 0)
                          for p, n in (("a", 90), ("b", 40)) for i in range(n)],
                         columns=["trial_id", "dataset", "provider_label", "method", "condition", "true_label", "correct"])
    out = I.seed_sweep(spark.createDataFrame(frame)).toPandas().set_index("provider_label")
    assert (out["q025"] <= out["drs_mean"]).all() and (out["drs_mean"] <= out["q975"]).all()
    assert out.loc["b", "q025"] == out.loc["b", "q975"] and out.loc["a", "q025"] < out.loc["a", "q975"]


def test_queue_is_balanced_and_resumes(spark):
    targets = spark.createDataFrame([("m1", 10), ("m2", 7), ("m3", 1)], "method string, n_trials bigint")
    queue = Q.trial_queue(targets, 1)
    counts = {(r["method"], r["condition"], r["true_label"]): r["count"]
              for r in queue.groupBy("method", "condition", "true_label").count().collect()}
    assert set(counts.values()) == {5, 3} and not any(k[0] == "m3" for k in counts)
    ids = sorted(r["trial_id"] for r in queue.filter("method = 'm1'").collect())
    assert ids == list(range(20))
    done = queue.filter("trial_id < 4").select("method", "condition", "true_label", "rep")
    assert B.remaining_queue(queue, done).count() == queue.count() - 8


def test_numbering_across_chunks(spark):
    n = 2 * Q.CHUNK + 5
    df = Q.number_off(spark.createDataFrame([("a", n)], "k string, n bigint"), F.col("n"), "i")
    row = df.agg(F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    assert (row["n"], row["d"], row["lo"], row["hi"]) == (n, n, 1, n)


def test_backfill_batches_are_even_and_big_enough(spark):
    grid = spark.createDataFrame([("p", "m", x, "C1") for x in ("a", "b", "c")], "provider string, model string, method string, condition string")
    t = trials(spark, [("p", "m", "a", "C1", "REAL", "REAL", True, 1.0)] * 20 + [("p", "m", "b", "C1", "REAL", "ERROR", False, 1.0)] * 3)
    plan = {r["method"]: r for r in B.backfill_plan(grid, t, 15, 10, 3).collect()}
    assert plan["a"]["action"] == "OK" and plan["b"]["batch_trials"] == 16 and plan["c"]["gap"] == 15


def test_failing_judge_gives_error_rows(spark):
    calls = spark.createDataFrame([(1, "m", "C1", "REAL", "ok"), (2, "m", "C1", "REAL", "boom"), (3, "m", "C1", "REAL", "junk")],
                                  "trial_id int, method string, condition string, true_label string, prompt string")

    def judge(system, prompt):
        if prompt == "boom":
            raise RuntimeError("HTTP 429: quota")
        return "not json" if prompt == "junk" else '```json\n{"verdict": "real", "confidence": 91, "red_flags": []}\n```'

    got = {r["trial_id"]: r for r in R.trial_rows(R.judge_prompts(calls, ["trial_id"], judge), "p", "m").collect()}
    assert got[1]["predicted_label"] == "REAL" and got[1]["correct"] and got[1]["confidence"] == 91
    assert got[2]["predicted_label"] == "ERROR" and got[2]["error_class"] == "quota" and got[2]["confidence"] == -1
    assert got[3]["predicted_label"] == "ERROR" and got[3]["error_class"] is None


def test_prompt_of_a_tiny_table_shows_every_row_once(spark):
    table = spark.createDataFrame([("t", i, float(i)) for i in range(7)], "source string, row_id int, x double")
    requests = spark.createDataFrame([(i, "t") for i in range(30)], "trial_id int, source string")
    index = R.row_index(table, 1, "row_id", ["x"])
    for r in R.build_prompts(requests, index, ["trial_id"], ["x"], F.lit("C1")).collect():
        lines = [line for line in r["prompt"].splitlines() if line.startswith("| ")][1:]
        assert lines == [f"| {float(i)} |" for i in range(7)] and r["n_shown"] == 7


def test_only_c2_prompts_carry_the_profile(spark):
    table = spark.createDataFrame([("t", i, float(i)) for i in range(40)], "source string, row_id int, x double")
    requests = spark.createDataFrame([(1, "t", "C1"), (2, "t", "C2")], "trial_id int, source string, condition string")
    profiles = R.profile_text(table, ["source"], ["x"])
    built = R.build_prompts(requests, R.row_index(table, 1, "row_id", ["x"]), ["trial_id"], ["x"], F.col("condition"), profiles)
    got = {r["trial_id"]: r["prompt"] for r in built.collect()}
    assert "mean=19.5000" in got[2] and "mean=" not in got[1] and "Rows shown: 20 of 40" in got[1]


@pytest.mark.parametrize("schema", ["x double", "c string"])
def test_profiles_of_tables_with_one_kind_of_column(spark, schema):
    df = spark.createDataFrame([(v,) for v in ((1.0, 2.0, 3.0) if "double" in schema else ("a", "b", "b"))], schema)
    row = P.table_profile(df).first()
    assert row["n_unique"] == (3 if "double" in schema else 2) and row["median"] == (2.0 if "double" in schema else None)
    assert P.correlations(df).count() == 0
    assert P.numeric_profile(df).count() + P.entropies(df).count() == 1
    assert (P.top_values(df).count() > 0) == ("string" in schema)


def test_profile_text_mentions_missing_and_correlation(spark):
    df = spark.createDataFrame([("t", i, float(i), float(2 * i) if i % 5 else None, "ab"[i % 2]) for i in range(50)],
                               "source string, row_id int, x double, y double, c string")
    text = R.profile_text(df, ["source"], ["x", "y", "c"], "row_id").first()["profile_text"]
    assert "y: 20.00% missing" in text and "x × y: r=1.0000" in text and "top values: a=50.0%" in text and "shapiro" in text


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([("a", 5.0)] * 3, "k string, value double")
    out = P.histogram(df, ["k"], 4).toPandas().sort_values("bin")
    assert out["n"].tolist() == [0, 0, 3, 0] and out["left_edge"].iloc[0] == 4.5


def test_theme_hits_count_records_once(spark):
    rows = [(1, "google", ["error error", "click"], ""), (2, "groq", [], "an ERROR here"), (3, "groq", [], "")]
    df = spark.createDataFrame(rows, "trial_id int, provider string, red_flags array<string>, reasoning string")
    got = {(r["scope"], r["theme"]): r["hits"] for r in N.theme_counts(df, {"e": ["error"], "c": ["click", "view"]}).collect()}
    assert got[("all", "e")] == 2 and got[("all", "c")] == 1 and got[("groq", "c")] == 0


def test_copula_keeps_margins_and_dependence(spark):
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.normal(size=n)
    real = pd.DataFrame({"row_id": range(n), "x": np.exp(x), "y": x + rng.normal(size=n), "k": rng.integers(0, 5, n),
                         "c": np.where(x > 0.5, "hi", "lo")})
    df = spark.createDataFrame(real)
    made = G.gaussian_copula(df, df.select("row_id"), columns=["x", "y", "k", "c"]).toPandas()
    assert len(made) == n and set(made["k"]) <= set(range(5))
    assert made["y"].mean() == pytest.approx(real["y"].mean(), abs=0.1)
    assert made["x"].rank().corr(made["y"].rank()) == pytest.approx(real["x"].rank().corr(real["y"].rank()), abs=0.08)
    assert (made["c"] == "hi").mean() == pytest.approx((real["c"] == "hi").mean(), abs=0.03)
    free = G.independent_margins(df, df.select("row_id"), columns=["x", "y"]).toPandas()
    assert abs(free["x"].rank().corr(free["y"].rank())) < 0.06


def test_unknown_and_failing_methods_are_left_out(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "row_id int, x double")
    with pytest.warns(UserWarning, match="unknown method"):
        out = G.generate_all(df, ["nonsense", "copula"])
    assert {r["method"] for r in out.select("method").distinct().collect()} == {"gaussian_copula"}


def test_older_human_records_and_mixed_annotations(spark):
    root = tempfile.mkdtemp(prefix="run-")
    with open(f"{root}/human.jsonl", "w") as f:
        f.write('{"trial_id": 1, "participant_id": "p1", "condition": "C1", "true_label": "REAL", "predicted_label": "REAL", '
                '"correct": true, "confidence_rating": 70, "reasoning": "odd"}\n')
    old = IN.read_human_trials(spark, f"{root}/human.jsonl")
    assert old.first()["annotator_id"] == "p1" and old.first()["confidence"] == 70.0
    with open(f"{root}/human_results_x.csv", "wb") as f:  # with a byte-order mark
        f.write(b"\xef\xbb\xbf" + (",".join(ANNOTATION.names) + "\nann,s,adult,tvae,1,C1,20,REAL,REAL,True,80,,2026-05-30T12:00:00\n").encode())
    new = IN.read_annotations(spark, f"{root}/human_results_x.csv")
    row = new.first()
    assert row["annotator_id"] == "ann" and row["correct"] is True and row["source_path"] == "human_results_x.csv"
    assert IN.read_mixed_annotations([new, old.select("annotator_id", "condition", "correct")]).count() == 2


def test_bad_json_modes(spark):
    root = tempfile.mkdtemp(prefix="run-")
    with open(f"{root}/llm_results_x.jsonl", "w") as f:
        f.write('{"trial_id": 1, "predicted_label": "REAL"}\n{"trial_id": 2, "pre\n\n{"trial_id": 3}\n')
    assert sorted(r["trial_id"] for r in IN.read_trials(spark, root, name_pattern="").collect()) == [1, 3]
    assert IN.read_trials(spark, root, bad_lines="keep").count() == 3
    with pytest.raises(Exception):
        IN.read_trials(spark, root, bad_lines="fail").select("predicted_label").collect()
    with pytest.raises(FileNotFoundError):
        IN.first_readable(spark, [f"{root}/none.csv"], IN.read_micro_csv)


def test_zero_valid_files_are_quarantined_on_request(spark):
    rows = spark.createDataFrame([("f1", "groq", "llama-3.1-8b-instant", "ERROR", 1), ("f2", None, None, None, 1)],
                                 "source_path string, provider string, model string, predicted_label string, line_no int")
    audit = U.audit_files(rows)
    assert {r["source_path"]: r["reason"] for r in U.classify_files(audit).collect()} == {"f1": None, "f2": "unapproved_model"}
    assert {r["reason"] for r in U.classify_files(audit, True).collect()} == {"zero_valid", "unapproved_model"}
    root = tempfile.mkdtemp(prefix="run-") + "/q"
    U.quarantine(rows, U.classify_files(audit, True), root)
    assert sorted(d for d in os.listdir(root) if d.startswith("reason")) == ["reason=unapproved_model", "reason=zero_valid"]


def test_stream_equals_batch_over_several_runs(spark):
    root = tempfile.mkdtemp(prefix="run-")
    folder, counts, checkpoint = f"{root}/census", f"{root}/counts", f"{root}/cp"
    rows = [(i, "2026-05-30T12:00:00", "groq", "m", "ctgan", "C1", "REAL" if i % 2 else "SYNTHETIC",
             "ERROR" if i % 7 == 0 else "REAL") for i in range(60)]
    df = spark.createDataFrame(rows, "trial_id bigint, timestamp string, provider string, model string, synthetic_method string, "
                                     "condition string, true_label string, predicted_label string")
    for part in (df.filter("trial_id < 40"), df.filter("trial_id >= 20")):  # the second run repeats 20 trials
        OUT.append_trials(part, folder)
        L.start_live_counts(L.stream_trials(spark, folder, TRIAL), counts, checkpoint).awaitTermination()
    live = L.live_drs(spark, counts).first()
    once = df.filter("predicted_label <> 'ERROR'").withColumn("correct", F.col("true_label") == F.col("predicted_label")) \
        .withColumn("confidence", F.lit(1.0)).withColumnRenamed("synthetic_method", "method")
    batch = M.cell_metrics(once, ["method"]).first()
    assert (live["dataset"], live["n_real"], live["n_syn"], live["drs"]) == ("census", batch["n_real"], batch["n_syn"], batch["drs"])


STREAMED = ("trial_id bigint, timestamp string, provider string, model string, synthetic_method string, "
            "condition string, true_label string, predicted_label string")


def land(spark, folder, records):
    """Append (trial_id, timestamp, predicted label) records of one run as a new file."""
    rows = [(i, t, "groq", "m", "ctgan", "C1", "REAL" if i % 2 else "SYNTHETIC", said) for i, t, said in records]
    OUT.append_trials(spark.createDataFrame(rows, STREAMED), folder)


def test_equal_trial_numbers_of_two_runs_and_data_sets(spark):
    """Runs number their trials from 0: equal numbers of two runs count apart, a re-run of one run at another time counts once."""
    root = tempfile.mkdtemp(prefix="run-")
    for name in ("adult", "census"):
        for run, day in (("llm_results_a.jsonl", "29"), ("llm_results_b.jsonl", "30"), ("llm_results_b.jsonl", "31")):
            land(spark, f"{root}/{name}/{run}", [(i, f"2026-05-{day}T12:00:00", "REAL") for i in range(10)])
    rows = L.stream_trials(spark, root + "/{adult,census}/*.jsonl", TRIAL, files_per_trigger=1)
    L.start_live_counts(rows, f"{root}/counts", f"{root}/cp", delay="10 days").awaitTermination()
    live = {r["dataset"]: (r["n_real"], r["n_syn"]) for r in L.live_drs(spark, f"{root}/counts").collect()}
    assert live == {"adult": (10, 10), "census": (10, 10)}


def test_a_re_run_corrects_counts_and_late_records_go_aside(spark):
    root = tempfile.mkdtemp(prefix="run-")
    folder = f"{root}/adult/llm_results_a.jsonl"

    def live(records):
        land(spark, folder, records)
        L.start_live_counts(L.stream_trials(spark, f"{root}/adult/*.jsonl", TRIAL), f"{root}/counts", f"{root}/cp").awaitTermination()
        r = L.live_drs(spark, f"{root}/counts").first()
        return r["n_real"], r["n_syn"], r["p_real_correct"]

    first = [(1, "2026-05-01T10:00:00", "SYNTHETIC"), (3, "2026-05-01T10:00:00", "REAL"), (2, "2026-05-01T10:00:00", "ERROR"), (2, "2026-05-01T09:00:00", "REAL")]
    assert live(first) == (2, 0, 50.0)
    assert live([(1, "2026-05-01T15:00:00", "REAL"), (2, "2026-05-01T15:00:00", "SYNTHETIC"), (3, "2026-05-01T09:00:00", "SYNTHETIC")]) == (2, 1, 100.0)
    assert live([(1, "2026-05-02T15:00:00", "ERROR")]) == (1, 1, 100.0)
    assert live([(9, "2026-05-09T12:00:00", "REAL")]) == (2, 1, 100.0)  # moves the watermark two days behind
    assert live([(11, "2026-05-02T12:00:00", "SYNTHETIC"), (13, "2026-05-08T12:00:00", "REAL")]) == (3, 1, 100.0)
    late = [(r["trial_id"], r["predicted_label"], r["run"]) for r in L.late_trials(spark, f"{root}/counts").collect()]
    assert late == [(11, "SYNTHETIC", "llm_results_a.jsonl")]


def test_matched_samples_of_cells_are_drawn_apart(spark):
    rows = [(i, d, p, "m", c, "REAL" if i % 2 else "SYNTHETIC", i % 3 == 0) for d in ("adult", "census") for c in ("C1", "C2")
            for p, n in (("a", 400), ("b", 40)) for i in range(n)]
    t = spark.createDataFrame(rows, "trial_id int, dataset string, provider_label string, method string, condition string, "
                                    "true_label string, correct boolean")
    got = I.matched_sample(t, 2026).filter("provider_label = 'a'").groupBy("dataset", "condition").agg(F.collect_set("trial_id").alias("s")).collect()
    sets = [set(r["s"]) for r in got]
    assert all(len(s) == 40 for s in sets) and len({frozenset(s) for s in sets}) == 4
    assert max(len(a & b) for i, a in enumerate(sets) for b in sets[:i]) < 20


def test_trials_of_two_files_with_equal_numbers_are_drawn_apart(spark):
    rows = [(f"run-{f}", i, "adult", p, "m", "C1", "REAL" if i % 2 else "SYNTHETIC", True)
            for f in (1, 2) for p, n in (("a", 300), ("b", 20)) for i in range(n)]
    t = spark.createDataFrame(rows, "source_path string, trial_id int, dataset string, provider_label string, method string, "
                                    "condition string, true_label string, correct boolean")
    got = I.matched_sample(t, 2026).filter("provider_label = 'a'").collect()
    picked = {f: {r["trial_id"] for r in got if r["source_path"] == f} for f in ("run-1", "run-2")}
    assert len(got) == 40 and picked["run-1"] != picked["run-2"] and all(picked.values())
    lined = t.withColumn("line_no", F.struct(F.lit(0).alias("split"), F.col("trial_id").alias("row"))).withColumn("trial_id", F.lit(1))
    assert I.matched_sample(lined, 2026).filter("provider_label = 'a'").select("source_path", "line_no").distinct().count() == 40
    assert {r["n_seeds"] for r in I.seed_sweep(lined, n_seeds=3).collect()} == {3}
    assert I.trial_key(t) == ["source_path", "trial_id"] and I.trial_key(t.drop("source_path")) == ["trial_id"]


def test_copula_keeps_nulls_and_many_values(spark):
    rows = [(i, f"v{i}" if i % 4 else None, float(i % 50) if i % 5 else float("nan"), None) for i in range(2000)]
    real = spark.createDataFrame(rows, "row_id int, name string, x double, void string")
    out = G.generate_all(real)
    assert {r["method"] for r in out.select("method").distinct().collect()} == {"gaussian_copula", "independent_margins", "fraction_sample"}
    made = out.filter("method = 'gaussian_copula'").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("name"), F.count("x").alias("x"),
                                                        F.count("void").alias("void"), F.countDistinct("name").alias("kinds")).first()
    assert made["n"] == 2000 and made["void"] == 0 and made["kinds"] > 600
    assert abs(made["name"] - 1500) < 100 and abs(made["x"] - 1600) < 100


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert {r["column"]: r["n_missing"] for r in P.missing(df).collect()} == {"a": 1, "b": 0}
    assert P.correlations(df).first()["r"] == 1.0


def test_lines_of_a_file_keep_their_order(spark):
    root = tempfile.mkdtemp(prefix="run-")
    with open(root + "/llm_results_x.jsonl", "w") as f:
        for i, model in enumerate(["m1"] * 3000 + ["m2"]):
            f.write('{"trial_id": %d, "provider": "groq", "model": "%s", "predicted_label": "REAL"}\n' % (0 if i == 3000 else i, model))
    rows = IN.read_trials(spark, root, bad_lines="keep", line_order=True)
    assert U.audit_files(rows).first()["model"] == "m2"


def test_successes_fill_the_queue_of_their_own_run(spark):
    rows = [(p, "adult", "m", "ctgan", "C1", "REAL", i, "REAL") for p, n in (("a", 3), ("b", 1)) for i in range(n)]
    log = spark.createDataFrame(rows, "provider string, dataset string, model string, method string, condition string, true_label string, "
                                      "trial_id int, predicted_label string")
    targets = spark.createDataFrame([("adult", p, "m", "ctgan", 8) for p in ("a", "b")],
                                    "dataset string, provider string, model string, method string, n_trials bigint")
    left = B.remaining_queue(Q.balanced_queue(targets), B.completed_slots(log, 1))
    got = {r["provider"]: r["count"] for r in left.groupBy("provider").count().collect()}
    assert got == {"a": 13, "b": 15}
    with pytest.raises(ValueError):
        B.remaining_queue(Q.balanced_queue(targets.drop("provider")), B.completed_slots(log, 1))


def test_numbers_at_gives_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(900, 3.5), rng.normal(size=1500).round(1), [-1e300, 1e300], np.exp(rng.normal(size=600) * 9)])
    real = spark.createDataFrame(pd.DataFrame({"row_id": range(len(values)), "x": values}))
    shares = np.concatenate([rng.random(2000), [0.0, 0.5, np.nextafter(1.0, 0.0)]])
    drawn = spark.createDataFrame(pd.DataFrame({"row_id": range(len(shares)), "x": shares}))
    got = G._numbers_at(drawn, "x", G._margin(real, "x"), len(values)).toPandas().set_index("row_id")["x"].sort_index()
    assert len(got) == len(shares)
    np.testing.assert_allclose(got, np.quantile(values, shares), rtol=1e-9)


def test_copula_does_not_depend_on_partitions(spark):
    rows = [(i, float((i * i) % 97) / 7, i % 11, f"c{i % 3}" if i % 4 else None) for i in range(600)]
    real = spark.createDataFrame(rows, "row_id int, x double, k bigint, c string")
    one, many = (G.gaussian_copula(real.repartition(n), real.select("row_id").repartition(n), columns=["x", "k", "c"]).toPandas()
                 .sort_values("row_id", ignore_index=True) for n in (1, 7))
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)
    assert one["k"].between(0, 10).all() and str(one["k"].dtype) == "int64"


def test_methods_are_written_whole_and_read_by_name(spark):
    root = tempfile.mkdtemp(prefix="run-")
    first = spark.createDataFrame([("a b", 1, "x"), ("ctgan", 2, None), ("ctgan", 3, "z, \"q\"")], "method string, row_id long, t string")
    OUT.write_methods(first.repartition(3), root)
    schema = first.drop("method").schema
    read = lambda: sorted(tuple(r) for r in IN.read_methods(spark, root, schema).select("method", "row_id", "t").collect())
    assert read() == [("a b", 1, "x"), ("ctgan", 2, None), ("ctgan", 3, "z, \"q\"")]
    OUT.write_methods(first.filter("row_id = 3"), root)  # replaces its own method only
    assert read() == [("a b", 1, "x"), ("ctgan", 3, "z, \"q\"")]
    with pytest.raises(Exception, match="no method"):
        OUT.write_methods(spark.createDataFrame([("ctgan", 9, "x"), (None, 8, "y")], first.schema), root)
    assert read() == [("a b", 1, "x"), ("ctgan", 3, "z, \"q\"")]
    OUT.write_methods(first.limit(0), root)
    assert len(read()) == 2


def test_prompts_are_not_moved_on_their_way_to_the_judge(spark):
    rows = spark.createDataFrame([("real", i, f"v{i}") for i in range(60)], "source string, row_id int, v string")
    asked = spark.createDataFrame([(7, "C1", "real"), (7, "C1", "real"), (8, "C1", "real")], "trial_id int, condition string, source string")
    prompts = R.build_prompts(asked, R.row_index(rows, 42, "row_id", ["v"]), ["trial_id"], ["v"], F.col("condition"))
    judged = R.judge_prompts(prompts)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "prompt" in line for line in plan.splitlines())
    shown = {r["trial_id"]: (r["n_shown"], sum(line.startswith("| v") for line in r["prompt"].splitlines()) - 1) for r in judged.collect()}
    assert shown == {7: (40, 40), 8: (20, 20)}  # a repeated request shows its rows twice


def test_shapiro_sorts_the_first_digests_only(spark, monkeypatch):
    """All but the first buckets are left out before rows are ordered; NULL keys and small groups count as before."""
    rows = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 'a', NULL) AS g", "CAST(id * 7919 % 10007 AS DOUBLE) AS v")
    rows = rows.unionByName(spark.range(12).selectExpr("id", "'small' AS g", "CAST(id * id AS DOUBLE) AS v"))
    seen, whole = [], P.top_k
    monkeypatch.setattr(P, "top_k", lambda df, *args, **more: seen.append(df.count()) or whole(df, *args, **more))
    got = {tuple(r) for r in P.shapiro(rows, ["id"], ["g"], ["v"], sample=50).collect()}
    assert seen[0] < 200
    monkeypatch.setattr(P, "_first_buckets", lambda values, *_: values)
    assert got == {tuple(r) for r in P.shapiro(rows, ["id"], ["g"], ["v"], sample=50).collect()} and len(got) == 3


def test_an_experiment_in_waves_judges_every_trial_once(spark, monkeypatch):
    """Small waves are written one after the other; their trials are those of a single one."""
    from tablejury.plans.experiment import run_experiment
    tables = spark.range(120).selectExpr("IF(id % 2 = 0, 'real', 'ctgan') AS source", "id AS row_id", "CAST(id AS DOUBLE) / 7 AS x")
    targets = spark.createDataFrame([("ctgan", 60)], "method string, n_trials long")

    def trials():
        return run_experiment(tables, targets, ["x"], "row_id", "offline", "rules").drop("timestamp")

    whole = sorted(map(str, trials().collect()))
    monkeypatch.setattr(Q, "WAVE", 25)
    monkeypatch.setattr(Q.packs, "CHUNK", 8)
    monkeypatch.setattr(Q, "WAVE_ROWS", 40)
    waves = trials()
    assert "trials-" in waves.inputFiles()[0] and sorted(map(str, waves.collect())) == whole and len(whole) == 120
