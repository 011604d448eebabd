from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablejury.functions import packs
from tablejury.operators import sampling as Q
from tablejury.session import dropping_shuffles, shared_table


@pytest.mark.parametrize("digits, span, bucket_rows", [(4, 8, 4096), (1, 1, 3), (2, 3, 1)])
def test_rows_by_position_equal_the_sorted_table(spark, monkeypatch, digits, span, bucket_rows):
    """Also where buckets are counted by further digits, several times over."""
    for name, value in (("DIGITS", digits), ("SPAN", span), ("BUCKET_ROWS", bucket_rows)):
        monkeypatch.setattr(Q, name, value)
    rows = [("a", i, f"a{i}") for i in range(900)] + [("b", 0, "b0")] + [("c", i, f"c{i}") for i in range(40)]
    index = Q.RowIndex(spark.createDataFrame(rows, "source string, row int, line string"), "source", "row", ["line"], 5)
    ordered = {}
    for s, i, line in sorted(rows, key=lambda r: md5(f"5|{r[0]}|{r[1]}".encode()).hexdigest()):
        ordered.setdefault(s, []).append((i, line))
    wanted = [("a", p, p) for p in range(0, 900, 7)] + [("b", 0, 1), ("b", 0, 2)] + [("c", p, 0) for p in range(40)]
    got = index.fetch(spark.createDataFrame(wanted, "source string, pos long, request int")).collect()
    assert sorted((r["source"], r["pos"], r["request"], r["row"], r["line"]) for r in got) == sorted((s, p, k, *ordered[s][p]) for s, p, k in wanted)


def test_draws_are_distinct_even_and_depend_on_the_key_alone(spark):
    keys = spark.range(4000).withColumn("n_total", F.when(F.col("id") % 4 == 3, 3).otherwise(30).cast("bigint"))
    draws = {r["id"]: r["p"] for r in keys.select("id", Q.draw_positions(F.col("n_total"), 5, 1, "id").alias("p")).collect()}
    again = {r["id"]: r["p"] for r in keys.repartition(7).select("id", Q.draw_positions(F.col("n_total"), 5, 1, "id").alias("p")).collect()}
    assert draws == again
    assert all(sorted(p) == [0, 1, 2] if i % 4 == 3 else len(set(p)) == 5 and max(p) < 30 for i, p in draws.items())
    counts = Counter(x for i, p in draws.items() if i % 4 != 3 for x in p)
    assert len(counts) == 30 and all(abs(n - 500) < 110 for n in counts.values())  # 500 +- 5 standard deviations
    assert len({tuple(p) for p in draws.values()}) > 2900


def test_requests_for_absent_and_empty_tables(spark):
    index = Q.RowIndex(spark.createDataFrame([("a", 1, "x")], "source string, row int, line string"), "source", "row", ["line"], 5)
    asked = spark.createDataFrame([("a", 1), ("gone", 2)], "source string, request int")
    assert [(r["source"], r["line"], r["n_total"]) for r in index.sample(asked, ["request"], 20, 1).collect()] == [("a", "x", 1)]
    assert index.sample(asked.where("false"), ["request"], 20, 1).count() == 0


def test_draws_carry_the_number_of_a_request_only(spark):
    """The request's own columns stay behind; a request asked twice is drawn once and given twice."""
    index = Q.RowIndex(spark.createDataFrame([("a", i, f"a{i}") for i in range(50)], "source string, row int, line string"), "source", "row", ["line"], 5)
    asked = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), (None, 3, "x")], "source string, request int, note string")
    numbered = index.numbered(asked)
    assert sorted((r["request"], r["_times"]) for r in numbered.collect()) == [(1, 2), (2, 1)]
    drawn = index.drawn(numbered, ["request"], 20, 1)
    assert sorted(drawn.columns) == ["_request", "line", "pos", "row", "source"] and drawn.count() == 40
    assert index.sample(asked, ["request"], 20, 1).groupBy("request").count().orderBy("request").collect() == [(1, 40), (2, 20)]


def test_positions_in_python_equal_those_in_spark(spark):
    keys = spark.range(600).selectExpr("CONCAT('é', id) AS k", "CAST(id % 27 + 1 AS BIGINT) AS n_total")
    rows = keys.select("k", "n_total", Q.draw_positions(F.col("n_total"), 20, 42, "k").alias("p")).collect()
    got = packs.positions([f"42||{r['k']}".encode() for r in rows], np.array([r["n_total"] for r in rows]), 20)
    assert [[int(x) for x in p if x >= 0] for p in got] == [r["p"] for r in rows]


@pytest.mark.parametrize("block_rows, chunk", [(32_768, 32_768), (40, 64)])
def test_draws_in_packs_equal_draws_as_rows(spark, monkeypatch, block_rows, chunk):
    """Also with equal, NULL and absent keys, and where blocks and chunks are small."""
    monkeypatch.setattr(Q, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(packs, "CHUNK", chunk)
    rows = spark.range(900).selectExpr("IF(id % 3 = 0, 'a', IF(id % 3 = 1, 'b', NULL)) AS source", "IF(id % 11 = 0, NULL, id % 200) AS row", "IF(id % 5 = 0, NULL, id % 13) AS line")
    index = Q.RowIndex(rows.unionByName(spark.range(3).selectExpr("'few' AS source", "id AS row", "id AS line")), "source", "row", ["line"], 5)
    asked = spark.range(800).selectExpr("IF(id % 9 = 0, NULL, id % 700) AS request", "element_at(array('a', 'b', 'few', 'gone', NULL), int(id % 5) + 1) AS source", "timestamp_micros(id % 700 * 1000001) AS t")
    numbered = index.numbered(asked)

    def shown():
        return sorted(str((*r[:-1], sorted(map(str, r["_rows"])))) for r in index.shown(numbered, ["request"], 20, 1).collect())

    assert index.blocks and "_pack" in index.shown(numbered, ["request"], 20, 1)._jdf.queryExecution().toString()
    packed = shown()
    monkeypatch.setattr(index, "blocks", [])
    assert packed == shown() and len(packed) == numbered.count()


def test_few_draws_and_equal_digests_do_not_travel_in_packs(spark, monkeypatch):
    index = Q.RowIndex(spark.range(300).selectExpr("'a' AS source", "1 AS row", "id AS line"), "source", "row", ["line"], 5)
    monkeypatch.setattr(Q, "BLOCK_ROWS", 100)
    assert index.blocks == []  # 300 rows with one digest
    asked = spark.createDataFrame([("a", 1)], "source string, request int")
    assert sorted(r["line"] for r in index.shown(index.numbered(asked), ["request"], 300, 1).first()["_rows"]) == list(range(300))
    index = Q.RowIndex(spark.range(300).selectExpr("'a' AS source", "id AS row", "id AS line"), "source", "row", ["line"], 5)
    assert "_pack" not in index.shown(index.numbered(asked), ["request"], 20, 1)._jdf.queryExecution().toString()


def test_writes_can_leave_no_shuffle_files(spark):
    def files():
        return {p for p in map(str, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in p}

    before = files()
    with dropping_shuffles(spark):
        stored = shared_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not files() - before and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
