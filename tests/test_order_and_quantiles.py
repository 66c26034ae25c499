import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import explore, ordering
from firnline.operators.quantiles import brackets, exact_quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def test_quantiles_equal_numpy(spark):
    generator = random.Random(3)
    rows = [("hot", generator.gauss(0, 5)) for _ in range(9000)]  # most rows in one group
    rows += [("ties", float(generator.randint(0, 3))) for _ in range(700)]
    rows += [("tiny", 4.0), ("tiny", None), ("pair", 1.0), ("pair", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    # a small slice makes the large groups take several rounds of histograms
    for most, bins in ((4096, 1024), (40, 16), (1, 4)):
        got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBABILITIES, most, bins).collect()}
        assert set(got) == {"hot", "ties", "tiny", "pair", "none"}
        assert got["none"].n == 0 and list(got["none"].quantiles) == [None] * len(PROBABILITIES)
        for k in ("hot", "ties", "tiny", "pair"):
            want = np.quantile([v for key, v in rows if key == k and v is not None], PROBABILITIES)
            assert np.allclose(got[k].quantiles, want, atol=1e-12), k


def test_heavy_ties_in_a_large_group(spark):
    values = [0.0] * 6000 + [1.0] * 3000 + [float(i) for i in range(2, 1002)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, [], "v", [0.5, 0.6, 0.75, 0.95], 30, 8).first()
    assert np.allclose(row.quantiles, np.quantile(values, [0.5, 0.6, 0.75, 0.95]))


@pytest.mark.parametrize("shape", ["outliers", "powers", "near", "infinite", "signs"])
def test_brackets_stay_small_for_any_distribution(spark, shape):
    generator = random.Random(6)
    values = {
        "outliers": [generator.random() for _ in range(3000)] + [1e300, -1e300],
        "powers": [generator.choice([-1, 1]) * 2.0 ** generator.uniform(-1000, 1000) for _ in range(3000)],
        "near": [1e9 + i * 2.0**-20 for i in range(3000)],
        "infinite": [generator.gauss(0, 1e-200) for _ in range(3000)] + [float("inf"), float("-inf")] * 20,
        "signs": [-1.7e308, 1.7e308] * 500 + [generator.choice([0.0, 5e-324, -5e-324]) for _ in range(2000)],
    }[shape]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, __v double").repartition(3)
    state = brackets(rows, ["k"], PROBABILITIES, 20, 32).collect()
    assert all(r.inside <= 20 or r.low == r.high for r in state)  # what the last window orders
    ordered = sorted(values)
    for r in state:
        if r.k == "a":
            assert ordered[r.before] == r.low and ordered[r.before + r.inside - 1] == r.high
            assert all(r.before <= rank < r.before + r.inside for rank in r.ranks)
    ranks = {rank for r in state if r.k == "a" for rank in r.ranks}
    assert ranks == {f((len(values) - 1) * p) for p in PROBABILITIES for f in (math.floor, math.ceil)}


def test_ranks_are_exact_and_spread(spark):
    rows = [(("hot" if i % 3 else f"g{i % 5}"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = ordering.hashed_rank(df, ["g"], ["i"], 7, "place").collect()
    for group in {r.g for r in got}:
        own = [r for r in got if r.g == group]
        assert sorted(r.place for r in own) == list(range(1, len(own) + 1))
    hashed = df.select("i", ordering.order_hash(["i"], 7).alias("h")).collect()
    order = {r.i: r.h for r in hashed}
    own = sorted([r for r in got if r.g == "hot"], key=lambda r: r.place)
    assert [order[r.i] for r in own] == sorted(order[r.i] for r in own)
    blocks = df.where("g = 'hot'").select(F.substring(ordering.order_hash(["i"], 7), 1, 1).alias("b")).groupBy("b").count()
    assert blocks.count() == 16


def test_running_before_with_nested_blocks(spark):
    generator = random.Random(5)
    rows = [(generator.choice("xy"), f"s{generator.randint(1, 4)}", generator.randint(1, 3), i, generator.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, s string, b int, i int, v double")
    got = ordering.running_before(df, ["c"], ["s", "b"], ["i"], {"total": F.col("v"), "seen": F.lit(1)}).collect()
    assert len(got) == 400
    for c in "xy":
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1], r[2], r[3]))
        by_row = {r.i: r for r in got if r.c == c}
        total = 0.0
        for n, r in enumerate(own):
            assert by_row[r[3]].seen == n and by_row[r[3]].total == pytest.approx(total)
            total += r[4]


@pytest.mark.parametrize("n", [3, 8, 11, 40])
def test_portions_sizes(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "i int")
    got = [r["count"] for r in ordering.portions(df, [], ["i"], 1, 8).groupBy("portion").count().orderBy("portion").collect()]
    assert got == [len(p) for p in np.array_split(list(range(n)), 8) if len(p)]


def test_describe_and_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = explore.describe(df, ["v"]).first()
    assert (row["count"], row["min"], row["max"], row.p50) == (5, 1.0, 100.0, 3.0)
    assert row["std"] == pytest.approx(np.std(values, ddof=1))
    box = explore.box_summary(df, "k", "v").first()
    assert (box.q1, box.q3, box.whisker_high, box.outliers) == (2.0, 4.0, 4.0, 1)


def test_histogram_matches_numpy(spark):
    generator = random.Random(9)
    values = [generator.random() * 10 for _ in range(500)]
    df = spark.createDataFrame([("a", v) for v in values] + [("flat", 2.0)], "k string, v double")
    got = explore.histogram(df, "v", "k", 20)
    counts = [r["count"] for r in got.where("k = 'a'").orderBy("bin").collect()]
    assert counts == list(np.histogram(values, 20)[0])
    assert got.where("k = 'flat'").agg(F.sum("count")).first()[0] == 1


def test_correlation_and_gain(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, None), (4.0, 8.0)], "a double, b double")
    got = {(r.x, r.y): r["corr"] for r in explore.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 8])[0, 1])
    gains = spark.createDataFrame([("f", 6.0, 2), ("g", 1.0, 1), ("h", 5.0, 0)], "feature string, gain double, splits int")
    assert [(r.feature, r.importance) for r in explore.average_gain(gains).collect()] == [("f", 0.75), ("g", 0.25), ("h", 0.0)]


def test_encoder_wins_and_first_rows(spark):
    trials = spark.createDataFrame([("m", "v", "a", 1.0), ("m", "v", "b", 2.0), ("m", "w", "b", 1.0)], "model string, variant string, encoder string, rmse double")
    assert {r.encoder: r.wins for r in explore.encoder_wins(trials).collect()} == {"a": 1, "b": 1}
    plan = explore.first_per_station(trials, "model", ["rmse"], ["encoder"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # only leading rows are shuffled
