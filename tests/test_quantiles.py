import numpy as np
import pytest

from popatlas.operators.profile import profile_categorical, profile_numeric
from popatlas.plans.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def samples():
    rng = np.random.default_rng(7)
    return {
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "ties": np.repeat([1.0, 2.0, 9.0], [5, 90, 5]),
        "normal": rng.normal(size=2500),
        "skewed": np.exp(rng.normal(size=1800) * 4),
        "hot": np.concatenate([np.full(900, 7.0), rng.random(1500)]),
        "negative": -np.arange(301.0),
        "both signs": np.concatenate([-np.exp(rng.normal(size=300)), np.zeros(99), rng.random(300)]),
        "zeros": np.array([0.0, -0.0, 0.0]),
        "extreme": np.array([5e-324, -5e-324, 1.7e308, 1.0, 1e-300, -1.7e308, 2.0**0.125]),
        "powers": 2.0 ** np.arange(-60, 60),
        "close": 1.0 + np.arange(400) * 2.0**-52,
    }


@pytest.mark.parametrize("buckets", [2, 20, 1 << 16])
def test_exact_with_any_number_of_buckets(spark, buckets):
    data = samples()
    cells = [(name, float(v)) for name, values in data.items() for v in values]
    df = spark.createDataFrame([*cells, ("none", None)], "k string, v double").repartition(5)
    got = exact_quantiles(df, "v", PROBS, ["k"], buckets=buckets).collect()
    assert {r.k for r in got} == set(data)
    for r in got:
        assert r["quantile"] == pytest.approx(float(np.quantile(data[r.k], r.prob)), rel=1e-12), r


def test_without_keys(spark):
    df = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS v")
    assert exact_quantiles(df, "v", [0.5]).first()["quantile"] == 50.0


def test_numeric_profile_ignores_non_finite(spark):
    values = [1.0, 2.0, 4.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v, None) for v in values], "a double, b double")
    got = {r.property: r for r in profile_numeric(df, ["a", "b"]).collect()}
    assert got["a"]["count"] == 3 and got["a"]["median"] == 2.0 and got["a"]["max"] == 4.0
    assert got["a"]["std"] == pytest.approx(round(float(np.std([1, 2, 4])), 4))
    assert got["b"]["count"] == 0 and got["b"]["median"] is None


def test_categorical_profile_keeps_the_top_and_counts_all(spark):
    cells = [(f"v{i:02d}",) for i in range(30) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(cells, "c string")
    top = profile_categorical(df, ["c"], k=4).orderBy("place").collect()
    assert [r.value for r in top] == ["v02", "v05", "v08", "v11"]
    assert {(r["count"], r.unique_count, r.percent) for r in top} == {(60, 30, 5.0)}


def test_null_groups_keep_their_profile(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 3.0, "a"), ("x", 5.0, "b")], "g string, v double, c string")
    numeric = {r.g: (r["count"], r["median"]) for r in profile_numeric(df, ["v"], by=["g"]).collect()}
    assert numeric == {None: (2, 2.0), "x": (1, 5.0)}
    top = profile_categorical(df, ["c"], by=["g"])
    assert sorted((r.g or "", r.value, r.n) for r in top.collect()) == [("", "a", 2), ("x", "b", 1)]


def test_no_sketch_and_no_row_of_one_group_in_one_task(spark):
    """A third of the rows in one group, all of one value: one row per task is shuffled."""
    df = spark.range(0, 90_000, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
        "CASE WHEN id % 3 = 0 THEN 7.0 ELSE CAST(id AS DOUBLE) END AS v",
    )
    got = exact_quantiles(df, "v", [0.5], ["k"])
    assert "percentile_approx" not in got._jdf.queryExecution().toString()
    values = {r.k: r["quantile"] for r in got.collect()}
    pdf = df.toPandas()
    assert values == pytest.approx(pdf.groupby("k")["v"].median().to_dict())


def test_only_finite_values_have_quantiles(spark):
    values = [float("inf"), float("nan"), None, 3.0, float("-inf"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["quantile"] for r in exact_quantiles(df, "v", [0.5, 1.0]).orderBy("prob").collect()] == [2.0, 3.0]
    assert exact_quantiles(df.where("v is null"), "v", [0.5]).count() == 0
