import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pelagia.functions.stats import correlation_p
from pelagia.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "k": np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 40, 3000).astype(str)),
        "v": rng.integers(0, 25, 3000).astype(float), "id": np.arange(3000)})
    return frame, spark.createDataFrame(frame).repartition(7)


@pytest.mark.parametrize("hot_rows", [10, 200, 10_000])
def test_numbering_by_window_and_by_slices(skewed, hot_rows):
    plain, frame = skewed
    got = ordering.numbered(frame, ["k"], ["v", "id"], "n", hot_rows=hot_rows).toPandas()
    want = plain.sort_values(["v", "id"]).assign(n=lambda d: d.groupby("k").cumcount())
    merged = got.merge(want, on=["k", "v", "id"])
    assert len(merged) == 3000 and (merged.n_x == merged.n_y).all()


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_running_total_without_segments(skewed, hot_rows):
    plain, frame = skewed
    got = ordering.running_total(frame, [], ["id"], F.col("v").cast("long"), "t", hot_rows).toPandas()
    want = plain.sort_values("id").v.cumsum().tolist()
    assert got.sort_values("id").t.tolist() == want


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_quantiles_are_exact(skewed, hot_rows):
    plain, frame = skewed
    got = ordering.quantiles(frame, ["k"], "v", {"q1": 0.25, "mid": 0.5, "q3": 0.75},
                             hot_rows=hot_rows).toPandas().set_index("k")
    want = plain.groupby("k").v.quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose(got.loc[want.index].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_average_ranks_and_lookup_of_frequent_values(skewed, hot_rows):
    plain, frame = skewed
    ranks = ordering.average_ranks(frame, "v", "r", hot_rows)
    assert ranks.agg(F.sum("_ties")).first()[0] == 3000
    for share in (2, 1000):
        got = ordering.attach_by_value(frame, ranks, "v", "_ties", share).toPandas()
        merged = got.merge(plain.assign(want=plain.v.rank()), on="id")
        assert len(merged) == 3000 and np.allclose(merged.r, merged.want)


def test_lookup_splits_frequent_keys(spark, skewed):
    plain, frame = skewed
    table = spark.createDataFrame([("hot", 1), ("3", 2), ("absent", 3)], "kk string, x int")
    cold = ordering.lookup(frame, table, [("k", "kk")], hot_rows=10_000).toPandas()
    hot = ordering.lookup(frame, table, [("k", "kk")], hot_rows=100).toPandas()
    key = lambda d: sorted(zip(d.id, d.x.fillna(0)))
    assert key(cold) == key(hot) and len(hot) == 3000


def test_deep_pages(skewed, monkeypatch):
    plain, frame = skewed
    monkeypatch.setattr(ordering, "DEEP_OFFSET", 100)
    got = [r.id for r in ordering.page(frame, [F.desc("v"), "id"], 1500, 20).collect()]
    want = plain.sort_values(["v", "id"], ascending=[False, True]).id.iloc[1500:1520].tolist()
    assert got == want
    assert ordering.page(frame, ["id"], 5000, 10).count() == 0


def exact_p(rho, n):
    """Closed form for an even number of degrees of freedom."""
    v = n - 2
    theta = np.arctan(abs(rho) / np.sqrt(1 - rho * rho))
    term, total = 1.0, 1.0
    for j in range(1, v // 2):
        term *= (2 * j - 1) / (2 * j) * np.cos(theta) ** 2
        total += term
    return 1 - np.sin(theta) * total


@pytest.mark.parametrize("n", [4, 6, 10, 50, 500, 1068, 20002])
@pytest.mark.parametrize("rho", [0.0, 1e-4, -0.01, 0.05, -0.3, 0.7])
def test_p_values(n, rho):
    assert correlation_p(rho, n) == pytest.approx(exact_p(rho, n), rel=1e-7, abs=1e-11)


def test_p_value_extremes():
    from statistics import NormalDist
    assert correlation_p(1.0, 10) == correlation_p(-1.0, 10) == 0.0
    assert correlation_p(None, 10) is None and correlation_p(0.5, 2) is None
    assert correlation_p(0.0, 10) == 1.0
    assert correlation_p(0.5, 3) == pytest.approx(2 / 3)
    assert 0 < correlation_p(0.9, 1000) < 1e-300 or correlation_p(0.9, 1000) == 0.0
    n, rho = 1_000_000_002, 3e-5
    t = rho * (n - 2) ** 0.5 / (1 - rho * rho) ** 0.5
    assert correlation_p(rho, n) == pytest.approx(2 * NormalDist().cdf(-t), rel=1e-6)
