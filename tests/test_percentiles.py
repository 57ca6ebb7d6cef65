import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import timing

Q = (0.0, 0.01, 0.5, 0.5, 0.95, 0.99, 1.0)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_one_key_of_all_rows_in_many_tasks(spark, ranges):
    rng = random.Random(ranges)
    rows = [("a", rng.choice([rng.gauss(0, 1e6), float(rng.randrange(5))])) for _ in range(3001)] + [("b", float(i % 3)) for i in range(10)] + [(None, 4.0), ("c", None), ("d", 1.0), ("d", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.percentiles) for r in timing.percentiles_of_large_groups(df, "k", "v", Q, ranges=ranges).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for k, (n, p) in got.items():
        values = [v for j, v in rows if j == k and v is not None]
        assert n == len(values) and p == pytest.approx(np.percentile(values, [100 * q for q in Q]), rel=1e-12)
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", list(Q)).alias("p")).collect()}
    assert all(want[k] == pytest.approx(p, rel=1e-12) for k, (_, p) in got.items())


def test_empty_tables_infinities_and_refusals(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert timing.percentiles_of_large_groups(df, "k", "v", Q).count() == 0
    df = spark.createDataFrame([("a", float("-inf")), ("a", 1.0), ("a", float("inf"))], "k string, v double")
    assert timing.percentiles_of_large_groups(df, "k", "v", (0.0, 0.5, 1.0)).first().percentiles == [float("-inf"), 1.0, float("inf")]
    for bad in ((), (1.1,), (-0.1,)):
        with pytest.raises(ValueError):
            timing.percentiles_of_large_groups(df, "k", "v", bad)


def test_a_mean_does_not_hang_on_the_order_of_rows(spark):
    """64 values in hundredths whose mean lies halfway between two millionths: added up in doubles it comes out on either side."""
    rng = random.Random(7)
    cents = [rng.randrange(1, 40_000) for _ in range(63)]
    cents.append(next(c for c in range(1, 40_000) if (sum(cents) + c) % 64 == 30))
    want = sum(cents) / 100 / 64
    assert {float(np.cumsum(rng.sample([c / 100 for c in cents], 64))[-1]) / 64 for _ in range(50)} > {want}
    orders = [rng.sample(cents, 64) for _ in range(50)]
    rows = [(k, c / 100, False) for k, order in enumerate(orders) for c in order] + [(k, 1e9, True) for k in range(50)] + [(50, v, False) for v in (1e300, 1e-300, 2.0)] + [(51, float("nan"), False), (51, 1.0, False), (52, None, False), (53, 5.0, True)]
    got = {r.k: r for r in timing.latency_metrics(spark.createDataFrame(rows, "k long, v double, failed boolean").coalesce(1), "k", "v", "failed").collect()}
    assert {got[k].mean for k in range(50)} == {want}
    assert got[50].mean == pytest.approx(1e300 / 3) and np.isnan(got[51].mean) and got[52].mean is None and got[53].mean is None
