"""The rolling median against a plain loop."""

import random
import statistics

from terrachron.operators import metrics


def test_rolling_age_median(spark):
    """Edges that rows lie on, ties, equal and negative values, empty windows, null rows."""
    rng = random.Random(5)
    train = [(rng.choice([rng.uniform(0, 40), float(rng.randint(0, 40)), 20.0]), rng.choice([rng.uniform(-5, 60), 7.0, 0.0])) for _ in range(800)]
    train += [(3.0, None), (None, 9.0), (float("nan"), 4.0)]
    asked = [rng.uniform(-3, 43) for _ in range(60)] + [float(k) for k in range(-2, 45, 3)] + [500.0, 20.0, 20.0]
    t = spark.createDataFrame(train, "age double, y double")
    q = spark.createDataFrame([(i, a) for i, a in enumerate([*asked, None])], "id int, query_age double")
    everything = statistics.median(y for _, y in train if y is not None)
    for width in (2.0, 0.3):
        got = {r.id: r.prediction for r in metrics.rolling_age_median(t, q, width).collect()}
        assert got.keys() == set(range(len(asked)))
        for i, a in enumerate(asked):
            near = [y for age, y in train if y is not None and age is not None and abs(age - a) <= width]
            assert abs(got[i] - (statistics.median(near) if near else everything)) < 1e-9, (a, width)
    assert metrics.rolling_age_median(t, q.limit(0), 2.0).collect() == []
    assert {r.prediction for r in metrics.rolling_age_median(t.limit(0), q, 2.0).collect()} == {None}
