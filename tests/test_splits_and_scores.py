import math

from pyspark.sql import functions as F

from terrachron.functions import chronology as chrono
from terrachron.operators import fields, ordering, records, scoring, splits


def test_whole_interval_leaves_training(spark):
    rows = [("a", 0, 5), ("b", 22, 23), ("c", 0, 21), ("d", 31, 45), ("e", 29, 10), ("f", 55, 60)]
    df = spark.createDataFrame(
        [(i, float(lo), float(hi), i) for i, lo, hi in rows],
        "observation_id string, age_lower_ma double, age_upper_ma double, g string",
    )
    out = splits.assign_split(df, "g", window=(20, 30), validation_fraction=0.0)
    got = {r.observation_id: r.split for r in out.collect()}
    assert [got[k] for k in "abcdef"] == [0, 2, -1, 0, -1, 0]


def test_validation_never_splits_a_group(spark):
    df = spark.createDataFrame(
        [(k, g) for k, g in enumerate("aabb")], "observation_id int, study_id string"
    )
    out = splits.assign_split(df, "study_id", validation_fraction=0.5).collect()
    by = {}
    for r in out:
        by.setdefault(r.study_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and by["a"] != by["b"]


def test_missing_scores(spark):
    cells = [(a, i, j) for a in range(2) for i in range(2) for j in range(2)]
    truth = spark.createDataFrame([(*c, 0.0) for c in cells], "age_idx int, i int, j int, value double")
    missing = {(0, 0, 0): 2.0, (1, 1, 1): 4.0}
    pred = spark.createDataFrame(
        [(*c, missing.get(c, 0.0)) for c in cells], "age_idx int, i int, j int, value double"
    )
    support = spark.createDataFrame(
        [c for c in cells if c not in missing], "age_idx int, i int, j int"
    )
    area = F.when(F.col("i") == 0, 1.0).otherwise(3.0)
    row = fields.missing_scores(truth, pred, support, area).collect()[0]
    assert row.n_cells == 2
    assert math.isclose(row.area_mae_km, 3.5) and math.isclose(row.area_rmse_km, math.sqrt(13))


def test_weights_sum_to_one_and_jensen(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 10.0), ("b", 5.0, 9.0), ("c", 40.0, 80.0), ("d", 60.0, 70.0), ("e", 70.0, 70.0)],
        "observation_id string, age_lower_ma double, age_upper_ma double",
    )
    for kind in ("uniform", "triangular"):
        nodes = records.explode_nodes(df, ["observation_id"], distribution=kind)
        sums = {
            r.observation_id: (r.n, r.w)
            for r in nodes.groupBy("observation_id")
            .agg(F.count("*").alias("n"), F.sum("node_weight").alias("w"))
            .collect()
        }
        assert {k: v[0] for k, v in sums.items()} == {"a": 1, "b": 3, "c": 8}
        assert all(math.isclose(v[1], 1.0) for v in sums.values())
    scored = records.explode_nodes(df, ["observation_id"]).select(
        "*", F.lit(10.0).alias("y"), F.lit(2.0).alias("sigma"), (F.col("node_age") / 3).alias("mu")
    )
    assert scoring.jensen_gap(scored).collect()[0][0] <= 0
    assert scoring.replication_error(scored, 20).collect()[0][0] < 1e-12


def test_student_t_constant(spark):
    row = spark.range(1).select(chrono.t4_log_density(F.lit(0.0), 0.0, 1.0).alias("v")).collect()[0]
    assert math.isclose(row.v, math.log(3 / 8))


def test_exact_quantiles_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(500, 3.0), rng.normal(size=401)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordering.exact_quantiles(df, [], "v", {"a": 0.05, "b": 0.5, "c": 0.977}, chunks=16).collect()[0]
    want = np.quantile(values, [0.05, 0.5, 0.977])
    assert np.allclose([got.a, got.b, got.c], want)


def test_bootstrap_vectors_follow_the_hash_law(spark):
    from pyspark.sql import functions as F

    from terrachron.functions.chronology import hash_uniform
    from terrachron.operators import metrics

    rows = [(g, float(k), k + 0.1 * (k % 3), k - 0.2 * (k % 5)) for g in ("u1", "u2", "ü3", None) for k in range(7)]
    df = spark.createDataFrame([*rows, ("gap", 1.0, None, None)], "unit string, y double, a double, b double")
    got = {r.b: r.delta for r in metrics.bootstrap_deltas(df, "y", "a", "b", "unit", n_boot=40, seed=5).collect()}
    units = df.groupBy("unit").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("y"))).alias("sa"), F.sum(F.abs(F.col("b") - F.col("y"))).alias("sb")
    )
    cuts = metrics._poisson_cuts()
    drawn = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select(
        "*", hash_uniform(5, F.col("k"), F.col("unit")).alias("u")
    )
    want = {}
    for r in drawn.collect():
        t = sum(r.u >= c for c in cuts)
        n, sa, sb = want.get(r.k, (0, 0.0, 0.0))
        want[r.k] = (n + t * r.n, sa + t * (r.sa or 0), sb + t * (r.sb or 0))
    want = {k: sa / n - sb / n for k, (n, sa, sb) in want.items() if n}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_predictive_samples_read_picks_in_place(spark):
    import hashlib

    from terrachron.operators import histories

    def uniform(*parts):
        return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32

    rows = [(7, d, n, 0.5, 10.0 * d + n, 0.0) for d in range(3) for n in range(2) if (d, n) != (1, 1)]
    nodes = spark.createDataFrame(rows, "observation_id long, draw int, node_idx int, node_weight double, mu double, sigma double")
    out = histories.predictive_samples(nodes, 3, 40, 42)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    picks = [(int(uniform(42, "draw", 7, k) * 3), int(uniform(42, "node", 7, k) >= 0.5)) for k in range(40)]
    assert (1, 1) in picks
    want = [None if p == (1, 1) else 10.0 * p[0] + p[1] for p in picks]
    assert out.collect()[0].samples == want


def test_bootstrap_hashes_units_side_by_side(monkeypatch):
    """Every replicate's counts follow hashlib, which only texts over one block still go through."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from terrachron.operators import metrics

    real, calls, n_boot = hashlib.md5, [], 120
    units = ["7", "42", "12345", "ü3", "", None, "x" * 48, "x" * 49, "x" * 50, "x" * 51, "x" * 130]
    rows = pa.record_batch({"unit": units, "n": pa.array(range(1, 12), pa.int64()), "sa": [1.5, None, *[0.25] * 9], "sb": [2.0] * 11})
    want = np.zeros((3, n_boot))
    cuts = metrics._poisson_cuts()
    for row in rows.to_pylist():
        tail = "" if row["unit"] is None else f"-{row['unit']}"
        for k in range(n_boot):
            u = int(real(f"3-{k}{tail}".encode()).hexdigest()[:8], 16) / 2**32
            want[:, k] += sum(u >= c for c in cuts) * np.array([row["n"], row["sa"] or 0, row["sb"]])
    monkeypatch.setattr(hashlib, "md5", lambda text: calls.append(text) or real(text))
    out = next(metrics._replicate_sums(n_boot, 3)([rows]))
    assert out.column("n").to_pylist() == want[0].tolist()
    assert np.allclose(out.column("sa"), want[1], atol=1e-12) and np.allclose(out.column("sb"), want[2], atol=1e-12)
    assert all(len(text) > 49 for text in calls)


def _odd_draws():
    """Records with all rows, without some, with some twice or null, and with other numbers for nodes; shuffled."""
    import random

    rng = random.Random(3)
    rows = []
    for oid in (None, -7, 0, 5, 12, 345, 99_999, 30_000_017, 2**62):
        for d in range(3):
            for n in range(1 if oid == 12 else 4):
                node = 10 * n - 5 if oid == 345 else n
                row = [oid, d, node, 0.25, rng.uniform(0, 40), rng.uniform(1, 4), 20.0]
                if oid == 0 and (d, n) in ((0, 0), (1, 2), (2, 3)):
                    continue
                if oid == 5 and rng.random() < 0.4:
                    row[rng.choice([1, 2, 3, 4, 5])] = None
                rows.append(tuple(row))
                if oid == 99_999 and n % 2:
                    rows.append((oid, d, node, 0.5, rng.uniform(0, 40), 1.0, 20.0))
    rng.shuffle(rows)
    return rows


_DRAW_COLUMNS = "observation_id long, draw int, node_idx int, node_weight double, mu double, sigma double, y double"


def test_predictive_samples_hash_side_by_side(spark, monkeypatch):
    """Samples of odd records follow hashlib; the picks are neither SQL expressions nor hashlib calls."""
    import hashlib
    import math

    from terrachron.functions.chronology import side_by_side_hashes
    from terrachron.operators import histories

    def uniform(name, oid, k):
        text = "-".join(str(x) for x in (42, name, oid, k) if x is not None)
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32

    def first(rows, d, n):
        at = [r for r in rows if r[1] == d and r[2] == n and None not in (d, n)]
        return min(at, key=lambda r: [(x is not None, x or 0) for x in (r[4], r[5], r[3])]) if at else None

    nodes = spark.createDataFrame(_odd_draws(), _DRAW_COLUMNS).repartition(3)
    frame = histories.predictive_samples(nodes, 3, 60, 42)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Join" not in plan and "Generate" not in plan
    got = {r.observation_id: r.samples for r in frame.collect()}
    records = {}
    for row in _odd_draws():
        records.setdefault(row[0], []).append(row)
    assert got.keys() == records.keys()
    for oid, rows in records.items():
        if oid == 99_999:  # of rows that are there twice one is taken
            continue
        heads = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
        weights = []
        for n in heads:
            own = [r for r in rows if r[2] == n and n is not None]
            low = min(own, key=lambda r: [(x is not None, x or 0) for x in (r[1], r[2], r[4])], default=None)
            weights.append(math.nan if low is None or low[3] is None else low[3])
        for k, sample in enumerate(got[oid]):
            at = min(sum(sum(weights[: i + 1]) <= uniform("node", oid, k) for i in range(len(heads))), len(heads) - 1)
            row = first(rows, int(uniform("draw", oid, k) * 3), heads[at])
            if row is None or None in row[4:6]:
                assert sample is None
            else:
                p = uniform("noise", oid, k) + 0.5 / 2**32
                a = 4 * p * (1 - p)
                t = math.copysign(2 * math.sqrt(max(math.cos(math.acos(math.sqrt(a)) / 3) / math.sqrt(a) - 1, 0)), p - 0.5)
                assert abs(sample - row[4] - row[5] * t) < 1e-6

    import numpy as np

    real, calls = hashlib.md5, []
    monkeypatch.setattr(hashlib, "md5", lambda text: calls.append(text) or real(text))
    tails = [str(k).encode() for k in range(130)]
    hashes = side_by_side_hashes(tails)
    for length in (0, 1, 7, 8, 9, 30, 43, 44, 45, 70):
        texts = [bytes(65 + (i * 7 + j) % 26 for j in range(length)) for i in range(300)]
        out = hashes(b"42-draw-", np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(300, length))
        assert (length > 44) == bool(calls)  # only texts over one block
        for i in (0, 255, 256, 299):
            assert out[i].tolist() == [int(real(b"42-draw-" + texts[i] + t).hexdigest()[:8], 16) for t in tails]


def test_predictive_intervals_of_odd_lists(spark):
    import math

    from terrachron.operators import histories

    lists = {0: [3.0, 1.0, 2.0], 1: [None, 1.0, 5.0], 2: [4.0], 3: [], 4: None, 5: [math.nan, 1.0], 6: [None] * 2 + [float(k) for k in range(40)]}
    df = spark.createDataFrame(list(lists.items()), "observation_id long, samples array<double>").coalesce(1)
    frame = histories.predictive_intervals(df)
    assert "sort_array" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r.observation_id: (r.lower, r.upper) for r in frame.collect()}
    assert got[0] == (1.1, 2.9) and got[2] == (4.0, 4.0) and got[3] == got[4] == (None, None)
    assert got[1] == (None, 4.6) and got[5][0] != got[5][0]
    assert abs(got[6][0] - 0.05) < 1e-9 and abs(got[6][1] - 36.95) < 1e-9


def test_rows_that_are_not_laid_out_are_refused(spark):
    import pytest

    from terrachron.operators import histories, ordering

    apart = [(1, 0, 0, 1.0, 1.0, 1.0, 0.0), (2, 0, 0, 1.0, 1.0, 1.0, 0.0), (1, 1, 0, 1.0, 1.0, 1.0, 0.0)]
    nodes = spark.createDataFrame(apart, _DRAW_COLUMNS).coalesce(1)
    with pytest.raises(Exception, match="not laid out"):
        histories.predictive_samples(nodes, 2, 4, laid_out=True).collect()
    spread = ordering.laid_out(nodes, "observation_id")
    frame = histories.predictive_samples(spread, 2, 4, laid_out=True)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert sorted(frame.collect()) == sorted(histories.predictive_samples(nodes, 2, 4).collect())


def test_predictive_scores_sum_rows_as_they_pass(spark):
    """Scores of odd records follow their definition, without an aggregation of every record and draw."""
    import math

    from terrachron.operators import histories, ordering

    nodes = spark.createDataFrame(_odd_draws(), _DRAW_COLUMNS).repartition(3)
    frame = histories.predictive_scores(ordering.laid_out(nodes, "observation_id"), laid_out=True)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    got = {r.observation_id: r for r in frame.collect()}
    assert sorted(got.values(), key=str) == sorted(histories.predictive_scores(nodes).collect(), key=str)
    records = {}
    for oid, d, _, w, mu, sigma, y in _odd_draws():
        p, e = records.setdefault(oid, {}).setdefault(d, ([], []))
        if None not in (w, mu, sigma):
            p.append(w * 0.375 / sigma * (1 + ((y - mu) / sigma) ** 2 / 4) ** -2.5)
        if None not in (w, mu):
            e.append(w * mu)
    assert got.keys() == records.keys()
    for oid, draws in records.items():
        p, e = ([sum(x[i]) for x in draws.values() if x[i]] for i in (0, 1))
        assert abs(got[oid].nll + math.log(sum(p) / len(p))) < 1e-9
        assert abs(got[oid].expected - sum(e) / len(e)) < 1e-9 and got[oid].y == 20.0
    empty = [(1, 0, 0, 0.0, 1.0, 1.0, 2.0), (2, 0, 0, 1.0, None, 1.0, 3.0)]
    rows = histories.predictive_scores(spark.createDataFrame(empty, _DRAW_COLUMNS)).collect()
    assert sorted(map(tuple, rows)) == [(1, None, 0.0, 2.0), (2, None, None, 3.0)]
