import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import checks, metrics, ordering, physics, polygons, spherebins, splits
from terrachron.plans import prepare
from terrachron.sources import gpml, synthetic, tables, text


def test_argument_ranges():
    assert checks.checked_number("x", 3, 0, 5) == 3.0
    for bad in (-1, 6, math.nan, math.inf, "3", True):
        with pytest.raises(ValueError, match="x = "):
            checks.checked_number("x", bad, 0, 5)
    with pytest.raises(ValueError):
        checks.checked_number("x", 0, 0, open_low=True)
    assert checks.anchor_count(60, 10) == 7
    for max_age, step in ((61, 10), (60, 0), (60, 7), (0, 1)):
        with pytest.raises(ValueError):
            checks.anchor_count(max_age, step)
    assert checks.checked_window((5, 10), 60) == (5.0, 10.0)
    for window in ((10, 5), (5, 5), (-1, 5), (5, 61)):
        with pytest.raises(ValueError):
            checks.checked_window(window, 60)


def test_held_out_list_rules(spark):
    obs = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "observation_id string, group_id string")
    good = spark.createDataFrame([("a", 1), ("c", 0)], "observation_id string, held int")
    assert splits.holdout_problems(obs, good).collect() == []
    held = {r.observation_id: r.held_out for r in splits.whole_group_holdout(obs, good, "group_id").collect()}
    assert held == {"a": True, "b": True, "c": False}
    bad = spark.createDataFrame([("a", 1), ("a", 1), ("x", 0), ("b", 2), ("c", None)], "observation_id string, held int")
    got = {r.observation_id: r.problem for r in splits.holdout_problems(obs, bad).collect()}
    assert got == {"a": "repeated id", "x": "unknown id", "b": "flag is not 0 or 1", "c": "flag is not 0 or 1"}


def test_prepare_refuses_an_empty_test_set_and_bad_lists(spark):
    obs = synthetic.observations(spark, 30)
    modern = text.parse_modern_grid(synthetic.modern_grid_lines(spark).select("value"))
    with pytest.raises(checks.ContractError, match="test set"):
        prepare.prepare(spark, obs, modern, nlat=8, nlon=16, step=10.0, window=(58.5, 59.0), max_width=0.0)
    unknown = spark.createDataFrame([("nobody",)], "observation_id string")
    with pytest.raises(checks.ContractError, match="unknown id"):
        prepare.prepare(spark, obs, modern, nlat=8, nlon=16, step=10.0, holdout=unknown)


def test_sources_refuse_what_they_cannot_read(spark):
    raw = spark.createDataFrame([("a", "1", "2", "3", "4", "5", "perhaps")], "observation_id string, present_lon string, present_lat string, age_lower_ma string, age_upper_ma string, thickness_km string, qc_negative_age string")
    assert [r.text for r in tables.flag_rejects(raw).collect()] == ["perhaps"]
    with pytest.raises(Exception, match="unreadable qc_negative_age"):
        tables.typed_observations(raw).collect()
    xml = "<gpml:Basin><gpml:reconstructionPlateId>7</gpml:reconstructionPlateId><gml:posList>0 0 1 1 2 x</gml:posList></gpml:Basin></gml:"
    members = spark.createDataFrame([("p", 1, xml)], "path string, feature long, xml string")
    assert gpml.feature_rejects(members).count() == 1
    with pytest.raises(Exception, match="malformed coordinates"):
        gpml.parse_features(members).collect()


def test_a_file_with_a_bad_line_is_left_out_whole(spark):
    names, body = "# @NA|B|FEATURE_ID", ['# @D"x|y"|"say ""so"""|f', "# @P", "0 0", "4 0", "4 4", "0 4"]
    rows = [("good.gmt", k, line) for k, line in enumerate([names, *body])]
    rows += [("bad.gmt", k, line) for k, line in enumerate([names, *body, "1 east"])]
    v = text.parse_snapshots(spark.createDataFrame(rows, "path string, n long, line string"))
    p = text.snapshot_polygons(v)
    assert {r.path for r in p.collect()} == {"good.gmt"}
    assert p.first().meta == {"A": "x|y", "B": 'say "so"', "FEATURE_ID": "f"}
    assert {(r.path, r.problem) for r in text.snapshot_rejects(v, p).collect()} == {("bad.gmt", "expected longitude and latitude")}


def test_a_ring_round_half_the_sphere_is_refused(spark):
    rows = [("equator", 1, 1, "exterior", k, 30.0 * k, 0.0, 1, 1) for k in range(12)]
    ring = spark.createDataFrame(rows, "feature_id string, part int, ring int, role string, vertex int, lon double, lat double, plate_id int, priority int")
    points = spark.createDataFrame([(5.0, 5.0)], "lon double, lat double")
    assert polygons.hemisphere_rings(ring).count() == 1
    with pytest.raises(Exception, match="half the sphere"):
        polygons.assign_plates(points, ring).collect()


@pytest.mark.parametrize("kind", ["tail", "cluster", "ties", "one"])
def test_quantiles_of_hard_columns(spark, kind):
    rng = random.Random(1)
    values = {
        "tail": [math.exp(rng.gauss(0, 12)) * rng.choice([-1, 1]) for _ in range(3000)],
        "cluster": [1e15 + k for k in range(2000)] + [0.0],
        "ties": [float(rng.randint(0, 3)) for _ in range(1000)],
        "one": [2.5],
    }[kind]
    df = spark.createDataFrame([("hot" if k % 50 else "cold", v) for k, v in enumerate(values)], "g string, v double")
    levels = {"a": 0.05, "m": 0.5, "z": 1.0}
    got = ordering.exact_quantiles(df, [], "v", levels).first()
    want = np.quantile(values, list(levels.values()))
    assert got.n == len(values) and np.allclose([got.a, got.m, got.z], want, rtol=1e-12)
    hot = [v for k, v in enumerate(values) if k % 50]
    grouped = {r.g: r for r in ordering.exact_quantiles(df, ["g"], "v", levels).collect()}
    if hot:
        assert np.allclose([grouped["hot"].a, grouped["hot"].m], np.quantile(hot, [0.05, 0.5]), rtol=1e-12)
    ids = {r.v: r.id for r in ordering.dense_ids(df, "v", "id").collect()}
    assert [ids[v] for v in sorted(ids)] == list(range(len(set(values))))
    plan = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(
        ordering.exact_quantiles(df, [], "v", levels)._jdf.queryExecution(), "simple"
    )
    assert "CartesianProduct" not in plan


def test_empty_quantiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ordering.exact_quantiles(df, [], "v", {"m": 0.5}).collect() == []
    assert ordering.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect() == []


def test_kernel_sums_take_every_centre(spark):
    centres = [(0.0, 0.0, 2.0), (90.0, 0.0, 4.0), (180.0, 0.0, 8.0)]
    row = spherebins.rbf_sums(spark.createDataFrame([(0.0, 0.0)], "lon double, lat double"), centres, 5000.0).first()
    weights = [math.exp(-0.5 * (6371.0 * a / 5000.0) ** 2) for a in (0, math.pi / 2, math.pi)]
    assert math.isclose(row.weight, sum(weights), rel_tol=1e-3)
    assert math.isclose(row.weighted_value, sum(w * c[2] for w, c in zip(weights, centres)), rel_tol=1e-3)


def test_regions_without_a_quota_leave_nothing_out(spark):
    cells = spark.createDataFrame([(k % 3, k, 0) for k in range(60)], "plate_id int, i int, j int")
    assert physics.balanced_regions(cells).agg(F.count("*"), F.max("left_out")).first()[:] == (60, 0)
    some = physics.balanced_regions(cells, 6)
    assert some.count() == 6 and {r.left_out for r in some.collect()} == {18}


def test_bootstrap_of_equal_predictors_is_zero(spark):
    rows = [(k % 7, float(k), float(k) + 1, float(k) + 1) for k in range(70)]
    deltas = metrics.bootstrap_deltas(spark.createDataFrame(rows, "u int, y double, a double, b double"), "y", "a", "b", "u", 50)
    assert deltas.count() == 50 and deltas.agg(F.max(F.abs("delta"))).first()[0] == 0


def test_ensembles_are_refused(spark):
    from terrachron.operators import histories
    from terrachron.plans import reports

    cells = [(a, i, j) for a in range(2) for i in range(1) for j in range(2)]
    grid = spark.createDataFrame(cells, "age_idx int, i int, j int")
    sides = {"a": "train", "b": "train", "c": "validation"}

    def ensemble(change=lambda r: r, same=False, groups=str):
        rows = [dict(history_id=h, group_id=groups(h), split=s, age_idx=a, i=i, j=j, value=8.0 + j, prediction=8.0, observed=1) for h, s in sides.items() for a, i, j in cells]
        rows = [r for r in map(change, rows) if r]
        cores = [(h, s, a, d, float(a + d + (0 if same else ord(h)))) for h, s in sides.items() for a in range(2) for d in range(2)]
        f = spark.createDataFrame(rows, "history_id string, group_id string, split string, age_idx int, i int, j int, value double, prediction double, observed int")
        return f, spark.createDataFrame(cores, "history_id string, split string, age_idx int, dim int, value double")

    out = reports.ensemble_report(*ensemble(), [0.0, 1.0], grid)
    assert {r.history_id: round(r.rmse_km, 9) for r in out["rmse"].collect()} == dict.fromkeys("abc", round(0.5**0.5, 9))
    cases = {
        "duplicate histories": ensemble(same=True),
        "splits of histories": ensemble(groups=lambda h: "g"),
        "other grid": ensemble(lambda r: None if r["history_id"] == "b" and r["j"] == 1 else r),
        "mask is not": ensemble(lambda r: r | {"observed": 3} if r["history_id"] == "b" else r),
        "nothing observed": ensemble(lambda r: r | {"observed": 0} if r["history_id"] == "c" else r),
        "not positive": ensemble(lambda r: r | {"value": -1.0} if r["history_id"] == "c" else r),
    }
    for message, tables_ in cases.items():
        with pytest.raises(checks.ContractError, match=message):
            reports.ensemble_report(*tables_, [0.0, 1.0], grid)
    cores = ensemble()[1]
    for ages in ([0.0], [1.0, 0.0], [0.0, math.nan], [0.0, 0.0]):
        with pytest.raises(ValueError, match="rising"):
            histories.core_problems(cores, ages)
    assert histories.core_problems(cores, [0.0, 1.0]).collect() == []
    assert {r.problem for r in histories.core_problems(cores, [0.0, 1.0, 2.0]).collect()} == {"ages and dimensions incomplete"}


def test_prepare_refuses_unknown_sources_and_short_rings(spark):
    obs = synthetic.observations(spark, 30).withColumn("source_id", F.lit("s1"))
    modern = text.parse_modern_grid(synthetic.modern_grid_lines(spark).select("value"))
    registry = spark.createDataFrame([("s1", 3.0, 0.5)], "source_id string, source_sigma_km double, source_bias_km double")
    out = prepare.prepare(spark, obs, modern, nlat=8, nlon=16, step=10.0, registry=registry)
    row = out["records"].first()
    assert row.source_bias_km == 0.5 and math.isclose(row.effective_sigma_km, math.hypot(row.sigma, 3.0))
    with pytest.raises(checks.ContractError, match="unregistered sources"):
        prepare.prepare(spark, obs, modern, nlat=8, nlon=16, step=10.0, registry=registry.where("source_id = 'x'"))
    rings = spark.createDataFrame([("f", 1, 1, "exterior", k, float(k), 0.0, 1, 1) for k in range(2)], "feature_id string, part int, ring int, role string, vertex int, lon double, lat double, plate_id int, priority int")
    entries = spark.createDataFrame([(1, 0.0, 90.0, 0.0, 0.0, 0)], "plate_id int, age double, lat double, lon double, angle double, conjugate_id int")
    with pytest.raises(checks.ContractError, match="fewer than three"):
        prepare.prepare(spark, obs, modern, nlat=8, nlon=16, step=10.0, rotation_entries=entries, static_plates=rings)


def test_dynamic_geometry_refuses_ages_without_outlines(spark):
    from terrachron.plans import dynamic

    ring = [("f", 1, 1, "exterior", k, x, y, 1, 1, 0) for k, (x, y) in enumerate([(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)])]
    v = spark.createDataFrame(ring, "feature_id string, part int, ring int, role string, vertex int, lon double, lat double, plate_id int, priority int, age_idx int")
    base = spark.createDataFrame([(0, 0, 1.0, 1.0, 1)], "i int, j int, lon double, lat double, plate_id int")
    with pytest.raises(checks.ContractError, match="without any outline"):
        dynamic.dynamic_features(base, base, v, v.limit(0), v, base, step=10.0, n_anchors=2)
    with pytest.raises(checks.ContractError, match="plates: rings"):
        dynamic.dynamic_features(base, base, v.where("vertex < 2"), v, v, base, step=10.0, n_anchors=1)


def test_dynamic_geometry_searches_all_layers_at_once(spark, monkeypatch):
    """Layers that share a feature id stay apart in the one containment search."""
    from terrachron.operators import polygons
    from terrachron.plans import dynamic

    def square(plate, west):
        corners = [(west, 0.0), (west + 5.0, 0.0), (west + 5.0, 5.0), (west, 5.0)]
        rows = [("f", 1, 1, "exterior", k, x, y, plate, 1, 0) for k, (x, y) in enumerate(corners)]
        return spark.createDataFrame(rows, "feature_id string, part int, ring int, role string, vertex int, lon double, lat double, plate_id int, priority int, age_idx int")

    calls, real = [], polygons._cell_tables
    monkeypatch.setattr(polygons, "_cell_tables", lambda *a: calls.append(1) or real(*a))
    base = spark.createDataFrame([(0, k, x, 2.0, -1) for k, x in enumerate([1.5, 4.0, 7.0, 10.0])], "i int, j int, lon double, lat double, plate_id int")
    modern = spark.range(180 * 360).selectExpr("cast(id div 360 as int) as i", "cast(id % 360 as int) as j", "7e0 as value")
    entries = spark.createDataFrame([(p, 0.0, 90.0, 0.0, 0.0, 0) for p in (1, 2)], "plate_id int, age double, lat double, lon double, angle double, conjugate_id int")
    out = dynamic.dynamic_features(base, modern, square(1, 0.0), square(2, 3.0), square(3, 6.0), entries, step=10.0, n_anchors=1)
    got = {r.j: (r.plate_id, r.deformation_coverage, r.continental_mask) for r in out.collect()}
    assert got == {0: (1, 0.0, -1.0), 1: (2, 1.0, -1.0), 2: (2, 1.0, 1.0), 3: (-1, 0.0, 1.0)}, got
    assert len(calls) == 1


def test_budget_points_of_both_kinds_are_read_once(spark):
    """One table of interior and boundary points gives what two copies of it give, without a join."""
    from terrachron.operators import physics

    rows = [
        (f, f"e{f % 2}" if f < 4 else f"e{k % 2}", 10.0 * (k // 2 if f > 4 else k), 5.0 + f + k, 0.1 * k, 2.0 + f, 1.0 - 0.3 * k, 3.0 + k, 100.0, 0.5)
        for f in range(6) for k in range(4)
    ] + [(None, "e0", 10.0, *[1.0] * 7), (1, "e1", None, *[1.0] * 7)]
    df = spark.createDataFrame(
        rows, "factor_id int, evidence_id string, age double, h double, source double, area_km2 double, "
        "rel_normal_velocity double, length_km double, reference_km3 double, sigma double",
    )
    one, two = physics.budget_residuals(df), physics.budget_residuals(df, df)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    # Factors 4 and 5 lie under two evidence ids, 5 at equal ages too, where the order of its steps is open.
    found, wanted = ({(r.factor_id, r.evidence_id): r.residual for r in t.collect()} for t in (one, two))
    assert found.keys() == wanted.keys() and len(found) == 8
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in found if k[0] < 5), (found, wanted)


def test_constraint_steps_are_dealt_out_once(spark, tmp_path):
    """Lines are scanned and shuffled once for a kind of residual, and both kinds share that."""
    from terrachron.catalog import physics

    lines = [(o, n, float(1 + o + n), 0.01 * n, 0.02 * (o % 3)) for o in range(1, 30) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 7) for o in range(1, 30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for query in (physics.moving_budget_residuals, physics.trajectory_residuals, physics.evidence_grouped_loss):
        out = query(spark, str(tmp_path))
        assert out.count() > 0
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line and "Reused" not in line]
        assert len(dealt) == 1 and plan.count("SortMergeJoin") == 0, plan
