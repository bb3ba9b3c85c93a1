import math

import numpy as np
from pyspark.sql import functions as F

from terrachron.functions import grids, harmonics
from terrachron.operators import fields, polygons, rotations


def ring(fid, pts, role="exterior", number=1, plate=1):
    return [(fid, 1, number, role, k, float(x), float(y), plate, plate) for k, (x, y) in enumerate(pts)]


SCHEMA = (
    "feature_id string, part int, ring int, role string, vertex int, lon double, lat double, "
    "plate_id int, priority int"
)


def test_containment_square_seam_and_pole(spark):
    cap = [(lon, 70) for lon in range(0, 360, 30)]
    rows = (
        ring("box", [(-10, -10), (10, -10), (10, 10), (-10, 10)], plate=1)
        + ring("box", [(-2, -2), (2, -2), (2, 2), (-2, 2)], "hole", 2, plate=1)
        + ring("seam", [(170, -10), (-170, -10), (-170, 10), (170, 10)], plate=2)
        + ring("cap", cap, plate=3)
        + ring("south", [(-x, -y) for x, y in cap], plate=4)
    )
    v = spark.createDataFrame(rows, SCHEMA)
    pts = [(5, 5, 1), (0, 0, -1), (180, 0, 2), (-175, 5, 2), (160, 0, -1), (12, 88, 3), (200, 80, 3),
           (40, -85, 4), (100, 20, -1), (0, 90, 3), (0, 45, -1)]
    p = spark.createDataFrame([(float(a), float(b), c) for a, b, c in pts], "lon double, lat double, want int")
    out = polygons.assign_plates(p, v).collect()
    assert all(r.plate_id == r.want for r in out), [r for r in out if r.plate_id != r.want]


def test_remap_preserves_the_integral(spark):
    g = grids.native_grid(spark).withColumn("value", 1 + F.sin(F.radians("lat")) ** 2 + F.cos(F.radians("lon")))
    total = g.agg(F.sum(F.col("value") * F.col("area_km2"))).collect()[0][0]
    out = fields.conservative_remap(g, 12, 24)
    back = out.agg(F.sum(F.col("value") * grids.gauss_cell_area("i", 12, 24))).collect()[0][0]
    assert math.isclose(total, back, rel_tol=1e-10)


def test_circuit_without_parent_is_flagged(spark):
    e = spark.createDataFrame(
        [(1, 0.0, 90.0, 0.0, 0.0, 0), (1, 10.0, 90.0, 0.0, 20.0, 0), (2, 0.0, 90.0, 0.0, 0.0, 1),
         (2, 10.0, 90.0, 0.0, 10.0, 1), (3, 5.0, 0.0, 0.0, 5.0, 9)],
        "plate_id int, age double, lat double, lon double, angle double, conjugate_id int",
    )
    pts = spark.createDataFrame(
        [(1, 5.0), (2, 5.0), (2, 30.0), (3, 5.0), (-1, 5.0)], "plate_id int, age double"
    ).withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})
    got = {(r.plate_id, r.age): (r.ok, round(r.rec_lon, 9)) for r in rotations.reconstruct(pts, e).collect()}
    assert got == {(1, 5.0): (True, 10.0), (2, 5.0): (True, 15.0), (2, 30.0): (True, 30.0),
                   (3, 5.0): (False, 0.0), (-1, 5.0): (False, 0.0)}


def test_harmonics_agree_and_are_orthonormal():
    lat, w = (np.array(x) for x in grids.gauss_latitudes(24))
    lon = np.arange(48) * 7.5
    lo, la = np.meshgrid(lon, lat)
    y = harmonics.basis_matrix(6, lo.ravel(), la.ravel())
    q = np.repeat(w, 48) * 2 * np.pi / 48
    assert np.allclose(y.T @ (y * q[:, None]), np.eye(49), atol=1e-10)


def test_harmonic_expression_equals_recursion(spark):
    pts = [(12.0, 33.0), (-170.0, -71.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    rows = df.select(harmonics.basis(5).alias("y")).collect()
    want = harmonics.basis_matrix(5, np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
    assert np.allclose([r.y for r in rows], want)


def walked(entries, plate, age, hops=11):
    """Rotation matrix from a plate to plate 0, one hop at a time; None where the walk fails."""

    def quaternion(e):
        half = math.radians(e[4]) / 2
        lat, lon = math.radians(e[2]), math.radians(e[3])
        axis = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
        return np.array([math.cos(half), *(a * math.sin(half) for a in axis)])

    def product(a, b):
        w, v = a[0] * b[0] - a[1:] @ b[1:], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])
        return np.array([w, *v])

    total, clamped = np.array([1.0, 0, 0, 0]), False
    for _ in range(hops):
        if plate == 0:
            break
        rows = sorted(e for e in entries if e[0] == plate)
        if not rows:
            return None, clamped
        k = max((i for i, e in enumerate(rows) if e[1] <= age), default=0)
        a, b = rows[k], rows[min(k + 1, len(rows) - 1)]
        edge = age < rows[0][1] or k == len(rows) - 1
        clamped |= edge
        f = 0.0 if edge else (age - a[1]) / (b[1] - a[1])
        qa, qb = quaternion(a), quaternion(a if edge else b)
        qb = -qb if qa @ qb < 0 else qb
        omega = math.acos(min(1.0, abs(qa @ qb)))
        step = qa if omega < 1e-12 else (math.sin((1 - f) * omega) * qa + math.sin(f * omega) * qb) / math.sin(omega)
        if a[5] == plate or a[5] is None:
            return None, clamped
        total, plate = product(step, total), a[5]
    return (total if plate == 0 else None), clamped


def test_circuits_agree_with_a_walk(spark):
    import random

    rng = random.Random(3)
    entries = []
    for plate in range(1, 30):
        for age in sorted({round(rng.uniform(0, 90), 1) for _ in range(rng.randint(1, 4))}):
            parent = rng.choice([0, plate - 1, plate - 2 if plate > 2 else 0, plate, 40, plate + 1] if plate > 3 else [plate - 1])
            entries.append((plate, age, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-60, 300), parent))
    entries += [(50 + k, 5.0, 10.0, 20.0, 3.0, 49 + k if k else 0) for k in range(13)]  # chains of 1 to 13 hops
    pairs = [(p, a) for p in [0, *range(1, 30), *range(50, 63), 77] for a in (-1.0, 0.0, 5.0, 17.3, 60.0, 400.0, 5000.0)]
    model = spark.createDataFrame(entries, "plate_id int, age double, lat double, lon double, angle double, conjugate_id int")
    asked = spark.createDataFrame([*pairs, (None, 1.0), (1, None), (2, float("nan"))], "plate_id int, age double")
    got = rotations.total_rotations(asked, model).collect()
    assert len(got) == len(set(pairs)) + 3
    held = 0
    for r in got:
        if r.plate_id is None or r.age is None or math.isnan(r.age):
            assert not r.ok and r.r_w is None
            continue
        expected, clamped = walked(entries, r.plate_id, r.age)
        assert r.ok == (expected is not None) and r.clamped == clamped, r
        if expected is not None:
            held += 1
            expected = -expected if expected[0] < 0 else expected
            assert np.allclose([r.r_w, r.r_x, r.r_y, r.r_z], expected, atol=1e-12)
    assert held > 100
    assert not any(r.ok for r in rotations.total_rotations(asked, model.limit(0)).collect() if r.plate_id)


def turning(ring, lon, lat):
    """Whether a ring (its smaller side) holds a point, by the angles its edges subtend there."""

    def unit(x, y):
        x, y = math.radians(x), math.radians(y)
        return np.array([math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)])

    v, p = [unit(x, y) for x, y in ring], unit(lon, lat)
    total, area = 0.0, 0.0
    for a, b in zip(v, v[1:] + v[:1]):
        total += math.atan2(p @ np.cross(a, b), a @ b - (p @ a) * (p @ b))
        area += 2 * math.atan2(v[0] @ np.cross(a, b), 1 + v[0] @ a + a @ b + v[0] @ b)
    return total / (2 * math.pi) * math.copysign(1, area) > 0.5


def test_containment_agrees_with_turning_angles(spark):
    import random

    rng = random.Random(9)
    rings, rows = {}, []
    for k in range(24):
        lon0, lat0, wide = rng.uniform(-180, 180), rng.choice([-88, -60, -20, 0, 33, 70, 87]), rng.choice([0.4, 3, 20, 40])
        n = rng.randint(3, 40)
        pts = []
        for i in range(n):  # star-shaped rings around a centre, poles and the seam included
            angle, r = 2 * math.pi * i / n, math.radians(wide * rng.uniform(0.3, 1))
            y = math.asin(math.sin(math.radians(lat0)) * math.cos(r) + math.cos(math.radians(lat0)) * math.sin(r) * math.cos(angle))
            x = math.radians(lon0) + math.atan2(math.sin(angle) * math.sin(r) * math.cos(math.radians(lat0)), math.cos(r) - math.sin(math.radians(lat0)) * math.sin(y))
            pts.append((math.degrees(x), math.degrees(y)))
        if k % 3 == 0:  # vertices on the borders and corners of cells
            pts = [(float(round(x)), float(round(y))) for x, y in pts]
            pts = [p for i, p in enumerate(pts) if p != pts[i - 1]]
        if k % 2:
            pts.reverse()
        rings[f"r{k}"] = pts
        rows += ring(f"r{k}", pts, plate=k)
    points = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(150)]
    for pts in rings.values():
        x, y = pts[0]
        points += [(x + rng.uniform(-3, 3), max(-90.0, min(90.0, y + rng.uniform(-3, 3)))) for _ in range(8)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "pid int, lon double, lat double")
    v = spark.createDataFrame(rows, SCHEMA)
    expected = {(i, f) for i, (x, y) in enumerate(points) for f, pts in rings.items() if turning(pts, x, y)}
    for cell in (1.0, 7.5):
        got = {(r.pid, r.feature_id) for r in polygons.ring_hits(p, v, point_keys=["pid"], cell=cell).collect()}
        assert got == expected and len(expected) > 40


def test_nearest_targets_crowded_into_one_cell(spark):
    """Thousands of targets within a few metres to kilometres, points near and far, one key or none."""
    from terrachron.functions import sphere
    from terrachron.operators import spherebins

    rng = np.random.default_rng(4)
    lon, lat = 10 + rng.normal(0, 0.01, 3000), 20 + rng.normal(0, 0.01, 3000)
    t = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(lon, lat)], "k string, t_lon double, t_lat double")
    t = t.withColumns(sphere.vec_columns(sphere.unit_vector("t_lon", "t_lat"), "t_"))
    points = [(i, "a", 10 + float(x), 20 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.02, (60, 2)))]
    points += [(100, "a", -170.0, -20.0), (101, "a", 0.0, 90.0), (102, "b", 10.0, 20.0), (103, "a", 40.0, 20.0)]
    p = spark.createDataFrame(points, "pid int, k string, lon double, lat double")
    unit = lambda x, y: np.array([np.cos(np.radians(y)) * np.cos(np.radians(x)), np.cos(np.radians(y)) * np.sin(np.radians(x)), np.sin(np.radians(y)) + 0 * x])
    goals = unit(lon, lat)
    for by in ([], ["k"]):
        for cap in (None, 3000.0):
            out = spherebins.nearest_distance(
                p, t, sphere.angle(sphere.vec_of("p_"), sphere.vec_of("t_")), point_keys=["pid"], by=by, cap_km=cap
            ) if by else spherebins.nearest_distance(
                p.drop("k"), t.drop("k"), sphere.angle(sphere.vec_of("p_"), sphere.vec_of("t_")), point_keys=["pid"], cap_km=cap
            )
            got = {r.pid: r.distance_km for r in out.collect()}
            assert len(got) == len(points)
            for i, k, x, y in points:
                chord = np.sqrt(((goals - unit(x, y)[:, None]) ** 2).sum(0)).min()
                want = 6371 * 2 * math.asin(min(1, chord / 2))
                if by and k == "b":
                    assert got[i] == cap
                else:
                    assert math.isclose(got[i], want if cap is None else min(want, cap), rel_tol=1e-9, abs_tol=1e-5), (i, got[i], want)


def _stack(n):
    """Polygons on top of each other; the first has a hole."""
    square = [(-10, -10), (10, -10), (10, 10), (-10, 10)]
    hole = [(-2.5, -2.5), (2.5, -2.5), (2.5, 2.5), (-2.5, 2.5)]
    rows = [r for k in range(n) for r in ring(f"f{k}", square, plate=k + 1)]
    return rows + ring("f0", hole, "hole", 2, plate=1)


def test_plates_hidden_by_an_earlier_one_are_not_met(spark, monkeypatch):
    v = spark.createDataFrame(_stack(30), SCHEMA)
    pts = [(6.5, 6.5, 1), (0.5, 0.5, 2), (2.2, 2.2, 2), (2.8, 0.5, 1), (9.9, 9.9, 1), (10.3, 0.5, -1)]
    p = spark.createDataFrame([(float(a), float(b), c) for a, b, c in pts], "lon double, lat double, want int")
    rows, real = [], polygons._settled_and_counted

    def counted(at, whole, corners, near, *rest):
        rows.append(whole.count() + corners.count())
        return real(at, whole, corners, near, *rest)

    monkeypatch.setattr(polygons, "_settled_and_counted", counted)
    out = polygons.assign_plates(p, v).collect()
    assert all(r.plate_id == r.want for r in out), out
    # Without the bound, 30 squares in each of the cells that they fill.
    assert rows[0] < 100, rows


def test_ring_tables_are_not_broadcast(spark):
    v = spark.createDataFrame(_stack(30), SCHEMA)
    p = spark.createDataFrame([(6.5, 6.5), (0.5, 0.5)], "lon double, lat double")
    hits = polygons.ring_hits(p, v, point_keys=["lon", "lat"])
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 5


def test_coverage_counts_probes_of_filled_cells(spark):
    v = spark.createDataFrame(_stack(3)[:4] + ring("f0", [(-2.5, -2.5), (2.5, -2.5), (2.5, 2.5), (-2.5, 2.5)], "hole", 2), SCHEMA)
    cells = spark.createDataFrame([(0, 0, 6.0, 6.0), (0, 1, 0.0, 0.0), (0, 2, 0.0, 10.0), (0, 3, 2.5, 2.5)], "i int, j int, lat double, lon double")
    got = {r.j: r.coverage for r in polygons.coverage_fraction(cells, v, 1.0, 1.0).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.5, 3: 0.75}


def test_edges_along_a_meridian_inside_a_cell(spark):
    v = spark.createDataFrame(ring("f", [(-2.5, -2.5), (2.5, -2.5), (2.5, 2.5), (-2.5, 2.5)]), SCHEMA)
    pts = [(2.2, 0.5, 1), (2.5, 0.5, -1), (2.8, 0.5, -1), (-2.8, 0.5, -1), (-2.5, 0.5, 1), (-2.2, 0.5, 1), (2.8, 2.2, -1)]
    p = spark.createDataFrame([(float(a), float(b), c) for a, b, c in pts], "lon double, lat double, want int")
    out = polygons.assign_plates(p, v).collect()
    assert all(r.plate_id == r.want for r in out), out


def test_kernel_sums_are_compiled(spark):
    from terrachron.operators import spherebins

    p = spark.createDataFrame([(0.0, 0.0), (10.0, 80.0)], "lon double, lat double")
    out = spherebins.rbf_sums(p, [(0.0, 0.0, 2.0), (90.0, 0.0, 3.0), (0.0, 5.0, 1.0)], 800.0)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    k = lambda d: math.exp(-0.5 * (6371 * math.radians(d) / 800) ** 2)
    row = out.where("lat = 0").collect()[0]
    assert math.isclose(row.weight, 1 + k(90) + k(5), rel_tol=1e-9)
    assert math.isclose(row.weighted_value, 2 + 3 * k(90) + k(5), rel_tol=1e-9)


def test_anchor_coefficients_are_broadcast(spark):
    from terrachron.operators import harmonics as sums

    rows = [(a, t, float(a + t)) for a in range(2) for t in range(4)]
    c = spark.createDataFrame(rows, "age_idx int, term int, coefficient double")
    p = spark.range(10).selectExpr("cast(id % 2 as int) as age_idx", "0e0 as lon", "id * 1e0 as lat")
    out = sums.synthesise(p, c, 1, by="age_idx")
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 10


def test_copies_of_an_outline_are_searched_once(spark, monkeypatch):
    """Thirty equal squares are four arcs, and points that share a position one point."""
    from terrachron.operators import spherebins

    v = spark.createDataFrame([r for r in _stack(30) if r[3] == "exterior"], SCHEMA)
    p = spark.createDataFrame([(k, 12.0, 0.0) for k in range(5)], "pid int, lon double, lat double")
    seen, real = [], spherebins.nearest_distance

    def watched(points, targets, *rest, **named):
        seen.append((targets.count(), targets.select("t_lon", "t_lat").distinct().count()))
        return real(points, targets, *rest, **named)

    monkeypatch.setattr(spherebins, "nearest_distance", watched)
    for search in (polygons.outline_distance, polygons.boundary_vertex_distance):
        out = search(p, v, point_keys=["pid"]).collect()
        assert len(out) == 5 and len({r[-1] for r in out}) == 1
        assert seen[-1][0] < 1.5 * seen[-1][1], seen
