import hashlib

from pyspark.sql import functions as F

from terrachron.sources import frozen, gpml, storage, synthetic, tables, text


def test_rotation_text(spark, tmp_path):
    p = tmp_path / "model.rot"
    p.write_text("! note\n101 0.0 90 0 0 0\n101 10 80 20 5 000 !x\n101 10 1 1 1 0\nbad line\n7 5 1 2 3\n")
    got = {(r.plate_id, r.age): (r.lat, r.angle, r.conjugate_id) for r in text.read_rotations(spark, str(p)).collect()}
    assert got == {(101, 0.0): (90.0, 0.0, 0), (101, 10.0): (80.0, 5.0, 0), (7, 5.0): (1.0, 3.0, 0)}


def test_snapshots(spark, tmp_path):
    body = (
        "# @VGMT1.0 @GPOLYGON\n# @NPLATEID1|FEATURE_ID\n# FEATURE_DATA\n>\n# @D12|\"f1\"\n# @P\n"
        "0 0\n10 0\n10 0\n10 10\n0 0\n>\n# @H\n2 1\n4 1\n4 2\n>\n# @D13|f2\n20 0\n30 0\n30 10\n"
    )
    (tmp_path / "plates_10Ma.gmt").write_text(body)
    (tmp_path / "plates_20Ma.gmt").write_text(body.replace("13|f2", "13"))
    assert [r.n_files for r in text.snapshot_report(text.list_snapshots(spark, str(tmp_path)), [10, 15]).orderBy("age").collect()] == [1, 0]
    v = text.read_snapshots(spark, str(tmp_path))
    assert {r.problem for r in text.snapshot_rejects(v).collect()} == {"attribute count differs from the names"}
    poly = text.snapshot_polygons(v.where("age = 10"))
    got = {(r.feature_id, r.ring): (r.role, r.part, r.n, r.plate_id) for r in poly.groupBy("feature_id", "ring", "role", "part", "plate_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("f1", 1): ("exterior", 1, 3, 12), ("f1", 2): ("hole", 1, 3, 12), ("f2", 1): ("exterior", 1, 3, 13)}


def test_features(spark, tmp_path):
    p = tmp_path / "a.gpml"
    p.write_text(
        "<gpml:FeatureCollection><gml:featureMember><gpml:Basin><gml:name>n1</gml:name>"
        "<gpml:reconstructionPlateId><gpml:ConstantValue><gpml:value>801</gpml:value></gpml:ConstantValue>"
        "</gpml:reconstructionPlateId><gml:posList>0 0 10 0 10 10</gml:posList></gpml:Basin></gml:featureMember>"
        "<gml:featureMember><gpml:Basin><gml:posList>0 0 1 1 2 2</gml:posList></gpml:Basin></gml:featureMember>"
        "</gpml:FeatureCollection>"
    )
    f = gpml.read_features(spark, str(p))
    row = f.collect()
    assert [(r.plate_id, r.name, r.feature_type, len(r.rings)) for r in row] == [(801, "n1", "Basin", 1)]
    assert gpml.outlines(f).count() == 3


def test_modern_grid_and_frozen_dataset(spark, tmp_path):
    lines = synthetic.modern_grid_lines(spark).select("value")
    lines.write.text(str(tmp_path / "grid"))
    grid = text.read_modern_grid(spark, str(tmp_path / "grid"))
    assert text.modern_grid_report(grid).collect()[0].passed
    obs = synthetic.observations(spark, 50)
    frozen.write_dataset(spark, str(tmp_path / "d"), {"obs": obs}, {"nlat": "8"})
    assert frozen.read_dataset(spark, str(tmp_path / "d"), ["obs"], {"nlat": "8"})["obs"].count() == 50
    assert storage.file_hashes(spark, str(tmp_path / "grid"), "part-*").count() >= 1


def test_observation_csv(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("observation_id,present_lon,present_lat,age_lower_ma,age_upper_ma,thickness_km,qc_negative_age\na,1,2,3,4,x,false\n")
    row = tables.read_observations(spark, str(p)).collect()[0]
    assert row.thickness_km is None and row.qc_negative_age is False


def test_file_hashes_against_hashlib(spark, tmp_path):
    contents = {"a.gmt": b"> x", "b.gmt": bytes(range(256)) * 300, "c.txt": b"left out", "d.gmt": b""}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.file_name: (r.bytes, r.sha256) for r in storage.geometry_hashes(spark, {"x": str(tmp_path)}).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if n in ("a.gmt", "b.gmt")}


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces give the digest of the whole file, also of files that no task may read whole."""
    contents = {f"{k}.gmt": bytes(range(256)) * (40 + 60 * k) + b"x" * k for k in range(4)}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    monkeypatch.setattr(storage, "PIECE_BYTES", 15000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 15000)
    try:
        found = {r.file_name: (r.bytes, r.sha256) for r in storage.file_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
