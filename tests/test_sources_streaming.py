import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.operators import mesh, spc
from meshspark.sources import obj, tables
from meshspark.streaming import monitor

OBJ = """# a square of two faces
v 0 0 0
v 1 0 0 \r
v 1 1 0
v 0 1 0
vn 0 0 1
vn 0 1 0
vt 0 0
vt 1 0
vt 1 1
vt 0 1
f 1/1/1 2/2/1 3/3/1
f 1//2 3//1 4//1\x20
"""


def test_mesh_files(spark, tmp_path):
    (tmp_path / "square.obj").write_text(OBJ)
    vertices, triangles = obj.read_mesh(spark, f"{tmp_path}/square.obj")
    assert [tuple(r)[1:] for r in triangles.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3)]
    rows = vertices.orderBy("vid").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)] and rows[0].mesh_id == "square"
    assert [(r.nx, r.ny, r.nz) for r in rows] == [(0, 1, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1)] and [(r.u, r.v) for r in rows] == [(0, 0), (1, 0), (1, 1), (0, 1)]
    obj.write_mesh(vertices, triangles, f"{tmp_path}/again.obj")
    back, faces = obj.read_mesh(spark, f"{tmp_path}/again.obj")
    same = lambda a, b, cols: sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    assert same(back, vertices, ["vid", "x", "y", "z", "nx", "ny", "nz", "u", "v"]) and same(faces, triangles, ["fid", "v1", "v2", "v3"])
    assert mesh.edges(triangles).where("n_faces = 2").select("i", "j").collect() == [(0, 2)]


def test_point_sets(spark, tmp_path):
    rng = np.random.default_rng(1)
    near, far = rng.random((30, 3)), rng.random((12, 3)) + 100
    lines = [f"v {x} {y} {z}\nvc 1 0 {k}" for k, (x, y, z) in enumerate([*near, *far])] + ["vn 0 0 1"]
    (tmp_path / "p.pobj").write_text("\n".join(lines))
    got = obj.read_points(spark, f"{tmp_path}/p.pobj")
    assert sorted(r.vid for r in got.collect()) == list(range(30)) and {r.nx for r in got.collect()} == {None} and {r.cr for r in got.collect()} == {1.0}
    (tmp_path / "c.obj").write_text("vn 1 0 0\nv 1 2 3\nv 4 5 6\nvn 0 1 0\nv 7 8 9\n")
    assert [(r.x, r.nx, r.ny) for r in obj.carry_normals(spark, f"{tmp_path}/c.obj").orderBy("vid").collect()] == [(1, 1, 0), (4, 1, 0), (7, 0, 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("2,0,0\n1.5,2,3\n4,5,6\n7,8,9\n")
    got = tables.read_matrix(spark, f"{tmp_path}/m.csv", ["x", "y", "z"], header=True)
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(0, 1.5, 2, 3), (1, 4, 5, 6)] and tables.read_dimension(spark, f"{tmp_path}/m.csv") == 2
    tables.write_matrix(got, f"{tmp_path}/w.csv", ["row"], header=True)
    assert sorted(map(tuple, tables.read_matrix(spark, f"{tmp_path}/w.csv", ["x", "y", "z"], header=True).collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "l.txt").write_text("1, 2, 3\n\n4 5\n")
    (tmp_path / "n.txt").write_text("2\n0\n2\n")
    lists = tables.read_lists(spark, f"{tmp_path}/l.txt", f"{tmp_path}/n.txt", shift=-1)
    assert [r.ids for r in lists.orderBy("row").collect()] == [[0, 1], [], [3, 4]]
    tables.write_lists(lists, f"{tmp_path}/l2", f"{tmp_path}/n2")
    assert [r.ids for r in tables.read_lists(spark, f"{tmp_path}/l2", f"{tmp_path}/n2").orderBy("row").collect()] == [[0, 1], [], [3, 4]]
    assert tables.spread(got, ["x", "y"]).count() == 4


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, t, f"f{k}", float(v)) for s in (1, 2) for t in range(1, 31) for k, v in enumerate(rng.normal(size=4))]
    schema = "sim_id int, t int, feature_id string, value double"
    parts = spark.createDataFrame(rows, schema)
    for k, (low, high) in enumerate(((1, 22), (23, 26), (20, 24), (27, 30))):  # the third batch is late
        parts.where(F.col("t").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = monitor.monitor(stream, 20).writeStream.format("memory").queryName("charts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.sim_id, r.t): r.t_stat for r in spark.table("charts").collect()}
    want = {(r.sim_id, r.t): r.t_stat for r in spc.rank_chart(parts, 20, 10).collect()}
    assert got == pytest.approx(want)
