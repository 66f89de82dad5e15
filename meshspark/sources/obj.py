"""Mesh and point-set text files: records v, vn, vt, vc and f, ids from 1 in files and from 0 in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, spatial


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, at, kind, parts): trimmed records in file order; mesh_id is the file's name."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("mesh_id"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value"))
    held = raw.where("value <> '' and not startswith(value, '#')").withColumn("parts", F.split("value", " "))
    return held.select("mesh_id", "at", F.col("parts")[0].alias("kind"), F.slice("parts", 2, F.size("parts")).alias("parts"))


def _numbered(lines: DataFrame, kind: str, names: list[str], key: str = "vid") -> DataFrame:
    rows = lines.where(F.col("kind") == kind)
    number = (F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")) - 1).cast("long")
    return rows.select("mesh_id", number.alias(key), *[F.try_element_at("parts", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names, 1)])


def _token(corner: Column, k: int) -> Column:
    """The k-th index of a corner token v, v/t, v//n or v/t/n, from 0; null where absent."""
    return F.nullif(F.get(F.split(corner, "/"), F.lit(k)), F.lit("")).cast("long") - 1


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (mesh_id, vid, x, y, z, nx, ny, nz, u, v), triangles (mesh_id, fid, v1, v2, v3)) of one or many files.

    A corner's first index is the vertex; its normal index, the last of two or three, scatters normals into vertex order,
    the last face winning. Without corners' normals those in file order are used if there are as many as vertices, as for
    texture coordinates. Only three corners of a face are read.
    """
    lines = _lines(spark, path)
    vertices = _numbered(lines, "v", ["x", "y", "z"])
    normals = _numbered(lines, "vn", ["nx", "ny", "nz"], "nid")
    texture = _numbered(lines, "vt", ["u", "v"])
    faces = lines.where("kind = 'f'").select("mesh_id", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")) - 1).cast("long").alias("fid"), "parts")
    triangles = faces.select("mesh_id", "fid", *[_token(F.col("parts")[k], 0).alias(f"v{k + 1}") for k in range(3)])
    corner = faces.select("mesh_id", "fid", F.posexplode(F.slice("parts", 1, 3)).alias("k", "c"))
    used = corner.select("mesh_id", "fid", "k", _token(F.col("c"), 0).alias("vid"), F.coalesce(_token(F.col("c"), 2), F.when(F.size(F.split("c", "/")) == 2, _token(F.col("c"), 1))).alias("nid"))
    last = used.where("nid is not null").groupBy("mesh_id", "vid").agg(F.max_by("nid", F.struct("fid", "k")).alias("nid"))
    counts = lambda df, name: df.groupBy("mesh_id").agg(F.count("*").alias(name))
    scattered = last.join(normals, ["mesh_id", "nid"]).select("mesh_id", "vid", "nx", "ny", "nz")
    out = vertices.join(scattered, ["mesh_id", "vid"], "left")
    same = counts(vertices, "n").join(counts(texture, "m"), "mesh_id").where("n = m").select("mesh_id")
    out = out.join(texture.join(same, "mesh_id", "left_semi"), ["mesh_id", "vid"], "left")
    return out, triangles


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """One text file: vertices, then normals and texture coordinates where all have them, then faces in one of the four
    layouts v, v/t, v//n, v/t/n. Rows are sorted by id on executors and merged into a single file."""
    full = vertices.agg(*[F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in ("nx", "u") if c in vertices.columns]).first()
    has = lambda c: c in vertices.columns and bool(full[c])
    number = lambda c: F.format_string("%.17g", F.col(c))
    record = lambda rank, key, kind, cols: vertices.select(F.lit(rank).alias("rank"), F.col(key).alias("key"), F.concat_ws(" ", F.lit(kind), *[number(c) for c in cols]).alias("value"))
    rows = record(0, "vid", "v", ("x", "y", "z"))
    if has("nx"):
        rows = rows.unionByName(record(1, "vid", "vn", ("nx", "ny", "nz")))
    if has("u"):
        rows = rows.unionByName(record(2, "vid", "vt", ("u", "v")))
    layout = {(False, False): "%1$d", (False, True): "%1$d/%1$d", (True, False): "%1$d//%1$d", (True, True): "%1$d/%1$d/%1$d"}[(has("nx"), has("u"))]
    face = triangles.select(F.lit(3).alias("rank"), F.col("fid").alias("key"), F.concat_ws(" ", F.lit("f"), *[F.format_string(layout, F.col(f"v{k}") + 1) for k in (1, 2, 3)]).alias("value"))
    rows.unionByName(face).orderBy("rank", "key").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_points(spark: SparkSession, path: str, largest: bool = True) -> DataFrame:
    """(vid, x, y, z, nx, ny, nz, u, v, cr, cg, cb) of one point-set file; attributes are dropped unless there is one per
    point. With ``largest`` only the largest component of the graph of 8 nearest neighbours stays, ids unchanged."""
    lines = _lines(spark, path)
    out = _numbered(lines, "v", ["x", "y", "z"])
    n = out.count()
    for kind, names in (("vn", ["nx", "ny", "nz"]), ("vt", ["u", "v"]), ("vc", ["cr", "cg", "cb"])):
        rows = _numbered(lines, kind, names)
        if rows.count() != n:
            rows = rows.limit(0)
        out = out.join(rows, ["mesh_id", "vid"], "left")
    if largest:
        pairs = spatial.knn(out.select("vid", "x", "y", "z"), 8)
        out = out.join(graph.largest_component(out.select("vid"), pairs.select("i", "j")), "vid", "left_semi")
    return out.drop("mesh_id")


def point_set(points: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds, directed graph (i, j, d) of k nearest neighbours, valence (vid, valence)) of points(vid, x, y, z)."""
    from ..operators import mesh

    pairs = spatial.knn(points, k).select("i", "j", "d")
    return mesh.bounds(points), pairs, pairs.groupBy(F.col("i").alias("vid")).agg(F.count("*").alias("valence"))


def carry_normals(spark: SparkSession, path: str) -> DataFrame:
    """(vid, x, y, z, nx, ny, nz): each v record with the last vn record above it."""
    lines = _lines(spark, path)
    normal = F.when(F.col("kind") == "vn", F.col("parts"))
    held = lines.withColumn("_n", F.last(normal, ignorenulls=True).over(Window.partitionBy("mesh_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    rows = held.where("kind = 'v'").withColumn("vid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("at")) - 1).cast("long"))
    return rows.select("vid", *[F.col("parts")[k].cast("double").alias(d) for k, d in enumerate("xyz")], *[F.get("_n", F.lit(k)).cast("double").alias("n" + d) for k, d in enumerate("xyz")])
