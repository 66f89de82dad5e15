"""The library's inputs made from the driver's tables: points, a grid mesh over them, observations over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import sql_table

WIDTH = 20
#: A prime below 2**31 for the replayable random numbers.
PRIME = 2147483647


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(value: Column, f) -> Column:
    """``f`` of a value that is worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def uniform(key: Column, stream: int = 0) -> Column:
    """A replayable uniform number in [0, 1) from an integer key below 1e14; the same in any SQL engine."""
    last = lambda k: lambda h: _with((h * 16807 + 7) % PRIME, lambda m: (m * m + k) % PRIME / float(PRIME))
    return _with((key * 8 + stream).cast("long"), lambda k: _with((k * 48271 + 11) % PRIME, lambda h: _with((h * h + 12345) % PRIME, last(k))))


def uniform_sql(key: str, stream: int = 0) -> str:
    k = f"(({key})*8+{stream})::BIGINT"
    h = f"(({k}*48271+11)%{PRIME})"
    h = f"(({h}*{h}+12345)%{PRIME})"
    h = f"(({h}*16807+7)%{PRIME})"
    return f"((({h}*{h}+{k})%{PRIME})/{PRIME}.0::DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


sql_table("pts", "SELECT vec_id AS vid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings")


def grid(vertices: DataFrame, width: int = WIDTH) -> DataFrame:
    """Two faces for every grid cell whose four corners exist."""
    n = vertices.agg((F.max("vid") + 1).alias("n"))
    cell = vertices.join(n).where((F.col("vid") % width < width - 1) & (F.col("vid") + width + 1 < F.col("n"))).select("vid")
    v = F.col("vid")
    face = lambda k, a, b, c: F.struct((2 * v + k).alias("fid"), a.alias("v1"), b.alias("v2"), c.alias("v3"))
    return cell.select(F.explode(F.array(face(0, v, v + 1, v + width), face(1, v + 1, v + width + 1, v + width))).alias("f")).select("f.*")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(points(spark, sf_dir))


sql_table("cells", "SELECT vid FROM pts WHERE vid % 20 < 19 AND vid + 21 < (SELECT max(vid) + 1 FROM pts)", "pts")
sql_table("tris", "SELECT 2*vid AS fid, vid AS v1, vid+1 AS v2, vid+20 AS v3 FROM cells UNION ALL SELECT 2*vid+1, vid+1, vid+21, vid+20 FROM cells", "cells")
sql_table("corners", "SELECT fid, 0 AS k, v1 AS vid FROM tris UNION ALL SELECT fid, 1, v2 FROM tris UNION ALL SELECT fid, 2, v3 FROM tris", "tris")
sql_table(
    "faces",
    """SELECT t.*, a.x ax, a.y ay, a.z az, b.x bx, b.y "by", b.z bz, c.x cx, c.y cy, c.z cz
    FROM tris t JOIN pts a ON a.vid=t.v1 JOIN pts b ON b.vid=t.v2 JOIN pts c ON c.vid=t.v3""",
    "tris", "pts",
)
sql_table("face_geo", """SELECT *, sqrt(nx*nx+ny*ny+nz*nz)/2 AS area FROM (SELECT *, (by-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by-ay)*(cx-ax) AS nz FROM (SELECT fid,v1,v2,v3,ax,ay,az,bx,"by",bz,cx,cy,cz FROM faces))""".replace("(by-", '("by"-'), "faces")
sql_table("half", "SELECT fid, 0 AS k, v1 AS i, v2 AS j, v3 AS opp FROM tris UNION ALL SELECT fid, 1, v2, v3, v1 FROM tris UNION ALL SELECT fid, 2, v3, v1, v2 FROM tris", "tris")
sql_table("edges", "SELECT least(i,j) AS i, greatest(i,j) AS j, count(*) AS n_faces FROM half GROUP BY 1, 2", "half")
sql_table("nbrs", "SELECT i, j, n_faces FROM edges UNION ALL SELECT j, i, n_faces FROM edges", "edges")
sql_table("lens", "SELECT e.i, e.j, e.n_faces, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM nbrs e JOIN pts a ON a.vid=e.i JOIN pts b ON b.vid=e.j", "nbrs", "pts")
# every corner p of a face with the two others in order
sql_table(
    "turns",
    """SELECT fid, v1 AS i, v2 AS j, v3 AS o, ax px, ay py, az pz, bx qx, "by" qy, bz qz, cx rx, cy ry, cz rz, area FROM face_geo
    UNION ALL SELECT fid, v2, v3, v1, bx, "by", bz, cx, cy, cz, ax, ay, az, area FROM face_geo
    UNION ALL SELECT fid, v3, v1, v2, cx, cy, cz, ax, ay, az, bx, "by", bz, area FROM face_geo""",
    "face_geo",
)
# at corner p the dot product and the cross product's size of its two edges
sql_table("angles", """SELECT *, (qx-px)*(rx-px)+(qy-py)*(ry-py)+(qz-pz)*(rz-pz) AS dp, 2*area AS cp FROM turns""", "turns")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sim_id, t, feature_id, value, value2): events by day from 1 and by type, mean and largest value."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.to_date(F.min("ts")).alias("first"))
    day = (F.datediff(F.to_date("ts"), "first") + 1).cast("int")
    return events.join(first).groupBy(F.lit(1).alias("sim_id"), day.alias("t"), F.col("event_type").alias("feature_id")).agg(F.avg("value").alias("value"), F.max("value").alias("value2"))


sql_table("obs", "SELECT 1 AS sim_id, (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1)::INT AS t, event_type AS feature_id, avg(value) AS value, max(value) AS value2 FROM events GROUP BY ALL")
