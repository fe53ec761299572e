"""Registered queries, one or more for each operator, with the SQL that states the same.

The events table serves as a 40 x 30 camera (camera_view), lineitem as a stream with
equal timestamps and as a source of codec words, orders as frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decode, render, representations, select, spatial, temporal
from .schema import camera_view

H, W = 30, 40
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CAM = """cam AS (SELECT event_id AS idx, epoch_us(ts) AS t_us, CAST(user_id % 40 AS INTEGER) AS x,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 AS INTEGER) AS y, event_type IN ('click', 'view', 'purchase') AS p FROM events)"""
FRAMES = "frames AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS frame_idx, t_us FROM (SELECT DISTINCT epoch_us(o_orderdate) AS t_us FROM orders))"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def cam(spark: SparkSession, d: str) -> DataFrame:
    return camera_view(spark.read.parquet(f"{d}/events.parquet"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t_us")).distinct()
    return select.numbered(t, "t_us")


# --- projections, filters, sets -------------------------------------------------------


@query(f"WITH {CAM} SELECT idx, x, y, t_us AS t, p FROM cam")
def prj01_columns(spark, d):
    return cam(spark, d).select("idx", "x", "y", F.col("t_us").alias("t"), "p")


@query(f"WITH {CAM} SELECT idx, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, CAST(t_us AS DOUBLE) AS t, CAST(CAST(p AS INTEGER) AS DOUBLE) AS p FROM cam")
def prj02_matrix(spark, d):
    return select.matrix(cam(spark, d))


@query(f"WITH {CAM} SELECT * FROM cam WHERE idx = (SELECT max(idx) - 2 FROM cam)")
def prj03_single_row(spark, d):
    return select.row(cam(spark, d), -3)


@query(f"WITH {CAM} SELECT * FROM cam WHERE idx >= 10 AND idx < (SELECT max(idx) + 1 - 100 FROM cam) AND (idx - 10) % 3 = 0")
def prj04_slice(spark, d):
    return select.python_slice(cam(spark, d), 10, -100, 3)


@query(f"WITH {CAM} SELECT idx, CASE WHEN p THEN 'FF0000' ELSE '0000FF' END AS color FROM cam")
def prj05_color(spark, d):
    return cam(spark, d).select("idx", select.color(F.col("p")).alias("color"))


@query(f"WITH {CAM} SELECT count(*) AS n FROM cam")
def prj06_count(spark, d):
    return cam(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {CAM} SELECT * FROM cam WHERE idx >= 200 AND idx < 700")
def flt01_index_range(spark, d):
    return select.by_index(cam(spark, d), 200, 700)


@query(f"WITH {CAM} SELECT * FROM cam WHERE t_us >= 1704153600000000 AND t_us < 1705449600000000")
def flt02_time_range(spark, d):
    return select.by_time(cam(spark, d), 1704153600000000, 1705449600000000, strict=True)


@query(f"WITH {CAM} SELECT idx, t_us, x / 10.0 AS ax FROM cam WHERE idx % 10 = 0 AND t_us >= 1704153600000000 AND t_us < 1706313600000000")
def flt03_imu_range(spark, d):
    imu = cam(spark, d).where("idx % 10 = 0").select("idx", "t_us", (F.col("x") / 10.0).alias("ax"))
    return select.by_time(imu, 1704153600000000, 1706313600000000)


@query(f"WITH {CAM}, hot AS (SELECT y + x * 30 AS pixel FROM cam GROUP BY 1 HAVING count(*) > 10) SELECT * FROM cam WHERE y + x * 30 NOT IN (SELECT pixel FROM hot)")
def flt05_hot_pixel(spark, d):
    return select.hot_pixel_filter(cam(spark, d), H, 10)


@query(f"WITH {CAM} SELECT * FROM cam WHERE x < 32 AND y < 20 AND x >= 0 AND y >= 0")
def flt06_in_bounds(spark, d):
    return select.in_bounds(cam(spark, d), 20, 32)


@query(f"WITH {CAM} SELECT * FROM cam WHERE t_us > (SELECT t_us FROM cam WHERE idx = 50) AND t_us <= (SELECT t_us FROM cam WHERE idx = 150)")
def flt08_left_open(spark, d):
    c = cam(spark, d)
    low, high = (c.where(F.col("idx") == i).first()["t_us"] for i in (50, 150))
    return select.by_time(c, low, high, closed="right")


@query("SELECT event_id AS idx, CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events)")
def flt09_finite(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).otherwise(F.col("value"))
    return e.select(F.col("event_id").alias("idx"), select.finite(v).alias("v"))


@query(f"WITH {CAM} SELECT * FROM cam UNION ALL SELECT idx + (SELECT max(idx) + 1 FROM cam) AS idx, t_us, x, y, p FROM cam WHERE idx < 5")
def set01_append(spark, d):
    c = cam(spark, d)
    return select.append(c, c.where("idx < 5"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey < 2 UNION SELECT r_name AS name FROM region")
def set04_catalogue(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    return n.where("n_regionkey < 2").select(F.col("n_name").alias("name")).union(r.select(F.col("r_name").alias("name"))).distinct()


@query(f"WITH {CAM}, n AS (SELECT count(*) AS n FROM cam) SELECT idx - n // 2 AS i, CASE WHEN idx < n // 2 THEN idx - n // 2 + n ELSE idx - n // 2 END AS at FROM cam, n")
def flt10_normalize_index(spark, d):
    c = cam(spark, d)
    n = c.count()
    return c.select((F.col("idx") - n // 2).alias("i")).select("i", select.normalize_index(F.col("i"), F.lit(n)).alias("at"))


@query(f"WITH {CAM} SELECT * FROM cam WHERE idx < 100 UNION ALL SELECT * FROM cam WHERE idx >= 100")
def set02_concat(spark, d):
    c = cam(spark, d)
    return c.where("idx < 100").unionByName(c.where("idx >= 100"))


@query(f"WITH {CAM}, k AS (SELECT DISTINCT x FROM cam WHERE y = 3 AND p) SELECT * FROM cam WHERE x NOT IN (SELECT x FROM k)")
def set03_members(spark, d):
    c = cam(spark, d)
    return select.members(c, c.where("y = 3 AND p").distinct(), "x", invert=True)


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey AS k FROM customer")
def set05_available(spark, d):
    n, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer"))
    return n.select(F.col("n_nationkey").alias("k")).intersect(c.select(F.col("c_nationkey").alias("k")))


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS idx, epoch_us(l_shipdate) AS t_us, l_orderkey FROM lineitem")
def srt01_dense_order(spark, d):
    from .schema import dense_index

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = dense_index(li.select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return rows.select("idx", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t_us"), "l_orderkey")


@query("SELECT c_name AS name, row_number() OVER (ORDER BY c_name) - 1 AS frame_idx FROM customer")
def srt02_sorted_names(spark, d):
    return select.numbered(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name")), "name")


@query(f"WITH {CAM}, g AS (SELECT unnest(generate_series(0, (SELECT max(t_us) - min(t_us) FROM cam) // 60000000)) AS ms) SELECT ms, (SELECT count(*) FROM cam WHERE t_us - (SELECT min(t_us) FROM cam) < ms * 60000000) AS idx FROM g")
def srt04_ms_to_index(spark, d):
    c = cam(spark, d)
    zero = c.agg(F.min("t_us").alias("_z"))
    return temporal.ms_to_index(c.crossJoin(F.broadcast(zero)).withColumn("t_us", F.col("t_us") - F.col("_z")), 60_000_000)


@query(f"WITH {CAM} SELECT * FROM cam WHERE idx < 7 UNION ALL SELECT * FROM cam WHERE idx > (SELECT max(idx) - 9 FROM cam)")
def srt07_first_and_trailing(spark, d):
    c = cam(spark, d)
    return select.first(c, 7).unionByName(select.trailing(c, 9))


# --- temporal joins -------------------------------------------------------------------

PROBES = "probes AS (SELECT idx AS probe_id, t_us + (idx % 3 - 1) * 500000 * (idx % 5) AS t_us FROM cam)"


def probes(c: DataFrame) -> DataFrame:
    return c.select(F.col("idx").alias("probe_id"), (F.col("t_us") + (F.col("idx") % 3 - 1) * 500000 * (F.col("idx") % 5)).alias("t_us"))


@query(f"WITH {CAM}, {PROBES} SELECT p.probe_id, p.t_us, coalesce(c.idx, -1) AS at FROM probes p ASOF LEFT JOIN cam c ON p.t_us > c.t_us")
def join01_time_to_index(spark, d):
    c = cam(spark, d)
    return temporal.time_to_index(probes(c), c)


@query("WITH s AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS idx, epoch_us(l_shipdate) AS t_us FROM lineitem), p AS (SELECT DISTINCT epoch_us(o_orderdate) AS t_us FROM orders) SELECT p.t_us, p.t_us AS probe_id, (SELECT count(*) FROM s WHERE s.t_us < p.t_us) - 1 AS at FROM p")
def join01_equal_timestamps(spark, d):
    s = srt01_dense_order(spark, d).select("idx", "t_us")
    p = frames(spark, d).select("t_us", F.col("t_us").alias("probe_id"))
    return temporal.time_to_index(p, s, span=30 * 86_400_000_000)


@query(f"WITH {CAM}, n AS (SELECT count(*) AS n FROM cam), i AS (SELECT idx * 13 % (2 * n) - n AS i, n FROM cam, n) SELECT i.i, c.t_us FROM i JOIN cam c ON c.idx = CASE WHEN i.i < 0 THEN i.i + i.n ELSE i.i END")
def join02_index_to_time(spark, d):
    c = cam(spark, d)
    n = c.count()
    return temporal.index_to_time(c.select((F.col("idx") * 13 % (2 * n) - n).alias("i")), c, n)


NEAREST = """n AS (SELECT p.probe_id, p.t_us, b.idx AS bi, b.t_us AS bt, a.idx AS ai, a.t_us AS aft FROM probes p
  ASOF LEFT JOIN cam b ON p.t_us > b.t_us ASOF LEFT JOIN cam a ON p.t_us <= a.t_us)"""


@query(f"WITH {CAM}, {PROBES}, {NEAREST} SELECT probe_id, t_us, CASE WHEN ai IS NULL THEN bi WHEN bi IS NULL THEN ai WHEN t_us - bt <= aft - t_us THEN bi ELSE ai END AS nearest FROM n")
def join03_nearest(spark, d):
    c = cam(spark, d)
    return temporal.nearest(probes(c), c)


@query(f"WITH {CAM}, {FRAMES}, e AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM cam), f AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS frame_idx, t_us FROM cam WHERE idx % 97 = 40) SELECT f.frame_idx, f.t_us, hi.n AS hi, lag(hi.n, 1, 0) OVER (ORDER BY f.frame_idx) AS lo FROM f JOIN (SELECT f.frame_idx, count(c.idx) AS n FROM f LEFT JOIN cam c ON c.t_us < f.t_us GROUP BY 1) hi USING (frame_idx)")
def join05_frame_bounds(spark, d):
    c = cam(spark, d)
    f = select.numbered(c.where("idx % 97 = 40").select("t_us"), "t_us")
    return temporal.frame_bounds(f, c).select("frame_idx", "t_us", "hi", "lo")


CAMFRAMES = "f AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS frame_idx, t_us FROM cam WHERE idx % 97 = 40)"


def camframes(c: DataFrame) -> DataFrame:
    return select.numbered(c.where("idx % 97 = 40").select("t_us"), "t_us")


@query(f"WITH {CAM}, {CAMFRAMES} SELECT c.idx, c.t_us, f.frame_idx FROM cam c ASOF JOIN f ON c.t_us < f.t_us")
def join05_events_in_frames(spark, d):
    c = cam(spark, d)
    return temporal.in_frames(c, camframes(c)).select("idx", "t_us", "frame_idx")


@query(f"WITH {CAM}, f AS (SELECT idx // 50 AS frame_idx, idx + 3 AS event_idx FROM cam WHERE idx % 50 = 0) SELECT c.idx, f.frame_idx FROM cam c ASOF JOIN f ON c.idx < f.event_idx")
def join06_frames_by_event_index(spark, d):
    c = cam(spark, d)
    f = c.where("idx % 50 = 0").select(F.floor(F.col("idx") / 50).alias("frame_idx"), (F.col("idx") + 3).alias("event_idx"))
    return temporal.frames_by_event_index(c, f).select("idx", "frame_idx")


@query(f"""WITH {CAM}, {CAMFRAMES}, iv AS (SELECT frame_idx, t_us AS t0, lead(t_us) OVER (ORDER BY frame_idx) AS t1 FROM f), s AS (SELECT * FROM iv WHERE t1 IS NOT NULL),
  imu AS (SELECT idx, t_us FROM cam WHERE idx % 10 = 0), disp AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS idx, t_us FROM cam WHERE idx % 53 = 5),
  near AS (SELECT s.frame_idx, b.idx AS bi, b.t_us AS bt, a.idx AS ai, a.t_us AS aft, s.t1 FROM s ASOF LEFT JOIN disp b ON s.t1 > b.t_us ASOF LEFT JOIN disp a ON s.t1 <= a.t_us)
  SELECT s.frame_idx, s.t0, s.t1, (SELECT count(*) FROM cam c WHERE c.t_us >= s.t0 AND c.t_us < s.t1) AS num_events, (SELECT count(*) FROM imu c WHERE c.t_us >= s.t0 AND c.t_us < s.t1) AS num_imu,
  CASE WHEN ai IS NULL THEN bi WHEN bi IS NULL THEN ai WHEN n.t1 - bt <= aft - n.t1 THEN bi ELSE ai END AS disparity FROM s JOIN near n USING (frame_idx)""")
def join07_samples(spark, d):
    from .plans.samples import interval_samples

    c = cam(spark, d)
    disparity = select.numbered(c.where("idx % 53 = 5").select("t_us"), "t_us", name="idx")
    return interval_samples(camframes(c), c, c.where("idx % 10 = 0"), disparity)


def _near(end: str, stream: str) -> str:
    return f"(SELECT s.frame_idx, CASE WHEN a.idx IS NULL THEN b.idx WHEN b.idx IS NULL THEN a.idx WHEN s.{end} - b.t_us <= a.t_us - s.{end} THEN b.idx ELSE a.idx END AS near FROM s ASOF LEFT JOIN {stream} b ON s.{end} > b.t_us ASOF LEFT JOIN {stream} a ON s.{end} <= a.t_us)"


@query(f"""WITH {CAM}, {CAMFRAMES}, s AS (SELECT * FROM (SELECT frame_idx, t_us AS t0, lead(t_us) OVER (ORDER BY frame_idx) AS t1 FROM f) WHERE t1 IS NOT NULL),
  img AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS idx, t_us FROM cam WHERE idx % 71 = 3), disp AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS idx, t_us FROM cam WHERE idx % 53 = 5),
  back AS (SELECT row_number() OVER (ORDER BY t_us) - 1 AS idx, t_us FROM (SELECT t_us + frame_idx % 3 AS t_us FROM f WHERE frame_idx % 2 = 0))
  SELECT s.frame_idx, s.t0, s.t1, (SELECT count(*) FROM cam c WHERE c.t_us >= s.t0 AND c.t_us < s.t1) AS num_events, (SELECT count(*) FROM cam c WHERE c.idx % 10 = 0 AND c.t_us >= s.t0 AND c.t_us < s.t1) AS num_imu,
  (SELECT count(*) FROM cam c WHERE c.idx % 7 = 0 AND c.t_us >= s.t0 AND c.t_us < s.t1) AS num_lidar, i0.near AS image_start, i1.near AS image_end, s.frame_idx AS flow, b.idx AS flow_backward, d.near AS disparity
  FROM s JOIN {_near('t0', 'img')} i0 USING (frame_idx) JOIN {_near('t1', 'img')} i1 USING (frame_idx) JOIN {_near('t1', 'disp')} d USING (frame_idx) LEFT JOIN back b ON b.t_us BETWEEN s.t0 - 1 AND s.t0 + 1""")
def join07_modal_samples(spark, d):
    from .plans.samples import intervals, modal_samples

    c = cam(spark, d)
    f = camframes(c)
    back = f.where("frame_idx % 2 = 0").select((F.col("t_us") + F.col("frame_idx") % 3).alias("t_us"))
    every = lambda n, k: select.numbered(c.where(f"idx % {n} = {k}").select("t_us"), "t_us", name="idx")
    return modal_samples(intervals(f), c, every(71, 3), True, select.numbered(back, "t_us", name="idx"), every(53, 5), c.where("idx % 10 = 0"), c.where("idx % 7 = 0"))


@query(f"WITH {CAM}, l AS (SELECT idx AS id, t_us + idx % 4 AS t_us FROM cam) SELECT l.id, l.t_us, r.idx AS match FROM l LEFT JOIN cam r ON r.t_us BETWEEN l.t_us - 1 AND l.t_us + 1")
def join08_tolerance(spark, d):
    c = cam(spark, d)
    left = c.select(F.col("idx").alias("id"), (F.col("t_us") + F.col("idx") % 4).alias("t_us"))
    return temporal.within(left, c.select("idx", "t_us"), 1)


@query(f"WITH {CAM}, {CAMFRAMES} SELECT c.idx AS probe_id, c.t_us, b.t_us AS t_before, a.t_us AS t_after FROM cam c ASOF LEFT JOIN f b ON c.t_us >= b.t_us ASOF LEFT JOIN f a ON c.t_us < a.t_us")
def join09_bracket(spark, d):
    c = cam(spark, d)
    return temporal.bracket(c.select(F.col("idx").alias("probe_id"), "t_us"), camframes(c).withColumnRenamed("frame_idx", "idx"))


@query(f"WITH {CAM} SELECT idx, t_us, idx // 250 AS \"window\" FROM cam")
def win01_count_windows(spark, d):
    return temporal.count_windows(cam(spark, d), 250).select("idx", "t_us", "window")


@query(f"WITH {CAM}, b AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM cam) SELECT idx, t_us, (t_us - lo) // 3600000000 AS \"window\" FROM cam, b WHERE lo + (t_us - lo) // 3600000000 * 3600000000 < hi")
def str01_time_windows(spark, d):
    return temporal.time_windows(cam(spark, d), 3_600_000_000).select("idx", "t_us", "window")


@query(f"WITH {CAM}, s AS (SELECT (t_us - (SELECT min_by(t_us, idx) FROM cam)) // 7200000000 AS slice FROM cam), g AS (SELECT unnest(generate_series(0, (SELECT max(slice) FROM s))) AS slice), n AS (SELECT slice, count(*) AS n FROM s GROUP BY 1) SELECT g.slice, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (slice)")
def str03_slices_gapfill(spark, d):
    return representations.slice_totals(temporal.slices(cam(spark, d), 7_200_000_000, late=False))


LATE = f"{CAM}, shaken AS (SELECT idx, t_us - CASE WHEN idx % 6 = 5 THEN 9000000000 ELSE 0 END AS t_us, x, y, p FROM cam), raw AS (SELECT *, CAST(floor((t_us - (SELECT min_by(t_us, idx) FROM shaken)) / 7200000000) AS BIGINT) AS own FROM shaken)"


def shaken(c: DataFrame) -> DataFrame:
    return c.withColumn("t_us", F.col("t_us") - F.when(F.col("idx") % 6 == 5, 9_000_000_000).otherwise(0))


@query(f"WITH {LATE} SELECT idx, greatest(0, max(own) OVER (ORDER BY idx)) AS slice FROM raw")
def str04_late_events(spark, d):
    return temporal.slices(shaken(cam(spark, d)), 7_200_000_000).select("idx", "slice")


@query(f"WITH {CAM}, {CAMFRAMES} SELECT frame_idx, t_us, lag(t_us) OVER (ORDER BY frame_idx) AS prev FROM f")
def win09_previous_frame(spark, d):
    return temporal.previous(camframes(cam(spark, d)), "frame_idx", "t_us", "prev")


@query(f"WITH {LATE}, v AS (SELECT t_us < lag(t_us) OVER (ORDER BY idx) AS bad FROM shaken) SELECT count(*) AS violations FROM v WHERE bad")
def win10_monotonic_check(spark, d):
    return select.order_violations(shaken(cam(spark, d)))


# --- representations ------------------------------------------------------------------


@query(f"WITH {CAM} SELECT y, x, CAST(sum(CASE WHEN p THEN 1 ELSE -1 END) AS BIGINT) AS value FROM cam GROUP BY 1, 2")
def agg01_histogram_signed(spark, d):
    return representations.histogram(cam(spark, d), H, W)


@query(f"WITH {CAM} SELECT CASE WHEN y = 25 THEN 24 ELSE y END AS y, CASE WHEN x = 35 THEN 34 ELSE x END AS x, count(*) AS value FROM cam WHERE x <= 35 AND y <= 25 GROUP BY 1, 2")
def agg01_histogram_unsigned_edge(spark, d):
    return representations.histogram(cam(spark, d), 25, 35, use_polarity=False)


SECONDS = f"{CAM}, sec AS (SELECT *, (t_us - (SELECT min(t_us) FROM cam)) / 1e9 AS s FROM cam)"


def in_seconds(c: DataFrame) -> DataFrame:
    return c.crossJoin(F.broadcast(c.agg(F.min("t_us").alias("_z")))).withColumn("s", (F.col("t_us") - F.col("_z")) / 1e9).drop("_z")


@query(f"WITH {SECONDS}, g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM generate_series(0, 29) a(y), generate_series(0, 39) b(x)), l AS (SELECT y, x, max_by(s, idx) AS t FROM sec GROUP BY 1, 2) SELECT g.y, g.x, round(exp(-0.5 * ((SELECT max(s) FROM sec) - coalesce(l.t, 0))), 6) AS value FROM g LEFT JOIN l ON g.y = l.y AND g.x = l.x")
def agg02_time_map(spark, d):
    return representations.time_map(in_seconds(cam(spark, d)), H, W, 0.5, "s").select("y", "x", F.round("value", 6).alias("value"))


VOXEL = f"{CAM}, n AS (SELECT y, x, CASE WHEN p THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS p, 4 * CAST(t_us - min(t_us) OVER () AS DOUBLE) / (max(t_us) OVER () - min(t_us) OVER ()) AS tn FROM cam), sp AS (SELECT y, x, CAST(floor(tn) AS INTEGER) AS bin, p * (1 - (tn - floor(tn))) AS v FROM n UNION ALL SELECT y, x, CAST(floor(tn) AS INTEGER) + 1 AS bin, p * (tn - floor(tn)) AS v FROM n), vox AS (SELECT bin, y, x, sum(v) AS value FROM sp WHERE bin < 5 GROUP BY 1, 2, 3)"


@query(f"WITH {VOXEL} SELECT bin, y, x, round(value, 6) + 0.0 AS value FROM vox")
def agg03_voxel_grid(spark, d):
    return representations.voxel_grid(cam(spark, d), H, W, 5).select("bin", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {CAM}, s AS (SELECT *, (t_us - (SELECT min(t_us) FROM cam)) // 86400000000 AS slice FROM cam) SELECT slice, y, x, CAST(sum(CAST(p AS INTEGER)) AS BIGINT) AS \"on\", CAST(sum(CAST(NOT p AS INTEGER)) AS BIGINT) AS \"off\" FROM s GROUP BY 1, 2, 3")
def agg04_slice_counts(spark, d):
    return representations.slice_counts(temporal.slices(cam(spark, d), 86_400_000_000))


@query(f"WITH {CAM} SELECT CAST(y + x * 30 AS BIGINT) AS pixel, count(*) AS n FROM cam GROUP BY 1")
def agg05_pixel_counts(spark, d):
    return select.pixel_counts(cam(spark, d), H)


@query(f"WITH {CAM} SELECT count(*) AS num_events, min_by(t_us, idx) AS t_start, max_by(t_us, idx) AS t_end, max_by(t_us, idx) - min_by(t_us, idx) AS duration, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height FROM cam")
def agg06_metadata(spark, d):
    return select.metadata(cam(spark, d))


@query(f"WITH {VOXEL}, r AS (SELECT bin, y, x, CASE WHEN abs(value) < 1e-12 THEN 0 ELSE value END AS value FROM vox), st AS (SELECT sum(value) / count(*) AS m, sqrt(sum(value * value) / count(*) - (sum(value) / count(*)) ** 2) AS sd FROM r WHERE value <> 0) SELECT bin, y, x, round(CASE WHEN value <> 0 THEN (value - m) / sd ELSE 0 END, 4) + 0.0 AS value FROM r, st")
def agg07_normalized_voxels(spark, d):
    v = representations.voxel_grid(cam(spark, d), H, W, 5)
    v = v.withColumn("value", F.when(F.abs("value") < 1e-12, 0.0).otherwise(F.col("value")))  # sums that are zero but for rounding
    return representations.normalize_voxels(v).select("bin", "y", "x", (F.round("value", 4) + 0.0).alias("value"))


BOUNDS = f"{CAM}, v AS (SELECT idx // 100 AS frame_idx, (x * 30 + y) / 1200.0 AS value FROM cam), e AS (SELECT frame_idx, least(greatest(min(value), 0.0), 0.45) AS low, least(greatest(max(value), 0.55), 1.0) AS high FROM v GROUP BY 1)"


@query(f"WITH {BOUNDS} SELECT frame_idx, round(median(low) OVER w, 6) AS low, round(median(high) OVER w, 6) AS high FROM e WINDOW w AS (ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def agg08_intensity_bounds(spark, d):
    f = cam(spark, d).select(F.floor(F.col("idx") / 100).alias("frame_idx"), ((F.col("x") * 30 + F.col("y")) / 1200.0).alias("value"))
    return representations.intensity_bounds(f, 4).select("frame_idx", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {CAM}, {CAMFRAMES} SELECT frame_idx // 8 AS batch, count(*) AS n, min(frame_idx) AS first, string_agg(CAST(t_us AS VARCHAR), ',' ORDER BY frame_idx) AS times FROM f GROUP BY 1")
def agg09_collate(spark, d):
    b = representations.collate(camframes(cam(spark, d)), 8)
    return b.select("batch", F.size("samples").cast("long").alias("n"), F.element_at("samples", 1)["frame_idx"].alias("first"), F.array_join(F.transform("samples", lambda s: s["t_us"].cast("string")), ",").alias("times"))


FLOW = f"{CAM}, fl AS (SELECT y, x, (sum(CASE WHEN p THEN 1 ELSE -1 END) + 0.5)::DOUBLE AS v, (count(*) - 8 + 0.25)::DOUBLE AS h FROM cam GROUP BY 1, 2)"


def flow_field(c: DataFrame) -> DataFrame:
    return c.groupBy("y", "x").agg((F.sum(F.when(F.col("p"), 1).otherwise(-1)) + 0.5).cast("double").alias("v"), (F.count("*") - 8 + 0.25).cast("double").alias("h"))


@query(f"WITH {FLOW} SELECT round(max(sqrt(v * v + h * h) ** 0.5), 6) AS top FROM fl")
def agg10_max_magnitude(spark, d):
    f = flow_field(cam(spark, d))
    return f.agg(F.round(F.max(F.pow(F.sqrt(F.col("v") * F.col("v") + F.col("h") * F.col("h")), 0.5)), 6).alias("top"))


SLICED = f"{CAM}, c AS (SELECT (t_us - (SELECT min(t_us) FROM cam)) // 86400000000 AS slice, y, x, sum(CAST(p AS INTEGER)) AS a, sum(CAST(NOT p AS INTEGER)) AS b FROM cam GROUP BY 1, 2, 3)"


@query(f"WITH {SLICED}, g AS (SELECT unnest(generate_series(0, (SELECT max(slice) FROM c))) AS slice) SELECT g.slice, c.y, c.x, round(sum(c.a * 0.5 ** (g.slice - c.slice)), 6) AS \"on\", round(sum(c.b * 0.5 ** (g.slice - c.slice)), 6) AS \"off\" FROM c JOIN g ON g.slice >= c.slice GROUP BY 1, 2, 3")
def win12_decayed_counts(spark, d):
    n = representations.slice_counts(temporal.slices(cam(spark, d), 86_400_000_000))
    return representations.decayed_counts(n, 0.5).select("slice", "y", "x", F.round("on", 6).alias("on"), F.round("off", 6).alias("off"))


@query(f"WITH {CAM}, v AS (SELECT idx // 100 AS frame_idx, max(x) AS a FROM cam GROUP BY 1) SELECT frame_idx, a, median(a) OVER (ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a_median FROM v")
def win13_sliding_median(spark, d):
    v = cam(spark, d).groupBy(F.floor(F.col("idx") / 100).alias("frame_idx")).agg(F.max("x").alias("a"))
    return temporal.sliding_median(v, "frame_idx", ["a"], 3)


# --- coordinates and flow -------------------------------------------------------------

MAP = "m AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, x + ((x * 7 + y * 3) % 9 - 4) * 0.75 AS rx, y + ((x * 5 + y * 11) % 7 - 3) * 0.5 AS ry FROM generate_series(0, 29) a(y), generate_series(0, 39) b(x))"


def mapping(spark: SparkSession) -> DataFrame:
    g = spatial.grid(spark, H, W)
    return g.select("y", "x", (F.col("x") + ((F.col("x") * 7 + F.col("y") * 3) % 9 - 4) * 0.75).alias("rx"), (F.col("y") + ((F.col("x") * 5 + F.col("y") * 11) % 7 - 3) * 0.5).alias("ry"))


@query(f"WITH {CAM}, {MAP}, s AS (SELECT idx, t_us, p, least(x + idx % 5, 39) AS cx, least(y + idx % 3, 29) AS cy FROM cam) SELECT s.idx, s.t_us, CAST(round_even(m.rx, 0) AS INTEGER) AS x, CAST(round_even(m.ry, 0) AS INTEGER) AS y, s.p FROM s JOIN m ON m.x = s.cx AND m.y = s.cy")
def join10_undistort_keep(spark, d):
    c = cam(spark, d).withColumn("x", (F.col("x") + F.col("idx") % 5).cast("int")).withColumn("y", (F.col("y") + F.col("idx") % 3).cast("int"))
    return spatial.undistort(c, mapping(spark), H, W).select("idx", "t_us", "x", "y", "p")


RECTIFIED = f"{CAM}, {MAP}, r AS (SELECT c.idx, c.t_us, CAST(round_even(m.rx, 0) AS INTEGER) AS x, CAST(round_even(m.ry, 0) AS INTEGER) AS y, c.p FROM cam c JOIN m USING (x, y) WHERE round_even(m.rx, 0) BETWEEN 0 AND 39 AND round_even(m.ry, 0) BETWEEN 0 AND 29)"


@query(f"WITH {RECTIFIED} SELECT * FROM r")
def join12_rectify_drop(spark, d):
    return spatial.rectify(cam(spark, d), mapping(spark), H, W).select("idx", "t_us", "x", "y", "p")


@query(f"WITH {RECTIFIED} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, t_us, x, y, p FROM r")
def join13_prerectify(spark, d):
    return spatial.prerectify(cam(spark, d), mapping(spark), H, W).select("idx", "t_us", "x", "y", "p")


@query("WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS frame_idx FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS frame_idx FROM orders) SELECT a.frame_idx, c_name, o_orderkey FROM a JOIN b USING (frame_idx)")
def join14_by_ordinal(spark, d):
    a = select.numbered(spark.read.parquet(f"{d}/customer.parquet").select("c_name"), "c_name")
    b = select.numbered(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey")
    return a.join(b, "frame_idx").select("frame_idx", "c_name", "o_orderkey")


FIELD = "ff AS MATERIALIZED (SELECT CAST(frame AS INTEGER) AS frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(((x * 3 + y + frame) % 5 - 2) * 0.5 AS FLOAT) AS fx, CAST(((x + y * 2 + frame) % 7 - 3) * 0.5 AS FLOAT) AS fy FROM generate_series(0, 3) f(frame), generate_series(0, 29) a(y), generate_series(0, 39) b(x))"


def fields(spark: SparkSession) -> DataFrame:
    g = spatial.grid(spark, H, W).crossJoin(spark.range(4).withColumnRenamed("id", "frame"))
    fx = ((F.col("x") * 3 + F.col("y") + F.col("frame")) % 5 - 2) * 0.5
    fy = ((F.col("x") + F.col("y") * 2 + F.col("frame")) % 7 - 3) * 0.5
    return g.select("frame", "y", "x", fx.cast("float").alias("fx"), fy.cast("float").alias("fy"))


@query(f"WITH {CAM}, {FIELD}, q AS (SELECT idx, (y + idx % 4 * 0.5 - 0.5)::DOUBLE AS yc, (x + idx % 3 * 0.75)::DOUBLE AS xc FROM cam) SELECT q.idx, q.yc, q.xc, coalesce(f.fx, 0) AS fx, coalesce(f.fy, 0) AS fy, round_even(xc, 0) BETWEEN 0 AND 39 AND round_even(yc, 0) BETWEEN 0 AND 29 AS valid FROM q LEFT JOIN (SELECT * FROM ff WHERE frame = 0) f ON f.x = round_even(xc, 0) AND f.y = round_even(yc, 0)")
def join15_sample_flow(spark, d):
    q = cam(spark, d).select("idx", (F.col("y") + F.col("idx") % 4 * 0.5 - 0.5).alias("yc"), (F.col("x") + F.col("idx") % 3 * 0.75).alias("xc"))
    return spatial.sample_flow(q, fields(spark).where("frame = 0"), H, W).select("idx", "yc", "xc", "fx", "fy", "valid")


def _step(source: str, frame: int, share: str, out: str) -> str:
    """A frame's share of flow, looked up by whole pixel numbers; past the border there is none."""
    return (
        f"{out}k AS MATERIALIZED (SELECT *, CAST(round_even(yc, 0) AS INTEGER) AS ky, CAST(round_even(xc, 0) AS INTEGER) AS kx FROM {source}), "
        f"{out} AS MATERIALIZED (SELECT y0, x0, CAST(yc + coalesce(f.fy, 0) * CAST({share} AS FLOAT) AS FLOAT) AS yc, CAST(xc + coalesce(f.fx, 0) * CAST({share} AS FLOAT) AS FLOAT) AS xc, "
        f"xm AND coalesce(f.fx, 0) <> 0 AS xm, ym AND coalesce(f.fy, 0) <> 0 AS ym FROM {out}k s LEFT JOIN ff f ON f.frame = {frame} AND f.x = s.kx AND f.y = s.ky)"
    )


@query(f"""WITH {FIELD}, p0 AS MATERIALIZED (SELECT y AS y0, x AS x0, CAST(y AS FLOAT) AS yc, CAST(x AS FLOAT) AS xc, TRUE AS xm, TRUE AS ym FROM ff WHERE frame = 0),
  {_step('p0', 0, '0.5', 'p1')}, {_step('p1', 1, '1.0', 'p2')}, {_step('p2', 2, '0.25', 'p3')}
  SELECT y0 AS y, x0 AS x, CASE WHEN xm THEN xc - x0 ELSE 0 END::FLOAT AS dx, CASE WHEN ym THEN yc - y0 ELSE 0 END::FLOAT AS dy FROM p3""")
def fn14_interval_flow(spark, d):
    return spatial.interval_flow(fields(spark), [0.0, 1.0, 2.0, 3.0, 4.0], 0.5, 2.25, H, W)


@query(f"WITH {FIELD} SELECT y, x, fx * CAST(0.5 AS FLOAT) AS dx, fy * CAST(0.5 AS FLOAT) AS dy FROM ff WHERE frame = 1")
def fn14_within_one_frame(spark, d):
    return spatial.interval_flow(fields(spark), [0.0, 1.0, 2.0, 3.0, 4.0], 1.25, 1.75, H, W)


@query("SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM generate_series(0, 29) a(y), generate_series(0, 39) b(x)")
def fn13_grid(spark, d):
    return spatial.grid(spark, H, W)


@query("WITH RECURSIVE u AS (SELECT 0 AS k, y, x, (x - 20.0)::DOUBLE / 50 AS u0, (y - 15.0)::DOUBLE / 50 AS v0, (x - 20.0)::DOUBLE / 50 AS u, (y - 15.0)::DOUBLE / 50 AS v FROM generate_series(0, 29) a(y), generate_series(0, 39) b(x) UNION ALL SELECT k + 1, y, x, u0, v0, (u0 - (2 * 0.01 * u * v + 0.02 * (u * u + v * v + 2 * u * u))) / (1 + (u * u + v * v) * (-0.1 + (u * u + v * v) * 0.2)), (v0 - (0.01 * (u * u + v * v + 2 * v * v) + 2 * 0.02 * u * v)) / (1 + (u * u + v * v) * (-0.1 + (u * u + v * v) * 0.2)) FROM u WHERE k < 20) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(u * 50 + 20, 6) AS rx, round(v * 50 + 15, 6) AS ry FROM u WHERE k = 20")
def fn11_pinhole_map(spark, d):
    m = spatial.pinhole_map(spark, H, W, (50, 50, 20, 15, -0.1, 0.2, 0.01, 0.02))
    return m.select("y", "x", F.round("rx", 6).alias("rx"), F.round("ry", 6).alias("ry"))


IMAGE = f"{CAM}, img AS (SELECT y, x, count(*)::DOUBLE AS value FROM cam GROUP BY 1, 2)"


def image(c: DataFrame) -> DataFrame:
    return c.groupBy("y", "x").agg(F.count("*").cast("double").alias("value"))


@query(f"WITH {IMAGE}, {MAP}, k AS (SELECT m.y, m.x, floor(ry) + dy AS yy, floor(rx) + dx AS xx, abs(1 - dy - (ry - floor(ry))) * abs(1 - dx - (rx - floor(rx))) AS w FROM m, generate_series(0, 1) a(dy), generate_series(0, 1) b(dx)) SELECT k.y, k.x, round(sum(w * coalesce(i.value, 0)), 6) AS value FROM k LEFT JOIN img i ON i.y = k.yy AND i.x = k.xx GROUP BY 1, 2")
def fn12_undistort_image(spark, d):
    return spatial.undistort_image(image(cam(spark, d)), mapping(spark)).select("y", "x", F.round("value", 6).alias("value"))


# --- display --------------------------------------------------------------------------


@query(f"WITH {CAM}, l AS (SELECT least(y, 24) AS y, least(x, 34) AS x, max_by(p, idx) AS p FROM cam GROUP BY 1, 2) SELECT y, x, CASE WHEN p THEN 255 ELSE 0 END AS r, 0 AS g, CASE WHEN p THEN 0 ELSE 255 END AS b FROM l")
def fn05_paint_last_event(spark, d):
    return render.paint(cam(spark, d), 25, 35)


@query(f"WITH {IMAGE} SELECT y, x, CAST(floor(least(greatest(value, 2), 20) - 2) AS INTEGER) * 0 + CAST(least(floor((least(greatest(value, 2.0), 20.0) - 2) / 18 * 4), 3) AS INTEGER) * 60 AS g FROM img")
def fn06_depth_levels(spark, d):
    colors = [(0.0, (60 * i + 0.5) / 255, 1.0) for i in range(4)]
    return render.color_depth(image(cam(spark, d)).withColumnRenamed("value", "depth"), colors, 2.0, 20.0).select("y", "x", "g")


def _poly(row: tuple[float, ...]) -> str:
    return "CAST(floor(255 * least(1.0, greatest(0.0, " + " + ".join(f"({c!r})::DOUBLE * t ** {k}" for k, c in enumerate(row)) + "))) AS INTEGER)"


@query(f"WITH {IMAGE}, l AS (SELECT y, x, least(floor((least(greatest(value, 2.0), 20.0) - 2) / 18 * 256), 255) / 255.0::DOUBLE AS t FROM img) SELECT y, x, {_poly(render.VIRIDIS[0])} AS r, {_poly(render.VIRIDIS[1])} AS g, {_poly(render.VIRIDIS[2])} AS b FROM l")
def fn06_depth_colors(spark, d):
    return render.color_depth(image(cam(spark, d)).withColumnRenamed("value", "depth"), None, 2.0, 20.0).select("y", "x", "r", "g", "b")


@query(f"WITH {FLOW}, m AS (SELECT *, sqrt(v * v + h * h) AS mag FROM fl) SELECT y, x, CAST(floor((atan2(h, v) + pi()) * 180 / pi() / 2) AS INTEGER) AS hue, 255 AS sat, CAST(floor(255 * mag / (SELECT max(mag) FROM m)) AS INTEGER) AS val FROM m")
def fn09_flow_hsv(spark, d):
    return render.flow_hsv(flow_field(cam(spark, d))).select("y", "x", "hue", "sat", "val")


@query(f"WITH {SLICED}, s AS (SELECT slice, y, x, CAST(least(a * 30, 255) AS INTEGER) AS a, CAST(least(b * 30, 255) AS INTEGER) AS b FROM c), dl AS (SELECT slice, y + dy AS y, x + dx AS x, max(a) AS a, max(b) AS b FROM s, generate_series(-1, 1) q(dy), generate_series(-1, 1) r(dx) WHERE y + dy BETWEEN 0 AND 29 AND x + dx BETWEEN 0 AND 39 GROUP BY 1, 2, 3) SELECT slice, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN b > 40 THEN 'off' ELSE 'on' END AS color FROM dl WHERE a > 40 OR b > 40")
def fn10_render_frames(spark, d):
    n = representations.slice_counts(temporal.slices(cam(spark, d), 86_400_000_000))
    return render.frames(n, H, W, scale=30.0, threshold=40, radius=1)


# G of the kernel g_i g_j, the square roots of the standard normal's mass in five bins of width 0.52 round 0, summing to 1.
KERNEL = "(-2, 0.174178483500::DOUBLE), (-1, 0.212377497209), (0, 0.226888038582), (1, 0.212377497209), (2, 0.174178483500)"


@query(f"WITH {IMAGE}, g(d, w) AS (VALUES {KERNEL}), k AS (SELECT a.d AS dy, b.d AS dx, a.w * b.w AS w FROM g a, g b), b AS (SELECT i.y, i.x, sum(k.w * n.value) AS blur FROM img i, k JOIN img n ON n.y = i.y + k.dy AND n.x = i.x + k.dx GROUP BY 1, 2) SELECT i.y, i.x, round(1.3 * i.value - 0.3 * b.blur, 6) AS value FROM img i JOIN b USING (y, x)")
def fn16_unsharp(spark, d):
    return render.unsharp(image(cam(spark, d)), H, W, 0.3).select("y", "x", F.round("value", 6).alias("value"))


@query(f"WITH {IMAGE} SELECT i.y, i.x, round(sum(exp(-((n.y - i.y) ** 2 + (n.x - i.x) ** 2) / 8.0 - (n.value - i.value) ** 2 / 50.0) * n.value) / sum(exp(-((n.y - i.y) ** 2 + (n.x - i.x) ** 2) / 8.0 - (n.value - i.value) ** 2 / 50.0)), 6) AS value FROM img i JOIN img n ON (n.y - i.y) ** 2 + (n.x - i.x) ** 2 <= 4 GROUP BY 1, 2")
def fn17_bilateral(spark, d):
    return render.bilateral(image(cam(spark, d)), H, W, 5.0, 2.0).select("y", "x", F.round("value", 6).alias("value"))


@query(f"WITH {IMAGE}, g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN y - 1 < 0 THEN 1 - y WHEN y - 1 >= 30 THEN 58 - (y - 1) ELSE y - 1 END AS sy, x AS sx FROM generate_series(0, 31) a(y), generate_series(0, 39) b(x)) SELECT g.y, g.x, i.value FROM g LEFT JOIN img i ON i.y = g.sy AND i.x = g.sx")
def fn18_reflect_pad(spark, d):
    return render.reflect_pad(image(cam(spark, d)), H, W, 3).select("y", "x", "value")


@query(f"WITH {IMAGE} SELECT 29 - y AS y, 39 - x AS x, value FROM img")
def fn19_flip(spark, d):
    return render.flip(image(cam(spark, d)), H, W)


@query(f"WITH {IMAGE} SELECT y, x, CAST(floor(least(greatest(255.0 * (value - 3.0) / 9.0, 0), 255)) AS INTEGER) AS level FROM img")
def fn20_to_byte(spark, d):
    return image(cam(spark, d)).select("y", "x", representations.to_byte(F.col("value"), F.lit(3.0), F.lit(12.0)).alias("level"))


@query("SELECT c_custkey AS id, regexp_replace(c_name, '[0-9]+$', '') AS stem, split_part(c_name, '#', 2) AS number, md5(c_name) AS digest FROM customer")
def fn21_fn23_strings(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "[0-9]+$", "").alias("stem"), F.coalesce(F.get(F.split("c_name", "#"), F.lit(1)), F.lit("")).alias("number"), F.md5(F.col("c_name").cast("binary")).alias("digest"))


# --- codecs as SQL --------------------------------------------------------------------

WORDS = """li AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS i, l_partkey AS a, l_suppkey AS b, l_linenumber AS c FROM lineitem),
  words AS (SELECT i, CAST(([0, 2, 2, 3, 4, 5, 6, 8])[CAST((a + b + c) % 8 AS INTEGER) + 1] * 4096 + (a * 131 + b * 7 + c) % 4096 AS INTEGER) AS v FROM li)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    from .schema import dense_index

    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = dense_index(li, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "i")
    return rows.select("i", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("c"))


def words(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in (0, 2, 2, 3, 4, 5, 6, 8)])
    return lines(spark, d).select("i", (F.get(kinds, ((F.col("a") + F.col("b") + F.col("c")) % 8).cast("int")) * 4096 + (F.col("a") * 131 + F.col("b") * 7 + F.col("c")) % 4096).cast("int").alias("v"))


@query(f"""WITH {WORDS}, w AS (SELECT i, v, v >> 12 AS ty, v & 4095 AS pl, CASE v >> 12 WHEN 4 THEN 12 WHEN 5 THEN 8 ELSE 0 END AS wd FROM words),
  x1 AS (SELECT *, lag(pl, 1, 0) OVER (PARTITION BY ty ORDER BY i) AS pv, coalesce(sum(wd) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM w),
  x2 AS (SELECT *, CASE WHEN ty = 6 THEN pl + 4096 * sum(CAST(pl < pv AS INTEGER)) OVER (PARTITION BY ty ORDER BY i) END AS lo, CASE WHEN ty = 8 THEN pl * 4096 + 16777216 * sum(CAST(pl < pv AS INTEGER)) OVER (PARTITION BY ty ORDER BY i) END AS hi FROM x1),
  st AS (SELECT *, coalesce(last_value(lo IGNORE NULLS) OVER o, 0) + coalesce(last_value(hi IGNORE NULLS) OVER o, 0) AS t, coalesce(last_value(CASE WHEN ty = 0 THEN v & 2047 END IGNORE NULLS) OVER o, 0) AS y,
    coalesce(last_value(CASE WHEN ty = 3 THEN v & 2047 END IGNORE NULLS) OVER o, 0) AS bx, coalesce(last_value(CASE WHEN ty = 3 THEN cw END IGNORE NULLS) OVER o, 0) AS bcw, coalesce(last_value(CASE WHEN ty = 3 THEN (v & 2048) <> 0 END IGNORE NULLS) OVER o, FALSE) AS bp
    FROM x2 WINDOW o AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ev AS (SELECT i, 0 AS k, t, v & 2047 AS x, y, (v & 2048) <> 0 AS p FROM st WHERE ty = 2
    UNION ALL SELECT i, k, t, bx + cw - bcw + k AS x, y, bp AS p FROM st, generate_series(0, 11) g(k) WHERE (ty = 4 OR (ty = 5 AND k < 8)) AND (pl >> k) & 1 = 1)
  SELECT row_number() OVER (ORDER BY i, k) - 1 AS idx, CAST(t AS BIGINT) AS t_us, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, p FROM ev""")
def win03_evt3_decode(spark, d):
    return decode.evt3(words(spark, d))


@query(f"WITH {WORDS}, r AS (SELECT i, CAST(a % 240 AS INTEGER) AS x, CAST(CASE WHEN b % 10 = 0 THEN 240 ELSE b % 180 END AS INTEGER) AS y, (a + c) % 2 = 1 AS p, (c % 128) * 65536 + (a % 256) * 256 + b % 256 AS ts FROM li), o AS (SELECT *, ts + 8192 * sum(CAST(y = 240 AS INTEGER)) OVER (ORDER BY i) AS t_us FROM r) SELECT i, CAST(t_us AS BIGINT) AS t_us, x, y, p FROM o WHERE y <> 240")
def win02_bin_records(spark, d):
    n = lines(spark, d)
    b = n.select("i", (F.col("a") % 240).cast("int").alias("b0"), F.when(F.col("b") % 10 == 0, 240).otherwise(F.col("b") % 180).cast("int").alias("b1"), (((F.col("a") + F.col("c")) % 2) * 128 + F.col("c") % 128).cast("int").alias("b2"), (F.col("a") % 256).cast("int").alias("b3"), (F.col("b") % 256).cast("int").alias("b4"))
    return decode.records(b)


@query(f"WITH {CAM} SELECT idx, round(t_us / 1e6, 6) AS t, x, y, CAST(p AS INTEGER) AS p FROM cam")
def src01_text_round_trip(spark, d):
    from .sources import text

    lines_ = text.format_events(cam(spark, d))
    return text.parse_events(lines_.select("idx", "value"), rule="positive").select("idx", F.round("t", 6).alias("t"), "x", "y", F.col("p").cast("int").alias("p"))


# --- more of the same operators on other streams ---------------------------------------


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS idx, epoch_us(l_shipdate) AS t_us FROM lineitem),
  p AS (SELECT DISTINCT epoch_us(o_orderdate) + 43200000000 * (o_orderkey % 2) AS t_us FROM orders),
  b AS (SELECT p.t_us, (SELECT count(*) FROM s WHERE s.t_us < p.t_us) AS n, (SELECT max(s.t_us) FROM s WHERE s.t_us < p.t_us) AS lo, (SELECT min(s.t_us) FROM s WHERE s.t_us >= p.t_us) AS hi FROM p)
  SELECT t_us AS probe_id, t_us, CASE WHEN hi IS NULL THEN n - 1 WHEN lo IS NULL THEN n WHEN t_us - lo <= hi - t_us THEN n - 1 ELSE n END AS nearest FROM b""")
def join04_nearest_of_runs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    p = o.select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 43_200_000_000 * (F.col("o_orderkey") % 2)).alias("t_us")).distinct()
    return temporal.nearest(p.select("t_us", F.col("t_us").alias("probe_id")), srt01_dense_order(spark, d).select("idx", "t_us"), span=30 * 86_400_000_000)


@query(f"WITH {CAM}, i AS (SELECT (idx * idx) % (SELECT count(*) FROM cam) AS i FROM cam) SELECT i.i, c.t_us FROM i JOIN cam c ON c.idx = i.i")
def srt06_scattered_reads(spark, d):
    c = cam(spark, d)
    return temporal.index_to_time(c.select(((F.col("idx") * F.col("idx")) % c.count()).alias("i")), c)


@query(f"WITH {CAM}, s AS (SELECT idx, (t_us - min(t_us) OVER ()) // 3600000000 AS slice FROM cam), c AS (SELECT slice, idx, CAST(slice <> lag(slice, 1, -1) OVER (ORDER BY idx) AS INTEGER) AS turn FROM s) SELECT slice, min(idx) AS first, count(*) AS n FROM c GROUP BY slice")
def win11_slice_runs(spark, d):
    return temporal.slices(cam(spark, d), 3_600_000_000).groupBy("slice").agg(F.min("idx").alias("first"), F.count("*").alias("n"))


@query(f"WITH {FLOW}, m AS (SELECT *, sqrt(sqrt(v * v + h * h)) AS mag FROM fl) SELECT y, x, CAST(floor((atan2(h, v) + pi()) * 180 / pi() / 2) AS INTEGER) AS hue, 255 AS sat, CAST(floor(255 * mag / (SELECT max(mag) FROM m)) AS INTEGER) AS val FROM m")
def fn08_flow_view(spark, d):
    return render.flow_hsv(flow_field(cam(spark, d)), order=0.5).select("y", "x", "hue", "sat", "val")


@query(f"WITH {CAM}, c AS (SELECT x * 4 AS hue, 200 AS sat, 50 + y * 6 AS val FROM cam), k AS (SELECT *, floor(hue / 30.0) AS s, hue / 30.0 - floor(hue / 30.0) AS f, val / 255.0 AS v, sat / 255.0 AS sa FROM c), q AS (SELECT *, v * (1 - sa) AS p0, v * (1 - sa * f) AS q0, v * (1 - sa * (1 - f)) AS t0 FROM k) SELECT hue, sat, val, CAST(round_even(255 * CASE s % 6 WHEN 0 THEN v WHEN 1 THEN q0 WHEN 2 THEN p0 WHEN 3 THEN p0 WHEN 4 THEN t0 ELSE v END, 0) AS INTEGER) AS r, CAST(round_even(255 * CASE s % 6 WHEN 0 THEN t0 WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q0 ELSE p0 END, 0) AS INTEGER) AS g, CAST(round_even(255 * CASE s % 6 WHEN 0 THEN p0 WHEN 1 THEN p0 WHEN 2 THEN t0 WHEN 3 THEN v WHEN 4 THEN v ELSE q0 END, 0) AS INTEGER) AS b FROM q")
def fn09_hsv_to_rgb(spark, d):
    c = cam(spark, d).select((F.col("x") * 4).alias("hue"), F.lit(200).alias("sat"), (F.col("y") * 6 + 50).alias("val"))
    return c.select("hue", "sat", "val", *render.hsv_to_rgb(F.col("hue"), F.col("sat"), F.col("val")))


@query("SELECT event_id AS idx, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn22_json(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("idx"), F.from_json("props", "k int")["k"].alias("k"))


@query(f"WITH {CAM} SELECT idx, printf('%.9f %d %d %d', idx / 1000.0::DOUBLE, x, y, CAST(p AS INTEGER)) AS value FROM cam")
def snk03_text_lines(spark, d):
    from .sources import text

    return text.format_events(cam(spark, d), F.col("idx") / 1000.0)


@query(f"WITH {CAM} SELECT idx, t_us AS \"time\", x, y, p FROM cam")
def snk01_parquet_round_trip(spark, d):
    from .shared import place
    from .sources import cache

    path = place(spark, "snk01")
    cache.convert(cam(spark, d), path, {"t_us": "time"})
    return spark.read.parquet(path)


# --- streams --------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str, rows: Callable[[DataFrame], DataFrame] = lambda c: c, files: int = 4) -> DataFrame:
    """What a stream has made when nothing is left: the events are put into a folder of a few files in order, which is tailed a file at a time.

    Each batch of the result is a folder of Parquet files; in complete mode the last one holds all.
    """
    from .shared import place
    from .streaming import live

    folder, path, batches = place(spark, "tailed"), place(spark, "stream"), []
    events = rows(cam(spark, d)).withColumn("recording", F.lit("events")).select(*[c.split()[0] for c in live.EVENTS.split(", ")])
    n = events.count()
    for k in range(files):  # one after another, as a recording grows
        events.where((F.col("idx") >= n * k // files) & (F.col("idx") < n * (k + 1) // files)).coalesce(1).write.mode("append").parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batches.append(number)

    made = make(live.tail(spark, folder, max_files=1))
    q = made.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    held = spark.read.schema(made.schema)
    if not batches:
        return spark.createDataFrame([], made.schema)
    return held.parquet(f"{path}/batch={max(batches)}") if mode == "complete" else held.parquet(*[f"{path}/batch={n}" for n in sorted(set(batches))])


@query(f"WITH {CAM} SELECT t_us // 3600000000 * 3600000000 AS start_us, CAST(sum(CAST(p AS INTEGER)) AS BIGINT) AS \"on\", CAST(sum(CAST(NOT p AS INTEGER)) AS BIGINT) AS \"off\" FROM cam GROUP BY 1")
def str05_stream_windows(spark, d):
    from .streaming import live

    return _streamed(spark, d, lambda s: live.window_counts(s, 3_600_000_000, 1_000_000), "complete").select("start_us", "on", "off")


@query(f"WITH {LATE}, s AS (SELECT *, greatest(0, max(own) OVER (ORDER BY idx)) AS slice FROM raw) SELECT CAST(slice AS BIGINT) AS slice, y, x, CAST(sum(CAST(p AS INTEGER)) AS BIGINT) AS \"on\", CAST(sum(CAST(NOT p AS INTEGER)) AS BIGINT) AS \"off\" FROM s GROUP BY 1, 2, 3")
def str04_stream_slices(spark, d):
    from .streaming import live

    n = _streamed(spark, d, lambda s: live.slice_counts(s, 7_200_000_000), "append", shaken)
    return n.groupBy("slice", "y", "x").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))


@query(f"WITH {CAM}, s AS (SELECT (t_us - (SELECT min_by(t_us, idx) FROM cam)) // 86400000000 AS slice FROM cam), k AS (SELECT slice, row_number() OVER (ORDER BY slice) AS value FROM s GROUP BY 1) SELECT slice AS frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, value::DOUBLE AS value FROM k, generate_series(0, {H - 1}) a(y), generate_series(0, {W - 1}) b(x) WHERE slice < (SELECT max(slice) FROM s)")
def str10_stream_images(spark, d):
    """A model that counts the windows it has seen shows that its state goes on from batch to batch."""
    import numpy as np

    from .streaming import live

    def counter(grid: np.ndarray, state: object) -> tuple[np.ndarray, object]:
        seen = (state or 0) + 1
        return np.full(grid.shape[1:], float(seen)), seen

    images = _streamed(spark, d, lambda s: live.reconstructions(s, 86_400_000_000, H, W, 3, lambda: counter, encoders=1), "append")
    return images.select("frame_idx", "y", "x", "value")


@query(f"WITH {CAM}, s AS (SELECT *, (t_us - (SELECT min_by(t_us, idx) FROM cam)) // 86400000000 AS slice FROM cam) SELECT slice, y, x, CAST(sum(CAST(p AS INTEGER)) AS BIGINT) AS \"on\", CAST(sum(CAST(NOT p AS INTEGER)) AS BIGINT) AS \"off\" FROM s WHERE slice = (SELECT max(slice) FROM s) GROUP BY 1, 2, 3")
def str06_newest_slice(spark, d):
    """What a display shows last of a whole recording that came in one batch."""
    from .shared import place
    from .streaming import live

    folder, path = place(spark, "tailed"), place(spark, "shown")
    cam(spark, d).withColumn("recording", F.lit("events")).select(*[c.split()[0] for c in live.EVENTS.split(", ")]).write.parquet(folder)
    show = live.newest(live.slice_counts(live.tail(spark, folder), 86_400_000_000), lambda b: b.write.mode("overwrite").parquet(path))
    show.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("slice", "y", "x", "on", "off")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
