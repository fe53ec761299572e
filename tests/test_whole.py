import duckdb
import pytest

from luxflow import queries

D = "/root/testdata/sf0.001"
EVENTS = ["flt10_normalize_index", "set02_concat", "join02_index_to_time", "join15_sample_flow", "srt06_scattered_reads", "fn09_hsv_to_rgb"]


def size(sql):
    return duckdb.execute(sql).fetchone()[0]


@pytest.mark.parametrize("name", EVENTS)
def test_every_event_is_used(spark, name):
    assert queries.queries()[name](spark, D).count() == size(f"SELECT count(*) FROM '{D}/events.parquet'")


def test_keys_come_from_every_row():
    for name, cut in (("set03_members", "idx < 500"), ("set05_available", "c_custkey")):
        assert cut not in queries.oracle_sql()[name]


@pytest.mark.parametrize("name", ["join01_time_to_index", "join03_nearest", "join08_tolerance"])
def test_every_event_probes(spark, name):
    assert queries.queries()[name](spark, D).count() == size(f"SELECT count(*) FROM '{D}/events.parquet'")


def test_every_order_probes(spark):
    assert queries.queries()["join04_nearest_of_runs"](spark, D).count() == size(f"SELECT count(DISTINCT epoch_us(o_orderdate) + 43200000000 * (o_orderkey % 2)) FROM '{D}/orders.parquet'")


def test_dense_numbers_of_many_partitions(spark):
    """Rows equal in the first column are dealt by the next ones."""
    from pyspark.sql import functions as F

    from luxflow.schema import dense_index

    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.lit(5).alias("same"))
    got = dense_index(rows, ["same", "k"], rows=100)
    assert sorted((r.k, r.idx) for r in got.collect()) == [(i, i) for i in range(3000)]


def test_dense_recordings_spread_over_buckets(spark, monkeypatch):
    """An hour of events has as many buckets as its times need."""
    from pyspark.sql import functions as F

    from luxflow.operators import temporal

    monkeypatch.setattr(temporal, "BUCKET", 100)
    events = spark.range(5000).select(F.col("id").alias("idx"), (F.col("id") * 719_999).alias("t_us"))
    span = temporal._span(events, "t_us")
    assert events.select(F.floor(F.col("t_us") / span)).distinct().count() >= 50
    probes = spark.range(700).select(F.col("id").alias("probe_id"), (F.col("id") * 5_000_011 - 1_000_000).alias("t_us"), F.lit("kept").alias("note"))
    times = [r.t_us for r in events.orderBy("idx").collect()]
    import bisect

    for strict, side in ((True, bisect.bisect_left), (False, bisect.bisect_right)):
        got = temporal.as_of(probes, events, strict=strict, around=True).collect()
        assert len(got) == 700
        for r in got:
            at = side(times, r.t_us) - 1
            assert (r.at, r.t_left, r.t_right, r.note) == (at, times[at] if at >= 0 else None, times[at + 1] if at + 1 < len(times) else None, "kept")


def test_frames_by_broadcast_and_by_join_agree(spark):
    from pyspark.sql import functions as F

    from luxflow.operators import temporal

    events = spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") % 9000).alias("t_us"))
    frames = spark.createDataFrame([(i, t) for i, t in enumerate([100, 100, 250, 251, 4000, 8000])], "frame_idx long, t_us long")
    ordered = events.orderBy("t_us", "idx").collect()
    dense = spark.createDataFrame([(i, r.t_us) for i, r in enumerate(ordered)], "idx long, t_us long")
    few, many = (sorted((r.idx, r.frame_idx) for r in temporal.in_frames(dense, frames, limit).collect()) for limit in (10, 3))
    assert few == many and len(few) == sum(r.t_us < 8000 for r in ordered)
    assert temporal.in_frames(dense, frames.limit(0)).count() == 0


def test_many_probes_of_few_events_spread_over_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from luxflow.operators import temporal

    monkeypatch.setattr(temporal, "BUCKET", 100)
    events = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * 1000).alias("t_us"))
    probes = spark.range(5000).select(F.col("id").alias("probe_id"), F.when(F.col("id") > 0, F.col("id") * 4).otherwise(1 << 60).alias("t_us"))
    spans, step = [], temporal._span
    monkeypatch.setattr(temporal, "_span", lambda *a: spans.append(step(*a)) or spans[-1])
    got = temporal.as_of(probes, events, strict=False, around=True).collect()
    most = probes.groupBy(F.floor(F.col("t_us") / spans[0])).count().agg(F.max("count")).first()[0]
    assert most <= 150
    for r in got:
        at = min(r.t_us // 1000, 19)
        assert (r.at, r.t_left, r.t_right) == (at, at * 1000, (at + 1) * 1000 if at < 19 else None)
    assert len(got) == 5000
