"""Pools: grid, composition, split, invariants, files, triage."""

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anomalypool.config import PoolConfig, SamplerConfig
from anomalypool.operators import chunks, compose, explore, order, profile, validate
from anomalypool.plans import agent, real_pool, synthetic_pool
from anomalypool.sources import pools, raw
from anomalypool.streaming import replay

CONFIG = SamplerConfig(split_threshold=300, base_chunk=100, min_length=50, pool_size=40, recording_share=0.2, stats_tolerance=2.0, period_range=(5, 40))


def rank(*parts):
    return zlib.crc32("|".join(map(str, parts)).encode())


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = np.random.default_rng(1), []
    for r in range(12):
        n = 250 if r % 3 == 0 else 1000 + 37 * r
        y = np.zeros(n, int)
        y[rng.integers(0, n, 4)] = 1
        rows.append(pd.DataFrame({"dataset": "D", "recording": f"m{r // 2}_col_{r}", "pos": range(n), "value": rng.normal(size=n) + 8 * y, "label": y}))
    return spark.createDataFrame(pd.concat(rows), "dataset string, recording string, pos bigint, value double, label tinyint").repartition(5)


def test_positions(spark):
    df = spark.createDataFrame([(k, i * 7 % 101) for k in "ab" for i in range(101)] + [("c", 5)], "k string, x int").repartition(6)
    got = order.with_positions(df, "k", [F.col("x")]).toPandas()
    assert (got.sort_values(["k", "x"]).groupby("k").cumcount() == got.sort_values(["k", "x"]).pos).all()


def test_grid_does_not_see_labels(points):
    flipped = points.withColumn("label", (1 - F.col("label")).cast("tinyint"))
    shape = lambda p: p.select("recording", "slot", "start", "length").orderBy("recording", "slot").collect()
    a = shape(chunks.chunk_grid(points, CONFIG))
    assert a == shape(chunks.chunk_grid(flipped, CONFIG))
    assert all(x["length"] >= 50 for x in a)


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 9), min_size=1, max_size=8), st.integers(0, 40))
@settings(max_examples=8, deadline=None)
def test_waterfill_is_even(spark, avail, target):
    rows = [("D", r, f"{r}-{i}", 1) for r, n in avail.items() for i in range(n)]
    samples = spark.createDataFrame(rows, "dataset string, recording string, series_id string, y_i int")
    kept = compose.waterfill(compose.hash_order(samples, 42, ["dataset", "recording"]), target, 42, ["dataset", "recording"]).toPandas()
    assert len(kept) == min(target, sum(avail.values()))
    got = kept.groupby("recording").size().to_dict()
    open_ = [got.get(r, 0) for r, n in avail.items() if got.get(r, 0) < n]
    assert not open_ or max(got.values(), default=0) - min(open_) <= 1
    for r, n in got.items():
        best = sorted((f"{r}-{i}" for i in range(avail[r])), key=lambda s: (rank(42, "pick", s), s))[:n]
        assert sorted(kept[kept.recording == r].series_id) == sorted(best)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=7), st.sampled_from([None, 0.25, 0.5]), st.sampled_from([None, 0.3, 0.6]))
@settings(max_examples=60, deadline=None)
def test_plan_is_feasible(counts, rate, share):
    plan = compose.plan_pool(counts, SamplerConfig(pool_size=20, positive_rate=rate, recording_share=share))
    top = plan.ceiling or 10**9
    assert plan.size <= 20
    if rate is None:
        assert sum(min(a + b, top) for a, b in counts) >= plan.size
    else:
        assert sum(min(b, top) for _, b in counts) >= plan.positives and sum(min(a, top) for a, _ in counts) >= plan.size - plan.positives


def test_split_keeps_machines_whole_and_near_the_goal(spark):
    kind = "dataset string, machine string, n_samples bigint, n_positives bigint"

    def split(counts):
        found = compose.split_machines(spark.createDataFrame([(*k, *v) for k, v in counts.items()], kind), "R", 0.3, 42).collect()
        assert len(found) == len(counts)
        return {(r["dataset"], r["machine"]): r["side"] for r in found}

    counts = {("D", f"m{i}"): (10 + i, 2 + i % 3) for i in range(20)}
    side = split(counts)
    dev = np.sum([counts[k] for k in counts if side[k] == "dev"], axis=0)
    assert np.allclose(dev / np.sum(list(counts.values()), axis=0), 0.3, atol=0.02)
    assert side == split(dict(reversed(counts.items())))
    assert set(split({("D", "a"): (1, 0), ("D", "b"): (1, 0)}).values()) == {"dev", "test"}
    assert set(split({("D", "a"): (1, 0)}).values()) <= {"dev", "test"}


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 9), st.integers(1, 50)), min_size=1, max_size=40, unique_by=lambda c: c[:2]), st.floats(0.05, 0.95))
@settings(max_examples=80, deadline=None)
def test_dev_quotas(classes, fraction):
    quotas = compose.dev_quotas(classes, fraction)
    assert all(0 <= q <= m for q, (_, _, m) in zip(quotas, classes))
    machines = sum(m for _, _, m in classes)
    assert machines < 2 or 0 < sum(quotas) < machines
    if machines > 2:
        goal = fraction * sum(n * m for n, _, m in classes)
        assert abs(sum(n * q for (n, _, _), q in zip(classes, quotas)) - goal) <= max(n for n, _, _ in classes) + goal * 0.2


@pytest.mark.parametrize("legacy", [False, True])
def test_pool_from_recordings(spark, points, tmp_path, legacy):
    config = SamplerConfig(**{**CONFIG.__dict__, "legacy": legacy, "legacy_chunk_max": 200})
    pool = real_pool.build(points, "R1", config)
    real_pool.publish(pool, f"file://{tmp_path}", "R1", config)
    data, meta = (x.toPandas() for x in pools.load_pool(spark, f"file://{tmp_path}", "R1"))
    assert len(meta) and set(meta.series_id) == set(data.series_id) and meta.series_id.str.startswith("R1__D__m").all()
    assert (data.groupby("series_id").size() == meta.set_index("series_id").length.sort_index()).all()
    assert json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/R1_manifest.json").collect()))["final_samples"] == len(meta)
    if not legacy:
        assert set(meta.split) <= {"dev", "test"}


def test_rows_of_a_key_come_together_and_in_order(spark):
    """Keys over several batches and tasks, and null ones."""
    made = {("D", "a"): 25_000, ("D", "b"): 3, ("E", "a"): 11_000, ("E", None): 7, (None, "a"): 5}
    rows = pd.DataFrame([(*k, i, float(i)) for k, n in made.items() for i in range(n)], columns=["dataset", "recording", "pos", "value"])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1).astype(object).where(rows.notna(), None), "dataset string, recording string, pos long, value double").repartition(7)

    def kernel(key, pos, value):
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.string()), pa.array([len(pos)]), pa.array([bool((pos == np.arange(len(pos))).all() and (value == pos).all())])], names=["d", "r", "n", "ordered"])

    names = df.select("dataset", "recording").distinct()
    joined = df.join(names.hint("shuffle_merge"), df.dataset.eqNullSafe(names.dataset) & df.recording.eqNullSafe(names.recording)).select(df["*"])
    for points in (df, joined):
        got = order.by_key(points, ["dataset", "recording"], ["pos"], ["pos", "value"], kernel, "d string, r string, n long, ordered boolean").collect()
        assert {(x["d"], x["r"]): x["n"] for x in got} == made and len(got) == len(made) and all(x["ordered"] for x in got)


def test_samples_of_the_older_way_leave_in_parts(points, monkeypatch):
    config = SamplerConfig(**{**CONFIG.__dict__, "legacy": True, "legacy_chunk_max": 200})
    made = []
    for size in (real_pool.POSITIONS, 1):
        monkeypatch.setattr(real_pool, "POSITIONS", size)
        made.append(sorted(real_pool.legacy_samples(points, config).collect()))
    assert made[0] == made[1] and all(len(r["positions"]) == r["length"] for r in made[0]) and len(made[0]) > 12


BREAKS = {
    "unique_series": lambda p, m: (p, m.union(m.limit(1))), "finite_values": lambda p, m: (p.withColumn("value", F.when(F.col("time_index") == 1, float("inf")).otherwise(F.col("value"))), m),
    "binary_labels": lambda p, m: (p.withColumn("label", F.when(F.col("time_index") == 1, 2).otherwise(F.col("label")).cast("tinyint")), m), "metadata_has_data": lambda p, m: (p.filter("series_id <> 'a'"), m),
    "data_has_metadata": lambda p, m: (p, m.filter("series_id <> 'a'")), "length_matches": lambda p, m: (p, m.withColumn("length", F.col("length") + 1)), "anomalies_match": lambda p, m: (p, m.withColumn("num_point_anomalies", F.lit(7))),
    "label_matches": lambda p, m: (p, m.withColumn("y_i", 1 - F.col("y_i"))), "contiguous": lambda p, m: (p.withColumn("time_index", F.col("time_index") + 1), m), "known_split": lambda p, m: (p, m.withColumn("split", F.lit("x"))),
    "length_bounds": lambda p, m: (p.filter("time_index < 2"), m), "anomaly_budget": lambda p, m: (p.withColumn("label", F.lit(1).cast("tinyint")), m),
}


@pytest.mark.parametrize("check", sorted(BREAKS))
def test_each_invariant_fires(spark, check):
    p = spark.createDataFrame([(s, i, 0.5, int(i == 3 and s == "a")) for s in "ab" for i in range(5)], "series_id string, time_index bigint, value double, label tinyint")
    m = spark.createDataFrame([("a", 5, 1, 1, "dev"), ("b", 5, 0, 0, "test")], "series_id string, length bigint, num_point_anomalies bigint, y_i int, split string")
    limits = {"lengths": (3, 9), "max_ratio": 0.5}
    validate.validate(p, m, **limits)
    with pytest.raises(validate.PoolError, match=check):
        validate.validate(*BREAKS[check](p, m), **limits)


def test_legacy_pools_are_held_to_a_cap_for_each_row(spark, tmp_path):
    config = SamplerConfig(legacy=True, min_length=3, base_chunk=5, legacy_chunk_max=5)
    p = spark.createDataFrame([(s, i, 0.5, int(i < 2)) for s in "ab" for i in range(10)], "series_id string, time_index bigint, value double, label tinyint")
    m = spark.createDataFrame([("a", 10, 2, 1, "period=5;whole_series", 0.2), ("b", 10, 2, 1, None, 0.2)], "series_id string, length bigint, num_point_anomalies bigint, y_i int, source_notes string, anomaly_ratio double")
    pool = lambda *ids: {k: x.filter(F.col("series_id").isin(*ids)) for k, x in (("points", p), ("metadata", m), ("full_points", p), ("full_metadata", m))} | {"stats": {}}
    with pytest.raises(validate.PoolError, match="'anomaly_budget': 1"):
        real_pool.publish(pool("a", "b"), f"file://{tmp_path}", "R", config)
    assert not any(tmp_path.iterdir())
    real_pool.publish(pool("a"), f"file://{tmp_path}", "R", config)


def test_schema_is_checked(spark):
    p = spark.createDataFrame([("a", 0, 1.0, 0)], "series_id string, time_index int, value double, label tinyint")
    with pytest.raises(validate.PoolError):
        validate.check_schema(p, p)


def test_raw_files(spark, tmp_path):
    d = tmp_path / "SET"
    d.mkdir()
    (d / "a_col_1.csv").write_text(" Data ,LABEL\n,1\n1,0\nx,2\n3,\n")
    (d / "b.csv").write_text("value\n1\n")
    (d / "c.csv").write_text("")
    pd.DataFrame({"value": [None, 2.0], "data": [9.0, 9.0], "label": [0, -1]}).to_parquet(d / "d.parquet")
    (d / "e.parquet").write_bytes(b"no parquet")
    got = raw.raw_points(spark, f"file://{tmp_path}").orderBy("recording", "pos").toPandas()
    assert got.values.tolist() == [["SET", "a_col_1", 0, 1.0, 0], ["SET", "a_col_1", 1, 1.0, 1], ["SET", "a_col_1", 2, 3.0, 0], ["SET", "d", 0, 2.0, 0]]
    assert raw.raw_points(spark, f"file://{tmp_path}/nowhere").count() == 0
    assert raw.view(raw.raw_points(spark, f"file://{tmp_path}"), "a_col_1", 1, 3).count() == 2


def test_synthetic_pool_and_triage(spark, tmp_path):
    config = PoolConfig.of("S1", num_series=60, length_range=(300, 500), anomaly_rate=0.3)
    p, m = synthetic_pool.build(spark, config)
    synthetic_pool.publish(p, m, config, f"file://{tmp_path}")
    one = synthetic_pool.series(spark, config, 1).orderBy("series_id").collect()
    assert one == synthetic_pool.series(spark, config, 7).orderBy("series_id").collect()
    found = agent.triage(p, budget=100)
    agent.write_run(found, f"file://{tmp_path}/run")
    scores = agent.evaluate(found)
    assert scores["deep_calls"] == 6 and scores["cheap_calls"] == 60 and scores["auroc"] > 0.5 and scores["seconds"] > 0
    read = lambda name: "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/run/{name}").collect())
    assert json.loads(read("metrics.json")) == pytest.approx(scores) and "| deep_calls | 6 |" in read("summary.md")
    assert found["ranked_list"].count() == 60 and found["decision_trace"].count() == 6


def test_stream_of_events(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "a", float(i)) for i in range(9)], "event_id bigint, t string, event_type string, value double")
    rows.select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/in")
    query = replay.windowed(replay.events_stream(spark, f"{tmp_path}/in"), late="1 minute").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["start"].hour: r["n"] for r in spark.table("windows").collect()}
    assert got.items() <= {0: 3, 1: 3, 2: 3}.items() and 0 in got


def test_rolling_repeats_the_ends(spark):
    """By numpy, on recordings shorter than the window, of several blocks, and with a column that clashes with none of its own."""
    rng = np.random.default_rng(5)
    made = {f"r{n}": rng.normal(size=n) for n in (1, 2, 5, 11, 37)}
    rows = [(k, i, float(v), "x") for k, x in made.items() for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "recording string, pos bigint, value double, block string")
    for what, of in (("avg", np.mean), ("median", np.median)):
        got = {(r["recording"], r["pos"]): r["m"] for r in profile.rolling(points, 3, what, "m", block=8).collect()}
        near = {k: np.lib.stride_tricks.sliding_window_view(np.pad(x, 3, mode="edge"), 7) for k, x in made.items()}
        assert got == pytest.approx({(k, i): of(w) for k, ws in near.items() for i, w in enumerate(ws)})
    assert profile.rolling(points.limit(0), 3, "avg", "m").columns == [*points.columns, "m"]


def test_binary_rounding_is_that_of_python(spark):
    from anomalypool.functions import scalars

    rng = np.random.default_rng(2)
    xs = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.5, 1.5, 2.5, 0.0, 1e300, *rng.normal(scale=100, size=300).tolist(), *(i / 8 for i in range(-40, 40)), *(i * 0.005 for i in range(400))]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 3, 6):
        got = rows.select("x", scalars.round_binary(F.col("x"), digits).alias("r")).collect()
        assert [r["r"] for r in got] == [round(r["x"], digits) for r in got]


def test_points_keep_their_rows_without_metadata(spark):
    points = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "series_id string, time_index bigint, value double")
    metadata = spark.createDataFrame([("a", 7.0, "t")], "series_id string, value double, base_type string")
    assert sorted(map(tuple, explore.described(points, metadata).collect())) == [("a", 0, 1.0, "t"), ("b", 0, 2.0, None)]
    assert [r[0] for r in explore.head(points, 1, ("value",)).collect()] == ["a"]
