"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PoolConfig, SamplerConfig
from ..functions import scalars
from ..operators import chunks, cleaning, compose, explore, metrics, profile, runs, scan, validate
from ..sources import pools, raw, tables
from ..sources.scratch import folder, written
from ..streaming import replay
from . import agent, real_pool, synthetic_pool

#: Settings that let tables of this size show every branch.
KNOBS = SamplerConfig(split_threshold=5_000, base_chunk=500, min_length=400, max_anomaly_ratio=0.004, stats_tolerance=0.05, pool_size=60, recording_share=None)
COMPOSE = SamplerConfig(pool_size=2_000, recording_share=0.01)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EVENTS = """points AS (SELECT event_type AS recording, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value,
  CAST(value > quantile_cont(value, 0.998::DOUBLE) OVER (PARTITION BY event_type) AS INT) AS label FROM events)"""
_PRICES = """raw AS (SELECT l_returnflag AS recording, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  l_extendedprice AS value FROM lineitem),
limits AS (SELECT recording AS lr, quantile_cont(value, 0.998::DOUBLE) AS lim FROM raw GROUP BY 1),
points AS (SELECT recording, pos, value, CAST(value > lim AS INT) AS label FROM raw JOIN limits ON recording = lr)"""
_DAILY = """daily AS (SELECT l_returnflag AS recording, CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS value FROM lineitem GROUP BY 1, 2),
points AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY day) - 1 AS pos, value FROM daily)"""
#: Each point with the 2 * half + 1 around it, positions beyond an end held to it.
_NEAR = """ends AS (SELECT recording AS er, max(pos) AS last FROM points GROUP BY 1),
near AS (SELECT p.recording, p.pos, p.value, q.value AS near FROM points p JOIN ends ON er = p.recording CROSS JOIN (SELECT unnest(range(-{half}, {half} + 1)) AS k) JOIN points q ON q.recording = p.recording AND q.pos = least(greatest(p.pos + k, 0), last))"""
_REFERENCE = """med AS (SELECT recording AS mr, median(value) AS m FROM points GROUP BY 1),
mads AS (SELECT mr, any_value(m) AS m, median(abs(value - m)) * 1.4826::DOUBLE AS s FROM points JOIN med ON recording = mr GROUP BY 1),
held AS (SELECT recording, CASE WHEN s > 1e-10 THEN least(greatest(value, m - 5 * s), m + 5 * s) ELSE value END AS v FROM points JOIN mads ON recording = mr),
reference AS (SELECT recording AS rr, avg(v) AS ref_mean, stddev_pop(v) AS ref_std FROM held GROUP BY 1)"""
_SLOTS = """lens AS (SELECT recording AS nr, count(*) AS n FROM points GROUP BY 1),
slots AS (SELECT recording, pos // (CASE WHEN n <= 5000 THEN n ELSE 500 END) AS slot, any_value(n) AS original_length, min(pos) AS start, count(*) AS length, sum(label) AS num_point_anomalies,
  max(label) AS y_i, avg(value) AS mean, stddev_pop(value) AS std FROM points JOIN lens ON recording = nr GROUP BY 1, 2 HAVING count(*) >= 400)"""
_JUDGED = """judged AS (SELECT *, CASE WHEN y_i = 0 AND NOT (abs(mean - ref_mean) <= 0.05::DOUBLE * ref_std AND abs(std - ref_std) <= 0.05::DOUBLE * ref_std) THEN 'representativeness'
  WHEN num_point_anomalies / length::DOUBLE > 0.004::DOUBLE THEN 'budget' END AS reject_reason FROM slots JOIN reference ON recording = rr)"""
_META = """kept AS (SELECT *, 'R__lineitem__' || recording || '_' || CASE WHEN original_length <= 5000 THEN 'full' ELSE 'chunk' || slot END AS series_id,
  num_point_anomalies / length::DOUBLE AS anomaly_ratio FROM judged WHERE reject_reason IS NULL)"""
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({k}, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295::BIGINT) / 4294967296.0::DOUBLE)"""
_SAMPLES = """samples AS (SELECT o_custkey::VARCHAR AS recording, 'm' || (o_custkey % 97) AS machine, 'R__orders__' || o_custkey || '_chunk' || o_orderkey AS series_id,
  CAST(o_orderpriority = '1-URGENT' AS INT) AS y_i, o_orderkey FROM orders)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price series, written, for queries that go over them more than once."""
    return written(tables.price_series(spark, sf_dir), "prices")


def _price_slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = _prices(spark, sf_dir)
    return points, chunks.judged(chunks.chunk_grid(points, KNOBS), profile.robust_reference(points), KNOBS)


def _price_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.samples(_prices(spark, sf_dir), KNOBS, "R", F.lit("lineitem"))


@query(f"WITH {_EVENTS} SELECT recording, pos, value, label FROM points")
def ingest_pool(spark, sf_dir):
    return tables.event_series(spark, sf_dir).withColumn("label", F.col("label").cast("int"))


@query("""WITH t AS (SELECT event_type AS recording, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, value FROM events),
f AS (SELECT recording, p, last_value(CASE WHEN p % 7 >= 2 THEN value END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY p ROWS UNBOUNDED PRECEDING) AS value FROM t)
SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY p) - 1 AS pos, value FROM f WHERE value IS NOT NULL""")
def ffill_gaps(spark, sf_dir):
    points = tables.event_series(spark, sf_dir)
    holes = points.withColumn("value", F.when(F.col("pos") % 7 >= 2, F.col("value").cast("string")).otherwise(F.lit("no number"))).withColumn("label", F.lit("1"))
    return cleaning.cleaned(holes).select("recording", "pos", "value")


@query(f"""WITH {_EVENTS} SELECT recording, count(*) AS length, sum(label) AS n_anomalies, max(label) AS y_i, round(avg(label), 6) AS ratio, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
round(quantile_cont(value, 0.001::DOUBLE), 6) AS q001, round(median(value), 6) AS median, round(quantile_cont(value, 0.995::DOUBLE), 6) AS q995, round(quantile_cont(value, 0.999::DOUBLE), 6) AS q999 FROM points GROUP BY 1""")
def series_profile(spark, sf_dir):
    p = profile.series_profile(tables.event_series(spark, sf_dir))
    return _rounded(_rounded(p, "ratio", "q001", "median", "q995", "q999", digits=6), "mean", "std")


@query(f"WITH {_PRICES}, med AS (SELECT recording AS mr, median(value) AS m FROM points GROUP BY 1) SELECT recording, round(any_value(m), 4) AS median, round(median(abs(value - m)) * 1.4826::DOUBLE, 4) AS mad_sigma FROM points JOIN med ON recording = mr GROUP BY 1")
def mad_sigma(spark, sf_dir):
    return _rounded(profile.mad_sigma(_prices(spark, sf_dir)), "median", "mad_sigma")


@query(f"WITH {_EVENTS}, {_REFERENCE} SELECT rr AS recording, round(ref_mean, 4) AS ref_mean, round(ref_std, 4) AS ref_std FROM reference")
def robust_reference(spark, sf_dir):
    return _rounded(profile.robust_reference(tables.event_series(spark, sf_dir)), "ref_mean", "ref_std")


@query(f"""WITH {_EVENTS}, d AS (SELECT recording, value - lag(value) OVER (PARTITION BY recording ORDER BY pos) AS diff FROM points),
m AS (SELECT recording AS mr, median(diff) AS m, stddev_pop(diff) AS sd FROM d GROUP BY 1)
SELECT recording, round(median(abs(diff - m)) * 1.4826::DOUBLE / sqrt(2.0::DOUBLE), 4) AS local_scale, round(any_value(sd) / sqrt(2.0::DOUBLE), 4) AS robust_sd FROM d JOIN m ON recording = mr GROUP BY 1""")
def local_scale(spark, sf_dir):
    return _rounded(profile.local_scale(tables.event_series(spark, sf_dir)), "local_scale", "robust_sd")


@query(f"WITH {_DAILY} SELECT recording, round(regr_slope(value, pos::DOUBLE), 4) AS slope, round(regr_intercept(value, pos::DOUBLE), 2) AS intercept FROM points GROUP BY 1")
def linear_detrend(spark, sf_dir):
    return _rounded(_rounded(profile.line_fit(tables.daily_series(spark, sf_dir)), "slope"), "intercept", digits=2)


@query(f"""WITH {_DAILY}, fit AS (SELECT recording AS fr, regr_slope(value, pos::DOUBLE) AS s, regr_intercept(value, pos::DOUBLE) AS i FROM points GROUP BY 1),
r AS (SELECT recording, pos, value - (s * pos + i) AS v FROM points JOIN fit ON recording = fr), d AS (SELECT recording, abs(v - lag(v, 30) OVER (PARTITION BY recording ORDER BY pos)) AS d FROM r)
SELECT recording, round(quantile_cont(d, 0.995::DOUBLE), 2) AS wander FROM d GROUP BY 1""")
def baseline_wander(spark, sf_dir):
    return _rounded(profile.baseline_wander(tables.daily_series(spark, sf_dir), 30), "wander", digits=2)


@query(f"""WITH {_DAILY}, {_NEAR.format(half=50)}, b AS (SELECT recording, any_value(value) - median(near) AS r FROM near GROUP BY recording, pos),
m AS (SELECT recording AS mr, median(r) AS m FROM b GROUP BY 1), q AS (SELECT recording, median(abs(r - m)) * 1.4826::DOUBLE AS s, quantile_cont(abs(r - m), 0.995::DOUBLE) AS a, quantile_cont(abs(r - m), 0.999::DOUBLE) AS z FROM b JOIN m ON recording = mr GROUP BY 1)
SELECT recording, round(s, 2) AS sigma_vis, round(greatest(a, s * 1.2::DOUBLE), 2) AS reach, round(z - a, 2) AS tail_step FROM q""")
def rolling_median_profile(spark, sf_dir):
    return _rounded(profile.visual_profile(tables.daily_series(spark, sf_dir)), "sigma_vis", "reach", "tail_step", digits=2)


@query(f"WITH {_DAILY}, {_NEAR.format(half=10)} SELECT recording, pos, round(avg(near), 2) AS level FROM near GROUP BY 1, 2")
def moving_average(spark, sf_dir):
    return _rounded(profile.rolling(tables.daily_series(spark, sf_dir), 10, "avg", "level"), "level", digits=2).select("recording", "pos", "level")


@query(f"""WITH {_DAILY}, r AS (SELECT recording, pos, sqrt(avg(value * value) OVER w) AS rms, count(*) OVER w AS n FROM points WINDOW w AS (PARTITION BY recording ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT recording, pos, round(rms, 2) AS rms FROM r WHERE n = 30""")
def rolling_rms(spark, sf_dir):
    return _rounded(profile.rolling_rms(tables.daily_series(spark, sf_dir), 30), "rms", digits=2).select("recording", "pos", "rms")


_ACF = f"""WITH {_DAILY}, s AS (SELECT recording AS sr, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM points GROUP BY 1), c AS (SELECT recording, pos, value - m AS x, v, n FROM points JOIN s ON recording = sr),
acf AS (SELECT a.recording, b.pos - a.pos AS lag, sum(a.x * b.x) / any_value(a.v) / (any_value(a.n) - (b.pos - a.pos)) AS acf FROM c a JOIN c b ON a.recording = b.recording AND b.pos > a.pos AND b.pos <= a.pos + 40 GROUP BY 1, 2)"""


@query(_ACF + " SELECT recording, lag, round(acf, 6) AS acf FROM acf")
def acf_bounded(spark, sf_dir):
    return _rounded(profile.autocorrelation(tables.daily_series(spark, sf_dir), 40), "acf", digits=6)


@query(_ACF + """, n AS (SELECT recording, lag, acf, lag(acf) OVER w AS b, lead(acf) OVER w AS a FROM acf WINDOW w AS (PARTITION BY recording ORDER BY lag))
SELECT recording, lag, round(acf, 6) AS acf FROM n WHERE acf > a AND acf > b AND acf > 0.01::DOUBLE""")
def acf_peaks(spark, sf_dir):
    return _rounded(profile.peaks(profile.autocorrelation(tables.daily_series(spark, sf_dir), 40), 0.01), "acf", digits=6)


@query(f"WITH {_DAILY}, l AS (SELECT recording, value, lag(value, 7) OVER (PARTITION BY recording ORDER BY pos) AS b FROM points) SELECT recording, round(corr(value, b), 6) AS corr FROM l GROUP BY 1")
def lag_corr(spark, sf_dir):
    return _rounded(profile.lag_correlation(tables.daily_series(spark, sf_dir), 7), "corr", digits=6)


@query(f"WITH {_PRICES}, {_SLOTS} SELECT recording, slot, start, length, num_point_anomalies, y_i, round(mean, 4) AS mean, round(std, 4) AS std FROM slots")
def chunk_grid(spark, sf_dir):
    g = chunks.chunk_grid(_prices(spark, sf_dir), KNOBS)
    return _rounded(g.select("recording", "slot", "start", "length", "num_point_anomalies", "y_i", "mean", "std"), "mean", "std")


@query(f"WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED} SELECT recording, slot, y_i, reject_reason FROM judged")
def budget_and_screen(spark, sf_dir):
    return _price_slots(spark, sf_dir)[1].select("recording", "slot", "y_i", "reject_reason")


@query(f"WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED} SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def reject_summary(spark, sf_dir):
    return _price_slots(spark, sf_dir)[1].groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_GAPS = "n AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= {gap} THEN 0 ELSE 1 END AS new FROM points WHERE label = {label} WINDOW w AS (PARTITION BY recording ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY pos) AS island FROM n)"


@query(f"WITH {_PRICES}, {_GAPS.format(gap=100, label=1)} SELECT recording, island AS cluster, min(pos) AS start, max(pos) + 1 AS \"end\", count(*) AS n_points FROM i GROUP BY 1, 2")
def anomaly_clusters(spark, sf_dir):
    return runs.anomaly_clusters(tables.price_series(spark, sf_dir))


@query(f"""WITH {_PRICES}, {_GAPS.format(gap=1, label=0)}, p AS (SELECT *, (pos - min(pos) OVER (PARTITION BY recording, island)) // 700 AS piece FROM i)
SELECT recording, island AS run, piece, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n_points FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 400""")
def clean_runs(spark, sf_dir):
    return runs.clean_runs(tables.price_series(spark, sf_dir), 400, 700)


@query("""WITH points AS (SELECT event_type AS recording, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, floor(value / 20) AS value FROM events),
n AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY recording ORDER BY pos) THEN 0 ELSE 1 END AS new FROM points), i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY pos) AS run FROM n)
SELECT recording, run, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n_points FROM i GROUP BY 1, 2 HAVING count(*) >= 5""")
def flat_runs(spark, sf_dir):
    return runs.flat_runs(tables.event_series(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20)), 5)


@query(f"""WITH {_PRICES}, r AS (SELECT recording, pos + 1 AS k, sum(label) OVER (PARTITION BY recording ORDER BY pos) / (pos + 1)::DOUBLE AS r FROM points)
SELECT recording, coalesce(min(CASE WHEN k > 300 AND r <= 0.001::DOUBLE THEN k END), min(CASE WHEN k > 300 AND r <= 0.002::DOUBLE THEN k END), 300) AS "end" FROM r GROUP BY 1""")
def dilution_point(spark, sf_dir):
    return runs.dilution_point(tables.price_series(spark, sf_dir), 300, 0.001, 0.002)


_SEGMENTS = f"""WITH {_EVENTS}, {_GAPS.format(gap=100, label=1)}, segs AS (SELECT recording AS sr, min(pos) AS s, max(pos) + 1 AS e FROM i GROUP BY recording, island)"""


@query(_SEGMENTS + " SELECT recording, pos, CAST(EXISTS (SELECT 1 FROM segs WHERE sr = recording AND s <= pos AND pos < e) AS INT) AS in_segment FROM points")
def segments_label_join(spark, sf_dir):
    points = tables.event_series(spark, sf_dir)
    return runs.segment_labels(points, runs.anomaly_clusters(points)).select("recording", "pos", "in_segment")


@query(_SEGMENTS + ", o AS (SELECT *, max(e) OVER (PARTITION BY sr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM segs) SELECT sr AS recording, s AS start, e AS \"end\" FROM o WHERE s < last + 150")
def segment_gap_check(spark, sf_dir):
    clusters = runs.anomaly_clusters(tables.event_series(spark, sf_dir))
    return runs.crowded_segments(clusters, 150).select("recording", "start", "end")


@query(f"SELECT o_orderkey, {_CRC.format(k=chr(39) + '42|pick|' + chr(39) + ' || o_orderkey')} AS r FROM orders")
def stable_rank(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.stable_rank(42, "pick", F.col("o_orderkey")).alias("r"))


@query(f"SELECT c_custkey, CASE WHEN {_CRC.format(k=chr(39) + '42|split|' + chr(39) + ' || c_custkey')} < 0.3::DOUBLE THEN 'dev' ELSE 'test' END AS side FROM customer")
def hash_split(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").select("c_custkey", scalars.hash_side(0.3, 42, "split", F.col("c_custkey")).alias("side"))


_PICK = f"{_SAMPLES}, picked AS (SELECT *, row_number() OVER (PARTITION BY recording, y_i ORDER BY {_CRC.format(k=chr(39) + '42|pick|' + chr(39) + ' || series_id')}, series_id) AS pick FROM samples)"
_FILL = _CRC.format(k="'42|fill|orders|' || recording")


@query(f"WITH {_PICK} SELECT series_id, pick FROM picked WHERE pick <= 3")
def hash_pick_topk(spark, sf_dir):
    return compose.hash_order(tables.order_samples(spark, sf_dir), 42, ["dataset", "recording"]).filter("pick <= 3").select("series_id", "pick")


@query(f"WITH {_PICK} SELECT series_id, pick FROM picked WHERE y_i = 1 ORDER BY pick, {_FILL}, recording LIMIT 1700")
def waterfill(spark, sf_dir):
    key = ["dataset", "recording"]
    ordered = compose.hash_order(tables.order_samples(spark, sf_dir), 42, key).filter("y_i = 1")
    return compose.waterfill(ordered, 1700, 42, key).select("series_id", "pick")


@query(f"""WITH {_PICK}, p AS (SELECT * FROM picked WHERE y_i = 1 ORDER BY pick, {_FILL}, recording LIMIT 500), t AS (SELECT recording AS tr, count(*) AS n FROM p GROUP BY 1),
q AS (SELECT picked.* FROM picked LEFT JOIN t ON recording = tr WHERE y_i = 0 AND pick <= 20 - coalesce(n, 0) ORDER BY pick, {_FILL}, recording LIMIT 1500)
SELECT series_id, y_i FROM p UNION ALL SELECT series_id, y_i FROM q""")
def waterfill_pos_neg(spark, sf_dir):
    return compose.compose(tables.order_samples(spark, sf_dir), COMPOSE, ["dataset", "recording"])[0].select("series_id", "y_i")


@query(f"WITH {_SAMPLES} SELECT recording, count(*) AS n_samples, sum(y_i) AS n_positives FROM samples GROUP BY 1")
def recording_stats(spark, sf_dir):
    return tables.order_samples(spark, sf_dir).groupBy("recording").agg(F.count("*").alias("n_samples"), F.sum("y_i").alias("n_positives"))


@query(f"WITH {_SAMPLES} SELECT 'orders' AS dataset, machine, count(*) AS n_samples, sum(y_i) AS n_positives FROM samples GROUP BY 2")
def machine_counts(spark, sf_dir):
    return compose.machine_counts(tables.order_samples(spark, sf_dir))


@query(f"WITH {_SAMPLES}, s AS (SELECT machine, recording::BIGINT % 3 = 0 AS side FROM samples) SELECT machine FROM s GROUP BY 1 HAVING count(DISTINCT side) > 1")
def machine_straddle(spark, sf_dir):
    sided = tables.order_samples(spark, sf_dir).withColumn("split", F.when(F.col("recording").cast("long") % 3 == 0, "dev").otherwise("test"))
    return compose.straddling(sided).select("machine")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_metadata(spark, sf_dir):
    owners = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, sf_dir, "customer").join(owners, "c_custkey", "left_anti").select("c_custkey")


def _damaged(spark, sf_dir):
    """A pool with a fault of each kind: a sample's number of its recording's slots says which."""
    points = _prices(spark, sf_dir)
    kept = written(chunks.samples(points, KNOBS, "R", F.lit("lineitem")), "kept")
    slot, hit = F.col("slot"), lambda n: (F.col("slot") == n).cast("int")
    meta = kept.filter("slot != 7").withColumns({
        "length": F.col("length") + hit(2), "split": F.when(slot == 3, "other").when(slot == 13, None).otherwise("dev"), "num_point_anomalies": F.col("num_point_anomalies") + hit(9), "y_i": F.when(slot == 10, 1 - F.col("y_i")).otherwise(F.col("y_i")),
    })
    meta = meta.withColumn("_copy", F.explode(F.when(slot == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")
    at = F.col("time_index")
    cells = chunks.sample_points(points, kept).withColumn("slot", F.regexp_extract("series_id", r"_chunk(\d+)$", 1).try_cast("bigint")).filter("slot IS NULL OR slot != 8").withColumns({
        "value": F.when((slot == 5) & (at == 0), float("nan")).when((slot == 14) & (at == 1), None).otherwise(F.col("value")),
        "label": F.when((slot == 6) & (at == 0), 2).when((slot == 15) & (at == 1), None).when(slot == 12, 1).otherwise(F.col("label")), "time_index": F.when((slot == 11) & (at == 5), 6).otherwise(at),
    })
    return cells.drop("slot"), meta


@query(f"""WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META},
meta AS (SELECT series_id, length + CAST(slot = 2 AS INT) AS length, num_point_anomalies + CAST(slot = 9 AS INT) AS marked, CASE WHEN slot = 10 THEN 1 - y_i ELSE y_i END AS y_i, CASE WHEN slot = 3 THEN 'other' WHEN slot <> 13 THEN 'dev' END AS split
  FROM kept, LATERAL (SELECT unnest(range(CASE WHEN slot = 4 THEN 2 ELSE 1 END))) WHERE slot <> 7),
cells AS (SELECT series_id, CASE WHEN slot = 11 AND pos - start = 5 THEN 6 ELSE pos - start END AS t, CASE WHEN slot = 5 AND pos = start THEN 'nan'::DOUBLE WHEN slot = 14 AND pos = start + 1 THEN NULL ELSE value END AS value,
  CASE WHEN slot = 6 AND pos = start THEN 2 WHEN slot = 15 AND pos = start + 1 THEN NULL WHEN slot = 12 THEN 1 ELSE label END AS label FROM points JOIN kept ON kept.recording = points.recording AND pos >= start AND pos < start + length WHERE slot <> 8 OR original_length <= 5000),
seen AS (SELECT series_id AS sid, count(*) AS n, sum(label) AS marked_points, bool_or(value IS NULL OR NOT isfinite(value)) AS odd_value, bool_or(label IS NULL OR label NOT IN (0, 1)) AS odd_label, list_sort(list(t)) <> range(count(*)) AS torn FROM cells GROUP BY 1),
paired AS (SELECT *, count(series_id) OVER (PARTITION BY series_id) AS times FROM meta FULL JOIN seen ON sid = series_id),
bad AS (SELECT unnest([struct_pack(c := 'unique_series', b := times > 1), struct_pack(c := 'finite_values', b := odd_value), struct_pack(c := 'binary_labels', b := odd_label), struct_pack(c := 'metadata_has_data', b := sid IS NULL),
  struct_pack(c := 'data_has_metadata', b := series_id IS NULL), struct_pack(c := 'length_matches', b := length <> n), struct_pack(c := 'anomalies_match', b := marked <> marked_points), struct_pack(c := 'label_matches', b := (y_i = 1) <> (marked_points > 0)),
  struct_pack(c := 'contiguous', b := torn), struct_pack(c := 'length_bounds', b := n < 450 OR n > 35000), struct_pack(c := 'anomaly_budget', b := marked_points / n::DOUBLE > 0.004::DOUBLE + 1e-9), struct_pack(c := 'known_split', b := series_id IS NOT NULL AND coalesce(split NOT IN ('dev', 'test'), TRUE))]) AS u FROM paired)
SELECT u.c AS "check", count(*) FILTER (WHERE u.b) AS violations FROM bad GROUP BY 1""")
def pool_validation(spark, sf_dir):
    return validate.violations(*_damaged(spark, sf_dir), lengths=(450, 35_000), max_ratio=0.004)


@query(f"""WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META} SELECT recording, count(*) AS n_series, round(avg(y_i), 6) AS positive_rate, min(length) AS min_length, round(avg(length), 4) AS mean_length, max(length) AS max_length,
 round(stddev_samp(length), 4) AS std_length, round(avg(anomaly_ratio), 8) AS mean_ratio, round(max(anomaly_ratio), 8) AS max_ratio FROM kept GROUP BY 1""")
def pool_summary(spark, sf_dir):
    s = _rounded(metrics.pool_summary(_price_samples(spark, sf_dir), ["recording"]), "mean_length", "std_length")
    return _rounded(_rounded(s, "mean_ratio", "max_ratio", digits=8), "positive_rate", digits=6)


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return metrics.value_counts(tables.table(spark, sf_dir, "orders"), "o_orderpriority")


@query(f"""WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META} SELECT recording, count(*) AS n, round(quantile_cont(anomaly_ratio, 0.1::DOUBLE), 8) AS p10, round(quantile_cont(anomaly_ratio, 0.5::DOUBLE), 8) AS p50,
 round(quantile_cont(anomaly_ratio, 0.9::DOUBLE), 8) AS p90, round(max(anomaly_ratio), 8) AS max_density FROM kept WHERE y_i = 1 GROUP BY 1""")
def density_percentiles(spark, sf_dir):
    return _rounded(metrics.density_percentiles(_price_samples(spark, sf_dir), "recording"), "p10", "p50", "p90", "max_density", digits=8)


@query(f"WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META} SELECT series_id, num_point_anomalies FROM kept WHERE y_i = 1 AND anomaly_ratio >= 0.002::DOUBLE ORDER BY num_point_anomalies DESC, series_id LIMIT 10")
def pick_series(spark, sf_dir):
    return explore.pick(_price_samples(spark, sf_dir), anomalous=True, dataset="lineitem", min_ratio=0.002, sort_by="num_point_anomalies", n=10).select("series_id", "num_point_anomalies")


@query(f"""WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META}, p AS (SELECT * FROM kept WHERE y_i = 1 ORDER BY num_point_anomalies DESC, series_id LIMIT 3)
SELECT p.series_id, points.pos - p.start AS time_index, points.value FROM points JOIN p ON points.recording = p.recording AND points.pos >= p.start + 100 AND points.pos < p.start + 200""")
def series_slice(spark, sf_dir):
    points = _prices(spark, sf_dir)
    kept = written(chunks.samples(points, KNOBS, "R", F.lit("lineitem")), "kept")
    ids = explore.pick(kept, anomalous=True, sort_by="num_point_anomalies", n=3)
    return explore.points_of(chunks.sample_points(points, kept), ids, 100, 200).select("series_id", "time_index", "value")


_SCORES = f"""WITH {_PRICES}, q AS (SELECT 'R__' || recording || '_' || pos // 500 AS series_id, quantile_cont(value, 0.25::DOUBLE) AS a, median(value) AS m, quantile_cont(value, 0.75::DOUBLE) AS b, min(value) AS lo, max(value) AS hi, max(label) AS y_i FROM points GROUP BY 1),
s AS (SELECT series_id, CASE WHEN (b - a) / 1.349::DOUBLE > 1e-12 THEN greatest(hi - m, m - lo) / ((b - a) / 1.349::DOUBLE) ELSE 0 END AS cheap_score, y_i FROM q)"""


def _scored(spark, sf_dir):
    points = tables.price_series(spark, sf_dir)
    return scan.cheap_scan(points.withColumn("series_id", F.concat(F.lit("R__"), "recording", F.lit("_"), F.floor(F.col("pos") / 500).cast("string"))))


@query(_SCORES + " SELECT series_id, round(cheap_score, 6) AS cheap_score, y_i FROM s")
def cheap_scan(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), "cheap_score", digits=6)


@query(_SCORES + """, l AS (SELECT avg(cheap_score) + 2 * stddev_pop(cheap_score) AS lim FROM s)
SELECT series_id, row_number() OVER (ORDER BY cheap_score DESC, series_id) AS rank, cheap_score > lim AS is_reported FROM s, l""")
def ranked_list(spark, sf_dir):
    return scan.ranked_list(written(_scored(spark, sf_dir), "scores"), score="cheap_score").select("series_id", "rank", "is_reported")


@query(_SCORES + " SELECT series_id FROM s ORDER BY cheap_score DESC, series_id LIMIT (SELECT count(*) * 50 // 1000 FROM s)")
def budget_topk(spark, sf_dir):
    return scan.budget_topk(written(_scored(spark, sf_dir), "scores"), 50).select("series_id")


@query(_SCORES + f" SELECT series_id FROM s ORDER BY {_CRC.format(k=chr(39) + '42|random|' + chr(39) + ' || series_id')}, series_id LIMIT (SELECT count(*) * 50 // 1000 FROM s)")
def random_baseline(spark, sf_dir):
    return scan.random_baseline(written(_scored(spark, sf_dir), "scores"), 50).select("series_id")


_LABELLED = "SELECT n_chars AS score, toxic, quality FROM documents JOIN labels USING (doc_id)"


def _labelled(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(tables.table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH t AS ({_LABELLED}), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM t),
s AS (SELECT sum(rk) FILTER (WHERE toxic = 1) AS sr, sum(toxic)::DOUBLE AS p, (count(*) - sum(toxic))::DOUBLE AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * n), 8) AS auroc FROM s""")
def auroc(spark, sf_dir):
    return _rounded(metrics.auroc(_labelled(spark, sf_dir), truth="toxic"), "auroc", digits=8)


@query(f"""WITH t AS ({_LABELLED}), c AS (SELECT toxic AS a, quality AS b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c),
x AS (SELECT sum(s * (s - 1) / 2) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY a)), y AS (SELECT sum(s * (s - 1) / 2) AS y FROM (SELECT sum(n) AS s FROM c GROUP BY b))
SELECT round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 8) AS ari FROM i, x, y""")
def adjusted_rand(spark, sf_dir):
    return _rounded(metrics.adjusted_rand(_labelled(spark, sf_dir), "toxic", "quality"), "ari", digits=8)


@query(_SCORES + """, n AS (SELECT row_number() OVER (ORDER BY cheap_score DESC, series_id) AS rk, y_i, count(*) OVER () AS total FROM s), b AS (SELECT unnest([10, 25, 50, 100]) AS budget)
SELECT budget, count(*) FILTER (WHERE rk <= total * budget // 1000) AS looked, coalesce(sum(y_i) FILTER (WHERE rk <= total * budget // 1000), 0) AS found FROM n, b GROUP BY 1""")
def quality_vs_budget(spark, sf_dir):
    scores = written(_scored(spark, sf_dir), "scores")
    ranked = scan.ranked_list(scores, score="cheap_score").select("series_id", "rank")
    scored = scores.select("series_id", "y_i").join(ranked, "series_id")
    total = scored.count()
    looks = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(scan.allowed(total, b)).alias("most")) for b in (10, 25, 50, 100)]))
    within = F.col("rank") <= F.col("_b.most")
    return scored.withColumn("_b", looks).groupBy(F.col("_b.budget").alias("budget")).agg(F.sum(within.cast("long")).alias("looked"), F.sum(F.when(within, F.col("y_i")).otherwise(0)).alias("found"))


@query("""WITH t AS (SELECT unnest(range(64)) AS i) SELECT i, round(least(least(i, 63 - i), 6) / 6.0::DOUBLE, 8) AS taper, round(sin(2 * pi() * i / 16), 8) AS sine FROM t""")
def taper_window(spark, sf_dir):
    i = F.col("id")
    return spark.range(64).select(i.alias("i"), F.round(scalars.taper(i, F.lit(64), F.lit(6)), 8).alias("taper"), F.round(F.sin(2 * F.pi() * i / 16), 8).alias("sine"))


@query("""WITH t AS (SELECT unnest(range(66)) AS i), w AS (SELECT i, CASE WHEN i BETWEEN 1 AND 64 THEN least(least(i - 1, 64 - i), 6) / 6.0::DOUBLE ELSE 0 END AS x FROM t)
SELECT round(sqrt(sum(pow(x - 0.5::DOUBLE * p, 2))) / 0.8::DOUBLE, 8) AS z FROM (SELECT x, coalesce(lag(x) OVER (ORDER BY i), 0) AS p FROM w)""")
def matched_filter_z(spark, sf_dir):
    shape = F.transform(F.sequence(F.lit(0), F.lit(65)), lambda i: F.when((i >= 1) & (i <= 64), scalars.taper(i - 1, F.lit(64), F.lit(6))).otherwise(0.0))
    w = spark.range(1).select(shape.alias("s"))
    shifted = F.concat(F.array(F.lit(0.0)), F.slice("s", 1, F.size("s") - 1))
    energy = F.aggregate(F.zip_with("s", shifted, lambda x, p: (x - 0.5 * p) * (x - 0.5 * p)), F.lit(0.0), lambda a, b: a + b)
    return w.select(F.round(F.sqrt(energy) / 0.8, 8).alias("z"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, max(value) AS max FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    w = replay.windowed(tables.table(spark, sf_dir, "events"))
    return _rounded(w.withColumn("start", F.col("start").cast("timestamp_ntz")), "mean", "std")


_ORDERS = """SELECT 'R__' || o_orderpriority || '__' || o_orderkey AS series_id, o_orderstatus AS base_type, CAST(o_orderpriority = '1-URGENT' AS INT) AS y_i, CASE WHEN o_orderkey % 3 = 0 THEN 'dev' ELSE 'test' END AS split,
  CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 900 END AS period_detected, o_totalprice AS detect_z, (o_custkey % 100) / 128.0::DOUBLE AS anomaly_fraction FROM orders"""


def _orders(spark, sf_dir):
    """Orders in the form of a pool's metadata."""
    key = F.col("o_custkey")
    return tables.table(spark, sf_dir, "orders").select(
        F.concat_ws("__", F.lit("R"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("series_id"), F.col("o_orderstatus").alias("base_type"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_i"),
        F.when(F.col("o_orderkey") % 3 == 0, "dev").otherwise("test").alias("split"), F.when(key % 4 > 0, key % 900).alias("period_detected"), F.col("o_totalprice").alias("detect_z"), ((key % 100) / 128.0).alias("anomaly_fraction"),
    )


@query(f"SELECT base_type, split, count(*) AS n_series, round(avg(y_i), 8) AS positive_rate, round(count(period_detected) / count(*)::DOUBLE, 8) AS period_share FROM ({_ORDERS}) GROUP BY 1, 2")
def split_summary(spark, sf_dir):
    return _rounded(metrics.split_summary(_orders(spark, sf_dir), ["base_type"]), "positive_rate", "period_share", digits=8)


@query(f"SELECT base_type, sum(y_i)::BIGINT AS n_dirty, min(detect_z) FILTER (WHERE y_i = 1) AS least, round(median(detect_z) FILTER (WHERE y_i = 1), 4) AS median, round(avg(anomaly_fraction) FILTER (WHERE y_i = 1), 8) AS fraction FROM ({_ORDERS}) GROUP BY 1")
def dirty_summary(spark, sf_dir):
    return _rounded(_rounded(metrics.dirty_summary(_orders(spark, sf_dir), ["base_type"]), "median"), "fraction", digits=8)


@query("SELECT DISTINCT o_orderpriority AS dataset FROM orders")
def distinct_datasets(spark, sf_dir):
    return metrics.datasets(_orders(spark, sf_dir))


@query(f"SELECT series_id, base_type, detect_z FROM ({_ORDERS}) ORDER BY detect_z, series_id LIMIT 25")
def stored_head(spark, sf_dir):
    return explore.head(_orders(spark, sf_dir), 25, ("detect_z", "series_id")).select("series_id", "base_type", "detect_z")


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT 'N' || n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) ON k = 'N' || c_nationkey""")
def metadata_lookup(spark, sf_dir):
    named = tables.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = named.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("series_id"), "n_name", "r_name")
    points = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("series_id"), "c_custkey")
    return explore.described(points, named).select("c_custkey", "n_name", "r_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_orderkey * 0.005::DOUBLE)::DOUBLE AS near_tie, printf('%.2f', l_partkey / 8.0::DOUBLE)::DOUBLE AS tie, printf('%.4f', l_extendedprice * l_discount / 7)::DOUBLE AS quotient,
round(l_extendedprice / 7 % 1, 8) AS phase, l_partkey // 32 * 32 AS down, (l_partkey + 31) // 32 * 32 AS up, round(exp(ln(0.01::DOUBLE) + l_discount * (ln(0.3::DOUBLE) - ln(0.01::DOUBLE))), 10) AS log_uniform, l_discount IS NOT NULL AS tagged FROM lineitem""")
def number_functions(spark, sf_dir):
    part, price = F.col("l_partkey"), F.col("l_extendedprice")
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.round_binary(F.col("l_orderkey") * 0.005, 2).alias("near_tie"), scalars.round_binary(part / 8.0, 2).alias("tie"), scalars.round_binary(price * F.col("l_discount") / 7, 4).alias("quotient"),
        F.round(scalars.fraction_of_cycle(price / 7), 8).alias("phase"), scalars.down_to_multiple(part, F.lit(32)).alias("down"), scalars.up_to_multiple(part, F.lit(32)).alias("up"),
        F.round(scalars.log_uniform(F.col("l_discount"), 0.01, 0.3), 10).alias("log_uniform"), F.col("l_discount").isNotNull().alias("tagged"),
    )


@query("""SELECT o_orderkey, 'unit' || o_custkey % 7 AS machine, CASE WHEN o_custkey % 2 = 0 THEN 'even;' ELSE '' END || o_orderstatus || CASE WHEN o_custkey % 5 = 0 THEN ';whole_series' ELSE '' END AS notes, o_custkey % 5 = 0 AS is_whole,
printf('%05d', o_custkey) AS number, printf('%.1f', round(o_custkey % 64 / 64.0::DOUBLE * 1000) / 10) || '%' AS share, format('{:,}', o_orderkey * 1009) AS thousands,
'{' || concat_ws(',', '"base_type":"' || o_orderstatus || '"', CASE WHEN o_custkey % 3 > 0 THEN '"split":"dev"' END) || '}' AS tags FROM orders""")
def text_functions(spark, sf_dir):
    key = F.col("o_custkey")
    orders = tables.table(spark, sf_dir, "orders")
    tagged = explore.tags(orders.select(F.col("o_orderkey").alias("series_id"), F.col("o_orderstatus").alias("base_type"), F.when(key % 3 > 0, "dev").alias("split"))).withColumnRenamed("series_id", "o_orderkey")
    notes = scalars.notes(F.when(key % 2 == 0, "even").otherwise(""), F.col("o_orderstatus"), F.when(key % 5 == 0, "whole_series"))
    return orders.select(
        "o_orderkey", scalars.machine_of(F.format_string("unit%d_col_%d", key % 7, "o_orderkey")).alias("machine"), notes.alias("notes"), scalars.is_whole(notes).alias("is_whole"), scalars.numbered(key).alias("number"),
        scalars.percent(F.round(key % 64 / 64.0, 3)).alias("share"), scalars.thousands(F.col("o_orderkey") * 1009).alias("thousands"),
    ).join(tagged, "o_orderkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS recording, CASE WHEN s_suppkey % 10 > 0 THEN 25 + s_suppkey * 7 % 200 ELSE 0 END AS planted, TRUE AS found FROM supplier")
def planted_periods(spark, sf_dir):
    """A wave of a period of its own for each supplier, with noise by hash; every tenth is noise alone.

    found: the detector's period is within 6% of the planted one, the window within which it moves a guess to a hill
    (of 90 waves 81 are found to the sample, the others within 3); noise, planted 0, must have none.
    """
    key, i = F.col("s_suppkey"), F.col("pos")
    planted, noise = F.when(key % 10 > 0, 25 + key * 7 % 200), F.xxhash64(key, i) / 2.0**64
    wave = F.sin(2 * F.pi() * i / planted) + 0.6 * F.sin(4 * F.pi() * i / planted + 1) + 0.4 * F.cos(10 * F.pi() * i / planted)
    rows = tables.table(spark, sf_dir, "supplier").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2499))))
    points = rows.select(key.cast("string").alias("recording"), i.cast("long").alias("pos"), (F.coalesce(wave, F.lit(0.0)) + 0.05 * noise + 0.001 * i).alias("value"))
    truth = tables.table(spark, sf_dir, "supplier").select(key.cast("string").alias("recording"), planted.alias("planted"))
    near = F.coalesce(F.abs(F.col("period") - F.col("planted")) <= 0.06 * F.col("planted"), F.col("period").isNull() & F.col("planted").isNull())
    return real_pool.periods(points, SamplerConfig()).join(truth, "recording").select("recording", F.coalesce("planted", F.lit(0)).cast("long").alias("planted"), near.alias("found"))


_SEGMENT = "array<struct<kind:string,start:bigint,end:bigint,shift:double,peak_drift:double,level:double,n_core:bigint>>"


@query("""SELECT family, law, TRUE AS holds FROM (SELECT unnest(['point', 'group', 'level_shift', 'variance', 'trend', 'seasonality', 'flatline']) AS family), (SELECT unnest(['labelled', 'apart', 'found', 'same_elsewhere', 'stated_size']) AS law)""")
def injected_laws(spark, sf_dir):
    """What holds for all anomalous series of each family, against the same series without anomalies.

    labelled: the segments cover as many points as are labelled, all of them inside; apart: events keep 25 points
    between them, spikes 5, and spikes 50 from the ends; found: z is 5 or more, but for
    flatlines, which have no size to raise and stand at their level for as long as they say; same_elsewhere: outside the labels
    nothing changed, inside something did; stated_size: level shifts and drifts reach what their segments say.
    """
    config = PoolConfig.of("S1", anomaly_rate=1.0)
    clean = synthetic_pool.series(spark, replace(config, anomaly_rate=0.0)).select("series_id", F.col("values").alias("twin"))
    made = synthetic_pool.series(spark, config).filter("y_i = 1").join(clean, "series_id")
    events = F.array_sort(F.from_json("segments", _SEGMENT))
    made = made.withColumns({"_e": events, "_d": F.zip_with("values", "twin", lambda a, b: F.abs(a - b))})
    of = lambda f: F.aggregate("_e", F.lit(0).cast("bigint"), f)
    inside = F.array_distinct(F.flatten(F.transform("_e", lambda e: F.slice("labels", (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int")))))
    gaps = F.zip_with(F.slice("_e", 2, F.size("_e")), F.slice("_e", 1, F.size("_e") - 1), lambda b, a: b["start"] - a["end"])
    point = F.col("anomaly_type") == "point"
    edge = ~point | F.forall("_e", lambda e: (e["start"] >= 50) & (e["end"] <= F.col("length") - 50))
    changed = lambda label: F.size(F.filter(F.zip_with("_d", "labels", lambda d, y: (d > 0) & (y == label)), lambda hit: hit))
    stated = F.array_max(F.transform("_e", lambda e: F.abs(F.coalesce(e["shift"], e["peak_drift"]))))
    flat = F.forall("_e", lambda e: F.size(F.filter(F.slice("values", (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int")), lambda v: F.abs(v - e["level"]) <= 1e-5)) >= e["n_core"])
    laws = {
        "labelled": (of(lambda n, e: n + e["end"] - e["start"]) == F.col("num_point_anomalies")) & (inside == F.array(F.lit(1).cast("tinyint"))),
        "apart": F.coalesce(F.array_min(gaps) >= F.when(point, 5).otherwise(25), F.lit(True)) & edge, "found": F.when(F.col("anomaly_type") == "flatline", flat).otherwise(F.col("detect_z") >= 5),
        "same_elsewhere": (changed(0) == 0) & (changed(1) > 0), "stated_size": ~F.col("anomaly_type").isin("level_shift", "trend") | (F.abs(F.array_max("_d") - stated) <= 1e-5),
    }
    kept = made.groupBy(F.col("anomaly_type").alias("family")).agg(*[F.every(F.coalesce(c, F.lit(False))).alias(n) for n, c in laws.items()])
    return kept.unpivot("family", list(laws), "law", "holds")


@query("SELECT unnest(['white_noise', 'ar1', 'ar2', 'linear_trend']) AS base, TRUE AS holds")
def process_laws(spark, sf_dir):
    """Whether the statistics of clean series are those of their drawn parameters.

    Correlation at lag 1 is 0, phi, or phi1 / (1 - phi2), within 5 / sqrt(length); the slope of a linear trend is the
    drawn one within 15 of its deviations in white noise, as the noise may be correlated up to 0.7.
    """
    params = "struct<phi:double,phi1:double,phi2:double,slope:double,sigma:double>"
    made = synthetic_pool.series(spark, PoolConfig.of("S1", anomaly_rate=0.0)).unionByName(synthetic_pool.series(spark, replace(PoolConfig.of("S2", anomaly_rate=0.0), base_types=("linear_trend",))))
    made = made.withColumn("_p", F.from_json("base_params", params))
    points = made.select("series_id", "base_type", "_p", "length", F.posexplode(F.arrays_zip("values", F.concat(F.array(F.lit(None).cast("double")), F.slice("values", 1, F.col("length").cast("int") - 1)).alias("before"))).alias("t", "_v"))
    one = points.groupBy("series_id").agg(F.first("base_type").alias("base"), F.first("_p").alias("_p"), F.first("length").alias("n"), F.corr("_v.values", "_v.before").alias("rho"), F.regr_slope(F.col("_v.values"), F.col("t").cast("double")).alias("slope"))
    rho = F.when(F.col("base") == "ar1", F.col("_p.phi")).when(F.col("base") == "ar2", F.col("_p.phi1") / (1 - F.col("_p.phi2"))).otherwise(0.0)
    straight = F.abs(F.col("slope") - F.col("_p.slope")) <= 15 * F.col("_p.sigma") * F.sqrt(F.lit(12.0)) / F.pow("n", F.lit(1.5))
    holds = F.when(F.col("base") == "linear_trend", straight).otherwise(F.abs(F.col("rho") - rho) <= 5 / F.sqrt("n"))
    return one.groupBy("base").agg(F.every(F.coalesce(holds, F.lit(False))).alias("holds"))


@query(f"""WITH {_EVENTS}, f AS (SELECT recording, pos AS p, label, last_value(CASE WHEN pos % 7 >= 2 THEN value END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY pos ROWS UNBOUNDED PRECEDING) AS value FROM points)
SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY p) - 1 AS pos, value, label FROM f WHERE value IS NOT NULL""")
def raw_files(spark, sf_dir):
    """Events as raw CSV files, one a recording, with padded headings, cells that are no number and labels above 1, read back."""
    points = written(tables.event_series(spark, sf_dir), "events")  # else the join before stands for repartition(), and may deal a recording to several tasks
    cell = F.when(F.col("pos") % 7 >= 2, F.col("value").cast("string")).otherwise("n/a")
    cells = points.repartition("recording").sortWithinPartitions("recording", "pos").select("recording", cell.alias(" DATA "), (F.col("label") * 3).alias("Label"))
    where = folder(spark, "raw-files")
    cells.write.mode("overwrite").partitionBy("recording").option("header", True).option("maxRecordsPerFile", 0).csv(where)
    read = raw.raw_points(spark, where)
    return read.select(F.regexp_replace("dataset", "^recording=", "").alias("recording"), "pos", "value", F.col("label").cast("int").alias("label"))


@query(f"WITH {_PRICES}, {_SLOTS}, {_REFERENCE}, {_JUDGED}, {_META} SELECT series_id, length, num_point_anomalies, length AS points, num_point_anomalies AS labelled, length * (length - 1) // 2 AS places FROM kept")
def pool_files(spark, sf_dir):
    """A pool written, and what is found in its files."""
    points = _prices(spark, sf_dir)
    kept = written(chunks.samples(points, KNOBS, "R", F.lit("lineitem")), "kept")
    where = folder(spark, "pool-files")
    pools.write_pool(chunks.sample_points(points, kept), kept.select("series_id", "length", "num_point_anomalies"), where, "R")
    found, metadata = pools.load_pool(spark, where, "R")
    held = found.groupBy("series_id").agg(F.count("*").alias("points"), F.sum("label").alias("labelled"), F.sum("time_index").alias("places"))
    return metadata.join(held, "series_id")


# what SQL can't say


@query()
def detect_period(spark, sf_dir):
    return real_pool.periods(tables.daily_series(spark, sf_dir), SamplerConfig())


@query()
def deep_detect(spark, sf_dir):
    points = tables.daily_series(spark, sf_dir).select(F.col("recording").alias("series_id"), F.col("pos").alias("time_index"), "value")
    return agent.deep_detect(points).withColumn("evidence", F.to_json("evidence"))


@query()
def gen_series(spark, sf_dir):
    made = synthetic_pool.series(spark, PoolConfig.of("S2"))
    return made.drop("values", "labels")


@query()
def inject_families(spark, sf_dir):
    made = synthetic_pool.series(spark, PoolConfig.of("S1", anomaly_rate=1.0))
    return made.groupBy("anomaly_type").agg(F.count("*").alias("n"), F.min("detect_z").alias("least_z"), F.max("anomaly_fraction").alias("most_anomalous"))


def _raw(spark, sf_dir):
    return _prices(spark, sf_dir).withColumn("dataset", F.lit("lineitem"))


@query()
def compose_split(spark, sf_dir):
    """At the pool size of production, unlike the other queries with KNOBS."""
    return real_pool.build(_raw(spark, sf_dir), "R", replace(KNOBS, pool_size=SamplerConfig().pool_size))["metadata"]


@query()
def legacy_samples(spark, sf_dir):
    config = replace(KNOBS, legacy=True, legacy_chunk_max=1_000, legacy_target_ratio=0.002, legacy_acceptable_ratio=0.004, legacy_max_ratio=0.27)
    return real_pool.legacy_samples(_raw(spark, sf_dir), config).drop("positions")
