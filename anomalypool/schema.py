"""Schemas of the tables that pools are made of."""

from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("time_index", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("label", T.ByteType())])

METADATA = "series_id string, length bigint, num_point_anomalies bigint, y_i int, is_split boolean, original_length bigint, source_notes string, split string"
METADATA_REAL = METADATA + ", period_detected int, is_representative boolean, anomaly_ratio double"
SEGMENT = "kind string, start int, end int, severity double, detail map<string,string>"
SYNTHETIC = (
    "series_id string, length bigint, num_point_anomalies bigint, y_i int, is_split boolean, original_length bigint, source_notes string, split string, base_type string, "
    "base_params string, anomaly_type string, severity double, num_segments int, segments string, severity_effective double, detect_z double, anomaly_fraction double, target_fraction double"
)
