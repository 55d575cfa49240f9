"""Schemas of the vendor-neutral tables, as DDL, and the closed vocabulary of quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STUDIES = "study_id long, name string, vendor string, provenance map<string,string>"
MAPS = "map_id long, study_id long, map_name string, study_name string, number_of_points int, mesh_file string, attributes string"
VERTICES = "map_id long, vertex_id int, x double, y double, z double, nx double, ny double, nz double, at_edge boolean"
TRIANGLES = "map_id long, tri_id int, v0 int, v1 int, v2 int, area double"
SCALARS = "map_id long, vertex_id int, name string, kind string, unit string, value double, valid boolean, source string"
MEASUREMENTS = "map<string,struct<value:double,kind:string,unit:string>>"
POINTS = f"map_id long, point_index int, source_id string, x double, y double, z double, measurements {MEASUREMENTS}, electrodes map<string,array<double>>, tags array<string>, annotations map<string,string>"
PLACED_POINTS = "study_id long, placed_id long, type string, x double, y double, z double, label string, attributes map<string,string>, source_id string"
WAVEFORMS = "waveform_id long, study_id long, map_id long, point_source_id string, signal_type string, channels array<string>, units array<string>, sample_rate double, n_samples int, n_channels int, start_time double, data_uri string, size_bytes long"
SAMPLES = "data_uri string, sample_idx int, t double, channel string, value double, unit string"

#: Quantity kind, its unit.
KINDS = {
    "activation_time": "ms",
    "voltage_bipolar": "mV",
    "voltage_unipolar": "mV",
    "pacemap_score": "%",
    "impedance": "ohm",
    "contact_force": "g",
    "correlation": "",
    "unknown": "unknown",
}

#: Order in which a map's primary quantity is looked for.
PRIMARY_ORDER = ["activation_time", "pacemap_score", "voltage_bipolar", "voltage_unipolar"]

#: Kind of quantity, unit as exported, factor to the standard unit.
UNIT_FACTORS = [
    ("activation_time", "ms", 1.0),
    ("activation_time", "s", 1000.0),
    ("activation_time", "us", 0.001),
    ("activation_time", "µs", 0.001),
    ("voltage_bipolar", "mV", 1.0),
    ("voltage_bipolar", "V", 1000.0),
    ("voltage_bipolar", "uV", 0.001),
    ("voltage_bipolar", "µV", 0.001),
    ("voltage_unipolar", "mV", 1.0),
    ("voltage_unipolar", "V", 1000.0),
    ("voltage_unipolar", "uV", 0.001),
    ("voltage_unipolar", "µV", 0.001),
    ("contact_force", "g", 1.0),
    ("impedance", "ohm", 1.0),
    ("impedance", "Ohm", 1.0),
    ("impedance", "Ω", 1.0),
    ("impedance", "kohm", 1000.0),
    ("impedance", "kΩ", 1000.0),
    ("pacemap_score", "%", 1.0),
]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
