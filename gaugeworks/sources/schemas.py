"""Schemas of the files that evaluation runs leave, as DDL. Seeds are BIGINT: they go up to 2**32. Free parameters are VARIANT."""

MANIFEST = """sample_id STRING, modality STRING, label STRING, attack_type STRING, split STRING, bonafide_source STRUCT<dataset: STRING, id: STRING, license: STRING, url: STRING>,
 attack_params VARIANT, sensor_preset STRING, sensor_params VARIANT, generators_used ARRAY<STRUCT<name: STRING, version: STRING, license: STRING, commercial_ok: BOOLEAN, model_hash: STRING>>,
 pipeline_version STRING, core_version STRING, ontology_version STRING, seed BIGINT, output_path STRING, output_sha256 STRING, created_at TIMESTAMP"""

#: All kinds of events in one: `type` tells which columns have values.
PROVENANCE = """type STRING, name STRING, license STRING, source_url STRING, sha256_of_index STRING, attack_types ARRAY<STRING>, ingested_at TIMESTAMP, version STRING, commercial_ok BOOLEAN, model_hash STRING,
 registered_at TIMESTAMP, attack_type STRING, axis STRING, paper STRING, doi STRING, url STRING, n_chunks BIGINT, n_videos BIGINT, n_frames_written BIGINT, detection_rate DOUBLE, real_filenames_sha256 STRING"""

SESSION = """session_id STRING, label STRING, subject_id STRING, touch ARRAY<STRUCT<t: DOUBLE, x: DOUBLE, y: DOUBLE, phase: STRING>>, key ARRAY<STRUCT<t: DOUBLE, phase: STRING, field: STRING>>,
 motion ARRAY<STRUCT<t: DOUBLE, ax: DOUBLE, ay: DOUBLE, az: DOUBLE>>, ontology_version STRING, generator_version STRING, seed BIGINT, created_at TIMESTAMP"""

SESSION_MANIFEST = "session_id STRING, label STRING, subject_id STRING, payload_path STRING, payload_sha256 STRING"

#: A superset over time: older cells lack the later columns.
SWEEP_CELL = """capacity STRING, data_level STRING, seed BIGINT, n_train BIGINT, n_val_in_domain BIGINT, n_val_cross_domain BIGINT, eer_in_domain DOUBLE, eer_cross_domain DOUBLE, accuracy_in_domain DOUBLE, accuracy_cross_domain DOUBLE,
 threshold DOUBLE, apcer_max DOUBLE, bpcer DOUBLE, acer DOUBLE, apcer_per_pai MAP<STRING, DOUBLE>, seconds DOUBLE, git_sha STRING"""

REP = "user STRING, pointer ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, ts: DOUBLE>>, keys ARRAY<STRUCT<code: STRING, phase: STRING, ts: DOUBLE>>"

# Fixed values of closed columns.
MODALITIES = ("face", "voice")
LABELS = ("bonafide", "attack")
SPLITS = ("train", "dev", "test")
SESSION_LABELS = ("genuine", "imposter", "bot")
