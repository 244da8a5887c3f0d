"""Declared schemas of the engine's tables, as DDL text; nothing is inferred."""

from __future__ import annotations

BOX = "x1: double, y1: double, x2: double, y2: double"
POINTS = "array<struct<x: double, y: double>>"

DETECTIONS = f"session_id string, frame_index int, det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double, body struct<{BOX}>, embedding array<double>"
ZONES = f"session_id string, salon {POINTS}, street {POINTS}, door {POINTS}, spawn {POINTS}, frame_width int, frame_height int"
SAMPLES = "session_id string, track_id int, seq int, frame_index int, zone string, in_door boolean, anchor_x double, anchor_y double, head_size double, body_ratio double, in_spawn boolean"
ORIGINS = "session_id string, track_id int, origin string"
EVENTS = "session_id string, frame_index int, track_id int, kind string, exits int, total_exits int"
RESULTS = (
    "session_id string, status string, video_device_id string, channel int, event_code string, clip_started_ms long, finished_ms long, boardings int, alightings int, exited int, onboard int, file_sha256 string, original_path string"
)
BINDINGS = "id long, recorder_id string, camera_code string, logical_door string, profile_id long, active boolean, updated_ms long"
PROFILES = "id long, name string, door string, salon string, street string, spawn string, smart_stop boolean"
FILES = "path string, size long, modified_ms long"

#: Fixed values.
DOOR_NAMES = "FRONT", "REAR", "CUSTOM", "IGNORE", "NEEDS_CLASSIFICATION"
