"""The record types of the engine."""

from __future__ import annotations

FLIGHTS = "Placeholder string, Name string, Status string, Flight string, Cost_usd int, Distance_km int, Region string"
LABELS = "sample string, label int"
RUNS = "run_id string, experiment_id string, status string, params map<string,string>, metrics map<string,double>"
METRICS = "run_id string, key string, value double, step int"
MODEL_VERSIONS = "name string, version int, run_id string, current_stage string"
PREDICTIONS = "predicted_label int, probabilities array<double>, target_label int, error string"
FILES = "path string, parent string, name string, depth int, type string, size long, created double, modified double, accessed double, mode int, link boolean"
OBJECTS = "key string, size long, last_modified timestamp, content_type string, etag string, content binary"
MESSAGES = "thread string, seq int, role string, name string, content string"
TOOLS = "name string, description string, schema string, ord int"
CONFIG_MAPS = "name string, namespace string, labels map<string,string>, deploymentConfig string"
KEYS = "name string, value binary"
EDGES = "src string, cond string, dst string"
