"""Documents and sensors shared by the tests."""

import json
import os


def treatment(tid, control, treat, received=15, expected=15, quality=1.0):
    return {"treatment_id": tid, "mean_control_temp": control, "mean_treatment_temp": treat,
            "received_packets": received, "expected_packets": expected, "connection_quality": quality}


def document(site=1, start="2026-01-01T00:00:00", end="2026-01-01T00:15:00", n=15, treatments=None):
    return {"site_id": site, "window_start": start, "window_end": end, "n_observations": n,
            "treatments": treatments if treatments is not None else []}


# The documents of the original test suite, written out again by hand.
VALID_1 = document(1, "2026-01-01T00:00:00", "2026-01-01T00:15:00", 15, [
    treatment(1, 22.0, 23.5), treatment(2, 22.0, 25.0), treatment(3, 22.0, 26.5)])
VALID_2 = document(1, "2026-01-01T00:15:00", "2026-01-01T00:30:00", 15, [
    treatment(1, 22.1, 23.6, 14, 15, 0.933), treatment(2, 22.1, 25.1), treatment(3, 22.1, 26.6)])
INVALID_QUALITY = document(1, "2026-01-01T00:30:00", "2026-01-01T00:45:00", 15, [
    treatment(1, 22.0, 23.5, quality=1.5)])
MISSING_FIELD = {"site_id": 1, "window_start": "2026-01-01T00:45:00", "n_observations": 15,
                 "treatments": [treatment(1, 22.0, 23.5)]}
EXAMPLE_SITE_9 = document(9, "2026-02-20T11:30:00", "2026-02-20T11:45:00", 15, [
    treatment(3, 26.0, 26.38, 20, 20), treatment(1, 26.0, 27.0, 24, 24), treatment(2, 26.0, 26.0, 16, 16)])

SENSORS = [
    {"id": 1, "name": "Sensor 1", "location": "Garden 1", "frequency_minutes": 15, "max_gap_hours": 3},
    {"id": 9, "name": "Sensor 9", "location": "Garden 9", "frequency_minutes": 15, "max_gap_hours": 3},
]


def write_docs(folder, docs: dict):
    """Write ``{file_name: document or raw text}`` into ``folder``."""
    os.makedirs(folder, exist_ok=True)
    for name, doc in docs.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write(doc if isinstance(doc, str) else json.dumps(doc))
    return folder
