"""Report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import spreadsheet_safe
from plumbline.sources.versions import VersionedTable

# fixed values: columns of the flat report, in order
REPORT_COLUMNS = {
    "analysis_id": "analysis_id", "created_at": "created_at", "filename": "source.filename",
    "sha256": "source.sha256", "decision": "prediction.decision",
    "review_priority": "prediction.review_priority",
    "raw_anomaly_score": "prediction.raw_anomaly_score",
    "anomaly_area_ratio": "prediction.anomaly_area_ratio",
    "region_count": "prediction.region_count", "model_id": "model.model_id",
    "threshold_id": "threshold.threshold_id", "quality_status": "quality_gate.status",
    "total_latency_ms": "timing_ms.total",
}


def flat_report(results: DataFrame) -> DataFrame:
    """Nested analysis rows as the flat report, file names made safe for spreadsheets."""
    columns = []
    for name, path in REPORT_COLUMNS.items():
        c = F.col(path)
        if name == "filename":
            c = spreadsheet_safe(c)
        elif name in ("model_id", "threshold_id"):
            c = F.coalesce(c, F.lit(""))
        columns.append(c.alias(name))
    return results.select(*columns)


TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv_report(results: DataFrame, path: str) -> None:
    flat_report(results).write.mode("errorifexists").option("header", "true").option(
        "timestampFormat", TIMESTAMP_FORMAT).csv(path)


def write_json_report(results: DataFrame, path: str) -> None:
    results.write.mode("errorifexists").option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def append(rows: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Add a batch to an audit table once; existing rows are never touched. Whether it was added."""
    return VersionedTable(rows.sparkSession, path).append(rows, writer, batch)
