"""Artifacts of a job: storage of files by key, side-cars, previews, manifests; constant and empty sources; unlabelled videos.

Files are reached through Hadoop file systems, so a base of `s3a://` works as a local folder does.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import union_of_columns
from ..runner import Report

LOG = logging.getLogger(__name__)
# The constant row of the mock source.
MOCK_ROW = {"product_name": "mock", "price_card": "99.99", "frame_timestamp": "0", "x_min": "0", "y_min": "0", "x_max": "10", "y_max": "10"}


@dataclass
class Storage:
    """Objects by key under a base folder or bucket."""

    spark: SparkSession
    base: str

    def path(self, key: str) -> str:
        return f"{self.base.rstrip('/')}/{key.lstrip('/')}"

    def _at(self, key: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, key: str) -> bool:
        fs, p = self._at(key)
        return fs.exists(p)

    def size(self, key: str) -> int | None:
        """Bytes of an object, None if there is none."""
        fs, p = self._at(key)
        return fs.getFileStatus(p).getLen() if fs.exists(p) else None

    def put_text(self, key: str, text: str) -> str:
        fs, p = self._at(key)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        return self.path(key)

    def get_text(self, key: str) -> str:
        return self.spark.read.text(self.path(key), wholetext=True).first()["value"]

    def upload(self, local: str, key: str) -> str:
        fs, p = self._at(key)
        fs.copyFromLocalFile(self.spark._jvm.org.apache.hadoop.fs.Path(local), p)
        return self.path(key)

    def download(self, key: str, local: str) -> None:
        fs, p = self._at(key)
        fs.copyToLocalFile(p, self.spark._jvm.org.apache.hadoop.fs.Path(local))


def side_car(storage: Storage, key: str, rows: DataFrame, head: dict | None = None) -> str:
    """Rows written as lines of JSON under a key, and `head` beside them; a failure is logged and gives "": a side-car never breaks a job."""
    try:
        rows.write.mode("overwrite").json(storage.path(key))
        if head is not None:
            storage.put_text(f"{key}.head.json", json.dumps(head, ensure_ascii=False, sort_keys=True))
        return storage.path(key)
    except Exception as e:  # noqa: BLE001  reported, not raised
        LOG.warning("side-car %s failed: %s", key, e)
        return ""


def preview(stats: DataFrame, detections: DataFrame, crops: DataFrame, rows: DataFrame, order: str, n_detections: int = 10, n_crops: int = 10, n_rows: int = 25) -> DataFrame:
    """One JSON document (column `preview`): the stats, the first detections, the best crops and the first rows."""

    def part(df: DataFrame, name: str, by: list[str], most: int) -> DataFrame:
        keys = [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in by]
        item = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*df.columns).alias("r"))
        return df.orderBy(*keys).limit(most).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias(name))

    parts = [
        stats.select(F.struct(*stats.columns).alias("stats")),
        part(detections, "detections", ["detection_id"], n_detections),
        part(crops, "crops", ["-quality", "crop_id"], n_crops),
        part(rows, "rows", [order], n_rows),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.select(F.to_json(F.struct("stats", "detections", "crops", "rows")).alias("preview"))


def manifest(storage: Storage, key: str, job: str, reports: list[Report], began: datetime, stats: dict | None = None) -> dict:
    """What a job did, written also after a failure: its stages with times in UTC and milliseconds."""
    ended = datetime.now(UTC)
    failed = [r.name for r in reports if r.status == "failed"]
    doc = {
        "job": job,
        "status": "failed" if failed else "done",
        "started_at": began.astimezone(UTC).isoformat(),
        "finished_at": ended.isoformat(),
        "duration_ms": max(round((ended - began.astimezone(UTC)).total_seconds() * 1000), 0),
        "stages": [asdict(r) for r in reports],
        "stats": stats or {},
    }
    storage.put_text(key, json.dumps(doc, ensure_ascii=False, default=list))
    return doc


def mock_rows(spark: SparkSession, columns: list[str]) -> DataFrame:
    """One constant row of all columns."""
    return spark.range(1).select(*[F.lit(MOCK_ROW.get(c, "")).alias(c) for c in columns])


def emptied(frames: dict[str, DataFrame], names: tuple[str, ...] = ("detections", "rows")) -> dict[str, DataFrame]:
    """The frames without any row, schemas kept."""
    return {n: frames[n].where(F.lit(False)) for n in names if n in frames}


def rehydrated(frames: dict[str, DataFrame], name: str, load) -> DataFrame:
    """A frame that an earlier stage left, else what `load` reads."""
    return frames[name] if name in frames else load()


def unlabelled(videos: DataFrame, labels: DataFrame, preferred: list[str]) -> DataFrame:
    """place, path of the videos without labels: preferred names first in their order, then the others by path. Columns: path."""
    from pyspark.sql.window import Window

    name = F.element_at(F.split("path", "/"), -1)
    at = F.array_position(F.array(*map(F.lit, preferred)), name) if preferred else F.lit(0)
    d = videos.select("path").join(labels.select("path").distinct(), "path", "left_anti").withColumn("_at", F.when(at > 0, at).otherwise(F.lit(len(preferred) + 1)))
    # One row a video of a folder.
    return d.select(F.row_number().over(Window.orderBy("_at", "path")).alias("place"), "path")


def dataset_name(video: str, timestamp_ms: int, frame_index: int | None = None, offset: int = 0) -> str:
    """The name of a training image: video and time, and the frame and its offset where they are known."""
    base = f"{video}_ts_{timestamp_ms}"
    if frame_index is None and not offset:
        return base
    return f"{base}_f_{'unknown' if frame_index is None else f'{frame_index:06d}'}_off_{offset:+04d}"


def table_of(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts with the union of their columns, in the order in which they first come."""
    return union_of_columns(parts)
