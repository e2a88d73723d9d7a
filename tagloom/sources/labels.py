"""Label and prediction CSV files, catalogs, and the sinks of the output table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import dates
from ..functions.geometry import box, valid, yolo_line
from ..functions.text import digits, text_of

# The columns of the output table, in order, and a header that label files misspell.
COLUMNS = (
    "filename product_name price_default price_card price_discount barcode discount_amount id_sku print_datetime code additional_info color "
    "special_symbols frame_timestamp x_min y_min x_max y_max qr_code_barcode price1_qr price2_qr price3_qr price4_qr wholesale_level_1_count "
    "wholesale_level_1_price wholesale_level_2_count wholesale_level_2_price action_price_qr action_code_qr"
).split()
ALIASES = {"wholesale_level_1_coun": "wholesale_level_1_count"}
ROWS = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
CATALOG = T.StructType([T.StructField("fullname", T.StringType()), T.StructField("code", T.StringType())])


def read_labels(spark: SparkSession, path: str, skip: tuple[str, ...] = ("sample.csv",)) -> DataFrame:
    """The output table's columns from one file or all `*.csv` below a folder: trimmed, missing ones empty, file names inferred."""
    raw = spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", escape='"', encoding="UTF-8", mode="PERMISSIVE").csv(path)
    name = F.col("_metadata.file_name")
    held = {ALIASES.get(c.strip().lstrip("﻿"), c.strip().lstrip("﻿")): c for c in raw.columns}
    cells = {c: F.trim(text_of(F.col(f"`{held[c]}`"))) if c in held else F.lit("") for c in COLUMNS}
    stem = F.regexp_replace(F.url_decode(name), r"\.csv$", "")
    cells["filename"] = F.when(cells["filename"] == "", stem).otherwise(cells["filename"])
    return raw.where(~name.isin(list(skip))).select(*[cells[c].alias(c) for c in COLUMNS])


def read_catalog(spark: SparkSession, path: str, charset: str = "cp1251") -> DataFrame:
    """name, code, ord (file order) of a `;`-separated catalog in a single-byte charset; rows without either don't count.

    Spark's CSV reader refuses this charset, so lines are split as bytes and decoded in Arrow batches.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    # The text reader keeps the bytes of a line as they are.
    raw = lines.select(F.col("value").cast("binary").alias("line"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"))

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            text = [x.decode(charset, "replace") for x in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column("ord")], names=["line", "ord"])

    kind = raw.schema["ord"].dataType.simpleString()
    rows = raw.mapInArrow(decoded, f"line string, ord {kind}")
    parsed = rows.select(F.from_csv("line", CATALOG.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": ";", "escape": '"'}).alias("r"), "ord")
    code, name = digits(F.col("r.code")), F.trim(F.col("r.fullname"))
    return parsed.select(name.alias("name"), code.alias("code"), "ord").where("code <> '' and name <> ''")


def with_boxes(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds bbox and timestamp_ms; strict: a row without a valid box raises, else it is null."""
    side = lambda c: F.replace(text_of(F.col(c)), F.lit(","), F.lit(".")).try_cast("double")
    b = box(side("x_min"), side("y_min"), side("x_max"), side("y_max"))
    bad = F.raise_error(F.lit("a label has no valid box")).cast("struct<x_min:double,y_min:double,x_max:double,y_max:double>") if strict else F.lit(None).cast("struct<x_min:double,y_min:double,x_max:double,y_max:double>")
    return rows.withColumns({"bbox": F.when(valid(b), b).otherwise(bad), "timestamp_ms": dates.timestamp_ms(F.col("frame_timestamp"))})


def layout_entries(rows: DataFrame, band: int = 220) -> DataFrame:
    """Labelled rows with file name keys, box, shelf band and an order key."""
    d = with_boxes(rows)
    cy = (F.col("bbox.y_min") + F.col("bbox.y_max")) / 2
    return d.withColumns({"filename_keys": filename_keys(F.col("filename")), "shelf_band": F.floor(cy / band), "order_key": F.struct("timestamp_ms", F.floor(cy / band).alias("band"), F.col("bbox.x_min").alias("x"))})


def filename_keys(c):
    """Spellings under which a video is known: path, name, stem, stem with .mp4, parent and name, parent."""
    path = F.lower(F.replace(F.trim(text_of(c)), F.lit("\\"), F.lit("/")))
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    near = F.when(parent != "", F.concat(parent, F.lit("/"), name)).otherwise(F.lit(""))
    return F.filter(F.array_distinct(F.array(path, name, stem, F.concat(stem, F.lit(".mp4")), near, parent)), lambda x: (x != "") & (x != ".mp4"))


def near_filename_keys(c):
    """The earlier spellings: path, name, parent and name."""
    return F.array_distinct(F.filter(F.array(*[F.get(filename_keys(c), F.lit(i)) for i in range(2)], F.lower(F.regexp_extract(F.replace(F.trim(text_of(c)), F.lit("\\"), F.lit("/")), r"([^/]+/[^/]+)$", 1))), lambda x: F.coalesce(x != "", F.lit(False))))


def video_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """csv, video: each label file with the video of its stem in its folder, else with the only one there."""
    paths = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(folder).select("path")
    d = paths.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kind"))
    csv = d.where("kind = 'csv'").select("dir", "stem", F.col("path").alias("csv"))
    videos = d.where("kind = 'mp4'").select("dir", "stem", F.col("path").alias("video"))
    only = videos.groupBy("dir").agg(F.min("video").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    j = csv.join(videos, ["dir", "stem"], "left").join(only, "dir", "left")
    return j.select("csv", F.coalesce("video", "only").alias("video")).where("video is not null")


def write_rows(rows: DataFrame, path: str) -> None:
    """One CSV file of exactly the output columns, empty cells unquoted. The output table of a video is small; one task writes it."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS]
    rows.select(*cells).coalesce(1).write.mode("overwrite").options(header=True, emptyValue="", escape='"').csv(path)


def preview(rows: DataFrame, order: str, limit: int = 25) -> DataFrame:
    """One JSON document with the number of rows and the first ones."""
    cells = F.struct(*[c for c in rows.columns])
    first = rows.orderBy(order).limit(limit).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("r")))).alias("x"))
    n = rows.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(first)).select(F.to_json(F.struct("n", F.transform("x", lambda r: r["r"]).alias("rows"))).alias("preview"))  # one row each


def yolo_labels(rows: DataFrame, frame_width: int, frame_height: int, split_stride: int = 5) -> DataFrame:
    """image, split, line of the detector's training labels; every `split_stride`-th time of a video is held out."""
    w = Window.partitionBy("filename").orderBy("timestamp_ms")
    d = with_boxes(rows).where("bbox is not null").withColumn("_t", F.dense_rank().over(w))
    image = F.concat_ws("_", F.col("filename"), F.col("timestamp_ms").cast("string"))
    return d.select(image.alias("image"), F.when(F.col("_t") % split_stride == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"), yolo_line(F.col("bbox"), F.lit(frame_width), F.lit(frame_height)).alias("line"))
