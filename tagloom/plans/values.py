"""Queries of single values: texts made clean, dates and codes read, colors, qualities, boxes of points, times, maps, and the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, payload, prices
from ..functions import geometry as G
from ..functions import reading as R
from ..functions import text as X
from ..operators import crops as K
from ..operators import ranking, tracks
from ..sources import labels
from ..sources.tables import DETECTIONS_SQL, detections, ean_ok_sql, load
from .readings import PAYLOADS_SQL, payloads
from .registry import query

P = "p_partkey"


@query(
    f"""WITH raw AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || chr(9) || chr(10) || chr(160) || p_brand || ' ' WHEN 1 THEN '{X.ABSENT_MISREAD}' WHEN 2 THEN ' N/A ' WHEN 3 THEN '-' WHEN 4 THEN '' ELSE p_type END AS t,
  ['Красный', ' жёлтый', 'white', 'ЗЕЛЕНЫЙ', 'синий'][p_partkey % 5 + 1] AS c FROM part),
clean AS (SELECT k, t, trim(regexp_replace(t, '[\\s\\x{{00A0}}]+', ' ', 'g')) AS s, c FROM raw)
SELECT k AS p_partkey, s AS collapsed, replace(s, '{X.ABSENT_MISREAD}', 'нет') AS value, lower(replace(s, '{X.ABSENT_MISREAD}', 'нет')) NOT IN ('', 'нет', 'none', 'n/a', '-') AS says,
  CASE lower(trim(c)) WHEN 'красный' THEN 'red' WHEN 'жёлтый' THEN 'yellow' WHEN 'зеленый' THEN 'green' ELSE lower(trim(c)) END AS color, s AS decoded FROM clean"""
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their white space as one space, words for nothing told apart, colors in English, bytes of symbols as text."""
    k = F.col(P)
    spaced = F.concat(F.lit("  "), "p_name", F.lit("\t\n "), "p_brand", F.lit(" "))
    t = F.when(k % 6 == 0, spaced).when(k % 6 == 1, X.ABSENT_MISREAD).when(k % 6 == 2, " N/A ").when(k % 6 == 3, "-").when(k % 6 == 4, "").otherwise(F.col("p_type"))
    color = F.element_at(F.array(*map(F.lit, ("Красный", " жёлтый", "white", "ЗЕЛЕНЫЙ", "синий"))), (k % 5 + 1).cast("int"))
    p = load(spark, sf_dir, "part").select(k, t.alias("t"), color.alias("c"))
    data = F.concat(F.lit("\0 ").cast("binary"), X.collapse(F.col("t")).cast("binary"), F.lit("\0\n").cast("binary"))
    return p.select(k, X.collapse(F.col("t")).alias("collapsed"), X.output_value(F.col("t")).alias("value"), X.has_value(F.col("t")).alias("says"), X.color_en(F.col("c")).alias("color"), R.decoded_payload(data).alias("decoded"))


READ_SQL = r"""WITH made AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'на ' || (p_partkey % 28 + 1) || ',02,2026 1.14 и 3.04.26' WHEN 1 THEN 'до ' || (p_partkey % 28 + 1) || '.12.2025' WHEN 2 THEN '1.2' ELSE '' END AS d,
  CASE p_partkey % 3 WHEN 0 THEN '01_' || lpad((p_partkey % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN 'x ЧБК 7_a' ELSE p_name END AS z, ['п/ сух', 'Полу', 'CYX OE', 'брют'][p_partkey % 4 + 1] AS s, p_name || ' ' || p_size AS t FROM part),
found AS (SELECT *, regexp_extract_all(d, '([0-9]{1,2}[.,][0-9]{1,2}[.,][0-9]{2,4})(\s*([0-9]{1,2}[:.][0-9]{2}))?', 1) AS days, regexp_extract_all(d, '([0-9]{1,2}[.,][0-9]{1,2}[.,][0-9]{2,4})(\s*([0-9]{1,2}[:.][0-9]{2}))?', 3) AS hours FROM made)
SELECT k AS p_partkey, array_to_string([trim(replace(days[i], ',', '.') || ' ' || replace(coalesce(hours[i], ''), '.', ':')) for i in range(1, len(days) + 1)], '|') AS dates,
  CASE k % 3 WHEN 0 THEN z WHEN 1 THEN 'ЧБК 7_a' ELSE '' END AS zones, CASE k % 4 WHEN 0 THEN 'Полусухое' WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 'Полусладкое' ELSE '' END WHEN 2 THEN 'Сухое' ELSE 'Брют' END AS sweetness,
  round(0.5::DOUBLE + least(length(regexp_replace(t, '[^0-9]', '', 'g')) / 20.0::DOUBLE, 1.0) + least(length(t) / 120.0::DOUBLE, 0.5), 6) AS quality FROM found"""


@query(READ_SQL)
def read_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, zones of stores and sweetness in blocks of text, and how much a text has to say."""
    k = F.col(P)
    d = F.when(k % 4 == 0, F.concat(F.lit("на "), (k % 28 + 1).cast("string"), F.lit(",02,2026 1.14 и 3.04.26"))).when(k % 4 == 1, F.concat(F.lit("до "), (k % 28 + 1).cast("string"), F.lit(".12.2025"))).when(k % 4 == 2, F.lit("1.2")).otherwise(F.lit(""))
    z = F.when(k % 3 == 0, F.concat(F.lit("01_"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))).when(k % 3 == 1, F.lit("x ЧБК 7_a")).otherwise(F.col("p_name"))
    s = F.element_at(F.array(*map(F.lit, ("п/ сух", "Полу", "CYX OE", "брют"))), (k % 4 + 1).cast("int"))
    blocks = F.array(F.lit("вино"), s, F.when(k % 8 == 1, F.lit("слад кое")).otherwise(F.lit("1,5")))
    t = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    joined = lambda c: F.array_join(c, "|")
    return load(spark, sf_dir, "part").select(
        k, joined(R.date_candidates(F.array(d, F.lit("x")))).alias("dates"), joined(R.zone_codes(F.array(z))).alias("zones"), R.block_sweetness(blocks).alias("sweetness"), F.round(R.text_score(t, F.lit(0.5)), 6).alias("quality")
    )


@query(
    f"""WITH {PAYLOADS_SQL}, t AS (SELECT *, {ean_ok_sql('code')} AS ok FROM payloads)
SELECT p_partkey, CASE WHEN ok THEN code ELSE '' END AS values, CASE WHEN ok THEN code ELSE '8051070512049' END AS hint, CASE WHEN p_partkey % 2 = 0 AND ok THEN code WHEN p_partkey % 2 = 1 THEN '8051070512049' ELSE '' END AS first,
  ok OR p_partkey % 4 <> 3 AS evidence FROM t"""
)
def code_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid codes of payloads, the best hint of them, the first valid of two fields, and whether a symbol is evidence of its product."""
    p, k = payloads(spark, sf_dir), F.col(P)
    values = R.barcode_values(F.col("payload"))
    fields = {"barcode": F.when(k % 2 == 0, F.col("code")).otherwise(F.lit("12")), "qr_code_barcode": F.when(k % 2 == 1, F.lit("8051070512049"))}
    kind = F.when(k % 4 == 3, "barcode").otherwise("qr")
    return p.select(
        k, F.array_join(values, ",").alias("values"), R.best_hint(values, F.lit("08051070512049")).alias("hint"), R.first_valid_barcode(fields).alias("first"), R.code_evidence(kind, F.col("payload")).alias("evidence")
    )


@query(
    """WITH m AS (SELECT p_partkey AS k, floor(p_retailprice) AS whole, p_retailprice FROM part),
t AS (SELECT *, CASE k % 3 WHEN 0 THEN whole WHEN 1 THEN whole + 0.5 ELSE whole + 1 END AS seen, whole + CASE WHEN k % 4 = 0 THEN 0 ELSE 0.89 END AS qr FROM m)
SELECT k AS p_partkey, k % 5 <> 0 AND k % 3 = 0 AND k % 4 <> 0 AS overrides FROM t"""
)
def qr_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a symbol's price replaces the read one: same roubles, and only the symbol has kopecks."""
    k, whole = F.col(P), F.floor("p_retailprice")
    seen = F.format_string("%.2f", whole + F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.5).otherwise(1.0))
    qr = F.format_string("%.2f", whole + F.when(k % 4 == 0, 0.0).otherwise(0.89))
    field = F.when(k % 5 == 0, "product_name").otherwise("price_default")
    return load(spark, sf_dir, "part").select(k, prices.qr_overrides(field, qr, seen).alias("overrides"))


@query(
    f"""WITH {DETECTIONS_SQL}, q AS (SELECT detection_id AS i, quality * 900 AS sharp, 255 * confidence AS bright, 80 * quality AS contrast, (detection_id % 10) / 10.0::DOUBLE AS glare, ((x_max - x_min) * (y_max - y_min) / 2073600::DOUBLE) AS area, x_min, y_min, x_max, y_max FROM detections)
SELECT i AS detection_id, round(least(greatest(0.35 * least(sharp / 500, 1) + 0.2 * greatest(1 - abs(bright - 160) / 160, 0) + 0.15 * least(contrast / 64, 1) + 0.2 * (1 - glare) + 0.1 * least(area / 0.01, 1), 0), 1)::DOUBLE, 4) AS quality,
  round(CASE WHEN sharp <= 100 OR sharp >= 850 THEN 0 WHEN sharp < 300 THEN (sharp - 100) / 200 WHEN sharp > 600 THEN (850 - sharp) / 250 ELSE 1 END::DOUBLE, 6) AS preferred,
  CASE WHEN i % 7 = 0 THEN -1 ELSE floor(x_min / 2.0)::INT END AS px_min, CASE WHEN i % 7 = 0 THEN -1 ELSE ceil(y_max / 1.5::DOUBLE)::INT END AS py_max, CASE WHEN i % 5 = 0 THEN i * 1000000 ELSE i END AS time_key, CASE WHEN i % 5 = 0 THEN 0 ELSE i END AS time_or_zero FROM q"""
)
def crop_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of crops, scores of ranges, boxes around corners found in scaled pictures, and times with their two fallbacks."""
    i, b, q = F.col("detection_id"), F.col("bbox"), F.col("quality")
    corner = lambda x, y: F.struct((b[x] * 1.0).alias("x"), (b[y] * 1.0).alias("y"))
    points = F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"))
    box = K.box_of_points(points, F.lit(2.0), F.lit(1.5), F.when(i % 7 == 0, 90.0).otherwise(0.0))
    at = F.when(i % 5 != 0, i)
    return detections(spark, sf_dir).select(
        i, F.round(G.crop_quality(q * 900, 255 * F.col("confidence"), 80 * q, (i % 10) / 10.0, G.area(b) / 2_073_600.0), 4).alias("quality"), F.round(G.preferred_range(q * 900, 100.0, 300.0, 600.0, 850.0), 6).alias("preferred"),
        F.coalesce(box["x_min"], F.lit(-1)).alias("px_min"), F.coalesce(box["y_max"], F.lit(-1)).alias("py_max"), dates.time_key(at, i * 1_000_000).alias("time_key"), dates.time_or_zero(at).alias("time_or_zero"),
    )


@query(
    f"""WITH {DETECTIONS_SQL}, cropped AS (SELECT * FROM detections WHERE track_id % 3 = 0 AND detection_id % 2 = 0),
c AS (SELECT track_id, min(timestamp_ms) AS f, max(timestamp_ms) AS l, median(x_min) AS x, count(*) AS n FROM cropped GROUP BY track_id), d AS (SELECT track_id, min(timestamp_ms) AS f, max(timestamp_ms) AS l, median(x_min) AS x, count(*) AS n FROM detections GROUP BY track_id)
SELECT track_id, coalesce(c.f, d.f) AS first_ms, coalesce(c.l, d.l) AS last_ms, coalesce(c.x, d.x)::DOUBLE AS x_min, coalesce(c.n, d.n) AS n, CASE WHEN c.n IS NULL THEN 'detections' ELSE 'crops' END AS evidence FROM d LEFT JOIN c USING (track_id)"""
)
def slot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and middle boxes of tracks from their crops, where they have any, else from their detections."""
    d = detections(spark, sf_dir)
    s = tracks.slot_summaries(d, d.where("track_id % 3 = 0 and detection_id % 2 = 0"), ["track_id"])
    return s.select("track_id", "first_ms", "last_ms", F.col("median_box.x_min").cast("double").alias("x_min"), "n", "evidence")


@query(
    """SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 2 = 0 THEN 'a=' || p_name END, CASE WHEN p_partkey % 3 <> 0 THEN 'b=' || p_type ELSE 'b=left' END, 'c=' || p_brand) AS merged, CASE WHEN p_partkey % 2 = 0 THEN 'a=' || p_name || ';b=left' ELSE 'b=left' END AS filled FROM part"""
)
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of fields without empty ones, and two merged, the right one winning."""
    k = F.col(P)
    left = payload.non_empty(F.create_map(F.lit("a"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.lit(" нет ")), F.lit("b"), F.lit("left")))
    right = payload.non_empty(F.create_map(F.lit("b"), F.when(k % 3 != 0, F.col("p_type")).otherwise(F.lit("-")), F.lit("c"), F.col("p_brand")))
    return load(spark, sf_dir, "part").select(k, payload.encode(payload.merged(left, right)).alias("merged"), payload.encode(left).alias("filled"))


@query(f"WITH {DETECTIONS_SQL} SELECT detection_id, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, detection_id) AS place FROM detections")
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in its file: the surest first, equals as they came."""
    d = ranking.surest_first(detections(spark, sf_dir), "confidence", "detection_id")
    return d.select("detection_id", F.row_number().over(Window.partitionBy("track_id").orderBy(*ranking.surest_order("confidence", "detection_id"))).cast("long").alias("place"))


@query(
    """WITH rows_of AS (SELECT o_orderkey AS k, 'IN\\day/V' || o_custkey % 20 || '.mp4' AS filename, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 37) % 1800 END AS x, (o_orderkey * 91) % 1000 AS y FROM orders)
SELECT k, 'in/day/v' || regexp_extract(filename, 'V([0-9]+)', 1) || '.mp4' AS path, 'day/v' || regexp_extract(filename, 'V([0-9]+)', 1) || '.mp4' AS near, coalesce(x + 0.5, -1)::DOUBLE AS x_min, CASE WHEN x IS NOT NULL THEN floor((y + y + 80) / 2 / 220)::BIGINT ELSE -1 END AS shelf_band,
  round(k % 1000 * 1000.5)::BIGINT AS at_ms FROM rows_of"""
)
def layout_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows as entries of a layout: names of their file, box, shelf and time."""
    k = F.col("o_orderkey")
    x, y = (k * 37) % 1800, (k * 91) % 1000
    text = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    rows = load(spark, sf_dir, "orders").select(
        k.alias("k"), F.concat(F.lit("IN\\day/V"), (F.col("o_custkey") % 20).cast("string"), F.lit(".mp4")).alias("filename"), F.when(k % 9 != 0, text(x + 0.5)).otherwise(F.lit("")).alias("x_min"), text(y).alias("y_min"),
        text(x + 120).alias("x_max"), text(y + 80).alias("y_max"), text((k % 1000 * 1000.5).cast("decimal(18,1)")).alias("frame_timestamp"),
    )
    e = labels.layout_entries(rows)
    return e.select("k", F.col("filename_keys")[0].alias("path"), F.element_at("filename_keys", 4).alias("near"), F.coalesce("bbox.x_min", F.lit(-1.0)).alias("x_min"), F.coalesce("shelf_band", F.lit(-1)).alias("shelf_band"), F.col("timestamp_ms").alias("at_ms"))


@query(
    f"""WITH {DETECTIONS_SQL}, f AS (SELECT detection_id AS i, (x_max - x_min) * (y_max - y_min) / 2073600::DOUBLE * (1 + detection_id % 40) AS area, (x_max - x_min) * (1 + detection_id % 7) / (2.0 * (y_max - y_min))::DOUBLE AS aspect, quality AS q FROM detections)
SELECT i AS detection_id, CASE WHEN area < 0.006 THEN 'area_too_small' WHEN area > 0.2 THEN 'area_too_large' WHEN aspect < 1.5 THEN 'aspect_ratio_too_small' WHEN aspect > 4.5 THEN 'aspect_ratio_too_large' WHEN q < 0.32 THEN 'low_rectangularity' ELSE '' END AS reason,
  CASE i % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'rotate_90_ccw' WHEN 2 THEN 'rotate_180' WHEN 3 THEN 'none' ELSE 'rotate_90_cw' END AS mode, CASE i % 5 WHEN 3 THEN 'Unknown orientation_mode ''upside''. Falling back to ''none''.' ELSE '' END AS warning FROM f"""
)
def rejected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why regions of pictures can't be tags, and how their pictures are turned."""
    i, b = F.col("detection_id"), F.col("bbox")
    f = {"area_ratio": G.area(b) / 2_073_600.0 * (1 + i % 40), "aspect_ratio": G.width(b) * (1 + i % 7) / (2.0 * G.height(b)), "rectangularity": F.col("quality")}
    mode = F.when(i % 5 == 0, "none").when(i % 5 == 2, " rotate_180").when(i % 5 == 3, "upside").when(i % 5 == 4, "rotate_90_cw").when(i % 10 == 1, "")
    return detections(spark, sf_dir).select(i, K.rejection_reason(f, (0.006, 0.2), (1.5, 4.5)).alias("reason"), F.inline(F.array(K.orientation(mode))))
