"""Queries over texts, groups, crops, checks and reports: one for each operator of a pipeline's stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from ..functions import reading as R
from ..functions.text import has_value
from ..operators import crops as K
from ..operators import gate, grouping, price_blocks, ranking, reports, score, spatial, symbols, tracks
from ..sources.tables import CODES_SQL, DETECTIONS_SQL, codes, detections, ean_ok_sql, load, spread
from ..storage import stored
from .observations import GAP, HOUR, IOU, TRACKS_SQL, track_table
from .readings import PAYLOADS_SQL, ROWS_SQL, SCORED_SQL, output_rows, payloads
from .registry import query

WITH = f"WITH {DETECTIONS_SQL}"
P = "p_partkey"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir)
    k = F.col(P)
    r, kop = 100 + k % 900, F.lpad((k % 100).cast("string"), 2, "0")
    line = lambda on, *parts: F.when(on, F.concat(*parts))
    text = F.concat_ws(
        "\n",
        "p_name",
        F.concat(F.lit("цена "), (r + 50).cast("string"), F.lit(","), kop),
        line(k % 2 == 0, F.lit("карта "), r.cast("string"), F.lit("."), kop),
        line(k % 3 == 0, F.lit("-"), (10 + k % 80).cast("string"), F.lit(" %")),
        line(k % 5 != 0, F.lit("код "), F.left("true_code", F.lit(1)), F.lit(" "), F.substr("true_code", F.lit(2))),
        line(k % 7 == 0, F.lit("полусухое,")),
        line(k % 4 == 0, F.lit("k")),
    )
    zones = F.create_map(
        F.lit("product_name"), F.concat(F.lit("."), "p_name", F.lit("\n12")),
        F.lit("price_default"), F.concat((r + 50).cast("string"), F.lit(" "), kop),
        F.lit("price_card"), F.concat(kop, F.lit(" x "), F.when(k % 2 == 0, r).otherwise(r + 50).cast("string")),
        F.lit("discount"), F.when(k % 3 == 0, F.concat((10 + k % 80).cast("string"), F.lit("%"))).otherwise(F.lit("")),
        F.lit("barcode"), F.col("code"),
        F.lit("sku_date"), F.concat(F.lit("n 27"), F.lpad(k.cast("string"), 10, "0"), F.lit(" t 17.02.2026 1:14")),
        F.lit("special"), F.when(k % 4 == 0, F.lit("ш")).otherwise(F.lit("")),
    )
    return c.select(P, "p_name", "code", "true_code", text.alias("text"), zones.alias("zones"))


TEXT_SQL = f"WITH {CODES_SQL}, t AS (SELECT *, 100 + {P} % 900 AS r, lpad(({P} % 100)::VARCHAR, 2, '0') AS k FROM codes)"


@query(
    f"""{TEXT_SQL} SELECT {P}, p_name || CASE WHEN {P} % 3 = 0 THEN ' -' || (10 + {P} % 80) || ' %' ELSE '' END AS product_name, CASE WHEN {P} % 2 = 0 THEN (r + 50) || '.' || k END AS price_default,
  CASE WHEN {P} % 2 = 0 THEN r ELSE r + 50 END || '.' || k AS price_card, CASE WHEN {P} % 3 = 0 THEN '-' || (10 + {P} % 80) || '%' END AS discount_amount, CASE WHEN {P} % 5 <> 0 THEN true_code END AS barcode,
  CASE WHEN {P} % 7 = 0 THEN 'полусухое' END AS additional_info, CASE WHEN {P} % 4 = 0 THEN 'К' END AS special_symbols FROM t"""
)
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a tag's whole text."""
    f = _texts(spark, sf_dir).select(P, R.parse_fields(F.col("text")).alias("f"))
    return f.select(P, *[F.col("f")[n].alias(n) for n in ("product_name", "price_default", "price_card", "discount_amount", "barcode", "additional_info", "special_symbols")])


@query(
    f"""{TEXT_SQL} SELECT {P}, p_name AS product_name, CASE WHEN {P} % 2 = 0 THEN (r + 50) || '.' || k END AS price_default, CASE WHEN {P} % 2 = 0 THEN r ELSE r + 50 END || '.' || k AS price_card,
  CASE WHEN {P} % 3 = 0 THEN '-' || (10 + {P} % 80) || '%' END AS discount_amount, CASE WHEN {ean_ok_sql('code')} THEN code END AS barcode, '27' || lpad({P}::VARCHAR, 10, '0') AS id_sku,
  '17.02.2026 1:14' AS print_datetime, CASE WHEN {P} % 4 = 0 THEN 'Ш' END AS special_symbols FROM t"""
)
def zone_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the texts of a tag's zones."""
    f = spread(_texts(spark, sf_dir).select(P, "zones"), P).select(P, R.parse_zones(F.col("zones")).alias("f"))
    return f.select(P, *[F.col("f")[n].alias(n) for n in ("product_name", "price_default", "price_card", "discount_amount", "barcode", "id_sku", "print_datetime", "special_symbols")])


@query(f"{WITH}, f AS (SELECT video, timestamp_ms // {HOUR} AS frame, label, detection_id FROM detections) SELECT video, frame, count(*) AS n FROM f GROUP BY ALL")
def detections_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("frame", F.expr(f"timestamp_ms div {HOUR}"))
    return d.groupBy("video", "frame").agg(F.count("*").alias("n"))


@query(
    f"""{WITH} SELECT count(*) AS detections_total, count(DISTINCT timestamp_ms // {HOUR}) AS frames, count(DISTINCT track_id) AS tracks, count(*) FILTER (WHERE label = 'purchase') AS purchases,
  (max(timestamp_ms) - min(timestamp_ms))::BIGINT AS duration_ms, min(quality) AS least, max(quality) AS most FROM detections"""
)
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts over all detections."""
    return detections(spark, sf_dir).agg(
        F.count("*").alias("detections_total"), F.countDistinct(F.expr(f"timestamp_ms div {HOUR}")).alias("frames"), F.countDistinct("track_id").alias("tracks"), F.count_if(F.col("label") == "purchase").alias("purchases"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"), F.min("quality").alias("least"), F.max("quality").alias("most"),
    )


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, and a crop and a symbol of each; some symbols name no detection."""
    d = detections(spark, sf_dir)
    i, t = F.col("detection_id"), F.col("track_id")
    key = F.concat(F.lit("27"), F.lpad((F.expr("track_id div 200") % 1000).cast("string"), 11, "0"))
    crop = d.select(
        i.alias("crop_id"), "detection_id", t.cast("string").alias("track_key"), "quality",
        F.map_filter(F.create_map(
            F.lit("barcode"), F.when(i % 6 == 0, key).otherwise(F.lit("")), F.lit("id_sku"), F.concat(F.lit("27"), F.lpad((t % 7 + i % 3).cast("string"), 10, "0")),
            F.lit("price_card"), F.when(i % 4 == 0, F.lit("99,50")).otherwise(F.concat((t % 50).cast("string"), F.lit(" р"))), F.lit("print_datetime"), F.when(i % 8 == 0, F.lit("на 17.02.2026 1:14")).otherwise(F.lit("нет"))), lambda k, v: v != "").alias("fields"),
    )
    symbol = d.select(
        i.alias("symbol_id"), F.when(i % 35 == 0, i + 10_000_000).otherwise(i).alias("detection_id"), t.cast("string").alias("track_key"), F.when(i % 2 == 0, F.lit("barcode")).otherwise(F.lit("qr")).alias("symbol_type"),
        F.when(i % 15 == 0, F.concat(F.lit("barcode="), key, F.lit(";p1=5"))).when(i % 2 == 0, key).otherwise(F.lit("p1=7")).alias("payload"), "confidence",
    )
    return d, crop, symbol


OBSERVED_SQL = f"""{DETECTIONS_SQL}, keyed AS (SELECT *, '27' || lpad(((track_id // 200) % 1000)::VARCHAR, 11, '0') AS k FROM detections),
crops AS (SELECT detection_id AS crop_id, *, CASE WHEN detection_id % 6 = 0 THEN k ELSE '' END AS barcode, '27' || lpad((track_id % 7 + detection_id % 3)::VARCHAR, 10, '0') AS id_sku,
  CASE WHEN detection_id % 4 = 0 THEN '99,50' ELSE (track_id % 50) || ' р' END AS price_card, CASE WHEN detection_id % 8 = 0 THEN 'на 17.02.2026 1:14' ELSE 'нет' END AS print_datetime FROM keyed),
symbols AS (SELECT detection_id AS symbol_id, CASE WHEN detection_id % 35 = 0 THEN detection_id + 10000000 ELSE detection_id END AS detection_id, track_id, confidence, k,
  CASE WHEN detection_id % 2 = 0 THEN 'barcode' ELSE 'qr' END AS symbol_type, detection_id % 15 = 0 AS coded, detection_id % 15 = 0 OR detection_id % 2 = 0 AS keyed FROM keyed)"""
GROUPS_SQL = f"""{OBSERVED_SQL}, members AS (
  SELECT 'detection' AS kind, detection_id::VARCHAR AS id, track_id::VARCHAR AS t, NULL AS key, 2 AS turn, 0.0 AS rank FROM detections
  UNION ALL SELECT 'crop', crop_id::VARCHAR, track_id::VARCHAR, CASE WHEN barcode <> '' THEN 'barcode:' || barcode ELSE 'id_sku:' || id_sku END, 1, -quality FROM crops
  UNION ALL SELECT 'symbol', symbol_id::VARCHAR, CASE WHEN d.detection_id IS NOT NULL THEN d.track_id::VARCHAR WHEN keyed THEN 'barcode:' || k ELSE s.detection_id::VARCHAR END, CASE WHEN keyed THEN 'barcode:' || k END, 0, -s.confidence
    FROM symbols s LEFT JOIN detections d ON d.detection_id = s.detection_id),
stable AS (SELECT t, arg_min(key, (turn, rank, id)) AS s FROM members WHERE key IS NOT NULL GROUP BY t),
grouped AS (SELECT kind, id, coalesce(s, t) AS group_key FROM members LEFT JOIN stable USING (t))"""


@query(f"WITH {GROUPS_SQL} SELECT kind, id, group_key FROM grouped")
def fusion_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, crops and symbols by the thing that they show."""
    d, c, s = _observed(spark, sf_dir)
    return grouping.fusion_groups(d, c, s)[0]


@query(
    f"""WITH {GROUPS_SQL}, worst AS (SELECT detection_id, min(quality) AS q FROM crops GROUP BY detection_id)
SELECT group_key, arg_max(detection_id, (coalesce(q, 0.0), confidence, -detection_id)) AS best_detection FROM grouped JOIN detections d ON kind = 'detection' AND id = d.detection_id::VARCHAR LEFT JOIN worst USING (detection_id) GROUP BY group_key"""
)
def fusion_best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, s = _observed(spark, sf_dir)
    return grouping.fusion_groups(d, c, s)[1]


@query(
    f"""WITH {OBSERVED_SQL}, c AS (SELECT track_id, crop_id, quality, id_sku, CASE WHEN crop_id % 4 = 0 THEN '99.50' ELSE printf('%.2f', (track_id % 50)::DOUBLE) END AS price, crop_id % 8 = 0 AS dated FROM crops),
prices AS (SELECT track_id, arg_max(price, (n, -o)) AS price_card FROM (SELECT track_id, price, count(*) AS n, min(crop_id) AS o FROM c GROUP BY ALL) GROUP BY track_id),
spots AS (SELECT track_id, i, substr(id_sku, i, 1) AS x, count(*) AS n, min(crop_id) AS o FROM c, range(1, 13) r(i) GROUP BY ALL), places AS (SELECT track_id, i, arg_max(x, (n, -o)) AS x FROM spots GROUP BY track_id, i),
skus AS (SELECT track_id, string_agg(x, '' ORDER BY i) AS id_sku FROM places GROUP BY track_id)
SELECT track_id::VARCHAR AS track_key, arg_max(crop_id, (quality, -crop_id)) AS crop_id, any_value(price_card) AS price_card, any_value(skus.id_sku) AS id_sku, CASE WHEN bool_or(dated) THEN '17.02.2026 1:14' WHEN true THEN 'нет' END AS print_datetime
FROM c JOIN prices USING (track_id) JOIN skus USING (track_id) GROUP BY track_id"""
)
def track_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the crops of a track agree on, written to its best crop. A crop's own cells stay where nothing is agreed on."""
    _, c, s = _observed(spark, sf_dir)
    out = grouping.track_consensus(c, s.where("false"))
    return out.select("track_key", "crop_id", *[F.col("fields")[n].alias(n) for n in ("price_card", "id_sku", "print_datetime")])


@query(
    f"""WITH {OBSERVED_SQL}, votes AS (
  SELECT track_id, 'color' AS field, label AS value, 1 AS w, detection_id AS o FROM detections
  UNION ALL SELECT track_id, 'barcode', barcode, 1, (1::BIGINT << 52) + crop_id FROM crops WHERE barcode <> ''
  UNION ALL SELECT track_id, 'price_card', price_card, 1, (1::BIGINT << 52) + crop_id FROM crops
  UNION ALL SELECT track_id, CASE WHEN coded THEN 'qr_code_barcode' ELSE 'barcode' END, k, 3, (2::BIGINT << 52) + symbol_id FROM symbols WHERE keyed
  UNION ALL SELECT track_id, 'price1_qr', CASE WHEN coded THEN '5' ELSE '7' END, 3, (2::BIGINT << 52) + symbol_id FROM symbols WHERE coded OR NOT keyed),
per AS (SELECT track_id, field, value, sum(w) AS w, min(o) AS o FROM votes GROUP BY ALL), best AS (SELECT track_id, field, arg_max(value, (w, -o)) AS value FROM per GROUP BY track_id, field),
place AS (SELECT track_id, avg((x_min + x_max) / 2.0) AS x, avg((y_min + y_max) / 2.0) AS y FROM detections GROUP BY track_id)
SELECT track_id::VARCHAR AS track_key, max(value) FILTER (WHERE field = 'color') AS color, max(value) FILTER (WHERE field = 'barcode') AS barcode, max(value) FILTER (WHERE field = 'price_card') AS price_card,
  max(value) FILTER (WHERE field = 'price1_qr') AS price1_qr, max(value) FILTER (WHERE field = 'qr_code_barcode') AS qr_code_barcode, round(any_value(x), 4) AS order_x, floor(any_value(y) / 220)::INT AS shelf_band FROM best JOIN place USING (track_id) GROUP BY track_id"""
)
def track_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voted fields, mean center and shelf of each track; symbols count three times."""
    d, c, s = _observed(spark, sf_dir)
    d = d.select(F.col("track_id").cast("string").alias("track_key"), "detection_id", F.col("label").alias("color"), "bbox")
    out = grouping.track_evidence(d, c, s)
    return out.select("track_key", *[F.col("fields")[n].alias(n) for n in ("color", "barcode", "price_card", "price1_qr", "qr_code_barcode")], F.round("order_x", 4).alias("order_x"), "shelf_band")


@query(
    f"""WITH {CODES_SQL}, shaped AS (SELECT {P}, true_code, code, {P} % 4 AS m FROM codes)
SELECT {P}, true_code AS code, CASE m WHEN 0 THEN 0.84 WHEN 1 THEN 0.96 WHEN 2 THEN CASE WHEN code = true_code THEN 0.96 ELSE 0.78 END ELSE 0.96 END AS confidence,
  CASE m WHEN 0 THEN 'ocr_12_plus_checksum' WHEN 2 THEN CASE WHEN code = true_code THEN 'ocr_exact_ean13' ELSE 'ocr_one_digit_repair' END ELSE 'ocr_exact_ean13' END AS source FROM shaped"""
)
def codes_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog codes in texts of twelve digits, of thirteen with a wrong one, and behind a zero, with the surest reading of each text."""
    c = codes(spark, sf_dir)
    k = F.col(P)
    text = F.when(k % 4 == 0, F.col("body")).when(k % 4 == 2, F.col("code")).when(k % 4 == 1, F.concat(F.lit("EAN "), "true_code", F.lit(" шт"))).otherwise(F.concat(F.lit("0"), "true_code"))
    known = c.select(F.col("true_code").alias("code")).distinct()
    found = grouping.read_codes(spread(c.select(P, text.alias("text")), P), known, P, "text")
    best = found.groupBy(P).agg(F.max_by(F.struct("code", "confidence", "source"), F.struct("confidence", "code")).alias("b"))
    return best.select(P, "b.*")


@query(
    f"""WITH {CODES_SQL}, named AS (SELECT true_code, min(p_name) AS name FROM codes GROUP BY true_code),
found AS (SELECT p_brand, {P} AS o, code, 0.96 AS c FROM codes WHERE code = true_code UNION ALL SELECT p_brand, {P}, true_code, 0.90 + ({P} % 10) / 100.0 FROM codes)
SELECT p_brand, arg_max(true_code, (c, -o)) AS barcode, arg_max(name, (c, -o)) AS product_name, max(c)::DOUBLE AS confidence FROM found JOIN named ON code = true_code GROUP BY p_brand"""
)
def products_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest code of each brand's texts and symbols, with its catalog name."""
    c = codes(spark, sf_dir)
    names = c.groupBy(F.col("true_code").alias("code")).agg(F.min("p_name").alias("name"))
    item = lambda d, code, conf, source: d.select("p_brand", F.col(code).alias("code"), conf.alias("confidence"), F.lit(source).alias("source"), F.col(P).alias("ord"))
    found = item(c.where("code = true_code"), "code", F.lit(0.96), "ocr_exact_ean13").unionByName(item(c, "true_code", F.round(0.90 + (F.col(P) % 10) / 100.0, 2), "symbol:zxing"))
    return grouping.resolve_products(found, names, "p_brand").drop("source")


#: Payloads in all their forms through the gate: each third form of list holds a code alone, and codes of even parts are known.
GATED_SQL = f"""{PAYLOADS_SQL}, known AS (SELECT DISTINCT true_code FROM whole WHERE p_partkey % 2 = 0),
seen AS (SELECT p_partkey AS symbol_id, p_partkey % 4 AS m, code, CASE WHEN p_partkey % 12 = 4 THEN 'barcode:' || code ELSE payload END AS payload, {ean_ok_sql('code')} AS ok, code IN (SELECT true_code FROM known) AS listed, p_retailprice AS p, p_partkey % 12 = 4 AS lone FROM payloads),
gated AS (SELECT *, CASE WHEN ok AND listed THEN code ELSE '' END AS trusted, CASE WHEN m = 3 THEN CASE WHEN NOT ok THEN 'bad_ean13_checksum' WHEN NOT listed THEN 'barcode_not_in_catalog' ELSE '' END WHEN lone AND NOT (ok AND listed) THEN 'qr_payload_no_safe_fields' ELSE '' END AS reason FROM seen)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(P)
    p = payloads(spark, sf_dir).withColumn("payload", F.when(k % 12 == 4, F.concat(F.lit("barcode:"), "code")).otherwise(F.col("payload")))
    known = codes(spark, sf_dir).where(f"{P} % 2 = 0").select(F.col("true_code").alias("code"))
    symbols_of = p.select(k.alias("symbol_id"), k.alias("crop_id"), k.alias("detection_id"), F.when(k % 4 == 3, "barcode").otherwise("qr").alias("symbol_type"), F.lit("zxing").alias("decoder"), F.lit("original").alias("variant"), "payload", F.lit(0.9).alias("confidence"))
    return symbols.gated(symbols_of, known)


@query(f"WITH {GATED_SQL} SELECT symbol_id, payload, reason FROM gated WHERE reason <> ''")
def rejected_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of symbols that the gate rejects."""
    return reports.rejected(_gated(spark, sf_dir), "reason").select("symbol_id", "payload", "reason")


@query(
    f"""WITH {GATED_SQL} SELECT symbol_id, trusted AS code, CASE WHEN trusted = '' THEN '' WHEN m = 3 THEN 'barcode' ELSE 'qr_code_barcode' END AS code_field, CASE WHEN m = 3 THEN trusted ELSE concat_ws(';',
  CASE m WHEN 0 THEN CASE WHEN NOT lone THEN 'p1=' || printf('%.2f', p) || ';p4=' || printf('%.2f', p * 0.8) END WHEN 1 THEN 'ap=1.5;p1=' || printf('%.2f', p) ELSE 'ac=None;p1=' || p::VARCHAR END, CASE WHEN trusted <> '' THEN 'barcode=' || trusted END) END AS clean
FROM gated WHERE reason = ''"""
)
def gated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that pass the gate, with their trusted code and their payload without an untrusted one."""
    return _gated(spark, sf_dir).where("reason = ''").select("symbol_id", "code", "code_field", "clean")


@query(
    f"""{WITH}, d AS (SELECT detection_id, CASE WHEN detection_id % 11 = 0 THEN '  ' ELSE label END AS label, CASE WHEN detection_id % 13 = 0 THEN -1 ELSE detection_id END AS f, confidence + CASE WHEN detection_id % 17 = 0 THEN 1.5 ELSE 0 END AS c FROM detections)
SELECT detection_id, concat_ws('; ', CASE WHEN trim(label) = '' THEN 'label must not be empty' END, CASE WHEN f < 0 THEN 'frame_index must be non-negative' END, CASE WHEN c > 1 THEN 'confidence must be from 0 to 1' END) AS violations
FROM d WHERE trim(label) = '' OR f < 0 OR c > 1"""
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that break a rule of their schema."""
    i = F.col("detection_id")
    d = detections(spark, sf_dir).select(
        i, F.when(i % 11 == 0, F.lit("  ")).otherwise(F.col("label")).alias("label"), F.when(i % 13 == 0, F.lit(-1)).otherwise(i).alias("frame_index"), "timestamp_ms", (F.col("confidence") + F.when(i % 17 == 0, 1.5).otherwise(0.0)).alias("confidence"), F.lit("x").alias("source")
    )
    return reports.checked(d, "detection").where("size(violations) > 0").select(i, F.array_join("violations", "; ").alias("violations"))


@query(
    f"""{WITH}, inside AS (SELECT detection_id, timestamp_ms // {HOUR} AS frame, confidence, greatest(0, least(x_min, 1700)) AS a, greatest(0, least(y_min, 900)) AS b, greatest(0, least(x_max, 1700)) AS c, greatest(0, least(y_max, 900)) AS d FROM detections),
padded AS (SELECT *, greatest(0, a - round_even((c - a) * 0.1, 0)::INT) AS pa, greatest(0, b - round_even((d - b) * 0.1, 0)::INT) AS pb, least(1700, c + round_even((c - a) * 0.1, 0)::INT) AS pc, least(900, d + round_even((d - b) * 0.1, 0)::INT) AS pd FROM inside WHERE c > a AND d > b),
numbered AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, detection_id) AS n FROM padded WHERE pc - pa >= 100 AND pd - pb >= 60)
SELECT printf('frame_%06d_crop_%06d', frame, n) AS crop_id, detection_id, (pc - pa)::INT AS width, (pd - pb)::INT AS height FROM numbered WHERE n <= 2 ORDER BY frame, n LIMIT 500"""
)
def crop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of clipped and padded boxes: two a frame, five hundred in all (the caps are the operator)."""
    d = detections(spark, sf_dir).withColumn("frame_index", F.expr(f"timestamp_ms div {HOUR}"))
    return K.candidates(d, 1700, 900, 0.1, (100, 60), 2, 500).select("crop_id", "detection_id", "width", "height")


@query(
    f"""WITH {OBSERVED_SQL}, sizes AS (SELECT track_id, count(*) AS n_crops FROM crops GROUP BY track_id), chosen AS (SELECT * FROM (SELECT * FROM sizes ORDER BY n_crops DESC, track_id::VARCHAR LIMIT 60) WHERE n_crops >= 2)
SELECT track_id::VARCHAR AS track_id, crop_id, row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, crop_id)::INT AS place, n_crops FROM crops JOIN chosen USING (track_id)"""
)
def crop_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crops of the sixty tracks that have most of them."""
    _, c, _ = _observed(spark, sf_dir)
    return K.bank(c.select(F.col("track_key").alias("track_id"), "crop_id", "quality"), 60, 2)


@query(
    f"""{WITH}, v AS (SELECT *, (detection_id % 10) / 10.0::DOUBLE AS glare, (x_max - x_min) * (y_max - y_min) AS area FROM detections)
SELECT track_id, detection_id, row_number() OVER (PARTITION BY track_id ORDER BY quality - 0.25::DOUBLE * glare DESC, area DESC, glare, detection_id)::INT AS place FROM v QUALIFY place <= 3"""
)
def selected_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of each track by quality, glare and area."""
    d = detections(spark, sf_dir).select("track_id", "detection_id", "quality", F.col("detection_id").alias("crop_id"), ((F.col("detection_id") % 10) / 10.0).alias("glare_ratio"), G.area(F.col("bbox")).alias("area"))
    return K.views(d, "track_id", 3).select("track_id", "detection_id", "place")


def _ramp_sql(v: str, lo: float, hi: float) -> str:
    return f"greatest(0.0::DOUBLE, least(({v} - {lo}::DOUBLE) / {hi - lo!r}::DOUBLE, 1.0::DOUBLE))"


def _range_sql(v: str, a: float, b: float, c: float, d: float) -> str:
    return f"CASE WHEN {v} <= {a!r}::DOUBLE OR {v} >= {d!r}::DOUBLE THEN 0.0 WHEN {v} < {b!r}::DOUBLE THEN ({v} - {a!r}::DOUBLE) / {b - a!r}::DOUBLE WHEN {v} > {c!r}::DOUBLE THEN ({d!r}::DOUBLE - {v}) / {d - c!r}::DOUBLE ELSE 1.0 END"


@query(
    f"""{WITH}, f AS (SELECT detection_id, quality AS q, confidence AS c, (x_max - x_min) / (y_max - y_min)::DOUBLE AS aspect, (x_max - x_min) * (y_max - y_min) / 2073600::DOUBLE AS area, y_min / 1080::DOUBLE AS y FROM detections)
SELECT detection_id, round(greatest(0.0, least(0.22 * {_ramp_sql('q', 0.45, 0.98)} + 0.18 * {_range_sql('aspect', 1.5, 2.2, 6.2, 9.5)} + 0.08 * {_range_sql('area', 0.00008, 0.0004, 0.03, 0.12)} + 0.14 * {_ramp_sql('c', 0.18, 0.82)}
  + 0.10 * {_ramp_sql('q * c', 0.01, 0.16)} + 0.12 * {_ramp_sql('c / 5', 0.02, 0.18)} + 0.12 * greatest(0.0, least(1 - q, 1.0)) + 0.06 * {_range_sql('y', 0.0, 0.35, 0.88, 1.0)} - 0.10 * {_ramp_sql('q', 0.10, 0.70)}, 1.0)), 6) AS score,
  least(CASE detection_id % 3 WHEN 0 THEN 0.68 WHEN 1 THEN 0.78 ELSE 0.82 END + CASE detection_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.10 WHEN 2 THEN 0.08 ELSE 0.04 END, 0.95)::DOUBLE AS decoder_confidence FROM f"""
)
def region_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much regions look like tags, and the confidence of decoders on variants."""
    b, q, c, i = F.col("bbox"), F.col("quality"), F.col("confidence"), F.col("detection_id")
    f = {
        "rectangularity": q, "aspect_ratio": G.width(b) / G.height(b), "area_ratio": G.area(b) / 2_073_600.0, "white_ratio": c, "accent_ratio": q * c, "edge_density": c / 5, "text_like": 1 - q, "center_y": b["y_min"] / 1080.0, "glare_ratio": q,
    }
    decoder = F.element_at(F.array(F.lit("opencv_qr_detector"), F.lit("pyzbar"), F.lit("zxingcpp")), (i % 3 + 1).cast("int"))
    variant = F.element_at(F.array(F.lit("original"), F.lit("resized_x4"), F.lit("rotated_90"), F.lit("tilt_5")), (i % 4 + 1).cast("int"))
    return detections(spark, sf_dir).select(i, F.round(K.candidate_score(f), 6).alias("score"), F.round(K.decoder_confidence(decoder, variant), 6).alias("decoder_confidence"))


@query(
    f"""{WITH}, z(zone, x1, y1, x2, y2) AS (VALUES {', '.join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in K.ZONES.items())}), w AS (SELECT detection_id, x_max - x_min AS w, y_max - y_min AS h FROM detections)
SELECT detection_id, zone, floor(greatest(0.0::DOUBLE, 0.097 + 0.806::DOUBLE * x1 - 0.025) * w)::INT AS x_min, floor(greatest(0.0::DOUBLE, 0.097 + 0.806::DOUBLE * y1 - 0.025) * h)::INT AS y_min,
  greatest(floor(least(1.0::DOUBLE, 0.097 + 0.806::DOUBLE * x2 + 0.025) * w)::INT, x_min + 1) AS x_max, greatest(floor(least(1.0::DOUBLE, 0.097 + 0.806::DOUBLE * y2 + 0.025) * h)::INT, y_min + 1) AS y_max FROM w, z"""
)
def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of each zone of each crop."""
    d = detections(spark, sf_dir).select("detection_id", G.width(F.col("bbox")).alias("w"), G.height(F.col("bbox")).alias("h"))
    return K.zone_boxes(d, "detection_id", "w", "h").select("detection_id", "zone", "bbox.*")


@query(
    f"""{WITH}, f AS (SELECT video, detection_id AS frame_index, timestamp_ms, CASE WHEN detection_id % 10 = 0 THEN NULL ELSE quality * 60 END AS motion FROM detections),
s AS (SELECT * FROM f WHERE frame_index % 30 = 0 OR (frame_index % 6 = 0 AND (motion IS NULL OR motion <= 24.0)))
SELECT video, count(*) AS n, min(frame_index) AS first_index, max(frame_index) AS last_index, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM s GROUP BY video"""
)
def motion_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the frames that a sparse rhythm, or a dense one where little moves, takes."""
    i = F.col("detection_id")
    f = detections(spark, sf_dir).select("video", i.alias("frame_index"), "timestamp_ms", F.when(i % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("quality") * 60).alias("motion"))
    return K.manifest(K.motion_sampled(f, "frame_index", "motion", 30.0, 5.0, 1.0), "video", "frame_index", "timestamp_ms").drop("checksum")


@query(
    f"""{WITH}, bounds AS (SELECT video, max(detection_id) AS most FROM detections GROUP BY video), t AS (SELECT video, detection_id AS target, detection_id + 2 AS i FROM detections)
SELECT target, CASE WHEN i > most THEN 'out_of_range' WHEN d.detection_id IS NOT NULL THEN 'found' ELSE 'missing' END AS status, coalesce(d.timestamp_ms, -1) AS timestamp_ms FROM t JOIN bounds USING (video) LEFT JOIN detections d ON d.video = t.video AND d.detection_id = t.i"""
)
def frames_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by number, with bounds."""
    d = detections(spark, sf_dir)
    t = d.select("video", F.col("detection_id").alias("target"), (F.col("detection_id") + 2).alias("i"))
    return K.frames_at(t, d.select("video", F.col("detection_id").alias("i"), "timestamp_ms"), "video", "i").select("target", "status", F.coalesce("timestamp_ms", F.lit(-1)).alias("timestamp_ms"))


@query(f"{WITH} SELECT detection_id, printf('det_%06d_%03d', timestamp_ms // {HOUR}, row_number() OVER (PARTITION BY video, timestamp_ms // {HOUR} ORDER BY confidence DESC, detection_id)) AS made_id FROM detections")
def frame_rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from a frame and the rank inside it."""
    d = detections(spark, sf_dir).withColumn("frame", F.expr(f"timestamp_ms div {HOUR}"))
    return K.frame_rank_ids(d, "det", ["video", "frame"], [F.desc("confidence"), F.col("detection_id")]).select("detection_id", "made_id")


@query(
    f"""WITH {TRACKS_SQL}, t AS (SELECT * REPLACE (first_ms - {GAP} AS first_ms, last_ms + {GAP} AS last_ms), n_detections <= 1 AS loose FROM tracks)
SELECT a.video, a.track_id, b.track_id AS r_track_id, round({IOU}, 6) AS iou FROM t a JOIN t b ON a.video = b.video AND a.loose AND NOT b.loose AND a.first_ms <= b.last_ms AND b.first_ms <= a.last_ms
WHERE {IOU} >= 0.3 AND abs((a.y_min + a.y_max) / 2.0 - (b.y_min + b.y_max) / 2.0) / greatest(1.0, (a.y_max - a.y_min + b.y_max - b.y_min) / 2) <= 0.35
  AND least((a.x_max - a.x_min) * (a.y_max - a.y_min), (b.x_max - b.x_min) * (b.y_max - b.y_min)) / greatest((a.x_max - a.x_min) * (a.y_max - a.y_min), (b.x_max - b.x_min) * (b.y_max - b.y_min)) >= 0.45"""
)
def overlap_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short untracked fragments inside a longer one's time and place."""
    t = track_table(spark, sf_dir).withColumns({"loose": F.col("n_detections") <= 1, "first_ms": F.col("first_ms") - GAP, "last_ms": F.col("last_ms") + GAP})
    return spatial.absorbed(t, "video", "track_id", "first_ms", "last_ms", "median_box", "loose", "n_detections", 128, 0.3).select("video", "track_id", "r_track_id", F.round("iou", 6).alias("iou"))


SIDE_SQL = f"""{SCORED_SQL}, decided AS (SELECT *, CASE WHEN NOT located THEN 'no_bbox' WHEN k THEN 'match_key' WHEN NOT (named OR sku OR card OR d) THEN 'no_evidence'
  WHEN round(confidence, 4) >= 0.40 THEN 'confidence' ELSE 'low_confidence' END AS why FROM scored),
flagged AS (SELECT *, bool_or(why IN ('match_key', 'confidence') AND k AND named) OVER (PARTITION BY filename) AS beside FROM decided),
raised AS (SELECT *, why IN ('match_key', 'confidence') AND beside AND NOT k AND NOT named AND NOT sku AND (card OR d) AND round(confidence, 4) < 0.45 AS weak FROM flagged),
side AS (SELECT p_partkey, filename, k, named, round(confidence, 4) AS confidence, why IN ('match_key', 'confidence') AND NOT weak AS keep, keep AND p_partkey % 8 <> 0 AS emitted,
  CASE WHEN emitted THEN '' WHEN keep THEN 'deduped' WHEN weak THEN 'weak_price_only_beside_identity' ELSE why END AS suppressed_reason FROM raised)"""


def _side_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated rows, every eighth of which counts as a duplicate."""
    g = stored(gate.gated(output_rows(spark, sf_dir), ["filename"]), "gated")  # read by the dedup, the side-car and the summary
    return reports.gate_side_car(g, g.where(f"keep and {P} % 8 <> 0").select(P), P)


@query(f"WITH {SIDE_SQL} SELECT p_partkey, confidence, emitted, suppressed_reason FROM side")
def gate_side_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with why it wasn't written."""
    return _side_car(spark, sf_dir).select(P, "confidence", "emitted", "suppressed_reason")


@query(
    f"""WITH {SIDE_SQL} SELECT count(*) AS input_rows, count(*) FILTER (WHERE keep) AS gated_rows, count(*) FILTER (WHERE emitted) AS kept_rows, count(*) FILTER (WHERE NOT keep) AS suppressed_rows, count(*) FILTER (WHERE keep AND NOT emitted) AS deduped_rows,
  count(*) FILTER (WHERE suppressed_reason = 'weak_price_only_beside_identity') AS identity_present_suppressed_rows, count(*) FILTER (WHERE emitted AND k AND named) AS identity_rows,
  count(*) FILTER (WHERE emitted AND confidence >= 0.6) AS high_confidence_rows, round(coalesce(avg(confidence::DECIMAL(18,6)) FILTER (WHERE emitted), 0)::DOUBLE, 4) AS mean_confidence FROM side"""
)
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gate_summary(_side_car(spark, sf_dir))


@query(
    f"""WITH {CODES_SQL}, m AS (SELECT {P}, true_code, code, p_name, {P} % 3 AS w, {ean_ok_sql('code')} AS ok FROM codes), r AS (SELECT *, ok AND code = true_code AS sure FROM m)
SELECT {P}, CASE WHEN w = 0 AND NOT sure THEN 'catalog_guess' WHEN w = 0 THEN 'confirmed' ELSE 'catalog_guess' END AS status, CASE WHEN w = 0 AND sure THEN p_name END AS product_name, CASE WHEN w = 0 AND sure THEN true_code END AS barcode,
  CASE WHEN NOT (w = 0 AND sure) THEN p_name END AS guess_name, CASE WHEN NOT (w = 0 AND sure) THEN true_code END AS guess_barcode, CASE WHEN w = 0 THEN CASE WHEN sure THEN 'visual_barcode_or_qr' ELSE 'catalog_inferred' END END AS key_source,
  CASE WHEN w = 0 AND NOT sure THEN 'no_reliable_barcode' END AS withheld FROM r WHERE w < 2"""
)
def catalog_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches confirmed by a code that was seen, or given as guesses; queries without a match have no fields."""
    c = codes(spark, sf_dir)
    w = F.col(P) % 3
    match = {
        "accepted": w == 0, "status": F.when(w == 0, F.lit("confirmed")).otherwise(F.lit("catalog_guess")), "product_name": F.col("p_name"), "guess_name": F.when(w == 1, F.col("p_name")).otherwise(F.lit("")),
        "barcode": F.when(w == 0, F.col("true_code")).otherwise(F.lit("")), "candidate_codes": F.array("true_code"), "score": F.lit(9.5), "margin": F.lit(2.25),
    }
    d = c.select(P, grouping.identity_fields(match, F.col("code")).alias("f")).where("f is not null")
    names = {"status": "catalog_match_status", "product_name": "product_name", "barcode": "barcode", "guess_name": "catalog_guess_name", "guess_barcode": "catalog_guess_barcode", "key_source": "catalog_key_source", "withheld": "catalog_withheld_reason"}
    return d.select(P, *[F.col("f")[n].alias(k) for k, n in names.items()])


@query(
    f"""WITH {ROWS_SQL}, n AS (SELECT filename, barcode, count(*) AS n FROM rows_of WHERE barcode <> '' GROUP BY ALL)
SELECT p_partkey, coalesce(n, 0) AS n_same_code FROM rows_of LEFT JOIN n USING (filename, barcode)"""
)
def code_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.multiplicity(output_rows(spark, sf_dir), "filename", "barcode").select(P, F.col("n_same_code"))


@query(
    f"""WITH {ROWS_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE product_name NOT IN ('', 'нет')) AS product_name_filled, count(*) FILTER (WHERE barcode <> '') AS barcode_filled, count(*) FILTER (WHERE price_card <> '') AS price_card_filled, count(*) FILTER (WHERE color <> 'нет') AS color_filled FROM rows_of"""
)
def filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filled_counts(output_rows(spark, sf_dir), ["product_name", "barcode", "price_card", "color"], ("", "нет", "none", "n/a", "-"))


@query(
    f"""WITH {ROWS_SQL}, v AS (SELECT p_partkey, p_partkey % 4 AS m, coalesce(try_cast(x_min AS DOUBLE), 0) AS x, (p_partkey % 5) * 1.5 AS t FROM rows_of)
SELECT p_partkey, row_number() OVER (PARTITION BY m ORDER BY floor(t), floor(x), 20, p_partkey) AS whole, row_number() OVER (PARTITION BY m ORDER BY t, x, 20, p_partkey) AS exact FROM v"""
)
def row_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows by time and box, cut to whole numbers and not."""
    from pyspark.sql.window import Window

    r = output_rows(spark, sf_dir).withColumn("frame_timestamp", ((F.col(P) % 5) * 1.5).cast("string"))
    place = lambda whole: F.row_number().over(Window.partitionBy(F.col(P) % 4).orderBy(*reports.row_keys(whole), P)).cast("long")
    return r.select(P, place(True).alias("whole"), place(False).alias("exact"))


@query(
    f"""{WITH} SELECT 'time' AS kind, video::VARCHAR AS g, timestamp_ms AS h, count(*) AS n, string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) AS items FROM detections GROUP BY ALL
UNION ALL SELECT 'name', CASE WHEN video = 3 THEN 'unknown' ELSE 'v' || video || '.mp4' END, 0, count(*), string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) FROM detections GROUP BY ALL
UNION ALL SELECT 'sure', track_id::VARCHAR, 0, count(*), string_agg(detection_id::VARCHAR, ',' ORDER BY confidence DESC, detection_id) FROM detections GROUP BY ALL"""
)
def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by time, by the name of their video, and by track with the surest first."""
    d = detections(spark, sf_dir)
    named = d.withColumn("g", reports.video_name(F.when(F.col("video") == 3, F.lit(" ")).otherwise(F.concat(F.lit("in\\day/v"), F.col("video").cast("string"), F.lit(".mp4")))))
    parts = [
        reports.grouped(d, ["video", "timestamp_ms"], "detection_id", "detection_id").select(F.lit("time").alias("kind"), F.col("video").cast("string").alias("g"), F.col("timestamp_ms").alias("h"), "n", "items"),
        reports.grouped(named, ["g"], "detection_id", "detection_id").select(F.lit("name").alias("kind"), "g", F.lit(0).cast("long").alias("h"), "n", "items"),
        reports.grouped(d, ["track_id"], "detection_id", "detection_id", F.col("confidence")).select(F.lit("sure").alias("kind"), F.col("track_id").cast("string").alias("g"), F.lit(0).cast("long").alias("h"), "n", "items"),
    ]
    return reports.union_of_columns(parts).withColumn("items", F.array_join("items", ","))


@query(
    f"""{WITH} SELECT coalesce(video, -1) AS video, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS boxes, count(DISTINCT timestamp_ms // {HOUR}) AS images
FROM (SELECT *, CASE WHEN detection_id % 7 = 0 THEN 'val' ELSE 'train' END AS split FROM detections) GROUP BY ROLLUP (video, split)"""
)
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and images by video and split, with totals."""
    d = detections(spark, sf_dir).withColumns({"split": F.when(F.col("detection_id") % 7 == 0, F.lit("val")).otherwise(F.lit("train")), "image": F.expr(f"timestamp_ms div {HOUR}")})
    r = reports.dataset_report(d, "video", "split", "image")
    return r.select(F.coalesce("video", F.lit(-1)).alias("video"), F.coalesce("split", F.lit("all")).alias("split"), "boxes", "images")


@query(
    """WITH RECURSIVE pairs AS (SELECT p_partkey AS t, p_partkey + p_partkey % 2 AS e, p_name AS n FROM part), j AS (SELECT t, e, n, p_name AS m, t % 3 = 0 AS coded, (t % 5) / 5.0 AS iou, t % 4 <> 0 AS same FROM pairs JOIN part ON p_partkey = e),
names AS (SELECT *, array_to_string(list_sort(string_split(n, ' ')), ' ') AS x, array_to_string(list_sort(string_split(m, ' ')), ' ') AS y FROM j),
walk AS (SELECT t, x, y, 0 AS i, (1::HUGEINT << length(x)) - 1 AS row FROM names
  UNION ALL SELECT t, x, y, i + 1, ((row + (row & hit)) | (row - (row & hit))) & ((1::HUGEINT << length(x)) - 1) FROM (
    SELECT *, list_sum([CASE WHEN x[k] = y[i + 1] THEN 1::HUGEINT << (k - 1)::INT ELSE 0::HUGEINT END for k in range(1, length(x) + 1)])::HUGEINT AS hit FROM walk WHERE i < length(y))),
common AS (SELECT t, 2 * (length(x) - bit_count(row)) / (length(x) + length(y))::DOUBLE AS r FROM walk WHERE i = length(y)),
scored AS (SELECT t, e, iou, same, CASE WHEN same THEN 8 ELSE 0 END + CASE WHEN same AND iou >= 0.18 THEN 35 + 80 * iou ELSE 0 END + CASE WHEN coded AND t = e THEN 110 ELSE 0 END + CASE WHEN t % 2 = 0 THEN 36 ELSE 0 END + 5 + CASE WHEN r >= 0.55 THEN 35 * r ELSE 0 END AS s FROM names JOIN common USING (t))
SELECT t, e, round(s, 4)::DOUBLE AS score, CASE WHEN same AND iou >= 0.18 THEN iou >= 0.5 OR s >= 2 ELSE s >= 45 AND s >= 8 END AS accepted FROM scored"""
)
def row_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored against the entry that they belong to, or its neighbour, by the earlier rule."""
    p = load(spark, sf_dir, "part").select(P, "p_name")
    k = F.col(P)
    j = p.join(p.toDF("e", "e_product_name"), F.col("e") == k + k % 2)
    code = lambda c: F.when(k % 3 == 0, c.cast("string")).otherwise(F.lit(""))
    blank = ("qr_code_barcode", "id_sku", "price_default", "price1_qr", "price2_qr", "price4_qr", "discount_amount", "special_symbols")
    j = j.select(
        k.alias("t"), "e", F.col("p_name").alias("t_product_name"), "e_product_name", code(k).alias("t_barcode"), code(F.col("e")).alias("e_barcode"), F.lit("10,00").alias("t_price_card"), F.when(k % 2 == 0, F.lit("10")).otherwise(F.lit("11")).alias("e_price_card"),
        F.lit("Red").alias("t_color"), F.lit("red ").alias("e_color"), *[F.lit("").alias(f"{s}_{f}") for s in "te" for f in blank], ((k % 5) / 5.0).alias("iou"), (k % 4 != 0).alias("same_file"),
    )
    scored = j.withColumn("score", score.row_score(F.col("same_file"), F.col("iou"))["score"])
    return score.best_entries(scored, "t", "e").select("t", "e", F.round("score", 4).alias("score"), "accepted")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS product_name, CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE 'x' || p_partkey END AS barcode, CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE 'x' || p_partkey END AS qr_code_barcode,
  CASE WHEN p_partkey % 5 = 0 THEN 'red' ELSE 'blue' END AS color, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END) AS n_changed FROM part"""
)
def backfilled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filled from reference rows, with the number of cells that changed."""
    k = F.col(P)
    p = load(spark, sf_dir, "part").select(
        P, F.col("p_type").alias("r_product_name"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("e_product_name"), F.when(k % 3 == 0, F.lit("8")).otherwise(F.lit("")).alias("r_barcode"),
        F.when(k % 3 == 0, F.lit("9")).otherwise(F.lit("")).alias("e_barcode"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("r_qr_code_barcode"), F.lit("").alias("e_qr_code_barcode"),
        F.lit("red").alias("r_color"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("blue")).alias("e_color"),
    )
    return reports.backfilled(p, ["product_name", "barcode", "qr_code_barcode", "color"])


@query(
    f"""WITH {PAYLOADS_SQL}, new AS (SELECT p_partkey, p_partkey // 6 AS crop, payload AS p FROM payloads UNION ALL SELECT p_partkey + 1000000, p_partkey // 6, payload FROM payloads)
SELECT crop, p AS payload, min(p_partkey) AS ord FROM new WHERE NOT EXISTS (SELECT 1 FROM payloads o WHERE o.p_partkey % 5 = 0 AND o.payload = p AND o.p_partkey // 6 = crop) GROUP BY ALL"""
)
def symbols_without_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New symbols, each once, that a crop doesn't have yet."""
    p = payloads(spark, sf_dir).select(F.col(P).alias("ord"), F.expr(f"{P} div 6").alias("crop"), "payload")
    return grouping.without_existing(p.unionByName(p.withColumn("ord", F.col("ord") + 1_000_000)), p.where("ord % 5 = 0"), ["crop", "payload"], "ord")


@query(
    f"""{WITH}, a AS (SELECT video, track_id, detection_id FROM detections WHERE label = 'purchase' AND quality > 0.5), b AS (SELECT video, track_id, detection_id FROM detections WHERE label = 'view')
SELECT track_id, detection_id FROM a UNION ALL SELECT track_id, detection_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.track_id = b.track_id)"""
)
def fallback_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second detector's boxes where the first found none."""
    d = detections(spark, sf_dir)
    return reports.fallback(d.where("label = 'purchase' and quality > 0.5").select("track_id", "detection_id"), d.where("label = 'view'").select("track_id", "detection_id"), ["track_id"])


@query(
    """WITH r AS (SELECT p_partkey, [lower(p_brand), lower(p_type), p_partkey::VARCHAR] AS ks FROM part), w AS (SELECT DISTINCT unnest(['brand#11', 'brand#23', '17', '40']) AS k)
SELECT p_partkey FROM r WHERE len(list_intersect(ks, (SELECT list(k) FROM w))) > 0"""
)
def entries_sharing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries any of whose names is wanted."""
    p = load(spark, sf_dir, "part")
    wanted = spark.range(1).select(F.array(*map(F.lit, ("brand#11", "brand#23", "17", "40"))).alias("w"))
    keyed = p.select(P, F.array(F.lower("p_brand"), F.lower("p_type"), F.col(P).cast("string")).alias("ks"))
    return reports.sharing_keys(keyed, "ks", wanted, "w").select(P)


@query(
    f"""WITH {OBSERVED_SQL}, known AS (SELECT DISTINCT track_id // 100 AS n FROM detections WHERE label = 'purchase' AND quality > 0.8) SELECT DISTINCT track_id // 100 AS n FROM detections WHERE track_id // 100 NOT IN (SELECT n FROM known)"""
)
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select(F.expr("track_id div 100").alias("n"), "label", "quality")
    return reports.unknown_names(d, d.where("label = 'purchase' and quality > 0.8"), "n")


@query(
    """WITH r AS (SELECT p_partkey, ['zxingcpp', 'pyzbar', 'zxingcpp_qr_only', 'opencv_qr_detector'][p_partkey % 4 + 1] AS decoder FROM part)
SELECT p_partkey, decoder FROM r WHERE decoder IN ('zxingcpp_qr_only', 'opencv_qr_detector')"""
)
def zone_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder runs of zones, where a QR-only decoder takes the generic one's place; all variants are allowed."""
    p = load(spark, sf_dir, "part").select(P, F.element_at(F.array(*map(F.lit, ("zxingcpp", "pyzbar", "zxingcpp_qr_only", "opencv_qr_detector"))), (F.col(P) % 4 + 1).cast("int")).alias("decoder"))
    return reports.allowed(reports.zone_decoders(p), "decoder", []).where("decoder = reads_as").drop("reads_as")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'color=' || p_type || ';name=' || p_name ELSE 'color=' || p_brand || ';name=' || p_name || ';size=' || p_size END AS fields,
  CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n_rows FROM part"""
)
def merged_maps_and_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of which the left one counts, and the rows of preview documents of four shapes."""
    k = F.col(P)
    left = F.when(k % 2 == 0, F.create_map(F.lit("name"), F.col("p_name"), F.lit("color"), F.col("p_type"))).otherwise(F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string")))
    right = F.create_map(F.lit("name"), F.lit("other"), F.lit("color"), F.col("p_brand"))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries(reports.merged_left(left, right))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    json = F.element_at(F.array(*map(F.lit, ('[{"a": 1}, {"a": 2}]', '{"rows": [{"a": 1}, {"b": [2]}]}', '{"stats": {"rows": 2}}', '{"data": [7]}'))), (k % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(P, merged.alias("fields"), F.size(reports.preview_rows(json)).alias("n_rows"))


@query(
    f"""{WITH}, b AS (SELECT track_id, quality, detection_id, CASE WHEN detection_id % 3 = 0 THEN 'EAN 4600000' || lpad((detection_id % 100000)::VARCHAR, 5, '0') ELSE 'x' || detection_id END AS t FROM detections)
SELECT track_id, string_agg(t, '|' ORDER BY quality DESC, detection_id) AS texts, coalesce(arg_min('4600000' || lpad((detection_id % 100000)::VARCHAR, 5, '0'), (-quality, detection_id)) FILTER (WHERE detection_id % 3 = 0), '') AS hint FROM b GROUP BY track_id"""
)
def pooled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's blocks of text, the best crop's first, and the first code among them."""
    i = F.col("detection_id")
    b = detections(spark, sf_dir).select("track_id", "quality", i, F.when(i % 3 == 0, F.concat(F.lit("EAN 4600000"), F.lpad((i % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("x"), i.cast("string"))).alias("t"))
    return grouping.pooled(b, "track_id", "quality", "detection_id", "t").withColumn("texts", F.array_join("texts", "|"))


@query(f"{WITH}, s AS (SELECT track_id, min(detection_id) AS stop FROM detections WHERE quality > 0.6 GROUP BY track_id) SELECT track_id, detection_id FROM detections LEFT JOIN s USING (track_id) WHERE stop IS NULL OR detection_id <= stop")
def attempts_to_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode attempts of each track up to the first that succeeded."""
    d = detections(spark, sf_dir).select("track_id", "detection_id", (F.col("quality") > 0.6).alias("ok"))
    return grouping.first_success(d, ["track_id"], "detection_id", "ok").select("track_id", "detection_id")


@query(
    f"""WITH {TRACKS_SQL}, s AS (SELECT track_id, 'slot_' || (track_id // 300) AS slot FROM tracks WHERE track_id % 3 <> 0)
SELECT detection_id, coalesce(slot, d.track_id::VARCHAR) AS track_id, d.track_id AS source_track_id FROM detections d LEFT JOIN s ON s.track_id = d.track_id"""
)
def slots_on_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their slot as track."""
    slots = track_table(spark, sf_dir).where("track_id % 3 <> 0").select("track_id", F.concat(F.lit("slot_"), F.expr("track_id div 300").cast("string")).alias("slot"))
    return tracks.renamed(detections(spark, sf_dir), slots, "track_id").select("detection_id", "track_id", "source_track_id")


LENS = K.Camera.of_lens(3840, 2160, 2.8, 16.0 / 2.8, (-0.02, 0.003, 0.0004, -0.0006, -0.0001))


def _lens_sql() -> str:
    (fx, fy), (mx, my), (k1, k2, p1, p2, k3) = LENS.focus, LENS.middle, LENS.distortion
    u, v = f"((3840 - y - {mx}) / {fx!r}::DOUBLE)", f"((x - {my}) / {fy!r}::DOUBLE)"
    return f"""p AS (SELECT detection_id, {u} AS u, {v} AS v FROM (SELECT detection_id, unnest([x_min, x_max, x_max, x_min]) AS x, unnest([y_min, y_min, y_max, y_max]) AS y FROM detections)),
q AS (SELECT *, u * u + v * v AS r FROM p), d AS (SELECT detection_id, u * (1 + r * ({k1} + r * ({k2} + r * {k3}))) + 2 * {p1} * u * v + {p2} * (r + 2 * u * u) AS a, v * (1 + r * ({k1} + r * ({k2} + r * {k3}))) + {p1} * (r + 2 * v * v) + 2 * {p2} * u * v AS b FROM q),
e AS (SELECT detection_id, greatest(0, least(a * {fx!r}::DOUBLE + {mx}, 3839)) AS a, greatest(0, least(b * {fy!r}::DOUBLE + {my}, 2159)) AS b FROM d)"""


@query(f"{WITH}, {_lens_sql()} SELECT detection_id, round(min(a), 3) AS x_min, round(min(b), 3) AS y_min, round(max(a), 3) AS x_max, round(max(b), 3) AS y_max FROM e GROUP BY detection_id")
def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the straightened, turned picture in the camera's own one."""
    d = LENS.to_raw(detections(spark, sf_dir), "bbox", "raw")
    return d.select("detection_id", *[F.round(F.col("raw")[c], 3).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


@query(
    f"""{WITH}, b AS (SELECT track_id, detection_id, quality AS y, confidence AS x FROM detections), fine AS (SELECT track_id, string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) AS fine FROM b WHERE y >= 0.6 GROUP BY track_id),
name AS (SELECT track_id, string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) AS name FROM b WHERE y >= 0.03 AND y < 0.46 AND x < 0.7 GROUP BY track_id)
SELECT track_id, coalesce(fine, '') AS fine, coalesce(name, '') AS name FROM fine FULL JOIN name USING (track_id)"""
)
def band_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the fine print and of the name's band of each crop."""
    b = detections(spark, sf_dir).select("track_id", F.col("detection_id").alias("ord"), F.col("detection_id").cast("string").alias("text"), F.col("quality").alias("rel_y"), F.col("confidence").alias("rel_x"))
    of = lambda band, name: K.band_texts(b, "track_id", band).select("track_id", F.array_join("texts", ",").alias(name))
    j = of(K.FINE_PRINT, "fine").join(of(K.NAME_BAND, "name"), "track_id", "full")
    return j.select("track_id", F.coalesce("fine", F.lit("")).alias("fine"), F.coalesce("name", F.lit("")).alias("name"))


@query(
    f"""WITH {SCORED_SQL}, m AS (SELECT p_partkey, CASE WHEN round(confidence, 4) >= 0.6 THEN 'high' WHEN round(confidence, 4) >= 0.3 THEN 'medium' ELSE 'low' END AS tier, named, p_partkey % 5 <> 0 AS truth, p_partkey % 6 <> 0 AS same FROM scored)
SELECT tier, count(*) AS n, count(*) FILTER (WHERE named AND truth) AS named, count(*) FILTER (WHERE named AND truth AND same) AS "right", round(count(*) FILTER (WHERE named AND truth AND same) / nullif(count(*) FILTER (WHERE named AND truth), 0), 4) AS precision FROM m GROUP BY tier"""
)
def name_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of matched rows by tier, and how many are right."""
    d, f = gate.with_facts(output_rows(spark, sf_dir))
    r = d.withColumn("c", gate.confidence(f))
    m = r.select(P, F.col("c.tier").alias("tier"), F.col("product_name").alias("p_product_name"), F.when(F.col(P) % 5 != 0, F.when(F.col(P) % 6 != 0, F.col("product_name")).otherwise(F.lit("zz"))).otherwise(F.lit("нет")).alias("t_product_name"))
    return reports.name_precision(m, F.col("p_product_name") == F.col("t_product_name"), "tier")


@query(
    f"""{WITH}, b AS (SELECT track_id, detection_id AS o, quality AS y, CASE WHEN detection_id % 3 = 0 THEN lpad((detection_id % 90 + 10)::VARCHAR, 2, '0') END AS two FROM detections),
c AS (SELECT track_id, arg_min(two, (abs(y - 0.3), o)) AS k, min(abs(y - 0.3)) AS far FROM b WHERE two IS NOT NULL AND two <> '99' GROUP BY track_id)
SELECT DISTINCT b.track_id, CASE WHEN far <= 0.16 THEN k ELSE '00' END AS kopecks FROM b LEFT JOIN c USING (track_id)"""
)
def default_kopecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kopecks of the default price by height alone."""
    i = F.col("detection_id")
    b = detections(spark, sf_dir).select("track_id", i.alias("ord"), F.col("quality").alias("rel_y"), F.when(i % 3 == 0, F.concat(F.lit("ц "), (i % 90 + 10).cast("string"))).otherwise(F.lit("1234 %")).alias("text"))
    return price_blocks.default_kopecks(b, "track_id", 0.3, "99")


@query(
    f"""{WITH}, best AS (SELECT * FROM detections WHERE quality >= 0.3 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, confidence DESC, detection_id) <= 3),
chosen AS (SELECT * FROM best ORDER BY quality DESC, confidence DESC, detection_id LIMIT 400) SELECT track_id, detection_id, row_number() OVER (ORDER BY timestamp_ms, detection_id)::INT AS place FROM chosen"""
)
def selected_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best crops of each track, four hundred in all, in the order of frames (the caps are the operator)."""
    order = [F.desc("quality"), F.desc("confidence"), F.col("detection_id")]
    d = detections(spark, sf_dir).where("quality >= 0.3")
    return ranking.selected(d, ["track_id"], order, 3, 400, [F.col("timestamp_ms"), F.col("detection_id")]).select("track_id", "detection_id", "place")


@query(
    f"""{WITH}, f AS (SELECT video, detection_id AS i, timestamp_ms, CASE WHEN detection_id % 10 = 0 THEN NULL ELSE quality * 60 END AS motion FROM detections)
SELECT video, row_number() OVER (PARTITION BY video ORDER BY i)::INT AS place, i AS frame_index, timestamp_ms, CASE WHEN i % 30 = 0 THEN 'sparse' ELSE 'dense' END AS tick FROM f WHERE i % 30 = 0 OR (i % 6 = 0 AND (motion IS NULL OR motion <= 24.0))"""
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's list: each frame that motion sampling takes, with its number, time and rhythm."""
    i = F.col("detection_id")
    f = detections(spark, sf_dir).select("video", i.alias("frame_index"), "timestamp_ms", F.when(i % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("quality") * 60).alias("motion"))
    return K.listed(K.motion_sampled(f, "frame_index", "motion", 30.0, 5.0, 1.0), "video", "frame_index").select("video", "place", "frame_index", "timestamp_ms", "tick")
