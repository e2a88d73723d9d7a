"""Rows of one thing brought together: detections, crops and symbols by track and by code; evidence and consensus per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, payload, prices, reading
from ..functions.text import digits, has_value, output_value, text_of
from . import votes
from .tracks import track_key

# Fields whose digits name a product, in the order in which they are asked.
KEY_FIELDS = ("barcode", "qr_code_barcode", "id_sku")


def symbol_track(symbols: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds `track_key` to symbols: their own track_id, else their detection's (`tracks`: detection_id, track_key), else the detection's id."""
    s = symbols.join(tracks.select("detection_id", F.col("track_key").alias("_of")), "detection_id", "left")
    own = F.nullif(F.trim(text_of(F.col("track_id"))), F.lit(""))
    return s.withColumn("track_key", F.coalesce(own, "_of", F.col("detection_id").cast("string"))).drop("_of")


def symbol_key(symbol_payload: Column) -> Column:
    """`barcode:<digits>` from a payload's code fields, or from a bare code of 12 or 13 digits; null if there is none."""
    fields = payload.parse(symbol_payload)
    own = F.get(F.filter(F.transform(F.array(fields["qr_code_barcode"], fields["barcode"]), lambda v: digits(F.coalesce(v, F.lit("")))), lambda d: d != ""), F.lit(0))
    bare = digits(symbol_payload)
    found = F.when(own.isNotNull(), own).when((F.size(fields) <= 0) & F.length(bare).isin(12, 13), bare)
    return F.concat(F.lit("barcode:"), found)


def text_key(fields: Column) -> Column:
    """`<field>:<digits>` of the first key field that was read; null if there is none."""
    found = [F.nullif(digits(F.coalesce(fields[f], F.lit(""))), F.lit("")) for f in KEY_FIELDS]
    return F.coalesce(*[F.concat(F.lit(f"{f}:"), d) for f, d in zip(KEY_FIELDS, found)])


def fusion_groups(detections: DataFrame, crops: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, id, group_key) of all detections, crops and symbols, and (group_key, best_detection).

    Each detection brings its crops and symbols into its track; symbols without a detection stand by their own code, else by the
    detection they name. Tracks that share a stable key (the surest symbol's, else the best crop's read one) become one group. The best
    detection has the best quality, by its worst crop, and the greatest confidence.
    Columns: detections (detection_id, track_id, confidence), crops (crop_id, detection_id, quality, fields), symbols (symbol_id, detection_id, payload, confidence).
    """
    d = detections.select("detection_id", track_key(F.col("track_id"), F.col("detection_id")).alias("_t"), "confidence")
    of = d.select("detection_id", "_t")
    c = crops.join(of, "detection_id").select("_t", "detection_id", F.lit("crop").alias("kind"), F.col("crop_id").cast("string").alias("id"), (-F.col("quality")).alias("rank"), text_key(F.col("fields")).alias("key"), F.lit(1).alias("turn"))
    s = symbols.join(of, "detection_id", "left").withColumn("_key", symbol_key(F.col("payload")))
    s = s.select(F.coalesce("_t", "_key", F.col("detection_id").cast("string")).alias("_t"), "detection_id", F.lit("symbol").alias("kind"), F.col("symbol_id").cast("string").alias("id"), (-F.col("confidence")).alias("rank"), F.col("_key").alias("key"), F.lit(0).alias("turn"))
    members = d.select("_t", "detection_id", F.lit("detection").alias("kind"), F.col("detection_id").cast("string").alias("id"), F.lit(0.0).alias("rank"), F.lit(None).cast("string").alias("key"), F.lit(2).alias("turn")).unionByName(c).unionByName(s)
    stable = members.where("key is not null").groupBy("_t").agg(F.min_by("key", F.struct("turn", "rank", "id")).alias("_stable"))
    grouped = members.join(stable, "_t", "left").withColumn("group_key", F.coalesce("_stable", "_t"))
    worst = crops.groupBy("detection_id").agg(F.min("quality").alias("_q"))
    best = grouped.where("kind = 'detection'").join(detections.select("detection_id", "confidence"), "detection_id").join(worst, "detection_id", "left")
    best = best.groupBy("group_key").agg(F.max_by("detection_id", F.struct(F.coalesce("_q", F.lit(0.0)), "confidence", -F.col("detection_id"))).alias("best_detection"))
    return grouped.select("kind", "id", "group_key"), best


def field_counts(detections: DataFrame, crops: DataFrame, symbols: DataFrame, track: str = "track_key") -> DataFrame:
    """track, field, value: the plurality of plain votes; symbols count three times. Ties go to colors, then texts, then symbols, in order of id.

    Columns: detections (detection_id, color), crops (crop_id, fields), symbols (symbol_id, payload), and the track in each.
    """
    color = detections.where(F.trim(text_of(F.col("color"))) != "").select(track, F.lit("color").alias("field"), F.trim("color").alias("value"), F.lit(1).alias("w"), F.col("detection_id").alias("o"))
    texts = crops.select(track, F.explode("fields").alias("field", "value"), F.lit(1).alias("w"), (F.lit(1 << 52) + F.col("crop_id")).alias("o"))
    read = payload.parse(F.col("payload"))
    bare = digits(F.col("payload"))
    fields = F.when(F.size(read) > 0, read).when(F.length(bare).isin(12, 13), F.create_map(F.lit("barcode"), bare))
    symbol = symbols.select(track, F.explode(fields).alias("field", "value"), F.lit(3).alias("w"), (F.lit(2 << 52) + F.col("symbol_id")).alias("o"))
    every = color.unionByName(texts).unionByName(symbol).where(has_value(F.col("value"))).withColumn("value", output_value(F.col("value")))
    per = every.groupBy(track, "field", "value").agg(F.sum("w").alias("w"), F.min("o").alias("o"))
    return per.groupBy(track, "field").agg(F.max_by("value", F.struct("w", -F.col("o"))).alias("value"))


def track_evidence(detections: DataFrame, crops: DataFrame, symbols: DataFrame, band: int = 220) -> DataFrame:
    """track_key, fields (map), order_x, shelf_band: voted fields, mean center and the shelf that it lies on. Detections need bbox, too."""
    b = F.col("bbox")
    place = detections.groupBy("track_key").agg(F.avg((b["x_min"] + b["x_max"]) / 2.0).alias("order_x"), F.avg((b["y_min"] + b["y_max"]) / 2.0).alias("_y"))
    maps = votes.as_maps(field_counts(detections, crops, symbols), ["track_key"])
    out = place.join(maps, "track_key", "left")
    return out.select("track_key", F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("fields"), "order_x", F.floor(F.col("_y") / band).cast("int").alias("shelf_band"))


def _price_form(value: Column) -> Column:
    v = F.regexp_replace(F.replace(F.replace(text_of(value), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast(prices.MONEY)
    return F.when(v.between(0, 100000), F.bround(v, 2).cast("decimal(18,2)").cast("string"))


def track_consensus(crops: DataFrame, symbols: DataFrame, price_fields: tuple[str, ...] = ("price_default", "price_card", "price1_qr", "price2_qr", "price4_qr")) -> DataFrame:
    """track_key, crop_id (the best crop), fields: what a track's readings agree on, over the crop's own fields.

    Codes by places among valid, completed and mended readings, stock numbers of 12 digits by places, prices and dates by their mode.
    Columns: crops (crop_id, track_key, quality, fields), symbols (symbol_id, symbol_type, track_key, payload).
    """
    texts = crops.select("track_key", F.explode("fields").alias("field", "value"), F.col("crop_id").alias("o")).where(F.trim("value") != "")
    bars = symbols.where("symbol_type = 'barcode'").select("track_key", F.lit("barcode").alias("field"), F.col("payload").alias("value"), (F.lit(1 << 52) + F.col("symbol_id")).alias("o"))
    known = crops.select("track_key").distinct()
    long = texts.unionByName(bars.join(known, "track_key", "left_semi"))
    code = votes.ean13_consensus(long.where(F.col("field").isin("barcode", "qr_code_barcode")).withColumn("o", F.col("o") + F.when(F.col("field") == "barcode", 0).otherwise(1 << 54)), ["track_key"], "value", "o")
    code = code.select("track_key", F.explode(F.array(F.lit("barcode"), F.lit("qr_code_barcode"))).alias("field"), F.col("code").alias("value"))
    sku = votes.position_consensus(long.where("field = 'id_sku'").withColumn("value", digits(F.col("value"))), ["track_key"], "value", "o", 12).select("track_key", F.lit("id_sku").alias("field"), "value")
    money = long.where(F.col("field").isin(list(price_fields))).withColumn("value", _price_form(F.col("value")))
    day = long.where("field = 'print_datetime'").withColumn("value", F.regexp_extract("value", r"\d{1,2}[.]\d{1,2}[.]\d{2,4}(?:\s+\d{1,2}:\d{2})?", 0))
    usual = votes.mode(money.unionByName(day), ["track_key", "field"], "value", "o").drop("n")
    agreed = votes.as_maps(code.unionByName(sku).unionByName(usual), ["track_key"]).withColumnRenamed("fields", "_agreed")
    best = crops.groupBy("track_key").agg(F.max_by(F.struct("crop_id", "fields"), F.struct("quality", -F.col("crop_id"))).alias("_b"))
    merged = F.map_concat(F.map_filter("_b.fields", lambda k, v: ~F.map_contains_key("_agreed", k)), F.col("_agreed"))
    return best.join(agreed, "track_key").select("track_key", F.col("_b.crop_id").alias("crop_id"), merged.alias("fields"))


def code_windows(text: Column) -> Column:
    """All digits of a text if they are 12 to 14, and the windows of 13 and of 12 of longer ones; each once."""
    d = digits(text)
    whole = F.when(F.length(d).between(12, 14), F.array(d)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, F.when(F.length(d) > 13, codes.digit_windows(text)).otherwise(F.array().cast("array<string>"))))


def read_codes(texts: DataFrame, catalog: DataFrame, key: str, value: str) -> DataFrame:
    """key, code, confidence, source of catalog codes that a text holds: exact (0.96), twelve digits completed (0.84), one digit mended (0.78).

    A window counts by the first of these that gives a code. `catalog` has a column `code`, each once.
    """
    w = texts.select(key, F.explode(code_windows(F.col(value))).alias("w"))
    exact = F.nullif(reading.catalog_code(F.col("w")), F.lit(""))
    full = F.when(F.length("w") == 12, F.concat("w", codes.check_digit(F.col("w"))))
    fixes = F.when(F.length("w") == 13, codes.one_digit_repairs(F.col("w")))
    made = F.concat(
        F.array(F.struct(F.lit(0).alias("i"), exact.alias("code"), F.lit(0.96).alias("confidence"), F.lit("ocr_exact_ean13").alias("source"))),
        F.array(F.struct(F.lit(1).alias("i"), full.alias("code"), F.lit(0.84).alias("confidence"), F.lit("ocr_12_plus_checksum").alias("source"))),
        F.coalesce(F.transform(fixes, lambda x, i: F.struct((i + 2).alias("i"), x.alias("code"), F.lit(0.78).alias("confidence"), F.lit("ocr_one_digit_repair").alias("source"))), F.array().cast("array<struct<i:int,code:string,confidence:double,source:string>>")),
    )
    tries = w.select(key, "w", F.explode(made).alias("x")).select(key, "w", "x.*").where("code is not null")
    known = tries.join(catalog.select("code"), "code")
    first = known.groupBy(key, "w").agg(F.min_by(F.struct("code", "confidence", "source"), "i").alias("_b"))
    return first.select(key, "_b.*")


def resolve_products(found: DataFrame, catalog: DataFrame, track: str) -> DataFrame:
    """track, barcode, product_name, confidence, source: the surest code that the catalog (code, name) names. `found`: track, code, confidence, source, ord."""
    named = found.join(catalog.select("code", "name").where("name <> ''"), "code")
    best = F.max_by(F.struct(F.col("code").alias("barcode"), F.col("name").alias("product_name"), F.round("confidence", 4).alias("confidence"), "source"), F.struct("confidence", -F.col("ord")))
    return named.groupBy(track).agg(best.alias("_b")).select(track, "_b.*")


def pooled(blocks: DataFrame, track: str, quality: str, ord: str, text: str) -> DataFrame:
    """track, texts (in the order of falling quality, then ord), hint: the first block with 12 or 13 digits."""
    item = F.struct((-F.col(quality)).alias("q"), F.col(ord).alias("o"), F.col(text).alias("t"))
    d = digits(F.col(text))
    hint = F.min_by(d, F.when(F.length(d).isin(12, 13), F.struct((-F.col(quality)).alias("q"), F.col(ord).alias("o"))))
    return blocks.groupBy(track).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("texts"), F.coalesce(hint, F.lit("")).alias("hint"))


def identity_fields(match: dict[str, Column], trusted_hint: Column) -> Column:
    """Map of a catalog match's output fields: name and codes where a trusted code confirms them, else a guess.

    `match`: accepted, status, product_name, guess_name, barcode, candidate_codes (array), score, margin.
    """
    m = match
    reliable = reliable_key(m["barcode"], m["candidate_codes"], trusted_hint)
    confirmed = m["accepted"] & reliable
    listed = F.array_join(m["candidate_codes"], ",")
    guessed = F.when(m["accepted"], m["product_name"]).otherwise(m["guess_name"])
    cells = {
        "catalog_match_status": F.when(m["accepted"] & ~reliable, F.lit("catalog_guess")).otherwise(m["status"]),
        "catalog_resolver_status": m["status"],
        "catalog_match_source": F.lit("catalog_resolver"),
        "catalog_match_score": F.format_string("%.3f", m["score"]),
        "catalog_match_margin": F.format_string("%.3f", m["margin"]),
        "catalog_candidate_codes": listed,
        "catalog_key_source": F.when(confirmed, F.lit("visual_barcode_or_qr")).when(m["accepted"], F.lit("catalog_inferred")),
        "catalog_withheld_reason": F.when(m["accepted"] & ~reliable, F.lit("no_reliable_barcode")),
        "product_name": F.when(confirmed, m["product_name"]),
        "barcode": F.when(confirmed, m["barcode"]),
        "qr_code_barcode": F.when(confirmed, m["barcode"]),
        "catalog_guess_name": F.when(~confirmed, guessed),
        "catalog_guess_barcode": F.when(~confirmed, F.when(m["accepted"], m["barcode"]).otherwise(F.get(m["candidate_codes"], F.lit(0)))),
    }
    flat = [x for k, v in cells.items() for x in (F.lit(k), v)]
    some = m["accepted"] | (F.coalesce(m["guess_name"], F.lit("")) != "")
    return F.when(some, F.map_filter(F.create_map(*flat), lambda k, v: F.coalesce(v != "", F.lit(False))))


def reliable_key(barcode: Column, candidate_codes: Column, hint: Column) -> Column:
    """Whether a valid code that was seen is one of the match's."""
    seen = codes.to_ean13(hint)
    return codes.ean13_ok(seen) & (F.array_contains(candidate_codes, seen) | (F.coalesce(barcode, F.lit("")) == seen))


def without_existing(found: DataFrame, existing: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """New rows whose keys no existing row has, the first of each."""
    fresh = found.join(existing.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), ord).alias("_b")).select(*keys, "_b.*")


def first_success(attempts: DataFrame, group: list[str], ord: str, ok: str) -> DataFrame:
    """The attempts of a group up to its first success, as an early stop leaves them."""
    first = attempts.where(F.col(ok)).groupBy(*group).agg(F.min(ord).alias("_stop"))
    return attempts.join(first, group, "left").where(F.col("_stop").isNull() | (F.col(ord) <= F.col("_stop"))).drop("_stop")
