"""Checks and reports: schema rules, allow lists, counts, side-car rows, gate and data set summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_value, output_value, text_of
from ..storage import stored

# Kinds of symbols, and decoders of a zone.
SYMBOL_TYPES = ("qr", "barcode", "unknown")
ZONE_DROPPED, ZONE_GENERIC, ZONE_QR_ONLY = "pyzbar", "zxingcpp", "zxingcpp_qr_only"


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(text_of(F.col(name))), F.lit("")) == ""


def _outside(c: Column, lo: float, hi: float | None = None) -> Column:
    bad = c < lo if hi is None else (c < lo) | (c > hi)
    return F.coalesce(bad, F.lit(True))


def violations(kind: str) -> dict[str, Column]:
    """The rules that rows of a kind (detection, crop, attempt, symbol) break, by name."""
    times = {
        "frame_index must be non-negative": _outside(F.col("frame_index"), 0),
        "timestamp_ms must be non-negative": F.coalesce(F.col("timestamp_ms") < 0, F.lit(False)),
    }
    named = lambda *names: {f"{n} must not be empty": _blank(n) for n in names}
    unit = lambda *names: {f"{n} must be from 0 to 1": _outside(F.col(n), 0, 1) for n in names}
    if kind == "detection":
        return named("detection_id", "label", "source") | times | unit("confidence")
    if kind == "crop":
        positive = {f"{n} must be positive": F.coalesce(F.col(n) <= 0, F.lit(True)) for n in ("width", "height")}
        return named("crop_id", "detection_id", "source") | times | positive | unit("glare_ratio", "area_ratio", "score")
    if kind == "attempt":
        return named("attempt_id", "crop_id", "decoder", "variant") | {"duration_ms must be non-negative": F.coalesce(F.col("duration_ms") < 0, F.lit(False))}
    if kind == "symbol":
        return named("symbol_id", "crop_id", "detection_id", "decoder", "variant", "payload") | times | unit("confidence") | {"symbol_type is unknown": ~F.coalesce(F.col("symbol_type").isin(*SYMBOL_TYPES), F.lit(False))}
    raise ValueError(f"no rules for {kind!r}")


def checked(df: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """Adds `violations`, the names of the rules that a row breaks; strict: such a row fails the query.

    Strict reads the rows twice, since the error gives the first row that breaks a rule, whichever task finds one sooner.
    """
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in violations(kind).items()]))
    out = df.withColumn("violations", found)
    if strict:
        broken = out.select("violations", F.monotonically_increasing_id().alias("at")).where(F.size("violations") > 0)
        first = broken.agg(F.min_by("violations", "at").alias("_first"))  # one row
        said = F.when(first["_first"].isNotNull(), F.raise_error(F.concat(F.lit(f"{kind}: "), F.array_join(first["_first"], "; "))))
        out = out.crossJoin(F.broadcast(first)).withColumn("violations", F.coalesce(said.cast("array<string>"), "violations")).drop(first["_first"])
    return out


def number(c: Column, strict: bool = False) -> Column:
    """A number with a comma or point; null if there is none. Strict: an empty or unreadable cell fails the query."""
    t = F.replace(F.trim(text_of(c)), F.lit(","), F.lit("."))
    v = t.try_cast("double")
    return F.coalesce(v, F.raise_error(F.concat(F.lit("no number: "), t)).cast("double")) if strict else v


def allowed(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose value is listed; an empty list allows all."""
    return df.where(F.col(column).isin(names)) if names else df


def zone_decoders(runners: DataFrame, name: str = "decoder") -> DataFrame:
    """Decoders that read zones: one is never used, and the generic one reads as QR-only, or goes where a QR-only one is there."""
    special = runners.where(F.col(name) == ZONE_QR_ONLY).select(F.lit(True).alias("_q")).limit(1)  # one row at most
    d = runners.where(F.col(name) != ZONE_DROPPED).join(F.broadcast(special), how="left")
    d = d.where(F.col("_q").isNull() | (F.col(name) != ZONE_GENERIC)).drop("_q")
    return d.withColumn("reads_as", F.when(F.col(name) == ZONE_GENERIC, F.lit(ZONE_QR_ONLY)).otherwise(F.col(name)))


def unknown_names(names: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Names, each once, that the known ones don't hold."""
    return names.select(column).distinct().join(known.select(column), column, "left_anti")


def fallback(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """All rows of the first, and rows of the second for groups of which the first has none; without `on`, only if the first is empty."""
    if not on:
        some = first.select(F.lit(True).alias("_some")).limit(1)
        return first.unionByName(second.join(F.broadcast(some), F.col("_some"), "left_anti"))  # one row at most
    return first.unionByName(second.join(first.select(*on).distinct(), on, "left_anti"))


def sharing_keys(rows: DataFrame, keys: str, wanted: DataFrame, wanted_keys: str) -> DataFrame:
    """Rows of which any key (array) is among the wanted ones."""
    flat = wanted.select(F.explode(wanted_keys).alias("_k")).distinct()
    hit = stored(rows.withColumn("_i", F.monotonically_increasing_id()), "numbered")  # numbers that stay, for both sides of the join
    found = hit.select("_i", F.explode(keys).alias("_k")).join(flat, "_k", "left_semi").select("_i").distinct()
    return hit.join(found, "_i", "left_semi").drop("_i")


def gate_side_car(decided: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Every input row with `emitted` and why it wasn't: the gate's reason, or `deduped`. `decided`: key, keep, reason, …; `emitted`: key."""
    j = decided.join(emitted.select(key).withColumn("_e", F.lit(True)), key, "left")
    out = F.coalesce("_e", F.lit(False))
    why = F.when(out, F.lit("")).when(F.col("keep"), F.lit("deduped")).otherwise(F.col("reason"))
    return j.withColumns({"emitted": out, "suppressed_reason": why}).drop("_e")


def gate_summary(side_car: DataFrame) -> DataFrame:
    """One row of counts over a side-car with confidence, tier, evidence (array), keep, emitted, suppressed_reason."""
    on = F.col("emitted")
    return side_car.agg(
        F.count("*").alias("input_rows"),
        F.count_if("keep").alias("gated_rows"),
        F.count_if(on).alias("kept_rows"),
        F.count_if(~F.col("keep")).alias("suppressed_rows"),
        F.count_if(F.col("keep") & ~on).alias("deduped_rows"),
        F.count_if(F.col("suppressed_reason") == "weak_price_only_beside_identity").alias("identity_present_suppressed_rows"),
        F.count_if(on & F.array_contains("evidence", "identity")).alias("identity_rows"),
        F.count_if(on & (F.col("confidence") >= 0.6)).alias("high_confidence_rows"),
        F.coalesce(F.round(F.avg(F.when(on, F.col("confidence").cast("decimal(18,6)"))).cast("double"), 4), F.lit(0.0)).alias("mean_confidence"),
    )


def rejected(symbols: DataFrame, reason: str) -> DataFrame:
    """The audit rows of symbols that a gate rejected."""
    return symbols.where(F.col(reason) != "").select("symbol_id", "crop_id", "detection_id", "symbol_type", "decoder", "variant", "payload", "confidence", F.col(reason).alias("reason"))


def name_precision(matches: DataFrame, similar: Column, tier: str) -> DataFrame:
    """Per tier: matches, those where both sides have a name, those where the names agree, and the share."""
    both = has_value(F.col("p_product_name"), ("", "нет")) & has_value(F.col("t_product_name"), ("", "нет"))
    g = matches.groupBy(tier).agg(F.count("*").alias("n"), F.count_if(both).alias("named"), F.count_if(both & similar).alias("right"))
    return g.withColumn("precision", F.round(F.try_divide("right", "named"), 4))


def filled_counts(rows: DataFrame, columns: list[str], empty: tuple[str, ...]) -> DataFrame:
    """One row: how many cells of each column say something."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(has_value(F.col(c), empty)).alias(f"{c}_filled") for c in columns])


def video_name(filename: Column) -> Column:
    """The last part of a path, `unknown` if blank."""
    base = F.element_at(F.split(F.replace(F.trim(text_of(filename)), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(base == "", F.lit("unknown")).otherwise(base)


def grouped(rows: DataFrame, by: list[str], ord: str, item: str, most_first: Column | None = None) -> DataFrame:
    """by, n, items: a group's items in the order of `ord`, or with the greatest `most_first` first."""
    lead = [] if most_first is None else [(-most_first).alias("m")]
    x = F.struct(*lead, F.col(ord).alias("o"), F.col(item).alias("i"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(x)), lambda v: v["i"]).alias("items"))


def dataset_report(boxes: DataFrame, video: str, split: str, image: str) -> DataFrame:
    """Boxes and images per video and split, with the totals of each video and of all (null)."""
    return boxes.rollup(video, split).agg(F.count("*").alias("boxes"), F.countDistinct(image).alias("images"))


def box_lines(lines: DataFrame, file: str, line: str) -> DataFrame:
    """file, boxes: the lines of label files that aren't blank."""
    return lines.groupBy(file).agg(F.count_if(F.trim(F.col(line)) != "").alias("boxes"))


def multiplicity(rows: DataFrame, video: str, code: str) -> DataFrame:
    """Adds `n_same_code`: rows of the video with the code (0 without one). Codes are counted first, so a hot code is no window."""
    per = rows.where(F.coalesce(F.col(code), F.lit("")) != "").groupBy(video, code).agg(F.count("*").alias("n_same_code"))
    return rows.join(per, [video, code], "left").withColumn("n_same_code", F.coalesce("n_same_code", F.lit(0)))


def row_keys(whole: bool) -> list[Column]:
    """Sort keys of output rows: time and place, cut to whole numbers (the earlier form) or not; unreadable cells count as 0."""
    value = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return [F.floor(value(c)).cast("long") if whole else value(c) for c in ("frame_timestamp", "x_min", "y_min")]


def backfilled(df: DataFrame, columns: list[str], copy_empty: bool = False) -> DataFrame:
    """Rows r_<column> filled from reference cells e_<column>, and `n_changed`; codes fill each other at last."""
    cells, changed = {}, F.lit(0)
    for c in columns:
        mine, own = F.coalesce(F.col(f"r_{c}"), F.lit("")), F.coalesce(F.col(f"e_{c}"), F.lit(""))
        takes = (mine != own) & (F.lit(True) if copy_empty else output_value(own) != "")
        cells[c] = F.when(takes, own).otherwise(mine)
        changed = changed + takes.cast("int")
    out = df.select(*[c for c in df.columns if not c.startswith(("r_", "e_"))], *[v.alias(c) for c, v in cells.items()], changed.alias("n_changed"))
    if "barcode" in columns and "qr_code_barcode" in columns:
        a, b = F.col("barcode"), F.col("qr_code_barcode")
        one = (a != "") != (b != "")
        both = F.when(a != "", a).otherwise(b)
        out = out.select(*[both.alias(c) if c in ("barcode", "qr_code_barcode") else (F.col(c) + one.cast("int")).alias(c) if c == "n_changed" else F.col(c) for c in out.columns])
    return out


def preview_rows(json: Column) -> Column:
    """The rows of a preview document: an array, or the array under `rows`, `preview` or `data`; each as text. Other documents have none."""
    paths = ("$", "$.rows", "$.preview", "$.data")
    found = [F.from_json(F.get_json_object(json, p), "array<string>") for p in paths]
    as_array = [F.when(F.trim(F.get_json_object(json, p)).startswith("["), f) for p, f in zip(paths, found)]
    return F.coalesce(*as_array, F.array().cast("array<string>"))


def merged_left(a: Column, b: Column) -> Column:
    """Both maps; of a key in both the left value counts."""
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)), a)


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows with the columns of all; cells that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
