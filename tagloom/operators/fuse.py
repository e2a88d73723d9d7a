"""From observations to output rows: votes of symbols, texts and detections, one row per group, and rows from assigned entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, payload, prices
from ..functions.text import ABSENT, digits, has_value, output_value, text_of
from . import votes
from .steps import computed

# Columns that read "absent" when nothing fills them, and columns that mirror a code's field.
ABSENT_FIELDS = (
    "color price_discount price3_qr wholesale_level_1_count wholesale_level_1_price wholesale_level_2_count wholesale_level_2_price "
    "action_price_qr action_code_qr code special_symbols additional_info"
).split()
MIRRORS = {"price1_qr": "price_default", "price4_qr": "price_card", "qr_code_barcode": "barcode"}


def _long(df: DataFrame, group: str, fields: Column, weight, ord: Column) -> DataFrame:
    e = df.withColumn("e", F.explode(F.map_entries(fields)))
    return e.select(group, F.col("e.key").alias("field"), F.col("e.value").alias("value"), weight(F.col("e.key")).alias("weight"), ord.alias("ord"))


def _place(kind: int, order: str) -> Column:
    """The place of a vote among all: by kind, then in the order given (a whole number below 2 ** 52)."""
    return F.lit(kind << 52) + F.col(order).cast("long")


def symbol_votes(symbols: DataFrame, group: str, order: str = "symbol_id") -> DataFrame:
    """Fields of decoded payloads, or a bare code of 12 or 13 digits, at weight 3 + confidence."""
    read = payload.parse(F.col("payload"))
    bare = digits(F.col("payload"))
    name = F.when(F.col("symbol_type") == "barcode", F.lit("barcode")).otherwise(F.lit("qr_code_barcode"))
    fields = F.when(F.size(read) > 0, read).when(F.length(bare).isin(12, 13), F.create_map(name, bare))
    return _long(symbols, group, fields, lambda f: 3.0 + F.col("confidence"), _place(1, order))


def text_votes(crops: DataFrame, group: str, order: str = "crop_id") -> DataFrame:
    """Fields read from crops, at weight 1 + the field's confidence (else the text's) + the crop's quality."""
    sure = lambda f: F.coalesce(F.col("field_confidences")[f], F.col("confidence"), F.lit(0.0))
    return _long(crops, group, payload.non_empty(F.col("fields")), lambda f: 1.0 + sure(f) + F.col("quality"), _place(2, order))


def color_votes(detections: DataFrame, group: str, order: str = "detection_id") -> DataFrame:
    d = detections.where(F.trim(text_of(F.col("color"))) != "")
    return _long(d, group, F.create_map(F.lit("color"), F.trim(F.col("color"))), lambda f: F.col("confidence"), _place(3, order))


def ordered(parts: list[DataFrame]) -> DataFrame:
    """All votes: those of symbols count as seen first, then those of texts, then colors."""
    all_votes = parts[0]
    for p in parts[1:]:
        all_votes = all_votes.unionByName(p)
    return all_votes


def fused(all_votes: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row per group: the winners as columns, mirrors filled both ways, empty fields derived, absent ones named."""
    winners = votes.weighted_vote(all_votes, [group])
    rows = winners.groupBy(group).pivot("field", columns).agg(F.first("value"))
    cell = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    rows = rows.select(group, *[v.alias(c) for c, v in cell.items()])
    # Step by step, so that each step sees the values of the one before.
    for qr, visible in MIRRORS.items():
        if qr in columns and visible in columns:
            q, v = F.col(qr), F.col(visible)
            takes = (has_value(q) & ~has_value(v)) | (has_value(q) & has_value(v) & prices.qr_overrides(F.lit(qr), q, v))
            rows = computed(rows, **{visible: F.when(takes, q).otherwise(v), qr: F.when(has_value(v) & ~has_value(q), v).otherwise(q)})
    needed = ("price_default", "price1_qr", "price_card", "price4_qr", "product_name", "discount_amount", "price2_qr", "additional_info")
    got = prices.derived_fields({c: F.col(c) if c in columns else F.lit("") for c in needed})
    for c in ("discount_amount", "price2_qr", "additional_info"):
        if c in columns:
            rows = computed(rows, **{c: got[c]})
    rows = rows.withColumns({c: F.when(has_value(F.col(c)), F.col(c)).otherwise(F.lit(ABSENT)) for c in ABSENT_FIELDS if c in columns})
    return rows.select(group, *[output_value(F.col(c)).alias(c) for c in columns])


def materialised(assigned: DataFrame, columns: list[str], duplicated: Column) -> DataFrame:
    """Rows copied from assigned entries (e_<column>), empty cells filled from the track's own readings (t_<column>).

    A code that several entries of a video share is blanked, and a track's own valid code wins over a differing one.
    """
    cells = {}
    for c in columns:
        mine, own = output_value(F.col(f"t_{c}")), output_value(F.col(f"e_{c}"))
        value = F.when(own != "", own).otherwise(mine)
        if c in ("barcode", "qr_code_barcode"):
            conflict = codes.trusted_ean13(mine) & (own != "") & (digits(mine) != digits(own))
            value = F.when(conflict, mine).when(duplicated, F.lit("")).otherwise(value)
        if c in ABSENT_FIELDS:
            value = F.when(value == "", F.lit(ABSENT)).otherwise(value)
        cells[c] = value
    return assigned.select(*[c for c in assigned.columns if not c.startswith(("t_", "e_"))], *[v.alias(c) for c, v in cells.items()])


def recognition_score(qr: Column, ean: Column, sku: Column, name: Column, n_fields: Column, quality: Column, area: Column) -> Column:
    """How well a crop was read: codes first, then a name of up to 40 letters, the number of fields, quality and size."""
    return (
        F.when(qr, 60.0).otherwise(0.0)
        + F.when(ean, 40.0).otherwise(0.0)
        + F.when(sku, 8.0).otherwise(0.0)
        + 0.3 * F.least(F.length(text_of(name)), F.lit(40))
        + n_fields
        + quality
        + F.least(area / 1_000_000.0, F.lit(1.0))
    )
