"""A gate for decoded symbols: codes must be valid and known, whatever else a payload holds stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, payload
from ..functions.text import digits
from .steps import computed

CODE_FIELDS = ("barcode", "qr_code_barcode")
# The keys under which cleaned payloads hold their fields.
KEY_OF_FIELD = {
    "qr_code_barcode": "barcode",
    "price1_qr": "p1",
    "price2_qr": "p2",
    "price3_qr": "p3",
    "price4_qr": "p4",
    "wholesale_level_1_count": "wl1c",
    "wholesale_level_1_price": "wl1p",
    "wholesale_level_2_count": "wl2c",
    "wholesale_level_2_price": "wl2p",
    "action_price_qr": "ap",
    "action_code_qr": "ac",
}


def cleaned_payload(fields: Column) -> Column:
    """`key=value` by field name, with `;` between them, under the keys that payloads use."""
    keys = F.create_map(*[F.lit(x) for kv in KEY_OF_FIELD.items() for x in kv])
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.coalesce(keys[e["key"]], e["key"]), F.lit("="), e["value"])), ";")


def gated(symbols: DataFrame, known: DataFrame, require_checksum: bool = True) -> DataFrame:
    """All symbols with `code` (trusted, else empty), `code_field`, `clean` (the payload that may be used) and `reason` (empty: kept).

    `known` has one column `code`. A payload with fields loses an untrusted code and is rejected if nothing else is left; a bare one is rejected
    with its code. Symbols without a usable code aren't looked up.
    """
    s = computed(symbols, _f=payload.parse(F.col("payload")))
    bare = F.size("_f") == 0
    given = F.when(bare, F.col("payload")).otherwise(F.coalesce(*[F.col("_f")[f] for f in CODE_FIELDS]))
    s = computed(s, _bare=bare, _made=codes.to_ean13(digits(F.coalesce(given, F.lit("")))))
    s = computed(s, _ok=codes.ean13_ok(F.col("_made")) if require_checksum else F.col("_made") != "")
    looked = s.where("_ok").join(known.select(F.col("code").alias("_made")).distinct().withColumn("_known", F.lit(True)), "_made", "left")
    s = looked.unionByName(s.where("not _ok").withColumn("_known", F.lit(None).cast("boolean")))
    s = computed(s, code=F.when(F.coalesce("_known", F.lit(False)), F.col("_made")).otherwise(F.lit("")))
    code = F.col("code")
    others = F.map_filter("_f", lambda k, v: ~k.isin(*CODE_FIELDS))
    trusted = F.map_filter("_f", lambda k, v: k.isin(*CODE_FIELDS) & (code != ""))
    s = computed(s, _kept=F.map_concat(others, F.transform_values(trusted, lambda k, v: code)))
    why = F.when(F.col("_made") == "", "no_usable_barcode_digits").when(~F.col("_ok"), "bad_ean13_checksum").when(code == "", "barcode_not_in_catalog").otherwise("")
    s = computed(s, reason=F.when(F.col("_bare"), why).when(F.size("_kept") == 0, "qr_payload_no_safe_fields").otherwise(""))
    field = F.when(code == "", "").when(F.col("_bare") & (F.col("symbol_type") == "barcode"), "barcode").otherwise("qr_code_barcode")
    clean = F.when(F.col("_bare"), code).otherwise(cleaned_payload(F.col("_kept")))
    return s.select(*symbols.columns, "code", field.alias("code_field"), F.when(F.col("reason") == "", clean).otherwise("").alias("clean"), "reason")
