"""Scores of pairs of a track's readings and a reference entry, with reasons. Columns: t_<field> and e_<field>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import prices_equal
from ..functions.text import STRICT_EMPTY_WORDS, digits, first_digits, has_value, output_value
from . import assign
from .evaluate import token_sort_ratio

# Weights of agreeing fields.
PRICES = {"price_card": 55.0, "price_default": 45.0, "price1_qr": 25.0, "price2_qr": 18.0, "price4_qr": 25.0}
TEXTS = {"discount_amount": 12.0, "color": 7.0, "special_symbols": 6.0}


def pair_score(iou: Column, same_shelf: Column) -> Column:
    """struct(score, reasons): overlap, shelf, codes, prices, attributes and name; conflicts count against the pair."""
    t, e = lambda f: F.col(f"t_{f}"), lambda f: F.col(f"e_{f}")
    parts: list[tuple[str, Column, Column]] = [
        ("strong_spatial_iou", iou >= 0.50, 240.0 + 220.0 * iou),
        ("spatial_iou", (iou >= 0.18) & (iou < 0.50), 70.0 + 150.0 * iou),
        ("same_shelf_band", same_shelf, F.lit(12.0)),
    ]
    seen, known = first_digits(t("barcode"), t("qr_code_barcode")), first_digits(e("barcode"), e("qr_code_barcode"))
    both = (seen != "") & (known != "")
    parts += [("exact_barcode", both & (seen == known), F.lit(500.0)), ("conflicting_barcode", both & (seen != known) & (F.length(seen) >= 12), F.lit(-1000.0))]
    a, b = digits(t("id_sku")), digits(e("id_sku"))
    both = (a != "") & (b != "")
    parts += [("exact_id_sku", both & (a == b), F.lit(320.0)), ("conflicting_id_sku", both & (a != b) & (F.length(a) >= 6), F.lit(-320.0))]
    for f, w in PRICES.items():
        same = prices_equal(t(f), e(f))
        shown = has_value(t(f), STRICT_EMPTY_WORDS) & has_value(e(f), STRICT_EMPTY_WORDS)
        parts += [(f"price_{f}", same, F.lit(w)), (f"conflicting_{f}", ~same & shown, F.lit(-min(w / 2, 30.0)))]
    for f, w in TEXTS.items():
        x, y = output_value(t(f)), output_value(e(f))
        parts.append((f"exact_{f}", (x != "") & (F.lower(x) == F.lower(y)), F.lit(w)))
    ratio = token_sort_ratio(t("product_name"), e("product_name"))
    named = (F.length(output_value(t("product_name"))) >= 4) & (output_value(e("product_name")) != "")
    parts.append(("name_fuzzy", named & (ratio >= 0.60), 50.0 * ratio))
    on = [F.coalesce(c, F.lit(False)) for _, c, _ in parts]
    total = F.lit(0.0)
    for c, (_, _, w) in zip(on, parts):
        total = total + F.when(c, w).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, (name, _, _) in zip(on, parts)]))
    return F.struct(total.alias("score"), reasons.alias("reasons"))


def acceptable(score: Column, margin: Column, iou: Column, least: float = 70.0, least_margin: float = 2.0) -> Column:
    """Strong overlap accepts; else the score and its lead must be large enough."""
    return (iou >= 0.50) | ((score >= least) & (margin >= least_margin))


# Weights of the earlier resolver.
ROW_CODES = {"barcode": 110.0, "qr_code_barcode": 90.0, "id_sku": 72.0}
ROW_PRICES = {"price_card": 36.0, "price_default": 26.0, "price1_qr": 18.0, "price2_qr": 14.0, "price4_qr": 18.0}
ROW_TEXTS = {"discount_amount": 10.0, "color": 5.0, "special_symbols": 5.0}


def row_score(same_file: Column, iou: Column, least_iou: float = 0.18) -> Column:
    """struct(score, reasons) of a row and an entry by the earlier rule: only what agrees counts. Columns: t_<field> and e_<field>."""
    t, e = lambda f: F.col(f"t_{f}"), lambda f: F.col(f"e_{f}")
    parts: list[tuple[str, Column, Column]] = [("same_file", same_file, F.lit(8.0)), ("spatial_iou", same_file & (iou >= least_iou), 35.0 + 80.0 * iou)]
    for f, w in ROW_CODES.items():
        a, b = digits(t(f)), digits(e(f))
        parts.append((f"exact_{f}", (a != "") & (a == b), F.lit(w)))
    parts += [(f"price_{f}", prices_equal(t(f), e(f)), F.lit(w)) for f, w in ROW_PRICES.items()]
    for f, w in ROW_TEXTS.items():
        a, b = output_value(t(f)), output_value(e(f))
        parts.append((f"exact_{f}", (a != "") & (F.lower(a) == F.lower(b)), F.lit(w)))
    ratio = token_sort_ratio(t("product_name"), e("product_name"))
    named = (F.length(output_value(t("product_name"))) >= 4) & (output_value(e("product_name")) != "")
    parts.append(("name_fuzzy", named & (ratio >= 0.55), 35.0 * ratio))
    on = [F.coalesce(c, F.lit(False)) for _, c, _ in parts]
    total = F.lit(0.0)
    for c, (_, _, w) in zip(on, parts):
        total = total + F.when(c, w).otherwise(F.lit(0.0))
    return F.struct(total.alias("score"), F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, (name, _, _) in zip(on, parts)])).alias("reasons"))


def row_accepted(score: Column, second: Column, same_file: Column, iou: Column, least: float = 45.0, margin: float = 8.0, least_iou: float = 0.18) -> Column:
    """Overlap in the same file accepts from 0.5 on, below that with a lead of 2; else the score and its lead must be large enough."""
    strong = same_file & (iou >= least_iou)
    lead = score - F.coalesce(second, F.lit(0.0))
    return F.when(strong, (iou >= 0.5) | (lead >= 2.0)).otherwise((score >= least) & (lead >= margin))


def best_entries(scored: DataFrame, row: str, entry: str) -> DataFrame:
    """row, entry, score, accepted: the best entry of each row by its lead to the runner-up. `scored`: row, entry, score, same_file, iou."""
    item = F.struct("score", (-F.col(entry)).alias("e"), "same_file", "iou")
    g = scored.where("score > 0").groupBy(row).agg(F.max(item).alias("_b"))
    second = scored.where("score > 0").join(g.select(row, "_b"), row).where(F.col(entry) != -F.col("_b.e")).groupBy(row).agg(F.max("score").alias("_second"))
    j = g.join(second, row, "left")
    ok = row_accepted(F.col("_b.score"), F.col("_second"), F.col("_b.same_file"), F.col("_b.iou"))
    return j.select(row, (-F.col("_b.e")).alias(entry), F.col("_b.score").alias("score"), ok.alias("accepted"))


def resolved(scored: DataFrame, row: str, entry: str, least: float = 45.0, least_iou: float = 0.18) -> DataFrame:
    """row, entry, score, iou, margin: rows in their order and the entries that they take, each used once. `scored`: row, entry, score, same_file, iou."""
    strong = F.col("same_file") & (F.col("iou") >= least_iou)
    accepts = row_accepted(F.col("score"), F.col("_second"), F.col("same_file"), F.col("iou"), least, least_iou=least_iou)
    out = assign.used_up(scored.select(row, entry, "score", "same_file", "iou"), row, entry, "score", strong | (F.col("score") >= least), accepts)
    return out.select(row, entry, "score", "iou", (F.col("score") - F.col("_second")).alias("margin"))
