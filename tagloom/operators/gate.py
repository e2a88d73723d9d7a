"""Explainable confidence of output rows, and the gates on it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, prices
from ..functions.geometry import box
from ..functions.text import GATE_EMPTY_WORDS, has_value, text_of

KEY_FIELDS = ("barcode", "qr_code_barcode")
FINE_PRINT = ("id_sku", "print_datetime", "code")
STRONG = 0.75


def _held(c: str) -> Column:
    return has_value(F.col(c), GATE_EMPTY_WORDS)


def match_key(fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    found = F.lit(False)
    for f in fields:
        found = found | codes.trusted_ean13(F.col(f))
    return found


def fine_print_confidence(field: str) -> Column:
    return F.coalesce(F.replace(text_of(F.col(f"{field}_confidence")), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def strong_fine_print(field: str) -> Column:
    return _held(field) & (fine_print_confidence(field) >= STRONG)


def row_box() -> Column:
    """The box of text columns, half to even; null if a side is missing or the box is empty."""
    side = lambda c: F.bround(prices.number_text(F.col(c)).try_cast("double"), 0).cast("int")
    b = box(side("x_min"), side("y_min"), side("x_max"), side("y_max"))
    return F.when(F.coalesce((b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"]), F.lit(False)), b)


@dataclass(frozen=True)
class Facts:
    """What the rules ask of a row; each a boolean."""

    key: Column
    named: Column
    price_default: Column
    price_card: Column
    inverted: Column
    located: Column
    discount: Column
    color: Column
    id_sku: Column
    print_datetime: Column
    code: Column

    @property
    def fine(self) -> Column:
        return self.id_sku | self.print_datetime | self.code

    @property
    def priced(self) -> Column:
        return self.price_default | self.price_card

    def named_columns(self) -> dict[str, Column]:
        return {f"_is_{f.name}": getattr(self, f.name) for f in fields(self)}


def facts() -> Facts:
    """The facts of a row, from its cells."""
    return Facts(
        match_key(),
        _held("product_name"),
        prices.is_price(F.col("price_default")),
        prices.is_price(F.col("price_card")),
        prices.inverted_pair(F.col("price_default"), F.col("price_card")),
        row_box().isNotNull(),
        _held("discount_amount"),
        _held("color"),
        *map(strong_fine_print, FINE_PRINT),
    )


def with_facts(rows: DataFrame) -> tuple[DataFrame, Facts]:
    """Rows with their facts as columns, so that rules on top of them stay small."""
    return rows.withColumns(facts().named_columns()), Facts(*[F.col(f"_is_{f.name}") for f in fields(Facts)])


def confidence(f: Facts | None = None) -> Column:
    """struct(confidence, tier, evidence): a sum of what the row shows, at most 1, with the reasons in order."""
    f = facts() if f is None else f
    # What each kind of evidence adds.
    parts = [
        ("identity", f.key & f.named, 0.40),
        ("name", f.named & ~f.key, 0.20),
        ("barcode", f.key & ~f.named, 0.20),
        ("price_card", f.price_card, 0.15),
        ("price_default", f.price_default & ~f.inverted, 0.08),
        ("discount", f.discount & ~f.inverted, 0.05),
        ("id_sku", f.id_sku, 0.22),
        ("print_datetime", f.print_datetime, 0.08),
        ("code", f.code, 0.05),
        ("color", f.color, 0.04),
        ("localized", f.located, 0.08),
    ]
    total = F.lit(0).cast("decimal(6,4)")
    for _, on, weight in parts:
        total = total + F.when(on, F.lit(f"{weight:.4f}").cast("decimal(6,4)")).otherwise(F.lit(0).cast("decimal(6,4)"))
    score = F.least(total.cast("double"), F.lit(1.0))
    tier = F.when(score >= 0.6, F.lit("high")).when(score >= 0.3, F.lit("medium")).otherwise(F.lit("low"))
    evidence = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on, _ in parts]))
    return F.struct(score.alias("confidence"), tier.alias("tier"), evidence.alias("evidence"))


def has_evidence(keep_price_only: bool = True, f: Facts | None = None) -> Column:
    """A trusted code, a name, strong fine print or (if that counts) any price."""
    f = facts() if f is None else f
    shown = f.key | f.named | f.fine
    return shown | f.priced if keep_price_only else shown


def decision(mode: str = "balanced", least: float = 0.40, f: Facts | None = None, score: Column | None = None) -> Column:
    """struct(keep, reason) of one row: recall keeps rows with a box, strict those with evidence, balanced tests box, key, evidence and confidence in turn."""
    f = facts() if f is None else f
    located, shown = f.located, has_evidence(f=f)
    score = confidence(f)["confidence"] if score is None else score
    say = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))
    if mode == "recall":
        return F.when(located, say(True, "bbox")).otherwise(say(False, "no_bbox"))
    if mode == "strict":
        return F.when(shown, say(True, "evidence")).otherwise(say(False, "no_evidence"))
    if mode != "balanced":
        raise ValueError("mode must be recall, strict or balanced")
    return (
        F.when(~located, say(False, "no_bbox"))
        .when(f.key, say(True, "match_key"))
        .when(~shown, say(False, "no_evidence"))
        .when(score >= least, say(True, "confidence"))
        .otherwise(say(False, "low_confidence"))
    )


def weak_price_only(f: Facts | None = None) -> Column:
    f = facts() if f is None else f
    return ~f.key & ~f.named & ~f.fine & f.priced


def gated(rows: DataFrame, group: list[str], mode: str = "balanced", least: float = 0.40, least_beside_identity: float = 0.45) -> DataFrame:
    """Adds confidence, tier, evidence, keep and reason.

    Where a group keeps a row of confirmed identity, weak rows with prices alone need the higher confidence. The flag is
    aggregated per group before it is joined, so that groups of any size are combined map-side.
    """
    d, f = with_facts(rows)
    d = d.withColumn("_c", confidence(f)).withColumn("_d", decision(mode, least, f, F.col("_c.confidence")))
    d = d.withColumns({"_confirmed": f.key & f.named, "_weak": weak_price_only(f)})
    flag = d.groupBy(*group).agg(F.max((F.col("_d.keep") & F.col("_confirmed")).cast("int")).alias("_any"))
    d = d.join(flag, group)
    raised = F.col("_d.keep") & (F.col("_any") == 1) & F.col("_weak") & (F.col("_c.confidence") < least_beside_identity)
    return d.select(
        *rows.columns,
        F.col("_c.confidence").alias("confidence"),
        F.col("_c.tier").alias("tier"),
        F.col("_c.evidence").alias("evidence"),
        (F.col("_d.keep") & ~raised).alias("keep"),
        F.when(raised, F.lit("weak_price_only_beside_identity")).otherwise(F.col("_d.reason")).alias("reason"),
    )
