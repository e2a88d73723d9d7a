"""Prices and discounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ABSENT, has_value, output_value, sweetness, text_of

MONEY = "decimal(18,4)"


def number_text(c: Column) -> Column:
    clean = F.replace(F.replace(output_value(c), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.regexp_replace(clean, r"[^0-9.\-]", "")


def price(c: Column) -> Column:
    """A positive amount, or null."""
    clean = output_value(c)
    value = number_text(c).try_cast(MONEY)
    return F.when((F.lower(clean) != ABSENT) & (value > 0), value)


def is_price(c: Column) -> Column:
    return price(c).isNotNull()


def plausible(v: Column) -> Column:
    return F.coalesce(v.between(10, 100000), F.lit(False))


def prices_equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(price(a) - price(b)) <= F.lit("0.01").cast(MONEY), F.lit(False))


def inverted_pair(default: Column, card: Column) -> Column:
    return F.coalesce(price(card) > price(default) + F.lit("0.01").cast(MONEY), F.lit(False))


def qr_overrides(field: Column, qr: Column, visible: Column) -> Column:
    """A code's price replaces a read one with the same whole part, if only the code's has a fraction."""
    from .text import PRICE_FIELDS

    q, v = price(qr), price(visible)
    part = lambda x: F.abs(x - F.floor(x))
    half = F.lit("0.005").cast(MONEY)
    return field.isin(list(PRICE_FIELDS)) & F.coalesce((F.floor(q) == F.floor(v)) & (part(v) <= half) & (part(q) > half), F.lit(False))


def truncated_discount(default: Column, card: Column) -> Column:
    """`-N%` with N cut to a whole number from 1 to 99, or null."""
    share = ((default - card).cast("double") / default.cast("double") * 100.0).cast("int")
    return F.when((default > card) & share.between(1, 99), F.concat(F.lit("-"), share.cast("string"), F.lit("%")))


def rounded_discount(default: Column, card: Column) -> Column:
    """The same, but rounded to the nearest (half to even)."""
    share = F.bround((default - card).cast("double") / default.cast("double") * 100.0, 0).cast("int")
    return F.when((default > card) & share.between(1, 99), F.concat(F.lit("-"), share.cast("string"), F.lit("%")))


def discount_text(c: Column) -> Column:
    """A read percentage with its minus implied; empty if there is none."""
    found = F.regexp_extract(text_of(c), r"(?<!\d)(\d{1,2})\s*%", 1)
    return F.when(found != "", F.concat(F.lit("-"), found, F.lit("%"))).otherwise(F.lit(""))


def second_price(default: Column) -> Column:
    whole = F.bround(default.cast("double") * 0.95, 0)
    return F.format_string("%.2f", whole - 0.01)


def derived_fields(row: dict[str, Column]) -> dict[str, Column]:
    """Empty discount_amount, price2_qr and additional_info filled from the prices and the name; others as they are."""
    default = F.coalesce(price(row["price_default"]), price(row["price1_qr"]))
    card = F.coalesce(price(row["price_card"]), price(row["price4_qr"]))
    fill = lambda name, value: F.when(has_value(row[name]), row[name]).otherwise(F.coalesce(value, text_of(row[name])))
    return row | {
        "discount_amount": fill("discount_amount", truncated_discount(default, card)),
        "price2_qr": fill("price2_qr", F.when(default.isNotNull(), second_price(default))),
        "additional_info": fill("additional_info", F.nullif(sweetness(row["product_name"]), F.lit(""))),
    }


def pair_cost(default_y: Column, card_y: Column, default_x: Column, card_x: Column) -> Column:
    """How far two price blocks (places as shares of the crop) are from the usual layout."""
    gap = card_y - default_y
    # Usual places, and the weights of being off them.
    return (
        2.6 * F.abs(default_y - 0.30)
        + 2.4 * F.abs(card_y - 0.62)
        + 1.8 * F.abs(gap - 0.30)
        + 0.8 * F.abs(default_x - card_x)
        + 7 * F.greatest(card_y - 0.84, F.lit(0.0))
        + 6 * F.greatest(default_y - 0.58, F.lit(0.0))
    )


def pair_allowed(default: Column, card: Column, default_y: Column, card_y: Column) -> Column:
    d, c = default.cast("double"), card.cast("double")
    # Shares of the default price, and distances of height.
    return (c < d) & (c >= 0.30 * d) & (c <= 0.985 * d) & (card_y - default_y).between(0.08, 0.58)
