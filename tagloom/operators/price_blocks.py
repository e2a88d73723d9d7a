"""Prices, discount and marks of price tags from their blocks of text with places (shares of the crop).

A tag's blocks are gathered once, in their order, and all rules are functions over that array: one shuffle by tag, no
joins. The array holds the lines of one picture, so it stays small however many tags there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prices
from ..functions.reading import best_discount, block_sweetness, block_symbol, reconciled_discount

# The cents that price tags use.
USUAL_CENTS = ("99", "90", "49", "50", "00", "95", "98", "79", "59", "69", "89", "29", "19")
# Volumes and weights, which are no prices.
VOLUME = r"\d[\s.,]*(?:ML|МЛ|L|Л)(?![\p{L}\p{N}_])"
LITRES = r"^\s*[01][.,]\d{1,2}\s*[lLлЛ]?\s*$"
WEIGHT = r"(?iu)\d+\s*(?:kg|кг|g|г)(?![\p{L}\p{N}_])"
TWO_DIGITS = r"(?<!\d)\d{2}(?!\d)"


def with_prices(blocks: Column) -> Column:
    """The blocks of an array whose numbers may be prices."""

    def may(b: Column) -> Column:
        t = b["text"]
        return t.rlike(r"\d") & ~t.contains("%") & ~F.upper(t).rlike(VOLUME) & ~t.rlike(LITRES) & ~t.rlike(WEIGHT)

    return F.filter(blocks, may)


def whole_prices(numbers: Column) -> Column:
    """Every number of three to five digits, with the place of its block, in order; one of five digits that ends in 0 also without it, less surely."""

    def read(b: Column, t: Column, share: float) -> Column:
        return F.struct(t.cast("int").alias("value"), (b["conf"] * share).alias("conf"), *[b[c].alias(c) for c in ("y", "h", "x", "w", "cx")])

    def of(b: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(b["text"], F.lit(r"\d+"), F.lit(0)), lambda t: F.length(t).between(3, 5))
        cut = lambda t: (F.length(t) == 5) & t.endswith("0") & b["y"].between(0.12, 0.56)
        return F.flatten(F.transform(tokens, lambda t: F.when(cut(t), F.array(read(b, t, 1.0), read(b, F.left(t, F.lit(4)), 0.88))).otherwise(F.array(read(b, t, 1.0)))))

    return F.filter(F.flatten(F.transform(numbers, of)), lambda e: e["value"] >= 100)


def each_value_once(found: Column) -> Column:
    """The surest reading of each value (the first of equals), with `first`, where the value was met first."""
    placed = F.transform(found, lambda e, i: F.struct(e["value"].alias("value"), (-e["conf"]).alias("doubt"), i.alias("at"), e.alias("e")))
    kept = F.transform(F.array_distinct(F.transform(placed, lambda e: e["value"])), lambda v: F.filter(placed, lambda e: e["value"] == v))
    best = F.transform(kept, lambda same: F.struct(F.array_min(F.transform(same, lambda e: e["at"])).alias("first"), F.array_min(F.transform(same, lambda e: F.struct(e["doubt"], e["at"], e["e"])))["e"].alias("e")))
    return F.transform(best, lambda b: F.struct(b["first"].alias("first"), *[b["e"][c].alias(c) for c in ("value", "y", "h", "x", "w", "cx")]))


def best_pair(entries: Column) -> Column:
    """struct(default, card) of the two values nearest to a tag's usual layout; null if no two make a pair."""

    def cards(d: Column) -> Column:
        fits = F.filter(entries, lambda c: prices.pair_allowed(d["value"], c["value"], d["y"], c["y"]))
        return F.transform(fits, lambda c: F.struct(prices.pair_cost(d["y"], c["y"], d["cx"], c["cx"]).alias("cost"), d["first"].alias("a"), c["first"].alias("b"), d.alias("default"), c.alias("card")))

    return F.array_min(F.flatten(F.transform(entries, cards)))


def cents(numbers: Column, price: Column, fallback: str, not_these: Column | None = None, far: float = 0.24) -> Column:
    """The two digits that stand alone nearest to a price's height and right edge; unusual ones left of it don't count."""
    two = F.flatten(F.transform(numbers, lambda b: F.transform(F.regexp_extract_all(b["text"], F.lit(TWO_DIGITS), F.lit(0)), lambda t: F.struct(t.alias("t"), b["y"].alias("y"), b["x"].alias("x")))))
    right = price["x"] + price["w"]

    def may(e: Column) -> Column:
        near = e["t"].isin(*USUAL_CENTS) | (e["x"] + 0.02 >= price["x"])
        return near if not_these is None else near & (e["t"] != not_these)

    def cost(e: Column) -> Column:
        aside = F.abs(e["x"] - right) + F.when(e["x"] + 0.03 < right, 0.12).otherwise(0.0)
        return F.abs(e["y"] - price["y"]) + F.least(aside, F.lit(0.20))

    best = F.array_min(F.transform(F.filter(two, may), lambda e, i: F.struct(cost(e).alias("cost"), i.alias("at"), e["t"].alias("t"))))
    return F.when(best["cost"] <= far, best["t"]).otherwise(F.lit(fallback))


def parse(blocks: DataFrame, key: str) -> DataFrame:
    """`key`, price_default, price_card, discount_amount, special_symbols, additional_info (empty if not read), a row for each tag.

    `blocks`: key, ord, text, conf, rel_x, rel_y, rel_w, rel_h, rel_cx. Of several prices the pair nearest to the usual layout counts; a
    price without a partner is the card's, the tallest one if there are several.
    """
    number = lambda c: F.col(c).cast("double")
    block = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"), number("conf").alias("conf"), *[number(f"rel_{c}").alias(c) for c in ("y", "h", "x", "w", "cx")])
    tags = blocks.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    tags = tags.withColumn("_numbers", with_prices(F.col("_blocks"))).withColumn("_found", whole_prices(F.col("_numbers")))
    tags = tags.withColumn("_entries", each_value_once(F.col("_found"))).withColumn("_pair", best_pair(F.col("_entries")))
    alone = F.array_max(F.transform("_entries", lambda e: F.struct(e["h"].alias("h"), e["value"].alias("value"), e.alias("e"))))["e"]
    tags = tags.withColumns({"_card": F.coalesce(F.col("_pair")["card"], alone), "_default": F.col("_pair")["default"]})
    tags = tags.withColumn("_cents", cents(F.col("_numbers"), F.col("_card"), "99"))
    money = lambda e, c: F.concat(e["value"].cast("string"), F.lit("."), c)
    tags = tags.withColumn("_c", money(F.col("_card"), F.col("_cents")))
    tags = tags.withColumn("_d", money(F.col("_default"), cents(F.col("_numbers"), F.col("_default"), "00", F.col("_cents"))))
    card, default = (F.coalesce(F.when(prices.plausible(F.col(c).cast("double")), F.col(c)), F.lit("")) for c in ("_c", "_d"))
    tags = tags.withColumns({"price_card": card, "price_default": F.when(default == F.col("_c"), "").otherwise(default)})
    texts = F.transform("_blocks", lambda b: b["text"])
    derived = prices.rounded_discount(F.col("price_default").try_cast("double"), F.col("price_card").try_cast("double"))
    discount = reconciled_discount(best_discount(F.array_join(texts, " ")), F.coalesce(derived, F.lit("")))
    symbols = F.filter(F.transform("_blocks", lambda b: block_symbol(b["text"], b["y"])), lambda s: s != "")
    symbol = F.coalesce(F.try_element_at(symbols, F.lit(-1)), F.lit(""))
    return tags.select(key, "price_default", "price_card", discount.alias("discount_amount"), symbol.alias("special_symbols"), block_sweetness(texts).alias("additional_info"))


def default_kopecks(blocks: DataFrame, key: str, default_y: float, card_kopecks: str, far: float = 0.16) -> DataFrame:
    """`key`, kopecks: the two digits that stand alone nearest the default price's height, within `far`, other than the card's; else 00."""
    two = blocks.select(key, "ord", F.abs(F.col("rel_y") - default_y).alias("_far"), F.explode(F.regexp_extract_all("text", F.lit(TWO_DIGITS), F.lit(0))).alias("_two")).where(F.col("_two") != card_kopecks)
    best = two.groupBy(key).agg(F.min(F.struct("_far", "ord", "_two")).alias("_b"))
    j = blocks.select(key).distinct().join(best, key, "left")
    return j.select(key, F.when(F.col("_b._far") <= far, F.col("_b._two")).otherwise(F.lit("00")).alias("kopecks"))
