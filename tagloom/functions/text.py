"""Text normalization, sentinels, tokens and fuzzy comparison.

White space is Unicode white space, as `(?U)\\s` matches it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word for "absent", its misread spelling, and what counts as empty.
ABSENT = "нет"
ABSENT_MISREAD = "РЅРµС‚"
EMPTY_WORDS = ("", ABSENT, ABSENT_MISREAD.lower(), "none", "n/a", "-")
GATE_EMPTY_WORDS = ("", ABSENT, "none", "n/a", "-")
STRICT_EMPTY_WORDS = ("",)
# Words that tell nothing about a product, misread prefixes, and category prefixes.
STOP_WORDS = (
    "ВИНО ВИННЫЙ КР БЕЛ РОЗ СУХ СУХОЕ ПОЛУСУХОЕ СЛ П СУ ИГТ IGT IGP AOP AOC DOC DOP DOCG DO ОРД ОРДИНАРНОЕ СОРТ СОРТОВОЕ ГОД L ML "
    "ИТАЛИЯ ФРАНЦИЯ ИСПАНИЯ РОССИЯ ЧИЛИ AND THE DI DE LA LE DEL VINO WINE RED ROSSO BIANCO ROUGE BLANC"
).split()
MISREAD_PREFIXES = "BWHO BHHO BUHO BUNO BPHO BHRO BNHO BHO HO".split()
WINE_PREFIXES = "вино винный вина игрист шампан ликерное".split()
# Sweetness by the first marker that the name holds, without white space.
SWEETNESS = [
    ("п/сл", "Полусладкое"),
    ("п./сл", "Полусладкое"),
    ("п.сл", "Полусладкое"),
    ("полусладк", "Полусладкое"),
    ("п/сух", "Полусухое"),
    ("п./сух", "Полусухое"),
    ("п.сух", "Полусухое"),
    ("полусух", "Полусухое"),
    ("сух", "Сухое"),
    ("сладк", "Сладкое"),
    ("брют", "Брют"),
]
# Colors.
COLORS = {"красный": "red", "желтый": "yellow", "жёлтый": "yellow", "белый": "white", "зеленый": "green", "зелёный": "green"}

SPACE = r"(?U)\s+"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), SPACE, " "))


def output_value(c: Column) -> Column:
    return collapse(F.replace(text_of(c), F.lit(ABSENT_MISREAD), F.lit(ABSENT)))


def has_value(c: Column, empty: Iterable[str] = EMPTY_WORDS) -> Column:
    """Whether a cell says something; `empty` holds lower-case words that don't (copies of this test differ in them)."""
    return ~F.lower(output_value(c)).isin(list(empty))


def absent_or(c: Column) -> Column:
    """The value, or the word for "absent"."""
    return F.when(has_value(c), output_value(c)).otherwise(F.lit(ABSENT))


def digits(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\D+", "")


def first_digits(*cells: Column) -> Column:
    return F.coalesce(*[F.nullif(digits(c), F.lit("")) for c in cells], F.lit(""))


def sweetness(name: Column) -> Column:
    folded = F.regexp_replace(F.lower(output_value(name)), SPACE, "")
    found = F.lit("")
    for marker, label in reversed(SWEETNESS):
        found = F.when(F.contains(folded, F.lit(marker)), F.lit(label)).otherwise(found)
    return found


def color_en(c: Column) -> Column:
    out = F.lower(output_value(c))
    found = out
    for ru, en in COLORS.items():
        found = F.when(out == ru, F.lit(en)).otherwise(found)
    return found


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, a longer text ending in three points."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(c)


def trigrams(token: Column) -> Column:
    """Different trigrams of a token with two spaces at either side, in order."""
    padded = F.concat(F.lit("  "), token, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 99 where the lengths differ by more than three."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, F.lit(99)).otherwise(F.levenshtein(a, b))


def brand_tokens(texts: Column) -> Column:
    """Latin words of an array of texts in upper case, without one misread prefix, of three letters at least, each once."""
    words = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(text_of(t), F.lit("([A-Za-z]+)"), F.lit(1))))

    def bare(w: Column) -> Column:
        found = w
        for prefix in reversed(MISREAD_PREFIXES):
            cut = w.startswith(prefix) & (F.length(w) > len(prefix) + 2)
            found = F.when(cut, F.substr(w, F.lit(len(prefix) + 1))).otherwise(found)
        return found

    kept = F.filter(F.transform(F.transform(words, F.upper), bare), lambda w: (F.length(w) >= 3) & ~w.isin(MISREAD_PREFIXES))
    return F.array_distinct(kept)


def name_tokens(name: Column) -> Column:
    """Latin, Cyrillic (without Ё) or digit words of two characters at least that identify; numbers alone don't."""
    words = F.regexp_extract_all(F.upper(text_of(name)), F.lit("([0-9A-Za-zА-Яа-я]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS) & ~w.rlike("^[0-9]+$")))


def fuzzy_hit(q: Column, t: Column) -> Column:
    """Whether a query token can be a misread name token: equal, contained, or within one error in four characters (three at most)."""
    least = F.least(F.length(q), F.length(t))
    tolerance = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(least / 4)))
    near = (F.abs(F.length(q) - F.length(t)) <= tolerance + 1) & (edit_distance(q, t) <= tolerance)
    return (q == t) | ((least >= 4) & (F.contains(t, q) | F.contains(q, t) | near))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(collapse(c), " ")), " ")


def vote_value(field: Column, value: Column) -> Column:
    """The form of a reading in which equal readings are equal, by field."""
    clean = output_value(value)
    digit_fields = ["barcode", "id_sku", "qr_code_barcode"]
    return (
        F.when(field.isin(digit_fields), digits(clean))
        .when(field.isin(list(PRICE_FIELDS)), F.regexp_replace(F.replace(F.replace(clean, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), r"[^0-9.\-]", ""))
        .when((field == "special_symbols") & (F.upper(clean) == "K"), F.lit("К"))
        .otherwise(F.lower(clean))
    )


# Fields that hold prices.
PRICE_FIELDS = (
    "price_default price_card price_discount price1_qr price2_qr price3_qr price4_qr "
    "wholesale_level_1_price wholesale_level_2_price action_price_qr"
).split()
