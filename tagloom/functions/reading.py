"""Fields read from whole texts and from texts of zones: prices, discounts, dates, codes, names and marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes, payload
from .prices import discount_text
from .text import ABSENT, ABSENT_MISREAD, collapse, digits, text_of

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
# Patterns of prices, discounts, dates and store zones as tags print them.
PRICE = r"(?<!\d)(\d{1,5})\s*[,.\s]\s*(\d{2})(?!\d)"
DISCOUNT = r"[-−]\s*\d{1,2}\s*%"
DATE = r"(?U)\b\d{1,2}[.]\d{1,2}[.]\d{2,4}(?:\s+\d{1,2}:\d{2})?\b"
LOOSE_DATE = r"(?U)\b(\d{1,2}[.,]\d{1,2}[.,]\d{2,4})(?:\s*(\d{1,2}[:.]\d{2}))?"
ZONE_CODE = r"(?U)\d{1,2}_?\d{5,6}\s*[-–—]\s*\d{5,6}|\b\d{2}_\d{6}\b|\b\d{2}_[A-Za-zА-Яа-я]{2,4}\b|\bЧБК\s*\d[\w_]*"
# Words of lines that are no product names, words of sweetness, and the cents that price tags use, likeliest first.
NAME_STOP_WORDS = ("руб", "карта", "картой", "цена", "скидка", "сухое", "полусухое", "полусладкое", "сладкое")
INFO_WORDS = ("сухое", "полусухое", "полусладкое", "сладкое", "брют")
KOPECKS = ("99", "90", "50", "49", "00", "95", "98", "59", "79")
# Sweetness by the first group of which the blocks' text holds a marker; some markers mix alphabets.
BLOCK_SWEETNESS = (
    (("полуслад", "п/сл", "п.сл", "p/cл", "n/cл"), "Полусладкое"),
    (("полусух", "п/сух", "п.сух", "p/cyx", "n/cyx", "p.cyx", "n.cyx"), "Полусухое"),
    (("сух", "cyx"), "Сухое"),
    (("слад",), "Сладкое"),
    (("брют", "brut"), "Брют"),
)

def _empty() -> Column:
    return F.array().cast("array<string>")


def _first(a: Column) -> Column:
    return F.coalesce(F.get(a, F.lit(0)), F.lit(""))


def _bound(value: Column, f) -> Column:
    """`f` of a value that is made once: a lambda binds it, however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _holds_any(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def clean_lines(text: Column) -> Column:
    """Lines with white space as single spaces and without points at their ends; empty ones are left out."""
    lines = F.transform(F.split(text_of(text), LINE_END), lambda x: F.regexp_replace(collapse(x), r"^[ .,:;|]+|[ .,:;|]+$", ""))
    return F.filter(lines, lambda x: x != "")


def normalized(text: Column) -> Column:
    """Lines with white space as single spaces, without empty ones, and the misread word for "absent" mended."""
    plain = F.replace(F.replace(text_of(text), F.lit("\0"), F.lit(" ")), F.lit(ABSENT_MISREAD), F.lit(ABSENT))
    return F.array_join(F.filter(F.transform(F.split(plain, LINE_END), collapse), lambda x: x != ""), "\n")


def prices_in(text: Column) -> Column:
    """`roubles.kopecks` of all pairs of 1 to 5 and two digits that a comma, a point or white space parts."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(PRICE), F.lit(1)), F.regexp_extract_all(text, F.lit(PRICE), F.lit(2)), lambda a, b: F.concat(a.cast("long").cast("string"), F.lit("."), b))
    return F.coalesce(both, _empty())


def _greatest_price(prices: Column) -> Column:
    return F.array_max(F.transform(prices, lambda x: F.struct(x.cast("decimal(18,2)").alias("v"), x.alias("x"))))["x"]


def best_price(text: Column) -> Column:
    """The greatest price of a text; without one, roubles and kopecks put together from whole numbers; empty if there are none."""
    t = text_of(text)
    tokens = F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))

    def of_tokens(tokens: Column) -> Column:
        return _bound(F.filter(tokens, lambda x: F.length(x).between(2, 6)), lambda ints: of_ints(tokens, ints))

    def of_ints(tokens: Column, ints: Column) -> Column:
        big = F.array_max(F.transform(F.filter(ints, lambda x: F.length(x) >= 3), lambda x: F.struct(F.length(x).alias("n"), x.cast("long").alias("v"), x.alias("x"))))["x"]
        two = F.filter(ints, lambda x: F.length(x) == 2)
        return _bound(F.struct(big.alias("big"), two.alias("two")), lambda r: of_big(tokens, ints, r["big"], r["two"]))

    def of_big(tokens: Column, ints: Column, big: Column, two: Column) -> Column:
        at = F.array_position(tokens, big).cast("int")
        beside = F.filter(F.array(F.get(tokens, at), F.get(tokens, at - 2)), lambda x: F.coalesce(F.length(x) == 2, F.lit(False)))
        usual = F.filter(F.array(*map(F.lit, KOPECKS)), lambda k: F.array_contains(two, k))
        kopecks = F.coalesce(F.get(beside, F.lit(0)), F.get(usual, F.lit(0)), F.get(two, F.lit(0)), F.lit("00"))
        small = F.concat(F.array_max(F.transform(ints, lambda x: x.cast("long"))).cast("string"), F.lit(".00"))
        return F.coalesce(F.when(big.isNotNull(), F.concat(big.cast("long").cast("string"), F.lit("."), kopecks)), small, F.lit(""))

    # Lambdas bind the tokens and what is chosen from them, so that each is made once.
    return F.coalesce(_greatest_price(prices_in(t)), _bound(tokens, of_tokens))


def best_discount(text: Column) -> Column:
    """A percentage with its minus, written or implied; empty if there is none."""
    found = F.regexp_extract(text_of(text), DISCOUNT, 0)
    return F.when(found != "", F.replace(F.regexp_replace(found, r"\s+", ""), F.lit("−"), F.lit("-"))).otherwise(discount_text(text))


def written_discount(text: Column) -> Column:
    found = F.regexp_extract(text_of(text), DISCOUNT, 0)
    return F.replace(F.regexp_replace(found, r"\s+", ""), F.lit("−"), F.lit("-"))


def sku12(text: Column, exclude: Column) -> Column:
    """The first stretch of exactly twelve digits, spaces and hyphens left out, that is not `exclude`; else empty."""
    found = F.regexp_extract_all(F.regexp_replace(text_of(text), r"(?U)[\s\-]", ""), F.lit(r"(?<!\d)\d{12}(?!\d)"), F.lit(0))
    return _first(F.filter(found, lambda x: x != F.coalesce(exclude, F.lit(""))))


def product_name(text: Column) -> Column:
    """Up to three lines that may name a product: four signs at least, few digits, no word of a tag's other parts."""
    fits = lambda x: (
        ~F.exists(F.array(F.lower(x)), lambda low: _holds_any(low, NAME_STOP_WORDS)) & (F.length(F.regexp_replace(x, r"(?U)\D+", "")) <= F.greatest(F.floor(F.length(x) / 3), F.lit(2))) & (F.length(x) >= 4)
    )
    return F.trim(F.array_join(F.slice(F.filter(clean_lines(text), fits), 1, 3), " "))


def additional_info(text: Column) -> Column:
    """The first line that speaks of sweetness."""
    return _first(F.filter(clean_lines(text), lambda x: _holds_any(F.lower(x), INFO_WORDS)))


def special_symbol(text: Column) -> Column:
    """The first letter К, Ш or Л (or a Latin K for К) that stands alone, as a Cyrillic capital."""
    found = F.upper(F.regexp_extract(text_of(text), r"(?iuU)\b[КШЛK]\b", 0))
    return F.when(found == "K", F.lit("К")).otherwise(found)


def _filled(cells: dict[str, Column]) -> Column:
    """A map of the cells that hold something."""
    flat = [x for k, v in cells.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*flat), lambda k, v: F.coalesce(v != "", F.lit(False)))


def parse_fields(text: Column) -> Column:
    """Map of the fields of a whole text; a field that isn't found is left out."""
    t = normalized(text)
    prices = F.array_distinct(prices_in(t))
    least = F.array_min(F.transform(prices, lambda x: F.struct(x.cast("decimal(18,2)").alias("v"), x.alias("x"))))["x"]
    ean = codes.first_valid_ean13(t)
    return _filled(
        {
            "price_default": F.when(F.size(prices) > 1, _greatest_price(prices)),
            "price_card": least,
            "discount_amount": written_discount(t),
            "print_datetime": F.regexp_extract(t, DATE, 0),
            "barcode": ean,
            "id_sku": sku12(t, ean),
            "product_name": product_name(t),
            "additional_info": additional_info(t),
            "special_symbols": special_symbol(t),
        }
    )


def parse_zones(zones: Column) -> Column:
    """Map of the fields of a tag's zones (map of zone to text).

    Prices must be plausible, the default price must differ from the card's, and digits that are prices run together are no code.
    """
    z = lambda name: F.coalesce(zones[name], F.lit(""))
    likely = lambda p: F.when(p.try_cast("decimal(18,2)").between(10, 100000), p).otherwise(F.lit(""))
    kept = lambda s, joined: F.when((s != "") & ~((joined != "") & (F.contains(joined, s) | joined.startswith(F.left(s, F.lit(6))))), s).otherwise(F.lit(""))
    plain = {
        "product_name": product_name(z("product_name")),
        "discount_amount": best_discount(F.concat(z("discount"), F.lit(" "), z("price_card"))),
        "print_datetime": F.regexp_extract(z("sku_date"), DATE, 0),
        "special_symbols": special_symbol(z("special")),
        "additional_info": additional_info(F.concat(z("additional_info"), F.lit("\n"), z("product_name"))),
    }
    read = plain | {"default": best_price(z("price_default")), "card": best_price(z("price_card")), "ean": codes.first_valid_ean13(F.concat(z("barcode"), F.lit(" "), z("sku_date"))), "sku": z("sku_date")}

    def step(made: dict[str, Column], f) -> Column:
        """The next step from a struct of what was made, in a lambda: later steps name these several times over."""
        return _bound(F.struct(*[v.alias(k) for k, v in made.items()]), lambda r: f({k: r[k] for k in made}))

    def prices_kept(m: dict[str, Column]) -> Column:
        return step(m | {"default": likely(m["default"]), "card": likely(m["card"])}, digits_joined)

    def digits_joined(m: dict[str, Column]) -> Column:
        return step(m | {"joined": F.concat(digits(m["default"]), digits(m["card"]), digits(m["discount_amount"]))}, code_kept)

    def code_kept(m: dict[str, Column]) -> Column:
        return step(m | {"ean": kept(m["ean"], m["joined"])}, number_found)

    def number_found(m: dict[str, Column]) -> Column:
        return step(m | {"sku": sku12(m["sku"], m["ean"])}, filled)

    def filled(m: dict[str, Column]) -> Column:
        default = F.when(m["default"] != m["card"], m["default"]).otherwise(F.lit(""))
        return _filled({k: m[k] for k in plain} | {"price_card": m["card"], "price_default": default, "barcode": m["ean"], "id_sku": kept(m["sku"], m["joined"])})

    return step(read, prices_kept)


def text_score(text: Column, confidence: Column) -> Column:
    """How useful a read text is: its confidence, digits, a price, Cyrillic letters and length; 0 if empty."""
    t = normalized(text)
    n_digits = F.length(F.regexp_replace(t, r"(?U)\D+", ""))
    bonus = (
        F.least(n_digits / 20.0, F.lit(1.0))
        + F.when(t.rlike(PRICE), 0.4).otherwise(0.0)
        + F.when(t.rlike("[А-Яа-я]"), 0.2).otherwise(0.0)
        + F.least(F.length(t) / 120.0, F.lit(0.5))
    )
    return F.when(t == "", F.lit(0.0)).otherwise(confidence + bonus)


def decoded_payload(data: Column) -> Column:
    """A decoded symbol's bytes or text without NUL signs and white space at the ends; bytes that are no UTF-8 are dropped."""
    plain = F.regexp_replace(F.make_valid_utf8(data.cast("binary").cast("string")), "�", "")
    return F.coalesce(F.regexp_replace(F.replace(plain, F.lit("\0"), F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(""))


def date_candidates(texts: Column) -> Column:
    """All dates of an array of texts, commas as points, with their times where they have one."""

    def of(t: Column) -> Column:
        day, time = (F.regexp_extract_all(t, F.lit(LOOSE_DATE), F.lit(i)) for i in (1, 2))
        return F.zip_with(day, time, lambda d, h: F.trim(F.concat(F.replace(d, F.lit(","), F.lit(".")), F.lit(" "), F.replace(F.coalesce(h, F.lit("")), F.lit("."), F.lit(":")))))

    return F.flatten(F.transform(texts, lambda t: of(text_of(t))))


def zone_codes(texts: Column) -> Column:
    """All codes of store zones in an array of texts."""
    return F.flatten(F.transform(texts, lambda t: F.transform(F.regexp_extract_all(text_of(t), F.lit(ZONE_CODE), F.lit(0)), collapse)))


def block_sweetness(texts: Column) -> Column:
    """Sweetness from a tag's blocks of text (an array), also where Latin letters were read for Cyrillic ones."""
    t = F.lower(F.regexp_replace(F.array_join(F.transform(texts, text_of), " "), r"(?U)\s+", ""))
    found = F.lit("")
    for markers, label in reversed(BLOCK_SWEETNESS):
        found = F.when(_holds_any(t, markers), F.lit(label)).otherwise(found)
    return found


def block_symbol(text: Column, rel_y: Column) -> Column:
    """К, Ш or Л of a block in the lowest three tenths of a tag; a misread К, as in K0, counts."""
    t = F.upper(F.regexp_replace(text_of(text), r"(?U)\s+", ""))
    found = F.when(t.rlike("^[KК][O0О]?$"), F.lit("К")).when(t.isin("Ш", "Л"), t).otherwise(F.lit(""))
    return F.when(rel_y > 0.70, found).otherwise(F.lit(""))


def reconciled_discount(seen: Column, derived: Column) -> Column:
    """The read discount, unless it lost a digit: then the one that the prices give."""
    one = F.length(digits(seen)) == 1
    far = F.abs(digits(seen).try_cast("int") - digits(derived).try_cast("int")) >= 10
    return F.when((derived != "") & one & far, derived).otherwise(seen)


def barcode_values(symbol_payload: Column) -> Column:
    """Valid codes of a symbol's payload: its code fields, then all of it; each once."""
    fields = payload.parse(symbol_payload)
    made = F.transform(F.array(fields["barcode"], fields["qr_code_barcode"], symbol_payload), lambda v: codes.to_ean13(F.coalesce(v, F.lit(""))))
    return F.array_distinct(F.filter(made, codes.ean13_ok))


def best_hint(values: Column, fallback: Column) -> Column:
    """The first valid code of an array, else the fallback, in its valid form where it has one."""
    made = F.get(F.filter(F.transform(values, codes.to_ean13), codes.ean13_ok), F.lit(0))
    last = codes.to_ean13(fallback)
    return F.coalesce(made, F.when(codes.ean13_ok(last), last).otherwise(text_of(fallback)))


def first_valid_barcode(fields: Column) -> Column:
    """The first valid 13 digits of a row's two code fields, else empty."""
    found = F.transform(F.array(fields["barcode"], fields["qr_code_barcode"]), lambda v: digits(F.coalesce(v, F.lit(""))))
    return _first(F.filter(found, codes.ean13_ok))


def code_evidence(symbol_type: Column, symbol_payload: Column) -> Column:
    """Whether a symbol says which product it is on: a valid code, or a QR code with any other field."""
    fields = payload.parse(symbol_payload)
    values = F.transform(F.array(fields["barcode"], fields["qr_code_barcode"], symbol_payload), lambda v: codes.zone_ean13(F.coalesce(v, F.lit(""))))
    other = F.size(F.map_filter(fields, lambda k, v: ~k.isin("barcode", "qr_code_barcode"))) > 0
    return F.exists(values, codes.ean13_ok) | ((symbol_type == "qr") & F.coalesce(other, F.lit(False)))


def catalog_code(value: Column) -> Column:
    """A valid code of 13 digits, also behind one zero; else empty."""
    d = digits(value)
    bare = F.when((F.length(d) == 14) & d.startswith("0"), F.right(d, F.lit(13))).otherwise(d)
    return F.when(codes.ean13_ok(bare), bare).otherwise(F.lit(""))
