"""Product codes: EAN-13 checks, normal forms, repair and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, text_of


def check_digit(first12: Column) -> Column:
    """The thirteenth digit of a code of twelve: one sum of twelve casts, so that the check stays flat inside larger expressions."""
    at = lambda i: F.substr(first12, F.lit(i + 1), F.lit(1)).try_cast("int")
    odd, even = at(0), at(1)
    for i in range(2, 12, 2):
        odd, even = odd + at(i), even + at(i + 1)
    return F.when(first12.rlike(r"^[0-9]{12}$"), F.pmod(F.lit(0) - (odd + 3 * even), F.lit(10)).cast("string"))


def _place(number: Column, i: int) -> Column:
    """The digit at place `i` (from 1) of a number of thirteen digits."""
    return F.call_function("div", number, F.lit(10 ** (13 - i))) % 10


def _off(number: Column) -> Column:
    """What the checksum of a number of thirteen digits is off by: 0 to 9. Whole-number work, which stays small and compiled."""
    odd, even = _place(number, 1), _place(number, 2)
    for i in range(3, 14, 2):
        odd = odd + _place(number, i)
    for i in range(4, 13, 2):
        even = even + _place(number, i)
    return (odd + 3 * even) % 10


def ean13_ok(code: Column) -> Column:
    """Whether a code has thirteen digits that fit. A lambda binds the code, so that its own expression stands in a filter once, not for each digit."""
    number = lambda c: F.when(c.rlike(r"^\d{13}$") & (F.length(c) == 13), c.try_cast("long"))
    return F.coalesce(F.exists(F.transform(F.array(text_of(code)), number), lambda n: _off(n) == 0), F.lit(False))


def to_ean13(code: Column) -> Column:
    """Thirteen digits from 12 (a zero before), 13 or 14 (the first dropped, whether or not the rest is valid); else empty."""
    d = digits(code)
    return (
        F.when(F.length(d) == 13, d)
        .when(F.length(d) == 14, F.right(d, F.lit(13)))
        .when(F.length(d) == 12, F.concat(F.lit("0"), d))
        .otherwise(F.lit(""))
    )


def zone_ean13(code: Column) -> Column:
    """The form for codes read in a zone: 12 or 13 digits alone."""
    d = digits(code)
    return F.when(F.length(d) == 13, d).when(F.length(d) == 12, F.concat(F.lit("0"), d)).otherwise(F.lit(""))


def zero_stripped_alias(code: Column) -> Column:
    """A catalog's second key: a valid code of 13 digits behind one zero; else null."""
    d = digits(code)
    return F.when((F.length(d) == 14) & d.startswith("0") & ean13_ok(F.right(d, F.lit(13))), F.right(d, F.lit(13)))


def trusted_ean13(code: Column) -> Column:
    return ean13_ok(to_ean13(digits(code)))


def one_digit_repairs(code: Column) -> Column:
    """All valid codes that differ from thirteen digits in one place, by place and then by digit.

    The weights 1 and 3 have inverses by tens, so a wrong checksum is mended by one digit at each place, and a right one by none. Lambdas bind
    the number and what it is off by: a filter on the result is pushed down with the code's own expression in each place that names it.
    """
    c = digits(code)

    def mended(n: Column, off: Column, i: int) -> Column:
        old = _place(n, i)
        new = F.pmod(old - off * (7 if i % 2 == 0 else 1), F.lit(10))
        return F.lpad((n + (new - old) * 10 ** (13 - i)).cast("string"), 13, "0")

    def of(n: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.array(_off(n)), lambda o: o != 0), lambda o: F.array(*[mended(n, o, i) for i in range(1, 14)])))

    return F.flatten(F.transform(F.filter(F.array(F.when(F.length(c) == 13, c.try_cast("long"))), lambda n: n.isNotNull()), of))


def repair_one_digit(code: Column) -> Column:
    """The code if valid, else its first repair, else empty."""
    c = digits(code)
    return F.when(ean13_ok(c), c).otherwise(F.coalesce(F.get(one_digit_repairs(c), F.lit(0)), F.lit("")))


def digit_windows(text: Column) -> Column:
    """Runs of 13 and then of 12 digits inside the digits of a text, each once."""
    d = digits(text)
    of = lambda n: F.when(
        F.length(d) >= n, F.transform(F.sequence(F.lit(1), F.length(d) - n + 1), lambda i: F.substr(d, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(13), of(12)))


# Signs that are read for digits.
LOOK_ALIKES = {
    "O": "0",
    "o": "0",
    "О": "0",
    "о": "0",
    "Q": "0",
    "I": "1",
    "i": "1",
    "l": "1",
    "L": "1",
    "І": "1",
    "|": "1",
    "S": "5",
    "s": "5",
    "B": "8",
    "З": "3",
    "з": "3",
}


def look_alikes(text: Column) -> Column:
    """Signs that are read for digits, as digits."""
    return F.translate(text_of(text), "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))


def digit_runs(text: Column) -> Column:
    """Digits of runs of 11 to 20 signs (digits that spaces or hyphens may part) that stand alone, and all digits of the text if they are 11 to 14; each once."""
    seen = look_alikes(text)
    runs = F.transform(F.regexp_extract_all(seen, F.lit(r"(?U)(?<!\w)[0-9][0-9\s\-]{9,18}[0-9](?!\w)"), F.lit(0)), digits)
    every = digits(seen)
    return F.array_distinct(F.concat(runs, F.when(F.length(every).between(11, 14), F.array(every)).otherwise(F.array().cast("array<string>"))))


def sku_candidates(text: Column) -> Column:
    """Twelve digits that begin with 27 or 37, from digit runs of 12 to 14 after undoing look-alikes."""
    windows = F.flatten(
        F.transform(
            F.filter(digit_runs(text), lambda r: F.length(r).between(12, 14)),
            lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 11), lambda i: F.substr(r, i, F.lit(12))),
        )
    )
    return F.array_distinct(F.filter(windows, lambda w: w.rlike("^[23]7")))


def first_valid_ean13(text: Column) -> Column:
    """The first valid code in a text whose digits spaces or hyphens may part."""
    found = F.transform(F.regexp_extract_all(text_of(text), F.lit(r"(?U)\b(\d(?:[\s\-]?\d){12})\b"), F.lit(1)), digits)
    return F.coalesce(F.get(F.filter(found, ean13_ok), F.lit(0)), F.lit(""))


# The EAN-13 patterns of the digits 0 to 9 in the left odd set, and the parities by first digit.
L_CODES = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
PARITIES = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()


def module_patterns() -> list[tuple[str, int, str]]:
    """(set, digit, pattern) for the left odd (L), left even (G) and right (R) sets; G and R follow from L."""
    out = []
    for d, p in enumerate(L_CODES):
        right = p.translate(str.maketrans("01", "10"))
        out += [("L", d, p), ("G", d, right[::-1]), ("R", d, right)]
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _nearest_patterns() -> tuple[list[int], list[int]]:
    """For each seven modules as a number, in the left half (0 to 127) and in the right one (128 to 255): the first nearest pattern's place in the table, and its errors."""
    table, best = module_patterns(), []
    for half in ("LG", "R"):
        options = [(k, int(p, 2)) for k, (s, _, p) in enumerate(table) if s in half]
        best += [min(((seen ^ p).bit_count(), k) for k, p in options) for seen in range(128)]
    return [k for _, k in best], [e for e, _ in best]


def decode_modules(bits: Column) -> Column:
    """struct(code, errors) from 95 modules: per digit the nearest pattern, the first digit from the parities; code empty beyond 8 errors or if invalid.

    Modules that are all 0 or 1 are looked up by their number; other signs are compared with every pattern.
    """
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(str(d)).alias("d"), F.lit(p).alias("p")) for k, (s, d, p) in enumerate(module_patterns())])
    place, errors = (F.lit(x) for x in _nearest_patterns())

    def nearest(bits: Column, i: Column) -> Column:
        seen = F.substr(bits, F.when(i < 6, 4 + 7 * i).otherwise(50 + 7 * (i - 6) + 1), F.lit(7))
        options = F.filter(table, lambda t: (t["s"] == "R") == (i >= 6))
        return F.array_min(F.transform(options, lambda t: F.struct(hamming(seen, t["p"]).alias("e"), t["k"].alias("k"), t["s"].alias("s"), t["d"].alias("d"))))

    def looked_up(n: Column) -> Column:
        t = F.get(table, F.get(place, n))
        return F.struct(F.get(errors, n).alias("e"), t["k"].alias("k"), t["s"].alias("s"), t["d"].alias("d"))

    def read(bits: Column) -> Column:
        numbers = [F.conv(F.substr(bits, F.lit(4 + 7 * i if i < 6 else 9 + 7 * i), F.lit(7)), 2, 10).cast("int") + (0 if i < 6 else 128) for i in range(12)]
        plain = F.transform(F.array(*numbers), looked_up)
        return F.when(bits.rlike("^[01]{95}$") & (F.length(bits) == 95), plain).otherwise(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: nearest(bits, i)))

    def joined(best: Column) -> Column:
        parity = F.array_join(F.transform(F.slice(best, 1, 6), lambda x: x["s"]), "")
        first = F.array_position(F.array(*map(F.lit, PARITIES)), parity)
        code = F.concat(F.when(first > 0, (first - 1).cast("string")), F.array_join(F.transform(best, lambda x: x["d"]), ""))
        return F.struct(code.alias("code"), F.aggregate(best, F.lit(0), lambda a, x: a + x["e"]).alias("errors"))

    # Lambdas bind the modules and what is read from them, so that each is made once.
    found = F.transform(F.transform(F.array(bits), read), joined)
    checked = F.transform(found, lambda x: F.struct(F.when(ean13_ok(x["code"]) & (x["errors"] <= 8) & (F.length(bits) == 95), x["code"]).otherwise(F.lit("")).alias("code"), x["errors"].alias("errors")))
    return checked[0]
