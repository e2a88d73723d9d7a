"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and its histogram of common words are compared with the references of
its language by the Jensen-Shannon distance (base 2, 0 to 1). References are fixed, one of each kind for every language: rounded shares of
character classes, as large general corpora of the language have them (German writes nouns with capitals and has long words, French
has many apostrophes), and for the common words, listed by rank, a share that falls with the rank (Zipf's law) from that of
the language's commonest word. Thresholds follow the language, too: they are shares of how far a text of small letters and spaces alone, and one
without any common word, is from its language's references (German has more capitals to miss). So a verdict depends on the document alone, and nothing is
shuffled. The measures are written to the shared folder once, so that no later filter on a verdict makes them again.

Defined cases: a null or empty text has no words and fails the base rules. A document of a null or unlisted language and
one shorter than a guard is not judged by the distances. Rows with equal texts and languages get equal
verdicts, repeated rows stay repeated. A very long text is measured whole, in one task, whose memory holds its words and their windows'
hashes a few times over. Empty tables give no rows. Extra columns of any name pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .frames import boxed, column_index, only_boxed, unboxed

# The most common words of each language by rank. They count in any letter case, with points cut off.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": (
        "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be",
        "by", "as", "this", "are", "at", "from", "or", "an", "have", "not", "but", "he", "they", "you",
        "his", "her", "had", "which", "one", "all", "we", "were", "their", "been", "has", "when", "who", "will",
        "more", "no", "if", "out", "so", "there", "what", "can",
    ),
    "fr": (
        "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui",
        "par", "dans", "sur", "au", "pas", "avec", "il", "ne", "ce", "se", "plus", "son", "sa", "ses",
        "ou", "mais", "sont", "nous", "vous", "elle", "ils", "cette", "ces", "aux", "été", "être", "comme", "leur",
        "on", "tout", "fait", "si", "je", "y", "dont", "avoir",
    ),
    "de": (
        "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "des", "für", "ist",
        "nicht", "dem", "im", "ein", "als", "eine", "es", "an", "auch", "er", "hat", "dass", "sie", "nach",
        "wird", "bei", "einer", "um", "am", "sind", "noch", "wie", "einem", "über", "einen", "so", "zum", "war",
        "haben", "nur", "oder", "aber", "vor", "zur", "bis", "mehr",
    ),
    "es": (
        "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con",
        "su", "una", "es", "para", "al", "lo", "como", "más", "a", "o", "pero", "sus", "le", "ha",
        "este", "sí", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde",
        "desde", "todo", "nos", "durante", "uno", "ni", "contra", "ese",
    ),
}
# The share of each language's commonest word in running text; the word of rank r has the r-th part of it.
TOP_SHARES = {"en": 0.06, "fr": 0.055, "de": 0.05, "es": 0.06}
# The classes of characters, each taken from what the earlier ones left.
CHAR_CLASSES: tuple[tuple[str, str], ...] = (
    ("lower", r"\p{Ll}+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"\p{Lu}+"),
    ("digit", r"\p{N}+"),
    ("point", r"[.,;:!?'\"()\-]+"),
    ("symbol", r"[#*$%&|<>]+"),
)
# The shares of these classes in running text; what is left are other characters.
CHAR_SHARES = {
    "en": (0.780, 0.170, 0.022, 0.003, 0.022, 0.0),
    "fr": (0.775, 0.160, 0.020, 0.003, 0.034, 0.0),
    "de": (0.770, 0.143, 0.055, 0.003, 0.024, 0.0),
    "es": (0.785, 0.165, 0.020, 0.003, 0.022, 0.0),
}
SPACE = r"[\x20\x09-\x0D]+"
#: What stands between words that are looked up: white space and points.
BETWEEN = r"[\x20\x09-\x0D.,;:!?\"'()]+"


def word_reference(lang: str) -> list[float]:
    """The shares of a language's listed words, and of all others."""
    shares = [TOP_SHARES[lang] / (r + 1) for r in range(len(COMMON_WORDS[lang]))]
    return [*shares, 1.0 - sum(shares)]


def char_reference(lang: str) -> list[float]:
    """The shares of a language's classes of characters, and of all others."""
    return [*CHAR_SHARES[lang], round(1.0 - sum(CHAR_SHARES[lang]), 6)]


def _apart(p: list[float], q: list[float]) -> float:
    """The Jensen-Shannon distance of two references."""
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2)


def without_common_words(lang: str) -> float:
    """How far a text that holds none of the listed words is from its language's reference."""
    words = word_reference(lang)
    return _apart([*[0.0] * (len(words) - 1), 1.0], words)


def small_letters_alone(lang: str) -> float:
    """How far a text of small letters and spaces, in the language's proportion, is from its reference."""
    chars = char_reference(lang)
    both = chars[0] + chars[1]
    return _apart([chars[0] / both, chars[1] / both, *[0.0] * (len(chars) - 2)], chars)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; a distance above its maximum rejects, if the document is at least as long as the guards say."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: A share of the distance of a text of small letters and spaces alone: missing capitals and points don't reject.
    max_char_share: float = 1.15
    #: A share of the distance of a text without any listed word.
    max_word_share: float = 0.9
    guard_chars: int = 400
    guard_words: int = 60


def _hashed_pairs(a: Column, by: int) -> Column:
    """The hash of each element with the one `by` places on, for every element that has one."""
    rest = F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))), rest, lambda x, y: F.xxhash64(x, y))


def _measured(df: DataFrame, window: int) -> DataFrame:
    """Adds to `k_text`, `k_lang` the measures, `chars` (counts by class, rest last) and `common` (counts by word, rest last)."""
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    kept = df.columns
    df = df.withColumn("_t", F.coalesce("k_text", F.lit("")))
    rest, sizes = F.col("_t"), []
    for name, pattern in CHAR_CLASSES:
        df = df.withColumn(f"_t_{name}", F.regexp_replace(rest, pattern, ""))
        sizes.append((F.length(rest) - F.length(f"_t_{name}")).alias(f"_n_{name}"))
        rest = F.col(f"_t_{name}")
    sizes.append(F.length(rest).alias("_n_rest"))
    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        listed = F.when(F.col("k_lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    cut = F.array_remove(F.split(F.lower("_t"), BETWEEN), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*kept, F.length("_t").alias("n_chars"), *sizes, listed.alias("_list"), lines.alias("_lines"), F.array_remove(F.split("_t", SPACE), "").alias("_words"), F.when(listed.isNotNull(), cut).alias("_cut"))
    # From here on windows are compared by 64-bit hashes, within one document only.
    df = df.withColumns({"_hits": F.filter("_cut", lambda w: w.isin(every)), "_w1": F.transform("_words", lambda w: F.xxhash64(w))})
    by = 1
    while by < window:
        # No window is found twice where all of its length's half are different.
        longer = _hashed_pairs(F.col(f"_w{by}"), by)
        if 1 < by == window // 2:
            longer = F.when(F.size(F.array_distinct(f"_w{by}")) < F.size(f"_w{by}"), longer)
        df = df.withColumn(f"_w{2 * by}", longer)
        by *= 2
    df = df.select(
        *kept,
        "n_chars",
        *[f"_n_{c}" for c, _ in CHAR_CLASSES],
        "_n_rest",
        F.size("_words").alias("n_words"),
        F.size("_cut").alias("_n_cut"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.transform("_list", lambda w: F.size("_hits") - F.size(F.array_remove("_hits", w))).alias("_counts"),
        F.col(f"_w{window}").alias("_g"),
    )
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_s", F.when(again, F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    h = lambda i: F.get("_s", i)["h"]
    twice = F.filter("_s", lambda x, i: F.coalesce(x["h"] == h(i + 1), F.lit(False)) | F.when(i > 0, x["h"] == h(i - 1)).otherwise(False))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    reach = F.transform("_p", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_p", i + 1) - p, F.lit(window))))
    listed_words = F.aggregate("_counts", F.lit(0), lambda a, x: a + x)
    return df.select(
        *kept,
        "n_chars",
        "n_words",
        (F.col("n_chars") - F.col("_n_space")).alias("word_chars"),
        F.col("_n_symbol").alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n_repeat_words"),
        F.array(*[f"_n_{c}" for c, _ in CHAR_CLASSES], "_n_rest").alias("chars"),
        F.concat("_counts", F.array(F.col("_n_cut") - listed_words)).alias("common"),
    )


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2) of two arrays of shares of equal length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), carry: list[str] | None = None) -> DataFrame:
    """All rows of `docs` and the columns in `carry` (default: all), with the measures, both distances (null: not judged), base_failed and kept."""
    boxes, places = boxed(docs, "text", "lang"), None
    if carry is not None:
        places = [column_index(docs, c) for c in carry]
        boxes = only_boxed(boxes, places)
    d = stored(_measured(boxes, rules.window).drop("k_text"), "quality", "zstd")
    d = d.withColumns({"_c": _shares("chars"), "_w": _shares("common")})
    words, chars = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    far, odd = F.lit(None).cast("double"), F.lit(None).cast("double")
    for lang in COMMON_WORDS:
        mine = F.col("k_lang") == lang
        words = F.when(mine, F.array(*map(F.lit, word_reference(lang)))).otherwise(words)
        chars = F.when(mine, F.array(*map(F.lit, char_reference(lang)))).otherwise(chars)
        far = F.when(mine, F.lit(rules.max_word_share * without_common_words(lang))).otherwise(far)
        odd = F.when(mine, F.lit(rules.max_char_share * small_letters_alone(lang))).otherwise(odd)
    judged = (F.col("n_chars") >= rules.guard_chars) & (F.col("n_words") >= rules.guard_words) & F.col("k_lang").isin(list(COMMON_WORDS))
    d = d.withColumns(
        {
            "_cd": F.when(judged, js_distance(F.col("_c"), chars)),
            # A text of points alone has no words to compare.
            "_wd": F.when(judged & F.col("_w").isNotNull(), js_distance(F.col("_w"), words)),
            "_failed": (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words").cast("long") > rules.max_repeat_percent * F.col("n_words").cast("long")),
        }
    )
    fits = F.coalesce(F.col("_cd") <= odd, F.lit(True)) & F.coalesce(F.col("_wd") <= far, F.lit(True))
    return unboxed(
        d,
        docs,
        places,
        **{k: F.col(k).cast("long") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
        char_distance=F.col("_cd"),
        word_distance=F.col("_wd"),
        base_failed=F.col("_failed"),
        kept=~F.col("_failed") & fits,
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept rows with the columns of `docs`, columns named like a measure included."""
    names = docs.columns
    plain = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    own = {n: F.col(f"_d{column_index(docs, n)}") for n in ("text", "lang")}
    return judge(plain.withColumns(own), rules, plain.columns).where("kept").select(*plain.columns).toDF(*names)


#: For the registered query and the pipeline alike.
PRODUCTION = QualityRules()
