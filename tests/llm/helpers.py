from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string"
COMMON = "the of and to in is it that for with on as".split()


def words(rng: random.Random, n: int, common: float = 0.3) -> list[str]:
    made = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    # Common words by rank, as in running text.
    return [rng.choices(COMMON, [1 / (i + 1) for i in range(len(COMMON))])[0] if rng.random() < common else made() for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    w = words(rng, n)
    return " ".join(x + ("." if i % 12 == 11 else "") for i, x in enumerate(w)).capitalize()


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
