"""SQL for the quality rules, independent of their DataFrame form."""

from __future__ import annotations

from .quality import COMMON_WORDS, QualityRules, char_reference, small_letters_alone, without_common_words, word_reference


def oracle_sql(r: QualityRules = QualityRules()) -> str:
    listed = ", ".join(f"('{lang}', {list(words)!r}, {word_reference(lang)!r}::DOUBLE[], {char_reference(lang)!r}::DOUBLE[], {r.max_word_share * without_common_words(lang)!r}::DOUBLE, {r.max_char_share * small_letters_alone(lang)!r}::DOUBLE)" for lang, words in COMMON_WORDS.items())
    patterns = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"\p{N}", r"[.,;:!?''\"()\-]", r"[#*$%&|<>]"]
    left = ["t"]
    for p in patterns:
        left.append(f"regexp_replace({left[-1]}, '{p}+', '', 'g')")
    chars = ", ".join([f"length({a}) - length({b})" for a, b in zip(left, left[1:])] + [f"length({left[-1]})"])
    w = r.window
    js = lambda p, q: f"""sqrt(greatest(0.0, list_sum([
      (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0.0 END) / 2
      for z in list_transform(list_zip({p}, {q}), lambda x: [x[1], x[2]])])))"""  # noqa: E731
    return rf"""
WITH listed(lang, listed_words, rw, rc, far, odd) AS (VALUES {listed}),
base AS (SELECT doc_id, documents.lang, coalesce(text, '') AS t, listed_words, rw, rc, far, odd FROM documents LEFT JOIN listed ON listed.lang = documents.lang),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, [{chars}]::DOUBLE[] AS chars FROM base),
places AS (SELECT doc_id, i, ws[i : i + {w - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM cut)),
twice AS (SELECT doc_id, unnest(starts) AS i FROM (SELECT doc_id, list(i) AS starts FROM places GROUP BY doc_id, g HAVING count(*) > 1)),
reach AS (SELECT doc_id, least({w}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {w})) AS n FROM twice),
repeats AS (SELECT doc_id, sum(n) AS n_repeat_words FROM reach GROUP BY doc_id),
counted AS (SELECT doc_id, rw, rc, far, odd, len(ws) AS n_words, length(t) AS n_chars, length(t) - chars[2]::BIGINT AS word_chars, chars[6]::BIGINT AS n_symbols, chars,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, regexp_extract_all(translate(lower(t), '.,;:!?"''()', '          '), '[^\x20\x09-\x0D]+') AS cs, listed_words FROM cut),
hits AS (SELECT *, [len(list_filter(cs, lambda y: y = x)) for x in listed_words] AS hits FROM counted),
shares AS (SELECT *, [x / list_sum(chars) for x in chars] AS c, [x / len(cs) for x in list_append(hits, len(cs) - list_sum(hits))] AS w,
  listed_words IS NOT NULL AND n_chars >= {r.guard_chars} AND n_words >= {r.guard_words} AS guarded FROM hits),
measured AS (SELECT shares.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  CASE WHEN guarded THEN {js("c", "rc")} END AS char_distance,
  CASE WHEN guarded AND len(cs) > 0 THEN {js("w", "rw")} END AS word_distance FROM shares LEFT JOIN repeats USING (doc_id)),
failed AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance <= odd, TRUE) AND coalesce(word_distance <= far, TRUE) AS kept FROM failed
"""
