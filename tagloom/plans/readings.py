"""Queries over codes, payloads, names, votes, output rows, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates, payload, prices
from ..functions import text as X
from ..operators import assign, evaluate, gate, resolve, spatial, votes
from ..sources.tables import CODES_SQL, codes, ean_ok_sql, load, spread
from .registry import query

WITH = f"WITH {CODES_SQL}"


@query(
    f"""{WITH} SELECT p_partkey, code, {ean_ok_sql('code')} AS valid, body || right(true_code, 1) AS completed,
  CASE WHEN p_partkey % 3 = 0 THEN code WHEN p_partkey % 3 = 1 THEN '0' || body ELSE code END AS normal,
  CASE WHEN p_partkey % 4 = 0 AND {ean_ok_sql('code')} THEN code END AS alias FROM codes"""
)
def ean13_validate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, check digits, normal forms of 12 to 14 digits, and zero-stripped aliases."""
    c = codes(spark, sf_dir)
    form = F.when(F.col("p_partkey") % 3 == 0, F.col("code")).when(F.col("p_partkey") % 3 == 1, F.col("body")).otherwise(F.concat(F.lit("1-"), F.col("code")))
    packed = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("0"), F.col("code"))).otherwise(F.col("code"))
    return c.select(
        "p_partkey", "code", C.ean13_ok(F.col("code")).alias("valid"), F.concat("body", C.check_digit(F.col("body"))).alias("completed"),
        C.to_ean13(form).alias("normal"), C.zero_stripped_alias(packed).alias("alias"),
    )


@query(
    f"""{WITH}, broken AS (SELECT p_partkey, code FROM codes WHERE NOT {ean_ok_sql('code')}),
made AS (SELECT p_partkey, code, i, d, left(code, i - 1) || d::VARCHAR || substr(code, i + 1) AS x FROM broken, range(1, 14) t(i), range(10) u(d)),
good AS (SELECT * FROM made WHERE x <> code AND {ean_ok_sql('x')}),
first AS (SELECT p_partkey, arg_min(x, i * 10 + d) AS repaired, count(*) AS n FROM good GROUP BY p_partkey),
known AS (SELECT good.p_partkey, arg_min(x, i * 10 + d) AS in_catalog FROM good JOIN (SELECT DISTINCT true_code FROM whole) ON x = true_code GROUP BY good.p_partkey)
SELECT p_partkey, repaired, n, coalesce(in_catalog, '') AS in_catalog FROM first LEFT JOIN known USING (p_partkey)"""
)
def ean13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-digit repairs: the first by checksum, their number, and the first that the catalog knows."""
    c = codes(spark, sf_dir)
    broken = spread(c.where(~C.ean13_ok(F.col("code"))).select("p_partkey", "code"), "p_partkey").select("p_partkey", C.one_digit_repairs(F.col("code")).alias("all"))
    known = c.select(F.col("true_code").alias("x")).distinct()
    tries = broken.select("p_partkey", F.posexplode("all").alias("i", "x")).join(known, "x").groupBy("p_partkey").agg(F.min_by("x", "i").alias("found"))
    j = broken.join(tries, "p_partkey", "left")
    return j.select("p_partkey", F.coalesce(F.get("all", F.lit(0)), F.lit("")).alias("repaired"), F.size("all").cast("long").alias("n"), F.coalesce("found", F.lit("")).alias("in_catalog"))


@query(
    f"""{WITH} SELECT p_partkey, 13 AS n13, code AS first, 3 AS windows, '27' || lpad((p_partkey % 1000)::VARCHAR, 10, '0') AS sku,
  CASE WHEN {ean_ok_sql('code')} THEN code ELSE '' END AS found FROM codes"""
)
def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit windows, stock numbers behind look-alikes, and the first valid code in a text."""
    c = codes(spark, sf_dir)
    d = F.col("code")
    sku = F.concat(F.lit("27"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 10, "0"))
    seen = F.translate(F.concat(F.lit("no. "), sku, F.lit(" x")), "0", "O")
    spaced = F.concat(F.lit("EAN "), F.left(d, F.lit(1)), F.lit(" "), F.substr(d, F.lit(2), F.lit(6)), F.lit("-"), F.right(d, F.lit(6)), F.lit(" end"))
    w = C.digit_windows(F.concat(F.lit("a"), d, F.lit("b")))
    return c.select("p_partkey", F.length(w[0]).alias("n13"), w[0].alias("first"), F.size(w).alias("windows"), C.sku_candidates(seen)[0].alias("sku"), C.first_valid_ean13(spaced).alias("found"))


def _bars(code: Column) -> Column:
    """The 95 modules of a code."""
    left = {(s, d): p for s, d, p in C.module_patterns()}
    at = lambda i: F.substr(code, F.lit(i), F.lit(1))
    of = lambda s, c: F.coalesce(*[F.when(c == str(d), F.lit(left[s, d])) for d in range(10)])
    parity = F.coalesce(*[F.when(at(1) == str(d), F.lit(p)) for d, p in enumerate(C.PARITIES)])
    halves = [F.when(F.substr(parity, F.lit(i + 1), F.lit(1)) == "L", of("L", at(i + 2))).otherwise(of("G", at(i + 2))) for i in range(6)]
    return F.concat(F.lit("101"), *halves, F.lit("01010"), *[of("R", at(i + 8)) for i in range(6)], F.lit("101"))


@query(f"{WITH} SELECT p_partkey, CASE WHEN {ean_ok_sql('code')} THEN code ELSE '' END AS code, 0 AS errors FROM codes")
def ean13_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar modules of the codes, decoded; a code with a wrong check digit gives none."""
    bars = spread(codes(spark, sf_dir).select("p_partkey", "code"), "p_partkey").select("p_partkey", _bars(F.col("code")).alias("bits"))
    return bars.select("p_partkey", C.decode_modules(F.col("bits")).alias("x")).select("p_partkey", "x.code", "x.errors")


PAYLOADS_SQL = f"""{CODES_SQL}, payloads AS (SELECT p_partkey, code, p_retailprice, CASE p_partkey % 4
  WHEN 0 THEN 'b=' || code || ';p1=' || printf('%.2f', p_retailprice) || ';P-4=' || replace(printf('%.2f', p_retailprice * 0.8), '.', ',') || ';junk'
  WHEN 1 THEN 'https://q.example/t?barcode=' || code || '&price1=' || printf('%.2f', p_retailprice) || '&x=&ap=1%2C5#top'
  WHEN 2 THEN '{{"b": "' || code || '", "p1": ' || printf('%.2f', p_retailprice) || ', "other": true, "ac": null}}'
  ELSE code END AS payload FROM codes)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in the three forms, and bare codes."""
    c = codes(spark, sf_dir)
    money = lambda x: F.format_string("%.2f", x)
    p = F.col("p_retailprice")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("b="), "code", F.lit(";p1="), money(p), F.lit(";P-4="), F.replace(money(p * 0.8), F.lit("."), F.lit(",")), F.lit(";junk")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://q.example/t?barcode="), "code", F.lit("&price1="), money(p), F.lit("&x=&ap=1%2C5#top")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('{"b": "'), "code", F.lit('", "p1": '), money(p), F.lit(', "other": true, "ac": null}')))
        .otherwise(F.col("code"))
    )
    return c.select("p_partkey", "code", "p_retailprice", text.alias("payload"))


@query(
    f"""WITH {PAYLOADS_SQL} SELECT p_partkey, CASE p_partkey % 4
  WHEN 0 THEN 'price1_qr=' || printf('%.2f', p_retailprice) || ';price4_qr=' || printf('%.2f', p_retailprice * 0.8) || ';qr_code_barcode=' || code
  WHEN 1 THEN 'action_price_qr=1.5;price1_qr=' || printf('%.2f', p_retailprice) || ';qr_code_barcode=' || code
  WHEN 2 THEN 'action_code_qr=None;price1_qr=' || p_retailprice::VARCHAR || ';qr_code_barcode=' || code ELSE '' END AS fields FROM payloads"""
)
def parse_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(spark, sf_dir)
    return p.select("p_partkey", payload.encode(payload.parse(F.col("payload"))).alias("fields"))


@query(
    f"""WITH {PAYLOADS_SQL}, known AS (SELECT DISTINCT true_code FROM whole WHERE p_partkey % 2 = 0)
SELECT p_partkey, {ean_ok_sql('code')} AND true_code IS NOT NULL AS trusted, p_partkey % 4 <> 3 OR ({ean_ok_sql('code')} AND true_code IS NOT NULL) AS kept
FROM payloads LEFT JOIN known ON code = true_code"""
)
def symbol_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded symbols whose code is valid and in the catalog are trusted; others keep their safe fields, if they have any."""
    p = payloads(spark, sf_dir)
    known = codes(spark, sf_dir).where("p_partkey % 2 = 0").select(F.col("true_code").alias("known")).distinct()
    fields = payload.parse(F.col("payload"))
    d = p.select("p_partkey", fields.alias("fields"), X.digits(F.coalesce(fields["qr_code_barcode"], F.col("payload"))).alias("seen"))
    d = d.join(known, F.col("seen") == F.col("known"), "left")
    trusted = C.ean13_ok(F.col("seen")) & F.col("known").isNotNull()
    safe = F.map_filter("fields", lambda k, v: k != "qr_code_barcode")
    return d.select("p_partkey", trusted.alias("trusted"), (trusted | (F.size(safe) > 0)).alias("kept"))


@query(
    """WITH votes AS (SELECT o_custkey, o_orderstatus AS value, o_totalprice::DECIMAL(24,6) AS weight, o_orderkey AS ord FROM orders),
per AS (SELECT o_custkey, lower(value) AS n, sum(weight) AS w, min(ord) AS o, arg_min(value, ord) AS raw FROM votes GROUP BY ALL)
SELECT o_custkey, 'status' AS field, arg_max(raw, (w, -o)) AS value, max(w)::DOUBLE AS weight FROM per GROUP BY o_custkey"""
)
def weighted_vote_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("ord"))
    return votes.weighted_vote(o, ["o_custkey"]).withColumn("weight", F.col("weight").cast("double"))


@query(
    f"""{WITH}, spots AS (SELECT p_name, i, substr(code, i, 1) AS c, count(*) AS n, min(p_partkey) AS o FROM codes, range(1, 14) t(i) GROUP BY ALL),
best AS (SELECT p_name, i, arg_max(c, (n, -o)) AS c FROM spots GROUP BY p_name, i) SELECT p_name, string_agg(c, '' ORDER BY i) AS code FROM best GROUP BY p_name"""
)
def char_position_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.position_consensus(codes(spark, sf_dir), ["p_name"], "code", "p_partkey", 13)


@query(
    f"""{WITH}, readings AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 < 5 THEN min(true_code) OVER (PARTITION BY p_brand) ELSE true_code END AS code FROM whole),
spots AS (SELECT p_brand, i, substr(code, i, 1) AS c, count(*) AS n, min(p_partkey) AS o FROM readings, range(1, 14) t(i) GROUP BY ALL),
best AS (SELECT p_brand, i, arg_max(c, (n, -o)) AS c FROM spots GROUP BY p_brand, i), voted AS (SELECT p_brand, string_agg(c, '' ORDER BY i) AS v FROM best GROUP BY p_brand),
counted AS (SELECT p_brand, code, count(*) AS n, min(p_partkey) AS o FROM readings GROUP BY ALL), usual AS (SELECT p_brand, arg_max(code, (n, -o)) AS m, max(n) AS n FROM counted GROUP BY p_brand)
SELECT p_brand, CASE WHEN {ean_ok_sql('v')} THEN v ELSE m END AS code, m AS most, n FROM voted JOIN usual USING (p_brand)"""
)
def ean13_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of several readings per brand, and their mode."""
    c = codes(spark, sf_dir)
    usual = c.groupBy("p_brand").agg(F.min("true_code").alias("usual"))
    r = c.join(usual, "p_brand").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 7 < 5, F.col("usual")).otherwise(F.col("true_code")).alias("code"))
    m = votes.mode(r, ["p_brand"], "code", "p_partkey").select("p_brand", F.col("code").alias("most"), "n")
    return votes.ean13_consensus(r, ["p_brand"], "code", "p_partkey").join(m, "p_brand")


@query(
    """WITH skus AS (SELECT p_partkey // 4 AS lot, p_partkey, (CASE WHEN p_brand < 'Brand#2' THEN '27' ELSE '31' END) || lpad((CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE p_partkey END)::VARCHAR, 10, '0') AS sku FROM part),
counted AS (SELECT lot, sku, count(*) AS n, min(p_partkey) AS o FROM skus GROUP BY ALL), usual AS (SELECT lot, arg_max(sku, (n, -o)) AS m, max(n) AS n, sum(n) AS everything FROM counted GROUP BY lot),
spots AS (SELECT lot, i, substr(sku, i, 1) AS c, count(*) AS n, min(p_partkey) AS o FROM skus, range(1, 13) t(i) GROUP BY ALL),
best AS (SELECT lot, i, arg_max(c, (n, -o)) AS c FROM spots GROUP BY lot, i), voted AS (SELECT lot, string_agg(c, '' ORDER BY i) AS v FROM best GROUP BY lot)
SELECT lot, CASE WHEN n >= 2 THEN m WHEN everything >= 3 AND v[1:2] IN ('27', '37') THEN v ELSE '' END AS sku,
  CASE WHEN n >= 2 THEN 'exact_majority' WHEN everything >= 3 AND v[1:2] IN ('27', '37') THEN 'position_vote' ELSE 'insufficient_support' END AS method,
  CASE WHEN n >= 2 THEN 0.94 WHEN everything >= 3 AND v[1:2] IN ('27', '37') THEN 0.86 ELSE 0.0 END::DOUBLE AS confidence, n FROM usual JOIN voted USING (lot)"""
)
def sku_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock numbers of lots of four parts, of which one or two read the same."""
    p = load(spark, sf_dir, "part")
    number = F.when(F.col("p_partkey") % 3 == 0, F.lit(7)).otherwise(F.col("p_partkey")).cast("string")
    sku = F.concat(F.when(F.col("p_brand") < "Brand#2", F.lit("27")).otherwise(F.lit("31")), F.lpad(number, 10, "0"))
    return votes.sku_consensus(p.select(F.expr("p_partkey div 4").alias("lot"), "p_partkey", sku.alias("sku")), ["lot"], "sku", "p_partkey")


NAMES_SQL = """names AS (SELECT DISTINCT upper(p_name || ' ' || p_brand || p_type) AS name FROM part),
tokens AS (SELECT DISTINCT name, unnest(regexp_extract_all(name, '[0-9A-Z]+')) AS token FROM names),
rare AS (SELECT token, count(*) AS df, ln(1 + (SELECT count(*) FROM names) / count(*)) AS idf FROM tokens WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+')
  AND token NOT IN ('RED', 'THE', 'DO', 'LA', 'LE', 'DE', 'DI', 'DEL', 'AND', 'WINE', 'VINO') GROUP BY token)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.upper(F.concat("p_name", F.lit(" "), "p_brand", "p_type"))
    return codes(spark, sf_dir).join(load(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").select(name.alias("name"), F.col("true_code").alias("code"), F.col("p_partkey").alias("ord"))


@query(f"WITH {NAMES_SQL} SELECT token, df, round(idf, 6) AS idf FROM rare")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.index(catalog(spark, sf_dir))[2].withColumn("idf", F.round("idf", 6))


GRAMS_SQL = f"""{NAMES_SQL}, misread AS (SELECT token AS q0, left(token, 2) || 'X' || substr(token, 4) AS q FROM rare WHERE length(token) >= 5),
grams AS (SELECT DISTINCT token, substr('  ' || token || '  ', i, 3) AS g FROM rare, range(1, 40) t(i) WHERE i <= length(token) + 2 AND length(token) >= 4),
asked AS (SELECT DISTINCT q, substr('  ' || q || '  ', i, 3) AS g FROM misread, range(1, 40) t(i) WHERE i <= length(q) + 2),
near AS (SELECT q, token, count(*) AS n FROM asked JOIN grams USING (g) GROUP BY q, token HAVING count(*) >= 2)"""


@query(f"WITH {GRAMS_SQL} SELECT q, token, n FROM near")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name tokens that share two trigrams with a misread one."""
    _, grams, rare = resolve.index(catalog(spark, sf_dir))
    q = rare.where(F.length("token") >= 5).select(F.concat(F.left("token", F.lit(2)), F.lit("X"), F.substr("token", F.lit(4))).alias("q")).distinct()
    mine = q.select("q", F.explode(X.trigrams(F.col("q"))).alias("gram"))
    return mine.join(grams, "gram").groupBy("q", "token").agg(F.count("*").alias("n")).where("n >= 2")


@query(
    f"""WITH {GRAMS_SQL}, sized AS (SELECT q, token, least(length(q), length(token)) AS l, least(3, greatest(1, least(length(q), length(token)) // 4)) AS tol FROM near),
hits AS (SELECT q, token FROM sized WHERE q = token OR contains(token, q) OR contains(q, token) OR (abs(length(q) - length(token)) <= tol + 1 AND abs(length(q) - length(token)) <= 3 AND levenshtein(q, token) <= tol))
SELECT q, arg_max(token, (round(idf, 9), token)) AS token FROM hits JOIN rare USING (token) GROUP BY q"""
)
def fuzzy_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest plausible name token for each misread one."""
    tokens, grams, rare = resolve.index(catalog(spark, sf_dir))
    q = rare.where(F.length("token") >= 5).select(F.lit(0).alias("k"), F.concat(F.left("token", F.lit(2)), F.lit("X"), F.substr("token", F.lit(4))).alias("q")).distinct()
    hits = resolve.token_hits(q, "k", grams, tokens).join(rare, "token").where(F.length("token") >= 4)
    return hits.groupBy("q").agg(F.max_by("token", F.struct(F.round("idf", 9), "token")).alias("token"))


#: Names of which each seventh ends in a word of its own, and the texts read of each twentieth part: with C for E, and one letter of the own word misread.
RESOLVE_SQL = f"""{CODES_SQL},
made AS (SELECT part.p_partkey, part.p_name, p_type, true_code, CASE WHEN part.p_partkey % 7 = 0 THEN translate(substr(md5(part.p_partkey::VARCHAR), 1, 8), '0123456789abcdef', 'BCDFGHJKLMNPQRST') ELSE '' END AS own,
  trim(upper(part.p_name || ' ' || part.p_brand || p_type) || ' ' || own) AS name FROM part JOIN whole USING (p_partkey)),
names AS (SELECT name, min(p_partkey) AS place FROM made GROUP BY name),
tokens AS (SELECT DISTINCT name, unnest(regexp_extract_all(name, '[0-9A-Z]+')) AS token FROM names),
rare AS (SELECT token, count(*) AS df, ln(1 + (SELECT count(*) FROM names) / count(*)) AS idf FROM tokens WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+')
  AND token NOT IN ('RED', 'THE', 'DO', 'LA', 'LE', 'DE', 'DI', 'DEL', 'AND', 'WINE', 'VINO') GROUP BY token),
asked AS (SELECT p_partkey, unnest(regexp_extract_all(upper(replace(p_name, 'e', 'c') || ' ' || p_type || ' ' || left(own, 2) || CASE WHEN own = '' THEN '' ELSE 'X' END || substr(own, 4)), '[A-Z]+')) AS w FROM made WHERE p_partkey % 20 = 0),
q AS (SELECT DISTINCT p_partkey, regexp_replace(w, '^(BWHO|BHHO|BUHO|BUNO|BPHO|BHRO|BNHO|BHO|HO)(.{{3,}})$', '\\2') AS q FROM asked),
kept AS (SELECT * FROM q WHERE length(q) >= 3 AND q NOT IN ('BWHO', 'BHHO', 'BUHO', 'BUNO', 'BPHO', 'BHRO', 'BNHO', 'BHO', 'RED', 'THE', 'DEL', 'AND', 'WINE', 'VINO')),
grams AS (SELECT DISTINCT token, substr('  ' || token || '  ', i, 3) AS g FROM rare, range(1, 40) t(i) WHERE i <= length(token) + 2 AND length(token) >= 4),
mine AS (SELECT DISTINCT q, substr('  ' || q || '  ', i, 3) AS g FROM kept, range(1, 40) t(i) WHERE i <= length(q) + 2 AND length(q) >= 4),
near AS (SELECT q, token, least(length(q), length(token)) AS l, least(3, greatest(1, least(length(q), length(token)) // 4)) AS tol FROM mine JOIN grams USING (g) GROUP BY q, token HAVING count(*) >= 2),
hits AS (SELECT q, token FROM near WHERE q = token OR contains(token, q) OR contains(q, token) OR (abs(length(q) - length(token)) <= least(3, tol + 1) AND levenshtein(q, token) <= tol)
  UNION SELECT q, q FROM kept WHERE q IN (SELECT token FROM rare)),
per AS (SELECT p_partkey, name, q, arg_max({{'token': token, 'idf': idf}}, (q = token, idf)) AS b FROM kept JOIN hits USING (q) JOIN rare USING (token) JOIN tokens USING (token) GROUP BY p_partkey, name, q),
scored AS (SELECT p_partkey, name, sum(b.idf::DECIMAL(18,9))::DOUBLE AS score, max(CASE WHEN length(q) >= 4 AND length(b.token) >= 4 THEN b.idf ELSE 0 END) AS rarest FROM per GROUP BY p_partkey, name),
best AS (SELECT *, lead(score, 1, 0) OVER w AS second FROM scored JOIN names USING (name) WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, rarest DESC, place DESC) QUALIFY row_number() OVER w = 1),
bar AS (SELECT list_sort(list(idf))[floor(count(*) * 0.88)::INT + 1] AS bar FROM rare),
judged AS (SELECT *, rarest >= bar AND score >= greatest(6.0, 1.3 * second) AS accepted FROM best, bar)"""


@query(
    f"""WITH {RESOLVE_SQL} SELECT p_partkey, name, round(score, 3) AS score, round(score - second, 3) AS margin, accepted, CASE WHEN accepted THEN (SELECT min(true_code) FROM made m WHERE m.name = judged.name) ELSE '' END AS barcode,
  CASE WHEN accepted THEN 'confirmed' WHEN rarest > 0 THEN 'catalog_guess' ELSE 'unresolved' END AS status FROM judged"""
)
def resolve_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with misread letters, some of them with a word of their own, resolved against all names."""
    k = F.col("p_partkey")
    own = F.when(k % 7 == 0, F.translate(F.left(F.md5(k.cast("string")), F.lit(8)), "0123456789abcdef", "BCDFGHJKLMNPQRST")).otherwise(F.lit(""))
    p = load(spark, sf_dir, "part").withColumn("own", own)
    named = p.select("p_partkey", F.trim(F.concat(F.upper(F.concat("p_name", F.lit(" "), "p_brand", "p_type")), F.lit(" "), "own")).alias("name"))
    known = codes(spark, sf_dir).join(named, "p_partkey").select("name", F.col("true_code").alias("code"), k.alias("ord"))
    misread = F.concat(F.left("own", F.lit(2)), F.when(F.col("own") != "", F.lit("X")).otherwise(F.lit("")), F.substr("own", F.lit(4)))
    seen = F.upper(F.concat(F.regexp_replace("p_name", "e", "c"), F.lit(" "), "p_type", F.lit(" "), misread))
    queries = p.where("p_partkey % 20 = 0").select("p_partkey", F.array(seen).alias("texts"))
    found = resolve.resolve(queries, known, "p_partkey", "texts", place="ord")
    return found.select("p_partkey", "name", "score", "margin", "accepted", "barcode", "status")


@query(
    f"""{WITH}, forms AS (SELECT p_partkey, p_name, true_code, CASE WHEN p_partkey % 3 = 0 THEN '0' || true_code ELSE true_code END AS code FROM whole),
entries AS (SELECT code, p_name, 0 AS a, p_partkey FROM forms UNION ALL SELECT true_code, p_name, 1, p_partkey FROM forms WHERE p_partkey % 3 = 0),
known AS (SELECT code, arg_min(p_name, (a, p_partkey)) AS name FROM entries GROUP BY code)
SELECT p_partkey, known.name FROM whole JOIN known ON known.code = whole.true_code"""
)
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups in a catalog with zero-padded codes and their aliases; the first name of a code wins."""
    c = codes(spark, sf_dir)
    entries = c.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0"), "true_code")).otherwise(F.col("true_code")).alias("code"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    known = resolve.with_aliases(entries, "ord")
    return resolve.lookup(c.select("p_partkey", "true_code"), known, "p_partkey", "true_code")


ROWS_SQL = f"""{CODES_SQL}, rows_of AS (SELECT p_partkey, p_brand AS filename, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'нет' ELSE '' END AS product_name,
  CASE WHEN p_partkey % 4 = 0 THEN code ELSE '' END AS barcode, CASE WHEN p_partkey % 5 <> 1 THEN printf('%.2f', p_retailprice) ELSE '' END AS price_default,
  CASE WHEN p_partkey % 7 = 0 THEN printf('%.2f', p_retailprice * 1.5) WHEN p_partkey % 7 < 5 THEN printf('%.2f', p_retailprice * 0.7) ELSE '' END AS price_card,
  CASE WHEN p_partkey % 2 = 0 THEN '-25%' ELSE '' END AS discount_amount, CASE WHEN p_partkey % 6 = 0 THEN '270000000001' ELSE '' END AS id_sku, CASE WHEN p_partkey % 12 = 0 THEN '0,86' ELSE '0.5' END AS id_sku_confidence,
  CASE WHEN p_partkey % 9 = 0 THEN 'red' ELSE 'нет' END AS color, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ((p_partkey % 100) * 10)::VARCHAR END AS x_min FROM codes)"""


def output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the output table in several states of completeness."""
    c, k, p = codes(spark, sf_dir), F.col("p_partkey"), F.col("p_retailprice")
    money = lambda x: F.format_string("%.2f", x)
    blank = F.lit("")
    x = (k % 100) * 10
    return c.select(
        "p_partkey",
        F.col("p_brand").alias("filename"),
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.lit("нет")).otherwise(blank).alias("product_name"),
        F.when(k % 4 == 0, F.col("code")).otherwise(blank).alias("barcode"),
        blank.alias("qr_code_barcode"),
        F.when(k % 5 != 1, money(p)).otherwise(blank).alias("price_default"),
        F.when(k % 7 == 0, money(p * 1.5)).when(k % 7 < 5, money(p * 0.7)).otherwise(blank).alias("price_card"),
        F.when(k % 2 == 0, F.lit("-25%")).otherwise(blank).alias("discount_amount"),
        F.when(k % 6 == 0, F.lit("270000000001")).otherwise(blank).alias("id_sku"),
        F.when(k % 12 == 0, F.lit("0,86")).otherwise(F.lit("0.5")).alias("id_sku_confidence"),
        *[blank.alias(f) for f in ("print_datetime", "print_datetime_confidence", "code", "code_confidence")],
        F.when(k % 9 == 0, F.lit("red")).otherwise(F.lit("нет")).alias("color"),
        F.when(k % 11 == 0, blank).otherwise(x.cast("string")).alias("x_min"),
        F.lit("20").alias("y_min"),
        (x + 80).cast("string").alias("x_max"),
        F.lit("90,4").alias("y_max"),
    )


SCORED_SQL = f"""{ROWS_SQL}, flags AS (SELECT *, barcode <> '' AND {ean_ok_sql('barcode')} AS k, p_partkey % 3 = 0 AS named, price_card <> '' AS card, price_default <> '' AS d,
  coalesce(try_cast(price_card AS DECIMAL(18,4)) > try_cast(price_default AS DECIMAL(18,4)) + 0.01, false) AS inverted, p_partkey % 12 = 0 AS sku, p_partkey % 11 <> 0 AS located FROM rows_of),
scored AS (SELECT *, least(1.0, (CASE WHEN k AND named THEN 0.4 WHEN k OR named THEN 0.2 ELSE 0.0 END + CASE WHEN card THEN 0.15 ELSE 0.0 END + CASE WHEN d AND NOT inverted THEN 0.08 ELSE 0.0 END
  + CASE WHEN p_partkey % 2 = 0 AND NOT inverted THEN 0.05 ELSE 0.0 END + CASE WHEN sku THEN 0.22 ELSE 0.0 END + CASE WHEN p_partkey % 9 = 0 THEN 0.04 ELSE 0.0 END + CASE WHEN located THEN 0.08 ELSE 0.0 END))::DOUBLE AS confidence FROM flags)"""


@query(
    f"WITH {SCORED_SQL} SELECT p_partkey, round(confidence, 4) AS confidence, CASE WHEN round(confidence, 4) >= 0.6 THEN 'high' WHEN round(confidence, 4) >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM scored"
)
def confidence_score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = gate.with_facts(output_rows(spark, sf_dir))
    r = d.withColumn("c", gate.confidence(f))
    return r.select("p_partkey", "c.confidence", "c.tier")


@query(
    f"""WITH {SCORED_SQL}, decided AS (SELECT *, CASE WHEN NOT located THEN 'no_bbox' WHEN k THEN 'match_key' WHEN NOT (named OR sku OR card OR d) THEN 'no_evidence'
  WHEN round(confidence, 4) >= 0.40 THEN 'confidence' ELSE 'low_confidence' END AS why FROM scored),
flagged AS (SELECT *, bool_or(why IN ('match_key', 'confidence') AND k AND named) OVER (PARTITION BY filename) AS beside FROM decided),
raised AS (SELECT *, why IN ('match_key', 'confidence') AND beside AND NOT k AND NOT named AND NOT sku AND (card OR d) AND round(confidence, 4) < 0.45 AS weak FROM flagged)
SELECT p_partkey, why IN ('match_key', 'confidence') AND NOT weak AS keep, CASE WHEN weak THEN 'weak_price_only_beside_identity' ELSE why END AS reason FROM raised"""
)
def identity_present_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gated(output_rows(spark, sf_dir), ["filename"]).select("p_partkey", "keep", "reason")


@query(
    f"""WITH {ROWS_SQL}, priced AS (SELECT *, try_cast(price_default AS DECIMAL(18,4)) AS d, try_cast(price_card AS DECIMAL(18,4)) AS c FROM rows_of)
SELECT p_partkey, CASE WHEN discount_amount <> '' THEN discount_amount WHEN d > c AND trunc((d - c)::DOUBLE / d::DOUBLE * 100)::INT BETWEEN 1 AND 99 THEN '-' || trunc((d - c)::DOUBLE / d::DOUBLE * 100)::INT || '%' ELSE '' END AS discount_amount,
  CASE WHEN d IS NOT NULL THEN printf('%.2f', round_even(d::DOUBLE * 0.95, 0) - 0.01) ELSE '' END AS price2_qr,
  CASE WHEN p_partkey % 4 = 1 THEN 'Полусладкое' WHEN p_partkey % 4 = 2 THEN 'Сухое' ELSE '' END AS additional_info FROM priced"""
)
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields filled from the prices and the name."""
    k = F.col("p_partkey")
    r = output_rows(spark, sf_dir)
    name = F.when(k % 4 == 1, F.lit("Вино п/ сл 0.75")).when(k % 4 == 2, F.lit("Вино Сухое")).otherwise(F.lit(""))
    cells = {c: F.col(c) for c in ("price_default", "price_card", "discount_amount")} | {"product_name": name, **{c: F.lit("") for c in ("price1_qr", "price4_qr", "price2_qr", "additional_info")}}
    got = prices.derived_fields(cells)
    return r.select("p_partkey", *[got[c].alias(c) for c in ("discount_amount", "price2_qr", "additional_info")])


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE round(p_retailprice, 2) END AS price, p_partkey % 5 <> 4 AS equal, '-' || (p_partkey % 90 + 1) || '%' AS discount,
  CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 28 + 1) || '.2.2026 ' || (p_partkey % 24) || ':05' ELSE '' END AS printed, (p_partkey % 1000 * 1000 + 1)::BIGINT AS ms FROM part"""
)
def scalar_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in local spelling, discounts, printed dates, times."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    plain = F.format_string("%.2f", F.col("p_retailprice"))
    local = F.when(k % 5 == 4, F.lit("нет")).otherwise(F.concat(F.left(plain, F.lit(1)), F.lit(" "), F.replace(F.substr(plain, F.lit(2)), F.lit("."), F.lit(",")), F.lit(" ₽")))
    seen = F.when(k % 2 == 0, F.concat(F.lit("pr "), (k % 28 + 1).cast("string"), F.lit(",2.2026  "), (k % 24).cast("string"), F.lit(":05 x"))).otherwise(F.lit("none 1.2.26"))
    return p.select(
        "p_partkey", prices.price(local).cast("double").alias("price"), prices.prices_equal(local, plain).alias("equal"), prices.discount_text(F.concat(F.lit("sale "), (k % 90 + 1).cast("string"), F.lit(" %"))).alias("discount"),
        dates.printed(seen).alias("printed"), dates.timestamp_ms(F.concat((k % 1000).cast("string"), F.lit("000,5"))).alias("ms"),
    )


@query(
    """SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS token, lower(replace(p_name, ' ', '-')) || '-x' AS slug, substr(p_name || '-' || p_brand, 1, 9) || '...' AS short,
  levenshtein(p_type, 'ECONOMY') AS raw, CASE WHEN abs(length(p_type) - 7) > 3 THEN 99 ELSE levenshtein(p_type, 'ECONOMY') END AS bounded FROM part"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    second = F.split("p_name", " ")[1]
    return p.select(
        "p_partkey", X.brand_tokens(F.array(F.concat(F.lit("BHO"), second)))[0].alias("token"), X.slug(F.concat(F.lit("  "), F.col("p_name"), F.lit(" / X!"))).alias("slug"),
        X.truncated(F.concat("p_name", F.lit("-"), "p_brand"), 12).alias("short"), F.levenshtein("p_type", F.lit("ECONOMY")).alias("raw"), X.edit_distance(F.col("p_type"), F.lit("ECONOMY")).alias("bounded"),
    )


PAIRS_SQL = """labelled AS (SELECT o_orderkey AS id, o_custkey % 20 AS video, repeat(chr(65 + (o_orderkey % 8)::INT), 6 + (o_orderkey % 5)::INT) AS name, printf('%.2f', o_totalprice) AS price, o_orderpriority AS info,
  CASE WHEN o_orderkey % 4 = 0 THEN (270000000000 + o_custkey)::VARCHAR ELSE '' END AS code, (o_orderkey * 37) % 1800 AS x, (o_orderkey * 91) % 1000 AS y, o_custkey FROM orders),
guessed AS (SELECT id, video, CASE WHEN id % 5 = 0 THEN 'Q' || name ELSE name END AS name, CASE WHEN id % 3 = 0 THEN '1.00' ELSE price END AS price, CASE WHEN id % 7 = 0 THEN '' ELSE lower(info) END AS info,
  CASE WHEN id % 3 = 0 THEN (270000000000 + o_custkey)::VARCHAR ELSE '' END AS code, x + (id * 13) % 64 - 32 AS x, y + (id * 7) % 40 - 20 AS y FROM labelled)"""


def labelled_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows of all orders, and predictions near them: boxes meet those of several rows, and a customer's rows share a code."""
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders")
    code = (F.lit(270000000000) + F.col("o_custkey")).cast("string")
    spaced = F.concat(F.left(code, F.lit(4)), F.lit(" "), F.substr(code, F.lit(5)))
    t = o.select(
        k.alias("truth_id"), (F.col("o_custkey") % 20).alias("video"), F.repeat(F.char(65 + k % 8), (6 + k % 5).cast("int")).alias("product_name"), F.format_string("%.2f", F.col("o_totalprice")).alias("price_card"), F.col("o_orderpriority").alias("additional_info"),
        evaluate.row_code(F.when(k % 4 == 0, spaced).otherwise(F.lit("4 00")), F.lit("")).alias("code"), ((k * 37) % 1800).alias("x"), ((k * 91) % 1000).alias("y"), code.alias("own"),
    )
    i = F.col("truth_id")
    p = t.select(
        i.alias("pred_id"), "video", F.when(i % 5 == 0, F.concat(F.lit("Q"), "product_name")).otherwise(F.col("product_name")).alias("product_name"),
        F.when(i % 3 == 0, F.lit("1.00")).otherwise(F.col("price_card")).alias("price_card"), F.when(i % 7 == 0, F.lit("")).otherwise(F.lower("additional_info")).alias("additional_info"),
        evaluate.row_code(F.when(i % 6 == 0, F.col("own")).otherwise(F.lit("нет")), F.when(i % 6 == 3, F.col("own"))).alias("code"), (F.col("x") + i * 13 % 64 - 32).alias("x"), (F.col("y") + i * 7 % 40 - 20).alias("y"),
    )
    boxed = lambda d: d.withColumn("bbox", F.struct(F.col("x").alias("x_min"), F.col("y").alias("y_min"), (F.col("x") + 120).alias("x_max"), (F.col("y") + 80).alias("y_max"))).drop("x", "y")
    return boxed(p), boxed(t.drop("own"))


#: `hits`: pred, truth and their number of equal fields, for pairs in `matched` (pred, truth).
FIELD_HITS_SQL = """hits AS (SELECT m.pred, m.truth, (CASE WHEN right(g.name, 1) = left(l.name, 1) AND 2 * least(length(l.name), length(ltrim(g.name, 'Q'))) / (length(g.name) + length(l.name))::DOUBLE >= 0.85 THEN 1 ELSE 0 END
  + CASE WHEN abs(g.price::DECIMAL(18,4) - l.price::DECIMAL(18,4)) <= 0.01 THEN 1 ELSE 0 END + CASE WHEN g.info = lower(l.info) THEN 1 ELSE 0 END)::BIGINT AS n_matches FROM matched m JOIN guessed g ON g.id = m.pred JOIN labelled l ON l.id = m.truth)"""
#: `matched`: the predicted rows of a video, one after the other, each take the first of their wishes that is free.
MATCHED_SQL = """known AS (SELECT video, code, min(id) AS id FROM labelled WHERE code <> '' GROUP BY video, code),
met AS (SELECT *, area / (2 * 9600 - area) AS iou FROM (SELECT g.video, g.id AS pred, l.id AS truth, (greatest(0, least(g.x, l.x) + 120 - greatest(g.x, l.x)) * greatest(0, least(g.y, l.y) + 80 - greatest(g.y, l.y)))::DOUBLE AS area
  FROM guessed g JOIN labelled l ON g.video = l.video AND abs(g.x - l.x) < 120 AND abs(g.y - l.y) < 80)),
edges AS (SELECT video, pred, truth, CASE WHEN max(by_code) THEN 1.0::DOUBLE ELSE max(iou) END AS iou, max(by_code) AS by_code FROM (SELECT video, pred, truth, iou, FALSE AS by_code FROM met WHERE iou >= 0.5::DOUBLE
  UNION ALL SELECT g.video, g.id, k.id, 1.0::DOUBLE, TRUE FROM guessed g JOIN known k ON k.video = g.video AND k.code = g.code) GROUP BY video, pred, truth),
turns AS (SELECT video, pred, row_number() OVER (PARTITION BY video ORDER BY pred) AS turn, wishes FROM (SELECT video, pred, list(truth ORDER BY by_code DESC, iou DESC, truth) AS wishes FROM edges GROUP BY video, pred)),
walk AS (SELECT video, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS pred, NULL::BIGINT AS truth FROM (SELECT DISTINCT video FROM turns)
  UNION ALL SELECT video, turn, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pred, pick
  FROM (SELECT t.video, t.turn, w.taken, t.pred, list_filter(t.wishes, lambda x: NOT list_contains(w.taken, x))[1] AS pick FROM walk w JOIN turns t ON t.video = w.video AND t.turn = w.turn + 1)),
matched AS (SELECT w.video, w.pred, w.truth, e.iou, e.by_code FROM walk w JOIN edges e ON e.pred = w.pred AND e.truth = w.truth)"""


FIELDS = ["product_name", "price_card", "additional_info"]


def _paired(p: DataFrame, t: DataFrame, matched: DataFrame) -> DataFrame:
    left = p.select("pred_id", *[F.col(f).alias(f"p_{f}") for f in FIELDS])
    right = t.select("truth_id", *[F.col(f).alias(f"t_{f}") for f in FIELDS])
    return matched.join(left, "pred_id").join(right, "truth_id")


@query(f"""WITH {PAIRS_SQL}, matched AS (SELECT id AS pred, id AS truth FROM labelled), {FIELD_HITS_SQL} SELECT truth AS id, 3 AS n_fields, n_matches FROM hits""")
def evaluate_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields compared by their kinds, given the pairs."""
    p, t = labelled_pairs(spark, sf_dir)
    matched = p.select("pred_id", F.col("pred_id").alias("truth_id"))
    return evaluate.field_scores(_paired(p, t, matched), ["truth_id"], FIELDS).withColumnRenamed("truth_id", "id")


@query(f"""WITH RECURSIVE {PAIRS_SQL}, {MATCHED_SQL} SELECT video, pred AS pred_id, truth AS truth_id, round(iou, 6) AS iou, by_code FROM matched""")
def evaluate_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted rows in their order, each matched by its code, else by the overlap that is left."""
    p, t = labelled_pairs(spark, sf_dir)
    return evaluate.match_rows(p, t, "video", 0.5, 256).withColumn("iou", F.round("iou", 6))


@query(
    f"""WITH RECURSIVE {PAIRS_SQL}, {MATCHED_SQL}, {FIELD_HITS_SQL}, scored AS (SELECT m.*, n_matches / 3.0::DOUBLE AS s FROM matched m JOIN hits USING (pred, truth)), n AS (SELECT count(*) AS n FROM labelled)
SELECT count(*) AS matched, count(*) FILTER (WHERE s >= 0.8) AS correct, count(*) FILTER (WHERE s >= 0.8) / any_value(n)::DOUBLE AS score, round(avg(s), 6) AS field_accuracy, round(avg(iou), 6) AS mean_iou,
  any_value(n) - count(*) AS unmatched_pred, any_value(n) - count(*) AS unmatched_truth FROM scored, n"""
)
def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = labelled_pairs(spark, sf_dir)
    matched = evaluate.match_rows(p, t, "video", 0.5, 256)
    scores = evaluate.field_scores(_paired(p, t, matched), ["pred_id", "truth_id"], FIELDS)
    return evaluate.totals(matched, scores, p.count(), t.count())
