"""Queries that fuse readings into rows and score them against reference entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuse, price_blocks, score, votes
from ..sources.tables import DETECTIONS_SQL, load
from .observations import detections
from .readings import PAYLOADS_SQL, payloads
from .registry import query

COLUMNS = ["barcode", "qr_code_barcode", "price_default", "price_card", "price1_qr", "price2_qr", "price4_qr", "product_name", "discount_amount", "additional_info", "color"]


FUSED_SQL = f"""WITH {PAYLOADS_SQL}, named AS (SELECT payloads.*, p_partkey AS k, p_brand, p_name FROM payloads JOIN (SELECT p_partkey, p_brand, p_name FROM part) USING (p_partkey)),
read AS (SELECT p_brand AS g, 'qr_code_barcode' AS f, code AS v, 3.0::DOUBLE + (k % 90) / 100.0::DOUBLE AS w, (1::BIGINT << 52) + k AS o FROM named
  UNION ALL SELECT p_brand, 'price1_qr', CASE WHEN k % 4 = 2 THEN p_retailprice::VARCHAR ELSE printf('%.2f', p_retailprice) END, 3.0::DOUBLE + (k % 90) / 100.0::DOUBLE, (1::BIGINT << 52) + k FROM named WHERE k % 4 < 3
  UNION ALL SELECT p_brand, 'price4_qr', printf('%.2f', p_retailprice * 0.8), 3.0::DOUBLE + (k % 90) / 100.0::DOUBLE, (1::BIGINT << 52) + k FROM named WHERE k % 4 = 0
  UNION ALL SELECT p_brand, 'product_name', p_name, 1.0::DOUBLE + (k % 7) / 10.0::DOUBLE + (k % 11) / 11.0::DOUBLE, (2::BIGINT << 52) + k FROM named
  UNION ALL SELECT p_brand, 'price_card', '99,50', 1.0::DOUBLE + 0.5::DOUBLE + (k % 11) / 11.0::DOUBLE, (2::BIGINT << 52) + k FROM named WHERE k % 2 = 0
  UNION ALL SELECT p_brand, 'color', 'red', 0.7::DOUBLE, (3::BIGINT << 52) + k FROM named WHERE k % 3 = 0),
sums AS (SELECT g, f, lower(v) AS n, sum(w::DECIMAL(24,6)) AS w, min(o) AS o, arg_min(v, o) AS v FROM read GROUP BY g, f, lower(v)),
won AS (SELECT g, f, arg_max(v, (w, -o)) AS v FROM sums GROUP BY g, f),
wide AS (SELECT g, max(v) FILTER (WHERE f = 'qr_code_barcode') AS code, max(v) FILTER (WHERE f = 'price1_qr') AS p1, max(v) FILTER (WHERE f = 'price4_qr') AS p4, max(v) FILTER (WHERE f = 'product_name') AS name,
  max(v) FILTER (WHERE f = 'price_card') AS card, max(v) FILTER (WHERE f = 'color') AS color FROM won GROUP BY g),
both_ways AS (SELECT *, coalesce(card, p4, '') AS price_card, coalesce(p4, card, '') AS price4_qr FROM wide),
amounts AS (SELECT *, p1::DECIMAL(18,4) AS d, nullif(replace(price_card, ',', '.'), '')::DECIMAL(18,4) AS c FROM both_ways)
SELECT g AS p_brand, code AS barcode, code AS qr_code_barcode, p1 AS price_default, price_card, p1 AS price1_qr, printf('%.2f', round_even(d::DOUBLE * 0.95, 0) - 0.01) AS price2_qr, price4_qr, name AS product_name,
  CASE WHEN d > c AND trunc((d - c)::DOUBLE / d::DOUBLE * 100.0) BETWEEN 1 AND 99 THEN '-' || trunc((d - c)::DOUBLE / d::DOUBLE * 100.0)::INT || '%' ELSE '' END AS discount_amount, 'нет' AS additional_info, coalesce(color, 'нет') AS color FROM amounts"""


@query(FUSED_SQL)
def fused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, text readings and colors of a brand's parts voted into one row."""
    p = payloads(spark, sf_dir)
    brand = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    s = p.join(brand, "p_partkey").select("p_brand", F.col("p_partkey").alias("symbol_id"), F.lit("qr").alias("symbol_type"), "payload", ((F.col("p_partkey") % 90) / 100.0).alias("confidence"))
    c = brand.select(
        "p_brand", F.col("p_partkey").alias("crop_id"), F.create_map(F.lit("product_name"), F.col("p_name"), F.lit("price_card"), F.when(F.col("p_partkey") % 2 == 0, F.lit("99,50")).otherwise(F.lit("нет"))).alias("fields"),
        F.create_map(F.lit("product_name"), (F.col("p_partkey") % 7) / 10.0).alias("field_confidences"), F.lit(0.5).alias("confidence"), ((F.col("p_partkey") % 11) / 11.0).alias("quality"),
    )
    d = brand.select("p_brand", F.col("p_partkey").alias("detection_id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("red")).otherwise(F.lit(" ")).alias("color"), F.lit(0.7).alias("confidence"))
    every = fuse.ordered([fuse.symbol_votes(s, "p_brand"), fuse.text_votes(c, "p_brand"), fuse.color_votes(d, "p_brand")])
    return fuse.fused(every, "p_brand", COLUMNS)


@query(
    f"""WITH {PAYLOADS_SQL}, long AS (SELECT p_partkey % 50 AS g, p_partkey AS o, unnest(list_concat([{{'f': 'qr_code_barcode', 'v': code}}], CASE p_partkey % 4 WHEN 0 THEN [{{'f': 'price1_qr', 'v': printf('%.2f', p_retailprice)}}, {{'f': 'price4_qr', 'v': printf('%.2f', p_retailprice * 0.8)}}]
  WHEN 1 THEN [{{'f': 'price1_qr', 'v': printf('%.2f', p_retailprice)}}, {{'f': 'action_price_qr', 'v': '1.5'}}] WHEN 2 THEN [{{'f': 'price1_qr', 'v': p_retailprice::VARCHAR}}] ELSE [] END)) AS x, 3 + (p_partkey % 90) / 100.0 AS w FROM payloads),
per AS (SELECT g, x.f AS f, x.v AS v, sum(w::DECIMAL(24,6)) AS w, min(o) AS o FROM long GROUP BY ALL)
SELECT g, f AS field, arg_max(v, (w, -o)) AS value, max(w)::DOUBLE AS weight FROM per GROUP BY g, f"""
)
def symbol_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of decoded payloads by field."""
    p = payloads(spark, sf_dir).select(
        (F.col("p_partkey") % 50).alias("g"), F.col("p_partkey").alias("symbol_id"), F.lit("qr").alias("symbol_type"), "payload", ((F.col("p_partkey") % 90) / 100.0).alias("confidence")
    )
    return votes.weighted_vote(fuse.symbol_votes(p, "g"), ["g"]).withColumn("weight", F.col("weight").cast("double"))


@query(
    """WITH RECURSIVE pairs AS (SELECT a.p_partkey AS t, b.p_partkey AS e, a.p_partkey % 3 = 0 AS coded, a.p_retailprice AS p, b.p_retailprice AS q, a.p_name AS n, b.p_name AS m FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_partkey % 2),
names AS (SELECT *, array_to_string(list_sort(string_split(n, ' ')), ' ') AS x, array_to_string(list_sort(string_split(m, ' ')), ' ') AS y FROM pairs),
walk AS (SELECT t, x, y, 0 AS i, (1::HUGEINT << length(x)) - 1 AS row FROM names
  UNION ALL SELECT t, x, y, i + 1, ((row + (row & hit)) | (row - (row & hit))) & ((1::HUGEINT << length(x)) - 1) FROM (
    SELECT *, list_sum([CASE WHEN x[j] = y[i + 1] THEN 1::HUGEINT << (j - 1)::INT ELSE 0::HUGEINT END for j in range(1, length(x) + 1)])::HUGEINT AS hit FROM walk WHERE i < length(y))),
common AS (SELECT t, length(x) - bit_count(row) AS c FROM walk WHERE i = length(y)),
ratios AS (SELECT names.*, 2 * c / (length(x) + length(y))::DOUBLE AS r FROM names JOIN common USING (t))
SELECT t, round(CASE WHEN NOT coded THEN 0 WHEN t = e THEN 500 ELSE -1000 END + CASE WHEN abs(p - q) <= 0.01 THEN 55 ELSE -27.5 END + CASE WHEN t % 5 = 0 THEN 12 ELSE 0 END
  + CASE WHEN t % 4 = 0 THEN 240 + 220 * 0.6 WHEN t % 4 = 1 THEN 70 + 150 * 0.2 ELSE 0 END + CASE WHEN r >= 0.6 THEN 50 * r ELSE 0 END, 4)::DOUBLE AS score FROM ratios"""
)
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings scored against the entry they belong to, or its neighbour."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    right = p.toDF("e", "e_product_name", "e_p")
    j = p.join(right, F.col("e") == F.col("p_partkey") + F.col("p_partkey") % 2)
    code = lambda k: F.when(F.col("p_partkey") % 3 == 0, (k + 270000000000).cast("string")).otherwise(F.lit(""))
    blank = [f for f in ("qr_code_barcode", "id_sku", "price_default", "price1_qr", "price2_qr", "price4_qr", "discount_amount", "color", "special_symbols")]
    money = lambda c: F.format_string("%.2f", F.col(c))
    j = j.select(
        F.col("p_partkey").alias("t"), F.col("p_name").alias("t_product_name"), "e_product_name", code(F.col("p_partkey")).alias("t_barcode"), code(F.col("e")).alias("e_barcode"), money("p_retailprice").alias("t_price_card"), money("e_p").alias("e_price_card"),
        *[F.lit("").alias(f"{s}_{f}") for s in "te" for f in blank],
        F.when(F.col("p_partkey") % 4 == 0, 0.6).when(F.col("p_partkey") % 4 == 1, 0.2).otherwise(0.0).alias("iou"), (F.col("p_partkey") % 5 == 0).alias("shelf"),
    )
    return j.select("t", F.round(score.pair_score(F.col("iou"), F.col("shelf"))["score"], 4).alias("score"))


#: Blocks of a tag for each part: place in the tag, text, height, own height, left edge and width, by the part's key k.
TAG_BLOCKS = """
  0 | CASE WHEN k % 11 = 0 THEN concat(120 + k % 9000, '0') ELSE concat('', 120 + k % 9000) END | 0.30 + (k % 5) * 0.02 | 0.06 | 0.42 | 0.14
  1 | CASE WHEN k % 3 = 0 THEN 'word' ELSE lpad(concat('', k % 100), 2, '0') END | 0.31 + (k % 7) * 0.03 | 0.03 | 0.40 + (k % 4) * 0.06 | 0.06
  2 | CASE WHEN k % 6 = 5 THEN '7' ELSE concat('', (120 + k % 9000) * (60 + k % 30) DIV 100) END | 0.60 + (k % 3) * 0.02 | 0.14 | 0.39 + (k % 4) * 0.02 | 0.16
  3 | CASE WHEN k % 2 = 0 THEN '99' ELSE concat('x ', lpad(concat('', k * 7 % 100), 2, '0')) END | 0.59 | 0.04 | CASE WHEN k % 5 = 0 THEN 0.30 ELSE 0.57 END | 0.07
  4 | CASE WHEN k % 4 = 1 THEN concat(599 + k % 300, ' 50 ', 400 + k % 100) ELSE '' END | 0.78 | 0.08 | 0.42 | 0.14
  5 | CASE k % 5 WHEN 0 THEN '275г' WHEN 1 THEN '0.75L' WHEN 2 THEN '1,5 л' WHEN 3 THEN '750 ML x' ELSE '330 kg' END | 0.20 | 0.05 | 0.45 | 0.15
  6 | CASE k % 5 WHEN 0 THEN '-31%' WHEN 1 THEN '4%' WHEN 2 THEN '− 7 %' WHEN 3 THEN '12 % off' ELSE 'word' END | 0.55 | 0.05 | 0.80 | 0.10
  7 | CASE k % 6 WHEN 0 THEN 'KO' WHEN 1 THEN 'ш' WHEN 2 THEN 'x1' WHEN 3 THEN 'Л' ELSE 'к' END | CASE WHEN k % 7 = 0 THEN 0.5 ELSE 0.84 END | 0.05 | 0.45 | 0.15
  8 | CASE k % 4 WHEN 0 THEN 'Вино п/ сух' WHEN 1 THEN 'CYXOE' WHEN 2 THEN 'Полуслад кое' ELSE 'Vino' END | 0.10 | 0.05 | 0.45 | 0.15
"""
TAG_ROWS = [[x.strip() for x in line.split(" | ")] for line in TAG_BLOCKS.strip().splitlines()]


def _blocks_sql() -> str:
    each = ", ".join(f"{{'ord': {o}, 'text': {t.replace(' DIV ', ' // ')}, 'y': ({y})::DOUBLE, 'h': {h}::DOUBLE, 'x': ({x})::DOUBLE, 'w': {w}::DOUBLE}}" for o, t, y, h, x, w in TAG_ROWS)
    return f"""blocks AS (SELECT p, b.*, b.x + b.w / 2.0 AS cx, (0.5 + (p + b.ord) % 5 / 10.0)::DOUBLE AS conf
  FROM (SELECT p_partkey AS p, unnest([{each}]) AS b FROM (SELECT p_partkey, p_partkey AS k FROM part)))"""


def _cents_sql(name: str, of: str, fallback: str, condition: str = "TRUE") -> str:
    """Two digits nearest to the price of a tag in `of` (p, y, x, w)."""
    right = "(f.x + f.w)"
    aside = f"(abs(t.x - {right}) + CASE WHEN t.x + 0.03::DOUBLE < {right} THEN 0.12::DOUBLE ELSE 0::DOUBLE END)"
    usual = "'99', '90', '49', '50', '00', '95', '98', '79', '59', '69', '89', '29', '19'"
    return f"""{name}_all AS (SELECT f.p, t.t, t.ord, t.i, abs(t.y - f.y) + least({aside}, 0.20::DOUBLE) AS cost FROM {of} f JOIN twos t ON t.p = f.p
  WHERE (t.t IN ({usual}) OR t.x + 0.02::DOUBLE >= f.x) AND {condition}),
{name} AS (SELECT f.p, coalesce((SELECT arg_min(t, (cost, ord, i)) FROM {name}_all a WHERE a.p = f.p HAVING min(cost) <= 0.24::DOUBLE), '{fallback}') AS cents FROM {of} f)"""


PRICE_BLOCKS_SQL = f"""WITH {_blocks_sql()},
nums AS (SELECT * FROM blocks WHERE regexp_matches(text, '[0-9]') AND NOT contains(text, '%') AND NOT regexp_matches(upper(text), '[0-9][\\s.,]*(ML|МЛ|L|Л)($|[^\\p{{L}}\\p{{N}}_])')
  AND NOT regexp_full_match(text, '\\s*[01][.,][0-9]{{1,2}}\\s*[lLлЛ]?\\s*') AND NOT regexp_matches(text, '(?i)[0-9]\\s*(kg|кг|g|г)($|[^\\p{{L}}\\p{{N}}_])')),
tokens AS (SELECT * EXCLUDE (ts), unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT *, regexp_extract_all(text, '[0-9]+') AS ts FROM nums)),
twos AS (SELECT * FROM tokens WHERE length(t) = 2),
read AS (SELECT *, t::INT AS v, 1.0::DOUBLE AS share, 0 AS cut FROM tokens WHERE length(t) BETWEEN 3 AND 5
  UNION ALL SELECT *, left(t, 4)::INT, 0.88::DOUBLE, 1 FROM tokens WHERE length(t) = 5 AND right(t, 1) = '0' AND y BETWEEN 0.12::DOUBLE AND 0.56::DOUBLE),
placed AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ord, i, cut) AS place FROM read WHERE v >= 100),
entries AS (SELECT *, min(place) OVER (PARTITION BY p, v) AS met FROM placed QUALIFY row_number() OVER (PARTITION BY p, v ORDER BY conf * share DESC, place) = 1),
pairs AS (SELECT d.p, d.v AS dv, d.y AS dy, d.x AS dx, d.w AS dw, c.v AS cv, c.y AS cy, c.x AS x, c.w AS w FROM entries d JOIN entries c ON c.p = d.p AND c.v < d.v
    AND c.v >= 0.30::DOUBLE * d.v AND c.v <= 0.985::DOUBLE * d.v AND c.y - d.y BETWEEN 0.08::DOUBLE AND 0.58::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY d.p ORDER BY 2.6::DOUBLE * abs(d.y - 0.30::DOUBLE) + 2.4::DOUBLE * abs(c.y - 0.62::DOUBLE) + 1.8::DOUBLE * abs(c.y - d.y - 0.30::DOUBLE)
    + 0.8::DOUBLE * abs(d.cx - c.cx) + 7.0::DOUBLE * greatest(c.y - 0.84::DOUBLE, 0) + 6.0::DOUBLE * greatest(d.y - 0.58::DOUBLE, 0), d.met, c.met) = 1),
alone AS (SELECT p, v, y, x, w FROM entries WHERE p NOT IN (SELECT p FROM pairs) QUALIFY row_number() OVER (PARTITION BY p ORDER BY h DESC, v DESC) = 1),
cards AS (SELECT p, cv AS v, cy AS y, x, w FROM pairs UNION ALL SELECT * FROM alone),
{_cents_sql("card_cents", "cards", "99")},
defaults AS (SELECT pairs.p, dv AS v, dy AS y, dx AS x, dw AS w, cents AS taken FROM pairs JOIN card_cents USING (p)),
{_cents_sql("default_cents", "defaults", "00", "t.t <> f.taken")},
prices AS (SELECT DISTINCT b.p, coalesce(d.v || '.' || dc.cents, '') AS price_default, coalesce(c.v || '.' || cc.cents, '') AS price_card
  FROM blocks b LEFT JOIN cards c ON c.p = b.p LEFT JOIN card_cents cc ON cc.p = b.p LEFT JOIN defaults d ON d.p = b.p LEFT JOIN default_cents dc ON dc.p = b.p),
texts AS (SELECT p, string_agg(text, ' ' ORDER BY ord) AS every, lower(regexp_replace(string_agg(text, ' ' ORDER BY ord), '\\s+', '', 'g')) AS dense FROM blocks GROUP BY p),
seen AS (SELECT *, CASE WHEN regexp_matches(every, '[-−]\\s*[0-9]{{1,2}}\\s*%') THEN replace(regexp_replace(regexp_extract(every, '[-−]\\s*[0-9]{{1,2}}\\s*%'), '\\s+', '', 'g'), '−', '-')
  WHEN regexp_matches(every, '(^|[^0-9])[0-9]{{1,2}}\\s*%') THEN '-' || regexp_extract(every, '(^|[^0-9])([0-9]{{1,2}})\\s*%', 2) || '%' ELSE '' END AS discount FROM texts),
shares AS (SELECT *, round_even((price_default::DOUBLE - price_card::DOUBLE) / price_default::DOUBLE * 100.0, 0)::INT AS share FROM seen JOIN (SELECT p, nullif(price_default, '') AS price_default, nullif(price_card, '') AS price_card FROM prices) USING (p)),
marks AS (SELECT p, CASE WHEN regexp_full_match(m, '[KК][O0О]?') THEN 'К' ELSE m END AS m FROM (SELECT p, y, upper(regexp_replace(text, '\\s+', '', 'g')) AS m, ord FROM blocks WHERE y > 0.70::DOUBLE)
  WHERE regexp_full_match(m, '[KК][O0О]?|Ш|Л') QUALIFY row_number() OVER (PARTITION BY p ORDER BY ord DESC) = 1)
SELECT p AS p_partkey, coalesce(price_default, '') AS price_default, coalesce(price_card, '') AS price_card,
  CASE WHEN length(regexp_replace(discount, '[^0-9]', '', 'g')) = 1 AND share BETWEEN 1 AND 99 AND abs(regexp_replace(discount, '[^0-9]', '', 'g')::INT - share) >= 10 THEN '-' || share || '%' ELSE discount END AS discount_amount,
  coalesce(m, '') AS special_symbols, CASE WHEN dense LIKE '%полуслад%' THEN 'Полусладкое' WHEN dense LIKE '%п/сух%' THEN 'Полусухое' WHEN dense LIKE '%cyx%' THEN 'Сухое' ELSE '' END AS additional_info
FROM shares LEFT JOIN marks USING (p)"""


@query(PRICE_BLOCKS_SQL)
def price_blocks_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, discount and marks of a tag for each part, from blocks of text in their places."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"))
    kinds = (("ord", "int"), ("text", "string"), ("rel_y", "double"), ("rel_h", "double"), ("rel_x", "double"), ("rel_w", "double"))
    block = lambda row: F.struct(*[F.expr(x).cast(kind).alias(name) for x, (name, kind) in zip(row, kinds)])
    b = p.select("p_partkey", F.inline(F.array(*map(block, TAG_ROWS))))
    b = b.withColumns({"rel_cx": F.col("rel_x") + F.col("rel_w") / 2.0, "conf": 0.5 + (F.col("p_partkey") + F.col("ord")) % 5 / 10.0})
    return price_blocks.parse(b, "p_partkey")


@query(
    f"""WITH {DETECTIONS_SQL}, s AS (SELECT *, CASE label WHEN 'purchase' THEN 60.0 WHEN 'view' THEN 40.0 WHEN 'click' THEN 8.0 ELSE 0.0 END::DOUBLE + 0.3::DOUBLE * length(label) + detection_id % 3 + quality + 0.0096::DOUBLE AS s FROM detections)
SELECT track_id, arg_max(detection_id, (s, quality, -detection_id)) AS detection_id, round(max(s), 4) AS score FROM s GROUP BY track_id"""
)
def recognised_best_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best read crop of each track."""
    d = detections(spark, sf_dir)
    s = fuse.recognition_score(F.col("label") == "purchase", F.col("label") == "view", F.col("label") == "click", F.col("label"), F.col("detection_id") % 3, F.col("quality"), F.lit(9600))
    return d.withColumn("s", s).groupBy("track_id").agg(F.max_by("detection_id", F.struct("s", "quality", -F.col("detection_id"))).alias("detection_id"), F.round(F.max("s"), 4).alias("score"))


@query(
    """WITH RECURSIVE made AS (SELECT p_partkey AS k, p_partkey // 20 AS f, repeat(chr(65 + (p_partkey % 8)::INT), 6 + (p_partkey % 5)::INT) AS name, CASE WHEN p_partkey % 3 = 0 THEN ((p_partkey // 20) * 1000 + 100 + (p_partkey * 3) % 7)::VARCHAR ELSE '' END AS code,
  CASE WHEN p_partkey % 2 = 0 THEN ((p_partkey // 20) * 1000 + 100 + p_partkey % 7)::VARCHAR ELSE '' END AS known, 10 + p_partkey % 7 AS price, 10 + p_partkey % 9 AS listed, (p_partkey * 13) % 900 AS x, (p_partkey * 29) % 900 AS ex FROM part),
met AS (SELECT a.k AS t, b.k AS e, a.f, greatest(0, 120 - abs(a.x - b.ex)) / (240 - greatest(0, 120 - abs(a.x - b.ex)))::DOUBLE AS iou, CASE WHEN left(a.name, 1) = left(b.name, 1) THEN 2 * least(length(a.name), length(b.name)) / (length(a.name) + length(b.name))::DOUBLE ELSE 0 END AS r,
  a.code <> '' AND a.code = b.known AS coded, a.price = b.listed AS priced FROM made a JOIN made b USING (f)),
scored AS (SELECT t, e, f, iou, 8 + CASE WHEN iou >= 0.18 THEN 35 + 80 * iou ELSE 0 END + CASE WHEN coded THEN 110 ELSE 0 END + CASE WHEN priced THEN 36 ELSE 0 END + CASE WHEN r >= 0.55 THEN 35 * r ELSE 0 END AS s FROM met),
turns AS (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY t) AS turn, wishes FROM (SELECT f, t, list({'e': e, 's': s, 'iou': iou} ORDER BY s DESC, e) AS wishes FROM scored GROUP BY f, t)),
walk AS (SELECT f, 0::BIGINT AS turn, []::BIGINT[] AS used, NULL::BIGINT AS t, NULL::BIGINT AS e, NULL::DOUBLE AS s, NULL::DOUBLE AS iou, NULL::DOUBLE AS margin FROM (SELECT DISTINCT f FROM turns)
  UNION ALL SELECT f, turn, CASE WHEN ok THEN list_append(used, b.e) ELSE used END, t, CASE WHEN ok THEN b.e END, b.s, b.iou, b.s - second FROM (
    SELECT *, CASE WHEN b IS NULL THEN FALSE WHEN b.iou >= 0.18 THEN b.iou >= 0.5 OR b.s - second >= 2 ELSE b.s >= 45 AND b.s - second >= 8 END AS ok FROM (
      SELECT f, turn, used, t, free[1] AS b, coalesce(free[2].s, 0) AS second FROM (SELECT turns.f, turns.turn, w.used, turns.t, list_filter(wishes, lambda x: NOT list_contains(w.used, x.e)) AS free FROM walk w JOIN turns ON turns.f = w.f AND turns.turn = w.turn + 1))))
SELECT t, e, round(s, 4)::DOUBLE AS score, round(margin, 4)::DOUBLE AS margin FROM walk WHERE e IS NOT NULL"""
)
def resolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that take entries of their file, one after the other, each entry once, if their score or overlap leads enough."""
    k = F.col("p_partkey")
    file = F.expr("p_partkey div 20")
    code = lambda when, n: F.when(when, (file * 1000 + 100 + n).cast("string")).otherwise(F.lit(""))
    name = F.repeat(F.char(65 + k % 8), (6 + k % 5).cast("int"))
    p = load(spark, sf_dir, "part")
    left = p.select(file.alias("f"), k.alias("t"), name.alias("t_product_name"), code(k % 3 == 0, k * 3 % 7).alias("t_barcode"), (10 + k % 7).cast("string").alias("t_price_card"), (k * 13 % 900).alias("x"))
    right = p.select(file.alias("f"), k.alias("e"), name.alias("e_product_name"), code(k % 2 == 0, k % 7).alias("e_barcode"), (10 + k % 9).cast("string").alias("e_price_card"), (k * 29 % 900).alias("ex"))
    shared = F.greatest(F.lit(0), 120 - F.abs(F.col("x") - F.col("ex")))
    blank = ("qr_code_barcode", "id_sku", "price_default", "price1_qr", "price2_qr", "price4_qr", "discount_amount", "color", "special_symbols")
    j = left.join(right, "f").withColumns({**{f"{s}_{f}": F.lit("") for s in "te" for f in blank}, "iou": shared / (240 - shared), "same_file": F.lit(True)})
    scored = j.select("t", "e", "same_file", "iou", F.inline(F.array(score.row_score(F.col("same_file"), F.col("iou"))))).drop("reasons")
    return score.resolved(scored, "t", "e").select("t", "e", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))
