"""Goldens of texts read from tags, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import codes, reading as R


def values(spark, of, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r.v for r in df.select("i", of(F.col("c")).alias("v")).orderBy("i").collect()]


def test_prices(spark):
    texts = ["1199 99", "было 2 345,99 стало 1 999.50", "1199", "abc", "99 1199", "1199 и 123 и 49 и 90", "12", "0012 x 34567", "7", "1,5", "345\n99 %", "карта 1234567", None]
    # Digits parted by one space are a price already: the greatest one wins.
    assert values(spark, R.best_price, texts) == ["1199.99", "999.50", "1199.00", "", "1199.99", "1199.90", "12.00", "34567.00", "", "", "345.99", "", ""]
    assert values(spark, R.prices_in, ["5,10 и 12345 67 и 123456,78"]) == [["5.10", "12345.67"]]


def test_discounts(spark):
    assert values(spark, R.best_discount, ["- 31 %", "−5%", "цена 38 %", "138%", "нет", None]) == ["-31%", "-5%", "-38%", "", "", ""]
    df = spark.createDataFrame([("-4%", "-24%"), ("-4%", "-9%"), ("-24%", "-51%"), ("", "-24%"), ("-4%", "")], "a string, b string")
    assert [r.v for r in df.select(R.reconciled_discount(F.col("a"), F.col("b")).alias("v")).collect()] == ["-24%", "-4%", "-24%", "", "-4%"]


def test_lines_names_info_and_symbols(spark):
    text = " .Вино красное |\r\n Шато  Марго \n12345 67\nабв\nЦена за штуку\nполусухое, 0.75\nЕщё строка\nПятая"
    assert values(spark, R.clean_lines, ["a\n\n : \n b;"]) == [["a", "b"]]
    assert values(spark, R.product_name, [text, "1234 ab\nx", None]) == ["Вино красное Шато Марго Ещё строка", "", ""]
    assert values(spark, R.additional_info, [text, "Брют!"]) == ["полусухое, 0.75", "Брют!"]
    assert values(spark, R.special_symbol, ["x k y", "ш.", "КШ", "Л", ""]) == ["К", "Ш", "", "Л", ""]
    assert values(spark, R.normalized, ["a\0b  c\n\n d РЅРµС‚"]) == ["a b c\nd нет"]


def test_whole_texts(spark):
    text = "Вино Шато\nцена 1 999,50 1 499.90\n-25%\n17.02.2026 1:14\n4006381333931\n270102701074\nсухое\nК"
    got = values(spark, R.parse_fields, [text, "", "  "])
    assert got[1] == got[2] == {}
    # The day and month read as a price, and digits of several lines run together, so no stock number stands alone.
    assert got[0] == {"price_default": "999.50", "price_card": "17.02", "discount_amount": "-25%", "print_datetime": "17.02.2026 1:14", "barcode": "4006381333931", "product_name": "Вино Шато -25%", "additional_info": "сухое", "special_symbols": "К"}
    assert values(spark, R.parse_fields, ["всего 12,50 за штуку"])[0]["price_card"] == "12.50"


def test_zones(spark):
    zones = [
        {"product_name": "Вино Шато\nкрасное", "price_default": "1999 99", "price_card": "1499 99", "discount": "25%", "barcode": "4006381333931", "sku_date": "17.02.2026 x 270102701074", "special": "K"},
        {"price_default": "1499.99", "price_card": "1499 99"},
        {"price_card": "0.75", "sku_date": "149999 149999"},
        {"price_card": "1499 99", "sku_date": "149999888888"},
    ]
    got = values(spark, R.parse_zones, zones, "map<string,string>")
    assert got[0] == {"product_name": "Вино Шато красное", "price_card": "1499.99", "price_default": "1999.99", "discount_amount": "-25%", "barcode": "4006381333931", "id_sku": "270102701074", "print_datetime": "17.02.2026", "special_symbols": "К"}
    assert got[1] == {"price_card": "1499.99"} and got[2] == {"id_sku": "149999149999"} and got[3] == {"price_card": "1499.99"}


def test_fine_print(spark):
    kind = "array<string>"
    assert values(spark, R.date_candidates, [["a 17.02.2026 1:14 ", "03,04,2026", "1.2.26 5.30"]], kind) == [["17.02.2026 1:14", "03.04.2026", "1.2.26 5:30"]]
    assert values(spark, R.zone_codes, [["01_026015 - 026016", "x 13_043015 y", "12_АБв ЧБК 5_1"]], kind) == [["01_026015 - 026016", "13_043015", "12_АБв", "ЧБК 5_1"]]
    assert values(spark, R.block_sweetness, [["Вино", "п / сух"], ["N/CYX"], ["CYXOE"], ["брЮт"], ["x"], ["сладкое"]], kind) == ["Полусухое", "Полусухое", "Сухое", "Брют", "", "Сладкое"]
    df = spark.createDataFrame([("K0", 0.9), ("k", 0.71), ("Ш", 0.8), ("К", 0.7), ("КШ", 0.9)], "t string, y double")
    assert [r.v for r in df.select(R.block_symbol(F.col("t"), F.col("y")).alias("v")).collect()] == ["К", "К", "Ш", "", ""]


def test_every_look_alike(spark):
    signs = sorted(codes.LOOK_ALIKES)
    assert len(signs) == 16
    assert values(spark, codes.sku_candidates, [f"27{x}102701074" for x in signs]) == [[f"27{codes.LOOK_ALIKES[x]}102701074"] for x in signs]


def test_digit_runs_stand_alone(spark):
    assert values(spark, codes.digit_runs, ["a270102701074", "x 2701 0270-1074 y", "17.02.2026 01_026015 - 026016", "Б7"]) == [["270102701074"], ["270102701074"], [], []]
    assert values(spark, codes.first_valid_ean13, ["4 006381\t333931", "14006381333931", "4006381333932"]) == ["4006381333931", "", ""]


def test_symbols_and_codes(spark):
    payloads = ["barcode=4006381333931;p1=5", "4006381333931", "p1=5", "barcode=4006381333932", "0 4006381333931"]
    assert values(spark, R.barcode_values, payloads) == [["4006381333931"], ["4006381333931"], [], [], ["4006381333931"]]
    df = spark.createDataFrame([("qr", p) for p in payloads] + [("barcode", payloads[2])], "t string, p string")
    assert [r.v for r in df.select(R.code_evidence(F.col("t"), F.col("p")).alias("v")).collect()] == [True, True, True, False, False, False]
    assert values(spark, R.catalog_code, ["04006381333931", "14006381333931", "400638133393"]) == ["4006381333931", "", ""]
    df = spark.createDataFrame([(["x", "4006381333931"], "z"), ([], "04006381333931"), ([], "12a")], "v array<string>, f string")
    assert [r.h for r in df.select(R.best_hint(F.col("v"), F.col("f")).alias("h")).collect()] == ["4006381333931", "4006381333931", "12a"]
    assert values(spark, R.first_valid_barcode, [{"barcode": "1", "qr_code_barcode": "4006381333931"}, {}], "map<string,string>") == ["4006381333931", ""]
    assert values(spark, R.decoded_payload, [b" a\0b \xff\n", None], "binary") == ["ab", ""]
    df = spark.createDataFrame([("Вино 12,50", 0.5), ("", 0.9)], "t string, c double")
    assert [round(r.s, 6) for r in df.select(R.text_score(F.col("t"), F.col("c")).alias("s")).collect()] == [round(0.5 + 4 / 20 + 0.4 + 0.2 + 10 / 120, 6), 0.0]
