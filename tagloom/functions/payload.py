"""Decoded payloads as maps of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import output_value, text_of

# Field names by the keys that payloads use.
FIELD_OF_KEY = {
    "barcode": "qr_code_barcode",
    "b": "qr_code_barcode",
    "p1": "price1_qr",
    "price1": "price1_qr",
    "p2": "price2_qr",
    "price2": "price2_qr",
    "p3": "price3_qr",
    "price3": "price3_qr",
    "p4": "price4_qr",
    "price4": "price4_qr",
    "wl1c": "wholesale_level_1_count",
    "wl1p": "wholesale_level_1_price",
    "wl2c": "wholesale_level_2_count",
    "wl2p": "wholesale_level_2_price",
    "ap": "action_price_qr",
    "ac": "action_code_qr",
}


def _json_pairs(text: Column) -> Column:
    """Entries of a JSON object. Values that are objects or lists keep their JSON text."""
    return F.when(text.startswith("{") & text.endswith("}"), F.map_entries(F.from_json(text, "map<string,string>")))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _query_pairs(text: Column) -> Column:
    """Decoded entries of what follows the first question mark; blank values don't count."""
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(parts, lambda p: _entry(plain(F.substring_index(p, "=", 1)), plain(F.regexp_replace(p, "^[^=]*=", ""))))


def _list_pairs(text: Column) -> Column:
    """Entries of chunks between `;`, `&` and line ends, cut at the first `=` or `:`."""
    chunks = F.filter(F.split(text, r"[;&\n\r]+"), lambda c: c.rlike("[=:]"))
    return F.transform(chunks, lambda c: _entry(F.trim(F.regexp_replace(c, r"(?s)[=:].*$", "")), F.trim(F.regexp_replace(c, r"(?s)^[^=:]*[=:]", ""))))


def parse(payload: Column) -> Column:
    """map<field, value> of the first form that gives entries: JSON object, URL query, list. Later entries win."""
    text = F.trim(text_of(payload))
    some = lambda a: F.when(F.size(a) > 0, a)
    pairs = F.coalesce(some(_json_pairs(text)), some(_query_pairs(text)), some(_list_pairs(text)), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.create_map(*[F.lit(x) for kv in FIELD_OF_KEY.items() for x in kv])
    field = lambda e: names[F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]+", "")]
    value = lambda e: output_value(F.replace(F.coalesce(e["value"], F.lit("None")), F.lit(","), F.lit(".")))
    named = F.filter(F.transform(pairs, lambda e: _entry(field(e), value(e))), lambda e: e["key"].isNotNull())
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def encode(fields: Column) -> Column:
    """`k=v` entries by key, with `;` between them."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def non_empty(fields: Column) -> Column:
    from .text import has_value

    return F.map_filter(fields, lambda k, v: has_value(v))


def merged(left: Column, right: Column) -> Column:
    """Both maps; right wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)
