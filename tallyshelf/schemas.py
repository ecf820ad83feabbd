"""Schemas of landed payloads and of the tables this library writes, as DDL text."""

from __future__ import annotations

SHOP_FEED = """
    _roaster STRUCT<name: STRING, country: STRING, url: STRING, currency: STRING>,
    products ARRAY<STRUCT<
        handle: STRING, title: STRING, product_type: STRING, tags: VARIANT, body_html: STRING,
        images: ARRAY<STRUCT<src: STRING>>,
        variants: ARRAY<STRUCT<title: STRING, price: STRING, grams: INT, available: BOOLEAN>>>>
"""

STORE_FEED = """
    ARRAY<STRUCT<
        id: BIGINT, name: STRING, permalink: STRING, short_description: STRING, description: STRING,
        is_in_stock: BOOLEAN, images: ARRAY<STRUCT<src: STRING>>,
        prices: STRUCT<price: STRING, currency_code: STRING, currency_minor_unit: INT>>>
"""

PRODUCT_FIELDS = {
    "key": "STRING", "shop": "STRING", "country": "STRING", "title": "STRING", "url": "STRING", "image": "STRING",
    "price": "DOUBLE", "currency": "STRING", "grams": "INT", "per100": "DOUBLE", "available": "BOOLEAN",
    "origin": "STRING", "process": "STRING", "tags": "STRING", "notes": "STRING", "city": "STRING",
    "province": "STRING",
}
STATE_FIELDS = {
    **PRODUCT_FIELDS,
    "first_seen": "TIMESTAMP", "last_seen": "TIMESTAMP", "last_status_change": "TIMESTAMP",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


PRODUCT_STATE = ddl(STATE_FIELDS)
EVENT = "key STRING, type STRING, ts TIMESTAMP, oos_hours DOUBLE"
