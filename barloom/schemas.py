"""Schemas of the tables, so that none is inferred."""

from __future__ import annotations

BARS = "code string, ktype int, ts timestamp, open double, high double, low double, close double, volume double, amount double"
INDEX_BARS = f"{BARS}, up_count int, down_count int"
QUOTES = (
    "code string, name string, open double, high double, low double, price double, last_close double, volume double, amount double, s_vol long, b_vol long, "
    "bid_ask array<struct<bid_price:double,ask_price:double,bid_volume:long,ask_volume:long>>"
)
MINUTES = "code string, date date, seq int, price double, number long"
TICKS = "code string, ts timestamp, seq long, price double, volume long, status int"
AUCTIONS = "code string, time string, price double, match long, unmatched long"
CORP_ACTIONS = (
    "code string, date date, category int, fen_hong double, pei_gu_jia double, song_zhuan_gu double, pei_gu double, suo_gu double, xing_quan_jia double, "
    "fen_shu double, pan_qian_liu_tong double, pan_hou_liu_tong double, qian_zong_gu_ben double, hou_zong_gu_ben double"
)
SECURITIES = "exchange string, code string, name string"
BLOCK_MEMBERS = "file string, block_name string, block_type int, stock_code string, seq long"
COMPANY_TOC = "code string, name string, filename string, start long, length long"
CACHE = "bucket string, key string, value string, created_at long, expires_at long"
HISTORY = "code string, analyzed_at timestamp"
CALENDAR = "date date"
SECTIONS = "seq int, type string, content array<array<string>>, text string"
