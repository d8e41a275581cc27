"""Explicit schemas of the base tables and vendor files. Nothing is inferred."""

from __future__ import annotations

OHLC = "open double, high double, low double, close double"

TABLES: dict[str, tuple[str, list[str]]] = {
    # name -> (columns, primary key)
    "daily_prices": (f"ticker string, date date, {OHLC}, volume bigint, transactions bigint", ["ticker", "date"]),
    "splits": ("ticker string, execution_date date, split_from double, split_to double, split_ratio double",
               ["ticker", "execution_date"]),
    "dividends": ("ticker string, ex_dividend_date date, cash_amount double, declaration_date date, pay_date date, "
                  "frequency int, dividend_type string", ["ticker", "ex_dividend_date"]),
    "ticker_reference": ("ticker string, name string, type string", ["ticker", "type"]),
    "ticker_events": ("query_ticker string, figi string, name string, cik string, event_date date, event_type string, "
                      "event_ticker string", []),
    "intraday_prices": (f"ticker string, timestamp timestamp, {OHLC}, volume double, vwap double, transactions int",
                        ["ticker", "timestamp"]),
    "minute_aggs": (f"ticker string, window_start bigint, {OHLC}, volume bigint, transactions bigint",
                    ["ticker", "window_start"]),
    "trades": ("ticker string, participant_timestamp bigint, sip_timestamp bigint, sequence_number bigint, price double, "
               "size double, exchange int, trf_id bigint, conditions array<int>",
               ["ticker", "participant_timestamp", "sequence_number"]),
    "float_sec": ("cik bigint, concept string, period_end date, known_date date, value double", ["cik", "concept", "period_end"]),
}

DAILY_CSV = "ticker string, volume bigint, open double, close double, high double, low double, window_start bigint, transactions bigint"
SPLITS_CSV = "ticker string, execution_date string, split_from double, split_to double"
DIVIDENDS_CSV = ("ticker string, ex_dividend_date string, cash_amount double, declaration_date string, pay_date string, "
                 "frequency int, dividend_type string")
TICKERS_CSV = "ticker string, name string, type string"
TRADES_CSV = ("ticker string, conditions string, exchange int, participant_timestamp bigint, price double, "
              "sequence_number bigint, sip_timestamp bigint, size double, trf_id bigint")
INTRADAY_JSON = ("ticker string, results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:int>>")
TICKER_EVENTS_JSON = ("results struct<composite_figi:string,name:string,cik:string,"
                      "events:array<struct<date:string,type:string,ticker_change:struct<ticker:string>>>>")
QUOTES_JSON = ("ticker string, results array<struct<sip_timestamp:bigint,participant_timestamp:bigint,sequence_number:bigint,"
               "bid_price:double,bid_size:double,bid_exchange:int,ask_price:double,ask_size:double,ask_exchange:int,"
               "conditions:array<int>,indicators:array<int>,tape:int>>")
NEWS_JSON = ("results array<struct<id:string,title:string,author:string,published_utc:string,article_url:string,"
             "description:string,tickers:array<string>,publisher:struct<name:string,homepage_url:string>,"
             "insights:array<struct<ticker:string,sentiment:string,sentiment_reasoning:string>>>>")


def columns(table: str) -> str:
    return TABLES[table][0]


def primary_key(table: str) -> list[str]:
    return TABLES[table][1]
