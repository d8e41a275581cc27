"""Shared CTEs of the SQL counterparts (DuckDB dialect), mirroring ``barspark.plans.market``."""

from __future__ import annotations

EP = "PARTITION BY ticker, episode ORDER BY date"
SE = "PARTITION BY ticker, session ORDER BY minute"


def r4(e: str) -> str:
    return f"floor(({e})*1e4+0.5)/1e4"


_P = "(20.0::DOUBLE + l_extendedprice / l_quantity / 1000.0::DOUBLE)"
_HI, _LO = "(1.0::DOUBLE + l_tax / 2.0::DOUBLE)", "(1.0::DOUBLE - l_discount / 2.0::DOUBLE)"

CTES: dict[str, str] = {
    "daily": f"""
SELECT ticker, date, arg_min(o, k) AS open, max(h) AS high, min(l) AS low, arg_max(c, k) AS close,
       CAST(sum(q) AS BIGINT) AS volume, count(*) AS transactions
FROM (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
        (l_orderkey * 8 + l_linenumber) * 2097152 + l_partkey % 2097152 AS k,
        {r4(f"CASE WHEN l_linestatus = 'F' THEN {_P}*{_LO} ELSE {_P}*{_HI} END")} AS o,
        {r4(f"CASE WHEN l_linestatus = 'F' THEN {_P}*{_HI} ELSE {_P}*{_LO} END")} AS c,
        {r4(f"{_P}*(1.0::DOUBLE + l_tax)")} AS h, {r4(f"{_P}*(1.0::DOUBLE - l_discount)")} AS l
      FROM lineitem) GROUP BY ticker, date""",
    "tape": """
SELECT user_id AS ticker, epoch_us(ts) AS ts, event_id AS seq, value AS price,
       CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size,
       CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign,
       CASE event_type WHEN 'click' THEN [12] WHEN 'error' THEN [32] WHEN 'purchase' THEN [8, 32]
            WHEN 'signup' THEN [17] END AS conditions,
       CASE WHEN event_id % 7 = 0 THEN 201 ELSE 0 END AS trf_id, epoch_us(ts) AS participant_ts,
       CASE WHEN event_id % 50 = 0 THEN 0 ELSE epoch_us(ts) + (event_id % 100) * 1000 END AS sip_ts,
       CAST(ts AS DATE) AS date
FROM events""",
    "eps": """
SELECT *, sum(isnew) OVER (PARTITION BY ticker ORDER BY date) AS episode FROM (
  SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY ticker ORDER BY date) > 45 THEN 1 ELSE 0 END AS isnew
  FROM daily)""",
    "sess": "SELECT *, CAST(year(date) AS BIGINT) AS session, CAST(569 + dayofyear(date) AS BIGINT) AS minute FROM daily",
    "acts": """
SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS pr, max(o_orderkey) AS key,
       arg_max(o_totalprice, o_orderkey) AS amount
FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2, 3""",
    "spl": """
SELECT ticker, date AS execution_date,
       CASE WHEN key % 4 = 0 THEN 1.0::DOUBLE / 3.0::DOUBLE ELSE CAST(key % 3 * 2 + 3 AS DOUBLE) END AS split_ratio
FROM acts WHERE pr = '1-URGENT'""",
    "divs": "SELECT ticker, date AS ex_dividend_date, amount / 1e6 AS cash_amount FROM acts WHERE pr = '2-HIGH'",
    "flo": """
SELECT ticker, CAST(date + INTERVAL 40 DAY AS DATE) AS known_date, date AS period_end, amount * 1000.0::DOUBLE AS value
FROM acts WHERE pr = '3-MEDIUM'""",
    "shr": "SELECT ticker, date AS as_of, CAST(key + 1000 AS DOUBLE) AS shares FROM acts WHERE pr = '5-LOW'",
    "refs": """
SELECT s_suppkey AS ticker, s_name AS name, unnest(CASE n_regionkey WHEN 0 THEN ['CS'] WHEN 1 THEN ['CS', 'ADRC']
       WHEN 2 THEN ['ADRC'] WHEN 3 THEN ['ETF'] ELSE ['WARRANT'] END) AS type
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "feat": f"""
SELECT *, max(atr_now) OVER ({EP} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) AS max_atr,
  volume / nullif(avg_vol, 0) AS rvol, CASE WHEN prev_close > 0 THEN close / prev_close - 1 END AS pct_up,
  close / open - 1 AS intraday_ret, (ln(rng_hi) - ln(rng_lo)) / nullif(atr_log, 0) AS tight_log,
  (rng_hi - rng_lo) / nullif(atr_lin, 0) AS tight_lin, close / hi_close - 1 AS d52_close, close / hi_high - 1 AS d52_high,
  close / lo_close - 1 AS d52_low_close, close / lo_low - 1 AS d52_low
FROM (SELECT *, avg(tr_log) OVER x14 AS atr_log, avg(tr_lin) OVER x14 AS atr_lin, avg(tr_log) OVER i14 AS atr_now,
    max(high) OVER x14 AS rng_hi, min(low) OVER x14 AS rng_lo, max(close) OVER x252 AS hi_close, max(high) OVER x252 AS hi_high,
    min(close) OVER x252 AS lo_close, min(low) OVER x252 AS lo_low, min(low) OVER x15 AS stop_low,
    max(high) OVER x15 AS stop_high, row_number() OVER ep AS bars_seen, avg(volume) OVER x20 AS avg_vol,
    avg(close * volume) OVER x20 AS avg_dol
  FROM (SELECT *, greatest(high, prev_close) - least(low, prev_close) AS tr_lin_all,
      CASE WHEN prev_close IS NOT NULL THEN greatest(high, prev_close) - least(low, prev_close) END AS tr_lin,
      CASE WHEN prev_close IS NOT NULL THEN ln(greatest(high, prev_close) / least(low, prev_close)) END AS tr_log
    FROM (SELECT *, lag(close) OVER ({EP}) AS prev_close FROM eps))
  WINDOW ep AS ({EP}), x14 AS ({EP} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
    i14 AS ({EP} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), x252 AS ({EP} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING),
    x15 AS ({EP} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), x20 AS ({EP} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    "trips": f"""
SELECT ticker * 100000 + (date - DATE '1970-01-01') AS trip_id, ticker, date AS entry_date, close AS entry_price, exit_date,
  exit_price, exit_reason, open_trip, rvol, pct_up, atr_log, tight_log, max_atr, d52_close, intraday_ret, avg_dol,
  exit_price / close - 1 AS ret, 10000.0::DOUBLE / close AS qty, 10000.0::DOUBLE / close * (exit_price - close) AS net_pnl
FROM (SELECT *, coalesce(lead(open, 6) OVER ({EP}), last_value(close) OVER e) AS exit_price,
    coalesce(lead(date, 6) OVER ({EP}), last_value(date) OVER e) AS exit_date,
    CASE WHEN lead(open, 6) OVER ({EP}) IS NULL THEN 'mtm' ELSE 'time_stop' END AS exit_reason,
    CASE WHEN lead(open, 6) OVER ({EP}) IS NULL THEN 1 ELSE 0 END AS open_trip
  FROM feat WINDOW e AS ({EP} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE pct_up >= 0.05 AND pct_up < 3 AND rvol >= 0.8 AND bars_seen > 21 AND avg_dol >= 100 AND close >= 0.1 * hi_close
  AND close >= 1 AND tight_log < 50 AND atr_log < 5 AND intraday_ret >= -0.2 AND max_atr >= 0.01""",
    "sfeat": f"""
SELECT *, lag(ema) OVER s AS ema_p, lag(vwap) OVER s AS vwap_p, (rng_hi - rng_lo) / nullif(atr_lin, 0) AS tight,
  (rng_hi_p - rng_lo_p) / nullif(atr_lin_p, 0) AS tight_p, volume / nullif(vol_hi_p, 0) AS vol_vs_hi
FROM (SELECT *, row_number() OVER s - 1 AS idx,
    list_reduce(list(CAST(close AS DOUBLE)) OVER f, lambda e, x: e + 0.2::DOUBLE * (x - e)) AS ema,
    list_reduce(list(CAST(volume AS DOUBLE)) OVER f, lambda e, x: e + 0.2::DOUBLE * (x - e)) AS vol_ema,
    sum((high + low + close) / 3 * volume) OVER f / sum(volume) OVER f AS vwap,
    avg(tr_log) OVER i20 AS atr_log, avg(tr_lin) OVER i20 AS atr_lin, avg(tr_log) OVER x20 AS atr_log_p,
    avg(tr_lin) OVER x20 AS atr_lin_p, max(high) OVER i20 AS rng_hi, min(low) OVER i20 AS rng_lo,
    max(high) OVER x20 AS rng_hi_p, min(low) OVER x20 AS rng_lo_p, max(high) OVER fp AS sess_hi_p,
    min(low) OVER fp AS sess_lo_p, max(close) OVER fp AS sess_hic_p, min(close) OVER fp AS sess_loc_p,
    min(low) OVER f AS sess_lo, max(volume) OVER fp AS vol_hi_p, sum(volume) OVER f AS cum_vol,
    lag(high) OVER s AS prev_high, lag(low) OVER s AS prev_low, first_value(open) OVER f AS sess_open,
    close / lag(close, 20) OVER s - 1 AS chg20
  FROM (SELECT *, CASE WHEN prev_close IS NOT NULL THEN greatest(high, prev_close) - least(low, prev_close) END AS tr_lin,
      CASE WHEN prev_close IS NOT NULL THEN ln(greatest(high, prev_close) / least(low, prev_close)) END AS tr_log
    FROM (SELECT *, lag(close) OVER ({SE}) AS prev_close FROM sess))
  WINDOW s AS ({SE}), f AS ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    fp AS ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    i20 AS ({SE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), x20 AS ({SE} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
WINDOW s AS ({SE})""",
    "sctx": """
SELECT ticker, session, lag(c) OVER w AS close_1d, lag(c, 3) OVER w AS close_3d, lag(v) OVER w AS permin FROM (
  SELECT ticker, session, arg_max(close, minute) AS c, sum(volume) / count(*) AS v FROM sess GROUP BY 1, 2)
WINDOW w AS (PARTITION BY ticker ORDER BY session)""",
    "tfeat": f"""
SELECT *, idx - max(CASE WHEN new_hi THEN idx END) OVER f AS bars_since_hi, idx - max(CASE WHEN new_lo THEN idx END) OVER f AS bars_since_lo,
  sum(above) OVER ({SE} ROWS 5 PRECEDING) AS above6, (vol_ema - vol_ema_min) / vol_ema AS vol_climb
FROM (SELECT *, ema_hi_p IS NULL OR ema > ema_hi_p AS new_hi, ema_lo_p IS NULL OR ema < ema_lo_p AS new_lo,
    ema_hi20_p IS NULL OR ema > ema_hi20_p AS new_hi20, ema_hi60_p IS NULL OR ema > ema_hi60_p AS new_hi60
  FROM (SELECT s.*, close_1d, close_3d, permin, max(ema) OVER fp AS ema_hi_p, min(ema) OVER fp AS ema_lo_p, max(ema) OVER f AS ema_hi,
      min(ema) OVER f AS ema_lo, min(ema) OVER i20 AS ema_low20, min(ema) OVER x20 AS ema_low20_p, max(ema) OVER x20 AS ema_hi20_p,
      max(ema) OVER ({SE.replace("ticker, session", "s.ticker, s.session")} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS ema_hi60_p,
      regr_slope(ln(close), idx) OVER x20 AS slope_p, regr_slope(ln(volume), idx) OVER i20 AS vol_slope,
      min(vol_ema) OVER i20 AS vol_ema_min,
      avg(volume) OVER ({SE.replace("ticker, session", "s.ticker, s.session")} ROWS 4 PRECEDING) AS vol5, sum(volume) OVER i20 AS vol20,
      CASE WHEN ema_p IS NOT NULL AND close >= ema_p THEN 1 ELSE 0 END AS above
    FROM sfeat s JOIN sctx c ON c.ticker = s.ticker AND c.session = s.session
    WINDOW f AS (PARTITION BY s.ticker, s.session ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      fp AS (PARTITION BY s.ticker, s.session ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      i20 AS (PARTITION BY s.ticker, s.session ORDER BY minute ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
      x20 AS (PARTITION BY s.ticker, s.session ORDER BY minute ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))
WINDOW f AS ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "runs": f"""
SELECT *, coalesce(lag(run_len) OVER ({SE}), 0) AS run_len_p, min(CASE WHEN bl THEN ema_p END) OVER (PARTITION BY ticker, session, isl ORDER BY minute) AS run_low
FROM (SELECT *, sum(CASE WHEN bl THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, session, isl ORDER BY minute) AS run_len
  FROM (SELECT *, sum(CASE WHEN bl IS DISTINCT FROM pbl AND idx > 0 THEN 1 ELSE 0 END) OVER ({SE}) AS isl
    FROM (SELECT *, lag(bl) OVER ({SE}) AS pbl FROM (SELECT *, coalesce(ema_p < vwap_p, false) AS bl FROM sfeat))))""",
    "eruns": f"""
SELECT *, coalesce(lag(bn) OVER ({SE}), 0) AS below_n_p, coalesce(lag(an) OVER ({SE}), 0) AS above_n_p,
  lag(saved) OVER ({SE}) AS saved_run_p, coalesce(lag(since) OVER ({SE}), -1) AS since_break_p
FROM (SELECT *, last_value(ended IGNORE NULLS) OVER ({SE}) AS saved, coalesce(idx - max(CASE WHEN be THEN idx END) OVER ({SE}), -1) AS since
  FROM (SELECT *, CASE WHEN be AND lag(an) OVER ({SE}) > 0 THEN lag(an) OVER ({SE}) END AS ended
    FROM (SELECT *, CASE WHEN be THEN count(*) OVER (PARTITION BY ticker, session, isl ORDER BY minute) ELSE 0 END AS bn,
        CASE WHEN ae THEN count(*) OVER (PARTITION BY ticker, session, isl ORDER BY minute) ELSE 0 END AS an
      FROM (SELECT *, sum(CASE WHEN st IS DISTINCT FROM pst AND idx > 0 THEN 1 ELSE 0 END) OVER ({SE}) AS isl
        FROM (SELECT *, lag(st) OVER ({SE}) AS pst FROM (SELECT *, coalesce(close < ema_p, false) AS be,
          coalesce(close >= ema_p, false) AS ae, CASE WHEN ema_p IS NULL THEN 0 WHEN close < ema_p THEN 1 ELSE 2 END AS st FROM sfeat))))))""",
}
