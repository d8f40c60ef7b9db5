"""SQL of the queries, in pieces that queries share."""

from __future__ import annotations

W = "PARTITION BY ticker ORDER BY date"


def frame(a: int | None, b: int | None) -> str:
    edge = lambda x: "UNBOUNDED PRECEDING" if x is None else "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"({W} ROWS BETWEEN {edge(a)} AND {edge(b)})"


def roll(fn: str, x: str, a: int | None, b: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(a, b)} >= {least} THEN {fn}({x}) OVER {frame(a, b)} END"


def ema(x: str, alpha: str) -> str:
    return f"list_reduce(list({x}) OVER {frame(None, 0)}, lambda a, v: {alpha} * v + (1 - {alpha}) * a)"


def bars(ticker: str = "l_returnflag", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT CAST({ticker} AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, k) AS open, max(px) AS high,
    min(px) AS low, arg_max(px, k) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_quantity) AS k FROM lineitem) GROUP BY 1, 2)"""


RETURNS = f"""r AS (SELECT *, row_number() OVER w AS rn, ln(close) - ln(lag(close) OVER w) AS ret, close / lag(close) OVER w - 1 AS sret
    FROM bars WINDOW w AS ({W}))"""
BASE = f"WITH {bars()}, {RETURNS}"


def rv(k: int) -> str:
    return f"sqrt(({roll('sum', 'ret * ret', 1 - k, 0, k)}) / {k})"


def label(k: int) -> str:
    return f"sqrt(({roll('sum', 'ret * ret', 1, k, k)}) / {k})"


ADJ_SKEW = f"CASE WHEN count(ret) OVER {frame(-19, 0)} = 20 THEN skewness(ret) OVER {frame(-19, 0)} END"
ADJ_KURT = f"CASE WHEN count(ret) OVER {frame(-19, 0)} = 20 THEN kurtosis(ret) OVER {frame(-19, 0)} END"
SLOPE = f"CASE WHEN count(close) OVER {frame(-19, 0)} = 20 THEN regr_slope(ln(close), rn) OVER {frame(-19, 0)} END"
DRAWDOWN = f"close / max(close) OVER {frame(-59, 0)} - 1"
PARKINSON = "sqrt(ln(high / low) * ln(high / low) / (4 * ln(2)))"

#: f1 to f3: all features of a bar without masks.
FEATURES = f"""
f1 AS (SELECT *, {rv(5)} AS rv5, {rv(10)} AS rv10, {rv(20)} AS rv20, {PARKINSON} AS park_d, {ADJ_SKEW} AS skew20, {ADJ_KURT} AS kurt20,
    {SLOPE} AS slope20, {DRAWDOWN} AS dd60, {label(10)} AS label,
  {ema('close', '0.2')} AS e9, {ema('close', '(2.0/13)')} - {ema('close', '(2.0/27)')} AS md, CASE WHEN ret IS NOT NULL THEN list_reduce(list(ret * ret) FILTER (ret IS NOT NULL) OVER {frame(None, 0)},
    lambda a, v: 0.06 * v + 0.94 * a) END AS ev FROM r),
f2 AS (SELECT *, CASE WHEN rn >= 9 THEN e9 END AS ema9, CASE WHEN rn >= 26 THEN md END AS macd, CASE WHEN rn >= 11 THEN sqrt(ev) END AS ewma94,
    rv10 - lag(rv10) OVER ({W}) AS d_rv10, {roll('stddev_samp', 'rv10', -9, 0, 10)} AS vov FROM f1),
f3 AS (SELECT *, CASE WHEN rn >= 46 THEN list_reduce(list(macd) FILTER (macd IS NOT NULL) OVER {frame(None, 0)}, lambda a,
    v: (2.0/22) * v + (1 - 2.0/22) * a) END AS macd21,
  CASE WHEN rn >= 34 THEN list_reduce(list(macd) FILTER (macd IS NOT NULL) OVER {frame(None, 0)}, lambda a, v: 0.2 * v + 0.8 * a) END AS macd_signal FROM f2)"""

HISTORY = {"park_d": 1, "ema9": 9, "macd21": 26, "slope20": 20, "rv5": 6, "rv10": 11, "rv20": 21, "ewma94": 11, "d_rv10": 12, "vov": 20, "skew20": 21, "kurt20": 21, "dd60": 60}
MASKED = ", ".join(f"CASE WHEN rn >= {n} THEN {c} END AS {c}" for c, n in HISTORY.items())
CALENDAR = ", ".join([*(f"CASE WHEN isodow(date) - 1 = {i} THEN 1.0 ELSE 0.0 END AS dow_{i}" for i in range(7)), *(f"CASE WHEN month(date) = {i} THEN 1.0 ELSE 0.0 END AS mon_{i}" for i in range(1, 13))])


def filled(c: str) -> str:
    near, past = frame(-20, -1), frame(None, -1)
    return f"coalesce({c}, CASE WHEN count({c}) OVER {near} >= 3 THEN quantile_cont({c}, 0.5) OVER {near} END, CASE WHEN count({c}) OVER {past} >= 5 THEN quantile_cont({c}, 0.5) OVER {past} END) AS {c}"


DATASET = f"""{BASE}, {FEATURES},
m AS (SELECT date, ticker, {MASKED}, {CALENDAR}, label FROM f3),
i AS (SELECT date, ticker, {', '.join(filled(c) for c in HISTORY)}, {', '.join([*(f'dow_{i}' for i in range(7)), *(f'mon_{i}' for i in range(1, 13))])}, label FROM m),
d AS (SELECT * FROM i WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*HISTORY, 'label'])}),
n AS (SELECT *, row_number() OVER ({W}) AS k, count(*) OVER (PARTITION BY ticker) AS c FROM d),
s AS (SELECT *, CASE WHEN k <= floor(0.4 * c) THEN 'train' WHEN k <= floor(0.4 * c) + floor(0.35 * c) THEN 'val'
    ELSE 'test' END AS split FROM n)"""

WEIGHT_LIST = "list_transform(range(32), lambda i: 0.6 * pow(0.4, i))"


def spread(x: str, weights: str) -> str:
    """Two CTE columns' expressions: the newest-first values, and their weighted spread from the column v and m."""
    return f"CASE WHEN len(v) = 32 THEN sqrt(list_sum(list_transform(range(1, 33), lambda i: {weights}[i] * (v[i] - m) * (v[i] - m)))) END"


def spreads(source: str, x: str = "sret", weights: str = "w", normalized: bool = False) -> str:
    """CTEs a, b, q over source rows where x is known: v, m and sd."""
    w = f"(SELECT list_transform(l, lambda y: y / list_sum(l)) FROM (SELECT {WEIGHT_LIST} AS l))" if normalized else f"(SELECT {WEIGHT_LIST})"
    return f"""a AS (SELECT *, list_reverse(list({x}) OVER {frame(-31, 0)}) AS v, row_number() OVER ({W}) AS n, {w} AS w
    FROM {source} WHERE {x} IS NOT NULL),
b AS (SELECT *, CASE WHEN len(v) = 32 THEN list_sum(list_transform(range(1, 33), lambda i: w[i] * v[i])) END AS m FROM a),
q AS (SELECT *, {spread(x, 'w')} AS sd FROM b)"""


V1 = f"""{spreads('r')}, q1 AS (SELECT * REPLACE (CASE WHEN n > 32 THEN sd END AS sd) FROM q),
v1 AS (SELECT ticker, date, close, 19.0 * (0.7 * sd + 0.3 * ({roll('avg', 'sd', -54, -1, 54)})) AS pred_vol FROM q1)"""
V2 = f"""{spreads('r', normalized=True)}, q2 AS (SELECT ticker, date, 19.0 * (0.7 * sd + 0.3 * ({roll('avg', 'sd', -53, 0, 54)})) AS now FROM q),
v2 AS (SELECT bars.ticker AS ticker, bars.date AS date, bars.close AS close, lag(now) OVER (PARTITION BY bars.ticker ORDER BY bars.date) AS pred_vol
    FROM bars LEFT JOIN q2 ON bars.ticker = q2.ticker AND bars.date = q2.date)"""
V3 = f"""t3 AS (SELECT ticker, date, close, {roll('stddev_samp', 'sret', -54, 0, 55)} AS sd, count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING
    AND UNBOUNDED FOLLOWING) AS left_rows FROM r),
v3 AS (SELECT ticker, date, close, CASE WHEN left_rows > 54 THEN 19.0 * (0.7 * sd + 0.3 * (avg(sd) OVER {frame(1, 53)})) END AS pred_vol FROM t3)"""
V4 = f"""d4 AS (SELECT ticker, date, close, (close - newer) / newer AS ret4
    FROM (SELECT *, lead(close) OVER ({W}) AS newer FROM bars) WHERE newer IS NOT NULL),
{spreads('d4', 'ret4')}, p4 AS (SELECT ticker, date, n, 19.0 * (0.7 * sd + 0.3 * ({roll('avg', 'sd', -53, -1, 53)})) AS pv FROM q),
v4 AS (SELECT ticker, arg_max(CASE WHEN n >= 86 THEN pv END, date) AS pred_vol
    FROM p4 GROUP BY ticker)"""
V5 = f"""{spreads('r')}, p5 AS (SELECT ticker, date, m, sd, CASE WHEN count(sd) OVER {frame(None, 0)} > 54 THEN 19.0 * (0.7 * sd + 0.3 * ({roll('avg', 'sd', -53, -1, 53)})) END AS pred_vol FROM q),
v5 AS (SELECT r.ticker AS ticker, CAST(row_number() OVER (PARTITION BY r.ticker ORDER BY r.date DESC) - 1 AS INTEGER) AS idx,
    r.date AS date, close, sret AS ret, m AS ewma32, sd AS stdev32, pred_vol
    FROM r LEFT JOIN p5 ON r.ticker = p5.ticker AND r.date = p5.date)"""
WEIGHTS = "weights AS (SELECT * FROM (VALUES ('A', 0.23, 1.0), ('N', 0.078, 1.0), ('R', 0.078, 1.0)) t(ticker, portw, mult))"
BEFORE = """lastp AS (SELECT ticker, arg_max(close, date) AS price
    FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS top
    FROM bars) WHERE date < top GROUP BY ticker)"""


def weekly_positions(vols: str) -> str:
    """CTE wp of a weekly backtest over forecasts (ticker, date, pred_vol)."""
    friday = "date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER)"
    t = "PARTITION BY ticker ORDER BY week"
    return f"""{WEIGHTS}, wk AS (SELECT ticker, {friday} AS week, arg_max(close, date) AS price FROM bars GROUP BY 1, 2),
vw AS (SELECT ticker, {friday} AS week, arg_max(pred_vol, date) AS pv FROM {vols}
    WHERE pred_vol IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT week FROM wk) CROSS JOIN (SELECT ticker, portw / sum(portw) OVER () AS w FROM weights)),
j AS (SELECT grid.ticker AS ticker, grid.week AS week, w, price, pv FROM grid LEFT JOIN wk ON grid.ticker = wk.ticker
    AND grid.week = wk.week LEFT JOIN vw ON grid.ticker = vw.ticker AND grid.week = vw.week),
k AS (SELECT *, last_value(pv IGNORE NULLS) OVER ({t} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0 FROM j),
l AS (SELECT *, CASE WHEN v0 IS NOT NULL THEN greatest(v0, 1e-8) END AS vol FROM k),
o AS (SELECT *, 50000.0 * w / (price * vol) AS shares, lead(week) OVER ({t}) IS NOT NULL AS more, lead(price) OVER ({t}) AS nextp FROM l),
wp AS (SELECT ticker, week, price, vol, shares, shares * (nextp - price) AS pnl FROM o WHERE more),
ws AS (SELECT week, coalesce(sum(pnl), 0.0) AS pnl FROM wp GROUP BY week)"""


PRED = f"""{BASE}, p AS (SELECT date, ticker, {label(10)} AS y, {rv(10)} AS pred FROM r), e AS (
  SELECT *, greatest(pred, 1e-12) AS pp, abs(y - greatest(pred, 1e-12)) AS ae, abs(y - greatest(pred, 1e-12)) / greatest(abs(y),
    1e-12) AS ape FROM p WHERE y IS NOT NULL AND pred IS NOT NULL)"""
DECILES = """d AS (SELECT CAST(CASE WHEN t = 1 THEN 1 ELSE greatest(1, ceil((rk - 1) * least(10, t) / (t - 1))) END AS INTEGER) AS decile,
    * FROM (SELECT *, row_number() OVER (ORDER BY pp, ticker, date) AS rk, count(*) OVER () AS t FROM e)),
dt AS (SELECT decile, count(*) AS count, avg(y) AS mean_y, avg(pp) AS mean_pred, avg(ae) AS mae, avg(ape) AS mape
    FROM d GROUP BY decile)"""

LOOK = 60
REGIME = f"""{BASE}, sg AS (SELECT *, {rv(10)} AS sigma_hat FROM r),
g1 AS (SELECT date, ticker, close AS price, volume, sigma_hat, rn, {ema('close', '0.2')} AS ema_fast, {ema('close', '(2.0/22)')} AS ema_slow,
    {ema('close', f'(2.0/{LOOK + 1})')} AS ema_look,
  CASE WHEN count(*) OVER {frame(1 - LOOK, 0)} >= 20 THEN CASE WHEN sum(volume) OVER {frame(1 - LOOK, 0)} > 0 THEN sum(close * volume) OVER {frame(1 - LOOK, 0)} / sum(volume) OVER {frame(1 - LOOK, 0)} END END AS vw,
  quantile_cont(sigma_hat, 0.33) OVER {frame(None, -1)} AS q1, quantile_cont(sigma_hat, 0.66) OVER {frame(None, -1)} AS q2 FROM sg),
g2 AS (SELECT *, ema_fast - ema_slow AS ema_slope, coalesce(vw, ema_look) AS vwap_roll, price - coalesce(vw, ema_look) AS sp FROM g1),
g AS (SELECT date, ticker, price, volume, sigma_hat, ema_fast, ema_slow, ema_slope, vwap_roll,
  CAST(CASE WHEN rn = 1 THEN NULL WHEN sigma_hat IS NULL OR q1 IS NULL THEN 1 WHEN sigma_hat <= q1 THEN 0
    WHEN sigma_hat >= q2 THEN 2 ELSE 1 END AS INTEGER) AS vol_tercile,
  CASE WHEN ({roll('stddev_samp', 'sp', 1 - LOOK, 0, 10)}) > 0 THEN (sp - ({roll('avg', 'sp', 1 - LOOK, 0, 10)})) / ({roll('stddev_samp', 'sp', 1 - LOOK, 0, 10)}) END AS vwap_z FROM g2),
sc AS (SELECT date, ticker, coalesce(CAST(vol_tercile = 0 AS INT), 0) + coalesce(CAST(ema_slope > 0 AS INT), 0) + coalesce(CAST(vwap_z > -0.5 AS INT), 0) AS s_on,
  coalesce(CAST(vol_tercile = 2 AS INT), 0) + 1 - coalesce(CAST(ema_slope > 0 AS INT), 0) + coalesce(CAST(vwap_z < -1.0 AS INT), 0) AS s_off FROM g),
lb AS (SELECT date, ticker, CASE WHEN s_off > s_on THEN 'risk_off' WHEN s_on > s_off THEN 'risk_on' ELSE 'neutral' END AS state FROM sc),
vc AS (SELECT date, count(*) FILTER (state = 'risk_off') AS a, count(*) FILTER (state = 'neutral') AS b, count(*) FILTER (state = 'risk_on') AS c FROM lb GROUP BY date),
vt AS (SELECT date, CASE WHEN a >= b AND a >= c THEN 'risk_off' WHEN b >= c THEN 'neutral' ELSE 'risk_on' END AS state,
    row_number() OVER (ORDER BY date) AS i FROM vc)"""
STATE = REGIME.replace("WITH ", "WITH RECURSIVE ", 1) + """,
h AS (SELECT i, date, state AS now, CAST(NULL AS VARCHAR) AS nx, 0 AS n FROM vt WHERE i = 1
  UNION ALL SELECT vt.i, vt.date,
    CASE WHEN state <> now AND (CASE WHEN state = nx THEN n + 1 ELSE 1 END) >= 3 THEN state ELSE now END,
    CASE WHEN state = now THEN NULL WHEN (CASE WHEN state = nx THEN n + 1 ELSE 1 END) >= 3 THEN NULL ELSE state END,
    CASE WHEN state = now THEN 0 WHEN (CASE WHEN state = nx THEN n + 1 ELSE 1 END) >= 3 THEN 0 ELSE CASE
    WHEN state = nx THEN n + 1 ELSE 1 END END
  FROM h JOIN vt ON vt.i = h.i + 1),
ds AS (SELECT date, now AS state FROM h),
st AS (SELECT * FROM (VALUES ('risk_off'), ('neutral'), ('risk_on')) t(s)),
tc AS (SELECT prev, state, count(*) AS n FROM (SELECT state, lag(state) OVER (ORDER BY date) AS prev
    FROM ds) WHERE prev IS NOT NULL GROUP BY prev, state),
tp AS (SELECT x.s AS from_state, y.s AS to_state, coalesce(n, 0) + 0.5 AS c
    FROM st x CROSS JOIN st y LEFT JOIN tc ON tc.prev = x.s AND tc.state = y.s),
tr AS (SELECT from_state, to_state, c / sum(c) OVER (PARTITION BY from_state) AS prob FROM tp),
nw AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (ORDER BY date) AS run
    FROM (SELECT *, lag(state) OVER (ORDER BY date) AS pv FROM ds)),
ag AS (SELECT date, state, CAST(run AS BIGINT) AS run, CAST(row_number() OVER (PARTITION BY run ORDER BY date) AS INTEGER) AS age FROM nw),
rl AS (SELECT run, state, min(date) AS start, max(date) AS "end", count(*) AS length
    FROM ag GROUP BY run, state),
lg AS (SELECT state, unnest(range(1, max(length) + 1)) AS age FROM rl GROUP BY state),
hz AS (SELECT lg.state AS state, CAST(lg.age AS INTEGER) AS age, CAST(count(*) FILTER (length = lg.age) AS DOUBLE) / count(*) AS hazard
    FROM lg JOIN rl ON rl.state = lg.state AND rl.length >= lg.age GROUP BY 1, 2),
hs AS (SELECT state, age, greatest(0.0, least(0.99, avg(hazard) OVER (PARTITION BY state ORDER BY age ROWS BETWEEN 2 PRECEDING
    AND CURRENT ROW))) AS hazard FROM hz)"""
