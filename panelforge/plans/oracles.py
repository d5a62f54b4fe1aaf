"""DuckDB SQL that the registered queries are checked against; written independently of the operators."""

from __future__ import annotations

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _bars(name: str, period: str, symbol: str, source: str) -> str:
    return f"""
{name} AS (SELECT CAST(date_trunc('{period}', l_shipdate) AS DATE) AS dt, {symbol} AS symbol, first(px ORDER BY {_ORDER}) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS px FROM {source}) WHERE px IS NOT NULL GROUP BY 1, 2),
{name}g AS (SELECT d.dt, s.symbol, b.* EXCLUDE (dt, symbol), row_number() OVER (PARTITION BY s.symbol ORDER BY d.dt) - 1 AS i
  FROM (SELECT DISTINCT dt FROM {name}) d CROSS JOIN (SELECT DISTINCT symbol FROM {name}) s LEFT JOIN {name} b ON b.dt = d.dt AND b.symbol = s.symbol)"""


BM = _bars("bm", "month", "l_suppkey", "lineitem")
BW = _bars("bw", "week", "s_nationkey", "lineitem JOIN supplier ON s_suppkey = l_suppkey")
#: Month panel with factor (momentum over 5) and the next bar's return from open to close.
PAIRS = (
    BM
    + """,
pairs0 AS (SELECT dt, symbol, close / nullif(lag(close, 5) OVER w, 0) - 1 AS factor, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd_ret FROM bmg WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
pairs AS (SELECT * FROM pairs0 WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL)"""
)
_AVG_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
_CORR = "covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def rank(x: str, k: str = "dt") -> str:
    return _AVG_RANK.format(x=x, k=k)


def corr(x: str, y: str) -> str:
    return _CORR.format(x=x, y=y)


IC = (
    PAIRS
    + f""",
ranked AS (SELECT dt, {rank('factor')} AS rf, {rank('fwd_ret')} AS rr FROM pairs),
ic AS (SELECT dt, CASE WHEN count(*) >= 3 THEN {corr('rf', 'rr')} END AS ic FROM ranked GROUP BY 1)"""
)
LAYERS = (
    PAIRS
    + """,
grouped AS (SELECT *, greatest(1, CAST(ceil((rn - 1) * 5 / (n - 1)::DOUBLE) AS INT)) AS grp FROM
  (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY factor, symbol) AS rn, count(*) OVER (PARTITION BY dt) AS n FROM pairs) WHERE n >= 5),
layers AS (SELECT dt, grp, avg(fwd_ret) AS ret FROM grouped GROUP BY 1, 2),
damped AS (SELECT dt, grp, ret / 100 AS ret FROM layers)"""
)
# Turnover and holdings look at the factor alone.
TOP = (
    PAIRS
    + """,
fgroup AS (SELECT *, greatest(1, CAST(ceil((rn - 1) * 5 / (n - 1)::DOUBLE) AS INT)) AS grp FROM
  (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY factor, symbol) AS rn, count(*) OVER (PARTITION BY dt) AS n FROM pairs0 WHERE factor IS NOT NULL) WHERE n >= 5),
held AS (SELECT dt, symbol, factor, 1.0 / count(*) OVER (PARTITION BY dt) AS w FROM fgroup WHERE grp = 5)"""
)
SERIES = (
    BM
    + """,
ser AS (SELECT dt, avg(r) / 100 AS ret FROM (SELECT dt, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS r FROM bmg) WHERE r IS NOT NULL GROUP BY 1)"""
)
CAPPED = (
    BM
    + """,
cap AS (SELECT *, ln(nullif(sum(amount) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0)) AS size,
  close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS factor FROM bmg)"""
)
QS = """
q0 AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount) * 0.6::DOUBLE) AS cost_revenue,
  sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) AS net_income, sum(l_quantity * 100) AS total_assets, sum(l_quantity * 40) AS equity FROM lineitem GROUP BY 1, 2),
qs AS (SELECT *, CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, CAST(quarter + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS dt, revenue - cost_revenue AS gross_profit FROM q0)"""
QUALITY = (
    QS
    + """,
ql AS (SELECT symbol, dt, report_date, net_income / nullif(equity, 0) AS roeq, net_income / nullif((total_assets + lag(total_assets) OVER w) / 2, 0) AS roaq,
  gross_profit / nullif((total_assets + lag(total_assets) OVER w) / 2, 0) AS gpoaq, gross_profit / nullif(revenue, 0) AS gmarq,
  (net_income - lag(net_income, 4) OVER w) / nullif(lag(equity, 4) OVER w, 0) AS droeq, (net_income - lag(net_income, 4) OVER w) / nullif(lag(total_assets, 4) OVER w, 0) AS droaq,
  (gross_profit - lag(gross_profit, 4) OVER w) / nullif(lag(total_assets, 4) OVER w, 0) AS dgpoaq, (gross_profit - lag(gross_profit, 4) OVER w) / nullif(lag(revenue, 4) OVER w, 0) AS dgmarq
  FROM qs WINDOW w AS (PARTITION BY symbol ORDER BY dt, report_date))"""
)
#: Weights of four factors by the ICIR of the past.
WEIGHTS = (
    BM
    + f""",
fac AS (SELECT dt, symbol, close / nullif(lag(close, 1) OVER w, 0) - 1 AS m1, close / nullif(lag(close, 3) OVER w, 0) - 1 AS m3, (high - low) / nullif(close, 0) AS spread, volume AS vol,
  lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS fwd FROM bmg WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
lng AS (SELECT dt, symbol, fwd, factor, value FROM (SELECT dt, symbol, fwd, CAST(m1 AS DOUBLE) AS m1, CAST(m3 AS DOUBLE) AS m3, CAST(spread AS DOUBLE) AS spread, CAST(vol AS DOUBLE) AS vol FROM fac) UNPIVOT (value FOR factor IN (m1, m3, spread, vol))),
fr AS (SELECT dt, factor, {rank('value', 'dt, factor')} AS rv, {rank('fwd', 'dt, factor')} AS rf FROM lng WHERE fwd IS NOT NULL AND value IS NOT NULL),
fic AS (SELECT dt, factor, CASE WHEN count(*) >= 5 THEN {corr('rv', 'rf')} END AS ic FROM fr GROUP BY 1, 2),
sc AS (SELECT dt, factor, CASE WHEN count(ic) OVER p >= 6 THEN greatest(coalesce(avg(ic) OVER p / nullif(stddev_samp(ic) OVER p, 0), 0), 0) END AS score
  FROM fic WINDOW p AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
wt AS (SELECT dt, factor, CASE WHEN score IS NULL THEN NULL WHEN sum(score) OVER d > 0 THEN score / sum(score) OVER d ELSE 1.0 / count(score) OVER d END AS weight FROM sc WINDOW d AS (PARTITION BY dt))"""
)


def _w(n: int, x: str) -> str:
    return f"{x} OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, value: str, over: str = "close") -> str:
    return f"(CASE WHEN {_w(n, f'count({over})')} = {n} THEN {value} END)"


def _agg(n: int, f: str, x: str, extra: str = "") -> str:
    return _full(n, _w(n, f"{f}({x}{extra})"), x)


def _pos(n: int, x: str, f: str) -> str:
    return _full(n, f"(list_position({_w(n, f'list({x})')}, {_w(n, f'{f}({x})')}) - 1)", x)


def _rc(n: int, a: str, b: str) -> str:
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return _full(n, f"{_w(n, f'covar_samp({x}, {y})')} / nullif({_w(n, f'stddev_samp({x})')} * {_w(n, f'stddev_samp({y})')}, 0)", x)


def _share(n: int, x: str, op: str) -> str:
    return _agg(n, "avg", f"(CASE WHEN {x} {op} 0 THEN 1.0::DOUBLE WHEN {x} IS NOT NULL THEN 0.0::DOUBLE END)")


def _part(n: int, x: str, sign: str) -> str:
    return f"{_agg(n, 'sum', f'(CASE WHEN {x} IS NOT NULL THEN greatest({sign}{x}, 0) END)')} / nullif({_agg(n, 'sum', f'abs({x})')}, 0)"


_C = "nullif(close, 0)"
ROLLING = {
    "roc": lambda n: f"lag(close, {n}) OVER (PARTITION BY symbol ORDER BY dt) / {_C}",
    "ma": lambda n: f"{_agg(n, 'avg', 'close')} / {_C}",
    "std": lambda n: f"{_agg(n, 'stddev_samp', 'close')} / {_C}",
    "beta": lambda n: f"{_full(n, _w(n, 'regr_slope(close, i)'))} / {_C}",
    "rsqr": lambda n: _full(n, f"CASE WHEN {_w(n, 'max(close)')} = {_w(n, 'min(close)')} THEN 1.0 ELSE {_w(n, 'regr_r2(close, i)')} END"),
    "resi": lambda n: _full(n, f"(close - ({_w(n, 'regr_intercept(close, i)')} + {_w(n, 'regr_slope(close, i)')} * i)) / {_C}"),
    "max": lambda n: f"{_agg(n, 'max', 'high')} / {_C}",
    "min": lambda n: f"{_agg(n, 'min', 'low')} / {_C}",
    "qtlu": lambda n: f"{_agg(n, 'quantile_cont', 'close', ', 0.8')} / {_C}",
    "qtld": lambda n: f"{_agg(n, 'quantile_cont', 'close', ', 0.2')} / {_C}",
    "rank": lambda n: _full(n, f"(list_sum(list_transform({_w(n, 'list(close)')}, lambda v: CASE WHEN v < close THEN 1.0 WHEN v = close THEN 0.5 ELSE 0.0 END)) + 0.5) / {n}"),
    "rsv": lambda n: f"(close - {_agg(n, 'min', 'low')}) / nullif({_agg(n, 'max', 'high')} - {_agg(n, 'min', 'low')}, 0)",
    "imax": lambda n: f"{_pos(n, 'high', 'max')} / {n - 1}.0",
    "imin": lambda n: f"{_pos(n, 'low', 'min')} / {n - 1}.0",
    "imxd": lambda n: f"({_pos(n, 'high', 'max')} - {_pos(n, 'low', 'min')}) / {n - 1}.0",
    "corr": lambda n: _rc(n, "close", "lv"),
    "cord": lambda n: _rc(n, "ret", "dlv"),
    "cntp": lambda n: _share(n, "dc", ">"),
    "cntn": lambda n: _share(n, "dc", "<"),
    "cntd": lambda n: f"{_share(n, 'dc', '>')} - {_share(n, 'dc', '<')}",
    "sump": lambda n: _part(n, "dc", ""),
    "sumn": lambda n: _part(n, "dc", "-"),
    "sumd": lambda n: f"{_part(n, 'dc', '')} - {_part(n, 'dc', '-')}",
    "vma": lambda n: f"{_agg(n, 'avg', 'volume')} / nullif(volume, 0)",
    "vstd": lambda n: f"{_agg(n, 'stddev_samp', 'volume')} / nullif(volume, 0)",
    "wvma": lambda n: f"{_agg(n, 'stddev_samp', 'rv')} / nullif({_agg(n, 'avg', 'rv')}, 0)",
    "vsump": lambda n: _part(n, "dv", ""),
    "vsumn": lambda n: _part(n, "dv", "-"),
    "vsumd": lambda n: f"{_part(n, 'dv', '')} - {_part(n, 'dv', '-')}",
}
DERIVED = (
    BW
    + """,
d0 AS (SELECT *, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM bwg),
d1 AS (SELECT *, close - lag(close) OVER w AS dc, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lv - lag(lv) OVER w AS dlv, volume - lag(volume) OVER w AS dv FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
d AS (SELECT *, abs(ret) * volume AS rv FROM d1)"""
)


def r6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 2.3e-10, 6) + 0.0 AS {name}"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_TOPBOT = "(CASE WHEN open >= close THEN open ELSE close END)", "(CASE WHEN open <= close THEN open ELSE close END)"
_K = {"kmid": "close - open", "kup": f"high - {_TOPBOT[0]}", "klow": f"{_TOPBOT[1]} - low", "ksft": "2 * close - high - low"}
_KSQL = [r6("(high - low) / nullif(open, 0)", "alpha158_klen")] + [s for n, e in _K.items() for s in (r6(f"({e}) / nullif(open, 0)", f"alpha158_{n}"), r6(f"({e}) / nullif(high - low, 0)", f"alpha158_{n}2"))]
_TRADED = "amount / nullif(volume, 0)"
_RET = "close / nullif(lag(close) OVER w, 0) - 1"
_WS = "WINDOW w AS (PARTITION BY symbol ORDER BY dt)"


_PRICE = [f"""{r6(f'open / {_C}', 'alpha158_open0')}""", f"""{r6(f'high / {_C}', 'alpha158_high0')}""", f"""{r6(f'low / {_C}', 'alpha158_low0')}""", f"""{r6(f'coalesce(CASE WHEN {_TRADED} / {_C} BETWEEN 0.5 AND 1.5 THEN {_TRADED} END, (open + high + low + close) / 4) / {_C}', 'alpha158_vwap0')}"""]


def _perf(source: str, by: str = "", p: str = "p") -> str:
    """Performance figures of (by, dt, ret), as the table ``{p}f``."""
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
{p}v AS (SELECT {head}dt, ret, product(1 + ret) OVER ({part}ORDER BY dt ROWS UNBOUNDED PRECEDING) AS v FROM {source}),
{p}d0 AS (SELECT *, v / nullif(max(v) OVER ({part}ORDER BY dt ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM {p}v),
{p}d1 AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER ({part}ORDER BY dt ROWS UNBOUNDED PRECEDING) AS calm FROM {p}d0),
{p}d2 AS (SELECT *, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {head}calm) AS run FROM {p}d1),
{p}f AS (SELECT {head}product(1 + ret) - 1 AS total_return, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(ret)) - 1 ELSE -1.0 END AS annual_return, stddev_pop(ret) * sqrt(252) AS annual_vol,
  coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) AS sharpe, min(dd) AS max_drawdown, max(run) AS drawdown_days, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  avg(CASE WHEN ret > 0 THEN ret END) / nullif(abs(avg(CASE WHEN ret < 0 THEN ret END)), 0) AS profit_loss, count(ret) AS n,
  CASE WHEN min(dd) < 0 THEN (CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(ret)) - 1 ELSE -1.0 END) / abs(min(dd)) ELSE 0 END AS calmar FROM {p}d2 {group})"""


_PERF_OUT = ", ".join(r6(c, c) for c in ("total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "calmar", "win_rate", "profit_loss")) + ", CAST(drawdown_days AS BIGINT) AS drawdown_days, n"

_TIMING = (
    BW
    + """,
mc AS (SELECT dt, symbol, close, coalesce(sign(CASE WHEN count(close) OVER f = 5 THEN avg(close) OVER f END - CASE WHEN count(close) OVER s = 20 THEN avg(close) OVER s END), 0) AS s FROM bw
  WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
tr AS (SELECT dt, symbol, s, close / nullif(lag(close) OVER w, 0) - 1 AS r, lag(s, 2) OVER w AS s2 FROM mc WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
ts AS (SELECT dt, symbol, s, r, coalesce(s2 * r, 0) / 100 AS ret FROM tr)"""
)


def _cleaned(out: str, source: str, keep: str) -> str:
    """Tables ``{out}`` of (keep, factor, z): clipped, filled and standardised per date and factor."""
    return f"""
{out}q AS (SELECT dt, factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM {source} GROUP BY 1, 2),
{out}c AS (SELECT {keep}, factor, CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END AS v FROM {source} JOIN {out}q USING (dt, factor)),
{out}f AS (SELECT {keep}, factor, coalesce(v, median(v) OVER (PARTITION BY dt, factor)) AS v FROM {out}c),
{out} AS (SELECT {keep}, factor, round((v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0), 10) AS z FROM {out}f WINDOW d AS (PARTITION BY dt, factor))"""


def _icir(out: str, source: str) -> str:
    """``{out}`` (dt, factor, weight) by the rank ICIR of (dt, factor, value, fwd)."""
    return f"""
{out}r AS (SELECT dt, factor, {rank('value', 'dt, factor')} AS rv, {rank('fwd', 'dt, factor')} AS rf FROM {source} WHERE fwd IS NOT NULL AND value IS NOT NULL),
{out}i AS (SELECT dt, factor, CASE WHEN count(*) >= 5 THEN {corr('rv', 'rf')} END AS ic FROM {out}r GROUP BY 1, 2),
{out}s AS (SELECT dt, factor, CASE WHEN count(ic) OVER p >= 6 THEN greatest(coalesce(avg(ic) OVER p / nullif(stddev_samp(ic) OVER p, 0), 0), 0) END AS score
  FROM {out}i WINDOW p AS (PARTITION BY factor ORDER BY dt ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
{out} AS (SELECT dt, factor, CASE WHEN score IS NULL THEN NULL WHEN sum(score) OVER d > 0 THEN score / sum(score) OVER d ELSE 1.0 / count(score) OVER d END AS weight FROM {out}s WINDOW d AS (PARTITION BY dt))"""


_PROFIT, _GROWTH = ("roeq", "roaq", "gpoaq", "gmarq"), ("droeq", "droaq", "dgpoaq", "dgmarq")


def _composite(names: tuple[str, ...], equal: bool, blend: bool, dated: bool = False) -> str:
    members = """
snap AS (SELECT quarter, symbol FROM (SELECT quarter, symbol, row_number() OVER (PARTITION BY quarter ORDER BY revenue DESC, symbol) AS n FROM qs) WHERE n <= 8),
used AS (SELECT DISTINCT (SELECT max(quarter) FROM snap WHERE quarter <= d.dt) AS quarter FROM (SELECT DISTINCT dt FROM bm) d),
mem AS (SELECT DISTINCT symbol FROM snap JOIN used USING (quarter)),"""
    counts = " AND ".join(f"count({n}) >= 5" for n in names)
    ctes = (
        BM + "," + QUALITY + "," + (members if dated else "") + f"""
dv AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS symbol, sum(l_extendedprice * l_discount) AS dividend FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
pn0 AS (SELECT dt, symbol, close, sum(amount) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS cap FROM bmg {'WHERE symbol IN (SELECT symbol FROM mem)' if dated else ''}),
ttm AS (SELECT p.dt, p.symbol, sum(abs(dividend)) AS ttm FROM pn0 p JOIN dv ON dv.symbol = p.symbol AND dv.d > p.dt - 365 AND dv.d <= p.dt GROUP BY 1, 2),
pn AS (SELECT p.dt, p.symbol, close, cap, CASE WHEN cap > 0 THEN ln(cap) END AS size, CASE WHEN cap > 0 THEN coalesce(ttm, 0) / cap END AS dividend_ratio FROM pn0 p LEFT JOIN ttm USING (dt, symbol)),
ao AS (SELECT p.*, q.report_date, {', '.join(f'q.{n}' for n in (*_PROFIT, *_GROWTH))} FROM pn p ASOF LEFT JOIN ql q ON q.symbol = p.symbol AND q.dt <= p.dt),
ok AS (SELECT dt FROM ao GROUP BY 1 HAVING {counts}),
fw AS (SELECT dt, symbol, lead(c) OVER w / nullif(c, 0) - 1 AS fwd FROM (SELECT dt, symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt) AS c FROM pn) WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
bs AS (SELECT ao.*, CASE WHEN ao.symbol % 3 > 0 THEN r_name END AS industry FROM ao LEFT JOIN supplier ON s_suppkey = ao.symbol LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE dt IN (SELECT dt FROM ok)),
ln0 AS (SELECT dt, symbol, report_date, size, industry, unnest([{', '.join(f"'{n}'" for n in names)}]) AS factor, unnest([{', '.join(names)}]) AS value FROM bs),"""
        + _cleaned("ca", "ln0", "dt, symbol, report_date, size, industry")
        + """,
nz AS (SELECT *, industry IS NOT NULL AS has, CASE WHEN z IS NOT NULL THEN size END AS ks FROM ca),
n1 AS (SELECT *, count(ks) OVER s >= 3 AND max(ks) OVER s <> min(ks) OVER s AS use, median(ks) OVER s AS mid, count(z) OVER s AS n, count(z) OVER (PARTITION BY dt, factor) AS n_all,
  avg(z) OVER s AS side_mean FROM nz WINDOW s AS (PARTITION BY dt, factor, has)),
n2 AS (SELECT *, CASE WHEN z IS NOT NULL THEN CASE WHEN use THEN coalesce(size, mid) ELSE 0 END END AS s FROM n1),
gi AS (SELECT dt, factor, has, count(DISTINCT industry) AS k FROM nz WHERE z IS NOT NULL GROUP BY 1, 2, 3),
n3 AS (SELECT n2.*, z - avg(z) OVER g AS ry, s - avg(s) OVER g AS rs FROM n2 WINDOW g AS (PARTITION BY dt, factor, has, industry)),
n4 AS (SELECT n3.*, coalesce(sum(ry * rs) OVER x / nullif(sum(rs * rs) OVER x, 0), 0) AS slope FROM n3 WINDOW x AS (PARTITION BY dt, factor, has)),
n5 AS (SELECT n4.dt, n4.symbol, report_date, n4.factor, CASE WHEN n_all >= 3 THEN CASE WHEN n < 3 OR CASE WHEN n4.has THEN k ELSE 1 END + CASE WHEN use THEN 1 ELSE 0 END >= n THEN z - side_mean ELSE ry - slope * rs END END AS e
  FROM n4 LEFT JOIN gi ON gi.dt = n4.dt AND gi.factor = n4.factor AND gi.has = n4.has),
lq AS (SELECT n5.dt, n5.symbol, report_date, factor, fwd, round((e - avg(e) OVER d) / nullif(stddev_samp(e) OVER d, 0), 10) AS value FROM n5 LEFT JOIN fw USING (dt, symbol) WINDOW d AS (PARTITION BY n5.dt, factor)),"""
    )
    if equal:
        ctes += "\nsco AS (SELECT dt, symbol, avg(value) AS score FROM lq WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"
    else:
        ctes += _icir("iw", "lq") + """,
sw AS (SELECT dt, factor, CASE WHEN sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) OVER d >= 3 THEN weight WHEN count(weight) OVER d >= 3 AND weight IS NOT NULL THEN 1.0 / count(weight) OVER d END AS weight FROM iw WINDOW d AS (PARTITION BY dt)),
sco AS (SELECT dt, symbol, sum(value * weight) / nullif(sum(weight), 0) AS score FROM lq JOIN sw USING (dt, factor) WHERE value IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"""
    if not blend:
        return with_(ctes, f"SELECT dt, symbol, {r6('score', 'value')} FROM sco")
    ctes += f""",
sd AS (SELECT c.dt, c.symbol, c.report_date, c.fwd, score FROM (SELECT * FROM lq WHERE factor = '{names[0]}') c LEFT JOIN sco USING (dt, symbol)),
lr AS (SELECT symbol, report_date, score FROM sd WHERE score IS NOT NULL AND report_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, report_date ORDER BY dt DESC) = 1),
yy AS (SELECT sd.*, sd.score - lr.score AS increase FROM sd LEFT JOIN lr ON lr.symbol = sd.symbol AND lr.report_date = CAST(sd.report_date - INTERVAL 12 MONTH AS DATE)),
ya AS (SELECT sd.*, CASE WHEN (SELECT count(increase) FROM yy) > 0 THEN yy.increase ELSE sd.score - lag(sd.score, 4) OVER (PARTITION BY sd.symbol ORDER BY sd.dt) END AS increase FROM sd JOIN yy USING (dt, symbol)),
yo AS (SELECT dt FROM ya GROUP BY 1 HAVING count(score) >= 5 AND count(increase) >= 5),
yl AS (SELECT dt, symbol, fwd, unnest(['score', 'increase']) AS factor, unnest([score, increase]) AS value FROM ya WHERE dt IN (SELECT dt FROM yo)),""" + _cleaned("yz", "yl", "dt, symbol, fwd") + ",\nyv AS (SELECT dt, symbol, fwd, factor, z AS value FROM yz)," + _icir("yw", "yv")
    return with_(ctes, f"SELECT dt, symbol, {r6('sum(value * weight) / nullif(sum(weight), 0)', 'value')} FROM yv JOIN yw USING (dt, factor) WHERE value IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2")


_FIRST = """
alldates AS (SELECT 'market' AS "table", dt FROM bm WHERE symbol <> 3 UNION ALL SELECT 'etf', dt FROM bm WHERE symbol <= 3 AND symbol <> 3 UNION ALL SELECT 'fundamental', report_date FROM qs WHERE symbol <> 3
  UNION ALL SELECT 'alpha158', dt FROM bmg WHERE symbol <> 3 UNION ALL SELECT 'statement', dt FROM qs WHERE symbol <> 3 UNION ALL SELECT 'macro', dt FROM (SELECT DISTINCT CAST(ts AS DATE) AS dt, event_type FROM events)
  UNION ALL SELECT 'sp500_constituents', quarter FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY revenue DESC, symbol) AS k FROM qs) WHERE k <= 5),
firsts AS (SELECT "table", min(dt) AS first FROM alldates GROUP BY 1)"""
_LABELLED = (
    WEIGHTS
    + """,
lb AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY fwd DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY fwd, symbol) AS d FROM fac WHERE fwd IS NOT NULL),
sup AS (SELECT dt, symbol, m1, m3, spread, CAST(vol AS DOUBLE) AS vol, CASE WHEN u <= floor(n * 0.3) THEN 1 ELSE -1 END AS label FROM lb
  WHERE n >= 30 AND (u <= floor(n * 0.3) OR d <= floor(n * 0.3)) AND m1 IS NOT NULL AND m3 IS NOT NULL AND spread IS NOT NULL AND vol IS NOT NULL)"""
)
#: The simulator as a recursion over events: of each date the sales (q = 0), then its purchases one by one.
_RECURSIVE = (
    "WITH RECURSIVE "
    + BM
    + """,
sg AS (SELECT dt, symbol, close, volume, close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS s FROM bmg),
pk AS (SELECT dt, symbol, row_number() OVER (PARTITION BY dt ORDER BY s DESC, symbol) AS n FROM sg WHERE s > 0 AND close IS NOT NULL AND volume > 0),
k AS (SELECT dt, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY dt) AS w FROM pk WHERE n <= 5),
gl AS (SELECT g.dt, CAST(g.symbol AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY g.dt ORDER BY CAST(g.symbol AS VARCHAR)) AS j, last_value(ln(g.close) IGNORE NULLS) OVER w AS p, coalesce(lag(coalesce(k.w, 0)) OVER w, 0) AS w
  FROM bmg g LEFT JOIN k ON k.dt = g.dt AND k.symbol = g.symbol WINDOW w AS (PARTITION BY g.symbol ORDER BY g.dt)),
days AS (SELECT dt, list(coalesce(p, 0) ORDER BY j) AS prices, list(w ORDER BY j) AS weights, list(symbol ORDER BY j) AS names FROM gl GROUP BY 1),
ev AS (SELECT row_number() OVER (ORDER BY dt, q) - 1 AS e, * FROM (
  SELECT dt, 0 AS q, 0 AS j FROM days UNION ALL SELECT dt, row_number() OVER (PARTITION BY dt ORDER BY w DESC, j) AS q, j FROM gl WHERE w > 0)),
st AS (
  SELECT -1::BIGINT AS e, DATE '1900-01-01' AS dt, 1e6::DOUBLE AS cash, list_transform(prices, lambda x: 0.0::DOUBLE) AS sh, list_transform(prices, lambda x: 0.0::DOUBLE) AS goal, 0.0::DOUBLE AS before, 0.0::DOUBLE AS notional, 0.0::DOUBLE AS bought, 0.0::DOUBLE AS sold
  FROM (SELECT * FROM days ORDER BY dt LIMIT 1)
  UNION ALL
  SELECT e, dt, CASE WHEN q = 0 THEN cash + list_dot_product(list_transform(sh, lambda x, i: greatest(x - goal[i], 0)), prices) * 0.998 ELSE cash - qty * prices[j] * 1.002 END,
    CASE WHEN q = 0 THEN list_transform(sh, lambda x, i: least(x, goal[i])) ELSE list_transform(sh, lambda x, i: CASE WHEN i = j THEN x + qty ELSE x END) END, goal, before,
    CASE WHEN q = 0 THEN list_dot_product(list_transform(sh, lambda x, i: greatest(x - goal[i], 0)), prices) ELSE notional + qty * prices[j] END,
    CASE WHEN q = 0 THEN 0 ELSE bought + qty END, CASE WHEN q = 0 THEN list_sum(list_transform(sh, lambda x, i: greatest(x - goal[i], 0))) ELSE sold END
  FROM (SELECT *, CASE WHEN q > 0 THEN greatest(least(goal[j] - sh[j], floor(cash / (prices[j] * 1.002))), 0) END AS qty
    FROM (SELECT ev.e, ev.dt, ev.q, ev.j, d.prices, st.cash, st.sh, st.bought, st.sold, st.notional, CASE WHEN ev.q = 0 THEN st.cash + list_dot_product(st.sh, d.prices) ELSE st.before END AS before,
        CASE WHEN ev.q = 0 THEN list_transform(d.weights, lambda w, i: CASE WHEN w > 0 AND d.prices[i] > 0 THEN floor((st.cash + list_dot_product(st.sh, d.prices)) * w / (d.prices[i] * 1.002)) ELSE 0 END) ELSE st.goal END AS goal
      FROM st JOIN ev ON ev.e = st.e + 1 JOIN days d ON d.dt = ev.dt))),
fin AS (SELECT st.*, d.prices, d.names FROM st JOIN days d USING (dt) QUALIFY row_number() OVER (PARTITION BY dt ORDER BY e DESC) = 1)
"""
)

ORACLES: dict[str, str] = {
    "panel_monthly_bars": with_(BM, f"SELECT dt, symbol, {r6('open', 'open')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('close', 'close')}, volume, round(amount, 2) AS amount FROM bm"),
    "scan_filtered": with_(BM, f"SELECT dt, symbol, {r6('close', 'close')} FROM bm WHERE dt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND symbol IN (1, 2, 3, 4, 5) AND symbol NOT IN (3)"),
    "scan_symbols": "SELECT DISTINCT l_suppkey AS symbol FROM lineitem",
    "scan_statements_delayed": with_(QS, f"SELECT symbol, dt, report_date, round(revenue, 2) AS revenue, round(net_income, 2) AS net_income FROM qs WHERE dt >= DATE '1999-01-01'"),
    "dense_grid": with_(BM, f"SELECT dt, symbol, CAST(i AS INT) AS i, {r6('close', 'close')} FROM bmg"),
    "ic_series_rank": with_(IC, f"SELECT dt, {r6('ic', 'ic')} FROM ic"),
    "ic_series_pearson": with_(PAIRS, f"SELECT dt, {r6('CASE WHEN count(*) >= 3 THEN ' + corr('factor', 'fwd_ret') + ' END', 'ic')} FROM pairs GROUP BY 1"),
    "ic_summary": with_(IC, f"SELECT {r6('avg(ic)', 'ic_mean')}, {r6('stddev_samp(ic)', 'ic_std')}, {r6('avg(ic) / stddev_samp(ic) * sqrt(252 / 21.0)', 'icir')}, {r6('avg(ic) * sqrt(count(ic)) / stddev_samp(ic)', 't_stat')}, {r6('sum(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) / count(*)', 'positive_ratio')}, count(ic) AS n FROM ic"),
    "yearly_ic": with_(IC, f"SELECT CAST(year(dt) AS INT) AS year, {r6('avg(ic)', 'ic_mean')}, {r6('stddev_samp(ic)', 'ic_std')}, {r6('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, {r6('sum(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) / count(*)', 'positive_ratio')}, count(*) AS n FROM ic WHERE ic IS NOT NULL GROUP BY 1"),
    "ic_decay": with_(
        PAIRS + f""",
lagged AS (SELECT dt, factor, k, r FROM (SELECT dt, factor, {', '.join(f'lead(fwd_ret, {k}) OVER w AS r{k}' for k in range(6))} FROM pairs0 {_WS}), LATERAL (SELECT unnest(range(0, 6)) AS k, unnest([{', '.join(f'r{k}' for k in range(6))}]) AS r) WHERE factor IS NOT NULL AND r IS NOT NULL),
lr AS (SELECT dt, k, {rank('factor', 'dt, k')} AS a, {rank('r', 'dt, k')} AS b FROM lagged),
li2 AS (SELECT dt, k, CASE WHEN count(*) >= 3 THEN {corr('a', 'b')} END AS ic FROM lr GROUP BY 1, 2)""",
        f"SELECT CAST(k + 1 AS INT) AS lag, {r6('avg(ic)', 'ic')} FROM li2 GROUP BY 1",
    ),
    "forward_returns": with_(BM, "SELECT dt, symbol, " + ", ".join(r6(f"lead(close, {1 + p}) OVER w / nullif(lead(close, 1) OVER w, 0) - 1", f"fwd_{p}") for p in (1, 5)) + f" FROM bmg {_WS}"),
    "rebalance_returns": with_(
        BM + """,
sig AS (SELECT DISTINCT dt FROM bm WHERE month(dt) IN (1, 4, 7, 10)), plan AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS exit_dt FROM sig),
ent AS (SELECT p.*, (SELECT min(b.dt) FROM bm b WHERE b.dt > p.dt) AS next_dt FROM plan p WHERE exit_dt IS NOT NULL)""",
        f"SELECT e.dt, a.symbol, {r6('b.close / nullif(a.open, 0) - 1', 'fwd_ret')} FROM ent e JOIN bm a ON a.dt = e.next_dt JOIN bm b ON b.dt = e.exit_dt AND b.symbol = a.symbol",
    ),
    "layers": with_(LAYERS, f"SELECT dt, grp, {r6('ret', 'ret')} FROM layers"),
    "layer_summary": with_(LAYERS, f"SELECT grp, {r6('product(1 + ret) - 1', 'total')}, {r6('pow(product(1 + ret), 12.0 / count(ret)) - 1', 'annual')}, {r6('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 0)', 'sharpe')}, count(ret) AS n FROM damped GROUP BY 1"),
    "layer_spreads": with_(LAYERS, f"SELECT dt, {r6('max(CASE WHEN grp = 5 THEN ret END)', 'top')}, {r6('-max(CASE WHEN grp = 1 THEN ret END)', 'short')}, {r6('max(CASE WHEN grp = 5 THEN ret END) - avg(ret)', 'excess')} FROM layers GROUP BY 1"),
    "layer_extremes": with_(
        LAYERS + """,
spx AS (SELECT dt, max(CASE WHEN grp = 5 THEN ret END) AS top, -max(CASE WHEN grp = 1 THEN ret END) AS short, max(CASE WHEN grp = 5 THEN ret END) - avg(ret) AS excess FROM damped GROUP BY 1),
wl AS (SELECT dt, product(1 + top) OVER w AS a, product(1 + short) OVER w AS b, product(1 + excess) OVER w AS c, excess FROM spx WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)),
wd AS (SELECT excess, a / max(a) OVER w - 1 AS a, b / max(b) OVER w - 1 AS b, c / max(c) OVER w - 1 AS c FROM wl WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)),
wr AS (SELECT min(a) AS a, min(b) AS b, min(c) AS c, pow(product(1 + excess), 12.0 / count(excess)) - 1 AS y FROM wd)""",
        f"SELECT {r6('a', 'long_drawdown')}, {r6('b', 'short_drawdown')}, {r6('y', 'excess_annual')}, {r6('c', 'excess_drawdown')}, {r6('CASE WHEN c < 0 THEN y / abs(c) ELSE 0 END', 'excess_calmar')} FROM wr",
    ),
    "rolling_ic": with_(IC, f"SELECT dt, {r6('CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w END', 'ic')} FROM ic WINDOW w AS (ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
    "pct_change_padded": with_(BM + ", ff AS (SELECT dt, symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt) AS c FROM bmg)", f"SELECT dt, symbol, {r6('c / nullif(lag(c, 3) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1', 'change')} FROM ff"),
    "volatility_20": with_(DERIVED, f"SELECT dt, symbol, {r6(_agg(20, 'stddev_samp', 'ret'), 'value')} FROM d"),
    "highlow_spread_20": with_(DERIVED + ", hs AS (SELECT dt, symbol, (high - low) / nullif(close, 0) AS s FROM bwg)", f"SELECT dt, symbol, {r6(_agg(20, 'avg', 's'), 'value')} FROM hs"),
    "rebalance_records": _RECURSIVE
    + f"""SELECT dt, symbol, CASE WHEN diff < 0 THEN 'sell' ELSE 'buy' END AS action, abs(diff) AS shares, {r6('p', 'price')}, round(abs(diff) * p, 2) AS notional
FROM (SELECT s.dt, unnest(d.names) AS symbol, unnest(list_transform(s.sh, lambda x, i: x - s.psh[i])) AS diff, unnest(d.prices) AS p FROM (SELECT *, lag(sh) OVER (ORDER BY e) AS psh FROM st) s JOIN days d ON d.dt = s.dt WHERE s.e >= 0) WHERE diff <> 0""",
    "drawdown": with_(SERIES + ", s AS (SELECT dt, product(1 + ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS wealth FROM ser)", f"SELECT dt, {r6('wealth', 'wealth')}, {r6('wealth / max(wealth) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1', 'drawdown')} FROM s"),
    "turnover": with_(
        TOP + """,
ds AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS prev FROM (SELECT DISTINCT dt FROM pairs0)),
ch AS (SELECT dt, symbol, w FROM held UNION ALL SELECT ds.dt, h.symbol, -h.w FROM held h JOIN ds ON ds.prev = h.dt),
mv AS (SELECT dt, sum(abs(w)) / 2 AS t FROM (SELECT dt, symbol, sum(w) AS w FROM ch GROUP BY 1, 2) GROUP BY 1)""",
        f"SELECT ds.dt, {r6('CASE WHEN prev IS NULL THEN 0 ELSE coalesce(t, 0) END', 'turnover')} FROM ds LEFT JOIN mv ON mv.dt = ds.dt",
    ),
    "top_holdings": with_(TOP, "SELECT dt, string_agg(CAST(symbol AS VARCHAR), ', ' ORDER BY factor DESC, symbol) AS symbols FROM held GROUP BY 1"),
    "features_kline": with_(BM, f"SELECT dt, symbol, {', '.join(_KSQL)} FROM bmg"),
    "features_price": with_(BM, f"SELECT dt, symbol, {', '.join(_PRICE)} FROM bmg"),
    **{f"rolling_{p}": with_(DERIVED, f"SELECT dt, symbol, {', '.join(r6(f(n), f'{p}{n}') for n in (5, 10, 20, 30, 60))} FROM d") for p, f in ROLLING.items()},
    "features_all_158": with_(DERIVED, f"SELECT dt, symbol, {', '.join(_KSQL + _PRICE)}, {', '.join(r6(f(n), f'alpha158_{p}{n}') for p, f in ROLLING.items() for n in (5, 10, 20, 30, 60))} FROM d"),
    **{f"momentum_{n}": with_(BM, f"SELECT dt, symbol, {r6(f'close / nullif(lag(close, {n}) OVER w, 0) - 1', 'value')} FROM bmg {_WS}") for n in (5, 10, 20)},
    **{
        f"resample_{rule}": with_(
            BW + f""",
pp AS (SELECT *, {key} AS period FROM bw),
ag AS (SELECT symbol, period, max(dt) AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume FROM pp GROUP BY 1, 2)""",
            f"SELECT a.period, a.symbol, a.dt, {r6('open', 'open')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('close', 'close')}, volume FROM ag a JOIN (SELECT period, max(dt) AS e FROM ag GROUP BY 1) x ON x.period = a.period AND a.dt = x.e",
        )
        for rule, key in (("month", "strftime(dt, '%Y-%m')"), ("half_month", "strftime(dt, '%Y-%m') || CASE WHEN day(dt) > 15 THEN '-H2' ELSE '-H1' END"))
    },
    "as_of_statements": with_(BM + "," + QS, "SELECT g.dt, g.symbol, q.report_date, round(q.net_income, 2) AS net_income FROM bmg g ASOF LEFT JOIN qs q ON q.symbol = g.symbol AND q.dt <= g.dt"),
    "trailing_dividends": with_(
        BM + ", ev AS (SELECT CAST(l_shipdate AS DATE) AS dt, l_suppkey AS symbol, sum(l_extendedprice * l_discount) AS dividend FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)",
        "SELECT g.dt, g.symbol, round(sum(abs(e.dividend)) + 3.1e-5, 2) AS ttm FROM bmg g LEFT JOIN ev e ON e.symbol = g.symbol AND e.dt <= g.dt AND e.dt > g.dt - INTERVAL 365 DAY GROUP BY 1, 2",
    ),
    "upsert_keep_last": with_(BM, f"SELECT dt, symbol, {r6('CASE WHEN dt >= DATE ' + chr(39) + '2000-01-01' + chr(39) + ' THEN close * 2 ELSE close END', 'close')} FROM bm"),
    "universe_active": "SELECT symbol FROM (SELECT l_suppkey AS symbol, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1) WHERE a <= DATE '1995-02-01' AND b >= DATE '1995-01-10'",
    "universe_pending_anti": "SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-05')",
    "membership_as_of": with_(
        QS + ", snap AS (SELECT quarter AS dt, symbol FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY revenue DESC, symbol) AS n FROM qs) WHERE n <= 5)",
        "SELECT DISTINCT symbol FROM snap WHERE dt IN (SELECT max(s.dt) FROM snap s JOIN (SELECT unnest([DATE '1996-05-05', DATE '1998-02-01', DATE '2000-11-11']) AS d) x ON s.dt <= x.d GROUP BY x.d)",
    ),
    "winsor_zscore": with_(
        CAPPED + ", q AS (SELECT dt, quantile_cont(factor, 0.01) AS lo, quantile_cont(factor, 0.99) AS hi FROM cap GROUP BY 1), x AS (SELECT c.dt, symbol, CASE WHEN factor IS NOT NULL THEN greatest(least(factor, hi), lo) END AS v FROM cap c JOIN q ON q.dt = c.dt), y AS (SELECT dt, symbol, coalesce(v, median(v) OVER (PARTITION BY dt)) AS v FROM x)",
        f"SELECT dt, symbol, {r6('(v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0)', 'z')} FROM y WINDOW p AS (PARTITION BY dt)",
    ),
    "mad_winsor": with_(
        CAPPED + ", m AS (SELECT dt, median(factor) AS med FROM cap GROUP BY 1), a AS (SELECT c.dt, median(abs(factor - med)) AS mad FROM cap c JOIN m ON m.dt = c.dt GROUP BY 1)",
        f"SELECT c.dt, symbol, {r6('CASE WHEN factor IS NULL THEN NULL WHEN mad > 0 THEN greatest(least(factor, med + 5 * mad), med - 5 * mad) ELSE factor END', 'factor')} FROM cap c JOIN m ON m.dt = c.dt JOIN a ON a.dt = c.dt",
    ),
    "size_neutral": with_(
        CAPPED + ", ok AS (SELECT * FROM cap WHERE factor IS NOT NULL AND size IS NOT NULL), f AS (SELECT dt, avg(factor) AS my, avg(size) AS ms, coalesce(covar_samp(factor, size) / nullif(var_samp(size), 0), 0) AS b, count(*) AS n FROM ok GROUP BY 1)",
        f"SELECT c.dt, c.symbol, {r6('CASE WHEN n >= 3 AND c.size IS NOT NULL THEN (c.factor - my) - b * (c.size - ms) END', 'resid')} FROM cap c LEFT JOIN f ON f.dt = c.dt",
    ),
    "industry_neutral": with_(
        CAPPED + """,
ind AS (SELECT s_suppkey AS symbol, r_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ok AS (SELECT c.dt, c.symbol, factor AS y, size AS s, industry FROM cap c JOIN ind USING (symbol) WHERE factor IS NOT NULL AND size IS NOT NULL),
dm AS (SELECT *, y - avg(y) OVER g AS ry, s - avg(s) OVER g AS rs FROM ok WINDOW g AS (PARTITION BY dt, industry)),
sl AS (SELECT dt, coalesce(sum(ry * rs) / nullif(sum(rs * rs), 0), 0) AS b, count(*) AS n, count(DISTINCT industry) + 1 AS p, avg(y) AS my FROM dm GROUP BY 1)""",
        f"SELECT dm.dt, symbol, {r6('CASE WHEN n < 3 THEN NULL WHEN n <= p THEN y - my ELSE ry - b * rs END', 'resid')} FROM dm JOIN sl ON sl.dt = dm.dt",
    ),
    "valid_dates": with_(WEIGHTS, "SELECT dt FROM fac GROUP BY 1 HAVING count(m1) >= 5 AND count(m3) >= 5 AND count(spread) >= 5 AND count(vol) >= 5"),
    "factor_rank_ic": with_(WEIGHTS, f"SELECT dt, factor, {r6('ic', 'ic')} FROM fic"),
    "rank_icir_weights": with_(WEIGHTS, f"SELECT dt, factor, {r6('weight', 'weight')} FROM wt"),
    "combined_score": with_(WEIGHTS, f"SELECT l.dt, l.symbol, {r6('sum(value * weight) / nullif(sum(weight), 0)', 'score')} FROM lng l JOIN wt ON wt.dt = l.dt AND wt.factor = l.factor WHERE weight IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"),
    "long_short_return": with_(
        PAIRS + ", n AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY factor DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY factor, symbol) AS d FROM pairs)",
        f"SELECT dt, {r6('avg(CASE WHEN u <= greatest(1, floor(n * 0.2)) THEN fwd_ret END) - avg(CASE WHEN d <= greatest(1, floor(n * 0.2)) THEN fwd_ret END)', 'long_short')} FROM n WHERE n >= 5 GROUP BY 1",
    ),
    "quantile_spread": with_(
        PAIRS + ", q AS (SELECT dt, quantile_cont(factor, 0.3) AS lo, quantile_cont(factor, 0.7) AS hi FROM pairs GROUP BY 1)",
        f"SELECT p.dt, {r6('CASE WHEN count(*) >= 2 THEN avg(CASE WHEN factor >= hi THEN fwd_ret END) - avg(CASE WHEN factor <= lo THEN fwd_ret END) END', 'spread')} FROM pairs p JOIN q ON q.dt = p.dt GROUP BY 1",
    ),
    "capm_beta": with_(
        BM + f""",
cc AS (SELECT dt, symbol, {_RET} AS r, last_value(amount IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cap FROM bmg {_WS}),
mk AS (SELECT dt, sum(CASE WHEN cap > 0 THEN r * cap END) / nullif(sum(CASE WHEN r IS NOT NULL AND cap > 0 THEN cap END), 0) AS mkt FROM cc GROUP BY 1),
j AS (SELECT cc.dt, symbol, CASE WHEN mkt IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN mkt END AS m, mkt FROM cc JOIN mk ON mk.dt = cc.dt),
b AS (SELECT dt, symbol, CASE WHEN count(r) OVER x >= 12 THEN covar_samp(r, m) OVER x END / nullif(CASE WHEN count(mkt) OVER x >= 12 THEN var_samp(mkt) OVER x END, 0) AS v FROM j WINDOW x AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
        f"SELECT dt, symbol, {r6('CASE WHEN v IS NOT NULL THEN greatest(least(v, 3), -3) END', 'value')} FROM b",
    ),
    "quality_subfactors": with_(QUALITY, "SELECT symbol, dt, report_date, " + ", ".join(r6(c, c) for c in ("roeq", "roaq", "gpoaq", "gmarq", "droeq", "droaq", "dgpoaq", "dgmarq")) + " FROM ql"),
    "quality_increase": with_(QUALITY, f"SELECT dt, symbol, {r6('roeq - lag(roeq, 4) OVER w', 'increase')} FROM ql {_WS}"),
    "top_k_weights": with_(
        BM + """,
sg AS (SELECT dt, symbol, close, volume, close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS s FROM bmg),
pk AS (SELECT dt, symbol, row_number() OVER (PARTITION BY dt ORDER BY s DESC, symbol) AS n FROM sg WHERE s > 0 AND close IS NOT NULL AND volume > 0),
k AS (SELECT dt, symbol, 1.0 / count(*) OVER (PARTITION BY dt) AS w FROM pk WHERE n <= 5)""",
        f"SELECT g.dt, g.symbol, {r6('coalesce(k.w, 0)', 'weight')} FROM bmg g LEFT JOIN k ON k.dt = g.dt AND k.symbol = g.symbol",
    ),
    "execution_simulation": _RECURSIVE
    + f"""SELECT dt, round(cash + list_dot_product(sh, prices), 2) AS equity, round(cash, 2) AS cash, {r6('(cash + list_dot_product(sh, prices)) / 1e6', 'nav')},
  {r6('(cash + list_dot_product(sh, prices)) / coalesce(lag(cash + list_dot_product(sh, prices)) OVER (ORDER BY dt), 1e6) - 1', 'ret')}, {r6('notional / before', 'turnover')},
  round(notional, 2) AS notional, round(notional * 0.001, 2) AS commission, round(notional * 0.001, 2) AS slippage, round(notional * 0.002, 2) AS cost, bought, sold FROM fin""",
    "execution_positions": _RECURSIVE
    + f"""SELECT dt, symbol, shares, {r6('shares * p / (cash + list_dot_product(sh, prices))', 'weight')}
FROM (SELECT dt, cash, sh, prices, unnest(names) AS symbol, unnest(sh) AS shares, unnest(prices) AS p FROM fin) WHERE shares <> 0""",
    "timing_nav": with_(_TIMING, f"SELECT symbol, dt, {r6('ret', 'ret')}, {r6('product(1 + ret) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)', 'nav')} FROM ts"),
    "benchmark_nav": with_(
        BW + ", bc AS (SELECT dt, ln(arg_min(close, symbol)) AS close FROM bw GROUP BY 1)",
        f"SELECT dt, {r6('close / lag(close) OVER w - 1', 'ret')}, {r6('close / first_value(close) OVER w', 'nav')} FROM bc WINDOW w AS (ORDER BY dt)",
    ),
    "performance": with_(SERIES + "," + _perf("ser"), f"SELECT {_PERF_OUT} FROM pf"),
    "monthly_returns": with_(SERIES, f"SELECT CAST(year(dt) AS INT) AS year, CAST(month(dt) AS INT) AS month, {r6('product(1 + ret) - 1', 'ret')} FROM ser GROUP BY 1, 2"),
    "rolling_sharpe": with_(SERIES, f"SELECT dt, {r6('CASE WHEN count(ret) OVER x = 12 THEN avg(ret) OVER x / nullif(stddev_pop(ret) OVER x, 0) * sqrt(252) END', 'sharpe')} FROM ser WINDOW x AS (ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"),
    "benchmark_excess": with_(
        SERIES + ", one AS (SELECT dt, close / nullif(lag(close) OVER (ORDER BY dt), 0) - 1 AS r FROM bmg WHERE symbol = 1)",
        f"SELECT s.dt, {r6('s.ret - o.r', 'excess')} FROM ser s JOIN one o ON o.dt = s.dt",
    ),
    "ma_cross": with_(BW, "SELECT dt, symbol, coalesce(sign(CASE WHEN count(close) OVER f = 5 THEN avg(close) OVER f END - CASE WHEN count(close) OVER s = 20 THEN avg(close) OVER s END), 0)::DOUBLE AS signal FROM bw WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "rsi": with_(
        BW + """,
dd AS (SELECT dt, symbol, row_number() OVER w AS i, close - lag(close) OVER w AS d FROM bw WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
ew AS (SELECT a.dt, a.symbol, a.i, sum(greatest(b.d, 0) * pow(13 / 14.0::DOUBLE, a.i - b.i)) / sum(pow(13 / 14.0::DOUBLE, a.i - b.i)) AS g, sum(greatest(-b.d, 0) * pow(13 / 14.0::DOUBLE, a.i - b.i)) / sum(pow(13 / 14.0::DOUBLE, a.i - b.i)) AS l
  FROM dd a JOIN dd b ON a.symbol = b.symbol AND b.i <= a.i AND b.d IS NOT NULL GROUP BY 1, 2, 3),
rs AS (SELECT dd.dt, dd.symbol, CASE WHEN dd.i > 14 THEN 100 - 100 / (1 + CASE WHEN l = 0 THEN 0 ELSE g / l END) END AS rsi FROM dd LEFT JOIN ew ON ew.symbol = dd.symbol AND ew.dt = dd.dt)""",
        f"SELECT dt, symbol, {r6('rsi', 'rsi')}, CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -1.0 ELSE 0.0 END::DOUBLE AS signal FROM rs",
    ),
    "timing_summary": with_(
        _TIMING + """,
hit AS (SELECT symbol, avg(CASE WHEN s <> 0 AND r IS NOT NULL THEN CASE WHEN s = sign(r) THEN 1.0 ELSE 0.0 END END) AS direction_win_rate FROM ts GROUP BY 1),
one AS (SELECT dt, ln(close) / lag(ln(close)) OVER (ORDER BY dt) - 1 AS b FROM bw WHERE symbol = 3),
ex AS (SELECT symbol, dt, ret - b AS ret FROM ts JOIN one USING (dt) WHERE b IS NOT NULL),"""
        + _perf("ts", "symbol") + "," + _perf("ex", "symbol", "x"),
        f"SELECT pf.symbol, {r6('direction_win_rate', 'direction_win_rate')}, {_PERF_OUT}, {r6('ea', 'excess_annual')}, {r6('ec', 'excess_calmar')} FROM pf JOIN hit ON hit.symbol = pf.symbol LEFT JOIN (SELECT symbol, annual_return AS ea, calmar AS ec FROM xf WHERE n > 1) x ON x.symbol = pf.symbol",
    ),
    "class_labels": with_(
        PAIRS + ", n AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY fwd_ret DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY fwd_ret, symbol) AS d FROM pairs0 WHERE fwd_ret IS NOT NULL)",
        "SELECT dt, symbol, CASE WHEN u <= floor(n * 0.3) THEN 1 ELSE -1 END AS label FROM n WHERE n >= 30 AND (u <= floor(n * 0.3) OR d <= floor(n * 0.3))",
    ),
    "time_folds": with_(BM + ", d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM bm)), f AS (SELECT dt, k, n // 6 AS size, n - (n // 6) * 5 AS first FROM d)", "SELECT dt, CAST(CASE WHEN k < first THEN 0 ELSE (k - first) // size + 1 END AS INT) AS fold FROM f"),
    "event_bars": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS dt, event_type AS symbol, {r6('arg_min(value, (ts, event_id))', 'open')}, {r6('max(value)', 'high')}, {r6('min(value)', 'low')}, {r6('arg_max(value, (ts, event_id))', 'close')}, count(*) AS volume FROM events GROUP BY 1, 2",
    "composite_quality": _composite((*_PROFIT, *_GROWTH, "dividend_ratio"), False, True),
    "composite_quality_equal_weight": _composite((*_PROFIT, *_GROWTH, "dividend_ratio"), True, True),
    "composite_profitability": _composite(_PROFIT, False, False),
    "composite_growth": _composite(_GROWTH, False, False),
    "composite_members": _composite(_PROFIT, False, False, True),
    "three_factor_volatility": with_(
        BM + """,
rt AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS r FROM bmg),
mk AS (SELECT dt, sum(r * amount) / nullif(sum(amount), 0) AS mkt FROM rt WHERE r IS NOT NULL AND amount > 0 GROUP BY 1),
qz AS (SELECT *, quantile_cont(amount, 0.3) OVER d AS al, quantile_cont(amount, 0.7) OVER d AS ah, quantile_cont(volume, 0.3) OVER d AS vl, quantile_cont(volume, 0.7) OVER d AS vh FROM rt WHERE r IS NOT NULL AND amount IS NOT NULL AND volume IS NOT NULL WINDOW d AS (PARTITION BY dt)),
sp AS (SELECT dt, CASE WHEN count(*) >= 2 THEN -(avg(CASE WHEN amount >= ah THEN r END) - avg(CASE WHEN amount <= al THEN r END)) END AS smb, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN volume >= vh THEN r END) - avg(CASE WHEN volume <= vl THEN r END) END AS hml FROM qz GROUP BY 1),
jn AS (SELECT rt.dt, rt.symbol, r, mkt, smb, hml, r IS NOT NULL AND mkt IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AS ok FROM rt JOIN mk USING (dt) JOIN sp USING (dt)),
jo AS (SELECT dt, symbol, CASE WHEN ok THEN r END AS y, CASE WHEN ok THEN mkt END AS m, CASE WHEN ok THEN smb END AS s, CASE WHEN ok THEN hml END AS h FROM jn),
cv AS (SELECT dt, symbol, count(y) OVER w AS n, covar_samp(y, y) OVER w AS yy, covar_samp(y, m) OVER w AS ym, covar_samp(y, s) OVER w AS ys, covar_samp(y, h) OVER w AS yh, covar_samp(m, m) OVER w AS mm, covar_samp(m, s) OVER w AS ms,
  covar_samp(m, h) OVER w AS mh, covar_samp(s, s) OVER w AS ss, covar_samp(s, h) OVER w AS sh, covar_samp(h, h) OVER w AS hh FROM jo WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e1 AS (SELECT dt, symbol, n, yy - q * ym * ym AS yy, ys - q * ym * ms AS ys, yh - q * ym * mh AS yh, ss - q * ms * ms AS ss, sh - q * ms * mh AS sh, hh - q * mh * mh AS hh FROM (SELECT *, CASE WHEN mm > 1e-18 THEN 1 / mm ELSE 0 END AS q FROM cv)),
e2 AS (SELECT dt, symbol, n, yy - q * ys * ys AS yy, yh - q * ys * sh AS yh, hh - q * sh * sh AS hh FROM (SELECT *, CASE WHEN ss > 1e-18 THEN 1 / ss ELSE 0 END AS q FROM e1)),
e3 AS (SELECT dt, symbol, n, yy - q * yh * yh AS yy FROM (SELECT *, CASE WHEN hh > 1e-18 THEN 1 / hh ELSE 0 END AS q FROM e2))""",
        f"SELECT dt, symbol, {r6('CASE WHEN n = 20 THEN sqrt(greatest(yy, 0)) * sqrt(252.0) END', 'value')} FROM e3",
    ),
    "factor_rotation": with_(
        WEIGHTS + """,
rg AS (SELECT *, count(*) OVER f AS n, row_number() OVER (PARTITION BY dt, factor ORDER BY value DESC, symbol) AS u, row_number() OVER (PARTITION BY dt, factor ORDER BY value, symbol) AS d FROM lng WHERE fwd IS NOT NULL AND value IS NOT NULL WINDOW f AS (PARTITION BY dt, factor)),
rr0 AS (SELECT dt, factor, avg(CASE WHEN u <= greatest(1, floor(n * 0.2)) THEN fwd END) - avg(CASE WHEN d <= greatest(1, floor(n * 0.2)) THEN fwd END) AS ret FROM rg WHERE n >= 5 GROUP BY 1, 2),
rr AS (SELECT e.dt, e.factor, ret FROM (SELECT dt, unnest(['m1', 'm3', 'spread', 'vol']) AS factor FROM (SELECT DISTINCT dt FROM fac)) e LEFT JOIN rr0 ON rr0.dt = e.dt AND rr0.factor = e.factor),
rm AS (SELECT dt, factor, avg(ret) OVER (PARTITION BY factor ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS m FROM rr),
rk AS (SELECT dt, factor, m, count(m) OVER (PARTITION BY dt) AS k, row_number() OVER (PARTITION BY dt ORDER BY m DESC NULLS LAST, list_position(['m1', 'm3', 'spread', 'vol'], factor)) AS r FROM rm),
rw AS (SELECT dt, factor, CASE WHEN k >= 3 THEN CASE WHEN m IS NULL THEN 0 ELSE (k - r + 1) / (k * (k + 1) / 2.0) END ELSE 0.25 END AS weight FROM rk),
zq AS (SELECT dt, factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM lng GROUP BY 1, 2),
zc AS (SELECT l.dt, symbol, l.factor, greatest(least(value, hi), lo) AS v FROM lng l JOIN zq ON zq.dt = l.dt AND zq.factor = l.factor WHERE value IS NOT NULL),
zz AS (SELECT dt, symbol, factor, (v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0) AS z FROM zc WINDOW p AS (PARTITION BY dt, factor))""",
        f"SELECT zz.dt, symbol, {r6('sum(z * weight) / sum(weight)', 'value')} FROM zz JOIN rw ON rw.dt = zz.dt AND rw.factor = zz.factor WHERE weight > 0 AND z IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    ),
    "stale_symbols": with_(
        BM + ", have AS (SELECT symbol, max(dt) AS last_dt, count(*) AS n FROM bm GROUP BY 1)",
        "SELECT s_suppkey AS symbol, last_dt, coalesce(n, 0) AS n FROM supplier LEFT JOIN have ON have.symbol = s_suppkey WHERE last_dt IS NULL OR last_dt + 30 < DATE '2001-12-01'",
    ),
    "table_market": with_(BM, f"SELECT dt, CAST(symbol AS VARCHAR) AS symbol, {r6('close', 'close')}, {r6('close', 'adj_close')} FROM bm WHERE symbol IN (1, 2, 4) AND dt BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"),
    "table_etf": with_(BM, f"SELECT dt, CAST(symbol AS VARCHAR) AS symbol, {r6('close', 'close')} FROM bm WHERE symbol <= 3 AND symbol <> 3 AND dt >= DATE '1996-01-01'"),
    "table_fundamental": with_(QS, f"SELECT report_date AS dt, CAST(symbol AS VARCHAR) AS symbol, {r6('revenue / total_assets', 'ps')}, {r6('equity', 'market_cap')} FROM qs WHERE symbol <> 3 AND report_date <= DATE '2000-12-31'"),
    "table_alpha158": with_(BM, f"SELECT dt, CAST(symbol AS VARCHAR) AS symbol, {', '.join(_KSQL)} FROM bmg WHERE symbol <> 3 AND dt >= DATE '1998-01-01'"),
    "table_statement": with_(QS, "SELECT dt, CAST(symbol AS VARCHAR) AS symbol, report_date, round(revenue, 2) AS revenue, round(net_income, 2) AS net_income FROM qs WHERE symbol <> 3 AND dt BETWEEN DATE '1999-01-01' AND DATE '2000-03-31'"),
    "table_macro": f"SELECT CAST(ts AS DATE) AS dt, event_type AS series_id, CAST(min(ts) AS DATE) AS observation_date, {r6('max(value)', 'value')}, 'unit' AS units FROM events GROUP BY 1, 2",
    "table_constituents": with_(QS, "SELECT quarter AS dt, CAST(symbol AS VARCHAR) AS symbol, CASE WHEN k > 1 THEN quarter END AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY revenue DESC, symbol) AS k FROM qs) WHERE k <= 5 AND quarter >= DATE '1997-01-01'"),
    "table_industry": "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey IN (1, 2, 3)",
    "preload_ranges": with_(BM + "," + QS + "," + _FIRST, "SELECT \"table\", greatest(first, DATE '1995-03-15') AS first, DATE '1996-03-14' AS last FROM firsts WHERE greatest(first, DATE '1995-03-15') <= DATE '1996-03-14'"),
    "preload_rows": with_(BM + "," + QS + "," + _FIRST, "SELECT \"table\", count(dt) AS n, min(dt) AS first, max(dt) AS last FROM (SELECT DISTINCT \"table\" FROM alldates) LEFT JOIN (SELECT * FROM alldates WHERE dt >= DATE '1995-03-15' AND dt < DATE '1996-03-15') USING (\"table\") GROUP BY 1"),
    "report_rows": with_(QS, "SELECT CAST(symbol AS VARCHAR) AS symbol, report_date, CASE WHEN symbol % 5 <> 0 THEN report_date END AS filing_date, round(revenue, 2) AS revenue, CASE WHEN net_income > 1e6 THEN NULL ELSE round(net_income, 2) END AS net_income FROM qs"),
    "month_end_panel": with_(BW, f"SELECT dt, symbol, {r6('close', 'close')} FROM bwg WHERE dt IN (SELECT max(dt) FROM bw GROUP BY date_trunc('month', dt))"),
    "forward_excess": with_(
        BM + ", l AS (SELECT dt, symbol, ln(close) AS c FROM bm WHERE month(dt) IN (1, 4, 7, 10)), nx AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nd FROM (SELECT DISTINCT dt FROM l)), fw AS (SELECT l.dt, l.symbol, n.c / l.c - 1 AS r FROM l JOIN nx USING (dt) LEFT JOIN l n ON n.dt = nx.nd AND n.symbol = l.symbol)",
        f"SELECT f.dt, f.symbol, {r6('f.r', 'fwd_ret')}, {r6('f.r - b.r', 'excess')} FROM fw f LEFT JOIN fw b ON b.dt = f.dt AND b.symbol = 1",
    ),
    "supervised_set": with_(_LABELLED, f"SELECT dt, symbol, {', '.join(r6(c, c) for c in ('m1', 'm3', 'spread', 'vol'))}, label FROM sup"),
    "classifier_figures": with_(
        _LABELLED + ", rk AS (SELECT label, rank() OVER (ORDER BY m3 - 1) + (count(*) OVER (PARTITION BY m3 - 1) - 1) / 2.0 AS r, m3 - 1 AS score FROM sup)",
        f"SELECT {r6('(sum(CASE WHEN label = 1 THEN r END) - count(CASE WHEN label = 1 THEN 1 END) * (count(CASE WHEN label = 1 THEN 1 END) + 1) / 2.0) / nullif(count(CASE WHEN label = 1 THEN 1 END) * count(CASE WHEN label = -1 THEN 1 END), 0)', 'auc')}, {r6('avg(CASE WHEN (score > 0) = (label = 1) THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(CASE WHEN label = 1 THEN 1 END) AS positive_count, count(CASE WHEN label = -1 THEN 1 END) AS negative_count, count(*) AS sample_count FROM rk",
    ),
    "complete_dates": with_(QUALITY, "SELECT dt, symbol FROM ql WHERE dt NOT IN (SELECT dt FROM ql WHERE roeq IS NULL OR droeq IS NULL)"),
    "symbol_codes": """
WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM part),
m AS (SELECT *, CASE WHEN code[1] = '6' THEN 'SH' WHEN code[1] IN ('4', '8') THEN 'BJ' ELSE 'SZ' END AS mkt FROM c)
SELECT p_partkey, code || '.' || mkt AS suffixed, lower(mkt) || '.' || code AS prefixed FROM m""",
    "benchmark_forward": with_(
        BW + ", st AS (SELECT dt, symbol, coalesce(lead(l, 2) OVER w / nullif(lead(l, 1) OVER w, 0) - 1, 0) AS r FROM (SELECT dt, symbol, ln(close) AS l FROM bw) WINDOW w AS (PARTITION BY symbol ORDER BY dt))",
        f"SELECT dt, symbol, {r6('product(1 + r) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1', 'total')} FROM st",
    ),
}
