"""The catalogue's queries as SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np

EMB = "emb2d AS (SELECT vec_id AS baseline, CAST(g.i AS INTEGER) - 1 AS channel, CAST(embedding[g.i] AS DOUBLE) AS value FROM embeddings, range(1, 65) g(i))"
EMBC = "embc AS (SELECT vec_id AS baseline, CAST(g.i AS INTEGER) AS channel, CAST(embedding[2 * g.i + 1] AS DOUBLE) AS re, CAST(embedding[2 * g.i + 2] AS DOUBLE) AS im FROM embeddings, range(0, 32) g(i))"
EV = """ev_cells AS (SELECT event_type AS baseline, CAST(floor((floor(epoch(ts)) - 1704067200) / 86400) AS INTEGER) AS time,
 CAST(floor(((floor(epoch(ts)) - 1704067200) % 86400) / 1800) AS INTEGER) AS channel, avg(value) AS m FROM events GROUP BY 1, 2, 3),
ev3d AS (SELECT b.baseline, CAST(t.i AS INTEGER) AS time, CAST(c.i AS INTEGER) AS channel, coalesce(e.m, 0.0) AS value, e.m IS NULL AS flag
 FROM (SELECT DISTINCT baseline FROM ev_cells) b CROSS JOIN range(0, 30) t(i) CROSS JOIN range(0, 48) c(i)
 LEFT JOIN ev_cells e ON e.baseline = b.baseline AND e.time = t.i AND e.channel = c.i)"""
MAD = 1.4826


def r6(x: str) -> str:
    """Six digits; the small shift takes exact halves, which engines round either way, off the border."""
    return f"round(({x}) + 1e-9, 6) + 0.0"


FILL = "SELECT CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, 3735928559 AS value FROM range(0, 75) r(i), range(0, 63) c(i)"
ZERO = f"WITH {EMB} SELECT baseline AS row, channel AS col, CAST(0 AS DOUBLE) AS value FROM emb2d"
KERNEL = f"WITH {EMB} SELECT baseline, channel, {r6('sum(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, value))) OVER (PARTITION BY baseline ORDER BY channel)')} AS value FROM emb2d"
ONES = f"WITH {EMB} SELECT baseline AS row, channel AS col, CAST(1 AS DOUBLE) AS value FROM emb2d"
SCALE = f"WITH {EMB} SELECT baseline AS row, channel AS col, {r6('value * 3.0::DOUBLE')} AS value FROM emb2d"
TRANSPOSE = f"WITH {EMB} SELECT channel AS row, CAST(baseline AS INTEGER) AS col, {r6('value')} AS value FROM emb2d"
REGION_READ = f"WITH {EMB} SELECT CAST((baseline - 10) // 3 AS BIGINT) AS row, CAST((channel - 5) // 2 AS INTEGER) AS col, {r6('value')} AS value FROM emb2d WHERE baseline >= 10 AND baseline < 200 AND (baseline - 10) % 3 = 0 AND channel >= 5 AND channel < 60 AND (channel - 5) % 2 = 0"
REGION_COPY = f"""WITH {EMB} SELECT baseline AS row, channel AS col, {r6('value')} AS value FROM emb2d WHERE baseline < 100 OR baseline >= 150 OR channel < 8 OR channel >= 28
UNION ALL SELECT baseline + 100 AS row, channel // 2 + 8 AS col, {r6('-value')} AS value FROM emb2d WHERE baseline < 50 AND channel < 40 AND channel % 2 = 0"""
TRANSPOSE_VECTORS = f"WITH {EMB} SELECT channel, CAST(count(*) AS INTEGER) AS n, max(baseline) AS last, {r6('list(value ORDER BY baseline)[1]')} AS first_value, {r6('sum(value * (baseline % 11))')} AS weighted FROM emb2d GROUP BY 1"
REGION_WRITE = f"""WITH {EMB} SELECT baseline AS row, channel AS col, {r6('CASE WHEN baseline >= 20 AND baseline < 80 AND (baseline - 20) % 2 = 0 AND channel >= 4 AND channel < 34 AND (channel - 4) % 3 = 0 THEN 1000 * ((baseline - 20) // 2) + (channel - 4) // 3 ELSE value END')} AS value FROM emb2d"""
REGION_PROFILE = f"WITH {EMB} SELECT CAST((channel - 2) // 5 AS INTEGER) AS col, CAST(0 AS INTEGER) AS pol, {r6('value')} AS value FROM emb2d WHERE baseline = 7 AND channel >= 2 AND channel < 60 AND (channel - 2) % 5 = 0"
FLAG_RATES = f"WITH {EV} SELECT baseline AS key, count(*) AS n, count(*) FILTER (flag) AS flagged, {r6('avg(CAST(flag AS INTEGER)) * 100')} AS percent FROM ev3d GROUP BY 1"
FLAG_RATE = f"WITH {EV} SELECT {r6('avg(CAST(flag AS INTEGER)) * 100')} AS percent FROM ev3d"
VECTORS = f"WITH {EMB} SELECT channel AS pos, {r6('sum(value)')} AS total, count(*) AS n FROM emb2d GROUP BY 1"


NPY_SCAN = f"WITH {EMB} SELECT CAST(channel AS BIGINT) AS channel, count(*) AS n, {r6('sum(value)')} AS total, {r6('max(abs(value))')} AS most FROM emb2d WHERE channel >= 8 AND channel < 40 GROUP BY 1"


def hreduce(op: str) -> str:
    f = {"sum": "CAST(sum(v) AS BIGINT)", "min": "min(v)", "max": "max(v)", "xor": "bit_xor(v)"}[op]
    return f"WITH {EMB} SELECT baseline AS row, {f} AS value FROM (SELECT baseline, CAST(round(value * 1000) AS BIGINT) AS v FROM emb2d WHERE channel >= 7 AND channel < 51) GROUP BY 1"


HREDUCE_PRODUCT = f"WITH {EMB} SELECT baseline AS row, {r6('product(1 + value / 10)')} AS value FROM emb2d WHERE channel < 16 GROUP BY 1"
HREDUCE_CUSTOM = f"WITH {EMB} SELECT baseline AS row, CAST(sum(CAST(round(abs(value) * 1000) AS BIGINT)) % 997 AS BIGINT) AS value FROM emb2d GROUP BY 1"
FILL_REDUCE = "SELECT CAST(i AS INTEGER) AS row, CAST(210 AS BIGINT) AS value FROM range(0, 40) r(i)"
BLOCK_SUM = f"WITH {EMB} SELECT CAST((baseline * 64 + channel) // 128 AS BIGINT) AS block, {r6('sum(value)')} AS value FROM emb2d GROUP BY 1"
MASKED_SUM = f"WITH {EMBC} SELECT channel AS col, {r6('sum((baseline % 4) / 2.0::DOUBLE * re)')} AS re, {r6('sum((baseline % 4) / 2.0::DOUBLE * im)')} AS im FROM embc GROUP BY 1"
MASKED_SUM_AMP = f"WITH {EMBC} SELECT channel AS col, {r6('sum((baseline % 4) / 2.0::DOUBLE * sqrt(re * re + im * im))')} AS value FROM embc GROUP BY 1"
MASKED_MONTHS = """SELECT l_returnflag || l_linestatus AS col, round(sum(CASE WHEN ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1) % 2 = 1 THEN l_extendedprice ELSE 0 END), 2) AS value
 FROM lineitem GROUP BY 1"""


def percentile5(value: str, table: str, where: str = "") -> str:
    pick = lambda k: r6(f"list_sort(list(v))[1 + CAST((count(*) - 1) * {k} // 4 AS INTEGER)]")
    return f"""WITH {EMB}, {EMBC} SELECT row, {pick(0)} AS min, {pick(4)} AS max, {pick(1)} AS q25, {pick(3)} AS q75, {pick(2)} AS q50
 FROM (SELECT baseline AS row, {value} AS v FROM {table} {where}) GROUP BY row"""


ORDER_STATISTIC = f"WITH {EMB} SELECT baseline AS row, {r6('(list_sort(list(value))[20] + list_sort(list(value))[21]) / 2')} AS value FROM emb2d GROUP BY 1"
PRICES = "list_sort(list(l_extendedprice))"
PRICE_QUANTILES = f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {PRICES}[1 + (count(*) - 1) // 4] AS q25, {PRICES}[1 + (count(*) - 1) // 2] AS q50, {PRICES}[1 + 99 * (count(*) - 1) // 100] AS q99, {PRICES}[count(*)] AS most
 FROM lineitem GROUP BY 1, 2"""
PRICE_MEDIANS = f"SELECT l_linestatus, {r6('median(l_extendedprice * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END))')} AS value FROM lineitem GROUP BY 1"
INTERVALS = """SELECT o_orderkey AS low, o_orderkey + 1 + (o_custkey * o_custkey) % 400 AS high, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
 FROM orders JOIN lineitem ON l_orderkey >= o_orderkey AND l_orderkey < o_orderkey + 1 + (o_custkey * o_custkey) % 400 WHERE o_orderkey % 5 = 0 GROUP BY 1, 2"""
RANKS = "SELECT p.i * 1000.0::DOUBLE AS point, CAST(count(o.o_totalprice) AS BIGINT) AS below FROM range(0, 500) p(i) LEFT JOIN orders o ON o.o_totalprice < p.i * 1000.0::DOUBLE GROUP BY 1"
RANK_HELPERS = f"""WITH {EMB}, m AS (SELECT baseline AS row, channel AS col, CASE WHEN channel % 7 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM emb2d)
SELECT row, count(*) FILTER (value < 0.05) AS below, count(*) FILTER (value = 0) AS zeros, {r6('greatest(coalesce(max(value) FILTER (value < 0.1), 0), 0)')} AS under,
 {r6('median(value) FILTER (value > 0)')} AS middle, {r6('min(value) FILTER (col % 5 <> 0)')} AS low, {r6('max(value) FILTER (col % 5 <> 0)')} AS high FROM m GROUP BY row"""
NEAREST = "SELECT min(p_brand) AS device_name, CAST(2 AS INTEGER) AS match_level FROM part"
UPSERT = """WITH s AS (SELECT p_brand AS device_name, CAST(p_size AS VARCHAR) AS device_version, count(*) AS value_n FROM part GROUP BY 1, 2)
SELECT device_name, device_version, CASE WHEN device_name < 'Brand#3' THEN -value_n ELSE value_n END AS value_n FROM s UNION ALL SELECT device_name || '/new', device_version, value_n FROM s"""
AMPLITUDE = f"WITH {EMBC} SELECT baseline, channel, {r6('sqrt(re * re + im * im)')} AS value FROM embc"


def _dev(width: int, flagged: str = "false", table: str = "emb2d", value: str = "value") -> str:
    return f"""{EMB}, {EMBC}, ok AS (SELECT baseline, channel, CASE WHEN NOT {flagged} THEN {value} END AS a FROM {table}),
dev AS (SELECT baseline, channel, coalesce(a - median(a) OVER (PARTITION BY baseline ORDER BY channel ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING), 0.0) AS dev FROM ok)"""


def background(width: int, flagged: str = "false", table: str = "emb2d", value: str = "value") -> str:
    return f"WITH {_dev(width, flagged, table, value)} SELECT baseline, channel, {r6('dev')} AS dev FROM dev"


_NOISE = f"noise AS (SELECT baseline, {MAD} * median(abs(dev)) FILTER (abs(dev) > 0) AS noise FROM dev GROUP BY 1)"
NOISE = f"WITH {_dev(13)}, {_NOISE} SELECT baseline, {r6('noise')} AS noise FROM noise"


def flag_simple(n_sigma: float, every: bool = False) -> str:
    where = "" if every else "WHERE flag <> 0"
    return f"""WITH {_dev(13)}, {_NOISE} SELECT * FROM (SELECT d.baseline, channel, CAST(coalesce(dev > {n_sigma}::DOUBLE * noise, false) AS INTEGER) AS flag
 FROM dev d JOIN noise n ON n.baseline = d.baseline) {where}"""


def flag_sum(n_sigma: float, n_windows: int, flag_value: int, flagged: str = "false", padded: int = 0) -> str:
    """padded: zeros lie beyond both ends of so many channels."""
    parts = [f"band AS (SELECT * FROM dev UNION ALL SELECT baseline, p.i, 0.0 FROM (SELECT DISTINCT baseline FROM dev), range(-16, {padded} + 16) p(i) WHERE p.i < 0 OR p.i >= {padded})"] if padded else []
    parts.append(f"s0 AS (SELECT d.baseline, channel, dev, {n_sigma}::DOUBLE * noise AS thr, false AS f FROM {'band' if padded else 'dev'} d JOIN noise n ON n.baseline = d.baseline)")
    for i in range(n_windows):
        w = 2**i
        parts.append(f"a{i} AS (SELECT baseline, channel, dev, thr, f, CAST(CAST(thr * {1.2**-i!r}::DOUBLE AS FLOAT) AS DOUBLE) AS t FROM s{i})")
        parts.append(f"b{i} AS (SELECT *, sum(CASE WHEN f THEN t ELSE dev END) OVER k AS s, count(*) OVER k AS n FROM a{i} WINDOW k AS (PARTITION BY baseline ORDER BY channel ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))")
        parts.append(f"s{i + 1} AS (SELECT baseline, channel, dev, thr, f OR bool_or(coalesce(n = {w} AND s > t * {w}, false)) OVER (PARTITION BY baseline ORDER BY channel ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS f FROM b{i})")
    return f"WITH {_dev(13, flagged)}, {_NOISE}, {', '.join(parts)} SELECT baseline, channel, CASE WHEN f THEN {flag_value} ELSE 0 END AS flag FROM s{n_windows}{f' WHERE channel BETWEEN 0 AND {padded - 1}' if padded else ''}"


def average_freq(factor: int, lost: str = "false") -> str:
    good = f"FILTER (NOT flag AND NOT ({lost}))"
    return f"""WITH {EV} SELECT baseline, time, CAST(channel // {factor} AS INTEGER) AS channel, {r6(f'coalesce(avg(abs(value)) {good}, 0.0)')} AS value,
 count(*) {good} = 0 AS flag FROM ev3d GROUP BY 1, 2, 3"""


TIME_MEDIAN = f"WITH {EV} SELECT baseline, channel, {r6('coalesce(median(value) FILTER (NOT flag), 0.0)')} AS value, count(*) FILTER (NOT flag) = 0 AS flag FROM ev3d GROUP BY 1, 2"


def median_abs(keys: list[str]) -> str:
    return f"WITH {EV} SELECT {', '.join(keys)}, {r6('median(abs(value)) FILTER (NOT flag)')} AS value FROM ev3d GROUP BY {', '.join(keys)}"


def _interpolated(source: str, column: str) -> str:
    """A table expression: ``source`` with the gaps of ``column`` filled along channel."""
    order = "PARTITION BY baseline, time ORDER BY channel"
    known = f"CASE WHEN {column} IS NOT NULL THEN channel END"
    left, right = (f"{f}({{}} IGNORE NULLS) OVER ({order} ROWS BETWEEN {frame})" for f, frame in (("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")))
    return f"""(SELECT * REPLACE (CASE WHEN {column} IS NOT NULL THEN {column} WHEN lx IS NULL AND rx IS NULL THEN 0.0 WHEN lx IS NULL THEN ry WHEN rx IS NULL THEN ly
 ELSE ly + (ry - ly) * (channel - lx) / (rx - lx) END AS {column})
 FROM (SELECT *, {left.format(known)} AS lx, {left.format(column)} AS ly, {right.format(known)} AS rx, {right.format(column)} AS ry FROM {source}))"""


INTERPOLATE = f"WITH {EV}, gaps AS (SELECT baseline, time, channel, CASE WHEN NOT flag THEN value END AS value FROM ev3d) SELECT baseline, time, channel, {r6('value')} AS value FROM {_interpolated('gaps', 'value')}"


def _kernel(r: int, passes: int = 4) -> list[int]:
    out = np.ones(1, np.int64)
    for _ in range(passes):
        out = np.convolve(out, np.ones(2 * r + 1, np.int64))
    return [int(x) for x in out]


def _convolved(source: str, axis: str, kernel: list[int], columns: list[str], keep: str = "") -> str:
    """Each sample meets those within reach of it; the kernel weighs them."""
    if len(kernel) == 1:
        return source
    other = "channel" if axis == "time" else "time"
    reach = len(kernel) // 2
    sums = ", ".join(f"sum(s.{c} * k.w) AS {c}" for c in columns)
    values = ", ".join(f"({i - reach}, {w})" for i, w in enumerate(kernel))
    return f"""(SELECT d.baseline, d.time, d.channel, {sums} FROM {source} d JOIN (VALUES {values}) k(o, w) ON true
 JOIN {source} s ON s.baseline = d.baseline AND s.{other} = d.{other} AND s.{axis} = d.{axis} + k.o GROUP BY 1, 2, 3)"""


def _radius(sigma: float) -> int:
    return int(0.5 * sqrt(12 * sigma * sigma / 4 + 1))


BOX = f"WITH {EV} SELECT baseline, time, channel, {r6('value / 625.0')} AS value FROM {_convolved('ev3d', 'channel', _kernel(2), ['value'])}"


class Chain:
    """CTEs one after another under fresh names."""

    def __init__(self, *first: str):
        self.parts, self.n = list(first), 0

    def add(self, body: str) -> str:
        self.n += 1
        name = f"q{self.n}"
        self.parts.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def sql(self, last: str) -> str:
        return f"WITH {', '.join(self.parts)} {last}"


def _gaussian(q: Chain, source: str, sigma_time: float, sigma_freq: float) -> str:
    """baseline, time, channel, background"""
    w = q.add(f"SELECT baseline, time, channel, CASE WHEN flag THEN 0.0 ELSE value END AS num, CASE WHEN flag THEN 0.0 ELSE 1.0::DOUBLE END AS den FROM {source}")
    for axis, sigma in (("time", sigma_time), ("channel", sigma_freq)):
        if _radius(sigma):
            w = q.add(f"SELECT * FROM {_convolved(w, axis, _kernel(_radius(sigma)), ['num', 'den'])}")
    return q.add(f"SELECT baseline, time, channel, CASE WHEN den <> 0 THEN num / den END AS background FROM {w}")


def masked_gaussian(sigma_time: float, sigma_freq: float) -> str:
    q = Chain(EV)
    got = _gaussian(q, "ev3d", sigma_time, sigma_freq)
    return q.sql(f"SELECT baseline, time, channel, {r6('background')} AS background FROM {got}")


def _in_chunk(ends) -> str:
    return "CASE " + " ".join(f"WHEN channel < {b} THEN {k}" for k, b in enumerate(ends[1:])) + " END"


def _background2d(q: Chain, source: str, sigma_time: float, sigma_freq: float, ends, iterations: int, reject: float) -> str:
    now = source
    for e in range(iterations, 0, -1):
        g = _gaussian(q, now, e * sigma_time, e * sigma_freq)
        res = q.add(f"SELECT d.baseline, d.time, d.channel, value, flag, abs(value - background) AS res, {_in_chunk(ends)} AS c FROM {now} d JOIN (SELECT baseline AS gb, time AS gt, channel AS gc, background FROM {g}) ON gb = d.baseline AND gt = d.time AND gc = d.channel")
        lim = q.add(f"SELECT baseline, c, {MAD * reject!r}::DOUBLE * median(res) FILTER (NOT flag) AS lim FROM {res} GROUP BY 1, 2")
        now = q.add(f"SELECT r.baseline, time, channel, value, flag OR coalesce(res > lim, false) AS flag FROM {res} r JOIN {lim} l ON l.baseline = r.baseline AND l.c = r.c")
    g = _gaussian(q, now, sigma_time, sigma_freq)
    return q.add(f"SELECT baseline, time, channel, background FROM {_interpolated(g, 'background')}")


def background2d(sigma_time: float, sigma_freq: float, ends, iterations: int, reject: float) -> str:
    q = Chain(EV)
    got = _background2d(q, "ev3d", sigma_time, sigma_freq, ends, iterations, reject)
    return q.sql(f"SELECT baseline, time, channel, {r6('background')} AS background FROM {got}")


def _sum_threshold(q: Chain, source: str, axis: str, windows, n_sigma: float, rho: float, ends) -> str:
    """baseline, time, channel, found"""
    other = "channel" if axis == "time" else "time"
    pad = max(windows) - 1 if windows else 0
    spans = list(zip(ends[:-1], ends[1:], strict=True)) if ends else [(0, 1 << 30)]
    values = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(spans))
    now = q.add(f"SELECT baseline, time, channel, value, flag, k AS c, ({axis} >= lo AND {axis} < hi) AS own FROM {source} JOIN (VALUES {values}) s(k, lo, hi) ON {axis} >= lo - {pad} AND {axis} < hi + {pad}")
    thr = q.add(f"SELECT baseline, {other} AS o, c, {n_sigma * MAD!r}::DOUBLE * median(abs(value)) FILTER (own AND NOT flag) AS t FROM {now} GROUP BY 1, 2, 3")
    now = q.add(f"SELECT n.*, coalesce(t, 'infinity'::DOUBLE) AS t, false AS pos, false AS neg FROM {now} n JOIN {thr} h ON h.baseline = n.baseline AND h.o = n.{other} AND h.c = n.c")
    part = f"PARTITION BY baseline, {other}, c ORDER BY {axis}"
    for w in windows:
        lim = f"(t / {float(rho ** log2(w))!r}::DOUBLE)"
        held = f"CASE WHEN pos AND value > {lim} THEN {lim} WHEN neg AND value < -{lim} THEN -{lim} ELSE value END"
        now = q.add(f"SELECT *, avg({held}) OVER (x ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m, count(*) OVER (x ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS n FROM {now} WINDOW x AS ({part})")
        now = q.add(
            f"SELECT baseline, time, channel, value, flag, c, own, t, pos OR bool_or(n = {w} AND m > {lim}) OVER (x ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS pos,"
            f" neg OR bool_or(n = {w} AND -m > {lim}) OVER (x ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS neg FROM {now} WINDOW x AS ({part})"
        )
    return q.add(f"SELECT baseline, time, channel, pos OR neg AS found FROM {now} WHERE own")


def sum_threshold(axis: str, n_sigma: float, ends) -> str:
    q = Chain(EV)
    source = q.add("SELECT baseline, time, channel, CASE WHEN flag THEN 0.0 ELSE value - 50 END AS value, flag FROM ev3d")
    return q.sql(f"SELECT * FROM {_sum_threshold(q, source, axis, [1, 2, 4, 8], n_sigma, 1.3, ends)}")


def _smear(flag: str, keys: str, axis: str, width: int) -> str:
    return f"bool_or({flag}) OVER (PARTITION BY {keys} ORDER BY {axis} ROWS BETWEEN {width // 2} PRECEDING AND {width - 1 - width // 2} FOLLOWING)"


COMBINE = f"WITH {EV} SELECT baseline, time, channel, {_smear('value > 97 OR (channel * 31 + time * 17) % 53 = 0', 'baseline, channel', 'time', 4)} AS flag FROM ev3d"


def _unaverage(q: Chain, source: str, channels: int, times: int, factor: int, extend: int, time_frac: float, freq_frac: float) -> str:
    wide = q.add(f"SELECT s.baseline, s.time, CAST(o.i AS INTEGER) AS channel, flag FROM {source} s JOIN range(0, {channels}) o(i) ON o.i // {factor} = s.channel")
    smeared = q.add(f"SELECT baseline, time, channel, {_smear('flag', 'baseline, time', 'channel', extend)} AS f FROM {wide}")
    return q.add(
        f"SELECT baseline, time, channel, f OR sum(f::INTEGER) OVER (PARTITION BY baseline, time) > {freq_frac * channels!r}::DOUBLE"
        f" OR sum(f::INTEGER) OVER (PARTITION BY baseline, channel) > {time_frac * times!r}::DOUBLE AS flag FROM {smeared}"
    )


def _unaverage_query() -> str:
    q = Chain(EV)
    source = q.add("SELECT baseline, time, channel, value > 90 OR (time % 13 = 3 AND channel < 9) AS flag FROM ev3d")
    return q.sql(f"SELECT * FROM {_unaverage(q, source, 142, 30, 3, 4, 0.3, 0.5)}")


UNAVERAGE = _unaverage_query()


def twod_flagger(p, times: int, channels: int, lost: str = "false") -> str:
    q, good = Chain(EV), f"FILTER (NOT flag AND NOT ({lost}))"
    averaged = -(-channels // p.average_freq)
    ends = sorted({int(x) for x in np.linspace(0, averaged, p.freq_chunks + 1)})
    wf = sorted({w for w in (ceil(w / p.average_freq) for w in p.windows_freq) if w <= averaged})
    wt = [w for w in p.windows_time if w <= channels]
    spike = p.spike_width_freq / p.average_freq
    grid = q.add(f"SELECT baseline, time, CAST(channel // {p.average_freq} AS INTEGER) AS channel, coalesce(avg(abs(value)) {good}, 0.0) AS value, count(*) {good} = 0 AS flag FROM ev3d GROUP BY 1, 2, 3")
    spec = q.add(f"SELECT baseline, 0 AS time, channel, coalesce(median(value) FILTER (NOT flag), 0.0) AS value, count(*) FILTER (NOT flag) = 0 AS flag FROM {grid} GROUP BY 1, 3")
    less = lambda a, b: q.add(f"SELECT a.baseline, a.time, a.channel, value - background AS value, flag FROM {a} a JOIN {b} b ON b.baseline = a.baseline AND b.time = a.time AND b.channel = a.channel")
    spec = less(spec, _background2d(q, spec, 0.0, spike, ends, p.background_iterations, p.background_reject))
    spec = _sum_threshold(q, spec, "channel", wf, p.outlier_nsigma, p.rho, ends)
    grid = q.add(f"SELECT g.baseline, g.time, g.channel, value, flag OR found AS flag FROM {grid} g JOIN {spec} s ON s.baseline = g.baseline AND s.channel = g.channel")
    res = less(grid, _background2d(q, grid, p.spike_width_time, spike, ends, p.background_iterations, p.background_reject))
    in_time = _sum_threshold(q, res, "time", wt, p.outlier_nsigma, p.rho, None)
    res = q.add(f"SELECT r.baseline, r.time, r.channel, value, flag OR found AS flag FROM {res} r JOIN {in_time} t ON t.baseline = r.baseline AND t.time = r.time AND t.channel = r.channel")
    in_freq = _sum_threshold(q, res, "channel", wf, p.outlier_nsigma, p.rho, ends)
    either = q.add(
        f"SELECT t.baseline, t.time, t.channel, t.found OR f.found OR s.found AS any FROM {in_time} t JOIN {in_freq} f ON f.baseline = t.baseline AND f.time = t.time AND f.channel = t.channel"
        f" JOIN {spec} s ON s.baseline = t.baseline AND s.channel = t.channel"
    )
    wide = q.add(f'SELECT baseline, time, channel, {_smear(chr(34) + "any" + chr(34), "baseline, channel", "time", p.time_extend)} AS flag FROM {either}')
    return q.sql(f"SELECT baseline, time, channel, flag OR ({lost}) AS flag FROM {_unaverage(q, wide, channels, times, p.average_freq, p.freq_extend, p.flag_all_time_frac, p.flag_all_freq_frac)}").replace(" AS any FROM", ' AS "any" FROM')


_ANGLE = "2 * pi() / 64 * k.i * channel"
DFT = f"WITH {EMB} SELECT baseline, CAST(k.i AS INTEGER) AS k, {r6(f'sum(value * cos({_ANGLE})) ** 2 + sum(value * sin({_ANGLE})) ** 2')} AS power FROM emb2d, range(0, 33) k(i) GROUP BY 1, 2"
FFT = f"WITH {EMB} SELECT baseline, CAST(k.i AS INTEGER) AS k, {r6(f'sum(value * cos({_ANGLE}))')} AS re, {r6(f'-sum(value * sin({_ANGLE}))')} AS im FROM emb2d, range(0, 33) k(i) GROUP BY 1, 2"
FFT_ROUND = f"WITH {EMB} SELECT baseline, channel AS k, {r6('value * 64')} AS value FROM emb2d"


def fft_c2c(sign: int) -> str:
    turn = f"({sign} * 2 * pi() * k.i * channel / 32)"
    return f"""WITH {EMBC} SELECT baseline, CAST(k.i AS INTEGER) AS k, {r6(f'sum(re * cos({turn}) - im * sin({turn}))')} AS re, {r6(f'sum(re * sin({turn}) + im * cos({turn}))')} AS im
 FROM embc, range(0, 32) k(i) GROUP BY 1, 2"""


FFT_C2C, FFT_C2C_INVERSE = fft_c2c(-1), fft_c2c(1)
FFT_SINGLE = f"WITH {EMBC} SELECT baseline, channel AS k, true AS near, true AS single FROM embc"
