"""The registered queries in DuckDB SQL, over one chain of common table expressions."""

from __future__ import annotations

import math

#: Parameters of the registered queries, at every size of the tables.
PARAMETERS = {
    "lat": (22.0, 35.0), "lon": (97.5, 105.5), "candidate_mag": 4.5, "window_days": 2.0, "most": 30, "radius_km": 400.0, "days": 10.0, "min_mag": 1.0,
    "rings": (0.0, 50.0, 150.0, 400.0), "least": 25, "depths": [0.0, 10.0, 20.0, 40.0, 80.0, 300.0], "buffers": (10, 25, 50), "tmin": 0.01, "seed": 7,
    "least_mainshock": 30, "least_relaxed": 10, "draws": 200, "reps": 20, "reps_corr": 400, "reps_fe": 2000, "reps_permutation": 5000, "reps_uncertainty": 1000, "reps_influence": 1000,
}
P = PARAMETERS


def _distance(radius: str, lat: str, lon: str, lat0: str, lon0: str) -> str:
    return f"(2e0 * {radius} * asin(least(1e0, sqrt(pow(sin((radians({lat0}) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians({lat0})) * pow(sin(radians({lon0} - {lon}) / 2), 2)))))"


def _depth(c: str) -> str:
    bins = P["depths"]
    return "CASE WHEN " + c + " IS NULL THEN 'unknown' " + " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN '{a:g}-{b:g}km'" for a, b in zip(bins, bins[1:])) + f" ELSE '>={bins[-1]:g}km' END"


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _poisson(h: str) -> str:
    """A Poisson number of mean one from 32 bits."""
    total, term, ends = 0.0, math.exp(-1), []
    for k in range(10):
        total += term
        term /= k + 1
        ends.append(f"CAST({h} / 4294967296e0 >= {total!r}e0 AS INT)")
    return " + ".join(ends)


def _grid(name: str, source: str, by: str, gate: int = 0, weight: str = "1") -> str:
    """Tables that end with ``name``: the best grid point by ``by``, with n, k, c, p, nll."""
    enough = f"SELECT {by} FROM {source} GROUP BY ALL HAVING count(*) >= {gate}"
    return f"""
    {name}_sums AS (
        SELECT {by}, i, c, sum({weight}) AS n, sum({weight} * ln(t_days + c)) AS logs FROM {source} {f"JOIN ({enough}) USING ({by})" if gate else ""}, cs
        WHERE t_days BETWEEN {P['tmin']} AND {P['days']} GROUP BY {by}, i, c HAVING sum({weight}) >= 20),
    {name}_k AS (SELECT s.*, j, p, n / ((pow({P['days']}e0 + c, 1 - p) - pow({P['tmin']}e0 + c, 1 - p)) / (1 - p)) AS k FROM {name}_sums s, ps),
    {name} AS MATERIALIZED (
        SELECT *, CAST(n AS BIGINT) AS n_events, n - n * ln(k) + p * logs AS nll FROM {name}_k
        QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(n - n * ln(k) + p * logs, 9), i, j) = 1)"""


M = P["least"]
WINDOW, SPAN = int(P["window_days"] * 86400e6), int(P["days"] * 86400e6)

CHAIN = f"""
WITH RECURSIVE cat AS (
    SELECT 'ev' || event_id AS usgs_id, epoch_us(ts) AS time_us, event_type AS place,
           22e0 + 13e0 * ((event_id * 7919 + user_id * 31) % 10007) / 10007e0 AS lat,
           97.5e0 + 8e0 * ((event_id * 104729 + user_id * 17) % 10009) / 10009e0 AS lon,
           TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS depth_km, 1e0 + value / 80e0 AS mag
    FROM events),
cand AS (SELECT * FROM cat WHERE mag >= {P['candidate_mag']} AND lat BETWEEN 22 AND 35 AND lon BETWEEN 97.5 AND 105.5),
kept(t) AS (
    SELECT min(time_us) FROM cand
    UNION ALL
    SELECT min(c.time_us) FROM kept k JOIN cand c ON c.time_us >= k.t + {WINDOW} HAVING min(c.time_us) IS NOT NULL),
ms AS (
    SELECT usgs_id, time_us, mag, lat, lon, depth_km, place FROM cand WHERE time_us IN (SELECT t FROM kept ORDER BY t LIMIT {P['most']})
    QUALIFY row_number() OVER (PARTITION BY time_us ORDER BY usgs_id) = 1),
aft0 AS (
    SELECT m.usgs_id AS mainshock_id, m.mag AS mainshock_mag, m.lat AS c_lat, m.lon AS c_lon, c.usgs_id, c.time_us, c.lat, c.lon, c.depth_km, c.mag,
           (c.time_us - m.time_us) / 86400e6 AS t_days, {_distance('6371e0', 'c.lat', 'c.lon', 'm.lat', 'm.lon')} AS dist_km
    FROM cat c JOIN ms m ON c.time_us > m.time_us AND c.time_us <= m.time_us + {SPAN} AND c.usgs_id <> m.usgs_id
    WHERE c.mag >= {P['min_mag']}),
aft AS (SELECT * FROM aft0 WHERE dist_km <= {P['radius_km']}),
rc AS (
    SELECT mainshock_id, count(*) FILTER (dist_km < 50) AS a, count(*) FILTER (dist_km >= 50 AND dist_km < 150) AS b,
           count(*) FILTER (dist_km >= 150 AND dist_km < 400) AS c
    FROM aft GROUP BY 1),
step1 AS (
    SELECT *, CASE WHEN least(a, b, c) >= {M} THEN 'none'
                   WHEN a <= b AND a <= c THEN 'left'
                   WHEN b <= c THEN CASE WHEN a <= c THEN 'left' ELSE 'right' END
                   ELSE 'right' END AS joined
    FROM rc),
step2 AS (
    SELECT *, CASE joined WHEN 'left' THEN least(a + b, c) WHEN 'right' THEN least(a, b + c) END AS fewest FROM step1),
rings AS (
    SELECT mainshock_id, unnest(CASE
        WHEN joined = 'none' THEN [{{'lo': 0e0, 'hi': 50e0}}, {{'lo': 50e0, 'hi': 150e0}}, {{'lo': 150e0, 'hi': 400e0}}]
        WHEN fewest < {M} THEN [{{'lo': 0e0, 'hi': 400e0}}]
        WHEN joined = 'left' THEN [{{'lo': 0e0, 'hi': 150e0}}, {{'lo': 150e0, 'hi': 400e0}}]
        ELSE [{{'lo': 0e0, 'hi': 50e0}}, {{'lo': 50e0, 'hi': 400e0}}] END, recursive := true)
    FROM step2),
rec0 AS (
    SELECT mainshock_id, 'depth' AS subgroup_type, 'all_depth' AS subgroup, t_days, mag FROM aft
    UNION ALL SELECT mainshock_id, 'region', CASE WHEN lon < c_lon THEN 'West_of_ms' ELSE 'East_of_ms' END, t_days, mag FROM aft
    UNION ALL SELECT mainshock_id, 'region', CASE WHEN lat < c_lat THEN 'South_of_ms' ELSE 'North_of_ms' END, t_days, mag FROM aft
    UNION ALL SELECT r.mainshock_id, 'ring', CAST(lo AS INT) || '-' || CAST(hi AS INT) || 'km', t_days, mag
        FROM aft e JOIN rings r ON e.mainshock_id = r.mainshock_id AND dist_km >= lo AND dist_km < hi),
rec AS (
    SELECT * FROM rec0
    UNION ALL SELECT mainshock_id, 'depth', {_depth('depth_km')}, t_days, mag FROM aft),
px AS (
    SELECT 97.5e0 + 8e0 * ((o_orderkey * 104729) % 10009) / 10009e0 AS lon, 22e0 + 13e0 * ((o_orderkey * 7919) % 10007) / 10007e0 AS lat, o_totalprice / 100e0 AS pop
    FROM orders),
near0 AS (
    SELECT m.usgs_id AS mainshock_id, m.lat AS c_lat, m.lon AS c_lon, p.lat, p.lon, p.pop, {_distance('6371.0088e0', 'p.lat', 'p.lon', 'm.lat', 'm.lon')} AS dist_km
    FROM px p, ms m),
near AS (SELECT * FROM near0 WHERE dist_km <= {P['radius_km']}),
buf AS (
    SELECT m.usgs_id AS mainshock_id, {', '.join(f"{f}(pop) FILTER (dist_km <= {r}) AS pop_{n}_{r}km" for r in P['buffers'] for n, f in (('sum', 'sum'), ('mean', 'avg'), ('max', 'max')))}
    FROM ms m LEFT JOIN near n ON n.mainshock_id = m.usgs_id GROUP BY 1),
cs AS (SELECT i, exp(ln(1e-6) + (ln(10e0) - ln(1e-6)) * i / 39) AS c FROM range(0, 40) t(i)),
ps AS (SELECT j, 0.2e0 + 4.8e0 * j / 59 AS p FROM range(0, 60) t(j)),
{_grid("fitted", "rec", "mainshock_id, subgroup_type, subgroup", M)},
fits AS (
    SELECT mainshock_id || '|' || subgroup_type || '|' || subgroup AS record_id, mainshock_id, subgroup_type, subgroup, n_events, p FROM fitted),
pops AS (
    SELECT record_id, sum(pop) AS pop_sum_subgroup, avg(pop) AS pop_mean_subgroup, max(pop) AS pop_max_subgroup
    FROM fits f JOIN near n ON f.mainshock_id = n.mainshock_id
     AND CASE WHEN subgroup_type = 'ring' THEN dist_km > CAST(split_part(subgroup, '-', 1) AS DOUBLE) AND dist_km <= CAST(replace(split_part(subgroup, '-', 2), 'km', '') AS DOUBLE)
              WHEN subgroup = 'East_of_ms' THEN lon >= c_lon WHEN subgroup = 'West_of_ms' THEN lon < c_lon
              WHEN subgroup = 'North_of_ms' THEN lat >= c_lat WHEN subgroup = 'South_of_ms' THEN lat < c_lat ELSE true END
    GROUP BY 1),
sub AS (SELECT f.*, pop_sum_subgroup, pop_mean_subgroup, pop_max_subgroup FROM fits f LEFT JOIN pops USING (record_id)),
samp AS (
    SELECT *, log10(pop_sum_subgroup) AS x, ln(n_events) AS z FROM sub
    WHERE subgroup <> 'all_depth' AND NOT (subgroup_type = 'ring' AND subgroup = '0-400km') AND n_events >= {M} AND pop_sum_subgroup > 0),
{_grid("shockfits", "aft", "mainshock_id", P["least_mainshock"])},
msr AS (
    SELECT f.mainshock_id, f.n_events, f.p, m.mag AS mainshock_mag FROM shockfits f JOIN ms m ON m.usgs_id = f.mainshock_id),
msrows AS (SELECT * FROM msr LEFT JOIN buf USING (mainshock_id)),
hashed AS (
    SELECT mainshock_id AS record_id, rep AS draw, t_days, {_draw(str(P['seed']), 'rep', 'mainshock_id', 'usgs_id')} AS h FROM aft, range(1, {P['draws'] + 1}) t(rep)),
taken AS (SELECT record_id, draw, t_days, {_poisson('h')} AS times FROM hashed),
{_grid("drawn0", "taken", "record_id, draw", 0, "times")},
draws AS (SELECT record_id, draw, p AS p_boot FROM drawn0),
dm0 AS (SELECT record_id, mainshock_id, x, z, p AS y, CAST(subgroup_type = 'region' AS DOUBLE) AS r, CAST(subgroup_type = 'ring' AS DOUBLE) AS g FROM samp),
dm AS (
    SELECT record_id, mainshock_id, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, r - avg(r) OVER w AS r, g - avg(g) OVER w AS g, y - avg(y) OVER w AS y FROM dm0 WINDOW w AS (PARTITION BY mainshock_id)),
kinds AS (
    SELECT *, (sum(p) OVER k - p) / nullif(count(*) OVER k - 1, 0) AS predicted FROM samp WINDOW k AS (PARTITION BY subgroup_type)),
known AS (SELECT * FROM kinds WHERE predicted IS NOT NULL),
others AS (SELECT g.mainshock_id AS test_group, s.p FROM (SELECT DISTINCT mainshock_id FROM samp) g JOIN samp s ON s.mainshock_id <> g.mainshock_id),
bins AS (SELECT test_group, quantile_cont(p, 0.33) AS q1, quantile_cont(p, 0.66) AS q2 FROM others GROUP BY 1),
kothers AS (SELECT g.mainshock_id AS test_group, s.p FROM (SELECT DISTINCT mainshock_id FROM known) g JOIN known s ON s.mainshock_id <> g.mainshock_id),
kbins AS (SELECT test_group, quantile_cont(p, 0.33) AS q1, quantile_cont(p, 0.66) AS q2 FROM kothers GROUP BY 1),
classed AS (
    SELECT k.*, CAST(p >= q1 AS INT) + CAST(p >= q2 AS INT) AS t, CAST(predicted >= q1 AS INT) + CAST(predicted >= q2 AS INT) AS c
    FROM known k JOIN kbins b ON b.test_group = k.mainshock_id)
"""


def _ranks(by: str, x: str = "x", y: str = "p") -> str:
    part = f"PARTITION BY {by}" if by else ""
    more = f"{by}, " if by else ""
    return f"rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {more}{x}) - 1) / 2 AS rx, rank() OVER ({part} ORDER BY {y}) + (count(*) OVER (PARTITION BY {more}{y}) - 1) / 2 AS ry"


def _corr(a: str, b: str) -> str:
    return f"round(CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END, 6)"


def _swept(source: str, name: str, part: str = "", w: str = "") -> str:
    """Tables that end with ``name``: z, r, g made orthogonal one after another, and y freed of them; x stays."""
    over = f"OVER ({'PARTITION BY ' + part if part else ''})"

    def less(a: str, q: str) -> str:
        return f"{a} - {q} * coalesce(sum({w}{a} * {q}) {over} / CASE WHEN sum({w}{q} * {q}) {over} > 1e-9 THEN sum({w}{q} * {q}) {over} END, 0) AS {a}"

    return f""", {name}1 AS (SELECT * REPLACE ({less('r', 'z')}, {less('g', 'z')}, {less('y', 'z')}) FROM {source}),
    {name}2 AS (SELECT * REPLACE ({less('g', 'r')}, {less('y', 'r')}) FROM {name}1),
    {name} AS (SELECT * REPLACE ({less('y', 'g')}) FROM {name}2)"""


def _slope(w: str = "") -> str:
    """x's coefficient from what _swept gives, as an aggregate."""
    gone = "".join(f" - coalesce(pow(sum({w}x * {q}), 2) / CASE WHEN sum({w}{q} * {q}) > 1e-9 THEN sum({w}{q} * {q}) END, 0)" for q in "zrg")
    return f"sum({w}x * y) / (sum({w}x * x){gone}) AS slope"


def _two_sided(t: str, dof: str) -> str:
    """Two-sided p of a t statistic with whole degrees of freedom, by the finite series of the angle atan(|t| / sqrt(dof))."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    odd = f"2e0 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda k: exp(k * ln(4e0) + 2 * lgamma(k + 1e0) - lgamma(2 * k + 2e0)) * pow(cos({angle}), 2 * k + 1))), 0))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {dof} // 2), lambda k: exp(lgamma(2 * k + 1e0) - 2 * lgamma(k + 1e0) - k * ln(4e0)) * pow(cos({angle}), 2 * k)))"
    return f"(1 - CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END)"


def _least_squares(source: str, terms: dict[str, str], shape: str) -> str:
    """Tables that end with ``tested``: term, coef, se, t, p_value, ci_lo, ci_hi, rss of y on the terms, which are columns of ``source``.

    Each term is freed of all others, and so is y; ``shape`` is a query of
    one row with the degrees of freedom dof. The critical value is bisected.
    """
    columns, k = list(terms.values()), len(terms)
    wide = " UNION ALL ".join(
        f"SELECT '{term}' AS term, {c} AS e, y" + "".join(f", {o} AS a{i}" for i, o in enumerate(o for o in columns if o != c)) + f" FROM {source}" for term, c in terms.items()
    )
    steps, last = "", "wide"
    for i in range(k - 1):
        less = [f"{c} - a{i} * sum({c} * a{i}) OVER w / sum(a{i} * a{i}) OVER w AS {c}" for c in ("e", "y", *(f"a{j}" for j in range(i + 1, k - 1)))]
        steps += f""", freed{i} AS (SELECT * REPLACE ({", ".join(less)}) FROM {last} WINDOW w AS (PARTITION BY term))"""
        last = f"freed{i}"
    return f"""
    , wide AS ({wide}){steps},
    shape AS ({shape}),
    critical(i, lo, hi) AS (
        SELECT 0, 0e0, 1000e0
        UNION ALL
        SELECT i + 1, CASE WHEN p > 0.05e0 THEN mid ELSE lo END, CASE WHEN p > 0.05e0 THEN hi ELSE mid END
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, {_two_sided("((lo + hi) / 2)", "dof")} AS p FROM critical, shape) WHERE i < 60),
    solved AS (SELECT term, sum(e * y) / sum(e * e) AS coef, sum(e * e) AS own, sum(y * y) - pow(sum(e * y), 2) / sum(e * e) AS rss FROM {last} GROUP BY 1),
    erring AS (SELECT *, sqrt(rss / dof / own) AS se FROM solved, shape),
    tested AS (
        SELECT e.*, coef / se AS t, {_two_sided("(coef / se)", "dof")} AS p_value, coef - hi * se AS ci_lo, coef + hi * se AS ci_hi FROM erring e, (SELECT hi FROM critical WHERE i = 60))
    """


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_SUMS = ", ".join(f"sum({{w}}{a} * {b}) AS s{a}{b}" for a, b in (("x", "x"), ("z", "z"), ("x", "z"), ("x", "y"), ("z", "y"), ("y", "y")))

_CATALOG = "SELECT usgs_id, {time} AS time_us, round(lat, 9) AS lat, round(lon, 9) AS lon, depth_km, round(mag, 9) AS mag, place FROM cat"

_PERMUTED = _swept("dm", "sw") + f"""
    , placed AS (SELECT *, row_number() OVER (PARTITION BY mainshock_id ORDER BY record_id) AS n FROM sw),
    given AS (
        SELECT rep, mainshock_id, x, row_number() OVER (PARTITION BY mainshock_id, rep ORDER BY md5(concat_ws('|', {P['seed']}, rep, record_id)), record_id) AS n
        FROM placed, range(1, {P['reps_permutation']} + 1) t(rep)),
    every AS (
        SELECT v.rep, v.x, p.z, p.r, p.g, p.y FROM given v JOIN placed p ON v.mainshock_id = p.mainshock_id AND v.n = p.n
        UNION ALL SELECT 0, x, z, r, g, y FROM sw),
    slopes AS (SELECT rep, {_slope()} FROM every GROUP BY 1)
"""


def _drawn(reps: int) -> str:
    return f"""
    , lv AS (SELECT mainshock_id, row_number() OVER (ORDER BY mainshock_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT mainshock_id FROM samp)),
    times AS (
        SELECT rep, {_draw(str(P['seed']), 'rep', 'place')} % n AS place, count(*) AS times FROM lv, range(1, {reps + 1}) t(rep) GROUP BY ALL),
    drawn AS (SELECT rep, mainshock_id, times FROM times JOIN lv USING (place))
"""


def _mixed(x: str) -> str:
    """Whole numbers below 2^31 - 1 from whole numbers, by products and shifts."""
    first = f"({x}) % 2147483647 * 48271 % 2147483647"
    second = f"list_transform([{first}], lambda v: xor(v, v >> 15) * 69621 % 2147483647)"
    return f"list_transform({second}, lambda v: xor(v, v >> 13) * 39373 % 2147483647)[1]"


def _quantile(k: int, i: int) -> str:
    """The i-th of k quantiles of the sorted list ds of n values, linear between ranks."""
    at = f"({i}e0 / {k} * (n - 1))"
    low = f"CAST(floor({at}) AS BIGINT)"
    a, b, share = f"ds[{low} + 1]", f"ds[least({low} + 2, n)]", f"({at} - {low})"
    return f"CASE WHEN {share} < 0.5e0 THEN {a} + {share} * ({b} - {a}) ELSE {b} - ({b} - {a}) * (1 - {share}) END"


def _label(lo: str, hi: str) -> str:
    shown = lambda v: f"regexp_replace(regexp_replace(printf('%.6f', CASE WHEN {v} = 0 THEN 0e0 ELSE round({v} / pow(10e0, floor(log10(abs({v}))) - 5)) * pow(10e0, floor(log10(abs({v}))) - 5) END), '0+$', ''), '\\.$', '')"
    return f"CASE WHEN {hi} IS NULL THEN '>=' || {shown(lo)} || 'km' ELSE {shown(lo)} || '-' || {shown(hi)} || 'km' END"


#: Depths of each sequence in a sorted list, their number, and what the quantile rules ask of them.
_DEPTHS = f"""
    , dl AS (SELECT mainshock_id, list(depth_km ORDER BY depth_km) AS ds, count(*) AS n FROM aft WHERE depth_km IS NOT NULL GROUP BY 1),
    q0 AS (SELECT *, ds[1] AS low, {_quantile(3, 1)} AS a3, {_quantile(3, 2)} AS b3, {_quantile(2, 1)} AS a2 FROM dl)
"""

#: Cuts one after another among the distinct depths, for sequences whose quantiles coincide.
_CUTS = f""", inner0 AS (
        SELECT mainshock_id, depth_km AS u, sum(count(*)) OVER (PARTITION BY mainshock_id ORDER BY depth_km) AS upto FROM aft WHERE depth_km IS NOT NULL GROUP BY 1, 2),
    within AS (SELECT i.* FROM inner0 i JOIN q0 USING (mainshock_id) WHERE u > low + 1e-9 AND u < ds[n]),
    cut1 AS (SELECT mainshock_id, min(u) AS u1, min(upto) AS n1 FROM within WHERE upto >= {M} GROUP BY 1),
    cut2 AS (SELECT w.mainshock_id, min(u) AS u2, min(upto) AS n2 FROM within w JOIN cut1 c ON w.mainshock_id = c.mainshock_id AND u > u1 AND upto - n1 >= {M} GROUP BY 1),
    q1 AS (
        SELECT q0.*, CASE WHEN a3 > low + 1e-9 AND b3 > a3 THEN [a3, b3] WHEN n - n2 >= {M} THEN [u1, u2] END AS three,
               CASE WHEN a2 > low + 1e-9 THEN [a2] WHEN n - n1 >= {M} THEN [u1] END AS two
        FROM q0 LEFT JOIN cut1 USING (mainshock_id) LEFT JOIN cut2 USING (mainshock_id) WHERE n >= {2 * M}),
    q2 AS (
        SELECT *, len(list_filter(ds, lambda v: v <= three[1])) AS a, len(list_filter(ds, lambda v: v > three[1] AND v <= three[2])) AS b, len(list_filter(ds, lambda v: v > three[2])) AS c,
               len(list_filter(ds, lambda v: v <= two[1])) AS d, len(list_filter(ds, lambda v: v > two[1])) AS e FROM q1),
    q3 AS (SELECT *, CASE WHEN a <= b AND a <= c THEN true WHEN b <= c THEN a <= c ELSE false END AS leftward FROM q2),
    q4 AS (
        SELECT *, CASE WHEN three IS NOT NULL AND least(a, b, c) >= {M} THEN [low, three[1], three[2]]
            WHEN three IS NOT NULL AND leftward AND least(a + b, c) >= {M} THEN [low, three[2]]
            WHEN three IS NOT NULL AND NOT leftward AND least(a, b + c) >= {M} THEN [low, three[1]]
            WHEN two IS NOT NULL AND least(d, e) >= {M} THEN [low, two[1]] END AS edges FROM q3)
"""

_BINS = f""", mg(mainshock_id, los, cs) AS (
        SELECT mainshock_id, {[float(b) for b in P["depths"]]}::DOUBLE[],
               [{", ".join(f"len(list_filter(ds, lambda v: v >= {a}" + (f" AND v < {b}" if b is not None else "") + "))" for a, b in zip(P["depths"], [*P["depths"][1:], None]))}] FROM q0
        UNION ALL
        SELECT mainshock_id, los[:j] || los[j + 2:], cs[:j - 1] || [cs[j] + cs[j + 1]] || cs[j + 2:]
        FROM (
            SELECT *, CASE WHEN i > 1 AND (i = len(cs) OR cs[i - 1] <= cs[i + 1]) THEN i - 1 ELSE i END AS j
            FROM (SELECT *, list_position(cs, list_min(cs)) AS i FROM mg WHERE len(cs) > 1 AND (list_min(cs) < {M} OR len(cs) > 3)))),
    merged AS (SELECT mainshock_id, los FROM mg WHERE len(cs) > 1 AND list_min(cs) >= {M} AND len(cs) <= 3),
    q4 AS (
        SELECT mainshock_id, CASE WHEN los IS NOT NULL THEN los
            WHEN n >= {3 * M} AND least(len(list_filter(ds, lambda v: v < a3)), len(list_filter(ds, lambda v: v >= a3 AND v < b3)), len(list_filter(ds, lambda v: v >= b3))) >= {M} THEN [low, a3, b3]
            WHEN n >= {2 * M} AND least(len(list_filter(ds, lambda v: v < a2)), len(list_filter(ds, lambda v: v >= a2))) >= {M} THEN [low, a2] END AS edges
        FROM q0 LEFT JOIN merged USING (mainshock_id))
"""

_SEGMENTS = f""", sg AS (SELECT mainshock_id, i, edges[i] AS lo, edges[i + 1] AS hi FROM q4, range(1, 4) t(i) WHERE i <= len(edges))
    SELECT mainshock_id, {_label("lo", "hi")} AS segment, round(lo, 6) AS lo, round(hi, 6) AS hi, i = 1 AS first FROM sg
"""

#: The slope of p on log10 of people within 50 km over all orders of up to 10 rows, else over 5000 seeded ones, by a hash of repetition and place.
_ORDERS = f"""
    , vs AS (SELECT log10(pop_sum_50km) AS x, p, row_number() OVER (ORDER BY log10(pop_sum_50km), p) AS i, count(*) OVER () AS size FROM msrows WHERE pop_sum_50km > 0 AND p IS NOT NULL),
    us AS (SELECT x - avg(x) OVER () AS u, p, i, size FROM vs),
    lists AS (SELECT list(u ORDER BY i) AS u, list(p ORDER BY i) AS p FROM us),
    orders_of(o) AS (SELECT CAST([] AS BIGINT[]) UNION ALL SELECT list_append(o, i) FROM orders_of, us WHERE size <= 10 AND NOT list_contains(o, i)),
    os AS (SELECT rep, p, row_number() OVER (PARTITION BY rep ORDER BY {_mixed(_mixed(f"rep + {P['seed']}") + " + " + _mixed("i"))}, i) AS place FROM us, range(0, 5000) t(rep) WHERE size > 10),
    slopes AS (
        SELECT sum(o.p * u) / sum(u * u) AS slope FROM os o JOIN us ON place = us.i GROUP BY rep
        UNION ALL
        SELECT list_inner_product(u, list_transform(o, lambda j: p[j])) / list_inner_product(u, u) FROM orders_of, lists WHERE len(o) = len(u) AND len(u) <= 10)
"""


def _refined(name: str, source: str, by: str, low: str, raw: int) -> str:
    """Tables that end with ``name``: the fit of ``source`` by ``by`` over [low, days], with n, u = ln c, p, nll.

    The points of ln c close in on the best, and for each the points of p do.
    """
    width, end = math.log(10 / 1e-6) / 39, P["days"]

    def nll(p: str) -> str:
        a, b = f"({low} + exp(u))", f"({end}e0 + exp(u))"
        return f"n - n * ln(n / CASE WHEN abs(1 - {p}) < 1e-12 THEN ln({b} / {a}) ELSE (pow({b}, 1 - {p}) - pow({a}, 1 - {p})) / (1 - {p}) END) + {p} * logs"

    def best(points: str) -> str:
        return f"list_extract({points}, list_position(list_transform({points}, lambda q: {nll('q')}), list_min(list_transform({points}, lambda q: {nll('q')}))))"

    out = f"""
    , {name}_in AS (
        SELECT {by}, t_days FROM {source} JOIN (SELECT {by} FROM {source} GROUP BY ALL HAVING count(*) >= {raw}) USING ({by}) WHERE t_days BETWEEN {low} AND {end}),
    {name}_u0 AS (SELECT {by}, ln(1e-6) + {width!r} * k AS u FROM (SELECT DISTINCT {by} FROM {name}_in), range(0, 40) t(k))"""
    for r in range(7):
        out += f""",
    {name}_s{r} AS (SELECT {by}, u, count(*) AS n, sum(ln(t_days + exp(u))) AS logs FROM {name}_in JOIN {name}_u{r} USING ({by}) GROUP BY ALL HAVING count(*) >= 20),
    {name}_p{r}0 AS (SELECT *, {best("list_transform(range(0, 49), lambda k: 0.2e0 + 0.1e0 * k)")} AS p FROM {name}_s{r})"""
        for k, step in enumerate((5e-3, 2.5e-4, 1.25e-5, 6.25e-7)):
            points = f"list_transform(range(-20, 21), lambda k: least(5e0, greatest(0.2e0, p + {step!r} * k)))"
            out += f""",
    {name}_p{r}{k + 1} AS (SELECT * REPLACE ({best(points)} AS p) FROM {name}_p{r}{k})"""
        out += f""",
    {name}_b{r} AS MATERIALIZED (SELECT *, {nll("p")} AS nll FROM {name}_p{r}4 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {nll("p")}, u) = 1),
    {name}_u{r + 1} AS (SELECT DISTINCT {by}, greatest(ln(1e-6), least(ln(10e0), u + {width / 8**r!r} * (k - 8) / 8)) AS u FROM {name}_b{r}, range(0, 17) t(k))"""
    return out + f""",
    {name} AS (SELECT * FROM {name}_b6)
    """


_BODIES = {
    "event_catalog": _CATALOG.format(time="time_us"),
    "geojson_roundtrip": _CATALOG.format(time="time_us // 1000 * 1000"),
    "bbox_search": "SELECT usgs_id, time_us, round(mag, 9) AS mag FROM cat WHERE lat BETWEEN 25 AND 30 AND lon BETWEEN 99 AND 103 AND time_us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-20') AND mag >= 2",
    "mainshock_top1": "SELECT place, usgs_id, time_us, round(mag, 9) AS mag FROM cat WHERE mag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place ORDER BY mag DESC, time_us, usgs_id) = 1",
    "declustered_mainshocks": "SELECT usgs_id, time_us, round(mag, 9) AS mag FROM ms",
    "aftershock_join": "SELECT mainshock_id, usgs_id, round(t_days, 6) AS t_days, round(dist_km, 6) AS dist_km FROM aft",
    "catalog_clean": f"""
        SELECT t.usgs_id AS mainshock_id, count(*) AS n_events, round(min((c.time_us - t.time_us) / 86400e6), 6) AS first_days, round(sum((c.time_us - t.time_us) / 86400e6), 3) AS sum_days
        FROM cat c JOIN ms t ON c.time_us > t.time_us AND c.time_us <= t.time_us + {SPAN} AND c.usgs_id <> t.usgs_id
        WHERE c.mag BETWEEN -1 AND 10 AND (c.depth_km IS NULL OR c.depth_km BETWEEN -5 AND 800) AND {_distance('6371e0', 'c.lat', 'c.lon', 't.lat', 't.lon')} <= {P['radius_km']} GROUP BY 1""",
    "mainshock_list": "SELECT usgs_id, time_us, round(lat, 9) AS lat, round(lon, 9) AS lon, depth_km, round(mag, 9) AS mag, place FROM ms",
    "fits_roundtrip": "SELECT mainshock_id, mainshock_id || '|mainshock|all' AS record_id, n_events, round(p, 6) AS p FROM msr",
    "line_fit": "SELECT 'mainshock' AS scope, count(*) AS n, round(regr_slope(p, log10(pop_sum_50km)), 6) AS slope, round(regr_intercept(p, log10(pop_sum_50km)), 6) AS intercept FROM msrows WHERE pop_sum_50km > 0 AND p IS NOT NULL",
    "catalog_summary": "SELECT mainshock_id, count(*) AS n_rows, " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in ("mag", "depth_km", "t_days") for f in ("min", "max")) + " FROM aft GROUP BY 1",
    "events_per_mainshock": f"SELECT m.usgs_id, any_value(m.time_us) AS time_us, round(any_value(m.mag), 9) AS mag, round(any_value(m.lat), 9) AS lat, round(any_value(m.lon), 9) AS lon, any_value(m.depth_km) AS depth_km, any_value(m.place) AS place, count(a.usgs_id) AS aftershocks_n, CAST({P['radius_km']} AS DOUBLE) AS radius_km, CAST({P['days']} AS DOUBLE) AS days_after, CAST({P['min_mag']} AS DOUBLE) AS minmag FROM ms m LEFT JOIN aft a ON a.mainshock_id = m.usgs_id GROUP BY 1",
    "circle_boxes": "SELECT usgs_id AS mainshock_id, round(lat - 400e0 / 111, 6) AS lat_min, round(lat + 400e0 / 111, 6) AS lat_max, round(lon - 400e0 / (111e0 * greatest(cos(radians(lat)), 1e-6)), 6) AS lon_min, round(lon + 400e0 / (111e0 * greatest(cos(radians(lat)), 1e-6)), 6) AS lon_max FROM ms",
    "depth_group_counts": f"SELECT mainshock_id, {_depth('depth_km')} AS depth_group, count(*) AS n FROM aft GROUP BY ALL",
    "half_plane_counts": "SELECT mainshock_id, subgroup AS region, count(*) AS n FROM rec0 WHERE subgroup_type = 'region' GROUP BY ALL",
    "region_predicate_counts": "SELECT mainshock_id, subgroup, count(*) AS n FROM (SELECT mainshock_id, unnest([CASE WHEN lon < 101.5 THEN 'West_of_lon0' ELSE 'East_of_lon0' END, CASE WHEN lat < 28.5 THEN 'South_of_lat0' ELSE 'North_of_lat0' END]) AS subgroup FROM aft) GROUP BY ALL",
    "aftershock_ring_counts": "SELECT mainshock_id, CASE WHEN dist_km < 50 THEN 0 WHEN dist_km < 150 THEN 1 ELSE 2 END AS ring, count(*) AS n FROM aft WHERE dist_km < 400 GROUP BY ALL",
    "merged_rings": "SELECT mainshock_id, lo, hi FROM rings",
    "depth_segments": _DEPTHS + _CUTS + _SEGMENTS,
    "depth_segments_binned": _DEPTHS + _BINS + _SEGMENTS,
    "subgroup_expand": "SELECT mainshock_id || '|' || subgroup_type || '|' || subgroup AS record_id, subgroup_type, subgroup, count(*) AS n FROM rec0 GROUP BY ALL",
    "omori_nll": f"SELECT mainshock_id, count(*) AS n_events, round(50e0 * (pow(10.05e0, 1 - 1.1e0) - pow(0.06e0, 1 - 1.1e0)) / (1 - 1.1e0) - (count(*) * ln(50e0) - 1.1e0 * sum(ln(t_days + 0.05e0))), 4) AS nll FROM aft WHERE t_days BETWEEN {P['tmin']} AND {P['days']} GROUP BY 1",
    "omori_grid_fit": ", " + _grid("best", "aft", "mainshock_id") + " SELECT mainshock_id, n_events, round(k, 4) AS k, round(c, 9) AS c, round(p, 6) AS p, round(nll, 4) AS nll FROM best",
    "omori_sensitivity": """
        , sn AS (
            SELECT CAST(mc AS DOUBLE) AS mc, CAST(tmin_days AS DOUBLE) AS tmin_days, t_days
            FROM aft, (VALUES (1.0), (1.5), (2.0), (2.5)) a(mc), (VALUES (0.01), (0.05), (0.1)) b(tmin_days) WHERE mag >= mc)"""
        + _refined("sf", "sn", "mc, tmin_days", "tmin_days", 200)
        + "SELECT mc, tmin_days, n AS n_events, round(p, 3) AS p, round(nll, 4) AS nll FROM sf",
    "bootstrap_intervals": "SELECT record_id, count(p_boot) AS n_draws, round(quantile_cont(p_boot, 0.025), 6) AS p_lo, round(quantile_cont(p_boot, 0.5), 6) AS p_median, round(quantile_cont(p_boot, 0.975), 6) AS p_hi, avg(CAST(p_boot < 0 AS DOUBLE)) AS below_zero FROM draws GROUP BY 1",
    "binned_rate": f"""
        , b AS (SELECT mainshock_id, CAST(least(floor(ln(t_days / {P['tmin']}) * 20 / ln({P['days'] / P['tmin']}e0)), 19) AS INT) AS bin, count(*) AS n FROM aft WHERE t_days BETWEEN {P['tmin']} AND {P['days']} GROUP BY ALL),
        e AS (SELECT mainshock_id, CAST(i AS INT) AS bin FROM (SELECT DISTINCT mainshock_id FROM aft), range(0, 20) t(i))
        SELECT mainshock_id, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ({P['tmin']} * exp((bin + 1) * ln({P['days'] / P['tmin']}e0) / 20) - {P['tmin']} * exp(bin * ln({P['days'] / P['tmin']}e0) / 20)), 6) AS rate FROM e LEFT JOIN b USING (mainshock_id, bin)""",
    "buffer_exposure": "SELECT mainshock_id, " + ", ".join(f"round(pop_{n}_{r}km, 4) AS pop_{n}_{r}km" for r in P["buffers"] for n in ("sum", "mean", "max")) + " FROM buf",
    "subgroup_exposure": "SELECT record_id, round(pop_sum_subgroup, 4) AS pop_sum_subgroup, round(pop_mean_subgroup, 4) AS pop_mean_subgroup, round(pop_max_subgroup, 4) AS pop_max_subgroup FROM sub",
    "mainshock_summary": "SELECT mainshock_id, n_events, round(p, 6) AS p, round(mainshock_mag, 6) AS mainshock_mag, " + ", ".join(f"round(pop_sum_{r}km, 4) AS pop_sum_{r}km" for r in P["buffers"]) + " FROM msrows",
    "subgroup_summary": "SELECT record_id, mainshock_id, subgroup_type, subgroup, n_events, round(p, 6) AS p, round(pop_sum_subgroup, 4) AS pop_sum_subgroup, round(pop_sum_50km, 4) AS pop_sum_50km FROM sub LEFT JOIN buf USING (mainshock_id)",
    "analysis_sample": "SELECT record_id, n_events, round(p, 6) AS p, round(pop_sum_subgroup, 4) AS pop_sum_subgroup, true AS analysis_included FROM samp",
    "features": """
        , mid AS (SELECT *, CASE WHEN subgroup LIKE '>=%' THEN CAST(replace(replace(subgroup, '>=', ''), 'km', '') AS DOUBLE)
                                 WHEN subgroup LIKE '%-%km' THEN (CAST(split_part(subgroup, '-', 1) AS DOUBLE) + CAST(replace(split_part(subgroup, '-', 2), 'km', '') AS DOUBLE)) / 2 ELSE 0 END AS m FROM samp)
        SELECT record_id, round(x, 6) AS log10_pop, round(z, 6) AS log_n_events, CASE WHEN subgroup_type = 'ring' THEN m ELSE 0e0 END AS ring_mid_km, CASE WHEN subgroup_type = 'depth' THEN m ELSE 0e0 END AS depth_mid_km,
               CAST(subgroup_type = 'depth' AS DOUBLE) AS type_depth, CAST(subgroup_type = 'region' AS DOUBLE) AS type_region, CAST(subgroup_type = 'ring' AS DOUBLE) AS type_ring, CAST(subgroup = 'West_of_ms' AS DOUBLE) AS region_West_of_ms
        FROM mid""",
    "corr_pearson_spearman": f", k AS (SELECT *, {_ranks('subgroup_type')} FROM samp) SELECT subgroup_type, count(*) AS n, {_corr('x', 'p')} AS pearson_r, {_corr('rx', 'ry')} AS spearman_rho, round(CASE WHEN min(x) < max(x) THEN regr_slope(p, x) END, 6) AS slope FROM k GROUP BY 1",
    "controlled_ols": f"""
        , c AS (SELECT x - avg(x) OVER () AS x, z - avg(z) OVER () AS z, p - avg(p) OVER () AS y FROM samp),
        s AS (SELECT count(*) AS n, {_SUMS.format(w='')} FROM c),
        b AS (SELECT *, sxx * szz - sxz * sxz AS det, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM s),
        e AS (SELECT *, syy - b1 * sxy - b2 * szy AS rss FROM b),
        t AS (SELECT 'log10_pop' AS term, b1 AS coef, sqrt(rss / (n - 3) * szz / det) AS se, n, rss, syy FROM e UNION ALL SELECT 'log_n_events', b2, sqrt(rss / (n - 3) * sxx / det), n, rss, syy FROM e)
        SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 5) AS t, n, n - 3 AS dof, round(1 - rss / syy, 6) AS r2, round(1 - rss / syy * (n - 1) / (n - 3), 6) AS adj_r2 FROM t""",
    "corr_p_values": f"""
        , k AS (SELECT *, {_ranks('subgroup_type')} FROM samp),
        c AS (SELECT subgroup_type, count(*) AS n, CASE WHEN min(x) < max(x) AND min(p) < max(p) THEN corr(x, p) END AS a, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS b FROM k GROUP BY 1)
        SELECT subgroup_type, {", ".join(f"round(CASE WHEN n < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0e0 ELSE {_two_sided(f'({r} * sqrt((n - 2) / (1 - {r} * {r})))', '(n - 2)')} END, 8) AS {name}" for r, name in (("a", "pearson_p"), ("b", "spearman_p")))} FROM c""",
    "controlled_ols_full": ", ol AS (SELECT 1e0 AS c, log10(greatest(pop_sum_subgroup, 1)) AS x, m.mag AS m, z, p AS y FROM samp s JOIN ms m ON m.usgs_id = s.mainshock_id)"
        + _least_squares("ol", {"const": "c", "log10_pop": "x", "mainshock_mag": "m", "log_n_events": "z"}, "SELECT count(*) AS n, count(*) - 4 AS dof, var_pop(y) * count(*) AS total FROM ol") + f"""
        SELECT term, {_rounded('coef', 'se', 't', 'p_value', 'ci_lo', 'ci_hi')}, n, dof, round(1 - rss / total, 6) AS r2, round(1 - rss / total * (n - 1) / dof, 6) AS adj_r2 FROM tested""",
    "within_fe": _least_squares("dm", {"log10_pop": "x", "log_n_events": "z", "type_region": "r", "type_ring": "g"}, "SELECT count(*) AS n, count(DISTINCT mainshock_id) AS n_groups, 4 + count(DISTINCT mainshock_id) AS n_parameters, count(*) - 4 - count(DISTINCT mainshock_id) AS dof, (SELECT var_pop(y) * count(*) FROM dm0) AS total FROM dm") + f"""
        SELECT term, {_rounded('coef', 'se', 'p_value', 'ci_lo', 'ci_hi')}, n, n_groups, n_parameters, dof, round(1 - rss / total, 6) AS r2, round(1 - rss / total * (n - 1) / dof, 6) AS adj_r2 FROM tested""",
    "within_fe_slope": _swept("dm", "sw") + f", b AS (SELECT {_slope()} FROM sw) SELECT round(slope, 6) AS slope FROM b",
    "loo_corr": f"""
        , o AS (SELECT g.mainshock_id AS omitted, s.x, s.p FROM (SELECT DISTINCT mainshock_id FROM samp) g JOIN samp s ON s.mainshock_id <> g.mainshock_id UNION ALL SELECT '(none)', x, p FROM samp),
        k AS (SELECT *, {_ranks('omitted')} FROM o)
        SELECT omitted, count(*) AS n, {_corr('x', 'p')} AS pearson_r, {_corr('rx', 'ry')} AS spearman_rho FROM k GROUP BY 1""",
    "cluster_boot_corr": _drawn(P["reps_corr"]) + f""", e AS (SELECT d.rep, s.x, s.p FROM drawn d JOIN samp s USING (mainshock_id), range(1, 1000) t(i) WHERE i <= times),
        k AS (SELECT *, {_ranks('rep')} FROM e)
        SELECT CAST(rep AS INT) AS rep, count(*) AS n, {_corr('x', 'p')} AS pearson_r, {_corr('rx', 'ry')} AS spearman_rho FROM k GROUP BY 1""",
    "cluster_boot_fe": _drawn(P["reps_fe"]) + ", wd AS (SELECT rep, times, x, z, r, g, y FROM drawn JOIN dm USING (mainshock_id))" + _swept("wd", "sw", "rep", "times * ") + f"""
        , b AS (SELECT rep, {_slope('times * ')} FROM sw GROUP BY 1) SELECT CAST(rep AS INT) AS rep, round(slope, 6) AS slope FROM b""",
    "within_permute": f"""
        , pl AS (SELECT record_id, mainshock_id, pop_sum_subgroup, row_number() OVER (PARTITION BY mainshock_id ORDER BY record_id) AS n FROM samp),
        gv AS (SELECT rep, mainshock_id, pop_sum_subgroup, row_number() OVER (PARTITION BY mainshock_id, rep ORDER BY md5(concat_ws('|', {P['seed']}, rep, record_id)), record_id) AS n FROM pl, range(1, {P['reps'] + 1}) t(rep))
        SELECT CAST(rep AS INT) AS rep, g.mainshock_id, p.record_id, round(g.pop_sum_subgroup, 4) AS pop_sum_subgroup FROM gv g JOIN pl p ON g.mainshock_id = p.mainshock_id AND g.n = p.n""",
    "permutation_test": _PERMUTED + """
        SELECT round(any_value(o.slope), 6) AS observed, count(*) AS n_perm, round((count(*) FILTER (abs(s.slope) >= abs(o.slope)) + 1) / (count(*) + 1), 6) AS p_value,
               round(avg(s.slope), 6) AS null_mean, round(quantile_cont(s.slope, 0.025), 6) AS null_lo, round(quantile_cont(s.slope, 0.975), 6) AS null_hi
        FROM slopes s, (SELECT slope FROM slopes WHERE rep = 0) o WHERE s.rep > 0""",
    "exact_permutation": _ORDERS + """
        SELECT 'all' AS study, count(*) AS n_orders, round(any_value(own), 6) AS observed, round((count(*) FILTER (abs(slope) >= abs(own) - 1e-12) + CAST(any_value(many) AS INT)) / (count(*) + CAST(any_value(many) AS INT)), 6) AS p_value,
               round(quantile_cont(slope, 0.025), 6) AS null_lo, round(quantile_cont(slope, 0.975), 6) AS null_hi
        FROM slopes, (SELECT sum(u * p) / sum(u * u) AS own, any_value(size) > 10 AS many FROM us) HAVING any_value(own) IS NOT NULL""",
    "draw_histogram": ", e AS (SELECT *, min(p_boot) OVER w AS lo, max(p_boot) OVER w AS hi FROM draws WINDOW w AS (PARTITION BY record_id)) SELECT record_id, CAST(least(floor(coalesce((p_boot - lo) * 25 / nullif(hi - lo, 0), 0)), 24) AS INT) AS bin, count(*) AS n FROM e GROUP BY ALL",
    "draw_matrix": f"""
        , m AS (SELECT record_id, p_boot, row_number() OVER (PARTITION BY record_id ORDER BY p_boot, draw) - 1 AS i, count(*) OVER (PARTITION BY record_id) AS m FROM draws),
        k AS (SELECT record_id, rep, {_draw(str(P['seed']), 'record_id', 'rep')} % any_value(m) AS i FROM m, range(1, 31) t(rep) GROUP BY record_id, rep)
        SELECT record_id, CAST(rep AS INT) AS rep, round(p_boot, 6) AS p FROM k JOIN m USING (record_id, i)""",
    "logo_splits": "SELECT g.mainshock_id AS test_group, record_id, g.mainshock_id = s.mainshock_id AS is_test FROM (SELECT DISTINCT mainshock_id FROM samp) g, samp s",
    "train_bins": "SELECT test_group, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM bins",
    "class_metrics": ", f AS (SELECT subgroup_type, k, avg(CAST(t = c AS DOUBLE)) AS accuracy, coalesce(2e0 * sum(CAST(t = k AND c = k AS INT)) / nullif(sum(CAST(t = k AS INT)) + sum(CAST(c = k AS INT)), 0), 0) AS f1 FROM classed, range(0, 3) r(k) GROUP BY ALL) SELECT subgroup_type, round(any_value(accuracy), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1",
    "confusion": "SELECT t AS true_class, count(*) FILTER (c = 0) AS pred_0, count(*) FILTER (c = 1) AS pred_1, count(*) FILTER (c = 2) AS pred_2 FROM classed GROUP BY 1",
    "fold_metrics": "SELECT mainshock_id, count(*) AS n, round(avg(abs(p - predicted)), 6) AS mae, round(sqrt(avg(pow(p - predicted, 2))), 6) AS rmse, round(CASE WHEN var_pop(p) * count(*) > 1e-12 THEN 1 - sum(pow(p - predicted, 2)) / (var_pop(p) * count(*)) END, 5) AS r2, round(stddev_pop(p), 6) AS target_sd FROM known GROUP BY 1",
    "scale_correlations": f"""
        , l AS (SELECT mainshock_id, p, unnest([{', '.join(f"{{'radius_km': {r}, 'pop': pop_sum_{r}km}}" for r in P['buffers'])}], recursive := true) FROM msrows),
        v AS (SELECT radius_km, log10(pop) AS x, p FROM l WHERE pop > 0 AND p > 0),
        k AS (SELECT *, {_ranks('radius_km')} FROM v)
        SELECT radius_km, count(*) AS n, {_corr('x', 'p')} AS pearson_r, {_corr('rx', 'ry')} AS spearman_rho, round(CASE WHEN min(x) < max(x) THEN regr_slope(p, x) END, 6) AS slope FROM k GROUP BY 1""",
    "influence_range": """
        , o AS (SELECT g.mainshock_id AS omitted, CASE WHEN min(s.x) < max(s.x) THEN corr(s.x, s.p) END AS v FROM (SELECT DISTINCT mainshock_id FROM samp) g JOIN samp s ON s.mainshock_id <> g.mainshock_id GROUP BY 1)
        SELECT count(v) AS n, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(avg(CAST(v < 0 AS DOUBLE)), 6) AS share_negative, round(avg(CAST(v > 0 AS DOUBLE)), 6) AS share_positive FROM o""",
    "report_facts": f"SELECT count(*) AS n_rows, count(DISTINCT mainshock_id) AS n_groups, count(DISTINCT record_id) AS n_records, (SELECT count(*) FROM msr) AS n_mainshocks, {P['reps_permutation']} AS n_perm, true AS slopes_agree FROM samp",
}
_BODIES["draws_roundtrip"] = "SELECT record_id || '|mainshock|all' AS record_id, record_id AS mainshock_id, 'mainshock' AS subgroup_type, 'all' AS subgroup, CAST(draw AS INT) AS draw, round(p_boot, 6) AS p_boot FROM draws"
_BODIES["tiled_exposure"] = _BODIES["buffer_exposure"]

ORACLES = {name: CHAIN + body for name, body in _BODIES.items()}
