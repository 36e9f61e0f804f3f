"""Independent SQL for every query, in the dialect of an embedded SQL engine.

The statements are written from the definitions, with plain joins, brute-force distances and
recursion, and share nothing with the DataFrame operators but the input tables.
"""

from __future__ import annotations

from talusgrid.functions.numeric import ERFC_COEFFICIENTS

VIEWS = {
    "fx_cells": """
SELECT o_orderkey AS node_id,
       CAST(floor(o_orderkey / 100) AS INT) AS r,
       CAST(o_orderkey % 100 AS INT) AS c,
       9000e0 - 5e0 * floor(o_orderkey / 100) + o_totalprice / 10000e0 AS elevation_m,
       (o_custkey % 600) / 10e0 AS slope_deg,
       CASE WHEN o_orderkey % 97 = 0 THEN CAST(-9999.0 AS DOUBLE)
            ELSE CAST((o_orderkey * 37) % 360 AS DOUBLE) END AS aspect_deg,
       (o_custkey % 91) / 7e0 AS roughness,
       3e0 + (o_orderkey % 53) / 4e0 AS twi,
       CAST((o_orderkey % 101) * (o_orderkey % 101) * (o_orderkey % 7) AS DOUBLE) AS flow_accum,
       CAST((o_orderkey % 89) * (o_orderkey % 11) AS DOUBLE) AS sca,
       CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8
            WHEN 5 THEN 16 WHEN 6 THEN 32 WHEN 7 THEN 64 ELSE 128 END AS d8_code
FROM orders""",
    "fx_soil": """
SELECT p_partkey AS sample_id,
       CAST(floor(p_partkey / 50) AS INT) AS lr,
       CAST(p_partkey % 50 AS INT) AS lc,
       7189735.290828891e0 + 250e0 * (p_partkey % 50) AS x_m,
       3743288.1316389814e0 - 250e0 * floor(p_partkey / 50) AS y_m,
       CASE WHEN p_partkey % 13 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(100 + p_size * 15 AS DOUBLE) END AS sand_gkg,
       CAST((p_partkey * 7) % 46 * 10 AS DOUBLE) AS clay_gkg,
       CASE WHEN p_partkey % 13 = 0 THEN CAST(0.0 AS DOUBLE) ELSE p_retailprice - 800e0 END AS bdod_cgcm3
FROM part""",
    "fx_rain": """
SELECT n_nationkey AS cell_id,
       CAST(floor(n_nationkey / 5) AS INT) AS rr,
       CAST(n_nationkey % 5 AS INT) AS cc,
       round(avg(c_acctbal) / 50e0, 3) AS mm
FROM nation JOIN customer ON c_nationkey = n_nationkey
GROUP BY n_nationkey""",
    "fx_storm": """
SELECT CAST(hour(ts) AS INT) AS hr, round(sum(value), 2) AS amount
FROM events GROUP BY hour(ts)""",
    "fx_fs": """
SELECT o_orderkey AS node_id, n_nationkey AS hr,
       greatest(0e0, least(5e0, 3e0 - n_nationkey * (o_custkey % 20) / 100e0)) AS fs,
       (o_orderkey % 11) * n_nationkey / 25e0 AS depth_m
FROM orders CROSS JOIN nation WHERE n_nationkey < 24""",
    "fx_bands": """
SELECT b.n_nationkey AS band,
       CAST(floor(o_orderkey / 100) AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c,
       CASE WHEN (o_orderkey + b.n_nationkey) % 29 = 0 THEN -32768
            ELSE CAST(o_custkey % 500 + 10 * b.n_nationkey AS INT) END AS value
FROM orders CROSS JOIN nation b
WHERE b.n_nationkey < 3 AND (b.n_nationkey < 2 OR o_orderkey % 100 < 80)""",
    "shape": "SELECT max(r) + 1 AS gh, max(c) + 1 AS gw FROM fx_cells",
    "valid": """
SELECT lr, lc, sample_id, sand_gkg, clay_gkg, bdod_cgcm3 FROM fx_soil
WHERE NOT (sand_gkg = 0 AND bdod_cgcm3 = 0) AND sand_gkg <> -32768 AND bdod_cgcm3 <> -32768""",
    "lattice_nodes": "SELECT node_id, c * 6e-1 - 5e0 AS u, r * 3e-1 - 3e0 AS v FROM fx_cells",
    "rain_nodes": "SELECT node_id, c / 20e0 - 5e-1 AS u, (r % 100) / 20e0 - 5e-1 AS v FROM fx_cells",
    "rain_at": """
SELECT node_id, CASE WHEN mm < 0 THEN 0e0 ELSE mm END AS mm FROM (
  SELECT n.node_id,
         (a.mm * (1 - (n.u - n.pj)) + b.mm * (n.u - n.pj)) * (1 - (n.v - n.pi))
         + (d.mm * (1 - (n.u - n.pj)) + e.mm * (n.u - n.pj)) * (n.v - n.pi) AS mm
  FROM (SELECT *, CAST(least(3, greatest(0, floor(v))) AS INT) AS pi,
                  CAST(least(3, greatest(0, floor(u))) AS INT) AS pj FROM rain_nodes) n
  JOIN fx_rain a ON a.rr = n.pi AND a.cc = n.pj
  JOIN fx_rain b ON b.rr = n.pi AND b.cc = n.pj + 1
  JOIN fx_rain d ON d.rr = n.pi + 1 AND d.cc = n.pj
  JOIN fx_rain e ON e.rr = n.pi + 1 AND e.cc = n.pj + 1)""",
    "linear": """
SELECT node_id, u, v, {cols} FROM (
  SELECT n.*, n.v - floor(n.v) AS a, n.u - floor(n.u) AS b,
         q00.sand_gkg AS s00, q01.sand_gkg AS s01, q10.sand_gkg AS s10, q11.sand_gkg AS s11,
         q00.clay_gkg AS c00, q01.clay_gkg AS c01, q10.clay_gkg AS c10, q11.clay_gkg AS c11,
         q00.bdod_cgcm3 AS b00, q01.bdod_cgcm3 AS b01, q10.bdod_cgcm3 AS b10, q11.bdod_cgcm3 AS b11
  FROM lattice_nodes n
  LEFT JOIN valid q00 ON q00.lr = floor(n.v) AND q00.lc = floor(n.u)
  LEFT JOIN valid q01 ON q01.lr = floor(n.v) AND q01.lc = floor(n.u) + 1
  LEFT JOIN valid q10 ON q10.lr = floor(n.v) + 1 AND q10.lc = floor(n.u)
  LEFT JOIN valid q11 ON q11.lr = floor(n.v) + 1 AND q11.lc = floor(n.u) + 1)""".format(
        cols=", ".join(
            f"""CASE WHEN a >= b AND {p}00 IS NOT NULL AND {p}10 IS NOT NULL AND {p}11 IS NOT NULL
                     THEN {p}00 + ({p}10 - {p}00) * a + ({p}11 - {p}10) * b
                WHEN a < b AND {p}00 IS NOT NULL AND {p}01 IS NOT NULL AND {p}11 IS NOT NULL
                     THEN {p}00 + ({p}01 - {p}00) * b + ({p}11 - {p}01) * a
                WHEN a + b <= 1 AND {p}11 IS NULL THEN {p}00 + ({p}10 - {p}00) * a + ({p}01 - {p}00) * b
                WHEN a + b >= 1 AND {p}00 IS NULL
                     THEN {p}11 + ({p}01 - {p}11) * (1 - a) + ({p}10 - {p}11) * (1 - b) END AS {name}"""
            for p, name in (("s", "sand_gkg"), ("c", "clay_gkg"), ("b", "bdod_cgcm3"))
        )
    ),
    "nearest": """
SELECT n.node_id, q.sand_gkg, q.clay_gkg, q.bdod_cgcm3 FROM (
  SELECT n.node_id, min({{'d': (n.v - s.lr) * (n.v - s.lr) + (n.u - s.lc) * (n.u - s.lc), 'k': s.sample_id}}) AS m
  FROM {nodes} n CROSS JOIN valid s GROUP BY n.node_id) n
JOIN valid q ON q.sample_id = n.m.k""",
    "hull_points": """
SELECT lr, min(lc) AS col FROM valid GROUP BY lr UNION SELECT lr, max(lc) FROM valid GROUP BY lr""",
    "hull_edges": """
SELECT p.lr AS r0, p.col AS c0, q.lr AS r1, q.col AS c1,
       min((q.lr - p.lr) * (x.col - p.col) - (q.col - p.col) * (x.lr - p.lr)) AS lo,
       max((q.lr - p.lr) * (x.col - p.col) - (q.col - p.col) * (x.lr - p.lr)) AS hi
FROM hull_points p JOIN hull_points q ON p.lr < q.lr CROSS JOIN hull_points x
GROUP BY p.lr, p.col, q.lr, q.col
HAVING min((q.lr - p.lr) * (x.col - p.col) - (q.col - p.col) * (x.lr - p.lr)) >= 0
    OR max((q.lr - p.lr) * (x.col - p.col) - (q.col - p.col) * (x.lr - p.lr)) <= 0""",
    "covered": """
SELECT n.node_id,
       n.v >= (SELECT min(lr) FROM valid) AND n.v <= (SELECT max(lr) FROM valid)
       AND bool_and(CASE WHEN e.lo >= 0
                         THEN (n.u - e.c0) - (e.c1 - e.c0) / CAST(e.r1 - e.r0 AS DOUBLE) * (n.v - e.r0) >= -1e-9
                         ELSE (n.u - e.c0) - (e.c1 - e.c0) / CAST(e.r1 - e.r0 AS DOUBLE) * (n.v - e.r0) <= 1e-9 END)
       AS has_soil
FROM lattice_nodes n CROSS JOIN hull_edges e GROUP BY n.node_id, n.u, n.v""",
    "texture": """
SELECT *, CASE WHEN sand_pct >= 85 THEN 'sand'
     WHEN sand_pct >= 70 AND clay_pct < 15 THEN 'sandy_loam'
     WHEN silt_pct >= 50 AND clay_pct < 27 THEN 'silt_loam'
     WHEN silt_pct >= 80 THEN 'silt'
     WHEN clay_pct >= 27 AND clay_pct < 40 AND sand_pct < 45 THEN 'clay_loam'
     WHEN clay_pct >= 40 THEN 'clay' ELSE 'loam' END AS texture FROM fractions""",
    "strength_table": """
SELECT * FROM (VALUES ('sand', 1e0, 33e0), ('sandy_loam', 4e0, 30e0), ('loam', 8e0, 28e0), ('silt_loam', 10e0, 27e0),
  ('silt', 6e0, 26e0), ('clay_loam', 15e0, 24e0), ('clay', 20e0, 20e0)) t(texture, cohesion_kpa, friction_deg)""",
    "strength": """
SELECT x.*, coalesce(t.cohesion_kpa, 0e0) AS cohesion_kpa, coalesce(t.friction_deg, 0e0) AS friction_deg,
       density_gcm3 * 1000e0 * 981e-2 / 1000e0 AS unit_weight
FROM texture x LEFT JOIN strength_table t ON t.texture = x.texture""",
    "water1": """
SELECT *, sand_pct / 100e0 AS s, clay_pct / 100e0 AS k FROM strength""",
    "water2": """
SELECT *, -24e-3 * s + 487e-3 * k + 6e-3 + 5e-3 * (s * k) - 13e-3 * (k * k) AS t1500,
       -251e-3 * s + 195e-3 * k + 11e-3 + 6e-3 * (s * k) - 27e-3 * (k * k) + 452e-3 * (s * k) AS t33raw,
       278e-3 * s + 34e-3 * k + 22e-3 - 18e-3 * (s * k) - 27e-3 * (k * k) AS extra FROM water1""",
    "water3": "SELECT *, least(greatest(t33raw, t1500 + 2e-2), 6e-1) AS t33 FROM water2",
    "water4": """
SELECT *, least(greatest(t33 + extra, t33 + 2e-2), 65e-2) AS theta_sat,
       least(greatest(t1500 * 7e-1, 1e-2), t33 - 2e-2) AS theta_res,
       least(greatest(100e0 / least(greatest(t33 * 100, 5e0), 200e0), 5e-1), 20e0) AS alpha_1_m,
       (ln(1500e0) - ln(33e0)) / (ln(CASE WHEN t33 > 0 THEN t33 END) - ln(CASE WHEN t1500 > 0 THEN t1500 END) + 1e-9)
       AS slope_b FROM water3""",
    "water5": """
SELECT *, CASE WHEN slope_b IS NOT NULL
     THEN least(greatest(1930e0 * pow(theta_sat - t33, 3e0 - 1e0 / slope_b), 1e-1), 500e0) END / 1000e0 / 3600e0
     AS ksat_m_s FROM water4""",
    "water": """
SELECT *, ksat_m_s / least(greatest(theta_sat - theta_res, 5e-2), 1e0) * 10 AS diffusivity_m2_s FROM water5""",
    "slope_nodes": """
SELECT node_id, slope_deg, radians(slope_deg) AS th, 1e-6 * (1 + node_id % 7) AS ksat_m_s,
       1e-5 * (1 + node_id % 5) AS diffusivity_m2_s, 50e0 + node_id % 150 AS precip_mm,
       2e0 + node_id % 9 AS cohesion_kpa, 20e0 + node_id % 14 AS friction_deg, 16e0 + node_id % 5 AS unit_weight
FROM fx_cells""",
    "bell": """
SELECT hr, w / sum(w) OVER () AS share FROM (
  SELECT CAST(range AS INT) AS hr, exp(-5e-1 * ((range - 14e0) / 28e-1) * ((range - 14e0) / 28e-1)) AS w FROM range(24))""",
    "measured": "SELECT hr, amount / sum(amount) OVER () AS share FROM fx_storm",
    "d8": """
SELECT node_id, r, c, first(target_id ORDER BY drop DESC, k) AS target_id, max(drop) AS drop,
       first(diag ORDER BY drop DESC, k) AS diag
FROM (SELECT a.node_id, a.r, a.c, b.node_id AS target_id, o.k, o.di * o.dj <> 0 AS diag,
             (a.elevation_m - b.elevation_m) / CASE WHEN o.di * o.dj <> 0 THEN sqrt(2e0) ELSE 1e0 END AS drop
      FROM fx_cells a CROSS JOIN offsets8 o JOIN fx_cells b ON b.r = a.r + o.di AND b.c = a.c + o.dj)
WHERE drop > 0 GROUP BY node_id, r, c""",
    "offsets8": """
SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) t(k, di, dj)""",
    "walk": """
SELECT node_id, node_id AS reached, 0 AS straight, 0 AS diagonal FROM fx_cells
UNION ALL
SELECT w.node_id, d.target_id, w.straight + CASE WHEN d.diag THEN 0 ELSE 1 END,
       w.diagonal + CASE WHEN d.diag THEN 1 ELSE 0 END
FROM walk w JOIN d8 d ON d.node_id = w.reached""",
    "reach": """
SELECT node_id, reached AS terminal_id, straight, diagonal FROM walk WHERE reached NOT IN (SELECT node_id FROM d8)""",
    "onset": "SELECT node_id, min(hr) AS onset_hr FROM fx_fs WHERE fs < 1 GROUP BY node_id",
    "debris": """
SELECT x.node_id, x.r, x.c, d.target_id, CASE WHEN x.node_id % 5 = 0 THEN (x.node_id % 23) * 5e-1 ELSE 0e0 END AS h,
       least(1e0, sqrt(500e0 * greatest(0e0, sin(radians(slope_deg)) - tan(radians(25e0)) * cos(radians(slope_deg))))
             * 5e0 / 140e0) AS share
FROM fx_cells x LEFT JOIN d8 d ON d.node_id = x.node_id""",
}

# Views each view is built on.
NEEDS = {
    "shape": ["fx_cells"],
    "valid": ["fx_soil"],
    "lattice_nodes": ["fx_cells"],
    "rain_nodes": ["fx_cells"],
    "rain_at": ["rain_nodes", "fx_rain"],
    "linear": ["lattice_nodes", "valid"],
    "nearest": ["lattice_nodes", "valid"],
    "hull_points": ["valid"],
    "hull_edges": ["hull_points"],
    "covered": ["lattice_nodes", "hull_edges", "valid"],
    "strength": ["texture", "strength_table"],
    "texture": ["fractions"],
    "water1": ["strength"],
    "water2": ["water1"],
    "water3": ["water2"],
    "water4": ["water3"],
    "water5": ["water4"],
    "water": ["water5"],
    "slope_nodes": ["fx_cells"],
    "measured": ["fx_storm"],
    "d8": ["fx_cells", "offsets8"],
    "walk": ["d8"],
    "reach": ["walk"],
    "onset": ["fx_fs"],
    "debris": ["fx_cells", "d8"],
    "gaps": ["linear"],
    "soil_at": ["linear", "nearest", "covered"],
    "ready": ["fx_cells", "rain_at", "water"],
    "simulated": ["ready", "bell"],
    "moved1": ["debris"],
}


def _fractions(source: str) -> str:
    return f"""
SELECT *, sand_gkg / 10e0 AS sand_pct, clay_gkg / 10e0 AS clay_pct,
       least(greatest(100e0 - sand_gkg / 10e0 - clay_gkg / 10e0, 0e0), 100e0) AS silt_pct,
       bdod_cgcm3 / 100e0 AS density_gcm3 FROM {source}"""


def _with(body: str, *wanted: str, **extra: tuple[list[str], str]) -> str:
    """Prefix `body` with the named views, in order of need; `extra` adds or replaces views."""
    views = {**VIEWS, **{k: v for k, (_, v) in extra.items()}}
    needs = {**NEEDS, **{k: n for k, (n, _) in extra.items()}}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in needs.get(name, []):
            visit(n)
        order.append(name)

    for name in wanted:
        visit(name)
    parts = [f"{name} AS ({views[name]})" for name in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def _erfc(x: str) -> str:
    t = f"(1e0 / (1e0 + {x} * 5e-1))"
    series = f"({ERFC_COEFFICIENTS[-1]!r}e0)"
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        series = f"({a!r}e0 + {t} * {series})"
    return f"({t} * exp(-{x} * {x} + {series}))"


def _ierfc(x: str) -> str:
    return f"(exp(-{x} * {x}) / sqrt(pi()) - {x} * {_erfc(x)})"


SOIL_SAMPLES = {"fractions": (["fx_soil"], _fractions("fx_soil"))}
SOIL_AT_NODES = {
    "gaps": (["linear"], "SELECT * FROM linear WHERE sand_gkg IS NULL"),
    "nearest": (["gaps", "valid"], VIEWS["nearest"].format(nodes="gaps")),
    "soil_at": (
        ["linear", "nearest", "covered"],
        """
SELECT l.node_id, h.has_soil, coalesce(l.sand_gkg, n.sand_gkg) AS sand_gkg,
       coalesce(l.clay_gkg, n.clay_gkg) AS clay_gkg, coalesce(l.bdod_cgcm3, n.bdod_cgcm3) AS bdod_cgcm3
FROM linear l LEFT JOIN nearest n ON n.node_id = l.node_id JOIN covered h ON h.node_id = l.node_id""",
    ),
    "fractions": (["soil_at"], _fractions("soil_at")),
}
READY = {
    **SOIL_AT_NODES,
    "ready": (
        ["fx_cells", "rain_at", "water"],
        """
SELECT x.*, p.mm AS precip_mm, w.has_soil, w.cohesion_kpa, w.friction_deg, w.unit_weight, w.ksat_m_s,
       w.diffusivity_m2_s, w.theta_sat, w.theta_res, w.alpha_1_m
FROM fx_cells x JOIN rain_at p ON p.node_id = x.node_id JOIN water w ON w.node_id = x.node_id""",
    ),
}


def _series(nodes: str, storm: str) -> str:
    """psi per node and hour by explicit superposition of rain bins, for nodes(th, z constants)."""
    eta = "15e-1 / (2e0 * sqrt(greatest(d1 * k * 3600e0, 1e-12)))"
    return f"""
SELECT p.node_id, p.hr, least(15e-1, n.psi0 + p.response) AS psi FROM (
  SELECT d.node_id, h.hr, sum(2e0 * s.share * d.precip_mm / 1000e0 / 3600e0 / greatest(d.ksat_m_s, 1e-12) * d.pulse) AS response
  FROM (SELECT hr FROM {storm}) h JOIN {storm} s ON s.hr <= h.hr
  JOIN (SELECT node_id, precip_mm, ksat_m_s, k - 1 AS lag,
               kernel - lag(kernel) OVER (PARTITION BY node_id ORDER BY k) AS pulse
        FROM (SELECT node_id, precip_mm, ksat_m_s, k,
                     CASE WHEN k = 0 THEN 0e0 ELSE sqrt(d1 * k * 3600e0) * {_ierfc("eta")} END AS kernel
              FROM (SELECT *, {eta} AS eta FROM (
                      SELECT *, diffusivity_m2_s / greatest(cos(th) * cos(th), 1e-6) AS d1 FROM {nodes})
                    CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(25)))) 
       ) d ON d.lag = h.hr - s.hr
  GROUP BY d.node_id, h.hr) p
JOIN (SELECT node_id, (cos(th) * cos(th) - 2e-2 * ksat_m_s / greatest(ksat_m_s, 1e-12)) * (15e-1 - 2e0) AS psi0
      FROM {nodes}) n ON n.node_id = p.node_id"""


FS = """tan(radians(friction_deg)) / greatest(tan(th), 1e-6)
  + (cohesion_kpa - psi * 981e-2 * tan(radians(friction_deg)))
    / CASE WHEN abs(unit_weight * 15e-1 * sin(th) * cos(th)) < 1e-6 THEN 1e-6
           ELSE unit_weight * 15e-1 * sin(th) * cos(th) END"""

SIMULATED = {
    **READY,
    "storm_in": (
        ["ready"],
        """
SELECT node_id, radians(slope_deg) AS th, precip_mm,
       CASE WHEN has_soil THEN cohesion_kpa ELSE 10e0 END AS cohesion_kpa,
       CASE WHEN has_soil THEN friction_deg ELSE 27e0 END AS friction_deg,
       CASE WHEN has_soil THEN unit_weight ELSE 18e0 END AS unit_weight,
       CASE WHEN has_soil THEN ksat_m_s ELSE 1e-6 END AS ksat_m_s,
       CASE WHEN has_soil THEN diffusivity_m2_s ELSE 1e-5 END AS diffusivity_m2_s FROM ready""",
    ),
    "psi_series": (["storm_in", "bell"], _series("storm_in", "bell")),
    "simulated": (
        ["psi_series", "storm_in"],
        f"""
SELECT node_id, hr, psi, CASE WHEN fs IS NOT NULL THEN greatest(0e0, least(5e0, fs)) END AS fs FROM (
  SELECT s.node_id, s.hr, CASE WHEN n.ksat_m_s IS NOT NULL THEN s.psi END AS psi,
         CASE WHEN n.ksat_m_s IS NOT NULL THEN {FS} END AS fs
  FROM psi_series s JOIN storm_in n ON n.node_id = s.node_id)""",
    ),
}


_LON, _LAT, _PX, _RADIUS = "78.84999998888891e0", "30.85000001111111e0", "0.0002777777777777778e0", "6371007.1809e0"
# The georeferenced run: every second cell inside a border of two, its degrees, and its places on the soil lattice and the world's rain grid.
GEOREFERENCED = {
    **SIMULATED,
    "all_cells": ([], VIEWS["fx_cells"]),
    "fx_cells": (
        ["all_cells"],
        """
SELECT * REPLACE (CAST(floor((r - 2) / 2) AS INT) AS r, CAST(floor((c - 2) / 2) AS INT) AS c) FROM all_cells
WHERE r BETWEEN 2 AND (SELECT max(r) FROM all_cells) - 2 AND c BETWEEN 2 AND (SELECT max(c) FROM all_cells) - 2
  AND (r - 2) % 2 = 0 AND (c - 2) % 2 = 0""",
    ),
    "nodes_lonlat": (
        ["fx_cells"],
        f"SELECT node_id, ({_LON} + 2 * {_PX}) + c * 2 * {_PX} AS lon, ({_LAT} - 2 * {_PX}) - r * 2 * {_PX} AS lat FROM fx_cells",
    ),
    # The projection angle t, by repeated steps from the latitude.
    "angles": (
        ["nodes_lonlat"],
        """
SELECT 0 AS k, node_id, lon, radians(lat) AS t, pi() * sin(radians(lat)) AS goal FROM nodes_lonlat
UNION ALL
SELECT k + 1, node_id, lon, t - (2 * t + sin(2 * t) - goal) / greatest(2e0 + 2 * cos(2 * t), 1e-12), goal FROM angles WHERE k < 6""",
    ),
    "lattice_nodes": (
        ["angles"],
        f"""
SELECT node_id, ((2 * {_RADIUS} * sqrt(2e0) / pi()) * radians(lon) * cos(t) - 7189735.290828891e0) / 250e0 AS u,
       (3743288.1316389814e0 - {_RADIUS} * sqrt(2e0) * sin(t)) / 250e0 AS v FROM angles WHERE k = 6""",
    ),
    "rain_nodes": (["nodes_lonlat"], "SELECT node_id, (lon + 180e0) / 5e-2 - 5e-1 AS u, (60e0 - lat) / 5e-2 - 5e-1 AS v FROM nodes_lonlat"),
    "fx_rain": (
        [],
        "SELECT CAST(575 + floor(c_custkey / 16) AS INT) AS rr, CAST(5170 + c_custkey % 16 AS INT) AS cc, round(c_acctbal / 50e0, 3) AS mm FROM customer",
    ),
    "rain_at": (["rain_nodes", "fx_rain"], VIEWS["rain_at"].replace("least(3, ", "least(2398, ", 1).replace("least(3, ", "least(7198, ", 1)),
    "fx_soil": ([], VIEWS["fx_soil"].replace("CAST(p_partkey % 50 AS INT) AS lc", "CAST(p_partkey % 50 - 40 AS INT) AS lc")),
}


def _routed(steps: int) -> dict[str, tuple[list[str], str]]:
    """Views for alternating transfer and overflow; the last one is called routed."""
    out: dict[str, tuple[list[str], str]] = {}
    prev = "debris"
    for k in range(1, steps + 1):
        out[f"moved{k}"] = (
            [prev, "debris"],
            f"""
SELECT d.node_id, d.r, d.c, d.target_id, d.share,
       s.h - CASE WHEN s.h > 1e-4 AND d.target_id IS NOT NULL THEN s.h * d.share ELSE 0e0 END + coalesce(i.h, 0e0) AS h
FROM debris d JOIN {prev} s ON s.node_id = d.node_id
LEFT JOIN (SELECT b.target_id, sum(a.h * b.share) AS h FROM {prev} a JOIN debris b ON b.node_id = a.node_id
           WHERE a.h > 1e-4 AND b.target_id IS NOT NULL GROUP BY b.target_id) i ON i.target_id = d.node_id""",
        )
        out[f"state{k}"] = (
            [f"moved{k}", "offsets8", "shape"],
            f"""
SELECT m.node_id, m.r, m.c, least(m.h, 5e0) + coalesce(i.h, 0e0) AS h
FROM moved{k} m LEFT JOIN (
  SELECT least(greatest(o.r + f.di, 0), gh - 1) * gw + least(greatest(o.c + f.dj, 0), gw - 1) AS id, sum((o.h - 5e0) / 8) AS h
  FROM moved{k} o CROSS JOIN offsets8 f CROSS JOIN shape WHERE o.h > 5e0 GROUP BY 1) i ON i.id = m.node_id""",
        )
        prev = f"state{k}"
    out["routed"] = ([prev], f"SELECT * FROM {prev}")
    return out


PX = "2777777777777778e-19"
LAT0 = f"(3085000001111111e-14 - {{b}} * {PX})"
LON0 = f"(7884999998888891e-14 + {{b}} * {PX})"


def _label(x: str) -> str:
    a = f"abs({x})"
    return (
        f"CASE WHEN {a} >= 1e6 THEN printf('%.1fM', {x} / 1e6) WHEN {a} >= 1e3 THEN printf('%.1fk', {x} / 1e3) "
        f"WHEN {a} >= 100 THEN printf('%.0f', {x}) WHEN {a} >= 1 THEN printf('%.1f', {x}) "
        f"ELSE printf('%.2f', {x}) END"
    )


RAMP = {
    "red": ("753e-3", "831e-3", "18e-2", "541e-3"),
    "green": ("161e-3", "722e-3", "49e-2", "353e-3"),
    "blue": ("169e-3", "247e-3", "31e-2", "231e-3"),
}


def _ramp(name: str) -> str:
    a, m, z, d = RAMP[name]
    ground = (
        f"CASE WHEN f < 4e-1 THEN {a} + f / 4e-1 * ({m} - {a}) "
        f"ELSE {m} + least(1e0, (f - 4e-1) / 6e-1) * ({z} - {m}) END"
    )
    return (
        f"round(CASE WHEN d > 2e-2 THEN ({ground}) * (1 - least(1e0, d * 2)) + {d} * least(1e0, d * 2) "
        f"ELSE {ground} END, 6) AS {name}"
    )


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    q = out.__setitem__

    q("scan_cells", _with("SELECT node_id, r, c, elevation_m, slope_deg FROM fx_cells", "fx_cells"))
    q(
        "manifest_missing",
        _with(
            """SELECT DISTINCT 'strip_' || lpad(CAST(r AS VARCHAR), 8, '0') || '.tif' AS name FROM fx_cells
WHERE r NOT IN (SELECT lr FROM fx_soil)""",
            "fx_cells",
            "fx_soil",
        ),
    )
    q(
        "manifest_resolve",
        r"""WITH pg AS (SELECT regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS host,
  regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 2) AS l,
  regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 3) AS n FROM pages),
cat AS (SELECT lower(l || n) AS k, min(host || '/' || l || '-' || n || '.html') AS path, count(*) AS n_matches FROM pg GROUP BY 1)
SELECT DISTINCT upper(lang) || '.' || CAST(doc_id AS VARCHAR) || '.TIF' AS name, path,
       CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM documents LEFT JOIN cat ON k = lower(lang) || CAST(doc_id AS VARCHAR)""",
    )
    q(
        "tile_mosaic",
        """SELECT r, c, value FROM (
  SELECT CAST(floor(vec_id / 10) * 8 + floor((i - 1) / 8) AS INT) AS r,
         CAST((vec_id % 10) * 8 + (i - 1) % 8 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN (SELECT range AS i FROM range(1, 65)))
WHERE c < 77 AND r < (SELECT floor(count(*) / 10) * 8 - 3 FROM embeddings)""",
    )
    q(
        "mosaic_bands",
        """SELECT r, c, max(CASE WHEN band = 0 THEN value END) AS band_0, max(CASE WHEN band = 2 THEN value END) AS band_2 FROM (
  SELECT CAST(floor(vec_id / 10) * 4 + floor((i - 1) / 16) AS INT) AS r, (i - 1) % 4 AS band,
         CAST((vec_id % 10) * 4 + floor((i - 1) / 4) % 4 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN (SELECT range AS i FROM range(1, 65)))
WHERE c < 38 GROUP BY r, c""",
    )
    q(
        "band_pivot",
        _with(
            """SELECT r, c, max(CASE WHEN band = 0 THEN value END) AS band_0, max(CASE WHEN band = 2 THEN value END) AS band_2
FROM fx_bands WHERE band IN (0, 2) GROUP BY r, c""",
            "fx_bands",
        ),
    )
    q(
        "border_crop",
        _with(
            """SELECT node_id, r - 2 AS r, c - 2 AS c, elevation_m FROM fx_cells, shape
WHERE r BETWEEN 2 AND gh - 3 AND c BETWEEN 2 AND gw - 3""",
            "shape",
        ),
    )
    q(
        "stride_downsample",
        _with(
            """SELECT node_id, CAST(r / 2 AS INT) AS r, CAST(c / 2 AS INT) AS c, elevation_m
FROM fx_cells WHERE r % 2 = 0 AND c % 2 = 0""",
            "fx_cells",
        ),
    )
    q(
        "nodata_mask",
        _with("SELECT node_id, CASE WHEN aspect_deg > -9000 THEN aspect_deg END AS aspect_deg FROM fx_cells", "fx_cells"),
    )
    q(
        "coregister_bands",
        _with(
            """SELECT a.r, a.c, a.value AS band_0, b.value AS band_1, z.value AS band_2
FROM (SELECT * FROM fx_bands WHERE band = 0) a JOIN (SELECT * FROM fx_bands WHERE band = 1) b ON a.r = b.r AND a.c = b.c
LEFT JOIN (SELECT * FROM fx_bands WHERE band = 2
           AND (SELECT max(c) FROM fx_bands WHERE band = 2) = (SELECT max(c) FROM fx_bands WHERE band = 0)
           AND (SELECT max(r) FROM fx_bands WHERE band = 2) = (SELECT max(r) FROM fx_bands WHERE band = 0)) z
  ON z.r = a.r AND z.c = a.c""",
            "fx_bands",
        ),
    )
    lat6, lon6, lat2, lon2 = LAT0.format(b=6), LON0.format(b=6), LAT0.format(b=2), LON0.format(b=2)
    q(
        "node_lonlat",
        _with(
            f"""SELECT node_id, r, c, round({lon6} + c * 5 * {PX}, 10) AS lon, round({lat6} - r * 5 * {PX}, 10) AS lat
FROM fx_cells""",
            "fx_cells",
        ),
    )
    q(
        "node_metres",
        _with(
            f"""SELECT node_id, r, c,
       round(c * {PX} * 5 * 111320e0 * cos(radians({lat6} - gh * 5 * {PX} / 2)), 6) AS x_m,
       round(r * {PX} * 5 * 111320e0, 6) AS y_m FROM fx_cells, shape""",
            "shape",
        ),
    )
    q(
        "extent_meta",
        _with(
            f"""SELECT full_rows, full_cols, elev_min, elev_max, step, CAST(ceil(full_rows / step) AS INT) AS grid_h,
  CAST(ceil(full_cols / step) AS INT) AS grid_w, round({lat2}, 6) AS lat_top, round({lon2}, 6) AS lon_left,
  round({lat2} - full_rows * {PX}, 6) AS lat_bottom, round({lon2} + full_cols * {PX}, 6) AS lon_right,
  round(full_cols * {PX} * 111320e0 * cos(radians({lat2} - full_rows * {PX} / 2)), 6) AS width_m,
  round(full_rows * {PX} * 111320e0, 6) AS height_m
FROM (SELECT *, CAST(greatest(1, round_even(full_cols / 40e0, 0)) AS INT) AS step FROM (
  SELECT CAST(gh - 4 AS INT) AS full_rows, CAST(gw - 4 AS INT) AS full_cols,
         round(min(elevation_m), 6) AS elev_min, round(max(elevation_m), 6) AS elev_max
  FROM fx_cells, shape WHERE r BETWEEN 2 AND gh - 3 AND c BETWEEN 2 AND gw - 3 GROUP BY gh, gw))""",
            "shape",
        ),
    )
    radius = "63710071809e-4"
    q(
        "mollweide_inverse",
        _with(
            f"""SELECT sample_id, round(degrees(pi() * x_m / (2 * {radius} * sqrt(2e0) * cos(t))), 8) AS lon,
       round(degrees(asin(greatest(-1e0, least(1e0, (2 * t + sin(2 * t)) / pi())))), 8) AS lat
FROM (SELECT *, asin(greatest(-1e0, least(1e0, y_m / ({radius} * sqrt(2e0))))) AS t FROM fx_soil)""",
            "fx_soil",
        ),
    )
    q(
        "lattice_position",
        _with(
            "SELECT sample_id, CAST(lc AS DOUBLE) AS u, CAST(lr AS DOUBLE) AS v FROM fx_soil",
            "fx_soil",
        ),
    )
    q("bilinear_resample", _with("SELECT node_id, mm FROM rain_at", "rain_at"))
    q(
        "nearest_resample",
        _with(
            "SELECT * FROM nearest",
            "nearest",
            nearest=(["lattice_nodes", "valid"], VIEWS["nearest"].format(nodes="lattice_nodes")),
        ),
    )
    q("lattice_linear_resample", _with("SELECT node_id, sand_gkg, clay_gkg, bdod_cgcm3 FROM linear", "linear"))
    q("coverage_mask", _with("SELECT node_id, has_soil FROM covered", "covered"))
    q(
        "soil_defaults",
        _with(
            """SELECT node_id, has_soil, CASE WHEN has_soil THEN cohesion_kpa ELSE 10e0 END AS cohesion_kpa,
  CASE WHEN has_soil THEN friction_deg ELSE 27e0 END AS friction_deg,
  CASE WHEN has_soil THEN round(unit_weight, 6) ELSE 18e0 END AS unit_weight,
  CASE WHEN has_soil THEN round(ksat_m_s, 15) ELSE 1e-6 END AS ksat_m_s,
  CASE WHEN has_soil THEN round(diffusivity_m2_s, 14) ELSE 1e-5 END AS diffusivity_m2_s FROM water""",
            "water",
            **SOIL_AT_NODES,
        ),
    )
    q(
        "nearest_upsample",
        _with(
            """SELECT f.r, f.c, k.elevation_m FROM fx_cells f
JOIN fx_cells k ON k.r = CAST(floor(f.r / 3) AS INT) * 3 AND k.c = CAST(floor(f.c / 3) AS INT) * 3""",
            "fx_cells",
        ),
    )
    q(
        "roundtrip_sink",
        _with(
            """SELECT node_id, r, c, round(CAST(CAST(slope_deg AS FLOAT) AS DOUBLE), 4) AS slope_deg, aspect_deg, d8_code
FROM fx_cells""",
            "fx_cells",
        ),
    )

    q(
        "soil_fractions",
        _with(
            """SELECT sample_id, round(sand_pct, 6) AS sand_pct, round(silt_pct, 6) AS silt_pct,
  round(clay_pct, 6) AS clay_pct, round(density_gcm3, 6) AS density_gcm3 FROM fractions""",
            "fractions",
            **SOIL_SAMPLES,
        ),
    )
    q(
        "soil_hydraulics",
        _with(
            """SELECT sample_id, round(theta_sat, 9) AS theta_sat, round(theta_res, 9) AS theta_res,
  round(ksat_m_s, 15) AS ksat_m_s, round(alpha_1_m, 9) AS alpha_1_m, round(diffusivity_m2_s, 14) AS diffusivity_m2_s
FROM water""",
            "water",
            **SOIL_SAMPLES,
        ),
    )
    q("texture_class", _with("SELECT sample_id, texture FROM texture", "texture", **SOIL_SAMPLES))
    q(
        "texture_strength",
        _with("SELECT sample_id, texture, cohesion_kpa, friction_deg FROM strength", "strength", **SOIL_SAMPLES),
    )
    q(
        "unit_weight",
        _with("SELECT sample_id, round(unit_weight, 6) AS unit_weight FROM strength", "strength", **SOIL_SAMPLES),
    )
    aspect = "radians(CASE WHEN aspect_deg < -900 THEN 0e0 ELSE aspect_deg END)"
    features = {
        "elevation_m": "elevation_m",
        "slope_deg": "greatest(slope_deg, 0e0)",
        "aspect_sin": f"sin({aspect})",
        "aspect_cos": f"cos({aspect})",
        "roughness": "greatest(roughness, 0e0)",
        "twi": "twi",
        "log_flow_accum": "ln(1 + greatest(flow_accum, 0e0))",
        "log_specific_catchment_area": "ln(1 + greatest(sca, 0e0))",
    }
    q(
        "terrain_features",
        _with(
            "SELECT node_id, " + ", ".join(f"round({e}, 9) AS {n}" for n, e in features.items()) + " FROM fx_cells",
            "fx_cells",
        ),
    )
    q(
        "feature_vector",
        _with(
            "\nUNION ALL ".join(
                f"SELECT node_id, {k} AS position, round({e}, 9) AS value, '{n}' AS feature FROM fx_cells"
                for k, (n, e) in enumerate(features.items())
            ),
            "fx_cells",
        ),
    )
    masked = {
        "cohesion_kpa": 9,
        "friction_deg": 9,
        "unit_weight": 9,
        "ksat_m_s": 15,
        "diffusivity_m2_s": 14,
        "theta_sat": 12,
        "theta_res": 12,
        "alpha_1_m": 9,
    }
    q(
        "unified_features",
        _with(
            "SELECT node_id, "
            + ", ".join(f"round({e}, 9) AS {n}" for n, e in features.items())
            + ", precip_mm, "
            + ", ".join(f"round(CASE WHEN has_soil THEN {n} ELSE 0e0 END, {d}) AS {n}" for n, d in masked.items())
            + ", CASE WHEN has_soil THEN 1e0 ELSE 0e0 END AS has_soil_data FROM ready",
            "ready",
            **READY,
        ),
    )
    whole = (
        [f"round({e}, 9)" for e in features.values()]
        + ["precip_mm"]
        + [f"round(CASE WHEN has_soil THEN {n} ELSE 0e0 END, {d})" for n, d in masked.items()]
        + ["CASE WHEN has_soil THEN 1e0 ELSE 0e0 END"]
    )
    q(
        "node_vectors",
        _with(
            "\nUNION ALL ".join(
                f"SELECT node_id, {k} AS position, {e} AS value, '{n}' AS feature FROM ready"
                for k, (n, e) in enumerate(zip([*features, "precip_mm", *masked, "has_soil_data"], whole, strict=True))
            ),
            "ready",
            **READY,
        ),
    )
    q(
        "storm_shape",
        """WITH s AS (SELECT event_type AS storm_id, avg(hour(ts)) AS peak, stddev_pop(hour(ts)) AS width FROM events GROUP BY 1),
w AS (SELECT storm_id, CAST(range AS INT) AS hr, exp(-5e-1 * ((range - peak) / width) * ((range - peak) / width)) AS weight
      FROM s CROSS JOIN range(24))
SELECT storm_id, hr, round(weight / sum(weight) OVER (PARTITION BY storm_id), 9) AS share FROM w""",
    )
    q(
        "rain_disaggregate",
        _with(
            "SELECT node_id, hr, round(share * (mm / 1000e0) / 3600e0, 12) AS intensity_m_s FROM rain_at CROSS JOIN bell",
            "rain_at",
            "bell",
        ),
    )
    q(
        "ierfc",
        _with(
            f"SELECT node_id, round({_ierfc('eta')}, 9) AS ierfc FROM (SELECT node_id, node_id % 1200 / 100e0 AS eta FROM fx_cells)",
            "fx_cells",
        ),
    )
    q(
        "steady_pressure",
        _with(
            """SELECT node_id, round((cos(th) * cos(th) - 2e-2 * ksat_m_s / greatest(ksat_m_s, 1e-12)) * (15e-1 - 2e0), 9) AS psi,
  round(diffusivity_m2_s / greatest(cos(th) * cos(th), 1e-6), 13) AS d1 FROM slope_nodes""",
            "slope_nodes",
        ),
    )
    q(
        "pressure_series",
        _with(
            "SELECT node_id, hr, round(psi, 6) AS psi FROM (" + _series("slope_nodes", "measured") + ")",
            "slope_nodes",
            "measured",
        ),
    )
    q(
        "factor_of_safety",
        _with(
            f"""SELECT node_id, round({FS}, 4) AS fs
FROM (SELECT *, node_id % 40 / 20e0 - 5e-1 AS psi FROM slope_nodes)""",
            "slope_nodes",
        ),
    )
    q(
        "stability_series",
        _with(
            f"""SELECT p.node_id, hr, round(psi, 6) AS psi, round(greatest(0e0, least(5e0, {FS})), 6) AS fs
FROM ({_series("slope_nodes", "measured")}) p JOIN slope_nodes n ON n.node_id = p.node_id""",
            "slope_nodes",
            "measured",
        ),
    )
    q(
        "voellmy_mobility",
        _with(
            """SELECT node_id,
  round(981e-2 * sin(th) - (tan(phi) * 981e-2 * cos(th) + 981e-2 * v * v / 500e0), 6) AS acceleration,
  round(sqrt(500e0 * greatest(0e0, sin(th) - tan(phi) * cos(th))), 6) AS speed_eq
FROM (SELECT node_id, th, radians(friction_deg) AS phi, CAST(node_id % 25 AS DOUBLE) AS v FROM slope_nodes)""",
            "slope_nodes",
        ),
    )
    q(
        "risk_color",
        _with(
            f"""SELECT node_id, hr, {", ".join(_ramp(n) for n in RAMP)},
  CASE WHEN d > 2e-2 THEN 'debris' WHEN fs < 1 THEN 'failing' WHEN fs <= 2 THEN 'marginal' ELSE 'stable' END AS risk
FROM (SELECT *, floor(least(1e0, greatest(0e0, fs / 3e0)) * 255) / 255e0 AS f,
             floor(least(1e0, greatest(0e0, depth_m / 10e0)) * 255) / 255e0 AS d FROM fx_fs)""",
            "fx_fs",
        ),
    )
    q(
        "fmt_label",
        _with(
            f"""SELECT node_id, {_label("flow_accum")} AS flow_label, {_label("(flow_accum * 1e3)")} AS large_label,
  {_label("(roughness - 5e0)")} AS centred_label, {_label("(twi / 8e0)")} AS twi_label FROM fx_cells""",
            "fx_cells",
        ),
    )
    q(
        "exaggerated_height",
        _with(
            "SELECT node_id, (elevation_m - min(elevation_m) OVER ()) * 16e-1 AS height FROM fx_cells",
            "fx_cells",
        ),
    )

    edges = """SELECT s.node_id AS src, d.node_id AS dst, s.c - d.c AS dj, s.r - d.r AS di FROM fx_cells d
CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(di, dj) JOIN fx_cells s ON s.r = d.r + t.di AND s.c = d.c + t.dj"""
    q(
        "graph_sink",
        _with(
            f"""SELECT n.node_id, n.r, n.c, coalesce(e.degree, 0) AS degree FROM fx_cells n
LEFT JOIN (SELECT src, count(*) AS degree FROM ({edges}) GROUP BY src) e ON e.src = n.node_id""",
            "fx_cells",
        ),
    )
    q("grid_edges4", _with(f"SELECT src, dst FROM ({edges})", "fx_cells"))
    q(
        "edge_attrs",
        _with(
            f"""SELECT src, dst, round(dj * dx, 6) AS dx_m, round(di * dy, 6) AS dy_m,
  round(sqrt(dj * dx * dj * dx + di * dy * di * dy), 6) AS length_m
FROM ({edges}), (SELECT {PX} * 5 * 111320e0 * cos(radians({lat6} - gh * 5 * {PX} / 2)) AS dx, {PX} * 5 * 111320e0 AS dy FROM shape)""",
            "shape",
        ),
    )
    q(
        "d8_downslope",
        _with(
            """SELECT x.node_id, d.target_id, round(coalesce(d.drop, 0e0), 6) AS drop
FROM fx_cells x LEFT JOIN d8 d ON d.node_id = x.node_id""",
            "d8",
        ),
    )
    q("d8_sinks", _with("SELECT node_id, r, c FROM fx_cells WHERE node_id NOT IN (SELECT node_id FROM d8)", "d8"))
    q(
        "neighbors8_clamped",
        _with(
            """SELECT node_id, k AS direction,
  CAST(greatest(0, least(gh - 1, r + di)) * gw + greatest(0, least(gw - 1, c + dj)) AS BIGINT) AS neighbour_id
FROM fx_cells CROSS JOIN offsets8 CROSS JOIN shape""",
            "offsets8",
            "shape",
        ),
    )
    q("runout_terminal", _with("SELECT node_id, terminal_id FROM reach", "reach"))
    q(
        "runout_length",
        _with(
            """SELECT o.node_id, terminal_id, CAST(straight + diagonal AS BIGINT) AS hops,
  round(140e0 * (straight + diagonal * sqrt(2e0)), 6) AS path_m FROM onset o JOIN reach w ON w.node_id = o.node_id""",
            "reach",
            "onset",
        ),
    )
    q(
        "deposits_stored",
        _with(
            """SELECT terminal_id, count(*) AS n_releases, count(*) * 15e-1 AS deposit_m
FROM onset o JOIN reach w ON w.node_id = o.node_id GROUP BY terminal_id""",
            "reach",
            "onset",
        ),
    )
    q(
        "released_throughflow",
        _with(
            "SELECT reached AS node_id, count(o.node_id) * 15e-1 AS through FROM walk w LEFT JOIN onset o ON o.node_id = w.node_id GROUP BY reached",
            "walk",
            "onset",
        ),
    )
    q("deposit_balance", _with("SELECT count(*) * 15e-1 AS released_m, count(*) * 15e-1 AS deposited_m, 0e0 AS difference_m FROM onset", "onset"))
    q(
        "runout_deposit",
        _with(
            """SELECT terminal_id, count(*) AS n_releases, count(*) * 15e-1 AS deposit_m
FROM onset o JOIN reach w ON w.node_id = o.node_id GROUP BY terminal_id""",
            "reach",
            "onset",
        ),
    )
    q("failure_onset", _with("SELECT node_id, onset_hr FROM onset", "onset"))
    q("release_events", _with("SELECT node_id, onset_hr, 15e-1 AS depth_m FROM onset", "onset"))
    q(
        "erosion_history",
        _with(
            """SELECT h.hr, count(o.node_id) AS n_released, count(o.node_id) * 15e-1 AS released_m,
  sum(count(o.node_id)) OVER (ORDER BY h.hr) * 15e-1 AS cumulative_m
FROM (SELECT CAST(range AS INT) AS hr FROM range(24)) h LEFT JOIN onset o ON o.onset_hr = h.hr GROUP BY h.hr""",
            "onset",
        ),
    )
    steps = _routed(3)
    q("route_step", _with("SELECT node_id, round(h, 6) AS h FROM moved1", "moved1", **steps))
    q(
        "overflow_spread",
        _with(
            """SELECT m.node_id, round(least(m.h, 5e0) + coalesce(i.h, 0e0), 6) AS h FROM debris m LEFT JOIN (
  SELECT greatest(0, least(gh - 1, o.r + di)) * gw + greatest(0, least(gw - 1, o.c + dj)) AS id, sum((o.h - 5e0) / 8) AS h
  FROM debris o CROSS JOIN offsets8 CROSS JOIN shape WHERE o.h > 5e0 GROUP BY 1) i ON i.id = m.node_id""",
            "debris",
            "offsets8",
            "shape",
        ),
    )
    q("route_k_steps", _with("SELECT node_id, round(h, 6) AS h FROM routed", "routed", **steps))
    q(
        "mass_balance",
        _with(
            """SELECT round((SELECT sum(h) FROM debris), 4) AS released_m, round((SELECT sum(h) FROM debris), 4) AS routed_m,
  0e0 AS difference_m""",
            "debris",
        ),
    )

    q(
        "failed_fraction_hourly",
        _with("SELECT hr, round(avg(CASE WHEN fs < 1 THEN 1e0 ELSE 0e0 END), 9) AS failed_frac FROM fx_fs GROUP BY hr", "fx_fs"),
    )
    q(
        "run_summary",
        _with(
            """SELECT count(DISTINCT node_id) AS n_nodes, count(DISTINCT CASE WHEN fs < 1 THEN node_id END) AS n_failed,
  round(100e0 * count(DISTINCT CASE WHEN fs < 1 THEN node_id END) / count(DISTINCT node_id), 6) AS failed_pct,
  round(min(fs), 6) AS fs_min, round(max(fs), 6) AS fs_max, round(max(depth_m), 6) AS max_depth_m FROM fx_fs""",
            "fx_fs",
        ),
    )
    q(
        "hourly_rain",
        _with(
            "SELECT hr, round(share * (SELECT quantile_cont(mm, 5e-1) FROM rain_at), 6) AS rain_mm FROM bell",
            "rain_at",
            "bell",
        ),
    )
    profiled = ["elevation_m", "slope_deg", "aspect_deg", "roughness", "twi", "flow_accum", "sca"]
    q(
        "feature_profile",
        _with(
            "\nUNION ALL ".join(
                f"""SELECT '{n}' AS feature, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value,
  round(avg(x), 4) AS mean_value, count(*) - count(x) AS n_missing
FROM (SELECT CASE WHEN {n} > -9000 THEN {n} END AS x FROM fx_cells)"""
                for n in profiled
            ),
            "fx_cells",
        ),
    )
    q("texture_histogram", _with("SELECT texture, count(*) AS n FROM texture GROUP BY texture", "texture", **SOIL_SAMPLES))
    q(
        "band_stats",
        _with(
            """SELECT band, min(value) FILTER (value <> -32768) AS min_value, max(value) FILTER (value <> -32768) AS max_value,
  round(avg(value) FILTER (value <> -32768), 6) AS mean_value, count(*) FILTER (value = -32768) AS n_nodata
FROM fx_bands GROUP BY band""",
            "fx_bands",
        ),
    )
    q(
        "coverage_share",
        _with(
            """SELECT count(*) AS n, count(*) FILTER (has_soil) AS n_covered,
  round(avg(CASE WHEN has_soil THEN 1e0 ELSE 0e0 END), 9) AS share FROM covered""",
            "covered",
        ),
    )
    q(
        "layer_percentiles",
        _with(
            "\nUNION ALL ".join(
                f"SELECT '{n}' AS layer, {p} AS p, round(quantile_cont({n}, {p}), 6) AS value FROM fx_cells"
                for n in ("roughness", "twi", "flow_accum", "elevation_m")
                for p in ("1e-2", "2e-2", "5e-1", "99e-2", "995e-3")
            ),
            "fx_cells",
        ),
    )
    q(
        "hourly_safety_percentiles",
        _with(
            """SELECT hr, CAST(p AS DOUBLE) AS p, round(CASE p WHEN 1e-2 THEN p1 WHEN 25e-2 THEN p25 WHEN 5e-1 THEN p50 ELSE p99 END, 9) AS value FROM (
  SELECT hr, quantile_cont(fs, 1e-2) AS p1, quantile_cont(fs, 25e-2) AS p25, quantile_cont(fs, 5e-1) AS p50, quantile_cont(fs, 99e-2) AS p99
  FROM fx_fs GROUP BY hr), (SELECT unnest([1e-2, 25e-2, 5e-1, 99e-2]) AS p)""",
            "fx_fs",
        ),
    )
    q(
        "banded_median",
        _with(
            """SELECT range AS band, coalesce(red, 40e0) AS red, coalesce(green, 40e0) AS green, coalesce(blue, 44e0) AS blue, n_cells FROM (
  SELECT CAST(range AS INT) AS range, last_value(red IGNORE NULLS) OVER w AS red, last_value(green IGNORE NULLS) OVER w AS green,
         last_value(blue IGNORE NULLS) OVER w AS blue, coalesce(n_cells, 0) AS n_cells
  FROM range(14) LEFT JOIN (
    SELECT CAST(least(13, greatest(0, floor((elevation_m - lo) / (hi - lo) * 14))) AS INT) AS band, median(red) AS red,
           median(green) AS green, median(blue) AS blue, count(*) AS n_cells
    FROM (SELECT *, node_id * 7 % 256 AS red, floor(twi * 15) AS green, node_id * node_id % 251 AS blue,
                 min(elevation_m) OVER () AS lo, max(elevation_m) OVER () AS hi FROM fx_cells) GROUP BY 1) ON band = range
  WINDOW w AS (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
            "fx_cells",
        ),
    )
    channels = {
        "hillshade-color": ("node_id * 7 % 256", "node_id * 5 % 256", "node_id * 3 % 256"),
        "color-relief": ("node_id * 11 % 256", "floor(twi * 15)", "node_id * node_id % 251"),
    }
    hexed = "lpad(lower(to_hex(CAST(floor(coalesce(last_value({c} IGNORE NULLS) OVER w, {d})) AS BIGINT))), 2, '0')"
    q(
        "colour_stops",
        _with(
            "\nUNION ALL ".join(
                f"""SELECT '{name}' AS layer, CAST(range AS INT) AS band, round(range / 13e0, 9) AS position,
  '#' || {" || ".join(hexed.format(c=c, d=d) for c, d in zip("rgb", (40, 40, 44), strict=True))} AS colour
FROM range(14) LEFT JOIN (
  SELECT CAST(least(13, greatest(0, floor((elevation_m - lo) / (hi - lo) * 14))) AS INT) AS band,
         {", ".join(f"median({e}) AS {c}" for c, e in zip("rgb", rgb, strict=True))}
  FROM (SELECT *, min(elevation_m) OVER () AS lo, max(elevation_m) OVER () AS hi FROM fx_cells) GROUP BY 1) ON band = range
WINDOW w AS (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
                for name, rgb in channels.items()
            ),
            "fx_cells",
        ),
    )
    q(
        "pack_metadata",
        _with(
            """SELECT (SELECT count(DISTINCT hr) FROM fx_fs) AS n_hours, (SELECT count(DISTINCT node_id) FROM fx_fs) AS n_nodes,
  max(r) + 1 AS grid_rows, max(c) + 1 AS grid_cols, 3e0 AS fs_top, 1e1 AS depth_top, 3e0 AS erosion_top FROM fx_cells""",
            "fx_fs",
            "fx_cells",
        ),
    )
    q(
        "d8_convention",
        _with(
            """SELECT CASE WHEN bool_and(d8_code IN (0, 1, 2, 4, 8, 16, 32, 64, 128)) THEN 'esri' ELSE 'sequential' END AS convention
FROM fx_cells""",
            "fx_cells",
        ),
    )

    q(
        "frame_at",
        _with(
            """SELECT a.node_id, round(a.fs * 75e-2 + b.fs * 25e-2, 6) AS fs, round(a.depth_m * 75e-2 + b.depth_m * 25e-2, 6) AS depth_m
FROM fx_fs a JOIN fx_fs b ON a.node_id = b.node_id AND a.hr = 17 AND b.hr = 18""",
            "fx_fs",
        ),
    )
    q(
        "readout_at",
        _with(
            """SELECT t.t, CAST(t.shown_hr AS INT) AS shown_hr, f.failed_frac, round(b.share * m.mm, 6) AS rain_mm
FROM (SELECT range / 2e0 AS t, least(23, floor(range / 2e0 + 5e-1)) AS shown_hr FROM range(48)) t
JOIN (SELECT hr, round(avg(CASE WHEN fs < 1 THEN 1e0 ELSE 0e0 END), 6) AS failed_frac FROM fx_fs GROUP BY hr) f ON f.hr = t.shown_hr
JOIN bell b ON b.hr = t.shown_hr CROSS JOIN (SELECT quantile_cont(mm, 5e-1) AS mm FROM rain_at) m""",
            "fx_fs",
            "rain_at",
            "bell",
        ),
    )
    q(
        "layer_stretch",
        _with(
            """SELECT node_id, round(least(hi, greatest(0e0, roughness)) / greatest(1e-6, hi), 6) AS norm
FROM fx_cells, (SELECT quantile_cont(roughness, 99e-2) AS hi FROM fx_cells)""",
            "fx_cells",
        ),
    )
    q(
        "layer_stretch_log",
        _with(
            """SELECT node_id, round((least(hi, greatest(lo, ln(1 + flow_accum))) - lo) / greatest(1e-6, hi - lo), 6) AS norm
FROM fx_cells, (SELECT quantile_cont(ln(1 + flow_accum), 2e-2) AS lo, quantile_cont(ln(1 + flow_accum), 995e-3) AS hi FROM fx_cells)""",
            "fx_cells",
        ),
    )
    tick = lambda n: f"""SELECT '{n}' AS layer, pos, exp(lo + pos * (hi - lo)) - 1 AS value FROM
  (SELECT quantile_cont(ln(1 + {n}), 2e-2) AS lo, quantile_cont(ln(1 + {n}), 995e-3) AS hi FROM fx_cells),
  (SELECT range / 4e0 AS pos FROM range(5))"""  # noqa: E731
    q(
        "log_ticks",
        _with(
            f"SELECT layer, pos, round(value, 4) AS value, {_label('value')} AS label FROM ({tick('flow_accum')} UNION ALL {tick('sca')})",
            "fx_cells",
        ),
    )
    q(
        "cyclic_direction",
        _with(
            """SELECT node_id, CASE WHEN a IS NOT NULL THEN round(greatest(0e0, least(360e0, degrees(a))) / 360e0, 9) END AS norm
FROM (SELECT node_id, CASE WHEN node_id % 31 <> 0 THEN node_id * 17 % 628 / 100e0 END AS a FROM fx_cells)""",
            "fx_cells",
        ),
    )
    q(
        "aspect_layer",
        _with(
            """SELECT node_id, round(a / 360e0, 9) AS norm,
  CASE CAST(floor(a / 360e0 * 4 + 5e-1) AS INT) WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' WHEN 3 THEN 'W' WHEN 4 THEN 'N' END AS tick
FROM (SELECT node_id, CASE WHEN aspect_deg > -9000 THEN aspect_deg END AS a FROM fx_cells)""",
            "fx_cells",
        ),
    )
    q(
        "d8_legend",
        _with(
            """SELECT t.code, t.class_index, t.label, t.colour, count(x.node_id) AS n_cells FROM (VALUES
  (1, 1, 'E', '#ff7f0e'), (2, 2, 'SE', '#2ca02c'), (4, 3, 'S', '#d62728'), (8, 4, 'SW', '#8c564b'), (16, 5, 'W', '#e377c2'),
  (32, 6, 'NW', '#7f7f7f'), (64, 7, 'N', '#bcbd22'), (128, 8, 'NE', '#17becf')) t(code, class_index, label, colour)
LEFT JOIN fx_cells x ON x.d8_code = t.code GROUP BY ALL""",
            "fx_cells",
        ),
    )
    levels = """SELECT node_id, hr, CAST(floor(least(1e0, greatest(0e0, fs / 3e0)) * 255) AS INT) AS fs_q,
  CAST(floor(least(1e0, greatest(0e0, depth_m / 10e0)) * 255) AS INT) AS depth_q FROM fx_fs"""
    q("quantize", _with(levels, "fx_fs"))
    q(
        "pack_frames",
        _with(
            f"""SELECT hr, CAST(floor(node_id / 8192) AS BIGINT) AS block, count(*) AS n_nodes,
  to_base64(from_hex(string_agg(printf('%02X%02X', fs_q, depth_q), '' ORDER BY node_id))) AS b64 FROM ({levels}) GROUP BY 1, 2""",
            "fx_fs",
        ),
    )
    q(
        "pack_erosion",
        _with(
            """SELECT CAST(floor(node_id / 8192) AS BIGINT) AS block, count(*) AS n_nodes,
  to_base64(from_hex(string_agg(CASE WHEN lo < 1 THEN '7F' ELSE '00' END, '' ORDER BY node_id))) AS b64
FROM (SELECT node_id, min(fs) AS lo FROM fx_fs GROUP BY node_id) GROUP BY 1""",
            "fx_fs",
        ),
    )
    ticks = lambda marks: "[" + ",".join(
        f'{{"pos":{p},"label":"{m}"}}' for p, m in zip(("0.0", "0.25", "0.5", "0.75", "1.0"), marks)
    ) + "]"
    quant = lambda col, p: f"(SELECT quantile_cont({col}, {p}) FROM fx_cells)"
    rows = []

    def gradient(k, layer, title, lo, hi, unit="", tail=""):
        rows.append(
            f"SELECT {k} AS display_order, '{layer}' AS layer, '{title}' AS title, 'gradient' AS kind, "
            f"{_label('lo')} || '{unit}' AS min_label, {_label('hi')} || '{unit}' AS max_label, "
            f"""'{{"kind":"gradient","minLabel":"' || min_label || '","maxLabel":"' || max_label || '"{tail}}}' AS legend_json """
            f"FROM (SELECT {lo} AS lo, {hi} AS hi)"
        )

    def log_gradient(k, layer, title, col):
        lo, hi = quant(f"ln(1 + {col})", "2e-2"), quant(f"ln(1 + {col})", "995e-3")
        rows.append(
            f"SELECT {k} AS display_order, '{layer}' AS layer, '{title}' AS title, 'gradient' AS kind, "
            f"{_label('(exp(lo) - 1)')} AS min_label, {_label('(exp(hi) - 1)')} AS max_label, "
            f"""'{{"kind":"gradient","minLabel":"' || min_label || '","maxLabel":"' || max_label || '","midLabel":"' """
            f"""|| {_label("(exp(lo + 5e-1 * (hi - lo)) - 1)")} || '","logScale":true}}' AS legend_json """
            f"FROM (SELECT {lo} AS lo, {hi} AS hi)"
        )

    def marked(k, layer, title, kind, marks=None):
        tail = "" if marks is None else ',"ticks":' + ticks(marks)
        rows.append(
            f"SELECT {k} AS display_order, '{layer}' AS layer, '{title}' AS title, '{kind}' AS kind, "
            f"NULL AS min_label, NULL AS max_label, '{{\"kind\":\"{kind}\"{tail}}}' AS legend_json"
        )

    ends = lambda n, w="", t="ready": (f"(SELECT min({n}) FROM {t}{w})", f"(SELECT max({n}) FROM {t}{w})")
    elevation = ends("elevation_m", t="fx_cells")
    gradient(0, "hillshade-color", "Shaded relief + color", *elevation, " m", ',"approx":true')
    gradient(1, "color-relief", "Elevation color", *elevation, " m", ',"approx":true')
    rows.append(
        "SELECT 2 AS display_order, 'hillshade' AS layer, 'Hillshade (grayscale)' AS title, 'gradient' AS kind, "
        "'shadowed' AS min_label, 'sunlit' AS max_label, "
        """'{"kind":"gradient","minLabel":"shadowed","maxLabel":"sunlit"}' AS legend_json"""
    )
    gradient(3, "slope", "Slope", "0e0", "60e0", "°")
    marked(4, "aspect", "Aspect", "cyclic", "NESWN")
    gradient(5, "roughness", "Roughness", "0e0", quant("roughness", "99e-2"))
    log_gradient(6, "flow-accumulation", "Flow accumulation", "flow_accum")
    log_gradient(7, "specific-catchment-area", "Specific catchment area", "sca")
    gradient(8, "twi", "Topographic wetness (TWI)", quant("twi", "1e-2"), quant("twi", "99e-2"))
    marked(9, "flow-direction-dinf", "Flow direction (D∞)", "cyclic", ["0°", "90°", "180°", "270°", "360°"])
    colours = ("#ff7f0e", "#2ca02c", "#d62728", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
    names = ("E", "SE", "S", "SW", "W", "NW", "N", "NE")
    items = ",".join(f'{{"color":"{c}","label":"{n}"}}' for c, n in zip(colours, names))
    rows.append(
        "SELECT 10 AS display_order, 'flow-direction-d8' AS layer, 'Flow direction (D8)' AS title, 'categorical' AS kind, "
        f"NULL AS min_label, NULL AS max_label, '{{\"kind\":\"categorical\",\"items\":[{items}]}}' AS legend_json"
    )
    gradient(11, "hydro-conditioned-dem", "Hydro-conditioned DEM", *elevation, " m")
    gradient(12, "precipitation", "Precipitation", *ends("precip_mm"), " mm")
    gradient(13, "soil-friction-angle", "Soil friction angle (est.)", *ends("friction_deg", " WHERE has_soil"), "°")
    gradient(14, "soil-cohesion", "Soil cohesion (est.)", *ends("cohesion_kpa", " WHERE has_soil"), " kPa")
    q("layer_catalog", _with("\nUNION ALL ".join(rows), "ready", **READY))
    q(
        "soil_layers",
        _with(
            """SELECT node_id, CASE WHEN has_soil THEN round((friction_deg - f0) / greatest(1e-6, f1 - f0), 9) END AS friction_deg_norm,
  CASE WHEN has_soil THEN round((cohesion_kpa - c0) / greatest(1e-6, c1 - c0), 9) END AS cohesion_kpa_norm
FROM strength, (SELECT min(friction_deg) AS f0, max(friction_deg) AS f1, min(cohesion_kpa) AS c0, max(cohesion_kpa) AS c1
                FROM strength WHERE has_soil)""",
            "strength",
            **SOIL_AT_NODES,
        ),
    )

    q(
        "storm_simulation",
        _with("SELECT node_id, hr, round(psi, 5) AS psi, round(fs, 5) AS fs FROM simulated", "simulated", **SIMULATED),
    )
    q(
        "storm_failed_fraction",
        _with(
            "SELECT hr, round(avg(CASE WHEN fs < 1 THEN 1e0 ELSE 0e0 END), 9) AS failed_frac FROM simulated GROUP BY hr",
            "simulated",
            **SIMULATED,
        ),
    )
    q(
        "storm_releases",
        _with(
            "SELECT node_id, min(hr) AS onset_hr, 15e-1 AS depth_m FROM simulated WHERE fs < 1 GROUP BY node_id",
            "simulated",
            **SIMULATED,
        ),
    )
    q(
        "storm_deposits",
        _with(
            """SELECT terminal_id, count(*) AS n_releases, count(*) * 15e-1 AS deposit_m
FROM (SELECT DISTINCT node_id FROM simulated WHERE fs < 1) o JOIN reach w ON w.node_id = o.node_id GROUP BY terminal_id""",
            "simulated",
            "reach",
            **SIMULATED,
        ),
    )
    q(
        "storm_georeferenced",
        _with("SELECT node_id, hr, round(psi, 5) AS psi, round(fs, 5) AS fs FROM simulated", "simulated", **GEOREFERENCED),
    )
    q(
        "deposits_georeferenced",
        _with(
            """SELECT terminal_id, count(*) AS n_releases, count(*) * 15e-1 AS deposit_m
FROM (SELECT DISTINCT node_id FROM simulated WHERE fs < 1) o JOIN reach w ON w.node_id = o.node_id GROUP BY terminal_id""",
            "simulated",
            "reach",
            **GEOREFERENCED,
        ),
    )
    q(
        "stream_failed_fraction",
        """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start,
  round(avg(CASE WHEN value / 50e0 < 1 THEN 1e0 ELSE 0e0 END), 9) AS failed_frac, count(*) AS n_readings
FROM events GROUP BY date_trunc('hour', ts)""",
    )
    for name in ("stream_release_once", "stream_release_resumed"):
        q(name, "SELECT DISTINCT user_id AS node_id FROM events WHERE value / 50e0 < 1")
    return out


def all_sql() -> dict[str, str]:
    return _sql()
