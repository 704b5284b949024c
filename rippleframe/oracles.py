"""DuckDB SQL for the queries of queries.py, written from the operators' definitions on the same tables."""

from __future__ import annotations

from .functions.rng import uniform_sql as U
from .queries import DRAWS, SEEDS, P

RAW = "raw AS (SELECT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_discount = b.l_discount AND a.l_linenumber < b.l_linenumber)"
COMP = f"""{RAW}, simple AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM raw WHERE u <> v),
both0 AS (SELECT u, v FROM simple UNION ALL SELECT v, u FROM simple),
reach(node, lab) USING KEY (node) AS (SELECT DISTINCT u, u FROM both0 UNION SELECT b.v, min(r.lab) FROM reach r JOIN both0 b ON b.u = r.node JOIN recurring.reach c ON c.node = b.v WHERE r.lab < c.lab GROUP BY b.v),
comp AS (SELECT node, lab AS comp FROM reach)"""
NET = f"""{COMP}, big AS (SELECT comp FROM comp GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1),
ids AS (SELECT node AS original_id, row_number() OVER (ORDER BY node) - 1 AS node FROM comp WHERE comp = (SELECT comp FROM big)),
edges AS (SELECT a.node AS u, b.node AS v FROM simple s JOIN ids a ON a.original_id = s.u JOIN ids b ON b.original_id = s.v),
arcs AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges),
deg AS (SELECT u AS node, count(*) AS k FROM arcs GROUP BY u), nn AS (SELECT count(*) AS n FROM ids)"""
SHELL = f"""{NET}, s1 AS (SELECT u AS src, v AS node FROM arcs),
s2 AS (SELECT a.src, b.v AS node FROM s1 a JOIN arcs b ON b.u = a.node EXCEPT (SELECT * FROM s1 UNION ALL SELECT node, node FROM deg)),
s3 AS (SELECT a.src, b.v AS node FROM s2 a JOIN arcs b ON b.u = a.node EXCEPT (SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
shell AS (SELECT node AS src, node, 0 AS d FROM deg UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3)"""
TRI = """cn AS (SELECT e.u, e.v, count(b.v) AS c FROM edges e JOIN arcs a ON a.u = e.u LEFT JOIN arcs b ON b.u = e.v AND b.v = a.v GROUP BY e.u, e.v),
ends AS (SELECT u, v, c FROM cn UNION ALL SELECT v, u, c FROM cn), tri AS (SELECT u AS node, (sum(c) / 2)::BIGINT AS t FROM ends GROUP BY u)"""
EGO = f"""{TRI}, lv AS (SELECT e.u AS node, sum(d.k - e.c - 1) AS o FROM ends e JOIN deg d ON d.node = e.v GROUP BY e.u),
ego AS (SELECT node, t AS triangle_count, CASE WHEN k > 1 THEN t / (k * (k - 1) / 2.0) ELSE 0 END AS clustering_coefficient, k + 1 AS ego_net_size, t + k AS ego_net_edges, (t + k) / ((k + 1) * k / 2.0) AS ego_net_density, o::BIGINT AS edges_leaving_ego, k - 2.0 * t / k AS effective_size, o / (t + k + o)::DOUBLE AS boundary_porosity FROM deg JOIN tri USING (node) JOIN lv USING (node))"""
B2 = """w2 AS (SELECT a.u AS i, a.v AS j, b.v AS l FROM arcs a JOIN arcs b ON a.u = b.u AND a.v < b.v WHERE NOT EXISTS (SELECT 1 FROM arcs x WHERE x.u = a.v AND x.v = b.v)),
wc AS (SELECT j, l, count(*) AS c FROM w2 GROUP BY j, l),
b2 AS (SELECT d.node, coalesce(s.b, 0.0) AS b_2 FROM deg d LEFT JOIN (SELECT i AS node, sum(1.0 / c) AS b FROM w2 JOIN wc USING (j, l) GROUP BY i) s USING (node))"""


def live(p: str, draws: int, seed: int, name: str = "lv0") -> str:
    return f"""{name} AS (SELECT draw, u, v FROM edges, (SELECT unnest(range(0, {draws}))::INTEGER AS draw) WHERE {U('u', 'v', 'draw', str(seed))} < {p})"""


def perc(p: str, draws: int, seed: int, n: str = "") -> str:
    """Components of the live graph per draw."""
    return f"""{live(p, draws, seed, f'lv{n}')}, lb{n} AS (SELECT draw, u, v FROM lv{n} UNION ALL SELECT draw, v, u FROM lv{n}),
rc{n}(draw, node, lab) USING KEY (draw, node) AS (SELECT draw, node, node FROM deg, (SELECT unnest(range(0, {draws}))::INTEGER AS draw) UNION SELECT r.draw, b.v, min(r.lab) FROM rc{n} r JOIN lb{n} b ON b.draw = r.draw AND b.u = r.node JOIN recurring.rc{n} c ON c.draw = b.draw AND c.node = b.v WHERE r.lab < c.lab GROUP BY r.draw, b.v),
pc{n} AS (SELECT draw, node, lab AS comp FROM rc{n}),
perc{n} AS (SELECT draw, node, comp, count(*) OVER (PARTITION BY draw, comp)::INTEGER AS size FROM pc{n})"""


STATS = """st AS (SELECT node, avg(size) AS spread_mean, stddev_samp(size) AS spread_std, avg((size > 0.05 * (SELECT n FROM nn))::INTEGER::DOUBLE) AS spread_ignition, count(*) AS c FROM perc GROUP BY node)"""
PERC = f"{NET}, {perc(str(P), DRAWS, 0)}"
CELLS = f"""{SHELL}, {EGO}, {B2}, sf AS (SELECT src AS node, sum((d > 0 AND d <= 2)::INTEGER)::DOUBLE AS r2, sum((d > 0)::INTEGER)::DOUBLE AS r3, sum(CASE WHEN d = 2 THEN k - 1 ELSE 0 END) AS c2, sum(CASE WHEN d = 3 THEN k - 1 ELSE 0 END) AS c3 FROM shell JOIN deg USING (node) GROUP BY src),
nd AS (SELECT u AS node, sum(k) AS x1 FROM arcs JOIN deg ON deg.node = arcs.v GROUP BY u),
wide AS (SELECT deg.node, round(b_2, 6) AS y, k::DOUBLE AS x0, x1::DOUBLE AS x1, edges_leaving_ego::DOUBLE AS y1, r2, r3, ((k - 1) * c2)::DOUBLE AS c2, ((k - 1) * c3)::DOUBLE AS c3 FROM deg JOIN nd USING (node) JOIN ego USING (node) JOIN sf USING (node) JOIN b2 USING (node)),
rules AS (SELECT node, y, 0 AS radius, 'node' AS richness, x0 AS x FROM wide UNION ALL SELECT node, y, 1, 'node', x1 FROM wide UNION ALL SELECT node, y, 2, 'node', r2 FROM wide UNION ALL SELECT node, y, 3, 'node', r3 FROM wide
 UNION ALL SELECT node, y, 0, 'all', x0 FROM wide UNION ALL SELECT node, y, 1, 'all', y1 FROM wide UNION ALL SELECT node, y, 2, 'all', c2 FROM wide UNION ALL SELECT node, y, 3, 'all', c3 FROM wide),
lng AS (SELECT node, y, radius, richness, seed, x + 0.001::DOUBLE * {U('node', 'seed')} AS x FROM rules, (SELECT unnest(range(0, {SEEDS}))::INTEGER AS seed)),
cells AS (SELECT a.radius, a.richness, a.seed, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x)))::DOUBLE * sum(abs(sign(a.y - b.y)))), 9) AS kendall_tau FROM lng a JOIN lng b ON a.radius = b.radius AND a.richness = b.richness AND a.seed = b.seed AND a.node < b.node GROUP BY ALL)"""
LARGEST = ", ".join([NET, *(perc(str(m / 10), 6, 2, str(m)) for m in (2, 4, 6))]) + ", lt AS (" + " UNION ALL ".join(f"SELECT {m} AS m, draw, max(size) AS s1 FROM perc{m} GROUP BY draw" for m in (2, 4, 6)) + "), chi AS (SELECT m, var_samp(s1) / avg(s1) AS chi FROM lt GROUP BY m)"


def q(prelude: str, body: str) -> str:
    return f"WITH RECURSIVE {prelude} {body}"


def _ladder() -> str:
    parts, prev = [], "SELECT node, k AS h FROM deg"
    for s in (1, 2, 3):
        parts.append(f"h{s} AS (SELECT u AS node, max(least(h, r)) AS h FROM (SELECT a.u, p.h, row_number() OVER (PARTITION BY a.u ORDER BY p.h DESC) AS r FROM arcs a JOIN ({prev}) p ON p.node = a.v) GROUP BY u)")
        prev = f"SELECT node, h FROM h{s}"
    return ", ".join(parts)


def _five(c: str, name: str, total: bool = False, digits: int = 6) -> str:
    s = f"round(avg({c}), {digits}) AS {name}_mean, round(max({c}), {digits})::DOUBLE AS {name}_max, round(min({c}), {digits})::DOUBLE AS {name}_min, round(stddev_pop({c}), {digits}) AS {name}_std"
    return s + (f", round(sum({c}), 6)::DOUBLE AS {name}_sum" if total else "")


def _shell_features() -> str:
    at = {(c, d): f"coalesce(max(CASE WHEN d = {d} THEN {e} END), 0)" for c, e in (("n", "n"), ("ks", "ks"), ("km", "km"), ("kx", "kx")) for d in (1, 2, 3)}
    cols = ", ".join(f"{v} AS {c}{d}" for (c, d), v in at.items())
    out = []
    for d in (2, 3):
        out += [f"n{d}::BIGINT AS shell_{d}_count", f"round(km{d}, 6)::DOUBLE AS shell_{d}_degree_mean", f"kx{d}::BIGINT AS shell_{d}_degree_max", f"round(CASE WHEN n{d - 1} > 0 THEN n{d} / n{d - 1}::DOUBLE ELSE 0 END, 6) AS growth_ratio_{d}", f"({' + '.join(f'n{j}' for j in range(1, d + 1))})::BIGINT AS reach_within_{d}"]
    for d in (1, 2, 3):
        out += [f"((k - 1) * (ks{d} - n{d}))::BIGINT AS collective_influence_{d}", f"round(k * ({' + '.join(f'ks{j} / {j * j}.0::DOUBLE' for j in range(1, d + 1))}), 6) AS local_gravity_{d}"]
    return f"""per AS (SELECT src, d, count(*) AS n, sum(k) AS ks, avg(k) AS km, max(k) AS kx FROM shell JOIN deg USING (node) WHERE d > 0 GROUP BY src, d),
wd AS (SELECT deg.node, k, {cols} FROM deg JOIN per ON per.src = deg.node GROUP BY deg.node, k) SELECT node, {', '.join(out)} FROM wd"""


def oracle_sql() -> dict[str, str]:
    out = {
        "flagship_influencers": q(f"{SHELL}, {_ladder()}", "SELECT ids.node, original_id, deg.k AS degree, h1.h AS h_index_1, ((max(deg.k) - 1) * coalesce(sum(CASE WHEN d = 2 THEN x.k - 1 END), 0))::BIGINT AS collective_influence_2, sum((d IN (1, 2))::INTEGER)::BIGINT AS reach_within_2 FROM ids JOIN deg USING (node) JOIN h1 USING (node) JOIN shell ON shell.src = ids.node JOIN deg x ON x.node = shell.node GROUP BY ids.node, original_id, deg.k, h1.h ORDER BY collective_influence_2 DESC, node LIMIT 20"),
        "p1_p4_cleaning_counts": f"WITH {RAW}, dir AS (SELECT u, v, count(*) AS n FROM raw WHERE u <> v GROUP BY u, v), fold AS (SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS ways FROM dir GROUP BY 1, 2) SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM raw WHERE u = v) AS self_loops, (SELECT sum(n - 1) FROM dir)::BIGINT AS multi_edges, (SELECT count(*) FROM fold WHERE ways = 2) AS reciprocals, (SELECT count(*) FROM fold) AS simple_edges",
        "p6_components": q(COMP, "SELECT node, comp FROM comp"),
        "p5_p8_network_nodes": q(NET, "SELECT node, original_id, k AS degree FROM ids JOIN deg USING (node)"),
        "p9_s13_neighbour_lists": q(NET, "SELECT u AS node, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM arcs GROUP BY u"),
        "p11_directed_arcs": f"WITH {RAW} SELECT u, count(*) AS out_degree, sum(v)::BIGINT AS sum_v FROM (SELECT DISTINCT u, v FROM raw WHERE u <> v) GROUP BY u",
        "p12_p13_deleted_edges": q(NET, f"SELECT deg.node, coalesce(c, 0)::DOUBLE AS degree, 0.0::DOUBLE AS triangle_count FROM deg LEFT JOIN (SELECT node, count(*) AS c FROM (SELECT unnest([u, v]) AS node FROM edges WHERE {U('u', 'v', '3')} >= 0.2) GROUP BY node) USING (node)"),
        "p14_ball_arcs": q(SHELL, "SELECT a.src, count(*) AS arcs FROM shell a JOIN arcs ON arcs.u = a.node JOIN shell b ON b.src = a.src AND b.node = arcs.v WHERE a.d <= 1 AND b.d <= 1 GROUP BY a.src"),
        "p15_observer_view": q(SHELL, "SELECT src, (inside + 2 * (total - inside))::BIGINT AS arcs, (total - inside)::BIGINT AS stubs FROM (SELECT a.src, count(*) AS total, sum((b.node IS NOT NULL)::INTEGER) AS inside FROM shell a JOIN arcs ON arcs.u = a.node LEFT JOIN shell b ON b.src = a.src AND b.node = arcs.v AND b.d <= 1 WHERE a.d <= 1 GROUP BY a.src)"),
        "f1_degree": q(NET, "SELECT node, k AS degree, round(k / greatest(n - 1, 1)::DOUBLE, 6) AS degree_normalized FROM deg, nn"),
        "f2_f7_ego": q(f"{NET}, {EGO}", "SELECT node, triangle_count, round(clustering_coefficient, 6)::DOUBLE AS clustering_coefficient, ego_net_size, ego_net_edges, round(ego_net_density, 6)::DOUBLE AS ego_net_density, edges_leaving_ego, round(effective_size, 6)::DOUBLE AS effective_size, round(boundary_porosity, 6) AS boundary_porosity FROM ego"),
        "f8_f9_edges": q(f"{NET}, {TRI}", f"SELECT node, {_five('c', 'edge_embeddedness', digits=9)}, {_five('o', 'edge_overlap', digits=9)} FROM (SELECT u AS node, c, CASE WHEN a.k + b.k - 2 - c <> 0 THEN c / (a.k + b.k - 2 - c)::DOUBLE ELSE 0 END AS o FROM ends JOIN deg a ON a.node = u JOIN deg b ON b.node = v) GROUP BY node"),
        "f10_f11_f28_neighbour_degree": q(NET, "SELECT u AS node, round(avg(k), 6) AS nbr_degree_mean, max(k)::DOUBLE AS nbr_degree_max, min(k)::DOUBLE AS nbr_degree_min, round(stddev_pop(k), 6) AS nbr_degree_std, sum(k)::BIGINT AS nbr_degree_sum, round(avg(k) - count(*), 6) AS assortativity_local, round(max(h), 6) + 0.0 AS local_entropy, round(CASE WHEN count(*) > 1 THEN max(h) / ln(count(*)) ELSE 0 END, 6) AS local_entropy_norm, (sum(k) - count(*))::BIGINT AS nbw_2 FROM (SELECT u, d.k, sum(-(d.k / t) * ln(d.k / t)) OVER (PARTITION BY u) AS h FROM (SELECT u, v, sum(k) OVER (PARTITION BY u)::DOUBLE AS t FROM arcs JOIN deg ON deg.node = v) x JOIN deg d ON d.node = x.v) GROUP BY u"),
        "f12_ego_betweenness": q(f"{NET}, {B2}", "SELECT d.node, round(coalesce(s, 0), 6)::DOUBLE AS ego_betweenness FROM deg d LEFT JOIN (SELECT i AS node, sum(1.0 / (1 + c)) AS s FROM (SELECT w.i, w.j, w.l, count(y.v) AS c FROM w2 w JOIN arcs n ON n.u = w.i LEFT JOIN arcs x ON x.u = w.j AND x.v = n.v LEFT JOIN arcs y ON y.u = w.l AND y.v = x.v GROUP BY w.i, w.j, w.l) GROUP BY i) USING (node)"),
        "f13_cluster_rank": q(f"{NET}, {EGO}", "SELECT node, round(pow(10, -clustering_coefficient) * (s + k), 6) AS cluster_rank FROM ego JOIN deg USING (node) JOIN (SELECT u AS node, sum(k) AS s FROM arcs JOIN deg ON deg.node = v GROUP BY u) USING (node)"),
        "f14_f15_h_index_ladder": q(f"{NET}, {_ladder()}", "SELECT node, h1.h AS h_index_1, h2.h AS h_index_2, h3.h AS h_index_3 FROM h1 JOIN h2 USING (node) JOIN h3 USING (node)"),
        "f17_shell_counts": q(SHELL, "SELECT src, d, count(*) AS n, sum(node)::BIGINT AS sum_node FROM shell GROUP BY src, d"),
        "f16_f22_shell_features": q(f"{SHELL}, " + _shell_features().split(" SELECT node, n2")[0], "SELECT node, n2" + _shell_features().split(" SELECT node, n2")[1]),
        "f21_ball2": q(SHELL, "SELECT src AS node, e::BIGINT AS ball2_edges, round(CASE WHEN n > 1 THEN e / (n * (n - 1) / 2.0) ELSE 0 END, 6)::DOUBLE AS ball2_density, round((vol - 2 * e) / vol::DOUBLE, 6) AS local_conductance_2 FROM (SELECT src, count(*) AS n, sum(k) AS vol FROM shell JOIN deg USING (node) WHERE d <= 2 GROUP BY src) JOIN (SELECT a.src, count(*) / 2 AS e FROM shell a JOIN arcs ON arcs.u = a.node JOIN shell b ON b.src = a.src AND b.node = arcs.v WHERE a.d <= 2 AND b.d <= 2 GROUP BY a.src) USING (src)"),
        "f23_neighbour_triangles": q(f"{NET}, {EGO}", f"SELECT arcs.u AS node, {_five('clustering_coefficient', 'nbr_clustering', True)}, {_five('triangle_count', 'nbr_triangles', True)} FROM arcs JOIN ego ON ego.node = arcs.v GROUP BY arcs.u"),
        "f24_semilocal": q(SHELL, "SELECT u AS node, sum(b)::BIGINT AS semilocal_centrality, round(avg(b), 6) AS nbr_reach2_mean FROM arcs JOIN (SELECT src, count(*) AS b FROM shell WHERE d <= 2 GROUP BY src) ON src = v GROUP BY u"),
        "f25_percolation_reach": q(
            f"""{SHELL}, q1 AS (SELECT src, node, {P}::DOUBLE AS q FROM s1),
            q2 AS (SELECT t.src, t.node, 1 - exp(sum(ln(1 - {P}::DOUBLE * q1.q))) AS q FROM s2 t JOIN arcs ON arcs.v = t.node JOIN q1 ON q1.src = t.src AND q1.node = arcs.u GROUP BY 1, 2),
            q3 AS (SELECT t.src, t.node, 1 - exp(sum(ln(1 - {P}::DOUBLE * q2.q))) AS q FROM s3 t JOIN arcs ON arcs.v = t.node JOIN q2 ON q2.src = t.src AND q2.node = arcs.u GROUP BY 1, 2)""",
            "SELECT node, round(1 + coalesce(a, 0) + coalesce(b, 0), 6) AS perc_reach_2, round(1 + coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS perc_reach_3 FROM deg LEFT JOIN (SELECT src AS node, sum(q) AS a FROM q1 GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, sum(q) AS b FROM q2 GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, sum(q) AS c FROM q3 GROUP BY 1) USING (node)",
        ),
        "f26_a16_coverage": q(SHELL, "SELECT radius, round(quantile_cont(share, 0.25), 6) AS q25, round(quantile_cont(share, 0.5), 6) AS q50, round(quantile_cont(share, 0.75), 6) AS q75, round(avg((share > 0.5)::INTEGER), 6) AS over_half FROM (SELECT r AS radius, src, count(*) / (SELECT n FROM nn)::DOUBLE AS share FROM shell, (SELECT unnest([1, 2, 3]) AS r) WHERE d <= r GROUP BY r, src) GROUP BY radius"),
        "f27_walk_counts": q(NET, "SELECT node, k AS nbw_1, w2 AS nbw_2, w3 AS nbw_3 FROM deg JOIN (SELECT a.u AS node, count(b.v) AS w2 FROM arcs a LEFT JOIN arcs b ON b.u = a.v AND b.v <> a.u GROUP BY a.u) USING (node) JOIN (SELECT a.u AS node, count(c.v) AS w3 FROM arcs a LEFT JOIN arcs b ON b.u = a.v AND b.v <> a.u LEFT JOIN arcs c ON c.u = b.v AND c.v <> b.u GROUP BY a.u) USING (node)"),
        "f29_branch_anisotropy": q(f"{SHELL}, lk AS (SELECT c.src, c.node AS v, a.u FROM s2 c JOIN arcs a ON a.v = c.node JOIN s1 p ON p.src = c.src AND p.node = a.u), ms AS (SELECT src, u, sum(w) AS w FROM (SELECT src, u, 1.0 / count(*) OVER (PARTITION BY src, v) AS w FROM lk) GROUP BY src, u), sh AS (SELECT src, w / sum(w) OVER (PARTITION BY src) AS p FROM ms)", "SELECT deg.node, round(coalesce(m, 0), 6)::DOUBLE AS branch_max_share, round(coalesce(e, 0), 6) + 0.0 AS branch_entropy, m IS NULL AS branch_empty FROM deg LEFT JOIN (SELECT src AS node, max(p) AS m, sum(-p * ln(p)) AS e FROM sh GROUP BY src) USING (node)"),
        "d1_edge_probability": q(NET, f"SELECT u, v, CASE floor({U('u', 'v', '5')} * 3) WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 ELSE 0.1 END::DOUBLE AS p FROM edges"),
        "d2_arc_probability": q(NET, "SELECT u, v, round(1.0 / k, 6)::DOUBLE AS p FROM arcs JOIN deg ON deg.node = v"),
        "d3_d9_percolation": q(PERC, "SELECT * FROM perc"),
        "d4_direct_cascades": q(f"{NET}, dl AS (SELECT draw, u, v FROM arcs JOIN deg ON deg.node = v, (SELECT unnest(range(0, 4))::INTEGER AS draw) WHERE {U('u', 'v', 'draw', '1')} < 1.0 / k), dr(src, draw, node) AS (SELECT node, draw, node FROM deg, (SELECT unnest(range(0, 4))::INTEGER AS draw) UNION SELECT r.src, r.draw, l.v FROM dr r JOIN dl l ON l.draw = r.draw AND l.u = r.node)", "SELECT src, draw, count(*)::INTEGER AS size FROM dr GROUP BY src, draw"),
        "d6_spread_statistics": q(f"{PERC}, {STATS}", "SELECT node, round(spread_mean, 6) AS spread_mean, round(spread_std, 6) AS spread_std, round(spread_std / sqrt(c), 6) AS spread_stderr, round(spread_std / spread_mean, 6) AS spread_cv, round(spread_ignition, 6) AS spread_ignition FROM st"),
        "d7_noise_report": q(f"{PERC}, {STATS}, nr AS (SELECT quantile_cont(spread_std / sqrt(c), 0.5) AS m, stddev_pop(spread_mean) AS b FROM st)", "SELECT round(m, 6) AS median_stderr, round(b, 6) AS between, round(m / b, 6) AS noise_ratio, m / b < 0.1 AS quiet FROM nr"),
        "d8_transmission_sweep": q(f"{NET}, {perc('0.1', 4, 0, '1')}, {perc('0.3', 4, 0, '3')}", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round(avg(m), 6) AS mean_size, round(stddev_pop(m), 6) AS between_nodes, round(avg(i), 6) AS ignition FROM (SELECT node, avg(size) AS m, avg((size > 0.05 * (SELECT n FROM nn))::INTEGER::DOUBLE) AS i FROM perc{x} GROUP BY node)" for p, x in ((0.1, "1"), (0.3, "3")))),
        "d10_truncated_cascades": q(f"{NET}, {live(str(P), 4, 0)}, lb AS (SELECT draw, u, v FROM lv0 UNION ALL SELECT draw, v, u FROM lv0), t0 AS (SELECT draw, node AS src, node FROM deg, (SELECT unnest(range(0, 4))::INTEGER AS draw)), t1 AS (SELECT * FROM t0 UNION SELECT draw, u, v FROM lb), t2 AS (SELECT * FROM t1 UNION SELECT t1.draw, t1.src, lb.v FROM t1 JOIN lb ON lb.draw = t1.draw AND lb.u = t1.node)", "SELECT draw, src AS node, 1 AS radius, count(*)::INTEGER AS size FROM t1 GROUP BY draw, src UNION ALL SELECT draw, src, 2, count(*)::INTEGER FROM t2 GROUP BY draw, src"),
        "d14_ignition_gate": q(PERC, "SELECT round(f, 6) AS fraction, f >= 0.1 AND f <= 0.9 AS passes, q[1]::DOUBLE AS q10, q[2]::DOUBLE AS q50, q[3]::DOUBLE AS q90, ds AS distinct_sizes FROM (SELECT avg((size > 0.05 * (SELECT n FROM nn))::INTEGER) AS f, quantile_cont(size, [0.1, 0.5, 0.9]) AS q, count(DISTINCT size) AS ds FROM perc)"),
        "d15_largest_two": q(PERC, "SELECT draw, max(size)::BIGINT AS s1, coalesce(max(CASE WHEN r = 2 THEN size END), 0)::BIGINT AS s2 FROM (SELECT draw, size, row_number() OVER (PARTITION BY draw ORDER BY size DESC, comp) AS r FROM (SELECT DISTINCT draw, comp, size FROM perc)) GROUP BY draw"),
        "d16_susceptibility_peak": q(LARGEST, "SELECT arg_min(m, -chi) AS m, arg_min(m, -chi) IN (2, 6) AS at_edge, round(max(chi), 6) AS chi FROM chi"),
        "d17_bootstrap_peak": q(f"{LARGEST}, pk AS (SELECT rep, floor({U('rep', 'slot', '0')} * 6)::INTEGER AS draw FROM (SELECT unnest(range(0, 10))::INTEGER AS rep), (SELECT unnest(range(0, 6))::INTEGER AS slot)), bc AS (SELECT rep, m, var_samp(s1) / avg(s1) AS chi FROM lt JOIN pk USING (draw) GROUP BY rep, m)", "SELECT rep, m FROM (SELECT rep, m, row_number() OVER (PARTITION BY rep ORDER BY chi DESC, m) AS r FROM bc) WHERE r = 1"),
        "d18_set_spread": q(PERC, "SELECT draw, sum(size)::BIGINT AS spread FROM (SELECT DISTINCT draw, comp, size FROM perc WHERE node IN (SELECT node FROM deg ORDER BY k DESC, node LIMIT 5)) GROUP BY draw"),
        "d19_greedy_seeds": q(
            f"{PERC}, g1 AS (SELECT node, sum(size) AS g FROM perc GROUP BY node ORDER BY g DESC, node LIMIT 1), h1 AS (SELECT draw, comp FROM perc JOIN g1 USING (node)), g2 AS (SELECT node, sum(size) AS g FROM perc ANTI JOIN h1 USING (draw, comp) GROUP BY node ORDER BY g DESC, node LIMIT 1), h2 AS (SELECT draw, comp FROM perc JOIN g2 USING (node) UNION SELECT * FROM h1), g3 AS (SELECT node, sum(size) AS g FROM perc ANTI JOIN h2 USING (draw, comp) GROUP BY node ORDER BY g DESC, node LIMIT 1)",
            "SELECT 1 AS rank, node, g::BIGINT AS gain FROM g1 UNION ALL SELECT 2, node, g::BIGINT FROM g2 UNION ALL SELECT 3, node, g::BIGINT FROM g3",
        ),
        "d20_degree_discount": q(
            f"{NET}, g1 AS (SELECT node FROM deg ORDER BY k DESC, node LIMIT 1), e2 AS (SELECT d.node, k, (SELECT count(*) FROM arcs a JOIN g1 ON a.u = g1.node WHERE a.v = d.node) AS t FROM deg d ANTI JOIN g1 USING (node)), g2 AS (SELECT node FROM e2 ORDER BY k - 2 * t - (k - t) * t * {P}::DOUBLE DESC, node LIMIT 1), g12 AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), e3 AS (SELECT d.node, k, (SELECT count(*) FROM arcs a JOIN g12 ON a.u = g12.node WHERE a.v = d.node) AS t FROM deg d ANTI JOIN g12 USING (node)), g3 AS (SELECT node FROM e3 ORDER BY k - 2 * t - (k - t) * t * {P}::DOUBLE DESC, node LIMIT 1)",
            "SELECT 1 AS rank, node FROM g1 UNION ALL SELECT 2, node FROM g2 UNION ALL SELECT 3, node FROM g3",
        ),
        "d21_top_k": q(NET, "SELECT node, k FROM deg ORDER BY k DESC, node LIMIT 25"),
        "c1_nonbacktracking_pairs": q(NET, "SELECT a.v, count(*) AS pairs, sum(a.u * b.v)::BIGINT AS uw FROM arcs a JOIN arcs b ON b.u = a.v AND b.v <> a.u GROUP BY a.v"),
        "c3_power_steps": q(f"{NET}, x0 AS (SELECT u, v, 1.0::DOUBLE AS x FROM arcs), " + ", ".join(f"x{s} AS (SELECT a.u, a.v, coalesce(sum(b.x), 0) AS x FROM arcs a LEFT JOIN x{s - 1} b ON b.u = a.v AND b.v <> a.u GROUP BY a.u, a.v)" for s in (1, 2, 3, 4)), " UNION ALL ".join(f"SELECT {s} AS step, round(sum(x), 6)::DOUBLE AS total FROM x{s}" for s in (1, 2, 3, 4))),
        "c4_cyclomatic_excess": q(NET, "SELECT 0::BIGINT AS comp, n AS nodes, m AS edges, m - n + 1 AS excess FROM nn, (SELECT count(*) AS m FROM edges)"),
        "c6_mean_field_threshold": q(NET, "SELECT round(avg(k) / (avg(k * k) - avg(k)), 9) AS beta FROM deg"),
        "t3_b2": q(f"{NET}, {B2}", "SELECT node, round(b_2, 6)::DOUBLE AS b_2 FROM b2"),
        "t3_b3": q(
            f"{SHELL}, {B2}, sg2 AS (SELECT s2.src, s2.node, count(*) AS s FROM s2 JOIN arcs ON arcs.v = s2.node JOIN s1 ON s1.src = s2.src AND s1.node = arcs.u GROUP BY 1, 2), pth AS (SELECT s3.src, s3.node AS dst, a.u AS y, b.u AS x FROM s3 JOIN arcs a ON a.v = s3.node JOIN s2 ON s2.src = s3.src AND s2.node = a.u JOIN arcs b ON b.v = a.u JOIN s1 ON s1.src = s3.src AND s1.node = b.u), tot AS (SELECT src, dst, count(*) AS c FROM pth GROUP BY 1, 2), thr AS (SELECT node, sum(w) AS w FROM (SELECT x AS node, 1.0 / c AS w FROM pth JOIN tot USING (src, dst) UNION ALL SELECT y, 1.0 / c FROM pth JOIN tot USING (src, dst)) GROUP BY node)",
            "SELECT node, round(b_2 + coalesce(w, 0) / 2, 6)::DOUBLE AS b_3 FROM b2 LEFT JOIN thr USING (node)",
        ),
        "t8_distance_to_hubs": q(f"{NET}, hub AS (SELECT node FROM deg ORDER BY k DESC, node LIMIT (SELECT greatest(1, round_even(0.01 * n, 0))::BIGINT FROM nn)), hd(node, d) AS (SELECT node, 0::BIGINT FROM hub UNION SELECT a.v, hd.d + 1 FROM hd JOIN arcs a ON a.u = hd.node WHERE hd.d < 12)", "SELECT deg.node, coalesce(min(d), (SELECT n FROM nn)) AS hub_distance FROM deg LEFT JOIN hd USING (node) GROUP BY deg.node"),
        "a31_zero_set": q(f"{NET}, {B2}", "SELECT node FROM deg ANTI JOIN (SELECT DISTINCT i AS node FROM w2) USING (node)"),
        "a32_witnesses": q(f"{NET}, {B2}", "SELECT node, a, b, common, 2::BIGINT AS num, ((SELECT (n - 1) * (n - 2) FROM nn) * common)::BIGINT AS den FROM (SELECT i AS node, j AS a, l AS b, c AS common, row_number() OVER (PARTITION BY i ORDER BY c, j, l) AS r FROM w2 JOIN wc USING (j, l)) WHERE r = 1"),
        "g1_g2_g3_descriptors": q(f"{NET}, {TRI}", "SELECT n, (SELECT count(*) FROM edges) AS m, round(mk, 6) AS mean_degree, k_max, round((SELECT corr(a.k, b.k) FROM arcs JOIN deg a ON a.node = u JOIN deg b ON b.node = v), 6) AS assortativity, round(tt / pp, 6) AS transitivity, round(ac, 6) AS average_clustering, (tt / 3)::BIGINT AS triangles, round(sqrt(k_max), 6) AS hub, round(bulk, 6) AS bulk, sqrt(k_max) > bulk AS hub_wins FROM (SELECT count(*) AS n, avg(k) AS mk, max(k) AS k_max, sum(t)::DOUBLE AS tt, sum(k * (k - 1) / 2) AS pp, avg(CASE WHEN k > 1 THEN t / (k * (k - 1) / 2) ELSE 0 END) AS ac, sum(k * k) / sum(k)::DOUBLE AS bulk FROM deg JOIN tri USING (node))"),
        "g7_erdos_renyi": f"SELECT u, v FROM (SELECT unnest(range(0, 200)) AS u), (SELECT unnest(range(0, 200)) AS v) WHERE u < v AND {U('u', 'v', '7')} < 4.0::DOUBLE / 199",
        "g8_chung_lu": q(f"{NET}, wt AS (SELECT node, k::DOUBLE AS w FROM deg)", f"SELECT a.node AS u, b.node AS v FROM wt a, wt b, (SELECT sum(w) AS s FROM wt) WHERE a.node < b.node AND {U('a.node', 'b.node', '7')} < a.w * b.w / s"),
        "g9_configuration_model": q(f"{NET}, stub AS (SELECT node, unnest(range(1, k + 1)) AS i FROM deg), nm AS (SELECT node, row_number() OVER (ORDER BY {U('node', 'i', '7')}, node, i) - 1 AS at FROM stub)", "SELECT a.node AS u, b.node AS v, a.at // 2 AS pair FROM nm a JOIN nm b ON b.at = a.at + 1 WHERE a.at % 2 = 0").replace("SELECT a.node AS u, b.node AS v, a.at // 2 AS pair", "SELECT a.node AS u, b.node AS v"),
        "k1_k5_evaluate": q(
            f"{NET}, {B2}, yp AS (SELECT node, round(b_2, 6)::DOUBLE AS y, k::DOUBLE AS p FROM b2 JOIN deg USING (node)), rk AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, row_number() OVER (ORDER BY y DESC, node) AS ty, row_number() OVER (ORDER BY p DESC, node) AS tp FROM yp)",
            "SELECT 'degree' AS cell, (SELECT round(sum(sign(a.y - b.y) * sign(a.p - b.p)) / sqrt(sum(abs(sign(a.y - b.y)))::DOUBLE * sum(abs(sign(a.p - b.p)))), 6) FROM yp a JOIN yp b ON a.node < b.node) AS kendall_tau, round(corr(ry, rp), 6) AS spearman, round(sum((ty <= greatest(1, n // 100) AND tp <= greatest(1, n // 100))::INTEGER) / greatest(1, max(n) // 100), 6)::DOUBLE AS precision_at_1pct, round(sum((ty <= greatest(1, n // 20) AND tp <= greatest(1, n // 20))::INTEGER) / greatest(1, max(n) // 20), 6)::DOUBLE AS precision_at_5pct, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM rk, nn",
        ),
        "k6_k7_percentile_rank": q(f"{NET}, rk AS (SELECT node, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS r FROM deg)", "SELECT node, round(r / n, 6)::DOUBLE AS pct, round((r - 1) / (n - 1), 6)::DOUBLE AS centred FROM rk, nn"),
        "k8_k9_somers": q(f"{NET}, {B2}, yp AS (SELECT node, round(b_2, 6)::DOUBLE AS y, k AS p FROM b2 JOIN deg USING (node))", "SELECT (SELECT sum(c * (c - 1) / 2)::BIGINT FROM (SELECT count(*) AS c FROM deg GROUP BY k)) AS tied_pairs, (SELECT round(sum(sign(a.y - b.y) * sign(a.p - b.p)) / sum(abs(sign(a.p - b.p)))::DOUBLE, 6) FROM yp a JOIN yp b ON a.node < b.node) AS somers_d"),
        "k10_cliffs_delta": q(f"{NET}, {B2}, gz AS (SELECT k, node NOT IN (SELECT i FROM w2) AS z FROM deg)", "SELECT round(sum(sign(a.k - b.k)) / count(*)::DOUBLE, 6) AS delta FROM gz a, gz b WHERE a.z AND NOT b.z"),
        "k11_zero_inflation": q(f"{NET}, {B2}, zz AS (SELECT count(*) AS n, sum((b_2 = 0)::INTEGER)::BIGINT AS nz FROM b2)", "SELECT n, nz, round(nz / n::DOUBLE, 6) AS zero_share, round(2 * nz * (n - nz) / (n * (n - 1) - nz * (nz - 1))::DOUBLE, 6) AS w, round(nz * (n - nz) / sqrt((n * (n - 1) / 2.0 - nz * (nz - 1) / 2.0) * (n * (n - 1) / 2.0))::DOUBLE, 6) AS tau_floor FROM zz"),
        "k14_pair_contributions": q(f"{NET}, {B2}, yp AS (SELECT node, round(b_2, 6)::DOUBLE AS y, k AS p FROM b2 JOIN deg USING (node))", "SELECT a.node, sum(sign(a.y - b.y) * sign(a.p - b.p))::BIGINT AS s FROM yp a, yp b GROUP BY a.node"),
        "k16_adjusted_p": q(f"{NET}, pp AS (SELECT node, {U('node', repr('p'))} AS p FROM ids), rk AS (SELECT node, p, row_number() OVER (ORDER BY p) AS r, (SELECT n FROM nn) AS m FROM pp), hm AS (SELECT sum(1.0::DOUBLE / i) AS h FROM (SELECT unnest(range(1, (SELECT n FROM nn) + 1)) AS i))", "SELECT node, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS q, round(least(1, min(p * m * h / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS q_by FROM rk, hm"),
        "k17_a20_paired_gain": q(CELLS, "SELECT radius, count(*) AS n, round(avg(g), 6) + 0.0 AS mean, round(stddev_samp(g), 6) AS sd, abs(avg(g)) > 2 * stddev_samp(g) AS starred FROM (SELECT a.radius, a.kendall_tau - b.kendall_tau AS g FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness = 'all' AND b.richness = 'node') GROUP BY radius"),
        "k19_moran": q(f"{SHELL}, cz AS (SELECT node, k - (SELECT avg(k) FROM deg) AS c FROM deg), lg AS (SELECT src, d, avg(c) AS w FROM shell JOIN cz USING (node) WHERE d > 0 GROUP BY src, d)", "SELECT d AS lag, round((SELECT n FROM nn) / count(*)::DOUBLE * sum(c * w) / (SELECT sum(c * c) FROM cz), 6) AS moran_i, count(*) AS n FROM lg JOIN cz ON cz.node = lg.src GROUP BY d"),
        "k13_two_number_report": q(
            f"{NET}, {B2}, yp AS (SELECT node, round(b_2, 6)::DOUBLE AS y, k AS p, node NOT IN (SELECT i FROM w2) AS z FROM b2 JOIN deg USING (node)), po AS (SELECT * FROM yp WHERE y > 0)",
            "SELECT count(*) AS n, sum((y = 0 AND z)::INTEGER)::BIGINT AS zero_hit, sum((y = 0 AND NOT z)::INTEGER)::BIGINT AS zero_missed, sum((y <> 0 AND z)::INTEGER)::BIGINT AS zero_wrong, round(avg(((y = 0) = z)::INTEGER), 6) AS zero_accuracy, (SELECT round(sum(sign(a.y - b.y) * sign(a.p - b.p)) / sqrt(sum(abs(sign(a.y - b.y)))::DOUBLE * sum(abs(sign(a.p - b.p)))), 6) FROM po a JOIN po b ON a.node < b.node) AS tau_positive, (SELECT sum(c * (c - 1) / 2)::BIGINT FROM (SELECT count(*) AS c FROM po GROUP BY y)) AS ties_y, (SELECT sum(c * (c - 1) / 2)::BIGINT FROM (SELECT count(*) AS c FROM po GROUP BY p)) AS ties_score FROM yp",
        ),
        "k15_tie_broken_tau": q(f"{NET}, {B2}, yp AS (SELECT node, rep, round(b_2, 6)::DOUBLE AS y, k + 0.001::DOUBLE * {U('node', 'rep')} AS p FROM b2 JOIN deg USING (node), (SELECT unnest(range(0, 2))::INTEGER AS rep))", "SELECT a.rep, round(sum(sign(a.y - b.y) * sign(a.p - b.p)) / sqrt(sum(abs(sign(a.y - b.y)))::DOUBLE * sum(abs(sign(a.p - b.p)))), 6) AS tau FROM yp a JOIN yp b ON a.rep = b.rep AND a.node < b.node GROUP BY a.rep"),
        "k20_moran_null": q(
            f"{NET}, mz AS (SELECT node, k, rep FROM deg, (SELECT unnest(range(0, 3))::INTEGER AS rep)), ow AS (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY node) AS i FROM mz), de AS (SELECT rep, k, row_number() OVER (PARTITION BY rep ORDER BY {U('node', 'rep')}, node) AS i FROM mz), cz AS (SELECT rep, node, k - (SELECT avg(k) FROM deg) AS c FROM ow JOIN de USING (rep, i)), lg AS (SELECT rep, u AS src, avg(c) AS w FROM arcs JOIN cz ON cz.node = arcs.v GROUP BY rep, u)",
            "SELECT rep, round(avg(c * w) / (SELECT avg(x.c * x.c) FROM cz x WHERE x.rep = lg.rep), 6) AS moran_i FROM lg JOIN cz USING (rep) WHERE cz.node = lg.src GROUP BY rep",
        ),
        "m10_buffered_plan": q(f"{NET}, fo AS (SELECT node, ((row_number() OVER (ORDER BY {U('node', '0')}, node) - 1) % 5)::INTEGER AS fold FROM ids)", "SELECT f.fold, n.node, arm FROM fo n, (SELECT unnest(range(0, 5))::INTEGER AS fold) f, (SELECT unnest(['buffered', 'control']) AS arm) WHERE n.fold <> f.fold"),
        "m1_r5_fold_digest": q(f"{NET}, fo AS (SELECT node, (row_number() OVER (ORDER BY {U('node', '0')}, node) - 1) % 5 AS fold FROM ids)", "SELECT sha256(string_agg(node || ':' || fold, ',' ORDER BY node)) AS digest FROM fo"),
        "m9_subsample": q(f"{NET}, fo AS (SELECT node, ((row_number() OVER (ORDER BY {U('node', '0')}, node) - 1) % 5)::INTEGER AS fold FROM ids), rk AS (SELECT node, fold, row_number() OVER (PARTITION BY fold ORDER BY {U('node', '0', repr('s'))}, node) AS r, count(*) OVER (PARTITION BY fold) AS n FROM fo)", "SELECT node, fold FROM rk WHERE r <= round(n * 0.25::DOUBLE)"),
        "a0_sweep_cells": q(CELLS, "SELECT radius, richness, seed, round(kendall_tau, 6) AS kendall_tau FROM cells"),
        "a1_horizon": q(f"{CELLS}, tp AS (SELECT *, max(kendall_tau) OVER (PARTITION BY richness, seed) AS top FROM cells)", "SELECT richness, seed, min(CASE WHEN top > 0 AND kendall_tau >= 0.95::DOUBLE * top THEN radius END) AS r_star, round(max(top), 6) AS ceiling FROM tp GROUP BY richness, seed"),
        "a2_a11_modal_horizon": q(f"{CELLS}, tp AS (SELECT *, max(kendall_tau) OVER (PARTITION BY richness, seed) AS top FROM cells), rs AS (SELECT richness, seed, min(CASE WHEN top > 0 AND kendall_tau >= 0.95::DOUBLE * top THEN radius END) AS r_star FROM tp GROUP BY richness, seed), ct AS (SELECT richness, r_star, count(*) AS c FROM rs WHERE r_star IS NOT NULL GROUP BY ALL)", "SELECT richness, r_star, c AS agree, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY richness ORDER BY c DESC, r_star) AS r, sum(c) OVER (PARTITION BY richness) AS n FROM ct) WHERE r = 1"),
        "a3_curve": q(CELLS, "SELECT richness, radius, round(avg(kendall_tau), 6) AS tau_mean, round(stddev_samp(kendall_tau), 6) AS tau_sd, count(*) AS n FROM cells GROUP BY richness, radius"),
        "a4_seed_matrix": q(CELLS, "SELECT richness, seed, " + ", ".join(f"round(max(CASE WHEN radius = {r} THEN kendall_tau END), 6) AS r{r}" for r in range(4)) + " FROM cells GROUP BY richness, seed"),
        "a5_keep_last": q(CELLS, "SELECT radius, richness, seed, round(CASE WHEN seed < 2 THEN kendall_tau / 2 ELSE kendall_tau END, 6) AS kendall_tau, CASE WHEN seed < 2 THEN 2 ELSE 1 END AS seq FROM cells"),
        "a7_pareto": q(f"{CELLS}, cv AS (SELECT richness, radius, radius * 10 + CASE WHEN richness = 'all' THEN 5 ELSE 0 END AS seconds, round(avg(kendall_tau), 9) AS t FROM cells GROUP BY richness, radius)", "SELECT richness, radius, seconds, round(t, 6) AS tau_mean FROM cv a WHERE NOT EXISTS (SELECT 1 FROM cv b WHERE b.seconds < a.seconds AND b.t >= a.t)"),
        "a8_depth_against_richness": q(CELLS, "SELECT radius, count(*) AS n, round(avg(g), 6) + 0.0 AS gain_richness, round(stddev_samp(g), 6) AS sd FROM (SELECT a.radius, a.kendall_tau - b.kendall_tau AS g FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness = 'all' AND b.richness = 'node') GROUP BY radius"),
        "a9_noise_horizon": q(f"{CELLS}, mn AS (SELECT richness, radius, avg(kendall_tau) AS m FROM cells GROUP BY ALL), bs AS (SELECT richness, radius AS r_ceiling FROM (SELECT *, row_number() OVER (PARTITION BY richness ORDER BY m DESC, radius) AS r FROM mn) WHERE r = 1), gp AS (SELECT c.richness, r_ceiling, c.radius, avg(t.kendall_tau - c.kendall_tau) AS gap, stddev_samp(t.kendall_tau - c.kendall_tau) AS sd FROM cells c JOIN bs USING (richness) JOIN cells t ON t.richness = c.richness AND t.seed = c.seed AND t.radius = r_ceiling GROUP BY ALL)", "SELECT richness, min(CASE WHEN gap <= 2 * sd THEN radius END) AS r_star, r_ceiling FROM gp GROUP BY richness, r_ceiling"),
        "a10_a26_radius_gains": q(CELLS, "SELECT richness, radius, count(*) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, abs(avg(g)) > 2 * stddev_samp(g) AS starred FROM (SELECT a.richness, a.radius, a.kendall_tau - b.kendall_tau AS g FROM cells a JOIN cells b ON b.richness = a.richness AND b.seed = a.seed AND b.radius = a.radius - 1) GROUP BY richness, radius"),
        "a12_standardised_residual": q(
            f"{NET}, {B2}, dl AS (SELECT node, k, (rank() OVER (ORDER BY round(b_2, 6)) + (count(*) OVER (PARTITION BY round(b_2, 6)) - 1) / 2.0 - rank() OVER (ORDER BY k) - (count(*) OVER (PARTITION BY k) - 1) / 2.0)::DOUBLE / (SELECT n FROM nn) AS delta FROM b2 JOIN deg USING (node)), qe AS (SELECT list_sort(list_distinct(quantile_cont(k, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM deg), bn AS (SELECT node, delta, least(greatest(len(list_filter(e, lambda x: x <= k)) - 1, 0), len(e) - 2) AS bin FROM dl, qe), md AS (SELECT *, delta - median(delta) OVER (PARTITION BY bin) AS c FROM bn), ma AS (SELECT bin, median(abs(c)) AS mad FROM md GROUP BY bin)",
            "SELECT node, round(CASE WHEN mad > 0 THEN c / mad ELSE 0 END, 6) + 0.0 AS z FROM md JOIN ma USING (bin)",
        ),
        "a13_tails": q(f"{NET}, rk AS (SELECT node, row_number() OVER (ORDER BY k DESC, node) AS a, row_number() OVER (ORDER BY k, node) AS b, greatest(10, round((SELECT n FROM nn) * 0.05)::INTEGER) AS c FROM deg)", "SELECT node, CASE WHEN a <= c THEN 'high' ELSE 'low' END AS tail FROM rk WHERE a <= c OR b <= c"),
        "a25_certificate_ratio": q(CELLS, "SELECT a.richness, a.seed, round(a.kendall_tau / b.kendall_tau, 6) AS ratio FROM cells a JOIN cells b USING (richness, seed) WHERE a.radius = 1 AND b.radius = 3"),
        "a28_radius_rule": q(f"{CELLS}, cv AS (SELECT richness, radius, avg(kendall_tau) AS t FROM cells GROUP BY ALL)", "SELECT a.richness, min(CASE WHEN a.t >= 0.9::DOUBLE * b.t THEN a.radius END) AS radius FROM cv a JOIN cv b ON b.richness = a.richness AND b.radius = 3 GROUP BY a.richness"),
        "a29_verdicts": q(f"{CELLS}, gn AS (SELECT a.richness, a.radius, avg(a.kendall_tau - b.kendall_tau) AS m, stddev_samp(a.kendall_tau - b.kendall_tau) AS sd FROM cells a JOIN cells b ON b.richness = a.richness AND b.seed = a.seed AND b.radius = a.radius - 1 GROUP BY ALL)", "SELECT richness, CASE WHEN bool_or(abs(m) > 2 * sd AND m > 0) THEN 'deeper' ELSE 'local' END AS verdict FROM gn WHERE radius > 1 GROUP BY richness"),
        "a33_a34_grid_scan": "SELECT count(*) AS rows, sum((l_discount = 0)::INTEGER)::BIGINT AS zeros, sum((l_discount::VARCHAR::DECIMAL(38, 18) % 0.01::DECIMAL(38, 18) <> 0)::INTEGER)::BIGINT AS off_grid, sum((l_discount::VARCHAR::DECIMAL(38, 18) = 0.01)::INTEGER)::BIGINT AS at_step, round(min(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS least_positive FROM lineitem",
        "a33_pair_labels": "WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS base, o_orderstatus = 'F' AS f FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY base, f ORDER BY k)::INTEGER AS nth FROM o) SELECT base, nth, a.k AS plain, b.k AS filtered FROM n a JOIN n b USING (base, nth) WHERE NOT a.f AND b.f",
        "a38_compare_runs": q(f"{CELLS}, ol AS (SELECT * FROM cells WHERE radius < 3), nw AS (SELECT radius, richness, seed, kendall_tau + CASE WHEN seed = 1 THEN 0.01 ELSE 0 END AS kendall_tau FROM cells WHERE radius > 0)", "SELECT radius, richness, seed, CASE WHEN o.kendall_tau IS NULL THEN 'new_only' WHEN n.kendall_tau IS NULL THEN 'old_only' ELSE 'both' END AS side, round(n.kendall_tau - o.kendall_tau, 6) AS diff, coalesce(abs(n.kendall_tau - o.kendall_tau) <= 1e-6, FALSE) AS agrees FROM ol o FULL JOIN nw n USING (radius, richness, seed)"),
        "r1_missing_cells": "SELECT r::INTEGER AS radius, q AS richness, s::INTEGER AS seed FROM (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(['node', 'all']) AS q), (SELECT unnest(range(0, 5)) AS s) WHERE s >= 4 OR r = 2",
    }
    out["t7_core_numbers"] = q(f"{NET}, core(node, h) USING KEY (node) AS (SELECT node, k FROM deg UNION SELECT x.u, x.h FROM (SELECT u, max(least(h, r)) AS h FROM (SELECT a.u, c.h, row_number() OVER (PARTITION BY a.u ORDER BY c.h DESC) AS r FROM arcs a JOIN recurring.core c ON c.node = a.v) GROUP BY u) x JOIN recurring.core o ON o.node = x.u WHERE x.h < o.h)", "SELECT node, h::BIGINT AS core FROM core")
    out["d5_sir"] = q(
        f"""{NET}, sr(src, draw, node, t) USING KEY (src, draw, node) AS (SELECT node, draw, node, 0 FROM deg, (SELECT unnest(range(0, 2))::INTEGER AS draw)
        UNION (SELECT src, draw, node, t + 1 FROM sr WHERE {U('src', 'draw', 't', 'node', repr('r'), '0')} >= 0.5
         UNION SELECT s.src, s.draw, a.v, s.t + 1 FROM sr s JOIN arcs a ON a.u = s.node WHERE {U('s.src', 's.draw', 's.t', 's.node', 'a.v', '0')} < 0.03 AND NOT EXISTS (SELECT 1 FROM recurring.sr e WHERE e.src = s.src AND e.draw = s.draw AND e.node = a.v)))""",
        "SELECT src, draw, count(*)::INTEGER AS size FROM sr GROUP BY src, draw",
    )
    out["x1_unpivot_features"] = q(NET, "SELECT node, 'degree' AS feature, k::DOUBLE AS value FROM deg UNION ALL SELECT node, 'degree_normalized', round(k / greatest(n - 1, 1)::DOUBLE, 6) FROM deg, nn")
    out["x2_common_leaders"] = q(f"{NET}, ns AS (SELECT u AS node, sum(k) AS x FROM arcs JOIN deg ON deg.node = arcs.v GROUP BY u)", "(SELECT node FROM deg ORDER BY k DESC, node LIMIT 100) INTERSECT (SELECT node FROM ns ORDER BY x DESC, node LIMIT 100)")
    out["x3_lookup_parts"] = q(NET, "SELECT node, original_id, p_brand, p_size FROM ids LEFT JOIN part ON p_partkey = original_id")

    def spread(within: str) -> str:
        """Threshold cascades from closed neighbourhoods."""
        return f"""act(src, node, a) USING KEY (src, node) AS (SELECT node, node, 1 FROM deg UNION SELECT u, v, 1 FROM arcs
        UNION SELECT t.src, t.v, 1 FROM (SELECT x.src, a.v, count(*) AS c FROM recurring.act x JOIN arcs a ON a.u = x.node GROUP BY x.src, a.v) t JOIN deg ON deg.node = t.v {within} WHERE 3 * t.c >= deg.k AND NOT EXISTS (SELECT 1 FROM recurring.act e WHERE e.src = t.src AND e.node = t.v))"""

    out["d11_threshold_cascades"] = q(f"{NET}, {spread('')}", "SELECT src AS node, count(*) AS size FROM act GROUP BY src")
    out["d12_d13_truncated_threshold"] = q(f"{SHELL}, {spread('JOIN shell b ON b.src = t.src AND b.node = t.v AND b.d <= 2')}", "SELECT src AS node, count(*) AS size, NOT bool_or(d = 2) AS contained, CASE WHEN bool_or(d = 2) THEN (SELECT n + 1 FROM nn) ELSE count(*) END AS prediction FROM act JOIN shell USING (src, node) GROUP BY src")
    deep = 14  # more than the network's diameter
    back = ", ".join(f"e{d} AS (SELECT l.src, a.u AS node, sum(x.s / l.s * (1 + coalesce(e.delta, 0))) AS delta FROM lvl l JOIN arcs a ON a.v = l.node JOIN lvl x ON x.src = l.src AND x.node = a.u AND x.d = {d} LEFT JOIN {f'e{d + 1}' if d < deep else '(SELECT NULL::BIGINT AS src, NULL::BIGINT AS node, NULL::DOUBLE AS delta)'} e ON e.src = l.src AND e.node = l.node WHERE l.d = {d + 1} GROUP BY l.src, a.u)" for d in range(deep, 0, -1))
    out["t1_exact_betweenness"] = q(
        f"""{NET}, lvl(src, node, d, s) USING KEY (src, node) AS (SELECT node, node, 0, 1.0::DOUBLE FROM deg
        UNION SELECT r.src, a.v, r.d + 1, sum(r.s) FROM lvl r JOIN arcs a ON a.u = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.lvl e WHERE e.src = r.src AND e.node = a.v) GROUP BY r.src, a.v, r.d), {back}""",
        "SELECT deg.node, round(coalesce(b, 0), 4)::DOUBLE AS betweenness FROM deg LEFT JOIN (SELECT node, sum(delta) / 2 AS b FROM (" + " UNION ALL ".join(f"SELECT node, delta FROM e{d}" for d in range(1, deep + 1)) + ") GROUP BY node) USING (node)",
    )
    residual = "lx AS (SELECT node, log10(greatest(spread_mean, 1e-12)) AS lm, log10(greatest(spread_std, 1e-12)) AS ls FROM st), qe AS (SELECT list_sort(list_distinct(quantile_cont(lm, [" + ", ".join(f"{i / 10}" for i in range(11)) + "]))) AS e FROM lx), bn AS (SELECT node, ls, least(greatest(len(list_filter(e, lambda x: x <= lm)) - 1, 0), len(e) - 2) AS bin FROM lx, qe), rs AS (SELECT node, ls - median(ls) OVER (PARTITION BY bin) AS r FROM bn)"
    out["t4_variance_residual"] = q(f"{PERC}, {STATS}, {residual}", "SELECT node, round(r, 6) + 0.0 AS spread_resid FROM rs")
    out["t5_targets"] = q(f"{PERC}, {STATS}, {residual}, {B2}", "SELECT node, round(spread_mean, 6) AS spread_mean, round(spread_std, 6) AS spread_std, round(spread_std / spread_mean, 6) AS spread_cv, round(r, 6) + 0.0 AS spread_resid, round(spread_ignition, 6) AS spread_ignition, round(b_2, 6)::DOUBLE AS betweenness FROM st JOIN rs USING (node) JOIN b2 USING (node)")
    gains = f"{CELLS}, rg AS (SELECT a.radius, a.seed, round(a.kendall_tau - b.kendall_tau, 9) AS g FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness = 'all' AND b.richness = 'node')"
    hops = "hg AS (SELECT a.radius, a.seed, round(a.kendall_tau - b.kendall_tau, 9) AS g FROM cells a JOIN cells b ON b.richness = 'all' AND b.seed = a.seed AND b.radius = a.radius - 1 WHERE a.richness = 'all')"
    choose = "(factorial(nz) / (factorial(i) * factorial(nz - i)))::DOUBLE"
    sign = lambda t, x: f"{x} AS (SELECT radius, count(*) FILTER (g > 0)::INTEGER AS pos, count(*) FILTER (g <> 0)::INTEGER AS nz FROM {t} GROUP BY radius), p{x} AS (SELECT radius, least(1.0, 2 * sum({choose}) / 2 ** nz)::DOUBLE AS p_sign FROM {x}, (SELECT unnest(range(0, {SEEDS + 1}))::INTEGER AS i) WHERE i <= least(pos, nz - pos) GROUP BY radius, nz)"
    four = "(t / sqrt(4 + t * t) * (1 + 0.5::DOUBLE * 4 / (4 + t * t)))"  # Student's distribution at four degrees of freedom, as five seeds have
    out["k16_paired_tests"] = q(
        f"{gains}, {sign('rg', 'sg')}, st AS (SELECT radius, count(*) AS n, avg(g) AS mean, stddev_samp(g) AS sd FROM rg GROUP BY radius), tt AS (SELECT *, CASE WHEN sd > 0 THEN abs(mean) / (sd / sqrt(n)) END AS t FROM st)",
        f"SELECT radius, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, abs(mean) > 2 * sd AS starred, round(CASE WHEN sd > 0 THEN 1 - {four} WHEN mean = 0 THEN 1 ELSE 0 END, 6) + 0.0 AS p_t, round(p_sign, 6)::DOUBLE AS p_sign FROM tt JOIN psg USING (radius)",
    )
    adjusted = "min(p_sign * m / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    out["a21_families"] = q(
        f"{gains}, {hops}, {sign('rg', 'sg')}, {sign('hg', 'sh')}, fam AS (SELECT 'richness' AS family, * FROM psg UNION ALL SELECT 'hop', * FROM psh), rk AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p_sign) AS r FROM fam)",
        f"SELECT family, radius, round(p_sign, 6) AS p_sign, round(least(1, {adjusted}), 6)::DOUBLE AS q, round(least(1, {adjusted} * list_sum([1.0::DOUBLE / x FOR x IN range(1, m + 1)])), 6)::DOUBLE AS q_by FROM rk",
    )
    rest, agreed = "(900.0::DOUBLE - 100 * radius)", "(z * (1000 - z) + tau * (1000 - z) * (999 - z) / 2)"
    mix = f"mx AS (SELECT *, (1000 - {rest})::DOUBLE AS z, 1000 * 999 / 2.0::DOUBLE AS total"
    scoreable = "(total - z * (z - 1) / 2)"
    out["k12_mixture_tau"] = q(f"{CELLS}, {mix}, kendall_tau AS tau FROM cells)", f"SELECT radius, richness, seed, round({agreed} / sqrt({scoreable} * total), 6) AS untied, round({agreed} / {scoreable}, 6) AS tied FROM mx")
    none = "z * (1000 - z) / sqrt({0} * total)".format(scoreable)
    out["a41_benchmark_errors"] = q(
        f"{CELLS}, {mix}, tau_filtered AS tau FROM (SELECT a.radius, a.seed, a.kendall_tau AS tau_all, b.kendall_tau AS tau_filtered FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness = 'node' AND b.richness = 'all'))",
        f"SELECT radius, count(*) AS n, round(median({agreed} / sqrt({scoreable} * total) - tau_all), 6) AS err, round(median({agreed} / {scoreable} - tau_all), 6) AS err_tied, count(*) FILTER (round(tau_all - {none}, 9) <= 0.05::DOUBLE) AS hits FROM mx GROUP BY radius",
    )
    out["a17_horizon_agreement"] = q(
        f"{CELLS}, tp AS (SELECT *, max(kendall_tau) OVER (PARTITION BY richness, seed) AS top FROM cells), rs AS (SELECT richness, seed, min(CASE WHEN top > 0 AND kendall_tau >= 0.95::DOUBLE * top THEN radius END) AS r_star FROM tp GROUP BY richness, seed), ct AS (SELECT richness, r_star, count(*) AS c FROM rs WHERE r_star IS NOT NULL GROUP BY ALL), md AS (SELECT richness, r_star, c AS agree, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY richness ORDER BY c DESC, r_star) AS r, sum(c) OVER (PARTITION BY richness) AS n FROM ct) WHERE r = 1)",
        "SELECT *, r_star IS NOT DISTINCT FROM (SELECT r_star FROM md WHERE richness = 'node') AS same FROM md",
    )
    out["a22_rung_gains"] = q(
        f"{CELLS}, ob AS (SELECT radius, richness, seed, 'raw' AS objective, kendall_tau FROM cells UNION ALL SELECT radius, richness, seed, 'log1p', kendall_tau * (1 + 0.01::DOUBLE * seed) FROM cells)",
        "SELECT radius, objective, count(*) AS n, CASE WHEN radius > 0 THEN round(avg(a.kendall_tau - b.kendall_tau), 6) + 0.0 END AS gain, CASE WHEN radius > 0 THEN round(stddev_samp(a.kendall_tau - b.kendall_tau), 6) END AS sd, radius = 0 AS degenerate FROM ob a JOIN ob b USING (radius, objective, seed) WHERE a.richness = 'all' AND b.richness = 'node' GROUP BY radius, objective",
    )
    out["a23_share_drops"] = q(CELLS, "SELECT radius, count(*) AS n, round(avg(a.kendall_tau - b.kendall_tau), 6) + 0.0 AS drop, abs(round(avg(a.kendall_tau - b.kendall_tau), 9)) <= 0.02::DOUBLE AS within FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness = 'node' AND b.richness = 'all' GROUP BY radius")
    out["a24_transfer_summary"] = q(
        f"{CELLS}, al AS (SELECT radius, CASE WHEN radius < 3 THEN avg(kendall_tau) END AS within, CASE WHEN radius > 0 THEN min(kendall_tau) END AS floor FROM cells WHERE richness = 'all' GROUP BY radius), tr AS (SELECT radius, avg(kendall_tau) AS tau, stddev_samp(kendall_tau) AS sd, count(*) AS seeds FROM cells WHERE richness = 'node' GROUP BY radius)",
        "SELECT radius, round(tau, 6) AS tau, round(sd, 6) AS sd, seeds, round(within, 6) AS within, round(floor, 6) AS floor, round(tau / within, 6) AS kept, CASE WHEN within IS NULL OR floor IS NULL THEN 'unscored' WHEN round(tau - floor, 9) > 0 THEN 'transfers' ELSE 'floor' END AS verdict FROM tr JOIN al USING (radius)",
    )
    numbers = ", ".join(f"CASE WHEN radius < 2 THEN round({x}, 6) + 0.0 END AS {n}" for n, x in (("mean_left", "avg(a.kendall_tau)"), ("mean_right", "avg(b.kendall_tau)"), ("mean_difference", "avg(a.kendall_tau - b.kendall_tau)"), ("sd_difference", "stddev_samp(a.kendall_tau - b.kendall_tau)"), ("covariance", "covar_samp(a.kendall_tau, b.kendall_tau)")))
    out["a27_arm_contrasts"] = q(CELLS, f"SELECT radius, a.richness AS left_arm, b.richness AS right_arm, CASE radius WHEN 2 THEN 'missing' WHEN 3 THEN 'infeasible' ELSE 'scored' END AS status, {numbers}, radius < 2 AND abs(avg(a.kendall_tau - b.kendall_tau)) > 2 * stddev_samp(a.kendall_tau - b.kendall_tau) AS starred FROM cells a JOIN cells b USING (radius, seed) WHERE a.richness <> b.richness GROUP BY radius, a.richness, b.richness")
    out["a36_pooled_noise"] = q(f"{CELLS}, vr AS (SELECT richness, radius, var_samp(kendall_tau) AS v FROM cells GROUP BY ALL)", "SELECT richness, count(*) AS groups, round(sqrt(avg(v)), 9) AS pooled_sd FROM vr GROUP BY richness")
    out["a39_replicate_noise"] = q(CELLS, "SELECT radius, richness, round(stddev_samp(kendall_tau), 6) AS sd_refit, round(avg(kendall_tau), 6) AS tau_refit_mean, round(stddev_samp(kendall_tau) / (0.01::DOUBLE * radius), 6) AS refit_over_frozen FROM cells WHERE radius > 0 GROUP BY radius, richness")
    out["a40_evicted_cells"] = q(CELLS, "SELECT radius, richness, seed FROM cells WHERE radius <> 1")
    out["r10_reconciled_cells"] = q(CELLS, "SELECT radius, richness, seed, 0 AS seq, seed >= 2 AS kept FROM cells UNION ALL SELECT radius, richness, seed, 1, TRUE FROM cells WHERE seed < 2")
    return out
