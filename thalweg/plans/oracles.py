"""The queries in SQL for DuckDB, written apart from the operators they check."""

from __future__ import annotations

from ..config import FINAL_SETTINGS
from . import queries as q
from . import standin

_D = standin.for_duckdb
SP = f"profile AS ({_D(standin.SHORT)})"
LP = f"profile AS ({_D(standin.LONG)})"
_BREAKS = q.BREAKS
for _x in ("1000.0D", "2000.0D", "4000.0D", "1.0D", "2.0D", "60.0D", "80.0D", "70.0D", "100.0D", "400.0D"):
    _BREAKS = _BREAKS.replace(f"({_x}", f"({_x[:-1]}::DOUBLE").replace(f" {_x}", f" {_x[:-1]}::DOUBLE")
BR = f"{SP}, breaks AS ({_BREAKS})"
_EVAL = q.EVALUATED.replace("CAST((o_orderkey / 3) % 4 AS INT)", "CAST((o_orderkey // 3) % 4 AS INT)").replace("CAST((o_orderkey / 12) % 3 AS INT)", "CAST((o_orderkey // 12) % 3 AS INT)")
_EVAL = _EVAL.replace("AS STRING", "AS VARCHAR").replace("0.05D", "0.05::DOUBLE").replace("0.01D", "0.01::DOUBLE").replace("0.7D", "0.7::DOUBLE").replace("0.3D", "0.3::DOUBLE")
EV = f"evaluated AS ({_EVAL})"
OBS = "obs AS (SELECT l_partkey AS node_id, l_suppkey AS reach_id, l_extendedprice AS wse_sm, l_discount * 10 AS u, l_tax * 10 AS dark, l_quantity * 1000 AS x FROM lineitem)"
HEIGHTS = "SELECT node_id, median(wse_sm) AS wse FROM obs WHERE u <= 1 AND dark <= 0.5 AND abs(x) BETWEEN 10000 AND 60000 AND wse_sm > 0"

RUNS = f"""{BR}, grid AS (
  SELECT * FROM (VALUES (1000.0::DOUBLE, 'W1km', 1.0::DOUBLE), (1000.0::DOUBLE, 'W1km', 2.0::DOUBLE), (2000.0::DOUBLE, 'W2km', 1.0::DOUBLE), (2000.0::DOUBLE, 'W2km', 2.0::DOUBLE), (4000.0::DOUBLE, 'W4km', 1.0::DOUBLE)) AS t(window_m, window_label, penalty)
), clustered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY mip, family ORDER BY break_m, window_m, penalty, setting) AS cluster_id FROM (
    SELECT *, CASE WHEN break_m - lag(break_m) OVER (PARTITION BY mip, family ORDER BY break_m, window_m, penalty, setting) > 300 THEN 1 ELSE 0 END AS fresh FROM breaks)
), support AS (
  SELECT mip, family, CAST(cluster_id AS INTEGER) AS cluster_id, quantile_cont(break_m, 0.5) AS center_m, count(*) AS n_members, count(DISTINCT window_m) AS n_windows_supported,
         count(DISTINCT penalty) AS n_penalties_supported, count(DISTINCT (window_m, penalty)) AS n_run_pairs_supported, 5::BIGINT AS runs_total, 3::BIGINT AS windows_total,
         count(*) / 5.0::DOUBLE AS frequency, count(DISTINCT (window_m, penalty)) / 5.0::DOUBLE AS support_runs, count(DISTINCT window_m) / 3.0::DOUBLE AS support_windows,
         string_agg(DISTINCT window_label, ',' ORDER BY window_label) AS windows_supported
  FROM clustered GROUP BY ALL
)"""
SUPPORT_COLUMNS = "mip, family, cluster_id, round(center_m, 6) AS center_m, n_members, n_windows_supported, n_penalties_supported, n_run_pairs_supported, runs_total, windows_total, round(frequency, 6) AS frequency, round(support_runs, 6) AS support_runs, round(support_windows, 6) AS support_windows, windows_supported"


def anchored(threshold: float) -> str:
    """Anchored clusters by a recursive walk over the distinct positions of a path."""
    return f"""places AS (
  SELECT mip, family, break_m, row_number() OVER (PARTITION BY mip, family ORDER BY break_m) AS k FROM (SELECT DISTINCT mip, family, break_m FROM breaks)
), walk AS (
  SELECT mip, family, break_m, k, break_m AS anchor, 0 AS cluster_id FROM places WHERE k = 1
  UNION ALL
  SELECT p.mip, p.family, p.break_m, p.k, CASE WHEN p.break_m - w.anchor > {threshold} THEN p.break_m ELSE w.anchor END,
         CASE WHEN p.break_m - w.anchor > {threshold} THEN w.cluster_id + 1 ELSE w.cluster_id END
  FROM walk w JOIN places p ON p.mip = w.mip AND p.family = w.family AND p.k = w.k + 1
), agreed AS (
  SELECT b.mip, b.family, w.cluster_id, quantile_cont(b.break_m, 0.5) AS center_m, min(b.break_m) AS min_m, max(b.break_m) AS max_m, count(*) AS n_members,
         count(DISTINCT b.setting) AS n_settings_supported, max(b.n_settings) AS n_settings_valid,
         list(struct_pack(m := b.break_m, s := b.setting) ORDER BY b.break_m, b.setting) AS members
  FROM breaks b JOIN walk w USING (mip, family, break_m) GROUP BY b.mip, b.family, w.cluster_id
), consensus AS (
  SELECT *, max_m - min_m AS span_m, n_settings_supported / n_settings_valid::DOUBLE AS support,
         CASE WHEN n_settings_supported / n_settings_valid::DOUBLE >= 0.75 THEN 'core' WHEN n_settings_supported / n_settings_valid::DOUBLE >= 0.5 THEN 'medium' ELSE 'weak' END AS support_class
  FROM agreed
)"""


STABLE = f"WITH RECURSIVE {BR}, {anchored(900)}, stable AS (SELECT DISTINCT mip, round(center_m, 6) AS b FROM consensus WHERE n_settings_supported >= 3)"
LABELS = f"{STABLE}, labels AS (SELECT p.mip, p.pos, p.dist_m, CAST((SELECT count(*) FROM stable s WHERE s.mip = p.mip AND s.b <= p.dist_m) AS INTEGER) AS label FROM profile p)"
EXACT = f"""{BR}, exact AS (
  SELECT mip, family, n_settings, break_m, count(DISTINCT setting) AS n_supported, string_agg(DISTINCT setting, ',' ORDER BY setting) AS settings_supported FROM breaks GROUP BY ALL
), gaps AS (
  SELECT *, n_supported / n_settings::DOUBLE AS support, break_m - lag(break_m) OVER w AS gap_before_m, lead(break_m) OVER w - break_m AS gap_after_m, lead(break_m) OVER w AS right_m,
         lead(n_supported / n_settings::DOUBLE) OVER w AS right_support
  FROM exact WINDOW w AS (PARTITION BY mip, family ORDER BY break_m)
), pairs AS (
  SELECT mip, family, break_m AS left_m, right_m, support AS left_support, right_support, right_m - break_m AS gap_m, (right_m - break_m) / 1000 AS gap_km,
         CASE WHEN greatest(support, right_support) >= 0.6 AND least(support, right_support) <= 0.2 THEN 'likely_same' WHEN least(support, right_support) >= 0.4 THEN 'risky' ELSE 'intermediate' END AS pair_type
  FROM gaps WHERE right_m IS NOT NULL
)"""
SWEEP = f"""{EXACT}, limits AS (SELECT unnest([0.4, 0.8, 1.5, 2.5, 4.0, 6.0])::DOUBLE AS upper_km), fam AS (
  SELECT upper_km, family, count(*) AS n_pairs, quantile_cont(gap_km, 0.9) AS q90, quantile_cont(gap_km, 0.95) AS q95
  FROM pairs JOIN limits ON gap_km <= upper_km WHERE pair_type = 'likely_same' AND family IN ('w2', 'w3', 'w4', 'w5') GROUP BY ALL HAVING count(*) >= 2
), shares AS (
  SELECT *, sum(n_pairs) OVER (PARTITION BY upper_km ORDER BY q90, n_pairs ROWS UNBOUNDED PRECEDING) / sum(n_pairs) OVER (PARTITION BY upper_km) AS s90,
            sum(n_pairs) OVER (PARTITION BY upper_km ORDER BY q95, n_pairs ROWS UNBOUNDED PRECEDING) / sum(n_pairs) OVER (PARTITION BY upper_km) AS s95 FROM fam
), sweep AS (
  SELECT l.upper_km, a.* EXCLUDE (upper_km), rint(((mean90 + median90) / 2 + (mean95 + median95) / 2) / 2 / 0.1) * 0.1 AS threshold_km
  FROM limits l LEFT JOIN (
    SELECT upper_km, count(*) AS n_families, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, sum(q90 * n_pairs) / sum(n_pairs) AS mean90, sum(q95 * n_pairs) / sum(n_pairs) AS mean95,
           min(q90) FILTER (s90 >= 0.5) AS median90, min(q95) FILTER (s95 >= 0.5) AS median95, string_agg(family, ',' ORDER BY family) AS families
    FROM shares GROUP BY upper_km) a USING (upper_km)
)""".replace("rint(", "round_even(").replace("/ 0.1) * 0.1", "/ 0.1, 0) * 0.1")
SETTINGS = f"""{EV}, rel AS (
  SELECT *, final_sse / min(final_sse) OVER (PARTITION BY mip, family) AS sse_ratio, ch / max(ch) OVER (PARTITION BY mip, family) AS ch_ratio FROM evaluated
), settings AS (
  SELECT family, setting, min_windows, min_support_runs, stop_relative, count(DISTINCT mip) AS n_paths, avg(ch) AS mean_ch, stddev_samp(ch) AS sd_ch, avg(centrality) AS mean_centrality,
         avg(sse_ratio) AS mean_sse_ratio, avg(n_breaks) AS mean_breaks, stddev_samp(n_breaks) AS sd_breaks, avg(mean_span_m) / 1000 AS mean_span_km, avg(span_penalty) AS mean_span_penalty
  FROM rel GROUP BY 1, 2, 3, 4, 5
), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY min_windows) AS r1, dense_rank() OVER (PARTITION BY family ORDER BY min_support_runs) AS r2,
         dense_rank() OVER (PARTITION BY family ORDER BY stop_relative) AS r3 FROM settings
), near AS (
  SELECT a.family, a.setting, avg(abs(a.mean_centrality - b.mean_centrality) + 0.2 * abs(a.mean_span_km - b.mean_span_km) + 0.15 * abs(a.mean_breaks - b.mean_breaks)
         + 0.15 * abs(a.mean_sse_ratio - b.mean_sse_ratio) + 0.1 * abs(a.mean_ch - b.mean_ch)) AS instability, count(*) AS n_neighbours
  FROM ranked a JOIN ranked b ON a.family = b.family AND abs(a.r1 - b.r1) + abs(a.r2 - b.r2) + abs(a.r3 - b.r3) = 1 GROUP BY 1, 2
), measured AS (
  SELECT r.family, r.setting, r1, r2, r3, n_paths, round(mean_ch, 5) AS mean_ch, round(mean_centrality, 5) AS mean_centrality, round(instability, 5) AS instability,
         round(mean_span_penalty, 5) AS mean_span_penalty, round(mean_sse_ratio, 5) AS mean_sse_ratio FROM ranked r LEFT JOIN near n USING (family, setting)
), front AS (
  SELECT a.*, NOT EXISTS (SELECT 1 FROM measured b WHERE b.family = a.family AND b.mean_ch >= a.mean_ch AND b.mean_centrality >= a.mean_centrality AND b.instability <= a.instability
      AND b.mean_span_penalty <= a.mean_span_penalty AND b.mean_sse_ratio <= a.mean_sse_ratio AND (b.mean_ch > a.mean_ch OR b.mean_centrality > a.mean_centrality OR b.instability < a.instability
      OR b.mean_span_penalty < a.mean_span_penalty OR b.mean_sse_ratio < a.mean_sse_ratio)) AS is_pareto FROM measured a
), reps AS (
  SELECT * FROM front WHERE is_pareto QUALIFY row_number() OVER (PARTITION BY family ORDER BY mean_ch DESC NULLS LAST, mean_centrality DESC NULLS LAST, instability NULLS LAST, mean_span_penalty NULLS LAST, mean_sse_ratio NULLS LAST, setting) = 1
)"""
EXPAND = f"""{SP}, expanded AS (
  SELECT p.*, w.window_m, w.half FROM profile p JOIN (SELECT mip, count(*) AS n FROM profile GROUP BY mip) c USING (mip)
  JOIN (VALUES (1000.0::DOUBLE, 5, 2), (2000.0::DOUBLE, 10, 5)) AS w(window_m, pts, half) ON w.pts <= c.n
)"""


def _frames(body: str) -> str:
    """A select over each window size, with its own frame."""
    return " UNION ALL ".join(body.replace("{H}", str(h)).replace("{M}", str(m)) for m, h in ((1000, 2), (2000, 5)))


#: Segments of the cut lines by reach, with the gap before each reach.
def _cut(gap: str) -> str:
    return f"""{SP}, ends AS (SELECT *, max(pos) OVER (PARTITION BY mip) AS last FROM profile),
        points AS (SELECT mip, last, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, pos // 10 AS r, {gap} AS gap FROM ends WINDOW w AS (PARTITION BY mip ORDER BY pos)),
        seg AS (SELECT mip, last, pos, r, CASE WHEN r > 0 AND pos % 10 = 0 THEN x + gap ELSE x END AS xa, y AS ya, x2 AS xb, y2 AS yb, x, gap FROM points WHERE x2 IS NOT NULL)"""


#: Change points of the two windows and four penalties: features, prefix sums, and the recursion over ends with the best sums as a list.
CHANGES = f"""WITH RECURSIVE {EXPAND}, logged AS (SELECT *, CASE WHEN width > 0 THEN ln(width) END AS lw, CAST(n_channels > 1 AS DOUBLE) AS multi FROM expanded),
    rolled AS (""" + _frames("""SELECT mip, window_m, pos, CASE WHEN count(lw) OVER w >= 5 THEN quantile_cont(lw, 0.5) OVER w END AS a, CASE WHEN count(multi) OVER w >= 5 THEN avg(multi) OVER w END AS b
        FROM logged WHERE window_m = {M} WINDOW w AS (PARTITION BY mip ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)""") + """),
    scaled AS (SELECT mip, window_m, pos, CASE WHEN stddev_pop(a) OVER w > 0 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE a * 0 END AS a, CASE WHEN stddev_pop(b) OVER w > 0 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE b * 0 END AS b FROM rolled WINDOW w AS (PARTITION BY mip, window_m)),
    filled AS (SELECT mip, window_m, pos, coalesce(a, quantile_cont(a, 0.5) OVER w, 0) AS a, coalesce(b, quantile_cont(b, 0.5) OVER w, 0) AS b FROM scaled WINDOW w AS (PARTITION BY mip, window_m)),
    run AS (SELECT mip, window_m, pos, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a + b * b) OVER w AS q FROM filled WINDOW w AS (PARTITION BY mip, window_m ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    lists AS (SELECT mip, window_m, CAST(window_m / 200 AS INTEGER) AS least, count(*) AS n, list_prepend(0.0, list(a ORDER BY pos)) AS a, list_prepend(0.0, list(b ORDER BY pos)) AS b, list_prepend(0.0, list(q ORDER BY pos)) AS q FROM run GROUP BY mip, window_m),
    penalties AS (SELECT unnest([1.0, 2.0, 5.0, 10.0])::DOUBLE AS penalty),
    best(mip, window_m, penalty, k, sums, came) AS (
      SELECT mip, window_m, penalty, 0, [-penalty], [0] FROM lists CROSS JOIN penalties
      UNION ALL
      SELECT mip, window_m, penalty, k, list_append(sums, CASE WHEN len(costs) > 0 THEN list_min(costs) + penalty ELSE 'inf'::DOUBLE END), list_append(came, CASE WHEN len(costs) > 0 THEN CAST(list_position(costs, list_min(costs)) - 1 AS INTEGER) ELSE 0 END)
      FROM (SELECT x.mip, x.window_m, penalty, k + 1 AS k, sums, came, [sums[s + 1] + q[k + 2] - q[s + 1] - (pow(a[k + 2] - a[s + 1], 2) + pow(b[k + 2] - b[s + 1], 2)) / (k + 1 - s) FOR s IN range(0, k + 2 - least)] AS costs
            FROM best x JOIN lists l ON x.mip = l.mip AND x.window_m = l.window_m WHERE k < n)),
    back(mip, window_m, penalty, t, found, came) AS (
      SELECT x.mip, x.window_m, penalty, CASE WHEN n >= 2 * least THEN came[n + 1] ELSE 0 END, CAST([] AS INTEGER[]), came FROM best x JOIN lists l ON x.mip = l.mip AND x.window_m = l.window_m WHERE k = n
      UNION ALL
      SELECT mip, window_m, penalty, came[t + 1], list_prepend(CAST(t AS INTEGER), found), came FROM back WHERE t > 0),
    changes AS (SELECT mip, window_m, penalty, n, least, found FROM back JOIN lists USING (mip, window_m) WHERE t = 0)"""
CHANGE_POINTS = f"{CHANGES} SELECT mip, window_m, penalty, CAST(n AS INTEGER) AS n_points, least AS min_size, array_to_string(found, ',') AS breaks, CASE WHEN n >= 2 * least THEN 'ok' ELSE 'too_short' END AS status FROM changes"


#: Junctions of the looped main stems by following pairs of ends, and components of what is beside the stem likewise.
LOOPS = f"""WITH RECURSIVE {LP}, reaches AS (
      SELECT mip, mip * 1000000 + pos AS r, true AS main, CASE WHEN pos % 10 = 3 THEN [mip * 1000000 + pos + 1, mip * 1000000 + 500000 + pos] WHEN pos % 20 = 4 THEN [mip * 1000000 + pos + 1, mip * 1000000 + 700000 + pos] ELSE [mip * 1000000 + pos + 1] END AS dn FROM profile
      UNION ALL SELECT mip, mip * 1000000 + 500000 + pos, false, [mip * 1000000 + 600000 + pos] FROM profile WHERE pos % 10 = 3
      UNION ALL SELECT mip, mip * 1000000 + 600000 + pos, false, [mip * 1000000 + pos + 4] FROM profile WHERE pos % 10 = 3
      UNION ALL SELECT mip, mip * 1000000 + 700000 + pos, false, [mip * 1000000 + pos + 2] FROM profile WHERE pos % 20 = 4
    ), pairs AS (SELECT 2 * a.r + 1 AS a, 2 * b.r AS b FROM (SELECT r, unnest(dn) AS d FROM reaches) a JOIN reaches b ON a.d = b.r),
    ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    joined(a, b) AS (SELECT a, a FROM ways UNION SELECT j.a, x.b FROM joined j JOIN ways x ON j.b = x.a),
    named AS (SELECT a, min(b) AS n FROM joined GROUP BY a),
    net AS (SELECT mip, r, main, coalesce(u.n, 2 * r) AS u, coalesce(v.n, 2 * r + 1) AS v FROM reaches LEFT JOIN named u ON u.a = 2 * r LEFT JOIN named v ON v.a = 2 * r + 1),
    beside AS (SELECT mip, u AS a, v AS b FROM net WHERE NOT main UNION ALL SELECT mip, v, u FROM net WHERE NOT main),
    linked(mip, a, b) AS (SELECT mip, a, a FROM beside UNION SELECT l.mip, l.a, x.b FROM linked l JOIN beside x ON l.mip = x.mip AND l.b = x.a),
    labels AS (SELECT mip, a AS node, min(b) AS label FROM linked GROUP BY mip, a),
    held AS (SELECT u.mip, u.label, count(*) AS n FROM net JOIN labels u ON u.mip = net.mip AND u.node = net.u JOIN labels v ON v.mip = net.mip AND v.node = net.v AND v.label = u.label GROUP BY ALL HAVING count(*) >= 2),
    parts AS (SELECT mip, label AS component, node, n AS n_inside FROM labels JOIN held USING (mip, label))"""


_SETTINGS = ", ".join(f"('{x.label}', {x.min_support_runs}::DOUBLE, {x.min_windows}, {x.stop_relative}::DOUBLE)" for x in FINAL_SETTINGS)
#: Squared error of the rows from lo to hi - 1 over both windows, from their running sums.
_ERROR = lambda lo, hi: f"(q[{hi} + 1] - q[{lo} + 1] - (pow(a1[{hi} + 1] - a1[{lo} + 1], 2) + pow(b1[{hi} + 1] - b1[{lo} + 1], 2) + pow(a2[{hi} + 1] - a2[{lo} + 1], 2) + pow(b2[{hi} + 1] - b2[{lo} + 1], 2)) / ({hi} - {lo}))"
#: Selections of the final settings: clusters of the changes, candidates by support, and the greedy choice, one break in each step.
CHOSEN = f"""{CHANGES}, found_breaks AS (SELECT mip, window_m, penalty, 200.0::DOUBLE * (unnest(found) + 1) AS break_m FROM changes),
    chained AS (SELECT *, sum(fresh) OVER (PARTITION BY mip ORDER BY break_m, window_m, penalty ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN break_m - lag(break_m) OVER (PARTITION BY mip ORDER BY break_m, window_m, penalty) > 1000 THEN 1 ELSE 0 END AS fresh FROM found_breaks)),
    totals AS (SELECT mip, count(*) AS runs, count(DISTINCT window_m) AS windows FROM changes GROUP BY mip),
    clusters AS (SELECT mip, round(quantile_cont(break_m, 0.5), 6) AS m, count(DISTINCT (window_m, penalty)) AS pairs, count(DISTINCT window_m) AS seen FROM chained GROUP BY mip, c),
    wanted AS (SELECT * FROM (VALUES {_SETTINGS}) AS t(setting, least_runs, least_windows, stop)),
    sums AS (SELECT x.mip, x.n, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2, [x.q[k] + y.q[k] FOR k IN range(1, x.n + 2)] AS q FROM lists x JOIN lists y ON x.mip = y.mip WHERE x.window_m = 1000 AND y.window_m = 2000),
    offered AS (
      SELECT s.mip, w.setting, w.stop, coalesce(list(DISTINCT m ORDER BY m) FILTER (WHERE m IS NOT NULL), []) AS offers FROM sums s CROSS JOIN wanted w JOIN totals t ON t.mip = s.mip
      LEFT JOIN clusters c ON c.mip = s.mip AND c.pairs / t.runs::DOUBLE >= w.least_runs AND c.seen >= least(w.least_windows, t.windows) AND c.m > 200 AND c.m < 200 * s.n GROUP BY ALL),
    greedy(mip, setting, step, error, cuts, picked, gains) AS (
      SELECT o.mip, o.setting, 0, {_ERROR("0", "n")}, [0, CAST(n AS BIGINT)], CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) FROM offered o JOIN sums s ON s.mip = o.mip WHERE len(offers) > 0
      UNION ALL
      SELECT mip, setting, step + 1, error - best.g, list_sort(list_distinct(list_append(cuts, best.i))), list_append(picked, best.m), list_append(gains, best.g)
      FROM (SELECT *, list_filter(tried, lambda t: t.g > list_max([t2.g FOR t2 IN tried]) - 1e-12)[1] AS best FROM (
        SELECT mip, setting, step, error, cuts, picked, gains,
               [{{'m': p.m, 'i': p.i, 'g': CASE WHEN p.i = p.lo THEN 0 ELSE {_ERROR("p.lo", "p.hi")} - {_ERROR("p.lo", "p.i")} - {_ERROR("p.i", "p.hi")} END}} FOR p IN
                 [{{'m': c.m, 'i': c.i, 'lo': list_max(list_filter(cuts, lambda x: x <= c.i)), 'hi': list_min(list_filter(cuts, lambda x: x > c.i))}} FOR c IN
                   [{{'m': m, 'i': CAST(ceil(m / 200) - 1 AS BIGINT)}} FOR m IN offers IF len(list_filter(picked, lambda x: abs(x - m) < 1000)) = 0] IF c.i > 0 AND c.i < n]] AS tried
        FROM (SELECT g.*, o.offers, s.n, s.a1, s.b1, s.a2, s.b2, s.q FROM greedy g JOIN offered o ON o.mip = g.mip AND o.setting = g.setting JOIN sums s ON s.mip = g.mip WHERE g.step < 30)) WHERE len(tried) > 0)
      WHERE best.g > 1e-12),
    ways AS (SELECT mip, setting, picked, gains, error FROM greedy QUALIFY row_number() OVER (PARTITION BY mip, setting ORDER BY step DESC) = 1),
    based AS (SELECT mip, setting, error AS base FROM greedy WHERE step = 0),
    stopped AS (
      SELECT o.mip, o.setting, o.offers, base, picked, gains, CASE WHEN picked IS NULL THEN 0 ELSE coalesce(list_min([k FOR k IN range(1, len(gains) + 1) IF (CASE WHEN base > 0 THEN gains[k] / base ELSE 0 END) < o.stop]) - 1, len(gains)) END AS k
      FROM offered o LEFT JOIN ways w ON w.mip = o.mip AND w.setting = o.setting LEFT JOIN based b ON b.mip = o.mip AND b.setting = o.setting),
    selections AS (
      SELECT mip, 'w2' AS family, setting, CASE WHEN len(offers) > 0 THEN 'ok' ELSE 'no_candidates' END AS status, len(offers) AS n_candidates, k AS n_breaks, base, base - coalesce(list_sum(gains[:k]), 0) AS final, coalesce(list_sort(picked[:k]), []) AS chosen FROM stopped)"""
AGREED = f"""{CHOSEN}, breaks AS (SELECT mip, family, setting, unnest(chosen) AS break_m, n_settings FROM (SELECT *, count(*) FILTER (WHERE status = 'ok') OVER (PARTITION BY mip, family) AS n_settings FROM selections) WHERE status = 'ok'),
    {anchored(1500)}, stable AS (SELECT DISTINCT mip, round(center_m, 6) AS b FROM consensus WHERE n_settings_supported >= 4),
    labels AS (SELECT p.mip, p.pos, p.dist_m, (SELECT count(*) FROM stable s WHERE s.mip = p.mip AND s.b <= p.dist_m) AS label FROM profile p),
    segments AS (SELECT mip, min(pos) AS first_pos, max(pos) + 1 AS end_pos, count(*) AS n_nodes, min(dist_m) AS start_m, max(dist_m) AS end_m FROM labels GROUP BY mip, label)"""


ORACLES: dict[str, str] = {
    "profile_short": f"WITH {SP} SELECT mip, pos, dist_m, round(CASE WHEN width > 0 THEN ln(width) END, 6) AS log_width, CAST(n_channels > 1 AS DOUBLE) AS multi FROM profile",
    "node_heights": f"WITH {OBS} SELECT node_id, round(wse, 6) AS wse FROM ({HEIGHTS} AND reach_id IN (SELECT s_suppkey FROM supplier) GROUP BY node_id)",
    "nodes_with_heights": f"WITH {OBS}, h AS ({HEIGHTS} GROUP BY node_id) SELECT p_partkey AS node_id, p_size AS reach_id, round(wse, 6) AS wse FROM part LEFT JOIN h ON node_id = p_partkey",
    "enriched_nodes": "SELECT p_partkey AS node_id, round(p_size + coalesce(CAST(s_nationkey AS DOUBLE), 0), 6) AS multi_n_chan, round(p_retailprice + coalesce(s_acctbal, 0), 6) AS multi_width FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "ordered_nodes": "SELECT l_suppkey AS mip, l_orderkey * 10 + l_linenumber AS node_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, round(sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS dist_m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber)",
    "reach_means": "SELECT l_suppkey AS reach_id, round(avg(l_quantity), 6) AS mean_n_channels FROM lineitem GROUP BY 1",
    "distance_faults": f"WITH {SP} SELECT mip, count(*) AS n_faults FROM (SELECT mip, width - lag(width) OVER (PARTITION BY mip ORDER BY pos) AS step FROM profile) WHERE step <= 0 GROUP BY mip",
    "feature_health": f"""WITH {SP}, long AS (SELECT 'width' AS feature, width AS v FROM profile UNION ALL SELECT 'n_channels', n_channels FROM profile UNION ALL SELECT 'logw', CASE WHEN width > 50 THEN width END FROM profile)
        SELECT feature, count(*) AS n, round(avg(CAST(v IS NULL AS DOUBLE)), 6) AS missing_fraction, count(DISTINCT v) AS n_unique, round(min(v), 6) AS low, round(max(v), 6) AS high FROM long GROUP BY 1""",
    "spacing_and_quantiles": f"""WITH {LP}, s AS (SELECT *, dist_m - lag(dist_m) OVER (PARTITION BY mip ORDER BY pos) AS step FROM profile)
        SELECT mip, round(quantile_cont(step, 0.5) FILTER (step > 0), 6) AS spacing_m, round(quantile_cont(width, 0.1) FILTER (width > 0), 6) AS width_low, round(quantile_cont(width, 0.9) FILTER (width > 0), 6) AS width_high FROM s GROUP BY mip""",
    "window_plan": f"""WITH {LP}, s AS (SELECT *, dist_m - lag(dist_m) OVER (PARTITION BY mip ORDER BY pos) AS step FROM profile), facts AS (
        SELECT mip, count(*) AS n, max(dist_m) - min(dist_m) AS length, quantile_cont(step, 0.5) FILTER (step > 0) AS sp, quantile_cont(width, 0.1) FILTER (width > 0) AS lo, quantile_cont(width, 0.9) FILTER (width > 0) AS hi FROM s GROUP BY mip),
        b AS (SELECT *, greatest(36 * lo, 5 * sp) AS wmin FROM facts), c AS (SELECT *, greatest(least(36 * hi, 0.15 * length), wmin) AS wmax FROM b),
        f AS (SELECT * FROM (VALUES ('raw', 1), ('w2', 2), ('w3', 3), ('w4', 4), ('w5', 5)) AS t(family, k)),
        g AS (SELECT c.*, f.family, f.k, i.i FROM c CROSS JOIN f CROSS JOIN (SELECT unnest(range(0, 5)) AS i) i WHERE i.i < f.k),
        h AS (SELECT DISTINCT mip, family, n, sp, CASE WHEN family = 'raw' THEN 0 ELSE greatest(round_even(CASE WHEN abs(wmax - wmin) <= 1e-8 + 1e-5 * abs(wmax) THEN wmin ELSE exp(ln(wmin) + i * (ln(wmax) - ln(wmin)) / (k - 1)) END / sp, 0) * sp, 5 * sp) END AS window_m FROM g)
        SELECT mip, family, CAST(row_number() OVER (PARTITION BY mip, family ORDER BY window_m) - 1 AS INTEGER) AS window_order, round(window_m, 6) AS window_m,
          CASE WHEN window_m = 0 THEN 'Wraw' ELSE 'W' || regexp_replace(printf('%.5f', window_m / 1000), '\\.?0+$', '') || 'km' END AS window_label,
          CAST(CASE WHEN window_m = 0 THEN 1 ELSE greatest(round_even(window_m / sp, 0), 3) END AS INTEGER) AS window_pts,
          CASE WHEN window_m = 0 THEN 1 ELSE greatest(round_even(window_m / sp, 0), 3) END <= n AS is_feasible FROM h""",
    "window_feasibility": f"""WITH {SP}, c AS (SELECT mip, count(*) AS n FROM profile GROUP BY mip), w AS (SELECT unnest([5, 55, 65]) AS pts),
        f AS (SELECT mip, n AS n_nodes, count(*) AS n_windows, count(*) FILTER (pts <= n) AS n_feasible FROM c CROSS JOIN w GROUP BY ALL)
        SELECT mip, n_windows, n_feasible, n_nodes, CASE WHEN n_feasible < n_windows THEN 'window_exceeds_path' END AS reason FROM f""",
    "rolling_features": f"WITH {EXPAND} " + _frames("""SELECT mip, window_m, pos, CASE WHEN count(width) OVER w >= 5 THEN round(quantile_cont(width, 0.5) OVER w, 6) END AS median, CASE WHEN count(width) OVER w >= 5 THEN round(avg(width) OVER w, 6) END AS mean,
        CASE WHEN count(width) OVER w >= 5 THEN round(sqrt(avg(width * width) OVER w), 6) END AS rms, CASE WHEN count(width) OVER w >= 5 THEN round(quantile_cont(width, 0.9) OVER w, 6) END AS p90,
        CASE WHEN count(n_channels) OVER w >= 5 THEN CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1.0 WHEN c2 >= c3 THEN 2.0 ELSE 3.0 END::DOUBLE END AS mode
        FROM (SELECT *, count(*) FILTER (n_channels = 1) OVER v AS c1, count(*) FILTER (n_channels = 2) OVER v AS c2, count(*) FILTER (n_channels = 3) OVER v AS c3 FROM expanded WHERE window_m = {M} WINDOW v AS (PARTITION BY mip ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING))
        WINDOW w AS (PARTITION BY mip ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)"""),
    "rolling_slope": f"""WITH {SP}, k AS (SELECT mip, pos, dist_m, CASE WHEN node_id % 7 <> 0 THEN wse END AS y FROM profile)
        SELECT mip, pos, round(CASE WHEN count(y) OVER w >= 12 THEN -regr_slope(y, dist_m) OVER w END, 6) AS slope FROM k WINDOW w AS (PARTITION BY mip ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""",
    "filled_gaps": f"""WITH {SP}, v AS (SELECT mip, pos, CASE WHEN (pos % 20 < 7 AND pos % 3 <> 1) OR pos % 20 = 12 THEN width END AS v FROM profile),
        n AS (SELECT a.mip, a.pos, a.v, (SELECT max(pos) FROM v b WHERE b.mip = a.mip AND b.pos <= a.pos AND b.v IS NOT NULL) AS p0, (SELECT min(pos) FROM v b WHERE b.mip = a.mip AND b.pos >= a.pos AND b.v IS NOT NULL) AS p1 FROM v a),
        l AS (SELECT n.mip, n.pos, CASE WHEN least(coalesce(n.pos - p0, 99999), coalesce(p1 - n.pos, 99999)) <= 3 THEN CASE WHEN n.v IS NOT NULL THEN n.v WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN x.v + (y.v - x.v) * (n.pos - p0) / (p1 - p0) ELSE coalesce(x.v, y.v) END END AS linear
          FROM n LEFT JOIN v x ON x.mip = n.mip AND x.pos = p0 LEFT JOIN v y ON y.mip = n.mip AND y.pos = p1)
        SELECT mip, pos, round(linear, 6) AS linear, round(coalesce(last_value(linear IGNORE NULLS) OVER (PARTITION BY mip ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(linear IGNORE NULLS) OVER (PARTITION BY mip ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM l""",
    "rolling_sinuosity": f"WITH {EXPAND}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM expanded WINDOW w AS (PARTITION BY mip, window_m ORDER BY pos)), r AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY mip, window_m ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s) "
    + _frames("""SELECT mip, window_m, pos, round(CASE WHEN count(*) OVER w >= 5 THEN (last_value(run) OVER w - first_value(run) OVER w) / sqrt(pow(last_value(x) OVER w - first_value(x) OVER w, 2) + pow(last_value(y) OVER w - first_value(y) OVER w, 2)) END, 6) AS sinuosity
        FROM r WHERE window_m = {M} WINDOW w AS (PARTITION BY mip ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING)"""),
    "moving_average": f"""WITH {SP}, n AS (SELECT *, count(*) OVER (PARTITION BY mip) AS n FROM profile), o AS (SELECT a.mip, a.pos, k.k, greatest(0, least(a.n - 1, a.pos + k.k)) AS at FROM n a CROSS JOIN (SELECT unnest(range(-4, 5)) AS k) k)
        SELECT o.mip, o.pos, round(avg(p.width), 6) AS smooth FROM o JOIN profile p ON p.mip = o.mip AND p.pos = o.at GROUP BY 1, 2""",
    "curvature": f"""WITH {SP}, a AS (SELECT mip, pos, count(*) OVER (PARTITION BY mip) AS n,
          CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / 200 WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / 200 ELSE (lead(x) OVER w - lag(x) OVER w) / 400 END AS dx,
          CASE WHEN lag(y) OVER w IS NULL THEN (lead(y) OVER w - y) / 200 WHEN lead(y) OVER w IS NULL THEN (y - lag(y) OVER w) / 200 ELSE (lead(y) OVER w - lag(y) OVER w) / 400 END AS dy FROM profile WINDOW w AS (PARTITION BY mip ORDER BY pos)),
        b AS (SELECT *, CASE WHEN lag(dx) OVER w IS NULL THEN (lead(dx) OVER w - dx) / 200 WHEN lead(dx) OVER w IS NULL THEN (dx - lag(dx) OVER w) / 200 ELSE (lead(dx) OVER w - lag(dx) OVER w) / 400 END AS ddx,
          CASE WHEN lag(dy) OVER w IS NULL THEN (lead(dy) OVER w - dy) / 200 WHEN lead(dy) OVER w IS NULL THEN (dy - lag(dy) OVER w) / 200 ELSE (lead(dy) OVER w - lag(dy) OVER w) / 400 END AS ddy FROM a WINDOW w AS (PARTITION BY mip ORDER BY pos))
        SELECT mip, pos, round(CASE WHEN n >= 5 THEN (dx * ddy - dy * ddx) / greatest(pow(dx * dx + dy * dy, 1.5), 1e-12) END, 9) AS kappa FROM b""",
    "standardized": f"""WITH {SP}, v AS (SELECT mip, pos, CASE WHEN pos % 5 <> 2 THEN width END AS v FROM profile), z AS (SELECT mip, pos, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM v WINDOW w AS (PARTITION BY mip)), m AS (SELECT mip, quantile_cont(z, 0.5) AS m FROM z GROUP BY mip)
        SELECT mip, pos, round(coalesce(z, m), 6) AS v, 0.0::DOUBLE AS flat FROM z JOIN m USING (mip)""",
    "useful_features": f"WITH {SP} SELECT mip, 'width' AS feature, round(stddev_pop(width), 6) AS deviation FROM profile GROUP BY mip HAVING stddev_pop(width) > 1e-12 UNION ALL SELECT mip, 'n_channels', round(stddev_pop(n_channels), 6) FROM profile GROUP BY mip HAVING stddev_pop(n_channels) > 1e-12",
    "nan_rates": f"""WITH {SP}, l AS (SELECT mip, 'v' AS feature, CASE WHEN pos % 5 <> 2 THEN width END AS x FROM profile UNION ALL SELECT mip, 'width', width FROM profile)
        SELECT mip, 0.0::DOUBLE AS window_m, feature, count(*) AS n, count(x) AS n_finite, count(*) - count(x) AS n_missing, round(avg(CAST(x IS NULL AS DOUBLE)), 6) AS missing_fraction FROM l GROUP BY mip, feature""",
    "chain_clusters": f"WITH {RUNS} SELECT mip, family, CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS n, min(break_m) AS lo, max(break_m) AS hi FROM clustered GROUP BY ALL",
    "support_table": f"WITH {RUNS} SELECT {SUPPORT_COLUMNS} FROM support",
    "candidates": f"WITH {RUNS}, e AS (SELECT mip, min(dist_m) AS lo, max(dist_m) AS hi FROM profile GROUP BY mip) SELECT DISTINCT mip, family, round(center_m, 6) AS center_m FROM support JOIN e USING (mip) WHERE support_runs >= 0.4 AND n_windows_supported >= 2 AND support_windows >= 0.5 AND center_m > lo AND center_m < hi",
    "all_run_candidates": f"WITH {RUNS} SELECT mip, family, round(center_m, 6) AS center_m FROM support",
    "consensus_table": f"""WITH RECURSIVE {BR}, {anchored(900)} SELECT mip, family, cluster_id, round(center_m, 6) AS center_m, min_m, max_m, span_m, n_members, n_settings_supported, round(support, 6) AS support, support_class,
        CAST(ceil(0.6 * n_settings_valid - 1e-12) AS INTEGER) AS stable_support_count, support >= 0.6 AS is_stable,
        (SELECT string_agg(s, ',' ORDER BY first) FROM (SELECT m.s, min(i) AS first FROM (SELECT unnest(members) AS m, generate_subscripts(members, 1) AS i) GROUP BY 1)) AS settings_supported FROM consensus""",
    "stable_segments": f"""{LABELS}, g AS (SELECT mip, label, min(pos) AS first_pos, max(pos) + 1 AS end_pos, count(*) AS n_nodes, min(dist_m) AS start_m, max(dist_m) AS end_m FROM labels GROUP BY 1, 2)
        SELECT mip, first_pos, end_pos, n_nodes, start_m, end_m, CAST(row_number() OVER (PARTITION BY mip ORDER BY first_pos) - 1 AS INTEGER) AS segment_id FROM g""",
    "segment_labels": f"{LABELS} SELECT mip, pos, label FROM labels",
    "cut_indices": f"WITH {BR} SELECT b.mip, b.break_m, CAST(count(*) FILTER (p.dist_m < b.break_m) AS INTEGER) AS cut FROM (SELECT DISTINCT mip, break_m - 50 AS break_m FROM breaks) b JOIN profile p ON p.mip = b.mip GROUP BY 1, 2",
    "exact_positions": f"WITH {EXACT} SELECT mip, family, n_settings, break_m, n_supported, settings_supported, round(support, 6) AS support, gap_before_m, gap_after_m FROM gaps",
    "gap_pairs": f"WITH {EXACT} SELECT mip, family, left_m, right_m, round(left_support, 6) AS left_support, round(right_support, 6) AS right_support, gap_m, round(gap_km, 6) AS gap_km, pair_type FROM pairs",
    "family_gaps": f"WITH {EXACT} SELECT family, count(*) AS n_pairs, round(quantile_cont(gap_km, 0.9), 6) AS q90_km, round(quantile_cont(gap_km, 0.95), 6) AS q95_km, round(max(gap_km), 6) AS max_km FROM pairs WHERE pair_type = 'likely_same' GROUP BY family HAVING count(*) >= 2",
    "limit_sweep": f"WITH {SWEEP} SELECT upper_km, n_families, n_pairs, round(mean90, 6) AS mean90, round(mean95, 6) AS mean95, round(median90, 6) AS median90, round(median95, 6) AS median95, round(threshold_km, 6) AS threshold_km FROM sweep",
    "plateau": f"""WITH {SWEEP}, n AS (SELECT *, lead(threshold_km) OVER w AS t2, lead(families) OVER w AS f2 FROM sweep WINDOW w AS (ORDER BY upper_km))
        SELECT upper_km, round(threshold_km, 6) AS threshold_km FROM n WHERE threshold_km IS NOT NULL AND t2 IS NOT NULL AND families = f2 AND abs(threshold_km - t2) <= 2.0 AND n_families >= 2 ORDER BY upper_km LIMIT 1""",
    "relative_quality": f"WITH {SETTINGS} SELECT mip, family, setting, round(sse_ratio, 8) AS sse_ratio, round(ch_ratio, 8) AS ch_ratio FROM rel",
    "calinski_harabasz": f"""WITH {SP}, v AS (SELECT mip, pos // 20 AS g, width AS a, n_channels AS b FROM profile WHERE pos % 11 <> 3), m AS (SELECT mip, g, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM v GROUP BY 1, 2), t AS (SELECT mip, count(*) AS nn, avg(a) AS ta, avg(b) AS tb FROM v GROUP BY 1),
        w AS (SELECT v.mip, sum(pow(a - ma, 2) + pow(b - mb, 2)) AS within FROM v JOIN m USING (mip, g) GROUP BY 1), b AS (SELECT m.mip, count(*) AS k, sum(n * (pow(ma - ta, 2) + pow(mb - tb, 2))) AS between_ FROM m JOIN t USING (mip) GROUP BY 1)
        SELECT mip, round(CASE WHEN k >= 2 AND nn > k AND within > 1e-12 THEN (between_ / (k - 1)) / (within / (nn - k)) END, 6) AS ch FROM t JOIN w USING (mip) JOIN b USING (mip)""",
    "span_statistics": f"""WITH RECURSIVE {BR}, {anchored(900)}, d AS (SELECT DISTINCT mip, family, setting, break_m FROM breaks), best AS (
          SELECT d.mip, d.family, d.setting, c.cluster_id, c.span_m, c.support_class, abs(c.center_m - d.break_m) AS away FROM d JOIN consensus c ON c.mip = d.mip AND c.family = d.family
          QUALIFY row_number() OVER (PARTITION BY d.mip, d.family, d.setting, d.break_m ORDER BY abs(c.center_m - d.break_m), c.cluster_id) = 1),
        hit AS (SELECT DISTINCT mip, family, setting, cluster_id, span_m, support_class FROM best WHERE away <= 250),
        s AS (SELECT mip, family, setting, count(*) AS n_matched, count(*) FILTER (support_class = 'core') AS n_core, count(*) FILTER (support_class = 'medium') AS n_medium, count(*) FILTER (support_class = 'weak') AS n_weak, avg(span_m) AS mean_span_m, max(span_m) AS max_span_m FROM hit GROUP BY 1, 2, 3)
        SELECT mip, family, setting, coalesce(n_matched, 0) AS n_matched, coalesce(n_core, 0) AS n_core, coalesce(n_medium, 0) AS n_medium, coalesce(n_weak, 0) AS n_weak, round(coalesce(mean_span_m, 0), 6) AS mean_span_m, round(coalesce(max_span_m, 0), 6) AS max_span_m,
          round(0.7 * coalesce(max_span_m, 0) + 0.3 * coalesce(mean_span_m, 0), 6) AS span_penalty FROM (SELECT DISTINCT mip, family, setting FROM d) LEFT JOIN s USING (mip, family, setting)""",
    "setting_statistics": f"WITH {SETTINGS} SELECT family, setting, n_paths, round(mean_ch, 9) AS mean_ch, round(sd_ch, 9) AS sd_ch, round(mean_centrality, 9) AS mean_centrality, round(mean_sse_ratio, 9) AS mean_sse_ratio, round(mean_breaks, 9) AS mean_breaks, round(sd_breaks, 9) AS sd_breaks, round(mean_span_km, 9) AS mean_span_km, round(mean_span_penalty, 9) AS mean_span_penalty FROM settings",
    "instability": f"WITH {SETTINGS} SELECT family, setting, round(near.instability, 5) AS instability, n_neighbours FROM settings LEFT JOIN near USING (family, setting)",
    "pareto": f"WITH {SETTINGS} SELECT family, setting, is_pareto FROM front",
    "representatives": f"WITH {SETTINGS} SELECT family, setting, mean_ch FROM reps",
    "family_overview": f"WITH {SETTINGS} SELECT f.family, count(*) AS n_settings, count(*) FILTER (f.is_pareto) AS n_pareto, round(max(f.mean_ch), 4) AS best_ch, round(avg(f.mean_ch), 4) AS average_ch, any_value(r.setting) AS rep_setting, round(any_value(r.mean_ch), 4) AS rep_ch FROM front f LEFT JOIN reps r USING (family) GROUP BY f.family",
    "family_rank": f"WITH {SETTINGS} SELECT family, setting, CAST(row_number() OVER (ORDER BY mean_ch DESC NULLS LAST, mean_centrality DESC NULLS LAST, instability NULLS LAST, mean_span_penalty NULLS LAST, mean_sse_ratio NULLS LAST, family) AS INTEGER) AS family_rank FROM reps",
    "local_grid": f"""WITH {SETTINGS}, a AS (SELECT f.*, abs(f.r1 - r.r1) + abs(f.r2 - r.r2) + abs(f.r3 - r.r3) AS step_distance FROM front f JOIN reps r USING (family) WHERE f.is_pareto),
        c AS (SELECT *, count(*) FILTER (step_distance <= 1) OVER (PARTITION BY family) AS near_, row_number() OVER (PARTITION BY family ORDER BY step_distance, mean_ch DESC NULLS LAST, mean_centrality DESC NULLS LAST, instability NULLS LAST, mean_span_penalty NULLS LAST, mean_sse_ratio NULLS LAST, setting) AS n FROM a)
        SELECT family, setting, CAST(step_distance AS INTEGER) AS step_distance FROM c WHERE CASE WHEN near_ >= 4 THEN step_distance <= 1 ELSE n <= 4 END""",
    "compare_families": f"""WITH {SETTINGS}, o AS (SELECT e.mip, e.family, e.ch FROM evaluated e JOIN reps USING (family, setting)), a AS (SELECT mip, ch FROM o WHERE family = '1-URGENT'), b AS (SELECT mip, ch FROM o WHERE family = '2-HIGH')
        SELECT mip, round(a.ch, 8) AS ch_a, round(b.ch, 8) AS ch_b, CASE WHEN b.ch IS NULL THEN 'left_only' WHEN a.ch IS NULL THEN 'right_only' ELSE 'both' END AS source, round((a.ch - b.ch) / greatest(abs(b.ch), 1e-12), 8) AS ch_difference,
          CASE WHEN b.ch IS NULL THEN '1-URGENT' WHEN a.ch IS NULL THEN '2-HIGH' WHEN (a.ch - b.ch) / abs(b.ch) > 0.02 THEN '1-URGENT' WHEN (a.ch - b.ch) / abs(b.ch) < -0.02 THEN '2-HIGH' ELSE 'tie' END AS winner FROM a FULL OUTER JOIN b USING (mip)""",
    "threshold_summary": f"""WITH RECURSIVE {BR}, {anchored(900)}, t AS (SELECT unnest([0.5, 0.625, 0.75, 0.875])::DOUBLE AS threshold),
        p AS (SELECT family, threshold, mip, count(*) FILTER (support >= threshold) AS n_kept, count(*) AS n_all, avg(support) FILTER (support >= threshold) AS s, avg(span_m) FILTER (support >= threshold) AS w, max(span_m) FILTER (support >= threshold) AS x FROM consensus CROSS JOIN t GROUP BY 1, 2, 3)
        SELECT family, threshold, count(*) AS n_paths, round(avg(n_kept), 6) AS mean_kept, round(avg(n_kept / n_all), 6) AS mean_kept_share, round(avg(s), 6) AS mean_support, round(avg(w), 6) AS mean_span_m, round(max(x), 6) AS max_span_m, round(avg(x), 6) AS mean_max_span_m FROM p GROUP BY 1, 2""",
    "percent_rank": """SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS up,
        round((rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS down FROM part""",
    "downstream_pairs": "SELECT DISTINCT l_suppkey AS reach_id, l_partkey % 100 AS dn_id FROM lineitem WHERE l_partkey % 100 <> 0 AND l_partkey % 100 <> l_suppkey",
    "line_graph": "WITH e AS (SELECT o_custkey AS u, (o_orderkey * 7) % 1500 AS v, o_orderkey AS r FROM orders) SELECT DISTINCT a.r AS from_reach, b.r AS to_reach FROM e a JOIN e b ON a.v = b.u WHERE a.r <> b.r",
    "width_summary": """SELECT p_brand AS k, round(CAST(sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END) AS DOUBLE), 6) AS length_m, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(avg(p_retailprice), 6) AS mean,
        round(sum(p_retailprice * (p_size % 5)) / sum(p_size % 5), 6) AS weighted FROM part GROUP BY 1""",
    "line_summary": f"""WITH {SP}, s AS (SELECT mip, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM profile WINDOW w AS (PARTITION BY mip ORDER BY pos))
        SELECT mip AS main_path_id, CAST(count(*) AS INTEGER) AS n_points, count(*) < 2 AS is_empty, round(sum(step), 4) AS length_m FROM s GROUP BY mip""",
    "oriented_lines": f"""WITH {SP}, e AS (SELECT mip, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS zx, arg_max(y, pos) AS zy FROM profile GROUP BY mip), g AS (SELECT mip, 2 * sqrt(pow(ax - zx, 2) + pow(ay - zy, 2)) AS gap FROM e)
        SELECT mip, CASE WHEN mip % 2 = 1 THEN 'reversed_to_match_node_dist' ELSE 'already_oriented' END AS status, mip % 2 = 1 AS reversed, round(CASE WHEN mip % 2 = 1 THEN gap ELSE 0 END, 6) AS error_forward_m,
          round(CASE WHEN mip % 2 = 1 THEN 0 ELSE gap END, 6) AS error_reverse_m, round(gap, 6) AS margin_m FROM g""",
    "metric_at_nodes": f"WITH {SP} SELECT n.mip, n.pos, round(quantile_cont(p.width, 0.5), 6) AS width FROM profile n JOIN profile p ON p.mip = n.mip AND abs(p.dist_m - n.dist_m) <= 500 GROUP BY 1, 2",
    "threshold_candidates": f"""WITH RECURSIVE {BR}, {anchored(900)}, t AS (SELECT unnest([0.5, 0.625, 0.75, 0.875])::DOUBLE AS threshold),
        p AS (SELECT family, threshold, mip, count(*) FILTER (support >= threshold) AS n, avg(support) FILTER (support >= threshold) AS s, max(span_m) FILTER (support >= threshold) AS x FROM consensus CROSS JOIN t GROUP BY 1, 2, 3),
        q AS (SELECT family, threshold, round(avg(n), 6) AS n, round(avg(s), 6) AS s, round(avg(x), 6) AS x FROM p GROUP BY 1, 2)
        SELECT family, threshold, CAST(row_number() OVER (PARTITION BY family ORDER BY s DESC NULLS LAST, x NULLS LAST, n DESC, threshold) AS INTEGER) AS rank FROM q a
        WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.family = a.family AND b.n >= a.n AND b.s >= a.s AND b.x <= a.x AND (b.n > a.n OR b.s > a.s OR b.x < a.x))""",
    "family_choice": f"""WITH {SETTINGS}, top AS (SELECT *, row_number() OVER (ORDER BY mean_ch DESC NULLS LAST, mean_centrality DESC NULLS LAST, instability NULLS LAST, mean_span_penalty NULLS LAST, mean_sse_ratio NULLS LAST, family) AS k FROM reps),
        a AS (SELECT * FROM top WHERE k = 1), b AS (SELECT * FROM top WHERE k = 2),
        l AS (SELECT e.mip, e.ch FROM evaluated e JOIN a USING (family, setting)), r AS (SELECT e.mip, e.ch FROM evaluated e JOIN b USING (family, setting)),
        j AS (SELECT l.mip IS NOT NULL AND r.mip IS NOT NULL AS both_there, CASE WHEN r.mip IS NULL THEN 1 WHEN l.mip IS NULL THEN 2 WHEN (l.ch - r.ch) / greatest(abs(r.ch), 1e-12) > 0.02 THEN 1 WHEN (l.ch - r.ch) / greatest(abs(r.ch), 1e-12) < -0.02 THEN 2 ELSE 0 END AS w FROM l FULL OUTER JOIN r ON l.mip = r.mip),
        c AS (SELECT count(*) AS n_paths, count(*) FILTER (both_there) AS n_both, count(*) FILTER (w > 0) AS n_decided, count(*) FILTER (w = 0) AS n_ties, count(*) FILTER (w = 1) AS w1, count(*) FILTER (w = 2) AS w2 FROM j),
        v AS (SELECT c.*, a.family AS fa, b.family AS fb, round((a.mean_ch - b.mean_ch) / greatest(abs(b.mean_ch), 1e-12), 5) AS gap,
          CASE WHEN w1 >= 0.75 * n_decided AND n_decided > 0 THEN 1 WHEN w2 >= 0.75 * n_decided AND n_decided > 0 THEN 2
               WHEN (-a.mean_centrality, a.instability, a.mean_span_penalty, a.mean_sse_ratio) <= (-b.mean_centrality, b.instability, b.mean_span_penalty, b.mean_sse_ratio) THEN 3 ELSE 4 END AS how FROM c, a, b)
        SELECT CASE WHEN how IN (1, 3) THEN fa ELSE fb END AS family, CASE WHEN how IN (1, 3) THEN fb ELSE fa END AS runner_up, CASE WHEN how <= 2 THEN 'path_wins' ELSE 'robustness' END AS reason, gap, n_paths, n_both, n_decided, n_ties,
          CASE WHEN how IN (1, 3) THEN w1 ELSE w2 END AS wins, CASE WHEN how IN (1, 3) THEN w2 ELSE w1 END AS runner_up_wins FROM v""",
    "break_faults": f"""WITH {BR}, b AS (SELECT DISTINCT mip, family, setting, break_m FROM breaks), e AS (SELECT mip, min(dist_m) AS lo, max(dist_m) AS hi FROM profile GROUP BY mip),
        g AS (SELECT mip, family, setting, break_m, break_m - lag(break_m) OVER w AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY mip, family, setting) AS n, lo, hi FROM b JOIN e USING (mip) WINDOW w AS (PARTITION BY mip, family, setting ORDER BY break_m))
        SELECT DISTINCT mip, family, setting, 'outside' AS fault FROM g WHERE break_m <= lo OR break_m >= hi
        UNION ALL SELECT DISTINCT mip, family, setting, 'too_near' FROM g WHERE gap < 500 - 1e-9
        UNION ALL SELECT DISTINCT mip, family, setting, 'short_reach' FROM g WHERE coalesce(gap, break_m - lo) < 600 - 1e-9 OR (k = n AND hi - break_m < 600 - 1e-9)""",
    "run_comparison": f"""WITH {BR}, b AS (SELECT mip, setting, count(DISTINCT break_m) AS n FROM breaks GROUP BY 1, 2)
        SELECT mip, setting AS run, CAST(n AS INTEGER) AS n_breaks, CAST(n + mip % 3 AS INTEGER) AS n_candidates, CAST(mip AS DOUBLE) AS final_sse, round((n + mip % 3) / n, 6) AS candidates_per_break FROM b""",
    "run_clusters": f"""WITH {BR}, b AS (SELECT DISTINCT mip, setting, break_m FROM breaks),
        c AS (SELECT *, sum(fresh) OVER (PARTITION BY mip ORDER BY break_m, setting) AS cluster_id FROM (SELECT *, CASE WHEN break_m - lag(break_m) OVER (PARTITION BY mip ORDER BY break_m, setting) > 400 THEN 1 ELSE 0 END AS fresh FROM b))
        SELECT mip, CAST(cluster_id AS INTEGER) AS cluster_id, round(quantile_cont(break_m, 0.5) / 1000, 6) AS center_km, count(DISTINCT setting) AS n_runs_supported, string_agg(DISTINCT setting, ',' ORDER BY setting) AS runs_supported, CAST(count(*) AS INTEGER) AS n_members FROM c GROUP BY mip, cluster_id""",
    "renamed_paths": "SELECT o_custkey AS old_path_id, arg_min(o_custkey % 100, o_orderkey) AS new_path_id FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1",
    "mainstem_paths": "SELECT count(DISTINCT o_custkey) AS n_paths, count(DISTINCT o_orderkey) AS n_reaches FROM orders WHERE o_orderkey % 4 < 2",
    "side_channels": f"""WITH {LP}, n AS (SELECT mip, max(pos) AS last FROM profile GROUP BY mip),
        f AS (SELECT mip, pos, last, width, mip * 1000000 + pos AS i FROM profile JOIN n USING (mip) WHERE pos % 10 = 3),
        c AS (SELECT *, least(concat_ws('-', i, CASE WHEN pos + 1 <= last THEN i + 1 END, i + 500000), concat(i + 500000, '-', i + 600000), CASE WHEN pos + 4 <= last THEN concat(i + 3, '-', i + 4, '-', i + 600000) ELSE concat(i + 600000) END) AS name FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY mip ORDER BY name) - 1 AS component FROM c)
        SELECT p.mip, p.i + j AS reach_id, CAST(p.component AS INTEGER) AS component, 2::INTEGER AS k_max, 1.0::DOUBLE AS k_eff, 1.0::DOUBLE AS k_eff_raw, round((p.width / 2 + p.width / 3) / 2, 6) AS width_extra,
          600.0::DOUBLE AS l_main, 900.0::DOUBLE AS l_dominant, 0.0::DOUBLE AS l_extra, 'ok' AS status
        FROM r p CROSS JOIN (SELECT unnest([1, 2, 3]) AS j) WHERE p.pos + 4 <= last""",
    "sampled_lines": f"""WITH {SP}, s AS (SELECT mip, pos, x, y, coalesce(sum(step) OVER (PARTITION BY mip ORDER BY pos), 0) AS s FROM (SELECT mip, pos, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM profile WINDOW w AS (PARTITION BY mip ORDER BY pos))),
        g AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY mip ORDER BY pos)), t AS (SELECT mip, max(s) AS total FROM s GROUP BY mip),
        k AS (SELECT mip, total, unnest(range(0, CAST(ceil(total / 50) AS BIGINT))) AS k FROM t), d AS (SELECT mip, k, 50.0 * k AS dist_m FROM k UNION ALL SELECT mip, CAST(ceil(total / 50) AS BIGINT), total FROM t WHERE total - 50.0 * (ceil(total / 50) - 1) > 1e-9)
        SELECT d.mip, CAST(d.k AS INTEGER) AS k, round(CAST(dist_m AS DOUBLE), 6) AS dist_m, round(g.x + (dist_m - g.s) * (g.x2 - g.x) / (g.s2 - g.s), 6) AS x, round(g.y + (dist_m - g.s) * (g.y2 - g.y) / (g.s2 - g.s), 6) AS y
        FROM d JOIN t USING (mip) JOIN g ON g.mip = d.mip AND ((g.s <= d.dist_m AND d.dist_m < g.s2) OR (d.dist_m = t.total AND g.s2 = t.total))""",
    "node_coordinates": f"""WITH {SP}, s AS (SELECT mip, pos, x, y, dist_m, coalesce(sum(step) OVER (PARTITION BY mip ORDER BY pos), 0) AS s FROM (SELECT mip, pos, x, y, dist_m, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM profile WINDOW w AS (PARTITION BY mip ORDER BY pos))),
        g AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY mip ORDER BY pos)), t AS (SELECT mip, max(s) AS total FROM s GROUP BY mip)
        SELECT n.mip, n.pos, round(g.x + (least(n.dist_m, total) - g.s) * (g.x2 - g.x) / (g.s2 - g.s), 6) AS x, round(g.y + (least(n.dist_m, total) - g.s) * (g.y2 - g.y) / (g.s2 - g.s), 6) AS y
        FROM s n JOIN t USING (mip) JOIN g ON g.mip = n.mip AND ((g.s <= least(n.dist_m, total) AND least(n.dist_m, total) < g.s2) OR (n.dist_m >= total AND g.s2 = total))""",
    # The merged line is the whole line again, over the middle of each gap.
    "merged_centerlines": f"""WITH {_cut("CASE WHEN mip % 3 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END")}, whole AS (
          SELECT mip, last, sum(sqrt(pow(xb - xa, 2) + pow(yb - ya, 2))) AS own,
                 sum(sqrt(pow((CASE WHEN (pos + 1) % 10 = 0 AND pos + 1 < last THEN xb + gap / 2 ELSE xb END) - (CASE WHEN r > 0 AND pos % 10 = 0 THEN x + gap / 2 ELSE x END), 2) + pow(yb - ya, 2))) AS merged,
                 sum(CASE WHEN mip % 3 = 1 AND pos % 10 >= 7 AND pos // 10 * 10 + 10 < last THEN sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)) ELSE 0 END) AS again
          FROM seg GROUP BY mip, last)
        SELECT mip AS main_path_id, CAST((last + 9) // 10 AS INTEGER) AS n_parts, round(own + again, 4) AS input_length_m, round(merged, 4) AS merged_length_m, round((own + again - merged) / (own + again), 4) AS loss_fraction,
               'reach_order' AS terminals, 'ok' AS status, CAST(CASE WHEN mip % 3 = 0 THEN 2 * ((last + 9) // 10 - 1) ELSE 0 END AS INTEGER) AS n_snapped, 1::INTEGER AS n_components, 0::INTEGER AS cycle_rank, 'simple' AS repair
        FROM whole""",
    "endpoint_diagnostics": f"""WITH {_cut("CASE (pos // 10) % 4 WHEN 1 THEN 0.0::DOUBLE WHEN 3 THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END")},
        parts AS (SELECT *, sum(CASE WHEN r > 0 AND pos % 10 = 0 AND gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY mip ORDER BY pos) AS part FROM seg),
        outer_ends AS (SELECT mip, last, xa AS x, ya AS y, part FROM parts WHERE pos = 0 UNION ALL SELECT mip, last, xb, yb, part FROM parts WHERE pos = last - 1),
        far AS (
          SELECT o.mip, o.x, o.y, min(sqrt(pow(s.xa + t * (s.xb - s.xa) - o.x, 2) + pow(s.ya + t * (s.yb - s.ya) - o.y, 2))) AS near
          FROM outer_ends o LEFT JOIN (SELECT * FROM parts) s ON o.mip = s.mip AND o.part <> s.part
          LEFT JOIN LATERAL (SELECT least(1, greatest(0, ((o.x - s.xa) * (s.xb - s.xa) + (o.y - s.ya) * (s.yb - s.ya)) / (pow(s.xb - s.xa, 2) + pow(s.yb - s.ya, 2)))) AS t) ON true
          GROUP BY o.mip, o.x, o.y)
        SELECT mip AS main_path_id, round(x, 4) AS x, round(y, 4) AS y, CASE WHEN near IS NULL THEN 'unresolved' ELSE 'outer' END AS status, '' AS reasons, round(near, 4) AS nearest_m, CAST(NULL AS DOUBLE) AS moved_to_x, CAST(NULL AS DOUBLE) AS moved_to_y FROM far
        UNION ALL
        SELECT mip, round(e.x, 4), round(e.y, 4), CASE WHEN gap = 3 THEN 'snapped_to_end' ELSE 'unresolved' END, '', round(gap, 4), CASE WHEN gap = 3 THEN round(e.middle, 4) END, CASE WHEN gap = 3 THEN round(e.y, 4) END
        FROM parts p CROSS JOIN LATERAL (SELECT unnest([p.x, p.xa]) AS x, p.ya AS y, p.x + p.gap / 2 AS middle) e WHERE r > 0 AND pos % 10 = 0 AND gap > 0""",
    # Nodes are all ends and crossings; a covered stretch with n nodes on it has n - 1 edges.
    "noded_lines": """WITH lines AS (
          SELECT l_suppkey AS mip, l_orderkey % 2 = 0 AS flat, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 10 * l_linenumber ELSE l_quantity END AS DOUBLE) AS level,
                 CAST(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity ELSE 10 * l_linenumber - 5 * (l_partkey % 3) END AS DOUBLE) AS lo,
                 CAST(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity + 1 + l_partkey % 15 ELSE 10 * l_linenumber + 5 + 10 * (l_partkey % 4) END AS DOUBLE) AS hi
          FROM lineitem
        ), fresh AS (
          SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY mip, flat, level ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY mip, flat, level ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS fresh FROM lines
        ), island AS (
          SELECT mip, flat, level, k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY mip, flat, level ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM fresh) GROUP BY ALL
        ), nodes AS (
          SELECT mip, CASE WHEN flat THEN e ELSE level END AS x, CASE WHEN flat THEN level ELSE e END AS y FROM lines CROSS JOIN LATERAL (SELECT unnest([lo, hi]) AS e)
          UNION
          SELECT h.mip, v.level, h.level FROM island h JOIN island v ON h.mip = v.mip AND h.flat AND NOT v.flat AND v.level BETWEEN h.lo AND h.hi AND h.level BETWEEN v.lo AND v.hi
        ), held AS (
          SELECT i.mip, i.flat, i.level, i.k, count(*) - 1 AS edges FROM island i JOIN nodes n ON i.mip = n.mip AND CASE WHEN flat THEN n.y ELSE n.x END = i.level AND CASE WHEN flat THEN n.x ELSE n.y END BETWEEN i.lo AND i.hi GROUP BY ALL
        )
        SELECT mip AS main_path_id, n_nodes, n_edges, round(length_m, 4) AS length_m FROM (SELECT mip, count(*) AS n_nodes FROM nodes GROUP BY mip)
        JOIN (SELECT mip, CAST(sum(edges) AS BIGINT) AS n_edges FROM held GROUP BY mip) USING (mip) JOIN (SELECT mip, sum(hi - lo) AS length_m FROM island GROUP BY mip) USING (mip)""",
    "aligned_features": f"""WITH {SP}, ext AS (
          SELECT mip, dist_m + CASE mip % 5 WHEN 0 THEN 5e-7 WHEN 1 THEN 70.0 ELSE 0 END AS d, pos, width, CASE WHEN pos % 6 <> 0 THEN n_channels END AS n_channels FROM profile
          WHERE CASE mip % 5 WHEN 0 THEN true WHEN 1 THEN pos % 3 = 0 WHEN 2 THEN pos % 4 = 1 WHEN 3 THEN pos = 2 ELSE false END
        ), long AS (SELECT mip, d, pos, 'w' AS c, width AS v FROM ext UNION ALL SELECT mip, d, pos, 'n', n_channels FROM ext), known AS (SELECT mip, d, c, v, count(*) OVER (PARTITION BY mip, c) AS n FROM long WHERE v IS NOT NULL),
        need AS (SELECT p.mip, p.pos, p.dist_m, c FROM profile p CROSS JOIN (SELECT unnest(['w', 'n']) AS c)),
        around AS (SELECT need.*, a.d AS d1, a.v AS v1, b.d AS d2, b.v AS v2 FROM need ASOF LEFT JOIN known a ON need.mip = a.mip AND need.c = a.c AND need.dist_m >= a.d ASOF LEFT JOIN known b ON need.mip = b.mip AND need.c = b.c AND need.dist_m <= b.d),
        found AS (
          SELECT r.mip, r.pos, r.c, CASE WHEN r.mip % 5 = 0 THEN same.v WHEN one.v IS NOT NULL THEN one.v WHEN d1 = d2 THEN v1 ELSE v1 + (v2 - v1) * (dist_m - d1) / (d2 - d1) END AS v
          FROM around r LEFT JOIN long same ON same.mip = r.mip AND same.pos = r.pos AND same.c = r.c LEFT JOIN (SELECT mip, c, v FROM known WHERE n = 1) one ON one.mip = r.mip AND one.c = r.c)
        SELECT mip, pos, round(max(v) FILTER (WHERE c = 'w'), 6) AS width, round(max(v) FILTER (WHERE c = 'n'), 6) AS n_channels FROM found GROUP BY mip, pos""",
    "change_points": CHANGE_POINTS,
    "change_points_sql": CHANGE_POINTS,
    "side_components": f"{LOOPS} SELECT mip, component, node, n_inside FROM parts",
    # A junction of the main stem is numbered by the reach above it, and so its place is that reach's place and one.
    "corridors": f"""{LOOPS}, stem AS (SELECT mip, node, row_number() OVER (PARTITION BY mip ORDER BY node) - 1 AS place FROM (SELECT mip, u AS node FROM net WHERE main UNION SELECT mip, v FROM net WHERE main)),
        ends AS (SELECT n.mip, p.component, s.place AS s, t.place AS t FROM net n JOIN parts p ON p.mip = n.mip AND p.node = n.u LEFT JOIN stem s ON s.mip = n.mip AND s.node = n.u LEFT JOIN stem t ON t.mip = n.mip AND t.node = n.v WHERE NOT main),
        span AS (SELECT e.mip, e.component, f.source, max(e.t) AS sink FROM ends e JOIN (SELECT mip, component, min(s) AS source FROM ends GROUP BY ALL) f ON f.mip = e.mip AND f.component = e.component WHERE e.t > f.source GROUP BY ALL),
        out_of(mip, component, source, sink, node) AS (
          SELECT sp.mip, component, source, sink, node FROM span sp JOIN stem ON stem.mip = sp.mip AND place = source
          UNION
          SELECT o.mip, component, source, sink, n.v FROM out_of o JOIN net n ON n.mip = o.mip AND n.u = o.node LEFT JOIN stem ON stem.mip = n.mip AND stem.node = n.v WHERE coalesce(place, -1) <= sink),
        into_it(mip, component, source, sink, node) AS (
          SELECT sp.mip, component, source, sink, node FROM span sp JOIN stem ON stem.mip = sp.mip AND place = sink
          UNION
          SELECT o.mip, component, source, sink, n.u FROM into_it o JOIN net n ON n.mip = o.mip AND n.v = o.node LEFT JOIN stem ON stem.mip = n.mip AND stem.node = n.u WHERE coalesce(place, source) >= source),
        inside AS (SELECT * FROM out_of INTERSECT SELECT * FROM into_it)
        SELECT n.mip, a.component, a.source, a.sink, n.r AS reach_id FROM net n JOIN inside a ON a.mip = n.mip AND a.node = n.u JOIN inside b ON b.mip = n.mip AND b.node = n.v AND b.component = a.component""",
    "line_formats": f"""WITH {SP}, s AS (SELECT mip, pos, count(*) OVER (PARTITION BY mip) AS n, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM profile WINDOW w AS (PARTITION BY mip ORDER BY pos)),
        t AS (SELECT mip, n, sum(CASE WHEN mip % 3 = 0 AND pos = n // 2 THEN 0 ELSE step END) AS length FROM s WHERE n > 3 GROUP BY mip, n),
        u AS (SELECT *, CASE WHEN mip % 7 = 1 THEN 'malformed' WHEN mip % 7 = 2 THEN 'missing' ELSE 'ok' END AS status, lpad(hex(n), 8, '0') AS h FROM t)
        SELECT mip, status, CASE WHEN status = 'ok' THEN CASE WHEN mip % 3 = 0 THEN 2 ELSE 1 END END AS n_parts, CASE WHEN status = 'ok' THEN round(length, 4) END AS length_m, 'ok' AS text_status, round(length, 4) AS text_length_m,
          CASE WHEN status = 'missing' THEN NULL WHEN mip % 3 = 0 THEN '010500000002000000' ELSE '0102000000' || h[7:8] || h[5:6] || h[3:4] || h[1:2] END AS head FROM u""",
    "selections": f"""{CHOSEN} SELECT mip, family, setting, status, CAST(n_candidates AS INTEGER) AS n_candidates, CAST(n_breaks AS INTEGER) AS n_breaks, round(base, 6) AS base_sse, round(final, 6) AS final_sse,
        array_to_string([CAST(b AS VARCHAR) FOR b IN chosen], ',') AS breaks FROM selections""",
    "segments": f"{AGREED} SELECT mip, first_pos, end_pos, n_nodes, start_m, end_m, CAST(row_number() OVER (PARTITION BY mip ORDER BY first_pos) - 1 AS INTEGER) AS segment_id FROM segments",
    "support_sweep": f"{AGREED} SELECT k AS count, mip, count(*) FILTER (WHERE n_settings_supported >= k) AS n_stable, round(avg(span_m), 6) AS mean_span_m FROM consensus CROSS JOIN (SELECT unnest([3, 4, 5]) AS k) GROUP BY k, mip",
    "reach_summary": f"""{AGREED}, s AS (SELECT mip, count(*) AS n_segments, avg(end_m - start_m) AS mean, quantile_cont(end_m - start_m, 0.5) AS median FROM segments GROUP BY mip),
        c AS (SELECT mip, family, count(*) AS n_stable, avg(support) AS support, avg(span_m) AS span FROM consensus WHERE n_settings_supported >= 4 GROUP BY mip, family)
        SELECT s.mip, n_segments, round(mean, 6) AS mean_segment_m, round(median, 6) AS median_segment_m, c.family, coalesce(n_stable, 0) AS n_stable, round(support, 6) AS mean_support, round(span, 6) AS mean_span_m, 'ok' AS status FROM s LEFT JOIN c USING (mip)""",
    # Breaks of one setting in turn each take the nearest free break of the other.
    "setting_centrality": f"""WITH RECURSIVE {BR}, own AS (SELECT mip, family, setting, list(DISTINCT break_m ORDER BY break_m) AS l FROM breaks GROUP BY ALL),
        walk(mip, family, setting, other, l, n, k, hits, free) AS (
          SELECT a.mip, a.family, a.setting, b.setting, a.l, len(a.l) + len(b.l), 0, 0, b.l FROM own a JOIN own b ON a.mip = b.mip AND a.family = b.family AND a.setting <> b.setting
          UNION ALL
          SELECT mip, family, setting, other, l, n, k + 1, hits + CASE WHEN best IS NULL THEN 0 ELSE 1 END, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda y: y <> best.m) END
          FROM (SELECT *, list_sort([{{'d': abs(y - l[k + 1]), 'm': y}} FOR y IN free IF abs(y - l[k + 1]) <= 450])[1] AS best FROM walk WHERE k < len(l)))
        SELECT o.mip, o.family, o.setting, round(coalesce(avg(2.0::DOUBLE * hits / n), 1), 6) AS centrality FROM own o LEFT JOIN (SELECT * FROM walk WHERE k = len(l)) w ON w.mip = o.mip AND w.family = o.family AND w.setting = o.setting GROUP BY ALL""",
}
