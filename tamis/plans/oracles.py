"""SQL of trees, merges, Gini and drops, built up level by level from common table expressions."""

from __future__ import annotations


def woe(e: str, n: str) -> str:
    return f"ln((({e} + 0.5) / (tot.E + 0.5)) / (({n} + 0.5) / (tot.N + 0.5)))"


def iv(e: str, n: str) -> str:
    return f"((({e} + 0.5) / (tot.E + 0.5)) - (({n} + 0.5) / (tot.N + 0.5))) * {woe(e, n)}"


def impurity(e: str, n: str) -> str:
    return f"(2 * ({e}) / (({e}) + ({n})) * (1 - ({e}) / (({e}) + ({n}))))"


def tree(hist: str, budget: int, least: str, out: str) -> str:
    """``out`` (feature, low, high): the leaves of a tree over ``hist`` (feature, value, e, n, r), at most budget + 1 a feature."""
    gain = f"round({impurity('te', 'tn')} - (le + ln_) / (te + tn) * {impurity('le', 'ln_')} - (te + tn - le - ln_) / (te + tn) * {impurity('te - le', 'tn - ln_')}, 12)"
    parts, k, left = [f"{out}_0 AS MATERIALIZED (SELECT DISTINCT feature, '-inf'::DOUBLE AS low, 'inf'::DOUBLE AS high, {budget} AS b FROM {hist})"], 0, budget
    while left > 0:
        parts.append(f"""{out}_x{k} AS MATERIALIZED (SELECT h.feature, d.low, d.high, d.b, h.value, sum(h.e) OVER w AS le, sum(h.n) OVER w AS ln_, sum(h.r) OVER w AS lr, sum(h.e) OVER f AS te, sum(h.n) OVER f AS tn, sum(h.r) OVER f AS tr
FROM {hist} h JOIN {out}_{k} d ON h.feature = d.feature AND h.value > d.low AND h.value <= d.high WHERE d.b > 0 WINDOW w AS (PARTITION BY h.feature, d.low ORDER BY h.value), f AS (PARTITION BY h.feature, d.low)),
{out}_s{k} AS MATERIALIZED (SELECT feature, low, high, b, value FROM (SELECT *, {gain} AS gain FROM {out}_x{k} WHERE lr >= {least} AND tr - lr >= {least}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature, low ORDER BY gain DESC, value) = 1),
{out}_{k + 1} AS MATERIALIZED (SELECT feature, low, value AS high, (b - 1) // 2 AS b FROM {out}_s{k} UNION ALL SELECT feature, value, high, (b - 1) - (b - 1) // 2 FROM {out}_s{k}
UNION ALL SELECT feature, low, high, 0 FROM {out}_{k} d WHERE NOT EXISTS (SELECT 1 FROM {out}_s{k} s WHERE s.feature = d.feature AND s.low = d.low))""")
        left, k = (left - 1) - (left - 1) // 2, k + 1
    return ",\n".join([*parts, f"{out} AS MATERIALIZED (SELECT feature, low, high FROM {out}_{k})"])


def tree_bins(hist: str, leaves: str, out: str) -> str:
    """``out`` (feature, bin, lower, events, non_events) of a tree's leaves."""
    return f"""{out} AS MATERIALIZED (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY low) - 1 AS INT) AS bin, lower, events, non_events FROM (
SELECT h.feature, d.low, min(h.value) AS lower, sum(h.e) AS events, sum(h.n) AS non_events FROM {hist} h JOIN {leaves} d ON h.feature = d.feature AND h.value > d.low AND h.value <= d.high GROUP BY 1, 2))"""


def optimal(bins: str, k: int, out: str, order: str = "") -> str:
    """``out``: the k runs of a feature's bins with the greatest IV, each of weight 5 or more; fewer bins stay."""
    steps = ",\n".join(f"{out}_p{m} AS MATERIALIZED (SELECT v.feature, v.i, v.j, v.woe, p.total + v.iv AS total, list_append(p.starts, v.i) AS starts FROM {out}_p{m - 1} p JOIN {out}_v v ON v.feature = p.feature AND v.i = p.j + 1 {order} QUALIFY row_number() OVER (PARTITION BY v.feature, v.i, v.j ORDER BY p.total + v.iv DESC) = 1)" for m in range(2, k + 1))
    return f"""{out}_b AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY feature) AS m FROM {bins}),
{out}_v AS MATERIALIZED (SELECT feature, i, j, {woe('ev', 'nev')} AS woe, {iv('ev', 'nev')} AS iv FROM (SELECT x.feature, x.bin AS i, z.bin AS j, sum(y.events) AS ev, sum(y.non_events) AS nev FROM {out}_b x JOIN {out}_b z ON z.feature = x.feature AND z.bin >= x.bin JOIN {out}_b y ON y.feature = x.feature AND y.bin BETWEEN x.bin AND z.bin WHERE x.m > {k} GROUP BY 1, 2, 3), tot WHERE ev + nev >= 5),
{out}_p1 AS MATERIALIZED (SELECT feature, i, j, woe, iv AS total, [i] AS starts FROM {out}_v WHERE i = 0),
{steps},
{out}_top AS (SELECT p.feature, p.starts FROM {out}_p{k} p JOIN (SELECT feature, max(bin) AS j FROM {out}_b GROUP BY 1) USING (feature, j) QUALIFY row_number() OVER (PARTITION BY p.feature ORDER BY total DESC) = 1),
{out} AS MATERIALIZED (SELECT feature, CAST(k AS INT) AS bin, min(lower) AS lower, sum(events) AS events, sum(non_events) AS non_events FROM (
SELECT b.*, CASE WHEN m <= {k} THEN bin ELSE len(list_filter(starts, lambda x: x <= bin)) - 1 END AS k FROM {out}_b b LEFT JOIN {out}_top USING (feature)) GROUP BY 1, 2)"""


def greedy(bins: str, most: int, k: int, out: str) -> str:
    """``out``: a feature's at most ``most`` bins, of which neighbours that lose least IV are merged until k are left."""
    parts = [f"{out}_0 AS MATERIALIZED (SELECT feature, bin, lower, events, non_events FROM {bins})"]
    for i in range(most - k):
        loss = f"{iv('events', 'non_events')} + {iv('e2', 'n2')} - {iv('events + e2', 'non_events + n2')}"
        parts.append(f"""{out}_c{i} AS MATERIALIZED (SELECT feature, bin, b2 FROM (SELECT *, lead(bin) OVER w AS b2, lead(events) OVER w AS e2, lead(non_events) OVER w AS n2, count(*) OVER (PARTITION BY feature) AS m FROM {out}_{i} WINDOW w AS (PARTITION BY feature ORDER BY bin)), tot
WHERE b2 IS NOT NULL AND m > {k} QUALIFY row_number() OVER (PARTITION BY feature ORDER BY {loss}, bin) = 1),
{out}_{i + 1} AS MATERIALIZED (SELECT t.feature, coalesce(c.bin, t.bin) AS bin, min(lower) AS lower, sum(events) AS events, sum(non_events) AS non_events FROM {out}_{i} t LEFT JOIN {out}_c{i} c ON c.feature = t.feature AND c.b2 = t.bin GROUP BY 1, 2)""")
    return ",\n".join([*parts, f"{out} AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY bin) - 1 AS INT) AS bin, lower, events, non_events FROM {out}_{most - k})"])


def auc(groups: str, out: str) -> str:
    """``out`` (feature, auc) of ``groups`` (feature, woe, p, q)."""
    return f"""{out}_g AS (SELECT feature, round(woe, 10) AS woe, sum(p) AS p, sum(q) AS q FROM {groups} GROUP BY 1, 2),
{out}_r AS (SELECT *, coalesce(sum(p + q) OVER (PARTITION BY feature ORDER BY woe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {out}_g),
{out} AS MATERIALIZED (SELECT feature, coalesce((sum(p * (before + (p + q) / 2)) - sum(p) * sum(p) / 2) / (sum(p) * sum(q)), 0.5) AS auc FROM {out}_r GROUP BY feature)"""


def numeric_stats(hist: str, bins: str, out: str) -> str:
    """``out`` (feature, iv, gini) of numeric features: every value under the last bin whose lower bound it reaches."""
    return f"""{out}_w AS MATERIALIZED (SELECT feature, bin, lower, {woe('events', 'non_events')} AS woe, {iv('events', 'non_events')} AS iv FROM {bins}, tot),
{out}_e AS (SELECT h.feature, h.value, h.e AS p, h.n AS q, max(w.bin) AS bin FROM {hist} h JOIN {out}_w w ON h.feature = w.feature AND w.lower <= h.value GROUP BY 1, 2, 3, 4),
{out}_s AS (SELECT e.feature, w.woe, e.p, e.q FROM {out}_e e JOIN {out}_w w ON w.feature = e.feature AND w.bin = e.bin),
{auc(f'{out}_s', f'{out}_a')},
{out} AS MATERIALIZED (SELECT feature, sum(iv) AS iv, 2 * max(auc) - 1 AS gini FROM {out}_w JOIN {out}_a USING (feature) GROUP BY feature)"""


def category_groups(cats: str, num_bins: int, out: str) -> str:
    """``out`` (feature, category, events, non_events): a tree's groups of categories, neighbours by event rate, of ``cats`` (feature, c, ev, nev)."""
    return f"""{out}_k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY ev / (ev + nev), c) AS k FROM {cats}),
{out}_h AS MATERIALIZED (SELECT feature, k::DOUBLE AS value, ev AS e, nev AS n, (ev > 0)::INT + (nev > 0)::INT AS r FROM {out}_k),
{tree(f'{out}_h', num_bins - 1, '1', f'{out}_t')},
{out} AS MATERIALIZED (SELECT k.feature, string_agg(c, ',' ORDER BY k) AS category, sum(ev) AS events, sum(nev) AS non_events FROM {out}_k k JOIN {out}_t d ON k.feature = d.feature AND k.k > d.low AND k.k <= d.high GROUP BY k.feature, d.low)"""


def category_stats(groups: str, out: str) -> str:
    """``out`` (feature, iv, gini) of categorical features."""
    return f"""{out}_w AS MATERIALIZED (SELECT feature, events AS p, non_events AS q, {woe('events', 'non_events')} AS woe, {iv('events', 'non_events')} AS iv FROM {groups}, tot),
{auc(f'{out}_w', f'{out}_a')},
{out} AS MATERIALIZED (SELECT feature, sum(iv) AS iv, 2 * max(auc) - 1 AS gini FROM {out}_w JOIN {out}_a USING (feature) GROUP BY feature)"""


def drops(stats: str, pairs: str, target: str, gini: float, threshold: float, out: str) -> str:
    """``out`` (feature, stage, reason), from ``stats`` (feature, iv, gini) and ``pairs`` (f1, f2, c, measure, place), without missing values."""
    told = "printf('Correlated with %s (%s %.4f); %s (%.4f vs %.4f)', CASE WHEN loser = f1 THEN f2 ELSE f1 END, measure, c, 'lower IV', CASE WHEN loser = f1 THEN iv1 ELSE iv2 END, CASE WHEN loser = f1 THEN iv2 ELSE iv1 END)"
    often = "printf('Correlated with %s (%s %.4f); higher frequency (%d vs %d)', CASE WHEN loser = f1 THEN f2 ELSE f1 END, measure, c, CASE WHEN loser = f1 THEN n1 ELSE n2 END, CASE WHEN loser = f1 THEN n2 ELSE n1 END)"
    return f"""{out}_low AS MATERIALIZED (SELECT feature, 'gini' AS stage, printf('Gini %.4f < threshold %.4f', gini, {gini}) AS reason FROM {stats} WHERE abs(gini) < {gini}),
{out}_far AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY abs(c) DESC, place) AS k FROM {pairs} WHERE abs(c) > {threshold} AND f1 NOT IN (SELECT feature FROM {out}_low) AND f2 NOT IN (SELECT feature FROM {out}_low)),
{out}_often AS (SELECT feature, count(*) AS n FROM (SELECT f1 AS feature FROM {out}_far UNION ALL SELECT f2 FROM {out}_far) GROUP BY 1),
{out}_told AS (SELECT p.*, a.iv AS iv1, b.iv AS iv2, x.n AS n1, y.n AS n2 FROM {out}_far p LEFT JOIN {stats} a ON a.feature = f1 LEFT JOIN {stats} b ON b.feature = f2 JOIN {out}_often x ON x.feature = f1 JOIN {out}_often y ON y.feature = f2),
{out}_loser AS MATERIALIZED (SELECT *, CASE WHEN f1 = '{target}' THEN f2 WHEN f2 = '{target}' THEN f1 WHEN abs(iv1 - iv2) > 2.220446049250313e-16 THEN CASE WHEN iv1 < iv2 THEN f1 ELSE f2 END WHEN n1 <> n2 THEN CASE WHEN n1 > n2 THEN f1 ELSE f2 END ELSE greatest(f1, f2) END AS loser FROM {out}_told),
{out}_seq AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone UNION ALL SELECT i + 1, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone ELSE list_append(gone, loser) END FROM {out}_seq JOIN {out}_loser ON k = i + 1),
{out}_cor AS (SELECT loser AS feature, 'correlation' AS stage, CASE WHEN '{target}' IN (f1, f2) THEN printf('Correlated with target (%s %.4f); dropped to protect target', measure, c)
WHEN abs(iv1 - iv2) > 2.220446049250313e-16 THEN {told} WHEN n1 <> n2 THEN {often} ELSE printf('Correlated with %s (%s %.4f); alphabetical tie-break', least(f1, f2), measure, c) END AS reason
FROM {out}_loser JOIN {out}_seq ON k = i + 1 WHERE NOT list_contains(gone, f1) AND NOT list_contains(gone, f2)),
{out} AS MATERIALIZED (SELECT * FROM {out}_low UNION ALL SELECT * FROM {out}_cor)"""
