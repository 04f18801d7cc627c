"""DuckDB twins of ``queries.QUERIES``, composed from shared common table expressions."""

from __future__ import annotations

from flarespan.config import EVENT_ROLES as ROLES
from flarespan.operators.embedding import RATIOS

E = """e AS (SELECT event_id AS row_id, ts, value AS amount, (event_type = 'error')::INT AS label, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)"""
TX = """t0 AS (
    SELECT event_id AS row_id, user_id, ts, value AS amount, (event_type = 'error')::INT AS label, json_extract_string(props, '$.k')::DOUBLE AS k,
           (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_sec,
           (count(*) OVER h)::DOUBLE AS cnt_1h, sum(value) OVER h AS sum_1h
    FROM events WINDOW h AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
acc AS (SELECT o_custkey AS user_id, min(o_orderdate) AS created, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_total, max(o_totalprice) AS max_total,
               arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1),
cus AS (SELECT c_custkey AS user_id, c_acctbal AS acctbal, c_mktsegment AS segment, r_name AS region
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT t0.*, CASE WHEN k < 30 THEN 'low' WHEN k < 60 THEN 'mid' WHEN k < 90 THEN 'high' ELSE 'top' END AS k_band,
             created, n_orders, avg_total, max_total, last_status, acctbal, segment, region FROM t0 LEFT JOIN acc USING (user_id) LEFT JOIN cus USING (user_id))"""


def grid(rel: str = "e") -> str:
    return f"""tot AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS slot, sum(amount) AS amount, sum(amount * label) AS fraud_amount, count(*) AS n, sum(label)::BIGINT AS frauds FROM {rel} GROUP BY 1),
g AS (SELECT r.slot, coalesce(amount, 0) AS amount, coalesce(fraud_amount, 0) AS fraud_amount, coalesce(n, 0) AS n, coalesce(frauds, 0) AS frauds
      FROM (SELECT unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTES)) AS slot FROM tot) r LEFT JOIN tot USING (slot))"""


def stats(frequency: float = 1.5) -> str:
    return f"""{grid()},
s0 AS (SELECT slot, coalesce(fraud_amount / nullif(amount, 0), 0) AS intensity, coalesce(frauds / nullif(n, 0), 0) AS frequency FROM g),
s AS (SELECT slot, intensity, frequency, coalesce(intensity / nullif(avg(intensity) OVER (), 0), 0) AS rel_intensity, coalesce(frequency / nullif(avg(frequency) OVER (), 0), 0) AS rel_frequency,
      coalesce(intensity / nullif(avg(intensity) OVER (), 0), 0) > 1.2 AND coalesce(frequency / nullif(avg(frequency) OVER (), 0), 0) > {frequency} AS active FROM s0)"""


LIFE = """runs AS (SELECT slot, slot - INTERVAL 30 MINUTES * row_number() OVER (ORDER BY slot) AS run FROM s WHERE active),
life AS (SELECT row_number() OVER (ORDER BY min(slot)) - 1 AS lifetime_id, min(slot) AS start, max(slot) + INTERVAL 30 MINUTES AS "end" FROM runs GROUP BY run)"""
ASSIGN = """x AS (SELECT e.*, coalesce(lifetime_id, -1) AS lifetime_id, [amount / 100, k / 99] AS va, [amount / 100, hour(ts) / 24] AS vb FROM e LEFT JOIN life ON ts >= start AND ts < "end")"""
BASE = f"WITH {E}, {stats()}, {LIFE}"
IN = f"{BASE}, {ASSIGN}"

SIM = """nv AS (SELECT row_id, lifetime_id, label, ts, va, vb FROM x WHERE lifetime_id >= 0),
un AS (SELECT *, CASE WHEN list_dot_product(va, va) > 0 THEN [v / sqrt(list_dot_product(va, va)) FOR v IN va] ELSE [0.0, 0.0] END AS ua,
              CASE WHEN list_dot_product(vb, vb) > 0 THEN [v / sqrt(list_dot_product(vb, vb)) FOR v IN vb] ELSE [0.0, 0.0] END AS ub FROM nv),
fs AS (SELECT lifetime_id, [sum(ua[1]), sum(ua[2])] AS fa, [sum(ub[1]), sum(ub[2])] AS fb FROM un WHERE label = 1 GROUP BY 1),
sim AS (SELECT row_id, lifetime_id, coalesce(list_dot_product(ua, fa), 0) + coalesce(list_dot_product(ub, fb), 0) AS similarity FROM un LEFT JOIN fs USING (lifetime_id) WHERE label = 0)"""
CONF = """tc AS (SELECT *, greatest(similarity, 0) AS sp, sum(greatest(similarity, 0)) OVER (PARTITION BY lifetime_id) AS total FROM sim),
cf AS (SELECT row_id, lifetime_id, CASE WHEN total = 0 THEN 1.0 WHEN total > 1 + 1e-12 THEN 1 - ln(greatest(sp, 2.2250738585072014e-308)) / ln(total) ELSE 1 - ln(1 + sp) / ln(1 + total) END AS confidence FROM tc)"""
HIGH = """hi AS (SELECT row_id, lifetime_id FROM (SELECT cf.*, q, row_number() OVER (PARTITION BY lifetime_id ORDER BY confidence DESC, row_id) AS r
      FROM cf JOIN (SELECT lifetime_id, count(*) AS q FROM nv WHERE label = 1 GROUP BY 1) USING (lifetime_id)) WHERE r <= q),
re AS (SELECT row_id, lifetime_id FROM nv WHERE label = 0 AND row_id NOT IN (SELECT row_id FROM hi))"""
PAIRS = """fr AS (SELECT row_id AS j, lifetime_id, epoch_us(ts) AS tj, va, vb FROM nv WHERE label = 1),
gs AS (SELECT unnest(range(-15, 16)) AS g),
wm AS (SELECT a.j, g, avg(b.va[1]) AS a1, avg(b.va[2]) AS a2, avg(b.vb[1]) AS b1, avg(b.vb[2]) AS b2 FROM fr a CROSS JOIN gs JOIN fr b
       ON a.lifetime_id = b.lifetime_id AND b.tj >= a.tj + least(g, 0) * 60000000 AND b.tj <= a.tj + greatest(g, 0) * 60000000 GROUP BY ALL),
w AS (SELECT j, sum(a1) AS a1, sum(a2) AS a2, sum(b1) AS b1, sum(b2) AS b2 FROM wm GROUP BY 1),
pr AS (SELECT n.lifetime_id, n.row_id AS i, f.j, exp(-abs((epoch_us(n.ts) - f.tj) / 60e6)) AS ex, n.va[1] * a1 + n.va[2] * a2 AS da, n.vb[1] * b1 + n.vb[2] * b2 AS db
       FROM nv n JOIN fr f USING (lifetime_id) JOIN w USING (j) WHERE n.label = 0),
pv AS (SELECT lifetime_id, i, j, 'va' AS view, ex / (1 + ex) * da AS a FROM pr UNION ALL SELECT lifetime_id, i, j, 'vb', ex / (1 + ex) * db FROM pr),
m AS (SELECT i, j, view, CASE WHEN sum(a) OVER p > 0 THEN a / sum(a) OVER p ELSE 0 END AS m FROM pv WINDOW p AS (PARTITION BY lifetime_id, j, view)),
fp AS (SELECT re.row_id, re.lifetime_id, fps FROM re LEFT JOIN (SELECT i AS row_id, sum(m) AS fps FROM m GROUP BY 1) USING (row_id)),
po AS (SELECT row_id, CASE WHEN fps IS NULL THEN NULL WHEN max(fps) OVER () > min(fps) OVER () THEN (fps - min(fps) OVER ()) / (max(fps) OVER () - min(fps) OVER ()) WHEN fps > 0 THEN 0.5 ELSE 0 END AS p FROM fp)"""
ALL = f"{IN}, {SIM}, {CONF}, {HIGH}, {PAIRS}"

SCORED = f"{BASE}, sc AS (SELECT *, round((k + label * 20) / 120, 6) AS score FROM e)"
CUM = """cu0 AS (SELECT score AS s, count(*) AS n, sum(label)::BIGINT AS pos FROM sc GROUP BY 1),
cu AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS up_n, sum(pos) OVER (ORDER BY s DESC) AS up_pos, sum(n) OVER () AS all_n, sum(pos) OVER () AS all_pos FROM cu0),
ap AS (SELECT sum(pos / all_pos * up_pos / up_n) AS average_precision FROM cu)"""


def top(percent: float, name: str) -> str:
    return f"{name} AS (SELECT row_id, label, (row_number() OVER (ORDER BY score DESC, row_id) <= ceil((SELECT count(*) FROM sc) * {percent} / 100))::INT AS flagged FROM sc)"


def rates(name: str) -> str:
    return f"""(SELECT *, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)
        / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT) AS macro_f1, fp / nullif(fp + tn, 0) AS fpr
        FROM (SELECT count(*) FILTER (label = 0 AND flagged = 0) AS tn, count(*) FILTER (label = 0 AND flagged = 1) AS fp,
                     count(*) FILTER (label = 1 AND flagged = 0) AS fn, count(*) FILTER (label = 1 AND flagged = 1) AS tp FROM {name}))"""


def signed_log(c: str) -> str:
    return f"sign({c}) * ln(1 + abs({c}))"


def features() -> list[tuple[str, str, str]]:
    """(level, feature, expression) in order."""
    out = []
    for name, level in ROLES.levels.items():
        out += [(name, c, signed_log(c) if c in level.monetary else c) for c in level.numeric]
        if name == "transaction":
            out += [(name, "time_of_day", "hour(ts) + minute(ts) / 60"), (name, "weekday", "(isodow(ts) - 1)::DOUBLE")]
        if name == "account":
            out.append((name, "age_days", "floor((epoch_us(ts) - epoch_us(created)) / 86400000000.0)"))
    return out


def fit() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS level, '{c}' AS feature, coalesce(median({x}), 0) AS median, min(coalesce({x}, (SELECT coalesce(median({x}), 0) FROM t))) AS least, max(coalesce({x}, (SELECT coalesce(median({x}), 0) FROM t))) AS most FROM t"
        for n, c, x in features()
    )


def encoded() -> str:
    parts, at = [], 0
    for name, level in ROLES.levels.items():
        for n, c, x in features():
            if n == name:
                parts.append(f"SELECT {at} AS place, sum(greatest(0, least(1, (coalesce({x}, median) - least) / CASE WHEN most > least THEN most - least ELSE 1 END))) AS total FROM t, f WHERE f.level = '{n}' AND f.feature = '{c}'")
                at += 1
        for c, vocab in level.categorical.items():
            for v in vocab:
                parts.append(f"SELECT {at}, sum(({c} IS NOT DISTINCT FROM '{v}')::INT) FROM t")
                at += 1
            names = ", ".join(f"'{v}'" for v in vocab)
            parts.append(f"SELECT {at}, sum((coalesce({c}, '-') NOT IN ({names}))::INT) FROM t")
            at += 1
    return " UNION ALL ".join(parts)


IMP = "ph AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_pop({signed_log(c)}) AS phi FROM t" for c in ("amount", "k", "cnt_1h", "n_orders", "acctbal")) + "), mm AS (SELECT feature, coalesce((phi - min(phi) OVER ()) / nullif(max(phi) OVER () - min(phi) OVER (), 0), 0) AS phi FROM ph)"

VEC = """v AS (SELECT vec_id AS row_id, label % 2 AS label, embedding::DOUBLE[] AS x FROM embeddings),
cn AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS k, row_number() OVER (ORDER BY count(*) DESC, label) AS big FROM v GROUP BY 1),
sz AS (SELECT *, greatest(2, n // 5) AS size FROM cn),
q0 AS (SELECT *, CASE WHEN n <= size THEN c ELSE greatest(round_even(size * c / n, 0), least(c, size // (2 * k))) END AS q FROM sz),
qt AS (SELECT label, CASE WHEN big = 1 AND n > size THEN q + size - sum(q) OVER () ELSE q END AS q FROM q0),
rf AS (SELECT row_id, label, x FROM (SELECT v.*, q, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || row_id), row_id) AS r FROM v JOIN qt USING (label)) WHERE r <= q),
nn AS (SELECT a.row_id AS src, b.row_id AS dst, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS sign, list_distance(a.x, b.x) AS distance FROM rf a JOIN rf b ON a.row_id <> b.row_id),
nk AS (SELECT *, row_number() OVER p AS r, count(*) OVER (PARTITION BY src, sign) AS m FROM nn WINDOW p AS (PARTITION BY src, sign ORDER BY distance, dst)),
ed AS (SELECT src, dst, sign, distance FROM nk WHERE r <= least(m, greatest(2, round_even(CASE WHEN sign = 1 THEN 0.05 ELSE 0.03 END * m, 0)))),
ew AS (SELECT src, dst, sign / (1 + distance) / count(*) OVER (PARTITION BY src) AS weight FROM ed)"""

TOP5 = f"{SCORED}, {top(5, 'fl')}"
MANY = ", ".join(top(p, f"f{p}") for p in (1, 2, 5, 10))

VIEWS = f"WITH {TX}, vw AS (SELECT row_id, [amount, k, cnt_1h] AS va, [coalesce(n_orders, 0), coalesce(acctbal, 0), 1] AS vb FROM t)"


def by_place(vector: str) -> str:
    return f"u AS (SELECT row_id, unnest({vector})::DOUBLE AS v, (generate_subscripts({vector}, 1) - 1)::INT AS place FROM vw)"


#: Paths of the reference graph by number of hops, and both ways of reaching.
PATHS = """pa AS (
    SELECT src, dst, 1 AS hops FROM ed
    UNION
    SELECT pa.src, ed.dst, hops + 1 FROM pa JOIN ed ON pa.dst = ed.src WHERE hops < 24),
sp AS (SELECT src, dst, min(hops) AS hops FROM pa WHERE src <> dst GROUP BY ALL)"""

SQL = {
    "b9_scale_views": f"{VIEWS}, {by_place('list_concat(va, vb)')} SELECT row_id, place, round(coalesce((v - min(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0), 0), 6) AS v FROM u WINDOW p AS (PARTITION BY place)",
    "d5_fuse": f"{VIEWS}, {by_place('[va[1] * vb[1], va[2] * vb[2], va[3] * vb[3]]')} SELECT row_id, place, round(v, 6) AS v FROM u",
    "d6_final_features": f"{VIEWS}, {by_place('[va[1], va[2], va[3], vb[1], vb[2], vb[3], va[1] * vb[1], va[2] * vb[2], va[3] * vb[3]]')} SELECT row_id, place, round(v, 6) AS v FROM u",
    "e5_vote_unseen": f"""WITH {VEC},
cs AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM rf GROUP BY 1),
kk AS (SELECT label, least(c - 1, greatest(2, round_even(0.05 * (c - 1), 0))) AS kp, least(n - c, greatest(2, round_even(0.03 * (n - c), 0))) AS kn FROM cs),
qd AS (SELECT a.row_id AS src, b.row_id AS dst, b.label, list_distance(a.x, b.x) AS distance FROM v a CROSS JOIN rf b WHERE a.row_id NOT IN (SELECT row_id FROM rf)),
vt AS (SELECT src, label, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM qd) WHERE r <= (SELECT greatest(1, min(kp)) FROM kk) GROUP BY ALL),
own AS (SELECT src, arg_max(label, (m, -label)) AS own FROM vt GROUP BY 1)
SELECT src, own AS vote FROM own""",
    "e6_query_edges": f"""WITH {VEC},
cs AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM rf GROUP BY 1),
kk AS (SELECT label, least(c - 1, greatest(2, round_even(0.05 * (c - 1), 0))) AS kp, least(n - c, greatest(2, round_even(0.03 * (n - c), 0))) AS kn FROM cs),
qd AS (SELECT a.row_id AS src, b.row_id AS dst, b.label, list_distance(a.x, b.x) AS distance FROM v a CROSS JOIN rf b WHERE a.row_id NOT IN (SELECT row_id FROM rf)),
vt AS (SELECT src, label, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM qd) WHERE r <= (SELECT greatest(1, min(kp)) FROM kk) GROUP BY ALL),
own AS (SELECT src, arg_max(label, (m, -label)) AS own FROM vt GROUP BY 1),
sg AS (SELECT qd.*, own, CASE WHEN label = own THEN 1 ELSE -1 END AS sign FROM qd JOIN own USING (src)),
rk AS (SELECT sg.*, row_number() OVER (PARTITION BY src, sign ORDER BY distance, dst) AS r FROM sg)
SELECT src, dst, sign, round(distance, 6) AS distance FROM rk JOIN kk ON kk.label = own WHERE r <= CASE WHEN sign = 1 THEN kp ELSE kn END""",
    "e13_path_metrics": f"WITH RECURSIVE {VEC}, {PATHS} SELECT coalesce(max(hops), 0) AS diameter, round(coalesce(avg(hops), 0), 6) AS mean_path, count(*) AS pairs FROM sp",
    "e14_strong_components": f"WITH RECURSIVE {VEC}, {PATHS} SELECT row_id AS node, least(row_id, coalesce((SELECT min(a.dst) FROM sp a JOIN sp b ON a.src = b.dst AND a.dst = b.src WHERE a.src = row_id), row_id)) AS component FROM rf",
    "lifetime_summary": f"{IN} SELECT lifetime_id, count(*) AS n, round(sum(amount * label), 4) AS fraud_amount FROM x WHERE lifetime_id >= 0 GROUP BY 1",
    "a1_read_transactions": f"WITH {TX} SELECT row_id, user_id, amount, label, k, round(gap_sec, 6) AS gap_sec, cnt_1h, round(sum_1h, 6) AS sum_1h, k_band, n_orders, round(avg_total, 6) AS avg_total, last_status, segment, region FROM t",
    "a3_contract_violations": f"""WITH {TX}, b AS (SELECT count(*) FILTER (amount IS NULL OR isnan(amount) OR isinf(amount) OR amount < 0) AS a, count(*) FILTER (ts IS NULL) AS b, count(*) FILTER (created IS NULL) AS c, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS d FROM t)
        SELECT 'amount_not_finite_or_negative' AS rule, a AS n FROM b UNION ALL SELECT 'time_null', b FROM b UNION ALL SELECT 'created_null', c FROM b UNION ALL SELECT 'label_not_0_or_1', d FROM b""",
    "a4_temporal_split": f"WITH {E} SELECT CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS side, count(*) AS n, round(sum(amount), 2) AS amount FROM e GROUP BY 1",
    "a5_recent_window": f"WITH {E} SELECT row_id, amount FROM e WHERE ts > (SELECT max(ts) - INTERVAL 7 DAYS FROM e)",
    "b1_b4_scalar_encoding": f"WITH {TX} SELECT row_id, round(CASE WHEN k <> 0 THEN k END, 6) AS b1, round({signed_log('(amount - 20)')}, 6) AS b2, round(hour(ts) + minute(ts) / 60, 6) AS b3_time, (isodow(ts) - 1)::INT AS b3_day, floor((epoch_us(ts) - epoch_us(created)) / 86400000000.0) AS b4 FROM t",
    "b5_one_hot": f"WITH {TX} SELECT row_id, concat_ws(',', " + ", ".join(f"coalesce(segment = '{v}', false)::INT" for v in ROLES.levels["customer"].categorical["segment"]) + f", (coalesce(segment, '-') NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'))::INT) AS hot FROM t",
    "b6_fit_encoder": f"WITH {TX} SELECT level, feature, round(median, 6) AS median, round(least, 6) AS least, round(most, 6) AS most FROM ({fit()})",
    "b7_b8_encode": f"WITH {TX}, f AS ({fit()}) SELECT place, round(total, 4) AS total FROM ({encoded()})",
    "c1_with_slot": f"WITH {E} SELECT row_id, time_bucket(INTERVAL 30 MINUTES, ts) AS slot FROM e",
    "c2_slot_totals": f"WITH {E}, {grid()} SELECT slot, round(amount, 6) AS amount, round(fraud_amount, 6) AS fraud_amount, n, frauds FROM tot",
    "c3_slot_grid": f"WITH {E}, {grid()} SELECT slot, round(amount, 6) AS amount, round(fraud_amount, 6) AS fraud_amount, n, frauds FROM g",
    "c4_slot_stats": f"{BASE} SELECT slot, round(intensity, 6) AS intensity, round(frequency, 6) AS frequency, round(rel_intensity, 6) AS rel_intensity, round(rel_frequency, 6) AS rel_frequency, active FROM s",
    "c5_lifetimes": f'{BASE} SELECT lifetime_id, start, "end" FROM life',
    "c5_lifetimes_default": f'WITH {E}, {stats(4.0)}, {LIFE} SELECT lifetime_id, start, "end" FROM life',
    "c6_assign_lifetime": f"{IN} SELECT row_id, lifetime_id FROM x",
    "c7_active_averages": f"{BASE} SELECT round(coalesce(avg(rel_intensity) FILTER (active), 0), 6) AS avg_intensity, round(coalesce(avg(rel_frequency) FILTER (active), 0), 6) AS avg_frequency FROM s",
    "c8_quantile_thresholds": f"{BASE} SELECT round(quantile_cont(rel_intensity, 0.9), 6) AS intensity, round(quantile_cont(rel_frequency, 0.9), 6) AS frequency FROM s",
    "c9_slot_features": f"""WITH {TX}, z AS (SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) AS slot FROM t),
        mo AS (SELECT slot, c, arg_min(v, (-n, v)) AS v FROM (SELECT slot, c, v, count(*) AS n FROM (SELECT slot, 'k_band' AS c, k_band AS v FROM z UNION ALL SELECT slot, 'last_status', last_status FROM z) WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        ea AS (SELECT slot, avg(amount) AS a, avg(k) AS b, avg(gap_sec) AS c, count(*) AS n FROM z GROUP BY 1)
        SELECT r.slot, round(coalesce(a, 0) + 0.0000123, 4) AS mean_amount, round(coalesce(b, 0) + 0.0000123, 4) AS mean_k, round(coalesce(c, 0) + 0.0000123, 4) AS mean_gap_sec,
               coalesce(list_position(['low', 'mid', 'high'], (SELECT v FROM mo WHERE mo.slot = r.slot AND mo.c = 'k_band')) - 1, -1)::INT AS code_k_band,
               coalesce(list_position(['F', 'O', 'P'], (SELECT v FROM mo WHERE mo.slot = r.slot AND mo.c = 'last_status')) - 1, -1)::INT AS code_last_status,
               coalesce(n, 0) AS n, hour(r.slot)::INT AS slot_hour, (isodow(r.slot) - 1)::INT AS slot_weekday
        FROM (SELECT unnest(generate_series(min(slot), max(slot), INTERVAL 30 MINUTES)) AS slot FROM ea) r LEFT JOIN ea USING (slot)""",
    "d2_minmax_importance": f"WITH {TX}, {IMP} SELECT feature, round(phi, 6) AS phi FROM mm",
    "d3_level_weights": f"{BASE}, {TX}, {IMP} SELECT feature, round(phi * (0.3 * (SELECT coalesce(avg(rel_intensity) FILTER (active), 0) FROM s) + 0.7 * (SELECT coalesce(avg(rel_frequency) FILTER (active), 0) FROM s)), 6) AS weight FROM mm",
    "d4_project": "WITH u AS (SELECT vec_id AS row_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT row_id, (i % 24)::INT AS place, round(avg(v), 6) AS v FROM u GROUP BY ALL",
    "e1_stratified_sample": f"WITH {VEC} SELECT row_id, label FROM rf",
    "e2_k_from_ratio": f"""WITH {VEC}, ra AS (SELECT unnest({list(RATIOS)})::DOUBLE AS ratio)
        SELECT label, ratio, least(c - 1, greatest(2, round_even(ratio * (c - 1), 0)))::BIGINT AS k_pos, least(n - c, greatest(2, round_even(ratio * (n - c), 0)))::BIGINT AS k_neg FROM cn, ra""",
    "e3_signed_knn_edges": f"WITH {VEC} SELECT src, dst, sign, round(distance, 6) AS distance FROM ed",
    "e4_edge_weights": f"WITH {VEC} SELECT src, dst, round(weight, 6) AS weight FROM ew",
    "e5_vote_label": f"WITH {VEC}, vo AS (SELECT src, label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM ed) JOIN rf ON dst = row_id WHERE r <= 3 GROUP BY ALL) SELECT src, arg_max(label, (n, -label)) AS vote FROM vo GROUP BY 1",
    "e7_signed_neighbor_mean": f"WITH {VEC}, u AS (SELECT row_id AS dst, unnest(x) AS xv, generate_subscripts(x, 1) - 1 AS place FROM rf) SELECT src, place::INT AS place, round(sum(weight * xv), 6) AS mean FROM ew JOIN u USING (dst) GROUP BY ALL",
    "e10_fold_assign": f"WITH {E} SELECT row_id, ((row_number() OVER (PARTITION BY label ORDER BY md5('0:' || row_id), row_id) - 1) % 5)::INT AS fold FROM e",
    "e12_edge_reciprocity": f"WITH {VEC} SELECT round(avg((EXISTS (SELECT 1 FROM ed b WHERE b.src = a.dst AND b.dst = a.src))::INT), 6) AS reciprocity FROM ed a",
    "f1_similarity": f"{IN}, {SIM} SELECT row_id, lifetime_id, round(similarity, 6) AS similarity FROM sim",
    "f2_confidence": f"{IN}, {SIM}, {CONF} SELECT row_id, lifetime_id, round(confidence, 6) AS confidence FROM cf",
    "f3_high_confidence": f"{IN}, {SIM}, {CONF}, {HIGH} SELECT row_id, lifetime_id FROM hi",
    "f4_remaining": f"{IN}, {SIM}, {CONF}, {HIGH} SELECT row_id, lifetime_id FROM re",
    "f5_temporal_weight": f"WITH {E} SELECT row_id, round(exp(-abs(k - 50)) / (1 + exp(-abs(k - 50))), 9) AS weight FROM e",
    "f6_windowed_fraud_means": f"{ALL} SELECT j, round(a1 + 0.0000123, 4) AS w0, round(a2 + 0.0000123, 4) AS w1 FROM w",
    "f7_possibility_raw": f"{ALL} SELECT row_id, lifetime_id, round(fps, 6) AS fps FROM fp",
    "f8_temporal_correlation": f"{ALL} SELECT i, j, view, round(m, 6) AS m FROM m",
    "f9_fraud_possibility": f"{ALL} SELECT row_id, round(p, 6) AS p FROM po",
    "f10_weighted_training_set": f"{ALL} SELECT row_id, target, round(weight, 6) AS weight FROM (SELECT row_id, label AS target, 1.0::DOUBLE AS weight FROM e WHERE row_id NOT IN (SELECT row_id FROM po) UNION ALL SELECT row_id, 1, p FROM po UNION ALL SELECT row_id, 0, 1 - p FROM po) WHERE weight > 0",
    "g3_standardize_slots": f"{BASE} SELECT slot, round((intensity - avg(intensity) OVER ()) / stddev_pop(intensity) OVER (), 6) AS intensity, round((frequency - avg(frequency) OVER ()) / stddev_pop(frequency) OVER (), 6) AS frequency FROM s",
    "g4_stratified_bootstrap": f"""{BASE}, rk AS (SELECT slot, active, row_number() OVER (PARTITION BY active ORDER BY md5('1:' || slot::VARCHAR), slot) - 1 AS r, count(*) OVER (PARTITION BY active) AS n FROM s)
        SELECT b.slot, b.active FROM rk a JOIN rk b ON a.active = b.active AND ('0x' || substr(md5('1:draw:' || a.slot::VARCHAR), 1, 13))::BIGINT % a.n = b.r""",
    "g8_nearest_lifetimes": f'{BASE} SELECT row_id, (SELECT max("end") FROM life WHERE "end" <= ts) AS prev_end, (SELECT min(start) FROM life WHERE start > ts) AS next_start FROM e',
    "g9_adjust_scores": f"""{SCORED}, nr AS (SELECT row_id, score, EXISTS (SELECT 1 FROM life WHERE ts >= start AND ts < "end") AS hit,
        exp(-0.1 * (epoch_us(ts) - epoch_us((SELECT max("end") FROM life WHERE "end" <= ts))) / 60e6) AS a, exp(-0.1 * (epoch_us((SELECT min(start) FROM life WHERE start > ts)) - epoch_us(ts)) / 60e6) AS b FROM sc)
        SELECT row_id, round(CASE WHEN hit THEN score ELSE score * coalesce((a + b) / 2, a, b, 1) END, 6) AS adjusted FROM nr""",
    "g12_run_summary": f"{IN} SELECT (SELECT count(*) FILTER (active) FROM s) AS active_slots, (SELECT count(*) FROM s) AS slots, count(DISTINCT lifetime_id) AS lifetimes, count(*) AS inside, sum(label)::BIGINT AS frauds FROM x WHERE lifetime_id >= 0",
    "h1_average_precision": f"{SCORED}, {CUM} SELECT round(average_precision, 6) AS average_precision FROM ap",
    "h2_roc_auc": f"{SCORED}, {CUM} SELECT round(sum(pos * (all_n - all_pos - (up_n - up_pos)) + 0.5 * pos * (n - pos)) / max(all_pos * (all_n - all_pos)), 6) AS roc_auc FROM cu",
    "h3_top_percent": f"{TOP5} SELECT row_id, flagged FROM fl",
    "h4_h6_confusion": f"{TOP5} SELECT tn, fp, fn, tp, round(macro_f1, 6) AS macro_f1, round(fpr, 6) AS fpr FROM {rates('fl')}",
    "h7_evaluate": f"{SCORED}, {CUM}, {MANY} " + " UNION ALL ".join(f"SELECT {p}.0::DOUBLE AS percent, round(macro_f1, 6) AS macro_f1, round(fpr, 6) AS fpr, round((SELECT average_precision FROM ap), 6) AS average_precision FROM {rates(f'f{p}')}" for p in (1, 2, 5, 10)),
}
