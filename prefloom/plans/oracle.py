"""DuckDB SQL for the library's queries, written from the formulas."""

from __future__ import annotations

from .queries import ALPHA, BETAS, TWO, U

_EVENTS = """ev AS (SELECT user_id AS rid, event_type AS lab, min(ts) AS k FROM events GROUP BY 1, 2),
 r AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k, lab) - 1 AS pos, dense_rank() OVER (ORDER BY lab) - 1 AS item FROM ev)"""
_ORDERS = """od AS (SELECT o_custkey AS rid, o_orderpriority AS lab, min(o_orderdate) AS k FROM orders GROUP BY 1, 2),
 r AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k, lab) - 1 AS pos, dense_rank() OVER (ORDER BY lab) - 1 AS item FROM od)"""
_BRANDS = """br AS (SELECT l_orderkey AS rid, p_brand AS lab, max(l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 r AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k DESC, lab) - 1 AS pos, dense_rank() OVER (ORDER BY lab) - 1 AS item FROM br)"""
_PAIRS = "c AS (SELECT a.rid, a.item AS winner, b.item AS loser FROM r a JOIN r b ON a.rid = b.rid AND a.pos < b.pos)"
_COUNTS = "n AS (SELECT winner, loser, count(*) AS cnt FROM c GROUP BY 1, 2)"
#: both directions of observed pairs
_BOTH = """m AS (SELECT DISTINCT winner, loser FROM (SELECT winner, loser FROM n UNION ALL SELECT loser, winner FROM n)),
 b AS (SELECT m.loser, m.winner, coalesce(x.cnt, 0) AS w, coalesce(y.cnt, 0) AS l FROM m LEFT JOIN n x ON x.winner = m.winner AND x.loser = m.loser LEFT JOIN n y ON y.winner = m.loser AND y.loser = m.winner)"""
_GRADED = """gr AS (SELECT o_custkey AS u, o_orderpriority AS lab, least(count(*) - 1, 3) AS s FROM orders GROUP BY 1, 2),
 g AS (SELECT u, dense_rank() OVER (ORDER BY lab) - 1 AS item, s FROM gr)"""
_BINARY = """bo AS (SELECT o_custkey AS u, o_orderpriority AS lab, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
 g AS (SELECT u, dense_rank() OVER (ORDER BY lab) - 1 AS item, CASE WHEN st = 'F' THEN 1 ELSE 0 END AS s FROM bo WHERE rn = 1)"""
_U = "uu(component, item, u) AS (VALUES " + ", ".join(f"({k}, {i}, {v}::DOUBLE)" for k, row in enumerate(U) for i, v in enumerate(row)) + ")"
_A = "aa(component, a) AS (VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, v in enumerate(ALPHA)) + ")"
_B = "bb(item, level, beta) AS (VALUES " + ", ".join(f"({i}, {k + 1}, {v}::DOUBLE)" for i, row in enumerate(BETAS) for k, v in enumerate(row)) + ")"


_MEAN = "es AS (SELECT item, row_number() OVER (ORDER BY avg(pos), item) - 1 AS pos FROM r GROUP BY item)"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(parts) + "\n"


def _r(x: str, n: int = 6) -> str:
    return f"round(({x})::DOUBLE, {n}) + 0.0"


_LL = f"""s AS (SELECT rid, pos, component, u, ln(sum(exp(u)) OVER (PARTITION BY rid, component ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lse, max(pos) OVER (PARTITION BY rid, component) AS last FROM r JOIN uu ON r.item = uu.item),
 ll AS (SELECT rid, component, sum(CASE WHEN pos < last THEN u - lse ELSE 0 END) AS loglik FROM s GROUP BY 1, 2),
 z AS (SELECT ll.*, a, exp(loglik) * a AS e FROM ll JOIN aa ON ll.component = aa.component),
 q AS (SELECT rid, component, e / sum(e) OVER (PARTITION BY rid) AS q, ln(sum(e) OVER (PARTITION BY rid)) AS lse FROM z)"""
_CHAIN = """p AS (SELECT loser AS src, winner AS dst, (w + 1.0) / (w + l + 2.0) AS p FROM b),
 rs AS (SELECT src, sum(p) AS row FROM p GROUP BY 1), dd AS (SELECT max(row) AS d FROM rs),
 ch AS (SELECT src, dst, p / d AS p FROM p, dd UNION ALL SELECT src, src, 1 - row / d FROM rs, dd)"""
_RASCH = """n AS (SELECT a.item AS i, b.item AS j, count(*) AS y FROM g a JOIN g b ON a.u = b.u WHERE a.s = 1 AND b.s = 0 GROUP BY 1, 2),
 k AS (SELECT i, j, sum(y) + 1.0 AS p FROM (SELECT i, j, y FROM n UNION ALL SELECT j, i, 0 FROM n) WHERE i <> j GROUP BY 1, 2)"""
_PCM = """cs AS (SELECT item, level, beta, sum(beta) OVER (PARTITION BY item ORDER BY level) AS run FROM bb),
 lv AS (SELECT item, level, run FROM cs UNION ALL SELECT DISTINCT item, 0, 0.0 FROM bb),
 e AS (SELECT g.u, g.item, g.s, level, exp(level * ((g.u % 7 - 3) / 2.0::DOUBLE) - run) AS e FROM g JOIN lv ON g.item = lv.item),
 pr AS (SELECT u, item, s, level, e / sum(e) OVER (PARTITION BY u, item) AS p FROM e)"""
_EMB = "x AS (SELECT rid, least(winner, loser) AS i, greatest(winner, loser) AS j, winner < loser AS f FROM c)"
_K = "(5 * i - (i * (i + 1)) // 2 + (j - i - 1))"

SQL: dict[str, str] = {
    "rank_break_full": _with(_ORDERS, _PAIRS) + "SELECT rid AS ranking_id, winner, loser FROM c",
    "choice_tensor": _with(_ORDERS, _PAIRS) + "SELECT winner, loser, rid AS ranking_id FROM c",
    "pairwise_counts": _with(_ORDERS, _PAIRS, _COUNTS) + "SELECT winner, loser, cnt FROM n",
    "brand_pairwise_counts": _with(_BRANDS, _PAIRS, _COUNTS) + "SELECT winner, loser, cnt FROM n",
    "pairwise_prob_raw": _with(_BRANDS, _PAIRS, _COUNTS, _BOTH) + f"SELECT loser, winner, {_r('w / (w + l)::DOUBLE')} AS p FROM b",
    "pairwise_prob_laplace": _with(_BRANDS, _PAIRS, _COUNTS, _BOTH) + f"SELECT loser, winner, {_r('(w + 1) / (w + l + 2)::DOUBLE')} AS p FROM b",
    "pairwise_prob_onesided": _with(_BRANDS, _PAIRS, _COUNTS, _BOTH) + f"SELECT loser, winner, {_r('CASE WHEN w = 0 OR l = 0 THEN (w + 1) / (w + l + 2)::DOUBLE ELSE w / (w + l)::DOUBLE END')} AS p FROM b",
    "pairwise_weighted": _with(_ORDERS, _PAIRS, "n AS (SELECT winner, loser, sum(1.0::DOUBLE / (1 + rid % 4)) AS cnt FROM c GROUP BY 1, 2)", _BOTH)
    + f"SELECT loser, winner, {_r('w', 4)} AS weight, {_r('w / (w + l)')} AS p FROM b",
    "choice_counts": _with(_ORDERS) + "SELECT item AS item_id, sum(CASE WHEN pos < last THEN 1 ELSE 0 END)::BIGINT AS wins FROM (SELECT item, pos, max(pos) OVER (PARTITION BY rid) AS last FROM r) GROUP BY 1",
    "win_matrix": _with(_ORDERS) + "SELECT rid AS ranking_id, item AS item_id FROM (SELECT rid, item, pos, max(pos) OVER (PARTITION BY rid) AS last FROM r) WHERE pos < last",
    "stage_statistics": _with(_EVENTS)
    + "SELECT rid AS ranking_id, item AS item_id, CASE WHEN pos < last THEN 1 ELSE 0 END AS u, least(pos + 1, last) AS stages FROM (SELECT rid, item, pos, max(pos) OVER (PARTITION BY rid) AS last FROM r)",
    "rank_centrality_chain": _with(_EVENTS, _PAIRS, _COUNTS, _BOTH, _CHAIN) + f"SELECT src, dst, {_r('p')} AS p FROM ch",
    "rank_centrality_t12": _with(
        _EVENTS, _PAIRS, _COUNTS, _BOTH, _CHAIN,
        "it(step, item, pi) AS (SELECT 0, src, 1.0::DOUBLE / 5 FROM rs UNION ALL SELECT step + 1, dst, sum(pi * p) FROM it JOIN ch ON it.item = ch.src WHERE step < 12 GROUP BY step, dst)",
        recursive=True,
    ) + f"SELECT item AS item_id, {_r('pi')} AS pi FROM it WHERE step = 12",
    "ilsr_one_step_chain": _with(_ORDERS, "s AS (SELECT rid, pos, item, 1.0::DOUBLE / (0.2 * count(*) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM r)")
    + f"SELECT b.item AS loser, a.item AS winner, {_r('sum(a.rate)', 4)} AS rate FROM s a JOIN s b ON a.rid = b.rid AND a.pos < b.pos GROUP BY 1, 2",
    "mm_one_step": _with(
        _ORDERS,
        "s AS (SELECT rid, pos, item, max(pos) OVER (PARTITION BY rid) AS last FROM r)",
        "t AS (SELECT rid, pos, item, last, CASE WHEN pos < last THEN 1.0::DOUBLE / (last + 1 - pos) ELSE 0 END AS inv FROM s WHERE last > 0)",
        "v AS (SELECT *, sum(inv) OVER (PARTITION BY rid ORDER BY pos) AS run FROM t)",
    ) + f"SELECT item AS item_id, sum(CASE WHEN pos < last THEN 1 ELSE 0 END)::BIGINT AS wins, {_r('sum(run)', 4)} AS denom FROM v GROUP BY 1",
    "rasch_chain_counts": _with(_BINARY) + "SELECT a.item AS i, b.item AS j, count(*) AS n FROM g a JOIN g b ON a.u = b.u WHERE a.s = 1 AND b.s = 0 GROUP BY 1, 2",
    "rasch_co_responses": _with(_BINARY) + "SELECT a.item AS i, b.item AS j, count(*) AS b FROM g a JOIN g b ON a.u = b.u GROUP BY 1, 2",
    "rasch_chain_accelerated": _with(_BINARY, _RASCH, "rs AS (SELECT i, sum(p) AS row, greatest(sum(p), 1.0) AS d FROM k GROUP BY 1)")
    + f"SELECT k.i AS src, k.j AS dst, {_r('p / d')} AS p FROM k JOIN rs ON k.i = rs.i UNION ALL SELECT i, i, {_r('1 - row / d')} FROM rs",
    "rasch_chain_plain": _with(
        _BINARY, _RASCH, "dd AS (SELECT a.item AS i, count(*) + 1.0::DOUBLE AS d FROM g a JOIN g b ON a.u = b.u GROUP BY 1)", "o AS (SELECT k.i, k.j, p / d AS p FROM k JOIN dd ON k.i = dd.i)"
    ) + f"SELECT i AS src, j AS dst, {_r('p')} AS p FROM o UNION ALL SELECT i, i, {_r('1 - sum(p)')} FROM o GROUP BY i",
    "pcm_level_counts": _with(_GRADED) + "SELECT a.s AS k, b.s AS l, a.item AS i, b.item AS j, count(*) AS n FROM g a JOIN g b ON a.u = b.u WHERE a.s = b.s + 1 OR a.s <= 1 GROUP BY 1, 2, 3, 4",
    "pl_loglik": _with(_ORDERS, _U, _A, _LL) + f"SELECT rid AS ranking_id, component, {_r('loglik')} AS loglik FROM ll",
    "pl_posterior": _with(_ORDERS, _U, _A, _LL) + f"SELECT rid AS ranking_id, component, {_r('q')} AS q FROM q",
    "pl_mixture_loglik": _with(_ORDERS, _U, _A, _LL) + f"SELECT {_r('avg(lse)')} AS loglik FROM q WHERE component = 0",
    "alpha_update": _with(_ORDERS, _U, _A, _LL) + f"SELECT component, {_r('avg(q)')} AS a FROM q GROUP BY 1",
    "pair_composite_loglik": _with(_ORDERS, _PAIRS, _U)
    + f"SELECT rid AS ranking_id, a.component, {_r('sum(-ln(1 + exp(b.u - a.u)))')} AS loglik FROM c JOIN uu a ON a.item = c.winner JOIN uu b ON b.item = c.loser AND a.component = b.component GROUP BY 1, 2",
    "pcm_probabilities": _with(_GRADED, _B, _PCM) + f"SELECT u AS user_id, item AS item_id, level, {_r('p')} AS p FROM pr",
    "pcm_heldout": _with(_GRADED, _B, _PCM, "rk AS (SELECT *, row_number() OVER (PARTITION BY u, item ORDER BY round(p, 12) DESC, level) AS rn FROM pr)")
    + f"SELECT u AS user_id, item AS item_id, s AS score, max(CASE WHEN rn = 1 THEN level END) AS predicted, {_r('max(CASE WHEN level = s THEN p END)')} AS p FROM rk GROUP BY 1, 2, 3",
    "cramer_rao_bound": _with(_BINARY, _B, "us AS (SELECT DISTINCT u FROM g)", "v AS (SELECT item, 1 / (1 + exp(beta - (u % 7 - 3) / 2.0::DOUBLE)) AS s FROM us, bb WHERE level = 1)")
    + f"SELECT item AS item_id, {_r('1 / sum(0.8 * s * (1 - s))', 8)} AS bound FROM v GROUP BY 1",
    "heldout_loglik": _with(_BINARY) + f"SELECT {_r('avg(CASE WHEN s = 1 THEN ln(0.2 + 0.1 * item) ELSE ln(1 - (0.2 + 0.1 * item)) END)')} AS loglik FROM g",
    "auc": _with(_BINARY, "v AS (SELECT (u * 7 + item * 3) % 11 AS p, s FROM g)", "w AS (SELECT p, sum(s) AS pos, sum(1 - s) AS neg FROM v GROUP BY 1)", "x AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w)")
    + f"SELECT {_r('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))')} AS auc FROM x",
    "top_k_accuracy": _with(_EVENTS, _MEAN) + f"SELECT a.rid AS ranking_id, {_r('count(b.item) / 3.0::DOUBLE')} AS accuracy FROM r a LEFT JOIN es b ON a.item = b.item AND b.pos < 3 WHERE a.pos < 3 GROUP BY 1",
    "kendall_distance": _with(_EVENTS, _MEAN, "j AS (SELECT a.rid, a.pos AS t, b.pos AS e FROM r a JOIN es b ON a.item = b.item)")
    + f"SELECT a.rid AS ranking_id, {_r('sum(CASE WHEN a.e > b.e THEN 1 ELSE 0 END) / count(*)::DOUBLE')} AS distance FROM j a JOIN j b ON a.rid = b.rid AND a.t < b.t GROUP BY 1",
    "pairwise_loglik": _with(_EVENTS, _PAIRS, _COUNTS, _BOTH, _U)
    + f"SELECT {_r('sum((w + 1.0) / (w + l + 2.0) * -ln(1 + exp(y.u - x.u)))')} AS loglik FROM b JOIN uu x ON x.item = b.winner AND x.component = 0 JOIN uu y ON y.item = b.loser AND y.component = 0",
    "confusion_counts": "SELECT label::INTEGER AS truth, ((label * 3 + vec_id % 4) % 10)::INTEGER AS predicted, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "embed_pairwise_signed": _with(_ORDERS, _PAIRS, _EMB) + f"SELECT rid AS ranking_id, {_K} AS k, CASE WHEN f THEN 0.5 ELSE -0.5 END::DOUBLE AS x FROM x",
    "embed_pairwise_binary": _with(_ORDERS, _PAIRS, _EMB) + f"SELECT rid AS ranking_id, {_K} AS k, 1.0::DOUBLE AS x FROM x WHERE f",
    "embed_partial": _with(
        _ORDERS, "t AS (SELECT rid, count(*) AS s FROM r GROUP BY 1)", "ids AS (SELECT i FROM range(0, 5) t(i))",
        "y AS (SELECT t.rid, s, a.i, b.i AS j, x.pos AS ri, z.pos AS rj FROM t JOIN ids a ON true JOIN ids b ON a.i < b.i LEFT JOIN r x ON x.rid = t.rid AND x.item = a.i LEFT JOIN r z ON z.rid = t.rid AND z.item = b.i)",
    )
    + f"SELECT rid AS ranking_id, {_K} AS k, {_r('CASE WHEN ri IS NOT NULL AND rj IS NOT NULL THEN CASE WHEN ri < rj THEN 1.0 ELSE 0.0 END WHEN ri IS NOT NULL THEN (s - ri) / (s + 1.0) WHEN rj IS NOT NULL THEN (rj + 1) / (s + 1.0) ELSE 0.5 END')} AS x FROM y",
    "embed_lehmer": _with(_ORDERS) + "SELECT a.rid AS ranking_id, a.pos AS k, count(b.item)::DOUBLE AS x FROM r a LEFT JOIN r b ON a.rid = b.rid AND b.pos < a.pos AND b.item > a.item GROUP BY 1, 2",
    "embed_positional": _with(_ORDERS) + "SELECT rid AS ranking_id, item AS k, pos::DOUBLE AS x FROM r WHERE pos > 0",
    "embed_top_k": _with(_ORDERS) + "SELECT rid AS ranking_id, item AS k, 1.0::DOUBLE AS x FROM r WHERE pos < 2",
    "embed_disjoint": _with(_ORDERS) + "SELECT rid AS ranking_id, item // 2 AS k, CASE WHEN arg_min(item, pos) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM r WHERE item < 4 GROUP BY 1, 2",
    "embed_square": _with(_ORDERS, _PAIRS) + "SELECT rid AS ranking_id, loser * 5 + winner AS k, 1.0::DOUBLE AS x FROM c UNION ALL SELECT rid, winner * 5 + loser, -1.0 FROM c",
    "embed_gram": _with(_ORDERS, _PAIRS, _EMB, f"v AS (SELECT rid, {_K} AS k, CASE WHEN f THEN 0.5 ELSE -0.5 END AS v FROM x)")
    + "SELECT a.k AS i, b.k AS j, sum(a.v * b.v)::DOUBLE AS s FROM v a JOIN v b ON a.rid = b.rid GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0",
    "preference_graph": _with(_BRANDS, _PAIRS, _COUNTS, _BOTH)
    + "SELECT CASE WHEN w < l THEN winner ELSE loser END AS src, CASE WHEN w < l THEN loser ELSE winner END AS dst FROM b WHERE loser < winner",
    "comparison_graph": _with(_BRANDS, _PAIRS, _COUNTS) + "SELECT a.winner AS src, a.loser AS dst FROM n a JOIN n b ON a.winner = b.loser AND a.loser = b.winner",
    "split_responses": _with(_BINARY, "t AS (SELECT item, count(*) AS n, floor(0.8 * count(*))::BIGINT AS k FROM g GROUP BY 1)")
    + "SELECT item AS item_id, 'train' AS split, k AS n FROM t WHERE k > 0 UNION ALL SELECT item, 'test', n - k FROM t WHERE n > k",
    "one_hot": _with(_GRADED) + "SELECT u AS user_id, item AS item_id, l AS level, CASE WHEN s = l THEN 1 ELSE 0 END AS z FROM g, range(0, 4) t(l)",
    "score_pairs": _with(_GRADED) + "SELECT a.u AS user_id, a.item AS i, b.item AS j FROM g a JOIN g b ON a.u = b.u WHERE a.s = 1 AND b.s = 0",
    "graded_to_binary": _with(_GRADED) + "SELECT u AS user_id, item AS item_id, CASE WHEN s >= 2 THEN 1 ELSE 0 END AS score FROM g",
    "menu_components": _with(
        "me AS (SELECT DISTINCT o_custkey % 60 AS m FROM orders)",
        "it AS (SELECT m, m AS x FROM me UNION ALL SELECT m, m + CASE WHEN m % 5 = 0 THEN 60 ELSE 1 END FROM me)",
        "ed AS (SELECT a.x AS s, b.x AS d FROM it a JOIN it b ON a.m = b.m AND a.x <> b.x)",
        "re(s, d) AS (SELECT s, s FROM ed UNION SELECT re.s, ed.d FROM re JOIN ed ON re.d = ed.s)",
        recursive=True,
    ) + "SELECT s::INTEGER AS node, min(d)::INTEGER AS root FROM re GROUP BY 1",
}

SQL |= {
    "pl_posterior_hard": _with(_ORDERS, _U, _A, _LL, "h AS (SELECT component, row_number() OVER (PARTITION BY rid ORDER BY q DESC, component) AS rn FROM q)") + "SELECT component, count(*) AS n FROM h WHERE rn = 1 GROUP BY 1",
    "pl_posterior_trimmed": _with(_ORDERS, _U, _A, _LL, "h AS (SELECT rid, component, CASE WHEN q < 0.25 THEN 0 ELSE q END AS q FROM q)")
    + f"SELECT rid AS ranking_id, component, {_r('q / sum(q) OVER (PARTITION BY rid)')} AS q FROM h",
    "mixture_evaluation": _with(
        _GRADED, _B, "cc(c) AS (VALUES (0), (1))", "cs AS (SELECT c, item, level, sum(beta + c * 0.5) OVER (PARTITION BY c, item ORDER BY level) AS run FROM bb, cc)",
        "lv AS (SELECT c, item, level, run FROM cs UNION ALL SELECT DISTINCT c, item, 0, 0.0 FROM bb, cc)",
        "e AS (SELECT g.u, g.item, g.s, c, level, exp(level * ((g.u % 7 - 3) / 2.0::DOUBLE + c / 2.0) - run) AS e FROM g JOIN lv ON g.item = lv.item)",
        "p AS (SELECT u, item, s, c, level, e / sum(e) OVER (PARTITION BY u, item, c) AS p FROM e)", "k AS (SELECT *, row_number() OVER (PARTITION BY u, item, c ORDER BY round(p, 12) DESC, level) AS rn FROM p)",
        "m AS (SELECT u, item, max(CASE WHEN c = 0 AND rn = 1 AND level <> s THEN 1.0 ELSE 0.0 END) AS miss, sum(CASE WHEN level = s THEN p * CASE WHEN c = 0 THEN 0.7 ELSE 0.3 END END) AS p FROM k GROUP BY 1, 2)",
    ) + f"SELECT {_r('avg(miss)')} AS error, {_r('sum(ln(p))', 3)} AS loglik FROM m",
    "composite_loglik_weighted": _with(
        _ORDERS, "c AS (SELECT a.rid, a.item AS winner, b.item AS loser, a.pos AS pa, b.pos AS pb FROM r a JOIN r b ON a.rid = b.rid AND a.pos < b.pos)", _U,
        "w AS (SELECT *, CASE WHEN (winner + loser) % 2 = 1 THEN 0.5 + 0.1 * (winner + loser) ELSE 1 END * CASE WHEN pa = 0 AND pb = 1 THEN 2 WHEN pa = 0 AND pb = 2 THEN 0.5 WHEN pa = 1 AND pb = 2 THEN 1.5 ELSE 1 END AS w FROM c)",
    ) + f"SELECT rid AS ranking_id, a.component, {_r('sum(-w * ln(1 + exp(b.u - a.u)))')} AS loglik FROM w JOIN uu a ON a.item = winner JOIN uu b ON b.item = loser AND a.component = b.component GROUP BY 1, 2",
    "antisymmetric_pairs": _with(_ORDERS, _PAIRS) + "SELECT rid AS ranking_id, winner AS i, loser AS j, 0.5::DOUBLE AS x FROM c UNION ALL SELECT rid, loser, winner, -0.5 FROM c",
    "responses_unpivoted": _with(_BINARY) + "SELECT u AS user_id, item AS item_id, s AS score FROM g",
    "split_users": _with(_BINARY, "n AS (SELECT count(DISTINCT u) AS n FROM g)") + "SELECT 'train' AS split, floor(n * 0.7)::BIGINT AS users FROM n UNION ALL SELECT 'test', floor(n * 0.2)::BIGINT FROM n",
    "masked_cells": _with(_EVENTS, _PAIRS, _COUNTS, _BOTH) + f"SELECT loser AS i, winner AS j, {_r('(w + 1) / (w + l + 2)::DOUBLE')} AS p FROM b WHERE (loser + winner) % 2 = 1",
    "weekly_pairwise_counts": """
WITH e AS (SELECT user_id, (day(ts) - 1) // 7 AS t, event_type AS lab, min(ts) AS k FROM events GROUP BY 1, 2, 3),
r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id, t ORDER BY k, lab) AS pos, dense_rank() OVER (ORDER BY lab) - 1 AS item FROM e)
SELECT a.t::INTEGER AS t, a.item AS winner, b.item AS loser, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.t = b.t AND a.pos < b.pos GROUP BY 1, 2, 3""",
}

#: stationary mass by power steps that leave no change in the digits shown, over d, as centred logarithms
_STEPS = "it(step, item, pi) AS (SELECT 0, src, 1.0::DOUBLE / 5 FROM rs UNION ALL SELECT step + 1, dst, sum(pi * p) FROM it JOIN ch ON it.item = ch.src WHERE step < 400 GROUP BY step, dst)"
_RATES = "rs AS (SELECT i AS src, sum(p) AS row, greatest(sum(p), 1.0) AS d FROM k GROUP BY 1), ch AS (SELECT k.i AS src, k.j AS dst, p / d AS p FROM k JOIN rs ON k.i = rs.src UNION ALL SELECT src, src, 1 - row / d FROM rs)"
#: the best assignment of ten predicted labels to ten true ones, one true label at a time, by the set of those taken
_ASSIGN = ["w AS (SELECT label::INTEGER AS t, ((label * 3 + vec_id % 4) % 10)::INTEGER AS p, count(*) AS n FROM embeddings GROUP BY 1, 2)", "p AS (SELECT i AS p FROM range(0, 10) x(i))", "s0 AS (SELECT 0 AS taken, 0 AS n)"] + [
    f"s{t + 1} AS (SELECT taken + (1 << p.p) AS taken, max(s{t}.n + coalesce(w.n, 0)) AS n FROM s{t} JOIN p ON (taken >> p.p) % 2 = 0 LEFT JOIN w ON w.t = {t} AND w.p = p.p GROUP BY 1)" for t in range(10)
]
SQL |= {
    "rank_centrality": _with(_EVENTS, _PAIRS, _COUNTS, _BOTH, _CHAIN, _STEPS, recursive=True) + f"SELECT item AS item_id, {_r('ln(pi) - avg(ln(pi)) OVER ()', 4)} AS u FROM it WHERE step = 400",
    "rasch_beta": _with(_BINARY, _RASCH, _RATES, _STEPS, "z AS (SELECT item, ln(pi / d) AS u FROM it JOIN rs ON item = src WHERE step = 400)", recursive=True) + f"SELECT item AS item_id, {_r('u - avg(u) OVER ()', 4)} AS beta FROM z",
    "connectivity": _with(
        _BRANDS, _PAIRS, _COUNTS, "ed AS (SELECT a.winner AS s, a.loser AS d FROM n a JOIN n b ON a.winner = b.loser AND a.loser = b.winner)", "re(d) AS (SELECT 0::BIGINT UNION SELECT ed.d FROM re JOIN ed ON re.d = ed.s)", recursive=True
    ) + "SELECT count(DISTINCT d) = 25 AS connected FROM re",
    "clustering_accuracy": _with(*_ASSIGN) + f"SELECT {_r('s10.n / (SELECT sum(n) FROM w)::DOUBLE')} AS accuracy FROM s10",
}


def _key(seed: int, *columns: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(columns)}), 1, 15))::BIGINT"


def _bisect(score: str) -> list[str]:
    """Roots of the expected total of each pattern (items, total), by halving; ``score`` is that total of betas ``bs`` at x."""
    return [
        "pt AS (SELECT DISTINCT items, bs, total FROM us)",
        f"""bi(step, items, total, bs, low, high) AS (SELECT 0, items, total, bs, -6.0::DOUBLE, 6.0::DOUBLE FROM pt
 UNION ALL SELECT step + 1, items, total, bs, CASE WHEN m < total THEN x ELSE low END, CASE WHEN m < total THEN high ELSE x END FROM (SELECT *, {score} AS m FROM (SELECT *, (low + high) / 2 AS x FROM bi WHERE step < 60)))""",
        "th AS (SELECT u, (low + high) / 2 AS theta FROM us JOIN bi ON step = 60 AND us.items = bi.items AND us.total = bi.total)",
    ]


def _directions(k: int, size: int) -> list[str]:
    """Leading eigenvectors e0, e1, .. (v, lam) of the matrix of ``cell`` (i, j, s): squared thirty times, then deflated."""
    at = f"range(1, {size + 1})"
    out = [
        f"full_ AS (SELECT i, j, coalesce(s, 0) AS s FROM range(0, {size}) x(i) CROSS JOIN range(0, {size}) y(j) LEFT JOIN cell USING (i, j))",
        "g0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM full_ GROUP BY i))",
    ]
    scaled = lambda source: f"list_transform(m, lambda r: list_transform(r, lambda y: y / tr)) FROM (SELECT *, list_sum(list_transform({at}, lambda i: m[i][i])) AS tr FROM ({source}))"
    for j in range(k):
        squared = f"SELECT t, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS m FROM p{j} WHERE t < 30"
        out += [
            f"p{j}(t, m) AS (SELECT 0, {scaled(f'SELECT m FROM g{j}')} UNION ALL SELECT t + 1, {scaled(squared)})",
            f"d{j} AS (SELECT m, list_position(dg, list_max(dg)) AS a FROM (SELECT m, list_transform({at}, lambda i: m[i][i]) AS dg FROM p{j} WHERE t = 30))",
            f"w{j} AS (SELECT list_transform(m, lambda r: r[a] / sqrt(m[a][a])) AS v FROM d{j})",
            f"e{j} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lam FROM w{j}, g{j})",
            f"g{j + 1} AS (SELECT list_transform({at}, lambda i: list_transform({at}, lambda l: m[i][l] - lam * v[i] * v[l])) AS m FROM g{j}, e{j})",
        ]
    return out


_ITEMS_OF = "us AS (SELECT u, list(item ORDER BY item) AS items, list(b ORDER BY item) AS bs, sum(s)::DOUBLE AS total FROM g JOIN bt USING (item) GROUP BY u)"
_SIGNED = f"v AS (SELECT rid, {_K} AS k, CASE WHEN f THEN 0.5 ELSE -0.5 END::DOUBLE AS v FROM x)"
_CELLS = "cell AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.rid = b.rid GROUP BY 1, 2)"
_LEVEL_SUM = "list_sum(list_transform(bs, lambda b: (exp(x - b[1]) + 2 * exp(2 * x - b[2]) + 3 * exp(3 * x - b[3])) / (1 + exp(x - b[1]) + exp(2 * x - b[2]) + exp(3 * x - b[3]))))"
SQL |= {
    "rasch_joint": _with(
        _BINARY, _RASCH, _RATES, _STEPS, "z AS (SELECT item, ln(pi / d) AS u FROM it JOIN rs ON item = src WHERE step = 400)", "bt AS (SELECT item, u - avg(u) OVER () AS b FROM z)",
        _ITEMS_OF, *_bisect("list_sum(list_transform(bs, lambda b: 1 / (1 + exp(b - x))))"), recursive=True,
    ) + f"SELECT u AS user_id, {_r('theta', 3)} AS theta FROM th",
    "pcm_abilities": _with(
        _GRADED, _B, "rn AS (SELECT item, level, sum(beta) OVER (PARTITION BY item ORDER BY level) AS run FROM bb)", "bt AS (SELECT item, list(run ORDER BY level) AS b FROM rn GROUP BY 1)", _ITEMS_OF, *_bisect(_LEVEL_SUM), recursive=True
    ) + f"SELECT u AS user_id, {_r('theta', 4)} AS theta FROM th",
    "leading_directions": _with(_ORDERS, _PAIRS, _EMB, _SIGNED, _CELLS, *_directions(2, 10), "e AS (SELECT 0 AS direction, v, lam FROM e0 UNION ALL SELECT 1, v, lam FROM e1)", recursive=True)
    + f"SELECT direction, unnest(range(0, 10))::INTEGER AS k, {_r('sqrt(lam)', 3)} AS s, {_r('unnest(v)', 4)} AS loading FROM e",
    "projected_rankings": _with(_ORDERS, _PAIRS, _EMB, _SIGNED, _CELLS, *_directions(1, 10), recursive=True) + f"SELECT rid AS ranking_id, {_r('sum(b.v * e0.v[k + 1])', 4)} AS z FROM v b, e0 GROUP BY 1",
    "heuristic_pair_weight": _with(
        _EVENTS, _PAIRS, _EMB, _SIGNED, "n AS (SELECT count(DISTINCT rid)::DOUBLE AS n FROM r)", "mu AS (SELECT k, sum(v) / n AS mu FROM v, n GROUP BY k, n)",
        "cell AS (SELECT i, j, s / n - a.mu * b.mu AS s FROM (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.rid = b.rid GROUP BY 1, 2), n, mu a, mu b WHERE a.k = i AND b.k = j)", *_directions(1, 10), recursive=True,
    ) + f"SELECT unnest(range(0, 10))::INTEGER AS k, {_r('abs(unnest(v)) / list_max(list_transform(v, lambda y: abs(y)))', 4)} AS w FROM e0",
    "split_members": _with(_BINARY, f"h AS (SELECT u, item, row_number() OVER (PARTITION BY item ORDER BY {_key(3, 'u', 'item')}, u) AS rk, count(*) OVER (PARTITION BY item) AS n FROM g)")
    + "SELECT u AS user_id, item::INTEGER AS item_id, CASE WHEN rk <= floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM h",
    "split_user_members": _with(_BINARY, f"h AS (SELECT u, row_number() OVER (ORDER BY {_key(5, 'u')}, u) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT u FROM g))")
    + "SELECT u AS user_id, 'train' AS split FROM h WHERE rk <= floor(n * 0.7::DOUBLE) UNION ALL SELECT u, 'test' FROM h WHERE rk > n - floor(n * 0.2::DOUBLE)",
    "auc_prices": "WITH w AS (SELECT l_extendedprice::DOUBLE AS p, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1), x AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w)\n"
    + f"SELECT {_r('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg))')} AS auc FROM x",
    "brand_components": """WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
 ed AS (SELECT DISTINCT x.b AS s, y.b AS d FROM m x JOIN m y ON x.o = y.o AND x.b <> y.b), re(s, d) AS (SELECT s, s FROM ed UNION SELECT re.s, ed.d FROM re JOIN ed ON re.d = ed.s)
SELECT s AS node, min(d) AS root FROM re GROUP BY 1""",
}

#: strengths, tails and stages of each ranking and component, for one step from the fixed mixture
_TAILS = """t AS (SELECT r.rid, r.pos, r.item, uu.component, max(pos) OVER (PARTITION BY rid, component) AS last, sum(exp(u)) OVER (PARTITION BY rid, component ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM r JOIN uu ON r.item = uu.item),
 st AS (SELECT *, sum(CASE WHEN pos < last THEN 1 / tail ELSE 0 END) OVER (PARTITION BY rid, component ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stay FROM t)"""
_MM = "mm AS (SELECT st.component, st.item, sum(CASE WHEN pos < last THEN q ELSE 0 END) AS wins, sum(CASE WHEN last > 0 THEN q * stay ELSE 0 END) AS denom FROM st JOIN q ON st.rid = q.rid AND st.component = q.component GROUP BY 1, 2)"
_SHARE = "sh AS (SELECT component, avg(q) AS a, sum(q) AS total, count(*) AS m FROM q GROUP BY 1), lk AS (SELECT avg(lse) AS loglik FROM q WHERE component = 0)"
_HARD = "qs AS (SELECT rid, component, CASE WHEN row_number() OVER (PARTITION BY rid ORDER BY q DESC, component) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS q, lse FROM q)"
#: the composite likelihood of a ranking's pairs in place of the Plackett-Luce one
_COMPOSITE = """ll AS (SELECT r.rid, k.component, coalesce(x.ll, 0) AS loglik FROM (SELECT DISTINCT rid FROM r) r CROSS JOIN (SELECT DISTINCT component FROM uu) k
 LEFT JOIN (SELECT rid, a.component, sum(-ln(1 + exp(b.u - a.u))) AS ll FROM c JOIN uu a ON a.item = c.winner JOIN uu b ON b.item = c.loser AND a.component = b.component GROUP BY 1, 2) x ON x.rid = r.rid AND x.component = k.component),
 z AS (SELECT ll.*, a, exp(loglik) * a AS e FROM ll JOIN aa ON ll.component = aa.component),
 q AS (SELECT rid, component, e / sum(e) OVER (PARTITION BY rid) AS q, ln(sum(e) OVER (PARTITION BY rid)) AS lse FROM z)"""
_WEIGHTS = "pw AS (SELECT component, loser, winner, sum(q) AS weight FROM c JOIN q ON c.rid = q.rid GROUP BY 1, 2, 3)"
#: a matrix [winner][loser] of each component's pair weights, as shares of their sum
_MATRIX = """wm AS (SELECT component, list(row ORDER BY i) AS m FROM (SELECT component, i, list(w ORDER BY j) AS row FROM (
   SELECT k.component, x.i, y.j, coalesce(weight, 0) / tot AS w FROM (SELECT component, sum(weight) AS tot FROM pw GROUP BY 1) k CROSS JOIN range(0, 5) x(i) CROSS JOIN range(0, 5) y(j) LEFT JOIN pw ON pw.component = k.component AND winner = i AND loser = j)
  GROUP BY 1, 2) GROUP BY 1)"""


def _step_of(x: str, a: str = "a") -> str:
    return f"SELECT n.component, n.item AS item_id, {_r(f'{x} - avg({x}) OVER (PARTITION BY n.component)', 5)} AS u, {_r(a)} AS a, {_r('loglik')} AS loglik FROM "


def _descent(slope: str, rate: float, steps: int, pinned: bool = False) -> list[str]:
    """Gradient steps from zero for each component: ``slope`` of item i at utilities u under the matrix m."""
    moved = f"list_transform(range(1, 6), lambda i: {'CASE WHEN i = 1 THEN 0.0 ELSE ' if pinned else ''}u[i] - {rate} * ({slope}){' END' if pinned else ''})"
    kept = "y" if pinned else "list_transform(y, lambda v: v - list_avg(y))"
    return [
        f"gd(step, component, m, u) AS (SELECT 0, component, m, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] FROM wm UNION ALL SELECT step + 1, component, m, {kept} FROM (SELECT *, {moved} AS y FROM gd WHERE step < {steps}))",
        f"fit AS (SELECT component, unnest(range(0, 5))::INTEGER AS item, unnest(u) - list_avg(u) AS x FROM gd WHERE step = {steps})",
    ]


def _likelihood_slope(lam: float) -> str:
    return f"{2 * lam} * u[i] - list_sum(list_transform(range(1, 6), lambda j: m[i][j] / (1 + exp(u[i] - u[j])) - m[j][i] / (1 + exp(u[j] - u[i]))))"


_MOMENT_SLOPE = """0.01 * u[i] + 2 * list_sum(list_transform(range(1, 6), lambda j: CASE WHEN m[i][j] + m[j][i] = 0 THEN 0.0 ELSE
 (m[j][i] / (1 + exp(u[j] - u[i])) - m[i][j] / (1 + exp(u[i] - u[j]))) / (m[i][j] + m[j][i]) / (1 + exp(u[i] - u[j])) / (1 + exp(u[j] - u[i])) END))"""


def _damped(damp: float) -> str:
    u = f"{1 - damp} * uu.u + {damp} * x" if damp < 1 else "x"
    a = f"{1 - damp} * aa.a + {damp} * sh.a" if damp < 1 else "sh.a"
    return f"SELECT fit.component, fit.item AS item_id, {_r(u, 3)} AS u, {_r(a)} AS a, {_r('loglik')} AS loglik FROM fit JOIN uu ON uu.component = fit.component AND uu.item = fit.item JOIN aa ON aa.component = fit.component JOIN sh ON sh.component = fit.component, lk"


_LUCE = """pi0 AS (SELECT component, sum(exp(u)) AS scale FROM uu GROUP BY 1),
 rt AS (SELECT b.component, b.item AS src, a.item AS dst, sum(q.q * scale / a.tail) AS p FROM t a JOIN t b ON a.rid = b.rid AND a.component = b.component AND a.pos < b.pos JOIN qq q ON q.rid = a.rid AND q.component = a.component JOIN pi0 ON pi0.component = a.component GROUP BY 1, 2, 3),
 rp AS (SELECT component, src, dst, sum(p) + CASE WHEN sum(p) = 0 THEN 1.0 ELSE 0.0 END AS p FROM (SELECT * FROM rt WHERE p > 0 UNION ALL SELECT component, dst, src, 0.0 FROM rt WHERE p > 0) GROUP BY 1, 2, 3),
 rs AS (SELECT component, src, sum(p) AS row FROM rp GROUP BY 1, 2), dd AS (SELECT component, max(row) AS d FROM rs GROUP BY 1),
 ch AS (SELECT rp.component, src, dst, p / d AS p FROM rp JOIN dd USING (component) UNION ALL SELECT rs.component, src, src, 1 - row / d FROM rs JOIN dd USING (component)),
 it(step, component, item, pi) AS (SELECT 0, component, src, 1.0::DOUBLE / 5 FROM rs UNION ALL SELECT step + 1, ch.component, dst, sum(pi * p) FROM it JOIN ch ON it.item = ch.src AND it.component = ch.component WHERE step < 400 GROUP BY step, ch.component, dst),
 n AS (SELECT component, item, ln(pi) AS x FROM it WHERE step = 400)"""
_FIXED = (_ORDERS, _U, _A, _LL)
SQL |= {
    "emm_step": _with(*_FIXED, _TAILS, _MM, _SHARE) + _step_of("(ln(wins + 1e-8) - ln(denom + 1e-8))") + "mm n JOIN sh ON sh.component = n.component, lk",
    "bayes_map_step": _with(*_FIXED, _TAILS, _MM, _SHARE) + _step_of("(ln(1 + wins) - ln(1 + denom))", "(2 + total) / (4 + m)") + "mm n JOIN sh ON sh.component = n.component, lk",
    "pl_spectral_em_step": _with(*_FIXED, _TAILS, "qq AS (SELECT * FROM q)", _SHARE, _LUCE, recursive=True) + _step_of("x") + "n JOIN sh ON sh.component = n.component, lk",
    "pl_spectral_em_hard_step": _with(*_FIXED, _TAILS, _HARD, "qq AS (SELECT * FROM qs)", _SHARE.replace("FROM q ", "FROM qs "), _LUCE, recursive=True) + _step_of("x") + "n JOIN sh ON sh.component = n.component, lk",
    "em_gmm_step": _with(*_FIXED, _PAIRS, _WEIGHTS, _MATRIX, _SHARE, *_descent(_MOMENT_SLOPE, 1.0, 3000), recursive=True) + _damped(1.0),
    "em_cml_step": _with(*_FIXED, _PAIRS, _WEIGHTS, _MATRIX, _SHARE, *_descent(_likelihood_slope(0.01), 2.0, 2000), recursive=True) + _damped(1.0),
    "composite_em_step": _with(_ORDERS, _U, _A, _PAIRS, _COMPOSITE, _WEIGHTS, _MATRIX, _SHARE, *_descent(_likelihood_slope(0.01), 2.0, 2000), recursive=True) + _damped(0.1),
    "composite_em_pinned_step": _with(*_FIXED, _PAIRS, _WEIGHTS, _MATRIX, _SHARE, *_descent(_likelihood_slope(0.01), 2.0, 4000, True), recursive=True) + _damped(1.0),
    "composite_posterior": _with(_ORDERS, _U, _A, _PAIRS, _COMPOSITE) + f"SELECT rid AS ranking_id, component, {_r('q')} AS q, {_r('lse')} AS lse FROM q",
    "posterior_pair_weights": _with(*_FIXED, _PAIRS, _WEIGHTS) + f"SELECT component, loser, winner, {_r('weight', 5)} AS weight FROM pw",
    "pinned_slopes": _with(
        _ORDERS, _PAIRS, _COUNTS, _U, "v AS (SELECT item, u - first_value(u) OVER (ORDER BY item) AS v FROM uu WHERE component = 0)",
        "s AS (SELECT winner, loser, cnt / (1 + exp(a.v - b.v)) AS g, cnt / (1 + exp(a.v - b.v)) / (1 + exp(b.v - a.v)) AS h FROM n JOIN v a ON a.item = winner JOIN v b ON b.item = loser)",
        "e AS (SELECT winner AS i, 0 AS j, -g AS x FROM s UNION ALL SELECT loser, 0, g FROM s UNION ALL SELECT item, 0, v FROM v UNION ALL SELECT winner, winner, h FROM s UNION ALL SELECT loser, loser, h FROM s UNION ALL SELECT winner, loser, -h FROM s WHERE winner > 0 AND loser > 0 UNION ALL SELECT loser, winner, -h FROM s WHERE winner > 0 AND loser > 0 UNION ALL SELECT item, item, 1.0 FROM v)",
    ) + f"SELECT i, j, {_r('sum(x)', 4)} AS value FROM e WHERE i > 0 GROUP BY 1, 2",
    "pinned_estimate": _with(_ORDERS, _PAIRS, "pw AS (SELECT 0 AS component, loser, winner, count(*)::DOUBLE AS weight FROM c GROUP BY 2, 3)", _MATRIX, *_descent(_likelihood_slope(0.0), 2.0, 3000, True), recursive=True)
    + f"SELECT item AS item_id, {_r('x', 4)} AS u FROM fit",
}

_TWO = "b2(component, item, b) AS (VALUES " + ", ".join(f"({c}, {i}, {[float(x) for x in row.cumsum()]}::DOUBLE[])" for c, m in enumerate(TWO) for i, row in enumerate(m)) + ")"
_CLASSES = [
    _GRADED, _TWO, "us AS (SELECT component * 100000000 + u AS u, list(item * 10 + component ORDER BY item) AS items, list(b ORDER BY item) AS bs, sum(s)::DOUBLE AS total FROM g JOIN b2 USING (item) GROUP BY u, component)", *_bisect(_LEVEL_SUM),
    "ab AS (SELECT u % 100000000 AS u, u // 100000000 AS component, theta FROM th)",
    "lc AS (SELECT g.u, b2.component, theta, sum(CASE s WHEN 0 THEN 0 ELSE s * theta - b[s] END - ln(1 + exp(theta - b[1]) + exp(2 * theta - b[2]) + exp(3 * theta - b[3]))) - theta * theta / 2 - ln(sqrt(2 * pi())) AS z FROM g JOIN b2 USING (item) JOIN ab ON ab.u = g.u AND ab.component = b2.component GROUP BY 1, 2, 3)",
    "qc AS (SELECT u, component, theta, exp(z) / sum(exp(z)) OVER (PARTITION BY u) AS q, ln(sum(exp(z)) OVER (PARTITION BY u)) AS lse FROM lc)",
]
#: spectral partial-credit difficulties: a chain a level, then the shift of each level against the first
_LEVELS = [
    _GRADED, "y AS (SELECT a.s AS k, b.s AS l, a.item AS i, b.item AS j, count(*)::DOUBLE AS n FROM g a JOIN g b ON a.u = b.u AND a.item <> b.item WHERE a.s = b.s + 1 OR a.s <= 1 GROUP BY 1, 2, 3, 4)",
    "mk AS (SELECT k, i AS src, j AS dst, sum(n) + 0.1 AS p FROM (SELECT k, i, j, n FROM y WHERE l = k - 1 UNION ALL SELECT k, j, i, 0 FROM y WHERE l = k - 1) GROUP BY 1, 2, 3)",
    "rs AS (SELECT k, src, sum(p) AS row, greatest(sum(p), 1.0) AS d FROM mk GROUP BY 1, 2)",
    "ch AS (SELECT mk.k, mk.src, dst, p / d AS p FROM mk JOIN rs ON rs.k = mk.k AND rs.src = mk.src UNION ALL SELECT k, src, src, 1 - row / d FROM rs)",
    "it(step, k, item, pi) AS (SELECT 0, k, src, 1.0::DOUBLE / 5 FROM rs UNION ALL SELECT step + 1, ch.k, dst, sum(pi * p) FROM it JOIN ch ON it.item = ch.src AND it.k = ch.k WHERE step < 600 GROUP BY step, ch.k, dst)",
    "b0 AS (SELECT it.k, item, ln(pi / d) - avg(ln(pi / d)) OVER (PARTITION BY it.k) AS b FROM it JOIN rs ON rs.k = it.k AND rs.src = item WHERE step = 600)",
    "up AS (SELECT l + 1 AS k, sum(exp(b) * n) AS x FROM y JOIN b0 ON b0.k = 1 AND b0.item = i WHERE y.k = 1 GROUP BY 1)",
    "dn AS (SELECT l AS k, sum(exp(b) * n) AS x FROM y JOIN b0 ON b0.k = l AND b0.item = j WHERE y.k = 0 GROUP BY 1)",
]
SQL |= {
    "pcm_memberships": _with(*_CLASSES, recursive=True) + f"SELECT u AS user_id, component::INTEGER AS component, {_r('theta', 4)} AS theta, {_r('q', 4)} AS q, {_r('lse', 4)} AS lse FROM qc",
    "pcm_mixture_sums": _with(
        *_CLASSES, "ct AS (SELECT component, item, s, sum(q) AS weight FROM qc JOIN g USING (u) GROUP BY 1, 2, 3)",
        "nx AS (SELECT component, a.item, b.s, sum(q * q) AS next FROM qc JOIN g a ON a.u = qc.u AND a.s = 1 JOIN g b ON b.u = qc.u AND b.item = (a.item + 1) % 5 GROUP BY 1, 2, 3)",
        "al AS (SELECT c.c AS component, i.i AS item, k.k AS s FROM range(0, 2) c(c) CROSS JOIN range(0, 5) i(i) CROSS JOIN range(0, 4) k(k))", recursive=True,
    ) + f"SELECT component::INTEGER AS component, item::INTEGER AS item_id, s::INTEGER AS level, {_r('coalesce(weight, 0)', 3)} AS weight, {_r('coalesce(next, 0)', 3)} AS next FROM al LEFT JOIN ct USING (component, item, s) LEFT JOIN nx USING (component, item, s)",
    "pcm_beta": _with(*_LEVELS, recursive=True) + f"SELECT item::INTEGER AS item_id, b0.k::INTEGER AS level, {_r('b + CASE WHEN b0.k > 1 THEN ln(up.x / dn.x) ELSE 0 END', 4)} AS beta FROM b0 LEFT JOIN up ON up.k = b0.k LEFT JOIN dn ON dn.k = b0.k",
}


def _uni(seed: int, *columns: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {" || ':' || ".join(columns)}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def _gumbel(seed: int, *columns: str) -> str:
    return f"(-ln(-ln({_uni(seed, *columns)})))"


def _gauss(seed: int, *columns: str) -> str:
    one, two = _uni(seed, *columns, "'1'"), _uni(seed, *columns, "'2'")
    return f"(sqrt(-2 * ln({one})) * cos(2 * pi() * {two}))"


def _placed(key: str = "rid") -> str:
    return f"row_number() OVER (PARTITION BY {key} ORDER BY x DESC, item) - 1"


#: utilities as mean places, of event types and of order priorities
_MEASURED = (_EVENTS, _ORDERS.replace(" r AS", " r2 AS"), "mu AS (SELECT 0 AS component, item, -avg(pos) AS u FROM r GROUP BY item UNION ALL SELECT 1, item, -avg(pos) FROM r2 GROUP BY item)")
_WEEKS = "wk AS (SELECT (day(ts) - 1) // 7 AS t, dense_rank() OVER (ORDER BY event_type) - 1 AS item FROM events), tu AS (SELECT t, item, ln(count(*)::DOUBLE) AS u FROM wk GROUP BY 1, 2)"
_ABLE = "th AS (SELECT c_custkey AS u, (c_custkey % 7 - 3) / 2.0::DOUBLE AS theta FROM customer)"
_PRICED = "h AS (SELECT o_orderkey, x, 0.5 + atan(x) / 4 AS q FROM (SELECT o_orderkey, least(o_totalprice::DOUBLE / 100000 - 2, 2.9::DOUBLE) AS x FROM orders))"


def _link(cdf: str, pdf: str, quantile: str) -> str:
    return _with(_PRICED) + f"SELECT o_orderkey, x, {_r(cdf)} AS cdf, {_r(pdf)} AS pdf, {_r(quantile)} AS quantile FROM h"


_OUT = "SELECT rid AS ranking_id, pos::INTEGER AS pos, item::INTEGER AS item_id"
SQL |= {
    "link_logistic": _link("1 / (1 + exp(-x / 1.5))", "1 / (1 + exp(-x / 1.5)) * (1 - 1 / (1 + exp(-x / 1.5))) / 1.5", "1.5 * ln(q / (1 - q))"),
    "link_laplace": _link("CASE WHEN x < 0 THEN 0.5 * exp(-abs(x) / 1.5) ELSE 1 - 0.5 * exp(-abs(x) / 1.5) END", "exp(-abs(x) / 1.5) / 3", "CASE WHEN q < 0.5 THEN 1.5 * ln(2 * q) ELSE -1.5 * ln(2 * (1 - q)) END"),
    "link_extreme_value": _link("exp(-pow(1 - 0.5 * x / 1.5, 2))", "(1 - 0.5 * x / 1.5) * exp(-pow(1 - 0.5 * x / 1.5, 2)) / 1.5", "1.5 * (1 - pow(-ln(q), 0.5)) / 0.5"),
    "ell2": _with(*_MEASURED, "j AS (SELECT a.u - b.u AS d FROM mu a JOIN mu b ON a.item = b.item WHERE a.component = 0 AND b.component = 1)") + f"SELECT {_r('sqrt(sum(d * d) - sum(d) * sum(d) / count(*))')} AS ell2 FROM j",
    "ell2_mixture": _with(
        *_MEASURED, "a AS (SELECT component, item, u - avg(u) OVER (PARTITION BY component) AS u FROM mu)",
        "b AS (SELECT 1 - component AS component, item, u + item / 10.0::DOUBLE AS u FROM mu)", "c AS (SELECT component, item, u - avg(u) OVER (PARTITION BY component) AS u FROM b)",
        "d AS (SELECT a.component AS i, c.component AS j, sum((a.u - c.u) * (a.u - c.u)) AS s FROM a JOIN c ON a.item = c.item GROUP BY 1, 2)",
    ) + f"SELECT {_r('sqrt(least(sum(CASE WHEN i = j THEN s ELSE 0 END), sum(CASE WHEN i <> j THEN s ELSE 0 END)))')} AS ell2 FROM d",
    "centred_utilities": _with(*_MEASURED, "v AS (SELECT component, item, u + component + item / 10.0::DOUBLE AS u FROM mu)") + f"SELECT component, item AS item_id, {_r('u - avg(u) OVER (PARTITION BY component)')} AS u FROM v",
    "normalised_alpha": f"SELECT ascii(o_orderstatus)::INTEGER AS component, {_r('count(*) / sum(count(*)) OVER ()')} AS a FROM orders GROUP BY 1",
    "frobenius_difference": _with(
        _GRADED, "n AS (SELECT u % 2 AS c, item, k.k AS level, count(*) FILTER (s = k.k - 1) AS a, count(*) FILTER (s = k.k) AS b FROM g CROSS JOIN range(1, 4) k(k) GROUP BY 1, 2, 3)", "v AS (SELECT c, item, level, ln((a + 1) / (b + 1)::DOUBLE) AS v FROM n)",
        "d AS (SELECT x.c AS i, 1 - y.c AS j, sum((x.v - y.v - 0.1) * (x.v - y.v - 0.1)) AS s FROM v x JOIN v y ON x.item = y.item AND x.level = y.level GROUP BY 1, 2)",
    ) + f"SELECT {_r('least(sum(CASE WHEN i = j THEN s ELSE 0 END), sum(CASE WHEN i <> j THEN s ELSE 0 END))')} AS difference FROM d",
    "mean_pairwise_link": _with(*_MEASURED, "x AS (SELECT a.item AS i, b.item AS j, a.u - b.u AS d FROM mu a JOIN mu b ON a.item < b.item WHERE a.component = 0 AND b.component = 0)")
    + f"SELECT {_K} AS k, {_r('1 / (1 + exp(-d)) / 2 - 1 / (1 + exp(d)) / 2')} AS x FROM x",
    "marginal_response": _with(
        _BINARY, "be AS (SELECT item, ln((count(*) - sum(s) + 1) / (sum(s) + 1)::DOUBLE) AS beta FROM g GROUP BY 1)", "k AS (SELECT i, -10 + i * 0.05::DOUBLE AS x, CASE WHEN i IN (0, 400) THEN 0.5 ELSE 1.0 END AS w FROM range(0, 401) t(i))"
    ) + f"SELECT item AS item_id, {_r('least(1.0, 0.05 * sum(w * exp(-0.5 * x * x) / sqrt(2 * pi()) / (1 + exp(beta - x))))')} AS p FROM be, k GROUP BY 1",
    "privacy_budgets": _with(
        "n AS (SELECT count(*)::DOUBLE AS m FROM customer)",
        """bi(step, m, low, high) AS (SELECT 0, m, 0.0::DOUBLE, greatest(ln(1000 * m / (16 * ln(2e6))), 0) FROM n UNION ALL SELECT step + 1, m, CASE WHEN f <= 1 THEN x ELSE low END, CASE WHEN f <= 1 THEN high ELSE x END
 FROM (SELECT *, ln(1 + (exp(x) - 1) / (exp(x) + 1) * (8 * sqrt(exp(x) * ln(4e6) / (1000 * m)) + 8 * exp(x) / (1000 * m))) AS f FROM (SELECT *, (low + high) / 2 AS x FROM bi WHERE step < 60)))""", recursive=True,
    ) + f"SELECT 'gauss' AS mechanism, {_r('1 / sqrt(2 * ln(m * m))')} AS epsilon FROM n UNION ALL SELECT 'shuffle', {_r('(low + high) / 2')} FROM bi WHERE step = 60",
    "random_pairs": _with("n AS (SELECT count(DISTINCT p_brand) AS n FROM part)", f"e AS (SELECT i, j FROM (SELECT x.i, y.j FROM n, range(0, 100) x(i), range(0, 100) y(j) WHERE i < j AND j < n) WHERE {_uni(1, 'i', 'j')} < 0.3::DOUBLE)")
    + "SELECT i, j FROM e UNION ALL SELECT j, i FROM e",
    "generated_rankings": _with(
        *_MEASURED, f"x AS (SELECT c_custkey AS rid, item, u + {_gumbel(0, 'c_custkey', 'item')} AS x FROM customer, mu WHERE component = 0)", f"y AS (SELECT rid, item, {_placed()} AS pos FROM x)",
        f"z AS (SELECT rid, item, pos, count(*) OVER (PARTITION BY rid) AS n FROM y WHERE {_uni(1, 'rid', 'pos')} < 0.7::DOUBLE)", "w AS (SELECT rid, item, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS pos FROM z WHERE n > 1)",
    ) + f"{_OUT} FROM w",
    "generated_exponential_rankings": _with(
        *_MEASURED, f"x AS (SELECT c_custkey AS rid, item, u + CASE item WHEN 1 THEN 0.7 * {_gauss(4, 'c_custkey', 'item')} ELSE -ln(1 - {_uni(4, 'c_custkey', 'item')}) END AS x FROM customer, mu WHERE component = 1)", f"w AS (SELECT rid, item, {_placed()} AS pos FROM x)",
    ) + f"{_OUT} FROM w",
    "generated_mixture": _with(
        _U, f"k AS (SELECT c_custkey AS rid, CASE WHEN {_uni(7, 'c_custkey')} < 0.6::DOUBLE THEN 0 ELSE 1 END AS component FROM customer)",
        f"x AS (SELECT rid, k.component, item, u + {_gumbel(0, 'rid', 'item')} AS x FROM k JOIN uu ON uu.component = k.component)", f"w AS (SELECT rid, component, item, {_placed()} AS pos FROM x)",
    ) + f"{_OUT}, component::INTEGER AS component FROM w",
    "generated_responses": _with(
        _B, _ABLE, "cs AS (SELECT item, level, sum(beta) OVER (PARTITION BY item ORDER BY level) AS run FROM bb UNION ALL SELECT DISTINCT item, 0, 0.0 FROM bb)",
        "e AS (SELECT u, item, level, exp(level * theta - run) AS e FROM th, cs)", "p AS (SELECT u, item, level, sum(e) OVER (PARTITION BY u, item ORDER BY level) / sum(e) OVER (PARTITION BY u, item) AS run FROM e)",
    ) + f"SELECT u AS user_id, item::INTEGER AS item_id, least(3, count(*) FILTER (run <= {_uni(0, 'u', 'item')}))::INTEGER AS score FROM p GROUP BY 1, 2",
    "generated_binary": _with(_B, _ABLE) + f"SELECT u AS user_id, item::INTEGER AS item_id, CASE WHEN {_uni(1, 'u', 'item')} < 1 / (1 + exp(beta - theta)) THEN 1 ELSE 0 END::INTEGER AS score FROM th, bb WHERE level = 1 AND {_uni(0, 'u', 'item')} < 0.8::DOUBLE",
    "generated_comparisons": _with(
        _EVENTS, _PAIRS, _COUNTS, _BOTH, f"x AS (SELECT winner AS i, loser AS j, CASE WHEN {_uni(0, 'winner', 'loser', 'k.k')} < (w + 1) / (w + l + 2)::DOUBLE THEN 1 ELSE 0 END AS won FROM b CROSS JOIN range(0, 100) k(k) WHERE winner < loser)"
    ) + "SELECT CASE won WHEN 1 THEN i ELSE j END::INTEGER AS winner, CASE won WHEN 1 THEN j ELSE i END::INTEGER AS loser, count(*)::DOUBLE AS weight FROM x GROUP BY 1, 2",
    "timed_utilities": _with(
        "wk AS (SELECT count(DISTINCT (day(ts) - 1) // 7) AS steps, count(DISTINCT event_type) AS n FROM events)",
        f"i AS (SELECT i.i AS item, {_gauss(2, chr(39) + 'f' + chr(39), 'i.i')} AS f, {_gauss(2, chr(39) + 'b' + chr(39), 'i.i')} AS b, steps FROM wk, range(0, 100) i(i) WHERE i.i < n)",
    ) + f"SELECT t.t::INTEGER AS t, item::INTEGER AS item_id, {_r('sin(t.t * f) + b')} AS u FROM i, range(0, 100) t(t) WHERE t.t < steps",
    "timed_rankings": _with(_WEEKS, f"x AS (SELECT t, t * 20 + k.k AS rid, item, u + {_gumbel(0, '(t * 20 + k.k)', 'item')} AS x FROM tu, range(0, 20) k(k))", f"w AS (SELECT t, rid, item, {_placed()} AS pos FROM x)") + f"{_OUT}, t::INTEGER AS t FROM w",
    "timed_partial_rankings": _with(
        _WEEKS, "d AS (SELECT t, item, u, ('0x' || substr(md5('0:' || t || ':0:' || k.k), 1, 15))::BIGINT AS rid FROM tu, range(0, 20) k(k) WHERE item < 3)", f"x AS (SELECT t, rid, item, u + {_gumbel(0, 'rid', 'item')} AS x FROM d)", f"w AS (SELECT t, rid, item, {_placed()} AS pos FROM x)",
    ) + f"{_OUT}, t::INTEGER AS t, 0 AS menu_id FROM w",
    "timed_comparisons": _with(
        _WEEKS, f"e AS (SELECT a.t, a.item AS i, b.item AS j, a.u AS ui, b.u AS uj, k.k AS k FROM tu a JOIN tu b ON a.t = b.t AND a.item < b.item, range(0, 10) k(k) WHERE {_uni(0, 'a.t', 'a.item', 'b.item')} < 0.5::DOUBLE)",
        f"x AS (SELECT t, i, j, ui + {_gumbel(1, 't', 'i', 'j', 'k', chr(39) + '1' + chr(39))} > uj + {_gumbel(1, 't', 'i', 'j', 'k', chr(39) + '2' + chr(39))} AS won FROM e)",
    ) + "SELECT t::INTEGER AS t, CASE WHEN won THEN i ELSE j END::INTEGER AS winner, CASE WHEN won THEN j ELSE i END::INTEGER AS loser FROM x",
    "menu_rankings": _with(
        *_MEASURED, "sz AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS menu FROM (SELECT DISTINCT count(*) AS n FROM r2 GROUP BY rid) WHERE n > 1)",
        f"mi AS (SELECT menu, i.i AS item FROM sz, range(0, 5) i(i) QUALIFY row_number() OVER (PARTITION BY menu ORDER BY {_uni(1, 'menu', 'i.i')}) <= n)", "me AS (SELECT min(menu) AS menu, a FROM (SELECT menu, list(item ORDER BY item) AS a FROM mi GROUP BY menu) GROUP BY a)",
        f"x AS (SELECT menu, menu * 50 + k.k AS rid, mu.item, u + {_gauss(0, '(menu * 50 + k.k)', 'mu.item')} AS x FROM (SELECT menu, unnest(a) AS item FROM me) m JOIN mu ON mu.item = m.item AND component = 1, range(0, 50) k(k))", f"w AS (SELECT menu, rid, item, {_placed()} AS pos FROM x)",
    ) + f"{_OUT}, menu AS menu_id FROM w",
}

_E10 = (_ORDERS, _PAIRS, _EMB, _SIGNED, _CELLS)
SQL |= {
    "rank_centrality_pairs": _with(_ORDERS, _PAIRS, _COUNTS, _BOTH, _CHAIN, _STEPS, recursive=True) + f"SELECT item AS item_id, {_r('ln(pi) - avg(ln(pi)) OVER ()', 4)} AS u FROM it WHERE step = 400",
    "pcm_chain": _with(*_LEVELS[:5]) + f"SELECT src, dst, {_r('p')} AS p FROM ch WHERE k = 1",
    "brand_type_grid": "SELECT * FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT DISTINCT event_type FROM events)",
    "low_rank_reconstruction": _with(*_E10, *_directions(2, 10), "z AS (SELECT rid, sum(b.v * e0.v[k + 1]) AS a, sum(b.v * e1.v[k + 1]) AS b FROM v b, e0, e1 GROUP BY 1)", recursive=True)
    + f"SELECT rid AS ranking_id, k.k::INTEGER AS k, {_r('a * e0.v[k.k + 1] + b * e1.v[k.k + 1]', 4)} AS x FROM z, e0, e1, range(0, 10) k(k)",
    "soft_threshold_reconstruction": _with(
        *_E10, *_directions(10, 10), "n AS (SELECT sqrt(count(DISTINCT rid)::DOUBLE) / 2 AS lam FROM r)",
        "e AS (" + " UNION ALL ".join(f"SELECT v, sqrt(greatest(e{j}.lam, 0)) AS s FROM e{j}" for j in range(10)) + ")", "f AS (SELECT v, greatest(s - n.lam, 0) / s AS w FROM e, n WHERE s > n.lam)",
        "z AS (SELECT rid, f.v AS d, w * sum(b.v * f.v[k + 1]) AS a FROM v b, f GROUP BY rid, f.v, w)", recursive=True,
    ) + f"SELECT rid AS ranking_id, k.k::INTEGER AS k, {_r('sum(a * d[k.k + 1])', 4)} AS x FROM z, range(0, 10) k(k) GROUP BY 1, 2",
    "pl_mixture_loglik_normalised": _with(_ORDERS, _U, _A, _LL) + f"SELECT {_r('avg(lse)')} AS loglik FROM q WHERE component = 0",
    "running_pairwise_counts": _with(_EVENTS, _PAIRS, _COUNTS) + "SELECT winner, loser, cnt FROM n",
}

#: rankings cut into pairs at random: by hash within each, neighbours of that order meet
_RANDOM = f"""h AS (SELECT rid, pos, item, row_number() OVER (PARTITION BY rid ORDER BY {_key(0, 'rid', 'item')}, pos, item) - 1 AS place, count(*) OVER (PARTITION BY rid) AS n FROM r),
 c AS (SELECT rid, arg_min(item, pos) AS winner, arg_max(item, pos) AS loser FROM h WHERE place // 2 < n // 2 GROUP BY rid, place // 2)"""
SQL |= {
    "rank_break_random": _with(_ORDERS, _RANDOM) + "SELECT rid AS ranking_id, winner, loser FROM c",
    "randomized_response": _with(_BINARY, "n AS (SELECT u, count(*) AS n FROM g GROUP BY 1)")
    + f"SELECT u AS user_id, item::INTEGER AS item_id, CASE WHEN {_uni(0, 'u', 'item')} < 1 / (1 + exp(1.0::DOUBLE / n)) THEN 1 - s ELSE s END::INTEGER AS score FROM g JOIN n USING (u)",
    # minorise-maximise steps over rankings that are collapsed to lists
    "mm": _with(
        _ORDERS, "pt AS (SELECT items, count(*)::DOUBLE AS w FROM (SELECT list(item + 1 ORDER BY pos) AS items FROM r GROUP BY rid HAVING count(*) > 1) GROUP BY 1)",
        """it(step, u) AS (SELECT 0, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] UNION ALL
 SELECT step + 1, list_transform(y, lambda v: v - list_avg(y)) FROM (SELECT step, list(x ORDER BY item) AS y FROM (SELECT step, item, ln(sum(CASE WHEN place < n THEN w ELSE 0 END)) - ln(sum(w * list_sum(stay[1:least(place, n - 1)]))) AS x
  FROM (SELECT step, w, len(items) AS n, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS place, list_transform(range(1, len(items)), lambda i: 1 / list_sum(list_transform(items[i:], lambda j: exp(u[j])))) AS stay FROM it, pt WHERE step < 60)
  GROUP BY step, item) GROUP BY step))""", recursive=True,
    ) + f"SELECT unnest(range(0, 5))::INTEGER AS item_id, {_r('unnest(u)', 3)} AS u FROM it WHERE step = 60",
}

_ALL = "pw AS (SELECT 0 AS component, loser, winner, count(*)::DOUBLE AS weight FROM c GROUP BY 2, 3)"
_ONE_SIDED = "pw AS (SELECT 0 AS component, loser, winner, CASE WHEN w = 0 OR l = 0 THEN (w + 1) / (w + l + 2)::DOUBLE ELSE w / (w + l)::DOUBLE END AS weight FROM b)"
#: m[i][j] is the share of meetings of i and j that i wins, with one more win each; a cell of exactly one half drops out
_RIDGE = "0.1 * u[i] + 4 * list_sum(list_transform(range(1, 6), lambda j: CASE WHEN i = j OR m[i][j] = 0 OR m[i][j] = m[j][i] THEN 0.0 ELSE (u[i] - u[j]) - ln(m[i][j] / m[j][i]) END))"
_FITTED = f"SELECT item AS item_id, {_r('x', 3)} AS u FROM fit"
SQL |= {
    "gmm_logistic": _with(_ORDERS, _PAIRS, _ALL, _MATRIX, *_descent(_MOMENT_SLOPE.replace("0.01 *", "0.001 *", 1), 1.0, 4000), recursive=True) + _FITTED,
    "composite_logistic": _with(_ORDERS, _PAIRS, _COUNTS, _BOTH, _ONE_SIDED, _MATRIX, *_descent(_likelihood_slope(0.0001), 2.0, 4000), recursive=True) + _FITTED,
    "rum_lrmc_all_pairs": _with(
        _ORDERS, _PAIRS, _COUNTS, _BOTH, "pw AS (SELECT 0 AS component, loser, winner, (w + 1) / (w + l + 2)::DOUBLE AS weight FROM b)", _MATRIX, *_descent(_RIDGE, 0.02, 2000), recursive=True
    ) + _FITTED,
}
