"""Loops that resume, draws that are kept, passes against plain versions, order statistics that no task holds whole."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from prefloom.functions.links import ExtremeValue, GeneralNormal, Logistic, Normal
from prefloom.operators import draws, embeddings, estimators, graph, irt, metrics, mixtures, ordering, passes, reshape, response_passes
from prefloom.operators import rankings as R
from prefloom.plans import solvers
from prefloom.plans.state import Loop
from prefloom.sources import generators
from pyspark.sql import functions as F

U = solvers.centred(np.array([[2.5, 1.5, 0.0, -1.5, -2.5], [-2.5, -1.0, 0.5, 1.0, 2.0]]))


@pytest.fixture(scope="module")
def mixed(spark):
    return generators.mixture_rankings(U, np.array([0.6, 0.4]), spark, m=300, seed=2).select("ranking_id", "pos", "item_id").cache()


class Stopped(Exception):
    pass


def stopping(monkeypatch, module, name, after):
    """The function fails from its call number ``after`` on, as if the driver were lost there."""
    real, calls = getattr(module, name), [0]

    def f(*a, **b):
        calls[0] += 1
        if calls[0] > after:
            raise Stopped
        return real(*a, **b)

    monkeypatch.setattr(module, name, f)


# -- iteration state -----------------------------------------------------------------------------------------------------


def test_loop_keeps_resumes_and_forgets(spark, tmp_path):
    step = lambda k, s: ({"x": s["x"] * 0.5, "n": s["n"] + k}, {"change": float(np.abs(s["x"]).max()), "k": k})
    start = {"x": np.arange(6.0).reshape(2, 3), "n": np.array(0.0)}
    want = Loop(9, 0.1)
    out = want.run(start, step)
    for k in (1, 4):
        Loop(k, 0.1, spark, str(tmp_path / "a")).run(start, step)
    again = Loop(9, 0.1, spark, str(tmp_path / "a"))
    got = again.run(start, step)
    assert np.array_equal(got["x"], out["x"]) and got["n"] == out["n"] and again.history == want.history
    assert Loop(9, 0.1, spark, str(tmp_path / "a")).run(start, None)["n"] == out["n"]  # settled: nothing is run
    again.clear()
    assert again.resume() is None and again.history == []
    (tmp_path / "a" / "step=3").mkdir(parents=True)  # left half-written
    assert again.resume() is None


@pytest.mark.parametrize("name", ["emm", "em_gmm", "pl_spectral_em", "composite_em", "em_cml", "bayes_map"])
def test_fits_resume_to_the_same_result(spark, mixed, name, tmp_path, monkeypatch):
    start = (solvers.centred(U / 3), np.array([0.5, 0.5]))
    options = {"emm": {"mm_iters": 1}, "composite_em": {"link": Logistic(), "damp": 0.5}}.get(name, {})
    fit = lambda at: getattr(mixtures, name)(mixed, 5, 2, start=start, iters=5, eps=0.0, at=at, **options)
    want = fit(None)
    with monkeypatch.context() as m, pytest.raises(Stopped):
        stopping(m, passes, "sums", 3)
        fit(str(tmp_path))
    got = fit(str(tmp_path))
    assert got.u == pytest.approx(want.u, abs=1e-12) and got.alpha == pytest.approx(want.alpha, abs=1e-12)
    assert got.loglik == pytest.approx(want.loglik) and len(got.change) == 5


def test_single_estimators_resume(spark, mixed, tmp_path):
    assert estimators.ilsr(mixed, 5, iters=2, tol=0, at=str(tmp_path / "i")) is not None
    assert estimators.ilsr(mixed, 5, iters=4, tol=0, at=str(tmp_path / "i")) == pytest.approx(estimators.ilsr(mixed, 5, iters=4, tol=0))
    u = lambda df: [r.u for r in df.orderBy("item_id").collect()]
    estimators.mm(mixed, 5, iters=2, at=str(tmp_path / "m"))
    assert u(estimators.mm(mixed, 5, iters=4, at=str(tmp_path / "m"))) == pytest.approx(u(estimators.mm(mixed, 5, iters=4)))


# -- passes ---------------------------------------------------------------------------------------------------------------------


def test_passes_equal_the_relational_steps(spark, mixed):
    partial = mixed.where("(ranking_id + item_id) % 4 <> 0")
    rows = R.to_arrays(partial)
    alpha = np.array([0.7, 0.3])
    key = lambda df: {(r.ranking_id, r.component): (r.q, r.lse) for r in df.collect()}
    for options in ({}, {"hard": True}, {"trim": 0.04}):
        got, want = key(passes.assign(rows, passes.Model(U, alpha, **options))), key(mixtures.e_step(partial, U, alpha, trim="trim" in options, hard="hard" in options))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    ll = mixtures.pair_log_likelihood(partial, estimators.to_frame(spark, U), Logistic())
    log_f = np.log(Logistic().cdf(U[:, :, None] - U[:, None, :]))
    got = key(passes.assign(rows, passes.Model(U, alpha, log_f)))
    want = key(R.posterior(ll, mixtures.alpha_frame(spark, alpha)))
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_do_not_change_sums(spark, mixed, monkeypatch):
    rows = passes.table(mixed.where("(ranking_id + item_id) % 3 <> 0"))
    model = passes.Model(U, np.array([0.7, 0.3]))
    for want in ("mm", "pairs", "rates"):
        whole = passes.sums(rows, 5, model, want)
        with monkeypatch.context() as m:
            m.setattr(passes, "CELLS", 7)
            assert all(x == pytest.approx(passes.sums(rows.repartition(5), 5, model, want)[name]) for name, x in whole.items())
    with monkeypatch.context() as m, pytest.raises(ValueError, match="more than a task may hold"):
        m.setattr(passes, "MOST", 5)
        passes.sums(rows, 5, model, "pairs")


def test_large_utilities_do_not_overflow(spark):
    r = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 2)], "ranking_id long, pos int, item_id int")
    u = np.array([[800.0, -800.0, 0.0], [0.0, 0.0, 0.0]])
    q = {(x.ranking_id, x.component): x.q for x in passes.assign(R.to_arrays(r), passes.Model(u, np.array([0.5, 0.5]))).collect()}
    assert q[0, 0] == pytest.approx(2 / 3) and q[1, 0] == pytest.approx(0) and q[2, 0] == pytest.approx(0.5)
    assert all(np.isfinite(x).all() for x in passes.sums(R.to_arrays(r), 3, passes.Model(u, np.array([0.5, 0.5])), "mm").values())


def test_pcm_pass_equals_the_relational_steps(spark):
    betas = np.array([[[-0.5, 0.2], [0.1, 0.4], [0.6, 0.9]], [[0.5, 0.1], [-0.3, 0.8], [0.0, 0.2]]])
    rng = np.random.default_rng(4)
    r = spark.createDataFrame([(u, i, int(rng.integers(0, 3))) for u in range(120) for i in range(3) if rng.random() < 0.8], "user_id long, item_id int, score int")
    frame = irt.levels_frame(spark, betas)
    theta = irt.abilities(r, frame)
    q = irt.responsibilities(r, theta, frame, 1.3).select("user_id", "component", "q", "lse").toPandas()
    got = response_passes.sums(response_passes.table(r), betas, 1.3)
    assert got["loglik"] / got["m"] == pytest.approx(q[q.component == 0].lse.mean())
    long = r.toPandas().merge(q, on="user_id")
    for (c, i, k), x in long.groupby(["component", "item_id", "score"]).q.sum().items():
        assert got["counts"][c, i, k] == pytest.approx(x)
    pairs = long.merge(long, on=["user_id", "component"])
    for (c, k, l, i, j), x in pairs.assign(w=pairs.q_x**2).groupby(["component", "score_x", "score_y", "item_id_x", "item_id_y"]).w.sum().items():
        assert got["y"][c, k, l, i, j] == pytest.approx(x if k <= 1 or l == k - 1 else 0)


def test_pcm_mixture_resumes(spark, tmp_path):
    rng = np.random.default_rng(5)
    r = spark.createDataFrame([(u, i, int(rng.integers(0, 3))) for u in range(80) for i in range(4)], "user_id long, item_id int, score int")
    start = rng.normal(0, 0.3, (2, 4, 2))
    want = irt.pcm_mixture(r, 4, 2, 2, iters=4, eps=0, start=start)[0]
    irt.pcm_mixture(r, 4, 2, 2, iters=2, eps=0, start=start, at=str(tmp_path))
    got = irt.pcm_mixture(r, 4, 2, 2, iters=4, eps=0, start=start, at=str(tmp_path))[0]
    assert got.betas == pytest.approx(want.betas) and got.loglik == pytest.approx(want.loglik)


@pytest.mark.parametrize("levels", [1, 3])
def test_abilities_solve_the_expected_total(spark, levels):
    rng = np.random.default_rng(6)
    betas = rng.normal(0, 2, (6, levels))
    rows = [(u, i, int(rng.integers(0, levels + 1))) for u in range(60) for i in range(6) if rng.random() < 0.7] + [(100, 0, 0), (101, 1, levels), (102, 99, 1)]
    r = spark.createDataFrame(rows, "user_id long, item_id int, score int")
    got = {x.user_id: x.theta for x in irt.abilities(r, irt.levels_frame(spark, betas)).collect()}
    own = pd.DataFrame(rows, columns=["u", "i", "s"])
    assert set(got) == set(own[own.i < 6].u) and got[100] == -6 and got[101] == 6
    for u, g in own[own.i < 6].groupby("u"):
        mean = response_passes.probabilities(np.array([got[u]]), betas[g.i.to_numpy()])[0] @ np.arange(levels + 1)
        assert abs(got[u]) == 6 or mean.sum() == pytest.approx(g.s.sum(), abs=1e-9)


# -- posterior draws -----------------------------------------------------------------------------------------------------------


def test_killed_chains_resume_to_the_same_draws(spark, mixed, tmp_path, monkeypatch):
    run = lambda store, n=7: mixtures.gibbs(mixed, 5, 2, (U / 2, np.array([0.5, 0.5])), samples=n, chains=2, store=store, alpha=2.0)
    rows = lambda store: sorted((tuple(r) for r in store.read().collect()), key=str)
    whole = draws.Store(spark)
    want = run(whole)
    with monkeypatch.context() as m, pytest.raises(Stopped):
        stopping(m, passes, "draw", 9)
        run(draws.Store(spark, str(tmp_path), every=3))
    kept = draws.Store(spark, str(tmp_path), every=3)
    assert kept.last(0)[0] == 7 and kept.last(1)[0] == 0  # a part of three was not full yet
    got = run(kept)
    assert rows(kept) == rows(whole) and got[0] == pytest.approx(want[0]) and got[1].sum() == pytest.approx(1)
    assert len(rows(whole)) == 2 * 7 * (2 + 10)


def test_draws_do_not_depend_on_partitions(spark, mixed):
    rows, model = passes.table(mixed), passes.Model(U, np.array([0.6, 0.4]))
    a, b = passes.draw(rows, 5, model, (1, 2, 3)), passes.draw(rows.repartition(7), 5, model, (1, 2, 3))
    assert all(a[k] == pytest.approx(b[k]) for k in a) and a["count"].sum() == 300
    assert not np.allclose(passes.draw(rows, 5, model, (1, 2, 4))["waits"], a["waits"])


def test_draws_have_the_right_means(spark):
    r = spark.createDataFrame([(i, p, x) for i in range(400) for p, x in enumerate([0, 1, 2])], "ranking_id long, pos int, item_id int")
    u = np.array([[0.0, 0.5, 1.0]])
    got = [passes.draw(passes.table(r), 3, passes.Model(u, np.ones(1)), (0, 0, t)) for t in range(30)]
    waits = np.mean([g["waits"][0] for g in got], axis=0) / 400
    first, second = 1 / np.exp(u[0]).sum(), 1 / np.exp(u[0, 1:]).sum()
    assert waits == pytest.approx([first, first + second, first + second], rel=0.05)
    assert got[0]["wins"].tolist() == [[400, 400, 0]]


def test_relabelling_and_r_hat(spark):
    rng = np.random.default_rng(8)
    store = draws.Store(spark)
    for chain in range(2):
        for t in range(60):
            swap = bool(rng.integers(0, 2))
            u = U + rng.normal(0, 0.1, U.shape)
            store.add(chain, t, u[::-1] if swap else u, np.array([0.4, 0.6]) if swap else np.array([0.6, 0.4]))
    fixed = draws.relabel(store.read(), U)
    u, w = draws.matrices(fixed.groupBy("component", "item").agg(F.avg("value").alias("value")))
    assert np.abs(u - U).max() < 0.1 and w == pytest.approx([0.6, 0.4])
    assert max(r.r_hat for r in draws.r_hat(fixed.where("item is not null")).collect()) < 1.1
    apart = fixed.withColumn("value", F.col("value") + F.col("chain"))
    assert min(r.r_hat for r in draws.r_hat(apart.where("item is not null")).collect()) > 2
    assert {r.draws for r in draws.summary(fixed).collect()} == {120}


# -- the pinned solver ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("link", [Logistic(), Normal(), Logistic(2.0), GeneralNormal(1.0, 2.0)])
def test_pinned_equals_centred_up_to_a_shift(link):
    rng = np.random.default_rng(3)
    wins = rng.integers(1, 30, (6, 6)).astype(float)
    assert solvers.pinned_mle(wins, link) == pytest.approx(solvers.composite_mle(wins, link, lam=0), abs=1e-6)
    with pytest.raises(ValueError):
        solvers.pinned_mle(np.triu(wins, 1), link)


@pytest.mark.parametrize("link", [Logistic(1.5), Normal(0.8), GeneralNormal(1.2, 2.0), ExtremeValue(4.0, 0.5)])
def test_slopes_agree_with_differences(link):
    x, h = np.linspace(-2.0, 2.0, 9) + 0.01, 1e-5
    f = lambda x: np.log(link.cdf(x))
    rate, turn = link.log_slopes(x)
    assert rate == pytest.approx((f(x + h) - f(x - h)) / (2 * h), rel=1e-5)
    assert turn == pytest.approx((link.log_slopes(x + h)[0] - link.log_slopes(x - h)[0]) / (2 * h), rel=1e-4)
    v, w = np.array([0.0, 0.3, -0.2, 0.1]), np.arange(16.0).reshape(4, 4) * (1 - np.eye(4))
    slope, bend = solvers.pinned_slopes(w, link, v, 0.3)
    value = lambda v: -(w * f(v[None, :] - v[:, None])).sum() + 0.3 * (v * v).sum()
    for i in range(1, 4):
        e = np.eye(4)[i] * h
        assert slope[i - 1] == pytest.approx((value(v + e) - value(v - e)) / (2 * h), rel=1e-4, abs=1e-5)
        assert bend[i - 1] == pytest.approx((solvers.pinned_slopes(w, link, v + e, 0.3)[0] - solvers.pinned_slopes(w, link, v - e, 0.3)[0]) / (2 * h), rel=1e-3, abs=1e-4)


# -- order statistics ------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=12), max_size=6))
def test_earlier_larger_equals_pairs(groups):
    group = np.array([g for g, x in enumerate(groups) for _ in x], np.int64)
    value = np.array([v for x in groups for v in x], np.int64)
    want = [sum(a > b for a in x[:i]) for x in groups for i, b in enumerate(x)]
    assert ordering.earlier_larger(group, value).tolist() == want


def test_long_rankings(spark):
    n = 100_000
    order = np.random.default_rng(1).permutation(n)
    truth = spark.range(n).select(F.lit(7).cast("long").alias("ranking_id"), F.col("id").cast("int").alias("item_id"), F.col("id").cast("int").alias("pos"))
    estimate = spark.createDataFrame(pd.DataFrame({"item_id": order.astype("int32"), "pos": np.arange(n, dtype="int32")}))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    swaps = ordering.earlier_larger(np.zeros(n, np.int64), place).sum()
    assert metrics.kendall_distance(truth, estimate, "ranking_id").first().distance == pytest.approx(swaps / (n * (n - 1) / 2))
    codes = embeddings.lehmer(estimate.withColumn("ranking_id", F.lit(1)))
    x = np.array([r.x for r in codes.orderBy("k").collect()])
    assert len(x) == n and x.sum() == ordering.earlier_larger(np.zeros(n, np.int64), order).sum()


def test_short_and_string_rankings(spark):
    t = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0), (None, 1, 0), (None, 0, 1)], "who string, item_id int, pos int")
    e = spark.createDataFrame([(0, 0), (1, 1)], "item_id int, pos int")
    assert {r.who: r.distance for r in metrics.kendall_distance(t, e, "who").collect()} == {"a": 0.0, "b": None, None: 1.0}


def test_prefix_sums(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000003).alias("a"), F.col("id").alias("b"), (F.col("id") % 7).alias("x")).repartition(5)
    got = sorted((tuple(r) for r in ordering.sums_before(df, ["a", "b"], "x", "before").select("a", "b", "x", "before").collect()))
    total = 0
    for _, _, x, before in got:
        assert before == total
        total += x


def test_auc_of_continuous_scores(spark):
    df = spark.range(20_000).select((F.abs(F.xxhash64("id")) / 1e19).alias("p"), (F.xxhash64(F.lit(1), "id") % 3 == 0).cast("int").alias("score"))
    own = df.toPandas()
    rank = own.p.rank()
    pos = own.score == 1
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert metrics.auc(df).first().auc == pytest.approx(want)


@pytest.mark.parametrize("ranked", [1, 64, 1 << 16])
def test_selection_equals_sorting(spark, ranked):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(i), int(h)) for i, (g, h) in enumerate(zip(rng.choice(3, 3000, p=[0.9, 0.09, 0.01]), rng.integers(0, 1 << 60, 3000), strict=True))]
    rows += [(5, 10_000 + i, 99) for i in range(40)]  # one key: told apart by ties
    df = spark.createDataFrame(rows, "g int, i long, h long").repartition(4)
    want = {0: 1000, 1: 0, 2: 10_000, 5: 13}
    got = ordering.least(df, ["g"], "h", ["i"], spark.createDataFrame(list(want.items()), "g int, k long"), ranked).collect()
    assert len(got) == len(rows)
    for g, k in want.items():
        first = sorted((h, i) for a, i, h in rows if a == g)[:k]
        assert {r.i for r in got if r.g == g and r.taken} == {i for _, i in first}


def test_splits_hold_members(spark):
    df = spark.range(4000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("item_id"), F.lit(1).alias("score"), F.lit("x").alias("k"))
    out = reshape.split_responses(df, 0.8, 1)
    assert out.columns == ["user_id", "item_id", "score", "k", "split"] or set(out.columns) == {"user_id", "item_id", "score", "k", "split"}
    n = {(r.item_id, r.split): r.n for r in out.groupBy("item_id", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {(0, "train"): int(0.8 * 2666), (0, "test"): 2666 - int(0.8 * 2666), (1, "train"): int(0.8 * 1334), (1, "test"): 1334 - int(0.8 * 1334)}
    train, test = reshape.split_users(df, 0.5, 0.3, 1)
    a, b = {r.user_id for r in train.collect()}, {r.user_id for r in test.collect()}
    assert len(a) == 2000 and len(b) == 1200 and not a & b


# -- components ---------------------------------------------------------------------------------------------------------------------


def least_reachable(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_components_equal_union_find(spark, kind):
    rng = np.random.default_rng(9)
    name = (lambda x: f"n{x:03d}") if kind == "string" else int
    edges = [(name(a), name(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(name(200 + i), name(201 + i)) for i in range(40)] + [(name(300), name(300))]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()}
    assert got == least_reachable(edges)


def test_menus_are_stars(spark):
    rows = [(m, f"i{i:05d}") for m, i in enumerate(range(0, 50))] + [(100, f"i{i:05d}") for i in range(0, 20_000, 2)] + [(101, "i00001"), (101, "i00003"), (102, "i00003"), (102, "lone"), (103, "alone")]
    menus = spark.createDataFrame(rows, "menu_id long, item_id string")
    assert graph.menu_stars(menus).count() == 9_999 + 1 + 1
    got = {r.component: r["items"] for r in graph.menu_components(menus).collect()}
    assert got.keys() == {"i00000", "i00001"} and got["i00001"] == ["i00001", "i00003", "lone"] and len(got["i00000"]) == 10_000
    few = menus.where("menu_id > 100")
    assert graph.components(graph.menu_graph(few)).count() == 3
    pairs = {(m, *p) for m, g in pd.DataFrame([r for r in rows if r[0] > 100], columns=["m", "i"]).groupby("m") for p in combinations(sorted(g.i), 2)}
    assert graph.menu_graph(few).count() == 2 * len(pairs)


def test_unsettled_components_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=1)


def test_bounds_of_many_abilities(spark):
    theta = spark.range(3000).select((F.col("id") % 50 / 10 - 2).alias("theta"), F.col("id").alias("user_id"))
    beta = spark.createDataFrame([("a", 0.3), ("b", -1.0)], "item_id string, beta double")
    got = {r.item_id: r.bound for r in metrics.cramer_rao(beta, theta, 0.9).collect()}
    x = (np.arange(3000) % 50) / 10 - 2
    for item, b in (("a", 0.3), ("b", -1.0)):
        s = 1 / (1 + np.exp(b - x))
        assert got[item] == pytest.approx(1 / (0.9 * s * (1 - s)).sum())
