import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions.links import ExtremeValue, GeneralNormal, Logistic, Normal
from prefloom.operators import chains, clustering, embeddings, ep, estimators, glrm, graph, irt, metrics, mixtures, privacy, reshape
from prefloom.operators import rankings as R
from prefloom.plans import solvers
from prefloom.sources import generators, tables
from prefloom.streaming import pairwise

TRUTH = solvers.centred(np.array([1.2, 0.6, 0.1, -0.5, -1.4]))


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, [0, 1, 2]), (1, [0, 2, 1]), (2, [1, 0]), (3, [2])]
    return spark.createDataFrame([(r, p, i) for r, items in rows for p, i in enumerate(items)], "ranking_id long, pos int, item_id int")


@pytest.fixture(scope="module")
def drawn(spark):
    return generators.rankings(estimators.to_frame(spark, TRUTH), "gumbel", 1500, seed=3).cache()


def values(df, key="item_id", value="u"):
    rows = sorted(df.select(key, value).collect())
    return np.array([r[1] for r in rows])


def test_breaking_and_smoothing(small):
    c = R.comparisons(small)
    assert c.count() == 7
    n = {(r.winner, r.loser): r.cnt for r in R.pairwise_counts(c).collect()}
    assert n == {(0, 1): 2, (1, 0): 1, (0, 2): 2, (1, 2): 1, (2, 1): 1}
    p = {(r.loser, r.winner): r.p for r in R.pairwise_matrix(c, "one-sided").collect()}
    assert p[1, 0] == pytest.approx(2 / 3) and p[2, 0] == pytest.approx(3 / 4) and p[0, 2] == pytest.approx(1 / 4)
    r = R.comparisons(small, "random", 1).collect()
    assert len(r) == 3 and all((x.winner, x.loser) in n for x in r)


def test_empty_rankings(spark, small):
    none = small.limit(0)
    assert R.comparisons(none).count() == 0 and R.comparisons(none, "random").count() == 0
    assert R.pairwise_matrix(R.comparisons(none)).count() == 0


def test_equal_utilities(spark, drawn):
    ll = R.pl_log_likelihood(drawn, estimators.to_frame(spark, np.zeros(5)))
    assert ll.where(F.abs(F.col("loglik") + math.log(120)) > 1e-9).count() == 0


def test_chain_rows_add_to_one(drawn):
    chain, scale = chains.rank_centrality(R.pairwise_matrix(R.comparisons(drawn), "all"))
    m, _ = chains.to_dense(chain, scale, 5)
    assert np.allclose(m.sum(axis=1), 1)
    pi = solvers.stationary(m)
    assert np.allclose(pi @ m, pi) and np.allclose(solvers.power(m, eps=1e-12)[0], pi, atol=1e-6)
    walked = values(chains.power_iteration(chain, 60), value="pi")
    assert np.allclose(walked, pi, atol=1e-3)


@pytest.mark.parametrize(
    "fit",
    [
        lambda r: values(estimators.rank_centrality(r, 5)),
        lambda r: estimators.ilsr(r, 5, mle=True, log=True, iters=6),
        lambda r: values(estimators.mm(r, 5, iters=60)),
        lambda r: values(estimators.composite(r, 5, Logistic(), scheme="full", reg="l2")),
        lambda r: values(estimators.composite(r, 5, Logistic(), reg="l1")),
        lambda r: values(estimators.gmm(r, 5, Logistic())),
        lambda r: values(estimators.matrix_completion(r, 5, "rum_lrmc", scheme="full")),
        lambda r: values(estimators.matrix_completion(r, 5, "svt", scheme="full")),
        lambda r: values(estimators.matrix_completion(r, 5, "lrmc", scheme="full")),
        lambda r: solvers.centred(ep.fit(R.pairwise_counts(R.comparisons(r)), 5, 0.1)[0]),
    ],
)
def test_estimators_recover(drawn, fit):
    assert np.abs(fit(drawn) - TRUTH).max() < 0.3


def test_partial_rankings_recover(spark):
    r = generators.rankings(estimators.to_frame(spark, TRUTH), "gumbel", 2000, 0.6, seed=5)
    assert r.groupBy("ranking_id").count().where("count < 2").count() == 0
    assert np.abs(values(estimators.mm(r, 5, iters=60)) - TRUTH).max() < 0.3
    assert np.abs(estimators.ilsr(r, 5, iters=8, log=True) - TRUTH).max() < 0.35


def test_unbounded_estimate_is_refused():
    with pytest.raises(ValueError):
        solvers.composite_mle(np.array([[0, 1.0], [0, 0]]), Logistic(), lam=0)


@pytest.fixture(scope="module")
def mixed(spark):
    u = solvers.centred(np.array([[2.5, 1.5, 0.0, -1.5, -2.5], [-2.5, -1.0, 0.5, 1.0, 2.0]]))
    return u, generators.mixture_rankings(u, np.array([0.6, 0.4]), spark, m=600, seed=2).cache()


@pytest.mark.parametrize("name", ["emm", "em_gmm", "pl_spectral_em", "composite_em", "em_cml"])
def test_mixtures_recover(spark, mixed, name):
    u, r = mixed
    options = {"emm": {"init": "spectral", "iters": 5, "mm_iters": 3}, "composite_em": {"link": Logistic(), "iters": 4, "damp": 1.0}}.get(name, {"iters": 4})
    fit = getattr(mixtures, name)(r.select("ranking_id", "pos", "item_id"), 5, 2, **options)
    assert abs(max(fit.alpha) - 0.6) < 0.1
    # composite likelihoods of whole rankings are sharper than the model's own, so only the order is held there
    order = lambda v: np.argsort(-v).tolist()
    best = min(permutations(range(2)), key=lambda p: sum(np.abs(fit.u[j] - u[i]).sum() for i, j in enumerate(p)))
    for i, j in enumerate(best):
        assert order(fit.u[j])[0] == order(u[i])[0] and order(fit.u[j])[-1] == order(u[i])[-1]
    if name == "emm":
        assert all(b >= a - 1e-6 for a, b in zip(fit.loglik, fit.loglik[1:]))


def test_posteriors_add_to_one(spark, mixed):
    u, r = mixed
    q = mixtures.e_step(r.select("ranking_id", "pos", "item_id"), u, np.array([0.6, 0.4]))
    assert q.groupBy("ranking_id").agg(F.sum("q").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    hard = mixtures.e_step(r.select("ranking_id", "pos", "item_id"), u, np.array([0.6, 0.4]), hard=True)
    labels = hard.where("q = 1").join(r.select("ranking_id", F.col("component").alias("truth")).distinct(), "ranking_id").select("truth", F.col("component").alias("predicted"))
    assert metrics.clustering_accuracy(labels) > 0.9


def test_gibbs_and_map(mixed):
    u, r = mixed
    r = r.select("ranking_id", "pos", "item_id")
    fit = mixtures.bayes_map(r, 5, 2, (u, np.array([0.5, 0.5])), iters=4)
    assert np.abs(fit.u - u).max() < 0.8
    mean, w = mixtures.gibbs(r, 5, 2, (u, np.array([0.5, 0.5])), samples=4)
    assert np.abs(mean - u).max() < 1.0 and w.sum() == pytest.approx(1)


def test_rasch_recovers(spark):
    beta = solvers.centred(np.linspace(-1.5, 1.5, 8))
    theta = spark.range(1500).select(F.col("id").alias("user_id"), (generators.normal_noise()(1, "id")).alias("theta"))
    r = generators.rasch(theta, estimators.to_frame(spark, beta, "beta"), 0.8, 4).cache()
    got = values(irt.rasch(r, 8), value="beta")
    assert np.abs(got - beta).max() < 0.35
    private = values(privacy.private_rasch(r, 8, epsilon=1.0), value="beta")
    assert np.abs(private - beta).max() < 0.5
    est = irt.abilities(r, estimators.to_frame(spark, beta, "beta")).join(theta.withColumnRenamed("theta", "t"), "user_id")
    assert est.where("abs(theta) < 5").stat.corr("theta", "t") > 0.6


def test_pcm_recovers(spark):
    b = np.array([[-1.0, 0.5], [-0.5, 1.0], [0.0, 0.2], [0.5, 1.5], [1.0, 0.8]])
    b = b - b[:, :1].mean()
    theta = spark.range(2500).select(F.col("id").alias("user_id"), (generators.normal_noise()(1, "id")).alias("theta"))
    r = generators.graded(theta, irt.levels_frame(spark, b), 2)
    assert np.abs(irt.pcm(r, 5, 2) - b).max() < 0.4


def test_links_agree_with_numeric_derivatives(spark):
    x = np.linspace(-1.2, 1.2, 13)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for link in (Normal(), Logistic(1.3), GeneralNormal(1.1, 1.0), GeneralNormal(1.0, 2.0), GeneralNormal(0.9, 3.0), ExtremeValue(2.0, 0.5)):
        h = 1e-5
        mid = x + 1e-3
        assert np.allclose((link.cdf(mid + h) - link.cdf(mid - h)) / (2 * h), link.pdf(mid), atol=1e-5)
        assert np.allclose(link.quantile(link.cdf(x)), x, atol=1e-6)
        got = df.select("x", link.cdf_col(F.col("x")).alias("c"), link.pdf_col(F.col("x")).alias("p")).toPandas().sort_values("x")
        assert np.allclose(got.c, link.cdf(x)) and np.allclose(got.p, link.pdf(x))
    assert np.allclose(GeneralNormal(math.sqrt(2) * math.sqrt(2), 2.0).cdf(x), Normal().cdf(x), atol=1e-9)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 7):
        for _ in range(20):
            c = rng.integers(0, 20, (n, n)).astype(float)
            a = solvers.assignment(c)
            assert sorted(a) == list(range(n))
            assert sum(c[i, j] for i, j in enumerate(a)) == min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(n)))


def test_closed_forms():
    rng = np.random.default_rng(2)
    u = solvers.centred(rng.normal(size=6))
    m = u[None, :] - u[:, None]
    mask = ~np.eye(6, dtype=bool)
    assert np.allclose(solvers.ridge(m, mask, 1e-9), u, atol=1e-6)
    x = rng.normal(size=(5, 4))
    best = solvers.nuclear(x, 0.5)
    f = lambda z: 0.5 * ((x - z) ** 2).sum() + 0.5 * np.linalg.svd(z, compute_uv=False).sum()
    assert all(f(best) <= f(best + 0.05 * rng.normal(size=x.shape)) + 1e-12 for _ in range(30))


def test_partial_embedding_is_the_mean_over_completions(spark):
    n, ranked = 4, [2, 0]
    r = spark.createDataFrame([(0, p, i) for p, i in enumerate(ranked)], "ranking_id long, pos int, item_id int")
    got = {x.k: x.x for x in embeddings.partial_pairwise(r, n).collect()}
    full = [p for p in permutations(range(n)) if p.index(2) < p.index(0)]
    index = lambda i, j: n * i - i * (i + 1) // 2 + (j - i - 1)
    for i in range(n):
        for j in range(i + 1, n):
            assert got[index(i, j)] == pytest.approx(np.mean([p.index(i) < p.index(j) for p in full]))


def test_clustering_and_low_rank(spark, mixed):
    _, r = mixed
    x = embeddings.pairwise(r, 5)
    truth = r.select("ranking_id", F.col("component").alias("truth")).distinct()
    for algorithm in ("k-means", "agglomerative"):
        labels = clustering.spectral_clustering(x, 10, 2, algorithm=algorithm).join(truth, "ranking_id").select("truth", F.col("label").alias("predicted"))
        assert metrics.clustering_accuracy(labels) > 0.85
    for method in ("pca", "gaussian", "sparse", "nuclear", "alternating"):
        assert clustering.low_rank(x, 10, 2, method).count() == 600
    assert clustering.disjoint_pair_clustering(x, 5, 2).count() > 0
    assert clustering.heuristic_pair_weight(x, 10, 600).max() == pytest.approx(1.0)


def test_graphs(spark):
    menus = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)], "menu_id long, item_id int")
    got = sorted(r["items"] for r in graph.menu_components(menus).collect())
    assert got == [[0, 1], [2, 3]]
    assert not graph.connected(graph.menu_graph(menus))
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src int, dst int")
    assert graph.connected(chain) and graph.connected(chain, range(21)) and not graph.connected(chain, range(22))
    assert graph.topological_order(chain, np.zeros(21)) == list(range(21))


def test_metrics(spark):
    u = estimators.to_frame(spark, np.array([[1.0, 0, -1], [0, 1, -1]]))
    v = estimators.to_frame(spark, np.array([[0, 1.0, -1], [1, 0, -1]]))
    assert metrics.ell2_mixture(u, v) == pytest.approx(0)
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, score int")
    assert metrics.auc(s).first()[0] == pytest.approx(0.75)
    b = irt.levels_frame(spark, np.array([[[0.0, 1.0]], [[1.0, 0.0]]]))
    assert metrics.frobenius_difference(b, b) == pytest.approx(0)


def test_privacy():
    rng = np.random.default_rng(0)
    g = np.array([privacy.discrete_gaussian(2.0, rng) for _ in range(3000)])
    assert abs(g.mean()) < 0.2 and abs(g.std() - 2) < 0.15
    t = np.array([privacy.two_sided_geometric(0.5, rng) for _ in range(3000)])
    assert abs(t.mean()) < 0.15 and abs((t == 0).mean() - 1 / 3) < 0.04
    assert abs(np.mean([privacy.bernoulli_exp(1.5, rng) for _ in range(3000)]) - math.exp(-1.5)) < 0.03
    assert privacy.epsilon_shuffle(1.0, 1e-6, 100_000) == pytest.approx(5.700792, abs=1e-6)
    assert privacy.epsilon_shuffle(0.1, 1e-6, 100_000) == pytest.approx(1.274315, abs=1e-6)
    assert privacy.epsilon_shuffle(1.0, 1e-6, 100) == 1.0  # too few reports
    assert privacy.epsilon_gauss(1.0, 1e-5) == pytest.approx(1 / math.sqrt(2 * math.log(1e5)))
    a = privacy.random_graph(30, 0.5)
    assert (a == a.T).all() and not a.diagonal().any()


def test_randomized_response_keeps_most(spark):
    r = spark.range(2000).select(F.col("id").alias("user_id"), F.lit(0).alias("item_id"), F.lit(1).alias("score"))
    kept = privacy.randomized_response(r, 1.0).agg(F.avg("score")).first()[0]
    assert abs(kept - 1 / (1 + math.exp(-1))) < 0.05


def test_glrm():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 8)) + 3
    hidden = rng.random(a.shape) < 0.2
    m = glrm.GLRM(np.where(hidden, np.nan, a), k=2, reg_x=glrm.Penalty("l2", 1e-4), reg_y=glrm.Penalty("l2", 1e-4)).fit(600, 1e-8)
    assert np.abs(m.predict() - a)[hidden].mean() < 0.3
    assert m.history[-1] <= m.history[0]
    sign = np.sign(a - 3)
    h = glrm.GLRM(sign, glrm.Hinge(), 2, glrm.Penalty("l2", 1e-3), glrm.Penalty("l2", 1e-3)).fit(200)
    assert (h.predict() == sign).mean() > 0.9
    for kind in ("zero", "l1", "nonnegative", "group"):
        assert np.isfinite(glrm.GLRM(a, glrm.Huber(), 2, glrm.Penalty(kind, 0.01)).fit(5).history[-1])
    grades = np.clip(np.round(a), 0, 5)
    assert np.isfinite(glrm.GLRM(grades, glrm.Ordinal(0, 5), 2).fit(5).predict()).all()


def test_reshape(spark):
    wide = spark.createDataFrame([(0, 1, None), (1, -99999, 0)], "user_id long, a int, b int")
    assert sorted(tuple(r) for r in reshape.unpivot(wide).collect()) == [(0, 0, 1), (1, 1, 0)]
    assert reshape.pivot(reshape.unpivot(wide), 2).count() == 2
    r = spark.range(100).select(F.col("id").alias("user_id"), (F.col("id") % 2).cast("int").alias("item_id"), F.lit(1).alias("score"))
    s = reshape.split_responses(r, 0.8)
    assert s.where("split = 'train'").count() == 80
    train, test = reshape.split_users(r, 0.7, 0.2)
    assert train.count() == 70 and test.count() == 20 and train.join(test, "user_id").count() == 0
    none = reshape.split_users(r, 0.7, 0.0)[1]
    assert none.count() == 0
    cells = spark.createDataFrame([(0, 1), (1, 0)], "i int, j int")
    assert reshape.mask(cells, cells.where("i = 0")).count() == 1 == reshape.mask(cells, cells.where("i = 0"), True).count()
    assert reshape.random_pairs(spark, 5, 1.0, symmetric=True).count() == 20
    assert reshape.cartesian(cells, cells.toDF("k", "l")).count() == 4


def test_generators(spark):
    m = generators.menus(spark, 6, [2, 3, 3], 1)
    assert set(r["count"] for r in m.groupBy("menu_id").count().collect()) <= {2, 3}
    p = generators.partial_rankings(estimators.to_frame(spark, np.zeros(6)), m, m=10)
    assert p.count() == 10 * m.count()
    timed = generators.time_varying_utilities(spark, 4, 3)
    assert timed.count() == 12
    assert generators.timed_rankings(timed, m=5).count() == 60
    assert generators.timed_partial_rankings(timed, timed.select("t", F.lit(0).alias("menu_id"), "item_id").where("item_id < 3"), m=2).count() == 18
    assert generators.time_varying_comparisons(timed, 4, draws=10, p0=1.0).count() == 3 * 6 * 10
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    w = generators.comparisons_from_p(np.array([[0.5, 0.2], [0.8, 0.5]]), pairs, 1000).where("winner = 0").first().weight
    assert abs(w - 800) < 60
    x = generators.mean_pairwise(estimators.to_frame(spark, TRUTH), Logistic(), 5)
    assert x.count() == 10
    e = spark.range(4000).select(generators.exponential_noise(2.0)(1, "id").alias("e"), generators.normal_noise()(1, "id").alias("z"), generators.gumbel_noise()(1, "id").alias("g"))
    mean = e.agg(F.avg("e"), F.stddev("z"), F.avg("g")).first()
    assert abs(mean[0] - 2) < 0.15 and abs(mean[1] - 1) < 0.06 and abs(mean[2] - 0.5772) < 0.08


def test_sources_and_stream(spark, tmp_path):
    r = tables.event_rankings(spark, "/root/testdata/sf0.001")
    assert r.groupBy("ranking_id").count().where("count <> 5").count() == 0
    for kind in ("parquet", "json", "csv", "orc"):
        tables.save(r.select("ranking_id", "pos", "item_id"), str(tmp_path / kind), kind)
        assert tables.load(spark, str(tmp_path / kind), kind, "ranking_id long, pos int, item_id int").count() == r.count()
    c = R.comparisons(r).select("winner", "loser")
    c.write.parquet(str(tmp_path / "in"))
    q = pairwise.running_counts(spark.readStream.schema("winner int, loser int").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.winner, x.loser): x.cnt for x in spark.sql("select * from pairs").collect()}
    assert got == {(x.winner, x.loser): x.cnt for x in R.pairwise_counts(c).collect()}
    ev = spark.createDataFrame([("2024-01-01 00:10:00", 0, 1), ("2024-01-01 01:10:00", 0, 1)], "ts string, winner int, loser int").withColumn("ts", F.to_timestamp("ts"))
    assert pairwise.windowed_counts(ev).count() == 2
