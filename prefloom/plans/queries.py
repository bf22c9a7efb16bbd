"""The library's queries over the tables.  Floats are rounded, so that results compare across engines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import ExtremeValue, GeneralNormal, Logistic, Normal
from ..operators import chains, clustering, draws, embeddings, ep, estimators, glrm, graph, irt, lowrank, metrics, mixtures, passes, privacy, reshape, response_passes
from ..operators import rankings as R
from ..sources import generators, tables
from ..streaming import pairwise
from . import solvers

ITEMS = 5
BRANDS = 25
LEVELS = 3
#: utilities and weights of a fixed two-component mixture, for likelihoods and posteriors
U = ((0.5, -0.25, 0.0, 0.75, -1.0), (-0.5, 1.0, 0.25, -0.75, 0.0))
ALPHA = (0.6, 0.4)
BETAS = ((-0.5, 0.25, 0.75), (0.0, 0.5, 1.0), (-1.0, 0.0, 0.5), (0.25, 0.5, 0.75), (-0.25, 0.0, 1.25))

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    FOUND[f.__name__] = f
    return f


def r6(c, digits: int = 6):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _u(spark):
    return estimators.to_frame(spark, np.array(U))


def _alpha(spark):
    return mixtures.alpha_frame(spark, np.array(ALPHA))


def _vector(spark, u, name="u"):
    return estimators.to_frame(spark, u, name).withColumn(name, r6(F.col(name), 4))


def _events(spark, d):
    return tables.event_rankings(spark, d)


def _orders(spark, d):
    return tables.order_rankings(spark, d).select("ranking_id", "pos", "item_id")


# -- rank breaking and pairwise statistics ------------------------------------------------------------------------


@query
def rank_break_full(spark, d):
    return R.comparisons(_orders(spark, d)).select("ranking_id", "winner", "loser")


@query
def rank_break_random(spark, d):
    return R.comparisons(_orders(spark, d), "random").select("ranking_id", "winner", "loser")


@query
def pairwise_counts(spark, d):
    return R.pairwise_counts(R.comparisons(_orders(spark, d))).select("winner", "loser", F.col("cnt").cast("long").alias("cnt"))


@query
def brand_pairwise_counts(spark, d):
    return R.pairwise_counts(R.comparisons(tables.brand_rankings(spark, d))).select("winner", "loser", F.col("cnt").cast("long").alias("cnt"))


def _p(spark, d, kind):
    return R.pairwise_matrix(R.comparisons(tables.brand_rankings(spark, d)), kind, 1.0).select("loser", "winner", r6(F.col("p")).alias("p"))


@query
def pairwise_prob_raw(spark, d):
    return _p(spark, d, "none")


@query
def pairwise_prob_laplace(spark, d):
    return _p(spark, d, "all")


@query
def pairwise_prob_onesided(spark, d):
    return _p(spark, d, "one-sided")


@query
def pairwise_weighted(spark, d):
    w = _orders(spark, d).withColumn("weight", 1.0 / (1 + F.col("ranking_id") % 4))
    return R.pairwise_matrix(R.comparisons(w), "none").select("loser", "winner", r6(F.col("cnt"), 4).alias("weight"), r6(F.col("p")).alias("p"))


@query
def choice_counts(spark, d):
    return R.choice_counts(_orders(spark, d))


@query
def win_matrix(spark, d):
    return R.win_matrix(_orders(spark, d))


@query
def choice_tensor(spark, d):
    return R.choice_tensor(_orders(spark, d)).select("winner", "loser", "ranking_id")


@query
def stage_statistics(spark, d):
    return R.stage_statistics(_events(spark, d)).select("ranking_id", "item_id", "u", F.col("stages").cast("int").alias("stages"))


# -- chains ----------------------------------------------------------------------------------------------------------


@query
def rank_centrality(spark, d):
    return estimators.rank_centrality(_events(spark, d), ITEMS).select("item_id", r6(F.col("u"), 4).alias("u"))


@query
def rank_centrality_chain(spark, d):
    chain, _ = chains.rank_centrality(R.pairwise_matrix(R.comparisons(_events(spark, d)), "all", 1.0))
    return chain.select("src", "dst", r6(F.col("p")).alias("p"))


@query
def rank_centrality_t12(spark, d):
    chain, _ = chains.rank_centrality(R.pairwise_matrix(R.comparisons(_events(spark, d)), "all", 1.0))
    return chains.power_iteration(chain.cache(), 12).select("item_id", r6(F.col("pi")).alias("pi"))


@query
def ilsr_one_step_chain(spark, d):
    pi = estimators.to_frame(spark, np.full(ITEMS, 1 / ITEMS), "pi")
    return estimators.ilsr_chain(R.to_arrays(_orders(spark, d)), pi).select("loser", "winner", r6(F.col("rate"), 4).alias("rate"))


@query
def mm_one_step(spark, d):
    s = estimators.mm_statistics(R.to_arrays(_orders(spark, d)), estimators.to_frame(spark, np.zeros((1, ITEMS))))
    return s.select("item_id", F.col("wins").cast("long").alias("wins"), r6(F.col("denom"), 4).alias("denom"))


@query
def rasch_chain_counts(spark, d):
    return chains.co_counts(tables.binary_responses(spark, d), 1, 0).select("i", "j", F.col("y").cast("long").alias("n"))


@query
def rasch_co_responses(spark, d):
    return chains.co_responses(tables.binary_responses(spark, d))


@query
def rasch_chain_accelerated(spark, d):
    chain, _ = chains.responses(tables.binary_responses(spark, d), 1.0)
    return chain.select("src", "dst", r6(F.col("p")).alias("p"))


@query
def rasch_chain_plain(spark, d):
    chain, _ = chains.responses(tables.binary_responses(spark, d), 1.0, accelerated=False)
    return chain.select("src", "dst", r6(F.col("p")).alias("p"))


@query
def pcm_level_counts(spark, d):
    y = irt.level_counts(tables.graded_responses(spark, d), LEVELS)
    return y.select("k", "l", "i", "j", F.col("y").cast("long").alias("n"))


# -- likelihoods and posteriors ----------------------------------------------------------------------------------------


@query
def pl_loglik(spark, d):
    ll = R.pl_log_likelihood(_orders(spark, d), _u(spark))
    return ll.select("ranking_id", "component", r6(F.col("loglik")).alias("loglik"))


@query
def pl_posterior(spark, d):
    q = R.posterior(R.pl_log_likelihood(_orders(spark, d), _u(spark)), _alpha(spark))
    return q.select("ranking_id", "component", r6(F.col("q")).alias("q"))


@query
def pl_mixture_loglik(spark, d):
    return metrics.mixture_log_likelihood(_orders(spark, d), _u(spark), _alpha(spark), normalise=False).select(r6(F.col("loglik")).alias("loglik"))


@query
def alpha_update(spark, d):
    q = R.posterior(R.pl_log_likelihood(_orders(spark, d), _u(spark)), _alpha(spark))
    return q.groupBy("component").agg(r6(F.avg("q")).alias("a"))


@query
def pair_composite_loglik(spark, d):
    ll = mixtures.pair_log_likelihood(_orders(spark, d), _u(spark), Logistic())
    return ll.select("ranking_id", "component", r6(F.col("loglik")).alias("loglik"))


# -- links -----------------------------------------------------------------------------------------------------------


def _priced(spark, d):
    """A point and a probability of each order, from its price."""
    price = F.col("o_totalprice").cast("double")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.least(price / 100000 - 2, F.lit(2.9)).alias("x"))
    return o.withColumn("q", 0.5 + F.atan("x") / 4)


def _link(link):
    def f(spark, d):
        return _priced(spark, d).select("o_orderkey", "x", r6(link.cdf_col(F.col("x"))).alias("cdf"), r6(link.pdf_col(F.col("x"))).alias("pdf"), r6(link.quantile_col(F.col("q"))).alias("quantile"))

    return f


FOUND["link_logistic"] = _link(Logistic(1.5))
FOUND["link_laplace"] = _link(GeneralNormal(1.5, 1.0))
FOUND["link_extreme_value"] = _link(ExtremeValue(1.5, 0.5))
FOUND["link_probit"] = _link(Normal(1.0))
FOUND["link_general_normal"] = _link(GeneralNormal(1.0, 3.0))


# -- item response -------------------------------------------------------------------------------------------------------


def _beta(spark):
    return spark.createDataFrame([(i, b[0]) for i, b in enumerate(BETAS)], "item_id int, beta double")


@query
def pcm_probabilities(spark, d):
    j = tables.graded_responses(spark, d).join(metrics.level_arrays(irt.levels_frame(spark, np.array(BETAS))), "item_id")
    p = metrics.pcm_probabilities((F.col("user_id") % 7 - 3) / 2, F.col("betas"))
    return j.select("user_id", "item_id", F.posexplode(p).alias("level", "v")).select("user_id", "item_id", "level", r6(F.col("v")).alias("p"))


@query
def pcm_heldout(spark, d):
    r = tables.graded_responses(spark, d)
    theta = r.select("user_id").distinct().withColumn("theta", (F.col("user_id") % 7 - 3) / 2)
    h = metrics.heldout_ratings(theta, irt.levels_frame(spark, np.array(BETAS)), r)
    return h.select("user_id", "item_id", "score", "predicted", r6(F.col("p")).alias("p"))


@query
def cramer_rao_bound(spark, d):
    r = tables.binary_responses(spark, d).select("user_id").distinct().withColumn("theta", (F.col("user_id") % 7 - 3) / 2)
    return metrics.cramer_rao(_beta(spark), r, 0.8).select("item_id", F.round("bound", 8).alias("bound"))


@query
def marginal_response(spark, d):
    right = F.sum((F.col("score") == 1).cast("int"))
    beta = tables.binary_responses(spark, d).groupBy("item_id").agg(F.log((F.count("*") - right + 1) / (right + 1)).alias("beta"))
    return metrics.marginal_response(beta, 1.0, 0.0, 10.0, 400).select("item_id", r6(F.col("p")).alias("p"))


@query
def heldout_loglik(spark, d):
    p = spark.createDataFrame([(i, 0.2 + 0.1 * i) for i in range(ITEMS)], "item_id int, p double")
    return metrics.heldout_log_likelihood(p, tables.binary_responses(spark, d)).select(r6(F.col("loglik")).alias("loglik"))


@query
def auc(spark, d):
    r = tables.binary_responses(spark, d).withColumn("p", (F.col("user_id") * 7 + F.col("item_id") * 3) % 11 / 11)
    return metrics.auc(r).select(r6(F.col("auc")).alias("auc"))


@query
def auc_prices(spark, d):
    """Returned lines against all others, by price: scores of which few are equal."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("score"))
    return metrics.auc(li).select(r6(F.col("auc")).alias("auc"))


@query
def pcm_abilities(spark, d):
    theta = irt.abilities(tables.graded_responses(spark, d), irt.levels_frame(spark, np.array(BETAS)))
    return theta.select("user_id", r6(F.col("theta"), 4).alias("theta"))


@query
def rasch_beta(spark, d):
    return irt.rasch(tables.binary_responses(spark, d), ITEMS).select("item_id", r6(F.col("beta"), 4).alias("beta"))


@query
def rasch_joint(spark, d):
    _, theta = irt.rasch_joint(tables.binary_responses(spark, d), ITEMS)
    return theta.select("user_id", r6(F.col("theta"), 3).alias("theta"))


@query
def pcm_beta(spark, d):
    b = irt.pcm(tables.graded_responses(spark, d), ITEMS, LEVELS)
    return irt.levels_frame(spark, b).withColumn("beta", r6(F.col("beta"), 4))


@query
def pcm_mixture(spark, d):
    fit, _, q = irt.pcm_mixture(tables.graded_responses(spark, d), ITEMS, LEVELS, 2)
    return q.groupBy("component").agg(r6(F.avg("q"), 3).alias("share"))


TWO = np.array([BETAS, BETAS]) + np.array([0.0, 0.5])[:, None, None] * np.arange(ITEMS)[None, :, None] / 2


@query
def pcm_memberships(spark, d):
    """Abilities and memberships of each user in two fixed classes."""
    r, betas = tables.graded_responses(spark, d), irt.levels_frame(spark, TWO)
    theta = irt.abilities(r, betas)
    q = irt.responsibilities(r, theta, betas).join(theta, ["user_id", "component"])
    return q.select("user_id", "component", r6(F.col("theta"), 4).alias("theta"), r6(F.col("q"), 4).alias("q"), r6(F.col("lse"), 4).alias("lse"))


@query
def pcm_mixture_sums(spark, d):
    """Scores by item of each class, weighted by memberships, from the pass that a mixture's step makes."""
    got = response_passes.sums(response_passes.table(tables.graded_responses(spark, d)), TWO, 1.0)
    rows = [(c, i, k, float(got["counts"][c, i, k]), float(got["y"][c, 1, k, i, (i + 1) % ITEMS])) for c in range(2) for i in range(ITEMS) for k in range(LEVELS + 1)]
    return spark.createDataFrame(rows, "component int, item_id int, level int, weight double, next double").withColumns({"weight": r6(F.col("weight"), 3), "next": r6(F.col("next"), 3)})


# -- metrics ---------------------------------------------------------------------------------------------------------------


def _against_mean(spark, d):
    """All users' rankings, and the items by their mean place in them."""
    r = _events(spark, d)
    mean = r.groupBy("item_id").agg(F.avg("pos").alias("mean"))
    return r, mean.select("item_id", (F.row_number().over(Window.orderBy("mean", "item_id")) - 1).alias("pos"))  # one row an item


@query
def top_k_accuracy(spark, d):
    return metrics.top_k_accuracy(*_against_mean(spark, d), 3, "ranking_id").select("ranking_id", r6(F.col("accuracy")).alias("accuracy"))


@query
def kendall_distance(spark, d):
    return metrics.kendall_distance(*_against_mean(spark, d), "ranking_id").select("ranking_id", r6(F.col("distance")).alias("distance"))


def _measured(spark, d):
    """Utilities as mean places: component 0 of event types, component 1 of order priorities."""
    u = lambda r, c: r.groupBy("item_id").agg((-F.avg("pos")).alias("u")).select(F.lit(c).alias("component"), "item_id", "u")
    return u(_events(spark, d), 0).union(u(_orders(spark, d), 1))


@query
def ell2(spark, d):
    u = _measured(spark, d)
    return metrics.ell2(u.where("component = 0"), u.where("component = 1")).select(r6(F.col("ell2")).alias("ell2"))


@query
def pairwise_loglik(spark, d):
    p = R.pairwise_matrix(R.comparisons(_events(spark, d)), "all")
    return metrics.pairwise_log_likelihood(p, _u(spark).where("component = 0"), Logistic()).select(r6(F.col("loglik")).alias("loglik"))


def _labels(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("int").alias("truth"), ((F.col("label") * 3 + F.col("vec_id") % 4) % 10).cast("int").alias("predicted"))


@query
def confusion_counts(spark, d):
    return metrics.confusion(_labels(spark, d))


@query
def clustering_accuracy(spark, d):
    return spark.createDataFrame([(round(float(metrics.clustering_accuracy(_labels(spark, d))), 6),)], "accuracy double")


# -- embeddings ------------------------------------------------------------------------------------------------------------


def _embed(f):
    def g(spark, d):
        return f(_orders(spark, d)).select("ranking_id", F.col("k").cast("int").alias("k"), r6(F.col("x")).alias("x"))

    return g


FOUND["embed_pairwise_signed"] = _embed(lambda r: embeddings.pairwise(r, ITEMS))
FOUND["embed_pairwise_binary"] = _embed(lambda r: embeddings.pairwise(r, ITEMS, "binary"))
FOUND["embed_partial"] = _embed(lambda r: embeddings.partial_pairwise(r, ITEMS))
FOUND["embed_lehmer"] = _embed(embeddings.lehmer)
FOUND["embed_positional"] = _embed(embeddings.positional)
FOUND["embed_top_k"] = _embed(lambda r: embeddings.top_k(r, 2))
FOUND["embed_disjoint"] = _embed(lambda r: embeddings.disjoint_pairs(r, ITEMS))
FOUND["embed_square"] = _embed(lambda r: embeddings.square(r, ITEMS))


@query
def embed_gram(spark, d):
    g = embeddings.gram(embeddings.pairwise(_orders(spark, d), ITEMS), 10)
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(10) for j in range(10) if g[i, j]], "i int, j int, s double")


# -- graphs ------------------------------------------------------------------------------------------------------------------


@query
def preference_graph(spark, d):
    return graph.preference_graph(R.pairwise_matrix(R.comparisons(tables.brand_rankings(spark, d)), "all"))


@query
def comparison_graph(spark, d):
    return graph.comparison_graph(R.pairwise_matrix(R.comparisons(tables.brand_rankings(spark, d)), "none"))


def _menus(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("c"))
    return o.groupBy((F.col("c") % 60).alias("m")).count().select(F.explode(F.array(F.col("m"), F.col("m") + F.when(F.col("m") % 5 == 0, 60).otherwise(1))).alias("item_id"), F.col("m").alias("menu_id")).select(F.col("menu_id").cast("long"), F.col("item_id").cast("int"))


@query
def menu_components(spark, d):
    return graph.components(graph.menu_stars(_menus(spark, d))).select(F.col("node").cast("int"), F.col("root").cast("int"))


@query
def brand_components(spark, d):
    """Brands (by name) that orders tie together."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item_id"))
    menus = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", F.col("l_orderkey").alias("menu_id")).join(part, "l_partkey").select("menu_id", "item_id")
    return graph.components(graph.menu_stars(menus))


@query
def topological_order(spark, d):
    order = graph.topological_order(graph.preference_graph(R.pairwise_matrix(R.comparisons(_events(spark, d)), "all")), np.zeros(ITEMS))
    return spark.createDataFrame(list(enumerate(order)), "place int, item_id int")


# -- estimators ------------------------------------------------------------------------------------------------------------------


def _estimate(f):
    def g(spark, d):
        return f(_orders(spark, d)).select("item_id", r6(F.col("u"), 3).alias("u"))

    return g


FOUND["mm"] = _estimate(lambda r: estimators.mm(r, ITEMS, iters=100))
FOUND["composite_likelihood"] = _estimate(lambda r: estimators.composite(r, ITEMS))
FOUND["gmm"] = _estimate(lambda r: estimators.gmm(r, ITEMS))
FOUND["svt"] = _estimate(lambda r: estimators.matrix_completion(r, ITEMS, "svt"))
FOUND["lrmc"] = _estimate(lambda r: estimators.matrix_completion(r, ITEMS, "lrmc"))
FOUND["rum_lrmc"] = _estimate(lambda r: estimators.matrix_completion(r, ITEMS, "rum_lrmc"))


FOUND["gmm_logistic"] = _estimate(lambda r: estimators.gmm(r, ITEMS, Logistic()))
FOUND["composite_logistic"] = _estimate(lambda r: estimators.composite(r, ITEMS, Logistic(), "full", reg="l2"))
FOUND["rum_lrmc_all_pairs"] = _estimate(lambda r: estimators.matrix_completion(r, ITEMS, "rum_lrmc", scheme="full", lam=0.1))


@query
def ilsr(spark, d):
    return _vector(spark, estimators.ilsr(_orders(spark, d), ITEMS))


@query
def expectation_propagation(spark, d):
    mean, _ = ep.fit(R.pairwise_counts(R.comparisons(_events(spark, d))), ITEMS)
    return _vector(spark, mean)


# -- mixtures --------------------------------------------------------------------------------------------------------------------


def _mixture(f):
    def g(spark, d):
        fit = f(_events(spark, d).select("ranking_id", "pos", "item_id"))
        u, a = fit.frames(spark)
        return u.join(a, "component").select("component", "item_id", r6(F.col("u"), 2).alias("u"), r6(F.col("a"), 2).alias("a"))

    return g


FOUND["emm"] = _mixture(lambda r: mixtures.emm(r, ITEMS, 2))
FOUND["em_gmm"] = _mixture(lambda r: mixtures.em_gmm(r, ITEMS, 2))
FOUND["pl_spectral_em"] = _mixture(lambda r: mixtures.pl_spectral_em(r, ITEMS, 2))
FOUND["composite_em"] = _mixture(lambda r: mixtures.composite_em(r, ITEMS, 2, link=Logistic(), eps=1e-6))
FOUND["em_cml"] = _mixture(lambda r: mixtures.em_cml(r, ITEMS, 2))
FOUND["gmm_mixture"] = _mixture(lambda r: mixtures.gmm_mixture(r, ITEMS, 2))
FOUND["bayes_map"] = _mixture(lambda r: mixtures.bayes_map(r, ITEMS, 2, mixtures.random_start(ITEMS, 2)))


def _fixed(spark, fit, digits):
    """Utilities and weights after one step from the fixed mixture, and the log-likelihood before it."""
    u, a = fit.frames(spark)
    return u.join(a, "component").select("component", "item_id", r6(F.col("u"), digits).alias("u"), r6(F.col("a")).alias("a"), F.lit(round(fit.loglik[0], 6)).alias("loglik"))


def _one_step(f, digits=3):
    return lambda spark, d: _fixed(spark, f(_orders(spark, d), (np.array(U), np.array(ALPHA))), digits)


FOUND["emm_step"] = _one_step(lambda r, start: mixtures.emm(r, ITEMS, 2, start, iters=1, mm_iters=1), 5)
FOUND["bayes_map_step"] = _one_step(lambda r, start: mixtures.bayes_map(r, ITEMS, 2, start, c=2.0, d=1.0, alpha=3.0, iters=1), 5)
FOUND["pl_spectral_em_step"] = _one_step(lambda r, start: mixtures.pl_spectral_em(r, ITEMS, 2, start, iters=1), 5)
FOUND["pl_spectral_em_hard_step"] = _one_step(lambda r, start: mixtures.pl_spectral_em(r, ITEMS, 2, start, iters=1, hard=True), 5)
FOUND["em_gmm_step"] = _one_step(lambda r, start: mixtures.em_gmm(r, ITEMS, 2, start, iters=1, lam=0.01))
FOUND["em_cml_step"] = _one_step(lambda r, start: mixtures.composite_em(r, ITEMS, 2, start, Logistic(), iters=1, damp=1.0, lam=0.01, e="pl"))
FOUND["composite_em_step"] = _one_step(lambda r, start: mixtures.composite_em(r, ITEMS, 2, start, Logistic(), iters=1, damp=0.1, lam=0.01))
FOUND["composite_em_pinned_step"] = _one_step(lambda r, start: mixtures.composite_em(r, ITEMS, 2, start, Logistic(), iters=1, damp=1.0, lam=0.01, e="pl", space="pinned"))


@query
def composite_posterior(spark, d):
    """Posteriors of each ranking under the composite likelihood of pairs."""
    u = np.array(U)
    f = np.log(Logistic().cdf(u[:, :, None] - u[:, None, :]))
    q = passes.assign(R.to_arrays(_orders(spark, d)), passes.Model(u, np.array(ALPHA), f))
    return q.select("ranking_id", "component", r6(F.col("q")).alias("q"), r6(F.col("lse")).alias("lse"))


@query
def posterior_pair_weights(spark, d):
    s = passes.sums(passes.table(_orders(spark, d)), ITEMS, passes.Model(np.array(U), np.array(ALPHA)), "pairs")["pairs"]
    rows = [(int(c), int(l), int(w), float(s[c, l, w])) for c, l, w in np.argwhere(s > 0)]
    return spark.createDataFrame(rows, "component int, loser int, winner int, weight double").withColumn("weight", r6(F.col("weight"), 5))


@query
def pinned_slopes(spark, d):
    """Gradient (j = 0) and curvature of the composite likelihood of all pairs with item 0 pinned, at fixed utilities."""
    w = R.dense(R.pairwise_counts(R.comparisons(_orders(spark, d))).withColumnRenamed("cnt", "p"), ITEMS, diagonal=0.0)
    v = np.array(U[0]) - U[0][0]
    slope, bend = solvers.pinned_slopes(w, Logistic(), v, 0.5)
    rows = [(i + 1, 0, float(x)) for i, x in enumerate(slope)] + [(i + 1, j + 1, float(x)) for i, row in enumerate(bend) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", r6(F.col("value"), 4))


@query
def pinned_estimate(spark, d):
    """The composite likelihood's maximum over all pairs, found with item 0 pinned."""
    w = R.dense(R.pairwise_counts(R.comparisons(_orders(spark, d))).withColumnRenamed("cnt", "p"), ITEMS, diagonal=0.0)
    return _vector(spark, solvers.pinned_mle(w, Logistic()))


@query
def gibbs(spark, d):
    """Posterior means after 30 of 100 draws."""
    u, a = mixtures.gibbs(_events(spark, d).select("ranking_id", "pos", "item_id"), ITEMS, 2, mixtures.random_start(ITEMS, 2), samples=100, burn=30)
    return estimators.to_frame(spark, u)


@query
def posterior_draws(spark, d):
    """Two chains of 40 draws a mixture of users' rankings: mean, spread and R-hat of utilities and weights."""
    store = draws.Store(spark)
    mixtures.gibbs(_events(spark, d).select("ranking_id", "pos", "item_id"), ITEMS, 2, mixtures.random_start(ITEMS, 2), samples=40, burn=10, chains=2, store=store, alpha=5.0, c=5.0, d=1.0)
    kept = draws.relabel(store.read().where("draw >= 10"))
    both = draws.summary(kept).join(draws.r_hat(kept).withColumnRenamed("component", "c").withColumnRenamed("item", "i"), F.expr("component = c and item <=> i"))
    return both.select("component", "item", "mean", "sd", "draws", "r_hat")


# -- clustering and low rank ---------------------------------------------------------------------------------------------------------


@query
def spectral_clustering(spark, d):
    labels = clustering.spectral_clustering(embeddings.pairwise(_orders(spark, d), ITEMS), 10, 2)
    return labels.groupBy("label").agg(F.count("*").alias("n"))


@query
def heuristic_pair_weight(spark, d):
    r = _events(spark, d)
    w = clustering.heuristic_pair_weight(embeddings.pairwise(r, ITEMS), 10, r.select("ranking_id").distinct().count())
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(w)], "k int, w double")


def _signed(v):
    """Columns whose entry of largest magnitude is positive."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


@query
def leading_directions(spark, d):
    s, v = lowrank.right_vectors(lowrank.Rows(embeddings.pairwise(_orders(spark, d), ITEMS), 10), 2)
    rows = [(j, k, float(s[j]), float(x)) for j, column in enumerate(_signed(v).T) for k, x in enumerate(column)]
    return spark.createDataFrame(rows, "direction int, k int, s double, loading double").withColumns({"s": r6(F.col("s"), 3), "loading": r6(F.col("loading"), 4)})


@query
def projected_rankings(spark, d):
    """Each ranking on the leading direction of all of them."""
    rows = lowrank.Rows(embeddings.pairwise(_orders(spark, d), ITEMS), 10)
    _, v = lowrank.right_vectors(rows, 1)
    return rows.project(_signed(v)).select("ranking_id", r6(F.col("z")[0], 4).alias("z"))


@query
def low_rank_model(spark, d):
    p = R.dense(R.pairwise_matrix(R.comparisons(tables.brand_rankings(spark, d)), "all"), BRANDS)
    model = glrm.GLRM(p, k=2, mask=p > 0).fit(20)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(model.history)], "step int, objective double")


# -- privacy, splits, generators --------------------------------------------------------------------------------------------------------


@query
def randomized_response(spark, d):
    return privacy.randomized_response(tables.binary_responses(spark, d), 1.0)


@query
def private_rasch(spark, d):
    return privacy.private_rasch(tables.binary_responses(spark, d), ITEMS, epsilon=1.0)


@query
def split_responses(spark, d):
    s = reshape.split_responses(tables.binary_responses(spark, d))
    return s.groupBy("item_id", "split").agg(F.count("*").alias("n"))


@query
def split_members(spark, d):
    return reshape.split_responses(tables.binary_responses(spark, d), 0.7, 3).select("user_id", "item_id", "split")


@query
def split_user_members(spark, d):
    train, test = reshape.split_users(tables.binary_responses(spark, d), 0.7, 0.2, 5)
    return train.select("user_id", F.lit("train").alias("split")).union(test.select("user_id", F.lit("test"))).distinct()


@query
def one_hot(spark, d):
    return reshape.one_hot(tables.graded_responses(spark, d), LEVELS)


@query
def score_pairs(spark, d):
    return reshape.score_pairs(tables.graded_responses(spark, d), 1, 0)


@query
def graded_to_binary(spark, d):
    return reshape.graded_to_binary(tables.graded_responses(spark, d), lambda s: s >= 2)


def _customers(spark, d, name="ranking_id"):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias(name))


def _able(spark, d):
    return _customers(spark, d, "user_id").withColumn("theta", (F.col("user_id") % 7 - 3) / 2)


@query
def generated_rankings(spark, d):
    return generators.rankings_of(_customers(spark, d), _measured(spark, d).where("component = 0"), "gumbel", 0.7)


@query
def generated_exponential_rankings(spark, d):
    """Rankings of customers under exponential noise; item 1's is normal."""
    return generators.rankings_of(_customers(spark, d), _measured(spark, d).where("component = 1"), "exponential", seed=4, noises={1: generators.normal_noise(0.7)})


@query
def generated_mixture(spark, d):
    return generators.mixture_rankings_of(_customers(spark, d), np.array(U), np.array(ALPHA))


@query
def generated_responses(spark, d):
    return generators.graded(_able(spark, d), irt.levels_frame(spark, np.array(BETAS)))


@query
def svt_reconstruction(spark, d):
    p = R.dense(R.pairwise_matrix(R.comparisons(_events(spark, d)), "all"), ITEMS)
    m = solvers.nuclear(p, 0.1)
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(ITEMS) for j in range(ITEMS)], "i int, j int, x double")


# -- further operators, one query each ------------------------------------------------------------------------------------------------------


@query
def centred_utilities(spark, d):
    return R.centre(_measured(spark, d).withColumn("u", F.col("u") + F.col("component") + F.col("item_id") / 10)).select("component", "item_id", r6(F.col("u")).alias("u"))


@query
def normalised_alpha(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.ascii("o_orderstatus").alias("component")).agg(F.count("*").cast("double").alias("a"))
    return R.normalise_alpha(o).select("component", r6(F.col("a")).alias("a"))


@query
def pl_posterior_hard(spark, d):
    q = R.posterior(R.pl_log_likelihood(_orders(spark, d), _u(spark)), _alpha(spark), hard=True)
    return q.where("q = 1").groupBy("component").agg(F.count("*").alias("n"))


@query
def pl_posterior_trimmed(spark, d):
    q = R.posterior(R.pl_log_likelihood(_orders(spark, d), _u(spark)), _alpha(spark), trim=0.25)
    return q.select("ranking_id", "component", r6(F.col("q")).alias("q"))


@query
def ell2_mixture(spark, d):
    u = _measured(spark, d)
    swapped = u.select((1 - F.col("component")).alias("component"), "item_id", (F.col("u") + F.col("item_id") / 10).alias("u"))
    return spark.createDataFrame([(round(float(metrics.ell2_mixture(u, swapped)), 6),)], "ell2 double")


@query
def frobenius_difference(spark, d):
    """Log ratios of successive levels among odd and even users, against themselves with classes swapped and shifted."""
    n = tables.graded_responses(spark, d).groupBy((F.col("user_id") % 2).cast("int").alias("component"), "item_id").agg(*[F.sum((F.col("score") == k).cast("int")).alias(f"n{k}") for k in range(LEVELS + 1)])
    x = n.select("component", "item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.log((F.col(f"n{k - 1}") + 1) / (F.col(f"n{k}") + 1)).alias("beta")) for k in range(1, LEVELS + 1)])).alias("b")).select("component", "item_id", "b.*")
    y = x.withColumn("component", 1 - F.col("component")).withColumn("beta", F.col("beta") + 0.1)
    return spark.createDataFrame([(round(float(metrics.frobenius_difference(x, y)), 6),)], "difference double")


@query
def mixture_evaluation(spark, d):
    r = tables.graded_responses(spark, d)
    users = r.select("user_id").distinct()
    theta = users.select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("component")).withColumn("theta", (F.col("user_id") % 7 - 3) / 2.0 + F.col("component") / 2.0)
    q = theta.select("user_id", "component", F.when(F.col("component") == 0, 0.7).otherwise(0.3).alias("q"))
    betas = irt.levels_frame(spark, np.array([BETAS, BETAS]) + np.array([0.0, 0.5])[:, None, None])
    return metrics.evaluate_mixture(theta, betas, q, r).select(r6(F.col("error")).alias("error"), r6(F.col("loglik"), 3).alias("loglik"))


@query
def mean_pairwise_link(spark, d):
    x = generators.mean_pairwise(_measured(spark, d).where("component = 0").select("item_id", "u"), Logistic(), ITEMS)
    return x.select("k", r6(F.col("x")).alias("x"))


@query
def composite_loglik_weighted(spark, d):
    pairs = spark.createDataFrame([(i, j, 0.5 + 0.1 * (i + j)) for i in range(ITEMS) for j in range(i + 1, ITEMS) if (i + j) % 2], "i int, j int, w double")
    places = spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.5), (1, 2, 1.5)], "pos_a int, pos_b int, w double")
    ll = mixtures.pair_log_likelihood(_orders(spark, d), _u(spark), Logistic(), pairs, places)
    return ll.select("ranking_id", "component", r6(F.col("loglik")).alias("loglik"))


@query
def antisymmetric_pairs(spark, d):
    return embeddings.all_pairs(embeddings.pairwise(_orders(spark, d), ITEMS), ITEMS).select("ranking_id", "i", "j", "x")


@query
def responses_unpivoted(spark, d):
    wide = reshape.pivot(tables.binary_responses(spark, d), ITEMS)
    return reshape.unpivot(wide)


@query
def split_users(spark, d):
    train, test = reshape.split_users(tables.binary_responses(spark, d), 0.7, 0.2)
    return train.select(F.lit("train").alias("split"), "user_id").union(test.select(F.lit("test"), "user_id")).groupBy("split").agg(F.countDistinct("user_id").alias("users"))


@query
def masked_cells(spark, d):
    p = R.pairwise_matrix(R.comparisons(_events(spark, d)), "all").select(F.col("loser").alias("i"), F.col("winner").alias("j"), r6(F.col("p")).alias("p"))
    return reshape.mask(p, p.where("(i + j) % 2 = 0"), complement=True)


@query
def random_pairs(spark, d):
    """A random graph of the brands there are."""
    n = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().count()
    return reshape.random_pairs(spark, n, 0.3, 1, symmetric=True)


def _weekly(spark, d):
    """(t, item_id, u): how often each event type came in a week, as a logarithm."""
    e = estimators.dense_ids(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "label"), "label")
    return e.groupBy(F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("t"), "item_id").agg(F.log(F.count("*").cast("double")).alias("u"))


@query
def timed_utilities(spark, d):
    """Utilities that vary with time, for as many items and steps as the events have types and weeks."""
    seen = _weekly(spark, d).agg(F.countDistinct("item_id"), F.countDistinct("t")).first()
    return generators.time_varying_utilities(spark, seen[0], seen[1], seed=2).select("t", "item_id", r6(F.col("u")).alias("u"))


@query
def timed_rankings(spark, d):
    return generators.timed_rankings(_weekly(spark, d), m=20)


@query
def timed_partial_rankings(spark, d):
    timed = _weekly(spark, d)
    return generators.timed_partial_rankings(timed, timed.where("item_id < 3").select("t", F.lit(0).alias("menu_id"), "item_id"), m=20)


@query
def timed_comparisons(spark, d):
    return generators.time_varying_comparisons(_weekly(spark, d), ITEMS, draws=10, p0=0.5)


@query
def menu_rankings(spark, d):
    """Random menus of the sizes that customers' rankings have, ranked fifty times each."""
    sizes = _orders(spark, d).groupBy("ranking_id").count().where("count > 1").select("count").distinct().orderBy("count").collect()
    menus = generators.menus(spark, ITEMS, [r["count"] for r in sizes], 1)
    return generators.partial_rankings(_measured(spark, d).where("component = 1").select("item_id", "u"), menus, "normal", 50)


@query
def generated_comparisons(spark, d):
    p = R.dense(R.pairwise_matrix(R.comparisons(_events(spark, d)), "all"), ITEMS)
    return generators.comparisons_from_p(p, reshape.random_pairs(spark, ITEMS, 1.0), 100)


@query
def generated_binary(spark, d):
    return generators.rasch(_able(spark, d), _beta(spark), 0.8)


@query
def connectivity(spark, d):
    g = graph.comparison_graph(R.pairwise_matrix(R.comparisons(tables.brand_rankings(spark, d)), "none"))
    return spark.createDataFrame([(bool(graph.connected(g, range(BRANDS))),)], "connected boolean")


@query
def disjoint_pair_clusters(spark, d):
    labels = clustering.disjoint_pair_clustering(embeddings.pairwise(_orders(spark, d), ITEMS), ITEMS, 2)
    return labels.groupBy("label").agg(F.count("*").alias("n"))


@query
def random_projection(spark, d):
    z = clustering.low_rank(embeddings.pairwise(_events(spark, d), ITEMS), 10, 2, "gaussian")
    return z.select("ranking_id", F.size("z").alias("dimensions"))


@query
def weekly_pairwise_counts(spark, d):
    """Comparisons of event types within weeks: each user and week is a ranking of its own."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int"))
    f = estimators.dense_ids(e.groupBy("user_id", "t", F.col("event_type").alias("label")).agg(F.min("ts").alias("ts")), "label")
    by = Window.partitionBy("user_id", "t").orderBy("ts", "label")
    r = f.select((F.col("user_id") * 8 + F.col("t")).cast("long").alias("ranking_id"), (F.row_number().over(by) - 1).cast("int").alias("pos"), "item_id")
    c = R.comparisons(r)
    return c.groupBy((F.col("ranking_id") % 8).cast("int").alias("t"), "winner", "loser").agg(F.count("*").alias("n"))


@query
def privacy_budgets(spark, d):
    """Budgets of one response of each customer: by noise, and by shuffling as many as there are."""
    users = spark.read.parquet(f"{d}/customer.parquet").count()
    return spark.createDataFrame([("gauss", round(privacy.epsilon_gauss(1.0, 1 / users**2), 6)), ("shuffle", round(privacy.epsilon_shuffle(1.0, 1e-6, 1000 * users), 6))], "mechanism string, epsilon double")


# -- what the queries above do not reach ------------------------------------------------------------------------------------------------


@query
def rank_centrality_pairs(spark, d):
    """Scores from pairwise shares, without the rankings."""
    pairs = R.pairwise_matrix(R.comparisons(_orders(spark, d)), "all", 1.0)
    return estimators.rank_centrality_from_pairs(pairs, ITEMS).select("item_id", r6(F.col("u"), 4).alias("u"))


@query
def pcm_chain(spark, d):
    """The chain between scores 1 and 0, whose stationary mass gives the first level's difficulties."""
    y = irt.level_counts(tables.graded_responses(spark, d), LEVELS).where("k = 1 and l = 0")
    chain, _ = chains.graded(y)
    return chain.select("src", "dst", r6(F.col("p")).alias("p"))


@query
def brand_type_grid(spark, d):
    """All combinations of brands and event types."""
    brands = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct()
    return reshape.cartesian(brands, spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct())


@query
def low_rank_reconstruction(spark, d):
    """Signed pair embeddings of order rankings, as far as their two leading directions tell."""
    z = clustering.low_rank(embeddings.pairwise(_orders(spark, d), ITEMS), 10, 2, "alternating")
    return z.select("ranking_id", F.posexplode("z").alias("k", "x")).withColumn("x", r6(F.col("x"), 4))


@query
def soft_threshold_reconstruction(spark, d):
    """The same with singular values less the square root of the number of rankings, and no others."""
    r = _orders(spark, d)
    lam = float(r.select("ranking_id").distinct().count()) ** 0.5 / 2
    z = clustering.low_rank(embeddings.pairwise(r, ITEMS), 10, 2, "nuclear", lam=lam)
    return z.select("ranking_id", F.posexplode("z").alias("k", "x")).withColumn("x", r6(F.col("x"), 4))


@query
def pl_mixture_loglik_normalised(spark, d):
    """The mixture's likelihood, from utilities that are not centred and weights that do not add to 1."""
    u = _u(spark).withColumn("u", F.col("u") + 3 + F.col("component"))
    return metrics.mixture_log_likelihood(_orders(spark, d), u, mixtures.alpha_frame(spark, 5 * np.array(ALPHA))).select(r6(F.col("loglik")).alias("loglik"))


@query
def running_pairwise_counts(spark, d):
    """What the streaming counts come to once all of a table has arrived."""
    return pairwise.running_counts(R.comparisons(_events(spark, d))).select("winner", "loser", F.col("cnt").cast("long").alias("cnt"))


@query
def noisy_event_counts(spark, d):
    """Counts of event pairs under two-sided geometric noise."""
    w = R.dense(R.pairwise_counts(R.comparisons(_events(spark, d))).withColumnRenamed("cnt", "p"), ITEMS, diagonal=0.0)
    n = privacy.noisy_counts(w, "geometric", 1.0, 3)
    return spark.createDataFrame([(i, j, float(n[i, j])) for i in range(ITEMS) for j in range(ITEMS) if i != j], "loser int, winner int, cnt double")
