"""Accuracy, likelihood and efficiency metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import solvers
from . import ordering
from . import rankings as R


def top_k_accuracy(truth: DataFrame, estimate: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Overlap of the first k of two rankings (item_id, pos), over k; with ``by``, of each ranking of ``truth``."""
    keys = [by] if by else []
    e = estimate.where(F.col("pos") < k).select("item_id", F.lit(1).alias("in_both"))
    hits = truth.where(F.col("pos") < k).select(*keys, "item_id").join(e, "item_id", "left")
    return hits.groupBy(*keys).agg((F.count("in_both") / k).alias("accuracy"))


def kendall_distance(truth: DataFrame, estimate: DataFrame, by: str | None = None) -> DataFrame:
    """Discordant pairs over all pairs of two rankings (item_id, pos) of the same items; with ``by``, of each ranking of ``truth``.

    Rankings are dealt and sorted once, and a batch's discordant pairs counted together in n log n steps; a ranking
    of one item has a null distance.
    """
    key = F.col(by) if by else F.lit(0)
    j = truth.select(key.alias("by"), "item_id", F.col("pos").alias("t")).join(estimate.select("item_id", F.col("pos").alias("e")), "item_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, e in ordering.whole_groups(batches):
            swaps, n = np.bincount(row, weights=ordering.earlier_larger(row, e), minlength=len(ids)), np.bincount(row, minlength=len(ids))
            pairs = n * (n - 1) / 2
            yield pa.RecordBatch.from_arrays([ids, pa.array(swaps / np.maximum(pairs, 1), mask=pairs == 0)], ["by", "distance"])

    kind = j.schema["by"].dataType.simpleString()
    out = j.select("by", "e", "t").repartition("by").sortWithinPartitions("by", "t").select("by", "e").mapInArrow(work, f"by {kind}, distance double")
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def ell2(a: DataFrame, b: DataFrame) -> DataFrame:
    """L2 norm of the centred difference of two utilities (item_id, u)."""
    d = a.select("item_id", F.col("u").alias("x")).join(b.select("item_id", F.col("u").alias("y")), "item_id").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.sqrt(F.sum(F.col("d") * F.col("d")) - F.sum("d") * F.sum("d") / F.count("*")).alias("ell2"))


def _cost(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> np.ndarray:
    """Squared differences between all components of two tables: components x components numbers."""
    x = a.select(F.col("component").alias("ca"), *keys, F.col(value).alias("va")).join(b.select(F.col("component").alias("cb"), *keys, F.col(value).alias("vb")), keys)
    rows = x.groupBy("ca", "cb").agg(F.sum(F.pow(F.col("va") - F.col("vb"), 2)).alias("c")).collect()
    ca, cb = sorted({r.ca for r in rows}), sorted({r.cb for r in rows})
    out = np.zeros((len(ca), len(cb)))
    for r in rows:
        out[ca.index(r.ca), cb.index(r.cb)] = r.c
    return out


def ell2_mixture(a: DataFrame, b: DataFrame) -> float:
    """Least L2 distance of centred mixtures (component, item_id, u) over matchings of components."""
    return math.sqrt(max(0.0, solvers.best_permutation(_cost(R.centre(a), R.centre(b), ["item_id"], "u"))[0]))


def frobenius_difference(a: DataFrame, b: DataFrame) -> float:
    """Least squared difference of difficulties (component, item_id, level, beta) over matchings of components."""
    return solvers.best_permutation(_cost(a, b, ["item_id", "level"], "beta"))[0]


def pairwise_log_likelihood(pairs: DataFrame, utilities: DataFrame, link) -> DataFrame:
    """Sum of p log F(U_winner - U_loser) over (loser, winner, p)."""
    w, l = utilities.select(F.col("item_id").alias("winner"), F.col("u").alias("uw")), utilities.select(F.col("item_id").alias("loser"), F.col("u").alias("ul"))
    return pairs.join(w, "winner").join(l, "loser").agg(F.sum(F.col("p") * F.log(link.cdf_col(F.col("uw") - F.col("ul")))).alias("loglik"))


def mixture_log_likelihood(rankings: DataFrame, utilities: DataFrame, alpha: DataFrame, normalise: bool = True) -> DataFrame:
    """Mean over rankings of the log of the mixture's Plackett-Luce likelihood."""
    if normalise:
        utilities, alpha = R.centre(utilities), R.normalise_alpha(alpha)
    q = R.posterior(R.pl_log_likelihood(rankings, utilities), alpha)
    return q.groupBy("ranking_id").agg(F.max("lse").alias("lse")).agg(F.avg("lse").alias("loglik"))


def confusion(labels: DataFrame) -> DataFrame:
    """(truth, predicted, n)."""
    return labels.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def clustering_accuracy(labels: DataFrame) -> float:
    """Share of rows on the best one-to-one matching of predicted to true labels."""
    rows = confusion(labels).collect()  # labels x labels
    t, p = sorted({r.truth for r in rows}), sorted({r.predicted for r in rows})
    n = max(len(t), len(p))
    m = np.zeros((n, n))
    for r in rows:
        m[t.index(r.truth), p.index(r.predicted)] = r.n
    return -solvers.best_permutation(-m)[0] / m.sum() if m.sum() else 0.0


def cramer_rao(difficulties: DataFrame, abilities: DataFrame, p: float = 1.0) -> DataFrame:
    """(item_id, bound): 1 / sum over users of p s (1 - s), s = sigmoid(theta - beta).

    Equal abilities are counted first; each task then sums its own over all items, so that users and items are never
    joined: what is shuffled is a row an item and task.
    """
    items = difficulties.select("item_id", F.col("beta").cast("double").alias("beta")).toArrow()  # item-sized
    ids, beta = items.column("item_id").combine_chunks(), items.column("beta").to_numpy()
    kind = difficulties.schema["item_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(beta))
        for b in batches:
            theta, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(theta), step := max(1, (1 << 20) // max(1, len(beta)))):
                s = 1 / (1 + np.exp(beta[None, :] - theta[at : at + step, None]))
                total += n[at : at + step] @ (p * s * (1 - s))
        yield pa.RecordBatch.from_arrays([ids, pa.array(total)], ["item_id", "information"])

    counted = abilities.where("theta is not null").groupBy(F.col("theta").cast("double").alias("theta")).agg(F.count("*").alias("n"))
    sums = counted.mapInArrow(work, f"item_id {kind}, information double").groupBy("item_id").agg(F.sum("information").alias("s"))
    return sums.where("s > 0").select("item_id", (1 / F.col("s")).alias("bound"))


def marginal_response(difficulties: DataFrame, sigma: float = 1.0, mean: float = 0.0, kappa: float = 10.0, steps: int = 2000) -> DataFrame:
    """(item_id, p): integral of the normal density times sigmoid(x - beta), by trapezoids, at most 1."""
    x = lambda k: mean - kappa * sigma + k * (2 * kappa * sigma / steps)
    f = lambda k: F.when((k == 0) | (k == steps), 0.5).otherwise(1.0) * F.exp(-0.5 * F.pow((x(k) - mean) / sigma, 2)) / (sigma * math.sqrt(2 * math.pi)) / (1 + F.exp(F.col("beta") - x(k)))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, k: a + f(k))
    return difficulties.select("item_id", F.least(F.lit(1.0), total * (2 * kappa * sigma / steps)).alias("p"))


def heldout_log_likelihood(probabilities: DataFrame, test: DataFrame) -> DataFrame:
    """Mean Bernoulli log-likelihood of responses (item_id, score) under (item_id, p)."""
    j = test.join(probabilities, "item_id")
    return j.agg(F.avg(F.when(F.col("score") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))).alias("loglik"))


def auc(scored: DataFrame, score: str = "p", label: str = "score") -> DataFrame:
    """Area under the ROC curve.  Ties count half.

    Scores are counted by value, the values dealt to ranges, and negatives below a value found by prefix sums of
    ranges and within them, so that no task meets all values.
    """
    g = scored.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.sum((F.col(label) != 1).cast("double")).alias("neg"))
    return ordering.sums_before(g, ["s"], "neg", "below").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pcm_probabilities(theta: Column, betas: Column) -> Column:
    """Array of P(score = 0 .. L) of the partial-credit model: softmax of k theta - (beta_1 + .. + beta_k)."""
    steps = F.aggregate(betas, F.array(F.lit(0.0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + theta - b)))
    weights = let(steps, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
    return let(weights, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total)))


def pcm_moments(theta: Column, betas: Column) -> Column:
    """(mean, var) of the total score over items, from an array of the items' betas; each level is met once.

    An item's weights are summed against the greatest so far, so that none overflows.
    """
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("z"), F.lit(0.0).alias("top"), F.lit(1.0).alias("s0"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def level(a: Column, b: Column) -> Column:
        def add(z: Column) -> Column:
            def scaled(w: Column) -> Column:
                old, new = F.when(z <= a["top"], F.lit(1.0)).otherwise(w), F.when(z <= a["top"], w).otherwise(F.lit(1.0))
                k = a["k"] + 1.0
                return F.struct(k.alias("k"), z.alias("z"), F.greatest(z, a["top"]).alias("top"), (a["s0"] * old + new).alias("s0"), (a["s1"] * old + k * new).alias("s1"), (a["s2"] * old + k * k * new).alias("s2"))

            return let(F.exp(-F.abs(z - a["top"])), scaled)

        return let(a["z"] + theta - b, add)

    def item(total: Column, b: Column) -> Column:
        return let(F.aggregate(b, start, level), lambda m: let(m["s1"] / m["s0"], lambda mean: F.struct((total["mean"] + mean).alias("mean"), (total["var"] + m["s2"] / m["s0"] - mean * mean).alias("var"))))

    return F.aggregate(betas, F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var")), item)


def likeliest(probs: Column) -> Column:
    """Score of the largest probability; the least of those that tie to 12 places."""
    return let(F.transform(probs, lambda v: F.round(v, 12)), lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def level_arrays(difficulties: DataFrame) -> DataFrame:
    """([component,] item_id, betas) from (.., level, beta)."""
    keys = [c for c in ("component", "item_id") if c in difficulties.columns]
    return difficulties.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "beta"))), lambda x: x["beta"]).alias("betas"))


def heldout_ratings(abilities: DataFrame, difficulties: DataFrame, heldout: DataFrame) -> DataFrame:
    """(user_id, item_id, score, predicted, p): the likeliest score and the probability of the actual one."""
    j = heldout.join(abilities, "user_id").join(level_arrays(difficulties), "item_id").withColumn("probs", pcm_probabilities(F.col("theta"), F.col("betas")))
    return j.select("user_id", "item_id", "score", likeliest(F.col("probs")).alias("predicted"), F.get("probs", F.col("score")).alias("p"))


def evaluate_mixture(abilities: DataFrame, difficulties: DataFrame, q: DataFrame, ratings: DataFrame) -> DataFrame:
    """(error, loglik): misses of the likeliest class's likeliest score; sum of log of the mixture's probability."""
    best = Window.partitionBy("user_id", "item_id")
    j = ratings.join(q, "user_id").join(abilities, ["user_id", "component"]).join(level_arrays(difficulties), ["component", "item_id"])
    j = j.withColumn("probs", pcm_probabilities(F.col("theta"), F.col("betas"))).withColumn("first", F.row_number().over(best.orderBy(F.desc("q"), "component")))
    miss = (likeliest(F.col("probs")) != F.col("score")).cast("double")
    g = j.groupBy("user_id", "item_id").agg(F.sum(F.when(F.col("first") == 1, miss)).alias("miss"), F.sum(F.col("q") * F.get("probs", F.col("score"))).alias("p"))
    return g.agg(F.avg("miss").alias("error"), F.sum(F.log("p")).alias("loglik"))
