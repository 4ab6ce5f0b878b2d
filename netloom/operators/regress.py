"""Stepwise regression by p-values, elastic-net logistic models, elastic-net Cox models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.ranks import running
from netloom.operators import cox as models


def support_filter(df: DataFrame, columns: Sequence[str], support: int = 1) -> list[str]:
    """The columns with several values whose less frequent ones make up ``support`` rows together."""
    if support <= 0 or not columns:
        return list(columns)
    long = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot([], [f"`{c}`" for c in columns], "c", "v").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.count(F.lit(1)).alias("kinds"), (F.sum("n") - F.max("n")).alias("minor"))
    good = {r["c"] for r in counts.where((F.col("kinds") > 1) & (F.col("minor") >= support)).collect()}
    return [c for c in columns if c in good]


def p_values(df: DataFrame, y: str, columns: Sequence[str], learner: str = "ols") -> dict[str, float]:
    """The p-value of each column's coefficient in a model with an intercept; 1 where none can be had."""
    packed = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in [*columns, y])))
    try:
        if learner == "ols":
            values = LinearRegression(labelCol=y, solver="normal").fit(packed).summary.pValues
        elif learner == "logit":
            values = GeneralizedLinearRegression(labelCol=y, family="binomial").fit(packed).summary.pValues
        else:
            raise ValueError("a learner is 'ols' or 'logit'")
    except Exception as e:  # a singular design has no p-values
        if "singular" not in str(e).lower() and "UnsupportedOperation" not in str(e):
            raise
        return dict.fromkeys(columns, 1.0)
    return {c: (1.0 if p != p else p) for c, p in zip(columns, values, strict=False)}


def forward(df: DataFrame, y: str, columns: Sequence[str], threshold: float = 0.05, learner: str = "ols", included: Sequence[str] = (), once: bool = False) -> list[str]:
    """Add the column of the lowest p-value while it is below the threshold."""
    kept = list(included)
    while left := [c for c in columns if c not in kept]:
        tried = {c: p_values(df, y, [*kept, c], learner)[c] for c in left}
        best = min(left, key=lambda c: (tried[c], columns.index(c)))
        if tried[best] >= threshold:
            break
        kept.append(best)
        if once:
            break
    return kept


def backward(df: DataFrame, y: str, columns: Sequence[str], threshold: float = 0.05, learner: str = "ols") -> list[str]:
    """Drop the column of the highest p-value while it is above the threshold."""
    kept = list(columns)
    while kept:
        p = p_values(df, y, kept, learner)
        worst = max(kept, key=lambda c: (p[c], -kept.index(c)))
        if p[worst] <= threshold:
            break
        kept.remove(worst)
    return kept


def stepwise(df: DataFrame, y: str, columns: Sequence[str], threshold_in: float = 0.05, threshold_out: float = 0.05, support: int = 1, learner: str = "ols") -> list[str]:
    """Forward steps, each followed by backward ones; a column dropped twice ends the search."""
    columns, df = support_filter(df, columns, support), df.persist()
    kept: list[str] = []
    dropped: set[str] = set()
    while True:
        new = forward(df, y, columns, threshold_in, learner, kept, once=True)
        changed, kept = new != kept, new
        while changed and kept:
            p = p_values(df, y, kept, learner)
            worst = max(kept, key=lambda c: (p[c], -kept.index(c)))
            if p[worst] <= threshold_out:
                break
            if worst in dropped:
                changed = False
                break
            kept.remove(worst)
            dropped.add(worst)
        if not changed:
            df.unpersist()
            return kept


# ---- logistic ------------------------------------------------------------------------------------


def _place(key: str, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def split(df: DataFrame, key: str, share: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key."""
    u = _place(key, seed)
    return df.where(u >= share), df.where(u < share)


def auc(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(auc, ap): area under the ROC curve by mid-ranks, and average precision, from counts by score."""
    each = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    # What lies below or above a score is what is left of the totals, one row.
    each = running(each.where(F.col("s").isNotNull()), [], "s", {"upto_p": "p", "upto_n": "n"})
    each = each.join(F.broadcast(each.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    tp, fp = F.col("all_p") - F.col("upto_p") + F.col("p"), F.col("all_n") - F.col("upto_n") + F.col("n")
    each = each.select("p", "n", (F.col("upto_n") - F.col("n")).alias("below"), tp.alias("tp"), (tp + fp).alias("all"))
    sums = each.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0))).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("tp") / F.col("all").cast("double")).alias("q"))
    return sums.select((F.col("a") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"), (F.col("q") / F.nullif("p", F.lit(0))).alias("ap"))


def confusion(scored: DataFrame, predicted: str = "predicted", y: str = "y") -> DataFrame:
    """(tp, fp, tn, fn, mcc): Matthews' correlation, null where a row or column is empty."""
    of = lambda a, b, n: F.count_if((F.col(predicted) == a) & (F.col(y) == b)).alias(n)
    c = scored.agg(of(1, 1, "tp"), of(1, 0, "fp"), of(0, 0, "tn"), of(0, 1, "fn"))
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    base = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.withColumn("mcc", (tp * tn - fp * fn) / F.nullif(base, F.lit(0.0)))


def coef_table(coefs: DataFrame) -> DataFrame:
    """(variable, coef, abs, percent, cumulative, odds_ratio), by falling size, of (variable, coef)."""
    total = F.sum(F.abs("coef")).over(Window.partitionBy(F.lit(1)))
    order = Window.orderBy(F.col("abs").desc(), "variable").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = coefs.select("variable", "coef", F.abs("coef").alias("abs"), (100 * F.abs("coef") / F.nullif(total, F.lit(0.0))).alias("percent"))
    return out.withColumn("cumulative", F.sum("percent").over(order)).withColumn("odds_ratio", F.exp("coef"))


def logistic(df: DataFrame, y: str, columns: Sequence[str], key: str, c_values: Sequence[float] = tuple(np.logspace(-3, 3, 20)), l1_ratios: Sequence[float] = (0.0, 0.5, 1.0), folds: int = 5, most_folds: int = 10, test_size: float = 0.25, seed: int = 0) -> dict:
    """The elastic-net model whose cross-validated AUC is the best: {'params', 'coef', 'scores', 'predictions'}.

    Columns are standardised; C counts rows, so Spark's penalty is 1 / (C n).  While all
    coefficients are 0, one more fold is tried, up to ``most_folds``.  One model is chosen for all
    scores, and an undefined score never wins.
    """
    own = df.select(F.col(key).alias("key"), F.col(f"`{y}`").cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).na.drop()
    packed = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(own)
    train, test = split(packed, "key", test_size, seed) if test_size else (packed, packed)
    scaler = StandardScaler(inputCol="_v", outputCol="features", withMean=True).fit(train)
    train, test = (scaler.transform(t).select("key", "y", "features") for t in (train, test))
    train = train.persist()
    n = train.count()
    score = lambda model, data: model.transform(data).select(F.get(vector_to_array("probability"), F.lit(1)).alias("score"), "y", F.col("prediction").cast("int").alias("predicted"), "key")
    fit = lambda data, c, l1: LogisticRegression(labelCol="y", regParam=1 / (c * max(n, 1)), elasticNetParam=l1, standardization=False, maxIter=200).fit(data)
    best, model = None, None
    for k in range(folds, most_folds + 1):
        fold = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(k))
        results = []
        for l1 in l1_ratios:
            for c in c_values:
                aucs = [auc(score(fit(train.where(fold != i), c, l1), train.where(fold == i))).first()["auc"] for i in range(k)]
                known = [a for a in aucs if a is not None]
                results.append((-(sum(known) / len(known)) if known else 1.0, float(c), float(l1)))
        best = min(results)
        model = fit(train, best[1], best[2])
        if model.coefficients.numNonzeros():
            break
    rows = [(c, float(v)) for c, v in zip(columns, model.coefficients, strict=True)]
    predictions = score(model, test)
    scores = auc(predictions).join(confusion(predictions))
    train.unpersist()
    return {"params": {"C": best[1], "l1_ratio": best[2], "cv_auc": -best[0]}, "coef": coef_table(df.sparkSession.createDataFrame(rows, "variable string, coef double")), "scores": scores, "predictions": predictions, "model": model}


def elastic_nets(x: np.ndarray, y: np.ndarray, use: np.ndarray, penalty: np.ndarray, l1: np.ndarray, rounds: int = 1000, still: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of many logistic models of one table, each of its own rows ``use``, by
    coordinate descent below quadratic bounds of the loss, so that no step makes it larger.  Models of
    rows of one class keep zeros."""
    beta, base = np.zeros((len(use), x.shape[1])), np.zeros(len(use))
    both = np.flatnonzero((use & (y == 1)).any(1) & (use & (y == 0)).any(1))
    for at in np.array_split(both, max(1, -(-len(both) * len(x) // 2_000_000))):
        u, a1, a2 = use[at].astype(float), (penalty * l1)[at], (penalty * (1 - l1))[at]
        b, c, eta = beta[at], base[at], np.zeros((len(at), len(x)))
        for _ in range(rounds if len(at) else 0):
            far, m, change = np.abs(eta), u.sum(1), np.zeros(len(at))
            h = u * np.where(far > 1e-6, np.tanh(far / 2) / np.maximum(2 * far, 1e-6), 0.25)
            r, bend = u * (y - 0.5) - h * eta, h @ (x * x) / m[:, None]
            for _ in range(3):
                d = r.sum(1) / h.sum(1)
                c, r, eta, change = c + d, r - h * d[:, None], eta + d[:, None], np.maximum(change, np.abs(d))
                for k in range(x.shape[1]):
                    g = r @ x[:, k] / m + bend[:, k] * b[:, k]
                    new = np.sign(g) * np.maximum(np.abs(g) - a1, 0) / (bend[:, k] + a2 + 1e-12)
                    d = new - b[:, k]
                    if d.any():
                        step = np.outer(d, x[:, k])
                        b[:, k], r, eta, change = new, r - h * step, eta + step, np.maximum(change, np.abs(d))
            beta[at], base[at] = b, c
            go = change > still
            at, u, a1, a2, b, c, eta = (z[go] for z in (at, u, a1, a2, b, c, eta))
            if not len(at):
                break
    return beta, base


def ranked(score: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """(auc, ap) as ``auc`` has them."""
    at = np.unique(score, return_inverse=True)[1]
    p, n = np.bincount(at, y == 1), np.bincount(at, y == 0)
    tp, every = (np.cumsum(z[::-1])[::-1] for z in (p, p + n))
    of = p.sum()
    return (float((p * (np.cumsum(n) - n / 2)).sum() / (of * n.sum())) if of and n.sum() else None), (float((p * tp / every).sum() / of) if of else None)


def logistic_here(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, folds: Mapping[int, np.ndarray], c_values: Sequence[float], l1_ratios: Sequence[float]) -> dict:
    """What ``logistic`` finds, for a table that a task holds: all folds and penalties are fitted together.
    ``folds`` has the rows' folds for each number of them that is tried."""
    n, spread = max(train.sum(), 1), x[train].std(0, ddof=1) if train.sum() > 1 else np.zeros(x.shape[1])
    x = (x - (x[train].mean(0) if train.any() else 0)) * np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)
    grid = [(float(c), float(l1)) for l1 in l1_ratios for c in c_values]
    probability = lambda beta, base, rows: 1 / (1 + np.exp(-np.clip(x[rows] @ beta + base, -700, 700)))
    for k, fold in folds.items():
        use = np.stack([train & (fold != i) for _ in grid for i in range(k)])
        beta, base = elastic_nets(x, y, use, np.repeat([1 / (c * n) for c, _ in grid], k), np.repeat([l1 for _, l1 in grid], k))
        results = []
        for g, (c, l1) in enumerate(grid):
            aucs = [ranked(probability(beta[g * k + i], base[g * k + i], train & (fold == i)), y[train & (fold == i)])[0] for i in range(k)]
            known = [a for a in aucs if a is not None]
            results.append((-(sum(known) / len(known)) if known else 1.0, c, l1))
        best = min(results)
        (beta,), (base,) = elastic_nets(x, y, train[None], np.array([1 / (best[1] * n)]), np.array([best[2]]))
        if beta.any():
            break
    p, own = probability(beta, base, test), y[test]
    guess = p > 0.5
    tp, fp, tn, fn = (float(((guess == a) & (own == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 0), (0, 1)))
    wide = np.sqrt((tp + fp) * (tp + fn)) * np.sqrt((tn + fp) * (tn + fn))
    auc_, ap = ranked(p, own)
    return {"l1_ratio": best[2], "penalty": best[1], "n_coeffs": int((beta != 0).sum()), "score_roc_auc": auc_, "score_ap": ap, "score_mcc": float((tp * tn - fp * fn) / wide) if wide else None}


def logistic_tables(tables: DataFrame, by: str, y: str, values: str, key: str, c_values: Sequence[float] = tuple(np.logspace(-3, 3, 20)), l1_ratios: Sequence[float] = (0.0, 0.5, 1.0), folds: int = 5, most_folds: int = 10, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """(by, l1_ratio, penalty, n_coeffs, score_roc_auc, score_ap, score_mcc): ``logistic`` for each of many
    tables, told apart by ``by``, each small enough for a task; ``values`` is the array of a subject's columns."""
    tried = range(folds, most_folds + 1)
    own = tables.select(by, F.col(key).alias("key"), F.col(y).cast("double").alias("y"), F.col(values).alias("x"), *([(_place(key, seed) < test_size).alias("test")] if test_size else [F.lit(None).cast("boolean").alias("test")]))
    own = own.withColumn("folds", F.array(*(F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(k)) for k in tried)))
    own = own.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def fit(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        x, fold, every = np.stack(rows["x"].to_numpy()).astype(float), np.stack(rows["folds"].to_numpy()), np.ones(len(rows), bool)
        test = rows["test"].to_numpy(bool) if test_size else every
        found = logistic_here(x, rows["y"].to_numpy(float), ~test if test_size else every, test, {k: fold[:, i] for i, k in enumerate(tried)}, c_values, l1_ratios)
        return pd.DataFrame([{by: name[0]} | found])

    return own.groupBy(by).applyInPandas(fit, f"`{by}` string, l1_ratio double, penalty double, n_coeffs int, score_roc_auc double, score_ap double, score_mcc double")


# ---- Cox -----------------------------------------------------------------------------------------


def _cox_terms(x: np.ndarray, time: np.ndarray, event: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the partial likelihood (Breslow) in the linear predictor; rows by
    falling time."""
    e = np.exp(np.clip(x @ beta, -50, 50))
    first = np.searchsorted(-time, -time, "right") - 1
    risk = np.cumsum(e)[first]
    add, add2 = np.where(event, 1 / risk, 0), np.where(event, 1 / risk**2, 0)
    later = lambda a: np.cumsum(a[::-1])[::-1][np.searchsorted(-time, -time, "left")]
    a, b = later(add), later(add2)
    return event - e * a, np.maximum(e * a - e * e * b, 1e-10)


def cox_fit(x: np.ndarray, time: np.ndarray, event: np.ndarray, alpha: float, l1_ratio: float, beta: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """Elastic-net Cox coefficients by coordinate descent on the quadratic approximation."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order], time[order], event[order].astype(float)
    n, beta = len(x), np.zeros(x.shape[1]) if beta is None else beta.copy()
    for _ in range(rounds):
        g, h = _cox_terms(x, time, event, beta)
        old, eta = beta.copy(), x @ beta
        z = eta + g / h
        r, scale = z - eta, (h[:, None] * x * x).sum(0) / n
        for _ in range(20):
            before = beta.copy()
            for k in range(x.shape[1]):
                u = (h * x[:, k] * r).sum() / n + scale[k] * beta[k]
                new = np.sign(u) * max(abs(u) - alpha * l1_ratio, 0) / (scale[k] + alpha * (1 - l1_ratio) + 1e-12)
                r += x[:, k] * (beta[k] - new)
                beta[k] = new
            if np.abs(beta - before).max(initial=0) < 1e-7:
                break
        if np.abs(beta - old).max(initial=0) < 1e-6:
            break
    return beta


def c_index(score: np.ndarray, time: np.ndarray, event: np.ndarray) -> float:
    good = tied = pairs = 0.0
    for i in np.flatnonzero(event):
        later = (time > time[i]) | ((time == time[i]) & ~event.astype(bool))
        pairs += later.sum()
        good += (score[i] > score[later]).sum()
        tied += (score[i] == score[later]).sum()
    return (good + tied / 2) / pairs if pairs else float("nan")


def _alphas(slope: float, l1: float, n_alphas: int) -> np.ndarray:
    """Falling penalties, from one that leaves no coefficient."""
    return slope / max(l1, 0.05) * np.logspace(0, -2, n_alphas)


def cox(df: DataFrame, duration: str, event: str, columns: Sequence[str], key: str, l1_ratios: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0), n_alphas: int = 20, folds: int = 5, seed: int = 0) -> dict:
    """{'params', 'coef', 'score'}: the elastic-net Cox model of the best cross-validated concordance.

    Subjects lie in blocks (``cox``).  One block is fitted on the driver, more in passes over them, all
    folds and l1 ratios of an alpha together; both fit the same model."""
    blocks = models.cohort(df, duration, event, columns, key, folds, seed)
    small = blocks.limit(2).collect() if blocks.limit(2).count() < 2 else None
    best, beta, score = _cox_here(small, columns, l1_ratios, n_alphas, folds) if small is not None else _cox_passes(blocks, len(columns), l1_ratios, n_alphas, folds)
    rows = [(c, float(b), float(np.exp(b))) for c, b in zip(columns, beta, strict=True)]
    return {"params": {"alpha": best[1], "l1_ratio": best[2], "cv_score": best[0]}, "score": score, "coef": df.sparkSession.createDataFrame(rows, "variable string, coef double, hr double")}


def _better(best: tuple | None, found: Sequence[float], alpha: float, l1: float) -> tuple:
    mean = np.nanmean(found) if not np.isnan(found).all() else -1.0
    return (float(mean), float(alpha), float(l1)) if best is None or mean > best[0] + 1e-12 else best


def _cox_here(rows: list, columns: Sequence[str], l1_ratios: Sequence[float], n_alphas: int, folds: int) -> tuple[tuple, np.ndarray, float]:
    t, e, fold, x = models.opened(rows[0]) if rows else (np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros((0, len(columns))))
    slope = np.abs(_cox_terms(x, t, e, np.zeros(x.shape[1]))[0] @ x).max() / max(len(x), 1)
    best = None
    for l1 in l1_ratios:
        betas = [None] * folds
        for alpha in _alphas(slope, l1, n_alphas):
            found = []
            for k in range(folds):
                inn = fold != k
                betas[k] = cox_fit(x[inn], t[inn], e[inn], alpha, l1, betas[k])
                found.append(c_index(x[~inn] @ betas[k], t[~inn], e[~inn]))
            best = _better(best, found, alpha, l1)
    beta = cox_fit(x, t, e, best[1], best[2])
    return best, beta, c_index(x @ beta, t, e)


def _cox_passes(blocks: DataFrame, p: int, l1_ratios: Sequence[float], n_alphas: int, folds: int) -> tuple[tuple, np.ndarray, float]:
    from netloom.operators.survival import concordances

    n, gradient, _ = models.sums(blocks, [(np.zeros(p), -1)])[0]
    slope, each = np.abs(gradient).max() / max(n, 1), [(l1, k) for l1 in l1_ratios for k in range(folds)]
    betas, scores = [np.zeros(p)] * len(each), {}
    for step in range(n_alphas):
        alphas = [_alphas(slope, l1, n_alphas)[step] for l1, _ in each]
        betas = models.fits(blocks, [(alpha, l1, k) for alpha, (l1, k) in zip(alphas, each, strict=True)], betas)
        held = models.scored(blocks, [(i, beta, k) for i, (beta, (_, k)) in enumerate(zip(betas, each, strict=True))])
        for r in concordances(held, "s", "t", "e", ["model"]).collect():
            l1 = each[r["model"]][0]
            scores.setdefault((l1, step), []).append(float("nan") if r["cindex"] is None else r["cindex"])
    best = None
    for l1 in l1_ratios:
        for step, alpha in enumerate(_alphas(slope, l1, n_alphas)):
            best = _better(best, scores.get((l1, step), [float("nan")]), alpha, l1)
    beta = models.fits(blocks, [(best[1], best[2], -1)], [np.zeros(p)])[0]
    return best, beta, concordances(models.scored(blocks, [(0, beta, -1)]), "s", "t", "e").first()["cindex"]


def find_survival_variable(df: DataFrame, duration: str, event: str, columns: Sequence[str]) -> DataFrame:
    """(variable, coef, cindex): a Cox model of each column alone, by falling concordance."""
    from netloom.operators.survival import concordance

    rows = []
    for c in columns:
        blocks = models.cohort(df, duration, event, [c])
        coef = models.fits(blocks, [(1e-6, 0.0, -1)], [np.zeros(1)])[0][0] if not blocks.isEmpty() else 0.0
        rows.append((c, float(coef), concordance(df.withColumn("_s", F.col(f"`{c}`") * float(np.sign(coef) or 1)), "_s", duration, event).first()["cindex"]))
    return df.sparkSession.createDataFrame(rows, "variable string, coef double, cindex double").orderBy(F.col("cindex").desc())


def boosted(*_, **__):
    """Not computed: there is no definition to compute."""
    raise NotImplementedError("boosted models aren't defined")
