"""Models fitted by sums that the executors make: choice models, logits and least squares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.kernels import choice_moments, ridge_logit, swap_walk
from loomwork.sources.store import cut


def _pack(values: Sequence[np.ndarray | float]) -> pd.DataFrame:
    return pd.DataFrame({"v": [np.concatenate([np.ravel(x) for x in values]).tolist()]})


def conditional_logit(df: DataFrame, group: str, outcome: str, features: Sequence[str], rounds: int = 15) -> DataFrame:
    """Exact conditional likelihood with several successes in a group; Newton steps, one pass each.

    Every group adds its likelihood, gradient and Hessian where it lies; a
    partition sends the driver one row.  Result: term, coefficient, se, z.
    """
    k, names = len(features), list(features)
    rows = df.select(group, F.col(outcome).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names])
    rows = cut(rows, "choices").repartition(group).sortWithinPartitions(group)

    def moments(beta: np.ndarray):
        def run(batches):
            total, held, last = np.zeros(1 + k + k * k), [], None

            def add(g: pd.DataFrame):
                nonlocal total
                x, y = g[names].to_numpy(), g["_y"].to_numpy()
                m = int(y.sum())
                if 0 < m < len(y):
                    value, mean, hess = choice_moments(x, m, beta)
                    total = total + np.concatenate([[(x @ beta)[y > 0].sum() - value], x[y > 0].sum(axis=0) - mean, hess.ravel()])

            for b in batches:
                for key, g in b.groupby(group, sort=False):
                    if last is not None and key != last:
                        add(pd.concat(held))
                        held = []
                    last = key
                    held.append(g)
            if held:
                add(pd.concat(held))
            yield _pack([total])

        got = rows.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        v = np.array([r["x"] for r in got])
        return v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)

    beta = np.zeros(k)
    for _ in range(rounds):
        _, gradient, information = moments(beta)
        step = np.linalg.solve(information + 1e-12 * np.eye(k), gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    return df.sparkSession.createDataFrame([(n, float(b), float(s), float(b / s)) for n, b, s in zip(names, beta, se, strict=True)], "term string, coefficient double, se double, z double")


def _moments(df: DataFrame, x: Sequence[str], extra: Sequence) -> np.ndarray:
    return np.array(df.agg(*extra).first(), dtype=float)


def logit(df: DataFrame, outcome: str, features: Sequence[str], cluster: str | None = None, l2: float = 0.0, rounds: int = 25) -> DataFrame:
    """Binomial logit with an intercept by Newton steps over DataFrame sums; cluster-robust errors where a cluster is named.

    ``l2`` penalises the features' coefficients, not the intercept.
    """
    names, spark = ["intercept", *features], df.sparkSession
    df = cut(df.select(outcome, *features, *([cluster] if cluster else [])), "logit")
    k = len(names)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(outcome).cast("double")
    pen, beta, info = np.diag([0.0] + [l2] * (k - 1)), np.zeros(k), np.eye(k)
    for _ in range(rounds):
        eta = sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        sums = [F.sum((y - p) * c) for c in cols] + [F.sum(p * (1 - p) * cols[i] * cols[j]) for i in range(k) for j in range(i, k)]
        got = _moments(df, features, sums)
        info = np.zeros((k, k))
        info[np.triu_indices(k)] = got[k:]
        info = info + np.triu(info, 1).T + pen
        step = np.linalg.solve(info, got[:k] - pen @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    cov = np.linalg.inv(info)
    if cluster:
        eta = sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
        scores = df.groupBy(cluster).agg(*[F.sum((y - 1 / (1 + F.exp(-eta))) * c).alias(f"s{i}") for i, c in enumerate(cols)])
        got = np.array(scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)], F.count(F.lit(1))).first(), dtype=float)
        groups, n = got[-1], df.count()
        cov = cov @ got[:-1].reshape(k, k) @ cov * (groups / max(groups - 1, 1)) * ((n - 1) / max(n - k, 1))
    se = np.sqrt(np.diag(cov))
    return spark.createDataFrame([(a, float(b), float(s), float(b / s)) for a, b, s in zip(names, beta, se, strict=True)], "term string, coefficient double, se double, z double")


def ols(df: DataFrame, outcome: str, features: Sequence[str]) -> DataFrame:
    """Least squares with HC3 errors and R²: normal equations by sums, then one more pass for the errors."""
    names, df = ["intercept", *features], cut(df.select(outcome, *features), "ols")
    k = len(names)
    cols, y = [F.lit(1.0), *[F.col(f).cast("double") for f in features]], F.col(outcome).cast("double")
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)] + [F.sum(c * y) for c in cols] + [F.sum(y), F.sum(y * y), F.count(y)]
    got = np.array(df.agg(*sums).first(), dtype=float)
    xtx = np.linalg.inv(got[: k * k].reshape(k, k))
    beta = xtx @ got[k * k : k * k + k]
    e = y - sum((c * float(b) for c, b in zip(cols, beta, strict=True)), F.lit(0.0))
    lever = sum((cols[i] * cols[j] * float(xtx[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    w = F.pow(e / (1 - lever), 2)
    second = np.array(df.agg(*[F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(k)], F.sum(e * e)).first(), dtype=float)
    se = np.sqrt(np.diag(xtx @ second[:-1].reshape(k, k) @ xtx))
    r2 = float(1 - second[-1] / (got[-2] - got[-3] ** 2 / got[-1]))
    rows = [(a, float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s), r2, int(got[-1])) for a, b, s in zip(names, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, low double, high double, r2 double, n long")


def swap_chains(sup: DataFrame, by: Sequence[str], draws: int, chains: int = 8, seed: int = 7, burn: int = 20, thin: int = 8, entity: str = "actor", category: str = "topic", label: str | None = None) -> DataFrame:
    """by, draw, labels, jaccard, pairs, accepted: mean overlap of the pairs of entities in random supports that keep both margins, by the labels of the two.

    Chains run side by side: the edges of a group are sent to each of its
    chains, so every group and chain is a task of its own and nothing goes
    through the driver.  A group is a support, no larger than entities x
    categories.  ``accepted``: the swaps made for the draw; a group that allows
    none repeats itself.  Without a label the labels are empty; pairs are those
    of entities that hold anything.
    """
    by, each = list(by), -(-draws // chains)
    rows = sup.select(*by, F.col(entity).cast("string").alias("_e"), F.col(category).cast("string").alias("_c"), (F.col(label).cast("string") if label else F.lit("")).alias("_l")).distinct()
    kinds = dict(rows.dtypes)
    sent = rows.withColumn("_chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, chain = pdf.sort_values(["_e", "_c"], kind="stable"), int(pdf["_chain"].iloc[0])
        rows_, columns = pdf["_e"].astype("category"), pdf["_c"].astype("category")
        codes = np.stack([rows_.cat.codes.to_numpy(), columns.cat.codes.to_numpy()], axis=1).astype(int)
        names = pdf.groupby("_e", observed=True)["_l"].first().reindex(rows_.cat.categories).to_numpy()
        i, j = np.triu_indices(len(names), 1)
        pair = np.array(["-".join(sorted((names[a], names[b]))) if label else "" for a, b in zip(i, j, strict=True)], dtype=object)
        out = []
        for k, (edges, accepted) in enumerate(swap_walk(codes, seed + chain, burn, thin, each)):
            x = np.zeros((len(names), len(columns.cat.categories)))
            x[edges[:, 0], edges[:, 1]] = 1
            both, size = x @ x.T, x.sum(axis=1)
            value = both[i, j] / (size[i] + size[j] - both[i, j])
            found = pd.DataFrame({"labels": pair, "v": value}).groupby("labels")["v"].agg(["mean", "size"])
            out += [(*pdf[by].iloc[0], chain * each + k, l, float(m), int(n), accepted) for l, m, n in found.itertuples()]
        return pd.DataFrame(out, columns=[*by, "draw", "labels", "jaccard", "pairs", "accepted"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["draw long, labels string, jaccard double, pairs long, accepted long"])
    return sent.groupBy(*by, "_chain").applyInPandas(run, schema).filter(F.col("draw") < draws)


def swap_null_jaccard(sup: DataFrame, draws: int, seed: int = 7, entity: str = "actor", category: str = "topic", burn: int = 20, thin: int = 8, chains: int = 8) -> DataFrame:
    """draw, jaccard: mean pair overlap in random supports with both margins kept."""
    return swap_chains(sup, (), draws, chains, seed, burn, thin, entity, category).select("draw", "jaccard")


def retain_adopt(panel: DataFrame, rounds: int = 25) -> tuple[DataFrame, DataFrame]:
    """Retention and entry logits on closeness and popularity (both panels stacked, ``kind`` retain or adopt)."""
    fit = lambda kind: logit(panel.filter(F.col("kind") == kind), "outcome", ["closeness", "popularity"], "actor", rounds=rounds)
    return fit("retain"), fit("adopt")


def simulate(panel: DataFrame, coefficients: dict[str, Sequence[float]], simulations: int = 64, seed: int = 1) -> DataFrame:
    """simulation, period, actor, breadth: portfolios drawn by the fitted probabilities."""
    from loomwork.operators.resample import draws, uniform

    p = F.lit(0.0)
    for kind, (a, b, c) in coefficients.items():
        p = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-(a + b * F.col("closeness") + c * F.col("popularity"))))).otherwise(p)
    drawn = draws(panel.withColumn("_p", p), simulations)
    held = (uniform(seed, "draw", "period", "actor", "topic") < F.col("_p")).cast("int")
    return drawn.groupBy(F.col("draw").alias("simulation"), "period", "actor").agg(F.sum(held).alias("breadth"))


def group_logits(df: DataFrame, by: Sequence[str], outcome: str, features: Sequence[str]) -> DataFrame:
    """by, the coefficient of every standardised feature, intercept, rows and hits of a ridge logit for each group with both outcomes.

    Groups without one of the outcomes, and rows with a null, give nothing.
    """
    names = list(features)
    rows = df.select(*by, F.col(outcome).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names]).dropna()
    kinds = dict(rows.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["_y"].to_numpy()
        if not 0 < y.sum() < len(y):
            return pd.DataFrame({c: [] for c in [*by, *names, "intercept", "rows", "hits"]})
        beta = ridge_logit(pdf[names].to_numpy(), y)
        return pd.DataFrame([[*pdf[list(by)].iloc[0], *beta[1:], beta[0], len(y), int(y.sum())]], columns=[*by, *names, "intercept", "rows", "hits"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{c}` double" for c in names] + ["intercept double", "rows long", "hits long"])
    return rows.groupBy(*by).applyInPandas(fit, schema)


def partial_regression(df: DataFrame, outcome: str, feature: str, controls: Sequence[str]) -> DataFrame:
    """coefficient of ``feature`` beside the controls, and the slope of the outcome's residuals on the feature's."""
    whole = {r["term"]: r["coefficient"] for r in ols(df, outcome, [feature, *controls]).collect()}
    rest = df
    for name in (outcome, feature):
        beta = {r["term"]: r["coefficient"] for r in ols(df, name, list(controls)).collect()}
        fitted = sum((F.col(c) * beta[c] for c in controls), F.lit(beta["intercept"]))
        rest = rest.withColumn(f"_{name}", F.col(name) - fitted)
    slope = rest.agg(F.regr_slope(f"_{outcome}", f"_{feature}").alias("partial"), F.corr(f"_{outcome}", f"_{feature}").alias("partial_r"), F.count(F.lit(1)).alias("n"))
    return slope.select(F.lit(whole[feature]).alias("coefficient"), "partial", "partial_r", "n")
