"""The sequential model of portfolios: what is kept, what is entered, and how a budget is spread over both.

All models of a batch (replicates, stages) are fitted together: each Newton
step is one job that sums gradients and Hessians by the models' keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.panel import transitions
from loomwork.operators.resample import uniform
from loomwork.operators.space import both_ways
from loomwork.sources.store import cut

Names = Sequence[str]


def transition_rows(cells: DataFrame, edges: DataFrame, by: Names = ()) -> DataFrame:
    """One row for each category and each entity that is active in two consecutive periods.

    ``cells``: by, period, actor, topic, x > 0.  ``edges``: by (if the network
    differs), i, j, phi.  Columns: by, prev, period, actor, topic, held and
    now (0 or 1), x, share (of the prior budget), fit (mean phi to the prior
    portfolio; a category is not near itself), popularity (share of the
    earlier period's actors that hold it).  Every category of ``cells`` counts,
    the same for all ``by``.
    """
    by = list(by)
    steps = transitions(cells.select("period").distinct())
    prior = cells.withColumnRenamed("period", "prev").join(steps, "prev").select(*by, "prev", "period", "actor", "topic", F.col("x").alias("px"))
    budgets = cells.groupBy(*by, "period", "actor").agg(F.sum("x").alias("budget"))
    active = prior.groupBy(*by, "prev", "period", "actor").agg(F.sum("px").alias("prior_budget"), F.count(F.lit(1)).alias("breadth")).join(budgets, [*by, "period", "actor"])
    everyone = prior.groupBy(*by, "prev").agg(F.count_distinct("actor").alias("actors"))
    holders = prior.groupBy(*by, "prev", "topic").agg(F.count(F.lit(1)).alias("holders"))
    keyed = [c for c in by if c in edges.columns]
    near = both_ways(edges, "phi", *keyed).select(*keyed, F.col("i").alias("topic"), F.col("j").alias("_held"), "phi")
    fit = prior.withColumnRenamed("topic", "_held").join(near, [*keyed, "_held"]).groupBy(*by, "prev", "period", "actor", "topic").agg(F.sum("phi").alias("_fit"))
    now = cells.select(*by, "period", "actor", "topic", "x")
    at = [*by, "prev", "period", "actor", "topic"]
    rows = active.crossJoin(cells.select("topic").distinct()).join(prior, at, "left").join(fit, at, "left").join(now, [*by, "period", "actor", "topic"], "left")
    rows = rows.join(holders, [*by, "prev", "topic"], "left").join(everyone, [*by, "prev"])
    none = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *at, F.col("px").isNotNull().cast("int").alias("held"), F.col("x").isNotNull().cast("int").alias("now"), none("x").alias("x"),
        (none("px") / F.col("prior_budget")).alias("share"), (none("_fit") / F.col("breadth")).alias("fit"), (none("holders") / F.col("actors")).alias("popularity"),
    )


def baselines(rows: DataFrame, by: Names = ()) -> DataFrame:
    """by, topic, retain, enter, allocate: log-odds of the pooled frequencies of keeping and entering, and the log of the pooled mass, each with a half added."""
    n = lambda c: F.count(F.when(c, 1))
    held, now = F.col("held") == 1, F.col("now") == 1
    odds = lambda yes, no: F.log((n(yes) + 0.5) / (n(no) + 0.5))
    return rows.groupBy(*by, "topic").agg(odds(held & now, held & ~now).alias("retain"), odds(~held & now, ~held & ~now).alias("enter"), F.log(F.sum("x") + 0.5).alias("allocate"))


def _newton(keys: list[tuple], by: Names, k: int, moments: Callable[[DataFrame], DataFrame], session, kinds: dict, rounds: int = 30) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """For each key the coefficients and the information at them; a job for each step, for all keys at once.

    Steps are cut at 4; a key whose information cannot be inverted keeps what it has.
    """
    beta = {key: np.zeros(k) for key in keys}
    info = {key: np.eye(k) for key in keys}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["_b array<double>"])
    upper = np.triu_indices(k)
    for _ in range(rounds):
        most = 0.0
        for r in moments(session.createDataFrame([(*key, b.tolist()) for key, b in beta.items()], schema)).collect():
            key, sums = tuple(r[c] for c in by), np.array([r[f"s{i}"] for i in range(k + len(upper[0]))], dtype=float)
            h = np.zeros((k, k))
            h[upper] = sums[k:]
            info[key] = h = h + np.triu(h, 1).T
            step = np.clip(np.linalg.lstsq(h, sums[:k], rcond=1e-12)[0], -4, 4)
            beta[key] = beta[key] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-9:
            break
    return {key: (beta[key], info[key]) for key in keys}


def _linear(features: Names) -> Column:
    return sum((F.col("_b")[i] * F.col(f) for i, f in enumerate(features)), F.col("_offset"))


def batched_logits(rows: DataFrame, by: Names, outcome: str, features: Names, offset: Column) -> dict:
    """A binomial logit for each key of ``by``; ``features`` hold their own constant."""
    rows = cut(rows.select(*by, F.col(outcome).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features], offset.cast("double").alias("_offset")), "logits")
    k = len(features)

    def moments(b: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-_linear(features)))
        each = rows.join(b, list(by)).withColumns({"_e": F.col("_y") - p, "_w": p * (1 - p)})
        sums = [F.sum(F.col("_e") * F.col(f)) for f in features] + [F.sum(F.col("_w") * F.col(features[i]) * F.col(features[j])) for i in range(k) for j in range(i, k)]
        return each.groupBy(*by).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])

    return _newton([tuple(r) for r in rows.select(*by).distinct().collect()], by, k, moments, rows.sparkSession, dict(rows.dtypes))


def batched_allocations(rows: DataFrame, by: Names, group: Names, mass: str, features: Names, offset: Column) -> dict:
    """A multinomial softmax over the rows of each group, for each key of ``by``: each group adds its gradient and Hessian, weighed by its budget."""
    rows = cut(rows.select(*by, *group, F.col(mass).cast("double").alias("_x"), *[F.col(f).cast("double").alias(f) for f in features], offset.cast("double").alias("_offset")), "allocations")
    k, own = len(features), [*by, *group]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def moments(b: DataFrame) -> DataFrame:
        each = rows.join(b, list(by)).withColumn("_eta", _linear(features))
        each = each.withColumn("_w", F.exp(F.col("_eta") - F.max("_eta").over(Window.partitionBy(*own))))
        sums = [F.sum("_w").alias("_z"), F.sum("_x").alias("_k")] + [F.sum(F.col("_w") * F.col(f)).alias(f"_m{i}") for i, f in enumerate(features)] + [F.sum(F.col("_x") * F.col(f)).alias(f"_t{i}") for i, f in enumerate(features)]
        sums += [F.sum(F.col("_w") * F.col(features[i]) * F.col(features[j])).alias(f"_q{i}_{j}") for i, j in pairs]
        at = each.groupBy(*own).agg(*sums)
        mean = lambda i: F.col(f"_m{i}") / F.col("_z")
        found = [F.sum(F.col(f"_t{i}") - F.col("_k") * mean(i)) for i in range(k)] + [F.sum(F.col("_k") * (F.col(f"_q{i}_{j}") / F.col("_z") - mean(i) * mean(j))) for i, j in pairs]
        return at.groupBy(*by).agg(*[s.alias(f"s{i}") for i, s in enumerate(found)])

    return _newton([tuple(r) for r in rows.select(*by).distinct().collect()], by, k, moments, rows.sparkSession, dict(rows.dtypes))


TERMS = {"retain": ("shift", "share", "popularity"), "enter": ("shift", "fit", "popularity"), "allocate": ("share", "fit", "popularity")}


def sequential_model(rows: DataFrame, by: Names = ()) -> DataFrame:
    """by, stage (retain, enter, allocate), term, coefficient, se of the three stages, for each key of ``by``.

    ``rows``: of ``transition_rows``.  Offsets are the topics' baselines.
    """
    by, spark = list(by), rows.sparkSession
    kinds = {c: t for c, t in rows.dtypes if c in by}
    rows = cut(rows.join(baselines(rows, by), [*by, "topic"]), "transitions")
    stage = F.when(F.col("held") == 1, "retain").otherwise("enter")
    binary = rows.select(*by, stage.alias("stage"), "now", F.lit(1.0).alias("shift"), F.when(F.col("held") == 1, F.col("share")).otherwise(F.col("fit")).alias("near"), "popularity", F.when(F.col("held") == 1, F.col("retain")).otherwise(F.col("enter")).alias("base"))
    fits = dict(batched_logits(binary, [*by, "stage"], "now", ["shift", "near", "popularity"], F.col("base")))
    spread = rows.filter("now = 1").withColumn("stage", F.lit("allocate"))
    fits |= batched_allocations(spread, [*by, "stage"], ["period", "actor"], "x", TERMS["allocate"], F.col("allocate"))
    out = []
    for key, (beta, info) in fits.items():
        se = np.sqrt(np.clip(np.diag(np.linalg.pinv(info)), 0, None))
        out += [(*key, term, float(b), float(s)) for term, b, s in zip(TERMS[key[-1]], beta, se, strict=True)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["stage string, term string, coefficient double, se double"])
    return spark.createDataFrame(out, schema)


def _allocated(chosen: DataFrame, keys: Names, seed: int) -> DataFrame:
    """The budget of each group of ``keys`` drawn over its topics in proportion to exp(eta): topics that get nothing go."""
    top = F.max("eta").over(Window.partitionBy(*keys))
    lists = chosen.withColumn("w", F.exp(F.col("eta") - top)).groupBy(*keys).agg(F.max("budget").alias("budget"), F.array_sort(F.collect_list(F.struct("topic", "w"))).alias("s"))
    lists = lists.select(*keys, "budget", F.col("s.topic").alias("topics"), F.col("s.w").alias("weights"), F.xxhash64(F.lit(seed), *[k for k in keys if k != "arm"]).alias("_seed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.random.default_rng(s & (2**63 - 1)).multinomial(k, w / w.sum()).tolist() for s, k, w in zip(b["_seed"], b["budget"], b["weights"], strict=True)]
            yield b.drop(columns=["weights", "_seed", "budget"]).assign(x=x)

    kinds = dict(lists.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", topics array<string>, x array<long>"
    drawn = lists.mapInPandas(run, schema).select(*keys, F.explode(F.arrays_zip(F.col("topics").alias("topic"), F.col("x").alias("x"))).alias("d"))
    return drawn.select(*keys, F.col("d.topic").alias("topic"), F.col("d.x").alias("x")).filter("x > 0")


def simulated(cells: DataFrame, edges: DataFrame, base: DataFrame, coefficients: dict[str, Sequence[float]], arms: Sequence[tuple[float, float]], simulations: int, seed: int = 0) -> DataFrame:
    """arm, simulation, period, actor, topic, x, held: portfolios drawn period after period, each from the one drawn before.

    The active entities and their budgets are the observed ones; an entity
    without a prior period starts from its observed portfolio (and is not in
    the result for that period).  An arm adds two numbers to the shifts of
    keeping and entering; all arms use the same draws, so that they differ by
    their numbers alone.  Who would hold nothing holds its likeliest draw.
    """
    spark = cells.sparkSession
    steps = [tuple(r) for r in transitions(cells.select("period").distinct()).select("prev", "period").orderBy("period").collect()]
    settings = spark.createDataFrame([(k, float(r), float(e)) for k, (r, e) in enumerate(arms)], "arm int, d_retain double, d_enter double").crossJoin(spark.range(simulations).select(F.col("id").alias("simulation")))
    near = both_ways(edges, "phi").select(F.col("i").alias("topic"), F.col("j").alias("_held"), "phi")
    known = cells.select("period", "actor", "topic", F.col("x").cast("long").alias("x"))
    out, state = None, None
    run = ["arm", "simulation"]
    for prev, period in steps:
        seen = known.filter(F.col("period") == prev)
        # who was drawn in the period before goes on from there, the others from what was observed
        fresh = seen if state is None else seen.join(state.select("actor").distinct(), "actor", "left_anti")
        now = settings.select(*run).crossJoin(fresh.select("actor", "topic", "x"))
        now = now if state is None else now.unionByName(state.select(*run, "actor", "topic", "x"))
        budget = known.filter(F.col("period") == period).groupBy("actor").agg(F.sum("x").alias("budget"))
        sizes = now.groupBy(*run, "actor").agg(F.sum("x").alias("mass"), F.count(F.lit(1)).alias("breadth"))
        actors = sizes.groupBy(*run).agg(F.count(F.lit(1)).alias("actors"))
        holders = now.groupBy(*run, "topic").agg(F.count(F.lit(1)).alias("holders"))
        fit = now.withColumnRenamed("topic", "_held").join(near, "_held").groupBy(*run, "actor", "topic").agg(F.sum("phi").alias("_fit"))
        grid = sizes.join(budget, "actor").join(settings, run).join(actors, run).crossJoin(base)
        rows = grid.join(now.select(*run, "actor", "topic", "x"), [*run, "actor", "topic"], "left").join(fit, [*run, "actor", "topic"], "left").join(holders, [*run, "topic"], "left")
        none = lambda c: F.coalesce(c, F.lit(0))
        rows = rows.withColumns({"held": F.col("x").isNotNull(), "share": none("x") / F.col("mass"), "fit": none("_fit") / F.col("breadth"), "popularity": none("holders") / F.col("actors")})
        r, e, a = (coefficients[s] for s in ("retain", "enter", "allocate"))
        p = lambda c, eta: 1 / (1 + F.exp(-(F.col(c) + eta)))
        keep = p("retain", F.col("d_retain") + r[0] + r[1] * F.col("share") + r[2] * F.col("popularity"))
        enter = p("enter", F.col("d_enter") + e[0] + e[1] * F.col("fit") + e[2] * F.col("popularity"))
        spare = uniform(seed, "simulation", F.lit(period), "actor", "topic") - F.when(F.col("held"), keep).otherwise(enter)
        rows = rows.withColumn("spare", spare).withColumn("_r", F.row_number().over(Window.partitionBy(*run, "actor").orderBy("spare", "topic"))).filter("spare < 0 or _r = 1")
        rows = rows.withColumn("eta", F.col("allocate") + a[0] * F.col("share") + a[1] * F.col("fit") + a[2] * F.col("popularity"))
        drawn = _allocated(rows.withColumn("period", F.lit(period)), [*run, "period", "actor"], seed)
        state = cut(drawn.join(now.select(*run, "actor", "topic", F.lit(1).alias("held")), [*run, "actor", "topic"], "left").fillna(0, ["held"]), "simulated")
        out = state if out is None else out.unionByName(state)
    return out


def calibrated(cells: DataFrame, edges: DataFrame, rows: DataFrame, simulations: int = 4, seed: int = 0, reach: float = 1.0, rounds: int = 2) -> tuple[dict, DataFrame, tuple[float, float]]:
    """The fitted coefficients, the topics' baselines, and the two numbers to add to the shifts so that simulated portfolios keep and enter as many topics as observed.

    Each round runs a grid of nine arms at once and solves the line through
    what they keep and enter; the next grid is a quarter as wide.
    """
    base = cut(baselines(rows), "baselines")
    found: dict[str, dict[str, float]] = {}
    for r in sequential_model(rows).collect():
        found.setdefault(r["stage"], {})[r["term"]] = r["coefficient"]
    coefficients = {s: [found[s][t] for t in TERMS[s]] if s in found else [0.0] * 3 for s in TERMS}
    goal = rows.agg(F.count(F.when((F.col("held") == 1) & (F.col("now") == 1), 1)), F.count(F.when((F.col("held") == 0) & (F.col("now") == 1), 1))).first()
    centre = np.zeros(2)
    for _ in range(rounds):
        arms = [(centre[0] + i * reach, centre[1] + j * reach) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        paths = simulated(cells, edges, base, coefficients, arms, simulations, seed)
        if paths is None:
            break
        counted = {r["arm"]: (r["kept"] / simulations, r["entered"] / simulations) for r in paths.groupBy("arm").agg(F.sum("held").alias("kept"), F.sum(1 - F.col("held")).alias("entered")).collect()}
        design = np.array([[1.0, *arm] for arm in arms])
        line = np.linalg.lstsq(design, np.array([counted.get(k, (0, 0)) for k in range(len(arms))], dtype=float), rcond=None)[0]
        move = np.linalg.lstsq(line[1:].T, np.array(goal, dtype=float) - line[0], rcond=1e-9)[0]
        centre = centre + np.clip(move - centre, -reach, reach)
        reach /= 4
    return coefficients, base, (float(centre[0]), float(centre[1]))


def thinned_cubes(facts: DataFrame, doc: str, keys: Names, shares: Sequence[int], replicates: int, seed: int = 0) -> DataFrame:
    """share, replicate, keys, x: the cube of each replicate that keeps a document with ``share`` per cent.

    A checksum of (replicate, document) decides, the same for all shares, so a
    document of a smaller share is in the larger one too.  The facts are read
    once: each cell counts for all shares and replicates side by side.
    """
    place = lambda r: F.floor(uniform(seed, F.lit(r), doc) * 100)
    facts = facts.select(doc, *keys).withColumns({f"_u{r}": place(r) for r in range(1, replicates + 1)})
    cells = facts.groupBy(*keys).agg(*[F.count(F.when(F.col(f"_u{r}") < s, 1)).alias(f"_{s}_{r}") for s in shares for r in range(1, replicates + 1)])
    one = [F.struct(F.lit(s).alias("share"), F.lit(r).alias("replicate"), F.col(f"_{s}_{r}").alias("x")) for s in shares for r in range(1, replicates + 1)]
    return cells.select(*keys, F.inline(F.array(*one))).filter("x > 0").select("share", "replicate", *keys, "x")
