"""Walk-forward models: one elastic net and one boosted-tree score per month.

All training sets are the panel before some date. Elastic nets need sums of products only: these are taken once per month, and a prefix of months
gives every training set its covariances. Trees are fitted on all rows, dealt to as many tasks as run side by side; rows beyond ``HELD_ROWS`` lie in files.
The driver holds medians, sums and models, whose number and size depend on months, features and settings and not on rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.groups import join_days, prefix_quantiles, quantiles, with_average_ranks
from pitgrid.functions.staging import stage
from pitgrid.operators.boosting import HELD_ROWS, array, binned, boosted_scores, grown
from pitgrid.session import importable

# Window rules and search grids.
MIN_MONTHS = 24
MIN_ROWS = 100
VALIDATION_MONTHS = 6
ELASTIC_GRID = tuple(product((0.001, 0.01, 0.1), (0.1, 0.5, 0.9)))
TREE_GRID = tuple(product((0.03, 0.08), (7, 15)))  # learning rate, leaves
DEFAULT_ELASTIC = (0.01, 0.5)
DEFAULT_TREE = (0.05, 15)
ROUNDS = 150
TREE_L2 = 0.1
TARGET = "next_month_excess_return"


class LookAheadError(ValueError):
    """Training rows reach into the prediction month."""


def labelled_history(snapshot: DataFrame, forward: DataFrame) -> DataFrame:
    """Snapshot rows with their forward returns."""
    return snapshot.join(forward, ["signal_date", "company_id"])


def walk_forward_split(panel: DataFrame, months: DataFrame, target: str = TARGET) -> DataFrame:
    """Per prediction month the training size and whether a model may be fit.

    Monthly counts are summed over earlier months; the panel is read once.
    """
    counts = panel.where(F.col(target).isNotNull()).groupBy("signal_date").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(F.lit(1)).orderBy("signal_date").rowsBetween(W.unboundedPreceding, -1)  # one row per month
    df = months.select("signal_date").distinct().join(counts, "signal_date", "left").fillna(0, ["_n"])
    df = df.withColumns({
        "train_rows": F.coalesce(F.sum("_n").over(w), F.lit(0)), "train_months": F.count(F.when(F.col("_n") > 0, 1)).over(w),
        "last_train": F.max(F.when(F.col("_n") > 0, F.col("signal_date"))).over(w),
    })
    return df.withColumn("fits", (F.col("train_months") >= MIN_MONTHS) & (F.col("train_rows") >= MIN_ROWS)).drop("_n")


def check_no_look_ahead(train: DataFrame, current: DataFrame) -> None:
    """Raise when a training date is not strictly before the prediction date."""
    a, b = train.agg(F.max("signal_date")).first()[0], current.agg(F.min("signal_date")).first()[0]
    if a is not None and b is not None and a >= b:
        raise LookAheadError("Walk-forward training rows must strictly precede the prediction month")


def impute_scale(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training medians fill gaps, then population standardization; features never seen become 0.

    The statistics are one row of three numbers per feature, computed by Spark and joined
    to the rows.
    """
    stats = training_stats(train, features)
    med = {f: F.coalesce(F.col(f).cast("double"), F.col(f"_med_{f}")) for f in features}
    filled = rows.join(F.broadcast(stats), F.lit(True))  # one row, whatever the data size
    sd = lambda f: F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0)
    scaled = {f: F.coalesce((med[f] - F.col(f"_mean_{f}")) / sd(f), F.lit(0.0)) for f in features}
    return filled.withColumns(scaled).select(*rows.columns)


def training_stats(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: median, and mean and population deviation after filling, of each feature."""
    long = train.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "f", "v")
    med = quantiles(long, ["f"], "v", {"med": 0.5}).select("f", "med")
    filled = long.join(med, "f").withColumn("x", F.coalesce("v", "med"))
    s = filled.groupBy("f").agg(F.max("med").alias("med"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return s.agg(*[F.max(F.when(F.col("f") == f, F.col(c))).alias(f"_{c}_{f}") for f in features for c in ("med", "mean", "sd")])


@dataclass(frozen=True)
class TrainingSet:
    """What is known of the labelled rows before ``end``; x is a feature filled with its median."""

    end: datetime.date
    rows: int
    medians: np.ndarray
    seen: np.ndarray  # features with any value
    means: np.ndarray
    deviations: np.ndarray  # 1 for a constant
    correlations: np.ndarray
    with_target: np.ndarray  # covariance of the scaled features with the target
    target_mean: float
    target_deviation: float


def training_sets(panel: DataFrame, ends: Sequence[datetime.date], features: Sequence[str], target: str = TARGET) -> dict[datetime.date, TrainingSet]:
    """Statistics of the labelled rows before each date of ``ends``.

    The panel is read twice: once for sums of products per month, of values and of gaps (so that any median can be filled in
    afterwards), once for the medians of all prefixes.
    """
    features, ends = list(features), sorted(set(ends))
    k = len(features)
    known = panel.where(F.col(target).isNotNull())
    parts = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features] + [F.col(f).isNull().cast("double") for f in features]
    parts += [F.col(target).cast("double"), F.lit(1.0)]
    named = known.select("signal_date", *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    pairs = [(i, j) for i in range(len(parts)) for j in range(i + 1)]
    sums = named.groupBy("signal_date").agg(*[F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # one row per month
    long = known.select("signal_date", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["signal_date"], features, "f", "v")
    med = prefix_quantiles(long, ["f"], "signal_date", ends, "v", {"med": 0.5}).collect()
    medians = {(r["end"], r["f"]): r["med"] for r in med}
    out = {}
    for end in ends:
        s = np.zeros((len(parts), len(parts)))
        for r in sums:
            if r["signal_date"] < end:
                for i, j in pairs:
                    s[i, j] += r[f"s{i}_{j}"]
        s = s + np.tril(s, -1).T
        m = np.array([medians.get((end, f), np.nan) for f in features])
        seen = ~np.isnan(m)
        fill = np.zeros((k + 2, len(parts)))
        fill[:k, :k], fill[:k, k : 2 * k], fill[k:, 2 * k :] = np.eye(k), np.diag(np.nan_to_num(m)), np.eye(2)
        s = fill @ s @ fill.T
        n = s[-1, -1]
        mean = s[:-1, -1] / max(n, 1)
        cov = s[:-1, :-1] / max(n, 1) - np.outer(mean, mean)
        var = np.diag(cov)
        sd = np.where(var > 1e-18, np.sqrt(np.maximum(var, 0)), 1.0)
        scaled = np.where(np.outer(var > 1e-18, var > 1e-18), cov / np.outer(sd, sd), 0.0)
        out[end] = TrainingSet(end, int(n), np.nan_to_num(m), seen, mean[:k], sd[:k], scaled[:k, :k], scaled[:k, k] * sd[k], mean[k], sd[k])
    return out


def elastic_weights(t: TrainingSet, params: tuple[float, float], features: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Weights of the scaled features that minimize half the mean squared error of the target (divided by ``scale``) plus alpha times the mixed norm.

    Features outside the mask ``features`` keep weight 0. Coordinate descent until no weight moves.
    """
    alpha, ratio = params
    w = np.zeros(len(features))
    c = t.with_target / scale
    for _ in range(5000):
        moved = 0.0
        for j in np.flatnonzero(features):
            rest = c[j] - t.correlations[j] @ w + t.correlations[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha * ratio, 0.0) / (t.correlations[j, j] + alpha * (1 - ratio))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-13:
            break
    return w


def linear_scores(t: TrainingSet, weights: np.ndarray, x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    return t.target_mean + scale * (((x - t.means) / t.deviations) @ weights)


def fit_trees(panel: DataFrame, fits: Sequence[tuple], sets: dict, masks: dict, features: Sequence[str], target: str = TARGET, rounds: int = ROUNDS, max_rows: int = HELD_ROWS) -> dict[tuple, bytes]:
    """Model per fit (end, rate, leaves), each fitted on all labelled rows before its end, gaps filled with the medians.

    ``masks`` has the usable features per end. Fits are dealt to tasks, no more than run side by side. All training sets are prefixes of one line of rows, so
    a task gets the rows of its longest one once, each with its place in the line, whatever the shuffle. A task holds ``max_rows`` rows in memory at a time and the
    others in files.
    """
    fits, features = list(fits), list(features)
    if not fits:
        return {}
    spark = panel.sparkSession
    dealt = deal_fits(fits, {e: sets[e].rows for e, _, _ in fits}, max(1, spark.sparkContext.defaultParallelism))
    last = [max(fits[i][0] for i in some) for some in dealt]
    values = [F.col(f).cast("double").alias(f) for f in features]
    known = panel.where(F.col(target).isNotNull() & F.col("signal_date").isNotNull()).select("signal_date", "company_id", *values, F.col(target).cast("double").alias("_y"))
    counts = known.groupBy("signal_date").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("signal_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per month
    order = W.partitionBy("signal_date").orderBy(F.asc_nulls_last("company_id"), "_y", *features)
    line = join_days(known.withColumn("_at", F.row_number().over(order) - 1), counts.select("signal_date", before.alias("_before")), ["signal_date"])
    tasks = F.array(*[F.struct(F.lit(i).alias("task"), F.lit(e).alias("end")) for i, e in enumerate(last)])
    wanted = F.transform(F.filter(tasks, lambda j: j["end"] > F.col("signal_date")), lambda j: j["task"])
    rows = line.select(F.explode(wanted).alias("_task"), (F.col("_before") + F.col("_at")).alias("_at"), *features, "_y")
    medians, usable = {e: sets[e].medians for e, _, _ in fits}, {e: np.flatnonzero(masks[e]) for e, _, _ in fits}
    sizes = {e: sets[e].rows for e, _, _ in fits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}  # columns of a task's rows, the target last
        for batch in batches:
            task, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(2, batch.num_columns)]
            for i in np.unique(task).tolist():
                some = task == i
                if i not in held:
                    held[i] = [array(sizes[last[i]], np.float64, max_rows) for _ in columns]
                for column, values in zip(held[i], columns, strict=True):
                    column[at[some]] = values[some]
        for i, columns in held.items():
            end, edges, place = None, [], []
            for k in sorted(dealt[i], key=lambda k: fits[k][0]):
                if fits[k][0] != end:
                    end = fits[k][0]
                    edges, place = binned([columns[j][: sizes[end]] for j in usable[end]], medians[end][usable[end]], max_rows)
                model = grown(edges, place, columns[-1][: sizes[end]], *fits[k][1:], rounds, TREE_L2, max_rows)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([model], pa.binary())], ["fit", "model"])

    importable(spark)
    found = rows.repartitionById(len(dealt), "_task").mapInArrow(run, "fit int, model binary").collect()  # months x settings models
    return {fits[r["fit"]]: bytes(r["model"]) for r in found}


def deal_fits(fits: Sequence[tuple], rows: dict, tasks: int) -> list[list[int]]:
    """Numbers of the fits of each task: the one with the most rows and leaves goes to the task that has the least to do."""
    work = {i: rows[end] * leaves for i, (end, _, leaves) in enumerate(fits)}
    dealt, load = [[] for _ in range(min(tasks, len(fits)))], [0] * min(tasks, len(fits))
    for i in sorted(work, key=lambda i: (-work[i], i)):
        least = load.index(min(load))
        dealt[least].append(i)
        load[least] += work[i] + 1
    return dealt


def filled(rows: pd.DataFrame, features: Sequence[str], medians: np.ndarray) -> np.ndarray:
    x = rows[list(features)].to_numpy(dtype=np.float64)
    return np.where(np.isnan(x), medians, x)


@dataclass(frozen=True)
class Selection:
    """Settings chosen for a year and the features that its core months know; errors by setting, empty where history was too short."""

    elastic: tuple[float, float]
    tree: tuple[float, int]
    features: np.ndarray
    elastic_errors: dict
    tree_errors: dict


def validation_start(months: Sequence[datetime.date]) -> datetime.date | None:
    """First of the last ``VALIDATION_MONTHS`` training months; None if there are no others."""
    return sorted(months)[-VALIDATION_MONTHS] if len(months) > VALIDATION_MONTHS else None


def select_params(panel: DataFrame, ends: Sequence[datetime.date], features: Sequence[str], target: str = TARGET, rounds: int = ROUNDS, tree_grid=TREE_GRID, elastic_grid=ELASTIC_GRID) -> dict[datetime.date, Selection]:
    """For the training rows before each of ``ends``, the settings with the least mean absolute error on their last six months.

    Medians, scales and models come from the months before those only. All dates and settings are fitted side by side.
    """
    features = list(features)
    dates = [r[0] for r in panel.where(F.col(target).isNotNull()).select("signal_date").distinct().collect()]  # one per month
    first = {end: validation_start([d for d in dates if d < end]) for end in ends}
    cores = sorted({c for c in first.values() if c is not None})
    sets = training_sets(panel, [*cores, *ends], features, target)
    seen = {c: sets[c].seen for c in cores}
    trees = fit_trees(panel, [(c, *p) for c in cores if seen[c].any() for p in tree_grid], sets, seen, features, target, rounds)
    linear = {(c, *p): elastic_weights(sets[c], p, seen[c]) for c in cores for p in elastic_grid}
    spans = [(c, end) for end, c in first.items() if c is not None]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for core, end in spans:
                some = rows[(rows["signal_date"] >= core) & (rows["signal_date"] < end)]
                if len(some):
                    x, y = filled(some, features, sets[core].medians), some["_y"].to_numpy()
                    for p in elastic_grid:
                        out.append((end, "elastic", *map(float, p), float(np.abs(linear_scores(sets[core], linear[core, *p], x) - y).sum()), len(y)))
                    for p in tree_grid:
                        if (core, *p) in trees:
                            out.append((end, "tree", *map(float, p), float(np.abs(boosted_scores(trees[core, *p], x[:, seen[core]]) - y).sum()), len(y)))
            yield pd.DataFrame(out, columns=["end", "kind", "a", "b", "error", "n"])

    validating = [F.col("signal_date").between(core, end) for core, end in spans]
    rows = panel.where(F.col(target).isNotNull() & reduce(or_, validating, F.lit(False))).select("signal_date", *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    importable(panel.sparkSession)
    # in order of the dates a batch meets few models
    found = rows.sortWithinPartitions("signal_date").mapInPandas(errors, "end date, kind string, a double, b double, error double, n long").groupBy("end", "kind", "a", "b").agg((F.sum("error") / F.sum("n")).alias("mae")).collect()
    mae = {(r["end"], r["kind"], r["a"], r["b"]): r["mae"] for r in found}
    out = {}
    for end, core in first.items():
        if core is None or not seen[core].any():
            out[end] = Selection(DEFAULT_ELASTIC, DEFAULT_TREE, sets[end].seen if core is None else seen[core], {}, {})
            continue
        e = {p: mae[end, "elastic", *map(float, p)] for p in elastic_grid}
        t = {p: mae[end, "tree", *map(float, p)] for p in tree_grid}
        out[end] = Selection(min(e, key=e.get, default=DEFAULT_ELASTIC), min(t, key=t.get, default=DEFAULT_TREE), seen[core], e, t)
    return out


def tree_scores(panel: DataFrame, end: datetime.date, chosen: Selection, features: Sequence[str], target: str = TARGET, rounds: int = ROUNDS) -> DataFrame:
    """(signal_date, company_id, tree_score): all rows of the panel, scored by the trees of the labelled rows before ``end``."""
    features = list(features)
    known = training_sets(panel, [end], features, target)[end]
    usable = chosen.features & known.seen
    model = fit_trees(panel, [(end, *chosen.tree)], {end: known}, {end: usable}, features, target, rounds)[end, *chosen.tree]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = filled(rows, features, known.medians)[:, usable]
            yield pd.DataFrame({"signal_date": rows["signal_date"], "company_id": rows["company_id"], "tree_score": boosted_scores(model, x)})

    importable(panel.sparkSession)
    rows = panel.select("signal_date", "company_id", *[F.col(f).cast("double").alias(f) for f in features])
    return rows.mapInPandas(run, f"signal_date date, company_id {panel.schema['company_id'].dataType.simpleString()}, tree_score double")


def predict(panel: DataFrame, asks: dict[datetime.date, Selection], features: Sequence[str], target: str = TARGET, rounds: int = ROUNDS) -> DataFrame:
    """(signal_date, company_id, elastic_score, tree_score): the rows of each date of ``asks``, by models of the labelled rows before it."""
    features = list(features)
    sets = training_sets(panel, list(asks), features, target) if asks else {}
    masks = {end: s.features & sets[end].seen for end, s in asks.items()}
    trees = fit_trees(panel, [(end, *s.tree) for end, s in asks.items() if masks[end].any()], sets, masks, features, target, rounds)
    # the linear model sees a standardized target
    scale = {end: sets[end].target_deviation for end in asks}
    linear = {end: elastic_weights(sets[end], s.elastic, masks[end], scale[end]) for end, s in asks.items()}
    chosen = {end: s.tree for end, s in asks.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for end, some in rows.groupby("signal_date"):
                x = filled(some, features, sets[end].medians)
                e = linear_scores(sets[end], linear[end], x, scale[end]) if masks[end].any() else np.zeros(len(x))
                t = boosted_scores(trees[end, *chosen[end]], x[:, masks[end]]) if masks[end].any() else np.zeros(len(x))
                yield pd.DataFrame({"signal_date": end, "company_id": some["company_id"], "elastic_score": e, "tree_score": t})

    rows = panel.where(F.col("signal_date").isin(list(asks))) if asks else panel.limit(0)
    importable(panel.sparkSession)
    rows = rows.select("signal_date", "company_id", *[F.col(f).cast("double").alias(f) for f in features])
    # in order of the dates a batch meets few models
    return rows.sortWithinPartitions("signal_date").mapInPandas(run, f"signal_date date, company_id {panel.schema['company_id'].dataType.simpleString()}, elastic_score double, tree_score double")


def walk_forward(panel: DataFrame, months: Sequence, features: Sequence[str], target: str = TARGET, rounds: int = ROUNDS, tree_grid=TREE_GRID) -> DataFrame:
    """M01 to M05 for a list of prediction months: settings chosen once a year, at its first fitted month, weights refit each month.

    A month with too little history is not fitted: its scores are 0 and ``fitted`` is false (``rank_blend`` then
    takes the factor rank alone). All months and settings are fitted side by side; the number of jobs does not grow with the months.
    """
    months = sorted(months)
    keep = ["signal_date", "company_id", *features, target]
    panel = stage(panel.select(*dict.fromkeys(keep)), "panel")
    asked = panel.sparkSession.createDataFrame([(m,) for m in months], "signal_date date")
    every = panel.select("signal_date").distinct().unionByName(asked).distinct()
    gate = {r["signal_date"]: r["fits"] for r in walk_forward_split(panel, every, target).collect()}  # one row per month
    fitted = [m for m in months if gate[m]]
    firsts = {}
    for m in fitted:
        firsts.setdefault(m.year, m)
    chosen = select_params(panel, list(firsts.values()), features, target, rounds, tree_grid) if fitted else {}
    asks = {m: chosen[firsts[m.year]] for m in fitted}
    scored = predict(panel, asks, features, target, rounds).withColumn("fitted", F.lit(True))
    short = [m for m in months if not gate[m]]
    rest = panel.where(F.col("signal_date").isin(short)) if short else panel.limit(0)
    return scored.unionByName(rest.select("signal_date", "company_id", F.lit(0.0).alias("elastic_score"), F.lit(0.0).alias("tree_score"), F.lit(False).alias("fitted")))


def rank_blend(scored: DataFrame, has_history: Column | None = None) -> DataFrame:
    """Model score is the mean of two percentile ranks; ensemble is half factor rank, half model score.

    Rows of a month without training history get model score 0 and the factor rank alone.
    """
    df = with_average_ranks(scored, ["signal_date"], ["company_id"], {"elastic_score": "_re", "tree_score": "_rt", "factor_score": "factor_rank"})
    ml = (F.col("_re") + F.col("_rt")) / 2
    known = F.lit(True) if has_history is None else has_history
    return df.withColumn("ml_score", F.when(known, ml).otherwise(0.0)).withColumn(
        "ensemble_score", F.when(known, 0.5 * F.col("factor_rank") + 0.5 * F.col("ml_score")).otherwise(F.col("factor_rank"))
    ).drop("_re", "_rt")
