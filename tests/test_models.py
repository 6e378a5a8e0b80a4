"""The models: full grids, all rounds and months, and their arithmetic against plain forms."""

import inspect

import numpy as np
import pytest

from pitgrid.operators import boosting, learning
from pitgrid.plans import learning as plans
from pitgrid.plans.registry import tables

SF = "/root/testdata/sf0.001"


def test_every_signal_month_is_predicted_with_the_full_grid(spark, monkeypatch):
    t, asked = tables(spark, SF), []
    monkeypatch.setattr(learning, "walk_forward", lambda *a, **k: asked.append((a, k)))
    plans.m05(t)
    (args, named), = asked
    assert sorted(args[1]) == sorted(r[0] for r in t.signals.collect()) and len(args[1]) > 70 and not named


def test_trees_come_from_the_grid(spark, monkeypatch):
    made, real = [], learning.fit_trees
    defaults = {n: p.default for n, p in inspect.signature(learning.select_params).parameters.items()}
    assert defaults["rounds"] == 150 and defaults["tree_grid"] == ((0.03, 7), (0.03, 15), (0.08, 7), (0.08, 15))
    monkeypatch.setattr(learning, "fit_trees", lambda panel, fits, sets, masks, features, target, rounds: made.append((list(fits), rounds)) or real(panel, fits, sets, masks, features, target, 1))
    assert plans.m04(tables(spark, SF)).select("tree_score").count() > 0
    (grid, rounds), (final, again) = made
    assert rounds == again == 150 and sorted(f[1:] for f in grid) == sorted(learning.TREE_GRID) and len(final) == 1 and final[0][0] == plans.FIT_MONTH


def sample(spark, months=40, names=30, seed=4):
    rng, rows = np.random.default_rng(seed), []
    for m in range(months):
        day = __import__("datetime").date(2015 + m // 12, m % 12 + 1, 28)
        for i in range(names):
            x = rng.normal(size=3)
            y = 0.5 * x[0] - 0.2 * x[1] + (0.3 if x[2] > 0.4 else -0.1) + 0.05 * rng.normal()
            rows.append((day, f"c{i}", None if rng.random() < 0.1 else float(x[0]), float(x[1]), float(x[2]), None, float(y)))
    return rows, spark.createDataFrame(rows, "signal_date date, company_id string, a double, b double, c double, never double, next_month_excess_return double")


def test_elastic_weights_meet_the_optimality_conditions(spark):
    rows, df = sample(spark)
    end = max(r[0] for r in rows)
    t = learning.training_sets(df, [end], ["a", "b", "c", "never"])[end]
    train = [r for r in rows if r[0] < end]
    med = [np.median([r[j] for r in train if r[j] is not None]) for j in (2, 3, 4)]
    x = np.array([[med[j] if r[2 + j] is None else r[2 + j] for j in range(3)] for r in train])
    y = np.array([r[6] for r in train])
    assert t.rows == len(train) and list(t.seen) == [True, True, True, False] and t.medians[:3] == pytest.approx(med)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for alpha, ratio in (*learning.ELASTIC_GRID, (0.3, 0.9)):
        w = learning.elastic_weights(t, (alpha, ratio), t.seen)
        slope = z.T @ (y - y.mean() - z @ w[:3]) / len(y) - alpha * (1 - ratio) * w[:3]
        for j in range(3):
            assert abs(slope[j]) <= alpha * ratio + 1e-9 and (w[j] == 0 or slope[j] == pytest.approx(np.sign(w[j]) * alpha * ratio, abs=1e-9))
        assert w[3] == 0
    assert not learning.elastic_weights(t, (9.0, 0.9), t.seen).any()


def test_first_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (200, 2)).astype(float)
    y = np.where(x[:, 0] > 6, 2.0, 0.0) + 0.1 * rng.normal(size=200)
    got = boosting.boosted_scores(boosting.boost(x, y, 1.0, 2, 1, 0.0), x)
    best = None
    for j in range(2):
        for cut in np.unique(x[:, j]):
            low = x[:, j] <= cut
            if low.sum() >= boosting.MIN_LEAF and (~low).sum() >= boosting.MIN_LEAF:
                error = ((y[low] - y[low].mean()) ** 2).sum() + ((y[~low] - y[~low].mean()) ** 2).sum()
                if best is None or error < best[0]:
                    best = (error, np.where(low, y[low].mean(), y[~low].mean()))
    assert got == pytest.approx(best[1])
    for leaves in (7, 15):
        model = boosting.boost(x, y, 0.1, leaves, 5, 0.1)
        trees = int(np.frombuffer(model, "<i8", 1, 8)[0])
        nodes = np.frombuffer(model, boosting.NODE, offset=16 + 8 * trees)
        assert trees == 5 and 0 < (nodes["feature"] < 0).sum() <= 5 * leaves
    flat = boosting.boost(x, np.ones(200), 0.1, 7, 3, 0.1)
    assert set(boosting.boosted_scores(flat, x)) == {1.0}
    assert set(boosting.boosted_scores(boosting.boost(x[:, :0], y, 0.1, 7, 3, 0.1), x[:, :0])) == {y.mean()}


def test_features_never_seen_before_are_left_out_and_models_learn(spark):
    rows, df = sample(spark)
    months = sorted({r[0] for r in rows})[-3:]
    out = learning.walk_forward(df, months, ["a", "b", "c", "never"], rounds=40).collect()
    truth = {(r[0], r[1]): r[6] for r in rows}
    assert len(out) == 3 * 30 and all(r.fitted for r in out)
    for score in ("elastic_score", "tree_score"):
        assert np.corrcoef([r[score] for r in out], [truth[r.signal_date, r.company_id] for r in out])[0, 1] > 0.8


def test_large_training_sets_are_thinned(spark):
    _, df = sample(spark)
    end = df.agg({"signal_date": "max"}).first()[0]
    sets = learning.training_sets(df, [end], ["a", "b", "c"])
    model = learning.fit_trees(df, [(end, 0.1, 7)], sets, {end: sets[end].seen}, ["a", "b", "c"], rounds=2, max_rows=200)
    assert len(model) == 1


def test_every_row_of_a_large_training_set_is_learned(spark):
    rows, df = sample(spark)
    end = max(r[0] for r in rows)
    sets = learning.training_sets(df, [end], ["a", "b", "c"])
    fits = [(end, 0.1, 7), (end, 0.05, 15)]
    train = sorted((r[0], r[1], r[6], *r[2:5]) for r in rows if r[0] < end)
    assert sets[end].rows == len(train) > 5 * 200
    x = np.array([[sets[end].medians[j] if v is None else v for j, v in enumerate(r[3:])] for r in train])
    for held in (200, 10_000):  # beyond it arrays lie in files
        models = learning.fit_trees(df.repartition(7), fits, sets, {end: sets[end].seen}, ["a", "b", "c"], rounds=20, max_rows=held)
        for f in fits:
            whole = boosting.boost(x, np.array([r[2] for r in train]), *f[1:], 20, learning.TREE_L2)
            assert boosting.boosted_scores(models[f], x) == pytest.approx(boosting.boosted_scores(whole, x), abs=1e-12)
    dealt = learning.deal_fits([(m, 0.1, 7) for m in range(9)], {m: m + 1 for m in range(9)}, 4)
    assert sorted(i for some in dealt for i in some) == list(range(9)) and len(dealt) == 4


def test_files_and_parts_change_no_bins():
    x = np.random.default_rng(2).normal(size=5000)
    assert np.array_equal(boosting.bin_edges(x, held=97), np.unique(np.quantile(x, np.linspace(0, 1, boosting.BINS + 1)[1:-1])))
    few = np.round(x)
    assert np.array_equal(boosting.bin_edges(few, held=97), (np.unique(few)[:-1] + np.unique(few)[1:]) / 2)
