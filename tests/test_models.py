"""One-pass fits, boosted trees, cross-validation and the vectorised bootstrap against plain Python."""

import math
import random
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import LogisticConfig, TreeConfig
from tidemark.functions.hashing import draw
from tidemark.operators import boosting as BO, bootstrap as BS, distributed as DI, folds as FO, linear as LI, metrics as M, models as MO
from tidemark.operators.blocks import sparse_rows

CODES = ["c0", "c1", "c2", "rare", "full"]


def _data(spark, n=240, seed=1, nulls=False):
    """Features a to e (c with gaps), labels of five codes of which two cannot be fitted."""
    rng = random.Random(seed)
    features, labels = [], []
    for s in range(n):
        x = {"a": float(rng.randrange(6)), "b": rng.gauss(0, 1), "c": float(rng.randrange(3)), "d": rng.choice([0.0, 1.0]), "e": 0.0}
        if nulls and s % 5 == 0:
            x["c"] = None
        features += [(s, 0, "B", k, v) for k, v in x.items() if v is None or v]
        z = {"c0": x["a"] - 2.5, "c1": x["b"] + (2.0 if x["c"] is None else 0.0), "c2": x["d"] * 2 - x["a"] / 3}
        for c in CODES:
            y = int(s == 0) if c == "rare" else 1 if c == "full" else int(rng.random() < 1 / (1 + math.exp(-z[c])))
            labels.append((s, 0, c, y, int(rng.random() < 0.9 or s == 0)))
    examples = spark.createDataFrame([(s, 0) for s in range(n)], "subject_id int, cutoff int")
    return (spark.createDataFrame(features, "subject_id int, cutoff int, block string, feature string, value double"),
            spark.createDataFrame(labels, "subject_id int, cutoff int, code string, y int, at_risk int"), examples)


def _dense(rows, size):
    out = {}
    for r in rows.collect():
        x = np.zeros(size)
        x[r["at"]] = r["v"]
        out[r["subject_id"]] = x
    return out


def test_logistic_of_all_codes_reaches_every_optimum(spark):
    features, labels, examples = _data(spark)
    scope = examples.filter("subject_id % 4 <> 0").select("subject_id")
    ready = MO.fit_preprocessing(features, examples, scope)
    rows = ready.rows(features, examples)
    cfg = LogisticConfig(C=0.5)
    models = LI.fit_logistic(rows, ready.size(), labels, scope, CODES, cfg)
    x = _dense(rows, ready.size())
    told = [r for r in labels.collect() if r["subject_id"] % 4 and r["at_risk"]]
    for k, code in enumerate(CODES[:3]):
        mine = [(x[r["subject_id"]], r["y"]) for r in told if r["code"] == code]
        features_, y = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
        p = 1 / (1 + np.exp(-(features_ @ models.coefficients[k] + models.intercepts[k])))
        slope = (features_.T @ (p - y) + models.coefficients[k] / cfg.C) / len(y)
        assert np.abs(slope).max() < 2e-6 and abs((p - y).mean()) < 2e-6
    assert {r["code"]: r["converged"] for r in models.report} == dict.fromkeys(CODES[:3], True)
    assert models.constants["full"] == 1.0 and 0 < models.constants["rare"] <= 1 or models.constants["rare"] == 0.0
    scores = {(r["subject_id"], r["code"]): r["p"] for r in models.score(rows).collect()}
    assert len(scores) == 240 * 5
    assert scores[7, "c1"] == pytest.approx(1 / (1 + math.exp(-(x[7] @ models.coefficients[1] + models.intercepts[1]))))
    short = LI.fit_logistic(rows, ready.size(), labels, scope, CODES[:1], LogisticConfig(C=0.5, max_iter=1))
    assert [r["converged"] for r in short.report] == [False]


def _uneven(spark, n=400):
    """Twelve features of which some are all but equal and others a thousandth as large."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(n, 1))
    x = np.concatenate([base + 0.02 * rng.normal(size=(n, 6)), 1e-3 * rng.normal(size=(n, 6))], axis=1)
    y = rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - 800 * x[:, 7] + 1))
    rows = spark.createDataFrame([(i, 0, list(range(12)), v.tolist()) for i, v in enumerate(x)], "subject_id int, cutoff int, at array<int>, v array<double>")
    labels = spark.createDataFrame([(i, 0, "c0", int(t), 1) for i, t in enumerate(y)], "subject_id int, cutoff int, code string, y int, at_risk int")
    return x, y, rows, labels


@pytest.mark.parametrize("paired, most", [(1_024, 30), (4, 2_000)])
def test_logistic_on_uneven_features_takes_few_passes(spark, monkeypatch, paired, most):
    x, y, rows, labels = _uneven(spark)
    passes, losses = [], LI._losses

    def counted(*args):
        evaluate = losses(*args)
        return lambda points: (passes.append(1), evaluate(points))[1]

    monkeypatch.setattr(LI, "_losses", counted)
    monkeypatch.setattr(LI, "PAIRED", paired, raising=False)
    cfg = LogisticConfig(C=1e4)
    models = LI.fit_logistic(rows, 12, labels, rows.select("subject_id"), ["c0"], cfg)
    p = 1 / (1 + np.exp(-(x @ models.coefficients[0] + models.intercepts[0])))
    slope = (x.T @ (p - y) + models.coefficients[0] / cfg.C) / len(y)
    assert models.report[0]["converged"] and np.abs(slope).max() < 2e-6 and abs((p - y).mean()) < 2e-6
    assert len(passes) <= most


def test_codes_in_groups_give_the_same_models(spark, monkeypatch):
    features, labels, examples = _data(spark)
    scope = examples.select("subject_id")
    ready = MO.fit_preprocessing(features, examples, scope)
    rows = ready.rows(features, examples)
    whole = LI.fit_logistic(rows, ready.size(), labels, scope, CODES)
    monkeypatch.setattr(LI, "STATE_VALUES", 1)
    single = LI.fit_logistic(rows, ready.size(), labels, scope, CODES)
    assert np.allclose(whole.coefficients, single.coefficients, atol=1e-4)


def test_bundle_scores_alike_from_its_path(spark, tmp_path):
    features, labels, examples = _data(spark, nulls=True)
    scope = examples.select("subject_id")
    ready = MO.fit_preprocessing(features, examples, scope)
    models = LI.fit_logistic(ready.rows(features, examples), ready.size(), labels, scope, CODES)
    MO.Bundle(ready, models).save(str(tmp_path / "b"))
    again = MO.load_bundle(spark, str(tmp_path / "b")).score(features, examples)
    mine = {(r["subject_id"], r["code"]): r["p"] for r in models.score(ready.rows(features, examples)).collect()}
    assert {(r["subject_id"], r["code"]): r["p"] for r in again.collect()} == pytest.approx(mine)


# Trees


def _plain_tree(x, g, h, cfg):
    """Best-first growth on bins by trying every split; x has -1 for nulls."""
    def gain(rows):
        best = None
        total = lambda r: (g[r].sum(), h[r].sum(), len(r))
        score = lambda t: t[0] ** 2 / (t[1] + cfg.l2_regularization)
        for null_left in (False, True):
            for f in range(x.shape[1]):
                if null_left and not (x[rows, f] < 0).any():
                    continue
                for b in range(x[:, f].max() + 1):
                    left = np.where(x[rows, f] < 0, null_left, x[rows, f] <= b)
                    lo, hi = total(rows[left]), total(rows[~left])
                    if min(lo[2], hi[2]) < cfg.min_samples_leaf or min(lo[1], hi[1]) < BO.LEAST_HESSIAN:
                        continue
                    value = round(score(lo) + score(hi) - score(total(rows)), 9)
                    if value > 0 and (best is None or value > best[0]):
                        best = (value, rows[left], rows[~left])
        return best

    leaves = [np.arange(len(x))]
    while len(leaves) < cfg.max_leaf_nodes:
        found = [(gain(r), i) for i, r in enumerate(leaves)]
        found = [(b, i) for b, i in found if b]
        if not found:
            break
        best, i = max(found, key=lambda t: t[0][0])
        leaves[i:i + 1] = [best[1], best[2]]
    step = np.zeros(len(x))
    for r in leaves:
        step[r] = -cfg.learning_rate * g[r].sum() / (h[r].sum() + cfg.l2_regularization)
    return step


@pytest.mark.parametrize("leaves", [3, 7])
def test_trees_match_brute_force(spark, leaves):
    features, labels, examples = _data(spark, n=160, seed=leaves, nulls=True)
    scope = examples.filter("subject_id % 5 <> 1").select("subject_id")
    cfg = TreeConfig(max_iter=6, max_leaf_nodes=leaves, learning_rate=0.3, max_bins=16)
    bins = BO.fit_bins(features, scope, cfg.max_bins)
    bins = spark.createDataFrame(bins.collect(), bins.schema)
    rows = BO.binned_rows(features, bins, examples)
    models = BO.fit_trees(rows, bins, labels, scope, CODES, cfg)
    scores = {(r["subject_id"], r["code"]): r["p"] for r in models.score(rows).collect()}
    held = {(r["subject_id"], r["feature"]): r["value"] for r in features.collect()}
    table = {r["feature"]: r for r in bins.collect()}
    names = sorted(table)
    place = lambda s, f: -1 if (v := held.get((s, f), 0.0)) is None else sum(c < v for c in table[f]["cuts"])
    x = np.array([[place(s, f) for f in names] for s in range(160)])
    for code in CODES[:3]:
        told = {r["subject_id"]: r for r in labels.filter(F.col("code") == code).collect()}
        fit = np.array([s for s in range(160) if s % 5 != 1 and told[s]["at_risk"]])
        y = np.array([told[s]["y"] for s in fit])
        raw = np.full(len(fit), math.log(y.sum() / (len(y) - y.sum())))
        for _ in range(cfg.max_iter):
            p = 1 / (1 + np.exp(-raw))
            raw += _plain_tree(x[fit], p - y, p * (1 - p), cfg)
        assert [scores[int(s), code] for s in fit] == pytest.approx((1 / (1 + np.exp(-raw))).tolist(), abs=1e-9)
    assert scores[3, "full"] == 1.0 and len(scores) == 160 * 5


def test_trees_beat_prevalence_and_do_without_features(spark):
    features, labels, examples = _data(spark, nulls=True)
    scope = examples.select("subject_id")
    bins = BO.fit_bins(features, scope, 255)
    bins = spark.createDataFrame(bins.collect(), bins.schema)
    rows = BO.binned_rows(features, bins, examples)
    models = BO.fit_trees(rows, bins, labels, scope, CODES, TreeConfig(max_iter=30))
    scored = models.score(rows).join(labels, ["subject_id", "cutoff", "code"])
    base = MO.constant_models(labels.filter("at_risk = 1"), scope, CODES).score(examples).join(labels, ["subject_id", "cutoff", "code"])
    loss = lambda df: {r["code"]: r["log_loss"] for r in M.masked_log_loss(df, ["code"]).collect()}
    mine, theirs = loss(scored), loss(base)
    assert all(mine[c] < theirs[c] for c in CODES[:3])
    none = BO.fit_bins(features.limit(0), scope, 255)
    assert none.count() == 0 and BO.fit_trees(rows, none, labels, scope, CODES, TreeConfig(max_iter=1)).trees["c0"] == []


# Cross-validation


def test_cross_validation_resumes_and_ranks_before_the_floor(spark, tmp_path):
    _, labels, examples = _data(spark, n=60)
    examples = examples.withColumn("is_real", F.lit(True))
    labels = labels.withColumn("prevalent", F.lit(0)).filter("code <> 'full'")
    folds = examples.select("subject_id", (F.col("subject_id") % 3).alias("fold"))
    built = []

    def build(scope):
        built.append(1)
        return "shared"

    def score(shared, scope, held):
        assert shared == "shared"
        return MO.constant_models(labels, scope, CODES[:4]).score(held)

    run = lambda tag: MO.run_cv(build, {"m": score}, examples, labels, folds, 3, str(tmp_path), {"m": tag})
    table = {r["fold"]: r for r in MO.cv_table(run("1")).collect()}
    assert set(table) == {-1, 0, 1, 2} and len(built) == 3
    assert all(table[k]["macro_auroc"] == pytest.approx(0.5) and table[k]["n_oof"] == 20 for k in range(3)) and table[-1]["n_oof"] == 60
    run("1")
    assert len(built) == 3  # all folds were stored
    run("2")
    assert len(built) == 6


# Bootstrap


def _plain_metrics(rows, w):
    pos = [(p, w[s]) for s, p, y in rows if y]
    neg = [(p, w[s]) for s, p, y in rows if not y]
    n_pos, n_neg = sum(x[1] for x in pos), sum(x[1] for x in neg)
    if not n_pos or not n_neg:
        return n_pos, n_neg, None, None
    wins = sum(a * b * (1.0 if p > q else 0.5 if p == q else 0.0) for p, a in pos for q, b in neg)
    ap = 0.0
    for t in {p for p, _ in pos}:
        tp, fp = sum(a for p, a in pos if p >= t), sum(b for q, b in neg if q >= t)
        ap += sum(a for p, a in pos if p == t) * tp / (tp + fp) if tp + fp else 0.0
    return n_pos, n_neg, wins / (n_pos * n_neg), ap / n_pos


@pytest.mark.parametrize("cells", [2, 256])
def test_bootstrap_matches_plain_resampling(spark, monkeypatch, cells):
    monkeypatch.setattr(BS, "CELLS", cells)
    monkeypatch.setattr(BS, "_SUBJECTS", 7)
    rng = random.Random(cells)
    data = [(s, m, c, rng.choice([0.1, 0.25, 0.5, 0.5, 0.75, rng.random()]), int(rng.random() < (0.04 if c == "thin" else 0.4)))
            for s in range(40) for m in "ab" for c in ("x", "thin", "none")]
    data = [(s, m, c, p, 0 if c == "none" else y) for s, m, c, p, y in data]
    rows = spark.createDataFrame(data, "subject_id long, model string, code string, p double, y int")
    weights = {r["subject_id"]: np.frombuffer(r["w"], "<u2") for r in BS.subject_weights(rows, 9, 7).collect()}
    assert (sum(weights.values()) == 40).all()
    ranked = {r["subject_id"]: r["rank"] for r in BS.hash_rank(rows.select("subject_id").distinct(), "subject_id", 7).collect()}
    slots = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("r"), "id").select("r", (draw(7, F.col("r"), F.col("id")) % 40).alias("rank"))
    drawn = {(x["r"], x["rank"]): x["count"] for x in slots.groupBy("r", "rank").count().collect()}
    assert all(weights[s][b] == drawn.get((b, k), 0) for s, k in ranked.items() for b in range(9))
    got = {(r["model"], r["code"], r["replicate"]): (r["n_pos"], r["n_neg"], r["auroc"], r["ap"]) for r in BS.bootstrap_by_label(rows, 9, 7).collect()}
    assert len(got) == 2 * 3 * 9
    for (m, c, b), found in got.items():
        mine = [(s, p, y) for s, m_, c_, p, y in data if (m_, c_) == (m, c)]
        expected = _plain_metrics(mine, {s: int(w[b]) for s, w in weights.items()})
        assert found[:2] == expected[:2]
        assert found[2:] == (pytest.approx(expected[2:]) if expected[2] is not None else (None, None))


# Iterative stratification


def test_shares_equal_one_by_one_dealing():
    rng = random.Random(2)
    for _ in range(300):
        k = rng.randrange(1, 6)
        need = [rng.choice([rng.uniform(-3, 9), float(rng.randrange(-3, 9)), 2.4]) for _ in range(k)]
        size = [rng.randrange(5) for _ in range(k)]
        n = rng.randrange(0, 40)
        taken = [0] * k
        for _ in range(n):
            f = min(range(k), key=lambda f: (-round(need[f] - taken[f], 9), size[f] + taken[f], f))
            taken[f] += 1
        assert FO.fold_shares(n, need, size) == taken
    assert sum(FO.fold_shares(10**9 + 3, [0.5, 7.25, 7.25], [1, 2, 2])) == 10**9 + 3


def test_iterative_folds_match_plain_rounds(spark):
    rng = random.Random(8)
    rate = {"x": 0.04, "y": 0.2, "z": 0.5}
    held = {s: {c for c, q in rate.items() if rng.random() < q} for s in range(300)}
    rows = [(s, c, int(c in held[s])) for s in held for c in [*rate, "none"]]
    labels = spark.createDataFrame(rows, "subject_id long, code string, y int")
    got = {r["subject_id"]: r["fold"] for r in FO.iterative_folds(labels).collect()}
    assert set(got) == set(held)
    order = sorted(rate, key=lambda c: (sum(c in h for h in held.values()), c))
    need, size, seen = {c: [sum(c in h for h in held.values()) / 5] * 5 for c in order}, [0] * 5, set()
    for c in [*order, None]:
        mine = [s for s in held if s not in seen and (c is None or c in held[s])]
        shares = FO.fold_shares(len(mine), need[c] if c else [-x for x in size], size)
        assert [sum(got[s] == f for s in mine) for f in range(5)] == shares
        for s in mine:
            size[got[s]] += 1
            for other in held[s]:
                need[other][got[s]] -= 1
        seen |= set(mine)
    first = [sum(got[s] == f for s in held if order[0] in held[s]) for f in range(5)]
    assert max(first) - min(first) <= 1 and max(size) - min(size) <= 3
    assert FO.iterative_folds(labels.limit(0)).count() == 0


def test_range_rank_over_groups_and_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.randrange(2), rng.randrange(5), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, k int, v int, i long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = DI.range_rank(df, ["g", "k"], ["v", "i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in sorted(got, key=lambda r: (r["g"], r["k"], r["v"], r["i"])):
        groups.setdefault((r["g"], r["k"]), []).append(r)
    assert len(got) == len(rows)
    for mine in groups.values():
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {r["rank_n"] for r in mine} == {len(mine)}
    assert DI.range_rank(df.limit(0), ["g", "k"], ["v", "i"]).count() == 0


def test_sums_of_trees_hold_one_block_at_a_time_and_come_once_a_task(spark):
    layout = BO.Layout(np.array([0, 4]), np.array([3, 7]), np.array([1, 0]))
    rng = np.random.default_rng(8)

    def block():
        bins = np.stack([rng.integers(0, 4, 50), rng.integers(0, 4, 50)], axis=1).astype(np.uint16)
        y, risk = (rng.random((2, 50, 3)) < 0.6).astype(np.uint8)
        return BO.TreeBlock(bins, y, risk, rng.standard_normal((50, 3)), range(3))

    made, alive = [], []

    def stream():
        for _ in range(6):
            one = block()
            made.append((one.bins, one.y, one.risk, one.raw))
            alive.append(weakref.ref(one))
            yield one
            del one
            assert sum(r() is not None for r in alive) <= 2

    root = {code: (BO.Tree(), [0]) for code in range(3)}
    found = dict(BO._sums(stream(), root, layout))
    assert sorted(found) == [0, 1, 2]
    for code, (total, at, sums) in found.items():
        plain, dense = np.zeros((3, 8)), np.zeros((3, 8))
        for bins, y, risk, raw in made:
            for i in np.flatnonzero(risk[:, code]):
                p = 1 / (1 + np.exp(-raw[i, code]))
                for f in (0, 1):
                    if bins[i, f] != layout.zero[f]:
                        plain[:, layout.offset[f] + bins[i, f]] += p - y[i, code], p * (1 - p), 1
        dense[:, at] = sums
        assert np.allclose(dense, plain) and total[2, 0] == sum(m[2][:, code].sum() for m in made)
    many = spark.sparkContext.parallelize(range(40), 40)
    assert BO.few_tasks(many, 4).getNumPartitions() == 8 and sorted(BO.few_tasks(many, 4).collect()) == list(range(40))
    assert BO.few_tasks(many, 20).getNumPartitions() == 40
