"""Profiles against numpy."""

import numpy as np

from gaugeworks.operators import evaluation, features, profiles
from gaugeworks.plans import catalogue
from gaugeworks.sources import proxies


def descended(x, y, steps=2000, rate=0.1, seed=0):
    """Probabilities after full-batch descent on standardised columns."""
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1.0, std)
    w, b = np.random.default_rng(seed).normal(0.0, 0.01, x.shape[1]), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * z.T @ e / len(z), b - rate * e.mean()
    return 1 / (1 + np.exp(-(z @ w + b)))


def test_logistic_bot_trains_as_long_as_numpy(spark, sf):
    touch = proxies.touch(spark, sf)
    v = features.feature_vector(proxies.sessions(spark, sf), touch, proxies.keys(spark, sf), proxies.motion(spark, sf)).collect()
    x = np.array([[r[n] for n in features.FEATURES] for r in v], float)
    ours = {r["session"]: (r["label"], r["score"]) for r in catalogue.logistic_bot(spark, sf).collect()}
    clicks = {r["session"]: r["count"] for r in touch.groupBy("session").count().collect()}
    y = np.array([float(clicks.get(r["session"], 0) > 13) for r in v])
    assert len(ours) == len(v) and [ours[r["session"]][0] for r in v] == y.tolist()
    assert np.abs(np.array([ours[r["session"]][1] for r in v]) - descended(x, y)).max() < 2e-6


def test_logistic_of_blocks(spark):
    """Many blocks, a constant column and fewer steps give the descent of one matrix."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(3, 2, 300), rng.normal(0, 1, 300), np.ones(300)])
    y = (x[:, 0] + rng.normal(0, 1, 300) > 3).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "i int, v array<double>, y int")
    fit = profiles.logistic(rows, "v", "y", steps=50, block=70)
    score = [r["score"] for r in profiles.logistic_scores(rows, "v", *fit).orderBy("i").collect()]
    assert np.abs(np.array(score) - descended(x, y, steps=50)).max() < 1e-12


def test_mahalanobis_score_is_numpys(spark, sf):
    rows = proxies.profiles(spark, sf).collect()
    ours = {r["vec_id"]: r["distance"] for r in catalogue.mahalanobis_score(spark, sf).collect()}
    assert len(ours) == len(rows)
    for subject in {r["subject"] for r in rows}:
        of = [r for r in rows if r["subject"] == subject]
        x = np.array([r["vector"] for r in of], float)
        cov = np.cov(x, rowvar=False) if len(x) > 1 else np.zeros((64, 64))
        d = x - x.mean(axis=0)
        theirs = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov + 1e-3 * np.eye(64)), d))
        assert np.abs(np.array([ours[r["vec_id"]] for r in of]) - theirs).max() < 2e-6


def test_subject_disjoint_split_numpy_is_the_greedy_one(spark, sf):
    first, n = {}, {}
    for r in proxies.scored(spark, sf).select("subject", "unit").collect():
        if r["subject"] is not None:
            first[r["subject"]] = min(first.get(r["subject"], r["unit"]), r["unit"])
            n[r["subject"]] = n.get(r["subject"], 0) + 1
    listed = sorted(first, key=lambda s: (first[s], s))
    target, taken, split = max(1, int(proxies.scored(spark, sf).count() * 0.25)), 0, {}
    for i in np.random.default_rng(0).permutation(len(listed)):
        split[listed[i]] = "test" if taken < target else "train"
        taken += n[listed[i]] if taken < target else 0
    ours = catalogue.subject_disjoint_split_numpy(spark, sf).collect()
    assert {r["subject"]: (r["n"], r["split"]) for r in ours} == {s: (n[s], split[s]) for s in n} and len(ours) == len(n)


def test_covariances_far_from_zero(spark):
    """Values of 1e6 with deviations of 0.01, several batches and partitions, a group of one row."""
    rng = np.random.default_rng(2)
    x = {g: 1e6 + rng.normal(0, 0.01, (n, 4)) for g, n in (("a", 400), ("b", 37), ("c", 1))}
    rows = spark.createDataFrame([(g, v.tolist()) for g, m in x.items() for v in m], "g string, v array<double>").repartition(5)
    got = {r["g"]: r for r in profiles.covariances(rows, "g", "v", 4).collect()}
    for g, m in x.items():
        assert got[g]["n"] == len(m)
        assert np.allclose(got[g]["mean"], m.mean(axis=0), rtol=1e-15)
        want = np.cov(m, rowvar=False) if len(m) > 1 else np.zeros((4, 4))
        assert np.allclose(np.reshape(got[g]["cov"], (4, 4)), want, rtol=1e-5, atol=1e-9)


def brute_eer(scores, labels):
    best, out = 1.0, 0.5
    for t in np.unique(scores):
        fpr, fnr = (scores[labels == 0] >= t).mean(), (scores[labels == 1] < t).mean()
        if abs(fpr - fnr) < best:
            best, out = abs(fpr - fnr), (fpr + fnr) / 2
    return out


def test_evaluation_is_numpys(spark):
    """Genuine sessions alone are learned; imposters and bots of the same set and of another are told apart."""
    rng = np.random.default_rng(6)
    sets = []
    for shift in (0.0, 0.7):
        sets.append([(f"{label}{i}", label, (rng.normal(0, 1, 3) * [1, 5, 0.1] + mean + shift).tolist()) for label, mean in (("genuine", 0.0), ("imposter", 1.0), ("bot", 2.5)) for i in range(60)])
    frames = [spark.createDataFrame(x, "session string, label string, vector array<double>") for x in sets]
    got = {r["domain"]: r for r in evaluation.evaluated(*frames, 3).collect()}
    v = lambda x, *labels: np.array([r[2] for r in x if r[1] in labels])
    genuine = v(sets[0], "genuine")
    inverse = np.linalg.pinv(np.cov(genuine, rowvar=False) + 1e-3 * np.eye(3))
    every, y = v(sets[0], "genuine", "imposter", "bot"), np.array([float(r[1] == "bot") for r in sets[0]])
    std = every.std(axis=0)
    z = (every - every.mean(axis=0)) / std
    w, b = np.random.default_rng(0).normal(0.0, 0.01, 3), 0.0
    for _ in range(2000):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.1 * z.T @ e / len(z), b - 0.1 * e.mean()
    for domain, test in (("in", sets[0]), ("cross", sets[1])):
        d = v(test, "genuine", "imposter") - genuine.mean(axis=0)
        scores = np.sqrt(np.einsum("ij,jk,ik->i", d, inverse, d))
        assert abs(got[domain]["auth_eer"] - brute_eer(scores, np.array([float(r[1] == "imposter") for r in test if r[1] != "bot"]))) < 1e-9
        p = 1 / (1 + np.exp(-(((v(test, "genuine", "imposter", "bot") - every.mean(axis=0)) / std) @ w + b)))
        assert abs(got[domain]["bot_accuracy"] - ((p >= 0.5) == np.array([r[1] == "bot" for r in test])).mean()) < 1e-9


def test_models_without_rows(spark):
    """Nothing learned gives no scores; a domain without sessions has the values of an empty set; nulls are passed over."""
    none = spark.createDataFrame([], "session string, label string, vector array<double>")
    got = {r["domain"]: (r["auth_eer"], r["bot_accuracy"]) for r in evaluation.evaluated(none, none, 3).collect()}
    assert got == {"in": (0.5, 0.0), "cross": (0.5, 0.0)}
    rows = spark.createDataFrame([("a", "bot", [1.0, 2.0]), ("b", "genuine", None), ("c", "genuine", [0.0, 5.0])], "session string, label string, vector array<double>")
    empty = profiles.logistic(rows.filter("false"), "vector", "label")
    assert [r["score"] for r in profiles.logistic_scores(rows, "vector", *empty).collect()] == [None] * 3
    scores = {r["session"]: r["score"] for r in evaluation.bot_scores(rows, rows, steps=50).collect()}
    assert scores["b"] is None and scores["a"] > 0.5 > scores["c"]


def test_profiles_are_those_of_covariances(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i % 3 or None, rng.normal(1e6, 3, 4).tolist()) for i in range(50)] + [(1, None)], "g int, v array<double>")
    cov = {r["g"]: np.array(r["cov"]).reshape(4, 4) for r in profiles.covariances(rows, "g", "v", 4).collect()}
    for r in profiles.profiled(rows, "g", "v", 4, ridge=0.01, shrink=0.2).collect():
        c = cov.pop(r["g"])
        want = np.linalg.pinv(0.8 * c + 0.2 * np.diag(np.diag(c)) + 0.01 * np.eye(4))
        assert np.allclose(np.array(r["inverse"]).reshape(4, 4), want, rtol=1e-9, atol=0)
    assert not cov
