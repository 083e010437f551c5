import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import links, softassign


def dense(a, b, radius, how=softassign.Annealing()):
    """The whole matrix with its outlier row and column, as written down in one loop."""
    n, m = len(a), len(b)
    shift, beta = np.zeros((n, 2)), how.beta
    while beta < how.beta_end:
        score = np.zeros((n + 1, m + 1))
        for i in range(n):
            for j in range(m):
                s = -(((a[i] - shift[i] - b[j]) ** 2).sum() - how.alpha)
                score[i, j] = s if s >= -(radius**2) else -np.inf
        w = np.exp(beta * score)
        for _ in range(how.rounds):
            step = w / w.sum(1, keepdims=True)
            step = step / step.sum(0, keepdims=True)
            done = (np.abs(step - w) < how.tolerance).all()
            w = step
            if done:
                break
        shift = np.array([sum(w[i, j] * (a[i] - b[j]) for j in range(m)) for i in range(n)]).reshape(n, 2)
        beta, radius = beta * how.beta_rate, radius * how.radius_rate
    best = w[:n].argmax(1)
    return {i: (int(best[i]), w[i, best[i]]) for i in range(n) if best[i] < m}


@pytest.mark.parametrize("radius", [1.5, 20.0])
def test_frames_equal_the_dense_loop(spark, radius):
    rng = np.random.default_rng(7)
    frames = [rng.uniform(0, 12, (n, 2)) for n in (14, 9)]
    frames += [frames[1] + rng.normal(0, 0.3, (9, 2)), np.vstack([frames[0][:5] + 0.4, [[40.0, 40.0]]])]
    rows = [(t, 2**33 + i, float(x), float(y)) for t, f in enumerate(frames) for i, (x, y) in enumerate(f)] + [(1, 5, None, 2.0)]
    points = spark.createDataFrame(rows, "tp int, pt long, x double, y double")
    got = {}
    for r in softassign.soft_pairs(points, points.withColumn("tp", F.col("tp") - 1), radius).collect():
        got.setdefault(r.tp, {})[r.pt1 - 2**33] = (r.pt2 - 2**33, r.weight, r.dist)
    for t in range(3):
        want = dense(frames[t], frames[t + 1], radius)
        assert {i: j for i, (j, _, _) in got.get(t, {}).items()} == {i: j for i, (j, _) in want.items()}
        assert all(got[t][i][1] == pytest.approx(want[i][1]) and got[t][i][2] == pytest.approx(float(np.hypot(*(frames[t][i] - frames[t + 1][want[i][0]])))) for i in want)
    assert got[1] == {i: (i, *got[1][i][1:]) for i in range(9)} or radius > 2  # small moves are found again


def test_near_pairs_equal_all_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 5, (200, 2)), rng.normal(0, 5, (150, 2))
    for radius in (0.3, 2.0, 50.0):
        i, j = softassign.near_pairs(a, b, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(200) for y in range(150) if ((a[x] - b[y]) ** 2).sum() <= radius**2} and len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True)))
    assert len(softassign.near_pairs(a[:0], b, 1.0)[0]) == 0


def test_rules_by_name(spark):
    assert set(links.rules()) == {"nearest", "mutual", "matched", "soft"}
    rows = [(t, 2**40 + 10 * t + i, 10.0 * i + 0.2 * t, 0.0) for t in range(5) for i in range(3)]
    points = spark.createDataFrame(rows, "tp int, pt long, x double, y double")
    for rule in ("Nearest", "mutual", "matched", "soft", links.link_by_mutual):
        chains = {(r.tp, r.pt): (r.root_tp, r.root_pt, r.depth) for r in links.linked_by(points, rule, 3.0).collect()}
        assert chains == {(t, 2**40 + 10 * t + i): (0, 2**40 + i, t) for t in range(5) for i in range(3)}, rule
    chains = {(r.tp, r.pt): (r.root_tp, r.root_pt, r.depth) for r in links.linked_by(points, "nearest", 3.0, step=2).collect()}
    assert chains == {(t, 2**40 + 10 * t + i): (t % 2, 2**40 + 10 * (t % 2) + i, t // 2) for t in range(5) for i in range(3)}
    with pytest.raises(KeyError):
        links.links_of(points, "other", 3.0)
    with pytest.raises(TypeError):
        links.links_of(points, 3, 3.0)
