"""Density clusters against a brute-force hierarchy over all pairs."""

import numpy as np
import pytest

from netloom.operators import blocked, cluster, density


def brute(x, least, min_samples=1):
    """The single-linkage tree of mutual reachability from the top down; (labels by point)."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    core = np.sort(d + np.diag(np.full(n, np.inf)), 1)[:, min_samples - 1]
    d = np.maximum(np.maximum(d, core), core[:, None])

    def parts(points, height):
        """Connected pieces of edges below the height."""
        left, out = set(points), []
        while left:
            stack, own = [left.pop()], []
            while stack:
                p = stack.pop()
                own.append(p)
                new = [q for q in left if d[p, q] < height]
                left.difference_update(new)
                stack += new
            out.append(own)
        return out

    def top(points):
        """The largest height at which these points fall apart: the largest edge of their tree."""
        best, near, worst = {q: d[points[0], q] for q in points[1:]}, points[0], 0.0
        while best:
            q = min(best, key=best.get)
            worst = max(worst, best.pop(q))
            for r in best:
                best[r] = min(best[r], d[q, r])
        return worst

    def grow(points, birth, root):
        """(worth, clusters) of the best choice at or below a cluster that begins with these points."""
        stable, now = 0.0, points
        while True:
            height = top(now)
            level, pieces = 1 / max(height, 1e-12), parts(now, height)
            large = [p for p in pieces if len(p) >= least]
            stable += (len(now) - sum(map(len, large)) * (len(large) == 1)) * (level - birth)
            if len(large) != 1:
                break
            now = large[0]
        below = [grow(p, level, False) for p in large]
        inner = sum(w for w, _ in below)
        if not below or (stable >= inner and not root):
            return stable, [points]
        return inner, [c for _, own in below for c in own]

    labels = np.full(n, -1)
    for c in grow(list(range(n)), 0.0, True)[1] if n >= least else []:
        labels[c] = min(c)
    return labels


def cohort(seed, n):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, size=(n // 5, 2)) for c, s in (((0, 0), 0.3), ((3, 0), 0.5), ((0, 4), 0.2), ((0.5, 4.5), 0.2))])
    return np.concatenate([x, rng.uniform(-4, 8, size=(n - len(x), 2))])


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node_id long, v array<double>").repartition(3)


def named(labels, n):
    """Labels as the smallest point of each cluster."""
    first = {}
    rows = sorted(map(tuple, labels.collect()))
    assert [i for i, _ in rows] == list(range(n))
    return np.array([first.setdefault(c, i) if c >= 0 else -1 for i, c in rows])


@pytest.mark.parametrize("n,least,min_samples,blocks,most", [(500, 12, 3, 64, 700), (200, 5, 1, 4096, 10**6), (300, 8, 2, 40, 150)])
def test_equal_to_brute_force(spark, monkeypatch, n, least, min_samples, blocks, most):
    monkeypatch.setattr(blocked, "BLOCK", blocks)
    monkeypatch.setattr(density, "RANGE", most)
    x = cohort(n, n)
    want = brute(x, least, min_samples)
    got = named(cluster.hdbscan(frame(spark, x), "v", least, min_samples), n)
    assert len(set(want)) > 2 and (got == want).all()


def test_noise_takes_its_nearest_cluster(spark, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 50)
    x = cohort(7, 240)
    df = frame(spark, x)
    plain, full = named(cluster.hdbscan(df, "v", 10), 240), named(cluster.hdbscan(df, "v", 10, noise_to_cluster=True), 240)
    for i in range(240):
        inside = np.flatnonzero(plain >= 0)
        near = inside[((x[inside] - x[i]) ** 2).sum(1).argmin()]
        assert (full[i] == full[near]) and (plain[i] < 0 or (full[i] == full[plain[i]]))


def test_equal_points_and_few_points(spark):
    same = named(cluster.hdbscan(frame(spark, np.zeros((30, 2))), "v", 5), 30)
    assert (same == 0).all()
    assert named(cluster.hdbscan(frame(spark, np.eye(3)), "v", 5), 3).tolist() == [-1, -1, -1]
    assert cluster.hdbscan(frame(spark, np.eye(3)).where("node_id < 0"), "v", 5).count() == 0
    assert named(cluster.hdbscan(frame(spark, np.eye(1)), "v", 5), 1).tolist() == [-1]


@pytest.mark.parametrize("dim", [2, 12])
def test_links_between_blocks_hold_the_tree(dim):
    """Trees within two blocks and between them hold the tree of all points; copies weigh their cores."""
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(40, dim)), rng.normal(size=(30, dim))
    y[:10] = x[:10]
    a, b, c, e = np.arange(40), 100 + np.arange(30), rng.uniform(0, 0.5, 40), rng.uniform(0, 0.5, 30)
    c[:5] = e[:5] = 0
    whole = density.spanning(np.r_[a, b], np.r_[x, y], np.r_[c, e], "euclidean")
    own = [t[k].to_numpy() for t in (density.spanning(a, x, c, "euclidean"), density.spanning(b, y, e, "euclidean")) for k in "abw"]
    links = density.crossing(a, x, c, b, y, e, "euclidean")
    assert len(links[0]) == 69 and (links[2] == np.maximum(np.maximum(((x[links[0]] - y[links[1] - 100]) ** 2).sum(1), c[links[0]]), e[links[1] - 100])).all()
    together = [np.concatenate([own[k], own[3 + k], links[k]]) for k in range(3)]
    keep = density.thinned(*together)
    assert len(keep) == 69 and sorted(together[2][keep]) == sorted(whole["w"])


def test_squares_are_thinned_together(spark, monkeypatch):
    """Many blocks, several to a side: the same clusters, from not many more edges than points."""
    monkeypatch.setattr(blocked, "BLOCK", 8)
    monkeypatch.setattr(blocked, "LEAST_SIDES", 4)
    monkeypatch.setattr(blocked, "SIDE", 2)
    monkeypatch.setattr(density, "SIDES", 2)
    x = cohort(3, 200)
    assert (named(cluster.hdbscan(frame(spark, x), "v", 8, 2), 200) == brute(x, 8, 2)).all()
    edges, own = density.tree_edges(frame(spark, x), "v", 2, "euclidean", "node_id")
    assert own.count() >= 20 and edges.count() <= 5 * 200
