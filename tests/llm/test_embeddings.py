"""Embedding near-duplicates against all pairs."""

import numpy as np
from test_simhash import groups

from crawlwright.llm import embeddings, queries

FOLDER = "/root/testdata/sf0.01"


def brute(rows, threshold=0.98):
    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, v, m), (_, w, n) = rows[a], rows[b]
        if m is None or m != n or not usable(v) or not usable(w) or len(v) != len(w):
            return False
        x, y = np.array(v, float), np.array(w, float)
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
    top = groups(list(range(len(rows))), linked)
    names = {}
    for k, t in top.items():
        names[t] = min(names.get(t, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], sum(linked(k, j) for j in range(len(rows)) if j != k), names[top[k]], rows[k][0] == names[top[k]])
                  for k in range(len(rows)))


def test_query(spark):
    """All vectors of the table, and some of them again, moved a little: every link is found, none below the threshold."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert len(queries.op2_embedding_dedup(spark, FOLDER).collect()) == len(rows)
    rng = np.random.default_rng(8)
    for k in range(200):
        _, v, label = rows[k % 60]
        x = np.array(v, np.float32) + (0.02 * rng.normal(size=len(v))).astype(np.float32) * (1 + k % 3) / 2
        rows.append((1000 + k, x.tolist(), label))
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([n for *_, n in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    top = groups(list(range(len(rows))), lambda a, b: near[a, b])
    want = sorted((ids[k], int(near[k].sum()), ids[top[k]], top[k] == k) for k in range(len(rows)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(frame).collect())) == want and near.sum() > 200


def test_recall():
    """Neighbours at the threshold's angle, the hardest ones, are met at the target recall."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48)) + 3 * rng.normal(size=(30, 48))[rng.integers(0, 30, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.fitted(x[:3000], 16, 0.98)
    near = x[3000:] + 0.2 / np.sqrt(48) * rng.normal(size=(3000, 48))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    met = (index.traversal(x[3000:], index.visits) == index.cells(near)[:, None]).any(axis=1)
    met |= (index.traversal(near, index.visits) == index.cells(x[3000:])[:, None]).any(axis=1)
    assert met.mean() >= 0.97 and index.visits < 100


def test_many_visits():
    """Vectors without clusters below a low threshold need more than the first visits; the target still holds."""
    x = np.random.default_rng(6).normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.fitted(x, 48, 0.7)
    side = np.random.default_rng(7).normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    near = 0.7 * x + np.sqrt(1 - 0.49) * side / np.linalg.norm(side, axis=1, keepdims=True)
    met = [((index.traversal(a, index.visits) == index.cells(b)[:, None]).any(axis=1)
            | (index.traversal(b, index.visits) == index.cells(a)[:, None]).any(axis=1)).mean()
           for a, b in ((x[k:k + 100], near[k:k + 100]) for k in range(0, 1500, 100))]
    assert index.visits > 256 and np.mean(met) >= 0.98


def test_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8))
    index = embeddings.fitted(x / np.linalg.norm(x, axis=1, keepdims=True), 6, 0.98)
    a, b = index.halves(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    assert (np.sort(total, axis=1)[:, :10] == np.take_along_axis(total, index.traversal(x, 10), axis=1)).all()


def test_cases(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 6)).tolist()
    near = [(x + rng.normal(size=6) * 0.02).tolist() for x in np.array(base)]
    rows = [(7, base[0], 1), (3, base[0], 1), (9, near[0], 1), (2, near[0], 2), (4, base[0], None), (5, None, 1), (6, [], 1), (1, [0.0] * 6, 1),
            (8, [1.0, None] + [0.0] * 4, 1), (10, [float("nan")] + [1.0] * 5, 1), (11, [float("inf")] + [1.0] * 5, 1),
            (12, (np.array(base[1]) * 1e-200).tolist(), 1), (13, (np.array(base[1]) * 1e200).tolist(), 1), (14, base[2][:4], 1),
            (15, base[2], 1), (16, near[2], 1), (16, near[2], 1), (17, [2.0], 1), (18, [3.0], 1), (19, [-1.0], 1), (20, [5.0], 2),
            (21, [float("inf")], 1), (22, [0.0], 1), (23, [-7.0], 1), (24, [None], 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    clear = [(i, None if i in (12, 13) else v, n) for i, v, n in rows]  # norms of these two overflow in the brute force
    want = [r for r in brute(clear) if r[0] not in (12, 13)]
    got = sorted(map(tuple, embeddings.near_duplicates(frame).collect()))
    assert [r for r in got if r[0] not in (12, 13)] == want
    assert [r for r in got if r[0] in (12, 13)] == [(12, 1, 12, True), (13, 1, 12, False)]
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    unknown = spark.createDataFrame([(None, base[0], 1), (3, base[0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(unknown).collect()) == [
        (0, 0, 0, True), (3, 0, 3, True)]
