import math

import numpy as np
import pytest

from pagewright.llm import embedlsh as E


def brute(rows, threshold=0.93):
    links, root = [0] * len(rows), list(range(len(rows)))

    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, va, la) in enumerate(rows):
        for j in range(i):
            b, vb, lb = rows[j]
            if la is None or la != lb or not usable(va) or not usable(vb) or len(va) != len(vb):
                continue
            x, y = np.array(va, float), np.array(vb, float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {r[0]: (links[i], find(i), find(i) == i) for i, r in enumerate(rows)}


def some_rows(seed, n=250, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.3:
            v = list(rows[r.integers(len(rows))][1] or [1.0] * dim)
        elif rows and kind < 0.6:
            base = rows[r.integers(len(rows))][1]
            v = [float((x or 0.0) + r.normal() * 0.15) for x in (base or [1.0] * dim)]
        else:
            v = [float(x) for x in r.normal(size=dim)]
        v = [float(np.float32(x)) if math.isfinite(x) else x for x in v]
        rows.append((i, v, int(r.integers(3)) if r.random() < 0.95 else None))
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [math.nan] + [1.0] * (dim - 1), 0), (n + 3, [None] + [1.0] * (dim - 1), 1)]
    rows += [(n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [math.inf] * dim, 1)]
    return rows


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 256), (3, 4)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = some_rows(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, raw string, kind int").repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, recall=0.9999).collect()}
    assert found == brute(rows)


def test_recall_and_precision_at_the_threshold(spark):
    """Pairs just above the threshold: the recall asked for; just below: none."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cosine = 0.932 if i % 2 else 0.928
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist(), i)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {x.vec_id: x.n_links for x in E.near_duplicates(df).collect()}
    above = [found[2 * i] for i in range(300) if i % 2]
    assert sum(above) >= 0.9 * len(above)
    assert not any(found[2 * i] for i in range(300) if not i % 2)


def test_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    rows = sorted((r.vec_id, r.n_links) for r in E.near_duplicates(df).collect())
    assert rows == [(1, 0), (1, 1), (2, 1)]
    assert E.near_duplicates(df.filter("1 = 0")).count() == 0


def test_plan():
    assert E.cell_chance(1e-6) == pytest.approx(1, abs=1e-4) and E.cell_chance(100.0) < 0.02
    small, large = E.plan_tables(100, 0.93, 0.99), E.plan_tables(10**9, 0.93, 0.99)
    assert small[0] < large[0] and small[1] < large[1]


def test_bytes_of_vectors():
    r = np.random.default_rng(8)
    short, long = r.normal(size=5).astype("<f4").astype(float), r.normal(size=5)
    assert len(E.packed(short)) == 21 and len(E.packed(long)) == 41
    assert np.array_equal(E.unpacked([E.packed(long), E.packed(short), E.packed(long)], 5), [long, short, long])
    assert E.packed(np.array([1e300, 0.0]))[:1] == b"d" and E.packed(np.array([1e-300, 0.0]))[:1] == b"d"


@pytest.mark.parametrize("size", [3, 64, 200])
def test_pairs_of_large_and_small_groups(size, monkeypatch):
    r = np.random.default_rng(size)
    x = E._unit(r.normal(size=(2 * size, 4)))
    group = np.repeat([1, 2], size)
    side = np.concatenate([np.full(size, 2), r.integers(0, 2, size)])
    want = {(i, k) for i in range(2 * size) for k in range(i + 1, 2 * size)
            if group[i] == group[k] and (side[i] == 2 or side[i] != side[k]) and x[i] @ x[k] >= 0.9}
    for least in (2, 10**6):
        monkeypatch.setattr(E, "MATRIX", least)
        found = [tuple(sorted(e)) for p, q in E._near(x, group, side, 0.9) for e in zip(p.tolist(), q.tolist())]
        assert len(found) == len(set(found)) and set(found) == want


def test_a_hot_bucket_of_several_blocks_and_a_hot_class(spark, monkeypatch):
    from pagewright.llm import common

    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "MOST_HOT", 5)
    r = np.random.default_rng(9)
    base = r.normal(size=8)
    rows = [(i, (base + r.normal(size=8) * 0.2).astype("<f4").tolist(), 0) for i in range(120)]
    rows += [(1000 + i, base.tolist(), 0) for i in range(60)] + [(2000 + i, r.normal(size=8).tolist(), 0) for i in range(40)]
    plain = [(k, v, lab) for k, (_, v, lab) in enumerate(rows)]
    df = spark.createDataFrame([(k, v, lab) for k, v, lab in plain], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_duplicates(df, recall=0.99999).collect()}
    assert found == brute(plain)
