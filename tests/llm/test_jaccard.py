import math
import random
import re

import numpy as np
import pytest

from pagewright.llm import graph
from pagewright.llm import jaccard as J


def brute(texts, percent=80):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        whole = {tuple(words)} if words else set()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else whole)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= percent * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def some_texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([5, 50, 500]))]
    shared, out = [r.choice(words) for _ in range(30)], []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.6:
            own = (r.choice(out) or "a").split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[r.choice(words)], [], [own[at], r.choice(words)]])
                own = own or ["a"]
            out.append(" ".join(own))
        elif kind < 0.7:
            out.append(r.choice(["", None, "a", "a b", "A  B", "a\tb", "\u00c9 x", "\u00e9 x", " \n"]))
        else:
            out.append(" ".join([r.choice(words) for _ in range(r.choice([3, 5, 20, 60, 150]))] + (shared if r.random() < 0.5 else [])))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_regions_in_memory(seed):
    texts = some_texts(seed, 70)
    sizes, parts = brute(texts)
    sets = J.shingle_sets(texts)
    assert [len(s) for s in sets] == sizes
    links = J.region_links(sets, 80)
    root = list(range(len(texts)))
    if links:
        for node, low in zip(*graph.smallest_reachable(*map(np.array, zip(*links)))):
            root[node] = low
    assert root == parts


@pytest.mark.parametrize("seed, options", [(100, {}), (101, {}), (102, {"region_sets": 6}), (103, {"region_shingles": 300})])
def test_documents(spark, seed, options):
    texts = some_texts(seed, 200)
    sizes, parts = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs, **options).collect()}
    assert found == {i: (sizes[i], parts[i]) for i in range(len(texts))}


def test_other_thresholds(spark):
    texts = some_texts(7, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in J.similar_documents(docs, percent=90).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 90)[1]


def test_a_low_threshold(spark):
    # 400 pairs of 100 shingles each, of which they share 67: 50 percent of the union.
    texts = []
    for i in range(400):
        own = [f"p{i}w{k}" for k in range(104)]
        texts += [" ".join(own), " ".join(own[:71] + [f"q{i}w{k}" for k in range(33)])]
    sizes, parts = brute(texts[:2], 50)
    assert sizes == [100, 100] and parts == [0, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in J.similar_documents(docs, percent=50).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("percent", [30, 50, 60])
def test_low_thresholds_like_brute_force(spark, percent):
    texts = some_texts(8, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in J.similar_documents(docs, percent=percent).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, percent)[1]


def test_bits_of_a_sketch_follow_from_the_threshold():
    bits = [J.sketch_bits(p) for p in (90, 80, 60, 50)]
    assert bits == sorted(bits)
    for percent, most in zip((90, 80, 60, 50), bits):
        p = (1 - percent / 100) / 2
        past = [sum(math.comb(256, k) * p**k * (1 - p) ** (256 - k) for k in range(n, 257)) for n in (most, most + 1)]
        assert past[1] <= 2.0**-64 < past[0]


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(400):
        own = list(base)
        own[i % 60] = f"x{i}"
        texts.append(" ".join(own))
    texts += ["other words that nobody else has in here"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r.doc_id: r.component_id for r in J.similar_documents(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)[1]


def test_bound_of_the_window():
    for n in range(1, 300):
        w = J.window(n, 80)
        # Two sets of at least 80 % share ceil(0.8 n) elements, so the first w of n hold one of them.
        assert w == n - -(-8 * n // 10) + 1 and 1 <= w <= n


def test_sketches_of_similar_sets_are_near():
    r = np.random.default_rng(3)
    for n in (20, 200):
        for _ in range(100):
            pool = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            common = round(2 * n * 0.8 / 1.8)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
            assert np.bitwise_count(J.sketch(a) ^ J.sketch(b)).sum() <= J.sketch_bits(80)


def test_representatives_across_chunks_stay_within_the_bound(spark):
    # Sketches as far apart as allowed, each represented by one that is SKETCH_NEAR bits further off.
    far = J.sketch_bits(80) + 2 * J.SKETCH_NEAR
    other = (1 << far) - 1
    words = [int.from_bytes((other >> 64 * i & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True) for i in range(4)]
    for least, rows in ((words[1], 1), (words[1] ^ 1 << 62, 0)):
        # One more differing bit is too many.
        postings = spark.createDataFrame([(7, 0, 0, 0, 0), (7, words[0], least, words[2], words[3])], "a long, b long, c long, d long, e long")
        assert J._meeting_edges(postings).count() == rows


def test_large_meetings_are_connected_like_small_ones(monkeypatch):
    r = np.random.default_rng(4)
    keys = r.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    keys[150:] = keys[:150] ^ np.uint64(5)
    pivot = np.repeat(np.arange(3, dtype=np.uint64), 100)

    def parts():
        x, y = J.meeting_edges(pivot, keys, 120)
        return [tuple(map(tuple, graph.smallest_reachable(x, y)))]

    whole = parts()
    monkeypatch.setattr(J, "MEETING_GROUP", 10)
    assert parts() == whole


def test_rows_of_a_dealt_pivot_meet():
    r = np.random.default_rng(5)
    pivot = np.repeat(np.arange(1, 4, dtype=np.uint64), 40)
    blocks = np.repeat([1, 4, 8], 40)
    key, row = J.spread_pivots(pivot, r.integers(-(1 << 62), 1 << 62, 120), blocks)
    assert np.bincount(row).tolist() == blocks.tolist()
    tasks = [set(key[row == i].tolist()) for i in range(120)]
    for i in range(120):
        assert all((pivot[i] == pivot[k]) == bool(tasks[i] & tasks[k]) for k in range(i))


@pytest.mark.parametrize("reach", [0.1, 0.2, 0.4, 0.7])
def test_linked_documents_share_a_cell(reach):
    r = np.random.default_rng(6)
    for n in (3, 40, 300):
        points = r.random((n, 3)) * r.choice([0.3, 1.0])
        pivots = points[r.choice(n, min(n, 6), replace=False)]
        cells = J.voronoi_cells(np.abs(points[:, None] - pivots).max(axis=2), reach)
        assert set(np.concatenate(cells).tolist()) == set(range(n))
        member = [{k for k, c in enumerate(cells) if i in c} for i in range(n)]
        apart = np.abs(points[:, None] - points).max(axis=2)
        for i, k in np.argwhere(apart <= reach):
            assert member[i] & member[k]


def test_cells_in_sql_are_those_in_memory(spark):
    r = np.random.default_rng(7)
    distance = np.round(r.random((200, 5)), 2)
    rows = [(i, list(map(float, d))) for i, d in enumerate(distance)]
    found = spark.createDataFrame(rows, "doc long, distance array<double>").select("doc", J._cell_numbers(0.2).alias("c")).collect()
    cells = J.voronoi_cells(distance, 0.2)
    assert {(x.doc, c) for x in found for c in x.c} == {(int(i), k) for k, c in enumerate(cells) for i in c}


def at_the_threshold(seed, n):
    """Texts of a chain in which neighbours have exactly 80 percent in common, beside pairs just below."""
    r = random.Random(seed)
    out = []
    for g in range(n):
        # 4 k + 4 words in a row are 4 k shingles; the next text shares 4 k of 5 k with it.
        k = r.randrange(2, 30)
        words = [f"g{g}w{i}" for i in range(5 * k + 4)]
        out.append(" ".join(words))
        out.append(" ".join(words[: 4 * k + 4]))
        out.append(" ".join(words[: 4 * k + 3]))
        out.append(" ".join(words[k:] + [f"g{g}z{i}" for i in range(k // 5)]))
    return out


@pytest.mark.parametrize("options", [{}, {"region_sets": 2}, {"region_shingles": 40}])
def test_similarities_at_the_threshold(spark, options):
    texts = at_the_threshold(1, 60)
    sizes, parts = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs, **options).collect()}
    assert found == {i: (sizes[i], parts[i]) for i in range(len(texts))}


def crowd(seed, n):
    """Texts of one region without a core: each of many small groups shares half of its words with all others."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    out = []
    for g in range(n):
        own = common + [f"g{g}w{i}" for i in range(30)]
        out.append(" ".join(own))
        own[r.randrange(42, len(own))] = "x"
        out.append(" ".join(own))
    return out


def test_a_region_without_a_core_is_divided(spark):
    texts = crowd(2, 60)
    sets = J.shingle_sets(texts)
    rows = [("r", i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    rows = spark.createDataFrame(rows, "piece string, doc long, n long, shingles binary")
    large = spark.createDataFrame([("r", len(rows.collect()), 12)], "piece string, sets long, blocks int")
    links = J._divide(rows, rows, large, 80, 20, 3_000_000)
    root = list(range(len(texts)))
    edges = [(x.a, x.b) for d in links for x in d.collect()]
    for node, low in zip(*graph.smallest_reachable(*map(np.array, zip(*edges)))):
        root[node] = low
    assert root == brute(texts)[1]


@pytest.mark.parametrize("seed", range(6))
def test_cells_in_memory(seed, monkeypatch):
    monkeypatch.setattr(J, "SEVERAL", 6)
    texts = crowd(seed, 40) + some_texts(seed, 60)
    sets = J.shingle_sets(texts)
    root = list(range(len(texts)))
    for node, low in zip(*graph.smallest_reachable(*map(np.array, zip(*J.region_links(sets, 80))))):
        root[node] = low
    assert root == brute(texts)[1]


def test_one_hot_class_and_many_empty_texts(spark, monkeypatch):
    from pagewright.llm import common

    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "MOST_HOT", 10)
    texts = ["the same text in a third of all rows of the table"] * 300 + [""] * 200 + [None] * 100
    texts += ["the same text in a third of all rows of the table now"] + some_texts(3, 150)
    sizes, parts = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs).collect()}
    assert found == {i: (sizes[i], parts[i]) for i in range(len(texts))}


def test_odd_rows(spark, odd, none):
    rows = J.similar_documents(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].component_id == 0  # only case and spaces differ
    assert {(r.n_shingles, r.component_id) for r in by_id[2]} == {(0, 2)}
    assert len(by_id[3]) == 2 and by_id[None][0].component_id is None
    assert J.similar_documents(none).count() == 0


def test_one_of_each(spark, odd):
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert 1 not in ids and ids.count(0) == 2 and None in ids and ids.count(3) == 2


def test_an_id_with_two_texts(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, first), (5, first + " x"), (5, second), (7, second + " y"), (9, "no other has this text at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.component_id) for r in J.similar_documents(docs).collect()} == {(1, 1), (5, 1), (7, 1), (9, 9)}
    assert sorted(map(tuple, J.one_of_each(docs).collect())) == [rows[0], rows[2], rows[4]]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {x.node: x.component for x in graph.connected_components(df, one_task=limit).collect()}
    assert found == {x: find(x) for x in root}
