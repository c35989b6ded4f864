"""Jaccard join and sharding against brute force; classifiers on planted signals."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablelog.llm import components as components_, jaccard_join, quality_cnn, sharding, store, toxicity_mil
from tablelog.llm.components import components

from .conftest import prose


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b])):
                top[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0], len(sets[k]), least[find(k)]) for k, r in enumerate(rows))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:8]
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    texts = []
    for size, n, edits in ((200, 40, 8), (120, 25, 6), (60, 30, 4), (9, 12, 1), (40, 20, 3)):
        texts += family(rng, prose(rng, size), n, edits)
    shared = prose(rng, 55)
    texts += [prose(rng, rng.randint(5, 60)) + " " + shared + " " + prose(rng, rng.randint(5, 60)) for _ in range(40)]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(60)] + ["same words here"] * 6 + ["", None, "one", "ONE"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[o]) for k, o in enumerate(order)]


def test_components_against_brute_force(spark, corpus, monkeypatch):
    want = brute_components(corpus)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_join.jaccard_components(df).collect()))
    assert got == want
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 900)  # groups are split, links across them found by asking
    monkeypatch.setattr(jaccard_join, "ASKING_SHINGLES", 300)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components_, "LAST_LINKS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == want


def test_components_of_edge_cases(edge, edge_rows, empty):
    rows = jaccard_join.jaccard_components(edge).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    assert got == brute_components(edge_rows)
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_groups_smaller_than_their_families(spark, monkeypatch):
    """Groups of a few documents each: nearly every link is found by documents that ask other groups."""
    rng = random.Random(17)
    base = prose(rng, 70)
    rows = [(k, t) for k, t in enumerate(family(rng, base, 150, 4) + family(rng, prose(rng, 30), 40, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "GROUP_DOCUMENTS", 3)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == brute_components(rows)


def test_each_receiver_has_a_task_of_its_own(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    n, held = 12, spark.conf.get("spark.sql.shuffle.partitions")

    def alone(step):
        def of(n):
            run = step(n)

            def watched(batches):
                batches = list(batches)
                receivers = {r % n for b in batches for r in b.column(0).to_pylist()}
                assert len(receivers) <= 1, f"one task holds the blocks of receivers {sorted(receivers)}"
                yield from run(iter(batches))

            return watched

        return of

    for name in ("_shared", "_prefixes", "_meet"):
        monkeypatch.setattr(jaccard_join, name, alone(getattr(jaccard_join, name)))
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == brute_components(corpus)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_group_resolution_keeps_connectivity():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, 34, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(12)]
        top = list(range(12))

        def find(k):
            while top[k] != k:
                k = top[k]
            return k

        for a in range(12):
            for b in range(a):
                if jaccard_join.linked(sets[a], sets[b]):
                    top[find(a)] = find(b)
        want = {frozenset(k for k in range(12) if find(k) == r) for r in map(find, range(12))}
        top = list(range(12))
        for a, b in jaccard_join.resolve(list(range(12)), sets):
            assert jaccard_join.linked(sets[a], sets[b])
            top[find(a)] = find(b)
        assert {frozenset(k for k in range(12) if find(k) == r) for r in map(find, range(12))} == want


@pytest.mark.parametrize("last", [0, 500_000])
def test_components_of_a_path(spark, monkeypatch, last):
    monkeypatch.setattr(components_, "LAST_LINKS", last)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got) == {*range(41), 100, 101, 103} and len({got[k] for k in range(41)}) == 1 and got[0] in range(41)
    assert len({got[k] for k in (100, 101, 103)}) == 1 and got[100] in (100, 101, 103)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding_laws(spark, edge, edge_rows):
    rows = sharding.assign(edge, 4).collect()
    assert len(rows) == len(edge_rows)
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    where = {}
    for r in rows:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_nothing_and_of_many(spark, empty):
    assert sharding.assign(empty).count() == 0
    rng = random.Random(8)
    rows = [(k, "w" * rng.randint(1, 400) + str(k)) for k in range(4000)] + [(k, None) for k in range(50)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").sum("size").collect()
    sums = [r["sum(size)"] for r in got]
    assert len(sums) == 16 and max(sums) < 1.02 * sum(sums) / 16


def test_minimax_is_smallest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes, shards = rng.integers(0, 20, rng.integers(1, 12)), int(rng.integers(1, 5))
        best = [[10**9] * (shards + 1) for _ in range(len(sizes) + 1)]
        best[0] = [0] * (shards + 1)
        for k in range(1, len(sizes) + 1):
            for s in range(1, shards + 1):
                best[k][s] = min(max(best[j][s - 1], int(sizes[j:k].sum())) for j in range(k + 1))
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        assert capacity == best[len(sizes)][shards] and len(cuts) == shards and cuts[-1] == len(sizes)


def labelled(n=400):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        w = prose(rng, rng.randint(20, 80)).split()
        toxic, junk = k % 5 == 0, k % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vilestuff", "vilething.", "Vilest,"])
        if junk:
            w = [x + rng.choice(["***", "%%%"]) for x in w]
        rows.append((k, " ".join(w), int(not junk), int(toxic)))
    return rows


def test_classifiers_learn_on_one_fold_and_hold_on_the_other(spark, edge, empty):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    toxic = toxicity_mil.train(docs, labels)
    out = toxicity_mil.score_texts(docs, toxic).collect()
    wrong = [r.doc_id for r in out if r.doc_id in held and r.predicted != rows[r.doc_id][3]]
    assert len(wrong) <= 0.05 * len(held)
    for r in out:
        if rows[r.doc_id][3] and r.predicted:
            raw = rows[r.doc_id][1].encode()
            assert b"vile" in raw[r.worst_start : r.worst_start + r.worst_bytes].lower()
    net = quality_cnn.train(docs, labels)
    out = quality_cnn.score_texts(docs, net).collect()
    wrong = [r.doc_id for r in out if r.doc_id in held and r.predicted != rows[r.doc_id][2]]
    assert len(wrong) <= 0.05 * len(held)
    for f, model in ((toxicity_mil.score_texts, toxic), (quality_cnn.score_texts, net)):
        got = f(edge, model).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
        assert f(empty, model).count() == 0
    assert toxicity_mil.keep_clean(edge, toxic).columns == edge.columns


def test_training_never_sees_the_held_out_fold(spark):
    from tablelog.llm.labelled import sample_ids

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(500)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    ids = [r.id for r in sample_ids(labels, "quality", 1000).collect()]
    assert sorted(ids) == [k for k in range(500) if zlib.crc32(str(k).encode()) % 5]
    few = sample_ids(labels, "quality", 20).collect()
    assert len(few) == 40 and few == sample_ids(labels.repartition(5), "quality", 20).collect()
    twice = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.id, r.y) for r in sample_ids(twice, "quality", 5).collect()} == {(1, 1), (2, 0)}


def test_models_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity_mil.score_texts(edge, toxicity_mil.train(edge, none)).collect()} == {0.0}
    assert {r.score for r in quality_cnn.score_texts(edge, quality_cnn.train(edge, none)).collect()} == {1.0}


def random_network(seed=3):
    rng = np.random.default_rng(seed)
    q = quality_cnn
    return q.Network(rng.normal(size=(q.SYMBOLS, q.CHANNELS)), rng.normal(size=(q.WIDTH, q.CHANNELS, q.FILTERS)) / 4, rng.normal(size=q.FILTERS), rng.normal(size=2 * q.FILTERS) / 9, 0.1)


def plain_score(net, text):
    """The network's score of one text, window by window."""
    q = quality_cnn
    raw = list((text or "").encode())
    data = np.array(raw + [q.PADDING] * (q.WIDTH + 1))
    n = max(1, len(raw))
    windows = np.stack([sum(net.embed[data[p + k]] @ net.kernel[k] for k in range(q.WIDTH)) for p in range(n)])
    chunks = [(0, min(n, q.CHUNK))]
    while chunks[-1][1] < n:
        a = chunks[-1][0] + q.STRIDE
        chunks.append((a, min(n, a + q.CHUNK)))
    pooled = np.stack([np.maximum(windows[a:b].max(0) + net.shift, 0) for a, b in chunks])
    return 1 / (1 + np.exp(-(np.concatenate([pooled.max(0), pooled.mean(0)]) @ net.head + net.bias)))


def test_network_against_a_plain_version_and_alone():
    net, rng = random_network(), random.Random(12)
    texts = ["xxxxxxxxx", "xxxxxxxxx", None, "", "a", "é" * 200, "a" * 1000 + "Q" + "b" * 1000, prose(rng, 40), prose(rng, 400), "y" * 256, "y" * 257, "xxxxxxxxx"]
    got = net.score(pa.array(texts))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
    for k, t in enumerate(texts):  # a neighbour changes nothing
        assert np.isclose(net.score(pa.array([t], pa.string()))[0], got[k], rtol=1e-5)
    assert quality_cnn.STRIDE < quality_cnn.CHUNK and len(set(np.round(got[[0, 1, 11]], 6))) == 1


def test_gradients_against_differences():
    net, rng = random_network(5), random.Random(13)
    column, y = pa.array([prose(rng, n) for n in (3, 20, 90)]), np.array([1.0, 0.0, 1.0])
    weight = np.array([1.0, 2.0, 0.5])

    def loss(n):
        p = np.array([plain_score(n, t) for t in column.to_pylist()])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    found = quality_cnn.gradients(net, column, y, weight)
    pick = np.random.default_rng(1)
    for name in ("kernel", "shift", "head", "embed"):
        v = getattr(net, name)
        for _ in range(8):
            at = tuple(int(pick.integers(0, n)) for n in v.shape) if name != "embed" else (ord(pick.choice(list("aeht"))), int(pick.integers(0, 8)))
            old, e = v[at], 1e-6
            v[at] = old + e
            up = loss(net)
            v[at] = old - e
            down = loss(net)
            v[at] = old
            assert np.isclose((up - down) / (2 * e), found[name][at], atol=2e-4), name


def test_length_alone_is_never_toxic():
    s = toxicity_mil.split(pa.array(["A neutral sentence. " * 2000, "One."]))
    model = toxicity_mil.Model(np.zeros((1 << toxicity_mil.BITS) + 1, np.float32), 0.02)
    assert len(s.text) == 2001 and np.allclose(model.score(s)[0], 1 - np.exp(-0.02))


def test_score_is_the_noisy_or_of_the_docstring():
    rng = np.random.default_rng(6)
    weights = np.append(np.maximum(rng.normal(0, 1, 1 << toxicity_mil.BITS), 0) * (rng.random(1 << toxicity_mil.BITS) < 0.1), 0).astype(np.float32)
    model = toxicity_mil.Model(weights, 0.03)
    texts = [prose(random.Random(k), n) for k, n in enumerate((1, 5, 30, 200))] + ["", None, "a\nb. c! d"]
    got, each = model.score(toxicity_mil.split(pa.array(texts)))
    q = 1 / (1 + np.exp(4.0))
    for k, t in enumerate(texts):
        alone = toxicity_mil.split(pa.array([t], pa.string()))
        stays = np.exp(-0.03)
        for j in range(len(alone.text)):
            slots = alone.features[alone.sentence == j].ravel()
            p = 1 / (1 + np.exp(4.0 - weights[slots[slots >= 0]].astype(float).sum()))
            stays *= (1 - p) / (1 - q)
        assert np.isclose(got[k], 1 - stays, atol=1e-5)


def test_toxicity_fit_lowers_the_loss_of_its_law():
    rows = labelled(300)
    texts, y = [r[1] for r in rows], np.array([r[3] for r in rows], float)

    def loss(model):
        p = np.clip(model.score(toxicity_mil.split(pa.array(texts)))[0], 1e-9, 1 - 1e-9)
        return -(np.where(y == 1, np.log(p) * 0.5 / y.sum(), np.log1p(-p) * 0.5 / (1 - y).sum())).sum()

    steps = [loss(toxicity_mil.fit(texts, y, steps=n)) for n in (0, 5, 50, 300)]
    assert steps == sorted(steps, reverse=True) and steps[-1] < 0.2 * steps[0]


def test_shards_beside_a_large_group_are_even():
    rng = random.Random(4)
    for where in (0, 1, 1000, 2503, 3999):
        sizes = np.array([rng.randrange(40, 60) for _ in range(4000)])
        sizes[where] = 100_000  # a third of all
        cuts = sharding.even_cuts(sizes, 16)
        runs = [int(sizes[a:b].sum()) for a, b in zip([0, *cuts], cuts)]
        assert sum(runs) == sizes.sum() and max(runs) == sharding.minimax_cuts(sizes, 16)[0]
        others = sorted(runs)[:-1]
        assert others[-1] <= 1.25 * 200_000 / 15 and (others[0] >= 0.75 * 200_000 / 15 or where == 1)
    for _ in range(300):  # never over the smallest capacity, all in order
        n, shards = rng.randrange(0, 30), rng.randrange(1, 9)
        sizes = np.array([rng.choice([0, 1, 5, 9, 60, 200]) for _ in range(n)], np.int64)
        cuts = sharding.even_cuts(sizes, shards)
        assert len(cuts) == shards and cuts == sorted(cuts) and cuts[-1] == n
        assert max(int(sizes[a:b].sum()) for a, b in zip([0, *cuts], cuts)) <= sharding.minimax_cuts(sizes, shards)[0]
