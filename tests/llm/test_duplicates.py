"""Components, near-duplicates of texts and of embeddings against brute force over all pairs."""

import random

import numpy as np
import pytest

from vellumspark.llm import components, embedding_duplicates, near_duplicates, registry


def union(n_keys, pairs):
    up = {k: k for k in n_keys}

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in n_keys}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame([*pairs, (None, 3)], "u long, v long")).collect()}
    want = union({x for p in pairs for x in p}, pairs)
    assert all(got.get(k, k) == c for k, c in want.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 10)
    monkeypatch.setattr(components, "HOT_SHARE", 10**9)
    rng = random.Random(14)
    hubs = rng.sample(range(3000), 12)
    pairs = [(h, x) for h in hubs for x in rng.sample(range(3000), 60)] + [(3000 + i, 3001 + i) for i in range(25)] + [(5, 6)] * 30
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == union({x for p in pairs for x in p if p[0] != p[1]}, pairs)


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    s = {k: sets(t) for k, t in texts.items()}
    by = {}
    for k, x in s.items():
        for g in x:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    return {k: len(x) for k, x in s.items()}, union(texts, links)


def compare(out, texts):
    n, comp = brute(texts)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for k in texts:
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (n[k], comp[k], comp[k] == k), k


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    compare(registry.op8_near_duplicates(spark, "/root/testdata/sf0.01"), {r.doc_id: r.text for r in docs.collect()})


def test_near_duplicates_of_hard_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(200)]
    texts, k = {}, 0
    for rate in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06):
        for _ in range(25):
            texts[k] = " ".join(word() if rng.random() < rate else w for w in base)
            k += 1
    chain = [word() for _ in range(300)]
    for i in range(12):  # each links with the next, few with those after it
        texts[k] = "\n".join(chain[i * 8 : i * 8 + 120])
        k += 1
    for t in (None, "", " \t\n", "one", "One", "a b c d", "a b c d", "a b c d e", "x " * 5000, "X  " * 7000, "ü " * 6, "  x"):
        texts[k] = t
        k += 1
    frame = spark.createDataFrame([(a, b, "c") for a, b in texts.items()], "doc_id long, text string, rep string")
    old, near_duplicates.BLOCK = near_duplicates.BLOCK, 16
    try:
        compare(near_duplicates.near_duplicate_groups(frame), texts)
    finally:
        near_duplicates.BLOCK = old
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (9, "q r s t u v"), (9, "q r s t u v")], "doc_id long, text string")
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicate_groups(odd).collect()], key=str)
    assert got == [(2, 2, True), (2, 2, True), (9, 2, False), (9, 2, False), (None, None, True)]
    assert near_duplicates.near_duplicate_groups(frame.limit(0)).count() == 0


def test_links_with_distant_signatures(spark):
    texts = {}
    for k, seed in enumerate((2570, 5943, 20231)):  # 30 of 40 shingles shared, signatures more than RADIUS places apart
        rng = random.Random(seed)
        w = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(39)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join([*w[:12], "changed", *w[13:]])
    out = near_duplicates.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: k - k % 2 for k in texts}


def check_vectors(out, rows):
    ids = [i for i, _ in rows]
    good = np.array([v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows])
    width = max(len(v or []) for _, v in rows)
    x = np.array([[*v, *[0.0] * (width - len(v))] if g else [1.0] * width for (_, v), g in zip(rows, good, strict=True)], dtype=np.float64)
    c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    link = (c >= 0.95) & good & good[:, None]
    np.fill_diagonal(link, False)
    comp = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    got = {r.vec_id: r for r in out.collect()}
    for i, k in enumerate(ids):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (link[i].sum(), comp[k], comp[k] == k), k


@pytest.mark.parametrize("block", [2048, 50])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_duplicates, "BLOCK", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    hot = rng.normal(size=64)
    rows += [(10_000 + i, (hot + rng.normal(size=64) * 0.18).tolist()) for i in range(120)] + [(20_000 + i, hot.tolist()) for i in range(60)]
    rows += [(30_000, None), (30_001, [0.0] * 64), (30_002, [float("nan")] * 64), (30_003, [None] + [1.0] * 63), (30_004, [float("inf")] + [1.0] * 63), (30_005, []), (30_006, hot[:3].tolist()), (30_007, hot[:3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    check_vectors(embedding_duplicates.link_vectors(frame), rows)
    assert embedding_duplicates.link_vectors(frame.limit(0)).count() == 0
    only_bad = frame.where("vec_id in (30000, 30001)")
    assert [(r.n_links, r.kept) for r in embedding_duplicates.link_vectors(only_bad).collect()] == [(0, True)] * 2


def test_embeddings_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 5), (4, v, 6), (4, v, 7), (9, [1.0, 2.0, 3.1], 8), (8, [-1.0, 0.0, 0.0], 9), (None, [-2.0, 0.0, 0.0], 9), (3, [float(2**60), 2.0**61, 3.0 * 2**60], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates.link_vectors(frame).collect()], key=str)
    assert got == [(3, 4, 3, True), (4, 4, 3, False), (4, 4, 3, False), (8, 1, 8, True), (9, 4, 3, False), (None, 1, None, True), (None, 4, None, True)]


def test_one_of_two_linked_vectors_probes_the_other_s_list():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.07
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = np.linalg.norm(x - y, axis=1) <= np.sqrt(0.1)
    index = embedding_duplicates.Index(x[:1000], 60, float(np.sqrt(0.1)))
    (a, *_, probes_x), (b, *_, probes_y) = index.assign(x), index.assign(y)
    apart = 0
    for i in np.flatnonzero(near):
        assert b[i] in probes_x[i] or a[i] in probes_y[i]
        assert (b[i] in probes_x[i]) == (a[i] == b[i] or index.probed(x[i : i + 1], a[i : i + 1], b[i : i + 1])[0])
        apart += a[i] != b[i]
    assert apart > 100
