"""Toxicity, decontamination, line dedup and the pipeline against plain versions of their rules."""

import random
from collections import Counter

import numpy as np
import pytest
import zlib

import corpus_pipeline
from vellumspark.llm import decontamination, line_dedup, registry, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(n)]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    bad = ["vilest", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(rng, rng.randint(20, 200)), i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, None), (None, "", "en", "a", 0), (5001, "#" * 3000, "en", "a", 0), (5002, "you " * 20_000, "en", "a", 0)]
    labels += [(None, 1, 1), (3, None, None), (3, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "Score")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs.select("doc_id", "text"), x).collect()) for x in (labels, turned))
    assert a == b


def test_isotonic_curve_rises():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    x, y = toxicity.isotonic(m, (m + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= -1e-12).all()


def multiset(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, b in items:
            v = (b or "").lower().split()
            if not v or not w or (len(v) < 5 and v != w):
                continue
            a = multiset(v)
            if not set(a) & set(multiset(w)):
                continue
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                c = multiset(w[s : s + len(v)])
                both = sum((a & c).values())
                best = max(best, both / (sum(a.values()) + sum(c.values()) - both))
            if best >= 0.75:
                out[d, i] = round(best, 6)
    return out


def test_leaks_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in registry.op7_decontamination(spark, SF).collect()}
    assert got == brute_leaks(docs, items)


def test_leaks_of_changed_and_odd_items(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([12, 30, 30, 60, 5, 3])] + [(90, None), (91, ""), (92, "same same same same same same same")]
    docs = []
    for k in range(40):
        i, t = items[k % 4]
        v = t.split()
        if k % 3 == 1:
            v[rng.randrange(len(v))] = "changed"
        if k % 3 == 2:
            v.insert(len(v) // 2, "more")
        docs.append((k, " ".join(words(rng, rng.randint(0, 80)) + v + words(rng, rng.randint(0, 80)))))
    docs += [(100, None), (101, ""), (102, items[5][1].upper()), (103, "x " + items[5][1]), (104, items[4][1]), (105, "same " * 500), (106, " ".join(words(rng, 20_000)) + " " + items[1][1])]
    frame = spark.createDataFrame([(a, b, "c", a) for a, b in docs] + [(104, items[4][1], "c", 1)], "doc_id long, text string, m string, start long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(frame, bench).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and all(got[k] <= want[k] for k in got)
    assert sum(got[k] == want[k] for k in got) > 0.9 * len(got)
    left = {r.doc_id for r in decontamination.drop_leaks(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.find_leaks(frame.limit(0), bench).count() == 0 and decontamination.find_leaks(frame, bench.limit(0)).count() == 0


def brute_removed(docs, n=50):
    """Words that stand in a run of n words which stands earlier as well."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            g = hash(tuple(w[i : i + n]))
            if g in first:
                gone[i : i + n] = True
            else:
                first[g] = (d, i)
        out[d] = gone
    return out


def test_passages_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_removed(docs)
    got = {r.doc_id: r for r in registry.op9_line_dedup(spark, SF).collect()}
    assert len(got) == len(docs)
    texts = dict(docs)
    missed = sum(abs(int(want[d].sum()) - got[d].removed_words) for d in texts)
    assert missed <= 0.01 * sum(int(g.sum()) for g in want.values()), missed
    for d, t in docs:
        assert got[d].n_words == len(t.split()) and len(got[d].text.split()) == got[d].n_words - got[d].removed_words
        if not want[d].any():
            assert got[d].text == t


def test_planted_passages(spark):
    rng = random.Random(9)
    passage, other = words(rng, 55), words(rng, 49)
    docs = []
    for k in range(120):
        w = words(rng, rng.randint(30, 90))
        at = rng.randrange(len(w))
        docs.append((k, "\n".join([" ".join(w[:at]), " ".join(w[at:])]) if k % 4 == 0 else " ".join(w[:at] + (passage if k % 4 < 3 else other) + w[at:])))
    docs += [(500, None), (501, ""), (502, "to " * 3000), (503, docs[1][1]), (504, " \n "), (None, " ".join(words(rng, 60)))]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs] + [(*docs[1], "x", 1)], "doc_id long, text string, pos string, N_words int").select("doc_id", "text", "pos", "N_words")
    old, line_dedup.BLOCK = line_dedup.BLOCK, 16
    try:
        got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    finally:
        line_dedup.BLOCK = old
    own = " ".join(passage[5:50])
    assert [k for k in range(120) if own in got[k].text] == [1]
    for k, t in docs[:120]:
        if k in (0, 1) or k % 4 in (0, 3):
            assert got[k].text == t
        else:
            assert got[k].removed_words >= 55
    assert got[500].text is None and got[501].text == "" and got[503].text == "" and got[504].text == " \n " and got[None].removed_words == 0
    assert got[502].removed_words > 2900
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] and counts[-1] > 0.6 * counts[0] and counts == sorted(counts, reverse=True)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not brute_leaks([(r.doc_id, r.text) for r in docs.collect()], items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed.doc_id.nunique() == docs.count()


def test_every_passage_of_50_words_shares_a_fingerprint():
    rng = random.Random(12)
    for n in (50, 51, 55):
        for _ in range(150):
            passage = words(rng, n)
            texts = [" ".join(words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 40))).encode() for _ in range(2)]
            at, h, _ = line_dedup.fingerprints(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            assert set(h[at == 0]) & set(h[at == 1])


def test_passages_of_later_partners_go(spark):
    rng = random.Random(13)
    parts = [words(rng, 30) for _ in range(6)]
    docs = [(k, " ".join(words(rng, 20) + p + words(rng, 20))) for k, p in enumerate(parts)]  # each part alone first
    for k in range(10, 40):  # then two in a row, and some in one document twice
        a, b = rng.choice([(0, 1), (2, 3), (4, 5), (1, 2)])
        docs.append((k, " ".join(words(rng, rng.randint(0, 30)) + parts[a] + parts[b] + words(rng, rng.randint(0, 30)) + (parts[a] + parts[b]) * (k % 5 == 0))))
    near = words(rng, 300)
    for k in range(40, 60):  # copies that share some of their changes
        docs.append((k, " ".join(w + "x" * (i % 60 == 7 * (k % 3)) + "y" * (i == 40 + k % 4) for i, w in enumerate(near))))
    docs += [(70, "to " * 300 + "be " * 80), (71, "be " * 70 + "to " * 90), (72, "a b c " * 100)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (d, t), gone in zip(docs, (brute_removed(docs)[d] for d, _ in docs), strict=True):
        assert got[d].text.split() == [w for w, g in zip(t.split(), gone, strict=True) if not g], d


def test_all_passages_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_removed(docs)
    assert {r.doc_id: r.removed_words for r in registry.op9_line_dedup(spark, SF).collect()} == {d: int(g.sum()) for d, g in want.items()}


def test_leaks_with_distant_fingerprints(spark):
    docs, items = [], []
    for seed in (120, 136, 194):  # 30 of 35 shingles shared, fingerprints more than RADIUS bits apart
        rng = random.Random(seed)
        w = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(39)]
        items.append((seed, " ".join(w)))
        docs.append((seed, " ".join([*w[:12], "changed", *w[13:]])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(a, b).collect()} == {(s, s): 0.75 for s in (120, 136, 194)}


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(14)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = " ".join([*a[:30], "changed", *a[31:]])
    rows = [(1, " ".join(a)), (2, near), (2, " ".join(b)), (3, " ".join(c)), (3, " ".join(c)), (4, None), (4, None), (None, " ".join(b)), (5, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted([(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect()], key=str)
    assert got == sorted([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, None), (5, "")], key=str)


def test_leaks_at_windows_that_no_shingle_aligns(spark):
    rng = random.Random(21)
    w, v = words(rng, 64), words(rng, 60)
    again = "la " * 12
    items = [(0, " ".join(w)), (1, " ".join(v)), (2, "x y z " + again + " ".join(v[:9]))]
    pad = lambda: " ".join(words(rng, 70))
    docs = [
        (0, " ".join([pad(), *w[32:], *w[:32], pad()])),  # halves in the other order
        (1, " ".join([pad(), *v[40:], *v[20:40], *v[:20], pad()])),
        (2, " ".join([pad(), *w[8:], pad()])),  # a part that the best window holds with what stands before it
        (3, " ".join([*v[45:], *v[:45]])),  # shorter than one of the items, as long as the other
        (4, " ".join([pad(), again, again, *v[:9], "x y z", again, *v[:9], again, pad()])),
        (5, " ".join([*w[30:], pad(), *w[:30]])),
        (6, " ".join([*w[32:], *w[:20]])),
        (7, " ".join([*v[:20], *words(rng, 3), *v[20:]])),
    ]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert {k: x for k, (x, _) in got.items()} == want
    assert got[0, 0][1] == 70 and {(0, 0), (1, 1), (2, 0), (3, 1), (4, 2), (7, 1)} <= set(want)
