"""Sharding, token counts, URL filter, packing and secrets against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from vellumspark.llm import packing, registry, secrets, sharding, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", None, None, None), (4, "same text", "en", "b", 9), (4, "same text", "en", "b", 9),
    (5, "x" * 5000 + " tail. " + "word " * 9000, "en", "a", 1), (6, "tab\tand nbsp\u00a0and 😀 ümlaut <|endoftext|> <s>it's</s> ▁x", "de", "a", 3), (7, "\n\n  \n", "en", "a", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_shards_hold_counts_mixture_and_slots(spark, odd):
    rows = [(i, f"t{i % 40}", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), per_bucket=100).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    assert max(out["shard"].value_counts()) - min(out["shard"].value_counts()) <= 1 and set(out["shard"]) == set(range(16))
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        for source, n in out.source.value_counts().items():
            assert abs((part.source == source).sum() - n / 16) <= 2
    assert all(out["size"] == [len(f"t{i % 40}") + 1 for i in out.doc_id])
    again = sharding.shard_documents(odd.withColumnRenamed("lang", "Bucket")).toPandas()
    assert sorted(again["size"])[:2] == [1, 1] and len(again) == len(ODD)
    assert set(again.text_crc32) == {zlib.crc32((t or "").encode()) for _, t, *_ in ODD}
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_token_counts_are_the_library_s(spark, odd, docs, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = registry.op3_token_counts(spark, sf).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert out.loc[i, "n_tokens"] == len(sp.encode(t)) and out.loc[i, "n_bytes"] == len(t.encode())
    got = token_counts.with_token_counts(odd, path).toPandas()
    assert sorted(got.n_tokens) == sorted(len(sp.encode(t or "")) for _, t, *_ in ODD)
    assert token_counts.with_token_counts(odd.limit(0), path).count() == 0


def test_overlapping_chunks_give_the_same_count():
    sp, proven = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert proven
    rng = random.Random(3)
    alphabet = ["the ", "word", "  ", "\n", "é", "😀", "▁", ".", "longer ", "ss", " a", "\t"]
    for k in range(60):
        text = "".join(rng.choices(alphabet, k=rng.randint(50, 900)))
        if k % 5 == 0:
            text = text.replace(" ", "")  # no boundary anywhere
        if k % 7 == 0:
            text = text[:100] + "q" * 300 + text[100:]
        for chunk, overlap in ((40, 8), (64, 16), (100, 30)):
            assert token_counts.count_tokens(sp, proven, text, chunk, overlap) == len(sp.encode(text)), (k, chunk)


def test_urls(spark):
    urls = [
        "http://a.example.com/en/x?y", "https://WWW.Example.COM/en/", "x://b.net/es/1", "http://net/fr/", "http://foo.net/de/", None, "no scheme", "://?x", "http://com",
        "http://notcom/", "http://a.example.com/en", "http://xexample.com/en/1", "a://b://c.net/es/", "http://" + "a." * 5000 + "net/fr/" + "y" * 9000, "http://u.net/fr/#z", "http://u.net/fr",
    ]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(3, urls[3], "k")], "page_id long, url string, rule_host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, registry.URL_RULES)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = host.translate(lower)
        fits = [(len(r), r, v) for v, r in registry.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, registry.URL_RULES)).count() == 0


def check_pieces(out, texts, tokenizer, length=4096):
    by_doc = defaultdict(list)
    for r in out.to_dict("records"):
        by_doc[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        at = 0
        for p in parts:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == list(np.r_[0, np.cumsum(s.length)[:-1]]) and s.length.sum() <= length


def test_packing_round_trip(spark, odd, docs, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = registry.op6_packing(spark, sf).toPandas()
    check_pieces(out, dict(zip(docs.doc_id, docs.text, strict=True)), tokenizer)
    assert out.length.sum() > 0.97 * 4096 * (out.sequence_id.nunique() - 1)
    texts = {i: t for i, t, *_ in ODD if i not in (None, 4)}
    got = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    check_pieces(got, texts, tokenizer)
    assert (got.doc_id == 4).sum() == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack_documents(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_words_give_the_ids_of_whole_texts():
    encoder, _ = packing.load(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(encoder, packing.WordEncoder)
    rng = random.Random(5)
    alphabet = ["The", "é", "e\u0301", "\u0301", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "it's", "'", "12", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ς", "😀", "\u200d", "ﬁ", "中文", "ก็", "-", ".", "?!", "I\u0307", "J\u030c", "Ab", "\u0345"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)]
    ids, sizes = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_that_are_forgotten_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    encoder = packing.WordEncoder(packing.load(public_tokenizers.path("word_bpe_49k.json"))[0].tokenizer)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeistn,.", k=rng.choice((0, 1, 1, 2, 5))))
    for _ in range(60):
        texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(5)]
        ids, sizes = encoder.encode(texts)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(encoder.index) == len(encoder.seen) < 50 + 150
    assert encoder.encode([])[1].tolist() == []


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(1)
    for _ in range(40):
        gaps = rng.integers(1, 9, rng.integers(1, 14))
        places = np.r_[0, np.cumsum(gaps)]
        penalty = np.r_[0, rng.integers(0, 6, len(gaps) - 1), 0] if len(gaps) > 1 else np.zeros(2, int)
        cost = lambda cuts: sum(12 - (places[b] - places[a]) + penalty[b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))  # noqa: B023, E731
        best = [0] + [None] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + 12 - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= 12)
        assert cost(packing.choose_cuts(places, penalty, 12)) == best[-1]


def base_spans(t):
    found = []
    for n, (kind, pattern) in enumerate({"assign": secrets.PATTERNS["assign"], "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.items()):
        for m in re.finditer(pattern, t):
            if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                found.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(spark, docs, sf):
    rng = random.Random(2)
    bits = ["password=", "Passwd : ", "token\" = '", "api_key:", "APIKEY=", "secret", "=", " ", "\n", "abcdef12", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJKL12", "😀", "é", "x", ".", "deadbeef"]
    texts = dict(zip(docs.doc_id, docs.text, strict=True)) | {10_000 + k: "".join(rng.choices(bits, k=rng.randint(0, 60))) for k in range(300)} | {20_000: None, 20_001: "", 20_002: "token=abcdefghi " * 3000}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secret_digest(frame).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = base_spans(t or "")
        n = Counter(k for k, *_ in want)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"]), i
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), i
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in secrets.BASE] == [s for s in text.split(",") if s], i


def test_weak_parts_need_each_other(spark):
    lone, key, end = "Zk3vQ9pLm2XwB7rT5nHd8s", "client_id=app77", "https://db.example.com/x"
    rows = [(1, f"see {lone} there"), (2, f"{key} and {lone}"), (3, f"{lone} at {end}"), (4, f"{lone}{' far' * 100}{end}"), (5, f"{key} only"), (5, f"{key} only")]
    got = [(r.doc_id, [s.kind for s in r.spans]) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, []), (2, ["ident", "candidate"]), (3, ["candidate", "endpoint"]), (4, []), (5, []), (5, [])]


def test_cuts_are_the_best_of_all_places():
    def cost(cuts, penalty, n, length):
        assert cuts[-1] == n and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
        return len(cuts) * length - n + sum(penalty[c] for c in cuts)

    rng = np.random.default_rng(5)
    for k in range(60):
        length = int(rng.choice([300, 1000, 4096]))
        n = int(rng.integers(1, 12 * length))
        docs = np.unique(np.r_[rng.integers(1, n + 1, rng.integers(0, 12)), n])
        sentences = np.unique(rng.integers(1, n + 1, rng.integers(0, n // [20, 200, 900][k % 3] + 1)))
        penalty = np.full(n + 1, packing.HARD_PENALTY)
        penalty[sentences] = packing.SENTENCE_PENALTY
        penalty[[0, *docs]] = 0
        want = packing.choose_cuts(np.arange(n + 1), penalty, length)
        assert cost(packing.best_cuts(n, docs, sentences, length), penalty, n, length) == cost(want, penalty, n, length)


def test_texts_without_sentence_ends_leave_little_padding():
    class Numbers:
        def encode(self, texts):
            sizes = np.array([int(t) for t in texts], np.int64)
            return np.full(sizes.sum(), 9, np.int32), sizes

    pieces = list(packing.pack_stream(iter([(list(range(60)), ["1399"] * 60)]), Numbers(), np.array([5], np.int32), 4096, 2, 0))
    windows = len(set(np.concatenate([p["sequence_id"] for p in pieces]).tolist()))
    assert windows == -(-60 * 1400 // 4096)


def test_packing_with_few_words_remembered(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = ["sequence_id", "offset"]
    many, few = (packing.pack_documents(docs, path, memo=m).toPandas().sort_values(order, ignore_index=True) for m in (None, 300))
    assert many.equals(few)
    encoder, _ = packing.load(path, 300)
    assert packing.load(path)[0].memo == packing.MEMO and encoder.memo == 300
    sizes = []
    for i in range(0, 4000, 100):
        ids, _ = encoder.encode([" ".join(f"w{k}q" for k in range(i, i + 100))])
        assert ids.tolist() == encoder.tokenizer.encode(" ".join(f"w{k}q" for k in range(i, i + 100)), add_special_tokens=False).ids
        sizes.append(len(encoder.index))
    assert max(sizes) <= 300 + 2 * 100 + 1
    assert corpus_pipeline.PACKING_MEMO < packing.MEMO
