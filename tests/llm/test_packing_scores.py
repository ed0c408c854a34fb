"""Search and routing of retrieval packing against BM25 over all rows, in plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from keyflow.llm import common, packing, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def bm25(docs, every):
    """For each seed the score of each row, by plain counting; docs: (id, text)."""
    words = [Counter((t or "").encode().lower().split()) for _, t in docs]
    df = Counter(w for c in words for w in c)
    lens = [sum(c.values()) for c in words]
    mean = sum(lens) / max(1, len(docs))
    idf = {w: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for key in sorted({k for k, _ in docs if k is not None and k % every == 0}):
        query = Counter(min((t or "").encode() for k, t in docs if k == key).lower().split())
        length = math.sqrt(sum(idf[w] ** 2 for w in query)) or 1.0
        out[key] = [sum(idf[w] / length * c[w] * (packing.K1 + 1) / (c[w] + packing.K1 * (1 - packing.B + packing.B * n / mean)) for w in query if w in c) for c, n in zip(words, lens, strict=True)]
    return out


@pytest.fixture
def many():
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 300)) for i in range(240)]
    docs += [(40, "w1 w2 rare"), (None, "w1 w5 rare rare"), (None, None), (80, ""), (7, docs[7][1]), (300, None), (301, "nobody has these"), (302, " ".join(f"w{i % 300}" for i in range(20_000)))]
    return docs


def test_search_is_exact_over_all_shards(spark, many, monkeypatch):
    monkeypatch.setattr(packing, "_DENSE", 20)  # both ways of multiplying
    want = bm25(many, 20)
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    found = defaultdict(list)
    for r in packing.search(df, 10, every=20).orderBy("seed", "rank").collect():
        found[r.seed].append((r.doc_id, r.score))
    for seed, scores in want.items():
        best = sorted((s for (k, _), s in zip(many, scores, strict=True) if k != seed and s > 0), reverse=True)[:10]
        assert np.allclose([s for _, s in found[seed]], best, rtol=1e-4)


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_documents_go_to_the_seed_that_finds_them_best(spark, many, monkeypatch, held):
    monkeypatch.setattr(packing, "HELD_BYTES", held)
    want = bm25(many, 20)
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in many], "doc_id long, text string, seed string, score int").repartition(3)
    rows = packing.route(df, BYTE, 1, every=20).collect()
    assert len(rows) == len(many)
    by_ids = defaultdict(list)
    enc = tokens.Encoder(BYTE)
    for r in rows:
        by_ids[r.id, bytes(r.ids)].append(r)
    for i, (k, t) in enumerate(many):
        (r, *_) = by_ids[k, b"".join(enc.raw([t or ""])) + np.array([1], enc.dtype).tobytes()]
        scores = {s: x[i] for s, x in want.items()}
        best = max(scores.values())
        if k is not None and k % 20 == 0:
            assert r.seed == k and r.score == math.inf
        elif best == 0:
            assert r.seed is None
        else:
            assert abs(scores[r.seed] - best) < 1e-4 and abs(r.score - best) < 1e-3


def test_windows_hold_a_seed_and_its_nearest(spark):
    """Two groups of texts whose numbers alternate end up in windows of their own."""
    docs = [(i, " ".join(f"{'ab'[i % 2]}{j}" for j in range(i % 5, 40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.pack_documents(df.filter("doc_id not in (0, 1)").unionByName(spark.createDataFrame([(100, docs[0][1]), (200, docs[1][1])], df.schema)), BYTE, 1, window=512).collect()
    groups = defaultdict(set)
    for p in pieces:
        groups[p.sequence_id].add(0 if p.doc_id == 100 else 1 if p.doc_id == 200 else p.doc_id % 2)
    assert sum(len(g) > 1 for g in groups.values()) <= 4


def test_fill():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(1, 50, int(rng.integers(0, 40))).tolist()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for d, start, n, s, offset in packing.fill(enumerate(counts), 64):
            by_doc[d].append((start, n))
            by_seq[s].append((offset, n))
        for d, c in enumerate(counts):
            assert sum(n for _, n in by_doc[d]) == c and [a for a, _ in by_doc[d]] == np.cumsum([0] + [n for _, n in by_doc[d]])[:-1].tolist()
        sizes = [sum(n for _, n in by_seq[s]) for s in sorted(by_seq)]
        assert all(x == 64 for x in sizes[: sum(counts) // 64]) and all(x & (x - 1) == 0 for x in sizes)
        assert all([o for o, _ in x] == np.cumsum([0] + [n for _, n in x])[:-1].tolist() for x in by_seq.values())


@pytest.mark.parametrize("docs", [[], [(3, "no seed here"), (None, "a b"), (3, "no seed here"), (5, None)], [(100, "same text")] * 30, [(i, "") for i in range(700)]])
def test_null_repeated_and_empty(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.pack_documents(df, BYTE, 1, window=16).collect()
    enc = tokens.Encoder(BYTE)
    want = Counter()
    for k, raw in zip([k for k, _ in docs], enc.raw([t or "" for _, t in docs]), strict=True):
        want[k] += len(raw) // enc.dtype.itemsize + 1
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert all(x <= 16 and x & (x - 1) == 0 for x in sizes.values())


def test_recall_on_documents(spark):
    """Of the nearest and the ten nearest, for the seeds among 1,000 documents, against plain BM25 over all."""
    docs = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = bm25(docs, 100)
    found = defaultdict(list)
    for r in packing.search(common.table(spark, "/root/testdata/sf0.01", "documents"), 10).orderBy("seed", "rank").collect():
        found[r.seed].append(r.doc_id)
    hits = {1: [], 10: []}
    for seed, scores in want.items():
        score = {k: s for (k, _), s in zip(docs, scores, strict=True) if k != seed}
        for n in hits:
            least = sorted(score.values(), reverse=True)[n - 1]
            hits[n] += [score[k] >= least - 1e-4 for k in found[seed][:n]] + [False] * (n - len(found[seed][:n]))
    assert np.mean(hits[1]) >= 0.99 and np.mean(hits[10]) >= 0.99
