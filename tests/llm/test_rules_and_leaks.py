"""Quality rules against plain counting and held-out labels; leaks against full alignment; the pipeline against its parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from keyflow.llm import decontamination, packing, quality
from keyflow.llm.common import table

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", "a b c", "x\n\n x\nx\n y # | <é> &$%*\n y", "the cat sat on the cat sat on the mat " * 3, "\t\n ", "ünï wörd " * 40, "w " * 60, " ".join(f"w{i}" for i in range(20_000)),
    "line one\nline one\r\nline one\n", "a\x0bb\x0cc　d",
]


def _signs(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(rb"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(covered))


def test_signs(spark):
    docs = spark.createDataFrame([(i if i else None, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs, labels)
    assert out.columns == ["doc_id", "text", "quality"]
    got = {r.text: r.quality for r in out.collect()}
    assert len(got) == len(TEXTS)
    for t in TEXTS:
        n, *_, repeats = want = _signs(t)
        q = got[t]
        assert tuple(q[s] for s in quality.SIGNS) == want
        assert q.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert q.kept == (not q.base_failed)  # no usable labels: the signs decide
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def _best(item, text):
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        for j in range(1, len(new)):
            new[j] = min(new[j], new[j - 1] + 1)
        row = new
    return int(row.min())


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.2])
def test_leaks_are_those_of_full_alignment(rate):
    rng = random.Random(1)
    words = [rng.choice(["the", "of", "and", "tion", "er"]) + rng.choice("abcdefg") * rng.randint(0, 2) for _ in range(400)]
    items = [(k, " ".join(words[20 * k : 20 * k + rng.choice([1, 3, 9, 16])])) for k in range(12)]
    indexes = decontamination._indexes([(k, decontamination.points(t), int(len(t) * rate)) for k, t in items])
    for _ in range(60):
        k, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.randint(0, int(len(t) * rate) + 2)):
            p = rng.randrange(len(s)) if s else 0
            s[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        text = " ".join(rng.sample(words, 12)) + " " + "".join(s) + " " + " ".join(rng.sample(words, 5))
        got = {h["item_id"]: h for h in decontamination.leaks_in(text, indexes)}
        x = decontamination.points(text)
        for key, t2 in items:
            best = _best(decontamination.points(t2), x)
            assert (key in got) == (best <= int(len(t2) * rate)), (t2, text)
            if key in got:
                assert got[key]["edits"] == best and _best(decontamination.points(t2), x[got[key]["start"] : got[key]["end"]]) == best


def test_find_leaks(spark):
    item = "What is the Capital of France, and why is it not a harbour town at all?"
    docs = spark.createDataFrame([(1, "so: what is  the capital\nof france, and why is it not an harbour town at all? yes", 0), (2, None, 0), (3, "", 0), (None, item, 0), (4, "clean " * 5000, 0), (1, item, 1)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "q")], "item_id long, text string")
    for block in (decontamination.BLOCK_CHARS, 10):
        out = decontamination.find_leaks(docs, bench, block_chars=block)
        got = sorted(((r.doc_id, [(h.item_id, h.edits) for h in r.leaks if h.item_id != 10]) for r in out.collect()), key=repr)
        assert got == sorted([(1, [(7, 1)]), (2, []), (3, []), (None, [(7, 0)]), (4, []), (1, [(7, 0)])], key=repr)
    assert out.columns == ["doc_id", "text", "leaks"]
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).filter("size(leaks) > 0").count() == 0


def test_pipeline_stage_by_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, "/root/testdata/sf0.001").collect(), docs.schema)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "substring_dedup":
            assert set(after) == set(before)
            seen = {}
            for key in sorted(after):
                w = before[key].encode().split()
                gone = set()
                for i in range(len(w) - 12):
                    if seen.setdefault(tuple(w[i : i + 13]), key) < key:
                        gone |= set(range(i, i + 13))
                assert after[key].encode().split() == [x for i, x in enumerate(w) if i not in gone]
        else:
            assert all(after[k] == before[k] for k in after)
        if name == "decontamination":
            items = [decontamination.normal(r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
            for k, t in before.items():
                if any(i in decontamination.normal(t) for i in items):
                    assert k not in after
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = packing.pack_documents(kept, corpus_pipeline.tokenizer_path(), 1).collect()
    assert sorted(map(repr, pieces)) == sorted(map(repr, want)) and {p.doc_id for p in pieces} == set(after)
