"""Training in executors: rows, labels, calibration, and recall on labels kept from training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyflow.llm import quality
from keyflow.llm.common import table

SF = "/root/testdata/sf0.1"


def rows(made):
    return quality.TrainingRows(lambda: iter(made))


def test_bounds_of_the_training_sample():
    assert quality.TRAIN_ROWS == 6000 and quality.PAIR_BITS == 20


def test_recall_on_labels_kept_from_training(spark):
    """Trained on the labels of even ids, judged on the odd ones."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").distinct()
    models = quality.classifiers(quality.fit(docs, labels.filter("doc_id % 2 = 0")))
    held = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("text", "quality", "toxic").collect()
    ready = [(m, m.dense()) for m in models]
    parts = [quality.Portion([(r.text or "").encode() for r in held[i : i + 200]]).probabilities(ready) for i in range(0, len(held), 200)]
    for found, wrong, least, sure in ((0, [r.quality == 0 for r in held], 0.75, 0.92), (1, [r.toxic == 1 for r in held], 0.65, 0.95)):
        said, wrong = np.concatenate([p[found] for p in parts]) >= 0.5, np.array(wrong)
        recall, precision = said[wrong].mean(), wrong[said].mean()
        print(f"label {found}: recall {recall:.3f}, precision {precision:.3f}, of {wrong.sum()} in {len(wrong)}")
        assert recall > least and precision > sure


def test_calibration_is_a_probability():
    rng = np.random.default_rng(5)
    made = []
    for i in range(4000):
        p = np.sort(rng.choice(50, 8, replace=False)).astype(np.int32)
        made.append((p, np.ones(8, np.float32), bool(rng.random() < (0.9 if 3 in p else 0.2)), False, i % 4 == 3))
    m = quality.train(rows(made), 0)
    w = m.dense()
    p = np.array([1 / (1 + np.exp(-(m.slope * (m.bias + w[a].sum()) + m.offset))) for a, *_ in made])
    has = np.array([3 in a for a, *_ in made])
    assert abs(p[has].mean() - 0.9) < 0.06 and abs(p[~has].mean() - 0.2) < 0.06
    one_sided = quality.train(rows(made), 1)
    assert not len(one_sided.places) and one_sided.offset < -5
    nothing = quality.train(rows([]), 0)
    assert not len(nothing.places) and nothing.offset == 0


def test_clearness_is_that_of_plain_counting():
    rng = np.random.default_rng(6)
    made = [(np.unique(rng.integers(0, 30, 6)).astype(np.int32), None, bool(rng.random() < 0.4), False, i % 5 == 0) for i in range(700)]
    made = [(p, np.ones(len(p), np.float32), *r) for p, _, *r in made]
    names, clear, n = quality.clearness(rows(made), 0)
    used = [(set(p.tolist()), y) for p, _, y, _, out in made if not out]
    assert n.tolist() == [sum(not y for _, y in used), sum(y for _, y in used)] and names.tolist() == sorted(set().union(*(p for p, _ in used)))
    for f, c in zip(names.tolist(), clear, strict=True):
        has = [sum(f in p for p, y in used if y == k) for k in (False, True)]
        g = sum(2 * h * np.log(h / (sum(has) * m / n.sum())) for h, m in zip(has, n, strict=True) if h)
        assert abs(c - np.sqrt(max(g, 0))) < 1e-6


def test_words_begin_with_features():
    portion = quality.Portion([b"abcdefg ab", b"abcd xyz", "ééé".encode()])
    doc, place = portion.present()
    starts = [set(place[(doc == d) & (place >= quality._STARTS)].tolist()) for d in range(3)]
    assert [len(s) for s in starts] == [4, 1, 3] and len(starts[0] & starts[1]) == 1 and not starts[2] & starts[0]


@pytest.mark.parametrize("case", ["repeated", "null", "empty", "one class", "no text"])
def test_odd_labels(spark, case):
    """Labels that can't be used change nothing; of repeated ones the worst holds."""
    text = lambda i: " ".join(f"{'bad' if i % 2 else 'good'}{j % 7} w{j * 13 + i % 3}" for j in range(60))
    docs = spark.createDataFrame([(i, text(i)) for i in range(80)] + [(3, text(3))], "doc_id long, text string")
    plain = [(i, int(i % 2 == 0), 0) for i in range(80)]
    more = {"repeated": plain + [(i, 1, 0) for i in range(80)], "null": plain + [(None, 0, 0), (4, None, 0), (6, 0, None)], "empty": [], "one class": [(i, 1, 0) for i in range(80)], "no text": [(i + 1000, 0, 1) for i in range(9)]}
    labels = spark.createDataFrame(more[case], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs, labels)
    kept = {r.doc_id: r.kept for r in out.select("doc_id", F.col("quality.kept").alias("kept")).collect()}
    assert out.count() == 81
    assert all(kept[i] == (i % 2 == 0 if case in ("repeated", "null") else True) for i in range(80))
