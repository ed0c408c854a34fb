"""Quality rules: countable signs of a text, and logistic regression on hashed word and character n-grams.

Two classifiers of the same features are trained on labelled rows: low quality and toxic. Features: words, pairs of words and
beginnings of words that a text has, hashed; and the share that each hashed character trigram (of UTF-8 bytes) has. All
features count: each is scaled by how clearly it tells the classes apart in the training rows, and regression with an L2
penalty does the rest. Margins are turned into probabilities on rows kept out of training.

Counting features, training and calibration are tasks of executors, which read the training rows' features a few at a time;
the driver handles neither texts nor features nor weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C
from keyflow.llm.substring_dedup import window_hashes

WORD_BITS, PAIR_BITS, START_BITS, CHAR_BITS = 20, 20, 20, 16
#: Beginnings of words of these lengths, in UTF-8 bytes, are features.
STARTS = (4, 5, 6, 7)
_PAIRS = 1 << WORD_BITS
_STARTS = _PAIRS + (1 << PAIR_BITS)
_CHARS = _STARTS + (1 << START_BITS)
SIZE = _CHARS + (1 << CHAR_BITS)
#: Labelled rows that classifiers are trained on, at most: those whose ids have the least hashes.
TRAIN_ROWS = 6000
#: A text is rejected if it is of low quality, or toxic, with at least these probabilities.
LOW_QUALITY, TOXIC = 0.5, 0.5
_CHAR_SCALE = 30.0
_L2 = 2e-5
_ODD = 0x8CB92BA72F3D8DD7
_PORTION = 1 << 20
#: Training rows that are read at a time, and features of them that a training task keeps for its next pass.
_CHUNK, _HELD_FEATURES = 256, 16_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Classifier:
    """The weights of the features that training rows have, and the line that turns a margin into log odds."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def dense(self) -> np.ndarray:
        w = np.zeros(SIZE, np.float32)
        w[self.places] = self.weights
        return w


class Portion:
    """Some texts with what is counted in them, worked out together."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        split = [t.split() for t in texts]
        self.n_words = np.array([len(x) for x in split], np.int64)
        self.texts, self.split = texts, split
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self.chars = np.frombuffer(b"".join(texts), np.uint8)
        self.n_bytes = np.array([len(t) for t in texts], np.int64)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        end = np.cumsum(self.n_bytes)
        return total[end] - total[end - self.n_bytes]

    def _within(self, length: int) -> np.ndarray:
        """The words where a window of that length begins that doesn't leave its text."""
        n = len(self.doc) - length + 1
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def signs(self) -> dict[str, np.ndarray]:
        letters = self._sum(~_SPACE[self.chars] & ((self.chars & 0xC0) != 0x80))
        symbols = self._sum(_SYMBOL[self.chars])
        copies = []
        for t in self.texts:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            copies.append(len(lines) - len(set(lines)))
        flat = C.word_hashes([w for x in self.split for w in x])
        at = self._within(3)
        h = window_hashes(flat, 3, _ODD)[at] ^ C.mix(self.doc[at].astype(np.uint64), 1) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        s = C.runs(h[order])
        size = np.diff(np.append(s, len(h)))
        again = at[order][np.repeat(size > 1, size)]
        steps = np.zeros(len(flat) + 1, np.int64)
        np.add.at(steps, again, 1)
        np.add.at(steps, again + 3, -1)
        repeat = np.bincount(self.doc, np.cumsum(steps)[:-1] > 0, self.n).astype(np.int64)
        return {"n_words": self.n_words, "word_chars": letters, "n_symbols": symbols, "n_dup_lines": np.array(copies, np.int64), "n_repeat_words": repeat}

    def present(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of each distinct hashed word, pair of words and beginning of a word of a text."""
        index: dict[bytes, int] = {}
        number = np.array([index.setdefault(w, len(index)) for x in self.split for w in b" ".join(x).lower().split()], np.int64)
        n = max(1, len(index))
        hashes = C.word_hashes(list(index))
        at = self._within(2)
        pair = (C.mix(window_hashes(hashes[number], 2, _ODD)[at], 12) >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + _PAIRS if len(at) else at
        own = C.distinct(self.doc * n + number)  # each text's distinct words
        doc, number = own // n, own % n
        word = (C.mix(hashes, 11) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        keys = [doc * SIZE + word[number], self.doc[at] * SIZE + pair]
        lens = np.fromiter(map(len, index), np.int64, len(index))
        chars = np.frombuffer(b"".join(index) + bytes(8), np.uint8).astype(np.uint64)
        begin, head = np.cumsum(lens) - lens, np.zeros(len(index), np.uint64)
        for i in range(STARTS[-1]):
            head |= chars[begin + i] << np.uint64(8 * i)
            if i + 1 in STARTS:
                place = (C.mix(head, 20 + i) >> np.uint64(64 - START_BITS)).astype(np.int64) + _STARTS
                long = lens[number] > i
                keys.append(doc[long] * SIZE + place[number[long]])
        key = C.distinct(np.concatenate(keys))
        return key // SIZE, key % SIZE

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of each character trigram of each text."""
        c = self.chars.astype(np.uint32)
        doc = np.repeat(np.arange(self.n), self.n_bytes)
        if len(c) < 3:
            return doc[:0], doc[:0]
        code = (c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        inside = doc[:-2] == doc[2:]
        return doc[:-2][inside], (code[inside] >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + _CHARS

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the places of its features, ascending, and their values."""
        doc, place = self.present()
        gram_doc, gram = self.trigrams()
        key = np.sort(gram_doc * SIZE + gram)
        first = C.runs(key)
        key, count = key[first], np.diff(np.append(first, len(key)))
        share = count * _CHAR_SCALE / np.maximum(np.bincount(gram_doc, minlength=self.n), 1)[key // SIZE]
        a, b = np.searchsorted(doc, np.arange(self.n + 1)), np.searchsorted(key // SIZE, np.arange(self.n + 1))
        return [(np.concatenate([place[a[i] : a[i + 1]], key[b[i] : b[i + 1]] % SIZE]), np.concatenate([np.ones(a[i + 1] - a[i]), share[b[i] : b[i + 1]]])) for i in range(self.n)]

    def probabilities(self, models: list[tuple[Classifier, np.ndarray]]) -> list[np.ndarray]:
        doc, place = self.present()
        gram_doc, gram = self.trigrams()
        grams = np.maximum(np.bincount(gram_doc, minlength=self.n), 1)
        out = []
        for model, dense in models:
            z = model.bias + np.bincount(doc, dense[place], self.n) + np.bincount(gram_doc, dense[gram], self.n) * _CHAR_SCALE / grams
            out.append(1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -500, 500))))
        return out


def _minimise(f, x: np.ndarray, steps: int = 80) -> np.ndarray:
    """L-BFGS with backtracking for a smooth convex f that gives value and gradient."""
    value, g = f(x)
    s_all: list = []
    for _ in range(steps):
        d = g.copy()
        alphas = []
        for s, y, r in reversed(s_all):
            a = r * (s @ d)
            alphas.append(a)
            d -= a * y
        if s_all:
            s, y, r = s_all[-1]
            d *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(s_all, reversed(alphas), strict=True):
            d += s * (a - r * (y @ d))
        slope, t = -(g @ d), 1.0 if s_all else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = x - t * d
            v, h = f(new)
            if v <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - x, h - g
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        if (sy := s @ y) > 1e-12:
            s_all = [*s_all[-7:], (s, y, 1 / sy)]
        x, value, g = new, v, h
        if done:
            break
    return x


class TrainingRows:
    """Labelled rows' features, read as often as needed, a few rows at a time; read() gives rows of (places, values, low, toxic, kept out of training)."""

    def __init__(self, read: Callable[[], Iterable[tuple]]):
        self.read = read

    def chunks(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(place, value, row within, low, toxic, kept out) of some rows."""
        held: list[tuple] = []
        for row in self.read():
            held.append(row)
            if len(held) == _CHUNK:
                yield self._joined(held)
                held = []
        if held:
            yield self._joined(held)

    @staticmethod
    def _joined(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        place, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
        return place, value, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), *(np.array([r[i] for r in rows], bool) for i in (2, 3, 4))


def clearness(rows: TrainingRows, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of the rows that are trained on, how clearly each tells the classes apart, and both classes' numbers of rows.

    Words, pairs and beginnings: the root of the likelihood ratio of having it; trigrams: the means' distance in standard
    errors. Both are near 1 for what chance gives.
    """
    has, sums, n = np.zeros((2, SIZE), np.int32), np.zeros((2, 2, SIZE - _CHARS)), np.zeros(2, np.int64)
    for place, value, row, *label, out in rows.chunks():
        for k in (0, 1):
            own = (label[which] == bool(k)) & ~out
            n[k] += own.sum()
            at = own[row]
            has[k] += np.bincount(place[at], minlength=SIZE).astype(np.int32)
            at &= place >= _CHARS
            for power in (1, 2):
                sums[k, power - 1] += np.bincount(place[at] - _CHARS, value[at].astype(np.float64) ** power, SIZE - _CHARS)
    names = np.flatnonzero(has.sum(axis=0))
    has, m = has[:, names], np.maximum(n, 1)
    both = np.maximum(has.sum(axis=0), 1)
    ratio = sum(2 * h * np.log(np.maximum(h, 1) / (both * p)) for h, p in zip(has, m / m.sum(), strict=True))
    clear = np.sqrt(np.maximum(ratio, 0))
    mean = sums[:, 0] / m[:, None]
    error = ((sums[:, 1] / m[:, None] - mean**2).clip(0) / m[:, None]).sum(axis=0) + 1e-12
    chars = names >= _CHARS
    clear[chars] = (np.abs(mean[0] - mean[1]) / np.sqrt(error))[names[chars] - _CHARS]
    return names, clear, n


def train(rows: TrainingRows, which: int) -> Classifier:
    """A classifier of label ``which`` (0: low quality, 1: toxic). Rows kept out of training turn margins into probabilities.

    Where one class is missing it gives the share of the other (smoothed) for every text, and has no features.
    """
    names, clear, n = clearness(rows, which)
    if not n.all():
        return Classifier(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    scale = (clear / np.sort(clear)[-20:].mean()).astype(np.float32)
    number = np.full(SIZE, len(names), np.int32)
    number[names] = np.arange(len(names), dtype=np.int32)
    scale, size, total = np.append(scale, np.float32(0)), len(names), int(n.sum())  # the last place is for what training rows don't have

    held: list[tuple] = []
    room = [_HELD_FEATURES]

    def scaled_chunks() -> Iterator[tuple]:
        """The chunks with scaled values: the first ones are held, up to a bound, and the others read again."""
        yield from list(held)
        if held and room[0] > 0:
            return
        known = len(held)
        for i, (place, value, row, *label, out) in enumerate(rows.chunks()):
            if i >= known:
                at = number[place]
                chunk = at, value * scale[at], row.astype(np.int32), label[which], out
                room[0] -= len(at)
                if room[0] > 0:
                    held.append(chunk)
                yield chunk

    def passes(x: np.ndarray) -> Iterator[tuple]:
        for at, scaled, row, wrong, out in scaled_chunks():
            yield at, scaled, row, np.bincount(row, scaled * x[:size].take(at, mode="clip"), len(out)) + x[size], wrong, out

    def loss(x: np.ndarray):
        value, g = _L2 / 2 * float(x[:size] @ x[:size]), np.append(_L2 * x[:size], 0.0)
        for at, scaled, row, z, wrong, out in passes(x):
            w = np.where(out, 0.0, 1 / total)
            r = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - wrong)
            value += float(w @ np.logaddexp(0, np.where(wrong, -z, z)))
            g[:size] += np.bincount(at, scaled * r[row], size + 1)[:size]
            g[size] += r.sum()
        return value, g

    x = _minimise(loss, np.zeros(size + 1))
    z, y = (np.concatenate(c) for c in zip(*[(z[out], wrong[out]) for *_, z, wrong, out in passes(x)], strict=True))
    slope, offset = _calibrated(z, y.astype(np.float64)) if 0 < y.sum() < len(y) else (1.0, 0.0)
    return Classifier(names, (x[:size] * scale[:size]).astype(np.float32), float(x[size]), slope, offset)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The line that turns margins into log odds."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def line(ab: np.ndarray):
        m = ab[0] * z + ab[1]
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        return float(np.sum(np.logaddexp(0, m) - target * m)), np.array([np.sum((p - target) * z), np.sum(p - target)])

    slope, offset = _minimise(line, np.array([1.0, 0.0]))
    return float(slope), float(offset)


def _portions(batch: pa.RecordBatch, column: int):
    held, begin, size = [], 0, 0
    texts = C.bodies(batch.column(column))
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size > _PORTION or i + 1 == len(texts):
            yield begin, Portion(held)
            held, begin, size = [], i + 1, 0


_MODEL = "which int, places binary, weights binary, bias double, slope double, offset double"


def _stored_rows(folder: str) -> Iterator[tuple]:
    """The training rows in a folder, in the order of its files."""
    import pyarrow.parquet as pq
    from pyarrow import fs as filesystems

    fs, at = C.filesystem(folder)
    for info in sorted(fs.get_file_info(filesystems.FileSelector(at)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(_CHUNK):
                    quality, toxic, out, places, values = (batch.column(c).to_pylist() for c in ("quality", "toxic", "out", "places", "values"))
                    for q, t, o, p, v in zip(quality, toxic, out, places, values, strict=True):
                        yield np.frombuffer(p, np.int32), np.frombuffer(v, np.float32), q == 0, t == 1, o


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> str:
    """The folder of classifiers of low quality and of toxic texts, trained on at most ``rows`` labelled rows (by the hash of their id).

    labels: id, quality (0: low), toxic (1: toxic); rows with a null are left out; of repeated ids the worst label holds.
    One row in four is kept out of training.
    """
    spark = docs.sparkSession
    sample = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = sample.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = sample.withColumn("out", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(4)) == 3)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))

    def features(batches):
        for batch in batches:
            for i, portion in _portions(batch, 3):
                found = portion.features()
                cut = batch.slice(i, portion.n)
                yield pa.RecordBatch.from_arrays([
                    cut.column(0), cut.column(1), cut.column(2),
                    pa.array([p.astype(np.int32).tobytes() for p, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ], ["quality", "toxic", "out", "places", "values"])

    at, models = C.new_folder(spark, "features"), C.new_folder(spark, "classifiers")
    labelled = texts.join(F.broadcast(sample), "id").select("quality", "toxic", "out", "body")  # the sample's size is bounded
    labelled.mapInArrow(features, "quality int, toxic int, out boolean, places binary, values binary").write.parquet(at)

    def learn(batches):
        C.hold(None)  # no memo beside what training holds
        for batch in batches:
            for which in batch.column(0).to_pylist():
                m = train(TrainingRows(lambda: _stored_rows(at)), which)
                C.trim()
                yield pa.RecordBatch.from_pydict({
                    "which": pa.array([which], pa.int32()), "places": [m.places.astype(np.int32).tobytes()], "weights": [m.weights.astype(np.float32).tobytes()],
                    "bias": [m.bias], "slope": [m.slope], "offset": [m.offset],
                })

    spark.range(2, numPartitions=1).select(F.col("id").cast("int").alias("which")).mapInArrow(learn, _MODEL).write.parquet(models)
    return models


def classifiers(folder: str) -> list[Classifier]:
    """The classifiers in a folder: low quality, toxic."""
    import pyarrow.dataset as ds

    fs, at = C.filesystem(folder)
    rows = sorted(ds.dataset(at, filesystem=fs, format="parquet").to_table().to_pylist(), key=lambda r: r["which"])
    return [Classifier(np.frombuffer(r["places"], np.int32), np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["offset"]) for r in rows]


SIGNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_low, p_toxic, kept.

    Null text: no words (base_failed). Null and repeated ids, and ids without labels, keep their rows. No labels: the
    classifiers say that half of all texts are wrong, and p_low and p_toxic don't reject. A column called ``quality`` is
    replaced. No rows: no rows. Labels with a null are left out; of an id's labels the worst holds; labels without a text
    aren't used.
    """
    docs = docs.drop("quality")
    folder = fit(docs, labels, id_col, text_col, rows)
    schema = docs.schema
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    ready: list = []

    def judge(batches):
        if not ready:
            ready.extend((m, m.dense()) for m in classifiers(folder))
        for batch in batches:
            for i, portion in _portions(batch, 1):
                signs = portion.signs()
                failed = (signs["n_words"] < 50) | (100 * signs["n_repeat_words"] > 50 * signs["n_words"])
                low, toxic = portion.probabilities(ready)
                sure = [len(m.places) > 0 for m, _ in ready]
                kept = ~failed & ~((low >= LOW_QUALITY) & sure[0]) & ~((toxic >= TOXIC) & sure[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, portion.n), *(pa.array(signs[s], pa.int64()) for s in SIGNS), pa.array(failed), pa.array(low), pa.array(toxic), pa.array(kept)],
                    ["row", *SIGNS, "base_failed", "p_low", "p_toxic", "kept"],
                )
        C.trim()

    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    fields = [StructField("row", schema), *(StructField(s, LongType()) for s in SIGNS), StructField("base_failed", BooleanType()), StructField("p_low", DoubleType()), StructField("p_toxic", DoubleType()), StructField("kept", BooleanType())]
    judged = out.mapInArrow(judge, StructType(fields))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.struct(*SIGNS, "base_failed", "p_low", "p_toxic", "kept").alias("quality"))
