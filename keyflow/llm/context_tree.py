"""LM scoring by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) with a space after each but the last, and an end byte. Each byte is eight binary
decisions; each decision, told apart by the bits before it, has a tree over the last ``depth`` bytes, whose nodes hold
Krichevsky-Trofimov counts. A node's weighted probability is half its own estimate's and half its children's product;
from these come the weights by which the estimates of all depths are mixed, and so a code length for each byte.

Training counts contexts of full depth; a bucket of them holds whole subtrees below the last ``TOP`` bytes. What lies
above is summed over the buckets: a table whose size is bounded by 256 ** (TOP - 1) contexts times 255 decisions.

A common pair of bytes has a large share of all contexts. Contexts that weren't counted in training don't change a tree's
weights, so the questions of different blocks to one bucket are independent: those to a large bucket are dealt to several
tasks, each with the bucket's counts. A task holds distinct contexts, and one block's questions beside them.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C

#: Bytes of context unless ``fit`` is told otherwise (2 to 7: a context and its byte are a 64-bit number).
DEPTH = 5
TOP = 2
#: Text whose questions to one bucket are answered by one task.
PART_BYTES = 64 << 20
_LN2 = math.log(2)
#: Distinct keys that a training task holds before it sends them on.
_HELD = 3_000_000
_PORTION = 2 << 20
_END_WORD = int(C.xxhash.xxh3_64_intdigest(b"\n"))
_SENT = "kind int, bucket int, part int, block int, keys binary, counts binary"


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def gram_keys(docs: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each document: its context, newest byte first, and itself, as a number; and the documents' lengths."""
    pad = b"\n" * depth
    joined = [b" ".join(w) for w in docs]
    buffer = np.frombuffer(b"".join(pad + x + b"\n" for x in joined), np.uint8).astype(np.uint64)
    lens = np.array([len(x) + 1 for x in joined], np.int64)
    inside = np.ones(len(buffer), bool)
    begin = np.cumsum(lens + depth) - lens - depth
    for d in range(depth):
        inside[begin + d] = False
    n, key = len(buffer), buffer[depth:].copy()
    for d in range(1, depth + 1):
        key |= buffer[depth - d : n - d] << np.uint64(8 * (depth + 1 - d))
    return key[inside[depth:]], lens


def _gram_bucket(keys: np.ndarray, n: int, depth: int) -> np.ndarray:
    top = keys >> np.uint64(8 * (depth + 1 - TOP))
    return (C.mix(top, 3) % np.uint64(n)).astype(np.int64)


def _word_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (C.mix(keys, 5) % np.uint64(n)).astype(np.int64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
        s = C.runs(keys)
        return keys[s], np.diff(np.append(s, len(keys)))
    return C.summed(keys, counts)


def union(parts) -> np.ndarray:
    """The distinct numbers of several arrays, ascending; holds them and a portion of the rest."""
    held, size, most = [np.zeros(0, np.uint64)], 0, _HELD
    for x in parts:
        held.append(x)
        size += len(x)
        if size > most:
            held = [C.distinct(np.concatenate(held))]
            size = len(held[0])
            most = max(_HELD, 2 * size)
    return C.distinct(np.concatenate(held))


def added(parts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several (keys, counts), ascending, and the sums of their counts; holds them and a portion of the rest."""
    held, size, most = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))], 0, _HELD
    for keys, counts in parts:
        held.append((keys, counts.astype(np.uint64)))
        size += len(keys)
        if size > most:
            held = [C.summed(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            most = max(_HELD, 2 * size)
    return C.summed(*map(np.concatenate, zip(*held, strict=True)))


def _rows(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, parts: dict[int, int]) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint32)
    return [(kind, b, block % parts.get(b, 1) if kind else 0, block, C.pack(keys[i:j], True), C.pack(counts[i:j])) for b, i, j in C.slices(bucket[order])]


def _table(rows: list[tuple]) -> dict:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return {n: pa.array(c, t) for n, c, t in zip(("kind", "bucket", "part", "block", "keys", "counts"), columns, types, strict=True)}


_SMALL = 1 << 14


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x of at least 1/2: Stirling's series, eight steps up."""
    y = x + 8
    steps = x.copy()
    for i in range(1, 8):
        steps = steps * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


_HALVES, _WHOLES = _lgamma(np.arange(_SMALL) + 0.5) - _lgamma(np.array([0.5])), _lgamma(np.arange(_SMALL) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    if not len(a) or max(a.max(), b.max()) * 2 < _SMALL:
        return _HALVES[a] + _HALVES[b] - _WHOLES[a + b]
    half = _lgamma(np.array([0.5]))
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - 2 * half - _lgamma(a + b + 1.0)


class Tree:
    """The trees of a bucket's contexts: for each depth the distinct (context, byte), and for each bit their nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        self.keys = {depth: keys}
        self.up: dict[int, np.ndarray] = {}
        n = {depth: counts.astype(np.int64)}
        for d in range(depth - 1, TOP - 2, -1):
            below = self.keys[d + 1]
            short = (below >> np.uint64(16)) << np.uint64(8) | (below & np.uint64(255))
            self.keys[d], self.up[d + 1] = np.unique(short, return_inverse=True)
            n[d] = np.bincount(self.up[d + 1], n[d + 1], len(self.keys[d])).astype(np.int64)
        self.n = n

    def bit(self, j: int) -> dict[int, tuple]:
        """By depth: the node of each (context, byte), zeros, ones, log KT, log weighted and the first (context, byte) of each node."""
        out: dict[int, tuple] = {}
        for d in range(self.depth, TOP - 2, -1):
            keys = self.keys[d]
            s = C.runs(keys >> np.uint64(8 - j))
            node = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(keys))))
            one = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64)
            all_, ones = np.add.reduceat(self.n[d], s), np.add.reduceat(self.n[d] * one, s)
            kt = log_kt(all_ - ones, ones)
            if d == self.depth:
                children = weighted = kt
            else:
                below, first = out[d + 1], out[d + 1][5]
                children = np.bincount(node[self.up[d + 1][first]], below[4], len(s))
                weighted = np.logaddexp(kt, children) - _LN2
            out[d] = (node, all_ - ones, ones, kt, weighted, s, children)
        return out

    def sums(self) -> list[tuple[np.ndarray, ...]]:
        """For each bit: the nodes above the buckets' contexts, their zeros, ones, and their children's log weighted here."""
        out = []
        for j in range(8):
            _, zeros, ones, _, _, s, children = self.bit(j)[TOP - 1]
            out.append((_node(self.keys[TOP - 1][s], j), zeros, ones, children))
        return out

    def code(self, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of each (context, byte)'s probability; top: nodes, ascending, with what they add and leave to those below."""
        total = np.zeros(len(self.keys[self.depth]))
        for j in range(8):
            by = self.bit(j)
            one = (self.keys[self.depth] >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            at = np.arange(len(one))
            p = None
            for d in range(self.depth, TOP - 1, -1):
                node, zeros, ones, kt, weighted, *_ = by[d]
                x = node[at]
                own = ((ones + 0.5) / (zeros + ones + 1))[x]
                p = own if p is None else (w := np.exp(kt - _LN2 - weighted)[x]) * own + (1 - w) * p
                at = self.up[d][at]
            i = np.minimum(np.searchsorted(top[0], _node(self.keys[TOP - 1][at], j)), len(top[0]) - 1) if len(top[0]) else None
            if i is not None:
                known = top[0][i] == _node(self.keys[TOP - 1][at], j)
                p = np.where(known, top[1][i] + top[2][i] * p, p)
            total += np.log10(np.where(one, p, 1 - p))
        return total


def _node(keys: np.ndarray, j: int) -> np.ndarray:
    """A decision's number in a context: the context, and a one before the bits so far."""
    return ((keys >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << j) | (keys & np.uint64(255)) >> np.uint64(8 - j)).astype(np.int64)


def top_table(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each decision in a context of TOP - 1 bytes: what depths up to it add to the chance of a one, and leave to those below."""
    order = np.argsort(node)
    node, zeros, ones, children = node[order], zeros[order], ones[order], children[order]
    levels = []
    at_node, ids = np.arange(len(node)), node
    for _ in range(TOP - 1, -1, -1):
        kt = log_kt(zeros, ones)
        weighted = np.logaddexp(kt, children) - _LN2
        levels.append((at_node, np.exp(kt - _LN2 - weighted), (ones + 0.5) / (zeros + ones + 1)))
        short = (ids >> 16) << 8 | ids & 255
        ids, up = np.unique(short, return_inverse=True)
        zeros, ones = np.bincount(up, zeros, len(ids)).astype(np.int64), np.bincount(up, ones, len(ids)).astype(np.int64)
        children = np.bincount(up, weighted, len(ids))
        at_node = up[at_node]
    add, leave = np.zeros(len(node)), np.ones(len(node))
    for at, w, own in levels:  # from the deepest to depth 0: p = w own + (1 - w) (add + leave p)
        add, leave = w[at] * own[at] + (1 - w[at]) * add, (1 - w[at]) * leave
    return node, add, leave


class Model:
    """A trained model: buckets of counts in the shared folder, the table above them, and the words' totals."""

    def __init__(self, counts: DataFrame, top: tuple, n_buckets: int, tokens: int, vocabulary: int, depth: int):
        self.counts, self.top, self.n_buckets, self.tokens, self.vocabulary, self.depth = counts, top, n_buckets, tokens, vocabulary, depth

    def dealt(self, size: int, part_bytes: int) -> DataFrame:
        """counts with ``parts``: the tasks that answer a bucket, by its share of ``size`` bytes of text."""
        contexts = self.counts.filter("kind = 1").agg(F.sum("distinct")).first()[0] or 1
        parts = F.greatest(F.lit(1), F.ceil(F.col("distinct") * (size / contexts / part_bytes)))
        return self.counts.withColumn("parts", F.when(F.col("kind") == 1, parts).otherwise(1).cast("int"))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> Model:
    """Counts words and contexts of ``depth`` bytes (2 to 7) of all rows that aren't held out."""
    if not TOP <= depth <= 7:
        raise ValueError(f"depth must be from {TOP} to 7, not {depth}")
    n = C.groups(C.text_bytes(docs, text_col), C.BUCKET_BYTES)

    def count(batches):
        held: dict[int, list] = {0: [], 1: []}

        def add(kind: int, keys: np.ndarray) -> int:
            held[kind].append(counted(keys))
            return sum(len(k) for k, _ in held[kind])

        def merged(kind: int):
            return counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))

        def send():
            for kind in (0, 1):
                if held[kind]:
                    keys, counts = merged(kind)
                    held[kind] = []
                    bucket = _gram_bucket(keys, n, depth) if kind else _word_bucket(keys, n)
                    yield pa.RecordBatch.from_pydict(_table(_rows(kind, 0, keys, counts, bucket, {})))

        for texts in _train_portions(batches):
            add(0, np.concatenate([C.hashed_words(texts, lower=True)[0], np.full(len(texts), _END_WORD, np.uint64)]))
            if add(1, gram_keys([words_of(x) for x in texts], depth)[0]) > 2 * _HELD:
                for kind in (0, 1):
                    held[kind] = [merged(kind)]
                if len(held[1][0][0]) > _HELD:
                    yield from send()
        yield from send()

    def gather(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        sent = zip(table.column("keys"), table.column("counts"), strict=True)
        keys, counts = added((C.unpack(k.as_py(), np.uint64, True), C.unpack(c.as_py(), np.uint32)) for k, c in sent)
        tops: list = [[], [], [], []]
        if kind:
            for c, parts in zip(tops, zip(*Tree(keys, counts, depth).sums(), strict=True), strict=True):
                c.extend(np.concatenate(parts).tolist())
        top = pa.array([[{"node": a, "zeros": b, "ones": c, "children": d} for a, b, c, d in zip(*tops, strict=True)]], _TOP)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "tokens": pa.array([int(counts.sum())], pa.int64()), "distinct": pa.array([len(keys)], pa.int64()), "keys": [C.pack(keys, True)], "counts": [C.pack(counts)], "top": top})

    sent = _columns(docs, id_col, text_col).mapInArrow(count, _SENT)
    ddl = "kind int, bucket int, tokens long, distinct long, keys binary, counts binary, top array<struct<node: long, zeros: long, ones: long, children: double>>"
    model = C.settle(sent.groupBy("kind", "bucket").applyInArrow(gather, ddl), "context-tree")
    words = model.filter("kind = 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    sums = model.filter("kind = 1").select(F.explode("top").alias("t")).groupBy("t.node").agg(F.sum("t.zeros").alias("zeros"), F.sum("t.ones").alias("ones"), F.sum("t.children").alias("children"))
    found = list(zip(*sums.collect(), strict=True)) or [(), (), (), ()]  # bounded, whatever the corpus
    top = top_table(*(np.array(c, t) for c, t in zip(found, (np.int64, np.int64, np.int64, np.float64), strict=True)))
    return Model(model.select("kind", "bucket", "distinct", "keys", "counts"), top, n, words[0] or 0, words[1] or 0, depth)


_TOP = pa.list_(pa.struct([("node", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64()), ("children", pa.float64())]))


def _train_portions(batches):
    held, size = [], 0
    for batch in batches:
        out = held_out(batch.column(0).to_pylist())
        for skip, body in zip(out, batch.column(1).to_pylist(), strict=True):
            if not skip:
                held.append(body)
                size += len(body)
                if size > _PORTION:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and where among them each number is."""
    order = np.argsort(x)
    s = C.runs(x[order])
    at = np.empty(len(x), np.int32)
    at[order] = np.repeat(np.arange(len(s), dtype=np.int32), np.diff(np.append(s, len(x))))
    return x[order[s]], at


class _Asked:
    """A block's distinct words and contexts; places: and where each of its own is among them."""

    def __init__(self, table: pa.Table, places: bool, depth: int):
        self.depth = depth
        C.trim()
        self.ids = table.column("id").to_pylist()
        texts = table.column("body").to_pylist()
        words, self.n_words = C.hashed_words(texts, lower=True)
        words = np.append(words, np.uint64(_END_WORD))
        self.words, self.word_at = _places(words) if places else (C.distinct(words), None)
        del words
        grams, self.lens = gram_keys([words_of(x) for x in texts], depth)
        del texts
        self.grams, self.gram_at = _places(grams) if places else (counted(grams)[0], None)

    def parts(self, n: int):
        return (0, self.words, _word_bucket(self.words, n)), (1, self.grams, _gram_bucket(self.grams, n, self.depth))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words, A-Z lower-cased, and an end. base_score: sum of log10((c + 1) / (N + V + 1)), c being a token's
    training count, N all and V the distinct training tokens. score: the model's log10 probability of the words joined by
    spaces and an end byte. Null and empty texts: the end alone. A null id counts as the text '' for the fold; null and
    repeated ids keep their rows. Without training rows every bit has probability 1/2. No rows: no rows.
    """
    n, top, tokens, vocabulary, depth = model.n_buckets, model.top, model.tokens, model.vocabulary, model.depth
    size = C.text_bytes(docs, text_col)
    blocks = _columns(docs, id_col, text_col)
    blocks = blocks.withColumn("block", C.block_of(F.col("id"), C.groups(size, C.BLOCK_BYTES)))
    dealt = model.dealt(size, part_bytes)
    large = {r.bucket: r.parts for r in dealt.filter("parts > 1").select("bucket", "parts").collect()}  # 256 ** TOP at most

    def ask(table: pa.Table) -> pa.Table:
        block, asked = table.column("block")[0].as_py(), _Asked(table, False, depth)
        return pa.table(_table([r for kind, keys, bucket in asked.parts(n) for r in _rows(kind, block, keys, np.zeros(len(keys)), bucket, large)]))

    def answer(key, known: pa.Table, asked: pa.Table) -> pa.Table:
        C.trim()
        kind, bucket, part = (k.as_py() for k in key)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if known.num_rows:
            keys, counts = C.unpack(known.column("keys")[0].as_py(), np.uint64, True), C.unpack(known.column("counts")[0].as_py(), np.uint64)
        wanted = lambda: (C.unpack(x.as_py(), np.uint64, True) for x in asked.column("keys"))
        all_keys = C.distinct(np.concatenate([keys, union(wanted())]))
        all_counts = np.zeros(len(all_keys), np.uint64)
        all_counts[np.searchsorted(all_keys, keys)] = counts
        if not asked.num_rows:
            value = np.zeros(0)
        elif kind:
            value = Tree(all_keys, all_counts, depth).code(top)
        else:
            value = all_counts.astype(np.float64)
        # a word's count exactly; a byte's log10 probability in single precision
        form = np.float32 if kind else np.int64
        answers = (value[np.searchsorted(all_keys, w)].astype(form) for w in wanted())
        return pa.table(_table([(kind, bucket, part, b, b"", C.pack(a)) for b, a in zip(asked.column("block").to_pylist(), answers, strict=True)]))

    def finish(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _SCORED})
        asked = _Asked(table, True, depth)
        found = {(k, b): x for k, b, x in zip(*[replies.column(c).to_pylist() for c in ("kind", "bucket", "counts")], strict=True)}
        got = []
        for kind, keys, bucket in asked.parts(n):
            order = np.argsort(bucket, kind="stable")
            parts = [C.unpack(found[kind, b], np.float32 if kind else np.int64) for b in np.unique(bucket)]
            value = np.zeros(len(keys), np.float64 if kind else np.int64)
            value[order] = np.concatenate(parts)
            got.append(value)
        counts, codes = got
        end = np.searchsorted(asked.words, np.uint64(_END_WORD))
        per = np.append(counts[asked.word_at[:-1]], 0)  # the appended one keeps reduceat within bounds
        starts = np.cumsum(asked.n_words) - asked.n_words
        total = lambda x: np.where(asked.n_words > 0, np.add.reduceat(x, starts), 0)
        n_tokens = asked.n_words + 1
        known = total((per > 0).astype(np.int64)) + int(counts[end] > 0)
        base = total(np.log10(per + 1.0)) + np.log10(counts[end] + 1.0) - n_tokens * math.log10(tokens + vocabulary + 1)
        logp = np.add.reduceat(codes[asked.gram_at], np.cumsum(asked.lens) - asked.lens)
        columns = (asked.ids, held_out(asked.ids), n_tokens, known, np.full(len(known), tokens), base, logp, -logp * math.log2(10) / asked.lens)
        return pa.table({k: pa.array(c, t) for c, (k, t) in zip(columns, _SCORED, strict=True)})

    asked = blocks.groupBy("block").applyInArrow(ask, _SENT)
    known = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("kind", "bucket", "part", "keys", "counts")
    place = ("kind", "bucket", "part")
    replies = known.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(answer, _SENT)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, ddl)


_SCORED = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()))
