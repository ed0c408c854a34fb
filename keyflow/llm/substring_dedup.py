"""Substring dedup by level-wise doubling.

Windows of ``min_words`` consecutive words that also occur in a document with a smaller id are cut out. The lengths
double up to ``min_words``: windows of half that length (a minimizer for each full window, so that every repeated full
window has a repeated half) are counted first; only where a half is repeated is it extended to the full length; only
full windows that repeat are cut. With the default, the levels are 7 and 13 words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = 0xD6E8FEB86659FD93
_ODD2 = 0xA0761D6478BD642F
#: Bits of a half's hash that are compared; a chance match only lets a window on to the next level.
_HALF_BITS = 40
_SENT = "level int, block int, bucket int, keys binary, more binary, least binary"
_REPLY = "level int, block int, bucket int, bits binary"


def window_hashes(w: np.ndarray, length: int, odd: int) -> np.ndarray:
    """Hash of the window of that many words at each place where one fits; doubling, then joining two that overlap nowhere."""
    have, size, parts = w, 1, []
    rest = length
    power = lambda n: np.uint64(pow(odd, n, 2**64))
    while rest:
        if rest & 1:
            parts.append((have, size))
        rest >>= 1
        if rest:
            have = have[: len(have) - size] * power(size) + have[size:] if len(have) > size else have[:0]
            size *= 2
    out, at, n = None, 0, max(0, len(w) - length + 1)
    for have, size in reversed(parts):
        piece = have[at : at + n]
        out = piece if out is None else out * power(size) + piece
        at += size
    return out[:n]


class _Block:
    """A block's windows: place, document's index, hashes."""

    def __init__(self, table: pa.Table, min_words: int):
        C.hold(None)
        C.trim()
        self.half = -(-min_words // 2)
        ids = table.column("id")
        order = np.argsort(np.array(ids.fill_null(0)), kind="stable")
        self.order = order
        self.ids = np.array(ids.fill_null(0), np.int64)[order]
        known = ~np.array(ids.is_null())[order]
        flat, lens = C.hashed_words(list(np.array(C.bodies(table.column("body")) + [b""], object)[:-1][order]))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        doc = np.repeat(np.arange(len(lens)), lens)
        fits = np.arange(len(flat)) + min_words <= np.repeat(self.ends, lens)
        fits &= np.repeat(known, lens)
        self.at = np.flatnonzero(fits)
        self.doc = doc[self.at]
        self.flat = flat
        self.min_words = min_words

    def anchors(self) -> np.ndarray:
        """For each window the least hash of a half of it."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        h = C.mix(window_hashes(self.flat, self.half, _ODD))
        span, n = self.min_words - self.half + 1, len(h) - (self.min_words - self.half)
        least = h[:n].copy()
        for i in range(1, span):
            np.minimum(least, h[i : i + n], out=least)
        least = C.mix(least, 4)  # least hashes are small numbers: spread them over the buckets again
        return (least[self.at] >> np.uint64(64 - _HALF_BITS)) << np.uint64(64 - _HALF_BITS)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors, ascending; whether two documents here have it; the anchors of all windows."""
        a = self.anchors()
        order = np.argsort(a, kind="stable")
        s = C.runs(a[order])
        ends = np.append(s[1:], len(a))
        doc = self.doc[order]
        return a[order][s], doc[s] != doc[ends - 1] if len(s) else np.zeros(0, bool), a

    def full(self, alive: np.ndarray):
        """Of the windows whose anchor survives: the two hashes, places in order of the first hash, and the runs."""
        at, doc = self.at[alive], self.doc[alive]
        h = C.mix(window_hashes(self.flat, self.min_words, _ODD), 1)[at] if len(at) else np.zeros(0, np.uint64)
        h2 = (C.mix(window_hashes(self.flat, self.min_words, _ODD2), 2)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        h, h2, at, doc = h[order], h2[order], at[order], doc[order]
        return h, h2, at, self.ids[doc], C.runs(h, h2)


def _alive(block: _Block, reply: np.ndarray) -> np.ndarray:
    keys, _, a = block.halves()
    return reply[np.searchsorted(keys, a)] if len(a) else np.zeros(0, bool)


def _bits(table: pa.Table, level: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in table.select(["level", "bucket", "bits"]).to_pylist() if r["level"] == level}


def _joined(bits: dict[int, bytes], ranges: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(ranges[-1][2] if ranges else 0, bool)
    for b, i, j in ranges:
        out[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i)
    return out


def substring_dedup(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text`` without the repeated windows, and a struct ``dedup`` (n_words, n_removed).

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Every word covered by a window of ``min_words`` words
    whose word sequence also occurs in a row with a smaller id is cut; kept stretches keep their own white space and are
    joined by one space; a text without cuts stays as it is. Null text: no words, stays null. Null id: the row takes no
    part and stays whole. Rows with the same id don't cut each other. Texts shorter than a window stay whole. An input
    column called ``dedup`` is replaced.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = docs.drop("dedup")
    names = docs.columns
    total = C.text_bytes(docs, text_col)
    n_blocks, n_buckets = C.groups(total, C.BLOCK_BYTES), C.groups(total, C.BUCKET_BYTES)
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"),
    ).withColumn("block", C.block_of(F.col("id"), n_blocks))

    def rows(level, block, ranges, keys, more, least):
        made = [(level, block, b, C.pack(keys[i:j], True), C.pack(more[i:j]), C.pack(least[i:j])) for b, i, j in ranges]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*made, strict=True)) or [()] * len(types)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("level", "block", "bucket", "keys", "more", "least"), columns, types, strict=True)})

    def send_halves(table: pa.Table) -> pa.Table:
        block = _Block(table, min_words)
        keys, multi, _ = block.halves()
        short = keys >> np.uint64(64 - _HALF_BITS)
        return rows(1, table.column("block")[0].as_py(), C.ranges(keys, n_buckets), short, multi.view(np.uint8), np.zeros(len(keys), np.uint8))

    def send_full(key, table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows(2, 0, [], *[np.zeros(0, np.uint64)] * 3)
        block = _Block(table, min_words)
        keys, _, _ = block.halves()
        alive = _alive(block, _joined(_bits(reply, 1), C.ranges(keys, n_buckets)))
        h, h2, _, ids, s = block.full(alive)
        return rows(2, table.column("block")[0].as_py(), C.ranges(h[s], n_buckets), h[s], h2[s], ids[s])

    def answer(table: pa.Table) -> pa.Table:
        """Level 1: has another document this half? Level 2: has a document with a smaller id this window?"""
        level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = [C.unpack(x, np.uint64, True) for x in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        kind, least = (np.uint8, np.uint8) if level == 1 else (np.uint32, np.int64)
        k = np.concatenate(keys)
        del keys
        m = np.concatenate([C.unpack(x, kind) for x in table.column("more").to_pylist()])
        d = np.concatenate([C.unpack(x, least) for x in table.column("least").to_pylist()])
        if level == 1:
            order = np.argsort(k, kind="stable")
            s = C.runs(k[order])
            size = np.diff(np.append(s, len(k)))
            yes = np.repeat((size > 1) | (np.maximum.reduceat(m[order], s) > 0), size)
        else:
            order = np.lexsort((d, m, k))
            s = C.runs(k[order], m[order])
            yes = np.repeat(d[order][s], np.diff(np.append(s, len(k)))) < d[order]
        flag = np.zeros(len(k), bool)
        flag[order] = yes
        parts = np.split(flag, np.cumsum(sizes)[:-1])
        return pa.table({
            "level": pa.array([level] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int32()),
            "bucket": pa.array([bucket] * len(blocks), pa.int32()), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        })

    row_type = base.schema["row"].dataType

    def cut(key, table: pa.Table, reply: pa.Table) -> pa.Table:
        block = _Block(table, min_words) if table.num_rows else None
        texts, n_words, n_removed = [], [], []
        if block:
            keys, _, _ = block.halves()
            alive = _alive(block, _joined(_bits(reply, 1), C.ranges(keys, n_buckets)))
            h, h2, at, ids, s = block.full(alive)
            less = _joined(_bits(reply, 2), C.ranges(h[s], n_buckets))
            size = np.diff(np.append(s, len(h)))
            gone = np.repeat(less, size) | (ids > np.repeat(ids[s], size)) if len(s) else np.zeros(0, bool)
            steps = np.zeros(len(block.flat) + 1, np.int64)
            np.add.at(steps, at[gone], 1)
            np.add.at(steps, at[gone] + min_words, -1)
            covered = np.cumsum(steps)[:-1] > 0
            body = table.column("body").take(pa.array(block.order)).to_pylist()
            for i, x in enumerate(body):
                c = covered[block.starts[i] : block.ends[i]]
                n_words.append(len(c))
                n_removed.append(int(c.sum()))
                texts.append(_without(x, c) if n_removed[-1] else x)
            table = table.take(pa.array(block.order))
        return pa.table({
            "row": table.column("row").combine_chunks() if table.num_rows else pa.array([], table.schema.field("row").type),
            "body": pa.array(texts, pa.binary()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        })

    by_block = lambda: base.groupBy("block")
    halves = by_block().applyInArrow(send_halves, _SENT).groupBy("bucket").applyInArrow(answer, _REPLY)
    full = by_block().cogroup(halves.groupBy("block")).applyInArrow(send_full, _SENT).groupBy("bucket").applyInArrow(answer, _REPLY)
    both = halves.unionByName(full)
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([StructField("row", row_type), StructField("body", BinaryType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    out = by_block().cogroup(both.groupBy("block")).applyInArrow(cut, schema)
    return out.select(
        *[F.col("body").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names],
        F.struct("n_words", "n_removed").alias("dedup"),
    )


def repeat_lengths(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[tuple[int, int]]]:
    """(id, longest) for each row with an id, and for each level its length and how many windows survived it.

    Levels are min_words, twice that, and so on: a window survives if a row with another id has its word sequence, and what
    survives is extended to twice the length where the window that follows it in its text survives too, until none does.
    longest: the greatest level's length at which a window of the row survives; 0 if none does. Null and short texts: 0.
    A level reads what the one before wrote, surviving windows alone; texts are read for the first one only.
    """
    spark = docs.sparkSession
    total = C.text_bytes(docs, text_col)
    n_blocks, n_buckets = C.groups(total, C.BLOCK_BYTES), C.groups(total, C.BUCKET_BYTES)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).filter("id is not null")
    base = base.withColumn("block", C.block_of(F.col("id"), n_blocks))

    def table(rows: list[tuple]) -> pa.Table:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("level", "block", "bucket", "keys", "more", "least"), columns, types, strict=True)})

    def grouped(at: np.ndarray, doc: np.ndarray, h: np.ndarray, ids: np.ndarray):
        """The order of windows by hash, the runs, and the least and greatest id of each."""
        order = np.lexsort((doc, h))  # documents are in the order of their ids
        s = C.runs(h[order])
        ends = np.append(s[1:], len(h)) - 1
        return order, s, ids[doc[order[s]]], ids[doc[order[ends]]] if len(s) else ids[:0]

    def state(block: int, at: np.ndarray, doc: np.ndarray, h: np.ndarray, ids: np.ndarray, longest: np.ndarray, survived: int) -> pa.Table:
        """A row for the block's windows, one for its documents, and what it sends to each bucket."""
        order, s, least, most = grouped(at, doc, h, ids)
        keys = h[order][s]
        sends = [(1, block, b, C.pack(keys[i:j], True), C.pack(most[i:j]), C.pack(least[i:j])) for b, i, j in C.ranges(keys, n_buckets)]
        own = (-1, block, survived, C.pack(at, True), C.pack(h), C.pack(doc))
        return table([own, (-2, block, 0, C.pack(ids), C.pack(longest), b""), *sends])

    def begin(key, part: pa.Table, reply: pa.Table) -> pa.Table:
        if not part.num_rows:
            return table([])
        block = _Block(part, min_words)
        keys, _, _ = block.halves()
        alive = _alive(block, _joined(_bits(reply, 1), C.ranges(keys, n_buckets)))
        h = C.mix(window_hashes(block.flat, min_words, _ODD), 1)[block.at[alive]] if len(block.at) else np.zeros(0, np.uint64)
        return state(part.column("block")[0].as_py(), block.at[alive], block.doc[alive], h, block.ids, np.zeros(len(block.ids), np.int64), 0)

    def send_halves(part: pa.Table) -> pa.Table:
        block = _Block(part, min_words)
        keys, multi, _ = block.halves()
        return table([(1, part.column("block")[0].as_py(), b, C.pack(keys[i:j], True), C.pack(multi[i:j].view(np.uint8)), b"") for b, i, j in C.ranges(keys, n_buckets)])

    def answer(part: pa.Table, half: bool = False) -> pa.Table:
        """Whether documents with different ids have each key."""
        keys = [C.unpack(x, np.uint64, True) for x in part.column("keys").to_pylist()]
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        s = C.runs(k[order])
        size = np.diff(np.append(s, len(k)))
        if half:
            yes = (size > 1) | (np.maximum.reduceat(np.concatenate([C.unpack(x, np.uint8) for x in part.column("more").to_pylist()])[order], s) > 0)
        else:
            most, least = (np.concatenate([C.unpack(x, np.int64) for x in part.column(c).to_pylist()])[order] for c in ("more", "least"))
            yes = np.maximum.reduceat(most, s) > np.minimum.reduceat(least, s)
        flag = np.zeros(len(k), bool)
        flag[order] = np.repeat(yes, size)
        bits = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum([len(x) for x in keys])[:-1])]
        n = part.num_rows
        return pa.table({"level": pa.array([1] * n, pa.int32()), "block": part.column("block"), "bucket": part.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def extended(length: int):
        def extend(key, own: pa.Table, reply: pa.Table) -> pa.Table:
            rows = {r["level"]: r for r in own.to_pylist()}
            if -1 not in rows:
                return table([])
            at, h, doc = C.unpack(rows[-1]["keys"], np.int64, True), C.unpack(rows[-1]["more"], np.uint64), C.unpack(rows[-1]["least"], np.int64)
            ids, longest = C.unpack(rows[-2]["keys"], np.int64), C.unpack(rows[-2]["more"], np.int64).copy()
            order, s, *_ = grouped(at, doc, h, ids)
            yes = _joined(_bits(reply, 1), C.ranges(h[order][s], n_buckets))
            alive = np.zeros(len(at), bool)
            alive[order] = np.repeat(yes, np.diff(np.append(s, len(at))))
            at, h, doc = at[alive], h[alive], doc[alive]
            longest[doc] = length
            survived = len(at)
            if survived:
                after = np.minimum(np.searchsorted(at, at + length), survived - 1)
                go = (at[after] == at + length) & (doc[after] == doc)
                with np.errstate(over="ignore"):
                    h = C.mix(h[go] * np.uint64(_ODD) + h[after[go]], 3)
                at, doc = at[go], doc[go]
            return state(rows[-1]["block"], at, doc, h, ids, longest, survived)

        return extend

    halves = base.groupBy("block").applyInArrow(send_halves, _SENT).groupBy("bucket").applyInArrow(lambda part: answer(part, True), _REPLY)
    now = C.settle(base.groupBy("block").cogroup(halves.groupBy("block")).applyInArrow(begin, _SENT), "windows")
    length, survivors = min_words, []
    while not now.filter("level = 1").isEmpty():
        replies = now.filter("level = 1").groupBy("bucket").applyInArrow(lambda part: answer(part), _REPLY)
        now = C.settle(now.filter("level < 0").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(extended(length), _SENT), "windows")
        survivors.append((length, now.filter("level = -1").agg(F.sum("bucket")).first()[0] or 0))
        length *= 2

    def result(batches):
        for batch in batches:
            for ids, longest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(C.unpack(ids, np.int64)), pa.array(C.unpack(longest, np.int64))], [id_col, "longest"])

    found = now.filter("level = -2").select("keys", "more").mapInArrow(result, f"`{id_col}` long, longest long")
    return found, survivors


def _without(text: bytes, covered: np.ndarray) -> bytes:
    spans = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
    return b" ".join(text[spans[i][0] : spans[j - 1][1]] for i, j in zip(edge[::2], edge[1::2], strict=True))


def kept_digest(text):
    """SHA-256 of a text's words joined by one space; null: of the empty string."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", " ")), 256)
