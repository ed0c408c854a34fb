"""Token ids in binary shards, with a minimal perfect hash from document keys to places in the shard.

A shard holds documents in ascending order of their keys: raw little-endian ids, then for each record its key and count,
then the hash: levels of bit sets (a key belongs to the first level where it is alone at its place), whose ranks number
the keys without gaps, and for each number a fingerprint of the key and the place of its first record. A lookup reads a word
of bits in one or a few levels, a rank, a fingerprint, a place, and the record: as much for a large shard as for a small one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyflow.llm import common as C
from keyflow.llm.tokens import encoder, portions

MAGIC = b"KFTOKEN1"
#: Places for each key of a level of the hash.
_GAMMA = 2
#: Text to a shard.
SHARD_BYTES = 64 << 20


class PerfectHash:
    """Numbers distinct 64-bit keys from 0 without gaps."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.begins = np.cumsum([0, *sizes])
        per = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(per) - per

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, all_bits, sizes = keys, [], []
        while len(left):
            size = -(-_GAMMA * len(left) // 64)
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size * 64) == 1
            all_bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(all_bits) if all_bits else np.zeros(0, "<u8"), sizes)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(keys, level + 7) % np.uint64(size * 64)).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for a key that isn't there -1 or any number."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._at(keys[open_], level, size)
            word = self.begins[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


def key_print(keys: np.ndarray) -> np.ndarray:
    return (C.mix(keys, 99) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Writes a shard to a stream as documents come, in ascending order of their keys; nulls first."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype, self.keys, self.known, self.counts = out, dtype, [], [], []
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.counts.append(len(ids) // self.dtype.itemsize)

    def close(self) -> tuple[int, int]:
        """Writes the index; gives the numbers of documents and of ids."""
        keys, known, counts = np.array(self.keys, "<i8"), np.array(self.known, bool), np.array(self.counts, "<i8")
        begins = np.cumsum(counts) - counts
        first = np.flatnonzero(known)
        first = first[C.runs(keys[first])] if len(first) else first
        distinct = keys[first].view("<u8")
        mph = PerfectHash.of(distinct)
        slot = mph.number(distinct)
        prints, places = np.zeros(len(first), "<u4"), np.zeros(len(first), "<i8")
        prints[slot], places[slot] = key_print(distinct), first
        parts = {"keys": keys, "known": known.view(np.uint8), "counts": counts, "begins": begins.astype("<i8"), "bits": mph.bits, "ranks": mph.before.astype("<i8"), "prints": prints, "places": places}
        head = json.dumps({"dtype": self.dtype.str, "ids": int(counts.sum()), "levels": mph.sizes, "parts": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
        for v in parts.values():
            self.out.write(v.tobytes())
        self.out.write(head + len(head).to_bytes(8, "little") + MAGIC)
        return len(keys), int(counts.sum())


class Shard:
    """Keyed access to a shard; file: something seekable. Opening reads the head alone."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 16)
        size, magic = int.from_bytes(file.read(8), "little"), file.read(8)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(end - 16 - size)
        head = json.loads(file.read(size))
        self.dtype, self.levels = np.dtype(head["dtype"]), head["levels"]
        self.parts, at = {}, len(MAGIC) + head["ids"] * self.dtype.itemsize
        for name, kind, n in head["parts"]:
            self.parts[name] = at, np.dtype(kind), n
            at += n * np.dtype(kind).itemsize

    def read(self, name: str, begin: int = 0, n: int | None = None) -> np.ndarray:
        """Some of a part of the index, or all of it."""
        at, kind, size = self.parts[name]
        n = size - begin if n is None else n
        self.file.seek(at + begin * kind.itemsize)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def place(self, key: int) -> int:
        """The first record of a key, by a few reads; -1 where the fingerprint says that it isn't here."""
        one, begin = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self.levels):
            at = int(PerfectHash._at(one, level, size)[0])
            word = int(self.read("bits", begin + (at >> 6), 1)[0])
            if word >> (at & 63) & 1:
                slot = int(self.read("ranks", begin + (at >> 6), 1)[0]) + (word & ((1 << (at & 63)) - 1)).bit_count()
                same = self.read("prints", slot, 1)[0] == key_print(one)[0]
                return int(self.read("places", slot, 1)[0]) if same else -1
            begin += size
        return -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents with that key: its first record's and those of the records after it that have the key too."""
        at, out = self.place(key), []
        while 0 <= at < self.parts["keys"][2] and self.read("keys", at, 1)[0] == key and self.read("known", at, 1)[0]:
            begin, n = int(self.read("begins", at, 1)[0]), int(self.read("counts", at, 1)[0])
            self.file.seek(len(MAGIC) + begin * self.dtype.itemsize)
            out.append(np.frombuffer(self.file.read(n * self.dtype.itemsize), self.dtype))
            at += 1
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each of many keys; -1 where the fingerprint says that it isn't here."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = PerfectHash(self.read("bits"), self.levels).number(keys)
        prints, places = self.read("prints"), self.read("places")
        if not len(prints):
            return np.full(len(keys), -1, np.int64)
        ok = (slot >= 0) & (prints[slot] == key_print(keys))
        return np.where(ok, places[slot], -1)

    def documents(self, keys: np.ndarray | None = None):
        """(key or None, begin, ids) of the documents with those keys, each found by the hash; without keys of all documents, those without a key first."""
        own, known, begins, counts = self.read("keys"), self.read("known").astype(bool), self.read("begins"), self.read("counts")
        none = int(np.count_nonzero(~known))  # they are the first records
        if keys is None:
            keys = own[none:][C.runs(own[none:])] if none < len(own) else own[:0]
            for at in range(none):
                yield None, int(begins[at]), self._ids(begins[at], counts[at])
        found = self.find(keys)
        for key, at in zip(keys.tolist(), found.tolist(), strict=True):
            while none <= at < len(own) and own[at] == key:
                yield key, int(begins[at]), self._ids(begins[at], counts[at])
                at += 1

    def _ids(self, begin: int, n: int) -> np.ndarray:
        self.file.seek(len(MAGIC) + int(begin) * self.dtype.itemsize)
        return np.frombuffer(self.file.read(int(n) * self.dtype.itemsize), self.dtype)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs to the shared folder; gives (shard, path, documents, tokens, low, high).

    Ascending order of ids over shards and in them; equal ids by text, all in one shard; null ids first, without a key.
    Null text: only the end id. No rows: shards without documents, or none.
    """
    folder = C.new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = C.groups(C.text_bytes(rows), shard_bytes)
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def write(batches):
        import os

        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(tokenizer)
        fs, at = C.filesystem(folder)
        fs.create_dir(at, recursive=True)
        name = f"shard-{task.partitionId():06d}.tok"
        mine = f"{at}/.{name}.{task.taskAttemptId()}.{os.getpid()}"
        end, low, high = np.array([end_id], enc.dtype).tobytes(), None, None
        with fs.open_output_stream(mine) as out:
            shard = ShardWriter(out, enc.dtype)
            for batch in batches:
                for ids, texts in portions(batch):
                    for key, raw in zip(ids, enc.raw(texts), strict=True):
                        shard.add(key, raw + end)
                        low, high = key if low is None else low, key
            documents, tokens = shard.close()
        fs.move(mine, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "path": [f"{folder}/{name}"], "documents": [documents], "tokens": [tokens], "low": [low], "high": [high]},
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]),
        )

    return C.settle(rows.mapInArrow(write, "shard int, path string, documents long, tokens long, low long, high long"), "token-list")


_READ = "doc_id long, start long, ids binary"
_READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _placed(shards: DataFrame) -> DataFrame:
    """The shards that have documents, with the ids before each (a window over one row a shard)."""
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", "path", "documents", "low", "high", F.coalesce(before, F.lit(0)).cast("long").alias("begin")).filter("documents > 0")


def _batches(found):
    """Record batches of (key, start, ids), some at a time."""
    held, size = [], 0
    for key, start, ids in found:
        held.append((key, start, ids.astype("<u4").tobytes()))
        size += len(held[-1][2])
        if size > 4 << 20 or len(held) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document's ids, as little-endian unsigned 32-bit numbers, found through its shard's hash.

    start: the ids of all documents before it. Documents with null ids have no key and are read by their record.
    """

    def read(batches):
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = C.filesystem(path)
                with fs.open_input_file(at) as file:
                    shard, n = Shard(file), 0
                    for out in _batches((k, begin + b, ids) for k, b, ids in shard.documents()):
                        n += out.num_rows
                        yield out
                    if n != shard.parts["keys"][2]:
                        raise ValueError(f"the hash of {path} misses {shard.parts['keys'][2] - n} documents")

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(shards).select("path", "begin").repartition(n).mapInArrow(read, _READ)


def lookup_tokens(shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of the documents with those keys; keys that no shard has, and null ones, give nothing.

    A key goes to the shards whose range has it: both are dealt to as many even bins of the keys' range as there are
    shards, so that a shard is in few bins and nothing is broadcast.
    """
    placed = _placed(shards).filter("low is not null or high is not null")
    bounds = placed.agg(F.min(F.coalesce("low", "high")), F.max("high"), F.count(F.lit(1))).first()
    least, width = bounds[0] or 0, max(1, -(-((bounds[1] or 0) - (bounds[0] or 0) + 1) // max(1, bounds[2])))
    bin_of = lambda c: F.floor((F.col(c) - F.lit(least)) / F.lit(width)).cast("long")
    placed = placed.withColumn("low", F.coalesce("low", F.lit(least))).withColumn("bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))
    asked = keys.select(F.col(key_col).cast("long").alias("key")).dropna().distinct().withColumn("bin", bin_of("key"))
    routed = asked.join(placed, "bin").filter("key between low and high").select("path", "begin", "key")

    def read(table: pa.Table) -> pa.Table:
        fs, at = C.filesystem(table.column("path")[0].as_py())
        begin = table.column("begin")[0].as_py()
        with fs.open_input_file(at) as file:
            found = list(_batches((k, begin + b, ids) for k, b, ids in Shard(file).documents(np.sort(np.array(table.column("key"), np.int64)))))
        return pa.Table.from_batches(found, schema=_READ_SCHEMA)

    return routed.groupBy("path").applyInArrow(read, _READ)
