"""What the training-data operators share: tables, the shared folder, words, and exchanges between blocks of documents.

A *block* is a bounded group of documents (by a hash of their id), about ``BLOCK_BYTES`` of text. An operator that needs
to know about all other documents works on a block at a time: it sends the block's distinct keys, sorted and packed, to
buckets of the key space (one row for each block and bucket, so that neither a frequent key nor a large group of copies
makes a bucket large), and gets an answer for each key back in the same order.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.functions.files import new_folder, shared_dir  # noqa: F401

#: Text of a block; a block may be larger by its last document.
BLOCK_BYTES = 6 << 20
#: Text whose keys go to one bucket.
BUCKET_BYTES = 16 << 20
#: Fewest blocks and buckets, so that small inputs use all cores.
LEAST_GROUPS = 24
#: Entries of a worker's memo of words; it starts anew when full.
MEMO_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and losing executors doesn't undo it."""
    spark = df.sparkSession
    at = new_folder(spark, kind)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def filesystem(uri: str):
    """A pyarrow file system and the path in it; a path without scheme is local (or a shared mount)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def groups(total: int, each: int) -> int:
    return max(LEAST_GROUPS, -(-total // each))


def block_of(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


_holder = None


def hold(memo) -> None:
    """Only one memo is kept in a process, the last that learnt something (None: none); the others start anew."""
    global _holder
    if _holder is not memo:
        if _holder is not None:
            _holder.clear()
            trim()
        _holder = memo


def trim() -> None:
    """Gives memory that isn't used back to the machine; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordHash(dict):
    """64-bit hash of a word (bytes), memoised."""

    def __missing__(self, word: bytes) -> int:
        if _holder is not self:
            hold(self)
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TOGETHER = 4 << 20
#: Longest span, in bytes, that is hashed eight bytes at a time together with all others; longer ones are few, and each is hashed alone.
SHORT_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eight_bytes(padded: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as one number, zeros after its end. padded: whole numbers of eight bytes, eight more than the spans reach."""
    words, place = padded.view("<u8"), at >> 3
    shift = ((at & 7) << 3).astype(np.uint64)
    x = (words[place] >> shift) | (words[place + 1] << (np.uint64(63) - shift) << np.uint64(1))
    return x & _LOW_BYTES[np.minimum(lens, 8)]


def padded_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text + bytes(16 - len(text) % 8), np.uint8)


def span_hashes(padded: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    h = mix(eight_bytes(padded, at, lens) ^ (lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    left = np.flatnonzero((lens > 8) & (lens <= SHORT_SPAN))
    for done in range(8, SHORT_SPAN, 8):
        left = left[lens[left] > done]
        if not len(left):
            break
        h[left] = mix(h[left] ^ eight_bytes(padded, at[left] + done, lens[left] - done), done)
    for i in np.flatnonzero(lens > SHORT_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[at[i] : at[i] + lens[i]])
    return h


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts in a row (``bytes.split``; lower: A-Z as a-z), and how many each text has.

    No word becomes a Python object, unless it is very long.
    """
    hashes, counts, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= _TOGETHER or i + 1 == len(texts):
            h, n = _hashed(held, lower)
            hashes.append(h)
            counts.append(n)
            held, size = [], 0
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *counts])


def _hashed(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n"
    padded = padded_bytes(joined.lower() if lower else joined)
    space = _SPACE[padded[: len(joined)]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.append(0, edge)
    begin, end = edge[::2], edge[1::2]  # the text ends with a space
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(begin, ends), prepend=0)
    return span_hashes(padded, begin, end - begin), count


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as planes of bytes, compressed; ascending ones as their differences."""
    if ascending and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(x, dtype=dtype) if ascending else x


def ranges(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of those of n even ranges of the 64-bit key space that have any of some ascending keys; n is under 2**32."""
    number = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return slices(number)


def slices(number: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, begin, end) of each run in ascending numbers."""
    s = runs(number)
    return list(zip(number[s].tolist(), s.tolist(), [*s[1:].tolist(), len(number)][: len(s)], strict=True))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending; by sorting, which is many times faster than np.unique's table of hashes."""
    x = np.sort(x)
    return x[runs(x)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's counts (integers, so that their order doesn't matter)."""
    order = np.argsort(keys)
    keys = keys[order]
    s = runs(keys)
    return keys[s], np.add.reduceat(counts[order], s) if len(s) else counts[:0]


def bodies(column) -> list[bytes]:
    """The texts of an Arrow column of binary or string; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
