"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of r + 1 bits; each non-zero vector v of r + 1 bits gives a mask of the bits
whose vector has an odd product with v. Any r differing bits have a v orthogonal to all their vectors, so under that
mask the two fingerprints are equal: every pair within r bits shares a bucket in one of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C
from keyflow.llm.components import by_root, components

#: Fingerprints with equal masked bits up to this many are compared pair by pair.
_FEW = 1024
#: Masked fingerprints to a bucket.
_BUCKET_ROWS = 500_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles' XXH64: a bit is set if it is in over half of them; no words: 0; fewer words than a shingle: all of them."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=begin[1:])
    last = begin[min(shingle, len(words)) :][:n] - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], seed) for i, j in zip(begin[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def masks(radius: int, bits: int = 64) -> np.ndarray:
    """The covering masks of so many bits for that radius, as unsigned 64-bit numbers."""
    of = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return np.array([sum(1 << i for i in range(bits) if (of[i] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))], np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n, by links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while not np.array_equal(up := root[root], root):
            root = up


def _linked(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in x, distinct fingerprints; all pairs within the radius for few, else enough of them."""
    near = lambda rows: np.nonzero(np.bitwise_count(x[rows, None] ^ x[None, :]) <= radius)
    if len(x) <= _FEW:
        i, j = near(np.arange(len(x)))
        return i[i < j], j[i < j]
    # Many: first those one or two bits apart, found in the sorted list; then whatever isn't in the largest class against all.
    order = np.argsort(x)
    sorted_x = x[order]
    varying = int(np.bitwise_or.reduce(x ^ x[0]))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    steps = bits + [p | q for n, p in enumerate(bits) for q in bits[:n]]
    a, b = [], []
    for s in steps if radius >= 2 else bits[: radius * 64]:
        to = sorted_x ^ np.uint64(s)
        at = np.minimum(np.searchsorted(sorted_x, to), len(x) - 1)
        hit = sorted_x[at] == to
        a.append(order[hit])
        b.append(order[at[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    root = _roots(len(x), a, b)
    keep = root != np.arange(len(x))
    a, b = [np.flatnonzero(keep)], [root[keep]]
    largest = np.bincount(root).argmax()
    rest = np.flatnonzero(root != largest)
    for i in range(0, len(rest), 256):
        rows = rest[i : i + 256]
        p, q = near(rows)
        p = rows[p]
        tree = _roots(len(x), np.concatenate([*a, p]), np.concatenate([*b, q]))
        moved = tree != np.arange(len(x))
        a, b = [np.flatnonzero(moved)], [tree[moved]]
    return a[0], b[0]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) that join all fingerprints of fps (fp long, distinct) within the radius: a forest for each bucket, no pair list."""
    table_masks = masks(radius)
    signed = [int(m) for m in table_masks.astype(np.int64)]
    n = C.groups(fps.count() * len(signed), _BUCKET_ROWS)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    spread = fps.select("fp", tables.alias("x")).select(F.pmod(F.xxhash64("x.t", "x.key"), F.lit(n)).cast("int").alias("bucket"), "x.t", "fp")

    def link(table: pa.Table) -> pa.Table:
        x = np.array(table.column("fp")).astype(np.int64).view(np.uint64)
        t = np.array(table.column("t")).astype(np.int64)
        key = x & table_masks[t]
        order = np.lexsort((x, key, t))
        x, t, key = x[order], t[order], key[order]
        s = C.runs(t, key)
        size = np.diff(np.append(s, len(x)))
        all_x, at = np.unique(x, return_inverse=True)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(size <= 16, size) & np.repeat(size > 1, size)
        end = np.repeat(s + size, size)
        for lag in range(1, 16):
            i = np.flatnonzero(small & (np.arange(len(x)) + lag < end))
            i = i[np.bitwise_count(x[i] ^ x[i + lag]) <= radius]
            a.append(at[i])
            b.append(at[i + lag])
        for begin, m in zip(s[size > 16], size[size > 16], strict=True):
            i, j = _linked(x[begin : begin + m], radius)
            a.append(at[begin + i])
            b.append(at[begin + j])
        # the least fingerprint by sign is the root everywhere, so that buckets name the same one
        signed_x = all_x.view(np.int64)
        rank = np.argsort(signed_x)
        where = np.empty_like(rank)
        where[rank] = np.arange(len(rank))
        root = _roots(len(all_x), where[np.concatenate(a)], where[np.concatenate(b)])
        moved = root != np.arange(len(root))
        ranked = signed_x[rank]
        return pa.table({"a": pa.array(ranked[moved], pa.int64()), "b": pa.array(ranked[root[moved]], pa.int64())})

    return spread.groupBy("bucket").applyInArrow(link, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex string, component_id): the least id reachable over fingerprints that differ in ``radius`` bits or fewer.

    One row for each input row. Texts are lower-cased (A-Z). Null and empty texts have fingerprint zero and are linked
    like any other. Null ids keep their row, and don't become a component's id (which is null where all ids are null).
    Repeated rows share a component. No rows: no rows. Other columns aren't looked at.
    """

    def prints(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in C.bodies(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = C.settle(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(prints, "id long, fp long"), "prints")
    fps = C.settle(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    roots = components(near_links(fps.select("fp"), radius)).toDF("fp", "root")
    linked = fps.select("fp", "first").join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = by_root(linked, least, "root", "fp").select("fp", F.col("component_id").alias("least"))
    of = C.settle(fps.join(linked, "fp", "left").select("fp", "first", "n", F.coalesce("least", "first").alias("component_id")), "classes")
    alone = of.filter("n = 1").select(F.col("first").alias("id"), "fp", "component_id")  # its row's own id
    copies = by_root(rows, of.filter("n > 1").select("fp", "component_id"), "fp", "id").select("id", "fp", "component_id")
    found = alone.unionByName(copies)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
