"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most e edits shares at least (m - q + 1) - q e of its q-grams with the text,
on diagonals no more than e apart. Shared q-grams are counted in overlapping bands of diagonals, two of e + 1 wide and
half over the next, so that some band holds them all; bands that meet the bound are verified by banded alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C

#: Edits that an occurrence may have, for each character of the item.
EDITS = 0.08
#: q-gram lengths, from the one that filters best; an item uses the first whose bound is at least LEAST.
LENGTHS, LEAST = (9, 6, 4, 3, 2, 1), 2
#: Characters of items that are indexed, and sent to the tasks, at a time.
BLOCK_CHARS = 4_000_000
_ODD = np.uint64(0x9FB21C651E98DF25)
_FILTER_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, and one space for each stretch of white space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place where one fits."""
    from keyflow.llm.substring_dedup import window_hashes

    return C.mix(window_hashes(x.astype(np.uint64) + np.uint64(1), q, int(_ODD)), 4)


def bound(m: int, q: int, e: int) -> int:
    return m - q + 1 - q * e


class Items:
    """An index of the items' q-grams for one q."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.items = q, items
        h = [grams(x, q) for _, x, _ in items]
        sizes = [len(x) for x in h]
        owner, place, h = np.repeat(np.arange(len(items)), sizes), np.concatenate([np.arange(n) for n in sizes]), np.concatenate(h)
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], owner[order], place[order]
        s = C.runs(h)
        self.hashes, self.begins = h[s], np.append(s, len(h))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[h >> np.uint64(64 - _FILTER_BITS)] = True
        self.edits = np.array([e for _, _, e in items], np.int64)
        self.needs = np.array([max(1, bound(len(x), q, e)) for _, x, e in items], np.int64)
        self.least = int(self.needs.min())
        self.reach = int(max(len(x) + e for _, x, e in items))

    def candidates(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of the band) of each band with enough shared q-grams."""
        if len(text) < self.q:
            return []
        h = grams(text, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        if len(at) < self.least:
            return []
        # a place counts if enough places with known q-grams are within an item's reach of it
        i = np.arange(len(at))
        dense = np.searchsorted(at, at + self.reach, "right") - i >= self.least
        if not dense.any():
            return []
        steps = np.zeros(len(at) + 1, np.int64)
        np.add.at(steps, i[dense], 1)
        np.add.at(steps, np.searchsorted(at, at[dense] + self.reach, "right"), -1)
        at = at[np.cumsum(steps)[:-1] > 0]
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        n = self.begins[slot + 1] - self.begins[slot]
        at = np.repeat(at, n)
        entry = np.repeat(self.begins[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner = self.owner[entry]
        diagonal = at - self.place[entry] + (1 << 20)
        wide = self.edits[owner] + 1
        band = diagonal // wide
        keys = np.concatenate([owner << 40 | band, owner << 40 | (band - 1)])
        found, count = np.unique(keys, return_counts=True)
        ok = count >= self.needs[found >> 40]
        return [(int(k >> 40), int((k & ((1 << 40) - 1)) * (self.edits[k >> 40] + 1) - (1 << 20))) for k in found[ok]]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in text on diagonals low to high, if it has at most that many edits."""
    width, m, far, one = high - low + 1, len(item), 1 << 60, 1 << 32
    for d in range(max(low, 0), min(high, len(text) - m) + 1):  # without edits there is nothing to align
        if text[d] == item[0] and np.array_equal(text[d : d + m], item):
            return 0, d, d + m
    # column c of row i is text place low + i + c; a cell holds edits and, for the later start, what is left of the text there
    place = np.arange(low, low + m + width, dtype=np.int64)
    within = (place >= 0) & (place <= len(text))
    bar = np.where(within, 0, far)
    letters = np.full(m + width, -1, np.int64)  # the one that ends at a place
    there = np.flatnonzero((place >= 1) & (place <= len(text)))
    letters[there] = text[place[there] - 1]
    row = np.where(within[:width], len(text) - place[:width], far)
    step = np.arange(width, dtype=np.int64) * one
    for i, c in enumerate(item.tolist(), 1):
        new = row + (letters[i : i + width] != c) * one
        np.minimum(new[:-1], row[1:] + one, out=new[:-1])
        new += bar[i : i + width]
        new -= step
        np.minimum.accumulate(new, out=new)
        new += step
        new += bar[i : i + width]
        row = np.minimum(new, far, out=new)
    best = int(row.argmin())
    edits = int(row[best]) >> 32
    if row[best] >= far or edits > most:
        return None
    return edits, len(text) - (int(row[best]) & (one - 1)), low + m + best


def leaks_in(text: str, indexes: list[Items]) -> list[dict]:
    """The items in a normalised text: of each its best occurrence."""
    x, best = points(text), {}
    for index in indexes:
        for k, diagonal in index.candidates(x):
            key, item, most = index.items[k]
            found = align(item, x, diagonal - most, diagonal + 3 * most + 2, most)
            if found and ((index.q, k) not in best or found < best[index.q, k][1]):
                best[index.q, k] = key, found
    return [{"item_id": key, "edits": e, "start": s, "end": t} for key, (e, s, t) in sorted(best.values(), key=lambda v: (v[0] is None, v[0] or 0, v[1]))]


class Block:
    """Items that are searched for together; what goes to the tasks is their text, and each task makes its own index."""

    def __init__(self, items: list[tuple[int, str, int]]):
        self.items, self._made = items, None

    def indexes(self) -> list[Items]:
        if self._made is None:
            self._made = _indexes([(key, points(text), e) for key, text, e in self.items])
        return self._made


def _blocks(benchmark: DataFrame, item_id: str, text_col: str, rate: float, block_chars: int):
    """The items, as many at a time as have so many characters; those without text are left out."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text_col).cast("string")).distinct()
    for key, text in rows.toLocalIterator():
        if text := normal(text):
            held.append((key, text, int(len(text) * rate)))
            size += len(text)
        if size > block_chars:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _indexes(items: list[tuple[int, np.ndarray, int]]) -> list[Items]:
    by: dict[int, list] = {}
    for key, x, e in items:
        q = next((q for q in LENGTHS if bound(len(x), q, e) >= LEAST), 1)
        by.setdefault(q, []).append((key, x, e))
    return [Items(q, own) for q, own in by.items()]


_HIT = "array<struct<item_id: long, edits: long, start: long, end: long>>"
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with an array ``leaks`` of the benchmark items that occur in the text with at most ``rate`` edits a character.

    Each has item_id, edits, and start and end in the normalised text (lower case, single spaces); one for an item. Items
    are read in blocks of bounded size, each of which goes over all docs. Null and empty texts have none; null and empty
    items match nothing; repeated items count once, repeated rows each. A column called ``leaks`` is replaced.
    """
    docs = docs.drop("leaks")
    from pyspark.sql.types import StructField, StructType

    names = docs.columns
    kind = docs.select(F.lit(None).cast(_HIT).alias("x")).schema["x"].dataType
    schema = StructType([StructField("row", docs.schema), StructField("text", docs.select(F.col(text_col).cast("string")).schema[0].dataType), StructField("leaks", kind)])
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast(_HIT).alias("leaks"))
    for block in _blocks(benchmark, item_id, item_text, rate, block_chars):

        def search(batches, block=block):
            for batch in batches:
                found = [(old or []) + leaks_in(normal(t), block.indexes()) for t, old in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _HIT_TYPE)], ["row", "text", "leaks"])

        out = out.mapInArrow(search, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.coalesce("leaks", F.array().cast(_HIT)).alias("leaks"))
