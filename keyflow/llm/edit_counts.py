"""Token counts that follow edits: a tree of sums over a document's stretches, of which an edit re-encodes a few."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm.tokens import Encoder, encoder, portions, stretches

#: Stretches in a leaf at first.
LEAF = 32

Edit = tuple[int, int, str]


class CountTree:
    """The stretches of a text between white space in leaves, and over them a binary tree of characters and tokens.

    Where a text is cut depends on two neighbouring characters, so an edit needs the stretches that it touches and one
    more on either side; these are cut and encoded anew, their leaf takes them, and the sums above it change.
    """

    def __init__(self, text: str, enc: Encoder, parts: list[str] | None = None, counts: np.ndarray | None = None):
        self.enc = enc
        parts = stretches(text) if parts is None else parts
        counts = enc.counts([parts])[0] if counts is None else counts
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF].tolist() for i in range(0, len(parts), LEAF)] or [[]]
        self.recoded = 0
        n = self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        if parts:
            at = np.arange(0, len(parts), LEAF)
            self.tokens[n : n + len(at)] = np.add.reduceat(counts, at)
            self.chars[n : n + len(at)] = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), at)
        while n > 1:
            for sums in (self.tokens, self.chars):
                sums[n // 2 : n] = sums[n : 2 * n : 2] + sums[n + 1 : 2 * n : 2]
            n //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf with that character, and the characters before the leaf; the last leaf for the end of the text."""
        if place >= self.length:
            return len(self.leaves) - 1, self.length - int(self.chars[self.size + len(self.leaves) - 1])
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.chars[i]:
                before += int(self.chars[i])
                i += 1
        return i - self.size, before

    def _put(self, leaf: int, parts: list[str], counts: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = parts, counts
        i = self.size + leaf
        dt, dc = sum(counts) - self.tokens[i], sum(map(len, parts)) - self.chars[i]
        while i:
            self.tokens[i] += dt
            self.chars[i] += dc
            i //= 2

    def edit(self, start: int, end: int, text: str) -> int:
        """Puts text for the characters from start to end; gives the new count of the document."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        # from the stretch before the first touched to the one after the last, over leaves
        low, before = self._leaf(max(start - 1, 0))
        high, high_before = self._leaf(end)
        of = lambda k: [(k, p, c) for p, c in zip(self.leaves[k], self.counts[k], strict=True)]
        flat = [x for k in range(low, high + 1) for x in of(k)]
        ends = before + np.cumsum([len(x[1]) for x in flat]) if flat else np.zeros(0, np.int64)
        i = int(np.searchsorted(ends, max(start - 1, 0), "right"))
        j = int(np.searchsorted(ends, end, "right")) + 1
        if i == 0:  # context from the leaf before, if there is one with text
            k = low - 1
            while k >= 0 and not self.leaves[k]:
                k -= 1
            if k >= 0:
                low, before = k, before - sum(map(len, self.leaves[k]))
                flat = of(k) + flat
                i, j = len(self.leaves[k]), j + len(self.leaves[k])
        i = max(0, i - 1)
        if j > len(flat):
            k = high + 1
            while k < len(self.leaves) and not self.leaves[k]:
                k += 1
            if k < len(self.leaves):
                high = k
                flat += of(k)
            j = min(j, len(flat))
        at = before + sum(len(x[1]) for x in flat[:i])
        old = "".join(x[1] for x in flat[i:j])
        new = stretches(old[: start - at] + text + old[end - at :])
        self.recoded += len(new)
        owner = flat[i][0] if i < len(flat) else low
        fresh = [(owner, p, c) for p, c in zip(new, self.enc.counts([new])[0].tolist(), strict=True)]
        for k in range(low, high + 1):
            mine = [x for x in flat[:i] + fresh + flat[j:] if x[0] == k]
            if (parts := [x[1] for x in mine]) != self.leaves[k]:
                self._put(k, parts, [x[2] for x in mine])
        return self.total

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def standard_edits(text: str) -> list[Edit]:
    """The edits that the registered query makes: a note put in at a quarter, a word's place rewritten in the middle, and a stretch cut at three quarters."""
    n = len(text)
    return [(n // 4, n // 4, " (see note)"), (n // 2, min(n, n // 2 + 8), "revised"), (3 * n // 4, min(n, 3 * n // 4 + 20), "")]


def edit_counts(docs: DataFrame, tokenizer: str, edits: Callable[[str], Iterable[Edit]] = standard_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_edits, n_stretches, n_recoded) for each row.

    Each edit (start, end, text; characters) is made on the text as the edits before it left it; places outside the text
    mean its ends. Null text: empty, edited like any other. Null and repeated ids keep their rows. No rows: no rows.
    """
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_stretches", "n_recoded"]

    def count(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for keys, texts in portions(batch):
                out, parts = [], [stretches(t) for t in texts]
                for key, t, p, c in zip(keys, texts, parts, enc.counts(parts), strict=True):
                    tree, n = CountTree(t, enc, p, c), 0
                    before = tree.total
                    for edit in edits(t):
                        tree.edit(*edit)
                        n += 1
                    out.append((key, before, tree.total, n, len(p), tree.recoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, ", ".join(f"{n} long" for n in names))
