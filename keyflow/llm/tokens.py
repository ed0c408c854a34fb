"""Token ids by the tokenizers library, memoised for the stretches between white space.

A text is cut where white space follows something else. The two kinds of tokenizer that are known here have no pre-token
(and no normalisation) that reaches over such a place, so the ids of the stretches in a row are the ids of the text. A
tokenizer of any other kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from keyflow.llm.common import SHORT_SPAN, eight_bytes, hold, padded_bytes, runs, span_hashes

#: Stretches, and parts of them, that a worker keeps ids of; it starts anew when full.
MEMO_STRETCHES, MEMO_PARTS = 250_000, 500_000

#: Characters of texts that are worked on together.
PORTION_CHARS = 1 << 20

_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_STRETCH = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_EDGE = re.compile(r"(?<=[^ \n\t\r])(?=[ \n\t\r])")
#: One pre-token for both tokenizers.
_LETTERS = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LETTER, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (bytes([*range(65, 91), *range(97, 123)]), b".,;:!?%$&*#|"))
_CUT_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
#: Letters and then marks: pre-tokens of their own for both tokenizers, whatever Unicode version they follow.
_SIMPLE = re.compile("([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?%$&*#|]*)")
#: The byte-level spelling: visible Latin-1 characters stand for themselves, the other bytes for those from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SPELLING = [chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256)]
_SPACE = _SPELLING[32]


#: How the known kinds normalise and cut: byte-level with the usual pattern; words and marks in lower case (fixed values).
_BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_LOWER_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def stretches(text: str) -> list[str]:
    """The text cut before white space that follows something else; together they are the text."""
    if _ODD_SPACE.search(text):
        return [x for x in _BETWEEN.split(text) if x]
    return _STRETCH.findall(text)


def pieces(text: str) -> list[str]:
    """A text cut into some of about ``PORTION_CHARS`` characters, before white space that follows something else."""
    out, begin = [], 0
    while len(text) - begin > 2 * PORTION_CHARS and (cut := _EDGE.search(text, begin + PORTION_CHARS)):
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


def _equal_spans(padded: np.ndarray, begin: np.ndarray, lens: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span of bytes equals that numbered in other."""
    if not np.array_equal(lens, lens[other]):
        return False
    left = np.flatnonzero(other != np.arange(len(other)))
    for done in range(0, SHORT_SPAN, 8):
        left = left[lens[left] > done]
        left_lens = lens[left] - done
        if not np.array_equal(eight_bytes(padded, begin[left] + done, left_lens), eight_bytes(padded, begin[other[left]] + done, left_lens)):
            return False
    left = left[lens[left] > SHORT_SPAN].tolist()
    return all(np.array_equal(padded[begin[i] : begin[i] + lens[i]], padded[begin[other[i]] : begin[other[i]] + lens[i]]) for i in left)


class Encoder:
    """Ids of whole texts without special tokens; their strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        how = spec.get("normalizer"), spec.get("pre_tokenizer")
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(t["special"] for t in spec["added_tokens"])
        #: Whether texts may be cut; and whether a pre-token is never white space, so that white space can be left out.
        self.cuts, self.drops_space = plain and how in (_BYTE_LEVEL, _LOWER_WORDS), how == _LOWER_WORDS
        self.model = self.tokenizer.model
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.stretch_ids: dict[bytes, bytes] = {}

    def parts(self, text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if self.drops_space else stretches(text)

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of dtype."""
        if not self.cuts:
            return [array(self.kind, e.ids).tobytes() for i in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            if not self.drops_space and _ODD_SPACE.search(text):
                out[i].append(self._one_by_one(text))
                continue
            for piece in pieces(text):
                held.append(piece.encode())
                owner.append(i)
                size += len(held[-1])
                if size >= PORTION_CHARS:
                    self._put(out, owner, held)
                    held, owner, size = [], [], 0
        self._put(out, owner, held)
        return [b"".join(x) for x in out]

    def _one_by_one(self, text: str) -> bytes:
        parts = self.parts(text)
        self._learn([parts])
        return b"".join(map(self.memo.__getitem__, parts))

    def _put(self, out: list[list[bytes]], owner: list[int], texts: list[bytes]) -> None:
        """Ids of texts, each distinct stretch being looked up once: equal ones are found by sorting their hashes, and compared byte by byte.

        Stretches are cut between a letter and a mark too, over which no pre-token of the known kinds reaches.
        """
        joined = b"".join(texts)
        if not joined:
            return
        padded, ends = padded_bytes(joined), np.cumsum([len(t) for t in texts])
        c = padded[: len(joined)]
        space = _CUT_SPACE[c]
        first = np.zeros(len(joined), bool)
        first[1:] = _LETTER[c[:-1]] & _MARK[c[1:]]
        first[0] = True
        first[ends[:-1][ends[:-1] < len(joined)]] = True
        if self.drops_space:
            first[1:] |= space[:-1]
            begin = np.flatnonzero(first & ~space)
            last = np.append(first[1:] | space[1:], True)
            lens = np.flatnonzero(last & ~space) + 1 - begin
        else:
            first[1:] |= space[1:] & ~space[:-1]
            begin = np.flatnonzero(first)
            lens = np.diff(np.append(begin, len(joined)))
        h = span_hashes(padded, begin, lens)
        order = np.argsort(h)
        s = runs(h[order])
        kind = np.empty(len(h), np.int64)
        kind[order] = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(h))))
        model = order[s]
        if not _equal_spans(padded, begin, lens, model[kind]):
            for i, t in zip(owner, texts, strict=True):
                out[i].append(self._one_by_one(t.decode()))
            return
        ids = self._ids([joined[b:e] for b, e in zip(begin[model].tolist(), (begin[model] + lens[model]).tolist(), strict=True)])
        flat, size = np.frombuffer(b"".join(ids), self.dtype), self.dtype.itemsize
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        from_ = np.cumsum(n) - n
        per = n[kind]
        until = np.cumsum(per)
        raw = flat[np.arange(int(per.sum())) + np.repeat(from_[kind] - until + per, per)].tobytes()
        cuts = np.append(0, until)[np.searchsorted(begin, ends)] * size
        for i, b, e in zip(owner, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            out[i].append(raw[b:e])

    def counts(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Ids of each stretch, counted."""
        if not self.cuts:
            raise ValueError("this tokenizer's texts can't be cut into stretches")
        self._learn(parts)
        size, get = self.dtype.itemsize, self.memo.__getitem__
        return [np.fromiter(map(len, map(get, p)), np.int64, len(p)) // size for p in parts]

    def _learn(self, parts: list[list[str]]) -> None:
        hold(self)
        need = set().union(*parts)
        memo, known, simple = self.memo, self.known, _SIMPLE.fullmatch
        new = [w for w in need if w not in memo]
        if len(memo) + len(new) > MEMO_STRETCHES:
            memo.clear()
            new = list(need)
        if len(known) > MEMO_PARTS:
            known.clear()
        others = []
        for w in new:
            m = simple(w)
            if not m:
                others.append(w)
                continue
            space, letters, marks = m.groups()
            if self.drops_space:
                before, word = b"", letters.lower()
            elif space == "\n":
                before, word = self._part(space), letters
            else:
                before, word = b"", space + letters
            ids = known.get(word)
            if ids is None:
                # letters alone are one pre-token: it goes straight to the model, in the model's spelling of bytes
                spelt = word.replace(" ", _SPACE) if word.isascii() else "".join(map(_SPELLING.__getitem__, word.encode()))
                ids = known[word] = array(self.kind, [t.id for t in self.model.tokenize(spelt)]).tobytes()
            memo[w] = before + ids + self._part(marks) if before or marks else ids
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[w] = array(self.kind, e.ids).tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct stretches."""
        hold(self)
        stretch_ids = self.stretch_ids
        found = list(map(stretch_ids.get, words))
        others = []
        for i, ids in enumerate(found):
            if ids is None:
                w = words[i].decode()
                if not _LETTERS.fullmatch(w) or (self.drops_space and w[0] == " "):
                    others.append((i, w))
                    continue
                if self.drops_space:
                    w = w.lower()
                spelt = w.replace(" ", _SPACE) if w.isascii() else "".join(map(_SPELLING.__getitem__, w.encode()))
                found[i] = array(self.kind, [t.id for t in self.model.tokenize(spelt)]).tobytes()
                if len(stretch_ids) < MEMO_PARTS:
                    stretch_ids[words[i]] = found[i]
        for n in range(0, len(others), 4096):
            some = others[n : n + 4096]
            for (i, _), e in zip(some, self.tokenizer.encode_batch_fast([w for _, w in some], add_special_tokens=False), strict=True):
                found[i] = array(self.kind, e.ids).tobytes()
                if len(stretch_ids) < MEMO_PARTS:
                    stretch_ids[words[i]] = found[i]
        if len(stretch_ids) >= MEMO_PARTS:
            stretch_ids.clear()
        return found

    def clear(self) -> None:
        self.stretch_ids.clear()
        self.memo.clear()
        self.known.clear()

    def _part(self, text: str) -> bytes:
        """Ids of a few marks or a line's end, pre-tokens of their own."""
        if not text:
            return b""
        ids = self.known.get(text)
        if ids is None:
            ids = self.known[text] = array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def portions(batch):
    """(keys, texts) of a batch's first two columns, some texts at a time."""
    keys, texts, size = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        keys.append(k)
        texts.append(t)
        size += len(t)
        if size > PORTION_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
