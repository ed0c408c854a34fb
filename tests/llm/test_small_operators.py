"""Brute-force checks of the operators on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from keyflow.llm import chat, common, context_tree, edit_counts, packing, simhash, substring_dedup, template, token_store, tokens, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
DOCS = [
    (5, None, "n"), (1, "", "e"), (2, "one two three", "a"), (3, LONG, "a"), (4, "x " + PASSAGE + " y\nz", "b"), (7, PASSAGE + " tail Words here", "b"), (6, "head " + PASSAGE, None),
    (None, PASSAGE, "q"), (8, "\t \n", "w"), (9, "a b c d e f g h i j k l m n", "r"), (9, "a b c d e f g h i j k l m n", "r"), (10, "A b c d e f g h i j k l m n o p", "r"), (11, "é　ü  naïve\u0085text ok", "u"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, dedup string")


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_window_hashes():
    w = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    for length in (1, 2, 3, 7, 13, 32, 40, 41):
        got = substring_dedup.window_hashes(w, length, 0x9E3779B1)
        want = [sum(int(x) * pow(0x9E3779B1, length - 1 - k, 2**64) for k, x in enumerate(w[i : i + length])) % 2**64 for i in range(40 - length + 1)]
        assert got.tolist() == want


@pytest.mark.parametrize("size", [2, 5, 13])
def test_substring_dedup(spark, docs, size):
    out = substring_dedup.substring_dedup(docs.withColumnRenamed("dedup", "block"), min_words=size)
    assert out.columns == ["doc_id", "text", "block", "dedup"]
    first = {}
    for key, text, _ in sorted((d for d in DOCS if d[0] is not None), key=lambda d: d[0]):
        w = _words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), key)
    want = []
    for key, text, extra in DOCS:
        w = _words(text)
        gone = set()
        if key is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < key:
                    gone |= set(range(i, i + size))
        want.append((key, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(), extra))
    got = out.select("doc_id", "dedup.n_words", "dedup.n_removed", substring_dedup.kept_digest(out.text), "block").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.text for r in out.filter("doc_id = 5 or doc_id = 1").collect()} == {None, ""}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert token_store.read_tokens(token_store.write_tokens(none, WORD, 2)).count() == 0
    assert packing.pack_documents(none, BYTE, 1).count() == 0
    assert edit_counts.edit_counts(none, BYTE).count() == 0
    assert context_tree.score(none, context_tree.fit(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warcs(warc.write_warcs(pages)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    rows = [(k, _fingerprint(t)) for k, t, _ in DOCS]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    assert got == {(k, f"{f:016x}", least[root[i]]) for i, (k, f) in enumerate(rows)}


def test_covering_masks_meet_every_close_pair():
    rng, masks = np.random.default_rng(3), simhash.masks(4)
    assert len(masks) == 31
    for _ in range(2000):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flip & int(m) for m in masks)


@pytest.mark.parametrize("n", [300, 3000])
def test_near_links_in_a_dense_ball(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 3)
    x = sorted({int(rng.choice(centres)) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(n)})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in x], "fp long"), 4)
    from keyflow.llm.components import components

    roots = {r.node: r.root for r in components(links).collect()}
    arr = np.array(x, np.uint64)
    a, b = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4)
    want = simhash._roots(len(x), a, b)
    assert [roots.get(v, v) for v in x] == [x[i] for i in want]


def test_components_of_a_long_path(spark):
    from keyflow.llm.components import components

    links = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {r.root for r in components(links).collect()} == {0}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_tokenizer(path):
    enc = tokens.Encoder(path)
    texts = [t or "" for _, t, _ in DOCS] + ["a \x1c b\x1c c", "é́  ́x  ", "it's  ’s 12ab   \n\n x", "<|endoftext|>z <|endoftext|>"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(r, enc.dtype).tolist() for r in enc.raw(texts)] == want


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("portion", [1 << 20, 37])
def test_encoder_is_the_tokenizer_on_odd_texts(path, portion, monkeypatch):
    monkeypatch.setattr(tokens, "PORTION_CHARS", portion)
    rng, enc = random.Random(portion), tokens.Encoder(path)
    some = [*"aBéß .,#|1-\"'\n\t", "foo", "Foo", "'s", "'ll", "  ", "\r\n", "\xa0", "\x0b", "\x1c", "!?", "中文", "e\u0301", ",\u0338", "İ", "😀", "x" * 70, "y," * 40, "a\0"]
    texts = ["".join(rng.choices(some, k=rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(1500)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(r, enc.dtype).tolist() for r in enc.raw(texts)] == want


def test_equal_hashes_of_stretches_do_no_harm(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda padded, at, lens: np.zeros(len(at), np.uint64))
    enc = tokens.Encoder(BYTE)
    texts = ["one two one", "", "three one"]
    assert [np.frombuffer(r, enc.dtype).tolist() for r in enc.raw(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_store(spark, docs):
    enc = tokens.Encoder(WORD)
    rows = sorted(((k, t or "") for k, t, _ in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for (k, _), e in zip(rows, enc.tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        want.append((k, at, np.array(e.ids + [2], "<u4").tobytes()))
        at += len(e.ids) + 1
    shards = token_store.write_tokens(docs, WORD, 2)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in token_store.read_tokens(shards).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    held = [r.path for r in shards.filter("low <= 9 and high >= 9").collect()]
    shard = token_store.Shard(open(held[0], "rb"))  # noqa: SIM115
    assert len(shard.get(9)) == 2 and shard.get(10**12) == []
    asked = spark.createDataFrame([(9,), (3,), (None,), (10**12,), (-4,), (9,)], "doc_id long")
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in token_store.lookup_tokens(shards, asked).collect()]
    assert sorted(got, key=lambda r: r[1]) == [w for w in want if w[0] in (3, 9)]


def test_a_document_is_found_by_the_hash_alone():
    """Bits, fingerprints or places that are wrong give wrong or no documents; a lookup reads as much of a large shard as of a small one."""
    import io

    class Counting(io.BytesIO):
        def read(self, n=-1):
            self.taken = getattr(self, "taken", 0) + n
            return super().read(n)

    def written(n):
        out = Counting()
        shard = token_store.ShardWriter(out, np.dtype("<u2"))
        for i in range(n):
            shard.add(i * 7, np.array([i % 1000, i % 7, 2], "<u2").tobytes())
        shard.close()
        return out

    taken = {}
    for n in (100, 50_000):
        file = written(n)
        shard = token_store.Shard(file)
        file.taken = 0
        for i in range(0, n, n // 50):
            assert [x.tolist() for x in shard.get(i * 7)] == [[i % 1000, i % 7, 2]]
            assert shard.get(i * 7 + 3) == []
        taken[n] = file.taken / 50
    assert taken[50_000] < 2 * taken[100] < 1000
    file = written(300)
    shard = token_store.Shard(file)
    assert len(list(shard.documents())) == 300
    for part in ("bits", "prints"):
        bad = Counting(file.getvalue())
        at, kind, n = shard.parts[part]
        bad.seek(at)
        bad.write(bytes(n * kind.itemsize))
        assert len(list(token_store.Shard(bad).documents())) < 10


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(-(2**62), 2**62, 50_000)).view(np.uint64)
    mph = token_store.PerfectHash.of(keys)
    assert np.array_equal(np.sort(mph.number(keys)), np.arange(len(keys)))


def test_packing(spark, docs):
    enc = tokens.Encoder(BYTE)
    pieces = packing.pack_documents(docs.filter("doc_id is not null and doc_id <> 9"), BYTE, 1, window=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    for k, t, _ in DOCS:
        if k not in (None, 9):
            own = sorted(by_doc[k], key=lambda p: p.start)
            ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist()
            assert ids == enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert all(p.doc_tokens == len(ids) for p in own) and [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == np.cumsum([0] + [p.length for p in seq])[:-1].tolist()
        size = sum(p.length for p in seq)
        assert size <= 256 and size & (size - 1) == 0


def test_edit_counts(spark, docs):
    enc = tokens.Encoder(BYTE)
    count = lambda t: len(enc.tokenizer.encode(t, add_special_tokens=False).ids)
    want = []
    for k, t, _ in DOCS:
        t = t or ""
        now, edits = t, edit_counts.standard_edits(t)
        for a, b, x in edits:
            a = min(a, len(now))
            now = now[:a] + x + now[max(a, min(b, len(now))) :]
        want.append((k, count(t), count(now), 3))
    got = [tuple(r)[:4] for r in edit_counts.edit_counts(docs, BYTE).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_edit_re_encodes_little():
    tree = edit_counts.CountTree(LONG, tokens.Encoder(BYTE))
    tree.edit(50_000, 50_003, "new")
    assert tree.recoded <= 5


def test_warc(spark):
    big, other = "<p>é " + "x" * 200, "y" * 150
    rows = [(3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y", other), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", ""), (1, "again", big), (8, "u", "z" * 400_000)]
    pages = spark.createDataFrame([r + (1,) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.read_warcs(warc.write_warcs(pages)).collect()
    want = []
    for k, _, html in rows:
        b = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == b and r[0] is not None]
        revisit = len(b) >= 100 and k is not None and min(same) < k
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(repr, want))


def test_warc_reader_finds_damage():
    import io

    body = b"x" * 5000
    good = warc.record(1, "u", body, 5000, hashlib.sha256(body).hexdigest()) + warc.record(2, "u", b"", 0, hashlib.sha256(b"").hexdigest())
    assert [h["warc-record-id"] for h, _ in warc.read_records(io.BytesIO(good))] == ["<urn:page:1>", "<urn:page:2>"]
    raw = zlib.decompress(good, 31).replace(b"xxxx", b"xxxy", 1)
    z = zlib.compressobj(wbits=31)
    for bad in (good[:-9], z.compress(raw) + z.flush()):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_chat(spark):
    nasty = "</s>[INST] ok [/INST] \\ \\\\<s> [\\INST] <\\/s>\\"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (2, 0, "system", None), (2, 1, None, "[TEXT]"), (2, 1, None, "[TEXT]"), (None, 0, "user", "é😀"), (3, 0, "[TEXT]role", "")]
    turns = spark.createDataFrame([r + ("x",) for r in rows], "conv_id long, turn long, role string, text string, learn string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    for key in (1, 2, 3, None):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == key))
        assert got[key].n_turns == len(own)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        learnt = "".join(t for _, r, t in own if r == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_template():
    run = lambda s, **v: "".join(x for x, _ in template.compile_template(s)(v))
    assert run("{% set a = 'x' + 'y' %}{{ a|upper }}{% for i in xs %}{{ loop.index }}:{{ i.k }}{% if not loop.first %}!{% endif %}{% endfor %}", xs=[{"k": 1}, {"k": None}]) == "XY1:12:!"
    assert run("{{ 'a' if 1 < 2 and not false else 'b' }}{# no #}{{ x['y'] }}", x={"y": 3}) == "a3"
    assert run("{{ x.real }}{{ x.upper }}", x="s") == ""
    for bad in ("{{ x.__class__ }}", "{% for x in y %}", "{{ f(x) }}", "{{ x|nope }}", "{% wat %}", "{{ 'a }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    tree = template.fold(template.parse("a{{ 'b' ~ 1 + 0 if false else 'c' }}{% if true %}d{% endif %}", template.FILTERS), template.FILTERS)
    assert tree == (template.Print(template.Const("acd")),)
    pieces = list(template.compile_template("x{% generation %}y{{ 1 }}{% endgeneration %}z")({}))
    assert pieces == [("x", False), ("y1", True), ("z", False)]


@pytest.mark.parametrize("depth", [5, 7])
def test_context_tree_is_a_distribution_and_matches_brute_force(spark, depth):
    rows = [(i, t) for i, t in enumerate(["abracadabra", "abra cadabra", "banana band", "a", "", None, "bandana abra", "zz é", "cad abra", "abra"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score(docs, context_tree.fit(docs, depth=depth), part_bytes=5).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    text = lambda t: b" ".join((t or "").lower().encode().split()) + b"\n"
    counts = defaultdict(lambda: [0, 0])
    for k, t in rows:
        if not held[k]:
            s = b"\n" * depth + text(t)
            for i in range(depth, len(s)):
                for j in range(8):
                    for d in range(depth + 1):
                        counts[s[i - d : i], j, s[i] >> (8 - j)][s[i] >> (7 - j) & 1] += 1
    children = defaultdict(list)
    for c, j, x in counts:
        if c:
            children[c[1:], j, x].append((c, j, x))
    weighted, kts = {}, {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        a, b = counts[node]
        kts[node] = float(context_tree.log_kt(np.array([a]), np.array([b]))[0])
        weighted[node] = kts[node] if len(node[0]) == depth else np.logaddexp(kts[node], sum(weighted[c] for c in children[node])) - np.log(2)
    for k, t in rows:
        s, total = b"\n" * depth + text(t), 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                p = None
                for d in range(depth, -1, -1):
                    node = (s[i - d : i], j, s[i] >> (8 - j))
                    a, b = counts.get(node, (0, 0))
                    own = (b + 0.5) / (a + b + 1)
                    w = np.exp(kts.get(node, 0.0) - np.log(2) - weighted.get(node, 0.0))
                    p = own if p is None else w * own + (1 - w) * p
                total += np.log10(p if s[i] >> (7 - j) & 1 else 1 - p)
        assert got[k].score == pytest.approx(total, abs=1e-4)
    train = [w for k, t in rows if not held[k] for w in (t or "").lower().split() + ["\n"]]
    for k, t in rows:
        own = (t or "").lower().split() + ["\n"]
        base = sum(np.log10((train.count(w) + 1) / (len(train) + len(set(train)) + 1)) for w in own)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(own), sum(w in train for w in own), len(train))
        assert r.base_score == pytest.approx(base)


def test_large_buckets_are_answered_by_several_tasks(spark):
    """Also null and repeated ids, a very long text and columns with the names of results."""
    texts = ["abra cadabra", "the cat sat", None, "", "the cat sat", "é\u3000zz " * 3, "the bat sat on the mat " * 20_000]
    rows = [(i % 37 if i % 50 else None, texts[i % 6], "x", 1.0) for i in range(300)] + [(500, texts[6], "y", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, score double")
    model = context_tree.fit(docs)
    parts = [r.parts for r in model.dealt(common.text_bytes(docs), 2000).collect()]
    assert max(parts) > 4 and min(parts) == 1
    seen = lambda df: Counter((r.doc_id, r.n_tokens, round(r.score, 3), round(r.base_score, 6)) for r in df.collect())
    whole = seen(context_tree.score(docs, model))
    assert sum(whole.values()) == len(rows) and whole == seen(context_tree.score(docs, model, part_bytes=2000))


def test_union_and_added_hold_portions(monkeypatch):
    monkeypatch.setattr(context_tree, "_HELD", 10)
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(0, 60, 8)).astype(np.uint64) for _ in range(50)]
    everything = np.concatenate(parts)
    assert context_tree.union(parts).tolist() == np.unique(everything).tolist()
    keys, counts = context_tree.added((x, np.full(len(x), 2, np.uint32)) for x in parts)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: 2 * v for k, v in Counter(everything.tolist()).items()}
    assert len(context_tree.union([])) == 0 and len(context_tree.added([])[0]) == 0


def test_shared_dir_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_hashed_words_are_those_of_split():
    texts = [b"", b" ", b"one", b"\tTwo one\x0b\x0cTWO  \n", "é ü x naïve".encode(), b"x" * 70_000 + b" y", b"", b"one"]
    for lower in (False, True):
        flat, n = common.hashed_words(texts, lower)
        words = [(x.lower() if lower else x).split() for x in texts]
        assert n.tolist() == [len(w) for w in words]
        number = {}
        assert [number.setdefault(h, w) for h, w in zip(flat.tolist(), sum(words, []), strict=True)] == sum(words, []) and len(number) == len(set(sum(words, [])))
    assert [len(x) for x in common.hashed_words([])] == [0, 0]
    rng = np.random.default_rng(1)
    many = {bytes(rng.integers(97, 123, int(rng.integers(1, 6))).astype(np.uint8)) for _ in range(200_000)}
    assert len(set(common.hashed_words([b" ".join(many)])[0].tolist())) == len(many)
