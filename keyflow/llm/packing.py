"""Lexical retrieval packing: every seed document asks all shards of a BM25 inverted index, and its neighbours fill its windows.

Seeds are the documents whose id is divisible by ``every``. A shard of the index is a bounded portion of documents with its
postings; document counts, their number and mean length are those of all documents. Each seed's query has all of its terms,
and each is scored against every document, a block of seeds and a shard at a time. A document goes to the seed that finds it
best, so it is used once; queries have length one, for which a seed's ranking is the same and seeds of all lengths compare.
A seed's windows take it and then its documents by descending score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import common as C
from keyflow.llm.tokens import encoder

K1, B = 1.2, 0.75
#: A document whose id is divisible by this is a seed.
EVERY = 100
#: Text and documents of a shard of the index; text and seeds of a block of queries.
SHARD_BYTES, SHARD_ROWS = 4 << 20, 4096
QUERY_BYTES, QUERY_ROWS = 1 << 20, 512
#: Ids of a task that fills windows.
FILL_BYTES = 4 << 20
#: Blocks of queries are held by a task up to this size, and else read anew for each shard.
HELD_BYTES = 48 << 20
#: Terms of a shard that are multiplied as a matrix: those that most of its documents have.
_DENSE = 512
#: Products that are added up together; few enough for a processor's cache.
_PRODUCTS = 1 << 17
#: Distinct terms that a counting task holds before it sends them on.
_HELD_TERMS = 1_500_000
_QUERIES = "block int, seeds binary, lens binary, terms binary, numbers binary, weights binary"


def distinct_terms(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, ascending; for each pair of a term and a text that has it the term's number, the text and how often, by term; and the texts' lengths.

    A term is a hashed word, A-Z lower-cased.
    """
    flat, lens = C.hashed_words(bodies, lower=True)
    n = max(1, len(bodies))
    order = np.argsort(flat)
    s = C.runs(flat[order])
    number = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(flat))))
    key = np.sort(number * n + np.repeat(np.arange(len(bodies)), lens)[order])
    terms = flat[order[s]]
    s = C.runs(key)
    tf = np.diff(np.append(s, len(key)))
    return terms, key[s] // n, key[s] % n, tf, lens


class Shard:
    """The postings of some documents."""

    def __init__(self, bodies: list[bytes], mean: float):
        self.n = len(bodies)
        self.terms, number, self.docs, tf, lens = distinct_terms(bodies)
        self.df = np.bincount(number, minlength=len(self.terms))
        self.begins = np.cumsum(self.df) - self.df
        norm = K1 * (1 - B + B * lens / max(mean, 1e-9))
        self.weights = (tf * (K1 + 1) / (tf + norm[self.docs])).astype(np.float32)
        # the terms that most documents have are multiplied as a matrix
        self.column = np.full(len(self.terms), -1)
        common = np.argsort(-self.df, kind="stable")[:_DENSE]
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        own = self.column[number] >= 0
        self.matrix[self.column[number[own]], self.docs[own]] = self.weights[own]

    def scores(self, lens: np.ndarray, terms: np.ndarray, number: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A row for each query of its score for each document; a query is so many numbers of the ascending terms, and their weights."""
        out = np.zeros((len(lens), self.n), np.float32)
        if not len(self.terms) or not len(terms):
            return out
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        have = self.terms[place] == terms
        column = np.where(have, self.column[place], -2)[number]
        query, left = np.repeat(np.arange(len(lens)), lens), np.zeros((len(lens), len(self.matrix)), np.float32)
        own = np.flatnonzero(column >= 0)
        left[query[own], column[own]] = weights[own]
        np.matmul(left, self.matrix, out=out)
        rest = np.flatnonzero(column == -1)
        query, weights, place = query[rest], weights[rest], place[number[rest]]
        per = self.df[place]
        until = np.cumsum(per)
        flat = out.reshape(-1)
        cuts = [0, *(np.flatnonzero(np.diff(until // _PRODUCTS)) + 1).tolist(), len(rest)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            n = per[i:j]
            posting = np.arange(n.sum()) + np.repeat(self.begins[place[i:j]] - np.cumsum(n) + n, n)
            first, last = int(query[i]) * self.n, (int(query[j - 1]) + 1) * self.n  # queries are in order
            cell = self.docs[posting] + np.repeat(query[i:j] * self.n - first, n)
            flat[first:last] += np.bincount(cell, self.weights[posting] * np.repeat(weights[i:j], n), last - first)
        return out


def _portions(batches: Iterable[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.Table]:
    """Some rows at a time, by the size of their texts (column ``body``) and their number."""
    held, length, n = [], 0, 0
    for batch in batches:
        sizes, begin = pc.binary_length(batch.column("body")).to_pylist(), 0
        for i in range(batch.num_rows):
            length += sizes[i]
            n += 1
            if length >= size or n >= rows:
                held.append(batch.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(held)
                held, length, n, begin = [], 0, 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Queries:
    """The seeds' queries in the shared folder, in blocks of bounded size."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.held = folder, size, None

    def _read(self) -> Iterator[tuple[np.ndarray, ...]]:
        import pyarrow.parquet as pq
        from pyarrow import fs as filesystems

        fs, at = C.filesystem(self.folder)
        for info in sorted(fs.get_file_info(filesystems.FileSelector(at)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(1):
                        row = [batch.column(i)[0].as_py() for i in range(1, 6)]
                        yield tuple(np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint64, np.int32, np.float32), strict=True))

    def blocks(self) -> Iterable[tuple[np.ndarray, ...]]:
        """(seeds, lens, terms, number, weights) of each block: its distinct terms, ascending, and each query's numbers of them."""
        if self.size > HELD_BYTES:
            return self._read()
        if self.held is None:
            self.held = list(self._read())
        return self.held


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def build_queries(rows: DataFrame, every: int = EVERY) -> tuple[Queries, float]:
    """The seeds' queries, weighted by the document counts of all rows (id, body), and the mean length of all rows in words."""
    spark = rows.sparkSession
    n = C.groups(C.text_bytes(rows, "body"), C.BUCKET_BYTES)
    bucket_of = lambda keys: (C.mix(keys, 5) % np.uint64(n)).astype(np.int64)

    def table(made: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made, strict=True)) or [()] * 4, types, strict=True)], ["bucket", "block", "keys", "counts"])

    def sent(keys: np.ndarray, counts: np.ndarray, block: int) -> list[tuple]:
        """Ascending keys and their counts, a row for each bucket."""
        bucket = bucket_of(keys).astype(np.uint16 if n <= 1 << 16 else np.int64)  # short numbers are sorted by counting
        order = np.argsort(bucket, kind="stable")
        return [(b, block, C.pack(keys[order][i:j], True), C.pack(counts[order][i:j].astype(np.uint32))) for b, i, j in C.slices(bucket[order])]

    def count(batches):
        held, total, documents = [], 0, 0
        merged = lambda: C.summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        for part in _portions(batches, SHARD_BYTES, SHARD_ROWS):
            terms, number, *_, lens = distinct_terms(C.bodies(part.column("body").combine_chunks()))
            held.append((terms, np.bincount(number, minlength=len(terms))))
            documents, total = documents + len(lens), total + int(lens.sum())
            if sum(len(k) for k, _ in held) > 2 * _HELD_TERMS:
                held = [merged()]
                if len(held[0][0]) > _HELD_TERMS:
                    yield table(sent(*held[0], 0))
                    held = []
        made = sent(*merged(), 0) if held else []
        yield table([*made, (-1, 0, np.array([documents, total], "<i8").tobytes(), b"")])
        C.trim()

    ddl = "bucket int, block int, keys binary, counts binary"
    counts = C.settle(rows.mapInArrow(count, ddl), "term-counts")
    stats = np.array([np.frombuffer(r.keys, "<i8") for r in counts.filter("bucket = -1").select("keys").toLocalIterator()] or [[0, 0]], np.int64).sum(axis=0)  # a row for each task
    documents, mean = int(stats[0]), float(stats[1]) / max(1, int(stats[0]))

    seeds = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("body").alias("body"))
    size = seeds.agg(F.sum(F.octet_length("body")).alias("a"), F.count(F.lit(1)).alias("b")).first()
    n_blocks = max(1, -(-(size.a or 0) // QUERY_BYTES), -(-size.b // QUERY_ROWS))
    seeds = seeds.withColumn("block", C.block_of(F.col("id"), n_blocks))

    def ask(part: pa.Table) -> pa.Table:
        terms = distinct_terms(C.bodies(part.column("body").combine_chunks()))[0]
        return pa.Table.from_batches([table(sent(terms, np.zeros(len(terms)), part.column("block")[0].as_py()))])

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([table([])])
        none = [np.zeros(0, np.uint64)]
        keys, df = C.summed(np.concatenate(none + [C.unpack(x, np.uint64, True) for x in known.column("keys").to_pylist()]), np.concatenate(none + [C.unpack(x, np.uint32) for x in known.column("counts").to_pylist()]))
        made = []
        for b, block, x in zip(*(asked.column(c).to_pylist() for c in ("bucket", "block", "keys")), strict=True):
            made.append((b, block, x, C.pack(df[np.searchsorted(keys, C.unpack(x, np.uint64, True))].astype(np.uint64))))
        return pa.Table.from_batches([table(made)])

    schema = pa.schema([("block", pa.int32()), ("seeds", pa.binary()), ("lens", pa.binary()), ("terms", pa.binary()), ("numbers", pa.binary()), ("weights", pa.binary())])

    def finish(part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.Table.from_pylist([], schema)
        part = part.sort_by("id")
        terms, number, doc, _, lens = distinct_terms(C.bodies(part.column("body").combine_chunks()))
        keys = np.concatenate([np.zeros(0, np.uint64), *(C.unpack(x, np.uint64, True) for x in replies.column("keys").to_pylist())])
        df = np.concatenate([np.zeros(0, np.uint64), *(C.unpack(x, np.uint64) for x in replies.column("counts").to_pylist())]).astype(np.float64)
        order = np.argsort(keys)
        idf = np.log1p((documents - df[order] + 0.5) / (df[order] + 0.5))  # keys are the block's terms
        by_doc = np.argsort(doc, kind="stable")
        weight, doc = idf[number[by_doc]], doc[by_doc]
        length = np.sqrt(np.bincount(doc, weight**2, len(lens)))
        weight /= np.maximum(length, 1e-12)[doc]
        return pa.Table.from_pylist([{
            "block": part.column("block")[0].as_py(), "seeds": np.array(part.column("id"), np.int64).tobytes(), "lens": np.bincount(doc, minlength=len(lens)).astype(np.int64).tobytes(),
            "terms": terms.tobytes(), "numbers": number[by_doc].astype(np.int32).tobytes(), "weights": weight.astype(np.float32).tobytes(),
        }], schema)

    asked = seeds.groupBy("block").applyInArrow(ask, ddl)
    replies = counts.filter("bucket >= 0").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, ddl)
    folder = C.new_folder(spark, "queries")
    seeds.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, _QUERIES).write.parquet(folder)
    held = spark.read.schema(_QUERIES).parquet(folder).agg(F.sum(F.octet_length("terms") + F.octet_length("numbers") + F.octet_length("weights"))).first()[0]
    return Queries(folder, held or 0), mean


def search(docs: DataFrame, k: int, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(seed, doc_id, score, rank): for each seed the k documents of highest BM25 score over all shards, but for those with its own id.

    The score is BM25 of all of the seed's distinct terms, divided by the length of the query's vector. Documents without a
    term of the seed aren't found. Equal scores: by id.
    """
    rows = _rows_of(docs, id_col, text_col)
    queries, mean = build_queries(rows, every)

    def ask(batches):
        for part in _portions(batches, SHARD_BYTES, SHARD_ROWS):
            shard, ids = Shard(C.bodies(part.column("body").combine_chunks()), mean), np.array(part.column("id").fill_null(-1), np.int64)
            known = np.array(part.column("id").is_valid())
            for seeds, lens, terms, number, weights in queries.blocks():
                scores = shard.scores(lens, terms, number, weights)
                scores[(seeds[:, None] == ids[None, :]) & known[None, :]] = 0
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(scores, best, 1)
                q, j = np.nonzero(value > 0)
                yield pa.RecordBatch.from_arrays([pa.array(seeds[q]), pa.array(ids[best[q, j]], mask=~known[best[q, j]]), pa.array(value[q, j].astype(np.float64))], ["seed", "doc_id", "score"])

    from pyspark.sql import Window

    found = rows.mapInArrow(ask, "seed long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def fill(documents: Iterable[tuple[int, int]], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents (number, count) in order: whole windows, then lengths that are powers of two."""
    sequence, open_, room = 0, [], window
    for d, count in documents:
        start = 0
        while start < count:
            n = min(room, count - start)
            open_.append((d, start, n))
            start, room = start + n, room - n
            if not room:
                offset = 0
                for a, b, m in open_:
                    yield a, b, m, sequence, offset
                    offset += m
                sequence, open_, room = sequence + 1, [], window
    left = window - room
    while left:
        size, offset = 1 << (left.bit_length() - 1), 0
        left -= size
        while offset < size:
            a, b, m = open_.pop(0)
            n = min(m, size - offset)
            yield a, b, n, sequence, offset
            if n < m:
                open_.insert(0, (a, b + n, m - n))
            offset += n
        sequence += 1


def route(docs: DataFrame, tokenizer: str, end_id: int, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, seed, score, ids): each document's ids, and the seed that finds it best; a seed is its own, without a score.

    Documents that no seed finds have none. place tells rows with the same id apart.
    """
    rows = _rows_of(docs, id_col, text_col)
    queries, mean = build_queries(rows, every)

    def best(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for part in _portions(batches, SHARD_BYTES, SHARD_ROWS):
            column = part.column("body").combine_chunks()
            bodies = C.bodies(column)
            shard, n = Shard(bodies, mean), part.num_rows
            score, seed = np.zeros(n, np.float32), np.zeros(n, np.int64)
            for seeds, lens, terms, number, weights in queries.blocks():
                found = shard.scores(lens, terms, number, weights)
                at = found.argmax(axis=0)
                value = found[at, np.arange(n)]
                better = (value > score) | ((value == score) & (value > 0) & (seeds[at] < seed))
                score, seed = np.where(better, value, score), np.where(better, seeds[at], seed)
            del shard
            ids = np.array(part.column("id").fill_null(1), np.int64)
            own = np.array(part.column("id").is_valid()) & (ids % every == 0)
            seed, none = np.where(own, ids, seed), ~own & (score == 0)
            texts = [b.decode("utf-8") for b in bodies]
            del bodies
            raw = [x + end for x in enc.raw(texts)]
            yield pa.RecordBatch.from_arrays([
                part.column("id").combine_chunks(), part.column("place").combine_chunks(), pa.array(seed, mask=none),
                pa.array(np.where(own, np.inf, np.round(score, 4)).astype(np.float64)), pa.array(raw, pa.binary()),
            ], ["id", "place", "seed", "score", "ids"])
        C.trim()

    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.mapInArrow(best, "id long, place long, seed long, score double, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): every piece of every document; ids as unsigned 32-bit.

    Each document is its ids and end_id. Null text: the end id alone. Null and repeated ids are documents of their own
    (repeated ones can't be told apart in the result); of repeated seeds the least text asks. Without seeds, and for what no
    seed finds, documents are in the order of their ids. No rows: no pieces. A task fills the windows of some seeds, or of a
    part of one that finds much, and numbers them from (task << 32); only a task's last windows are shorter, and their
    lengths are powers of two, so nothing is padded.
    """
    routed = C.settle(route(docs, tokenizer, end_id, every, id_col, text_col), "routed")
    n = C.groups(C.text_bytes(routed, "ids"), FILL_BYTES)
    order = [F.col("seed").asc_nulls_last(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("place")]
    rows = routed.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        base, kind = TaskContext.get().partitionId() << 32, encoder(tokenizer).dtype
        held: dict[int, tuple] = {}

        def documents():
            n = 0
            for batch in batches:
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[n] = key, raw
                    yield n, len(raw) // kind.itemsize
                    n += 1

        made, size, last = [], 0, -1
        for d, start, length, sequence, offset in fill(documents(), window):
            if sequence != last:  # documents before the first of a new window are done
                for x in [x for x in held if x < d]:
                    del held[x]
                last = sequence
            key, raw = held[d]
            ids = np.frombuffer(raw, kind, length, start * kind.itemsize).astype("<u4").tobytes()
            made.append((key, start, length, len(raw) // kind.itemsize, base + sequence, offset, ids))
            size += len(ids)
            if size > 2 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PIECES, strict=True)], schema=_PIECES)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return rows.select("id", "ids").mapInArrow(pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
