"""Packing by lexical retrieval.

Documents are tokenised once, a block of texts at a time and each new piece of a block once, and stored. The BM25
statistics, document frequency of each token, number and mean length of documents, are taken over the whole corpus;
they are as many numbers as the vocabulary has entries. Each document is routed by its rarest token that another document has too, so documents with rare words in common meet; the routes, in
order, are cut into index shards of about ``SHARD_TOKENS`` tokens, and a route that is larger than a shard is spread over
several by a hash, so no task holds more than a shard. In a shard an inverted index of BM25 weights returns, for the
document that opens a window, its best unused neighbours, which fill the window greedily; the one that no longer fits is
cut, and its rest opens the next window. Without neighbours the next unused document follows. So every window but the
last of a shard is full, every token lies in one piece, and a document longer than a window fills windows of its own.

Defined results: null text is the end token alone; rows that repeat are packed each on its own; ties of score go to the
smaller doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from marketlens.llm.bpe import Bpe, byte_symbols
from marketlens.llm.common import staged, text_key, whole_text

WINDOW, END, SHARD_TOKENS = 2048, 1, 4_000_000
#: Bytes of text that are tokenised together, and pieces that the library is given at a time.
BLOCK, CALL = 8 << 20, 1000
#: Units whose ids a worker keeps, twice over, and the most bytes of one.
KEPT_UNITS, KEPT_BYTES = 500_000, 64
#: Kinds of bytes; one of the last two is a unit by itself. A chunk with a byte of the kind WHOLE is cut by the file's pattern. No text in UTF-8 holds STOPS.
SPACE, LETTER, SIGN, WHOLE, DIGIT, STOP = range(6)
STOPS = b"\xff"
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: A token in one of so many documents of a shard has a row with a weight (four bytes) for each of them.
FREQUENT = 8
#: The best neighbours are sorted out so many at a time; a window seldom takes more.
BEST = 32
#: An index leaves used documents out again when they are this share of it.
USED_SHARE = 0.03
ID = np.dtype("<u2")


class LibraryBpe(Bpe):
    """Pieces are tokenised by the library's own model, each distinct one of a block of texts once; ids are kept as bytes, 16 bits each."""

    def __init__(self, path: str):
        super().__init__(path)
        if max(self.strings) >= 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.library = Tokenizer(Tokenizer.from_file(path).model)
        self.library.pre_tokenizer = CharDelimiterSplit("\n")
        self.last_of_piece = np.zeros(1 << 16, bool)  # pieces hold letters, a digit or signs, so no other id ends in the suffix
        self.last_of_piece[[i for i, s in self.strings.items() if s.endswith(self.library.model.end_of_word_suffix)]] = True
        self.symbols = {b: s for b, s in byte_symbols().items() if b != ord("\n")}
        self.fixed = {s.encode(): np.array([i], ID).tobytes() for s, i in self.special.items()} | {STOPS: np.array([END], ID).tobytes()}
        self.kept, self.older = dict(self.fixed), {}
        whole = "'" + "".join(sorted({s[0] for s in self.special}))
        self.kind = np.full(256, SIGN, np.uint8)
        for kind, some in ((SPACE, b"\t\n\v\f\r "), (LETTER, string.ascii_letters.encode()), (WHOLE, whole.encode() + bytes(range(128, 255))), (DIGIT, string.digits.encode()), (STOP, STOPS)):
            self.kind[list(some)] = kind
        self.odd = re.compile(b"[\x80-\xfe" + re.escape(whole.encode()) + b"]")

    def packed(self, text: str) -> bytes:
        """Ids of a text."""
        return self.texts([text.encode()])[0].as_py()[: -ID.itemsize]

    def tokenised(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        made = []
        for n in range(0, len(pieces), CALL):
            some = pieces[n : n + CALL]
            got = self.library.encode_batch_fast([b"\n".join(some).decode("latin-1").translate(self.symbols)])[0]
            ids = np.array(got.ids, ID)
            ends, ids = (np.flatnonzero(self.last_of_piece[ids]) + 1) * ID.itemsize, ids.tobytes()
            made += [ids[a:b] for a, b in pairwise([0, *ends.tolist()])]
        return made

    def cut_unit(self, unit: bytes) -> list[bytes]:
        """Pieces and special tokens of a chunk."""
        text = unit.decode()
        chunks = [text] if text.rstrip(",.").isalpha() else self.split(text)
        return [p.encode() for c in chunks for p in ([c] if c in self.special else self.cut_chunk(c))]

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit: a piece, or a chunk that is yet to be cut. Those of earlier blocks are kept."""
        made = list(map(self.kept.get, units))
        missing = [n for n, ids in enumerate(made) if ids is None]
        if len(self.kept) + len(missing) > KEPT_UNITS:
            self.kept, self.older = dict(self.fixed), self.kept
        new = [units[n] for n in missing]
        known = {u: self.older[u] for u in new if u in self.older}
        cut = {u: self.cut_unit(u) if self.odd.search(u) else [u] for u in new if u not in known}
        pieces = list(set().union(*cut.values()).difference(self.fixed))
        ids_of = self.fixed | dict(zip(pieces, self.tokenised(pieces), strict=True))
        known |= {u: b"".join([ids_of[p] for p in some]) for u, some in cut.items()}
        for n, u in zip(missing, new, strict=True):
            made[n] = known[u]
        self.kept.update([(u, ids) for u, ids in known.items() if len(u) <= KEPT_BYTES])
        return made

    def texts(self, texts: list[bytes]) -> pa.Array:
        """Ids of each text, the end token last. Chunks of plain ASCII are cut into pieces on the bytes of all texts; others are cut once each."""
        data = np.frombuffer(STOPS.join([*texts, b""]), np.uint8)
        kind = self.kind[data]
        at = np.flatnonzero((np.append(True, kind[1:] != kind[:-1]) | (kind >= DIGIT)) & (kind != SPACE))
        own, before = kind[at], kind[at - 1]
        opens = (before == SPACE) | (before == STOP) | (own == STOP)
        whole = np.logical_or.reduceat(own == WHOLE, np.flatnonzero(opens))[np.cumsum(opens) - 1]
        stays = opens | ~whole
        at, whole = at[stays], whole[stays]
        filled = kind != SPACE
        begin = at - np.cumsum(~filled, dtype=np.int32)[at]
        data = data[filled]
        data = np.where(np.repeat(whole, np.diff(begin, append=len(data))), data, LOWER[data])
        units = _binary(np.append(begin, len(data)), data).dictionary_encode()
        ids = pa.array(self.units(_listed(units.dictionary)), pa.binary()).take(units.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int32)
        return _binary(np.append(0, offsets[np.flatnonzero(kind[at] == STOP) + 1]), ids.buffers()[2])


def _binary(offsets: np.ndarray, data: np.ndarray | pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _listed(values: pa.Array) -> list[bytes]:
    """What to_pylist returns for an array of ``_binary`` or of its dictionary."""
    _, offsets, data = values.buffers()
    data = data.to_pybytes()
    return [data[a:b] for a, b in pairwise(np.frombuffer(offsets, np.int32)[: len(values) + 1].tolist())]


@lru_cache(maxsize=4)
def coder(path: str) -> LibraryBpe:
    """One per worker process, which is a core's: the library starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryBpe(path)


def _blocks(sizes: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes, or one row and so many."""
    number = np.cumsum(sizes, dtype=np.int64) // most
    if len(sizes):
        yield from pairwise([0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)])


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Stored: doc_id, key, u in [0, 1), ids (16 bits each, the end token last), terms (the distinct ids)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in rows:
            for begin, end in _blocks(pc.binary_length(batch.column("text")).to_numpy()):
                some = batch.slice(begin, end - begin)
                ids = bpe.texts(some.column("text").cast(pa.large_binary()).to_pylist())
                terms = [x.astype(ID).tobytes() for x in _counted([np.frombuffer(x, ID) for x in _listed(ids)])[0]]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("doc_id", "key", "u")], ids, pa.array(terms, pa.binary())], ["doc_id", "key", "u", "ids", "terms"])

    part = (F.shiftrightunsigned(F.xxhash64("doc_id", text_key(), F.lit(3)), 11) * F.lit(2.0**-53)).alias("u")
    rows = docs.select("doc_id", text_key().alias("key"), part, whole_text().alias("text"))
    return staged(rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, u double, ids binary, terms binary"), "tokens", compression="zstd")


def _frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        seen = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), ID), minlength=1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])


def _table(counts: DataFrame, size: int) -> np.ndarray:
    """(term, n) rows, at most one per vocabulary entry, as an array."""
    got = counts.toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def _routes(terms: list[bytes], frequency: np.ndarray) -> np.ndarray:
    """The rarest term of each document that another document has too, else its rarest."""
    rare = np.where(frequency > 1, frequency, frequency.max() + 1)
    out = np.empty(len(terms), np.int64)
    for n, t in enumerate(terms):
        ids = np.frombuffer(t, ID)
        out[n] = ids[np.argmin(rare[ids])]
    return out


def _counted(ids: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each document the distinct ids in order, and how often each occurs."""
    seen, place = np.zeros(1 << 16, bool), np.empty(1 << 16, np.int64)
    for x in ids:
        seen[x] = True
    present = np.flatnonzero(seen)
    place[present] = np.arange(len(present))
    terms, counts = [], []
    for x in ids:
        times = np.bincount(place[x], minlength=len(present))
        at = np.flatnonzero(times)
        terms.append(present[at])
        counts.append(times[at])
    return terms, counts


class Index:
    """BM25 weights of the documents of one shard, by document and by token; ``names`` are the documents still in it, in order."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = _counted(ids)
        n = np.array([len(t) for t in terms])
        self.first = np.append(0, np.cumsum(n))
        self.terms = np.concatenate(terms)
        doc = np.repeat(np.arange(len(ids)), n)
        tf = np.concatenate(counts).astype(np.float64)
        size = np.array([len(x) for x in ids], float)[doc]
        weight = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        frequent = np.flatnonzero(np.bincount(self.terms, minlength=len(idf)) * FREQUENT >= max(len(ids), FREQUENT))
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(ids)), np.float32)
        row = self.row[self.terms]
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.docs, self.weights = doc[rare], weight[rare]
        self.begin = np.searchsorted(self.terms[rare], np.arange(len(idf) + 1))
        self.names = np.arange(len(ids))

    def forget(self, unused: np.ndarray) -> None:
        """Leave used documents out. The others keep their order and their scores."""
        stays = unused[self.names]
        kept, number = np.flatnonzero(stays), np.cumsum(stays) - 1
        posting = stays[self.docs]
        self.begin = np.append(0, np.cumsum(posting))[self.begin]
        self.docs, self.weights = number[self.docs[posting]], self.weights[posting]
        self.rows, self.names = np.take(self.rows, kept, axis=1), self.names[kept]

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a token of ``doc``, best first. All its tokens are asked."""
        return np.fromiter(self.best_first(doc, unused), np.int64)

    def best_first(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """What ``neighbours`` returns, sorted only as far as it is asked for."""
        terms = self.terms[self.first[doc] : self.first[doc + 1]]
        row = self.row[terms]
        scores = self.rows[row[row >= 0]].sum(axis=0).astype(float)
        terms = terms[row < 0]
        begin, end = self.begin[terms], self.begin[terms + 1]
        spans = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if a < b]
        if spans:
            docs, weights = (np.concatenate([x[span] for span in spans]) for x in (self.docs, self.weights))
            scores += np.bincount(docs, weights, minlength=len(scores))
        found = np.flatnonzero((scores > 0) & unused[self.names])
        distance = -scores[found]
        while len(found):
            best = np.arange(len(found))
            if len(found) > BEST:
                best = np.flatnonzero(distance <= np.partition(distance, BEST - 1)[BEST - 1])
            yield from self.names[found[best[np.argsort(distance[best], kind="stable")]]].tolist()
            found, distance = np.delete(found, best), np.delete(distance, best)


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of one shard."""
    index = Index(ids, idf, mean)
    unused = np.ones(len(ids), bool)
    left_in = len(ids)
    sequence, offset, following = 0, 0, 0
    waiting: Iterator[int] = iter(())
    for n in range(len(ids)):
        doc = next((d for d in waiting if unused[d]), None)
        if doc is None:
            while not unused[following]:
                following += 1
            doc = following
        unused[doc] = False
        start, left, opened = 0, len(ids[doc]), offset == 0
        while left:
            piece = min(left, window - offset)
            yield doc, start, piece, sequence, offset
            start, left, offset = start + piece, left - piece, offset + piece
            if offset == window:
                sequence, offset, opened = sequence + 1, 0, True
        if opened:  # the document opens the window that is being filled
            waiting = index.best_first(doc, unused) if offset else iter(())
            if left_in - (len(ids) - n - 1) > USED_SHARE * left_in:
                index.forget(unused)
                left_in = len(ids) - n - 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenised(docs, path)
    total = tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("ids") / ID.itemsize), F.lit(0.0)).alias("tokens")).first()
    size = 1 << 16
    frequency = _table(tokens.select("terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), size)
    mean, idf = total["tokens"] / max(total["docs"], 1), np.log1p((total["docs"] - frequency + 0.5) / (frequency + 0.5))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def routed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.column("n").to_numpy()
            of = _routes(batch.column("terms").to_pylist(), frequency)
            sums = np.bincount(of, n)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at].astype(np.int64))], ["term", "n"])

    length = (F.octet_length("ids") / ID.itemsize).cast("long").alias("n")
    held = _table(tokens.select("terms", length).mapInArrow(routed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), size)
    before = np.cumsum(held) - held

    def sharded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            of = _routes(batch.column("terms").to_pylist(), frequency)
            shard = ((before[of] + batch.column("u").to_numpy() * held[of]) // shard_tokens).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[batch.column(c) for c in ("doc_id", "key", "ids")]], ["shard", "doc_id", "key", "ids"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        ids = [np.frombuffer(x, ID) for x in table.column("ids").to_pylist()]
        pieces = list(fill(ids, idf, mean, window))
        doc, start, count, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        lengths = np.array([len(x) for x in ids], np.int64)
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(doc)), "start": start, "length": count, "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": lengths[doc], "sequence_id": sequence + (shard << 32), "offset": offset,
        })

    placed = tokens.mapInArrow(sharded, f"shard long, doc_id {id_type}, key long, ids binary")
    return placed.groupBy("shard").applyInArrow(packed, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
