"""Byte-pair encoding with word ends, and decoding, of the public tokenizer file of that kind.

A text is cut into chunks at white space, a chunk into pieces by the file's pattern, a piece into byte symbols of which
the last carries the word end. The merges of a piece are applied from a priority queue of merge ranks over a doubly
linked list of symbols; entries whose symbols have changed since are stale and skipped. Chunks repeat, so the result of
a chunk is kept in a bounded cache of the worker process. Decoding joins the vocabulary strings of the ids by one space,
which is what the library does for a file without decoder.

Defined results: null counts as empty, an empty text has no ids and decodes to the empty text; texts of any length are
encoded whole; rows that repeat are encoded alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import whole_text

#: Fixed values of the file's format: white space, the pattern of pieces, white space of str.split that is none there.
SPACE = "\t-\r \x85\xa0  -     　"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LOW_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile(f"[^{SPACE}]+")

#: Chunks and pieces whose results a worker keeps, twice over: the newest generation and the one before.
KEPT_CHUNKS, KEPT_PIECES = 350_000, 250_000


def byte_symbols() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Generations(dict):
    """key -> made(key), for the keys of the newest generation and those of the one before: bounded, and frequent keys stay."""

    def __init__(self, made: Callable[[str], object], limit: int):
        super().__init__()
        self.made, self.limit, self.older = made, limit, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.made(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Bpe:
    """Vocabulary, merge ranks and special tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a.removesuffix(end) + b if end else a + b]
        symbols = byte_symbols()
        self.inner = [vocab[symbols[b]] for b in range(256)]
        self.last = [vocab[symbols[b] + end] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = {s[:2] for s in self.special}
        self.pieces = Generations(self._merged, KEPT_PIECES)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until no pair has a rank."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j == n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _merged(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self.merge(ids) if len(ids) > 1 else ids

    @staticmethod
    def cut_chunk(chunk: str) -> list[str]:
        """Pieces of a text without white space and special tokens, normalised."""
        if chunk.isascii():
            low, pieces = chunk.lower(), LOW_ASCII_PIECE
        else:
            low, pieces = "".join(map(str.lower, unicodedata.normalize("NFC", chunk))), PIECE
        if low.isalpha():
            return [low]
        if low[-1] in ",." and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return pieces.findall(low)

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space and special tokens."""
        ids: list[int] = []
        for piece in self.cut_chunk(chunk):
            ids += self.pieces[piece]
        return ids

    def split(self, text: str) -> list[str]:
        """Chunks and special tokens, in order."""
        if self.cut and any(m in text for m in self.marks):
            return [c for part in self.cut.split(text) for c in ([part] if part in self.special else self._chunks(part))]
        return self._chunks(text)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return CHUNKS.findall(text) if SEPARATORS.search(text) else text.split()


    def keyed(self, chunk: str) -> list[int]:
        """Ids of what ``split`` gives."""
        special = self.special.get(chunk)
        return self.chunk(chunk) if special is None else [special]


@lru_cache(maxsize=4)
def coder(path: str) -> tuple[Bpe, Generations]:
    """One per worker process: pairs of decimal ids and vocabulary strings, each joined by one space."""
    bpe = Bpe(path)
    strings = bpe.strings

    def printed(chunk: str) -> tuple[str, str]:
        ids = bpe.keyed(chunk)
        return " ".join(map(str, ids)), " ".join([strings[i] for i in ids])

    return bpe, Generations(printed, KEPT_CHUNKS)


def decode(bpe: Bpe, ids: list[int]) -> str:
    return " ".join([bpe.strings[i] for i in ids])


def encode(bpe: Bpe, text: str) -> list[int]:
    return [i for c in bpe.split(text) for i in bpe.keyed(c)]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Per row doc_id, ids and decoded: decimal ids joined by one space, and the decoded text."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = coder(path)
        for batch in rows:
            made = [[cache[c] for c in bpe.split(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([" ".join([m[0] for m in x]) for x in made], pa.large_string()),
                 pa.array([" ".join([m[1] for m in x]) for x in made], pa.large_string())], ["doc_id", "ids", "decoded"])

    return _with_text(docs).mapInArrow(batches, f"doc_id {_id_type(docs)}, ids string, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded text, without sending either back."""

    def sha(parts: list[str]) -> str:
        return hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = coder(path)
        for batch in rows:
            n, ids, decoded = [], [], []
            for text in batch.column("text"):
                made = [cache[c] for c in bpe.split(text.as_py())]
                ids.append(sha([m[0] for m in made]))
                decoded.append(sha([m[1] for m in made]))
                n.append(sum([m[0].count(" ") for m in made]) + len(made))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _with_text(docs).mapInArrow(batches, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), whole_text().alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
