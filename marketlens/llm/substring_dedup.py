"""Substring de-duplication over super-k-mers.

A window is 20 consecutive words of a document. Each window has a minimiser, the smallest hash of its runs of 3 words;
consecutive windows that share it form a super-k-mer, which travels once, as one packed string, to the bucket of its
minimiser, compressed together with those of its batch that go there too. Equal windows have equal minimisers, so they meet in one bucket, where sorting the windows by a 128-bit hash
of their words, ties in document order, counts them exactly and names the first of each. All others mark their words.
Inside a task a super-k-mer that repeats an earlier one of its batch is decided at once and not sent, so a passage that
many documents share travels once per batch. The bytes that would go out are first summed by slot of the minimiser's hash;
where a slot alone would overfill a bucket (a frequent line in ever new contexts), its windows travel one by one, as their
hashes, to the bucket of the whole window, so equal windows still meet and the group splits. Marks come back as word ranges, are joined with their documents, and the
words that are covered are cut.

Order is (doc_id, hash of the text, start), a null doc_id last; ids of any type that sorts will do. Defined results: null text has no words; a text of fewer
than 20 words has no window and stays; rows that repeat doc_id and text are one document and get the same result; an
empty table gives an empty result; further columns are ignored by ``cut_words`` and returned unchanged by ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from marketlens.llm.common import staged, text_key, whole_text
from marketlens.llm.wordhash import LONGEST_WINDOW, U, Words, blocks, buffers, mix, words_of

WINDOW, RUN = 20, 3
#: Windows of a super-k-mer at most: one over repetitive words is cut, so that its hashes keep their strength.
MOST_WINDOWS = LONGEST_WINDOW // 2
#: Packed bytes a bucket is planned for: super-k-mers are about three times as long as the texts.
BUCKET_BYTES, PACKED = 4 << 20, 3
#: Bytes of text that a task packs at once.
BATCH_BYTES = 4 << 20
#: Slots per bucket in which the bytes of minimisers are summed.
SLOTS = 64
NO_ID = (1 << 63) - 1

HASHED = ("id", "key", "start", "a", "b")
COLUMNS = ("id", "key", "start", "windows")
SUPER = "bucket long, packed binary"
RANGES = "id long, key long, start long, stop long"


def _minimisers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the minimiser of each."""
    n = len(words.h)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = mix(words.windows(np.arange(n - RUN + 1), RUN))
    width, have = WINDOW - RUN + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    starts = np.arange(n - WINDOW + 1)
    doc = np.searchsorted(words.first, starts, side="right") - 1
    whole = starts + WINDOW <= words.first[doc + 1]
    return starts[whole], low[: len(starts)][whole]


def super_kmers(texts: pa.Array, ids: np.ndarray, keys: np.ndarray, hot: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Per block of texts: minimiser, id, key, start (word in its document), windows, two hashes, byte range and data.

    With ``hot``, a flag per slot: which lie in a hot slot, and of their windows the super-k-mer, place in it and hashes.
    """
    for begin, stop in blocks(texts):
        words = words_of(texts.slice(begin, stop - begin))
        starts, low = _minimisers(words)
        if not len(starts):
            continue
        doc = np.searchsorted(words.first, starts, side="right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        place = np.arange(len(starts))
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST_WINDOWS == 0
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(starts)))
        at, span = starts[head], count + WINDOW - 1
        split = np.zeros(len(head), bool) if hot is None else hot[(low[head] % U(len(hot))).astype(np.int64)]
        of = np.repeat(np.flatnonzero(split), count[split])
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
        each = at[of] + inside
        yield {
            "split": split, "of": of, "inside": inside, "of_a": words.windows(each, WINDOW), "of_b": words.windows(each, WINDOW, second=True),
            "low": low[head], "id": ids[begin + doc[head]], "key": keys[begin + doc[head]], "start": at - words.first[doc[head]], "windows": count,
            "a": words.windows(at, span), "b": words.windows(at, span, second=True), "from": words.start[at], "to": words.end[at + span - 1], "data": words.data,
        }


def _first_of_equal(order: np.ndarray, a: np.ndarray, b: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
    """For items sorted by (a, b, place): True where the item has the place of the first item equal to it."""
    sa, sb = a[order], b[order]
    head = np.ones(len(order), bool)
    head[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    leader = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    same = np.ones(len(order), bool)
    for column in place:
        sorted_ = column[order]
        same &= sorted_ == sorted_[leader]
    first = np.empty(len(order), bool)
    first[order] = same
    return first


def _packed(rows: dict[str, np.ndarray], texts: list[bytes], hashed: dict[str, np.ndarray]) -> bytes:
    """Super-k-mers and single windows of one batch and bucket as one string: columns, then words, compressed together."""
    head = [np.array([len(texts), len(hashed["a"])], "<i8"), *[rows[c].astype("<i8") for c in COLUMNS], np.array([len(t) for t in texts], "<i8")]
    head += [hashed[c].astype(U if c in "ab" else "<i8") for c in HASHED]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*[h.tobytes() for h in head], *texts]))


def _unpacked(blobs: pa.ChunkedArray) -> tuple[dict[str, np.ndarray], pa.Array, dict[str, np.ndarray]]:
    """Columns and words of all super-k-mers of a bucket, those that travel without words have empty ones; its single windows."""
    columns: dict[str, list[np.ndarray]] = {c: [] for c in (*COLUMNS, "size")}
    singles: dict[str, list[np.ndarray]] = {c: [] for c in HASHED}
    texts = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        for column in columns.values():
            column.append(np.frombuffer(raw, "<i8", n, at))
            at += 8 * n
        for name, column in singles.items():
            column.append(np.frombuffer(raw, U if name in "ab" else "<i8", m, at))
            at += 8 * m
        texts.append(raw[at:])
    joined = {c: np.concatenate(v) for c, v in columns.items()}
    offsets = np.append(0, np.cumsum(joined["size"])).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])
    return joined, words, {c: np.concatenate(v) for c, v in singles.items()}


def _collapsed(rows: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[tuple[list[dict], dict[str, np.ndarray], np.ndarray]]:
    """Per batch, in document order: blocks of super-k-mers, their columns joined, and which do not repeat an earlier one."""
    parts_of = (whole.slice(begin, stop - begin) for whole in rows for begin, stop in blocks(whole.column("text"), BATCH_BYTES))
    for batch in parts_of:
        ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
        order = np.lexsort((keys, ids))
        texts = batch.column("text").take(pa.array(order))
        parts = list(super_kmers(texts, ids[order], keys[order], hot))
        if not parts:
            continue
        whole = {c: np.concatenate([p[c] for p in parts]) for c in ("low", "a", "b", "split", "from", "to", *COLUMNS)}
        yield parts, whole, _first_of_equal(np.lexsort((np.arange(len(whole["a"])), whole["b"], whole["a"])), whole["a"], whole["b"], [whole[c] for c in ("id", "key", "start")])


def _slot_bytes(rows: Iterator[pa.RecordBatch], slots: int, share: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Bytes of words that would go out, by slot of the minimiser, where they are at least ``share`` of the text bytes of the task.

    What tasks leave out of a slot is less than ``share`` of all text bytes together.
    """
    total, read = np.zeros(slots, np.int64), 0

    def counted() -> Iterator[pa.RecordBatch]:
        nonlocal read
        for batch in rows:
            read += int(buffers(batch.column("text"))[1][-1])
            yield batch

    for _, whole, first in _collapsed(counted()):
        np.add.at(total, (whole["low"][first] % U(slots)).astype(np.int64), (whole["to"] - whole["from"])[first])
    at = np.flatnonzero((total > 0) & (total >= share * read))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _single_windows(parts: list[dict], whole: dict[str, np.ndarray], first: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Windows of the hot slots: those to be sent, and runs of those that repeat an earlier one of the batch."""
    before = np.cumsum([0, *[len(p["low"]) for p in parts]])
    of = np.concatenate([p["of"] + n for p, n in zip(parts, before, strict=False)])
    inside, a, b = (np.concatenate([p[c] for p in parts]) for c in ("inside", "of_a", "of_b"))
    sent = first[of]
    of, inside, a, b = of[sent], inside[sent], a[sent], b[sent]
    each = {"id": whole["id"][of], "key": whole["key"][of], "start": whole["start"][of] + inside, "a": a, "b": b}
    new = _first_of_equal(np.lexsort((np.arange(len(a)), b, a)), a, b, [each[c] for c in ("id", "key", "start")])
    again = np.flatnonzero(~new)
    head = np.flatnonzero(np.append(True, (np.diff(again) > 1) | (of[again[1:]] != of[again[:-1]]))[: len(again)])
    runs = {c: v[again[head]] for c, v in each.items()} | {"windows": np.diff(np.append(head, len(again)))}
    return {c: v[new] for c, v in each.items()}, runs


def _sent(rows: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of each batch, one string per bucket; one that repeats an earlier one goes without its words."""
    flags = None
    if hot is not None and len(hot):
        flags = np.zeros(buckets * SLOTS, bool)
        flags[hot] = True
    for parts, whole, first in _collapsed(rows, flags):
        singles, runs = _single_windows(parts, whole, first)
        packed: list[bytes] = []
        for p in parts:
            raw = p["data"].tobytes()
            packed += [raw[s:e] for s, e in zip(p["from"].tolist(), p["to"].tolist(), strict=True)]
        # what is decided already goes to any bucket, evenly
        evenly = lambda x: x["a"] ^ mix(x["key"].astype(U) + x["start"].astype(U))
        stay = np.flatnonzero(~(first & whole["split"]))
        texts = [packed[i] if first[i] else b"" for i in stay.tolist()] + [b""] * len(runs["a"])
        low = np.concatenate([np.where(first, whole["low"], evenly(whole))[stay], evenly(runs)])
        columns = {c: np.concatenate([whole[c][stay], runs[c]]) for c in COLUMNS}
        bucket, single = (low % U(buckets)).astype(np.int64), (singles["a"] % U(buckets)).astype(np.int64)
        order, order_single = np.argsort(bucket, kind="stable"), np.argsort(single, kind="stable")
        used = np.union1d(bucket, single)
        blobs = [
            _packed({c: v[at] for c, v in columns.items()}, [texts[i] for i in at.tolist()], {c: v[at_single] for c, v in singles.items()})
            for at, at_single in zip(np.split(order, np.searchsorted(bucket[order], used[1:])), np.split(order_single, np.searchsorted(single[order_single], used[1:])), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], ["bucket", "packed"])


def _decided(table: pa.Table) -> pa.Table:
    """Word ranges of one bucket that repeat an earlier window."""
    rows, texts, singles = _unpacked(table.column("packed"))
    id_, key, start = (np.concatenate([rows[c], singles[c]]) for c in ("id", "key", "start"))
    windows, size = rows["windows"], rows["size"]
    known = np.flatnonzero(size == 0)
    out = [(id_[known], key[known], start[known], start[known] + windows[known] + WINDOW - 1)]
    if len(known) < len(id_):
        rank = np.empty(len(id_), np.int64)
        rank[np.lexsort((start, key, id_))] = np.arange(len(id_))
        words = words_of(texts)
        count = np.where(size == 0, 0, windows)
        of = np.repeat(np.arange(len(size)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = words.first[:-1][of] + inside
        a, b = np.append(words.windows(at, WINDOW), singles["a"]), np.append(words.windows(at, WINDOW, second=True), singles["b"])
        of, inside = np.append(of, np.arange(len(size), len(id_))), np.append(inside, np.zeros(len(singles["a"]), np.int64))
        place = [id_[of], key[of], start[of] + inside]
        first = _first_of_equal(np.lexsort(((rank[of] << 32) + inside, b, a)), a, b, place)
        again = np.flatnonzero(~first)
        if len(again):
            new = np.ones(len(again), bool)
            new[1:] = (again[1:] != again[:-1] + 1) | (of[again[1:]] != of[again[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(again)) - 1
            out.append((place[0][again[head]], place[1][again[head]], place[2][again[head]], place[2][again[tail]] + WINDOW))
    return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("id", "key", "start", "stop"))})


def numbered(docs: DataFrame) -> DataFrame:
    """Adds _id, a whole number in the order of doc_id, null last. Whole numbers are taken as they are, all other ids are sorted and numbered."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        ends = docs.agg(F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("n")).first()
        if ends["top"] != NO_ID or not ends["n"]:
            return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    ids = docs.select(F.col("doc_id").alias("_of")).filter("_of is not null").distinct().repartitionByRange("_of").sortWithinPartitions("_of")
    order = staged(ids.select("_of", F.monotonically_increasing_id().alias("_id")), "ids")
    return docs.join(order, docs["doc_id"] == order["_of"], "left").drop("_of").withColumn("_id", F.coalesce("_id", F.lit(NO_ID)))


def repeated_ranges(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, key, ranges: array<struct<start, stop>> of words, per document with a window that came earlier; id as ``numbered`` gives it."""
    docs = docs if "_id" in docs.columns else numbered(docs)
    rows = docs.select(F.col("_id").alias("id"), text_key().alias("key"), whole_text().alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()[0]
    buckets = max(1, -(-total * PACKED // bucket_bytes))
    hot = None
    if buckets > 1:
        # a slot of bucket_bytes in all has at least half of them in tasks that name it
        slots, share = buckets * SLOTS, bucket_bytes / 2 / total
        bytes_ = rows.mapInArrow(lambda batches: _slot_bytes(batches, slots, share), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        hot = bytes_.filter(F.col("n") >= bucket_bytes // 2).select("slot").toArrow().column("slot").to_numpy()
    sent = rows.mapInArrow(lambda batches: _sent(batches, buckets, hot), SUPER)
    marks = sent.groupBy("bucket").applyInArrow(_decided, RANGES)
    return staged(marks, "marks").groupBy("id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _cut(text: str, ranges: list[dict]) -> tuple[int, list[bytes]]:
    """Number of words, and those outside the ranges."""
    words = text.encode("utf-8").split()
    kept: list[bytes] = []
    done = 0
    for start, stop in _merged(ranges):
        kept += words[done:start]
        done = stop
    return len(words), kept + words[done:]


def _with_ranges(docs: DataFrame) -> DataFrame:
    known = numbered(docs)
    ranges = repeated_ranges(known)
    return known.join(ranges, (known["_id"] == ranges["id"]) & (text_key() == ranges["key"]), "left").drop(ranges["id"], ranges["key"])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by one space."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, removed, sha = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words, kept = _cut(text.as_py(), ranges.as_py())
                n.append(words)
                removed.append(words - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_ranges(docs.select("doc_id", whole_text().alias("text")))
    return joined.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def apply(docs: DataFrame) -> DataFrame:
    """The documents with repeated words cut: the words left, joined by one space, and n_chars of them. Others as they came."""

    @F.arrow_udf("string")
    def left(text: pa.Array, ranges: pa.Array) -> pa.Array:
        cut = [None if r is None else b" ".join(_cut(t, r)[1]).decode("utf-8") for t, r in zip(text.to_pylist(), ranges.to_pylist(), strict=True)]
        return pa.array(cut, pa.string())

    plain = docs.withColumn("_struct", F.struct("*")).select("doc_id", "text", F.col("_struct").alias("_row"))
    cut = _with_ranges(plain).withColumn("_new", left(whole_text(), F.col("ranges")))

    def column(name: str):
        kept = F.col("_row").getField(name)
        changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast(docs.schema[name].dataType)}.get(name)
        return (kept if changed is None else F.when(F.col("_new").isNotNull(), changed).otherwise(kept)).alias(name)

    return cut.select(*[column(c) for c in docs.columns])
