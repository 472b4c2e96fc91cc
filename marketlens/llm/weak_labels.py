"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of
vote patterns, at most 3 to the number of labellers, estimates the share of good documents and each labeller's accuracy
on good and on bad ones, without labels. The posterior of each pattern is the soft label of its documents. A hashed
linear scorer (logistic regression on hashed words and word pairs) is trained on the posteriors of a bounded sample, the
``SAMPLE`` documents with the smallest seeded hash, and scores every document.

Defined results: null text has no words: no features, the votes of an empty text and the bias as score; a pattern that
gives no vote has the share of good documents as posterior; rows that repeat score alike; an empty table gives an empty
result and trains nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import staged, text_key, whole_text
from marketlens.llm.wordhash import U, blocks, mix, words_of

#: Documents of the training sample, hashed features, passes over the sample, posterior and score from which to keep.
SAMPLE, FEATURES, PASSES, KEEP = 8_000, 1 << 17, 12, 0.5
GOOD, BAD, NONE = 2, 0, 1
#: Characters that stand for mark-up and tables.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def measures(texts: pa.Array) -> tuple[dict[str, np.ndarray], "object"]:
    """Measures per text of one block, and its words."""
    words = words_of(texts)
    first, n = words.first, np.diff(words.first)
    data = words.data

    def share(flag: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flag))
        begin, stop = _byte_range(words)
        return (sums[stop] - sums[begin]) / np.maximum(stop - begin, 1)

    def per_word(flag: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flag))
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)

    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.h, of))
    new = np.ones(len(order), bool)
    new[1:] = (words.h[order][1:] != words.h[order][:-1]) | (of[order][1:] != of[order][:-1])
    ends = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    return {
        "n": n, "length": per_word(words.end - words.start), "symbols": share(np.isin(data, SYMBOLS)), "capitals": share((data >= 65) & (data <= 90)),
        "distinct": np.bincount(of[order][new], minlength=len(n)) / np.maximum(n, 1), "stops": per_word((ends == 46) | (ends == 33) | (ends == 63)),
        "digits": share((data >= 48) & (data <= 57)),
    }, words


def _byte_range(words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from the first to the last word of each text."""
    has = np.diff(words.first) > 0
    begin, stop = np.zeros(len(has), np.int64), np.zeros(len(has), np.int64)
    begin[has], stop[has] = words.start[words.first[:-1][has]], words.end[words.first[1:][has] - 1]
    return begin, stop


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller: good, bad or nothing."""
    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    return np.stack([
        vote((m["n"] >= 30) & (m["n"] <= 50_000), m["n"] < 10),
        vote((m["length"] >= 3) & (m["length"] <= 9), (m["length"] < 2) | (m["length"] > 12)),
        vote(m["symbols"] <= 0.002, m["symbols"] > 0.02),
        vote((m["capitals"] >= 0.002) & (m["capitals"] <= 0.08), m["capitals"] > 0.2),
        vote(m["distinct"] >= 0.3, (m["distinct"] < 0.15) & (m["n"] >= 20)),
        vote((m["stops"] >= 0.02) & (m["stops"] <= 0.4), (m["stops"] > 0.6) | ((m["stops"] == 0) & (m["n"] >= 40))),
        vote(m["digits"] <= 0.05, m["digits"] > 0.2),
    ], axis=1)


LABELLERS = 7


def _voted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scale = 3 ** np.arange(LABELLERS)
    for batch in rows:
        for begin, stop in blocks(batch.column("text")):
            part = batch.slice(begin, stop - begin)
            pattern = votes(measures(part.column("text"))[0]) @ scale
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(pattern.astype(np.int64))], ["doc_id", "key", "pattern"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, table[labeller, class, vote], and the posterior of good for each pattern (n, labellers)."""
    k = patterns.shape[1]
    if not counts.sum():
        return 0.5, np.full((k, 2, 3), 1 / 3), np.zeros(0)
    # the start: a labeller that votes is right in seven of ten cases
    table = np.empty((k, 2, 3))
    seen = np.stack([np.array([counts[patterns[:, j] == v].sum() for v in (BAD, NONE, GOOD)]) for j in range(k)]) / counts.sum()
    table[:, 0] = np.stack([0.7 * (1 - seen[:, 1]), seen[:, 1], 0.3 * (1 - seen[:, 1])], axis=1)
    table[:, 1] = table[:, 0, ::-1]
    good, last = 0.8, -np.inf
    for _ in range(rounds):
        logs = np.log(np.maximum(table, 1e-12))
        score = np.stack([logs[np.arange(k), c, patterns].sum(axis=1) for c in (0, 1)], axis=1) + np.log([1 - good, good])
        top = score.max(axis=1, keepdims=True)
        like = np.exp(score - top)
        posterior = like[:, 1] / like.sum(axis=1)
        total = float((counts * (top[:, 0] + np.log(like.sum(axis=1)))).sum() / counts.sum())
        if total - last < tolerance:
            break
        last = total
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        good = float(np.clip(weight[1].sum() / counts.sum(), 1e-6, 1 - 1e-6))
        for j in range(k):
            for v in (BAD, NONE, GOOD):
                table[j, :, v] = (weight[:, patterns[:, j] == v].sum(axis=1) + 0.5) / (weight.sum(axis=1) + 1.5)
    return good, table, posterior


def features(texts: pa.Array, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, the shapes of word ends, and word pairs of each text of one block: columns, and ranges per text."""
    _, words = measures(texts)
    n, h = np.diff(words.first), words.h
    pair = np.zeros(len(h), U)
    pair[:-1] = mix(h[:-1] * U(3) + h[1:])
    last = np.zeros(len(h), bool)
    last[words.first[1:][n > 0] - 1] = True
    tail = words.data[words.end - 1].astype(U) if len(h) else np.zeros(0, U)
    head = words.data[words.start].astype(U) if len(h) else np.zeros(0, U)
    shape = mix(head * U(256) + tail + U(1))
    columns = np.stack([h % U(size), np.where(last, h, pair) % U(size), shape % U(size)], axis=1).ravel().astype(np.int64)
    return columns, words.first * 3


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for begin, stop in blocks(batch.column("text")):
            columns, first = features(batch.column("text").slice(begin, stop - begin))
            yield pa.RecordBatch.from_arrays([batch.column("pattern").slice(begin, stop - begin), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(columns.astype(np.int32)))],
                                             ["pattern", "columns"])


def fit(columns: list[np.ndarray], target: np.ndarray, size: int = FEATURES, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on mean feature weights, by Adagrad over small batches in fixed order."""
    weights, bias = np.zeros(size), 0.0
    held, held_bias = np.full(size, 1e-8), 1e-8
    count = np.array([len(c) for c in columns])
    order = np.random.default_rng(7).permutation(len(columns))
    for _ in range(passes):
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            ids, of = np.concatenate([columns[r] for r in rows]), np.repeat(np.arange(len(rows)), count[rows])
            scale = 8.0 / np.maximum(count[rows], 1)
            z = np.bincount(of, weights[ids], minlength=len(rows)) * scale + bias
            slope = (1 / (1 + np.exp(-z)) - target[rows]) / len(rows)
            grad = np.bincount(ids, (slope * scale)[of], minlength=size)
            held += grad * grad
            held_bias += slope.sum() ** 2
            weights -= 0.5 * grad / np.sqrt(held)
            bias -= 0.5 * slope.sum() / np.sqrt(held_bias)
    return weights, float(bias)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, posterior of its votes, score of the linear scorer, kept."""
    rows = docs.select("doc_id", text_key().alias("key"), whole_text().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    voted = staged(rows.mapInArrow(_voted, f"doc_id {id_type}, key long, pattern long"), "votes")
    counted = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** LABELLERS rows
    codes = np.array([r["pattern"] for r in counted], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(LABELLERS)) % 3
    _, _, posterior = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    soft = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    chosen = voted.orderBy(F.xxhash64("doc_id", "key", F.lit(11)), "doc_id", "key").limit(sample).select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "pattern")
    drawn = rows.join(F.broadcast(chosen), rows["doc_id"].eqNullSafe(F.col("_i")) & (rows["key"] == F.col("_k"))).select("pattern", "text", "doc_id", "key")
    got = drawn.mapInArrow(_hashed, "pattern long, columns array<int>").toArrow()
    lists = got.column("columns").combine_chunks()
    columns = [np.asarray(x.values) for x in lists] if got.num_rows else []
    weights, bias = fit(columns, np.array([soft[p] for p in got.column("pattern").to_pylist()])) if columns else (np.zeros(FEATURES), 0.0)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias, soft))  # FEATURES numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, soft = model.value
        scale = 3 ** np.arange(LABELLERS)
        for batch in batches:
            for begin, stop in blocks(batch.column("text")):
                part = batch.slice(begin, stop - begin)
                columns, first = features(part.column("text"))
                sums = np.append(0.0, np.cumsum(weights[columns], dtype=np.float64))
                z = (sums[first[1:]] - sums[first[:-1]]) * 8.0 / np.maximum(np.diff(first), 1) + bias
                pattern = votes(measures(part.column("text"))[0]) @ scale
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([soft[p] for p in pattern.tolist()]), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "posterior", "score"])

    out = rows.mapInArrow(scored, f"doc_id {id_type}, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= KEEP)
