"""Near-duplicates by DartMinHash and banded joining.

A document is the multiset of its runs of five words, A-Z lower-cased; an element of weight w owns the cells 1 to w. On
each cell darts fall along a rank axis, a Poisson process that the hash of the cell alone fixes. A document throws the
darts of its cells up to the rank at which k ln k + 2k darts are expected, deals them to k coordinates by hash and keeps
the earliest of each; if a coordinate stays empty the rank doubles. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity, at the cost of the darts, not of k hashes per element.

Documents of equal words are one node. Bands of coordinates are joined: in the first bands the nodes of a key are compared
with one pivot, the node that shares keys with most others, which connects most of a group of copies at once. Then, in all bands, the nodes of a
key that lies in several components are compared with its pivot, the centre. What is left of such keys is compared by differences: what a node and the centre
do not share. Two nodes have as many cells in only one of them as their differences have, so those of different components are similar only if their differences
share at least half of what these are larger than similarity allows; cells that no other component has count for none. Each node
therefore names the rarest of its shared differences, as many as must hold one common cell, and only nodes that meet there and still can share enough are compared. So in the
end every pair of a key is either compared, connected already or proved to be no link. Pairs are verified on their cells by exact
weighted Jaccard similarity, verified pairs are links, and linked nodes are one class, found by label propagation with
pointer jumping over stored tables.

Defined results: null text has no words; texts without words are one node; a text of fewer than five words is one run;
the class is named by its smallest doc_id (null last), which is the document that stays; of rows that repeat doc_id and
text one stays; an empty table gives an empty result; further columns are returned unchanged by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import staged, text_key, whole_text
from marketlens.llm.exact_dedup import keep_rows
from marketlens.llm.wordhash import U, blocks, mix, words_of

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 25, 5, 0.8
COORDINATES = BANDS * ROWS
#: Bands of the first round.
FIRST_BANDS = 3
#: Bounds are loosened by this much, so that rounding loses no pair.
SLACK = 1e-6


def cells_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of texts: cell hashes, the range of cells of each text, and a 16-byte name of its word sequence."""
    words = words_of(texts, fold_case=True)
    n = np.diff(words.first)
    runs = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), runs)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(n, SHINGLE)[of]
    h = mix(words.windows(words.first[:-1][of] + inside, length) + length.astype(U))
    order = np.lexsort((h, of))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    place = np.arange(len(h))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    cells = mix(h + copy.astype(U) * U(0x9E3779B97F4A7C15))
    return cells, np.append(0, np.cumsum(runs)), words.names()


def signatures(cells: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """k names of earliest darts per text, one row a text; a text without cells has zeros."""
    texts = len(first) - 1
    count = np.diff(first)
    out = np.zeros((texts, k), U)
    rank = (k * math.log(k) + 2 * k) / np.maximum(count, 1)
    todo = np.flatnonzero(count)
    while len(todo):
        best, name = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, U)
        of = np.repeat(np.arange(len(todo)), count[todo])
        cell = np.concatenate([cells[first[t] : first[t + 1]] for t in todo]) if len(todo) < texts else cells
        limit, at, step = rank[todo][of], np.zeros(len(of)), 0
        while len(of):
            step += 1
            dart = mix(cell + U(step * 0xD1B54A32D192ED03 % (1 << 64)))
            at = at - np.log1p(-(dart >> U(11)).astype(np.float64) * 2.0**-53)
            near = at <= limit
            of, cell, limit, at, dart = of[near], cell[near], limit[near], at[near], dart[near]
            slot = of * k + (((mix(dart) >> U(32)) * U(k)) >> U(32)).astype(np.int64)
            np.minimum.at(best, slot, at)
            won = best[slot] == at
            name[slot[won]] = dart[won]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        out[todo[full]] = name.reshape(-1, k)[full]
        todo = todo[~full]
        rank[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=U)), (len(signature), 1))
    for row in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, row])
    return key


def _names(name: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(name), [None, pa.py_buffer(np.ascontiguousarray(name).tobytes())]).cast(pa.binary())


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for begin, stop in blocks(batch.column("text")):
            part = batch.slice(begin, stop - begin)
            cells, first, name = cells_of(part.column("text"))
            keys = band_keys(signatures(cells, first))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), _names(name), _lists(keys.ravel(), np.arange(len(part) + 1) * BANDS)],
                                             ["doc_id", "key", "node", "bands"])


def _celled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for begin, stop in blocks(batch.column("text")):
            cells, first, _ = cells_of(batch.column("text").slice(begin, stop - begin))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(begin, stop - begin), _lists(cells, first)], ["node", "cells"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach from each node of ``links`` (a, b). Each round is a stored table."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        moved = staged(lower.join(jump, F.col("label") == F.col("_n")).select("node", "old", F.least("label", "_far").alias("label")), "labels")
        if moved.filter("label != old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose cells have at least the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("cells").alias("_x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("cells").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.filter(common >= similarity * (F.size("_x") + F.size("_y") - common)).select("a", "b")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(labelled: DataFrame) -> DataFrame:
    """Rows of the keys whose nodes lie in several components."""
    several = labelled.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l != m").select("band")
    return labelled.join(several, "band", "left_semi")


def _more(links: DataFrame, found: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links with those among the pairs, and the components of all."""
    more = staged(_verified(pairs, sets, similarity), "pairs")
    if more.isEmpty():
        return links, found
    links = links.unionByName(more)
    return links, components(links)


def _pivots(rows: DataFrame, name: str) -> DataFrame:
    """band, and the most popular node of each."""
    return rows.groupBy("band").agg(F.min(F.struct("far", "node")).alias("p")).select("band", F.col("p.node").alias(name))


def _meeting(homes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with a common centre and different labels, none missing that has the similarity.

    ``homes`` has distinct (centre, node, label); of two nodes with different labels one at least is not similar to the centre.
    """
    odd = (1 - similarity) / (1 + similarity)  # cells in one of two similar nodes only, as a share of the cells of both
    cells = homes.join(sets.select("node", F.col("cells").alias("_x")), "node").join(sets.select(F.col("node").alias("centre"), F.col("cells").alias("_c")), "centre")
    apart = F.concat(F.array_except("_x", "_c"), F.array_except("_c", "_x"))
    apart = staged(cells.select("centre", "node", "label", apart.alias("apart"), (F.size(apart) - odd * F.size("_x")).alias("excess")), "apart")
    lows = apart.groupBy("centre", "label").agg(F.min("excess").alias("low"))
    lowest = lows.groupBy("centre").agg(F.min(F.struct("low", "label")).alias("l"))
    others = lows.join(lowest, "centre").filter(F.col("label") != F.col("l.label")).groupBy("centre").agg(F.min("low").alias("other"), F.first("l").alias("l"))
    single = apart.select("centre", "node", "label", "excess", F.explode("apart").alias("cell"))
    shared = single.groupBy("centre", "cell").agg(F.min("label").alias("_l"), F.max("label").alias("_m"), F.count(F.lit(1)).alias("n")).filter("_l != _m")
    rarest = F.sort_array(F.collect_list(F.struct("n", "cell"))).alias("rarest")
    nodes = single.join(shared.select("centre", "cell", "n"), ["centre", "cell"]).groupBy("centre", "node").agg(F.first("label").alias("label"), F.first("excess").alias("excess"), rarest)
    partner = F.when(F.col("label") == F.col("l.label"), F.col("other")).otherwise(F.col("l.low"))
    need = F.greatest(F.ceil((F.col("excess") + partner) / 2 - SLACK), F.lit(1))
    nodes = nodes.join(others, "centre").select("centre", "node", "label", "excess", "rarest", F.size("rarest").alias("n"), need.cast("int").alias("need")).filter("n >= need")
    named = nodes.select("centre", "node", "label", "excess", "n", F.posexplode(F.slice("rarest", F.lit(1), F.col("n") - F.col("need") + 1)).alias("at", "c"))
    named = staged(named.select("centre", F.col("c.cell").alias("cell"), "node", "label", "excess", "n", "at"), "differences")
    mine = [F.col(c).alias("_" + c) for c in ("node", "label", "excess", "n", "at")]
    most = F.least("at", "_at") + 1 + F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) - 1
    enough = F.least("n", "_n", most) >= (F.col("excess") + F.col("_excess")) / 2 - SLACK
    met = named.join(named.select("centre", "cell", *mine), ["centre", "cell"]).filter((F.col("node") > F.col("_node")) & (F.col("label") != F.col("_label")) & enough)
    return met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, key, class_id, class_size, kept, and twin (repeats the row that stays)."""
    rows = docs.select("doc_id", text_key().alias("key"), whole_text().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = staged(rows.mapInArrow(_signed, f"doc_id {id_type}, key long, node binary, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    banded = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = staged(banded.join(sizes, "band"), "bands")  # only keys that several nodes share
    # the pivot of a key is the node that shares its keys with most others, as an original does with its copies
    popular = met.groupBy("node").agg((-F.sum("n")).alias("far"))
    members = staged(met.join(popular, "node").select("place", "band", "node", "far"), "bands")
    wanted = members.select("node").distinct()
    named = signed.select("doc_id", "key", "node").join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("d"))
    spokes = named.select("node", F.col("d.doc_id").alias("_i"), F.col("d.key").alias("_k"))
    texts = rows.join(spokes, rows["doc_id"].eqNullSafe(spokes["_i"]) & (rows["key"] == spokes["_k"])).select("node", "text")
    sets = staged(texts.mapInArrow(_celled, "node binary, cells array<long>").dropDuplicates(["node"]), "cells")
    first = members.filter(F.col("place") < FIRST_BANDS)
    pairs = first.join(_pivots(first, "b"), "band").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    links = staged(_verified(pairs, sets, similarity), "pairs")
    found = components(links)
    left = staged(_open(_labelled(members, found)).select("band", "node", "far", "label"), "open")
    centred = left.join(_pivots(left, "centre"), "band")
    labels = left.select(F.col("node").alias("centre"), F.col("label").alias("_l")).distinct()
    spokes = centred.filter("node != centre").select("band", "centre", "node")
    pairs = centred.join(labels, "centre").filter("label != _l").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links, found = _more(links, found, pairs, sets, similarity)
    homes = staged(_open(_labelled(spokes, found)).select("centre", "node", "label").distinct(), "homes")
    links, found = _more(links, found, _meeting(homes, sets, similarity), sets, similarity)
    named = signed.select("doc_id", "key", "node", F.monotonically_increasing_id().alias("row")).join(found, "node", "left")
    named = staged(named.select("doc_id", "key", "row", F.coalesce("label", "node").alias("label")), "classes")
    stay = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "key")).alias("s"), F.count(F.lit(1)).alias("class_size"))
    kept = F.col("row") == F.col("s.row")
    twin = F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("key") == F.col("s.key")) & ~kept
    return named.join(stay, "label").select("doc_id", F.col("key").alias("text_hash"), F.col("s.doc_id").alias("class_id"), "class_size", kept.alias("kept"), twin.alias("twin"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, all columns as they came."""
    decided = staged(classes(docs, similarity), "near")
    return keep_rows(docs, decided.filter("kept").select("doc_id", "text_hash"), decided.filter("twin").select("doc_id", "text_hash").distinct())
