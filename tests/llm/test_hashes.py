"""Texts made to defeat hashes of words and windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import near_dedup, substring_dedup
from marketlens.llm.wordhash import words_of


def alternating(n: int, pair: str) -> tuple[str, str]:
    """The Thue-Morse sequence of length n over two letters, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_structured_words_have_their_own_hashes(n):
    words = words_of(pa.array([" ".join(alternating(n, "ab"))]))
    assert words.h[0] != words.h[1] and words.h2[0] != words.h2[1]
    texts = [" ".join(t) for t in alternating(n, "ab")]
    names = words_of(pa.array(texts)).names()
    assert (names[0] != names[1]).all()


def test_hashes_depend_on_the_word_alone():
    texts = ["aa b", "x aa", "", "  aa", "b aa " + "y" * 300 + " aa", "z" * 300 + " " + "y" * 300]
    words = words_of(pa.array(texts))
    shown = [bytes(words.data[s:e]) for s, e in zip(words.start, words.end, strict=True)]
    assert [w for t in texts for w in t.encode().split()] == shown
    for h in (words.h, words.h2):
        assert len({(w, x) for w, x in zip(shown, h.tolist(), strict=True)}) == len(set(shown)) == len(set(h.tolist()))
    assert np.array_equal(words.first, [0, 2, 4, 4, 5, 9, 11])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_documents_of_structured_words_are_left_alone(spark, n):
    one, other = alternating(n, "ab")
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, one), (4, other)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs.filter("doc_id > 2")).collect()}
    assert classes == {3: 3, 4: 4}


def test_documents_of_two_alternating_words(spark):
    one, other = (" ".join(t) for t in alternating(4096, "xy"))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert all((words_of(pa.array([one, other])).names()[0] != words_of(pa.array([one, other])).names()[1]))
    seen, want = set(), {}
    for doc_id, text in ((1, one), (2, other)):
        words = text.split()
        covered = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                covered |= set(range(i, i + 20))
            seen.add(window)
        want[doc_id] = (len(covered), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in covered).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digests(docs).collect()} == want


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "int", "long"])
def test_ids_of_any_type_keep_their_order(spark, kind):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [("10", f"{passage} a"), ("9", f"{passage} b"), ("11", f"c {passage}"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    first = "10" if kind == "string" else "9"
    got = {None if r["doc_id"] is None else str(r["doc_id"]): r["n_removed"] for r in substring_dedup.digests(docs).collect()}
    assert got == {i: 0 if i == first else 30 for i, _ in rows}
    assert dict(substring_dedup.apply(docs).dtypes) == dict(docs.dtypes)


def test_the_largest_id_is_not_taken_for_null(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(None, passage), ((1 << 63) - 1, passage)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(docs).collect()} == {(1 << 63) - 1: 0, None: 30}


def test_a_text_longer_than_a_block(spark):
    words = [f"w{i % 70_000}" for i in range(420_000)]  # 2.8 MB
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:50]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(docs).collect()} == {1: 350_000, 2: 50}
    assert {r["class_size"] for r in near_dedup.classes(docs).collect()} == {1}
