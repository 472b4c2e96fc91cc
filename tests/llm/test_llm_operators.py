"""Operators of the llm subpackage against brute force, exact round trips and held-out labels, on small tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from marketlens.llm import bpe, chat_format, exact_dedup, license_scan, near_dedup, packing, quality_rules, sharding, substring_dedup, weak_labels
from marketlens.llm.queries import QUERIES, WORD_BPE
from marketlens.llm.wordhash import words_of

PATH = public_tokenizers.path(WORD_BPE)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, id string, node string, label string, ranges string, _row string, h long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies, clashing column names."""
    long_, shared = prose(1, 3000), prose(2, 60)
    near = prose(3, 200).split()
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one  two\nthree four"), (6, long_), (7, long_), (7, long_), (7, prose(4, 30)), (None, prose(5, 40)), (None, prose(5, 40)),
        (8, "a  b c " + shared), (9, shared + " tail of nine"), (10, " ".join(near)), (11, " ".join(near[:100] + ["x"] + near[101:])), (12, " ".join(near).upper()),
        (13, "loop " * 500), (14, "Ünï ćødé 😀 end\x0b\x0c" + shared), (15, "under the MIT license. Under the  mit-license; Apache License, Version 2"), (16, "c c\u212a \u0085 \u00a0x"),
    ]
    return [(i, t, None if n % 5 == 0 else "en", "s", None if t is None else len(t), "r", "k", "i", "n", "l", "g", "_", 1) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(contract.oracle_sql().keys() & QUERIES.keys()))
def test_same_rows_as_sql(spark, sf_dir, name):
    got = contract.queries()[name](spark, sf_dir)
    want = duck(sf_dir).execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want.fetchall()]
    assert collections.Counter(rows) == collections.Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.select(names).collect())


def test_words_of_bytes():
    words = words_of(pa.array(["", " a bb\x0bc", "a\x85b é", "a"]), fold_case=False)
    parts = [bytes(words.data[s:e]) for s, e in zip(words.start, words.end, strict=True)]
    assert parts == [b"a", b"bb", b"c", "a\x85b".encode(), "é".encode(), b"a"]
    assert words.first.tolist() == [0, 0, 3, 5, 6] and words.h[0] == words.h[5] and len(set(words.h.tolist())) == 5


# exact de-duplication


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for n, r in enumerate(rows):
        groups["".join(c for c in (r[1] or "") if c not in " \t\n\x0b\x0c\r")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, n))
    return {k: (min(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("heavy", [1, 512])
def test_exact_dedup_on_odd_rows(odd, heavy):
    want = brute_exact(odd_rows())
    got = collected(exact_dedup.decide(odd, heavy=heavy, counters=1024))
    assert len(got) == len(odd_rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, (first, size) in want.items():
        rows = by[hashlib.sha256(text.encode()).hexdigest()]
        assert len(rows) == size and {r["group_size"] for r in rows} == {size} and sum(r["kept"] for r in rows) == 1
        assert {r["keep_id"] for r in rows} == {None if first[1] else first[2]}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(want)


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


# quality rules


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (1, 40, 900) for k in (0, 1, 3, 7)]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules.binomial_tail("n", "k", 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == 1.0 if r.k >= r.n * 0.02 else abs(r.p - want) < 1e-12


def test_cutoffs_bound_false_rejection(spark):
    pick = random.Random(5)
    bad = [(i, " ".join(w + "###" for w in prose(i, 40).split()), "en") for i in range(100)]
    good = [(1000 + i, prose(1000 + i, 40) + (" ###" * 30 if i % 400 == 0 else ""), "en") for i in range(2600)]
    few = [(9000 + i, prose(9000 + i, 40), "xx") for i in range(50)]
    docs = spark.createDataFrame([r for r in pick.sample(bad + good + few, len(bad + good + few))], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 1000, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality_rules.apply(docs, labels).collect()}
    assert not kept & {r[0] for r in bad}
    assert len([r for r in good if r[0] not in kept]) <= quality_rules.ALPHA * len(good)
    assert {r[0] for r in few} <= kept  # too few labels certify nothing


def test_cutoffs_of_several_strata_equal_sql(spark, tmp_path):
    """Two strata get cutoffs of their own, one has too few labels; the SQL decides the same rows."""
    rows = []
    for lang, first, good, capitals in (("en", 10_000, 1700, 2), ("de", 20_000, 1900, 9), ("xx", 30_000, 60, 2)):
        rows += [(first + i, ("A" * capitals if i % 50 == 0 else "") + prose(first + i, 30), lang, 1) for i in range(good)]
        rows += [(first + 5000 + i, " ".join(w + "###" for w in prose(first + 5000 + i, 30).split()), lang, 0) for i in range(40)]
    for name, columns, schema in (("documents", (0, 1, 2), "doc_id long, text string, lang string"), ("labels", (0, 3), "doc_id long, quality int")):
        pq.write_table(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema).toArrow(), tmp_path / f"{name}.parquet")
    got = {r["doc_id"]: r["kept"] for r in collected(contract.queries()["op5_quality_rules"](spark, str(tmp_path)))}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert got == dict(con.execute(f"SELECT doc_id, kept FROM ({contract.oracle_sql()['op5_quality_rules']})").fetchall())
    junk = {lang: [got[r[0]] for r in rows if r[2] == lang and r[3] == 0] for lang in ("en", "de", "xx")}
    assert not any(junk["en"]) and not any(junk["de"]) and all(junk["xx"])
    assert all(sum(not got[r[0]] for r in rows if r[2] == lang and r[3]) <= quality_rules.ALPHA * n for lang, n in (("en", 1700), ("de", 1900)))


def test_quality_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = collected(quality_rules.judge(odd, labels))
    assert len(got) == len(odd_rows())
    for r in odd_rows():
        words = (r[1] or "").encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
        assert any(x["doc_id"] == r[0] and x["n_words"] == len(words) and x["n_repeat_words"] == len(covered) and x["word_chars"] == sum(len(w.decode()) for w in words) for x in got)
    assert quality_rules.apply(odd, labels).columns == odd.columns
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.apply(none, labels).count() == 0


# byte-pair encoding


ODD_TEXTS = ["", "don't I'LL 've", "<|startoftext|>a<|endoftext|>B", "ΑΣ ΣΑΣ İstanbul", "A\u0301 e\u0301\u0323", "x\x1cy\x1fz", "a\u2003b\u0085c", "ﬃ Ⅷ ½ 12345", "😀👍🏽", "<|endof", "w" * 3000]


def test_bpe_equals_the_library(docs):
    own, library = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    for text in ODD_TEXTS + [r["text"] or "" for r in docs[:80]]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(own, text) == ids
        assert bpe.decode(own, ids) == library.decode(ids, skip_special_tokens=False)
    for text in ("hello,wörld", "<|endoftext|>", "İstanbul.", "don't,"):
        assert np.frombuffer(packing.LibraryBpe(PATH).packed(text), packing.ID).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_each_assigned_character():
    import unicodedata

    own, library = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    for c in range(0, 0x30000, 7):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn":
            assert bpe.encode(own, f"a{chr(c)}b") == library.encode(f"a{chr(c)}b", add_special_tokens=False).ids, hex(c)


def test_bpe_query_and_odd_rows(spark, sf_dir, docs, odd, none):
    library = Tokenizer.from_file(PATH)

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(QUERIES["op8_bpe_codec"](spark, sf_dir))}
    assert got == {r["doc_id"]: want(r["text"]) for r in docs}
    rows = collected(bpe.digests(odd, PATH))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == collections.Counter((r[0], *want(r[1])) for r in odd_rows())
    assert bpe.digests(none, PATH).count() == 0
    ids = {r["doc_id"]: r for r in collected(bpe.tokenised(odd, PATH))}
    assert ids[4]["ids"] == " ".join(map(str, library.encode("one", add_special_tokens=False).ids))


def test_generations_forget_the_oldest():
    made = []
    kept = bpe.Generations(lambda k: made.append(k) or k.upper(), 2)
    assert [kept[k] for k in "abcab"] == list("ABCAB") and len(kept) <= 2
    assert made.count("a") == 1


# license scan


def test_license_spans(spark, odd, none):
    long_ = next(t for t in license_scan.TEMPLATES if t.startswith("permission"))
    words = long_.split()
    rows = [
        (1, "x " * 7 + "Released Under The MIT License. " + "y " * 3 + "under the mit license"), (2, " ".join(words[:9] + ["extra"] + words[9:])), (3, " ".join(words[:6])),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "apache license version"), (6, "CC BY NC, cc-by-nc"), (7, "mİt under the mit licensé"), (8, "under the mit \u212aicense"),
    ]
    got = {r["doc_id"]: r for r in collected(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"], got[1]["score"]) == (2, 8, 15, "mit", 1.0)
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["labels"]) == (0, "", "mit") and 0.8 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.5
    assert got[4]["labels"] == "gpl-3" and got[5]["labels"] == "" and got[6]["n_base"] == 2 and got[7]["labels"] == "" and got[8]["labels"] == ""
    apache = "licensed under the apache license version 2 0".split()
    torn = " ".join(w for i in range(len(apache) - 2) for w in apache[i : i + 3])
    back = " ".join(" ".join(apache[i : i + 3]) for i in range(len(apache) - 3, -1, -1))
    again = spark.createDataFrame([(1, torn), (2, back), (3, "under the mit license " * 3000)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(again).collect()} == {1: "", 2: "", 3: "mit"}
    assert license_scan.scan(odd).count() == len(odd_rows()) and license_scan.scan(none).count() == 0
    fifteen = next(r for r in collected(license_scan.scan(odd)) if r["doc_id"] == 15)
    assert (fifteen["n_base"], fifteen["first_word"], fifteen["last_word"], fifteen["base_labels"]) == (3, 0, 8, "apache-2,mit")


# weak labels


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.85])
    right = draw.random((20_000, 4)) < accuracy
    votes = np.where(draw.random((20_000, 4)) < 0.2, weak_labels.NONE, np.where(right == truth[:, None], weak_labels.GOOD, weak_labels.BAD))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, table, posterior = weak_labels.expectation_maximisation(patterns, counts.astype(float))
    assert abs(good - 0.7) < 0.03
    assert np.abs(table[:, 1, weak_labels.GOOD] / (table[:, 1, weak_labels.GOOD] + table[:, 1, weak_labels.BAD]) - accuracy).max() < 0.03
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.93


def test_weak_labels_on_held_out_labels(spark, odd, none):
    dir_ = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{dir_}/labels.parquet").to_pylist()}
    got = [(truth[r.doc_id], r.kept) for r in QUERIES["op6_weak_label_quality"](spark, dir_).collect() if r.doc_id in truth]
    assert sum(bool(t) == k for t, k in got) / len(got) > 0.88
    assert sum(k for t, k in got if t) / sum(t for t, _ in got) > 0.97
    rows = collected(weak_labels.classify(odd))
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert weak_labels.classify(none).count() == 0


# sharding


def test_shards(spark, sf_dir, docs, odd, none, tmp_path):
    rows = collected(QUERIES["op7_sharding"](spark, sf_dir))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {r["doc_id"]: (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    small = sharding.shuffled(odd, shards=3, bucket_bytes=4096)
    again = collected(small)
    assert [r["record"] for r in again] and collections.Counter(str(r["record"]) for r in again) == collections.Counter(str(r.asDict()) for r in odd.collect())
    by = collections.defaultdict(list)
    for r in again:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sharding.write_shards(small, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(odd_rows())
    assert sharding.shuffled(none).count() == 0


def test_one_more_shard_takes_only_into_itself(spark):
    ids = spark.range(2000)
    at = {n: {r.id: r.s for r in ids.select("id", sharding.winner(F.col("id"), n, 1)["s"].alias("s")).collect()} for n in (7, 8)}
    assert all(at[8][i] in (at[7][i], 7) for i in at[7])
    assert 150 < sum(at[8][i] == 7 for i in at[7]) < 350


# chat formatting


def test_round_trip_of_conflicting_turns(spark):
    texts = ["plain", None, "", "</turn>", "\\</turn>", "\\\\<text>x", "a\n</turn><turn>user\n<text>b", "ends with \\", "<turn>", "</turn", "\n<text>", "ünï 😀 </turn>\n"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(texts)] + [(2, 0, "we<text>ird\n<text>", "x"), (2, 0, None, None), (None, None, "assistant", "</turn>"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    got = {r["conv_id"]: r for r in collected(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat_format.masked_text()))}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["loss"] == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("we<text>ird\n<text>", "x")]
    assert got[3]["loss"] == "bb" and got[None]["loss"] == "</turn>"
    assert got[1]["formatted"].startswith("<turn>user\n<text>plain\n</turn>") and "\\\\</turn>" in got[1]["formatted"]
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_has_the_planted_conversation(spark, sf_dir):
    text = "\\### Assistant: </turn> ok"
    row = next(r for r in collected(QUERIES["op9_chat_format"](spark, sf_dir)) if r["conv_id"] == -7)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# substring de-duplication


def brute_cut(rows):
    """(doc_id, text) -> kept words; equal (doc_id, text) rows are one document."""
    from_first, out = {}, {}
    for doc_id, text, key in sorted({(r[0], r[1] or "", r[2]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if from_first.setdefault(window, (doc_id, text, i)) != (doc_id, text, i):
                gone.update(range(i, i + 20))
        out[doc_id, text] = [w for n, w in enumerate(words) if n not in gone], len(words)
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 22])
def test_substring_dedup_on_odd_rows(odd, none, bucket_bytes, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_ranges, "__defaults__", (bucket_bytes,))
    keyed = [(r.doc_id, r.text, r.k) for r in odd.select("doc_id", "text", substring_dedup.text_key().alias("k")).collect()]
    want = brute_cut(keyed)
    got = collected(substring_dedup.digests(odd))
    sha = lambda kept: hashlib.sha256(b" ".join(kept)).hexdigest()
    expected = collections.Counter((i, want[i, t or ""][1], want[i, t or ""][1] - len(want[i, t or ""][0]), sha(want[i, t or ""][0])) for i, t, _ in keyed)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected
    cut = substring_dedup.apply(odd)
    assert cut.columns == odd.columns
    for r in cut.collect():
        if r.doc_id is not None and r.doc_id not in (7,):
            kept, n = want[r.doc_id, next(t or "" for i, t, _ in keyed if i == r.doc_id)]
            assert (r.text or "").encode().split() == kept and (len(kept) == n or r.n_chars == len(r.text))
    assert substring_dedup.digests(none).count() == 0 and substring_dedup.apply(none).count() == 0


def test_a_frequent_line_is_split_over_buckets(spark):
    """One line stands in each document amid other words: no bucket gets more than a few times its share, no row changes."""
    line = prose(50, 12)
    rows = [(i, f"{prose(5000 + i, 25)} {line} {prose(7000 + i, 25)}") for i in range(600)]
    rows += [(1000 + i, f"{prose(5000 + i, 25)} {line} {prose(9000 + i, 15)}") for i in range(0, 600, 9)]  # equal windows across the line
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def counted(blobs):
        rows, _, singles = substring_dedup._unpacked(blobs)
        return int(rows["windows"].sum()) + len(singles["a"])

    source = docs.select(F.col("doc_id").alias("id"), substring_dedup.text_key().alias("key"), "text").toArrow().combine_chunks().to_batches()
    total = sum(len(r[1]) for r in rows)
    buckets, bucket_bytes = 24, total * substring_dedup.PACKED // 24
    slots = list(substring_dedup._slot_bytes(iter(source), buckets * substring_dedup.SLOTS))
    hot = np.concatenate([s.column("slot").to_numpy()[s.column("n").to_numpy() > bucket_bytes] for s in slots])
    assert len(hot)
    by = collections.defaultdict(list)
    for batch in substring_dedup._sent(iter(source), buckets, hot):
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
            by[bucket].append(blob)
    sizes = [counted(blobs) for blobs in by.values()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    want = brute_cut([(i, t, 0) for i, t in rows])
    ranges = {r["id"]: r["ranges"] for r in collected(substring_dedup.repeated_ranges(docs, bucket_bytes))}
    assert {i: substring_dedup._cut(t, ranges.get(i, []))[1] for i, t in rows} == {i: want[i, t][0] for i, t in rows}


def test_substring_query(spark, sf_dir, docs):
    want = brute_cut([(r["doc_id"], r["text"], 0) for r in docs])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in collected(QUERIES["op10_substring_dedup"](spark, sf_dir))}
    assert got == {i: (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for (i, _), (kept, n) in want.items()}


# near-duplicates


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def brute_classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if union == 0 or (sum((sets[i] & sets[j]).values()) >= 0.8 * union):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_darts_estimate_weighted_similarity():
    a, b = prose(21, 300), prose(21, 300).split()
    b = " ".join(b[:150] + b[200:])
    cells, first, _ = near_dedup.cells_of(pa.array([a, b, "loop " * 40, "", "one two"]))
    s = near_dedup.signatures(cells, first, k=4000)
    x, y = shingles(a), shingles(b)
    assert abs((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.03
    assert (s[3] == 0).all() and (s[4] != 0).all() and (s[2] != 0).all()
    assert np.array_equal(s[1], near_dedup.signatures(*near_dedup.cells_of(pa.array([b]))[:2], k=4000)[0])


def test_near_query(spark, sf_dir, docs):
    docs = sorted(docs, key=lambda r: r["doc_id"])
    want = brute_classes([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in collected(QUERIES["op1_near_dedup"](spark, sf_dir))}
    assert [got[r["doc_id"]]["class_id"] for r in docs] == [docs[w]["doc_id"] for w in want]
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_near_dedup_of_a_chain_and_odd_rows(spark, odd, none):
    base = prose(31, 400).split()
    chain = [" ".join(base[i * 12 : i * 12 + 200]) for i in range(12)]  # neighbours are similar, ends are not
    rows = [(100 + n, t) for n, t in enumerate(chain)] + [(200 + n, prose(200 + n, 50)) for n in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in collected(near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
    want = brute_classes([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[w][0] for w in want]
    rows = collected(near_dedup.classes(odd))
    assert len(rows) == len(odd_rows())
    keys = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] not in (None, 7)}
    assert keys[2] == keys[3] == 1 and keys[12] == 10 and keys[11] == 10 and keys[4] == 4
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["class_id"] for r in rows} - {7}) + 1
    assert near_dedup.classes(none).count() == 0 and near_dedup.drop_near_copies(none).count() == 0


def test_near_dedup_compares_a_family_without_all_its_pairs(spark, monkeypatch):
    base, pick, texts = prose(33, 200).split(), random.Random(34), []
    for n in range(240):
        text = list(base)
        for at in sorted(pick.sample(range(5, 195), 2 + n % 6), reverse=True):
            text[at : at + 1] = [f"x{pick.randrange(400)}"] if pick.random() < 0.8 else []
        texts.append(" ".join(text))
        if n % 6 == 5 and n % 4 == 1:  # linked to a copy that is not similar to the base
            at = pick.randrange(20, 180)
            texts.append(" ".join([*text[:at], "y", *text[at + 1 :]]))
    rows, compared, verified = list(enumerate(texts)), [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    got = {r["doc_id"]: r["class_id"] for r in collected(near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")))}
    want = brute_classes(texts)
    assert [got[i] for i, _ in rows] == want
    assert len(set(want)) > 20 and collections.Counter(collections.Counter(want).values())[2] > 5
    assert sum(compared) < 20 * len(rows)  # all pairs: 33670


# packing


def check_packing(rows, docs, window):
    library = Tokenizer.from_file(PATH)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
        total += at
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= window
    return total / (len(sequences) * window)


def test_packing(spark, sf_dir, docs, odd, none):
    assert check_packing(collected(QUERIES["op3_packing"](spark, sf_dir)), [(r["doc_id"], r["text"]) for r in docs], 2048) > 0.98
    single = odd.filter("doc_id is not null and doc_id != 7")
    rows = collected(packing.pack(single, PATH, window=64, shard_tokens=2000))
    check_packing(rows, [(r[0], r[1]) for r in odd_rows() if r[0] not in (None, 7)], 64)
    whole = collected(packing.pack(odd, PATH))
    assert sum(r["length"] for r in whole if r["doc_id"] == 7) == sum(r["doc_tokens"] for r in whole if r["doc_id"] == 7 and r["start"] == 0)
    assert packing.pack(none, PATH).count() == 0


def test_packing_asks_the_library_once_for_a_piece(docs, monkeypatch):
    own, library, asked = packing.LibraryBpe(PATH), Tokenizer.from_file(PATH), []
    monkeypatch.setattr(own, "tokenised", lambda pieces: asked.extend(pieces) or packing.LibraryBpe.tokenised(own, pieces))
    pick = random.Random(7)
    parts = [*ODD_TEXTS, "Word", "word,", "W\u00f6rd!", "H\u0331", "o\u0308", "\u2014", "'", "'s", "<|", "|>", " ", "\n", "\x1c", "\x00", "\x7f", "7", "\u1e9e", "\u0130", "\u4e2d", "\U0001f600", "a" * 5000]
    texts = [*parts, *["".join(pick.choice(parts) for _ in range(12)) for _ in range(300)], *[r["text"] or "" for r in docs[:40]]]
    want = [[*library.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]

    def got():
        return [np.frombuffer(x, packing.ID).tolist() for x in own.texts([t.encode() for t in texts]).to_pylist()]

    assert got() == want and len(asked) == len(set(asked)) > 100
    known, again = set(asked), "the Word, the w\u00f6rd; a7b the".encode()
    own.texts([again])
    asked.clear()
    assert own.texts([again, b"", again]).to_pylist()[::2] == [own.texts([again])[0].as_py()] * 2 and not asked
    assert got() == want and known.issuperset(asked) and len(asked) < len(known) / 2
    monkeypatch.setattr(packing, "KEPT_UNITS", 50)
    own.kept.clear()
    own.kept.update(own.fixed)
    assert got() == want and got() == want


def test_blocks_of_texts():
    assert list(packing._blocks(np.array([3, 9, 1, 1, 40, 0, 2]), 10)) == [(0, 1), (1, 4), (4, 7)]
    assert list(packing._blocks(np.array([5]), 10)) == [(0, 1)]


def test_index_ranks_by_bm25():
    ids = [np.array(x, packing.ID) for x in ([5, 6, 7, 1], [5, 6, 9, 1], [8, 8, 1], [5, 1], [6, 7, 7, 5, 1])]
    n, mean = len(ids), np.mean([len(x) for x in ids])
    frequency = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=16)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    found = packing.Index(ids, idf, mean).neighbours(0, np.array([False, True, True, True, True]))

    def score(x):
        return sum(idf[t] * (x == t).sum() * 2.2 / ((x == t).sum() + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(ids[0].tolist()))

    assert found.tolist() == sorted((1, 2, 3, 4), key=lambda d: -score(ids[d]))


def test_all_tokens_of_a_seed_are_asked():
    seed, many, few = list(range(10, 60)), list(range(26, 60)), list(range(10, 13))
    ids = [np.array([*x, 1], packing.ID) for x in (seed, few + list(range(100, 131)), many)]
    idf = np.concatenate([np.full(26, 2.0), np.full(200, 1.0)])
    assert packing.Index(ids, idf, 40.0).neighbours(0, np.array([False, True, True])).tolist() == [2, 1]
    apart = [np.array([*x, 1], packing.ID) for x in (seed, *[range(200, 205)] * 9, few + list(range(100, 131)), many)]  # tokens without a row too
    assert packing.Index(apart, idf, 40.0).neighbours(0, np.array([False] + [True] * 11)).tolist()[:2] == [11, 10]


# the pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in docs}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "substrings", "pack"]
    last = None
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.staged(stage(spark, frame, sf_dir), f"test-{name}")
        now = {r["doc_id"]: r for r in collected(frame)} if name != "pack" else None
        if name == "quality":
            judged = duckdb_rows(sf_dir, contract.oracle_sql()["op5_quality_rules"], "doc_id", "kept")
            assert set(now) == {i for i, kept in judged if kept} and all(now[i] == rows[i] for i in now)
        elif name == "exact":
            want = brute_exact([(i, r["text"]) for i, r in sorted(last.items())])
            assert set(now) == {first[2] for first, _ in want.values()}
        elif name == "near":
            order = sorted(last)
            assert set(now) == {order[w] for w in brute_classes([last[i]["text"] for i in order])}
        elif name == "substrings":
            want = brute_cut([(i, r["text"], 0) for i, r in last.items()])
            assert {i: (r["text"] or "").encode().split() for i, r in now.items()} == {i: kept for (i, _), (kept, _) in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in now.values())
        else:
            assert check_packing(collected(frame), [(i, r["text"]) for i, r in last.items()], 2048) > 0.97
        last = now
    assert contract.queries()["pipeline"](spark, sf_dir).count() == frame.count()


def duckdb_rows(sf_dir, sql, *names):
    got = duck(sf_dir).execute(sql)
    at = [[c[0] for c in got.description].index(n) for n in names]
    return [tuple(r[i] for i in at) for r in got.fetchall()]


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(contract.__file__).parent
    files = [p for p in [*root.glob("marketlens/**/*.py"), root / "bench.py"] if "llm" not in p.parts]
    assert not [p for p in files if "marketlens.llm" in p.read_text()]
    assert duckdb.__version__
