"""Personal data, centroid clustering and the filter audit against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import centroids, filter_audit, pii
from marketlens.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- personal data

def plain_base(text: str) -> list[tuple[str, int, int]]:
    def digits(s: str) -> str:
        return re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n if n < 10 else n - 9
        return total % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, good in rules for m in re.finditer(pattern, text) if good(m.group())]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "..", "1", "25", "256", "0007", "4111111111111111", "-", " ", "+", "%", "(", ")", "é", "\n", "@x.y", "4111 1111 1111 1111", "+1 (132) 555-1352", "one", " at ", " dot "]), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    found = pii.spans(text)
    base = [s[:3] for s in found if s[3]]
    assert base == plain_base(text)
    assert list(pii.scan(pa.array([text])))[0] == found
    assert all(0 <= start < stop <= len(text) for _, start, stop, _, _ in found)


@pytest.mark.parametrize(
    ("text", "kind", "source", "value"),
    [
        ("Mail john dot smith at example dot com now", "email", "john dot smith at example dot com", "john.smith@example.com"),
        ("x john [at] example [dot] com.", "email", "john [at] example [dot] com", "john@example.com"),
        ("von hans klammeraffe post punkt example punkt de!", "email", "hans klammeraffe post punkt example punkt de", "hans@post.example.de"),
        ("a jоhn＠exаmple。com b", "email", "jоhn＠exаmple。com", "john@example.com"),
        ("call plus one five five five, one two three four five", "phone", "plus one five five five, one two three four five", "+1555" + "12345"),
        ("４１１１ 1111 1111​ 1111", "card", "４１１１ 1111 1111​ 1111", "4111 1111 1111 1111"),
        ("four triple one 1111 1111 1111", "card", "four triple one 1111 1111 1111", "4111 1111 1111 1111"),
        ("at one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
        ("ip l92.l68.O.1 end", "ip", "l92.l68.O.1", "192.168.0.1"),
        ("ip 10[.]0[.]0[.]7 end", "ip", "10[.]0[.]0[.]7", "10.0.0.7"),
        ("x john&#64;example&#46;com", "email", "john&#64;example&#46;com", "john@example.com"),
        ("१२७.0.0.1", "ip", "१२७.0.0.1", "127.0.0.1"),
    ],
)
def test_disguises_are_found_at_their_source(text, kind, source, value):
    found = [s for s in pii.spans(text) if s[0] == kind]
    assert [(text[s[1] : s[2]], s[4], s[3]) for s in found] == [(source, value, False)]
    assert list(pii.scan(pa.array([text])))[0] == pii.spans(text)


@pytest.mark.parametrize(
    "text",
    ["We met at noon. The one at the dot.", "buy one at example.com", "one, two, three and four", "un point deux", "4l2 O2", "+1 (132) 555-1352 one time", "Éa fin de 4111 1111 1111 1112", ""],
)
def test_plain_prose_gets_no_added_span(text):
    assert [s for s in pii.spans(text) if not s[3]] == []


def test_a_long_run_takes_linear_time():
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+(" * 200_000, "l" * 400_000, "a@" * 200_000, " at x" * 80_000, "one " * 100_000):
        pii.spans(run + "é")


def test_pii_query_and_redaction(spark):
    rows = [(1, "mail a@b.co or c [at] d.org", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (1, "mail a@b.co or c [at] d.org", "en", "s", 3), (None, "9 " * 50_000 + "+1 (132) 555-1352", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash")).withColumn("kind", F.lit(1))
    got = sorted((tuple(r) for r in pii.digests(docs).collect()), key=str)
    sha = hashlib.sha256
    one = (1, 1, 0, 0, 0, sha(b"email:5:11").hexdigest(), "email:5:11,email:15:27", 1)
    none = sha(b"").hexdigest()
    assert got == sorted([one, one, (2, 0, 0, 0, 0, none, "", 0), (3, 0, 0, 0, 0, none, "", 0), (None, 0, 0, 0, 1, sha(b"phone:100000:100017").hexdigest(), "phone:100000:100017", 0)], key=str)
    clean = {r["doc_id"]: r for r in pii.redact(docs.filter("doc_id is not null")).collect()}
    assert clean[1]["text"] == "mail <email> or <email>" and clean[2]["text"] is None and clean[1]["spans"] == "clash"
    assert pii.digests(docs.limit(0)).count() == 0


def test_op11_covers_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_pii"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


# ---- centroid clustering

def plain_clusters(rows: list[tuple[int, list[float]]], k: int, rounds: int):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v):
        return min((far(v, c), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), centers


def test_clusters_equal_comparing_all(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1, 0, 1]) * draw.random() * 3 ** (i % 4) for _ in range(64)]) for i in range(120)]
    rows += [(3, rows[3][1]), (200, rows[7][1]), (201, [0.0] * 64), (None, [0.5] * 64)]
    rows += [(300, None), (301, [1.0] * 63), (302, [float("nan")] + [0.0] * 63), (303, [float("inf")] + [0.0] * 63), (304, [None] + [0.0] * 63), (305, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(0))
    want, centers = plain_clusters(rows, 16, 3)
    got = centroids.report(frame.repartition(5)).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    assert all(r["centroid_sha256"] == names[r["cluster"]] for r in got)
    assert all(r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)
    assert sum(r["n_exact"] for r in got) < 16 * len(got)


def test_few_equal_or_no_vectors(spark):
    frame = spark.createDataFrame([(i, [0.25] * 64) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in centroids.report(frame).collect()} == {(0, 0, 0)}
    assert centroids.report(frame.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [r["distance"] for r in centroids.report(wide).collect()] == [0, 0]


def test_pruning_keeps_ties_and_the_nearest():
    draw = np.random.default_rng(2)
    v = draw.integers(-3, 4, (500, 64))
    c, p = v[:16].copy(), v[16:24]
    c[5] = c[2]
    number, best, taken = centroids.Bounds.of(c, p).nearest(v, centroids.squared(v, p))
    all_ = centroids.squared(v, c)
    assert (number == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all() and (taken <= 16).all()


# ---- filter audit

def plain_audit(docs, labels):
    text = {}
    for i, (_, t, s) in enumerate(docs):
        text[i] = t or ""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for i, (doc_id, _, source) in enumerate(docs):
        t = text[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        key = math.inf if doc_id is None else doc_id
        if any(text[j] == t and (math.inf if docs[j][0] is None else docs[j][0]) < key for j in range(len(docs))):
            fails.add("E")
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                earlier = len([r for r in mine if f in r[1]]) - len(gone)
                left = [r for r in left if f not in r[1]]
                only = len([r for r in mine if r[1] == {f}])
                out.append((part, order, step, len(left), len(gone), earlier, only, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_running_every_order(spark):
    draw = random.Random(3)
    texts = ["", "x", "A B C", "# one", " ".join(str(i) for i in range(60)), " ".join(str(i) for i in range(60)) + " &", "same " * 70, "Same " * 70 + "|", "ABC " * 5 + " ".join(map(str, range(60)))]
    docs = [(draw.choice([None, *range(40)]), draw.choice([None, *texts]), draw.choice([None, "", "hot", "hot", "hot", "b"])) for _ in range(90)]
    docs += [(7, "same", "a"), (7, "same", "b"), (7, "same", "b"), (8, "same", "a"), (None, "same", "c")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, 8, None]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("good", F.lit("clash")).withColumn("digest", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    assert sorted(tuple(r) for r in filter_audit.audit(frame, marks).collect()) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert filter_audit.audit(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
