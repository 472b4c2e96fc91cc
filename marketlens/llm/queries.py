"""Queries of the operators on the driver tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, centroids, chat_format, exact_dedup, filter_audit, license_scan, near_dedup, packing, pii, quality_rules, sharding, substring_dedup, weak_labels
from marketlens.llm.common import table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLE_SQL: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


@query(
    "op2_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
    FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.decide(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def quality_sql() -> str:
    """Word counts by splitting, windows by self-numbering, cutoffs by exact binomial tails."""
    rules = quality_rules.RULES
    values = ", ".join(f"CASE WHEN {b} > 0 THEN 1000 * {t} // {b} ELSE 0 END AS v_{r}" for r, (t, b, _) in rules.items())
    share, tests = quality_rules.ALPHA / len(rules), sum(len(c) for _, _, c in rules.values())
    grid = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c} AS cut, count(*) AS n, sum(CAST(v_{r} > {c} AS INT)) AS k FROM held GROUP BY stratum" for r, (_, _, cuts) in rules.items() for c in cuts
    )
    tail = (
        f"CASE WHEN k >= n * {share!r} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: "
        f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share!r}) + (n - j) * ln(1 - {share!r})))) END"
    )
    over = " OR ".join(f"coalesce(v_{r} > c.{r}, false)" for r in rules)
    chosen = ", ".join(f"min(cut) FILTER (rule = '{r}') AS {r}" for r in rules)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
    g AS (SELECT r, i, concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g, lead(w, 4) OVER p IS NOT NULL AS whole FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
    u AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE whole),
    v AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM u WHERE c > 1),
    rep AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY r),
    li AS (SELECT r, count(*) AS n, count(DISTINCT l) AS m FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
    s AS (SELECT d.doc_id, d.stratum, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
          coalesce(li.n, 0) AS n_lines, coalesce(li.n - li.m, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
          FROM d LEFT JOIN rep USING (r) LEFT JOIN li USING (r)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {values} FROM s),
    held AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
    grid AS ({grid}),
    ok AS (SELECT stratum, rule, cut FROM grid WHERE {tail} <= {quality_rules.DELTA!r} / ({tests} * (SELECT count(DISTINCT stratum) FROM held))),
    c AS (SELECT stratum, {chosen} FROM ok GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
    FROM f LEFT JOIN c USING (stratum)
    """


@query("op5_quality_rules", quality_sql())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_bpe_codec")
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query(
    "op1_near_dedup",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    c AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0) GROUP BY ALL),
    t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS i FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE i >= 0.8 * (a.n + b.n - i)
          UNION ALL SELECT (SELECT min(doc_id) FROM d WHERE len(ws) = 0), doc_id FROM d WHERE len(ws) = 0),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
    k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
    SELECT a AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, a = class_id AS kept FROM k
    """,
)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def license_sql() -> str:
    """K-grams of numbered words joined with numbered template words, counted by diagonal, merged by gaps."""
    templates = [(t, n, True) for t, n in license_scan.PHRASES.items()] + [(t, n, False) for t, n in license_scan.TEMPLATES.items()]
    values = ", ".join(f"({n}, '{text}', '{label}', {exact})" for n, (text, label, exact) in enumerate(templates))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
    g AS (SELECT r, i, concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p) AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i) QUALIFY lead(w, 2) OVER p IS NOT NULL),
    t AS (SELECT * FROM (VALUES {values}) AS v(t, phrase, label, exact)),
    tw AS (SELECT t, label, exact, string_split(phrase, ' ') AS ws FROM t),
    tg AS (SELECT t, label, exact, len(ws) - 2 AS n, unnest(range(0, len(ws) - 2)) AS j, ws FROM tw),
    tj AS (SELECT t, label, exact, n, j, concat_ws(' ', ws[j + 1], ws[j + 2], ws[j + 3]) AS g FROM tg),
    hit AS (SELECT r, t, label, exact, n, j, i, i - j AS dg FROM g JOIN tj USING (g)),
    dg AS (SELECT DISTINCT r, t, dg FROM hit),
    near AS (SELECT h.r, h.t, dg.dg AS s, label, exact, n, j, min(i) AS i FROM hit h JOIN dg ON dg.r = h.r AND dg.t = h.t AND h.dg BETWEEN dg.dg AND dg.dg + CASE WHEN exact THEN 0 ELSE {license_scan.DRIFT} END GROUP BY ALL),
    chain AS (SELECT *, coalesce(i > max(i) OVER (PARTITION BY r, t, s ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_chain FROM near),
    sp AS (SELECT r, t, label, exact, n, s, count(*) FILTER (on_chain) AS c, min(i) AS a FROM chain GROUP BY ALL),
    b AS (SELECT *, exact AND c = n AS base, c / n AS share FROM sp),
    o AS (SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
          array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
          array_to_string(list_sort(list_distinct(list(label) FILTER (base OR (NOT exact AND share >= {license_scan.SHARE})))), ',') AS labels, max(share) AS score FROM b GROUP BY r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0.0) AS score FROM d LEFT JOIN o USING (r)
    """


@query("op4_license_scan", license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_weak_label_quality")
def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffled(table(spark, sf_dir, "documents"))
    return placed.select("record.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


PLANTED = "\\### Assistant: </turn> ok"


@query(
    "op9_chat_format",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(21 + length(role) + length(text) + len(regexp_extract_all(role, '</?turn>|<text>')) + len(regexp_extract_all(text, '</?turn>|<text>'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    formatted = chat_format.format_conversations(rows.unionByName(planted))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), lines.alias("lines"), chat_format.masked_text().alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", "n_turns", F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@query(
    "op10_substring_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM d, unnest(range(1, len(ws) - 18)) AS t(i)),
    f AS (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
    c AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM f WHERE again),
    w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
    k AS (SELECT w.r, count(c.i) AS gone, string_agg(w, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS kept FROM w LEFT JOIN c ON c.r = w.r AND c.i = w.i GROUP BY w.r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def centroid_sql() -> str:
    """Every vector against every centroid in each round, by components numbered in rows."""
    k, size = centroids.K, centroids.SIZE
    rounds = "".join(
        f"""
    a{n} AS (SELECT r, c, far FROM (SELECT v.r, o.c, sum((v.x - o.x) * (v.x - o.x)) AS far FROM v JOIN o{n} o USING (i) GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1),
    m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY ALL),
    o{n + 1} AS (SELECT o.c, o.i, CASE WHEN m.n IS NULL THEN o.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM o{n} o LEFT JOIN m{n} m ON m.c = o.c AND m.i = o.i),"""
        for n in range(centroids.ROUNDS)
    )
    last = centroids.ROUNDS
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}),
    v AS (SELECT r, unnest(range(1, {size + 1})) AS i, CAST(floor({centroids.SCALE} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM d),
    f AS (SELECT r, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS c FROM d QUALIFY c < {k}),
    o0 AS (SELECT f.c, v.i, v.x FROM f JOIN v USING (r)),{rounds}
    a AS (SELECT r, c, far FROM (SELECT v.r, o.c, sum((v.x - o.x) * (v.x - o.x)) AS far FROM v JOIN o{last} o USING (i) GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1),
    h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM o{last} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a JOIN d USING (r) JOIN h USING (c)
    """


@query("op12_centroid_clustering", centroid_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings")).drop("n_exact")


@query(
    "op13_filter_audit",
    r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
    f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c,
          regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    st AS (SELECT o, k AS step, o[k] AS x, string_split(o[1:k - 1], '') AS before, string_split(o, '') AS every FROM o, unnest(range(1, 6)) AS u(k)),
    g AS (SELECT st.*, m.*, fails[x] AS hit, len(list_filter(before, lambda y: y <> '' AND fails[y])) > 0 AS gone, len(list_filter(every, lambda y: fails[y])) AS n_fails FROM st, m),
    r AS (SELECT part, o AS filter_order, step, x, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant,
          sum(n) FILTER (hit AND n_fails = 1) AS unique_fails, sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost FROM g GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
