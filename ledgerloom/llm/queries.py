"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, cover_dedup, mixing, ngram_join, pii, quality_crf, secret_scan, sentencepieces, sharding, topk, toxicity, variants, warc
from ledgerloom.llm.spans import count_kind, digest, of_kinds
from ledgerloom.llm.tables import read

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, folder: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Two best segmentations of every document: pieces, score, checksum of the ids, loss of the second."""
    done = sentencepieces.encoded(
        read(spark, folder, "documents"),
        sentencepieces.vocabulary(model_path),
        ["doc_id"],
        n_best=2,
        add=["n_pieces", "score", "ids_crc32", "alternatives", "round_trip"],
    )
    return done.select("doc_id", "n_pieces", "score", "ids_crc32", F.try_element_at("alternatives", F.lit(1))["loss"].alias("second_loss"), "round_trip")


def op2_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards with counts at most one apart; ``grown_shard`` belongs to another law and is null."""
    placed = sharding.balanced_shards(read(spark, folder, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = pii.with_pii(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    spans = F.col("pii_spans")
    return docs.select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(digest(of_kinds(spans, pii.BASE_KINDS)), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return cover_dedup.cosine_components(read(spark, folder, "embeddings"))


def op7_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5)


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = secret_scan.with_secrets(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    return docs.select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(digest(of_kinds(spans, secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.with_severity(docs, toxicity.train(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", "toxic_probability", "expected_severity", "grade", (F.col("toxic_probability") >= toxicity.REJECT).alias("rejected"))


def op10_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = quality_crf.quality(docs, quality_crf.train(docs, read(spark, folder, "labels")))
    predicted = (F.col("score") >= quality_crf.PREDICT_FROM).cast("int")
    return scored.select("doc_id", quality_crf.held_out().alias("held_out"), "score", predicted.alias("predicted"), "n_lines", "n_bad_lines")


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of a package, read back: size, digest and role of each."""
    manifest = warc.write_packages(read(spark, folder, "pages"))
    found = warc.read_packages(manifest, payload=False)
    page = F.col("page_id").cast("long").alias("page_id")
    return found.select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(read(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_balanced_shards,
        op3_pii,
        op4_ngram_join,
        op5_mixing,
        op6_cover_tree,
        op7_uniform_threshold,
        op8_secrets,
        op9_toxicity,
        op10_quality_crf,
        op11_warc,
        op12_variants,
        op13_collocations,
    )
}

ORACLES: dict[str, str] = {
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
               ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
        FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION
    SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
""",
    "op6_cover_tree": """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
r AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION
    SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT c.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
""",
    "op7_uniform_threshold": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.c) = len(d.c))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN response_id IS DISTINCT FROM page_id AND response_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response_id IS DISTINCT FROM page_id THEN response_id END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
""",
    "op12_variants": r"""
WITH RECURSIVE t AS (
    SELECT list(c ORDER BY i) AS crcs FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
        ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END))),
        lambda a, b: xor(a >> 8, crcs[xor(a & 255, b) + 1]))) AS h FROM runs, t),
w AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS wild, left(word, i - 1) || substr(word, i + 1) AS cut
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.wild = b.wild AND a.word <> b.word
    UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.cut
    UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.cut),
b AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM near GROUP BY word),
f AS (
    SELECT w.word, min(near.other) AS form, b.best_n AS form_n FROM w JOIN b ON b.word = w.word AND b.best_n >= 10 * w.n
    JOIN near ON near.word = w.word AND near.n = b.best_n GROUP BY w.word, b.best_n),
r AS (
    SELECT word, word AS root, 0 AS steps FROM w UNION ALL
    SELECT r.word, f.form, r.steps + 1 FROM r JOIN f ON f.word = r.root)
SELECT w.word, f.form, r.root, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN f ON f.word = w.word
JOIN (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word) r ON r.word = w.word
""",
    "op13_collocations": r"""
WITH p AS (
    SELECT doc_id, lang, piece, row_number() OVER () AS id FROM (
        SELECT doc_id, coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
ws AS (SELECT lang, id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, id, unnest(w) AS w1, unnest(range(len(w))) AS i FROM ws),
s AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f1 AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS n FROM s GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS n FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS n FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (
    SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.n AS a, x.n AS l, y.n AS r, 1000000 * f2.n * f2.n // (x.n * y.n) AS score
    FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.n >= 50 * f2.n)
      AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.n >= 50 * f2.n)),
c3 AS (
    SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.n AS a, x.n AS l1, yz.n AS r1, xy.n AS l2, z.n AS r2,
           1000000 * f3.n * f3.n // (x.n * yz.n) AS s1, 1000000 * f3.n * f3.n // (xy.n * z.n) AS s2
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
    JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3),
c AS (
    SELECT * FROM c2 UNION ALL
    SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, k.phrase, CAST(k.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n,
       CAST(score AS BIGINT) AS score
FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
""",
}
ORACLES = {name: sql.strip() for name, sql in ORACLES.items()}
