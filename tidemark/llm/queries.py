"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import best_fit, divergence, fill_in_middle, imatch, jaccard_join, langid, materialise, mixing, packing, quality, token_counts, topk_search, toxicity
from tidemark.llm.common import fold, table
from tidemark.session import shared_dir

BYTE_BPE, PIECE_BPE, WORD_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"

LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"crawl": 3, "reference": 5, "forum": 2}, "lang": {"en": 6, "de": 2, "*": 1}, "source": {"src1": 3, "*": 1}}
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'reference' ELSE 'forum' END"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=1024)


def op3_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return materialise.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), folder, key="tidemark-1")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, p = langid.train(docs.filter(fold(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), names, p)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, known)
    found = quality.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    found = mixing.mix(docs, LEVELS, WEIGHTS, share=0.8, epochs=3, seed="mix-1", tokens=mixing.word_count(F.col("text")), then=F.md5(F.coalesce("text", F.lit(""))))
    return found.select("doc_id", "domain", "lang", "source", "tokens", "leaf_budget", "copies", "part_tokens")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, known)
    found = toxicity.score(docs.select("doc_id", "text"), model, threshold=0.7)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "clauses")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(PIECE_BPE), limit=4096)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs, rate=100, spm=50, seed="7:"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=4096, end_id=1)


def queries() -> dict:
    import corpus_pipeline

    found = (op1_jaccard_join, op2_packing, op3_materialise, op4_language_id, op5_quality, op6_topk, op7_mixing, op8_toxicity, op9_token_counts, op10_imatch, op11_fill_in_middle, op12_divergence, op13_best_fit)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM (SELECT doc_id, string_agg(s, chr(1) ORDER BY s) AS k FROM shingles GROUP BY doc_id)),
reps AS (SELECT s.doc_id, s.s, n FROM shingles s JOIN classes c USING (doc_id) JOIN sizes USING (doc_id) WHERE c.rep = s.doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node),
labels_ AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(l.c, k.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN classes k USING (doc_id) LEFT JOIN labels_ l ON l.node = k.rep
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


FILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
h AS (SELECT *, CAST(len(l) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 2)) // (y.n + 2 * v.v) AS q FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL) x
  JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) y ON y.lang = x.lang JOIN v ON v.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT 'term', p.lang, p.source, p.term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""


def mixing_sql(share: float = 0.8, epochs: int = 3, seed: str = "mix-1") -> str:
    """The same budgets and prefixes level by level, on whole tables."""

    def weight(level: str) -> str:
        own = WEIGHTS[level]
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in own.items() if k != "*") + f" ELSE {own.get('*', 1)} END"

    parts = [
        f"docs AS (SELECT doc_id, {DOMAIN} AS domain, lang AS own_lang, source AS own_source, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, "
        r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS tie FROM documents)",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap FROM docs GROUP BY ALL)",
        f"b0 AS (SELECT least(sum(cap), CAST(floor(sum(tokens) * {share}::DOUBLE) AS BIGINT)) AS budget FROM leaves)",
    ]
    for i, level in enumerate(LEVELS, 1):
        up, node = ", ".join(LEVELS[: i - 1]), ", ".join(LEVELS[:i])
        by = f"PARTITION BY {up}" if up else ""
        parts += [
            f"n{i} AS (SELECT x.*, budget FROM (SELECT {node}, CAST(sum(cap) AS HUGEINT) AS cap, CAST({weight(level)} AS HUGEINT) AS w FROM leaves GROUP BY {node}) x " + (f"JOIN b{i - 1} USING ({up}))" if up else "CROSS JOIN b0)"),
            f"o{i} AS (SELECT *, coalesce(sum(cap) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(w) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af FROM n{i} WINDOW a AS ({by} ORDER BY cap / w, {level}))",
            f"f{i} AS (SELECT *, cap * af + bf * w <= budget * w AS fl FROM o{i})",
            f"g{i} AS (SELECT *, coalesce(sum(CASE WHEN fl THEN cap END) OVER (p), 0) AS taken, sum(CASE WHEN NOT fl THEN w END) OVER (p) AS opn FROM f{i} WINDOW p AS ({by}))",
            f"b{i} AS (SELECT {node}, CAST(CASE WHEN fl THEN cap ELSE least(cap, CAST(w * (budget - taken) AS HUGEINT) // CAST(opn AS HUGEINT)) END AS BIGINT) AS budget FROM g{i})",
        ]
    parts += [
        "plan AS (SELECT domain, lang, source, leaves.tokens AS leaf_tokens, budget AS leaf_budget, CASE WHEN leaves.tokens > 0 THEN budget // leaves.tokens ELSE 0 END AS epoch FROM leaves JOIN b3 USING (domain, lang, source))",
        f"placed AS (SELECT docs.*, leaf_budget, epoch, leaf_budget - epoch * leaf_tokens AS rest, md5('{seed}:' || epoch || ':' || doc_id) AS place FROM docs JOIN plan USING (domain, lang, source))",
        "ahead AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, tokens, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, own_lang AS lang, own_source AS source, tokens, leaf_budget, CAST(epoch + CASE WHEN ahead < rest AND ahead + tokens <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies, CAST(CASE WHEN ahead < rest AND ahead + tokens > rest THEN rest - ahead ELSE 0 END AS BIGINT) AS part_tokens FROM ahead"


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op1_jaccard_join": JACCARD_SQL, "op6_topk": TOPK_SQL, "op7_mixing": mixing_sql(), "op11_fill_in_middle": FILL_SQL, "op12_divergence": DIVERGENCE_SQL} | own
