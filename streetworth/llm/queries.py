"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetworth.llm import quality
from streetworth.llm._common import save, table
from streetworth.llm.chat import digests
from streetworth.llm.hard_negatives import hard_negatives
from streetworth.llm.importance import resample
from streetworth.llm.language import fold, identify, train
from streetworth.llm.license_scan import scan_licenses
from streetworth.llm.mixing import mix
from streetworth.llm.ngram_join import ngram_jaccard
from streetworth.llm.packing import pack
from streetworth.llm.pii import BASE, find_pii, listed
from streetworth.llm.suffix_dedup import dedup_substrings
from streetworth.llm.vectors import near_vectors, top_k

#: Weights of domains and languages (others and all sources: 1).
MIX_WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 2.0}, "lang": {"en": 2.0}}
MIX_SHARE = 0.8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def domain() -> Column:
    """Four domains, from the last digit of a source's name."""
    return F.concat(F.lit("domain"), (F.substring("source", -1, 1).try_cast("int") % 4).cast("string"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by the shrinkage discriminant, learnt from labelled documents of the other folds. Repeated rows are scored each and count each; a doc_id labelled twice counts twice; without labels of both kinds every score is the same. An empty table gives no rows."""
    measured = save(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(measured.join(labels, "doc_id"))
    scored = quality.score(measured, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the other folds' texts and non-null languages. Without a learnt language, null texts and texts without a letter: `und`, 0. Repeated rows are judged each. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_spans").alias("lang_spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text, as counts by kind, the digest of the base spans, and all spans. A null text is empty; repeated rows are searched each. An empty table gives no rows."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near vectors within each label (see near_vectors)."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2,048 tokens (see pack)."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for a corpus of the target weights, in at most two epochs (see mix)."""
    mixed = mix(table(spark, sf_dir, "documents"), domain(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=2)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th one (see top_k)."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and statements in every whole text (see scan_licenses)."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that lie in a repeated string of 400 bytes, and what is left without them (see dedup_substrings)."""
    return dedup_substrings(table(spark, sf_dir, "documents"), length=400)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by five-word shingles: each document's set size and component (see ngram_jaccard)."""
    return ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back (see format_chats, read_back). A row is a message event at the place of its turn, so repeated rows are turns each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(own)
    return digests(rows.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every 100th vector; labels of vectors divisible by 7 are moved on first (see hard_negatives)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words, drawn to follow the benchmark's words (see resample)."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_near_vectors": op4_near_vectors,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_top_k": op7_top_k,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_chat_format": op11_chat_format,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance": op13_importance,
}

def _fill_sql(level: str, parents: str, budget: str, source: str, weight: str) -> str:
    """One level of the tree: room, weight, and what the water level gives each node."""
    by = f"PARTITION BY {parents}" if parents else ""
    columns = f"{parents}, {level}" if parents else level
    order = f"({by} ORDER BY CASE WHEN w > 0 THEN room / w ELSE -1e0 END, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""w_{level} AS (SELECT {columns}, {budget} AS budget, {weight} AS w, CASE WHEN {weight} > 0 THEN room ELSE 0 END AS room FROM {source}),
l_{level} AS (SELECT *, CASE WHEN w > 0 THEN (budget - (sum(room) OVER {order} - room)) / (sum(w) OVER ({by}) - sum(w) OVER {order} + w) END AS level FROM w_{level}),
g_{level} AS (SELECT {columns}, least(CAST(room AS DOUBLE), coalesce(max(level) OVER ({by}), 0e0) * w) AS given FROM l_{level})"""


def _weight_sql(level: str) -> str:
    return "CASE " + "".join(f"WHEN {level} = '{k}' THEN {v}e0 " for k, v in MIX_WEIGHTS.get(level, {}).items()) + "ELSE 1e0 END" if MIX_WEIGHTS.get(level) else "1e0"


_MIXING = f"""WITH d AS (SELECT doc_id, lang AS own_lang, source AS own_source, coalesce('domain' || CAST(TRY_CAST(right(source, 1) AS INTEGER) % 4 AS VARCHAR), '?') AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
t AS (SELECT * FROM d WHERE n > 0), leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * 2 AS room FROM t GROUP BY 1, 2, 3), langs AS (SELECT domain, lang, sum(room) AS room FROM leaves GROUP BY 1, 2), domains AS (SELECT domain, sum(room) AS room FROM langs GROUP BY 1), total AS (SELECT sum(tokens) AS tokens FROM leaves),
{_fill_sql("domain", "", f"tokens * {MIX_SHARE}e0", "domains, total", _weight_sql("domain"))}, in_lang AS (SELECT l.*, given FROM langs l JOIN g_domain USING (domain)), {_fill_sql("lang", "domain", "given", "in_lang", _weight_sql("lang"))},
in_source AS (SELECT l.*, given FROM leaves l JOIN g_lang USING (domain, lang)), {_fill_sql("source", "domain, lang", "given", "in_source", _weight_sql("source"))},
plan AS (SELECT domain, lang, source, CAST(floor(given) AS BIGINT) AS given, tokens FROM g_source JOIN leaves USING (domain, lang, source)), p AS (SELECT *, CAST(given // tokens AS BIGINT) AS whole, CAST(given % tokens AS BIGINT) AS rest FROM plan WHERE given > 0),
r AS (SELECT t.*, whole, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '17', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), n) - n AS before FROM t JOIN p USING (domain, lang, source)),
e AS (SELECT *, unnest(range(whole + 1)) AS epoch FROM r), k AS (SELECT *, CASE WHEN epoch < whole THEN n ELSE least(n, greatest(0, rest - before)) END AS taken FROM e)
SELECT doc_id, domain, own_lang AS lang, own_source AS source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(taken AS BIGINT) AS taken FROM k WHERE taken > 0"""

SQL: dict[str, str] = {
    "op7_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.w, x.w) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_near_vectors": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93e0), reach AS (SELECT a AS x, a AS y FROM links UNION SELECT x, b FROM reach JOIN links ON y = a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1) SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.x = vec_id""",
    "op6_mixing": _MIXING,
    "op10_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w), n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2), links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS x, a AS y FROM links UNION SELECT x, b FROM reach JOIN links ON y = a), c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1) SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id FROM n LEFT JOIN c ON x = doc_id""",
    "op9_suffix_dedup": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), c AS (SELECT doc_id, n, s, substr(h, 2 * s + 1, 2798) AS part FROM h, unnest(range(0, greatest(n - 399, 0), 1000)) t(s)),
w AS (SELECT doc_id, s + i AS pos, md5(substr(part, 2 * i + 1, 800)) AS k FROM c, unnest(range(0, least(1000, n - 399 - s))) u(i)), hit AS (SELECT doc_id, pos FROM w JOIN (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1) USING (k)),
b AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400 THEN 1 ELSE 0 END AS new FROM hit), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b), spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 400 AS z FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans), cut AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM o JOIN h USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)""",
    "op12_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.w, x.w) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op11_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
m AS (SELECT *, len(text) + (len(text) - len(replace(text, '\', ''))) + (len(text) - len(replace(text, '<turn>', ''))) // 6 + (len(text) - len(replace(text, '</turn>', ''))) // 7 AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(role) + body + 15) AS BIGINT) AS formatted_chars FROM m GROUP BY 1""",
    "op13_importance": r"""WITH RECURSIVE step AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT r, unnest(w) AS f FROM d), b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
h AS (SELECT f, xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1:2 * i])::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM (SELECT f FROM e UNION SELECT f FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (f) GROUP BY 1), n AS (SELECT (SELECT count(*) FROM e) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT r, sum(gain) AS weight FROM e JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM o LEFT JOIN k USING (r)""",
}
