"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, bpe, chat, fingerprint, gif, jaccard, language, mixing, quality, secrets, vectors, warc
from .tables import shared_path, table, text_of


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as GIF payloads, stored, read back and described. Null texts are empty; repeated rows stay; an empty table gives none."""
    return gif.read_payloads(gif.store_texts(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts and what they decode to, as digests. Null texts are empty; repeated rows stay; an empty table gives none."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses. Null texts are empty."""
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.spelled(F.col("samples")).alias("fingerprint"),
        fingerprint.spelled(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all texts: counts of the base kinds, and all spans. Null texts are empty."""
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda s: s["ord"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": count(kind) for kind, *_ in secrets.BASE}
    return found.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("found")).alias("spans"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted one, formatted and read back. Null texts are empty."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], rows.schema)
    messages = chat.conversation_trees(rows.unionByName(more))
    ids = F.expr("try_cast(tree as long)").alias("conv_id")
    read = chat.read_formatted(chat.chat_conversations(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        ids, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts, learnt from labels that aren't held out. Null and empty texts have a score too."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = quality.held_out(4, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


OP5_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn:') + length('|>' || chr(10)) + length('<|end|>' || chr(10))
    + length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '[', '\\k'))
    + length(replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '[', '\\k')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive that holds each payload once, and read back. Null html is an empty payload."""
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS digest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM d
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all documents takes of each; null texts have size 0, a null source comes last."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learnt from documents that aren't held out; und where a text has no letter or is null."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    held = quality.held_out(3, 1)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are alike from 0.9; texts without words are alone."""
    return jaccard.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90).drop("text_key")


OP10_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) END AS s FROM said),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.b, r.r FROM reached r JOIN sides s ON s.a = r.doc_id WHERE r.r < s.b),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""



def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings by cosine, from 0.9."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 0.9)


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS i, embedding::DOUBLE[] AS e, len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS fit FROM embeddings),
u AS (SELECT vec_id, i, e FROM v WHERE fit),
links AS (SELECT x.i AS a, y.i AS b, y.vec_id AS id FROM u x JOIN u y ON x.i <> y.i AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reached(i, r) AS (SELECT i, i FROM v UNION SELECT l.b, r.r FROM reached r JOIN links l ON l.a = r.i),
least AS (SELECT reached.i, min(v.vec_id) AS component_id FROM reached JOIN v ON v.i = reached.r GROUP BY reached.i)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.i) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least USING (i)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts by a byte-level BPE (A) and by a sentencepiece model (B), aligned."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, in every order."""
    failed = audit.failures(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return audit.interactions(failed, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP13_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM said),
says AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS failed FROM w LEFT JOIN says USING (doc_id)),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(l) WHERE length(o) < 5 AND NOT contains(o, l)),
steps AS (SELECT o, s, 1 << (ord(o[s]) - 65) AS bit, list_sum(list_transform(range(1, s), lambda i: 1 << (ord(o[i]) - 65))) AS seen FROM orders, range(1, 6) t(s) WHERE length(o) = 5),
sets AS (SELECT part, failed, good, toxic, count(*) AS n FROM docs GROUP BY ALL),
found AS (SELECT *, failed & bit <> 0 AS fails, failed & coalesce(seen, 0)::INT = 0 AS here FROM sets, steps)
SELECT part, o AS filter_order, s::INT AS step, coalesce(sum(n) FILTER (here AND NOT fails), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (here AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (NOT here AND fails), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (here AND fails AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (here AND fails AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(failed), 1)) FILTER (fails), 0)::BIGINT AS shapley FROM found GROUP BY ALL
"""

QUERIES = {
    "op1_gif": op1_gif,
    "op2_bpe": op2_bpe,
    "op3_fingerprint": op3_fingerprint,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_jaccard": op10_jaccard,
    "op11_vectors": op11_vectors,
    "op12_alignment": op12_alignment,
    "op13_audit": op13_audit,
}
ORACLES = {"op5_chat_format": OP5_SQL, "op7_warc": OP7_SQL, "op10_jaccard": OP10_SQL, "op11_vectors": OP11_SQL, "op13_audit": OP13_SQL}
