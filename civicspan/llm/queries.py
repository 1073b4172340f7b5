"""The corpus operators as registered queries, with their SQL counterparts.

Each query applies its operator to the whole table and derives the columns it returns from the operator's result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspan.llm import (
    bpe,
    chat_format,
    decontamination,
    gru_lm,
    order_minhash,
    pii,
    quality_cascade,
    sharding,
    token_store,
    toxicity,
    vector_codes,
    warc,
    whitening,
)
from civicspan.llm.common import let_workers_import, table, written

SHARDS = 24
SURROGATE_KEY = "registered query"
VOCABULARY = "byte_bpe_50k.json"
#: Components of the whitening that the query returns.
AXES = 4
CATEGORIES = ["low_quality", "toxic"]


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    replaced = pii.replace_entities(table(spark, folder, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", "n_entities", "entity_types")


def op2_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.balanced_shards(table(spark, folder, "documents"), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2("items", 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_gru_lm(spark: SparkSession, folder: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, folder, "documents"))


def op5_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_cascade.quality_report(table(spark, folder, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *names, "base_failed", "kept")


def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


def op7_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")
    )
    scored = toxicity.score(docs, toxicity.train(docs, labels, CATEGORIES))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), vocabulary_path(), decoded="decoded")
    return coded.select(
        "doc_id",
        bpe.n_tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_content_addressed_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_records(spark, warc.write_archive(table(spark, folder, "pages")))


def op10_elias_fano_store(spark: SparkSession, folder: str) -> DataFrame:
    store = token_store.write_store(table(spark, folder, "documents"), vocabulary_path())
    read = token_store.read_documents(spark, store).select(
        "shard", "block", "doc_id", "place", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    placed = read.join(token_store.block_starts(spark, store), ["shard", "block"])
    return placed.select("doc_id", (F.col("block_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors, most=AXES)
    each = whitening.whiten(vectors, model).select(
        F.col("key").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")
    )
    explained = [float(e / model.trace) for e in model.eigenvalues] if model else []
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, explained or [0.0])), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_gnat_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    books = vector_codes.train(vectors)
    coded = written(vector_codes.encode(vectors, books, also="label"), "codes")
    of_label = coded.groupBy(F.col("also").alias("label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(books.as_text().encode()).hexdigest() if books else None
    return coded.join(of_label, F.col("also").eqNullSafe(F.col("label"))).select(
        F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256")
    )


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)
    )
    formatted = chat_format.format_conversations(turns.union(planted))
    read = formatted.select(
        F.col("conversation").alias("conv_id"),
        "formatted",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("segments")).alias("loss"),
    )
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _runs(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        let_workers_import(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_label_propagation": op2_label_propagation,
        "op3_decontamination": op3_decontamination,
        "op4_gru_lm": op4_gru_lm,
        "op5_quality_cascade": op5_quality_cascade,
        "op6_order_minhash": op6_order_minhash,
        "op7_toxicity_chain": op7_toxicity_chain,
        "op8_backtracking_bpe": op8_backtracking_bpe,
        "op9_content_addressed_warc": op9_content_addressed_warc,
        "op10_elias_fano_store": op10_elias_fano_store,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_gnat_vector_codes": op12_gnat_vector_codes,
        "op13_chat_format": op13_chat_format,
    }
    return {name: _runs(query) for name, query in named.items()}


#: Only what SQL can express over whole tables; the others are tested against brute-force versions.
WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), digests AS (
  SELECT page_id, payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM digests
"""

#: The template's lengths: headers and ends of turns, and one character more for each escape but for those that shorten.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(n)
)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') || '</turn>') + 1
    )::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _codes_sql() -> str:
    """Each round assigns all parts to all entries of their codebook and moves the entries."""
    steps = ["""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x,
    len(embedding) // 4 AS width
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), entries AS (
  SELECT vec_id, label, (i // width)::INTEGER AS part, (i % width)::INTEGER AS pos, x[i + 1] AS v
  FROM (SELECT *, unnest(range(len(x))) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, (dense_rank() OVER (ORDER BY vec_id) - 1)::INTEGER AS entry, pos, v
  FROM entries WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""]
    for k in range(5):
        steps.append(f"""apart{k} AS MATERIALIZED (
  SELECT vec_id, part, entry, sum((e.v - b.v) * (e.v - b.v))::BIGINT AS far
  FROM entries e JOIN book{k} b USING (part, pos) GROUP BY vec_id, part, entry
), home{k} AS MATERIALIZED (
  SELECT vec_id, part, min((far, entry))[2] AS entry, min(far) AS far FROM apart{k} GROUP BY vec_id, part
)""")
        if k < 4:
            steps.append(f"""mean{k} AS (
  SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
  FROM entries JOIN home{k} USING (vec_id, part) GROUP BY part, entry, pos
), book{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos)
)""")
    steps.append("""coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM home4 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
""")
    return ", ".join(steps)


def oracle_sql() -> dict[str, str]:
    return {
        "op9_content_addressed_warc": WARC_SQL,
        "op12_gnat_vector_codes": _codes_sql(),
        "op13_chat_format": CHAT_SQL,
    }
