"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import oracles
from fleetspark.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.html_extraction import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 512)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.fingerprints import edited_versions

    return edited_versions(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm import quality, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, toxicity.learnable(table(spark, sf_dir, "labels"), "quality"))
    return quality.judge(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept")


#: The rules that the query applies.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.urls import Rule, url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), tuple(Rule(*r) for r in URL_RULES))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.pieces import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.chat import chat_digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    extra = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_digests(turns.unionByName(extra))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetspark.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES = (op1_toxicity, op2_ngram_jaccard_join, op3_html_extraction, op4_token_counts, op5_fingerprints, op6_quality_rules, op7_url_filters, op8_sentencepiece, op9_packing, op10_chat_format, op11_decontamination, op12_phrases, op13_source_divergence)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op10_chat_format": CHAT_SQL, "op11_decontamination": oracles.DECONTAMINATION_SQL, "op12_phrases": oracles.PHRASE_SQL, "op13_source_divergence": oracles.DIVERGENCE_SQL}


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), moves AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS is_last,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text_written,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS role_written
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ') + length(role_written) + 1 + length(text_written) + length('</turn>') + 1)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN before = 'system' THEN role = 'user'
                WHEN before = 'user' THEN role = 'assistant'
                WHEN before = 'assistant' THEN role = 'user' ELSE false END
           AND (NOT is_last OR role = 'assistant')) AS valid
FROM moves GROUP BY conv_id
"""
