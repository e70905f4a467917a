"""The registered queries of the text operators, thin over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import suffix

    return suffix.remove(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import pii

    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.aggregate("base", F.lit(0).cast("long"), _plus_one_if(k)).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def _plus_one_if(kind: int):
    return lambda n, s: n + F.when(s["kind"] == kind, 1).otherwise(0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import bpe

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_config(), with_values=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import chat

    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    row = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    added = spark.range(1).select(F.explode(F.array(row(0, "user"), row(1, "assistant"))).alias("r")).select("r.*")
    formatted = chat.format_trees(chat.from_turns(given.unionByName(added)), keep=1)
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("mask"))
    out = formatted.select(F.when(F.col("tree") != "null", F.substring("tree", 2, 30).cast("long")).alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import neardup

    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import ann

    return ann.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 20 = 0")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import html

    return html.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import langid

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import decontam

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def tokenizer_config(path: str | None = None) -> str:
    """The tokenizer file's contents; its path is a parameter, by default the public 49k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The others are held against brute-force versions, round trips or held-out accuracy in tests/llm."""
    return {"op5_chat": OP5_SQL}


OP5_SQL = r"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
