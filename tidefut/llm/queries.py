"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str) -> str:
    """A file of the public tokenizers' package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("keep_file", "n_bytes")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import extendible_shards

    return extendible_shards(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with what was asked before it, which bears no loss; few segments and little loss in a sequence."""
    from pyspark.sql import functions as F

    from .packing import pack

    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role <> 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("text").alias("asked"))
    answers = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text", "asked")
    return pack(answers, vocabulary("word_bpe_49k.json"), max_tokens=2048, max_segments=4, max_loss=1024, prompt="asked")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import sequences, trie, with_openings

    return trie(with_openings(sequences(table(spark, sf_dir, "conversations"))))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_middle import fill_in_middle, restore

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.withColumns({"output_sha256": digest(F.col("output")), "restored_sha256": digest(restore(F.col("output"), F.col("form")))}).drop("output")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() or name == "packed_conversations"}


def oracle_sql() -> dict[str, str]:
    from . import fill_middle, prefix_trie, sharding

    return {"op4_exact_dedup": OP4_SQL, "op7_extendible_shards": sharding.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
