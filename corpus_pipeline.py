"""The corpus pipeline: its stages, each applied to what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.llm import corpus, decontamination, pii, quality, sentencepiece_bpe


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on trusted labels doesn't reject.

    Empty and null texts, and languages without trusted text, can't be judged and stay; repeated rows are judged alike and all stay or go;
    a perplexity of just the threshold stays; an empty table gives an empty one. Extra columns are kept, whatever their names."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays (null last; of equal ids the smallest hash of the text). Null and empty texts are one group; of rows that repeat in id
    and text one stays; an empty table gives an empty one. Extra columns are kept, whatever their names."""
    return corpus.one_of_each_group(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item.

    Null and empty texts have no words and stay; repeated rows all stay or go; an empty benchmark or table removes nothing. Extra columns are
    kept, whatever their names."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, plain or disguised, replaced by its kind.

    Null texts stay null, and n_chars is null with them; every row stays, repeated ones too; findings that overlap are replaced as one, by the
    kind that begins first. Extra columns are kept, whatever their names."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text decoded from them.

    Null texts count as empty and have no tokens; repeated rows are each encoded; an empty table gives an empty one. Columns of documents
    but doc_id, lang and source are left out."""
    import public_tokenizers

    out = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_redaction),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
#: The stages can't be expressed in SQL; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the documents are written to the shared folder and read again."""
    from trivalent.llm.common import new_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = new_folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
