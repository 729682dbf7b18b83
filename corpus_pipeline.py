"""The corpus pipeline: each stage works on what the one before kept, written as Parquet and reread.

1. language ID: documents in no learned language go (fitted on the labelled documents);
2. exact dedup: of equal texts the smallest id stays;
3. n-gram Jaccard join: one document of each group of near copies stays. Near copies have
   five-word shingles and a similarity of 0.8 or more here;
4. benchmark decontamination: documents with a twentieth of their words in benchmark windows go;
5. SentencePiece: the pieces of what is left.

All but the last return the columns of documents. ORACLE_SQL is None: SQL can't express
the first stage's model or the last one's encoding. The tests hold the stages between
against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.common import stage, table
from panelwright.llm.decontaminate import decontaminate
from panelwright.llm.exact_dedup import exact_dedup
from panelwright.llm.jaccard_join import near_dedup
from panelwright.llm.language_id import fit, keep_known
from panelwright.llm.sentence_pieces import encode_pieces

#: Near copies: similarity in hundredths, and words of a shingle.
NEAR, SHINGLE = 80, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that the labelled ones teach, or without a letter."""
    return keep_known(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the smallest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep the smallest id."""
    return near_dedup(docs, num=NEAR, den=100, size=SHINGLE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a twentieth of their words in benchmark windows."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; the last stage, so its columns are documents' and the pieces."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=docs.columns)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmark),
    ("SentencePiece", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
