"""The corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return the columns of ``documents`` and any others that it has, whatever their names.

Defined results, for every stage: an empty table gives no rows. Null and empty texts are clean,
have no lines, no copies and no passages, and are encoded as the end id alone. Rows with a null
id pass every stage; rows that repeat an id are each judged by their texts, but for the near
copies, where an id counts as one document and its rows stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import toxicity
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.jaccard_join import BROADCAST_IDS, jaccard_groups
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.piece_bpe import encode_decode
from marlstone.llm.workspace import materialise
from marlstone.sources.session import table

#: Words of a shingle and similarity in hundredths of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of held-out rows are not learned from."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("id")))
    return toxicity.keep_clean(docs, lexicon)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a large part of their source repeats."""
    kept = line_dedup(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    groups = jaccard_groups(docs, width=SHINGLE, percent=PERCENT)
    copies = materialise(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and how many, end id included."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: SQL has no word for the first stage's model nor for the last one's encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
