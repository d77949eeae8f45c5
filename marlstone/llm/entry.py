"""The driver contract's queries for this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.session import table as _table

from . import jaccard_join as _jaccard
from . import line_dedup as _lines
from . import substring_dedup as _substrings
from . import topk_search as _topk
from . import toxicity as _toxic
from . import url_filter as _urls
from .decontaminate import find_leaks
from .jaccard_join import jaccard_groups
from .license_scan import license_scan
from .piece_bpe import encode_decode
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk.topk_search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = _toxic.learn(docs, _table(spark, sf_dir, "labels"), ~_toxic.held_out(F.col("id")))
    out = _toxic.score_texts(docs, lexicon)
    return out.select("doc_id", _toxic.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= _toxic.THRESHOLD).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lines.line_dedup(_table(spark, sf_dir, "documents"))
    lines, removed = out.columns[-2:]
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed"), _sha256("text").alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.url_filter(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), batches=2)
    return out.select("doc_id", "n_words", "n_removed", _sha256("text").alias("kept_sha256"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", _sha256("ids").alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_decontaminate": op2_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op8_token_files": op8_token_files,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": _topk.ORACLE_SQL,
    "op3_line_dedup": _lines.ORACLE_SQL,
    "op4_substring_dedup": _substrings.ORACLE_SQL,
    "op7_url_filter": _urls.ORACLE_SQL,
    "op10_jaccard_join": _jaccard.ORACLE_SQL,
}
