"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import ann, bpe, chat, extraction, language, media, mixing, repair, secret_scan, shards, simhash, url_filter, yinyang
from gleaner.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat.digest(turns.unionByName(own))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, bits=2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.digest(table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_shards": op2_shards,
    "op3_bpe": op3_bpe,
    "op4_urls": op4_urls,
    "op5_chat": op5_chat,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_extract": op11_extract,
    "op12_repair": op12_repair,
    "op13_yinyang": op13_yinyang,
}

ORACLE: dict[str, str] = {"op2_shards": shards.ORACLE_SQL, "op5_chat": chat.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op11_extract": extraction.ORACLE_SQL, "op12_repair": repair.ORACLE_SQL, "op13_yinyang": yinyang.ORACLE_SQL}
