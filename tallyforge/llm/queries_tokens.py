"""Queries of BPE encoding and of token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import shared
from tallyforge.llm.bpe import digests
from tallyforge.llm.token_files import read_tokens, write_tokens

TOKENIZER = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(shared.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=1)
    return read_tokens(spark, manifest)
