"""Query of the token-id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import token_files
from tallyshelf.llm.common import shared_folder, table
from tallyshelf.llm.registry import query


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer on this machine; the package is installed on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


# No SQL: the tests encode every text by the library alone.
@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.read(spark, folder).drop("ids")
