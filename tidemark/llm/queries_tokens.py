"""Queries of the operators that write and arrange token ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import packing, planes, token_links
from tidemark.llm._shared import documents


def op2_bit_planes(spark, sf_dir):
    path = planes.new_path(spark)
    planes.write(documents(spark, sf_dir), path)
    return planes.read_documents(spark, path).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op7_curve_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op12_token_links(spark, sf_dir):
    import public_tokenizers

    return token_links.scored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_token_links": op12_token_links, "op2_bit_planes": op2_bit_planes, "op7_curve_packing": op7_curve_packing}
ORACLE_SQL: dict[str, str] = {}
