"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from livetick.llm import (
    arc, bag_rank, block_knn, bpe_stream, chosen_path, dac, decontaminate, hilbert_shards, html_trees, kn_lm, quality_qda, token_alignment,
    toxic_kn,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        hilbert_shards.op1_hilbert_shards, chosen_path.op2_chosen_path_join, dac.op3_dac_token_file, bpe_stream.op4_bpe_stream,
        block_knn.op5_block_knn, quality_qda.op6_quality_qda, html_trees.op7_html_trees, decontaminate.op8_qgram_decontamination,
        toxic_kn.op9_toxic_kneser_ney, kn_lm.op10_kneser_ney_lm, arc.op11_arc_to_warc, bag_rank.op12_bag_ranking,
        token_alignment.op13_token_alignment,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of the queries SQL can express; crc32, hashes of sets, tokenizers and fitted models are compared by brute force."""
    return {"op11_arc_to_warc": arc.ORACLE_SQL, "op12_bag_ranking": bag_rank.ORACLE_SQL}
