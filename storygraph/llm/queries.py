"""The queries of this subpackage and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from storygraph.llm import bpe, bytes_dedup, collocations, conversations, language_id, line_dedup, mixing, near_dedup, ngram_join, pii, quality, top_k, word_dedup


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_substring_dedup": word_dedup.op3_substring_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_suffix_dedup": bytes_dedup.op8_suffix_dedup,
    "op9_top_k": top_k.op9_top_k,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_collocations": collocations.op12_collocations,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES = {
    "op3_substring_dedup": word_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op8_suffix_dedup": bytes_dedup.ORACLE,
    "op9_top_k": top_k.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_ngram_join": ngram_join.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
