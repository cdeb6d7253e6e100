"""The queries of this package by name, with SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, importance, lm_score, minhash, oracles, quality, rlz_dedup, spelling, suffix_dedup
from factloom.llm.bpe import op6_bpe
from factloom.llm.chat_tree import op11_chat_tree
from factloom.llm.decontaminate import op10_decontaminate
from factloom.llm.importance import op13_importance
from factloom.llm.language import op4_language
from factloom.llm.lm_score import op3_lm_score
from factloom.llm.minhash import op1_minhash
from factloom.llm.quality import op8_quality
from factloom.llm.rlz_dedup import op5_rlz_dedup
from factloom.llm.secrets import op7_secrets
from factloom.llm.shared import read, spread
from factloom.llm.spelling import op12_spelling
from factloom.llm.suffix_dedup import op2_suffix_dedup
from factloom.llm.token_files import op9_token_files


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that no learned verdict decides, so that SQL can check them."""
    found = quality.judged(quality.statistics(spread(read(spark, sf_dir, "documents", "doc_id", "text"))), [])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_OPERATORS = (op1_minhash, op2_suffix_dedup, op3_lm_score, op4_language, op5_rlz_dedup, op6_bpe, op7_secrets, op8_quality, op9_token_files, op10_decontaminate, op11_chat_tree, op12_spelling, op13_importance)
QUERIES = {f.__name__: f for f in (*_OPERATORS, quality_statistics)}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": oracles.near_duplicates(4, minhash.PERCENT),
    "op2_suffix_dedup": oracles.repeated_bytes(suffix_dedup.SIZE),
    "op3_lm_score": lm_score.SQL,
    "op5_rlz_dedup": oracles.copied_words(rlz_dedup.SIZE),
    "op10_decontaminate": oracles.contaminated(decontaminate.WINDOW),
    "op11_chat_tree": oracles.CHAT,
    "op12_spelling": oracles.spelling(spelling.LENGTH, spelling.COUNT, spelling.RATIO, spelling.RARE),
    "op13_importance": oracles.importance(importance.BUCKETS, importance.PERCENT, importance.LEAST_WORDS, importance.SEED),
    "quality_statistics": oracles.STATISTICS,
}
