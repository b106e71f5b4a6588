"""The operators as queries over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import chat, chat_repair, collocations, line_dedup, mixing
from tablewright.llm.common import table
from tablewright.llm.decontaminate import find_leaks
from tablewright.llm.jaccard_join import near_duplicates
from tablewright.llm.neighbours import nearest
from tablewright.llm.private_data import find_private
from tablewright.llm.secrets import scan_secrets
from tablewright.llm.suffix_dedup import dedupe_substrings
from tablewright.llm.token_counts import count_tokens
from tablewright.llm.toxicity import fit_classifier, score_toxicity
from tablewright.session import small_table

ORACLES: dict[str, str] = {}


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed patterns and what the random field adds."""
    return scan_secrets(table(spark, folder, "documents"), "text", "doc_id", keep=["doc_id"])


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, repeated towards weights that follow size ** 0.7, shuffled."""
    return mixing.mix_sources(table(spark, folder, "documents"), "doc_id", "source", "text")


ORACLES["op2_mix_sources"] = mixing.SQL.format(documents="documents")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a copy, exact or edited."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = find_leaks(docs, "text", items, "item_id", "text", keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    return dedupe_substrings(table(spark, folder, "documents"), "doc_id", "text")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, formatted and read back; conversation -1 tries control strings."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = small_table(spark, [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.read_back(chat.format_turns(own.unionByName(more), path), path))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without lines that 10 or more sources hold."""
    cleaned = line_dedup.remove_boilerplate(table(spark, folder, "documents"), "doc_id", "text", "source")
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op6_line_dedup"] = line_dedup.SQL.format(documents="documents") + """
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def held_out(key: str = "doc_id") -> Column:
    """The fold that no label may be learned from; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document, learned outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_classifier(docs, labels, "doc_id", "text", "toxic", ~held_out())
    scored = score_toxicity(docs, "text", model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity from 0.8."""
    return near_duplicates(table(spark, folder, "documents"), "doc_id", "text")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the byte-level BPE."""
    return count_tokens(table(spark, folder, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors of every 50th one."""
    return nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of 2 to 4 words of every language."""
    return collocations.mine_phrases(table(spark, folder, "documents"), "text", "lang")


ORACLES["op11_collocations"] = collocations.SQL.format(documents="documents")


def op12_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and identifiers that their contexts reveal."""
    return find_private(table(spark, folder, "documents"), "text", keep=["doc_id"])


def op13_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by a hash of their turns and repaired by the cheapest edits."""
    columns = ["conv_id", "turn", "role", "text"]
    return chat_repair.repair(chat_repair.damage(table(spark, folder, "conversations"), *columns), *columns)


ORACLES["op13_chat_repair"] = chat_repair.sql("conversations")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after all stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_decontaminate, op4_suffix_dedup, op5_chat_format, op6_line_dedup, op7_toxicity, op8_jaccard_join, op9_token_counts, op10_nearest_neighbours, op11_collocations, op12_private_data, op13_chat_repair, pipeline)}
