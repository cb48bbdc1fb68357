"""A corpus pipeline of five stages, each with one of the corpus operators over all that its predecessor kept.

``run(spark, sf_dir)`` writes each stage's rows as Parquet to the shared folder and reads them again for the next.

Odd rows: empty tables give no rows in every stage; texts are whole, however long; documents with columns beyond those of the
driver's table keep them up to the last stage; what null ids, null and empty texts, ties and repeated rows give stands with each
stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold toxic (its score is under one half).

    Null and empty texts have the score of the bias and a null id is scored like any other; repeated rows go or stay together;
    without labels all stay."""
    from editlens.llm.toxicity import without_toxic

    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (5-word shingles, similarity of 0.8 or more).

    Null and empty texts are copies of nothing and stay, as do rows of a null id; of rows that repeat id and text one stays,
    and rows of one id with different texts all stay if their id does; a similarity of just 0.8 makes a copy."""
    from editlens.llm.near_dedup import distinct_documents

    return distinct_documents(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of the smallest id only.

    Null and empty texts and rows of a null id stay as they are; repeats between rows of one id aren't cut; a document of which
    no word is left goes."""
    from editlens.llm.substring_dedup import without_repeats

    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (13 words, or a whole shorter item, four fifths of them equal).

    Null and empty texts stay, whatever their id; repeated rows go or stay together; null and empty items, and those under five
    words, mark nothing."""
    from editlens.llm.decontaminate import without_contaminated

    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, and whether decoding the ids gives the text again (``restored``).

    Null and empty texts have no ids; null ids stay null; repeated rows are encoded alike."""
    import public_tokenizers

    from editlens.llm.byte_bpe import tokens_of

    return tokens_of(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: No SQL: the classifier and the tokenizer can't be said in it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        out = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = out
    return docs
