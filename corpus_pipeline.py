"""From raw documents to token files: filter, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from folioscope.llm.common import store, table, word_count
from folioscope.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from the labelled ones that are not held out, does not reject.

    Each row is judged by its own text, with or without a doc_id; null and empty texts have
    the score of no words and stay. Repeated rows share their fate; other columns stay as they are.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.7)


def named() -> Column:
    """doc_id, or for rows without one an id below all others that their text gives, so equal texts are one document."""
    return F.coalesce(F.col("doc_id").cast("long"), -2 - F.shiftrightunsigned(F.xxhash64("text"), 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are alike in 0.8 of their five-word shingles: of the least doc_id, the least text.

    Rows of one doc_id are one document, of which one row stays. Rows without a doc_id
    take part as ``named`` says and are left with their null. Documents without words are
    alike with none.
    """
    groups = ngram_join.jaccard_groups(docs.select(named().alias("doc_id"), "text"), n=5, a=80, b=100)
    # a document without an id gives way to one of its group that has one
    group = groups.groupBy("component_id").agg(F.coalesce(F.min(F.when(F.col("doc_id") >= -1, F.col("doc_id"))), F.min("doc_id")).alias("_kept_id"))
    kept = store(group.select("_kept_id"), "kept")
    rows = docs.withColumn("_kept_id", named()).join(kept, "_kept_id")
    first = Window.partitionBy("_kept_id").orderBy(F.xxhash64("text"), *[c for c, kind in docs.dtypes if "map" not in kind and c != "text"])
    return rows.withColumn("_kept_row", F.row_number().over(first)).where("_kept_row = 1").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that hold no benchmark item to 0.8 of its five-word shingles.

    Rows of one doc_id are one document and go together; rows without one are judged by
    their texts. Null and empty texts hold nothing and stay. No benchmark leaves all.
    """
    found = decontaminate.contaminated(docs.select(named().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = store(found.select(F.col("doc_id").alias("_found_id")).distinct(), "contaminated")
    return docs.withColumn("_found_id", named()).join(found, "_found_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture of its source takes it: weights 5, 2, 1 in turn, three epochs at most.

    Null sources are one source; rows without words are taken as often as whole epochs are.
    Columns that have names of the mixture's own results stay as they are.
    """
    aside = {c: f"_own_{n}" for n, c in enumerate(docs.columns) if c in mixing.RESULTS}
    mixed = mixing.mix(docs.withColumnsRenamed(aside), word_count(F.col("text")), lambda s: mixing.cyclic_weights(s, (5.0, 2.0, 1.0)), max_epochs=3.0)
    return mixing.repeat(mixed).withColumnsRenamed({own: c for c, own in aside.items()}).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, a list of ids for each row in the order of doc_id, null first; the result is read back from them.

    Null and empty texts are the end id alone; other columns are left out.
    """
    path = token_output.write_tokens(docs, tokenizer_path(), end_id=1)
    return token_output.token_digests(token_output.read_tokens(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier, the join's components and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
