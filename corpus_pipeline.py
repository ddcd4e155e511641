"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1 toxicity: documents that score 0.3 or more go.
2 near duplicates: word shingles of five, similarity 0.8; of each group the row of the smallest id stays.
3 suffix array: strings of 100 bytes that start earlier go, by whole characters.
4 personal data: spans are replaced by their kind.
5 packing: sequences of at most 2048 tokens; a row for each piece.

Every stage takes any table with the columns of documents (more may be there; the first four stages return
them unchanged) and gives no row for an empty table. A null text counts as an empty one and stays null, but
in stage 3, which returns it empty. Rows without an id are documents of their own.
1: repeated rows score alike, so all go or all stay.
2: of equal rows, with or without ids, one stays; texts without a word are in no group and all stay.
3: ids say what starts earlier, null ids first and equal ids by a hash of the text; a repeated row with an
   id loses what its first copy loses, one without an id loses all that the first copy keeps.
4: a text without spans is unchanged.
5: a row without text gives a piece with the end id alone; repeated rows are packed each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import jaccard, packing, pii, suffix, toxicity
from sparkloom.llm.tokens import public
from sparkloom.util import Scratch, table, with_row_keys

NEAR = jaccard.Join(words=5, num=80, den=100)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "jaccard")
    # rows without an id of their own are told apart by a key in the order of ids
    keyed = with_row_keys(docs, "doc_id", F.xxhash64("text"), scratch, merge=False)
    rows, key = (docs, "doc_id") if keyed is None else (keyed, "row_key")
    found = jaccard.jaccard_components(rows, scratch, NEAR, id_col=key)
    later = found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(key))
    return rows.join(later, key, "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix.dedup_substrings(docs, Scratch(spark, "suffix"), whole=True, carry=tuple(rest))
    text = F.col("kept").cast("string")
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    return out.select(*(own[c].alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public("byte_bpe_50k.json"), Scratch(spark, "packing"))


STAGES = [("toxicity", toxic), ("ngram_jaccard", near_duplicates), ("suffix_array", repeated_passages), ("pii", personal_data), ("packing", sequences)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
