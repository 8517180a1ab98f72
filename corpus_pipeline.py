"""The corpus pipeline: documents through four stages, each over all that the stage before it kept.

All stages but the last return the columns of documents as they came, extra columns too, and change no row that they keep. An empty table
passes every stage as an empty table. Texts of any length are judged whole. Repeated rows are judged alike; only
the near-copy stage makes one of them. No stage reads a column that it makes, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, jaccard, mixing, toxicity
from gridloom.llm.store import cut, free, table

#: What ids that go to all executors may take, and an id there.
BROADCAST_BYTES, BYTES_AN_ID = 96 << 20, 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; a score at it is rejected.

    Null and empty texts have the score of a text without any known n-gram, rows of a null doc_id are scored like others. Without
    labels every text has the same score: the bounded share of toxic labels, which keeps all."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc_id: distinct longs), for ``left_semi``, or is not, for ``left_anti``; then rows without doc_id stay.

    Ids go to all executors in packs of some 64, so texts stay where they are, for tables of any size; only ids that would take over
    BROADCAST_BYTES there meet the texts by a shuffle."""
    n = ids.count()
    if n * BYTES_AN_ID > BROADCAST_BYTES:
        return docs.join(ids.hint("merge"), "doc_id", how)
    own = docs["doc_id"].cast("long")
    pack = lambda x: F.pmod(F.xxhash64(x), F.lit(max(1, n // 64)))
    packs = ids.groupBy(pack(ids["doc_id"]).alias("_pack")).agg(F.collect_list("doc_id").alias("_ids"))
    return docs.join(F.broadcast(packs), (pack(own) == packs["_pack"]) & F.array_contains(packs["_ids"], own), how)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 over five-word shingles: the smallest doc_id.

    Null texts, texts without words and rows without doc_id belong to no group and stay. Rows of the same doc_id are one document, of which one
    row stays. Links are transitive, so a group may hold two texts that are less alike than 0.8.
    """
    found = jaccard.join(docs, width=5, num=80, den=100).filter("doc_id is not null")
    found = found.groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("_copy"), (F.count("*") > 1).alias("_repeats"))
    marked = cut(found.filter("_copy or _repeats"), "marked")
    out = by_id(docs, marked.select("doc_id"), "left_anti")
    repeated = marked.filter("not _copy").select("doc_id")
    if not repeated.isEmpty():
        out = out.unionByName(by_id(docs, repeated, "left_semi").dropDuplicates(["doc_id"]))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is similar to a benchmark item, at a weighted Jaccard similarity of 0.8 over five-word shingles.

    Null and empty texts and items match nothing; rows of a null doc_id are judged like others; an empty benchmark keeps all."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of them: doc_id, source, size, source_size, target, taken.

    Null text has size 0 and is not taken; a null source is a source of its own; a null doc_id is drawn like any other. Equal keys are ordered by
    doc_id, then size."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Neither the classifier nor the join by components is a SQL query; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        free(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
