"""Line deduplication: range-partitioned line hashes in order of document and position, and bitmaps of what stays.

Main path: DataFrame functions only. Lines leave their documents as a 96-bit hash with document and position; texts are
read again only where a document's bitmap is applied to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import cut, free

LEAST_CHARS, LEAST_DOCS = 40, 5
#: A hash with more than one of so many lines is hot: it is counted by partial sums and never meets in one task. So there are fewer than this many.
HOT = 1024
#: Counters of the sketch that finds hot hashes; what it misses only costs time.
TRACKED = 16_384
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a bitmap's word.
BITS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _identity(docs: DataFrame) -> DataFrame:
    """With _a, _b: equal for rows of the same doc_id and text, which lose the same lines."""
    return docs.withColumns({"_a": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_b": F.xxhash64(F.col("doc_id").isNull(), "text")})


def keep_bitmaps(documents: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot: int = HOT) -> DataFrame:
    """_a, _b, keep: for each document that loses lines its bitmap, an array of (word, bits) with a set bit for each of 64 lines that stays.

    Words in which every line stays are left out, and so are documents that lose none. A line's key is the line without white
    space at its ends, A-Z lower-cased; keys of ``least_chars`` code points that at least ``least_docs`` different doc_ids hold lose their
    lines in all documents but the one of the largest doc_id. Rows of a null doc_id are not counted and lose such lines.

    Hashes are partitioned by ranges and sorted by document, the largest first, and position: the first row of a hash names the document that keeps
    it. Hot hashes stay where they are: their documents are counted with partial aggregation and the answer, fewer than ``hot`` rows, is broadcast.
    """
    stripped = F.btrim(F.col("_line"), F.lit(BLANK))
    split = _identity(documents.select("doc_id", "text")).select("doc_id", "_a", "_b", F.posexplode(_lines(F.col("text"))).alias("_at", "_line"))
    keyed = split.filter(F.length(stripped) >= least_chars).select("doc_id", "_a", "_b", "_at", F.translate(stripped, UPPER, LOWER).alias("_key"))
    lines = cut(keyed.select("doc_id", "_a", "_b", "_at", F.xxhash64("_key").alias("_h"), F.hash("_key").alias("_g")), "lines")

    seen = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_h, {hot}, {max(TRACKED, hot)})").alias("top")).first()
    often = [x["item"] for x in seen["top"] or [] if x["count"] * hot > seen["n"]]
    is_hot = F.col("_h").isin(often) if often else F.lit(False)

    order = W.partitionBy("_h", "_g").orderBy(F.desc_nulls_last("doc_id"))
    rest = lines.filter(~is_hot).repartitionByRange("_h", "_g").sortWithinPartitions("_h", "_g", F.desc_nulls_last("doc_id"), "_at")
    rest = rest.withColumns({"_first": F.first("doc_id").over(order.rowsBetween(W.unboundedPreceding, 0)), "_nth": F.when(F.col("doc_id").isNotNull(), F.dense_rank().over(order))})
    rest = rest.withColumn("_docs", F.max("_nth").over(W.partitionBy("_h", "_g")))
    gone = rest.filter((F.col("_docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("_first"))).select("_a", "_b", "_at")
    if often:
        stands = lines.filter(is_hot).groupBy("_h", "_g").agg(F.count_distinct("doc_id").alias("_docs"), F.max("doc_id").alias("_first")).filter(F.col("_docs") >= least_docs)
        held = lines.filter(is_hot).join(F.broadcast(stands), ["_h", "_g"])
        gone = gone.unionByName(held.filter(~F.col("doc_id").eqNullSafe(F.col("_first"))).select("_a", "_b", "_at"))
    word = F.floor(F.col("_at") / BITS).cast("int").alias("word")
    words = gone.groupBy("_a", "_b", word).agg(F.bitwise_not(F.bit_or(F.expr(f"shiftleft(1L, _at % {BITS})"))).alias("bits"))
    out = cut(words.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep")), "bitmaps")
    free(lines)
    return out


def dedup(documents: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: one row for each input row; ``kept`` is the text without the lines that ``keep_bitmaps`` drops.

    Null or empty text: one empty line, which stays. A text may lose all its lines; it is empty then. Repeated rows lose the same lines and stay
    rows; a document that repeats a line keeps or loses all of its copies. An empty table gives no rows; other columns are ignored. Texts of
    any length are split whole.
    """
    marks = keep_bitmaps(documents, least_chars, least_docs, hot)
    # The bitmap with its gaps filled, so that a line finds its bit by place.
    filled = lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - F.coalesce(F.get("keep", i - 1)["word"], F.lit(-1)) - 1), F.array(x["bits"]))
    stays = lambda x, i: F.getbit(F.coalesce(F.get("_bits", F.floor(i / BITS).cast("int")), F.lit(-1).cast("long")), i % BITS) == 1
    left = F.aggregate("keep", F.lit(0).cast("long"), lambda n, x: n + BITS - F.bit_count(x["bits"]))
    # Bitmaps grow with the input, so they are never broadcast: the plan is the same at every size.
    rows = _identity(documents.select("doc_id", "text")).join(marks.hint("merge"), ["_a", "_b"], "left").withColumn("_bits", F.flatten(F.transform("keep", filled)))
    text, lines = F.coalesce("text", F.lit("")), _lines(F.col("text"))
    return rows.select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(left, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("kept"),
    )
