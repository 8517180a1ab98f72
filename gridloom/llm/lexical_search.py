"""Ranked lexical search: three-phase uniform-threshold top-k (TPUT) over term-partitioned postings.

Terms are runs of ASCII letters, digits and any byte beyond ASCII, A-Z lower-cased, and are known by 64-bit hashes. The
postings of the queries' terms are written once, partitioned by ranges of (term, impact, document) and sorted, so each list is in
descending order of impact and a frequent term's list spans as many files as it needs. Then, for all queries at once:

1. The first k entries of each list give partial sums; a query's k-th best partial sum is a lower bound of its k-th best score.
2. Every list of a query is read down to the same value, that bound over the number of its lists: a document that is in none of these heads cannot
   reach the bound. What is read meets by blocks of documents, where sums and the most that lists not read can add give candidates.
3. The candidates' exact scores are looked up in the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.llm.bytewords import NON_ALNUM, mix, words
from gridloom.llm.store import cut, free

TOP = 10
#: Queries are read to the driver and sent to the workers in lots of so many bytes of text at most, so a lot has fewer lists than half of that.
LOT_BYTES = 2 << 20
#: Bytes of text that are cut into terms together, documents of a block, and entries that a block adds up at a time.
SLICE, BLOCK, STEP = 4 << 20, 1024, 1 << 21
_RESULT = "item_id long, rank int, doc_id long, score long"


class Queries:
    """The terms of one lot of queries: ``vocabulary`` ascending; for each list of a query its number, its term's place and how often it says it."""

    def __init__(self, texts: list[str | None]):
        hashes, starts = words(pa.array(texts, pa.string()), NON_ALNUM)
        self.vocabulary, at = np.unique(hashes, return_inverse=True)
        key, self.times = np.unique(np.repeat(np.arange(len(texts)), np.diff(starts)) * max(1, len(self.vocabulary)) + at, return_counts=True)
        self.query, self.term = key // max(1, len(self.vocabulary)), key % max(1, len(self.vocabulary))


def _lots(queries: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The queries, read to the driver lot by lot; only one lot is held."""
    given = queries.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    lots = -(-total // LOT_BYTES)
    for k in range(lots):
        part = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == k) if lots > 1 else given
        yield [(r["item_id"], r["text"]) for r in part.collect()]


_POSTING = "term int, row long, tf long, n long, doc_id long, profile_a long, profile_b long"


def _postings(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each document and term of ``vocabulary`` in it, and for each document with any term at all a row of term -1.

    The latter has the document's number of terms ``n``, its id and its profile, which is equal for documents that agree in n and in the number of each term.
    """
    given = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def part(rows: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        known = given.value
        hashes, starts = words(texts, NON_ALNUM)
        n = np.diff(starts)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(known) + at[hit], return_counts=True)
        doc, term = key // len(known), key % len(known)
        bounds = np.searchsorted(doc, np.arange(len(n) + 1))
        profiles = []
        for salt in (1, 2):
            entry = mix(mix(term.astype(np.uint64) + np.uint64(salt << 40)) + tf.astype(np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(entry, dtype=np.uint64)])
            profiles.append((sums[bounds[1:]] - sums[bounds[:-1]] + mix(n.astype(np.uint64) + np.uint64(salt << 41))).view(np.int64))
        own = np.flatnonzero(n > 0)
        row = rows.to_numpy()
        columns = [
            pa.array(np.concatenate([term, np.full(len(own), -1)]).astype(np.int32)),
            pa.array(np.concatenate([row[doc], row[own]])),
            pa.array(np.concatenate([tf, n[own]]).astype(np.int64)),
            pa.array(np.concatenate([n[doc], n[own]])),
            *(pa.concat_arrays([pa.nulls(len(doc), pa.int64()), x.take(pa.array(own))]) for x in (ids.cast(pa.int64()), *map(pa.array, profiles))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "row", "tf", "n", "doc_id", "profile_a", "profile_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SLICE, "right")))
                yield part(*(batch.column(c).slice(low, high - low) for c in ("row", "doc_id", "text")))
                low = high

    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTING)


def _first(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The ``k`` first rows of each group, with ``_nth`` from 1; no more than k a group and task are shuffled."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= k)


class _Block:
    """Phase 2 for one block of documents: candidates for every query of the lot."""

    NAMES = ("query", "row", "doc_id", "profile_a", "profile_b", "low", "high")

    def __init__(self, k: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, read_to: np.ndarray, bound: np.ndarray, best: np.ndarray):
        self.k, self.query, self.term, self.weight, self.read_to, self.bound = k, query, term, weight, read_to, bound
        #: The most that a list adds where it has not been read.
        self.rest = np.maximum(0, np.minimum(read_to[query] - 1, weight * best[term]))
        self.terms = len(best)

    def run(self, entries: pa.Table, documents: pa.Table) -> pa.Table:
        number = lambda t, c: t[c].fill_null(0).to_numpy()
        row, ids, a, b = (number(documents, c) for c in ("row", "doc_id", "profile_a", "profile_b"))
        absent = documents["doc_id"].is_null().to_numpy()
        # Of documents of one profile, all scores are equal: those after the k-th smallest id are in no result.
        order = np.lexsort((row, ids, absent, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        begin = np.flatnonzero(new)
        chosen = np.sort(order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < self.k])
        chosen = chosen[np.argsort(row[chosen])]
        held = row[chosen]
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        term, where, impact = number(entries, "term"), number(entries, "row"), number(entries, "impact")
        if len(held) and len(where):
            place = np.minimum(np.searchsorted(held, where), len(held) - 1)
            real = held[place] == where
            by_term = np.argsort(term[real], kind="stable")
            place, impact = place[real][by_term], impact[real][by_term]
            ends = np.searchsorted(term[real][by_term], np.arange(self.terms + 1))
            count = ends[self.term + 1] - ends[self.term]
            first = 0
            queries = len(self.bound)
            edges = np.searchsorted(self.query, np.arange(queries + 1))
            so_far = np.concatenate([[0], np.cumsum(count)])
            while first < queries:
                # Whole queries, as many as STEP entries and sums allow, one at least.
                last = first + 1
                while last < queries and so_far[edges[last + 1]] - so_far[edges[first]] <= STEP and (last + 1 - first) * len(held) <= STEP:
                    last += 1
                self._add(slice(edges[first], edges[last]), first, last, count, ends, place, impact, len(held), out)
                first = last
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        at = chosen[found[1]] if len(found[1]) else np.zeros(0, np.int64)
        columns = [pa.array(found[0].astype(np.int32)), pa.array(row[at]), pa.array(ids[at], mask=absent[at]), pa.array(a[at]), pa.array(b[at]), pa.array(found[2].astype(np.int64)), pa.array(found[3].astype(np.int64))]
        return pa.Table.from_arrays(columns, names=list(self.NAMES))

    def _add(self, lists: slice, first: int, last: int, count, ends, place, impact, docs: int, out) -> None:
        n = count[lists]
        at = np.repeat(ends[self.term[lists]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        value = np.repeat(self.weight[lists], n) * impact[at]
        query = np.repeat(self.query[lists], n)
        read = value >= self.read_to[query]
        key = (query[read] - first) * docs + place[at[read]]
        # Sums of whole numbers below 2^53 are exact in doubles.
        low = np.bincount(key, value[read], (last - first) * docs).reshape(last - first, docs)
        most = np.bincount(self.query[lists] - first, self.rest[lists], last - first)
        high = low + most[:, None] - np.bincount(key, np.repeat(self.rest[lists], n)[read], (last - first) * docs).reshape(last - first, docs)
        bound = self.bound[first:last].astype(np.float64)
        if docs >= self.k:
            bound = np.maximum(bound, np.partition(low, docs - self.k, axis=1)[:, docs - self.k])
        q, d = np.nonzero((high >= bound[:, None]) & (low > 0))
        for held, x in zip(out, (q + first, d, low[q, d], high[q, d]), strict=True):
            held.append(x)


def _search_lot(documents: DataFrame, lot: list[tuple[int | None, str]], k: int) -> DataFrame | None:
    spark = documents.sparkSession
    queries = Queries([text for _, text in lot])
    if not len(queries.vocabulary):
        return None
    postings = cut(_postings(documents, queries.vocabulary), "postings")
    counted = {r["term"]: (r["df"], r["n"]) for r in postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")).collect()}
    if -1 not in counted:
        free(postings)
        return None
    docs, length = counted.pop(-1)
    weight = np.zeros(len(queries.vocabulary), np.int64)
    for term, (df, _) in counted.items():
        weight[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    live = weight[queries.term] > 0
    query, term, weight = queries.query[live], queries.term[live].astype(np.int32), (queries.times * weight[queries.term])[live]
    lists = F.broadcast(spark.createDataFrame(pd.DataFrame({"query": query.astype(np.int32), "term": term, "weight": weight}), "query int, term int, weight long"))

    m = 100 - 75 + F.expr(f"(75L * n * {docs}L) div {length}L")
    impact = F.expr("(1000000000L * tf) div (1000L * tf + 8L * _m)").cast("int").alias("impact")
    by = ("term", F.desc("impact"), "row")
    index = postings.filter("term >= 0").withColumn("_m", m).select("term", impact, "row")
    index = cut(index.repartitionByRange(*by).sortWithinPartitions(*by), "index")

    # Phase 1.
    heads = _first(index, k, ["term"], F.desc("impact"), "row")
    tops = {r["term"]: r["impact"] for r in heads.filter("_nth = 1").collect()}
    sums = heads.join(lists, "term").groupBy("query", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"))
    bound = np.zeros(len(lot), np.int64)
    for r in _first(sums, k, ["query"], F.desc("low"), "row").filter(F.col("_nth") == k).collect():
        bound[r["query"]] = r["low"]
    best = np.zeros(len(queries.vocabulary), np.int64)
    best[list(tops)] = list(tops.values())

    # Phase 2.
    read_to = bound // np.maximum(1, np.bincount(query, minlength=len(lot)))
    least = pd.DataFrame({"term": term, "least": -(-read_to[query] // weight)}).groupby("term", as_index=False).min()
    least = F.broadcast(spark.createDataFrame(least, "term int, least long"))
    blocks = max(1, -(-docs // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    entries = index.join(least, "term").filter(F.col("impact") >= F.col("least")).select(block, "row", "term", "impact")
    every = postings.filter("term = -1").select(block, "row", "doc_id", "profile_a", "profile_b")
    given = spark.sparkContext.broadcast(_Block(k, query, term, weight, read_to, bound, best))

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        return given.value.run(left, right)

    schema = "query int, row long, doc_id long, profile_a long, profile_b long, low long, high long"
    found = cut(entries.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(candidates, schema), "found")
    kth = _first(found, k, ["query"], F.desc("low"), "row").filter(F.col("_nth") == k).select("query", F.col("low").alias("_bound"))
    able = found.join(F.broadcast(kth), "query", "left").filter(F.col("high") >= F.coalesce("_bound", F.lit(0)))
    able = _first(able, k, ["query", "profile_a", "profile_b"], F.asc_nulls_last("doc_id"), "row").select("query", "row", "doc_id")
    able = cut(able, "candidates")

    # Phase 3.
    exact = index.join(able, "row").join(lists, ["query", "term"]).groupBy("query", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"), F.first("doc_id").alias("doc_id"))
    ranked = _first(exact, k, ["query"], F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    names = F.broadcast(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(lot)], "query int, item_id long"))
    out = cut(ranked.join(names, "query").select("item_id", F.col("_nth").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    free(postings, index, found, able)
    return out


def search(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``queries`` (item_id, text) its ``k`` highest-scoring documents with a score above 0, or all if fewer.

    N counts the documents with a term, L all their terms, n one document's, df the documents that hold a term, tf its occurrences in one. A term
    weighs floor(1000 ln((2N + 2) / (2df + 1))); a document's m is 100 - 75 + 75 n N div L; it scores the sum of weight * (10^9 tf div (1000 tf + 8 m)) over
    the query's terms, each as often as the query says it. Equal scores are ranked by ascending doc_id, null last.

    Null or empty texts have no terms: such documents are not counted and not found, such queries have no rows. Each row is a document or a query of its
    own, repeated or not. Without documents or queries there are no rows; other columns are ignored; whole texts are read.
    """
    ship(documents.sparkSession)
    parts = [x for lot in _lots(queries) if (x := _search_lot(documents, lot, k)) is not None]
    out = documents.sparkSession.createDataFrame([], _RESULT)
    for part in parts:
        out = part if part is parts[0] else out.unionByName(part)
    return out
