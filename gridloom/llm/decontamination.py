"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of ASCII letters, digits and any byte beyond ASCII, A-Z lower-cased; features are shingles of WIDTH
words (an item of fewer words is one shingle), weighted by how often they stand in the window. For each item length,
every window of that many words near an item's shingle has a 64-bit SimHash from prefix sums; a window without
one has similarity 0 and is passed over. Fingerprints within RADIUS bits of each other agree up to SLACK bits in at
least one of BLOCKS blocks. The index holds, for each block, all values within SLACK bits of an item's, in order; so looking up
a window's blocks misses none within the radius, and about one in seven of unlike pairs is looked at. Then the
weighted Jaccard similarity decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.llm.bytewords import NON_ALNUM, chained, words
from gridloom.llm.packing import cuts
from gridloom.llm.store import cut, free

WIDTH, SIMILARITY = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average, with a deviation of 2.9; of 1,800 random pairs
#: of similarity 0.8 or more none differed in more than 19.
RADIUS, BLOCKS = 19, 4
SLACK = RADIUS // BLOCKS
#: Items are read to the driver and sent to the workers in lots of about so many bytes and so many items; an item's entries in the index take 60 KB, so a lot's
#: index takes about 60 MB in a worker, and workers hold the index of one lot at a time.
LOT_BYTES, LOT_ITEMS = 2 << 20, 1000
#: Of several lots, documents without any item's shingle are left out first, by a table of so many bits.
_SCREEN_BITS, _FILTER_BITS = 27, 20
_WINDOWS = 8192
#: 16-bit values of few bits: what may lie between two blocks.
_MASKS = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= SLACK).astype(np.uint16)


class Neighbours:
    """The multi-index of fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: values within SLACK bits of a fingerprint's, ascending, and whose. Made where they are used."""
        out = []
        for block in self.prints.view(np.uint16).reshape(-1, BLOCKS).T:
            values, item = (block[:, None] ^ _MASKS).ravel(), np.repeat(np.arange(len(block), dtype=np.int32), len(_MASKS))
            order = np.argsort(values, kind="stable")
            out.append((values[order], item[order]))
        return out

    def __getstate__(self) -> dict:
        return {"prints": self.prints}

    def candidates(self, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``got``, fingerprint): the pairs that agree up to SLACK bits in some block, once each."""
        pairs = []
        for block, (values, item) in zip(got.view(np.uint16).reshape(-1, BLOCKS).T, self.tables, strict=True):
            low, high = np.searchsorted(values, block), np.searchsorted(values, block, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pairs.append(np.repeat(np.arange(len(got)), n) * len(self.prints) + item[at])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.prints), both % len(self.prints)


class Index:
    """The items of one lot, by shingle width and by length."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids = [i for i, _ in items]
        hashes, starts = words(pa.array([t for _, t in items], pa.string()), NON_ALNUM)
        self.lengths = np.diff(starts)
        #: width -> (filter by leading bits, sorted shingles, window size in shingles -> item numbers, their fingerprints)
        self.widths: dict[int, tuple] = {}
        self.bags: dict[int, Counter] = {}
        for w in sorted({min(width, int(n)) for n in self.lengths if n}):
            own = [k for k, n in enumerate(self.lengths) if n and min(width, int(n)) == w]
            bags = {k: chained(hashes[starts[k] : starts[k + 1]], w) for k in own}
            self.bags |= {k: Counter(v.tolist()) for k, v in bags.items()}
            known = np.unique(np.concatenate(list(bags.values())))
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[known >> np.uint64(64 - _FILTER_BITS)] = True
            sizes = {}
            for m in sorted({len(v) for v in bags.values()}):
                same = np.array([k for k in own if len(bags[k]) == m])
                prints = np.concatenate([fingerprints(bags[k], m) for k in same])
                sizes[m] = same, Neighbours(prints)
            self.widths[w] = table, known, sizes

    def find(self, texts) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, bits apart, first word, words) of the best window of each text and item."""
        hashes, starts = words(texts, NON_ALNUM)
        for w, (table, known, sizes) in self.widths.items():
            every = chained(hashes, w)
            if not len(every):
                continue
            seeds = np.flatnonzero(table[every >> np.uint64(64 - _FILTER_BITS)])
            at = np.minimum(np.searchsorted(known, every[seeds]), len(known) - 1)
            seeds = seeds[known[at] == every[seeds]]
            text = np.searchsorted(starts, seeds, "right") - 1
            inside = seeds + w <= starts[text + 1]
            seeds, text = seeds[inside], text[inside]
            if not len(seeds):
                continue
            ends = cuts(text)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                t = int(text[a])
                yield from self._in_text(t, every, seeds[a:b], int(starts[t]), int(starts[t + 1]) - w + 1, w, sizes)

    def _in_text(self, t: int, every: np.ndarray, seeds: np.ndarray, low: int, high: int, w: int, sizes: dict) -> Iterator[tuple]:
        """every[low:high]: the text's shingles; seeds: where one of an item stands."""
        best: dict[int, tuple] = {}
        reach = max(sizes)
        gaps = np.flatnonzero(np.diff(seeds) > reach) + 1
        for run in np.split(seeds, gaps):
            for m, (same, index) in sizes.items():
                begin, end = max(low, int(run[0]) - m + 1), min(high, int(run[-1]) + m)
                size = min(m, high - low)  # a text shorter than the item is one window
                if end - begin < size:
                    begin = max(low, end - size)
                    end = min(high, begin + size)
                for first in range(begin, end - size + 1, _WINDOWS):
                    part = every[first : min(end, first + _WINDOWS + size - 1)]
                    got = fingerprints(part, size)
                    window, item = index.candidates(got)
                    apart = np.bitwise_count(got[window] ^ index.prints[item])
                    close = apart <= RADIUS
                    window, item, apart = window[close], item[close], apart[close]
                    for x in np.argsort(apart, kind="stable").tolist():
                        k, at = int(same[item[x]]), int(window[x])
                        found = weighted_jaccard(Counter(part[at : at + size].tolist()), self.bags[k])
                        if found >= self.similarity:
                            new = (found, -int(apart[x]), -(first + at - low))
                            best[k] = max(best.get(k, new), new)
        for k, (found, bits, at) in sorted(best.items()):
            yield t, self.ids[k], found, -bits, -at, min(int(self.lengths[k]), high - low + w - 1)


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles; each adds its 64 bits as plus or minus one."""
    out = []
    for low in range(0, len(shingles) - size + 1, 8192):
        part = shingles[low : low + 8192 + size - 1]
        lanes = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(lanes, 0, dtype=np.int32)])
        out.append(np.packbits(sums[size:] - sums[:-size] > 0, axis=1).view(np.uint64)[:, 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def _lot_filters(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The benchmark in lots, which are read to the driver one by one; only one is held. No items are one empty lot."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items")).first()
    lots = max(1, -(-(size["bytes"] or 0) // LOT_BYTES), -(-size["items"] // LOT_ITEMS))
    for k in range(lots):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == k) if lots > 1 else items


def _read(part: DataFrame) -> list[tuple[int, str]]:
    return [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def _lots(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    return map(_read, _lot_filters(benchmark))


def _screened(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """Of a benchmark of several lots: the documents (numbered rows of ``docs``) that hold a shingle of an item, written out;
    so ``docs`` is read once, however many lots there are. Else ``docs``."""
    table, lots, shortest = np.zeros(1 << (_SCREEN_BITS - 3), np.uint8), 0, width
    for lot in _lots(benchmark):
        lots += 1
        hashes, starts = words(pa.array([t for _, t in lot], pa.string()), NON_ALNUM)
        lengths = np.diff(starts)
        for w in {min(width, int(n)) for n in lengths if n}:
            shortest = min(shortest, w)
            at = np.concatenate([chained(hashes[a:b], w) for a, b, n in zip(starts[:-1], starts[1:], lengths, strict=True) if n and min(width, int(n)) == w])
            bit = at >> np.uint64(64 - _SCREEN_BITS)
            np.bitwise_or.at(table, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    if lots < 2:
        return docs, False
    given = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = given.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                hashes, starts = words(part.column("text"), NON_ALNUM)
                keep = np.zeros(part.num_rows, bool)
                for w in range(shortest, width + 1):
                    every = chained(hashes, w)
                    bit = every >> np.uint64(64 - _SCREEN_BITS)
                    hit = np.flatnonzero(held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    keep[np.searchsorted(starts, hit, "right") - 1] = True
                yield part.filter(pa.array(keep))

    return cut(docs.mapInArrow(run, docs.schema), "screened"), True


_FOUND = "doc_id long, item_id long, similarity double, bits_apart int, first_word long, n_words long"


def _finder(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "similarity", "bits_apart", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = list(zip(*index.value.find(part.column("text")), strict=True)) or [()] * 6
                ids = part.column("doc_id").take(pa.array(found[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, k) for x, k in zip(found[1:], kinds[1:], strict=True))], names=names)

    return run


def find(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, bits_apart, first_word, n_words: a row for each row of ``documents`` and each item
    of which some window reaches ``similarity``; the best window, of equal ones the nearest fingerprint, then the first.

    Documents are not shuffled. Null or empty texts and items match nothing; rows of a null doc_id come with null;
    repeated documents give a row each, repeated items count once; empty tables give no rows; other columns are
    ignored; whole texts are read.
    """
    spark = documents.sparkSession
    ship(spark)
    docs, many = _screened(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width)
    out = None
    for lot in _lots(benchmark):
        index = spark.sparkContext.broadcast(Index(lot, width, similarity))
        part = docs.mapInArrow(_finder(index), _FOUND)
        if many:
            part = cut(part, "found")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` without the rows in which ``find`` finds an item; columns and other rows are unchanged."""
    spark = documents.sparkSession
    ship(spark)

    def filtered(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1000):
                    part = batch.slice(low, 1000)
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in index.value.find(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        return run

    # Lots follow one another; where there are several, what one leaves is written before the next, so that its index can go.
    out, lots = documents, list(_lot_filters(benchmark))
    for k, chosen in enumerate(lots):
        index = spark.sparkContext.broadcast(Index(_read(chosen), width, similarity))
        before, out = out, out.mapInArrow(filtered(index), documents.schema)
        if len(lots) > 1:
            out = cut(out, "clean")
            index.destroy()
            if k:
                free(before)
    return out
