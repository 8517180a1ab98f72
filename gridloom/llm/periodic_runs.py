"""Periodic runs of words: Karp-Miller-Rosenberg names of power-of-two stretches, grid candidates, longest common extensions.

Every stretch of 2^k words of a text has a name at level k, equal for equal stretches of that text; names of a level come from
pairs of names of the level below by one sort. A stretch that occurs once has no name (-1) and is left out of all higher levels, so in ordinary text
few positions are sorted after the second level. A run of period q and length >= max(LEAST, TIMES * q) contains a multiple i of q (counted
from the text's start) whose extension common with i + q has at least max(LEAST, TIMES * q) - 2q + 1 words, so their names agree
at that length's level; such pairs are extended to both sides by descending levels. Texts are worked on many at a time, each within its own bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship

LEAST, TIMES = 24, 3
#: Bytes of text that are worked on together; a longer text is worked on alone, whole.
SLICE = 1 << 20
#: Candidates that are held at a time.
_STEP = 1 << 19
_BLANK = r"[\x20\x09-\x0D]+"


def with_planted(documents: DataFrame) -> DataFrame:
    """doc_id, text: documents of which about one in ten has a periodic tail.

    With h the CRC-32 of the decimal doc_id (null: of no characters) and g = h // 10: where h is a multiple of 10 and there are n > 0 words, each word
    i >= a = g % n becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). Such a text is its words joined by a space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", _BLANK), lambda w: w != "")
    rows = documents.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_w", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    picked = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, where each text's words begin and, last, the end); null is empty."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    at = lists.offsets.to_numpy().astype(np.int64)
    return words.filter(full), before[at - at[0]]


def _named(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of equal keys, -1 for keys that occur once; ``at`` are the keys' places."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    out = np.full(size, -1, np.int64)
    out[at[order[shared]]] = (np.cumsum(fresh) - 1)[shared]
    return out


class Names:
    """Names of the stretches of 1, 2, 4, ... words within each text, as far as any stretch of a text repeats."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        size, lengths = len(codes), np.diff(starts)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.low, self.high = starts[:-1][self.doc], starts[1:][self.doc]
        self.levels, self.top = [codes.astype(np.int64)], np.zeros(len(lengths), np.int64)
        while size:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            at = np.arange(size) if width == 1 else np.flatnonzero(last >= 0)
            at = at[at + 2 * width <= self.high[at]]
            if width > 1:
                at = at[last[at + width] >= 0]
            if not len(at):
                break
            base = int(last.max()) + 1
            # Above the first level names are a text's own; there the text is part of the key.
            key = ((self.doc[at] * base + last[at]) if width == 1 else last[at]) * base + last[at + width]
            names = _named(key, at, size)
            alive = np.flatnonzero(names >= 0)
            if not len(alive):
                break
            self.levels.append(names)
            self.top[self.doc[alive]] = len(self.levels) - 1

    def agree(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.levels[level]
        return (names[a] == names[b]) & (names[a] >= 0)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of places a < b of one text to the right."""
        out, high, last = np.zeros(len(a), np.int64), self.high[a], len(self.doc) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            inside = b + out + (1 << level) <= high
            out += (inside & self.agree(level, np.minimum(a + out, last), np.minimum(b + out, last))).astype(np.int64) << level
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same to the left of both places."""
        out, low = np.zeros(len(a), np.int64), self.low[a]
        for level in range(len(self.levels) - 1, -1, -1):
            width = 1 << level
            inside = a - out - width >= low
            out += (inside & self.agree(level, np.maximum(a - out - width, 0), np.maximum(b - out - width, 0))).astype(np.int64) << level
        return out


def _candidates(names: Names, starts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): pairs of grid places whose names agree as those in a run of that period must."""
    lengths = np.diff(starts)
    able = np.flatnonzero(lengths >= least)
    most = np.minimum(lengths[able] // times, (2 << names.top[able]) - 1)
    at = 0
    while at < len(able):
        # So many texts that their periods are few enough, one text at least.
        upto = max(at + 1, int(np.searchsorted(np.cumsum(most[at:]), _STEP, "right")) + at)
        doc = np.repeat(able[at:upto], most[at:upto])
        period = np.arange(len(doc)) - np.repeat(np.cumsum(most[at:upto]) - most[at:upto], most[at:upto]) + 1
        need = np.maximum(least, times * period) - 2 * period + 1
        level = np.log2(np.maximum(need, 1)).astype(np.int64)
        fits = level <= names.top[doc]
        doc, period, level = doc[fits], period[fits], level[fits]
        count = (lengths[doc] - 1) // period
        total = np.cumsum(count)
        first = 0
        while first < len(doc):
            end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _STEP, "right")))
            n = count[first:end]
            q = np.repeat(period[first:end], n)
            place = np.repeat(starts[doc[first:end]], n) + q * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            which = np.repeat(level[first:end], n)
            hit = np.zeros(len(q), bool)
            for k in np.unique(which):
                part = which == k
                hit[part] = names.agree(int(k), place[part], place[part] + q[part])
            yield place[hit], q[hit]
            first = end
        at = upto


def find_runs(codes: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of the maximal runs with length >= max(least, times * smallest period) of texts whose words are the integers
    ``codes``; places count through all texts, text d takes starts[d] to starts[d + 1]. Ascending; ``times`` is 2 at least."""
    names, found = Names(codes, starts), [np.zeros((0, 3), np.int64)]
    for place, q in _candidates(names, starts, least, times):
        begin, end = place - names.behind(place, place + q), place + q + names.ahead(place, place + q)
        long = end - begin >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([begin[long], end[long], q[long]], 1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # A multiple of a run's period has the same ends as the run, so the first of equal ends has the smallest period.
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[fresh]


def _greatest(length: np.ndarray, period: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text's runs the first with the greatest length / period, compared exactly; runs are in order of start."""
    best = np.full(len(bounds) - 1, -1, np.int64)
    for d in np.flatnonzero(np.diff(bounds)):
        low, high = int(bounds[d]), int(bounds[d + 1])
        ratio = length[low:high] / period[low:high]
        near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)) + low
        top = int(near[0])
        for k in near[1:].tolist():
            if int(length[k]) * int(period[top]) > int(length[top]) * int(period[k]):
                top = k
        best[d] = top
    return best


def _rows(ids: pa.Array, texts: pa.Array, least: int, times: int) -> pa.RecordBatch:
    words, starts = _split(texts)
    codes = words.dictionary_encode().indices.to_numpy()
    runs = find_runs(codes, starts, least, times)
    begin, end, period = runs.T
    bounds = np.searchsorted(begin, starts)
    keep = np.ones(len(codes), bool)
    if len(runs):
        depth = np.zeros(len(codes) + 1, np.int64)
        np.add.at(depth, begin + period, 1)
        np.add.at(depth, end, -1)
        keep = np.cumsum(depth[:-1]) <= 0
    kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[starts].astype(np.int32)), words.filter(pa.array(keep)))
    doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
    place, length = begin - starts[doc], end - begin
    best = _greatest(length, period, bounds)
    none = best < 0
    chosen = lambda x: pa.array(np.concatenate([x, [0]])[best], pa.int64(), mask=none)
    listed = pa.StructArray.from_arrays([pa.array(place), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), chosen(place), chosen(length), chosen(period), chosen(1000 * length // period), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), listed), pc.binary_join(kept, " ")],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
    )


def collapse(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed: one row for each input row, made where the row is, without a shuffle.

    Words are runs of bytes that are no ASCII white space, compared as they are. ``runs`` (start, length, period), by start, then period: stretches of words with
    smallest period q that no neighbouring word extends, of max(``least``, ``times`` * q) words at least. The five columns before it tell of the run of the greatest length /
    period, of equal ones the first; without a run they are null, and n_runs is 0. ``collapsed``: the words that no run contains after its first
    q words, joined by a space.

    Null or empty text: no words, no run, an empty ``collapsed``. Repeated rows stay rows. An empty table gives no rows; other columns are ignored. A text of any
    length is worked on whole: memory follows the longest text.
    """
    ship(documents.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SLICE, "right")))
                yield _rows(batch.column("doc_id").slice(low, high - low), batch.column("text").slice(low, high - low), least, times)
                low = high

    fields = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(parts, fields)
