"""Token counts by a two-tier lookup on the map side.

A compact table of frequent pre-token lengths goes to all workers; what it lacks is encoded once a worker and
kept in that worker's cache. Pre-tokens are never shuffled. Where a text holds a character that regular-expression libraries may class
differently, or a special string, the stretch around it, from one safe place to the next, is a unit of its own and is
looked up like a pre-token; the rest of the text goes its usual way.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship

#: Fixed value: the tokenizer's own pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class every regular-expression library knows alike, as it has been the same since the first versions of Unicode: ASCII without the odd control
#: characters, letters of Latin, Greek, Cyrillic, Hebrew, Arabic, Kana, Han and Hangul, and common punctuation; and those of them that are no space.
_SOLID = r"!-~¡-¬®-ȳΑ-ΡΣ-ҁא-תء-غف-ي٠-٩‐-‧‰-›€、-〃〈-】ぁ-んァ-ヺ一-龥가-힣！-＇（-～"
COMMON = rf"[\t\n\r {_SOLID}]*"
#: A space between two of these ends a pre-token on its left, whatever stands further away.
SAFE = rf"(?<=[{_SOLID}])(?= [{_SOLID}])"
TABLE_SIZE, SAMPLE_DOCS = 50_000, 512
#: Bytes of a worker's cache, reckoned as _ENTRY and eight a character for each unit (Python keeps two forms of it); longer units than _CACHED characters hardly come again and are not kept.
CACHE_BYTES, _ENTRY, _CACHED = 64 << 20, 120, 256
#: Units that are encoded at a time, and texts that are looked up at a time.
_ENCODED, _TEXTS = 8192, 256
DECLARED = "doc_id long, n_bytes long, n_tokens long"

_workers: dict[str, _Worker] = {}


class _Worker:
    """Tokenizer, cache and patterns of a Python worker; they outlive a task where workers are reused."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, int] = {}
        self.held = 0
        self.words = regex.compile(PATTERN).findall
        self.common = regex.compile(COMMON).fullmatch
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special)).search if special else lambda _: None
        self.odd = regex.compile("|".join([*special, rf"[^\t\n\r {_SOLID}]+"])).finditer
        self.safe = regex.compile(SAFE)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for low in range(0, len(texts), _ENCODED) for e in self.tokenizer.encode_batch(texts[low : low + _ENCODED], add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        """Pre-tokens, and whole stretches around what is not common; together they are the text."""
        if self.common(text) and not self.special(text):
            return self.words(text)
        safe = np.array([0, *(m.start() for m in self.safe.finditer(text)), len(text)])
        out, done = [], 0
        for m in self.odd(text):
            if m.start() < done:
                continue
            begin = int(safe[np.searchsorted(safe, m.start(), "right") - 1])
            end = int(safe[np.searchsorted(safe, m.end())])
            if begin < done:  # goes on from the stretch before
                out[-1] += text[done:end]
            else:
                out += self.words(text[done:begin])
                out.append(text[begin:end])
            done = end
        return out + self.words(text[done:])


def _worker(path: str) -> _Worker:
    if path not in _workers:
        _workers[path] = _Worker(path)
    return _workers[path]


def frequent_table(documents: DataFrame, path: str, size: int = TABLE_SIZE, sample: int = SAMPLE_DOCS) -> dict[str, int]:
    """The most frequent pre-tokens of ``sample`` documents, ``size`` at most, with their token counts.

    The documents with the smallest hash of doc_id are taken, each id once a task, and counted whole where they are read; a task sends ``size``
    words at most. The table only saves work: what it lacks is encoded where it occurs, so no result depends on it.
    """
    chosen = [r["doc_id"] for r in documents.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not chosen:
        return {}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, worker = set(), Counter(), _worker(path)
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and i not in seen:
                    seen.add(i)
                    counts.update(w for w in worker.units(text) if len(w) < 64)
        if counts:
            words, n = zip(*counts.most_common(size), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([list(words)]), pa.array([list(n)], pa.list_(pa.int64()))], names=["words", "n"])

    rows = documents.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text").mapInArrow(counted, "words array<string>, n array<long>")
    counts = Counter()
    for r in rows.toLocalIterator():
        counts.update(dict(zip(r["words"], r["n"], strict=True)))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:size]
    return dict(zip(words, _worker(path).lengths(words), strict=True))


def count_texts(texts: list[str], path: str, table: dict[str, int], cache_bytes: int = CACHE_BYTES) -> list[int]:
    """The library's number of tokens of each text."""
    worker = _worker(path)
    cache, every, ends = worker.cache, [], []
    for text in texts:
        every += worker.units(text)
        ends.append(len(every))
    got = list(map(table.get, every))
    if None in got:
        missed = [i for i, n in enumerate(got) if n is None]
        second = [every[i] for i in missed]
        lacking = [w for w in dict.fromkeys(second) if w not in cache]
        fresh = dict(zip(lacking, worker.lengths(lacking), strict=True))
        got_twice = {w: cache[w] if w in cache else fresh[w] for w in dict.fromkeys(second)}
        for w in lacking:
            size = _ENTRY + 8 * len(w)
            if len(w) > _CACHED or size > cache_bytes:
                continue
            if worker.held + size > cache_bytes:  # starts anew; memory stays bounded
                cache.clear()
                worker.held = 0
            cache[w] = fresh[w]
            worker.held += size
        for i, w in zip(missed, second, strict=True):
            got[i] = got_twice[w]
    sums = np.concatenate([[0], np.cumsum(np.array(got, np.int64))])
    return np.diff(sums[np.array([0, *ends])]).tolist()


def _counter(path: str, table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            for low in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(low, _TEXTS)
                texts = [x or "" for x in part.column("text").to_pylist()]
                sizes = [len(x.encode()) for x in texts]
                counts = count_texts(texts, path, known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(counts, np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): one row for each input row, no shuffle.

    ``path``: a byte-level tokenizer file, readable on every machine. Counts are the library's, without begin and
    end tokens; the tokenizer's special strings inside texts count as the library takes them. Null text: empty. Repeated rows
    stay; an empty table gives no rows; other columns are ignored; texts are counted whole.
    """
    ship(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(frequent_table(documents, path))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counter(path, known), DECLARED).withColumn("over_limit", F.col("n_tokens") > limit)
