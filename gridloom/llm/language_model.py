"""Language-model scoring: unigram counts over the whole corpus and a log-bilinear neural model trained in numpy.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end a text. The model predicts a symbol from the CONTEXT
symbols before it: words that occur at least sqrt(N) / ROOT times among the N learnable tokens (and the LEAST_WORDS most frequent at
least) and the end are symbols of their own, so symbols grow with the corpus; any other word belongs to one of RARE symbols by its last two bytes, and
is drawn within it by its add-one unigram share. Embeddings of the context, scaled by position, add up to a vector; its products
with output embeddings give logits. Symbols stand in about sqrt(V) classes of as many, by frequency: the class is
predicted first, then the symbol within it. Training is by noise-contrastive estimation: classes against the expected noise, symbols
against noise that is drawn within their class, so a token costs the same however many symbols there are, but for the classes.
Scoring normalises over classes and within them, so the probabilities of all tokens sum to one.

Texts are read once: for each chunk of documents its token numbers and its dictionary are written. Dictionaries are shuffled by
hash block, so a word moves once a chunk and not once a place; counts return to their chunks, and frequent words are known from
them. Then the texts to learn from are dealt, as symbols, into lots by a hash of doc_id and words. A lot has about LOT_TOKENS tokens,
whatever the files and partitions, and trains a model of its own in the order of the hashes, on every token; models are averaged by
tokens. So scores do not depend on how the table is partitioned. Last, chunks are scored from their token numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.llm.bytewords import column, mix, words
from gridloom.llm.packing import block_of, cuts, joined, packed, unpacked
from gridloom.llm.store import cut, free

RARE, CONTEXT, SIZE, ROOT, LEAST_WORDS = 64, 4, 24, 8, 191
#: Symbols of every model: the rare ones and the end. Frequent words follow; the last input stands for what lies before a text.
END = RARE
OUTPUTS = RARE + 1
END_HASH = np.uint64(0x1D8AF066B5A3C0DE)
CHUNK_BYTES, DOCS_A_BLOCK = 8 << 20, 16_384
BATCH, NOISE, RATE = 1024, 32, 0.4
#: Tokens a lot; lots of which models are first added up; tokens of one class that are multiplied at a time.
LOT_TOKENS, LOTS_TOGETHER, TILE = 4_000_000, 64, 8
#: Symbols of a class that a batch draws as noise.
DRAWN = 16
LEARNED = "pmod(crc32(cast(doc_id as string)), 7) <> 2"
_ROWS = "kind byte, chunk long, block long, low long, ids array<long>, held array<boolean>, learn array<boolean>, sizes array<long>, payload binary"
_CHUNK, _WORDS = 0, 1
#: What a block of words gives: counts for the pieces of chunks, its sums, and its frequent words.
_BACK, _SUMS, _FREQUENT = 0, 1, 2
#: Weights in a row of a model.
PIECE = 1 << 15
_FAR = np.float32(-60)


def _rare(tails: np.ndarray) -> np.ndarray:
    return ((tails.astype(np.int64) * 0x9E3779B1 >> 8) & 0xFFFFFF) % RARE


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text."""
    _, at = column(batch.column("text"))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with ends, last two bytes with 0 at ends, tokens of each text)."""
    hashes, starts, tails = words(texts, tails=True)
    docs = len(starts) - 1
    sizes = np.diff(starts)
    out, tail = np.full(len(hashes) + docs, END_HASH, np.uint64), np.zeros(len(hashes) + docs, np.int32)
    place = np.arange(len(hashes)) + np.repeat(np.arange(docs), sizes)
    out[place], tail[place] = hashes, tails
    return out, tail, sizes + 1


def laid_out(symbols: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(the symbols of texts one after another, each text behind CONTEXT times ``start``; where the texts' own symbols stand)."""
    place = np.arange(len(symbols)) + CONTEXT * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out = np.full(len(symbols) + CONTEXT * len(sizes), start, np.int32)
    out[place] = symbols
    return out, place


class Model:
    """Log-bilinear weights. All start the same, so models trained apart can be averaged. Symbols are numbered by frequency inside
    (``rank``), so a class is a row of the output tables; places beyond the last symbol are out of reach."""

    def __init__(self, symbol_counts: np.ndarray):
        r = np.random.default_rng(7)
        v = len(symbol_counts)
        order = np.argsort(-symbol_counts, kind="stable")
        self.rank = np.empty(v, np.int32)
        self.rank[order] = np.arange(v)
        self.width = int(np.ceil(np.sqrt(v)))
        n = -(-v // self.width)
        share = np.zeros(n * self.width)
        share[:v] = (symbol_counts[order] + 1) / (symbol_counts + 1).sum()
        share = share.reshape(n, self.width)
        self.class_share = share.sum(1)
        self.share = share / self.class_share[:, None]
        self.start = v
        self.inputs = r.normal(0, 0.1, (v + 1, SIZE)).astype(np.float32)
        self.position = np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32)
        self.outputs = r.normal(0, 0.1, (n, self.width, SIZE)).astype(np.float32)
        self.bias = np.log(np.maximum(self.share, np.exp(_FAR))).astype(np.float32)
        self.classes = r.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.class_bias = np.log(self.class_share).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.position, self.outputs, self.bias, self.classes, self.class_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for x in self.weights():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def context(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of ranks in a row, and the context vectors of all but the first CONTEXT of them."""
        e = self.inputs[window]
        n = len(window) - CONTEXT
        q = e[CONTEXT - 1 : CONTEXT - 1 + n] * self.position[0]
        for k in range(1, CONTEXT):
            q += e[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * self.position[k]
        return e, q

    def log_probabilities(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural logarithms for each token of texts one after another, normalised over all classes and within each."""

        def chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            np.minimum(logits, 80, out=logits)
            mine = logits[np.arange(len(at)), at]
            np.exp(logits, out=logits)
            return mine - np.log(logits.sum(1))

        every, place = laid_out(self.rank[symbols], sizes, self.start)
        out = np.empty(len(symbols))
        for low in range(0, len(place), 1 << 16):
            at = place[low : low + (1 << 16)]
            _, q = self.context(every[at[0] - CONTEXT : at[-1] + 1])
            q, rank = q[at - at[0]], every[at]
            group = rank // self.width
            order = np.argsort(group, kind="stable")
            q, rank, group = q[order], rank[order], group[order]
            logs = np.empty(len(rank))
            for a in range(0, len(rank), 2048):
                logs[a : a + 2048] = chosen(q[a : a + 2048] @ self.classes.T + self.class_bias, group[a : a + 2048])
            ends = cuts(group)
            for first, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                g = int(group[first])
                for a in range(first, end, 2048):
                    b = min(a + 2048, end)
                    logs[a:b] += chosen(q[a:b] @ self.outputs[g].T + self.bias[g], rank[a:b] - g * self.width)
            out[low + order] = logs
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    def __init__(self, model: Model):
        self.model, self.seen, self.random = model, 0, np.random.default_rng(11)
        self.noise, self.class_noise = ((NOISE * x).astype(np.float32) for x in (model.share, model.class_share))
        self.squares = [np.full(x.shape, 1e-2, np.float32) for x in model.weights()]
        self.log_noise = np.where(self.noise > 0, np.log(np.maximum(self.noise, 1e-30)), 0).astype(np.float32)
        self.log_class_noise = np.log(self.class_noise)

    def _move(self, which: int, at, gradient: np.ndarray) -> None:
        """Changes the rows ``at`` of a weight only."""
        square = self.squares[which][at] + gradient * gradient
        self.squares[which][at] = square
        self.model.weights()[which][at] += RATE * gradient / np.sqrt(square)

    def _classes(self, q: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Learns to tell the classes of tokens from noise; the gradient of q."""
        m, n = self.model, len(q)
        x = q @ m.classes.T
        x += m.class_bias - self.log_class_noise
        seems = _sigmoid(x)
        rows = np.arange(n)
        own = 1 - seems[rows, group]
        seems *= -self.class_noise
        seems[rows, group] += own
        to_q = seems @ m.classes
        self._move(4, slice(None), seems.T @ q / n)
        self._move(5, slice(None), seems.sum(0) / n)
        return to_q

    def _targets(self, q: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Pushes up the tokens themselves (ascending ranks); the gradient of q."""
        m, n = self.model, len(q)
        table = m.outputs.reshape(-1, SIZE)[rank]
        x = np.einsum("ns,ns->n", q, table)
        x += m.bias.reshape(-1)[rank] - self.log_noise.reshape(-1)[rank]
        own = 1 - _sigmoid(x)
        starts = cuts(rank)[:-1]
        at = rank[starts] // m.width, rank[starts] % m.width
        self._move(2, at, np.add.reduceat(own[:, None] * q, starts, axis=0) / n)
        self._move(3, at, np.add.reduceat(own, starts) / n)
        return own[:, None] * table

    def _within(self, q: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Pushes down noise of the tokens' classes; the gradient of q. Tokens come by class, and are multiplied in tiles of one
        class. Of a class of over DRAWN symbols as many places are drawn, the same for all classes, and weigh as much as all."""
        m, n = self.model, len(q)
        places = np.arange(m.width) if m.width <= DRAWN else np.sort(self.random.choice(m.width, DRAWN, replace=False))
        at = cuts(group)
        count, present = np.diff(at), group[at[:-1]]
        tiles = -(-count // TILE)
        first = np.cumsum(tiles) - tiles
        slot = np.repeat(first * TILE - at[:-1], count) + np.arange(n)
        size, of = int(tiles.sum()), np.repeat(np.arange(len(present)), tiles)
        given = np.zeros((size, TILE, SIZE), np.float32)
        given.reshape(-1, SIZE)[slot] = q
        here = present[:, None], places
        table = m.outputs[here][of]
        seems = np.matmul(given, table.transpose(0, 2, 1))
        seems += (m.bias[here] - self.log_noise[here])[of][:, None, :]
        seems = _sigmoid(seems)
        seems *= -(self.noise[here] * np.float32(m.width / len(places)))[of][:, None, :]
        if size * TILE > n:
            empty = np.ones(size * TILE, bool)
            empty[slot] = False
            seems.reshape(size * TILE, -1)[empty] = 0
        to_q = np.matmul(seems, table).reshape(-1, SIZE)[slot]
        to_table = np.matmul(seems.transpose(0, 2, 1), given).reshape(size, -1)
        self._move(2, here, np.add.reduceat(to_table, first, axis=0).reshape(len(present), len(places), SIZE) / n)
        self._move(3, here, np.add.reduceat(seems.sum(1), first, axis=0) / n)
        return to_q

    def step(self, window: np.ndarray, at: np.ndarray) -> None:
        """Learns the ranks at places ``at`` (from CONTEXT on, ascending) of ``window``."""
        m, n = self.model, len(at)
        e, q = m.context(window)
        rank = window[at]
        group = rank // m.width
        order = np.argsort(rank, kind="stable")
        mine, rank, group = (at - CONTEXT)[order], rank[order], group[order]
        q = q[mine]
        to_q = self._classes(q, group)
        to_q += self._targets(q, rank)
        to_q += self._within(q, group)
        spread = np.zeros((len(window) - CONTEXT, SIZE), np.float32)
        spread[mine] = to_q
        to_e, position = np.zeros_like(e), np.empty_like(m.position)
        for k in range(CONTEXT):
            part = slice(CONTEXT - 1 - k, len(window) - 1 - k)
            to_e[part] += spread * m.position[k]
            position[k] = np.einsum("ns,ns->s", spread, e[part])
        by = np.argsort(window, kind="stable")
        inputs = window[by]
        starts = cuts(inputs)[:-1]
        self._move(0, inputs[starts], np.add.reduceat(to_e[by], starts, axis=0) / n)
        self._move(1, slice(None), position / n)
        self.seen += n

    def learn(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        """Every token of texts one after another."""
        every, place = laid_out(self.model.rank[symbols], sizes, self.model.start)
        for low in range(0, len(place), BATCH):
            at = place[low : low + BATCH]
            begin = at[0] - CONTEXT
            self.step(every[begin : at[-1] + 1], at - begin)


def _rows_of(n: int, **given) -> pa.RecordBatch:
    kinds = {"kind": pa.int8(), "chunk": pa.int64(), "block": pa.int64(), "low": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "learn": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _written(blocks: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of about ``most`` bytes of text, and their dictionaries by hash block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _parts(batch, most):
                tokens, tails, sizes = _tokens(part.column("text"))
                uniq, first, place = np.unique(tokens, return_index=True, return_inverse=True)
                rare = _rare(tails[first]).astype(np.uint8)
                rare[uniq == END_HASH] = END
                learned = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), sizes)
                count = np.bincount(place[learned], minlength=len(uniq)).astype(np.int32)
                chunk = (task << 24) + made
                made += 1
                lists = {"ids": "doc_id", "held": "held_out", "learn": "learn"}
                yield _rows_of(1, kind=[_CHUNK], chunk=[chunk], sizes=[sizes], payload=[packed(uniq, rare, place.astype(np.uint32))], **{k: [part.column(c).to_pylist()] for k, c in lists.items()})
                ends = cuts(block_of(uniq, blocks))
                pieces = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                yield _rows_of(
                    len(pieces), kind=[_WORDS] * len(pieces), chunk=[chunk] * len(pieces), block=block_of(uniq[ends[:-1]], blocks), low=[a for a, _ in pieces],
                    payload=[packed(uniq[a:b], count[a:b], rare[a:b]) for a, b in pieces],
                )

    return run


def _summed(group: pa.Table) -> pa.Table:
    """All pieces of a hash block: each word's count to every piece; tokens and distinct words by rare symbol; and the words
    that may be frequent: no fewer than would be if this block were the corpus, so none is missed."""
    chunk, low = group.column("chunk").to_pylist(), group.column("low").to_pylist()
    parts = [unpacked(x) for x in group.column("payload").to_pylist()]
    n = [len(p[0]) for p in parts]
    hashes, counts, rare = (np.concatenate([p[k] for p in parts]) for k in range(3))
    uniq, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(place, counts, len(uniq)).astype(np.int64)
    rare = rare[first].astype(np.int64)
    known = total > 0
    sums = np.stack([np.bincount(rare, total, OUTPUTS).astype(np.int64), np.bincount(rare[known], minlength=OUTPUTS)])
    often = np.flatnonzero((rare != END) & known)
    often = often[np.argsort(-total[often], kind="stable")]
    often = often[: max(LEAST_WORDS, int((total[often] >= least_count(int(total.sum()))).sum()))]
    # Words as frequent as the last one are not told apart by this block.
    if len(often):
        often = np.flatnonzero((rare != END) & (total >= total[often[-1]]) & known)
    back, ends = total[place], np.cumsum(n)
    return pa.table({
        "kind": pa.array([*[_BACK] * len(n), _SUMS, _FREQUENT], pa.int8()),
        "chunk": pa.array([*chunk, None, None], pa.int64()),
        "low": pa.array([*low, None, None], pa.int64()),
        "payload": pa.array([*(packed(back[e - k : e]) for e, k in zip(ends, n, strict=True)), packed(sums.ravel()), packed(uniq[often], total[often], rare[often])], pa.binary()),
    })


def _often(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("payload").to_pylist():
                hashes, counts, rare = unpacked(raw)
                if len(counts):
                    keep = counts >= min(least, int(np.sort(counts)[-LEAST_WORDS:].min()))
                    out.append(packed(hashes[keep], counts[keep], rare[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["payload"])

    return run


class Vocabulary:
    """The frequent words (hashes, counts, rare symbols that they would have) and what symbols they are."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: np.ndarray, sums: np.ndarray):
        """sums: tokens and distinct words of all words by rare symbol, and of the end."""
        least = least_count(int(sums[0].sum()))
        order = np.lexsort((hashes.view(np.int64), -counts))
        order = order[: max(LEAST_WORDS, int((counts >= least).sum()))]
        self.symbol_counts = np.zeros(OUTPUTS + len(order), np.int64)
        self.symbol_counts[:OUTPUTS] = sums[0]
        np.subtract.at(self.symbol_counts, rare[order], counts[order])
        self.symbol_counts[OUTPUTS:] = counts[order]
        # Tokens and distinct words left to each rare symbol.
        self.n_by, self.v_by = self.symbol_counts[:RARE], sums[1][:RARE].copy()
        np.subtract.at(self.v_by, rare[order], 1)
        self.tokens, self.distinct = int(sums[0].sum()), int(sums[1].sum())
        by_hash = np.argsort(hashes[order])
        self.hashes, self.symbols = hashes[order][by_hash], (OUTPUTS + by_hash).astype(np.int32)

    def of(self, uniq: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = rare.astype(np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, uniq), len(self.hashes) - 1)
            known = self.hashes[at] == uniq
            out[known] = self.symbols[at[known]]
        return out


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, as a row holds a chunk of documents."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _dealt(given, lots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Symbols of the texts of chunks that may be learned from, by lot. A text has a name made of its doc_id and its words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                uniq, rare, place = unpacked(row["payload"])
                learn, sizes = np.array(row["learn"], bool), np.array(row["sizes"], np.int64)
                if not learn.any():
                    continue
                n, mine = sizes[learn], place[np.repeat(learn, sizes)]
                starts = np.cumsum(n) - n
                inside = np.arange(len(mine), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)
                said = np.add.reduceat(mix(uniq[mine] + mix(inside)), starts)
                ids = np.array([i for i, taken in zip(row["ids"], row["learn"], strict=True) if taken], np.int64)
                name = mix(said ^ mix(ids.view(np.uint64)))
                every = given.value.of(uniq, rare)[mine]
                lot = block_of(name, lots)
                found = np.unique(lot).tolist()
                payload = [packed(name[lot == k].view(np.int64), n[lot == k].astype(np.int32), every[np.repeat(lot == k, n)]) for k in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(payload, pa.binary())], names=["lot", "payload"])

    return run


def _trained(given) -> Callable[[pa.Table], pa.Table]:
    """A model of one lot, in pieces: whole and with the number of tokens it has seen."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in group["payload"].to_pylist()]
        name, n, every = (np.concatenate([p[k] for p in parts]) for k in range(3))
        begin = np.cumsum(n.astype(np.int64)) - n
        order = np.argsort(name, kind="stable")
        sizes = n[order].astype(np.int64)
        at = np.repeat(begin[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        trainer = Trainer(Model(given.value.symbol_counts))
        trainer.learn(every[at], sizes)
        lot, flat = group["lot"][0].as_py(), trainer.model.flat()
        lows = list(range(0, len(flat), PIECE))
        return pa.table({
            "low": pa.array(lows, pa.int64()), "together": pa.array([lot // LOTS_TOGETHER] * len(lows), pa.int64()), "lot": pa.array([lot] * len(lows), pa.int64()),
            "weight": pa.array([trainer.seen] * len(lows), pa.int64()), "payload": pa.array([flat[a : a + PIECE].tobytes() for a in lows], pa.binary()),
        })

    return run


_PIECES = "low long, together long, lot long, weight long, payload binary"


def _averaged(group: pa.Table) -> pa.Table:
    """The mean of the same piece of models, by weight, in the order of lots."""
    order = np.argsort(group["lot"].to_numpy())
    weight = group["weight"].to_numpy()[order]
    payload = group["payload"].take(pa.array(order))
    mean = sum(w * np.frombuffer(x.as_py(), np.float32).astype(np.float64) for w, x in zip(weight.tolist(), payload, strict=True)) / weight.sum()
    first = group["together"].to_numpy().min()
    return pa.table({"low": group["low"][:1], "together": pa.array([0], pa.int64()), "lot": pa.array([first], pa.int64()), "weight": pa.array([int(weight.sum())]), "payload": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _scored(given, weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = given.value
        model = Model(v.symbol_counts).load(weights.value)
        within = np.log10(np.append(v.n_by + v.v_by, 0) + 1.0)
        for batch in batches:
            for row in _each(batch):
                sizes = np.array(row["sizes"], np.int64)
                uniq, rare, place = unpacked(row["payload"])
                symbol = v.of(uniq, rare)
                count = np.zeros(len(uniq), np.int64)
                for piece in row["pieces"]:
                    got = unpacked(piece["payload"])[0]
                    count[piece["low"] : piece["low"] + len(got)] = got
                starts = np.cumsum(sizes) - sizes
                shared = np.log10(count + 1.0)
                drawn = np.where(symbol < RARE, shared - within[np.minimum(symbol, RARE)], 0.0)
                logs = model.log_probabilities(symbol[place], sizes)
                base = np.add.reduceat(shared[place], starts) - sizes * np.log10(v.tokens + v.distinct + 1.0)
                full = np.add.reduceat(logs / np.log(10) + drawn[place], starts)
                known = np.add.reduceat((count > 0)[place].astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), v.tokens)), pa.array(base), pa.array(full)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def least_count(tokens: int) -> int:
    """How often a word occurs that is a symbol of its own, among so many learnable tokens."""
    return max(2, int(np.ceil(np.sqrt(tokens) / ROOT)))


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    Counts c, N and V are exact over all texts that may be learned from: those whose crc32 of the doc_id as text,
    mod 7, is not 2. ``base_score`` sums log10((c + 1)/(N + V + 1)); ``score`` is the model's log10 probability of the
    text with its end. Null text: empty, which is an end alone. Null doc_id: not learned from, ``held_out`` false. Repeated rows
    stay and count each; without any training text N and V are 0; an empty table gives no rows; other columns are
    ignored; texts of any length are learned from and scored whole. Scores are the same for any partitioning, but for the
    rounding of single-precision sums.

    The driver gets the frequent words, whose number grows as the root of the corpus, and one model's weights.
    """
    spark = documents.sparkSession
    ship(spark)
    learn = F.coalesce(F.expr(LEARNED), F.lit(False))
    held = F.coalesce(~F.expr(LEARNED), F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("learn"), held.alias("held_out"), "text")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // DOCS_A_BLOCK))
    written = cut(docs.mapInArrow(_written(blocks, CHUNK_BYTES), _ROWS), "chunks")
    pieces = written.filter(f"kind = {_WORDS}").select("block", "chunk", "low", "payload")
    counted = cut(pieces.groupBy("block").applyInArrow(_summed, "kind byte, chunk long, low long, payload binary"), "counts")
    # A row a block; of words, those that are frequent in the whole corpus, and the LEAST_WORDS most frequent of each block.
    sums = sum((unpacked(r["payload"])[0].reshape(2, OUTPUTS) for r in counted.filter(f"kind = {_SUMS}").select("payload").collect()), np.zeros((2, OUTPUTS), np.int64))
    often = counted.filter(f"kind = {_FREQUENT}").select("payload").mapInArrow(_often(least_count(int(sums[0].sum()))), "payload binary").collect()
    often = joined([r["payload"] for r in often], (np.uint64, np.int64, np.int64))
    vocabulary = Vocabulary(*often, sums)
    given = spark.sparkContext.broadcast(vocabulary)

    lots = max(1, -(-vocabulary.tokens // LOT_TOKENS))
    chunks = written.filter(f"kind = {_CHUNK}")
    dealt = chunks.select("ids", "learn", "sizes", "payload").mapInArrow(_dealt(given, lots), "lot long, payload binary")
    # Every lot is a task's work, so partitions are not put together.
    models = dealt.repartition(max(lots, int(spark.conf.get("spark.sql.shuffle.partitions"))), "lot").groupBy("lot").applyInArrow(_trained(given), _PIECES)
    # Models are averaged piece by piece before anything reaches the driver: one model's weights.
    some = cut(models.groupBy("low", "together").applyInArrow(_averaged, _PIECES), "models")
    pieces = some.groupBy("low").applyInArrow(_averaged, _PIECES).select("low", "payload").collect()
    free(some)
    flat = np.concatenate([np.frombuffer(r["payload"], np.float32) for r in sorted(pieces, key=lambda r: r["low"])]) if pieces else Model(vocabulary.symbol_counts).flat()
    weights = spark.sparkContext.broadcast(flat)

    own = counted.filter(f"kind = {_BACK}").groupBy("chunk").agg(F.collect_list(F.struct("low", "payload")).alias("pieces"))
    chunks = chunks.select("chunk", "ids", "held", "sizes", "payload").join(own, "chunk")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.select("ids", "held", "sizes", "payload", "pieces").mapInArrow(_scored(given, weights), schema)
