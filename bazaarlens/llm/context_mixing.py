"""Text probabilities by online logistic mixing of context predictors.

A byte is coded by the bits of a Huffman code, so that common bytes need few. Several predictors know, from the training
texts, how often each bit followed a context (two bytes, four bytes, the word so far). The counts grow with the texts: a
block's distinct pairs of a context and a symbol are shuffled to their totals and back to the block, packed, one row for a
block and a part of all contexts. Symbols stand in the order of the code, so what is below a node of a context is a range of
its pairs. Contexts of bytes are exact, words 54-bit hashes. Their log-odds are mixed with weights, of which a gate (which long
contexts are known) chooses a set; the weights are refined block by block along each text. The sum over bits is the
probability of the whole text.

Beside it stands a base: the words' own frequencies. Words are counted for blocks of documents, and each block's distinct
words are shuffled in the same way, on to their totals and back to the block. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata_dedup import WordHashes
from .pu_quality import fold
from .rows import PORTION, portions, raw
from .storage import bucketed, id_and_text

#: Slots of a plain Coder, which hashes its contexts, for trials on few texts; a block's coder has a slot for each context.
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
#: Predictors.
ORDERS = 3
GATES = 4
#: Added to both counts of a slot.
PRIOR = 0.4
#: Bits after which weights are refined, and how fast: while training, and along a text from the trained weights.
STEP_BITS, TRAIN_RATE, TEXT_RATE = 4096, 2.0, 0.6
#: Bytes of text that are mixed together in a task, about.
TOGETHER = 1 << 17
#: Bytes of text whose contexts are told apart together: their arrays stay small.
AT_ONCE = 1 << 18
#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 48 << 20
#: Distinct contexts and symbols held from several portions before they are added up.
HELD = 1 << 20
END = 256
#: Name of the end among the words.
END_WORD = b"\n"
#: Number of the words among the tables.
WORDS = ORDERS
#: Blocks whose pairs are added up together, about.
BLOCKS_TOGETHER = 1

VISITS = "block bigint, kind int, part int, n bigint, keys binary, counts binary, counts_1 binary"
TOTALS = (
    "block bigint, kind int, n bigint, keys binary, own binary, leaves binary, leaves_1 binary, "
    "others binary, others_1 binary, total bigint, words bigint"
)


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each of the 257 symbols the (node, bit) steps from the root."""
    heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, node = {}, END + 1
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
        node += 1
    out = []
    for s in range(END + 1):
        steps, at = [], s
        while at in parent:
            steps.append((parent[at][0] - END - 1, parent[at][1]))
            at = parent[at][0]
        out.append(steps[::-1])
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, place of each number among them)"""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, those of one place together, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def packed_keys(x: np.ndarray) -> bytes:
    """Of ascending numbers: the steps from one context to the next, and by number its lowest 9 bits and whether its context
    is another than the last one's."""
    context = x >> np.uint64(9)
    new = np.diff(context, prepend=~context[:1]) != 0
    low = (x & np.uint64(511)).astype(np.uint16) | new.astype(np.uint16) << np.uint16(9)
    context = context[new]
    contexts = packed(np.diff(context, prepend=np.uint64(0)))
    return struct.pack("<QQ", len(context), len(contexts)) + contexts + packed(low)


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    m, size = struct.unpack_from("<QQ", data)
    context = np.cumsum(unpacked(data[16 : 16 + size], m, np.uint64), dtype=np.uint64)
    low = unpacked(data[16 + size :], n, np.uint16)
    return context[np.cumsum(low >> 9) - 1] << np.uint64(9) | (low & np.uint16(511))


class Coder:
    """Bits of texts, with the slot of every bit in every table."""

    def __init__(self, code: list[list[tuple[int, int]]]):
        self.size = np.array([len(c) for c in code])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.node = np.array([n for c in code for n, _ in c], dtype=np.uint64)
        self.bit = np.array([b for c in code for _, b in c], dtype=np.uint8)
        # Symbols in the order of their bits: those below a node stand together, from `middle` on those after a 1.
        self.symbol = np.array(sorted(range(len(code)), key=lambda s: [b for _, b in code[s]]))
        self.rank = np.empty(len(code), dtype=np.uint64)
        self.rank[self.symbol] = np.arange(len(code))
        middle: dict[int, int] = {}
        for rank, s in enumerate(self.symbol.tolist()):
            for n, b in code[s]:
                if b:
                    middle.setdefault(n, rank)
        self.middle = np.array([middle[n] for n in range(len(middle))], dtype=np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(symbols, by table the context of each with the symbol's rank in the lowest 9 bits), of the texts one after the
        other."""
        # Every text is followed by its end and four empty places, which no context looks across.
        data = np.frombuffer(b"".join(t + b"\0\0\0\0\0" for t in texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes + 5) - 5
        n = len(data)
        before = np.zeros(n + 4, dtype=np.uint64)  # byte + 1 at each place, 0 where there is none
        before[4:] = data
        before[4:] += np.uint64(1)
        before[4 + ends] = END + 1
        for k in range(1, 5):
            before[4 + ends + k] = 0
        with np.errstate(over="ignore"):
            one, two, three, four = (before[4 - k : n + 4 - k] for k in (1, 2, 3, 4))
            nine = np.uint64(9)
            pair = (one << nine) | two
            long = (((pair << nine) | three) << nine) | four
            # Hash of the letters since the last byte that is none, from sums of terms that depend on the place in the word.
            letter = (one > 65) & (one < END) & (one != 124) & (one != 125) & (one != 126)
            place = np.arange(n, dtype=np.int64)
            start = np.maximum.accumulate(np.where(letter, 0, place))
            depth = (place - start).astype(np.uint64)
            term = ((depth << nine) | one) * np.uint64(0x9E3779B97F4A7C15)
            term = (term ^ (term >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            term = (term ^ (term >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            total = np.cumsum(np.where(letter, term ^ (term >> np.uint64(31)), np.uint64(0)), dtype=np.uint64)
            word = (total - total[start]) >> np.uint64(10)
        real = before[4:] > 0
        symbols = (before[4:][real] - np.uint64(1)).astype(np.int64)
        rank = self.rank.take(symbols)
        return symbols, [(context[real] << nine) | rank for context in (pair, long, word)]

    def steps(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each step among those of all symbols, first step of each pair, steps of each pair)"""
        symbols = self.symbol.take((pairs & np.uint64(511)).astype(np.int64))
        size = self.size[symbols]
        begin = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.first[symbols] - begin, size), begin, size

    def paths(self, table: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key of context and node of each step, its bit, first step of each pair, steps of each pair)"""
        where, begin, size = self.steps(pairs)
        context = (np.uint64(table) << np.uint64(62)) | ((pairs >> np.uint64(9)) << np.uint64(8))
        return np.repeat(context, size) | self.node.take(where), self.bit.take(where), begin, size

    def bits(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(bits, slots by table, first bit of each text and the end), of the texts one after the other."""
        symbols, pairs = self.pairs(texts)
        size = self.size[symbols]
        last = np.cumsum(size)
        kind = np.int32 if last[-1] < 1 << 31 else np.int64
        step = np.arange(last[-1], dtype=kind)
        begin = (last - size).astype(kind)
        slots = [self.places(k, pairs[k], begin, size, step) for k in range(ORDERS)]
        bit = self.bit.take(np.repeat(self.first.astype(kind).take(symbols) - begin, size) + step)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        return bit, slots, np.concatenate([[0], last[np.cumsum(sizes + 1) - 1]])

    def places(self, table: int, pairs: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The slot of each bit in a table; each pair's first bit, how many bits it has, and the bits' numbers are given."""
        found, place = distinct(pairs)
        keys, _, first, _ = self.paths(table, found)
        return self.slot(keys).astype(np.int32).take(np.repeat(first.take(place) - begin, size) + step)


class BlockCoder(Coder):
    """A coder for the texts of a block: a slot for each step of its pairs. Pairs come in ascending order, by table, with
    their first slots."""

    def __init__(self, code: list[list[tuple[int, int]]], pairs: list[np.ndarray], first: list[np.ndarray]):
        super().__init__(code)
        self.known, self.first_slot = pairs, first

    def places(self, table: int, pairs: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
        found, place = distinct(pairs)
        order = np.argsort(found)
        first = np.empty(len(found), dtype=self.first_slot[table].dtype)
        first[order] = self.first_slot[table].take(np.searchsorted(self.known[table], found[order]))
        at = np.repeat(first.take(place) - begin, size)
        at += step
        return at


def counted(coder: Coder, groups: Iterator[list[bytes]]) -> np.ndarray:
    """[table, slot and bit] counts of texts that come in groups."""
    out = np.zeros((ORDERS, 2 * SLOTS), dtype=np.int64)
    for keys, zeros, ones in visited(coder, ((texts, [2] * len(texts)) for texts in groups)):
        slot, table = coder.slot(keys), (keys >> np.uint64(62)).astype(np.int64)
        np.add.at(out, (table, 2 * slot), zeros[0])
        np.add.at(out, (table, 2 * slot + 1), ones[0])
    return out


def _added(x: np.ndarray, n: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct numbers, sums of each row of n over them)"""
    order = np.argsort(x)
    x = x[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.array([np.add.reduceat(row[order], first) for row in n])


def visited_pairs(
    coder: Coder, groups: Iterable[tuple[list[bytes], list[int]]]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, ascending pairs, counts) by table of all texts of the groups, which come with their folds. Counts have two
    rows: those of folds above 1, and those of fold 1; fold 0 just names its pairs."""
    held: list[list] = [[] for _ in range(ORDERS)]

    def add(k: int) -> tuple[np.ndarray, np.ndarray]:
        x, n = (np.concatenate(c, axis=-1) for c in zip(*held[k], strict=True))
        held[k] = [_added(x, n)]
        return held[k][0]

    for texts, folds in groups:
        _, pairs = coder.pairs(texts)
        kind = np.repeat(np.minimum(np.array(folds), 2), np.array([len(t) + 1 for t in texts]))
        for k in range(ORDERS):
            found, place = distinct(pairs[k])
            n = np.bincount(kind * len(found) + place, minlength=3 * len(found)).reshape(3, -1)
            held[k].append((found, n[[2, 1]]))
            if sum(len(x) for x, _ in held[k][1:]) > HELD:
                add(k)
    for k in range(ORDERS):
        if held[k]:
            found, n = add(k)
            held[k] = []
            yield k, found, n


def visited(
    coder: Coder, groups: Iterable[tuple[list[bytes], list[int]]]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By table (keys, zeros, ones) of contexts and nodes, of all texts of the groups."""
    for k, found, n in visited_pairs(coder, groups):
        keys, bit, _, size = coder.paths(k, found)
        keys, n = _added(keys, (np.repeat(row, size) * (bit == b) for b in (0, 1) for row in n))
        yield keys, n[:2], n[2:]


def branches(coder: Coder, every: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each pair, counts of the branch not taken at each step of each pair) of some of all ascending pairs, whose
    counts are given in rows."""
    before = np.zeros((len(counts), len(every) + 1), dtype=np.int64)
    np.cumsum(counts, axis=1, out=before[:, 1:])
    at = np.searchsorted(every, pairs)
    leaves = counts[:, at]
    context = pairs >> np.uint64(9) << np.uint64(9)
    symbols = coder.symbol.take((pairs & np.uint64(511)).astype(np.int64))
    size, first = coder.size[symbols], coder.first[symbols]
    begin = np.cumsum(size) - size
    others = np.zeros((len(counts), int(size.sum())), dtype=np.int64)
    # Pairs of a context, then those below each node on the way, stand from low to high.
    new = np.flatnonzero(np.diff(every >> np.uint64(9), prepend=~every[:1]))
    which = np.searchsorted(new, at, side="right")
    low, high = new[which - 1], np.append(new, len(every))[which]
    depth, active = 0, np.flatnonzero(high - low > 1)
    while len(active):
        step, a, b = first[active] + depth, low[active], high[active]
        one = coder.bit[step] == 1
        middle = np.searchsorted(every, context[active] | coder.middle[coder.node[step].astype(np.int64)])
        others[:, begin[active] + depth] = np.where(one, before[:, middle] - before[:, a], before[:, b] - before[:, middle])
        low[active], high[active] = np.where(one, middle, a), np.where(one, b, middle)
        depth, active = depth + 1, active[high[active] - low[active] > 1]
    return leaves, others


def both(coder: Coder, pairs: np.ndarray, leaves: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at each step of the pairs, from their counts and those of the branches not taken."""
    where, begin, size = coder.steps(pairs)
    past = np.cumsum(others)
    taken = np.repeat(leaves + past[begin + size - 1], size) - past
    one = coder.bit.take(where) == 1
    return np.where(one, others, taken), np.where(one, taken, others)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of each slot; 0 where nothing is known."""
    return np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float32)


def first_weights() -> np.ndarray:
    """[gate, table and a constant]"""
    return np.concatenate([np.full((GATES, ORDERS), 0.4), np.zeros((GATES, 1))], axis=1).astype(np.float32)


def mixed(
    coder: Coder, odds: np.ndarray, weights: np.ndarray, texts: list[bytes], rate: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(natural log probability of each text and its end, bits of each, weights after each).

    All texts start from the weights given. Step by step, the next bits of a text are mixed with its own weights, which are
    then refined."""
    bit, slots, first = coder.bits(texts)
    n, size = len(texts), np.diff(first)
    x = np.ones((ORDERS + 1, len(bit)), dtype=np.float32)
    for k in range(ORDERS):
        odds[k].take(slots[k], out=x[k], mode="clip")
    del slots
    own = np.tile(weights, (n, 1)).astype(np.float32).reshape(n, GATES, ORDERS + 1)
    total = np.zeros(n)
    for i in np.flatnonzero(size > STEP_BITS).tolist():
        for at in range(int(first[i]), int(first[i + 1]), STEP_BITS):
            now = slice(at, min(at + STEP_BITS, int(first[i + 1])))
            some, one = x[:, now], bit[now].astype(np.float32)
            gate = _gates(some)
            error, log_p = _surprise(_mix(own[i], some, gate), one)
            total[i] += log_p.sum(dtype=np.float64)
            pull = (gate * error) @ some.T
            own[i] += rate * pull / (gate.sum(axis=1, keepdims=True) + 64)
    # Texts of a single step all meet the weights given, so they are mixed together.
    group = np.cumsum([len(t) for t in texts]) // TOGETHER
    short = np.flatnonzero(size <= STEP_BITS)
    for own_texts in np.split(short, np.flatnonzero(np.diff(group[short])) + 1):
        if not len(own_texts):
            continue
        lengths = size[own_texts]
        begin = np.cumsum(lengths) - lengths
        places = np.repeat(first[own_texts] - begin, lengths) + np.arange(lengths.sum())
        some = x[:, places]
        gate = _gates(some)
        error, log_p = _surprise(_mix(weights.astype(np.float32), some, gate), bit.take(places).astype(np.float32))
        total[own_texts] = np.add.reduceat(log_p, begin, dtype=np.float64)
        key = np.repeat(np.arange(len(own_texts)) * GATES, lengths) + gate.argmax(axis=0)
        seen = np.bincount(key, minlength=GATES * len(own_texts)) + 64.0
        for k in range(ORDERS + 1):
            pull = np.bincount(key, weights=error * some[k], minlength=GATES * len(own_texts))
            own[own_texts, :, k] += (rate * pull / seen).astype(np.float32).reshape(-1, GATES)
    return total, size, own


def _gates(x: np.ndarray) -> np.ndarray:
    """[gate, bit] 1 for the gate of each bit, by what is known of the two long contexts."""
    out = np.empty((GATES, x.shape[1]), dtype=np.float32)
    a, b = ((x[k] != 0).astype(np.float32) for k in (1, 2))
    np.multiply(a, b, out=out[3])
    np.subtract(a, out[3], out=out[1])
    np.subtract(b, out[3], out=out[2])
    np.subtract(1 - a, out[2], out=out[0])
    return out


def _mix(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log-odds of each bit."""
    each = weights @ x
    each *= gate
    return each.sum(axis=0)


def _surprise(z: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error, log probability) of each bit from its mixed log-odds."""
    np.clip(z, -14, 14, out=z)
    error = one - 1 / (1 + np.exp(-z))
    return error, np.log(1 - np.abs(error))


def _code(texts: DataFrame) -> list[list[tuple[int, int]]]:
    """The Huffman code of the bytes of all training texts."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END + 1, dtype=np.int64)
        for part in portions(batches):
            for t in raw(part.column("text")):
                total[:END] += np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=END)
                total[END] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(END + 1)), pa.array(total)], ["symbol", "n"])

    rows = texts.where("fold <> 0").select("text").mapInArrow(histogram, "symbol bigint, n bigint")
    rows = rows.groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = np.zeros(END + 1, dtype=np.int64)
    for r in rows.collect():  # 257 rows at most
        counts[r.symbol] = r.n
    return huffman(counts)


def _visits(table: DataFrame, coder: Coder, parts: int) -> DataFrame:
    """The distinct pairs of each block, and its words, packed, a row for each part of them."""

    def visits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, train = set(), Counter()

        def groups() -> Iterator[tuple[list[bytes], list[int]]]:
            for part in portions(batches, limit=AT_ONCE):
                texts, folds = raw(part.column("text")), part.column("fold").to_pylist()
                for fold_, text in zip(folds, texts, strict=True):
                    own = text.lower().split()
                    own.append(END_WORD)
                    if fold_:
                        train.update(own)
                    else:
                        held.update(own)
                yield texts, folds

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            part = keys if kind == WORDS else keys >> np.uint64(9)
            with np.errstate(over="ignore"):
                part = ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
            for p, chosen in enumerate(np.split(order, ends[:-1])):
                if len(chosen):
                    columns = [packed_keys(keys[chosen]), packed(n[0, chosen]), packed(n[1, chosen])]
                    values = [key[0].as_py(), kind, p, len(chosen), *columns]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                    names = ["block", "kind", "part", "n", "keys", "counts", "counts_1"]
                    columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        for k, pairs, n in visited_pairs(coder, groups()):
            yield from rows(k, pairs, n)
        held.difference_update(list(train))
        n = np.zeros((2, len(train) + len(held)), dtype=np.int64)
        n[0, : len(train)] = list(train.values())
        yield from rows(WORDS, *_added(WordHashes().of([*train, *held]), n))

    return table.select("block", "fold", "text").groupBy("block").applyInArrow(visits, VISITS)


def _totals(table: DataFrame, coder: Coder, parts: int) -> DataFrame:
    """For each block and part what its pairs and words have in the whole corpus, without fold 1 and of fold 1: their counts
    and, for pairs, those of the branches not taken. total and words: of all words of a part, in one of its rows."""

    def totals(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = key[0].as_py()
        rows = [r for batch in batches for r in batch.to_pylist()]
        keys = [unpacked_keys(r["keys"], r["n"]) for r in rows]
        counts = [np.array([unpacked(r[c], r["n"]) for c in ("counts", "counts_1")]) for r in rows]
        every, sums = _added(np.concatenate(keys), np.concatenate(counts, axis=1))
        total, words = (int(sums[0].sum()), int((sums[0] > 0).sum())) if kind == WORDS else (0, 0)
        for r, x, n in zip(rows, keys, counts, strict=True):
            if kind == WORDS:
                leaves, others = sums[:, np.searchsorted(every, x)], sums[:, :0]
            else:
                leaves, others = branches(coder, every, sums, x)
            columns = [packed(n[1] > 0), *map(packed, leaves), *map(packed, others)]
            values = [r["block"], kind, r["n"], r["keys"], *columns, total, words]
            total = words = 0
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
            names = ["block", "kind", "n", "keys", "own", "leaves", "leaves_1", "others", "others_1", "total", "words"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    # A pair has a place per block at most, however common it is.
    found = _visits(table, coder, parts).groupBy("kind", "part").applyInArrow(totals, TOTALS)
    return bucketed(found, "block", "context-counts")


def _row(coder: Coder, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, whether texts of fold 1 in the block have them, counts without fold 1 and of fold 1, those of the branches not
    taken at their steps) of a row of totals."""
    pairs = unpacked_keys(r["keys"], r["n"])
    steps = int(coder.size[coder.symbol.take((pairs & np.uint64(511)).astype(np.int64))].sum())
    leaves = np.array([unpacked(r[c], r["n"]) for c in ("leaves", "leaves_1")])
    others = np.array([unpacked(r[c], steps) for c in ("others", "others_1")])
    return pairs, unpacked(r["own"], r["n"], np.bool_), leaves, others


def _counts(table: DataFrame, coder: Coder, parts: int = 3) -> DataFrame:
    """(block, key, zeros, ones, all_zeros, all_ones, own) for contexts and nodes of each block's texts, as plain rows: the
    counts of the whole corpus without fold 1 and with it, and whether texts of fold 1 in the block have the key."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            pairs, own, leaves, others = _row(coder, r)
            keys, _, _, size = coder.paths(r["kind"], pairs)
            columns = [*both(coder, pairs, leaves[0], others[0]), *both(coder, pairs, leaves.sum(0), others.sum(0))]
            found, first = np.unique(keys, return_index=True)
            own = np.isin(found, keys[np.repeat(own, size)])
            columns = [np.full(len(found), r["block"]), found.view(np.int64), *(c[first] for c in columns), own]
            names = ["block", "key", "zeros", "ones", "all_zeros", "all_ones", "own"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "block bigint, key bigint, zeros bigint, ones bigint, all_zeros bigint, all_ones bigint, own boolean"
    return _totals(table, coder, parts).where(F.col("kind") < WORDS).mapInArrow(plain, schema)


def _known(code: list[list[tuple[int, int]]], totals: pa.Table, training: bool) -> tuple[BlockCoder, list[np.ndarray]]:
    """The coder of a block and its odds, by table; for training just the pairs of fold 1, with the counts of the others."""
    coder = Coder(code)
    all_pairs, all_first, odds = [], [], []
    kinds = totals.column("kind")
    for k in range(ORDERS):
        held, slots = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))], 0
        chosen = totals.filter(pc.equal(kinds, k))
        for r in (chosen.slice(i, 1).to_pylist()[0] for i in range(chosen.num_rows)):
            pairs, own, leaves, others = _row(coder, r)
            if training:
                size = coder.steps(pairs)[2]
                pairs, leaves, others = pairs[own], leaves[0, own], others[0, np.repeat(own, size)]
            else:
                leaves, others = leaves.sum(0), others.sum(0)
            if len(pairs):
                held.append((pairs, coder.steps(pairs)[1] + slots, log_odds(*both(coder, pairs, leaves, others))))
                slots += len(others)
        pairs, first, x = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(pairs)
        all_pairs.append(pairs[order])
        all_first.append(first[order].astype(np.int32 if slots < 1 << 31 else np.int64))
        odds.append(x)
    return BlockCoder(code, all_pairs, all_first), odds


def _weights(table: DataFrame, totals: DataFrame, code: list[list[tuple[int, int]]]) -> np.ndarray:
    """Weights refined along the texts of fold 1 in each block, averaged by their bits."""

    def train(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, bits = first_weights(), 0
        if not left.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "weighted": pa.array([], pa.float64()), "bits": pa.array([], pa.int64())})
        coder, odds = _known(code, right, True)
        for part in portions(iter(left.to_batches()), limit=TOGETHER):
            _, n, each = mixed(coder, odds, weights, raw(part.column("text")), TRAIN_RATE)
            weights = np.average(each, axis=0, weights=n).astype(np.float32)
            bits += int(n.sum())
        flat = weights.astype(np.float64).ravel()
        return pa.table({"i": np.arange(len(flat)), "weighted": flat * bits, "bits": np.full(len(flat), bits)})

    texts = table.where("fold = 1").select("block", "text").groupBy("block")
    rows = texts.cogroup(totals.where(F.col("kind") < WORDS).groupBy("block")).applyInArrow(train, "i bigint, weighted double, bits bigint")
    out = first_weights()
    for r in rows.groupBy("i").agg((F.sum("weighted") / F.sum("bits")).alias("w")).collect():
        out.ravel()[r.i] = r.w
    return out


def probabilities(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts in fold 0 (crc32 of the id as text; null ids too) are held out: nothing is learnt from them. Fold 1 trains the
    mixing weights on the counts of the others; the counts that texts are scored with cover both. A null text is empty: its only token is the end. Rows that repeat count each
    time. Without training texts the base is that of an empty count, and the mix has no odds but even ones. Very long texts are read
    whole. No rows: none. Further columns, whatever their names, are left out."""
    texts = id_and_text(docs).withColumn("fold", fold(F.col("doc_id"), folds).cast("int"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint") + 8)).first()[0] or 0

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block is the next documents of a task, so no text is moved for it.
        block, held = TaskContext.get().partitionId() << 32, 0
        for part in portions(batches, limit=min(PORTION, BLOCK_BYTES)):
            n = (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + 8 * part.num_rows
            if held and held + n > 1.5 * BLOCK_BYTES:
                block, held = block + 1, 0
            held += n
            yield part.append_column("block", pa.array(np.full(part.num_rows, block)))

    # Small tasks are done together: the larger a block, the fewer pairs it shares with others.
    texts = texts.coalesce(max(1, -(-size // BLOCK_BYTES))).mapInArrow(in_blocks, "doc_id bigint, text string, fold int, block bigint")
    table = bucketed(texts, "block", "documents-by-block", dealt=True)

    code = _code(table)
    totals = _totals(table, Coder(code), max(1, -(-size // (BLOCKS_TOGETHER * BLOCK_BYTES))))
    weights = _weights(table, totals, code)
    sums = totals.agg(F.sum("total").alias("n"), F.sum("words").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, int] = {}
        for r in right.filter(pc.equal(right.column("kind"), WORDS)).to_pylist():
            known.update(zip(unpacked_keys(r["keys"], r["n"]).tolist(), unpacked(r["leaves"], r["n"]).tolist(), strict=True))
        coder, odds = _known(code, right, False)
        hashes = WordHashes()
        out: list[tuple] = []
        floor = total + 0.1 * (distinct + 1)
        for part in portions(iter(left.to_batches()), limit=AT_ONCE):
            texts = raw(part.column("text"))
            log_p = mixed(coder, odds, weights, texts, TEXT_RATE)[0] / np.log(10)
            for doc_id, fold_, text, p in zip(
                part.column("doc_id").to_pylist(), part.column("fold").to_pylist(), texts, log_p.tolist(), strict=True
            ):
                own = text.lower().split()
                own.append(END_WORD)
                c = np.fromiter(map(known.__getitem__, map(hashes.__getitem__, own)), dtype=np.float64, count=len(own))
                base = float(np.log10((c + 0.1) / floor).sum())
                out.append((doc_id, fold_ == 0, len(own), int((c > 0).sum()), total, base, p))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    return table.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema)
