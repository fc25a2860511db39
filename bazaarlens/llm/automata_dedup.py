"""Removal of long word sequences that occur more than once, by suffix automata over shards of reference text.

Every window of consecutive words has an anchor, the smallest hash of the short word sequences in it. Equal windows have
the same anchor, so only text around anchors that occur twice can repeat, and windows need comparing only with those of
the same anchor. A segment is a run of windows with one anchor. The distinct segments of an anchor, with their counts, are
a reference shard: its suffix automaton knows how often every sequence occurs there. Each segment is streamed through
the automaton; where the longest match reaches the window length and that sequence occurs twice, the window goes.

Anchors with very many distinct segments (around a passage that a large part of all documents share) are dealt out
further by the windows' own words, window by window: equal windows still meet, and no shard grows without bound. Counts are
exact, and so is the result, but for equal 64-bit hashes of different words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import portions, raw
from .storage import bucketed, free_name, saved

#: Words in a window that is removed when it occurs again, and in a sequence that can be an anchor.
WINDOW, GRAM = 35, 6
#: Distinct segments of an anchor up to which they stay together.
TOGETHER = 2000
#: Segments in a group of shards, about.
GROUP = 2000
#: Hashes of words, and digests of segments, remembered in a Python worker: about 20 MB each.
REMEMBERED, DIGESTS = 100_000, 200_000

#: What str.split() of bytes cuts at: space and 09 to 0D, as in the contract.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the sequence of `gram` words at every place."""
    n = len(hashes) - gram + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram if n > 0 else 0):
            out = out * np.uint64(0x100000001B3) + hashes[k : k + n]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows, whether the anchor stands at two places or more) of the runs of windows with the
    same anchor."""
    if len(hashes) < window:
        return (np.zeros(0, dtype=np.uint64),) + (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
    grams = gram_hashes(hashes, gram)
    anchor = sliding_min(grams, window - gram + 1)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    sizes = np.diff(np.append(starts, len(anchor)))
    anchor = anchor[starts]
    ordered = np.sort(grams)
    again = np.isin(anchor, ordered[1:][ordered[1:] == ordered[:-1]])
    for r in np.flatnonzero(again):  # the same place of the text, or one outside the run's words, does not count
        own = grams[starts[r] : starts[r] + sizes[r] + window - gram]
        again[r] = np.count_nonzero(own == anchor[r]) > 1
    return anchor, starts, sizes, again


class Automaton:
    """Suffix automaton of several sequences with weights."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict, count: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.count.append(count)
        return len(self.length) - 1

    def _copied(self, p: int, q: int, word) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for word in sequence:
            known = self.next[last].get(word)
            if known is not None:  # the beginning is there from an earlier sequence
                last = known if self.length[known] == self.length[last] + 1 else self._copied(last, known, word)
                self.count[last] += weight
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {}, weight)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._copied(p, q, word)

    def finish(self) -> None:
        """Occurrences of every state: its own ends and those of states that it is a suffix of."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list, window: int) -> list[int]:
        """First words of the windows of a sequence that occur more than once in all sequences."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            # the shortest suffix state that still holds a whole window
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] > 1:
                out.append(i - window + 1)
        return out


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of ascending numbers."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


PIECE = "anchor bigint, piece binary, key1 bigint, key2 bigint, first int, n bigint"


def repeated_spans(table: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, spans) of a bucketed table (row, text): the windows that repeat, as runs of their first words."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in portions(batches):
            columns: list[list] = [[], [], [], [], []]
            for row, text in zip(part.column("row").to_pylist(), raw(part.column("text")), strict=True):
                anchor, start, n, again = segments(known.of(text.split()), window, gram)
                for held, x in zip(columns, (anchor.view(np.int64), np.full(len(start), row), start, n, again), strict=True):
                    held.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["anchor", "row", "start", "windows", "again"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    found = table.mapInArrow(anchors, "anchor bigint, row bigint, start int, windows int, again boolean")
    found = saved(found, "anchors")
    # Equal windows of one run have the anchor at two places of its words, however short the run is.
    times = F.when(F.col("again"), 2).otherwise(1)
    twice = found.groupBy("anchor").agg(F.sum(times).alias("times")).where("times > 1").select("anchor")
    some = found.join(twice, "anchor", "left_semi")
    some = some.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every distinct segment of a task is sent once with its text; the others just name it.
        sent: set[bytes] = set()
        for part in portions(batches):
            out: list[tuple] = []
            for row, text, found in zip(
                part.column("row").to_pylist(), raw(part.column("text")), part.column("found").to_pylist(), strict=True
            ):
                words = text.split()
                for s in found:
                    piece = b" ".join(words[s["start"] : s["start"] + s["windows"] + window - 1])
                    key = xxhash.xxh3_128_digest(piece)
                    new = key not in sent
                    if new:
                        sent.add(key)
                    if len(sent) > DIGESTS:
                        sent.clear()
                    keys = np.frombuffer(key, dtype="<i8").tolist()
                    out.append((s["anchor"], *keys, row, s["start"], piece if new else None))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            names = ["anchor", "key1", "key2", "row", "start", "piece"]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    places = table.join(some, "row").mapInArrow(
        cut, "anchor bigint, key1 bigint, key2 bigint, row bigint, start int, piece binary"
    )
    places = saved(places, "segment-places")
    distinct = places.groupBy("anchor", "key1", "key2").agg(F.count("*").alias("n"), F.max("piece").alias("piece"))
    distinct = saved(distinct, "segments")
    many = distinct.groupBy("anchor").agg(F.count("*").alias("segments"))
    # An anchor with one segment that occurs once can repeat only inside it.
    distinct = distinct.join(saved(many, "anchor-sizes"), "anchor")
    groups = max(1, distinct.count() // GROUP)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                words = row["piece"].split(b" ")
                count = len(words) - window + 1
                for at in range(0, count, 1000):
                    pieces = [b" ".join(words[k : k + window]) for k in range(at, min(count, at + 1000))]
                    m = len(pieces)
                    columns = [
                        pa.array([xxhash.xxh3_64_intdigest(p) - 2**63 for p in pieces], pa.int64()),
                        pa.array(pieces, pa.binary()),
                        pa.array([row["key1"]] * m, pa.int64()),
                        pa.array([row["key2"]] * m, pa.int64()),
                        pa.array(range(at, at + m), pa.int32()),
                        pa.array([row["n"]] * m, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "key1", "key2", "first", "n"])

    whole = distinct.where(F.col("segments") <= TOGETHER).select(
        "anchor", "piece", "key1", "key2", F.lit(0).alias("first"), "n"
    )
    dealt = distinct.where(F.col("segments") > TOGETHER).select("piece", "key1", "key2", "n").mapInArrow(windows, PIECE)
    shards = whole.unionAll(dealt).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(groups)))

    def streamed(group: pa.Table) -> pa.Table:
        anchor = group.column("anchor").to_numpy()
        order = np.argsort(anchor, kind="stable")
        out: list[tuple] = []
        pieces, n = group.column("piece"), group.column("n").to_numpy()
        keys = [group.column(c).to_numpy() for c in ("key1", "key2", "first")]
        for rows in np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1):
            texts = [pieces[int(r)].as_py().split(b" ") for r in rows]
            automaton = None
            if len(rows) > 1 or (n[rows[0]] == 1 and len(texts[0]) > window):
                automaton = Automaton()
                for r, words in zip(rows, texts, strict=True):
                    automaton.add(words, int(n[r]))
                automaton.finish()
            for r, words in zip(rows, texts, strict=True):
                if n[r] > 1:
                    runs = [(0, len(words) - window)]
                else:
                    runs = _runs(automaton.repeated(words, window)) if automaton else []
                k1, k2, first = (int(k[r]) for k in keys)
                out += [(k1, k2, first + a, first + b) for a, b in runs]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key1", "key2", "a", "b"])

    repeated = shards.groupBy("shard").applyInArrow(streamed, "key1 bigint, key2 bigint, a int, b int")
    repeated = saved(repeated, "repeated-windows")
    spans = places.select("key1", "key2", "row", "start").join(repeated, ["key1", "key2"])
    spans = spans.select("row", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("s"))
    return spans.groupBy("row").agg(F.collect_list("s").alias("spans"))


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        change[s["a"]] += 1
        change[s["b"] + window] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, str, str]:
    """The documents with a row number and the spans that repeat, and the names of these two columns."""
    row, spans = free_name(docs, "row_"), free_name(docs, "spans_")
    table = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "documents-by-row")
    found = repeated_spans(table.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text")), window, gram)
    found = found.select(F.col("row").alias(row), F.col("spans").alias(spans))
    return table.join(found, row, "left"), row, spans


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: its words, those removed, and the hash of those kept, joined by spaces.

    A null or empty text has no words and keeps none (the hash of nothing). Rows that repeat are texts of their own, so
    their long sequences go from both. Very long texts are read whole, and their windows count within them too. No rows:
    none. Further columns, whatever their names, are left out."""
    table, _, spans = _with_spans(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), window, gram)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            sizes, gone, kept = [], [], []
            for text, found in zip(raw(part.column("text")), part.column(spans).to_pylist(), strict=True):
                words = text.split()
                out = covered(len(words), found, window)
                sizes.append(len(words))
                gone.append(int(out.sum()))
                left = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if gone[-1] else words
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return table.select("doc_id", "text", spans).mapInArrow(
        digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def without_spans(text: bytes, spans: list[dict], window: int) -> bytes:
    """The text without the words covered, and without the white space after each."""
    places = [m.span() for m in WORDS.finditer(text)]
    out = covered(len(places), spans, window)
    ends = [a for a, _ in places[1:]] + [len(text)]
    lead = text[: places[0][0]] if places else text
    return lead + b"".join(text[a:e] for (a, _), e, x in zip(places, ends, out.tolist(), strict=True) if not x)


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All documents with the repeated spans taken out of their texts; n_chars, where there is one, follows. Texts without
    such spans, null ones too, stay as they are; rows that repeat lose their spans both. All columns stay, whatever their
    names. No rows: none."""
    table, row, spans = _with_spans(docs, window, gram)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            texts = [
                t if s is None or t is None else without_spans(t.encode(), s, window).decode()
                for t, s in zip(part.column("text").to_pylist(), part.column(spans).to_pylist(), strict=True)
            ]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field("text"), pa.array(texts, part.schema.field("text").type))

    changed = table.where(F.col(spans).isNotNull()).mapInArrow(rewrite, table.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return table.where(F.col(spans).isNull()).select(*columns).unionAll(changed.select(*columns))
