"""Exact byte-pair encoding in linear time by backtracking, and decoding by an offset table.

Token numbers follow the order of merges. A sequence of tokens is the encoding of its bytes exactly if each
two neighbours are compatible: merging from the bytes of both gives these two again. The encoder takes the
longest token at a place (all tokens at all places come from one Aho-Corasick pass), and where that is not
compatible with the token before it, shorter ones, and then goes back a token.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .rows import portions
from .storage import id_and_text
from .tokens import Pieces, byte_letters

#: Fixed pattern of the byte-level tokenizers' pre-tokenizer.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Compatible or incompatible pairs remembered in a Python worker, at most.
PAIRS = 1_000_000

ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in word)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            self.parts.setdefault(whole, (vocab[a], vocab[b]))
        by_bytes = {x: i for i, x in enumerate(self.token) if x}
        # For a token, the longest other token that it starts with; -1: none.
        self.shorter = [
            next((by_bytes[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in by_bytes), -1) for x in self.token
        ]
        self.automaton = ahocorasick.Automaton()
        for x, i in by_bytes.items():
            self.automaton.add_word(x.decode("latin-1"), (i, len(x)))
        self.automaton.make_automaton()
        self.lengths = np.array([len(x) for x in self.token], dtype=np.int64)
        for text, i in self.special.items():
            self.token[i] = text.encode()
            self.lengths[i] = len(self.token[i])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as just a, b."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges on both sides of the border, latest first. A merge across the border that would have come
        # before the last one undone shows that a, b is not what merging gives.
        undone = len(self.token)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < undone:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                undone, a = a, left[1]
            else:  # of two merges of the same kind the left one comes first
                undone, b = b + 1, right[0]

    def encode_bytes(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [0] * n
        size = [0] * n
        for end, (token, length) in self.automaton.iter(word.decode("latin-1")):
            if length > size[start := end - length + 1]:
                longest[start], size[start] = token, length
        out: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)  # places from which the rest may still be encoded
        place, token, lengths, shorter = 0, longest[0] if n else -1, self.token, self.shorter
        while place < n:
            last = out[-1] if out else -1
            while token >= 0:
                after = place + len(lengths[token])
                if open_at[after] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place = after
                if place < n:
                    token = longest[place]
            else:  # nothing goes on from here
                open_at[place] = 0
                token = out.pop()
                place -= len(lengths[token])
                token = shorter[token]
        return out

    def encode_strings(self, strings: list[str]) -> list[list[int]]:
        return [[i for w in PRETOKENS.findall(s) for i in self.encode_bytes(w.encode())] for s in strings]

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens in it become these tokens."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            out += [self.special[part]] if k % 2 else self.encode_strings([part])[0]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, gathered from the table by the offsets of the tokens."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.table[where].tobytes()


_made: dict[str, tuple[Codec, Pieces]] = {}


def codec(path: str) -> tuple[Codec, Pieces]:
    """One per Python worker and tokenizer file."""
    if path not in _made:
        own = Codec(path)
        _made[path] = own, Pieces(own.encode_strings, own.encode_whole)
    return _made[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids in decimal with commas between, and of the text decoded from
    them. A null text is empty: no ids, and the hash of nothing. Rows are independent of each other; repeated ones
    stay. Very long texts are encoded whole. No rows: none. Further columns, whatever their names, are left out. No
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = codec(tokenizer)
        for part in portions(batches):
            counts, of_ids, of_text = [], [], []
            for data in pieces.ids(part.column("text").to_pylist()):
                ids = np.frombuffer(data, dtype="<u4")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text = own.decode(ids).decode("utf-8", errors="replace")
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, ENCODED)
