"""Token ids of whole texts, by a public tokenizer with a memory of the pieces between spaces.

A text is cut before each space and line feed; every piece has its own ids, so a piece that was seen
before is not encoded again. Where a cut could change the ids (inside longer runs of white space, in
strings of special tokens) the whole text goes through the library at once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Sequence

from tokenizers import Tokenizer

#: Byte-level tokenizers take a run of white space but for its last character as one: a cut inside such a run.
UNSAFE = re.compile(r"\s[ \n](?:\s|\Z)")
#: What unsafe texts have; found fast, as each begins with a fixed character.
MAYBE_UNSAFE = re.compile(r" (?:\s|\Z)"), re.compile(r"\n(?:\s|\Z)")
#: A word of letters that have one-letter lower cases, with a comma or stop after it: two pieces for both tokenizers.
WORD_AND_MARK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]\Z")
#: A word that is one piece for both tokenizers, perhaps after a space.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Pieces remembered in a Python worker, at most; then the memory starts anew.
REMEMBERED = 1_000_000
LATIN = re.compile(r"[\x00-\xff]*\Z").match


def _packed(ids: Sequence[int]) -> bytes:
    return array("I", ids).tobytes()


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable letter: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """Ids, as little-endian unsigned 32-bit numbers, of texts. `encode` gives the ids of each of a list of strings.

    space: what stands before a piece that was cut at a space; "" for tokenizers that drop all white space."""

    def __init__(
        self,
        encode: Callable[[list[str]], list[Sequence[int]]],
        whole: Callable[[str], Sequence[int]],
        space: str = " ",
        remembered: int = REMEMBERED,
    ):
        self.encode, self.whole, self.space, self.remembered = encode, whole, space, remembered
        self.known: dict[str, bytes] = {}
        self.marks = {m: _packed(x) for m, x in zip(",.", encode([",", "."]), strict=True)}

    def _learn(self, parts: set[str]) -> None:
        known = self.known
        marked = [p for p in parts if WORD_AND_MARK.match(p)]
        words = {p[:-1] for p in marked}.union(parts.difference(marked))
        words = [p for p in words if p not in known]
        for p, ids in zip(words, self.encode([p if p[:1] == "\n" else self.space + p for p in words]), strict=True):
            known[p] = _packed(ids)
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[p[-1]]

    def _parts(self, text: str) -> list[str] | None:
        if "<|" in text:
            return None
        if not self.space:
            if LATIN(text):  # these letters have their lower cases one by one, as the tokenizer does
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        if any(p.search(text) for p in MAYBE_UNSAFE) and UNSAFE.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known.clear()
        find, heads, new, cut = self.known.get, [], set(), []
        for text in texts:
            parts = self._parts(text)
            if parts is None:
                cut.append(None)
                continue
            heads.append(parts.pop(0))
            found = list(map(find, parts))
            gaps, at = [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                gaps.append((at, parts[at]))
            new.update(p for _, p in gaps)
            cut.append((found, gaps))
        if new:
            self._learn(new)
        first, out = iter(self.encode(heads)), []
        for text, held in zip(texts, cut, strict=True):
            if held is None:
                out.append(_packed(self.whole(text)))
                continue
            found, gaps = held
            for at, part in gaps:
                found[at] = self.known[part]
            out.append(_packed(next(first)) + b"".join(found))
        return out


_made: dict[tuple, Pieces] = {}


def library_pieces(path: str, space: str = " ") -> Pieces:
    """By the tokenizers library; one per Python worker and file. space: what a piece has before it ("" where
    the tokenizer drops white space)."""
    if (path, space) not in _made:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        model = tokenizer.model
        letters = {b: c for c, b in byte_letters().items()}

        def encode(strings: list[str]) -> list[Sequence[int]]:
            # Single words need just the model; everything else the whole tokenizer.
            out: list[Sequence[int] | None] = []
            for x in strings:
                if WORD.fullmatch(x):
                    x = x if space else x.lower()
                    x = (x.encode().decode("latin-1")).translate(letters)
                    out.append([t.id for t in model.tokenize(x)])
                else:
                    out.append(None)
            others = [x for x, ids in zip(strings, out, strict=True) if ids is None]
            rest = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False))
            return [next(rest).ids if ids is None else ids for ids in out]

        _made[path, space] = Pieces(encode, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, space)
    return _made[path, space]
