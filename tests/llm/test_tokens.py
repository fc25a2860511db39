"""Token operators against the tokenizers library itself."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bazaarlens.llm import backtracking_bpe, blocks_of_ids, packing
from bazaarlens.llm.queries import tokenizer
from bazaarlens.llm.tokens import library_pieces

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "  two  spaces ", "tail \n ", "three   spaces", "a\n \nb", "don't we'll I'M", "x<|endoftext|>y",
    "ÀÉ ǆ İstanbul, Straße. ΣΑΣ", "数字 123 ٣٤٥", "é ́x", "🙂🙂 ‍", "\x1c a\x85b\xa0c", "tab\there\r\n",
    "the the the, the. The THE", "Thandble, " * 700, "w" * 9000, "the the the, the. The THE",
]
SCHEMA = "doc_id bigint, text string, length string, part int, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], None, None, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def library(path):
    return lambda text: LIBRARY[path].encode(text or "", add_special_tokens=False).ids


STRANGE = st.text(st.sampled_from(" \n\tab's.,éİ1٣ <|endoftext|>́\x1c\xa0Σ!"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_pieces_are_the_library(text):
    for path, space in ((BYTES, " "), (WORDS, "")):
        own = np.frombuffer(library_pieces(path, space).ids([text])[0], dtype="<u4").tolist()
        assert own == library(path)(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(STRANGE, st.text(max_size=30)))
def test_backtracking_is_the_library(text):
    own, pieces = backtracking_bpe.codec(BYTES)
    ids = np.frombuffer(pieces.ids([text])[0], dtype="<u4")
    assert ids.tolist() == library(BYTES)(text)
    assert own.decode(ids).decode("utf-8", "replace") == LIBRARY[BYTES].decode(ids.tolist(), skip_special_tokens=False)


def test_backtracking_on_long_words():
    own, _ = backtracking_bpe.codec(BYTES)
    rng = np.random.default_rng(1)
    for alphabet in ("ab", "the ing", "aA", "\xe9\xe8"):
        for n in (1, 7, 300, 3000):
            word = "".join(rng.choice(list(alphabet.replace(" ", "")), n))
            assert own.encode_strings([word])[0] == library(BYTES)(word)


def test_encode_decode(spark, docs):
    got = Counter(map(tuple, backtracking_bpe.encode_decode(docs, BYTES).collect()))
    t, want = LIBRARY[BYTES], Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        want[r.doc_id, len(ids), *sha] += 1
    assert got == want
    assert backtracking_bpe.encode_decode(docs.limit(0), BYTES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 64))
def test_id_blocks_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint32)
    payload = blocks_of_ids.encode_ids(ids, 0.9, block)
    assert (blocks_of_ids.decode_ids(payload) == ids).all()
    assert (blocks_of_ids.decode_ids(payload, 1, 3) == ids[block : 3 * block]).all()


def test_id_blocks_are_small():
    ids = np.random.default_rng(0).integers(0, 500, 100_000).astype(np.uint32)
    ids[::50] = 4_000_000_000
    assert len(blocks_of_ids.encode_ids(ids, 0.9)) < 100_000 * 9 / 8 * 1.2


@pytest.mark.parametrize("segment", [5, 1 << 18])
def test_token_file(spark, docs, segment):
    dataset = blocks_of_ids.write_ids(docs, BYTES, 0, segment=segment)
    got = blocks_of_ids.read_ids(dataset).collect()
    ids = library(BYTES)
    want = Counter()
    for r in docs.collect():
        own = np.array([*ids(r.text), 0], dtype="<u4")
        want[r.doc_id, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert blocks_of_ids.read_ids(blocks_of_ids.write_ids(docs.limit(0), BYTES, 0)).count() == 0


def check_packing(rows, size):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        held.sort()
        end = 0
        for offset, length in held:
            assert offset == end and length > 0
            end += length
        assert end <= size
    assert sorted(at) == list(range(len(at)))
    return sum(r.length for r in rows) / size / max(1, len(at))


@pytest.mark.parametrize("size", [1, 16, 4096])
def test_packing(spark, docs, size):
    rows = packing.pack(docs, WORDS, 2, size).collect()
    check_packing(rows, size)
    ids, found = library(WORDS), defaultdict(list)
    for r in rows:
        found[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        own = np.array([*ids(r.text), 2], dtype="<u4")
        pieces = {(s, min(size, len(own) - s), zlib.crc32(own[s : s + size].tobytes())) for s in range(0, len(own), size)}
        assert pieces == set(found[r.doc_id, len(own)])
    assert len(rows) == sum(-(-(len(ids(r.text)) + 1) // size) for r in docs.collect())
    assert packing.pack(docs.limit(0), WORDS, 2, size).count() == 0


def test_little_padding_and_few_patterns():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 200_000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    found = packing.patterns(histogram, 4096)
    held = Counter()
    for n, pattern in found:
        assert n > 0 and sum(a * b for a, b in pattern) <= 4096
        for length, copies in pattern:
            held[length] += n * copies
    assert held == histogram
    assert len(found) <= 3 * 4096
    assert lengths.sum() / 4096 / sum(n for n, _ in found) > 0.99
