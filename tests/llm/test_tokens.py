"""Token files against the tokenizer itself, as exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import token_files
from plumbline.llm.repair import Shard, encode_shard
from plumbline.llm.token_files import PieceEncoder, token_index

FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)
ENCODER = PieceEncoder(FILE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'. \t\n\x0b\x1c\x85 　é語😀st")),
                        max_size=25), max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    got = ENCODER.encode(texts).tolist()
    want = [i for t in texts for i in [*PLAIN.encode(t, add_special_tokens=False).ids,
                                       ENCODER.terminals]]
    assert got == want


def test_special_names_and_forgetting(monkeypatch):
    monkeypatch.setattr(token_files, "_PIECES", 4)
    encoder = PieceEncoder(FILE)
    for text in ["one two three four five six", "a <|endoftext|> b", "one nine", "x\x00 y", ""] * 3:
        assert encoder.encode([text])[:-1].tolist() == PLAIN.encode(
            text, add_special_tokens=False).ids


def test_words_of_a_normalizing_tokenizer_go_through_it(tmp_path):
    """The short cut for words is taken only where the tokenizer changes no character before."""
    import json

    parts = json.loads(PLAIN.to_str()) | {"normalizer": {"type": "Lowercase"}}
    (tmp_path / "t.json").write_text(json.dumps(parts))
    encoder, plain = PieceEncoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert ENCODER.by_word and not encoder.by_word
    text = "Some WORDS, and More.\nLines"
    assert encoder.encode([text])[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_rules_are_stored_narrow():
    """Rules cost what symbols cost, so that a shard with few frequent pairs is no larger."""
    rng = np.random.default_rng(3)
    seq = np.append(rng.integers(0, 300, 60_000), 300).astype(np.int32)
    plain = encode_shard([1], seq, 300, 2, rounds=0)
    assert len(encode_shard([1], seq, 300, 2)) < len(plain)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.integers(2, 4))
def test_shard_round_trip(documents, least):
    seq = np.array([t for d in documents for t in [*d, 6]], np.int32)
    ids = [None if i == 1 else i for i in range(len(documents))]
    shard = Shard(encode_shard(ids, seq, 6, 2, rounds=6, most=3, least=least))
    want = np.where(seq == 6, 2, seq)
    assert shard.all_tokens().tolist() == want.tolist() and shard.ids == ids
    for i, d in enumerate(documents):
        whole = [*d, 2]
        assert shard.tokens(i).tolist() == whole
        assert shard.tokens(i, 3, 9).tolist() == whole[3:9]


def test_frequent_pairs_are_replaced():
    seq = np.array(([1, 2, 3, 4] * 50 + [9]) * 4, np.int32)
    shard = Shard(encode_shard([1, 2, 3, 4], seq, 9, 0))
    assert len(shard.symbols) < len(seq) / 8 and shard.rule_lengths.max() >= 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=80), max_size=8), st.integers(2, 6))
def test_no_frequent_pair_is_left(documents, least):
    seq = np.array([t for d in documents for t in [*d, 4]], np.int32)
    shard = Shard(encode_shard(list(range(len(documents))), seq, 4, 2, most=3, least=least))
    assert shard.all_tokens().tolist() == np.where(seq == 4, 2, seq).tolist()
    left, last, counts = shard.symbols.tolist(), None, {}
    for i, pair in enumerate(zip(left, left[1:])):
        if 4 in pair or last == (i - 1, pair):  # of a run every other one counts
            last = None
            continue
        counts[pair], last = counts.get(pair, 0) + 1, (i, pair)
    assert max(counts.values(), default=0) < least


def test_long_copies_become_single_symbols():
    passage = np.random.default_rng(1).integers(0, 1000, 1000)
    seq = np.append(np.tile(np.append(passage, 1000), 64), np.arange(5)).astype(np.int32)
    seq = np.append(seq, 1000).astype(np.int32)
    shard = Shard(encode_shard(list(range(65)), seq, 1000, 2))
    assert len(shard.symbols) <= 64 * 2 + 6 and shard.rule_lengths.max() == 1000
    assert shard.tokens(63).tolist() == [*passage.tolist(), 2]


@pytest.mark.parametrize("tokens", [3, 1 << 20])
def test_index(spark, monkeypatch, tokens):
    monkeypatch.setattr(token_files.write_token_files, "__kwdefaults__", {"shard_tokens": tokens})
    texts = ["b text", None, "", "same", "same", "é " * 5000, "z"]
    rows = [(i, t, 5) for i, t in zip([4, 7, 2, 9, 9, None, -3], texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [tuple(r) for r in token_index(docs, FILE, 2).orderBy("start").collect()]
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert got == want
    assert token_index(docs.limit(0), FILE, 2).count() == 0
