import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alphaloom.llm import packing, tokens
from alphaloom.llm.queries import BYTE_BPE, op2_best_fit_packing, op4_token_counts
from alphaloom.llm.tokens import Encoder, byte_alphabet, load_vocabulary, prove_whole_tokens, token_counts
from tests.llm.common import awkward, empty, texts_of

TRICKY = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "it's they'RE we'll 'S", "x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> <|endoftext|>", "<|endoftext", "日本語 テキスト",
    "zażółć gęślą", "naïve café", "é é", "  a b", " x 　 y", "tab\tsep \t x", "1234567 89.5", "!!! ??", "a" * 3000, " \r\n ", "🙂🙃 👩‍👩‍👧 x", "\x00\x01 \x7f", "end ​ z", "﻿bom", "it 's 'll", "ab  ", "a b", "x ' s", "\x1c y \x1d",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_encoder_equals_library(library):
    encoder = Encoder(load_vocabulary(BYTE_BPE))
    rng = np.random.default_rng(1)
    mixed = ["".join(TRICKY[i] for i in rng.integers(0, len(TRICKY), 6)) for _ in range(300)]
    for text in TRICKY + mixed:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_encoded_together_equal_library(library, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 60_000)
    encoder = Encoder(load_vocabulary(BYTE_BPE))
    rng = np.random.default_rng(2)
    atoms = [*TRICKY, "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'r", "''", "s", "re", "word", "Straße", "\n", "\r\n", "\t", "23", "٣", ".,", "_", "\x7f", "\x85", "\u00a0", "”", "’", "‐", "‧", "…", "\u2028", "\u200b", "ℓ", "⅓"]
    texts = ["".join(atoms[i] for i in rng.integers(0, len(atoms), rng.integers(0, 8))) for _ in range(3000)]
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(pa.array(["left out", *texts], kind).slice(1))]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.recent) <= 60_000 and len(encoder.older) <= 60_000
    assert list(encoder.encode_all(pa.array([], kind))) == [] and list(encoder.encode_all(pa.array(["", ""], kind))) == [b"", b""]


def test_a_word_is_merged_once_whatever_stands_beside_it(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 60_000)
    encoder = Encoder(load_vocabulary(BYTE_BPE))
    merged, ids = [], encoder.merger.ids
    encoder.merger.ids = lambda piece: merged.append(piece) or ids(piece)
    texts = ["ok " + word + mark for word in ("zzyxqwv", "qqkxzéw") for mark in ("", ",", ".\nThe", "***", ";\nof", "\n")]
    assert list(encoder.encode_all(pa.array(texts))) and sorted(merged) == [" qqkxzéw", " zzyxqwv"]
    list(encoder.encode_all(pa.array([" ".join(f"zz{i}" for i in range(5)) + " " + " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}zx" for i in range(15_000))])))
    assert encoder.older and len(encoder.recent) <= 60_000
    merged.clear()
    list(encoder.encode_all(pa.array(texts)))  # what the older half holds is not merged again
    assert not merged


def test_only_texts_that_bytes_do_not_tell_are_encoded_one_by_one(library, monkeypatch):
    encoder = Encoder(load_vocabulary(BYTE_BPE))
    alone, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda text: alone.append(text) or encode(text))
    merged, ids = [], encoder.merger.ids
    monkeypatch.setattr(encoder.merger, "ids", lambda piece: merged.append(piece) or ids(piece))
    texts = ["“Don’t” – it's …", "a\u00a0b", "x\x01y", "Straße, 日本。", "<|endoftext|>", "it’s\r\n\r\n•  1", "zzyxqwv ½ zzyxqwv"]
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(pa.array(texts))]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert alone == [texts[i] for i in (1, 2, 3, 4, 6)] and merged.count(" zzyxqwv") == 1


def test_only_what_the_merges_reach_is_proven():
    ids = {c: i for i, c in enumerate(byte_alphabet())}
    for entry in ("ab", "cd", "abcd", "bc", "xyz", "yz", "xy"):
        ids[entry] = len(ids)
    # No merge makes abcd. The first merge of xyz is xy, after which xy + z is no merge: it ends at two tokens.
    proven = prove_whole_tokens(ids, [("a", "b"), ("c", "d"), ("b", "c"), ("x", "y"), ("y", "z"), ("x", "yz")])
    assert {"ab", "cd", "bc", "xy", "yz", "a"} <= set(proven) and not {"abcd", "xyz"} & set(proven)
    assert {"abcd": ids["abcd"]}.items() <= prove_whole_tokens(ids, [("a", "b"), ("c", "d"), ("ab", "cd")]).items()
    with pytest.raises(ValueError, match="lacks 1 bytes"):
        prove_whole_tokens({c: i for c, i in ids.items() if c != "a"}, [])


def test_counts_equal_library(spark, small, library):
    docs = texts_of(f"{small}/documents.parquet")
    found = op4_token_counts(spark, small).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tuple(found.loc[doc_id, ["n_bytes", "n_tokens", "over_limit"]]) == (len(text.encode()), n, n > 1024)


def test_counts_of_awkward_rows(spark):
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts(awkward(spark), BYTE_BPE).collect()}
    assert got[1, 0] == got[2, 0] == 0 and got[6, 300_000] > 50_000
    assert token_counts(awkward(spark), BYTE_BPE).count() == 10
    assert token_counts(empty(spark), BYTE_BPE).count() == 0


def _whole(packed, max_len):
    """Pieces make up their documents and sequences without gaps; returns the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_doc.values():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(pieces)):
            assert (piece, start) == (i, at) and 0 < length <= max_len and (i == 0 or length == max_len)
            at += length
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark, small, library):
    packed = op2_best_fit_packing(spark, small).collect()
    used = _whole(packed, 1024)
    docs = texts_of(f"{small}/documents.parquet")
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in zip(docs.doc_id, docs.text.fillna(""), strict=True)}
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in packed) == total
    assert used <= -(-total // 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.integers(8, 65))
    histogram = np.concatenate([[0], rng.integers(0, 50, most) * (rng.random(most) < 0.7)])
    plan = packing.plan_packing(histogram, most)
    left = histogram.copy()
    for pattern, n in plan.items():
        assert sum(pattern) <= most and n > 0
        for length in pattern:
            left[length] -= n
    assert not left.any()
    volume = int((np.arange(most + 1) * histogram).sum())
    assert sum(plan.values()) <= 1.25 * -(-volume // most) + 2


def test_packing_of_awkward_rows(spark):
    docs = awkward(spark).where("doc_id is null or doc_id <> 4")
    packed = packing.pack(docs, BYTE_BPE, 2)
    got = packed.collect()
    _whole([r for r in got], 1024)
    assert {r.doc_id: r.length for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    assert all(len(r.ids) == 4 * r.length for r in got)
    twice = packing.pack(awkward(spark).where("doc_id = 4"), BYTE_BPE, 2, keep_ids=False).select("sequence_id", "offset").distinct().count()
    assert twice == 2
    assert packing.pack(empty(spark), BYTE_BPE, 2).agg(F.count("*")).first()[0] == 0
