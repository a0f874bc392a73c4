"""Token counts by the whole-token shortcut.

Offline (once, on the driver) every vocabulary string is shown to encode alone
as one token: it must be valid text, form a single pre-token, and replaying the
file's merge list on its bytes must end at its own id. A text's pre-tokens in
that proven set count one token each; only the others are merged, by the same
list, and what they merge to is remembered in bounded memory.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from alphaloom.llm._spark import text_column

#: Fixed value: the byte-level pre-token pattern of this vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 400_000
#: Bytes of text whose pre-tokens are looked up together.
CHUNK_BYTES = 8 << 20
MAX_TOKENS = 1024
_IRREGULAR = None
#: Marks that are a pre-token of their own after a run of letters.
_POINTS = frozenset(".,;:!?)")
#: Kinds of a text's bytes. Bytes of characters beyond ASCII count as letters until the pre-token is read.
_SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(6)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[33:127], _KINDS[128:] = _MARK, _LETTER
for _kind, _members in ((_SPACE, b" "), (_WHITE, b"\t\n\v\f\r"), (_DIGIT, b"0123456789"), (_LETTER, bytes([*range(65, 91), *range(97, 123)]))):
    _KINDS[list(_members)] = _kind
#: Marks only: those of ASCII, and dashes, quotes, dots and bullets from U+2010 to U+2027 (bytes E2 80 90 to E2 80 A7).
_MARKS = re.compile(r"[!-/:-@\[-`{-~\u2010-\u2027]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: ids by string of the byte alphabet, merges in order, special tokens, the file's digest, and the strings proven to be whole tokens."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    digest: str
    whole: dict[str, int]


class Merger:
    """Ids of a pre-token by the merge list alone: a piece that is in the vocabulary is merged like any other."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> None:
        alphabet = byte_alphabet()
        if missing := set(alphabet) - set(ids):
            raise ValueError(f"the vocabulary lacks {len(missing)} bytes")
        self.model = BPE(vocab=ids, merges=merges)
        self.letters = "".join(sorted(alphabet, key=alphabet.__getitem__))

    def ids(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            spelt = piece.replace(" ", self.letters[32])
        else:
            spelt = codecs.charmap_decode(piece.encode("utf-8"), "strict", self.letters)[0]
        return [t.id for t in self.model.tokenize(spelt)]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file and prove its whole tokens; a file is read again only if it has changed."""
    state = os.stat(path)
    return _loaded(path, state.st_size, state.st_mtime_ns)


@lru_cache(maxsize=2)
def _loaded(path: str, size: int, changed: int) -> Vocabulary:
    with open(path, "rb") as file:
        raw = file.read()
    spec = json.loads(raw)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
    merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in spec["model"]["merges"]]
    return Vocabulary(ids, merges, special, hashlib.sha256(raw).hexdigest(), prove_whole_tokens(ids, merges))


def prove_whole_tokens(ids: dict[str, int], merges: list[tuple[str, str]]) -> dict[str, int]:
    """Vocabulary strings that are text, one pre-token, and merge to exactly their own id.

    An entry that the merges cannot reach, or whose merges end elsewhere, is not among them.
    """
    pattern, merger, alphabet, proven = regex.compile(PRE_TOKEN), Merger(ids, merges), byte_alphabet(), {}
    for entry, i in ids.items():
        try:
            text = bytes(alphabet[c] for c in entry).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        if pattern.findall(text) == [text] and merger.ids(text) == [i]:
            proven[text] = i
    return proven


def split_pre_tokens(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin that stand one after another in ``data`` (UTF-8), from ``starts`` on.

    This is ``PRE_TOKEN`` by the kinds of neighbouring bytes. It holds for texts
    without control characters whose characters beyond ASCII are letters or
    among ``_MARKS``.
    """
    n = len(data)
    kinds = _KINDS[data]
    marks = np.flatnonzero(data == 0xE2)
    marks = marks[(data[marks + 1] == 0x80) & (data[marks + 2] >= 0x90) & (data[marks + 2] <= 0xA7)]
    kinds[marks[:, None] + np.arange(3)] = _MARK
    white = kinds <= _WHITE
    first = np.zeros(n + 2, bool)
    first[starts] = first[n:] = True
    begins = first[:n].copy()
    before_other = ~white[1:] & ~first[1:n]  # the last of a run of white space, which goes with what follows or stands alone
    edges = np.where(white[1:], ~white[:-1] | np.append(before_other[1:], False), (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE))
    begins[1:] |= edges
    at = np.flatnonzero(begins & (data == ord("'")))
    padded = np.append(data, np.zeros(2, np.uint8))
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~first[at + 1]
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~first[at + 1] & ~first[at + 2]
    begins[at[short | long] + 1] = False
    ends = np.concatenate([at[short] + 2, at[long] + 3])
    begins[ends[ends < n]] = True
    return np.flatnonzero(begins)


def told_by_kinds(word: str) -> bool:
    """Whether a text that has this between two begins of ``split_pre_tokens`` is split there as ``PRE_TOKEN`` has it."""
    if word.isascii():
        return _KINDS[ord(word[-1])] != _ODD
    word = word.removeprefix(" ")
    return word.isalpha() or _MARKS.fullmatch(word) is not None


class Encoder(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit integers in a byte string.

    Between two single spaces a text's pre-tokens do not depend on what
    surrounds them, so this dict remembers the ids of each such stretch (with its
    leading space). A stretch that starts or ends in white space could join a
    longer run; a text that holds one is split by the full pattern instead.

    ``encode_all`` splits many texts at once and looks each distinct pre-token up
    once; only texts with special strings, control characters or characters
    beyond ASCII that are neither letters nor common marks go through ``encode``.
    Of the pre-tokens it remembers, those not asked for lately are forgotten.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.merger = Merger(vocabulary.ids, vocabulary.merges)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.whole = {word.encode(): i.to_bytes(4, "little") for word, i in vocabulary.whole.items() if told_by_kinds(word)}
        self.recent, self.older = dict(self.whole), {}

    def _merged(self, word: str) -> bytes:
        ids = self.merger.ids(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pre_token(self, word: str) -> bytes:
        i = self.vocabulary.whole.get(word)
        return self._merged(word) if i is None else i.to_bytes(4, "little")

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self._pre_token, self.pattern.findall(text)))

    def __missing__(self, stretch: str) -> bytes | None:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            found = _IRREGULAR
        elif stretch.isalpha():  # one pre-token, as the pattern has it
            found = self._pre_token(" " + stretch)
        elif stretch[-1] in _POINTS and stretch[:-1].isalpha():
            found = self._pre_token(" " + stretch[:-1]) + self._pre_token(stretch[-1])
        else:
            found = self._by_pattern(" " + stretch)
        if len(stretch) <= 100:
            self[stretch] = found
        return found

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._by_pattern(text)
        parts = [self[x] for x in rest]
        if _IRREGULAR in parts:
            return self._by_pattern(text)
        return self._by_pattern(first) + b"".join(parts)

    def encode(self, text: str) -> bytes:
        if self.special is not None and any(s in text for s in self.vocabulary.special):
            pieces = self.special.split(text)
            return b"".join(self.vocabulary.special[p].to_bytes(4, "little") if i % 2 else self._ordinary(p) for i, p in enumerate(pieces) if p)
        return self._ordinary(text)

    def _new(self, key: bytes) -> bytes:
        """Ids of a pre-token that is not among the recent ones."""
        found = self.older.get(key)
        if found is None:
            found = self._merged(key.decode())
        if len(self.recent) >= MEMO_ENTRIES:
            self.recent, self.older = dict(self.whole), self.recent
        if len(key) <= 100:
            self.recent[key] = found
        return found

    def _encode_chunk(self, texts: pa.Array) -> list[bytes]:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data, bounds = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        begins = split_pre_tokens(data, bounds[:-1])
        split = [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), split).dictionary_encode()
        keys = words.dictionary.to_pylist()
        known = list(map(self.recent.get, keys))
        lost = np.array([found is None and not told_by_kinds(k.decode()) for k, found in zip(keys, known, strict=True)])
        at, places = words.indices.to_numpy(), np.searchsorted(begins, bounds)
        single = np.zeros(len(texts), bool)
        single[np.searchsorted(places, np.flatnonzero(lost[at]), "right") - 1] = True
        for special in self.vocabulary.special:
            single |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        asked = np.zeros(len(keys), bool)
        asked[at[np.repeat(~single, np.diff(places))]] = True
        found = [b"" if not wanted else self._new(k) if ids is None else ids for k, ids, wanted in zip(keys, known, asked.tolist(), strict=True)]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        ends, packed = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        cuts = ends[places].tolist()
        return [self.encode(texts[i].as_py()) if alone else bytes(packed[cuts[i] : cuts[i + 1]]) for i, alone in enumerate(single.tolist())]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of every text of an array without nulls, in order."""
        chunk = pc.binary_length(texts).to_numpy().astype(np.int64).cumsum() // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield from self._encode_chunk(texts.slice(start, stop - start))


_ENCODER: list[Encoder] = []


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, with what it remembers from earlier tasks."""
    if not _ENCODER or _ENCODER[0].vocabulary.digest != vocabulary.digest:
        _ENCODER[:] = [Encoder(vocabulary)]
    return _ENCODER[0]


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null and empty texts have zero bytes and tokens; very long texts are counted
    whole; repeated rows are counted row by row; an empty table gives an empty
    result; other columns are ignored; ties cannot arise.
    A narrow map: no shuffle, one batch in memory at a time. The vocabulary that
    is broadcast has a fixed size.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            n = pa.array([len(ids) // 4 for ids in encoder.encode_all(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = text_column(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > max_tokens)
