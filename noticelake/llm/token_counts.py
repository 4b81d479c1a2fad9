"""Token counts with a whole-token shortcut, for a BPE vocabulary of lower-case words with word ends.

Offline, once per vocabulary, every string of the vocabulary is encoded alone. Those that come back as
one token and one pre-token are proven: a pre-token equal to one of them is one token wherever it stands, since
pre-tokens are merged apart from each other. In the tasks, pre-tokens of ASCII words are cut from the
bytes in numpy passes and looked up among the proven strings; what is left is merged in rounds, each
distinct string once a slice. Stretches between blanks that hold other characters or a special token's string go
to the library whole, so that its normaliser decides; no token and no normalisation crosses a blank.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.files import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm.common import mix, prepare, release, slices, utf8, words

MODEL = public_tokenizers.path("word_bpe_49k.json")

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(128, _OTHER, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[*range(0x30, 0x3A)]] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Letters after a lone apostrophe that it takes along, by how many they are. Fixed values of the vocabulary's pattern.
_TAKES = {1: (b"s", b"t", b"m", b"d"), 2: (b"re", b"ve", b"ll")}
#: Parts strings that are encoded together: a pre-token of its own between blanks.
_PART = "\x01"
#: Bytes of a pre-token up to which it is merged in rounds together with others.
_BRIEF = 48


@lru_cache(maxsize=2)
def _library(file: str) -> Tokenizer:
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


def prove(file: str = MODEL) -> pa.Array:
    """The vocabulary's strings that are one token when they are encoded alone, without those of special tokens.

    A string that the normaliser changes, or that falls into several pre-tokens, is not among them.
    """
    t = _library(file)
    special = _special(file)
    suffix = t.model.end_of_word_suffix or ""
    alphabet = {c: b for b, c in _byte_letters().items()}
    found = []
    for token, number in t.get_vocab().items():
        if token in special or not token.endswith(suffix):
            continue
        raw = token.removesuffix(suffix)
        if not raw or any(c not in alphabet for c in raw):
            continue
        try:
            string = bytes(alphabet[c] for c in raw).decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
        if t.normalizer.normalize_str(string) == string and len(t.pre_tokenizer.pre_tokenize_str(string)) == 1:
            found.append((string, number))
    alone = t.encode_batch_fast([s for s, _ in found], add_special_tokens=False)
    return pa.array(sorted(s.encode() for (s, number), e in zip(found, alone, strict=True) if e.ids == [number]), pa.large_binary())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _special(file: str) -> tuple[str, ...]:
    return tuple(x.content for x in _library(file).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _proven(file: str) -> pa.Array:
    return prove(file)


def _packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes of some stretches, which may leave gaps but do not overlap."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] = 1
    mark[start + length] -= 1
    raw = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(length)))), pa.py_buffer(raw)])


class _Merges:
    """The merges of a vocabulary, to be looked up for whole arrays of pairs at once."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        number, suffix, letter = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([number[letter[b]] for b in range(256)])
        self.last = np.array([number[letter[b] + suffix] for b in range(256)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank = {(number[x], number[y]): (r, number[x + y]) for r, (x, y) in reversed(list(enumerate(pairs)))}
        key = np.array([x << 32 | y for x, y in rank], np.uint64)
        self.none = len(pairs)
        self.bits = np.uint64(64 - 18)
        self.key, self.rank, self.token = np.full(1 << 18, 2**64 - 1, np.uint64), np.full(1 << 18, self.none), np.zeros(1 << 18, np.int64)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        values = np.array(list(rank.values()))
        while len(left):  # each free slot takes one of the keys that ask for it, the others move on by one
            free = self.key[slot[left]] == 2**64 - 1
            _, one = np.unique(slot[left[free]], return_index=True)
            taken = left[free][one]
            self.key[slot[taken]], self.rank[slot[taken]], self.token[slot[taken]] = key[taken], values[taken, 0], values[taken, 1]
            left = np.setdiff1d(left, taken)
            slot[left] = (slot[left] + 1) % (1 << 18)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> self.bits).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The slot of every pair; that of a pair without a merge has the rank ``none``."""
        key = x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)
        slot = self._slot(key)
        open_ = np.flatnonzero(self.key[slot] != key)
        for _ in range(self.probes):
            open_ = open_[self.key[slot[open_]] != 2**64 - 1]
            slot[open_] = (slot[open_] + 1) % (1 << 18)
            open_ = open_[self.key[slot[open_]] != key[open_]]
        return slot

    def count(self, data: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of tokens of every string: round after round, the first pair of the least rank in each one merges."""
        size = np.diff(stops)
        out, token, ends = size.copy(), self.inner[data], stops[1:] - 1
        token[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(size)), size)
        while len(token):
            pair = np.flatnonzero(word[1:] == word[:-1])
            slot = self.find(token[pair], token[pair + 1])
            rank, of = self.rank[slot], word[pair]
            if not len(pair):
                break
            head = np.flatnonzero(np.diff(of, prepend=-1))
            least = np.minimum.reduceat(rank, head)
            hit = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(head, len(of)))))
            hit = hit[(rank[hit] < self.none) & (np.diff(of[hit], prepend=-1) != 0)]
            token[pair[hit]] = self.token[slot[hit]]
            out[of[hit]] -= 1
            alive = np.zeros(len(size), bool)  # strings in which nothing merged are done
            alive[of[hit]] = True
            keep = alive[word]
            keep[pair[hit] + 1] = False
            token, word = token[keep], word[keep]
        return out


@lru_cache(maxsize=2)
def _merges(file: str) -> _Merges:
    return _Merges(file)


def _merged(strings: pa.Array, file: str) -> np.ndarray:
    """The token count of every pre-token, each distinct one merged once."""
    coded = strings.dictionary_encode()
    each = coded.dictionary
    out = np.zeros(len(each), np.int64)
    brief = pc.less_equal(pc.binary_length(each), _BRIEF).to_numpy(zero_copy_only=False)
    if brief.any():
        out[brief] = _merges(file).count(*_buffers(each.filter(pa.array(brief))))
    if not brief.all():  # a queue of pairs suits long ones better than rounds
        out[~brief] = _encoded(each.filter(pa.array(~brief)), file)
    return out[coded.indices.to_numpy(zero_copy_only=False)]


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    stops = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[stops[0] : stops[-1]], stops - stops[0]


def _encoded(strings: pa.Array, file: str) -> np.ndarray:
    """The token count of every string by the library, each distinct one once.

    All go as one text, parted by a control character that stands alone; those that hold it, or a special token's string, go alone.
    """
    coded, t = strings.dictionary_encode(), _library(file)
    each = [x.decode() for x in coded.dictionary.to_pylist()]
    alone = np.array([_PART in s or any(x in s for x in _special(file)) for s in each], bool)
    ids = np.array(t.encode("".join(f"{s} {_PART} " for s, x in zip(each, alone.tolist(), strict=True) if not x), add_special_tokens=False).ids)
    out = np.zeros(len(each), np.int64)
    out[~alone] = np.diff(np.flatnonzero(ids == t.encode(_PART, add_special_tokens=False).ids[0]), prepend=-1) - 1
    out[alone] = [len(t.encode(s, add_special_tokens=False).ids) for s, x in zip(each, alone.tolist(), strict=True) if x]
    return out[coded.indices.to_numpy(zero_copy_only=False)]


def _pretokens(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every pre-token of ASCII bytes; ``begins`` are the first bytes of words, ``data`` has no blanks."""
    n = len(data)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[begins] = True
    start = np.flatnonzero(edge[:-1])
    stop = np.append(start[1:], n)
    # a lone apostrophe before letters takes some of them along
    apart = np.zeros(n + 1, bool)
    apart[begins] = True
    lone = start[(data[start] == 0x27) & (stop - start == 1) & (stop < n)]
    lone = lone[(kind[lone + 1] == _LETTER) & ~apart[lone + 1]]
    for size, tails in _TAKES.items():
        fits = lone[lone + size < n]
        if size == 2:
            fits = fits[(kind[fits + 2] == _LETTER) & ~apart[fits + 2]]
        hit = np.zeros(len(fits), bool)
        for tail in tails:
            hit |= np.logical_and.reduce([data[fits + 1 + j] == c for j, c in enumerate(tail)])
        fits = fits[hit]
        edge[fits + 1] = False
        edge[fits + 1 + size] = True
    start = np.flatnonzero(edge[:-1])
    return start, np.append(start[1:], n) - start


def _shortcut(strings: pa.Array, rest, file: str) -> np.ndarray:
    """One for every proven string, and what ``rest`` says of the others."""
    out = np.ones(len(strings), np.int64)
    left = ~pc.is_in(strings, value_set=_proven(file)).to_numpy(zero_copy_only=False)
    if left.any():
        out[left] = rest(strings.filter(pa.array(left)), file)
    return out


def counts(texts: pa.Array, file: str = MODEL) -> np.ndarray:
    """The number of tokens of every text; null counts as empty."""
    data, offsets = utf8(texts)
    s, e, first = words(data, offsets)
    total = np.zeros(len(s), np.int64)
    # words with other characters, and those in which a special token's string may stand, are left to the library
    odd = np.concatenate(([0], np.cumsum(data > 0x7F)))
    pipe = np.concatenate(([0], np.cumsum((data[:-1] == 0x3C) & (data[1:] == 0x7C)))) if len(data) else np.zeros(1, np.int64)
    whole = (odd[e] > odd[s]) | (pipe[np.maximum(e - 1, s)] > pipe[s])
    if whole.any():
        total[whole] = _shortcut(_packed(data, s[whole], (e - s)[whole]), _encoded, file)
    plain = np.flatnonzero(~whole)
    if len(plain):
        length = (e - s)[plain]
        raw = _LOWER[np.frombuffer(_packed(data, s[plain], length).buffers()[2], np.uint8)]
        begins = np.concatenate(([0], np.cumsum(length)[:-1]))
        start, size = _pretokens(raw, begins)
        total[plain] = np.add.reduceat(_shortcut(_packed(raw, start, size), _merged, file), np.searchsorted(start, begins))
    return np.diff(np.concatenate(([0], np.cumsum(total)))[first])


def _local(file: str) -> str:
    sent = SparkFiles.get(os.path.basename(file))
    return sent if os.path.exists(sent) else file


def with_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", model: str = MODEL) -> DataFrame:
    """Adds the number of tokens of every text, without added special tokens; their strings in a text count as the library has it.

    Null and empty texts have none. Repeated rows and all other columns stay; one named ``out`` is replaced. ``model`` is
    a file of a BPE vocabulary with lower-case pre-tokens and word ends; every other kind is refused.
    """
    prepare(docs.sparkSession)
    t = _library(model)
    if not getattr(t.model, "end_of_word_suffix", None) or t.normalizer is None or t.normalizer.normalize_str("A  b") != "a b":
        raise ValueError(f"not a vocabulary of lower-case words with word ends: {model}")
    docs.sparkSession.sparkContext.addFile(model)  # workers may have no such file of their own

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        file, parts = _local(model), []
        for a, b in slices(texts, 4 << 20, 4096):
            parts.append(counts(texts.slice(a, b - a), file))
            release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return docs.withColumn(out, n_tokens(F.col(f"`{text}`").cast("string")))
