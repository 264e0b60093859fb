"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent
pair's rank is found by binary search over the sorted pair keys, and each word
merges all places of its lowest-rank pair. Words without a known pair leave the
rounds.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, spread

#: Words whose ids a Python worker keeps before it starts anew.
WORDS_KEPT = 200_000
#: The word pattern of byte-level BPE (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encodes and decodes as the tokenizers library does with this vocabulary file.

    Special strings in a text become their ids, longest first at the leftmost
    place. Texts are whole; ids are uint32.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, to_byte = spec["model"]["vocab"], printable_bytes()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.cut = regex.compile(WORD_PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        token = [b""] * size
        for text, i in vocab.items():
            token[i] = bytes(to_byte[c] for c in text)
        for text, i in special.items():
            token[i] = text.encode()
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_size = np.array([len(t) for t in token], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.first = np.zeros(256, np.int64)
        for text, i in vocab.items():
            if len(text) == 1:
                self.first[to_byte[text]] = i
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # words met lately: a word's number, and where its ids lie in the flat store
        self.new, self.store, self.begin, self.size = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for a pair that does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], len(self.pair))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids."""
        none = len(self.pair)
        length = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), length)
        done_symbols, done_owner = [], []
        while len(symbols):
            # the last symbol of a word pairs with nothing
            rank = np.full(len(symbols), none, np.int64)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(head, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, head), count)
            open_ = least < none
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, rank, least = symbols[open_], owner[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # in a run of one repeated symbol, pairs overlap: from the left, every other one merges
            run = np.concatenate([[True], np.diff(at) != 1])
            since = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[since % 2 == 0]
            symbols[at] = self.into[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def numbers(self, cuts: list[list[str]]) -> list[np.ndarray]:
        """The number of each word in the store, after merging the words not in it."""
        seen = set().union(*cuts) if cuts else set()
        if len(self.new) > WORDS_KEPT:
            self.new, self.store, self.begin, self.size = {}, self.store[:0], self.begin[:0], self.size[:0]
        ask = sorted(seen.difference(self.new))
        if ask:
            ids, size = self.merge_words([w.encode() for w in ask])
            self.begin = np.concatenate([self.begin, len(self.store) + np.cumsum(size) - size])
            self.store, self.size = np.concatenate([self.store, ids]), np.concatenate([self.size, size])
            self.new.update(zip(ask, range(len(self.new), len(self.new) + len(ask))))
        find = self.new.__getitem__
        return [np.fromiter(map(find, ws), np.int64, len(ws)) for ws in cuts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain, parts = [], []  # parts: of each text, numbers of pieces in plain or ids of special strings
        for text in texts:
            own = []
            for i, piece in enumerate(self.at_special.split(text) if self.at_special else [text]):
                if i % 2:
                    own.append(np.array([self.special[piece]], np.int64))
                elif piece:
                    own.append(len(plain))
                    plain.append(self.cut(piece))
            parts.append(own)
        numbers = self.numbers(plain)
        ids = []
        for n in numbers:
            ids.append(self.store[spread(self.begin[n], self.size[n])])
        return [np.concatenate([np.zeros(0, np.int64), *(ids[p] if isinstance(p, int) else p for p in own)]).astype("<u4") for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        raw = self.token_bytes[spread(self.token_start[ids], self.token_size[ids])]
        return raw.tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<long> of every whole text (null or empty text: no ids).

    A map over the rows: nothing moves between tasks, repeated rows and null ids
    come out as they are, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for part, ids in _encoded(batches, codec(tokenizer_path)):
            size = np.array([len(i) for i in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<long>")


def _encoded(batches, bpe):
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, bpe.encode([t or "" for t in part.column("text").to_pylist()])


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, then decodes its ids.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers. Null
    texts count as empty; rules as in encode_documents.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe = codec(tokenizer_path)
        for part, ids in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
