"""SentencePiece BPE over tables of distinct chunks.

Where no piece of a model has a whitespace marker behind another character, no
merge crosses the place before a run of markers. Normalised texts are cut
there. A block of documents becomes a table of its distinct chunks and, by
position, their row numbers; each chunk is segmented once, in numpy rounds over
all new chunks together, and the ids go back to the texts by position. A Python
worker keeps its table for the blocks that follow, up to CHUNKS_KEPT rows.
Nothing moves between tasks: a table for all blocks would have to be shuffled
to every block, which costs more disk than the texts have.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ._text import slices, spread

MARK = "▁"
#: Bytes of text in a block of documents (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Chunks that a Python worker's table has before it starts anew.
CHUNKS_KEPT = 500_000
#: Characters of a chunk that is merged together with many others; longer ones go through a heap.
SHORT = 64
#: Characters of chunks merged at once.
BATCH_CHARS = 1 << 19
#: What an unknown id decodes to (a fixed value).
UNKNOWN = " ⁇ "


class PieceBPE:
    """Normalises, segments and decodes as the sentencepiece library does with a BPE model file.

    The library normalises texts; merging and decoding are done here. Models
    that need more (unused pieces, collapsed spaces, no bytes for unknown characters) are an error.
    """

    def __init__(self, path: str):
        sp = self.library = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte = np.array([sp.is_byte(i) for i in range(size)])
        self.control = np.array([sp.is_control(i) for i in range(size)])
        if any(sp.is_unused(i) for i in range(size)) or self.byte.sum() != 256 or sp.normalize("a  b").count(MARK * 2) != 1:
            raise ValueError(f"{path}: only BPE models with a piece for each byte, all pieces in use and spaces kept are supported")
        plain = {p: i for i, p in enumerate(pieces) if not (self.byte[i] or self.control[i] or sp.is_unknown(i))}
        #: symbols: a piece's id, or size + code point for a character that is no piece
        self.size = size
        self.char = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.of_byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.byte):
            self.of_byte[int(pieces[i][1:-1], 16)] = i
        # any two adjacent symbols merge if together they are a piece; equal scores are equal ranks
        rank = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        pairs = []
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = (plain.get(x, self.char[ord(x)] if len(x) == 1 else None) for x in (p[:k], p[k:]))
                if a is not None and b is not None:
                    pairs.append((int(a) << 32 | int(b), rank[sp.get_score(i)], i))
        pairs.sort()
        self.pair, self.rank, self.into = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64))
        crosses = any(MARK in p.lstrip(MARK) for p in plain)
        self.cut = re.compile(".+" if crosses else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL).findall
        shown = [b"" if self.control[i] else UNKNOWN.encode() if sp.is_unknown(i) else bytes([int(p[1:-1], 16)]) if self.byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(b) for b in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.marked = np.array([p.startswith(MARK) and p in plain for p in pieces])
        first = next((i for p, i in plain.items() if p[0] == MARK != p[-1]), None)
        self.strips = first is not None and not sp.decode([first]).startswith(" ")
        # the table: a chunk's row, and where its ids lie
        self.row, self.table, self.begin, self.count = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The parts of the normalised text that no merge leaves, in order."""
        return self.cut(self.library.normalize(text)) if text else []

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols and what it becomes; the greatest integer for a pair that doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_MERGE), self.into[at]

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in one array, and each chunk's number of ids."""
        parts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        # consecutive chunks go together, but a long one alone
        long = length > SHORT
        part = np.cumsum(np.where(long, 0, length)) // BATCH_CHARS + np.cumsum(long) + np.cumsum(np.concatenate([[False], long[:-1]]))
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(chunks)]):
            symbols = self.symbols("".join(chunks[a:b]))
            if b - a == 1 and long[a]:
                symbols, owner = self.merge_long(symbols), None
            else:
                symbols, owner = self.merge(symbols, np.repeat(np.arange(b - a), length[a:b]))
            owner = np.zeros(len(symbols), np.int64) if owner is None else owner
            ids, owner = self.ids(symbols, owner)
            parts.append(ids)
            sizes.append(np.bincount(owner, minlength=b - a))
        return np.concatenate(parts), np.concatenate(sizes)

    def symbols(self, text: str) -> np.ndarray:
        return self.char[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each round every chunk merges its best pair, the leftmost of equals, until none has one."""
        done_symbols, done_owner = [], []
        rank, into = np.full(len(symbols), NO_MERGE), np.zeros(len(symbols), np.int64)  # of each symbol and the next
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner], into[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(symbols))))
            open_ = least < NO_MERGE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, rank, into, least = symbols[open_], owner[open_], rank[open_], into[open_], least[open_]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank, into = symbols[keep], owner[keep], rank[keep], into[keep]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):  # the pairs that a merged symbol starts or ends
                rank[i] = NO_MERGE
                i = i[i + 1 < len(symbols)]
                i = i[owner[i] == owner[i + 1]]
                rank[i], into[i] = self.ranks(symbols[i], symbols[i + 1])
        if not done_owner:
            return symbols, owner
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long chunk: a heap of pairs (rank, place), over linked symbols."""
        rank, into = self.ranks(symbols[:-1], symbols[1:])
        some = np.flatnonzero(rank < NO_MERGE)
        s = symbols.tolist()
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = list(zip(rank[some].tolist(), some.tolist(), symbols[some].tolist(), symbols[some + 1].tolist(), into[some].tolist()))
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= len(s) or s[j] != b:
                continue  # one of the two has merged meanwhile
            s[i], s[j], after[i] = ab, -1, after[j]
            if after[i] < len(s):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(s):
                    pair = s[x], s[y]
                    if pair not in known:
                        r, m = self.ranks(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = int(r[0]), int(m[0])
                    if known[pair][0] < NO_MERGE:
                        heapq.heappush(heap, (known[pair][0], x, *pair, known[pair][1]))
        return np.array([x for x in s if x >= 0], np.int64)

    def ids(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as they are; any other character becomes the pieces of its UTF-8 bytes."""
        other = symbols >= self.size
        if not other.any():
            return symbols, owner
        raw = [chr(c).encode() for c in (symbols[other] - self.size).tolist()]
        count = np.ones(len(symbols), np.int64)
        count[other] = [len(b) for b in raw]
        out = np.repeat(symbols, count)
        out[np.repeat(other, count)] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(owner, count)

    def numbers(self, cuts: list[list[str]]) -> list[np.ndarray]:
        """The row of each chunk in the table, after segmenting the chunks that it hasn't."""
        if len(self.row) > CHUNKS_KEPT:
            self.row, self.table, self.begin, self.count = {}, self.table[:0], self.begin[:0], self.count[:0]
        ask = sorted(set().union(*cuts).difference(self.row))
        if ask:
            ids, count = self.segment(ask)
            self.begin = np.concatenate([self.begin, len(self.table) + np.cumsum(count) - count])
            self.table, self.count = np.concatenate([self.table, ids]), np.concatenate([self.count, count])
            self.row.update(zip(ask, range(len(self.row), len(self.row) + len(ask))))
        find = self.row.__getitem__
        return [np.fromiter(map(find, own), np.int64, len(own)) for own in cuts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.table[spread(self.begin[n], self.count[n])] for n in self.numbers([self.chunks(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; each byte that is no part of a UTF-8 character becomes the replacement character."""
        ids = np.asarray(ids, np.int64)
        silent = np.flatnonzero(self.control[ids])
        runs = np.split(ids, silent) if len(silent) else [ids]  # bytes around a control piece make no character together
        out, strips = [], self.strips
        for run in runs:
            raw = self.shown[spread(self.shown_start[run], self.shown_size[run])].tobytes()
            shown = run[self.control[run[:1]].sum():]
            if strips and len(shown):
                raw, strips = raw[int(self.marked[shown[0]]):], False
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_replaced(raw))
        return "".join(out)


NO_MERGE = np.iinfo(np.int64).max


def _replaced(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceBPE:
    return PieceBPE(path)


def _encoded(batches, model: PieceBPE):
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            yield part, model.encode([t or "" for t in part.column("text").to_pylist()])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text (null or empty text: no ids), without begin or end ids.

    A map over the rows: repeated rows and null ids come out as they are, and
    other columns are not read. The model file must be there on every executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for part, ids in _encoded(batches, codec(model_path)):
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row's ids (null: an empty text; null ids inside count as none)."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.array_compact(F.coalesce(F.col(ids_col), F.array())).alias("ids"))

    def run(batches):
        model = codec(model_path)
        for batch in batches:
            texts = pa.array([model.decode(i.values.to_numpy()) for i in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, then decodes its ids.

    ids_sha256 is over the decimal ids joined by commas; rules as in encode_documents.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        model = codec(model_path)
        for part, ids in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(model.decode(i).encode()).hexdigest() for i in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
