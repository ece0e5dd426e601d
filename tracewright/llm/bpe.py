"""Byte-level BPE encoding and decoding with numpy.

Every match of the pre-tokenizer's pattern is merged separately.  Distinct matches of like lengths are
the columns of padded matrices of bounded size; each round every column merges its leftmost pair of minimum
rank, pair ranks come from an open-addressing hash table, and finished columns leave the matrix.
Matches longer than ``MATRIX_BYTES`` go through an exact heap instead, since a column takes one
round per merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import map_pieces
from tracewright.llm.common import hold

MATRIX_BYTES = 256
#: Cells of a matrix, or twice as many.
MATRIX_CELLS = 1 << 16
#: Distinct matches whose ids a worker remembers; when more come up it starts afresh.
MEMORY = 200_000
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> bytes:
    """The vocabulary file's content, read on the driver and sent with the tasks (bounded by the
    vocabulary, about a megabyte)."""
    return Path(path).read_bytes()


class PairTable:
    """Hashed lookup of (left id, right id) -> merged id, vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            first = np.unique(slot[left][free], return_index=True)[1]
            won = left[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = left[~np.isin(left, won)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        slot = self._slot(flat)
        found = self.keys[slot]
        hit = found == flat
        out = np.where(hit, self.values[slot], _NONE)
        todo = np.flatnonzero(~hit & (found >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            todo, slot = todo[more], slot[more]
        return out.reshape(keys.shape)


class Encoder:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.pair_rank = dict(zip(keys, values, strict=True))
        names = sorted(self.ranks, key=self.ranks.get)
        lengths = np.zeros(self.size, np.int64)
        lengths[[self.ranks[x] for x in names]] = [len(x) for x in names]
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(names), np.uint8)
        self._forget()

    def _forget(self) -> None:
        outer = self

        class Known(dict):
            """Match -> number; a new match gets the next number and waits to be encoded."""

            def __missing__(self, match: str) -> int:
                outer.waiting.append(match)
                self[match] = n = len(self)
                return n

        self.waiting: list[str] = []
        self.known = Known()
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, matches: list[bytes]) -> list[np.ndarray]:
        """The ids of every match."""
        return _split(*self.merge_flat(matches))

    def merge_flat(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in one array, and how many each match has."""
        size = np.fromiter(map(len, matches), np.int64, len(matches))
        whole = np.fromiter(map(self.ranks.get, matches, repeat(-1)), np.int64, len(matches))
        length = np.minimum(size, 1)
        parts = [(rows := np.flatnonzero(whole >= 0), whole[rows])]
        for i in np.flatnonzero((whole < 0) & (size > MATRIX_BYTES)).tolist():
            parts.append((np.array([i]), self._merge_long(matches[i])))
            length[i] = len(parts[-1][1])
        rows = np.flatnonzero((whole < 0) & (size > 0) & (size <= MATRIX_BYTES))
        rows = rows[np.argsort(size[rows], kind="stable")]
        sizes, a = size[rows], 0
        while a < len(rows):
            b = min(a + max(1, MATRIX_CELLS // int(sizes[a])), int(np.searchsorted(sizes, 2 * sizes[a], "right")))
            ids, length[rows[a:b]] = self._merge_columns([matches[i] for i in rows[a:b].tolist()], sizes[a:b])
            parts.append((rows[a:b], ids))
            a = b
        start, out = np.cumsum(length) - length, np.empty(int(length.sum()), np.int32)
        for rows, ids in parts:
            out[spread(start[rows], length[rows])] = ids
        return out, length

    def _merge_matrix(self, matches: list[bytes]) -> list[np.ndarray]:
        return _split(*self._merge_columns(matches, np.array([len(m) for m in matches])))

    def _merge_columns(self, matches: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for matches of at most ``MATRIX_BYTES``. A column holds a match, with the rank and the place of each
        pair as one number, so that a column's least number is its leftmost pair of minimum rank."""
        width, count = int(size.max()), len(matches)
        inside = np.arange(width) < size[:, None]
        cells = np.full((count, width), -1, np.int32)
        cells[inside] = self.byte_ids[np.frombuffer(b"".join(matches), np.uint8)]
        cells = np.ascontiguousarray(cells.T)
        pairs = np.full((width, count), _NONE, np.int32)
        place, column = np.nonzero(cells[1:] >= 0)
        pairs[place, column] = self._placed(cells[place, column], cells[place + 1, column], place)
        after, before = (np.repeat(np.arange(x, width + x, dtype=np.int32)[:, None], count, axis=1) for x in (1, -1))
        out, mine = np.full((width, count), -1, np.int32), np.arange(count)
        while True:
            best = pairs.min(axis=0)
            live = np.flatnonzero(best != _NONE)
            if 4 * len(live) < 3 * len(mine):  # finished columns leave the matrix
                done = np.flatnonzero(best == _NONE)
                out[:, mine[done]] = cells[:, done]
                mine, best = mine[live], best[live]
                cells, pairs, after, before = (x.take(live, axis=1) for x in (cells, pairs, after, before))
                live = np.arange(len(mine))
            else:
                best = best[live]
            if not len(live):
                break
            n, (c, p, to, back) = len(mine), (x.reshape(-1) for x in (cells, pairs, after, before))
            at, new = best & 255, best >> 8
            here = at.astype(np.int64) * n + live
            gone = to[here].astype(np.int64) * n + live
            then, left = to[gone], back[here]
            c[here], c[gone], p[here], p[gone], to[here] = new, -1, _NONE, _NONE, then
            # only the pairs on both sides of the merged cell change
            r = np.flatnonzero(then < width)
            there = then[r].astype(np.int64) * n + live[r]
            some = c[there] >= 0
            r, there = r[some], there[some]
            back[there] = at[r]
            k = np.flatnonzero(left >= 0)
            prior = left[k].astype(np.int64) * n + live[k]
            p[np.concatenate([here[r], prior])] = self._placed(np.concatenate([new[r], c[prior]]), np.concatenate([c[there], new[k]]), np.concatenate([at[r], left[k]]))
        out = out.T
        kept = out >= 0
        return out[kept], kept.sum(axis=1)

    def _placed(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The ranks of pairs with their places, as one number for each."""
        rank = self.pairs.get(a.astype(np.int64) * self.size + b)
        return np.where(rank == _NONE, _NONE, (rank << 8) | place.astype(np.int32))

    def _merge_long(self, match: bytes) -> np.ndarray:
        ids = [int(self.byte_ids[b]) for b in match]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, size = self.pair_rank.get, self.size
        heap = [(x, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (x := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], k = new, -1, after[j]
            after[i] = k
            if k < len(ids):
                before[k] = i
                if (x := get(new * size + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (x := get(ids[h] * size + new)) is not None:
                heapq.heappush(heap, (x, h, ids[h], new))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the bounds of each text's ids in it."""
        if len(self.known) > MEMORY:
            self._forget()
        number, find = self.known.__getitem__, self.pattern.findall
        used, counts = [], []
        for t in texts:
            found = find(t)
            counts.append(len(found))
            used.append(np.fromiter(map(number, found), np.int64, len(found)))
        if self.waiting:
            new = self.merge([m.encode() for m in self.waiting])
            self.waiting.clear()
            length = np.array([len(x) for x in new], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, *new])
        numbers = np.concatenate(used) if used else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.length[numbers])])
        bounds = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return self.ids[spread(self.start[numbers], self.length[numbers])], bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids between two bounds."""
        length = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])[bounds]
        raw = self.token_bytes[spread(self.token_start[ids], length)].tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _split(values: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Consecutive runs of the given lengths."""
    ends = np.cumsum(length).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] steps, then the same from start[1], and so on."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hashlib.sha256(content).digest(), pattern)
    hold("bpe", _ENCODERS.clear)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the ids of its whole text: doc_id, ids, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode
    to).

    Null and empty texts have no ids; special-token strings are ordinary text; repeated rows get
    one result each; an empty table gives an empty result; other columns are ignored. A very long text is
    encoded whole: n bytes take up to some 100 n bytes of a worker's memory. Of pairs of equal rank
    the leftmost is merged first.
    """
    content = read_ranks(ranks_path)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(content, pattern)
        ids, bounds = coder.encode([t or "" for t in batch.column("text").to_pylist()])
        plain = ids.astype("<u4")
        ids_sha = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        text_sha = [hashlib.sha256(x).hexdigest() for x in coder.decode(ids, bounds)]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows of (doc_id, ids) with the decoded bytes: doc_id, raw. Null ids decode to nothing."""
    content = read_ranks(ranks_path)

    def run(batches):
        coder = encoder(content, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            raw = coder.decode(np.concatenate([np.zeros(0, np.int32), *lists]), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, raw binary")
