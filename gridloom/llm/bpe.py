"""Byte-level BPE in length-bucketed padded matrices.

Every distinct pre-token is one row of a padded matrix of token ids. Rows of similar length share a
matrix. In a round each active row merges its leftmost pair of minimum rank: the pair's rank comes from
a hash table of pairs, the merged column is cut out, so a matrix loses one column a round, and rows
without a mergeable pair leave it (compaction). That equals the greedy merge order of the rank file.

Defined cases: null and empty texts give no ids; repeated rows are encoded alike; an empty table gives
an empty table; other columns of the input are ignored. Ids outside the vocabulary fail on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, ragged, shared, whole_text

NONE = np.int32(2**31 - 1)
# The pre-token pattern for which runs between white space can be split first; Unicode white space.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows of more bytes than this merge through a heap instead (n log n for one long run without a break).
LONG_ROW = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Vocabulary as flat arrays, and an open-addressing table (id, id) -> rank of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) >= 2**31:
            raise ValueError("too many tokens")
        n = max(ranks.values(), default=-1) + 1
        known = np.zeros(n, bool)
        size = np.zeros(n, np.int64)
        words = [b""] * n
        for word, rank in ranks.items():
            known[rank], size[rank], words[rank] = True, len(word), word
        self.known, self.size = known, size
        self.start = np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        found = np.array(pairs, np.int64).reshape(-1, 3)
        self.bits = max(4, int(np.ceil(np.log2(len(found) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = (found[:, 0] << 32) | found[:, 1], found[:, 2].astype(np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = key[taken], value[taken]
            left = np.ones(len(key), bool)
            left[taken] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is no such token. Negative ids are padding."""
        shape = np.broadcast_shapes(a.shape, b.shape)
        key = ((a.astype(np.int64) << 32) | b.astype(np.int64)).reshape(-1)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((a.reshape(-1) >= 0) & (b.reshape(-1) >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """One long row: the same merges, leftmost of the minimum rank first, kept in a heap."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int) -> int:
            j = after[i]
            return int(self.ranks_of(np.array([ids[i]]), np.array([ids[j]]))[0]) if j < n else int(NONE)

        first = self.ranks_of(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) != NONE:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return [x for x, on in zip(ids, alive) if on]

    def encode_rows(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each row, flat, and the number of ids of each row."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        # Buckets: one width up to 16 bytes, then steps of an eighth, so padding stays small.
        step = np.maximum(1, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 4))
        widths = -(-sizes // step) * step
        counts = np.zeros(len(rows), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row numbers, their lengths, ids
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            if width == 0:
                continue
            if width > LONG_ROW:
                for i in own:
                    ids = np.array(self._merge_long(flat[starts[i] : starts[i] + sizes[i]].tolist()), np.int32)
                    parts.append((np.array([i]), np.array([len(ids)]), ids))
                continue
            for at in range(0, len(own), block := max(1, 4_000_000 // int(width))):
                self._merge_block(flat, starts, sizes, own[at : at + block], int(width), parts)
        if not parts:
            return np.zeros(0, np.int32), counts
        order, lengths, ids = (np.concatenate(x) for x in zip(*parts))
        counts[order] = lengths
        place = np.zeros(len(rows), np.int64)
        place[order] = np.cumsum(lengths) - lengths
        return ids[ragged(place, counts)], counts

    def _merge_block(self, flat, starts, sizes, rows, width, parts) -> None:
        column = np.arange(width)
        inside = column < sizes[rows, None]
        m = np.where(inside, flat[np.minimum(starts[rows, None] + column, len(flat) - 1)], np.int32(-1))
        r = np.full(m.shape, NONE, np.int32)  # of the pair that starts in a column; the last has none
        if width > 1:
            r[:, :-1] = self.ranks_of(m[:, :-1], m[:, 1:])
        while len(m):
            at = r.argmin(1)  # the leftmost of the minimum
            best = r[np.arange(len(m)), at]
            if (done := best == NONE).any():
                ended = m[done]
                parts.append((rows[done], (ended >= 0).sum(1), ended[ended >= 0]))
                m, r, rows, at, best = (x[~done] for x in (m, r, rows, at, best))
                if not len(m):
                    break
            i, width = np.arange(len(m)), m.shape[1]
            m[i, at] = best
            keep = np.ones(m.shape, bool)
            keep[i, at + 1] = False
            m = m[keep].reshape(-1, width - 1)
            r = r[keep].reshape(-1, width - 1)
            right = np.minimum(at + 1, width - 2)
            r[i, at] = np.where(at + 1 < width - 1, self.ranks_of(m[i, at], m[i, right]), NONE)
            left = np.maximum(at - 1, 0)
            r[i, left] = np.where(at > 0, self.ranks_of(m[i, left], m[i, at]), r[i, left])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, flat, and the number of bytes of each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.size[ids]
        return self.blob[ragged(self.start[ids], sizes)], sizes


class Encoder:
    """Splits texts into pre-tokens and keeps what it has encoded, up to `most` distinct runs."""

    def __init__(self, table: PairTable, pattern: str, most: int = 400_000):
        self.table, self.most = table, most
        self.fine = regex.compile(pattern)
        # Matches of SPACED_PATTERN never cross the ends of these runs, so runs can be split one by one.
        self.coarse = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+") if pattern == SPACED_PATTERN else self.fine
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, runs: list[str]) -> None:
        pieces = [self.fine.findall(x) for x in runs] if self.coarse is not self.fine else [[x] for x in runs]
        per_run = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes, distinct = pd.factorize(np.array([x for p in pieces for x in p], object))
        ids, n = self.table.encode_rows([x.encode() for x in distinct])
        at = np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(n[codes])])[np.cumsum(per_run)]
        self.seen.update(zip(runs, range(len(self.off) - 1, len(self.off) - 1 + len(runs))))
        self.off = np.concatenate([self.off, self.off[-1] + ends])
        self.flat = np.concatenate([self.flat, ids[ragged(at[codes], n[codes])]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each."""
        runs = [self.coarse.findall(x) for x in texts]
        codes, distinct = pd.factorize(np.array([x for r in runs for x in r], object))
        if len(self.seen) > self.most:
            self._clear()
        if new := [x for x in distinct if x not in self.seen]:
            self._learn(new)
        row = np.fromiter((self.seen[x] for x in distinct), np.int64, len(distinct))[codes]
        n = self.off[row + 1] - self.off[row]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))]
        return self.flat[ragged(self.off[row], n)], np.diff(ends, prepend=0)


def _shared_table(spark: SparkSession, path: str):
    """The pair table as a broadcast: its size depends on the vocabulary alone (about 20 MB for 50,000 tokens)."""
    return shared(spark, PairTable(read_ranks(path)))


#: Characters that one step encodes, which bounds a worker's memory; one longer text is a step of its own.
STEP_CHARS = 2_000_000


def _columns(batches, table, pattern):
    encoder = Encoder(table, pattern)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = pa.compute.utf8_length(texts).to_pylist()
        for a, b in chunks(sizes, STEP_CHARS):
            ids, n = encoder.encode(texts.slice(a, b - a).to_pylist())
            yield keys.slice(a, b - a), ids, n


def encode(docs: DataFrame, vocabulary: str, pattern: str = SPACED_PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids array<int>) of every row; null texts count as empty."""
    table = _shared_table(docs.sparkSession, vocabulary)

    def run(batches):
        for keys, ids, n in _columns(batches, table(), pattern):
            off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.record_batch([keys, pa.ListArray.from_arrays(off, pa.array(ids))], ["key", "token_ids"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, token_ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, content binary): the bytes of every row's ids; a null list counts as an empty one."""
    table = _shared_table(tokens.sparkSession, vocabulary)

    def run(batches):
        vocabulary_table = table()
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            out, sizes = vocabulary_table.decode(flat)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
            raw = out.tobytes()
            yield pa.record_batch([batch.column(0), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["key", "content"])

    rows = tokens.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, content binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str, pattern: str = SPACED_PATTERN, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every row, then decodes the ids it got. with_ids: token_ids as well."""
    table = _shared_table(docs.sparkSession, vocabulary)

    def run(batches):
        own = table()
        for keys, ids, n in _columns(batches, own, pattern):
            out, sizes = own.decode(ids)
            at = np.concatenate([[0], np.cumsum(n)])
            ends = np.concatenate([[0], np.cumsum(sizes)])[at]
            raw_ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(out.tobytes())
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))] if with_ids else []
            yield pa.record_batch(
                [
                    keys,
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(raw_ids[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                    *lists,
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 + with_ids],
            )

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
