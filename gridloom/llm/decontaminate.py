"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared lower-cased, with each run of white space as one space. An item is cut into overlapping
windows of WINDOW characters (a shorter item is one window), so a verbatim passage of WINDOW + STRIDE - 1 characters holds a whole one. A window of w characters leaks into a text if a substring of the text
is within k = w // EDITS edits of it. Then at least w + 1 - q (k + 1) of the window's q-grams stand in the
text, on diagonals that differ by k at most. So shared q-grams are counted in overlapping bands of diagonals, the
bands that reach that bound are kept, and an alignment of the window over the band's diagonals alone decides.

Items under MINIMUM characters, normalised, are matched without edits and between word borders; items under Q characters only if they are the whole text.

The benchmark is the query set: it goes to executors in blocks of bounded size, and each block is held against
every whole text. With more than one block, a bitmap of fixed size over the q-grams of all items first finds the texts that hold as many of them
close together as any window needs; only those are read again for each block.

Defined cases: null and empty texts leak nothing; null and empty items are left
out; repeated rows give equal rows; empty tables give an empty table; other columns are ignored. Positions count characters
of the normalised text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, identity, ragged, shared, stored, whole_text

WINDOW, STRIDE, Q, EDITS, MINIMUM = 50, 5, 8, 12, 40
#: Characters of benchmark items that one block of the query set holds, about.
BLOCK_CHARS = 500_000
STEP_CHARS = 1_000_000
#: log2 of the bits of the filter of one block, and of the bitmap of all items.
FILTER_BITS, ALL_BITS = 23, 27


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of every Q = 8 characters, by doubling."""
    h = x.astype(np.uint64) + np.uint64(1)
    for span, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= span:
            return np.zeros(0, np.uint64)
        h = h[:-span] * np.uint64(factor) + h[span:]
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """The windows of a block of items, and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.at, parts = [], [], []
        for number, (_, text) in enumerate(items):
            last = max(0, len(text) - WINDOW)
            for at in sorted({*range(0, last + 1, STRIDE), last}):
                self.item.append(number)
                self.at.append(at)
                parts.append(points(text[at : at + WINDOW]))
        self.ids = [i for i, _ in items]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.text = np.zeros((len(parts), WINDOW), np.uint32)
        for i, p in enumerate(parts):
            self.text[i, : len(p)] = p
        short = np.array([len(items[i][1]) < MINIMUM for i in self.item], bool)
        self.budget = np.where(short, 0, self.size // EDITS)
        self.whole: dict[str, list[int]] = {}
        for number, (_, text) in enumerate(items):
            if len(text) < Q:
                self.whole.setdefault(text, []).append(number)
        self.bound = self.size + 1 - Q * (self.budget + 1)
        found = [grams(p) for p in parts]
        key = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(g) for g in found])
        offset = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((offset, owner, key))
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.owner, self.offset = owner[order], offset[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._bit(self.keys)] = True

    @staticmethod
    def _bit(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)

    def regions(self, text: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of the bands that reach the bound, over joined texts; own: q-grams that lie in one text."""
        h = grams(text)
        at = np.flatnonzero(self.filter[self._bit(h)] & own[: len(h)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        at, i = at[hit], i[hit]
        n = self.first[i + 1] - self.first[i]
        entry = ragged(self.first[i], n)
        window = self.owner[entry]
        diagonal = np.repeat(at, n) - self.offset[entry] + WINDOW  # not negative
        step = self.budget[window] + 1
        count = 1 + (len(text) + 2 * WINDOW)
        band, hits = np.unique(window * count + diagonal // step, return_counts=True)
        window, band = band // count, band % count
        # A band with the one below it: every k + 1 neighbouring diagonals lie in such a pair.
        below = np.zeros(len(band), np.int64)
        joined = (band[1:] == band[:-1] + 1) & (window[1:] == window[:-1])
        below[1:][joined] = hits[:-1][joined]
        above = np.zeros(len(band), np.int64)
        above[:-1][joined] = hits[1:][joined]
        keep = np.maximum(hits + below, hits + above) >= self.bound[window]
        window, band = window[keep], band[keep]
        return window, (band - 1) * (self.budget[window] + 1) - WINDOW

    def aligned(self, text: np.ndarray, lows: np.ndarray, highs: np.ndarray, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window over the diagonals of its band (three bands from start on, and its edits to both sides), inside its text, and
        where the best alignment ends. Column c of a row is diagonal start - edits + c: the column to the right in the row before drops a character
        of the window, the column to the left in the same row skips one of the text."""
        edits, ends = np.full(len(window), WINDOW + 1), np.zeros(len(window), np.int64)
        most = WINDOW // EDITS
        width = 3 * (most + 1) + 2 * most
        steps = np.arange(width, dtype=np.int32)
        for a in range(0, len(window), 16384):
            w, s = window[a : a + 16384], start[a : a + 16384] - most
            low, high = lows[a : a + 16384, None], highs[a : a + 16384, None]
            row = np.zeros((len(w), width), np.int32)  # a match may start anywhere
            best, size = row.copy(), self.size[w]
            for r in range(int(size.max())):
                j = s[:, None] + (r + steps)
                same = (j >= low) & (j < high) & (text[np.clip(j, 0, len(text) - 1)] == self.text[w, r][:, None])
                new = row + ~same
                np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
                row = np.minimum.accumulate(new - steps, axis=1) + steps
                done = size == r + 1
                best[done] = row[done]
            end = best.argmin(1)
            edits[a : a + 16384], ends[a : a + 16384] = best[np.arange(len(w)), end], s + size + end
        return edits, np.minimum(ends, highs)


def borders(text: str, end: int, size: int) -> bool:
    """Whether the passage of that size and end stands between word borders."""
    return not (text[end - size - 1 : end - size].isalnum() or text[end : end + 1].isalnum())


def leaks_in(texts: list[str], windows: Windows) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, leaking windows, end of the best, its edits) of the leaks in normalised texts."""
    tiny = [(n, i, 1, len(t), 0) for n, t in enumerate(texts) for i in windows.whole.get(t, ())]
    sizes = np.array([len(t) for t in texts], np.int64)
    text = points("\n".join(texts))  # normalised texts have no line breaks
    if not len(windows.size) or len(text) < Q:
        return tiny
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    border = np.zeros(len(text) + 1, np.int32)
    border[1:] = np.cumsum(text == 10)
    own = border[Q:] == border[:-Q]
    window, start = windows.regions(text, own)
    if not len(window):
        return tiny
    # the text that the middle of the region lies in
    number = np.clip(np.searchsorted(starts, start + windows.size[window] // 2 + windows.budget[window], "right") - 1, 0, len(texts) - 1)
    edits, ends = windows.aligned(text, starts[number], (starts + sizes)[number], window, start)
    good = edits <= windows.budget[window]
    found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for n, w, e, end in zip(number[good].tolist(), window[good].tolist(), edits[good].tolist(), (ends - starts[number])[good].tolist()):
        if windows.size[w] < MINIMUM and not borders(texts[n], end, int(windows.size[w])):
            continue
        own_windows = found.setdefault((n, windows.item[w]), {})
        own_windows[w] = min(own_windows.get(w, (e, end)), (e, end))
    return sorted(tiny + [(n, i, len(ws), min(ws.values())[1], min(ws.values())[0]) for (n, i), ws in found.items()])


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")


def _blocks(rows: DataFrame):
    """The items in blocks of about BLOCK_CHARS characters, each as a list on the driver: one block at a time, in one pass."""
    items, size = [], 0
    for r in rows.distinct().orderBy("id", "text").toLocalIterator():
        if t := normal(r["text"]):
            items.append((r["id"], t))
            size += len(t)
        if size >= BLOCK_CHARS:
            yield items
            items, size = [], 0
    if items:
        yield items


def _bits(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - ALL_BITS)).astype(np.int64)


def _suspects(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows (key, text) with as many q-grams of items within the length of a window and its edits as the least bound of all windows."""

    def words(batches):
        for batch in batches:
            bit = np.unique(np.concatenate([np.zeros(0, np.int64), *(_bits(grams(points(normal(t)))) for t in batch.column(0).to_pylist())]))
            yield pa.record_batch([pa.array(bit >> 6), pa.array((np.int64(1) << (bit & 63)).astype(np.int64))], ["word", "bits"])

    # One row a word of the bitmap: 2 ** (ALL_BITS - 6) rows at most, whatever the benchmark.
    found = items.select("text").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (ALL_BITS - 6), np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    index = shared(rows.sparkSession, bitmap)
    # An item under MINIMUM characters needs one q-gram at least, one under Q characters none.
    least = items.agg(F.min(F.char_length(F.btrim(F.regexp_replace("text", r"\s+", " "))))).first()[0] or 0
    need = 0 if least < 4 * Q else 1 if least < MINIMUM else MINIMUM + 1 - Q * (MINIMUM // EDITS + 1)
    reach = WINDOW + 2 * (WINDOW // EDITS)

    def keep(batches):
        known = index()
        for batch in batches:
            on = []
            for t in batch.column(1).to_pylist():
                bit = _bits(grams(points(normal(t))))
                hit = np.flatnonzero((known[bit >> 6] >> (bit & 63)) & 1)
                on.append(need == 0 or len(hit) >= need and bool((hit[need - 1 :] - hit[: len(hit) - need + 1] <= reach).any()))
            yield batch.filter(pa.array(on, pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item_id, n_windows, end_at, edits): every document and item of which a window leaks into the document."""
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item_id bigint, n_windows bigint, end_at bigint, edits int"
    names = ["key", "item_id", "n_windows", "end_at", "edits"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    queries = _items(benchmark, item, "text")
    many = (queries.agg(F.sum(F.char_length("text"))).first()[0] or 0) > BLOCK_CHARS
    if many:
        rows = stored(_suspects(rows, queries), "suspects")
    out = None
    for items in _blocks(queries):
        index = shared(docs.sparkSession, Windows(items))

        def run(batches, index=index):
            windows = index()
            for batch in batches:
                texts = [normal(t) for t in batch.column(1).to_pylist()]
                for a, b in chunks([len(t) for t in texts], STEP_CHARS):
                    found = leaks_in(texts[a:b], windows)
                    keys = batch.column(0).take(pa.array([a + f[0] for f in found], pa.int64()))
                    cols = [[windows.ids[f[1]] for f in found], *([f[i] for f in found] for i in (2, 3, 4))]
                    yield pa.record_batch([keys, *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

        part = rows.mapInArrow(run, schema)
        if many:  # one block's index at a time
            part = stored(part, "leaks")
            index.forget()
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    row, tag = identity(docs, key, text)
    dirty = leaks(docs.select(F.struct(row, tag).alias("id"), F.col(text).alias("text")), benchmark, "id").select("id.row", "id.tag").distinct()
    every = docs.select(row, tag, F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("all"))
    return every.join(dirty, ["row", "tag"], "left_anti").select(*[F.col(f"all._{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "end_at", "edits")
