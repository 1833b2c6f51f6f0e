"""Line deduplication over all documents, exact and within EDITS edits.

Lines are trimmed of white space. A line may differ by one edit for each MINIMUM characters of the shorter line, EDITS at most: so equal
lines are one class at any length (that of `minimum`; 1 in op9 and the pipeline, for all lines that hold a letter or digit), lines of
MINIMUM to NEAR - 1 characters are near within one edit, longer ones within two.

For near lines, a line is cut into edits + 1 segments: lines within the edits share a segment of the shorter one, at nearly its place. So
each line is indexed by its segments, and probes, for each length up to the edits below its own, the substrings that could be
a segment of such a line. Lines that meet at a signature are first held against each other by counts of character
classes (k edits change 2 * k counts at most), then by a banded bit-parallel edit distance. Components of
the links are the classes. The first line of a class (least key, then position) stays, all others go.

Signatures are shuffled without texts, packed by bucket, and a task holds one bucket of them at least (1 in BUCKETS of all); texts are fetched for lines that have a likely partner only. A signature with more than GROUP
lines is not compared pair by pair. Its lines are dealt again: what is not yet known to be equal is cut into PIECES pieces, of
which all but as many as there are edits are untouched, and so on until groups are small or only a few characters are open. There the edits are enumerated: lines with one
variant (positions replaced or dropped) are linked with the least of them. So work grows with the lines of a group, not
with their pairs, no link is lost, and no task holds more than a bounded part of a group: rows of a signature that is frequent within one chunk of lines are spread over
tasks by a lane number.

Lines are told apart by 96 bits of hashes; a chance of 1e-5 that two of 1e12 lines are confused.

Defined cases: null and empty texts have no lines to remove; rows of one key and one text count as one document and stay alike;
null keys come first; an empty table gives an empty table; other columns pass through deduplicated(). A document that
loses all its lines is left out by deduplicated().
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, identity, stored, whole_groups, whole_text
from gridloom.llm.components import components
from gridloom.llm.rolling import Hashes, mix

MINIMUM, NEAR, EDITS = 20, 40, 2  # characters of a line that is joined by one edit; by EDITS edits; edits
#: Lines that a task remembers to have given signatures for, so repeated lines are shuffled once a task.
REMEMBERED = 500_000
#: Keys of needed lines (8 bytes each) up to which they are broadcast rather than shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of signatures handled together; lines whose signatures are made together, and how many of them may share one before the rest is spread.
ROWS, CHUNK, LOCAL = 100_000, 4000, 64
#: Lines of a group that are compared pair by pair; larger groups are dealt again.
GROUP = 256
#: Open characters from which the edits are enumerated, by the number of edits.
OPEN = {1: 64, 2: 12}
#: Pieces that open characters are cut into, of which as many as there are edits may differ.
PIECES = 4
CLASSES = 15
#: A row of signatures as it is shuffled, many in one binary; buckets that such rows are dealt to by signature and lane number, and binaries unpacked together.
ROW = np.dtype([("sign", "<i8"), ("h", "<i8"), ("sketch", "<i8"), ("lane", "<i4")])
BUCKETS, PACKED = 4096, 10_000


def segments(size: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the edits + 1 segments of lines of that many characters; the later ones take the remainder."""
    parts = edits + 1
    base, rest = size // parts, size % parts
    out, start = [], np.zeros_like(size)
    for i in range(parts):
        length = base + (i >= parts - rest)
        out.append((start, length))
        start = start + length
    return out


def placed(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, ...]:
    """(line number, signature, part, place in the line, characters of the indexed line) of all segments and probes. A signature is odd if it is for one edit."""
    size = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    hashes = Hashes(mix(text.astype(np.uint64) + np.uint64(1)))
    out: list[tuple[np.ndarray, ...]] = []
    every = np.arange(len(lines))

    def add(of, part, start, length, total):
        h = hashes.of(first[of] + start, first[of] + start + length)
        sign = mix(h ^ mix((total * 8 + part).astype(np.uint64))) & ~np.uint64(1) | np.uint64(edits < EDITS)
        out.append((of, sign.view(np.int64), np.full(len(of), part), start, total))

    for i, (start, length) in enumerate(segments(size, edits)):
        add(every, i, start, length, size)
    for less in range(edits + 1):
        total = size - less
        for i, (start, length) in enumerate(segments(total, edits)):
            # the i edits at most before it, and edits - i after it, bound where the segment can stand
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + shift
                on = every[(at >= 0) & (at + length <= size)]
                if less or shift:  # else it is the line's own segment
                    add(on, i, at[on], length[on], total[on])
    return tuple(np.concatenate(x) for x in zip(*out))


def sketches(lines: list[str]) -> np.ndarray:
    """For each line the counts of its characters by class and its size, 4 bits each."""
    size = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    group = np.repeat(np.arange(len(lines)), size) * CLASSES + (text.astype(np.int64) * 7) % CLASSES
    counts = np.bincount(group, minlength=len(lines) * CLASSES).reshape(-1, CLASSES) & 15
    sketch = (size & 15).astype(np.uint64)
    for c in range(CLASSES):
        sketch |= counts[:, c].astype(np.uint64) << np.uint64(4 * (c + 1))
    return sketch.view(np.int64)


def signatures(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, signature, sketch) of all segments and probes of lines."""
    number, sign, *_ = placed(lines, edits)
    return number, sign, sketches(lines)[number]


def placed_by_size(lines: list[str]) -> tuple[np.ndarray, ...]:
    """placed() of each line for the edits its length allows, and those edits; lines of NEAR characters can have a shorter partner as well."""
    size = np.array([len(x) for x in lines], np.int64)
    parts = []
    for own, edits in ((np.flatnonzero(size >= NEAR), EDITS), (np.flatnonzero((size >= MINIMUM) & (size <= NEAR)), 1)):
        if len(own):
            number, *rest = placed([lines[i] for i in own], edits)
            parts.append((own[number], *rest, np.full(len(number), edits)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6


def allowed(sign: np.ndarray) -> np.ndarray:
    """The edits that a signature is for."""
    return EDITS - (sign & 1) * (EDITS - 1)


def alike(a: np.ndarray, b: np.ndarray, edits=EDITS) -> np.ndarray:
    """Whether sketches allow that many edits."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    total = np.zeros(len(x), np.int64)
    for c in range(1, CLASSES + 1):
        d = (((x >> np.uint64(4 * c)) - (y >> np.uint64(4 * c))) & np.uint64(15)).astype(np.int64)
        total += np.minimum(d, 16 - d)
    d = ((x - y) & np.uint64(15)).astype(np.int64)
    return (total <= 2 * edits) & (np.minimum(d, 16 - d) <= edits)


def within(lines: list[str], a: np.ndarray, b: np.ndarray, edits: np.ndarray | None = None) -> np.ndarray:
    """Whether the lines of each pair are within EDITS edits, or their own number of `edits` if given, by a banded bit-parallel automaton.

    Bit d of state e says that, after j characters of b, the first j + d - EDITS characters of a are reached with e edits at
    most. A step of one character moves all diagonals and all pairs at once.
    """
    size = np.array([len(x) for x in lines], np.int64)
    out = np.zeros(len(a), bool)
    edits = np.full(len(a), EDITS) if edits is None else edits
    todo = np.flatnonzero(np.abs(size[a] - size[b]) <= EDITS)
    todo = todo[np.argsort(size[b[todo]], kind="stable")]
    band = np.uint8((1 << (2 * EDITS + 1)) - 1)
    at = 0
    while at < len(todo):
        n = max(1, min(len(todo) - at, 2_000_000 // int(size[b[todo[min(at + 4096, len(todo)) - 1]]] + 8), 4096))
        own = todo[at : at + n]
        at += n
        width = int(max(size[a[own]].max(), size[b[own]].max()))
        x, y = np.full((width + 2 * EDITS, n), 0xFFFFFFFF, np.uint32), np.full((width, n), 0xFFFFFFFE, np.uint32)
        for i, p in enumerate(own):
            x[EDITS : EDITS + size[a[p]], i] = np.frombuffer(lines[a[p]].encode("utf-32-le", "surrogatepass"), np.uint32)
            y[: size[b[p]], i] = np.frombuffer(lines[b[p]].encode("utf-32-le", "surrogatepass"), np.uint32)
        state = [np.full(n, ((1 << (e + 1)) - 1) << EDITS, np.uint8) & band for e in range(EDITS + 1)]
        last, goal = size[b[own]], (size[a[own]] - size[b[own]] + EDITS).astype(np.uint8)
        for j in range(width):
            match = np.zeros(n, np.uint8)
            for d in range(2 * EDITS + 1):
                match |= (x[j + d] == y[j]).view(np.uint8) << np.uint8(d)
            new = [state[0] & match]
            for e in range(1, EDITS + 1):
                new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> np.uint8(1)) | (new[e - 1] << np.uint8(1))) & band)
            state = new
            if (ended := last == j + 1).any():
                reached = np.array(state)[edits[own[ended]], np.flatnonzero(ended)]
                out[own[ended]] = (reached >> goal[ended]) & 1 == 1
            elif j % 16 == 15 and not state[EDITS].any():
                break
    return out


def lanes(sign: np.ndarray, indexed: np.ndarray, chunk: int) -> np.ndarray:
    """Bit 0: an indexed segment, not a probe. Bit 1: the signature is frequent in this chunk. From bit 2 on: where its rows beyond LOCAL go."""
    out = indexed.astype(np.int32)
    _, code, count = np.unique(sign, return_inverse=True, return_counts=True)
    many = np.flatnonzero(count[code] > LOCAL)
    if len(many):
        out[many] |= 2
        order = many[np.argsort(code[many], kind="stable")]
        own = code[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        out[order[rank >= LOCAL]] |= np.int32((1 + chunk % 1_000_003) << 2)
    return out


def packed(sign: np.ndarray, h: np.ndarray, sketch: np.ndarray, lane: np.ndarray) -> pa.RecordBatch:
    """(bucket, rows): the rows of each bucket as one binary, so that a shuffle moves and sorts few rows."""
    bucket = (mix(sign.view(np.uint64) + (lane >> 2).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    rows = np.empty(len(sign), ROW)
    for name, x in zip(ROW.names, (sign, h, sketch, lane)):
        rows[name] = x[order]
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = (np.append(first, len(rows)) * ROW.itemsize).astype(np.int32)
    binaries = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.record_batch([pa.array(bucket[first].astype(np.int32)), binaries], ["bucket", "rows"])


def unpacked(batches):
    """Batches (sign, h, sketch, lane, path) by sign, lane number and h, of packed rows clustered by bucket; rows that meet no other are left out."""
    for table in whole_groups(batches, PACKED):
        rows = np.frombuffer(b"".join(table.column(1).to_pylist()), ROW)
        order = np.argsort(rows["sign"])
        sign = rows["sign"][order]
        same = sign[1:] == sign[:-1]
        on = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (rows["lane"][order] & 2 > 0)
        rows = rows[order[on]]
        rows = rows[np.lexsort((rows["h"], rows["lane"] >> 2, rows["sign"]))]
        yield pa.record_batch([*(pa.array(np.ascontiguousarray(rows[c])) for c in ROW.names), pa.nulls(len(rows), pa.binary())], [*ROW.names, "path"])


def _signature_rows(lines: DataFrame) -> DataFrame:
    """lines: h, line. packed() rows."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            h = batch.column(0).to_numpy()
            if len(seen) > REMEMBERED:
                seen.clear()
            new = []
            for i, x in enumerate(h.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            for k in range(0, len(new), CHUNK):
                own = np.array(new[k : k + CHUNK])
                lines = batch.column(1).take(pa.array(own)).to_pylist()
                number, sign, part, at, total, edits = placed_by_size(lines)
                lane = lanes(sign, _indexed(lines, number, part, at, total, edits), int(h[own[0]]))
                yield packed(sign, h[own][number], sketches(lines)[number], lane)

    return lines.mapInArrow(run, "bucket int, rows binary")


def _indexed(lines, number, part, at, total, edits) -> np.ndarray:
    """Which rows of placed() are segments of the line itself."""
    size = np.array([len(x) for x in lines], np.int64)[number]
    out = np.zeros(len(number), bool)
    for e in (1, EDITS):
        starts = np.array([s for s, _ in segments(total, e)]) if len(total) else np.zeros((e + 1, 0), np.int64)
        own = (edits == e) & (total == size)
        out[own] = starts[part[own], np.flatnonzero(own)] == at[own]
    return out


def _shifted(key: np.ndarray, usable):
    """Pairs (i, i + s) of one group, for s = 1, 2, ... until usable(i, j), which tells which pairs still matter, has had all."""
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
    left = np.repeat(size, size)
    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    i = np.arange(len(key))
    s = 1
    while len(i):
        i = i[place[i] + s < left[i]]
        if len(i):
            usable(i, i + s)
        s += 1


def _grouped(batches, most: int, limit: int):
    """Tables of rows (sign, h, sketch, lane, path) clustered by sign and lane number, repeated rows as one: (table, group numbers, part of a large group).

    A table has about `most` rows: whole groups, or a part of one group of more than `limit` rows, which is never held whole.
    """

    def tidy(table: pa.Table) -> pa.Table:
        sign, h, lane = (table.column(c).to_numpy() for c in ("sign", "h", "lane"))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (h[1:] != h[:-1]) | (lane[1:] >> 2 != lane[:-1] >> 2)
        if table.column("path").null_count < len(h):
            path = table.column("path").to_pylist()
            fresh[1:] |= np.array([a != b for a, b in zip(path[1:], path)], bool)
        lane = np.bitwise_or.reduceat(lane, np.flatnonzero(fresh))
        return table.filter(pa.array(fresh)).set_column(3, table.schema.field(3), pa.array(lane, pa.int32()))

    def numbers(table: pa.Table) -> np.ndarray:
        sign, lane = table.column("sign").to_numpy(), table.column("lane").to_numpy() >> 2
        return np.concatenate([[0], np.cumsum((sign[1:] != sign[:-1]) | (lane[1:] != lane[:-1]))]) if len(sign) else np.zeros(0, np.int64)

    def key(table: pa.Table, i: int) -> tuple:
        return table.column("sign")[i].as_py(), table.column("lane")[i].as_py() >> 2

    held, rows, large = [], 0, None
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
        if not rows:
            continue
        table = tidy(pa.Table.from_batches(held))
        group = numbers(table)
        if large is not None:
            end = int(np.searchsorted(group, 0, "right")) if key(table, 0) == large else 0
            if end:
                yield table.slice(0, end), group[:end], True
                table, group = table.slice(end), group[end:]
            if len(group):
                large = None
        cut = len(group) if batch is None or not len(group) else int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut), group[:cut], False
        held, rows = [], 0
        if cut < len(group):
            tail = table.slice(cut)
            if len(group) - cut > limit:
                large = key(tail, 0)
                yield tail, group[cut:], True
            else:
                held, rows = tail.to_batches(), len(group) - cut


def _likely(signs: DataFrame) -> DataFrame:
    """(sign, h, hot, path): hot rows of groups to be dealt again; else lines that have a partner in their group whose sketch allows the edits."""
    limit, whole = GROUP, "path" not in signs.columns

    def run(batches):
        for table, group, large in _grouped(unpacked(batches) if whole else batches, ROWS, limit):
            sign, h, sketch, lane = (table.column(c).to_numpy() for c in ("sign", "h", "sketch", "lane"))
            marked = np.zeros(len(h), bool)
            hot = np.ones(len(h), bool)
            if not large:
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                size = np.diff(np.append(first, len(group)))
                have = np.bitwise_or.reduceat(lane, first)
                hot = np.repeat((size > limit) | (have > 1), size)
                some = np.flatnonzero(~hot & np.repeat((size > 1) & (have & 1 == 1), size))

                def mark(i, j):
                    i, j = some[i], some[j]
                    on = ~(marked[i] & marked[j]) & (((lane[i] | lane[j]) & 1) == 1)
                    i, j = i[on], j[on]
                    good = alike(sketch[i], sketch[j], allowed(sign[i]))
                    marked[i[good]] = marked[j[good]] = True

                _shifted(group[some], mark)
            out = marked | hot
            yield pa.record_batch([pa.array(sign[out]), pa.array(h[out]), pa.array(hot[out]), table.column("path").filter(pa.array(out)).combine_chunks()], ["sign", "h", "hot", "path"])

    lane = F.shiftright("lane", 2)
    if whole:
        dealt = signs.repartition("bucket").sortWithinPartitions("bucket")
    else:
        dealt = signs.select("sign", "h", "sketch", "lane", "path").repartition("sign", lane).sortWithinPartitions("sign", lane, "h", "path")
    return dealt.mapInArrow(run, "sign bigint, h bigint, hot boolean, path binary")


# A path says how a line meets the others of its group, in bytes: the edits, the characters it has more than the indexed line, the segment that is
# equal and its shift (plus 8); then, each time the group was dealt again, the pieces that may differ and the shift between them.


def pieces(spans: list[tuple[int, int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    """(span number, start, end) of that many pieces of the open spans, of like lengths; they depend on the indexed line only."""
    share = [1] * len(spans)
    for _ in range(parts - len(spans)):
        share[max(range(len(spans)), key=lambda j: ((spans[j][1] - spans[j][0]) // share[j], -j))] += 1
    out = []
    for j, n in enumerate(share):
        u, size = spans[j][0], spans[j][1] - spans[j][0]
        for i in range(n):
            length = size // n + (i >= n - size % n)
            out.append((j, u, u + length))
            u += length
    return out


def left_open(spans: list[tuple[int, int, int, int]], cut: list[tuple[int, int, int]], differ: tuple[int, ...], shift: int) -> list[tuple[int, int, int, int]]:
    """The spans that stay open if only those pieces may differ; shift: of what stands between two of them in one span."""
    i, j = differ[0], differ[-1]
    (p, x, y), (q, z, w) = cut[i], cut[j]
    if i == j or p == q and j == i + 1:
        return [(x, w, spans[p][2], spans[p][3])]
    if p == q:
        return [(x, y, spans[p][2], shift), (z, w, shift, spans[p][3])]
    return [(x, y, *spans[p][2:]), (z, w, *spans[q][2:])]


def opened(size: int, path: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The edits, and the open spans (start and end in the indexed line; the shift of the line at either end)."""
    edits, more, part, shift = path[:4]
    total = size - more
    _, x, y = pieces([(0, total, 0, 0)], edits + 1)[part]
    spans = [(0, x, 0, shift - 8), (y, total, shift - 8, more)]
    for k in range(4, len(path), edits + 1):
        spans = left_open(spans, pieces(spans, PIECES), tuple(path[k : k + edits]), path[k + edits] - 8)
    return edits, spans


def dealt_again(sign: int, line: str, path: bytes) -> list[tuple[int, bytes, bool]]:
    """(signature, path, indexed) for each choice of as many pieces of what is open as there are edits, the others being equal; none if so
    little is open that edits are enumerated."""
    edits, spans = opened(len(line), path)
    if sum(v - u for u, v, _, _ in spans) <= OPEN[edits]:
        return []
    still = not path[1] and path[3] == 8 and all(path[k + edits] == 8 for k in range(4, len(path), edits + 1))
    cut = pieces(spans, PIECES)
    out = []
    for differ in combinations(range(len(cut)), edits):
        own = [cut[i][0] for i in differ]
        if any(a != b for j, (_, _, a, b) in enumerate(spans) if j not in own):
            continue  # a span that keeps its edits must have one
        between = edits == 2 and own[0] == own[1] and differ[1] > differ[0] + 1
        for s in range(-edits, edits + 1) if between else (0,):
            left = left_open(spans, cut, differ, s)
            if sum(abs(b - a) for _, _, a, b in left) > edits or any(v + b < u + a for u, v, a, b in left):
                continue
            known = []
            for i, (j, x, y) in enumerate(cut):
                if i not in differ:
                    before = own[0] == j and differ[0] < i, own[-1] == j and differ[-1] < i
                    at = spans[j][3] if before[1] or before[0] and own[-1] != j else s if before[0] else spans[j][2]
                    known.append(line[x + at : y + at] if 0 <= x + at and y + at <= len(line) else None)
            if None not in known:
                h = xxhash.xxh64_intdigest("\0".join([f"{sign}:{differ}", *known]).encode("utf-8", "surrogatepass")) & ~1 | (edits < EDITS)
                out.append((h - (1 << 64) if h >> 63 else h, path + bytes((*differ, s + 8)), still and s == 0))
    return out


def variants(line: str, edits: int, spots: list[int]) -> dict[bytes, bool]:
    """Digests of what is left of the line by the edits at those places; True where a line is near all others that have the digest too.

    Lines within the edits of each other have a digest in common that one of them, at least, has with True.
    """
    out: dict[bytes, bool] = {}

    def add(center: bool, *what) -> None:
        key = xxhash.xxh128_digest(":".join(map(str, (edits, *what))).encode("utf-8", "surrogatepass"))
        out[key] = out.get(key, False) or center

    without = {p: line[:p] + line[p + 1 :] for p in spots}
    if edits == 1:
        for p in spots:
            add(True, "one replaced", p, without[p])
            add(False, "one dropped", without[p])
        add(True, "one dropped", line)
        return out
    for own in combinations(spots, min(2, len(spots))):
        rest = line
        for p in reversed(own):
            rest = rest[:p] + rest[p + 1 :]
        add(True, "two replaced", *own, rest)
        if len(own) == 2:
            add(False, "two dropped", rest)
    add(True, "two dropped", line)
    add(True, "one dropped of either", line)
    for p in spots:
        add(True, "one dropped of either", without[p])
        add(True, "one replaced, one dropped", p, without[p])
        for q in spots:
            if q != p:
                at = q - (q > p)  # in the shorter line
                add(False, "one replaced, one dropped", at, without[p][:at] + without[p][at + 1 :])
    return out


LEVEL = "sign bigint, h bigint, sketch bigint, lane int, path binary"


def _level_batch(h: np.ndarray, lines: list[str], given: list[list[tuple[int, bytes]]]) -> pa.RecordBatch:
    """Rows of the next level, of lines with their (signature, path); a row without a signature is a path whose edits are to be enumerated."""
    number, sign, path, indexed, done = [], [], [], [], []
    for i, (line, own) in enumerate(zip(lines, given)):
        for s, p in own:
            new = dealt_again(s, line, p)
            for s2, p2, flag in new or [(0, p, False)]:
                number.append(i)
                sign.append(s2)
                path.append(p2)
                indexed.append(flag)
                done.append(not new)
    number, sign, done = np.array(number, np.int64), np.array(sign, np.int64), np.array(done, bool)
    lane = np.full(len(number), -1, np.int32)
    lane[~done] = lanes(sign[~done], np.array(indexed, bool)[~done], int(h[0]))
    return pa.record_batch([pa.array(sign), pa.array(h[number]), pa.array(sketches(lines)[number]), pa.array(lane), pa.array(path, pa.binary())], ["sign", "h", "sketch", "lane", "path"])


def _first_level(rows: DataFrame) -> DataFrame:
    """rows: h, line, signs (its signatures that are hot)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                h, lines, signs = batch.column(0).slice(k, CHUNK).to_numpy(), batch.column(1).slice(k, CHUNK).to_pylist(), batch.column(2).slice(k, CHUNK).to_pylist()
                hot = [set(x) for x in signs]
                given: list[list[tuple[int, bytes]]] = [[] for _ in lines]
                number, sign, part, at, total, edits = (x.tolist() for x in placed_by_size(lines))
                for i, s, p, a, n, e in zip(number, sign, part, at, total, edits):
                    if s in hot[i]:
                        start = pieces([(0, n, 0, 0)], e + 1)[p][1]
                        given[i].append((s, bytes((e, len(lines[i]) - n, p, a - start + 8))))
                if lines:
                    yield _level_batch(h, lines, given)

    return rows.select("h", "line", "signs").mapInArrow(run, LEVEL)


def _next_level(rows: DataFrame) -> DataFrame:
    """rows: h, line, sign, path."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                h, lines, sign, path = (batch.column(c).slice(k, CHUNK) for c in range(4))
                yield _level_batch(h.to_numpy(), lines.to_pylist(), [[x] for x in zip(sign.to_pylist(), path.to_pylist())])

    return rows.select("h", "line", "sign", "path").mapInArrow(run, LEVEL)


def _enumerated(rows: DataFrame) -> DataFrame:
    """rows: h, g, line, paths. (ah, ag, bh, bg): each line and the least center of each of its variants."""

    def run(batches):
        for batch in batches:
            h, g, lines, paths = (c.to_pylist() for c in batch.columns)
            for i in range(len(h)):
                spots: dict[tuple, int] = {}
                for path in paths[i]:
                    edits, spans = opened(len(lines[i]), path)
                    spots[tuple(p for u, v, a, b in spans for p in range(u + a, v + b))] = edits
                found: dict[bytes, bool] = {}
                for own, edits in spots.items():
                    for key, center in variants(lines[i], edits, list(own)).items():
                        found[key] = found.get(key, False) or center
                n = len(found)
                yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([h[i]] * n, pa.int64()), pa.array([g[i]] * n, pa.int32()), pa.array(list(found.values()), pa.bool_())], ["v", "h", "g", "center"])

    each = rows.select("h", "g", "line", "paths").mapInArrow(run, "v binary, h bigint, g int, center boolean").select("v", node("h", "g").alias("n"), "center", "h", "g")
    hubs = each.groupBy("v").agg(F.min(F.when(F.col("center"), F.col("n"))).alias("hub"), F.count("*").alias("m")).filter("m > 1 AND hub IS NOT NULL")
    return each.join(hubs, "v").filter("n != hub").select(F.col("n").alias("a"), F.col("hub").alias("b")).distinct()


def _links(members: DataFrame) -> DataFrame:
    """members: sign, h, g, line. (a, b): links that give the components of all near pairs of each group."""

    def run(batches):
        for table in whole_groups(batches, ROWS):
            sign, h, g = (table.column(c).to_numpy() for c in range(3))
            order = np.lexsort((g, h))
            fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
            code = np.zeros(len(h), np.int64)
            code[order] = np.cumsum(fresh) - 1
            where = order[fresh]
            lines = table.column(3).take(pa.array(where)).to_pylist()
            sketch = np.concatenate([sketches(lines[k : k + CHUNK]) for k in range(0, len(lines), CHUNK)])
            up = np.arange(len(lines))
            out: list[tuple[int, int]] = []

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            def link(i, j):
                a, b, edits = code[i], code[j], allowed(sign[i])
                on = up[a] != up[b]
                a, b, edits = a[on], b[on], edits[on]
                on = alike(sketch[a], sketch[b], edits)
                if not on.any():
                    return
                pair = np.unique((np.minimum(a, b)[on] * len(lines) + np.maximum(a, b)[on]) * (EDITS + 1) + edits[on])
                pair, edits = pair // (EDITS + 1), pair % (EDITS + 1)
                a, b = pair // len(lines), pair % len(lines)
                good = within(lines, a, b, edits)
                for x, y in zip(a[good].tolist(), b[good].tolist()):
                    s, t = find(x), find(y)
                    if s != t:
                        up[max(s, t)] = min(s, t)
                        out.append((x, y))
                up[:] = [find(x) for x in range(len(up))] if good.any() else up

            _shifted(sign, link)
            a, b = (where[x] for x in np.array(out, np.int64).reshape(-1, 2).T)
            yield pa.record_batch([pa.array(x) for x in (h[a], g[a], h[b], g[b])], ["ah", "ag", "bh", "bg"])

    found = members.repartition("sign").sortWithinPartitions("sign", "h", "g").mapInArrow(run, "ah bigint, ag int, bh bigint, bg int")
    return found.select(node("ah", "ag").alias("a"), node("bh", "bg").alias("b"))


def node(h: str, g: str) -> Column:
    """One number for a line's two hashes."""
    return (F.col(h).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col(g).cast("decimal(10,0)")).cast("decimal(38,0)")


def near_links(texts: DataFrame) -> DataFrame:
    """texts: h, g, line. (a, b): links between nodes that give the classes of all near lines."""
    likely = cut(_likely(_signature_rows(texts.select("h", "line"))).distinct())
    need = likely.select("h").distinct()
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    held = stored(texts.join(need, "h", "left_semi").groupBy("h", "g").agg(F.first("line").alias("line")), "held")
    small, hot = likely.filter("NOT hot").select("sign", "h"), likely.filter("hot").select("h", "sign")
    links, open_paths, level = None, [], None
    if not hot.isEmpty():
        level = _first_level(held.join(hot.groupBy("h").agg(F.collect_set("sign").alias("signs")), "h"))
    while level is not None:
        level = cut(level.distinct())
        open_paths.append(level.filter("lane < 0").select("h", "path"))
        found = cut(_likely(level.filter("lane >= 0")))
        small = small.union(found.filter("NOT hot").select("sign", "h"))
        hot = found.filter("hot").select("h", "sign", "path")
        level = None if hot.isEmpty() else _next_level(held.join(hot, "h"))
    links = _links(small.distinct().join(held, "h").select("sign", "h", "g", "line"))
    for paths in open_paths:
        links = links.union(_enumerated(held.join(paths.groupBy("h").agg(F.collect_set("path").alias("paths")), "h")))
    return links


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All columns as _0, _1, ... (so no name clashes), with row and tag (which tell documents apart) and text."""
    return docs.select(*identity(docs, key, text), whole_text(text).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("all"))


def _lines(base: DataFrame, minimum: int, *more: Column) -> DataFrame:
    each = base.select("row", "tag", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.btrim("line", F.lit(" \t\r\x0b\x0c"))
    some = each.select("row", "tag", "at", line.alias("line")).filter(F.char_length("line") >= minimum).filter((F.char_length("line") >= MINIMUM) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    return some.select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "row", "tag", "at", *more)


def line_classes(base: DataFrame, minimum: int = MINIMUM) -> tuple[DataFrame, DataFrame]:
    """(lines: h, g, row, tag, at of every line; classes: h, g, class and the class's first line) - the latter for lines that have others."""
    lines = stored(_lines(base, minimum), "lines")
    texts = _lines(base, MINIMUM, F.col("line")).select("h", "g", "line")
    roots = components(near_links(texts))
    known = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("row", "tag", "at")).alias("first")).withColumn("own", node("h", "g"))
    placed_lines = known.join(roots, F.col("own") == F.col("node"), "left").select("h", "g", "n", "first", F.coalesce("root", "own").alias("class"))
    whole = placed_lines.groupBy("class").agg(F.sum("n").alias("size"), F.min("first").alias("first")).filter("size > 1")
    return lines, placed_lines.select("h", "g", "class").join(whole, "class").select("h", "g", "class", "first")


def removals(base: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """(row, tag, gone array<int>): positions of the lines that go, of documents that lose some."""
    lines, classes = line_classes(base, minimum)
    here = F.struct("row", "tag", "at")
    gone = lines.join(classes, ["h", "g"]).filter(here != F.col("first")).select("row", "tag", "at")
    return gone.groupBy("row", "tag").agg(F.collect_set("at").alias("gone"))


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", minimum: int = MINIMUM) -> DataFrame:
    """minimum: characters of a line that can go. all (struct of the input's columns), kept (text that stays), n_lines, n_removed."""
    base = _documents(docs, key, text)
    joined = base.join(removals(base.select("row", "tag", "text"), minimum), ["row", "tag"], "left")
    parts = F.split("text", "\n")

    def without(p: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n")

    # A text is split once, not once a line.
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(parts), without)[0])
    return joined.select("all", kept.alias("kept"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", minimum: int = MINIMUM) -> DataFrame:
    """docs with their texts cut (n_chars, if there, as well); documents that lose all their words are left out."""
    out = kept_lines(docs, key, text, minimum).filter("n_removed = 0 OR kept RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = F.col("n_removed") > 0
    cols = []
    for i, c in enumerate(docs.columns):
        old = F.col(f"all._{i}")
        new = F.when(changed, F.col("kept")).otherwise(old) if c == text else F.when(changed, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old
        cols.append(new.alias(c))
    return out.select(*cols)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kept_lines(docs.select("doc_id", "text"), minimum=1).select(F.col("all._0").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
