"""SimHash near-duplicates through BK-trees of shards.

Every text becomes a bit code; equal codes are one node. The nodes are dealt to shards so that any two within
the radius meet in one: with radius r, the 64 bits are cut into r + 1 bands, and codes within r bits agree on
a band at least. A shard's BK-tree is what all its members search. Whole trees are not sent to every executor,
as that would compare every code with every other: a tree goes to the queries that share a band with it. A shard over
SHARD members is dealt again by bands of its remaining bits, so shards stay bounded and no link is lost.
A shard returns one edge a member, to the least member linked with it; components() joins the shards.

near_copies() finds texts by the similarity of their shingles. Its codes are longer and differ in many bits, so bands would not deal them; shards are the
texts that share one of their rarest shingles. Each shard's BK-tree gives the candidates, whose sets of shingles decide.

Defined cases: null and empty texts have the code zero and are linked like any other; rows that share an id count
as one document; rows with a null id get a component of null if linked with no other id; an empty
table gives an empty table; columns other than the id and the text are ignored by fingerprints().
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bktree import Forest
from gridloom.llm.common import chunks, cut, identity, shared, stored, whole_groups, whole_text
from gridloom.llm.components import components
from gridloom.llm.rolling import mix

#: Members of a shard beyond which it is dealt again.
SHARD = 4096
#: Members of the shards that a worker searches together.
FOREST = 32768
SEED = 42


def codes(texts: list[str], shingle: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """(n, words) uint64: the SimHash of each text's word shingles, 64 bits of XXH64, then 64 of each further mix of it."""
    out = np.zeros((len(texts), words), np.uint64)
    for a, b in chunks([len(t) for t in texts], 1_000_000):
        shingles, n = [], np.zeros(b - a, np.int64)
        for i in range(a, b):
            w = texts[i].encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
            own = [b" ".join(x) for x in zip(*(w[k:] for k in range(shingle)))] if len(w) >= shingle else [b" ".join(w)] if w else []
            own = list(dict.fromkeys(own)) if distinct else own
            n[i - a] = len(own)
            shingles += own
        some = np.flatnonzero(n)
        if not len(some):
            continue
        starts = (np.cumsum(n) - n)[some]
        first = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles))
        for k in range(words):
            h = mix(first + np.uint64(k)) if k else first
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")
            out[a + some, k] = packed.reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp bigint): the 64-bit code of every row."""

    def run(batches):
        for batch in batches:
            fp = codes(batch.column(1).to_pylist(), shingle)[:, 0].view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint").withColumnRenamed("key", key)


def _bands(free: int, parts: int) -> list[int]:
    """Cuts the set bits of a mask into as many contiguous masks."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(nodes: DataFrame, radius: int, most: int = SHARD) -> DataFrame:
    """(shard, fp): every two codes (column fp, distinct) within the radius share a shard; shards have `most` members at most."""

    def dealt(rows: DataFrame, masks: list[int], level: int) -> DataFrame:
        """rows: (path, fp); masks: radius + 1 for each path, of the bits that name a shard. Levels have shards of their own."""
        each = F.array(*[F.lit(_signed(m)) for m in masks])
        out = rows.select("fp", F.explode(F.sequence(F.col("path") * (radius + 1), F.col("path") * (radius + 1) + radius)).alias("path"))
        return out.select("path", F.xxhash64(F.lit(level), "path", F.col("fp").bitwiseAND(F.get(each, F.col("path")))).alias("shard"), "fp")

    masks = _bands((1 << 64) - 1, radius + 1)
    rows, done = dealt(nodes.select("fp", F.lit(0).alias("path")), masks, 0), []
    for level in range(1, 65):
        hot = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("shard"))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "shard", "left_anti").select("shard", "fp"))
        masks = [m | band for m in masks for band in _bands(((1 << 64) - 1) & ~m, radius + 1)]
        rows = dealt(rows.join(hot, "shard", "left_semi"), masks, level)
    out = rows.select("shard", "fp")
    for x in done:
        out = out.union(x)
    return out


def _linked_in_shards(radius: int):
    """mapInArrow over rows clustered by shard: (a, b) with b the least code linked with a in a shard."""

    def search(shard, fp):
        many = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        size = np.diff(many)
        on = np.repeat(size > 1, size)
        shard, fp = shard[on], fp[on]
        label = Forest(fp.view(np.uint64)[:, None], shard).linked(radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    def run(batches):
        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(shard) >= FOREST:
                differ = np.flatnonzero(shard != shard[-1])
                end = int(differ[-1]) + 1 if len(differ) else 0
                if end:
                    yield search(shard[:end], fp[:end])
                    shard, fp = shard[end:], fp[end:]
        if len(shard):
            yield search(shard, fp)

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) whose components are those of all pairs of codes (column fp, distinct) within the radius."""
    if radius == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    dealt = shards(nodes, radius)
    clustered = dealt.repartition("shard").sortWithinPartitions("shard", "fp")
    return clustered.mapInArrow(_linked_in_shards(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component): component is the least key reachable over links of at most `radius` bits."""
    prints = stored(fingerprints(docs, key, text, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(placed.join(named, "root").select("fp", "component"), "fp").select(key, "fp", "component")


#: For near_copies(): words of a shingle; texts link at Jaccard similarity 4/5 or more of their sets of shingles.
SHINGLE = 5
#: One document in SAMPLE is counted to find frequent shingles: those in FREQUENT of them, the HOT most frequent at most.
SAMPLE, FREQUENT, HOT = 16, 6, 200_000
#: 64-bit words of a set's SimHash, and the bits that candidates differ in at most. Sets of similarity 4/5 differ in 39 of 256 bits on average, with a
#: standard deviation of 6 (sets of 4 and 5 shingles in 48), so a link is missed once in 5 million at worst.
WORDS, RADIUS = 4, 80
#: Rows of sets handled together; shingles of them held as Python sets at once.
SETS, HELD = 4096, 500_000
#: Bytes of texts whose sets are made at once, and words whose hashes are remembered.
PART, REMEMBERED = 2_000_000, 250_000
#: Documents with a possible partner up to which their names are broadcast rather than shuffled.
BROADCAST_ROWS = 1_000_000


def _parts(batches):
    """Slices of batches whose last column, the text, has PART bytes at most (or one longer row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
        for a, b in chunks(sizes, PART):
            yield batch.slice(a, b - a)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's five-word shingles; a shorter text is one shingle, an empty one has none."""
    words: dict[bytes, int] = {}
    out: list[np.ndarray] = []
    for a, b in chunks([len(t) for t in texts], 1_000_000):
        hashes, n = [], []
        for i in range(a, b):
            own = texts[i].encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
            n.append(len(own))
            for w in own:
                h = words.get(w)
                if h is None:
                    h = words[w] = xxhash.xxh64_intdigest(w, SEED)
                hashes.append(h)
        if len(words) > REMEMBERED:
            words.clear()
        word = np.array(hashes, np.uint64)
        rolled = word.copy()
        for k in range(1, SHINGLE):  # rolled[i]: words i to i + k
            rolled = mix(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:]) if len(rolled) else rolled
        at = 0
        for size in n:
            if size >= SHINGLE:
                out.append(np.unique(rolled[at : at + size - SHINGLE + 1]))
            elif size:
                h = np.full(1, size, np.uint64)
                for k in range(size):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[at + k])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
    return out


def _frequent(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, class) of frequent shingles, ascending. It sets the order of prefixes, so it bears on cost and not on results."""

    def run(batches):
        for batch in _parts(batches):
            sets = shingle_sets(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["s"])

    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(whole_text(text).alias("text")).distinct()
    counts = some.mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "s").limit(HOT).toPandas()
    shingle, level = rows["s"].to_numpy(np.int64).view(np.uint64), np.log2(rows["n"].to_numpy(np.float64)).astype(np.int64) + 1
    order = np.argsort(shingle)
    return shingle[order], level[order]


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n // 5 + 1 of a set of n, by ascending frequency, then hash: sets of similarity 4/5 share one of these."""
    if len(frequent[0]) and len(s):
        i = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
        level = np.where(frequent[0][i] == s, frequent[1][i], 0)
        s = s[np.argsort(level, kind="stable")]
    return s[: len(s) // 5 + 1]


def set_codes(sets: list[np.ndarray]) -> np.ndarray:
    """(n, WORDS) uint64: the SimHash of each set of shingles; zero for an empty one."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    for a, b in chunks([len(s) for s in sets], 500_000):
        n = np.array([len(s) for s in sets[a:b]], np.int64)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        every, starts = np.concatenate(sets[a:b]), (np.cumsum(n) - n)[some]
        for k in range(WORDS):
            bits = np.unpackbits(mix(every + np.uint64(k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[a + some, k] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def _copy_prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, tag, id and more (96 bits of a hash of the set), n (its size), prefix, code."""
    index = shared(docs.sparkSession, _frequent(docs, key, text))

    def run(batches):
        frequent = index()
        for batch in _parts(batches):
            sets = shingle_sets(batch.column(2).to_pylist())
            raw = [s.tobytes() for s in sets]
            ids = np.array([xxhash.xxh64_intdigest(x, SEED) for x in raw], np.uint64).view(np.int64)
            more = np.array([xxhash.xxh32_intdigest(x, SEED) for x in raw], np.uint32).view(np.int32)
            prefix = pa.array([_prefix(s, frequent).tobytes() for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int32())
            code = pa.array([c.tobytes() for c in set_codes(sets)], pa.binary())
            yield pa.record_batch([*batch.columns[:2], pa.array(ids), pa.array(more), n, prefix, code], ["row", "tag", "id", "more", "n", "prefix", "code"])

    rows = docs.select(*identity(docs, key, text), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "row bigint, tag int, id bigint, more int, n int, prefix binary, code binary")


def _named(ids: np.ndarray, more: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A name for each group of members, so that equal groups are one shard."""
    return mix(np.add.reduceat(mix(ids.view(np.uint64) + more.astype(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)


def _dealt_copies(nodes: DataFrame, most: int) -> DataFrame:
    """(shard, id, more, n, large). Not large: shards of `most` members at most. Large: all members of a group over `most`, under one shard number.

    A shard is the members of one shingle's group whose sizes are comparable. Of a group over `most`, in order of size, each two neighbouring
    blocks of half as many are a shard. Rows are read in one pass, and no group is held whole.
    """
    step = max(1, most // 2)

    def rows(batches):
        for batch in batches:
            prefix = batch.column(3).to_pylist()
            k = np.array([len(p) // 8 for p in prefix], np.int64)
            own = np.repeat(np.arange(len(k)), k)
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(prefix), np.int64)), *(batch.column(i).take(pa.array(own)) for i in range(3))], ["s", "id", "more", "n"])

    def deal(batches):
        held, count, opened = [], 0, False  # opened: what is held begins with the last block of a large group

        def parts(s, ids, more, n, first, end, opened):
            size = end - first
            s, ids, more, n = (c[: int(end[-1])] for c in (s, ids, more, n))
            small = (size > 1) & (size <= most)
            small[0] &= not opened
            if small.any():
                name = _named(ids, more, first, size)
                on = np.repeat(small, size)
                yield np.repeat(name[small], size[small]), ids[on], more[on], n[on], False
            for g in np.flatnonzero((size > most) | (opened & (np.arange(len(size)) == 0))).tolist():
                a, b = int(first[g]), int(end[g])
                for at in range(a, b, step):
                    if at + step < b:
                        own = slice(at, min(at + 2 * step, b))
                        name = mix(mix(ids[at : at + 1].view(np.uint64)) ^ s[at : at + 1].view(np.uint64)).view(np.int64)
                        yield np.repeat(name, len(ids[own])), ids[own], more[own], n[own], False
                yield s[a:b], ids[a:b], more[a:b], n[a:b], True

        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                count += batch.num_rows
                if count < FOREST:
                    continue
            if not count:
                continue
            table = pa.Table.from_batches(held)
            s, ids, more, n = (c.to_numpy() for c in table.columns)
            wide = n.astype(np.int64)
            near = (s[1:] == s[:-1]) & (4 * wide[1:] <= 5 * wide[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~near]))
            end = np.append(first[1:], len(s))
            keep = len(s)  # rows from here on wait for the next batch
            lasting = batch is not None
            if lasting:
                size, still = int(end[-1] - first[-1]), opened and len(first) == 1
                if size > 4 * most or still and size > 2 * step:
                    keep = int(first[-1]) + (size // step - 1) * step
                    end[-1] = keep + step
                else:
                    keep = int(first[-1])
                    first, end = first[:-1], end[:-1]
            if len(first):
                for shard, *cols, large in parts(s, ids, more, n, first, end, opened):
                    yield pa.record_batch([pa.array(shard), *map(pa.array, cols), pa.array(np.full(len(shard), large))], ["shard", "id", "more", "n", "large"])
                opened = lasting and len(end) > 0 and int(end[-1]) > keep
            tail = table.slice(keep)
            held, count = tail.to_batches(), tail.num_rows

    each = nodes.select("id", "more", "n", "prefix").mapInArrow(rows, "s bigint, id bigint, more int, n int")
    return each.repartition("s").sortWithinPartitions("s", "n", "id", "more").mapInArrow(deal, "shard bigint, id bigint, more int, n int, large boolean").distinct()


def _copy_shards(nodes: DataFrame, most: int) -> DataFrame:
    """(shard, id, more): the shards of _dealt_copies()."""
    return _dealt_copies(nodes, most).filter("NOT large").select("shard", "id", "more")


def _candidates(table: pa.Table):
    """Yields arrays of pairs of rows (shard, id, more, n, part, code) of one shard that the BK-trees find near, of different parts and comparable sizes."""
    shard, n, part = table.column("shard").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("part").to_numpy()
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(-1, WORDS)
    for a, b in Forest(code, shard).search(RADIUS):
        on = (a < b) & (part[a] != part[b]) & (4 * np.maximum(n[a], n[b]) <= 5 * np.minimum(n[a], n[b]))
        if on.any():
            yield a[on], b[on]


def _near_edges(batches):
    """(ah, ag, bh, bg): links that give the components of all candidate pairs of each shard."""
    for table in whole_groups(batches, FOREST):
        up = np.arange(table.num_rows)
        ends = [np.zeros((2, 0), np.int64)]
        for a, b in _candidates(table):
            on = up[a] != up[b]
            while on.any():  # each round hooks every root to its least neighbour, and notes that edge
                p, q = np.minimum(up[a[on]], up[b[on]]), np.maximum(up[a[on]], up[b[on]])
                order = np.lexsort((p, q))
                top = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])]
                ends.append(np.stack([a[on][top], b[on][top]]))
                up[q[top]] = p[top]
                while (up[up] != up).any():
                    up = up[up]
                on = up[a] != up[b]
        a, b = np.concatenate(ends, axis=1)
        ids, more = table.column("id").to_numpy(), table.column("more").to_numpy()
        yield pa.record_batch([pa.array(x) for x in (ids[a], more[a], ids[b], more[b])], ["ah", "ag", "bh", "bg"])


def _copy_links(batches):
    """(ah, ag, bh, bg): links that give the components of all similar pairs of each shard; rows have their sets of shingles."""
    for table in whole_groups(batches, SETS):
        ids, more = table.column("id").to_numpy(), table.column("more").to_numpy()
        order = np.lexsort((more, ids))
        fresh = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (more[order][1:] != more[order][:-1])])
        code = np.zeros(len(ids), np.int64)
        code[order] = np.cumsum(fresh) - 1
        where = order[fresh]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").take(pa.array(where)).to_pylist()]
        members: dict[int, frozenset] = {}
        held = 0
        up = np.arange(len(sets))
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def member(x: int) -> frozenset:
            nonlocal held
            if x not in members:
                if held > HELD:
                    members.clear()
                    held = 0
                members[x] = frozenset(sets[x].tolist())
                held += len(sets[x])
            return members[x]

        for i, j in _candidates(table):
            for k in range(0, len(i), 4096):
                a, b = code[i[k : k + 4096]], code[j[k : k + 4096]]
                on = up[a] != up[b]
                found = False
                for x, y in zip(a[on].tolist(), b[on].tolist()):
                    p, q = find(x), find(y)
                    if p != q and 9 * len(member(x) & member(y)) >= 4 * (len(sets[x]) + len(sets[y])):
                        up[max(p, q)] = min(p, q)
                        out.append((x, y))
                        found = True
                if found:
                    while (up[up] != up).any():
                        up[:] = up[up]
        a, b = (where[x] for x in np.array(out, np.int64).reshape(-1, 2).T)
        yield pa.record_batch([pa.array(x) for x in (ids[a], more[a], ids[b], more[b])], ["ah", "ag", "bh", "bg"])


def _with_sets(docs: DataFrame, key: str, text: str, need: DataFrame) -> DataFrame:
    """(id, more, shingles) of the documents (row, tag, id, more) that need names."""

    def run(batches):
        for batch in _parts(batches):
            sets = shingle_sets(batch.column(2).to_pylist())
            yield pa.record_batch([*batch.columns[:2], pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "more", "shingles"])

    need = cut(need)
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    rows = docs.select(*identity(docs, key, text), whole_text(text).alias("text")).join(need, ["row", "tag"])
    return rows.select("id", "more", "text").dropDuplicates(["id", "more"]).mapInArrow(run, "id bigint, more int, shingles binary")


ID = ["id", "more"]


def node(h: str, g: str) -> Column:
    """One number for the two hashes of a set."""
    return (F.col(h).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col(g).cast("decimal(10,0)")).cast("decimal(38,0)")


def _shard_links(docs: DataFrame, key: str, text: str, dealt: DataFrame, nodes: DataFrame, leasts: DataFrame) -> DataFrame:
    """dealt: shard, id, more, part. (a, b): links of sets of different parts that share a shard and are similar.

    Candidates of all shards are joined to clusters first, so that a set goes to one place to be compared. A cluster of over SHARD sets
    is compared in the shards of its members.
    """
    ends = "ah bigint, ag int, bh bigint, bg int"
    edge = node("ah", "ag").alias("a"), node("bh", "bg").alias("b")
    known = nodes.select(*ID, "n", "code")
    near = dealt.join(known, ID).select("shard", *ID, "n", "part", "code").repartition("shard").sortWithinPartitions("shard", *ID).mapInArrow(_near_edges, ends).select(*edge)
    clusters = components(near)
    every = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    own = known.select(*ID, node(*ID).alias("node")).join(every.join(every.groupBy("root").agg(F.count("*").alias("m")), "root"), "node")
    own = cut(own.select(F.xxhash64("root").alias("shard"), *ID, "m"))
    likely = own.filter(F.col("m") <= SHARD).select("shard", *ID).union(dealt.join(own.filter(F.col("m") > SHARD).select(*ID), ID, "left_semi").select("shard", *ID))
    sets = _with_sets(docs, key, text, leasts.join(own.select(*ID), ID, "left_semi").select(*ID, "least.row", "least.tag"))
    held = likely.join(dealt.select(*ID, "part").distinct(), ID).join(known, ID).join(sets, ID).select("shard", *ID, "n", "part", "code", "shingles")
    found = held.repartition("shard").sortWithinPartitions("shard", *ID).mapInArrow(_copy_links, ends)
    return cut(found.select(*edge).distinct())


def _rest_of_large(large: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(shard, id, more, part): what neighbouring blocks of large groups have not compared, of members that are not linked yet.

    Members of a group's largest component need no comparing with each other. Each block of the others meets each block of all members, so
    work is the product of a group's size and the number of those outside that component; a group of copies has few.
    """
    own = large.withColumn("node", node("id", "more")).join(roots, "node", "left").select("shard", *ID, F.coalesce("root", "node").alias("root"))
    own = cut(own)
    by_root = own.groupBy("shard", "root").agg(F.count("*").alias("m"))
    sizes = by_root.groupBy("shard").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top")).select("shard", "n", (F.col("n") - F.col("top.m")).alias("rest"), F.col("top.root").alias("top")).filter("rest > 0")
    half = max(1, most // 2)
    rows = own.join(cut(sizes), "shard").withColumn("part", F.xxhash64("root"))
    rows = rows.withColumn("blocks", F.ceil(F.col("rest") / half).cast("int")).withColumn("chunks", F.ceil(F.col("n") / half).cast("int"))
    spread = F.xxhash64(F.lit(7), *ID)
    outer = rows.filter("root != top").select(*ID, "part", "shard", F.pmod(spread, "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    every = rows.select(*ID, "part", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(spread, "chunks").cast("int").alias("j"))
    return outer.union(every).select(F.xxhash64("shard", "i", "j").alias("shard"), *ID, "part").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, tag) of the documents that go: all but the first of each group of texts whose similarity is 0.8 or more.

    Similarity is the Jaccard similarity of the sets of five-word shingles (as 64-bit hashes). A prefix filter deals the shards and keeps similar texts together,
    BK-trees over SimHash codes find candidates, and each link is one whose sets were compared. Groups are the components of the links.
    """
    prints = stored(_copy_prints(docs, key, text), "copies")
    nodes = stored(prints.groupBy(*ID).agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("code").alias("code")), "sets")
    leasts = prints.groupBy(*ID).agg(F.min(F.struct("row", "tag")).alias("least"))
    dealt = cut(_dealt_copies(nodes, SHARD))
    links = _shard_links(docs, key, text, dealt.filter("NOT large").select("shard", *ID, F.xxhash64(*ID).alias("part")), nodes, leasts)
    roots = components(links)
    large = dealt.filter("large").select("shard", *ID)
    if not large.isEmpty():
        rest = cut(_rest_of_large(large, roots, SHARD))
        if not rest.isEmpty():
            roots = components(links.union(_shard_links(docs, key, text, rest, nodes, leasts)))
    placed = leasts.withColumn("node", node("id", "more")).join(roots, "node", "left").select(*ID, "least", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("first"))
    every = prints.select(*ID, "row", "tag").join(placed.join(named, "root").select(*ID, "first"), ID)
    return every.filter(F.struct("row", "tag") != F.col("first")).select("row", "tag").distinct()


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_copies() leaves, with all their columns."""
    every = docs.select(*identity(docs, key, text), F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("all"))
    left = every.join(near_copies(docs, key, text), ["row", "tag"], "left_anti")
    return left.select(*[F.col(f"all._{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
