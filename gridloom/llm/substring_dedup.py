"""Removes every byte covered by a LENGTH-byte string that also starts elsewhere.

Equal strings have equal anchors: in a string of LENGTH bytes, the ANCHOR-byte gram of least hash. Every text gives its anchors;
those whose hash occurs once can be in no repeated string. An anchor's context is all bytes that a string around
it can reach. Occurrences with equal contexts prove each other. The different contexts of one anchor are sorted
together, as one suffix array over the group (the anchor, which all contexts have, is one symbol with what follows it):
neighbours in that order whose LENGTH bytes are equal are repeated strings. Spans go back to their texts, where they are joined
and cut out.

A suffix array sorts GROUP contexts at most. In a larger group the strings are dealt by where they start: those that take over half of the
bytes to the left share that half of the left side, the others share half of the right side. So each half is a set of smaller groups of more
similar contexts, and so on until a group is small or its strings have one start, where contexts are equal or apart.

Texts are shuffled by row, anchors by hash; nothing is collected, and what one task sorts is bounded. An anchor is known by 64 bits of a hash,
its context by 96 more; the parts of a large group by their bytes.

Defined cases: null and empty texts have no bytes; repeated rows repeat each other's strings; texts shorter than LENGTH keep
all bytes; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, cut, identity, stored, whole_text
from gridloom.llm.rolling import Hashes, mix
from gridloom.llm.suffixes import suffix_array

LENGTH, ANCHOR = 200, 120
SIDE = LENGTH - ANCHOR  # bytes to each side of an anchor that a string can reach
#: Different contexts of an anchor that one suffix array sorts, at most.
GROUP = 400
#: Bytes hashed at once: few enough for the arrays to stay in a core's cache.
STEP_BYTES = 60_000
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
OTHER_BYTES = mix(np.arange(1001, 1257, dtype=np.uint64))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, position, hash, hash of the context, 32 more bits of it) of the anchors of all texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(data), SIDE + 1
    if n < LENGTH or not (sizes >= LENGTH).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    hashes = Hashes(BYTES[data])
    h = mix(hashes.all_of(ANCHOR)) | np.uint64(1)
    least = _sliding(h, width, np.minimum)  # of the string that starts here
    inside = np.zeros(len(least) + 1, np.int64)
    some = sizes >= LENGTH
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, (starts + sizes - LENGTH + 1)[some], -1)
    least[np.cumsum(inside)[:-1] == 0] = 0  # strings don't cross texts
    # An anchor is the least of a string around it: its hash is the greatest of those leasts.
    padded = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(h)] == h)
    text = np.searchsorted(starts, at, "right") - 1
    left = np.maximum(at - SIDE, starts[text])
    right = np.minimum(at + LENGTH, starts[text] + sizes[text])
    sides = ((at - left) * 1024 + (right - at)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    around = mix(hashes.of(left, right) + sides)
    more = mix(Hashes(OTHER_BYTES[data]).of(left, right) + sides) >> np.uint64(32)
    return text, at - starts[text], h[at].view(np.int64), around.view(np.int64), more.astype(np.uint32).view(np.int32)


def _most_shared(parts: list[bytes]) -> list[int]:
    """For each part the longest prefix that it has in common with another."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = min(len(parts[i]), len(parts[j]))
        differ = int.from_bytes(parts[i][:n]) ^ int.from_bytes(parts[j][:n])
        n -= (differ.bit_length() + 7) // 8
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated_starts(contexts: list[tuple[bytes, bytes, bool, tuple]]) -> list[list[int]]:
    """For each context (left and right of the anchor, whether it is proved, where it is - no two are at one place), the numbers of left bytes that
    a repeated string takes. Contexts that are proved are not reported, but repeat others.

    What all strings hold (`low` bytes to the left, and the anchor) is one symbol with the bytes to the right: their rank. So the text has a symbol
    for each start of a string. Contexts that are equal as far as strings reach are in the text once, and count as many.
    """
    found: list[list[int]] = [[] for _ in contexts]
    # No string reaches further than what a context has in common with another on either side.
    lefts, rights = _most_shared([c[0][::-1] for c in contexts]), _most_shared([c[1] for c in contexts])
    equal: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for c, (a, b) in enumerate(zip(lefts, rights)):
        if a + b >= SIDE:
            left, right = contexts[c][0], contexts[c][1]
            equal[left[len(left) - a :], right[:b]].append(c)
    kinds = list(equal)
    times = [2 if any(contexts[c][2] for c in own) else len(own) for own in equal.values()]  # proved ones repeat themselves
    if sum(times) < 2:
        return found
    low = max(0, SIDE - max(len(right) for _, right in kinds))
    tails = [left[len(left) - low :] + right for left, right in kinds]
    rank = {t: 258 + i for i, t in enumerate(sorted(set(tails)))}
    text: list[int] = []
    owner, taken = [], []
    for k, ((left, _), tail) in enumerate(zip(kinds, tails)):
        text += [b + 2 for b in left[: len(left) - low]]
        text.append(rank[tail])
        owner += [k] * (len(left) - low + 1)
        taken += range(len(left), low - 1, -1)
    text.append(0)
    order = suffix_array(text)
    starts: list[list[int]] = [[] for _ in kinds]
    run: list[int] = []
    string, count = (-1, b"", b""), 0
    for s in order[1:]:
        k, a = owner[s], taken[s]
        left, right = kinds[k]
        if not SIDE - len(right) <= a <= SIDE:
            continue  # no whole string starts here
        this = (a, left[len(left) - a :], right[: SIDE - a])
        if this != string:
            if count > 1:
                for r in run:
                    starts[r].append(string[0])
            run, string, count = [], this, 0
        run.append(k)
        count += times[k]
    if count > 1:
        for r in run:
            starts[r].append(string[0])
    for own, takes in zip(equal.values(), starts):
        for c in own:
            if not contexts[c][2]:
                found[c] = takes[:]
    return found


def _anchor_rows(base: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            rows, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for a, b in chunks([len(t) for t in texts], STEP_BYTES):
                text, at, h, around, more = anchors(texts[a:b])
                for own, x in zip(found, (h, around, more, rows[a + text], tags[a + text], at.astype(np.int32))):
                    own.append(x)
            if texts:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in found], ["h", "around", "more", "row", "tag", "at"])

    return base.mapInArrow(run, "h bigint, around bigint, more int, row bigint, tag int, at int")


def _context_rows(wanted: DataFrame) -> DataFrame:
    """wanted: row, tag, asked (h, at, proved), text; gives the bytes around each anchor."""

    def run(batches):
        for batch in batches:
            out = []
            for row, tag, asked, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                out += [(a["h"], a["proved"], row, tag, a["at"], data[max(a["at"] - SIDE, 0) : a["at"]], data[a["at"] + ANCHOR : a["at"] + LENGTH]) for a in asked]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["h", "proved", "row", "tag", "at", "before", "after"])

    return wanted.mapInArrow(run, "h bigint, proved boolean, row bigint, tag int, at int, before binary, after binary")


# A group: an anchor, the least and the most bytes that its strings take to the left, and the bytes that all of them have beside the anchor.
PLACE = ["h", "low", "high", "core"]


def _sorted_groups(contexts: DataFrame, most: int) -> DataFrame:
    """(row, tag, a, b): spans of repeated strings, from the suffix array of the contexts of each group of `most` at most (PLACE, before, after,
    proved and where). Larger groups are passed over, and never held."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def spans(group):
        if not 1 < len(group) <= most or all(c[6] for c in group):
            return
        known = [(c[4], c[5], c[6], ((c[7], c[8]), c[9])) for c in group]
        for c, starts in zip(known, repeated_starts(known)):
            (row, tag), at = c[3]
            starts.sort()
            k = 0
            while k < len(starts):  # runs of starts are one span
                j = k
                while j + 1 < len(starts) and starts[j + 1] == starts[j] + 1:
                    j += 1
                yield row, tag, at - starts[j], at - starts[k] + LENGTH
                k = j + 1

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out = []
            for c in zip(*(x.to_pylist() for x in batch.columns)):
                if group and group[0][:4] != c[:4]:
                    out += spans(group)
                    group = []
                if len(group) <= most:
                    group.append(c)
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["row", "tag", "a", "b"])
        out = list(spans(group))
        yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["row", "tag", "a", "b"])

    every = contexts.select(*PLACE, "before", "after", "proved", "row", "tag", "at")
    return every.repartition(*PLACE).sortWithinPartitions(*PLACE, "row", "tag", "at").mapInArrow(run, "row bigint, tag int, a int, b int")


def _halves(large: DataFrame) -> DataFrame:
    """The contexts of groups, once for the strings that take the most bytes to the left and once for the others; cut to what those strings reach."""
    middle = F.expr("(low + high) div 2").cast("int")
    ranges = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    each = large.select("h", "row", "tag", "at", "proved", "before", "after", F.explode(ranges).alias("r")).select("h", "r.low", "r.high", "row", "tag", "at", "proved", "before", "after")
    first, last = F.greatest("low", F.lit(SIDE) - F.length("after")), F.least("high", F.length("before"))
    cut_before, cut_after = F.expr("substring(before, -high, high)"), F.expr(f"substring(after, 1, {SIDE} - low)")
    core = F.concat(F.expr("substring(before, -low, low)"), F.expr(f"substring(after, 1, {SIDE} - high)"))
    return each.filter(first <= last).select("h", "low", "high", core.alias("core"), "row", "tag", "at", "proved", cut_before.alias("before"), cut_after.alias("after"))


def _group_spans(contexts: DataFrame, most: int) -> DataFrame:
    """(row, tag, a, b): spans of repeated strings; contexts: h, row, tag, at, proved, before, after - each different context of an anchor once."""
    level = contexts.select("h", F.lit(0).alias("low"), F.lit(SIDE).alias("high"), F.lit(b"").alias("core"), "row", "tag", "at", "proved", "before", "after")
    found = None
    while True:
        sizes = level.groupBy(*PLACE).agg(F.count("*").alias("n"), F.bool_and("proved").alias("all"))
        hot = cut(sizes.filter((F.col("n") > most) & ~F.col("all") & (F.col("low") < F.col("high"))).select(*PLACE))
        last = hot.isEmpty()
        small = _sorted_groups(level if last else level.join(hot, PLACE, "left_anti"), most)
        found = small if found is None else found.union(small)
        if last:
            return found
        rows = stored(_halves(level.join(hot, PLACE, "left_semi")), "halves")
        same = [*PLACE, "before", "after"]
        kinds = rows.groupBy(*same).agg(F.count("*").alias("m"), F.max("proved").alias("known"), F.min(F.struct("row", "tag", "at")).alias("where"))
        kinds = stored(kinds.select(*same, "where.*", ((F.col("m") > 1) | F.col("known")).alias("proved")), "kinds")
        equal = rows.filter("NOT proved").join(kinds.filter("proved").select(*same), same, "left_semi")
        a, b = F.col("at") - F.length("before"), F.col("at") + ANCHOR + F.length("after")
        found = found.union(equal.select("row", "tag", a.alias("a"), b.alias("b")))
        level = kinds


def repeated_spans(base: DataFrame, most: int = GROUP) -> DataFrame:
    """(row, tag, spans array<struct<a,b>>) of texts with repeated strings; base: row, tag, text. Spans may overlap.

    Rows of one (row, tag) have one text, and each counts: their strings repeat each other.
    """
    every = _anchor_rows(base)
    # Counts with partial sums, so a hot anchor is few rows to one task; the counts are a table of their own, so that the join can split it.
    again = stored(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    rows = stored(every.join(again, "h", "left_semi"), "anchors")
    context = ["h", "around", "more"]
    kinds = stored(rows.groupBy(*context).agg(F.count("*").alias("m"), F.min(F.struct("row", "tag", "at")).alias("where")), "contexts")
    proved = rows.join(kinds.filter("m > 1").select(*context), context, "left_semi")
    sure = proved.select("row", "tag", (F.col("at") - SIDE).alias("a"), (F.col("at") + LENGTH).alias("b"))
    groups = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("m").alias("least")).filter("kinds > 1 AND least = 1").select("h"), "groups")
    place = F.struct("h", F.col("where.at").alias("at"), (F.col("m") > 1).alias("proved"))
    asked = kinds.join(groups, "h", "left_semi").select(F.col("where.row").alias("row"), F.col("where.tag").alias("tag"), place.alias("x"))
    asked = asked.groupBy("row", "tag").agg(F.collect_list("x").alias("asked"))
    contexts = stored(_context_rows(base.join(asked, ["row", "tag"]).select("row", "tag", "asked", "text")), "around")
    found = _group_spans(contexts, most)
    return stored(sure.union(found).groupBy("row", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", emit: str = "digest", most: int = GROUP) -> DataFrame:
    """One row a document. emit "text": key, spans and the kept bytes; "digest": key and the digest columns."""
    kind = docs.schema[key].dataType
    base = docs.select(*identity(docs, key, text), F.col(key).alias("key"), whole_text(text).alias("text"))
    joined = base.join(repeated_spans(base.select("row", "tag", "text"), most), ["row", "tag"], "left").select("key", "text", "spans")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                runs = merged([(s["a"], s["b"]) for s in spans or ()], len(data))
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) if emit == "digest" else ([{"a": a, "b": b} for a, b in runs], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) if emit == "digest" else (pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if emit == "digest" else ["spans", "kept"]
            yield pa.record_batch([batch.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["key", *names])

    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if emit == "digest" else "spans array<struct<a:bigint,b:bigint>>, kept binary"
    return joined.mapInArrow(run, f"key {kind.simpleString()}, {schema}").withColumnRenamed("key", key)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
