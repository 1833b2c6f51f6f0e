"""Secret scan with multipart credential linking.

Strong patterns (assign, access, hex) are reported wherever they stand. Weak candidates - user names and
client ids, random-looking tokens, end points - say little alone: they are reported only where
complementary parts stand together. For that, parts and scopes are intervals: a secret's scope reaches
REACH code points to both sides but not over a blank line, and an interval join of scopes with
identifiers, then of the linked pairs with end points, gives the credentials.

Defined cases: null and empty texts have no spans; repeated rows are scanned alike; an empty table gives an
empty table; columns other than the id and the text are ignored. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import whole_text

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: Code points to each side of a secret within which its identifier and end point may stand.
REACH = 240
# The strong patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run matches whole, so the length can stand in the pattern
# Weak patterns.
IDENTIFIER = re.compile(r"""(?ai:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}""")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ASSIGN = re.compile(r"""(?ai:\b(?:pwd|passphrase|pass|auth|credential|private_?key|signature|bearer))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}""")
ENDPOINT = re.compile(r"""(?ai:\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def overlapping(scopes: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[list[int]]:
    """Interval join: for each scope the numbers of the parts that overlap it. parts: sorted, not overlapping each other."""
    ends = [e for _, e in parts]
    out = []
    for a, b in scopes:
        i = bisect_left(ends, a + 1)
        own = []
        while i < len(parts) and parts[i][0] < b:
            own.append(i)
            i += 1
        out.append(own)
    return out


def _apart(found, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the sorted spans that overlap nothing in taken (sorted) or an earlier one of their own."""
    ends, out, last = [e for _, e in taken], [], -1
    for a, b in found:
        i = bisect_left(ends, a + 1)
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            out.append((a, b))
            last = b
    return out


def _flat(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans, as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak identifiers, keys and end points that belong to one credential."""
    strong_ids = [(a, b) for a, k, b in base if k == 1]
    named = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    if not strong_ids and not named:
        return []  # without an identifier there is nothing to complement
    taken = _flat([(a, b) for a, _, b in base])
    weak_ids = _apart(named, taken)
    links = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    ends = _apart(links, _flat(taken + weak_ids))
    guesses = sorted([(m.start(), m.end()) for m in TOKEN.finditer(text) if _random_looking(m[0])] + [(m.start(), m.end()) for m in WEAK_ASSIGN.finditer(text)])
    weak_keys = _apart(guesses, _flat(taken + weak_ids + ends))
    strong_keys = [(a, b) for a, k, b in base if k != 1]
    gaps = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    gap_starts, gap_ends = [a for a, _ in gaps], [b for _, b in gaps]

    def scope(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_left(gap_ends, a + 1) - 1, bisect_left(gap_starts, b)
        return max(a - REACH, gap_ends[i] if i >= 0 else 0), min(b + REACH, gap_starts[j] if j < len(gaps) else len(text))

    keys = sorted([(s, True) for s in weak_keys] + [(s, False) for s in strong_keys])
    ids = sorted([(s, True) for s in weak_ids] + [(s, False) for s in strong_ids])
    scopes = [scope(*s) for s, _ in keys]
    joined = overlapping(scopes, _flat([s for s, _ in ids]))
    flat_ids = _flat([s for s, _ in ids])
    weak = {s for s, w in ids if w}
    out: set[Span] = set()
    complete = []
    for (s, is_weak), own, reach in zip(keys, joined, scopes):
        if not own:
            continue
        if is_weak:
            out.add((s[0], 4, s[1]))
        out.update((flat_ids[i][0], 3, flat_ids[i][1]) for i in own if flat_ids[i] in weak)
        complete.append(reach)
    for own in overlapping(complete, ends):
        out.update((ends[i][0], 5, ends[i][1]) for i in own)
    return sorted(out)



def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans, and all spans, by start and kind."""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,end,linked>>) of every row."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base, every = scan_text(t)
                own = set(base)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "linked": (a, k, b) not in own} for a, k, b in every])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())]))
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,linked:boolean>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["linked"])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
