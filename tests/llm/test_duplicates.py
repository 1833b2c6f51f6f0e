import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bktree, line_dedup, simhash, substring_dedup, suffixes
from gridloom.llm.components import components
from tests.llm.helpers import SF, edge_frame, edge_rows, edits, mutated, texts


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    codes[300:900] = codes[0] ^ (np.uint64(1) << rng.integers(0, 10, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 600).astype(np.uint64))
    codes = np.unique(codes)[:, None]
    shard = np.sort(rng.integers(0, 3, len(codes)))
    got = {p for q, n in bktree.Forest(codes, shard).search(2) for p in zip(q.tolist(), n.tolist())}
    d = np.bitwise_count(codes ^ codes.T)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((d <= 2) & (shard[:, None] == shard))) if i != j}
    assert got == want and len(want) > 1000


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            count[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * count[k] > len(shingles))


def test_search_of_a_large_group_holds_few_pairs():
    rng = np.random.default_rng(1)
    codes = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 3000, 0)
    for _ in range(8):
        codes[np.arange(3000), rng.integers(0, 4, 3000)] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    shard = np.repeat([0, 1, 2], [100, 2800, 100])
    forest = bktree.Forest(codes, shard)
    tracemalloc.start()
    pairs = sum(len(q) for q, _ in forest.search(80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = sum(np.bitwise_count(w[:, None] ^ w) for w in codes.T)
    assert pairs == ((d <= 80) & (shard[:, None] == shard)).sum() - 3000 > 5_000_000
    assert peak < 10e6


def test_sets_of_links_are_held_in_part(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.permutation(40)[:38]], np.uint64(k + 1))) for k in range(200)]
    ids = np.arange(200)
    cols = [np.zeros(200, np.int64), ids, np.zeros(200, np.int32), np.array([len(x) for x in sets], np.int32), ids, [c.tobytes() for c in simhash.set_codes(sets)], [x.tobytes() for x in sets]]
    batch = pa.record_batch([pa.array(c) for c in cols], ["shard", "id", "more", "n", "part", "code", "shingles"])
    want = roots(200, [(a, b) for a in range(200) for b in range(a) if 9 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * (len(sets[a]) + len(sets[b]))])
    monkeypatch.setattr(simhash, "HELD", 100)
    found = [p for out in simhash._copy_links(iter([batch])) for p in zip(out.column(0).to_pylist(), out.column(2).to_pylist())]
    assert roots(200, found) == want and len(set(want)) < 100


def test_simhash_against_brute_force(spark):
    rows = texts()
    prints = [brute_print(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, SF).collect()}
    assert got == {rows[i][0]: (f"{prints[i]:016x}", rows[want[i]][0]) for i in range(len(rows))}


def test_small_shards_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    codes = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 12, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    nodes = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint")
    dealt = simhash.shards(nodes, 2, 20)
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= 20
    found = components(dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(simhash._linked_in_shards(2), "a bigint, b bigint"))
    got = {r.node: r.root for r in found.collect()}
    label = bktree.Forest(codes[:, None], np.zeros(len(codes), np.int64)).linked(2)
    groups = collections.defaultdict(list)
    for c, g in zip(codes.view(np.int64).tolist(), label.tolist()):
        groups[g].append(c)
    assert all(got.get(c, c) == min(g) for g in groups.values() for c in g)


def test_simhash_edges(spark):
    out = simhash.near_duplicates(edge_frame(spark)).collect()
    assert len(out) == len(edge_rows())
    by = {r.doc_id: r.component for r in out if r.doc_id not in (None, 7)}
    assert by[2] == by[3] == by[1] and by[5] == by[6] == 5
    assert simhash.near_duplicates(edge_frame(spark, empty=True)).count() == 0


def test_near_copies(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.replace(" ", "  ")) for i, t in enumerate(base[:2])]
    w = base[3].split()
    w[50], w[200] = "changed", "again"
    rows += [(20, " ".join(w)), (21, None), (22, "")]
    left = simhash.without_copies(edge_frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4, 5, 21] or sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4, 5, 22]
    assert left.columns == edge_frame(spark).columns
    assert simhash.without_copies(edge_frame(spark, empty=True)).count() == 0


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(400):
        t = [rnd.randint(1, rnd.choice((1, 2, 3, 20))) for _ in range(rnd.randint(0, 60))] + [0]
        order = suffixes.suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffixes.common_prefixes(t, order)
        for a, b, k in zip(order, order[1:], shared[1:]):
            assert t[a : a + k] == t[b : b + k] and t[a + k : a + k + 1] != t[b + k : b + k + 1]


def test_sorted_contexts(monkeypatch):
    """Against brute force; and a suffix array sorts a symbol for each start of a string, equal ones once."""
    rnd = random.Random(4)
    sorted_texts = []
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda t: sorted_texts.append(len(t)) or suffixes.suffix_array(t))
    for letters in (b"a", b"ab", bytes(range(256))):
        for _ in range(40):
            base = [bytes(rnd.choices(letters, k=80)) for _ in range(2)]
            sides = {(rnd.choice(base)[rnd.randint(0, 50) :], rnd.choice(base)[: rnd.randint(30, 80)]) for _ in range(6)}
            sides |= {(x[:-9] + b"?" + x[-8:], y) for x, y in list(sides)[:2]}
            group = [(x, y, rnd.random() < 0.2, ((i, 0), 100)) for i, (x, y) in enumerate(sorted(sides))]
            every = collections.defaultdict(int)
            strings = [{a: (x[len(x) - a :], y[: 80 - a]) for a in range(81) if a <= len(x) and 80 - a <= len(y)} for x, y, _, _ in group]
            for own, (_, _, proved, _) in zip(strings, group):
                for s in own.values():
                    every[s] += 1 + proved
            want = [[] if proved else [a for a, s in own.items() if every[s] > 1] for own, (_, _, proved, _) in zip(strings, group)]
            assert [sorted(x) for x in substring_dedup.repeated_starts(group)] == want
    # 50 texts share 30 bytes to the left of the anchor and all to the right: 31 strings, and the end of the text.
    group = [(bytes(rnd.choices(range(256), k=49)) + bytes([i]) + bytes(range(30)), b"r" * 80, False, ((i, 0), 100)) for i in range(50)]
    sorted_texts.clear()
    assert [sorted(x) for x in substring_dedup.repeated_starts(group)] == [list(range(31))] * 50
    assert sorted_texts == [32]
    wide = [rnd.choice((1, 2, 70_000, 70_001)) for _ in range(200)] + [0]
    assert suffixes.suffix_array(wide) == sorted(range(len(wide)), key=lambda i: wide[i:])


def brute_removed(docs, size=200):
    count = collections.Counter(d[i : i + size] for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if count[d[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def test_substrings_against_brute_force(spark):
    rnd = random.Random(8)
    p = texts()[5][1][:700]
    docs = [None, "", "x" * 199, "x" * 201, "ab" * 400, p, p, p[:350] + "ZZ" + p[350:], p[100:420], "q" + p[:199], "é" * 150 + p[:250], "é" * 150 + "!"] + [mutated(rnd, p, rnd.randint(1, 4), "XYZ") for _ in range(12)]
    want = brute_removed([(d or "").encode() for d in docs])
    frame = edge_frame(spark, list(enumerate(docs)))
    for most in (5000, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(frame, most=most).collect()}
        assert got == dict(enumerate(want))
    rows = substring_dedup.remove_repeats(edge_frame(spark)).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == collections.Counter(brute_removed([(t or "").encode() for _, t in edge_rows()]))
    assert substring_dedup.remove_repeats(edge_frame(spark, empty=True)).count() == 0


def test_band_and_signatures():
    rnd = random.Random(2)
    lines = []
    for _ in range(25):
        s = "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(40, 90)))
        lines += [s, *(mutated(rnd, s, rnd.randint(0, 4)) for _ in range(4))]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(lines)) for j in range(i + 1, min(i + 6, len(lines)))]))
    near = np.array([edits(lines[i], lines[j]) <= 2 for i, j in zip(a, b)])
    assert (line_dedup.within(lines, a, b) == near).all() and near.sum() > 40
    number, sign, sketch = line_dedup.signatures(lines)
    own = [set(sign[number == i].tolist()) for i in range(len(lines))]
    one = np.array([sketch[number == i][0] for i in range(len(lines))])
    assert all(own[i] & own[j] for i, j, n in zip(a, b, near) if n) and line_dedup.alike(one[a], one[b])[near].all()


def test_signatures_are_shuffled_in_few_rows():
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(20, 90))) for _ in range(2500)]
    lines += [x[:30] + "#" + x[31:] for x in lines[:300]] + ["the same long beginning of a line, then " + str(i) for i in range(200)]
    number, sign, part, at, total, edits = line_dedup.placed_by_size(lines)
    lane = line_dedup.lanes(sign, line_dedup._indexed(lines, number, part, at, total, edits), 3)
    h, sketch = number + 10, line_dedup.sketches(lines)[number]
    batch = line_dedup.packed(sign, h, sketch, lane)
    assert batch.num_rows <= line_dedup.BUCKETS < len(sign) / 5
    out = [b for half in (batch.slice(0, 1500), batch.slice(1500)) for b in line_dedup.unpacked(iter([half]))]
    got = [r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("sign", "h", "sketch", "lane")))]
    times = collections.Counter(sign.tolist())
    alone = collections.Counter((s, n >> 2) for s, n in zip(sign.tolist(), lane.tolist()))
    every = list(zip(sign.tolist(), h.tolist(), sketch.tolist(), lane.tolist()))
    assert set(got) <= set(every) and len(got) < len(every) / 2 and max(times.values()) > line_dedup.LOCAL
    assert set(got) >= {r for r in every if alone[r[0], r[3] >> 2] > 1 or r[3] & 2}
    for b in out:
        key = list(zip(b.column(0).to_pylist(), [x >> 2 for x in b.column(3).to_pylist()], b.column(1).to_pylist()))
        assert key == sorted(key)


def test_lines_against_brute_force(spark):
    rnd = random.Random(4)
    pool = []
    for _ in range(15):
        s = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(45, 70)))
        pool += [s, *(mutated(rnd, s, rnd.randint(0, 3)) for _ in range(3))]
    rows = [(i, "\n".join(rnd.choice([*pool, "short", "exactly equal lines of 20", ""]) for _ in range(rnd.randint(0, 7)))) for i in range(50)] + [(60, None), (61, "")]
    lines = [(d, p, x.strip()) for d, t in rows for p, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 20]
    distinct = sorted({x for _, _, x in lines})
    pairs = [(i, j) for i, x in enumerate(distinct) for j in range(i) if len(x) >= 40 and len(distinct[j]) >= 40 and edits(x, distinct[j]) <= 2]
    label = dict(zip(distinct, roots(len(distinct), pairs)))
    first: dict = {}
    for d, p, x in lines:
        first.setdefault(label[x], (d, p))
    want = {d: "\n".join(x for p, x in enumerate((t or "").split("\n")) if len(x.strip()) < 20 or first[label[x.strip()]] == (d, p)) for d, t in rows}
    got = {r["all"]["_0"]: r.kept for r in line_dedup.kept_lines(edge_frame(spark, rows)).collect()}
    assert got == want
    left = line_dedup.deduplicated(edge_frame(spark, rows))
    assert left.columns == edge_frame(spark).columns and left.count() == sum(1 for d, t in rows if want[d].strip() or want[d] == (t or ""))
    assert line_dedup.deduplicated(edge_frame(spark)).count() > 0 and line_dedup.deduplicated(edge_frame(spark, empty=True)).count() == 0


def copies_wanted(rows):
    """Ids that stay, by the exact Jaccard similarity of five-word shingles of all pairs."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (t.lower().split() for _, t in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    label = roots(len(rows), pairs)
    return sorted(rows[i][0] for i in range(len(rows)) if label[i] == i), pairs


def passages(rnd, n=60, cuts=(0.03, 0.3)):
    """Texts with a shortened, an extended and a replaced passage, at similarities on both sides of 0.8."""
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 400))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(8, 250))]
        k = max(1, int(len(w) * rnd.uniform(*cuts)))
        at = rnd.randrange(len(w) - k + 1)
        for j, x in enumerate((w, w[:-k], [*w, *(word() for _ in range(k))], [*w[:at], *(word() for _ in range(k)), *w[at + k :]])):
            rows.append((10 * i + j, " ".join(x)))
    return rows


def test_near_copies_of_passages(spark):
    rows = passages(random.Random(11))
    want, pairs = copies_wanted(rows)
    assert len(pairs) > 60
    assert sorted(r.doc_id for r in simhash.without_copies(edge_frame(spark, rows)).collect()) == want


def test_small_shards_lose_no_copy(spark, monkeypatch):
    rnd = random.Random(12)
    common = " ".join(f"common{i}" for i in range(90))
    rows = passages(rnd, 30) + [(1000 + i, f"{common} {' '.join(f'w{rnd.randint(0, 99)}' for _ in range(rnd.randint(5, 30)))}") for i in range(60)]
    rows += [(2000 + i, mutated(rnd, common, rnd.randint(1, 12))) for i in range(60)]
    want, _ = copies_wanted(rows)
    nodes = simhash._copy_prints(edge_frame(spark, rows), "doc_id", "text").dropDuplicates(["id"])
    assert simhash._copy_shards(nodes, 6).groupBy("shard").count().agg(F.max("count")).first()[0] <= 6
    for most in (6, 4096):
        monkeypatch.setattr(simhash, "SHARD", most)
        assert sorted(r.doc_id for r in simhash.without_copies(edge_frame(spark, rows)).collect()) == want


def test_copies_below_similarity_stay(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(60):
        w = [f"{i}w{rnd.randint(0, 999)}" for _ in range(rnd.choice((10, 60, 300)))]
        k = 1 + (len(w) - 4) * 5 // 4 - (len(w) - 4)  # words added, so that similarity is a little under 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, *(f"{i}x{j}" for j in range(k))]))]
    want, pairs = copies_wanted(rows)
    assert not pairs and want == [i for i, _ in rows]
    assert sorted(r.doc_id for r in simhash.without_copies(edge_frame(spark, rows)).collect()) == want


def test_short_lines_against_brute_force(spark):
    rnd = random.Random(14)
    pool = ["short", "12", "--", "• •", "é", "Ietzte."]
    for size in (8, 19, 20, 21, 25, 30, 38, 39, 40, 41, 42):
        for _ in range(4):
            s = "x" + "".join(rnd.choice("abcde ") for _ in range(size - 2)) + "y"
            pool += [s, *(mutated(rnd, s[1:-1], rnd.randint(0, 3), "abc").join("xy") for _ in range(3))]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 7)))) for i in range(120)]
    word = re.compile(r"[^\W_]")
    can = lambda x: len(x) >= 20 or word.search(x)
    lines = [(d, p, x.strip()) for d, t in rows for p, x in enumerate(t.split("\n")) if can(x.strip())]
    distinct = sorted({x for _, _, x in lines})
    near = lambda x, y: min(len(x), len(y)) >= 20 and edits(x, y) <= (1 if min(len(x), len(y)) < 40 else 2)
    label = dict(zip(distinct, roots(len(distinct), [(i, j) for i, x in enumerate(distinct) for j in range(i) if abs(len(x) - len(distinct[j])) < 3 and near(x, distinct[j])])))
    first: dict = {}
    for d, p, x in lines:
        first.setdefault(label[x], (d, p))
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if not can(x.strip()) or first[label[x.strip()]] == (d, p)) for d, t in rows}
    assert {r["all"]["_0"]: r.kept for r in line_dedup.kept_lines(edge_frame(spark, rows), minimum=1).collect()} == want


def line_wanted(lines):
    """Least line of the class of each of the distinct lines, by the edit distance of all pairs."""
    near = lambda x, y: min(len(x), len(y)) >= 20 and edits(x, y) <= (1 if min(len(x), len(y)) < 40 else 2)
    pairs = [(i, j) for i, x in enumerate(lines) for j in range(i) if abs(len(x) - len(lines[j])) < 3 and near(x, lines[j])]
    return roots(len(lines), pairs), pairs


def test_hot_signatures_are_dealt_again(spark, monkeypatch):
    rnd = random.Random(21)
    lines = set()
    for k in range(30):  # one prefix, one suffix, and a middle; some near each other
        own = "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(9, 14)))
        for _ in range(3):
            lines.add(f"Copyright (c) 2020 by {mutated(rnd, own, rnd.randint(0, 3), 'abcdefghij')}. All rights reserved.")
        lines.add(f"Page {k:02d} of the catalogue {rnd.randint(0, 9)}")  # of 20 to 39 characters
        lines.add(f"Entry number {rnd.randint(0, 99):02d}-{rnd.randint(0, 99):02d} in the catalogue of the museum")
        lines.add("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "b" * rnd.randint(0, 3) + "c" * rnd.randint(0, 2) + rnd.choice("xyz") * rnd.randint(0, 3))
    lines = sorted(lines)
    want, pairs = line_wanted(lines)
    assert len(pairs) > 50
    for group, local, short in ((4, 2, {1: 6, 2: 5}),):
        monkeypatch.setattr(line_dedup, "GROUP", group)
        monkeypatch.setattr(line_dedup, "LOCAL", local)
        monkeypatch.setattr(line_dedup, "OPEN", short)
        stay = {r.doc_id for r in line_dedup.deduplicated(edge_frame(spark, list(enumerate(lines))), minimum=1).collect()}
        assert stay == {i for i, r in enumerate(want) if i == r}, (group, local)


def test_dealing_again_keeps_near_lines_together():
    rnd = random.Random(24)
    for _ in range(1500):
        size = rnd.choice((24, 33, 45, 70))
        a = "".join(rnd.choice("ab") for _ in range(size))
        b = mutated(rnd, a, rnd.randint(1, 3), "ab")
        allow = 1 if min(len(a), len(b)) < 40 else 2
        if edits(a, b) > allow or max(len(a), len(b)) > 40 and allow == 1:
            continue
        number, sign, part, at, total, budget = line_dedup.placed_by_size([a, b])
        start = [(line_dedup.pieces([(0, int(n), 0, 0)], int(e) + 1)[p][1]) for n, e, p in zip(total, budget, part)]
        rows = [set(), set()]
        for i, s, p, x, n, e, z in zip(number.tolist(), sign.tolist(), part.tolist(), at.tolist(), total.tolist(), budget.tolist(), start):
            line = (a, b)[i]
            if e == allow:
                rows[i].add((s, bytes((e, len(line) - n, p, x - z + 8)), n == len(line) and x == z))
        for _ in range(3):  # at every level one row of either is in a group of the other, one of them indexed
            found = {s for s, _, flag in rows[0] if any(s == t and (flag or other) for t, _, other in rows[1])}
            assert found, (a, b)
            rows = [{new for s, path, _ in own if s in found for new in line_dedup.dealt_again(s, line, path)} for own, line in zip(rows, (a, b))]
            if not rows[0] and not rows[1]:
                break


def test_variants_join_near_lines():
    rnd = random.Random(22)
    for _ in range(3000):
        size = rnd.choice((4, 7))
        a = "".join(rnd.choice("abc") for _ in range(size))
        b = mutated(rnd, a, rnd.randint(0, 3), "abc")
        for k in (1, 2):
            x, y = (line_dedup.variants(s, k, list(range(len(s)))) for s in (a, b))
            joined = any(x[v] or y[v] for v in x.keys() & y.keys())
            assert joined == (edits(a, b) <= k), (a, b, k)


def test_a_group_of_one_prefix(spark):
    """200,000 lines with one prefix: no group is compared pair by pair, and near lines are found."""
    rnd = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["Copyright (c) 2020 by " + "".join(rnd.choices(letters, k=rnd.randint(20, 34))) for _ in range(200_000)]
    near = {i: mutated(rnd, lines[i], rnd.randint(1, 2)) for i in range(0, 200_000, 2000)}
    docs = ["\n".join(lines[i : i + 100]) for i in range(0, 200_000, 100)] + [" " + x for x in near.values()]
    frame = edge_frame(spark, list(enumerate(docs)))
    out = {r["all"]["_0"]: r.n_removed for r in line_dedup.kept_lines(frame, minimum=1).collect()}
    assert all(out[i] == 0 for i in range(2000)) and all(out[2000 + i] == 1 for i in range(len(near)))
