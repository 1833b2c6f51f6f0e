"""Operators that SQL can't express against plain versions of their definitions."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from gridloom.llm import common, decontaminate, html_text, line_dedup, quality_rules, secrets, simhash, toxicity
from tests.llm.helpers import SF, edge_frame, edge_rows, texts


def test_ratio_and_verdict(spark):
    rows = [(k, t) for k, t in texts()]
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in rows}
    h = {k: [xxhash.xxh64_intdigest(w, 42) for w in ws] for k, ws in words.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(k):
        own = [signed(x) for x in h[k]]
        return [x % quality_rules.BUCKETS for x in own] + [(a ^ (b >> 1)) % quality_rules.BUCKETS for a, b in zip(own, own[1:])]

    def trusted(k, t):
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words[k])
        upper = sum(c.isupper() and c.lower() != c for c in t)
        return n >= 40 and 100 * len(re.findall(r"[#*$%&|<>]", t)) <= n and len(lines) == len(set(lines)) and 5 * upper <= sum(map(len, words[k])) and 10 * len(set(h[k])) >= 30 * math.sqrt(n)

    raw, target = collections.Counter(), collections.Counter()
    for k, t in rows:
        raw.update(grams(k))
        if trusted(k, t):
            target.update(grams(k))
    a, b = sum(target.values()) + quality_rules.BUCKETS, sum(raw.values()) + quality_rules.BUCKETS
    weight = {g: math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b) for g in raw}
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, SF).collect()}
    for k, _ in rows:
        own = [weight[g] for g in grams(k)]
        want = sum(own) / len(own) if own else 0.0
        assert got[k].llr == pytest.approx(want, abs=1e-9)
        assert got[k].kept == (not got[k].base_failed and got[k].llr >= quality_rules.THRESHOLD)


def test_linked_parts():
    """What the interval joins give, by looking at all pairs."""
    rnd = random.Random(31)
    parts = ["user=alice7", "client_id: ab12cd", "AKIA" + "A1" * 8, "Zx9aB3aB3aB3aB3aB3aB3aB3", "pwd=S3cret!x9", "password: hunter22x", "https://db.example.com/x", "host: db.local", "plain words", "lorem " * 30, "\n\n", "\n"]
    meets = lambda s, t: s[0] < t[1] and t[0] < s[1]
    some = 0
    for _ in range(600):
        t = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        base, every = secrets.scan_text(t)
        found = {k: [(m.start(), m.end()) for m in p.finditer(t)] for k, p in (("id", secrets.IDENTIFIER), ("end", secrets.ENDPOINT))}
        guess = sorted([(m.start(), m.end()) for m in secrets.TOKEN.finditer(t) if re.search(r"\d", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])] + [(m.start(), m.end()) for m in secrets.WEAK_ASSIGN.finditer(t)])
        taken = [(a, b) for a, _, b in base]

        def free(spans, taken):
            out = []
            for s in spans:
                if not any(meets(s, x) for x in taken) and not any(meets(s, x) for x in out):
                    out.append(s)
            return out

        ids = free(found["id"], taken)
        ends = free(found["end"], taken + ids)
        keys = free(guess, taken + ids + ends)
        blank = [(m.start(), m.end()) for m in secrets.BLANK.finditer(t)]

        def scope(a, b):
            left = max([e for _, e in blank if e <= a], default=0)
            right = min([s for s, _ in blank if s >= b], default=len(t))
            return max(a - secrets.REACH, left), min(b + secrets.REACH, right)

        strong = [(a, b) for a, k, b in base if k == 1]
        want = set()
        for s, weak in [(s, True) for s in keys] + [((a, b), False) for a, k, b in base if k != 1]:
            reach = scope(*s)
            near = [i for i in ids if meets(reach, i)]
            if not near and not any(meets(reach, i) for i in strong):
                continue
            want |= {(a, 3, b) for a, b in near} | {(a, 5, b) for a, b in ends if meets(reach, (a, b))}
            if weak:
                want.add((s[0], 4, s[1]))
        assert set(every) - set(base) == want, t
        some += bool(want)
    assert some > 100


def test_scores_lambda_and_k():
    rnd = random.Random(32)
    words = [f"{a}{b}{c}ing" for a in "abcd" for b in "xyz" for c in "mnop"]
    bad = set(rnd.sample(words, 8))
    good = sorted(set(words) - bad)
    docs = [(y, [rnd.choice(good) for _ in range(40)] + [rnd.choice(sorted(bad)) for _ in range(10 if y else rnd.random() < 0.1)]) for y in (rnd.random() < 0.3 for _ in range(400))]
    n, toxic = collections.Counter(), collections.Counter()
    for y, ws in docs:
        n.update(set(ws))
        toxic.update(set(ws) if y else ())
    counts = pd.DataFrame([(w, n[w], toxic[w]) for w in sorted(n)], columns=["word", "n", "toxic"])
    stems = collections.defaultdict(lambda: [0, 0])
    for w in n:
        for s in {w[:4], w[:6]}:
            stems[s][0] += n[w]
            stems[s][1] += toxic[w]
    lex = toxicity.Lexicon(counts, pd.DataFrame([(s, *v) for s, v in sorted(stems.items())], columns=["stem", "n", "toxic"]))
    rate = sum(toxic.values()) / sum(n.values())

    def mean(t, m, prior):
        return (t + prior) / (m + 1)

    for w in n:
        outer = mean(stems[w[:4]][1], stems[w[:4]][0], rate)
        p = mean(toxic[w], n[w], mean(stems[w[:6]][1], stems[w[:6]][0], outer))
        odds = math.log(p / (1 - p)) - math.log(rate / (1 - rate))
        error = math.sqrt(1 / (toxic[w] + rate) + 1 / (n[w] - toxic[w] + 1))
        assert lex.score(w) == pytest.approx(math.copysign(max(0, abs(odds) - toxicity.ERRORS * error), odds) - toxicity.COST)
    assert any(lex.score(w) < toxicity.NEUTRAL for w in n) and any(lex.score(w) > 0 for w in bad)  # evidence against as well as for
    clean = np.array([n[w] - toxic[w] for w in n], float)
    top = max(1.0, max(lex.score(w) for w in n))
    total = (clean * np.exp(lex.decay * np.array([lex.score(w) for w in n]))).sum() + 0.5 * math.exp(lex.decay * top)
    assert total / (clean.sum() + 0.5) == pytest.approx(1, abs=1e-6)
    best, size = np.array([0.0, 1.0, 3.0]), np.array([10.0, 20.0, 30.0])
    lex.fit_k(best, size)
    assert lex.k == pytest.approx(2 / (10 + 20 * math.exp(-lex.decay) + 30 * math.exp(-3 * lex.decay)))
    text = " ".join(sorted(bad)[:3] + words[:3])
    found = sorted((lex.decay * s - math.log(lex.k * 6) for _, _, s in lex.segments(toxicity.tokens(text))), reverse=True)
    sums = np.cumsum(found)
    want = max([0.0] + [s - r * math.log(s) + math.lgamma(r + 2) + math.lgamma(r + 1) for r, s in enumerate(sums) if all(x > 0 for x in sums[: r + 1]) and s > r + 1])
    assert lex.evidence(text)[0] == pytest.approx(want)


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "What is the capital"), (2, "yes"), (3, "Name the longest river in Asia")], "item_id bigint, text string")
    rows = [(1, "so what is the capital of it"), (2, "what is the capitally odd"), (3, "Yes"), (4, "yes and no"), (5, "name the longest river in Asia!"), (6, "Name the longest rivers in Asia"), (7, None)]
    want = [(1, 1), (3, 2), (5, 3)]
    for blocks in (500_000, 10):
        decontaminate.BLOCK_CHARS, old = blocks, decontaminate.BLOCK_CHARS
        try:
            assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(edge_frame(spark, rows), bench).collect()) == want
        finally:
            decontaminate.BLOCK_CHARS = old


def test_a_very_long_page():
    trees = html_text.fit()
    words = " ".join(f"word{i % 977} of a long article that goes on" for i in range(4000))
    page = f"<html><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Title</h1><p>{words}</p><p>{words}</p></article><footer>Contact us</footer></body></html>"
    assert html_text.extract([page], trees) == [f"Title {words} {words}"]


def test_all_stages_on_edges(spark):
    docs = edge_frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(edge_rows())
        assert stage(spark, edge_frame(spark, empty=True), SF).count() == 0


def test_tables_go(spark):
    since = common.mark()
    kept, gone = common.stored(spark.range(5), "kept"), common.stored(spark.range(5), "gone")
    common.release(since, kept)
    assert kept.count() == 5 and common.mark() == since + 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        gone.count()
    common.discard(kept)
    assert common.mark() == since


class Plan:
    """Stands for a DataFrame and keeps the functions that run on batches."""

    def __init__(self):
        self.functions = []

    def mapInArrow(self, f, schema):
        self.functions.append(f)
        return self

    def __getattr__(self, name):
        return lambda *a: self


@pytest.mark.parametrize("most, forest", [(6, 17), (6, 1000), (10, 64), (50, 64)])
def test_groups_of_copies_across_batches(monkeypatch, most, forest):
    """Sets of comparable size in one group share a shard, or are both known as members of a large group; neighbours always share one."""
    monkeypatch.setattr(simhash, "FOREST", forest)
    plan = Plan()
    simhash._dealt_copies(plan, most)
    rnd = random.Random(most * forest)
    rows = sorted((s * 7 - 100, rnd.choice([20, 21, 22, 24, 25, 30, 31, 60, 61]), i) for s in range(40) for i in rnd.sample(range(100_000), rnd.choice([1, 2, 5, 30, 120])))

    def batches():
        for a in range(0, len(rows), 13):
            s, n, ids = zip(*rows[a : a + 13])
            yield pa.record_batch([pa.array(s, pa.int64()), pa.array(ids, pa.int64()), pa.array([0] * len(s), pa.int32()), pa.array(n, pa.int32())], ["s", "id", "more", "n"])

    shards, large = collections.defaultdict(set), collections.defaultdict(set)
    for b in plan.functions[1](batches()):
        for shard, i, _, _, whole in zip(*(c.to_pylist() for c in b.columns)):
            (large if whole else shards)[shard].add(i)
    assert max(map(len, shards.values())) <= most
    of = collections.defaultdict(set)
    for shard, own in shards.items():
        for i in own:
            of[i].add(shard)
    groups = collections.defaultdict(list)
    for s, n, i in rows:
        groups[s].append((n, i))
    for s, own in groups.items():
        for b, (m, j) in enumerate(own):
            for a, (n, i) in enumerate(own[:b]):
                if 4 * m <= 5 * n:
                    assert of[i] & of[j] or a + 1 < b and {i, j} <= large[s]


@pytest.mark.parametrize("most, limit", [(7, 3), (50, 10), (1000, 4)])
def test_groups_of_lines_across_batches(most, limit):
    """No group of up to `limit` lines is cut; of a larger one all rows come, marked as such if it is cut."""
    rnd = random.Random(most)
    rows = sorted((s, h, rnd.randint(0, 1)) for s in range(60) for h in [rnd.randint(0, 30) for _ in range(rnd.choice([1, 2, 5, 60]))])

    def batches():
        for a in range(0, len(rows), 11):
            s, h, lane = zip(*rows[a : a + 11])
            yield pa.record_batch([pa.array(s, pa.int64()), pa.array(h, pa.int64()), pa.array(h, pa.int64()), pa.array(lane, pa.int32()), pa.array([None] * len(s), pa.binary())], ["sign", "h", "sketch", "lane", "path"])

    seen, parts = collections.defaultdict(set), collections.defaultdict(list)
    for k, (table, group, large) in enumerate(line_dedup._grouped(batches(), most, limit)):
        for s, h, g in zip(table["sign"].to_pylist(), table["h"].to_pylist(), group.tolist()):
            seen[s].add(h)
            if not parts[s] or parts[s][-1] != (k, large):
                parts[s].append((k, large))
    want = collections.defaultdict(set)
    for s, h, _ in rows:
        want[s].add(h)
    assert seen == want
    assert all(len(p) == 1 if len(want[s]) <= limit else len(p) == 1 or all(x for _, x in p) for s, p in parts.items())
