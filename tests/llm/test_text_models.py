import collections
import hashlib
import random
import re

import numpy as np
import pytest

from gridloom.llm import decontaminate, html_text, quality_model, quality_rules, secrets, toxicity
from gridloom.llm.common import fold
from gridloom.llm.dom import Page
from tests.llm.helpers import SF, edge_frame, edge_rows, mutated, texts


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark):
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, SF).collect()}
    for k, t in texts():
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words, got[k].base_failed) == base(t)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([got[k].kept == (q == 1) for k, q in labels.items() if not got[k].base_failed]) > 0.9
    rows = quality_rules.score(edge_frame(spark)).collect()
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == collections.Counter(base(t or "") for _, t in edge_rows())
    assert quality_rules.kept(edge_frame(spark)).columns == edge_frame(spark).columns
    assert quality_rules.score(edge_frame(spark, empty=True)).count() == 0


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark):
    rnd = random.Random(1)
    parts = ["password: hunter22x", "API_KEY='abcdefgh1'", "token=secret:abcdefgh", "AKIA" + "A1" * 8, "AKIAAAAA", "0" * 32, "deadbeef" * 5, "user=alice", "key Zx9" + "aB3" * 9, "https://db.example.com/x", "ſecret: abcdefghij", "plain words", "\n\n", "\n"]
    for _ in range(400):
        t = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        strong, every = secrets.scan_text(t)
        assert strong == brute_spans(t) and set(strong) <= set(every)
    weak = "login: alice99\nkey Zx9aB3aB3aB3aB3aB3aB3aB3 at https://db.example.com/x"
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan_text(weak)[1]] == ["identifier", "key", "endpoint"]
    assert secrets.scan_text("key Zx9aB3aB3aB3aB3aB3aB3aB3 at https://db.example.com/x")[1] == []  # nothing to go with
    assert secrets.scan_text("login: alice99\n\n" + "word " * 3 + "\n\nkey Zx9aB3aB3aB3aB3aB3aB3aB3")[1] == []  # another scope
    rows = {r.doc_id: r for r in secrets.op8_secret_scan(spark, SF).collect()}
    for k, t in texts():
        spans = brute_spans(t)
        assert (rows[k].n_assign, rows[k].n_access, rows[k].n_hex) == tuple(sum(s[1] == i for s in spans) for i in range(3))
        assert rows[k].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[i]}:{a}:{b}" for a, i, b in spans).encode()).hexdigest()
    assert secrets.scan(edge_frame(spark)).count() == len(edge_rows()) and secrets.scan(edge_frame(spark, empty=True)).count() == 0


def substring_edits(parts, t):
    """Least edits of each part (of one length) against substrings of t, by the full table."""
    text, many = np.array(list(t)), np.array([list(p) for p in parts])
    row = np.zeros((len(parts), len(t) + 1), int)
    steps = np.arange(len(t) + 1)
    for k in range(many.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (many[:, k, None] != text))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(1)


def test_decontamination(spark):
    rnd = random.Random(5)
    items = [(i, decontaminate.normal(t)) for i, t in texts("benchmark", key="item_id")][:12]
    clean = [t for _, t in texts()]
    docs = []
    for _ in range(40):
        z = rnd.choice(items)[1]
        at = rnd.randrange(0, 40)
        docs.append(decontaminate.normal(f"{rnd.choice(clean)[:120]} {mutated(rnd, z[at : at + rnd.choice((70, 85, 100, 130))], rnd.randint(0, 12))} end"))
    windows = decontaminate.Windows(items)
    got = {(f[0], f[1]) for f in decontaminate.leaks_in(docs, windows)}
    want = set()
    every = [(windows.item[w], items[windows.item[w]][1][windows.at[w] : windows.at[w] + decontaminate.WINDOW]) for w in range(len(windows.size))]
    assert {len(p) for _, p in every} == {decontaminate.WINDOW}
    for n, d in enumerate(docs):
        near = substring_edits([p for _, p in every], d) <= decontaminate.WINDOW // decontaminate.EDITS
        want |= {(n, item) for (item, _), on in zip(every, near) if on}
    assert got == want and len(want) > 3
    bench = spark.createDataFrame([(i, t) for i, t in texts("benchmark", key="item_id")] + [(900, None), (901, ""), (902, "tiny")], "item_id bigint, text string")
    frame = edge_frame(spark, [*edge_rows(), (50, "Start. " + texts("benchmark", key="item_id")[3][1].upper() + " End.")])
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()] == [(50, 3)]
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and left.count() == len(edge_rows())
    assert decontaminate.leaks(edge_frame(spark, empty=True), bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.undo()
    assert many == {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} and many


def held_out(rows, labels, column):
    pairs = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([a == b for a, b in pairs])


def test_quality_model(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality_model.op1_quality_classifier(spark, sf).collect()
    assert held_out(rows, labels, "quality") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    some = [t.encode() for _, t in texts()[:40]] + [b"", b" ", b"x" * 3000]
    together, n = quality_model.encode(some)
    assert np.array_equal(together, np.concatenate([quality_model.encode([t])[0] for t in some])) and n[-3:].tolist() == [1, 1, 1]
    docs, lab = edge_frame(spark), spark.createDataFrame([(5, 1), (5, 1), (6, None), (None, 0)], "doc_id bigint, quality int")
    out = quality_model.score(docs, quality_model.fit(docs, lab, fold("doc_id", 5) >= 0)).collect()
    assert len(out) == len(edge_rows()) and {r.score for r in out} == {1.0}
    assert quality_model.score(edge_frame(spark, empty=True), quality_model.fit(docs, lab.limit(0), fold("doc_id", 5) >= 0)).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, n, y = rng.normal(size=(12, quality_model.FEATURES)).astype(np.float32), np.array([3, 4, 5]), np.array([1.0, 0, 1])
    model = quality_model.Model(x, n, y)
    z = (x - model.center) / model.scale
    cost = np.full(3, 1 / 3)

    def loss():
        p = 1 / (1 + np.exp(-model._forward(z, n)[5]))
        return -(cost * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for name, g in model._gradients(z, n, y, cost).items():
        w = model.weights[name]
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert np.isclose((up - down) / 2e-5, g[at], rtol=1e-3, atol=1e-7)


def test_toxicity(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op7_toxicity(spark, sf).collect()
    assert held_out(rows, labels, "toxic") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    docs, lab = edge_frame(spark), spark.createDataFrame([(5, 1), (5, 1), (6, None), (None, 0)], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, lab, fold("doc_id", 3) >= 0)).collect()
    assert len(out) == len(edge_rows()) and {r.score for r in out} == {0.0}
    assert toxicity.score(edge_frame(spark, empty=True), toxicity.fit(docs, lab.limit(0), fold("doc_id", 3) >= 0)).count() == 0


def test_maximal_segments():
    rnd = random.Random(6)

    def best(scores):  # the definition: the maximal one, then the same left and right of it
        top = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if top[0] <= 1e-12:
            return []
        i, j = top[2], top[3]
        return best(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in best(scores[j:])]

    lex = toxicity.Lexicon.__new__(toxicity.Lexicon)
    lex.scores, lex.stems, lex.roots = {"aaaa": 2.25, "bbbb": 4.125}, {}, {"aaaa", "bbbb"}
    for _ in range(300):
        words = [rnd.choice(["aaaa", "bbbb", "cccc", "dddd", "eeee"]) for _ in range(rnd.randint(0, 14))]
        got = [(a, b) for a, b, _ in lex.segments(words)]
        want = best([lex.score(w) for w in words])
        assert sum(lex.score(w) for a, b in got for w in words[a:b]) == pytest.approx(sum(lex.score(w) for a, b in want for w in words[a:b])) and len(got) == len(want)


def test_html(spark):
    trees = html_text.fit()
    writer, exact = html_text.Writer(99), 0
    for _ in range(150):
        page = writer.page()
        want = " ".join(t.replace(html_text.MARK, "").strip() for t in Page(page).text if html_text.MARK in t)
        exact += html_text.extract([page.replace(html_text.MARK, "")], trees)[0] == want
    assert exact >= 135
    for _, source in texts("pages", "html", "page_id"):
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", source, re.S)[1]
        parts = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert html_text.extract([source], trees) == [" ".join(filter(None, parts))]
    odd = ["", "plain <b>te</b>xt &lt;x", "<div>" * 3000 + "deep", "<p", "<script>a", "</p></p>", "<table><tr><td>a<td>b<tr>", "<!-- x"]
    assert len(html_text.extract(odd, trees)) == len(odd) and html_text.extract([""], trees) == [""]
    frame = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, "<p>x", "z")], "page_id bigint, url string, html string, text string")
    assert html_text.main_text(frame).count() == 3 and html_text.main_text(frame.limit(0)).count() == 0


def test_passages_of_items_are_found():
    rnd = random.Random(15)
    items = [(i, t) for i, t in ((i, decontaminate.normal(t)) for i, t in texts("benchmark", key="item_id")) if len(t) > 150]
    filler = " ".join(f"{rnd.choice('qxz')}{rnd.randint(0, 9999)}" for _ in range(60))
    docs, want = [], []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for _ in range(4):
            at = rnd.randrange(max(1, len(w) - 12))
            p = " ".join(w[at : at + 13])
            if len(p) >= 54:
                want.append((len(docs), i))
                docs.append(f"{filler} {p} {filler}")
    assert len(want) > 20 and sum(len(d) - 2 * len(filler) < 80 for d in docs) > 5
    assert set(want) <= {(f[0], f[1]) for f in decontaminate.leaks_in(docs, decontaminate.Windows(items))}
