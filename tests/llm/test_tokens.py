import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gridloom.llm import bpe
from tests.llm.helpers import edge_frame, edge_rows, texts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tools():
    ranks = bpe.read_ranks(PATH)
    return bpe.PairTable(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken(tools):
    table, reference = tools
    rnd = random.Random(1)
    letters = "ab 'stre\n\t\r\x1c\x85\xa0 é漢字12³½!?… 　ld́​🎉"
    data = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["a" * 5000, "ab" * 3000, "", "漢" * 900, "<|endoftext|>"] + [t for _, t in texts()[:60]]
    ids, n = bpe.Encoder(table, P.PATTERN).encode(data)
    ends = np.concatenate([[0], np.cumsum(n)])
    assert all(ids[a:b].tolist() == reference.encode_ordinary(t) for t, a, b in zip(data, ends, ends[1:]))
    raw, _ = table.decode(ids)
    assert raw.tobytes() == "".join(data).encode()
    with pytest.raises(ValueError):
        table.decode(np.array([60000]))


def test_other_pattern_and_vocabulary(tools):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    table = bpe.PairTable(ranks)
    assert bpe.Encoder(table, r"\S+|\s+").encode(["abc bc"])[0].tolist() == [257, 32, 258]


def test_query_and_edges(spark, tools):
    _, reference = tools
    out = bpe.digests(edge_frame(spark), PATH, with_ids=True).collect()
    want = sorted(((k is None, k or 0, hashlib.sha256((t or "").encode()).hexdigest(), len(reference.encode_ordinary(t or ""))) for k, t in edge_rows()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256, r.n_tokens) for r in out) == want
    assert all(len(r.token_ids) == r.n_tokens and r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest() for r in out)
    encoded = bpe.encode(edge_frame(spark), PATH)
    assert {(r.doc_id, bytes(r.content)) for r in bpe.decode(encoded, PATH).collect()} == {(k, (t or "").encode()) for k, t in edge_rows()}
    assert bpe.digests(edge_frame(spark, empty=True), PATH).count() == 0
