import random

import duckdb

SF = "/root/testdata/sf0.001"


def texts(table="documents", column="text", key="doc_id"):
    return duckdb.connect().execute(f"SELECT {key}, {column} FROM '{SF}/{table}.parquet' ORDER BY 1").fetchall()


def edge_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a repeated key, and characters beyond the basic plane."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    some = "The quick brown fox jumps over the lazy dog and runs away. " * 4
    return [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, some), (6, some), (6, some), (7, "a"), (7, "different text of one key"), (None, some), (8, "𝒳😀 é x\x00y"), (9, "x" * 5000)]


def edge_frame(spark, rows=None, empty=False):
    """With extra columns whose names clash with those the operators use inside."""
    data = [] if empty else [(k, t, "z", 5, 1.5, "q", 2) for k, t in (edge_rows() if rows is None else rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, h string, row int, key double, label string, n_chars bigint").repartition(3)


def mutated(rnd: random.Random, s: str, edits: int, letters="abcxyz ") -> str:
    p = list(s)
    for _ in range(edits):
        at, r = rnd.randrange(len(p)), rnd.random()
        if r < 0.4:
            p[at] = rnd.choice(letters)
        elif r < 0.7 and len(p) > 1:
            del p[at]
        else:
            p.insert(at, rnd.choice(letters))
    return "".join(p)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]
