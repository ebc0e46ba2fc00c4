"""Periodic runs against their definition, and the planted query against the contract written out plainly."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from gondola.llm import periodic_runs as P
from gondola.llm import run_queries


def plain_runs(w, words=6, copies=4):
    """Every stretch tried by its definition."""
    n, found = len(w), set()
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(words, copies * q):
                part = w[i : j + q]
                if all(any(part[k] != part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    for size in (0, 1, 5, 6, 7, 30):
        for letters in (1, 2, 3):
            yield [rng.choice("abc"[:letters]) for _ in range(size)]
    for _ in range(60):
        made = []
        while len(made) < rng.choice([40, 200, 500]):
            unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12, 16, 17, 31, 33, 50]))]
            made += (unit * 7)[: int(len(unit) * rng.choice([1, 1, 3.9, 4, 4.5, 6.3]))]
        yield made
    nested = ["a", "b", "a", "b", "a", "b", "a", "b", "c"] * 5
    yield nested * 4 + ["x"] + nested


def test_runs_are_those_of_the_definition():
    for words in texts():
        ids = P.numbered([x.encode() for x in words])
        assert P.runs(ids) == plain_runs(words), words


def test_long_periods_in_a_long_text():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4)
    prose = [word() for _ in range(20_000)]
    unit = [word() for _ in range(4_097)]
    w = P.numbered([x.encode() for x in prose + unit * 4 + unit[:100] + prose[:3_000] + ["z"] * 200_000])
    found = P.runs(w)
    assert any(p == 4_097 and length >= 4 * 4_097 + 100 for _, length, p in found)
    assert any(p == 1 and length >= 200_000 for _, length, p in found)
    assert not any(p > 1 and s > 50_000 for s, _, p in found)


def expected(doc_id, text):
    words = [] if text is None else text.encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_on_hard_and_planted_rows(spark, hard_docs, no_docs, tmp_path):
    rows, docs = hard_docs
    rng = random.Random(3)
    more = [(1_000 + i, " ".join(rng.choice(["a", "b", "c\x0b", "d e"]) for _ in range(rng.randint(0, 90))), "en", "a", 1, 1, 1) for i in range(300)]
    short = [r for r in rows if r[1] is None or len(r[1]) < 5_000] + more
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in short) > 20
    path = str(tmp_path)
    spark.createDataFrame(short, docs.schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    got = sorted(map(tuple, run_queries.op13_periodic_runs(spark, path).collect()), key=str)
    assert got == sorted((expected(r[0], r[1]) for r in short), key=str)
    none = P.find_runs(no_docs, keep=["doc_id"])
    assert none.count() == 0 and none.columns == ["doc", "runs", "strongest", "collapsed"]
    long = P.find_runs(docs.where("doc_id = 7"), keep=["doc_id"]).first()
    assert long.collapsed == " ".join(next(r[1] for r in rows if r[0] == 7).split()) or long.runs


def test_clashing_names_come_back(spark):
    df = spark.createDataFrame([("x x x x x x x y", 1, 2, 3)], "text string, doc int, runs int, `a.b` int")
    row = P.find_runs(df, keep=["text", "doc", "runs", "a.b"]).first()
    assert (row.doc["doc"], row.doc["runs"], row.doc["a.b"]) == (1, 2, 3)
    assert [tuple(r) for r in row.runs] == [(0, 7, 1)] and row.collapsed == "x y"


def test_masks():
    assert list(np.flatnonzero(P.collapsed(9, [(0, 6, 1), (3, 6, 1)]))) == [0]
