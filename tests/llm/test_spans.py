"""Personal data and secrets against plain regular expressions on hard texts."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gondola.llm import arrays as A
from gondola.llm import pii, secrets
from gondola.llm import spans as S
from gondola.llm.span_queries import op4_pii, op10_secrets


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 14 <= len(digits(h)) <= 19 and luhn(digits(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 10 <= len(digits(h)) <= 15),
    ]
    return [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, keep) in enumerate(rules)
        for m in re.finditer(pattern, text)
        if keep(m.group())
    ]


def secret(text):
    assign = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    rules = [
        ("assign", assign, lambda m: len(m.group(2)) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ]
    return [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, keep) in enumerate(rules)
        for m in re.finditer(pattern, text)
        if keep(m)
    ]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)).encode()).hexdigest()


PARTS = [
    "a", "é", "😀", " ", "  ", "\n", ".", "-", "_", "@", "+", "(", ")", "1", "42", "255", "256", "0007", "4539578763621486",
    "4539 5787 6362 1486", "a.b@c.de", "x@y", "+1 (988) 555-2485", "10.0.0.1", "1.2.3.4.5.6.7.8", "password", "Token",
    "secret:", "API_KEY", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "/", "%",
]


def texts():
    random.seed(5)
    made = ["".join(random.choices(PARTS, k=random.randint(1, 25))) for _ in range(1500)]
    return [None, "", *made, "9" * 60_000, "a" * 60_000 + "@", "1 " * 30_000, "a@b.c_d@e.f", "+1((((" * 9000, "1." * 20_000]


@pytest.fixture(scope="module")
def hard(spark):
    rows = list(enumerate(texts()))
    return dict(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_base_pii_equals_plain_patterns(hard):
    data, df = hard
    got = df.select("doc_id", S.listed(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for row in got:
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(personal(data[row.doc_id] or "")))
        assert row.s == want, data[row.doc_id]


def test_base_secrets_equal_plain_patterns(hard):
    data, df = hard
    found, _ = secrets.find_secrets(df, keep=["doc_id"], rules=secrets.BASE)
    got = found.select("doc.doc_id", S.listed(F.col("spans")).alias("s")).collect()
    assert len(got) == len(data)
    for row in got:
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(secret(data[row.doc_id] or "")))
        assert row.s == want, data[row.doc_id]


def test_a_short_value_hides_the_name_in_it(spark):
    rows = [
        (1, "password: secret: abcdefghijklmnop"),
        (2, "token=secret 'x' secret: abcdefghijklmnop"),
        (3, 'api_key="Token":"abcdefghijklmnop"'),
        (4, "secret:passwd=abcdefg"),
    ]
    found, _ = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], rules=secrets.BASE)
    got = {r.doc.doc_id: sorted((s.start, s.rank, s.end, s.kind) for s in r.spans) for r in found.collect()}
    assert got == {i: sorted(secret(text)) for i, text in rows}
    assert not got[1] and not got[3] and len(got[2]) == len(got[4]) == 1


@pytest.mark.parametrize("build, brute", [(op4_pii, personal), (op10_secrets, secret)])
def test_queries(spark, build, brute):
    sf = "/root/testdata/sf0.001"
    data = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = build(spark, sf).collect()
    assert len(got) == len(data)
    for row in got:
        want = brute(data[row.doc_id])
        assert row.base_sha256 == digest(want)
        listed = [f"{k}:{a}:{b}" for a, _, b, k in sorted(want)]
        assert set(listed) <= set(row.spans.split(",")) if listed else True
        for kind in {k for *_, k in want}:
            assert row[f"n_{kind}"] == sum(k == kind for *_, k in want)


def test_context_discovers_unseen_identifiers(spark):
    known = [f"please call my number +1 555 010 {i:04d} after work" for i in range(12)]
    unseen = ["please call my number 555-0199-77 after work", "please call my number 555-0188-66 after work"]
    other = [f"the year was {1900 + i} and it rained" for i in range(30)]
    rows = list(enumerate([*known, *unseen, *other, None, ""]))
    got = {r.doc.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert [s.kind for s in got[i].spans] == ["phone"]
    for i in (12, 13):
        (span,) = got[i].spans
        assert not got[i].base and rows[i][1][span.start : span.end] == rows[i][1].split()[4] and span.kind == "phone"
    assert all(not got[i].spans for i in range(14, len(rows)))


def test_redacted_texts(spark):
    rows = [(1, "mail a.b@c.de or 10.0.0.1 now", "x", 29), (1, None, "x", None), (None, "plain é", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    got = sorted(map(tuple, pii.redact(df).collect()), key=str)
    want = [(1, "mail [EMAIL] or [IP] now", "x", 24), (1, None, "x", None), (None, "plain é", None, 7)]
    assert got == sorted(want, key=str)


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([("a", "token=abcdefghijklmno"), ("b", "token=abcdefghijklmno"), ("c", None)], "path string, text string")
    found, ledger = secrets.find_secrets(first, ["path"])
    assert ledger.select("blob").distinct().count() == 2
    assert {r.doc.path: len(r.spans) for r in found.collect()} == {"a": 1, "b": 1, "c": 0}
    later = first.unionByName(spark.createDataFrame([("d", "AKIA" + "Q" * 16)], "path string, text string"))
    assert secrets.scan(later, ledger).select("blob").distinct().count() == 1
    newer = (*secrets.RULES[:-1], secrets.Rule("chat_token", 2, r"token=[a-z]+"))
    fresh = secrets.scan(first, ledger, newer)
    assert {(r.rule, r.version) for r in fresh.collect()} == {("chat_token", 2)} and fresh.count() == 2
    both, _ = secrets.find_secrets(later, ["path"], ledger, newer)
    assert {r.doc.path: len(r.spans) for r in both.collect()} == {"a": 2, "b": 2, "c": 0, "d": 1}


def test_a_ledger_of_earlier_calls_changes_no_finding(spark):
    words = ["token=abcdefghijklmno", "AKIA" + "Q" * 16, "0123456789abcdef0", "plain", "", "eyJabcdefghi.eyJabcdefghi.abcdefghij"]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))) if i % 9 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, _ = secrets.find_secrets(docs, ["doc_id"])
    early = docs.where(secrets.blob_of(F.coalesce("text", F.lit(""))) < "8")
    ledger = secrets.scan(early)
    assert 0 < ledger.select("blob").distinct().count() < docs.select("text").distinct().count()
    assert secrets.scan(docs, ledger).join(ledger, ["blob", "rule", "version"]).count() == 0
    after, whole = secrets.find_secrets(docs, ["doc_id"], ledger)
    listed = lambda df: sorted((r.doc.doc_id, sorted(map(tuple, r.spans))) for r in df.collect())
    assert listed(after) == listed(plain)
    assert whole.count() == whole.select("blob", "rule", "version").distinct().count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, doc string, blob string, spans string")
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).columns == empty.columns
    assert secrets.find_secrets(empty, ["doc_id"])[0].count() == 0


def test_very_many_matches_in_one_text(spark):
    n = 50_000
    text = "".join(f"wörd a{i}@ex.com, " for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "wörd [EMAIL], " * n, 2: None}


def test_running_values_and_cuts(spark):
    sizes = [0, 1, 255, 256, 257, 512, 1000]
    df = spark.createDataFrame([(n, [i % 7 for i in range(n)], "aé😀x" * n) for n in sizes], "n int, v array<int>, text string")
    spans = F.transform("v", lambda x, i: F.struct((i * 4 + 1).alias("start"), (i * 4 + 3).alias("end")))
    for r in df.select("*", A.sums(F.col("v")).alias("sums"), A.maxima(F.col("v")).alias("top"), A.cuts(F.col("text"), spans).alias("parts")).collect():
        assert r.sums == list(itertools.accumulate(r.v))
        assert r.top == list(itertools.accumulate(r.v, max))
        assert r.parts == ["é😀"] * r.n


def test_lowest_rank_of_overlaps(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        span = lambda: (lambda s: (s, rng.randrange(3), s + rng.randint(1, 9), "k"))(rng.randrange(400))
        rows.append((k, [span() for _ in range(k * 30)], [(s, e) for s, _, e, _ in (span() for _ in range(k * 15))]))
    df = spark.createDataFrame(rows, f"k int, base {S.SPANS}, x array<struct<start:int,end:int>>")
    for r in df.select("*", S.lowest_rank(F.col("base"), F.col("x"), 3).alias("got")).collect():
        want = [(x.start, x.end, min((b.rank for b in r.base if b.start < x.end and x.start < b.end), default=-1)) for x in r.x]
        assert sorted((g.x.start, g.x.end, -1 if g.rank is None else g.rank) for g in r.got) == sorted(want)
