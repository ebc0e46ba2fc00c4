"""Token ids: units, packing, token files and sampled pieces."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gondola.llm import packing, pieces, token_files, tokens
from gondola.llm.staging import shared_path
from gondola.llm.token_queries import op1_packing, op2_sampled_pieces, op7_token_planes

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_ids(texts, end):
    found = Tokenizer.from_file(PATH).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, end] for e in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_give_the_ids_of_whole_texts():
    parts = [
        "a", "Word", " ", "  ", "\n", "\t", "é", "'s", "'", "n't", ".", ",", "!!", "###", "1", "42", "²", "α", "中文",
        "\xa0", "　", "<|endoftext|>", "_", "|", "\x1c", "ß", "Ā", "́", "😀", "\r\n", "it's", "THE!!", "\x85",
    ]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(8000)] + ["a" * 5000, ""]
    encode = tokens.encoder(PATH)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want


def check_packing(rows, docs, end=0):
    """Every id in exactly one piece, sequences gapless and full but for the last."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id, r.doc_tokens].append(r)
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for at, pieces_ in per_sequence.items():
        filled = 0
        for offset, length in sorted(pieces_):
            assert offset == filled
            filled += length
        assert filled <= 1024 and (filled == 1024 or at == max(per_sequence))
    want = Counter()
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs], end), strict=True):
        want[doc_id] += len(ids)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    return per_doc


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World, it's\n fine", "", " a", "x" * 5000, "ÀB c."]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(path)(texts)] == want


def test_caches_forget_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcé,.1\n", k=rng.randint(0, 6))) for _ in range(40)) for _ in range(60)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    encode = tokens.encoder(PATH)
    got = [x for i in range(0, 60, 7) for x in encode(texts[i : i + 7])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_op1_against_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op1_packing(spark, SF).collect()
    per_doc = check_packing(rows, docs)
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs], 0), strict=True):
        at = 0
        for r in sorted(per_doc[doc_id, len(ids)], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_packing_hard_rows(spark, hard_docs, no_docs):
    rows, df = hard_docs
    check_packing(packing.pack(df, PATH).collect(), [(r[0], r[1]) for r in rows])
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_keeps_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, ["hot", "b", "c"][min(2, rng.randrange(9) // 3 if i % 3 else 0)], rng.randint(1, 3000)) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "row long, source string, n long")
    targets = spark.createDataFrame([("hot", 0.5), ("b", 0.3), ("c", 0.2)], "source string, weight double")
    laid = packing.layout(sizes, targets).join(sizes.select("row", "source"), "row")
    shares = defaultdict(dict)
    for r in packing.mixture(laid).collect():
        shares[r.window_id][r.source] = r.tokens
    left = {s: sum(n for _, source, n in rows if source == s) for s in ("hot", "b", "c")}
    window = 1024 * 32
    for k in range(1, int(min(left[s] / (w * window) for s, w in (("hot", 0.5), ("b", 0.3), ("c", 0.2))))):
        for s, w in (("hot", 0.5), ("b", 0.3), ("c", 0.2)):
            # The deficit carried over is less than one piece.
            sent = sum(shares[j].get(s, 0) for j in range(1, k + 1))
            assert 0 <= k * w * window - sent < 1024


@pytest.mark.parametrize("flatten", [0.0, 0.5, 1.0])
def test_flattened_mixture(spark, flatten):
    rows = [(i, "hot" if i % 10 else "rare", 1 + i * 37 % 900) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "row long, source string, n long")
    total = {s: sum(n for _, source, n in rows if source == s) for s in ("hot", "rare")}
    weight = {s: n**flatten for s, n in total.items()}
    quantum = {s: w / sum(weight.values()) * 1024 * 32 for s, w in weight.items()}
    laid = packing.layout(sizes, flatten=flatten).join(sizes.select("row", "source"), "row")
    sent = defaultdict(dict)
    for r in packing.mixture(laid).collect():
        sent[r.source][r.window_id] = r.tokens
    assert {s: sum(w.values()) for s, w in sent.items()} == total
    for s in total:
        for k in range(1, int(total[s] / quantum[s])):
            assert 0 <= k * quantum[s] - sum(sent[s].get(j, 0) for j in range(1, k + 1)) < 1024


def test_sequences_are_padded_to_powers_of_two(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "s") for i in range(9)], "doc_id long, text string, source string")
    got = packing.sequences(packing.pack(docs, PATH)).orderBy("sequence_id").collect()
    sizes = [len(r.ids) // 4 for r in got]
    assert all(n == 1024 for n in sizes[:-1]) and sizes[-1] & (sizes[-1] - 1) == 0
    assert sizes[-1] >= got[-1].length > sizes[-1] // 2


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000, 65_536):
        ids = rng.integers(0, 2**32 if n == 1000 else 50_257, n).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()


def test_op7_against_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = {}, 0
    for (doc_id, _), ids in zip(docs, plain_ids([t for _, t in docs], 2), strict=True):
        want[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op7_token_planes(spark, SF).collect()} == want


@pytest.mark.parametrize("kind, block", [("bit", 97), ("byte", 4096)])
def test_token_files_hard_rows(spark, hard_docs, no_docs, kind, block):
    rows, df = hard_docs
    path = shared_path(spark, "test-ids")
    token_files.write_ids(df, path, PATH, 2, kind, block)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    ids = [plain_ids([t], 2)[0] for _, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == [0, *itertools.accumulate(map(len, ids))][:-1]
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n_ids for r in index) == sum(map(len, ids)) and all(r.n_ids <= block for r in index)
    empty = shared_path(spark, "test-ids")
    token_files.write_ids(no_docs, empty, PATH, 2)
    assert token_files.read_ids(spark, empty).count() == 0


def test_pieces_are_lossless_and_reproducible(spark, hard_docs, no_docs):
    rows, df = hard_docs
    one = pieces.encode(df, MODEL, seed=1)
    decoded = pieces.decode(one, MODEL).collect()
    order = lambda x: sorted(x, key=str)
    assert order((r.doc_id, r.text) for r in decoded) == order((r[0], r[1] or "") for r in rows)
    again = pieces.encode(df.repartition(2), MODEL, seed=1).collect()
    assert order((r.doc_id, bytes(r.ids)) for r in again) == order((r.doc_id, bytes(r.ids)) for r in decoded)
    other = pieces.encode(df, MODEL, seed=2).collect()
    assert order(bytes(r.ids) for r in other) != order(bytes(r.ids) for r in decoded)
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_samples_follow_the_lattice():
    """Shares of all segmentations of a word, drawn often, against their enumeration."""
    model = pieces.lattices(MODEL)
    unit = "▁then"
    ways = []
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(unit)]
        parts = [unit[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(p in model.pieces for p in parts):
            ways.append((tuple(model.pieces[p][0] for p in parts), sum(model.pieces[p][1] for p in parts)))
    total = sum(math.exp(w) for _, w in ways)
    n = 40_000
    drawn = Counter(tuple(np.frombuffer(x, "<u4").tolist()) for x in pieces.encode_texts(["then"] * n, list(range(n)), MODEL))
    assert set(drawn) <= {w for w, _ in ways}
    for way, weight in ways:
        share = math.exp(weight) / total
        assert abs(drawn[way] / n - share) < 5 * math.sqrt(share / n) + 1e-4


def test_op2_keeps_every_text(spark):
    want = {r.doc_id: r.sha for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).collect()}
    assert {r.doc_id: r.text_sha256 for r in op2_sampled_pieces(spark, SF).collect()} == want
