"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over bytes (order 4, digits as one), so n-grams are exact integers and a
suffix or a context is a mask or a shift. It is trained on trusted text: documents
labelled good and not toxic, but for one of ``HELD`` that is held out.

1. Documents are dealt into blocks by hash. A block sends its distinct n-grams with
   their trusted counts, so what is shuffled follows the vocabulary, not the text.
2. Counts are summed, lower orders follow as counts of distinct continuations, and
   joins of n-grams, contexts and discounts give the probability of every distinct
   n-gram any block asked for.
3. Each block gets the probabilities it asked for and scores its documents.
4. A document is rejected if its mean negative log probability per byte, less an
   allowance for short texts, lies beyond its language's fence: the ``TOP`` quantile of
   the documents labelled good that the model was not trained on. Languages with few of
   them use the fence over all languages; without any, those of the training count.

The texts are shuffled once: both passes read the same exchange in one plan.

Defined results: texts that are null or empty have no perplexity and are kept; without
trusted text all documents are kept; null ids are never trusted; repeated rows are
scored alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.staging import slices, staged, text_or_empty

ORDER = 4
BLOCK_CHARS = 16_000_000
#: Allowance for short texts, in nats times the square root of the bytes.
SHORT = 8.0
#: One of so many trusted documents is held out of the training, and the quantile of the costs not trained on.
HELD, TOP = 8, 0.995
#: Documents outside the training a language needs for a fence of its own.
LEAST_TRUSTED = 50

_PART = 1_000_000
_BYTES = np.arange(256, dtype=np.int64)
_BYTES[ord("0") : ord("9") + 1] = ord("0")


def grams(text: str) -> np.ndarray:
    """The n-gram ending at each byte, as integers; the start is padded with byte 1."""
    raw = b"\x01" * (ORDER - 1) + text.encode("utf-8", "surrogatepass")
    values = _BYTES[np.frombuffer(raw, np.uint8)]
    out = np.zeros(len(values) - ORDER + 1, np.int64)
    for j in range(ORDER):
        out = (out << 8) | values[j : len(values) - ORDER + 1 + j]
    return out


def _parts(table: pa.Table):
    """(ids, texts) of a few rows at a time, about ``_PART`` characters."""
    names: list = []
    texts: list[str] = []
    size = 0
    for batch in slices(table.select(["doc_id", "doc"]).to_batches()):
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("doc").field("text").to_pylist(), strict=True):
            names.append(name)
            texts.append(text or "")
            size += len(texts[-1])
            if size > _PART:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def _ask(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct n-grams of a block with their counts in trusted documents."""
    good = set(trusted["doc_id"].to_pylist())
    known = np.empty(0, np.int64)
    counts = np.empty(0, np.int64)
    for names, texts in _parts(docs):
        for wanted in (True, False):
            own = [grams(text) for name, text in zip(names, texts, strict=True) if text and (name in good) == wanted]
            if own:
                found, n = np.unique(np.concatenate(own), return_counts=True)
                every, at = np.unique(np.concatenate([known, found]), return_inverse=True)
                total = np.zeros(len(every), np.int64)
                np.add.at(total, at[: len(known)], counts)
                if wanted:
                    np.add.at(total, at[len(known) :], n)
                known, counts = every, total
    block = docs["block"][0].as_py() if docs.num_rows else -1
    return pa.table(
        {"block": pa.array([block] * len(known), pa.int32()), "gram": pa.array(known, pa.int64()), "n": pa.array(counts, pa.int64())}
    )


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Mean negative log probability per byte of each document of a block."""
    order = np.argsort(answers["gram"].to_numpy())
    known, costs = answers["gram"].to_numpy()[order], answers["cost"].to_numpy()[order]
    means = np.full(docs.num_rows, np.nan)
    sizes = np.zeros(docs.num_rows, np.int64)
    done = 0
    for _, texts in _parts(docs):
        some = [done + i for i, text in enumerate(texts) if text]
        done += len(texts)
        if not some:
            continue
        own = [grams(text) for text in texts if text]
        each = np.array([len(x) for x in own])
        every = np.concatenate(own)
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        if not (known[at] == every).all():
            raise ValueError("an n-gram of the block was not answered")
        means[some] = np.add.reduceat(costs[at], np.cumsum(each) - each) / each
        sizes[some] = each
    cost = pa.array(means, pa.float64(), mask=np.isnan(means)) if len(means) else pa.array([], pa.float64())
    return pa.table({"doc": docs["doc"], "cost": cost, "bytes": pa.array(sizes, pa.int64())})


def _levels(gram: str = "gram") -> F.Column:
    """(level, suffix, longer): the suffixes of an n-gram, each with the one that is a byte longer."""
    masks = [(1 << (8 * level)) - 1 for level in range(1, ORDER + 2)]
    g = F.col(gram)
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(level).alias("level"),
                    g.bitwiseAND(F.lit(masks[level - 1])).alias("suffix"),
                    g.bitwiseAND(F.lit(masks[level])).alias("longer"),
                )
                for level in range(1, ORDER + 1)
            ]
        )
    )


def probabilities(asked: DataFrame) -> DataFrame:
    """(gram, cost): negative log probability of every distinct n-gram of ``asked`` (gram, n)."""
    totals = asked.groupBy("gram").agg(F.sum("n").alias("n"))
    seen = totals.where("n > 0").select(_levels().alias("x"), "n").select("x.*", "n")
    counts = (
        seen.groupBy("level", "suffix", "longer")
        .agg(F.sum("n").alias("n"))
        .groupBy("level", "suffix")
        .agg(F.sum("n").alias("_raw"), F.count(F.lit(1)).alias("_kinds"))
        .select("level", "suffix", F.when(F.col("level") == ORDER, F.col("_raw")).otherwise(F.col("_kinds")).alias("c"))
    )
    context = F.shiftright("suffix", 8)
    number = lambda condition: F.sum(condition.cast("int"))
    contexts = counts.groupBy("level", context.alias("context")).agg(
        F.sum("c").alias("all"),
        number(F.col("c") == 1).alias("k1"),
        number(F.col("c") == 2).alias("k2"),
        number(F.col("c") >= 3).alias("k3"),
    )
    of = counts.groupBy("level").agg(*[number(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    plain = (F.col("n1") == 0) | (F.col("n2") == 0) | (F.col("n3") == 0)
    discounts = of.select(
        "level",
        *[
            F.when(plain, F.lit(0.5)).otherwise(
                F.greatest(F.lit(0.0), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
            ).alias(f"d{i}")
            for i in (1, 2, 3)
        ],
    )
    wanted = totals.select("gram", _levels().alias("x")).select("gram", "x.level", "x.suffix")
    c = F.coalesce("c", F.lit(0))
    off = F.when(c == 0, F.lit(0.0)).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    back = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("all")
    parts = (
        wanted.select("level", "suffix")
        .distinct()
        .join(counts, ["level", "suffix"], "left")
        .withColumn("context", context)
        .join(contexts, ["level", "context"], "left")
        .join(F.broadcast(discounts), "level", "left")  # one row per level
        .select(
            "level",
            "suffix",
            F.when(F.col("all").isNull(), F.lit(0.0)).otherwise((c - off) / F.col("all")).alias("own"),
            F.when(F.col("all").isNull(), F.lit(1.0)).otherwise(back).alias("back"),
        )
    )
    by_level = wanted.join(parts, ["level", "suffix"]).groupBy("gram").agg(
        *[F.max(F.when(F.col("level") == i, F.col(k))).alias(f"{k}{i}") for i in range(1, ORDER + 1) for k in ("own", "back")]
    )
    p = F.lit(1 / 256)
    for i in range(1, ORDER + 1):
        p = F.col(f"own{i}") + F.col(f"back{i}") * p
    return by_level.select("gram", (-F.log(p)).alias("cost"))


def _good(labels: DataFrame, condition: F.Column | bool = True) -> DataFrame:
    good = (F.col("quality") == 1) & F.col("doc_id").isNotNull() & F.lit(condition)
    return labels.where(good).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _trusted(labels: DataFrame) -> DataFrame:
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0
    return _good(labels, F.coalesce(F.col("toxic"), F.lit(0)) == 0).where(~held)


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, cost, bytes): each document with its mean negative log probability per byte."""
    chars = docs.agg(F.sum(F.length(text_or_empty()).cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    doc_id = F.col("doc_id").cast("long")
    block = lambda of: F.pmod(F.xxhash64(of), F.lit(blocks)).cast("int").alias("block")
    # Rows without an id are spread by their text.
    place = F.coalesce(doc_id, F.xxhash64(text_or_empty()))
    dealt = docs.select(block(place), doc_id.alias("doc_id"), F.struct("*").alias("doc")).repartition(blocks, "block")
    good = _trusted(labels).select(block(F.col("doc_id")), "doc_id")
    asked = dealt.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_ask, "block int, gram long, n long")
    answers = asked.select("block", "gram").join(probabilities(asked.select("gram", "n")), "gram").select("block", "gram", "cost")
    schema = f"doc {docs.select(F.struct('*').alias('doc')).schema['doc'].dataType.simpleString()}, cost double, bytes long"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, schema)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, perplexity, threshold, kept): ``doc`` holds the columns ``keep`` (all by default)."""
    named = docs if keep is None else docs.select(*dict.fromkeys([*keep, "doc_id", "lang", "text"]))
    fields = [F.col(f"doc.{c}").alias(c) for c in (docs.columns if keep is None else keep)]
    scored = staged(
        perplexities(named, labels).select(
            F.struct(*fields).alias("doc"),
            F.col("doc.doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("doc.lang").cast("string"), F.lit("")).alias("lang"),
            "cost",
            (F.col("cost") - SHORT / F.sqrt("bytes")).alias("adjusted"),
        ),
        "perplexities",
    )
    costs = scored.select("doc_id", "lang", "adjusted")
    trusted = costs.join(_trusted(labels), "doc_id", "left_semi")
    unseen = costs.join(_good(labels).join(_trusted(labels), "doc_id", "left_anti"), "doc_id", "left_semi")
    spot = F.percentile_approx("adjusted", TOP, 10_000)
    overall = unseen.select(spot).first()[0]
    if overall is None:
        unseen = trusted
        overall = unseen.select(spot).first()[0]
    fences = (
        unseen.groupBy("lang")
        .agg(spot.alias("fence"), F.count("adjusted").alias("n"))
        .where(F.col("n") >= LEAST_TRUSTED)
        .select("lang", "fence")
    )
    limit = F.coalesce("fence", F.lit(overall).cast("double"))
    return scored.join(fences, "lang", "left").select(
        "doc",
        F.exp("cost").alias("perplexity"),
        F.exp(limit).alias("threshold"),
        F.coalesce(F.col("adjusted") <= limit, F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects."""
    return judge(docs, labels).where("kept").select("doc.*")
