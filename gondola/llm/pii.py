"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. These
seed a search for identifiers the patterns miss: every identifier-like string is an
instance, the words around it are lexical patterns, and both score each other in
turn. A pattern's confidence is the share of known instances among the distinct
instances it surrounds; an instance's score joins the confidences of its patterns.
What scores high and holds five digits or an at sign is added under the seeds' kind.

All patterns are possessive and start at the beginning of a run, so a text of any
length is searched in linear time. Only distinct (pattern, instance) pairs are
joined, so a frequent word or identifier counts once per partner.

Defined results: null text is empty and has no spans; null and repeated doc_ids keep
one row per input row; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm import spans as S
from gondola.llm.staging import kept_columns, staged, text_or_empty
from gondola.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The four kinds of identifiers.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A run of identifier characters that holds a digit or an at sign, with further runs of digits after blanks.
INSTANCE = (
    r"(?<![A-Za-z0-9._%+@()#-])(?=[A-Za-z._%+()#-]*+[0-9@])[A-Za-z0-9._%+@()#-]++"
    r"(?:\x20[(]?[0-9][A-Za-z0-9._%+@()#-]*+)*+"
)
#: Characters beside an instance that are searched for words.
CONTEXT = 60
ROUNDS = 3
#: Distinct seeds a pattern needs, and the score that makes an instance an identifier.
SUPPORT, SCORE = 3, 0.6


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four fixed patterns."""
    many = lambda hit, low, high: F.length(_digits(hit)).between(low, high)
    return F.concat(
        S.find(text, EMAIL, "email", 0, F.contains(text, F.lit("@"))),
        S.find(text, IP, "ip", 1, text.rlike(r"[0-9]\.[0-9]"), lambda h: h.rlike(IP_PARTS)),
        S.find(
            text, CARD, "card", 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
            lambda h: many(h, 14, 19) & _luhn(_digits(h)),
        ),
        S.find(text, PHONE, "phone", 3, F.contains(text, F.lit("+")), lambda h: many(h, 10, 15)),
    )


def _instances(text: Column) -> Column:
    """array of (start, end, instance, patterns) of all identifier-like strings of a text."""

    def one(m: Column) -> Column:
        led = F.regexp_replace(m["hit"], r"^[._%)#-]+", "")
        core = F.regexp_replace(led, r"[._%(#+-]+$", "")
        start = m["start"] + F.length(m["hit"]) - F.length(led)
        left = F.lower(F.substring(m["before"], -CONTEXT, CONTEXT))
        right = F.lower(F.substring(m["after"], 1, CONTEXT))
        l1, l2 = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
        r1, r2 = F.regexp_extract(right, r"^\s*(\S+)", 1), F.regexp_extract(right, r"^\s*(\S+\s+\S+)", 1)
        patterns = F.array(
            F.when(l2 != "", F.concat(F.lit("L "), l2)),
            F.when((l1 != "") & (r1 != ""), F.concat_ws(" ", F.lit("M"), l1, r1)),
            F.when(r2 != "", F.concat(F.lit("R "), r2)),
        )
        return F.struct(
            start.alias("start"),
            (start + F.length(core)).alias("end"),
            F.lower(core).alias("instance"),
            F.array_compact(patterns).alias("patterns"),
        )

    kind = "array<struct<start:int,end:int,instance:string,patterns:array<string>>>"
    found = F.transform(S.matches(text, INSTANCE), one)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(kind))


def learn(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, rank, score): all scored instances after ``rounds`` of pattern and instance scoring.

    ``edges`` are distinct (pattern, instance) pairs, ``seeds`` (instance, rank).
    """
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = seeds.select("instance", "rank", F.lit(1.0).alias("score"), F.lit(1).alias("seed"))
    scored = known
    for _ in range(rounds):
        sums = (
            edges.join(scored, "instance")
            .groupBy("pattern", "rank")
            .agg(F.sum("score").alias("weight"), F.sum("seed").alias("seeds"))
            .where(F.col("seeds") >= SUPPORT)
        )
        sure = sums.join(sizes, "pattern").select(
            "pattern", "rank", (F.col("weight") / (F.col("n") + 1)).alias("confidence")
        )
        told = (
            edges.join(sure, "pattern")
            .groupBy("instance", "rank")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
            .join(known.select("instance"), "instance", "left_anti")
        )
        best = told.groupBy("instance").agg(F.max_by("rank", F.struct("score", -F.col("rank"))).alias("rank"), F.max("score").alias("score"))
        scored = cut_lineage(known.unionByName(best.withColumn("seed", F.lit(0))))
    return scored


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, base, spans): per input row the columns ``keep`` (all by default), fixed and all spans."""
    doc = kept_columns(docs.columns if keep is None else keep)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), text_or_empty().alias("text"))
    found = staged(
        rows.select("row", "doc", base_spans(F.col("text")).alias("base"), _instances(F.col("text")).alias("instances")),
        "pii",
    )
    ranked = S.lowest_rank(F.col("base"), F.col("instances"), len(KINDS))
    each = found.select("row", F.explode(ranked).alias("z")).select("row", "z.x.*", "z.rank")
    edges = cut_lineage(each.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    seeds = cut_lineage(each.where("rank is not null").groupBy("instance").agg(F.min("rank").alias("rank")))
    names = F.array(*[F.lit(k) for k in KINDS])
    new = learn(edges, seeds).where((F.col("seed") == 0) & (F.col("score") >= SCORE))
    new = new.where(F.contains("instance", F.lit("@")) | (F.length(_digits(F.col("instance"))) >= 5))
    added = (
        each.where("rank is null")
        .select("row", "start", "end", "instance")
        .join(new.select("instance", "rank"), "instance")
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct("start", "rank", "end", F.element_at(names, F.col("rank") + 1).alias("kind"))
            ).alias("added")
        )
    )
    return found.select("row", "doc", "base").join(added, "row", "left").select(
        "doc", "base", F.concat("base", F.coalesce("added", S.empty_spans())).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data replaced by its kind in brackets; n_chars follows where present."""
    made = find_pii(docs)
    text = S.masked(F.col("doc")["text"], F.col("spans"))
    out = made.select("doc", text.alias("_text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            count = F.length("_text").cast(docs.schema["n_chars"].dataType)
            columns.append(F.coalesce(count, F.col("doc")["n_chars"]).alias("n_chars"))
        else:
            columns.append(F.col("doc")[c].alias(c))
    return out.select(*columns)
