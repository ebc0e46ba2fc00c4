"""Secret scans over all historical versions, with an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content. The ledger
holds one row per (blob, rule, rule version) ever scanned, with what was found; only
pairs missing from it are scanned, each distinct blob once, and findings are joined
back to all paths that hold the blob. A new rule version or a new text is therefore
the only cause of work. DataFrame operations only.

Defined results: null text is the blob of the empty text; null and repeated paths
keep one row per input row; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm import spans as S
from gondola.llm.staging import kept_columns, staged, text_or_empty

LEDGER = f"blob string, rule string, version int, found {S.SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern, and a literal or pattern that a text must hold before the search is worth its cost.

    With ``least``, a match whose second group is shorter is dropped but has been
    passed over: what begins inside it is not found.
    """

    name: str
    version: int
    pattern: str
    literal: str = ""
    least: int = 0

    def find(self, text: Column, rank: int) -> Column:
        guard = F.contains(text, F.lit(self.literal)) if self.literal else text.rlike(self.pattern)
        value = lambda hit: F.length(F.regexp_extract(hit, self.pattern, 2)) >= self.least
        return S.find(text, self.pattern, self.name, rank, guard, value if self.least else None)


# The three base rules. The least lengths of runs are part of their pattern,
# as a shorter run can only hide shorter ones; a short value can hide the name of the next.
BASE = (
    Rule(
        "assign",
        2,
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)",
        least=12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}+", "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
)
RULES = (*BASE, *MORE)


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: what ``rules`` find in the blobs of ``versions`` they have not seen."""
    text = text_or_empty()
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text"))
    every = F.array(*[F.lit(f"{r.name} {r.version}") for r in rules])
    if ledger is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(
            F.collect_set(F.concat_ws(" ", "rule", F.col("version").cast("string"))).alias("seen")
        )
        todo = (
            blobs.dropDuplicates(["blob"])
            .join(seen, "blob", "left")
            .withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0)
        )
    results = F.array(
        *[
            F.when(
                F.array_contains("todo", f"{r.name} {r.version}"),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.version).alias("version"),
                    r.find(F.col("text"), i).alias("found"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    return todo.select("blob", F.explode(F.array_compact(results)).alias("x")).select("blob", "x.*")


def find_secrets(
    versions: DataFrame,
    keep: list[str],
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): per version the columns ``keep``, its blob and all spans; the ledger with the new rows."""
    new = staged(scan(versions, ledger, rules), "secret-ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    current = F.concat_ws(" ", "rule", F.col("version").cast("string")).isin(*[f"{r.name} {r.version}" for r in rules])
    if ledger is not None:  # The history may hold far more blobs than this call asks about.
        whole_asked = whole.join(versions.select(blob_of(text_or_empty()).alias("blob")).distinct(), "blob", "left_semi")
    else:
        whole_asked = whole
    # Written, so that the join deals out both of its sides and a blob that many paths hold can be split.
    per_blob = staged(
        whole_asked.where(current & (F.size("found") > 0))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("found")).alias("spans")),
        "secret-spans",
    )
    doc = kept_columns(keep).alias("doc")
    paths = versions.select(doc, blob_of(text_or_empty()).alias("blob"))
    found = paths.join(per_blob, "blob", "left").select(
        "doc", "blob", F.coalesce("spans", S.empty_spans()).alias("spans")
    )
    return found, whole
