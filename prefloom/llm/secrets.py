"""Operator 9 (native), secret scans by an incremental blob ledger.

Every version of a text is content-addressed (SHA-256).  The ledger lists blob and rule-version pairs that
were scanned, with their findings; only pairs it lacks are scanned, one copy each, and findings are joined
back to all paths (doc_ids) that hold the blob.  Texts travel by doc_id, so that a blob with very many
copies is never gathered in one place, and only if the ledger lacks any blob.  The rule version is a digest of
the rules themselves, so that changed rules always scan again.

Spans are code points, end exclusive.  They are found without Python: ``split`` and ``regexp_extract_all``
walk the same matches, and the lengths of what lies between and within them add up to the offsets.

Defined results: a null text is the empty blob; an empty text has no finding; texts of any length are scanned
whole; findings at one start are listed in the order of the rules; repeated rows each get their blob's findings;
an empty table gives no rows; a ledger row that repeats counts once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kind: (pattern, group whose length counts, least length, what a match must contain), base kinds first
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),  # a maximal run of 24 or more: the same as longer runs of all runs
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("-----BEGIN",)),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("gh",)),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ("eyJ",)),
}
BASE = ("assign", "access", "hex")


def version_of(rules=RULES) -> str:
    """Names a set of rules by what they say."""
    return hashlib.sha256(json.dumps([[kind, *rule] for kind, rule in rules.items()]).encode()).hexdigest()[:16]


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _path(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("\0"))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind_no, kind, start, end) of all findings in (blob, text) rows; rows that repeat count once."""
    tries = []
    for no, (kind, (pattern, group, least, within)) in enumerate(rules.items()):
        p = F.lit(pattern)
        may = F.col("text").rlike(pattern)
        for literal in within[:1] if len(within) == 1 else ():
            may = F.contains("text", F.lit(literal)) & may
        if len(within) > 1:
            may = (F.contains("text", F.lit(within[0])) | F.contains("text", F.lit(within[1]))) & may
        found = F.struct(
            F.lit(no).alias("kind_no"),
            F.lit(kind).alias("kind"),
            F.lit(least).alias("least"),
            F.transform(F.split("text", pattern, -1), lambda s: F.length(s)).alias("gaps"),
            F.transform(F.regexp_extract_all("text", p, F.lit(0)), lambda s: F.length(s)).alias("lens"),
            F.transform(F.regexp_extract_all("text", p, F.lit(group)), lambda s: F.length(s)).alias("parts"),
        )
        tries.append(F.when(may, found))
    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*tries))).alias("f")).select("blob", "f.*")
    rows = hits.select("blob", "kind_no", "kind", "least", F.posexplode(F.arrays_zip("gaps", "lens", "parts")).alias("i", "m")).where("m.lens is not null")
    rows = rows.select("blob", "kind_no", "kind", "least", "i", "m.*").distinct()  # a blob may come more than once: its rows are the same each time
    so_far = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gaps") + F.col("lens")).over(so_far)
    return rows.select("blob", "kind_no", "kind", (end - F.col("lens")).alias("start"), end.alias("end"), (F.col("parts") >= F.col("least")).alias("ok")).where("ok").drop("ok")


def findings_of(spans: DataFrame, base=BASE) -> DataFrame:
    """One row for each blob with findings: counts, spans and base spans as text, ordered by start, then kind."""
    item = F.struct("start", "kind_no", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"), F.col("kind").isin(*base).alias("base"))
    g = spans.groupBy("blob").agg(F.sort_array(F.collect_list(item)).alias("a"), *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in base])
    text = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    return g.select("blob", *[f"n_{k}" for k in base], text(F.filter("a", lambda x: x["base"])).alias("base_spans"), text(F.col("a")).alias("spans"))


EMPTY_LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows).  Append the rows to the ledger to skip these blobs next time."""
    from .common import cut

    version = version_of(rules)
    ledger = docs.sparkSession.createDataFrame([], EMPTY_LEDGER) if ledger is None else ledger
    known = ledger.where(F.col("rule_version") == version).dropDuplicates(["blob"])
    d = docs.select("doc_id", F.col("text"), _blob(F.col("text")).alias("blob"))
    paths = cut(d.select("doc_id", "blob"))
    one = paths.groupBy("blob").agg(F.min(_path(F.col("doc_id"))).alias("at"))
    unseen = cut(one.join(known.select("blob"), "blob", "left_anti"))
    n = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    if unseen.isEmpty():
        fresh = docs.sparkSession.createDataFrame([], EMPTY_LEDGER)
    else:
        text = d.select(_path(F.col("doc_id")).alias("at"), "blob", "text").join(unseen, ["at", "blob"]).select("blob", "text")
        found = cut(findings_of(find_spans(text, rules)))  # a path may list one blob twice
        fresh = unseen.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), *n, F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
    held = cut(fresh.where("spans <> ''").unionByName(known.where("spans <> ''")).drop("rule_version"))
    by_path = paths.join(held, "blob", "left").select(
        "doc_id",
        *n,
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        "blob",
    )
    return by_path, fresh
