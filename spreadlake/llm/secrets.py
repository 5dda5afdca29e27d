"""Secret scans with an incremental ledger of blobs.

Every historical version of a path has a content; a blob is a distinct content, addressed by the
SHA-256 of its UTF-8 bytes.  The ledger holds (blob, rule version, spans) of everything that was
ever scanned.  A scan takes the blobs that the versions hold, leaves out the (blob, rule version)
pairs that are in the ledger, reads each of the others once, and joins the spans back to all paths.

Null content is an empty blob (no spans).  Repeated rows and copies share one blob; each gets its
own result row.  An empty table gives an empty result; columns other than path and content are not
read.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_in

#: kind -> (pattern, group that is measured, least length).  The first three are the base kinds, in this order.
RULES: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    "forge": (re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
}
BASE = ("assign", "access", "hex")
#: Another rule, pattern or length makes another version, under which every blob is scanned anew.
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, (p, g, n) in RULES.items()]).encode()).hexdigest()[:16]
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
_WORDS = re.compile("|".join(map(re.escape, ("password", "passwd", "secret", "token", "apikey", "api_key"))), re.IGNORECASE | re.ASCII)
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed in RULES."""
    found = []
    for i, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        # Cheap tests first; they only leave out texts (or short hex runs) in which the rule can't keep a match.
        if kind == "assign" and not _WORDS.search(text):
            continue
        if kind == "hex":
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), i, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob(content_col: str = "text") -> Column:
    """The blob id of a content."""
    return F.sha2(F.coalesce(content_col, F.lit("")), 256).alias("blob")


def blobs(versions: DataFrame, path_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """path and the blob id of every version."""
    return versions.select(F.col(path_col).alias("path"), blob(content_col))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([RULE_VERSION] * len(spans), pa.string()), pa.array(spans, kind)], ["blob", "rule_version", "spans"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """New ledger rows: one for each blob of versions whose pair with RULE_VERSION the ledger lacks.

    With a ledger, blob ids alone are compared first, and only the contents of unseen blobs travel (but for a few
    that a bitmap lets through).  Copies meet under their blob id; the map-side half of the aggregation leaves one
    content of each blob and task, so a blob that a third of all rows hold costs a row a task.
    """
    content = F.coalesce(content_col, F.lit(""))
    todo = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content"))
    if ledger is None:
        return todo.groupBy("blob").agg(F.first("content").alias("content")).mapInArrow(_scan, LEDGER)
    unseen = todo.select("blob").distinct().join(ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    some = maybe_in(todo, unseen, "blob").groupBy("blob").agg(F.first("content").alias("content"))
    return some.join(unseen, "blob", "left_semi").mapInArrow(_scan, LEDGER)


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger that update() keeps in a folder; empty where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(folder)


def update(versions: DataFrame, folder: str, path_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """Scans the blobs of versions that the ledger in the folder lacks, appends them to it, and returns all of it.

    The folder is Parquet that only grows.  An append that failed half-way is not seen, so it is done again by the next
    call.  Two writers at once may both add a pair; the rows are equal, and readers (hits, scan_unseen) take a blob once.
    """
    spark = versions.sparkSession
    scan_unseen(versions, ledger_at(spark, folder), path_col, content_col).write.mode("append").parquet(folder)
    return ledger_at(spark, folder)


def hits(ledger: DataFrame) -> DataFrame:
    """blob, spans of the blobs with spans under RULE_VERSION, each once, however often the ledger holds it."""
    return ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", content_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """path, blob, spans of every version, from a ledger that has all its blobs; also: more columns of versions, such as a revision.

    Only blobs with spans take part in the join, and clean ones come out with an empty list.
    """
    joined = versions.select(F.col(path_col).alias("path"), *also, blob(content_col)).join(hits(ledger), "blob", "left")
    return joined.select("path", *also, "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (sorted by start) replaced, as a column; overlapping spans become one mark, NULL spans change nothing."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        new = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], new).alias("out"))

    found = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, found).otherwise(text)


def mask(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """text with every span replaced; overlapping spans become one mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for _, start, end in sorted((0, s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
