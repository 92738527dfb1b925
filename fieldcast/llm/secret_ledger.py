"""Secret scans with an incremental blob ledger (operator 11).

A version of a document is a path (its doc_id) and a text.  The text's content
address is its SHA-256, and a blob is one text, however many paths and versions
hold it.  The ledger is a folder that all executors share:

* ``scan`` addresses every version, and reads from the ledger which rules, in
  which version, have seen which blob.  Only the unseen pairs of blob and rule
  version are scanned, each once: copies leave a task as their address alone.
* What was scanned and what was found is one batch of the ledger.  A batch
  counts from the moment that its marker file stands beside it, so a scan that
  breaks off leaves nothing, and a repeated one scans the same pairs again.
* ``report`` joins the findings of the current rule versions back to all paths.

A null text is the empty text.  Rows are reported one by one: repeated rows
repeat, and so do rows with a null doc_id.  Offsets are code points.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import chunks
from fieldcast.llm.files import new_folder
from fieldcast.operators.util import broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that do not overlap, of which ``group`` has ``least`` characters or more.

    ``hints``: a text without any of these, in lower case, has no match."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which they are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 32),
)
#: Further kinds: private key blocks, signed web tokens, and tokens with a known prefix.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, hints=("eyj",)),
    Rule("prefixed", 1, r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", 20, hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_live_")),
)
RULES = BASE + MORE
FOUND = "array<struct<rule: string, kind: string, start: int, end: int>>"
BATCH = f"blob binary, rules array<string>, found {FOUND}"


def matches(rule: Rule, text: str, low: str) -> Iterator[tuple[int, int]]:
    """Spans of the rule's matches in a text (``low``: the text in lower case)."""
    if rule.hints and not any(h in low for h in rule.hints):
        return
    for m in _compiled(rule).finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if rule.pattern == "[0-9a-f]+":
        pattern = f"[0-9a-f]{{{rule.least},}}"  # a shorter run can be passed over at once
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, text) -> the same, packed, one row for each blob that the task meets."""
    import zstandard

    press, met = zstandard.ZstdCompressor(level=1), set()
    for batch in chunks(batches):
        blobs = batch.column("blob").to_pylist()
        new = [i for i, b in enumerate(blobs) if b not in met and not met.add(b)]
        texts = batch.column("text").take(pa.array(new, pa.int64())).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([blobs[i] for i in new], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["blob", "text"])


def _scanned(rules: tuple[Rule, ...]):
    """(blob, text, rules seen) -> one row for each blob with unseen rules: (blob, rules, found)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, met = zstandard.ZstdDecompressor(), set()
        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for blob, packed, seen in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "seen")), strict=True):
                unseen = [r for r in rules if r.name not in (seen or ())]
                if blob in met or not unseen:
                    continue
                met.add(blob)
                text = press.decompress(packed).decode()
                low = text.lower()
                found = [{"rule": r.name, "kind": r.kind, "start": a, "end": b} for r in unseen for a, b in matches(r, text, low)]
                rows.append((blob, [r.name for r in unseen], found))
            columns = list(zip(*rows, strict=True)) or ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.string()), kind), strict=True)], ["blob", "rules", "found"])

    return run


class Ledger:
    """The blobs that were scanned, in batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def new(cls, spark: SparkSession) -> Ledger:
        return cls(spark, new_folder(spark, "ledger"))

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Folders of the committed batches."""
        path, system = self._path("commits")
        if not system.exists(path):
            return []
        return sorted(f"{self.folder}/batches/{s.getPath().getName()}" for s in system.listStatus(path))

    def entries(self) -> DataFrame:
        """(blob, rules, found) of all committed batches."""
        paths = self.batches()
        return self.spark.read.schema(BATCH).parquet(*paths) if paths else self.spark.createDataFrame([], BATCH)

    def append(self, entries: DataFrame) -> None:
        """Write a batch, then its marker."""
        name = uuid.uuid4().hex
        entries.write.parquet(f"{self.folder}/batches/{name}")
        path, system = self._path(f"commits/{name}")
        system.create(path).close()


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen pairs of blob and rule version of ``docs`` (text) and append them to the ledger."""
    texts = docs.select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    once = texts.mapInArrow(_once, "blob binary, text binary").repartition("blob")
    if ledger.batches():
        seen = ledger.entries().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        once = once.join(seen, "blob", "left")
    else:
        once = once.withColumn("seen", F.lit(None).cast("array<string>"))
    ledger.append(once.mapInArrow(_scanned(rules), BATCH))


def report(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found): for every row the findings of its text, by start and then by kind as ``rules`` lists them."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.col("found").isNotNull() & (F.size("found") > 0)
    listed = ledger.entries().filter(current).select("blob", F.explode("found").alias("f")).filter(F.col("f.rule").isin([r.name for r in rules]))
    # a pair that two scans saw at once is listed twice
    one = listed.select("blob", F.struct("f.start", order[F.col("f.kind")].alias("nth"), "f.end", "f.kind").alias("f")).distinct()
    found = one.groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("found"))
    paths = docs.select("doc_id", _blob(F.col("text")).alias("blob"))
    return paths.join(broadcast_if_small(found), "blob", "left")


def digest(reported: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) of a report."""
    found = F.coalesce("found", F.expr("array()").cast(reported.schema["found"].dataType))
    spans = lambda some: F.concat_ws(",", F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))
    of_kinds = lambda *kinds: F.filter(found, lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of_kinds(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = of_kinds(*(r.kind for r in BASE))
    return reported.select("doc_id", *counts, F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"), spans(found).alias("spans"), F.lower(F.hex("blob")).alias("blob"))

