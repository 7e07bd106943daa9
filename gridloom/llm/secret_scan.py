"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by SHA-256, and each distinct content (a *blob*) is scanned once
for each rule version that the ledger does not yet name for it. The ledger is a Parquet table in a shared folder, one row a
scan: ``blob``, the ``rules`` scanned, and the ``matches`` of each rule as gaps and lengths. Findings are cumulated to code-point
spans and joined back to all paths that ever held the blob.

Positions come without a Python function: splitting a text by a pattern gives the gaps between its leftmost
non-overlapping matches, extracting gives the matches, and a running sum over both gives each start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import filled, scratch


@dataclass(frozen=True)
class Rule:
    """A named pattern; matches whose ``group`` has fewer than ``least`` characters are dropped after matching."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds with the same start are listed. Keywords are spelt out in both cases because engines
#: differ in which non-ASCII letters a case-insensitive pattern takes. Runs of a class are maximal, so a least length
#: on the run as a whole is the same in the pattern as after it.
RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)

#: Batches in which ``secret_scan`` takes a table in; the ledger spares later batches what earlier ones have scanned.
BATCHES = 2

HITS = "array<struct<gap:int,len:int,keep:boolean>>"
MATCHES = f"array<struct<rule:string,hits:{HITS}>>"


def _matches(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches in order: the characters since the last one, its length, and whether it is kept.

    Pieces between matches and matches are zipped, each found in one pass over the text.
    """

    def hit(gap: Column, x: Column) -> Column:
        held = x if rule.group == 0 else F.regexp_extract(x, rule.pattern, rule.group)
        return F.when(x.isNotNull(), F.struct(F.char_length(gap).alias("gap"), F.char_length(x).alias("len"), (F.char_length(held) >= rule.least).alias("keep")))

    hits = F.filter(F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), hit), lambda h: h.isNotNull())
    found = F.when(F.regexp_like(text, F.lit(rule.pattern)), hits).otherwise(F.array().cast(HITS))
    return F.struct(F.lit(rule.key).alias("rule"), found.alias("hits"))


def scan_blobs(versions: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows for the contents of ``versions``: blobs that ``ledger`` has under every rule version are not scanned."""
    text = filled(text_col)
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob", "text").agg(F.lit(0).alias("_"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("rules", keys)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    each = F.array(*[_matches(F.col("text"), r) if ledger is None else F.when(F.array_contains("rules", r.key), _matches(F.col("text"), r)) for r in rules])
    return blobs.select("blob", "rules", F.filter(each, lambda m: m.isNotNull() & (F.size(m["hits"]) > 0)).cast(MATCHES).alias("matches"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of the rule versions given: blob, kind, start, end in code points, end exclusive.

    A blob that was scanned more than once for a rule version (by two writers, or in a retried append) counts once, as its scans are the same.
    """
    rows = ledger.select("blob", F.inline("matches")).where(F.col("rule").isin([r.key for r in rules]))
    rows = rows.groupBy("blob", "rule").agg(F.first("hits").alias("hits"))
    rows = rows.select("blob", "rule", F.posexplode("hits").alias("nth", "hit")).select("blob", "rule", "nth", "hit.*")
    so_far = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).where("keep")
    return rows.select("blob", F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")


class Ledger:
    """A ledger kept at ``path``. ``add`` scans what is new, ``report`` joins findings to paths, ``scan`` does both."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def rows(self) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)
        return self.spark.read.schema(f"blob string, rules array<string>, matches {MATCHES}").parquet(self.path) if there else None

    def add(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scan the contents of ``versions`` for the rule versions that the ledger has not yet for them."""
        scan_blobs(versions, text_col, self.rules, self.rows()).write.mode("append").parquet(self.path)

    def report(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The findings of all rows of ``versions``, whose contents have been added."""
        at = {r.kind: i for i, r in enumerate(self.rules)}
        rank = F.create_map(*[F.lit(v) for pair in at.items() for v in pair])
        span = F.struct("start", rank[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
        per_blob = (
            findings(self.rows(), self.rules)
            .groupBy("blob")
            .agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in at], F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["said"]), ",").alias("spans"))
        )
        paths = versions.select(F.col(id_col).alias(id_col), F.sha2(filled(text_col), 256).alias("blob"))
        # Turned round, so that the join's shuffles are its own and a blob that very many paths have can be split over tasks.
        joined = paths.join(per_blob.withColumn("_blob", F.reverse("blob")).drop("blob"), F.reverse("blob") == F.col("_blob"), "left")
        spans = F.coalesce("spans", F.lit(""))
        return joined.select(id_col, *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in at], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of ``versions``: id, n_assign, n_access, n_hex, base_sha256, spans.

        Null texts are empty and have no findings; repeated rows each get the blob's findings; null ids are carried;
        an empty table gives an empty result; columns other than the two named are not looked at.
        """
        self.add(versions, text_col)
        return self.report(versions, id_col, text_col)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, batches: int = BATCHES) -> DataFrame:
    """``Ledger.scan`` with the ledger at ``path``, or a new one in the shared folder, the table being added in ``batches`` dealt by id."""
    ledger = Ledger(docs.sparkSession, path or scratch(docs.sparkSession, "secrets"))
    for k in range(batches):
        ledger.add(docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k), text_col)
    return ledger.report(docs, id_col, text_col)
