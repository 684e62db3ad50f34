"""Secret scan with an incremental blob ledger (operator 4, DataFrame operations only).

Every version of a document is addressed by the SHA-256 of its bytes. The ledger holds which
(blob, rule, rule version) triples were scanned and what was found. A run scans only triples that
the ledger lacks, one copy of each blob, appends to the ledger, and joins findings back to all
documents that hold the blob.

Defined results: a null text is the empty string; rows with a null or repeated id each get their
blob's findings; an empty table gives an empty result; extra columns are ignored. Positions are
code points, the end exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, scratch_path, utf8_sha256, whole_text, written


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0  # code points in the group; shorter matches are dropped
    base: bool = True


#: Matches of access and hex are maximal runs, so their least length can stand in the pattern.
RULES = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)
SCANNED = "blob binary, rule string, version int"
FOUND = "blob binary, rule string, version int, start long, end long"


def matches(text: Column, rule: Rule) -> Column:
    """Array of (rule, version, gap before the match, length, kept) in order; empty without a match."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m")
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("v")
    gaps = F.split(text, rule.pattern, -1).alias("g")
    zipped = F.filter(F.arrays_zip(whole, value, gaps), lambda x: x.m.isNotNull())
    pieces = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.alias("i"),
            F.length(x.g).cast("long").alias("gap"), F.length(x.m).cast("long").alias("len"), (F.length(x.v) >= rule.least).alias("kept"),
        ),
    )
    return F.when(F.array_contains("todo", rule.name) & text.rlike(rule.pattern), pieces)


class BlobLedger:
    """Two Parquet tables below path: scanned triples and findings."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules
        for name, schema in (("scanned", SCANNED), ("found", FOUND)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")

    def found(self) -> DataFrame:
        """Findings of the current rule versions; what a run that broke off left behind is told apart by the key."""
        current = F.create_map(*[F.lit(x) for r in self.rules for x in (r.name, r.version)])
        all_found = self.spark.read.schema(FOUND).parquet(f"{self.path}/found")
        return all_found.where(current[F.col("rule")] == F.col("version")).dropDuplicates()

    def scan(self, versions: DataFrame) -> None:
        """versions: doc_id, text, one row per version. Findings are written first, so a run that broke off repeats safely."""
        rows = versions.select("doc_id", whole_text().alias("text")).withColumn("blob", F.unhex(utf8_sha256(F.col("text"))))
        rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in self.rules])
        wanted = rows.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).select("blob", "doc_id", F.inline(rules))
        unseen = wanted.join(self.scanned(), ["blob", "rule", "version"], "left_anti")
        todo_path = scratch_path(self.spark, "secret-todo")
        unseen.groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("todo")).write.parquet(todo_path)
        todo = self.spark.read.schema("blob binary, doc_id long, todo array<string>").parquet(todo_path)
        due = todo.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"), "todo")
        texts = rows.join(due, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")))
        empty = F.array().cast("array<struct<rule:string,version:int,i:int,gap:bigint,len:bigint,kept:boolean>>")
        hits = texts.select("blob", F.explode(F.concat(*[F.coalesce(matches(F.col("text"), r), empty) for r in self.rules])).alias("x")).select("blob", "x.*")
        order = Window.partitionBy("blob", "rule", "version").orderBy("i")
        once = hits.dropDuplicates(["blob", "rule", "version", "i"])
        placed = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).where("kept")
        placed.select("blob", "rule", "version", (F.col("end") - F.col("len")).alias("start"), "end").write.mode("append").parquet(f"{self.path}/found")
        done = todo.select("blob", F.explode("todo").alias("rule"))
        of = F.create_map(*[F.lit(x) for r in self.rules for x in (r.name, r.version)])
        done.select("blob", "rule", of[F.col("rule")].cast("int").alias("version")).write.mode("append").parquet(f"{self.path}/scanned")


def findings_by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, n_<base rule> columns, base (list of spans as text) and spans."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    base = [r.name for r in rules if r.base]
    span = F.struct("start", rank[F.col("rule")].alias("rank"), F.concat_ws(":", "rule", "start", "end").alias("said"), F.col("rule").isin(base).alias("base"))
    grouped = found.groupBy("blob").agg(
        *[F.count_if(F.col("rule") == n).alias(f"n_{n}") for n in base], F.sort_array(F.collect_list(span)).alias("all")
    )
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: x.said))
    return grouped.select(
        "blob", *[f"n_{n}" for n in base],
        F.sha2(said(F.filter("all", lambda x: x.base)), 256).alias("base_sha256"), said(F.col("all")).alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """Scan what the ledger lacks and return doc_id with the findings of its blob for every row."""
    ledger.scan(docs)
    # written first: a join of two plain tables, in which Spark can split the paths of a blob that very many documents hold
    by_blob = written(findings_by_blob(ledger.found(), ledger.rules), "secret-findings")
    paths = docs.select("doc_id", F.unhex(utf8_sha256(whole_text())).alias("blob"))
    base = [r.name for r in ledger.rules if r.base]
    return paths.join(by_blob, "blob", "left").select(
        "doc_id", *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, scratch_path(spark, "secret-ledger"))
    return scan_documents(read_table(spark, sf_dir, "documents"), ledger)


def _oracle() -> str:
    """The same rows in DuckDB's SQL: gaps and matches of each rule give positions by running sums."""
    quoted = lambda x: x.replace("'", "''")
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{r.name}' AS rule, {i} AS rank, {r.least} AS least, regexp_extract_all(text, '{quoted(r.pattern)}', 0) AS ms, "
        f"regexp_extract_all(text, '{quoted(r.pattern)}', {r.group}) AS vs, regexp_split_to_array(text, '{quoted(r.pattern)}') AS gs FROM t"
        for i, r in enumerate(RULES)
    )
    base = sum(r.base for r in RULES)
    counts = ", ".join(f"count(*) FILTER (rule = '{r.name}') AS n_{r.name}" for r in RULES if r.base)
    said = "string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({found}),
x AS (SELECT doc_id, rule, rank, least, unnest(ms) AS w, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT *, CAST(sum(length(g) + length(w)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS BIGINT) AS stop FROM x),
s AS (SELECT doc_id, rule, rank, stop - length(w) AS start, stop FROM p WHERE length(v) >= least)
SELECT t.doc_id, {counts}, sha256(coalesce({said} FILTER (rank < {base}), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id"""


ORACLE_SQL = _oracle()
