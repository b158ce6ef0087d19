"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every historical version of a path is a blob named by the SHA-256 of its text. The ledger holds a row for each pair of a
blob and a rule version that was scanned, findings or not. A scan takes the distinct blobs that the ledger lacks under
the present rules, one text each, finds the spans, and appends them; a report joins the ledger back to all paths.

Positions come from the pieces between the matches: a match begins after all pieces and matches before it. They are
running sums over a row per match, so a text with very many matches costs no more than sorting them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.llm.staging import stage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` count where ``group`` has ``least`` characters.

    ``probe`` matches somewhere in every text with such a match; only these texts are taken apart.
    """

    kind: str
    pattern: str
    probe: str
    group: int = 0
    least: int = 1


#: Digests of unseen blobs that are broadcast to pick their texts (about 100 bytes each); beyond it the texts are shuffled.
BROADCAST_BLOBS = 200_000

_KEY = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]"
#: Runs of one class are maximal, so the least length can be part of the pattern for access and hex.
RULES = (
    Rule("assign", _KEY + "+)", _KEY + "{12,})", group=2, least=12),
    Rule("access", "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", "[0-9a-f]{16,}", "[0-9a-f]{16,}", least=16),
)

def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def versions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with their text replaced by its content address ``blob``; null counts as empty."""
    return df.withColumn("blob", F.sha2(F.coalesce(df[text_col], F.lit("")), 256)).drop(text_col)


def _matches(text: Column, rank: int, rule: Rule) -> Column:
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(whole.alias("m"), judged.alias("g"), F.split(text, rule.pattern, -1).alias("gap"))
    row = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("m"), (F.length(x["g"]) >= rule.least).alias("good"))
    # the last piece has no match after it
    found = F.filter(F.transform(zipped, row), lambda x: x["m"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(rule.probe)), found).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,m:int,good:boolean>>"))


def _spans(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) for rows (blob, found) with matches; spans by start, then in the rules' order."""
    rows = found.filter(F.size("found") > 0).select("blob", F.inline("found"))
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("m")).cast("long")).over(upto)).filter("good")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("m")).alias("start"), "rank", kind.alias("kind"), "end")
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(df: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rule_version, spans): each unseen pair of a blob of ``df`` and the rules' version, once.

    A null text is the empty blob, which has no spans, as have texts without findings. Equal texts, repeated rows among
    them, are one blob. Offsets count code points; the end is exclusive. Other columns are ignored; an empty table
    gives no rows.
    """
    mark = rule_version(rules)
    texts = df.select(F.coalesce(df[text_col], F.lit("")).alias("text"))
    blobs = texts.select(F.sha2("text", 256).alias("blob"), "text")
    if ledger is not None:
        # digests alone tell what is unseen; then only the texts of these move
        todo = stage(blobs.select("blob").distinct().join(ledger.filter(F.col("rule_version") == mark).select("blob"), "blob", "left_anti"), "secret-todo")
        blobs = blobs.join(F.broadcast(todo) if todo.count() <= BROADCAST_BLOBS else todo, "blob", "left_semi")
    # equal blobs shrink to one within each task before the shuffle
    unseen = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    every = F.concat(*[_matches(F.col("text"), i, r) for i, r in enumerate(rules)])
    rows = stage(unseen.select("blob", every.alias("found")), "secret-scan")
    found = _spans(rows, rules)
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.select("blob").join(found, "blob", "left").select("blob", F.lit(mark).alias("rule_version"), F.coalesce("spans", empty).alias("spans"))


def report(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``paths`` (from ``versions``) with their blob's spans under the present rules."""
    mine = ledger.filter(F.col("rule_version") == rule_version(rules)).select("blob", "spans")
    return paths.join(mine, "blob", "left")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents, from a ledger filled by two scans: one of about half of the documents, as an earlier
    load, and one of the whole table, which takes up only the blobs that the first hasn't seen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    earlier = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    first = stage(scan(earlier), "secret-ledger")
    # tables of their own, so the join's sides both come from exchanges and a blob with very many paths can be split
    ledger = first.unionByName(stage(scan(docs, first), "secret-ledger"))
    out = report(versions(docs), ledger)
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    spans = F.coalesce(_joined(F.col("spans")), F.lit(""))
    return out.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


OP5_SQL = r"""
WITH rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
  ('hex', 2, '[0-9a-f]+', 0, 16)),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 12 AS least,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
    regexp_split_to_array(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gap FROM docs
  UNION ALL SELECT doc_id, 'access', 1, 18, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, 'hex', 2, 16, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_split_to_array(text, '[0-9a-f]+') FROM docs),
rows_ AS (SELECT doc_id, kind, rank, least, unnest(m) AS m, unnest(g) AS g, unnest(gap[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM parts),
ends AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM rows_),
spans AS (SELECT doc_id, kind, rank, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ends WHERE length(g) >= least),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)
"""
