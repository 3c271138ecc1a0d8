"""Secret scans over a ledger of blobs, with DataFrame functions only.

A text is addressed by its SHA-256. Of every distinct blob only those (blob, rule, rule
version) pairs are scanned that the ledger does not hold; the findings then go to all rows
that carry the blob. One row per hit keeps the work linear in the length of a text: a
regular expression gives the hits and the pieces between them, and a running sum over
their lengths gives the places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.columns import spare_name
from chronofold.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap count when ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # the runs of 16 and more, without an array of all shorter ones
)

LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(text: Column, rule: Rule) -> Column:
    """Of each match: length of the text since the one before, its own, and the group's."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)),
        F.zip_with(found, groups, lambda m, g: F.struct(F.length(m).alias("width"), F.length(g).alias("held"))),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), m["width"].alias("width"), m["held"].alias("held")),
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), rows)


def _scan_pairs(blobs: DataFrame, rules: Sequence[Rule], every: bool) -> DataFrame:
    """(blob, kind, version, start, end, counts) of all matches in ``blobs`` (blob, text, todo).

    ``every`` gives pairs without a match a row of nulls.
    """
    scans = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.lit(r.least).alias("least"),
                F.when(F.array_contains("todo", r.kind), _hits(F.col("text"), r)).alias("hits"),
            )
            for r in rules
        ]
    )
    rows = blobs.select("blob", "todo", F.explode(scans).alias("s"))
    rows = rows.where(F.array_contains("todo", F.col("s.kind")) if every else "s.hits is not null")
    hits = (F.posexplode_outer if every else F.posexplode)("s.hits").alias("n", "hit")
    rows = rows.select("blob", "s.kind", "s.version", "s.least", hits)
    order = Window.partitionBy("blob", "kind").orderBy("n")
    end = F.sum(F.expr("cast(hit.gap + hit.width as bigint)")).over(order)
    return rows.select(
        "blob", "kind", "version", (end - F.col("hit.width")).alias("start"), end.alias("end"), F.expr("hit.held >= least").alias("counts")
    )


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, kind, version, start, end) of the hits in ``blobs`` (blob, text, todo).

    ``todo`` lists the kinds to scan. Code points from 0; end is exclusive.
    """
    return _scan_pairs(blobs, rules, every=False).where("counts").drop("counts")


def unseen_blobs(docs: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None = None) -> DataFrame:
    """Distinct blobs with the kinds the ledger lacks: blob, text, todo."""
    texts = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every["kind"])
    pairs = texts.select("blob").distinct().select("blob", F.inline(every))
    todo = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    todo = todo.groupBy("blob").agg(F.collect_list("kind").alias("todo"))  # at most one entry for each rule
    return texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")


def ledger_rows(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What a scan adds to a ledger: blob, kind, version, spans; one row per pair scanned."""
    spans = F.collect_list(F.when(F.col("counts"), F.struct("start", "end")))  # without nulls
    return _scan_pairs(blobs, rules, every=True).groupBy("blob", "kind", "version").agg(F.array_sort(spans).alias("spans"))


def start_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger in a folder that must not be there yet."""
    spark.range(0).select(F.from_json(F.lit("{}"), LEDGER).alias("pair")).select("pair.*").write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def extend_ledger(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan the (blob, rule, version) pairs of ``docs`` that the ledger lacks and append them.

    A scan that fails adds nothing. One writer at a time: two at once could scan a pair twice,
    which changes no finding.
    """
    fresh = unseen_blobs(docs, rules, read_ledger(docs.sparkSession, path))
    ledger_rows(fresh, rules).write.mode("append").parquet(path)


def document_findings(
    docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The ledger's findings of these rules and versions for each row of ``docs``; see ``scan_documents``."""
    wanted = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(r.version)) for r in rules])
    known = ledger.where(F.array_contains(wanted, F.concat_ws(":", "kind", "version")) & (F.size("spans") > 0))
    hits = known.select("blob", "kind", F.inline("spans")).distinct()
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", F.array_position(kinds, F.col("kind")).alias("order"), "end", "kind")
    found = hits.groupBy("blob").agg(
        F.sort_array(F.collect_list(span)).alias("found"),
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules],
    )
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = found.select("blob", text.alias("spans"), *[f"n_{r.kind}" for r in rules])
    # Written, so that the join below is one of two exchanges and a frequent blob can be split.
    found = Scratch(docs.sparkSession).keep(found, "findings")
    rows = docs.select(*keys, blob_id(F.col("text")).alias("blob")).join(found, "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return rows.select(
        *keys,
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
        "blob",
    )


def scan_documents(
    docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per row of ``docs``: its path (the columns ``keys``), blob and findings.

    n_<kind> counts the hits of each rule; spans lists kind:start:end by start, then in the
    order of the rules; base_sha256 is its digest. Null texts are empty; a text without a
    hit has an empty list; very long texts are scanned whole; repeated rows get equal results;
    an empty table gives no rows; other columns are not read, whatever their names. ``ledger``
    is the folder of a ledger (``start_ledger``), which is extended; without one a new one is used.
    """
    spark = docs.sparkSession
    if ledger is None:
        ledger = Scratch(spark).path("ledger")
        start_ledger(spark, ledger)
    extend_ledger(docs, ledger, rules)
    return document_findings(docs, read_ledger(spark, ledger), rules, keys)


def redact_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; other columns stay.

    Spans that touch or overlap become one mask. Texts without a hit, null ones included,
    stay as they are; columns of any names come back as they were. An empty table gives no rows.
    """
    key, place = spare_name(docs.columns, "_blob"), spare_name(docs.columns, "_spans")
    hits = scan_blobs(unseen_blobs(docs, rules), rules)
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    upto = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.sum("new").over(upto))
    spans = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(place))
    spans = Scratch(docs.sparkSession).keep(spans, "findings")
    far = (1 << 31) - 1
    lows = F.concat(F.array(F.lit(0).cast("bigint")), F.col(f"{place}.end"))
    highs = F.concat(F.col(f"{place}.start"), F.array(F.lit(far).cast("bigint")))
    kept = F.zip_with(lows, highs, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.least(b - a, F.lit(far)).cast("int")))
    marked = docs.withColumn(key, blob_id(F.col("text"))).join(spans.select(F.col("blob").alias(key), place), key, "left")
    text = F.when(F.col(place).isNull(), F.col("text")).otherwise(F.array_join(kept, mask))
    return marked.withColumn("text", text).select(*docs.columns)
