"""Hashed files behind a release: selection, integrity, receipt chains."""

from __future__ import annotations

import gzip
import hashlib
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions import scalar as X
from chronofold.functions.storage import cut

# First folder of a path -> group of the frozen input set.
ROOT_GROUPS = {
    "src": "source",
    "scripts": "source",
    "verify": "source",
    "web": "web",
    "deploy": "deployment",
    "vendor": "vendor",
}
# Top-level files of the configuration group.
CONFIGURATION = (".env.example", ".gitignore", ".node-version", ".python-version", "pyproject.toml", "uv.lock")
# Folders that never count.
IGNORED_FOLDERS = (
    ".git", ".mypy_cache", ".next", ".open-next", ".pytest_cache", ".ruff_cache", ".turbo",
    ".venv", ".vercel", "__pycache__", "coverage", "dist", "node_modules", "out",
)
# Single files that never count.
IGNORED_FILES = (
    "web/.eslintcache", "web/data/featured.json", "web/next-env.d.ts", "web/npm-debug.log",
    "web/pnpm-debug.log", "web/yarn-error.log",
)
# Criteria each phase of a release must show, all true.
PHASE_CRITERIA = {
    "01-runtime": (
        "frozen_uv_sync", "exact_uv_lock", "ruff", "strict_mypy", "compileall",
        "frozen_environment_matches_project_venv", "bounded_runtime_correctness", "real_hard_exit_and_fresh_resume",
    ),
    "02-integration": (
        "registered_product_document", "one_provider_attempt_and_one_durable_refund", "aware_and_control_five_spans",
        "immutable_staging_before_acknowledged_otlp", "exact_duplicate_free_signoz_queryback",
        "retained_sanitized_source_facts", "compose_renders", "loopback_only_published_ports",
        "exact_stack_inventory_and_image_pins", "required_containers_healthy",
        "mounted_histogram_helper_matches_pin", "collector_and_signoz_healthy", "service_account_identity_validated",
    ),
    "03-publication": (
        "featured_v2_proof", "frozen_web_install", "locked_web_toolchain", "pnpm_production_audit",
        "python_dependency_audit", "python_source_security_scan", "web_typecheck_lint_format_build",
        "operator_observed_responsive_browser_routes", "operator_observed_origin_and_unavailable_fail_closed",
        "operator_observed_keyboard_and_reduced_motion", "package_readme_source_and_installed_cli",
        "publication_scope_and_v2_vocabulary",
    ),
}
PHASES = tuple(PHASE_CRITERIA)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` as ``(path, content)`` with root-relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    return files.select(relative.alias("path"), "content")


def artifact_group() -> Column:
    """The group a path belongs to; null when it is left out of the frozen set."""
    parts = F.split("path", "/")
    top = F.element_at(parts, 1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    ignored = F.exists(
        folders, lambda p: p.isin(*IGNORED_FOLDERS) | p.endswith(".egg-info")
    ) | F.col("path").isin(*IGNORED_FILES)
    name = F.element_at(parts, -1)
    generated = F.col("path").startswith("web/data/generated/")
    skip = ignored | generated | name.endswith(".tsbuildinfo") | ((top == "web") & name.endswith("-debug.log"))
    group = F.when(F.size(parts) == 1, F.when(name.isin(*CONFIGURATION), "configuration").when(name.endswith(".md"), "publication"))
    for folder, label in ROOT_GROUPS.items():
        group = group.when((F.size(parts) > 1) & (top == folder), label)
    return F.when(~skip, group)


def artifact_references(files: DataFrame) -> DataFrame:
    """``(group, path, sha256, bytes)`` of the files that count."""
    content = F.col("content").cast("binary")
    return files.withColumn("group", artifact_group()).where("group is not null").select(
        "group", "path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes")
    )


def control_files(files: DataFrame) -> DataFrame:
    """Each control file with ``verdict``: ok, bad UTF-8 or JSON, or not an object."""
    text = F.col("content").cast("string")
    body = F.when(F.is_valid_utf8(text), text)
    shape = F.schema_of_variant(X.strict_json(body))
    return files.withColumn(
        "verdict",
        F.when(shape.isNull(), "json_invalid").when(~shape.startswith("OBJECT"), "not_an_object").otherwise("ok"),
    )


def audit_artifacts(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """One verdict per (group, path) of the frozen list and the files of today."""
    keys = ["group", "path"]
    listed = frozen.groupBy(*keys).agg(
        F.count("*").alias("listed"),
        F.min("sha256").alias("sha256"),
        F.min("bytes").alias("bytes"),
    )
    forms = frozen.groupBy("path").agg(
        ((F.min("sha256") != F.max("sha256")) | (F.min("bytes") != F.max("bytes"))).alias("conflict")
    )
    now = current.select(*keys, F.col("sha256").alias("now_sha256"), F.col("bytes").alias("now_bytes"))
    joined = listed.join(now, keys, "full_outer").join(forms, "path", "left")
    verdict = (
        F.when(F.col("listed").isNull(), "missing_from_inputs")
        .when(~X.is_canonical_path(F.col("path")), "path_not_canonical")
        .when(F.col("listed") > 1, F.when(F.col("conflict"), "reference_conflict").otherwise("duplicate_path"))
        .when(F.col("conflict"), "reference_conflict")
        .when(F.col("now_sha256").isNull(), "artifact_missing")
        .when(F.col("now_bytes") != F.col("bytes"), "size_mismatch")
        .when(F.col("now_sha256") != F.col("sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    return joined.select(*keys, verdict.alias("verdict"))


def criteria_table(spark: SparkSession) -> DataFrame:
    rows = [(p, c) for p, cs in PHASE_CRITERIA.items() for c in cs]
    return spark.createDataFrame(rows, "phase string, criterion string")


def criteria_gaps(receipts: DataFrame) -> DataFrame:
    """Criteria of each receipt that are missing, unknown or not true."""
    keys = ["lineage_id", "position"]
    given = receipts.select(*keys, "phase", F.explode("criteria").alias("criterion", "value"))
    table = F.broadcast(criteria_table(receipts.sparkSession))  # a constant of 33 rows
    wanted = receipts.select(*keys, "phase").join(table, "phase")
    joined = wanted.withColumn("wanted", F.lit(True)).join(given, [*keys, "phase", "criterion"], "full_outer")
    gap = F.when(F.col("wanted").isNull(), "unknown").when(F.col("value").isNull(), "missing").when(~F.col("value"), "not_true")
    return joined.withColumn("gap", gap).where("gap is not null").select(*keys, "criterion", "gap")


def _fingerprint(value: Column) -> Column:
    """128 bits of the SHA-256 of a text, as bytes: a shuffled row need not hold the text itself."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _with_criteria(receipts: DataFrame) -> DataFrame:
    """Adds ``bad`` (a criterion is unknown or not true) and ``lacks``, a bit for each criterion of
    its phase that a receipt does not name (null for an unknown phase)."""
    rows = [(p, list(names)) for p, names in PHASE_CRITERIA.items()]
    table = F.broadcast(receipts.sparkSession.createDataFrame(rows, "phase string, _wanted array<string>"))  # a constant of 3 rows
    none = F.array().cast("array<string>")
    keys, wanted = F.coalesce(F.map_keys("criteria"), none), F.coalesce("_wanted", none)
    untrue = F.exists(F.map_values("criteria"), lambda v: ~F.coalesce(v, F.lit(False)))
    places = F.sequence(F.lit(0), F.size("_wanted") - 1)
    bit = lambda i: F.when(F.array_contains(keys, F.get("_wanted", i)), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    bits = F.aggregate(places, F.lit(0).cast("bigint"), lambda found, i: found * 2 + bit(i))
    lacks = F.when(F.size(F.array_except(wanted, keys)) == 0, F.lit(0).cast("bigint")).otherwise(bits)
    return receipts.join(table, "phase", "left").withColumns(
        {
            "bad": F.coalesce((F.size(F.array_except(keys, wanted)) > 0) | untrue, F.lit(False)),
            "lacks": F.when(F.col("_wanted").isNotNull(), lacks),
        }
    )


def _proven(phase: str = "phase", inputs: str = "inputs_sha256") -> Column:
    """What a receipt and its evidence must say alike."""
    said = F.struct(
        F.col("lineage_id").cast("string").alias("l"), F.col(phase).alias("p"), F.col(inputs).alias("i"),
        F.array_sort(F.map_entries("criteria")).alias("c"),
    )
    return _fingerprint(F.to_json(said, {"ignoreNullFields": "false"}))


RECEIPT_RULES = (
    "receipt_schema", "lineage_mismatch", "inputs_mismatch", "not_pass", "phase_unknown", "criteria_invalid",
    "evidence_missing", "chain_broken", "evidence_mismatch", "duplicate_phase",
)


def _broken(*rules: tuple[Column, str]) -> Column:
    """The number of the first of these rules, given in order, that does not hold."""
    found = F.lit(None).cast("int")
    for ok, code in reversed(rules):
        found = F.when(~ok, RECEIPT_RULES.index(code)).otherwise(found)
    return found


def _evidence_failures(receipts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per lineage with any: the first position whose evidence differs, and how many rows of
    evidence a path has beyond its first."""
    asked = receipts.select("lineage_id", "position", F.col("evidence.path").alias("evidence_path"), _proven().alias("wanted"))
    passed = F.col("schema_version").eqNullSafe(F.lit(1)) & F.col("verdict").eqNullSafe(F.lit("PASS"))
    proof = evidence.select(F.col("path").alias("evidence_path"), F.when(passed, _proven()).alias("proven"))
    nth = F.row_number().over(Window.partitionBy("evidence_path").orderBy("proven"))
    proof = proof.where("evidence_path is not null").withColumn("nth", nth)
    joined = asked.where("evidence_path is not null").join(proof.hint("merge"), "evidence_path", "left")
    differs, again = ~F.col("wanted").eqNullSafe(F.col("proven")), F.coalesce(F.col("nth") > 1, F.lit(False))
    return joined.where(differs | again).groupBy("lineage_id").agg(
        F.min(F.when(differs, F.col("position"))).alias("differs_at"), F.count_if(again).alias("again")
    )


def audit_receipts(receipts: DataFrame, inputs: DataFrame, evidence: DataFrame) -> DataFrame:
    """First failure of every lineage's receipt chain; null and ``ready`` when complete.

    ``receipts``: lineage_id, position, declared_lineage, schema_version, inputs_sha256,
    verdict, phase, criteria MAP, has_previous, previous STRUCT, evidence STRUCT and its
    own path, sha256, bytes. ``inputs``: lineage_id, sha256. ``evidence``: path,
    lineage_id, phase, schema_version, verdict, inputs_sha256, criteria MAP.

    ``position`` is the place in the list, unique per lineage. The order test looks one
    receipt back; all receipts of a lineage are judged, however many there are. What a
    receipt tells by itself is judged before the exchange; references, criteria and hashes
    travel as fingerprints. The first failure of a lineage is the least (position, rule) of
    all tests, so evidence is compared by its path and only what differs is sent on.
    """
    reference = lambda c: F.to_json(F.struct(*[F.col(f"{c}{x}") for x in ("path", "sha256", "bytes")]), {"ignoreNullFields": "false"})
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    phase_at = F.get(F.array(*[F.lit(p) for p in PHASES]), F.col("position").cast("int"))  # null beyond the last phase
    own = _broken(
        (F.col("schema_version").eqNullSafe(F.lit(1)), "receipt_schema"),
        (same("declared_lineage", "lineage_id"), "lineage_mismatch"),
        (F.col("verdict").eqNullSafe(F.lit("PASS")), "not_pass"),
        (F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), "phase_unknown"),
        (~F.col("bad"), "criteria_invalid"),
        (F.col("evidence").isNotNull(), "evidence_missing"),
        (F.col("has_previous"), "chain_broken"),
        (F.col("evidence.path").isNotNull(), "evidence_mismatch"),
    )
    slim = _with_criteria(receipts.where("lineage_id is not null")).select(
        "lineage_id",
        "position",
        "phase",
        own.alias("own"),
        "lacks",
        (~F.col("phase").eqNullSafe(phase_at)).alias("misplaced"),
        F.when(F.col("inputs_sha256").isNotNull(), _fingerprint(F.col("inputs_sha256"))).alias("inputs"),
        _fingerprint(reference("")).alias("reference"),
        F.when(F.col("previous").isNotNull(), _fingerprint(reference("previous."))).alias("previous"),
    )
    order = Window.partitionBy("lineage_id").orderBy("position", "phase")
    chain = slim.withColumn("before", F.lag("reference").over(order))
    chain = chain.withColumn("lacks", F.bit_and("lacks").over(Window.partitionBy("lineage_id", "position", "phase")))
    earlier = Window.partitionBy("lineage_id", "phase").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.withColumn("phases_before", F.count("*").over(earlier))
    given = inputs.where("lineage_id is not null").select(
        "lineage_id",
        F.when(F.col("sha256").isNotNull(), _fingerprint(F.col("sha256"))).alias("wanted_inputs"),
        F.count("*").over(Window.partitionBy("lineage_id")).alias("times"),
    )
    joined = chain.join(given.hint("merge"), "lineage_id", "left")
    complete = F.coalesce(F.col("lacks") == 0, F.lit(True)) | F.col("position").isNull()
    late = _broken(
        (same("inputs", "wanted_inputs"), "inputs_mismatch"),
        (complete, "criteria_invalid"),
        (same("previous", "before"), "chain_broken"),
        (F.col("phases_before") == 0, "duplicate_phase"),
    )
    rule = F.least("own", late)
    per_lineage = joined.groupBy("lineage_id").agg(
        F.min(F.when(rule.isNotNull(), F.struct(F.col("position"), rule.alias("rule")))).alias("first"),
        F.count("*").alias("rows"),
        F.max("times").alias("times"),
        F.count_if("misplaced").alias("misplaced"),
    )
    judged = per_lineage.join(_evidence_failures(receipts, evidence).hint("merge"), "lineage_id", "left")
    differs = F.struct(F.col("differs_at").alias("position"), F.lit(RECEIPT_RULES.index("evidence_mismatch")).alias("rule"))
    judged = judged.select(
        "lineage_id",
        F.least("first", F.when(F.col("differs_at").isNotNull(), differs))["rule"].alias("rule"),
        (F.col("rows") + F.coalesce("again", F.lit(0)) * F.coalesce("times", F.lit(1))).alias("receipts"),
        "misplaced",
    )
    known_lineages = inputs.select("lineage_id").join(judged.hint("merge"), "lineage_id", "left")
    code = F.element_at(F.array(*[F.lit(c) for c in RECEIPT_RULES]), F.col("rule") + 1)
    failure = F.coalesce(
        F.when(F.col("receipts").isNull(), "receipts_missing"),
        F.when(F.col("rule").isNotNull(), code),
        F.when(
            (F.col("receipts") != len(PHASES)) | (F.col("misplaced") > 0),
            "phase_policy",
        ),
    )
    return known_lineages.select("lineage_id", failure.alias("failure"), failure.isNull().alias("ready"))


def written_references(spark: SparkSession, path: str) -> DataFrame:
    """References (path, sha256, bytes) of the files below ``path``, from what was written.

    Of a ``.gz`` file they are those of what it unpacks to.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    packed = F.col("path").endswith(".gz")
    told = files.select("path", F.when(~packed, F.sha2("content", 256)).alias("sha256"), "length", _unpacked(F.when(packed, F.col("content"))).alias("of"))
    return told.select("path", F.coalesce("sha256", "of.sha256").alias("sha256"), F.coalesce("of.bytes", "length").alias("bytes"))


@F.pandas_udf(T.StructType().add("sha256", T.StringType()).add("bytes", T.LongType()))
def _unpacked(contents: pd.Series) -> pd.DataFrame:
    def one(content: bytes | None) -> tuple[str | None, int | None]:
        if content is None:
            return None, None
        digest, size = hashlib.sha256(), 0
        with gzip.open(io.BytesIO(content)) as lines:
            while part := lines.read(1 << 20):
                digest.update(part)
                size += len(part)
        return digest.hexdigest(), size

    return pd.DataFrame([one(c) for c in contents], columns=["sha256", "bytes"]).astype({"bytes": "Int64"})


def nested_references(documents: DataFrame) -> DataFrame:
    """Artifact references anywhere in JSON bodies: ``(id, location, path, sha256, bytes)``.

    Walks one level per step with ``variant_explode`` until no body has a further one; a
    branch that is a reference is not walked further. Each level is written once, so no
    step repeats an earlier one. ``problem`` marks an incomplete or malformed reference.
    """
    spark = documents.sparkSession
    field = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
    is_set = lambda k: F.variant_get("v", f"$.{k}", "variant").isNotNull()
    shape = F.schema_of_variant("v")
    level = documents.select("id", F.lit("$").alias("location"), F.try_parse_json("body").alias("v"))
    found = []
    while True:
        level = level.withColumn("object", shape.startswith("OBJECT")).where(shape.rlike("^(OBJECT|ARRAY)"))
        is_ref = F.col("object") & (is_set("sha256") | (is_set("path") & is_set("bytes")))
        level = cut(level.select("id", "location", "v", F.coalesce(is_ref, F.lit(False)).alias("is_ref")))
        if found and level.isEmpty():
            break
        found.append(level.where("is_ref").select("id", "location", "v"))
        level = spark.sql(
            "select id, location || coalesce('.' || e.key, '[' || e.pos || ']') as location, e.value as v "
            "from {rest}, lateral variant_explode(v) e",
            rest=level.where("not is_ref"),
        )
    refs = found[0]
    for more in found[1:]:
        refs = refs.unionByName(more)
    text = lambda k: F.when(F.schema_of_variant(F.variant_get("v", f"$.{k}", "variant")) == "STRING", field(k, "string"))
    size = F.when(F.schema_of_variant(F.variant_get("v", "$.bytes", "variant")) == "BIGINT", field("bytes", "bigint"))
    problem = (
        F.when(~is_set("path") | ~is_set("sha256"), "incomplete")
        .when(F.coalesce(text("path"), F.lit("")) == "", "bad_path")
        .when(~F.coalesce(text("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "bad_hash")
        .when(~F.coalesce(size >= 0, F.lit(False)), "bad_size")
    )
    return refs.select(
        "id", "location", text("path").alias("path"), F.lower(text("sha256")).alias("sha256"), size.alias("bytes"), problem.alias("problem")
    )


def provenance_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two provenance snapshots per id: the first field that changed, null when none did."""
    fields = ("lineage_id", "inputs_sha256", "manifest_sha256")
    joined = before.join(after.select("id", *[F.col(f).alias(f"after_{f}") for f in fields], F.lit(True).alias("seen")), "id", "left")
    changed = F.when(F.col("seen").isNull(), "absent")
    for f in fields:
        changed = changed.when(~F.col(f).eqNullSafe(F.col(f"after_{f}")), f)
    return joined.select("id", changed.alias("changed"))
