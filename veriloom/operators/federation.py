"""Closed contracts of a source registry, policy rules and entity candidates; verdict columns, or errors with strict()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.checks import is_hash, is_slug, is_unit

# The closed vocabularies.
ACCESS = ("open", "key_required", "rate_limited", "restricted_or_registered", "endpoint_alias_needed", "source_lead_only", "account_required")
PRIORITIES = ("high", "medium", "low")
CAPTURES = ("VERIFIED", "EMPTY_WARNING", "DROPPED_WARNING")
HTTP_CAPTURES = ("HTTP_503_WARNING", "HTTP_400_QUERY_SHAPE_WARNING", "HTTP_429_RATE_LIMIT_WARNING")
VERDICTS = {"429": "retryable_source_lead", "403": "access_escalation", "503": "retry_after"}
ROW = ("id", "system", "family", "domain", "access", "adapter", "url", "scope", "priority")
RULE = ("rule", "source_capture_ref", "failure_class", "superseded")
MATCH = ("candidate_id", "identifier_path", "confidence", "evidence_refs", "exact_id_join")
FORBIDDEN = {
    ("coverage", "registry_size"): "source_count_as_world_coverage",
    ("availability", "registry_listing"): "registry_listing_as_endpoint_availability",
    ("full_text", "metadata"): "metadata_as_full_text",
    ("availability", "access_token"): "closed_key_source_as_available",
    ("match", "empty_capture"): "empty_capture_as_match",
    ("absence", "route_failure"): "route_failure_as_source_absence",
}
ALLOWED = (("availability", "verified_capture"), ("match", "verified_capture"), ("full_text", "verified_capture"), ("absence", "exhausted_alternates"))
COVERAGE = "present registry size as coverage"
# Action, live probe, steps and prohibitions of each access token.
PLANS = {
    "open": ("capture", True, ["capture immediately", "record the body hash in the receipt"], []),
    "key_required": ("record_lead", False, ["record the source lead", "capture the public docs", "record the credential requirement for the operator"], ["attempt hidden credentials", "claim availability without a verified capture"]),
    "rate_limited": ("retry_gated_capture", True, ["record the retry policy", "capture within the recorded retry policy", "record the body hash in the receipt"], ["probe live before the retry policy is recorded"]),
    "restricted_or_registered": ("docs_then_admission", False, ["capture the public docs", "record an admission-gated future task"], ["claim availability without a verified capture"]),
    "endpoint_alias_needed": ("alias_check", True, ["record the stale endpoint", "record the alternate endpoint", "capture through the recorded alternate"], ["declare source absence before an alternate endpoint is recorded"]),
    "source_lead_only": ("catalog_only", False, ["catalog the source lead"], ["claim availability", "claim coverage"]),
    "account_required": ("account_gated", False, ["record the account requirement", "capture the public docs", "record an admission-gated future task"], ["create or borrow an account", "attempt hidden credentials", "claim availability without a verified capture"]),
}


def _first_error(*checks: tuple[Column, Column | str]) -> Column:
    out = None
    for bad, message in checks:
        m = F.lit(message) if isinstance(message, str) else message
        out = F.when(bad, m) if out is None else out.when(bad, m)
    return out


# Fields of each kind of document, and the list that an object has them under.
DOCUMENTS = {
    "sources": {c: "string" for c in ROW},
    "rules": {"rule": "string", "source_capture_ref": "string", "failure_class": "string", "superseded": "boolean"},
    "candidates": {"candidate_id": "string", "identifier_path": "string", "confidence": "double", "evidence_refs": "array<string>", "exact_id_join": "boolean"},
}


def document_rows(documents: DataFrame, within: str, payload: str = "payload", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with pos, keys and the fields of the kind; errors) of JSON documents: a list, or an object with a list `within`.

    A value of another type than its field's is null, which validation refuses; `keys` are the raw object's, null where an
    element is no object.
    """
    whole, inner = F.ltrim(F.col(payload)), F.ltrim(F.get_json_object(payload, f"$.{within}"))
    listed = F.when(whole.startswith("["), whole).when(whole.startswith("{") & inner.startswith("["), inner)
    read = documents.select(*keep, F.when(F.try_parse_json(F.col(payload)).isNotNull(), F.from_json(listed, "array<string>")).alias("_rows"))
    each = read.where("_rows IS NOT NULL").select(*keep, F.posexplode("_rows").alias("pos", "_raw")).withColumn("_v", F.try_parse_json(F.col("_raw")))

    def value(name: str, kind: str) -> Column:
        own = F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
        told = F.schema_of_variant(own)
        same = {"string": told == "STRING", "boolean": told == "BOOLEAN", "double": told.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "array<string>": told == "ARRAY<STRING>"}[kind]
        return F.when(same, F.try_variant_get(F.col("_v"), f"$.{name}", kind)).alias(name)

    rows = each.select(*keep, "pos", F.json_object_keys("_raw").alias("keys"), *[value(n, k) for n, k in DOCUMENTS[within].items()])
    return rows, read.where("_rows IS NULL").select(*keep, F.lit(f'a document must be a list or {{"{within}": [...]}}').alias("error"))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def validate_rows(rows: DataFrame, keys: str | None = None) -> DataFrame:
    """Registry rows with `error`: the first violation, or null.  `keys`: a column with the raw object's keys, if known."""
    shape = []
    if keys:
        k = F.col(keys)
        shape = [(F.size(F.array_except(k, F.array(*map(F.lit, ROW)))) > 0, "unknown field"), (F.size(F.array_except(F.array(*map(F.lit, ROW)), k)) > 0, "missing field")]
    others = [(_empty(c), f"empty {c}") for c in ("system", "family", "domain", "adapter", "url", "scope")]
    error = _first_error(*shape, (~is_slug(F.col("id")), "bad id"), (~F.coalesce(F.col("access").isin(*ACCESS), F.lit(False)), "unknown access"), (~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False)), "bad priority"), *others)
    return rows.withColumn("error", error)


def validate_registry(rows: DataFrame, order: str, keys: str | None = None) -> DataFrame:
    """As validate_rows; a later row of an id that a valid earlier row has is a duplicate."""
    checked = validate_rows(rows, keys)
    turn = F.row_number().over(Window.partitionBy("id", F.col("error").isNull()).orderBy(order))
    return checked.withColumn("error", F.when(F.col("error").isNull() & (turn > 1), F.lit("duplicate id")).otherwise(F.col("error")))


def strict(rows: DataFrame) -> DataFrame:
    """Raise on the first row with an error instead of carrying it."""
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))


def _receipt(kind: str, id: Column, title: Column, ref: Column, method: str, json: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), id.alias("id"), title.alias("title"), F.lit("federation").alias("source"), ref.alias("ref"), F.lit(method).alias("method"), canon.sha256(json).alias("sha256"), F.array().cast("array<string>").alias("derived_from")]


def registry_receipts(rows: DataFrame) -> DataFrame:
    """Receipts of valid rows: the hash covers every field."""
    json = canon.object_({c: canon.string(F.col(c)) for c in ROW})
    title = F.concat(F.col("system"), F.lit(": "), F.col("family"))
    return rows.where("error IS NULL").select(*_receipt("federation-source", F.col("id"), title, F.col("url"), "registry", json))


def capture_status(captures: DataFrame, by: str, prefix: str = "") -> DataFrame:
    """One evidence status a source: verified alone, verified with warnings, the sorted-first warning, or a lead only.

    `captures` is sources left-joined with their statuses (null: none).  `prefix` stands before the own status names.
    """
    known = [prefix + c for c in CAPTURES] + list(HTTP_CAPTURES)
    verified = prefix + "VERIFIED"
    seen = captures.groupBy(by).agg(F.array_sort(F.collect_set("status")).alias("seen"), F.bool_or(F.col("status").isNotNull() & ~F.col("status").isin(*known)).alias("unknown"))
    status = F.when(F.coalesce("unknown", F.lit(False)), F.lit("unknown status")).when(F.size("seen") == 0, F.lit("SOURCE_LEAD_ONLY"))
    status = status.when(F.array_contains("seen", verified) & (F.size("seen") > 1), F.lit(verified + "_WITH_WARNINGS")).otherwise(F.get("seen", F.lit(0)))
    return seen.select(by, status.alias("evidence"))


def plan_table(df: DataFrame) -> DataFrame:
    """The seven plans as rows."""
    rows = [(k, a, p, s, [*f, COVERAGE]) for k, (a, p, s, f) in PLANS.items()]
    return df.sparkSession.createDataFrame(rows, "access string, action string, live_probe boolean, steps array<string>, forbids array<string>")


def compile_plans(rows: DataFrame) -> DataFrame:
    """Each row with its plan; tokens outside the vocabulary get nulls.  Seven rows are broadcast, whatever the data."""
    return rows.join(F.broadcast(plan_table(rows)), "access", "left")


def guard_claims(claims: DataFrame) -> DataFrame:
    """allowed and refusal (the pattern's name, or denied by default) of each (claim, basis)."""
    pair = lambda p: (F.col("claim") == p[0]) & (F.col("basis") == p[1])
    refusal = _first_error(*[(pair(p), name) for p, name in FORBIDDEN.items()])
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | pair(p)
    allowed = F.coalesce(allowed, F.lit(False))
    return claims.withColumn("allowed", allowed).withColumn("refusal", F.when(~F.col("allowed"), F.coalesce(refusal, F.lit("denied by default"))))


def failure_verdict(failure_class: Column) -> Column:
    return _first_error(*[(failure_class == k, v) for k, v in VERDICTS.items()])


def validate_policy_rules(rows: DataFrame) -> DataFrame:
    verdict = failure_verdict(F.col("failure_class"))
    error = _first_error((_empty("rule"), "empty rule"), (~is_hash(F.col("source_capture_ref")), "no capture ref"), (verdict.isNull(), "unknown failure class"), (~F.coalesce(~F.col("superseded"), F.lit(False)), "superseded"))
    return rows.withColumn("verdict", verdict).withColumn("error", error)


def policy_receipts(rows: DataFrame) -> DataFrame:
    json = canon.object_({"rule": canon.string(F.col("rule")), "source_capture_ref": canon.string(F.col("source_capture_ref")), "failure_class": canon.string(F.col("failure_class")), "superseded": F.lit("false"), "verdict": canon.string(F.col("verdict"))})
    title = F.concat(F.col("failure_class"), F.lit(" -> "), F.col("verdict"))
    return rows.where("error IS NULL").select(*_receipt("federation-policy-rule", F.col("rule"), title, F.col("source_capture_ref"), "policy", json))


def validate_matches(rows: DataFrame) -> DataFrame:
    refs = F.col("evidence_refs")
    good = F.coalesce((F.size(refs) > 0) & F.forall(refs, lambda r: is_hash(r)), F.lit(False))
    error = _first_error((_empty("candidate_id"), "empty candidate_id"), (_empty("identifier_path"), "no identifier path"), (~is_unit(F.col("confidence")), "bad confidence"), (~good, "bad evidence"), (F.col("exact_id_join").isNull(), "bad exact_id_join"))
    return rows.withColumn("error", error)


def match_receipts(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    json = canon.object_({"candidate_id": canon.string(F.col("candidate_id")), "identifier_path": canon.string(F.col("identifier_path")), "confidence": canon.floating(F.col("confidence")), "evidence_refs": canon.strings(F.col("evidence_refs")), "exact_id_join": canon.boolean(F.col("exact_id_join"))})
    title = F.concat(F.col("identifier_path"), F.lit(": "), F.col("candidate_id"))
    return rows.where("error IS NULL").select(*keep, *_receipt("federation-entity-match", F.col("candidate_id"), title, F.get("evidence_refs", F.lit(0)), "entity", json))


def resolve_entities(rows: DataFrame, by: str, order: str) -> DataFrame:
    """One row a ranking: resolved (the top candidate) or the reason it is not.  Rankings are checked, never re-sorted."""
    checked = validate_matches(rows)
    before = F.lag("confidence").over(Window.partitionBy(by).orderBy(order))
    checked = checked.withColumn("_falls", F.coalesce(F.col("confidence") <= before, before.isNull()))
    g = checked.groupBy(by).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("error"), F.bool_and("_falls").alias("falls"), *[F.min_by(c, order).alias(c) for c in ("candidate_id", "identifier_path", "confidence", "exact_id_join")])
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("falls"), "not ordered by confidence").when(~F.col("exact_id_join"), "no exact-id join at the top")
    g = g.withColumn("error", error)
    return g.select(by, F.when(F.col("error").isNull(), F.col("candidate_id")).alias("resolved"), F.when(F.col("error").isNull(), F.col("identifier_path")).alias("identifier_path"), F.when(F.col("error").isNull(), F.col("confidence")).alias("confidence"), "error")


def validate_bundle(entries: DataFrame, by: str, order: str, statuses: tuple[str, ...] = ("pass", "fail", "unverified", "warn", "needs-human", "not-applicable", "unknown")) -> DataFrame:
    """Issues of each bundle's entries, in order: missing fields, bad status, bad hash, repeated ids."""
    fields = ("entry_id", "organ_id", "receipt_kind", "status", "payload_sha256", "summary", "payload_ref")
    w = Window.partitionBy(by).orderBy(order)
    at = F.concat(F.lit("entry["), (F.row_number().over(w) - 1).cast("string"), F.lit("] "))
    turn = F.row_number().over(Window.partitionBy(by, "entry_id").orderBy(order))
    found = [F.when(F.col(f).isNull(), F.concat(at, F.lit(f"missing {f}"))) for f in fields]
    found.append(F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), F.concat(at, F.lit("bad status"))))
    found.append(F.when(~is_hash(F.col("payload_sha256")), F.concat(at, F.lit("payload_sha256 is not a 64-hex digest"))))
    found.append(F.when(turn > 1, F.concat(F.lit("duplicate entry_id "), F.coalesce("entry_id", F.lit("null")))))
    return entries.select("*", F.array_compact(F.array(*found)).alias("issues"))
