"""JSON views of results: plain data, JSON lines, and sealed payloads."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import federation, items, seal


def plain(value: object, _above: tuple[int, ...] = ()) -> object:
    """Rows, dataclasses and containers as dicts and lists; a container within itself is an error."""
    if id(value) in _above:
        raise ValueError("a container holds itself")
    above = (*_above, id(value))
    if hasattr(value, "as_dict"):
        return plain(value.as_dict(), above)
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True), above)
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name), above) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v, above) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v, above) for v in value]
    return value


def to_json(value: object, indent: int | None = 2) -> str:
    return json.dumps(plain(value), indent=indent, ensure_ascii=False, default=str)


def to_jsonl(values) -> str:
    return "".join(json.dumps(plain(v), ensure_ascii=False, default=str) + "\n" for v in values)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, written in parallel."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def catalog_payload(rows: DataFrame, dropped: int, limit: int = 1000) -> dict:
    """{catalog, digest, dropped} for display: the catalog is a top-k report of `limit` rows, the seal covers all."""
    sealed = seal.seal(items.receipts(rows)).first()
    shown = [plain(r) for r in items.catalog_rows(rows).limit(limit).collect()]
    return {"schema": "catalog-digest/1", "catalog": shown, "digest": {"digested": sealed["digested"], "seal": sealed["seal"]}, "dropped": dropped}


def _admitted(checked: DataFrame, order: str) -> DataFrame:
    bad = checked.where("error IS NOT NULL").orderBy(order).select("error").first()
    if bad:
        raise ValueError(bad["error"])
    return checked


def policy_payload(rules: DataFrame, order: str) -> dict:
    """Sealed policy rules; the first violation raises.  Rows are shown whole, as a policy document is one JSON value."""
    checked = _admitted(federation.validate_policy_rules(rules), order)
    sealed = seal.seal(federation.policy_receipts(checked)).first()
    shown = checked.orderBy(order).select("rule", "source_capture_ref", "failure_class", "superseded", "verdict").collect()
    return {"schema": "policy-receipts/1", "rules": plain(shown), "digest": plain(sealed)}


def entity_payload(matches: DataFrame, order: str) -> dict:
    """The resolution of one ranking, and the seal over its candidates; a ranking that does not hold raises."""
    resolved = federation.resolve_entities(matches.withColumn("_ranking", F.lit(1)), "_ranking", order).drop("_ranking").first()
    if resolved is None or resolved["error"]:
        raise ValueError(resolved["error"] if resolved else "no candidates")
    sealed = seal.seal(federation.match_receipts(_admitted(federation.validate_matches(matches), order))).first()
    return {"schema": "entity-resolution/1", "resolution": {k: v for k, v in plain(resolved).items() if k != "error"}, "digest": plain(sealed)}


def envelope(command: str, status: str = "MATCH", native: dict | None = None, next_actions: list[dict] | None = None, diagnostics: list[dict] | None = None) -> dict:
    """One command's answer for programs: what ran, how it ended, its own result, and what could be done next."""
    return {"schema": "operator-envelope/1", "tool": "veriloom", "command": command, "status": status, "native": plain(native or {}), "next_actions": plain(next_actions or []), "diagnostics": plain(diagnostics or [])}


def registry_payload(rows: DataFrame, order: str, plans: bool = False) -> dict:
    """Sealed registry snapshot; the first violation raises."""
    checked = _admitted(federation.validate_registry(rows, order), order)
    sealed = seal.seal(federation.registry_receipts(checked)).first()
    out = {"sources": sealed["digested"], "seal": sealed["seal"]}
    if plans:
        out["plans"] = [plain(r) for r in federation.plan_table(rows).orderBy("access").collect()]
    return out
