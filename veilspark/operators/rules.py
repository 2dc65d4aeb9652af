"""Custom rules: validated user patterns and term lists as detectors."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.functions.dialect import RuleError, check_safe, java_flags, quote_terms, to_java
from veilspark.operators.detect import Detector, Scan


@dataclass(frozen=True)
class Rule:
    """``pattern`` wins over ``terms``. Terms match whole words, case-sensitive without flag ``i``."""

    name: str
    pattern: str | None = None
    flags: str | None = None
    terms: tuple[str, ...] = ()


def rule_from(spec: Mapping) -> Rule:
    """A rule from a parsed JSON object; wrong shapes are errors."""
    if not isinstance(spec, Mapping):
        raise RuleError("Custom rules must be JSON objects.")
    name, pattern, flags, terms = (spec.get(k) for k in ("name", "pattern", "flags", "terms"))
    if not isinstance(name, str) or not name:
        raise RuleError("Custom rule without a name.")
    for field, value in (("pattern", pattern), ("flags", flags)):
        if value is not None and not isinstance(value, str):
            raise RuleError(f'Custom rule "{name}": {field} must be a string.')
    if terms is not None and (
        not isinstance(terms, (list, tuple)) or any(not isinstance(t, str) or not t for t in terms)
    ):
        raise RuleError(f'Custom rule "{name}": terms must be non-empty strings.')
    return Rule(name, pattern, flags, tuple(terms or ()))


def rules_from_json(raw: str) -> list[Rule]:
    """Rules from a JSON array. Blank text means no rules; bad JSON fails."""
    if not raw.strip():
        return []
    try:
        specs = json.loads(raw)
    except json.JSONDecodeError:
        raise RuleError("Custom rules are not valid JSON.") from None
    if not isinstance(specs, list):
        raise RuleError("Custom rules must be a JSON array.")
    return [rule_from(s) for s in specs]


def pattern_of(rule: Rule) -> str:
    """The Java pattern of a rule, or an error naming the rule."""
    if rule.pattern:
        check_safe(rule.name, rule.pattern)
        return to_java(rule.name, rule.pattern, rule.flags)
    if rule.terms:
        prefix = java_flags(rule.name, rule.flags)
        if prefix and any(not t.isascii() for t in rule.terms):
            prefix = prefix.replace("(?", "(?u")
        return prefix + quote_terms(list(rule.terms))
    raise RuleError(f"rule {rule.name!r} has neither a pattern nor terms")


def compile_rules(spark: SparkSession, rules: Iterable[Rule]) -> list[Detector]:
    """Detectors for all rules. Every rule is checked, by the engine that will run it, before any
    data is read; all bad rules are named in one error."""
    detectors, errors = [], []
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    for rule in rules:
        try:
            pattern = pattern_of(rule)
            try:
                compiler.compile(pattern)
            except Exception as e:  # noqa: BLE001 - the JVM names the fault
                reason = str(getattr(e, "java_exception", e)).splitlines()[0]
                raise RuleError(f"rule {rule.name!r}: invalid regex: {reason}") from None
            needles = rule.terms if not rule.pattern and len(rule.terms) <= 8 and "i" not in (rule.flags or "") else ()
            detectors.append(Detector("CUSTOM", (Scan(pattern, needles),), rule.name))
        except RuleError as e:
            errors.append(str(e))
    if errors:
        raise RuleError("; ".join(errors))
    return detectors


def load_rules(spark: SparkSession, path: str, max_bytes: int = 4 << 20) -> list[Rule]:
    """Rules from JSON arrays or JSON-lines files. Rule sets are configuration, and small: more than
    ``max_bytes`` in all is an error, found before anything is read."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"rule files are too large: {size} bytes")
    rules: list[Rule] = []
    for row in files.orderBy("path").select(F.decode("content", "UTF-8").alias("text")).collect():
        text = row["text"].strip()
        if text.startswith("["):
            rules += rules_from_json(text)
        else:
            rules += [r for line in text.splitlines() if line.strip() for r in rules_from_json(f"[{line}]")]
    return rules
