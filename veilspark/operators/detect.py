"""Detectors and the detector set: text column in, array of spans out.

A detector is a list of scans, each one regex over the text. Most texts hold nothing, so the scans
share one joint probe: a single regex pass (or a byte search for a literal every match must hold)
decides whether a text is scanned at all. A scan sets marks around its matches and their values in one
pass, and a split at the marks gives the offsets where it matched. Probe, marked texts and spans sit in
consecutive steps, so no regex runs twice for its consumers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as p
from veilspark.functions.hof import built, empty, let, once
from veilspark.functions.kinds import ENTITY_TYPES, SPANS
from veilspark.functions.spans import cards_in_groups, interleaved, is_card, place_pieces, span

@dataclass(frozen=True)
class Scan:
    """One pattern. ``group`` 1 means the span is that group, which must end the match.

    ``needles`` are literals one of which every match holds. ``probe`` is a regex that finds
    something wherever ``pattern`` does, and ``first`` the characters its hits can start with.
    """

    pattern: str
    needles: tuple[str, ...] = ()
    probe: str | None = None
    first: str = ""
    group: int = 0
    keep: Callable[[Column], Column] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Detector:
    """A named entity type found by regex scans."""

    type: str
    scans: tuple[Scan, ...]
    label: str | None = None
    ignore_case: bool = False


@dataclass(frozen=True)
class ColumnDetector:
    """A plug-in: ``detect(text)`` is a column expression giving ``array<struct<start,end>>``.

    The function may build native expressions or call a ``pandas_udf``. Spans outside the text are
    dropped, and the value is always cut from the text itself.
    """

    type: str
    detect: Callable[[Column], Column] = field(compare=False)
    label: str | None = None


_DIGIT = "0-9"
EMAIL = Detector("EMAIL", (Scan(p.EMAIL, ("@",)),))
CREDIT_CARD = Detector("CREDIT_CARD", (Scan(p.CREDIT_CARD, (), p.CREDIT_CARD, _DIGIT, keep=is_card),))
SSN = Detector("SSN", (Scan(p.SSN, (), p.SSN, _DIGIT),))
PHONE = Detector("PHONE", (Scan(p.PHONE, (), p.PHONE, "0-9+("),))
JWT = Detector("JWT", (Scan(p.JWT, ("eyJ",)),))
API_KEY = Detector("API_KEY", (Scan(p.API_KEY, ("sk-", "AKIA")),))
IPV4 = Detector("IPV4", (Scan(p.IPV4, (), p.IPV4, _DIGIT),))
IPV6 = Detector("IPV6", (Scan(p.IPV6, (), p.PROBE_IPV6, ":"),))
IPV6_FULL = Detector("IPV6", (Scan(p.IPV6_FULL, (), p.PROBE_IPV6, ":"),))
DATE = Detector(
    "DATE",
    (
        Scan(p.DATE_ISO, (), p.DATE_ISO, _DIGIT),
        Scan(p.DATE_NUMERIC, (), p.DATE_NUMERIC, _DIGIT),
        Scan(p.DATE_MONTH_FIRST, (), p.PROBE_DATE_MONTH_FIRST, _DIGIT),
        Scan(p.DATE_DAY_FIRST, (), p.PROBE_DATE_DAY_FIRST, _DIGIT),
    ),
)
ADDRESS = Detector("ADDRESS", (Scan(p.ADDRESS, (), p.PROBE_ADDRESS, _DIGIT),))
NAME = Detector(
    "NAME",
    (
        Scan(p.NAME_HONORIFIC, (), p.NAME_HONORIFIC, "DMPS"),
        Scan(p.NAME_CUE, (), p.PROBE_NAME_CUE, "sm:", group=1),
    ),
)

#: Opt-in: known key formats, and values assigned to a name like ``token`` or ``api_key``.
API_KEY_ASSIGNED = Detector("API_KEY", (*API_KEY.scans, Scan(p.API_KEY_ASSIGNED, (), "[:=]", ":=", group=1)))


def _subspan_cards(text: Column) -> Column:
    return F.when(text.rlike(p.CREDIT_CARD), cards_in_groups(text))


#: Opt-in: a card followed or preceded by other groups of digits is found as well.
CREDIT_CARD_SUBSPAN = ColumnDetector("CREDIT_CARD", _subspan_cards)

BUILT_IN: tuple[Detector, ...] = (
    EMAIL,
    CREDIT_CARD,
    SSN,
    PHONE,
    JWT,
    API_KEY,
    IPV4,
    IPV6,
    DATE,
    ADDRESS,
    NAME,
)
MODEL_RANK = 1_000_000
#: The unit separator is set around matches. Texts that hold it themselves are split at the pattern.
MARK = "\x1f"


def detector_set(*custom: Detector | ColumnDetector, built_in: Sequence[Detector] = BUILT_IN):
    """Built-in detectors, then custom ones. The place in this list decides ties."""
    return (*built_in, *custom)


def check_types(detectors: Sequence[Detector | ColumnDetector]) -> None:
    for d in detectors:
        if d.type not in ENTITY_TYPES:
            raise ValueError(f"unknown entity type {d.type!r}")


def _keeps(keep: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: keep(s["value"])


def bounded(spans: Column, text: Column) -> Column:
    """Keep spans whose offsets are present and lie inside the text."""
    return F.filter(
        spans,
        lambda s: s["start"].isNotNull()
        & s["end"].isNotNull()
        & (s["start"] >= 0)
        & (s["end"] <= F.length(text))
        & (s["end"] > s["start"]),
    )


def cut_spans(spans: Column, text: Column, kind: str | None, label: str | None, rank: int) -> Column:
    """Turn bare offsets into spans, taking the values from the text."""
    return F.transform(
        bounded(spans, text),
        lambda s: span(
            s["type"] if kind is None else F.lit(kind),
            s["start"],
            s["end"],
            F.substring(text, s["start"] + 1, s["end"] - s["start"]),
            F.lit(label),
            F.lit(rank),
        ),
    )


def _has_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(needles[0]))
    for n in needles[1:]:
        hit = hit | F.contains(text, F.lit(n))
    return hit


def _joint_probe(scans: Sequence[Scan]) -> str | None:
    """All probes of a detector set as one regex, grouped by the characters they start with."""
    groups: dict[str, list[str]] = {}
    for s in scans:
        if s.probe:
            groups.setdefault(s.first, []).append(s.probe)
    if sum(map(len, groups.values())) < 2 and not any(s.probe and s.probe != s.pattern for s in scans):
        return None
    tried = "|".join(f"(?=[{first}])(?:{'|'.join(probes)})" for first, probes in groups.items())
    return f"(?=[{''.join(groups)}])(?:{tried})"


def _cut_at_pattern(text: Column, scan: Scan) -> Column:
    """The pieces of a text, without marks."""
    found = lambda group: F.regexp_extract_all(text, F.lit(scan.pattern), F.lit(group))
    gaps = F.split(text, scan.pattern, -1)
    return let(found(0), lambda matches: interleaved(matches, found(scan.group) if scan.group else None, gaps))


def detect(
    df: DataFrame,
    text: str = "text",
    detectors: Sequence[Detector | ColumnDetector] = BUILT_IN,
    out: str = "spans",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: every span every detector finds, in detector order. Narrow, no shuffle.

    ``extra`` names span array columns (model output) that are appended and then dropped.
    """
    check_types(detectors)
    if all(isinstance(d, Detector) for d in detectors):
        # Rules that keep matches do not take part in the comparison of detectors, so they are named, too.
        known = tuple((d, *(s.keep for s in d.scans)) for d in detectors)
        steps = built(("detect", text, known, tuple(extra)), lambda: _steps(text, detectors, extra))
    else:
        steps = _steps(text, detectors, extra)
    probed, raw, scanned, spans = steps
    matched = df.withColumns(probed).withColumns(raw).withColumns(scanned)
    return once(matched, out, spans).drop(*probed, *raw, *scanned, *extra)


def _steps(
    text: str, detectors: Sequence[Detector | ColumnDetector], extra: Sequence[str]
) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column], Column]:
    """The probe, the raw matches, the scans and the spans, as columns to be added one after the other."""
    t = F.col(text)
    probe = _joint_probe([s for d in detectors if isinstance(d, Detector) for s in d.scans])
    probed = {"__probed": t.rlike(probe)} if probe else {}
    if any(isinstance(d, Detector) for d in detectors):
        probed["__marks"] = F.contains(t, F.lit(MARK))
    raw: dict[str, Column] = {}
    scans: list[Column] = []
    plugged: list[Column] = []

    def keep(scan_no: Column, value: Column) -> Column:
        ok = F.lit(True)
        for no, rule in rules.items():
            ok = F.when(scan_no == no, rule(value)).otherwise(ok)
        return ok

    rules: dict[int, Callable[[Column], Column]] = {}
    for rank, d in enumerate(detectors):
        if isinstance(d, ColumnDetector):
            name = f"__d{rank}"
            raw[name] = d.detect(t)
            plugged.append(F.coalesce(cut_spans(F.col(name), t, d.type, d.label, rank), empty(SPANS)))
            continue
        for i, s in enumerate(d.scans):
            name = f"__d{rank}_{i}"
            # The whole match, then, with a group, that group again.
            marked = F.regexp_replace(t, s.pattern, MARK + "$0" + MARK + ("$1" + MARK if s.group else ""))
            gate = _has_any(t, s.needles) if s.needles else F.col("__probed") if s.probe and probe else None
            raw[name] = marked if gate is None else F.when(gate, marked)
            if s.keep:
                rules[len(scans)] = s.keep
            pieces = F.when(F.col("__marks"), _cut_at_pattern(t, s))
            scan = F.struct(
                F.lit(d.type).alias("type"),
                F.lit(d.label).cast("string").alias("label"),
                F.lit(rank).alias("rank"),
                F.lit(len(scans)).alias("scan"),
                F.lit(3 if s.group else 2).alias("stride"),
                pieces.otherwise(F.split(F.col(name), MARK, -1)).alias("pieces"),
            )
            scans.append(F.when(F.col(name) != t, scan))

    def spans_of(scan: Column) -> Column:
        placed = place_pieces(
            scan["pieces"],
            scan["stride"],
            lambda start, end, v: span(scan["type"], start, end, v, scan["label"], scan["rank"]),
        )
        return F.filter(placed, lambda x: keep(scan["scan"], x["value"])) if rules else placed

    # Ranks order the spans of scans and plug-ins later, so these two groups may be joined freely.
    steps = {}
    parts = [*plugged, *(F.coalesce(F.col(c), empty(SPANS)) for c in extra)]
    if scans:
        steps["__scans"] = F.array_compact(F.array(*scans))
        parts.insert(0, F.flatten(F.transform("__scans", spans_of)))
    spans = F.concat(*parts) if parts else empty(SPANS)
    return probed, raw, steps, spans


def findings(df: DataFrame, *ids: str, spans: str = "spans") -> DataFrame:
    """One row per span: the findings table. Keeps only the named id columns."""
    return df.select(*ids, F.explode(spans).alias("s")).select(*ids, "s.*")

