"""Built-in detector patterns, written for the Java regex engine.

Three rules keep the matches equal to what an ASCII-only engine finds:

* Java's ``\\b`` treats accented letters as word characters, so word borders are spelled as ASCII
  lookarounds (``\\w`` itself is ASCII in Java).
* ``\\s`` is spelled out, because Java's leaves out the no-break and other Unicode spaces.
* ``(?i)`` folds ASCII only, which is what the patterns here need.

Where a match can only start with a digit, the digit is consumed or seen *before* the look-behind that
checks its left border. The set of matches is the same, and a position that holds no digit is
rejected by one character test. Runs that cannot usefully give back characters are possessive.
"""

from __future__ import annotations

# Fixed values.
SPACE_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
STREET_SUFFIXES = (
    "Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|"
    "Way|Circle|Cir|Place|Pl|Highway|Hwy|Parkway|Pkwy|Terrace|Ter|Square|Sq|Trail|Trl"
)
ADDRESS_UNITS = "Apt|Apartment|Suite|Ste|Unit|Room|Rm|#"
HONORIFICS = "Mr|Mrs|Ms|Dr|Prof|Miss|Sir|Mx"
NAME_CUES = "[Mm]y name is|[Nn]ame is|[Ii] am|[Ii]'m|[Tt]his is|[Nn]ame:"
CAPITALIZED = "[A-Z][a-z]+"
ORDINALS = "st|nd|rd|th"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Java looks single characters of a class up in one table, but asks each range and nested class in turn.
_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _DIGITS + _UPPER + _UPPER.lower()
_HEX_DIGIT = f"[{_DIGITS}ABCDEFabcdef]"
HEX = f"{_HEX_DIGIT}{{1,4}}"

# The same characters, so written that a class asks one table for ASCII and one range for the rest first:
# Java tries the members of a class one by one.
_WIDE_SPACES = r"[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
_SPACES = r"\s[\u00A0-\uFEFF&&[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
_SINGLE_SPACES = r"\t\n\x0B\f\r \u00A0"
S = f"[{_SPACES}]"
_S_TABLE = f"[{_SINGLE_SPACES}{_WIDE_SPACES}]"
_PHONE_SEP = f"[{_SINGLE_SPACES}.{_WIDE_SPACES}-]"

EMAIL = (
    rf"(?:\w(?<!\w\w)|[.%+-](?<=\w[.%+-]))[{_ALNUM}_.%+-]*+@[{_ALNUM}.-]+\.[A-Za-z]{{2,}}(?!\w)"
)
CREDIT_CARD = r"\d(?<!\w\d)(?:[ -]?\d){12,18}(?!\w)"
#: Groups of digits parted by one blank or hyphen, each a whole word.
DIGIT_GROUPS = r"(?<!\w)[0-9]++(?!\w)(?:[ -][0-9]++(?!\w))*+"
SSN = r"\d(?<!\w\d)(?<!9)\d\d(?<!000|666)[- ](?!00)\d{2}[- ](?!0000)\d{4}(?!\w)"
PHONE = (
    rf"(?=[{_DIGITS}+(])(?<!\w)(?:\+?\d{{1,3}}{_PHONE_SEP}?)?(?:\(\d{{3}}\)|\d{{3}})"
    rf"{_PHONE_SEP}?\d{{3}}{_PHONE_SEP}?\d{{4}}(?!\w)"
)
# The two secret formats have no published pattern to match; these are our own.
# Their left border is checked behind the literal they start with, like that of a digit.
JWT = rf"eyJ(?<!\weyJ)[{_ALNUM}_-]++\.eyJ[{_ALNUM}_-]++\.[{_ALNUM}_-]++"
API_KEY = rf"(?=[sA])(?:sk-(?<!\wsk-)[{_ALNUM}_-]{{20,}}+|AKIA(?<!\wAKIA)[0-9A-Z]{{16}}(?!\w))"
#: Opt-in form: what is assigned to a name that says it is a secret. Our own, too.
API_KEY_ASSIGNED = (
    r"(?i)(?=[aspt])(?<!\w)(?:api[_-]?key|access[_-]?key|secret|password|token)[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_-]{20,}+)"
)
IPV4 = rf"(?=\d)(?<!\w)(?:{OCTET}\.){{3}}{OCTET}(?!\w)"

# Ordered choice: an earlier form wins even when a later one would match more text.
_IPV6_FORMS = (
    f"(?:{HEX}:){{7}}{HEX}",
    f"(?:{HEX}:){{1,7}}:",
    f"(?:{HEX}:){{1,6}}:{HEX}",
    f"(?:{HEX}:){{1,5}}(?::{HEX}){{1,2}}",
    f"(?:{HEX}:){{1,4}}(?::{HEX}){{1,3}}",
    f"(?:{HEX}:){{1,3}}(?::{HEX}){{1,4}}",
    f"(?:{HEX}:){{1,2}}(?::{HEX}){{1,5}}",
    f"{HEX}:(?::{HEX}){{1,6}}",
)
_IPV6_TAIL = f"(?:(?::{HEX}){{1,7}}|:)"
IPV6 = rf"(?:(?={HEX}+:)(?<!\w)(?:{'|'.join(_IPV6_FORMS)})|:(?<=\w:){_IPV6_TAIL})"
# Opt-in form that takes the longest address at each place, and accepts a leading "::".
IPV6_FULL = (
    rf"(?:(?={_HEX_DIGIT})(?<![\w:])(?:{_IPV6_FORMS[0]}|{'|'.join(reversed(_IPV6_FORMS[2:]))}|"
    rf"{_IPV6_FORMS[1]})|(?<![\w:]):{_IPV6_TAIL})(?![\w:])"
)

DATE_ISO = r"\d(?<!\w\d)\d{3}-\d{2}-\d{2}(?!\w)"
DATE_NUMERIC = r"\d(?<!\w\d)\d?[/-]\d{1,2}[/-]\d{2,4}(?!\w)"
DATE_MONTH_FIRST = (
    rf"(?i)(?=[ADFJMNOS])(?<!\w)(?:{MONTHS})\.?{S}+\d{{1,2}}(?:{ORDINALS})?,?{S}+\d{{4}}(?!\w)"
)
DATE_DAY_FIRST = (
    rf"(?i)\d(?<!\w\d)\d?(?:{ORDINALS})?{S}+(?:{MONTHS})\.?,?{S}+\d{{4}}(?!\w)"
)
ADDRESS = (
    rf"(?i)\d(?<!\w\d)\d{{0,5}}{_S_TABLE}++(?:[{_ALNUM}.'-]++{_S_TABLE}++){{0,4}}"
    rf"(?=[ABCDHLPRSTW])(?:{STREET_SUFFIXES})(?!\w)\.?"
    rf"(?:,?{S}+(?:{ADDRESS_UNITS})\.?{S}*#?{S}*\w+)?"
)
NAME_HONORIFIC = (
    rf"(?=[DMPS])(?<!\w)(?:{HONORIFICS})\.?{S}+{CAPITALIZED}(?:{S}+{CAPITALIZED}){{0,2}}"
)
NAME_CUE = rf"(?=[IMNTimnt])(?:{NAME_CUES}){S}+({CAPITALIZED}(?:{S}+{CAPITALIZED}){{0,2}})"

PLACEHOLDER = r"\[[A-Z0-9_]+\]"
OPEN_PLACEHOLDER = r"\[[A-Z0-9_]*\z"

# Probes: one per pattern, true wherever the pattern could match, and cheap to reject. All probes of
# a detector set are tried together in a single pass over the text; only texts where one holds are
# scanned pattern by pattern.
PROBE_IPV6 = ":[0-9A-Fa-f]{0,4}:"
PROBE_DATE_MONTH_FIRST = rf"(?i:\d(?<!\w\d)\d?(?:{ORDINALS})?,?{S}+\d{{4}}(?!\w))"
PROBE_DATE_DAY_FIRST = DATE_DAY_FIRST.replace("(?i)", "(?i:") + ")"
PROBE_ADDRESS = ADDRESS.replace("(?i)", "(?i:") + ")"
PROBE_NAME_CUE = rf"[sm:]{S}++[A-Z][a-z]"
