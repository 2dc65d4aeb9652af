"""The registered queries in plain SQL, for the DuckDB side of the comparison."""

from __future__ import annotations

# The detector patterns in RE2 syntax, whose \b is ASCII and which has no lookaround.
SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
S = f"[{SPACE}]"
P = f"[{SPACE}.-]"
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
SUFFIXES = (
    "Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|"
    "Way|Circle|Cir|Place|Pl|Highway|Hwy|Parkway|Pkwy|Terrace|Ter|Square|Sq|Trail|Trl"
)
UNITS = "Apt|Apartment|Suite|Ste|Unit|Room|Rm|#"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
H = "[A-Fa-f0-9]{1,4}"
CAP = "[A-Z][a-z]+"
RE2 = {
    "EMAIL": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"],
    "CREDIT_CARD": [r"\b\d(?:[ -]?\d){12,18}\b"],
    "SSN": [
        r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d\d|6[0-57-9]\d|66[0-57-9])[- ](?:0[1-9]|[1-9]\d)[- ]"
        r"(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b"
    ],
    "PHONE": [
        rf"(?:(?:\b|\B\+)\d{{1,3}}{P}?(?:\(\d{{3}}\)|\d{{3}})|\B\(\d{{3}}\)|\b\d{{3}}){P}?\d{{3}}{P}?\d{{4}}\b"
    ],
    "JWT": [r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"],
    "API_KEY": [r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}\b)"],
    "IPV4": [rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"],
    "IPV6": [
        rf"\b(?:(?:{H}:){{7}}{H}|(?:{H}:){{1,7}}:|(?:{H}:){{1,6}}:{H}|(?:{H}:){{1,5}}(?::{H}){{1,2}}|"
        rf"(?:{H}:){{1,4}}(?::{H}){{1,3}}|(?:{H}:){{1,3}}(?::{H}){{1,4}}|(?:{H}:){{1,2}}(?::{H}){{1,5}}|"
        rf"{H}:(?::{H}){{1,6}}|:(?:(?::{H}){{1,7}}|:))"
    ],
    "DATE": [
        r"\b\d{4}-\d{2}-\d{2}\b",
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
        rf"(?i)\b(?:{MONTHS})\.?{S}+\d{{1,2}}(?:st|nd|rd|th)?,?{S}+\d{{4}}\b",
        rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?{S}+(?:{MONTHS})\.?,?{S}+\d{{4}}\b",
    ],
    "ADDRESS": [
        rf"(?i)\b\d{{1,6}}{S}+(?:[A-Za-z0-9.'-]+{S}+){{0,4}}(?:{SUFFIXES})\b\.?"
        rf"(?:,?{S}+(?:{UNITS})\.?{S}*#?{S}*\w+)?"
    ],
    "NAME": [
        rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Miss|Sir|Mx)\.?{S}+{CAP}(?:{S}+{CAP}){{0,2}}",
        rf"(?:[Mm]y name is|[Nn]ame is|[Ii] am|[Ii]'m|[Tt]his is|[Nn]ame:){S}+({CAP}(?:{S}+{CAP}){{0,2}})",
    ],
}
ASSIGNED = r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|password|token)[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_-]{20,})"
ORDER = ["EMAIL", "CREDIT_CARD", "SSN", "PHONE", "JWT", "API_KEY", "IPV4", "IPV6", "DATE", "ADDRESS", "NAME"]
TOKEN = r"\[[A-Z0-9_]+\]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DAY = "(DATE '1990-01-01' + CAST(k % 9000 AS INTEGER))"
PERSON = "['Alice Chen', 'Bob Lee', 'Carla De Diaz', 'Zoe'][k % 4 + 1]"
STREET = "['Street', 'ave', 'Terrace, Apt 4B', 'Blvd.', 'Hollow'][k % 5 + 1]"
L4 = "lpad(CAST(k % 10000 AS VARCHAR), 4, '0')"
NOTES = f"""SELECT k AS note_id, c_nationkey AS tenant,
 'Account of ' || c_name || ', seen ' || strftime({DAY}, '%Y-%m-%d') || ' by Dr. ' || {PERSON} || ' '
 || strftime({DAY}, '%B %-d, %Y') || '. Again on ' || strftime({DAY}, '%-d %b %Y') || ' and '
 || strftime({DAY}, '%-m/%-d/%y') || '. Hi, my name is ' || {PERSON} || ' and I''m here since 1990. ssn '
 || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '-' || {L4}
 || ' call (415) 555-' || {L4} || ' or +1 415.555.' || lpad(CAST(k % 977 AS VARCHAR), 4, '0')
 || ' ' || CAST(k % 900 + 1 AS VARCHAR) || ' Maple ' || {STREET}
 || ' mail user' || CAST(k % 50 AS VARCHAR) || '@mail' || CAST(k % 7 AS VARCHAR) || '.example.com, '
 || 'user' || CAST(k % 50 AS VARCHAR) || '@mail' || CAST(k % 7 AS VARCHAR) || '.example.com or O.Brien+'
 || CAST(k AS VARCHAR) || '@example.co.uk. card 4111 1111 1111 ' || {L4}
 || ' café4111111111111111 and 4111-1111-1111-1111. host ' || CAST(k % 300 AS VARCHAR) || '.10.'
 || CAST(k % 7 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) || ' addr 2001:0db8:85a3:0000:0000:8a2e:0370:'
 || lpad(lower(to_hex(k % 65536)), 4, '0') || ' and fe80::' || lower(to_hex(k % 4096))
 || ' token eyJ' || md5(CAST(k AS VARCHAR)) || '.eyJ' || md5(CAST(k + 1 AS VARCHAR)) || '.' || md5(CAST(k + 2 AS VARCHAR))
 || ' key sk-' || md5(CAST(k AS VARCHAR)) || ' AKIA' || upper(substring(md5(CAST(k AS VARCHAR)), 1, 16)) || ' end.' AS text
 FROM (SELECT c_custkey AS k, c_name, c_nationkey FROM customer)"""

CORPUS = f"""SELECT 'documents' AS src, doc_id AS id, text FROM documents
 UNION ALL SELECT 'pages', page_id, html FROM pages
 UNION ALL SELECT 'notes', note_id, text FROM ({NOTES})"""

CHATS = """SELECT conv_id, turn, role, 'Hello. ' || text || ' write to u' || CAST((conv_id + turn) % 5 AS VARCHAR)
 || '@example.com, u' || CAST(conv_id % 3 AS VARCHAR) || '@example.com or call 415-555-'
 || lpad(CAST(turn % 4 AS VARCHAR), 4, '0')
 || CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN ' ssn 123-45-6789' ELSE '' END AS text FROM conversations"""

REQUESTS = """SELECT CAST(user_id AS VARCHAR) AS caller, event_id AS request_id, epoch_us(ts) // 1000 AS ts_ms,
 CASE event_type WHEN 'error' THEN '/health' WHEN 'click' THEN '/v1/redact'
 ELSE '/v1/chat/completions' END AS route FROM events"""


def reply_text_sql() -> str:
    long = "A" * 70
    return (
        "'Dear [NAME_1], ' || text || ' mail [EMAIL_1] or [EMAIL_11] call [PHONE_1][SSN_9] [note 1] ["
        f"{long}] [X'"
    )


REPLIES = (
    f"SELECT conv_id, turn, conv_id || ':' || turn AS stream_id, {reply_text_sql()} AS text "
    "FROM conversations"
)


def restored(text: str) -> str:
    """A reply text with the placeholders of its map put back."""
    return (
        f"replace(replace(replace(replace({text}, '[NAME_1]', 'Ms. Ada Byron'), '[EMAIL_1]', "
        "'u' || conv_id || '@example.com'), '[EMAIL_11]', 'v' || turn || '@example.com'), '[PHONE_1]', '415-555-0132')"
    )


LUHN = """(length(regexp_replace(value, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(
 range(1, length(regexp_replace(value, '[ -]', '', 'g')) + 1),
 lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i] AS INTEGER)
 WHEN CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i] AS INTEGER) > 4
 THEN CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i] AS INTEGER) * 2 - 9
 ELSE CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i] AS INTEGER) * 2 END)) % 10 = 0)"""


def spans(
    source: str, key: str, types: list[str] = ORDER, extra: dict[str, str] | None = None, groups: dict[str, int] | None = None
) -> str:
    """CTEs ``src`` and ``spans(key…, type, label, rank, value, start, end)``.

    ``extra`` maps a custom rule's label to its pattern.
    """
    scans = [(t, ORDER.index(t), None, p) for t in types for p in RE2[t]]
    for i, (label, pattern) in enumerate((extra or {}).items()):
        scans.append(("CUSTOM", len(ORDER) + i, label, pattern))
    raw = "\n UNION ALL ".join(
        f"SELECT {key}, '{t}' AS type, CAST({q(label) if label else 'NULL'} AS VARCHAR) AS label, {rank} AS rank, {no} AS scan, "
        f"regexp_extract_all(text, {q(p)}) AS m, regexp_extract_all(text, {q(p)}, {1 if '([A-Z]' in p else (groups or {}).get(label, 0)}) AS v, "
        f"string_split_regex(text, {q(p)}) AS g FROM src"
        for no, (t, rank, label, p) in enumerate(scans)
    )
    return f"""src AS ({source}),
 raw AS ({raw}),
 placed AS (SELECT {key}, type, label, rank, scan, unnest(m) AS mm, unnest(v) AS value,
  unnest(g[1:len(m)]) AS gg, generate_subscripts(m, 1) AS i FROM raw WHERE len(m) > 0),
 ended AS (SELECT {key}, type, label, rank, value, CAST(sum(length(gg) + length(mm))
  OVER (PARTITION BY {key}, scan ORDER BY i) AS BIGINT) AS "end" FROM placed),
 spans AS (SELECT {key}, type, label, rank, value, CAST("end" - length(value) AS BIGINT) AS start, "end"
  FROM ended WHERE type <> 'CREDIT_CARD' OR {LUHN})"""


def kept(key: str, spans_name: str = "spans") -> str:
    """CTE ``kept``: the spans left after overlap resolution. Needs WITH RECURSIVE."""
    same = " AND ".join(f"o.{k.strip()} = c.{k.strip()}" for k in key.split(","))
    cols = ", ".join(f"o.{k.strip()}" for k in key.split(","))
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}
  ORDER BY start, "end" DESC, rank, type) AS rn FROM {spans_name}),
 chosen AS (SELECT {key}, rn, type, label, value, start, "end", "end" AS last_end, true AS keep FROM ranked WHERE rn = 1
  UNION ALL SELECT {cols}, o.rn, o.type, o.label, o.value, o.start, o."end",
  CASE WHEN o.start >= c.last_end THEN o."end" ELSE c.last_end END, o.start >= c.last_end
  FROM chosen c JOIN ranked o ON {same} AND o.rn = c.rn + 1),
 kept AS (SELECT {key}, type, label, value, start, "end" FROM chosen WHERE keep)"""


def keep_last(n: int) -> str:
    """All but the last ``n`` letters and digits masked: work on the reversed string."""
    head = "(?:[^A-Za-z0-9]*[A-Za-z0-9]){" + str(n) + "}"
    shown = f"regexp_extract(reverse(value), '^{head}')"
    return (
        f"CASE WHEN {shown} = '' THEN value ELSE reverse({shown} || "
        f"regexp_replace(substring(reverse(value), length({shown}) + 1), '[A-Za-z0-9]', '*', 'g')) END"
    )


MASK = f"""CASE WHEN type IN ('CREDIT_CARD','PHONE','SSN','IPV4','IPV6','JWT','API_KEY') THEN {keep_last(4)}
 WHEN type = 'EMAIL' THEN value[1] || repeat('*', greatest(instr(value, '@') - 2, 1)) || substring(value, instr(value, '@'))
 WHEN type IN ('DATE','ADDRESS','NAME') THEN regexp_replace(value, '[A-Za-z0-9]', '*', 'g')
 WHEN length(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) > 4 THEN {keep_last(2)}
 ELSE regexp_replace(value, '[A-Za-z0-9]', '*', 'g') END"""

DISPLAY = (
    "CASE WHEN label IS NULL THEN type ELSE coalesce(nullif(trim(regexp_replace(upper(label), "
    "'[^A-Z0-9]+', '_', 'g'), '_'), ''), 'CUSTOM') END"
)


def acted(key: str, action: str) -> str:
    """CTE ``acted``: kept spans with display label and action (an SQL expression over ``type``)."""
    return f"""acted AS (SELECT {key}, type, coalesce(label, type) AS label, value, start, "end",
  {DISPLAY} AS display, {action} AS action FROM kept)"""


def numbered(key: str, scope: str, order: str) -> str:
    """CTE ``numbered``: placeholder per scope, display and value, by first occurrence."""
    part = f"{scope}, display" if scope else "display"
    return f"""firsts AS (SELECT {part}, value, min(row({order})) AS first FROM acted
  WHERE action IN ('redact', 'block') GROUP BY {part}, value),
 numbered AS (SELECT {part}, value, '[' || display || '_' ||
  CAST(row_number() OVER (PARTITION BY {part} ORDER BY first, value) AS VARCHAR) || ']' AS placeholder FROM firsts)"""


def rendered(key: str, scope: str) -> str:
    """CTE ``rendered``: redacted text, entity count and block flag per source row."""
    on = " AND ".join(f"a.{k.strip()} = n.{k.strip()}" for k in scope.split(",")) + " AND " if scope else ""
    same = " AND ".join(f"s.{k.strip()} = p.{k.strip()}" for k in key.split(","))
    own = ", ".join(f"s.{k.strip()}" for k in key.split(","))
    a_key = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    return f"""pieces AS (SELECT {a_key}, a.type, a.label, a.action, a.start, a."end",
  CASE WHEN a.action = 'mask' THEN a.masked ELSE n.placeholder END AS new
  FROM (SELECT *, {MASK} AS masked FROM acted) a LEFT JOIN numbered n ON {on}a.display = n.display AND a.value = n.value
  WHERE a.action <> 'allow'),
 gaps AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY start), 0) AS prev FROM pieces),
 joined AS (SELECT {own}, string_agg(substring(s.text, CAST(p.prev + 1 AS BIGINT), CAST(p.start - p.prev AS BIGINT)) || p.new, '' ORDER BY p.start)
  || substring(any_value(s.text), CAST(max(p."end") + 1 AS BIGINT)) AS redacted, count(*) AS n_entities,
  bool_or(p.action = 'block') AS blocked FROM src s JOIN gaps p ON {same} GROUP BY {own}),
 rendered AS (SELECT {own}, coalesce(p.redacted, s.text) AS redacted, coalesce(p.n_entities, 0) AS n_entities,
  coalesce(p.blocked, false) AS blocked FROM src s LEFT JOIN joined p ON {same})"""


def redaction(source: str, key: str, action: str = "'redact'", types: list[str] = ORDER, extra=None,
              scope: str | None = None, order: str = "start") -> str:
    """All CTEs up to ``rendered``. ``scope`` None numbers per source row; '' over the whole table."""
    by = key if scope is None else scope
    return "WITH RECURSIVE " + ",\n ".join(
        [spans(source, key, types, extra), kept(key), acted(key, action), numbered(key, by, order), rendered(key, by)]
    )


def token_map(key: str, scope_on: str) -> str:
    """Per row, the token map as one sorted string (``placeholder=value`` joined by ``|``)."""
    return f"""(SELECT string_agg(n.placeholder || '=' || n.value, '|' ORDER BY n.placeholder)
  FROM numbered n WHERE {scope_on})"""


def _detect(types: list[str]) -> str:
    return (
        "WITH " + spans(CORPUS, "src, id", types)
        + ' SELECT src, id, type, start, "end", value FROM spans'
    )


DOCS = "SELECT doc_id, text FROM documents"
ACTIONS_BY_TENANT = """CASE tenant % 4
 WHEN 0 THEN CASE type WHEN 'EMAIL' THEN 'mask' WHEN 'SSN' THEN 'block' ELSE 'redact' END
 WHEN 1 THEN CASE type WHEN 'PHONE' THEN 'allow' ELSE 'mask' END
 WHEN 2 THEN CASE type WHEN 'EMAIL' THEN 'block' ELSE 'redact' END
 ELSE 'redact' END"""
LAYERED = """CASE WHEN note_id % 3 = 0 THEN CASE type WHEN 'PHONE' THEN 'allow' ELSE 'mask' END
 WHEN note_id % 3 = 1 THEN CASE WHEN type = 'EMAIL' THEN 'block' ELSE {key} END ELSE {key} END"""
KEYED = """CASE tenant % 4 WHEN 0 THEN CASE type WHEN 'PHONE' THEN 'allow' ELSE 'mask' END
 WHEN 1 THEN 'redact' WHEN 2 THEN CASE type WHEN 'SSN' THEN 'allow' WHEN 'NAME' THEN 'mask' ELSE 'redact' END
 ELSE CASE type WHEN 'EMAIL' THEN 'mask' ELSE 'redact' END END"""
SERVER = "CASE type WHEN 'SSN' THEN 'block' ELSE 'redact' END"
MIXED = "CASE type WHEN 'EMAIL' THEN 'mask' WHEN 'PHONE' THEN 'allow' WHEN 'SSN' THEN 'block' ELSE 'redact' END"
CUSTOM = {"customer no": r"Customer#\d{9}", "codename": r"(?i)\b(?:maple hill|Maple Street|here since)\b"}
CLASSES = r"and[\s\S]{1,4}of[^\S]"
CHAT_ACTION = "CASE type WHEN 'SSN' THEN 'block' ELSE 'redact' END"
TS = "'2024-01-01T00:00:00Z'"


def _chat(action: str = "'redact'", scope: str = "conv_id", order: str = "turn, start") -> str:
    return redaction(CHATS, "conv_id, turn", action, scope=scope, order=order)


def _model_spans() -> str:
    """Model spans: the first word of every note after 'Account', and one out of bounds."""
    return """model AS (SELECT note_id, 'NAME' AS type, CAST(NULL AS VARCHAR) AS label, 1000000 AS rank, substring(text, 12, 18) AS value,
  11 AS start, 29 AS "end" FROM src)"""


BUCKET = """WITH RECURSIVE reqs AS (SELECT *, CAST({limit} AS DOUBLE) / ({window_ms} + (request_id - request_id)) AS rate
  FROM ({requests})),
 r AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY ts_ms, request_id) AS rn FROM reqs WHERE {where}),
 b AS (SELECT caller, request_id, ts_ms, route, rn, CAST({limit} AS DOUBLE) - 1 AS tokens, true AS allowed,
   CAST(0 AS BIGINT) AS retry_after_ms, CAST(floor(CAST({limit} AS DOUBLE) - 1) AS BIGINT) AS remaining FROM r WHERE rn = 1
  UNION ALL SELECT caller, request_id, ts_ms, route, rn, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1,
   CASE WHEN t >= 1 THEN 0 ELSE CAST(ceil((1 - t) / rate) AS BIGINT) END,
   CASE WHEN t >= 1 THEN CAST(floor(t - 1) AS BIGINT) ELSE 0 END
  FROM (SELECT r.caller, r.request_id, r.ts_ms, r.route, r.rn, r.rate,
   least(CAST({limit} AS DOUBLE), b.tokens + (r.ts_ms - b.ts_ms) * r.rate) AS t
   FROM b JOIN r ON r.caller = b.caller AND r.rn = b.rn + 1))"""


def bucket(limit: int, window_ms: int, where: str = "true") -> str:
    return BUCKET.format(requests=REQUESTS, limit=limit, window_ms=window_ms, where=where)


# The rate is a column, so that it is divided by as it stands. Three requests per ten hours: a limit the sparse event table runs into.
#: How long a map of the lifetime query lives.
VAULT_LIFE_MS = 7 * 3_600_000
#: Groups of digits, each a whole word, parted by one blank or hyphen.
GROUPS = r"\b[0-9]+\b(?:[ -][0-9]+\b)*"
BUCKET_LIMIT, BUCKET_WINDOW_MS = 3, 36_000_000
ONE_CALLER_LIMIT, ONE_CALLER_WINDOW_MS = 8, 43_200_000
LIMIT, LIMIT_WINDOW_SEC = 2, 36_000

CHUNKS = f"""replies AS ({REPLIES}),
 cut AS (SELECT *, unnest(range(0, CAST((length(text) - 1) // 7 + 1 AS BIGINT))) AS seq FROM replies),
 tails AS (SELECT *, least(7 * (seq + 1), length(text)) AS "end",
   regexp_extract(substring(text, 1, 7 * (seq + 1)), '\\[[A-Z0-9_]*$') AS tail FROM cut),
 held AS (SELECT *, CASE WHEN length(tail) <= 64 THEN length(tail) ELSE 0 END AS n FROM tails),
 ends AS (SELECT *, "end" - n AS upto, coalesce(lag("end" - n) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS since FROM held)"""
EMITTED = (
    "SELECT stream_id, seq, " + restored('substring(text, CAST(since + 1 AS BIGINT), CAST(upto - since AS BIGINT))')
    + " AS text, false AS flushed FROM ends UNION ALL SELECT stream_id, CAST((length(text) - 1) // 7 + 1 AS BIGINT), "
    "'[X', true FROM replies"
)
REDACTED = "redacted, n_entities, blocked"
ENTITY_COUNTS = "SELECT type, action, CAST(count(*) AS BIGINT) AS entities_total FROM pieces GROUP BY type, action"

NOTE_REDACTION = redaction(NOTES, "note_id", MIXED)
VAULT_AT = "TIMESTAMP '2024-01-01 00:00:00'"


def oracle_sql() -> dict[str, str]:
    sql = {f"detect_{t.lower()}": _detect([t]) for t in ORDER}
    sql["text_scan"] = """SELECT doc_id, CAST(length(text) AS BIGINT) AS n,
      CASE WHEN length(text) <= 5000 THEN 'ok' ELSE 'text_too_long' END AS status FROM documents"""
    sql["message_flatten"] = f"""SELECT conv_id, turn, CAST(0 AS BIGINT) AS msg_idx, CAST(NULL AS BIGINT) AS part_idx, role, text
      FROM ({CHATS}) WHERE turn % 2 = 0 UNION ALL
      SELECT conv_id, turn, 0, 0, role, text FROM ({CHATS}) WHERE turn % 2 = 1 UNION ALL
      SELECT conv_id, turn, 0, 2, role, 'second part' FROM ({CHATS}) WHERE turn % 2 = 1"""
    sql["message_reassemble"] = (
        _chat() + """ SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN redacted ELSE
      '[{"type":"text","text":' || CAST(to_json(redacted) AS VARCHAR) || '},{"type":"text","text":"tail"}]' END AS content
      FROM rendered"""
    )
    sql["custom_pattern_classes"] = (
        "WITH " + spans(DOCS, "doc_id", [], {"any": CLASSES.replace(r"[^\S]", r"\s")})
        + ' SELECT doc_id, label, start, "end", value FROM spans'
    )
    for name, size in (("redact_long_texts", 1000), ("redact_joined_notes", 500)):
        sql[name] = f"""SELECT CAST(note_id // {size} AS BIGINT) AS part, true AS found,
          string_agg(text, chr(10) ORDER BY note_id) AS restored FROM ({NOTES}) GROUP BY note_id // {size}"""
    sql["message_write_back"] = _chat() + """ SELECT r.conv_id, r.turn, r.redacted,
      'm|assistant|-|c1|ann|' || c.role || CASE WHEN r.turn % 2 = 1 THEN '|image|not text' ELSE '' END AS rest
      FROM rendered r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn"""
    kept_chats = "conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 10 = 3 AND turn = 1)"
    sql["chat_round_trip"] = f"SELECT conv_id, turn, text AS restored FROM ({CHATS}) WHERE {kept_chats}"
    sql["token_vault_expiry"] = _chat(CHAT_ACTION) + f" SELECT conv_id, turn, redacted AS restored FROM rendered WHERE {kept_chats}"
    sql["token_vault_all"] = _chat(CHAT_ACTION) + f""" SELECT r.conv_id, r.turn,
      CASE WHEN r.conv_id % 5 = 0 THEN r.redacted ELSE c.text END AS restored
      FROM rendered r JOIN ({CHATS}) c ON c.conv_id = r.conv_id AND c.turn = r.turn WHERE r.{kept_chats}"""
    sql["detect_all"] = (
        "WITH " + spans(CORPUS, "src, id") + " SELECT src, type, CAST(count(*) AS BIGINT) AS spans, "
        'CAST(sum(start) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends FROM spans GROUP BY src, type'
    )
    sql["overlap_resolution"] = (
        "WITH RECURSIVE " + spans(NOTES, "note_id") + ",\n " + kept("note_id")
        + ' SELECT note_id, type, start, "end", value FROM kept'
    )
    sql["mask_by_type"] = (
        "WITH " + spans(NOTES, "note_id") + f" SELECT note_id, type, value, {MASK} AS masked FROM spans"
    )
    sql["redact_documents"] = redaction(DOCS, "doc_id") + f"""
      SELECT doc_id, {REDACTED}, coalesce({token_map("doc_id", "n.doc_id = rendered.doc_id")}, '') AS token_map FROM rendered"""
    sql["redact_notes"] = NOTE_REDACTION + f"""
      SELECT note_id, {REDACTED}, coalesce({token_map("note_id", "n.note_id = rendered.note_id")}, '') AS token_map FROM rendered"""
    sql["redact_pages"] = redaction("SELECT page_id, html AS text FROM pages", "page_id") + f" SELECT page_id, {REDACTED} FROM rendered"
    sql["entities_report"] = NOTE_REDACTION + (
        ' SELECT note_id, type, label, action, new AS placeholder, start, "end" FROM pieces'
    )
    sql["numbering_document"] = NOTE_REDACTION + " SELECT note_id, placeholder, value FROM numbered"
    sql["rehydrate_documents"] = "SELECT src, id, text AS restored, true AS same FROM (" + CORPUS + ")"
    sql["block_split"] = NOTE_REDACTION + """
      SELECT note_id, CASE WHEN blocked THEN 'quarantine' ELSE 'passed' END AS output,
      CASE WHEN blocked THEN NULL ELSE redacted END AS redacted FROM rendered"""
    sql["policy_layers"] = redaction(
        NOTES, "note_id, tenant", LAYERED.format(key=KEYED)
    ) + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["policy_by_key"] = redaction(NOTES, "note_id, tenant", KEYED) + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["policy_function"] = redaction(
        NOTES, "note_id", "CASE WHEN type IN ('IPV4', 'IPV6') THEN 'allow' WHEN type = 'DATE' THEN 'mask' ELSE 'redact' END"
    ) + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["custom_rules"] = redaction(NOTES, "note_id", extra=CUSTOM) + f"""
      SELECT note_id, {REDACTED}, coalesce({token_map("note_id", "n.note_id = rendered.note_id")}, '') AS token_map FROM rendered"""
    sql["rules_file"] = sql["custom_rules"]
    sql["policy_many_keys"] = sql["policy_by_key"]
    # Two patterns of one type; the second one's value ends where its match ends.
    assigned = {"known": RE2["API_KEY"][0], "assigned": ASSIGNED}
    sql["detect_api_key_assigned"] = (
        "WITH " + spans(CORPUS, "src, id", [], assigned, groups={"assigned": 1})
        + " SELECT src, id, 'API_KEY' AS type, start, \"end\", value FROM spans"
    )
    sql["custom_pattern"] = (
        "WITH " + spans(NOTES, "note_id", [], {"customer no": CUSTOM["customer no"]})
        + ' SELECT note_id, label, start, "end", value FROM spans'
    )
    sql["custom_terms"] = (
        "WITH " + spans(NOTES, "note_id", [], {"codename": CUSTOM["codename"]})
        + ' SELECT note_id, label, start, "end", value FROM spans'
    )
    sql["term_dictionary_join"] = """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       'Sent the ' || p_name || ', not ' || p_name || 's; by ' || s_name || '.' AS text
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(9 AS BIGINT) AS start,
       CAST(9 + length(p_name) AS BIGINT) AS "end", p_name AS value
      FROM t JOIN part ON p_partkey = l_partkey"""
    sql["model_spans"] = (
        "WITH RECURSIVE " + spans(NOTES, "note_id") + ",\n " + _model_spans()
        + ",\n merged AS (SELECT * FROM spans UNION ALL SELECT note_id, type, label, rank, value, start, \"end\" FROM model),\n "
        + kept("note_id", "merged") + ' SELECT note_id, type, start, "end", value FROM kept'
    )
    model_redaction = "WITH RECURSIVE " + ",\n ".join(
        [
            spans(NOTES, "note_id"),
            _model_spans(),
            'merged AS (SELECT * FROM spans UNION ALL SELECT note_id, type, label, rank, value, start, "end" FROM model)',
            kept("note_id", "merged"),
            acted("note_id", "'redact'"),
            numbered("note_id", "note_id", "start"),
            rendered("note_id", "note_id"),
        ]
    )
    sql["redact_with_model"] = model_redaction + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["redact_model_null_ids"] = sql["redact_with_model"]
    sql["model_plugin"] = model_redaction + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["column_plugin"] = redaction(
        NOTES, "note_id", extra={"account": r"\bAccount\b"}
    ) + f" SELECT note_id, {REDACTED} FROM rendered"
    sql["redact_conversations"] = _chat(CHAT_ACTION) + """
      SELECT conv_id, turn, redacted, n_entities FROM rendered
      WHERE conv_id NOT IN (SELECT conv_id FROM rendered WHERE blocked)"""
    sql["redact_repeated_ids"] = _chat() + f""" SELECT r.conv_id, r.turn, r.redacted, c.text AS restored
      FROM rendered r JOIN ({CHATS}) c ON c.conv_id = r.conv_id AND c.turn = r.turn"""
    sql["numbering_conversation"] = _chat() + " SELECT conv_id, placeholder, value FROM numbered"
    sql["numbering_table"] = _chat(scope="", order="conv_id, turn, start") + " SELECT placeholder, value FROM numbered"
    sql["redact_table_scope"] = (
        _chat(scope="", order="conv_id, turn, start") + f" SELECT conv_id, turn, {REDACTED} FROM rendered"
    )
    sql["rehydrate_table_scope"] = f"SELECT conv_id, turn, text AS restored FROM ({CHATS})"
    sql["reply_rehydration"] = f"""SELECT stream_id, {restored("text")} AS content,
      '{{"to":"' || 'u' || conv_id || '@example.com' || '"}}' AS arguments, '[EMAIL_1]' AS id FROM ({REPLIES})"""
    sql["audit_events"] = NOTE_REDACTION + f"""
      SELECT {TS} AS ts, CAST(r.note_id AS VARCHAR) AS request_id, '/v1/redact' AS route, blocked,
      coalesce((SELECT string_agg(c.type || '=' || c.n, ',' ORDER BY c.type) FROM (SELECT note_id, type, count(*) AS n
        FROM pieces GROUP BY note_id, type) c WHERE c.note_id = r.note_id), '') AS entity_counts,
      CAST(n_entities AS BIGINT) AS total_entities FROM rendered r"""
    sql["audit_file_sink"] = sql["audit_events"]
    sql["audit_conversations"] = _chat(CHAT_ACTION) + f"""
      SELECT {TS} AS ts, CAST(r.conv_id AS VARCHAR) AS request_id, '/v1/chat/completions' AS route,
      bool_or(blocked) AS blocked, coalesce((SELECT string_agg(c.type || '=' || c.n, ',' ORDER BY c.type)
        FROM (SELECT conv_id, type, count(*) AS n FROM pieces GROUP BY conv_id, type) c
        WHERE c.conv_id = r.conv_id), '') AS entity_counts,
      CAST(sum(n_entities) AS BIGINT) AS total_entities FROM rendered r GROUP BY r.conv_id"""
    sql["requests_total"] = f"""SELECT '/v1/redact' AS route, CAST(count(*) AS BIGINT) AS requests_total FROM customer
      UNION ALL SELECT '/v1/chat/completions', count(DISTINCT conv_id) FROM conversations"""
    sql["entities_total"] = NOTE_REDACTION + ENTITY_COUNTS
    sql["blocked_total"] = NOTE_REDACTION + """
      SELECT '/v1/redact' AS route, CAST(count(*) AS BIGINT) AS blocked_total FROM rendered WHERE blocked"""
    sql["rate_limited_total"] = bucket(BUCKET_LIMIT, BUCKET_WINDOW_MS) + """
      SELECT route, CAST(count(*) AS BIGINT) AS rate_limited_total FROM b WHERE NOT allowed GROUP BY route"""
    sql["admission"] = bucket(BUCKET_LIMIT, BUCKET_WINDOW_MS) + """
      SELECT caller, request_id, ts_ms, route, allowed, retry_after_ms, remaining FROM b"""
    sql["admission_stream"] = sql["admission"]
    sql["rate_limit_routes"] = bucket(LIMIT, LIMIT_WINDOW_SEC * 1000, "route <> '/health'") + f"""
      SELECT request_id, allowed, retry_after_ms, CASE WHEN NOT allowed THEN
      greatest(1, CAST(ceil(retry_after_ms / 1000.0) AS BIGINT)) END AS retry_after_sec FROM b
      UNION ALL SELECT request_id, true, 0, NULL FROM ({REQUESTS}) WHERE route = '/health'"""
    nameless = f"SELECT CASE WHEN request_id % 3 > 0 THEN caller ELSE '' END AS caller, request_id, ts_ms, route FROM ({REQUESTS})"
    sql["admission_null_callers"] = (
        BUCKET.format(requests=nameless, limit=BUCKET_LIMIT, window_ms=BUCKET_WINDOW_MS, where="true")
        + " SELECT request_id, allowed, retry_after_ms FROM b"
    )
    # Whole units of 1 / window; the rows as one list each, so that a step is a look-up.
    full = ONE_CALLER_LIMIT * ONE_CALLER_WINDOW_MS
    sql["admission_one_caller"] = f"""WITH RECURSIVE r AS (
        SELECT list(request_id ORDER BY ts_ms, request_id) AS ids, list(ts_ms ORDER BY ts_ms, request_id) AS times FROM ({REQUESTS})),
      b AS (SELECT 1 AS i, ids[1] AS request_id, CAST({full} - {ONE_CALLER_WINDOW_MS} AS BIGINT) AS units, true AS allowed, CAST(0 AS BIGINT) AS wait
        FROM r WHERE len(ids) > 0
        UNION ALL SELECT i, request_id, CASE WHEN u >= {ONE_CALLER_WINDOW_MS} THEN u - {ONE_CALLER_WINDOW_MS} ELSE u END,
          u >= {ONE_CALLER_WINDOW_MS}, CASE WHEN u >= {ONE_CALLER_WINDOW_MS} THEN 0
            ELSE ({ONE_CALLER_WINDOW_MS} - u + {ONE_CALLER_LIMIT} - 1) // {ONE_CALLER_LIMIT} END
        FROM (SELECT i + 1 AS i, ids[i + 1] AS request_id,
            least({full}, units + (times[i + 1] - times[i]) * {ONE_CALLER_LIMIT}) AS u FROM b, r WHERE i < len(ids)))
      SELECT request_id, allowed, wait AS retry_after_ms, CASE WHEN allowed THEN units // {ONE_CALLER_WINDOW_MS} ELSE 0 END AS remaining FROM b"""
    sql["streaming_audit"] = redaction(DOCS, "doc_id") + f"""
      SELECT {TS} AS ts, CAST(r.doc_id AS VARCHAR) AS request_id, '/v1/redact' AS route, blocked,
      coalesce((SELECT string_agg(c.type || '=' || c.n, ',' ORDER BY c.type) FROM (SELECT doc_id, type, count(*) AS n
        FROM pieces GROUP BY doc_id, type) c WHERE c.doc_id = r.doc_id), '') AS entity_counts,
      CAST(n_entities AS BIGINT) AS total_entities FROM rendered r"""
    sql["streaming_window_counts"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start,
      event_type AS route, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY ALL"""
    sql["rate_limit_stream"] = sql["rate_limit_routes"]
    sql["chunk_rehydration"] = "WITH " + CHUNKS + " " + EMITTED
    sql["chunk_stream"] = sql["chunk_rehydration"]
    sql["chunk_frames"] = f"""WITH {CHUNKS}, emitted AS ({EMITTED})
      SELECT stream_id, seq, CAST(CAST(flushed AS INTEGER) AS BIGINT) AS part,
        'data: {{"choices":[{{"index":0,"delta":{{"content":' || CAST(to_json(text) AS VARCHAR) || '}}}}]}}' AS line
      FROM emitted WHERE text <> ''
      UNION ALL SELECT stream_id, (length(text) - 1) // 7 + 1, 2, 'data: [DONE]' FROM replies"""
    sql["chunk_token_rows"] = sql["chunk_rehydration"]
    sql["reply_token_rows"] = sql["reply_rehydration"]
    count = "((length(text) - 1) // 7 + 1)"
    line = "{{\"id\":\"' || stream_id || '\",".replace("{{", "{")
    sql["event_write_back"] = f"""WITH {CHUNKS}
      SELECT stream_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS part, stream_id AS id, CAST(NULL AS VARCHAR) AS content,
        CAST(NULL AS VARCHAR) AS finish, 'data: {line}"model":"m","choices":[{{"index":0,"delta":{{"role":"assistant"}},"finish_reason":null}}]}}' AS line
      FROM replies
      UNION ALL SELECT stream_id, seq + 1, 0, stream_id, text, NULL, NULL FROM ({EMITTED}) WHERE NOT flushed
      UNION ALL SELECT stream_id, {count} + 1, 0, stream_id, '[X', 'stop', NULL FROM replies WHERE turn % 3 <> 0
      UNION ALL SELECT stream_id, {count} + 2, 0, NULL, NULL, NULL, 'data: {{"choices":[],"usage":{{"total_tokens":7}}}}' FROM replies
      UNION ALL SELECT stream_id, {count} + 3, 0, NULL, NULL, NULL, 'data: {{broken' FROM replies
      UNION ALL SELECT stream_id, {count} + 5, -1, NULL, '[X', NULL, NULL FROM replies WHERE turn % 3 = 0
      UNION ALL SELECT stream_id, {count} + 5, 0, NULL, NULL, NULL, 'data: [DONE]' FROM replies"""
    sql["recorded_replies"] = f"""WITH replies AS ({REPLIES}),
      pieces AS (SELECT *, {count} AS n, unnest(range(0, CAST({count} + 6 AS BIGINT))) AS i FROM replies),
      lines AS (SELECT turn, conv_id, i, CASE
        WHEN i = 0 THEN 'data: {line}"model":"m","choices":[{{"index":0,"delta":{{"role":"assistant"}},"finish_reason":null}}]}}'
        WHEN i <= n THEN 'data: {line}"model":"m","choices":[{{"index":0,"delta":{{"content":'
          || CAST(to_json(substring(text, CAST((i - 1) * 7 + 1 AS BIGINT), 7)) AS VARCHAR) || '}}}}]}}'
        WHEN i = n + 1 AND turn % 3 = 0 THEN ': no finish'
        WHEN i = n + 1 THEN 'data: {line}"choices":[{{"index":0,"delta":{{}},"finish_reason":"stop"}}]}}'
        WHEN i = n + 2 THEN 'data: {{"choices":[],"usage":{{"total_tokens":7}}}}'
        WHEN i = n + 3 THEN 'data: {{broken' WHEN i = n + 4 THEN '' ELSE 'data: [DONE]' END AS line FROM pieces)
      SELECT conv_id // 200 AS part, row_number() OVER (PARTITION BY conv_id // 200 ORDER BY conv_id, turn, i) - 1 AS seq, line FROM lines"""
    sql["event_stream"] = sql["event_write_back"]
    sql["byte_chunk_lines"] = """SELECT doc_id, CAST(k - 1 AS BIGINT) AS line_no, line FROM (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line,
        len(string_split(text, chr(10))) AS n FROM documents) WHERE k < n OR line <> ''"""
    sql["byte_chunk_stream"] = sql["byte_chunk_lines"]
    scoped = f"SELECT *, CASE WHEN conv_id % 3 > 0 THEN conv_id ELSE -1 END AS scope FROM ({CHATS})"
    sql["redact_null_scopes"] = (
        redaction(scoped, "conv_id, turn, scope", scope="scope", order="conv_id, turn, start")
        + " SELECT conv_id, turn, redacted, n_entities FROM rendered"
    )
    sql["chunk_lines"] = f"""WITH replies AS ({REPLIES}),
      cut AS (SELECT stream_id, text, unnest(range(0, CAST((length(text) - 1) // 7 + 1 AS BIGINT))) AS seq FROM replies)
      SELECT stream_id, seq, CAST(0 AS BIGINT) AS choice, CAST(NULL AS BIGINT) AS tool_idx,
        substring(text, CAST(seq * 7 + 1 AS BIGINT), 7) AS fragment, false AS finished, false AS done, CAST(NULL AS VARCHAR) AS passthrough FROM cut
      UNION ALL SELECT stream_id, (length(text) - 1) // 7 + 1, NULL, NULL, NULL, NULL, true, NULL FROM replies
      UNION ALL SELECT stream_id, (length(text) - 1) // 7 + 2, NULL, NULL, NULL, NULL, false, '{{broken' FROM replies
      UNION ALL SELECT stream_id, (length(text) - 1) // 7 + 3, 1, 2, '[EMAIL_1]', true, false, NULL FROM replies
      UNION ALL SELECT stream_id, (length(text) - 1) // 7 + 3, 1, NULL, NULL, true, false, NULL FROM replies"""
    sql["vault_round_trip"] = f"SELECT note_id, text AS restored FROM ({NOTES}) WHERE note_id % 5 <> 0"
    sql["vault_rewritten"] = sql["vault_round_trip"]
    sql["vault_misses"] = f"SELECT note_id, 'missing_token_map' AS error FROM ({NOTES}) WHERE note_id % 5 = 0"
    sql["vault_size"] = f"SELECT CAST(count(*) AS BIGINT) AS size FROM customer WHERE c_custkey % 5 <> 0"
    sql["vault_eviction"] = f"""SELECT CAST(event_id AS VARCHAR) AS scope_id FROM events
      ORDER BY date_trunc('minute', ts) DESC, sha256('run' || chr(31) || CAST(event_id AS VARCHAR)) DESC LIMIT 500"""
    sql["vault_swept"] = redaction(NOTES, "note_id") + """ SELECT note_id, CAST(count(*) AS BIGINT) AS n_tokens FROM numbered
      WHERE note_id % 5 <> 0 GROUP BY note_id"""
    sql["vault_lifetimes"] = f"""WITH stored AS (SELECT event_id, ts, lead(ts, 100) OVER (
        ORDER BY ts, sha256('run' || chr(31) || CAST(event_id AS VARCHAR))) AS evicted FROM events)
      SELECT event_id, k, asked < least(ts + to_milliseconds({VAULT_LIFE_MS}), coalesce(evicted, asked + INTERVAL 1 DAY)) AS found
      FROM (SELECT *, ts + to_microseconds(k * {VAULT_LIFE_MS * 480}) AS asked FROM stored, (SELECT unnest(range(4)) AS k))"""
    sql["streaming_conversations"] = _chat() + " SELECT conv_id, turn, redacted, n_entities FROM rendered"
    sql["detect_card_subspan"] = f"""WITH RECURSIVE src AS ({CORPUS}),
      found AS (SELECT src, id, regexp_extract_all(text, {q(GROUPS)}) AS m, string_split_regex(text, {q(GROUPS)}) AS g FROM src
        WHERE regexp_matches(text, '[0-9][ -]?[0-9]')),
      placed AS (SELECT src, id, unnest(m) AS grp, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
      begun AS (SELECT src, id, grp, CAST(sum(length(gap) + length(grp)) OVER (PARTITION BY src, id ORDER BY i) - length(grp) AS BIGINT) AS pos
        FROM placed),
      windows AS (SELECT src, id, pos, grp, unnest(range(0, length(grp))) AS k FROM begun WHERE length(translate(grp, ' -', '')) >= 13),
      cut AS (SELECT src, id, pos + k AS start, substring(grp, CAST(k + 1 AS BIGINT)) AS rest, unnest(range(13, 38)) AS n
        FROM windows WHERE k = 0 OR grp[k] = ' ' OR grp[k] = '-'),
      fitting AS (SELECT src, id, start, start + n AS "end", substring(rest, 1, n) AS value FROM cut
        WHERE n <= length(rest) AND rest[n] >= '0' AND (n = length(rest) OR rest[n + 1] < '0')),
      spans AS (SELECT src, id, 'CREDIT_CARD' AS type, CAST(NULL AS VARCHAR) AS label, 0 AS rank, value, start, "end" FROM fitting WHERE {LUHN}),
      {kept("src, id")}
      SELECT src, id, type, start, "end", value FROM kept"""
    sql["streaming_redaction"] = redaction(DOCS, "doc_id") + f" SELECT doc_id, {REDACTED} FROM rendered"
    sql["streaming_entity_counts"] = redaction(DOCS, "doc_id") + " " + ENTITY_COUNTS
    sql["streaming_request_counts"] = redaction(DOCS, "doc_id", "CASE type WHEN 'IPV4' THEN 'block' ELSE 'redact' END") + """
      SELECT '/v1/redact' AS route, CAST(count(*) AS BIGINT) AS requests_total,
      CAST(sum(CAST(blocked AS INTEGER)) AS BIGINT) AS blocked_total FROM rendered"""
    return sql
