"""Names shared by every operator: entity types, actions, limits and span schemas."""

from __future__ import annotations

# Fixed values.
ENTITY_TYPES = (
    "EMAIL",
    "PHONE",
    "CREDIT_CARD",
    "SSN",
    "IPV4",
    "IPV6",
    "JWT",
    "API_KEY",
    "DATE",
    "ADDRESS",
    "NAME",
    "CUSTOM",
)
ACTIONS = ("redact", "mask", "block", "allow")
MAX_TEXT_CHARS = 1_000_000
MAX_PATTERN_CHARS = 256
MAX_STREAM_HOLD = 64
VAULT_TTL_MS = 15 * 60 * 1000
VAULT_MAX_ENTRIES = 10_000
LIMITER_MAX_KEYS = 100_000
UNLIMITED_ROUTES = ("/health", "/v1/health", "/metrics")

SPAN = "struct<type:string,start:int,end:int,value:string,label:string,rank:int>"
SPANS = f"array<{SPAN}>"
ENTITY = "struct<type:string,label:string,placeholder:string,action:string,start:int,end:int>"
ENTITIES = f"array<{ENTITY}>"
TOKEN_MAP = "map<string,string>"
