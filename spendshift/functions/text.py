"""Untrusted text, document fingerprints, identifiers and spreadsheet cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LENGTH = 400
MIN_FINGERPRINT_LENGTH = 200
FLAG_PREFIX = "[flagged untrusted text] "

# Shapes of text that tries to instruct a reader (case-insensitive).
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)",
    r"disregard\s+(all\s+)?(previous|prior|the)",
    r"you\s+are\s+now\b",
    r"\bact\s+as\b",
    r"system\s*prompt",
    r"\b(system|assistant|developer)\s*:",
    r"</?\s*(script|iframe|img)\b",
    r"```",
    r"\btool_call\b",
    r"\bexecute\s+(the\s+)?following\b",
    r"\b(delete|terminate|shutdown)\s+(all|every)\b",
]

# Field names that mark a file as carrying a credential.
CREDENTIAL_MARKERS = [
    "aws_secret_access_key",
    "aws_session_token",
    "secret_access_key",
    "client_secret",
    "private_key",
    "private_key_id",
    "refresh_token",
    "password",
    "sas_token",
    "connection_string",
]

_UNICODE = "(?U)"
_UNICODE_NOCASE = "(?iU)"
_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
_SPACE = _UNICODE + r"[\s\x1c-\x1f]+"
_FORMULA_START = r"^[=+\-@\t\r]"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; pure ASCII text skips the Python hop's payload."""
    beyond_ascii = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_nfkc(beyond_ascii), text)


def injection_hits(text: Column) -> Column:
    """Indexes (from 0) of the patterns found in the text."""
    checks = [
        F.when(text.rlike(_UNICODE_NOCASE + pattern), F.lit(index))
        for index, pattern in enumerate(INJECTION_PATTERNS)
    ]
    return F.array_compact(F.array(*checks))


def looks_like_injection(text: Column) -> Column:
    combined = "|".join(f"(?:{pattern})" for pattern in INJECTION_PATTERNS)
    return F.coalesce(text.rlike(_UNICODE_NOCASE + combined), F.lit(False))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def _flag_and_cut(clean: Column, flagged: Column, max_length: int) -> Column:
    marked = F.when(flagged, F.concat(F.lit(FLAG_PREFIX), clean)).otherwise(clean)
    cut = F.concat(F.rtrim(F.substring(marked, 1, max_length - 3)), F.lit("..."))
    return F.when(F.length(marked) > max_length, cut).otherwise(marked)


def scrub(text: Column, max_length: int = MAX_LENGTH, normalise: bool = True) -> tuple[Column, Column]:
    """(safe text, suspicious flag) for one piece of provider-controlled text."""
    filled = F.coalesce(text, F.lit(""))
    normal = nfkc(filled) if normalise else filled
    clean = collapse_space(F.regexp_replace(normal, _CONTROL, " "))
    flagged = looks_like_injection(clean)
    return _flag_and_cut(clean, flagged, max_length), flagged


def scrub_tags(tags: Column, limit: int = 6) -> tuple[Column, Column]:
    """(``k=v`` list of the first tags by key, flag over all tags)."""
    every = F.array_sort(F.map_entries(tags))
    entries = F.slice(every, 1, limit)

    def safe(entry: Column) -> Column:
        key, _ = scrub(entry["key"], 40, normalise=False)
        value, _ = scrub(entry["value"], 60, normalise=False)
        return F.concat(key, F.lit("="), value)

    def suspicious(entry: Column) -> Column:
        return scrub(entry["key"], 40, normalise=False)[1] | scrub(entry["value"], 60, normalise=False)[1]

    none = F.coalesce(F.size(tags) <= 0, F.lit(True))
    text = F.when(none, F.lit("no tags")).otherwise(F.array_join(F.transform(entries, safe), ", "))
    return text, F.when(none, F.lit(False)).otherwise(F.exists(every, suspicious))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(
        lambda items: None if items is None else list(pd.Series(items, dtype=object).str.normalize("NFKC"))
    )


def normalised_tags(tags: Column) -> Column:
    """Tag map with its keys and values in compatibility normal form."""
    return F.map_from_arrays(_nfkc_each(F.map_keys(tags)), _nfkc_each(F.map_values(tags)))


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles, tags and repeated white space."""
    no_blocks = F.regexp_replace(
        html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "
    )
    return collapse_space(F.regexp_replace(no_blocks, r"<[^>]+>", " "))


def fingerprint(html: Column) -> Column:
    """SHA-256 of the visible text; null when too short to compare."""
    text = visible_text(html)
    return F.when(F.length(text) >= MIN_FINGERPRINT_LENGTH, F.sha2(text, 256))


def credential_markers(text: Column) -> Column:
    """Credential-shaped field names found anywhere in the text."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(m)), F.lit(m)) for m in CREDENTIAL_MARKERS])
    )


def pseudonym(value: Column, salt: str = "") -> Column:
    """Stable stand-in for an account id; an empty value stays empty."""
    hashed = F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), value), 256), 1, 12)
    return F.when(value == "", value).otherwise(F.concat(F.lit("acct-"), hashed))


def spreadsheet_cell(text: Column) -> Column:
    """One line, pipes escaped, never starting like a formula."""
    flat = F.replace(text, F.lit("|"), F.lit("\\|"))
    flat = F.regexp_replace(F.regexp_replace(flat, r"[\r\n]", " "), _UNICODE + r"^\s+|\s+$", "")
    return F.when(flat.rlike(_FORMULA_START), F.concat(F.lit("'"), flat)).otherwise(flat)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``{name}`` placeholder with its column."""
    filled = template
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return filled
