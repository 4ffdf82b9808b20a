"""Scalar text functions as column expressions: masks, hashes, scrubbing, value formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def mask_ends(c: C, first: int, last: int) -> Column:
    """The first and last characters kept, stars between; a value no longer than both is all stars."""
    v = col(c)
    n = F.length(v)
    return F.when(n <= first + last, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(v, F.lit(first)), F.repeat(F.lit("*"), n - (first + last)), F.right(v, F.lit(last))))


def mask_email(c: C) -> Column:
    v = col(c)
    return F.when(F.coalesce(v, F.lit("")) == "", "").otherwise("***@***.***")


def mask_phone(c: C) -> Column:
    """Only the last four digits, or *** where there are fewer."""
    d = F.regexp_replace(col(c), r"\D", "")
    return F.when(F.coalesce(col(c), F.lit("")) == "", "").when(F.length(d) < 4, "***").otherwise(F.concat(F.lit("***-***-"), F.right(d, F.lit(4))))


def mask_address(c: C) -> Column:
    """State and postal code of an address struct, or *** without both."""
    a = col(c)
    parts = F.concat_ws(", ", F.nullif(a["state"], F.lit("")), F.nullif(a["zip"], F.lit("")))
    return F.when(a.isNull(), "").when(parts == "", "***").otherwise(parts)


def salted_hash(c: C, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), col(c)), 256)


def encrypted(c: C, key: str) -> Column:
    """AES-GCM, base64; key of 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(col(c), F.lit(key), F.lit("GCM")))


def decrypted(c: C, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(col(c)), F.lit(key), F.lit("GCM")).cast("string")


def mask_outbound(c: C) -> Column:
    """Numbers and mailboxes replaced by bracketed kinds, rule after rule."""
    v = col(c)
    for pattern, kind in V.OUTBOUND_MASKS:
        v = F.regexp_replace(v, pattern, kind.replace("[", "\\[").replace("]", "\\]"))
    return v


def scrub_log(c: C) -> Column:
    v = col(c)
    for pattern in V.LOG_SCRUBS:
        v = F.regexp_replace(v, pattern, "[REDACTED]")
    return F.regexp_replace(v, r"(?i)(raw_value(?:_encrypted)?\s*[=:]\s*)([^,\s]+)", "$1[REDACTED]")


def holds_personal(c: C) -> Column:
    """Whether any scrubbing pattern matches: the gate before a response leaves."""
    hit = F.lit(False)
    for pattern in V.LOG_SCRUBS:
        hit = hit | col(c).rlike(pattern)
    return hit


def luhn(c: C) -> Column:
    """Luhn check of the digits; no digits fail."""
    d = F.regexp_replace(col(c), r"[^0-9]", "")
    return (F.length(d) > 0) & F.call_function("luhn_check", d)


def python_title(c: C) -> Column:
    """Every run of letters capitalised, as in O'Brien and Smith-Jones."""
    runs = F.regexp_extract_all(col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def around(text: C, start: C, end: C, chars: int) -> Column:
    """The text from `chars` before start to `chars` after end (0-based positions)."""
    a = F.greatest(col(start) - chars, F.lit(0))
    return F.substring(col(text), (a + 1).cast("int"), (F.least(col(end) + chars, F.length(col(text))) - a).cast("int"))


def snippet(text: C, start: C, end: C, chars: int = 30) -> Column:
    """Context with the span replaced and the rest scrubbed."""
    a = F.greatest(col(start) - chars, F.lit(0))
    left = F.substring(col(text), (a + 1).cast("int"), (col(start) - a).cast("int"))
    right = F.substring(col(text), (col(end) + 1).cast("int"), F.lit(chars))
    return F.concat(scrub_log(left), F.lit("[REDACTED]"), scrub_log(right))


def formatted(c: C, kind: str) -> Column:
    """A value as export text: null is empty, nested values are JSON, doubles have four places, booleans are True or False."""
    v = col(c)
    if kind.startswith(("array", "struct", "map")):
        out = F.to_json(v)
    elif kind in ("double", "float"):
        out = F.format_string("%.4f", v)
    elif kind == "boolean":
        out = F.initcap(v.cast("string"))
    else:
        out = v.cast("string")
    return F.when(v.isNull(), "").otherwise(out)


def safe_substitute(template: str, values: dict[str, Column]) -> Column:
    """$name and ${name} replaced where known, otherwise left; $$ is a dollar sign."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[2] or m[3]
        parts.append(F.lit("$") if m[1] else F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
