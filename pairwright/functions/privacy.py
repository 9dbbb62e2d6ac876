"""Masking and redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .columns import col
from .text import collapse_whitespace


def mask_email(c: Column | str) -> Column:
    email = col(c)
    at = F.instr(email, "@")
    masked = F.concat(F.left(email, F.least(F.lit(1), at - 1)), F.lit("***"),
                      F.substring(email, at, F.length(email)))
    return F.when(at > 0, masked).otherwise(F.lit("***"))


def redact_pii(c: Column | str, keep_email: bool = False) -> Column:
    text = F.regexp_replace(col(c), lx.PII_URL, "[url]")
    if not keep_email:
        text = F.regexp_replace(text, lx.PII_EMAIL, "[email]")
    return collapse_whitespace(F.regexp_replace(text, lx.PII_PHONE, "[phone]"))


_JSON_VALUE = r'(?:"(?:[^"\\]|\\.)*"|\{[^{}]*\}|\[[^\[\]]*\]|[^",}\]\s]+)'


def sanitize_detail(c: Column | str) -> Column:
    """Audit detail (JSON text) with secrets redacted and e-mail addresses masked, at any depth."""
    secrets = "|".join(lx.SECRET_KEYS)
    emails = "|".join(lx.EMAIL_KEYS)
    text = F.regexp_replace(
        col(c), rf'(?i)("(?:{secrets})"\s*:\s*){_JSON_VALUE}', '$1"[redacted]"'
    )
    text = F.regexp_replace(text, rf'(?i)("(?:{emails})"\s*:\s*")[^"@]*"', '$1***"')
    return F.regexp_replace(text, rf'(?i)("(?:{emails})"\s*:\s*"[^"@]?)[^"@]*(@[^"]*")', "$1***$2")
