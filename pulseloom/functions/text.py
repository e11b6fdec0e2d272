"""String and time functions: trimming, environments, RFC 3339, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space a trim removes (Spark's own trim
# removes U+0020 only).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# -- environments -----------------------------------------------------------

# Accepted spellings of each environment.
ENVIRONMENT_SPELLINGS = {
    "production": ("prod", "production"),
    "staging": ("staging", "stage"),
    "development": ("dev", "development"),
}


def environment_key(env: Column) -> Column:
    return F.lower(strip(F.coalesce(env, F.lit(""))))


def normalize_environment(env: Column) -> Column:
    """Long environment name; an unknown one stays trimmed and lower-cased."""
    key = environment_key(env)
    named = key
    for name, spellings in ENVIRONMENT_SPELLINGS.items():
        named = F.when(key.isin(*spellings), F.lit(name)).otherwise(named)
    return named


def environment_error(env: Column) -> Column:
    """Error text of an unknown environment, null for a known one."""
    known = [s for spellings in ENVIRONMENT_SPELLINGS.values() for s in spellings]
    key = environment_key(env)
    return F.when(~key.isin(*known), F.concat(F.lit("invalid environment: "), key))


# -- time -------------------------------------------------------------------

RFC3339_SHAPE = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
    r"(Z|[+-]([01][0-9]|2[0-4]):([0-5][0-9]|60))\z"
)


def parse_rfc3339(text: Column) -> Column:
    """Strict RFC 3339 instant, null when malformed or not on the calendar.

    Offsets up to 24:60 and a comma before the fraction are legal, digits past
    the microsecond are cut. Split by position, so only the shape test is a
    regular expression.
    """
    utc = F.endswith(text, F.lit("Z"))
    suffix = F.when(utc, F.lit(1)).otherwise(F.lit(6))
    local = F.translate(F.substring(text, F.lit(1), F.length(text) - suffix), ",", ".")
    offset = F.when(utc, F.lit(0)).otherwise(
        (F.substring(text, -5, 2).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int"))
        * F.when(F.substring(text, -6, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    )
    instant = F.concat(local, F.lit("Z")).try_cast("timestamp")
    shifted = F.timestamp_micros(F.unix_micros(instant) - offset.cast("long") * F.lit(60_000_000))
    return F.when(F.rlike(text, F.lit(RFC3339_SHAPE)), shifted)


ZERO_TIME_US = -62_135_596_800_000_000  # 0001-01-01T00:00:00Z, the "unset" instant


def default_timestamp(ts: Column, as_of: Column) -> Column:
    """``as_of`` for a missing or unset instant."""
    unset = ts.isNull() | (F.unix_micros(ts) == F.lit(ZERO_TIME_US))
    return F.when(unset, as_of).otherwise(ts)


# -- masking of secrets in messages -----------------------------------------

# The three masking patterns, with ASCII word boundaries and
# white space written out because the JVM classes are wider. Case folding
# includes the two non-ASCII letters that fold onto "s" and "k". A cheap test
# comes before each pattern, and each starts with the set of its first letters.
_WORD = "0-9A-Za-z_"
_SPACE = r"\t\n\f\r "
_LONG_S, _KELVIN = "\u017f", "\u212a"


def _fold(words: str) -> str:
    return words.replace("s", f"[s{_LONG_S}]").replace("k", f"[k{_KELVIN}]")


# Names whose assigned values are masked.
SECRET_NAMES = ("api[_-]?key", "access[_-]?token", "refresh[_-]?token", "token", "password", "passwd", "secret")
# A name starts where a word does, so a long s, which is no word character, can be its first letter only after one.
_SECRET_NAMES = f"(?<![{_WORD}])(?:{'|'.join(n[0] + _fold(n[1:]) for n in SECRET_NAMES)})|(?<=[{_WORD}]){_LONG_S}ecret"
CREDENTIAL_RE = (
    f"(?i)(?=[aprst{_LONG_S}])({_SECRET_NAMES})(?![{_WORD}])"
    f"([{_SPACE}]*+[:=][{_SPACE}]*)"
    f"(\"[^\"]*\"|'[^']*'|[^{_SPACE},;]+)"
)
BEARER_RE = f"(?i)(?=b)(?<![{_WORD}])Bearer[{_SPACE}]++[A-Za-z0-9\\-._~+/{_LONG_S}{_KELVIN}]++=*+"
EMAIL_RE = (
    f"(?i)(?=[a-z0-9._%+\\-{_LONG_S}{_KELVIN}])"
    f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
    f"[a-z0-9._%+\\-{_LONG_S}{_KELVIN}]++@[a-z0-9.\\-{_LONG_S}{_KELVIN}]+"
    f"\\.[a-z{_LONG_S}{_KELVIN}]{{2,}}(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
)


def mask_credentials(message: Column) -> Column:
    assigns = F.contains(message, F.lit("=")) | F.contains(message, F.lit(":"))
    return F.when(assigns, F.regexp_replace(message, CREDENTIAL_RE, "$1$2[REDACTED]")).otherwise(message)


def mask_bearer(message: Column) -> Column:
    named = F.contains(F.lower(message), F.lit("bearer"))
    return F.when(named, F.regexp_replace(message, BEARER_RE, "Bearer [REDACTED_TOKEN]")).otherwise(message)


def mask_emails(message: Column) -> Column:
    has_at = F.contains(message, F.lit("@"))
    return F.when(has_at, F.regexp_replace(message, EMAIL_RE, "[REDACTED_EMAIL]")).otherwise(message)


def sanitize_message(message: Column) -> Column:
    """Mask credentials, bearer tokens and e-mail addresses, in this order."""
    return mask_emails(mask_bearer(mask_credentials(message)))
