"""Text rules as Column expressions: each is stated once and serves batch, streams and evaluation alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a compact identifier drops.
COMPACT_DROPS = r"""(?U)[\s.\-_/\\,:;(){}\[\]@"'`]"""
BODY_CHARS, HIT_CHARS, SNIPPET_CHARS, ERROR_CHARS = 700, 400, 512, 500
CHARS_PER_TOKEN = 4
UNIT_SEPARATOR = "\u001f"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c) -> Column:
    """Composed characters (Unicode NFC). Only texts with a character from U+0300 on, where it matters, are looked at."""
    said = col(c)
    return F.when(said.rlike(r"[^\x00-\x{2FF}]"), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(said, F.lit("")), F.lit(False))).otherwise(said)


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), COMPACT_DROPS, "")


def compact(c) -> Column:
    """Identifier, composed, without case, blanks and punctuation."""
    return _compact(nfc(c))


def compact_contains(c, key: str) -> Column:
    """Whether the compact form contains a compact key; the form itself isn't made."""
    flag, drops = COMPACT_DROPS[:4], COMPACT_DROPS[4:]
    loose = flag + f"{drops}*+".join(rf"\x{{{ord(x):x}}}" for x in key)
    return F.lower(nfc(c)).rlike(loose)


def preserve(c) -> Column:
    """Identifier, composed, in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(nfc(c)), r"\s+", " "))


def alias_forms(c) -> Column:
    """The distinct non-empty forms of an identifier: compact, then preserved."""
    return F.array_distinct(F.filter(F.array(compact(c), preserve(c)), lambda x: F.length(x) > 0))


def tokens(c, unicode: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9; of any letters and digits if unicode."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+" if unicode else "[a-z0-9]+"), F.lit(0))


def identifiers(c, most: int = 256) -> Column:
    """Distinct compact identifiers: runs of word characters with a letter, 3 to 100 long."""
    runs = F.regexp_extract_all(col(c), F.lit("[A-Za-z0-9_.=-]+"), F.lit(0))
    named = F.filter(runs, lambda x: F.length(x).between(3, 100) & x.rlike("[A-Za-z]"))
    return F.slice(F.array_distinct(F.filter(F.transform(named, _compact), lambda x: F.length(x) > 0)), 1, most)


def query_form(c) -> Column:
    """Composed, with single blanks."""
    return F.trim(F.regexp_replace(nfc(c), r"\s+", " "))


def hash_form(c) -> Column:
    """The text that is hashed: composed, line ends unified, blanks at line ends and around the text gone."""
    lines = F.regexp_replace(F.regexp_replace(nfc(c), "\r\n?", "\n"), r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(lines, r"^\s+|\s+\z", "")


def text_hash(c) -> Column:
    return F.sha2(hash_form(c), 256)


def contract_id(*fields) -> Column:
    """63 bits of the SHA-256 of the fields joined by the unit separator."""
    first = F.substring(F.sha2(F.concat_ws(UNIT_SEPARATOR, *map(col, fields)), 256), 1, 16)
    return (F.conv(first, 16, 10).cast("decimal(20,0)") % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def token_estimate(c) -> Column:
    return F.floor(F.length(col(c)) / CHARS_PER_TOKEN)


def clip(c, most: int = HIT_CHARS) -> Column:
    """Single blanks, and an ellipsis in place of what is over `most` characters."""
    one = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…")))


def snippet(c, most: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.coalesce(col(c), F.lit("")), 1, most)


def truncate_body(c, most: int = BODY_CHARS) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("…"))).otherwise(col(c))


def redact_error(c, most: int = ERROR_CHARS) -> Column:
    """An error message without keys, bearer tokens and URLs with passwords, cut to `most` characters."""
    out = col(c)
    for shape, put in ((r"(?i)bearer\s+\S+", "bearer [redacted]"), (r"(?i)(api[_-]?key|token|password|secret)(\s*[=:]\s*)\S+", "$1$2[redacted]"), (r"://[^\s/@:]+:[^\s/@]+@", "://[redacted]@"), (r"sk-[A-Za-z0-9_-]{8,}", "[redacted]")):
        out = F.regexp_replace(out, shape, put)
    return F.substring(out, 1, most)


def canonical_text(*parts) -> Column:
    """The non-empty parts, trimmed, with an empty line between."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts])


def entity_type(kind) -> Column:
    """message and distillation are themselves, any other kind is a resource, a blank one is null."""
    k = F.trim(F.lower(col(kind)))
    return F.when(k.isNull() | (k == ""), None).when(k.isin("message", "distillation"), k).otherwise("resource")


def is_snowflake(c) -> Column:
    """Digits alone and beyond 2^53, where doubles lose them."""
    return col(c).rlike("^[0-9]{1,20}$") & (col(c).cast("decimal(20,0)") > F.lit(1 << 53).cast("decimal(20,0)"))


def cites(c) -> Column:
    """`kind:id,...` as an array of (kind, id); malformed parts are dropped."""
    parts = F.transform(F.split(col(c), ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike("^(message|resource|distillation):[^:]+$"))
    return F.array_distinct(F.transform(good, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(p, F.lit(":"), F.lit(2)).alias("id"))))


def ordered_distinct(c) -> Column:
    """An array without repeats, case and outer blanks aside: the first of each stays, in its place; blank ones go."""
    said = F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    folded = F.transform(said, lambda x: F.lower(x))
    return F.filter(said, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def is_message_id(c) -> Column:
    """Whether a message may be asked for anew by this id: digits alone."""
    return F.coalesce(col(c).rlike("^[0-9]+$"), F.lit(False))


def provenance_weight(c) -> Column:
    """Priority of an alias by where it came from."""
    weights = {"curated": 100, "official": 80, "registry": 70, "workflow": 60, "community": 40}
    out = F.lit(0)
    for k, w in weights.items():
        out = F.when(col(c) == k, w).otherwise(out)
    return out


def entropy(c) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    kinds = F.array_distinct(chars)
    n = F.size(chars)
    share = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda x: x == k)) / n)
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


#: Shapes of credentials, by reason.
SECRET_SHAPES = {
    "private_key_block": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED |)PRIVATE KEY-----",
    "provider_token_prefix": r"sk-(?:proj-)?[A-Za-z0-9_-]{30,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bAIza[0-9A-Za-z_-]{35}\b|\b[rs]k_(?:live|test)_[0-9A-Za-z]{24,}\b|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "credential_assignment": r"(?i)(?<![A-Za-z0-9_])(?:api[_-]?key|apikey|secret|password|passwd|token|access[_-]?token|refresh[_-]?token|private[_-]?key|client[_-]?secret|authorization)\s*[:=]\s*['\"][^'\"\s]{16,}['\"]",
    "credential_url": r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/@:]+:[^\s/@:]{6,}@[^\s/@]+",
    "aws_env_var": r"AWS_(?:ACCESS_KEY_ID|SECRET_ACCESS_KEY)\s*=\s*['\"]?[A-Za-z0-9/+=]{16,}",
}


def secret_reasons(c) -> Column:
    """Reasons for which a text must not be shown, in order of their names; never the secret itself."""
    found = [F.when(col(c).rlike(shape), F.lit(reason)) for reason, shape in sorted(SECRET_SHAPES.items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def public_state(c) -> Column:
    return F.when(col(c).isNull() | ~col(c).rlike(r"\S"), "unavailable").when(F.size(secret_reasons(c)) > 0, "quarantined").otherwise("safe")


def redact(c) -> Column:
    """A text with its secrets blanked out."""
    out = col(c)
    for shape in SECRET_SHAPES.values():
        out = F.regexp_replace(out, shape, "[redacted]")
    return out
