"""Scalar functions as columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a prompt's status may be.
PROMPT_STATUSES = ("draft", "published", "archived")
#: Fixed value: the DNS namespace of version 5 UUIDs.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def strip(text: Column) -> Column:
    """Without white space, as Unicode has it, and the separators U+001C to U+001F, at both ends; time grows with the text whatever blanks are inside."""
    space = r"[\s\x1c-\x1f]"
    return F.regexp_replace(text, rf"(?U)^{space}++|(?<!{space}){space}++$", "")


def split_literal(text: Column, separator: str) -> Column:
    """Parts between occurrences of a literal, empty ones too."""
    return F.split(text, r"\Q" + separator + r"\E", -1)


def variables(content: Column) -> Column:
    """Names in {{name}}, each once, in the order in which they first appear."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?U)\{\{(\w+)\}\}"), F.lit(1)))


def missing_variables(content: Column, names: Column) -> Column:
    return F.array_except(variables(content), names)


def render(content: Column, entries: Column) -> Column:
    """content with each {{k}} of entries (array of k, v) replaced, one entry after the other: a value may bring in a later entry's name.

    Null if a variable has no entry.
    """
    filled = F.aggregate(entries, content, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["k"], F.lit("}}")), e["v"]))
    return F.when(F.size(missing_variables(content, F.transform(entries, lambda e: e["k"]))) == 0, filled)


def render_error(content: Column, entries: Column) -> Column:
    """The names that `render` lacks, by comma; null if none."""
    gone = missing_variables(content, F.transform(entries, lambda e: e["k"]))
    return F.when(F.size(gone) > 0, F.concat(F.lit("missing variables: "), F.array_join(gone, ", ")))


def with_blanks(content: Column, values: Column) -> Column:
    """Map of every variable of content to its value, blank if unset."""
    names = variables(content)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.element_at(values, n), F.lit(""))))


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def vector_id(doc_id: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("_", doc_id.cast("string"), index.cast("string")))


def known_model(model: Column) -> Column:
    """Whether the vector size of a model is known by its name: that of bge models is."""
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return name.startswith("baai/bge-") | name.startswith("bge-")


def vector_size(model: Column) -> Column:
    """Dimensions by a model's name: 1024 for bge models, an error otherwise."""
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    known = F.when(known_model(model), F.lit(1024))
    return F.coalesce(known, F.raise_error(F.when(name == "", F.lit("model name is empty")).otherwise(F.concat(F.lit("unknown embedding model: "), name))).cast("int"))


def tenant_name(nickname: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(nickname, F.lit("")), F.split_part(email, F.lit("@"), F.lit(1)))


def role_code(kind: str, tenant_id: Column) -> Column:
    return F.concat(F.lit(f"tenant_{kind}_"), tenant_id.cast("string"))


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """The first forwarded address, else the real-IP header, else the peer, else `unknown`."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))), blank(real), blank(peer), F.lit("unknown"))


def without_api(path: Column) -> Column:
    """A path without one leading /api."""
    return F.regexp_replace(path, "^/api", "")


def under_any(path: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: without_api(path).startswith(p))


def clamped_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def null_safe_add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + b


def backoff_seconds(attempt: Column) -> Column:
    """What to wait after a failed attempt (from 0): doubling, 5 seconds at most."""
    return F.least(F.pow(F.lit(2), attempt), F.lit(5)).cast("int")


def expires_at(issued: Column, kind: Column) -> Column:
    """When a token ends: access tokens after 5 minutes, refresh tokens after 7 days; null for other kinds."""
    return F.when(kind == "access", issued + F.expr("interval 5 minutes")).when(kind == "refresh", issued + F.expr("interval 7 days"))


def ttl_seconds(expires: Column, now: Column) -> Column:
    """Whole seconds that remain, one at least."""
    return F.greatest((expires - now).cast("long"), F.lit(1).cast("long"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def message_type(role: Column) -> Column:
    return F.when(role == "system", "system").when(role == "assistant", "ai").otherwise("human")


def masked(ciphertext: Column) -> Column:
    """Whether a secret is set; the secret itself is not shown."""
    return F.coalesce(F.length(ciphertext) > 0, F.lit(False))


def encrypted(text: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce, base 64; without a key it fails."""
    safe = F.coalesce(F.nullif(key, F.lit("")), F.raise_error(F.lit("encryption key is not configured")).cast("string"))
    return F.base64(F.aes_encrypt(text, F.unhex(F.md5(safe)), F.lit("GCM")))


def decrypted(ciphertext: Column, key: Column) -> Column:
    safe = F.coalesce(F.nullif(key, F.lit("")), F.raise_error(F.lit("encryption key is not configured")).cast("string"))
    return F.aes_decrypt(F.unbase64(ciphertext), F.unhex(F.md5(safe)), F.lit("GCM")).cast("string")


def _names(wanted: list[str] | Column) -> Column:
    return wanted if isinstance(wanted, Column) else F.array(*[F.lit(w) for w in wanted]).cast("array<string>")


def has_any(held: Column, wanted: list[str] | Column) -> Column:
    """Whether one of the wanted names is held; of none none is."""
    return F.exists(_names(wanted), lambda w: F.array_contains(held, w))


def has_all(held: Column, wanted: list[str] | Column) -> Column:
    """Whether all wanted names are held; of none all are."""
    return F.forall(_names(wanted), lambda w: F.array_contains(held, w))


def percent(share: Column) -> Column:
    """A share in per cent, one digit after the point."""
    return F.round(share * 100, 1)


def minute(ts: Column) -> Column:
    """A time up to its minute, as the first 16 characters of its text."""
    return F.substring(iso(ts), 1, 16)


def prompt_error(status: Column, name: Column, category: Column) -> Column:
    """Why an update of a prompt is refused: an unknown status, or a name or category that is too long; null if it isn't. What is null isn't updated."""
    return F.when(status.isNotNull() & ~status.isin(*PROMPT_STATUSES), F.concat(F.lit("unknown status: "), status)).when(F.length(name) > 255, "name is too long").when(F.length(category) > 100, "category is too long")


def price(amount: Column) -> Column:
    """$p/1K, or a dash without a price."""
    return F.when(amount.isNull(), F.lit("-")).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", amount.cast("double")), F.lit("/1K")))
