"""Deterministic authenticated encryption and keyed ids from built-in expressions.

The scheme is the generic synthetic-IV composition (Rogaway and Shrimpton, 2006): a MAC over the
associated data and the plaintext is the IV of a CBC encryption, and decryption recomputes it. Equal
values of one field and version give equal tokens, so masked columns stay joinable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: base64url with optional padding, as in V11.
CIPHERTEXT_SHAPE = r"^[A-Za-z0-9_-]+=*$"
MIN_CIPHERTEXT_LENGTH = 24


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``body`` use it many times."""
    return F.transform(F.array(value), body)[0]


def hmac_sha256(message: Column, keys: Column) -> Column:
    """HMAC-SHA256 of a binary message as binary."""
    inner = F.unhex(F.sha2(F.concat(keys["k_ipad"], message), 256))
    return F.unhex(F.sha2(F.concat(keys["k_opad"], inner), 256))


def associated_data(field: Column, version: Column, domain: str) -> Column:
    """Domain, version and field, preceded by their length so that no two inputs run together."""
    label = F.concat_ws("|", F.lit(domain), version, field)
    return F.concat(F.lpad(F.octet_length(label).cast("string"), 8, "0"), F.lit(":"), label)


def synthetic_iv(plaintext: Column, field: Column, version: Column, keys: Column, domain: str) -> Column:
    message = F.concat(
        associated_data(field, version, domain).cast("binary"), plaintext.cast("binary")
    )
    return F.substring(hmac_sha256(message, keys), 1, 16)


def encrypt(value: Column, field: Column, version: Column, keys: Column, domain: str) -> Column:
    """Encrypt a string column; null stays null.

    The value is bound, as the IV needs it too. A projection with a lambda is also compiled in small methods: the fused code of a few
    ciphers passes the 8,000 bytes up to which the JVM compiles a method, and would be interpreted for each row.
    """
    raw = bind(
        value.cast("binary"),
        lambda plain: F.aes_encrypt(
            plain, keys["k_enc"], F.lit("CBC"), F.lit("PKCS"), synthetic_iv(plain, field, version, keys, domain)
        ),
    )
    return _swapped(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), "+/", "-_")


def _swapped(text: Column, old: str, new: str) -> Column:
    """As ``translate``, which looks up each character of a text."""
    for a, b in zip(old, new, strict=True):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode(cipher: Column) -> Column:
    """Bytes of a base64url text, null if it is not valid."""
    return F.try_to_binary(_swapped(cipher, "-_", "+/"), F.lit("base64"))


def token_bytes(token: Column) -> Column:
    """Bytes of a token, or null if it does not have the shape of one."""
    return decode(F.when(token.rlike(CIPHERTEXT_SHAPE), token))


def _open(raw: Column, keys: Column) -> Column:
    return F.struct(
        F.substring(raw, 1, 16).alias("iv"),
        F.try_aes_decrypt(raw, keys["k_enc"], F.lit("CBC"), F.lit("PKCS")).alias("plain"),
    )


def verified(opened: Column, field: Column, version: Column, keys: Column, domain: str) -> Column:
    """Plaintext if the recomputed IV equals the stored one, else null."""
    iv = synthetic_iv(opened["plain"], field, version, keys, domain)
    return F.when(iv == opened["iv"], opened["plain"].cast("string"))


def decrypt_bytes(raw: Column, field: Column, version: Column, keys: Column, domain: str) -> Column:
    """Decrypt the bytes of a token; null if they do not belong to the field, version and key."""
    return bind(_open(raw, keys), lambda opened: verified(opened, field, version, keys, domain))


def decrypt(token: Column, field: Column, version: Column, keys: Column, domain: str) -> Column:
    """Decrypt a token; null if it was altered or belongs to another field, version or key."""
    return bind(token_bytes(token), lambda raw: decrypt_bytes(raw, field, version, keys, domain))


#: Tokens that are opened as one message.
_TOGETHER = 16


def decrypt_all(tokens: Column, keys: Column, domain: str) -> Column:
    """Plain values of ``array<struct<raw, field, version>>`` under one key; null for a token that does not open.

    Setting up a cipher costs far more than some blocks, so up to ``_TOGETHER`` tokens are opened at once. The result is that of
    :func:`decrypt_bytes` for each token.
    """

    def opened(group: Column) -> Column:
        return F.zip_with(
            group,
            _open_together(F.transform(group, lambda t: t["raw"]), keys),
            lambda t, o: verified(o, t["field"], t["version"], keys, domain),
        )

    def grouped(every: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), F.lit(_TOGETHER))
        return F.flatten(F.transform(starts, lambda at: bind(F.slice(every, at + 1, _TOGETHER), opened)))

    return bind(tokens, grouped)


def _open_together(raws: Column, keys: Column) -> Column:
    """``array<struct<iv, plain>>`` of tokens one after another.

    CBC decrypts a block with the block before it and nothing else. In a chain of tokens the plain text of each stands where its
    blocks are, behind a meaningless block for its IV. The cipher takes the padding off the last one. If the chain does not open, its
    last token is to blame or one that is no whole number of blocks, and each is opened by itself.
    """

    def cut(chain: Column, sizes: Column, total: Column) -> Column:
        def part(raw: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b)
            return bind(
                start,
                lambda at: F.struct(
                    F.substring(raw, 1, 16).alias("iv"),
                    bind(
                        F.substring(chain, at + 1, F.get(sizes, i) - 16),
                        lambda padded: F.when(at + F.get(sizes, i) == total, padded).otherwise(_unpadded(padded)),
                    ).alias("plain"),
                ),
            )

        return F.transform(raws, part)

    def opened(sizes: Column) -> Column:
        whole = F.forall(sizes, lambda n: (n == 0) | (n >= 32) & (n % 16 == 0))
        chain = F.aggregate(raws, F.lit(b""), lambda all_, raw: F.concat(all_, F.coalesce(raw, F.lit(b""))))
        plain = F.try_aes_decrypt(F.when(whole, chain), keys["k_enc"], F.lit("CBC"), F.lit("PKCS"))
        alone = F.transform(raws, lambda raw: _open(raw, keys))
        total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
        return bind(plain, lambda found: F.when(found.isNotNull(), bind(total, lambda n: cut(found, sizes, n))).otherwise(alone))

    return bind(F.transform(raws, lambda raw: F.coalesce(F.length(raw), F.lit(0))), opened)


def _unpadded(padded: Column) -> Column:
    """Bytes without their PKCS padding; null if it is wrong."""

    def without(last: Column) -> Column:
        size = F.ascii(last)
        padding = F.substring(padded, F.length(padded) - size + 1, size)
        right = size.between(1, 16) & (padding == F.repeat(last, size).cast("binary"))
        return F.when(right, F.substring(padded, F.lit(1), F.length(padded) - size))

    return bind(F.substring(padded, -1, 1).cast("string"), without)


def fail_unless(ok: Column, value: Column, message: Column) -> Column:
    """``value`` where ``ok`` holds; elsewhere the job fails with ``message``."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def is_ciphertext(value: Column) -> Column:
    """Shape check only: any unspaced identifier of 24 characters passes too."""
    return (F.length(value) >= MIN_CIPHERTEXT_LENGTH) & value.rlike(CIPHERTEXT_SHAPE)


def tracking_id(record_id: Column, keys: Column, run: str = "", size: int = 8) -> Column:
    """Repeatable id ``MASK-`` plus two hex digits for each of ``size`` bytes; safe under task retries and stream replays.

    With 8 bytes two of 10^9 records share an id with a chance of 3 in a hundred, with 16 bytes practically never.
    """
    message = F.concat(F.lit(f"tracking-id|{run}|"), record_id.cast("string")).cast("binary")
    return F.concat(F.lit("MASK-"), F.hex(F.substring(hmac_sha256(message, keys), 1, size)))


def random_tracking_id() -> Column:
    """Random form. It changes on re-evaluation: write it to the vault before using it."""
    return F.concat(F.lit("MASK-"), F.upper(F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(16))))
