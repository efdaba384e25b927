"""Encrypted tokens inside text: make, find, insert and reverse them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilspark.functions import crypto
from veilspark.functions.columns import canonical_text
from veilspark.functions.crypto import bind
from veilspark.functions.spans import find_spans

# The token format.
TOKEN_START = "[[ENC|"
TOKEN_PATTERN = r"\[\[ENC\|(v\d+)\|([^|]+)\|([A-Za-z0-9_-]+=*)\]\]"

# Four private-use characters spell a stand-in while other replacements are still to come. They can
# match no ordinary value; texts that hold one are refused.
_OPEN, _ZERO, _ONE, _CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"
_RESERVED = f"[{_OPEN}{_ZERO}{_ONE}{_CLOSE}]"


class TextMaskingError(ValueError):
    """Raised for arguments that cannot be tokenized."""


def is_enc_token(value: Column) -> Column:
    return value.rlike(f"^(?:{TOKEN_PATTERN})\\z")


def find_tokens(text: Column) -> Column:
    return find_spans(text, TOKEN_PATTERN)


def wrap_token(field: Column, version: Column, cipher: Column) -> Column:
    return F.concat(F.lit(TOKEN_START), version, F.lit("|"), field, F.lit("|"), cipher, F.lit("]]"))


def make_token(
    field: str, value: Column, version: str, keys: Column, domain: str, data_type: str = "string"
) -> Column:
    """Token of a value. Null is tokenized as the empty string."""
    if not field or "|" in field:
        raise TextMaskingError("field names must not be empty or contain '|'")
    text = canonical_text(value, data_type)
    cipher = crypto.encrypt(text, F.lit(field), F.lit(version), keys, domain)
    return wrap_token(F.lit(field), F.lit(version), cipher)


def _stand_in(position: Column) -> Column:
    return F.concat(F.lit(_OPEN), F.translate(F.bin(position), "01", _ZERO + _ONE), F.lit(_CLOSE))


def mask_problem(text: Column, replacements: Column) -> Column:
    """Why :func:`mask_text` refuses a row, null if it does not."""
    bad_key = F.exists(
        replacements, lambda p: p["key"].contains("|") | (p["key"] == "") | p["key"].rlike(_RESERVED)
    )
    bad_value = F.exists(replacements, lambda p: p["value"].rlike(_RESERVED))
    return (
        F.when(text.rlike(_RESERVED), "text holds a reserved character")
        .when(bad_key, "a replacement key is empty or holds a reserved character")
        .when(bad_value, "a replacement value holds a reserved character")
    )


def mask_text(text: Column, replacements: Column, version: str, keys: Column, domain: str) -> Column:
    """Replace sensitive values in a text by tokens.

    ``replacements`` is ``array<struct<key, value>>`` and its order counts. For each pair with a
    value: if ``{{key}}`` occurs, only the placeholder is replaced; otherwise every occurrence of the
    value is. Stand-ins are written first and swapped for tokens last, so no later value can match
    inside an earlier token.
    """

    def numbered(pairs: Column) -> Column:
        return F.transform(pairs, lambda p, i: F.struct(
            p["key"].alias("key"), p["value"].alias("value"), _stand_in(i).alias("mark")))

    def place(current: Column, item: Column) -> Column:
        slot = F.concat(F.lit("{{"), item["key"], F.lit("}}"))
        return (
            F.when(item["value"].isNull(), current)
            .when(F.contains(current, slot), F.replace(current, slot, item["mark"]))
            .when(item["value"] != "", F.replace(current, item["value"], item["mark"]))
            .otherwise(current)
        )

    def fill(current: Column, item: Column) -> Column:
        token = wrap_token(
            item["key"],
            F.lit(version),
            crypto.encrypt(item["value"], item["key"], F.lit(version), keys, domain),
        )
        # encrypt only what was placed
        return F.when(
            F.contains(current, item["mark"]), F.replace(current, item["mark"], token)
        ).otherwise(current)

    masked = bind(
        numbered(replacements),
        lambda items: F.aggregate(items, F.aggregate(items, text, place), fill),
    )
    problem = mask_problem(text, replacements)
    return (
        F.when(problem.isNotNull(), F.raise_error(problem))
        .when(replacements.isNull(), text)
        .otherwise(masked)
    )


def open_text(text: Column, keys_by_version: Column, domain: str) -> Column:
    """``struct<plain, problem>`` of a text with tokens, as :func:`open_texts`."""
    return F.get(open_texts(F.array(text), keys_by_version, domain), F.lit(0))


def open_texts(texts: Column, keys_by_version: Column, domain: str) -> Column:
    """``array<struct<plain, problem>>`` of texts with tokens.

    ``problem`` is null on success, else it says that there is no token or names the first field that
    did not decrypt. Each token is opened with the key of the version written in it, and all tokens of one version together.
    """

    def cut(text: Column) -> Column:
        found = F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))
        return F.struct(
            F.split(text, TOKEN_PATTERN, -1).alias("gaps"), F.transform(found, _parts).alias("tokens"), text.alias("text")
        )

    def opened(cuts: Column) -> Column:
        every = F.flatten(F.transform(cuts, lambda c: c["tokens"]))
        return bind(every, lambda tokens: bind(_open_parts(tokens, keys_by_version, domain), lambda plains: rebuilt(cuts, plains)))

    def rebuilt(cuts: Column, plains: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(cuts, 1, i), F.lit(0), lambda n, earlier: n + F.size(earlier["tokens"]))
            size = F.size(c["tokens"])
            none = F.struct(
                F.lit(None).cast("string").alias("plain"),
                F.when(c["text"].isNotNull(), "No ENC tokens found in text").alias("problem"),
            )
            own = F.slice(plains, before + 1, size)
            return F.when(size > 0, bind(own, lambda values: _filled(c["gaps"], c["tokens"], values))).otherwise(none)

        return F.transform(cuts, one)

    return bind(F.transform(texts, cut), opened)


def _parts(token: Column) -> Column:
    """``struct<version, field, raw>``: the pattern has matched, so a plain split does."""
    return bind(F.split(token, r"\|"), lambda p: F.struct(
        p[1].alias("version"),
        p[2].alias("field"),
        crypto.decode(F.left(p[3], F.length(p[3]) - 2)).alias("raw"),
    ))


def _open_parts(tokens: Column, keys_by_version: Column, domain: str) -> Column:
    """Plain values of tokens of any versions."""

    def of_version(some: Column, version: Column) -> Column:
        return bind(F.try_element_at(keys_by_version, version), lambda keys: crypto.decrypt_all(some, keys, domain))

    one = F.size(F.array_distinct(F.transform(tokens, lambda t: t["version"]))) == 1
    return F.when(one, of_version(tokens, F.get(tokens, F.lit(0))["version"])).otherwise(
        F.flatten(F.transform(tokens, lambda t: of_version(F.array(t), t["version"])))
    )


def _filled(gaps: Column, tokens: Column, plains: Column) -> Column:
    """``struct<plain, problem>``: the text with its plain values, or the first field that did not open."""
    failed = F.get(F.filter(tokens, lambda _, i: F.get(plains, i).isNull()), F.lit(0))
    joined = F.concat(
        F.array_join(
            F.zip_with(F.slice(gaps, 1, F.size(plains)), plains, lambda gap, plain: F.concat(gap, plain)), ""
        ),
        F.element_at(gaps, -1),
    )
    return bind(failed, lambda bad: F.struct(
        F.when(bad.isNull(), joined).alias("plain"),
        F.when(bad.isNotNull(), F.concat(F.lit("Failed to decrypt token for field '"), bad["field"], F.lit("'"))).alias("problem"),
    ))
