"""Tokenized prompts and explanations: build, render and reverse them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.config import EngineConfig
from veilspark.functions import columns as C, tokens
from veilspark.keyring import KeyRing
from veilspark.operators.scoring import contact
from veilspark.sources import schemas

# Texts whose wording results depend on. Braces name token fields.
PROMPT_TEXT = (
    "Provide RM explanation for customer {customer_name} regarding amount {amount} at "
    "{merchant_name} on {transaction_ts}. Fraud score {fraud_probability}. "
    "Reasons: {reasons}. Contact: {customer_phone}, {customer_email}."
)
EXPLANATION_TEXT = (
    "Transaction by {customer_name} for {amount} at {merchant_name} on {transaction_ts} "
    "received fraud score {fraud_probability}. Reasons: {reasons}. "
    "Customer contact: {customer_phone}, {customer_email}."
)
ACTION_TEXTS = (
    "Call {customer_name} at {customer_phone} to confirm the transaction.",
    "If unreachable, send email to {customer_email} and place a temporary hold.",
)
DISCLAIMER = "Masked explanation generated for RM review only."
FALLBACK_EXPLANATION = "Unable to unmask explanation. Please use masked output."
FALLBACK_ACTION = "Unable to unmask recommended actions. Please use masked output."
FALLBACK_DISCLAIMER = "Masked output should be reviewed internally."
UNMASK_WARNING = "LLM output unmasking failed: "
SCAN_TEXT = (
    "Customer {full_name} initiated transaction {transaction_id}. "
    "Contact phone: {phone}. Email: {email}. "
    "Billing address: {address}. "
    "Card PAN: {card_pan}. "
    "Customer ID: {customer_id}. "
    "Merchant: {merchant_name}. "
    "Amount: {amount} {currency}."
)


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a template with columns; a null leaves its slot empty."""
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(text), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def scan_text(df: DataFrame) -> Column:
    """One sentence per transaction with its personal data, as input of the discovery scan."""
    own = ("transaction_id", "card_pan", "customer_id", "merchant_name", "currency")
    values = {name: F.col(name) for name in own}
    values |= contact(df)
    values["amount"] = C.fixed_decimals(F.col("amount"), 2)
    return render(SCAN_TEXT, values)


def token_context(df: DataFrame, keys: Column, config: EngineConfig) -> Column:
    """Struct of seven tokens; amounts show two decimals and scores a whole percentage."""
    person = contact(df)
    values = {
        "customer_name": person["full_name"],
        "customer_phone": person["phone"],
        "customer_email": person["email"],
        "amount": C.fixed_decimals(F.col("amount"), 2),
        "merchant_name": F.col("merchant_name"),
        "transaction_ts": F.col("transaction_ts"),
        "fraud_probability": C.percent(F.col("fraud_probability")),
    }
    return F.struct(
        *[
            tokens.make_token(name, value, config.mask_version, keys, config.domain).alias(f"{name}_token")
            for name, value in values.items()
        ]
    )


def with_prompt(df: DataFrame, keyring: KeyRing, config: EngineConfig) -> DataFrame:
    """Add ``prompt``, a struct of version, token context and reason codes with its data classes."""
    keyed = df.withColumn("_keys", keyring.keys(config.mask_version))
    prompt = F.struct(
        F.lit(config.mask_version).alias("prompt_version"),
        token_context(keyed, F.col("_keys"), config).alias("context"),
        F.col("reason_codes"),
    )
    # what reads the struct names each token several times; it is encrypted once
    return keyed.withColumn("prompt", C.settled(prompt.cast(schemas.PROMPT))).drop("_keys")


def _slots(prompt: str) -> dict[str, Column]:
    slots = {n: F.col(f"{prompt}.context.{n}_token") for n in schemas.TOKEN_CLASSES}
    return slots | {"reasons": F.array_join(f"{prompt}.reason_codes", ", ")}


def masked_request(prompt: str = "prompt") -> Column:
    """Struct of the rendered prompt, its token list and the reason codes."""
    listed = [
        F.struct(F.lit(n).alias("field"), F.col(f"{prompt}.context.{n}_token").alias("token"))
        for n in schemas.TOKEN_CLASSES
    ]
    return F.struct(
        render(PROMPT_TEXT, _slots(prompt)).alias("prompt"),
        F.array(*listed).alias("tokens"),
        F.col(f"{prompt}.reason_codes").alias("reason_codes"),
    ).cast(schemas.MASKED_REQUEST)


def masked_explanation(prompt: str = "prompt") -> Column:
    """Explanation, two actions and a disclaimer with tokens copied in."""
    slots = _slots(prompt)
    return F.struct(
        render(EXPLANATION_TEXT, slots).alias("rm_explanation_masked"),
        F.array(*[render(t, slots) for t in ACTION_TEXTS]).alias("recommended_actions_masked"),
        F.lit(DISCLAIMER).alias("disclaimer_masked"),
    )


def mask_texts(
    df: DataFrame, keyring: KeyRing, config: EngineConfig, text_col: str = "text",
    replacements_col: str = "replacements", on_error: str = "fail",
) -> DataFrame:
    """Add ``masked_text`` and ``mask_version`` to ``(text, replacements)`` rows.

    A text or replacement that holds a reserved character, or an empty key, fails the job; with ``on_error="null"`` such a row alone
    gives null and ``problem`` says why.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    keyed = df.withColumn("_keys", keyring.keys(config.mask_version))
    masked = tokens.mask_text(
        F.col(text_col), F.col(replacements_col), config.mask_version, F.col("_keys"), config.domain
    )
    if on_error == "null":
        keyed = keyed.withColumn("problem", tokens.mask_problem(F.col(text_col), F.col(replacements_col)))
        masked = F.when(F.col("problem").isNull(), masked)
    return keyed.withColumn("masked_text", masked).withColumn(
        "mask_version", F.lit(config.mask_version)
    ).drop("_keys")


def unmask_texts(
    df: DataFrame, keyring: KeyRing, config: EngineConfig, text_col: str = "masked_text",
    on_error: str = "fail",
) -> DataFrame:
    """Add ``text`` with every token replaced by its plain value.

    A text without a token, or with one that does not open, fails the job; with ``on_error="null"``
    it gives null and ``problem`` says why.
    """
    config.require_unmask_text()
    keyed = df.withColumn("_keys", keyring.keys_by_version())
    opened = keyed.withColumn("_opened", tokens.open_text(F.col(text_col), F.col("_keys"), config.domain))
    problem = F.col("_opened.problem")
    if on_error == "null":
        return opened.withColumn("text", F.col("_opened.plain")).withColumn("problem", problem).drop(
            "_opened", "_keys"
        )
    if on_error != "fail":
        raise ValueError("on_error must be 'fail' or 'null'")
    plain = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("_opened.plain"))
    return opened.withColumn("text", plain).drop("_opened", "_keys")


def unmask_explanation(
    df: DataFrame, keyring: KeyRing, config: EngineConfig, masked: str = "masked_result",
    fallback: bool = True,
) -> DataFrame:
    """Add ``unmasked_result`` and ``unmask_warning``.

    Text and actions are opened, the disclaimer is kept. If any token fails, the row gets the fixed
    fallback texts and a warning, or a null result without ``fallback``.
    """
    config.require_unmask_text()
    keyed = df.withColumn("_keys", keyring.keys_by_version())
    actions = F.col(f"{masked}.recommended_actions_masked")
    texts = F.concat(
        F.array(f"{masked}.rm_explanation_masked"), F.coalesce(actions, F.array().cast("array<string>"))
    )
    opened = keyed.withColumn("_opened", tokens.open_texts(texts, F.col("_keys"), config.domain))
    failed = F.filter("_opened", lambda o: o["problem"].isNotNull())
    problem = F.get(failed, F.lit(0))["problem"]
    plain = F.struct(
        F.get("_opened", F.lit(0))["plain"].alias("rm_explanation"),
        F.when(
            actions.isNotNull(), F.transform(F.slice("_opened", 2, F.size(actions)), lambda o: o["plain"])
        ).alias("recommended_actions"),
        F.col(f"{masked}.disclaimer_masked").alias("disclaimer"),
    )
    instead = F.struct(
        F.lit(FALLBACK_EXPLANATION).alias("rm_explanation"),
        F.array(F.lit(FALLBACK_ACTION)).alias("recommended_actions"),
        F.lit(FALLBACK_DISCLAIMER).alias("disclaimer"),
    )
    ok = problem.isNull()
    result = F.when(ok, plain).otherwise(instead) if fallback else F.when(ok, plain)
    return (
        opened.withColumn("unmasked_result", result)
        .withColumn("unmask_warning", F.when(~ok, F.concat(F.lit(UNMASK_WARNING), problem)))
        .drop("_opened", "_keys")
    )
