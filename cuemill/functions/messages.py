"""Messages of models: JSON replies, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all

# USD for a million tokens in and out, by part of the model's name; the first hit counts.
PRICES = (("gpt-5.4-nano", 0.20, 1.25), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("gpt-5-nano", 0.05, 0.40))
DEFAULT_PRICE = (0.05, 0.40)


def approximate_tokens(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4).cast("bigint")


def lenient_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.floor(c.try_cast("double")).try_cast("int"))


def usage(body: Column) -> Column:
    """Input and output tokens of a reply, or null without usage."""
    at = lambda k: lenient_int(F.get_json_object(body, f"$.usage.{k}"))
    got = F.struct(F.coalesce(at("prompt_tokens"), at("input_tokens"), F.lit(0)).cast("bigint").alias("input"), F.coalesce(at("completion_tokens"), at("output_tokens"), F.lit(0)).cast("bigint").alias("output"))
    return F.when(F.get_json_object(body, "$.usage").isNotNull(), got)


def message_text(body: Column) -> Column:
    """Text of the first choice: a string, or the text (else content) of its parts; null if blank."""
    raw = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(raw, "array<struct<text:string,content:string>>")
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], x["content"], F.lit(""))), "")
    out = F.when(raw.startswith("["), F.coalesce(joined, raw)).otherwise(raw)
    return F.when(trim_all(out) != "", out)


def error_detail(body: Column) -> Column:
    at = lambda k: F.get_json_object(body, k)
    return F.coalesce(at("$.error.message"), at("$.error.detail"), at("$.message"), at("$.detail"), body)


def price(model: Column, which: int) -> Column:
    out = F.lit(DEFAULT_PRICE[which])
    for name, *usd in reversed(PRICES):
        out = F.when(F.lower(model).contains(name), usd[which]).otherwise(out)
    return out


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / F.lit(1_000_000.0) * price(model, 0) + tokens_out / F.lit(1_000_000.0) * price(model, 1)


def request_body(model: Column, messages: Column, temperature: Column, effort: Column) -> Column:
    """Request as JSON; null fields are left out."""
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"), effort.alias("reasoning_effort")))


def usage_totals(use: Column) -> list[Column]:
    """Aggregates of usage structs: tokens in and out, replies, and replies that told their usage."""
    total = lambda k: F.coalesce(F.sum(use[k]), F.lit(0)).cast("bigint")
    return [total("input").alias("input"), total("output").alias("output"), F.count("*").alias("replies"), F.count(use).alias("metered")]


def cost_summary(model: Column, tokens_in: Column, tokens_out: Column, metered: Column, replies: Column) -> Column:
    """One line on what the replies cost, or that it cannot be told."""
    told = F.format_string("%s: $%.4f (%d of %d replies metered, %d tokens in, %d out)", model, cost_usd(model, tokens_in, tokens_out), metered, replies, tokens_in, tokens_out)
    return F.when(metered > 0, told).otherwise("cost unknown: no reply told its usage")


def estimate(requests: Column, invocations: Column, metered: bool) -> Column:
    """Struct of usd and note before anything is sent: nothing costs nothing, nor do models on the device; others are unknown."""
    note = F.format_string("%d requests, billed by their replies", requests) if metered else F.format_string("%d requests, about %d calls on the device", requests, invocations)
    usd = F.when(requests == 0, F.lit(0.0)).otherwise(F.lit(None).cast("double") if metered else F.lit(0.0))
    return F.struct(usd.alias("usd"), F.when(requests == 0, "nothing to translate").otherwise(note).alias("note"))


# How models are asked, by the beginning of their names.
def temperature(model: Column) -> Column:
    return F.when(~F.lower(model).startswith("gpt-5"), F.lit(0.3))


def reasoning_effort(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.startswith("gpt-5.4"), "none").when(low.startswith("gpt-5"), "low")


def auth_header(mode: Column) -> Column:
    """Header that carries the key by the name of a mode; null for an unknown one."""
    low = F.lower(trim_all(F.coalesce(mode, F.lit(""))))
    return F.when(low.isin("", "bearer"), "Authorization").when(low.isin("x-api-key", "x_api_key", "api-key"), "x-api-key")
