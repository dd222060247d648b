"""Model families, token prices and context windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars for a million input tokens, by family, in the order in which families are looked for.
INPUT_PRICE = {"fable": 10.0, "opus": 5.0, "sonnet": 3.0, "haiku": 1.0}
#: What other tokens cost, in input tokens.
OUTPUT_WEIGHT, READ_WEIGHT, WRITE_WEIGHT = 5.0, 0.1, 1.25
#: Context windows in tokens, by a part of the model's name.
CONTEXT_WINDOW = {"opus-4-6": 1_000_000, "opus-4-7": 1_000_000, "opus-4-8": 1_000_000, "sonnet-4-6": 1_000_000, "opus-4-5": 200_000, "sonnet-4-5": 200_000, "haiku-4-5": 200_000, "qwen2.5-coder": 32_768, "devstral-small-2": 256_000}


def _first_match(model: Column, values: dict, otherwise: Column) -> Column:
    low, out = F.lower(model), otherwise
    for part, value in reversed(values.items()):
        out = F.when(F.contains(low, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def model_family(model: Column) -> Column:
    """The first known family named in a model id, else ``unknown``."""
    return _first_match(model, {f: f for f in INPUT_PRICE}, F.lit("unknown"))


def token_rate(model: Column) -> Column:
    """Dollars for a million input tokens; 0 for unknown models."""
    return _first_match(model, INPUT_PRICE, F.lit(0.0))


def billable_tokens(model: Column, inputs: Column, outputs: Column, reads: Column, writes: Column) -> Column:
    """All tokens in units of input tokens, unrounded; 0 for unknown models."""
    weighed = inputs + outputs * OUTPUT_WEIGHT + reads * READ_WEIGHT + writes * WRITE_WEIGHT
    return F.when(token_rate(model) > 0, weighed).otherwise(F.lit(0.0))


def cost_usd(model: Column, inputs: Column, outputs: Column, reads: Column, writes: Column) -> Column:
    """Dollars, to 8 places, from the unrounded billable tokens."""
    return F.round(billable_tokens(model, inputs, outputs, reads, writes) * token_rate(model) / 1_000_000, 8)


def context_window(model: Column) -> Column:
    """Tokens of the model's window, the longest matching name first; null if unknown."""
    by_length = dict(sorted(CONTEXT_WINDOW.items(), key=lambda kv: -len(kv[0])))
    return _first_match(model, by_length, F.lit(None).cast("int"))


def context_ratio(tokens: Column, window: Column) -> Column:
    """Share of the window that is filled; null without a window."""
    return F.try_divide(tokens, F.nullif(window, F.lit(0)))
