"""Kernel names: signature, category, normalised form, byte-wise truncation. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of compile-time parameters, each cut at its first occurrence, in this order.
CONFIG_PATTERNS = (
    "_GROUP_K_", "_GROUP_N_", "_GROUP_SIZE_", "_BLOCK_SIZE_", "_SPLITK_BLOCK_SIZE_", "_NUM_KSPLIT_",
    "_ACTUAL_KSPLIT_", "_MAX_KSPLIT_", "_GRID_MN_", "_GRID_", "_EVEN_K_", "_cache_modifier_",
)
# Implementation suffixes, each cut at its last occurrence, in this order.
CONFIG_SUFFIXES = ("_1tg_ps", "_1tg", "_ps", "_novs", "_vs")
# Category by the first substring that a name holds, case ignored.
CATEGORIES = (
    ("cijk_", "GEMM/BLAS"), ("triton_", "Triton"), ("attention", "Attention"), ("fmha", "FlashAttention"),
    ("paged_attention", "PagedAttention"), ("elementwise", "Elementwise"), ("reduce", "Reduce"), ("norm", "Normalization"),
    ("softmax", "Softmax"), ("embedding", "Embedding"), ("copy", "Memory"), ("fill", "Memory"), ("reshape", "Memory"),
    ("transpose", "Memory"), ("rocprim", "ROCm Primitives"), ("ck_tile", "Composable Kernel"),
)
OTHER = "Other"


def fnv1a_mod(text: Column, modulus: int = 1000) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as an unsigned number, modulo ``modulus``.

    The state is two 32-bit halves in longs: the prime is 2**40 + 435, so a step is a product
    with 435 and a shift of the low half into the high one, and nothing overflows.
    """
    whole = 0xFFFFFFFF
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    state = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(a: Column, b: Column) -> Column:
        low = a["lo"].bitwiseXOR(b)
        product = low * 435
        high = a["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(whole).alias("hi"), product.bitwiseAND(whole).alias("lo"))

    start = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(start, state, step, lambda a: F.pmod(F.pmod(a["hi"], F.lit(modulus)) * (2**32 % modulus) + a["lo"], F.lit(modulus)))


def signature(name: Column) -> Column:
    """What names of one kernel share: without template arguments, configuration and trailing numbers.

    A chain of regular expressions, each used once, so the plan stays linear in the steps. A
    marker whose first occurrence starts the name is not cut, nor are its later ones.
    """
    s = F.regexp_replace(name, r"(?s)^([^<]+)<.*$", "$1")
    for p in map(re.escape, CONFIG_PATTERNS):
        s = F.regexp_replace(s, rf"(?s)^(?!{p})(.+?){p}.*$", "$1")
    s = F.regexp_replace(s, r"_[0-9]+x[0-9]+\z", "")
    for p in map(re.escape, CONFIG_SUFFIXES):
        s = F.regexp_replace(s, rf"(?s)^(.+){p}.*$", "$1")
    # Single digits go while more than two bytes are left, then underscores.
    s = F.regexp_replace(s, r"(?s)(?<=.)(?:_[0-9])+\z", "")
    s = F.regexp_replace(s, r"_+\z", "")
    # An array of one element holds the result, so the steps are not made twice.
    return F.get(F.transform(F.array(s), lambda x: F.when(F.octet_length(x) < 3, F.concat(F.lit("other_"), fnv1a_mod(name).cast("string"))).otherwise(x)), 0)


def category(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(OTHER)
    for part, kind in reversed(CATEGORIES):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def is_dimension_suffix(text: Column) -> Column:
    return text.rlike(r"\A[0-9]+x[0-9]+\z")


def normalized(name: Column) -> Column:
    """A name that starts with ``triton_`` loses the number at its end."""
    return F.when(F.octet_length(name) > 7, F.regexp_replace(name, r"(?s)\A(triton(?:_.*)?)_[0-9]+\z", "$1")).otherwise(name)


def cut_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes; a character that is cut in two becomes a replacement character."""
    head = F.make_valid_utf8(F.substr(F.encode(text, "UTF-8"), F.lit(1), F.lit(most)).cast("string"))
    return F.when(F.octet_length(text) > most, head).otherwise(text)


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` bytes, the last three of them dots if something is cut."""
    return F.when(F.octet_length(text) > most, F.concat(cut_bytes(text, most - 3), F.lit("..."))).otherwise(text)


def fixed(value: Column, decimals: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.format_string(f"%.{decimals}f", value.cast("double"))


def change_percent(base: Column, new: Column) -> Column:
    """Per cent of change; null unless both durations are above zero."""
    return F.when((base > 0) & (new > 0), (new - base) / base * 100)


def change_class(percent: Column) -> Column:
    return F.when(percent < -5, "improved").when(percent > 5, "regressed").when(percent.isNotNull(), "neutral")
