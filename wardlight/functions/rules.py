"""Sensitivity rules on text and file metadata, as JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from wardlight import fixed
from wardlight.functions.text import as_column


def tier_pattern(patterns) -> str:
    r"""Join the patterns of one tier into a single Java regular expression.

    When every alternative is a whole word (`\b...\b`, starting with a plain letter)
    the word boundaries are taken out of the alternation and guarded by a lookahead
    for the first letters: most positions are then rejected by plain character tests,
    before the costlier test for a Unicode word boundary.
    `(?U)` gives Unicode word characters, `(?d)` lets `.` exclude only `\n`.
    """
    parts = [alt for p in patterns for alt in p.split("|")]
    whole = [re.fullmatch(r"\\b([a-z].*)\\b", alt) for alt in parts]
    if all(whole) and not any(ch in p for p in patterns for ch in "()["):
        words = [m.group(1) for m in whole]
        # A letter that may be absent ends the head before it.
        heads = [re.match("(?:[a-z](?![?*{])){0,3}", w).group() for w in words]
        classes = "".join(f"[{''.join(sorted({h[i] for h in heads}))}]" for i in range(min(map(len, heads))))
        return rf"(?Ud)(?={classes})\b(?:{'|'.join(words)})\b"
    return "(?Ud)" + "|".join(f"(?:{p})" for p in patterns)


def keyword_tier(text, rules=fixed.KEYWORD_RULES) -> Column:
    """Highest tier of any rule that matches; null text gives 0.

    One expression per tier, highest first, so a hit ends the search.
    """
    lowered = F.lower(as_column(text))
    by_tier: dict[int, list[str]] = {}
    for tier, pattern in rules:
        by_tier.setdefault(tier, []).append(pattern)
    result = F.lit(0)
    for tier in sorted(by_tier):
        result = F.when(lowered.rlike(tier_pattern(by_tier[tier])), tier).otherwise(result)
    return result.cast("int")


def extension_tier(filename, tiers=fixed.EXTENSION_TIERS) -> Column:
    """Tier of the final extension; unknown or missing extensions give 1."""
    ext = F.regexp_extract(F.lower(as_column(filename)), fixed.EXTENSION_PATTERN, 1)
    table = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(fixed.EXTENSION_DEFAULT)).cast("int")


def signature_tier(content, signatures=fixed.SIGNATURE_TIERS) -> Column:
    """Tier of a hex signature at the start of the content."""
    text = F.coalesce(as_column(content), F.lit(""))
    result = F.lit(0)
    for prefix, tier in sorted(signatures.items(), key=lambda kv: kv[1]):
        result = F.when(text.startswith(prefix), tier).otherwise(result)
    return result.cast("int")


def tier_label(tier) -> Column:
    t = as_column(tier)
    result = F.lit(None).cast("string")
    for value, label in enumerate(fixed.TIER_LABELS):
        result = F.when(t == value, label).otherwise(result)
    return result
