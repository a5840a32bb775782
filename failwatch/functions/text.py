"""Text expressions over log lines, image tags and templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from failwatch import settings as S

_JAVA_META = re.compile(r"([\\.\[\]{}()*+\-?^$|])")


def any_of(phrases: list[str]) -> str:
    """Regex matching any of the phrases literally."""
    return "|".join(_JAVA_META.sub(r"\\\1", p) for p in phrases)


def detect_stack(image_tag: Column) -> Column:
    tag = F.lower(F.coalesce(image_tag, F.lit("")))
    rules = [(tag.rlike(any_of(words)), stack) for words, stack in S.STACK_RULES]
    last_test, last_stack = rules.pop()
    rules.append((last_test | tag.startswith(S.GO_TAG_PREFIX), last_stack))
    return _first_match(rules, S.UNKNOWN_STACK)


def detect_log_level(text: Column) -> Column:
    upper = F.upper(text)
    rules = [(upper.rlike(any_of(words)), level) for words, level in S.LEVEL_RULES]
    return _first_match(rules, S.DEFAULT_LEVEL)


def has_gc_word(text: Column) -> Column:
    return F.coalesce(F.upper(text).rlike(any_of(S.GC_WORDS)), F.lit(False))


def _first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rules[1:],
                   F.when(rules[0][0], rules[0][1]))
    return chain.otherwise(default)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def clean_message(text: Column) -> Column:
    """Keep letters, digits, blanks, dot, colon and square brackets."""
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9 .:\[\]]+", ""))


def tokens(text: Column) -> Column:
    """White-space tokens; empty text has none."""
    parts = F.split(strip(text), r"\s+")
    return F.when(~text.rlike(r"\S"), F.array().cast("array<string>")).otherwise(parts)


def mask_numbers(token_array: Column) -> Column:
    """Replace tokens that hold a digit by the wildcard."""
    return F.transform(
        token_array, lambda t: F.when(t.rlike(r"\d"), F.lit("<*>")).otherwise(t)
    )


def keyword_type(template: Column) -> Column:
    """memory_leak, cpu_spike or null; memory phrases win."""
    upper = F.upper(template)
    return F.when(upper.rlike(any_of(S.MEMORY_PHRASES)), "memory_leak").when(
        upper.rlike(any_of(S.CPU_PHRASES)), "cpu_spike"
    )


def words(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def with_bigrams(word_array: Column) -> Column:
    """The words followed by every pair of neighbours."""
    pairs = F.greatest(F.size(word_array) - 1, F.lit(0))
    return F.concat(
        word_array,
        F.zip_with(
            F.slice(word_array, F.lit(1), pairs),
            F.slice(word_array, F.lit(2), pairs),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    )
