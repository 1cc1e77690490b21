"""Text normal forms and small string helpers, all as JVM-side column expressions.

The six forms are kept apart on purpose: matching, region lookup, blocking tokens,
accent folding, labels and the fold that keeps the stroked d each have their own rule.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLDED = [*range(0x00A0, 0x0250), *range(0x0386, 0x0460), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]


@lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str]:
    """Characters whose compatibility form is one other letter plus marks, and that letter."""
    source, target = [], []
    for code in _FOLDED:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(maxsize=None)
def _compose_pairs() -> str:
    """Base, mark and composed letter of every script, bases that are not composed themselves first, blank separated."""
    pairs: dict[str, str] = {}
    for code in range(0xC0, 0x2FA20):
        char, parts = chr(code), unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == char:
                pairs[pair] = char
    ordered = sorted(pairs.items(), key=lambda kv: (len(unicodedata.normalize("NFD", kv[1])), kv[0]))
    return " ".join(pair + composed for pair, composed in ordered)


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfc(c: Column) -> Column:
    """Unicode NFC of letters with marks in their usual order, in any script.  Rows without marks pass straight through.

    Hangul letters written in single parts stay apart; so do marks that stand in another than the canonical order.
    """
    pairs = F.split(F.lit(_compose_pairs()), " ")
    composed = F.aggregate(pairs, c, lambda acc, p: F.replace(acc, F.substring(p, 1, 2), F.substring(p, 3, 1)))
    return F.when(c.rlike(r"\p{M}"), composed).otherwise(c)


def norm_match(c: Column) -> Column:
    """Comparison form of names, aliases and titles."""
    return squeeze(F.replace(F.lower(nfc(c)), F.lit("ß"), F.lit("ss")))


def norm_region(c: Column) -> Column:
    return nfc(strip_space(F.lower(c)))


def norm_label(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def _strip_marks(c: Column) -> Column:
    source, target = _fold_tables()
    return F.regexp_replace(F.translate(c, source, target), r"\p{M}+", "")


def fold(c: Column) -> Column:
    """Lower case without accents; the stroked d becomes d."""
    return _strip_marks(F.translate(F.lower(F.coalesce(c, F.lit(""))), "đ", "d"))


def fold_nodj(c: Column) -> Column:
    """As ``fold`` but the stroked d is kept."""
    return _strip_marks(F.lower(F.coalesce(c, F.lit(""))))


def ascii_tokens(c: Column) -> Column:
    """Blocking tokens: decompose, drop what is not ASCII, lower, split."""
    plain = F.regexp_replace(_strip_marks(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]+", "")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"([a-z0-9]+)"), F.lit(1))


def has_vietnamese_marks(c: Column) -> Column:
    lowered = F.lower(c)
    return lowered.contains("đ") | (_strip_marks(lowered) != lowered)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))


def contains_any(c: Column, words) -> Column:
    """True when any of the plain substrings occurs."""
    test = F.lit(False)
    for word in words:
        test = test | c.contains(word)
    return test


def quote_regex(phrase: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in phrase)


def phrase_regex(phrase: str) -> str:
    """Whole-phrase pattern with flexible inner whitespace and Unicode boundaries."""
    body = r"\s+".join(quote_regex(part) for part in phrase.strip().split(" "))
    return rf"(?<!\w){body}(?!\w)"


def any_phrase_regex(phrases) -> str:
    """One alternation for a list of phrases, so each text is scanned once."""
    bodies = [r"\s+".join(quote_regex(p) for p in phrase.strip().split(" ")) for phrase in phrases]
    return rf"(?U)(?<!\w)(?:{'|'.join(bodies)})(?!\w)"


def py_fold(text: str) -> str:
    """Driver-side twin of ``fold`` for the fixed word lists."""
    base = unicodedata.normalize("NFKD", text.lower().replace("đ", "d"))
    return "".join(c for c in base if not unicodedata.combining(c))


def contains_folded_phrases(folded: Column, phrases) -> Column:
    return folded.rlike(any_phrase_regex(sorted({py_fold(p) for p in phrases})))


# One-word forms that collide with common words once accents are gone.
FOLD_STOP = ("ve", "day", "sua", "viet")


def contains_keywords(raw: Column, keywords) -> Column:
    """Any keyword on word boundaries; text without any accent is also tried folded."""
    lowered = F.lower(F.coalesce(raw, F.lit("")))
    direct = lowered.rlike(any_phrase_regex([k.lower() for k in keywords]))
    folded = sorted({py_fold(k) for k in keywords} - set(FOLD_STOP))
    if not folded:
        return direct
    retry = ~has_vietnamese_marks(lowered) & fold(lowered).rlike(any_phrase_regex(folded))
    return direct | retry
