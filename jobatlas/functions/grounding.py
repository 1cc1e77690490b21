"""Number and quote grounding of explanation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobatlas.functions.let import let

NUMBER = r"((?<![A-Za-z_])\d+(?:[.,]\d+)?)"


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1))


def int_spelling(value: Column) -> Column:
    return F.array_compact(F.array(value.cast("long").cast("string")))


def double_spellings(value: Column) -> Column:
    """Ways a decimal may be written: 12, 12.0, 6.5 and 6,5."""
    text = value.cast("double").cast("string")
    return F.array_distinct(
        F.array_compact(F.array(text, F.regexp_replace(text, r"\.0$", ""), F.replace(text, F.lit("."), F.lit(","))))
    )


def _spellings(token: Column) -> Column:
    return F.array_compact(
        F.array(
            token,
            F.replace(token, F.lit(","), F.lit(".")),
            F.replace(token, F.lit("."), F.lit(",")),
            F.when(token.endswith(".0"), F.regexp_replace(token, r"\.0$", "")),
        )
    )


def numbers_grounded(text: Column, allowed: Column) -> Column:
    """Every number in the text is one of the allowed spellings."""
    return let(
        F.flatten(F.transform(allowed, _spellings)),
        lambda known: F.forall(number_tokens(text), lambda t: F.arrays_overlap(_spellings(t), known)),
    )


def quote_belongs(quote: Column, allowed: Column) -> Column:
    """Equal to, inside, or around one of the allowed quotes."""
    def near(q: Column, a: Column) -> Column:
        other = F.lower(F.trim(a))
        return other.contains(q) | q.contains(other)

    return let(
        F.lower(F.trim(F.coalesce(quote, F.lit("")))), lambda q: (q != "") & F.exists(allowed, lambda a: near(q, a))
    )


def quote_item(quote: Column) -> Column:
    """A quote made ready for ``quotes_hold``: its normal form, and the hash of three words amid it.

    Words between blanks stand as such in every text around the quote; a quote without three inner ones has no hash.
    """
    def keyed(w: Column) -> Column:
        middle = F.slice(w, F.greatest(F.floor((F.size(w) - 3) / 2), F.lit(1)).cast("int") + 1, F.lit(3))
        return F.when(F.size(w) >= 5, F.get(_threes(middle), F.lit(0)))

    form = F.lower(F.trim(quote))
    return F.struct(let(F.split(form, " "), keyed).alias("key"), form.alias("form"))


def _threes(words: Column) -> Column:
    """Hash of every three neighbouring words."""
    three = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))
    return F.transform(F.slice(three, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))


def quotes_hold(quote: Column, items: Column) -> Column:
    """``quote_belongs`` against ``quote_item`` rows: only those whose three words occur are looked for in the text."""
    longest = F.array_max(F.transform(items, lambda i: F.length(i.form)))

    def around(q: Column) -> Column:
        def tested(hits: Column) -> Column:
            return F.exists(items, lambda i: (i.key.isNull() | F.array_contains(hits, i.key)) & q.contains(i.form))

        keys = F.array_compact(F.transform(items, lambda i: i.key))
        return let(F.array_intersect(_threes(F.split(q, " ")), keys), tested)

    def inside(q: Column) -> Column:
        return F.when(F.length(q) <= longest, F.exists(items, lambda i: i.form.contains(q))).otherwise(False)

    return let(F.lower(F.trim(F.coalesce(quote, F.lit("")))), lambda q: (q != "") & (inside(q) | around(q)))


def dotted_thousands(n: Column) -> Column:
    return F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit("."))


def source_note(n: Column, snapshot: Column) -> Column:
    return F.concat(
        F.lit("Từ "), dotted_thousands(n), F.lit(" tin tuyển dụng quan sát, "),
        F.coalesce(snapshot, F.lit("snapshot chưa xác minh")),
    )
