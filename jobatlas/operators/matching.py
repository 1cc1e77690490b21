"""Dictionary joins between text and small dimensions: skills in text, titles to careers.

Both joins prune by leading tokens: the distinct tokens and neighbouring token pairs of a
text meet the leading token or pair of each alias in an equi-join, so no text is ever
compared with the whole dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.functions.let import let
from jobatlas.functions.parsing import relevant_description
from jobatlas.functions.scoring import labels_match
from jobatlas.functions.text import contains_any, norm_label, norm_match, word_tokens
from jobatlas.operators.packs import meet, pack
from jobatlas.operators.spans import apart_rows, kept_rows, kept_skills

UNMAPPED = "unmapped"
#: Characters of the grams that patterns are filed under.
GRAM = 3

# Negation right before or right after a skill.
NEGATED_BEFORE = (
    r"(?U)(?:(?:không|chưa)\s+(?:yêu cầu|bắt buộc|cần)"
    r"(?:\s+(?:ứng viên|phải|biết|sử dụng|thành thạo)){0,4}\s*|(?:not|required no|without)\s+)$"
)
NEGATION_WORDS = ("không", "chưa", "not ", "required no ", "without ")
NEGATED_AFTER = r"(?U)^\s*(?:(?:là\s+)?(?:không|chưa)\s+(?:bắt buộc|cần thiết|yêu cầu)|(?:is\s+)?not\s+required)"


def boundary_pattern(phrase: Column) -> Column:
    """Regular expression of a literal phrase on Unicode word boundaries."""
    # The literal comes first so that the scan can skip ahead to it; the look-behind then
    # checks the character in front of the literal just matched.
    return F.concat(F.lit(r"(?U)\Q"), phrase, F.lit(r"\E(?<!\w\Q"), phrase, F.lit(r"\E)(?!\w)"))


def leading_key(phrase: Column) -> Column:
    """First two tokens of a phrase, its only token, or nothing when it has no word character."""
    return F.array_join(F.slice(word_tokens(phrase), 1, 2), " ")


def text_keys(text: Column) -> Column:
    """Every key an alias found in the text can have."""
    def keys(tokens: Column) -> Column:
        n = F.greatest(F.size(tokens) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(tokens, pairs, F.array(F.lit(""))))

    return let(word_tokens(text), keys)


def alias_table(taxonomy: DataFrame) -> DataFrame:
    """One row per normalized alias (canonical name included) from ``name, aliases, taxonomy_order``.

    An alias is cut into what stands before its first word, its words with the gaps between them, and what follows the
    last word.  ``alias_key`` are its first one or two words as they stand; ``settled`` tells that nothing else is left to
    compare where the key occurs.
    """
    names = F.array_distinct(
        F.transform(F.concat(F.array(F.col("name")), F.col("aliases")), norm_match)
    )
    # Built inside one array, whose items are bound step by step: later plans see columns, not the work behind them.
    each = F.explode(F.transform(F.filter(names, lambda n: n != ""), _cut_alias)).alias("a")
    return taxonomy.select(F.col("name").alias("skill"), "taxonomy_order", each).select("skill", "taxonomy_order", "a.*")


def _cut_alias(alias: Column) -> Column:
    def counted(v: Column) -> Column:
        words = F.greatest(F.ceil((F.size(v.parts) - v.first + 1) / 2).cast("int"), F.lit(0))
        return let(F.struct(v.parts.alias("parts"), v.first.alias("first"), words.alias("n"), (v.first + 2 * words - 2).alias("last")), fields)

    def fields(v: Column) -> Column:
        some = v.n > 0
        inner = lambda most: F.when(some, F.array_join(F.slice(v.parts, v.first, F.greatest(F.least(2 * v.n - 1, most), F.lit(0))), "")).otherwise("")
        head = F.when(some & (v.first == 2), F.get(v.parts, F.lit(0))).otherwise("")
        tail = F.when(some & (F.size(v.parts) > v.last), F.get(v.parts, v.last)).otherwise("")
        size = F.length(alias)
        apart = lambda at: ~F.substring(alias, at, F.lit(1)).rlike(r"(?U)\w")
        # Only a border between words lets an alias begin again before it has ended.
        borders = F.exists(F.sequence(F.lit(1), size), lambda n: (n < size) & apart(size - n) & apart(n + 1) & (F.left(alias, n) == F.right(alias, n)))
        key = inner(F.lit(3))
        return F.struct(
            alias.alias("alias"), key.alias("alias_key"), head.alias("head"), inner(F.size(v.parts)).alias("middle"), tail.alias("tail"), v.n.alias("n_words"),
            (some & (key == alias)).alias("settled"), borders.alias("may_overlap_itself"))

    return let(pieces(alias), lambda p: let(F.struct(p.alias("parts"), _first_word(p).alias("first")), counted))


def _candidates(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, text, alias row) pairs that share the alias' leading key.

    Only keys meet the dictionary, in one equi-join whatever its size; a text joins its own candidates afterwards, so
    texts without any produce no rows.
    """
    keyed = texts.select(key, F.explode(text_keys(F.col(text))).alias("alias_key"))
    return keyed.join(aliases, "alias_key").join(texts.select(key, text), key)


def posting_text(title: Column, description: Column) -> Column:
    return norm_match(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), relevant_description(description)))


def pieces(text: Column) -> Column:
    """Words and the gaps between them, in turn; together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))


def _first_word(parts: Column) -> Column:
    """Number of the first word among the pieces, from one."""
    return F.when(F.get(parts, F.lit(0)).rlike(r"(?U)^\w"), 1).otherwise(2)


def token_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, wary, at, alias_key``: every word and every two neighbouring words with their gap, at their piece number.

    ``wary`` marks texts with a word of negation.  Nothing of a text but its words travels on.
    """
    cut = texts.select(key, contains_any(F.col(text), NEGATION_WORDS).alias("wary"), pieces(F.col(text)).alias("_p"))
    cut = cut.select(key, "wary", "_p", _first_word(F.col("_p")).alias("_first"))
    # Pieces beside the next and the one after it: all of it stays in generated code, without a function per item.
    size = F.size("_p")
    three = F.arrays_zip(F.col("_p").alias("a"), F.slice("_p", F.lit(2), size).alias("b"), F.slice("_p", F.lit(3), size).alias("c"))
    each = cut.select(key, "wary", "_first", F.posexplode(three).alias("_i", "t")).where((F.col("_i") + 1 - F.col("_first")) % 2 == 0)
    keys = F.explode(F.array("t.a", F.concat("t.a", "t.b", "t.c"))).alias("alias_key")
    return each.select(key, "wary", (F.col("_i") + 1).alias("at"), keys).where("alias_key is not null")


def _alias_hits(texts: DataFrame, aliases: DataFrame, key: str, text: str, wary: bool) -> DataFrame:
    """``key, skill, taxonomy_order, alias, again, start, end`` of every occurrence, less the negated ones if ``wary``.

    Words and pairs meet the dictionary in one equi-join.  Most hits are settled by it.  The others, and those in texts
    with a negation, are gathered per text and compared with its pieces, so a text is joined at most once; texts that
    can have none of them are not cut for it.  Places are numbers of a piece times 2**32 plus characters into it, and
    order as characters do.  ``again`` is the alias where ``wary`` asks that hits inside an earlier one be dropped still.
    """
    columns = ("skill", "taxonomy_order", "alias", "head", "middle", "tail", "n_words", "may_overlap_itself")
    worded = aliases.where("n_words > 0")
    has_bare, has_open = aliases.agg(F.bool_or(F.col("n_words") == 0), F.bool_or((F.col("n_words") > 0) & ~F.col("settled"))).first()
    known = worded.select("alias_key", "settled", *columns)
    met = token_table(texts, key, text).join(known.where("settled"), "alias_key")
    place = lambda i: i.cast("long") * F.lit(1 << 32)
    after = F.col("at") + 2 * F.col("n_words") - 1
    done = F.col("settled") & ~F.col("wary") if wary else F.col("settled")
    again = F.when(F.lit(wary) & F.col("may_overlap_itself"), F.col("alias")).alias("again")
    found = (key, "skill", "taxonomy_order", "alias", again)
    settled = met.where(done).select(*found, place(F.col("at")).alias("start"), place(after).alias("end"))
    unsure = texts if has_open else texts.where(contains_any(F.col(text), NEGATION_WORDS))
    open_ = token_table(unsure, key, text).join(known, "alias_key").where(~done).groupBy(key).agg(F.collect_list(F.struct("at", *columns)).alias("_hits"))

    def before(parts: Column, i: Column) -> Column:
        return F.when(i >= 2, F.get(parts, i - 2)).otherwise("")

    def behind(parts: Column, h: Column) -> Column:
        return F.coalesce(F.get(parts, h.at + 2 * h.n_words - 2), F.lit(""))

    def stands(parts: Column, h: Column) -> Column:
        gap, more = before(parts, h.at), behind(parts, h)
        words = F.array_join(F.slice(parts, h.at, F.least(2 * h.n_words - 1, F.size(parts) - h.at + 1)), "")
        left = (h.head == "") | (gap.endswith(h.head) & ((F.length(gap) > F.length(h.head)) | (h.at == 2)))
        end = h.at + 2 * h.n_words - 1
        right = (h.tail == "") | (more.startswith(h.tail) & ((F.length(more) > F.length(h.tail)) | (end == F.size(parts))))
        return (words == h.middle) & left & right

    def negated(parts: Column, h: Column) -> Column:
        low = F.greatest(h.at - 56, F.lit(1))
        ahead = F.array_join(F.slice(parts, low, h.at - low), "")
        ahead = F.left(ahead, F.length(ahead) - F.length(h.head))
        end = h.at + 2 * h.n_words - 1
        rest = F.array_join(F.slice(parts, end, F.lit(36)), "")
        rest = F.substring(rest, F.length(h.tail) + 1, F.lit(35))
        return F.right(ahead, F.lit(55)).rlike(NEGATED_BEFORE) | rest.rlike(NEGATED_AFTER)

    def one_by_one(hits: Column) -> Column:
        """Without those that begin inside an earlier kept one of the same alias, as in a scan from left to right."""
        again = F.array_sort(F.transform(F.filter(hits, lambda h: h.may_overlap_itself), lambda h: F.struct(F.struct(h["alias"].alias("alias"), h.skill.alias("skill")).alias("a"), h.at.alias("at"), h.alias("h"))))
        state = F.struct(F.lit(None).cast("struct<alias: string, skill: string>").alias("a"), F.lit(0).alias("end"), F.slice(hits, F.lit(1), F.lit(0)).alias("kept"))

        def step(s: Column, x: Column) -> Column:
            kept = F.struct(x.a.alias("a"), (x.at + 2 * x.h.n_words - 1).alias("end"), F.concat(s.kept, F.array(x.h)).alias("kept"))
            return F.when((s.a == x.a) & (x.at < s.end), s).otherwise(kept)

        return F.concat(F.filter(hits, lambda h: ~h.may_overlap_itself), F.aggregate(again, state, step, lambda s: s.kept))

    def spans(parts: Column, hits: Column) -> Column:
        kept = F.filter(hits, lambda h: stands(parts, h))
        if wary:
            kept = F.filter(let(kept, one_by_one), lambda h: ~negated(parts, h))
        return F.transform(kept, lambda h: F.struct(
            h.skill.alias("skill"), h.taxonomy_order.alias("taxonomy_order"), h["alias"].alias("alias"),
            F.when(h.head == "", place(h.at)).otherwise(place(h.at - 1) + F.length(before(parts, h.at)) - F.length(h.head)).alias("start"),
            (place(h.at + 2 * h.n_words - 1) + F.length(h.tail)).alias("end")))

    every = settled
    if wary or has_open:
        checked = open_.join(unsure.select(key, F.col(text).alias("_text")), key)
        checked = checked.select(key, F.explode(let(pieces(F.col("_text")), lambda p: spans(p, F.col("_hits")))).alias("s")).select(key, "s.*")
        every = every.unionByName(checked, allowMissingColumns=True)
    # A dictionary seldom has an alias without a word; only then are gaps looked at.
    return every.unionByName(_bare_hits(texts, aliases.where("n_words = 0"), key, text, wary), allowMissingColumns=True) if has_bare else every


def _bare_hits(texts: DataFrame, bare: DataFrame, key: str, text: str, wary: bool) -> DataFrame:
    """Occurrences of aliases without any word character, which lie inside one gap; they meet gaps by a first character."""
    def gaps(parts: Column) -> Column:
        numbered = F.transform(parts, lambda g, i: F.struct((i + 1).alias("at"), g.alias("gap")))
        return F.filter(numbered, lambda x: ~x.gap.rlike(r"(?U)^\w") & (x.gap != " "))

    each = texts.select(key, F.col(text).alias("_text"), F.size(pieces(F.col(text))).alias("_n"), F.explode(let(pieces(F.col(text)), gaps)).alias("g"))
    light = each.select(key, "_n", "g.at", "g.gap", F.explode(F.array_distinct(F.split("g.gap", ""))).alias("_c"))
    met = light.join(bare.select("skill", "taxonomy_order", "alias", F.left("alias", F.lit(1)).alias("_c")), "_c").where(F.col("gap").contains(F.col("alias")))
    size = F.length("alias")
    free = lambda i: ((i > 1) | (F.col("at") == 1)) & ((i + size <= F.length("gap")) | (F.col("at") == F.col("_n")))
    fits = F.filter(F.sequence(F.lit(1), F.length("gap")), lambda i: (F.substring(F.col("gap"), i, size) == F.col("alias")) & free(i))
    apart = F.aggregate(
        fits, F.array().cast("array<int>"),
        lambda kept, i: F.when(i < F.coalesce(F.try_element_at(kept, F.lit(-1)) + size, F.lit(0)), kept).otherwise(F.concat(kept, F.array(i))))
    at = met.select("*", F.explode(apart).alias("i"))
    base = F.col("at").cast("long") * F.lit(1 << 32)
    hits = at.select(key, "skill", "taxonomy_order", "alias", (base + F.col("i") - 1).alias("start"), (base + F.col("i") - 1 + size).alias("end"))
    if not wary:
        return hits
    joined = hits.join(texts.select(key, pieces(F.col(text)).alias("_p")), key)
    piece, inside, stop = (F.shiftright("start", 32).cast("int"), (F.col("start") % (1 << 32)).cast("int"), (F.col("end") % (1 << 32)).cast("int"))
    low = F.greatest(piece - 56, F.lit(1))
    ahead = F.concat(F.array_join(F.slice("_p", low, piece - low), ""), F.left(F.get("_p", piece - 1), inside))
    rest = F.substring(F.array_join(F.slice("_p", piece, F.lit(37)), ""), stop + 1, F.lit(35))
    return joined.where(~F.right(ahead, F.lit(55)).rlike(NEGATED_BEFORE) & ~rest.rlike(NEGATED_AFTER)).select(*hits.columns)


def alias_mentions(texts: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Every boundary-safe, not negated occurrence of every alias: ``key, skill, taxonomy_order, alias, start, end``.

    ``text`` is normalized.  Texts that are null or hold no alias give no row; ``key`` must be unique.
    """
    rows = _by_place(_alias_hits(texts, aliases, key, text, True), key, "alias", "again")
    names = (key, "start", "end", "size", "taxonomy_order", "skill", "alias")
    return rows.mapInArrow(apart_rows, _schema(rows, *names)).select(key, "skill", "taxonomy_order", "alias", "start", "end")


def _by_place(mentions: DataFrame, key: str, *columns: str) -> DataFrame:
    """A text's mentions next to each other, by start and end."""
    rows = mentions.select(key, "start", "end", F.length("alias").alias("size"), "taxonomy_order", "skill", *columns)
    return rows.repartition(key).sortWithinPartitions(key, "start", "end")


def _schema(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)


def resolve_overlaps(mentions: DataFrame, key: str = "id") -> DataFrame:
    """Keep longest-first, non-overlapping mentions.

    A task walks its texts' mentions in order and settles a cluster of touching spans once it has ended, so a very long
    text needs memory for one cluster only.
    """
    rows = _by_place(mentions, key, "alias")
    names = (key, "start", "end", "taxonomy_order", "skill", "alias")
    kept = rows.mapInArrow(kept_rows, _schema(rows, *names))
    return kept.select(key, "skill", "taxonomy_order", "alias", "start", "end")


def tag_skills(texts: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Distinct skills of each text in taxonomy order: ``key, skills``.  Texts without any are absent.

    Overlaps are resolved as in ``resolve_overlaps``; the lists are made in the same walk.
    """
    rows = _by_place(_alias_hits(texts, aliases, key, text, True), key, "again")
    return rows.mapInArrow(kept_skills, f"{_schema(rows, key)}, skills array<string>")


def find_skills(texts: DataFrame, aliases: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Presence only: which skills have any alias in the text, without overlap or negation rules."""
    return _alias_hits(texts, aliases, key, text, False).select(key, "skill", "taxonomy_order").distinct()


def resolve_labels(labels: DataFrame, aliases: DataFrame, label: str = "label") -> DataFrame:
    """Canonical skill of free labels; unknown labels keep a null skill."""
    owners = aliases.select(F.col("alias").alias("_alias"), "skill", "taxonomy_order")
    return labels.join(owners, norm_match(F.col(label)) == F.col("_alias"), "left").drop("_alias")


# ---------------------------------------------------------------- titles to careers


def pattern_table(careers: DataFrame) -> DataFrame:
    """One row per normalized title pattern from ``career_id, title_patterns``."""
    patterns = F.array_distinct(F.transform(F.col("title_patterns"), norm_match))
    return careers.select("career_id", F.explode(patterns).alias("alias")).withColumn(
        "alias_key", leading_key(F.col("alias"))
    )


def map_titles(titles: DataFrame, patterns: DataFrame, column: str = "title") -> DataFrame:
    """Career decision for each distinct normalized title.

    Exact beats contained, then more words, then more characters.  A best score shared
    by two careers is ambiguous.  Only distinct titles are matched, so a title that
    fills a third of the table costs one row.
    """
    distinct = titles.select(norm_match(F.col(column)).alias("title_norm")).distinct()
    texts = distinct.withColumn("title_text", F.col("title_norm"))
    hits = _candidates(texts, "title_norm", "title_text", patterns)
    score = F.struct(
        (F.col("title_norm") == F.col("alias")).cast("int").alias("exact"),
        F.size(F.split("alias", " ")).alias("words"),
        F.length("alias").alias("chars"),
    )
    scored = hits.where(F.regexp_like("title_text", boundary_pattern(F.col("alias")))).select(
        "title_norm", score.alias("score"), "career_id", "alias"
    )
    per_score = scored.groupBy("title_norm", "score").agg(
        F.min("career_id").alias("first_career"), F.max("career_id").alias("last_career"), F.min("alias").alias("pattern")
    )
    best = per_score.groupBy("title_norm").agg(
        F.max_by(F.struct("first_career", "last_career", "pattern", "score"), "score").alias("b")
    )
    ambiguous = F.col("b.first_career") != F.col("b.last_career")
    return best.select(
        "title_norm",
        F.when(ambiguous, UNMAPPED).otherwise(F.col("b.first_career")).alias("career_id"),
        F.when(ambiguous, UNMAPPED).otherwise("title_pattern").alias("method"),
        F.when(ambiguous, "ambiguous_title_pattern")
        .when(F.col("b.score.exact") == 1, "exact_title_pattern")
        .otherwise("contained_title_pattern").alias("reason"),
        F.when(~ambiguous, F.col("b.pattern")).alias("matched_pattern"),
    )


def map_postings(postings: DataFrame, patterns: DataFrame, column: str = "title") -> DataFrame:
    """Postings with ``career_id, method, reason, matched_pattern``."""
    decisions = map_titles(postings, patterns, column)
    joined = postings.withColumn("title_norm", norm_match(F.col(column))).join(decisions, "title_norm", "left")
    return joined.select(
        *postings.columns,
        F.coalesce("career_id", F.lit(UNMAPPED)).alias("career_id"),
        F.coalesce("method", F.lit(UNMAPPED)).alias("method"),
        F.coalesce("reason", F.lit("no_title_pattern")).alias("reason"),
        "matched_pattern",
    )


def _grams(text: Column, size: Column) -> Column:
    """Substrings of this many characters, none if the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, size)), F.array().cast("array<string>"))


def contained_patterns(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Pairs of distinct ``text`` and ``pattern`` where the text contains the pattern anywhere.

    A pattern is filed under the gram of its own that the fewest patterns hold (three characters; the whole pattern if
    it is shorter).  A text meets only patterns filed under one of its grams, whatever the number of patterns; then
    containment is tested.  Null texts and patterns meet nothing; an empty pattern is in every text.
    """
    own = patterns.select(F.col(pattern).alias("_pattern")).where("_pattern is not null").distinct()
    each = own.select("_pattern", F.explode(F.array_distinct(_grams(F.col("_pattern"), F.least(F.length("_pattern"), F.lit(GRAM))))).alias("_gram"))
    common = each.groupBy("_gram").agg(F.count(F.lit(1)).alias("_many"))
    filed = each.join(common, "_gram").groupBy("_pattern").agg(F.min(F.struct("_many", "_gram"))["_gram"].alias("_gram"))
    column = F.col(text)
    grams = F.concat(F.array(F.lit("")), *[_grams(column, F.lit(n)) for n in range(1, GRAM + 1)])
    met = texts.select(text).where(column.isNotNull()).distinct().select(text, F.explode(F.array_distinct(grams)).alias("_gram"))
    hits = met.join(filed, "_gram").where(column.contains(F.col("_pattern")))
    return hits.select(text, F.col("_pattern").alias(pattern))


def soft_label_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of the labels ``a`` and ``b`` that match softly (``scoring.skill_match``), and no others."""
    x = left.select(a, norm_label(F.col(a)).alias("_a")).distinct()
    y = right.select(b, norm_label(F.col(b)).alias("_b")).distinct()
    inside = contained_patterns(x, y, "_a", "_b").unionByName(contained_patterns(y, x, "_b", "_a")).distinct()
    near = inside.where(labels_match(F.col("_a"), F.col("_b")))
    return near.join(x, "_a").join(y, "_b").select(a, b)


def judged_label_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of the distinct labels ``a`` and ``b`` with ``matches``, the verdict of ``scoring.skill_match``.

    Each label is normalized once; the result itself has a row for every pair.
    """
    x = left.select(a, norm_label(F.col(a)).alias("_a")).distinct()
    y = right.select(b, norm_label(F.col(b)).alias("_b")).distinct()
    met = meet(x, *pack(y, F.struct("_b", b))).select(a, "_a", F.explode("items").alias("_y"))
    return met.select(a, F.col(f"_y.{b}").alias(b), labels_match(F.col("_a"), F.col("_y._b")).alias("matches"))


def map_first_substring(postings: DataFrame, patterns: DataFrame, column: str = "title") -> DataFrame:
    """First career, in base order, with a pattern anywhere inside the lower-case title.

    ``patterns`` holds ``career_id, career_pos, pattern_pos, pattern``.  The test is plain containment; each distinct
    title meets the patterns of its rare grams only.
    """
    rows = patterns.select("career_pos", "pattern_pos", "career_id", F.lower("pattern").alias("pattern"))
    titles = postings.select(F.lower(column).alias("title_lower"))
    found = contained_patterns(titles, rows, "title_lower").join(rows, "pattern")
    decided = found.groupBy("title_lower").agg(F.min(F.struct("career_pos", "pattern_pos", "career_id", "pattern")).alias("hit"))
    joined = postings.withColumn("title_lower", F.lower(column)).join(decided, "title_lower", "left")
    return joined.select(
        *postings.columns,
        F.coalesce("hit.career_id", F.lit(UNMAPPED)).alias("career_id"),
        F.col("hit.pattern").alias("matched_pattern"),
    )
