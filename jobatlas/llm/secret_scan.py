"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import read_table, save

#: Characters between the parts of one credential: the scope of a link.
SCOPE = 200


@dataclass(frozen=True)
class Kind:
    """A span kind. Strong kinds are always reported; the others only next to a part of each kind set in ``needs``."""

    name: str
    pattern: str
    least: int
    group: int = 0
    needs: tuple[tuple[str, ...], ...] = ()


#: Fixed patterns of the base kinds; ``least`` is the shortest match (or group) that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Kind("assign", ASSIGN, 8, 2), Kind("access", r"AKIA[A-Z0-9]+", 16), Kind("hex", r"[0-9a-f]+", 32))
IDS, SECRETS, ENDS = ("access", "login"), ("assign", "hex", "key"), ("endpoint",)
WEAK = (
    Kind("login", r"""(?i:(?:access_key_id|client_id|account_id|user(?:name)?|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 3, 0, (SECRETS,)),
    Kind("key", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 40, 0, (IDS + ENDS,)),
    Kind("endpoint", r"""(?i:(?:https?|s3|ftp|amqps?|redis|mongodb|mysql|postgres(?:ql)?))://[^\s"'<>]+""", 8, 0, (IDS, SECRETS)),
)
KINDS = BASE + WEAK
#: One pass tells texts in which no kind can occur: what each base kind holds at least, and every weak pattern.
_ANY = "|".join([r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}", *(k.pattern for k in WEAK)])
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def text_column(name: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _matches(texts: DataFrame, kind: Kind) -> DataFrame:
    """(key, kind, start, end) of a kind's leftmost matches that are long enough; code points, end exclusive.

    Matches and the pieces between them come as two aligned lists; running sums of their lengths give the places.
    """
    # A run of 32 or more is found as such; only the assignment can swallow a later match with a short one.
    pattern = kind.pattern if kind.group else kind.pattern.replace("[0-9a-f]+", "[0-9a-f]{32,}")
    cut = texts.where(F.col("text").rlike(pattern)).select(
        "key", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.transform(F.split("text", pattern, -1), F.length).alias("between")
    )
    each = cut.select("key", F.posexplode("found").alias("i", "match"), "between").select("key", "i", "match", F.get("between", F.col("i")).alias("gap"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    value = F.regexp_extract("match", kind.pattern, kind.group) if kind.group else F.col("match")
    return (
        each.withColumn("end", F.sum(F.col("gap") + size).over(upto))
        .where(F.length(value) >= kind.least)
        .select("key", F.lit(kind.name).alias("kind"), (F.col("end") - size).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    )


def _linked(strong: DataFrame, weak: DataFrame, scope: int) -> DataFrame:
    """Weak spans that have a part of every needed set within ``scope``: an interval join on text and stretch.

    Every part is filed under the stretches of ``scope`` characters that it touches, each weak span under those that
    its surroundings touch, so spans of any length meet where one reaches the other's surroundings; a pair that meets
    in several stretches counts once in the set.  Spans of one kind do not overlap, so a stretch holds few.
    """
    parts = strong.unionByName(weak)
    stretches = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope), F.floor(hi / scope))).alias("stretch")
    filed = parts.select("key", F.col("kind").alias("other"), F.col("start").alias("lo"), F.col("end").alias("hi"), stretches(F.col("start"), F.col("end")))
    own = weak.select("*", stretches(F.col("start") - scope, F.col("end") + scope))
    near = (F.col("lo") <= F.col("end") + scope) & (F.col("hi") >= F.col("start") - scope)
    met = own.join(filed, ["key", "stretch"]).where(near).groupBy("key", "kind", "start", "end").agg(F.collect_set("other").alias("others"))
    good = F.lit(False)
    for kind in WEAK:
        need = F.col("kind") == kind.name
        for names in kind.needs:
            need = need & F.arrays_overlap("others", F.array(*map(F.lit, names)))
        good = good | need
    return met.where(good).select("key", "kind", "start", "end")


def spans_by_text(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, spans) of the distinct texts of ``docs`` that hold secrets; key is the text's md5, spans are in order."""
    texts = docs.select(text_column().alias("text")).where(F.col("text").rlike(_ANY)).withColumn("key", F.md5("text"))
    texts = save(texts.dropDuplicates(["key"]).select("key", "text"))

    def union(kinds) -> DataFrame:
        out = None
        for k in kinds:
            out = _matches(texts, k) if out is None else out.unionByName(_matches(texts, k))
        return out

    strong, weak = save(union(BASE)), save(union(WEAK))
    # A weak candidate inside a strong span says nothing new.
    s = strong.select("key", F.col("start").alias("lo"), F.col("end").alias("hi"))
    weak = weak.join(s, (weak.key == s.key) & (s.lo < weak.end) & (weak.start < s.hi), "left_anti")
    every = strong.unionByName(_linked(strong, weak, scope))
    rank = F.create_map(*(F.lit(x) for name, i in _ORDER.items() for x in (name, i)))
    span = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end")
    return every.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text, ...): spans of struct (start, rank, kind, end), in order.

    Base spans are always there.  Weak candidates (a login, a bare key, an endpoint) are there only if the parts they
    need stand within ``scope`` characters: a login next to a secret, a key next to an identifier or endpoint, an
    endpoint next to both an identifier and a secret.  Texts are scanned once each, so rows may repeat and ids may be
    null; null and empty texts have no spans.
    """
    spans = spans_by_text(docs, scope)
    rows = docs.select("doc_id", F.md5(text_column()).alias("key"))
    return rows.join(spans, "key", "left").select("doc_id", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint>>)")).alias("spans"))


def redact_secrets(docs: DataFrame, scope: int = SCOPE, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``marker``; rows, order of columns and nulls stay."""
    spans = spans_by_text(docs, scope).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    suspect = F.coalesce(F.col("text").rlike(_ANY), F.lit(False))
    flat = F.aggregate(
        "__spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(
                    a["out"], F.when(x["start"] >= a["at"], F.concat(F.col("text").substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(marker))).otherwise(F.lit("")),
                ).alias("out"),
                x["end"].alias("at"),
            )
        ),
    )
    held = docs.where(suspect).withColumn("__key", F.md5("text")).join(spans, "__key", "left").withColumn("__cut", flat)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat("__cut.out", F.col("text").substr((F.col("__cut.at") + 1).cast("int"), F.length("text"))))
    held = held.withColumn("text", text).select(*docs.columns)
    return docs.where(~suspect).unionByName(held)


def op3_secret_scan(spark, sf_dir) -> DataFrame:
    """The contract query over all documents."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def _oracle() -> str:
    """The contract query for an engine whose patterns know no look-around and give no places."""
    patterns = {k.name: k.pattern for k in KINDS} | {"key": "[A-Za-z0-9+/=_-]{40,}", "hex": "[0-9a-f]{32,}"}
    found = " UNION ALL ".join(
        f"SELECT k, t, '{name}' AS kind, {_ORDER[name]} AS rank, regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}') AS ms FROM d" for name, p in patterns.items()
    )
    value = f"regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)"
    names = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    needs = " OR ".join(
        f"(w.kind = '{k.name}' AND " + " AND ".join(f"count(*) FILTER (o.kind IN {names(n)}) > 0" for n in k.needs) + ")" for k in WEAK
    )
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), p AS (
  SELECT k, t, kind, rank, ms, 1 AS i, instr(t, ms[1]) AS s FROM f WHERE len(ms) > 0
  UNION ALL
  SELECT k, t, kind, rank, ms, i + 1, s + length(ms[i]) - 1 + instr(substr(t, s + length(ms[i])), ms[i + 1]) FROM p WHERE i < len(ms)
), a AS (SELECT k, kind, rank, ms[i] AS m, s - 1 AS lo, s - 1 + length(ms[i]) AS hi FROM p), strong AS (
  SELECT k, kind, rank, lo, hi FROM a
  WHERE kind = 'assign' AND length({value}) >= 8 OR kind = 'access' AND length(m) >= 16 OR kind = 'hex' AND length(m) >= 32
), weak AS (
  SELECT k, kind, rank, lo, hi FROM a
  WHERE (kind = 'login' OR kind = 'endpoint' AND length(m) >= 8 OR kind = 'key' AND regexp_full_match(m, '[A-Za-z0-9+/]{{40}}'))
    AND NOT EXISTS (FROM strong s WHERE s.k = a.k AND s.lo < a.hi AND a.lo < s.hi)
), o AS (FROM strong UNION ALL FROM weak), linked AS (
  SELECT w.k, w.kind, w.rank, w.lo, w.hi FROM weak w JOIN o ON o.k = w.k AND o.lo <= w.hi + {SCOPE} AND o.hi >= w.lo - {SCOPE}
  WHERE w.k IN (SELECT k FROM strong UNION SELECT k FROM weak)
  GROUP BY ALL HAVING {needs}
), every AS (FROM strong UNION ALL FROM linked), g AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank) AS spans
  FROM every GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)
"""


OP3_SQL = _oracle()
