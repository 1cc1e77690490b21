"""Conversation repair against an exhaustive version and a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from jobatlas.llm import conversations as conv
from jobatlas.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, dropped string, block int, whole int"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(c, t, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def expected(rows, damaged=True):
    by = {r[0]: [] for r in rows}
    for r in damage(rows) if damaged else rows:
        by[r[0]].append((r[1], *(" " if v is None else v for v in r[2:])))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}".encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        first = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit = best(tuple(first), tuple(faults))
        said, i = [], 0
        head = False
        for letter in audit:
            role, text = turns[i][1:] if letter != "I" else ("", "")
            i += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = ("user", "assistant")[(len(said) - head) % 2]
            elif not said and role[0] == "s":
                head = True
            said.append(f"{role}:{text}")
        out.append((c, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def best(roles, faults):
    """Least (cost, audit): plain recursion on (turn, roles so far in short), inserts at most two in a row."""
    n = len(roles)

    @lru_cache(None)
    def go(i, state, inserts):
        options = []
        if i == n and state in ("", "a"):
            options.append((0, ""))
        want = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 2:
            c, x = go(i, want, inserts + 1)
            options.append((c + 2, "I" + x))
        if i < n:
            c, x = go(i + 1, state, 0)
            options.append((c + 3, "D" + x))
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                if roles[i] == want or (roles[i] == "s" and state == ""):
                    c, x = go(i + 1, roles[i], 0)
                    options.append((c + more, "K" + x))
                c, x = go(i + 1, want, 0)
                options.append((c + 2 + more, "R" + x))
        return min(options) if options else (1 << 40, "")

    for i in range(n, 0, -40):
        go(i, "a", 2)
    return go(0, "", 0)


def some(rng, conversations, longest):
    texts = ["Yes.", "No!", "well", "", " \n", "Why?", "so it goes . ", "a" * 90 + ".", "a" * 90 + "!", "é", None]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1) * 2
            rows.append((c if c else None, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


def result(spark, rows, damaged=True, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    given = conv.damaged(table) if damaged else table
    reports, blocks = conv.repair_conversations(given, "dropped" if damaged else None, **options)
    rows = reports.alias("r").join(conv.repaired_digests(blocks).alias("d"), F.expr("r.conv_id <=> d.conv_id")).select("r.*", "d.repaired_sha256").collect()
    return ordered(map(tuple, rows))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("damaged", [True, False])
def test_many_short_conversations(spark, damaged):
    rows = some(random.Random(1), 150, 12)
    assert result(spark, rows, damaged) == ordered(expected(rows, damaged))


def test_long_conversations_over_blocks_and_partitions(spark):
    """One conversation holds most rows, another is cut in the middle of a partition; repeats lie far apart."""
    rng = random.Random(2)
    rows = some(rng, 6, 40) + [(50, t, rng.choice(["user", "assistant", "system"]), rng.choice(["again.", f"new {t}", "x", "", f"unique {t}."])) for t in range(400)]
    rows += [(50, 7, "user", "again.")] * 60
    assert result(spark, rows, block_turns=7) == ordered(expected(rows))


def test_empty_table_and_rows_dropped_whole(spark):
    assert result(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert result(spark, [(3, gone, "user", "Hi.")]) == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_over_the_whole_table(spark, small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert ordered(map(tuple, QUERIES["op11_conversation_repair"](spark, small).collect())) == ordered(expected(rows))


def test_dynamic_program_equals_the_search_over_all_edits():
    rng = random.Random(3)
    for _ in range(300):
        roles = [rng.choice("suax") for _ in range(rng.randint(0, 9))]
        faults = [rng.choice(["", "", "b", "d", "t"]) for _ in roles]
        codes = bytes(4 * ["", "b", "d", "t"].index(f) + "suax".index(r) for r, f in zip(roles, faults, strict=True))
        letters, cost = conv._whole(codes)
        assert (cost, "".join(letters)) == best(tuple(roles), tuple(faults))
        through = conv.transfer(codes)
        assert min(through[t] + c for t, c in enumerate(conv._NO_DOUBT)) == cost
