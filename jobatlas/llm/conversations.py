"""Repair of conversation structure by a checkpointed dynamic program over blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobatlas.llm.common import Memo, map_batches, read_table, save

#: Turns and bytes of text after which a block ends; conversations within one block need no further step.
BLOCK_TURNS, BLOCK_BYTES = 4096, 4 << 20
#: Characters of role and text that order equal turns across range partitions.
TIE_CHARACTERS = 64
#: Costs: another role, a turn deleted, a turn inserted, a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"

# A turn's code is 4 * fault + kind.  Kinds: system, user, assistant, other.  Faults: none, blank, duplicate, truncated.
_KINDS = {"s": 0, "u": 1, "a": 2}
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
# States: nothing yet, after system, after user, after assistant.  A conversation may end in the first and the last.
_SPOKEN = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: The state after the role that may be inserted or given in each state, and that role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_NO_DOUBT = (0, 4, 2, 0)

Costs = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> list[int]:
    """Costs with turns inserted first; two in a row reach every state that any number reaches."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def _choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that take up a turn, in ASCII order."""
    fault, kind = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED * (fault == CUT_SHORT)
    if (state, kind) in _SPOKEN:
        out.append(("K", more, _SPOKEN[state, kind]))
    out.append(("R", REROLE + more, _NEXT[state]))
    return out


def _backward(step: tuple[int, Costs]) -> tuple[Costs, int]:
    """Costs before a turn out of those after it, less their least, and that least."""
    code, after = step
    costs = _inserted([min(c + after[n] for _, c, n in _choices(code, s)) for s in range(4)])
    least = min(costs)
    return tuple(min(c - least, _FAR) for c in costs), least


def _forward(step: tuple[int, int, Costs]) -> tuple[str, int]:
    """Letters at a turn in a state, with the costs after it, and the next state: the ASCII-least tight edits."""
    state, code, after = step
    letters = ""
    while True:
        costs = _inserted([min(c + after[n] for _, c, n in _choices(code, s)) for s in range(4)])
        options = [(x, c + after[n], n) for x, c, n in _choices(code, state)]
        options.append(("I", INSERT + costs[_NEXT[state]], -1))
        letter, _, target = min(o for o in options if o[1] == costs[state])
        letters += letter
        if letter != "I":
            return letters, target
        state = _NEXT[state]


_backward_of, _forward_of = Memo(_backward, 50_000), Memo(_forward, 50_000)


def checkpoints(codes: bytes, after: Costs) -> tuple[list[tuple[int, Costs]], Costs, int]:
    """(turn, costs before it) about every square root of the turns, the costs before all, and what was taken off."""
    step, costs, total = max(1, isqrt(len(codes))), after, 0
    kept = [(len(codes), after)]
    for i in range(len(codes) - 1, -1, -1):
        costs, least = _backward_of[codes[i], costs]
        total += least
        if i % step == 0:
            kept.append((i, costs))
    return kept[::-1], costs, total


def edits(codes: bytes, after: Costs, state: int = 0) -> tuple[list[str], int]:
    """Letters at each turn along the ASCII-least tight path from ``state``, and the state after the turns.

    Costs are kept at checkpoints only; walking forward, those of one stretch at a time are computed anew.
    """
    kept, _, _ = checkpoints(codes, after)
    out: list[str] = []
    for (low, _), (high, costs) in zip(kept, kept[1:], strict=False):
        stretch = [costs]
        for i in range(high - 1, low, -1):
            stretch.append(_backward_of[codes[i], stretch[-1]][0])
        for i in range(low, high):
            letters, state = _forward_of[state, codes[i], stretch[high - 1 - i]]
            out.append(letters)
    return out, state


def last_edits(state: int) -> str:
    """Turns inserted at the end."""
    return "I" * (_NO_DOUBT[state] // INSERT)


def transfer(codes: bytes) -> list[int]:
    """Cheapest costs through the turns from each state to each, row by row."""
    out = [[_FAR] * 4 for _ in range(4)]
    for to in range(4):
        _, costs, total = checkpoints(codes, tuple(0 if s == to else _FAR for s in range(4)))
        for s in range(4):
            out[s][to] = min(costs[s] + total, _FAR)
    return [c for row in out for c in row]


def _whole(codes: bytes) -> tuple[tuple[str, ...], int]:
    """Letters at each turn, those at the end as a last item, and the cost of a whole conversation."""
    letters, state = edits(codes, _NO_DOUBT)
    _, costs, total = checkpoints(codes, _NO_DOUBT)
    return (*letters, last_edits(state)), costs[0] + total


_whole_of = Memo(_whole, 50_000)


def repaired(letters: list[str], state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that edits make of turns; a last item of ``letters`` beyond the turns is inserted at the end."""
    new_roles: list[str] = []
    new_texts: list[str] = []
    for i, group in enumerate(letters):
        for letter in group:
            if letter == "D":
                continue
            if letter == "K":
                role, target = roles[i], _SPOKEN[state, _KINDS[roles[i][0]]]
            else:
                role, target = _ROLE[state], _NEXT[state]
            new_roles.append(role)
            new_texts.append("" if letter == "I" else texts[i])
            state = target
    return new_roles, new_texts


def _kind(role: str) -> int:
    return _KINDS.get(role[:1], 3)


def _illegal(kinds: bytes) -> int:
    """Neighbours other than system-user, user-assistant and assistant-user."""
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:], strict=False))


_BLOCK = (
    "conv_id long, part int, block int, whole boolean, turns array<long>, roles array<string>, texts array<string>, faults binary, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, new_roles array<string>, new_texts array<string>"
)
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _blocks(batches: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    """Blocks of turns out of sorted rows (conv_id, turn, role, text, fault; role null: no turn, only its conversation).

    A conversation that neither begins nor ends the partition and fills one block is repaired here.  At most the blocks
    being filled and BLOCK_BYTES of finished ones are held.
    """
    part, number, weight = TaskContext.get().partitionId(), 0, 0
    out: list[dict] = []
    block: dict | None = None
    edge, size = True, 0

    def put(last: bool) -> None:
        """Finish the current block; ``last``: whether its conversation may go on after it."""
        nonlocal number, weight
        whole = not edge and not last
        block.update(block=number, whole=whole, faults=bytes(block["faults"]))
        number, weight = number + 1, weight + size + 200
        if whole:
            _repair_whole(block)
        out.append(block)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
        for conv, turn, role, text, fault in zip(*columns, strict=True):
            same = block is not None and conv == block["conv_id"]
            full = same and (len(block["roles"]) >= block_turns or size >= BLOCK_BYTES)
            if block is None or full or not same:
                if block is not None:
                    put(full)
                    # The next block is at an edge if it goes on with a conversation that was cut.
                    edge = full
                block, size = {"conv_id": conv, "part": part, "turns": [], "roles": [], "texts": [], "faults": bytearray()}, 0
                if weight > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow_block())
                    out, weight = [], 0
            if role is not None:
                block["turns"].append(turn)
                block["roles"].append(role)
                block["texts"].append(text)
                block["faults"].append(fault)
                size += len(text)
    if block is not None:
        put(True)
        yield pa.RecordBatch.from_pylist(out, schema=_arrow_block())


def _arrow_block() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _BLOCK.split(", ")])


def _repair_whole(b: dict) -> None:
    """Figures, edits and repaired turns of a conversation in one block; the given turns are let go."""
    seen: set[tuple[str, str]] = set()
    codes, counts = bytearray(), [0, 0, 0, 0]
    for role, text, fault in zip(b["roles"], b["texts"], b["faults"], strict=True):
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        counts[fault] += 1
        codes.append(4 * fault + _kind(role))
    known = [t for t in b["turns"] if t is not None]
    b["gaps"] = max(known) - min(known) + 1 - len(set(known)) if known else 0
    b["blank"], b["duplicate"], b["truncated"] = counts[1:]
    b["illegal"] = _illegal(bytes(c % 4 for c in codes))
    letters, b["cost"] = _whole_of[bytes(codes)]
    b["audit"] = "".join(letters)
    b["new_roles"], b["new_texts"] = repaired(letters, 0, b["roles"], b["texts"])
    b["turns"] = b["roles"] = b["texts"] = b["faults"] = None


def _streamed(df: DataFrame, function, schema: str, *order: Column) -> DataFrame:
    """Rows of each conversation in ``order`` through ``function(rows)``, an iterator that keeps a few numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _backward_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each block, from the last block of a conversation to its first (rows sorted so)."""
    conv, costs, started = None, _NO_DOUBT, False
    for batch in batches:
        after, before = [], []
        for c, through in zip(batch.column("conv_id").to_pylist(), batch.column("through").to_pylist(), strict=True):
            if not started or c != conv:
                conv, costs, started = c, _NO_DOUBT, True
            after.append(list(costs))
            costs = tuple(min(through[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
            before.append(costs[0])
        kept = [batch.column(c) for c in ("conv_id", "part", "block")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(after, pa.list_(pa.int64())), pa.array(before, pa.int64())], ["conv_id", "part", "block", "after", "before"])


def _forward_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each block, from the first to the last; illegal neighbours across blocks; which block is the last."""
    conv, state, kind, started = None, 0, -1, False
    for batch in batches:
        states, across = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "leads", "first_kind", "last_kind")]
        for c, leads, low, high in zip(*columns, strict=True):
            if not started or c != conv:
                conv, state, kind, started = c, 0, -1, True
            states.append(state)
            across.append(int(kind >= 0 and low >= 0 and _illegal(bytes([kind, low]))))
            state = leads[state]
            kind = high if high >= 0 else kind
        kept = [batch.column(c) for c in ("conv_id", "part", "block")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(states, pa.int32()), pa.array(across, pa.int64())], ["conv_id", "part", "block", "state", "across"])


def _same(a: str, b: str, *more: str) -> Column:
    out = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in more:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _relative(costs: list[int]) -> Costs:
    least = min(costs)
    return tuple(min(c - least, _FAR) for c in costs)


def _mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Codes of the turns of a block and its costs from state to state."""
    rows = []
    for conv, part, block, roles, faults, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "block", "roles", "faults", "firsts")), strict=True):
        new = set(first or ())
        codes = bytes(4 * (DUPLICATE if f != BLANK and i not in new else f) + _kind(r) for i, (r, f) in enumerate(zip(roles, faults, strict=True)))
        counts = np.bincount(np.frombuffer(codes, dtype=np.uint8) // 4, minlength=4)
        kinds = bytes(c % 4 for c in codes)
        rows.append({
            "conv_id": conv, "part": part, "block": block, "codes": codes, "through": transfer(codes), "blank": counts[1], "duplicate": counts[2], "truncated": counts[3],
            "illegal": _illegal(kinds), "first_kind": kinds[0] if kinds else -1, "last_kind": kinds[-1] if kinds else -1,
        })
    kinds_of = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("codes", pa.binary()), ("through", pa.list_(pa.int64()))]
    kinds_of += [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")] + [(c, pa.int32()) for c in ("first_kind", "last_kind")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds_of))


def _lead(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Where the tight edits of a block lead from each state."""
    leads = [[edits(codes, _relative(after), s)[1] for s in range(4)] for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True)]
    return batch.append_column("leads", pa.array(leads, pa.list_(pa.int32())))


def _walk(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Edits and repaired turns of a block whose first state and costs behind are known."""
    rows = []
    names = ("conv_id", "part", "block", "roles", "texts", "codes", "after", "state", "ends")
    for conv, part, block, roles, texts, codes, after, state, ends in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        letters, last = edits(codes, _relative(after), state)
        if ends:
            letters.append(last_edits(last))
        new_roles, new_texts = repaired(letters, state, roles, texts)
        rows.append({"conv_id": conv, "part": part, "block": block, "audit": "".join(letters), "new_roles": new_roles, "new_texts": new_texts})
    kinds = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("audit", pa.string()), ("new_roles", pa.list_(pa.string())), ("new_texts", pa.list_(pa.string()))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def repair_conversations(turns: DataFrame, dropped: str | None = None, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """Repair of every conversation in ``turns`` (conv_id, turn, role, text, ...).

    Returns two tables.  Reports, one row each: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Repaired turns, in blocks: conv_id, part, block (their order), new_roles, new_texts, whole (a block is all there is).

    Turns are taken by turn number, nulls first, equal numbers by role and text.  A null role or text is one space.  Rows
    where the column named by ``dropped`` is true are no turns, but their conversations are reported.  Edits are the
    cheapest that give the roles ``(s?(ua)+)?``, the ASCII-least of them.

    Turns are range partitioned by conversation and order and cut into blocks, so a conversation of any length is
    spread over tasks.  Whole conversations in a block are repaired there.  Of others, each block yields its cheapest
    costs from state to state; a running scan over these few rows, backwards, leaves the costs after each block, the
    checkpoints; from them every block finds by itself where its tight edits lead; a scan forward tells the state each
    block begins in; blocks then recompute their costs, between checkpoints of their own, and emit the edits.
    First occurrences are found by an aggregation on the content, wherever its turns lie.

    Empty and long texts are turns like others; repeated rows are duplicates of the first; extra columns are ignored;
    an empty table gives two empty ones.
    """
    blocks = save(_cut(turns, dropped, block_turns))
    whole = blocks.where("whole")
    open_ = blocks.where("not whole").select("conv_id", "part", "block", "turns", "roles", "texts", "faults")
    at = F.struct("part", "block", "i")
    each = open_.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "t"))
    content = F.sha2(F.concat(F.octet_length("t.roles").cast("string"), F.lit(":"), F.col("t.roles"), F.col("t.texts")).cast("binary"), 256)
    first = each.groupBy("conv_id", content.alias("content")).agg(F.min(at).alias("at"))
    firsts = first.groupBy("conv_id", "at.part", "at.block").agg(F.collect_list("at.i").alias("firsts"))
    light = open_.select("conv_id", "part", "block", "roles", "faults").alias("o").join(firsts.alias("f"), _same("o", "f", "part", "block"), "left")
    mark = "conv_id long, part int, block int, codes binary, through array<long>, blank long, duplicate long, truncated long, illegal long, first_kind int, last_kind int"
    marked = save(map_batches(light.select("o.*", "f.firsts"), _mark, mark))
    order = [F.col("part"), F.col("block")]
    down = [c.desc() for c in order]
    after = save(_streamed(marked.select("conv_id", "part", "block", "through"), _backward_scan, "conv_id long, part int, block int, after array<long>, before long", *down))
    known = marked.alias("m").join(after.alias("a"), _same("m", "a", "part", "block")).select("m.conv_id", "m.part", "m.block", "codes", "after", "first_kind", "last_kind")
    led = map_batches(known, _lead, "conv_id long, part int, block int, codes binary, after array<long>, first_kind int, last_kind int, leads array<int>")
    states = save(_streamed(led.drop("codes", "after"), _forward_scan, "conv_id long, part int, block int, state int, across long", *order))
    final = marked.groupBy("conv_id").agg(F.max(F.struct("part", "block")).alias("end"))
    walk = open_.alias("o").join(known.alias("k"), _same("o", "k", "part", "block")).join(states.alias("s"), _same("o", "s", "part", "block")).join(final.alias("e"), _same("o", "e"))
    ends = F.col("end").eqNullSafe(F.struct(F.col("o.part").alias("part"), F.col("o.block").alias("block")))
    walked = walk.select("o.conv_id", "o.part", "o.block", "roles", "texts", "codes", "after", "state", ends.alias("ends"))
    walked = save(map_batches(walked, _walk, "conv_id long, part int, block int, audit string, new_roles array<string>, new_texts array<string>"))

    number = open_.select("conv_id", F.explode("turns").alias("turn")).groupBy("conv_id", "turn").count()
    gaps = number.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    sums = marked.alias("m").join(states.alias("s"), _same("m", "s", "part", "block")).join(after.alias("a"), _same("m", "a", "part", "block"))
    sums = sums.groupBy("m.conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("across")).alias("illegal"),
        F.min_by("before", F.struct("m.part", "m.block")).alias("cost"),
    )
    audits = walked.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x.audit), "").alias("audit"))
    pieced = sums.alias("s").join(gaps.alias("g"), _same("s", "g"), "left").join(audits.alias("a"), _same("s", "a"))
    pieced = pieced.select("s.conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *[f"s.{c}" for c in _FIGURES[1:]], "audit")
    reports = whole.select("conv_id", *_FIGURES, "audit").unionByName(pieced)
    kept = ("conv_id", "part", "block", "new_roles", "new_texts")
    return reports, whole.select(*kept, F.lit(True).alias("whole")).unionByName(walked.select(*kept, F.lit(False).alias("whole")))


def _cut(turns: DataFrame, marker: str | None, block_turns: int) -> DataFrame:
    """Blocks of the turns, in order within range partitions."""
    dropped = F.coalesce(F.col(marker), F.lit(False)) if marker else F.lit(False)
    role, text = (F.when(~dropped, F.coalesce(F.col(c).cast("string"), F.lit(" "))) for c in ("role", "text"))
    rows = turns.select("conv_id", F.when(~dropped, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    tie = F.concat_ws(":", "role", "text")
    rows = rows.withColumn("fault", F.coalesce(fault, F.lit(0)).cast("int"))
    # Equal short rows may be dealt to several partitions: they are alike, so their order is of no matter.
    salt = F.when(F.length(tie) <= TIE_CHARACTERS, F.xxhash64(F.monotonically_increasing_id())).otherwise(0)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left(tie, F.lit(TIE_CHARACTERS)), "salt"]
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), tie, "salt"]
    dealt = rows.withColumn("salt", salt).repartitionByRange(*keys).sortWithinPartitions(*order)
    return dealt.drop("salt").mapInArrow(lambda batches: _blocks(batches, block_turns), _BLOCK)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the turns of each conversation, whose blocks come in order."""
    conv, state, started, any_turn = None, None, False, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for c, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "new_roles", "new_texts")), strict=True):
            if not started or c != conv:
                if started:
                    yield row()
                conv, state, started, any_turn = c, hashlib.sha256(), True, False
            for role, text in zip(roles, texts, strict=True):
                state.update(("\n" * any_turn + f"{role}:{text}").encode())
                any_turn = True
    if started:
        yield row()


def repaired_digests(blocks: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns: ``role:text`` joined by newlines.

    A digest is made of the text from its first byte to its last; blocks of a long conversation pass in order, each
    held alone.
    """
    lines = F.transform(F.arrays_zip("new_roles", "new_texts"), lambda t: F.concat(t.new_roles, F.lit(":"), t.new_texts))
    whole = blocks.where("whole").select("conv_id", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    return whole.unionByName(_streamed(blocks.where("not whole").drop("whole"), _hashed, "conv_id long, repaired_sha256 string", F.col("part"), F.col("block")))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn`` (nulls: one space); extra columns go.

    Of 20 remainders, 0 drops a turn (its row stays with ``dropped``), 1 empties its text, 2 takes off ``.!?``, 3 repeats
    it and 4 makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("lot"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("lot") == 0).alias("dropped"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark, sf_dir) -> DataFrame:
    """The contract query over all conversations."""
    reports, blocks = repair_conversations(damaged(read_table(spark, sf_dir, "conversations")), "dropped")
    digests = repaired_digests(blocks)
    joined = reports.alias("r").join(digests.alias("d"), _same("r", "d"))
    return joined.select("r.conv_id", *[f"r.{c}" for c in _FIGURES], "r.audit", "d.repaired_sha256")


def _sql() -> str:
    """Plain twin: one recursion over the turns, backwards, holding cost and audit of each state as a string."""

    def add(value: str, cost: str, letters: str) -> str:
        return f"lpad((left({value}, 9)::bigint + {cost})::varchar, 9, '0') || '{letters}' || substr({value}, 10)"

    def taken(state: int) -> str:
        keep = " ".join(f"WHEN kind = '{'sua'[k]}' THEN {add(f'v{n}', 't', 'K')}" for (s, k), n in _SPOKEN.items() if s == state)
        stay = f"CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE least(CASE {keep} ELSE 'x' END, {add(f'v{_NEXT[state]}', 't + 2', 'R')}) END"
        return f"least({add(f'v{state}', '3', 'D')}, {stay}) AS w{state}"

    crc = (
        "xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split("
        "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), "
        "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    )
    inserted = {0: ["w0", add("w2", "2", "I"), add("w3", "4", "II")], 1: ["w1", add("w2", "2", "I"), add("w3", "4", "II")], 2: ["w2", add("w3", "2", "I")], 3: ["w3", add("w2", "2", "I")]}
    closed = ", ".join(f"least({', '.join(options)}) AS v{s}" for s, options in inserted.items())
    return f"""WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS lot FROM conversations),
turns AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy FROM lots WHERE lot <> 0)),
numbered AS (
  SELECT *, left(role, 1) AS kind, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text)),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    coalesce(prior || kind NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM numbered),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM marked GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3 FROM figures
  UNION ALL
  SELECT conv_id, i - 1, {closed} FROM (
    SELECT conv_id, i, {", ".join(map(taken, range(4)))} FROM (
      SELECT d.*, m.kind, m.fault, (m.fault = 'truncated')::bigint AS t FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i))),
best AS (SELECT conv_id, left(v0, 9)::bigint AS cost, substr(v0, 10) AS audit FROM dp WHERE i = 0),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''),
placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
spoken AS (
  SELECT p.*, m.role, m.text, max((p.j = 1 AND letter = 'K' AND kind = 's')::int) OVER (PARTITION BY p.conv_id) AS head
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i AND letter <> 'I'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text
  FROM spoken WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(s.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP11_SQL = _sql()
