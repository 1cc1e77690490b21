"""Session profiles: the ordered merge of turn signals and explicit edits.

``apply_event`` is the small state step shared by the batch fold and the stateful stream; the ledger module has its
rules.  It only merges values that Spark columns have already extracted from the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from jobatlas.functions.turns import SIGNAL_COLUMNS, turn_signals
from jobatlas.operators.ledger import QUOTE_CHARS, completeness, edit_rows, new_ledger, notes_of, step_phase, turn_rows, write

SNAPSHOT = (
    "session_id string, seq long, turn long, journey_mode string, phase string, done boolean, changed boolean, "
    "education_stage string, job_goal string, dimensions map<string,double>, "
    "skills array<struct<name:string,level:string,source_quote:string>>, interests array<string>, "
    "experiences array<struct<title:string,kind:string,description:string,skills:array<string>,source_quote:string>>, "
    "constraints struct<region_pref:string,study_budget:string,study_duration_pref:string,notes:string>, "
    "completeness double, quote string, mapped_to string"
)


def apply_event(state: dict | None, event: dict) -> tuple[dict, bool]:
    """One event on the ledger: ``(ledger, changed)``.  The mode is that of the first event."""
    ledger = new_ledger(event["journey_mode"] or "explore") if state is None else state
    if event.get("patch"):
        for row in edit_rows(json.loads(event["patch"])):
            write(ledger, row)
        ledger["completeness"] = completeness(ledger, False)
        return ledger, True
    opens = event["opening"]
    if (opens and ledger["turn"] > 0) or not (opens or event["meaningful"]):
        return ledger, False
    ledger["turn"] += 1
    if not opens:
        ledger["in_phase"] += 1
        ledger["declined"] |= bool(ledger["phase"] == "constraints" and event["declines"])
        for row in turn_rows(ledger, event):
            write(ledger, row)
    ledger["completeness"] = completeness(ledger, ledger["declined"])
    if not opens:
        step_phase(ledger, bool(event["wants_results"]), bool(event["wants_done"]))
    return ledger, True


def snapshot(session_id: str, seq: int, ledger: dict, event: dict, changed: bool) -> dict:
    """Profile after an event; the quote is that of an effective turn."""
    spoke = changed and not event.get("patch") and not event["opening"] and not event["injection"]
    slot = {f: v[0] for f, v in ledger["slots"].items()}
    items = {f: list(v.values()) for f, v in ledger["items"].items()}
    return {
        "session_id": session_id, "seq": seq, "turn": ledger["turn"], "journey_mode": ledger["mode"], "phase": ledger["phase"],
        "done": ledger["done"], "changed": changed, "education_stage": slot["education"], "job_goal": slot["goal"],
        "dimensions": {d: v[0] for d, v in ledger["levels"].items()}, **items,
        "constraints": {"region_pref": slot["region"], "study_budget": slot["budget"], "study_duration_pref": slot["duration"], "notes": notes_of(ledger)},
        "completeness": ledger["completeness"], "quote": event["text"][:QUOTE_CHARS] if spoke else None,
        "mapped_to": next(iter(event["dims_hit"]), "interests") if spoke else None,
    }


EVENT_COLUMNS = ("session_id", "seq", "journey_mode", "patch", *SIGNAL_COLUMNS)


def as_event(row: dict) -> dict:
    """Arrow row to plain Python values; missing text becomes empty, missing slots null."""
    out = {}
    for k, v in row.items():
        if isinstance(v, float) and v != v or v is pd.NaT:
            v = None
        out[k] = list(v) if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0) == 1 else v
    for k in ("dims_hit", "dims_mentioned", "tools", "exp_tools", "skills_mentioned", "words"):
        out[k] = list(out[k]) if out.get(k) is not None else []
    out["text"] = out["text"] or ""
    return out


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold rows that arrive grouped by session and ordered inside it; only one state is held."""
    current, state = None, None
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            event = as_event(row)
            if event["session_id"] != current:
                current, state = event["session_id"], None
            state, changed = apply_event(state, event)
            rows.append(snapshot(current, event["seq"], state, event, changed))
        yield pd.DataFrame(rows)


def session_events(turns: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Signals of ``session_id, seq, journey_mode, text`` turns, with ``session_id, seq, patch`` edits merged in."""
    events = turns.select("session_id", "seq", "journey_mode", "text").withColumn("patch", F.lit(None).cast("string"))
    if patches is not None:
        events = events.unionByName(patches.select(
            "session_id", "seq", F.lit(None).cast("string").alias("journey_mode"), F.lit("").alias("text"), "patch"
        ))
    return turn_signals(events).select(*EVENT_COLUMNS)


def fold_sessions(turns: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Profile snapshot after every event of every session.

    Text work runs in parallel before the shuffle.  The ordered merge streams each
    partition, sorted by session and sequence, through Arrow batches and keeps the state
    of the session at hand only, so a very long session never has to fit in memory.
    """
    events = session_events(turns, patches)
    return events.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(_fold_batches, SNAPSHOT)


def latest_profiles(snapshots: DataFrame) -> DataFrame:
    """Last snapshot of each session, without its quote."""
    body = F.struct(*[c for c in snapshots.columns if c not in ("session_id", "quote", "mapped_to", "changed")])
    return snapshots.groupBy("session_id").agg(F.max_by(body, "seq").alias("p")).select("session_id", "p.*")


def evidence_quotes(snapshots: DataFrame) -> DataFrame:
    """Long table of evidence quotes, one per effective turn."""
    return snapshots.where(F.col("quote").isNotNull()).select("session_id", "turn", "quote", "mapped_to")


def profile_diff(before: DataFrame, after: DataFrame, key: str = "session_id", epsilon: float = 0.01) -> DataFrame:
    """What a newer snapshot adds: moved dimensions, new skills, interests and experiences."""
    old = before.select(key, F.struct("dimensions", "skills", "interests", "experiences").alias("o"))
    joined = after.join(old, key, "left")
    empty = F.array().cast("array<string>")

    def added(new: Column, prior: Column) -> Column:
        return F.array_except(new, F.coalesce(prior, empty))

    moved = F.map_filter(
        "dimensions",
        lambda k, v: F.abs(v - F.coalesce(F.try_element_at(F.col("o.dimensions"), k), F.lit(0.0))) >= epsilon,
    )
    return joined.select(
        key, F.map_keys(moved).alias("changed_dimensions"),
        added(F.transform("skills", lambda s: s["name"]), F.transform("o.skills", lambda s: s["name"])).alias("added_skills"),
        added(F.col("interests"), F.col("o.interests")).alias("added_interests"),
        added(F.transform("experiences", lambda e: e.title), F.transform("o.experiences", lambda e: e.title)).alias("added_experiences"),
    )


def missing_slots(mode: Column, n_interests: Column, n_skills: Column, n_experiences: Column, complete: Column) -> Column:
    """Slots the profile still lacks, by mode."""
    launch = F.array(
        F.when(n_skills < 2, "sourced_skills"), F.when(n_experiences < 1, "experiences_or_none"),
        F.when(complete < 0.5, "job_goal_or_constraints"),
    )
    explore = F.array(
        F.when(n_interests < 2, "interests"), F.when(n_skills < 2, "sourced_skills"), F.when(complete < 0.4, "constraints")
    )
    return F.array_compact(F.when(mode == "launch", launch).otherwise(explore))


def trailing_messages(messages: DataFrame, key: str = "session_id", order: str = "turn", size: int = 16) -> DataFrame:
    """Trailing frames per message: the kept window, the last eight and the last four assistant turns."""
    w = W.partitionBy(key).orderBy(order)

    def last(n: int, column: Column) -> Column:
        return F.collect_list(column).over(w.rowsBetween(-(n - 1), 0))

    said = messages.where(F.col("role") == "assistant")
    recent = said.select(key, order, last(4, F.col(order)).alias("last_assistant"))
    framed = messages.select(
        key, order, "role", last(size, F.col(order)).alias("kept"), last(8, F.col(order)).alias("history")
    )
    return framed.join(recent, [key, order], "left")


def dimension_strength(turns: DataFrame) -> DataFrame:
    """Closed form of keyword dimensions without corrections: k matching turns give 0.55, 0.70, then 0.80."""
    hits = turns.select("session_id", F.explode("dims_hit").alias("dimension")).groupBy("session_id", "dimension").agg(
        F.count(F.lit(1)).alias("k")
    )
    return hits.withColumn("strength", F.round(F.least(F.lit(0.8), 0.55 + 0.15 * (F.col("k") - 1)), 2))
