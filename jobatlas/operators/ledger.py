"""Profile ledger: every turn or edit becomes rows of one form, and one rule per field kind decides what they change.

A row is ``(field, action, value, authority)``.  Said things have authority SAID, explicit edits EDIT.  A field is a
*slot* (one value, the last writer of the highest authority so far wins), a *list* (items by key, with tombstones that
only an edit lifts) or a *level* (a number that rises, may be taken back, and stands once an edit has set it).  The
phases of a session follow from two tables.
"""

from __future__ import annotations

import re

from jobatlas.functions.scoring import DIMENSIONS
from jobatlas.functions.text import py_fold
from jobatlas.functions.turns import INTEREST_STOPWORDS

# Fixed values.
PHASES = ("warmup", "interests", "abilities", "constraints", "wrapup")
MENTIONED = "đã đề cập"
NO_EXPERIENCE_NOTE = "chưa có thực tập/project — explicit no experience"
NONE_YET = "chưa"
RESET_VALUE = 0.15
LEAST_HIT, HIT_STEP, MOST_HIT = 0.55, 0.15, 0.8
ACTIVE = 0.05
MAX_EXPERIENCES = 3
QUOTE_CHARS, DESCRIPTION_CHARS = 240, 200
LONG_TURNS, LAST_TURN = 10, 12
RESULTS_FROM = 0.5

SAID, EDIT = 1, 2
SLOTS = ("education", "goal", "region", "budget", "duration")
LISTS = {"skills": None, "interests": None, "experiences": MAX_EXPERIENCES}
_STOP = frozenset(py_fold(w) for w in INTEREST_STOPWORDS)

#: Share of each part of a complete profile: the measure and the count at which it is full.
COMPLETE = {
    "launch": (("stage", 1), ("aim", 1), ("practice", 1), ("sourced", 2), ("limits", 1)),
    "explore": (("interests", 2), ("active", 2), ("sourced", 2), ("limits", 1)),
}
#: When a phase is over: turns at least, measures that must be reached, turns that suffice without them.
PHASE_ENDS = {
    ("warmup", None): (1, (), 1),
    ("interests", "launch"): (1, (("subject", 1),), 2),
    ("interests", "explore"): (1, (("interests", 2), ("active", 1)), 3),
    ("abilities", None): (0, (("sourced", 2),), 3),
    ("constraints", None): (0, (("limits", 1),), 2),
}

Row = tuple[str, str, object, int]


def new_ledger(mode: str) -> dict:
    """Empty ledger, made of plain values so that it can be stored as JSON."""
    return {
        "mode": mode, "phase": "warmup", "turn": 0, "in_phase": 0, "done": False, "declined": False, "completeness": 0.0, "notes": [],
        "slots": {f: [None, 0] for f in SLOTS}, "items": {f: {} for f in LISTS}, "gone": {f: {} for f in LISTS},
        "levels": {d: [0.0, False] for d in DIMENSIONS},
    }


def words_of(label: str) -> set[str]:
    """Words of a label that tell interests apart."""
    return {w for w in re.findall(r"[a-z]+", py_fold(label)) if w not in _STOP and len(w) >= 2}


def same_interest(candidate: str, removed: str) -> bool:
    """Whether a removed interest covers a candidate: all its words, or the whole label if it has none."""
    gone = words_of(removed)
    return gone <= words_of(candidate) if gone else py_fold(candidate).strip() == py_fold(removed).strip()


def _covered(field: str, label: str, tombstone: str) -> bool:
    if field == "interests" and same_interest(label, tombstone):
        return True
    return label.lower() == tombstone.lower()


def _name(item) -> str:
    return item if isinstance(item, str) else item.get("name") or item["title"]


def write(ledger: dict, row: Row) -> None:
    """Apply one row."""
    field, action, value, authority = row
    if field == "notes":
        ledger["notes"].append(value)
    elif field in ledger["slots"]:
        slot = ledger["slots"][field]
        if authority >= slot[1] and (value is not None or authority == EDIT):
            ledger["slots"][field] = [value, authority if authority == EDIT else slot[1]]
    elif field == "levels":
        name, level = value
        held = ledger["levels"][name]
        if action == "set":
            ledger["levels"][name] = [level, True]
        elif action == "reset":
            ledger["levels"][name] = [level, False]
        elif not held[1]:
            held[0] = max(held[0], level)
    else:
        items, gone, label = ledger["items"][field], ledger["gone"][field], _name(value)
        if action == "drop":
            gone[label.lower()] = label
            items.pop(label.strip().lower(), None)
            return
        if authority == SAID and any(_covered(field, label, t) for t in gone.values()):
            return
        most = LISTS[field]
        if label.lower() not in items and (most is None or len(items) < most):
            items[label.lower()] = value
        if authority == EDIT:
            ledger["gone"][field] = {k: t for k, t in gone.items() if not _covered(field, label, t)}


def corrections(ledger: dict, signal: dict) -> list[Row]:
    """Rows by which a turn with a negation takes back what the ledger holds."""
    if not signal["negation"]:
        return []
    named, words = set(signal["skills_mentioned"]), set(signal["words"])
    back: list[Row] = [("skills", "drop", s["name"], SAID) for s in ledger["items"]["skills"].values() if s["name"] in named]
    back += [("interests", "drop", i, SAID) for i in ledger["items"]["interests"].values() if words_of(i) & words]
    return back + [("levels", "reset", (d, RESET_VALUE), SAID) for d in signal["dims_mentioned"] if ledger["levels"].get(d, [0.0])[0] > 0.0]


def turn_rows(ledger: dict, signal: dict) -> list[Row]:
    """Rows of one turn: what it says, then what it takes back."""
    phase, launch, text = ledger["phase"], ledger["mode"] == "launch", signal["text"]
    quote, tools = text[:QUOTE_CHARS], list(signal["tools"])
    rows: list[Row] = [(f, "put", signal[f], SAID) for f in ("education", "region", "budget")]
    if launch:
        if phase != "abilities" or signal["goal_intent"]:
            rows.append(("goal", "put", signal["goal"] or None, SAID))
        if signal["no_experience"]:
            # Both readings of a turn, without and with the profile in view, leave the note.
            rows += [("notes", "put", NO_EXPERIENCE_NOTE, SAID)] * 2
        elif signal["exp_title"]:
            tools = [*signal["exp_tools"], *tools]
            if quote.strip():
                rows.append(("experiences", "put", {
                    "title": signal["exp_title"], "kind": signal["exp_kind"], "description": text[:DESCRIPTION_CHARS],
                    "skills": list(signal["exp_tools"]), "source_quote": quote,
                }, SAID))
    if text.strip():
        rows += [("skills", "put", {"name": t, "level": MENTIONED, "source_quote": quote}, SAID) for t in tools]
    label = (signal["label"] or "").strip()
    talks = phase in ("warmup", "interests", "constraints") or (phase == "abilities" and not signal["ability"])
    if label and talks and not signal["injection"]:
        rows.append(("interests", "put", label, SAID))
    back = corrections(ledger, signal)
    reset = {r[2][0] for r in back if r[0] == "levels"}
    if not signal["injection"]:
        for d in signal["dims_hit"]:
            step = 0.0 if d in reset else ledger["levels"][d][0] + HIT_STEP
            rows.append(("levels", "raise", (d, min(MOST_HIT, max(LEAST_HIT, step))), SAID))
    return rows + back


def edit_rows(patch: dict) -> list[Row]:
    """Rows of an explicit edit. A slot that is named counts even when its value is null."""
    rows: list[Row] = [("levels", "set", (d, max(0.0, min(1.0, float(v)))), EDIT) for d, v in (patch.get("dimensions") or {}).items() if d in DIMENSIONS]
    rows += [("skills", "drop", x, EDIT) for x in patch.get("remove_skills") or []]
    rows += [("interests", "put", x.strip(), EDIT) for x in patch.get("add_interests") or [] if x.strip()]
    rows += [("interests", "drop", x, EDIT) for x in patch.get("remove_interests") or [] if x.strip()]
    rows += [(slot, "put", patch[key], EDIT) for key, slot in (("education_stage", "education"), ("job_goal", "goal")) if key in patch]
    rows += [("experiences", "drop", x, EDIT) for x in patch.get("remove_experience_titles") or []]
    blank = {"kind": "other", "description": "", "skills": [], "source_quote": ""}
    return rows + [("experiences", "put", {"title": x["title"]} | {k: x.get(k) or v for k, v in blank.items()}, EDIT) for x in patch.get("add_experiences") or []]


def notes_of(ledger: dict) -> str:
    return "; ".join(ledger["notes"])


def measures(ledger: dict, declined: bool) -> dict[str, float]:
    """Counts that completeness and phases are read from."""
    slot = {f: v[0] for f, v in ledger["slots"].items()}
    items, notes = ledger["items"], notes_of(ledger)
    none_yet = NONE_YET in notes.lower()
    return {
        "stage": bool(slot["education"]), "aim": bool(slot["goal"] or none_yet), "subject": len(items["interests"]) + bool(slot["goal"]),
        "practice": 1.0 if items["experiences"] else 0.5 * none_yet, "interests": len(items["interests"]),
        "sourced": sum(bool(s["source_quote"].strip()) for s in items["skills"].values()),
        "active": sum(v[0] > ACTIVE for v in ledger["levels"].values()),
        "limits": bool(declined or slot["region"] or slot["budget"] or slot["duration"] or notes.strip()),
    }


def completeness(ledger: dict, declined: bool) -> float:
    have, parts = measures(ledger, declined), COMPLETE["launch" if ledger["mode"] == "launch" else "explore"]
    return round(sum(min(1.0, have[m] / full) for m, full in parts) / len(parts), 2)


def phase_over(ledger: dict) -> bool:
    """Whether the table lets the session leave its phase."""
    mode = "launch" if ledger["mode"] == "launch" else "explore"
    least, needs, enough = PHASE_ENDS.get((ledger["phase"], mode)) or PHASE_ENDS[(ledger["phase"], None)]
    have, n = measures(ledger, ledger["declined"]), ledger["in_phase"]
    return n >= enough or (n >= least and all(have[m] >= k for m, k in needs))


def step_phase(ledger: dict, wants_results: bool, wants_done: bool) -> None:
    """Move on after a turn: by request, by the phase table, or by the number of turns."""
    last = PHASES[-1]
    if ledger["phase"] == last:
        ledger["done"] |= wants_done or ledger["in_phase"] >= 1
    elif wants_results and ledger["phase"] != PHASES[0] and ledger["completeness"] >= RESULTS_FROM:
        ledger.update(phase=last, in_phase=0, done=True)
    else:
        while ledger["phase"] != last and phase_over(ledger):
            ledger.update(phase=PHASES[PHASES.index(ledger["phase"]) + 1], in_phase=0)
    if ledger["turn"] >= LONG_TURNS and ledger["phase"] in PHASES[-2:]:
        ledger["phase"] = last
        ledger["done"] |= ledger["turn"] >= LAST_TURN
