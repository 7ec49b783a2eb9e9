"""Planning of bulk actions on cards and notes, view state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARD_ACTIONS = ("flag", "suspend", "unsuspend", "bury", "unbury", "change_deck")
NOTE_ACTIONS = ("add_tags", "remove_tags")
# Flag names.
FLAG_NAMES = {1: "red", 2: "orange", 3: "green", 4: "blue", 5: "pink", 6: "turquoise", 7: "purple"}
LEAST_LIMIT, MOST_LIMIT, DEFAULT_LIMIT = 10, 200, 50


@dataclass(frozen=True)
class Action:
    kind: str
    flag: int | None = None
    deck_id: int | None = None
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in CARD_ACTIONS + NOTE_ACTIONS:
            raise ValueError(f"no such action: {self.kind}")
        if self.kind == "flag" and self.flag not in range(8):
            raise ValueError("a flag is 0 to 7")
        if self.kind == "change_deck" and not (self.deck_id and self.deck_id > 0):
            raise ValueError("a deck id is positive")
        if self.kind in NOTE_ACTIONS and not any(t.strip() for t in self.tags):
            raise ValueError("tags are missing")


def eligible(action: Action) -> Column:
    """Whether an action would change a live card (flag, suspended, buried, home_deck_id)."""
    return {
        "flag": lambda: F.col("flag") != action.flag,
        "suspend": lambda: ~F.col("suspended"),
        "unsuspend": lambda: F.col("suspended"),
        "bury": lambda: ~F.col("buried") & ~F.col("suspended"),
        "unbury": lambda: F.col("buried"),
        "change_deck": lambda: F.col("home_deck_id") != action.deck_id,
    }[action.kind]()


def classify(requested: DataFrame, cards: DataFrame, action: Action, normal_decks: DataFrame | None = None) -> DataFrame:
    """``(card_id, note_id, status)``: eligible, skipped, or stale (no longer there)."""
    if action.kind == "change_deck" and normal_decks is not None and not normal_decks.where(F.col("id") == action.deck_id).take(1):
        raise ValueError("the destination deck is not available")
    asked = requested.select("card_id").where("card_id > 0").distinct()
    live = cards.select("card_id", "note_id", eligible(action).alias("_eligible"))
    status = F.when(F.col("_eligible").isNull(), "stale").when(F.col("_eligible"), "eligible").otherwise("skipped")
    return asked.join(live, "card_id", "left").select("card_id", "note_id", status.alias("status"))


def counts(plan: DataFrame) -> DataFrame:
    """One row: requested, live, eligible, stale, skipped cards, and notes that would change."""
    n = lambda s: F.count_if(F.col("status") == s)
    return plan.agg(
        F.count("*").alias("requested"), (F.count("*") - n("stale")).alias("live"), n("eligible").alias("eligible"),
        n("stale").alias("stale"), n("skipped").alias("skipped"),
        F.countDistinct(F.when((F.col("status") == "eligible") & (F.col("note_id") > 0), F.col("note_id"))).alias("note_count"),
    )


def classify_notes(requested: DataFrame, notes: DataFrame) -> DataFrame:
    """``(note_id, status)`` of a tag action: eligible if the note is there."""
    live = notes.select("note_id", F.lit(True).alias("_live"))
    return requested.select("note_id").where("note_id > 0").distinct().join(live, "note_id", "left").select("note_id", F.when(F.col("_live"), "eligible").otherwise("stale").alias("status"))


def undo_allowed(last_step: int | None, current_step: int | None) -> bool:
    """Only the exact latest step may be undone."""
    return last_step is not None and last_step == current_step


def message(kind: str, changed: int, requested: int) -> str:
    noun = "note" if kind in NOTE_ACTIONS else "card"
    text = f"{changed} {noun}{'' if changed == 1 else 's'} changed"
    return text if changed == requested else f"{text}, {requested - changed} left as they were"


def clamp_limit(value) -> int:
    try:
        return min(MOST_LIMIT, max(LEAST_LIMIT, int(value)))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


def state_counts(cards: DataFrame, *keys: str) -> DataFrame:
    return cards.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("suspended").alias("suspended"), F.count_if("buried").alias("buried"), *(F.count_if(F.col("flag") == f).alias(f"flag_{f}") for f in range(8)))


def state_summary() -> Column:
    """A sentence from the columns of ``state_counts``; empty for no cards."""
    noun = F.when(F.col("total") == 1, "card").otherwise("cards")
    part = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" "), noun, F.lit(f" {c}")))
    flags = [F.when(F.col(f"flag_{i}") > 0, F.concat(F.lit(f"{name} "), F.col(f"flag_{i}").cast("string"))) for i, name in FLAG_NAMES.items()]
    listed = F.concat_ws(", ", *flags)
    rest = F.when(F.col("flag_0") > 0, F.concat(F.lit(", unflagged "), F.col("flag_0").cast("string"))).otherwise("")
    flagged = F.when(listed != "", F.concat(F.lit("Flags: "), listed, rest))
    text = F.concat_ws(". ", part("suspended"), part("buried"), flagged)
    return F.when(text != "", F.concat(text, F.lit("."))).otherwise("")


def patched(states: Column, targets: Column, **changes) -> Column:
    """States (array of struct with card_id, flag, suspended, buried) with target cards changed."""
    names = ("card_id", "flag", "suspended", "buried")

    def one(s: Column) -> Column:
        hit = F.array_contains(targets, s["card_id"])
        return F.struct(*(F.when(hit, F.lit(changes[n])).otherwise(s[n]).alias(n) if n in changes else s[n].alias(n) for n in names))

    return F.transform(states, one)


def selection(shown: DataFrame, checked: DataFrame, mode: str) -> DataFrame:
    """Set algebra of checked rows: all, none, invert, keep (those still shown)."""
    key = shown.columns[0]
    if mode == "all":
        return shown.select(key)
    if mode == "none":
        return shown.select(key).where("false")
    return shown.select(key).join(checked.select(key), key, "left_anti" if mode == "invert" else "left_semi")


def select_range(shown: DataFrame, checked: DataFrame, first: int, last: int, on: bool = True, position: str = "position") -> DataFrame:
    """Checked rows after the rows from one position to another (either way round) are checked or unchecked."""
    key = next(c for c in shown.columns if c != position)
    within = shown.where(F.col(position).between(min(first, last), max(first, last))).select(key)
    return checked.select(key).union(within).distinct() if on else checked.select(key).join(within, key, "left_anti")


def result_ids(results: DataFrame) -> DataFrame:
    """One row: the distinct positive note ids and card ids of results, sorted."""
    cards = results.select(F.explode("card_ids").alias("id")).where("id > 0").agg(F.array_sort(F.collect_set("id")).alias("card_ids"))
    return results.where("note_id > 0").agg(F.array_sort(F.collect_set("note_id")).alias("note_ids")).join(cards, F.lit(True))


def same_rows(shown: DataFrame, fresh: DataFrame) -> bool:
    """Whether two result lists have the same notes with the same cards at the same positions."""
    columns = ["position", "note_id", "card_ids"]
    a, b = shown.select(columns), fresh.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def refreshed(shown: DataFrame, fresh: DataFrame) -> DataFrame | None:
    """Results with live card states, or None if the rows are no longer the same; nothing else changes."""
    if not same_rows(shown, fresh):
        return None
    states = fresh.select("note_id", F.col("card_states").alias("_states"), F.col("sibling_count").alias("_siblings"))
    out = shown.drop("card_states", "sibling_count").join(states, "note_id")
    return out.withColumnRenamed("_states", "card_states").withColumnRenamed("_siblings", "sibling_count")


def overlay(results: DataFrame, live: DataFrame) -> DataFrame:
    """Results with live card ids and states where there are some."""
    l = live.select("note_id", F.col("card_ids").alias("_ids"), F.col("card_states").alias("_states"))  # noqa: E741
    out = results.join(l, "note_id", "left")
    return out.withColumn("card_ids", F.coalesce("_ids", "card_ids")).withColumn("card_states", F.coalesce("_states", "card_states")).drop("_ids", "_states")


def without_identity(fields: Column, name: str = "ankihub_id") -> Column:
    """Fields of a copy: the external identity is blank."""
    return F.transform(fields, lambda f: F.struct(f["name"].alias("name"), F.when(F.lower(f["name"]) == name, F.lit("")).otherwise(f["value"]).alias("value")))
