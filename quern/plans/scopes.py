"""Deck scopes: sets of ``::`` paths with exclusions, as query text and as predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.parser import has_wildcard, scan, unquote
from quern.plans.predicates import UnsupportedFilter, parse_expression

ALL, SELECTED, CUSTOM = "all", "selected", "custom"
#: Deck names with a meaning of their own (fixed values).
RESERVED = frozenset(["current", "filtered"])
_ESCAPED = re.compile(r'[\\":*_()-]')


def identity(name: str) -> str:
    """Equal decks: A-Z folded in ASCII names, other names compared as they are."""
    return name.lower() if name.isascii() else name


def is_below(name: str, root: str) -> bool:
    return identity(name).startswith(identity(root) + "::")


@dataclass(frozen=True)
class Scope:
    roots: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    @staticmethod
    def of(roots, excluded=()) -> Scope:
        """Canonical: roots below another root are absorbed; an exclusion lies below a root."""
        unique = list({identity(r): r for r in reversed(list(roots))}.values())[::-1]
        kept = tuple(r for r in unique if not any(is_below(r, o) for o in unique))
        out = list({identity(e): e for e in excluded}.values())
        if any(not any(is_below(e, r) for r in kept) for e in out):
            raise ValueError("an exclusion must lie below a selected deck")
        return Scope(kept, tuple(e for e in out if not any(is_below(e, o) for o in out)))

    def state(self, name: str) -> str | None:
        """'in', 'out' or None, by the longest selected or excluded ancestor or self."""
        found = [(len(r), s) for s, names in (("in", self.roots), ("out", self.excluded)) for r in names if identity(name) == identity(r) or is_below(name, r)]
        return max(found)[1] if found else None

    def toggled(self, name: str) -> Scope:
        """Check a deck that is out, uncheck one that is in, with its branch.

        A deck below an excluded one stays as it is: the exclusion itself restores the branch.
        """
        roots = [r for r in self.roots if not is_below(r, name) and identity(r) != identity(name)]
        excluded = [e for e in self.excluded if not is_below(e, name) and identity(e) != identity(name)]
        now = self.state(name)
        if now == "in":
            return Scope.of(roots, [*excluded, name] if any(is_below(name, r) for r in roots) else excluded)
        inherits = any(is_below(name, r) for r in roots) and not any(is_below(name, e) for e in excluded)
        if inherits:
            return Scope.of(roots, excluded)
        if any(is_below(name, e) for e in excluded):
            return self
        return Scope.of([*roots, name], excluded)

    def clause(self) -> str:
        if not self.roots:
            return ""
        parts = [_token(r) for r in self.roots]
        chosen = parts[0] if len(parts) == 1 else "(" + " OR ".join(parts) + ")"
        return f"({chosen} {' '.join('-' + _token(e) for e in self.excluded)})" if self.excluded else chosen

    def column(self, deck: Column) -> Column:
        def under(names):
            tests = [(F.lower(deck) == n.lower()) | F.lower(deck).startswith(n.lower() + "::") if n.isascii() else (deck == n) | deck.startswith(n + "::") for n in names]
            return reduce(lambda a, b: a | b, tests, F.lit(False))

        return under(self.roots) & ~under(self.excluded)


def _token(name: str) -> str:
    return 'deck:"' + _ESCAPED.sub(lambda m: "\\" + m[0] if m[0] in '\\":*_' else m[0], name) + '"'


def decode(token: str) -> str | None:
    """Deck name of an exact ``deck:`` token; None if it is a pattern, reserved or malformed."""
    inner = unquote(token) if token.startswith('"') else token
    key, colon, value = inner.partition(":")
    if not colon or key.lower() != "deck":
        return None
    if value.startswith('"'):
        if len(value) < 2 or not value.endswith('"'):
            return None
        value = value[1:-1]
    elif '"' in value:
        return None
    if not value or has_wildcard(value) or value in RESERVED:
        return None
    return re.sub(r"\\(.)", r"\1", value)


def _is_deck(token: str) -> bool:
    return re.match(r'-?"?deck:', token, re.I) is not None


def _scope(node) -> Scope | None:
    """The scope that a subtree of deck atoms says exactly, or None."""
    kind, inner = node
    if kind == "atom":
        name = decode(inner)
        return Scope.of([name]) if name else None
    if kind == "or":
        names = [decode(n[1]) if n[0] == "atom" else None for n in inner]
        return Scope.of(names) if all(names) else None
    if kind == "and":
        plain = [n for n in inner if n[0] != "not"]
        minus = [decode(n[1][1]) if n[1][0] == "atom" else None for n in inner if n[0] == "not"]
        base = _scope(plain[0]) if len(plain) == 1 and all(minus) else None
        try:
            return Scope.of(base.roots, [*base.excluded, *minus]) if base else None
        except ValueError:
            return None
    return None


def _has_deck(node) -> bool:
    kind, inner = node
    if kind == "atom":
        return _is_deck(inner)
    return _has_deck(inner) if kind == "not" else any(_has_deck(n) for n in inner)


def analyze(query: str) -> tuple[str, Scope]:
    """ALL without deck tokens, SELECTED with one exact scope beside other terms, else CUSTOM."""
    try:
        tree = parse_expression(query, native=True)
    except UnsupportedFilter:
        tokens, _ = scan(query, native=True)
        return (CUSTOM if any(map(_is_deck, tokens)) else ALL), Scope()
    if not _has_deck(tree):
        return ALL, Scope()
    whole = _scope(tree)
    if whole:
        return SELECTED, whole
    if tree[0] == "and":
        decks = [n for n in tree[1] if _has_deck(n)]
        found = _scope(decks[0]) if len(decks) == 1 else None
        if found:
            return SELECTED, found
    return CUSTOM, Scope()


def apply_selection(query: str, scope: Scope) -> str:
    """The query with its deck scope replaced; a custom deck expression is an error."""
    kind, old = analyze(query)
    if kind == CUSTOM:
        raise ValueError("the query holds a deck expression of its own")
    rest = query.strip()
    if kind == SELECTED:
        rest = _without_scope(rest)
    clause = scope.clause()
    if not clause or not rest:
        return clause or rest
    tree = parse_expression(rest, native=True) if rest else ("and", [])
    return f"{clause} ({rest})" if tree[0] == "or" else f"{clause} {rest}"


def _without_scope(query: str) -> str:
    tokens, _ = scan(query, native=True)
    drop: set[int] = {i for i, t in enumerate(tokens) if _is_deck(t)}
    changed = True
    while changed:  # parentheses and controls that lost their operands
        left = [i for i in range(len(tokens)) if i not in drop]
        new = set()
        for a, i in enumerate(left):
            before = tokens[left[a - 1]] if a else "("
            after = tokens[left[a + 1]] if a + 1 < len(left) else ")"
            t = tokens[i]
            if t == "(" and after == ")":
                new |= {i, left[a + 1]} if a + 1 < len(left) else {i}
            elif t.upper() in ("AND", "OR") and (before == "(" or after == ")" or before.upper() in ("AND", "OR")):
                new.add(i)
        changed = bool(new)
        drop |= new
    return re.sub(r"\( ", "(", re.sub(r" \)", ")", " ".join(t for i, t in enumerate(tokens) if i not in drop)))


def visible_decks(decks: DataFrame, needle: str) -> DataFrame:
    """Decks ``(name)`` whose name matches or that have a matching descendant."""
    low = needle.strip().lower()
    hits = decks.where(F.lower("name").contains(low))
    parts = F.split("name", "::")
    above = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).alias("name")).distinct()
    return decks.join(above, "name", "left_semi")


def inherited(decks: DataFrame, marks: DataFrame) -> DataFrame:
    """``(name, mark, state)``: each deck's longest marked ancestor or self; ``marks(mark, state)``."""
    parts = F.split("name", "::")
    paths = decks.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))).alias("mark"))
    found = paths.join(marks, "mark").groupBy("name").agg(F.max_by(F.struct("mark", "state"), F.length("mark")).alias("m"))
    return decks.join(found, "name", "left").select("name", "m.mark", "m.state")
