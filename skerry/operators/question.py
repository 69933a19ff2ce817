"""Typed questions: which items, in which order, how many to a page.

A question is a frozen record; `parse` is its validated constructor. Facets are spelled
`key:op:value`. Each key of a registry says how its predicate is met: by a column of the
item, by a related table (semi-join), or by presence (1: has a row there, 0: has none).
Equal facets repeated are conjuncts; `any` facets of one key are alternatives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from operator import and_
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "any": lambda c, v: c == v,
    "gte": lambda c, v: c >= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
PAGE_SIZE, PAGE_MOST = 60, 400


class Refused(ValueError):
    """A question that makes no sense; says why."""


@dataclass(frozen=True)
class Facet:
    key: str
    op: str
    value: object

    @property
    def spelling(self) -> str:
        shown = ("=".join(map(number_text, self.value))) if isinstance(self.value, tuple) else number_text(self.value)
        return f"{self.key}:{self.op}:{shown}"


def number_text(value: object) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


@dataclass(frozen=True)
class Key:
    """One filterable dimension.

    kind: int, num, text, date (spelled yyyy-mm-dd), pair (key=value) or numpair (key=number). rows: the related
    table, given the tables by name, with the item's id under `on`; None: the item itself.
    predicate: of the rows, from op and value. presence: 1 or 0 instead of a predicate.
    """

    name: str
    kind: str
    ops: tuple[str, ...]
    column: str | None = None
    rows: str | None = None
    on: str | None = None
    presence: bool = False
    choices: tuple[str, ...] | None = None
    fold: bool = False
    pair: tuple[str, str] | None = None
    #: Which of `rows` count at all.
    where: str | None = None


def facet(registry: Mapping[str, Key], spelling: str) -> Facet:
    """The facet that `key:op:value` spells, or Refused."""
    parts = spelling.split(":", 2)
    if len(parts) != 3 or not parts[2]:
        raise Refused(f"not key:op:value: {spelling!r}")
    name, op, raw = parts
    if name not in registry:
        raise Refused(f"unknown key {name!r}")
    key = registry[name]
    if op not in key.ops:
        raise Refused(f"{name} can't be asked with {op}")
    value = _value(key, raw)
    if key.choices and value not in key.choices:
        raise Refused(f"{name} is one of {', '.join(key.choices)}")
    if key.presence and value not in (0, 1):
        raise Refused(f"{name} is 0 or 1")
    return Facet(name, op, value)


def _value(key: Key, raw: str) -> object:
    try:
        if key.kind == "int":
            return int(raw)
        if key.kind == "num":
            return float(raw)
        if key.kind == "date":
            return date.fromisoformat(raw).isoformat()
        if key.kind in ("pair", "numpair"):
            left, sign, right = raw.partition("=")
            if not sign or not left:
                raise Refused(f"{key.name} is key=value")
            return (left, float(right) if key.kind == "numpair" else right)
    except ValueError as error:
        raise Refused(f"{key.name}: {raw!r} is no {key.kind}") from error
    return raw.lower() if key.fold else raw


def canonical(facets: list[Facet]) -> tuple[Facet, ...]:
    """Without repeats, in the order of their spelling."""
    return tuple(sorted(dict.fromkeys(facets), key=lambda f: f.spelling))


#: How much of a ranking answers.
DEPTHS = ("head", "all")
#: Most stars, and the orders by time.
STARS, TIMED = 5, ("newest", "oldest")


@dataclass(frozen=True)
class Question:
    facets: tuple[Facet, ...] = ()
    sort: str = "id"
    descending: bool = True
    size: int = PAGE_SIZE
    #: Scopes: one value each, of those that a library has (folder, album, person, artifact, kind, favorite, rating_min).
    scopes: tuple[tuple[str, object], ...] = ()
    text: str | None = None
    depth: str = "head"

    def without(self, key: str) -> Question:
        return replace(self, facets=tuple(f for f in self.facets if f.key != key), scopes=tuple(s for s in self.scopes if s[0] != key))

    def scope(self, name: str) -> object:
        return dict(self.scopes).get(name)

    @property
    def spelling(self) -> str:
        """The one way to write this question."""
        pairs = [*self.scopes, *([("q", self.text), ("depth", self.depth)] if self.text else []), *[("f", f.spelling) for f in canonical(list(self.facets))]]
        return urlencode([*pairs, ("sort", ("-" if self.descending else "") + self.sort), ("size", self.size)])

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.spelling.encode()).hexdigest()[:16]


def parse(
    registry: Mapping[str, Key], sorts: tuple[str, ...], facets: list[str] = (), sort: str | None = None, size: int = PAGE_SIZE,
    scopes: Mapping[str, object] | None = None, text: str | None = None, depth: str | None = None, kinds: tuple[str, ...] = (),
) -> Question:
    """A question, or Refused: unknown keys, operators, values, sorts, scopes, sizes, and what doesn't go together."""
    text = (text or "").strip() or None
    sort = sort or ("similarity" if text else "-id")
    name = sort.removeprefix("-")
    if (name == "similarity") != (text is not None):
        raise Refused("a phrase orders by similarity, and only a phrase does")
    if name not in ("id", "similarity", *sorts):
        raise Refused(f"can't sort by {name!r}")
    if not 1 <= size <= PAGE_MOST:
        raise Refused(f"a page has 1 to {PAGE_MOST} items")
    if depth is not None and (depth not in DEPTHS or text is None):
        raise Refused(f"only a phrase has a depth, one of {', '.join(DEPTHS)}")
    held = {k: v for k, v in sorted((scopes or {}).items()) if v is not None}
    if "folder" in held and "album" in held:
        raise Refused("a folder or an album, not both")
    if kinds and held.get("kind", kinds[0]) not in kinds:
        raise Refused(f"kind is one of {', '.join(kinds)}")
    if held.get("favorite", 1) not in (0, 1):
        raise Refused("favorite is 0 or 1")
    if "rating_min" in held and not 1 <= held["rating_min"] <= STARS:
        raise Refused(f"rating_min is 1 to {STARS}")
    return Question(canonical([facet(registry, x) for x in facets]), name, sort.startswith("-"), size, tuple(held.items()), text, depth or "head")


class Stale(Refused):
    """A link to a hypothesis over an older interpretation."""


def bound(question: Question, names: Mapping[str, DataFrame], current: DataFrame | None = None) -> Question:
    """The question with every scope's slug looked up: retired slugs become today's, unknown ones are a LookupError.

    names: of a scope, rows slug, live_slug (null: the slug itself). current: id, stale of the
    sessions; a question about a stale one is refused. Each look-up is one filtered row.
    """
    scopes = []
    for name, value in question.scopes:
        if name in names:
            found = names[name].where(F.col("slug") == value).limit(1).collect()
            if not found:
                raise LookupError(f"no {name} at {value!r}")
            value = found[0]["live_slug"] or value
        scopes.append((name, value))
    for f in question.facets:
        if f.key == "event.id" and current is not None:
            found = current.where(F.col("id") == f.value).limit(1).collect()
            if not found:
                raise LookupError(f"no session {f.value}")
            if found[0]["stale"]:
                raise Stale(f"session {f.value} was grouped over an older interpretation")
    return replace(question, scopes=tuple(scopes))


# -- rules: a question saved as a collection's membership -----------------------

#: What a stored rule of each version says, exactly.
RULE_WHERE = {
    1: {"folder", "person", "kind", "favorite", "rating_min"},
    2: {"folder", "person", "artifact", "kind", "favorite", "rating_min"},
    3: {"folder", "person", "artifact", "kind", "favorite", "rating_min", "facets"},
}
RULE_SELECT = {"sort", "text", "take"}


@dataclass(frozen=True)
class Rule:
    where: dict = field(default_factory=dict)
    facets: tuple[Facet, ...] = ()
    sort: str | None = None
    text: str | None = None
    take: int | None = None
    actor: int | None = None


def rule(stored: object, registry: Mapping[str, Key], kinds: tuple[str, ...], actor: int | None = None) -> Rule:
    """A stored rule, read; Refused if it says more, less or other than its version allows."""

    def need(holds: bool, why: str) -> None:
        if not holds:
            raise Refused(why)

    need(isinstance(stored, dict) and set(stored) == {"v", "where", "select"}, "a rule has v, where and select")
    version, where, select = stored["v"], stored["where"], stored["select"]
    need(type(version) is int and version in RULE_WHERE, f"no rule has version {version!r}")
    need(isinstance(where, dict) and set(where) == RULE_WHERE[version], f"version {version} says exactly {', '.join(sorted(RULE_WHERE[version]))}")
    need(isinstance(select, dict) and set(select) == RULE_SELECT, f"a selection says exactly {', '.join(sorted(RULE_SELECT))}")
    for name in ("folder", "person", "artifact"):
        need(where.get(name) is None or (isinstance(where[name], str) and len(where[name]) == 32 and all(c in "0123456789abcdef" for c in where[name])), f"{name} is a uuid of 32 hex digits")
    need(where["kind"] is None or where["kind"] in kinds, f"kind is one of {', '.join(kinds)}")
    need(where["favorite"] is None or isinstance(where["favorite"], bool), "favorite is true, false or absent")
    need(where["rating_min"] is None or (type(where["rating_min"]) is int and 1 <= where["rating_min"] <= STARS), f"rating_min is 1 to {STARS}")
    held = tuple(facet(registry, x) for x in where.get("facets") or ())
    need(all(f.key != "event.id" for f in held), "a session is a hypothesis, no membership")
    sort, text, take = select["sort"], select["text"], select["take"]
    need(take is None or (type(take) is int and take >= 1), "take is a rank, 1 or more")
    if text is not None:
        need(isinstance(text, str) and bool(text.strip()), "a phrase isn't empty")
        need(take is not None, "a phrase ranks everything; take makes a set of it")
        need(sort == "similarity", "a phrase orders by similarity")
    elif take is not None:
        need(sort in TIMED, f"a rule with take orders by one of {', '.join(TIMED)}")
    else:
        need(sort is None, "without take, order is no membership")
    authored = where["favorite"] is not None or where["rating_min"] is not None
    need(authored == (actor is not None), "an actor is named if, and only if, a mark is asked for")
    return Rule({k: v for k, v in where.items() if k != "facets"}, canonical(list(held)), sort, text, take, actor)


def condition(key: Key, op: str, value: object) -> Column:
    if key.pair:
        return (F.col(key.pair[0]) == value[0]) & OPERATORS[op](F.col(key.pair[1]), value[1])
    column = F.lower(F.col(key.column)) if key.fold else F.col(key.column)
    return OPERATORS[op](column, value)


def eligible(items: DataFrame, id: str, question: Question, registry: Mapping[str, Key], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of `items` that the question asks for.

    Conditions on the item's own columns become one filter that reaches the scan; every
    other conjunct is one semi-join (or anti-join, for absence) against the related table.
    """
    terms: list[tuple[Key, list[Facet]]] = []
    for f in question.facets:
        key = registry[f.key]
        same = next((t for t in terms if f.op == "any" and t[0] is key and t[1][0].op == "any"), None)
        if same:
            same[1].append(f)
        else:
            terms.append((key, [f]))
    own = [_either(k, fs) for k, fs in terms if k.rows is None]
    if own:
        items = items.where(reduce(and_, own))
    for key, fs in terms:
        if key.rows is None:
            continue
        rows = tables[key.rows] if key.where is None else tables[key.rows].where(key.where)
        if key.presence:
            how = "left_semi" if fs[0].value == 1 else "left_anti"
        else:
            rows, how = rows.where(_either(key, fs)), "left_semi"
        ids = rows.select(F.col(key.on).alias("__related"))
        items = items.join(ids, items[id] == ids["__related"], how)
    return items


def _either(key: Key, facets: list[Facet]) -> Column:
    if len(facets) > 1 and not key.pair and not key.fold:
        return F.col(key.column).isin([f.value for f in facets])
    out = condition(key, facets[0].op, facets[0].value)
    for f in facets[1:]:
        out = out | condition(key, f.op, f.value)
    return out
