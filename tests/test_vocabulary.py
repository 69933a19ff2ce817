"""The vocabulary: registry, dimensions, chips, scopes, rules and names."""

import pytest

from skerry.operators import vocabulary
from skerry.operators.question import Refused, Stale, bound, facet, parse, rule

KEYS = vocabulary.keys()


def test_every_key_has_a_dimension():
    facets = {d.key for d in vocabulary.DIMENSIONS.values() if d.carried == "facet"}
    assert facets == set(KEYS)
    assert len(KEYS) == 37
    assert {d.group for d in vocabulary.DIMENSIONS.values()} <= set(vocabulary.GROUPS)
    for d in vocabulary.DIMENSIONS.values():
        if d.carried == "facet":
            assert set(d.ops) == set(KEYS[d.key].ops), d.key


def test_kinds_have_their_dimensions():
    assert not vocabulary.applies(vocabulary.DIMENSIONS["media.width"], "audio")
    assert vocabulary.applies(vocabulary.DIMENSIONS["media.width"], None)
    assert vocabulary.applies(vocabulary.DIMENSIONS["tag"], "audio")
    assert "width" not in {d.label for _, held in vocabulary.grouped("document") for d in held}
    assert all(d.offered for _, held in vocabulary.grouped() for d in held)


def test_chips():
    assert vocabulary.chip("generation.lora", "eq", 5, names={5: "detail"}) == "LoRA detail"
    assert vocabulary.chip("generation.lora", "eq", 5) == "LoRA #5 (gone)"
    assert vocabulary.chip("rating_min", "gte", 4) == "rating from 4"
    assert vocabulary.chip("has.generation", "eq", 1) == "AI generated yes"
    assert vocabulary.chip("media.kind", "any", "image", "video", "audio") == "kind image, video or audio"
    assert vocabulary.chip("generation.lora", "eq", 1, 2, names={1: "a", 2: "b"}) == "LoRA all of a, b"


def test_dates_and_choices_are_checked():
    assert facet(KEYS, "context.local_day:eq:2024-01-05").value == "2024-01-05"
    for bad in ("context.local_day:eq:2024-13-05", "context.origin:eq:dreamt", "has.place:eq:2", "event.id:any:3", "media.duration:eq:3", "param.num:eq:k"):
        with pytest.raises(Refused):
            facet(KEYS, bad)


@pytest.mark.parametrize(
    "asked",
    [
        {"scopes": {"folder": "a", "album": "b"}}, {"scopes": {"kind": "dream"}, "kinds": vocabulary.KINDS}, {"scopes": {"favorite": 2}}, {"scopes": {"rating_min": 6}},
        {"depth": "all"}, {"text": "x", "depth": "deep"}, {"text": "x", "sort": "-id"}, {"sort": "similarity"}, {"size": 0}, {"size": 401}, {"sort": "dream"},
    ],
)
def test_questions_that_make_no_sense(asked):
    with pytest.raises(Refused):
        parse(KEYS, ("name",), **asked)


def test_one_spelling():
    a = parse(KEYS, (), ["tag:eq:Sun", "tag:eq:sea", "tag:eq:sea"], scopes={"person": "h", "folder": "f", "album": None}, text=" sea ")
    b = parse(KEYS, (), ["tag:eq:sea", "tag:eq:sun"], scopes={"folder": "f", "person": "h"}, text="sea", depth="head")
    assert a == b
    assert a.fingerprint == b.fingerprint
    assert a.fingerprint != parse(KEYS, (), ["tag:eq:sea", "tag:eq:sun"], scopes={"folder": "f", "person": "h"}, text="sea", depth="all").fingerprint
    assert a.without("folder").scope("folder") is None


def test_names_are_bound(spark):
    names = {"folder": spark.createDataFrame([("old", "new"), ("new", None)], "slug string, live_slug string")}
    sessions = spark.createDataFrame([(1, False), (2, True)], "id long, stale boolean")
    assert bound(parse(KEYS, (), scopes={"folder": "old"}), names).scope("folder") == "new"
    assert bound(parse(KEYS, (), scopes={"folder": "new"}), names).scope("folder") == "new"
    with pytest.raises(LookupError, match="no folder"):
        bound(parse(KEYS, (), scopes={"folder": "gone"}), names)
    assert bound(parse(KEYS, (), ["event.id:eq:1"]), names, sessions).facets[0].value == 1
    with pytest.raises(Stale):
        bound(parse(KEYS, (), ["event.id:eq:2"]), names, sessions)
    with pytest.raises(LookupError, match="no session"):
        bound(parse(KEYS, (), ["event.id:eq:3"]), names, sessions)


def stored(version=3, select=None, **where):
    held = {"folder": None, "person": None, "kind": None, "favorite": None, "rating_min": None}
    if version >= 2:
        held["artifact"] = None
    if version >= 3:
        held["facets"] = []
    return {"v": version, "where": held | where, "select": {"sort": None, "text": None, "take": None} | (select or {})}


def test_rules_are_read():
    got = rule(stored(facets=["tag:eq:Sea"], kind="image"), KEYS, vocabulary.KINDS)
    assert [f.spelling for f in got.facets] == ["tag:eq:sea"]
    assert rule(stored(1), KEYS, vocabulary.KINDS).facets == ()
    assert rule(stored(2, folder="0" * 32, select={"sort": "newest", "take": 5}), KEYS, vocabulary.KINDS).take == 5
    assert rule(stored(favorite=True), KEYS, vocabulary.KINDS, actor=3).actor == 3
    assert rule(stored(select={"text": "sea", "sort": "similarity", "take": 9}), KEYS, vocabulary.KINDS).text == "sea"


@pytest.mark.parametrize(
    ("told", "actor"),
    [
        ({"v": 3}, None), (stored(4), None), (stored(True), None), (stored(1, artifact="0" * 32), None), (stored(2, facets=[]), None), (stored(folder="xyz"), None), (stored(kind="dream"), None),
        (stored(favorite=1), 1), (stored(rating_min=True), 1), (stored(rating_min=6), 1), (stored(rating_min=3), None), (stored(), 1), (stored(facets=["event.id:eq:3"]), None), (stored(facets=["dream:eq:1"]), None),
        (stored(select={"take": 0, "sort": "newest"}), None), (stored(select={"take": 5, "sort": "similarity"}), None), (stored(select={"sort": "newest"}), None),
        (stored(select={"text": " ", "sort": "similarity", "take": 1}), None), (stored(select={"text": "x", "sort": "similarity"}), None), (stored(select={"text": "x", "sort": "newest", "take": 1}), None), (stored(more=1), None),
    ],
)
def test_rules_that_are_refused(told, actor):
    with pytest.raises(Refused):
        rule(told, KEYS, vocabulary.KINDS, actor)
