"""Typed questions: what is refused, one spelling, conjuncts and alternatives."""

import pytest

from skerry.operators.question import Question, Refused, canonical, eligible, facet, parse
from skerry.plans.filters import REGISTRY


@pytest.mark.parametrize("spelling", ["nothing", "media.kind:eq", "media.kind:eq:", "no.key:eq:1", "media.kind:gte:en", "media.length:eq:long", "has.label:eq:2", "param.is:eq:nosign", "param.num:eq:a=b"])
def test_refused(spelling):
    with pytest.raises(Refused):
        facet(REGISTRY, spelling)


@pytest.mark.parametrize(("sort", "size"), [("-nothing", 60), ("-n_chars", 0), ("-n_chars", 401)])
def test_refused_views(sort, size):
    with pytest.raises(Refused):
        parse(REGISTRY, ("n_chars",), [], sort, size)


def test_one_spelling():
    a = parse(REGISTRY, ("n_chars",), ["media.length:gte:7", "media.kind:eq:en", "media.kind:eq:en"], "-n_chars")
    b = parse(REGISTRY, ("n_chars",), ["media.kind:eq:en", "media.length:gte:7"], "-n_chars")
    assert a == b
    assert a.spelling == b.spelling
    assert a.fingerprint == b.fingerprint
    assert facet(REGISTRY, "param.num:gte:quality=7.0").spelling == "param.num:gte:quality=7"
    assert canonical([*a.facets, *a.facets]) == a.facets


def test_and_or(spark):
    items = spark.createDataFrame([(1, "en", 5, "A"), (2, "de", 5, "b"), (3, "en", 9, "a"), (4, None, None, None)], "doc_id long, lang string, n_chars long, source string")

    def ask(*facets):
        question = Question(tuple(facet(REGISTRY, f) for f in facets))
        return sorted(r.doc_id for r in eligible(items, "doc_id", question, REGISTRY, {}).collect())

    assert ask() == [1, 2, 3, 4]
    assert ask("media.kind:any:en", "media.kind:any:de") == [1, 2, 3]
    assert ask("media.kind:eq:en", "media.kind:eq:de") == []
    assert ask("media.kind:eq:en", "media.length:gte:6") == [3]
    assert ask("folder.folded:eq:A") == [1, 3]


def test_presence_keeps_rows_once(spark):
    items = spark.createDataFrame([(1, "en"), (2, "de")], "doc_id long, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for value, want in ((1, [1]), (0, [2])):
        question = Question((facet(REGISTRY, f"has.label:eq:{value}"),))
        assert [r.doc_id for r in eligible(items, "doc_id", question, REGISTRY, {"labels": labels}).collect()] == want
