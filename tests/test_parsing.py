"""Prompts, tags, tails, recipes, stamps and verdicts on awkward input."""

import json

import pytest
from pyspark.sql import functions as F

from skerry.functions import moments, recipes, text, when


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("prompt", "want"),
    [
        ("<lora:a:0.5:0.25>", [("a", 0.5, 0.25)]), ("<LORA:a> <lyco:A:2>", [("a", 1.0, 1.0)]), ("<lora::1><lora: >", []), ("<hypernet:a:1>", []), ("<lora:a:x>", [("a", 1.0, 1.0)]),
        ("<lora:a:unet=0.1>", [("a", 1.0, 0.1)]), ("<lora:a:te=0.3>", [("a", 0.3, 0.3)]), ("<lora:a:0.7:te=0.3>", [("a", 0.3, 0.3)]), ("", []),
    ],
)
def test_network_tags(spark, prompt, want):
    assert [(r.name, r.te, r.unet) for r in one(spark, text.network_tags(F.col("p")), p=prompt)] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("x\nSteps: 20, Sampler: Euler a, CFG scale: 7", {"Steps": "20", "Sampler": "Euler a", "CFG scale": "7"}), ('x\nAB: "a, \\"b\\": c", Hires-fix a/b: 2, Seed: 1, Seed: 2', {"AB": 'a, "b": c', "Hires-fix a/b": "2", "Seed": "1"}),
        ("x\nSteps: 20, Seed: 1", None), ("Steps: 20, Empty: , Seed: 1", {"Steps": "20", "Seed": "1"}),
    ],
)
def test_infotext(spark, raw, want):
    assert one(spark, text.infotext(F.col("p")), p=raw) == want


@pytest.mark.parametrize(
    ("raw", "positive", "negative"),
    [("a\nb\nNegative prompt: c\nd\nSteps: 1, Seed: 2, Size: 1x1", "a\nb", "c\nd"), ("only\n", "only", ""), ("a Negative prompt: no\nNegative prompt:yes", "a Negative prompt: no", "yes"), ("Steps: 1, Seed: 2, Size: 1x1", "", "")],
)
def test_prompt_parts(spark, raw, positive, negative):
    got = one(spark, text.prompt_parts(F.col("p")), p=raw)
    assert (got.positive, got.negative) == (positive, negative)


def test_sections():
    assert text.sections("a <b <c> <refiner>") == [{"ordinal": 0, "kind": "main", "spec": None, "text": "a <b <c> <refiner>"}]
    got = text.sections("<base>x<region:0,0,<random:1|2>,1//cid=3> y <break> z<comment:<w>> <other:q><segment:f>")
    assert [(s["kind"], s["spec"], s["text"]) for s in got] == [("main", None, ""), ("base", None, "x"), ("region", "0,0,<random:1|2>,1", "y z <other:q>")]
    assert text.sections(None)[0]["text"] == ""


def test_recipes():
    assert recipes.recipe(None) is None
    assert recipes.recipe({"parameters": "a plain text"}) is None
    broken = recipes.recipe({"parameters": '{"sui_image_params": '})
    assert (broken["tool"], broken["positive"], broken["seed"]) == ("SwarmUI", "", None)
    got = recipes.recipe({"parameters": "p\nSteps: 20.0, Seed: x1, CFG scale: nan, Size: 512X768, Own key: v"})
    assert (got["detection"], got["steps"], got["seed"], got["cfg"], got["width"], got["height"]) == ("heuristic", 20, None, None, 512, 768)
    assert got["extra"] == {"seed": "x1", "cfg": "nan", "Own key": "v"}
    loop = {"1": {"inputs": {"seed": 5, "steps": 3, "positive": ["2", 0]}}, "2": {"inputs": {"back": ["1", 0], "other": ["2", 0]}}}
    got = recipes.recipe({"prompt": json.dumps(loop)})
    assert (got["tool"], got["seed"], got["positive"]) == ("ComfyUI", 5, "")


@pytest.mark.parametrize(
    ("name", "precision"),
    [
        ("20230610_142301.jpg", "second"), ("x2023-06-10 14.23.01", "second"), ("20260821_17h30m02s313ms.png", "subsecond"), ("20260718T094712001", "second"), ("2013_02_10", "day"), ("99991399", None), ("18251231", None),
        ("20230230", None), ("20230610_256161", "day"), ("1700000000", "second"), ("1700000000123", "subsecond"), ("12345", None), ("", None),
    ],
)
def test_name_stamps(spark, name, precision):
    got = one(spark, when.name_stamp(F.col("n")), n=name)
    assert (got and got.precision) == precision


@pytest.mark.parametrize(("path", "precision"), [(["1998"], "year"), (["1970S"], "decade"), (["2003-07", "raw"], "month"), (["2013", "2", "10"], "day"), (["2013", "2"], "month"), (["200307"], None), (["2013-02-30"], None), (["1700"], None), ([], None)])
def test_folder_stamps(spark, path, precision):
    got = one(spark, when.folder_stamp(F.col("f")), f=path)
    assert (got and got.precision) == precision


@pytest.mark.parametrize(("raw", "want"), [("64.33 sec", 64.33), ("2 min", 120.0), ("x", None), ("", None), (None, None)])
def test_durations(spark, raw, want):
    assert one(spark, moments.duration(F.col("d")), d=raw) == want


@pytest.mark.parametrize(("raw", "want"), [('{"Api-Key": 1, "a": [{"token": {"x": 1}}], "b": "é"}', '{"Api-Key":"***","a":[{"token":"***"}],"b":"é"}'), ("no json", "no json"), (None, None), ("3", "3")])
def test_redaction(spark, raw, want):
    assert one(spark, text.redacted(F.col("j")), j=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("b=1&a=2&a=2&=x&c", "a=2&b=1&c="), ("", ""), ("q=%zz&a=1", "a=1&q=")])
def test_canonical_queries(spark, raw, want):
    assert one(spark, text.canonical_query(F.col("q")), q=raw) == want
