"""Recipes of generated pictures, out of the text chunks that their tools wrote.

A tool is one entry of TOOLS: how its chunks are known, where its values are, and under which
names. The first tool whose marker fits reads the chunks; else text that looks like a tail of
pairs is read as one, and called a guess. Values that aren't what their slot holds go to `extra`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CANONICAL, PAIR

WHOLE, REAL, WORDS = ("seed", "steps", "clip_skip", "width", "height"), ("cfg", "denoise"), ("model", "model_hash", "sampler", "scheduler", "version")
RECIPE = "struct<tool: string, detection: string, positive: string, negative: string, model: string, model_hash: string, sampler: string, scheduler: string, version: string, seed: long, steps: long, clip_skip: long, width: long, height: long, cfg: double, denoise: double, extra: map<string,string>>"


def _json(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


@dataclass(frozen=True)
class Tool:
    name: str
    marked: Callable[[dict], bool]
    values: Callable[[dict], dict]
    #: Slot -> the names that its value may go by, the first present one counts.
    names: dict[str, tuple[str, ...]] = field(default_factory=dict)


def graph_values(chunks: dict) -> dict:
    """Values of a node graph: of its sampling node, and of what that node's links lead to."""
    nodes = _json(chunks.get("prompt"))

    def follow(link: object, wanted: str, depth: int = 0) -> object:
        """The input `wanted` of the node at the other end of a link, or behind it."""
        if not (isinstance(link, list) and link and depth < 32):
            return None
        inputs = (nodes.get(str(link[0])) or {}).get("inputs") or {}
        if not isinstance(inputs.get(wanted), list) and wanted in inputs:
            return inputs[wanted]
        return next((x for v in inputs.values() if (x := follow(v, wanted, depth + 1)) is not None), None)

    for key in sorted(nodes, key=str):
        inputs = (nodes[key] or {}).get("inputs") if isinstance(nodes[key], dict) else None
        if isinstance(inputs, dict) and {"seed", "steps", "positive"} <= set(inputs) or isinstance(inputs, dict) and "noise_seed" in inputs:
            out = {k: v for k, v in inputs.items() if not isinstance(v, list)}
            reached = {"positive": ("positive", "text"), "negative": ("negative", "text"), "ckpt_name": ("model", "ckpt_name"), "width": ("latent_image", "width"), "height": ("latent_image", "height")}
            return out | {name: x for name, (link, wanted) in reached.items() if (x := follow(inputs.get(link), wanted)) is not None}
    return {}


def tail_values(text: str) -> dict:
    """Values of a text of lines: prompt, unwanted part, and a last line of three pairs or more."""
    lines = text.strip().split("\n")
    pairs = re.findall(PAIR, lines[-1])
    body = [x.strip() for x in (lines[:-1] if len(pairs) >= 3 else lines)]
    at = next((k for k, x in enumerate(body) if x.startswith("Negative prompt:")), len(body))
    negative = [body[at][16:].strip(), *body[at + 1 :]] if at < len(body) else []
    out = {"positive": "\n".join(body[:at]).strip(), "negative": "\n".join(negative).strip()}
    for key, raw in pairs if len(pairs) >= 3 else ():
        value = raw.strip()
        if len(value) > 1 and value[0] == value[-1] == '"':
            try:
                value = json.loads(value)
            except ValueError:
                pass
        if value != "":
            out.setdefault(CANONICAL.get(key.strip(), key.strip()), value)
    return out


def looks_like_tail(text: str) -> bool:
    return bool(text) and text.lstrip()[:1] not in "{[" and ("Negative prompt:" in text or len(re.findall(PAIR, text.strip().split("\n")[-1])) >= 3)


COMMON = {"positive": ("positive", "prompt"), "negative": ("negative", "negative_prompt"), "seed": ("seed",), "steps": ("steps",), "width": ("width",), "height": ("height",)}
TOOLS = (
    Tool("SwarmUI", lambda c: "sui_image_params" in (c.get("parameters") or ""), lambda c: _json(c["parameters"]).get("sui_image_params") or {}, COMMON | {"negative": ("negativeprompt",), "model": ("model",), "cfg": ("cfgscale",), "sampler": ("comfyuisampler", "autowebuisampler"), "scheduler": ("comfyuischeduler",), "version": ("swarm_version",)}),
    Tool("NovelAI", lambda c: c.get("Software") == "NovelAI", lambda c: _json(c.get("Comment")) | ({"positive": c["Description"].strip()} if (c.get("Description") or "").strip() else {}), COMMON | {"negative": ("uc",), "cfg": ("scale",), "sampler": ("sampler",)}),
    Tool("Fooocus", lambda c: c.get("fooocus_scheme") == "fooocus", lambda c: _json(c.get("parameters")), COMMON | {"model": ("base_model",), "cfg": ("guidance_scale",), "sampler": ("sampler",), "scheduler": ("scheduler",), "version": ("version",)}),
    Tool("InvokeAI", lambda c: "invokeai_metadata" in c, lambda c: {k: (v.get("model_name") or v.get("name") if k == "model" and isinstance(v, dict) else v) for k, v in _json(c["invokeai_metadata"]).items()}, COMMON | {"positive": ("positive_prompt",), "model": ("model",), "cfg": ("cfg_scale",), "sampler": ("scheduler",)}),
    Tool("Easy Diffusion", lambda c: "negative_prompt" in c, lambda c: c, COMMON | {"model": ("use_stable_diffusion_model",), "sampler": ("sampler_name",), "steps": ("num_inference_steps",), "cfg": ("guidance_scale",), "clip_skip": ("clip_skip",)}),
    Tool("ComfyUI", lambda c: (c.get("prompt") or "").lstrip().startswith("{"), graph_values, COMMON | {"positive": ("positive",), "seed": ("seed", "noise_seed"), "cfg": ("cfg",), "sampler": ("sampler_name",), "scheduler": ("scheduler",), "denoise": ("denoise",), "model": ("ckpt_name",)}),
    Tool("A1111", lambda c: "Negative prompt:" in (c.get("parameters") or "") and looks_like_tail(c["parameters"]), lambda c: tail_values(c["parameters"])),
)


def typed(value: object, kind: str) -> object:
    """A value as its slot holds it, or None: whole numbers, finite numbers, text."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    if kind == "words":
        return str(value).strip() or None
    try:
        number = float(value if isinstance(value, (int, float)) else str(value).strip())
    except ValueError:
        return None
    if number != number or number in (float("inf"), float("-inf")):
        return None
    return number if kind == "real" else int(value) if isinstance(value, int) else int(number) if number.is_integer() else None


def recipe(chunks: dict | None) -> dict | None:
    """The recipe that a picture's chunks tell, or None."""
    chunks = {k: v for k, v in (chunks or {}).items() if v is not None}
    tool = next((t for t in TOOLS if t.marked(chunks)), None)
    if tool is not None:
        name, detection, values, names = tool.name, "marker", dict(tool.values(chunks)), tool.names
    else:
        guess = next((chunks[k] for k in ("parameters", "UserComment", "Comment") if looks_like_tail(chunks.get(k) or "")), None)
        if guess is None:
            return None
        name, detection, values, names = "A1111", "heuristic", tail_values(guess), {}
    if "size" in values and (m := re.match(r"(?i)^\s*(\d+)\s*x\s*(\d+)\s*$", str(values["size"]))):
        values |= {"width": m[1], "height": m[2]}
        del values["size"]
    out: dict = {"tool": name, "detection": detection, "extra": {}}
    for slot in ("positive", "negative", *WORDS, *WHOLE, *REAL):
        key = next((k for k in names.get(slot, (slot,)) if values.get(k) not in (None, "")), None)
        raw = values.pop(key, None) if key else None
        kind = "whole" if slot in WHOLE else "real" if slot in REAL else "words"
        out[slot] = typed(raw, kind)
        if raw is not None and out[slot] is None:
            values[slot] = raw
    out["positive"], out["negative"] = out["positive"] or "", out["negative"] or ""
    out["extra"] = {str(k): str(v) for k, v in values.items() if v not in (None, "") and not isinstance(v, (dict, list))}
    return out


def recipes(chunks: Column) -> Column:
    """`recipe` of a map column: graphs and nested JSON of any shape are beyond from_json, which wants a schema."""

    def read(rows: pd.Series) -> pd.Series:
        told = [recipe(dict(x) if x is not None else None) for x in rows]
        return pd.Series([[] if t is None else [t] for t in told], dtype=object)

    # A list of one, or of none: a struct alone can't be null here.
    return F.get(F.pandas_udf(read, f"array<{RECIPE}>")(chunks), F.lit(0))
