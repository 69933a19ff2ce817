"""Queries: recipes of generated pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recipes import recipes
from ..sources.tables import load
from .registry import query


@query("recipe_parsed", """
SELECT event_id, CASE k WHEN 0 THEN 'SwarmUI' WHEN 1 THEN 'NovelAI' WHEN 2 THEN 'InvokeAI' WHEN 3 THEN 'ComfyUI' ELSE 'A1111' END AS tool, CASE WHEN k = 5 THEN 'heuristic' ELSE 'marker' END AS detection, 'a ' || event_type AS positive, CASE WHEN k = 5 THEN '' ELSE 'blur' END AS negative,
 event_id AS seed, CASE WHEN k <> 1 THEN 20 + event_id % 9 END AS steps, CASE WHEN k = 2 THEN NULL ELSE 6.5::DOUBLE END AS cfg, 'euler' AS sampler, CASE WHEN k IN (0, 2, 3) THEN 'm.ckpt' END AS model, CASE WHEN k IN (0, 3, 4) THEN 512 END AS width, CASE WHEN k = 2 THEN 'lots' END AS odd_cfg
FROM (SELECT *, event_id % 7 AS k FROM events) WHERE k < 6
""")
def recipe_parsed(spark, sf_dir):
    """Six tools' chunks, by event; every seventh has none that tells a recipe."""
    id, steps, words = F.col("event_id").cast("string"), (20 + F.col("event_id") % 9).cast("string"), F.concat(F.lit("a "), "event_type")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    tail = said("\nSteps: ", steps, ", Sampler: euler, CFG scale: 6.5, Seed: ", id)
    made = [
        F.create_map(F.lit("parameters"), said('{"sui_image_params": {"prompt": "', words, '", "negativeprompt": "blur", "seed": ', id, ', "steps": "', steps, '", "cfgscale": 6.5, "comfyuisampler": "euler", "model": "m.ckpt", "width": 512, "height": 640}}')),
        F.create_map(F.lit("Software"), F.lit("NovelAI"), F.lit("Description"), words, F.lit("Comment"), said('{"uc": "blur", "seed": ', id, ', "scale": 6.5, "sampler": "euler", "steps": 20.5}')),
        F.create_map(F.lit("invokeai_metadata"), said('{"positive_prompt": "', words, '", "negative_prompt": "blur", "seed": ', id, ', "steps": ', steps, ', "cfg_scale": "lots", "scheduler": "euler", "model": {"model_name": "m.ckpt"}}')),
        F.create_map(F.lit("prompt"), said('{"3": {"class_type": "KSampler", "inputs": {"seed": ', id, ', "steps": ', steps, ', "cfg": 6.5, "sampler_name": "euler", "positive": ["6", 0], "negative": ["9", 0], "model": ["8", 0], "latent_image": ["5", 0]}}, "5": {"inputs": {"width": 512, "height": 512}}, "6": {"inputs": {"text": "', words, '"}}, "9": {"inputs": {"text": ["7", 0]}}, "7": {"inputs": {"text": "blur"}}, "8": {"inputs": {"model": ["4", 0]}}, "4": {"inputs": {"ckpt_name": "m.ckpt"}}}')),
        F.create_map(F.lit("parameters"), said(words, "\nNegative prompt: blur", tail, ", Size: 512x640")),
        F.create_map(F.lit("UserComment"), said(words, tail)),
        F.create_map(F.lit("parameters"), F.lit('{"other": 1}')),
    ]
    chunks = F.element_at(F.array(*made), (F.col("event_id") % 7 + 1).cast("int"))
    rows = load(spark, sf_dir, "events").select("event_id", recipes(chunks).alias("r")).where("r is not null")
    return rows.select("event_id", *[f"r.{c}" for c in ("tool", "detection", "positive", "negative", "seed", "steps", "cfg", "sampler", "model", "width")], F.col("r.extra")["cfg"].alias("odd_cfg"))
