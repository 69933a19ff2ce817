"""Text: folding, slugs, tags, key-value tails, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that names are trimmed of.
BLANKS = " \t\n\r\f\v 　"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def name_key(text: Column) -> Column:
    """Equal for names that differ in case and outer or repeated white space only."""
    return F.lower(collapsed(text))


def humanised(key: Column) -> Column:
    """camelCase, snake_case and dotted names as words; the letters stay as they are."""
    spaced = F.regexp_replace(key, r"[_.\-]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    # The second seam of camel case: before the last capital of a run that begins a word.
    spaced = F.trim(F.regexp_replace(spaced, r"(?<=[A-Z])(?=[A-Z][a-z])", " "))
    return F.when(spaced == "", key).otherwise(spaced)


def match_score(name: Column, asked: Column, aliases: Column | None = None) -> Column:
    """0: begins with it; 1: a word does; 2: contains it; 3: an alias does; null: none does."""
    n, a = F.lower(name), F.lower(asked)
    word = F.concat(F.lit(" "), F.regexp_replace(n, "[^a-z0-9]+", " ")).contains(F.concat(F.lit(" "), a))
    out = F.when(n.startswith(a), 0).when(word, 1).when(n.contains(a), 2)
    return out if aliases is None else out.when(F.exists(aliases, lambda x: F.lower(x).contains(a)), 3)


#: The kinds of tags that name a network.
NETWORKS = ("lora", "lyco")


def network_tags(text: Column) -> Column:
    """Array of (name, te, unet) for `<lora:name:te:unet>` tags, the kind in any case; of names equal but for case the first counts.

    An item with one `=` is named (te=, unet=), others count by place; no unet weight means
    te's, and no te weight, or one that is no number, means 1. A tag without a name is none.
    """
    raw = F.regexp_extract_all(text, F.lit(rf"<(?i:{'|'.join(NETWORKS)}):([^>]+)>"), 1)

    def one(tag: Column) -> Column:
        parts = F.split(tag, ":")
        is_named = lambda p: F.size(F.split(p, "=")) == 2
        plain = F.filter(parts, lambda p: ~is_named(p))

        def weight(name: str, place: int) -> Column:
            own = F.filter(parts, lambda p: is_named(p) & p.startswith(f"{name}="))
            value = F.coalesce(F.substring_index(F.get(own, F.size(own) - 1), "=", -1), F.get(plain, F.lit(place)))
            return F.trim(value).try_cast("double")

        te = F.coalesce(weight("te", 1), F.lit(1.0))
        return F.struct(F.trim(F.get(plain, F.lit(0))).alias("name"), te.alias("te"), F.coalesce(weight("unet", 2), te).alias("unet"))

    tags = F.filter(F.transform(raw, one), lambda t: F.coalesce(t["name"], F.lit("")) != "")
    names = F.transform(tags, lambda t: F.lower(t["name"]))
    return F.filter(tags, lambda t, i: F.array_position(names, F.lower(t["name"])) == i + 1)


#: A key and its value on the last line; the names that keys go by.
PAIR = r'\s*(\w[\w \-/]+):\s*("(?:\\.|[^\\"])+"|[^,]*)(?:,|$)'
CANONICAL = {
    "Model": "model", "Model hash": "model_hash", "Sampler": "sampler", "Schedule type": "scheduler", "Seed": "seed", "Steps": "steps",
    "CFG scale": "cfg", "Size": "size", "Denoising strength": "denoise", "Clip skip": "clip_skip", "Version": "version",
}


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")


def _pairs(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(PAIR), 0)


def infotext(text: Column) -> Column:
    """Map of the `k: v` pairs of the last line, if it has three at least; quoted values may hold commas, empty ones are none."""
    pairs = _pairs(F.element_at(_lines(text), -1))
    raw = F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_extract(p, PAIR, 1)).alias("k"), F.trim(F.regexp_extract(p, PAIR, 2)).alias("v")))
    quoted = lambda v: v.startswith('"') & v.endswith('"') & (F.length(v) > 1)
    plain = F.transform(raw, lambda e: F.struct(e["k"].alias("k"), F.when(quoted(e["v"]), F.coalesce(F.from_json(F.concat(F.lit('{"v":'), e["v"], F.lit("}")), "v string")["v"], e["v"])).otherwise(e["v"]).alias("v")))
    held = F.filter(plain, lambda e: e["v"] != "")
    names = F.transform(held, lambda x: x["k"])
    first = F.filter(held, lambda e, i: F.array_position(names, e["k"]) == i + 1)
    return F.when(F.size(pairs) >= 3, F.map_from_entries(first))


def canonical_names(pairs: Column) -> Column:
    """The pairs of `infotext` under their canonical names; other keys keep theirs."""
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.transform_keys(pairs, lambda k, v: F.coalesce(F.try_element_at(names, k), k))


def looks_like_infotext(text: Column) -> Column:
    """Whether a text reads as one: it says what is unwanted, or ends in three pairs; JSON is none."""
    json = F.ltrim(text).startswith("{") | F.ltrim(text).startswith("[")
    return F.coalesce(~json & (text.contains("Negative prompt:") | (F.size(_pairs(F.element_at(_lines(text), -1))) >= 3)), F.lit(False))


def prompt_parts(text: Column) -> Column:
    """Struct of the positive and negative part of a prompt, line by line, its line of pairs left out.

    The negative part begins at the first line that starts with `Negative prompt:`.
    """
    lines = _lines(text)
    told = F.size(_pairs(F.element_at(lines, -1))) >= 3
    body = F.transform(F.when(told, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    begins = lambda x: x.startswith("Negative prompt:")
    at = F.array_position(F.transform(body, lambda x: begins(x).cast("int")), 1)
    upto = F.when(at > 0, at.cast("int") - 1).otherwise(F.size(body))
    negative = F.transform(F.slice(body, upto + 1, F.size(body)), lambda x: F.when(begins(x), F.regexp_replace(F.substr(x, F.lit(17)), r"^\s+", "")).otherwise(x))
    whole = lambda c: F.regexp_replace(F.array_join(c, "\n"), r"^\s+|\s+$", "")
    return F.struct(whole(F.slice(body, 1, upto)).alias("positive"), whole(negative).alias("negative"))


#: Tags that begin a section, those whose section has an argument, those that are dropped, and those that refer.
STAGES = ("base", "refiner", "pixeldecoder", "video", "videoswap")
CONFINED = ("segment", "object", "region", "extend")
DROPPED = ("comment", "break")
REFERENCES = ("lora", "embed", "embedding", "preset", "trigger")


def sections(text: str | None) -> list[dict]:
    """The sections of a staged prompt: the main one, then one for each tag of STAGES or CONFINED that has text.

    Tags nest, so what ends a tag is found by depth; a tag that nothing ends is text.
    """
    import re

    out: list[dict] = []
    kind, spec, held = "main", None, []

    def close() -> None:
        body = " ".join("".join(held).split())
        if body or kind == "main":
            out.append({"ordinal": len(out), "kind": kind, "spec": spec, "text": body})
        held.clear()

    text, at = text or "", 0
    while (begin := text.find("<", at)) >= 0:
        held.append(text[at:begin])
        depth, end, colon = 0, -1, -1
        for m in re.finditer("[<>:]", text[begin:]):
            if m[0] == ":":
                colon = begin + m.start() if colon < 0 and depth == 1 else colon
                continue
            depth += 1 if m[0] == "<" else -1
            if depth == 0:
                end = begin + m.start()
                break
        if end < 0:
            at = begin
            break
        name = re.sub(r"//cid=\d+$", "", text[begin + 1 : colon if colon >= 0 else end])
        data = re.sub(r"//cid=\d+$", "", text[colon + 1 : end]) if colon >= 0 else None
        name = (name[: name.find("[")] if name.endswith("]") and "[" in name else name).strip().lower()
        if name in STAGES or name in CONFINED:
            close()
            kind, spec = name, data if name in CONFINED else None
        else:
            held.append(" " if name in DROPPED or name in REFERENCES else text[begin : end + 1])
        at = end + 1
    held.append(text[at:])
    close()
    return out


def prompt_sections(text: Column) -> Column:
    """Array of `sections`; nested tags are beyond regular expressions."""
    import pandas as pd

    ddl = "array<struct<ordinal: int, kind: string, spec: string, text: string>>"
    return F.pandas_udf(lambda rows: pd.Series([sections(x) for x in rows], dtype=object), ddl)(text)


def url_parts(url: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(url, r"^([^:]+)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def canonical_query(query: Column) -> Column:
    """The one spelling of a query string: pairs decoded and encoded alike, without nameless ones and repeats, in order."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("v")))
    held = F.array_sort(F.array_distinct(F.filter(pairs, lambda p: F.coalesce(p["k"], F.lit("")) != "")))
    return F.array_join(F.transform(held, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(F.coalesce(p["v"], F.lit(""))))), "&")


def word_line(text: Column) -> Column:
    """The words of a text in lower case, a space before and behind each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def matches(line: Column, asked: str, how: str) -> Column:
    """Whether a word_line has all of the asked words, any of them, or them as a phrase."""
    words = asked.lower().split()
    if how == "phrase":
        return line.contains(f" {' '.join(words)} ")
    out = F.lit(how == "all")
    for w in words:
        out = (out & line.contains(f" {w} ")) if how == "all" else (out | line.contains(f" {w} "))
    return out


def redacted(text: Column, pattern: str = r"(?i)token|secret|password|api.?key") -> Column:
    """A JSON text with the values of keys that `pattern` finds hidden, at any depth; what is no JSON stays."""
    import json
    import re

    import pandas as pd

    known = re.compile(pattern)

    def hide(value: object) -> object:
        if isinstance(value, dict):
            return {k: "***" if known.search(k) else hide(v) for k, v in value.items()}
        return [hide(v) for v in value] if isinstance(value, list) else value

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else json.dumps(hide(json.loads(raw)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return raw

    return F.pandas_udf(lambda rows: pd.Series([one(x) for x in rows], dtype=object), "string")(text)


def name_in_phrase(phrases: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """phrase_id, slug, name, rest: the longest name of a phrase, in whole words and any case, and what the phrase says besides.

    Runs of up to `most` words meet names by equality, so no phrase is compared with every name.
    phrases: phrase_id, phrase; names: slug, name.
    """
    words = F.filter(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = phrases.select("phrase_id", words.alias("w")).where(F.size("w") > 0)
    starts = split.select("phrase_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("phrase_id", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("i") + 1))).alias("n"))
    runs = runs.withColumn("key", F.array_join(F.slice("w", F.col("i"), F.col("n")), " "))
    keyed = names.withColumn("key", F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " ")))
    best = runs.join(keyed, "key").groupBy("phrase_id").agg(F.max_by(F.struct("slug", "name", "w", "i", "n"), F.struct(F.length("key"), -F.col("i"), F.col("slug"))).alias("b"))
    rest = F.concat(F.slice("b.w", F.lit(1), F.col("b.i") - 1), F.slice("b.w", F.col("b.i") + F.col("b.n"), F.size("b.w")))
    return best.select("phrase_id", "b.slug", "b.name", F.array_join(rest, " ").alias("rest"))
