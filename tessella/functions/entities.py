"""Entities with offsets, overlap merging, grouping and counts."""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.segment import let
from tessella.lexicons import ENTITY_OFFSET_PATTERNS, ENTITY_TERMS, TAGGER_LABELS

FORM = "array<struct<text:string,type:string,start:int,end:int,confidence:double,source:string>>"


def _at(text: Column, pattern: str, kind: str, confidence: float, source: str) -> Column:
    """Matches of one pattern with code point offsets: lengths of the pieces between matches, summed in one fold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        item = F.struct(x["m"].alias("text"), F.lit(kind).alias("type"), start.alias("start"), end.alias("end"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(FORM).alias("out")), step, lambda a: a["out"])


def needed(pattern: str) -> frozenset[str] | None:
    """Characters of which every match of a pattern holds one; None where that is not known."""
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return None
    return None if parsed.state.flags & re.IGNORECASE else _needed(parsed)


def _needed(parsed) -> frozenset[str] | None:
    sets = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            sets.append(frozenset(chr(arg)))
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            spans = [(a, a) if str(o) == "LITERAL" else a for o, a in arg]
            if sum(b - a + 1 for a, b in spans) <= 64:
                sets.append(frozenset(chr(c) for a, b in spans for c in range(a, b + 1)))
        elif name == "SUBPATTERN" and not arg[1]:
            sets.append(_needed(arg[-1]))
        elif name == "MAX_REPEAT" and arg[0] > 0:
            sets.append(_needed(arg[2]))
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            sets.append(None if None in each else frozenset().union(*each))
    return min((x for x in sets if x), key=lambda x: (any(c.isascii() and c.isalnum() for c in x), len(x)), default=None)


def _guarded(text: Column, pattern: str, found: Column) -> Column:
    """found, or nothing without a search where no match can be: a run of letters before a rare word is tried from each of
    its letters."""
    some = needed(pattern)
    return F.when(text.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(some)) + "]"), found).otherwise(F.array().cast(FORM)) if some else found


def pattern_entities(text: Column, patterns: dict[str, list[str]] = ENTITY_OFFSET_PATTERNS, confidence: float = 0.7) -> Column:
    each = [_guarded(text, p, _at(text, p, kind, confidence, "regex")) for kind, ps in patterns.items() for p in ps]
    return F.concat(*each)


def dictionary_entities(text: Column, terms: dict[str, list[str]] = ENTITY_TERMS, confidence: float = 0.9) -> Column:
    """Every occurrence of every term, overlapping ones included; texts without a term skip it."""
    parts = []
    for kind, words in terms.items():
        for w in words:
            parts.append(F.when(text.contains(w), F.transform(_starts(text, w), _term(w, kind, confidence))).otherwise(F.array().cast(FORM)))
    return F.concat(*parts) if parts else F.array().cast(FORM)


def _starts(text: Column, term: str) -> Column:
    """Start offsets of all occurrences of a term, overlapping ones included: the text is split before each, and piece
    lengths are summed in one fold."""
    import re

    pieces = F.split(text, f"(?={re.escape(term)})", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    at = F.aggregate(pieces, start, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    return F.filter(at, lambda i: (i > 0) | text.startswith(term))


def _term(word: str, kind: str, confidence: float):
    return lambda i: F.struct(F.lit(word).alias("text"), F.lit(kind).alias("type"), i.alias("start"), (i + len(word)).alias("end"), F.lit(confidence).alias("confidence"), F.lit("dictionary").alias("source"))


def merge(entities: Column) -> Column:
    """Sweep in (start, end) order; of overlapping neighbours the higher confidence stays, then the longer, then the
    earlier one."""
    ordered = F.array_sort(
        F.transform(entities, lambda e: F.struct(e["start"].alias("s"), e["end"].alias("x"), (-e["confidence"]).alias("c"), e.alias("e")))
    )
    return let(F.transform(ordered, lambda o: o["e"]), _sweep)


def _sweep(es: Column) -> Column:

    def step(acc: Column, e: Column) -> Column:
        cur = acc["cur"]
        overlap = e["start"] < cur["end"]
        better = (e["confidence"] > cur["confidence"]) | ((e["confidence"] == cur["confidence"]) & (e["end"] - e["start"] > cur["end"] - cur["start"]))
        return F.struct(F.when(overlap & ~better, cur).otherwise(e).alias("cur"), F.when(overlap, acc["out"]).otherwise(F.concat(acc["out"], F.array(cur))).alias("out"))

    start = F.struct(F.get(es, 0).alias("cur"), F.array().cast(FORM).alias("out"))
    swept = F.aggregate(F.slice(es, F.lit(2), F.greatest(F.size(es) - 1, F.lit(0))), start, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    return F.when(F.size(es) > 0, swept).otherwise(F.array().cast(FORM))


def recognize(text: Column, patterns: dict = ENTITY_OFFSET_PATTERNS, terms: dict = ENTITY_TERMS, extra: Column | None = None) -> Column:
    """Pattern, dictionary and optional tagger entities, merged."""
    more = [extra.cast(FORM)] if extra is not None else []
    return merge(let(text, lambda t: F.concat(pattern_entities(t, patterns), dictionary_entities(t, terms), *more)))


def tagger_type(label: Column) -> Column:
    """The entity type of an external tagger's label; unknown labels are lower-cased."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TAGGER_LABELS.items() for x in kv]), label), F.lower(label))


def group_by_type(entities: Column) -> Column:
    kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.filter(entities, lambda e: e["type"] == k))))


def entity_stats(df: DataFrame, entities: str = "entities") -> DataFrame:
    """type, source, n, avg_confidence by type, by source and in total (nulls), in one pass."""
    e = df.select(F.explode(entities).alias("e")).select("e.type", "e.source", "e.confidence")
    return e.groupingSets([["type"], ["source"], []], "type", "source").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def top_entities(df: DataFrame, entities: str = "entities", k: int = 10) -> DataFrame:
    """Commonest (text, type) pairs; two columns, so a name may contain any character."""
    e = df.select(F.explode(entities).alias("e"))
    return e.groupBy(F.col("e.text").alias("text"), F.col("e.type").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text", "type").limit(k)
