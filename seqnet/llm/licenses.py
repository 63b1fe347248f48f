"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A text is cut into words of lower-case letters and digits and into shingles of five words.
Templates are grouped in classes by their number of shingles.  For each class, windows of a
fixed number of shingles overlap so far that wherever a notice stands, some window holds it
whole and is not much longer.  The MinHash signatures of window and template are compared in
bands of one row each; the number of bands is set so that a window at the least similarity that
counts shares a band with a probability of at least ``COLLISION``.  For every template that a window
retrieves, the share of the template's shingles that the window holds is computed exactly.

Everything is one pass of DataFrame expressions over each row: the text is neither
exploded nor shuffled.  A window whose shingles all are foreign to all templates cannot share
a MinHash with one, so signatures are computed only for windows with some known shingle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, log

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINED = 0.8
COLLISION = 0.999
#: Shingles of all templates together; they are part of the plan, so their number is bounded.
MOST_SHINGLES = 20_000

#: Names and notices of well-known licenses (fixed values: the wording the licenses ask for).
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingle_hash(words: list[str]) -> int:
    """Hash of a shingle: of its words' hashes in turn, each the seed of the next, as Spark chains columns."""
    value = 42
    for word in words:
        value = xxhash.xxh64_intdigest(word.encode(), value)
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Template:
    number: int
    name: str
    shingles: tuple[int, ...]


@dataclass(frozen=True)
class WindowClass:
    """Windows for templates of up to ``longest`` and at least ``shortest`` different shingles."""

    shortest: int
    longest: int

    @property
    def stride(self) -> int:
        return max(1, self.longest // 4)

    @property
    def size(self) -> int:
        return self.longest + self.stride - 1

    @property
    def bands(self) -> int:
        """Bands of one row, so many that the least similar window that counts collides almost surely.

        A window of ``size`` shingles that holds a share ``CONTAINED`` of the shortest template has
        at least this Jaccard similarity.
        """
        common = ceil(CONTAINED * self.shortest)
        least = common / (self.size + self.shortest - common)
        return 1 if least >= 1 else ceil(log(1 - COLLISION) / log(1 - least))


def templates_of(notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Template]:
    """The notices that have at least one shingle; shorter ones cannot be scanned for."""
    out = []
    for number, (name, text) in enumerate(notices):
        words = words_of(text)
        shingles = sorted({shingle_hash(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)})
        if shingles:
            out.append(Template(number, name, tuple(shingles)))
    if sum(len(t.shingles) for t in out) > MOST_SHINGLES:
        raise ValueError(f"templates have more than {MOST_SHINGLES} shingles")
    return out


def classes_of(templates: list[Template]) -> list[tuple[WindowClass, list[Template]]]:
    """Templates whose lengths lie within a third of each other share windows."""
    out: list[list[Template]] = []
    for template in sorted(templates, key=lambda t: len(t.shingles)):
        if out and 3 * len(template.shingles) <= 4 * len(out[-1][0].shingles):
            out[-1].append(template)
        else:
            out.append([template])
    return [(WindowClass(len(group[0].shingles), len(group[-1].shingles)), group) for group in out]


def permuted(value: int, band: int) -> int:
    """A shingle's place in the band's order: its hash that seeds the band's, as Spark chains columns."""
    first = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), 42)
    found = xxhash.xxh64_intdigest(band.to_bytes(4, "little", signed=True), first)
    return found - (1 << 64) if found >> 63 else found


def longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def once(expression: Column) -> Column:
    """The expression as a generated column, so that filters above do not compute it again."""
    return F.explode(F.array(expression))


def scan(docs: DataFrame, text: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``doc_id, template, license, first_word, containment, windows`` of each notice found in each row.

    ``containment`` is the largest share of the template's shingles in one window, at least 0.8;
    ``first_word`` the word (from 0) with which the first such window starts, and ``windows`` how
    many there are.  Null and empty texts, and those of fewer than five words, hold nothing.
    Null ids, repeated rows and ties are scanned row by row; other columns are ignored, an
    empty table gives an empty result.
    """
    templates = templates_of(notices)
    known = sorted({s for t in templates for s in t.shingles})
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9]+")
    rows = docs.select("doc_id", once(F.transform(F.filter(parts, lambda w: w != ""), F.lower)).alias("words"))
    last = F.size("words") - (WIDTH - 1)
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WIDTH)]))
    rows = rows.select("doc_id", once(hashes).alias("hashes"))
    hits = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "hashes", once(hits).alias("hits")).filter(F.size("hits") > 0)
    groups = classes_of(templates)
    rows = rows.select("doc_id", *[once(windows_of(window)).alias(f"windows_{k}") for k, (window, _) in enumerate(groups[:1])], "hashes", "hits")
    for k, (window, _) in enumerate(groups[1:], 1):
        rows = rows.select("*", once(windows_of(window)).alias(f"windows_{k}"))
    found = [match(t, window, F.col(f"windows_{k}")) for k, (window, group) in enumerate(groups) for t in group]
    rows = rows.select("doc_id", F.inline(F.filter(F.array(*found), lambda m: m["windows"] > 0)))
    return rows.select("doc_id", "template", "license", "first_word", "containment", "windows")


def windows_of(window: WindowClass) -> Column:
    """The windows of one class that hold a known shingle: number, different shingles, signature."""

    def holding(hit: Column) -> Column:
        first = F.ceil((hit - (window.size - 1)) / F.lit(window.stride)).cast("int")
        return F.sequence(F.greatest(F.lit(0), first), F.floor(hit / F.lit(window.stride)).cast("int"))

    def described(number: Column) -> Column:
        shingles = F.array_distinct(F.slice("hashes", number * window.stride + 1, window.size))
        bands = F.array(*[F.lit(b) for b in range(window.bands)])
        signature = F.transform(bands, lambda band: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band))))
        return F.struct(number.alias("number"), shingles.alias("shingles"), signature.alias("signature"))

    return F.transform(F.array_distinct(F.flatten(F.transform("hits", holding))), described)


def match(template: Template, window: WindowClass, windows: Column) -> Column:
    """What one template finds among the windows: first word, largest containment, number of windows."""
    signature = longs([min(permuted(s, band) for s in template.shingles) for band in range(window.bands)])
    own = longs(template.shingles)
    retrieved = F.filter(windows, lambda w: F.arrays_overlap(w["signature"], signature))
    shares = F.transform(
        retrieved,
        lambda w: F.struct(
            w["number"].alias("number"), (F.size(F.array_intersect(w["shingles"], own)) / F.lit(len(template.shingles))).alias("share")
        ),
    )
    good = F.filter(shares, lambda w: w["share"] >= CONTAINED)
    return F.struct(
        F.lit(template.number).alias("template"),
        F.lit(template.name).alias("license"),
        (F.array_min(F.transform(good, lambda w: w["number"])) * window.stride).alias("first_word"),
        F.array_max(F.transform(good, lambda w: w["share"])).alias("containment"),
        F.size(good).alias("windows"),
    )


def oracle(notices: tuple[tuple[str, str], ...] = NOTICES) -> str:
    """The same result by joining every shingle with the templates', without signatures."""
    values = []
    for window, group in classes_of(templates_of(notices)):
        for t in group:
            words = words_of(notices[t.number][1])
            shingles = {" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}
            values += [f"({t.number}, '{t.name}', {len(shingles)}, {window.size}, {window.stride}, '{s}')" for s in sorted(shingles)]
    return f"""
        WITH templates(template, license, n, size, stride, shingle) AS (VALUES {", ".join(values)}),
        docs AS (
            SELECT row_number() OVER () AS row_id, doc_id,
                [lower(w) FOR w IN string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+') IF w <> ''] AS words
            FROM documents
        ),
        shingles AS (
            SELECT row_id, doc_id, unnest(range(0, len(words) - {WIDTH - 1})) AS place,
                unnest([array_to_string(words[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, len(words) - {WIDTH - 2})]) AS shingle
            FROM docs WHERE len(words) >= {WIDTH}
        ),
        hits AS (
            SELECT row_id, doc_id, template, license, n, stride, shingle,
                unnest(range(greatest(0, CAST(ceil((place - size + 1) / stride) AS BIGINT)), CAST(floor(place / stride) AS BIGINT) + 1)) AS number
            FROM shingles JOIN templates USING (shingle)
        ),
        held AS (
            SELECT row_id, doc_id, template, license, stride, number, count(DISTINCT shingle) / n AS share
            FROM hits GROUP BY row_id, doc_id, template, license, n, stride, number
        )
        SELECT doc_id, template, license, CAST(min(number) * stride AS INTEGER) AS first_word, max(share) AS containment,
            CAST(count(*) AS INTEGER) AS windows
        FROM held WHERE share >= {CONTAINED} GROUP BY row_id, doc_id, template, license, stride
    """
