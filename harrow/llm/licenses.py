"""License scan: an exact set-similarity join of text blocks against templates.

A block is any run of consecutive words of a paragraph, of a template's ``span``:
as many words as leave the template's own the threshold's share. Lines may end
anywhere in it; paragraphs end at blank lines. A template is met when a block holds
at least ``threshold`` of its words, and of those of its words that no other
template has, so that a notice without its name is no notice of that name.

Tokens are ordered by their document frequency over all texts, rarest first. A
template's prefix are its ``size - need + 1`` rarest tokens: a block that meets it
holds one of them. An index leads from prefix tokens to templates, so a paragraph
meets only templates that it shares one with; the length filter (enough of the
template's words in the paragraph at all) comes next, and the positional filter:
only blocks around the prefix tokens' places are read, which begin at a template
word. Every qualifying pair is found, and most paragraphs stop at one small
intersection.

Templates are parameters, so their size is bounded; texts are never shuffled,
and only one count per template token comes back to the driver.

Defined results: null and empty texts have no words and no labels; whole texts
are scanned; a template that several paragraphs meet is given for each of them,
with its best block's score; repeated rows repeat their result; other columns pass
through, whatever their names, but one with the name of an output, which is a
parameter, is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import fresh

THRESHOLD = 0.8
#: Phrases whose words must stand consecutively, and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label and words of a license notice (fixed values).
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-line", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD_OR_LINE = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same wherever the text is ASCII, and is much faster there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def worded(text: Column) -> Column:
    """The words of each line, one space between them, lines apart by newline."""
    return F.regexp_replace(ascii_lower(text), NOT_WORD_OR_LINE, " ")


def token_order(words: DataFrame, lines: str, templates=TEMPLATES) -> list[str]:
    """Template tokens by document frequency over all texts, rarest first (ties by token)."""
    tokens = sorted({t for _, words_ in templates for t in words_.split()})
    known = F.array(*map(F.lit, tokens))
    held = words.select(F.explode(F.array_intersect(known, F.split(lines, "[ \\n]+"))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per template token
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def own_words(templates=TEMPLATES) -> dict[tuple[str, str], set[str]]:
    """Per template its words that no other has."""
    sets = {t: set(t[1].split()) for t in templates}
    return {t: words - set().union(*(other for u, other in sets.items() if u != t)) for t, words in sets.items()}


def at_least(threshold: float, n: int) -> int:
    return -int(-threshold * n // 1)


def span_of(words: str, threshold: float = THRESHOLD) -> int:
    """Words of a block: the template's are the threshold's share of them."""
    return -int(-len(words.split()) / threshold // 1)


def matches(lines: Column, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<label, score>>: every (paragraph, template) pair with a block that meets the threshold, and its best score."""
    rank = {t: i for i, t in enumerate(order)}
    arr = lambda ts: F.array(*map(F.lit, ts)) if ts else F.array().cast("array<string>")
    own, plans, index = own_words(templates), [], {}
    for k, (label, words) in enumerate(templates):
        tokens = sorted(set(words.split()), key=rank.__getitem__)
        need = at_least(threshold, len(tokens))
        prefix, marks = tokens[: len(tokens) - need + 1], sorted(own[label, words])
        for t in prefix:
            index.setdefault(t, []).append(k)
        fields = {"label": F.lit(label), "tokens": arr(tokens), "need": F.lit(need), "prefix": arr(prefix), "marks": arr(marks), "few": F.lit(at_least(threshold, len(marks))), "span": F.lit(span_of(words, threshold))}
        plans.append(F.struct(*[v.alias(c) for c, v in fields.items()]))
    rare = sorted(index, key=rank.__getitem__)
    prefixes, postings, every = arr(rare), F.array(*[F.array(*map(F.lit, index[t])) for t in rare]), F.array(*plans)
    words_of = lambda text: F.split(F.trim(text), "[ \\n]+")

    def blocks(words: Column, plan: Column) -> Column:
        """The best score of the blocks that begin at a template word and hold a prefix token; null if none meets the threshold."""
        places = lambda tokens: F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(tokens, w), i)), lambda i: i.isNotNull())

        def around(at: Column) -> Column:
            seeds, starts = at["seeds"], at["starts"]
            near = F.filter(starts, lambda i: F.exists(seeds, lambda p: (p >= i) & (p < i + plan["span"])))
            read = F.transform(near, lambda i: F.slice(words, i + 1, plan["span"]))
            both = lambda block: F.size(F.array_intersect(plan["tokens"], block))
            good = F.filter(read, lambda block: (both(block) >= plan["need"]) & (F.size(F.array_intersect(plan["marks"], block)) >= plan["few"]))
            return F.array_max(F.transform(good, both))

        return F.get(F.transform(F.array(F.struct(places(plan["prefix"]).alias("seeds"), places(plan["tokens"]).alias("starts"))), around), F.lit(0))

    def met(words: Column) -> Column:
        shared = F.transform(F.array_intersect(prefixes, words), lambda t: F.get(postings, F.array_position(prefixes, t).cast("int") - 1))
        likely = F.filter(F.transform(F.array_distinct(F.flatten(shared)), lambda k: F.get(every, k)), lambda p: F.size(F.array_intersect(p["tokens"], words)) >= p["need"])
        scored = F.transform(likely, lambda p: F.struct(p["label"].alias("label"), (blocks(words, p) / F.size(p["tokens"])).alias("score")))
        return F.filter(scored, lambda m: m["score"].isNotNull())

    paragraphs = F.filter(F.transform(F.split(lines, "\\n *(?:\\n *)+"), words_of), lambda ws: F.arrays_overlap(ws, prefixes))
    return F.flatten(F.transform(paragraphs, met))


def phrase_places(text: Column, phrases=PHRASES) -> Column:
    """array<struct<place, label>> of all places of the phrases; ``text``: words with one space between."""
    kind = "array<struct<place:int,label:string>>"

    def places(words: list[str], label: str):
        def of(array: Column) -> Column:  # bound once: an expression would be split anew for every word
            hits = F.filter(F.sequence(F.lit(0), F.size(array) - len(words)), lambda i: _all([F.get(array, i + k) == w for k, w in enumerate(words)]))
            return F.transform(hits, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label")))

        return of

    out = []
    for phrase, label in phrases.items():
        here = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} "))
        found = F.flatten(F.transform(F.array(F.split(text, " ")), places(phrase.split(), label)))
        out.append(F.when(here, found).otherwise(F.array().cast(kind)))
    return F.concat(*out)


def _all(conditions: list[Column]) -> Column:
    all_, *rest = conditions
    for c in rest:
        all_ = all_ & c
    return all_


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, n_words: str = "n_words", places: str = "places", matched: str = "matches") -> DataFrame:
    """Add the number of words, the phrases' places and the templates met."""
    order = token_order(df.select(worded(F.col(text)).alias("lines")), "lines", templates)
    lines = fresh(df, "_lines")
    words = fresh(df, "_words")
    with_lines = df.withColumn(lines, worded(F.col(text)))
    with_words = with_lines.withColumn(words, F.trim(F.regexp_replace(lines, " *\\n[ \\n]*", " ")))
    n = F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1
    found = {n_words: F.when(F.col(words) == "", 0).otherwise(n).cast("long"), places: phrase_places(F.col(words)), matched: matches(F.col(lines), order, templates, threshold)}
    return with_words.withColumns(found).drop(lines, words)
