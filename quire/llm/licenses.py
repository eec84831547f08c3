"""License scan by a positional index of rare words, with DataFrame functions only.

One index holds the rarest words of all templates (highest inverse document
frequency in the scanned corpus): for each word the templates and places where
it stands. A file's words in the index are looked up once each; every place of
such a word proposes, by its postings, a template and where it would start. The
proposals are sorted, and a start stands if as many postings agree on it as the
template needs: the fewest that can hold ``NEEDED`` of its rare words' weight.
Only for those are the mandatory phrases compared, word for word, and the weight
of the rare words in place added up. So the work of a file follows its words
and its own hits, not the number of templates.

Everything about a file is computed in its own row, so there is no shuffle but
for the document frequencies (one row per template word).

Null and empty texts have no words and no labels. Rows that repeat a document
are scanned each on their own. An empty table gives no rows. Templates that
match equally well all give their label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE = 4
NEEDED = 0.75
ORIGIN = 1 << 20  # more than the words of a template


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]  # mandatory, each a part of the text


# Phrases that are labels by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices of public licences.
TEMPLATES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and or distribute this software",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    Template("creative-commons", "licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is "
             "distributed on an as is basis without warranties or conditions of any kind either express or implied",
             ("unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
             "warranties of merchantability fitness for a particular purpose and noninfringement",
             ("without warranty of any kind express or implied", "fitness for a particular purpose and noninfringement")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission",
             ("endorse or promote products derived from this software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable for any damages arising from the use of this software", ("without any express or implied warranty",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation", ("gnu lesser general public license as published",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation", ("gnu general public license as published",)),
)


def words_of(text: Column) -> Column:
    """The words of a lower-case text: runs of anything but ASCII signs and white space."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def with_words(docs: DataFrame) -> DataFrame:
    # Lower case changes no separator, and of the characters that it makes ASCII letters of others only the
    # Kelvin sign (a k), which no base phrase has.
    return docs.withColumn("_text", F.lower(F.coalesce(F.col("text"), F.lit("")))).withColumn("_words", words_of(F.col("_text")))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the (bounded) vocabulary occurs."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = with_words(docs.select("text")).select(F.explode(F.array_intersect(known, F.col("_words"))).alias("word"))
    counts = {r["word"]: int(r["n"]) for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


@dataclass(frozen=True)
class Rare:
    """A template's rare words with their places and shares of weight, and how many of them must be in place."""
    template: Template
    places: tuple[tuple[str, int, float], ...]

    @property
    def needed(self) -> int:
        shares, n = sorted((s for *_, s in self.places), reverse=True), 1
        while sum(shares[:n]) < NEEDED - 1e-9 and n < len(shares):
            n += 1
        return n

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Each mandatory phrase's first place in the template, and its words."""
        words = self.template.text.split()
        own = [p.split() for p in self.template.phrases]
        return [(next(k for k in range(len(words)) if words[k:k + len(p)] == p), p) for p in own]


def build_index(templates: tuple[Template, ...], df: dict[str, int], documents: int, rare: int = RARE) -> list[Rare]:
    out = []
    for t in templates:
        words = t.text.split()
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        best = sorted(first, key=lambda w: (df.get(w, 0), first[w]))[:rare]
        idf = [math.log((documents + 1) / (df.get(w, 0) + 0.5)) for w in best]
        total = sum(idf)
        out.append(Rare(t, tuple((w, first[w], x / total if total > 0 else 1 / len(best)) for w, x in zip(best, idf))))
    return out


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def phrase_places(words: list[str]) -> Column:
    """Where the words stand consecutively."""
    span = F.sequence(F.lit(0), F.size("_words") - len(words))
    return F.filter(span, lambda i: _all([F.get(F.col("_words"), i + k) == w for k, w in enumerate(words)]))


def _none() -> Column:
    return F.array().cast("array<int>")


def places_if(words: list[str], holds: Column) -> Column:
    """``phrase_places`` in texts where it can be: those that hold the longest word and have words enough."""
    longest = max(words, key=len)
    return F.when(holds & F.contains(F.col("_text"), F.lit(longest)) & (F.size("_words") >= len(words)),
                  phrase_places(words)).otherwise(_none())


def _list(values: list, kind: str) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


def proposals(index: list[Rare], df: dict[str, int]) -> tuple[Column, Column, Column]:
    """(``_found``: the file's words in the index, rarest first; ``_own``: their postings; ``_starts``: a sorted number
    for each template and start that a place of one proposes), each over the columns before it and ``_words``.

    The number is the template's in the high half and the start, moved by ``ORIGIN``, in the low half.
    """
    postings: dict[str, list[int]] = {}
    for t, rare in enumerate(index):
        for word, place, _ in rare.places:
            postings.setdefault(word, []).append((t << 32) + ORIGIN - place)
    words = sorted(postings, key=lambda w: (df.get(w, 0), w))
    found = F.array_intersect(F.array(*[F.lit(w) for w in words]), F.col("_words"))
    table = F.create_map(*[c for w in words for c in (F.lit(w), _list([F.lit(p) for p in postings[w]], "bigint"))])
    own = F.transform("_found", lambda w: F.element_at(table, w))
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(F.array_position("_found", w).cast("int").alias("k"), i.alias("i"))),
                    lambda h: h["k"] > 0)
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.get(F.col("_own"), h["k"] - 1), lambda p: p + h["i"])))
    return found, own, F.array_sort(starts)


def matches(index: list[Rare]) -> Column:
    """(template, share of the weight of its rare words in place) of the ``_starts`` that stand, mandatory phrases and all."""
    needed = _list([F.lit(r.needed) for r in index], "int")
    phrases = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), _list([F.lit(w) for w in p], "string").alias("words"))
                                  for at, p in r.phrases]) for r in index])
    rare = F.array(*[F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("place"), F.lit(float(x)).alias("share"))
                               for w, p, x in r.places]) for r in index])

    def template(c: Column) -> Column:
        return F.shiftright(c, 32).cast("int")

    def start(c: Column) -> Column:
        return c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - ORIGIN

    def stands(c: Column) -> Column:
        return F.forall(F.get(phrases, template(c)), lambda p: F.when(start(c) + p["at"] >= 0, F.slice(
            F.col("_words"), F.greatest(start(c) + p["at"], F.lit(0)) + 1, F.size(p["words"])) == p["words"]).otherwise(False))

    def share(c: Column) -> Column:
        return F.aggregate(F.get(rare, template(c)), F.lit(0.0), lambda total, r: total + F.when(
            F.get(F.col("_words"), start(c) + r["place"]) == r["word"], r["share"]).otherwise(0.0))

    agreed = F.filter("_starts", lambda c, i: F.get(F.col("_starts"), i + F.get(needed, template(c)) - 1) == c)
    return F.filter(F.transform(F.filter(F.array_distinct(agreed), stands), lambda c: F.struct(
        template(c).alias("template"), share(c).alias("share"))), lambda m: m["share"] >= NEEDED)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``
    of every row. ``score`` is the best template's share of rare words in place, at least a half beside a phrase."""
    df = document_frequency(docs, sorted({w for t in templates for w in t.text.split()}))
    index = build_index(templates, df, docs.count())
    rows = with_words(docs.select("doc_id", "text")).drop("text")
    # Nearly all texts hold none of the phrases' longest words and are done with one look.
    rows = rows.withColumn("_any", F.col("_text").rlike("|".join(sorted({max(p.split(), key=len) for p in phrases}))))
    for k, phrase in enumerate(phrases):
        rows = rows.withColumn(f"_p{k}", places_if(phrase.split(), F.col("_any")))
    none = F.array().cast("array<struct<template:int,share:double>>")
    if index:
        found, own, starts = proposals(index, df)
        rows = rows.withColumn("_found", found).withColumn("_own", own)
        rows = rows.withColumn("_starts", F.when(F.size("_found") > 0, starts).otherwise(F.array().cast("array<bigint>")))
        rows = rows.withColumn("_matches", F.when(F.size("_starts") > 0, matches(index)).otherwise(none))
    else:
        rows = rows.withColumn("_matches", none)
    names = F.array(*[F.lit(t.label) for t in templates]).cast("array<string>")
    places = F.flatten(F.array(*[F.col(f"_p{k}") for k in range(len(phrases))]))
    base = F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())])
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), places.alias("_places"),
                       F.array_compact(base).alias("_base"),
                       F.transform("_matches", lambda m: F.get(names, m["template"])).alias("_more"),
                       F.coalesce(F.array_max(F.transform("_matches", lambda m: m["share"])), F.lit(0.0)).alias("_best"))
    labelled = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        labelled(F.col("_base")).alias("base_labels"), labelled(F.concat("_base", "_more")).alias("labels"),
        F.greatest(F.least(F.col("_best"), F.lit(1.0)), F.when(F.size("_base") > 0, 0.5).otherwise(0.0)).alias("score"))
