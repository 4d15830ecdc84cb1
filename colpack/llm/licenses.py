"""License scans by an exact set-similarity join (operator 8), in DataFrame functions only.

A text block meets a template if it contains at least THRESHOLD of the template's different words.
Blocks are the text's lines and, so that notices wrapped over lines are found, for a template of n words
its stretches of 2n words that begin at each n-th word: n words on end always lie in one of them whole.

Template words are ordered by how many documents of the whole table hold them, rarest first.  A block
that misses no more words than allowed holds one of the template's first few words (prefix filter), has
enough template words (length filter) and enough of them from its first common word on (positional
filter); what passes is verified by intersection.  The join goes through an index from prefix words to
templates: a text's own prefix words name the templates it is held against.  The catalogue is fixed, so
that index is a literal, whose size and not the plan grows with it: no text is shuffled or exploded.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base rule and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Templates, which are opening sentences of public licenses and notices, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
}
WORDS = {t: [*dict.fromkeys(t.split())] for t in TEMPLATES}


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased.  lower() does more, but to other words only where it makes ASCII letters."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """Words of a lower-cased text, in order."""
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def word_order(words: DataFrame) -> list[str]:
    """All template words, rarest first by the documents of the whole table that hold them."""
    every = sorted({w for ws in WORDS.values() for w in ws})
    held = words.select(F.explode(F.array_intersect("__words", _strings(every))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # at most as many rows as there are template words
    n = {r["w"]: r["n"] for r in held.collect()}
    return sorted(every, key=lambda w: (n.get(w, 0), w))


class Catalogue:
    """The templates as literal arrays: words in the global order, words needed, and an index from prefix words."""

    def __init__(self, order: list[str]):
        rank = {w: i for i, w in enumerate(order)}
        words = [sorted(ws, key=rank.get) for ws in WORDS.values()]
        need = [math.ceil(THRESHOLD * len(ws)) for ws in words]
        prefixes = [ws[: len(ws) - n + 1] for ws, n in zip(words, need)]
        probes = sorted({w for p in prefixes for w in p})
        owners = [[t for t, p in enumerate(prefixes) if w in p] for w in probes]
        self.order, self.probes = _strings(order), _strings(probes)
        self.owners = F.array(*(F.array(*map(F.lit, o)) for o in owners))
        kinds = zip(words, prefixes, need, (len(t.split()) for t in TEMPLATES), TEMPLATES.values())
        self.templates = F.array(*(F.struct(_strings(w).alias("words"), _strings(p).alias("prefix"), F.lit(n).alias("need"), F.lit(k).alias("step"), F.lit(v).alias("label")) for w, p, n, k, v in kinds))

    def candidates(self, words: Column) -> Column:
        """Templates that have a prefix word among words."""
        held = F.array_intersect(self.probes, words)
        owning = F.flatten(F.transform(held, lambda w: F.get(self.owners, F.array_position(self.probes, w).cast("int") - 1)))
        return F.transform(F.array_distinct(owning), lambda t: F.get(self.templates, t))

    def _common(self, template: Column, held: Column) -> Column:
        """How many of the template's words a block has, or 0 below the threshold; held are its template words in order."""
        first = F.array_intersect(template["prefix"], held)[0]
        left = F.least(F.size(template["words"]) + 1 - F.array_position(template["words"], first), F.size(held) + 1 - F.array_position(held, first))
        common = let(F.size(F.array_intersect(template["words"], held)), lambda n: F.when(n >= template["need"], n).otherwise(0))
        long_enough = (F.size(held) >= template["need"]) & F.arrays_overlap(held, template["prefix"])
        return F.when(long_enough, F.when(left >= template["need"], common)).otherwise(0)

    def met(self, words: Column, lines: Column) -> Column:
        """(label, score) of the templates that some block of the text meets."""

        def best(template: Column, held_lines: Column) -> Column:
            begins = F.sequence(F.lit(0), F.size(words) - 1, template["step"])
            cut = F.transform(begins, lambda i: F.slice(words, i + 1, 2 * template["step"]))
            near = F.transform(F.filter(cut, lambda b: F.arrays_overlap(b, template["prefix"])), lambda b: F.array_intersect(self.order, b))
            most = F.array_max(F.transform(F.concat(held_lines, near), lambda held: F.coalesce(self._common(template, held), F.lit(0))))
            return F.struct(template["label"].alias("label"), (F.coalesce(most, F.lit(0)) / F.size(template["words"])).alias("score"))

        def joined(held_lines: Column) -> Column:
            return F.filter(F.transform(self.candidates(words), lambda t: best(t, held_lines)), lambda m: m["score"] > 0)

        held = F.filter(F.transform(lines, split_words), lambda b: F.arrays_overlap(b, self.probes))
        return let(F.transform(held, lambda b: F.array_intersect(self.order, b)), joined)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of df.

    score is the best containment, 1.0 where a base phrase stands, else 0.0.  A null text is empty:
    no words, null places, empty labels.  Repeated rows and null ids stay rows of their own; other
    columns are not read; an empty table gives no row.
    """
    words = df.select(F.col(id_col).alias("id"), lowered(F.coalesce(F.col(text_col), F.lit(""))).alias("__low")).withColumn("__words", split_words(F.col("__low")))
    catalogue = Catalogue(word_order(words.select("__words")))
    # a text without any prefix word meets no template
    found = words.withColumn("__near", F.arrays_overlap("__words", catalogue.probes))
    no = F.array().cast("array<struct<place:int,label:string>>")

    def at(phrase: str) -> Column:
        parts = phrase.split()
        hit = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.get("__words", i + k) == F.get(_strings(parts), k))
        places = F.filter(F.sequence(F.lit(0), F.size("__words") - len(parts)), hit)
        long_enough = (F.size("__words") >= len(parts)) & F.array_contains("__words", parts[0]) & F.array_contains("__words", parts[-1])
        return F.when(long_enough, F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(PHRASES[phrase]).alias("label")))).otherwise(no)

    sure = F.rlike("__low", F.lit("license|cc[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+by"))
    found = found.withColumn("__places", F.when(sure, F.concat(*map(at, PHRASES))).otherwise(no))
    none = F.array().cast("array<struct<label:string,score:double>>")
    met = catalogue.met(F.col("__words"), F.split("__low", "\n", -1))
    found = found.withColumn("__met", F.when(F.col("__near"), met).otherwise(none))
    places = F.transform("__places", lambda p: p["place"].cast("bigint"))
    base = F.transform("__places", lambda p: p["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("id").alias(id_col),
        F.size("__words").cast("bigint").alias("n_words"),
        F.size("__places").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("__met", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("__places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__met", lambda m: m["score"])), F.lit(0.0))).alias("score"),
    )

