"""License scans by an exact set-similarity join, in DataFrame functions alone.

Text blocks, overlapping windows of the words of the whole text wherever its lines end, are joined with license templates: a block
matches a template if it holds at least ``THRESHOLD`` of the template's distinct words, or all of them where there are fewer than
``SHORT``. A window is twice as long as the templates it serves, so a notice that stands in one piece lies whole in one.

The words of all templates are put in one global order, rarest in the corpus first, and a block's template words follow it. Blocks and
templates are joined on the words of their prefixes: of so many first words that two sets without a common one there can't share enough
(prefix filter). Blocks with too few template words in all go (length filter), and pairs where too few words can stand before and behind
a shared one (positional filter). What is left is decided on the full sets. Each filter is exact, so every block that meets the threshold
is found. Of licenses whose notices differ in a word or two, a block counts for one only if it holds the words that tell it and none that
tell another (``TELLING``); the words of a match may stand in any order. The templates are a fixed small side; rows of the corpus move only if a block of theirs passes the filters.

Defined cases: a null or empty text has no words, no labels and score 0; equal rows give equal results; every row of the input gives one
row, also without doc_id; other columns are ignored. In an empty table word counts are 0 and the order is alphabetical.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Openings of public license texts and notices, in words of a-z and 0-9.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-line": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-line": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "hpnd": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "cc0": "to the extent possible under law has waived all copyright and related or neighboring rights to this work",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
}
# Words that tell licenses of nearly equal words apart: those that a block must hold, and those that it must not.
TELLING = {
    "gpl": ((), ("lesser", "affero")), "gpl-line": ((), ("lesser", "affero")), "lgpl": (("lesser",), ()), "agpl": (("affero",), ()), "isc": ((), ("documentation",)), "hpnd": (("documentation",), ()),
    "cc-by-sa": (("sharealike",), ("noncommercial", "noderivatives")), "cc-by-nc": (("noncommercial",), ("sharealike", "noderivatives")), "cc-by-nc-line": ((), ("sa", "nd")), "cc-by-nc-sa": (("noncommercial", "sharealike"), ("noderivatives",)),
}
THRESHOLD = 0.8
#: A template of fewer distinct words must be held whole: one word may be all that tells it from another license.
SHORT = 16
#: Words of a window; windows overlap by half, and a template goes with the least window of twice its words.
WIDTHS = (16, 32, 64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """A-Z as a-z, and other letters somehow, but none of them as a-z: words of a-z and 0-9 are as they would be with A-Z alone.

    Of all characters the Kelvin sign alone becomes a letter of a-z when lowered; a text that holds it takes the slow, literal way.
    """
    return F.when(F.contains(text, F.lit("\u212a")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary, rarest first by the number of documents of the whole table that hold each word; ties by alphabet."""
    text = plain(F.col("text").cast("string"))
    held = F.array_intersect(_strings(vocabulary), F.split(text, BETWEEN))
    found = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # one row a word of the vocabulary
    n = dict(map(tuple, found))
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def need(words: Sequence[str], threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return len(words) if len(words) < SHORT else ceil(threshold * len(words) - 1e-9)


def width(template: str) -> int:
    n = 2 * len(template.split())
    return next((w for w in WIDTHS if w >= n), 2 * n)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, telling: Mapping[str, tuple[Sequence[str], Sequence[str]]] = TELLING) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A template's name up to ``-line`` is its label. ``score`` is the largest containment found, 1 with a base phrase.
    """
    sets = {name: sorted(set(text.split())) for name, text in templates.items()}
    marks = {w for name in templates for words in telling.get(name, ((), ())) for w in words}
    order = word_order(docs, sorted({*marks, *(w for s in sets.values() for w in s)}))
    rank = {w: i for i, w in enumerate(order)}
    sets = {name: sorted(s, key=rank.__getitem__) for name, s in sets.items()}
    prefixes = sorted({w for s in sets.values() for w in s[: len(s) - need(s, threshold) + 1]}, key=rank.__getitem__)

    # cheap for every row: words once (explode keeps them from being split again where they are used), their number, and one set test
    text = plain(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("low")).select("doc_id", "low", F.explode(F.array(F.split("low", BETWEEN))).alias("words"))
    edges = (F.element_at("words", 1) == "").cast("int") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    rarest = [min(p.split(), key=lambda w: (rank.get(w, -1), w)) for p in phrases]
    may_hold = F.arrays_overlap("words", _strings(sorted({*prefixes, *rarest}))) if prefixes or rarest else F.lit(False)
    rows = rows.select("doc_id", (F.size("words") - edges).cast("long").alias("n_words"), F.when(may_hold, F.col("low")).alias("low"), F.when(may_hold, F.filter("words", lambda w: w != "")).alias("words"))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(1), F.size("words") - len(parts) + 1), lambda i: (F.element_at("words", i) == parts[0]) & (F.slice("words", i, len(parts)) == _strings(parts)))
        whole = (F.size("words") >= len(parts)) & (F.size(F.array_intersect("words", _strings(parts))) == len(set(parts)))
        return F.when(whole, at).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<array<int>>")
    rows = rows.select("doc_id", "n_words", "words", F.when(F.col("words").isNotNull(), F.array(*[places(p) for p in phrases])).otherwise(none).alias("places"))
    base = F.filter(F.transform(F.arrays_zip(F.col("places").alias("p"), _strings(list(phrases.values())).alias("l")), lambda x: F.when(F.size(x["p"]) > 0, x["l"])), F.isnotnull)

    def windows(w: int) -> Column:
        """Template words of each window, in the global order, if any template of this width can have enough of them."""
        least = min(need(sets[name], threshold) for name, text in templates.items() if width(text) == w)
        at = F.sequence(F.lit(1), F.greatest(F.size("words") - w // 2, F.lit(1)), F.lit(w // 2))
        held = F.array_distinct(F.filter(F.transform(at, lambda i: F.array_intersect(_strings(order), F.slice("words", i, w))), lambda x: F.size(x) >= least))
        return F.transform(held, lambda x: F.struct(F.lit(w).alias("width"), x.alias("words")))

    widths = sorted({width(text) for text in templates.values()})
    empty = F.array().cast("array<struct<width:int,words:array<string>>>")
    blocks = F.when(F.col("words").isNotNull(), F.concat(*[windows(w) for w in widths])).otherwise(empty) if widths else empty
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.array_sort(F.flatten("places")).alias("at"), F.array_sort(F.array_distinct(base)).alias("base"), blocks.alias("blocks"))
    rows = Scratch(docs.sparkSession, "licenses").save(rows, "blocks")
    found = _join(rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("nth", "block")), templates, sets, threshold, telling)
    rows = rows.drop("blocks").join(found.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), (F.try_element_at("at", F.lit(1)) - 1).cast("long").alias("first_word"),
        (F.try_element_at("at", F.lit(-1)) - 1).cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _join(blocks: DataFrame, templates: Mapping[str, str], sets: Mapping[str, list[str]], threshold: float, telling: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """row, found (labels) and share (largest containment) of rows with a block that matches. ``blocks``: row, nth, block (width, words)."""
    side = [F.struct(F.lit(name).alias("template"), F.lit(name.removesuffix("-line")).alias("label"), F.lit(width(templates[name])).alias("w"), F.lit(need(s, threshold)).alias("need"), _strings(s).alias("own"),
                     *(_strings(w).alias(c) for c, w in zip(("must", "bars"), telling.get(name, ((), ())), strict=True))) for name, s in sets.items()]
    if not side:
        return blocks.select("row", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("share")).limit(0)
    side = blocks.sparkSession.range(1).select(F.explode(F.array(*side)).alias("t")).select("t.*")  # the fixed templates
    prefix = side.select("template", "w", "need", F.size("own").alias("size_own"), F.posexplode(F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)).alias("j", "word"))
    words = blocks.select("row", "nth", "block", F.posexplode("block.words").alias("i", "token"))
    size = F.size("block.words")
    enough = (size >= F.col("need")) & (F.col("i") <= size - F.col("need"))  # length; the block's own prefix
    possible = F.least("i", "j") + 1 + F.least(F.col("size_own") - F.col("j"), size - F.col("i")) - 1 >= F.col("need")
    pairs = words.join(F.broadcast(prefix), (F.col("token") == F.col("word")) & (F.col("block.width") == F.col("w")) & enough & possible)
    pairs = pairs.select("row", "nth", "template", "block.words").dropDuplicates(["row", "nth", "template"])
    shared = F.size(F.array_intersect("own", "words"))
    sure = pairs.join(F.broadcast(side.select(F.col("template").alias("t"), "label", "need", "own", "must", "bars")), F.col("template") == F.col("t")).where(shared >= F.col("need"))
    sure = sure.where((F.size(F.array_intersect("must", "words")) == F.size("must")) & ~F.arrays_overlap("bars", "words"))
    return sure.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(shared / F.size("own")).alias("share"))
