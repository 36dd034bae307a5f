"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions only.

Blocks are the lines of a text, windows around its line feeds, and the text as a whole. A window belongs to a template: it
has as many words before a line feed, and as many after it, as the template has, whatever lines they are on, so the sentence
may be wrapped at any width. It ends at a line without words and at a line that ends in a full stop, exclamation or question
mark. Windows are made of texts that hold enough words of a template. A template of n distinct words is contained in a block that
holds at least ceil(threshold * n) of them. Blocks are reduced to the words that any template has, and words are ordered
by their frequency over all blocks, rare first. A match must share a word among the first of both (prefix filter), the
block must be long enough (length filter), and what follows that word in both must suffice (positional filter); the
candidates left are counted in full. The templates, a list in the code, are the only side that is broadcast.

A phrase is a template of the whole text with threshold 1; an exact check of consecutive words follows.

Null and empty texts have no words, no labels and score 0. Rows repeated with equal id and text get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .rows import ID, TIE, give, keyed, text_of

#: between words, and a character of a word, before A-Z are in lower case
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: the end of a line that ends a sentence
STOP = r"""[.!?][ \t\r)\]"'*]*"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: phrase words and their label
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: sentences by which texts state their license, and a label of the method's own
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit-release",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
THRESHOLD = 0.8
#: more than a text has lines
WINDOW = 1 << 32


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    threshold: float
    whole: bool  # of the text as a whole

    @property
    def distinct(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(self.distinct) - 1e-9)


def templates(phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    own = [Template(tuple(p.split()), label, 1.0, True) for p, label in phrases.items()]
    return own + [Template(tuple(t.split()), label, threshold, False) for t, label in sentences.items()]


def lower_case(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def held_words(known: list[Template]) -> str:
    """A pattern for line feeds and the words of the templates, whole words in any case, grouped by first letter."""
    by: dict[str, set[str]] = {}
    for w in {w for t in known for w in t.words}:
        by.setdefault(w[0], set()).add(w[1:])
    either = "|".join(first + "(?:" + "|".join(sorted(rest, reverse=True)) + ")" for first, rest in sorted(by.items()))
    return rf"\n|(?i)(?<!{WORD})(?:{either})(?!{WORD})"


def blocks(docs: DataFrame, text: str, known: list[Template]) -> DataFrame:
    """``__id, __tie, n_words``, ``blocks`` (number, and the distinct template words held; -1 is the whole text, windows
    of template n are numbered from ``(n + 1) * WINDOW``) and
    ``words`` (null where the text holds too few phrase words). Blocks with too few words for any template are left out."""
    phrase_words = sorted({w for t in known if t.whole for w in t.words})
    sentence_words = sorted({w for t in known if not t.whole for w in t.words})
    least, least_whole = (min([t.need for t in known if t.whole == w], default=1) for w in (False, True))
    body = text_of(text)
    stream = F.lower(F.array_join(F.regexp_extract_all(body, F.lit(held_words(known)), F.lit(0)), " "))
    rows = docs.select(ID, TIE, body.alias("body"), F.size(F.array_remove(F.split(body, SEPARATOR), "")).cast("long").alias("n_words"), stream.alias("s"))
    lines = F.transform(F.split("s", "\n"), lambda line, i: F.struct(i.cast("long").alias("block"), F.split(line, " ").alias("held")))
    lines = F.filter(lines, lambda b: F.size(b["held"]) >= least)
    lines = F.transform(lines, lambda b: F.struct(b["block"].alias("block"), F.array_intersect(b["held"], strings(sentence_words)).alias("held")))
    whole = F.array_intersect(F.split(F.translate("s", "\n", " "), " "), strings(phrase_words))
    held = F.array_intersect(F.split(F.translate("s", "\n", " "), " "), strings(sentence_words))
    rows = rows.select(ID, TIE, "body", "n_words", lines.alias("lines"), whole.alias("whole"), held.alias("sentences"))
    if sentence_words:
        one = lambda n, t: F.struct(F.lit(n).alias("n"), F.lit(len(t.words)).alias("reach"), strings(t.distinct).alias("own"), F.lit(t.need).alias("need"))
        some = F.array(*[one(n, t) for n, t in enumerate(known) if not t.whole])
        some = F.filter(some, lambda t: F.size(F.array_intersect("sentences", t["own"])) >= t["need"])
        wrapped = F.flatten(F.transform(some, lambda t: windows(F.col("body"), t["n"], t["reach"], t["own"], t["need"])))
        rows = rows.withColumn("lines", F.concat("lines", wrapped))
    enough = F.size("whole") >= least_whole
    whole = F.when(enough, F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.col("whole").alias("held"))))
    words = F.when(enough, F.regexp_extract_all(lower_case(F.col("body")), F.lit(WORD + "+"), F.lit(0)))
    found = F.concat(F.filter("lines", lambda b: F.size(b["held"]) >= least), F.coalesce(whole, F.filter("lines", lambda b: F.lit(False))))
    return rows.select(ID, TIE, "n_words", found.alias("blocks"), words.alias("words"))


def windows(body: Column, number: Column, reach: Column, own: Column, need: Column) -> Column:
    """Windows of ``reach`` words on either side of the line feeds within sentences, that hold a template's ``own`` words
    ``need`` times at least."""
    open_ended = F.regexp_replace(body, STOP + r"\n", "\n\n")
    tokens = F.array_join(F.regexp_extract_all(lower_case(open_ended), F.lit(rf"\n|{WORD}+"), F.lit(0)), " ")
    lines = lambda p: F.transform(F.split(F.trim(p), " ?\n ?"), lambda line: F.split(line, " "))
    # each step is an argument of the next, so it is computed once
    made = F.transform(F.split(tokens, r"\n(?: \n)+"), lines)
    ends = lambda line: F.struct(F.slice(line, 1, reach).alias("head"), F.slice(F.reverse(line), 1, reach).alias("tail"))
    made = F.transform(made, lambda p: F.transform(p, ends))

    def around(p: Column, i: Column) -> Column:
        """At most ``reach`` words before the end of line ``i`` (from 0), and after it."""
        before = F.reverse(F.slice(p, F.greatest(i + 2 - reach, F.lit(1)), F.least(i + 1, reach)))
        sides = F.transform(before, lambda x: x["tail"]), F.transform(F.slice(p, i + 2, reach), lambda x: x["head"])
        return F.array_intersect(F.concat(*[F.slice(F.flatten(x), 1, reach) for x in sides]), own)

    each = F.flatten(F.transform(made, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda _, i: around(p, i))))
    first = (number + 1).cast("long") * F.lit(WINDOW)
    return F.transform(F.filter(each, lambda held: F.size(held) >= need), lambda held, i: F.struct((first + i).alias("block"), held.alias("held")))


def frequencies(found: DataFrame, known: list[Template]) -> list[str]:
    """Template words by the number of blocks that hold them, rare first. As many rows as templates have words."""
    held = found.select(F.explode("blocks").alias("b")).select(F.explode("b.held").alias("w"))
    counted = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted({w for t in known for w in t.words}, key=lambda w: (counted.get(w, 0), w))


def join(found: DataFrame, known: list[Template]) -> DataFrame:
    """One row per block and template contained in it: ``__id, __tie, block, template`` (its number), ``share``."""
    spark = found.sparkSession
    order = {w: i for i, w in enumerate(frequencies(found, known))}
    index = []
    for number, t in enumerate(known):
        words = sorted(t.distinct, key=order.__getitem__)
        for i, w in enumerate(words[: len(words) - t.need + 1]):
            index.append((w, number, t.whole, i, len(words), t.need, words))
    index = spark.createDataFrame(index, "w string, template int, whole boolean, i int, size int, need int, all array<string>")
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    each = found.select(ID, TIE, F.explode("blocks").alias("b")).select(ID, TIE, "b.block", "b.held")
    in_order = F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("r"), w.alias("w"))))
    each = each.withColumn("held", F.transform(in_order, lambda x: x["w"]))
    least = F.when(F.col("block") < 0, min([t.need for t in known if t.whole], default=1))
    least = least.otherwise(min([t.need for t in known if not t.whole], default=1))
    prefix = F.slice("held", F.lit(1), F.greatest(F.size("held") - least + 1, F.lit(0)))
    probes = each.select(ID, TIE, "block", "held", F.posexplode(prefix).alias("j", "w"))
    candidates = probes.join(F.broadcast(index), "w").where((F.col("block") < 0) == F.col("whole"))
    candidates = candidates.where((F.col("block") < WINDOW) | (F.floor(F.col("block") / WINDOW) == F.col("template") + 1))
    follow = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    candidates = candidates.where((F.size("held") >= F.col("need")) & (follow >= F.col("need")))
    shared = F.array_intersect("held", "all")
    # the first shared word alone speaks for the pair
    checked = candidates.withColumn("shared", shared).where((F.size("shared") >= F.col("need")) & (F.col("shared")[0] == F.col("w")))
    return checked.select(ID, TIE, "block", "template", (F.size("shared") / F.col("size")).alias("share"))


def places(words: str, phrase: tuple[str, ...]) -> Column:
    """Where the words of the phrase stand consecutively."""
    every = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("w")))

    def start(m: Column) -> Column:
        hit = m["w"] == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(F.col(words), (m["at"] + k).cast("int")) == w, F.lit(False))
        return hit

    return F.transform(F.filter(every, start), lambda m: m["at"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    known = known or templates()
    found = written(blocks(keyed(docs, key, text), text, known), "blocks")
    pairs = join(found, known)
    phrases = pairs.where("block < 0").select(ID, TIE, "template").distinct()
    phrases = give(phrases, found.select(ID, TIE, "words").where("words is not null").dropDuplicates([ID, TIE]))
    at = F.lit(None).cast("array<long>")
    for number, t in enumerate(known):
        if t.whole:
            at = F.when(F.col("template") == number, places("words", t.words)).otherwise(at)
    base = phrases.select(ID, TIE, "template", at.alias("at")).where(F.size("at") > 0)
    labels = F.element_at(F.create_map(*[F.lit(x) for n, t in enumerate(known) for x in (n, t.label)]), F.col("template"))
    own = pairs.where("block >= 0").select(ID, TIE, labels.alias("label"), "share")
    none = F.lit(None).cast("long")
    base = base.select(
        ID, TIE, labels.alias("label"), F.lit(1.0).alias("share"),
        F.size("at").cast("long").alias("n"), F.array_min("at").alias("first"), F.array_max("at").alias("last"),
    )
    own = own.groupBy(ID, TIE, "label").agg(F.max("share").alias("share"))
    both = base.unionByName(own.select("*", none.alias("n"), none.alias("first"), none.alias("last")))
    base_label = F.when(F.col("n").isNotNull(), F.col("label"))
    per_text = both.groupBy(ID, TIE).agg(
        F.sum("n").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    out = give(found.select(ID, TIE, "n_words"), per_text)
    return out.select(
        F.col(ID).alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
