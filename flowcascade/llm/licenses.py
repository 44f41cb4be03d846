"""Licence scan by Dice coefficient over word bigrams.

The normalised words of a text, across its lines, are compared with licence templates.  A
window runs from one word bigram of the template to another, and holds up to as many bigrams
as the Dice coefficient allows.  It can only reach the threshold when it shares enough of the
template's bigrams, so texts that hold too few of them anywhere have no windows.

From each start the end runs once over the window while the numbers of distinct and of shared
bigrams are kept up.  Starts of long templates are first bounded in blocks: a window that
begins later in the block shares no more than the one from its first start and holds at most
the block's length fewer bigrams.  Blocks whose bound is below the threshold are left out, so
the result is that of all windows.
Only DataFrame functions are used, and no row leaves its partition.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcascade.llm.common import id_and_text

THRESHOLD = 0.8
BLOCKS = 16              # a block of starts is this part of the template

# Texts of public licence notices (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit": "Released under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License."),
    "cc-by-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    # full texts of licences
    **{path.stem: path.read_text() for path in
       sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},
}


def bigrams_of(text: str) -> list[str]:
    """Word bigrams of a template, normalised as :func:`bigrams` does."""
    words = re.sub(r"[^a-z0-9]+", " ", text.translate(_LOWER)).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


_UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER_LETTERS, _UPPER_LETTERS.lower())


def normal_words(text: Column) -> Column:
    """A-Z lower-cased; what is neither a letter a-z nor a digit separates words."""
    folded = F.translate(text, _UPPER_LETTERS, _UPPER_LETTERS.lower())
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Word bigrams of an array of words; neighbours come from a shifted copy."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def sql_list(values: list[str]) -> str:
    """Bigrams, which have no quotes, as a list of SQL literals."""
    return ", ".join(f"'{v}'" for v in values)


def template_rows(sets: dict[str, list[str]], threshold: float) -> Column:
    """The templates as one constant array.

    ``need`` is the least number of shared bigrams with which the coefficient can reach the
    threshold, ``reach`` the most bigrams of a window.
    """
    rows = []
    for place, (name, pairs) in enumerate(sets.items()):
        size = len(set(pairs))
        rows.append(F.struct(
            F.lit(name).alias("license"), F.lit(place).alias("place"), F.lit(size).alias("size"),
            F.lit(math.ceil(size * threshold / (2 - threshold) - 1e-9)).alias("need"),
            F.lit(math.floor(len(pairs) * (2 - threshold) / threshold + 1e-9)).alias("reach"),
            F.lit(max(len(pairs) // BLOCKS, 1)).alias("step"),
            F.expr(f"array({sql_list(sorted(set(pairs)))})").alias("pairs")))
    return F.array(*rows)


def earlier_places(pairs: Column) -> Column:
    """Per bigram of a text the place where it came last before, or -1."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), i.alias("at"))))
    one_on = F.concat(F.array(F.lit(None).cast("struct<pair:string,at:int>")), placed)
    linked = F.zip_with(placed, F.slice(one_on, F.lit(1), F.size(placed)), lambda x, y: F.struct(
        x["at"].alias("at"), F.when(x["pair"] == y["pair"], y["at"]).otherwise(-1).alias("last")))
    return F.transform(F.array_sort(linked), lambda x: x["last"])


def windows(template: Column, hits: Column, last: Column, threshold: float) -> Column:
    """Per bigram of a template in a text, the best window that starts there.

    ``last`` is :func:`earlier_places` of the text.
    """
    def run(own: Column, a: Column, start: Column, slack: Column, more: Column) -> Column:
        """Best coefficient, and its end, of the windows from the ``a``-th hit.

        ``slack`` is added to the longest window and taken off the number of its bigrams.
        Expressions in a lambda are evaluated wherever they stand, so a window is measured
        from the finished counts, one step later.
        """
        def measured(best: Column) -> Column:
            bigrams = F.greatest(best["shared"] + best["others"] - slack, F.lit(1))
            here = F.struct((2 * best["shared"] / (bigrams + template["size"])).alias("dice"),
                            (-best["at"]).alias("minus_end"))
            return F.greatest(best["top"], F.when(
                best["at"] - start < template["reach"] + slack, here))

        def longer(best: Column, x: Column) -> Column:
            return F.struct(
                F.when(x["last"] < start, best["shared"] + 1).otherwise(best["shared"])
                .alias("shared"),
                F.when(x["gap"].isNull(), best["others"]).otherwise(
                    best["others"] + F.size(F.filter(x["gap"], lambda p: p < start)))
                .alias("others"),
                x["at"].alias("at"), measured(best).alias("top"))

        first = F.struct(F.lit(1).alias("shared"), F.lit(0).alias("others"), start.alias("at"),
                         F.lit(None).cast("struct<dice:double,minus_end:int>").alias("top"))
        return F.aggregate(F.slice(own, a + 2, template["reach"] + more), first, longer, measured)

    def from_hits(own: Column) -> Column:
        step = template["step"]

        def hopeful(block: Column) -> Column:
            a = block * step
            start = own[a]["at"]
            slack = own[F.least(a + step, F.size(own)) - 1]["at"] - start
            return F.when(step == 1, True).otherwise(
                run(own, a, start, slack, step)["dice"] >= threshold)

        def best(blocks: Column) -> Column:
            tops = F.transform(own, lambda x, a: F.when(
                F.get(blocks, F.floor(a / step).cast("int")),
                F.struct(run(own, a, x["at"], F.lit(0), F.lit(0)).alias("top"),
                         x["at"].alias("start"))))
            good = F.filter(tops, lambda w: w.isNotNull() & (w["top"]["dice"] >= threshold))
            return F.transform(good, lambda w: F.struct(
                (-w["top"]["dice"]).alias("minus_dice"), w["start"].alias("start"),
                template["place"].alias("place"), (-w["top"]["minus_end"]).alias("end"),
                template["license"].alias("license")))

        count = F.floor((F.size(own) - 1) / step).cast("int")
        return _with(F.transform(F.sequence(F.lit(0), count), hopeful), best)

    def spaced(own: Column) -> Column:
        """Hits, and where the bigrams between the hit before and this one came last."""
        def one(x: Column, i: Column) -> Column:
            before = F.when(i == 0, x["at"] - 1).otherwise(F.get(own, i - 1)["at"])
            return F.struct(x["at"].alias("at"), last[x["at"]].alias("last"),
                            F.when(x["at"] - before > 1, F.slice(
                                last, before + 2, x["at"] - before - 1)).alias("gap"))
        return _with(F.transform(own, one), from_hits)

    own = F.filter(hits, lambda h: F.array_contains(template["pairs"], h["pair"]))
    return _with(own, lambda found: F.when(F.size(found) > 0, spaced(found)).otherwise(
        F.array().cast(FOUND)))


def _with(value: Column, use) -> Column:
    """``use(value)``, with an array value that is computed once."""
    return F.flatten(F.transform(F.array(value), use))


FOUND = "array<struct<minus_dice:double,start:int,place:int,end:int,license:string>>"


def apart(found: Column) -> Column:
    """The windows, best first, without those that overlap a better one of the same template or similar
    size."""
    def length(w: Column) -> Column:
        return w["end"] - w["start"] + 1

    def clash(x: Column, y: Column) -> Column:
        return ((x["start"] <= y["end"]) & (y["start"] <= x["end"])
                & ((x["place"] == y["place"]) | ((3 * length(x) >= 2 * length(y))
                                                 & (3 * length(y) >= 2 * length(x)))))

    return F.aggregate(found, F.slice(found, 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


NO_MATCH = "array<struct<license:string,dice:double,first_line:int,last_line:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES,
                  threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: all matches, their number, and the best one.

    ``matches`` lists ``license``, ``dice``, ``first_line`` and ``last_line`` (from 1) by
    coefficient, then by place in the text, then by the name of the template.  Of windows that
    overlap and are of one template or of similar size only the first in that order is a match;
    a short notice within a longer one is listed as well as that.  ``license``, ``dice`` and ``unit`` (the
    first line) are those of the first match.  Without a match they are null, ``matches`` is
    empty and ``n_matches`` is 0; so for null and empty texts.  Null ids stay null, repeated
    rows are reported each, an empty table gives an empty result, other columns are not read.
    """
    sets = {name: bigrams_of(text) for name, text in sorted(templates.items())}
    sets = {name: pairs for name, pairs in sets.items() if pairs}
    rows = id_and_text(docs, id_col, text_col)
    if not sets:
        nothing = F.lit(None)
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_matches"),
                           nothing.cast("string").alias("license"),
                           nothing.cast("double").alias("dice"), nothing.cast("int").alias("unit"),
                           F.array().cast(NO_MATCH).alias("matches"))
    known = sql_list(sorted(set().union(*sets.values())))
    paired = rows.select("doc_id", "text", bigrams(normal_words(F.col("text"))).alias("pairs"))
    hit = paired.withColumn("hits", F.expr(
        f"filter(transform(pairs, (p, i) -> if(p in ({known}), struct(i as at, p as pair), null)),"
        " h -> h is not null)"))
    least = min(math.ceil(len(set(p)) * threshold / (2 - threshold) - 1e-9) for p in sets.values())
    hits = F.col("hits")
    near = hit.withColumn("distinct", F.when(F.size("hits") >= least,
                                             F.array_distinct(F.col("hits.pair"))))
    likely = near.withColumn("likely", F.when(
        F.size("distinct") >= least, F.filter(
            template_rows(sets, threshold), lambda t: F.when(
                F.size("distinct") >= t["need"],
                F.size(F.array_intersect("distinct", t["pairs"])) >= t["need"]).otherwise(False))))
    placed = likely.withColumn("last", F.when(F.size("likely") > 0,
                                              earlier_places(F.col("pairs"))))
    last = F.col("last")
    found = placed.select("doc_id", "text", F.when(F.size("likely") > 0, F.array_sort(F.flatten(
        F.transform("likely", lambda t: windows(t, hits, last, threshold))))).alias("found"))
    kept = found.select("doc_id", "text", F.when(
        F.size("found") > 0, apart(F.col("found"))).alias("found"))
    # the line of every word
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.array_repeat(
        i + 1, F.size(normal_words(x)))))
    numbered = kept.select("doc_id", "found", F.when(F.size("found") > 0, lines).alias("lines"))
    matches = F.coalesce(F.transform("found", lambda w: F.struct(
        w["license"].alias("license"), (-w["minus_dice"]).alias("dice"),
        F.element_at("lines", w["start"] + 1).alias("first_line"),
        F.element_at("lines", w["end"] + 2).alias("last_line"))), F.array().cast(NO_MATCH))
    # a generator, so that no filter of the caller is moved below it with a copy of all above
    listed = numbered.select("doc_id", F.explode(F.array(matches)).alias("matches"))
    top = F.get("matches", F.lit(0))
    return listed.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                         top["license"].alias("license"), top["dice"].alias("dice"),
                         top["first_line"].alias("unit"), "matches")
