"""Licence scan: a trained paragraph classifier, confirmed against templates.

A sparse logistic regression over word n-grams tells licence families and an
unknown class apart.  It is trained on the templates below, each with words left
out and with text of the corpus around it, against lines of the corpus, with
and without licence words, loose licence words and notices with their version or name
left out as the unknown class.  Half of all lines, by hash, serve the fit: lines that
hold the same n-grams of the templates are one row, weighted by their number.  The
probability that a family must reach is calibrated on the other half.

A text is tokenized once, and only where it holds one of a few words without which
no template can be confirmed.  Its word pairs are looked up among those of all
templates; what is judged are the stretches around the hits that hold most of a
template's pairs, so each notice of a long paragraph is judged by itself.  The
stretch goes to the classifier, and a prediction counts if the template confirms
it: most of its word pairs are there, and so are its distinguishing words (numbers,
and words that templates of other families with nearly the same text lack), none of
the words that make it such a family's notice, and no "not" in it or before it.

Everything runs as DataFrame operations and MLlib.  NULL, empty and blank texts have no
paragraphs; a very long text is exploded into its own words only; ties between
equally good stretches go to the first; repeated rows are scanned once and each gets
the result; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, table

# Usual notices of public licences, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "lgpl-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-2-clause": ["Licensed under the BSD 2-Clause License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "mpl-1.1": ["Licensed under the Mozilla Public License, version 1.1."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."],
    "epl-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.", "Licensed under the Eclipse Public License, version 1.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-sa-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "CC0 1.0 Universal."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
UNKNOWN = "unknown"
#: Phrases that make a paragraph a candidate, whatever a template says.
ANCHORS = ["license", "licence", "copyright", "all rights reserved", "permission is hereby", "permitted provided", "public domain"]
#: Words that name a line of licences.
NAMES = ["mit", "isc", "apache", "lesser", "affero", "mozilla", "eclipse", "bsd", "by-sa", "by-nc", "by-nd", "attribution",
         "attribution-sharealike", "attribution-noncommercial", "attribution-noderivatives", "cc0", "unencumbered"]
#: Words that deny a notice when one of the two words before it is one of these.
DENIALS = ["not", "never", "isn", "aren", "nor", "longer"]
# End of fixed values.

FALSE_SHARE = 0.001  # share of unseen lines, with and without licence words, that may reach the calibrated probability
STEPS = 10_000  # probabilities are told apart by so many steps when they are counted
CONFIRM = 0.7  # share of a template's word pairs that must be in the stretch
LEAST = 0.5
FOREIGN = 0.3  # a background paragraph with licence words holds less of every template
SLACK = 2  # a stretch may be so many words longer than its template


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())


class Template:
    """A template's word pairs, and the words that it must and must not be found with."""

    def __init__(self, family: str, text: str):
        self.family, self.text, self.words = family, text, _words(text)
        self.pairs = sorted({f"{a} {b}" for a, b in zip(self.words, self.words[1:])})
        self.span = len(self.words) + SLACK
        self.must = sorted({w for w in self.words if w in NAMES or _number(w)})


def _number(word: str) -> bool:
    return any(c.isdigit() for c in word)


ALL = [Template(family, text) for family, some in TEMPLATES.items() for text in some]
#: Words that tell a notice from another one of nearly the same text.
TELLING = sorted({w for t in ALL for w in t.must})
WORDS = sorted({w for t in ALL for w in t.words})
PLAIN, GATED = -1, -2  # kinds of a background row that is no template's surroundings


def _gate() -> list[str]:
    """The anchors, and words of which a text holds one if any template is confirmed in
    it: a telling word that is not short, else words that touch so many of the
    template's pairs that fewer than ``CONFIRM`` of them are left."""
    chosen = list(ANCHORS)
    for t in ALL:
        telling = [w for w in t.must if len(w) > 3 or "." in w]
        if telling:
            if not any(c in w for c in chosen for w in telling):
                chosen.append(max(telling, key=lambda w: (len(w), w)))
            continue
        while len(left := [p for p in t.pairs if not any(c in p for c in chosen)]) >= CONFIRM * len(t.pairs):
            chosen.append(max({w for p in left for w in p.split(" ")}, key=lambda w: (len(w), w)))
    return chosen


GATE = _gate()


# ---- expressions -------------------------------------------------------------------

def held(text: str, phrases: list[str]) -> Column:
    """Whether a lower-cased text holds one of the phrases; it is lowered once."""
    def any_of(low: Column) -> Column:
        out = F.contains(low, F.lit(phrases[0]))
        for p in phrases[1:]:
            out = out | F.contains(low, F.lit(p))
        return out

    return F.transform(F.array(F.lower(text)), any_of)[0]


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def pairs(w: str) -> Column:
    """The word pairs in their order, repeats included."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(F.col(w), F.lit(1), n), F.slice(F.col(w), F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def grams(w: str) -> Column:
    """Distinct single words, pairs and triples of an array of words."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    three = F.zip_with(F.slice(pairs(w), F.lit(1), n), F.slice(F.col(w), F.lit(3), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(F.col(w), pairs(w), three))


def known_grams(w: str) -> Column:
    """``grams`` without those that hold a NULL, in order; for words of which few are known."""
    n, m = F.greatest(F.size(w) - 1, F.lit(0)), F.greatest(F.size(w) - 2, F.lit(0))
    two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(F.slice(two, F.lit(1), m), F.slice(w, F.lit(3), m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(F.col(w), two, three))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(key, unit, paragraph): the lines of each text, and its blocks of several lines
    between blank ones with the lines joined."""
    line = F.split("text", r"\n")
    block = F.filter(F.split("text", r"\n\s*\n"), lambda b: F.instr(F.trim(b), "\n") > 0)
    both = F.concat(line, F.transform(block, lambda b: F.regexp_replace(b, r"\s+", " ")))
    return docs.select("key", F.posexplode(both).alias("unit", "paragraph"))


def literal_rows(spark: SparkSession, structs: list[Column]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def templates(spark: SparkSession) -> DataFrame:
    """(t, family, w, n_pairs, must, bar), a row for each template, as a literal."""
    return literal_rows(spark, [F.struct(
        F.lit(i).alias("t"), F.lit(t.family).alias("family"), strings(t.words).alias("w"), F.lit(len(t.pairs)).alias("n_pairs"),
        strings(t.must).alias("must"), strings([w for w in [*TELLING, *DENIALS] if w not in t.words]).alias("bar")) for i, t in enumerate(ALL)])


def template_pairs(spark: SparkSession) -> DataFrame:
    """(pair, t, span), a row for each pair of each template, as a literal."""
    return literal_rows(spark, [F.struct(F.lit(p).alias("pair"), F.lit(i).alias("t"), F.lit(t.span).alias("span")) for i, t in enumerate(ALL) for p in t.pairs])


def stretches(units: DataFrame) -> DataFrame:
    """(place, t, share, first, last, n_pairs, ...) of the stretch of each unit (place, w) that
    holds the greatest share of a template's pairs, the first of equal ones."""
    spark = units.sparkSession
    hits = units.select("place", F.posexplode(pairs("w")).alias("at", "pair")).join(F.broadcast(template_pairs(spark)), "pair")  # fixed templates
    # Places in steps of a thousandth of the template's span, so that one frame fits all.
    ahead = Window.partitionBy("place", "t").orderBy("x").rangeBetween(0, 1000)
    found = hits.withColumn("x", F.floor(F.col("at") * 1000 / F.col("span"))).select(
        "place", "t", "at", F.size(F.collect_set("pair").over(ahead)).alias("n"), F.max("at").over(ahead).alias("last"))
    best = found.groupBy("place", "t").agg(F.max(F.struct("n", (-F.col("at")).alias("first"), "last")).alias("b"))
    return best.join(F.broadcast(templates(spark).drop("w")), "t").select(  # fixed templates
        "place", "t", "family", "must", "bar", (F.col("b.n") / F.col("n_pairs")).alias("share"), (-F.col("b.first")).alias("first"), F.col("b.last").alias("last"))


# ---- the classifier --------------------------------------------------------------------

class Classifier:
    """Vocabulary, fitted regression, its classes and the calibrated probability."""

    def __init__(self, counter: CountVectorizerModel, model: LogisticRegressionModel, classes: list[str], least: float):
        self.counter, self.model, self.classes, self.least = counter, model, classes, least

    def score(self, units: DataFrame) -> DataFrame:
        """Adds ``predicted`` and ``probability`` to rows with an array ``grams``."""
        p = vector_to_array("probability")
        out = self.model.transform(self.counter.transform(units)).withColumn("_p", p)
        names = F.array(*map(F.lit, self.classes))
        best = F.get(names, F.col("prediction").cast("int"))
        out = out.drop("probability").withColumn("probability", F.array_max("_p")).withColumn("predicted", F.when((best != UNKNOWN) & (F.col("probability") >= self.least), best).otherwise(F.lit(UNKNOWN)))
        return out.drop("_p", "prediction", "rawPrediction", "features")


def background(docs: DataFrame) -> DataFrame:
    """(kind, fitted, some, n), stored: all lines of ``docs`` (key, text), equal rows as one
    with their number.  ``some`` is for kind ``PLAIN`` the n-grams of known words in a line
    without licence words, for ``GATED`` a line with some, and for a template's number
    the words a plain line puts around it (empty if not known).  ``fitted`` tells the
    half of the lines for the fit; only these surround templates, each one."""
    lines = docs.select(F.explode(F.split("text", r"\n")).alias("line")).where(F.trim("line") != "")
    lines = lines.select("line", held("line", GATE).alias("gated"), F.xxhash64("line").alias("h"))
    known = F.transform(words(F.col("line")), lambda w: F.when(w.isin(WORDS), w))
    lines = lines.withColumn("w", F.when(~F.col("gated"), known)).withColumn("fitted", F.pmod("h", F.lit(2)) == 0)

    def row(kind: Column, some: Column) -> Column:
        return F.struct(kind.cast("int").alias("kind"), "fitted", some.alias("some"))

    plain = row(F.lit(PLAIN), known_grams("w"))
    around = row(F.floor(F.pmod("h", F.lit(2 * len(ALL))) / 2), F.transform(F.slice("w", 1, 4), lambda w: F.coalesce(w, F.lit(""))))
    rows = F.when(F.col("gated"), F.array(row(F.lit(GATED), F.array("line")))).when(F.col("fitted"), F.array(plain, around)).otherwise(F.array(plain))
    return store(lines.select(F.explode(rows).alias("r")).select("r.*").groupBy("kind", "fitted", "some").agg(F.count(F.lit(1)).alias("n")), "background")


def unlike(some: DataFrame) -> DataFrame:
    """(fitted, w), stored: the words of the distinct lines of ``background`` that have
    licence words but hold little of any template."""
    gated = some.where(F.col("kind") == GATED).select("fitted", words(F.col("some")[0]).alias("w")).withColumn("place", F.monotonically_increasing_id())
    gated = store(gated, "gated")
    near = stretches(gated.select("place", "w")).where(F.col("share") >= FOREIGN).select("place").distinct()
    return store(gated.join(near, "place", "left_anti").select("fitted", "w"), "unlike")


def train(docs: DataFrame) -> Classifier:
    """Fit on the templates and the ``background``: see the module's docstring.  The kinds
    of rows of a class weigh the same, so that many plain lines do not outweigh the others."""
    spark = docs.sparkSession
    some = background(docs)
    foreign = unlike(some)
    base = templates(spark).select("t", "family", "w", "must")
    one, unknown = F.lit(1).cast("long").alias("n"), F.lit(UNKNOWN).alias("family")

    def part(name: str, rows: DataFrame, n: Column = one, g: Column | None = None) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), "family", (grams("w") if g is None else g).alias("grams"), n)

    dropped = base.where(F.size("w") > 4).select("family", "must", F.explode("w").alias("x"), "w")
    # Without a telling word it could be another licence's notice.
    less = dropped.select(F.when(F.array_contains("must", F.col("x")), F.lit(UNKNOWN)).otherwise(F.col("family")).alias("family"), F.filter("w", lambda x: x != F.col("x")).alias("w"))
    inside = some.where(F.col("kind") >= 0).join(F.broadcast(base), F.col("kind") == F.col("t"))  # fixed templates
    inside = inside.select("family", "n", F.concat(F.slice("some", 1, 2), "w", F.slice("some", 3, 2)).alias("w"))
    loose = base.select(unknown, F.explode("w").alias("x")).distinct().select("family", F.array("x").alias("w"))
    plain = some.where(F.col("kind") == PLAIN).select(unknown, "fitted", "some", "n")
    parts = [part("whole", base), part("less", less), part("inside", inside, F.col("n")), part("loose", loose),
             part("plain", plain.where("fitted"), F.col("n"), F.col("some")), part("foreign", foreign.where("fitted").select(unknown, "w"))]
    data = parts[0]
    for more in parts[1:]:
        data = data.unionByName(more)
    classes = sorted({*TEMPLATES, UNKNOWN})
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    data = store(data.select("part", "family", number.cast("double").alias("label"), "grams", "n"), "licence-training")
    total = data.groupBy("family", "part").agg(F.sum("n").alias("total"))
    kinds = total.groupBy("family").agg(F.count(F.lit(1)).alias("kinds"))
    weight = total.join(kinds, "family").select("family", "part", (1.0 / (F.col("total") * F.col("kinds"))).alias("each"))
    data = data.join(F.broadcast(weight), ["family", "part"]).withColumn("weight", F.col("n") * F.col("each"))  # a few rows for each family
    vocabulary = [r["g"] for r in base.select(F.explode(grams("w")).alias("g")).distinct().orderBy("g").collect()]  # n-grams of the templates
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60).fit(counter.transform(data))
    classifier = Classifier(counter, model, classes, LEAST)
    unseen = part("plain", plain.where("NOT fitted"), F.col("n"), F.col("some")).unionByName(part("foreign", foreign.where("NOT fitted").select(unknown, "w")))
    reach = F.when(F.col("predicted") != UNKNOWN, F.ceil(F.col("probability") * STEPS)).otherwise(F.lit(0))
    reached = classifier.score(unseen).groupBy("part", reach.alias("reach")).agg(F.sum("n").alias("n")).collect()  # two for each step at most
    least = max((allowed([(r["reach"] / STEPS, r["n"]) for r in reached if r["part"] == p], FALSE_SHARE) for p in ("plain", "foreign")))
    classifier.least = min(0.99, max(LEAST, least))
    return classifier


def allowed(counted: list[tuple[float, int]], share: float) -> float:
    """The least of the values, given with their numbers, that at most ``share`` of all exceed."""
    left = share * sum(n for _, n in counted)
    for value, n in sorted(counted, reverse=True):
        left -= n
        if left < 0:
            return value
    return 0.0


# ---- the scan ------------------------------------------------------------------------------

def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(key, unit, place, family, predicted, probability, share, confirmed): every candidate
    paragraph of ``docs`` (key, text), once without a family and once for each stretch
    that holds most of a template.  A paragraph is a candidate if it holds an anchor
    or such a stretch."""
    units = paragraphs(docs.where(held("text", GATE))).where(held("paragraph", GATE))
    units = store(units.select("key", "unit", held("paragraph", ANCHORS).alias("anchored"), words(F.col("paragraph")).alias("w")), "paragraphs")
    units = units.withColumn("place", F.concat_ws(":", F.col("key").cast("string"), F.xxhash64("w").cast("string"), F.col("unit").cast("string")))
    close = stretches(units.select("place", "w").distinct()).where(F.col("share") >= CONFIRM)
    judged = units.join(close, "place")
    own = F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + 2)
    before = F.slice("w", F.greatest(F.col("first") - 1, F.lit(1)), F.least(F.col("first"), F.lit(2)))
    judged = judged.withColumn("own", own).withColumn("denied", F.arrays_overlap(before, strings(DENIALS)))
    scored = classifier.score(judged.withColumn("grams", grams("own")))
    told = F.size(F.array_except("must", "own")).eqNullSafe(0) & ~F.coalesce(F.arrays_overlap("bar", "own"), F.lit(False))
    confirmed = (F.col("predicted") == F.col("family")) & told & ~F.coalesce("denied", F.lit(False))
    judged = scored.select("key", "unit", "place", "family", "predicted", "probability", "share", confirmed.alias("confirmed"))
    plain = units.where("anchored").select("key", "unit", "place", F.lit(None).cast("string").alias("family"), F.lit(UNKNOWN).alias("predicted"),
                                           F.lit(0.0).alias("probability"), F.lit(0.0).alias("share"), F.lit(False).alias("confirmed"))
    return judged.unionByName(plain)


def documents(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Per row of ``docs`` (key, text) its confirmed families, sorted and comma-joined
    (empty if none), and the numbers of candidate, confirmed and unconfirmed
    paragraphs.  A NULL text counts as empty; rows that share a key each get the
    key's result once."""
    docs = docs.select("key", F.coalesce("text", F.lit("")).alias("text"))
    found = scan(docs.where("key IS NOT NULL"), classifier or train(docs))
    yes = F.when(F.col("confirmed"), F.col("place"))
    found = found.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("predicted")))), ",").alias("families"),  # families at most
                                     F.count_distinct("place").alias("n_candidates"), F.count_distinct(yes).alias("n_confirmed"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("best"))
    out = docs.select("key").join(found, "key", "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return out.select("key", F.coalesce("families", F.lit("")).alias("families"), n.alias("n_candidates"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
                      (n - F.coalesce("n_confirmed", F.lit(0))).alias("n_unknown"), F.coalesce("best", F.lit(0.0)).alias("best"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = documents(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")))
    return out.withColumnRenamed("key", "doc_id")
