"""Licence scans: a trained paragraph classifier in DataFrame functions only.

A sparse logistic regression over word 1- to 3-grams tells licence families apart,
with one class for text that is no licence statement. It is trained on the driver
from ``TEMPLATES`` (statements written for this purpose, varied by rule) and plain
sentences; at most ``MOST_FEATURES`` weights come out, so the weight table is
broadcast. Every feature holds a cue word of ``CUES``, so a paragraph without one
has no feature and is unknown by the model itself: the scan finds cue words first
and expands only paragraphs that have one. A paragraph is a line; each line with a
cue is also judged joined with the non-blank lines before and after it, for notices
that are wrapped. The joined verdict counts where no line of the three has one of
its own, or where it narrows the line's (``NARROWS``) and the text runs on over the
line's end: no full stop before, no new statement after. Probabilities are softened by a
temperature fitted on varied statements kept aside, and a best class below
``SURE`` is unknown. Trained as unknown are everyday uses of the cue words and the
names of ``OTHER`` licences. A prediction is confirmed if ``ALIKE`` of a template of
its family is in the text, with the family's name, and no other family's name is.

Defined results: one row a document. Null, empty and cue-free texts have no
licence, confidence 0 and no paragraph. Several families are listed in order; the
document's own is the surest (ties: first by name). Rows that repeat doc_id and
text get equal results. Other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, barrier, cut, read_table

#: Statements by family; ``unknown`` is the class of everything else.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 3", "released under the agpl", "licensed under agpl v3", "you can redistribute it under the terms of the gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "distributed under the terms of the apache 2.0 license", "apache license 2.0"),
    "artistic-2.0": ("licensed under the artistic license 2.0", "released under the perl artistic license", "you may use it under the terms of the artistic license"),
    "bsd": ("released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "licensed under the 3 clause bsd license", "bsd 2 clause license", "released under a bsd style license"),
    "bsl-1.0": ("distributed under the boost software license version 1.0", "licensed under the boost software license", "released under the boost license"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 license", "available under cc by nc for non commercial use", "licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under the creative commons attribution noncommercial license", "licensed under a creative commons attribution non commercial license"),
    "cc-by-nd": ("licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "available under the creative commons attribution no derivatives license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "available under the creative commons attribution share alike license"),
    "cc0": ("dedicated to the public domain under cc0 1.0", "cc0 1.0 universal no rights reserved", "the author has waived all copyright and related rights to this work", "licensed under cc0", "creative commons zero public domain dedication"),
    "epl": ("made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license", "released under the epl 2.0", "subject to the terms of the eclipse public license version 2.0"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it under the terms of the gnu general public license", "released under the gpl version 2 or later", "licensed under gpl v3", "released under gpl v2", "sous licence gpl", "unter der gpl lizenz", "bajo la licencia gpl"),
    "isc": ("licensed under the isc license", "released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the gnu lesser general public license version 2.1", "released under the lgpl", "this library is free software under the gnu lesser general public license", "licensed under lgpl v3", "released under lgpl v2.1"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the terms of the mit license", "available under the mit licence", "mit licensed", "sous licence mit", "unter der mit lizenz", "bajo la licencia mit"),
    "mpl": ("subject to the terms of the mozilla public license version 2.0", "released under the mozilla public license", "licensed under the mpl 2.0"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "unlicensed proprietary and confidential", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
    "zlib": ("licensed under the zlib license", "distributed under the zlib libpng license"),
}
#: Identifiers by family, as a file's identifier line has them after punctuation is gone.
IDENTIFIERS = {
    "agpl": ("agpl 3.0 only", "agpl 3.0 or later"), "apache-2.0": ("apache 2.0",), "artistic-2.0": ("artistic 2.0",), "bsd": ("bsd 2 clause", "bsd 3 clause"), "bsl-1.0": ("bsl 1.0",),
    "cc-by": ("cc by 4.0", "cc by 3.0"), "cc-by-nc": ("cc by nc 4.0", "cc by nc 3.0"), "cc-by-nd": ("cc by nd 4.0",), "cc-by-sa": ("cc by sa 4.0", "cc by sa 3.0"), "cc0": ("cc0 1.0",), "epl": ("epl 2.0", "epl 1.0"),
    "gpl": ("gpl 2.0 only", "gpl 3.0 or later", "gpl 2.0"), "isc": ("isc",), "lgpl": ("lgpl 2.1 only", "lgpl 3.0 or later"), "mit": ("mit",), "mpl": ("mpl 2.0",), "proprietary": ("licenseref proprietary",), "unlicense": ("unlicense",), "zlib": ("zlib",),
}
IDENTIFIED = "spdx license identifier {}"
#: Words that tie a paragraph to licensing; every feature holds one.
CUES = (
    "license", "licence", "licensed", "licenced", "copyright", "copyrighted", "apache", "mit", "gnu", "gpl", "lgpl", "agpl", "affero", "bsd", "mpl", "mozilla", "epl", "eclipse", "isc", "boost", "zlib", "artistic",
    "commons", "creative", "cc", "cc0", "noncommercial", "nc", "noderivatives", "sharealike", "redistribution", "redistribute", "permission", "permitted", "rights", "reserved",
    "proprietary", "unlicensed", "unlicense", "unencumbered", "reproduced", "attribution", "lesser", "gratis", "warranty", "spdx", "lizenz", "licencia", "rechte", "vorbehalten", "droits", "réservés", "derechos", "reservados",
)
#: Other licences: what they are called, put into the statements of ``OTHERWISE``.
OTHER = (
    "common development and distribution license", "european union public licence", "open software license", "python software foundation license", "sil open font license", "ruby license", "microsoft public license",
    "server side public license", "business source license", "elastic license", "open data commons attribution license", "php license", "academic free license", "sleepycat license", "open database license", "ibm public license",
    "cern open hardware licence", "game engine license", "community license", "vim license", "x11 style licence of the author", "commercial license", "site license", "free documentation licence", "enterprise license agreement",
)
OTHERWISE = ("licensed under the {}", "released under the {} version 2.0", "made available under the terms of the {}", "subject to the {} 1.0", "the {}")
PLAIN = (
    "the driver must hold a license to drive in the city", "she asked permission to leave the room early", "civil rights were debated for years",
    "the reserved seats are near the door", "his creative work in the commons was praised", "the warranty covers parts for two years",
    "the apache people lived in the south west", "the mit campus lies on the river", "a version of the story was released in the spring",
    "the work is under way and available from monday", "terms of use were changed by the public office", "attribution of the painting is unsure",
    "the commons voted on the public house license", "gnu herds cross the river with or without rain", "he was granted free entry to the show",
    "they released the software last year under a new name", "the license fee was paid in full by any person who came",
    "the license plate of the car was found on the road", "a new license plate costs more this year", "all rights reserved seats were taken", "reserved seats for all were sold out in an hour", "the rights reserved for members are few",
    "she is licensed under state law to practise medicine", "licensed doctors and nurses work here", "a licensed guide took us up the hill", "the shop is licensed to sell beer and wine", "his pilot licence ran out", "fishing licence fees went up",
    "the eclipse was seen in the north", "a solar eclipse of the sun", "the boost to trade was small", "an artistic gift for the school", "her artistic license with the facts", "poetic license is granted to him", "human rights were reserved to a few", "the copyright debate went on in parliament",
    "copyright law protects authors", "the copyright term was made longer", "students of mit built a robot", "a professor at mit wrote the paper", "mit der bahn in die stadt", "mit dem auto und mit der familie", "er kam mit einer lizenz zum fahren", "sie sprach mit ihm", "la licencia de conducir es cara", "les droits de douane montent",
    "los derechos humanos en el mundo", "die rechte der kinder", "a table reserved for two", "the bsd team won the match", "permission to land was given", "redistribution of income is debated", "proprietary methods of the firm were sold", "the permitted load is two tons", "the story was reproduced in the paper", "the lesser of two evils",
    "the film got a license from the board", "the apache helicopter landed", "mozilla held a conference in the spring", "nc state won the game", "cc the office on your mail",
)
UNKNOWN = "unknown"
#: Families whose statements contain those of a wider one.
NARROWS = {"cc-by-nc": "cc-by", "cc-by-nd": "cc-by", "cc-by-sa": "cc-by", "lgpl": "gpl", "agpl": "gpl"}
#: How a line starts that does not go on with the one before.
_START = r"(?i)^\W*(?:un)?(?:licen[sc]ed|released|distributed|available|subject|this|permission|redistribution|copyright|all)\b"
MOST_FEATURES, SURE, ALIKE = 4000, 0.6, 0.7
_NOISE = "and of the in a this for with project code file text data see notice terms work it is all by from on".split()


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() or c == "." else " " for c in text.lower()).replace(". ", " ").strip(". ").split() if w]


def _grams(words: list[str]) -> set[str]:
    cues = set(CUES)
    found = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            if cues & set(words[i : i + n]):
                found.add(" ".join(words[i : i + n]))
    return found


def _statements() -> list[tuple[str, str]]:
    rows = [(f, x) for f, xs in TEMPLATES.items() for x in xs] + [(f, IDENTIFIED.format(x)) for f, xs in IDENTIFIERS.items() for x in xs]
    return rows + [(UNKNOWN, x) for x in PLAIN] + [(UNKNOWN, x.format(name)) for name in OTHER for x in OTHERWISE] + [(UNKNOWN, IDENTIFIED.format(x)) for x in ("cddl 1.0", "eupl 1.2", "osl 3.0", "none")]


def _varied(seed: int, copies: int) -> list[tuple[str, list[str]]]:
    """Statements with words dropped and others put around them."""
    rng, rows = random.Random(seed), []
    for family, statement in _statements():
        for k in range(copies):
            words = _words(statement)
            if k:
                words = [w for w in words if rng.random() > 0.06] or words
                words = rng.choices(_NOISE, k=rng.randrange(4)) + words + rng.choices(_NOISE, k=rng.randrange(4))
            rows.append((family, words))
    for _ in range(20 * copies):  # lone cue words are no statement
        words = rng.choices(_NOISE, k=rng.randrange(3, 9))
        words.insert(rng.randrange(len(words)), rng.choice(CUES))
        rows.append((UNKNOWN, words))
    return rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@lru_cache(1)
def train(copies: int = 8, rounds: int = 20, seed: int = 11) -> tuple[dict, dict, float]:
    """``weights[gram][family]``, ``bias[family]`` and the temperature."""
    rows = [(f, _grams(w)) for f, w in _varied(seed, copies)]
    common = Counter(g for _, found in rows for g in found)
    kept = [g for g, n in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:MOST_FEATURES] if n > 1]
    place, families = {g: i for i, g in enumerate(sorted(kept))}, [*TEMPLATES, UNKNOWN]
    number = {f: i for i, f in enumerate(families)}
    indexed = lambda found: np.array(sorted(place[g] for g in found if g in place), dtype=np.int64)
    rows = [(number[f], indexed(found)) for f, found in rows]
    weights, squares = np.zeros((len(place), len(families))), np.zeros((len(place), len(families)))
    bias = np.zeros(len(families))
    bias[number[UNKNOWN]] = 2.0
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(rows)
        for family, mine in rows:
            err = _softmax(bias + weights[mine].sum(axis=0))
            err[family] -= 1
            squares[mine] += err * err
            weights[mine] -= 0.3 * err / np.sqrt(0.1 + squares[mine]) + 0.0005 * weights[mine]
    aside = [(number[f], indexed(_grams(w))) for f, w in _varied(seed + 1, 4)]

    def loss(t: float) -> float:
        return -sum(math.log(max(1e-9, _softmax((bias + weights[m].sum(axis=0)) / t)[y])) for y, m in aside)

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    return {g: dict(zip(families, weights[i].tolist(), strict=True)) for g, i in place.items()}, dict(zip(families, bias.tolist(), strict=True)), temperature


@lru_cache(1)
def names() -> dict[str, frozenset[str]]:
    """What each family is called: cue words and parts of identifiers that only its statements have."""
    said = {f: {w for x in (*xs, *IDENTIFIERS[f]) for w in _words(x)} for f, xs in TEMPLATES.items()}
    calls = {f: {w for x in xs for w in _words(x) if not w[0].isdigit()} for f, xs in IDENTIFIERS.items()}
    generic = {w for x in OTHER for w in _words(x)} | set(_NOISE)
    return {f: frozenset(w for w in own if (w in CUES or w in calls[f]) and w not in generic and not any(w in o for g, o in said.items() if g != f)) for f, own in said.items()}


def _confirmed(family: Column, words: Column) -> Column:
    """Whether a statement of the family is in the words: ``ALIKE`` of its words, all of its name,
    and no word that names another family. Statements without a name of their own must be there whole."""
    found = F.lit(False)
    for f, statements in TEMPLATES.items():
        own, foreign = names()[f], sorted(set().union(*(n for g, n in names().items() if g not in (f, NARROWS.get(f)))))
        fits = F.lit(False)
        for s in (*statements, *(IDENTIFIED.format(x) for x in IDENTIFIERS[f])):
            said = list(dict.fromkeys(_words(s)))
            named = [w for w in said if w in own]
            least = ALIKE if named else 1.0
            fit = F.size(F.array_intersect(words, F.array(*map(F.lit, said)))) >= math.ceil(least * len(said))
            fits |= fit & F.forall(F.array(*map(F.lit, named)), lambda w: F.array_contains(words, w)) if named else fit
        found |= (family == f) & fits & ~F.arrays_overlap(words, F.array(*map(F.lit, foreign)))
    return found


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, paragraph, joined, before, after, words`` of the lines that
    have a cue word, alone and joined with their neighbours; ``before`` and ``after``
    tell whether the text runs on over that end of the line."""
    cue = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(CUES)})(?:(?![\p{{L}}\p{{N}}])|(?=v?[0-9]))"
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(cue))
    rows = barrier(rows.withColumn("text_key", F.xxhash64("text")), "lines", F.split("text", r"\n"), "doc_id", "text_key")
    none = F.array(F.lit(""))
    near = F.arrays_zip(F.concat(none, "lines").alias("prev"), F.col("lines").alias("line"), F.concat(F.expr("slice(lines, 2, size(lines))"), none).alias("next"))
    rows = rows.select("doc_id", "text_key", F.posexplode(near).alias("paragraph", "near")).where(F.col("near.line").rlike(cue))
    rows = rows.select("doc_id", "text_key", "paragraph", "near.*")
    runs_on = lambda one, two: (F.trim(one) != "") & (F.trim(two) != "") & ~F.col(one).rlike(r"[.!?;:]\s*$") & ~F.col(two).rlike(_START)
    beside = (F.trim("prev") != "") | (F.trim("next") != "")
    both = F.when(beside, F.array(F.col("line"), F.concat_ws(" ", "prev", "line", "next"))).otherwise(F.array("line"))
    rows = rows.select("doc_id", "text_key", "paragraph", runs_on("prev", "line").alias("before"), runs_on("line", "next").alias("after"), F.posexplode(both).alias("joined", "line"))
    split = F.regexp_replace(F.lower("line"), rf"(?<![\p{{L}}\p{{N}}])(?!cc0)({'|'.join(CUES)})(?=v?[0-9])", "$1 ")
    plain = F.regexp_replace(split, r"[^\p{L}\p{N}.]", " ")
    plain = F.trim(F.regexp_replace(plain, r"\.(?= |$)", " "))
    return rows.select("doc_id", "text_key", "paragraph", "joined", "before", "after", F.filter(F.split(plain, GAP), lambda w: w != "").alias("words"))


def classify(found: DataFrame) -> DataFrame:
    """Adds ``family, confidence, confirmed`` to paragraphs; unknown ones are dropped."""
    spark = found.sparkSession
    weights, bias, temperature = train()
    families = [*TEMPLATES, UNKNOWN]
    # At most MOST_FEATURES rows with a weight for each family.
    table = spark.createDataFrame([(g, [w[f] for f in families]) for g, w in weights.items()], "gram string, weight array<double>")
    key = ["doc_id", "text_key", "paragraph", "joined", "before", "after"]
    two = F.transform(F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b")), lambda s: F.concat_ws(" ", s["a"], s["b"]))
    three = F.transform(
        F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b"), F.expr("slice(words, 3, size(words))").alias("c")),
        lambda s: F.concat_ws(" ", s["a"], s["b"], s["c"]),
    )  # short tails repeat shorter grams; distinct drops them
    grams = found.select(*key, "words", F.explode(F.array_distinct(F.concat("words", two, three))).alias("gram"))
    hits = grams.join(F.broadcast(table), "gram")
    sums = [F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(len(families))]
    scored = hits.groupBy(*key).agg(F.first("words").alias("words"), *sums)
    z = F.array(*[(F.col(f"s{i}") + bias[f]) / temperature for i, f in enumerate(families)])
    scored = barrier(scored, "z", z, *key, "words")
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    scored = barrier(scored, "confidence", 1 / total, *key, "words", "z", "top")
    family = F.element_at(F.array(*map(F.lit, families)), F.array_position("z", F.col("top")).cast("int"))
    scored = scored.select(*key, "words", "confidence", family.alias("family")).where((F.col("family") != UNKNOWN) & (F.col("confidence") >= SURE))
    return scored.select(*key, "family", "confidence", _confirmed(F.col("family"), F.col("words")).alias("confirmed"))


def stated(found: DataFrame) -> DataFrame:
    """One verdict a line: its own, or that of the joined text where that counts."""
    key = ["doc_id", "text_key", "paragraph"]
    verdict = F.struct("family", "confidence", "confirmed")
    rows = found.groupBy(*key).agg(
        F.first("before").alias("before"), F.first("after").alias("after"),
        F.max(F.when(F.col("joined") == 0, verdict)).alias("own"), F.max(F.when(F.col("joined") == 1, verdict)).alias("wide"),
    )
    lines = Window.partitionBy("doc_id", "text_key").orderBy("paragraph").rangeBetween(-1, 1)
    rows = rows.withColumn("stated", F.count("own").over(lines))
    wider = F.element_at(F.create_map(*[F.lit(x) for pair in NARROWS.items() for x in pair]), F.col("wide.family"))
    narrowed = F.col("own").isNotNull() & (wider == F.col("own.family")) & (F.col("before") | F.col("after"))
    rows = rows.withColumn("verdict", F.when(F.coalesce(narrowed, F.lit(False)) | (F.col("stated") == 0), F.col("wide")).otherwise(F.col("own")))
    # A line that goes on with one that took a joined verdict of the same family is the same notice.
    taken = F.when((F.col("verdict") == F.col("wide")) & (F.col("own").isNull() | narrowed), F.col("wide.family"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("paragraph").rangeBetween(-1, -1)
    rows = rows.withColumn("taken", taken).withColumn("same", F.max("taken").over(order))
    rows = rows.where("verdict IS NOT NULL AND NOT coalesce(before AND verdict.family = same, false)")
    return rows.select(*key, "verdict.*")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licence, families, n_paragraphs, confidence, confirmed`` for every row."""
    found = cut(stated(classify(paragraphs(docs))), "licence-paragraphs")
    best = F.min(F.struct((-F.col("confidence")).alias("down"), "family", (~F.col("confirmed")).alias("doubt")))
    by_doc = found.groupBy("doc_id", "text_key").agg(
        best.alias("best"), F.sort_array(F.collect_set("family")).alias("families"), F.count(F.lit(1)).alias("n")
    )
    by_doc = by_doc.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return rows.select(
        "doc_id",
        F.col("best.family").alias("licence"),
        F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"),
        F.coalesce("n", F.lit(0)).alias("n_paragraphs"),
        F.coalesce(-F.col("best.down"), F.lit(0.0)).alias("confidence"),
        F.coalesce(~F.col("best.doubt"), F.lit(False)).alias("confirmed"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
