"""License scans: a positional index of rare words finds template places, key phrases verify them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import ALNUM_SPLIT

RARE_WORDS = 8  # words of a template that are indexed, those in the fewest documents
AGREEING = 2  # indexed words of a longer template that must agree on a place


class Template(NamedTuple):
    label: str
    text: str  # words as a scan sees them
    phrases: tuple[str, ...]  # all must stand at their place
    base: bool = False  # a phrase that is found wherever it stands


# The phrases that every scan reports, and their labels.
BASE_TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

# Opening sentences of common licences.
LICENSE_TEMPLATES = (
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("licensed under the apache license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "cc",
        "this work is licensed under a creative commons attribution",
        ("licensed under a creative commons",),
    ),
    Template(
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        ("redistribute it and or modify it under the terms of the", "gnu general public license"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("distribute this software for any purpose",),
    ),
    Template(
        "lgpl-notice",
        "under the terms of the gnu lesser general public license",
        ("gnu lesser general public license",),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge",),
    ),
    Template("mit", "licensed under the mit license", ("under the mit license",)),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license",
        ("mozilla public license",),
    ),
    Template("spdx", "spdx license identifier", ("spdx license identifier",)),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def license_words(text: str) -> Column:
    """The words of a text, A-Z lower-cased; none where it is null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lowered, ALNUM_SPLIT), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def document_frequencies(docs: DataFrame, words: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many of all documents each of the given words stands (a row per word is gathered)."""
    found = F.array_distinct(F.filter(license_words(text), lambda w: w.isin(*words)))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def _index(templates: Sequence[Template], frequency: dict[str, int], rare: int) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place) of the ``rare`` highest-IDF words of each template; base phrases
    are looked up by their single rarest word."""
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, template in enumerate(templates):
        words = template.text.split()
        ranked = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        for word in ranked[: 1 if template.base else rare]:
            postings[word] += [(number, place) for place, w in enumerate(words) if w == word]
    return dict(postings)


def _place(template: Column, start: Column) -> Column:
    return F.struct(template.alias("template"), start.alias("start"))


def _phrase_places(template: Template) -> list[tuple[int, list[str]]]:
    words = template.text.split()
    places = []
    for phrase in template.phrases:
        part = phrase.split()
        places.append((next(i for i in range(len(words)) if words[i : i + len(part)] == part), part))
    return places


def license_scan(
    docs: DataFrame,
    templates: Sequence[Template] = (*BASE_TEMPLATES, *LICENSE_TEMPLATES),
    rare: int = RARE_WORDS,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(``key``, n_words, places, score) for each row of ``docs``.

    ``places`` are (label, start, base) of all verified templates, in order of template and start.
    Words of licences are ranked by how few of all documents hold them; each text looks up its
    places of the indexed ones, their postings are intersected by relative position, and a place on
    which enough of them agree counts if the template's key phrases stand where they must.  ``score``
    is the largest share of a verified template's indexed words that agree, 0 if there is none.

    Columns only: no row leaves its task, and a long or much-copied text costs its own words.  A
    null text has no words; rows are reported as often as they are repeated; other columns are not read.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    index = _index(templates, document_frequencies(docs, vocabulary, text), rare)

    def literal(values: list[Column]) -> Column:
        return F.array(*values)

    postings = F.create_map(
        *[
            part
            for word, places in sorted(index.items())
            for part in (F.lit(word), literal([F.struct(F.lit(t).alias("template"), F.lit(p).alias("at")) for t, p in places]))
        ]
    )
    needed = literal([F.lit(1 if t.base else min(AGREEING, len(set(t.text.split())), rare)) for t in templates])
    indexed = literal([F.lit(float(sum(t == n for ps in index.values() for t, _ in ps))) for n in range(len(templates))])
    phrases = literal(
        [
            literal([F.struct(F.lit(at).alias("at"), literal([F.lit(w) for w in part]).alias("words")) for at, part in _phrase_places(t)])
            for t in templates
        ]
    )
    labels = literal([F.lit(t.label) for t in templates])
    bases = literal([F.lit(t.base) for t in templates])

    words = F.col("_words")
    seen = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*index), i)), lambda i: i.isNotNull())
    looked_up = F.flatten(
        F.transform(
            seen,
            lambda i: F.transform(postings[F.get(words, i)], lambda p: _place(p["template"], i - p["at"])),
        )
    )

    def verified(hits: Column) -> Column:
        # Sorted, equal places stand together: the n-th of them tells that n words agree.
        def agreed(place: Column, i: Column) -> Column:
            back = F.element_at(needed, place["template"] + 1) - 1
            return (place["start"] >= 0) & F.coalesce(F.get(hits, i - back) == place, F.lit(False))

        def stands(place: Column) -> Column:
            return F.forall(
                F.element_at(phrases, place["template"] + 1),
                lambda p: F.slice(words, place["start"] + p["at"] + 1, F.size(p["words"])) == p["words"],
            )

        return F.filter(F.array_distinct(F.filter(hits, agreed)), stands)

    places = _once(F.sort_array(looked_up), lambda hits: F.struct(hits.alias("hits"), verified(hits).alias("found")))
    share = F.array_max(
        F.transform(
            F.col("_places.found"),
            lambda place: F.size(F.filter("_places.hits", lambda x: x == place)) / F.element_at(indexed, place["template"] + 1),
        )
    )
    reported = F.transform(
        "_places.found",
        lambda place: F.struct(
            F.element_at(labels, place["template"] + 1).alias("label"),
            place["start"].cast("long").alias("start"),
            F.element_at(bases, place["template"] + 1).alias("base"),
        ),
    )
    return (
        docs.select(F.col(key), license_words(text).alias("_words"))
        .select(F.col(key), F.size("_words").cast("long").alias("n_words"), places.alias("_places"))
        .select(
            F.col(key),
            "n_words",
            reported.alias("places"),
            F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)).alias("score"),
        )
    )
