"""License scans: ordered signature rules on normalised words, in native columns.

A text is reduced to its words between single spaces, so that layout and
punctuation do not matter. Texts without any keyword are done. For the others,
rules whose keyword occurs are matched; detections inside a longer one, or on
the same words as one of a better rule, are suppressed, and of two that overlap
in part the better rule's stays. Everything is one projection, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearly.llm.common import ascii_lower

# What is between words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that always count, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# (label, names as they stand in prose, SPDX identifier in words), normalised.
FAMILIES = (
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl)(?: v| version| version v)? ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: v| version| version v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: v| version| version v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v| version)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v| version)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: v| version)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", r"(?:gnu )?free documentation license", r"gfdl 1 [123](?: only| or later)?"),
    ("apache-1.1", r"apache (?:software )?license(?: v| version)? ?1 1", r"apache 1 1"),
    ("apache-2.0", r"apache (?:software )?license(?: v| version)? ?2(?: 0)?", r"apache 2 0"),
    ("mit", r"(?:the )?mit license", r"mit"),
    ("x11", r"x11 license", r"x11"),
    ("isc", r"isc license", r"isc"),
    ("bsd-2-clause", r"(?:simplified|2 clause|two clause|freebsd) bsd license", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd license", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd license", r"bsd 4 clause"),
    ("0bsd", r"(?:zero clause|0 clause) bsd license", r"0bsd"),
    ("mpl-1.1", r"mozilla public license(?: v| version)? ?1 1", r"mpl 1 1"),
    ("mpl-2.0", r"mozilla public license(?: v| version)? ?2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", r"eclipse public license(?: v| version)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", r"eclipse public license(?: v| version)? ?2(?: 0)?", r"epl 2 0"),
    ("cddl-1.0", r"common development and distribution license", r"cddl 1 [01]"),
    ("eupl", r"european union public license", r"eupl 1 [12]"),
    ("artistic-2.0", r"artistic license(?: v| version)?(?: 2(?: 0)?)?", r"artistic [12] 0"),
    ("zlib", r"zlib license", r"zlib"),
    ("boost-1.0", r"boost software license", r"bsl 1 0"),
    ("python-2.0", r"python (?:software foundation )?license", r"psf 2 0"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", r"do what the fuck you want to public license", r"wtfpl"),
    ("ofl-1.1", r"(?:sil )?open font license", r"ofl 1 1"),
    ("odbl", r"open database license", r"odbl 1 0"),
    ("pddl", r"public domain dedication and license", r"pddl 1 0"),
    ("cc0-1.0", r"(?:creative commons zero|cc0)(?: 1 0)?", r"cc0 1 0"),
    ("cc-by", r"(?:creative commons attribution|cc by)(?: [1234] [05])?", r"cc by [1234] [05]"),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    ("proprietary", r"(?:proprietary|commercial) license", r"licenseref proprietary"),
    ("ms-pl", r"microsoft public license", r"ms pl"),
    ("openssl", r"openssl license", r"openssl"),
    ("ruby", r"ruby license", r"ruby"),
    ("php-3.01", r"php license", r"php 3 01"),
    ("postgresql", r"postgresql license", r"postgresql"),
)

# What every name of a family holds, where that is not a plain word of the label.
KEYWORDS = {
    "gpl": "general public|gpl", "lgpl": "lesser general|lgpl", "agpl": "affero|agpl",
    "gfdl": "free documentation", "mit": "mit license", "x11": "x11 license", "isc": "isc license",
    "bsd": "bsd license", "0bsd": "bsd license", "mpl": "mozilla public", "epl": "eclipse public",
    "cddl": "common development", "eupl": "european union public", "artistic": "artistic license",
    "zlib": "zlib license", "boost": "boost software", "python": "python (?:software|license)",
    "wtfpl": "do what the fuck", "ofl": "open font", "odbl": "open database",
    "pddl": "public domain dedication", "cc0": "creative commons zero|cc0",
    "cc": "creative commons attribution|cc by", "proprietary": "(?:proprietary|commercial) license",
    "ms": "microsoft public", "openssl": "openssl license", "ruby": "ruby license",
    "php": "php license", "postgresql": "postgresql license",
}

# Every match of every rule holds one of these, so a text without any is done.
GATE = (
    "licens", "gpl", "cc by", "cc0", "creative commons", "spdx", "public domain", "copyright",
    "all rights", "free software", "later version", "redistribution and use", "permission",
    "source code form", "unencumbered", "plainly marked", "without warranty",
    "agreed to in writing",
)

# How a text refers to a family: (words before its name, weight), best first.
FORMS = (
    (r"(?:is |are )?licensed under (?:the )?(?:terms of (?:the )?)?", 0.95),
    (r"(?:is |are )?released under (?:the )?(?:terms of (?:the )?)?", 0.95),
    (r"(?:is |are )?distributed under (?:the )?(?:terms of (?:the )?)?", 0.95),
    (r"(?:made )?available under (?:the )?(?:terms of (?:the )?)?", 0.9),
    (r"under the terms (?:and conditions )?of (?:the )?", 0.9),
    (r"(?:subject to|governed by|covered by) (?:the )?", 0.8),
    (r"", 0.6),
)

# Words of the licenses themselves and of notices: (label, pattern, keyword, weight).
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license", "agreed to in writing", 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "is free software", 1.0),
    ("gpl", r"either version [123] of the license or at your option any later version", "any later version", 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked", 1.0),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization", "person or organization", 1.0),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain", 0.9),
    ("public-domain", r"public domain", "public domain", 0.5),
    ("all-rights-reserved", r"all rights reserved", "all rights", 0.7),
    ("no-warranty", r"(?:provided )?as is without warranty of any kind", "without warranty", 0.4),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 0.5),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  # on normalised words; matches whole words
    keyword: str  # pattern that every text with a match holds
    weight: float


def rules() -> tuple[Rule, ...]:
    """All rules, the best first: license texts, SPDX tags, references, mere names."""
    out = [Rule(label, p, k, w) for label, p, k, w in TEXTS]
    keyword = {x: KEYWORDS.get(x.split("-")[0], x.split("-")[0]) for x, _, _ in FAMILIES}
    out += [Rule(x, f"spdx license identifier {spdx}", "spdx", 1.0) for x, _, spdx in FAMILIES]
    for before, weight in FORMS:
        out += [Rule(x, before + name, keyword[x], weight) for x, name, _ in FAMILIES]
    return tuple(out)


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _matches(padded: Column, rule: Column) -> Column:
    """Places of one rule: array of (start, end) in words, with the rule's fields."""
    pattern = rule["pattern"]
    steps = F.arrays_zip(
        F.split(padded, pattern, -1).alias("gap"),
        F.regexp_extract_all(padded, pattern, F.lit(0)).alias("hit"),
    )
    none = F.array().cast("array<struct<start:int,size:int>>")
    found = F.aggregate(
        F.filter(steps, lambda s: s["hit"].isNotNull()),
        F.struct(F.lit(-1).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + _spaces(s["gap"]) + _spaces(s["hit"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + _spaces(s["gap"])).alias("start"),
                        (_spaces(s["hit"]) + 1).alias("size"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            (-(m["start"] + m["size"])).alias("minus_end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["weight"].alias("weight"),
        ),
    )


_DETECTIONS = "array<struct<start:int,minus_end:int,priority:int,label:string,weight:double>>"


def _resolved(detections: Column) -> Column:
    """From left to right, longest and best first: what the last kept one contains
    is dropped; where two overlap in part, the better rule stays."""

    def step(kept: Column, d: Column) -> Column:
        last = F.element_at(kept, -1)
        after = F.concat(kept, F.array(d))
        return (
            F.when((F.size(kept) == 0) | (d["start"] >= -last["minus_end"]), after)
            .when((d["minus_end"] >= last["minus_end"]) | (d["priority"] >= last["priority"]), kept)
            .otherwise(F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(d)))
        )

    return F.aggregate(F.sort_array(detections), F.array().cast(_DETECTIONS), step)


def _table(found: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"),
                F.lit(r.label).alias("label"),
                F.lit(_whole(r.pattern)).alias("pattern"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.weight).alias("weight"),
            )
            for i, r in enumerate(found)
        ]
    )


def scan(docs: DataFrame, text: str = "text", found: tuple[Rule, ...] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``licenses``.

    ``base`` holds every place of the base phrases, ``licenses`` the detections
    that remain, both as (start, end, label, weight) in words from 0. A NULL or
    empty text has no words and no detections. Rows never meet, so repeated rows
    get equal results; columns of these names are replaced. Rules given as ``found`` are gated
    by their own keywords alone. Time grows with the square of the detections of one text
    (some 10 s for 5,000); nothing is cut.
    """
    every = list(found if found is not None else rules())
    phrases = [Rule(label, phrase, phrase, 0.5) for phrase, label in BASE]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "base", "licenses")]
    words = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP, " "))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))

    may_match = reduce(Column.__or__, [F.contains(F.col("w"), F.lit(g)) for g in GATE])

    def detected(table: list[Rule], gated: bool = True) -> Column:
        some = F.filter(_table(table), lambda r: F.rlike(padded, r["keyword"]))
        places = F.flatten(F.transform(some, lambda r: _matches(padded, r)))
        return F.when(may_match, places).otherwise(F.array().cast(_DETECTIONS)) if gated else places

    def shown(detections: Column) -> Column:
        return F.transform(
            detections,
            lambda d: F.struct(
                d["start"].cast("bigint").alias("start"),
                (-d["minus_end"]).cast("bigint").alias("end"),
                d["label"].alias("label"),
                d["weight"].alias("weight"),
            ),
        )

    n_words = F.when(F.col("w") == "", F.lit(0)).otherwise(_spaces(F.col("w")) + 1)
    return (
        docs.select(F.struct(*kept).alias("row"), words.alias("w"))
        .select("row", "w", detected(phrases).alias("b"), detected(every, found is None).alias("d"))
        .select(
            "row.*",
            n_words.cast("bigint").alias("n_words"),
            shown(F.col("b")).alias("base"),
            shown(_resolved(F.col("d"))).alias("licenses"),
        )
    )
