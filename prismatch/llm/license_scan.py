"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words, joined by single spaces. Every rule is a regular
expression over them with keywords, a priority and a confidence. Whatever a rule
matches holds one of its keywords: a text without any keyword of any rule is done,
on the others a rule runs only where a keyword of its own occurs.
Detections are word intervals; one that lies inside another of a stronger rule is
suppressed. Base phrases are reported whether suppressed or not.

Defined cases: null and empty texts have no words and no labels; labels of equal
name count once; equal detections of several rules leave the strongest; repeated
rows each get their result; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and labels: fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

@dataclass(frozen=True)
class Rule:
    """A smaller ``priority`` is stronger; ``keyword`` has strings, parted by ``|``, of which every match between spaces holds one."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


#: (label, name as a pattern over words, keyword, versions)
FAMILIES = (
    ("gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)", "gpl|general public", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|lgpl", "lgpl|r general public|y general public", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|agpl", "agpl|affero", ("1 0", "3 0", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", "gfdl|free documentation", ("1 1", "1 2", "1 3")),
    ("apache", r"apache(?: software)? licen[cs]e", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mit", r"(?:the )?(?:mit|expat|x11) licen[cs]e", "mit licen|expat licen|x11 licen", ()),
    ("bsd", r"(?:new |modified |simplified |original )?bsd(?: style)? licen[cs]e", "bsd", ()),
    ("bsd-2-clause", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?", " bsd ", ()),
    ("bsd-3-clause", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?", " bsd ", ()),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla public| mpl ", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[cs]e|epl", "eclipse public| epl ", ("1 0", "2 0")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "cddl|common development", ("1 0", "1 1")),
    ("cpl", r"common public licen[cs]e", "common public", ("1 0",)),
    ("eupl", r"european union public licen[cs]e|eupl", "eupl|european union public", ("1 0", "1 1", "1 2")),
    ("artistic", r"(?:the )?(?:perl )?artistic licen[cs]e", "artistic licen", ("1 0", "2 0")),
    ("isc", r"isc licen[cs]e", "isc licen", ()),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("bsl", r"boost software licen[cs]e", "boost software", ("1 0",)),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", "psf licen|python software", ("2",)),
    ("unlicense", r"(?:the )?unlicense", "unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "wtfpl|fuck", ("1", "2")),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("openssl", r"openssl licen[cs]e", "openssl", ()),
    ("ofl", r"(?:sil )?open font licen[cs]e|ofl", "open font| ofl ", ("1 0", "1 1")),
    ("odbl", r"open database licen[cs]e|odbl", "open database|odbl", ("1 0",)),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft public| ms pl ", ()),
    ("cc-by", r"cc by|creative commons attribution(?: licen[cs]e)?", "cc by|commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike(?: licen[cs]e)?", "cc by sa|attribution share", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial(?: licen[cs]e)?", "cc by nc|attribution non", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: licen[cs]e)?", "cc by nd|attribution no", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", "cc by nc sa|commercial share", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: licen[cs]e)?", "cc by nc nd|commercial no", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", r"cc0|creative commons zero|cc zero", "cc0|commons zero|cc zero", ("1 0",)),
)

#: Signatures that are no family's name: (label, pattern, keyword, priority, weight)
SIGNATURES = (
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation", "free software foundation", 1, 1.0),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation", "free software foundation", 1, 1.0),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", "free software foundation", 1, 1.0),
    ("gpl-or-later", r"either version \d+(?: \d+)? of the licen[cs]e or at your option any later version", "any later version", 1, 0.95),
    ("apache", r"licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the licen[cs]e", "compliance with the licen", 1, 1.0),
    ("apache", r"you may obtain a copy of the licen[cs]e at http(?:s)? www apache org licenses license 2 0", "apache org", 1, 1.0),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge", 1, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee", 1, 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", 1, 0.95),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "endorse or promote", 1, 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable", 1, 0.9),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "source code form", 1, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1, 1.0),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "or organization obtaining", 1, 0.95),
    ("public-domain", r"(?:released|placed|dedicated|donated) (?:in ?to|to) the public domain", "public domain", 2, 0.9),
    ("public-domain", r"(?:is|are) in the public domain", "public domain", 3, 0.8),
    ("public-domain", r"public domain", "public domain", 6, 0.4),
    ("proprietary", r"(?:confidential|proprietary) and (?:confidential|proprietary)", "proprietary and|confidential and", 4, 0.6),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed|distributed) (?:\S+ ){0,8}without (?:\S+ ){0,4}permission", "may not be", 3, 0.7),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved", 5, 0.5),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 7, 0.3),
    ("cc", r"creative commons(?: public)? licen[cs]e", "creative commons", 6, 0.5),
    ("free-license", r"(?:released|available|published|licensed) under (?:a|an) (?:free|open(?: source)?) licen[cs]e", "under a", 6, 0.5),
    ("unknown-license", r"licen[cs]ed under", "sed under|ced under", 8, 0.2),
    ("unknown-license", r"see (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?: file)? for details", "for details", 8, 0.2),
)


def rules() -> list[Rule]:
    """All rules: the signatures, and for every family its name alone, granted, declared and with its versions."""
    granted = r"(?:released|licensed|distributed|available|published|provided|covered|made available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?"
    out = [Rule(label, pattern, keyword, priority, weight) for label, pattern, keyword, priority, weight in SIGNATURES]
    for label, name, keyword, versions in FAMILIES:
        out.append(Rule(label, rf"(?:{name})", keyword, 5, 0.7))
        out.append(Rule(label, rf"{granted}(?:{name})", keyword, 4, 0.85))
        out.append(Rule(label, rf"(?:spdx )?licen[cs]e identifier {label.replace('-', ' ')}", "nse identifier|nce identifier", 2, 1.0))
        for v in versions:
            version = rf"(?: version| v)? v?{v}(?! \d)"
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", rf"(?:{granted})?(?:{name}){version}", keyword, 3, 0.95))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}-or-later", rf"(?:{granted})?(?:{name}){version} or (?:\(?at your option\)? )?(?:any )?later(?: version)?", keyword, 2, 0.95))
    return out


def gate_words(using: list[Rule]) -> list[str]:
    """The fewest strings of which every match of a rule, and every base phrase, holds one."""
    words = {k for r in using for k in r.keyword.split("|")} | {f" {p} " for p in BASE}
    return sorted(w for w in words if not any(v in w for v in words - {w}))


def normalised(text: Column) -> Column:
    """Lower-cased words joined by single spaces, one space in front and behind; two spaces where there are none."""
    words = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.concat(F.lit(" "), F.lower(words), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def word_count(norm: Column) -> Column:
    return F.when(F.octet_length(norm) <= 2, F.lit(0)).otherwise(_spaces(norm) - 1)


_SPAN = "array<struct<start:int,end:int>>"


def word_spans(norm: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches of a pattern between spaces."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    between = F.transform(F.split(norm, bounded, -1), _spaces)
    inside = F.transform(F.regexp_extract_all(norm, bounded, F.lit(0)), _spaces)
    none = F.struct(F.lit(-1).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        end = start + x["1"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (end + 1).alias("end")))).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(between, F.lit(1), F.size(inside)).alias("0"), inside.alias("1")), none, add, lambda acc: acc["out"])


def detections(norm: Column, using: list[Rule]) -> Column:
    """Detections that no stronger one contains: array of ``start, end, label, priority, weight, id``."""
    table = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.keyword.split("|")).alias("keywords"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"))
        for i, r in enumerate(using)
    ])
    gated = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, k)))
    found = F.flatten(F.transform(gated, lambda r: F.transform(word_spans(norm, r["pattern"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["id"].alias("id")))))
    return found


def suppressed(found: Column) -> Column:
    """Only the detections that lie in no interval of a stronger rule; of equals the longer, then the earlier rule."""

    def stronger(a: Column, b: Column) -> Column:
        size_a, size_b = a["end"] - a["start"], b["end"] - b["start"]
        return (a["priority"] < b["priority"]) | ((a["priority"] == b["priority"]) & ((size_a > size_b) | ((size_a == size_b) & (a["id"] < b["id"]))))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & stronger(e, d)))


def scan(docs: DataFrame, *, text: str = "text", out: str = "__licenses", using: list[Rule] | None = None) -> DataFrame:
    """Add struct ``out``: n_words, base (phrase intervals with labels) and found (kept detections)."""
    using = rules() if using is None else using
    norm = docs.withColumn("__norm", normalised(F.col(text)))
    n = F.col("__norm")
    gate = F.lit(False)
    for word in gate_words(using):
        gate = gate | F.contains(n, F.lit(word))
    base_kind, found_kind = "array<struct<start:int,end:int,label:string>>", "array<struct<start:int,end:int,label:string,priority:int,weight:double,id:int>>"
    none = F.array().cast(base_kind)

    def places(phrase: str, label: str) -> Column:
        spans = F.transform(word_spans(n, F.lit(phrase)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains(n, F.lit(f" {phrase} ")), spans).otherwise(none)

    base = F.concat(*[places(phrase, label) for phrase, label in BASE.items()])
    gated = norm.withColumn("__gate", gate)
    raw = gated.withColumn("__base", F.when(F.col("__gate"), base).otherwise(none)).withColumn(
        "__found", F.when(F.col("__gate"), detections(n, using)).otherwise(F.array().cast(found_kind))
    )
    packed = F.struct(word_count(n).cast("bigint").alias("n_words"), F.col("__base").alias("base"), suppressed(F.col("__found")).alias("found"))
    return raw.withColumn(out, packed).drop("__norm", "__gate", "__base", "__found")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, labels and the strongest confidence."""
    found = scan(docs.select("doc_id", "text"))
    s = F.col("__licenses")
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform(s["base"], lambda x: x["start"].cast("bigint"))
    weight = F.coalesce(F.array_max(F.transform(s["found"], lambda x: x["weight"])), F.lit(0.0))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), s["n_words"].alias("n_words"), F.size(s["base"]).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(names(s["base"])).alias("base_labels"),
        joined(F.concat(names(s["base"]), names(s["found"]))).alias("labels"), weight.alias("score"),
    )
