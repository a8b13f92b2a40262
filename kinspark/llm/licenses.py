"""License scans: ordered signature rules over normalised words.

Each rule is a regular expression over the text's words joined by single spaces,
gated by a keyword that every match contains; texts with none of the phrases that
every match needs one of (HEADS, or a sentence's keyword) skip the rules. Rules come from a
grid of license names and phrasings, which covers SPDX ids, from acronyms that tell
a license wherever they stand, and from sentences of the licenses' own texts. Where detections overlap, the one of higher priority (then
the longer, then the earlier rule) suppresses those whose interval it contains.

Defined results: a null text counts as empty; texts without words have no
detections, null positions and score 0; repeated rows give repeated results; of
equal intervals and priorities the earlier rule stays; an empty table gives an empty
table; texts of any length are scanned whole, in time that grows with their matches
and not with the square of those; further columns of the input are kept unless they bear the name of an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T

#: Phrases whose every place is reported, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword, and the license's name as a pattern over words.
NAMES = (
    ("mit", "mit", r"mit(?: x11)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: 2(?: 0)?)?"),
    ("apache-1.1", "apache", r"apache(?: software)? 1 1"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("gpl-2", "public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3", "public", r"gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?"),
    ("gpl", "public", r"gnu general public"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license(?: version)? 2 1"),
    ("lgpl-3", "lesser", r"gnu lesser general public license(?: version)? 3(?: 0)?"),
    ("lgpl", "general", r"gnu (?:lesser|library) general public"),
    ("agpl-3", "affero", r"gnu affero general public(?: license)?(?: version)?(?: 3(?: 0)?)?"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version)? 1 1"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version)?(?: 2 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version)? 1 0"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version)?(?: 2 0)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: 2 0)?"),
    ("boost-1", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("python-2", "python", r"python software foundation"),
    ("postgresql", "postgresql", r"postgresql"),
    ("eupl", "european", r"european union public"),
    ("ofl-1.1", "font", r"sil open font"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("proprietary", "proprietary", r"proprietary"),
)

#: Phrasings around a name, their confidence and rank.
PHRASES = (
    (r"(?:is |are |be )?(?:re|sub)?licensed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?(?: version [0-9]+(?: [0-9]+)?)?", 1.0, 9),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?(?: version [0-9]+(?: [0-9]+)?)?", 1.0, 8),
    (r"under (?:the )?terms (?:and conditions )?of (?:the )?{name} licen[cs]e", 0.95, 7),
    (r"spdx license identifier {name}(?: [0-9])*(?: only| or later)?", 1.0, 9),
    (r"{name} (?:public )?licen[cs]e(?: agreement)?(?: version [0-9]+(?: [0-9]+)?)?", 0.8, 5),
    (r"licen[cs]e {name}", 0.7, 4),
)
_VERSION = r"(?: licen[cs]e)? ?(?:version |v ?)?"
_LATER = r"(?: only| or (?:any )?later(?: version)?)?"

#: Acronyms and SPDX ids, in every phrasing as the names are.
ACRONYMS = (
    ("gpl-1", "gpl", rf"(?:gnu )?gpl{_VERSION}1(?: 0)?{_LATER}"),
    ("gpl-2", "gpl", rf"(?:gnu )?gpl{_VERSION}2(?: 0)?{_LATER}"),
    ("gpl-3", "gpl", rf"(?:gnu )?gpl{_VERSION}3(?: 0)?{_LATER}"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_VERSION}2 1{_LATER}"),
    ("lgpl-2", "lgpl", rf"(?:gnu )?lgpl{_VERSION}2(?: 0)?{_LATER}"),
    ("lgpl-3", "lgpl", rf"(?:gnu )?lgpl{_VERSION}3(?: 0)?{_LATER}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-3", "agpl", rf"(?:gnu )?agpl{_VERSION}3(?: 0)?{_LATER}"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("mpl-1.1", " mpl", rf"mpl{_VERSION}1 1"),
    ("mpl-2", " mpl", rf"mpl{_VERSION}2(?: 0)?(?: no copyleft exception)?"),
    ("mpl", " mpl", r"mpl"),
    ("epl-1", " epl", rf"epl{_VERSION}1(?: 0)?"),
    ("epl-2", " epl", rf"epl{_VERSION}2(?: 0)?"),
    ("epl", " epl", r"epl"),
    ("boost-1", " bsl", rf"bsl{_VERSION}1 0"),
    ("eupl", "eupl", rf"eupl(?:{_VERSION}1 [0-2])?"),
    ("ofl-1.1", " ofl", rf"(?:sil )?ofl(?:{_VERSION}1 [01])?"),
    ("python-2", " psf", r"psf(?: 2 0)?"),
    ("python-2", "python", r"python 2 0"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
)

#: Of these, what tells a license without any phrase around it: those with a version, and GNU's.
ALONE = ("gpl-1", "gpl-2", "gpl-3", "gpl", "lgpl-2", "lgpl-2.1", "lgpl-3", "lgpl", "agpl-3", "agpl", "mpl-1.1", "mpl-2", "epl-1", "epl-2")

_EITHER = r"(?: as)? published by the free software foundation(?: either)?"

#: Label, keyword and a sentence of the license's own text or notice.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("boost-1", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl-1.1", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,20}?(?:nor the names of (?:its|their|other|any) contributors )?may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission to use copy modify and", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("zlib", "without any express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", "each contributor hereby grants to you", r"grant of (?:copyright|patent) license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("mpl-2", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("epl-2", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?2 0"),
    ("epl-1", "accompanying materials are made available", r"(?:this program and the|all rights reserved this program and the) accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?1 0"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to(?: public license)?"),
    ("cc0", "dedicated the work to the public domain", r"(?:has|have) dedicated the work to the public domain"),
    *((f"{short}-{v}", "gnu", rf"under the terms of the gnu {kind}general public licen[cs]e{_EITHER} version {v}(?: 0)?(?: of the licen[cs]e)?(?: or at your option any later version)?") for short, kind in (("gpl", ""), ("lgpl", "(?:lesser|library) "), ("agpl", "affero ")) for v in (2, 3) if (short, v) != ("agpl", 2)),
    ("lgpl-2.1", "gnu", rf"under the terms of the gnu (?:lesser|library) general public licen[cs]e{_EITHER} version 2 1(?: of the licen[cs]e)?(?: or at your option any later version)?"),
)

#: Keywords that stand as words of their own in every match, and inside many other words.
WHOLE = ("mit", "cc", "isc")

#: Words of a block; more than any rule's match has.
BLOCK = 256

#: What every match of the grid, of the base phrases or of an acronym alone contains one
#: of: its phrase's word license, or the second phrasing's head, or the acronym.
HEADS = ("licens", "licenc", "cc by", "released under", "distributed under", "published under", "available under", "provided under", " gpl", " lgpl", " agpl", " mpl", " epl")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """Base phrases first, then every name and acronym in every phrasing, acronyms alone, and sentences."""
    whole = lambda k: f" {k} " if k in WHOLE else k
    made = [Rule(label, whole(label.split("-")[0]), phrase, 10, 1.0) for phrase, label in BASE]
    for label, keyword, name in NAMES + ACRONYMS:
        for phrase, weight, priority in PHRASES:
            made.append(Rule(label, whole(keyword), phrase.replace("{name}", name), priority, weight))
    made += [Rule(label, whole(keyword), name, 3, 0.7) for label, keyword, name in ACRONYMS if label in ALONE]
    made += [Rule(label, keyword, sentence, 7, 0.9) for label, keyword, sentence in SENTENCES]
    return made


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches in ' w0 w1 ... '."""
    regex = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    return F.transform(T.matches(norm, regex, _spaces), lambda m: F.struct((m["start"] - 1).alias("a"), m["end"].alias("b")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base_places, detections and score to docs.

    base_places: array of (label, a, b), all places of the base phrases.
    detections: array of (label, a, b, priority, weight) left after suppression."""
    rs = rules()
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), T.NO_WORD, " ")), F.lit(" "))
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(i).alias("rank")) for i, r in enumerate(rs)])
    kind = "array<struct<label:string,a:int,b:int,priority:int,weight:double,rank:int>>"
    low = T.ascii_lower(F.col("__norm"))

    def found(r):
        return F.transform(_places(F.col("__low"), r["pattern"]), lambda p: F.struct(r["label"].alias("label"), p["a"].alias("a"), p["b"].alias("b"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["rank"].alias("rank")))

    def beaten(x, y):
        wider = (y["b"] - y["a"]) > (x["b"] - x["a"])
        inside = (y["a"] <= x["a"]) & (y["b"] >= x["b"])
        tie = (y["b"] - y["a"] == x["b"] - x["a"]) & (y["rank"] < x["rank"])
        return inside & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (wider | tie)))

    out = docs.drop("__norm", "__low", "__all", "__blocks").withColumn("__norm", norm)
    out = out.withColumn("__low", low)
    some = dict.fromkeys([*HEADS, *(k for _, k, _ in SENTENCES if k != "gnu")])  # sentences with gnu hold the word license
    gate = F.lit(False)
    for k in some:
        gate = gate | F.contains(F.col("__low"), F.lit(k))
    gated = F.filter(table, lambda r: F.contains(F.col("__low"), r["keyword"]))
    out = out.withColumn("__all", F.when(gate, F.flatten(F.transform(gated, found))).otherwise(F.array().cast(kind)))
    base = F.filter(F.col("__all"), lambda x: x["rank"] < len(BASE))
    # Detections by blocks of words where they start; one that holds another starts in its block or the one before.
    block = lambda x: F.floor(x["a"] / BLOCK).cast("int")
    last = F.array_max(F.transform("__all", block))
    blocks = F.when(F.size("__all") > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.filter("__all", lambda x: block(x) == k)))
    out = out.withColumn("__blocks", blocks)
    within = lambda x, k: F.exists(F.get("__blocks", k), lambda y: beaten(x, y))
    kept = F.filter(F.col("__all"), lambda x: ~(within(x, block(x)) | ((block(x) > 0) & within(x, block(x) - 1))))
    return out.withColumns({
        "n_words": F.when(F.col("__norm") == "  ", F.lit(0)).otherwise(_spaces(F.col("__norm")) - 1).cast("long"),
        "base_places": F.array_sort(F.transform(base, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["label"].alias("label")))),
        "detections": kept,
        "score": F.coalesce(F.array_max(F.transform(kept, lambda x: x["weight"])), F.lit(0.0)),
    }).drop("__norm", "__low", "__all", "__blocks")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, extremes and labels."""
    x = scan(docs.select("doc_id", "text"))
    base = F.transform("base_places", lambda p: p["label"])
    return x.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(F.transform("base_places", lambda p: p["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base_places", lambda p: p["a"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        "score",
    )
