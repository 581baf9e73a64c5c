"""License scans: ordered signature rules over normalized words.

Rules are signatures of licenses' own words (bodies, notices and headers, written by hand), and phrases around the names of
license families, each with a priority. A document is looked at more closely only if it has one of a few trigger strings, which
every rule implies, and a rule's regular expression runs only where its keyword, a string that any match has, occurs. A detection inside the interval of one that goes before it (by
priority, then length, then place) is suppressed; what is left gives the labels.
"""

from __future__ import annotations

import json
import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let, running

# Labels and names (regular expressions over lower-case words) of license families.
FAMILIES = """
mit | (?:mit|expat)
mit-0 | mit (?:0|no attribution)
x11 | x11
apache-2 | apache(?: software)?(?: license)? (?:version )?v?2(?: 0)?
apache-1.1 | apache(?: software)?(?: license)? (?:version )?v?1 1
apache | apache(?: software)?
gpl-3 | (?:gnu general public license|gnu gpl|gpl)(?: version)? v?3(?: 0)?
gpl-2 | (?:gnu general public license|gnu gpl|gpl)(?: version)? v?2(?: 0)?
gpl | (?:gnu general public|gnu gpl|gpl|gplv[123])
lgpl-3 | (?:gnu lesser general public license|gnu lgpl|lgpl)(?: version)? v?3(?: 0)?
lgpl-2.1 | (?:gnu lesser general public license|gnu lgpl|lgpl)(?: version)? v?2 1
lgpl | (?:gnu lesser general public|gnu lgpl|lgpl)
agpl-3 | (?:gnu affero general public license|gnu agpl|agpl)(?: version)? v?3(?: 0)?
agpl | (?:gnu affero general public|gnu agpl|agpl)
gfdl | (?:gnu free documentation|gfdl)
bsd-2 | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)
bsd-3 | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)
bsd-4 | (?:bsd 4 clause|4 clause bsd|original bsd)
bsd | bsd(?: style)?
0bsd | (?:0bsd|zero clause bsd)
isc | isc
mpl-1.1 | (?:mozilla public license|mpl)(?: version)? v?1 1
mpl-2 | (?:mozilla public license|mpl)(?: version)? v?2(?: 0)?
mpl | (?:mozilla public|mpl)
epl-1 | (?:eclipse public license|epl)(?: version)? v?1(?: 0)?
epl-2 | (?:eclipse public license|epl)(?: version)? v?2(?: 0)?
epl | (?:eclipse public|epl)
cddl | (?:common development and distribution|cddl)
cpl | (?:common public|cpl)
eupl | (?:european union public|eupl)
artistic-2 | artistic(?: license)?(?: version)? v?2(?: 0)?
artistic | (?:perl )?artistic
zlib | (?:zlib|zlib libpng)
libpng | libpng
boost | boost(?: software)?
unlicense | (?:the )?unlicense
wtfpl | (?:do what the fuck you want to public|wtfpl)
cc0 | (?:cc0|cc zero|creative commons zero)
cc-by-nc-nd | (?:cc by nc nd|creative commons attribution noncommercial no ?deriv\\w*)
cc-by-nc-sa | (?:cc by nc sa|creative commons attribution noncommercial share ?alike)
cc-by-nc | (?:cc by nc|creative commons attribution non ?commercial)
cc-by-nd | (?:cc by nd|creative commons attribution no ?deriv\\w*)
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike)
cc-by | (?:cc by|creative commons attribution)
creative-commons | creative commons
odbl | (?:open database|odbl)
odc-by | (?:open data commons attribution|odc by)
pddl | (?:public domain dedication and|pddl)
ofl | (?:sil open font|open font|ofl)
openssl | openssl
python | (?:python software foundation|psf|python)
ruby | ruby(?: s)?
php | php
postgresql | postgresql
w3c | w3c(?: software)?
icu | (?:icu|unicode)
ncsa | (?:university of illinois ncsa|university of illinois|ncsa)(?: open source)?
ms-pl | (?:microsoft public|ms pl)
ms-rl | (?:microsoft reciprocal|ms rl)
osl-3 | (?:open software license|osl)(?: version)? v?3(?: 0)?
afl-3 | (?:academic free license|afl)(?: version)? v?3(?: 0)?
bsl-1.1 | (?:business source license|busl)(?: version)? v?1 1
sspl | (?:server side public|sspl)
elastic | elastic
commons-clause | commons clause
json | json
beerware | beer ?ware
public-domain | (?:the )?public domain
proprietary | (?:proprietary|commercial)
"""
# Label, words of the license itself or of its usual notice (a regular expression over lower-case words), keyword.
SIGNATURES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | hereby granted free of charge
mit | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software | substantial portions of the software
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | software is provided as is
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish | deal in the software without restriction
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}to permit persons to whom the software is furnished to do so the software is provided | furnished to do so the software is provided
x11 | except as contained in this notice the names? of .{1,80}shall not be used in advertising or otherwise to promote the sale | except as contained in this notice
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution and use in source and binary
bsd | redistributions of source code must retain the above copyright notice this list of conditions | redistributions of source code must retain
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions | redistributions in binary form must reproduce
bsd-3 | neither the names? of .{1,80}nor the names of (?:its|their) contributors may be used to endorse or promote products | used to endorse or promote products
bsd-4 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | all advertising materials mentioning features
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided | without fee is hereby granted the software
apache-2 | you may not use this file except in compliance with the license you may obtain a copy of the license at | except in compliance with the license
apache-2 | terms and conditions for use reproduction and distribution 1 definitions license shall mean | terms and conditions for use reproduction and distribution
apache-2 | http www apache org licenses license 2 0 | apache org licenses license 2 0
apache-2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | perpetual worldwide non exclusive no charge royalty free
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | redistribute it and or modify it under the terms
gpl | you should have received a copy of the gnu general public license along with this program | received a copy of the gnu general public license
gpl | the gnu general public license is a free copyleft license for software and other kinds of works | free copyleft license for software
gpl-2 | gnu general public license version 2 june 1991 | version 2 june 1991
gpl-2 | either version 2 of the license or at your option any later version | either version 2 of the license
gpl-3 | gnu general public license version 3 29 june 2007 | version 3 29 june 2007
gpl-3 | either version 3 of the license or at your option any later version | either version 3 of the license
lgpl | under the terms of the gnu lesser general public license as published by the free software foundation | gnu lesser general public license as published
lgpl | this library is free software you can redistribute it and or modify it | this library is free software
lgpl-2.1 | either version 2 1 of the license or at your option any later version | either version 2 1 of the license
lgpl-3 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 | incorporates the terms and conditions of version 3
agpl-3 | gnu affero general public license version 3 19 november 2007 | version 3 19 november 2007
agpl | under the terms of the gnu affero general public license as published by the free software foundation | gnu affero general public license as published
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | gnu free documentation license
mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0 | source code form is subject to the terms
mpl-2 | if a copy of the mpl was not distributed with this file you can obtain one at | copy of the mpl was not distributed
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 | contents of this file are subject to the mozilla
epl | the accompanying program is provided under the terms of this eclipse public license agreement | terms of this eclipse public license
epl-2 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0 | accompanying materials are made available under the terms
epl-1 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | accompanying materials are made available under the terms
cddl | the contents of this file are subject to the terms of the common development and distribution license | common development and distribution license
cpl | the accompanying program is provided under the terms of this common public license | terms of this common public license
eupl | licen[sc]ed under the eupl | under the eupl
artistic-2 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms | this license establishes the terms
artistic | the intent of this document is to state the conditions under which a package may be copied | conditions under which a package may be copied
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable | in no event will the authors be held liable
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software | origin of this software must not be misrepresented
libpng | this copyright notice may not be removed or altered from any source or altered source distribution | may not be removed or altered from any source
boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software | any person or organization obtaining a copy
unlicense | this is free and unencumbered software released into the public domain | free and unencumbered software released
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | free to copy modify publish use compile sell
wtfpl | you just do what the fuck you want to | do what the fuck you want to
cc0 | the person who associated a work with this deed has dedicated the work to the public domain | associated a work with this deed
cc0 | to the extent possible under law .{1,80}has waived all copyright and related or neighboring rights | waived all copyright and related
public-domain | (?:has been |is |are )?(?:hereby )?(?:dedicated to|placed in(?:to)?|released (?:in)?to) the public domain | the public domain
cc-by | this work is licen[sc]ed under a creative commons attribution (?:4 0|3 0|2 5|2 0) | under a creative commons attribution
cc-by-sa | this work is licen[sc]ed under a creative commons attribution share ?alike | under a creative commons attribution
cc-by-nc | this work is licen[sc]ed under a creative commons attribution non ?commercial (?:4 0|3 0|2 5|2 0) | under a creative commons attribution
creative-commons | creativecommons org licenses | creativecommons org licenses
odbl | this database is made available under the open database license | available under the open database license
pddl | the person who associated a work with this document has dedicated the work to the commons | dedicated the work to the commons
ofl | this font software is licen[sc]ed under the sil open font license | under the sil open font license
ofl | the fonts and derivatives however cannot be released under any other type of license | cannot be released under any other type of license
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | developed by the openssl project
python | psf is making python available to licensee on an as is basis | psf is making python available
php | this product includes php software freely available from | includes php software freely available
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | without a written agreement is hereby granted
w3c | this work is being provided by the copyright holders under the following license by obtaining using and or copying this work | work is being provided by the copyright holders
icu | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files | copy of the unicode data files
ncsa | neither the names of .{1,120}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided | prior written permission the software is provided
ms-pl | this license governs use of the accompanying software if you use the software you accept this license | governs use of the accompanying software
osl-3 | licen[sc]ed under the open software license version 3 0 | under the open software license version 3
afl-3 | licen[sc]ed under the academic free license version 3 0 | under the academic free license version 3
bsl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use | make non production use
sspl | making the functionality of the program or modified version available to third parties as a service | available to third parties as a service
elastic | you may not provide the software to third parties as a hosted or managed service | third parties as a hosted or managed service
commons-clause | the license does not grant to you the right to sell the software | does not grant to you the right to sell
json | the software shall be used for good not evil | shall be used for good not evil
beerware | as long as you retain this notice you can do whatever you want with this stuff | whatever you want with this stuff
beerware | you can buy me a beer in return | buy me a beer in return
proprietary | this (?:document|software|program|file|material|source code) (?:is|contains) (?:the )?(?:confidential and )?proprietary(?: and confidential)? | proprietary
proprietary | unauthori[sz]ed copying (?:of this file )?via any medium is strictly prohibited | via any medium is strictly prohibited
proprietary | all rights reserved | all rights reserved
proprietary | for internal use only | for internal use only
proprietary | no part of this (?:publication|document|book|work) may be reproduced | may be reproduced
"""
# End of fixed values.

#: (priority, confidence, phrase) around a family's name.
PHRASES = [
    (1, 1.0, "spdx licen[sc]e identifier {}(?: only| or later)?"),
    (2, 0.95, "(?:re)?(?:licen[sc]ed|released|distributed|available|provided|published|dual licen[sc]ed) (?:in|under|into) (?:the |a )?(?:terms of (?:the )?)?{}(?: public)?(?: licen[sc]e)?"),
    (3, 0.9, "(?:subject to|governed by|covered by|under) (?:the )?(?:terms of (?:the )?)?{}(?: public)? licen[sc]e"),
    (4, 0.8, "{}(?: public)? licen[sc]e"),
    (5, 0.6, "licen[sc]e(?:d)?(?: is)? {}"),
]
#: Openings that the phrase of priority 2 can't do without.
OPENINGS = tuple(f"{verb} {to} " for verb in ("released", "distributed", "available", "provided", "published") for to in ("in", "under", "into"))
#: Phrases that are always looked for, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NO_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "array<struct<priority:int,confidence:double,label:string,keywords:array<string>,pattern:string>>"


def lines(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in block.strip().splitlines()]


def alternatives(name: str) -> list[str]:
    """Strings of which any match of a family's name has one: of each way to begin it, the longest part that can't be lacking.
    Names stand between spaces, so a way without optional parts is a word of its own."""
    group = re.match(r"\(\?:([^()]*)\)(?!\?)", name)
    out = []
    for way in group[1].split("|") if group else [name]:
        fixed = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\??|\\w\*|.\?", "\n", way)
        out.append(f" {way}{'' if group[0] != name else ' '}" if group and fixed == way else f" {way} " if fixed == way else max(fixed.split("\n"), key=len).strip())
    return out


@cache
def signature_rules() -> list[dict]:
    """Signatures, and every phrase around every family's name. A rule's keywords: any match has one of them."""
    signed = [{"priority": 0, "confidence": 1.0, "label": label, "keywords": [keyword], "pattern": f"(?<= ){pattern}(?= )"} for label, pattern, keyword in lines(SIGNATURES)]
    named = [{"priority": p, "confidence": c, "label": label, "keywords": alternatives(name), "pattern": f"(?<= ){phrase.format(name)}(?= )"} for label, name in lines(FAMILIES) for p, c, phrase in PHRASES]
    return signed + named


def triggers() -> tuple[str, ...]:
    """A document without any of these has no detection and no base phrase."""
    own = {k for r in signature_rules() if r["priority"] == 0 for k in r["keywords"] if "licen" not in k}
    return ("licen", "spdx", "cc by nc", *OPENINGS, *sorted(own))


TRIGGERS = triggers()
HIT = "array<struct<start:int,priority:int,shorter:int,stop:int,label:string,confidence:double>>"
#: Detections on each side, in order of place, among which one that contains another is looked for first.
BESIDE = 128


def spans(norm: Column, rule: Column) -> Column:
    """Detections of one rule: what lies between its matches tells where they are."""
    between = F.transform(F.split(norm, rule["pattern"]), F.length)
    found = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), F.length)

    def placed(b: Column, m: Column) -> Column:
        steps = F.zip_with(F.slice(b, F.lit(1), F.size(m)), m, lambda x, y: x + y)

        def one(starts: Column) -> Column:
            at = lambda i: F.get(starts, i) + F.get(b, i)
            return F.transform(m, lambda size, i: F.struct(at(i).alias("start"), rule["priority"].alias("priority"), (-size).alias("shorter"), (at(i) + size).alias("stop"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

        return let(running(steps), one)

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(HIT)).otherwise(let(between, lambda b: placed(b, m))))


def detections(norm: Column) -> Column:
    """What is left of all rules' detections in words with single spaces between and around, in order of place.

    Whatever contains a detection starts no further before it than the longest one is long. In order of place that is
    among its neighbours, unless there are more than BESIDE of those; then all are looked at.
    """
    rules = F.from_json(F.lit(json.dumps(signature_rules())), RULE)
    hits = F.array_sort(F.flatten(F.transform(F.filter(rules, lambda r: F.exists(r["keywords"], lambda k: norm.contains(k))), lambda r: spans(norm, r))))
    order = lambda x: F.struct(x["priority"], x["shorter"], x["start"], x["label"])
    over = lambda a, b: (a["start"] <= b["start"]) & (b["stop"] <= a["stop"]) & (order(a) < order(b))

    def left(h: Column, longest: Column) -> Column:
        def stays(b: Column, i: Column) -> Column:
            low = F.greatest(i - BESIDE, F.lit(0))
            near = F.slice(h, low + 1, F.lit(2 * BESIDE + 1))
            enough = ((low == 0) | (F.get(h, low)["start"] < b["start"] - longest)) & ((i + BESIDE >= F.size(h)) | (F.get(h, i + BESIDE)["start"] > b["start"]))
            return ~F.when(enough, F.exists(near, lambda a: over(a, b))).otherwise(F.exists(h, lambda a: over(a, b)))

        return F.filter(h, stays)

    return let(hits, lambda h: let(-F.coalesce(F.array_min(F.transform(h, lambda x: x["shorter"])), F.lit(0)), lambda longest: left(h, longest)))


def base_places(words: Column) -> Column:
    """(start, label) of each place of a base phrase."""

    def starts(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()
        def here(w: Column, i: Column) -> Column:
            hit = w == first
            for k, word in enumerate(rest, 1):
                hit = hit & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            return hit
        at = F.transform(words, lambda w, i: F.when(here(w, i), F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))
        return F.filter(at, lambda x: x.isNotNull())

    return F.concat(*(starts(p, label) for p, label in BASE.items()))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, base (start, label), detections (priority, start and stop in the normalized text, label, confidence).

    Only A-Z are lower-cased; words are runs of other characters than ASCII marks and controls. Null and empty texts
    have no words. Detections that tie in priority and length go by place, then label. Repeated rows are scanned
    each; columns other than doc_id and the text are not read.
    """
    words = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), NO_WORD), lambda w: w != "")
    first = docs.select("doc_id", let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("norm"))).alias("w"))
    rough = F.lower(F.col("w.norm"))  # also lowers letters outside A-Z: it only decides whether to look closer
    gate = let(rough, lambda x: reduce(lambda a, b: a | b, (x.contains(t) for t in TRIGGERS)) if TRIGGERS else F.lit(False))
    norm = F.when(gate, F.translate("w.norm", UPPER, LOWER))
    second = first.select("doc_id", F.col("w.n_words").alias("n_words"), norm.alias("norm"))
    close = let(F.col("norm"), lambda x: F.struct(let(F.split(F.trim(x), " "), base_places).alias("base"), detections(x).alias("detections")))
    found = second.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), close).alias("f"))
    return found.select("doc_id", "n_words", F.coalesce("f.base", F.array().cast("array<struct<start:bigint,label:string>>")).alias("base"), F.coalesce("f.detections", F.array().cast(HIT)).alias("detections"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest that op5's contract names. score: the surest label's confidence, 1 for a base phrase, 0 without labels."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts, base, own = F.col("base")["start"], F.col("base")["label"], F.col("detections")["label"]
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("detections")["confidence"]), F.lit(0.0))).alias("score"),
    )
