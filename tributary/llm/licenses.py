"""License scan by sentence rules, with native expressions only.

A text's sentences are normalised (case, comment signs, quotes, spaces; version numbers become ``#``) and mapped to the
identifiers of known licence sentences. The identifiers, in the order of the text, are matched against ordered rules:
a rule that matches uses its identifiers up, so later, weaker rules see only the rest. A sentence that names a licence
but isn't known is reported as ``UNKNOWN``.

Sentences are cut twice: line by line, and with lines folded into paragraphs, since licence texts are wrapped. Only
documents with one of ``ANCHORS`` are cut at all; every known sentence has one (checked when the module is loaded).
Nothing is shuffled but the caller's own work.

Defined results: null and empty texts have no sentences and no licences; repeated rows each get a row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import let, pick

# Sentences of public licences and licence notices, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "this project is licensed under the mit license": "MITname",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITasis",
    "licensed under the apache license, version #": "APACHEname",
    "licensed under the apache license, version # (the license)": "APACHElic",
    "you may not use this file except in compliance with the license": "APACHEuse",
    "you may obtain a copy of the license at": "APACHEcopy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "APACHEasis",
    "this work is licensed under the gnu general public license, version #": "GPLname",
    "licensed under the gnu general public license, version #": "GPLname",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version # of the license, or (at your option) any later version": "GPLlater",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; version # of the license": "GPLonly",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu general public license for more details": "GPLsee",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version # of the license, or (at your option) any later version": "LGPLlater",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "this source code form is subject to the terms of the mozilla public license, v #": "MPLname",
    "this work is licensed under a creative commons attribution # international license": "CCBYname",
    "licensed under cc by #": "CCBYname",
    "licensed under cc by-sa #": "CCBYSAname",
    "licensed under cc by-nc #": "CCBYNCname",
    "licensed under cc by-nd #": "CCBYNDname",
    "licensed under cc by-nc-sa #": "CCBYNCSAname",
    "licensed under cc by-nc-nd #": "CCBYNCNDname",
    "all rights reserved under copyright": "RIGHTS",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MITliable",
    "licensed under the apache license, version # (the license); you may not use this file except in compliance with the license": "APACHElic",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version # of the license, or (at your option) any later version": "GPLlater",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version # of the license, or (at your option) any later version": "AGPLlater",
    "licensed under the gnu affero general public license, version #": "AGPLname",
    "licensed under the gnu lesser general public license, version #": "LGPLname",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version # of the license, or (at your option) any later version": "LGPLlater",
    "this program and the accompanying materials are made available under the terms of the eclipse public license #": "EPLname",
    "licensed under the eclipse public license, version #": "EPLname",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZLIBgrant",
    "this is free and unencumbered software released into the public domain, distributed without any warranty": "UNLICENSE",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, without warranty": "UNLICENSE",
    "distributed under the boost software license, version #": "BSLname",
    "licensed under cc# #": "CCZEROname",
    "spdx-license-identifier: mit": "MITspdx",
    "spdx-license-identifier: isc": "ISCspdx",
    "spdx-license-identifier: unlicense": "UNLICENSEspdx",
    "spdx-license-identifier: zlib": "ZLIBspdx",
    "spdx-license-identifier: apache-#": "APACHEspdx",
    "spdx-license-identifier: bsd-#-clause": "BSDspdx",
    "spdx-license-identifier: gpl-#-only": "GPLonlyspdx",
    "spdx-license-identifier: gpl-#-or-later": "GPLlaterspdx",
    "spdx-license-identifier: lgpl-#-only": "LGPLonlyspdx",
    "spdx-license-identifier: lgpl-#-or-later": "LGPLlaterspdx",
    "spdx-license-identifier: agpl-#-only": "AGPLonlyspdx",
    "spdx-license-identifier: agpl-#-or-later": "AGPLlaterspdx",
    "spdx-license-identifier: mpl-#": "MPLspdx",
    "spdx-license-identifier: epl-#": "EPLspdx",
    "spdx-license-identifier: bsl-#": "BSLspdx",
    "spdx-license-identifier: cc-by-#": "CCBYspdx",
    "spdx-license-identifier: cc-by-sa-#": "CCBYSAspdx",
}
#: Whoever holds the rights, the endorsement clause is one sentence.
HOLDER, ANY_HOLDER = "^neither the names? of .+ nor the names of (?:its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors"
#: Ordered: identifiers that follow each other, and the licence they prove. Sentences that name some licence but aren't known
#: may stand between them, and are used up with them.
#: ``{v}`` is the version that the sentences name.
RULES = [
    ("MITgrant MITnotice MITasis MITliable", "MIT"),
    ("MITgrant MITnotice MITasis", "MIT"),
    ("BSDpre BSDsource BSDbinary BSDendorse", "BSD-3-Clause"),
    ("BSDpre BSDsource BSDbinary", "BSD-2-Clause"),
    ("APACHElic APACHEuse APACHEcopy APACHEasis", "Apache-{v}"),
    ("GPLlater GPLwarranty GPLsee", "GPL-{v}-or-later"),
    ("GPLonly GPLwarranty GPLsee", "GPL-{v}-only"),
    ("GPLlater", "GPL-{v}-or-later"),
    ("GPLonly", "GPL-{v}-only"),
    ("LGPLlater", "LGPL-{v}-or-later"),
    ("AGPLlater GPLwarranty", "AGPL-{v}-or-later"),
    ("AGPLlater", "AGPL-{v}-or-later"),
    ("AGPLname", "AGPL-{v}"),
    ("LGPLname", "LGPL-{v}"),
    ("EPLname", "EPL-{v}"),
    ("ZLIBgrant", "Zlib"),
    ("UNLICENSE", "Unlicense"),
    ("BSLname", "BSL-{v}"),
    ("CCZEROname", "CC0-1.0"),
    ("MITspdx", "MIT"),
    ("ISCspdx", "ISC"),
    ("UNLICENSEspdx", "Unlicense"),
    ("ZLIBspdx", "Zlib"),
    ("APACHEspdx", "Apache-{v}"),
    ("BSDspdx", "BSD-{v}-Clause"),
    ("GPLonlyspdx", "GPL-{v}-only"),
    ("GPLlaterspdx", "GPL-{v}-or-later"),
    ("LGPLonlyspdx", "LGPL-{v}-only"),
    ("LGPLlaterspdx", "LGPL-{v}-or-later"),
    ("AGPLonlyspdx", "AGPL-{v}-only"),
    ("AGPLlaterspdx", "AGPL-{v}-or-later"),
    ("MPLspdx", "MPL-{v}"),
    ("EPLspdx", "EPL-{v}"),
    ("BSLspdx", "BSL-{v}"),
    ("CCBYspdx", "CC-BY-{v}"),
    ("CCBYSAspdx", "CC-BY-SA-{v}"),
    ("APACHElic", "Apache-{v}"),
    ("APACHEname", "Apache-{v}"),
    ("GPLname", "GPL-{v}"),
    ("MITgrant", "MIT"),
    ("MITname", "MIT"),
    ("ISCgrant", "ISC"),
    ("MPLname", "MPL-{v}"),
    ("CCBYname", "CC-BY-{v}"),
    ("CCBYSAname", "CC-BY-SA-{v}"),
    ("CCBYNCname", "CC-BY-NC-{v}"),
    ("CCBYNDname", "CC-BY-ND-{v}"),
    ("CCBYNCSAname", "CC-BY-NC-SA-{v}"),
    ("CCBYNCNDname", "CC-BY-NC-ND-{v}"),
]
ANCHORS = "licen[sc]e|copyright|warrant|permission|redistribut|endorse|as is|free software|public domain"
#: A sentence that isn't known is reported if it has one of these.
NAMES = "licensed under|released under|public license|spdx-license-identifier"

assert all(re.search(ANCHORS, s) for s in SENTENCES)
assert all(" " in r for k, (r, _) in enumerate(RULES) for later, _ in RULES[k + 1 :] if " " in later and set(r.split()) & set(later.split()))

#: The first words of all known sentences.
_OPENINGS = "|".join(sorted({re.escape(" ".join(s.split()[:3])).replace("\\ ", " ").replace("\\#", "#") for s in SENTENCES}))
VERSION = r"\d+(?:\.\d+)*"


def _fold(text: Column) -> Column:
    """Lower case, without quotes and comment signs, one space between words."""
    plain = F.lower(F.regexp_replace(text, r"[\"'`“”‘’]", ""))
    bare = F.regexp_replace(plain, r"(?m)^[ \t]*(?://+|#+|/?\*+/?|;+|--+)", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"[ \t\x0b\f\r]+", " "), r"\bv\. (?=\d)", "v ")
    return F.regexp_replace(spaced, r"\b(inc|corp|ltd)\. (nor|and|or)\b", "$1 $2")  # no sentence ends there


def _sentences(lines: Column) -> Column:
    """Cut at line ends and after sentence ends; trimmed, without the closing sign, none empty."""
    cut = F.split(F.regexp_replace(lines, r"([.!?])(?= |\n|$)", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(F.trim(s), r"[ .:;!?*/]+$", "")), lambda s: s != "")


def _identified(sentences: Column) -> Column:
    """Identifiers ``|name:version|`` of the sentences that are known or name a licence."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def one(s: Column) -> Column:
        found = F.element_at(known, F.regexp_replace(F.regexp_replace(s, HOLDER, ANY_HOLDER), VERSION, "#"))
        name = F.coalesce(found, F.when(s.rlike(NAMES), F.lit("UNKNOWN")))
        return F.concat(F.lit("|"), name, F.lit(":"), F.regexp_extract(s, VERSION, 0), F.lit("|"))

    return F.filter(F.transform(F.filter(sentences, lambda s: s.rlike(ANCHORS)), one), lambda s: s.isNotNull())


def _pattern(rule: str) -> str:
    """The rule over ``|id:version|`` items; its first version is group 1."""
    first, *rest = rule.split(" ")
    return rf"\|{first}:([0-9.]*)\|" + "".join(rf"(?:\|UNKNOWN:[0-9.]*\|)*\|{r}:[0-9.]*\|" for r in rest)


def _matched(ids: Column) -> Column:
    """(licences, unknown) of an identifier string: rules in order, each using its matches up."""
    def use_up(pattern: str, licence: str) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            versions = F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(1))
            names = F.transform(versions, lambda v: F.regexp_replace(F.replace(F.lit(licence), F.lit("{v}"), v), "-(-|$)", "$1"))
            return F.struct(F.regexp_replace(s["rest"], pattern, "").alias("rest"), F.concat(s["found"], names).alias("found"))

        return step

    state = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("found"))
    for rule, licence in RULES:
        if " " in rule:
            state = let(state, use_up(_pattern(rule), licence))
    # rules of one identifier come after those of several that share it, and share none among themselves: one step for all
    alone = F.create_map(*[F.lit(x) for rule, licence in RULES if " " not in rule for x in (rule, licence)])

    def last(s: Column) -> Column:
        items = lambda k: F.regexp_extract_all(s["rest"], F.lit(r"\|(\w+):([0-9.]*)\|"), F.lit(k))
        named = F.zip_with(items(1), items(2), lambda i, v: F.regexp_replace(F.replace(F.element_at(alone, i), F.lit("{v}"), v), "-(-|$)", "$1"))
        return F.struct(s["rest"].alias("rest"), F.concat(s["found"], F.filter(named, lambda x: x.isNotNull())).alias("found"))

    return let(state, last)


def license_findings(docs: DataFrame) -> DataFrame:
    """doc_id, identifiers (of the text's licence sentences), licenses (sorted, joined by commas), unknown (sentences
    that name a licence but aren't known) of every row."""
    base = pick(docs, doc_id="long", text="string")
    text = F.lower(F.col("text"))
    lines = _fold(F.col("text"))
    # a paragraph ends at a blank line and before a line that opens like a known sentence; other line ends are folded
    ended = F.regexp_replace(lines, rf"\n *(?:\n|(?={_OPENINGS}))", "\u0001")
    paragraphs = F.replace(F.regexp_replace(ended, r"[ \n]+", " "), F.lit("\u0001"), F.lit("\n"))
    both = F.struct(_identified(_sentences(lines)).alias("lines"), _identified(_sentences(paragraphs)).alias("paragraphs"))
    scanned = F.when(
        text.rlike(ANCHORS),
        let(
            both,
            lambda b: F.struct(
                b["lines"].alias("ids"),
                _matched(F.array_join(b["lines"], "")).alias("l"),
                _matched(F.array_join(b["paragraphs"], "")).alias("p"),
            ),
        ),
    )
    none = F.array().cast("array<string>")
    found = base.select("doc_id", scanned.alias("s"))
    licences = F.array_sort(F.array_distinct(F.concat(F.coalesce("s.l.found", none), F.coalesce("s.p.found", none))))
    unknown = F.least(F.regexp_count("s.l.rest", F.lit(r"\|UNKNOWN:")), F.regexp_count("s.p.rest", F.lit(r"\|UNKNOWN:")))
    return found.select(
        "doc_id",
        F.array_join(F.coalesce("s.ids", none), "").alias("identifiers"),
        F.array_join(licences, ",").alias("licenses"),
        F.coalesce(unknown, F.lit(0)).cast("long").alias("unknown"),
    )
