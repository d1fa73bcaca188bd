"""License recognition by sentence rules, in DataFrame functions only.

A text is normalised and cut at the ends of lines and clauses; runs of pieces that make up a known license sentence, however it is
wrapped, give the text a sequence of sentence ids. A rule is an ordered sequence of ids; it matches where its ids follow one another with no other
known sentence between them but those that may stand anywhere. Licenses are also named in a sentence or a tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences and their ids.
SENTENCES = {
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-head",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-head",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "all rights reserved": "reserved",
}
# Licenses by their short names, and the names they go by.
NAMES = {
    "0BSD": ("bsd zero clause license", "0bsd license"), "AFL-3.0": ("academic free license version 3 0", "academic free license v3 0"), "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "agpl v3"),
    "Apache-1.1": ("apache software license version 1 1",), "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"), "APSL-2.0": ("apple public source license version 2 0",), "Artistic-1.0": ("artistic license 1 0",), "Artistic-2.0": ("artistic license 2 0",),
    "BSD-1-Clause": ("bsd 1 clause license",), "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license"), "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "3 clause bsd license"), "BSD-4-Clause": ("bsd 4 clause license", "original bsd license"),
    "BSL-1.0": ("boost software license version 1 0",), "BUSL-1.1": ("business source license 1 1",), "CAL-1.0": ("cryptographic autonomy license version 1 0",),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0 unported license"), "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"), "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"), "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"), "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"), "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"), "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal"), "CDDL-1.0": ("common development and distribution license version 1 0",), "CDDL-1.1": ("common development and distribution license version 1 1",),
    "CECILL-2.1": ("cecill free software license agreement version 2 1", "cecill license version 2 1"), "CPL-1.0": ("common public license version 1 0",), "ECL-2.0": ("educational community license version 2 0",), "EFL-2.0": ("eiffel forum license version 2",),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0"), "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0"), "EUPL-1.1": ("european union public licence version 1 1",), "EUPL-1.2": ("european union public licence version 1 2", "eupl v1 2"),
    "GFDL-1.3": ("gnu free documentation license version 1 3",), "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gpl v2", "gplv2"), "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gpl v3", "gplv3"),
    "HPND": ("historical permission notice and disclaimer",), "IPL-1.0": ("ibm public license version 1 0",), "ISC": ("isc license",), "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl v2 1"), "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v3"),
    "LPPL-1.3c": ("latex project public license version 1 3c",), "MIT": ("mit license", "mit licence", "expat license"), "MIT-0": ("mit no attribution license", "mit 0 license"), "MPL-1.1": ("mozilla public license version 1 1",), "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0"),
    "MS-PL": ("microsoft public license",), "MS-RL": ("microsoft reciprocal license",), "MulanPSL-2.0": ("mulan psl v2", "mulan permissive software license version 2"), "NCSA": ("university of illinois ncsa open source license",), "NPL-1.1": ("netscape public license version 1 1",), "ODbL-1.0": ("open database license v1 0", "open data commons open database license"),
    "OFL-1.1": ("sil open font license version 1 1",), "OLDAP-2.8": ("openldap public license version 2 8",), "OSL-3.0": ("open software license version 3 0", "open software license v3 0"), "PHP-3.01": ("php license version 3 01",), "PostgreSQL": ("postgresql license",), "PSF-2.0": ("python software foundation license version 2",),
    "QPL-1.0": ("q public license version 1 0",), "SSPL-1.0": ("server side public license version 1",), "Sleepycat": ("sleepycat license",), "UPL-1.0": ("universal permissive license version 1 0",), "Unlicense": ("unlicense",), "Vim": ("vim license",), "W3C": ("w3c software notice and license",),
    "WTFPL": ("do what the fuck you want to public license",), "X11": ("x11 license",), "ZPL-2.1": ("zope public license version 2 1",), "Zlib": ("zlib license",),
}
#: How a text says which license holds, before the name.
SAYS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under", "this file is licensed under", "this software is licensed under", "this code is released under")
TAG = "spdx license identifier"


def _words(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def _references() -> dict[str, str]:
    """The sentences that name a license, and their ids: what is said, with or without an article, and the name; or a tag."""
    out = {}
    for key, names in NAMES.items():
        out |= {f"{says} {the}{name}": f"{key.lower()}-ref" for says in SAYS for the in ("", "the ") for name in names}
        out[f"{TAG} {_words(key)}"] = f"{key.lower()}-ref"
    return out


REFERENCES = _references()
# License and the ids of its sentences in order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-grant")),
    ("Apache-2.0", ("apache-head", "apache-comply")),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-grant", "gpl-warranty")),
    ("LGPL-2.1", ("lgpl21-grant", "lgpl-warranty")),
    ("LGPL-3.0", ("lgpl3-grant", "lgpl-warranty")),
    ("AGPL-3.0", ("agpl3-grant", "gpl-warranty")),
    ("Unlicense", ("unlicense-head", "unlicense-grant")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("EPL-2.0", ("epl2-head",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("MPL-2.0", ("mpl2-head",)),
    ("ISC", ("isc-grant",)),
    ("All-Rights-Reserved", ("reserved",)),
    *((key, (f"{key.lower()}-ref",)) for key in NAMES),
)
#: Sentences that may stand inside any notice.
ANYWHERE = ("reserved",)
#: The longer rule stands in for the shorter one where it begins with the same sentences, and only there.
LONGER = {"BSD-2-Clause": "bsd-names"}
#: Stands for the end of a clause while texts are normalised.
_CUT = "\x01"


def _ids(text: Column) -> Column:
    r"""The ids of a text's known sentences in order.

    A text becomes its lower-case words with a space between them, a line break where a line or a clause ends, and more
    than one where a blank line stood, comment marks or not. A known sentence fills whole pieces between breaks, as many as
    it takes, but no blank line; of those that begin at one place the longest counts.
    """
    known = F.create_map(*(F.lit(x) for kv in (REFERENCES | SENTENCES).items() for x in kv))
    plain = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), _CUT, " ")), "\r\n?", "\n")
    for pattern, by in ((r"[.!?;:](?=\s|\z)", _CUT), (f"[^a-z0-9\n{_CUT}]+", " "), (f"[ {_CUT}]{{2,}}", _CUT), (f"[ {_CUT}]?\n[ {_CUT}]?", "\n")):
        plain = F.regexp_replace(plain, pattern, by)
    either = lambda of: "(?:" + "|".join(sorted(of, key=len, reverse=True)) + ")"
    names = {name for names in NAMES.values() for name in names}
    any_of = "|".join([*sorted(SENTENCES, key=len, reverse=True), f"{either(SAYS)} (?:the )?{either(names)}", f"{TAG} {either(map(_words, NAMES))}"]).replace(" ", r"[ \n]")
    found = F.regexp_extract_all(F.btrim(F.translate(plain, _CUT, "\n"), F.lit(" \n")), F.lit(f"(?<![^\n])(?:{any_of})(?![^\n])"), 0)
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def _pattern(name: str, rule: tuple[str, ...]) -> str:
    """A rule over ids in angle brackets."""
    between = "(?:" + "|".join(f"<{x}>" for x in ANYWHERE) + ")*"
    return between.join(f"<{i}>" for i in rule).replace(".", "[.]")


def _hits(name: str, rule: tuple[str, ...]) -> tuple[str, str]:
    """Patterns of which the first has to be found more often than the second, which begins at some of the same places."""
    longer = LONGER.get(name)
    return _pattern(name, rule), _pattern(name, (*rule, longer)) if longer and len(rule) > 1 else ""


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, licenses, n_sentences, sentences``.

    ``licenses`` are the matched licenses by name, joined by commas; ``sentences`` the ids in order, each in angle
    brackets, ``n_sentences`` their number. Null and empty texts have none: two empty strings and 0. Rows with the same id
    are read one by one; extra columns are ignored; an empty table gives an empty one. One projection, no shuffle.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _ids(F.col("text")).alias("ids"))
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("sentences"))
    by_name: dict[str, Column] = {}
    for name, rule in RULES:
        every, longer = _hits(name, rule)
        hit = F.regexp_count("sentences", F.lit(every)) > F.regexp_count("sentences", F.lit(longer)) if longer else F.col("sentences").contains(f"<{rule[0]}>") if len(rule) == 1 else F.col("sentences").rlike(every)
        by_name[name] = by_name[name] | hit if name in by_name else hit
    matched = F.concat_ws(",", *(F.when(by_name[k], F.lit(k)) for k in sorted(by_name)))
    return told.select("doc_id", F.when(F.col("n_sentences") > 0, matched).otherwise("").alias("licenses"), "n_sentences", "sentences")


def oracle() -> str:
    """The same in DuckDB for texts whose known sentences stand in one piece; sentences over several pieces aren't in it."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in (REFERENCES | SENTENCES).items())
    by_name: dict[str, str] = {}
    for name, rule in RULES:
        every, longer = _hits(name, rule)
        hit = f"len(regexp_extract_all(sentences, '{every}')) > len(regexp_extract_all(sentences, '{longer}'))" if longer else f"regexp_matches(sentences, '{every}')"
        by_name[name] = f"({by_name[name]} OR {hit})" if name in by_name else hit
    matched = ", ".join(f"CASE WHEN {by_name[k]} THEN '{k}' END" for k in sorted(by_name))
    return f"""
        WITH known(sentence, id) AS (VALUES {known}),
        cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;:]+(\\s|$)', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS parts FROM documents),
        long AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM cut),
        found AS (SELECT doc_id, k, id FROM long JOIN known ON trim(part) = sentence),
        told AS (SELECT doc_id, count(*) AS n_sentences, string_agg('<' || id || '>', '' ORDER BY k) AS sentences FROM found GROUP BY doc_id),
        every AS (SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentences, '') AS sentences FROM documents d LEFT JOIN told USING (doc_id))
        SELECT doc_id, concat_ws(',', {matched}) AS licenses, n_sentences, sentences FROM every"""
