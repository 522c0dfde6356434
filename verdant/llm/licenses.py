"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each normalised to lower-case words; a line break
alone does not end one, as licence texts are wrapped.  Known licence sentences become
identifiers, and so do the names of a notice (SPDX tags, "licensed under either of X or
Y", "X licensed"; SPDX exceptions with WITH are not read); identifiers that are close
together form a sequence.  Ordered licence rules, the longest and most specific first, then
replace runs of identifiers by the licence they stand for.  No row leaves its
task: there is no shuffle, and hot sources or long texts need no care.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "this project is licensed under the mit license": "MITname",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITgrantnotice",
    "the software is provided as is without warranty of any kind express or implied": "AsIs",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "licensed under the apache license version 2 0": "Apache2name",
    "licensed under the apache license version 2 0 the license": "Apache2name",
    "you may not use this file except in compliance with the license": "Apache2comply",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "Apache2header",
    "you may obtain a copy of the license at": "Apache2copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "Apache2copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2warranty",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2copywarranty",
    "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2copywarranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2limits",
    "this work is licensed under the gnu general public license version 3": "GPL3name",
    "this work is licensed under the gnu general public license version 2": "GPL2name",
    "licensed under the gnu general public license version 3": "GPL3name",
    "licensed under the gnu general public license version 2": "GPL2name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu general public license for more details": "GPLdetails",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu lesser general public license for more details": "LGPLdetails",
    "see the gnu affero general public license for more details": "AGPLdetails",
    "licensed under the gnu lesser general public license version 3": "LGPL3name",
    "licensed under the gnu lesser general public license version 2 1": "LGPL21name",
    "licensed under the gnu affero general public license version 3": "AGPL3name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDpre",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1": "BSDpre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDpresource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2name",
    "licensed under the mozilla public license version 2 0": "MPL2name",
    "licensed under cc by 4 0": "CCBY4name",
    "licensed under cc by sa 4 0": "CCBYSA4name",
    "licensed under cc by nc 4 0": "CCBYNC4name",
    "licensed under cc by nd 4 0": "CCBYND4name",
    "licensed under cc by nc sa 4 0": "CCBYNCSA4name",
    "licensed under cc by nc nd 4 0": "CCBYNCND4name",
    "released under cc0 1 0": "CC0name",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "EPL2name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2name",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL1grant",
    "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt": "BSL1copy",
    "see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt": "BSL1copy",
    "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt": "BSL1name",
    "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt": "BSL1name",
}
#: Names that follow "licensed under" and the like.
NAMES = {
    "MITname": ("the mit license", "the mit licence", "mit", "mit license", "the mit license mit"),
    "Apache2name": ("the apache license version 2 0", "the apache license 2 0", "apache license version 2 0", "apache license 2 0", "apache 2 0", "the apache 2 0 license", "the apache license v2 0", "apache license v2 0", "apache 2 0 license"),
    "BSD3name": ("the bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause", "bsd 3 clause license"),
    "BSD2name": ("the bsd 2 clause license", "the 2 clause bsd license", "bsd 2 clause", "bsd 2 clause license"),
    "MPL2name": ("the mozilla public license version 2 0", "the mozilla public license 2 0", "the mozilla public license v 2 0", "mpl 2 0", "the mpl 2 0"),
    "ISCname": ("isc", "isc license", "the isc license"),
    "0BSDname": ("0bsd", "the zero clause bsd license"),
    "EPL2name": ("epl 2 0", "the epl 2 0", "eclipse public license 2 0", "the eclipse public license 2 0", "the eclipse public license version 2 0", "the eclipse public license v 2 0", "the eclipse public license v2 0"),
    "BSL1name": ("bsl 1 0", "the boost software license version 1 0", "the boost software license 1 0", "boost software license 1 0", "boost software license version 1 0"),
    "Unlicense": ("unlicense", "the unlicense"),
    **{f"{i}{end}": tuple(f"{a}{v}{later}" for later in tails for a in (f"the gnu {n} public license version ", f"the gnu {n} public license v", f"the gnu {n} public license v ", *(f"{x}{g}{y}" for x in ("", "the ", "the gnu ", "gnu ") for y in (" ", "v", " v", " v ", " version "))))
          + tuple(f"{g} {v if ' ' in v else f'{v} 0'}{word}" for word in (("", " only") if end == "name" else (" or later",)))
       for i, n, g, v in (("GPL3", "general", "gpl", "3"), ("GPL2", "general", "gpl", "2"), ("LGPL3", "lesser general", "lgpl", "3"), ("LGPL21", "lesser general", "lgpl", "2 1"), ("AGPL3", "affero general", "agpl", "3"))
       for end, tails in (("name", ("",)), ("plus", (" or later", " or any later version")))},
    **{f"CC{k.upper().replace(' ', '')}4name": (f"cc {k} 4 0", f"a creative commons {long} 4 0 international license", f"the creative commons {long} 4 0 international license")
       for k, long in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))},
    "CC0name": ("cc0 1 0", "cc0", "the cc0 1 0 universal license"),
}
#: Titles of licence texts.
TITLES = {
    "mit license": "MITname", "the mit license": "MITname", "the mit license mit": "MITname", "apache license version 2 0": "Apache2name", "apache license version 2 0 january 2004": "Apache2name",
    "bsd 3 clause license": "BSD3name", "the 3 clause bsd license": "BSD3name", "bsd 2 clause license": "BSD2name", "the 2 clause bsd license": "BSD2name",
    "gnu general public license version 3 29 june 2007": "GPL3name", "gnu general public license version 2 june 1991": "GPL2name", "gnu lesser general public license version 3 29 june 2007": "LGPL3name",
    "gnu lesser general public license version 2 1 february 1999": "LGPL21name", "gnu affero general public license version 3 19 november 2007": "AGPL3name",
    "mozilla public license version 2 0": "MPL2name", "cc0 1 0 universal": "CC0name", "creative commons legal code cc0 1 0 universal": "CC0name",
    "isc license": "ISCname", "the isc license": "ISCname", "eclipse public license v 2 0": "EPL2name", "boost software license version 1 0": "BSL1name", "boost software license version 1 0 august 17th 2003": "BSL1name",
    "bsd zero clause license": "0BSDname",
}
SENTENCES |= TITLES | {f"licensed under {name}": i for i, names in NAMES.items() for name in names}
_THIS = "(?:(?:this|the) (?:work|project|software|code|program|library|package|file|repository) is )?"
#: Beginnings of a sentence or line that read as "licensed under"; what may follow the names.
NAMING = f"(?:{_THIS}(?:dual |made )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:both |either |either of )?|spdx license identifier |licen[cs]es? )"
AFTER = "(?: at your option)?(?: see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file| md| txt)?(?: for (?:more )?(?:details|information))?)?"
#: Every known sentence and every notice has one of these in it, or "under" with one of SHARING.
CLUES, SHARING = ("licen", "copyright", "warrant", "rights", "redistribut", "unencumbered", "cc0", "permission"), ("released", "distributed", "available")
#: Licence rules in order; a rule may use licences that earlier rules have found.
RULES = (
    (("AllRights", "BSDpre", "BSDsource", "BSDbinary", "BSDname"), "BSD-3-Clause"),
    (("AllRights", "BSDpre", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("BSDpre", "BSDsource", "BSDbinary", "BSDname"), "BSD-3-Clause"),
    (("BSDpre", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("BSDpresource", "BSDbinary", "BSDname"), "BSD-3-Clause"),
    (("BSDpresource", "BSDbinary"), "BSD-2-Clause"),
    (("MITgrant", "MITnotice", "AsIs"), "MIT"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("MITgrantnotice", "AsIs"), "MIT"),
    (("MITgrantnotice",), "MIT"),
    (("Apache2header", "Apache2copy", "Apache2warranty", "Apache2limits"), "Apache-2.0"),
    (("Apache2header", "Apache2copywarranty", "Apache2limits"), "Apache-2.0"),
    (("Apache2header",), "Apache-2.0"),
    (("Apache2name", "Apache2comply", "Apache2copy", "Apache2warranty", "Apache2limits"), "Apache-2.0"),
    (("Apache2name", "Apache2comply"), "Apache-2.0"),
    (("GPL3plus", "GPLwarranty", "GPLdetails"), "GPL-3.0-or-later"),
    (("GPL2plus", "GPLwarranty", "GPLdetails"), "GPL-2.0-or-later"),
    (("LGPL3plus", "GPLwarranty", "LGPLdetails"), "LGPL-3.0-or-later"),
    (("LGPL21plus", "GPLwarranty", "LGPLdetails"), "LGPL-2.1-or-later"),
    (("AGPL3plus", "GPLwarranty", "AGPLdetails"), "AGPL-3.0-or-later"),
    (("LGPL3plus",), "LGPL-3.0-or-later"),
    (("LGPL21plus",), "LGPL-2.1-or-later"),
    (("AGPL3plus",), "AGPL-3.0-or-later"),
    (("GPL3plus",), "GPL-3.0-or-later"),
    (("GPL2plus",), "GPL-2.0-or-later"),
    (("MITname",), "MIT"),
    (("Apache2name",), "Apache-2.0"),
    (("GPL3name",), "GPL-3.0-only"),
    (("GPL2name",), "GPL-2.0-only"),
    (("LGPL3name",), "LGPL-3.0-only"),
    (("LGPL21name",), "LGPL-2.1-only"),
    (("AGPL3name",), "AGPL-3.0-only"),
    (("MPL2name",), "MPL-2.0"),
    (("BSD3name",), "BSD-3-Clause"),
    (("BSD2name",), "BSD-2-Clause"),
    (("CCBY4name",), "CC-BY-4.0"),
    (("CCBYSA4name",), "CC-BY-SA-4.0"),
    (("CCBYNC4name",), "CC-BY-NC-4.0"),
    (("CCBYND4name",), "CC-BY-ND-4.0"),
    (("CCBYNCSA4name",), "CC-BY-NC-SA-4.0"),
    (("CCBYNCND4name",), "CC-BY-NC-ND-4.0"),
    (("CC0name",), "CC0-1.0"),
    (("Unlicense",), "Unlicense"),
    (("ISCgrant", "ISCwarranty"), "ISC"),
    (("ISCgrant",), "ISC"),
    (("0BSDgrant", "ISCwarranty"), "0BSD"),
    (("0BSDgrant",), "0BSD"),
    (("BSL1name", "BSL1copy"), "BSL-1.0"),
    (("BSL1grant",), "BSL-1.0"),
    (("ISCname",), "ISC"),
    (("0BSDname",), "0BSD"),
    (("EPL2name",), "EPL-2.0"),
    (("BSL1name",), "BSL-1.0"),
    (("AllRights",), "LicenseRef-AllRightsReserved"),
)
#: Identifiers with more than so many sentences between them are not in one sequence.
GAP = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", "abcdefghijklmnopqrstuvwxyz\x02"
#: Leading stars of a text that holds a /* comment, which are no list marks there.
STARS = r"\n[ \t]*/?\*+/?"
#: Replacements in order, on a text between line feeds: line ends; m4 and batch comment marks; list marks,
#: after other comment marks, become a blank line; "v. 2"; "2+"; colons before a break; other sentence ends; lines without a word.
LAYOUT = (
    (r"\x0D\n|[\x0B-\x0D]", "\n"),
    (r"\n[ \t]*(dnl|[Rr][Ee][Mm][ \t])", "\n"),
    (r"""\n[ \t#/;%>|!"'~=<]*(--+[ \t]+)?([-+*\x{2022}]|\(?[0-9]{1,3}[.)]|\(?[a-z]\))[ \t]+""", "\n\n"),
    (r"([^A-Za-z0-9])[Vv]\.[ \t\n#/*;]+([0-9])", r"\1v \2"),
    (r"([0-9])\+", r"\1 or later"),
    (r":[ \t]*\n", "\x01\n"),
    (r"[.!?]+[ \t\n]", "\x01\n"),
    (r"\n[^A-Za-z0-9\n\x01]*\n", "\x01"),
)


def _one_of(sentences: list[list[str]]) -> str:
    """Pattern of any of the word lists, the longest first, with a blank or a line end between words."""
    rest: dict[str, list[list[str]]] = {}
    for s in sentences:
        if s:
            rest.setdefault(s[0], []).append(s[1:])
    branches = "|".join(w + _one_of(r) for w, r in rest.items())
    inner = f"(?:{branches})" if len(rest) > 1 else branches
    if not rest:
        return ""
    return f"(?:{_BREAK}{inner})?" if [] in sentences else _BREAK + inner


_BREAK = r"(?: |\x02\x02)"
#: What keeps "or later" with its name; what lies between names.
TOGETHER, OTHER = (r" or (later|any later)", "\x04or\x04$1"), " (?:or|and) "


def _normalise() -> tuple[tuple[str, str], ...]:
    """Replacements on lower-case text with \x01 as sentence end and \x02 as line end: other characters;
    separators twice; notices as \x03 and their names; whole lines that make a known sentence become one; separators once; line ends as blanks."""
    known = _one_of([s.split() for s in SENTENCES]).removeprefix(_BREAK)
    name = _one_of([n.split() for group in NAMES.values() for n in group]).removeprefix(_BREAK)
    this, before, after = (x.replace(" ", _BREAK) for x in (_THIS, NAMING, AFTER))
    names = f"({name}(?:{_BREAK}(?:or|and){_BREAK}{name})*)"
    return (
        (r"[^a-z0-9\x01\x02]+", " "), (r"[ \x01\x02]*\x01[ \x01\x02]*", "\x01\x01"), (r" *\x02[ \x02]*", "\x02\x02"),
        (rf"[\x01\x02]{before}{names}{after}[\x01\x02]", "\x01\x03\\1\x01"), (rf"[\x01\x02]{this}{names}{_BREAK}licensed[\x01\x02]", "\x01\x03\\1\x01"),
        (rf"[\x01\x02]({known})[\x01\x02]", "\x01\\1\x01"), (r"[ \x02]*\x01[ \x01\x02]*", "\x01"), (r"\x02+", " "),
    )


def sentences(text: Column) -> Column:
    """Normalised sentences: ended by . ! or ? before white space or the end, by a
    blank line, a list item or a colon before a line end; another line end, with
    the comment marks or indent after it, is a blank, unless the lines before or
    after it are a known sentence.  Lower-cased (A-Z), other characters than a-z
    and 0-9 as blanks, without empty ones in between.  A notice that names licences
    is a sentence "licensed under" for each of them."""
    t = F.concat(F.lit("\n"), F.translate(text, "\x01\x02", "  "), F.lit("\n"))
    t = F.when(F.contains(t, F.lit("/*")), F.regexp_replace(t, STARS, "\n")).otherwise(t)
    for pattern, by in LAYOUT:
        t = F.regexp_replace(t, pattern, by.replace("\\", "$"))
    t = F.concat(F.lit("\x01"), F.translate(t, _UPPER, _LOWER), F.lit("\x01"))
    for pattern, by in _normalise():
        t = F.regexp_replace(t, pattern, by.replace("\\", "$"))
    every = F.split(F.btrim(t, F.lit(" \x01")), "\x01")
    return F.flatten(F.transform(every, lambda x: F.when(F.startswith(x, F.lit("\x03")), F.transform(
        F.split(F.regexp_replace(F.substr(x, F.lit(2)), *TOGETHER), OTHER), lambda n: F.concat(F.lit("licensed under "), F.translate(n, "\x04", " "))
    )).otherwise(F.array(x))))


def may_be_licensed(text: Column) -> Column:
    """Whether a text has a clue, without which no sentence of it can be a known one:
    a known sentence holds its words as they are, but for the case of A-Z."""
    t = F.lower(text)
    sharing = F.contains(t, F.lit("under")) & reduce(or_, [F.contains(t, F.lit(c)) for c in SHARING])
    return F.coalesce(reduce(or_, [F.contains(t, F.lit(c)) for c in CLUES]) | sharing, F.lit(False))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_sentences`` (known licence sentences), ``sequence`` (their
    identifiers as [A][B], ~ where there is a gap), ``licenses`` (names found,
    sorted, once each) and ``unmatched`` (identifiers that no rule took).

    A null or empty text has none of these, nor has one without a clue (such a text
    is not cut into sentences).  Repeated rows are scanned each by
    itself; columns other than the id and the text are not read.
    """
    ids = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(may_be_licensed(t), sentences(t)).otherwise(F.array().cast("array<string>")).alias("s"))
    rows = rows.select("doc_id", F.filter(F.transform("s", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].isin(list(SENTENCES))).alias("known"))
    named = F.transform("known", lambda x, k: F.concat(
        F.when((k > 0) & (x["i"] - F.get("known", k - 1)["i"] > GAP + 1), F.lit("~")).otherwise(F.lit("")), F.lit("["), F.element_at(ids, x["s"]), F.lit("]")))
    rows = rows.select("doc_id", F.size("known").cast("long").alias("n_sentences"), F.concat_ws("", named).alias("sequence"))
    matched = F.col("sequence")
    for sequence, name in RULES:
        matched = F.replace(matched, F.lit("".join(f"[{x}]" for x in sequence)), F.lit(f"<{name}>"))
    rows = rows.withColumn("matched", matched)
    return rows.select(
        "doc_id", "n_sentences", "sequence", F.array_sort(F.array_distinct(F.regexp_extract_all("matched", F.lit("<([^>]+)>")))).alias("licenses"),
        F.regexp_extract_all("matched", F.lit(r"\[([^\]]+)\]")).alias("unmatched"))


def oracle_sql() -> str:
    """DuckDB SQL of ``op1_license_scan``."""
    listed = ", ".join(f"'{s}'" for s in SENTENCES)
    ids = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    matched = "sequence"
    for sequence, name in RULES:
        matched = f"replace({matched}, '{''.join(f'[{x}]' for x in sequence)}', '<{name}>')"
    def quoted(x: str) -> str:
        x = x.replace("'", "''")
        for c in "\n\x01\x02\x03":
            x = x.replace(c, f"' || chr({ord(c)}) || '")
        return f"'{x}'"

    def replaced(t: str, steps) -> str:
        for pattern, by in steps:
            t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(by)}, 'g')"
        return t

    return rf"""
WITH r AS (SELECT doc_id, chr(10) || translate(coalesce(text, ''), chr(1) || chr(2), '  ') || chr(10) AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN contains(t, '/*') THEN regexp_replace(t, {quoted(STARS)}, chr(10), 'g') ELSE t END AS t FROM r),
l AS (SELECT doc_id, chr(1) || translate({replaced("t", LAYOUT)}, {quoted(_UPPER)}, {quoted(_LOWER)}) || chr(1) AS t FROM c),
e AS (SELECT doc_id, string_split(trim({replaced("t", _normalise())}, ' ' || chr(1)), chr(1)) AS s FROM l),
s AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN starts_with(x, chr(3))
    THEN list_transform(string_split_regex(regexp_replace(x[2:], ' or (later|any later)', chr(4) || 'or' || chr(4) || '\1', 'g'), '{OTHER}'), lambda n: 'licensed under ' || replace(n, chr(4), ' '))
    ELSE [x] END)) AS s FROM e),
k AS (SELECT doc_id, list_filter(list_transform(s, lambda x, i: {{'s': x, 'i': i}}), lambda x: x.s IN ({listed})) AS known FROM s),
q AS (SELECT doc_id, len(known) AS n_sentences, array_to_string(list_transform(known, lambda x, k:
    (CASE WHEN k > 1 AND x.i - known[k - 1].i > {GAP + 1} THEN '~' ELSE '' END) || '[' || MAP {{{ids}}}[x.s] || ']'), '') AS sequence FROM k),
m AS (SELECT doc_id, n_sentences, coalesce(sequence, '') AS sequence, {matched} AS matched FROM q)
SELECT doc_id, n_sentences::BIGINT AS n_sentences, sequence, array_to_string(list_sort(list_distinct(regexp_extract_all(matched, '<([^>]+)>', 1))), ',') AS licenses,
  array_to_string(regexp_extract_all(matched, '\[([^\]]+)\]', 1), ',') AS unmatched
FROM m"""
