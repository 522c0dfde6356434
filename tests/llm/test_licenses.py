"""Licence texts in their usual layout, by the query and by its SQL."""

import duckdb
import pytest

from verdant.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2.replace("1. ", "* ").replace("2. ", "* ") + """

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
WRAPPED = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-2.0-or-later": GPL,
           "GPL-3.0-or-later": GPL.replace("version 2", "version 3").replace("software;", "software:"), "MPL-2.0": MPL}
LAYOUTS = {
    "plain": lambda t: t, "crlf": lambda t: t.replace("\n", "\r\n"), "indent": lambda t: t.replace("\n", "\n\t  "), "close": lambda t: t.replace(":\n\n", ":\n").replace(".\n\n", ".\n"),
    "hash": lambda t: "# " + t.replace("\n", "\n# "), "slashes": lambda t: "// " + t.replace("\n", "\n// "), "dashes": lambda t: "-- " + t.replace("\n", "\n-- "),
    "stars": lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */\nint main() {", "dnl": lambda t: "dnl " + t.replace("\n", "\ndnl "),
}


@pytest.fixture(scope="module")
def scanned(spark):
    def scan(texts):
        rows = list(enumerate(texts))
        got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        twin = {r[0]: r[1:] for r in con.execute(licenses.oracle_sql()).fetchall()}
        assert twin == {i: (r.n_sentences, r.sequence, ",".join(r.licenses), ",".join(r.unmatched)) for i, r in got.items()}
        return [got[i] for i in range(len(rows))]
    return scan


def test_wrapped_texts(scanned):
    cases = [(name, layout, make(text)) for name, text in WRAPPED.items() for layout, make in LAYOUTS.items()]
    for (name, layout, _), r in zip(cases, scanned([t for _, _, t in cases]), strict=True):
        assert r.licenses == [name], (name, layout, r)


def test_sentence_ends(scanned):
    texts = ["Released under the\nMIT License", "Released under the\n\nCC0 1.0", "Note:\nAll rights\nreserved", "- All rights reserved\n- Released under the MIT License",
             "All rights reserved\r\n \r\nReleased under\r\nthe MIT License", "Released under the MIT License.\n\n\n\n\n\nAll rights reserved.", 
             "no end\nReleased under the MIT License\nno end\nall rights\nreserved", "with text\nReleased under the MIT License and more", None, "", "\n\n:\n"]
    got = scanned(texts)
    assert [r.sequence for r in got] == ["[MITname]", "", "[AllRights]", "[AllRights][MITname]", "[AllRights][MITname]", "[MITname][AllRights]", "[MITname][AllRights]", "", "", "", ""]


def one_line(text):
    return " ".join(text.split())


ORIGINALS = {
    "MITgrant": MIT.split("\n\n")[2], "MITnotice": MIT.split("\n\n")[3], "AsIs": MIT.split("\n\n")[4].split(" IN NO EVENT")[0],
    "MITgrantnotice": one_line(" ".join(MIT.split("\n\n")[2:4])), "Unlicense": "This is free and unencumbered software released into the public domain.", "AllRights": "All rights reserved.",
    "Apache2header": APACHE.split("\n\n")[1].split("\nYou")[0], "Apache2comply": "You may not use this file except in compliance with the License.",
    "Apache2copy": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache2copywarranty": one_line(" ".join(APACHE.split("\n\n")[1:4])).split(". ")[1].split(" See")[0], "Apache2warranty": APACHE.split("\n\n")[3].split("\nSee")[0], "Apache2limits": "See the License for the specific language governing permissions and\nlimitations under the License.",
    "BSDpresource": one_line(" ".join(BSD3.split("\n\n")[1:3])), "BSDpre": BSD2.split("\n\n")[1], "BSDsource": BSD2.split("\n\n")[2], "BSDbinary": BSD2.split("\n\n")[3], "BSDname": BSD3.split("\n\n")[4],
    "GPL2plus": GPL.split("\n\n")[0], "GPL3plus": GPL.split("\n\n")[0].replace("version 2", "version 3"), "GPLwarranty": GPL.split("\n\n")[1].split("  See")[0], "GPLdetails": "See the\nGNU General Public License for more details.",
    **{f"{k}plus": GPL.split("\n\n")[0].replace("GNU ", f"GNU {n} ").replace("version 2", f"version {v}") for k, n, v in (("LGPL21", "Lesser", "2.1"), ("LGPL3", "Lesser", "3"), ("AGPL3", "Affero", "3"))},
    "ISCgrant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "0BSDgrant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "ISCwarranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.',
    "BSL1grant": """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    "BSL1copy": "(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)",
    "LGPLdetails": "See the GNU Lesser General Public License for more details.", "AGPLdetails": "See the GNU Affero General Public License for more details.",
}
NAMINGS = {
    "MITname": "The MIT License (MIT)", "Apache2name": "                                 Apache License\n                           Version 2.0, January 2004", "GPL3name": "This code is released under the GNU General Public License, version 3.",
    "GPL2name": "licensed under the GPLv2", "LGPL3name": "This library is distributed under the terms of the GNU Lesser General Public License v3.", "LGPL21name": "Licensed under the GNU LGPL, version 2.1",
    "AGPL3name": "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "MPL2name": MPL, "BSD3name": "BSD 3-Clause License", "BSD2name": "Released under the 2-clause BSD license.", "CC0name": "Released under CC0 1.0",
    "ISCname": "SPDX-License-Identifier: ISC", "0BSDname": "License: 0BSD", "EPL2name": "Licensed under EPL-2.0", "BSL1name": "Distributed under the Boost Software License, Version 1.0.",
    **{f"CC{k.replace('-', '')}4name": f"This work is licensed under CC {k} 4.0." for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}


def test_every_identifier_from_its_original(scanned):
    originals = ORIGINALS | NAMINGS
    assert set(originals) == set(licenses.SENTENCES.values()) == {i for s, _ in licenses.RULES for i in s}
    for layout in (lambda t: t, one_line):
        for (i, _), r in zip(originals.items(), scanned([layout(t) for t in originals.values()]), strict=True):
            assert i in r.sequence.strip("[]").split("]["), (i, r)


def test_every_entry(scanned):
    got = scanned([s.replace(" 2 0", " 2.0").replace(" 2 1", " 2.1").capitalize() + "." for s in licenses.SENTENCES])
    assert [r.sequence for r in got] == [f"[{i}]" for i in licenses.SENTENCES.values()]


def test_unwrapped_texts(scanned):
    texts = WRAPPED | {"Apache-2.0": APACHE, "LGPL-2.1-or-later": GPL.replace("GNU ", "GNU Lesser ").replace("version 2", "version 2.1").replace("program", "library")}
    paragraphs = {n: t.split("\n\n") for n, t in texts.items()}
    bodies = {n: p[{"MIT": 2, "Apache-2.0": 1, "BSD-2-Clause": 1, "BSD-3-Clause": 1}.get(n, 0):] for n, p in paragraphs.items()}
    for shape in ({n: "\n".join(map(one_line, p)) for n, p in paragraphs.items()}, {n: one_line(" ".join(p)) for n, p in bodies.items()}, {n: make(texts[n]) for n in texts for make in LAYOUTS.values()}):
        for (name, _), r in zip(shape.items(), scanned(shape.values()), strict=True):
            assert r.licenses == [name] and not r.unmatched, (name, r)
    near = ["This code is released under the MIT License.", "released under the terms of the GNU GPL v3 or later", "Available under the Apache License 2.0!"]
    assert [r.licenses for r in scanned(near)] == [["MIT"], ["GPL-3.0-or-later"], ["Apache-2.0"]]


ISC = ORIGINALS["ISCgrant"] + "\n\n" + ORIGINALS["ISCwarranty"]
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
#: Text, sequence and licences, written by hand.
NOTICES = [
    ("// SPDX-License-Identifier: Apache-2.0\npackage x;", "[Apache2name]", ["Apache-2.0"]),
    ("SPDX-License-Identifier: MIT", "[MITname]", ["MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0+\nx = 1", "[GPL2plus]", ["GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */", "[GPL2name][BSD2name]", ["BSD-2-Clause", "GPL-2.0-only"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later OR MPL-2.0 OR Apache-2.0 AND MIT OR ISC", "[LGPL21plus][MPL2name][Apache2name][MITname][ISCname]", ["Apache-2.0", "ISC", "LGPL-2.1-or-later", "MIT", "MPL-2.0"]),
    ("License: MIT", "[MITname]", ["MIT"]),
    ("This code is MIT licensed.", "[MITname]", ["MIT"]),
    ("The library is MIT OR Apache-2.0 licensed.", "[MITname][Apache2name]", ["Apache-2.0", "MIT"]),
    ("Licensed under the MIT license, see LICENSE.", "[MITname]", ["MIT"]),
    ("Licensed under the BSD 3-Clause License; see the LICENSE file for details.", "[BSD3name]", ["BSD-3-Clause"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "[Apache2name][MITname]", ["Apache-2.0", "MIT"]),
    ("This project is dual-licensed under\nthe MIT license and the Apache License 2.0.", "[MITname][Apache2name]", ["Apache-2.0", "MIT"]),
    ("Released under the GPLv3 or any later version or MIT", "[GPL3plus][MITname]", ["GPL-3.0-or-later", "MIT"]),
    (ISC, "[ISCgrant][ISCwarranty]", ["ISC"]),
    (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "[0BSDgrant][ISCwarranty]", ["0BSD"]),
    (EPL, "[EPL2name]", ["EPL-2.0"]),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)", "[BSL1name][BSL1copy]", ["BSL-1.0"]),
    (ORIGINALS["BSL1grant"], "[BSL1grant]", ["BSL-1.0"]),
    ("Licensed under MIT or something else", "", []), ("The licence: MIT was founded in 1861.", "", []), ("This is mitigated, available under stress", "", []), ("GPL-2.0+", "", []),
    ("Released under\ndnl CC0 1.0", "[CC0name]", ["CC0-1.0"]), ("\x03mit or isc\x04", "", []), ("License: \x03MIT\x04", "[MITname]", ["MIT"]),
]


def test_notices(scanned):
    for (text, sequence, names), r in zip(NOTICES, scanned([t for t, _, _ in NOTICES]), strict=True):
        assert (r.sequence, r.licenses) == (sequence, names), (text, r)


def test_clues():
    """No known sentence, and no beginning or end of a notice, is without a clue."""
    for s in licenses.SENTENCES:
        assert any(c in s for c in licenses.CLUES) or "under" in s and any(c in s for c in licenses.SHARING), s
    for head in ("licensed under", "released under", "distributed under", "available under", "spdx license identifier", "license", "licence", "licenses"):
        assert any(c in head for c in licenses.CLUES) or "under" in head and any(c in head for c in licenses.SHARING), head
