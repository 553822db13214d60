import re

import pytest

from tessera.llm import licences as L

from ..conftest import SF01
from .oracle import agree

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. The rest."""
CASES = [
    (MIT, ["MIT"], []),
    ("Some words.\nAll rights reserved.\nMore words", ["All-rights-reserved"], []),
    ("Licensed under the Apache License, Version 2.0. See the license for the specific language governing permissions and limitations under the License.", ["Apache-2.0"], ["ApacheSee"]),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License. All rights reserved!", ["MIT", "CC-BY-NC-4.0", "All-rights-reserved"], []),
    ("This is not licensed under the MIT license at all.", [], []),
    ("Released under the MIT License.\nLicensed under the MIT License.", ["MIT"], []),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", [], ["GplHope"]),
    (None, [], []),
    ("", [], []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(CASES)], "i int, text string, licences string")
    got = {r["i"]: (r["licences"], r["left"]) for r in L.scan_licences(df).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(CASES)}
    assert L.scan_licences(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    agree(spark, "op6_licences", SF01)


@pytest.mark.parametrize("rule", [r for _, r in L.RULES])
def test_rules_name_known_sentences(rule):
    assert set(rule) <= set(L.SENTENCES)


# the text as the Open Source Initiative has it
MIT_WHOLE = """MIT License

Copyright (c) 2020 Some Body

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
SOFTWARE.
"""


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [(r["licences"], r["left"]) for r in L.scan_licences(df).orderBy("i").collect()]


def test_unmodified_mit_text(spark):
    paragraphs = "\n\n".join(p.replace("\n", " ") for p in MIT_WHOLE.strip().split("\n\n"))
    for text in (MIT_WHOLE, paragraphs, paragraphs.replace("\n\n", "\n")):
        assert scanned(spark, [text]) == [(["MIT"], [])], text


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
LINE = "Some prose here\nLicensed under CC BY-NC 4.0\nmore prose here"


def test_both_cuts_count(spark):
    wrapped = "This project is\nlicensed under the MIT License."
    both = [LINE + "\n\n" + GPL3, GPL3 + "\n\n" + LINE, LINE + "\n\n" + wrapped, LINE + "\n \n" + wrapped, LINE + "\n\n" + wrapped + "\n\n" + LINE]
    gpl, mit = (["GPL-3.0-or-later", "CC-BY-NC-4.0"], []), (["MIT", "CC-BY-NC-4.0"], [])
    assert scanned(spark, both) == [gpl, gpl, mit, mit, mit]
    commented = "/*\n" + "\n".join(" * " + x for x in MIT_WHOLE.split("\n")) + "\n */"
    assert scanned(spark, [commented, MIT_WHOLE.replace("\n", "\r\n")]) == [(["MIT"], [])] * 2
    df = spark.createDataFrame([(LINE + "\n\n" + GPL3 + "\n\n" + wrapped,)], "text string")
    assert L.scan_licences(df).first()["sentences"] == ["CcByNcRef", "Gpl3Later", "GplHope", "GplSee", "MitRef"]


REFERENCES = [
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("# SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR Apache-2.0\n# more", ["Apache-2.0", "GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: LGPL-2.1-only */", ["LGPL-2.1"]),
    ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: CC0-1.0 OR Unlicense", ["MIT", "Unlicense", "CC0-1.0"]),
    ("This file is licensed under the MIT License.", ["MIT"]),
    ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("It is licensed under the GNU Affero General Public License v3.0 or later", ["AGPL-3.0-or-later"]),
    ("Released under GPLv3+", ["GPL-3.0-or-later"]),
    ("Licensed under the Mozilla Public License 2.0.", ["MPL-2.0"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike\n3.0 Unported License.", ["CC-BY-NC-SA-3.0"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("The code is available under the terms of the ISC license, see the LICENSE file.", ["ISC"]),
    ("License: BSD-3-Clause", ["BSD-3-Clause"]),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    (GPL3.replace("General", "Affero General"), ["AGPL-3.0-or-later"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("This file is not licensed under the MIT License.", []),
    ("He walked under the bridge. The MIT is a school, and the license plate was red.", []),
]


def test_references_and_families(spark):
    got = scanned(spark, [t for t, _ in REFERENCES])
    assert [x for x in zip(REFERENCES, got, strict=True) if x[1] != (x[0][1], [])] == []


def test_every_wording_has_a_cue():
    assert [w for w in L.KNOWN if not re.search(L.CUE, w)] == []


def test_a_taken_rule_keeps_its_place(spark):
    """BSD forms, a whole GPL notice, then the rest of a BSD text: the two parts don't meet."""
    forms = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.\n\n"
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    assert scanned(spark, [forms + source + GPL3 + "\n\n" + binary]) == [(["GPL-3.0-or-later", "BSD"], ["BsdSource", "BsdBinary"])]
    assert scanned(spark, [forms + source + binary + GPL3]) == [(["GPL-3.0-or-later", "BSD"], [])]


def test_unknown_licences_are_reported(spark):
    texts = ["This file is licensed under the Frobnicate Public License 7.", "SPDX-License-Identifier: LicenseRef-Own\nSPDX-License-Identifier: MIT", "License: GLWTPL", "Licensed under the MIT License.", "He walked under the bridge; the license plate was red.", None, ""]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, text string, __taken string")
    got = {r["i"]: (r["unknown"], r["licences"], r["__taken"]) for r in L.scan_licences(df).collect()}
    assert [got[i][0] for i in range(7)] == [["the frobnicate public license 7"], ["licenseref own"], ["glwtpl"], [], [], [], []]
    assert got[1][1] == got[3][1] == ["MIT"] and all(g[2] == "own" for g in got.values())


def test_long_texts(spark):
    text = ("word " * 15 + "\n") * 130_000 + LINE + "\n\n" + GPL3  # ten megabytes
    assert scanned(spark, [text, "a" * 10_000_000 + " license "]) == [(["GPL-3.0-or-later", "CC-BY-NC-4.0"], []), ([], [])]
