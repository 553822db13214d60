"""The catalogue of the licence scans: wordings of licence sentences, names of licences, and rules over their identifiers.

A wording is a sentence in lower-case letters and digits with single blanks. A name is what may follow "licensed under"
or an SPDX tag, without words that don't tell licences apart and without ".0" (see licences._plain).
"""

from __future__ import annotations

# Identifier and wordings, beside those that the SQL of op6_licences knows.
TEXTS = {
    # the text has a blank line after "conditions:", so the halves of the grant are sentences of their own
    "MitPermit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "ApacheRefUse": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",),
    "BsdName": tuple(f"neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for who in ("the copyright holder", "the copyright owner", "the author", "the organization", "the university", "the company")),
    "IscGrant": tuple(f"permission to use copy modify and {either}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for either in ("", "or ")),
    "IscAsIs": tuple(f"the software is provided as is and {who} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness" for who in ("the author", "isc")),
    "UnlicenseFree": ("this is free and unencumbered software released into the public domain",),
    "UnlicenseAnyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "MplForm": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "MplCopy": tuple(f"if a copy of the mpl was not distributed with this file you can obtain one at {at}mozilla org mpl 2 0" for at in ("http ", "https ", "http www ", "https www ")),
    # titles of whole texts
    "MitRef": ("mit license", "the mit license", "the mit license mit"),
    "IscRef": ("isc license",),
    "ApacheRef": ("apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "Gpl2Ref": ("gnu general public license version 2 june 1991",),
    "Gpl3Ref": ("gnu general public license version 3 29 june 2007",),
    "Lgpl21Ref": ("gnu lesser general public license version 2 1 february 1999",),
    "Lgpl3Ref": ("gnu lesser general public license version 3 29 june 2007",),
    "Agpl3Ref": ("gnu affero general public license version 3 19 november 2007",),
    "MplRef": ("mozilla public license version 2 0",),
    "Cc0Ref": ("cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    "UnlicenseRef": ("the unlicense",),
}
TEXT_RULES = (
    ("MIT", ("MitPermit", "MitNotice", "MitAsIs")),
    ("Apache-2.0", ("ApacheRefUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("BSD-3-Clause", ("BsdForms", "BsdSource", "BsdBinary", "BsdName")),
)
SHORT_RULES = (
    ("MIT", ("MitPermit", "MitNotice")),
    ("MIT", ("MitPermit",)),
    ("Apache-2.0", ("ApacheRefUse",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("Unlicense", ("UnlicenseFree",)),
    ("MPL-2.0", ("MplForm", "MplCopy")),
    ("MPL-2.0", ("MplForm",)),
)
# Identifier, licence and names.
REFERENCES = (
    ("MitRef", "MIT", ("mit", "expat", "mit expat", "mit x11")),
    ("Mit0Ref", "MIT-0", ("mit 0",)),
    ("ApacheRef", "Apache-2.0", ("apache 2", "apache2", "asl 2", "apache software 2")),
    ("Apache11Ref", "Apache-1.1", ("apache 1 1", "apache software 1 1")),
    ("ApacheAnyRef", "Apache", ("apache", "apache software")),
    ("BsdRef", "BSD", ("bsd", "bsd style")),
    ("Bsd2Ref", "BSD-2-Clause", ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "bsd 2 clause simplified", "freebsd")),
    ("Bsd3Ref", "BSD-3-Clause", ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("Bsd4Ref", "BSD-4-Clause", ("bsd 4 clause", "4 clause bsd", "original bsd")),
    ("Bsd0Ref", "0BSD", ("0bsd", "bsd zero clause", "zero clause bsd")),
    ("IscRef", "ISC", ("isc",)),
    ("MplRef", "MPL-2.0", ("mozilla public 2", "mozilla 2", "mpl 2", "mpl2")),
    ("Mpl11Ref", "MPL-1.1", ("mozilla public 1 1", "mpl 1 1")),
    ("MplAnyRef", "MPL", ("mozilla public", "mpl")),
    ("Epl1Ref", "EPL-1.0", ("eclipse public 1", "epl 1")),
    ("Epl2Ref", "EPL-2.0", ("eclipse public 2", "epl 2")),
    ("BslRef", "BSL-1.0", ("boost software 1", "bsl 1", "boost software", "boost")),
    ("ZlibRef", "Zlib", ("zlib", "zlib libpng")),
    ("ArtisticRef", "Artistic-2.0", ("artistic 2",)),
    ("UnlicenseRef", "Unlicense", ("unlicense",)),
    ("Cc0Ref", "CC0-1.0", tuple(f"{name}{version}" for name in ("cc0", "cc zero", "creative commons zero", "creative commons cc0") for version in ("", " 1", " 1 universal"))),
    ("WtfplRef", "WTFPL", ("wtfpl",)),
)
GNU = (
    ("Gpl", "GPL", ("gnu general public",), ("1", "2", "3")),
    ("Lgpl", "LGPL", ("gnu lesser general public", "gnu library general public"), ("2", "2.1", "3")),
    ("Agpl", "AGPL", ("gnu affero general public",), ("3",)),
)
CREATIVE_COMMONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_LONG = {"by": ("attribution",), "sa": ("sharealike", "share alike"), "nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "noderivs", "no derivatives", "no derivs")}


def _gnu() -> tuple[dict, list, list]:
    """Wordings, rules of more than one sentence and references (as above) of the GNU licences."""
    texts, rules, references = {}, [], []
    for short, label, longs, versions in GNU:
        texts[f"{short}See"] = tuple(f"see the {long} license for more details" for long in longs)
        names = [n for long in longs for n in (long, long.removeprefix("gnu "))] + [label.lower(), f"gnu {label.lower()}"]
        references.append((f"{short}AnyRef", label, tuple(names)))
        for v in versions:
            key, licence, n = short + v.replace(".", ""), f"{label}-{v}" + ("" if "." in v else ".0"), v.replace(".", " ")
            start = [f"this program is free software you can redistribute it and or modify it under the terms of the {long} license" for long in longs]
            texts[f"{key}Later"] = tuple(f"{s} as published by the free software foundation either version {x} of the license or at your option any later version" for s in start for x in (n, f"{n} 0"))
            texts[f"{key}Only"] = tuple(f"{s}{x}" for s in start for x in (f" as published by the free software foundation version {n} of the license", f" as published by the free software foundation version {n}", f" version {n} as published by the free software foundation", f" version {n} only as published by the free software foundation"))
            for kind, name in (("Later", f"{licence}-or-later"), ("Only", licence)):
                rules += [(name, (key + kind, "GplHope", f"{short}See")), (name, (key + kind,))]
            named = [f"{x} {n}" for x in names] + [f"{x}{n}" for x in names if x.endswith(label.lower())]
            references += [(f"{key}Ref", licence, tuple(named)), (f"{key}LaterRef", f"{licence}-or-later", tuple(f"{x} orlater" for x in named))]
    return texts, rules, references


def _creative_commons() -> list:
    out = []
    for kind in CREATIVE_COMMONS:
        longs = ["creative commons"]
        for part in kind.split():
            longs = [f"{x} {y}" for x in longs for y in _LONG[part]]
        names = [f"cc {kind}", f"creative commons {kind}", *longs]
        base, label = "Cc" + kind.title().replace(" ", ""), "CC-" + kind.upper().replace(" ", "-")
        for v in ("", "1", "2", "2.5", "3", "4"):
            key = base + {"": "Any", "4": ""}.get(v, v.replace(".", "")) + "Ref"
            out.append((key, label + (v and f"-{v}" + ("" if "." in v else ".0")), tuple(f"{x} {v.replace('.', ' ')}".strip() for x in names)))
    return out


def catalogue(sentences: dict, rules: tuple) -> tuple[dict, tuple, dict]:
    """Identifiers with their wordings, rules, and the identifier of each name: all of the given ones and those above."""
    gnu_texts, gnu_rules, gnu_references = _gnu()
    references = [*REFERENCES, *gnu_references, *_creative_commons()]
    known = {k: () for k in (*sentences, *TEXTS, *gnu_texts, *(r[0] for r in references))}
    known = {k: tuple(dict.fromkeys((*sentences.get(k, ()), *TEXTS.get(k, ()), *gnu_texts.get(k, ())))) for k in known}
    long = [r for r in gnu_rules if len(r[1]) > 1]
    all_rules = (*TEXT_RULES, *long, *rules, *SHORT_RULES, *(r for r in gnu_rules if len(r[1]) == 1), *((label, (key,)) for key, label, _ in references))
    return known, tuple(dict.fromkeys(all_rules)), {name: key for key, _, names in references for name in names}
