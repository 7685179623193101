"""Usual licence texts and notices, wrapped as they are found."""

import re

import pytest

from docspan.llm import licences

AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
'''
MIT = '''MIT License

Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

''' + AS_IS + '''IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
'''
ISC = '''Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

''' + AS_IS
BSD_HEAD = '''Copyright (c) 2019, Group
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

'''
BSD_TAIL = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.
'''
BSD3 = BSD_HEAD + '''3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

''' + BSD_TAIL
APACHE_NOTICE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
'''


def gnu(kind, version):
    return f'''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind} Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.
'''


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


TEXTS = {
    "MIT": [MIT, commented(MIT, "//"), commented(MIT, " *"), "SPDX-License-Identifier: MIT\nint x;", "Released under the MIT licence."],
    "ISC": [ISC, commented(ISC, "#")],
    "BSD-3-Clause": [BSD3, commented(BSD3, " *"), "Available under the BSD 3-Clause terms."],
    "BSD-2-Clause": [BSD_HEAD + BSD_TAIL],
    "Apache-2.0": [APACHE_NOTICE, commented(APACHE_NOTICE, "#"), "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/"],
    "GPL-3.0-or-later": [gnu("General", 3), commented(gnu("General", 3), "--"), "SPDX-License-Identifier: GPL-3.0+"],
    "GPL-2.0-or-later": [gnu("General", 2), "under the GNU GPL text;\nGNU General Public License, version 2;\nor (at your option) any later version"],
    "LGPL-2.1-or-later": [gnu("Lesser General", "2.1"), "x = 1  # SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0-or-later": [gnu("Lesser General", 3)],
    "AGPL-3.0-or-later": [gnu("Affero General", 3)],
    "GPL-3.0": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007", "Distributed under AGPLv3."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"],
    "GPL-3.0-only": ["Released under GPLv3.", "under the GNU General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0\n===="],
    "EPL-2.0": ["Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM", "made available under the terms of the\nEclipse Public License v. 2.0 which is available at"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License,\nVersion 1.1.", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "ODbL-1.0": ["made available under the Open Database\nLicense (ODbL) v1.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", "Text: CC BY 4.0"],
    "CC-BY-SA-4.0": ["Text is CC-BY-SA-4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Attribution-NonCommercial-ShareAlike 4.0 International", "CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal", "The author has dedicated the work\nto the public domain."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it."],
    "Artistic-2.0": ["The Artistic License 2.0\n\nCopyright (c) 2000"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "Proprietary": ["Copyright 2020 Example.\nAll rights reserved."],
    "MIT AND Apache-2.0": ["Dual licensed under the MIT License or the Apache License 2.0.", "// SPDX-License-Identifier: (MIT OR Apache-2.0) WITH LLVM-exception", MIT + "\n\n" + APACHE_NOTICE],
    "": ["the warrior liked his islands", "A licence of some kind applies.", "Permission is hereby granted to leave early.", "SPDX-License-Identifier: LicenseRef-Own", "mit Kennzeichen und mit Lizenz", "", None,
         # sentences of one licence that stand far apart are none of it
         "Redistributions of source code must retain the above copyright notice.\n\n" + "Some words here. " * 9],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, want, text) for k, (want, text) in enumerate((w, t) for w, texts in TEXTS.items() for t in texts)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    return [(want, text, got[k]) for k, want, text in rows]


def test_usual_texts(found):
    wrong = [(want, row.licence, row.sequence, (text or "")[:60]) for want, text, row in found if row.licence != want]
    assert not wrong and len(TEXTS) > 25


def test_sentences_keep_their_text(found):
    row = next(r for want, text, r in found if text == BSD3)
    assert row.sequence == "copyright all-rights bsd-grant bsd-source bsd-binary bsd-endorse asis-warranty liability"
    assert row.sentences[3].text.startswith("Redistributions of source code must retain") and row.sentences[3].text.endswith("disclaimer.")
    assert [r.n_unknown for want, text, r in found if text == "A licence of some kind applies."] == [1]


def test_far_sentences_are_apart(spark):
    near = "GNU General Public License, version 3. {} Or (at your option) any later version."
    docs = spark.createDataFrame([(k, near.format("More is said. " * k)) for k in (0, 3, 4, 9)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(docs).collect()} == {0: "GPL-3.0-or-later", 3: "GPL-3.0-or-later", 4: "GPL-3.0-only", 9: "GPL-3.0-only"}


def test_the_hint_follows_from_every_rule():
    """A text made to fit a rule holds the stem that stands beside it."""
    samples = [t for texts in TEXTS.values() for t in texts if t]
    for name, rule, stem in licences.SENTENCES:
        for text in samples:
            plain = re.sub(" +", " ", re.sub(r"([a-z])\.|\.([^0-9]|$)", lambda m: (m[1] or "") + " " + (m[2] or ""), re.sub("[^a-z0-9.]+", " ", text.lower().replace("licence", "license")))).strip()
            if re.search(rule, plain):
                assert re.search(stem, text.lower()), (name, text)
