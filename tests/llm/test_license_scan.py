import textwrap

import pytest

from subtide.llm import license_scan as ls

S = ls.SENTENCES
MIT = "\n".join(["MIT License", "", "Copyright (c) 2020 Somebody", "", S["mit-grant"], S["mit-notice"], S["mit-as-is"]])
DOCS = [
    (1, "Some prose here. And more.\nReleased under the MIT License.\nEnd", "MIT", "mit-tag"),
    (1, "Some prose here. And more.\nReleased under the MIT License.\nEnd", "MIT", "mit-tag"),
    (2, MIT, "MIT", "mit-text mit-tag-title"),
    (3, MIT.replace("documentation files", "documentation\nfiles").lower(), "MIT", "mit-text mit-tag-title"),
    (4, None, "", ""),
    (5, "", "", ""),
    (6, "All rights reserved.\nLicensed under CC BY-NC 4.0.\nlicensed under the APACHE license, version 2.0", "Apache-2.0 CC-BY-NC-4.0 all-rights-reserved", "apache-tag cc-by-nc-tag reserved"),
    (7, S["bsd-redistribution"] + "\n" + S["bsd-source"] + "\n" + S["bsd-binary"] + "\n" + S["bsd-endorse"], "BSD-3-Clause", "bsd-3-text"),
    (8, S["bsd-redistribution"] + "\n1. " + S["bsd-source"] + "\n" + S["bsd-binary"], "BSD-2-Clause", "bsd-2-text"),
    (9, S["mit-notice"] + " " + S["mit-grant"], "MIT", "mit-grant-only"),
    (10, S["gpl-free"] + " " + S["gpl-redistribute"] + " One. Two. Three. Four. " + S["gpl-hope"], "GPL-3.0-or-later", "gpl3-notice-short"),
    (11, "word " * 100_000 + ". Licensed under CC BY 4.0.", "CC-BY-4.0", "cc-by-tag"),
    (None, "Not licensed under the MIT License", "", ""),
]


def test_rules(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _, _ in DOCS], "doc_id bigint, text string, licenses string")
    got = sorted(((r["doc_id"], r["licenses"], r["rules"]) for r in ls.scan_licenses(docs).collect()), key=repr)
    assert got == sorted(((d, licence, rules) for d, _, licence, rules in DOCS), key=repr)
    assert ls.scan_licenses(docs.limit(0)).count() == 0


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide.
"""
WRAPPED_MIT = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + "\n\n".join(textwrap.fill(S[x], 78) for x in ("mit-grant", "mit-notice", "mit-as-is"))
AGPL3 = GPL3.replace("GNU General", "GNU Affero General")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BSL1 = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL2 = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
NOTICES = [
    (BSD2, "BSD-2-Clause", "bsd-2-text"), (BSD3, "BSD-3-Clause", "bsd-3-text"), (GPL3, "GPL-3.0-or-later", "gpl3-notice"), (GPL2, "GPL-2.0-or-later", "gpl2-notice"),
    (LGPL, "LGPL-2.1-or-later", "lgpl21-notice"), (APACHE, "Apache-2.0", "apache-notice"), (MPL, "MPL-2.0", "mpl2-notice"), (ISC, "ISC", "isc-text"),
    (UNLICENSE, "Unlicense", "unlicense-text"), (CC0, "CC0-1.0", "cc0-notice"), (WRAPPED_MIT, "MIT", "mit-text mit-tag-title"),
    (AGPL3, "AGPL-3.0-or-later", "agpl3-notice"), (ZLIB, "Zlib", "zlib-text"), (BSL1, "BSL-1.0", "bsl-text"), (EPL2, "EPL-2.0", "epl2-notice-line"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0", "spdx-apache-2.0"), ("code\n\nSPDX-License-Identifier: MIT\n\nmore code", "MIT", "spdx-mit"),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "    "])
def test_notices_in_their_usual_layout(spark, mark):
    shown = [("\n".join((mark + line).rstrip() for line in text.split("\n")), licence, rules) for text, licence, rules in NOTICES]
    rows = [(i, t.replace("\n", end), licence, rules) for i, (t, licence, rules) in enumerate(shown) for end in ("\n", "\r\n")]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id bigint, text string")
    got = [(r["doc_id"], r["licenses"], r["rules"]) for r in ls.scan_licenses(docs).collect()]
    assert sorted(got) == sorted((i, licence, rules) for i, _, licence, rules in rows)


def test_tags_on_lines_of_their_own_stay(spark):
    texts = ["no stop before\nReleased under the MIT License.\nNo stop after", "MIT License\nCopyright (c) 2020 Somebody", "Some list\n    All rights reserved\nMore", "Licensed under CC BY 4.0\nmore"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["rules"] for r in ls.scan_licenses(docs).orderBy("doc_id").collect()] == ["mit-tag", "mit-tag-title", "reserved", "cc-by-tag"]


def test_a_name_alone_is_no_tag(spark):
    docs = spark.createDataFrame([(1, "MIT"), (2, "SPDX-License-Identifier: Unknown-1.0"), (3, "Licensed under CC BY-ND 4.0.")], "doc_id bigint, text string")
    assert [r["licenses"] for r in ls.scan_licenses(docs).orderBy("doc_id").collect()] == ["", "", "CC-BY-ND-4.0"]


def test_a_gap_of_real_sentences_parts_a_sequence(spark):
    four = [S["apache-header"], S["apache-compliance"], S["apache-copy"]]
    for between, rule in ((["One.", "", "", "Two."], "apache-notice"), (["One.", "Two.", "Three."], "apache-notice-short")):
        docs = spark.createDataFrame([(1, "\n".join([*four, *between, S["apache-as-is"]]))], "doc_id bigint, text string")
        assert ls.scan_licenses(docs).first()["rules"] == rule
