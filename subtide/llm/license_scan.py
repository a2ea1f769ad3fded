"""Licence scans: known licence sentences give identifiers, and identifier sequences are matched against ordered rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of licence notices by identifier, in the wording of the licences.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "rights-reserved": "All rights reserved.",
    "gpl-redistribute-part": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-licensed": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-free": "This library is free software:",
    "lgpl-redistribute-part": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "later-2": "either version 2 of the License, or (at your option) any later version.",
    "later-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "later-3": "either version 3 of the License, or (at your option) any later version.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-licensed": "Licensed under CC0 1.0.",
    "cc-by-nd-licensed": "Licensed under CC BY-ND 4.0.",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-terms-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl2-accompanies": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    "spdx": "SPDX-License-Identifier:",
}
#: Licences by the names that follow an SPDX tag.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"]
SENTENCES |= {f"name-{name.lower()}": name for name in SPDX}

#: (rule, licence, identifiers in order); tried in this order, so longer sequences come before their parts.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("mit-grant-only", "MIT", ["mit-grant"]),
    ("apache-notice", "Apache-2.0", ["apache-header", "apache-compliance", "apache-copy", "apache-as-is"]),
    ("apache-notice-short", "Apache-2.0", ["apache-header", "apache-compliance"]),
    ("gpl3-notice", "GPL-3.0-or-later", ["gpl-free", "gpl-redistribute", "gpl-hope"]),
    ("gpl3-notice-short", "GPL-3.0-or-later", ["gpl-redistribute"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("mit-tag", "MIT", ["mit-released"]),
    ("mit-tag-licensed", "MIT", ["mit-licensed"]),
    ("mit-tag-the-title", "MIT", ["mit-the-title"]),
    ("mit-tag-title", "MIT", ["mit-title"]),
    ("apache-tag", "Apache-2.0", ["apache-licensed"]),
    ("gpl3-tag", "GPL-3.0-only", ["gpl3-licensed"]),
    ("cc-by-tag", "CC-BY-4.0", ["cc-by-licensed"]),
    ("cc-by-work", "CC-BY-4.0", ["cc-work"]),
    ("cc-by-nc-tag", "CC-BY-NC-4.0", ["cc-by-nc-licensed"]),
    ("cc-by-sa-tag", "CC-BY-SA-4.0", ["cc-by-sa-licensed"]),
    ("gpl2-notice", "GPL-2.0-or-later", ["gpl-free", "gpl-redistribute-part", "later-2"]),
    ("gpl2-notice-short", "GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("gpl2-notice-part", "GPL-2.0-or-later", ["gpl-redistribute-part", "later-2"]),
    ("gpl3-notice-part", "GPL-3.0-or-later", ["gpl-redistribute-part", "later-3"]),
    ("gpl2-only-notice", "GPL-2.0-only", ["gpl2-only"]),
    ("gpl2-tag", "GPL-2.0-only", ["gpl2-licensed"]),
    ("lgpl21-notice", "LGPL-2.1-or-later", ["lgpl-redistribute-part", "later-2.1"]),
    ("lgpl21-notice-short", "LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("lgpl2-notice", "LGPL-2.0-or-later", ["lgpl-redistribute-part", "later-2"]),
    ("lgpl3-notice", "LGPL-3.0-or-later", ["lgpl-redistribute-part", "later-3"]),
    ("lgpl3-notice-short", "LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("mpl2-notice", "MPL-2.0", ["mpl-form"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("isc-text-and", "ISC", ["isc-grant-and"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("unlicense-text-short", "Unlicense", ["unlicense-free"]),
    ("cc0-notice", "CC0-1.0", ["cc0-dedicated"]),
    ("cc0-tag-title", "CC0-1.0", ["cc0-title"]),
    ("cc0-tag", "CC0-1.0", ["cc0-licensed"]),
    ("cc-by-nd-tag", "CC-BY-ND-4.0", ["cc-by-nd-licensed"]),
    ("agpl3-notice", "AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant"]),
    ("zlib-text-short", "Zlib", ["zlib-grant"]),
    ("bsl-text", "BSL-1.0", ["bsl-title", "bsl-grant"]),
    ("bsl-text-short", "BSL-1.0", ["bsl-grant"]),
    ("epl2-notice", "EPL-2.0", ["epl2-terms"]),
    ("epl2-notice-line", "EPL-2.0", ["epl2-terms-line"]),
    ("epl2-notice-accompanies", "EPL-2.0", ["epl2-accompanies"]),
    *[(f"spdx-{name.lower()}", name, ["spdx", f"name-{name.lower()}"]) for name in SPDX],
    ("reserved", "all-rights-reserved", ["rights-reserved"]),
]

#: Sentences of one sequence have at most so many other sentences between them, blank ones not counted.
MAX_GAP = 2

#: Words with a capital inside the known sentences that begin none: a line that starts with one goes on with a sentence.
_INSIDE = {i: s for i, s in SENTENCES.items() if not i.startswith("name-")}
_FIRST = {re.match("[A-Za-z]*", s)[0] for s in _INSIDE.values()}
_INNER = sorted({w for s in _INSIDE.values() for w in re.findall("[A-Z][A-Za-z]*", s)} - _FIRST)
#: A line break inside a sentence, with the blanks, carriage returns and comment marks about it. Links and blank lines are not joined, nor
#: lines that begin as a known sentence does, so that a title or tag on a line of its own stays one. No quote signs: it stands in SQL, too.
WRAP = (
    r"([A-Za-z,)\"”]|either [Vv]ersion [0-9.]*[0-9])[ \t]*\r?\n[ \t]*(?:(?:#+|\*+|//+|;+|--+|%+|>+)[ \t]*)?"
    rf"([a-gi-z(\"“]|h[a-su-z]|2\.[01]\b|[23] of the|THE WARRANTIES|(?:{'|'.join(_INNER)})\b)"
)
STOP = r"([.!?:;])\s+"
NOISE = r"[^a-z0-9.+-]+"
EDGES = r"^[ .+-]+|[ .+-]+$"


def normalised(sentence: Column) -> Column:
    """Lower case; letters a-z, digits and ``.+-`` stay, all else is one space; none of those signs at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), NOISE, " "), EDGES, "")


def sentences(text: Column) -> Column:
    """The text's sentences: cut at line breaks (but not where a line is wrapped) and after ``.!?:;`` before white space."""
    return F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WRAP, "$1 $2"), STOP, "$1\n"), "\n")


def known_sentences(spark) -> dict[str, str]:
    """Identifier by normalised sentence."""
    rows = spark.createDataFrame(list(SENTENCES.items()), "id string, sentence string").select("id", normalised(F.col("sentence")).alias("sentence")).collect()
    return {r["sentence"]: r["id"] for r in rows}


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, max_gap: int = MAX_GAP) -> DataFrame:
    """``keep`` columns, then n_sentences, sentence_ids, rules and licenses (sorted, distinct) of every row of ``docs``.

    Each normalised sentence that isn't blank is looked up among SENTENCES; the identifiers found stand in text order,
    parted by ``|`` where more than ``max_gap`` other sentences lie between. RULES are tried in their order
    on this sequence and use up what they match; a rule counts once however often it matches.

    sentence_ids, rules and licenses are strings joined by blanks, empty if there are none. A null or
    empty text has one empty sentence. Row by row, so ties, repeated rows and empty tables need
    nothing special. Working columns begin with ``_lic_``; ``keep`` defaults to doc_id.
    """
    keep = keep or ["doc_id"]
    ids = known_sentences(docs.sparkSession)
    to_id = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    split = docs.select(*keep, sentences(F.col("text")).alias("_lic_s"))
    placed = F.transform(F.filter(F.transform("_lic_s", normalised), lambda s: s != ""), lambda s, i: F.struct(i.alias("pos"), s.alias("s")))
    hits = split.select(*keep, F.size("_lic_s").cast("long").alias("n_sentences"), F.filter(placed, lambda x: x["s"].isin(list(ids))).alias("_lic_h"))
    far = lambda h, i: (i > 0) & (h["pos"] - F.get("_lic_h", i - 1)["pos"] > max_gap + 1)
    tokens = F.transform("_lic_h", lambda h, i: F.concat(F.when(far(h, i), F.lit("| ")).otherwise(F.lit("")), F.element_at(to_id, h["s"])))
    found = hits.select(*keep, "n_sentences", F.array_join(tokens, " ").alias("sentence_ids"))
    # " a  b  c " so that neighbouring identifiers don't share a blank
    left = F.concat(F.lit(" "), F.replace(F.col("sentence_ids"), F.lit(" "), F.lit("  ")), F.lit(" "))
    patterns = F.array(*[F.struct(F.lit("".join(f" {x} " for x in sequence)).alias("p"), F.lit(rule).alias("r")) for rule, _, sequence in RULES])
    begin = F.struct(left.alias("seq"), F.array().cast("array<string>").alias("rs"))

    def step(done: Column, rule: Column) -> Column:
        rs = F.when(F.contains(done["seq"], rule["p"]), F.array_append(done["rs"], rule["r"])).otherwise(done["rs"])
        return F.struct(F.replace(done["seq"], rule["p"], F.lit(" # ")).alias("seq"), rs.alias("rs"))

    names = {rule: licence for rule, licence, _ in RULES}
    rules = F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(F.aggregate(patterns, begin, step, lambda done: done["rs"]))
    to_licence = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return found.withColumn("_lic_r", rules).select(
        *keep, "n_sentences", "sentence_ids",
        F.array_join("_lic_r", " ").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_lic_r", lambda r: F.element_at(to_licence, r)))), " ").alias("licenses"),
    )


def oracle_sql(max_gap: int = MAX_GAP) -> str:
    """The same over ``documents`` in DuckDB."""
    norm = f"regexp_replace(regexp_replace(lower({{}}), '{NOISE}', ' ', 'g'), '{EDGES}', '', 'g')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {norm.format(quote(s))})" for i, s in SENTENCES.items())
    steps = reduce(lambda sql, r: f"SELECT n, replace(seq, {quote(''.join(f' {x} ' for x in r[2]))}, ' # ') AS seq, CASE WHEN contains(seq, {quote(''.join(f' {x} ' for x in r[2]))}) THEN list_append(rs, {quote(r[0])}) ELSE rs END AS rs FROM ({sql})", RULES, "SELECT n, ' ' || replace(ids, ' ', '  ') || ' ' AS seq, []::VARCHAR[] AS rs FROM seqs")
    licences = ", ".join(f"({quote(r)}, {quote(name)})" for r, name, _ in RULES)
    return f"""
WITH known(id, s) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS n, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{WRAP}', '\\1 \\2', 'g'), '{STOP}', '\\1\n', 'g'), chr(10)) AS ss FROM documents),
f AS (SELECT n, list_filter(list_transform(ss, lambda x: {norm.format('x')}), lambda x: x <> '') AS ns FROM d),
u AS (SELECT n, unnest(ns) AS ns, unnest(range(len(ns))) AS pos FROM f),
h AS (SELECT n, pos, id, pos - lag(pos) OVER (PARTITION BY n ORDER BY pos) AS gap FROM u JOIN known ON ns = known.s),
seqs AS (SELECT n, string_agg(CASE WHEN gap > {max_gap + 1} THEN '| ' ELSE '' END || id, ' ' ORDER BY pos) AS ids FROM h GROUP BY n),
m AS ({steps}),
lic(rule, name) AS (VALUES {licences}),
l AS (SELECT n, string_agg(name, ' ' ORDER BY name) AS licenses FROM (SELECT DISTINCT n, name FROM (SELECT n, unnest(rs) AS rule FROM m) JOIN lic USING (rule)) GROUP BY n)
SELECT doc_id, len(ss)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(rs, ' '), '') AS rules, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN seqs USING (n) LEFT JOIN m USING (n) LEFT JOIN l USING (n)
"""
