"""License scans by sentence rules: sentences to known identifiers, then sequences of identifiers to licences.

A text is cut into pieces (at line ends, and after ``.``, ``!``, ``?`` or ``;`` before a space), which are normalised (lower case, one
spelling of "licence", punctuation and comment marks dropped except dots inside numbers). A sentence is known if it equals a
run of whole pieces, so it may be wrapped over lines. What is between known sentences is left out; the
identifiers that remain, in order, are matched against ordered rules. A rule takes all its runs of identifiers before
the next rule looks, so a full licence text is not also read as a shorter licence that shares sentences with it.

Everything is a column expression on one row: no shuffle, no explode, no Python. A text without any of the ``CUES`` cannot hold a
known sentence and is not cut at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts, normalised, and the identifiers used here.
SENTENCES = {
    "all rights reserved": "all-rights",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2",
}
#: Sentences with a place for a holder's name, as patterns: up to twelve words stand there.
_HOLDER = r"[a-z0-9.]+(?: [a-z0-9.]+){0,11}"
SLOTTED = {
    rf"neither the names? of {_HOLDER} nor the names of (?:its|their|the|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    rf"the names? of {_HOLDER} may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    rf"this software is provided by {_HOLDER} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
}
# Public short identifiers that a tag may name.
TAGGED = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0",
          "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
          "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0"]
TAGS = {x.lower().replace("-", " "): x for x in TAGGED}
# How licences are named after "licensed under" and the like, normalised, and their public short identifiers.
NAMES = {
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0",
    "mit license": "MIT", "isc license": "ISC", "bsd license": "BSD", "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause", "mozilla public license version 2.0": "MPL-2.0", "unlicense": "Unlicense",
    "gnu general public license": "GPL", "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0",
    "gnu gpl version 2": "GPL-2.0", "gnu gpl version 3": "GPL-3.0", "gpl v2": "GPL-2.0", "gpl v3": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "cc0 1.0": "CC0-1.0", "boost software license version 1.0": "BSL-1.0", "zlib license": "Zlib",
}
#: The Creative Commons kinds, each with every version: ``cc by nc 4.0`` and ``creative commons attribution noncommercial 4.0``.
CC_KINDS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial",
            "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _kind, _long in CC_KINDS.items():
    for _version in CC_VERSIONS:
        _id = f"CC-{_kind.replace(' ', '-').upper()}-{_version}"
        for _name in (f"cc {_kind} {_version}", f"cc {_kind} {_version} license", f"creative commons {_long} {_version}",
                      f"creative commons {_long} {_version} license", f"creative commons {_long} {_version} international license"):
            NAMES[_name] = _id

#: Rules in order: a run of identifiers, and the licence it stands for. Whole texts come before their parts.
RULES = [
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("isc-grant",), "ISC"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("named:Apache-2.0", "apache-comply", "apache-copy", "apache-basis", "apache-see"), "Apache-2.0"),
    (("named:Apache-2.0", "apache-comply", "apache-copy"), "Apache-2.0"),
    (("gpl2-later", "gpl-hope", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("gpl3-later", "gpl-hope", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("agpl3-later", "gpl-hope", "agpl-see"), "AGPL-3.0-or-later"),
    (("agpl3-later",), "AGPL-3.0-or-later"),
    (("lgpl21-later", "lgpl-hope", "lgpl-see"), "LGPL-2.1-or-later"),
    (("lgpl21-later",), "LGPL-2.1-or-later"),
    (("lgpl3-later", "lgpl-hope", "lgpl-see"), "LGPL-3.0-or-later"),
    (("lgpl3-later",), "LGPL-3.0-or-later"),
    (("zlib-warranty", "zlib-grant"), "Zlib"),
    (("zlib-grant",), "Zlib"),
    (("boost-grant",), "BSL-1.0"),
    (("unlicense",), "Unlicense"),
    (("mpl2",), "MPL-2.0"),
    *[((f"named:{x}",), x) for x in sorted({*NAMES.values(), *TAGGED})],
    (("all-rights",), "All-Rights-Reserved"),
]

#: Every known sentence and every naming sentence holds one of these.
CUES = r"(?i)licen[cs]e|rights|warrant|permission|redistribut|public domain|cc0|cc by|creative commons|under|unencumbered|liable|spdx"
NAMING = r"^(?:(?:this|the) [a-z]+ (?:is|are) )?(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(.+)$"


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, one a line: cut at line ends, after ``.``, ``!``, ``?`` and ``;`` before a space, and before a link."""
    ended = F.regexp_replace(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), r"[ \t]+(?=<?https?://)", "\n")
    low = F.translate(ended, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    plain = F.regexp_replace(low, r"[^a-z0-9.\n]+", " ")
    numbers = F.regexp_replace(F.regexp_replace(plain, r"\.([^0-9]|$)", "$1"), r"(^|[^0-9])\.", "$1")
    return F.regexp_replace(F.regexp_replace(numbers, "licence", "license"), r"^[ \n]+|[ \n]+$|( )?\n[ \n]*", "\n")


def _any(of: Iterable[str]) -> str:
    """Any of some wordings, the longest first, with a line end for any of its spaces."""
    return "|".join(re.escape(x).replace("\\ ", "[ \\n]") for x in sorted(of, key=lambda x: (-len(x), x)))


#: A naming sentence as in ``NAMING``, also with "a" or "an" before the name and the words 'the "License"' after it.
_NAMED = (r"(?:(?:this|the) [a-z]+ (?:is|are) )?(?:licensed|released|distributed|published|available|provided) under "
          r"(?:the )?(?:terms of )?(?:the |an? )?").replace(" ", r"[ \n]")
_NAME = rf"(?:{_any(NAMES)})"
#: What may follow the name: the words 'the "License"', and where to look for it.
_TAIL = r"(?: the license)?(?: see (?:the )?(?:license|copying|[a-z0-9. ]{1,60} for (?:details|more information))[a-z0-9. ]{0,80})?"
_TAG = r"spdx license identifier "


def _spaced(pattern: str) -> str:
    """The pattern with a line end for any of its spaces."""
    return re.sub(r"(?<!\[)(?<!\. ) (?!\]|\{)", r"[ \\n]", pattern)


#: A known or naming sentence, a tag, or a heading that is a licence's name: a run of whole pieces, so a sentence may be wrapped anywhere.
KNOWN = (rf"(?m)^(?:{_any(SENTENCES)}|{'|'.join(_spaced(x) for x in SLOTTED)}|{_NAMED}{_NAME}{_spaced(_TAIL)}|{_spaced(_TAG)}(?:{_any(TAGS)})"
         rf"|(?:the[ \n])?{_NAME}(?:[ \n]mit)?)$")


def identify(sentence: Column) -> Column:
    """The identifier of a sentence that ``KNOWN`` found, its line ends made spaces."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    name = F.coalesce(F.try_element_at(named, F.regexp_extract(sentence, rf"^{_NAMED}({_NAME}){_TAIL}$", 1)),
                      F.try_element_at(tags, F.regexp_extract(sentence, f"^{_TAG}(.+)$", 1)),
                      F.try_element_at(named, F.regexp_extract(sentence, rf"^(?:the )?({_NAME})(?: mit)?$", 1)))
    slots = [F.when(sentence.rlike(f"^{pattern}$"), x) for pattern, x in SLOTTED.items()]
    return F.coalesce(F.try_element_at(known, sentence), *slots, F.concat(F.lit("named:"), name))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_sentences, sentences, licences, n_unmatched``.

    ``sentences`` are the known identifiers in order (joined by a space), ``licences`` the distinct licences the rules found
    in code-point order (joined by a space), ``n_unmatched`` the identifiers no rule took. Null, empty and other texts
    without a known sentence have 0 and empty text. Rows are independent, so ties and repeats do not matter.
    """
    text = F.col(text_col)
    found = F.when(text.rlike(CUES), F.transform(F.regexp_extract_all(pieces(text), F.lit(KNOWN), F.lit(0)), lambda s: identify(F.translate(s, "\n", " "))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    marked = rows.withColumn("left", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    # Each rule in turn: note the licence if its run is there, and take the run out (a bar keeps the rest apart).
    rules = F.array(*[F.struct(F.lit("".join(f"<{x}>" for x in run)).alias("mark"), F.lit(name).alias("licence")) for run, name in RULES])
    start = F.struct(F.col("left"), F.array().cast("array<string>").alias("got"))
    state = F.aggregate(rules, start, lambda s, r: F.struct(
        F.replace(s["left"], r["mark"], F.lit("|")).alias("left"),
        F.when(F.contains(s["left"], r["mark"]), F.concat(s["got"], F.array(r["licence"]))).otherwise(s["got"]).alias("got")))
    ruled = marked.withColumn("state", F.when(F.col("left") != "", state))
    return ruled.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentences"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("state.got")), " "), F.lit("")).alias("licences"),
        F.coalesce(F.regexp_count("state.left", F.lit("<")), F.lit(0)).cast("long").alias("n_unmatched"))


def oracle_sql() -> str:
    """The same scan in SQL, from the same tables of sentences, names and rules, for sentences that stand in one line.

    It does not join wrapped lines and does not know the wider forms of naming sentences.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda table: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in table.items())
    steps = []
    for n, (run, licence) in enumerate(RULES):
        mark = quote("".join(f"<{x}>" for x in run))
        steps.append(f"r{n + 1} AS (SELECT doc_id, replace(marks, {mark}, '|') AS marks, CASE WHEN contains(marks, {mark}) "
                     f"THEN list_append(got, {quote(licence)}) ELSE got END AS got FROM r{n})")
    slots = " ".join(f"WHEN regexp_full_match(norm.s, {quote(pattern)}) THEN {quote(x)}" for pattern, x in SLOTTED.items())
    return rf"""
WITH known(s, id) AS (VALUES {pairs(SENTENCES)}), named(s, id) AS (VALUES {pairs(NAMES)}), tagged(s, id) AS (VALUES {pairs(TAGS)}),
cut AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', E'\\1\n', 'g'), '[\r\n]+')) AS s,
               generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', E'\\1\n', 'g'), '[\r\n]+'), 1) AS i FROM documents),
low AS (SELECT doc_id, i, regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+', ' ', 'g') AS s FROM cut),
norm AS (SELECT doc_id, i, trim(replace(regexp_replace(regexp_replace(s, '\.([^0-9]|$)', '\1', 'g'), '(^|[^0-9])\.', '\1', 'g'), 'licence', 'license')) AS s FROM low),
ids AS (SELECT * FROM (SELECT doc_id, i, coalesce(k.id, CASE {slots} END, 'named:' || coalesce(n.id, t.id, g.id)) AS id FROM norm LEFT JOIN known k ON k.s = norm.s
        LEFT JOIN named n ON n.s = regexp_replace(regexp_extract(norm.s, '{NAMING}', 1), '{_TAIL}$', '')
        LEFT JOIN tagged t ON t.s = regexp_extract(norm.s, '^{_TAG}(.+)$', 1)
        LEFT JOIN named g ON g.s = regexp_extract(norm.s, '^(?:the )?(.+?)(?: mit)?$', 1)) WHERE id IS NOT NULL),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS sentences, string_agg('<' || id || '>', '' ORDER BY i) AS marks FROM ids GROUP BY doc_id),
r0 AS (SELECT doc_id, marks, []::VARCHAR[] AS got FROM seq), {", ".join(steps)}
SELECT d.doc_id, coalesce(q.n, 0)::BIGINT AS n_sentences, coalesce(q.sentences, '') AS sentences,
       coalesce(array_to_string(list_sort(list_distinct(r.got)), ' '), '') AS licences,
       coalesce(len(r.marks) - len(replace(r.marks, '<', '')), 0)::BIGINT AS n_unmatched
FROM documents d LEFT JOIN seq q ON q.doc_id = d.doc_id LEFT JOIN r{len(RULES)} r ON r.doc_id = d.doc_id"""
