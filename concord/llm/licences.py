"""Licence scans: sentences to identifiers, identifier sequences to licences.

A text is read twice, without the comment marks at both ends of its lines: by line, and by paragraph,
where wrapped lines are joined.  Either reading is cut into sentences, each is normalised to
lower-case letters and digits, and known licence sentences give identifiers.  The identifiers found,
in order, are matched against rules from the most specific to the least: a rule holds if its sequence
occurs without a gap among the recognised sentences, and it uses them up, so that a weaker rule does
not fire on the same ones.  A document has the licences of both readings.  "All rights reserved" alone
counts only where no licence is stated.

Known sentences are public notices run through the same cutting and normalising, so what the tables
hold is what a text with the notice yields.  All of it is expressions over one row; the tables are
constants of the program, so no join and no shuffle is needed.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_of

_WS = r"[\x20\x09-\x0D]"
_FRONT, _BACK = r"^[\x20\x09\x0D#*/;%!<>|-]+", r"[\x20\x09\x0D#*/%<>|-]+"
#: A sentence is over after one of these behind two characters or more, or after a colon that ends a line.
_CUT = rf"([^\x20\x09-\x0D]{{2}}[.!?;]){_WS}+|(:)[\x20\x09\x0D]*\n"

#: Sentences of public licences and of their notices.
_GPL_HOPE = (
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_3_OLD = "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
_MIT_0 = _MIT[0].replace(", subject to the following conditions:", ".")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = (
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented;",
)
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
_POSTGRES = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
_APACHE = (
    "you may not use this file except in compliance with the License.",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
)
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which is available at https://www.eclipse.org/legal/epl-{0}"
_CDDL = 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'
_OFL = "This Font Software is licensed under the SIL Open Font License, Version 1.1."


def _gnu(what: str, name: str, version: str, comma: bool = False) -> list[tuple[str, ...]]:
    """The notice of a GNU licence: with semicolons, or with a colon and commas as later ones have it."""
    older = (f"This {what} is free software;", f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation;", f"either version {version} of the License, or (at your option) any later version.")
    newer = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",)
    alone = (f"This {what} is free software;", f"you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation")
    hope = tuple(x.format(what) for x in _GPL_HOPE)
    return [(*older, *hope), older, (*newer, *hope), newer, (*alone, *hope), alone]


#: Licences by their full text or customary notice, the most specific first: what a rule's sentences state.
_TEXTS: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-4-Clause", (*_BSD[:3], _BSD_ADVERT)),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", (*_BSD[:3], _BSD_3_OLD)),
    ("BSD-2-Clause", _BSD[:3]),
    ("BSD", _BSD[:1]),
    ("MIT", _MIT),
    ("MIT-0", (_MIT_0,)),
    ("ISC", (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("0BSD", (f"{_ISC}.",)),
    ("Zlib", _ZLIB),
    ("BSL-1.0", (_BOOST,)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("PostgreSQL", (_POSTGRES,)),
    ("Apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License");', *_APACHE)),
    ("Apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License");',)),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", ("Apache License Version 2.0, January 2004",)),
    *((f"{short}-{version}", seq) for what, name, short, version in (
        ("program", "Affero General Public License", "AGPL", "3"), ("library", "Lesser General Public License", "LGPL", "2.1"), ("library", "Lesser General Public License", "LGPL", "3"),
        ("program", "Lesser General Public License", "LGPL", "3"), ("program", "General Public License", "GPL", "2"), ("program", "General Public License", "GPL", "3"),
    ) for seq in _gnu(what, name, version)),
    *((f"{short}-{version}", (f"GNU {name} Version {version}, {date}",)) for short, name, version, date in (
        ("AGPL", "AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007"), ("GPL", "GENERAL PUBLIC LICENSE", "3", "29 June 2007"), ("GPL", "GENERAL PUBLIC LICENSE", "2", "June 1991"),
        ("LGPL", "LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007"), ("LGPL", "LESSER GENERAL PUBLIC LICENSE", "2.1", "February 1999"),
    )),
    *((f"{short}-{version}", (f"This work is licensed under the GNU {name}, version {version}.",)) for short, name, version in (
        ("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3"), ("AGPL", "Affero General Public License", "3"),
    )),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("MPL-1.1", ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",)),
    ("EPL-2.0", (_EPL.format("2.0") + "/",)),
    ("EPL-1.0", ("All rights reserved.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html")),
    ("EPL-1.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("CDDL-1.0", (_CDDL,)),
    ("EUPL-1.2", ("Licensed under the EUPL, Version 1.2 or – as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",)),
    ("EUPL-1.2", ("Licensed under the EUPL-1.2 or later",)),
    ("OFL-1.1", (_OFL,)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("WTFPL", ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",)),
    ("Artistic-2.0", ("The Artistic License 2.0",)),
    ("CC0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)),
    ("CC0-1.0", ("Released under CC0 1.0.",)),
]
#: Creative Commons licences by code and words.
_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _code, _words in _COMMONS.items():
    _TEXTS += [(f"CC-{_code}-4.0", (x,)) for x in (f"Licensed under CC {_code} 4.0.", f"This work is licensed under CC {_code} 4.0.", f"This work is licensed under a Creative Commons {_words} 4.0 International License.")]
#: Licences by the name that short notices and titles give them.
_NAMED = {
    "MIT": "MIT", "BSD": "BSD", "BSD 2-Clause": "BSD-2-Clause", "BSD 3-Clause": "BSD-3-Clause", "ISC": "ISC", "zlib": "Zlib", "Apache 2.0": "Apache-2.0",
    "Apache-2.0": "Apache-2.0", "GPLv2": "GPL-2", "GPLv3": "GPL-3", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPLv3": "LGPL-3", "AGPLv3": "AGPL-3", "MPL 2.0": "MPL-2.0", "Unlicense": "Unlicense",
}
for _name, _licence in _NAMED.items():
    _TEXTS += [(_licence, (x,)) for x in (f"Released under the {_name} license.", f"Licensed under the {_name} license.", f"Distributed under the {_name} license.", f"This project is licensed under the {_name} license.")]
_TEXTS += [("MIT", (x,)) for x in ("MIT License", "The MIT License", "The MIT License (MIT)")]
#: Identifiers that a line in a source file states, and what they say.
_STATED = {
    **{x: x for x in ("MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "PostgreSQL", "Apache-2.0", "MPL-2.0", "MPL-1.1", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.2", "OFL-1.1", "Unlicense", "WTFPL", "Artistic-2.0", "CC0-1.0")},
    **{f"CC-{x}-4.0": f"CC-{x}-4.0" for x in _COMMONS},
    **{f"{x}-{v}{end}": f"{x}-{n}" for x, v, n in (("GPL", "2.0", "2"), ("GPL", "3.0", "3"), ("LGPL", "2.1", "2.1"), ("LGPL", "3.0", "3"), ("AGPL", "3.0", "3")) for end in ("", "-only", "-or-later")},
}
_TEXTS += [(v, (f"SPDX-License-Identifier: {k}",)) for k, v in _STATED.items()]
_TEXTS.append(("Proprietary", ("All rights reserved.",)))
#: The licence that any other one overrides.
WEAK = "Proprietary"


def _plain(sentence: str) -> str:
    """A sentence as lower-case words of ASCII letters and digits, without a number or letter before it."""
    words = re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(ascii_uppercase, ascii_lowercase))).strip(" ")
    return re.sub("^([0-9]+|[a-z]) ", "", words)


def _named(licence: str) -> str:
    """GNU licences by their usual name with a minor version."""
    return licence + ".0" if re.fullmatch("A?L?GPL-[23]", licence) else licence


def _pieces(sentences: tuple[str, ...]) -> list[str]:
    """What the scan makes of sentences that stand in lines of their own."""
    cut = re.sub(_CUT, lambda m: (m[1] or m[2]) + "\x01", "".join(f"{x}\n" for x in sentences))
    return [x for x in map(_plain, re.split("\x01|\n", cut)) if x]


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifier of every known sentence, after the least specific licence that has it, and the rules as licences and sequences of identifiers."""
    known: dict[str, str] = {}
    for licence, sentences in reversed(_TEXTS):
        for piece in _pieces(sentences):
            known.setdefault(piece, f"{_named(licence)}:{sum(v.startswith(_named(licence) + ':') for v in known.values()) + 1}")
    return known, list(dict.fromkeys((_named(licence), tuple(known[x] for x in _pieces(sentences))) for licence, sentences in _TEXTS))


SENTENCES, RULES = _tables()
#: Every known sentence holds one of these as part of a single word, and normalising changes no word of ASCII
#: letters but its case, so a text without any of them has no known sentence and is not cut up.
_ANCHORS = ("licen", "permi", "redistribut", "copyright", "warrant", "reserved", "misrepresented", "cc0", "advertising", "unencumbered", "software", "eupl")
HINT = "(?i)" + "|".join(_ANCHORS)
if _missed := [x for x in SENTENCES if not any(a in x for a in _ANCHORS)]:
    raise ValueError(f"no anchor in {_missed}")


def _sequence(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _identifiers(parts: Column) -> Column:
    """Identifiers of the known sentences in lines or paragraphs, in order."""
    known = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in SENTENCES.items()) + ")")
    words = lambda x: F.trim(F.regexp_replace(F.translate(x, ascii_uppercase, ascii_lowercase), "[^a-z0-9]+", " "))
    plain = lambda x: F.regexp_replace(words(x), "^([0-9]+|[a-z]) ", "")
    pieces = F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(p, _CUT, "$1$2\x01"), "\x01")))
    return F.array_compact(F.transform(pieces, lambda x: F.try_element_at(known, plain(x))))


def _stated(ids: Column) -> Column:
    """Licences that the rules find among identifiers, in order; each uses up its sentences."""
    rules = F.expr("array(" + ", ".join(f"named_struct('seq', '{_sequence(seq)}', 'name', '{name}')" for name, seq in RULES) + ")")
    marked = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    start = F.struct(marked.alias("s"), F.array().cast("array<string>").alias("found"))

    def step(held, rule):
        hit = held["s"].contains(rule["seq"])
        found = F.when(hit, F.array_append(held["found"], rule["name"])).otherwise(held["found"])
        return F.struct(F.replace(held["s"], rule["seq"], F.lit("<>")).alias("s"), found.alias("found"))

    return F.aggregate(rules, start, step)["found"]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_sentences`` recognised, their ``sequence`` and the ``licences``, one row per document.

    The sequence is that of the reading with more known sentences, of equal ones that by line; the
    licences are those of both.  Licences are sorted and joined by a blank; both strings are empty if
    nothing was recognised.  Null and empty texts have nothing; ids may be null or repeat; other
    columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    none = F.array().cast("array<string>")
    hinted = F.col("t").rlike(HINT)
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.regexp_replace(x, _FRONT + "|" + _BACK + r"\z", ""))
    rows = rows.select("id", F.when(hinted, lines).otherwise(none).alias("lines"))
    readings = F.array("lines", F.split(F.array_join("lines", "\n"), "\n\n+"))
    cut = rows.select("id", F.transform(readings, _identifiers).alias("ids"))
    found = F.array_distinct(F.flatten(F.transform(F.filter("ids", lambda x: F.size(x) > 0), _stated)))
    more = F.when(F.size(F.get("ids", F.lit(1))) > F.size(F.get("ids", F.lit(0))), F.get("ids", F.lit(1))).otherwise(F.get("ids", F.lit(0)))
    cut = cut.select("id", more.alias("ids"), found.alias("found"))
    strong = F.when(F.size("found") > 1, F.array_remove("found", WEAK)).otherwise(F.col("found"))
    return cut.select("id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "|").alias("sequence"), F.array_join(F.array_sort(strong), " ").alias("licences"))


def scan_sql() -> str:
    """The scan over ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"('{sentence}', '{name}')" for sentence, name in SENTENCES.items())
    # What is left of the sequence, a mark, and the licences so far go through the rules as one string.
    rules = ", ".join(f"'{_sequence(seq)}~{name}'" for name, seq in RULES)
    left, rule = "split_part(a, '~', 1)", "split_part(x, '~', 1)"
    step = f"replace({left}, {rule}, '<>') || '~' || split_part(a, '~', 2) || CASE WHEN contains({left}, {rule}) THEN split_part(x, '~', 2) || '|' ELSE '' END"
    return rf"""
        WITH known(sentence, name) AS (VALUES {known}),
        line AS (
            SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_FRONT}|{_BACK}\z', '', 'g')) AS l FROM documents
        ), part AS (
            SELECT doc_id, 0 AS way, unnest(l) AS x, unnest(range(len(l))) AS n FROM line
            UNION ALL
            SELECT doc_id, 1 AS way, unnest(p) AS x, unnest(range(len(p))) AS n FROM (SELECT doc_id, regexp_split_to_array(array_to_string(l, chr(10)), '\n\n+') AS p FROM line)
        ), piece AS (
            SELECT doc_id, way, n, unnest(p) AS x, unnest(range(len(p))) AS m
            FROM (SELECT *, string_split(regexp_replace(x, '{_CUT}', '\1\2' || chr(1), 'g'), chr(1)) AS p FROM part)
        ), plain AS (
            SELECT doc_id, way, n, m, regexp_replace(trim(regexp_replace(translate(x, '{ascii_uppercase}', '{ascii_lowercase}'), '[^a-z0-9]+', ' ', 'g')), '^([0-9]+|[a-z]) ', '') AS sentence FROM piece
        ), seq AS (
            SELECT doc_id, way, count(*) AS k, string_agg(name, '|' ORDER BY n, m) AS sequence FROM plain JOIN known USING (sentence) GROUP BY doc_id, way
        ), step AS (
            SELECT doc_id, way, k, sequence, string_split(rtrim(split_part(list_reduce(['<' || replace(sequence, '|', '><') || '>~', {rules}], lambda a, x: {step}), '~', 2), '|'), '|') AS names FROM seq
        ), found AS (
            SELECT doc_id, arg_max(sequence, k * 2 + 1 - way) AS sequence, max(k) AS k, list_distinct(list_filter(flatten(list(names)), lambda y: y <> '')) AS names
            FROM step GROUP BY doc_id
        )
        SELECT doc_id, coalesce(k, 0)::BIGINT AS n_sentences, coalesce(sequence, '') AS sequence,
               coalesce(array_to_string(list_sort(CASE WHEN len(names) > 1 THEN list_filter(names, lambda y: y <> '{WEAK}') ELSE names END), ' '), '') AS licences
        FROM documents LEFT JOIN found USING (doc_id)
    """
