"""Licence scans on the standard texts of notices."""

import duckdb
import pytest

from concord.llm import licences

BSD = """Copyright (c) 2020 A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licences.scanned(docs).orderBy("id").collect()]


def test_licences_of_both_readings(spark):
    """A reserved-rights line is overridden by the licence beside it; alone it counts."""
    assert found(spark, [BSD, "All rights reserved.\n\nNothing else."]) == ["BSD", "Proprietary"]


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain.\n"
NOTICES = [
    ("MIT", "Released under the MIT License."), ("BSD", "Released under the BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Proprietary", "All rights\nreserved."),
]


def test_standard_texts(spark):
    cases = [("GPL-3.0", GPL), ("MPL-2.0", MPL), ("Apache-2.0", APACHE), ("MIT", MIT), ("Unlicense", UNLICENSE), ("BSD", BSD), *NOTICES]
    marked = [(name, "".join(f"{mark} {x}".rstrip() + "\n" for x in text.splitlines())) for name, text in cases for mark in ("#", "//", " *", ";;")]
    every = cases + marked
    assert found(spark, [t for _, t in every]) == [name for name, _ in every]
    assert found(spark, [MPL.replace("2.0. If", "1.1. If")]) == [""]


BSD3 = BSD + """
 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

 * Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
AGPL = GPL.replace("GNU General", "GNU Affero General")
MORE = [
    ("BSD-3-Clause", BSD3), ("BSD-2-Clause", BSD3[: BSD3.index(" * Neither")]), ("GPL-2.0", GPL2), ("GPL-2.0", GPL2[: GPL2.index("This program is dis")]), ("LGPL-2.1", LGPL),
    ("ISC", ISC), ("AGPL-3.0", AGPL), ("MIT", "MIT License\n\nCopyright (c) 2021 B. Ody\n\n" + MIT), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n"),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint x;"), ("MIT", "This  project is\tlicensed under the MIT-License!"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0 MIT", "Released under the MIT License.\n\n" + GPL), ("Proprietary", "All rights-reserved."),
    ("", "We sign a new license. All rights are reserved for the design of free software."),
]


def test_more_notices(spark):
    assert found(spark, [t for _, t in MORE]) == [name for name, _ in MORE]


def test_every_rule_fires_on_its_own_text(spark):
    assert len(licences.SENTENCES) >= 60 and len({x for x, _ in licences.RULES}) >= 25
    texts = licences._TEXTS
    blocks, lines = ["\n\n".join(x) for _, x in texts], ["# " + "\n# ".join(x) for _, x in texts]
    for got in (found(spark, blocks), found(spark, lines)):
        assert [g for g, (name, _) in zip(got, texts) if g != licences._named(name)] == []


@pytest.mark.parametrize("odd", ["", "\u212a \u0130 \u2028 \x85"])
def test_scan_equals_sql(spark, tmp_path, odd):
    texts = ["", None, "\n \n", "x"] + [f"{odd}{a}{odd}\r\n{b}" for _, a in MORE for b in ("", MPL, "/* All rights reserved. */")]
    texts += [mark + t.replace("\n", "\n" + mark) for _, t in MORE for mark in ("// ", "# ", " * ", "<!-- ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    theirs = con.sql(licences.scan_sql())
    cols = sorted(theirs.columns)
    ours = licences.scanned(docs).withColumnRenamed("id", "doc_id").select(cols).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs.select(*cols).fetchall())
