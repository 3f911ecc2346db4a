import os
import re

import duckdb

from botlog.llm import licenses as L
from botlog.llm.license_texts import KNOWN, _MIT


def test_lookup(spark, docs_of):
    other = ("Copyright (c) 1999 Somebody\n# (C) 2001 Else. All rights reserved.\n\n" + _MIT.upper().replace("\n", "  \r\n ")
             .replace('"', "“").replace("COPYRIGHT HOLDERS", "copyright owners").replace("SUBLICENSE", "sub-licence"))
    rows = [(1, _MIT), (2, other), (3, _MIT + " Added."), (4, None), (5, ""), (6, "...\n—"), (None, "Released under the MIT Licence"),
            (7, "x " * 200_000), (8, "Copyright 2020 me\n"), (1, _MIT)]
    got = sorted([(r.doc_id, r.license_id) for r in L.license_lookup(docs_of(rows, extra=True)).collect()], key=str)
    assert got == sorted([(1, "MIT"), (1, "MIT"), (2, "MIT"), (None, "MIT")] + [(i, None) for i in (3, 4, 5, 6, 7, 8)], key=str)
    mine = spark.createDataFrame([("b", "My  TEXT!"), ("a", "my text"), ("c", "")], "license_id string, text string")
    assert [r.license_id for r in L.license_lookup(docs_of([(1, "MY text.")]), mine).collect()] == ["a"]
    assert L.license_lookup(docs_of(rows).limit(0)).count() == 0
    assert [r.license_id for r in L.license_lookup(docs_of([(1, _MIT)]), mine.limit(0)).collect()] == [None]


def test_every_known_text_finds_itself(docs_of):
    got = L.license_lookup(docs_of(list(enumerate(t for _, t in KNOWN)))).collect()
    assert {r.doc_id: r.license_id for r in got} == {i: k for i, (k, _) in enumerate(KNOWN)}


def test_native(docs_of):
    plan = L.license_lookup(docs_of([(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|Cartesian|NestedLoop", plan)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(L.SQL).fetchall()) == sorted(tuple(r) for r in L.op6_license_scan(spark, sf).collect())
    odd = [(1, "ÉA licence\n \t© x\ny İß ſ K"), (2, "copyright a\ncopyright b\n\ncopyright c"), (3, "a\r\n(c) b\r\nwhilst whilst fulfil 1.2²")]
    con.execute("drop view documents")
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", odd)
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert sorted(con.execute(L.SQL).fetchall()) == sorted(tuple(r) for r in L.license_lookup(df).collect())


ZLIB = """Copyright (c) 2019 Daniel "Lokathor" Gee.

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""


def test_full_texts_are_known_and_notices_labelled(spark, docs_of):
    rows, want = [(1, ZLIB), (2, UNLICENSE.upper()), (3, ZLIB + " More.")], {1: "Zlib", 2: "Unlicense", 3: None}
    for k, (name, i) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"),
                                   ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]):
        path = f"/usr/share/common-licenses/{name}"
        if os.path.exists(path):
            with open(path, encoding="utf8") as f:
                rows.append((10 + k, f.read()))
            want[10 + k] = i
    assert {r.doc_id: r.license_id for r in L.license_lookup(docs_of(rows)).collect()} == want
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {i: found for i, _, found in con.execute(L.SQL).fetchall()} == want  # the oracle knows the full texts too
    kinds = {(r.license_id, r.kind) for r in L.known_table(spark).collect()}
    assert {("Apache-2.0", "notice"), ("GPL-3.0", "notice"), ("CC-BY-NC-4.0", "notice"), ("MIT", "notice"), ("MIT", "text")} <= kinds
