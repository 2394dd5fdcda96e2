import re
import textwrap
import time

from graywether.llm import licences
from graywether.llm.queries import QUERIES

from .fixtures import clashing, empty

GRANT = next(s for s, i in licences.SENTENCES.items() if i == "mit-grant")


def brute(text):
    ids = []
    for part in re.split(r"\n|[.!?;:](?=[ \t\r])", text or ""):
        s = re.sub(r"[\W_]+", " ", part.lower()).strip()
        if s in licences.SENTENCES:
            ids.append(licences.SENTENCES[s])
    found = set()
    for name, _, rule in licences.RULES:
        rest = iter(ids)
        if all(x in rest for x in rule):
            found.add(name)
    if "BSD-3-Clause" in found:
        found.discard("BSD-2-Clause")
    return ids, ",".join(sorted(found))


def texts():
    by_id = {}
    for s, i in licences.SENTENCES.items():
        by_id.setdefault(i, s)
    full = [". \n".join(by_id[i].upper() for i in rule) + "." for _, _, rule in licences.RULES]
    mit = ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]
    apart = ". Other words stand here. ".join(by_id[i] for i in mit)
    backwards = ". ".join(by_id[i] for i in reversed(mit)) + ". "
    return [*full, apart, backwards, "Released under the (MIT) License!", "x" * 50_000, "MIT License\n" + GRANT, "all rights reserved"]


def test_rules_against_brute_force(spark, sf_dir):
    rows = [(i, t) for i, t in enumerate(texts())]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, spark.read.parquet(f"{sf_dir}/documents.parquet"), clashing(spark, "licences", "sentence_ids")):
        for r in licences.scan(df).collect():
            ids, names = brute(r.text)
            assert (r.sentence_ids, r.licences) == (ids, names), r.text[:200]
            assert r.n_sentences == len(ids) and r.n_licences == len([x for x in names.split(",") if x])
    found = {r.doc_id: r.licences for r in licences.scan(made).collect()}
    n = len(licences.RULES)
    assert found[n] == "MIT" and found[n + 1] == "" and found[n + 2] == "MIT" and found[n + 4] == "MIT"


def test_query_and_empty(spark, sf_dir):
    assert QUERIES["op5_licences"](spark, sf_dir).where("n_licences > 0").count() > 0
    assert licences.scan(empty(spark)).count() == 0


def test_wrapped_texts(spark):
    by_id = {}
    for s, i in licences.SENTENCES.items():
        by_id.setdefault(i, s)
    rows, want = [], {}
    for name, _, rule in licences.RULES:
        whole = ". ".join(by_id[i].capitalize() for i in rule) + "."
        lines = textwrap.wrap("Copyright of the holder. " + whole, 72)
        for mark, end in (("", "\n"), (" * ", "\r\n"), ("# ", "\n")):
            want[len(rows)] = name
            rows.append((len(rows), end.join(mark + x for x in lines)))
    want[len(rows)] = "MIT"
    rows.append((len(rows), "MIT License\nCopyright of the holder\n" + textwrap.fill(GRANT, 72)))
    want[len(rows)] = "Apache-2.0"
    rows.append((len(rows), "     Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/"))
    apart = len(rows)
    rows += [(apart, "released under the mit\n\nlicense"), (apart + 1, "released under the mit.\nlicense"), (apart + 2, "Released under the mit | license")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in want.items():
        assert name in got[i].licences.split(","), rows[i]
    assert got[len(want) - 1].sentence_ids == ["apache-title", "apache-2.0-title"]
    assert [got[apart + k].licences for k in range(3)] == ["", "", "MIT"]


#: Notices and texts as they are distributed.
REAL = {
    "MIT": """MIT License

Copyright (c) 2020 Some Holder

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
""",
    "ISC": """Copyright (c) 2020 Some Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
""",
    "BSD-2-Clause": """Copyright 2020 Some Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "LGPL-2.1-or-later": """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details.
""",
    "GPL-2.0-or-later": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
}


def test_texts_as_distributed(spark):
    rows = [(name, "Words before it.\n\n" + text + "\nand after it") for name, text in REAL.items()]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: name for name in REAL}


def test_ten_thousand_hits_in_one_text(spark):
    parts = [s for s, i in licences.SENTENCES.items() if i in ("bsd-grant", "bsd-source", "bsd-binary")]
    rows = [(1, ". ".join(parts * 3400) + "."), (2, ". ".join(reversed(parts * 3400)) + ".")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    licences.scan(df.limit(1)).collect()
    start = time.perf_counter()
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licences.scan(df).select("doc_id", "n_sentences", "licences").collect()}
    assert got == {1: (10_200, "BSD-2-Clause"), 2: (10_200, "BSD-2-Clause")} and time.perf_counter() - start < 10
