import time

from tallyweave.llm import license_rules as lr
from tests.llm.helpers import awkward, docs, same_as_sql

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"


def found(df):
    return sorted((r["doc_id"], r["rule"]) for r in lr.licences(df).collect())


def test_sentences_in_order(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0."),
        (2, "Header.\n" + MIT),
        (3, "Released under the MIT License.\n" + MIT + "More prose."),
        (4, "\n".join(bsd)),
        (5, "\n".join([bsd[0], "Between them. ", bsd[1], bsd[2]])),
        (6, "\n".join(bsd[::-1])),
        (7, "LICENSED UNDER CC BY-NC 4.0!\nAll rights reserved."),
        (8, "this is not licensed under the apache license version 2 0 in any way"),
        (9, "All rights reserved. All rights reserved."),
    ]
    assert found(docs(spark, rows)) == [(1, "apache_short"), (2, "mit_text"), (3, "mit_titled"), (4, "bsd_2"), (5, "bsd_2"), (7, "cc_by_nc"), (7, "reserved"), (9, "reserved")]


def test_awkward(spark):
    assert found(awkward(spark)) == [] and found(docs(spark, [])) == []
    text = "Released under the MIT License."
    assert found(docs(spark, [(1, text), (1, text), (None, text), (2, "x " * 60_000 + "\n" + text)])) == [(1, "mit_short"), (2, "mit_short")]


def test_each_sentence_has_a_trigger():
    assert all(any(t in s for t in lr.TRIGGERS) for s in lr.SENTENCES)
    assert {i for _, _, ids in lr.RULES for i in ids} == set(lr.SENTENCES.values())


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GNU = """This {what} is free software{stop} you can redistribute it and/or
modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation{comma} either
version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Copyright (c) 2019, The Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL SOMEBODY PAY.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
WILD = {
    "apache_header_whole": APACHE,
    "gpl3_header": GNU.format(what="program", stop=":", kind="", comma=",", version="3"),
    "gpl2_header_whole": GNU.format(what="program", stop=";", kind="", comma=";", version="2"),
    "lgpl21_header": GNU.format(what="library", stop=";", kind="Lesser ", comma=";", version="2.1"),
    "lgpl3_header": GNU.format(what="library", stop=":", kind="Lesser ", comma=",", version="3"),
    "agpl3_header": GNU.format(what="program", stop=":", kind="Affero ", comma=",", version="3"),
    "mpl2": MPL,
    "bsd_2_whole": BSD.format(third=""),
    "bsd_3_whole": BSD.format(third=THIRD),
    "isc": ISC,
    "mit_text": MIT,
}
STYLES = {
    "plain": lambda t: t,
    "hash": lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()),
    "star": lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\n",
    "slashes": lambda t: "".join(f"//  {x}".rstrip() + "\n" for x in t.splitlines()),
    "indented": lambda t: "".join(f"    {x}".rstrip() + "\n" for x in t.splitlines()),
    "dos": lambda t: t.replace("\n", "\r\n"),
}


def plainly(text):
    """The rules a text meets, by walking over it character by character: another way to the same definition."""
    ways = []
    for by_line in (True, False):
        sentences, now, k = [], "", 0
        while k < len(text):
            c = text[k]
            j = k + 1
            while c in ".!?;:" and j < len(text) and text[j] in ".!?;:":
                j += 1
            end = False
            if c in ".!?;:":
                m = j
                while m < len(text) and text[m] in "\"')]}":
                    m += 1
                end = m < len(text) and text[m] in " \t\r\n\f"
            elif c == "\n" and by_line:
                end = not (j < len(text) and "a" <= text[j] <= "z")
            elif c == "\n":
                line = text[j:].partition("\n")
                end = bool(line[1]) and not any(x.isascii() and x.isalnum() for x in line[0])
            if end:
                sentences.append(now)
                now = ""
            else:
                now += text[k:j] if c not in ".!?;:" else c
            k = j
        seq = [lr.SENTENCES[n] for x in [*sentences, now] if (n := " ".join("".join(y if y.isascii() and y.isalnum() else " " for y in x.lower()).split())) in lr.SENTENCES]
        ways.append(seq)

    def holds(ids, seq):
        rest = iter(seq)
        return all(i in rest for i in ids)

    met = {name: ids for name, _, ids in lr.RULES if any(holds(ids, w) for w in ways)}
    return {n for n, ids in met.items() if not any(o != n and len(more) > len(ids) and holds(ids, more) for o, more in met.items())}


def test_standard_headers_in_all_sorts_of_comments(spark):
    rows, want = [], []
    for k, (rule, text) in enumerate(WILD.items()):
        for j, (style, comment) in enumerate(STYLES.items()):
            rows.append((100 * k + j, "Some prose before.\n\n" + comment(text) + "\nint main();\n"))
            want.append((100 * k + j, rule))
    got = [(d, r) for d, r in found(docs(spark, rows)) if r != "reserved"]
    assert got == want
    assert {(d, r) for d, t in rows for r in plainly(t)} == set(found(docs(spark, rows)))


def test_whole_query_by_another_way(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], rule) for r in texts for rule in plainly(r["text"])}
    assert {(r["doc_id"], r["rule"]) for r in lr.op9_licence_rules(spark, folder).collect()} == want and want
    assert same_as_sql(spark, "op9_licence_rules")


def test_time_in_proportion(spark):
    tail = "\nReleased under the MIT License."
    rows = [(1, "." * 1_000_000 + tail), (2, "\n" * 1_000_000 + tail), (3, "licence\n" + " " * 1_000_000 + tail), (4, '."' * 400_000 + tail)]
    began = time.perf_counter()
    assert [d for d, _ in found(docs(spark, rows))] == [1, 2, 3, 4] and time.perf_counter() - began < 60
