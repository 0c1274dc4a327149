"""Personal data, licences and archives against plain versions."""

import gzip
import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from pelagia.llm import licences, pii, warc
from pelagia.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL

duckdb = pytest.importorskip("duckdb")


# -- personal data -----------------------------------------------------------------------------

def naive(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_plain_spans_equal_the_patterns(spark):
    choose = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", " ", "4111 1111 1111 1111", "10.0.0.1", "256", "+49 30 1234567", "x@y.zz", "é", "1", "0" * 30, "\n", "+", "(0)"]
    texts = ["".join(choose.choices(parts, k=choose.randint(1, 25))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in texts:
        assert pii.plain_spans(text) == naive(text), text


DISGUISED = [
    ("call +49 five 151 six 234 seven 89 now", "phone", "+49 five 151 six 234 seven 89"), ("write john at example.com.", "email", "john at example.com"),
    ("mail j.doe at mail.example.org, thanks", "email", "j.doe at mail.example.org"),
    ("write to john dot smith at example dot com now", "email", "john dot smith at example dot com"),
    ("bob (at) mail [dot] org!", "email", "bob (at) mail [dot] org"), ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("user@​example.com", "email", "user@​example.com"), ("mail bob @ example.com today", "email", "bob @ example.com"),
    ("call plus four nine five one five zero one two three four", "phone", "plus four nine five one five zero one two three four"),
    ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"), ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("vier zwei vier zwei 4242 4242 vier zwei vier zwei", "card", "vier zwei vier zwei 4242 4242 vier zwei vier zwei"),
]


@pytest.mark.parametrize("text, kind, wanted", DISGUISED)
def test_disguised_spans_map_back(text, kind, wanted):
    found = pii.all_spans("é " + text)
    assert [(k, ("é " + text)[a:b], plain) for k, a, b, plain in found] == [(kind, wanted, False)]


@pytest.mark.parametrize("text", ["", "look at the cat. dot to dot", "meet me at example.com", "look at example.com", "it is available at www.example.com now", "at noon.today", "3 at a.b",  "un un un un un un un un un un un un un un", "at the dot of five", "абв 7 a@b", "one two three four five six"])
def test_clean_texts_stay_clean(text):
    assert pii.all_spans(text) == []


def test_spans_column(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc"), (3, "a@b.cc"), (None, "x at y dot org"), (4, "9" * 200_000 + "@" * 1000 + "a" * 100_000)]
    found = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", pii.listed(pii.spans("text")).alias("s")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, ""), (2, ""), (3, "email:0:6"), (3, "email:0:6"), (None, "email:0:14"), (4, "")], key=repr)


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = naive(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        assert tuple(r)[1:5] == tuple(sum(k == kind for k, _, _ in plain) for kind in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


# -- licences ----------------------------------------------------------------------------------

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software").

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'''


@pytest.mark.parametrize("text, name", [
    ("Words.\nReleased under CC BY 4.0.", "CC-BY-4.0"), ("The data is available under the MIT.", "MIT"), ("published under the GPL\nversion 3", "GPL-3.0"),
    ("This is free\nand  unencumbered\nsoftware released into the public domain", "Unlicense")])
def test_every_text_is_read_whatever_words_it_holds(text, name):
    assert [m[0] for m in licences.licences(text)[0]] == [name]


def test_rules_need_their_order_and_nearness():
    grant, notice, warranty = MIT.split("\n\n")
    names = lambda text: [(m[0], m[3]) for m in licences.licences(text)[0]]
    assert names(MIT) == [("MIT", ["mit-grant", "mit-notice", "mit-warranty"])]
    assert names("\n\n".join([notice, grant, warranty])) == [("MIT", ["mit-grant"])]
    assert names("\n\n".join([grant, *["Some words."] * 9, notice])) == [("MIT", ["mit-grant"])]
    assert names(f"{MIT}\n\n{MIT}") == [("MIT", ["mit-grant", "mit-notice", "mit-warranty"])] * 2


@pytest.mark.parametrize("sentence, name", [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0")])
def test_grants_are_found_as_often_as_they_stand(spark, sentence, name):
    stored = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts = [r.text for r in stored if not sentence.startswith("SPDX")] + [f"Words.\n{sentence}\nMore words.", sentence]
    assert sum(t.count(sentence) for t in texts) == sum(m[0] == name for t in texts for m in licences.licences(t)[0])
    found = licences.licences(f"Words.\n{sentence}\nMore")[0]
    assert [(m[0], m[1], m[2]) for m in found] == [(name, 7, 7 + len(sentence))]


APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_apache_header_is_found_whole(mark):
    text = "\n".join(mark + line for line in APACHE.split("\n"))
    assert [(m[0], m[3]) for m in licences.licences(text)[0]] == [("Apache-2.0", ["named:Apache-2.0", "apache-condition", "apache-place", "apache-warranty"])]


@pytest.mark.parametrize("sentence, name", [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"), ("Licensed under the GPL version 2 or any later version, see COPYING.", "GPL-2.0"),
    ("Published under MIT Press rules.", None), ("Licensed under the MIT License or the Apache License.", None), ("Licensed under the GNU General Public License version 2.1 text.", None)])
def test_names_end_at_a_word(sentence, name):
    assert [m[0] for m in licences.licences(sentence)[0]] == [name] * (name is not None)


def gpl(version):
    return [f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.""",
            """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""]


def wrapped(paragraphs, width, mark=""):
    lines = [textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in paragraphs]
    return "\n".join(mark + line for part in lines for line in [*part, ""])


@pytest.mark.parametrize("mark", ["", " * ", "# "])
@pytest.mark.parametrize("width", [20, 30, 40, 60, 72, 80, 1000])
def test_notices_at_any_width(width, mark):
    names = lambda text: [(m[0], m[3]) for m in licences.licences(text)[0]]
    assert licences.identified(wrapped(gpl(2), width, mark))[0][0][-1] == "gpl2-grant"
    assert licences.identified(wrapped(gpl(3), width, mark))[0][0][-1] == "gpl3-grant"
    assert names("This file is free\nof\nerrors and\nreleased\nunder\nthe terms\nof the\nMIT\nLicense.")[-1:] == [("MIT", ["named:MIT"])]


def test_standard_gpl2_notice():
    text = """This program is free software;
you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation;
either version 2 of the License, or
(at your option) any later version."""
    assert [(m[0], m[3]) for m in licences.licences(text)[0]] == [("GPL-2.0", ["gpl2-grant"])]


WHOLE_MIT = ["Copyright (c) 2020 Someone",
             """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
             (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
             publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
             subject to the following conditions:""",
             """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
             """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
             MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
             ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
             THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""]
WHOLE_BSD = ["Copyright (c) 2020, Someone. All rights reserved.",
             """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
             are met:""",
             """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
             """2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
             documentation and/or other materials provided with the distribution.""",
             """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
             this software without specific prior written permission.""",
             """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
             LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
@pytest.mark.parametrize("width", [20, 30, 40, 60, 72, 80, 1000])
def test_whole_licences_at_any_width(width, mark):
    found = lambda paragraphs: [(m[0], m[3]) for m in licences.licences(wrapped(paragraphs, width, mark))[0]]
    mit, bsd = ["mit-grant", "mit-notice", "mit-warranty"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]
    assert found(WHOLE_MIT) == [("MIT", mit)]
    assert found(WHOLE_BSD) == [("BSD-3-Clause", bsd)]
    assert found([p for p in WHOLE_BSD if not p.startswith("3.")]) == [("BSD-2-Clause", bsd[:3] + bsd[4:])]
    assert found(gpl(2)) == [("GPL-2.0", ["gpl2-grant", "gpl-warranty"])] and found(gpl(3)) == [("GPL-3.0", ["gpl3-grant", "gpl-warranty"])]
    assert found([*WHOLE_MIT[:2], *["Some words."] * 4, *WHOLE_MIT[2:]]) == [("MIT", mit[:1])]


def test_licence_column(spark):
    rows = [(1, None), (2, ""), (3, "A licence."), (None, MIT), (4, "word. " * 50_000)]
    found = {r.doc_id: r.s for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", licences.scan("text").alias("s")).collect()}
    assert {k: ([m.licence for m in v.matches], v.unknown) for k, v in found.items()} == {1: ([], 0), 2: ([], 0), 3: ([], 1), None: (["MIT"], 0), 4: ([], 0)}


# -- archives ----------------------------------------------------------------------------------

def record(i, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.digest_of(body)}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


RECORDS = [record(i, b"x" * 50 * i + b"\nWARC/1.1\r\nWARC-Type: fake\r\n") for i in range(6)]


def salvaged(data):
    items = list(warc.salvage(data))
    return [warc.page_of(x.headers["warc-record-id"]) for x in items if isinstance(x, warc.Record)], [(x.offset, x.end) for x in items if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", range(8))
def test_salvage_loses_only_the_damaged_record(packed, seed):
    choose = random.Random(seed)
    parts = [gzip.compress(r) for r in RECORDS] if packed else RECORDS
    data = b"".join(parts)
    assert salvaged(data) == (list(range(6)), [])
    hurt = choose.randrange(6)
    begin = sum(map(len, parts[:hurt]))
    at = begin + choose.randrange(len(parts[hurt]) - 60, len(parts[hurt]) - 12)  # in the body
    broken = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1:]
    found, gaps = salvaged(broken)
    assert found == [i for i in range(6) if i != hurt] and gaps == [(begin, begin + len(parts[hurt]))]


def test_salvage_of_junk_and_cut_files():
    data = b"".join(RECORDS)
    assert salvaged(data[:-30]) == ([0, 1, 2, 3, 4], [(sum(map(len, RECORDS[:5])), len(data) - 30)])
    mixed = b"junk\n" + RECORDS[1] + b"\x1f\x8b\x08junk" + gzip.compress(RECORDS[2] + RECORDS[3])
    assert salvaged(mixed)[0] == [1, 2, 3] and len(salvaged(mixed)[1]) == 2
    assert salvaged(b"") == ([], []) and salvaged(b"nothing") == ([], [(0, 7)])


def test_archives_equal_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    wanted = connection.sql(ORACLE["op8_warc"]).fetchall()
    found = QUERIES["op8_warc"](spark, SMALL).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_odd_pages(spark, least):
    rows = [(1, "http://a\r\nX: y", "same body"), (2, None, "same body"), (3, "u", None), (4, "u", ""), (None, "u", "same body"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(2))
    found = {r.page_id: r for r in warc.round_trip(pages, least).collect()}
    assert all(r.quarantined is None for r in found.values()) and len(found) == 7
    kinds = {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in found.items()}
    short = ("revisit", 4, 0) if least == 0 else ("response", None, 0)
    assert kinds == {1: ("revisit", 2, 9), 2: ("response", None, 9), None: ("revisit", 2, 9), 3: short, 4: ("response", None, 0), 5: ("response", None, len(rows[5][2].encode())), 6: ("response", None, 300_000)}
    assert bytes(found[5].payload).decode() == rows[5][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_gzip_members_take_linear_time():
    """Twice the members take about twice as long, damage included."""
    import random
    import time

    def archive(n):
        block = [random.Random(i).randbytes(6000) for i in range(n)]
        head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 6000\r\n\r\n"
        data = bytearray(b"".join(gzip.compress(head + b + b"\r\n\r\n", 1) for b in block))
        data[len(data) // 2] ^= 255
        return bytes(data)

    def seconds(n):
        data, best = archive(n), 9e9
        for _ in range(3):
            start = time.perf_counter()
            found = list(warc.salvage(data))
            best = min(best, time.perf_counter() - start)
        assert sum(isinstance(f, warc.Record) for f in found) == n - 1
        return best

    small, large = seconds(1000), seconds(8000)
    assert large < 24 * small and large < 5
