import textwrap

import pytest

from foliant.llm import licenses

ISC = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")
Copyright (c) 1995-2003 by Internet Software Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def test_published_isc(spark):
    docs = spark.createDataFrame([(1, ISC), (2, ISC.replace("Copyright (c) 1995-2003 by", "Copyright"))], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(1, "ISC"), (2, "ISC")}


def test_every_known_text_in_every_wrapping(spark):
    rows = [(name, wrapped(t, width)) for name, kind, t in licenses.KNOWN if kind == "text" for width in range(30, 101)]
    docs = spark.createDataFrame([(k, "Copyright 2020 The Authors\n\n" + t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]


@pytest.mark.parametrize("line", ["Copyright (c) 2020 A. Person", "# Copyright © me", "Copyright 1999", "copyright: The Authors", "Copyright The Authors", "Copyright by X", "© me", "(c) 1999", "(C) Copyright Y", "* Copyright me", "(c) A Firm, 2001", "Copyright (C) Notice Ltd", "Copyright Holdermann"])
def test_notices_are_dropped(line):
    assert licenses.canonical_text(f"one\n{line}\ntwo") == "one two"


@pytest.mark.parametrize("line", ["copyright notice and this", "copyright holders be liable", "COPYRIGHT HOLDER OR", "copyright, patent", "copyright", "copyright law.", "(c) You must retain, in the", "copyright license to reproduce", 'copyright" means'])
def test_body_lines_are_kept(line):
    assert licenses.canonical_text(f"one\n{line}\ntwo").count(" ") > 1
