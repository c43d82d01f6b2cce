"""The digests of the longer licences, made anew from texts that the system has; a licence whose text it lacks is skipped."""

import hashlib
import re
import textwrap
from pathlib import Path

import pytest

from foliant.llm import licenses

TEXTS = Path("/usr/share/common-licenses")
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3",
    "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def digest(text):
    return hashlib.sha256(licenses.canonical_text(text).encode()).hexdigest()


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n\s*\n", text))


def test_every_digest_has_a_text():
    assert {name for name, _ in licenses.DIGESTS} == set(FILES)


@pytest.mark.parametrize("name, want", licenses.DIGESTS)
def test_digests(spark, name, want):
    if not (TEXTS / FILES[name]).exists():
        pytest.skip("no such text on this system")
    text = (TEXTS / FILES[name]).read_text()
    assert digest(text) == want
    shapes = [text, text.replace("\n", "\r\n"), text.upper() if "ß" not in text else text, "Copyright (c) 2024 Somebody\n\n" + text, text + "\n\n\n"]
    frame = spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(frame).collect()}
    assert {k: v for k, v in found.items() if v != name} == {}
    assert set(found) == set(range(len(shapes)))


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "MPL-2.0"])
@pytest.mark.parametrize("width", [60, 72, 100, 10_000])
def test_other_wrappings(name, width):
    if not (TEXTS / FILES[name]).exists():
        pytest.skip("no such text on this system")
    assert digest(wrapped((TEXTS / FILES[name]).read_text(), width)) == dict(licenses.DIGESTS)[name]
