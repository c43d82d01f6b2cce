import random
import time

import pytest

from foliant.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train()


KEYS = [
    "a1b2c3d4" * 8, "f0" * 32, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", "wJ4lrXUtnF3MI/K7MDENG+bPxRf1CYzzAQLe8KEYwJ4lrXUtnF3MI/K7MDENG",
    "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c",
]


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("frame", ["token = {}", "password: {} end", 'secret="{}".', "and the key {} is to be kept"])
def test_keys_beyond_48_characters(field, key, frame):
    text = frame.format(key)
    found = [text[a:b] for k, a, b in pii.find(text, field)[1] if pii.KINDS[k] == "secret"]
    assert found == [key], (text, found)
    assert key[:12] not in pii.redacted(text, pii.find(text, field)[1]) and key[-12:] not in pii.redacted(text, pii.find(text, field)[1])


def test_random_long_keys_and_long_words(field):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(r.choice(letters) for _ in range(r.randint(49, 400))) for _ in range(200)]
    whole = sum([text[a:b] for _, a, b in pii.find(text, field)[1]] == [key] for key in keys for text in (f"token {key} end",))
    assert whole >= 190
    # a path or a word without end is none, and bars nothing after it
    for plain in ("usr/local/share/documents/of/the/year/and/many/more/words/in/a/row", "la" * 60):
        text = f"see {plain} and call (988) 555-2485"
        assert [text[a:b] for _, a, b in pii.find(text, field)[1]] == ["(988) 555-2485"]


def test_very_long_texts_take_linear_time(field):
    for text in ("a" * 2_000_000, ("a" * 150 + "1") * 8_000, ("x1" * 500_000), "b" * 1_000_000 + "7" + "b" * 1_000_000, ("word " * 30 + "42 ") * 6_000):
        began = time.perf_counter()
        pii.find(text, field)
        assert time.perf_counter() - began < 60
