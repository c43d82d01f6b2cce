import random

import pytest

from foliant.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_numbers_across_region_borders(field):
    """A directory of some 30,000 characters: every number is found as it is alone, wherever it lies."""
    r = random.Random(6)
    text, want = "", []
    for k in range(900):
        text += "".join(r.choice("abcdefg") for _ in range(r.randint(3, 12))) + " "
        want.append((3, len(text), len(text) + 14))
        text += f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}\n"
    base, spans = pii.find(text, field)
    assert not base and spans == want


def test_blocks_change_nothing(field):
    text = " ".join(t for t, _ in pii.examples(60, 17))
    assert field.best_in(text, 0, len(text)) == field.best(pii.Region(text, 0, len(text), field.number))


def test_addresses_of_many_tokens(field):
    for address in ("name [at] host [dot] co [dot] uk", "joe [at] mail [dot] site [dot] com"):
        text = f"write to {address} for more"
        assert [text[a:b] for _, a, b in pii.find(text, field)[1]] == [address]
        assert address not in pii.redacted(text, pii.find(text, field)[1])
