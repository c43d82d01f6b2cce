import pyarrow as pa
from hypothesis import given, settings, strategies as st

from foliant.llm import tokenfiles

from .test_operators import BPE

END = "<|endoftext|>"
PARTS = st.lists(st.sampled_from([END, END, "<|endoftext|", "|>", "<", " ", "  ", "\n", "\t", "a", "The", "é", "漢", "'s", "1", "!"]), max_size=20).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=6))
def test_added_tokens_are_one_id_as_in_the_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    ids, off = tokenfiles.token_ids(pa.array(texts), BPE)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_an_added_token_between_letters_and_across_rows():
    ids, off = tokenfiles.token_ids(pa.array([f"a{END}b", "<|endof", "text|>"]), BPE)
    assert ids[: off[1]].tolist() == [64, 50256, 65, 2] and 50256 not in ids[off[1] :]
