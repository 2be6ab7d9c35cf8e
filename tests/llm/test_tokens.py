import functools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.llm import tokens

FILE = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab cdE.,'\n\t  12éя中　🙂"), st.characters(exclude_categories=("Cs",))), max_size=60)


@functools.cache
def both():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = tokens.read_ranks(f.read())
    return tokens.Encoder(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids(t):
    ours, theirs = both()
    assert ours.encode(t) == theirs.encode_ordinary(t) and ours.count(t) == len(ours.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_every_prefix_has_its_last_token(data):
    ours, _ = both()
    last = ours.extend(data, [])
    for n in range(1, len(data) + 1):
        assert ours.ids(data[:n], last[:n]) == ours._merge(data[:n])


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, TEXT, st.data())
def test_appends_and_edits(a, b, c, data):
    ours, theirs = both()
    s = tokens.PrefixState(ours).append(a).append(b)
    assert s.text == a + b and s.ids() == theirs.encode_ordinary(a + b)
    i = data.draw(st.integers(0, len(a + b)))
    j = data.draw(st.integers(i, len(a + b)))
    s.edit(i, j, c)
    want = (a + b)[:i] + c + (a + b)[j:]
    assert s.text == want and s.ids() == theirs.encode_ordinary(want)


def test_tables(spark):
    rows = [(1, "Hello <|endoftext|>", "x"), (2, "", "y"), (3, None, "z"), (1, "Hello <|endoftext|>", "x"), (4, "a" * 30_000, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    _, theirs = both()
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_table(df).collect())
    assert got == sorted((i, theirs.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokens.encode_table(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.count_table(df)
    n = {r.doc_id: r.k for r in tokens.count_table(df, out="k").collect()}
    assert n[2] == n[3] == 0 and n[4] == len(theirs.encode_ordinary("a" * 30_000))
