import random

import numpy as np
import pytest
import tiktoken

from postgrain.llm import encode as bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_random_texts(ranks, public):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "23", ".", "!!", "'s", "'", "日本", " ", "\x1c", "<|endoftext|>", "​", "ab", "The", "\r\n", "é", "😀", "हिन्दी"]
    ts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    e = bpe.Encoder(ranks, keep=500)
    got = []
    for k in range(0, len(ts), 700):
        got += split(*e.batch(ts[k : k + 700]))
    assert got == [public.encode_ordinary(t) for t in ts]


def test_scan_and_heap_agree(ranks):
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 120))).encode()
        assert bpe.merge_scan(w, ranks) == bpe.merge_heap(w, ranks)


def test_very_long_word(ranks, public):
    w = "".join(random.Random(3).choice("abcdefgh") for _ in range(100_000))
    assert bpe.Encoder(ranks).plain(w) == public.encode_ordinary(w)


def test_rows(spark, public):
    rows = [(1, None, [9]), (2, "", None), (3, " ", [1]), (4, "Hello  <|endoftext|> world \n", None), (4, "Hello  <|endoftext|> world \n", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode(df, key="doc_id", text="text").collect())
    assert got == sorted((k, public.encode_ordinary(t) if t else []) for k, t, _ in rows)
    assert bpe.encode(df.where("false"), key="doc_id", text="text").count() == 0


def test_round_trip_of_the_corpus(spark, data, ranks):
    from postgrain.session import table

    back = {v: k for k, v in ranks.items()}
    d = table(spark, data, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in bpe.encode(d, key="doc_id", text="text").collect():
        assert b"".join(back[i] for i in r["ids"]).decode() == texts[r["doc_id"]]
