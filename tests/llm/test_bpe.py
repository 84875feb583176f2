import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidewatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_ranks(PATH)
    return bpe.RankEncoder(ranks, P.PATTERN, memory=500), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, dtype="<u4").tolist()


def test_equals_merging_by_rank(pair):
    mine, theirs = pair
    rng = random.Random(3)
    alphabet = "ab cdeEé ñ\n\t  .,'s'll!1２²½ß漢字　\xa0\x1c\x85😀_-​́ "
    tokens = list(mine.bytes_of.values())
    for i in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) if i % 2 else b"".join(rng.choice(tokens) for _ in range(rng.randrange(6))).decode("utf8", "ignore")
        assert ids(mine.encode(text)) == theirs.encode_ordinary(text), text
        assert mine.decode(mine.encode(text)) == text.encode()


def test_long_pieces(pair):
    mine, theirs = pair
    for text in ("a" * 20000, "ab" * 9000, " " * 5000 + "x", "aaab" * 5000, "lL" * 4001):
        assert ids(mine.encode(text)) == theirs.encode_ordinary(text)


def test_columns(spark):
    rows = [(1, None, "i"), (2, "", "i"), (3, "Hello  world. " * 3000, "i"), (3, "again", "i"), (None, "ü", "i")]
    coded = bpe.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN)
    back = bpe.decode_column(coded, PATH, P.PATTERN)
    assert sorted((bytes(r.data).decode(), r.doc_id) for r in back.collect() if r.doc_id) == sorted((t or "", i) for i, t, _ in rows if i)
    assert bpe.encode_column(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_repeated_rows_stay(spark):
    rows = [(1, "one and the same"), (1, "one and the same"), (1, "another"), (2, "one and the same")]
    coded = bpe.encode_column(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN)
    back = sorted((r.doc_id, bytes(r.data).decode()) for r in bpe.decode_column(coded, PATH, P.PATTERN).collect())
    assert back == sorted(rows)
