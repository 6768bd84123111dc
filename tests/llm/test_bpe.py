import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ionquill.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  a", "don't we'll", "Größe  ÀB c\xa0d 1234567", "日本語 テスト", "a" * 700, "ab" * 400, "\x00\x1f", "🙂🙂 !!$$$",
    "<|endoftext|>", "x" * 33 + " " + "y" * 32, "\t\t\tx = 1;", "é̂̃" * 20,
]


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def random_text(rnd):
    alphabet = "aeiounrstlhd" + "AEÄß é日🙂 .,'0123456789\n\t-_" + "   "
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300)))


def test_equals_the_library(coder, library):
    rnd = random.Random(5)
    for text in [t for t in TEXTS if t is not None] + [random_text(rnd) for _ in range(300)]:
        assert coder.encode(text) == library.encode_ordinary(text)
        assert coder.decode(coder.encode_texts([text])[0]).decode() == text


def test_one_piece_and_many_agree(coder):
    rnd = random.Random(6)
    pieces = [bytes(rnd.choice(b"thereandin g\xc3\xa4\xff") for _ in range(rnd.randint(0, bpe.SHORT))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(pieces)] == [coder.encode_piece(p) for p in pieces]


def test_forgetting_changes_nothing(library):
    small = bpe.BytePairs(bpe.read_ranks(PATH), P.PATTERN, kept=5)
    for text in ["one two three four five six seven", "six seven eight one two", "nine one"] * 2:
        assert small.encode(text) == library.encode_ordinary(text)


def test_documents(spark, library):
    rows = [(k, t, 0) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (None, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for k, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs.where("doc_id > 4"), PATH, P.PATTERN).collect()}
    assert ids == {k: library.encode_ordinary(t) for k, t, _ in rows if k is not None and k > 4}
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.BytePairs({b"a": 0}, P.PATTERN)
