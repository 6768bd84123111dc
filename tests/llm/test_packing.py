import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ionquill.llm import packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def optimum(items, capacity):
    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        rest = left[:-1]
        best = len(left)

        def fill(start, room, others, gone):
            nonlocal best
            best = min(best, 1 + least(tuple(x for k, x in enumerate(rest) if k not in gone)))
            last = None
            for k in range(start, len(rest)):
                if rest[k] <= room and rest[k] != last:
                    last = rest[k]
                    fill(k + 1, room - rest[k], others, gone | {k})

        fill(0, capacity - left[-1], (), frozenset())
        return best

    return least(tuple(sorted(items)))


def contents(patterns):
    out = Counter()
    for pattern, times in patterns:
        for size, each in pattern:
            out[size] += each * times
    return out


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 17, 30])
    items = [rnd.randint(rnd.choice([1, 3, 5]), capacity) for _ in range(rnd.randint(1, 9))]
    fixed, left = packing.reduce_by_dominance(Counter(items), capacity)
    assert contents(fixed) + Counter(left) == Counter(items)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(items, capacity)


def plain_best_fit(items, capacity):
    rooms = []
    for size in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - size)
        else:
            rooms.append(capacity - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_equals_the_plain_one(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 400))]
    patterns = packing.best_fit(Counter(items), 100)
    assert contents(patterns) == Counter(items)
    assert sum(n for _, n in patterns) == plain_best_fit(items, 100)
    assert all(sum(s * n for s, n in p) <= 100 for p, _ in patterns)


def test_many_equal_items_stay_few_patterns():
    counts = {s: 10**9 + s for s in range(1, 1025)}
    patterns = packing.plan(counts, 1024)
    assert contents(patterns) == Counter(counts) and len(patterns) < 20000
    # no two items of over half the capacity share a sequence
    bound = sum(n for s, n in counts.items() if s > 512) + -(-counts[512] // 2)
    assert sum(n for _, n in patterns) == bound


def checked(rows, texts, capacity, end_id=2):
    tok = Tokenizer.from_file(JSON)
    docs = defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        got = sorted(docs.pop(doc_id), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(got):
            assert (r["piece"], r["start"]) == (k, at)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == capacity or (k == 0 and 0 < r["length"] < capacity)
            at += r["length"]
        assert at == len(ids)
    assert not docs
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packs_documents(spark):
    rnd = random.Random(3)
    texts = {k: " ".join(rnd.choice(["alpha", "beta!", "Größe", "x"]) for _ in range(rnd.choice([1, 3, 30, 200, 900]))) for k in range(80)}
    texts |= {100: None, 101: "", 102: "a <|endoftext|> b", 103: "word " * 5000}
    docs = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], "doc_id long, text string, length int, shard string").repartition(6)
    for ranks in (RANKS, None):
        rows = packing.pack(docs, JSON, 128, ranks_path=ranks, pattern=P.PATTERN, shards=5).collect()
        n = checked(rows, texts, 128)
        assert n == -(-sum(r["length"] for r in rows) // 128)


def test_repeated_rows_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, JSON, 8, shards=2).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 4, 4] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.pack(docs.limit(0), JSON, 8).count() == 0


def test_rank_file_gives_the_tokenizer_s_ids():
    quick, whole = packing._tokenizer(JSON, RANKS, P.PATTERN), packing._tokenizer(JSON, None, None)
    for text in ["", " ", "a\r\n\n  b", "Größe ÀB c\xa0d 12345", "日本語 テスト", "don't <|endoftext|>x", "a" * 500, "\x00\x1f퟿", "🙂🙂 !!$$$"]:
        assert quick(text).tolist() == whole(text).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_rank_file_gives_the_tokenizer_s_ids_on_any_text(seed):
    quick, whole = packing._tokenizer(JSON, RANKS, P.PATTERN), packing._tokenizer(JSON, None, None)
    rnd = random.Random(seed)
    parts = ["a", "The", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "9", "1234", "é", "é", "ß", "中文", "の", "🙂", "👩‍👧", " ", " ", "\u0000", "_", "...", "ﬁ", "İ", "नमस्ते"]
    for _ in range(500):
        text = "".join(rnd.choice(parts) if rnd.random() < 0.8 else chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(rnd.randrange(60)))
        assert quick(text).tolist() == whole(text).tolist(), repr(text)
