import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILES[0])


def test_ids_are_those_of_the_tokenizer(whole):
    rng = random.Random(1)
    bpe, plain = packing.ByteBPE(*FILES), packing.ByteBPE(FILES[0])
    texts = ["".join(rng.choice("ab'sStrevmld 12²½\n\t\r\x85\xa0\x1c!?.,éßÀǅªº$_-<|endoftext|>") for _ in range(120)) for _ in range(500)]
    texts += ["", "  a", "\n\n x", "<|endoftext|> a", "日本 x", "a" * 3000, "it's we'll I've", "x \n"]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert bpe.ids(t).tolist() == want == plain.ids(t).tolist()


def check(rows, docs, whole, limit=1024):
    """Each id lies in exactly one piece; sequences have no gap and keep within the limit."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i] += [(at, len(x := ids[at : at + limit]), zlib.crc32(x.tobytes()), len(ids)) for at in range(0, len(ids), limit)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_odd_rows(spark, odd, odd_rows, none, whole):
    rows = packing.pack_documents(odd, *FILES).collect()
    check(rows, [r[:2] for r in odd_rows], whole)
    assert packing.pack_documents(none, *FILES).count() == 0


def test_ranks_over_many_buckets(spark):
    rng = random.Random(6)
    rows = [(i, 0, rng.choice([300, 300, 300, 512, 700, 20]), i, 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    sizes = Counter(r[2] for r in rows)
    lengths = spark.createDataFrame([(k, n, [(0, n, 0, 0)]) for k, n in sizes.items()], "length bigint, total bigint, places array<struct<lo:bigint,n:bigint,first:bigint,offset:bigint>>")
    got = packing.ranked(frame, lengths, bucket_rows=7).collect()
    for length, n in Counter(r[2] for r in rows).items():
        assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(n))
    seq = defaultdict(int)
    for r in packing.pack(frame, bucket_rows=7).collect():
        seq[r.sequence_id] += r.length
    assert max(seq.values()) <= 1024 and len(seq) <= 1.05 * sum(r[2] for r in rows) / 1024 + 3


def test_patterns_hold_the_histogram():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 1024): rng.randint(1, 10_000) for _ in range(rng.randint(1, 300))}
        found = packing.patterns(histogram)
        held = Counter()
        for pattern, n in found:
            assert sum(pattern) <= 1024
            for length in pattern:
                held[length] += n
        assert held == Counter(histogram)
    assert packing.patterns({}) == []
