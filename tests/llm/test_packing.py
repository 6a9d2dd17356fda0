from __future__ import annotations

import collections
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pregao.llm import packing, queries

from .test_hilbert import save

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, out, capacity=4096):
    """Every piece once, cut only where it must be, and every sequence filled without gap or overlap."""
    expected = collections.Counter()
    for r in rows:
        ids = ids_of(r[1])
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            expected[(r[0], i, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_query_over_odd_texts(spark, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "Straße", "ÉTÉ", "don't", "x1y2", "🙂👍", "漢字かな", "áb", "́c", "ΣΑΣ", "<|endoftext|>", "a<|startoftext|>É<|endoftext|>", "<|ENDofTEXT|>", "x<|endoftext|", "...", "İi", "ﬁ"]
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", " ", " ", "\x85", "​"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 700))), "en", "s", 1) for i in range(50)]
    rows += [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (61, "", "en", "s", 0), (None, " \n", "en", "s", 2)]
    rows += [(70, "word " * 12_000, "en", "s", 1), (71, " ".join(["x"] * 4095), "en", "s", 1), (72, " ".join(["x"] * 4096), "en", "s", 1)]
    out = queries.op5_pattern_packing(spark, save(spark, tmp_path / "a", rows)).collect()
    total = sum(r["length"] for r in out)
    assert check(rows, out) <= -(-total // 4096) + 2
    assert queries.op5_pattern_packing(spark, save(spark, tmp_path / "b", [])).collect() == []


def test_query_on_documents(spark):
    out = queries.op5_pattern_packing(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert check(docs, out) <= 1.01 * sum(r["length"] for r in out) / 4096 + 1


def test_words_encode_alone_as_in_texts():
    rng = random.Random(3)
    tok = packing.tokenizer(PATH)
    chars = [chr(c) for c in itertools.chain(range(9, 0x250), range(0x300, 0x330), range(0x391, 0x3CA), range(0x2000, 0x2010), [0x3000, 0x1F600, 0xFEFF])]
    texts = ["".join(rng.choice(chars) for _ in range(200)) for _ in range(100)]
    flat, ends = packing.token_ids(tok, pa.array(texts))
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == ids_of(t)[:-1]


def used(sequences):
    total = collections.Counter()
    for lengths, n in sequences:
        for length in lengths:
            total[length] += n
    return total


def test_plans_use_up_the_histogram():
    rng = random.Random(6)
    for size, capacity in ((0, 64), (1, 64), (30, 64), (3000, 256), (200_000, 4096)):
        lengths = [min(capacity, max(1, int(rng.lognormvariate(0, 0.9) * capacity / 5))) for _ in range(size)]
        histogram = dict(collections.Counter(lengths))
        sequences = packing.plan(histogram, capacity)
        assert used(sequences) == collections.Counter(lengths)
        assert all(sum(s) <= capacity and n > 0 for s, n in sequences)
        count, least = sum(n for _, n in sequences), sum(lengths) / capacity
        assert size < 1000 or count <= least * 1.01 + 1, (count, least)
        table = packing.intervals(histogram, sequences)
        assert len(table) <= 24 * capacity
    hot = packing.plan({1000: 90_000, 7: 5, 4096: 3, 2049: 11})
    assert used(hot) == {1000: 90_000, 7: 5, 4096: 3, 2049: 11}


def test_repeats_are_least_squares():
    patterns = packing.bin_patterns(6)
    assert all(sum(p) in (6, 7) for p in patterns.tolist()) and len({tuple(p) for p in patterns.tolist()}) == len(patterns)
    histogram = np.array([0, 3, 5, 4, 2, 1, 7.0])
    x = packing.fit_repeats(patterns, histogram)
    assert x.min() >= 0
    matrix = np.stack([np.bincount(p, minlength=7) for p in patterns]).T[1:].astype(float)
    pull = matrix.T @ (histogram[1:] - matrix @ x)
    # Optimal: no pattern would lower the squares by more repeats, those in use not by fewer either.
    assert pull.max() < 1e-5 and np.abs(pull[x > 1e-9]).max() < 1e-5


def test_whole_sequences(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g"), (3, "h")], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, PATH, capacity=4, with_ids=True), capacity=4)
    whole = [i for r in packing.sequences(packed).collect() for i in r["ids"]]
    assert sorted(whole) == sorted(ids_of("a b c d e") + ids_of("f g") + ids_of("h"))
    assert all(len(r["ids"]) <= 4 for r in packing.sequences(packed).collect())


def test_ids_are_those_of_the_file(monkeypatch):
    """Control strings too, and whatever a process remembers."""
    texts = ["<|endoftext|> hi", "hi<|startoftext|>there", "<|ENDOFTEXT|>", "Don't<|endoftext|>'s", "a<|endoftext|>\u0301b É<|endoftext|>", "", " "]
    for known in (0, 3, 400_000):
        monkeypatch.setattr(packing, "KNOWN_PARTS", known)
        tok = packing.WordTokenizer(PATH)
        for _ in range(2):
            flat, ends = packing.token_ids(tok, pa.array(texts))
            assert [flat[a:b].tolist() for a, b in itertools.pairwise(ends)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_a_task_is_bounded_by_slices_of_text(monkeypatch):
    """Tokenizing 23 MB of text that come in one batch takes a few times a slice, not the batch."""

    class Stub:
        added = None

        def ids(self, parts):
            return [np.array([len(p)] * 2, np.uint32).tobytes() for p in parts]

    monkeypatch.setattr(packing, "tokenizer", lambda path: Stub())
    texts = ["some words of a text that is like others " * 80] * 7000
    batch = pa.record_batch([pa.array(range(7000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in packing._pieces(iter([batch]), "", 4096, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 7000 and peak < 80e6
