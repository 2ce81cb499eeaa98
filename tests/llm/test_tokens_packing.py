"""Token counts and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cairnframe.llm import packing, tokens
from cairnframe.llm.queries import pack_documents, pattern, vocabulary

ODD = ["", " ", "a <|endoftext|>b<|startoftext|> <|endoftext|>", "ΣΑΣ Σ İi̇ é it's I'LL", "12345 ,.;!!", "\x1c a\x1db c　d \t\n\r\x0b  x", "x" * 3000, "a  b   c\n\n d ", " \xa0 \xa0\xa0d", "ＡＢ ﬁ ǅ 漢字ß\U0001f600"]


def samples():
    rnd, pool = random.Random(3), "aZ éÉ'sΣ.1 \n\t<|>endoftext́ 漢字ß\U0001f600\xa0"
    return ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 80))) for _ in range(1500)]


def test_counts_equal_library():
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), tokens.Counter(vocabulary("word_bpe_49k.json"), remember=50)
    for text in samples():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_ids_equal_library():
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Encoder(vocabulary("byte_bpe_50k.json"), pattern(), remember=50)
    for text in samples():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "hello world", "y"), (None, "a " * 3000, "z")], "doc_id long, text string, n_tokens string")
    got = tokens.token_counts(df, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == [(0, 6000, 3000, True), (1, 0, 0, False), (1, 0, 0, False), (2, 11, 2, False)]
    assert tokens.token_counts(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_packing_is_a_partition(spark, n):
    rnd = random.Random(n)
    rows = [(k, " ".join(rnd.choice(["the", "cat", "zxqv", "é"]) for _ in range(rnd.choice([0, 1, 5, 300, 900, 2600])))) for k in range(80)] + [(80, None), (81, ""), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    got = pack_documents(df).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    sequences, seen = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        assert r["doc_tokens"] in map(len, ids[r["doc_id"]])
        assert r["ids_crc32"] in [zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in ids[r["doc_id"]]]
    for k, pieces in seen.items():
        assert sum(x for _, x in pieces) == sum(map(len, ids[k]))
    assert set(seen) == set(ids)
    partial = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        partial += at < 1024
    assert partial <= n  # one window of a task at most


@pytest.mark.parametrize("most", [5, 1000])
def test_sum_of_squares_choice(most):
    """The level chosen has the smallest sum of squares of all that are possible."""
    rnd = random.Random(5)
    levels = packing.SumOfSquares(32, most)
    cuts = 0
    for _ in range(800):
        size = rnd.randint(1, 31)
        before = levels.count.copy()

        def cost(h, size=size, before=before):
            n = before.copy()
            n[h] -= h > 0
            n[h + size if h + size <= 32 else h + size - 32] += 1
            return int((n[1:32] ** 2).sum())

        options = [0] * int(before[1:32].sum() < most) + [h for h in range(1, 33 - size) if before[h] > 0]
        cut = not options
        options = options or [h for h in range(33 - size, 32) if before[h] > 0]
        got = levels.place(size)
        cuts += cut
        assert len(got) == 1 + cut and sum(n for _, _, n in got) == size
        assert cost(got[0][1]) == min(map(cost, options))
        assert all(len(levels.open[h]) == levels.count[h] for h in range(1, 32))
        assert levels.opened == levels.count[1:32].sum() <= most
    assert (cuts > 10) == (most == 5) and cuts * (most - 5) == 0


def test_placement_closes_windows():
    """Of the tokens that placement handles, 95 % stand in windows it closes by itself."""
    rnd = random.Random(6)
    levels, total = packing.SumOfSquares(1024), 0
    for _ in range(2000):
        size = int(rnd.lognormvariate(6, 1)) % 1024 or 1
        total += size
        levels.place(size)
    assert sum(h * n for h, n in enumerate(levels.count.tolist()) if h < 1024) < 0.05 * total


def test_packing_odd_rows(spark):
    """Clashing column names, null ids, an empty table."""
    df = spark.createDataFrame([(None, "a b", 1, 2, 3), (None, "a b", 1, 2, 3), (4, None, 1, 2, 3)], "doc_id long, text string, start int, length int, sequence_id int")
    got = pack_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"]) == [(4, 0, 1, 1)]
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 6
    assert pack_documents(df.limit(0)).count() == 0


def test_tokens_of_every_code_point():
    """Counts equal the library's for every code point of the first two planes, alone, between letters, and before 's."""
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), tokens.Counter(vocabulary("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 2000):
        texts = [t for c in points[k : k + 2000] for t in (c, f"x{c}y 1{c}2", f"a{c}'s")]
        assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_slices_give_free_memory_back(monkeypatch):
    import pyarrow as pa

    from cairnframe.llm import _kernel as K

    said = []
    monkeypatch.setattr(K, "give_back", lambda: said.append(len(said)))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in ([], ["a b", None, "c" * 30])]
    assert [r for b in K.slices(iter(batches), size=8) for r in b.column(0).to_pylist()] == ["a b", None, "c" * 30]
    assert len(said) == 2
