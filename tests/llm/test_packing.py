"""Packing: ids against the tokenizer itself, plans against their rules, sequences against the documents."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import packing
from veriloom.llm.queries import tokenizer_file

WHOLE = {}


def encoded(text):
    if not WHOLE:
        from tokenizers import Tokenizer

        WHOLE[0] = Tokenizer.from_file(tokenizer_file())
    return WHOLE[0].encode(text or "", add_special_tokens=False).ids


ODD = ["<|endoftext|>. a<|endoftext|>b'S don't  x́ 가\x85 \x1c İ ΑΣ.\r\nΑΣ  'll 3.5, a.b. ...", "", " ", "\n\n", "a b.", "ﬁ ½ 1st,", "क़लम é é fin.", "x" * 300 + ". Y", "ab.*** cd%%%\n é,&& <|endoftext|>** a*'s* b''. c#|> d**é a.*.", "İ*** ﬁ!! ½&&"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_chunks_are_those_of_the_text(text):
    assert b"".join(packing.ChunkIds(tokenizer_file()).windows(text)) == np.array(encoded(text), "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBz .,*&'\n\t\r!é́İΣσ1½<|>endoftxt— 가"), max_size=60))
def test_ids_of_any_text(text):
    assert b"".join(packing.ChunkIds.of_worker(tokenizer_file()).windows(text)) == np.array(encoded(text), "<u4").tobytes()


def test_old_chunks_are_dropped_and_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "WINDOW", 5)
    ids, text = packing.ChunkIds(tokenizer_file()), "one two three four five six one two nine, one"
    assert b"".join(ids.windows(text)) == np.array(encoded(text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 20), max_size=12))
def test_every_piece_has_a_place_and_no_pack_overflows(histogram):
    patterns = packing.shortest_first(histogram, 32)
    assert all(sum(p) <= 32 and n > 0 for p, n in patterns)
    placed = {}
    for pattern, n in patterns:
        for length in pattern:
            placed[length] = placed.get(length, 0) + n
    assert placed == {k: n for k, n in histogram.items() if n}
    # packs are begun one at a time, so two that hold half or less would have been one
    assert sum(n for p, n in patterns if 2 * sum(p) <= 32) <= 1


def test_shortest_pack_first_by_hand():
    # 6 and 6 begin packs; 4 goes to one of them, 4 to the other; 3, 3 and 3 begin a third, as nothing else holds them; 1 joins the emptiest
    assert packing.shortest_first({6: 2, 4: 2, 3: 3, 1: 1}, 10) == [((3, 3, 3, 1), 1), ((6, 4), 2)]


DOCS = [(1, "one two three. " * 9), (1, "one two three. " * 9), (2, None), (None, ""), (3, "Ωμέγα " * 40), (4, "a"), (5, "w " * 200)]


def test_sequences_hold_all_ids_once(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in DOCS], "doc_id long, text string, length string, start int")
    rows = packing.pack(docs, tokenizer_file(), 64).collect()
    wanted = []
    for own, text in DOCS:
        ids = np.array([*encoded(text), packing.END], "<u4")
        wanted += [(own, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()), len(ids)) for at in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == sorted(wanted, key=str)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(by_sequence) <= -(-sum(w[2] for w in wanted) // 64) + 1
    whole = {r.sequence_id: r for r in packing.sequences(docs, tokenizer_file(), 64).collect()}
    assert sum(r.used for r in whole.values()) == sum(w[2] for w in wanted)
    found = []
    for r in whole.values():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == (r.used if r.used & (r.used - 1) == 0 else 64) and sum(r.lengths) == r.used
        found += [p.tobytes() for p in np.split(ids[: r.used], np.cumsum(r.lengths)[:-1])]
    assert sorted(map(zlib.crc32, found)) == sorted(w[3] for w in wanted)


def test_one_length_for_most_pieces_and_an_empty_table(spark):
    docs = spark.range(3000).selectExpr("cast(id as string) doc_id", "if(id % 3 = 0, 'more words than these', cast(null as string)) text")
    rows = packing.pack(docs, tokenizer_file(), 16).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert max(r.sequence_id for r in rows) + 1 == -(-sum(r.length for r in rows) // 16)
    assert packing.pack(docs.limit(0), tokenizer_file()).collect() == [] and packing.sequences(docs.limit(0), tokenizer_file()).collect() == []
