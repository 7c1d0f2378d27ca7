import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing, queries, token_counts
from graphloom.llm.tokenizer import default_path, encoder
from tests.llm.cases import ROWS, SF, documents, frame


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute_pieces(t, text, cap=1024):
    ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    first = (len(ids) - 1) % cap + 1
    cuts = [(0, first), *((s, cap) for s in range(first, len(ids), cap))]
    return [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]


def placed(rows):
    """Every sequence is gapless from 0 and no longer than 1024."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    return len(by)


def test_pieces_and_places(spark, plain):
    rows = queries.op9_sequence_packing(spark, SF).collect()
    want = {(r.doc_id, *p) for r in documents(spark).collect() for p in brute_pieces(plain, r.text)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = placed(rows)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_batches_pack_as_well(spark):
    """With far more pieces than a batch the plan stays valid and close to full."""
    r = np.random.default_rng(3)
    lengths = r.integers(1, 1024, 5000).tolist()
    p = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(p, batch=500).collect()
    assert len(rows) == 5000
    assert placed(rows) <= sum(lengths) / 1024 * 1.06 + 2


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squared counts of open bins by gap is smallest."""
    counts = np.zeros(1025, np.int64)
    for s, n in ((700, 3), (400, 5), (300, 4), (24, 6)):
        counts[s] = n
    slots, bins = packing.sum_of_squares(counts)
    gaps = []
    for s in (700, 400, 300, 24):
        for b, at in slots[s].tolist():
            if b == len(gaps):
                assert all(g < s for g in gaps) and at == 0
                gaps.append(1024 - s)
                continue
            open_ = np.bincount([g for g in gaps if g], minlength=1025)
            cost = {}
            for g in {g for g in gaps if g >= s}:
                c = open_.copy()
                c[g] -= 1
                if g > s:
                    c[g - s] += 1
                cost[g] = int((c[1:1024] ** 2).sum())
            assert gaps[b] == 1024 - at and cost[gaps[b]] == min(cost.values())
            gaps[b] -= s
    assert len(gaps) == bins


def test_awkward_rows(spark, plain):
    d = frame(spark)
    rows = packing.pack(packing.pieces(d)).collect()
    want = sorted((-1 if i is None else i, *p) for i, t, *_ in ROWS for p in brute_pieces(plain, t))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    placed(rows)
    assert packing.pack(packing.pieces(d.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> I'll don't\tx  \n\n y", "٣٤ ½ Ⅷ 一二 👩‍👩‍👧", "a\x1cb\x85c d　e f", "x" * 3000 + " " * 500 + "!" * 200, ""])
def test_encoder_is_the_tokenizer(plain, text):
    assert encoder(default_path()).ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(spark, plain, rule):
    """Tokens of each line by the tokenizer's own offsets, in bytes."""
    got = defaultdict(list)
    for r in token_counts.section_tokens(documents(spark).where("doc_id < 60"), rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.start, r.end, r.n_tokens))
    enc = encoder(default_path())
    for r in documents(spark).where("doc_id < 60").collect():
        ids = plain.encode(r.text, add_special_tokens=False).ids
        stops = np.cumsum([enc.byte_lengths[i] for i in ids])
        starts = stops - [enc.byte_lengths[i] for i in ids]
        at = {"first": starts, "middle": (starts + stops - 1) // 2, "last": stops - 1}[rule]
        assert stops[-1] == len(r.text.encode())
        want, pos = [], 0
        for line in r.text.split("\n"):
            end = min(pos + len(line) + 1, len(r.text))
            a, b = len(r.text[:pos].encode()), len(r.text[:end].encode())
            want.append((pos, end, int(((at >= a) & (at < b)).sum())))
            pos = end
        assert got[r.doc_id] == want and sum(n for *_, n in want) == len(ids)


def test_given_sections_and_awkward_rows(spark, plain):
    d = spark.createDataFrame([(1, "abc def ghi", [(0, 3), (3, 8), (0, 11), (5, 5), (8, 99)]), (2, None, [(0, 4)]), (3, "x", None), (None, "🙂 b", [(0, 1), (1, 3)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = sorted((r.doc_id, r.section, r.start, r.end, r.n_tokens) for r in token_counts.section_tokens(d, sections="parts").collect())
    by = {(a, b): (s, e, n) for a, b, s, e, n in rows}
    assert by[1, 0] == (0, 3, 1) and by[1, 2][2] == len(plain.encode("abc def ghi", add_special_tokens=False).ids) and by[1, 3][2] == 0 and by[1, 4][1] == 11 and by[2, 0] == (0, 0, 0)
    assert not any(a == 3 for a, _ in by) and len(by) == 8
    assert token_counts.section_tokens(frame(spark)).count() > 0 and token_counts.section_tokens(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(d, "nearest")
