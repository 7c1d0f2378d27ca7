import re

import pytest

from graphloom.llm import near_dup, queries
from graphloom.llm.minhash import odd_sketch, samples, shingles
from tests.llm.cases import SF, documents, frame
from tests.oracle import both


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute(rows, n, percent):
    s = sets(rows, n)
    ids = sorted(s)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_against_all_pairs(spark, monkeypatch, chunk):
    """Also with groups dealt over many chunks."""
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    want = brute([(r.doc_id, r.text) for r in documents(spark).collect()], 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_near_dup(spark, SF).collect()}
    assert got == want


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    (cols, ours), (names, theirs) = both(spark, sf, queries.op1_near_dup, queries.ORACLE_SQL["op1_near_dup"])
    assert cols == names and ours == theirs


def test_chain_and_large_group(spark):
    """A chain of texts, each near the next alone, is one group; so is a crowd around one text."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([*base[k * 8 :], *(f"v{j}" for j in range(k * 8))]) for k in range(6)]
    crowd = [" ".join([*(f"u{i}" for i in range(60)), f"own{j}"]) for j in range(80)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(chain + crowd)]
    want = brute([(r[0], r[1]) for r in rows], 2, 80)
    got = {r.id: (r.n, r.component) for r in near_dup.groups(frame(spark, rows), shingle=2).collect()}
    assert got == want


def test_awkward_rows(spark):
    d = frame(spark)
    got = {(r.id, r.n, r.component) for r in near_dup.groups(d, shingle=2).collect()}
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5][1] == by[6][1] == 5 and by[8][1] == by[9][1] == 8
    kept = near_dup.keep_one(d)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id or -1 for r in kept.collect()))
    assert ids == [-1, 1, 2, 3, 4, 5, 8, 10]
    assert near_dup.keep_one(d.limit(0)).count() == 0


def test_rows_without_or_with_shared_ids(spark):
    """Texts under one id, or none, are documents of their own: they link, and one row of each group stays."""
    w = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*w, f"own{k}"])
    other = lambda k: " ".join([*(f"o{i}" for i in range(60)), f"own{k}"])
    hi, lo = 2**63 - 1, -(2**63) + 1
    ids = [(None, near(0)), (None, near(1)), (None, near(1)), (7, near(2)), (None, "alone here"), (9, other(0)), (9, other(1)), (9, "quite another text"), (hi, other(2)), (lo, "far down"), (hi, "far down"), (3, None), (3, "")]
    rows = [(i, t, "en", "a", 0) for i, t in ids]
    got = {(r.id, r.n, r.component) for r in near_dup.groups(frame(spark, rows), shingle=2).collect()}
    none = near_dup.NO_ID
    assert got == {(none, 60, none), (7, 60, none), (none, 1, none), (9, 60, 9), (9, 2, 9), (hi, 60, 9), (lo, 1, lo), (hi, 1, lo), (3, 0, 3)}
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(frame(spark, rows), shingle=2).collect()]
    firsts = {(None, near(0)), (None, near(1))}
    assert len([x for x in kept if x in firsts]) == 1 and len([x for x in kept if x in {(9, other(0)), (9, other(1))}]) == 1
    assert len(kept) == len(set(kept)) == 7
    assert {(None, "alone here"), (9, "quite another text"), (lo, "far down"), (3, None), (3, "")} <= set(kept)


def test_sketches_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(1000))
    for changed in (0, 20, 60):
        b = " ".join(f"w{i}" if i >= changed else f"x{i}" for i in range(1000))
        x, y = shingles(a, 1), shingles(b, 1)
        true = (1000 - changed) / (1000 + changed)
        k = near_dup.BANDS * near_dup.ROWS
        sk = [__import__("numpy").frombuffer(odd_sketch(samples(s, k), near_dup.BITS), "u8") for s in (x, y)]
        assert abs(float(near_dup.similar(sk[0], sk[1])) - true) < 0.12
