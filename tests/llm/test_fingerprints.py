import hashlib
import re

from graphloom.llm import fingerprints, queries
from tests.llm.cases import ROWS, SF, documents, frame


def paragraphs(t):
    """Runs of up to three sentences of one line, long ones cut."""
    return set(re.findall(r"(?:[^.!?\n]{1,160}+[.!?]*+|[.!?]++){1,3}+", t))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(paragraphs(t), paragraphs(edited))) < 1e-12
        assert abs(r.near_next - like(paragraphs(t), paragraphs(nxt))) < 1e-12


def test_against_sets(spark, monkeypatch):
    """Also over many ranges of ids."""
    rows = [(r.doc_id, r.text or "") for r in documents(spark).collect()]
    for n in (4000, 20):
        monkeypatch.setattr(fingerprints, "NEIGHBOURS", n)
        got = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, SF).collect()}
        check(rows, got)
    by = {}
    for i, t in rows:
        assert by.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(paragraphs(t)) for _, t in rows})


def test_small_tables_are_tried_again(spark, monkeypatch):
    """With far too few cells, larger tables and in the end the plain comparison give the same digests."""
    monkeypatch.setattr(fingerprints, "ROOM", 0.05)
    monkeypatch.setattr(fingerprints, "LEAST", 1)
    check([(r.doc_id, r.text or "") for r in documents(spark).where("doc_id < 40").collect()], {r.doc_id: r for r in fingerprints.versions(documents(spark).where("doc_id < 40")).collect()})


def test_awkward_rows(spark):
    d = frame(spark)
    assert fingerprints.versions(d).count() == d.count()
    rows = [(i, t or "") for i, t, *_ in ROWS if i not in (5,)]
    check(rows, {r.doc_id: r for r in fingerprints.versions(frame(spark, [r for r in ROWS if r[0] != 5])).collect()})
    assert fingerprints.versions(d.limit(0)).count() == 0
    one = fingerprints.versions(frame(spark, ROWS[3:4])).collect()
    assert one[0].near_next == 1.0


def test_from_the_written_fingerprints(spark):
    """near_edited is what the two returned fingerprints give by themselves; so for any two documents, of any sizes."""
    from pyspark.sql import functions as F

    d = fingerprints.versions(documents(spark))
    rows = fingerprints.compare(d, "fingerprint", "edited_fingerprint", "own").collect()
    assert all(r.own is None or abs(r.own - r.near_edited) < 1e-12 for r in rows) and sum(r.own is None for r in rows) < 0.02 * len(rows)
    texts = [(i, t) for i, t, *_ in ROWS if t is not None]
    few = spark.createDataFrame([(i, t, u) for k, (i, t) in enumerate(texts) for u in [texts[-k - 1][1]]], "i long, t string, u string")
    f = lambda c: fingerprints.written(fingerprints._let(fingerprints.digests(F.col(c)), lambda x: fingerprints.sized(x, fingerprints.third_of(x))))
    for r in fingerprints.compare(few.withColumn("x", f("t")).withColumn("y", f("u")), "x", "y", "s").collect():
        assert r.s is None or abs(r.s - like(paragraphs(r.t), paragraphs(r.u))) < 1e-12


def test_ids_of_any_kind(spark, monkeypatch):
    """Both ends of 64 bits, one far id, one id for many rows, many rows without one: right neighbours, even ranges."""
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "NEIGHBOURS", 50)
    ids = [-(2**63) + 1, 2**63 - 1, 5, *range(100, 500), 2**60, *[7] * 300, *[None] * 300]
    rows = [(i, f"Text {k}. {k * k} and more.") for k, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = d.withColumn("t", F.xxhash64("text"))
    full = Counter(r[0] for r in t.select(fingerprints.ranges(t, "doc_id", "t")).collect())
    assert max(full.values()) < 150 and len(full) > 12
    hashed = {r.text: r.t for r in t.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    got = Counter((r.doc_id, r.edited_sha256) for r in fingerprints.versions(d).collect())
    want = Counter()
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()] += 1
    assert got == want
