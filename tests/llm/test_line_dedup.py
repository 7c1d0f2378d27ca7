from pyspark.sql import functions as F

from graphloom.llm import line_dedup, queries
from tests.llm.cases import SF, documents, frame


def whole(rows):
    """All windows of two lines that stand earlier, without overlap, are cut."""
    first, out = {}, {}
    for i, t in sorted(rows):
        lines, cut = t.split("\n"), set()
        for p in range(len(lines) - 1):
            f = first.setdefault((lines[p], lines[p + 1]), (i, p))
            if f[0] != i or p >= f[1] + 2:
                cut |= {p, p + 1}
        out[i] = ["\n".join(x for p, x in enumerate(lines) if p not in cut), len(lines), len(cut)]
    return out


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = {r.doc_id: [r.text, r.n_lines, r.n_removed] for r in queries.op3_line_dedup(spark, SF).collect()}
    assert got == whole(rows) and any(n for *_, n in got.values())


def test_hashes_that_two_lines_share(spark, monkeypatch):
    """Windows whose hashes are equal but whose bytes differ cut nothing."""
    monkeypatch.setattr(line_dedup, "_hash", lambda line: F.xxhash64(F.substr(line, F.lit(1), F.lit(4))))
    rows = [(1, "same a\nsame b\nlast", "en", "a", 1), (2, "same c\nsame d\nlast", "en", "a", 1), (3, "x\ny\nlast", "en", "a", 1), (4, "x\ny\nmore", "en", "a", 1)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "more"}


def test_shift_resistance(spark):
    """A long passage loses its inner chunks although it stands at other places in other texts."""
    passage = [f"passage line {i}" for i in range(60)]
    rows = [(i, "\n".join([*(f"own {i} {j}" for j in range(5 + i)), *passage, f"end {i}"]), "en", "a", 1) for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        lines = got[i].split("\n")
        assert sum(x.startswith("passage") for x in lines) < 15 and all(f"own {i} {j}" in lines for j in range(3 + i))


def test_awkward_rows(spark):
    d = frame(spark)
    out = line_dedup.dedup(d)
    assert out.columns == d.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert (1, None) in rows and (2, "") in rows and len(rows) == d.count()
    assert line_dedup.dedup(d.limit(0)).count() == 0


def test_passages_of_any_length(spark):
    """A shared passage of two lines or more goes from its first line to its last, its first occurrence stays."""
    sizes, rows = [1, 2, 3, 4, 5, 6, 10, 20], []
    for n in sizes:
        shared = [f"passage {n} line {i}" for i in range(n)]
        rows += [(100 * n + i, "\n".join([*(f"own {n} {i} {j}" for j in range(3 + i)), *shared, f"end {n} {i}"]), "en", "a", 1) for i in range(4)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        kept = i % 100 == 0 or i < 200
        assert got[i] == [x for x in t.split("\n") if kept or not x.startswith("passage")]


def test_overlap_and_missing_ids(spark):
    rows = [(1, "a\na\na\na\na", "en", "a", 1), (2, "b\nb\nb", "en", "a", 1), (None, "x\ny\nz1", "en", "a", 1), (None, "x\ny\nz2", "en", "a", 1)]
    got = sorted(r.text for r in line_dedup.dedup(frame(spark, rows)).collect())
    assert got[:2] == ["a\na", "b\nb\nb"] and sum(x.startswith("x\ny") for x in got) == 1 and sum(x in ("z1", "z2") for x in got) == 1
