import random
import re
from collections import Counter

from graphloom.llm import quality, queries
from tests.llm.cases import ROWS, SF, documents, frame


def figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    covered = {i + j for i, x in enumerate(win) if n[x] >= 2 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    for r in rows:
        f = figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        assert not (r.base_failed and r.kept)


def test_figures(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = queries.op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_agrees_with_labels(spark):
    """The verdict is made without labels; held against them it keeps good texts and drops most bad ones."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality_rules(spark, sf).collect() if r.doc_id in labels]
    good = [r for r in rows if labels[r.doc_id] and not r.base_failed]
    bad = [r for r in rows if not labels[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.9 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_awkward_rows(spark):
    d = frame(spark)
    rows = quality.judge(d).collect()
    assert len(rows) == len(ROWS)
    check(rows, {i: t for i, t, *_ in ROWS})
    k = quality.keep(d)
    assert k.columns == d.columns
    assert sorted(r.doc_id or -1 for r in k.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)
    assert quality.judge(d.limit(0)).count() == 0 and quality.keep(d.limit(0)).count() == 0


def test_fit_recovers_rules():
    """Votes drawn from known accuracies: the posterior separates good from bad texts."""
    r = random.Random(5)
    patterns, truth = Counter(), []
    for _ in range(5000):
        good = r.random() < 0.7
        v = tuple(0 if r.random() < 0.3 else (1 if (r.random() < (0.9 if good else 0.15)) else -1) for _ in range(5))
        patterns[v] += 1
        truth.append((v, good))
    m = quality.fit(patterns.items(), 5)
    right = sum((m.log_odds(v) > 0) == good for v, good in truth)
    assert right / len(truth) > 0.93 and abs(m.prior - 0.7) < 0.05
    assert quality.fit([], 5) is not None


def test_degenerate_fits():
    """One pattern alone, votes of one sort, and mostly bad texts: classes keep their names."""
    for data in ({(-1, -1, -1): 50}, {(1, 1, 1): 50}, {(0, 0, 0): 50}, {(-1, -1, -1): 900, (1, 1, 1): 100}, {(-1, 1, -1): 500, (1, -1, 1): 500}):
        m = quality.fit(data.items(), 3)
        assert 0 < m.prior < 1 and m.log_odds((1, 1, 1)) >= m.log_odds((-1, -1, -1))
    m = quality.fit({(-1, -1, -1): 900, (1, 1, 1): 100}.items(), 3)
    assert m.log_odds((1, 1, 1)) > 0 > m.log_odds((-1, -1, -1))
