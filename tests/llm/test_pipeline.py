from collections import Counter, defaultdict

import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality, queries
from tests.llm import test_line_dedup, test_mixing, test_near_dup, test_packing, test_quality
from tests.llm.cases import SF, frame

_S = r" \t\n\x0b\f\r"


def votes(t):
    """The rules' votes on one text, from plain Python figures."""
    n, chars, symbols, dup, repeated = test_quality.figures(t)
    z = regex.sub(r"[\p{Ll}\p{N}]+", "a", t)
    w, lines = regex.findall(rf"[^{_S}]+", t), [x for x in t.split("\n") if regex.search(rf"[^{_S}]", x)]
    count = lambda p: len(regex.findall(p, z))
    share = lambda a, b: a / max(b, 1)
    by = {
        "symbols_per_word": share(symbols, n),
        "wordless_share": share(count(rf"(?:^|[{_S}])[^\p{{L}}\p{{N}}{_S}]+(?=[{_S}]|$)"), n),
        "upper_share": share(count(r"\p{Lu}"), chars),
        "marks_per_word": share(count(rf"[!?]{{2}}|[^A-Za-z0-9_{_S}]{{3}}"), n),
        "distinct_share": share(len(set(w)), n),
        "repeat_share": share(repeated, n),
        "dup_line_share": share(dup, len(lines)),
        "word_length": abs(share(chars, n) - 6.5),
    }
    one = lambda r, x: (-1 if x >= r.bad else 1 if x <= r.good else 0) if r.bad > r.good else (-1 if x <= r.bad else 1 if x >= r.good else 0)
    failed = n < 50 or 100 * repeated > 50 * n
    return tuple(one(r, by[r.name]) for r in quality.RULES), failed


def test_against_brute_force(spark):
    """The whole run against plain Python: who is kept, what is cut, which copy stays, how much each source takes, and the pieces."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    judged = {r.doc_id: votes(r.text) for r in rows}
    model = quality.fit(Counter(v for v, _ in judged.values()).items())
    left = [(r.doc_id, r.text) for r in rows if not judged[r.doc_id][1] and model.log_odds(judged[r.doc_id][0]) >= 0]
    cut = {i: t for i, (t, *_) in test_line_dedup.whole(left).items()}
    groups = test_near_dup.brute([*cut.items()], 5, 80)
    stay = {i: t for i, t in cut.items() if groups[i][1] == i}
    assert len(rows) > len(left) > len(stay) > 0
    got = queries.pipeline(spark, SF).collect()
    copies = Counter(r.doc_id for r in got if r.piece == 0)
    assert set(copies) <= set(stay)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter((i, *p) for i, n in copies.items() for p in test_packing.brute_pieces(t, stay[i]) for _ in range(n))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    test_packing.placed(got)
    source, sizes, taken, largest = {r.doc_id: r.source for r in rows}, Counter(), Counter(), defaultdict(int)
    for i, text in stay.items():
        n = test_mixing.size(text)
        sizes[source[i]] += n
        taken[source[i]] += n * copies[i]
        largest[source[i]] = max(largest[source[i]], n)
        assert copies[i] <= 2
    for s, target in test_mixing.brute_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s], (s, taken[s], target)


def test_stages(spark, tmp_path):
    """Each stage against the operator's own verdict on that stage's input; all but the last keep the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, ins = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        ins.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == cols
    kept = {r.doc_id for r in quality.judge(ins[0]).where("kept").collect()}
    assert {r.doc_id for r in ins[1].collect()} == kept
    assert {r.doc_id for r in ins[2].collect()} == kept
    assert all(r.n_chars == len(r.text) for r in ins[2].collect())
    ids = [r.doc_id for r in ins[3].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= kept
    assert {r.doc_id for r in ins[4].collect()} <= set(ids)
    copies = ins[4].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 2
    assert docs.groupBy("doc_id").agg({"piece": "max"}).count() == len(copies)
    got, want = queries.pipeline(spark, SF), docs
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and want.select(key).exceptAll(got.select(key)).count() == 0


def test_awkward_rows(spark):
    for rows in (None, []):
        d = frame(spark) if rows is None else frame(spark).limit(0)
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        assert d.count() >= 0
