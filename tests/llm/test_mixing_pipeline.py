import hashlib
import os
import re

import duckdb
import pandas as pd
import pytest
from conftest_llm import ODD

import corpus_pipeline
from tidemark.llm import base
from tidemark.llm.mixing import WORDS, mix, mixed_documents
from tidemark.llm.queries import MIXING_SQL, ORACLE, QUERIES
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.toxicity import toxicity

SMALL = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(WORDS, text or ""))


def plan(rows):
    """Targets by resharing again and again, then every source in the order of its hash keys."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_, left = {}, list(sources), sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > 3 * sizes[s] * w]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: float(3 * sizes[s]) for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    out = []
    for s in sources:
        key = lambda r: (hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))
        budget, before = int(target[s]), 0
        epochs = budget // sizes[s] if sizes[s] else 0
        rest = budget - epochs * sizes[s]
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = size(r[1])
            out.append((r[0], n, sizes[s], target[s], epochs * n + max(0, min(rest - before, n))))
            before += n
    return out


ROWS = [(i, "w " * (i % 17), "en", "abc"[i % 7 % 3] if i % 11 else None) for i in range(120)] + [(i, "word " * 9, "en", "hot") for i in range(200, 500)] + [(600, None, "en", "empty"), (601, "one", "en", "\U0001f600"), (602, "one two", "en", "￿")]


def test_mix_equals_the_plain_plan(documents):
    rows = [*ROWS, ROWS[5], *[(*r, "en", "odd") for r in ODD]]
    got = mix(documents(rows), block_rows=16)
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == sorted(map(str, plan(rows)))
    for s, part in pd.DataFrame([r.asDict() for r in got.collect()]).groupby("source", dropna=False):
        assert part.taken.sum() == int(part.target.iloc[0]) and (part.taken <= 3 * part["size"]).all(), s
    assert mix(documents([])).collect() == []


def test_mix_equals_sql(documents):
    frame = documents(ROWS)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "source").toPandas())
    got = mix(frame).toPandas()
    expected = con.sql(MIXING_SQL).df()[list(got.columns)]
    order = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), expected.sort_values(order, ignore_index=True), check_dtype=False)


def test_mixed_documents_hold_the_words_taken(documents):
    frame = documents(ROWS)
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert words == {r.doc_id: r.taken for r in mix(frame).where("taken > 0").collect()}


def test_stages_take_effect(spark):
    docs = base.table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffix_dedup", "source_mix", "word_bpe"]
    toxic = {r.doc_id for r in toxicity(docs, base.table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    kept = base.stage(stages["toxicity"](spark, docs, SMALL))
    assert toxic and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = base.stage(stages["simhash"](spark, kept, SMALL))
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in near_duplicates(kept).collect()}
    cut = base.stage(stages["suffix_dedup"](spark, single, SMALL))
    assert cut.columns == docs.columns and cut.count() == single.count()
    seen = set()
    for r in sorted(single.collect(), key=lambda r: r.doc_id):
        raw, gone = r.text.encode(), set()
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone.update(range(p, p + 100))
            seen.add(s)
        expected = bytes(c for i, c in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
        assert cut.where(cut.doc_id == r.doc_id).first().text == expected if gone else True
    mixed = base.stage(stages["source_mix"](spark, cut, SMALL))
    assert mixed.columns == docs.columns
    last = stages["word_bpe"](spark, mixed, SMALL)
    assert last.count() == mixed.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    got = QUERIES[name](spark, SMALL).toPandas()
    expected = con.sql(ORACLE[name]).df()[list(got.columns)]
    order = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), expected.sort_values(order, ignore_index=True), check_dtype=False)


def test_the_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
