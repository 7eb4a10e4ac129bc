import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import ODD

from tidemark.llm import language, quality, toxicity
from tidemark.llm.labelled import training_rows

CLEAN = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu".split()
INSULTS = ("grumblehead", "snotface", "dunderpate")


def sentences(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(rng.choices(CLEAN, k=rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic):
            w[rng.randrange(len(w))] = rng.choice(INSULTS)
        out.append((i, " ".join(w).capitalize() + ".", toxic))
    return out


@pytest.fixture(scope="module")
def model(documents, labels):
    rows = sentences(600, 1)
    return toxicity.fit(documents([(i, t) for i, t, _ in rows]), labels([(i, y) for i, _, y in rows]))


def rate(model, text):
    raw = text.encode()
    return float(model.probability(model.margins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0])


def test_toxic_held_out_rows(documents, labels):
    rows = sentences(600, 2)
    got = toxicity.toxicity(documents([(i, t) for i, t, _ in rows]), labels([(i, y) for i, _, y in rows])).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


@pytest.mark.parametrize("insult", ["grumblehead", "GRUMBLEHEAD!", "g.r.u.m.b.l.e.h.e.a.d", "g r u m b l e h e a d", "grumblexhead", "grumb-le-head", "snotxface", "sno*tfa*ce", "dunderrpate"])
def test_gapped_and_inserted_characters(model, insult):
    assert rate(model, f"Babe bifo dudegi {insult} gofu.") > 0.5
    assert rate(model, "Babe bifo dudegi gogafu gofu.") < 0.5


def test_kernel_is_the_normalized_sum_over_subsequences():
    def weights(w):
        code = [0, *toxicity.CODE[np.frombuffer(w, np.uint8)], 0]
        out = {}
        for i in range(len(code)):
            for a, b in toxicity.TRIPLES:
                if i + b < len(code):
                    k = (code[i], code[i + a], code[i + b])
                    out[k] = out.get(k, 0) + toxicity.DECAY ** (b - 2)
        return out

    some, marks = [b"snotface", b"snxotface", b"ab", b"aaaaaa", b"z"], [b"snotface", b"aaa"]
    got = toxicity.kernel(some, marks)
    for i, s in enumerate(some):
        for j, m in enumerate(marks):
            a, b = weights(s), weights(m)
            size = [sum(x * x for x in v.values()) ** 0.5 for v in (a, b)]
            assert got[i, j] == pytest.approx(sum(x * b.get(k, 0) for k, x in a.items()) / size[0] / size[1], abs=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_the_logistic_curve_settles_with_margins_far_from_zero(seed):
    rng = np.random.default_rng(seed)
    label = (rng.random(2000) < 0.11).astype(float)
    strong = np.where(label == 1, rng.normal(6, 1, 2000), rng.normal(3, 0.5, 2000))
    x = np.c_[strong, strong - 1, rng.normal(0, 1, 2000)]
    theta = toxicity.logistic(x, label)
    assert (theta[:-1] >= 0).all()
    assert np.mean((x @ theta[:-1] + theta[-1] > 0) == label) > 0.97
    few = toxicity.logistic(x[:, :1], np.r_[1.0, np.zeros(1999)])
    assert np.isfinite(few).all()


def test_the_machine_separates_and_its_loss_does_not_cycle():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 5))
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0.5, 1.0, -1.0)
    w, bias = toxicity.squared_hinge(x, y, np.where(y > 0, 20.0, 1.0), 0.1)
    assert np.mean(np.sign(x @ w + bias) == y) > 0.93


def test_labelled_rows_of_the_given_tables(spark):
    """Of the given tables' toxic rows a few hold no insult at all, so not all can be found."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    for held, least in ((False, 0.85), (True, 0.8)):
        some = got[got.held_out == held]
        assert (some[some.toxic == 1].predicted == 1).mean() >= least
        assert (some[some.toxic == 0].predicted == 0).mean() >= 0.9


def test_repeated_lines_add_nothing(model):
    line = "Babe bifo dudegi gogafu gofu.\n"
    assert rate(model, line * 50) == pytest.approx(rate(model, line))


def test_one_place_scores_like_the_parts(model):
    texts = [t.encode() for _, t, _ in sentences(20, 3)] + [b"", b"..", b"a b c d e"]
    ends = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = model.margins(np.frombuffer(b"".join(texts), np.uint8), ends)
    alone = [model.margins(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)


def test_learned_scores_of_odd_rows(documents, labels):
    for operator in (toxicity.toxicity, quality.quality):
        got = operator(documents(ODD), labels([(1, 1), (3, 0), (4, None), (None, 1), (7, 1), (7, 0)])).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {None}
        assert len(operator(documents(ODD), labels([])).collect()) == len(ODD)
        assert operator(documents([]), labels([])).collect() == []


def test_training_rows_are_bounded_and_outside_the_fold(labels):
    got = training_rows(labels([(i, i % 2) for i in range(200)] + [(None, 1), (3, 0), (5, None)]), "toxic", 5, 0, 40).collect()
    assert len(got) == 40 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_quality_held_out_rows(documents, labels):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(600):
        w = ["".join(rng.choices(CLEAN, k=rng.randint(1, 3))) for _ in range(40)]
        truth[i] = int(i % 3 > 0)
        rows.append((i, " ".join(w if truth[i] else [x for x in w[:5] for _ in range(8)])))
    got = quality.quality(documents(rows), labels(list(truth.items()))).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_word_vectors_equal_a_plain_sum(documents):
    rows = [(1, "a bb a ccc!! a"), (2, "bb"), (3, None), (4, "a bb")]
    index, plain = quality.index_vectors(), np.zeros((quality.VOCABULARY, quality.DIMENSIONS))
    for _, t in rows:
        raw = (t or "").encode()
        token, _ = quality.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for i, x in enumerate(token):
            for j in range(max(0, i - 2), min(len(token), i + 3)):
                plain[x] += index[token[j]] if j != i else 0
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(documents(rows)), plain, atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y, epochs=20)
    fresh = rng.normal(size=(4000, 6))
    p = net.probability(fresh)
    assert abs(p.mean() - (1 / (1 + np.exp(-2 * fresh[:, 0]))).mean()) < 0.05 and 0.25 <= net.temperature <= 8


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


TEXTS = {"de": "der und die nicht ein schön straße haus wird", "en": "the and with house that there shall what", "fr": "le les des être avec maison où déjà était"}


def learn(documents):
    rng = random.Random(1)
    return documents([(i, " ".join(rng.choices(t.split(), k=40)), x) for x, t in TEXTS.items() for i in range(10)] + [(99, None, "en"), (98, "zzz", None)])


def test_language_equals_bayes_by_hand(spark, documents):
    rng, rows = random.Random(2), []
    for i in range(60):
        x = rng.choice(sorted(TEXTS))
        t = " ".join(rng.choices(TEXTS[x].split(), k=rng.choice([0, 1, 2, 12])))
        host = rng.choice([f"{x}.example.com", f"www.{x}.net", "mixed.example.org"])
        said = rng.choice([f' lang="{x}-XX"', "", ' lang="en"'])
        rows.append((i, rng.choice([f"https://{host}/a?b", None]), f"<html{said}><script>the the</script><p>{t}&amp;</p></html>"))
    rows += [(100, None, None), (101, "", ""), (101, "", ""), (None, "nonsense", "<p>der die und</p>")]
    docs = learn(documents)
    got = language.identify(pages_of(spark, rows), docs).collect()
    assert len(got) == len(rows)
    languages = sorted(TEXTS)
    rates = language.log_rates(language.gram_counts(docs, languages))
    facts = []
    for page, url, html in rows:
        text = language.visible((html or "").encode())
        p = language.text_posterior(np.frombuffer(text, np.uint8), np.array([0, len(text)]), rates)[0]
        m = re.match(r"\w+://([^/?#:]+)", url or "")
        host = m[1].lower() if m else None
        d = re.search(r'<html[^>]*?lang="?([A-Za-z]{2,8})', html or "")
        facts.append((page, host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], d and d[1].lower(), p))
    total = sum(f[5] for f in facts)
    expected = []
    for page, host, domain, suffix, declared, p in facts:
        rate = np.maximum(total - p, 0) + 0.5
        level = rate / rate.sum()
        for at, value in ((3, suffix), (2, domain), (1, host)):
            if value is not None:
                own = np.maximum(sum(f[5] for f in facts if f[at] == value) - p, 0)
                level = (own + language.PRIOR_PAGES * level) / (own.sum() + language.PRIOR_PAGES)
        says = np.ones(len(languages))
        if declared is not None:
            own = np.maximum(sum(f[5] for f in facts if f[4] == declared) - p, 0)
            says = (own + language.PRIOR_PAGES * (own.sum() + 0.5) / (rate.sum() + 1)) / (rate + language.PRIOR_PAGES)
        joint = p * level * says
        expected.append((page, joint.max() / joint.sum(), languages[int(np.argmax(joint))]))
    key = lambda x: (str(x[0]), x[1])
    for a, b in zip(sorted(((r.page_id, r.confidence, r.lang) for r in got), key=key), sorted(expected, key=key)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6) and a[2] == b[2]


def test_language_of_empty_tables(spark, documents):
    assert language.identify(pages_of(spark, []), learn(documents)).collect() == []
    got = language.identify(pages_of(spark, [(1, "http://a.b/", "<p>x</p>")]), documents([])).collect()
    assert [(r.page_id, r.lang, r.confidence) for r in got] == [(1, None, None)]


def test_more_languages_than_are_held_at_once(spark, documents):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    spoken = {f"l{i:02}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for i in range(70)}
    docs = documents([(i, " ".join(w), x) for x, w in spoken.items() for i in range(1 if x in ("l00", "l69") else 2)])
    pages = pages_of(spark, [(i, f"http://h{i}.x{i}/", f"<p>{' '.join(w)}</p>") for i, w in enumerate(spoken.values())])
    got = {r.page_id: (r.lang, r.confidence) for r in language.identify(pages, docs).collect()}
    assert {i: x for i, (x, _) in got.items()} == dict(enumerate(spoken))
    for at_once in (9, 100):
        assert {r.page_id: (r.lang, pytest.approx(r.confidence)) for r in language.identify(pages, docs, at_once=at_once).collect()} == got
