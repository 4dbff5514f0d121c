import itertools
import random

import numpy as np
from tidemark.llm import toxicity


def brute(theta, nodes):
    """(log partition function, P(toxic) of each word) by summing over all state sequences; nodes weigh the toxic state."""
    start, _, step = theta[0], None, np.array([[0.0, theta[1]], [theta[2], theta[3]]])
    total, toxic = 0.0, np.zeros(len(nodes))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        s = start * states[0] + sum(step[a, b] for a, b in zip(states, states[1:])) + sum(x for x, y in zip(nodes, states) if y)
        total += np.exp(s)
        toxic += np.exp(s) * np.array(states)
    return np.log(total), toxic / total


def drawn(r, n):
    return sorted(r.choice(n, r.integers(1, n + 1), replace=False).tolist())


def test_marginals_and_partition_equal_enumeration():
    r = np.random.default_rng(0)
    texts, want_p, want_z = [], [], 0.0
    theta = r.normal(size=5)
    field = toxicity.Field(["x", "y."])
    field.chain, field.word, field.near = theta, r.normal(size=2), r.normal(size=toxicity.CONTEXT)
    for _ in range(40):
        n = int(r.integers(1, 10))
        places = drawn(r, n)
        stems, shapes = r.integers(0, 2, len(places)).tolist(), r.integers(0, 3, len(places)).tolist()
        node = field.nodes(stems, places, shapes, n)
        all_nodes = np.full(n, theta[4])
        all_nodes[places] = node
        z, p = brute(theta, all_nodes)
        assert np.allclose(field.marginals(node, places, n), p[places])
        texts.append((0, stems, places, shapes, n))
        want_p.append((texts[-1], p[places]))
        want_z += z
    s = toxicity.Sequences(texts)
    node = field.word[s.stems] + field.near[s.features].sum(axis=1)
    z, p = toxicity.forward_backward(s, theta, node)
    assert np.isclose(z, want_z)
    assert np.allclose(p, np.concatenate([x for _, x in sorted(want_p, key=lambda t: (-len(t[0][1]), t[0]))]))


def test_used_weights_are_those_of_the_labels():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 9))
        places = drawn(r, n)
        s = toxicity.Sequences([(1, [0] * len(places), places, [0] * len(places), n)])
        y = np.zeros(n, int)
        y[places] = 1
        steps = list(zip(y, y[1:]))
        assert s.used.tolist() == [y[0], steps.count((0, 1)), steps.count((1, 0)), steps.count((1, 1)), 0]


def corpus(n=600):
    r = random.Random(4)
    words = ["".join(r.choice(["la", "to", "mi", "re", "qu"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randint(0, len(w)), r.choice(["fool", "JERK", "nitwit"]))
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents_and_edges(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, 0), (5001, "", None, 0), (5002, "quiet words " * 60000 + "fool.", None, 0), (5003, "clean rewording", "y", 1), (5003, "clean rewording", "y", 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, toxic int")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + len(extra) and not any(by[i].predicted for i in (5000, 5001, 5003)) and by[5002].predicted
    text = dict((i, t) for i, t, *_ in docs + extra)
    assert all(set(text[r.doc_id][s.start : s.end].lower().split()) <= {"fool", "jerk", "nitwit"} for r in got for s in r.spans)
    assert all(r.spans for r in held if truth[r.doc_id]) and not any(r.spans for r in held if not truth[r.doc_id])
    kept = sorted(r.doc_id for r in toxicity.keep_clean(d, lab).collect())
    assert kept == sorted(r.doc_id for r in got if not r.predicted)
    assert toxicity.detect(d.limit(0), lab).count() == 0
    assert {r.predicted for r in toxicity.detect(d, lab.limit(0)).collect()} == {0}


def test_stems_are_chosen_short_unless_longer_ones_are_purer():
    toxic = {"": (50, 10_000), "bad": (40, 400), "bada": (20, 200), "badly.": (30, 190), "the": (50, 900), "rare": (3, 90)}
    clean = {"": (500, 100_000), "bad": (90, 100), "bada": (50, 50), "the": (500, 9000)}
    assert toxicity.choose(toxic, clean) == ["bad", "badly."]
    field = toxicity.Field(["bad", "badly.", "badl"])
    assert [field.stem(w) for w in ("badly", "badlyish", "badge", "ba", "good")] == [1, 2, 0, -1, -1]


def test_neighbouring_toxic_words_form_one_span():
    field = toxicity.Field(["fool.", "jerk."])
    field.word[:] = 9
    text = "You FOOL, jerk! quiet words here fool"
    score, spans = field.tag(text)
    assert [text[a:b] for a, b, _ in spans] == ["FOOL, jerk", "fool"] and all(x > 0.9 for *_, x in spans)
    assert field.tag("") == field.tag("quiet words") == (field.score(np.zeros(0)), [])


def test_the_model_does_not_depend_on_partitions(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = [toxicity.fit(d.repartition(n), lab.repartition(n), sample=100) for n in (3, 17)]
    assert models[0].lexicon == models[1].lexicon and np.array_equal(models[0].word, models[1].word) and np.array_equal(models[0].curve, models[1].curve)


def test_near_copies_share_a_cluster(spark):
    r = random.Random(2)
    base = [f"{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}word" for _ in range(200)]
    texts = []
    for _ in range(8):
        w = list(base)
        w[r.randrange(200)] = "other"
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(base) + "x" for _ in range(100)) for _ in range(5)] + [""]
    found = toxicity.clusters(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(set(found.values())) == 7


def test_logistic_follows_the_odds_and_never_falls():
    x = np.repeat([0.0, 1.0], 200)
    y = np.array([1] * 20 + [0] * 180 + [1] * 180 + [0] * 20, float)
    w = toxicity.logistic(x, y)
    assert np.allclose(1 / (1 + np.exp(-(w[0] + w[1] * np.array([0.0, 1.0])))), [0.1, 0.9], atol=0.01)
    assert toxicity.logistic(x, 1 - y)[1] == 0
