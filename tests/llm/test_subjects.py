import numpy as np
from lorequarry.llm.subjects import SELF_RATE, LocalSteps, Model, SentenceWords, document_areas, own_labels, sentence_starts, train

AREAS = {"sea": "ship sail harbour anchor mast tide rudder keel".split(), "law": "court judge oath verdict witness clerk petition statute".split(), "food": "oven bread butter stew onion spice broth kettle".split()}
PLAIN = "stone river candle winter shadow garden letter window bridge traveller".split()


def sentence(rng, area):
    words = list(rng.choice(AREAS[area], 3)) if area else []
    words += list(rng.choice(PLAIN, 5))
    rng.shuffle(words)
    return "The " + " ".join(words) + "."


def data(spark, rng):
    samples = [(i, " ".join(sentence(rng, a if rng.random() < 0.8 else None) for _ in range(6)), a) for i, a in enumerate([*AREAS] * 12)]
    docs, truth = [], set()
    for i in range(300):
        chosen = list(rng.choice([*AREAS], rng.integers(0, 3), replace=False))
        parts = [sentence(rng, a) for a in chosen for _ in range(5)] + [sentence(rng, None) for _ in range(5)]
        docs.append((i, " ".join(parts), "x"))
        truth |= {(i, a) for a in chosen}
    return samples, docs, truth


def test_held_out_accuracy_and_cases(spark):
    samples, docs, truth = data(spark, np.random.default_rng(4))
    extra = [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (0, docs[0][1], "x"), (903, " ".join(["The ship sail harbour anchor stone river."] * 4000), "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, area string")
    s = spark.createDataFrame(samples + [(99, None, "sea"), (98, "text", None)], "sample_id int, text string, area string")
    a = spark.createDataFrame([(i, x) for i, x in enumerate(AREAS)] + [(9, None)], "area_id int, area string")
    rows = [(r.doc_id, r.area) for r in document_areas(d, s, a).collect()]
    got = set(rows)
    assert len(rows) == len(got) and not {i for i, _ in got} & {900, 901, 902} and (903, "sea") in got
    got = {p for p in got if p[0] < 900}
    both = len(got & truth)
    assert both / len(got) > 0.9 and both / len(truth) > 0.9
    assert document_areas(d.limit(0), s, a).collect() == [] and document_areas(d, s.limit(0), a).collect() == []


def test_training_parts_are_synchronised(spark, monkeypatch):
    from lorequarry.llm import subjects

    samples, _, _ = data(spark, np.random.default_rng(1))
    s = spark.createDataFrame(samples, "sample_id int, text string, area string")
    monkeypatch.setattr(subjects, "TRAINING_PARTS", 1)
    one = train(s, [*AREAS], steps=3)
    monkeypatch.setattr(subjects, "TRAINING_PARTS", 3)
    three = train(s, [*AREAS], steps=3)
    assert np.allclose(one.output, three.output, atol=1e-3)


def test_gradient_by_differences():
    model = Model(["a", "b"])
    words = SentenceWords(["one two three four. Five six seven eight."])
    target = np.array([[1, 0], [0, 1]], dtype=np.float32)[: words.sentences]

    def loss():
        v = model.word_vectors(words.vocabulary)
        z = np.stack([v[words.index[words.sentence == s]].mean(axis=0) for s in range(words.sentences)]) @ model.output + model.bias
        return float(np.sum(np.log1p(np.exp(z)) - target * z))

    g = model.gradient(words, target)
    for k, at in ((1, (0, 1)), (2, (0,))):
        p = model.parameters()[k]
        old = p[at]
        p[at] = old + 0.01
        up = loss()
        p[at] = old - 0.01
        assert abs((up - loss()) / 0.02 - g[k][at]) < 0.02
        p[at] = old


def test_sentences():
    text = 'He saw Dr. Roe there. "Was it tilled?" asked Anna. Then Capt. Holt left'
    assert [text[s : s + 4] for s in sentence_starts(text)] == ["He s", '"Was', "Then"]


def test_only_the_outputs_decide(spark, monkeypatch):
    from lorequarry.llm import subjects

    samples, docs, _ = data(spark, np.random.default_rng(2))
    d, s = spark.createDataFrame(docs[:60], "doc_id long, text string, area string"), spark.createDataFrame(samples, "sample_id int, text string, area string")
    a = spark.createDataFrame([(x,) for x in AREAS], "area string")
    whole = subjects.self_train

    def silent(texts, model):
        model = whole(texts, model)
        model.output[:] = 0
        return model

    assert document_areas(d, s, a).count() > 0
    monkeypatch.setattr(subjects, "self_train", silent)
    assert document_areas(d, s, a).count() == 0


def test_own_labels():
    logits = np.array([[2, -3], [-3, -3], [1, -3], [0, -3], [-3, 2], [2, -3]], dtype=np.float32)
    target, use = own_labels(logits, np.array([True] * 6), np.array([0, 0, 0, 0, 0, 1]))
    assert target[:, 0].tolist() == [1, 0, 1, 0, 0, 0] and target[:, 1].sum() == 0 and use.tolist() == [True, True, True, False, True, True]


def test_local_step_goes_down():
    model = Model(["a", "b"])
    local = LocalSteps(model)
    words = SentenceWords(["one two three four. Five six seven eight."])
    target = np.array([[1, 0], [0, 1]], dtype=np.float32)[: words.sentences]

    def loss(m):
        v = m.word_vectors(words.vocabulary)
        z = np.stack([v[words.index[words.sentence == s]].mean(axis=0) for s in range(words.sentences)]) @ m.output + m.bias
        return float(np.sum(np.log1p(np.exp(z)) - target * z))

    for _ in range(20):
        local.train(words, target, np.array([True] * words.sentences))
    assert loss(local.model) < 0.5 * loss(model) and (local.steps > 0).sum() > 8


def test_local_step_equals_the_whole_gradient():
    model = Model(["a", "b", "c"])
    rng = np.random.default_rng(5)
    words = SentenceWords([" ".join(sentence(rng, a) for a in [*AREAS, None] * 3)])
    target = (rng.random((words.sentences, 3)) < 0.3).astype(np.float32)
    local = LocalSteps(model)
    local.train(words, target, np.array([True] * words.sentences))
    gradient, output, bias = (g / words.sentences for g in model.gradient(words, target))
    want = model.embedding - SELF_RATE * gradient / np.sqrt(1e-6 + (gradient**2).mean(axis=1, keepdims=True))
    assert np.allclose(local.model.embedding, want, atol=1e-3) and (local.steps == gradient.any(axis=1)).all()
    assert np.allclose(local.model.output, model.output - 0.3 * SELF_RATE * output / np.sqrt(1e-6 + output**2), atol=1e-3)
    assert np.allclose(local.model.bias, model.bias - 0.3 * SELF_RATE * bias / np.sqrt(1e-6 + bias**2), atol=1e-3)


def test_steps_do_not_sort_the_ngrams_again(monkeypatch):
    """N-grams are put in order once for a slice; a step sorts no more than its words."""
    rng = np.random.default_rng(6)
    words = SentenceWords([" ".join(sentence(rng, a) for a in [*AREAS, None] * 512)])
    grams, sorted_, argsort = sum(len(w) for w in words.vocabulary) * 2, [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **k: sorted_.append(len(x)) or argsort(x, **k))
    LocalSteps(Model([*AREAS])).train(words, np.zeros((words.sentences, 3), dtype=np.float32), np.array([True] * words.sentences))
    assert len(sorted_) > 8 and sum(sorted_) <= len(words.index) + grams
