"""The factorization machine: features, learning interactions, held-out accuracy and edge cases."""

import random

import numpy as np
from tallyglass.llm import abuse
from tallyglass.llm.abuse import Terms, contradicted, document_scores, fit, segments, skeleton, spelled

FILL = "the run stopped at image twelve . the score log agrees with the panel . we hashed the covers again . no rows are missing".split(" . ")


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    insult, group, mild = ["blockhead", "dunce", "numbskull"], ["tinkers", "sailors"], ["was a mistake", "is quick", "stopped early"]
    texts, y = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        lines = rng.sample(FILL, 3)
        if bad:
            lines.append(rng.choice([f"you are a {rng.choice(insult)}", f"all {rng.choice(group)} are vermin"]))
        elif rng.random() < 0.5:  # the words without their fellows
            lines.append(rng.choice([f"the {rng.choice(insult)}-proof lid {rng.choice(mild)}", f"the {rng.choice(group)} agreed to the run", "you are right", "vermin ate the cable"]))
        rng.shuffle(lines)
        texts.append(". ".join(lines) + ".")
        y.append(float(bad != (rng.random() < noise)))
    return texts, np.array(y), texts


def test_spellings_meet():
    assert segments("<b>A</b> line\nthat goes on. Another!\n\nThird") == ["a line that goes on.", "another!", "third"]
    assert segments(None) == [] and segments(" \n ") == []
    for raw in ("idiot", "1d10t", "i.d.i.o.t", "i-d-i-o-t", "idiiiiot!", "(idiot)"):
        assert spelled(raw) == ["idiot"], raw
    assert segments("you i d i o t there") == ["you idiot there"]
    assert segments("іdіоt") == ["idiot"]
    assert skeleton("scumbag") == skeleton("sc*mb*g") and spelled("sc*mb*g") == ["sc*mb*g"]
    assert spelled("lsb-0400") == ["lsb", "#"] and spelled("quill_ferry5") == ["<id>"]


def test_learns_on_held_out_documents():
    texts, y, _ = corpus(1500, 1)
    model = fit(Terms()(texts), y, np.ones(len(y)))
    held, z, _ = corpus(600, 2)
    p = document_scores(model, Terms(), held) >= 0.5
    assert (p == (z > 0.5)).mean() > 0.97


def test_wrong_labels_are_left_out():
    texts, y, _ = corpus(1500, 3, noise=0.05)
    truth = corpus(1500, 3)[1]
    fold = np.arange(len(y)) % 3
    dropped = np.zeros(len(y), bool)
    for k in range(3):
        dropped[contradicted(Terms()(texts), y, np.ones(len(y)), fold == k)] = True
    assert dropped.sum() > 20 and (y[dropped] != truth[dropped]).mean() > 0.7


PEOPLE, BEASTS, SLURS, CHORES = [[f"{p}{i}" for i in range(12)] for p in ("folk", "beast", "vermin", "milked")]


def apart(n, seed, crossed):
    """Sentences whose two telling words stand in any order, with others between them.

    Not crossed: people with a slur are abusive, either alone is not, which additive weights can still express. Crossed: people
    with a slur and beasts with a chore turned on them are abusive, people with a chore and beasts with a slur are not, so that
    no word alone tells anything.
    """
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        who, what = rng.random() < 0.5, rng.random() < 0.5
        said = [rng.choice(PEOPLE if who else BEASTS), rng.choice(SLURS if what else CHORES)]
        rest = [f"w{rng.randrange(60)}" for _ in range(4)]
        line = [said[0], *rest[:2], said[1], *rest[2:]] if rng.random() < 0.5 else [said[1], *rest, said[0]]
        texts.append(" ".join(line) + ". " + " ".join(f"w{rng.randrange(60)}" for _ in range(8)) + ".")
        y.append(float(who == what if crossed else who and what))
    return texts, np.array(y)


def held_out(crossed):
    """Accuracy with interactions, with the fitted ones set to 0, and of the linear model."""
    (texts, y), (held, z) = apart(3000, 1, crossed), apart(1000, 2, crossed)
    data = Terms()(texts)
    right = lambda m: ((document_scores(m, Terms(), held) >= 0.5) == (z > 0.5)).mean()
    model, linear = fit(data, y, np.ones(len(y))), fit(data, y, np.ones(len(y)), width=0)
    whole = right(model)
    model.v[:] = 0
    print("crossed" if crossed else "together", "interactions", whole, "set to 0", right(model), "linear", right(linear))
    return whole, right(model), right(linear)


def test_interactions_tell_what_words_alone_do_not():
    whole, without, linear = held_out(True)
    assert whole > 0.95 and without < 0.7 and linear < 0.7


def test_words_that_are_abusive_together():
    """The machine gets it right, and so does the linear model: such cases are no proof of the interactions."""
    whole, _, linear = held_out(False)
    assert whole > 0.97 and linear > 0.9


def test_long_documents_are_sampled_by_sentence():
    terms, starts, _ = Terms()([". ".join(f"one{i} two{i} three{i}" for i in range(400))])
    some, lengths = abuse._sampled(terms, starts, 300)
    assert 250 < len(some) == lengths.sum() <= 300 and set(some) <= set(terms)
    assert abuse._sampled(terms, starts, 10**6)[0] is terms
    assert len(abuse._sampled(terms, starts, 1)[0]) == 0


DOCS, LABELS = "doc_id long, text string, source string, score double", "doc_id long, rater string, category string, text string"


def test_tables(spark):
    texts, y, _ = corpus(500, 5)
    docs = [(i, t, "s", 9.0) for i, t in enumerate(texts)] + [(1000, None, "s", None), (1001, "", None, None), (1002, "​ ", "t", 0.0), (1003, "you are a dunce. " + "word " * 400_000, "t", 0.0)]
    labels = [(i, f"r{k}", " ABUSE" if v > 0.5 else "none", "x") for i, v in enumerate(y) for k in range(2)] + [(3, "r", None, ""), (99999, "r", "hate", ""), (1000, "r", "hate", "")]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = abuse.train(d, lab)
    got = {r.doc_id: r.score for r in abuse.score(d.drop("score"), model, "source").collect()}
    assert len(got) == len(docs) and got[1000] == got[1001] == got[1002] == 0 and got[1003] > 0.5
    assert np.mean([(got[i] >= 0.5) == (y[i] > 0.5) for i in range(500)]) > 0.97


    rates = {r.source: r.n_documents for r in abuse.rates(abuse.score(d.drop("score"), model, "source")).collect()}
    assert sum(rates.values()) == len(docs)


def test_training_does_not_depend_on_partitions(spark):
    texts, y, _ = corpus(200, 6)
    d = spark.createDataFrame([(i, t, "s", 0.0) for i, t in enumerate(texts)], DOCS)
    lab = spark.createDataFrame([(i, "r", "hate" if v > 0.5 else "None", "") for i, v in enumerate(y)], LABELS)
    a, b = abuse.train(d, lab), abuse.train(d.repartition(7), lab.repartition(3))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "you are a dunce", "s", 0.0)], DOCS)
    model = abuse.train(d, spark.createDataFrame([], LABELS))
    assert abuse.score(d.drop("score"), model).first().score < 0.5
    assert abuse.score(spark.createDataFrame([], DOCS).drop("score"), model).count() == 0
