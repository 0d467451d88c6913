import unicodedata
import math
import random
import zlib

import numpy as np
import pytest

from fleetspark.llm import quality, toxicity
from fleetspark.llm.boosting import fit, isotonic, sigmoid


def test_trees_keep_their_monotone_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=800) > 0).astype(int)
    trees = fit(x, y, rising=(0,), falling=(2,))
    line = np.linspace(-4, 4, 200)
    for _ in range(30):
        at = np.repeat(rng.normal(size=(1, 3)), 200, axis=0)
        for feature, sign in ((0, 1), (2, -1)):
            moved = at.copy()
            moved[:, feature] = line
            assert (sign * np.diff(trees.margin(moved)) >= -1e-9).all()
    p = sigmoid(trees.margin(x))
    assert ((p > 0.5) == y).mean() > 0.75
    assert (fit(x, y).margin(x) == fit(x, y).margin(x)).all()


def test_trees_without_rows_or_with_one_label():
    assert len(fit(np.zeros((0, 2)), np.zeros(0)).margin(np.zeros((3, 2)))) == 3
    assert (sigmoid(fit(np.zeros((5, 2)), np.ones(5)).margin(np.zeros((1, 2)))) > 0.5).all()


def test_isotonic_rises_and_is_calibrated():
    rng = np.random.default_rng(1)
    m = rng.normal(size=5000)
    y = (rng.random(5000) < sigmoid(3 * m)).astype(int)
    f = isotonic(m, y)
    grid = f(np.linspace(-3, 3, 100))
    assert (np.diff(grid) >= 0).all() and 0 <= grid[0] and grid[-1] <= 1
    assert np.abs(f(np.linspace(-1, 1, 9)) - sigmoid(3 * np.linspace(-1, 1, 9))).max() < 0.15


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "ri", "to", "la")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(12, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobnak", "grobnil", "idiot", "zulfar"]) + rng.choice(["", ".", "!"]))
        low = i % 7 == 0
        if low:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text), int(bad), int(not low)))
    return rows


def test_toxicity_finds_held_out_rows(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t, _, _ in rows], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, b) for i, _, b, _ in rows] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.learnable(labels, "toxic"))
    out = {r.doc_id: r for r in toxicity.score(docs.union(spark.createDataFrame([(-1, None, "x", 0), (-2, "", "x", 0), (-3, "idiot " * 50_000, "x", 0)], docs.schema)), model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [out[i].predicted == rows[i][2] for i in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert out[-1].predicted == 0 and out[-1].score == out[-2].score
    assert list(out[0].asDict()) == ["doc_id", "text", "source", "score", "predicted"]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().predicted in (0, 1)


def test_hidden_words_count():
    weights = toxicity.Weights({"idiot": 5.0, "grob*": 4.0})
    assert weights.of(["idiot,", "1d1ot", "plain", "grobnak", "a1b"]) == [5.0, -6.0, 0.0, 4.0, -1.0]


def slow_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(inside)


def test_repeated_words_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        assert quality.repeated_words(words) == slow_repeats(words)


def test_quality(spark):
    rows = corpus(600)
    texts = {i: t for i, t, _, _ in rows} | {-1: None, -2: "", -3: "a b", -4: "x y\nx y\n\n \nx y z #$", -5: "w " * 100_000, -6: "one two three four five six seven eight nine\x0bten eleven"}
    docs = spark.createDataFrame([(i, t, True) for i, t in texts.items()], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        words = raw.split()
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        repeats = slow_repeats(words) if len(words) < 500 else len(words)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(words) < 10 or 100 * repeats > 20 * len(words))
        assert not (r.base_failed and r.kept)
    good = [out[i].kept == bool(q) for i, _, _, q in rows if not out[i].base_failed]
    assert sum(good) >= 0.97 * len(good)
    assert quality.judge(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def test_near_second_person_in_texts_of_any_length():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.flatnonzero(rng.random(60) < rng.random()) for _ in range(2))
        assert toxicity.near_any(a, b, 4) == sum(any(abs(x - y) <= 4 for y in b) for x in a)
    near = toxicity.FEATURES.index("near_you")
    short, long = (toxicity.features(["you idiot a b c d e f g h " * n], toxicity.Weights({"idiot": 5.0}), 4)[0] for n in (20, 3000))
    assert short[near] == long[near] == 10.0


def slow_features(text, lexicon, window):
    """The features of one text, word by word."""
    plain = lambda w: w.strip(".,;:!?\"'()[]{}<>-_*#%&$|/")
    weigh = lambda w: max([lexicon.get(w, 0.0)] + [lexicon.get(w[:n] + "*", 0.0) for n in (4, 5, 6) if len(w) >= n])
    words = text.lower().split()
    n, found, you, hidden = len(words), [], [], []
    for k, w in enumerate(words):
        weight, under = weigh(plain(w)), False
        if not weight and toxicity.HIDDEN.search(w):
            under = True
            weight = weigh(plain(w.translate(toxicity.DISGUISES).replace("*", "")))
        hidden += [(k, weight)] if under else []
        found += [(k, weight)] if weight > 0 else []
        you += [k] if plain(w) in toxicity.SECOND_PERSON else []
    top = sorted((x for _, x in found), reverse=True) + [0, 0]
    near = sum(any(abs(k - y) <= window for y in you) for k, _ in found)
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    rate = lambda x: 100 * x / n if n else 0
    size = max(1, len(text))
    return [
        math.log1p(n) if n else 0, rate(len(found)), len({words[k] for k, _ in found}), rate(sum(x for _, x in found)), top[0], top[1], rate(near), rate(len(you)),
        sum(unicodedata.category(c) == "Lu" for c in text) / max(1, len(letters)), rate(sum(w.isupper() for w in text.split())),
        sum(c in "!?" for c in text) / size, sum(unicodedata.category(c)[0] == "P" for c in text) / size, sum(unicodedata.category(c)[0] == "N" for c in text) / size,
        rate(len(hidden)), rate(sum(x > 0 for _, x in hidden)),
    ]


def test_features_are_brute_force():
    rng = random.Random(10)
    lexicon = {"idiot": 5.0, "grob*": 4.0, "scum": 3.5}
    words = ["idiot", "1d1ot!", "You", "you,", "grobnak", "plain", "SCUM.", "a1b", "été", "É", "x#y", "yours", "12", "--", "sc*um", "tu"]
    texts = ["", " \n", "x" * 5000] + [rng.choice([" ", "\n", "\u00a0"]).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    got = toxicity.features(texts, toxicity.Weights(lexicon), 4)
    for text, row in zip(texts, got.tolist()):
        assert row == pytest.approx(slow_features(text, lexicon, 4)), text
