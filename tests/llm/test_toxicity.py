"""Which words a toxic dictionary is trained on."""

import random

import numpy as np

from lodeseam.llm import toxicity


def test_longer_toxic_texts_do_not_make_ordinary_words_toxic():
    """Ordinary words are in more of the toxic documents, as those are longer; only the planted ones belong in the dictionary."""
    rnd = random.Random(6)
    letters = "bcdfghklmnprstvw"
    ordinary = ["".join(rnd.choices(letters, k=6)) for _ in range(50)]
    planted = ["qu" + "".join(rnd.choices("aeiou", k=6)) for _ in range(6)]

    def text(y):
        found = rnd.choices(ordinary, k=rnd.randrange(12, 32) if y else rnd.randrange(8, 28))
        return " ".join(found[:9] + rnd.sample(planted, y) + found[9:])

    rows = [(k % 3, text(y), y) for y, n in ((1, 500), (0, 1000)) for k in range(n)]
    model = toxicity.fit(rows, {0: 1.0, 1: 1.0}, 1 / 3)
    held = [w for w in ordinary if f" {w} ".encode() in model.toxic]
    assert not held and any(w.encode() in model.toxic for w in planted)
    score = model.scorer()
    toxic, clean = (np.array([score(text(y)) for _ in range(60)]) for y in (1, 0))
    assert (toxic[:, None] > clean).mean() > 0.98
