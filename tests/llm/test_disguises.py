"""The gate in front of the search loses nothing, and words cut into pieces are found."""

import numpy as np
import pyarrow as pa
import pytest

from bookloom.llm import toxicity

WORDS = "stupid worthless moron idiot loser pathetic".split()
PROSE = "you are a really go away letter hello under the green tree with some other friends at home".split()


@pytest.fixture(scope="module")
def scorer():
    text = " ".join((WORDS + PROSE) * 50)
    return toxicity.Scorer(toxicity.Restorer(toxicity.model(toxicity.trigram_vector(pa.array([text])))), {w: 2.0 + i for i, w in enumerate(WORDS)} | {"4:idio": 1.5, "5:worth": 1.6})


class Open(toxicity.Scorer):
    """Every span goes to the search."""

    def may(self, span):
        return True


def test_pieces_and_signs(scorer):
    for text, word in (("id!(ot", "idiot"), ("st|up!d", "stupid"), ("stu!p|d", "stupid"), ("worthl ess", "worthless"), ("worthles s", "worthless"), ("wor thl ess", "worthless"), ("m0r on", "moron"), ("wor7h le55", "worthless"), ("pa the tic", "pathetic"), ("MOR\nON", "moron"), ("l o s er.", "loser")):
        assert scorer.rows([f"hello {text} away"])[0, 0] == scorer.odds[word], text
    for text in ("worth the loss", "a letter on the tree", "mo the ron", "more on", "", "!|+(" * 9):
        assert scorer.rows([text])[0, 0] == (1.6 if text.startswith("worth") else 0), text


def test_the_gate_loses_nothing(scorer):
    """Random disguises: the same numbers as when every span is restored, though most spans are not."""
    r = np.random.default_rng(3)
    everything = Open(scorer.restorer, scorer.odds)
    signs = {"i": "1!|", "l": "1|", "o": "0", "s": "5$", "t": "7+", "e": "3", "a": "4@", "c": "("}
    passed = 0
    for _ in range(1500):
        word = str(r.choice(WORDS + PROSE))
        noisy = "".join(str(r.choice(list(signs[c]))) if c in signs and r.random() < 0.4 else c * (1 + (r.random() < 0.15)) for c in word)
        for _ in range(r.integers(0, 3)):
            at = r.integers(0, len(noisy) + 1)
            noisy = noisy[:at] + str(r.choice(list("!|+(.-_*"))) + noisy[at:]
        text = f"hello {noisy} away"
        assert (scorer.rows([text]) == everything.rows([text])).all(), text
        passed += scorer.may(noisy)
    assert 200 < passed < 1300


def test_skeletons():
    assert toxicity.skeletons("i!t") == {"it"} and toxicity.skeletons("c(") == {"c"} and toxicity.skeletons("a!b|c") == {"abc", "aibc", "abic", "aibic"}
    assert toxicity.skeletons("!" * 9) is None and toxicity.skeletons("h3llo w0rld") == {"heiowirid".replace("wirid", "worid")}
