"""Language sums over the whole vocabulary, and over runs longer than one step."""

import math
import sys

import numpy as np
import pytest
import sentencepiece

from cutledger.llm import language

PATH = language.vocabulary_path()
#: Long pieces, words that hold them, and runs without blanks whose pieces span the steps.
WORDS = ["▁something", "▁different", "▁information", "formation", "▁x" + "something" * 30, "▁" + "日本語の" * 40 + "information" * 9, "▁" + "z" * 63, "▁" + "z" * 64, "▁" + "information" * 300]


@pytest.fixture(scope="module")
def every_piece():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


@pytest.fixture(scope="module")
def place(every_piece):
    """Each piece's place in the model."""
    at = {int(h): i for i, h in enumerate(language.pieces(PATH)[0])}
    return {x: at[int(language._prefix_sums(language._codes([x], len(x)))[0, -1])] for x in every_piece}


def chances(word, p, place, i, j):
    """Probability of word[i:j] as one piece."""
    q = p[place[word[i:j]]] if word[i:j] in place else 0.0
    return max(q, language.UNKNOWN) if j == i + 1 else q


def logs(word, p, place):
    """Logs of the sums up to each character, by a plain loop in logarithms."""
    out = [0.0]
    for j in range(1, len(word) + 1):
        terms = [out[i] + math.log(q) for i in range(j) if (q := chances(word, p, place, i, j))]
        top = max(terms)
        out.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return out


def test_the_vocabulary_is_whole(every_piece):
    _, lengths = language.pieces(PATH)
    assert len(lengths) == len(every_piece) and lengths.max() == max(map(len, every_piece)) == language.LONGEST
    assert {"▁something", "▁different", "▁information", "formation"} <= every_piece


def test_sums_use_every_piece_and_cross_the_steps(place):
    p = np.random.default_rng(4).random((len(place), 2))
    p /= p.sum(axis=0)
    words = WORDS[:-1]
    got = language.log_likelihoods(PATH, words, p)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(logs(w, p[:, k], place)[-1], rel=1e-9)


@pytest.mark.parametrize("together", [1, 100_000])
def test_expected_counts_of_long_runs(place, monkeypatch, together):
    monkeypatch.setattr(language, "TOGETHER", together)
    p = np.random.default_rng(5).random(len(place))
    p /= p.sum()
    words, counts = WORDS[:-2], np.arange(1.0, len(WORDS) - 1)
    want = np.zeros(len(place))
    for w, c in zip(words, counts, strict=True):
        ahead, behind = logs(w, p, place), logs_back(w, p, place)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 16) + 1):
                if w[i:j] in place:
                    want[place[w[i:j]]] += c * math.exp(ahead[i] + math.log(chances(w, p, place, i, j)) + behind[j] - ahead[-1])
    assert language.expected(PATH, words, counts, p) == pytest.approx(want, rel=1e-8, abs=1e-12)


def logs_back(word, p, place):
    out = [0.0] * (len(word) + 1)
    for i in reversed(range(len(word))):
        terms = [math.log(q) + out[j] for j in range(i + 1, len(word) + 1) if (q := chances(word, p, place, i, j))]
        top = max(terms)
        out[i] = top + math.log(sum(math.exp(x - top) for x in terms))
    return out


def test_scores_of_a_text_do_not_depend_on_what_is_remembered(place):
    p = np.random.default_rng(6).random((len(place), 3))
    text = " ".join(w[1:] for w in WORDS if w.startswith("▁")) * 2
    want = sum(language.log_likelihoods(PATH, [w], p)[0] for w in language.signed_words(text))
    for most in (3, 250_000):
        scorer = language.Scorer(PATH, p, most=most)
        for _ in range(2):
            assert scorer([text])[0] == pytest.approx(want)
    assert all(len(w) <= language.WORD for w in scorer.known) and sys.getsizeof(scorer.known) < 1e6
