"""The forward sums against a plain one over all segmentations, on long and unspaced words too."""

import base64
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import langid

LONG = [
    "antidisestablishmentarianism" * 2, "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft", "x" * 300, "=" * 77, "-" * 33 + "a" + "-" * 40,
    "我们今天讨论语言识别的方法和它的局限性因为没有空格的文字整个句子都是一个词", "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ" * 3, "ภาษาไทยไม่มีช่องว่างระหว่างคำจึงเป็นคำยาวมาก",
    "https://example.org/a/very/long/path?with=many&parameters=that&never=end#and-a-fragment", "0123456789abcdef" * 9, "aé" * 60, "}" * 64 + ");" * 20, "a", "é", "\x01",
    "ЭтоОченьДлинноеСловоБезПробелов" * 3, "GATTACA" * 40, "👍" * 30, "________________________________________________________________________", "لااااااااااااااااااااااااااااااااااااااااااا",
]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list(a), 5)) for _ in range(200)) for a in ("abcdefgh", "opqrstuv")] + [" ".join(LONG), " ".join(LONG[::-1])]
    return langid.fit(texts, ["en", "fr", "en", "fr"])


@pytest.fixture(scope="module")
def vocabulary(model):
    with open(langid.VOCABULARY, "rb") as f:
        raw = sorted({base64.b64decode(line.split()[0]) for line in f})
    at = np.r_[0, np.cumsum([len(p) for p in raw])]
    h = langid.Rolling(np.frombuffer(b"".join(raw), np.uint8)).of(at[:-1], at[1:])
    return {p: np.log(model.p[i]) - langid.TILT * len(p) for p, i in zip(raw, np.searchsorted(model.known.hashes, h).tolist())}


def plain(word, vocabulary, longest):
    """Log score under each language, by a forward pass in logarithms over every piece."""
    raw = (" " + word).encode()
    a = [np.zeros(2)] + [np.full(2, -np.inf)] * len(raw)
    for t in range(1, len(raw) + 1):
        for n in range(1, min(t, longest) + 1):
            lp = vocabulary.get(raw[t - n : t])
            if lp is not None:
                a[t] = np.logaddexp(a[t], a[t - n] + lp)
    return a[-1]


def test_all_pieces_take_part(model, vocabulary):
    assert len(vocabulary) == len(model.known.hashes) and model.known.longest == max(map(len, vocabulary)) > 30
    assert np.allclose(sum(np.exp(x) for x in vocabulary.values()), 1)


def test_scores_are_the_sums_over_all_segmentations(model, vocabulary):
    got = langid.Scorer(model).words(pa.array(LONG, pa.large_string()))
    want = np.array([plain(w, vocabulary, model.known.longest) for w in LONG])
    assert sum(len(w.encode()) > 32 for w in LONG) >= 15
    assert np.allclose(got, want, rtol=1e-9, atol=1e-7)


def test_plain_forward_is_the_enumeration(model, vocabulary):
    for word in ["the", "abcé", "    ", "--------"]:
        raw, total = (" " + word).encode(), np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(raw)]
            each = [vocabulary.get(raw[a:b]) for a, b in itertools.pairwise(at)]
            if all(x is not None for x in each):
                total += np.exp(sum(each))
        assert np.allclose(np.log(total), plain(word, vocabulary, model.known.longest))


def test_expected_counts(model, vocabulary):
    """Pieces cover every byte of the words once, whatever the segmentation, also past a rescaling."""
    words = pa.array(LONG, pa.large_string())
    lattice = langid.Lattice(words, model.known)
    weight = np.arange(1.0, len(LONG) + 1)
    count = lattice.expected(model.p[:, 0], weight)
    assert math.isclose((count * model.known.size).sum(), (weight * [len(w.encode()) + 1 for w in LONG]).sum(), rel_tol=1e-9)


def test_a_word_of_many_bytes(model):
    z = langid.Scorer(model).words(pa.array(["ab" * 40_000, "ab" * 20_000], pa.large_string()))
    assert np.isfinite(z).all() and np.allclose(z[0] / z[1], 2, rtol=1e-3)
