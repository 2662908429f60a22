"""Very long texts hold no features but their own."""

import numpy as np
import pyarrow as pa

from docquarry.llm import toxicity
from docquarry.llm.words import split


def test_long_text_without_features_scores_like_an_empty_one():
    rng = np.random.default_rng(31)
    word = lambda signs: "".join(rng.choice(list(signs), 9))
    plain, bad = [word("abcdefgh") for _ in range(300)], [word("ijklmnop") for _ in range(60)]
    texts = [" ".join([*rng.choice(plain, 60), *(rng.choice(bad, 8) if i % 3 == 0 else [])]) for i in range(600)]
    y = np.stack([np.arange(600) % 3 == 0] * 2, axis=1)
    chain = toxicity.fit(texts, y)
    assert len(chain.known) > 50
    long = " ".join(f"{x:010d}" for x in rng.choice(10**10, 60_000, replace=True))
    s = split(pa.array([long, "", long + " " + " ".join(bad)], pa.large_string()))
    doc, at = toxicity.present(s, chain.known)
    p = chain.score(doc, at, 3)
    assert (doc != 0).all() and (p[0] == p[1]).all() and p[2, 1] >= chain.threshold > p[0, 1]
