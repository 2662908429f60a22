"""Classes and numbers of links against all pairs, both ways."""

import itertools

import numpy as np
import pytest

from docquarry.llm import neardup


def brute(spark, docs):
    """{(doc_id, row): (class, links)} from all pairs of signatures."""
    sigs = {(r.doc_id, r.row): None if r.sig is None else np.frombuffer(bytes(r.sig), np.uint16) for r in neardup.signatures(docs).collect()}
    root = {k: k for k in sigs}
    links = dict.fromkeys(sigs, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([k for k, s in sigs.items() if s is not None], 2):
        if (sigs[a] != sigs[b]).sum() <= neardup.RADIUS:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((k[0], find(k)[0], links[k]) for k in sigs)


def found(docs):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.near_classes(docs).collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for _ in range(12):
        own = [word() for _ in range(80)]
        for copies in (3, 2, 1):
            text = list(own)
            for at in rng.choice(80, 3, replace=False):
                text[at] = word()
            rows += [(len(rows) + i, " ".join(text)) for i in range(copies)]
    # One long chain: neighbours are near, the ends are not.
    text = [word() for _ in range(90)]
    for i in range(30):
        text[(i * 7) % 90], text[(i * 7 + 3) % 90] = word(), word()
        rows.append((1000 - i, " ".join(text)))
    # A hot group of slightly different texts.
    own = [word() for _ in range(60)]
    for i in range(90):
        text = list(own)
        for at in rng.choice(60, 1 + i % 5, replace=False):
            text[at] = word()
        rows.append((2000 + i, " ".join(text)))
    rows += [(2000, "another text of the same identifier"), (2001, rows[-1][1]), (None, own[0]), (3000, None), (3001, ""), (3002, "... !!!"), (3003, "one"), (3004, "One!"), (3003, "one")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("tile", [2048, 7])
def test_classes_and_links_are_those_of_all_pairs(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    want = brute(spark, docs)
    assert max(n for *_, n in want) > 60 and sum(n > 0 for *_, n in want) > 150
    assert found(docs) == want


def test_a_shared_key_for_every_pair_within_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(300):
        differ = np.zeros((1, neardup.POSITIONS), bool)
        differ[0, rng.choice(neardup.POSITIONS, rng.integers(0, neardup.RADIUS + 1), replace=False)] = True
        p = int(neardup.first_shared(differ)[0])
        shared = [q for c in neardup.chunks() for q in c if differ[0, [x for x in c if x != q]].sum() == 0]
        assert p == min(shared)


def test_one_document_of_each_class_stays(spark, docs):
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns
    want = brute(spark, docs)
    ids = [r.doc_id for r in kept.collect()]
    assert {2000 + i for i in range(1, 90)}.isdisjoint(ids) and ids.count(2000) == 2 and None in ids and ids.count(3003) == 2 and 3004 not in ids
    assert len({c for _, c, _ in want}) == len(set(ids) - {None})
