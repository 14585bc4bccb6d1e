import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tillflow.llm.gumbel_lattice import Run, Sampling, Vocabulary, decoded, sampled

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def words():
    return Vocabulary(MODEL, 1.0)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def segmentations(text, model, pieces):
    """All segmentations of a text with their probabilities, by recursion."""

    def walk(rest):
        if not rest:
            yield (), 0.0
        for j in range(1, len(rest) + 1):
            if rest[:j] in pieces:
                i = model.piece_to_id(rest[:j])
                for tail, weight in walk(rest[j:]):
                    yield (i, *tail), weight - math.log1p(-model.get_score(i))

    every = dict(walk("▁" + text.replace(" ", "▁")))
    total = math.log(sum(map(math.exp, every.values())))
    return {ids: w - total for ids, w in every.items()}


@pytest.mark.parametrize("text", ["hello", "a nt", " the  in"])
def test_samples_follow_the_distribution_without_replacement(words, model, text):
    pieces = {model.id_to_piece(i) for i in range(259, model.get_piece_size())}
    truth = segmentations(text, model, pieces)
    n = 20000
    run = Run([text] * n, [str(i) for i in range(n)], words)
    first, both = Counter(), Counter()
    for found, after in run.samples(2):
        ids = [tuple(run.ids(path, words).tolist()) for path, _, _ in found]
        assert len(set(ids)) == len(ids)
        for own, (_, logp, _) in zip(ids, found):
            assert logp == pytest.approx(truth[own], abs=1e-9)
        assert [v for *_, v in found] == sorted((v for *_, v in found), reverse=True)
        assert found[-1][2] >= after
        first[ids[0]] += 1
        both[tuple(ids)] += 1
    for own, logp in truth.items():
        p = math.exp(logp)
        assert abs(first[own] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    for (x, y), count in both.items():
        p = math.exp(truth[x]) * math.exp(truth[y]) / (1 - math.exp(truth[x]))
        assert abs(count / n - p) < 6 * math.sqrt(p / n) + 1e-3


def test_inclusion_is_unbiased(words, model):
    """Inverse inclusion weights add up to the number of segmentations, on average."""
    pieces = {model.id_to_piece(i) for i in range(259, model.get_piece_size())}
    truth = segmentations("ant", model, pieces)
    n, k, totals = 6000, 3, []
    for found, after in Run(["ant"] * n, [f"k{i}" for i in range(n)], words).samples(k):
        weights = [math.exp(lp) / -math.expm1(-math.exp(lp - after)) for _, lp, _ in found]
        totals.append(sum(weights))
    assert len(truth) > k and np.mean(totals) == pytest.approx(1.0, abs=0.03)


def test_more_samples_than_there_are(words):
    (found, after), (none, end) = Run(["a", ""], ["1", "2"], words).samples(50)
    assert len(found) == len({p.tobytes() for p, _, _ in found}) < 50
    assert after == end == -math.inf and len(none) == 1
    assert sum(math.exp(lp) for _, lp, _ in found) == pytest.approx(1.0)


@pytest.mark.parametrize("text", ["a  b é漢😀\nx", "\x00\x7f ", "ab" * 3000, "w" * 9000, "▁x▁", "  "])
def test_round_trip(words, model, text):
    run = Run([text, "other"], ["1", "2"], words)
    for path, _, _ in run.samples(3)[0][0]:
        ids = run.ids(path, words).tolist()
        assert decoded(ids, words) == text.replace("▁", " ") == model.decode(ids)


def test_texts_do_not_depend_on_their_neighbours(words):
    alone = Run(["one two three"], ["7"], words)
    among = Run(["x y", "one two three", "zzz"], ["1", "7", "3"], words)
    a, b = alone.samples(4)[0], among.samples(4)[1]
    assert a[1] == b[1] and [x[1:] for x in a[0]] == [x[1:] for x in b[0]]
    assert [alone.ids(p, words).tolist() for p, *_ in a[0]] == [among.ids(p, words).tolist() for p, *_ in b[0]]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sampled(docs, Sampling(MODEL, samples=3)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == {r.doc_id for r in docs.collect()}
    for own in by_doc.values():
        assert [r.sample for r in sorted(own, key=lambda r: -r.perturbed)] == list(range(1, len(own) + 1))
        assert len({bytes(r.ids) for r in own}) == len(own) and all(r.round_trip for r in own)
        assert all(0 <= r.inclusion <= 1 and 4 * r.n_pieces == len(r.ids) for r in own)
    again = sampled(docs.repartition(7), Sampling(MODEL, samples=3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_odd_rows(odd, repeated):
    found = sampled(odd, Sampling(MODEL)).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in odd.collect()}
    assert all(r.round_trip for r in found)
    assert sampled(repeated, Sampling(MODEL)).count() == 2 * len(found) + len(
        sampled(odd.limit(3), Sampling(MODEL)).collect()
    )
    assert sampled(odd.limit(0), Sampling(MODEL)).count() == 0
