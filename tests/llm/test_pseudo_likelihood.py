import math

import numpy as np
import pytest

from sessionlake.llm import pseudo_likelihood as pl

RULE = pl.Rule(own=96, shared=32, classes=8, dim=12, stride=1, rounds=4, batch=256, buckets=1 << 12)


@pytest.fixture(scope="module")
def cut(documents):
    return pl.bucketed(documents, RULE).cache()


@pytest.fixture(scope="module")
def model(cut):
    token = pl.vocabulary(pl.bucket_counts(cut, RULE), RULE)
    return pl.train(cut, token, RULE), token


def test_bucket_counts_cover_the_corpus(cut, texts):
    found = {r["bucket"]: r["n"] for r in pl.bucket_counts(cut, RULE).collect()}
    plain = {}
    for t in texts.values():
        for w in t.lower().split():
            b = pl._bucket(w, RULE)
            plain[b] = plain.get(b, 0) + 1
    assert found == plain


def test_probabilities_sum_to_one(model):
    net = pl.Net(model[0], RULE)
    contexts = np.array([[1, 5], [RULE.tokens, 9], [3, 3], [100, RULE.tokens]], dtype=np.int32)
    total = np.zeros(2)
    for t in range(RULE.tokens):
        total += np.exp(net.log_probs(np.array([t, t]), contexts))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradient_against_differences():
    rule = pl.Rule(own=14, shared=2, classes=4, dim=5, side=1)
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pl.new_weights(rule).items()}
    ids, contexts = rng.integers(0, 16, 20), rng.integers(0, 17, (2, 20))
    loss = lambda w: -pl.Net(w, rule).log_probs(ids, contexts).mean()
    before = {k: v.copy() for k, v in w.items()}
    sums = {k: np.full_like(v, 1e8) for k, v in w.items()}  # so large that a step is rate * gradient / 1e4
    pl.step(w, sums, ids, contexts, rule)
    for k in ("emb", "mix", "bias", "w1", "w2"):
        at = tuple(rng.integers(0, s) for s in before[k].shape) if k != "emb" else (int(contexts[0, 0]), 2)
        up = {n: v.copy() for n, v in before.items()}
        up[k][at] += 1e-4
        slope = (loss(up) - loss(before)) / 1e-4
        assert abs((before[k][at] - w[k][at]) * 1e4 / rule.rate - slope) < 2e-3 + 0.02 * abs(slope), k


def test_scores_against_brute_force(cut, texts, model):
    w, token = model
    net = pl.Net(w, RULE)
    found = {}
    for frame, ids, ends in pl._batches(iter([cut.toPandas()]), token, RULE):
        p = net.log_probs(ids, pl._contexts(ids, ends, RULE))
        found |= dict(zip(frame["doc_id"], np.diff(np.concatenate(([0.0], np.cumsum(p)))[ends], prepend=0.0)))
    for doc in sorted(texts)[:8]:
        t = [int(token[pl._bucket(x, RULE)]) for x in texts[doc].lower().split()]
        total = 0.0
        for i in range(min(len(t), 4000)):
            near = [t[i + o] if 0 <= i + o < len(t) else RULE.tokens for o in (-2, -1, 1, 2)]
            h = np.tanh(sum(w["emb"][x] @ m for x, m in zip(near, w["mix"])) + w["bias"])
            for z, at in ((h @ w["w1"] + w["b1"], t[i] % RULE.classes), (h @ w["w2"][t[i] % RULE.classes] + w["b2"][t[i] % RULE.classes], t[i] // RULE.classes)):
                total += float(z[at]) - math.log(sum(math.exp(float(x)) for x in z))
        assert abs(total - found[doc]) < 1e-3 * abs(total) + 1e-3


def test_better_than_word_frequencies(cut, model):
    w, token = model
    (_, ids, ends), = pl._batches(iter([cut.toPandas()]), token, RULE)
    p = np.bincount(ids, minlength=RULE.tokens) / len(ids)
    assert pl.Net(w, RULE).log_probs(ids, pl._contexts(ids, ends, RULE)).mean() > np.log(p[ids]).mean()


def test_awkward_rows(awkward, nothing):
    found = {r["doc_id"]: r for r in pl.scored(awkward, RULE).collect()}
    assert (found[3]["n_tokens"], found[3]["log_prob"], found[3]["mean_log_prob"]) == (0, 0.0, None)
    assert found[8]["n_tokens"] == 30_000 and found[8]["log_prob"] < 0
    assert pl.scored(awkward, RULE).count() == awkward.count()
    assert pl.scored(nothing, RULE).count() == 0


def test_the_rounds_train_on_every_position():
    rule = pl.Rule()
    for n in (1, 5, 1001):
        assert set(np.concatenate([pl.picked(n, at, rule) for at in range(rule.rounds)]).tolist()) == set(range(n))
    with pytest.raises(ValueError):
        pl.Rule(rounds=2, stride=16)
