"""What a pattern recognises once reaches all repeats, however many and however far."""

import itertools

import numpy as np

from gridloom.llm import pii


def test_every_repeat_is_labelled():
    text = "call +1 (545) 555-2355 now." + " later 5455552355 was seen ." * 60
    found, model = pii.nodes(text), pii.SkipChain(pii.fitted().chain, 2.0)
    assert set(model.labels(text, found, pii.base_spans(text))) == {pii.KINDS.index("phone")}


def test_two_of_a_kind_are_two_links_apart():
    links = pii.skip_links(["5455552355"] * 50)
    assert len(links) == 50 and {b for _, b in links} == {50}


def test_silence_is_what_messages_would_say():
    model = pii.fitted()
    rng = np.random.default_rng(4)
    words = ["1999", "(545)", "555-2355", "5455552355", "12.5", "call", "of", "tel", "4111111111111111", "page", "77777", "1.2.3.4", "a1", "+1"]
    for _ in range(300):
        text = " ".join(rng.choice(words, 8))
        found, base = pii.nodes(text), pii.base_spans(text)
        always = type(model)(model.chain, model.skip)
        always._clear = lambda *a: False
        if found:
            assert model.labels(text, found, base) == always.labels(text, found, base)


def _exact(scores, chain, pair, skips, skip):
    """Marginals, and log likelihoods of labellings, by summing over all labellings of nodes and hubs."""
    n, labels = scores.shape
    hubs = max((b + 1 - n for _, b in skips), default=0)
    out, total = np.zeros((n, labels)), -np.inf
    value = lambda ys: sum(scores[k][ys[k]] for k in range(n)) + sum(pair[ys[a], ys[b]] for a, b in chain) + sum(skip * (ys[a] == ys[b]) for a, b in skips)
    for ys in itertools.product(range(labels), repeat=n + hubs):
        w = value(ys)
        total = np.logaddexp(total, w)
        for k in range(n):
            out[k, ys[k]] += np.exp(w)
    return out / out.sum(axis=1, keepdims=True), lambda ys: value(ys) - total


def test_marginals_are_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(6)
    for _ in range(20):
        scores, pair, skip = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), float(rng.uniform(0.2, 2))
        for chain, skips, most in (([(0, 1), (2, 3)], [(1, 5), (2, 5), (4, 5)], 1e-3), ([], [(0, 5), (1, 5), (1, 6), (3, 6)], 1e-3), ([(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 5), (4, 5)], 0.12)):
            got = pii.marginals(scores, chain, pair, skips, skip, settled=1e-7)
            assert np.abs(got - _exact(scores, chain, pair, skips, skip)[0]).max() < most


def test_slopes_of_all_potentials():
    """Seen less expected counts are the slopes of the exact log likelihood, on a document without loops."""
    sample = pii.Sample([("call 5455552355 or . see 5455552355 of it . on 1999 now", [3, 3, 4])])
    rng = np.random.default_rng(1)
    scores, pair, skip = rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), 0.7
    assert len(sample.skips) == 2 and not sample.chain or len(sample.chain) <= 2
    graph = sample.graph
    tables, messages = graph.tables(pair, skip), graph.start()
    for _ in range(50):
        messages = graph.sent(scores, tables, messages)
    node, pairs, ties = sample.slopes(pair, skip, scores, messages)
    ys = [*sample.gold, *sample.hub_gold[graph.real :]]

    def loss(scores, pair, skip):
        return _exact(scores, sample.chain, pair, sample.skips, skip)[1](ys)

    step = 1e-4
    assert abs((loss(scores, pair, skip + step) - loss(scores, pair, skip - step)) / (2 * step) - ties) < 1e-3
    for at in np.ndindex(scores.shape):
        up, down = scores.copy(), scores.copy()
        up[at], down[at] = up[at] + step, down[at] - step
        assert abs((loss(up, pair, skip) - loss(down, pair, skip)) / (2 * step) - node[at]) < 1e-3
    up = pair.copy()
    up[3, 4] += step
    assert abs((loss(scores, up, skip) - loss(scores, pair, skip)) / step - pairs[3, 4]) < 1e-2


def test_the_fitted_weight_carries_over_repeats():
    model = pii.fitted()
    assert model.skip > 1
    text = "call +1 (545) 555-2355 now." + " later 5455552355 was seen ." * 60
    assert len(pii.scan_text(text, model)[1]) == 61
    assert pii.scan_text("later 5455552355 was seen . " * 60, model)[1] == []
    docs = pii.labelled_documents()
    wrong = [t for t, ys in docs if model.labels(t, pii.nodes(t), pii.base_spans(t)) != ys]
    assert len(wrong) <= len(docs) // 50


def test_marginals_that_op5_uses_are_exact():
    """Whole texts, features of likeness included: labels are those of sums over all labellings."""
    model = pii.fitted()
    for text in ("call +1 (545) 555-2355 or 5455552355", "card 4111111111111111 then 4111-1111-1111-1111", "bob99@localhost and bob99@intern"):
        found, base = pii.nodes(text), pii.base_spans(text)
        kinds = pii._kinds(found, base)
        follows = [k > 0 and found[k][0] - found[k - 1][1] <= 2 for k in range(len(found))]
        skips = pii.skip_links([text[a:b] for a, b in found])
        alike = pii.likenesses(kinds, skips)
        scores = model.chain.scores([pii.node_features(text[a:b], text[max(0, a - pii.CONTEXT) : a], f, k) + more for (a, b), f, k, more in zip(found, follows, kinds, alike)])
        chain = [(k - 1, k) for k in range(1, len(found)) if follows[k]]
        want = _exact(scores, chain, model.chain.pair, skips, model.skip)[0].argmax(axis=1).tolist()
        assert model.labels(text, found, base) == want


def test_likeness_needs_a_recognised_one():
    assert pii.likenesses([None, None], [(0, 2), (1, 2)]) == [[], []]
    assert pii.likenesses(["phone", None, None], [(0, 3), (1, 3), (1, 4), (2, 4)]) == [[], [pii._AT["like_phone"]], [pii._AT["like_phone"]]]


def test_long_texts_of_many_spans_take_linear_time():
    import time

    model = pii.fitted()
    line = "host 10.0.0.1 was down . card {} of it\n"
    make = lambda n: "".join(line.format(4000000000000000 + k * 37) for k in range(n))
    began = time.monotonic()
    pii.scan_text(make(300), model)
    one = time.monotonic() - began
    began = time.monotonic()
    assert len(pii.scan_text(make(4800), model)[0]) >= 4800
    assert time.monotonic() - began < 70 * one
