"""Personal data: fixed patterns, and a skip-chain CRF that adds what they miss.

Nodes are the tokens with a digit or an at sign. A node's own potential comes from a linear-chain
CRF's features, neighbouring nodes share its transition potentials, and distant tokens that
repeat or resemble each other (same digits, or the same last digits) share a skip potential that
favours equal labels. Sum-product message passing over the loopy graph gives every node's
marginals, so that an entity which a pattern recognises in one place is labelled the same where
it is written in another way. Tokens that repeat or resemble each other are tied to one hub node
of what they share, without a score of its own, so that any two of them are two links apart. A node
that lies in no pattern's span, but is tied, over however many hubs, to one that does, has a feature for the
kind of that span: any number of mentions without a cue then weighs nothing against the one that has it.
Messages are sent until they settle. Where no pattern has a span, and every node's own score is
so clear that no neighbour could turn it, whatever its label, none are sent.

Weights are fitted on a small labelled table that this module makes: first those of the chain alone,
then all together, the skip potential included, on the graphs of whole documents, whose marginals are
those of the messages. Spans of the patterns always stay; a run of nodes with one label that touches
none of them is added under its label's kind.

Cases: a null or empty text has no spans; spans are in code points, ends exclusive; repeated rows
are scanned alike; clashing input columns are replaced; an empty table stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .crf import LinearChain, apart, logsumexp

KINDS = ["email", "ip", "card", "phone"]
OTHER = len(KINDS)

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- nodes and their features ---------------------------------------------------------------

_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
FEATURES = [
    "bias", "at_sign", "at_word", "dots3", "decimal", "digits4", "digits3", "digits7", "digits10_11", "digits13_19", "digits_many",
    "digits1_2", "letters", "dashes", "parens", "plus", "luhn", "phone_word", "card_word", "mail_word", "ip_word", "other_word",
    "first_of_row", "money", "in_email", "in_ip", "in_card", "in_phone", "like_email", "like_ip", "like_card", "like_phone",
]
_AT = {f: k for k, f in enumerate(FEATURES)}
_WORDS = {
    "phone_word": {"phone", "call", "tel", "mobile", "fax", "cell", "telephone", "whatsapp", "telefon", "reach", "dial"},
    "card_word": {"card", "visa", "credit", "debit", "mastercard", "amex", "karte", "carte", "tarjeta", "pan"},
    "mail_word": {"mail", "email", "contact", "write", "correo", "courriel"},
    "ip_word": {"ip", "host", "server", "address", "ping", "from"},
    "other_word": {"version", "page", "chapter", "order", "invoice", "year", "section", "license", "isbn", "no", "apache", "gpl", "table", "figure", "token", "commit"},
}
CONTEXT = 40


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an at sign, without outer punctuation."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        at = end
        a, b = start, end
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def node_features(token: str, before: str, follows: bool, base: str | None) -> list[int]:
    """Active features of a node; ``base`` is the kind of the pattern's span that it lies in."""
    digits = re.sub(r"[^0-9]", "", token)
    n = len(digits)
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", before[-CONTEXT:])[-3:]}
    on = {
        "bias": True,
        "at_sign": "@" in token,
        "at_word": "@" in token and "." in token.partition("@")[2],
        "dots3": token.count(".") == 3 and n >= 4,
        "decimal": bool(re.fullmatch(r"[0-9]+[.,][0-9]*", token)),
        "digits4": token.isdigit() and n == 4,
        "digits3": n == 3,
        "digits7": n == 7,
        "digits10_11": n in (10, 11),
        "digits13_19": 13 <= n <= 19,
        "digits_many": n > 19,
        "digits1_2": n in (1, 2),
        "letters": any(c.isalpha() for c in token),
        "dashes": "-" in token,
        "parens": token.startswith("("),
        "plus": token.startswith("+"),
        "luhn": 13 <= n <= 19 and luhn(digits),
        "first_of_row": not follows,
        "money": before[-1:] in "$€£" and bool(before),
        **{k: bool(words & v) for k, v in _WORDS.items()},
        **{f"in_{k}": base == k for k in KINDS},
    }
    return [_AT[f] for f, yes in on.items() if yes]


def skip_links(tokens: list[str]) -> list[tuple[int, int]]:
    """Pairs of a node and a hub, which has a number from ``len(tokens)``.

    A hub holds the nodes that share a key; keys with the same nodes have one hub.
    """
    members: dict[tuple[str, str], list[int]] = {}
    for k, token in enumerate(tokens):
        digits = re.sub(r"[^0-9]", "", token)
        keys = [("word", token.lower())] if "@" in token or len(digits) >= 4 else []
        if len(digits) >= 7:
            keys += [("digits", digits), ("tail", digits[-7:])]
        if "@" in token:
            keys.append(("local", token.lower().partition("@")[0]))
        for key in keys:
            members.setdefault(key, []).append(k)
    groups = dict.fromkeys(tuple(ks) for ks in members.values() if len(ks) > 1)
    return [(k, len(tokens) + h) for h, ks in enumerate(groups) for k in ks]


#: Rounds after which messages that have not settled are damped more, and the share of new ones that is tried last.
SLOWER = 200
LEAST_SHARE = 1e-3


# --- inference ----------------------------------------------------------------------------------


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1)


def _groups(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    """The connected component of each of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(n)])


class Graph:
    """Nodes in chains, and hubs that tie distant ones; messages run along both kinds of links."""

    def __init__(self, n: int, chain: list[tuple[int, int]], skips: list[tuple[int, int]], labels: int):
        links = chain + skips
        self.real, self.chain, self.skips, self.labels = n, len(chain), len(skips), labels
        self.n = n + max((b + 1 - n for _, b in skips), default=0)
        self.src = np.array([a for a, _ in links] + [b for _, b in links], int)
        self.dst = np.array([b for _, b in links] + [a for a, _ in links], int)
        self.opposite = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])

    def tables(self, pair: np.ndarray, skip: float) -> np.ndarray:
        same = np.eye(self.labels) * skip
        return np.array([pair] * self.chain + [same] * self.skips + [pair.T] * self.chain + [same] * self.skips).reshape(-1, self.labels, self.labels)

    def beliefs(self, scores: np.ndarray, messages: np.ndarray) -> np.ndarray:
        every = np.concatenate([scores, np.zeros((self.n - self.real, self.labels))])
        return every + _summed(self.dst, messages, self.n) if len(messages) else every

    def sent(self, scores: np.ndarray, tables: np.ndarray, messages: np.ndarray) -> np.ndarray:
        """The messages that follow from those of the round before."""
        belief = self.beliefs(scores, messages)
        out = logsumexp((belief[self.src] - messages[self.opposite])[:, :, None] + tables, 1)
        return out - logsumexp(out, 1)[:, None]

    def start(self) -> np.ndarray:
        return np.full((len(self.src), self.labels), -np.log(self.labels))

    def joint(self, scores: np.ndarray, tables: np.ndarray, messages: np.ndarray) -> np.ndarray:
        """Marginals of the two ends of every link, chain links first."""
        half = len(self.src) // 2
        apart = self.beliefs(scores, messages)[self.src] - messages[self.opposite]
        both = apart[:half, :, None] + apart[half:, None, :] + tables[:half]
        return np.exp(both - logsumexp(both.reshape(half, -1), 1)[:, None, None])


def marginals(scores: np.ndarray, chain: list[tuple[int, int]], pair: np.ndarray, skips: list[tuple[int, int]], skip: float, settled: float = 1e-4) -> np.ndarray:
    """Label marginals by loopy sum-product messages along chain and skip edges, until no message moves by ``settled``.

    New messages are damped by half, and by more after every ``SLOWER`` rounds that do not settle, so that loops
    that swing come to rest; they are left where they are only if they would still swing at a share of ``LEAST_SHARE``.
    """
    graph = Graph(len(scores), chain, skips, scores.shape[1])
    tables, messages, share = graph.tables(pair, skip), graph.start(), 0.5
    for k in itertools.count(1):
        if not len(messages):
            break
        out = graph.sent(scores, tables, messages)
        moved = np.abs(out - messages).max()
        messages = (1 - share) * messages + share * out
        if moved <= settled or share < LEAST_SHARE:
            break
        if k % SLOWER == 0:
            share *= 0.7
    belief = graph.beliefs(scores, messages)[: graph.real]
    return np.exp(belief - logsumexp(belief, 1)[:, None])


def _kinds(found: list[tuple[int, int]], base: list[Span]) -> list[str | None]:
    """The kind of the pattern's span that each node lies in."""
    out: list[str | None] = []
    at = 0
    for a, b in found:
        while at < len(base) and base[at][1] <= a:
            at += 1
        out.append(next((k for x, y, k in base[at : at + 4] if x < b and a < y), None))
    return out


def likenesses(kinds: list[str | None], skips: list[tuple[int, int]]) -> list[list[int]]:
    """For each node the features of the kinds of pattern that nodes tied to it lie in, if it lies in none itself."""
    out: list[list[int]] = [[] for _ in kinds]
    if not skips or not any(kinds):
        return out
    group = _groups(max(h for _, h in skips) + 1, skips)
    known: dict[int, set[str]] = {}
    for k, _ in skips:
        if kinds[k] is not None:
            known.setdefault(int(group[k]), set()).add(kinds[k])
    for k in {k for k, _ in skips if kinds[k] is None}:
        out[k] = sorted(_AT[f"like_{kind}"] for kind in known.get(int(group[k]), ()))
    return out


class SkipChain:
    """A fitted chain with the weight of its skip edges."""

    def __init__(self, chain: LinearChain, skip: float):
        self.chain, self.skip = chain, skip

    def labels(self, text: str, found: list[tuple[int, int]], base: list[Span]) -> list[int]:
        """Each node's label of the largest marginal."""
        kinds = _kinds(found, base)
        follows = [k > 0 and found[k][0] - found[k - 1][1] <= 2 for k in range(len(found))]
        chain = [(k - 1, k) for k in range(1, len(found)) if follows[k]]
        skips = skip_links([text[a:b] for a, b in found])
        alike = likenesses(kinds, skips)
        scores = self.chain.scores([node_features(text[a:b], text[max(0, a - CONTEXT) : a], f, k) + more for (a, b), f, k, more in zip(found, follows, kinds, alike)])
        if self._clear(scores, follows, skips):
            return [OTHER] * len(found)
        # The chain's first-label weights are in the features; its rows begin anywhere.
        return marginals(scores, chain, self.chain.pair, skips, self.skip).argmax(axis=1).tolist()

    def _clear(self, scores: np.ndarray, follows: list[bool], skips: list[tuple[int, int]]) -> bool:
        """Whether every node is OTHER whatever it is told.

        A message is a weighted mean over the sender's labels, so it cannot favour a label over OTHER by more than the
        link's potentials do for the one sender's label that favours it most.
        """
        pair, linked = self.chain.pair, np.array([*follows, False])
        most = np.zeros(scores.shape)
        most += np.where(linked[:-1, None], (pair - pair[:, [OTHER]]).max(axis=0), 0)
        most += np.where(linked[1:, None], (pair - pair[[OTHER]]).max(axis=1), 0)
        most += self.skip * np.bincount(np.array([k for k, _ in skips], int), minlength=len(scores))[:, None]
        gap = scores[:, [OTHER]] - scores - most
        gap[:, OTHER] = np.inf
        return bool(gap.min() > 0)


def scan_text(text: str | None, model: SkipChain) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    found = nodes(text)
    if not found:
        return base, base
    labels = model.labels(text, found, base)
    more: list[Span] = []
    for k, ((a, b), y) in enumerate(zip(found, labels)):
        if y == OTHER:
            continue
        if k and labels[k - 1] == y and a - found[k - 1][1] <= 2 and more and more[-1][1] == found[k - 1][1]:
            more[-1] = (more[-1][0], b, KINDS[y])
        else:
            more.append((a, b, KINDS[y]))
    more = [s for s in apart(more, base) if _plausible(text[s[0] : s[1]], s[2])]
    return base, in_order(base + more) if more else base


def _plausible(token: str, kind: str) -> bool:
    """Whether a labelled run has the digits that its kind needs at the least."""
    n = sum(c.isdigit() for c in token)
    return {"email": "@" in token, "ip": n >= 4, "card": 13 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def labelled_table() -> list[tuple[str, list[int]]]:
    """Labelled texts with their nodes' labels, made from a fixed seed."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for _ in range(30):
        name = rng.choice(["anna", "j.doe", "info", "sales"]) + draw(2)
        phone, ip = draw(10), ".".join(str(rng.randrange(1, 256)) for _ in range(4))
        card = draw(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        rows += [
            (f"write to {name}@mail{draw(1)}.example.com today", [0]),
            (f"mail {name}@localhost now", [0]),
            (f"the host {ip} was", [1]),
            (f"paid with card {card} and", [2]),
            (f"paid with {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} and", [2, 2, 2, 2]),
            (f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} or", [3, 3, 3]),
            (f"call {phone[:3]}-{phone[3:6]}-{phone[6:]} or", [3]),
            (f"phone ({phone[:3]}) {phone[3:6]}-{phone[6:]}", [3, 3]),
            (f"in the year 19{draw(2)} and page {draw(2)}", [4, 4]),
            (f"version {draw(1)}.{draw(1)}. of it", [4]),
            (f"order {draw(8)} shipped {draw(3)} items", [4, 4]),
            (f"license {draw(1)}. see section {draw(1)}.{draw(1)}", [4, 4]),
            (f"it cost ${draw(3)}.{draw(2)} for {draw(4)} parts", [4, 4]),
            (f'token = "{draw(5)}ab{draw(9)}cd{draw(8)}" end', [4]),
            (f"values {draw(2)} {draw(3)} {draw(4)} {draw(2)}", [4, 4, 4, 4]),
            (f"number {draw(16)} of {draw(7)} and {draw(10)}", [4, 4, 4]),
            (f"the {draw(16)} in", [4]),
        ]
    return rows


def labelled_documents() -> list[tuple[str, list[int]]]:
    """Texts of the labelled table joined to documents: entities come again without their cue, and so do mere numbers."""
    rng = random.Random(8)
    table, out = labelled_table(), []
    for text, ys in table:
        base = base_spans(text)
        if len(base) == 1 and base[0][2] in ("phone", "card", "email") and KINDS.index(base[0][2]) in ys:
            a, b, kind = base[0]
            digits, label = re.sub(r"[^0-9]", "", text[a:b]), KINDS.index(kind)
            if kind == "email":
                again = [text[a:b].partition("@")[0] + "@intern"]
            elif kind == "phone":
                again = [digits[-10:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"]
            else:
                again = [digits, f"{digits[:4]}-{digits[4:8]}-{digits[8:12]}-{digits[12:]}"]
            times = rng.randint(1, 3)
            other, others = rng.choice(table)
            out.append((f"{text} . {other} . " + " . ".join(f"later {rng.choice(again)} was seen" for _ in range(times)), [*ys, *others, *[label] * times]))
        elif not base and OTHER in ys:
            out.append((f"{text} . {text} . {text}", ys * 3))
        else:
            out.append((text, ys))
    return out


class Sample:
    """Documents as one graph: the active features of all nodes, the links, and the right labels of nodes and hubs."""

    def __init__(self, docs: list[tuple[str, list[int]]]):
        rows: list[list[int]] = []
        chain: list[tuple[int, int]] = []
        skips: list[tuple[int, int]] = []
        gold, tied = [], []
        for text, ys in docs:
            found, at = nodes(text), len(rows)
            assert len(found) == len(ys), text
            kinds = _kinds(found, base_spans(text))
            follows = [k > 0 and found[k][0] - found[k - 1][1] <= 2 for k in range(len(found))]
            links = skip_links([text[a:b] for a, b in found])
            alike = likenesses(kinds, links)
            rows += [node_features(text[a:b], text[max(0, a - CONTEXT) : a], f, k) + more for (a, b), f, k, more in zip(found, follows, kinds, alike)]
            chain += [(at + k - 1, at + k) for k in range(1, len(found)) if follows[k]]
            tied += [(at + k, (at, h)) for k, h in links]
            gold += ys
        hubs = {h: len(rows) + k for k, h in enumerate(dict.fromkeys(h for _, h in tied))}
        skips = [(k, hubs[h]) for k, h in tied]
        self.dense = np.zeros((len(rows), len(FEATURES)))
        for row, active in zip(self.dense, rows):
            row[active] = 1
        self.gold, self.chain, self.skips = np.array(gold), chain, skips
        self.graph = Graph(len(rows), chain, skips, OTHER + 1)
        # A hub has the label of most of its nodes.
        of_hub = np.zeros((self.graph.n, OTHER + 1))
        for k, h in skips:
            of_hub[h, gold[k]] += 1
        self.hub_gold = of_hub.argmax(axis=1)

    def slopes(self, pair: np.ndarray, skip: float, scores: np.ndarray, messages: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Slopes of the log likelihood by label scores, pair weights and the skip weight: what is seen less what is expected."""
        labels, graph = OTHER + 1, self.graph
        belief = graph.beliefs(scores, messages)[: graph.real]
        node = np.eye(labels)[self.gold] - np.exp(belief - logsumexp(belief, 1)[:, None])
        joint = graph.joint(scores, graph.tables(pair, skip), messages)
        seen = np.zeros((labels, labels))
        for a, b in self.chain:
            seen[self.gold[a], self.gold[b]] += 1
        equal = sum(self.gold[k] == self.hub_gold[h] for k, h in self.skips)
        expected = np.trace(joint[graph.chain :], axis1=1, axis2=2).sum()
        return node, seen - joint[: graph.chain].sum(axis=0), float(equal - expected)


def fit_together(chain: LinearChain, sample: Sample, skip: float = 1.0, steps: int = 80, rounds: int = 6, rate: float = 0.05, l2: float = 2e-3) -> tuple[LinearChain, float]:
    """Move all potentials up the likelihood of whole documents; messages go on from step to step."""
    graph, n = sample.graph, len(sample.gold)
    weights = [chain.emit, chain.pair, np.array([skip])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    messages = graph.start()
    for step in range(1, steps + 1):
        emit, pair, tie = weights
        scores = sample.dense @ emit
        tables = graph.tables(pair, float(tie[0]))
        for _ in range(rounds):
            messages = 0.5 * messages + 0.5 * graph.sent(scores, tables, messages)
        node, pairs, ties = sample.slopes(pair, float(tie[0]), scores, messages)
        for w, g, (a, b) in zip(weights, (sample.dense.T @ node / n, pairs / n, np.array([ties / n])), moments):
            g = g - l2 * w / 10
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return chain, float(weights[2][0])


@functools.cache
def fitted() -> SkipChain:
    """The model fitted on the labelled table."""
    sequences = []
    for text, ys in labelled_table():
        found = nodes(text)
        base = base_spans(text)
        follows = [k > 0 and found[k][0] - found[k - 1][1] <= 2 for k in range(len(found))]
        for seen in (base, []):
            kind = [next((s[2] for s in seen if s[0] < b and a < s[1]), None) for a, b in found]
            rows = [node_features(text[a:b], text[max(0, a - CONTEXT) : a], f, k) for (a, b), f, k in zip(found, follows, kind)]
            cuts = [k for k in range(len(found)) if not follows[k]] + [len(found)]
            sequences += [(rows[a:b], ys[a:b]) for a, b in zip(cuts, cuts[1:])]
    chain = LinearChain(len(FEATURES), len(KINDS) + 1).fit(sequences)
    chain.emit[_AT["first_of_row"]] += chain.first
    return SkipChain(*fit_together(chain, Sample(labelled_documents())))


# --- the operator ----------------------------------------------------------------------------

_FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add counts of base spans by kind, their digest, and all spans to every row."""
    model = fitted()

    def compute(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in _FIELDS}
        for text in texts:
            base, spans = scan_text(text, model)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return map_texts(df, text_col, compute, _FIELDS, keep)
