"""Secret scans: fixed patterns, and a linear-chain CRF that adds what they miss.

The words and tokens of a whole text are one chain, whose labels are the begin or inside of a
secret, or outside. Labels follow from a token's shape, the words before and after it, features of
the file and the label before, and are decoded by Viterbi. Plain rows (words in plain case and tokens of a
few characters, with no key or auth word before them) have one feature, ``plain``, and so one score. It is learned,
and ``plain_is_outside`` proves from the fitted weights that outside is their best label whatever stands beside
them. So between two of them the chain's best labels are those of the tokens there, with the weights of the steps
from and to outside; only such runs are decoded, which gives the labels of decoding the whole text. The CRF is fitted
on whole sentences, each in a file of prose and in one of code, of a small labelled table that this module
makes. Spans of the patterns always stay; spans of the CRF that touch none of them are added under the kind ``secret``.

Cases: a null or empty text has no spans; spans are in code points, ends exclusive; repeated
rows are scanned alike; clashing input columns are replaced; an empty table stays empty.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, other_columns, quoted
from .crf import LinearChain, apart

KINDS = ["assign", "access", "hex", "secret"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the CRF ---------------------------------------------------------------------------------

#: Tokens of fewer characters are plain unless a key or auth word stands before them.
SHORT = 6
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{SHORT},}}")
_SHORT_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{{3,{SHORT - 1}}}(?![A-Za-z0-9+/_=.~-])")
_DIGIT = re.compile(r"[0-9]")
#: A name and its value in one token, as in ``pwd=...``.
_PAIR = re.compile(r"(-{0,2}[A-Za-z][A-Za-z_.-]*=)(?=[^=])")
_CODE = re.compile(r"(?m)^[^\S\n]*+(?:export |const |let |var |[A-Za-z_]++\s*+[:=]|[#{}])")
#: Characters before and after a token that its features see.
CONTEXT = 48
BEGIN, OUTSIDE, INSIDE = range(3)
_WORD = re.compile(r"\w")

FEATURES = [
    "bias", "long20", "long32", "mixed_case", "digits_only", "digits_dots", "hex_only", "has_base64", "dashed_groups",
    "slashes", "has_dot", "high_entropy", "many_turns", "known_prefix", "key_word", "auth_word", "benign_word", "equals",
    "colon", "quoted", "at_before", "plus_before", "after_run", "code_file", "vowel_word", "underscored_words",
    "short", "no_digit", "one_case", "assigned", "bearer_before", "two_humps", "key_after", "benign_after", "quoted_after",
    "plain", "consonants", "short6", "digits4_5",
]
_AT = {f: k for k, f in enumerate(FEATURES)}

_KEY = {"key", "secret", "token", "passwd", "password", "pwd", "pass", "passphrase", "credential", "credentials", "apikey", "private", "access", "pin", "passcode"}
_AUTH = {"bearer", "basic", "auth", "authorization", "session", "cookie", "signature", "client", "webhook"}
_BENIGN = {"commit", "sha", "md5", "uuid", "guid", "checksum", "http", "https", "www", "version", "isbn", "order", "invoice", "file", "path", "date", "call", "tel", "card", "serial", "page"}
# Prefixes that issuers of keys document.
_PREFIX = re.compile(r"(?:sk|pk|rk)[-_](?:live|test|proj|ant)|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ|npm_|pypi-|SG\.|hf_|dop_v1_|shpat_|ya29\.")


_SIGNAL = _KEY | _AUTH
_NAMED = _KEY - {"private", "access"}
_SIGNALS = re.compile("|".join(sorted(_SIGNAL, key=len, reverse=True)), re.IGNORECASE)
_STEMS = sorted(w for w in _SIGNAL if not any(o != w and o in w for o in _SIGNAL))
_ASSIGNED = re.compile(r"""([A-Za-z_]+)["']?\s*[:=]\s*["'`]?$""")
_BEARER = re.compile(r"(?i)\b(?:bearer|basic)\s+$")


_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{5,}")


def _words(before: str) -> set[str]:
    """The last three words before a token, with the parts of those joined by underscores."""
    return {w.lower() for x in re.findall(r"[A-Za-z_]{2,}", before[-CONTEXT:])[-3:] for w in (*x.split("_"), x)}


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def token_features(token: str, before: str, after: str, after_run: bool, code_file: bool) -> list[int]:
    """Active features of a token, given the characters before and after it."""
    if m := _PAIR.match(token):
        before, token = before + m[1], token[m.end() :]
    letters = re.sub(r"[^A-Za-z]", "", token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]) if a.isalnum() and b.isalnum())
    words = _words(before)
    assigned = _ASSIGNED.search(before[-CONTEXT:])
    tail = before.rstrip(" ")[-1:]
    near = before[-4:]
    following = {w.lower() for w in re.findall(r"[A-Za-z]{2,}", after[:CONTEXT].partition("\n")[0])[:4]}
    on = {
        "bias": True,
        "long20": len(token) >= 20,
        "long32": len(token) >= 32,
        "mixed_case": letters != letters.lower() and letters != letters.upper() and not letters.istitle(),
        "digits_only": token.isdigit(),
        "digits_dots": bool(re.fullmatch(r"[0-9.+/:-]+", token)) and not token.isdigit(),
        "hex_only": bool(re.fullmatch(r"[0-9a-fA-F]+", token)),
        "has_base64": "+" in token or token.endswith("="),
        "dashed_groups": token.count("-") >= 2,
        "slashes": token.count("/") >= 2,
        "has_dot": "." in token.strip("."),
        "high_entropy": _entropy(token) >= 3.6,
        "many_turns": turns >= 4,
        "known_prefix": bool(_PREFIX.match(token)),
        "key_word": bool(words & _KEY),
        "auth_word": bool(words & _AUTH),
        "benign_word": bool(words & _BENIGN),
        "equals": "=" in near,
        "colon": ":" in near,
        "quoted": tail in ("'", '"', "`"),
        "at_before": tail == "@",
        "plus_before": tail == "+",
        "after_run": after_run,
        "code_file": code_file,
        "vowel_word": turns <= 2 and any(sum(map(run.count, "aeiou")) >= 3 for run in re.findall(r"[a-z]+", token)),
        "underscored_words": bool(re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+)+[_-]?[0-9]*(?:\.[a-z]+)?", token)),
        "short": len(token) < 12,
        "no_digit": not _DIGIT.search(token),
        "one_case": letters == letters.lower() or letters == letters.upper() or letters.istitle(),
        "assigned": assigned is not None and bool({w.lower() for w in (*assigned[1].split("_"), assigned[1])} & _NAMED),
        "bearer_before": bool(_BEARER.search(before[-CONTEXT:])),
        "two_humps": bool(re.fullmatch(r"[A-Z]?[a-z]*(?:[A-Z]+[a-z]{2,}){1,3}[A-Z]{0,4}|(?:[A-Z]?[a-z]+[./+~=-]+)+[A-Z]?[a-z]*", token)),
        "key_after": bool(following & _NAMED),
        "benign_after": bool(following & _BENIGN),
        "consonants": bool(_CONSONANTS.search(token)),
        "short6": len(token) < SHORT,
        "digits4_5": token.isdigit() and 4 <= len(token) <= 5,
        "quoted_after": after[:1] in ("'", '"', "`") and bool(after),
    }
    return [_AT[f] for f, yes in on.items() if yes]


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens that are not plain: longer ones with a digit or mixed case, and any after (or with) a key or auth word."""
    low = text.lower()
    signals = [m.end() for m in _SIGNALS.finditer(text)] if any(w in low for w in _STEMS) else []
    out, short, seen = [], [], 0
    for s in signals:
        for m in _SHORT_TOKEN.finditer(text, max(s, seen), s + CONTEXT + SHORT):
            seen = m.end()
            if m.start() < s + CONTEXT and _words(text[max(0, m.start() - CONTEXT) : m.start()]) & _SIGNAL:
                short.append(m.span())
    for m in _TOKEN.finditer(text):
        token = m[0]
        if not _DIGIT.search(token) and (token.islower() or token.isupper() or token.istitle()):
            a, b = m.span()
            k = bisect.bisect_right(signals, b)
            if not k or signals[k - 1] <= a - CONTEXT:
                continue
            pair = _PAIR.match(token)
            if not _words(text[max(0, a - CONTEXT) : a] + (pair[1] if pair else "")) & _SIGNAL:
                continue
        out.append(m.span())
    return sorted(out + short) if short else out


def _is_code(text: str) -> bool:
    return sum(1 for _ in itertools.islice(_CODE.finditer(text), 3)) == 3


def run_labels(model: LinearChain, scores: np.ndarray, preceded: bool, followed: bool) -> list[int]:
    """Best labels of neighbouring tokens between others that are outside, or at an end of the text."""
    scores = scores.copy()
    if preceded:
        # Viterbi adds the weights of first labels, which this token has none of.
        scores[0] += model.pair[OUTSIDE] - model.first
    if followed:
        scores[-1] += model.pair[:, OUTSIDE]
    return model.viterbi(scores)


def crf_spans(text: str, model: LinearChain) -> list[Span]:
    """Spans that the CRF tags as secrets."""
    found = candidates(text)
    if not found:
        return []
    code = _is_code(text)
    runs: list[list[tuple[int, int]]] = []
    for a, b in found:
        if runs and not _WORD.search(text, runs[-1][-1][1], a):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    out: list[Span] = []
    for k, run in enumerate(runs):
        near = [False] + [a - b <= 1 for (_, b), (a, _) in zip(run, run[1:])]
        tokens = [token_features(text[a:b].rstrip(".="), text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], n, code) for (a, b), n in zip(run, near)]
        preceded = k > 0 or _WORD.search(text, 0, run[0][0]) is not None
        followed = k + 1 < len(runs) or _WORD.search(text, run[-1][1]) is not None
        for tag, n, (a, b) in zip(run_labels(model, model.scores(tokens), preceded, followed), near, run):
            b -= len(text[a:b]) - len(text[a:b].rstrip("."))
            if tag == INSIDE and n and out and out[-1][1] >= a - 1:
                out[-1] = (out[-1][0], b, "secret")
            elif tag != OUTSIDE:
                out.append((a, b, "secret"))
    return out


def labelled_table() -> list[tuple[str, str, bool]]:
    """The labelled rows: characters before, token, whether it is a secret. Made from a fixed seed."""
    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum = lower + upper + digits

    def odd(n: int) -> str:
        """Letters that are no word by their vowels."""
        while sum(map((made := draw(lower, n)).count, "aeiou")) > 2:
            pass
        return made

    rows: list[tuple[str, str, bool]] = []
    for _ in range(24):
        rows += [
            ("Authorization: Bearer ", "eyJ" + draw(alnum, 40) + "." + draw(alnum, 30), True),
            ("aws_secret_access_key = ", draw(alnum + "+/", 40), True),
            ("export DB_PASS=", draw(alnum, 18) + "9", True),
            ("client credentials: '", draw(alnum, 32) + "7", True),
            ("use key ", "sk_live_" + draw(alnum, 24) + "1", True),
            ("remote set to ", "ghp_" + draw(alnum, 35) + "2", True),
            ("pwd: ", draw(alnum + "-_", 16) + "4", True),
            ("the hook is ", "xoxb-" + draw(digits, 11) + "-" + draw(alnum, 24), True),
            ("Cookie: session=", draw(alnum, 36) + "0", True),
            ("private key ", draw(alnum + "+/", 60) + "3=", True),
            ("order ", draw(digits, 16), False),
            ("call +", draw(digits, 12), False),
            ("card no. ", draw(digits, 4) + "-" + draw(digits, 4) + "-" + draw(digits, 4) + "-" + draw(digits, 4), False),
            ("from ", ".".join(str(rng.randrange(100, 256)) for _ in range(4)), False),
            ("see https://www.", "example.com/" + draw(lower, 6) + "/" + draw(digits, 4) + "/" + draw(lower, 8), False),
            ("uuid ", "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), False),
            ("commit ", draw("0123456789abcdef", 20), False),
            ("on ", f"20{draw(digits, 2)}-0{rng.randrange(1, 9)}-1{draw(digits, 1)}T1{draw(digits, 1)}", False),
            ("write to ", "mail" + draw(digits, 2) + "." + "example" + "." + "organisation", False),
            ("open ", "report_final_version_" + draw(digits, 2) + ".txt", False),
            ("und ", rng.choice(["the", "from", "others"]) + "." + draw(digits, 2) + "mail.example", False),
            ("die ", draw(lower, 5) + "ationale" + draw(digits, 2) + "issements", False),
            ("part no ", draw(upper, 3) + "-" + draw(digits, 5) + "-" + draw(digits, 4), False),
            ("release ", "version-1.2." + draw(digits, 2) + ".build" + draw(digits, 3), False),
        ]
    short_prose = "was set sent the and lost not for all our that with from will been said they".split()
    prose = "building important hidden because message settings information nothing between drawer carefully expired".split()
    camel = "JavaScript McDonald iPhone YouTube HTMLElement PostgreSQL getElementById LaTeX MacArthur GmbH-Recht onClickHandler".split()
    for k in range(24):
        word, hump = prose[k % len(prose)], camel[k % len(camel)]
        rows += [
            ("pwd=", draw(alnum, rng.randrange(6, 11)) + "7", True),
            ("pass: ", draw(lower, 5) + draw(digits, 3), True),
            ("passphrase: ", draw(lower + upper, 14) + "nQ", True),
            ("passphrase: '", odd(6) + "-" + odd(7), True),
            ("Authorization: Bearer ", draw(lower + upper, 22) + "xZ", True),
            ("Authorization: Bearer ", draw(lower + upper, 30) + "pL", True),
            ("DB_PASS=", draw(lower, rng.randrange(7, 11)), True),
            ("pwd: ", draw(lower, rng.randrange(8, 12)), True),
            ("session: ", word, False),
            ("client: ", hump, False),
            ("access: ", word, False),
            ("client_secret=", draw(lower + upper, 18) + "jK", True),
            ("key is ", draw(lower + upper, 26) + "wR", True),
            ("the password is ", word, False),
            ("access to the ", word, False),
            ("a token for the ", word, False),
            ("the private ", hump, False),
            ("written in ", hump, False),
            ("session with ", hump, False),
            ("key in the ", hump, False),
            ("in the ", word + "." + rng.choice(["The", "And", "but", "We"]), False),
            ("it was ", word + "/" + prose[(k + 5) % len(prose)], False),
            ("about ", draw(digits, 3) + "." + draw(digits, 2) + "0", False),
            ("number ", draw(digits, 7), False),
            ("code ", draw(upper, 2) + "-" + draw(digits, 4), False),
            ("call ", draw(digits, 3) + "-" + draw(digits, 4), False),
            ("on ", f"20{draw(digits, 2)}-0{rng.randrange(1, 9)}-1{draw(digits, 1)}", False),
            ("the ", draw(digits, 2) + "th-century", False),
            ("model ", "covid-" + draw(digits, 2), False),
            ("basic ", word, False),
            ("client ", hump, False),
            (rng.choice(["pin: ", "pin=", "passcode: "]), draw(digits, rng.choice((4, 5, 6))), True),
            (rng.choice(["key: ", "token: ", "secret: "]), rng.choice(["none", "see", "the", "lost", "null", "set"]), False),
            *((named, draw("bcdfghjklmnpqrstvwxz", 9) + draw(lower, 2), True) for named in ("AUTH TOKEN ", "the api key ", "auth key ")),
            (rng.choice(["the pin ", "a key ", "the secret ", "the token ", "passwords "]), rng.choice(short_prose), False),
        ]
    return rows


def labelled_sentences() -> list[tuple[str, list[tuple[int, int]], list[int], bool]]:
    """Whole sentences of the labelled table: text, candidate tokens, their labels, and whether its file is code.

    Sentences of one beginning lie in files of prose and of code by turns, so that the file's kind tells what other rows show of it.
    """
    rng = random.Random(23)
    lower = "abcdefghijklmnopqrstuvwxyz"
    alnum = lower + lower.upper() + "0123456789"
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    ends = ["", ".", " is it.", " and so on", "\nhost: here", " # for the build", " was sent to them"]
    out = []

    turns: Counter[str] = Counter()

    def put(text: str, secrets: list[str], kind: str) -> None:
        spans = candidates(text)
        at = [(text.index(x), text.index(x) + len(x)) for x in secrets]
        labels = [next((BEGIN if k == 0 else INSIDE for k, (a, b) in enumerate(at) if a <= x and y <= b + 1), OUTSIDE) for x, y in spans]
        # A token that holds the name and the value is the secret as well.
        labels = [BEGIN if at and label == OUTSIDE and x <= at[0][0] and at[0][1] <= y else label for label, (x, y) in zip(labels, spans)]
        if spans:
            turns[kind] += 1
            out.append((text, spans, labels, turns[kind] % 2 == 0))

    for before, token, secret in labelled_table():
        quote = before[-1:] if before[-1:] in ("'", '"') else ""
        put(before + token + quote + rng.choice(ends), [token] if secret else [], before)
        if rng.random() < 0.5:
            put("it was seen that " + before + token + quote + rng.choice(ends), [token] if secret else [], "that " + before)
    for k in range(60):
        pem = [draw(alnum + "+/", 64) for _ in range(rng.randint(2, 4))]
        put("-----BEGIN PRIVATE KEY-----\n" + "\n".join(pem) + "\n-----END PRIVATE KEY-----\n", pem, "pem")
        token = draw(alnum, rng.randint(14, 30)) + "4"
        put(rng.choice(["use ", "they sent ", "", "take "]) + token + rng.choice([" as the password", " is the token", " for a password", " is our secret key"]), [token], "after")
        put(rng.choice(["see ", "they sent ", "take "]) + token[:8].lower() + draw("0123456789", 4) + rng.choice([" as the order", " is the invoice", " in the file", " on the page"]), [], "benign")
        put(f"the keys are {token} {draw(lower, 5)} of it and {draw(lower, 4)}", [token], "keys")
    return out


def plain_is_outside(model: LinearChain) -> bool:
    """Whether a plain row is outside in every best labelling: whatever its neighbours' labels are, outside scores best."""
    own = model.scores([[_AT["bias"], _AT["plain"]]])[0]
    for before in [model.first, *model.pair]:
        for after in [np.zeros(len(own)), *model.pair.T]:
            value = own + before + after
            if value.argmax() != OUTSIDE or np.sort(value)[-2] >= value[OUTSIDE]:
                return False
    return True


@functools.cache
def fitted() -> LinearChain:
    """The CRF over labels begin (0), outside (1), inside (2), fitted on the labelled sentences in files of both kinds."""
    sequences = []
    for text, spans, labels, in_code in labelled_sentences():
        tokens, ys, at = [], [], 0
        for (a, b), y in zip(spans, labels):
            plain = len(re.findall(r"\w+", text[at:a]))
            tokens += [[_AT["bias"], _AT["plain"]]] * plain
            ys += [OUTSIDE] * plain
            tokens.append(token_features(text[a:b].rstrip(".="), text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], bool(ys) and not plain and a - at <= 1, in_code))
            ys.append(y)
            at = b
        plain = len(re.findall(r"\w+", text[at:]))
        sequences.append((tokens + [[_AT["bias"], _AT["plain"]]] * plain, ys + [OUTSIDE] * plain))
    model = LinearChain(len(FEATURES), 3).fit(sequences)
    assert plain_is_outside(model)
    return model


# --- the operator ----------------------------------------------------------------------------


def scan_text(text: str | None, model: LinearChain) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    more = apart(crf_spans(text, model), base)
    return base, in_order(base + more) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add counts of base spans, their digest, and all spans to every row."""
    model = fitted()

    def compute(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in _FIELDS}
        for text in texts:
            base, spans = scan_text(text, model)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return map_texts(df, text_col, compute, _FIELDS, keep)


def redact_text(text: str | None, model: LinearChain) -> str | None:
    """The text with every span (overlapping ones as one) replaced by ``<SECRET>``."""
    spans = scan_text(text, model)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Every row with its secrets replaced; ``chars_col``, if present, follows a changed text."""
    model = fitted()

    def clean(texts: list[str | None]) -> dict[str, list]:
        return {"__clean": [redact_text(t, model) for t in texts]}

    rest = other_columns(df, [text_col, chars_col])
    inner = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("__row"), quoted(text_col).cast("string").alias("__own"))
    made = map_texts(inner, "__own", clean, [T.StructField("__clean", T.StringType())], ["__row"])
    own = lambda c: F.col("__row").getField(c)
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col("__clean").cast(df.schema[c].dataType).alias(c))
        elif c == chars_col and c not in rest:
            same = F.col("__clean").eqNullSafe(own(text_col).cast("string"))
            columns.append(F.when(same, own(c)).otherwise(F.length("__clean").cast(df.schema[c].dataType)).alias(c))
        else:
            columns.append(own(c).alias(c))
    return made.select(*columns)
