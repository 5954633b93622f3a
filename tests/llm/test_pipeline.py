"""The pipeline against a plain version of its stages, made of small functions over Python lists."""

import hashlib
import re
import struct

import corpus_pipeline
from gridloom.llm import quality_rules, secrets
from tests.llm.test_operators import _plain_components, _plain_fingerprint
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _windows(items):
    out = {}
    for text in items:
        words = WORD.findall(_lower(text))
        k = min(13, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            out.setdefault(k, set()).add(tuple(words[i : i + k]))
    return out


def _without_passages(text, windows):
    """(Whether it is contaminated, the text without runs of hit words)."""
    places = [m.span() for m in WORD.finditer(_lower(text))]
    words = [_lower(text)[a:b] for a, b in places]
    hit = set()
    for k, known in windows.items():
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in known:
                hit |= set(range(i, i + k))
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : places[k][0]])
        at = places[k][1]
    return bool(hit) and 20 * len(hit) >= len(words), "".join(out) + text[at:]


def _redacted(text, spans):
    """Overlapping spans as one."""
    marks = sorted((a, b) for a, b, _ in spans)
    out, at = "", 0
    for a, b in marks:
        if a >= at:
            out += text[at:a] + "<SECRET>"
        at = max(at, b)
    return out + text[at:]


def test_run_is_the_plain_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # The verdicts of the first stage are held against SQL elsewhere, the spans of the fourth against all labellings.
    good = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    rows = sorted((d for d in docs.collect() if d["doc_id"] in good), key=lambda d: d["doc_id"])
    comp = _plain_components([d["doc_id"] for d in rows], [_plain_fingerprint(d["text"]) for d in rows])
    rows = [d for k, d in enumerate(rows) if comp[k] == d["doc_id"]]
    windows = _windows([r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()])
    library, model = Tokenizer.from_file(corpus_pipeline.VOCABULARY), secrets.fitted()
    library.no_truncation()
    library.no_padding()
    want = {}
    for d in rows:
        bad, text = _without_passages(d["text"], windows)
        if bad:
            continue
        text = _redacted(text, secrets.scan_text(text, model)[1])
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[d["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) > 50
