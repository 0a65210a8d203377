"""Base spans against plain regexes, the tests' error rates, the false-discovery bound, edge cases."""

import hashlib
import math
import random
import re

import numpy as np

from tessera.llm import secret_scan as S
from tessera.llm.queries import op8_secret_scan


def plain(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), S.KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


ODD = ["", "é TOKEN = 'abc.def'", "token=token:abcdef secret:12345", "AKIA" + "A" * 16 + "xAKIAAKIA" + "B" * 13, "f" * 24 + "g" + "0" * 23, "password\x20\x20:\x20\"a_b-c=d\"", "api_key=x api-key=abcdef apikey:'ABCDEF'", "ſecret=abcdef toKen=abcdefg"]


def test_base_spans():
    for text in ODD:
        got = S.base_spans(text, True)
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in got) == plain(text)


def test_uniform_tokens_are_seldom_rejected():
    rng = np.random.default_rng(1)
    for size, n in ((10, 40), (16, 32), (32, 24), (62, 20), (64, 44), (64, 200)):
        rejected = sum(S.p_random(rng.integers(0, size, n), size) < S.ALPHA for _ in range(2000))
        assert rejected <= 2000 * 0.02


def test_words_are_rejected():
    for word in ("internationalization", "characteristically", "thonblewhtionting", "abcdefghijklmnopqrstuvwxyz", "x" * 40, "ABABABABABABABABABABAB"):
        assert S.p_random(*S.encoding(word)[1:]) < S.ALPHA, word


def test_numbers_are_no_secrets():
    assert S.encoding("4111111111111111") is None and S.encoding("00ff" * 8)[0] == "hex"


def test_benjamini_hochberg_is_the_step_up_rule():
    rng = random.Random(2)
    p_bins = [min(S.BINS, int(rng.expovariate(0.1))) for _ in range(500)] + [120] * 15
    table = np.zeros((1, S.BINS + 1), np.int64)
    for b in p_bins:
        table[0, b] += 1
    (least,) = S.benjamini_hochberg(table, 0.05)
    p = sorted(10 ** (-b / 10) for b in p_bins)
    rank = max((k + 1 for k, x in enumerate(p) if x <= 0.05 * (k + 1) / len(p)), default=0)
    assert sum(b >= least for b in p_bins) == rank > 0


def test_scan(spark):
    rng = random.Random(3)
    alphabet = dict((e[0], e[2]) for e in S.ENCODINGS)["base64"]
    secrets = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(40)]
    texts = [None, "", *ODD, "x" * 300_000] + [f"the é reading of internationalization {s} and more words here " + "sense and the sea " * 20 for s in secrets]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    rows = {r.doc_id: r for r in S.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in rows[i].base) == plain(t or "")
    first = len(texts) - len(secrets)
    hit = sum(any(texts[i][s.start : s.end] == secrets[i - first] for s in rows[i].found) for i in range(first, len(texts)))
    assert hit >= 36
    assert not any("internat" in texts[i][s.start : s.end] for i in range(first, len(texts)) for s in rows[i].found)
    assert S.scan(docs.limit(0)).count() == 0
    assert S.scan(docs.where("doc_id < 2")).where("size(base) + size(found) > 0").count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op8_secret_scan(spark, sf_dir).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in S.KINDS[:3])
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert math.isclose(S.upper_tail(1.959964), 0.025, rel_tol=1e-4)


def test_found_and_false_shares(spark, sf_dir):
    """Planted tokens of each encoding are found, by length; words joined as in code and paths, and the texts' own words, aren't reported."""
    import random
    import string
    from collections import Counter

    rng = random.Random(5)
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] * 3
    words = [w.lower() for d in docs[:200] for w in d.split() if w.isalpha() and w.isascii()]
    letters = string.ascii_letters + string.digits
    secret = {"hex 32": ("0123456789abcdef", 32), "hex 64": ("0123456789abcdef", 64), "base64 24": (letters + "+/", 24), "base64 40": (letters + "+/", 40), "base62 32": (letters, 32), "base32 32": (string.ascii_uppercase + "234567", 32)}
    plain = {"path": "/", "snake": "_", "camel": "", "kebab": "-"}
    rows, planted = [], {}
    for k, text in enumerate(docs):
        if k % 2:
            kind = rng.choice(list(secret))
            token = "".join(rng.choice(secret[kind][0]) for _ in range(secret[kind][1]))
        else:
            kind = rng.choice(list(plain))
            token = plain[kind].join(w.title() if kind == "camel" else w for w in rng.choices(words, k=5))
        planted[k] = (kind, token)
        rows.append((k, f"{text} value {token} end"))
    hit, n = Counter(), Counter()
    for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        kind, token = planted[r.doc_id]
        at = rows[r.doc_id][1].rindex(token)
        n[kind] += 1
        hit[kind] += any(s.start < at + len(token) and s.end > at for s in [*r.base, *r.found])
    assert min(n.values()) > 20
    assert all(hit[k] >= 0.95 * n[k] for k in secret), hit
    assert sum(hit[k] for k in plain) <= 0.02 * sum(n[k] for k in plain), hit
