"""The automaton against the regexes of the contract."""

import hashlib
import random
import re

import numpy as np

from lodestar.llm import secrets as S
from lodestar.llm.queries import queries

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PIECES = ["password", "token", "api_key", "ApiKey", "secret", "AKIA", "=", ":", " ", "'", '"', "abc123", "0123456789abcdef", "ABCDEF0123456789", "é", "\n", ",", "x", "deadbeefdead", "passwd", "tok", "ſecret", "K"]


def base_spans(t):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan(texts):
    raw = [t.encode() for t in texts]
    return S.scanner().scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_base_spans_equal_the_regexes():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000 + " token=" + "b" * 9000, "f" * 20_000, "x" * 700 + "password: hunter2hunter2" + "y" * 700]
    for t, got in zip(texts, scan(texts), strict=True):
        assert [s for s in got if s[2] < len(S.BASE)] == base_spans(t), t


def test_further_kinds():
    kinds = [r.kind for r in S.RULES]
    found = scan(["ghp_" + "a1" * 18 + " xoxb-123456789012-abcdef -----BEGIN RSA PRIVATE KEY-----"])[0]
    assert {"github", "slack", "pem"} <= {kinds[r] for *_, r in found}


def test_minimal_automaton_accepts_the_same_strings():
    classes, table, accept = S.determinise([("(ab|cd)+e?x{2,}", False)], anywhere=False)
    pattern = re.compile(r"(ab|cd)+e?x{2,}")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["ab", "cd", "e", "x", "xx"]) for _ in range(rng.randint(0, 6)))
        state = 0
        for b in t.encode():
            state = table[state, classes[b]]
        assert bool(accept[state]) == bool(pattern.fullmatch(t))


def test_query_digests_and_odd_rows(spark, odd_docs, tmp_path):
    text = 'é token = "abcdef12" and ' + "a1" * 14
    docs = odd_docs.unionByName(spark.createDataFrame([(50, text, "en", *("x" for _ in odd_docs.columns[3:]))], odd_docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries()["op5_secret_scan"](spark, str(tmp_path)).collect()}
    want = ",".join(f"{S.RULES[k].kind}:{s}:{e}" for s, e, k in base_spans(text))
    assert rows[50].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[50].spans == want and rows[50].n_hex == 1
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].n_assign == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é password=abcdef1234567890abcdef1234567890 end", 40, "s"), (2, None, None, None), (3, "clean", 5, "t")], "doc_id long, text string, n_chars long, secrets string")
    got = {r.doc_id: r for r in S.redact(df).collect()}
    assert got[1].text == "é [secret] end" and got[1].n_chars == 14 and got[3].text == "clean" and got[2].text is None
    assert S.redact(df).columns == df.columns
