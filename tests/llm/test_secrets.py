import random
import re

from helpers import CLASHING, frame, words
from parkops.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY, HEX, MIXED = "AKIA" + "A1B2" * 4, "0123456789abcdef" * 2, "Zq8Lm2Xc9Vb4Nn7Kp1Rt"
LOWER = "k3zq9wv7m2xj5t8r1p6y"   # one case: 20 characters are enough, 18 not, nor letters alone
TEXTS = [
    None, "", "no secret here", "PassWord = 'hunter22' é token: abc secret: token: abcdefgh", f"é{KEY} {KEY}x AKIAABC {HEX}{HEX} 0123456789abcdef",
    f"api-key=1234567 apikey:'{HEX}' passwd\":\"a=b/c+d.e_f-g\"", "password=12345 password=123456", f"x{HEX[:23]} g{HEX[:24]}z{HEX}",
    f"user: alice {MIXED} https://db.example.com/x",          # an identifier, a mixed token, an endpoint
    f"just {MIXED} and https://example.com/page",              # weak parts without a complement
    f"user: alice {'la ' * 200} {MIXED}",                      # too far apart
    f"{KEY} {MIXED}", f"user: alice {LOWER} {'x9' * 9} {'Qy' * 12}", f"{LOWER} alone", "a" * 200_000 + f" password=deadbeef99 {HEX}", "token" * 5000 + "=abcdef1",
]


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    bits = ["password", "token", "=", ":", " ", '"', "AKIA", "ABC123DEF456GHI7", "deadbeef0123", "x", "é", "secret", "=", "api_key"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    data = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in secrets.scan(frame(spark, data, CLASHING)).collect()}
    assert got == {i: base(t) for i, t, *_ in data}


def test_weak_parts_need_a_complement_in_scope(spark):
    data = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(frame(spark, data * 2)).collect()}
    assert found[8] == ["ident", "weak", "endpoint"]
    assert found[9] == [] and found[10] == []
    assert found[11] == ["access", "weak"]
    assert found[12] == ["ident", "weak"] and found[13] == []


def test_linked_spans_equal_brute_force(spark):
    rng = random.Random(4)
    parts = [f"user: bob{i}" for i in range(3)] + [KEY, MIXED, "https://h.example/x", "password=sesame77", "la " * 40, "lo " * 15]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["user: bob1 " + MIXED] * 300      # a hot text
    data = [(i, t, None, None) for i, t in enumerate(texts)]
    got = secrets.scan(frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        text = texts[r.doc_id]
        strong = [(k, a) for k, a, _ in base(text)]
        weak = [("ident", m.start()) for m in re.finditer(r"\buser: bob\d", text)]
        weak += [("weak", m.start()) for m in re.finditer(MIXED, text)] + [("endpoint", m.start()) for m in re.finditer("https://h.example/x", text)]
        role = {"assign": "s", "hex": "s", "weak": "s", "access": "i", "ident": "i", "endpoint": "e"}
        near = lambda at, w: any(role[k] == w and abs(b - at) <= 256 for k, b in strong + weak)  # noqa: E731,B023
        need = {"ident": "s", "weak": "i", "endpoint": "is"}
        want = sorted(strong + [(k, a) for k, a in weak if all(near(a, w) for w in need[k])], key=lambda x: x[1])
        assert [(s.kind, s.start) for s in r.spans] == want


def test_redaction_keeps_rows_and_columns(spark):
    data = [(i, t, "en", None) for i, t in enumerate(TEXTS)]
    df = frame(spark, data, CLASHING)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(data)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == TEXTS[2]
    assert texts[6] == "password=12345 [SECRET]" and texts[11] == "[SECRET] [SECRET]"
    assert texts[8] == "[SECRET] [SECRET] [SECRET]" and texts[9] == TEXTS[9]
    assert not any(base(t.replace("[SECRET]", "!")) for t in texts.values() if t)


def test_empty(spark):
    assert secrets.scan(frame(spark, [])).count() == 0
    assert secrets.redact(frame(spark, [])).count() == 0
