"""Secret scan against a plain Python version."""

from __future__ import annotations

import hashlib
import math
import random
import re

from riskloom.llm import secrets
from riskloom.llm.common import table


def entropy_span(word):
    bits = next(b for p, b in secrets.CLASSES.items() if re.search(p, word))
    hits = []
    for i in range(len(word) - secrets.WINDOW + 1):
        window = word[i : i + secrets.WINDOW]
        h = -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))
        if h >= bits - 1e-9:
            hits.append(i)
    return (hits[0], hits[-1] + secrets.WINDOW) if hits else None


def plain(text):
    text, out = text or "", []
    for kind, (pattern, least) in [("assign", (secrets.ASSIGN, 6)), ("access", ("AKIA[A-Z0-9]+", 20)), ("hex", ("[0-9a-f]+", 24))]:
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), secrets.KINDS.index(kind), m.end()))
    base = sorted(out)
    for m in re.finditer(secrets.CANDIDATE, text):
        if not re.search(secrets.ALLOWED, m[0]) and not re.search(secrets.ALLOWED_WORDS, m[0]) and (s := entropy_span(m[0])):
            out.append((m.start() + s[0], 3, m.start() + s[1]))
    shown = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == i for _, k, _ in out) for i in range(4)]
    return (*n[:3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(out)), n[3])


def texts():
    r = random.Random(8)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    alnum, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    parts = [
        lambda: r.choice(["password", "PassWd", "secret", "TOKEN", "api_key", "APIKEY"]) + r.choice(["=", ": ", '" : "', " = '", " is "]) + pick(alnum + "+/_.=-", r.randint(1, 30)),
        lambda: "AKIA" + pick(alnum[:26] + "0123456789", r.randint(10, 20)),
        lambda: pick(hexes, r.randint(10, 70)),
        lambda: pick(alnum + "+/", r.randint(15, 60)),
        lambda: pick("0123456789", 30),
        lambda: "some-long-slug-of-plain-words-here",
        lambda: "EXAMPLE" + pick(alnum, 30),
        lambda: "ñandú 😀 日本",
        lambda: "password: token: abcdefgh",
    ]
    return ["".join(r.choice(parts)() + r.choice([" ", "\n", "😀", ","]) for _ in range(r.randint(0, 6))) for _ in range(250)]


def test_equals_plain_version(spark):
    rows = list(enumerate([*texts(), None, "", "x" * 200_000, "a1B2c3D4e5F6g7H8i9J0" * 300, "password=" + "Zz9" * 4000]))
    df = spark.createDataFrame([(i, t, "s", "e") for i, t in rows], "doc_id long, text string, secrets string, _m0 string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in secrets.report(df).collect()}
    want = {i: plain(t) for i, t in rows}
    assert [i for i in want if got[i] != want[i]] == [] and sum(w[5] for w in want.values()) > 50


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in secrets.report(docs).collect()} == want


def test_redaction(spark, sf_dir):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f"ñ token = '{key}' 😀 {key}!", 9), (2, None, 9), (3, "clean", 9), (None, key, 9), (3, "clean", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in secrets.redact(df).collect()))
    assert got == [(0, "[SECRET]", 8), (1, "ñ [SECRET]' 😀 [SECRET]!", 23), (2, "", 9), (3, "clean", 9), (3, "clean", 9)]
    assert secrets.redact(df.limit(0)).collect() == [] and secrets.report(df.limit(0)).collect() == []


def test_allowed_parts_leave_the_rest_of_a_candidate(spark):
    r = random.Random(2)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    ssh = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW" + key(200)
    a, b = key(40), key(40)
    rows = [(1, ssh), (2, f"ñ example/{a}"), (3, f"{a}01234567{b}"), (4, f"{a}xxxxxx{b}"), (5, f"EXAMPLE{a}"), (6, f"{a[:10]}xxxxxx{b[:10]}"), (7, "x" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("entropy")] for x in secrets.report(df).collect()}
    assert max(e for _, e in got[1]) == len(ssh) and sum(e - s for s, e in got[1]) >= 200
    assert got[2] == [(9, 50)] and got[3] == [(0, 40), (48, 88)] and got[4] == [(0, 40), (46, 86)]
    assert got[5] == got[6] == got[7] == []
    hidden = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert hidden[1].endswith("[SECRET]") and hidden[2] == "ñ example[SECRET]"
