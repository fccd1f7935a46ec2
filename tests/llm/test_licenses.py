"""License scan against a plain Python version and against SQL."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest

from riskloom.llm import licenses
from riskloom.llm.common import table


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(text, templates, contained):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    starts, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        base |= {label} if own else set()
    labels, best = set(base), 0.0
    for block in lower(text).split("\n"):
        held = set(licenses.words_of(block))
        for label, t in templates:
            own = set(licenses.words_of(t))
            if len(own & held) >= math.ceil(contained * len(own) - 1e-9):
                labels.add(label)
                best = max(best, len(own & held) / len(own))
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best


@pytest.mark.parametrize("contained", [0.9, 0.6])
def test_equals_plain_version(spark, contained):
    r = random.Random(6)
    words = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)}) + ["MIT", "License", "ſecret", "É", "K", "日本", "x1"]

    def block():
        if r.random() < 0.5:
            return " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        own = re.split(r"(\W+)", r.choice(licenses.TEMPLATES)[1])
        return "".join(w for w in own if r.random() > r.choice([0, 0.05, 0.2])) + r.choice(["", "!", " mit license mit-license"])

    rows = list(enumerate(["\n".join(block() for _ in range(r.randint(1, 4))) for _ in range(200)] + [None, "", "...", "the MIT  License " * 20_000]))
    rows += [(None, "GENERAL public\nlicense"), (7, "Apache_License"), (7, "Apache_License")]
    df = spark.createDataFrame([(i, t, "l", "d") for i, t in rows], "doc_id long, text string, labels string, digest string").repartition(4)
    got = sorted(map(str, map(tuple, licenses.scan(df, contained=contained).collect())))
    assert got == sorted(str((i, *plain(t, licenses.TEMPLATES, contained))) for i, t in rows)
    assert licenses.scan(df.limit(0)).collect() == []


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cur = con.execute(licenses.check_sql())
    names = [c[0] for c in cur.description]
    df = licenses.scan(table(spark, folder, "documents"))
    assert df.columns == names
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cur.fetchall()))
