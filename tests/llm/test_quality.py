"""Quality model against a plain modified Kneser-Ney, both ways of adding up, thresholds and edges."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from riskloom.llm import quality
from riskloom.llm.common import table


class Plain:
    """Interpolated modified Kneser-Ney over characters, straight from the definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        high = Counter(g for t in texts for g in self.grams(t))
        self.counts[order] = high
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d, self.context = {}, {}
        for n, counts in self.counts.items():
            of = Counter(counts.values())
            if of[1] and of[2]:
                y = of[1] / (of[1] + 2 * of[2])
                d = (1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 1.0)
                self.d[n] = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]
            else:
                self.d[n] = [0.5] * 3
            self.context[n] = defaultdict(list)
            for g, c in counts.items():
                self.context[n][g[:-1]].append(c)

    def grams(self, text):
        s = " " * (self.order - 1) + text
        return [s[i : i + self.order] for i in range(len(text))]

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        n, below = len(gram), self.p(gram[1:])
        held = self.context[n].get(gram[:-1])
        if not held:
            return below
        cut = lambda c: self.d[n][min(c, 3) - 1]
        c = self.counts[n][gram]
        return (max(c - cut(c), 0) if c else 0) / sum(held) + sum(map(cut, held)) / sum(held) * below

    def log_prob(self, text):
        return sum(math.log(self.p(g)) for g in self.grams(text))


def corpus():
    r = random.Random(3)
    sound = lambda: "".join(r.choice(["an", "the", "io", "n", "er", "ß", "日"]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(sound() for _ in range(r.randint(1, 60))), r.choice(["en", "de", None])) for i in range(120)]
    rows += [(200, "%%% $$$ ### " * 20, "en"), (201, None, "en"), (202, "", "en"), (203, " \n", "en"), (None, "the an", "en"), (204, "x", "en"), (5, "again 5", "de")]
    return rows, [(i, 1, 0) for i in range(0, 100, 2)] + [(200, 0, 0), (3, 1, 1), (4, 0, 0), (7, 1, None), (None, 1, 0)]


@pytest.mark.parametrize("local_grams", [10**6, 0])
def test_equals_plain_model(spark, local_grams):
    rows, labels = corpus()
    df = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, lang string, key string, low double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, t in labels if q == 1 and not t and i is not None} - {i for i, q, t in labels if q != 1 or t}
    clean = lambda t: " ".join((t or "").lower().split())
    model = Plain([clean(t) for i, t, _ in rows if i in good], quality.ORDER)
    got = quality.classify(df, marks, (0.0, 1.0), local_grams).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len(clean(t)), round(model.log_prob(clean(t)), 2)) for i, t, _ in rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens, round(x.log_prob, 2)) for x in got) == [
        (i, n, pytest.approx(p, abs=0.02)) for i, n, p in want
    ]
    by = {x.doc_id: x for x in got}
    assert not by[201].keep and not by[202].keep and not by[203].keep and not by[200].keep and by[201].perplexity is None
    assert all(by[i].keep for i in good if i in by)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    told = {r.doc_id: r.quality for r in labels.collect()}
    kept = lambda q: sum(rows[i].keep for i, x in told.items() if x == q) / sum(x == q for x in told.values())
    print("kept good, bad:", kept(1), kept(0))
    assert len(rows) == docs.count() and kept(1) > 0.95 and kept(0) < 0.6


def test_nothing_trusted_and_empty(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(df, none).collect()
    assert all(x.low is None and x.keep == (x.n_tokens > 0) for x in got) and len(got) == len(rows)
    assert quality.classify(df.limit(0), none).collect() == []
