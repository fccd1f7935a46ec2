"""The pipeline stage by stage on the given documents, and what must hold at its end."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from riskloom.llm import decontaminate, near_join, packing, secrets
from riskloom.llm.common import table, written
from tests.llm.test_near_join import brute
from tests.llm.test_packing import held
from tests.llm.test_secrets import plain


def test_stages(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == source.columns and docs.schema.simpleString() == source.schema.simpleString()
        seen.append({r.doc_id: r for r in docs.collect()})
        assert len(seen[-1]) == docs.count()
    every = {r.doc_id: r for r in source.collect()}
    by_language, by_group, clean, masked = seen
    assert all(any(c.isalpha() for c in r.text) for r in by_language.values()) and len(by_language) >= 0.98 * len(every)
    groups = brute([(i, r.text) for i, r in by_language.items()], 5, 80)
    assert set(by_group) == {c for _, c in groups.values()}
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    assert not any(t in r.text for r in clean.values() for t in items)
    for i in set(by_group) - set(clean):
        norm = decontaminate.normalise(by_group[i].text)
        assert any(m[1] <= decontaminate.pieces(n, 0.05)[0] for n in map(decontaminate.normalise, items) for m in [(0, decontaminate.best_end(n, norm)[0])])
    assert set(masked) == set(clean)
    for i in clean:
        assert (masked[i].text != clean[i].text) == bool(plain(clean[i].text)[4])
    for r in secrets.find_secrets(docs).collect():
        assert r.n_chars == len(r.text)
        assert not r.secrets or "[SECRET]" in r.text
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    held(rows, {i: r.text for i, r in masked.items()}, packing.SEQUENCE)
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.agg({"length": "sum"}).first()[0] == sum(r.length for r in rows)


def test_odd_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that no text should ever hold on to")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "the and of that with it", "en"), (2, None, "en"), (3, "", None), (4, "123 456", "en"), (None, "und der die das mit ist", "de"),
            (1, "the and of that with it", "en"), (5, "The and of that WITH it", None), (6, "So A passage of the benchmark, that no text should ever hold on to!", "en"),
            (7, "my token = abcdefgh1234 is here", None)]
    df = spark.createDataFrame([(i, t, g, "s", len(t or ""), 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, sequence_id int")
    for write in (df, df.limit(0)):
        folder = f"{tmp_path}/{'all' if write is df else 'none'}"
        write.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.doc_id or 0 for r in got) == ([0, 1, 7] if write is df else [])
    assert near_join.keep_one(df).columns == df.columns
    assert public_tokenizers.path("byte_bpe_50k.tiktoken") == corpus_pipeline.TOKEN_RANKS
