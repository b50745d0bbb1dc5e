"""The pipeline against its stages in plain Python."""

import hashlib

import public_tokenizers
import pytest
from test_llm_operators import brute_decontam, brute_lines, brute_minhash

import corpus_pipeline
from modalflow.llm import bpe, registry, toxicity
from modalflow.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(docs, spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_pipeline_equals_brute_force(spark):
    d = table(spark, SF, "documents")
    model = toxicity.fit(d, table(spark, SF, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    v = toxicity.votes([(t or "").encode() for _, t in rows], model.lexicon)
    rows = [r for r, s in zip(rows, model.score(v), strict=True) if s < 0.5]
    gone = brute_lines(rows)
    cut = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone), any(g[0] == i for g in gone)) for i, t in rows]
    rows = [(i, t) for i, t, some in cut if not (some and not t.strip())]
    kept = {i for i, _, _, k in brute_minhash(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in brute_decontam(rows, items) if r[-1]}
    rows = [r for r in rows if r[0] not in bad]
    codec = bpe.Codec.of(public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN)
    want = sorted((i, len(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    with pytest.raises(ValueError):
        bpe.encode(d, public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN, chunk=1, overlap=1)
