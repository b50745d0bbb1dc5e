"""The ten operators on edge cases and against brute force, SQL, round trips or held-out accuracy."""

import hashlib
import itertools
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import edge_rows, prose  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modalflow.llm import bpe, decontam, embedding, hmm, langid, linededup, minhash, quality, registry, suffix, toxicity

RANKS = public_tokenizers.path(registry.RANKS)
SF = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bpe_equals_the_library_and_round_trips(docs, no_docs):
    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (60, 20)):
        got = sorted_rows(bpe.digest(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap))
        want = []
        for i, t, *_ in edge_rows():
            ids = codec.encoding.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert bpe.digest(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=10, overlap=10)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 '\n\tsltrevmd.,é　", max_size=120))
def test_bpe_seams(text):
    """Chunks scanned from their own starts agree from their first common boundary on."""
    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    chunk, overlap = 24, 20
    true = codec.boundaries(text)
    parts = [text[k : k + chunk + overlap] for k in range(0, max(1, len(text) - overlap), chunk)]
    for k, (a, b) in enumerate(itertools.pairwise(parts), 1):
        tail = {x - chunk for x in codec.boundaries(a) if chunk <= x <= len(a) - bpe.LOOKAHEAD}
        common = sorted(tail & {x for x in codec.boundaries(b) if x < overlap})
        # A cut that follows a true start of the chunk before is a true boundary.
        if common and (k == 1):
            assert common[0] + chunk * k in true


def brute_decontam_in_order(rows, items, window=13):
    def words(t):
        return [w for w in (t or "").encode().translate(decontam.LOWER_ALNUM).split(b" ") if w]

    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for i, t, *_ in rows:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    named |= got
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_decontam(rows, items, window=13):
    return sorted(brute_decontam_in_order(rows, items, window), key=repr)


def test_decontamination_equals_brute_force(spark, docs, no_docs):
    base = edge_rows()[0][1].split()
    items = [(1, " ".join(base[5:30])), (2, "ONE, two"), (10, "one-TWO three"), (3, ""), (4, None), (None, "a b"), (1, " ".join(base[5:30])), (7, "é" * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontam(edge_rows(), items)
    assert sorted_rows(decontam.digest(decontam.find(docs, bench))) == want
    spans = {r["doc_id"]: r["spans"] for r in decontam.find(docs, bench).where("doc_id = 11").collect()}
    assert [(s["start"], s["stop"]) for s in spans[11]] == [(0, len("ONE  two\tthree"))]
    assert decontam.digest(decontam.find(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontam.find(no_docs, bench).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_decontamination_keeps_all_bytes_of_a_word(spark):
    passage = "voilà à Århus хлеб Рим мир 中文 酠 date\u00a0limite déjà vu là où РОССИЯ"
    rows = [(1, f"Отрывок: {passage}, fin"), (2, passage.replace("à", "a")), (3, "х Р à \u00a0 \u0085 酠"), (4, "À " * 30)]
    items = [(1, passage), (2, "х Р à"), (3, "酠")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(docs, bench)
    assert sorted_rows(decontam.digest(found)) == brute_decontam(rows, items)
    span = found.where("doc_id = 1").first()["spans"][0]
    assert rows[0][1].encode()[span["start"] : span["stop"]].decode() == passage
    con = duckdb.connect()
    for name, data in (("documents(doc_id BIGINT, text VARCHAR)", rows), ("benchmark(item_id BIGINT, text VARCHAR)", items)):
        con.execute(f"CREATE TABLE {name}")
        con.executemany(f"INSERT INTO {name.split('(')[0]} VALUES (?, ?)", data)
    res = con.execute(decontam.ORACLE)
    cols = [c[0] for c in res.description]
    assert sorted_rows(decontam.digest(found).select(*cols)) == sorted(res.fetchall(), key=repr)


def test_decontamination_in_blocks_is_the_same(spark, docs):
    bench = spark.createDataFrame([(i, prose(1, 120)[i * 10 : i * 10 + 200]) for i in range(6)], "item_id long, text string")
    want = sorted_rows(decontam.find(docs, bench))
    assert sum(bool(r[2]) for r in want) >= 4  # a repeated row and one without an id among them
    for size in (1000, 300):
        assert sorted_rows(decontam.find(docs, bench, block_bytes=size)) == want
    odd = docs.withColumnsRenamed({"key": "found", "bucket": "c0", "label": "items"})
    rows = [decontam.clean(odd, bench, block_bytes=size) for size in (1 << 20, 300)]
    assert rows[0].columns == odd.columns and sorted_rows(rows[0]) == sorted_rows(rows[1])
    bad = {repr(r[1]) for r in edge_rows()} - {repr(r["text"]) for r in rows[0].collect()}
    assert bad == {repr(edge_rows()[k][1]) for k, r in enumerate(brute_decontam_in_order(edge_rows(), [(r[0], r[1]) for r in bench.collect()])) if r[-1]}
    one = spark.createDataFrame([(1, prose(1, 120), "x"), (1, "clean words", "y"), (None, prose(1, 120), "z")], "doc_id long, text string, c1 string")
    assert [r["c1"] for r in decontam.clean(one, bench).collect()] == ["y"]


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifier_edge_cases(docs, no_docs, labels, op):
    got = op.digest(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % op.MODULUS == op.HELD_OUT) for r in got if r["doc_id"] is not None)
    assert op.digest(no_docs, labels).count() == 0
    assert len(op.digest(docs, labels.limit(0)).collect()) == docs.count()


def accuracy(spark, op, column):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = op.digest(d, lab).join(lab, "doc_id").where(f"held_out and {column} is not null")
    return got.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_held_out_accuracy(spark):
    assert accuracy(spark, quality, "quality") > 0.95
    assert accuracy(spark, toxicity, "toxic") > 0.93
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = langid.digest(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def brute_toxicity(model, text):
    """The score of one text from the model's entries, one voter after the other."""
    words = (text or "").encode().translate(toxicity.LOWER_ALNUM).split()
    fires = lambda n, e, w: w == e if n == 0 else len(w) > n and w[:n] == e
    hit = [w for w in words if any(fires(n, e, w) for n, e in model.lexicon)]
    x = [0.0] * len(model.lexicon)
    for (n, e), k in model.lexicon.items():
        x[k] = float(any(fires(n, e, w) for w in words))
    x += [float(p.search((text or "").encode()) is not None) for p in toxicity.PATTERNS]
    d = len(set(hit))
    x += [math.log(1 + len(hit)), math.log(1 + d), math.log(1 + 100 * len(hit) / max(1, len(words))), d >= 2, d >= 3, not hit]
    return 1 / (1 + math.exp(-max(-40, min(40, sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias))))


def test_toxicity_score_equals_brute_force_for_models_in_turn(spark):
    """Many models in one session: none answers with what another one has looked up."""
    texts = ["you absolute clown", "blargh fooled", "foolish blarghs", "", None, "nice day!!! " * 40, "AAAA BBBB CCCC DDDD ", "word " * 30000 + "blargh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    r = np.random.default_rng(1)
    for words in ((b"clown", b"blargh"), (b"nice", b"day"), (b"word", b"absolute"), (b"foolish", b"you")):
        lexicon = {(0, words[0]): 0, (0, words[1]): 1, (4, words[0][:4]): 2}
        model = toxicity.Model(lexicon, r.standard_normal(3 + len(toxicity.PATTERNS) + 6), 0.3)
        got = dict(toxicity.score(df, model).select("doc_id", "score").collect())
        assert got == pytest.approx({i: brute_toxicity(model, t) for i, t in enumerate(texts)})


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    good = [(rng.random(2000) < np.where(y, 0.8, 0.02)).astype(float) for _ in range(4)]
    copy = good[0].copy()
    noise = (rng.random(2000) < 0.3).astype(float)
    x = np.stack([*good, copy, noise], 1)
    q = toxicity.label_model(x, np.where(x[:, :4].sum(1) >= 2, 0.9, 0.05))
    assert ((q > 0.5) == y).mean() > 0.97


def test_language_pieces_are_greedy_longest_matches():
    sample = b"abracadabra and more"
    text = b"abra more zz cadab"
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    assert langid.pieces([text], [("x", sample)])[0, 0] == n


def brute_language(samples, text):
    """(language, score) of one text by greedy longest matches, one language after the other."""
    f = langid.fold(text or "")
    if not any(map(str.isalpha, text or "")) or not samples:
        return "und", 0.0
    counts = []
    for _, sample in samples:
        n = 0
        for s in range(0, len(f), langid.BLOCK):
            block, at = f[s : s + langid.BLOCK], 0
            while at < len(block):
                k = 1
                while at + k < len(block) and block[at : at + k + 1] in sample:
                    k += 1
                n, at = n + 1, at + k
        counts.append(n)
    rate = [c / len(f) for c in counts]
    best = counts.index(min(counts))
    return samples[best][0], 1 / sum(math.exp(-(x - rate[best]) * min(len(f), 400)) for x in rate)


def test_language_predictions_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    samples = langid.fit(d, rows_per_lang=4, bytes_per_lang=600)
    assert 1 < len(samples) <= 6 and all(0 < len(x) <= 700 for _, x in samples)
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] + [(-1, None), (-2, "123 !"), (-3, "Ωμέγα"), (-4, "x" * 5000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    for i, t in rows:
        lang, score = brute_language(samples, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score), (i, t)


def test_language_learns_from_long_texts_and_past_a_shared_header(spark):
    head = "shared header of every text in this source " * 20
    rows = [(i, head + prose(i, 60) + " zyx wvu tsr " * 3000, "qq") for i in range(40)] + [(100 + i, head + "abba baab " * 300, "rr") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = dict(langid.fit(d))
    assert b"zyx wvu" in samples["qq"] and b"abba" in samples["rr"]
    new = spark.createDataFrame([(1, "zyx wvu tsr zyx"), (2, "abba baab abba baab")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(new, sorted(samples.items())).orderBy("doc_id").collect()] == ["qq", "rr"]


def test_quality_scores_are_sums_of_table_cells(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, lab)
    assert model.tables and len(model.pairs) == quality.PAIRS
    texts = [r["text"] for r in d.limit(40).collect()] + [None, "", "word " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(quality.score(df, model).collect())
    for i, t in enumerate(texts):
        x = quality.features((t or "").encode())
        cell = lambda cut, v: sum(v >= c for c in cut)
        logit = model.bias + sum(t_[cell(c, v)] for c, t_, v in zip(model.cuts, model.tables, x, strict=True))
        logit += sum(t_[cell(model.pair_cuts[a], x[a]), cell(model.pair_cuts[b], x[b])] for a, b, t_ in model.pairs)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, logit))))), i


def test_quality_training_finds_a_rule_and_an_interaction():
    r = np.random.default_rng(6)
    x = r.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95 and m.pairs[0][:2] == (1, 0)
    one = quality.train(x, np.ones(1500))
    assert (one.score(x) > 0.99).all()


def test_language_edge_cases(docs, no_docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.digest(docs).collect()}
    assert (4, "und") in got and (5, "und") in got and (19, "und") in got and (1, "en") in got
    assert langid.digest(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_lines(rows, least=5):
    def words(line):
        return line.strip(" ").lower().split(" ")

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    lines = [(i, p, words(x)) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    lines = sorted((i, p, w) for i, p, w in lines if len(w) >= least)
    return {(i, p) for k, (i, p, w) in enumerate(lines) if any(near(v, w) for _, _, v in lines[:k])}


def test_line_dedup_equals_brute_force(spark, docs, no_docs):
    extra = ["a b c d e f", "a b c d e", "a b X d e f", "b c d e f", "A B C D E F ", "q b c d e f g", "a b c d e f"]
    rows = {i: t for i, t, *_ in edge_rows() if i is not None and t is not None} | {100 + i: t + "\n" + "short line" for i, t in enumerate(extra)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]) for r in linededup.dropped_lines(df).collect()}
    assert got == brute_lines(sorted(rows.items()))
    out = linededup.dedup(docs)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 2 and out.where("doc_id = 4").first()["text"] is None
    assert linededup.dedup(no_docs).count() == 0


def test_line_dedup_judges_rows_of_one_id_apart(spark):
    a, b = "one two three four five\nsix seven eight nine ten", "p q r s t u\nsix seven eight nine ten"
    rows = [(1, a), (1, a), (1, "a b c d e\nz y x w v u\nk l m n o p"), (2, b), (None, a)]
    df = spark.createDataFrame([(*r, 5, "m", 7) for r in rows], "doc_id long, text string, n_dropped int, marks string, text_hash int")
    out = linededup.dedup(df)
    assert out.columns == df.columns
    got = sorted_rows(out.select("doc_id", "text", "n_dropped", "marks", "text_hash"))
    assert got == sorted([(*r, 5, "m", 7) for r in [rows[0], rows[1], rows[2], (2, "p q r s t u"), rows[4]]], key=repr)


def test_line_dedup_plan_has_no_python(docs):
    plan = linededup.without(docs, linededup.dropped_lines(docs))[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.02 * (i % 3) * rng.standard_normal(16)).tolist(), i % 2) for i in range(90)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0, None] + [0.0] * 14, 1), (203, [float("nan")] * 16, 0), (204, base[0].tolist(), None), (205, (3 * base[0]).tolist(), 0), (206, [], 0), (207, [1.0, 2.0], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.dot(v, v) > 0}
    link = {i: {j for j in ok if i != j and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] / np.sqrt((ok[i][0] @ ok[i][0]) * (ok[j][0] @ ok[j][0])) >= 0.98} for i in ok}
    comp = {i: i for i, _, _ in rows if i is not None}
    for _ in range(100):
        for i, js in link.items():
            comp[i] = min([comp[i], *(comp[j] for j in js)])
    want = sorted(((i, len(link.get(i, ())), comp.get(i), i is None or comp[i] == i) for i, _, _ in rows), key=repr)
    for block in (1024, 16):
        assert sorted_rows(embedding.near_duplicates(df, block=block)) == want
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_bounds_hold():
    rng = np.random.default_rng(3)
    c = rng.standard_normal((20, 8))
    x = np.concatenate([c[i] + 0.01 * rng.standard_normal((40, 8)) for i in range(20)])
    raw, x = x, x / np.sqrt((x * x).sum(1))[:, None]
    t = embedding.CoverTree(x)
    for lev in t.levels:
        for a, b, m, r in zip(lev["start"], lev["stop"], lev["centre"], lev["radius"], strict=True):
            assert np.sqrt(np.maximum(0, 2 - 2 * x[t.order[a:b]] @ x[m])).max() <= r
    n, _, edges = embedding.traverse(t, t, raw, raw, 0.98)
    assert (n == (x @ x.T >= 0.98).sum(1) - 1).all() and edges


def test_suffix_dedup_equals_brute_force(spark, docs, no_docs):
    assert sorted_rows(suffix.digest(docs)) == sorted(suffix.brute_force([r[:2] for r in edge_rows()]), key=repr)
    assert suffix.digest(no_docs).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=90), min_size=1, max_size=12))
def test_suffix_dedup_on_few_letters(spark, texts):
    rows = [(i, t + texts[0]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(suffix.digest(df)) == sorted(suffix.brute_force(rows), key=repr)


def brute_lm_base(rows):
    low = hmm.LOWER_SPACE
    train = [(t or "").encode().translate(low).split() for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().translate(low).split()
        d = n + 0.1 * (v + 1)
        out.append((i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(math.log10((c[x] + 0.1) / d) for x in w) + math.log10((len(train) + 0.1) / d), 6)))
    return sorted(out, key=repr)


def test_lm_counts_and_base(docs, no_docs):
    got = hmm.score(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("b"))
    assert sorted_rows(got) == brute_lm_base(edge_rows())
    assert hmm.score(no_docs).count() == 0
    alone = hmm.score(docs.where("doc_id is null")).collect()
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in alone} == {(0, 0.0, 0)}


def test_forward_is_exact_and_baum_welch_climbs():
    rng = np.random.default_rng(4)
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 3, 5, 4)]
    for s, got in zip(seqs, hmm.forward(m, seqs), strict=True):
        p = 0.0
        for path in itertools.product((0, 1), repeat=len(s)):
            x = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                x *= m.step[a, b] * m.emit[o, b]
            p += x
        assert got == pytest.approx(math.log10(p))
    data = [rng.integers(0, 5, 30).astype(np.int32) for _ in range(20)]
    last = -np.inf
    for _ in range(6):
        into = (np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2)))
        now = hmm.expect(m, data, into)
        assert into[2].sum() == pytest.approx(600)
        assert now >= last - 1e-6
        last, m = now, hmm.maximise(m, *into, np.full(5, 0.2), mass=1e-9)


def brute_minhash(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(minhash.LOWER_SPACE).split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = {i: i for i in sets}
    for _ in range(5):
        for i, j in itertools.permutations([i for i in sets if i is not None], 2):
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[i] for y in sets[j]):
                comp[i] = min(comp[i], comp[j])
    seen = Counter()
    out = []
    for i, *_ in rows:
        out.append((i, len(sets[i][seen[i]]), comp[i], i is None or comp[i] == i))
        seen[i] += 1
    return sorted(out, key=repr)


def test_minhash_equals_brute_force(spark, docs, no_docs, monkeypatch):
    assert sorted_rows(minhash.near_duplicates(docs)) == brute_minhash(edge_rows())
    assert minhash.near_duplicates(no_docs).count() == 0
    words = prose(9, 100).split()
    rows = [(i, " ".join(f"{w}{i}" if k == 3 * i % 100 else w for k, w in enumerate(words))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_minhash(rows)
    for block in (minhash.BLOCK, (4, 8)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert sorted_rows(minhash.near_duplicates(df)) == want


def test_minhash_finds_all_links_of_a_crowded_region(spark):
    """Sets alike but not linked, among them pairs that share nothing the others do not."""
    words, r, rows = prose(21, 300).split(), np.random.default_rng(5), []
    words = [f"{w}{k}" for k, w in enumerate(words)]
    for i in range(400):
        if i % 2 == 0:
            places = set((r.choice(36, 8, replace=False) * 8 + r.integers(0, 3, 8) + 4).tolist())
        rows.append((i, " ".join(f"{w}x{i}" if k in places else w for k, w in enumerate(words))))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(a, b) for a, b in itertools.combinations(range(400), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = list(range(400))
    for _ in range(20):
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert len(near) >= 200 and len(set(comp)) > 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(comp))


@pytest.mark.parametrize("block", [minhash.BLOCK, (8, 16)])
def test_minhash_loses_no_link_between_groups_on_one_text(spark, monkeypatch, block):
    """Groups of three near 0.77 on one base text, across groups near 0.72: every region is crowded and mixed."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = np.random.default_rng(11)
    base = [f"w{k}" for k in range(1200)]
    rows = []
    for g in range(60):
        own = r.choice(240, 21, replace=False) * 5
        group = [f"g{g}" if k in set(own.tolist()) else w for k, w in enumerate(base)]
        for c in range(3):
            changed = set((r.choice(240, 16, replace=False) * 5 + 2).tolist())
            rows.append((len(rows), " ".join(f"c{g}_{c}" if k in changed else w for k, w in enumerate(group))))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = list(range(len(rows)))
    for _ in range(60):
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))
    assert len(set(comp)) > 20 and len(near) > 60


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    res = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted_rows(df.select(*cols)) == sorted(res.fetchall(), key=repr)
