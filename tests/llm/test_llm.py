"""Operators against plain versions: odd rows, small tables, held-out accuracy and round trips."""

import glob
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from netloom.llm import (
    op1_substring_dedup as op1,
    op2_decontaminate as op2,
    op3_cross_polytope as op3,
    op4_quality as op4,
    op5_training_order as op5,
    op6_toxicity as op6,
    op7_bagminhash as op7,
    op8_token_counts as op8,
    op9_mixture as op9,
    op10_brown as op10,
)

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, score double"


def odd_rows():
    """Nulls, empties, ties, repeats, a long text, odd white space, and words in several scripts."""
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "déjà", "x", "42", "Ωmega", "the", "of", "—"]
    passage = " ".join(r.choice(words) + str(i) for i in range(30))
    texts = {0: passage, 1: f"start {passage} end", 2: passage, 3: None, 4: "", 5: " \t\n\x0b ", 6: "one", 7: "one two three four", 8: passage.upper(), 9: "a b " * 2000 + passage, 10: "zero width\x1f join " + passage, 11: "\n".join(passage.split()), 12: "word " * 40}
    rows = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}", None, k, 0.5) for k, t in texts.items()]
    return [*rows, rows[2], (None, passage, None, None, None, None, None), (None, None, None, "s1", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_substring_dedup(spark, odd, empty, docs):
    for df in (odd, docs):
        got = op1.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h"))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute.substring_dedup(pairs(df))
    assert op1.substring_dedup(empty).count() == 0
    spans = {r.doc_id: r.removed for r in op1.substring_dedup(odd).collect() if r.doc_id == 1}
    assert [tuple(s) for s in spans[1]] == [(1, 31)]


def test_maximal_repeats(spark):
    r = random.Random(4)
    passages = [[f"w{r.randrange(8)}" for _ in range(30)] for _ in range(5)]
    rows = []
    for i in range(24):
        text = []
        for _ in range(3):
            passage, a = r.choice(passages), r.randrange(8)
            text += [*passage[a : a + r.randrange(10, 22)], *(f"u{i}_{r.randrange(3)}" for _ in range(r.randrange(3)))]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (5, 13):
        got = sorted(tuple(x) for x in op1.maximal_repeats(df, min_words=least, batch_bytes=400).collect())
        assert got == brute.maximal_repeats(rows, least) and len(got) > 20
        cut = op1.substring_dedup(df, min_words=least, batch_bytes=400).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert sorted((tuple(x) for x in cut.collect()), key=str) == brute.substring_dedup(rows, least)
    assert op1.maximal_repeats(df.limit(0)).count() == 0


def test_substring_dedup_spreads_rows_without_ids(spark):
    """Rows without an id, or of one id, don't meet in one batch."""
    df = spark.createDataFrame([(None, f"a{i} " * 20) for i in range(200)], "doc_id long, text string")
    forest, batched, _, _ = op1._planted(df, 13, 500, False)
    assert forest.batches > 20 and batched.groupBy("batch").count().agg(F.max("count")).first()[0] < 20


CLASHES = ("k", "passes", "drawn", "mix_key", "d", "kept_id", "n_words", "n_hit", "items", "hits", "t1", "t2", "k1", "k2", "copy", "shard", "place", "turn", "at", "toxicity", "nth", "alone", "label", "size")


def test_columns_of_clashing_names_stay(spark, odd):
    df = odd.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    bench = spark.createDataFrame([(1, "one"), (2, odd_rows()[0][1])], "item_id long, text string")
    model = op6.fit(df, spark.createDataFrame([(k, k % 2) for k in range(13)], "doc_id long, toxic int"))
    for got in (op2.drop_contaminated(df, bench), op2.cut_spans(df, bench), op6.drop_toxic(df, model, at=1.1), op7.drop_near_duplicates(df), op9.mix(df)):
        assert got.columns == df.columns and {tuple(r) for r in got.select(*CLASHES).distinct().collect()} == {tuple(range(len(CLASHES)))}


@pytest.mark.parametrize("most", [1_000_000, 200])
def test_decontaminate(spark, odd, empty, docs, most):
    items = [(1, " ".join(odd_rows()[0][1].split()[5:20])), (2, "one TWO three"), (3, None), (4, ""), (10, "word"), (None, "déjà"), (1, "42 42")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op2.scan(odd.select("doc_id", "text"), bench, most_windows=most)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute.decontaminate(pairs(odd), items)
    assert op2.scan(empty, bench).count() == 0 and op2.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert op2.drop_contaminated(odd, bench).columns == odd.columns
    cut = {r.doc_id: r.text for r in op2.cut_spans(odd, bench).collect()}
    assert cut[6] == "one" and cut[7].split() == ["four"]


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 24))
    x[50] = x[40] = x[20]
    x *= r.uniform(0.5, 2, (400, 1))
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1001, [0.0] * 24, ""), (1002, [float("nan")] + [1.0] * 23, ""), (1003, [None] + [1.0] * 23, ""), (1004, [1.0] * 7, ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = defaultdict(list)
    for g in op3.nearest(df, is_query=F.col("vec_id") % 20 == 0, k=10, block_rows=64).orderBy("rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:10]
        assert len(got[q]) == 10 and all(abs(x[v] @ x[q] - score) < 1e-9 for v, score in got[q])
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
    assert len(got) == 20 and hits >= 0.9 * 200
    few = op3.nearest(df.filter("vec_id < 3"), is_query=F.col("vec_id") == 0)
    assert {r.vec_id for r in few.collect()} == {1, 2}
    assert op3.nearest(df.limit(0), is_query=F.lit(True)).count() == 0


def auc(score, label):
    values, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return (rank[label == 1].mean() - (label.sum() + 1) / 2) / (label == 0).sum()


@pytest.mark.parametrize("query, label, least", [(op4.op4_quality, "quality", 0.95), (op6.op6_toxicity, "toxic", 0.8)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = query(spark, folder).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(*map(np.array, zip(*held))) > least


@pytest.mark.parametrize("op, label, scored", [(op4, "quality", op4.score_quality), (op6, "toxic", op6.score_toxicity)])
def test_classifiers_on_odd_rows(spark, odd, empty, op, label, scored):
    labels = spark.createDataFrame([(k, k % 2) for k in range(13)] + [(None, 1), (5, None), (6, 1)], f"doc_id long, {label} int")
    model = op.fit(odd, labels)
    got = scored(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    none = op.fit(odd, labels.limit(0))
    assert scored(empty, none).count() == 0 and len({r.score for r in scored(odd, none).collect()}) == 1


def test_toxicity_keeps_rare_words(spark):
    """An insult with a handful of contexts, in no ordinary document, is evidence."""
    r = random.Random(8)
    plain = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("lan", "mir", "nos", "pet", "rul", "sav", "tik", "vom")]
    rows = [(i, " ".join([*(r.choice(plain) for _ in range(20)), *(["zugword"] if i % 10 == 0 else []), *(r.choice(plain) for _ in range(9))]), int(i % 10 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op6.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    clean = " ".join(plain[:15])
    with_insult, without, nothing = model(op6.pa.array([f"{clean} zugword {clean}", clean, None]))
    assert with_insult > 0.5 and without < 0.5 and nothing < 0.5


def test_toxicity_models_are_distributions(spark):
    """All words together have probability 1 after any word, in both classes; a pair's order matters; scores are sums by hand."""
    r = random.Random(2)
    plain = [f"p{i}lain" for i in range(40)]
    rows = []
    for i in range(200):
        text = [r.choice(plain) for _ in range(25)]
        text[3], text[5], text[9], text[11] = "go", "away", "away", "go"
        text[15:17] = ["go", "away"] if i % 4 == 0 else text[15:17]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op6.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    m = model.models
    words = m.words.keys[:-1]
    p = m.p_word[:-1]
    assert np.allclose(p.sum(axis=0), 1)
    for before in (*m.pairs.firsts[:-1], np.uint64(7)):
        assert np.allclose(m.pairs(np.full(len(words), before), words, p).sum(axis=0), 1, atol=1e-9)
    good, bad = "p1lain go p2lain away p3lain", "p1lain p2lain go away p3lain"
    toxic, ordinary = m(op6.pa.array([bad, good]))
    assert toxic > ordinary + 0.1
    logs, at = m.likelihoods(op6.pa.array([bad, good, None, "go"]))
    by_hand = [max((logs[i : min(i + m.window, z), 1] - logs[i : min(i + m.window, z), 0]).mean() for i in range(a, max(z - m.window, a) + 1)) if z > a else 0.0 for a, z in zip(at[:-1], at[1:])]
    assert np.allclose(m(op6.pa.array([bad, good, None, "go"])), by_hand)


def test_toxicity_cuts_stems_at_characters():
    words, stems, at = op6._tokens(op6.pa.array(["дурак дуга дуракам", "笨蛋 笨", "idiot IDIOTS ab", "", None, "é"]))
    assert at.tolist() == [0, 3, 5, 8, 8, 8, 9] and len(set(words.tolist())) == 9
    assert stems[0] == stems[2] != stems[1] and stems[3] != stems[4] and stems[5] == stems[6] and stems[7] == words[7] and stems[8] == words[8]


def test_training_order(spark, odd, empty, tmp_path):
    ordered = op5.materialise(odd, length=16, shards=3)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    vocabulary = op5.Vocabulary()
    text = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        text[r.doc_id].append(np.frombuffer(r.tokens, "<u2")[: r.n_tokens])
    for doc, t in pairs(odd):
        if doc not in (2, None):
            ids = np.concatenate(text[doc])
            assert ids[-1] == vocabulary.end and vocabulary.encoding.decode(ids[:-1].tolist()) == (t or "")
    op5.write_shards(ordered, str(tmp_path / "shards"))
    files = sorted(glob.glob(str(tmp_path / "shards/part-*")))
    stored = np.concatenate([op5.read_records(Path(f).read_bytes(), 16) for f in files])
    assert (stored == np.stack([np.frombuffer(r.tokens, "<u2") for r in sorted(rows, key=lambda r: r.slot)])).all()
    resumed = op5.read_records(Path(files[1]).read_bytes(), 16, first=2)
    assert (resumed == op5.read_records(Path(files[1]).read_bytes(), 16)[2:]).all()
    assert op5.materialise(empty).count() == 0


def test_near_duplicates(spark, odd, empty):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for family in range(12):
        text = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(9):
            copy = list(text)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.class_id) for x in op7.near_duplicates(df, block=3).collect())
    assert got == brute.near_classes(rows)
    some = {x.doc_id: x.class_id for x in op7.near_duplicates(odd).collect()}
    assert some[2] == 0 and some[11] == 0 and some[3] == 3 and some[4] == 4 and some[6] == 6
    assert op7.near_duplicates(odd).count() == len(odd_rows()) and op7.near_duplicates(empty).count() == 0
    assert op7.drop_near_duplicates(odd).columns == odd.columns


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """One row of each content stays; every text of an id is compared, and so are texts without an id."""
    words = [f"w{i}" for i in range(100)]
    text, near, other = " ".join(words), " ".join([*words[:50], "x", *words[51:]]), " ".join(reversed(words))
    rows = [(1, text), (1, text), (1, other), (2, near), (None, near), (3, other), (None, other), (None, ""), (None, ""), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r.doc_id, r.class_id): r.class_key for r in op7.near_duplicates(df).collect()}
    assert len({k for (_, c), k in keys.items() if c == 1}) == 1 or {c for _, c in keys} == {1, None, 4}
    got = sorted((r.doc_id or 0, r.text) for r in op7.drop_near_duplicates(df).collect())
    assert got == sorted([(0, ""), (0, ""), (4, ""), (1, text), (1, other)])
    nameless = spark.createDataFrame([(None, text), (None, near), (None, other)], "doc_id long, text string")
    assert op7.drop_near_duplicates(nameless).count() == 2 and len({r.class_key for r in op7.near_duplicates(nameless).collect()}) == 2


def test_many_small_components_of_one_bucket(spark):
    """What shares a long passage below the threshold stays apart, and every near copy among it is found."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(75)]
    rows = []
    for family in range(40):
        own = [f"f{family}_{i}" for i in range(25)]
        rows.append((len(rows), " ".join(common + own)))
        if family % 4 == 0:
            own[r.randrange(25)] = "x"
            rows.append((len(rows), " ".join(common + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.class_id) for x in op7.near_duplicates(df, block=4).collect())
    assert got == brute.near_classes(rows) and len({c for _, c in got}) == 40


def test_signature_is_unbiased():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 6, 60), r.integers(0, 6, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for trial in range(40):
        keys = r.integers(1, 2**63, 60, dtype=np.uint64)
        shingle, doc, count = np.concatenate([keys[a > 0], keys[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]])
        s = op7.bagminhash(shingle, doc, count, 2, 128)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


def test_token_counts_after_edits(spark, odd, empty):
    base = odd.filter("doc_id is null or doc_id <> 2")
    edits = spark.createDataFrame([(0, 3, 5, "XY z"), (0, 3, 0, " q"), (0, 9999, 4, " tail"), (1, 0, 0, None), (4, 0, 0, "new text"), (9, 4000, 30, "\n\n  it's"), (12, 10, 100, ""), (77, 1, 1, "lost"), (None, 1, 1, "x"), (6, -3, None, "pre ")], "doc_id long, at int, delete int, insert string")
    encoding = op8.Vocabulary().encoding
    todo = defaultdict(list)
    for r in edits.filter("doc_id is not null").collect():
        todo[r.doc_id].append((max(r["at"] or 0, 0), max(r["delete"] or 0, 0), r["insert"] or ""))
    rows = op8.apply_edits(base, op8.build(base), edits).collect()
    assert len(rows) == base.count()
    texts = dict(pairs(base))
    for r in rows:
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(encoding.encode_ordinary(text))
        limit = len(text)
        for at, delete, insert in sorted(todo[r.doc_id], reverse=True):
            at = min(at, limit)
            text, limit = text[:at] + insert + text[at + min(delete, limit - at) :], at
        assert (r.text, r.n_tokens_after) == (text, len(encoding.encode_ordinary(text)))
    assert op8.apply_edits(empty, op8.build(empty), edits).count() == 0


def test_mixture(spark, odd, empty, docs):
    rows = op9.mixed(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weights[s] / sum(w for k, w in weights.items() if k not in capped) for s in by if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            target = share | {s: 3.0 * sizes[s] for s in capped}
            break
        capped |= over
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sizes[s]} and abs(rs[0].target - target[s]) < 1e-6 * target[s] + 1e-9
        assert abs(sum(r.taken for r in rs) - target[s]) < 0.1 * target[s] + 64
    again = sorted((r.doc_id, r.taken) for r in op9.mixed(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in rows)
    assert op9.mixed(odd).count() == len(odd_rows()) and op9.mixed(empty).count() == 0
    mixed = op9.mix(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(op9.words(F.col("text")))).first()[0] == sum(r.taken for r in rows)


def test_mixture_gives_shards_and_places(docs):
    rows = op9.mixed(docs, shard_words=1 << 11).collect()
    draws = [(d.shard, d.place, d.block, r.source, r.doc_id) for r in rows for d in r.draws]
    by, quotas = defaultdict(list), defaultdict(int)
    for shard, place, _, source, _ in draws:
        by[shard].append(place)
        quotas[source] += 1
    # The number of shards follows the sizes' sum; places count on without gaps; shards are of one size.
    assert len(by) == -(-int(sum({r.source: r.target for r in rows}.values())) // (1 << 11)) > 16
    assert all(sorted(places) == list(range(len(places))) for places in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 8
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    want = op9.split_quotas(np.array([quotas[s] for s in names]), len(by), 9)
    got = np.zeros_like(want)
    for shard, _, _, source, _ in draws:
        got[shard, names.index(source)] += 1
    assert (got == want).all()
    first = min(draws)[4]
    assert op9.mix(docs, shard_words=1 << 11).first().doc_id == first


def test_mixture_of_one_text_in_several_sources(spark):
    """One id and text in two sources counts in each; repeated rows are drawn one by one; no word of a draw is lost."""
    rows = [(1, "dup text " * 200, s) for s in ("A", "B")] + [(2, "a b c " * 30, None)] * 3 + [(i, f"w{i} " * 90, "A") for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op9.mixed(df, block_words=8).collect()
    assert len(got) == len(rows)
    for source in ("A", "B", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8 * len(mine) and all(r.taken <= 3 * r.size for r in mine)
        assert all(r.taken == sum(min(8, r.size - 8 * d.block) for d in r.draws) for r in mine)
    mixed = op9.mix(df, block_words=8)
    assert mixed.select(F.sum(op9.words(F.col("text")))).first()[0] == sum(r.taken for r in got)


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (50, 70, 90), (3, 400, 200), (10**12, 3 * 10**12, 10**12)])
def test_hypergeometric_at_any_size(good, bad, draws):
    rng = np.random.default_rng(1)
    x = np.array([op9.hypergeometric(rng, good, bad, draws) for _ in range(4000 if good < 10**6 else 60)], float)
    total = good + bad
    mean, var = draws * good / total, draws * good / total * bad / total * (total - draws) / (total - 1)
    assert abs(x.mean() - mean) < 4.5 * (var / len(x)) ** 0.5 and 0.5 < x.var() / var < 1.7
    assert x.min() >= max(0, draws - bad) and x.max() <= min(good, draws)
    if good < 10:
        from math import comb

        for k in range(min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(total, draws)
            assert abs((x == k).mean() - p) < 4.5 * (p * (1 - p) / len(x)) ** 0.5 + 1e-9


def test_splitting_tree_is_exact():
    quotas = np.array([5, 0, 123, 4000])
    out = op9.split_quotas(quotas, 7, 1)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 4


def test_brown_base_and_score(spark, odd, empty, docs):
    def run(df):
        rest = op10.remainder(F.col("doc_id"), 7)
        return op10.score(df, held_out=rest == 2, learn=rest != 2).collect()

    want = brute.base_scores(pairs(docs))
    got = run(docs)
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(run(odd)) == len(odd_rows()) and all(np.isfinite(r.score) for r in run(odd)) and run(empty) == []


def test_brown_probabilities_add_up(spark, docs):
    """After any class, all words and the unseen word of each shape have probability 1 together."""
    known = op10._Clustered(docs.select("doc_id", "text", F.lit(False).alias("held_out"), F.lit(True).alias("learn")), least=2, rounds=2, batch_bytes=1 << 18, classes=None)
    model, words = known.model(), known.words().collect()
    place, count = np.array([r["class"] for r in words]), np.array([r.n for r in words])
    shapes = known.classes + np.arange(op10._SHAPES)
    place, count = np.concatenate([place, shapes]), np.concatenate([count, np.zeros(op10._SHAPES, int)])
    spell = np.where(count > 0, np.maximum(count - model.off[place], 1e-9) / model.in_class[place], model.unseen[place])
    by = np.bincount(place, spell, known.classes + op10._SHAPES)
    held = np.bincount(place, count > 0, len(by)) > 0
    unheard = np.isin(np.arange(len(by)), shapes) & (np.bincount(place, count, len(by)) == 0)
    # A shape that training never saw has its unseen word alone; the end has no unseen word.
    assert np.allclose(by[held & (np.arange(len(by)) != model.end)], 1, atol=1e-6) and np.allclose(by[unheard], 1)
    total = (10.0**model.step).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-9)
    # Every word seen twice has a Brown class, however many there are.
    assert all((r["class"] < known.classes) == (r.n >= 2) for r in words if r["class"] != model.end) and sum(r.n >= 2 for r in words) > 4 * known.classes


def test_brown_finds_planted_classes(spark):
    r = random.Random(9)
    kinds, per = 4, 30
    text = lambda n: " ".join(f"k{(i % kinds)}x{r.randrange(per)}y" for i in range(n))
    df = spark.createDataFrame([(i, text(400)) for i in range(60)], "doc_id long, text string").repartition(5)
    found = {x.word: x["class"] for x in op10.word_classes(df, classes=16, rounds=2, batch_bytes=20_000).collect()}
    names = [f"k{k}x{j}y" for k in range(kinds) for j in range(per)]
    hashes, _, at = op10.tokens(op10.pa.array(names))
    of = [found[int(h.view(np.int64))] for h in hashes[at[:-1]]]
    own = [set(of[k * per : (k + 1) * per]) for k in range(kinds)]
    assert all(not own[a] & own[b] for a in range(kinds) for b in range(a)) and max(of) < 16


def test_moves_take_the_best_class():
    r = np.random.default_rng(3)
    classes, k, n = 3, 5, 40
    grid, counts, now = r.integers(0, 200, (k, k)).astype(float), r.poisson(1.0, (n, 2 * k)), r.integers(-1, classes, n)
    word, column = np.nonzero(counts)
    got = op10.moves(word, column, counts[word, column], grid, classes, now, chunk=16)
    f = lambda x: np.where(x > 1, x * np.log(np.maximum(x, 1)), 0)
    for w in range(n):
        gain = []
        for c in range(classes):
            g = np.concatenate([grid[c], grid[:, c]])
            rest = np.maximum(g - counts[w] * (c == now[w]), 0)
            total = np.array([grid[c].sum(), grid[:, c].sum()])
            own = np.array([counts[w, :k].sum(), counts[w, k:].sum()])
            left = np.maximum(total - own * (c == now[w]), 0)
            gain.append((f(rest + counts[w]) - f(rest)).sum() - (f(left + own) - f(left)).sum())
        assert gain[got[w]] > max(gain) - 2e-2


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(0)
    classes, per = 4, 6
    of = np.arange(classes * per) % classes
    rate = np.where((of[:, None] + 1) % classes == of[None, :], 40.0, 1.0)
    found = op10.exchange(r.poisson(rate).astype(float), classes * per, classes)
    assert all(len(set(found[of == k])) == 1 for k in range(classes))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL).persist()
        assert kept.columns == docs.columns
        counts[name] = kept.count()
        if name == "near_dedup":
            rows = pairs(kept)
            assert brute.near_classes(rows) == sorted((d, d) for d, _ in rows)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert all(r[2] == 0 for r in brute.decontaminate(pairs(kept), items))
    assert counts["toxicity"] > 0.6 * docs.count() and counts["decontamination"] > 0.7 * counts["near_dedup"]
    last = corpus_pipeline.run(spark, SMALL)
    assert {"slot", "shard", "tokens"} <= set(last.columns)
    slots = sorted(r.slot for r in last.select("slot").collect())
    assert slots == list(range(len(slots)))
