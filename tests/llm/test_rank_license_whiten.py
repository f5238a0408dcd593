"""License templates, ranked search and whitening against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import op11_license_templates as op11
from netloom.llm import op12_bag_rank as op12
from netloom.llm import op13_whitening as op13

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, matches string, n_words int, row int, hash int, terms int"


def terms(text):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def as_regex(text):
    """A template as a regular expression over words that each end in a space."""
    out, at = "", 0
    literal = lambda s: "".join(re.escape(w) + " " for w in terms(s))
    for m in re.finditer(r'<<(beginOptional|endOptional|var;.*?)>>(?=[^>]|$)', text):
        out += literal(text[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            out += "(?:"
        elif m[1] == "endOptional":
            out += ")?"
        else:
            options = []
            for option in re.search('match="(.*?)"', m[1])[1].split("|"):
                counted = re.fullmatch(r"\.\{(\d+),(\d+)\}", option)
                options.append(f"(?:[^ ]+ ){{{counted[1]},{counted[2]}}}" if counted else literal(option))
            out += "(?:" + "|".join(options) + ")"
    return re.compile(out + literal(text[at:]))


def by_hand(text, templates):
    """(label, first word, end) of the longest match of every template from every word."""
    words, found = terms(text), []
    for label, template in templates:
        pattern = as_regex(template)
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[i:j]))]
            if ends:
                found.append((label, i, ends[-1]))
    return sorted(found)


MADE = [
    ("one", 'alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> <<var;name="x";match="one|two three|">> omega'),
    ("two", 'beta <<var;name="who";original="me";match=".{1,3}">> alpha<<beginOptional>>, beta<<endOptional>>'),
    ("three", '<<beginOptional>>gamma<<endOptional>> omega alpha <<var;match=".{0,2}">>'),
]


def license_rows():
    r = random.Random(11)
    words = ["Alpha", "beta", "GAMMA,", "omega.", "one", "two", "three", "x", "Apache", "license", "MIT", "cc", "by"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(14)))) for i in range(80)]
    return [*rows, (90, None), (91, ""), (92, "alpha\n\tomega"), (93, "CC BY-NC 4.0, cc/by; Apache\x0blicense GNU General Public License mit License"), (90, None), (93, rows[3][1]), (None, "mit license")]


def test_templates(spark):
    rows = license_rows()
    df = spark.createDataFrame([(k, t, "en", "m", 1, 2, 3, 4) for k, t in rows], SCHEMA).repartition(3)
    templates = [*MADE, *op11.BASE.items()]
    templates = [(label, t) for label, t in MADE] + [(label, phrase) for phrase, label in op11.BASE.items()]
    got = op11.scan(df, templates=MADE).select("doc_id", "text", "lang", "row", "n_words", "matches").collect()
    want = sorted(((k, len(terms(t)), by_hand(t, templates)) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, sorted((m.label, m.from_word, m.to_word) for m in r.matches)) for r in got), key=str) == want
    assert len({m.label for r in got for m in r.matches}) == 7 and {r.row for r in got} == {2}
    assert op11.scan(df.limit(0)).count() == 0


def test_public_templates_accept_their_wording():
    import pyarrow as pa

    scanner = op11.Scanner(op11.TEMPLATES, op11.BASE)
    full = " ".join(re.sub(r'<<var;[^>]*?match="([^"]*)">>', lambda m: "Jane Doe" if m[1].startswith(".") else m[1].split("|")[0], t).replace("<<beginOptional>>", "").replace("<<endOptional>>", "") + " ." for t in (op11.TEMPLATES[0][1],))
    without = re.sub(r"Jane Doe", "the Foo project", full).replace("(including the next paragraph)", "")
    spoilt = full.replace("free of charge", "for a fee")
    labels = [{scanner.automata[a].label for _, _, a, _ in found} for found in scanner.find(pa.array([full, without, spoilt, None]))[1]]
    assert "MIT" in labels[0] and "MIT" in labels[1] and "MIT" not in labels[2] and labels[3] == set()
    for bad in ("<<endOptional>> a", "<<beginOptional>> a", '<<var;match=".+">> a', "<<var;name=x>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            op11.Automaton.of("bad", bad)


def test_license_query(spark):
    got = {r.doc_id: r for r in op11.op11_license_templates(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for k, t in texts.items():
        w = terms(t)
        places = sorted((i, label) for phrase, label in op11.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def ranked(docs, items, k):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_all, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    texts = {}
    for i, t in dict.fromkeys(items):
        texts.setdefault(i, []).extend(terms(t))
    out = []
    for i, words in texts.items():
        scored = []
        for d, bag, n in bags:
            m = 25 + 75 * n * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    r = random.Random(12)
    words = ["the", "The", "of", "déjà", "Ωmega", "42", "x1", "rare", *(f"w{i}" for i in range(30))]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))) for i in range(150)]
    docs += [(200 - i, docs[5][1].upper() if i % 2 else docs[5][1]) for i in range(40)]  # one class of many
    docs += [(300, None), (301, ""), (302, " ,. "), (303, "rare " * 3000), (7, docs[7][1]), (None, docs[5][1]), (None, None)]
    items = [(1, docs[5][1]), (2, "the the of rare"), (3, None), (4, ""), (5, "nowhere"), (None, "Ωmega déjà"), (1, docs[5][1]), (2, "w3 w4"), (6, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("block_items", [2048, 1])
def test_ranked_search(spark, block_items):
    docs, items = search_rows()
    df = spark.createDataFrame([(k, t, "en", "m", 1, 2, 3, 4) for k, t in docs], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    got = op12.search(df, bench, k=10, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 10)
    assert op12.search(df.limit(0), bench).count() == 0 and op12.search(df, bench.limit(0)).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    real = op12.tv.word_hashes
    monkeypatch.setattr(op12.tv, "word_hashes", lambda *a: real(*a) % np.uint64(3))
    known = op12.Vocabulary([["aa bb cc dd"], ["bb ee"]])
    data, starts, ends, _, hashes = op12._terms(pa.array(["ee xx aa bb yy dd b"]))
    found = known.numbers(data, starts, ends, hashes)
    assert [known.terms[i].decode() if i >= 0 else None for i in found] == ["ee", None, "aa", "bb", None, "dd", None]


def test_members_are_cut_before_the_exchange(spark):
    held = spark.createDataFrame([(1, 1, 5, [1], [2])], "row long, doc_id long, n long, terms array<int>, times array<long>").write.mode("overwrite")
    folder = op12.stored(spark.range(1)).inputFiles()[0].rpartition("/")[0] + "-held"
    held.parquet(folder)
    rows = op12.classes(spark.read.parquet(folder), 1, 5, k=10)
    assert rows.count() == 1
    order = op12.Window.partitionBy("n", "terms").orderBy("doc_id")
    plan = spark.read.parquet(folder).withColumn("nth", F.row_number().over(order)).filter("nth <= 10")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def whitened_by_hand(vectors, k):
    x = np.floor(np.array(vectors, np.float64) * 64) + 1_000_000
    c = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(c.T @ c / len(x))
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    whole = [[int(a) for a in row] for row in x]
    sums = [sum(col) for col in zip(*whole, strict=True)]
    deviation = [sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in whole]
    return c @ turn / np.sqrt(values), values / np.trace(c.T @ c / len(x)), deviation


@pytest.mark.parametrize(("n", "dim", "k"), [(400, 24, 10), (400, 24, 24), (300, 120, 6), (12, 24, 8)])
def test_whitening(spark, n, dim, k):
    r = np.random.default_rng(13)
    x = r.normal(size=(n, dim)) * np.exp(-np.arange(dim) / 6) @ np.linalg.qr(r.normal(size=(dim, dim)))[0]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [(-1, None, ""), (-2, [float("nan")] + [1.0] * (dim - 1), ""), (-3, [None] + [1.0] * (dim - 1), ""), (-4, [float("inf")] * dim, ""), (-5, [], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string").repartition(3)
    got = op13.whiten(df, components=k).collect()
    want, explained, deviation = whitened_by_hand(x, k)
    assert len(got) == n * k
    w = np.zeros((n, k))
    for g in got:
        w[g.vec_id, g.component - 1] = g.whitened
        assert g.n == n and int(g.deviation) == deviation[g.vec_id] and abs(g.explained / explained[g.component - 1] - 1) < 1e-9 and g.identity_error < 1e-9
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-6


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert op13.whiten(spark.createDataFrame([], schema)).count() == 0
    assert op13.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    # Repeated ids, a missing id, zero vectors, vectors of two lengths, and a dimension without variance.
    rows = [(1, [0.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (None, [0.0, 2.0, 5.0]), (4, [3.0, 3.0, 5.0]), (5, [1.0]), (6, [2.0])]
    got = op13.whiten(spark.createDataFrame(rows, schema))
    assert sorted((r.dim, r.component, r["count"]) for r in got.groupBy("dim", "component").count().collect()) == [(1, 1, 2), (3, 1, 4), (3, 2, 4)]
    assert sorted(round(r.whitened, 9) for r in got.filter("dim = 1").collect()) == [-1.0, 1.0]


def test_repeated_variances_are_found_as_often_as_they_occur():
    r = np.random.default_rng(5)
    x, _ = np.linalg.qr(r.normal(size=(200, 40)) - 0.0)
    x = x * np.repeat([4.0, 3.0, 2.0, 1.0], 10)
    values, vectors, steps = op13.bidiagonalise(lambda p: x.T @ (x @ p), 40, 20, float((x * x).sum()))
    assert np.allclose(values[:20], np.repeat([16.0, 9.0], 10)) and steps <= 40
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)


def test_large_tables_end_early_and_sums_stay_exact():
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 300)) * np.exp(-np.arange(300) / 4)
    values, _, steps = op13.bidiagonalise(lambda p: x.T @ (x @ p), 300, 8, float((x * x).sum()))
    assert np.allclose(values[:8], np.linalg.svd(x, compute_uv=False)[:8] ** 2) and steps < 120
    assert op13._exact(np.array([[2**40], [3]])).dtype == object and op13._exact(np.array([[2**20]])).dtype == np.int64


def test_a_row_repeated_often_costs_what_its_repeats_cost(spark):
    """Each repeat meets its own draws alone: thousands of repeats of a long row are as many rows, not their square."""
    from netloom.llm import op9_mixture as op9

    text = " ".join(f"w{i}" for i in range(320))
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("a").alias("source"), F.create_map(F.lit("k"), F.lit(1)).alias("extra"))
    df = df.unionByName(spark.createDataFrame([(2, "one two three", "b"), (2, "one two three", "b")], "doc_id long, text string, source string").withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id").cast("int"))))
    taken = {r.source: r.n for r in op9.mixed(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = op9.mix(df)
    assert {r.source: r.n for r in got.groupBy("source").agg(F.sum(op9.words(F.col("text"))).alias("n")).collect()} == {k: n for k, n in taken.items() if n}
    assert got.filter("source = 'a'").count() >= 4000 and {r.k for r in got.filter("source = 'b'").select(F.col("extra")["k"].alias("k")).collect()} <= {2}
