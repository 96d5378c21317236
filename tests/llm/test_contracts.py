"""The registered queries against SQL or brute force over whole tables, and defined results of odd inputs."""

import datetime
import decimal
import hashlib
import itertools
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tephra.llm import common, decontaminate, licences, mixing, pii, quality, queries, secrets, sharding, simhash, urls, warc

from .test_scans import brute_pii, brute_secrets

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "plain words " * 30), (4, "plain words " * 30), (None, "ann@mail.example.com token = 'abcdef123456'"), (None, None)]
CLASH = ("kept", "row", "uid", "h", "spans", "found", "hits", "size", "shard", "n", "key", "order")


def clashing(df, names=CLASH):
    """df with further columns of these names."""
    return df.withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="module")
def odd_texts(spark):
    """Nulls, empty texts, repeated rows and columns whose names the operators use themselves."""
    return clashing(spark.createDataFrame(ODD, "doc_id long, text string"))


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.isoformat() if isinstance(v, datetime.datetime) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize(("name", "brute", "kinds"), [("op2_pii", brute_pii, pii.BASE), ("op6_secrets", brute_secrets, secrets.BASE)])
def test_base_columns_of_the_registered_queries(spark, sf, name, brute, kinds):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()[name](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [f"{k}:{a}:{z}" for k, a, z in brute(texts[r.doc_id])]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(f"{k}:") for x in base) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x.split(":")[0] in kinds] == base
        taken = sorted(tuple(map(int, x.split(":")[1:])) for x in spans if x.split(":")[0] not in kinds)
        solid = [tuple(map(int, x.split(":")[1:])) for x in base]
        assert all(z <= b for (_, z), (b, _) in itertools.pairwise(taken)) and all(z <= b or a >= e for a, z in taken for b, e in solid)


def test_odd_texts_have_defined_results(spark, odd_texts):
    want = Counter(d for d, _ in ODD)
    found = {"pii": pii.personal_data(odd_texts), "secrets": secrets.find_secrets(odd_texts), "licences": licences.scan(odd_texts), "simhash": simhash.near_duplicates(odd_texts), "leaks": decontaminate.contamination(odd_texts, clashing(spark.createDataFrame([(1, "plain words")], "item_id long, text string")))}
    for df in found.values():
        assert Counter(r.doc_id for r in df.select("doc_id").collect()) == want
    assert {r.doc_id: [s.kind for s in r.spans] for r in found["pii"].collect() if r.doc_id} == {1: [], 2: [], 3: [], 4: []}
    assert Counter((r.doc_id, r.n_hit) for r in found["leaks"].collect()) == Counter({(1, 0): 1, (2, 0): 1, (3, 0): 1, (4, 60): 2, (None, 0): 2})
    assert pii.redact(odd_texts).columns == odd_texts.columns
    kept = decontaminate.decontaminate(odd_texts, spark.createDataFrame([(1, "plain words")], "item_id long, text string"))
    assert kept.columns == odd_texts.columns and kept.count() == 5 and kept.first().kept == "kept"


def test_empty_tables_give_empty_results(spark, odd_texts):
    none, bench = odd_texts.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert pii.personal_data(none).count() == secrets.find_secrets(none).count() == licences.scan(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(odd_texts, bench).count() == len(ODD)


def test_pages_and_records_with_clashing_columns(spark):
    clash = ("shape", "label", "ratio", "n", "yes", "fold", "slice", "full", "canonical_url", "r")
    rows = [(1, "http://a.net/es/x"), (2, "http://b.com/de/" + "y" * 20_000), (2, "http://b.com/de/" + "y" * 20_000), (3, None), (None, "http://c.org/")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"), clash)
    got = urls.filter_urls(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "ratio"] and Counter(r.page_id for r in got.collect()) == Counter(d for d, _ in rows)
    records = spark.createDataFrame([(1, "http://a.net/" + "z" * 20_000, 5, 200, '"a"', None), (2, "http://a.net/" + "z" * 20_000, 6, 304, '"a"', None), (2, "http://a.net/" + "z" * 20_000, 6, 304, '"a"', None), (3, None, 7, 304, None, None)], "record_id long, url string, ts long, status int, etag string, last_modified string")
    out = warc.resolve(clashing(records.withColumn("headers", F.create_map(F.lit("A"), F.lit("1"))), clash)).collect()
    assert Counter((r.record_id, r.response_id, r.outcome) for r in out) == Counter({(2, 1, "confirmed"): 2, (3, None, "missing"): 1})


def test_every_group_moves_its_own_thresholds(spark):
    """Groups of all sizes against the blending rule, taken from all values."""
    rng, rows, values = random.Random(3), [], {}
    for lang, source, n, length in (("en", "long", 300, 9), ("en", "few", 3, 8), ("en", "usual", 600, 5), (None, None, 40, 7), ("de", "usual", 10, 6)):
        for _ in range(n):
            words = ["".join(rng.choices("abcdefghij", k=max(1, length + rng.randint(-1, 1)))) for _ in range(80)]
            rows.append((len(rows), " ".join(words), lang, source))
            values.setdefault((lang, source), []).append(sum(map(len, words)) * 100 // 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    params = quality.QualityParams()

    def top(v):  # of the bucket: 32 of them for each power of two
        octave = max(0, v.bit_length() - 6)
        return ((v >> octave) + 1 << octave) - 1

    def quartiles(vs):
        vs = sorted(map(top, vs))
        return len(vs), [vs[-(-len(vs) * q // 100) - 1] for q in (25, 50, 75)]

    blend = lambda own, prior: (own[0], [(own[0] * a + params.prior * b) // (own[0] + params.prior) for a, b in zip(own[1], prior[1])])
    everything = quartiles([v for vs in values.values() for v in vs])
    got = {(r.lang, r.source): (r.word_length_low, r.word_length_high) for r in quality.fences(quality.sketch(quality.measured(docs, False)), params).collect()}
    for (lang, source), vs in values.items():
        wide = blend(quartiles([v for (x, _), us in values.items() if x == lang for v in us]), everything)
        low, mid, high = blend(quartiles(vs), wide)[1]
        assert got[lang, source] == (low - params.reach * (mid - low) - 100, high + params.reach * (high - mid) + 100)
    assert len(set(got.values())) == len(got)
    on_fence = common.cut(quality.measured(docs, False), "q").withColumn("word_length", F.when(F.col("source") == "long", got["en", "long"][1]).otherwise(F.col("word_length")))
    limits = common.cut(quality.fences(quality.sketch(quality.measured(docs, False)), params), "limits").filter("source = 'long'")
    assert on_fence.join(limits, "source").filter("word_length <= word_length_high").count() == 300  # a value on its fence is kept


def test_candidates_take_linear_time():
    """Long texts full of candidates, with models that take half of them."""
    tree = [(1, 10.0, 1, 2, 0.0), (-1, 0.0, 0, 0, -1.0), (-1, 0.0, 0, 0, 1.0)]
    model = pii.Model([(1.0, tree)], {k: 0.5 for k in pii.KINDS})
    states = secrets.prefix_tree(["".join(x) for x in itertools.product("dh", repeat=3)])
    for piece, scan in (("(212) 555-0187, 212 555 018 ", lambda t: pii.all_spans(t, model)), ("ab1-cd2-ef3 aXb9_zz=yy ", lambda t: secrets.all_spans(t, secrets.Model(states, {}, -1e9)))):
        took = []
        for n in (75_000, 300_000):
            text = (piece * (n // len(piece) + 1))[:n]
            began = time.process_time()
            found = scan(text)
            took.append(time.process_time() - began)
            assert len(found) >= n // len(piece) - 1
        assert took[1] < 8 * took[0] + 0.5  # four times the text


def test_taken_spans_match_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        base = [(a, a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(4))]
        taken, slow = pii.Taken(base), list(base)
        for _ in range(20):
            a = rng.randrange(60)
            z = a + rng.randint(1, 5)
            free = all(z <= b or a >= e for b, e in slow)
            assert taken.add(a, z) == free
            slow += [(a, z)] if free else []


def test_secrets_generator():
    spans = lambda t: [t[a:z] for a, z in secrets.candidates(t)]
    assert spans("An ordinary Word, ORDINARY end.of-words hunter2, 123456 x a.b-c_d= AbCdEf") == ["end.of-words", "hunter2", "123456", "a.b-c_d=", "AbCdEf"]
    assert spans("short1 -dash-12- ...... ======") == ["short1", "dash-12"]


def test_hypergeometric_draws(monkeypatch):
    """The thinning rule for many items against exact probabilities, on numbers small enough for both."""
    monkeypatch.setattr(mixing, "NUMPY_MOST", 0)
    rng, good, bad, n, runs = np.random.default_rng(1), 7, 12, 9, 20_000
    seen = Counter(mixing.hypergeometric(rng, good, bad, n) for _ in range(runs))
    for k in range(good + 1):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        assert abs(seen[k] / runs - p) < 5 * math.sqrt(p * (1 - p) / runs) + 1e-9
    tree = mixing.split_tree(np.array([50, 0, 3, 17]), np.array([24, 23, 23]), rng)
    assert tree.sum(axis=0).tolist() == [50, 0, 3, 17] and tree.sum(axis=1).tolist() == [24, 23, 23] and (tree >= 0).all()
    monkeypatch.undo()
    big = np.array([3 * 10**10, 5, 10**10])
    tree = mixing.split_tree(big, np.array([2 * 10**10, 2 * 10**10 + 5]), rng)
    assert (tree.sum(axis=0) == big).all() and abs(tree[0, 0] - 1.5 * 10**10) < 10**6


def test_quotas_grant_what_fits():
    rng = random.Random(2)
    for _ in range(300):
        p = rng.randint(2, 5)
        flow = {(s, t): rng.randint(1, 9) for s in range(p) for t in range(p) if s != t and rng.random() < 0.6}
        free = [rng.randint(0, 6) for _ in range(p)]
        grant = sharding.quotas(flow, free)
        assert set(grant) == set(flow) and all(0 <= grant[x] <= flow[x] for x in flow)
        swaps = {x: min(n, flow.get(x[::-1], 0)) for x, n in flow.items()}
        for t in range(p):  # beyond the swaps, which cancel out, no shard takes more than its free places
            assert sum(grant[x] - swaps[x] for x in flow if x[1] == t) <= free[t]
        assert all(grant[x] >= swaps[x] for x in flow)


def test_propagation_cuts_fewer_links(spark):
    """Links are the pairs of equal texts; rounds never leave more of them cut, and quotas hold."""
    rng = random.Random(5)
    texts = [f"g{rng.randrange(90)}" for _ in range(1500)] + [f"u{i}" for i in range(700)] + ["hot"] * 900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = []
    for rounds in (0, 1, 8):
        got = sharding.shard(docs, n_shards=8, rounds=rounds).collect()
        load = Counter(r.shard for r in got)
        assert max(load.values()) - min(load[s] for s in range(8)) <= 1
        kept.append(sum(n * (n - 1) // 2 for n in Counter((r.hub, r.shard) for r in got).values()))
    assert kept[0] < kept[1] <= kept[2] and kept[2] >= 1.5 * kept[0]


def test_met_splits_hot_keys_and_keeps_all_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 10 * F.col("id") % 7).alias("k"), "id")
    side = common.cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k != 3"), "side")
    want = Counter((r.k, r.id) for r in rows.filter("k != 3").collect())
    for most in (100_000, 2):  # all keys broadcast; keys shuffled
        assert Counter((r.k, r.id) for r in common.met(rows, side, "k", "n", most).collect()) == want
        assert {r.k for r in common.unmet(rows, side, "k", "n", most).collect()} == {3}


def test_samples_take_distinct_texts(spark):
    docs = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = [r.text for r in common.sampled(docs, 100).collect()]
    assert len(got) == len(set(got)) == 100
    assert common.sampled(docs, 10_000).count() == 2501 and common.sampled(docs.limit(0), 5).count() == 0
    assert common.sampled(docs, 100, F.col("text") == "copy").count() <= 1


def test_licence_gate_and_spans(spark, sf):
    """Spans of the whole table against a scan that scores every line, whatever its words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    vocab = licences.vocabulary()
    weights = np.zeros((len(licences.FAMILIES), len(vocab)))
    for f, texts in licences.NOTICES.items():
        for g in set().union(*map(licences.grams, texts)):
            weights[licences.FAMILIES.index(f), vocab[g]] = 1 + g.count(" ")
    model = licences.Model(weights, np.zeros(len(licences.FAMILIES)), 0.3)
    wrapped = [t for f, t, _ in licences.wrapped(seed=9)][::40]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, f"some words\n{t}\nand more") for i, t in enumerate(wrapped)]
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans if s.kind != "unknown"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = 0
    for d, t in rows:
        at, want = 0, []
        for n, line in enumerate((t or "").split("\n")):
            words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in line.lower()).split()
            index = {vocab[g] for k in (1, 2, 3) for g in (" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if g in vocab}
            z = model.weights[:, sorted(index)].sum(axis=1)
            p, best = np.exp(z - z.max()) / np.exp(z - z.max()).sum(), licences.FAMILIES[int(z.argmax())]
            if line.strip() and best != "none" and p.max() >= 0.3 and licences.confirmed(best, line):
                if want and want[-1][3] == n - 1 and want[-1][0] == best:
                    want[-1] = (best, want[-1][1], at + len(line), n)
                else:
                    want.append((best, at, at + len(line), n))
            at += len(line) + 1
        assert got[d] == [w[:3] for w in want]
        found += len(want)
    assert found > 0
    assert licences.confirmed("gpl", "This program is free software: you can redistribute it") and not licences.confirmed("gpl", "licensed under the GNU Affero General Public License, version 3 of it")


def test_wrapped_notice_is_one_span(spark, sf):
    model, vocab = licences.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), licences.vocabulary()
    w = licences.NOTICES["mit"][2].split()
    text = "first\n" + "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10)) + "\nlast"
    spans = [s for s in licences.found(text, model, vocab) if s["kind"] == "mit"]
    assert sum(s["end"] - s["start"] for s in spans) > 0.8 * len(text) and len(spans) <= 3
    assert 0 < model.threshold < 1 and not [s for s in licences.found("His driving licence was found\nplain words", model, vocab) if s["kind"] != "unknown"]


def test_pipeline_runs_on_odd_documents(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and clashing names from end to end, and an empty table."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, text(rng.randint(60, 150)), rng.choice(["en", None]), rng.choice(["a", "b", None]), None, "u") for i in range(60)]
    rows += [rows[0], (None, rows[1][1], None, None, None, None), (None, None, None, None, None, None), (70, "", "en", "a", 0, "u"), (71, text(20_000), "en", "a", 5, "u")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid string"
    bench = spark.createDataFrame([(1, " ".join(rows[5][1].split()[3:14])), (None, None)], "item_id long, text string")
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    got = {r.doc_id for r in out.select("doc_id").collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "shard", "slot"] and got <= {r[0] for r in rows} and 5 not in got and 71 in got and 70 not in got and len(got) > 50
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
