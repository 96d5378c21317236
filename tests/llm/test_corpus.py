"""Operators 1, 3, 4, 7, 8 and the pipeline against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tephra.llm import decontaminate, mixing, quality, queries, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, uid long, row string, shard string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    base = [text(rng.randint(60, 200)) for _ in range(40)]
    texts = base + base[:10] + [" ".join(["zz", *b.split()[1:]]) for b in base[:10]] + [None, "", " \n\t", "one", "one two", "a a a a a a", text(30_000), "x\ny\nx\ny\n\n"]
    rows = [(i, t, "en" if i % 3 else None, rng.choice(["s1", "s2", None]), len(t or ""), "k", i, "r", "h") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def counts(t):
    ws, t = words(t), t or ""
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    lines = [x for x in t.split("\n") if words(x)]
    covered = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(odd):
    got = quality.quality_rules(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            want = counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) > 30


def test_quality_sketch(spark):
    v = spark.range(0, 200_000, 37).select(F.col("id").alias("v"))
    for r in v.select("v", quality.bucket(F.col("v")).alias("b")).withColumn("top", quality.bucket_top(F.col("b"))).collect():
        assert r.v <= r.top <= r.v + max(0, r.v // 32)


def find(parent, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def brute_print(t):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(odd):
    rows = [(r.doc_id, brute_print(r.text)) for r in odd.collect()]
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(parent, a)] = find(parent, b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(parent, p)] = min(d, least.get(find(parent, p), d))
    want = Counter((d, p, least.get(find(parent, p))) for d, p in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd).collect()) == want
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({find(parent, p) for _, p in rows})


def test_near_dedup_finds_edited_copies(spark, sf):
    """Copies with 1 to 3 words changed in 200 go, texts that share half of their shingles stay."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(120):
        base = text(200)
        rows.append((1000 * i, " ".join(base)))
        for edits in (1, 2, 3):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = "changed"
            rows.append((1000 * i + edits, " ".join(copy)))
        rows.append((1000 * i + 500, " ".join(base[:134] + text(66))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert all(1000 * i in kept and 1000 * i + 500 in kept for i in range(120))
    by_edits = {e: sum(1000 * i + e not in kept for i in range(120)) / 120 for e in (1, 2, 3)}
    print("recall of the stage", by_edits, "by fingerprint alone", 1 - (simhash.one_of_each(docs).filter("doc_id % 1000 in (1, 2, 3)").count() / 360))
    assert by_edits[1] >= 0.99 and by_edits[2] >= 0.99 and by_edits[3] >= 0.9  # of similarity 0.95, 0.90 and 0.86


def test_many_texts_of_a_band_meet_in_few_rounds(spark, monkeypatch):
    """Fifty texts that agree in one band and in nothing else took a round each; a pair of them is similar."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 30, (50, simhash.BANDS * simhash.IN_BAND))
    values[:, : simhash.IN_BAND] = 7
    values[31] = np.r_[values[17, :90], values[31, 90:]]
    rounds = []
    monkeypatch.setattr(simhash, "cut", lambda df, name, was=simhash.cut: rounds.append(name) or was(df, name))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "fp long, values array<int>")
    assert [tuple(r) for r in simhash.similar_links(rows, 0.8).collect()] == [(31, 17)]
    assert rounds.count("pairs") <= 4


def test_near_misses_of_a_band_are_not_compared_and_no_link_is_missed(spark, monkeypatch):
    """Copies that differ from one text in 5 to 45 of 100 values meet in bands, most of them too far from each other."""
    rng = np.random.default_rng(8)
    n, base = 150, rng.integers(0, 1 << 30, simhash.BANDS * simhash.IN_BAND)
    values = np.tile(base, (n, 1))
    for i, v in enumerate(values):
        at = rng.permutation(len(v))[: (8, 13, 25, 45)[i % 4]]
        v[at] = rng.integers(0, 1 << 30, len(at))
    compared = []
    monkeypatch.setattr(simhash, "cut", lambda df, name, was=simhash.cut: (out := was(df, name), name == "members" and compared.append(out.count()))[0])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "fp long, values array<int>")
    got, want = ({i: i for i in range(n)} for _ in range(2))
    for a, b in simhash.similar_links(rows, 0.8).collect():
        got[find(got, a)] = find(got, b)
    for a, b in itertools.combinations(range(n), 2):
        same = values[a] == values[b]
        if same.sum() >= 80 and same.reshape(simhash.BANDS, -1).all(axis=1).any():
            want[find(want, a)] = find(want, b)
    classes = lambda parent: {frozenset(j for j in range(n) if find(parent, j) == find(parent, i)) for i in range(n)}
    assert classes(got) == classes(want) and len(classes(want)) > n // 3
    assert sum(compared) < 4 * n


def test_classes_of_random_links(spark):
    rng = random.Random(3)
    links = {(rng.randrange(1, 400), rng.randrange(400)) for _ in range(330)} | {(i + 1000, i + 999) for i in range(1, 120)}
    links = {(max(x), min(x)) for x in links if x[0] != x[1]}
    parent = {n: n for x in links for n in x}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = simhash.classes(spark.createDataFrame(sorted(links), "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: find(parent, n) for n in parent} and len(got) == len(parent)


def test_ball_finds_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = set(seeds) | {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    parent = {p: p for p in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 2:
            parent[find(parent, a)] = find(parent, b)
    mine = {p: p for p in signed}
    for r in simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 2
        mine[find(mine, r.a)] = find(mine, r.b)
    group = lambda p: Counter(frozenset(x for x in signed if find(p, x) == find(p, y)) for y in signed)
    assert group(mine) == group(parent)


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(25))), (2, "Short item"), (3, None), (4, "..."), (None, "null id here now"), (2, "Short item")], "item_id long, text string")
    head = " ".join(f"W{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"x, {head} y"), (2, "w0 w1 w2"), (3, "a SHORT, item! short item"), (4, None), (5, ""), (5, ""), (6, "null id here now"), (7, " ".join(f"w{i}" for i in range(25)) + " z")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (12, 10, 1, ["1"], True), 2: (3, 0, 0, [], False), 3: (5, 4, 1, ["2"], True), 4: (0, 0, 0, [], False), 5: (0, 0, 0, [], False), 6: (4, 4, 0, [], True), 7: (26, 25, 1, ["1"], True)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 4, 5, 5]
    cleaned = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert words(cleaned[1]) == ["x,", "y"] and words(cleaned[3]) == ["a", ",", "!"] and cleaned[4] is None and words(cleaned[7]) == ["z"]
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == 8 and not any(r.contaminated for r in none)


def fill(sizes):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, full = sum(sizes.values()), set()
    while True:
        rest = left - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in sizes if s not in full)
        share = {s: rest * weight[s] / total for s in sizes if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_mixing(spark, odd, sf, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, n_shards=5).collect()
    assert len(got) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == sum(r.n) <= 3 * r["size"]
        for k in set(r.epoch):  # no word twice in a pass
            spans = sorted((a, a + n) for e, a, n in zip(r.epoch, r["first"], r.n) if e == k)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= r["size"]
    want = fill(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    again = mixing.mix(docs.repartition(7), n_shards=5).select("doc_id", "taken", "shard").collect()
    assert Counter((r.doc_id, r.taken, tuple(r.shard)) for r in again) == Counter((r.doc_id, r.taken, tuple(r.shard)) for r in got)
    draws = Counter()
    for x in {(r.source, d, s) for r in got for d, s in zip(r.draw, r.shard)}:
        draws[x[2]] += 1
    assert max(draws.values()) - min(draws.values()) <= 1
    rows = mixing.mixed_documents(docs).collect()
    back = Counter()
    for r in rows:
        back[r.doc_id] += len(words(r.text))
        assert r.n_chars is None or r.n_chars == len(r.text)
    by_doc = Counter()
    for r in mixing.mix(docs).collect():
        by_doc[r.doc_id] += r.taken
    assert back == +by_doc
    assert mixing.shards(mixing.mix(docs)).count() == sum(len(r.n) for r in mixing.mix(docs).collect())


def test_split_tree_and_permutation():
    quotas = np.array([1000, 1, 0, 250_000, 17])
    tree = mixing.split_tree(quotas, np.array([50_204, 50_204, 50_204, 50_203, 50_203]), np.random.default_rng(1))
    assert (tree.sum(axis=0) == quotas).all() and tree.sum(axis=1).tolist() == [50_204, 50_204, 50_204, 50_203, 50_203]
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


@pytest.mark.parametrize("hot", [False, True])
def test_sharding(spark, odd, hot):
    docs = odd if not hot else spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id") % 60)).otherwise(F.col("id").cast("string")).alias("text"))
    p = 16
    got = sharding.shard(docs, n_shards=p).collect()
    texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == texts
    load = Counter(r.shard for r in got)
    assert max(load[s] for s in range(p)) - min(load[s] for s in range(p)) <= 1
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(load[s]))
    groups = defaultdict(Counter)
    for r in got:
        groups[r.hub][r.shard] += 1
    if hot:  # groups that fit into a shard are whole, but for the few that meet a full shard
        fits = [c for c in groups.values() if 1 < sum(c.values()) < 100]
        assert sum(len(c) == 1 for c in fits) >= 0.8 * len(fits)
    out = sharding.sharded_documents(docs)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"] and out.count() == docs.count()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [words(re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + 10]) for b in bench for i in range(len(b) - 9)}
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        at[name] = docs
        assert docs.columns == columns + (["shard", "slot"] if name == "sharding" else [])
    assert all(not (counts(r.text)[0] < 50 or 100 * counts(r.text)[4] > 50 * counts(r.text)[0]) for r in at["quality_rules"].collect())
    prints = [brute_print(r.text) for r in at["near_dedup"].collect()]
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(prints, 2))
    for r in at["decontamination"].collect():
        ws = words(re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", r.text.lower()))
        assert not windows & {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)}
    assert at["mixing"].count() == at["sharding"].count() == corpus_pipeline.run(spark, sf).count()


def test_rows_of_files_and_other_rows_have_the_same_results(spark, odd, tmp_path):
    from tephra.llm.common import keyed

    odd.write.parquet(str(tmp_path / "odd"))
    read = spark.read.parquet(str(tmp_path / "odd"))
    assert "Scan parquet" in keyed(read, "x")._jdf.queryExecution().toString() and keyed(read, "x").select("uid").distinct().count() == odd.count()
    twice = read.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    assert keyed(twice, "x").select("uid").distinct().count() == 2 * odd.count() and keyed(read.filter("doc_id < 5").select("doc_id", "text"), "x").select("uid").distinct().count() == read.filter("doc_id < 5").count()
    for f in (simhash.one_of_each, sharding.sharded_documents, mixing.mixed_documents):
        a, b = (Counter((r.doc_id, r.text) for r in f(d).collect()) for d in (odd, read))
        assert a == b


def test_empty_tables(spark, odd, tmp_path):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_rules(none).count() == simhash.near_duplicates(none).count() == mixing.mix(none).count() == 0
    assert sharding.shard(none).count() == decontaminate.contamination(none, bench).count() == 0
    for f in (quality.keep_good, simhash.one_of_each, mixing.mixed_documents, sharding.sharded_documents):
        assert f(none).count() == 0


def test_digests(spark, sf):
    for r in queries.op8_decontamination(spark, sf).collect():
        assert len(r.items_sha256) == 64 and (r.n_items > 0 or r.items_sha256 == hashlib.sha256(b"").hexdigest())
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in queries.op7_simhash(spark, sf).collect())
