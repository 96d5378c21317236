"""Conversation repair, the n-gram Jaccard join, spelling variants and sharding against brute force."""

import gc
import hashlib
import heapq
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import common, conversations, ngram_join, sharding, spelling

CLASH = ("n", "key", "id", "row", "uid", "word", "seen", "symbol", "branch", "component_id")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


# Conversations


def brute_repair(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault) by a search over all edits, the cheapest and then the least audit first."""
    grammar = re.compile(r"(s?(ua)+)?\Z")
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and grammar.match(initials):
            return cost, audit, out
        if not re.match(r"(s?(ua)*u?)?\Z", initials):
            continue
        for role in ("user", "assistant"):
            if initials.count(role[0]) <= len(rows) + 1:
                heapq.heappush(heap, (cost + 2, audit + "I", i, initials + role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, initials + (role[:1] or "?"), (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 2, audit + "R", i + 1, initials + other[0], (*out, (other, text))))


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def test_repair_matches_a_search_over_all_edits(spark):
    rng, rows = random.Random(1), []
    for c in range(150):
        conv = None if c == 0 else c
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "uncle"])
            rows.append((conv, rng.choice([t, None, t // 2]), role, rng.choice(["Hi.", "Well?", "cut", " \n", "", None, "So !  ", "x" * 3000 + "."])))
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = conversations.repair(turns)
    got, digests = {r.conv_id: r for r in found.collect()}, {r.conv_id: r.repaired_sha256 for r in conversations.digests(turns, found).collect()}
    assert len(got) == 150
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or 0)), key=lambda r: r[0]):
        group = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for _, t, r, x in group))
        pairs, r = [(role, text) for _, _, role, text in group], got[conv]
        faults = faults_of(pairs)
        cost, audit, out = brute_repair([(*p, f) for p, f in zip(pairs, faults, strict=True)])
        known = [t for some, t, _, _ in group if some]
        assert (r.cost, r.audit, r.gaps) == (cost, audit, max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        text = "\n".join(f"{role}:{text}" for role, text in out)
        assert digests.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    edited = conversations.repaired_turns(turns, found).groupBy("conv_id").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.last + 1 == r.n for r in edited)
    assert conversations.repair(turns.limit(0)).count() == 0


def test_nodes_are_shared_by_common_endings():
    """Equal to signatures taken alone, and one step for each symbol and vector of relative costs."""
    rng = random.Random(2)
    signs = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 9))) for _ in range(4000)}, key=lambda s: s[::-1])
    together = list(conversations.nodes(s[::-1] for s in signs))
    assert together == [next(conversations.nodes(iter([s[::-1]]))) for s in signs]
    assert conversations.step.cache_info().currsize < 400
    long = "e" * 50_000
    assert next(conversations.nodes(iter([long])))[1] == 25_000 * 2 + (0 if len(long) % 2 == 0 else 2)


def test_damage_by_crc(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text or " ") if h == 2 else text or " "
        want[c, t, "user" if h == 4 else role or " ", text] += (h != 0) + (h == 3)
    assert got == +want


# N-gram Jaccard join


def brute_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def brute_components(ids, sets):
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) if sets[i] else ids[i] for i in range(len(ids))]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**6)}"
    return words


def test_join_finds_every_link(spark):
    """Chains of edits around the threshold, short texts, copies, shared passages and odd rows."""
    rng, texts = random.Random(3), [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b c d e f g h i", "a b c d e f g h i j"]
    passage = [f"p{i}" for i in range(60)]
    for n in (8, 9, 10, 12, 20, 45, 90, 200, 400):
        for _ in range(5):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)] if n != 90 else passage + [f"w{rng.randrange(5000)}" for _ in range(30)]
            texts.append(" ".join(base))
            for _ in range(5):
                base = edited(rng, base, rng.randint(0, max(1, n // 40)))
                cut = rng.randint(0, n // 12)
                texts.append(" ".join(base[cut:]) if rng.random() < 0.5 else "\t".join(base).upper())
    star = [f"s{i}" for i in range(120)]
    texts += [" ".join(edited(rng, star, 2)) for _ in range(120)] + [" ".join(star)] * 30
    texts.append(" ".join(f"v{rng.randrange(40_000)}" for _ in range(25_000)))
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[21]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = brute_sets([t for _, t in rows])
    want = brute_components([d for d, _ in rows], sets)
    got = ngram_join.linked(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == Counter((d, len(s), c) for (d, _), s, c in zip(rows, sets, want, strict=True))
    assert len({c for c in want}) < len(rows) - 200
    assert ngram_join.linked(docs.limit(0)).count() == 0


def test_units_find_every_partner():
    """Some unit of either set finds its partner whenever they are similar, also if the cheap units are others."""
    rng = np.random.default_rng(4)
    for n in [4, 5, 6, 8, 9, 10, 13, 22, 40, 97, 300]:
        for _ in range(30):
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = len(a) // 9
            drop = rng.integers(0, most + 1)
            b = np.unique(np.r_[a[rng.permutation(len(a))[drop:]], rng.integers(1, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64)])
            if len(a) > len(b):
                a, b = b, a
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            band = ngram_join.band_of(len(b))
            higher = band != ngram_join.band_of(len(a))
            keys = lambda s, own: ngram_join.keys_of(s, m := ngram_join.mix(s), ngram_join.totals(m), band, own)
            (ka, wa), (kb, wb) = keys(a, not higher), keys(b, True)
            indexed = set(kb[(wb & 7 == ngram_join.EXACT) | (wb & 7 == ngram_join.DELETED)].tolist())
            asked = (wa & 3) != ngram_join.DELETED
            for cost in (np.ones(len(ka), dtype=np.int64), rng.integers(0, 50, len(ka)), np.isin(ka, list(indexed)) * 100):
                probes = ngram_join.cheapest(len(a), higher, wa[asked], ka[asked], cost[asked])
                assert indexed & set(probes.tolist())


# Spelling variants


def brute_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("most", [50_000, 40])
def test_variants_match_all_pairs(spark, most):
    rng = random.Random(5)
    letters = "aeinorst" + "éßÿ"
    vocab = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(150)]
    vocab += [v[: (i := rng.randrange(len(v)))] + rng.choice(letters) + v[i + rng.randint(0, 1) :] for v in vocab for _ in range(3)]
    texts = [" ".join(rng.choices(vocab, k=300)).title() if i % 3 else "-".join(rng.choices(vocab[:50], k=900)) for i in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, None), (4, ""), (5, "漢字 abcde漢abcde abcdé"), (6, "y" * 100_000), (6, "y" * 100_000), (7, "y" * 100_000 + " " + "y" * 99_999)]
    got = spelling.variants(clashing(spark.createDataFrame(rows, "doc_id long, text string")), most=most).collect()
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if brute_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    assert len(got) == len(words) and sum(map(len, near.values())) > 300 and len(form) > 20
    for r in got:
        assert tuple(r) == (r.word, form.get(r.word), root(r.word), words[r.word], len(near[r.word]), words[form[r.word]] if r.word in form else None)
    if most == 40:
        assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Sharding


def test_propagation_goes_on_until_hubs_are_together(spark):
    """Pairs kept never fall from round to round, and a hub larger than a shard gets most of the pairs that it can have."""
    rng = random.Random(6)
    texts = [f"g{rng.randrange(90)}" for _ in range(1500)] + [f"u{i}" for i in range(700)] + ["hot"] * 900
    hubs = spark.createDataFrame([(h, n) for h, n in Counter(texts).items() if n > 1], "hub string, n long")
    capacity = [388, 388, 388, 388, 387, 387, 387, 387]
    kept = []
    for rounds in (0, 1, 2, 4, 8):
        state = [(r.hub, r.shard, r.n) for r in sharding.propagate(hubs, 2400, capacity, rounds).collect()]
        load, total = Counter(), Counter()
        for h, s, n in state:
            load[s] += n
            total[h] += n
        assert all(load[s] <= c for s, c in enumerate(capacity)) and total == Counter({r.hub: r.n for r in hubs.collect()}) and all(n > 0 for _, _, n in state)
        kept.append((sum(n * (n - 1) // 2 for _, _, n in state), sum(n * (n - 1) // 2 for h, _, n in state if h == "hot")))
    assert kept == sorted(kept) and kept[-1][1] >= 0.8 * (388 * 387 + 124 * 123 // 2)


def test_small_hubs_match_the_best_layout(spark):
    """Of all layouts of few hubs on few shards, propagation keeps at least four fifths of the pairs of the best."""
    rng = random.Random(7)
    for _ in range(3):
        sizes = [rng.randint(2, 5) for _ in range(4)]
        capacity = [-(-(sum(sizes) + 4) // 2)] * 2
        best = max(sum(a * (a - 1) // 2 + (n - a) * (n - a - 1) // 2 for a, n in zip(x, sizes, strict=True)) for x in itertools.product(*[range(n + 1) for n in sizes]) if sum(x) <= capacity[0] and sum(sizes) - sum(x) <= capacity[1])
        hubs = spark.createDataFrame([(f"h{i}", n) for i, n in enumerate(sizes)], "hub string, n long")
        got = sum(r.n * (r.n - 1) // 2 for r in sharding.propagate(hubs, sum(sizes), capacity, 8).collect())
        assert got >= 0.8 * best


def test_evicted_rows_find_room():
    lanes = sharding.lanes_of({0: 5, 2: 3}, {0: 2, 2: 0, 3: 4})
    assert lanes == [(0, 7, 0), (7, 11, 3), (11, 14, 2)]
    assert sharding.drawn({0: 5, 2: 3}, {0: 4, 3: 3, 2: 1}, {0: 2, 2: 0, 3: 4}) == {0: 5, 2: 3}
    assert sharding.drawn({0: 5, 2: 3}, {3: 4}, {0: 2, 2: 0, 3: 4}) == {0: 1, 2: 3}


def test_near_misses_of_a_cell_are_no_pairs(spark, monkeypatch):
    """Copies of one text that are too far from each other meet in cells, but the join of the cells makes no rows of them."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    rows.append((120, rows[7][1] + " end"))
    seen, similar = [], ngram_join.similar
    monkeypatch.setattr(ngram_join, "similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = brute_sets([t for _, t in rows])
    assert got == dict(zip(range(121), brute_components(list(range(121)), sets), strict=True))
    assert sum(seen) < 3 * len(rows)


def test_bits_are_sent_once_for_many_cells(spark, monkeypatch):
    """Texts that share many cells, but are not similar, are few rows of the join that carries their parity bits."""
    rng, rows = random.Random(8), []
    for i in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(578)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, 17)))]
    rows.append((40, rows[6][1] + " end"))
    seen, meeting = [], ngram_join.meeting
    monkeypatch.setattr(ngram_join, "meeting", lambda placed: seen.append(placed.count()) or meeting(placed))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(41), brute_components(list(range(41)), brute_sets([t for _, t in rows])), strict=True))
    assert got[40] == 6 and seen and sum(seen) < 6 * len(rows)


def test_shuffle_files_go_with_the_write(spark):
    """A table of the join leaves no shuffle files and no setting behind."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    gc.collect()
    before, setting = files(), spark.conf.get(common.TIDY, None)
    out = ngram_join.cut(spark.range(200_000).repartition(F.xxhash64("id")), "ids")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 200_000 and spark.conf.get(common.TIDY, None) == setting
