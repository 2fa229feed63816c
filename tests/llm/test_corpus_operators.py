"""Operators that compare documents: fingerprints, near duplicates, sharding, mixing, repeated passages, and the pipeline."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.helpers import awkward, corpus, documents, empty
from weftgraph.llm import fingerprint, mixing, neardup, sharding, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- fingerprints
def brute_sketch(text):
    """Number of shingles, retained hashes in order, and the hash up to which none is left out."""
    w = WORD.findall(text or "")
    s = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
    every = sorted(hashlib.md5(x.encode()).hexdigest()[:16] for x in s)
    kept = [h for i, h in enumerate(every) if h < "2" or i < 64]
    return len(s), kept, "g" if kept == every else max(kept[-1], "2")


def brute_likeness(one, two):
    (n, s, x), (m, t, y) = brute_sketch(one), brute_sketch(two)
    if not n or not m:
        return float(n == m)
    s, t = ({h for h in hashes if h <= min(x, y)} for hashes in (s, t))
    return len(s & t) / min(len(s), len(t)) if s and t else 0.0


def test_fingerprints_match_brute_force(spark):
    pairs = [*corpus(90), (200, "hi"), (201, "hi"), (202, ""), (203, ""), (204, "a b c"), (205, None)]
    random.Random(4).shuffle(pairs)
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(documents(spark, pairs).repartition(3)).collect()}
    pairs = sorted((i, t or "") for i, t in pairs)
    for (i, text), (_, following) in zip(pairs, [*pairs[1:], pairs[0]], strict=True):
        r, k = got[i], len(text) // 4
        new = text[: len(text) - k] + following[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        n, s, _ = brute_sketch(text)
        assert r.fingerprint == f"{n}:" + "".join(s)
        assert r.near_edited == pytest.approx(brute_likeness(text, new)) and r.near_next == pytest.approx(brute_likeness(text, following))
        assert fingerprint.likeness(r.fingerprint, r.edited_fingerprint) == r.near_edited
    assert got[200].near_next == got[202].near_next == got[200].near_edited == 1.0 and got[203].near_next == 0.0


def test_short_texts_are_resolved():
    """Equal texts are alike whatever their length, and different short texts have different fingerprints."""
    rng, seen = random.Random(6), set()
    for _ in range(400):
        text = " ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(1, 11)))
        parts = fingerprint.shingles(text)
        s = fingerprint.sketch(parts)
        assert fingerprint.containment(s, len(parts), s, len(parts)) == 1.0
        seen.add(fingerprint.encode(s, len(parts)))
    assert len(seen) == 400


def test_rows_of_one_id_are_split_into_ranges(spark):
    pairs = [(7, f"text {i}") for i in range(400)] + [(i, f"other {i}") for i in range(100, 300)] + [(None, f"none {i}") for i in range(200)]
    df = documents(spark, pairs)
    out = fingerprint.with_next(df, range_rows=50).collect()
    rows = [r for r in out if not r.tail]
    assert len(rows) == 800 and max(Counter(r.bucket for r in rows).values()) < 130
    firsts = {b: min((r for r in rows if r.bucket == b), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash)) for b in {r.bucket for r in rows}}
    order = sorted(firsts)
    for r in out:
        if r.tail:
            after = firsts[order[(order.index(r.bucket) + 1) % len(order)]]
            assert (r.doc_id, r.hash, r.text) == (after.doc_id, after.hash, after.text)
    assert len(fingerprint.fingerprint_documents(df).collect()) == 800


def test_fingerprint_ranges_are_seamless(spark):
    df = documents(spark, [(i * 3, f"text number {i}") for i in range(500)])
    out = fingerprint.with_next(df, range_rows=37).collect()
    assert sum(not r.tail for r in out) == 500
    by = defaultdict(list)
    for r in out:
        by[r.bucket].append((r.tail, r.doc_id))
    assert len(by) > 5
    for rows in by.values():
        ids = [d for _, d in sorted(rows)]
        assert sum(t for t, _ in rows) == 1 and (ids[-1] == ids[-2] + 3 or ids[-1] == 0)


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(4000)]
    whole, part = fingerprint.shingles(" ".join(words)), fingerprint.shingles(" ".join(words[:800]))
    a, b = fingerprint.sketch(whole), fingerprint.sketch(part)
    assert fingerprint.containment(a, len(whole), b, len(part)) == 1.0
    rest = fingerprint.sketch(fingerprint.shingles(" ".join(words[796:])))
    assert fingerprint.merge(b, rest) == a


def test_fingerprints_awkward_rows(spark):
    df = awkward(spark)
    out = fingerprint.fingerprint_documents(df).collect()
    assert len(out) == df.count()
    text = {r.doc_id: r.text for r in df.collect()}
    by_text = defaultdict(set)
    for r in out:
        by_text[text[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0


# -- near duplicates
def brute_components(pairs, size, percent=80):
    sets = {}
    for i, t in pairs:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    pairs = [*corpus(), (900, "ONE"), (901, "one"), (902, ""), (903, None), (904, None)]
    out = neardup.near_duplicates(documents(spark, pairs), neardup.NearDupParameters(shingle_words=size)).collect()
    want = brute_components(pairs, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    pairs = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(300)] = f"e{i}"
        pairs.append((i, " ".join(w)))
    out = neardup.near_duplicates(documents(spark, pairs)).collect()
    assert {r.component_id for r in out} == {0}


@pytest.mark.parametrize("chunk", [512, 3])
def test_links_between_outliers_of_a_bucket_are_found(spark, chunk):
    """One bucket for all (their common word has the least hash), where only the two of each later couple are linked."""
    least = min((f"c{i}" for i in range(20_000)), key=lambda w: neardup.shingle_hashes(w, 1)[0])
    texts = [(0, f"{least} " + " ".join(f"o{j}" for j in range(18)))]
    for i in range(1, 9):
        own = f"{least} " + " ".join(f"p{i}x{j}" for j in range(18))
        texts += [(i, own), (100 + i, own + " more")]
    p = neardup.NearDupParameters(shingle_words=1, rows=1, bands=1, chunk_sets=chunk)
    assert len({k for _, t in texts for k in neardup.band_keys(neardup.shingle_hashes(t, 1), 1, 1)}) == 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts), p).collect()}
    assert got == brute_components(texts, 1) and all(got[100 + i][1] == i for i in range(1, 9))


def test_band_keys_agree_with_similarity():
    rng = np.random.default_rng(1)
    p = neardup.NearDupParameters()
    for n in (1, 3, 40, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert neardup.band_keys(a, p.rows, p.bands) == neardup.band_keys(a.copy(), p.rows, p.bands)
    hits = 0
    for _ in range(200):
        both, x, y = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (180, 20, 20))
        one, two = np.union1d(both, x), np.union1d(both, y)  # similarity 180 / 220
        hits += bool(set(neardup.band_keys(one, p.rows, p.bands)) & set(neardup.band_keys(two, p.rows, p.bands)))
    assert hits == 200


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[201] == 200


def test_near_duplicates_awkward_rows(spark):
    df = awkward(spark)
    out = neardup.near_duplicates(df).collect()
    assert len(out) == df.count()
    got = {r.doc_id: r.component_id for r in out}
    assert got[5] == got[6] == got[7] == 5 and got[4] == 3 and got[0] == 0
    assert neardup.near_duplicates(empty(spark)).count() == 0


# -- sharding
def test_shards_are_exact_and_gapless(spark):
    df = documents(spark, [(i, f"t{i % 50}") for i in range(1003)])
    out = sharding.shard(df, 40, block_rows=100).collect()
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) - min(sizes.values()) == 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len(f"t{r.doc_id % 50}") + 16 and r.text_crc32 == zlib.crc32(f"t{r.doc_id % 50}".encode()) and r.grown_shard is None and r.law == "rows" for r in out)
    again = sharding.shard(df.repartition(7), 40, block_rows=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_hypergeometric_law():
    rng = random.Random(3)
    n = Counter(sharding.hypergeometric(rng, 6, 10, 5) for _ in range(20_000))
    for k in range(6):
        assert n[k] / 20_000 == pytest.approx(comb(6, k) * comb(10, 5 - k) / comb(16, 5), abs=0.012)
    big = [sharding.hypergeometric(rng, 10**10, 39 * 10**10, 10**6) for _ in range(200)]
    assert np.mean(big) == pytest.approx(25_000, rel=0.005)


@pytest.mark.parametrize(("good", "bad", "draws"), [(60, 100, 50), (1000, 39_000, 3000), (5, 10**6, 10**5), (2 * 10**5, 3 * 10**5, 1000)])
def test_hypergeometric_mass_is_exact(good, bad, draws):
    """Quantiles against the law in exact integers: the draw at u is the first count whose exact mass exceeds u."""
    class Fixed:
        def random(self):
            return self.u

    fixed, total, mass, want = Fixed(), comb(good + bad, draws), 0, []
    weight, k = comb(good, max(0, draws - bad)) * comb(bad, draws - max(0, draws - bad)), max(0, draws - bad)
    while k <= min(draws, good):
        mass += weight
        want.append((k, mass * 10**18 // total))
        weight = weight * (good - k) * (draws - k) // ((k + 1) * (bad - draws + k + 1))
        k += 1
    for u in [10**6, 10**14, 10**16, 10**17, 3 * 10**17, 5 * 10**17, 9 * 10**17, 999 * 10**15, 10**18 - 10**6]:
        fixed.u = u / 10**18
        got = sharding.hypergeometric(fixed, good, bad, draws)
        near = {k for k, m in want if abs(m - u) < 10**7}  # within 1e-11 of a step either side is right
        assert got in near | {x + 1 for x in near} | {next(k for k, m in want if m > u)}


def test_matrix_has_its_sums():
    m = sharding.communication_matrix([10, 0, 7, 33], [12, 13, 12, 13], 5)
    assert [sum(r) for r in m] == [10, 0, 7, 33] and [sum(c) for c in zip(*m, strict=True)] == [12, 13, 12, 13]


def spark_hash(*values):
    """The engine's 64-bit hash of longs (and first, where asked, a 32-bit seed), nulls passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if not isinstance(v, tuple) else struct.pack("<i", v[0]), seed=h)
    return h - 2**64 if h >= 2**63 else h


def test_shards_match_a_plain_construction(spark):
    """Blocks, matrix, cuts and both permutations by hand, with equal rows among the others."""
    pairs = [(i, f"t{i % 9}") for i in range(300)] + [(7, "same")] * 40 + [(None, None)] * 5
    seed, n_shards = 17, 6
    seen, rows = Counter(), []
    for i, t in pairs:
        row = (i, len(t or "") + 16, zlib.crc32((t or "").encode()))
        rows.append((*row, seen[row]))
        seen[row] += 1
    tie = {r: spark_hash(r[0], r[2], r[1], r[3]) for r in rows}
    n_blocks = min(64, len(rows) // 100)
    blocks = [[] for _ in range(n_blocks)]
    for r in rows:
        blocks[spark_hash((seed,), tie[r]) % n_blocks].append(r)
    sizes = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    matrix = sharding.communication_matrix([len(b) for b in blocks], sizes, seed)
    shards = [[] for _ in range(n_shards)]
    for held, counts in zip(blocks, matrix, strict=True):
        held.sort(key=lambda r: spark_hash((seed + 1,), tie[r]))
        at = 0
        for s, n in enumerate(counts):
            shards[s] += held[at : at + n]
            at += n
    want = Counter()
    for s, held in enumerate(shards):
        held.sort(key=lambda r: spark_hash((seed + 2,), tie[r]))
        want.update((r[0], r[1], r[2], s, slot) for slot, r in enumerate(held))
    got = sharding.shard(documents(spark, pairs), n_shards, seed=seed).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_many_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 7)
    df = documents(spark, [(1, "x")] * 50 + [(2, "y")] * 7 + [(3, "z")])
    got = sharding.numbered(df.select("doc_id", "text")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, "x", i): 1 for i in range(50)} | {(2, "y", i): 1 for i in range(7)} | {(3, "z", 0): 1})
    assert Counter(r.shard for r in sharding.shard(df, 4).collect()) == {0: 15, 1: 15, 2: 14, 3: 14}


def test_shuffle_is_uniform(spark):
    """Every row is about as often in every shard, and at every slot."""
    df = documents(spark, [(i, "") for i in range(12)])
    where, slots = Counter(), Counter()
    for seed in range(60):
        for r in sharding.shard(df, 3, seed=seed, block_rows=5).collect():
            where[r.doc_id, r.shard] += 1
            slots[r.doc_id % 3, r.slot] += 1
    assert all(5 <= where[i, s] <= 38 for i in range(12) for s in range(3))
    assert all(30 <= slots[k, s] <= 95 for k in range(3) for s in range(4))


def test_sharding_awkward_rows(spark):
    df = awkward(spark)
    out = sharding.shard(df, 5).collect()
    assert len(out) == df.count() and Counter(r.shard for r in out) == {0: 3, 1: 3, 2: 3, 3: 3, 4: 2}
    assert sharding.shard(empty(spark), 5).count() == 0


def test_sharding_runs_no_python(spark):
    plan = sharding.shard(documents(spark, [(1, "x")]), 4)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- mixing
def labelled(spark, n=300):
    rng = random.Random(8)
    vocabulary = {"high": ["fine", "clear", "sound"], "low": ["meh", "dull", "grey"], "toxic": ["vile", "nasty", "foul"]}
    docs, labels = [], []
    for i in range(n):
        d = rng.choices(["high", "low", "toxic"], [6, 3, 1])[0]
        w = [rng.choice(vocabulary[d]) for _ in range(8)] + [f"w{rng.randrange(40)}" for _ in range(30)]
        rng.shuffle(w)
        docs.append((i, " ".join(w) + "."))
        if i % 2:
            labels.append((i, int(d == "high"), int(d == "toxic")))
    labels += [(None, 1, 0), (5000, 1, 0), (1, None, None)]
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_meets_its_targets(spark):
    docs, labels = labelled(spark)
    p = mixing.MixingParameters(weights={"high": 0.5, "low": 0.4, "toxic": 0.1})
    model = mixing.fit_domains(docs, labels, p)
    soft = mixing.posteriors(docs, model)
    rated, reached, target = mixing.fit_rates(soft, model.domains, p)
    rows = rated.collect()
    totals = np.sum([r.rate * r.tokens * np.array(r.posterior) for r in rows], axis=0)
    assert totals == pytest.approx(target, rel=1e-4) and reached == pytest.approx(target, rel=1e-4)
    assert all(r.rate >= 0 for r in rows) and dict(zip(model.domains, target / target.sum(), strict=True)) == pytest.approx(p.weights)


def test_mixed_rows_meet_the_targets(spark):
    """Token totals of the rows that the stage returns: rates near 1.4 aren't all rounded to 1."""
    docs, labels = labelled(spark, 900)
    p = mixing.MixingParameters(weights={"high": 0.74, "low": 0.26, "toxic": 0.0})
    rows = mixing.mix(docs, labels, p).collect()
    model = mixing.fit_domains(docs, labels, p)
    posterior = {r.doc_id: (r.tokens, np.array(r.posterior)) for r in rows}
    have = np.sum([t * v for t, v in posterior.values()], axis=0)
    target = mixing.targets_for(have, np.array([p.weights[d] for d in model.domains]))
    got = np.sum([posterior[r.doc_id][0] * posterior[r.doc_id][1] for r in mixing.apply(docs, labels, p).collect()], axis=0)
    assert any(1.1 < r.rate < 1.5 for r in rows) and all(abs(r.copies - r.rate) < 1 for r in rows)
    assert np.abs(got - target).max() <= 0.04 * target.sum()


def test_mixing_steps_match_plain_projected_gradient(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS_A_TABLE", 1)
    docs, labels = labelled(spark, 120)
    p = mixing.MixingParameters(optimality=2e-4)
    model = mixing.fit_domains(docs, labels, p)
    rows = mixing.posteriors(docs, model).collect()
    a, t = np.array([r.posterior for r in rows]), np.array([float(r.tokens) for r in rows])
    have, scale = a.T @ t, t.sum()
    target = mixing.targets_for(have, np.array([p.weights[d] for d in model.domains]))
    inverse = np.linalg.pinv((a * t[:, None]).T @ a / scale + 1e-9 * np.eye(len(have))) / scale
    rate, reached, moved, rounds = np.ones(len(rows)), have, np.inf, 0
    while np.abs(reached - target).max() > p.tolerance * scale and moved > p.optimality * scale:
        new = np.maximum(0, rate - a @ (inverse @ (reached - target)))
        moved, rate, rounds = t @ np.abs(new - rate), new, rounds + 1
        reached = a.T @ (rate * t)
    assert 2 <= rounds < 200
    got = {r.doc_id: r.rate for r in mixing.fit_rates(mixing.posteriors(docs, model), model.domains, p)[0].collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(rate, abs=1e-6)


def test_posteriors_match_brute_force(spark):
    """The model's posteriors against sums over sets of terms, written out."""
    docs, labels = labelled(spark, 80)
    model = mixing.fit_domains(docs, labels, mixing.MixingParameters())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.posteriors(docs, model).collect():
        terms = set()
        for raw in text[r.doc_id].lower().split():
            w = raw.strip(".,;:!?\"'()")
            terms |= {w} | ({w[:4] + "*"} if len(w) > 4 else set()) | ({w[:6] + "*"} if len(w) > 6 else set())
        z = sum((model.weights[i] for x in terms if (i := model.vocabulary.get(zlib.crc32(x.encode()))) is not None), np.zeros(len(model.domains)))
        z = z + np.array(mixing.shape(text[r.doc_id], Counter(text[r.doc_id].lower().split()))) @ model.weights[len(model.vocabulary) :]
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.posterior == pytest.approx(want.tolist(), abs=1e-9)


def test_mixing_drops_toxic_and_keeps_clean(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    toxic = {r.doc_id for r in docs.collect() if re.search("vile|nasty|foul", r.text)}
    assert {i for i, r in out.items() if r.copies == 0} == toxic
    kept = mixing.apply(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(out) - toxic


def test_mixing_awkward_rows(spark):
    df, (_, labels) = awkward(spark), labelled(spark)
    out = mixing.mix(df, labels).collect()
    assert len(out) == df.count() and all(r.rate == 1.0 for r in out if r.tokens == 0)
    none = mixing.mix(df, labels.limit(0)).collect()
    assert {r.copies for r in none} == {1}
    assert mixing.mix(empty(spark), labels).count() == 0
    assert mixing.apply(df, labels).columns == df.columns


# -- repeated passages
def brute_removal(pairs, window=35):
    starts = defaultdict(list)
    words = {n: WORD.findall(t or "") for n, (_, t) in enumerate(pairs)}
    for n, w in words.items():
        for i in range(len(w) - window + 1):
            starts[tuple(w[i : i + window])].append((n, i))
    gone = {(n, i + k) for at in starts.values() if len(at) > 1 for n, i in at for k in range(window)}
    out = []
    for n, w in words.items():
        kept = [x for i, x in enumerate(w) if (n, i) not in gone]
        out.append((pairs[n][0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 500])
def test_substring_removal_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    pairs = [*corpus(), (900, "be " * 60), (901, None), (902, "z" * 10), (903, "  ".join(f"n{i}" for i in range(50)))]
    got = [tuple(r) for r in substring.remove_repeats(documents(spark, pairs).repartition(4)).collect()]
    assert sorted(got) == sorted(brute_removal(pairs))


def test_substring_result_does_not_depend_on_the_sketch(spark):
    pairs = corpus(60)
    tight = substring.remove_repeats(documents(spark, pairs), substring.SubstringParameters(cells=64)).collect()
    assert sorted(map(tuple, tight)) == sorted(brute_removal(pairs))


def test_substring_equal_rows_and_copies(spark):
    """Many equal rows, copies under other ids, and a passage of theirs inside another text."""
    rng = random.Random(2)
    base = [f"q{rng.randrange(10**6)}" for _ in range(80)]
    pairs = [(1, " ".join(base))] * 30 + [(i, " ".join(base)) for i in range(2, 12)] + [(50, " ".join(["x"] * 3 + base[5:60] + ["y"])), (51, " ".join(base[:20])), (None, " ".join(base[:20])), (52, "  ".join(base))]
    got = [tuple(r) for r in substring.remove_repeats(documents(spark, pairs).repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted(brute_removal(pairs), key=repr)


def test_substring_runs_without_a_broadcast(spark):
    plan = substring.remove_repeats(documents(spark, corpus(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_substring_awkward_rows(spark):
    df = awkward(spark)
    got = sorted((tuple(r) for r in substring.remove_repeats(df).collect()), key=repr)
    assert got == sorted(brute_removal([(r.doc_id, r.text) for r in df.collect()]), key=repr)
    assert substring.remove_repeats(empty(spark)).count() == 0


# -- pipeline
def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark)
    secret = documents(spark, [(1000, "fine clear sound text here w1 w2 w3 w4 w5 password=Hunter2222 and more w6 w7 w8 w9 end."), (1001, None), (1002, "12345 !!!")])
    copy = documents(spark, [(1003, docs.where("doc_id = 0").first().text)])
    docs.unionByName(secret).unionByName(copy).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, at = {}, read
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == read.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        at = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = {r.doc_id for r in at.collect()}
    everything = {r.doc_id for r in read.collect()}
    assert kept["language_id"] == everything - {1001, 1002}
    want = brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/out/language_id").collect()], 5)
    assert kept["near_dedup"] == {i for i, (_, c) in want.items() if i == c} and 1003 not in kept["near_dedup"]
    masked = spark.read.parquet(f"{tmp_path}/out/secret_scans").where("doc_id = 1000").first().text
    assert "Hunter2222" not in masked and "[SECRET]" in masked
    assert kept["secret_scans"] == kept["near_dedup"] and kept["packing"] == kept["mixing"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == kept["packing"]


CLASHES = "gone_id long, _gone long, _key long, mixed_id long, _mixed long, _copies long, mixed_times long, _time long, component_id long, kept boolean, text_key string, row_key long, _slot0 string"


def test_pipeline_with_clashing_columns_nulls_and_repeats(spark, tmp_path):
    """Columns named like the stages' own, rows without an id, repeated rows, a null in every column, a long text."""
    docs, labels = labelled(spark, 150)
    base = [(r.doc_id, r.text) for r in docs.collect()]
    first, second = base[0][1], base[1][1]
    extra = [(None, first), (None, "unlike all others fine clear sound " + second[::-1]), (None, None), base[2], (700, None), (701, " ".join(first.split() * 900))]
    extra.append((None, extra[1][1]))
    names = [x.split()[0] for x in CLASHES.split(", ")]
    rows = [(i, t, "en", "s", len(t) if t else None, *[7] * 9, True, "x", 7, "y")[: 5 + len(names)] for i, t in base + extra]
    rows = [(*r[:5], *(None if r[0] is None else {"boolean": True, "string": "x"}.get(x.split()[1], 7) for x in CLASHES.split(", "))) for r in rows]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns
        at.write.parquet(f"{tmp_path}/out/{name}")
        at = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name == "near_dedup":  # the copy without an id goes; of its own kind the other two are one document
            left = [r for r in at.collect() if r.doc_id is None]
            assert [r.text for r in left] == [extra[1][1]] * 2 and all(r._key is None for r in left)
            assert sum(r.doc_id == base[2][0] for r in at.collect()) == 2
    assert all(r._copies == 7 and r.kept for r in at.where("doc_id is not null").collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, 30)[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
