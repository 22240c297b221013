import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import ann, common, mixing, neardup_vectors, packing, quality, suffix_dedup
from quillon.llm import jaccard_join as J

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\né !", max_size=40)), min_size=1, max_size=12)


def words_ref(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    seen = []
    for i, j, data, offsets in common.text_chunks(pa.array(texts, pa.string()), 30):
        starts, ends, first = common.words_of(data, offsets)
        for d in range(j - i):
            seen.append([bytes(data[s:e]).decode() for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])])
    assert seen == [words_ref(t) for t in texts]


def shingles_ref(text, k=4):
    w = words_ref(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_copies(rng, groups=40):
    texts = []
    for _ in range(groups):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 10, 20, 40, 70, 150, 300]))
        base = [f"W{rng.integers(0, 5000)}" for _ in range(n)]
        for _ in range(int(rng.integers(1, 10))):
            t = list(base)
            for _ in range(rng.poisson(n * 0.02)):
                t[rng.integers(0, len(t))] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(t))
    return texts + ["", None, " \n", "a b", "A  b", "a b c", "a b c d"]


@pytest.fixture(scope="module")
def sets():
    texts = near_copies(np.random.default_rng(1))
    parts = [J.shingle_sets(common._LOWER[d], o) for _, _, d, o in common.text_chunks(pa.array(texts), 2000)]
    bounds = [0]
    for _, b in parts:
        bounds += (b[1:] + bounds[-1]).tolist()
    ref = [shingles_ref(t) for t in texts]
    truth = {
        (i, j)
        for i in range(len(ref))
        for j in range(i + 1, len(ref))
        if ref[i] and ref[j] and 100 * len(ref[i] & ref[j]) >= 85 * len(ref[i] | ref[j])
    }
    return np.concatenate([s for s, _ in parts]), np.array(bounds), ref, truth


def test_shingle_counts(sets):
    _, bounds, ref, _ = sets
    assert np.diff(bounds).tolist() == [len(r) for r in ref]


def test_linked_sets_share_a_key(sets):
    shingles, bounds, _, truth = sets
    keys, owners = J.signatures(shingles, bounds, 85)
    by = {}
    for k, o in zip(keys.tolist(), owners.tolist()):
        by.setdefault(k, set()).add(o)
    shared = {(x, y) for v in by.values() for x in v for y in v if x < y}
    assert len(truth) > 100 and truth <= shared


def test_a_shared_line_does_not_join_regions(monkeypatch):
    """Texts of 60 words of their own with a line that all share: they have keys in common, but too few to meet."""
    rng = np.random.default_rng(9)
    line = [f"line{i}" for i in range(14)]
    texts = [" ".join([*line, *(f"w{x}" for x in rng.integers(0, 1 << 40, 60))]).encode() for _ in range(300)]
    near = texts[0].replace(texts[0].split()[-1], b"other")
    texts.append(near)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    shingles, bounds = J.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, 5)
    keys, owners = J.signatures(shingles, bounds, 80)
    order = np.argsort(keys, kind="stable")
    monkeypatch.setattr(J, "PAIRED", 1000)
    a, b, level = J.key_pairs(keys[order], owners[order])
    wanted = J.class_counts(J.size_levels(80)[1:] - 1, 80)[0]
    pairs, n = np.unique(np.stack([a, b, level], 1), axis=0, return_counts=True)
    met = {(x, y) for (x, y, v), m in zip(pairs.tolist(), n.tolist()) if v == J.ANY or m >= wanted[v]}
    assert (0, 300) in met and len(pairs) > 1 and len(met) <= 2


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_pairs_share_the_wanted_keys(percent):
    rng = np.random.default_rng(percent)
    wanted = J.class_counts(J.size_levels(percent)[1:] - 1, percent)[0]
    for n in [1, 2, 3, 5, 8, 13, 20, 37, 60, 99, 150, 300, 700] * 8:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        kept = int(rng.integers(-(-percent * n // 100), n + 1))
        more = rng.integers(0, 1 << 63, kept * 100 // percent - n, dtype=np.uint64)
        b = np.unique(np.concatenate((rng.choice(a, kept, replace=False), more)))
        common = np.sort(rng.choice(a, int(rng.integers(0, n + 1)), replace=False))
        keys, owners = J.signatures(np.concatenate((a, b)), np.array([0, n, n + len(b)]), percent, common)
        level = J.key_pairs(keys, owners)[2]
        assert any(v == J.ANY or (level == v).sum() >= wanted[v] for v in np.unique(level))


def test_near_copies_make_rows_in_step_with_their_keys():
    """30 sets that agree in 200 keys: a row for each key, where all pairs would be 87,000."""
    keys = np.repeat(np.arange(200, dtype=np.uint64) << np.uint64(J.LEVEL_BITS) | np.uint64(20), 30)
    nodes = np.tile(np.arange(30), 200)
    name, bounds, held = J.key_groups(np.tile(keys, 2), np.tile(nodes, 2))  # each key sent twice
    assert len(J.key_pairs(keys, nodes)[0]) == 87_000
    assert len(name) == len(set(name.tolist())) == 200 and len(held) == bounds[-1] == 6000
    assert (np.diff(held.reshape(200, 30)) == 1).all()


@pytest.mark.parametrize("n", [2, 31, 32, 33, 63, 64, 500])
def test_large_keys_are_cut_into_pieces_that_overlap(n):
    name, bounds, held = J.key_groups(np.full(n, 7 << J.LEVEL_BITS | 20, np.uint64), np.arange(n)[::-1].copy())
    pieces = [held[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert all(2 <= len(x) <= J.PAIRED for x in pieces) and sorted({x for p in pieces for x in p}) == list(range(n))
    assert all(x[-1] == y[0] for x, y in zip(pieces, pieces[1:]))
    assert set((name & np.uint64(J.ANY)).tolist()) == {20 if n <= J.PAIRED else J.ANY}
    assert all(len(x) == 0 for x in J.key_groups(np.arange(n, dtype=np.uint64), np.arange(n))[::2])


def test_regions_are_those_of_all_pairs(spark):
    """Groups of sets that share many keys or few, within groups and across, some keys held by very many."""
    rng = np.random.default_rng(31)
    level = np.uint64(22)
    wanted = int(J.class_counts(J.size_levels(80)[1:] - 1, 80)[0][22])
    keys, nodes = [], []
    for x in range(1200):
        members = 40 * rng.integers(0, 25, rng.integers(1, 3))  # of one group of 40 nodes, or of two
        held = np.unique(np.concatenate([m + rng.integers(0, 40, rng.integers(1, 40 if x % 100 == 0 else 9)) for m in members]))
        mark = np.uint64(J.ANY) if x % 150 == 7 else level
        keys += [np.full(len(held), np.uint64(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1) & ~np.uint64(J.ANY) | mark)]
        nodes += [held.astype(np.int64) * 1_000_003 - 400_000_000]
    for group in range(2, 9):  # near copies: pairs that share enough, and one key less
        for copy, shared in enumerate((wanted, wanted - 1, wanted)):
            keys += [np.uint64(group * 64 + copy + 1 << 40) + (np.repeat(np.arange(shared, dtype=np.uint64), 2) << np.uint64(J.LEVEL_BITS)) | level]
            nodes += [np.tile(np.array([10**9 + group * 10 + copy, 10**9 + group * 10 + copy + 1]), shared)]
    for i in range(wanted):  # a pair whose keys have another smallest set each
        keys += [np.full(3, np.uint64((1 << 50) + (i << J.LEVEL_BITS)) | level)]
        nodes += [np.array([10**9 + 5 * 10**8 + i, 2 * 10**9, 2 * 10**9 + 1])]
    keys, nodes = np.concatenate(keys), np.concatenate(nodes)
    a, b, levels = J.key_pairs(keys, nodes)
    pairs, n = np.unique(np.stack([a, b, levels], 1), axis=0, return_counts=True)
    pairs = pairs[(pairs[:, 2] == J.ANY) | (n >= wanted)]
    names = np.unique(pairs[:, :2])
    root = common.union_roots(np.searchsorted(names, pairs[:, 0]), np.searchsorted(names, pairs[:, 1]), len(names))
    order = np.lexsort((nodes, keys >> np.uint64(62)))
    blobs = [(int(p), J.pack_keys(keys[use], nodes[use])) for p in range(4) for use in [order[(keys[order] >> np.uint64(62)) == p]] for _ in range(2)]
    got = J._regions(spark.createDataFrame(blobs, "part int, keys binary"), 80).collect()
    assert {(r.node, r.component) for r in got} == set(zip(names.tolist(), names[root].tolist()))
    assert len(got) == len(names) and 10 < len(set(root.tolist())) < len(names) / 2
    assert {2 * 10**9, 2 * 10**9 + 1} <= set(names.tolist())


@pytest.mark.parametrize("leaf,heavy", [(4, 2048), (16, 2048), (256, 3)])
def test_region_join_is_exact(sets, monkeypatch, leaf, heavy):
    shingles, bounds, ref, truth = sets
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "HEAVY", heavy)
    got = []
    n = len(ref)
    take = lambda i, j: got.extend(map(tuple, np.sort(np.stack([i, j], 1), 1).tolist()))
    links, root = J.Region(shingles, bounds, 85).join(np.zeros(n, int), np.ones(n), take)
    assert len(got) == len(set(got)) and set(got) == truth
    assert links.tolist() == [sum(x in p for p in truth) for x in range(n)]


def test_pivots_part_regions(sets, monkeypatch):
    """With the production leaf: cells are made, boundary sets replicated, and windows leave pairs out."""
    shingles, bounds, _, truth = sets
    monkeypatch.setattr(J, "BLOCK_PAIRS", 50)
    region, got = J.Region(shingles, bounds, 85), []
    region.join(np.zeros(len(bounds) - 1, int), np.ones(len(bounds) - 1), lambda i, j: got.extend(map(tuple, np.sort(np.stack([i, j], 1), 1).tolist())))
    assert set(got) == truth and len(got) == len(truth)
    assert region.cells > 10 and region.replicas > 0 and region.skipped > 0


def test_regions_of_two_sides(sets):
    shingles, bounds, ref, truth = sets
    side = np.arange(len(ref)) % 2 + 1
    got = []
    J.Region(shingles, bounds, 85).join(side, np.ones(len(ref)), lambda i, j: got.extend(zip(i.tolist(), j.tolist())))
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a, b in truth if side[a] != side[b]}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(1, 60))
def test_best_fill(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * i for s in sums for i in range(n + 1) if s + length * i <= capacity}
    got = packing.best_fill(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == max(sums)


def test_pack_lengths_uses_each_piece_once():
    lengths = np.random.default_rng(2).integers(1, 2049, 3000)
    window, offset, made = packing.pack_lengths(lengths)
    order = np.lexsort((offset, window))
    ends = {}
    for i in order:
        assert offset[i] == ends.get(window[i], 0)
        ends[window[i]] = offset[i] + lengths[i]
    assert max(ends.values()) <= 2048 and len(ends) == made
    assert made * 2048 / lengths.sum() < 1.01


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=60), min_size=1, max_size=6))
def test_suffix_array_and_common_prefixes(strings):
    symbols = np.concatenate([np.frombuffer(s.encode(), np.uint8).astype(np.uint64) for s in strings])
    sizes = np.array([len(s) for s in strings])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    order = suffix_dedup.suffix_array(symbols, left)
    suffix = [bytes(symbols[i : i + left[i]].astype(np.uint8)) for i in range(len(symbols))]
    assert [suffix[i] for i in order] == sorted(suffix)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    common_ = suffix_dedup.common_prefixes(symbols, left, order, starts)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common_[k] == same


@pytest.mark.parametrize("bits,size", [(24, (1 << 24) + 3000), (7, 3000)])
def test_anchors_of_long_texts(bits, size, monkeypatch):
    """Anchors are places in the whole text, and the same as those of its end alone."""
    data = np.random.default_rng(4).integers(97, 123, size).astype(np.uint8)
    cut = size - 2000
    tail = suffix_dedup.anchors(data[cut:], np.array([0, 2000]), 90, 40)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", bits, raising=False)
    whole = suffix_dedup.anchors(data, np.array([0, size]), 90, 40)
    first, count, anchor, h, context = whole
    assert count.sum() == size - 90 + 1 and (anchor >= first).all() and (anchor + 40 <= first + count - 1 + 90).all()
    late = first > cut
    assert late.sum() > 10
    for a, b, base in zip(whole, tail, (cut, 0, cut, 0, 0)):
        assert np.array_equal(a[late], b[-late.sum() :] + np.asarray(base, b.dtype))


def test_targets_hold_the_cap_and_the_whole():
    sizes = [100, 5, 300, 0, 50]
    got = mixing.resolve_targets(sizes, [5, 2, 1, 5, 2])
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes)) and abs(sum(got) - sum(sizes)) < 1e-9
    assert got[1] == 15  # held at three times its size


def test_shard_draws_add_up_and_stand_alone():
    quota = np.array([500, 77, 0, 1234])
    n = -(-quota.sum() // 64)
    whole = list(mixing.shard_draws(0, n, n, 64, quota, 3))
    assert (sum(c for _, c, _ in whole) == quota).all()
    before = np.zeros(4, int)
    for shard, counts, ahead in whole:
        assert (ahead == before).all()
        (alone,) = mixing.shard_draws(shard, shard + 1, n, 64, quota, 3)
        assert (alone[1] == counts).all() and (alone[2] == ahead).all()
        before += counts


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_block_at_is_a_permutation(n):
    for epoch in (0, 5):
        got = mixing.block_at(np.arange(n), np.full(n, epoch), n, 7, 3)
        assert sorted(got.tolist()) == list(range(n))


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 32)) * 3, rng.standard_normal((20, 32))
    rot = ann.rotation(32, 1)
    est, q_norm, off = ann.estimate(*ann.encode(x, rot), q, rot, ann.EPS)
    wrong = np.abs(est - q @ x.T) > q_norm[:, None] * off[None, :]
    assert wrong.mean() < 0.02


def test_calibrated_count_keeps_its_recall():
    t = neardup_vectors.calibrated_count(48, 2.2, 0.995)
    p = plan = neardup_vectors.plan(1000, 0.9, 64, 3)
    assert t == p["least"] and plan["tables"] >= 2
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d = rng.standard_normal((2000, 64))
    d -= (d * a).sum(1)[:, None] * a
    d /= np.linalg.norm(d, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * d
    hits = (np.abs(a @ p["lines"] - b @ p["lines"]) <= p["half"]).sum(axis=1)
    assert (hits >= t).mean() > 0.98
    met = (neardup_vectors.cells_of(a, p) == neardup_vectors.cells_of(b, p)).any(axis=1)
    assert met.mean() > 0.95


def test_fit_separates_what_positives_lack():
    rng = np.random.default_rng(0)
    width = len(quality.FEATURES)
    good, bad = rng.standard_normal((800, width)), rng.standard_normal((200, width)) + 4
    model = quality.fit(good[:400], np.concatenate((good[400:], bad)), 400 / 600)
    assert (model.score(good) >= 0.3).mean() > 0.97 and (model.score(bad) < 0.3).mean() > 0.9


def test_fit_lowers_the_non_negative_risk():
    """The risk by its definition, one row at a time: below that of the start and of random models."""
    rng = np.random.default_rng(5)
    width = len(quality.FEATURES)
    good, bad = rng.standard_normal((300, width)), rng.standard_normal((120, width)) + 2
    pos, unl, prior = good[:150], np.concatenate((good[150:], bad)), 150 / 270

    def risk(model):
        loss = lambda g: float(np.log1p(np.exp(-g)))
        raw = lambda row: sum(model.weights[np.searchsorted(model.edges[k], row[k], side="right") + k * quality.BINS] for k in range(width)) + model.bias
        p, u = [raw(r) for r in pos], [raw(r) for r in unl]
        return prior * np.mean([loss(g) for g in p]) + max(0, np.mean([loss(-g) for g in u]) - prior * np.mean([loss(-g) for g in p]))

    fitted = quality.fit(pos, unl, prior)
    least = risk(fitted)
    assert least < 0.5 * risk(quality.Model(fitted.edges, np.zeros(width * quality.BINS), fitted.bias))
    for _ in range(20):
        other = quality.Model(fitted.edges, fitted.weights + rng.standard_normal(len(fitted.weights)) * 0.5, fitted.bias)
        assert risk(other) > least - 1e-6


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_comes_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(int(share * 100))
    width, n = len(quality.FEATURES), 4000
    k = int(n * share)
    good, bad = rng.standard_normal((2000 + k, width)), rng.standard_normal((n - k, width)) + 2.5
    unl = rng.permutation(np.concatenate((good[2000:], bad)))
    assert abs(quality.estimate_prior(good[:2000], unl) - share) < 0.05
    assert quality.estimate_prior(good[:10], unl) == 0.5


def test_fit_without_rows_is_the_prior():
    none = np.zeros((0, len(quality.FEATURES)))
    assert abs(quality.fit(none, none, 0.8).score(np.zeros((1, len(quality.FEATURES))))[0] - 0.8) < 1e-9


def test_encoder_agrees_with_the_tokenizer_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    encode = packing.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["", " ", "Thhaen the\n\nof  éè 1234!!", "a<|endoftext|>b", "你好\U0001f600\tx", "don't " * 50]
    for t in texts:
        assert encode(t) == library.encode(t, add_special_tokens=False).ids
    assert zlib.crc32(np.array(encode(texts[2]), "<u4").tobytes()) >= 0
