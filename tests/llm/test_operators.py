"""Operators against brute force on small tables with nulls, repeats, ties, long and empty texts."""

import hashlib
import html as html_lib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, html_text, jaccard_join, mixing, neardup_vectors, packing, quality, sharding, suffix_dedup, warc
from tests.llm.test_bytes import near_copies, shingles_ref

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


def docs_frame(spark, texts, parts=4):
    rows = [(i, t, "en", None if i % 7 == 6 else f"s{i % 7}", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7)))
    out = [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(40)]
    out += out[:5] + ["", None, "one", "a b c", " ".join(word() for _ in range(20_000)), "ab" * 900, "THE!! " * 300]
    return out


# --------------------------------------------------------------------- op 1


@pytest.mark.parametrize("region", [2_000_000, 400])
def test_jaccard_classes(spark, region):
    texts = near_copies(np.random.default_rng(3), 30)
    ref = [shingles_ref(t) for t in texts]
    links = [
        (i, j) for i in range(len(ref)) for j in range(i + 1, len(ref))
        if ref[i] and ref[j] and 100 * len(ref[i] & ref[j]) >= 85 * len(ref[i] | ref[j])
    ]
    want, degree = components(range(len(ref)), links), Counter(x for p in links for x in p)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs_frame(spark, texts), region_shingles=region).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(ref[i]), want[i], degree[i])


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_jaccard_of_many_candidates(spark, monkeypatch, ids):
    """Above the first bound the sets are not broadcast; up to the second only their own texts are dealt."""
    texts = [f"{i // 2} b c d e f g h i j k l m n o p q r s t {i // 2}" for i in range(20)]
    wanted = sorted(map(tuple, jaccard_join.jaccard_classes(docs_frame(spark, texts)).collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_CANDIDATES", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", ids)
    assert sorted(map(tuple, jaccard_join.jaccard_classes(docs_frame(spark, texts)).collect())) == wanted


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_classes(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_classes(rows).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=repr)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words that do not match here"), (3, "other words that do not match here"), (None, "a b c d e f g")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 3), (True, None)]


# --------------------------------------------------------------------- op 2


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é " + "x" * 200_000
    rows = [
        (5, "http://a/", "y" * 150), (2, "http://b/é", "y" * 150), (9, None, "y" * 150), (1, "u", "short"), (3, "u", "short"),
        (4, "u", None), (6, "u\r\nx", ""), (7, "u", long), (8, "u", "WARC/1.1\r\n\r\n" + "z" * 100),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages, payloads=True).collect()}
    assert len(got) == len(rows)
    for i, url, body in rows:
        raw = (body or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest() and got[i].url == url
        revisit = i in (5, 9)
        assert got[i].record_type == ("revisit" if revisit else "response") and got[i].refers_to == (2 if revisit else None)
        assert revisit or bytes(got[i].payload) == raw
    normalised = warc.normalise_archives(warc.write_archives(warc.assign_types(pages), archive_bytes=500))
    import gzip

    for path in warc.export_archives(normalised, str(tmp_path)):
        assert gzip.open(path).read().count(b"WARC-Type") >= 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_monolithic_and_member_streams_read_alike():
    records = [warc.format_record(i, "u", b"x" * i * 1000, i * 1000, "d", "response", None) for i in range(1, 30)]
    import gzip

    whole, parts = gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)
    assert list(warc.split_stream(whole, 777)) == records == list(warc.split_stream(parts, 777))
    with pytest.raises(ValueError):
        list(warc.split_stream(whole[:-20]))


# --------------------------------------------------------------------- op 3


def test_mix(spark, texts):
    df = docs_frame(spark, texts * 6)
    rows = mixing.mix_documents(df, block=16, shard_blocks=64).collect()
    again = mixing.mix_documents(df.repartition(3), block=16, shard_blocks=64).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = mixing.resolve_targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))])
    for s, size, t in zip(order, sizes, want):
        assert {r.source_size for r in by[s]} == {size} and abs(by[s][0].target - t) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - t) <= 0.05 * t + 32


def test_mixed_documents_hold_what_is_taken(spark, texts):
    df = docs_frame(spark, [t for t in texts if t])
    # rows that agree in id and text do not occur here
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(df, block=16).collect()}
    got = mixing.mixed_documents(df, block=16)
    assert got.columns == df.columns
    words = Counter()
    for r in got.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix_documents(docs_frame(spark, ["", None])).collect()
    assert [r.taken for r in rows] == [0, 0]


# --------------------------------------------------------------------- op 4


def kept_ref(texts, n):
    out = []
    removed_ref(texts, n, out)
    return out


def removed_ref(texts, n, keep=None):
    keep = [] if keep is None else keep
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r) + 1)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        kept = bytes(x for x, h in zip(r, hit) if not h)
        keep.append(kept)
        spans = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n,gram,contexts", [(400, 128, 24_000), (60, 24, 24_000), (60, 24, 2), (53, 16, 3)])
def test_remove_repeats(spark, n, gram, contexts):
    rng = random.Random(n)
    word = lambda k: " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7))) for _ in range(k))
    texts = []
    for _ in range(15):
        base = word(rng.randint(5, 250))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice("xyzé")
            texts.append("".join(t))
    p = word(80)
    texts += [word(30) + p + word(20), word(10) + p, p, p + p, "ab" * 500, "ab" * 500 + "c", "a" * n, "a" * (n + 1), "", None, "x" * (n - 1), word(120) * 2]
    got = suffix_dedup.remove_repeats(docs_frame(spark, texts), n, gram=gram, shard_contexts=contexts)
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    by = {r.doc_id: r for r in got.collect()}
    for i, want in enumerate(removed_ref(texts, n)):
        r = by[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert (r.text is None) == (texts[i] is None)


@pytest.mark.parametrize("n,passage,gram,contexts", [(400, 240, 128, 12_000), (60, 40, 24, 12_000), (60, 31, 16, 2)])
def test_remove_repeats_at_two_lengths(spark, n, passage, gram, contexts):
    """Counts and digest are those of the longer length alone, the text that of the shorter."""
    rng = random.Random(n + passage)
    word = lambda k: " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7))) for _ in range(k))
    shared = [word(rng.randint(passage // 6, n // 4)) for _ in range(8)]
    texts = [f"{word(rng.randint(3, 60))} {rng.choice(shared)} {word(rng.randint(3, 60))} {rng.choice(shared)}" for _ in range(40)]
    base = word(300)
    texts += [base[:k] + "x" + base[k:] for k in range(0, len(base), 97)] + [base, base, "ab" * n, "", None, "a" * (n + 1)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_frame(spark, texts), n, passage=passage, gram=gram, shard_contexts=contexts).collect()}
    for i, (want, short) in enumerate(zip(removed_ref(texts, n), kept_ref(texts, passage))):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert r.text == (None if texts[i] is None else short.decode("utf-8", "ignore"))


def test_stretches():
    place = np.array([10 << 32 | 5 << 16, 15 << 32 | 3 << 16 | 2, 30 << 32 | 4 << 16])
    some = np.array([1, 3], np.int32).tobytes()
    assert suffix_dedup.stretches(place, [None, None, some], 8, 1).tolist() == [[10, 25], [31, 40]]
    assert suffix_dedup.stretches(place, [None, None, some], 8, 10).tolist() == [[10, 25]]


def test_remove_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "q" * 30 + "x" * 500), (1, "x" * 10), (1, "x" * 10)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == [(False, 0), (False, 0), (True, 500)]


# --------------------------------------------------------------------- op 5


def test_packing(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs_frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    seen, windows = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: len(x) for i, x in ids.items()} == dict(seen)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


# --------------------------------------------------------------------- op 6, 7


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 24))
    out = [base[i % 60] + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.3]) for i in range(300)] + list(base)
    rows = [(i, [float(np.float32(v)) for v in x], i % 3) for i, x in enumerate(out)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, [None] * 24, 0), (n + 4, [float("inf")] + [0.0] * 23, 0), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("cell_rows", [4000, 7])
def test_near_duplicate_vectors(spark, vectors, cell_rows):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4)
    rows = neardup_vectors.near_duplicates(df, 0.9, cell_rows=cell_rows).collect()
    x = np.array([v for _, v, _ in vectors[:420]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))]
    found = sum(r.n_links for r in rows) / 2
    assert len(rows) == len(vectors) and found >= 0.95 * len(links)
    by = {r.vec_id: r for r in rows}
    if found == len(links):
        want = components(range(420), links)
        assert all(by[i].component_id == want[i] for i in range(420))
    for i in range(420, len(vectors)):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


def test_links_at_the_threshold_are_found(spark):
    """Pairs planted at cosines of 0.90 to 0.93, the hardest that must link: 99 % at least, and no link below 0.9."""
    rng = np.random.default_rng(9)
    n, dim = 3000, 64
    a, d = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d -= (d * a).sum(1)[:, None] * a
    d /= np.linalg.norm(d, axis=1)[:, None]
    c = rng.uniform(0.9, 0.93, n)[:, None]
    x = np.concatenate((a, c * a + np.sqrt(1 - c**2) * d)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sims = u @ u.T
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(sims >= 0.9, 1)))]
    rows = {r.vec_id: r for r in neardup_vectors.near_duplicates(df, 0.9).collect()}
    assert len(links) > 2900 and 0.99 * len(links) <= sum(r.n_links for r in rows.values()) / 2 <= len(links)
    want = components(range(2 * n), links)
    # what is joined is linked: a component lies within a true one, and nearly all are whole
    assert all(want[i] == want[rows[i].component_id] for i in range(2 * n))
    assert np.mean([rows[i].component_id == want[i] for i in range(2 * n)]) >= 0.99


@pytest.mark.parametrize("rows", [40, 700])
def test_collisions_are_those_of_the_windows(rows):
    rng = np.random.default_rng(rows)
    p = neardup_vectors.plan(1000, 0.9, 16, 3)
    x = np.repeat(rng.standard_normal((-(-rows // 3), 16)), 3, axis=0)[:rows] + rng.standard_normal((rows, 16)) * 0.1
    y = x[::2] + rng.standard_normal((len(x[::2]), 16)) * 0.05
    lines = neardup_vectors.Lines(x, p)
    got = {(i, j) for a, b in neardup_vectors.colliding(*lines.windows(y, p), lines.rank, p["least"]) for i, j in zip(a, b)}
    near = np.abs((y @ p["lines"])[:, None, :] - (x @ p["lines"])[None, :, :]) <= p["half"]
    assert got == set(zip(*np.nonzero(near.sum(axis=2) >= p["least"]))) and len(got) >= len(y)


def test_vectors_of_many_lengths(spark):
    rows = [(d * 10 + i, [1.0 + i * (k == 0) * 5 for k in range(d)]) for d in range(1, 40) for i in (0, 0.001)]
    rows = [(n, v) for n, (_, v) in enumerate(rows)]
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].component_id == i - i % 2 and got[i].n_links == 1 for i in range(len(rows)))


def test_nearest_of_repeated_queries(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    once = [tuple(r) for r in ann.nearest(df, df.filter("vec_id in (0, 20)"), k=7).collect()]
    twice = df.filter("vec_id in (0, 20)").unionAll(df.filter("vec_id = 0"))
    assert sorted(tuple(r) for r in ann.nearest(df, twice, k=7).collect()) == sorted(once)
    # a vec_id with two vectors asks twice
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(two, two.filter("vec_id = 0")).collect())
    assert got == [(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_nearest(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4)
    rows = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=7).collect()
    x = np.array([v for _, v, _ in vectors[:420]])
    hits = total = 0
    for q in range(0, 420, 20):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(420), -score)) if i != q][:7]
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 8))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in got)
        hits += len({r.vec_id for r in got} & set(order))
        total += 7
    assert hits >= 0.95 * total and {r.query_id for r in rows} <= set(range(0, 420, 20))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, 5.0)]


# --------------------------------------------------------------------- op 8


@pytest.mark.parametrize("n", [1, 2, 39, 41, 500, 5000])
def test_feistel_shards(spark, n):
    rows = sharding.shard_documents(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("slot")), 40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == 16 + len(f"t{r.doc_id}") and r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode()) and r.law == "rows"
    counts = [len(by.get(s, [])) for s in range(40)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_feistel_shards_are_reproducible(spark, texts):
    a = sharding.shard_documents(docs_frame(spark, texts, 2)).collect()
    b = sharding.shard_documents(docs_frame(spark, texts, 7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    nulls = spark.createDataFrame([(None, None), (None, None), (1, None)], "doc_id long, text string")
    assert sorted(r.size for r in sharding.shard_documents(nulls).collect()) == [16, 16, 16]
    assert sharding.shard_documents(nulls.limit(0)).count() == 0


# --------------------------------------------------------------------- op 9

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="home nav-open">
<header><a href="/">no logo</a></header><nav><ul><li>no<li>no</ul></nav><div class="cookie-notice">no &amp; no</div><div class="ad">no</div>
<article><header><h1>Title &lt;{i}&gt;</h1></header><p><b>First  &eacute;{i}<br><p>Second&nbsp;part <i>in</i>line</p><!-- no --><form>no<input></form>
<div class="share-buttons">no</div><ul><li>one<li>two</ul><section id="comments">no</section></article><aside>no</aside><footer>no</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(30)]
    rows += [(100, "http://x/", None), (101, None, ""), (102, "http://y/", "plain <b>text"), (103, "bad", "<p>a<p>b &amp;c<div hidden>no</div><script>x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, blocks int").repartition(3)
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i].text == f"Title <{i}> First é{i} Second part inline one two" or got[i].text == f"Title <{i}> First é{i}"
    assert [got[i].text for i in (100, 101, 102, 103)] == ["", "", "plain text", "a b &c"]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.limit(0)).count() == 0


def test_constant_texts_are_template_and_copies_are_not(spark):
    frame = "<body><div>Daily Site</div><div>{}</div><p>All rights</p></body>"
    rows = [(i, f"http://t.example/{i}", frame.format(f"story {i}")) for i in range(20)]
    rows += [(100 + i, f"http://c.example/{i}", frame.format("same story")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert [got[i] for i in range(20)] == [f"story {i}" for i in range(20)]
    assert {got[100 + i] for i in range(20)} == {"Daily Site same story All rights"}


def test_hosts_of_few_pages_have_templates(spark):
    frame = "<body><div>Daily Site</div><div>{}</div><p>All rights {}</p></body>"
    rows = [(10 * n + i, f"http://h{n}.example/{i}", frame.format(f"a much longer story {i}", "kept")) for n in (1, 2, 3, 9) for i in range(n)]
    # versions of one page, and beside another page
    rows += [(200 + i, f"http://v.example/{i}", frame.format("the one long story here", i)) for i in range(3)]
    rows += [(300 + i, f"http://w.example/{i}", frame.format("the one long story here" if i else "quite another long story", i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[10] == "Daily Site a much longer story 0 All rights kept"
    assert all(got[10 * n + i] == f"a much longer story {i}" for n in (2, 3, 9) for i in range(n))
    assert [got[200 + i] for i in range(3)] == [f"Daily Site the one long story here All rights {i}" for i in range(3)]
    assert got[300] == "quite another long story All rights 0"
    assert [got[300 + i] for i in range(1, 5)] == [f"the one long story here All rights {i}" for i in range(1, 5)]


@pytest.mark.parametrize(
    "source,want",
    [
        ('<body style="overflow-x:hidden"><p>a</p></body>', "a"),
        ('<div class="content" style="overflow: hidden">a</div>', "a"),
        ("<div title='hidden gems'>a</div><div data-hidden=false>b</div>", "a b"),
        ('<article><p>a <a href="/story?id=ad12">b</a> c</p></article>', "a b c"),
        ('<div title="class=ad">a</div><div data-id="ad">b</div><div title=\'x" hidden\'>c</div>', "a b c"),
        ('<div hidden>a</div><div class="x"hidden="">b</div><div HIDDEN = "until-found">c</div>d', "d"),
        ('<div aria-hidden="true">a</div><div aria-hidden="false">b</div><div id=ad>c</div><div role="navigation">d</div>', "b"),
        ("<body hidden>a</body>", ""),
    ],
)
def test_attributes_are_read_by_name(source, want):
    assert said(source) == want


def said(source):
    return " ".join(t for _, _, listed, t in html_text.parse(source)[1] if not listed)


def test_tree_matching():
    a, b = "0:(1:x(2:a,3:b,4:c))", "0:(1:x(2:a,3:c,4:d))"
    assert html_text.align(html_text.read_tree(a), html_text.read_tree(b)) == {0: 0, 1: 1, 2: 2, 4: 3}
    assert html_text.align(html_text.read_tree("0:(1:x)"), html_text.read_tree("0:(1:y)")) == {0: 0}


def most_pairs(a, b):
    """Brute force: the most nodes that any alignment pairs that keeps levels, labels and order."""
    if a.label != b.label:
        return 0

    def ways(xs, ys):
        if not xs or not ys:
            return 0
        return max(ways(xs[1:], ys), *(most_pairs(xs[0], ys[k]) + ways(xs[1:], ys[k + 1 :]) for k in range(len(ys))))

    return 1 + ways(a.children, b.children)


def test_tree_matching_is_the_best_alignment():
    rng = random.Random(8)

    def tree(depth):
        nonlocal made
        made += 1
        return f"{made - 1}:{rng.choice('ab')}" + (f"({','.join(tree(depth - 1) for _ in range(rng.randint(1, 3)))})" if depth else "")

    def nodes(node, path=()):
        yield node.ident, (node.label, len(path))
        for k in node.children:
            yield from nodes(k, (*path, node))

    for _ in range(60):
        made = 0
        a = html_text.read_tree(tree(2))
        made = 0
        b = html_text.read_tree(tree(2))
        pairs = html_text.align(a, b)
        assert len(pairs) == len(set(pairs.values())) == most_pairs(a, b)
        of_a, of_b = dict(nodes(a)), dict(nodes(b))
        assert all(of_a[x] == of_b[y] for x, y in pairs.items())


def test_repeating_slots_are_template_without_any_list(spark, monkeypatch):
    """Menus, adverts and footers whose entries come back on other pages go by the template alone."""
    rng = random.Random(3)
    pool = [f"entry {i}" for i in range(12)]
    page = "<body><div class=top>{}</div><p>{}</p><div class=low>site {}</div><ul>{}</ul><p>{}</p></body>"
    rows, want = [], {}
    for i in range(40):
        a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
        low, top = rng.choice(pool), rng.choice(pool)
        rows.append((i, "http://s.example/x", page.format(top, a, low, "".join(f"<li>{rng.choice(pool)}" for _ in range(4)), b)))
        want[i] = f"{a} {b}"
    rows.append((99, "http://lone.example/", rows[0][2]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert {i: got[i].text for i in range(40)} == want
    assert all(got[i].n_template > 0 and got[i].n_listed == 0 for i in range(40))
    assert got[99].n_template == 0 and want[0] != got[99].text


def test_extraction_agrees_with_another_parser(spark):
    """Pages whose article is known, against the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.deep, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            if self.deep and tag in ("p", "h1", "li", "br"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.deep -= tag == "article"

        def handle_data(self, data):
            if self.deep:
                self.out.append(data)

    rng = random.Random(2)
    words = lambda k: " ".join(rng.choice(["é&amp;b", "&lt;x&gt;", "plain", "&#233;t&eacute;", "2 &gt; 1", "a\n b"]) for _ in range(k))
    rows = []
    for i in range(60):
        body = "".join(f"<p>{words(rng.randint(1, 30))}<br>{words(3)}</p>" for _ in range(rng.randint(1, 5)))
        article = f"<article><h1>{words(4)} {i}</h1>{body}<ul><li>{words(2)}<li>{words(2)}</ul></article>"
        rows.append((i, f"http://h{i % 4}/{i}", f"<html><body><nav><a href='/>'>{words(3)}</a></nav><div class='ad'>{words(5)}</div>{article}<footer>{words(4)}</footer></body></html>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, source in rows:
        parser = Article()
        parser.feed(source)
        assert got[i] == " ".join("".join(parser.out).split())


def test_subjects_of_an_article_are_kept():
    long = "words that tell the story " * 20
    assert said(f'<div class="search-results legal"><p>{long}</p></div><div class="share">no</div><div class="legal">no</div>') == long.strip()
    assert said(f'<div class="search-page"><div class="share">no</div><p>{long}</p></div>') == long.strip()
    # never so for comments, adverts and hidden parts
    assert said(f'<p>short</p><section id="comments">{long}</section><div class="legal" hidden>{long}</div>') == "short"


@pytest.mark.parametrize("source", ["<a", '<a "', "<a '\"", "<div>", "</p>", "<<", "<!--", "<li>", '<div class="search">', "<p><b>"])
def test_pages_are_parsed_in_linear_time(source):
    import time

    def seconds(n):
        start = time.perf_counter()
        html_text.parse(source * n + "</i><p></p></p>" * 500)
        return time.perf_counter() - start

    assert seconds(20_000) < 3


def test_deep_and_broken_pages():
    shape, blocks = html_text.parse("<div>" * 5000 + "x" + "</p></span>" * 10 + "<a href='a>b'>y</a><br>z<!-- open")
    assert " ".join(t for *_, t in blocks).split() == ["x", "y", "z"] and len(shape) < 10_000
    assert html_lib.unescape("&amp;") == "&"


# -------------------------------------------------------------------- op 10


def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "runs", "over", "old", "stones", "and", "sings"]) + "," * (rng.random() < 0.1) for _ in range(rng.randint(20, 120))) + "." for _ in range(400)]
    junk = [" ".join("X!!%%" * 2 for _ in range(rng.randint(5, 40))) for _ in range(80)]
    texts = good + junk + ["", None]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(480) if i % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in rows if rows[i].held_out and i < 480]
    assert np.mean([rows[i].predicted == int(i < 400) for i in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in rows.items() if r.predicted}
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert len({round(r.score, 9) for r in none}) == 1
    assert quality.score_documents(docs.limit(0), labels).count() == 0
