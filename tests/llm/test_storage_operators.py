"""Operators 1, 6, 7 and 9 against brute force, exact round trips, and odd rows."""

import io
import math
import os
import zlib
from collections import Counter
from functools import cache

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import mixing, progressive_jpeg, token_planes, warc
from loomgraph.llm.queries import queries

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "one", "Straße 日本語", "x" * 575, "x" * 576, "word " * 40_000]

# ---- media


def test_payloads_come_back(spark, small):
    texts = small("documents", "doc_id", "text")
    got = queries()["op1_progressive_jpeg"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        full = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), brute.sha(full), zlib.crc32(full[-32:]))


def test_media_of_odd_rows(docs):
    rows = docs([*ODD, (None, "one")])
    got = sorted(progressive_jpeg.digests(progressive_jpeg.store(rows)).collect(), key=str)
    by = {r.doc_id: r for r in got}
    same = lambda a, b: by[a][1:] == by[b][1:]
    assert len(got) == 10 and same(0, 1) and same(3, 4) and same(3, None) and by[7].payload_bytes == 576
    assert progressive_jpeg.digests(progressive_jpeg.store(rows.limit(0))).count() == 0
    media = progressive_jpeg.store(rows)
    t = {r.doc_id: r for r in progressive_jpeg.tensors(media.unionByName(rows.sparkSession.createDataFrame([(99, None)], media.schema))).collect()}
    assert t[99].rgb is None and all(len(r.rgb) == r.height * r.width * 3 for i, r in t.items() if i != 99)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_any_bytes(texts):
    blobs = progressive_jpeg.encode(texts)
    for text, (decoder, n) in zip(texts, progressive_jpeg.decode(blobs), strict=True):
        assert progressive_jpeg.payload(decoder, n) == (progressive_jpeg.padded(text), len(text))


def test_pixels_equal_the_plain_transform():
    text = bytes(np.random.default_rng(3).integers(97, 123, 576 * 3).astype(np.uint8))
    (decoder, n), = progressive_jpeg.decode(progressive_jpeg.encode([text]))
    rgb, x = decoder.pixels(n), np.arange(8)
    basis = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[:, None] / 2
    blocks = (np.frombuffer(text, np.uint8).astype(float) - 128).reshape(-1, 9, 64)
    for mcu in range(3):
        def plane(first, h, v):
            rows = []
            for j in range(v):
                row = []
                for i in range(h):
                    square = np.zeros(64)
                    square[progressive_jpeg.ZIGZAG] = blocks[mcu, first + j * h + i]  # noqa: B023
                    row.append(np.clip(np.round(basis.T @ square.reshape(8, 8) @ basis) + 128, 0, 255))
                rows.append(np.hstack(row))
            return np.repeat(np.repeat(np.vstack(rows), 2 // v, 0), 3 // h, 1)

        y, cb, cr = plane(0, 3, 2), plane(6, 1, 2) - 128, plane(8, 1, 1) - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
        assert np.abs(rgb[:, mcu * 24 : mcu * 24 + 24].astype(float) - want).max() <= 3


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard long")


def test_archives(spark, tmp_path):
    long = "<p>x</p>" * 30
    rows = [(5, "http://a/b c\n", long), (3, None, long), (4, "u", None), (6, "u", ""), (9, "u", "é" * 49), (8, "u", "é" * 49), (10, "u", "é" * 50), (2, "u", "é" * 50), (None, "u", long), (7, "u", "y" * 300_000), (7, "u", "y" * 300_000)]
    names = []
    for k in ("a", "b"):
        manifest = sorted(warc.write_archives(pages(spark, rows).repartition(3 if k == "a" else 1), f"{tmp_path}/{k}", roll_bytes=300).collect())
        names.append([(r.file, r.records, r.bytes, r.sha256) for r in manifest])
    assert names[0] == names[1] and sum(r[1] for r in names[0]) == len(rows) and not [f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".tmp")]
    got = sorted(map(tuple, warc.read_archives(spark, f"{tmp_path}/a").collect()), key=str)
    refers = {5: 3, 10: 2, None: 3}
    want = [(i, len((h or "").encode()), brute.sha(h or ""), "revisit" if i in refers else "response", refers.get(i)) for i, _, h in rows]
    assert got == sorted(want, key=str)
    first = f"{tmp_path}/a/{names[0][0][0]}"
    data = open(first, "rb").read()
    with open(first, "wb") as f:
        f.write(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])
    with pytest.raises(Exception):  # noqa: B017
        warc.read_archives(spark, f"{tmp_path}/a").collect()
    warc.write_archives(pages(spark, []), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_far_out_ids_leave_ranges_even(spark):
    rows = [(i * 3, "u", "x" * 300) for i in range(2000)] + [(2**62, "u", "y"), (-(2**62), "u", "z"), (7, "u", "x" * 300), (None, "u", "n")]
    dealt, n = warc.in_ranges(spark.createDataFrame(rows, "page_id long, url string, html string"), ranges=8)
    got = dealt.collect()
    sizes = Counter(r.shard for r in got)
    assert n == 8 and len(got) == len(rows) and max(sizes.values()) < 2 * len(rows) / 8
    order = sorted((r for r in got if r.page_id is not None), key=lambda r: r.page_id)
    assert [r.shard for r in order] == sorted(r.shard for r in order) and [r.shard for r in got if r.page_id is None] == [0]


# ---- mixing


def entropy(w):
    return -sum(x * math.log(x) for x in w if x)


def test_mixture_meets_its_targets(spark, small):
    docs = small("documents", "doc_id", "source", "text")
    tokens = Counter()
    for source, text in docs.values():
        tokens[source or ""] += len(brute.words(text)) + 1
    used, total, weights = Counter(), sum(tokens.values()), {}
    copies = Counter()
    for r in queries()["op7_mixing"](spark, DATA).collect():
        used[r.source] += r.n_tokens
        weights[r.source] = r.weight
        copies[r.doc_id] += 1
        assert r.n_tokens == len(brute.words(docs[r.doc_id][1])) + 1 and 0 <= r.block < 1024
    p = {s: t / total for s, t in tokens.items()}

    def mixture(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    low, high, target = 0.0, 1.0, entropy(p.values()) + mixing.ENTROPY_GAIN * (math.log(len(p)) - entropy(p.values()))
    for _ in range(60):
        mid = (low + high) / 2
        w = mixture(mid)
        if entropy(w.values()) > target or max(w[s] / p[s] for s in p) > mixing.MOST_REPEATS:
            low = mid
        else:
            high = mid
    most = max(len(brute.words(t)) + 1 for _, t in docs.values())
    for s, w in weights.items():
        assert abs(used[s] - w * total) <= most + 1, s
    assert sum(weights.values()) == pytest.approx(1) and max(copies.values()) <= mixing.MOST_REPEATS + 1
    assert entropy(weights.values()) == pytest.approx(entropy(mixture(high).values()), abs=1e-5)


@pytest.mark.parametrize("passes", [0.4, 1.5, 3.0])
def test_blocks_are_permuted_in_each_pass(docs, passes):
    rows = docs([(i, f"word {i} " + "more " * (i % 5), "a" if i % 3 else "b") for i in range(3000)])
    total = sum(3 + i % 5 for i in range(3000))
    got = mixing.schedule(rows, budget=int(passes * total), entropy_gain=0.0).collect()
    own = lambda h: (h >> 54) + 512
    seen, used = {}, Counter()
    for r in got:
        assert seen.setdefault((r.source, r.mix_epoch, r.mix_block), own(r.mix_hash)) == own(r.mix_hash)
        used[r.source] += r.mix_tokens
    # Of each source's passes all but the last are whole; the last takes its blocks in order, each whole but the one that it ends in.
    for s in ("a", "b"):
        every = {}
        for i, h, t in {(r.doc_id, r.mix_hash, r.mix_tokens) for r in mixing.passes(rows).collect() if r.source == s}:
            every.setdefault(own(h), []).append((h, i, t))
        n = sum(map(len, every.values()))
        for epoch in range(math.ceil(passes)):
            mine = [r for r in got if r.source == s and r.mix_epoch == epoch]
            if len(mine) == n:
                continue
            assert epoch == math.ceil(passes) - 1
            places = {p: [r.doc_id for r in mine if r.mix_block == p] for p in {r.mix_block for r in mine}}
            cut = max(places)
            assert all(len(ids) == len(every[seen[s, epoch, p]]) for p, ids in places.items() if p != cut)
            assert sorted(places[cut]) == sorted(i for _, i, _ in sorted(every[seen[s, epoch, cut]])[: len(places[cut])])
        share = sum(t for b in every.values() for _, _, t in b)
        assert abs(used[s] - passes * share) <= 9
    assert (len({k[2] for k in seen}) > 900 or passes < 1) and any(k[2] != v for k, v in seen.items())


def test_repeats_are_limited(spark):
    stats = spark.createDataFrame([("hot", 1_000_000)] + [(f"s{i}", 1000 + i) for i in range(30)], "source string, tokens long")
    tokens = {r.source: r.tokens for r in stats.collect()}
    total = sum(tokens.values())
    for limit, budget in ((4.0, None), (2.0, None), (50.0, None), (1.5, 2 * total)):
        a, z, own = mixing.exponent(stats, budget, most_repeats=limit)
        weights = {s: (t / total) ** a / z for s, t in tokens.items()}
        most = max(weights[s] * own / t for s, t in tokens.items())
        assert sum(weights.values()) == pytest.approx(1)
        assert a == 1 if budget else most <= limit + 1e-9
        if limit < 50 and not budget:
            assert most == pytest.approx(limit, rel=1e-3)  # the limit binds before the entropy
    assert mixing.exponent(stats.limit(0)) == (1.0, 1.0, 0) and mixing.exponent(stats.limit(1))[1] == 1


def test_mixing_odd_rows(docs):
    rows = docs([(i, t, None if i % 3 else "web") for i, t in enumerate(ODD)] + [(None, "one", "web"), (3, "one", "web"), (3, "one", "web")])
    got = mixing.schedule(rows, budget=200_000).collect()
    assert got and {"doc_id", "text", "source", "key", "mix_epoch", "mix_block"} <= set(got[0].asDict())
    assert mixing.schedule(rows.limit(0)).count() == 0


# ---- token planes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1), max_size=40), max_size=12), st.booleans(), st.integers(1, 16))
def test_any_ids(rows, bits, block):
    out = io.BytesIO()
    writer = token_planes.PlaneWriter(out, block, bits)
    for i, ids in enumerate(rows):
        writer.add(None if i % 5 == 3 else i, np.array(ids, "<u4").tobytes())
    writer.close()
    got = [(i, ids.tolist()) for i, ids in token_planes.PlaneReader(pa.BufferReader(out.getvalue())).documents()]
    assert got == [(None if i % 5 == 3 else i, ids) for i, ids in enumerate(rows)]
    with pytest.raises(Exception):  # noqa: B017
        token_planes.PlaneReader(pa.BufferReader(out.getvalue()[:-3]))


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def stored(rows):
    """Rows that the token query gives for (doc_id, text) in order."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array(encoded(text), "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens(spark, small):
    got = sorted(map(tuple, queries()["op9_token_planes"](spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == stored(sorted(small("documents", "doc_id", "text").items()))


@pytest.mark.parametrize("bits", [False, True])
def test_tokens_of_odd_rows(spark, docs, tmp_path, bits):
    import public_tokenizers

    path, extra = public_tokenizers.path("word_bpe_49k.json"), "0 a0b \x85 \u2003 0x00 00 \x1c\u00a0 é e\u0301 <pad> [UNK]\u200b 12345.67 don't"
    rows = docs([*ODD, extra, (None, "null id"), (3, "zz"), (3, "aa")])
    token_planes.write_planes(rows, f"{tmp_path}/p", path, bits=bits, block_ids=1000)
    got = sorted(map(tuple, token_planes.read_planes(spark, f"{tmp_path}/p").collect()), key=lambda r: r[1])
    order = [(None, "null id"), *enumerate(ODD[:3]), (3, "aa"), (3, "one"), (3, "zz"), *list(enumerate([*ODD, extra]))[4:]]
    assert got == stored(order)
    token_planes.write_planes(rows.limit(0), f"{tmp_path}/none", path)
    assert token_planes.read_planes(spark, f"{tmp_path}/none").count() == 0


WORDS = st.text("aZbéÉñßİıſǅ́İ'.,!<|>0９٣京 \n\t ​-_", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6))
def test_word_ids_are_those_of_whole_texts(texts):
    import public_tokenizers

    encoder = token_planes.encoder_of(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(encoder, token_planes.WordEncoder)
    texts = [*texts, "don't <|endoftext|> I'LL 's'sx " + texts[0]]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [encoded(t)[:-1] for t in texts]


def test_a_word_is_looked_up_once(monkeypatch):
    import public_tokenizers

    class Counting(token_planes.Pieces):
        looked = 0

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

        def __contains__(self, word):
            self.looked += 1
            return super().__contains__(word)

    encoder = token_planes.encoder_of(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(encoder, "cache", Counting())
    texts = ["new Words, new words", "known 7 words", "", "new"] * 3
    want = [encoded(t)[:-1] for t in texts]
    ids = lambda **k: [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts], **k)]
    assert ids(at_once=30) == want  # in several blocks, of which the later know the words
    encoder.cache.looked = 0
    assert ids() == want and encoder.cache.looked == sum(len(t.split()) for t in texts)
    monkeypatch.setattr(token_planes, "CACHE_WORDS", 2)
    assert ids(at_once=1) == want
    # Words whose encoding failed are new words again.
    monkeypatch.setattr(encoder, "_learn", lambda words: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        list(encoder.encode([b"other unseen"]))
    monkeypatch.undo()
    assert ids() == want


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, texts = token_planes.encoder_of(path), ["two  words\n x", "", "0 a 0"]
    assert isinstance(encoder, token_planes.WholeEncoder)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_files_roll(spark, docs, tmp_path):
    import public_tokenizers

    rows = docs([(i, "some words here " * (i % 7)) for i in range(60)])
    manifest = token_planes.write_planes(rows.coalesce(1), f"{tmp_path}/r", public_tokenizers.path("word_bpe_49k.json"), roll_ids=50).collect()
    assert len(manifest) > 8 and all(r.ids < 50 + 40 for r in manifest)
    got = sorted(map(tuple, token_planes.read_planes(spark, f"{tmp_path}/r").collect()), key=lambda r: r[1])
    assert got == stored([(i, "some words here " * (i % 7)) for i in range(60)])
