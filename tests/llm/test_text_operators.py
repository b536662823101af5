"""Operators 2, 3, 4, 5, 8 and 10 against brute force, and on odd rows."""

import math
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

from loomgraph.llm import chat, context_mixing, decontaminate, near_dedup, secrets, toxicity
from loomgraph.llm.queries import queries
from loomgraph.llm.sql import oracle_sql

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " \t\n", "one", "one", "two words", LONG, "Straße ÉCOLE 日本語 \x00 word"]


def run(spark, name):
    return queries()[name](spark, DATA).collect()


# ---- decontamination

ITEM = "A train leaves the station in Berlin and travels 120 kilometers in 3 hours before Anna meets it there with 45 boxes of fruit."


def test_leaks_equal_brute_force(spark, small):
    got = {(r.doc_id, r.item_id, r.n_windows, r.matched, r.exact) for r in run(spark, "op2_decontaminate")}
    assert got == brute.leaks(small("documents", "doc_id", "text"), small("benchmark", "item_id", "text"))


def test_leaks_with_other_values(spark, docs):
    changed = ITEM.replace("Berlin", "Madrid").replace("120", "250").replace("Anna", "Olga").replace("45", "7")
    torn = "said x " + ITEM.replace("Anna", "Berlin")  # one value for two of the item's
    rows = docs([*ODD, "Intro words here. " + ITEM + " And more.", changed, torn, "A train leaves a depot and nothing else of it is here at all today."])
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "two words"), (None, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(rows, items).collect()}
    # 3 of the item's 17 windows have too few literal words.
    assert got[8, 1].exact and not got[9, 1].exact and got[8, 1].matched == got[9, 1].matched == 14
    assert {k for k in got if k[0] in (10, 11)} <= {(10, 1)} and (5, 4) in got and (3, None) in got and (4, None) in got
    assert {r.doc_id for r in decontaminate.without_leaks(rows, items).collect()} >= {0, 1, 2, 6, 7, 11}
    assert decontaminate.leaks(rows.limit(0), items).count() == decontaminate.leaks(rows, items.limit(0)).count() == 0


def test_large_benchmarks_are_shuffled(spark, small, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = {(r.doc_id, r.item_id, r.n_windows, r.matched, r.exact) for r in run(spark, "op2_decontaminate")}
    assert got == brute.leaks(small("documents", "doc_id", "text"), small("benchmark", "item_id", "text"))


def test_leaks_of_short_and_number_rich_items(spark, docs):
    short, sums, question = "What is the capital of France?", "Compute 12 + 7 * 3 - 4 and 9 / 2 + 5 * 8", "What is 15 + 27 ?"
    rows = docs([f"Some words before it. {t} And some more words after it, as texts have." for t in (short, sums, question)] + [sums, question, sums.replace("12", "13").replace("7", "6").replace("5", "1"), "What is 16 + 28 ?", "no item"])
    items = spark.createDataFrame([(1, short), (2, sums), (3, question)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(rows, items).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 2), (4, 3)} and all(r.exact and r.share == 1 for r in got.values())


def test_names_of_any_case_and_length(spark, docs):
    item = "A long letter from Mary to her friend in Berlin says that the old harbour there is closed for the winter."
    changed = [item.replace("Mary", a).replace("Berlin", b) for a, b in (("Mary Jane", "New York"), ("MARY", "BERLIN"), ("Ana María López", "SAN JOSÉ"), ("Mary", "mary"))]
    rows = docs([*changed, "they said " + item.upper(), item.replace("old", "new").replace("long", "short").replace("closed", "open").replace("friend", "sister").replace("winter", "summer")])
    got = {r.doc_id: r.exact for r in decontaminate.leaks(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {0, 1, 2} <= set(got) and not got[0] and got[1] and not got[2] and 5 not in got
    plain = "The water of the lake is cold in the spring and warm in the autumn of each year."
    assert [r.exact for r in decontaminate.leaks(docs(["they said " + plain.upper()]), spark.createDataFrame([(1, plain)], "item_id long, text string")).collect()] == [True]


def test_share_is_of_windows_that_can_match(spark, docs):
    item = "1 2 3 4 5 6 7 8 9 10 11 12 Anna bought apples with Olga at home"
    rows = docs(["20 21 22 23 24 25 26 27 28 29 30 31 Anna bought apples with Olga at home"])
    (got,) = decontaminate.leaks(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert got.matched < 6 and got.matched / got.n_windows < 0.5 and got.share == 1 and not got.exact


# ---- context mixing


def test_scores_and_base_scores(spark, small):
    texts = small("documents", "doc_id", "text")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*brute.words(t), ""] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = run(spark, "op3_context_mixing")
    assert len(got) == len(texts)
    for r in got:
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_class_probabilities_sum_to_one():
    counts = [(w.encode(), 50 - i) for i, w in enumerate("a b c d e f g".split())] + [(b"", 9)]
    head = context_mixing.Head(counts, 400, 30)
    tables = context_mixing.Tables(12)
    tables.learn(head.read([b"a b c a b c z"] * 30))
    mixer = context_mixing.Mixer(context_mixing.stretched(tables.plain), [context_mixing.stretched(t) for t in tables.counts], 12)
    batch = head.read([b""] * 256)
    batch.classes = np.arange(256).astype(np.uint8)
    assert np.sum(2.0 ** -mixer.class_bits(batch)) == pytest.approx(1, abs=1e-5)


def test_places_in_a_class_are_mixed():
    """A word's place in a shared class follows its context; its words' probabilities sum to one."""
    own = [(f"w{i}".encode(), 1000) for i in range(context_mixing.OWN)]
    words = [b"aaing", b"bbing", b"ccing", b"dding"]  # one class
    head = context_mixing.Head([*own, (b"", 500), *((w, 100) for w in words)], 200_000, 200)
    tables = context_mixing.Tables(16)
    tables.learn(head.read([b"w1 aaing", b"w2 bbing", b"w3 ccing", b"w4 dding"] * 100))
    mixer = context_mixing.Mixer(context_mixing.stretched(tables.plain), [context_mixing.stretched(t) for t in tables.counts], 16)
    cost = {w: mixer.class_bits(head.read([b"w1 " + w]))[0] for w in words}
    assert all(cost[w] > cost[b"aaing"] + 2 for w in words[1:])
    sums = [sum(2.0 ** -b for b in mixer._lanes(head.read([w for w in words]), np.arange(4) * 2, np.ones(4, int)))]
    one = mixer._lanes(batch := head.read([b"aaing"]), np.zeros(1, int), np.ones(1, int))[0]
    batch.numbers = np.full(2, len(head.number))  # its class alone
    assert sums[0] == pytest.approx(2.0 ** -mixer._lanes(batch, np.zeros(1, int), np.ones(1, int))[0], rel=1e-4) and one > 0


def test_nodes_of_four_bits_share_a_block():
    """So that they lie in few lines of the cache; nodes of one block have slots of their own."""
    code, contexts = np.arange(256).astype(np.uint64), [np.full(256, 77, np.uint64), np.full(256, 1 << 63, np.uint64)]
    for begin in (0, 4):
        steps = list(context_mixing.class_slots(code, contexts, 16))[begin : begin + 4]
        for t in range(2):
            slot = np.stack([own[t] for _, _, own in steps])
            assert (slot >> 4 == slot[0] >> 4).all() and slot.min() >= 0 and slot.max() < 1 << 16
            assert all(len(set(x)) == 4 for x in slot.T.tolist())
    assert all(len({(int(n), int(x)) for n, x in zip(node, own[0], strict=True)}) == len(set(node.tolist())) for node, _, own in context_mixing.class_slots(code, contexts, 16))


def whole_head():
    """Words with classes of their own, and others that share classes by fours to eighties, so that places have up to a dozen bits."""
    own = [(f"w{i}".encode(), 3000 - i) for i in range(context_mixing.OWN)]
    many = [(f"{i}{'abcd'[i % 4]}ing".encode(), 1 + 2000 // (i + 1)) for i in range(320)]
    return context_mixing.Head([*own, (context_mixing.END, 900), *many], 600_000, 700), [w for w, _ in own + many]


def texts_of_words(words, n, size, seed=7):
    rng = np.random.default_rng(seed)
    return [b" ".join([*(words[i] for i in np.minimum(rng.geometric(0.01, size), len(words)) - 1), b"unknown"]) for _ in range(n)]


def path(head, batch, i, bits):
    """(row of weights, node or None for a place, counts' ln odds or None, bit, slots) of each bit of token ``i``, bit by bit."""
    contexts = [c[i : i + 1] for c in batch.contexts]
    for d, (node, bit, at) in enumerate(context_mixing.class_slots(batch.classes[i : i + 1].astype(np.uint64), contexts, bits)):
        yield d, int(node[0]), None, int(bit[0]), [int(s[0]) for s in at]
    for d, (_, node, bit, _) in enumerate(head.places(batch.numbers[i : i + 1])):
        if d % context_mixing.NIBBLE == 0:
            salted, local = context_mixing.salted_place(node), 1
            blocks = [int(context_mixing.slots(c, salted, bits)[0]) for c in contexts]
        yield context_mixing.CLASS_BITS + d, None, float(head.odds[node[0]]), int(bit[0]), [b ^ local for b in blocks]
        local = 2 * local + int(bit[0])


def test_tables_and_bits_are_those_of_one_bit_at_a_time():
    """Counts and costs of all bits of whole texts, of more than a segment, against plain loops."""
    head, words = whole_head()
    texts = [*texts_of_words(words, 4, 300), b"", b"unknown", words[-1]]
    batch, bits = head.read(texts), 9
    tables = context_mixing.Tables(bits)
    tables.learn(batch, chunk=500)
    counts, plain = np.zeros((context_mixing.CONTEXTS, 2 << bits), int), np.zeros(512, int)
    for i in range(len(batch.numbers)):
        for _, node, _, bit, at in path(head, batch, i, bits):
            if node is not None:
                plain[2 * node + bit] += 1
            for t, slot in enumerate(at):
                counts[t, 2 * slot + bit] += 1
    assert (tables.counts == counts).all() and (tables.plain == plain).all() and head.length.max() > 8
    mixer = context_mixing.Mixer(context_mixing.stretched(tables.plain), [context_mixing.stretched(t) for t in tables.counts], bits)
    mixer.begin_from(head.read(texts_of_words(words, 3, 80, seed=8)))
    want = []
    for first, size in zip(batch.offsets[:-1], batch.sizes, strict=True):
        cost = 0.0
        for k in range(size):
            if k % context_mixing.SEGMENT == 0:
                weights, maps = mixer.weights.astype(float), mixer.maps.astype(float)
            for row, node, odds, bit, at in path(head, batch, first + k, bits):
                x = np.array([mixer.plain[node] if odds is None else odds, *(t[slot] for t, slot in zip(mixer.tables, at, strict=True))])
                own = weights[row, :, batch.gate[first + k]]
                total = float(np.clip(own @ x, -7.99, 7.99))
                p = 1 / (1 + math.exp(-total))
                own += context_mixing.RATE * (bit - p) * x
                low, high = divmod((total + 8) * (context_mixing.STEPS - 1) / 16, 1)
                knots = maps[row, int(low) : int(low) + 2]
                final = min(max((p + knots[0] + high * (knots[1] - knots[0])) / 2, 1e-5), 1 - 1e-5)
                knots += context_mixing.MAP_RATE * np.array([1 - high, high]) * (bit - knots)
                cost -= math.log2(final if bit else 1 - final)
        want.append(cost)
    assert mixer.class_bits(batch) == pytest.approx(want, rel=1e-4)


def test_work_of_counting_and_mixing(monkeypatch):
    """Bits are mixed all at once in a step, and repeats of a path are counted at once."""
    head, words = whole_head()
    calls, added = [], []

    class Add:
        def __getattr__(self, name):
            return getattr(np.add, name)

        def at(self, counts, where, times):
            added.append(len(where))
            np.add.at(counts, where, times)

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, *more, **named):
            calls.append(np.size(x))
            return np.exp(x, *more, **named)

    monkeypatch.setattr(context_mixing, "np", Numpy())
    text, tables, work = texts_of_words(words, 1, 100), context_mixing.Tables(12), []
    for copies in (10, 200):
        added.clear()
        tables.learn(head.read(text * copies))
        work.append(sum(added))
    assert work[0] == work[1]
    mixer = context_mixing.Mixer(context_mixing.stretched(tables.plain), [context_mixing.stretched(t) for t in tables.counts], 12)
    batch = head.read(text * 10)
    calls.clear()
    mixer.class_bits(batch)
    assert len(calls) == batch.sizes[0] and sum(calls) == (context_mixing.CLASS_BITS + head.length[batch.numbers]).sum()


def test_words_are_split_as_bytes_are():
    """Blanks at the ends and in rows, odd bytes, empty texts; A-Z alone are lower-cased."""
    texts = [b"", b" ", b"\t\x0b\x0c\r\n ", b" A  b\x1c\x85C \n", "Ünd ÄB\xa0c d".encode(), b"\xff\xfeX \x00", b"x" * 70_000 + b" y"]
    for some in (texts, texts[3:4], texts[:2], []):
        words, many = context_mixing.split(some)
        want = [t.lower().split() for t in some]
        assert words.to_pylist() == [w for t in want for w in t] and many.tolist() == [len(t) for t in want]


def test_word_counts_of_many_words(docs):
    """More distinct words than a task keeps, with repeats across what it has sent before."""
    texts = [" ".join(f"w{i}" for i in range(at, at + 350_000)) for at in (0, 200_000, 100_000)]
    rows = docs([*texts, None, "w1 W1"]).selectExpr("cast(coalesce(text, '') as binary) as text").coalesce(1)
    got = {bytes(r.word): r.c for r in context_mixing.word_counts(rows).toLocalIterator()}
    want = Counter(w.encode() for t in [*texts, "w1 w1"] for w in t.split())
    assert got == want | {b"": 5}


def test_scores_of_odd_rows(docs):
    rows = docs([*ODD, (None, "one")])
    got = {r.doc_id: r for r in context_mixing.score(rows, docs([(9, "one two"), (10, "one")]), bits=12).collect()}
    assert len(got) == 9 and got[0].n_tokens == got[2].n_tokens == 1 and got[0].bits_per_byte is None
    assert got[3].score == got[4].score == got[None].score and all(r.score < 0 for r in got.values())
    assert context_mixing.score(rows.limit(0), rows, bits=12).count() == 0
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in context_mixing.score(rows, rows.limit(0), bits=12).collect())


# ---- chat


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries()[name](spark, DATA).select(columns)
    assert sorted(want.fetchall(), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_turns_come_back(spark):
    r = random.Random(1)
    says = lambda: "".join(r.choice(["a", "\\", "<", "l", "</turn>\n", "<also>", " ", "é"]) for _ in range(r.randrange(6)))
    rows = [(c, t, r.choice(["user", "assistant", "as<\\"]), says()) for c in range(6) for t in range(150)]
    rows += [(7, 0, None, None), (None, 3, "user", "x"), (8, 1, "assistant", "same"), (8, 1, "assistant", "same"), (8, None, "user", "first"), (9, 0, "assistant", LONG)]
    got = chat.parse_conversations(chat.format_conversations(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, formatted long"))).collect()
    for g in got:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == g.conv_id))
        assert [tuple(x) for x in g.turns] == [x[1:] for x in own]
        assert g.loss_texts == [x[2] for x in own if x[1] == "assistant"]
    assert len(got) == 10 and chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- toxicity


def test_neighbours_are_those_of_a_full_scan():
    r = random.Random(2)
    examples = [(i, r.randrange(2), {t: r.randrange(1, 4) for t in r.sample(range(40), r.randrange(0, 6))}) for i in range(300)]
    index = toxicity.Index(np.array([r.uniform(0.5, 4) for _ in range(40)]), examples, k=9, block=16)
    vectors = {i: dict(zip(*(x.tolist() for x in index.vector(c)), strict=True)) for i, _, c in examples if c}
    for _ in range(60):
        query = {t: r.randrange(1, 3) for t in r.sample(range(40), 4)}
        own = dict(zip(*(x.tolist() for x in index.vector(query)), strict=True))
        want = sorted((round(sum(w * v.get(t, 0) for t, w in own.items()), 9) for v in vectors.values()), reverse=True)[:9]
        assert [s for s, _ in index.nearest(query)] == pytest.approx([w for w in want if w > 0], abs=2e-9)


def test_toxic_documents_are_told(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = [r for r in queries()["op5_toxicity"](spark, data).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = sum(r.predicted == labels[r.doc_id] for r in got) / len(got)
    assert right > 0.9, right


def test_toxicity_of_odd_rows(spark, docs):
    rows = docs([*ODD, *(f"vile{i % 3} vileword rude{i % 3}" for i in range(30)), *(f"kind{i % 3} gentle nice{i % 3}" for i in range(30)), (None, "vileword")])
    labels = spark.createDataFrame([(i, int(i < 38)) for i in range(8, 68)] + [(None, 1), (9, None), (9, 1), (0, 0), (999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.with_scores(rows, toxicity.learn(rows, labels)).collect()}
    assert len(got) == 69 and got[8].score > 0.9 > 0.1 > got[67].score and got[None].score > 0.5 and got[0].score == got[1].score and got[8].key == "k"
    none = toxicity.learn(rows, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.with_scores(rows, none).collect()) and toxicity.with_scores(rows.limit(0), none).count() == 0


# ---- secrets


def test_base_spans(spark, small):
    texts = small("documents", "doc_id", "text")
    for r in run(spark, "op8_secrets"):
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.said(want)) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert set(brute.said(want).split(",")) <= set(r.spans.split(","))


def test_formats_are_inferred(docs):
    r = random.Random(3)
    pick = lambda n, chars: "".join(r.choice(chars) for _ in range(n))
    rows = [f"password = tok_{pick(24, 'ABCDEFGH23456789')}" for _ in range(200)] + [f"see {pick(9, 'aeiou')}-{pick(9, 'xyz')}-2024-report" for _ in range(200)]
    bare, key = f"é tok_{pick(24, 'ABCDEFGH23456789')} end", "api_key: 'abc.def+ghi/jkl' PASSWD=short AKIA" + "Z9" * 8 + " " + "0f" * 20
    table = docs([*rows, *ODD, bare, key])
    got = {x.doc_id: x for x in secrets.find_secrets(table, secrets.learn_formats(table)).collect()}
    assert got[408].spans == "format:2:30" and got[408].n_assign == 0 and "format" not in got[200].spans
    assert got[409].spans.startswith("assign:0:25,access:40:60,hex:61:101") and got[400].spans == "" == got[401].spans
    assert secrets.find_secrets(table.limit(0), secrets.learn_formats(table.limit(0))).count() == 0


def test_all_runs_are_scored(docs):
    r = random.Random(5)
    pick = lambda n: "".join(r.choice("ABCDEFGHKLMNPQRS") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [f"password = tok_{pick(24)}" for _ in range(15)] + [f"see {'-'.join(r.sample(['monthly', 'summary', 'report', 'people', 'office'], 3))}-2024" for _ in range(200)]
    table = docs([*rows, f"x tok_{pick(24)} end", f"x {pick(28)} end", f"x tok_{pick(8)}{hexes(16)}{pick(8)} end"])
    runs = [[w for _, _, w in secrets.other_runs(t, secrets.base_spans(t))] for t in ("correct-horse-battery-staple", "q" * 16, "tok_AB" + "0f" * 8 + "CD", "0f" * 8)]
    assert runs == [["correct-horse-battery-staple"], ["q" * 16], ["tok_AB" + "0f" * 8 + "CD"], []]
    got = {x.doc_id: x.spans for x in secrets.find_secrets(table, secrets.learn_formats(table)).collect()}
    assert got[215] == "format:2:30" and not any("format" in got[i] for i in range(15, 215))


def test_dotted_and_long_strings(docs):
    r = random.Random(7)
    pick = lambda n: "".join(r.choice("ABCDEFGHKLMNPQRS23456789") for _ in range(n))
    long = ["ab." + pick(700) for _ in range(3)]
    rows = [f"token: key.{pick(8)}.{pick(8)}" for _ in range(60)] + [f"secret={x}" for x in long] + [f"see {'-'.join(r.sample(['monthly', 'summary', 'report', 'people', 'office'], 3))}.html" for _ in range(100)]
    table = docs([*rows, f"x key.{pick(8)}.{pick(8)}. Then more."])
    formats = secrets.learn_formats(table)
    assert max(map(len, (w for w in long))) == 703 and formats.evidence(long[0]) > formats.evidence(long[0][:100])
    got = {x.doc_id: x.spans for x in secrets.find_secrets(table, formats).collect()}
    assert got[163] == "format:2:23" and not any("format" in got[i] for i in range(63, 163))
    assert [w for _, _, w in secrets.other_runs("...abc.defgh.ijkl... q", [])] == ["abc.defgh.ijkl"]


def test_automata_of_very_long_strings():
    r = random.Random(8)
    words = ["".join(r.choice("0123456789abcdefXYZ") for _ in range(n)) for n in [24] * 300 + [60_000]]
    automaton = secrets.Automaton(words)
    assert len(automaton.states) < 60 and automaton.score(words[0]) > automaton.score("-" * 24)


def test_automata_merge_states():
    words = ["ab" * n for n in range(1, 9) for _ in range(40 >> n // 2)]
    automaton = secrets.Automaton(words)
    assert len(automaton.states) < 8 and automaton.score("abab") > automaton.score("aabb")


# ---- near duplicates


def near(rows, **k):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows, **k).collect()), key=str)


def test_groups_equal_brute_force(spark, small):
    want = brute.components(small("documents", "doc_id", "text"), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op10_near_dedup")} == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_edits(docs, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        own = [r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.choice([3, 12, 60, 150]))]
        for _ in range(8):  # each an edit of the one before: chains whose ends aren't alike
            texts.append(" ".join(own).upper() if r.random() < 0.3 else "\t".join(own))
            own = own[:]
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = "new" + str(r.randrange(99))
    rows = {i: t for i, t in enumerate(texts)}
    want = brute.components(rows, 5, 80)
    assert near(docs(list(rows.items()))) == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=str)


def test_groups_of_odd_rows(docs):
    got = near(docs([*ODD, (None, "one"), (None, "alone here"), (5, "two words"), (7, "five words that differ wholly")]))
    assert [x for x in got if x[0] in (0, 1, 2)] == [(i, 0, i, True) for i in range(3)]
    assert [x[2:] for x in got if x[0] in (3, 4)] == [(3, True), (3, False)] and [x for x in got if x[0] == 5] == [(5, 1, 5, True)] * 2
    assert sorted((x[2:] for x in got if x[0] == -1), key=str) == [(3, False), (None, True)]
    assert near(docs([])) == []


def test_texts_of_one_id_keep_their_links(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    got = near(docs([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "c d e f g h")]))
    assert [(i, c) for i, _, c, _ in got] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_hot_group_is_one_component(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 7)
    own = [f"w{i}" for i in range(80)]
    rows = [" ".join([*own[:i], f"x{i}", *own[i + 1 :]]) for i in range(80)] + [f"other {i} text of its own" for i in range(40)]
    got = near(docs([(i + 5, t) for i, t in enumerate(rows)]), shingle=3, num=85)
    want = brute.components({i + 5: t for i, t in enumerate(rows)}, 3, 85)
    assert [(i, c) for i, _, c, _ in sorted(got)] == [(i, c) for i, (_, c) in sorted(want.items())]


def test_members_meet_their_components_once(docs, monkeypatch):
    lefts, join = [], near_dedup.common.joined_by_hot_key
    monkeypatch.setattr(near_dedup.common, "joined_by_hot_key", lambda left, *a: lefts.append(left) or join(left, *a))
    own = [f"w{i}" for i in range(80)]
    near(docs([" ".join([*own[:i], f"x{i}", *own[i + 1 :]]) for i in range(9)]))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in lefts if x.columns == ["rep", "key", "n", "c"]]
    assert plans and not any("Join" in p for p in plans)  # rows that are kept, not a join that each reader makes anew


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    both, a, b = (r.integers(1, 1 << 62, n).astype(np.uint64) for n in (600, 200, 200))
    s = near_dedup.super_minhash([np.concatenate([both, a]), np.concatenate([both, b])], 240)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08
