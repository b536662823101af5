"""Each stage of the pipeline against brute force on what the stage before kept."""

import brute
import corpus_pipeline
from test_storage_operators import stored

from loomgraph.llm import common, toxicity
from loomgraph.llm.queries import TOXIC, toxicity_labels

DATA = "/root/testdata/sf0.001"


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, DATA, "documents")
    every = {r.doc_id: r.text for r in docs.collect()}

    def step(name, given):
        return common.written(stages[name](spark, given, DATA), common.new_folder(spark, "test"))

    kept = step("toxicity", docs)
    model = toxicity.learn(docs, toxicity_labels(spark, DATA))
    vocabulary = toxicity.Vocabulary(model.terms)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, t in every.items() if model.index.score(vocabulary.counts(t or ""))[0] < TOXIC} and 0.5 * len(every) < len(ids)
    one = step("near_dedup", kept)
    groups = brute.components({i: every[i] for i in ids}, 5, 80)
    ids = {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in one.collect()} == ids and one.columns == docs.columns
    clean = step("decontaminate", one)
    leaked = {r[0] for r in brute.leaks({i: every[i] for i in ids}, small("benchmark", "item_id", "text"))}
    assert {r.doc_id for r in clean.collect()} == ids - leaked and leaked
    mixed = step("mix", clean)
    rows = mixed.collect()
    assert mixed.columns == docs.columns and {r.doc_id for r in rows} <= ids - leaked and len(rows) > 0.3 * len(ids)
    last = sorted(map(tuple, stages["token_planes"](spark, mixed, DATA).collect()), key=lambda r: r[1])
    assert last == stored(sorted((r.doc_id, r.text) for r in rows))


LONG = "some long text of many words " * 20_000
ODD = [(1, "one text of its own here, twice the same row"), (1, "one text of its own here, twice the same row"), (2, None), (2, "second text under an id that is used again"), (3, ""), (4, LONG), (5, LONG), (6, "tie"), (7, "tie"), (None, "a row without an id"), (None, "a row without an id"), (None, "tie"), (None, None), (8, " \t")]


def test_odd_rows(spark):
    """Nulls, empty, long, tied and repeated rows, and columns of other names, through each stage."""
    docs = spark.createDataFrame([(i, t, None, None if i == 4 else "web", None, 0.5, 1, 2, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double, kept_id long, mix_hash long, words string")
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name in ("toxicity", "decontaminate"):
        out = stages[name](spark, docs, DATA)
        assert out.columns == columns and rows(out) == sorted(ODD, key=str), name
    out = stages["near_dedup"](spark, docs, DATA)
    assert out.columns == columns
    assert rows(out) == sorted([ODD[0], ODD[3], (3, ""), (4, LONG), (6, "tie"), (8, " \t"), (None, "a row without an id")], key=str)
    out = stages["mix"](spark, docs, DATA)
    assert out.columns == columns and set(rows(out)) <= set(ODD)
    last = sorted(map(tuple, stages["token_planes"](spark, docs, DATA).collect()), key=lambda r: r[1])
    assert last == stored(sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))


def test_no_documents(spark):
    docs = common.table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name


def test_drivers_freed_memory_goes_back(spark, tmp_path, monkeypatch):
    """After each table that is cut or written, the driver's JVM is told to, and can."""
    told = []
    real = common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: told.append(real(s)))
    assert common.cut(spark.range(3)).count() == common.written(spark.range(3), str(tmp_path / "t")).count() == 3
    assert told == [True, True]
