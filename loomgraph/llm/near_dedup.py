"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents of
equal sets form a class, whose least doc_id stands for it.  A class's signature
has ``slots`` values: each shingle draws a random permutation of the slots and
offers slot ``p[j]`` the value ``j + r``, of which a slot keeps the least; slots
that one rank has filled can't improve at a later rank, so a set stops as soon
as all of its slots are filled.

Classes that agree on a band of slots share a bucket.  In a bucket one member,
the hub, is compared with all others on full sets.  Where a bucket's remaining
members then lie in several components, pairs across components that may yet be
similar are found by their rarest shingles, which loses none, and compared too:
groups of any size cost neither all pairs nor a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.components import connected

MOST_SLOTS = 240
MISS = 1e-7
CACHE_WORDS = 150_000
#: Pairs of one text that meet in one key.
HUB_PAIRS = 2000
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


class Words(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        return self.setdefault(word, xxhash.xxh3_64_intdigest(word))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence where it is shorter; empty without words."""
    found = text.lower().split()  # bytes: A-Z, and white space is \x20 \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < k:
        h, k = np.append(h, np.uint64(len(h))), len(h) + 1
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mixed(out * GOLD + h[i : i + n])
    return np.unique(mixed(out))


def bands_for(similarity: float, slots: int = MOST_SLOTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most selective split that misses a pair at the threshold with a probability under ``miss``."""
    for rows in range(16, 0, -1):
        if (1 - similarity**rows) ** (slots // rows) <= miss:
            return slots // rows, rows
    return slots, 1


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m) as rank << 56 | value; ``sets`` mustn't be empty arrays."""
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    for j in range(m):
        u = mixed(elements + np.uint64(int(GOLD) * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((mixed(u ^ MIX2) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j:
            rows = np.arange(len(elements))
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        else:
            slot = k
        np.minimum.at(best, owner * m + slot, (u >> np.uint64(8)) | np.uint64(j << 56))
        open_docs = (best.reshape(-1, m) == np.iinfo(np.uint64).max).any(1)
        if not open_docs.any():
            break
        keep = open_docs[owner]
        if j == 0:
            elements, owner, k = elements[keep], owner[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
            rows = np.arange(len(elements))
            perm[rows, k] = 0
            perm[:, 0] = k
        elif keep.mean() < 0.8:
            elements, owner, perm = elements[keep], owner[keep], perm[keep]
    return best.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), np.uint64(b + 1), np.uint64)
        for i in range(rows):
            key = mixed(key * GOLD + signatures[:, b * rows + i])
        keys[:, b] = key
    return keys.view(np.int64)


def sign(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    m, words = bands * rows, Words()

    def signed(batches):
        common.release()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                sets, begin, size = [], at, 0
                while at < len(ids) and size < 60_000:
                    sets.append(shingle_set(texts[at].as_py(), shingle, words))
                    size += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(super_minhash(full, m), bands, rows).tolist() if full else [])
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin:at], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands"],
                )
        common.release()

    return docs.mapInArrow(signed, SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar enough: den * intersection >= num * union.

    ``texts`` is (cls, text).  The pairs of a ``v`` with more than ``HUB_PAIRS`` of them are
    dealt to several keys, and its text is copied to each of these.
    """
    words = Words()

    def compare(batches):
        hub, own = None, None
        for batch in batches:
            out = []
            texts_u, texts_v = batch.column("text_u"), batch.column("text_v")
            for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                if v != hub:
                    hub, own = v, shingle_set(texts_v[i].as_py(), shingle, words)
                other = shingle_set(texts_u[i].as_py(), shingle, words)
                common_ = len(np.intersect1d(own, other, assume_unique=True))
                if den * common_ >= num * (len(own) + len(other) - common_):
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
        common.release()

    parts = pairs.groupBy(F.col("v").alias("cls")).agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts"))
    hubs = texts.join(parts, "cls").select(F.col("cls").alias("v"), F.col("text").alias("text_v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    many = common.cut(parts.filter("parts > 1"))
    # Each of these holds HUB_PAIRS pairs, so its rows are few against those of the pairs; Spark picks the join by its size.
    dealt = pairs.join(many.withColumnRenamed("cls", "v"), "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    with_u = dealt.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u")), "u")
    return with_u.join(hubs.drop("parts"), ["v", "part"]).select("u", "v", "text_u", "text_v").mapInArrow(compare, "u long, v long")


def by_prefix(rest: DataFrame, texts: DataFrame, shingle: int, num: int, den: int, hot: DataFrame) -> DataFrame:
    """Pairs (u, v) that may still be linked, of ``rest`` (key, rep, n, c: component): members of
    different components in one bucket, of which one is outside of the bucket's largest component.

    Two similar sets share one of the rarest (1 - similarity) * n + 1 shingles of
    each, by frequency in ``rest``; shingles that occur once are shared by none.
    """
    words = Words()
    sized = rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    largest = sized.groupBy("key").agg(F.max(F.struct("size", "c")).alias("top")).select("key", F.col("top.c").alias("top"))
    outside = common.joined_by_hot_key(rest, largest, "key", hot).groupBy("rep").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.bool_or(F.col("c") != F.col("top")).alias("outside"))

    def explode(batches):
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            sets = [shingle_set(t, shingle, words) for t in batch.column("text").to_pylist()]
            n = [len(s) for s in sets]
            if n:
                names = ["rep", "c", "outside", "n"]
                columns = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n)) for k in names[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(np.array(n, np.int32), n)), pa.array(np.concatenate(sets).view(np.int64))], names=[*names, "token"])
        common.release()

    rows = texts.join(outside.select(F.col("rep").alias("cls"), "c", "outside"), "cls").select(F.col("cls").alias("rep"), "c", "outside", "text")
    tokens = common.written(rows.mapInArrow(explode, "rep long, c long, outside boolean, n int, token long"), common.new_folder(texts.sparkSession, "tokens"))
    common_ = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("rep")
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token"))
    prefix = tokens.join(common_, "token").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).select("rep", "c", "outside", "n", "token", (F.col("n") - F.col("rank")).alias("after"))
    prefix = common.cut(prefix)
    left = prefix.filter("outside").select(F.col("rep").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("after").alias("au"), "token")
    right = prefix.select(F.col("rep").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("after").alias("av"), "token")
    small, large = F.least("nu", "nv"), F.greatest("nu", "nv")
    # Behind the first shingle that a pair shares lie too few for the rest of what it must share: not this pair, or not its first.
    enough = (F.least("au", "av") + 1) * (num + den) >= (F.col("nu") + F.col("nv")) * num
    return left.join(right, "token").filter((F.col("cu") != F.col("cv")) & (small * den >= large * num) & enough).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def texts_of(classes: DataFrame, docs: DataFrame, several: DataFrame, shingle: int) -> DataFrame:
    """(cls, text): a text of each class of ``classes`` (cls, doc_id, fp1, fp2), from the rows of its doc_id.

    A row of an id with ``several`` texts is taken only if it has the class's set.
    """
    words = Words()

    def of_class(batches):
        for batch in batches:
            own = []
            for text, *fp in zip(*(batch.column(k).to_pylist() for k in ("text", "fp1", "fp2")), strict=True):
                own.append(np.frombuffer(xxhash.xxh3_128_digest(shingle_set(text, shingle, words).tobytes()), "<i8").tolist() == fp)
            yield batch.filter(pa.array(own, pa.bool_())).select(["cls", "text"])
        common.release()

    wanted = docs.join(classes, "doc_id")
    alone = wanted.join(several, "doc_id", "left_anti").select("cls", "text")
    picked = wanted.join(several, "doc_id", "left_semi").select("cls", "text", "fp1", "fp2").mapInArrow(of_class, "cls long, text binary")
    return alone.unionByName(picked).dropDuplicates(["cls"])


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with den * intersection >= num * union of their shingle sets are
    linked; component_id is the least doc_id that links reach.  A null or blank
    text has an empty set, links to nothing and is kept; a text of any length is
    compared whole.  Rows repeated in full share everything, ``kept`` too; rows of
    one doc_id and different texts are linked to each other, and each to what its own text
    is similar to.  A row of null doc_id takes part in no group as its least id; it is kept unless its
    set equals that of a row with an id.  An empty table gives no rows; other
    columns are not read.  A pair at the threshold goes unseen with a probability
    under ``MISS``; all that is seen is confirmed on full sets.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(num / den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    signed = common.written(sign(docs, shingle, bands, rows), common.new_folder(spark, "signed"))
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Rows of equal sets have equal bands.  The number of a class is stable once it is written.
    classes = known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    classes = common.written(classes.withColumn("cls", F.monotonically_increasing_id()), common.new_folder(spark, "classes"))
    print_ = F.struct("fp1", "fp2")
    several = common.cut(known.groupBy("doc_id").agg(F.min(print_).alias("a"), F.max(print_).alias("b")).filter("a != b").select("doc_id"))
    same_id = known.join(several, "doc_id", "left_semi").select("doc_id", "fp1", "fp2").distinct().join(classes.select("fp1", "fp2", "cls"), ["fp1", "fp2"])
    same_id = common.cut(same_id.join(same_id.groupBy("doc_id").agg(F.min("cls").alias("v")), "doc_id").select(F.col("cls").alias("u"), "v").filter("u != v"))
    spread = classes.select(F.col("cls").alias("rep"), "n", F.explode("bands").alias("key"))
    sizes = common.cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    hot = common.hot_keys(sizes, "key")
    members = common.written(common.joined_by_hot_key(spread, sizes, "key", hot), common.new_folder(spark, "members"))
    # A bucket's hub is its member with the largest buckets: near the middle of its group.
    ranks = members.groupBy("rep").agg(F.sum("size").alias("rank"), F.first("n").alias("n"))
    hubs = members.join(ranks.select("rep", "rank"), "rep").groupBy("key").agg(F.max(F.struct("rank", "rep", "n")).alias("hub")).select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("m"))
    members = common.written(common.joined_by_hot_key(members, hubs, "key", hot), common.new_folder(spark, "hubs"))
    wanted = classes.join(ranks.select(F.col("rep").alias("cls")), "cls", "left_semi").select("cls", "doc_id", "fp1", "fp2")
    texts = common.written(texts_of(wanted, docs, several, shingle), common.new_folder(spark, "texts"))
    close = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num  # noqa: E731  a necessary condition
    pairs = members.filter((F.col("rep") != F.col("hub")) & close(F.col("n"), F.col("m"))).select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    edges = common.cut(verified(common.cut(pairs), texts, shingle, num, den).unionByName(same_id))
    component = connected(edges)
    rest = members.filter("size > 2 AND rep != hub").select("key", "rep", "n").join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    rest = common.cut(rest)  # read three times below; the join would be made as often
    split = rest.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a != b").select("key")
    rest = common.cut(common.joined_by_hot_key(rest, split, "key", hot))
    pairs = common.cut(by_prefix(rest, texts, shingle, num, den, hot))
    found = common.cut(verified(pairs, texts, shingle, num, den))
    if not found.isEmpty():
        component = connected(edges.unionByName(found))
    component = common.cut(component.withColumnRenamed("node", "cls"))
    least = component.join(classes.select("cls", "doc_id"), "cls").groupBy("component").agg(F.min("doc_id").alias("least"))
    component = component.join(least, "component").select("cls", "least")
    groups = classes.select("cls", "fp1", "fp2", "doc_id").join(component, "cls", "left").select("fp1", "fp2", F.coalesce("least", "doc_id").alias("c"))
    out = signed.drop("bands").join(groups, ["fp1", "fp2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))
