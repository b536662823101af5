"""Benchmark decontamination by template windows, with DataFrame expressions only.

Numbers, units after numbers, and names (up to four words
that begin with a capital inside a sentence, in whatever case they go on) become
typed placeholders, a name being one; windows of template words are hashed and joined with those
of the benchmark items.  Matches of one item that lie on one diagonal (position
in the document less position in the item) are one occurrence; it counts if its
literal words agree and its slots are consistent: one value of the document for
one value of the item and the reverse.  So a question asked again with other
numbers or names is found, a mere sequence of placeholders isn't: windows with
few literal words match word for word only.  Items shorter than a window are
one window of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, LEAST_LITERALS = 8, 4
#: An occurrence leaks its item with so many matched windows (13 words), or this share of the item's.
LEAST_WINDOWS, LEAST_SHARE = 6, 0.5
#: Benchmark windows that are broadcast at most; beyond it Spark shuffles both sides.
BROADCAST_WINDOWS = 500_000
#: Bytes of their words that are broadcast at most.
BROADCAST_BYTES = 64 << 20
UNITS = "kilograms?|kilometers?|kilometres?|centimeters?|meters?|metres?|grams?|miles?|feet|foot|inches|inch|pounds?|ounces?|lit(?:er|re)s?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?|kg|km|cm|mm|mg|ml|lb|oz|mph|kmh|hz|usd|eur|Kilogramm|Gramm|Meilen?|Pfund|Unzen?|Stunden?|Minuten?|Sekunden?|Tagen?|Wochen?|Monaten?|Jahren?|Prozent|Grad|kilogrammes?|milles?|livres?|onces?|heures?|secondes?|jours?|semaines?|mois|ans?|ann[ée]es?|pour cent|degr[ée]s?|kilogramos?|gramos?|kil[óo]metros?|cent[íi]metros?|metros?|millas?|libras?|onzas?|litros?|horas?|minutos?|segundos?|d[íi]as?|semanas?|meses|mes|a[ñn]os?|d[óo]lares?|centavos?|por ciento|grados?"
MARK, JOIN = "\u0002", "\u0003"
#: One to four words that begin with a capital; not the beginning of a passage in capitals, whose words count as such.
NAME = r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}+)(?: (\p{Lu}\p{L}*))?+(?: (\p{Lu}\p{L}*))?+(?: (\p{Lu}\p{L}*))?+(?!\p{L}| \p{Lu}{2})"


def canonical(text: Column) -> Column:
    """A text as words with one space between them; a slot's word is the mark, its type, and its value."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARK}{JOIN}]", " ")
    text = F.regexp_replace(text, NAME, f"{MARK}a$1{JOIN}$2{JOIN}$3{JOIN}$4")
    text = F.regexp_replace(text, r"[$€£]?\p{Nd}+(?:[.,:/]\p{Nd}+)*(%?)", f" {MARK}n$0 ")
    text = F.regexp_replace(text, f"(?i)({MARK}n\\S+ +)({UNITS})\\b", f"$1{MARK}u$2")
    return F.trim(F.regexp_replace(F.lower(text), f"(?:[^\\p{{L}}\\p{{N}}\\p{{M}}{MARK}{JOIN}.%]|\\.(?!\\p{{Nd}}))+", " "))


def template(text: Column) -> Column:
    """Slots of a canonical text, or of one of its words, without their values."""
    return F.regexp_replace(text, f"{MARK}(.)[^ ]*", f"{MARK}$1")


def windows(rows: DataFrame, sizes: list[int], at: str, short: bool = False) -> DataFrame:
    """``rows`` (id, text) to (id, words, n_windows, ``at``, k, few, h): a row for each window of k template words
    for each k of ``sizes``; ``short``: of the whole text where it is shorter than the only size.

    ``few`` windows have under ``LEAST_LITERALS`` literal words (in shorter windows: any slot); their ``h`` is of the words too, slots' values
    included.  All of it is generated code, up to a join on ``h`` too as long as no lambda stands in between: so
    ``words`` is passed on by reference and never copied for each window.
    """
    rows = rows.withColumn("text", canonical(F.col("text"))).withColumn("template", template(F.col("text")))
    # A letter for each literal word, nothing for a slot.
    letters = F.regexp_replace(F.regexp_replace("template", f"{MARK}.", ""), "[^ ]+", "x")
    rows = rows.withColumns({"words": F.split("text", " "), "templates": F.split("template", " "), "letters": F.split(letters, " "), "size": F.when(F.length("text") > 0, F.size(F.split("text", " "))).otherwise(0)}).drop("text", "template")
    if len(sizes) == 1:
        k = F.least(F.lit(sizes[0]), F.col("size")) if short else F.lit(sizes[0])
        rows = rows.withColumn("k", k).withColumn("n_windows", F.when(F.col("size") > 0, F.greatest(F.col("size") - F.col("k") + 1, F.lit(0))).otherwise(0))
        rows = rows.select("*", F.explode(F.when(F.col("n_windows") > 0, F.sequence(F.lit(0), F.col("n_windows") - 1)).otherwise(F.array().cast("array<int>"))).alias(at))
    else:
        every = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") * len(sizes) - 1)).otherwise(F.array().cast("array<int>"))
        rows = rows.select("*", F.lit(0).alias("n_windows"), F.explode(every).alias("i"))
        rows = rows.withColumns({at: F.floor(F.col("i") / len(sizes)).cast("int"), "k": F.element_at(F.array(*map(F.lit, sizes)), F.col("i") % len(sizes) + 1)}).filter(F.col(at) + F.col("k") <= F.col("size")).drop("i")
    part = lambda name: F.slice(name, F.col(at) + 1, F.col("k"))
    few = F.length(F.array_join(part("letters"), "")) < F.least(F.lit(LEAST_LITERALS), F.col("k"))
    rows = rows.withColumn("few", few)
    return rows.withColumn("h", F.xxhash64(part("templates"), F.when(F.col("few"), part("words")))).drop("templates", "letters", "size")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) that it leaks:
    doc_id, item_id, n_windows (of the item), matched, share, exact (no slot differs).

    Windows with enough literal words count first, as a share of the item's windows
    of that sort; where they aren't enough, all windows that agree word for word
    count, as a share of all.  An item of fewer than ``n`` words is leaked by each
    text that has all of them in a row, so an item of one word by each text with
    that word.  A text of any length is cut into all of its windows; an item ties with
    another where both match, and each is a row.  Null and empty texts have no windows; repeated rows and equal items give
    one row for each pair of ids; rows of a null id pair under the null id; empty
    tables give no rows; other columns are not read.
    """
    items = windows(benchmark.select("item_id", "text"), [n], "item_at", short=True)
    items = items.withColumn("item_words", F.slice("words", F.col("item_at") + 1, F.col("k"))).withColumn("row", F.xxhash64("words")).drop("words").distinct()
    items = items.withColumn("able", F.sum((~F.col("few")).cast("int")).over(Window.partitionBy("item_id", "row"))).drop("row").distinct()
    size = items.agg(F.count(F.lit(1)), F.collect_set(F.when(F.col("k") < n, F.col("k"))), F.sum(F.length(F.array_join("item_words", " ")))).first()
    items = items.drop("k")
    found, own = windows(docs.select("doc_id", "text"), [*sorted(size[1]), n], "at").drop("n_windows", "few"), F.slice("words", F.col("at") + 1, F.col("k"))
    # The bounds are checked here; a larger benchmark is joined by a shuffle on the hash, with no more of the text than the window.
    if size[0] <= BROADCAST_WINDOWS and (size[2] or 0) <= BROADCAST_BYTES:
        items = F.broadcast(items)
    else:
        found, own = found.withColumn("words", own), F.col("words")
    found = found.join(items, "h")
    hit = F.struct("item_at", F.col("few").alias("few"), own.alias("doc"), F.col("item_words").alias("item"))
    found = found.select("doc_id", "item_id", "n_windows", "able", (F.col("at") - F.col("item_at")).alias("diagonal"), hit.alias("hit"))
    # An occurrence has at most the windows of its item.
    runs = found.groupBy("doc_id", "item_id", "diagonal").agg(F.first("n_windows").alias("n_windows"), F.first("able").alias("able"), F.collect_set("hit").alias("hits"))
    same = lambda a, b: (a == b) | (F.startswith(a, F.lit(MARK)) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)))
    runs = runs.withColumn("hits", F.filter("hits", lambda h: F.forall(F.zip_with(h["doc"], h["item"], same), lambda x: x) & (~h["few"] | (h["doc"] == h["item"])))).filter(F.size("hits") > 0)
    slots = lambda h: F.filter(F.zip_with(h["item"], h["doc"], lambda b, a: F.struct(b.alias("item"), a.alias("doc"))), lambda s: F.startswith(s["item"], F.lit(MARK)))
    rich, verbatim = F.filter("hits", lambda h: ~h["few"]), F.filter("hits", lambda h: h["doc"] == h["item"])
    ats = lambda hits: F.transform(hits, lambda h: h["item_at"])
    runs = runs.select("doc_id", "item_id", "n_windows", "able", ats(rich).alias("ats"), ats(verbatim).alias("verbatim"), F.array_distinct(F.flatten(F.transform(rich, slots))).alias("slots"))
    one_to_one = lambda k: F.size(F.array_distinct(F.transform("slots", lambda s: s[k]))) == F.size("slots")
    runs = runs.withColumn("ats", F.when(one_to_one("item") & one_to_one("doc"), F.col("ats")).otherwise(F.array().cast("array<int>")))
    distinct = lambda name: F.size(F.array_distinct(F.flatten(F.collect_set(name)))).cast("long").alias(name)
    pairs = runs.groupBy("doc_id", "item_id").agg(
        F.first("n_windows").cast("long").alias("n_windows"), F.first("able").alias("able"), distinct("ats"), distinct("verbatim"), F.bool_and(F.when(F.size("ats") > 0, F.forall("slots", lambda s: s["item"] == s["doc"]))).alias("exact")
    )
    leaked = lambda m, of: (F.col(m) >= LEAST_WINDOWS) | (F.col(m) >= F.greatest(F.lit(1), F.col(of)) * LEAST_SHARE)
    first = leaked("ats", "able")
    pick = lambda a, b: F.when(first, a).otherwise(b)
    matched, of = pick(F.col("ats"), F.col("verbatim")), pick(F.col("able"), F.col("n_windows"))
    return pairs.filter(first | leaked("verbatim", "n_windows")).select("doc_id", "item_id", "n_windows", matched.alias("matched"), (matched / of).alias("share"), pick(F.col("exact"), F.lit(True)).alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id leaks no item; all columns."""
    leaked = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col("leaked_id")), "left_anti")
