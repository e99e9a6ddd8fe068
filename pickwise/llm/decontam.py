"""Operator 10: benchmark decontamination by templates, DataFrame functions only.

A text becomes a sequence of words (runs of letters and digits). In its template, numbers,
units after a number, and names (a capitalised word inside a sentence) are replaced by
typed placeholders and everything else is lower-cased, so that a question asked again with
other values keeps its template. Windows of ``width`` template words of the documents meet
those of the benchmark by hash join; windows of the benchmark that are mostly placeholders
meet only documents that have the very same words there. Along each alignment of document and item, the values
in the slots must map one to one (the same value of the item always to the same value of
the document, and back); otherwise only its windows without slots count. A document leaks
an item when the windows that count cover enough of the item.

Only window hashes are joined. The benchmark's windows are broadcast when they are counted
to be few; else both sides are dealt by hash. Texts are looked at again only for matches
that have slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import small_join, stored

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# Fixed list: units that become a placeholder after a number.
UNITS = ("kg g mg lb lbs oz t km m cm mm mi mile miles ft feet inch inches l ml litre litres liter liters s sec secs second seconds min mins minute "
         "minutes h hr hrs hour hours day days week weeks month months year years dollar dollars usd euro euros eur pound pounds gbp cent cents "
         "percent pct degree degrees w kw v a hz khz mhz ghz kb mb gb tb").split()
LEAST_WORDS = 3
FEW_WINDOWS = 500_000
MOST_WIDTH = 64     # words of a window at most


def spoken(text: Column) -> Column:
    """Words separated by single blanks, names marked by a leading placeholder; null stays null."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;]\s)(?=\p{Lu}[\p{Ll}'’])", NAME)
    apart = F.regexp_replace(marked, rf"[^\p{{L}}\p{{Nd}}{NAME}]+|(?<=\p{{Nd}})(?=\p{{L}})", " ")
    return F.btrim(apart)


def template(words: Column) -> Column:
    """Placeholders and lower-cased words, aligned word by word with ``spoken``."""
    named = F.regexp_replace(words, rf"{NAME}[^ ]+", NAME)
    numbered = F.regexp_replace(named, r"(?<![^ ])\p{Nd}+(?![^ ])", NUMBER)
    measured = F.regexp_replace(numbered, rf"(?i)(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", UNIT)
    return F.lower(measured)


def plain(words: Column) -> Column:
    """Lower-cased words without placeholders, aligned word by word with ``spoken``."""
    return F.lower(F.translate(words, NAME, ""))


def _hashes(words: Column, width: Column | int) -> Column:
    """Hash of every window of a word array; none if it is shorter."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(width, F.slice(words, i + 1, width))))


def bench_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int, share: float, most: int) -> DataFrame:
    """(h, plain, item, item_id, ipos, width, need, need_like, raw, kinds, n_slots) of every window of every item with three words or more.

    ``item`` stands for id and words. Items shorter than ``width`` have one window, the whole
    item. ``need``: windows of the item that a document must match. ``plain``: windows mostly
    made of placeholders; they are hashed by their words and have no slots. ``need_like``: the
    same as ``need`` over the other windows alone, which match with other values too."""
    base = benchmark.select(F.col(id_col).alias("item_id"), spoken(F.col(text_col)).alias("said")).where(F.length("said") > 0).distinct()
    arrays = base.select("item_id", F.xxhash64("item_id", "said").alias("item"), F.split("said", " ").alias("raw"),
                         F.split(template(F.col("said")), " ").alias("t"), F.split(plain(F.col("said")), " ").alias("p")).where(F.size("raw") >= LEAST_WORDS)
    sized = arrays.withColumn("width", F.least(F.size("raw"), F.lit(width)))

    def like(part: Column) -> Column:
        return F.size(F.filter(part, lambda x: ~x.isin(NAME, NUMBER, UNIT))) * 2 >= F.col("width")

    def needed(windows: Column) -> Column:
        return F.least(F.lit(most), F.ceil(windows * share)).cast("int")

    total = F.size("raw") - F.col("width") + 1
    likes = F.size(F.filter(F.sequence(F.lit(0), total - 1), lambda i: like(F.slice("t", i + 1, F.col("width")))))
    windows = sized.select(
        "item", "item_id", "width", "raw", "t", needed(total).alias("need"), needed(likes).alias("need_like"),
        F.posexplode(F.arrays_zip(_hashes(F.col("t"), F.col("width")).alias("ht"), _hashes(F.col("p"), F.col("width")).alias("hp"))).alias("ipos", "h"))
    part = F.slice("t", F.col("ipos") + 1, F.col("width"))
    kinds = F.transform(part, lambda x: F.when(x.isin(NAME, NUMBER, UNIT), x))
    return windows.select(
        F.when(like(part), F.col("h.ht")).otherwise(F.col("h.hp")).alias("h"), (~like(part)).alias("plain"), "item", "item_id", "ipos", "width", "need", "need_like",
        F.slice("raw", F.col("ipos") + 1, F.col("width")).alias("raw"), kinds.alias("kinds"),
        F.when(like(part), F.size(F.filter(kinds, lambda x: x.isNotNull()))).otherwise(0).alias("n_slots"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", width: int = 7, share: float = 0.4, most: int = 6) -> DataFrame:
    """(doc id, item_id, n_windows, n_slots, n_changed): one row per document and item that it leaks.

    n_windows: distinct windows of the item matched along consistent alignments; at least
    ``min(most, ceil(share * windows of the item))``, or as many of the windows that are not
    mostly placeholders, counted over these alone. Windows that are match by their very words
    and count as windows without slots. n_slots, n_changed: distinct slot values
    there, and those that the document states differently. Null or empty texts and items, and
    items of fewer than three words, match nothing. Repeated rows give one result; rows that
    share an id are one document. Null ids are kept as an id of their own."""
    if not 0 < width <= MOST_WIDTH:
        raise ValueError(f"width must be 1 to {MOST_WIDTH}")
    bench = stored(bench_windows(benchmark, item_col, item_text_col, width, share, most), "bench")
    shapes = sorted((r["plain"], r["width"]) for r in bench.select("plain", "width").distinct().collect()) or [(False, width)]  # at most 2 * ``width``
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.col(text_col), F.col(id_col)).alias("k2"))
    words = {as_is: keyed.select("doc_id", "k1", "k2", F.split((plain if as_is else template)(spoken(F.col("text"))), " ").alias("t")) for as_is in (False, True)}
    for_shape = [words[as_is].select("doc_id", "k1", "k2", F.lit(w).alias("width"), F.lit(as_is).alias("plain"), F.posexplode(_hashes(F.col("t"), w)).alias("pos", "h"))
                 for as_is, w in shapes]
    windows = for_shape[0]
    for more in for_shape[1:]:
        windows = windows.unionByName(more)
    slim = bench.select("h", "width", "plain", "item", "item_id", "ipos", "n_slots", "need", "need_like")
    if bench.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        slim = F.broadcast(slim)
    hits = stored(windows.join(slim, ["h", "width", "plain"]).select(
        "doc_id", "k1", "k2", "pos", "item", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("line"), "n_slots", "need", "need_like", "plain"), "hits")
    lined = ["k1", "k2", "item", "line"]
    judged = _slot_pairs(keyed, hits, bench).groupBy(*lined).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("kind", "asked").alias("from"), F.count_distinct("kind", "stated").alias("to"),
        F.count_if(F.col("asked") != F.col("stated")).alias("changed"))
    consistent = F.coalesce((F.col("pairs") == F.col("from")) & (F.col("pairs") == F.col("to")), F.lit(True))
    per_text = (hits.join(judged, lined, "left").where(consistent | (F.col("n_slots") == 0)).groupBy("k1", "k2", "item")
                .agg(F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"), F.max("need").alias("need"), F.max("need_like").alias("need_like"),
                     F.count_distinct("ipos").alias("n_windows"), F.count_distinct(F.when(~F.col("plain"), F.col("ipos"))).alias("n_like"), F.coalesce(F.max("pairs"), F.lit(0)).alias("n_slots"),
                     F.coalesce(F.max("changed"), F.lit(0)).alias("n_changed")))
    enough = (F.col("n_windows") >= F.col("need")) | ((F.col("n_like") >= F.col("need_like")) & (F.col("n_like") > 0))
    return (per_text.where(enough).groupBy("doc_id", "item_id")
            .agg(F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))
            .withColumnRenamed("doc_id", id_col))


def _slot_pairs(keyed: DataFrame, hits: DataFrame, bench: DataFrame) -> DataFrame:
    """Distinct (doc, item, line, kind, asked, stated) of the matches that have slots."""
    slotted = hits.where("n_slots > 0").select("k1", "k2", "pos", "item", "ipos", "line").distinct()
    places = stored(slotted.groupBy("k1", "k2").agg(F.collect_set("pos").alias("places")), "places")
    texts = small_join(keyed.select("k1", "k2", "text"), places, ["k1", "k2"])
    words = texts.select("k1", "k2", F.split(spoken(F.col("text")), " ").alias("raw"), "places")
    found = words.select("k1", "k2", F.explode(F.transform(
        "places", lambda p: F.struct(p.alias("pos"), F.slice(F.col("raw"), p + 1, F.lit(MOST_WIDTH)).alias("stated")))).alias("x"))
    seen = found.select("k1", "k2", "x.pos", "x.stated").dropDuplicates(["k1", "k2", "pos"])
    asked = bench.where("n_slots > 0").select("item", "ipos", F.col("raw").alias("asked"), "kinds")
    both = slotted.join(seen, ["k1", "k2", "pos"]).join(asked, ["item", "ipos"])
    slots = both.select("k1", "k2", "item", "line", F.explode(F.arrays_zip("kinds", "asked", "stated")).alias("s"))
    return slots.where(F.col("s.kinds").isNotNull()).select(
        "k1", "k2", "item", "line", F.col("s.kinds").alias("kind"), F.lower("s.asked").alias("asked"), F.lower("s.stated").alias("stated")).distinct()
