"""Benchmark decontamination by template canonicalisation, by DataFrame operations only.

Tokens are lower-cased words without punctuation at their edges. Numbers, units of measure and names (words with a capital
that neither begin a sentence nor are all capitals) become typed placeholders, so that a question with other parameters has the same templates.
A window also matches word for word, lower-cased, so that a copy in other letter case, whose names can't be told, is met.
Windows of n template tokens of the items (an item of fewer tokens is one window) are hash-joined with those of the
documents. Each window has an anchor, its rarest token; only documents whose words hold the anchors of as many windows
of an item as it takes have their templates made at all, which loses none; a window none of whose words has a letter or digit has a symbol for its anchor. Matches on one alignment of an item with a document count together, if they are slot-consistent: the values behind
an item's placeholder are the same wherever that value occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidetrace.llm.common import prepare, small_or_shuffled, text_or_empty

NUMBER, NAME, UNIT = "⟨num⟩", "⟨name⟩", "⟨unit⟩"
#: Units and currencies, singular and plural. Fixed values.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "% percent $ € £ usd eur gbp dollar dollars euro euros cent cents kmh mph hz khz mhz ghz kb mb gb tb w kw v degrees celsius fahrenheit"
).split()
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#&~_-–—“”‘’«»…¿¡"
_ENDS = "[.!?:;…|\n\r]"
#: A word, or a break between lines or cells, after which a sentence begins.
_TOKEN, _SPACE = r"[^ \t\n\x0B\f\r|]+|[\n\r|][ \t\n\x0B\f\r|]*", " \t\n\x0b\f\r"
_NO_WORD, _WORD = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]"


def template(text: Column) -> Column:
    """Array of (raw: the word without edge punctuation, lower-cased; form: the template token), without words that are all punctuation.

    Each array is bound to a lambda variable once; named twice as a column, it would be computed for every word.
    """

    def form(t: Column) -> Column:
        bare, low = t["bare"], t["low"]
        return (
            F.when(bare.rlike(r"^[+-]?[$€£]?\d[\d.,/:]*[%$€£]?$"), NUMBER)
            .when(low.isin(UNITS), UNIT)
            .when((low != bare) & (F.upper(bare) != bare) & ~t["starts"], NAME)
            .otherwise(low)
        )

    def one(w: Column, before: Column) -> Column:
        bare = F.btrim(w, F.lit(PUNCTUATION + _SPACE))
        return F.struct(bare.alias("bare"), F.lower(bare).alias("low"), before.rlike(_ENDS + "\\W*$").alias("starts"))

    words = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    found = F.transform(F.array(words), lambda ws: F.zip_with(ws, F.concat(F.array(F.lit(".")), ws), lambda w, before: F.when(w.isNotNull(), one(w, before))))[0]
    kept = F.filter(found, lambda t: t.isNotNull() & (t["low"] != ""))
    return F.transform(kept, lambda t: F.struct(t["low"].alias("raw"), form(t).alias("form")))


def windows(items: DataFrame, n: int) -> DataFrame:
    """Rows (item_id, at, size, hash, anchor, offset, raw, n_windows) of the items' windows; those of placeholders alone are left out."""
    t = items.where("item_id is not null").select("item_id", template(text_or_empty("text")).alias("t")).where("size(t) > 0")
    size = F.least(F.size("t"), F.lit(n))
    w = t.select("item_id", "t", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("t") - size)).alias("at"))
    w = w.select("item_id", "at", F.slice("t", F.col("at") + 1, F.col("size")).alias("t")).select("item_id", "at", "t.raw", "t.form")
    w = w.where(F.exists("form", lambda x: ~x.isin(NUMBER, NAME, UNIT))).distinct()
    words = w.select("item_id", F.explode("form").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df"))
    each = w.select("item_id", "at", "raw", "form", F.posexplode("form").alias("offset", "word")).where(~F.col("word").isin(NUMBER, NAME, UNIT)).join(words, "word")
    best = each.groupBy("item_id", "at", "raw", "form").agg(F.min(F.struct((~F.col("word").rlike(_WORD)).alias("symbol"), "df", (-F.length("word")).alias("l"), "word", "offset")).alias("b"))
    count = Window.partitionBy("item_id")
    return best.select("item_id", "at", F.size("form").alias("size"), F.xxhash64(F.size("form"), F.array_join("form", " ")).alias("hash"), F.col("b.word").alias("anchor"), F.col("b.offset").alias("offset"), "raw", "form", F.count("*").over(count).alias("n_windows"))


def suspects(docs: DataFrame, w: DataFrame, coverage: float) -> DataFrame:
    """Rows (doc_id) of documents that may hold an item: the anchors of enough of its windows are among their words.

    A shared window shares its anchor, so a document that holds ``coverage`` of an item's windows holds anchors that stand
    for as many. Words are cut at everything but letters and digits here, which splits no part of an anchor's key. A symbol's key is the whole anchor, met by words cut as templates are.
    """
    parts = F.filter(F.split("anchor", _NO_WORD), lambda x: x != "")
    longest = F.get(F.array_sort(parts, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)
    keys = w.select("item_id", "n_windows", F.coalesce(longest, F.col("anchor")).alias("word"))
    keys = keys.groupBy("item_id", "n_windows", "word").agg(F.count("*").alias("stands_for"))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(text_or_empty("text")), F.lit(_WORD + "+"), F.lit(0))).alias("word"))
    if not keys.where(~F.col("word").rlike(_WORD)).isEmpty():
        bare = F.transform(F.regexp_extract_all(F.lower(text_or_empty("text")), F.lit(_TOKEN), F.lit(0)), lambda x: F.btrim(x, F.lit(PUNCTUATION + _SPACE)))
        words = words.union(docs.select("doc_id", F.explode(F.filter(bare, lambda x: (x != "") & ~x.rlike(_WORD))).alias("word")))
    hit = words.join(small_or_shuffled(keys, 200_000), "word").groupBy("doc_id", "item_id", "word").agg(F.max("stands_for").alias("n"), F.max("n_windows").alias("n_windows"))
    return hit.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"), F.max("n_windows").alias("n_windows")).where(F.col("n") >= F.col("n_windows") * coverage).select("doc_id").distinct()


def matches(docs: DataFrame, items: DataFrame, n: int, coverage: float) -> DataFrame:
    """Rows (doc_id, item_id, shift, at, n_windows, pairs) of windows that documents and items share."""
    w = windows(items, n).checkpoint()
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    d = docs.join(small_or_shuffled(suspects(docs, w, coverage).checkpoint()), "doc_id", "left_semi").select("doc_id", template(text_or_empty("text")).alias("t"))
    # a document's words are cut row by row, so no row holds all its windows
    sizes = [r[0] for r in w.select("size").distinct().orderBy("size").collect()]  # n values at most
    sized = d.select("doc_id", "t", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where("size(t) >= size")
    starts = sized.select("doc_id", "t", "size", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("start"))
    cut = starts.select("doc_id", "start", F.slice("t", F.col("start") + 1, F.col("size")).alias("c")).select("doc_id", "start", F.col("c.raw").alias("d_raw"), F.col("c.form").alias("d_form"))
    # by the template and by the words themselves; where the two are one, once
    cut = cut.select("*", F.explode(F.array_distinct(F.array(F.xxhash64(F.size("d_form"), F.array_join("d_form", " ")), F.xxhash64(F.size("d_raw"), F.array_join("d_raw", " "))))).alias("hash"))
    keyed = w.select(*(c for c in w.columns if c != "hash"), F.explode(F.array_distinct(F.array("hash", F.xxhash64(F.size("raw"), F.array_join("raw", " "))))).alias("hash"))
    both = cut.join(small_or_shuffled(keyed, 50_000), "hash").where("d_form = form or d_raw = raw")
    slots = F.filter(F.transform(F.sequence(F.lit(1), F.size("form")), lambda i: F.when(F.element_at("form", i).isin(NUMBER, NAME, UNIT), F.struct((F.col("at") + i).alias("slot"), F.element_at("raw", i).alias("item"), F.element_at("d_raw", i).alias("doc")))), lambda x: x.isNotNull())
    return both.select("doc_id", "item_id", (F.col("start") - F.col("at")).alias("shift"), "at", "n_windows", slots.alias("pairs"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 8, coverage: float = 0.5) -> DataFrame:
    """Rows (doc_id, item_id, n_matched, n_windows, n_slots, n_changed) of documents that hold an item.

    An alignment counts if it is slot-consistent and holds at least ``coverage`` of the item's windows (one at least);
    the best alignment is reported: its windows, its distinct slots, and those of them whose value differs from the item's.
    Rows without id are left out; null or empty texts hold nothing and empty items are held by nothing; repeated rows
    count once. Other columns are not read.
    """
    prepare(docs.sparkSession)
    m = matches(docs, items, n, coverage)
    found = m.groupBy("doc_id", "item_id", "shift").agg(F.countDistinct("at").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    mapped = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["item"], p["doc"])))
    consistent = found.where((F.size(values) == F.size(mapped)) & (F.col("n_matched") >= F.greatest(F.lit(1), F.ceil(F.col("n_windows") * coverage))))
    slots = F.size("pairs").cast("long")
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])).cast("long")
    best = consistent.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-changed).alias("c"), "n_windows", slots.alias("n_slots"), changed.alias("n_changed"))).alias("b"))
    return best.select("doc_id", "item_id", "b.n_matched", "b.n_windows", "b.n_slots", "b.n_changed")
