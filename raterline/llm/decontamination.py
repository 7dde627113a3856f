"""Benchmark decontamination over a distributed positional inverted index.

Only DataFrame functions run here.  The steps:

1. The index is stored: the postings (term, document, position) of every word that the
   benchmark uses.  This is the only pass that splits texts to find matches; frequencies come
   from the stored lists.
2. Every window of an item (`window` consecutive words, or the whole of a shorter item) takes
   the two of its words whose lists are shortest.
3. Each posting of those is shifted by the term's place in the item.  Shifted lists of one
   window meet where item and document line up, so few alignments survive.
4. The lists of the window's other words are met at the places where an alignment needs them,
   within the documents that have one.  A window whose words are all met is a phrase match.

Windows, alignments and met words are rows throughout, so the work grows with the words of an
item, not with their square.

`proximity_matches` asks the same index for all words of a query within a span of words.

Item words, being a test set, are small next to the corpus; they are broadcast while their
number is at most `BROADCAST_TERMS`, and joined by shuffle beyond it.  All corpus-sized
results are keyed by document and position, so that a passage shared by a third of all
documents is spread over as many keys as there are documents.

Defined cases: null texts have no words; items without words are left out; rows of the
benchmark that share an item_id are one item with the windows of both, as are those without
item_id, which count among the items and give no name; repeated documents are each answered; empty tables give empty results or no hits; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import keyed, written

BROADCAST_TERMS = 200_000
#: What parts words: ASCII but for digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Lower-case words: runs of a-z, 0-9 and everything beyond ASCII.

    Only A-Z are made small.  In a text of ASCII alone that is lower(), which is much faster.
    """
    text = F.coalesce(text, F.lit(""))
    small_letters = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(small_letters, BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item (a hash of id and text), item_id, words, and the length of its windows."""
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text").cast("string")).alias("words"))
    return items.where(F.size("words") > 0).dropDuplicates(["item"]).withColumn("length", F.least(F.lit(window), F.size("words")))


def small(df: DataFrame, n: int) -> DataFrame:
    """Marked for broadcast if its n rows are within bounds, else left to a shuffle join."""
    return F.broadcast(df) if n <= BROADCAST_TERMS else df


def tokens(docs: DataFrame) -> DataFrame:
    """(key, pos, term) of every word; docs as keyed() gives them."""
    return docs.select("key", F.posexplode(word_array(F.col("text"))).alias("pos", "term"))


@dataclass
class Index:
    """terms: term, t (its number); postings: t, key, pos; n_terms: rows of terms, or more where terms are long."""

    terms: DataFrame
    postings: DataFrame
    n_terms: int


def build_index(docs: DataFrame, texts: DataFrame) -> Index:
    """Store the postings of all words of `texts` (words: array) in docs, as keyed() gives them."""
    terms = written(texts.select(F.explode("words").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    # A term of over 64 bytes counts as several.
    n = terms.agg(F.sum(F.ceil(F.octet_length("term") / 64))).head()[0] or 0
    return Index(terms, written(tokens(docs).join(small(terms, n), "term").select("t", "key", "pos"), "postings"), n)


def rare_pairs(index: Index, items: DataFrame, places: DataFrame, n_places: int) -> tuple[DataFrame, DataFrame]:
    """Which places of each item to look up first.

    places: item, place, t.  Returns (item, a, b, start), one row per window with the places of
    its two rarest words, a < b (both the one, if it has one word); and (item, a, b, place, part,
    t), the ends of each such pair: part is 1 for a, 2 for b and 3 for both.  Windows with a word
    that no document has are left out.  Rows grow with the words of an item, whatever its length.
    """
    counted = written(index.postings.groupBy("t").agg(F.count("*").alias("n")), "term-counts")
    spans = items.select("item", "length", (F.size("words") - F.col("length")).alias("last"))
    known = places.join(small(counted, index.n_terms), "t").join(spans, "item")
    # A word at place p stands in the windows that start from p - length + 1 to p.
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("length") + 1), F.least("place", "last"))
    rare = (
        known.select("item", "length", "place", "n", F.explode(starts).alias("start"))
        .groupBy("item", "length", "start").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("words"))
        .where(F.size("words") == F.col("length"))
    )
    first, second = F.col("words")[0]["place"], F.coalesce(F.get("words", F.lit(1))["place"], F.col("words")[0]["place"])
    windows = written(rare.select("item", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "start"), "rare-pairs")
    end = lambda place, part: F.struct(place.alias("place"), F.lit(part).alias("part"))
    ends = F.when(F.col("a") == F.col("b"), F.array(end(F.col("a"), 3))).otherwise(F.array(end(F.col("a"), 1), end(F.col("b"), 2)))
    return windows, windows.select("item", "a", "b").distinct().select("item", "a", "b", F.inline(ends)).join(places, ["item", "place"])


def alignments(index: Index, items: DataFrame, places: DataFrame, n_places: int) -> DataFrame:
    """(key, item, shift, start): windows whose rarest words meet where item and document line up.

    shift: the document position that the item's first word would have.
    """
    windows, ends = rare_pairs(index, items, places, n_places)
    shifted = index.postings.join(small(ends, 2 * n_places), "t").select("key", "item", "a", "b", (F.col("pos") - F.col("place")).alias("shift"), "part")
    met = shifted.groupBy("key", "item", "a", "b", "shift").agg(F.bit_or("part").alias("met")).where("met = 3")
    return met.join(small(windows, n_places), ["item", "a", "b"]).select("key", "item", "shift", "start")


def phrase_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """(key, item_id, at, length): every window of an item that stands at word `at` of a document; docs as keyed() gives them."""
    items = item_windows(benchmark, window)
    index = build_index(docs, items)
    places = written(items.select("item", F.posexplode("words").alias("place", "term")).join(small(index.terms, index.n_terms), "term").select("item", "place", "t"), "item-places")
    n_places = places.count()
    lengths = items.select("item", "length", "item_id")
    found = written(alignments(index, items, places, n_places), "alignments")
    # Each word that a window needs is looked up once, however many windows need it.
    wanted = found.join(small(lengths, n_places), "item").select("key", "item", "shift", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    cells = wanted.join(small(places, n_places), ["item", "place"]).withColumn("pos", F.col("shift") + F.col("place"))
    keys = found.select("key").distinct()
    lists = index.postings.join(small(keys, keys.count()), "key", "left_semi").distinct()
    met = cells.join(lists, ["key", "pos", "t"]).select("key", "item", "shift", "place").join(small(lengths, n_places), "item")
    # A window stands there if all its places are met; each of them counts for the windows it is in.
    starts = F.sequence(F.col("place") - F.col("length") + 1, F.col("place"))
    full = met.select("key", "item", "item_id", "shift", "length", F.explode(starts).alias("start")).groupBy("key", "item", "item_id", "shift", "length", "start").agg(F.count("*").alias("n")).where("n = length")
    return full.select("key", "item_id", (F.col("shift") + F.col("start")).alias("at"), "length")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Every row of docs as keyed() gives them, with n_words and `hits`.

    hits: array<struct<item_id, at, length>>, one entry for each window of an item that stands
    at word `at` of the document; empty if none does.
    """
    per_doc = phrase_hits(docs, benchmark, window=window).groupBy("key").agg(F.collect_set(F.struct("item_id", "at", "length")).alias("hits"))
    counted = docs.select("key", "doc_id", F.size(word_array(F.col("text"))).alias("n_words"))
    return counted.join(per_doc, "key", "left").withColumn("hits", F.coalesce("hits", F.array().cast(per_doc.schema["hits"].dataType)))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Per document: words, hit words, items found, and whether it is contaminated."""
    own = keyed(docs)
    hits = written(phrase_hits(own, benchmark, window=window), "hits")
    covered = hits.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    # Items without id are one, of which no name is listed.
    named = hits.select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("names"))
    counted = own.select("key", "doc_id", F.size(word_array(F.col("text"))).cast("long").alias("n_words")).join(covered.join(named, "key"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    names = F.concat_ws(",", F.coalesce("names", F.array().cast("array<string>")))
    return counted.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    hit = phrase_hits(keyed(docs), benchmark, window=window).select("key").distinct()
    return docs.join(hit, F.xxhash64(docs["doc_id"], docs["text"]) == hit["key"], "left_anti")


def proximity_matches(docs: DataFrame, queries: DataFrame, *, span: int = 10) -> DataFrame:
    """Documents that hold all words of a query within `span` words, in any order.

    queries: query_id and text.  Returns query_id, doc_id and the first place where they do.
    """
    asked = queries.select("query_id", F.array_distinct(word_array(F.col("text").cast("string"))).alias("words")).where(F.size("words") > 0)
    own = keyed(docs)
    index = build_index(own, asked)
    terms = written(asked.select("query_id", F.size("words").alias("wanted"), F.explode("words").alias("term")).join(small(index.terms, index.n_terms), "term").select("query_id", "wanted", "t"), "asked")
    found = written(index.postings.join(small(terms, terms.count()), "t").distinct(), "asked-postings")
    # Only documents that hold every word of a query are looked at more closely.
    full = found.groupBy("query_id", "key", "wanted").agg(F.count_distinct("t").alias("n")).where("n = wanted").select("query_id", "key")
    near = F.size(F.expr(f"collect_set(t) over (partition by query_id, key order by pos range between current row and {int(span) - 1} following)"))
    first = found.join(full, ["query_id", "key"]).withColumn("near", near).where("near = wanted").groupBy("query_id", "key").agg(F.min("pos").alias("at"))
    return first.join(own.select("key", "doc_id").distinct(), "key").select("query_id", "doc_id", "at")
