"""Test items inside documents, found with a positional inverted index.

The index stores one posting (term, document, position) for every term of a document that some test
item has too; a term is a run of ``gram`` words, as in a next-word index, since single words of a
small vocabulary have lists as long as the corpus. Lookups start from the rarest term of each run of
``least`` words of an item: its postings give the alignments (document, item, shift) worth looking
at. The lists of the other terms of those runs, moved by the shift, are then intersected with the
index, and an alignment counts if all terms of ``least`` consecutive words agree.

Defined results: NULL and empty texts have no words; texts and items shorter than ``least`` words match
nothing; repeated rows change nothing (ids are taken to be unique, so rows of one id are read position
by position as one text); results are distinct; empty tables give no rows; extra columns are never read.
Terms are kept as 64-bit hashes: for a wrong match a run of ``least`` words would have to contain a
colliding one at the right place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formquarry.llm.text import joined_words
from formquarry.session import bounded, stored

#: Test items are broadcast up to so many words; beyond, all joins shuffle.
BROADCAST_WORDS = 2_000_000


def positions(df: DataFrame, id_col: str, text_col: str, least: int = 1, gram: int = 1) -> DataFrame:
    """(id, pos, term) of each run of ``gram`` words; texts of fewer than ``least`` words are left out."""
    return grams(word_lists(df, id_col, text_col), least, gram)


def word_lists(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the words of each text that has some."""
    return df.select(F.col(id_col).alias("id"), joined_words(text_col).alias("w")).where("w != ''").select("id", F.split("w", " ").alias("w"))


def grams(lists: DataFrame, least: int, gram: int, *more: str) -> DataFrame:
    """``positions`` of word lists, with further columns of theirs."""
    split = lists.where(F.size("w") >= max(least, gram))
    words = F.expr(f"slice(w, 1, size(w) - {gram - 1})")
    rest = [F.get("w", F.col("pos") + i) for i in range(1, gram)]
    return split.select("id", "w", F.posexplode(words).alias("pos", "word")).select("id", "pos", F.xxhash64("word", *rest).alias("term"), *more)


def build_index(docs: DataFrame, items: DataFrame, least: int, gram: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings (term, doc_id, pos) of the documents' terms that items have too."""
    vocabulary = bounded(stored(items.select("term").distinct(), "vocabulary"), BROADCAST_WORDS)
    postings = positions(docs, doc_id, text, least, gram).join(vocabulary, "term", "left_semi")
    return stored(postings.select("term", F.col("id").alias("doc_id"), "pos"), "postings")


def rarest_seeds(items: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """(item_id, ipos, term): the rarest term of each run of ``least`` item terms all of which the index has."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    run = W.partitionBy("id").orderBy("pos").rowsBetween(0, least - 1)
    counted = items.join(counts, "term", "left").select("id", "pos", "term", "n")
    runs = counted.select(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "term")).over(run).alias("seed"), F.count("*").over(run).alias("words"), "id")
    return runs.where((F.col("words") == least) & (F.col("seed.n") > 0)).select(F.col("id").alias("item_id"), F.col("seed.pos").alias("ipos"), F.col("seed.term").alias("term")).distinct()


def alignments(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, item_id, ipos, shift): where the index has a seed term."""
    hits = index.join(bounded(stored(seeds, "seeds"), BROADCAST_WORDS), "term")
    return hits.select("doc_id", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()


def phrase_matches(docs: DataFrame, test_items: DataFrame, least: int = 12, gram: int = 3, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, shift, first_word, words): the maximal runs of at least ``least`` equal words."""
    gram = min(gram, least)
    terms = least - gram + 1
    items = stored(positions(test_items, item_id, text, least, gram).distinct(), "items")
    index = build_index(docs, items, least, gram, doc_id, text)
    found = alignments(index, rarest_seeds(items, index, terms))
    return intersect(index, items, found, terms).withColumn("words", F.col("words") + gram - 1)


def intersect(index: DataFrame, items: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Intersect the offset-adjusted lists of the terms around each seed and keep runs of ``least`` terms."""
    around = found.select("doc_id", "item_id", "shift", F.explode(F.sequence(F.greatest(F.col("ipos") - least + 1, -F.col("shift"), F.lit(0)), F.col("ipos") + least - 1)).alias("ipos")).distinct()
    terms = bounded(items.select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "term"), BROADCAST_WORDS)
    expected = around.join(terms, ["item_id", "ipos"]).select("doc_id", (F.col("ipos") + F.col("shift")).alias("pos"), "term", "item_id", "shift", "ipos")
    agreed = expected.join(index, ["doc_id", "pos", "term"], "left_semi").select("doc_id", "item_id", "shift", "ipos")
    order = W.partitionBy("doc_id", "item_id", "shift").orderBy("ipos")
    runs = agreed.withColumn("run", F.col("ipos") - F.row_number().over(order))
    return runs.groupBy("doc_id", "item_id", "shift", "run").agg(F.min("ipos").alias("first_word"), F.count("*").alias("words")).where(F.col("words") >= least).drop("run")


def leaked_pairs(docs: DataFrame, test_items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id) with ``least`` consecutive words in common: ``p6_found``."""
    return phrase_matches(docs, test_items, least).select("doc_id", "item_id").distinct()


def proximity_matches(docs: DataFrame, test_items: DataFrame, window: int = 12, edits: int = 3, gram: int = 3) -> DataFrame:
    """(doc_id, item_id, terms): a passage of ``window`` consecutive item words stands in the document, edited or not.

    A document matches where it has ``gram`` consecutive words of the item and, of a window of the item
    around them, all words but ``edits`` at most about as far from them as in the item, that is moved by
    no more than ``edits`` words. Each such run is looked up at all its places, so no passage with up to
    ``edits`` words put in, left out or replaced is lost: they cut the window into ``edits`` + 1 pieces, one
    of which has ``gram`` words. ``terms`` is the most words that a window has. Of an item shorter than
    ``window`` so many edits are allowed as leave such a piece.
    """
    if window < gram * (edits + 1):
        raise ValueError("so many edits leave no run of words in the window")
    lists = stored(word_lists(test_items, "item_id", "text").where(F.size("w") >= gram), "items")
    places = stored(grams(lists, gram, gram).select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "term"), "places")
    items = bounded(lists.select(F.col("id").alias("item_id"), F.col("w").alias("iw")), BROADCAST_WORDS // 1_000)
    reach = window - gram + edits
    # The document's words as far as a window around the run reaches, so that no text moves; ``left``: how many stand before the run.
    near = [F.slice("w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(2 * reach + gram)).alias("dw"), F.least(F.col("pos"), F.lit(reach)).alias("left")]
    held = bounded(places, BROADCAST_WORDS)
    runs = grams(word_lists(docs, "doc_id", "text"), gram, gram, "w").withColumnRenamed("id", "doc_id")
    # A broadcast meets the words where they are; a shuffle takes with each run only what is near it.
    hits = runs.select("doc_id", "term", *near).join(held, "term") if held is places else runs.join(held, "term").select("doc_id", "item_id", "ipos", *near)
    # A window that holds a run of equal words but neither its first nor its last gram is inside it, and so is the one that begins
    # with the run: the grams at both ends are enough.
    ends = f"NOT coalesce(get(dw, left - 1) = get(iw, ipos - 1), false) OR NOT coalesce(get(dw, left + {gram}) = get(iw, ipos + {gram}), false)"
    both = hits.join(items, "item_id").where(ends)
    sized = both.withColumn("size", F.least(F.size("iw"), F.lit(window))).withColumn("need", F.expr(f"size - least({edits}, int((size - {gram}) div {gram}))"))
    at = "(left + j - ipos)"
    there = f"{at} - {edits} < size(dw) AND exists(sequence(greatest({at} - {edits}, 0), greatest(least({at} + {edits}, size(dw) - 1), 0)), p -> dw[p] = iw[j])"
    kept = f"filter(sequence(greatest(ipos - size + {gram}, 0), least(ipos + size, size(iw)) - 1), j -> {at} + {edits} >= 0 AND {there})"
    most = "array_max(transform(filter(kept, j -> j <= ipos), j -> size(filter(kept, k -> k >= j AND k < j + size))))"
    around = sized.selectExpr("doc_id", "item_id", "ipos", "size", "need", f"{kept} AS kept").where("size(kept) >= need")
    return around.selectExpr("doc_id", "item_id", "need", f"cast({most} AS bigint) AS terms").where("terms >= need").groupBy("doc_id", "item_id").agg(F.max("terms").alias("terms"))
