"""Benchmark decontamination by a positional inverted index.

Test items are cut into windows of consecutive words. One pass over the training
texts counts the words that occur in items. The index then stores postings, the
place of a word in a document, of the two rarest words of every window, in a table
that outlives the search. A window is looked up from its rarest word: the places in
that list less the word's offset in the window are candidate starts, and they are
intersected with the list of the next rarest word, adjusted by its own offset. A
candidate that both lists confirm is compared word by word with the words that
stand around the posting. The same lists, joined within a distance instead, give
proximity matches: all words of a window in a short stretch, in any order.

Only DataFrame operations. What is broadcast comes from the items alone and is
measured first; beyond the bound, the same joins are shuffled. Texts are never
shuffled, and a posting of a frequent word is a row of its own, so no list has to
fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import LOWER, UPPER, broadcast_if_small, fresh, written

WINDOW = 10
# ASCII characters that are no part of a word once A-Z is in lower case.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
HEADER = ""


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, cut at every ASCII character but letters and digits."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.filter(F.split(plain, " ", -1), lambda word: word != "")


def windows(items: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(phrase, words, size)`` of the distinct windows, and ``(phrase, item_id)``.

    An item of fewer words than ``length`` is one window; one without words has none.
    """
    cut = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    cut = cut.select("item_id", "w", F.explode(starts).alias("start"))
    cut = cut.select("item_id", F.slice("w", F.col("start"), F.least(F.size("w"), F.lit(length))).alias("words"))
    cut = cut.select("item_id", F.array_join("words", " ").alias("phrase"), "words")
    of_items = written(cut.select("phrase", "item_id").distinct(), "decontam-items")
    phrases = cut.groupBy("phrase").agg(F.first("words").alias("words"))
    return written(phrases.withColumn("size", F.size("words")), "decontam-phrases"), of_items


def tokens(documents: DataFrame) -> DataFrame:
    """``(doc_id, version, w)``: a hash of the text tells apart rows under one id."""
    return documents.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("w"))


def rarest_terms(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(phrase, words, size, a, a_at, b, b_at)``: each window's two rarest different words and their offsets.

    A window of one word repeated has it in both places. Equally frequent words
    go by their order as text.
    """
    terms = phrases.select("phrase", F.posexplode("words").alias("at", "term"))
    vocabulary = broadcast_if_small(written(terms.select("term").distinct(), "decontam-vocabulary"), ["term"])
    counted = tokens(documents).select(F.explode("w").alias("term")).join(vocabulary, "term").groupBy("term").count()
    counted = written(counted, "decontam-counts")
    ranked = terms.groupBy("phrase", "term").agg(F.min("at").alias("at")).join(counted, "term", "left")
    ranked = ranked.groupBy("phrase").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "at"))), 1, 2).alias("r")
    )
    first, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])
    chosen = ranked.select(
        "phrase", first["term"].alias("a"), first["at"].alias("a_at"), second["term"].alias("b"), second["at"].alias("b_at")
    )
    return written(phrases.join(chosen, "phrase"), "decontam-terms")


def index(documents: DataFrame, chosen: DataFrame, reach: int) -> DataFrame:
    """Postings ``(term, doc_id, version, place, n_words, from_place, around, reach)`` as a stored table.

    ``around`` holds the words up to ``reach`` places away, ``from_place`` the place
    of its first. Exact search needs a reach of a window less one word, search with a
    slop that of a window and the slop. Every document has one posting of the empty word, its header.
    """
    terms = chosen.select(F.explode(F.array("a", "b")).alias("term"))
    terms = terms.union(chosen.sparkSession.range(1).select(F.lit(HEADER).alias("term")))
    terms = broadcast_if_small(written(terms.distinct(), "decontam-index-terms"), ["term"])
    cut = tokens(documents).withColumn("n_words", F.size("w"))
    all_places = cut.select("doc_id", "version", "n_words", "w", F.posexplode(F.concat(F.array(F.lit(HEADER)), "w")).alias("at", "term"))
    found = all_places.join(terms, "term")
    place = F.col("at") - 1
    from_place = F.greatest(place - reach, F.lit(0))
    is_header = F.col("term") == HEADER
    around = F.when(~is_header, F.slice("w", from_place + 1, F.lit(2 * reach + 1)))
    return written(
        found.select("term", "doc_id", "version", place.alias("place"), "n_words", from_place.alias("from_place"),
                     around.alias("around"), F.lit(reach).alias("reach")),
        "decontam-postings",
    )


def search(postings: DataFrame, chosen: DataFrame, slop: int | None = None) -> DataFrame:
    """``(doc_id, version, phrase, size, start, kind)``: where windows occur.

    Starts are places of words from 0. ``kind`` is ``phrase`` for the exact sequence
    and, if ``slop`` is given, ``proximity`` where all words of a window stand around
    a posting of its rarest word, at most the window's size and ``slop`` places away,
    without the exact sequence. Postings of too short a reach are refused, as matches
    at their edges would be missed.
    """
    stored, longest = postings.select("reach").first(), chosen.agg(F.max("size").alias("size")).first()["size"]
    if stored and longest and stored["reach"] < (needed := longest - 1 if slop is None else longest + slop):
        raise ValueError(f"the index reaches {stored['reach']} words, the search needs {needed}")
    chosen = broadcast_if_small(chosen, ["phrase", "words"])
    lists = postings.where(F.col("term") != HEADER)
    rare = lists.join(chosen, lists["term"] == chosen["a"]).select(
        "doc_id", "version", "phrase", "words", "size", "place", "from_place", "around", (F.col("place") - F.col("a_at")).alias("start")
    )
    next_ = lists.join(chosen.select("phrase", "b", "b_at"), lists["term"] == F.col("b")).select(
        "doc_id", "version", "phrase", "place", (F.col("place") - F.col("b_at")).alias("start")
    )
    key = [F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), "version", "phrase"]
    exact_next = next_.select(*key, "start").distinct()
    rare = rare.withColumns({"d": F.coalesce("doc_id", F.lit(-1)), "n": F.col("doc_id").isNull()})
    stands = F.slice("around", F.greatest(F.col("start") - F.col("from_place"), F.lit(0)) + 1, F.col("size")) == F.col("words")
    exact = rare.where("start >= 0").join(exact_next, ["d", "n", "version", "phrase", "start"], "left_semi").where(stands)
    exact = exact.select("doc_id", "version", "phrase", "size", "start", F.lit("phrase").alias("kind"))
    if slop is None:
        return exact.distinct()
    return exact.distinct().unionByName(proximity(rare, next_, key, slop)).distinct()


def proximity(rare: DataFrame, next_: DataFrame, key: list, slop: int) -> DataFrame:
    """Postings of rarest words with the next rarest nearby and all other words around, not in sequence."""
    span = F.col("size") + F.lit(slop)
    cell = 64 + slop
    near = next_.select(*key, F.col("place").alias("other"), F.explode(
        F.array(*[F.floor(F.col("place") / cell) + d for d in (-1, 0, 1)])).alias("cell")).distinct()
    met = rare.withColumn("cell", F.floor(F.col("place") / cell)).join(near, ["d", "n", "version", "phrase", "cell"])
    met = met.where(F.abs(F.col("place") - F.col("other")) <= span)
    at = F.col("place") - F.col("from_place")
    left = F.greatest(at - span, F.lit(0))
    close = F.slice("around", left + 1, at - left + span + 1)
    whole = F.size(F.array_except("words", close)) == 0
    exact = (F.col("start") >= 0) & (
        F.slice("around", F.greatest(F.col("start") - F.col("from_place"), F.lit(0)) + 1, F.col("size")) == F.col("words")
    )
    return met.where(whole & ~exact).select("doc_id", "version", "phrase", "size", F.col("place").alias("start"),
                                            F.lit("proximity").alias("kind"))


def contamination(documents: DataFrame, items: DataFrame, length: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``(doc_id, version, n_words, n_hit, items)``, one row per distinct pair of id and text.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` lists the ids
    of the items that occur, as sorted text. With a ``slop``, ``near_items`` lists in
    the same way the items of which a window is met in proximity only. A null or empty text, or one that has
    only separators, has no words. Items without words or with a null id match
    nothing. Without items all counts are 0; an empty table gives no rows. Columns
    other than ``doc_id``, ``item_id`` and ``text`` are not looked at.
    """
    documents = documents.select("doc_id", "text")
    phrases, of_items = windows(items.where(F.col("item_id").isNotNull()).select("item_id", "text"), length)
    chosen = rarest_terms(documents, phrases)
    postings = index(documents, chosen, length - 1 if slop is None else length + slop)
    found = written(search(postings, chosen, slop), "decontam-matches")
    doc = ["d", "n", "version"]
    keyed = found.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), "version", "phrase",
                         "size", "start", "kind")
    exact = keyed.where("kind = 'phrase'")
    places = exact.select(*doc, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")).distinct()
    hit = places.groupBy(*doc).agg(F.count(F.lit(1)).alias("n_hit"))

    def items_of(matches: DataFrame, name: str) -> DataFrame:
        held = matches.select(*doc, "phrase").distinct().join(of_items, "phrase").select(*doc, F.col("item_id").cast("string").alias("item"))
        return held.groupBy(*doc).agg(F.sort_array(F.collect_set("item")).alias(name))

    headers = postings.where(F.col("term") == HEADER).groupBy("doc_id", "version").agg(F.max("n_words").cast("long").alias("n_words"))
    headers = headers.withColumns({"d": F.coalesce("doc_id", F.lit(-1)), "n": F.col("doc_id").isNull()})
    joined = headers.join(hit.join(items_of(exact, "items"), doc), doc, "left")
    empty = F.array().cast("array<string>")
    columns = ["doc_id", "version", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", empty).alias("items")]
    if slop is None:
        return joined.select(*columns)
    joined = joined.join(items_of(keyed.where("kind = 'proximity'"), "near_items"), doc, "left")
    near = F.array_except(F.coalesce("near_items", empty), F.coalesce("items", empty))
    return joined.select(*columns, near.alias("near_items"))


def per_row(documents: DataFrame, measured: DataFrame) -> DataFrame:
    """What ``contamination`` measured, one row per row of the documents."""
    rows = documents.select(F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_version"))
    joined = rows.join(measured, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_version") == F.col("version")))
    return joined.drop("row_id", "row_version")


def digests(measured: DataFrame) -> DataFrame:
    """Counts, a hash of the items, and whether anything was hit."""
    listed = F.array_join("items", ",")
    return measured.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns.

    Rows that share an id go together. A row with a null id is kept only if its
    own text is clean.
    """
    dirty = contamination(documents, items, length).where("n_hit > 0")
    dirty = written(dirty.select("doc_id", "version").distinct(), "decontam-dirty")
    dirty_id, dirty_version = fresh(documents, "_dirty_id"), fresh(documents, "_dirty_version")
    ids = dirty.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(dirty_id)).distinct()
    nameless = dirty.where("doc_id IS NULL").select(F.col("version").alias(dirty_version))
    kept = documents.join(ids, documents["doc_id"] == F.col(dirty_id), "left_anti")
    version = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return kept.join(nameless, version == F.col(dirty_version), "left_anti")
