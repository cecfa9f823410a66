"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles. Its sketch has a fixed number of
coordinates, filled in rounds: in each of the first t rounds every shingle is
hashed to one coordinate and to a value, and a coordinate keeps the smallest value
of the earliest round that reached it; in t more rounds, one for each coordinate,
every shingle goes to that coordinate. So every coordinate is filled, after about
t log t / n rounds, and the share of equal coordinates of two sketches is as
concentrated about the Jaccard similarity as t independent minima at least.

Coordinates are grouped into bands; documents that agree in a band share a bucket.
With 40 bands of 4, a pair of similarity 0.8 shares none with probability 7e-10.
Documents with the same set are one class from the start. Every member of a bucket
is compared with the bucket's smallest member, on whole sets of whole texts, and
components are formed. Where the other members of a bucket are still in different
components, those outside the most frequent one are compared with it and with each
other, once for all buckets of that component, in cells of bounded size that give
only the links they find. So no pair that shares a bucket is left open, and a
bucket whose members hang together costs one comparison each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import fresh, per_batch, written
from keysieve.llm.graph import components

BATCH_ROWS = 256
CELL = 128
ROUND_BITS = np.uint64(40)
UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Near:
    """Words per shingle, least similarity in percent, bands and coordinates per band."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 4

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int, start: int) -> np.ndarray:
    return mixed((np.arange(count, dtype=np.uint64) + np.uint64(start)) * np.uint64(0x9E3779B97F4A7C15))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> set:
    """The set of runs of k words; the whole sequence if there are fewer; empty without words."""
    words = words_of(text)
    if len(words) >= k:
        return set(zip(*[words[i:] for i in range(k)]))
    return {tuple(words)} if words else set()


def similar(a: set, b: set, percent: int) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def shingle_hashes(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text, the distinct 64-bit hashes of its shingles, ascending."""
    import pandas as pd

    cut = [words_of(t) for t in texts]
    flat = np.empty(sum(map(len, cut)), dtype=object)
    flat[:] = [w for words in cut for w in words]
    codes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
    runs = np.full(max(len(codes) - k + 1, 0), k, dtype=np.uint64)
    for i in range(k):
        runs = mixed(runs ^ codes[i : i + len(runs)]) + np.uint64(i)
    result, at = [], 0
    for words in cut:
        n = len(words)
        if n >= k:
            result.append(np.unique(runs[at : at + n - k + 1]))
        elif n:
            whole = np.array([n], dtype=np.uint64) + np.uint64(1 << 32)
            for i in range(n):
                whole = mixed(whole ^ codes[at + i : at + i + 1]) + np.uint64(i)
            result.append(whole)
        else:
            result.append(np.zeros(0, dtype=np.uint64))
        at += n
    return result


def sketch(x: np.ndarray, size: int, seed: np.ndarray) -> np.ndarray:
    """The coordinates of a set of hashes, each the round and the value of its smallest entry."""
    out = np.full(size, UNFILLED)
    done = 0
    while done < size:
        many = max(1, min(size - done, 2048 // len(x)))
        numbers = np.arange(done, done + many, dtype=np.uint64)[:, None]
        hashed = mixed(x[None, :] ^ seed[done : done + many, None])
        places = ((hashed >> ROUND_BITS) % np.uint64(size)).astype(np.int64)
        values = (numbers << ROUND_BITS) | (hashed & np.uint64((1 << 40) - 1))
        np.minimum.at(out, places.ravel(), values.ravel())
        done += many
        if (out != UNFILLED).all():
            return out
    for place in np.flatnonzero(out == UNFILLED):
        hashed = mixed(x ^ seed[size + place])
        out[place] = ((np.uint64(size + place) << ROUND_BITS) | (hashed & np.uint64((1 << 40) - 1))).min()
    return out


def band_hashes(coordinates: np.ndarray, near: Near, seed: np.ndarray) -> np.ndarray:
    """One number per band from its place and its coordinates."""
    grouped = coordinates.reshape(near.bands, near.rows)
    hashed = seed[: near.bands].copy()
    for j in range(near.rows):
        hashed = mixed(hashed ^ grouped[:, j]) + np.uint64(j)
    return hashed.view(np.int64)


def signatures(documents: DataFrame, near: Near) -> DataFrame:
    """``(doc_id, version, n, d1, d2, bands)``: set sizes, hashes of whole sets and of bands; none for empty sets."""
    source = documents.select("doc_id", F.xxhash64("text").alias("version"), "text")
    schema = T.StructType(
        [*source.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
         T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seed = seeds(2 * near.size, 1)
        n, d1, d2, bands = [], [], [], []
        for x in shingle_hashes(batch.column(2).to_pylist(), near.words):
            n.append(len(x))
            d1.append(int(mixed(x).sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(mixed(x + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).view(np.int64)))
            bands.append(band_hashes(sketch(x, near.size, seed), near, seed) if len(x) else None)
        columns = [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], schema.names)

    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)


def checked(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar."""
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict = {}
        keep = []
        for a, b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for id_, text in ((a, text_a), (b, text_b)):
                if (id_, text) not in known:
                    known[id_, text] = shingles(text, near.words)
            keep.append(similar(known[a, text_a], known[b, text_b], near.percent))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(per_batch(work, BATCH_ROWS), "a long, b long")


def links_in_cell(near: Near):
    """A function on the members of one cell: pairs of components that hang together, enough to join them.

    Sides: 0 is compared with 1; 2 is compared with every other 2.
    """

    def run(key, cell):
        import pandas as pd

        sets = [shingles(t, near.words) for t in cell["text"]]
        root, side = cell["label"].tolist(), cell["side"].tolist()
        order = sorted(range(len(root)), key=lambda i: len(sets[i]))
        parent = {label: label for label in root}

        def top(label):
            while parent[label] != label:
                parent[label] = parent[parent[label]]
                label = parent[label]
            return label

        found = []
        for place, i in enumerate(order):
            for j in order[place + 1 :]:
                if 100 * len(sets[i]) < near.percent * len(sets[j]):
                    break
                if (side[i] == side[j]) == (side[i] != 2):
                    continue
                x, y = top(root[i]), top(root[j])
                if x != y and similar(sets[i], sets[j], near.percent):
                    parent[x] = y
                    found.append((root[i], root[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(home, id, label)`` of members that are not in the component most frequent in their bucket, and of those that are.

    Only buckets are looked at whose members, apart from the leader, are in several
    components. ``home`` is that most frequent component. What many buckets say of
    the same two documents is said once.
    """
    rest = members.where("id <> leader").join(labels, "id", "left")
    rest = rest.select("bucket", "id", F.coalesce("component", "id").alias("label"))
    counts = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    homes = counts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("components"))
    homes = homes.where("components > 1").select("bucket", F.col("top.label").alias("home"))
    return rest.join(homes, "bucket").select("home", "id", "label").distinct()


def cells(members: DataFrame) -> DataFrame:
    """``(home, kind, i, j, id, label, side)``: members dealt into cells that cover all pairs across components.

    The members of a home component are on one side and meet all others; the others
    also meet each other. What fits into one cell is one.
    """
    at_home = F.col("label") == F.col("home")
    sizes = members.groupBy("home").agg(F.count_if(at_home).alias("own"), F.count_if(~at_home).alias("far"))
    dealt = members.join(sizes, "home")
    small = dealt.where(F.col("own") + F.col("far") <= 2 * CELL).select(
        "home", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "label", F.lit(2).alias("side")
    )
    homes = F.greatest(F.ceil(F.col("own") / CELL), F.lit(1)).cast("int")
    others = F.greatest(F.ceil(F.col("far") / CELL), F.lit(1)).cast("int")
    large = dealt.where(F.col("own") + F.col("far") > 2 * CELL)
    large = large.select("home", "id", "label", homes.alias("homes"), others.alias("others"), at_home.alias("at_home"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("others"))).cast("int")
    large = large.withColumn("block", block)
    each_other, each_home = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("homes") - 1)
    own = large.where("at_home").select(
        "home", F.lit(1).alias("kind"), F.col("block").alias("i"), F.explode(each_other).alias("j"), "id", "label", F.lit(0).alias("side")
    )
    away = large.where("NOT at_home")
    meeting = away.select(
        "home", F.lit(1).alias("kind"), F.explode(each_home).alias("i"), F.col("block").alias("j"), "id", "label", F.lit(1).alias("side")
    )
    among = away.select("home", "block", F.explode(each_other).alias("o"), "id", "label").select(
        "home", F.lit(2).alias("kind"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "label",
        F.lit(2).alias("side"),
    )
    return small.unionByName(own).unionByName(meeting).unionByName(among)


def classes(documents: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, d1, d2)`` of all rows, and ``(d1, d2, component)`` of all sets that occur."""
    signed = written(signatures(documents.select("doc_id", "text"), near), "neardup-signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    sets = usable.groupBy("d1", "d2").agg(
        F.min(F.struct("doc_id", "version")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    sets = written(
        sets.select("d1", "d2", F.col("r.doc_id").cast("long").alias("id"), F.col("r.version").alias("version"), "n", "bands"),
        "neardup-sets",
    )
    banded = sets.select("id", "version", "n", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("leader"), F.max("id").alias("last"))
    buckets = buckets.where("leader.id <> last").select("bucket", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"))
    members = written(banded.join(buckets, "bucket"), "neardup-members")
    wanted = members.select(F.col("id").alias("w_id"), F.col("version").alias("w_version")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), "text")
    texts = texts.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("version") == F.col("w_version")), "left_semi")
    texts = written(texts.select("id", "text"), "neardup-texts")
    size = (F.least("n", "leader_n") * 100) >= (F.greatest("n", "leader_n") * near.percent)
    pairs = members.where((F.col("id") != F.col("leader")) & size).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = written(checked(pairs, texts, near), "neardup-links")
    labels = written(components(links), "neardup-labels")
    joined = sets.select("d1", "d2", "id").join(labels, "id", "left")
    joined = joined.select("d1", "d2", F.coalesce("component", "id").alias("label"))
    left = written(open_members(members, labels), "neardup-open")
    if not left.isEmpty():
        met = cells(left).join(texts, "id")
        more = met.groupBy("home", "kind", "i", "j").applyInPandas(links_in_cell(near), "a long, b long")
        merged = components(written(more, "neardup-more")).withColumnRenamed("id", "label")  # a graph of components
        joined = joined.join(merged, "label", "left")
        joined = joined.select("d1", "d2", F.coalesce("component", "label").alias("label"))
    return signed.select("doc_id", "n", "d1", "d2"), joined.select("d1", "d2", F.col("label").alias("component"))


def components_of(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of the documents.

    Documents are linked if their shingle sets are similar; a component's id is its
    smallest ``doc_id``, and that document is kept. A null, empty or blank text has
    no shingles and is linked with nothing, as is a row with a null id; it is kept.
    Rows that share an id count each by its own text. An empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are not looked at.
    """
    signed, labelled = classes(documents, near)
    usable = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(True))
    joined = signed.withColumns({"k1": F.when(usable, F.col("d1")), "k2": F.when(usable, F.col("d2"))})
    labelled = labelled.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "component")
    joined = joined.join(labelled, ["k1", "k2"], "left")
    component = F.coalesce("component", F.col("doc_id").cast("long"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """The documents without those that are near duplicates of one with a smaller id, with all their columns."""
    removed_id = fresh(documents, "_removed_id")
    removed = components_of(documents, near).where("NOT kept").select(F.col("doc_id").alias(removed_id)).distinct()
    removed = written(removed, "neardup-removed")
    return documents.join(removed, documents["doc_id"] == F.col(removed_id), "left_anti")
