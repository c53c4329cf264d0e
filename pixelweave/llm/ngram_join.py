"""Similarity join of documents by the Jaccard likeness of their word n-gram sets, with vertical partitioning.

The global n-gram order is cut into fragments. A document's set falls into one segment for each fragment; segments meet
fragment by fragment. There n-grams that only one set holds are told apart from shared ones, which get numbers in order
of rising frequency. Sets with too few shared n-grams can have no partner. For the rest, candidates share an n-gram
of their rarest ones (prefix filter), their overlaps are counted for each fragment by itself and summed for each pair.

Equal sets are one set throughout, so copies never make pairs. Candidates of a shared n-gram first meet one of them, the
hub; then only those that links have not yet joined, and whose sketches leave room for a link, meet each other. So a
large group of near copies costs a row for each copy, and sets that are merely related are told apart inside the join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import attach, components, in_chunks, mix, release, rolling, stage, to_bytes, U64, unstage, width, Words
from pixelweave.llm.tokens import forget

#: Groups of fragments by which the overlaps of candidates are counted.
PARTS = 4
#: 64-bit words of a set's sketch.
SKETCH = 16
#: Characters of text for a fragment, and rows of an n-gram that meet in one part of the last join.
FRAGMENT = 1 << 22
CROWD = 4096
_FLUSH = 2_000_000
_SALT = 0x5851F42D4C957F2D


def shingle_sets(texts: list[bytes], n: int):
    """For each text its distinct n-gram hashes, sorted. Fewer than ``n`` words: the whole sequence; none: nothing."""
    for first, last in in_chunks(texts):
        words = Words(texts[first:last], lower=True)
        rolled = rolling(words.hashes, n)
        for begin, end in zip(words.begins.tolist(), words.ends.tolist(), strict=True):
            if end - begin >= n:
                yield np.unique(rolled[begin : end - n + 1])
            elif end > begin:
                yield rolling(words.hashes[begin:end], end - begin) * U64(_SALT) + U64(end - begin)
            else:
                yield np.zeros(0, U64)


def fragments_for(docs: DataFrame) -> int:
    """Fragments, a power of two: from 256, one for each ``FRAGMENT`` characters, so that one's memory doesn't grow with the data."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    return 1 << max(8, (chars // FRAGMENT).bit_length())


def _cut(fragments: int, n: int):
    """Packs segments of many documents into one row for each fragment.

    A fragment is a range of hashes, so its number holds their upper bits, 8 at least; the lower 56 are written.
    """
    shift, flush = U64(65 - fragments.bit_length()), min(max(_FLUSH, 32 * fragments), 4 * _FLUSH)

    def pack(held: list) -> pd.DataFrame:
        docs, marks, sets = zip(*held, strict=True)
        sizes = np.array([len(s) for s in sets])
        sids = np.array([int(mix(np.array([mix(s).sum(dtype=U64) + U64(len(s))], U64))[0]) for s in sets], U64)
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        frag, home = (grams >> shift).astype(np.int32), (sids >> shift).astype(np.int32)
        marks = np.array(marks, np.int64)
        order, doc_order = np.argsort(frag, kind="stable"), np.argsort(home, kind="stable")
        edges, doc_edges = np.searchsorted(frag[order], np.arange(fragments + 1)), np.searchsorted(home[doc_order], np.arange(fragments + 1))
        known = np.array([d is not None for d in docs])
        ids = np.array([d or 0 for d in docs], np.int64)
        rows = []
        for f in range(fragments):
            at, own = order[edges[f] : edges[f + 1]], doc_order[doc_edges[f] : doc_edges[f + 1]]
            if len(at) or len(own):
                who, counts = np.unique(owner[at], return_counts=True)  # owners rise within a fragment
                rows.append((f, sids[who].tobytes(), counts.astype("<u4").tobytes(), grams[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes(),
                             ids[own].tobytes(), known[own].tobytes(), marks[own].tobytes(), sids[own].tobytes(), sizes[own].astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=["frag", "sids", "counts", "grams", "doc_ids", "known", "marks", "doc_sids", "sizes"])

    def cut(batches):
        forget()
        held, size = [], 0
        for pdf in batches:
            docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"].array]
            for doc, own, grams in zip(docs, pdf["mark"].tolist(), shingle_sets(to_bytes(pdf["text"].array), n), strict=True):
                held.append((doc, own, grams))
                size += len(grams) + 8
                if size > flush:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)
        held = []
        release()

    return cut


def _meet(table: pa.Table) -> pa.Table:
    """A fragment: its shared n-grams numbered by rising frequency, each set's segment of them, and the documents homed here."""
    join = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in table[c].to_pylist()])
    sid = np.repeat(join("sids", np.uint64), join("counts", "<u4"))
    low = join("grams", np.uint8).reshape(-1, 7)
    gram = np.zeros((len(low), 8), np.uint8)  # the fragment, common to all, stands for the upper bits
    gram[:, :7] = low
    gram = gram.view("<u8")[:, 0]
    order = np.argsort(gram)
    gram, sid = gram[order], sid[order]
    same = np.zeros(len(gram) + 1, bool)
    same[1:-1] = gram[1:] == gram[:-1]
    often = same[1:] | same[:-1]
    gram, sid = gram[often], sid[often]
    order = np.lexsort((sid, gram))
    gram, sid = gram[order], sid[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])
    gram, sid = gram[new], sid[new]
    _, which, freq = np.unique(gram, return_inverse=True, return_counts=True)
    number = np.empty(len(freq), np.int64)
    number[np.lexsort((np.arange(len(freq)), freq))] = np.arange(len(freq))
    keep = freq[which] > 1
    sid, which = sid[keep], which[keep]
    order = np.lexsort((number[which], sid))
    sid, which = sid[order], which[order]
    edges = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1], [True]))) if len(sid) else np.zeros(1, int)
    nums, freqs = number[which].astype(np.int32), freq[which].astype(np.int32)
    segments, docs = len(edges) - 1, join("doc_sids", np.int64)
    none, lists = np.zeros(len(docs), bool), np.concatenate((edges, np.full(len(docs), edges[-1]))).astype(np.int32)
    absent = np.concatenate((np.zeros(segments, bool), ~none))
    column = lambda first, last, kind, gone: pa.array(np.concatenate((first, last)), kind, mask=gone)
    nothing, blank = np.zeros(segments, np.int64), np.zeros(len(docs), np.int64)
    return pa.table({
        "sid": column(sid[edges[:-1]].view(np.int64), docs, pa.int64(), None),
        "frag": column(nothing + table["frag"][0].as_py(), blank, pa.int32(), absent),
        "n_shared": column(np.diff(edges), blank, pa.int32(), absent),
        "grams": pa.ListArray.from_arrays(lists, nums),
        "freqs": pa.ListArray.from_arrays(lists, freqs),
        "doc_id": column(nothing, join("doc_ids", np.int64), pa.int64(), np.concatenate((np.ones(segments, bool), ~join("known", bool)))),
        "mark": column(nothing, join("marks", np.int64), pa.int64(), ~absent),
        "size": column(nothing, join("sizes", "<i4").astype(np.int64), pa.int32(), ~absent),
    })


_MET = "sid long, frag int, n_shared int, grams array<int>, freqs array<int>, doc_id long, mark long, size int"


def _sketched(batches):
    """Adds to each row a parity sketch of its n-grams: each n-gram turns over one bit of 64 * SKETCH."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("grams"))
        flat, bits = lists.flatten().to_numpy(zero_copy_only=False), 64 * SKETCH
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        odd = np.bincount(row * bits + (mix(flat.astype(U64)) % U64(bits)).astype(np.int64), minlength=len(lists) * bits) & 1
        words = np.packbits(odd.astype(np.uint8)).view(np.int64)
        yield batch.append_column("sketch", pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * SKETCH, words))
    release()


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, size_a, b, size_b) those that link: overlaps by groups of fragments, summed by pair."""
    left = parts.select(F.col("sid").alias("a"), "part", F.col("grams").alias("grams_a"))
    right = parts.select(F.col("sid").alias("b"), "part", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("n"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("n")) * percent).select("a", "b")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75, fragments: int | None = None, mark: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links reach, itself included.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct ``n``-word shingles, or the
    whole sequence where there are fewer words. Two documents link when 100 * intersection >= percent * union. Null or
    wordless texts have no shingles and no links: component_id is the doc_id. A null doc_id counts as none: its component_id
    is the smallest other one, or null. Rows that share a doc_id are rows of their own. Other columns are not read; an
    empty table gives no rows. Shingles and sets are told apart by 64-bit hashes. ``fragments``: a power of two, 256 at least.
    With ``mark`` each row has its text's xxhash64 too, as ``mark``, and its set's component, as ``set_id``.
    """
    spark = docs.sparkSession
    fragments = fragments or fragments_for(docs)
    packed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInPandas(
        _cut(fragments, n),
        "frag int, sids binary, counts binary, grams binary, doc_ids binary, known binary, marks binary, doc_sids binary, sizes binary",
    )
    met = stage(packed.repartition(max(width(spark), fragments // 4), "frag").groupBy("frag").applyInArrow(_meet, _MET), "fragments")
    members = stage(met.where("size is not null").select("doc_id", "mark", "sid", "size"), "members")
    segments = met.where("frag is not null").select("sid", "frag", "n_shared", "grams", "freqs")
    sets = members.where("size > 0").groupBy("sid").agg(F.first("size").alias("size"))
    numbered = F.transform(F.arrays_zip("freqs", "grams"), lambda g: F.struct(g["freqs"].alias("freq"), (F.shiftleft(F.col("frag").cast("long"), 32) + g["grams"]).alias("gram")))
    # How common a set's n-grams are on average: what near copies were made from comes before them.
    central = F.aggregate("ordered", F.lit(0.0), lambda a, g: a + F.log(g["freq"].cast("double")))
    alive = stage(
        segments.groupBy("sid").agg(F.sum("n_shared").alias("shared"), F.sort_array(F.flatten(F.collect_list(numbered))).alias("ordered"))
        .join(sets, "sid").where(F.col("shared") * 100 >= F.col("size") * percent)
        .select("sid", "size", "shared", F.col("ordered")["gram"].alias("grams"), (central / F.col("size")).alias("central"))
        .mapInArrow(_sketched, "sid long, size int, shared long, grams array<long>, central double, sketch array<long>"),
        "alive",
    )
    unstage(met)
    # A set's rarest n-grams: so many that two sets without one of them in common can't link; those that nobody shares come first.
    take = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.col("shared"))
    postings = alive.select("sid", "size", "shared", "central", F.explode(F.slice("grams", F.lit(1), take.cast("int"))).alias("gram"))
    common = postings.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    postings = stage(postings.join(common, "gram"), "postings")
    part = lambda k: F.filter("grams", lambda g: F.shiftright(g, 32) % PARTS == k)
    parts = stage(alive.select("sid", F.posexplode(F.array(*[part(k) for k in range(PARTS)])).alias("part", "grams")), "parts")
    met, joined = [], spark.createDataFrame([], "sid long, component long")

    def compare(pairs: DataFrame, name: str) -> None:
        """Counts the overlaps of ``pairs`` (a, size_a, b, size_b; a < b) that weren't counted before, and joins what links."""
        nonlocal joined
        pairs = pairs.distinct()
        for before in met:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stage(pairs, f"pairs-{name}")
        met.append(pairs.select("a", "b"))
        links = _links(pairs, parts, percent).union(joined.select("sid", "component"))
        joined = stage(components(links, "ngram"), "joined").withColumnRenamed("node", "sid")

    # First the sets that hold an n-gram meet its hub, the most central of them.
    hubs = postings.groupBy("gram").agg(F.max(F.struct("central", "sid", "size")).alias("hub"))
    swap = F.col("sid") > F.col("hub.sid")
    ordered_pair = [
        F.least("sid", "hub.sid").alias("a"), F.when(swap, F.col("hub.size")).otherwise(F.col("size")).alias("size_a"),
        F.greatest("sid", "hub.sid").alias("b"), F.when(swap, F.col("size")).otherwise(F.col("hub.size")).alias("size_b"),
    ]
    alike = F.least("size", "hub.size") * 100 >= F.greatest("size", "hub.size") * percent
    compare(postings.join(hubs, "gram").where(F.col("sid") != F.col("hub.sid")).where(alike).select(*ordered_pair), "hub")

    # Then those that are not in one component meet each other, where their sketches leave room for a link: differing
    # sketch bits, and n-grams that no other set has, are differences between the sets.
    named = postings.join(joined, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = named.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    sketches = alive.select("sid", "shared", "sketch")
    named = stage(named.join(mixed.select("gram"), "gram").select("gram", "sid", "size", "component").join(sketches, "sid"), "open")
    # Sets whose sizes are too far apart can't link: sizes fall into levels of which a pair's are the same or neighbours.
    named = named.withColumn("level", F.floor(F.log(F.col("size").cast("double")) / (math.log(100 / percent) * 1.0001)).cast("int"))
    total, often = named.count(), named.groupBy("gram", "level").agg(F.count("*").alias("n"))
    # The rows of an n-gram and level are dealt to parts of at most about CROWD rows, and what may match them goes to each part.
    crowd = F.floor(F.col("n") / CROWD).cast("int")
    right = attach(named, often, ["gram", "level"], total).withColumn("salt", F.pmod(F.xxhash64("sid"), crowd + 1).cast("int")).drop("n")
    left = attach(named.withColumn("own", F.col("level")).withColumn("level", F.explode(F.array("level", F.col("level") + 1))), often, ["gram", "level"], 2 * total)
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), crowd))).drop("n")
    keys, rest = ("gram", "level", "salt"), ("sid", "size", "component", "shared", "sketch")
    left = left.select(*keys, "own", *[F.col(c).alias(f"{c}_a") for c in rest])
    right = right.select(*keys, *[F.col(c).alias(f"{c}_b") for c in rest])
    both = F.col("size_a") + F.col("size_b")
    differ = both - F.col("shared_a") - F.col("shared_b")
    for k in range(SKETCH):
        differ += F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k]))
    once = (F.col("own") < F.col("level")) | (F.col("sid_a") < F.col("sid_b"))
    room = once & (F.col("component_a") != F.col("component_b")) & (differ * (100 + percent) <= both * (100 - percent))
    swap = F.col("sid_a") > F.col("sid_b")
    found = left.join(right, list(keys)).where(room).select(
        F.least("sid_a", "sid_b").alias("a"), F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
        F.greatest("sid_a", "sid_b").alias("b"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
    )
    compare(found, "rest")

    # Copies share a set and related sets a component, either of which may hold much of the table: both go through ``attach``.
    own = members.where("size > 0").groupBy("sid").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).join(joined, "sid", "left")
    own = stage(own.select("sid", F.col("n").alias("copies"), F.coalesce("component", "sid").alias("component"), "least"), "owners")
    least = own.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    named = attach(own.drop("least"), least, ["component"], own.count()).select("sid", "component", "least", F.col("copies").alias("n"))
    out = attach(members.where("size > 0"), named, ["sid"], members.count()).drop("n")
    none = F.lit(None).cast("long")
    out = out.unionByName(members.where("size = 0").select("*", none.alias("component"), F.col("doc_id").alias("least")))
    return out.select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("least").alias("component_id"), *(["mark", F.col("component").alias("set_id")] if mark else [])
    )
