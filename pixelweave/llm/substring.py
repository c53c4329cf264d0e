"""Removal of long word passages that also start earlier, found by recompression.

Recompression renames a text in rounds: a symbol falls to the left or the right side by its name, and each left symbol
that a right one follows becomes one symbol, named by the two. Names are hashes of what they stand for, so every task
gives equal pairs equal names without a dictionary. A round changes at most one symbol at each end of a passage by
what stands outside it, so after three rounds (symbols of at most 8 words, 7 words lost at each end) the symbols that
cover the middle of a window of 20 words are the same wherever that window stands.

1. The first 10 words of every high-level symbol meet by hash ranges; those that occur once can be in no repeat.
2. Windows whose middle symbol is shared are candidates; their full word sequences meet by hash ranges.
3. The windows that are not the first of their kind mark words for removal.

Runs of one word stay unmerged: a run's name would depend on all of its extent, of which a window may hold a part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import U64, Words, in_chunks, mix, rolling, stage, to_bytes, width

ROUNDS = 3
_FLUSH = 1_500_000
_LAST = (1 << 63) - 1


def _edge(rounds: int) -> int:
    return (1 << rounds) - 1


def symbol_starts(hashes: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The places, in ``hashes``, of the first words of the symbols after ``rounds`` rounds. Symbols stay within a text."""
    names, starts, owner = hashes, np.arange(len(hashes)), text_of
    for k in range(rounds):
        right = (mix(names + U64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)) >> U64(63)).astype(bool)
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
        at = np.flatnonzero(pair)
        names = names.copy()
        names[at] = mix(names[at] * U64(0x9E3779B97F4A7C15) + mix(names[at + 1]) + U64(k))
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, starts, owner = names[keep], starts[keep], owner[keep]
    return starts


def _texts(texts: list[bytes], window: int):
    """For runs of texts: their words, each word's text, symbol starts and each word's symbol."""
    for first, last in in_chunks(texts):
        words = Words(texts[first:last])
        text_of = np.repeat(np.arange(last - first), words.counts)
        starts = symbol_starts(words.hashes, text_of) if len(words.hashes) else np.zeros(0, int)
        yield first, words, text_of, starts


class _Packer:
    """Gathers (hash, text, place) of many documents and gives one row of blobs for each range of hashes."""

    names = ("frag", "dids", "marks", "counts", "hashes", "places")

    def __init__(self, fragments: int, hash_type: str):
        self.fragments, self.hash_type = fragments, hash_type
        self.reset()

    def reset(self) -> None:
        self.keys, self.hashes, self.owners, self.places, self.size = [], [], [], [], 0

    def add(self, keys: list[tuple[int, int]], hashes: np.ndarray, owner: np.ndarray, places: np.ndarray) -> None:
        self.owners.append(owner + len(self.keys))
        self.keys += keys
        self.hashes.append(hashes)
        self.places.append(places)
        self.size += len(hashes)

    def rows(self) -> list[tuple]:
        out = []
        if self.size:
            hashes, owner, places = (np.concatenate(x) for x in (self.hashes, self.owners, self.places))
            keys = np.array(self.keys, np.int64)
            frag = ((hashes >> U64(32)) * U64(self.fragments) >> U64(32)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            edges = np.searchsorted(frag[order], np.arange(self.fragments + 1))
            place_type = "<u2" if places.max() < 1 << 16 else "<u4"
            for f in np.flatnonzero(np.diff(edges)):
                at = order[edges[f] : edges[f + 1]]
                who, counts = np.unique(owner[at], return_counts=True)
                out.append((int(f), keys[who, 0].tobytes(), keys[who, 1].tobytes(), counts.astype("<u4").tobytes(),
                            hashes[at].astype(self.hash_type).tobytes(), places[at].astype(place_type).tobytes()))
        self.reset()
        return out


PACKED = "frag int, dids binary, marks binary, counts binary, hashes binary, places binary"


def _unpack(pdf: pd.DataFrame, hash_type: str):
    join = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
    counts = join("counts", "<u4")
    hashes = join("hashes", hash_type)
    sizes = [len(p) // (len(h) // np.dtype(hash_type).itemsize) for p, h in zip(pdf["places"], pdf["hashes"], strict=True)]
    places = np.concatenate([np.frombuffer(p, f"<u{s}").astype(np.uint32) for p, s in zip(pdf["places"], sizes, strict=True)])
    return hashes, np.repeat(join("dids", np.int64), counts), np.repeat(join("marks", np.int64), counts), places


def _to_owners(did: np.ndarray, mark: np.ndarray, places: np.ndarray, owners: int) -> pd.DataFrame:
    """Places on their way back to their documents: a row for each of ``owners`` groups of documents."""
    order = np.lexsort((places, mark, did))
    did, mark, places = did[order], mark[order], places[order].astype("<u4")
    edges = np.flatnonzero(np.concatenate(([True], (did[1:] != did[:-1]) | (mark[1:] != mark[:-1]), [True]))) if len(did) else np.zeros(1, int)
    did, mark, counts = did[edges[:-1]], mark[edges[:-1]], np.diff(edges)
    group = (mix(did.view(U64) ^ mix(mark.view(U64))) % U64(owners)).astype(np.int64)
    rows = []
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        own = np.concatenate([places[edges[i] : edges[i + 1]] for i in at])
        rows.append((int(g), did[at].tobytes(), mark[at].tobytes(), counts[at].astype("<u4").tobytes(), own.tobytes()))
    return pd.DataFrame(rows, columns=["owner", "dids", "marks", "counts", "places"])


_OWNED = "owner int, dids binary, marks binary, counts binary, places binary"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group of documents: a row for each with all of its places."""
    join = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
    counts = join("counts", "<u4")
    did, mark, places = np.repeat(join("dids", np.int64), counts), np.repeat(join("marks", np.int64), counts), join("places", "<u4")
    order = np.lexsort((mark, did))
    did, mark, places = did[order], mark[order], places[order]
    edges = np.flatnonzero(np.concatenate(([True], (did[1:] != did[:-1]) | (mark[1:] != mark[:-1]), [True])))
    return pd.DataFrame({"did": did[edges[:-1]], "mark": mark[edges[:-1]], "places": [places[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]})


def _shared(pdf: pd.DataFrame, owners: int) -> pd.DataFrame:
    """The places whose words occur more than once in this range of hashes."""
    hashes, did, mark, places = _unpack(pdf, "<u4")
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    at = order[same[1:] | same[:-1]]
    return _to_owners(did[at], mark[at], places[at], owners)


def _later(pdf: pd.DataFrame, owners: int) -> pd.DataFrame:
    """The places of windows of which an equal one starts earlier."""
    hashes, did, mark, places = _unpack(pdf, "<u8")
    order = np.lexsort((places, mark, did, hashes))
    hashes, did, mark, places = hashes[order], did[order], mark[order], places[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (did != did[head]) | (mark != mark[head]) | (places != places[head])
    return _to_owners(did[later], mark[later], places[later], owners)


def substring_dedup(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept] of every row.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` consecutive words that covers
    it also starts earlier: in a document with a smaller doc_id (nulls last; rows that share one, in order of a hash of
    their text) or earlier in the same one. Rows equal in doc_id and text count as one and get the same result. Null and
    empty texts have no words; the digest is then that of an empty string. Kept words are joined by one space.
    Other columns are not read; an empty table gives no rows. Windows are told apart by 64-bit hashes of their words.
    """
    if window - 2 * _edge(ROUNDS) < 2:
        raise ValueError("window too short for the number of rounds")
    middle = window // 2
    owners = width(docs.sparkSession)
    fragments = max(1, owners // 3)
    keyed = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("mark"), "text"
    )

    def anchors(batches):
        packer = _Packer(fragments, "<u4")
        for pdf in batches:
            keys = list(zip(pdf["did"].tolist(), pdf["mark"].tolist(), strict=True))
            for first, words, text_of, starts in _texts(to_bytes(pdf["text"].array), window):
                grams = rolling(words.hashes, middle)
                starts = starts[starts < len(grams)]
                starts = starts[starts + middle <= words.ends[text_of[starts]]]
                owner = text_of[starts]
                packer.add(keys[first : first + len(words.counts)], grams[starts], owner, starts - words.begins[owner])
                if packer.size > _FLUSH:
                    yield pd.DataFrame(packer.rows(), columns=packer.names)
        yield pd.DataFrame(packer.rows(), columns=packer.names)

    def meet(packed: DataFrame, rule, name: str) -> DataFrame:
        """(did, mark, places): what ``rule`` finds in each range of hashes, gathered for each document."""
        found = packed.repartition(fragments, "frag").groupBy("frag").applyInPandas(lambda pdf: rule(pdf, owners), _OWNED)
        return stage(found.groupBy("owner").applyInPandas(_gather, "did long, mark long, places binary"), name)

    shared = meet(keyed.select("did", "mark", "text").mapInPandas(anchors, PACKED), _shared, "shared-anchors")

    def candidates(batches):
        packer, press = _Packer(fragments, "<u8"), zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            docs_out, texts = [], to_bytes(pdf["text"].array)
            keys = list(zip(pdf["did"].tolist(), pdf["mark"].tolist(), strict=True))
            spots, ids = pdf["places"].tolist(), [None if pd.isna(d) else int(d) for d in pdf["doc_id"].array]
            for first, words, text_of, starts in _texts(texts, window):
                known = np.zeros(len(words.hashes) + 1, bool)
                for i in range(len(words.counts)):
                    if spots[first + i] is not None:
                        known[words.begins[i] + np.frombuffer(spots[first + i], "<u4")] = True
                whole = rolling(words.hashes, window)
                p = np.flatnonzero(known[:-1][starts]) if len(starts) else np.zeros(0, int)
                # The windows whose middle word lies in a shared symbol.
                inside = np.zeros(len(words.hashes) + 1, np.int32)
                stops = np.append(starts[1:], len(words.hashes))
                np.add.at(inside, starts[p], 1)
                np.add.at(inside, stops[p], -1)
                at = np.flatnonzero(np.cumsum(inside)[:-1]) - middle
                at = at[(at >= 0) & (at < len(whole))]
                owner = text_of[at + middle]
                fits = (at >= words.begins[owner]) & (at + window <= words.ends[owner])
                at, owner = at[fits], owner[fits]
                packer.add(keys[first : first + len(words.counts)], whole[at], owner, at - words.begins[owner])
                touched = np.bincount(owner, minlength=len(words.counts))
                for i, n in enumerate(words.counts.tolist()):
                    text = texts[first + i]
                    row = (ids[first + i], *keys[first + i], n)
                    docs_out.append((*row, None, press.compress(text)) if touched[i] else (*row, _kept(text, None)[0], None))
            frame = pd.DataFrame(docs_out, columns=["doc_id", "did", "mark", "n_words", "sha", "packed"], dtype=object)
            packed = pd.DataFrame(packer.rows() if packer.size > _FLUSH else [], columns=packer.names, dtype=object)
            yield _both(frame, packed)
        yield _both(pd.DataFrame([], columns=["doc_id", "did", "mark", "n_words", "sha", "packed"], dtype=object), pd.DataFrame(packer.rows(), columns=packer.names, dtype=object))

    def finish(batches):
        undo = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for doc_id, n, sha, packed, places, text in zip(pdf["doc_id"].array, pdf["n_words"], pdf["sha"], pdf["packed"], pdf["places"], pdf["text"], strict=True):
                removed, kept = 0, None
                if packed is not None or keep_text:
                    raw = undo.decompress(packed) if packed is not None else to_bytes([text])[0]
                    at = np.frombuffer(places or b"", "<u4").astype(np.int64)
                    cover = np.zeros(n + 1, np.int32)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed = int(gone.sum())
                    sha, kept = _kept(raw, gone)
                rows.append((doc_id, n, removed, sha, kept.decode("utf-8", "replace") if keep_text else None))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    met = stage(
        keyed.join(shared, ["did", "mark"], "left").select("doc_id", "did", "mark", "text", "places")
        .mapInPandas(candidates, f"doc_id long, did long, mark long, n_words long, sha string, packed binary, {PACKED}"),
        "candidates",
    )
    windows = met.where("frag is not null").select("frag", "dids", "marks", "counts", "hashes", "places")
    later = meet(windows, _later, "later")
    rows = met.where("n_words is not null").select("doc_id", "did", "mark", "n_words", "sha", "packed")
    touched = rows.where("packed is not null").join(later, ["did", "mark"], "left").withColumn("text", F.lit(None).cast("string"))
    clean = rows.where("packed is null")
    if keep_text:
        once = keyed.select("did", "mark", "text").dropDuplicates(["did", "mark"])
        touched = touched.unionByName(clean.join(once, ["did", "mark"]).withColumn("places", F.lit(None).cast("binary")))
    columns = ["doc_id", "n_words", "sha", "packed", "places", "text"]
    done = touched.select(*columns).mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    if keep_text:
        return done
    return done.drop("kept").union(clean.select("doc_id", "n_words", F.lit(0).cast("long"), "sha"))


def _kept(text: bytes, gone: np.ndarray | None) -> tuple[str, bytes]:
    words = text.split()  # bytes.split() takes just ASCII white space
    kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g])
    return hashlib.sha256(kept).hexdigest(), kept


def _both(docs: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    out = pd.concat([docs, packed], ignore_index=True)  # of objects: 64-bit marks must not pass through floats
    out = out.where(out.notna(), None)
    return out.astype({c: "Int64" for c in ("doc_id", "did", "mark", "n_words", "frag")})
