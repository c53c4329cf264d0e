"""Byte-level BPE by Spark's own functions: texts to token ids by a rank file, and ids back to bytes.

A text's words are the matches of a pattern. A word's ids are a fold of merges over its array of bytes: each step joins the leftmost
of the adjacent pairs whose union has the lowest rank, until no union has one. Ranks come from pairs of ids in one array, read by
place. Distinct words are folded as a table: the commonest ones, of bounded number and length. This memo and the arrays are
written tables of one row each, which the encoding reads as scalar subqueries. All other words are folded where they stand, so no
text is shuffled. A text's ids are a string with a sign for each, the character of that code point.

Long words are cut at pairs of bytes that no token holds, which no merge can cross; in what remains longer, a step makes all
merges of the lowest rank up to the first that brings a still lower one, which are the same merges in the same order.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import stage, unstage

#: Words of the memo, at most, and the longest of them in characters: together they bound what is sent to every task.
MEMO, MEMO_CHARS = 1 << 19, 32
#: Texts that these words are counted in, about.
MEMO_ROWS = 40_000
#: Bytes from which on a word is cut and merged by rounds.
LONG = 64
#: More than ids, so that ids are the lower bits of an element; places of the table of pairs; more than ranks.
_SLOTS, _PLACES, _NONE = 1 << 18, 1 << 19, 1 << 20
#: The tables that the fold reads.
_FOLD = ("entries", "shift", "sure", "left", "right", "byte", "bytes", "crossed", "signs")
#: Code points from which on signs leave out the surrogates.
_SURROGATES = 0xD800
#: Of the memo's strings: before and after a word, and after its signs. No sign is one of them; a word that has one is not looked up.
_WORD, _END = "\U0010fffe", "\U0010ffff"


def let(value: Column, body) -> Column:
    """``body`` of a value that is reckoned once however often it is used: the end of a fold of no steps, which asks for no types on the way."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def sign(i: int) -> str:
    return chr(i if i < _SURROGATES else i + 0x800)


def own(element: Column) -> Column:
    """The id of an element of the fold."""
    return element.bitwiseAND(_SLOTS - 1)


def fields_of(t: Column, names: tuple[str, ...], body, *got: Column) -> Column:
    """``body`` of a struct's fields by name, each taken out once: taking a field costs as much as a step of arithmetic."""
    if len(got) == len(names):
        return body(dict(zip(names, got, strict=True)))
    return let(t[names[len(got)]], lambda v: fields_of(t, names, body, *got, v))


class Ranks:
    """A rank file: ``pieces`` by id, and the tables that the expressions read, as a row.

    The union of two ids a, b stands in ``entries`` at the shift of a + b, as its rank and a: shifts are such that no two pairs
    meet. An id more than the file has, ``edge``, is in no pair.

    By two neighbouring bytes, of which the second may be none (256): ``left`` has the lowest rank of the pieces that end in
    them, ``right`` of those that begin with them, ``byte`` the first one's id. ``sure`` has their union's rank, unless a union
    that it is a part of has a lower one. Where it is below the ``left`` of the pair before and the ``right`` of the pair after, no merge takes
    one of the two bytes before they are merged, and what their union is a part of comes later; so this merge may be made first.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.edge = max(self.ranks.values()) + 1
        if self.edge >= _SLOTS:
            raise ValueError(f"ids of {_SLOTS} and more")
        self.pieces = [b""] * self.edge
        self.unmade: dict[str, list[int]] | None = None
        crossed, pairs, ranks = np.zeros(1 << 16, np.int64), [], []
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
            for cut in range(1, len(piece)):
                crossed[piece[cut - 1] << 8 | piece[cut]] = 1
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b))
                    ranks.append(rank)
        a, b = np.array(pairs, np.int64).T
        ranks = np.array(ranks, np.int64)
        order = np.argsort(a, kind="stable")
        starts = np.searchsorted(a[order], np.arange(self.edge + 1))
        shift, entries, free = np.zeros(self.edge + 1, np.int64), np.full(_PLACES + _SLOTS, -1, np.int64), self.edge
        for g in np.argsort(starts[:-1] - starts[1:], kind="stable").tolist():  # the ids with most pairs choose first
            at = b[order[starts[g] : starts[g + 1]]]
            if not len(at):
                break
            if len(at) == 1:
                while entries[free] >= 0:
                    free += 1
                d = free - int(at[0])
            else:  # from anywhere: near the last ones little is free
                tries = ((g * 40503 + k) % _PLACES for k in range(_PLACES))
                d = next((d for d in tries if (entries[at + d] < 0).all()), _PLACES)
            if d >= _PLACES:
                raise ValueError("no table of pairs was found")
            shift[g] = d
            entries[at + d] = ranks[order[starts[g] : starts[g + 1]]] * _SLOTS + g
        ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        sure, left, right = (np.full((256, 257), _NONE, np.int32) for _ in range(3))
        early = np.zeros(self.edge, bool)
        early[a[ranks < a]] = early[b[ranks < b]] = True
        for piece, rank in self.ranks.items():
            if len(piece) > 1:
                left[piece[-2], piece[-1]] = min(left[piece[-2], piece[-1]], rank)
                right[piece[0], piece[1]] = min(right[piece[0], piece[1]], rank)
            if len(piece) == 2 and not early[rank]:
                sure[piece[0], piece[1]] = rank
        self.tables = pa.table({
            "entries": pa.array([entries]), "shift": pa.array([shift.astype(np.int32)]), "sure": pa.array([sure.ravel()]), "left": pa.array([left.ravel()]),
            "right": pa.array([right.ravel()]), "byte": pa.array([np.repeat(ids, 257).astype(np.int32)]),
            "bytes": pa.array([ids.astype(np.int32)]), "crossed": pa.array([crossed.astype(np.int32)]), "signs": pa.array([[sign(i) for i in range(self.edge)]]),
            "pieces": pa.array([[p.decode("latin-1") for p in self.pieces]]), "ids": pa.array([[n.to_bytes(4, "little").hex() for n in range(self.edge)]]),
        })

    def literal(self, *fields: str) -> Column:
        """The tables as a column without inputs, which the optimizer turns into one literal; only the fields named."""
        kind = ",".join(f"{k}:array<{'string' if pa.types.is_string(t.value_type) else 'bigint' if t.value_type == pa.int64() else 'int'}>" for k in fields for t in [self.tables.schema.field(k).type])
        return F.from_json(F.lit(json.dumps(self.tables.select(fields).to_pylist()[0])), f"struct<{kind}>")


@functools.lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


# Expressions; ``t`` is the literal's tables.

def _pair(t: dict[str, Column]):
    def element(a: Column, b: Column) -> Column:
        """``a`` with, above its bits, the rank of its union with ``b``; ``_NONE`` where there is no union or no ``b``."""
        # Another id's entry, or none, has other lower bits.
        return let(F.get(t["entries"], F.get(t["shift"], a) + b), lambda e: F.when(own(e) == a, e).otherwise(a + _NONE * _SLOTS))

    return element


def _ranked(ids: Column, rank) -> Column:
    """State of the fold: ids, and the rank of each with the one after it."""
    return let(ids, lambda v: F.struct(v.alias("ids"), F.zip_with(v, F.slice(v, 2, F.size(v)), rank).alias("ks")))


def _steps(ids: Column, rank, step) -> Column:
    """The fold, between two edges, of at most as many steps as there are merges."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 3, F.lit(1))), _ranked(ids, rank), step)["ids"]


def _merges(t: dict[str, Column], v: Column) -> Column:
    """The fold's elements of bytes ``v``, one merge a step.

    An element of the fold is an id with, above its bits, the rank of the union with the next one, or ``_NONE``. So the least
    element is a merge to make, and the leftmost of its equals the one: unions of one rank are of the same two ids. A step
    leaves out the second of the two, and reckons the first and the one before it anew. Before the fold, all merges of two
    bytes are made that are sure.
    """
    element = _pair(t)
    next_to = lambda v, pair: F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), pair)

    def sure(codes: Column) -> Column:
        """Ids after these merges; theirs have a bit more, by which the second byte is left out."""
        beside = lambda i: F.least(F.get(t["left"], F.get(codes, i - 1)), F.get(t["right"], F.get(codes, i + 1)))
        ids = F.transform(codes, lambda c, i: let(F.get(t["sure"], c), lambda r: F.when(r < beside(i), r + _NONE).otherwise(F.get(t["byte"], c))))
        return let(ids, lambda ids: F.filter(ids, lambda _, i: F.coalesce(F.get(ids, i - 1) < _NONE, F.lit(True))))

    def fold(ids: Column) -> Column:
        start = next_to(ids, lambda a, b: element(own(a), own(b)))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), start, step)

    def step(s: Column, _: Column) -> Column:
        def merged(low: Column) -> Column:
            def at(p: Column) -> Column:  # counts from 1
                made = F.shiftright(low, 18).cast("int")
                around = lambda x, i: F.when(i == p - 1, element(made, own(F.get(s, p + 1)).cast("int"))).when(i == p - 2, element(own(x).cast("int"), made)).otherwise(x)
                return F.transform(F.filter(s, lambda _, i: i != p), around)

            return let(F.array_position(s, low).cast("int"), at)

        return let(F.array_min(s), lambda low: F.when(low < _NONE * _SLOTS, merged(low)).otherwise(s))

    codes = next_to(v, lambda x, y: x * 257 + F.coalesce(y, F.lit(256)))
    return let(let(codes, sure), fold)


def _rounds(ids: Column, rank) -> Column:
    """All merges of the lowest rank in a step, as far as none of them brings a lower rank."""

    def step(s: Column, _: Column) -> Column:
        def merged(low: Column) -> Column:
            # Of overlapping merges every second one is made, from the left.
            flags = F.split(F.replace(F.array_join(F.transform(s["ks"], lambda k: F.when(k == low, "1").otherwise("0")), ""), F.lit("11"), F.lit("10")), "")
            joined = low.cast("int")

            def chosen(on: Column) -> Column:
                def bad(i: Column) -> Column:
                    before = F.when(F.get(on, i - 2) == "1", joined).otherwise(F.get(s["ids"], i - 1))
                    return (F.get(on, i) == "1") & ((rank(before, joined) < low) | (rank(joined, F.get(s["ids"], i + 2)) < low))

                first = F.coalesce(F.array_min(F.filter(F.transform(s["ks"], lambda k, i: F.when(bad(i), i)), lambda i: i.isNotNull())), F.size(s["ks"]))

                def made(stop: Column) -> Column:
                    here = lambda i: (F.get(on, i) == "1") & (i <= stop)
                    return F.filter(F.transform(s["ids"], lambda x, i: F.when(here(i), joined).when(here(i - 1), -1).otherwise(x)), lambda x: x >= 0)

                return let(first, made)

            return _ranked(let(flags, chosen), rank)

        return let(F.array_min(s["ks"]), lambda low: F.when(low < _NONE, merged(low)).otherwise(s))

    return _steps(ids, rank, step)


def _folded(t: dict[str, Column], ranks: Ranks, word: Column) -> Column:
    """The signs of a word's ids, by merging."""
    rank, end = lambda a, b: F.shiftright(_pair(t)(a, b), 18).cast("int"), F.array(F.lit(ranks.edge))
    chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # a character for each byte
    between = lambda ids: F.concat(end, ids, end)
    inside = lambda ids: F.transform(F.filter(ids, lambda x: x != ranks.edge), lambda x: x.cast("long"))

    def cut(v: Column) -> Column:
        n = F.size(v)
        cuts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(t["crossed"], F.get(v, i - 1) * 256 + F.get(v, i)) == 0)
        parts = let(cuts, lambda c: F.zip_with(F.concat(F.array(F.lit(0)), c), F.concat(c, F.array(n)), lambda a, b: F.slice(v, a + 1, b - a)))
        rounds = lambda p: inside(_rounds(between(F.transform(p, lambda b: F.get(t["bytes"], b))), rank))
        return F.flatten(F.transform(parts, lambda p: F.when(F.size(p) + 2 <= LONG, _merges(t, p)).otherwise(rounds(p))))

    ids = let(F.transform(chars, F.ascii), lambda v: F.when(F.octet_length(word) <= LONG, _merges(t, v)).otherwise(cut(v)))
    return F.array_join(F.transform(ids, lambda x: F.get(t["signs"], own(x).cast("int"))), "")


def words_of(text: Column, pattern: str) -> Column:
    """The pattern's matches; its classes are Unicode's, as in the libraries that read such files."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def _odd(text: Column) -> Column:
    """Whether a text has one of the memo's own signs."""
    return F.contains(text, F.lit(_WORD)) | F.contains(text, F.lit(_END))


class ByteBpe:
    """Encoding and decoding by one rank file and pattern; ``memo`` holds the signs of some words, whichever they are."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.ranks, self.pattern = spark, ranks_of(path), pattern
        self.tables = stage(spark.createDataFrame(self.ranks.tables), "byte-bpe-tables")
        if self.ranks.unmade is None:
            self.ranks.unmade = self._unmade()
        self._remember(None, 0)

    def _unmade(self) -> dict[str, str]:
        """Words that are pieces have their own id, also those, if any, that merging would not make of their bytes."""
        pieces = []
        for piece, rank in self.ranks.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                pieces.append((piece.decode(), sign(rank)))
        words = self.spark.createDataFrame(pieces, "word string, own string")
        found = self._encoded(words).where("signs <> own").collect()
        if any(_WORD in r.word or _END in r.word for r in found):
            raise ValueError("a piece with the memo's own signs")
        return {r.word: r.own for r in found}

    def _encoded(self, words: DataFrame) -> DataFrame:
        words = words.repartition(self.spark.sparkContext.defaultParallelism)
        own = words.columns
        return self.with_tables(words, *_FOLD).select(*own, let(F.col("t"), lambda t: fields_of(t, _FOLD, lambda t: _folded(t, self.ranks, F.col("word")))).alias("signs"))

    def _slot(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self._slots)).cast("int")

    def _remember(self, words: DataFrame | None, n: int) -> None:
        """Words with their signs become strings, by slot; of equal words the last counts."""
        own = self.spark.createDataFrame([(*r, 1) for r in self.ranks.unmade.items()], "word string, signs string, last int")
        words = own if words is None else words.select("word", "signs", F.lit(0).alias("last")).union(own)
        self._slots = 1 << ((n + len(self.ranks.unmade)) // 4).bit_length()
        entry = F.concat(F.lit(_WORD), "word", F.lit(_WORD), "signs", F.lit(_END))
        slots = words.groupBy(self._slot(F.col("word")).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("last", entry.alias("entry")))).alias("own"))
        slots = slots.select("slot", F.concat(F.lit(_END), F.array_join("own.entry", "")).alias("entries"))
        every = self.spark.range(self._slots).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
        row = every.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("entries", F.lit(_END)).alias("entries")))).alias("all"))
        self.memo = stage(row.select(F.col("all.entries").alias("memo")), "byte-bpe-memo")

    def learn(self, texts: DataFrame, column: str = "text", rows: int = MEMO_ROWS) -> None:
        """The commonest words of about ``rows`` texts, chosen by hash, become the memo: distinct words, encoded as a table, ``MEMO`` at most.

        Which words these are changes how long encoding takes, not what it gives.
        """
        total = texts.count()
        some = texts.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(total, 1))) + 1))
        words = some.select(F.explode(words_of(F.col(column), self.pattern)).alias("word")).where((F.length("word") <= MEMO_CHARS) & ~_odd(F.col("word")))
        counts = stage(words.groupBy("word").agg(F.least(F.count("*"), F.lit(1000)).cast("int").alias("n")), "byte-bpe-words")
        least, taken = 1001, 0
        for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
            if taken + r.words > MEMO:
                break
            least, taken = r.n, taken + r.words
        before = self.memo
        self._remember(self._encoded(counts.where(F.col("n") >= least).select("word")), taken)
        unstage(counts, before)

    def with_tables(self, df: DataFrame, *fields: str) -> DataFrame:
        """``df`` and the tables' fields named, as column ``t``. Who reads it reads it once, so the optimizer puts the subquery there and no row holds it."""
        return df.select("*", self.tables.select(F.struct(*fields)).scalar().alias("t"))

    def _of_text(self, t: Column, memo: Column, text: Column) -> Column:
        values = F.struct(t.alias("t"), memo.alias("memo"), words_of(text, self.pattern).alias("words"), F.coalesce(_odd(text), F.lit(False)).alias("odd"))

        def of_text(c: dict[str, Column]) -> Column:
            def known(w: Column) -> Column:  # empty: not there
                after = F.call_function("substring_index", F.get(c["memo"], self._slot(w)), F.concat(F.lit(_WORD), w, F.lit(_WORD)), F.lit(-1))
                return F.when(~(c["odd"] & _odd(w)), F.substring_index(after, _END, 1)).otherwise("")

            one = lambda w, k: F.when(k != "", k).otherwise(_folded(c, self.ranks, w))
            return F.array_join(F.zip_with(c["words"], F.transform(c["words"], known), one), "")

        return let(values, lambda v: fields_of(v, ("memo", "words", "odd"), lambda c: fields_of(v["t"], _FOLD, lambda t: of_text(c | t))))

    def with_signs(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """``docs`` with ``signs`` for ``column``: the ids of its text, a sign for each; a null text is empty."""
        own = docs.columns
        both = self.with_tables(docs, *_FOLD).select("*", self.memo.select("memo").scalar().alias("memo"))
        signs = both.select(*own, self._of_text(F.col("t"), F.col("memo"), F.col(column)).alias("signs"))
        # A generated column is reckoned once, though others are made of it; for an array made on the spot no filter is inferred.
        return signs.select(*own, F.explode(F.array("signs")).alias("signs"))

    def of_signs(self, signs: Column) -> Column:
        """The ids of signs, an array of int."""
        point = lambda c: let(F.ascii(c), lambda x: F.when(x < _SURROGATES, x).otherwise(x - 0x800)) if self.ranks.edge > _SURROGATES else F.ascii(c)
        return F.transform(F.when(signs == "", F.array().cast("array<string>")).otherwise(F.split(signs, "")), point)

    def ids(self, text: Column) -> Column:
        """A text's ids, an array of int; a null text is empty. For single columns: tables and memo are literals here."""
        memo = F.from_json(F.lit(json.dumps(self.memo.first().memo)), "array<string>")
        return let(self._of_text(self.ranks.literal(*_FOLD), memo, text), self.of_signs)

    def little_endian(self, ids: Column) -> Column:
        """Ids as unsigned 32-bit integers in a row."""
        return let(self.ranks.literal("ids"), lambda t: F.unhex(F.array_join(F.transform(ids, lambda x: F.get(t["ids"], x)), "")))

    def signs_little_endian(self, signs: Column) -> Column:
        """The same of signs: where no id is beyond the surrogates, two bytes of each are the sign's in UTF-16, two are zeros."""
        if self.ranks.edge > _SURROGATES:
            return self.little_endian(self.of_signs(signs))
        spaced = F.concat(F.array_join(F.split(signs, ""), "\0"), F.lit("\0"))
        return F.when(signs == "", F.lit(b"")).otherwise(F.encode(spaced, "UTF-16LE"))

    def decoded(self, ids: Column, t: Column | None = None) -> Column:
        """The bytes of ids: their pieces in a row."""
        pieces = lambda t: F.array_join(F.transform(ids, lambda x: F.get(t["pieces"], x)), "")
        return F.encode(let(self.ranks.literal("pieces") if t is None else t, pieces), "ISO-8859-1")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded by the ranks of ``path`` and decoded again.

    A null text is empty; strings of special tokens are ordinary text. Null and repeated doc_ids are rows of their own. Columns other
    than doc_id and text are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    bpe = ByteBpe(docs.sparkSession, path, pattern)
    bpe.learn(docs)
    signs = bpe.with_tables(bpe.with_signs(docs).drop("text"), "pieces")
    return signs.select(
        "doc_id", F.length("signs").cast("long").alias("n_tokens"), F.sha2(bpe.signs_little_endian(F.col("signs")), 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(bpe.of_signs(F.col("signs")), F.col("t")), 256).alias("decoded_sha256"),
    )
