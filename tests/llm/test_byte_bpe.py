"""Byte-level BPE against the library that such rank files are made for."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pixelweave.llm import byte_bpe
from pixelweave.llm.byte_bpe import ByteBpe, encode_and_decode, ranks_of

SF = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def path(request):
    return public_tokenizers.path(request.param)


def library(path):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(path).ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    signs = "ab é\n\t .,;:!?'\"s1漢 ²_-|#<ſ  \x85　\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    long = ["a" * 500, "=" * 1000, " " * 3000 + "x", "ab" * 300, "aab" * 200, "abc" * 100 + "the" * 50, "a" * 30_000, "漢字" * 900, "-+" * 400]
    return [*texts, *long, "'s" * 100, "<|endoftext|> it'll IT'LL", "", None]


def test_ids_are_the_librarys(spark, path):
    bpe, whole, texts = ByteBpe(spark, path, PATTERN), library(path), odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    bpe.learn(df, rows=50)
    ids = F.col("ids")
    for r in df.withColumn("ids", bpe.ids(F.col("text"))).select("k", "ids", bpe.little_endian(ids).alias("le"), bpe.decoded(ids).alias("back")).collect():
        text = texts[r.k] or ""
        assert list(r.ids) == whole.encode_ordinary(text), text[:80]
        assert bytes(r.le) == np.array(r.ids, "<u4").tobytes() and bytes(r.back) == text.encode()


def test_rounds_make_the_same_merges(spark, monkeypatch):
    """Words of all lengths by cuts and rounds, which are meant for long ones."""
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(7)
    texts = ["".join(rng.choice(("a", "b", "ab", "the", "aa", "in", "er")) for _ in range(rng.randint(2, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    whole = library(path)
    assert all(list(r.ids) == whole.encode_ordinary(r.text) for r in df.select("text", ByteBpe(spark, path, PATTERN).ids(F.col("text")).alias("ids")).collect())


def test_sure_merges(spark, tmp_path):
    """Merges made before the fold change nothing, also where pieces have lower ranks than what they are made of, as no trained file has them."""
    rng = random.Random(3)
    for k in range(3):
        pieces = sorted({"".join(rng.choice("abcde") for _ in range(rng.choice((2, 2, 3, 4, 5)))).encode() for _ in range(400)})
        rng.shuffle(pieces)
        every = [bytes([b]) for b in range(256)] + pieces
        (path := tmp_path / f"{k}.tiktoken").write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % rank for rank, p in enumerate(every)))
        tables, pairs = ranks_of(str(path)).tables, sum(len(p) == 2 for p in pieces)
        sure = np.array(tables["sure"][0].as_py()).reshape(256, 257)
        assert 0 < (sure < byte_bpe._NONE).sum() < pairs
        before, after = (np.array(tables[n][0].as_py()).reshape(256, 257) for n in ("left", "right"))
        made = [w for p in pieces if len(p) == 2 for x in b"abcde" for y in b"abcde" if sure[tuple(p)] < min(before[x, p[0]], after[p[1], y]) for w in [chr(x) + p.decode() + chr(y)]]
        words = made + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 16))) for _ in range(3000)]
        whole, df = library(str(path)), spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
        assert made
        for r in ByteBpe(spark, str(path), PATTERN)._encoded(df).collect():
            if r.word.encode() not in pieces:  # they have their own ids, which the memo knows
                assert [ord(c) for c in r.signs] == whole.encode_ordinary(r.word), r.word


def test_report(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole, docs = library(path), spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(None, "no id"), (1, "twice"), (1, "twice"), (2, None)]
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], "doc_id long, text string, n_tokens int, ids string, word string")

    def value(doc_id, text):
        ids = whole.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = encode_and_decode(df, path, PATTERN).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(value(*r)) for r in rows)
    assert encode_and_decode(df.limit(0), path, PATTERN).count() == 0


def test_memo(spark):
    """More distinct words than 65,536 are all looked up; the memo's own signs in a text change nothing; rows don't hold tables."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f" {a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:4]]
    df = spark.createDataFrame([("".join(words[k : k + 1000]),) for k in range(0, len(words), 1000)], "text string").repartition(4)
    bpe, whole = ByteBpe(spark, path, PATTERN), library(path)
    bpe.learn(df)
    entries = "".join(bpe.memo.first().memo)
    assert len(words) == entries.count(byte_bpe._WORD) // 2 > 1 << 16
    w, e = byte_bpe._WORD, byte_bpe._END
    odd = spark.createDataFrame([(t,) for t in (f" abca{w} abca{w}", f"{w}{e}", f" abca{e} abcb", f"x{w} abca{w}y", "", None)], "text string")
    for r in bpe.with_signs(df.union(odd)).collect():
        assert [ord(s) for s in r.signs] == whole.encode_ordinary(r.text or "")
    plan = bpe.with_signs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("scalar-subquery" in x and "aggregate(" not in x for x in plan.split("\n") if "Project" in x)
