"""Queries without SQL over a whole small table, against plain readings of what they state."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelweave.llm import queries
from pixelweave.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


def pieces(n, most):
    """Lengths of a document's pieces: whole ones, but for the first."""
    return [n] if n <= most else ([n % most] if n % most else []) + [most] * (n // most)


def best_fit(lengths, most):
    """How many bins best-fit decreasing takes, one length after the other."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(most - n)
    return len(room)


def test_packing(spark):
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want, lengths = [], []
    for r in queries.documents(spark, SF).select("doc_id", "text").collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, n in enumerate(pieces(len(ids), 2048)):
            want.append((r.doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            lengths.append(n)
            at += n
    rows = queries.QUERIES["op1_best_fit_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == best_fit(lengths, 2048)
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 2048


@pytest.mark.parametrize("words", [1, 47, 48, 49, 80, 81, 500])
def test_a_score_is_that_of_the_worst_window(words):
    from pixelweave.llm.toxicity import LENGTH, STRIDE, Read, forward, inputs, max_logit, new_model

    model = new_model(5)
    text = [f"w{k * k % 97}" for k in range(words)]
    starts = [0] + [s for s in range(STRIDE, words, STRIDE) if s + LENGTH - STRIDE < words]  # until one reaches the end
    covered = {k for s in starts for k in range(s, min(s + LENGTH, words))}
    assert covered == set(range(words))
    tops = []
    for s in starts:
        read = Read([" ".join(text[s : s + LENGTH]).encode()])
        places, _, real = read.windows()
        assert len(places) == 1
        tops.append(forward(model, inputs(read, model), places, real)[0][0])
    assert abs(max_logit(model, Read([" ".join(text).encode()]))[0] - max(tops)) < 1e-4


def test_mixing_stage(spark):
    """Every document as often as it is taken whole, and as many of its first words as remain."""
    import re
    from collections import Counter

    import corpus_pipeline
    from pixelweave.llm.mixing import mix_sources

    docs = queries.documents(spark, SF)
    taken = {r.doc_id: (r.taken, r["size"]) for r in mix_sources(docs).collect()}
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, size = taken[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert size == len(words)
        if size:
            want[r.doc_id, r.text] += n // size
            if n % size:
                want[r.doc_id, " ".join(words[: n % size])] += 1
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    assert got == +want


def test_toxicity_and_line_stages(spark):
    """The stages keep what their operators say."""
    import corpus_pipeline
    from pixelweave.llm.line_dedup import line_dedup
    from pixelweave.llm.toxicity import toxicity

    docs = queries.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, SF).collect()} == clean
    few = docs.where(F.length("text") < 2000)
    kept = {r.doc_id: r.text for r in line_dedup(few).collect() if r.lines_removed <= 0 or (r.text or "").strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, few, SF).collect()} == kept


def test_fingerprints(spark):
    """Likenesses are those of the sets of chains; a fingerprint has as many signatures as its set."""
    import hashlib

    import regex

    from pixelweave.llm.spotsigs import ANCHORS, CHAIN, to_text, with_signatures

    def chains(text):
        words = [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", text.lower()) if w]
        out, content = set(), [w for w in words if w not in ANCHORS]
        for i, w in enumerate(words):
            out.add((*words[i : i + CHAIN],))
            if w in ANCHORS:
                after = sum(x not in ANCHORS for x in words[:i])
                out.add((w, *content[after : after + CHAIN]))
        return out

    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    docs = sorted(((r.doc_id, r.text or "") for r in queries.documents(spark, SF).select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op9_spot_signatures"](spark, SF).collect()}
    assert len(got) == len(docs)
    edits = {}
    for k, (doc, text) in enumerate(docs):
        following, m, r = docs[(k + 1) % len(docs)][1], len(text) // 3, got[doc]
        edits[doc] = edited = text[: len(text) - m] + following[:m]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = chains(text)
        assert len(r.fingerprint) == 8 * len(own) and len(r.edited_fingerprint) == 8 * len(chains(edited))
        assert abs(r.near_edited - like(own, chains(edited))) < 1e-9 and abs(r.near_next - like(own, chains(following))) < 1e-9
    # The fingerprints are those of the texts by themselves.
    for column, texts in (("fingerprint", dict(docs)), ("edited_fingerprint", edits)):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        alone = {r.doc_id: r.f for r in with_signatures(df, "text", "sigs").select("doc_id", to_text(F.col("sigs")).alias("f")).collect()}
        assert all(alone[d] == got[d][column] for d in texts)


def test_stages_let_the_driver_give_memory_back(spark, monkeypatch):
    from pixelweave.llm import common

    monkeypatch.setattr(common, "_settled", -1e9)
    common.stage(spark.range(3), "small")
    assert common._settled > 0
