"""Conversation repair against a search over all edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pixelweave.llm import conversations
from pixelweave.llm.conversations import Repair, cheapest, repair_report

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows):
    """Dijkstra over (cost, labels, place, what the output so far ends with): the least pair, and the output."""
    heap, seen = [(0, "", 0, ".", ())], set()
    while heap:
        cost, labels, at, last, out = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ".a":
            return cost, labels, out
        follow = {".": "su", "s": "u", "u": "a", "a": "u"}[last]
        new = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 2, labels + "I", at, new[0], (*out, (new, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, labels + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[0] in follow:
                    heapq.heappush(heap, (cost + more, labels + "K", at + 1, role[0], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, labels + "R", at + 1, new[0], (*out, (new, text))))
    raise AssertionError


def expected(rows, harm=True):
    """conv_id -> values of the report, from rows (conv_id, turn, role, text)."""
    want = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20 if harm else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in after:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, _, _ in after if t is not None}
        cost, labels, out = search(judged)
        illegal = sum(p[0][:1] + q[0][:1] not in ("su", "ua", "au") for p, q in zip(judged, judged[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, labels, digest)
    return want


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_least_path_of_random_rows():
    rng = random.Random(1)
    kinds = {"": 0, "truncated": 1, "blank": 2}
    for _ in range(3000):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant", ""]), "t", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randint(0, 9))]
        given = [(r[:1] if r[:1] in ("s", "u", "a") else "", kinds[f], 1) for r, _, f in rows]
        assert cheapest(given) == search(rows)[:2]


def test_report_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(repair_report(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def made_up(rng, n):
    texts = ["Yes.", "No!", "cut short", "", "  ", "Why?", "a b c. ", None]
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


def one_row_a_turn(rows):
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("range_rows", [200_000, 7])
def test_odd_rows_and_pieces(spark, monkeypatch, range_rows):
    monkeypatch.setattr(conversations, "RANGE_ROWS", range_rows)
    rng = random.Random(5)
    rows = one_row_a_turn(made_up(rng, 150)) + [(7, k, "user" if k % 2 else "assistant", f"text {k % 5}.") for k in range(300)] + [(8, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as piece", "2 as n", "3 as mark", "4 as labels")
    assert found(repair_report(df)) == expected(rows)


def test_all_repeated_rows_and_no_rows(spark):
    rows = [(1, 5, "user", "Same.")] * 400 + [(2, k, "assistant", "Same.") for k in range(50)] + [(3, (1 << 62) + k, "user", "Long.") for k in range(3)]
    assert found(repair_report(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    dropped = next(k for k in range(100) if zlib.crc32(f"9:{k}".encode()) % 20 == 0)
    got = found(repair_report(spark.createDataFrame([(9, dropped, "user", "Hi.")], SCHEMA)))
    assert got == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows_follow_the_grammar(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RANGE_ROWS", 20)
    rows = one_row_a_turn(made_up(random.Random(8), 200))
    repair = Repair(spark.createDataFrame(rows, SCHEMA))
    want = expected(rows, harm=False)
    got = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r.piece, r.j)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, values in want.items():
        out = got.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest() == values[-1]
