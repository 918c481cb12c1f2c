"""Repair of conversations against an exhaustive search."""

import hashlib
import heapq
import random
import zlib

import pytest

from millrace.llm import queries, turn_repair

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by the cheapest path, ties by the audit, over (row, state); state: the initials' last letter."""
    marks = faults(rows)
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(made)
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in nexts[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*made, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, made))
            if marks[i] not in ("blank", "duplicate"):
                extra = 5 if marks[i] else 0
                if role[:1] and role[:1] in nexts[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*made, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in nexts[state]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, r, (*made, (name, text))))


def expected(rows):
    """rows: (conv, turn, role, text) as they are after damage; by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        pairs = [(r or "", t or "") for _, _, r, t in mine]
        marks, turns = faults(pairs), [t for _, t, _, _ in mine if t is not None]
        cost, audit, made = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, sha)
    return out


def got(spark, rows, chunk):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, idx int")
    found, edited = turn_repair.repairs(df, chunk)
    shas = {r["conv"]: r["sha256"] for r in turn_repair.repaired_digests(df, edited).collect()}
    placed = {}
    for r in sorted(turn_repair.repaired_rows(df, edited).collect(), key=lambda r: (r["part"], r["place"])):
        placed.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    out = {}
    for r in found.collect():
        assert hashlib.sha256("\n".join(placed.get(r["conv"], [])).encode()).hexdigest() == shas[r["conv"]]
        out[r["conv"]] = (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), shas[r["conv"]])
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for i in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 2, 3])
            role = rng.choice(["user", "assistant"] if rng.random() < 0.3 else [["user", "assistant"][i % 2]]) if rng.random() < 0.93 else rng.choice(["system", "tool", "", "sys", "agent", None])
            text = rng.choice(["Fine.", "What?", " \n", "", "cut off", "Well! \t", None, "é ."]) if rng.random() < 0.5 else f"text {conv} {i}" + rng.choice([".", "!", "", "."])
            rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repairs_against_search(spark, chunk):
    rows = conversations(5, 60, 14)
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "Yes."), (70, None, "user", "first."), (70, None, "user", "first."), (70, 1, "assistant", "x" * 100_000 + "."), (71, None, "system", "only."), (72, 5, "system", "s."), (72, 6, "user", "u.")]
    assert got(spark, rows, chunk) == expected(rows)


def test_one_long_conversation_among_others(spark):
    rows = [(1, i, r, t) for i, (_, _, r, t) in enumerate(conversations(9, 40, 30))] + [(c + 2, t, r, x) for c, t, r, x in conversations(4, 12, 4)]
    assert got(spark, rows, 7) == expected(rows)


def test_vectors_converge_and_stitch():
    """A run from another end meets the known vectors, and then equals a full run."""
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choice([4, 8, 4, 8, 5, 7, 11, 12, 0, 6]) for _ in range(rng.randint(1, 30)))
        known, total = turn_repair.backwards(codes, turn_repair.AT_END)
        other = turn_repair.step(turn_repair.AT_END, rng.choice([4, 8, 7, 0]))[1]
        assert turn_repair.backwards(codes, other, known, total) == turn_repair.backwards(codes, other)


def test_empty_table(spark):
    assert got(spark, [], 4) == {}


def test_query_against_search(spark):
    sf = "/root/testdata/sf0.01"
    rows, ids = [], set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conv, turn, role, text = r["conv_id"], r["turn"], r["role"], r["text"]
        ids.add(conv)
        how = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        rows += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    theirs = expected(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ours = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in queries.op13_turn_repair(spark, sf).collect()}
    assert ours == {i: theirs.get(i, empty) for i in ids}
