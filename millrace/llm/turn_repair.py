"""Operator 13: the cheapest repair of each conversation's structure, by a Viterbi search that is parallel within a conversation.

Rows are range-partitioned by conversation and turn, so that a conversation with very many rows is spread over ranges, and cut into chunks.
Cost vectors run backwards: what each state still costs from a row on. A chunk doesn't know the vector at its end, so it starts
from a speculative one, as if the conversation ended there. Vectors that differ only by a constant lead to the same
decisions, and vectors converge: a fix-up pass runs a chunk again from the vector of the chunk behind it, back to the row
where old and new differ only by a constant, and passes go on until no chunk's end changes. The stitched vectors then drive the
search for the least audit: each chunk is traced from every state that it may be entered in, and these maps
are composed by doubling.

States: nothing yet, after a system row, after a user row (an answer is due), after an assistant row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared_files import Scratch, partitions_for, stored

#: White space, ends of sentences, costs of the edits.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: A row's fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Where a written user or assistant row leads from each state, and its role.
TAKE = (USER, USER, ASSISTANT, USER)
WRITTEN = ("user", "user", "assistant", "user")
#: Where a kept row of an initial (s, u, a, other) leads from each state.
KEEP = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
#: Costs when no row is left.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Rows of a chunk; bytes of a row in a shuffle.
CHUNK, ROW_BYTES = 4096, 96
#: Initials that may follow each other: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
KEY = ["conv", "turn", "role", "h1", "h2"]


@lru_cache(1 << 16)
def step(after: tuple, code: int) -> tuple[int, tuple]:
    """(constant, vector without it) in front of a row, from the vector behind it. code: initial * 4 + fault. Rows may be inserted in front."""
    initial, fault = divmod(code, 4)
    cost = []
    for s in range(4):
        best = DELETE + after[s]
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            best = min(best, REROLE + extra + after[TAKE[s]])
            if initial in KEEP[s]:
                best = min(best, extra + after[KEEP[s][initial]])
        cost.append(best)
    u, a = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    cost = [min(cost[NOTHING], INSERT + u), min(cost[SYSTEM], INSERT + u), u, a]
    least = min(cost)
    return least, tuple(c - least for c in cost)


@lru_cache(1 << 16)
def choose(after: tuple, code: int, state: int) -> tuple[str, int]:
    """(edits up to and with this row, state behind it): the first in ASCII among the cheapest."""
    initial, fault = divmod(code, 4)
    least, before = step(after, code)
    extra = TRUNCATED if fault == CUT else 0
    edits = ""
    while True:
        cost = least + before[state]
        if DELETE + after[state] == cost:
            return edits + "D", state
        if INSERT + before[TAKE[state]] == before[state]:
            edits, state = edits + "I", TAKE[state]
            continue
        if fault in (SOUND, CUT) and initial in KEEP[state] and extra + after[KEEP[state][initial]] == cost:
            return edits + "K", KEEP[state][initial]
        return edits + "R", TAKE[state]


def backwards(codes: bytes, end: tuple, known: bytes | None = None, constants: int = 0) -> tuple[bytes, int]:
    """(vector in front of each row and at the end, 4 bytes each; the sum of the constants). known: an earlier run's vectors; where the new one
    meets them but for a constant, the rest of them holds."""
    vectors, total, now = [bytes(end)], 0, end
    for i in range(len(codes) - 1, -1, -1):
        least, now = step(now, codes[i])
        total += least
        if known is not None and known[4 * i : 4 * i + 4] == bytes(now):
            behind = 0
            was = tuple(known[-4:])
            for j in range(len(codes) - 1, i - 1, -1):
                c, was = step(was, codes[j])
                behind += c
            return known[: 4 * i] + bytes(now) + b"".join(reversed(vectors)), constants - behind + total
        vectors.append(bytes(now))
    return b"".join(reversed(vectors)), total


def traced(codes: bytes, vectors: bytes, state: int, last: bool) -> tuple[str, int]:
    """(edits, state at the end) of a chunk entered in a state."""
    edits = []
    for i, code in enumerate(codes):
        some, state = choose(tuple(vectors[4 * i + 4 : 4 * i + 8]), code, state)
        edits.append(some)
    while last and state not in (NOTHING, ASSISTANT):
        edits.append("I")
        state = TAKE[state]
    return "".join(edits), state


def _light(df: DataFrame, cols: tuple[str, str, str, str]) -> DataFrame:
    """conv, turn, role, hashes of role and text, and a code without duplicates; and the text."""
    conv, turn, role, text = (F.col(c) for c in cols)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(*ENDS), SOUND).otherwise(CUT)
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4 + fault
    return df.select(conv.alias("conv"), turn.cast("long").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), code.cast("int").alias("code"), text.alias("text"))


def _schema(df: DataFrame, ddl: str) -> T.StructType:
    """conv as df has it, then the columns of ddl."""
    return T.StructType([df.schema["conv"], *T.StructType.fromDDL(ddl)])


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of sorted rows. open: bit 1 if the chunk before, bit 2 if the chunk behind may be of the same conversation; duplicates within a chunk are marked."""
    schema = _schema(rows, "part int, no long, open int, codes binary, turns array<bigint>, roles array<string>, h1s array<bigint>, h2s array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        held, conv, started, part, no, out = [], None, False, 0, 0, []
        open_before = 1

        def close(behind: int) -> None:
            nonlocal held, no, open_before
            seen, codes = set(), bytearray()
            for _, _, a, b, code in held:
                if code & 3 != BLANK and (a, b) in seen:
                    code = code & ~3 | DUPLICATE
                seen.add((a, b))
                codes.append(code)
            turns, roles, h1s, h2s, _ = zip(*held, strict=True)
            out.append({"conv": conv, "part": part, "no": no, "open": open_before | behind, "codes": bytes(codes), "turns": turns, "roles": roles, "h1s": h1s, "h2s": h2s})
            held, no = [], no + 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, types)
            out.clear()
            return made

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for row_conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "h1", "h2", "code")), strict=True):
                if started and row_conv != conv:
                    close(0)
                    open_before = 0
                elif len(held) == size:
                    close(2)
                    open_before = 1
                conv, started = row_conv, True
                held.append(row)
            if out:
                yield batch_of()
        if held:
            close(2)
            yield batch_of()

    return rows.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "h1", "h2", "code").mapInArrow(run, schema)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Adds idx, the chunk's place among all, and whether it is the first and the last of its conversation. The driver gets two rows for each range."""
    edges = chunks.groupBy("part").agg(F.count("*").alias("n"), F.min_by(F.struct("conv"), "no").alias("a"), F.max_by(F.struct("conv"), "no").alias("z")).orderBy("part").collect()
    rows, at = [], 0
    for i, e in enumerate(edges):
        rows.append((e["part"], at, i > 0 and edges[i - 1]["z"] == e["a"], i + 1 < len(edges) and edges[i + 1]["a"] == e["z"], e["n"]))
        at += e["n"]
    places = chunks.sparkSession.createDataFrame(rows, "part int, base long, goes_back boolean, goes_on boolean, n long")
    joined = chunks.join(F.broadcast(places), "part")
    back = F.col("open").bitwiseAND(1) > 0
    on = F.col("open").bitwiseAND(2) > 0
    first = ~F.when(F.col("no") == 0, F.col("goes_back")).otherwise(back)
    last = ~F.when(F.col("no") == F.col("n") - 1, F.col("goes_on")).otherwise(on)
    return joined.select((F.col("base") + F.col("no")).alias("idx"), "conv", first.alias("first"), last.alias("last"), "codes", "turns", "roles", "h1s", "h2s")


def _mapped(df: DataFrame, fn, **added: str) -> DataFrame:
    """Adds columns that fn computes of each row's dict."""
    kinds = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    schema = T.StructType([*(f for f in df.schema if f.name not in added), *kinds])
    keep = [f.name for f in schema if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            names = [c for c in fn.reads if c in batch.schema.names]
            rows = [fn(dict(zip(names, r, strict=True))) for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([r[c] for r in rows], types.field(c).type) for c in added)], [*keep, *added])

    return df.mapInArrow(run, schema)


def _reads(*names: str):
    def mark(fn):
        fn.reads = names
        return fn

    return mark


@_reads("codes", "first", "last")
def _guess(row: dict) -> dict:
    vectors, total = backwards(row["codes"], AT_END)
    whole = row["first"] and row["last"]
    return {"vectors": None if whole else vectors, "constants": total + (vectors[NOTHING] if row["first"] else 0), "edits": traced(row["codes"], vectors, NOTHING, True)[0] if whole else None}


@_reads("codes", "first", "vectors", "constants", "next")
def _fix(row: dict) -> dict:
    if row["next"] is None or row["vectors"][-4:] == row["next"]:
        return {"vectors": row["vectors"], "constants": row["constants"], "moved": False}
    own = row["constants"] - (row["vectors"][NOTHING] if row["first"] else 0)
    vectors, total = backwards(row["codes"], tuple(row["next"]), row["vectors"], own)
    return {"vectors": vectors, "constants": total + (vectors[NOTHING] if row["first"] else 0), "moved": vectors[:4] != row["vectors"][:4]}


@_reads("codes", "first", "last", "vectors")
def _paths(row: dict) -> dict:
    paths = [traced(row["codes"], row["vectors"], s, row["last"]) for s in ((NOTHING,) if row["first"] else range(4))]
    return {"paths": [p[0] for p in paths], "exits": [p[1] for p in paths]}


@_reads("codes", "again")
def _marked(row: dict) -> dict:
    codes = bytearray(row["codes"])
    for i in row["again"] or ():
        if codes[i] & 3 != BLANK:
            codes[i] = codes[i] & ~3 | DUPLICATE
    return {"codes": bytes(codes)}


def _across(split: DataFrame, scratch: Scratch) -> DataFrame:
    """Marks rows whose role and text an earlier chunk of the conversation has. A chunk counts once for each of its texts before anything meets."""
    each = split.select("idx", "conv", F.posexplode(F.arrays_zip("h1s", "h2s")).alias("at", "h")).select("idx", "conv", "at", "h.h1s", "h.h2s")
    mine = scratch.stored(each.groupBy("conv", "h1s", "h2s", "idx").agg(F.collect_list("at").alias("ats")), "hashes")
    first = mine.groupBy("conv", "h1s", "h2s").agg(F.min("idx").alias("least"))
    same = (mine["h1s"] == first["h1s"]) & (mine["h2s"] == first["h2s"]) & mine["conv"].eqNullSafe(first["conv"]) & (F.col("least") < F.col("idx"))
    again = mine.join(first, same).groupBy("idx").agg(F.flatten(F.collect_list("ats")).alias("again"))
    return _mapped(split.join(again, "idx", "left"), _marked, codes="binary").drop("again")


def _stitched(split: DataFrame, scratch: Scratch) -> DataFrame:
    """Fix-up passes over the chunks of conversations with several, until no chunk's end changes; then the edits of each chunk."""
    now = scratch.stored(split.select("idx", "conv", "first", "last", "codes", "vectors", "constants"), "vectors")
    while True:
        heads = now.select((F.col("idx") - 1).alias("idx"), F.substring("vectors", 1, 4).alias("next"))
        fixed = _mapped(now.join(heads, "idx", "left").withColumn("next", F.when(~F.col("last"), F.col("next"))), _fix, vectors="binary", constants="long", moved="boolean")
        fixed = scratch.stored(fixed, "vectors")
        now = fixed.drop("next", "moved")
        if fixed.where("moved").limit(1).count() == 0:
            break
    # The state in which a chunk is entered is a map of the one in which the chunk `back` is; maps are composed by doubling.
    paths = scratch.stored(_mapped(now, _paths, paths="array<string>", exits="array<int>").drop("vectors"), "paths")
    before = paths.select((F.col("idx") + 1).alias("idx"), F.col("idx").alias("back"), F.col("exits").alias("map"))
    entered = paths.select("idx", "first").join(before, "idx", "left").select("idx", F.when(~F.col("first"), F.col("back")).alias("back"), F.when(~F.col("first"), F.col("map")).alias("map"))
    open_map = F.when(F.size("map") == 4, F.col("map"))
    constant = F.when(F.size(F.array_distinct("map")) == 1, F.col("map")[0])
    entered = scratch.stored(entered.select("idx", F.when(F.col("back").isNull(), NOTHING).otherwise(constant).alias("state"), "back", open_map.alias("map")), "entered")
    while entered.where("state is null").limit(1).count():
        behind = entered.select(F.col("idx").alias("back"), F.col("state").alias("state_b"), F.col("back").alias("back_b"), F.col("map").alias("map_b"))
        both = entered.join(behind, "back", "left")
        composed = F.when(F.col("state_b").isNull(), F.transform("map_b", lambda s: F.get("map", s))).otherwise(F.col("map"))
        known = F.coalesce("state", F.when(F.col("state_b").isNotNull(), F.get("map", F.col("state_b"))))
        entered = scratch.stored(both.select("idx", known.alias("state"), F.when(known.isNull(), F.col("back_b")).alias("back"), composed.alias("map")), "entered")
    picked = paths.join(entered.select("idx", "state"), "idx")
    return picked.select("idx", "codes", "constants", "state", F.get("paths", F.when(F.col("first"), 0).otherwise(F.col("state"))).alias("edits"))


@_reads("codes", "turns")
def _summary(row: dict) -> dict:
    """Counts of a chunk, and what its neighbours need to know of it: initials and turns at its ends."""
    faults, initials = [0] * 4, [code >> 2 for code in row["codes"]]
    for code in row["codes"]:
        faults[code & 3] += 1
    turns = [t for t in row["turns"] if t is not None]
    distinct = sum(a != b for a, b in zip(turns, [None, *turns], strict=False))
    return {"faults": faults, "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False)), "initials": [initials[0], initials[-1]], "turns": [turns[0], turns[-1], distinct] if turns else None}


@_reads("parts")
def _totals(row: dict) -> dict:
    parts = row["parts"]
    faults = [sum(p["faults"][i] for p in parts) for i in range(4)]
    illegal = sum(p["illegal"] for p in parts) + sum((p["initials"][1], q["initials"][0]) not in LEGAL for p, q in zip(parts, parts[1:], strict=False))
    turns = [p["turns"] for p in parts if p["turns"]]
    distinct = sum(t[2] for t in turns) - sum(t[1] == u[0] for t, u in zip(turns, turns[1:], strict=False))
    gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
    cost, audit = sum(p["constants"] for p in parts), "".join(p["edits"] for p in parts)
    return {"gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[CUT], "illegal": illegal, "cost": cost, "audit": audit}


def repairs(df: DataFrame, chunk: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation, edited chunks for repaired_rows).

    Rows are taken by turn, nulls first; rows of one turn by role and then by a hash of role and text. A null text is an empty one, a null role an
    empty one, which can't be kept as it has no initial. A null conversation is one as others are. A row is blank without a character that isn't white space,
    a duplicate if an earlier row of its conversation has its role and text, truncated if its last such character doesn't end a
    sentence; the first of these counts. audit: the first in ASCII of the cheapest edits (D, I, K, R) whose roles' initials read
    (s?(ua)+)?. An empty table gives no rows. Other columns are not read. Both results are written to the shared folder.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "turn-repair")
    try:
        rows = _light(df, (conv_col, turn_col, role_col, text_col)).drop("text")
        parts = partitions_for(spark, df.count() * ROW_BYTES)
        cut = scratch.stored(_chunks(rows.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY), chunk), "chunks")
        numbered = _numbered(cut)
        guessed = scratch.stored(_mapped(numbered.where("first and last"), _guess, vectors="binary", constants="long", edits="string").drop("vectors"), "guessed")
        done = guessed.withColumn("state", F.lit(NOTHING))
        split = numbered.where("not (first and last)")
        if split.limit(1).count():
            split = scratch.stored(_across(scratch.stored(split, "split"), scratch), "marked")
            first = _mapped(split, _guess, vectors="binary", constants="long", edits="string").drop("edits")
            found = _stitched(first, scratch)
            done = done.unionByName(split.drop("codes").join(found, "idx").select(done.columns))
        edited = stored(done, "edited-chunks")
        ends = _mapped(edited.select("idx", "conv", "constants", "edits", "codes", "turns"), _summary, faults="array<int>", illegal="int", initials="array<int>", turns="array<bigint>")
        per = ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("idx", "constants", "edits", "faults", "illegal", "initials", "turns"))).alias("parts"))
        numbers = {c: "long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        return stored(_mapped(per, _totals, **numbers, audit="string").drop("parts"), "repairs"), edited
    finally:
        scratch.close()


def _decisions(edited: DataFrame) -> DataFrame:
    """A row for each row that stays: its key, the role that it gets, and the role of an empty row in front of it. A row inserted at the end of a conversation
    has the key of its last row, and rank 2."""
    schema = _schema(edited, "turn long, role string, h1 long, h2 long, rank int, new_role string, front array<string>, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, i, front = r["state"], 0, []
                key = lambda i, r=r: {"conv": r["conv"], "turn": r["turns"][i], "role": r["roles"][i], "h1": r["h1s"][i], "h2": r["h2s"][i]}
                for edit in r["edits"]:
                    if edit == "I":
                        front.append(WRITTEN[state])
                        state = TAKE[state]
                        continue
                    if edit == "D":
                        i += 1
                        continue
                    code = r["codes"][i]
                    role = r["roles"][i] if edit == "K" else WRITTEN[state]
                    state = KEEP[state][code >> 2] if edit == "K" else TAKE[state]
                    out.append(key(i) | {"rank": 0, "new_role": role, "front": front, "text": None})
                    front, i = [], i + 1
                if front:
                    out.append(key(len(r["turns"]) - 1) | {"rank": 2, "new_role": None, "front": front, "text": None})
            yield pa.RecordBatch.from_pylist(out, types)

    return edited.select("conv", "codes", "turns", "roles", "h1s", "h2s", "edits", "state").mapInArrow(run, schema)


def _met(df: DataFrame, edited: DataFrame, cols: tuple[str, str, str, str]) -> DataFrame:
    """Decisions (rank 0, 2) and texts (rank 1), to be sorted so that a decision stands before its text."""
    empty = [F.lit(None).cast("string").alias("new_role"), F.lit(None).cast("array<string>").alias("front")]
    texts = _light(df, cols).select(*KEY, F.lit(1).alias("rank"), *empty, "text")
    return _decisions(edited).unionByName(texts)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, role, text) of the repaired rows, in order, of sorted decisions and texts; (conversation, None, None) where one begins."""
    waiting = None
    conv, started = None, False
    for batch in batches:
        for row in batch.to_pylist():
            if not started or row["conv"] != conv:
                conv, started, waiting = row["conv"], True, None
                yield conv, None, None
            if row["rank"] == 0:
                waiting = row
            elif row["rank"] == 2:
                for role in row["front"]:
                    yield conv, role, ""
            elif waiting is not None and all(waiting[c] == row[c] for c in KEY):
                for role in waiting["front"]:
                    yield conv, role, ""
                yield conv, waiting["new_role"], row["text"]
                waiting = None  # its duplicates follow, and go


def repaired_rows(df: DataFrame, edited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, place, role, text): the repaired rows; part and place order those of a conversation. Ranges, so a long conversation is many tasks'."""
    met = _met(df, edited, (conv_col, turn_col, role_col, text_col))
    schema = _schema(met, "part int, place long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        types, part, out = to_arrow_schema(schema), TaskContext.get().partitionId(), []
        for place, (conv, role, text) in enumerate(_written(batches)):
            if role is not None:
                out.append({"conv": conv, "part": part, "place": place, "role": role, "text": text})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        yield pa.RecordBatch.from_pylist(out, types)

    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    parts = partitions_for(df.sparkSession, size)
    return met.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY, "rank").mapInArrow(run, schema)


def repaired_digests(df: DataFrame, edited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, sha256) of each conversation's repaired ``role:text``, joined by newlines. Such a hash is taken byte after byte, so a conversation streams through one
    task, which holds one text at a time."""
    met = _met(df, edited, (conv_col, turn_col, role_col, text_col))
    schema = _schema(met, "sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, out, state = to_arrow_schema(schema), [], None
        conv, first = None, True
        for of, role, text in _written(batches):
            if role is None:
                if state is not None:
                    out.append({"conv": conv, "sha256": state.hexdigest()})
                conv, state, first = of, hashlib.sha256(), True
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
                continue
            state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if state is not None:
            out.append({"conv": conv, "sha256": state.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, types)

    return met.repartition("conv").sortWithinPartitions(*KEY, "rank").mapInArrow(run, schema)
