"""Operator 13: repair of conversation structure with ranked least edits.

A conversation's rows, in turn order, are edited into role initials ``(s?(ua)+)?``: Keep costs 0,
Rerole (to user or assistant) 2, Delete 3 (blank and duplicate rows must go), Insert of an empty
user or assistant turn 2, and a truncated row that stays 1. The audit is the initials of the
edits; among the cheapest the least audit in ASCII order is taken.

1. Order. Rows are range partitioned by (conversation, turn, role, text, a running number), so a
   conversation that holds a third of all rows is spread over many partitions, repeated rows too. A
   *segment* is what one range holds of one conversation; it is kept as a string of one letter a row
   (role initial and fault). A row is a duplicate unless its number is the least of its (role, text).
2. Cost. Nodes are (row, state of the pattern), four states a row. The costs to the end follow
   backwards from the costs at a segment's end. Where a conversation has several segments, each gives its
   4 x 4 matrix of costs from entry to exit; only those are put together in order.
3. Ranks. An arc is optimal if its cost closes the difference of its ends. Optimal-arc nodes are
   ranked by the first letter of their audits, then by prefixes of 2, 4, 8, ... letters: the
   rank of twice the length is that of the pair (rank, rank of the node that many letters on), and the
   pointers double too. The letters that leave a node lead to different nodes, so each rank has one pointer, and
   no cheapest audit begins with another one.
4. Path. The arcs of least (letter, rank) make the path; its letters are read off the doubled
   pointers, all places at once. Segments give an audit for each of four entries, of which the scan
   over a conversation's segments picks one.
5. Repair. Rows stream past their conversation's audit, sorted; nothing of a conversation is held but the audit itself.

Only the last step has a conversation in one task, as a stream: its result is one row with the whole
audit, and a digest of the repaired text can only be taken in order.

Defined results: a null conversation is one conversation; null turns come first; rows of one turn go by
role, then text; repeated rows follow one another; a null role or text counts as one space; a
role of no known initial cannot be kept; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesonar.llm.common import partitions, write_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
FAR = 1 << 40
LETTERS = " DIKR"  # ranks of the letters, in ASCII order; 0: the path ends
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; -1: not allowed
STEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1] * 4])  # keep initial s, u, a, other
TURN = np.array([2, 2, 3, 2])  # rerole and insert: the one role that may come next
ACCEPT = np.array([0, FAR, FAR, 0])
NONE, BLANK, DUPLICATE, CUT = range(4)
ROLES = {2: "user", 3: "assistant"}


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def ordered_rows(rows: DataFrame, rows_per_range: int) -> DataFrame:
    """Written rows (ck, conv_id, turn, role, text, num, part): ``num`` ascends in the order of
    each conversation, ``part`` is the range."""
    n = max(partitions(rows.sparkSession), -(-rows.count() // rows_per_range))
    order = ["ck", "turn", "role", "text"]
    keyed = rows.select(conversation_key().alias("ck"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("salt"))
    return write_table(
        keyed.repartitionByRange(n, *order, "salt").sortWithinPartitions(*order)
        .select("ck", "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("num"),
                F.spark_partition_id().alias("part")), "conversation-rows")


def segments(rows: DataFrame) -> DataFrame:
    """Written segments (ck, part, codes, first, last) of :func:`ordered_rows`."""
    initial = F.substring("role", 1, 1)
    start = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(NONE))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = rows.select("ck", "part", "num", start.alias("start"), fault.alias("fault"), same.alias("same"))
    firsts = (narrow.filter(F.col("fault") != BLANK).groupBy("ck", "same").agg(F.min("num").alias("num"))
              .select("num", F.lit(True).alias("new")))
    code = F.col("start") * 4 + F.when((F.col("fault") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    coded = narrow.join(firsts, "num", "left").select("ck", "part", "num", F.chr(code + 97).alias("code"))
    strings = coded.groupBy("ck", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("num", "code"))), lambda x: x["code"]), "").alias("codes"))
    line = Window.partitionBy("ck").orderBy("part")  # one row for each range a conversation is in
    return write_table(strings.withColumns({
        "first": F.lag("part").over(line).isNull(), "last": F.lead("part").over(line).isNull()}), "conversation-segments")


# the cost DP and the ranks, over the nodes of many segments at once --------

def closed(base: np.ndarray) -> np.ndarray:
    """Costs with inserts in front: columns are the states."""
    out = base.copy()
    out[..., 2] = np.minimum(base[..., 2], INSERT + base[..., 3])
    out[..., 3] = np.minimum(base[..., 3], INSERT + base[..., 2])
    out[..., :2] = np.minimum(base[..., :2], INSERT + out[..., 2:3])
    return out


def arc_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keep target, keep cost, rerole cost) of each row, per state."""
    start, fault = codes // 4, codes % 4
    stays = ((fault == NONE) | (fault == CUT))[:, None]
    extra = np.where(fault == CUT, TRUNCATED, 0)[:, None]
    target = STEP[start]
    keep = np.where(stays & (target >= 0), KEEP + extra, FAR)
    return np.maximum(target, 0), keep, np.broadcast_to(np.where(stays, REROLE + extra, FAR), (len(codes), 4))


class Nodes:
    """Nodes (place, state) of segments laid end to end; a segment of n rows has n + 1 places."""

    def __init__(self, strings: list[str], ends: np.ndarray, last: np.ndarray):
        """``ends``: costs (segments, states[, columns]) after the last place; a ``last`` segment may insert there too."""
        self.lengths = np.array([len(s) for s in strings])
        self.codes = np.frombuffer("".join(strings).encode(), np.uint8).astype(np.int64) - 97
        self.at = np.concatenate([[0], np.cumsum(self.lengths + 1)])  # first place of each segment
        self.last = last
        self.target, self.keep, self.rerole = arc_costs(self.codes)
        row = np.concatenate([[0], np.cumsum(self.lengths)])
        wide = ends.ndim == 3
        cost = np.full((self.at[-1], *ends.shape[1:]), FAR)
        done = ends.copy()
        if wide:
            done[last] = np.moveaxis(closed(np.moveaxis(ends[last], 1, -1)), -1, 1)
        else:
            done[last] = closed(ends[last])
        cost[self.at[1:] - 1] = done
        order = np.argsort(-self.lengths, kind="stable")
        longest = int(self.lengths.max()) if len(order) else 0
        alive = len(order)
        for step in range(1, longest + 1):
            while alive and self.lengths[order[alive - 1]] < step:
                alive -= 1
            seg = order[:alive]
            place = self.at[seg] + self.lengths[seg] - step
            r = row[seg] + self.lengths[seg] - step
            after = cost[place + 1]
            keep, rerole = self.keep[r], self.rerole[r]
            kept = after[np.arange(alive)[:, None], self.target[r]]
            turned = after[:, TURN]
            if wide:
                keep, rerole = keep[..., None], rerole[..., None]
            base = np.minimum(np.minimum(after + DELETE, kept + keep), turned + rerole)
            if wide:
                cost[place] = np.moveaxis(closed(np.moveaxis(base, 1, -1)), -1, 1)
            else:
                cost[place] = closed(base)
        self.cost = np.minimum(cost, FAR)

    def ranked(self) -> None:
        """Letters, ranks and doubled pointers of the nodes' least optimal arcs."""
        n = len(self.cost) * 4
        node = np.arange(n)
        place, state = node // 4, node % 4
        cost = self.cost.reshape(-1)
        is_end = np.zeros(len(self.cost), bool)
        is_end[self.at[1:] - 1] = True
        may_insert = ~is_end
        may_insert[self.at[1:][self.last] - 1] = True
        on = ~is_end[place]  # a row follows the place
        of_row = (np.cumsum(~is_end) - 1)[place]
        of_row = np.where(on, of_row, 0)
        if len(self.codes):
            keep_to, keep, rerole = self.target[of_row, state], self.keep[of_row, state], self.rerole[of_row, state]
        else:
            keep_to, keep, rerole = np.zeros(n, np.int64), np.full(n, FAR), np.full(n, FAR)
        following = np.minimum(place + 1, len(self.cost) - 1) * 4
        arcs = [  # (letter, target, cost), by letter
            (1, following + state, np.where(on, DELETE, FAR)),
            (2, place * 4 + TURN[state], np.where(may_insert[place], INSERT, FAR)),
            (3, following + keep_to, np.where(on, keep, FAR)),
            (4, following + TURN[state], np.where(on, rerole, FAR))]
        live = cost < FAR
        ends_here = live & is_end[place] & (~may_insert[place] | (cost == 0))
        optimal = [live & ~ends_here & (c < FAR) & (cost[t] + c == cost) for _, t, c in arcs]
        def least(keys):  # of the optimal arcs: (letter, target), 0 and itself where the path ends
            keys = np.where(optimal, keys, np.iinfo(np.int64).max)
            best = keys.argmin(axis=0)
            some = np.any(optimal, axis=0)
            return np.where(some, best + 1, 0), np.where(some, targets[best, node], node)

        targets, letters = np.stack([t for _, t, _ in arcs]), np.array([[k] for k, _, _ in arcs])
        letter, pointer = least(np.broadcast_to(letters, targets.shape))
        rank = letter
        while True:  # prefixes of 1, 2, 4, ... letters
            rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)[1]
            doubled = pointer[pointer]
            if np.array_equal(doubled, pointer):
                break
            pointer = doubled
        # the ranks of whole audits choose among the optimal arcs
        self.letter, pointer = least(letters * (rank.max(initial=0) + 1) + rank[targets])
        self.pointers, self.steps = [pointer], (self.letter > 0).astype(np.int64)
        while True:
            self.steps = self.steps + self.steps[pointer]
            doubled = pointer[pointer]
            if np.array_equal(doubled, pointer):
                break
            pointer = doubled
            self.pointers.append(pointer)

    def audits(self, state: int) -> tuple[list[str], np.ndarray]:
        """Each segment's least audit from ``state`` in front of it, and the state it ends in."""
        start = self.at[:-1] * 4 + state
        n = self.steps[start]
        first = np.concatenate([[0], np.cumsum(n)])
        now = np.repeat(start, n)
        place = np.arange(first[-1]) - np.repeat(first[:-1], n)
        for k, pointer in enumerate(self.pointers):
            jump = (place >> k) & 1 == 1
            now[jump] = pointer[now[jump]]
        text = np.frombuffer(LETTERS.encode(), np.uint8)[self.letter[now]].tobytes().decode()
        return [text[a:b] for a, b in zip(first[:-1], first[1:])], self.pointers[-1][start] % 4


def counts(strings: list[str]) -> np.ndarray:
    """Per segment: blank, duplicate, truncated, illegal neighbours inside, first and last initial."""
    lengths = np.array([len(s) for s in strings])
    at = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer("".join(strings).encode(), np.uint8).astype(np.int64) - 97
    start, fault = codes // 4, codes % 4
    bad = np.zeros(len(codes), np.int64)
    bad[1:] = illegal(start[:-1], start[1:])
    bad[at[:-1]] = 0
    sums = [np.add.reduceat(x.astype(np.int64), at[:-1]) for x in (fault == BLANK, fault == DUPLICATE, fault == CUT, bad)]
    return np.stack([*sums, start[at[:-1]], start[at[1:] - 1]], axis=1)


def illegal(a, b):
    """Do the initials ``a``, ``b`` follow each other though they may not?"""
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


PLAN = "ck string, audit string, cost long, counts array<long>"


def _long_lists(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.int64()))


def _lone(batches):
    """Plans of conversations with one segment."""
    for b in batches:
        strings = b.column(1).to_pylist()
        if strings:
            nodes = Nodes(strings, np.tile(ACCEPT, (len(strings), 1)), np.ones(len(strings), bool))
            nodes.ranked()
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(nodes.audits(0)[0]), pa.array(nodes.cost[nodes.at[:-1], 0]), _long_lists(counts(strings))],
                ["ck", "audit", "cost", "counts"])


def _matrices(batches):
    """Costs from each entry state (rows) to each exit state of segments; to the end, in column 0, of last ones."""
    for b in batches:
        strings, last = b.column(2).to_pylist(), np.array(b.column(3).to_pylist(), bool)
        if strings:
            ends = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(strings), 1, 1))
            ends[last] = FAR
            ends[last, :, 0] = ACCEPT
            nodes = Nodes(strings, ends, last)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), _long_lists(
                nodes.cost[nodes.at[:-1]].reshape(len(strings), 16))], ["ck", "part", "last", "matrix"])


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each segment of a conversation, from the last segment back."""
    group = group.sort_values("part", ascending=False)
    after, out = ACCEPT, []
    for m, last in zip(group["matrix"], group["last"]):
        m = np.array(m).reshape(4, 4)
        out.append(after.tolist())
        after = m[:, 0] if last else np.minimum((m + after).min(axis=1), FAR)
    return pd.DataFrame({"ck": group["ck"], "part": group["part"], "ends": out})


def _entries(batches):
    """Audits, exits and costs of segments for each of the four entries."""
    for b in batches:
        strings, last = b.column(2).to_pylist(), np.array(b.column(3).to_pylist(), bool)
        if strings:
            nodes = Nodes(strings, np.array(b.column(4).to_pylist()), last)
            nodes.ranked()
            texts, exits = zip(*[nodes.audits(q) for q in range(4)])
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(list(map(list, zip(*texts)))), _long_lists(np.stack(exits, axis=1)),
                _long_lists(nodes.cost[nodes.at[:-1]]), _long_lists(counts(strings))],
                ["ck", "part", "audits", "exits", "costs", "counts"])


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """One plan of the segments of a conversation."""
    group = group.sort_values("part")
    state, audit, total, before = 0, [], np.zeros(4, np.int64), None
    for texts, exits, c in zip(group["audits"], group["exits"], group["counts"]):
        audit.append(texts[state])
        state = exits[state]
        total += np.array(c[:4])
        if before is not None:
            total[3] += int(illegal(before, c[4]))
        before = c[5]
    return pd.DataFrame({"ck": [group["ck"].iloc[0]], "audit": ["".join(audit)], "cost": [group["costs"].iloc[0][0]],
                         "counts": [total.tolist()]})


def plans(parts: DataFrame) -> DataFrame:
    """(ck, audit, cost, counts) of each conversation in :func:`segments`; counts: blank,
    duplicate, truncated, illegal."""
    lone = parts.filter("first AND last").select("ck", "codes").mapInArrow(_lone, PLAN)
    several = parts.filter("NOT (first AND last)").select("ck", "part", "codes", "last")
    matrices = several.mapInArrow(_matrices, "ck string, part int, last boolean, matrix array<long>")
    ends = matrices.groupBy("ck").applyInPandas(_ends, "ck string, part int, ends array<long>")
    entries = several.join(ends, ["ck", "part"]).mapInArrow(
        _entries, "ck string, part int, audits array<string>, exits array<long>, costs array<long>, counts array<long>")
    return lone.union(entries.groupBy("ck").applyInPandas(_joined, PLAN))


# repair --------------------------------------------------------------------

class Repair:
    """Streams one conversation's rows past its audit."""

    def __init__(self, key, conv_id):
        self.key, self.conv_id = key, conv_id
        self.audit, self.cost, self.counts = "", 0, [0, 0, 0, 0]
        self.at, self.state = 0, 0
        self.turns, self.low, self.high = 0, None, None

    def plan(self, audit, cost, found):
        self.audit, self.cost, self.counts = audit, cost, found[:4]

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = int(TURN[self.state])
            yield ROLES[self.state], ""

    def row(self, turn, role, text):
        """The repaired turns that this row gives."""
        if turn is not None and turn != self.high:  # turns ascend
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(STEP["sua".find(role[:1]), self.state])
            yield role, text
        elif letter == "R":
            self.state = int(TURN[self.state])
            yield ROLES[self.state], text

    def gaps(self):
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _stream(batches):
    """(the repair, the turns that come next, whether it ends) for sorted rows of kinds 0 (the
    conversation is there), 1 (its plan) and 2 (its rows)."""
    now = None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for ck, kind, conv_id, turn, role, text, cost, found in zip(*cols):
            if now is None or now.key != ck:
                if now is not None:
                    yield now, now.inserts(), True
                now = Repair(ck, conv_id)
            if kind == 1:
                now.plan(text, cost, found)
            elif kind == 2:
                yield now, now.row(turn, role, text), False
    if now is not None:
        yield now, now.inserts(), True


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def streamed(rows: DataFrame, ids: DataFrame, rows_per_range: int) -> DataFrame:
    """Every conversation's plan and rows, in order, in one partition's stream."""
    ordered = ordered_rows(rows, rows_per_range)
    plan = plans(segments(ordered))
    nothing = {"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"),
               "cost": F.lit(None).cast("long"), "counts": F.lit(None).cast("array<long>")}
    cols = ["ck", "kind", "num", "conv_id", "turn", "role", "text", "cost", "counts"]
    there = ids.select("conv_id").distinct().select(
        conversation_key().alias("ck"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("num"), "conv_id").withColumns(nothing)
    planned = plan.select("ck", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("num"), F.lit(None).cast("long").alias("conv_id"),
                          F.col("audit").alias("text"), "cost", "counts").withColumns(
        {c: v for c, v in nothing.items() if c in ("turn", "role")})
    mine = ordered.select("ck", F.lit(2).alias("kind"), "num", "conv_id", "turn", "role", "text").withColumns(
        {c: v for c, v in nothing.items() if c in ("cost", "counts")})
    return (there.select(cols).union(planned.select(cols)).union(mine.select(cols))
            .repartition(partitions(rows.sparkSession), "ck").sortWithinPartitions("ck", "kind", "num").drop("num"))


def report(rows: DataFrame, ids: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """One row (:data:`REPORT`) for each conversation in ``ids`` (conv_id), of its ``rows`` (conv_id, turn, role, text);
    ``repaired_sha256`` is of the repaired ``role:text``, joined by line feeds."""
    kind = ids.schema["conv_id"].dataType.simpleString()

    def made(batches):
        out, digest, some = [], hashlib.sha256(), False
        for r, turns, ends in _stream(batches):
            for role, text in turns:
                digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
            if ends:
                blank, duplicate, truncated, bad = r.counts
                out.append((r.conv_id, r.gaps(), blank, duplicate, truncated, bad, r.cost, r.audit, digest.hexdigest()))
                digest, some = hashlib.sha256(), False
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(REPORT, o)) for o in out], schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(REPORT, o)) for o in out], schema)

    id_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("conv_id", id_type)] + [(c, pa.int64()) for c in REPORT[1:7]] + [(c, pa.string()) for c in REPORT[7:]])
    return streamed(rows, ids, rows_per_range).mapInArrow(
        made, f"conv_id {'string' if kind == 'string' else 'long'}, " + ", ".join(f"{c} long" for c in REPORT[1:7])
        + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """The repaired turns of ``rows`` (conv_id, turn, role, text): (conv_id, position, role, text)."""
    def made(batches):
        out, position = [], 0
        for r, turns, ends in _stream(batches):
            for role, text in turns:
                out.append((r.conv_id, position, role, text))
                position += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema)
                out = []
            position = 0 if ends else position
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema)

    names = ["conv_id", "position", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return streamed(rows, rows, rows_per_range).mapInArrow(made, "conv_id long, position long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with one fault by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 takes its closing marks, 3 repeats it, 4 makes it the user's."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return (rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).filter("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(known("role")).alias("role"),
                    text.alias("text"), F.explode(times).alias("_")).drop("_"))
