"""Conversation structure repair by error-correcting Earley parsing.

A well-formed conversation has the role initials `(s?(ua)+)?`. The grammar is left-linear, with weighted productions for
errors: a row is kept, given the role that is due, or deleted, and a row that is due may be inserted. Each item of a chart
column keeps its cheapest derivation as (cost, audit), the audit being the edits' initials (D, I, K, R) in order; of equal
costs the ASCII-least audit wins. The completed chart yields the edits.

What a row means to the parser is one symbol of a small alphabet (role initial and fault), so the texts never reach it:
rows are put in order by ranges of (conversation, turn, role, text's digest), cut into segments of 256 rows whatever
conversation they belong to, and each segment is parsed once from every nonterminal it may begin in. A conversation is then
a chain of segments, folded from left to right in the task that also streams its texts, which only keeps the edits. So a
conversation that holds any share of the rows is parsed in many tasks; its digest is made by one pass in order, as any
digest of a whole is, that never holds more than a batch of texts.

Two audits of one segment that begin and end alike and cost the same are never prefixes of each other (the longer would
have paid for an insertion more), so the least of a whole is made of the least of its parts.

Defined cases: a null in conv_id, turn, role or text counts as one space where text is made of it (in the key of the damage,
as a role, as a text); null conversations are one conversation, null turns come first. Rows of one turn are ordered by role,
then by the SHA-256 of their text, both after damage. A role's initial is its first character; an empty role has none, fits
nothing and counts as illegal beside any other. Repeated rows of a turn are duplicates. Gaps
beyond the range of a long are null. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.llm.base import map_batches, materialize, remembered

#: A segment, which is what one chart covers, has 2 to this power rows.
SEGMENT_BITS = 8
#: Charts a worker remembers.
CHARTS = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# A row's symbol is chr(65 + 4 * role + fault).
ROLES = "sua"  # 3: any other initial
FINE, BLANK, DUPLICATE, CUT = range(4)

#: Terminals: which rows they take, and whether taking a truncated row costs more.
TERMINALS = {**{t: (lambda role, fault, want=k: role == want and fault in (FINE, CUT), True) for k, t in enumerate(ROLES)}, "row": (lambda role, fault: fault in (FINE, CUT), True), "any": (lambda role, fault: True, False)}
#: head, body, cost, edit. Z: nothing yet; S, U, A: the last row that stands is a system's, user's, assistant's.
GRAMMAR = [
    *((x, (x, "any"), DELETE, "D") for x in "ZSUA"),
    ("S", ("Z", "s"), KEEP, "K"),
    *((("U", (x, t), c, e)) for x in "ZSA" for t, c, e in (("u", KEEP, "K"), ("row", REROLE, "R"))),
    *(("U", (x,), INSERT, "I") for x in "ZSA"),
    ("A", ("U", "a"), KEEP, "K"),
    ("A", ("U", "row"), REROLE, "R"),
    ("A", ("U",), INSERT, "I"),
]
STATES = "ZSUA"
#: A conversation may end where nothing stands or an assistant's row was last.
ENDS = "ZA"


def earley(symbols: str, start: str, grammar=GRAMMAR) -> dict[str, tuple[int, str]]:
    """(cost, audit) of the cheapest derivation of all symbols from each nonterminal, where `start` derives nothing at no cost.

    An item is (production, dot, origin column) with its cheapest (cost, audit); an item that gets cheaper is taken up again."""
    rules = [*grammar, (start, (), 0, "")]
    by_head = defaultdict(list)
    for r, (head, *_) in enumerate(rules):
        by_head[head].append(r)
    heads = sorted(by_head)
    waiting: list[dict] = []  # by column: nonterminal -> items before it
    scanned: dict = {}
    for at in range(len(symbols) + 1):
        chart: dict = {}
        agenda: list = []
        here: dict = defaultdict(dict)
        done: dict = {}  # (head, origin) -> value
        waiting.append(here)

        def offer(item, value):
            if item not in chart or value < chart[item]:
                chart[item] = value
                heapq.heappush(agenda, (value, item))

        for item, value in scanned.items():
            offer(item, value)
        if not at:
            for h in heads:
                for r in by_head[h]:
                    offer((r, 0, 0), (0, ""))
        scanned = {}
        role, fault = divmod(ord(symbols[at]) - 65, 4) if at < len(symbols) else (None, None)
        while agenda:
            value, item = heapq.heappop(agenda)
            if chart[item] != value:
                continue
            r, dot, origin = item
            head, body, cost, edit = rules[r]
            if dot == len(body):  # completed: all that wait for the head since its origin go on
                value = (value[0] + cost, value[1] + edit)
                if value < done.get((head, origin), (value[0] + 1,)):
                    done[head, origin] = value
                    for (r2, d2, o2), v2 in list(waiting[origin].get(head, {}).items()):
                        offer((r2, d2 + 1, o2), (v2[0] + value[0], v2[1] + value[1]))
            elif body[dot] in TERMINALS:
                takes, dear = TERMINALS[body[dot]]
                if role is not None and takes(role, fault):
                    scanned[r, dot + 1, origin] = (value[0] + TRUNCATED * (dear and fault == CUT), value[1])
            else:
                wanted = body[dot]
                here[wanted][item] = value
                for p in by_head[wanted]:
                    offer((p, 0, at), (0, ""))
                if (wanted, at) in done:
                    found = done[wanted, at]
                    offer((r, dot + 1, origin), (value[0] + found[0], value[1] + found[1]))
    return {h: done[h, 0] for h in heads if (h, 0) in done}


def charts(symbols: str) -> list[tuple[str, str, int, str]]:
    """start, end, cost, audit of a segment, from every nonterminal to every other it can lead to."""
    return [(s, e, *v) for s in STATES for e, v in earley(symbols, s).items()]


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of the rows after damage; the crc32 of the key says which."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20).cast("int")
    body = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(space(role)).alias("role"), body.alias("text"), kind.alias("kind"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("kind <> 0").select("conv", "turn", "role", "text", twice.alias("copy")).drop("copy")


def _fault(text: Column) -> Column:
    """The fault that a row has by itself."""
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.rlike("[.!?]"), CUT).otherwise(FINE)


def _order(salt: str | None = None) -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), *([F.col(salt)] if salt else [])]


def symbols(rows: DataFrame) -> DataFrame:
    """conv, at, symbol of rows (conv, turn, role, text): `at` follows the order of conversations and their rows."""
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), _fault(F.col("text")).alias("fault"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    # equal rows of one turn are dealt over ranges by the salt; which of them comes first makes no difference
    ranged = narrow.repartitionByRange(*_order("salt")).sortWithinPartitions(*_order("salt")).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(ranged.select("conv", "at", "role", "digest", "fault", F.coalesce(*(F.when(initial == r, k) for k, r in enumerate(ROLES)), F.lit(3)).alias("class")), "turns")
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    again = placed.join(firsts, placed.conv.eqNullSafe(F.col("c")) & (placed.role == F.col("r")) & (placed.digest == F.col("d")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return again.select("conv", "at", F.chr(65 + 4 * F.col("class") + fault).alias("symbol"))


def segments(placed: DataFrame) -> DataFrame:
    """conv, block, symbols, paths: a chart's (start, end, cost, audit) for each segment, as lines."""
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "")
    cut = placed.groupBy("conv", F.shiftright("at", SEGMENT_BITS).alias("block")).agg(held.alias("symbols"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = remembered("repair")
        for b in batches:
            out = []
            for s in b.column("symbols").to_pylist():
                if s not in seen:
                    if len(seen) >= CHARTS:
                        seen.clear()
                    seen[s] = "\n".join(f"{a} {z} {c} {w}" for a, z, c, w in charts(s))
                out.append(seen[s])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "paths"])

    return map_batches(cut, each, f"conv {placed.schema['conv'].dataType.simpleString()}, block long, symbols string, paths string", "repair")


class Fold:
    """A conversation's segments from left to right: the cheapest (cost, audit) by nonterminal, and counts of faults.

    What all audits have in common at their beginning is put aside once, so they stay short."""

    def __init__(self):
        self.settled, self.best, self.last = [], {"Z": (0, "")}, None
        self.faults, self.illegal = [0] * 4, 0

    def add(self, symbols: str, paths: str) -> None:
        for s in symbols:
            role, fault = divmod(ord(s) - 65, 4)
            self.faults[fault] += 1
            self.illegal += self.last is not None and (self.last, role) not in ((0, 1), (1, 2), (2, 1))
            self.last = role
        new: dict = {}
        for line in paths.split("\n"):
            a, z, cost, audit = line.split(" ")
            if a in self.best:
                value = (self.best[a][0] + int(cost), self.best[a][1] + audit)
                if z not in new or value < new[z]:
                    new[z] = value
        audits = [v[1] for v in new.values()]
        lo, hi = min(audits), max(audits)
        same = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
        if same:
            self.settled.append(lo[:same])
            new = {k: (c, w[same:]) for k, (c, w) in new.items()}
        self.best = new

    def result(self) -> tuple[int, str]:
        cost, rest = min(self.best[e] for e in ENDS if e in self.best)
        return cost, "".join(self.settled) + rest


class Writer:
    """The repaired conversation's digest, from its edits and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.digest, self.any = audit, 0, "Z", hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def due(self) -> str:
        self.last = "A" if self.last == "U" else "U"
        return "assistant" if self.last == "A" else "user"

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.line(self.due(), "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.line(self.due(), text)
        elif edit == "K":
            self.last = role[0].upper()
            self.line(role, text)

    def result(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def repair(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id", conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of `conversations`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows (conv, turn, role, text; no null role or text) are what is left of them, in any order."""
    kind = conversations.schema[conv_col].dataType.simpleString()
    turns = rows.groupBy("conv", "turn").count().groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("turns"))
    gaps = F.when(F.col("turns") == 0, F.lit(0)).otherwise(F.call_function("try_add", F.call_function("try_subtract", F.col("hi"), F.col("lo")), 1 - F.col("turns"))).alias("block")
    nothing = lambda t: F.lit(None).cast(t)
    blank = {"turn": "long", "role": "string", "digest": "string", "text": "string"}
    heads = conversations.select(F.col(conv_col).alias("conv")).distinct()
    columns = lambda **x: [x[c] if c in x else F.col(c) for c in ("conv", "step", "block", "turn", "role", "digest", "text")]
    head = heads.select(*columns(step=F.lit(0).alias("step"), block=F.lit(0).cast("long").alias("block"), **{c: nothing(t).alias(c) for c, t in blank.items()}))
    gap = turns.select(*columns(step=F.lit(1).alias("step"), block=gaps, **{c: nothing(t).alias(c) for c, t in blank.items()}))
    parsed = segments(symbols(rows)).select(*columns(step=F.lit(2).alias("step"), turn=nothing("long").alias("turn"), role=F.col("symbols").alias("role"), digest=nothing("string").alias("digest"), text=F.col("paths").alias("text")))
    texts = rows.select(*columns(step=F.lit(3).alias("step"), block=F.lit(0).cast("long").alias("block"), digest=F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    stream = head.unionByName(gap).unionByName(parsed).unionByName(texts)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "step", "block", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "step", "block", "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = gaps = fold = writer = None

        def close() -> None:
            cost, audit = fold.result()
            digest = (writer or Writer(audit)).result()
            out.append((conv, gaps, *(fold.faults[k] for k in (BLANK, DUPLICATE, CUT)), fold.illegal, cost, audit, digest))

        def flush() -> pa.RecordBatch:
            kinds = [into, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()
            return batch

        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        for b in batches:
            into = b.schema.field("conv").type
            for c, step, block, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if step == 0:
                    if fold is not None:
                        close()
                    conv, gaps, fold, writer = c, 0, Fold(), None
                elif step == 1:
                    gaps = block
                elif step == 2:
                    fold.add(role, text)
                else:
                    if writer is None:
                        writer = Writer(fold.result()[1])
                    writer.row(role, text)
            if out:
                yield flush()
        if fold is not None:
            close()
            yield flush()

    done = map_batches(stream, each, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", "repair")
    return done.withColumnRenamed("conv", conv)


def damaged_and_repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return repair(conversations, damaged(conversations, conv, turn, role, text), conv, conv)
