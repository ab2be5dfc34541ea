"""Repair of conversations: which turns to keep, re-role, delete or insert so that roles follow `(s?(ua)+)?`.

Every turn becomes one symbol, its role's initial with its fault, so a conversation is a word. Words that end alike
share their ends: read backwards and sorted, each differs from the one before only behind their common suffix, so the
nodes of the suffix-shared automaton lie on a stack and each is worked out once for all conversations that pass it. A
node holds, for each state of the grammar, the cost to go and the first letter of the best audit from there. Spark
makes the words distinct and deals them out by ranges of the reversed words; the audits are joined back.

A conversation may be very long. Its turns are sorted by Spark, which spills, and read one by one; what a task holds of
a conversation is one letter per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm.shared import kept
from growthlens.operators.common import join_back

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT for a truncated turn that stays
#: White space between the last character of a text and its end.
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; where an inserted or
#: re-roled turn leads to.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
_FAR = 1 << 60
#: Turns of a conversation whose symbols are joined at a time.
_PIECE = 4096

# One word, one node


def _kept_state(letter: str, state: int) -> int | None:
    if letter == "s":
        return 1 if state == 0 else None
    if letter == "u":
        return 2 if state != 2 else None
    return 3 if letter == "a" and state == 2 else None


def _with_inserts(costs: list[int], letters: list[str]) -> None:
    for _ in range(3):  # no best audit inserts three turns on end
        for state in range(4):
            if (INSERT + costs[NEXT[state]], "I") < (costs[state], letters[state]):
                costs[state], letters[state] = INSERT + costs[NEXT[state]], "I"


def end_node() -> tuple[list[int], list[str]]:
    """Cost to go and first letter of the audit per state where no turn is left."""
    costs, letters = [0, _FAR, _FAR, 0], ["", "Z", "Z", ""]
    _with_inserts(costs, letters)
    return costs, letters


def node(symbol: str, after: list[int]) -> tuple[list[int], list[str]]:
    """The same for a symbol in front of a suffix whose costs to go are `after`.

    Symbols are s, u, a, o for the initial of a sound turn's role (o: any other), upper case if the turn is truncated,
    x for a turn that has to go. The edits open to a state differ in their letter, so letters alone break ties.
    """
    costs, letters = [], []
    stays = CUT if symbol.isupper() else 0
    for state in range(4):
        choices = [(DELETE + after[state], "D")]
        if symbol != "x":
            to = _kept_state(symbol.lower(), state)
            if to is not None:
                choices.append((KEEP + stays + after[to], "K"))
            choices.append((REROLE + stays + after[NEXT[state]], "R"))
        cost, letter = min(choices)
        costs.append(cost)
        letters.append(letter)
    _with_inserts(costs, letters)
    return costs, letters


class Suffixes:
    """The automaton's nodes along one reversed word; the next word keeps those of the suffix that both share."""

    def __init__(self) -> None:
        self.word = ""
        self.nodes = [end_node()]
        self.made = 1

    def read(self, reversed_word: str) -> tuple[int, str]:
        """Least cost and its ASCII-least audit."""
        shared, most = 0, min(len(self.word), len(reversed_word))
        while shared < most and self.word[shared] == reversed_word[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed_word[shared:]:
            self.nodes.append(node(symbol, self.nodes[-1][0]))
            self.made += 1
        self.word = reversed_word
        state, audit = 0, []
        at = len(reversed_word)
        while letter := self.nodes[at][1][state]:
            audit.append(letter)
            if letter in "IR":
                state = NEXT[state]
            elif letter == "K":
                state = _kept_state(reversed_word[at - 1].lower(), state)
            at -= letter != "I"
        return self.nodes[len(reversed_word)][0][0], "".join(audit)


# The distributed part


def turns(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, turn, role, text, symbol, illegal, new_turn, blank, duplicate, truncated): ordered, judged turns.

    Null roles and texts count as one space. Order: turn, nulls first; turns of one number by role, then text.
    """
    plain = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial, before = F.left("role", F.lit(1)), F.lag(F.left("role", F.lit(1))).over(order)
    last_turn = F.lag("turn").over(order)
    # the second window needs no shuffle of its own: rows of one conversation lie together
    alike = Window.partitionBy("conv", "role", F.md5(F.col("text").cast("binary"))).orderBy("place")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    found = plain.withColumns(
        {
            "place": F.row_number().over(order).cast("long"),
            "illegal": before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"),
            "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last_turn),
        }
    ).withColumn("again", F.row_number().over(alike) > 1)
    found = found.withColumn("blank", last == "")
    found = found.withColumn("duplicate", ~F.col("blank") & F.col("again"))
    found = found.withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~last.isin(".", "!", "?"))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    return found.withColumn("symbol", symbol).drop("again")


def summary(judged: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, word): one row per conversation, the counts as long."""
    number = lambda c: F.sum(F.col(c).cast("long"))
    pieces = judged.groupBy("conv", F.floor((F.col("place") - 1) / _PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "").alias("part"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), *[number(c).alias(c) for c in ("new_turn", "blank", "duplicate", "truncated", "illegal")],
    )
    whole = pieces.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "").alias("word"),
        F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in ("new_turn", "blank", "duplicate", "truncated", "illegal")],
    )
    wide = [F.col(c).cast("decimal(38,0)") for c in ("most", "least", "new_turn")]
    gaps = F.least(wide[0] - wide[1] + 1 - wide[2], F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    gaps = F.when(F.col("most").isNotNull(), gaps).otherwise(F.lit(0).cast("long"))
    return whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "word")


def audits(words: DataFrame) -> DataFrame:
    """(word, cost long, audit) of every distinct word, by the suffix-shared automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for batch in batches:
            found = [automaton.read(w) for w in batch.column("reversed").to_pylist()]
            costs, letters = [c for c, _ in found], [a for _, a in found]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(costs, pa.int64()), pa.array(letters, pa.string())], ["word", "cost", "audit"])

    distinct = words.select("word").distinct().withColumn("reversed", F.reverse("word"))
    ordered = distinct.repartitionByRange("reversed").sortWithinPartitions("reversed")
    return ordered.mapInArrow(run, "word string, cost long, audit string")


def repaired(judged: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit): the turns that remain, in their order; edits: (conv, audit).

    place counts from 1; edit is K, R or I. Rows of one conversation lie together and in order.
    """
    plan = edits.select("conv", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = plan.union(judged.select("conv", "place", "role", "text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "place")
    kind = judged.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, 0, 0

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state, place = at + 1, NEXT[state], place + 1
                yield conv, place, ROLES[state], "", "I"

        def pack(out):
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], [f.name for f in arrow])

        for batch in batches:
            arrow = [pa.field("conv", batch.schema.field("conv").type), pa.field("place", pa.int64()), *(pa.field(n, pa.string()) for n in ("role", "text", "edit"))]
            out, size = [], 0
            for key, number, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "place", "role", "text"))):
                if number == 0:
                    out += inserted()  # those behind the last turn of the conversation before
                    conv, audit, at, state, place = key, text, 0, 0, 0
                    continue
                out += inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = NEXT[state] if edit == "R" else _kept_state(role[:1], state)
                    place += 1
                    out.append((conv, place, ROLES[state] if edit == "R" else role, text, edit))
                    size += len(text)
                if size > 8 << 20:  # long texts leave at once
                    yield pack(out)
                    out, size = [], 0
            yield pack(out)
        if rest := list(inserted()):
            yield pack(rest)

    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, place long, role string, text string, edit string")


def digests(remaining: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the frame that `repaired` returns: SHA-256 of its `role:text`, joined by newlines.

    The hash is fed turn by turn, so no conversation is held; those without turns have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            for key, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "place", "role", "text"))):
                if place == 1:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    kind = remaining.schema["conv"].dataType.simpleString()
    return remaining.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Judges and repairs conversations; returns (reports, turns).

    reports: one row per conversation, (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), counts as long.
    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (last
    character none of `.!?`). gaps are missing turn numbers, cut to a long; null turns don't count. illegal are adjacent
    role initials other than su, ua, au. The audit lists the cheapest edits, ties by ASCII. turns: what remains, see
    `repaired`. A null conversation is one of its own; an empty table gives two empty ones; other columns are not read.
    """
    judged = kept(turns(rows, conversation=conversation, turn=turn, role=role, text=text))
    found = kept(join_back(of := summary(judged), audits(of), ["word"]))
    return found.drop("word"), repaired(judged, found.select("conv", "audit"))
