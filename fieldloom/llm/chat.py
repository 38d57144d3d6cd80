r"""Chat formatting by relations alone: turns become one training text with a loss mask, and are read back from it.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a block by array
functions, and blocks are concatenated between the marks of their role. All of it is Spark expressions: no Python runs in a task.

Marks are control strings. A text that holds one gets a backslash behind its first character, and one backslash more where
some are there already: ``</s>`` becomes ``<\/s>`` and ``<\/s>`` becomes ``<\\/s>``. Every control string begins with a character
that none has later on, so escaped texts hold none, none arises at a seam, and removing one backslash gives the text back.

The loss mask is a list of (start, length) in UTF-8 bytes of the formatted text: the texts of the assistant's turns, without
marks. A span is cut from the bytes at once, wherever it lies, and running sums are made in slices, so a long conversation doesn't cost the square of its turns.

Defined cases: null texts and null roles count as empty; roles without marks of their own, empty ones included, get a block that
names them; turns sort by number, null numbers first, those of one number by role, then text; repeated rows are turns of their own; all rows
without a conv_id are one conversation; an empty table gives no rows; other columns are ignored. A conversation is one training example and so
one row, whose turns meet in one task; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Elements of a slice of running sums.
SLICE = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(strings: list[str]) -> str:
    """A pattern of any of ``strings``."""
    return "|".join(rf"\Q{s}\E" for s in strings)


@dataclass(frozen=True)
class Template:
    r"""The marks around a block of each role, of the other roles, and the seam between merged turns. Each is ``<`` or ``[`` and others than these and the backslash."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    seam: str = "[TURN]"
    learned: str = "assistant"

    def __post_init__(self) -> None:
        if any(s[:1] not in ("<", "[") or len(s) < 2 or set(s[1:]) & set("<[\\") for s in self.strings) or len(set(self.strings)) < len(self.strings):
            raise ValueError("marks must differ, begin with < or [ and hold neither of these nor a backslash later")

    @property
    def strings(self) -> list[str]:
        return [s for pair in [*self.marks.values(), self.other] for s in pair] + [self.seam]

    @property
    def rests(self) -> list[str]:
        return sorted({s[1:] for s in self.strings})

    def escape(self, text: Column) -> Column:
        """``text`` without control strings; ``unescape`` gives it back."""
        return F.regexp_replace(text, rf"([<\[])(\\*(?:{quoted(self.rests)}))", r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*(?:{quoted(self.rests)}))", "$1$2")

    def by_role(self, role: Column, known: Callable[[str, tuple[str, str]], Column], other: Column) -> Column:
        out = other
        for name, pair in self.marks.items():
            out = F.when(role == name, known(name, pair)).otherwise(out)
        return out

    def opening(self, role: Column) -> Column:
        return self.by_role(role, lambda _, pair: F.lit(pair[0]), F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.seam)))

    def closing(self, role: Column) -> Column:
        return self.by_role(role, lambda _, pair: F.lit(pair[1]), F.lit(self.other[1]))


def sums_before(numbers: Column) -> Column:
    """For each of ``numbers`` the sum of those before it: inside slices of SLICE, and over the slices."""

    def running(first: Column, values: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("sum"))
        return F.aggregate(values, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])

    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def by_slices(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / SLICE).cast("int")
        slices = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(values, k * SLICE + 1, SLICE))
        bases = lambda some: running(F.lit(0).cast("bigint"), F.transform(some, total))
        return let(slices, lambda some: let(bases(some), lambda base: F.flatten(F.zip_with(some, base, lambda s, b: running(b, s)))))

    return let(numbers, by_slices)


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent ``turns`` (role, text) of one role."""

    def cut(all_turns: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(all_turns))
        return F.transform(starts, lambda s, k: F.struct(F.get(all_turns, s)["role"].alias("role"), F.slice(all_turns, s + 1, end(k) - s)["text"].alias("texts")))

    begins = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    return let(turns, lambda t: let(begins(t), lambda starts: cut(t, starts)))


def laid_out(blocks: Column, template: Template) -> Column:
    """formatted, loss and n_blocks of ``blocks``: every text with what stands before and behind it, joined."""

    def pieces(b: Column) -> Column:
        last = F.size(b["texts"]) - 1
        return F.transform(
            b["texts"],
            lambda t, j: F.struct(
                F.when(j == 0, template.opening(b["role"])).otherwise(F.lit(template.seam)).alias("before"),
                template.escape(t).alias("text"),
                F.when(j == last, template.closing(b["role"])).otherwise(F.lit("")).alias("behind"),
                (b["role"] == template.learned).alias("learned"),
            ),
        )

    size = lambda c: F.octet_length(c).cast("bigint")

    def joined(parts: Column, n_blocks: Column) -> Column:
        whole = F.array_join(F.transform(parts, lambda p: F.concat(p["before"], p["text"], p["behind"])), "")
        starts = sums_before(F.transform(parts, lambda p: size(p["before"]) + size(p["text"]) + size(p["behind"])))
        spans = F.zip_with(parts, starts, lambda p, s: F.when(p["learned"], F.struct((s + size(p["before"])).alias("start"), size(p["text"]).alias("length"))))
        return F.struct(whole.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"), n_blocks.alias("n_blocks"))

    return let(blocks, lambda bs: let(F.flatten(F.transform(bs, pieces)), lambda parts: joined(parts, F.size(bs))))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, loss (start, length in bytes), n_blocks: one row for each conversation of ``rows`` (conv_id, turn, role, text)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", blank("role"), blank("text")))).alias("turns"))
    return turns.select("conv_id", laid_out(merged(F.col("turns")), template or Template()).alias("out")).select("conv_id", "out.*")


def turns_of(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted text holds."""
    template = template or Template()
    closes = [pair[1] for pair in [*template.marks.values(), template.other]]
    blocks = F.filter(F.split(formatted, "(?<=" + ")|(?<=".join(quoted([c]) for c in closes) + ")"), lambda b: b != "")

    def parts(b: Column, pair: tuple[str, str]) -> Column:
        n = len(pair[0])
        return F.split(F.substring(b, n + 1, F.char_length(b) - n - len(pair[1])), quoted([template.seam]))

    def read(b: Column) -> Column:
        turn = lambda role, texts: F.transform(texts, lambda t: F.struct(role.alias("role"), template.unescape(t).alias("text")))
        out = let(parts(b, template.other), lambda p: turn(template.unescape(F.get(p, F.lit(0))), F.slice(p, 2, F.size(p))))
        for role, pair in template.marks.items():
            out = F.when(F.startswith(b, F.lit(pair[0])), turn(F.lit(role), parts(b, pair))).otherwise(out)
        return out

    return F.flatten(F.transform(blocks, read))


def learned_text(formatted: Column, loss: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    template = template or Template()
    spans = lambda raw: F.transform(loss, lambda s: template.unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.array_join(let(formatted.cast("binary"), spans), "")


def with_probe(rows: DataFrame, conv_id: int = -7, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """``rows`` and one more conversation, whose user and assistant say control strings."""
    n = rows.sparkSession.range(2).select(F.lit(conv_id).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(n)


def round_trip(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id with digests of the turns, and of the text under the mask, that are read back from the written output."""
    template = template or Template()
    stored = written(format_chats(rows, template), "chats", "zstd")
    said = F.array_join(F.transform(turns_of(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = stored.select(
        "conv_id",
        "n_blocks",
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("loss").alias("n_spans"),
        F.size(turns_of(F.col("formatted"), template)).cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        let(learned_text(F.col("formatted"), F.col("loss"), template), lambda t: F.struct(F.char_length(t).cast("bigint").alias("chars"), F.sha2(t, 256).alias("sha256"))).alias("loss"),
    )
    return read.select("conv_id", "n_turns", "turns_sha256", F.col("loss.chars").alias("loss_chars"), F.col("loss.sha256").alias("loss_sha256"), "formatted_chars", "n_blocks", "n_spans")
