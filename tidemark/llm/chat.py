"""Chat formatting of heterogeneous records by schema fingerprints, in Spark's own expressions.

*Layouts.* A record is a row whose columns may be nested. The paths it has values at (``messages[].role``, ``prompt``,
...) are hashed; the hash selects one of the declared ``MAPPINGS``, which says where roles and texts are. So a table whose
schema is the union of many sources is converted row by row, and a record that no mapping describes is told apart
instead of being guessed at.

*Template.* A turn is ``<s>[INST]role[/INST]text</s>``. Inside roles and texts every control string gets a backslash after
its first character (``<\\s>``; one that has backslashes there gets one more), so no text can open or close a turn, and
taking one backslash away restores it. Loss spans are offsets of the assistants' texts in the UTF-8 bytes of the output.

*Size.* Turns are formatted and measured one by one; their places come from prefix sums over pieces of about equally
many rows, and they are joined in chunks of ``CHUNK`` turns before a conversation's chunks meet in its output row.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import prefix_sums
from ..plans.settle import settle

CHUNK = 256
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"(<\\*)(/?s>)|(\[\\*)(/?INST\])"  # every control string, with any number of backslashes after its first character
ESCAPED = r"(<\\*)\\(/?s>)|(\[\\*)\\(/?INST\])"


# -- layouts


@dataclass(frozen=True)
class Turn:
    """Where one turn comes from: ``role`` is a column or, with ``fixed``, the role itself; texts that are there are joined."""

    role: str
    texts: tuple[str, ...]
    fixed: bool = True


@dataclass(frozen=True)
class Mapping:
    """A layout. ``needs`` are paths a record must have, ``may`` those it can have besides.

    ``each`` names an array column with a turn per element (``turn`` then names fields of the element, and ``before``
    turns that come first); ``order`` the column by which records that hold one turn each follow one another.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Turn, ...]
    each: str | None = None
    order: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[tuple[str, ...]]:
        """Every set of paths that this mapping describes."""
        some = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [tuple(sorted(self.needs + x)) for x in some]


#: the names that published instruction and conversation sets use for the sides of a dialogue
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turns", ("turn",), ("role", "text"), (Turn("role", ("text",), fixed=False),), order="turn"),
    Mapping("turns_unnumbered", ("role",), ("text",), (Turn("role", ("text",), fixed=False),), order="turn"),
    Mapping("bare", (), ("text",), (Turn("role", ("text",), fixed=False),), order="turn"),
    Mapping("messages", ("messages", "messages[].role"), ("messages[].content", "system"),
            (Turn("role", ("content",), fixed=False),), each="messages", roles=SPEAKERS),
    Mapping("conversations", ("conversations", "conversations[].from"), ("conversations[].value", "system"),
            (Turn("from", ("value",), fixed=False),), each="conversations", roles=SPEAKERS),
    Mapping("prompt", ("prompt",), ("completion", "system"), (Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), (Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Mapping("instruction", ("instruction",), ("input", "output", "system"),
            (Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
)


def _vocabulary(mappings) -> list[str]:
    return sorted({p for m in mappings for p in m.needs + m.may})


def present_paths(df: DataFrame, vocabulary: list[str]) -> Column:
    """The paths of ``vocabulary`` at which a row has a value, sorted; ``a[].b`` is there if any element has it.

    Paths that the schema does not have, or has as another kind, are not there; columns beyond the vocabulary do not count.
    """
    found = []
    for path in vocabulary:
        top, _, field = path.partition("[].")
        kind = df.schema[top].dataType if top in df.columns else None
        if field:
            element = kind.elementType if isinstance(kind, T.ArrayType) else None
            if not isinstance(element, T.StructType) or field not in element.fieldNames():
                continue
            there = F.size(F.filter(F.col(f"`{top}`")[field], F.isnotnull)) > 0
        elif kind is None or isinstance(kind, T.StructType) or (
                isinstance(kind, T.ArrayType) != any(p.startswith(f"{top}[].") for p in vocabulary)):
            continue
        else:
            there = F.col(f"`{top}`").isNotNull()
        found.append(F.when(there, F.lit(path)))
    return F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def fingerprint(paths: Column) -> Column:
    """A 64-bit hash of the nested field paths."""
    return F.xxhash64(F.concat_ws("\n", paths))


def layout_of(df: DataFrame, mappings=MAPPINGS) -> Column:
    """The name of the mapping whose fingerprint a row has, else null; of two that share one the first declared."""
    named: dict[tuple, str] = {}
    for m in mappings:
        for p in m.fingerprints():
            named.setdefault(p, m.name)
    known = [(fingerprint(F.array(*[F.lit(x) for x in p]).cast("array<string>")), F.lit(n)) for p, n in named.items()]
    table = F.map_from_arrays(F.array(*[k for k, _ in known]), F.array(*[n for _, n in known]))
    return F.element_at(table, fingerprint(present_paths(df, _vocabulary(mappings))))


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def _turns_of(df: DataFrame, m: Mapping) -> Column | None:
    """array<struct<i, role, text>> of a record of layout ``m``; null if the schema cannot hold it."""
    canonical = lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in m.roles], r, F.lit(""))
    empty = F.lit("")
    system = []
    if "system" in m.may:
        s = _field(df, "system")
        system = [F.when(s.isNotNull(), F.struct(F.lit("system").alias("role"), s.alias("text")))]
    if m.each:
        if m.each not in df.columns or not isinstance(df.schema[m.each].dataType, T.ArrayType):
            return None
        element = df.schema[m.each].dataType.elementType
        if not isinstance(element, T.StructType):
            return None
        t = m.turns[0]
        of = lambda e, f: e[f].cast("string") if f in element.fieldNames() else F.lit(None).cast("string")
        body = F.transform(F.col(f"`{m.each}`"), lambda e: F.struct(
            canonical(of(e, t.role)).alias("role"), F.coalesce(of(e, t.texts[0]), empty).alias("text")))
        turns = F.concat(F.array_compact(F.array(*system)), body) if system else body
    else:
        body = [F.struct(
            (F.lit(t.role) if t.fixed else canonical(_field(df, t.role))).alias("role"),
            F.concat_ws("\n\n", *[_field(df, x) for x in t.texts]).alias("text")) for t in m.turns]
        turns = F.array_compact(F.array(*system, *body))
    return F.transform(turns, lambda x, i: F.struct(i.cast("long").alias("i"), x["role"].alias("role"), x["text"].alias("text")))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, i, role, text): the turns of every record whose layout a mapping describes, and ``layout``.

    ``turn`` orders records of one conversation, ``i`` the turns of one record. Null roles and texts are empty; a record
    without a value at any path is one empty turn. A record without a known layout gives one row with null ``layout``,
    role and text, so nothing is lost without a trace. Of a repeated record every copy counts.
    """
    known = [(m, _turns_of(records, m)) for m in mappings]
    kind = "array<struct<i:long,role:string,text:string>>"
    turns = F.coalesce(*[F.when(F.col("__layout") == m.name, t) for m, t in known if t is not None], F.lit(None).cast(kind))
    order = F.coalesce(*[F.when(F.col("__layout") == m.name, _field(records, m.order).try_cast("long")) for m in mappings if m.order])
    whole = records.withColumn("__layout", layout_of(records, mappings))
    key = F.col(f"`{id_col}`").alias("conv_id") if id_col in records.columns else F.lit(None).cast("long").alias("conv_id")
    return whole.select(key, order.alias("turn"), F.col("__layout").alias("layout"), F.explode_outer(turns).alias("t")).select(
        "conv_id", "turn", "layout", "t.i", "t.role", "t.text")


# -- the template


def escaped(text: Column) -> Column:
    """``text`` with a backslash put into every control string, so that none is left."""
    return F.regexp_replace(text, CONTROL, r"$1$3\\$2$4")


def restored(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, ESCAPED, "$1$3$2$4")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string, and where in its UTF-8 bytes the loss falls.

    A span (start, length) covers the text of one turn whose role is ``trained``, in order; turns follow one another by
    turn, i, role and text (nulls first).
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    pieces = turns.select(
        F.struct("conv_id").alias("c"), "turn", "i", "role", "text", (F.col("role") == trained).alias("loss"),
        F.concat(head, text, F.lit(CLOSE)).alias("piece"), F.octet_length(head).cast("long").alias("h"),
        F.octet_length(text).cast("long").alias("n"))
    pieces = settle(pieces)  # read to cut it into pieces, for their totals and for their rows
    one = F.lit(1).cast("long")
    placed = prefix_sums(pieces, ["c"], ["turn", "i", "role", "text"], {"at": F.octet_length("piece").cast("long"), "k": one})
    span = F.when(F.col("loss"), F.struct((F.col("at") + F.col("h")).alias("start"), F.col("n").alias("length")))
    chunk = F.floor(F.col("k") / CHUNK).alias("b")
    chunks = placed.groupBy("c", chunk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("part"),
        F.array_sort(F.collect_list(span)).alias("spans"))
    parts = F.array_sort(F.collect_list(F.struct("b", "part", "spans")))
    return chunks.groupBy("c").agg(parts.alias("p")).select(
        "c.conv_id",
        F.array_join(F.transform("p", lambda x: x["part"]), "").alias("formatted"),
        F.flatten(F.transform("p", lambda x: x["spans"])).alias("loss_spans"))


def parsed(output: DataFrame) -> DataFrame:
    """``output`` with ``turns``, array<struct<role, text>>, read back from ``formatted``."""
    whole = F.split("formatted", CLOSE, -1)
    bodies = F.transform(F.slice(whole, 1, F.size(whole) - 1), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))

    def turn(x):
        at = F.locate(MIDDLE, x)
        return F.struct(
            restored(F.substr(x, F.lit(1), at - 1)).alias("role"), restored(F.substr(x, at + len(MIDDLE))).alias("text"))

    return output.withColumn("turns", F.transform(bodies, turn))


def trained_text(formatted_col: str = "formatted", spans_col: str = "loss_spans") -> Column:
    """All text under the loss mask, restored, in order: cut from the output by its spans."""
    # the array makes the bytes once a row; a cast inside the inner lambda would copy them for every span
    cut = F.transform(F.array(F.col(formatted_col).cast("binary")), lambda whole: F.transform(
        F.col(spans_col), lambda s: restored(F.substr(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))))
    return F.array_join(cut[0], "")


def digests(records: DataFrame, id_col: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from its output.

    Null roles and texts are empty; rows with a null id form one conversation; repeated rows are turns of their own; rows
    of equal turn follow by role, then text. Records whose layout is not known take no part (``canonical_turns`` shows
    them). A conversation's output is one string and so has to stay below 2 GB. An empty table gives an empty result;
    columns that no mapping names are ignored.
    """
    turns = canonical_turns(records, id_col, mappings).filter("layout IS NOT NULL")
    read = parsed(settle(formatted(turns)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = trained_text()
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
