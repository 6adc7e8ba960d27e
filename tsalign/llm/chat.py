"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all preceding turns are context
and only that reply is trainable. A conversation that does not end with an
assistant turn gives one more example, all context, so that its last turns are
not lost.

An example holds its whole context in one string, so a conversation fits one
row by the definition of the format.

Defined results: NULL text is empty; a NULL role is the empty role; turns are
ordered by ``(turn, role, text)``, NULL first, so ties and repeated rows keep a
fixed order and all of them count; a NULL ``conv_id`` is a conversation of its
own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, END = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE {}] ", " [/ROLE]")
#: Characters that a control string needs, and what stands for them inside a text.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))

_TURN = r"(?s)(\[INST\] |\[SYS\] |\[ROLE [^\]]*\] )?([^\[<]*)( \[/INST\]| \[/SYS\]| \[/ROLE\]|</s>)"


def escape(text: Column) -> Column:
    """``text`` without any character that could begin a control string."""
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: ``\\0`` holds the place of a backslash meanwhile, coded itself if the text has one."""
    text = F.replace(F.replace(text, F.lit("\0"), F.lit("\0z")), F.lit("\\\\"), F.lit("\0s"))
    for raw, coded in ESCAPES[1:]:
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return F.replace(F.replace(text, F.lit("\0s"), F.lit("\\")), F.lit("\0z"), F.lit("\0"))


def render(role: Column, text: Column) -> Column:
    """One turn in the template; ``text`` is escaped already."""
    out = F.concat(F.lit("[ROLE "), escape(role), F.lit("] "), text, F.lit(OTHER[1]))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return F.when(role == "assistant", F.concat(text, F.lit(END))).otherwise(out)


def expand(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Examples: ``conv_id, example, last, formatted, loss_start, loss_end``.

    ``example`` is the position of the example's last turn, ``last`` marks the
    one that holds the whole conversation. ``loss_start`` and ``loss_end`` are
    code-point offsets into ``formatted``, equal where nothing is trainable. The
    mask covers the reply without its end mark.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    ordered = ordered.withColumn(
        "turns",
        F.expr(
            "array_sort(turns, (a, b) -> CASE"
            " WHEN a.turn IS NULL AND b.turn IS NOT NULL THEN -1 WHEN a.turn IS NOT NULL AND b.turn IS NULL THEN 1"
            " WHEN a.turn < b.turn THEN -1 WHEN a.turn > b.turn THEN 1"
            " WHEN a.role < b.role THEN -1 WHEN a.role > b.role THEN 1"
            " WHEN a.text < b.text THEN -1 WHEN a.text > b.text THEN 1 ELSE 0 END)"
        ),
    )
    texts = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
        F.transform("turns", lambda t: render(t["role"], escape(t["text"]))).alias("shown"),
    )
    targets = F.expr(
        "filter(sequence(1, size(roles)), i -> element_at(roles, i) = 'assistant' OR i = size(roles))"
    )
    cut = texts.select("*", F.explode(targets).alias("example"))
    before = F.concat(F.lit(BEGIN), F.array_join(F.expr("slice(shown, 1, example - 1)"), ""))
    cut = cut.select(
        "conv_id",
        "example",
        (F.col("example") == F.size("roles")).alias("last"),
        F.length(before).alias("loss_start"),
        F.concat(before, F.element_at("shown", F.col("example"))).alias("formatted"),
        F.when(F.element_at("roles", F.col("example")) == "assistant", F.length(F.element_at("texts", F.col("example"))))
        .otherwise(F.lit(0))
        .alias("n"),
    )
    return cut.select(
        "conv_id", "example", "last", "formatted", "loss_start", (F.col("loss_start") + F.col("n")).alias("loss_end")
    )


def turns_of(formatted: Column) -> Column:
    """The turns read back from an example: an array of ``role`` and ``text``."""
    formatted = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    marks, texts, ends = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2, 3))
    parts = F.arrays_zip(marks.alias("m"), texts.alias("t"), ends.alias("e"))

    def one(p: Column) -> Column:
        other = unescape(F.regexp_extract(p["m"], r"(?s)^\[ROLE ([^\]]*)\] $", 1))
        role = (
            F.when(p["e"] == END, F.lit("assistant"))
            .when(p["m"] == MARKS["user"][0], F.lit("user"))
            .when(p["m"] == MARKS["system"][0], F.lit("system"))
            .otherwise(other)
        )
        return F.struct(role.alias("role"), unescape(p["t"]).alias("text"))

    return F.transform(parts, one)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The original text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, text under the mask and sizes."""
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), turns_of(F.col("formatted"))).alias("turns"),
        F.when(
            F.col("loss_end") > F.col("loss_start"),
            loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")),
        ).otherwise(F.lit("")).alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def oracle(planted: tuple) -> str:
    """The digests in SQL, from the turns themselves."""
    def quoted(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in planted)
    escaped = "text"
    for raw, coded in ESCAPES:
        escaped = f"replace({escaped}, {quoted(raw)}, {quoted(coded)})"
    widths = " ".join(f"WHEN {quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    width = f"CASE role WHEN 'assistant' THEN {len(END)} {widths} ELSE {len(OTHER[0].format('')) + len(OTHER[1])} + length(role) END"
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL FROM (VALUES {rows}) v(conv_id, turn, role, text))),
        r AS (
            SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                sum(length({escaped}) + {width}) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum({len(BEGIN)} + upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id"""
