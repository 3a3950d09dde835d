"""Chat logs to training text: messages rebuilt from events, then rendered with a loss mask.

A log has events of conversations: a message is opened, streamed in deltas, edited,
regenerated or withdrawn. Events are partitioned by conversation and message and folded in
the order of their sequence numbers; only whole messages meet in a conversation, and those in
parts of ``span`` turns, so that a conversation with very many turns is spread over many
tasks. Every part is rendered by a template that marks turns, with the control strings inside
texts escaped so that they can be read back. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the control strings of the template, and what they become inside a text
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
#: inside a role the mark behind it is escaped too
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))
HEAD, BEHIND_ROLE, END = "### ", ": ", "</turn>\n"

#: kinds of events; a null or other kind adds nothing
OPEN, DELTA, EDIT, REGENERATE, WITHDRAW = "open", "delta", "edit", "regenerate", "withdraw"
KINDS = (OPEN, DELTA, EDIT, REGENERATE, WITHDRAW)


def escaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    """Every backslash in an escaped text begins a code, so the backslash itself comes last."""
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def once(value: Column) -> Column:
    """The value behind a generator, so that the optimizer cannot copy it into each of its uses."""
    return F.explode(F.array(value))


# --- events --------------------------------------------------------------------------


def event_log(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 256,
) -> DataFrame:
    """(conv_id, turn, message, seq, kind, role, text): the log that a table of finished turns came from.

    Texts are streamed in pieces of ``piece`` code points. Assistants first stream half of
    their text and are then regenerated; other roles send all but the last piece and then
    edit. Turns that are equal in all columns become messages of their own, and so do several
    with one number. Null texts are empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), text.alias("text"),
    )
    # equal rows are counted before they are told apart
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    cut = counted.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(
        "conv_id", "turn", "role", "text", F.concat_ws("-", F.sha2("text", 256), F.col("copy").cast("string")).alias("message"),
        once(pieces).alias("p"),
    )

    def event(kind: str, what: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), what.alias("text"))

    nothing = F.lit(None).cast("string")
    deltas = F.transform("p", lambda x: event(DELTA, x))
    half = F.floor(F.size("p") / 2).cast("int")
    again = F.concat(F.slice(deltas, 1, half), F.array(event(REGENERATE, nothing)), deltas)
    edited = F.concat(F.slice(deltas, 1, F.greatest(F.size("p") - 1, F.lit(0))), F.array(event(EDIT, F.col("text"))))
    events = F.concat(F.array(event(OPEN, nothing)), F.when(F.col("role") == "assistant", again).otherwise(edited))
    return cut.select("conv_id", "turn", F.concat_ws("-", "role", "message").alias("message"), "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "message", F.col("seq").cast("bigint").alias("seq"), "e.kind", "role", "e.text"
    )


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the messages that a log (as of ``event_log``) leaves.

    Inside a message events are taken by ``seq``, equal ones by kind and text. A delta is
    appended, an edit replaces all before it, a regeneration drops all before it, a withdrawn
    message goes with everything that follows for it but a later ``open``. The role is that of
    the last ``open``. Messages without one are kept, their role is the first that an event
    names; null texts add nothing.
    """
    own = F.filter(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))), lambda e: e["kind"].isin(*KINDS)
    )
    lists = events.groupBy("conv_id", "turn", "message").agg(own.alias("own")).select("conv_id", "turn", "message", once(F.col("own")).alias("own"))

    def last(*kinds: str) -> Column:
        at = F.transform("own", lambda e, k: F.when(e["kind"].isin(*kinds), k))
        return F.coalesce(F.array_max(at), F.lit(-1))

    marked = lists.select("*", last(OPEN).alias("opened"), last(WITHDRAW).alias("gone"), last(OPEN, EDIT, REGENERATE).alias("reset"))
    kept = F.slice("own", F.greatest(F.col("reset") + 1, F.lit(1)), F.size("own"))
    texts = F.transform(kept, lambda e: F.when(e["kind"].isin(DELTA, EDIT), e["text"]))
    roles = F.filter(F.transform("own", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.when(F.col("opened") >= 0, F.get("own", F.col("opened"))["role"]).otherwise(F.get(roles, F.lit(0)))
    alive = (F.col("gone") < 0) | (F.col("gone") < F.col("opened"))
    return marked.filter(alive & (F.size("own") > 0)).select(
        "conv_id", "turn", "message", role.alias("role"), F.array_join(texts, "").alias("text")
    )


# --- template ------------------------------------------------------------------------


def rendered(messages: DataFrame, span: int = 64, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, part, formatted, loss): conversations as text, in parts of ``span`` turn numbers.

    Turns stand in the order of their number, null first, equal ones by role and message. A
    conversation's text is that of its parts in order. ``loss`` holds (start, length) in code
    points of the part for the texts to learn, which end before the end mark. A null role is
    written as an empty one.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(HEAD), escaped(role, ROLE_ESCAPES), F.lit(BEHIND_ROLE))
    pieces = messages.select(
        "conv_id", F.floor(F.col("turn") / span).alias("part"),
        F.struct("turn", role.alias("role"), "message", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body")).alias("piece"),
    )
    parts = pieces.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    parts = parts.select("conv_id", "part", once(F.col("pieces")).alias("pieces"))
    sizes = F.transform(
        "pieces", lambda p: F.struct(F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body"), p["role"].isin(*learned).alias("own"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    found = F.aggregate(
        sizes, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(END)).alias("at"),
            F.when(s["own"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length")))))
            .otherwise(acc["loss"]).alias("loss"),
        ),
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.select("conv_id", "part", text.alias("formatted"), found["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, part, chars, turns array<struct<role, text>>, learned array<string>) from ``rendered`` text and its mask."""
    ended = F.split("formatted", "</turn>\\n", -1)
    turns = F.slice(ended, F.lit(1), F.size(ended) - 1)
    behind = len(HEAD)

    def parsed(turn: Column) -> Column:
        at = F.instr(turn, BEHIND_ROLE)
        return F.struct(
            unescaped(F.substring(turn, F.lit(behind + 1), at - behind - 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(turn, at + len(BEHIND_ROLE), F.char_length(turn))).alias("text"),
        )

    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    chars = F.char_length("formatted").cast("bigint").alias("chars")
    return formatted.select("conv_id", "part", chars, F.transform(turns, parsed).alias("turns"), learned.alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of ``rendered`` text, read back from it.

    Every part is read back on its own. A digest needs what it is taken of in one row, so
    conversations are limited here by what a row holds; the parts themselves are not.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(formatted).select(
        "conv_id", "chars", F.struct("part", lines.alias("turns"), F.array_join("learned", "").alias("loss")).alias("piece"),
        F.size("turns").cast("bigint").alias("n"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("piece")).alias("p")
    )
    loss = F.array_join(F.col("p.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("p.turns"), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
