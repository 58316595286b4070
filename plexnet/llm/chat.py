"""Transcript parsing into chat turns (operator 10).

A transcript is free text in which speakers are marked in many ways, or not at
all. Each line is observed as one symbol out of its marker class, whether a
blank line stands before it, how it ends and how long it is. A hidden Markov
model with two states per role (the first line of a turn, a later line) gives
the roles by Viterbi; its tables are counted on the cluster from transcripts
whose roles are known. The recovered turns are rendered in one canonical form.

Lines are rows, and a conversation is cut into windows of WINDOW lines that
different tasks work on; the result is that of Viterbi over the whole
conversation. A window's effect on the six states' best scores is a max-plus
matrix; a scan over these small matrices gives the scores with which each
window begins. Under these, each window tells for each of its possible end
states where its best path comes from; a scan backwards over these maps gives
every window's end state, and the windows are then traced back on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import crc_mod, materialize, read_table
from plexnet.shipping import ensure_importable

ROLES = ("system", "user", "assistant")
WINDOW = 512
#: marker class -> names that open a turn (matched without regard to case, before ':' or alone after '###')
MARKERS = {"system": ("system", "instructions", "context"), "user": ("user", "human", "question", "q", "customer"),
           "assistant": ("assistant", "ai", "answer", "a", "bot", "agent")}
#: Styles in which :func:`write_transcripts` marks speakers: names by role, and the form.
STYLES = (({"system": "System", "user": "User", "assistant": "Assistant"}, "{}: "),
          ({"system": "Instructions", "user": "Human", "assistant": "AI"}, "{}: "),
          ({"system": "Context", "user": "Q", "assistant": "A"}, "{}: "),
          ({"system": "SYSTEM", "user": "USER", "assistant": "ASSISTANT"}, "### {}\n"))
N_SYMBOLS = 4 * 2 * 2 * 4
TURN_OPEN, TURN_CLOSE = "<|{}|>\n", "<|end|>\n"


def _marker_pattern(role: str) -> str:
    names = "|".join(MARKERS[role])
    return rf"(?i)^\s*(?:###\s*(?:{names})\s*:?\s*$|[*>\[]*(?:{names})[\]*]*\s*:)"


_STRIP = r"(?i)^\s*(?:###\s*(?:{0})\s*:?\s*$|[*>\[]*(?:{0})[\]*]*\s*:\s?)".format("|".join(n for ns in MARKERS.values() for n in ns))


def write_transcripts(turns: DataFrame) -> DataFrame:
    """Raw lines ``(conv_id, turn, line_no, line, true_role)`` of ``turns(conv_id,
    turn, role, text)``: turns follow each other with a blank line between
    them, marked in the style that the conversation's id draws; one turn in
    six has no marker. ``line_no`` orders the lines of a conversation: turn in
    the high bits, place in the low ones. Null text is an empty line; a null
    turn number comes first."""
    style = crc_mod(F.col("conv_id"), len(STYLES))
    mark = F.lit("")
    for i, (names, form) in enumerate(STYLES):
        for role, name in names.items():
            mark = F.when((style == i) & (F.col("role") == role), F.lit(form.format(name))).otherwise(mark)
    bare = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("m"))) % 6 == 0
    text = F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"), "role",
                         F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    return lines.select("conv_id", "turn", (F.shiftleft(F.col("turn") + 1, 32) + F.col("at")).alias("line_no"), "line",
                        F.col("role").alias("true_role"))


def split_transcripts(transcripts: DataFrame) -> DataFrame:
    """Lines ``(conv_id, line_no, line)`` of ``transcripts(conv_id, text)``."""
    return transcripts.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "line")).select(
        "conv_id", F.col("at").cast("bigint").alias("line_no"), "line")


def symbols(line: Column, blank_before: Column) -> Column:
    """The observed symbol of a line, 0 .. N_SYMBOLS - 1."""
    marker = F.lit(0)
    for i, role in enumerate(ROLES, 1):
        marker = F.when(line.rlike(_marker_pattern(role)), F.lit(i)).otherwise(marker)
    ends = F.rtrim(line).endswith("?")
    size = F.length(line)
    bucket = F.when(size < 40, 0).when(size < 160, 1).when(size < 500, 2).otherwise(3)
    return ((marker * 2 + blank_before.cast("int")) * 2 + ends.cast("int")) * 4 + bucket


def _conversation() -> Column:
    """A key of the conversation that is never null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def observe(lines: DataFrame) -> DataFrame:
    """``lines`` without the blank ones, with the key ``conv`` of the
    conversation, the symbol ``obs``, the line's number ``at`` (from 1) and its
    window. Lines are sorted in parts of 512 written turns; the counts of the
    parts before give every line its number in the conversation."""
    from pyspark.sql import Window
    chunk = F.floor(F.col("line_no") / F.lit(1 << 41)).cast("bigint")  # 512 turns of written transcripts
    cols = [c for c in lines.columns if c not in ("conv_id", "line_no", "line")]
    x = lines.withColumn("conv", _conversation()).withColumn("chunk", chunk)
    full = F.trim("line") != ""
    parts = x.groupBy("conv", "chunk").agg(F.count_if(full).alias("n"), F.max_by(F.trim("line") == "", F.struct("line_no", "line")).alias("ends_blank"))
    before = Window.partitionBy("conv").orderBy("chunk")
    parts = parts.select("conv", "chunk", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
                         F.coalesce(F.lag("ends_blank").over(before), F.lit(True)).alias("blank_before"))
    part = Window.partitionBy("conv", "chunk").orderBy("line_no", "line")
    x = x.withColumn("prev_blank", F.lag(F.trim("line") == "").over(part)).where(full).withColumn("place", F.row_number().over(part))
    x = x.join(parts, ["conv", "chunk"]).withColumn("at", F.col("n_before") + F.col("place"))
    blank = F.coalesce("prev_blank", "blank_before")
    return x.select("conv", "conv_id", "line_no", "line", *cols, symbols(F.col("line"), blank).alias("obs"), "at",
                    F.floor((F.col("at") - 1) / F.lit(WINDOW)).cast("bigint").alias("window"))


def train(observed: DataFrame) -> dict[str, np.ndarray]:
    """Log tables (start, step, emit) counted from ``observed`` lines with
    ``true_role`` and ``first`` (whether the line opens its turn), plus one
    everywhere. Lines of unknown roles teach nothing."""
    from pyspark.sql import Window
    role = F.expr(f"array_position(array({', '.join(repr(r) for r in ROLES)}), true_role) - 1")
    x = observed.withColumn("state", (role * 2 + (~F.col("first")).cast("int")).cast("int")).where("true_role IS NOT NULL AND state >= 0")
    order = Window.partitionBy("conv", "window").orderBy("at")
    last = x.groupBy("conv", (F.col("window") + 1).alias("window")).agg(F.max_by("state", "at").alias("state_above"))
    x = x.withColumn("above", F.lag("state").over(order)).join(last, ["conv", "window"], "left")
    x = x.withColumn("before", F.coalesce("above", "state_above"))
    emit, step, start = np.ones((6, N_SYMBOLS)), np.ones((6, 6)), np.ones(6)
    for r in x.groupBy("before", "state", "obs").count().collect():  # at most 7 * 6 * N_SYMBOLS rows
        emit[r.state, r.obs] += r["count"]
        if r.before is None:
            start[r.state] += r["count"]
        else:
            step[r.before, r.state] += r["count"]
    for role_ in range(3):  # a later line cannot follow another role's line
        for s in range(6):
            if s // 2 != role_:
                step[s, role_ * 2 + 1] = 1e-6
    norm = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return {"start": norm(start), "step": norm(step), "emit": norm(emit)}


def _forward(obs: np.ndarray, model: dict[str, np.ndarray], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers and the states' best scores at the end of ``obs``. The
    scores ``before`` it are None at the start of a conversation."""
    back = np.zeros((len(obs), 6), np.int8)
    v = before
    for i, o in enumerate(obs):
        if v is None:
            v = model["start"] + model["emit"][:, o]
            continue
        s = v[:, None] + model["step"]
        back[i] = s.argmax(0)
        v = s.max(0) + model["emit"][:, o]
    return back, v


def viterbi(obs: np.ndarray, model: dict[str, np.ndarray], before: np.ndarray | None = None, end: int | None = None) -> np.ndarray:
    """Most likely states of a sequence of symbols; of ties, the lower state.
    For a window of a longer sequence, with the scores ``before`` it and its
    ``end`` state."""
    back, v = _forward(obs, model, before)
    out = np.zeros(len(obs), np.int64)
    out[-1] = v.argmax() if end is None else end
    for i in range(len(obs) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def transfer(obs: np.ndarray, model: dict[str, np.ndarray], first: bool) -> np.ndarray:
    """The max-plus matrix of a window: best score from each state before it to
    each state at its end. All rows of a conversation's first window are alike."""
    m = None
    for o in obs:
        if m is None:
            m = (np.tile(model["start"], (6, 1)) if first else model["step"]) + model["emit"][:, o]
        else:
            m = (m[:, :, None] + model["step"]).max(1) + model["emit"][:, o]
    return m


def sources(obs: np.ndarray, model: dict[str, np.ndarray], before: np.ndarray) -> tuple[list[int], int]:
    """For each end state of a window the state before it on the best path, and the best end state."""
    back, v = _forward(obs, model, before)
    at = np.arange(6)
    for i in range(len(obs) - 1, -1, -1):
        at = back[i, at]
    return at.tolist(), int(v.argmax())


def _by_window(f):
    """Runs ``f(conv, window, frame)`` on each window's lines; rows come sorted by conv, window and at."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def groups(df: pd.DataFrame) -> pd.DataFrame:
            conv, window = df["conv"].to_numpy(), df["window"].to_numpy()
            cut = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (window[1:] != window[:-1])))
            return pd.concat([f(conv[a], int(window[a]), df.iloc[a:b]) for a, b in zip(cut, [*cut[1:], len(df)], strict=True)], ignore_index=True)
        for b in batches:
            if not len(b):
                continue
            df = b if held is None else pd.concat([held, b], ignore_index=True)
            same = (df["conv"] == df["conv"].iloc[-1]) & (df["window"] == df["window"].iloc[-1])
            last = int(np.flatnonzero(~same.to_numpy()).max(initial=-1)) + 1  # the last group may go on
            held = df.iloc[last:]
            if last:
                yield groups(df.iloc[:last])
        if held is not None and len(held):
            yield groups(held)
    return run


def _scan(rows: DataFrame, f, schema: str, backwards: bool = False) -> DataFrame:
    """``f(state, window, *values) -> (state, row)`` along each conversation's
    windows, whose rows are small; the state starts as None."""
    names = [c for c in rows.columns if c not in ("conv", "window")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for b in batches:
            out = []
            for c, w, *values in zip(b["conv"], b["window"], *(b[n] for n in names), strict=True):
                if c != conv:
                    conv, state = c, None
                state, row = f(state, int(w), *values)
                out.append((c, int(w), *row))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0].strip("`") for x in schema.split(", ")])
    order = F.desc("window") if backwards else F.asc("window")
    return rows.repartition("conv").sortWithinPartitions("conv", order).mapInPandas(run, schema)


def boundaries(spark: SparkSession, observed: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``(conv, window, before, ends)`` for the windows of conversations of more
    than one window: the scores before the window (null for the first) and its
    end state on the best path of the whole conversation."""
    ensure_importable(spark)
    long = observed.where("window > 0").select("conv").distinct()
    lines = materialize(spark, observed.join(long, "conv", "left_semi").select("conv", "window", "at", "obs"), "long-lines")

    def sorted_(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "window").sortWithinPartitions("conv", "window", "at")

    def matrix(conv, window, df):
        return pd.DataFrame({"conv": [conv], "window": [window], "m": [transfer(df["obs"].to_numpy(), model, window == 0).ravel().tolist()]})

    def forward(v, window, m):
        after = np.array(m).reshape(6, 6) if v is None else v[:, None] + np.array(m).reshape(6, 6)
        after = after.max(0)
        return after - after.max(), (None if v is None else v.tolist(),)
    matrices = sorted_(lines).mapInPandas(_by_window(matrix), "conv string, window bigint, m array<double>")
    starts = materialize(spark, _scan(matrices, forward, "conv string, window bigint, before array<double>"), "window-starts")

    def came(conv, window, df):
        if window == 0:
            back, v = _forward(df["obs"].to_numpy(), model, None)
            return pd.DataFrame({"conv": [conv], "window": [window], "from": [[0] * 6], "best": [int(v.argmax())]})
        f, best = sources(df["obs"].to_numpy(), model, np.array(df["before"].iloc[0]))
        return pd.DataFrame({"conv": [conv], "window": [window], "from": [f], "best": [best]})

    def backward(end, window, sources_, best):
        end = int(best) if end is None else end
        return int(sources_[end]), (end,)
    maps = sorted_(lines.join(starts, ["conv", "window"])).mapInPandas(_by_window(came), "conv string, window bigint, `from` array<int>, best int")
    ends = _scan(maps, backward, "conv string, window bigint, ends int", backwards=True)
    return materialize(spark, starts.join(ends, ["conv", "window"]), "window-bounds")


def recover(spark: SparkSession, observed: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``(conv, conv_id, window, at, line_no, line, state, above)`` for every
    observed line: state is 2 * role + (0 for a turn's first line, 1 for a
    later one); above is the state of the line before (null for the first)."""
    ensure_importable(spark)
    bounds = boundaries(spark, observed, model)
    rows = observed.select("conv", "conv_id", "window", "at", "line_no", "line", "obs").join(bounds, ["conv", "window"], "left")
    above = bounds.select("conv", (F.col("window") + 1).alias("window"), F.col("ends").alias("last"))
    rows = rows.join(above, ["conv", "window"], "left")
    rows = rows.repartition("conv", "window").sortWithinPartitions("conv", "window", "at")

    def solve(conv, window, df):
        before, end, last = df["before"].iloc[0], df["ends"].iloc[0], df["last"].iloc[0]
        states = viterbi(df["obs"].to_numpy(), model, None if before is None else np.array(before), None if pd.isna(end) else int(end))
        prior = [None if pd.isna(last) else int(last), *states[:-1].tolist()]
        return df.assign(state=states, above=pd.array(prior, "Int64"))[["conv", "conv_id", "window", "at", "line_no", "line", "state", "above"]]
    return rows.mapInPandas(_by_window(solve), "conv string, conv_id bigint, window bigint, at bigint, line_no bigint, line string, state int, above int")


def turns_of(spark: SparkSession, states: DataFrame) -> DataFrame:
    """Turns ``(conv_id, first_line, role, text, n_lines)`` of recovered lines:
    a turn opens at a first-line state or where the role changes; its marker
    is taken off."""
    from pyspark.sql import Window
    names = F.array(*map(F.lit, ROLES))
    role = F.floor(F.col("state") / 2)
    opens = (F.col("state") % 2 == 0) | F.col("above").isNull() | (F.floor(F.col("above") / 2) != role)
    x = materialize(spark, states.select("conv", "conv_id", "window", "at", "line_no", "line", role.cast("int").alias("role"), opens.cast("int").alias("opens")), "chat-states")
    before = Window.partitionBy("conv").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy("conv", "window").agg(F.sum("opens").alias("n")).select("conv", "window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    order = Window.partitionBy("conv", "window").orderBy("at")
    x = x.withColumn("no", F.sum("opens").over(order)).join(offsets, ["conv", "window"]).withColumn("no", F.col("no") + F.col("n_before"))
    clean = F.regexp_replace("line", _STRIP, "")
    lines = F.sort_array(F.collect_list(F.struct("at", clean.alias("line"))))
    t = x.groupBy("conv", "no").agg(F.first("conv_id").alias("conv_id"), F.min_by("line_no", "at").alias("first_line"), F.first("role").alias("role"), lines.alias("lines"))
    body = F.filter(F.transform("lines", lambda s: s["line"]), lambda s: F.trim(s) != "")
    return t.select("conv_id", "first_line", F.element_at(names, F.col("role") + 1).alias("role"), F.array_join(body, "\n").alias("text"), F.size("lines").alias("n_lines"))


def render(turns: DataFrame) -> DataFrame:
    """Adds ``rendered``, the canonical form of each turn. A transcript's
    canonical form is its turns' in the order of ``first_line``."""
    head, _, tail = TURN_OPEN.partition("{}")
    return turns.withColumn("rendered", F.concat(F.lit(head), "role", F.lit(tail), "text", F.lit("\n" + TURN_CLOSE)))


def parse(spark: SparkSession, lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Canonical turns of raw ``lines(conv_id, line_no, line)``. Blank lines
    separate and are not content; a transcript without any other line has no
    turns; null ids form one transcript; lines of equal numbers stand in the
    order of their text; conversations and lines of any length are parsed
    whole; other columns are ignored; an empty table gives an empty result."""
    observed = materialize(spark, observe(lines.select("conv_id", "line_no", "line")), "chat-lines")
    return render(turns_of(spark, recover(spark, observed, model)))


def with_first(observed: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    part = Window.partitionBy("conv", "turn").orderBy("line_no")
    return observed.withColumn("first", F.row_number().over(part) == 1)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes raw transcripts of the whole ``conversations`` table, learns from
    conversations whose crc32 remainder by 5 is not 0 and parses all of them:
    one row per recovered turn with its role, and ``true_role``, the role of
    the turn whose line opens it (for measuring; the parser never sees it)."""
    raw = write_transcripts(read_table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "turn", "role", "text"))
    observed = materialize(spark, observe(raw), "chat-lines")
    model = train(with_first(observed.where(crc_mod(F.col("conv_id"), 5) != 0)))
    turns = materialize(spark, render(turns_of(spark, recover(spark, observed, model))), "chat-turns")
    truth = observed.select("conv_id", F.col("line_no").alias("first_line"), "true_role", "turn").distinct()
    held = crc_mod(F.col("conv_id"), 5) == 0
    return turns.join(truth, ["conv_id", "first_line"], "left").select(
        "conv_id", held.alias("held_out"), "first_line", F.col("turn").alias("true_turn"), "role", "true_role", "text", "rendered")
