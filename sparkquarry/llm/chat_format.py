"""Chat formatting (3): quotation linking turns quoted mail-like messages into reply-ordered chats.

A message's lines are parsed into nested quote levels (leading ``>`` signs); attribution lines above a
quote go.  Neighbouring lines of one level are a passage, joined across its line breaks and normalised
(lower case, single spaces), so a quote that was wrapped anew or cut inside a line still meets its
original.  A passage is hashed as its windows of WIDTH words, a shorter one as a whole, and joined with the
windows that the messages of the same conversation wrote themselves (for short passages: with their lines
and whole texts of that length).  A window belongs to the first message that wrote it, so the join meets
one row a window however often it is quoted.  A passage is linked to the earlier message that at least
half of its windows come from.  A message answers the one that most windows of its outermost linked level
come from (ties: the later one), and without a link the message before it.  Depth and root follow by
pointer doubling.  Every message is returned without quotes, as chat markup, ordered by (conv_id,
root_turn, turn): a reply never precedes what it answers.

Conversations aren't gathered: the message before comes from small windows of SPAN turns and their
maxima, so one conversation may hold a third of all messages.  Own windows are only made for conversations
that quote anything.

Defined results: null and empty texts are empty messages; a message of quotes alone has empty text; null
conv_id or turn: the message stands alone; a null role counts as ``user``; rows that repeat a
(conv_id, turn) are reported each and answered as one message; a message that several wrote word for word
is answered where it was written first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.tables import by_slice, cut, load

SPAN, WIDTH = 4096, 3
_QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
_OPENING = re.compile(r"(on|am|le|el)\s.*\d", re.IGNORECASE)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(the message without quotes and attribution lines, its quoted passages as (level, words joined by spaces)).

    >>> parse("On Monday Ann wrote:\\n> > all is\\n> > well\\n> so they say\\nI see.")
    ('I see.', [(2, 'all is well'), (1, 'so they say')])
    """
    lines = []
    for line in (text or "").split("\n"):
        mark = _QUOTED.match(line)
        lines.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    gone = set()
    for i, (level, line) in enumerate(lines[:-1]):
        if lines[i + 1][0] > level and _ATTRIBUTION.search(line):
            gone.add(i)
            if i and lines[i - 1][0] == level and len(line.split()) < 4 and _OPENING.match(lines[i - 1][1].strip()):
                gone.add(i - 1)  # an attribution broken into two lines
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    for i, (level, line) in enumerate(lines):
        if i in gone:
            continue
        if level == 0:
            own.append(line)
            passages.append((0, []))
        elif passages and passages[-1][0] == level:
            passages[-1][1].extend(line.lower().split())
        else:
            passages.append((level, line.lower().split()))
    return "\n".join(own).strip("\n"), [(level, " ".join(words)) for level, words in passages if words]


def _short_units(own: str) -> list[str]:
    """A message's own words as one unit, and each line that is too short for a window."""
    lines = [line.lower().split() for line in own.split("\n")]
    whole = [w for words in lines for w in words]
    return [" ".join(whole), *(" ".join(words) for words in lines if 0 < len(words) < WIDTH and len(words) < len(whole))]


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, own (hashes of what it wrote), and quoted: (level, passage, of, hash) of each window.

    passage is a hash of all its words, of the number of its windows.
    """

    def hashed(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, unit) of the distinct windows, and a hash of each whole unit."""
        words = textkit.Words(pa.array(units, pa.string()))
        value, unit = words.shingles(WIDTH)
        total = np.bincount(words.text, minlength=len(units))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textkit.mix(words.hashes + np.arange(len(words.text), dtype=np.uint64) - words.first[words.text].astype(np.uint64), 5), dtype=np.uint64)))
        whole = textkit.mix(sums[words.first[1:]] - sums[words.first[:-1]], 6) if len(units) else total.astype(np.uint64)
        order = np.lexsort((value, unit))
        value, unit = value[order], unit[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (unit[1:] != unit[:-1]))) if len(value) else np.zeros(0, bool)
        return value[new].view(np.int64), unit[new], whole.view(np.int64)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [parse(t) for t in part.column("text").to_pylist()]
        units = [(i, u) for i, (own, _) in enumerate(made) for u in _short_units(own)]
        quotes = [(i, level, p) for i, (_, passages) in enumerate(made) for level, p in passages]
        value, unit, _ = hashed([u for _, u in units])
        owner = np.array([i for i, _ in units], dtype=np.int64)[unit]
        own = textkit.ragged(value, np.bincount(owner, minlength=len(made)), pa.int64())
        value, unit, whole = hashed([p for *_, p in quotes])
        owner, level = (np.array([q[c] for q in quotes], dtype=np.int64)[unit] for c in (0, 1))
        of = np.bincount(unit, minlength=len(quotes))[unit]
        columns = [pa.array(x, k) for x, k in ((level, pa.int32()), (whole[unit], pa.int64()), (of, pa.int32()), (value, pa.int64()))]
        structs = pa.StructArray.from_arrays(columns, names=["level", "passage", "of", "hash"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(made))))).astype(np.int32)
        quoted = pa.ListArray.from_arrays(pa.array(offsets), structs)
        yield pa.record_batch([part.column("conv_id"), part.column("turn"), part.column("role"), pa.array([own for own, _ in made], pa.string()), own, quoted], names=["conv_id", "turn", "role", "text", "own", "quoted"])

    some = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), "text")
    return by_slice(some, work, "conv_id long, turn long, role string, text string, own array<long>, quoted array<struct<level:int,passage:long,of:int,hash:long>>")


def _before(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, before) with the turn before each turn of its conversation."""
    spans = nodes.withColumn("span", F.floor(F.col("turn") / SPAN))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn"))
    ends = spans.groupBy("conv_id", "span").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("ahead", F.lag("end").over(Window.partitionBy("conv_id").orderBy("span"))).drop("end")
    return spans.withColumn("inside", inside).join(ends, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("inside", "ahead").alias("before"))


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked) of every message that has both keys; n_linked: its linked passages."""
    named = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = named.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    quoting = quoted.select("conv_id").distinct()
    own = named.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode("own").alias("hash"))
    origin = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    met = quoted.join(origin, ["conv_id", "hash"]).where("origin < turn")
    votes = met.groupBy("conv_id", "turn", "level", "passage", "of", "origin").agg(F.count("*").alias("n")).where("2 * n >= of")
    passages = votes.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.struct("n", "origin")).alias("best"))
    per = passages.groupBy("conv_id", "turn", "level", F.col("best.origin").alias("origin")).agg(F.sum("best.n").alias("n"), F.count("*").alias("passages"))
    best = per.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("outer"), "n", "origin")).alias("best"), F.sum("passages").alias("n_linked"))
    best = best.select("conv_id", "turn", F.col("best.origin").alias("quoted"), "n_linked")
    before = _before(named.select("conv_id", "turn").distinct())
    out = before.join(best, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.coalesce("quoted", "before").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def with_roots(links: DataFrame) -> DataFrame:
    """links with root_turn and depth, by doubling the distance to a known ancestor each round.

    A message whose known ancestor is a root is settled and takes no part in later rounds, so one long
    conversation costs its own length a round and not the whole table's.
    """
    links = cut(links)
    root = F.col("parent_turn").isNull()
    reach = links.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"))
    settled, open_ = reach.where("depth = 0"), reach.where("depth > 0")
    while True:
        known = settled.unionByName(open_).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        moved = open_.join(known, ["conv_id", "up"]).select("conv_id", "turn", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("up") == F.col("higher")).alias("done"))
        moved = cut(moved)
        settled, open_ = settled.unionByName(moved.where("done").drop("done")), moved.where("NOT done").drop("done")
        if open_.isEmpty():
            return links.join(settled.withColumnRenamed("up", "root_turn"), ["conv_id", "turn"])


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, root_turn, turn, depth, parent_turn, n_linked, role, text, markup."""
    parsed = cut(parsed_messages(messages))
    linked = with_roots(reply_links(parsed))
    keys = linked.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn", "n_linked", "root_turn", "depth")
    out = parsed.drop("own", "quoted").join(keys, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    markup = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return out.select(
        "conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"), "parent_turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "role", "text", markup.alias("markup")
    ).orderBy("conv_id", "root_turn", "turn")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))
