"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (leading `>` marks); runs of
lines with one level are quoted passages. Passages and their lines are
normalised (case, white space) and hashed, and joined on conversation and hash to
the first message of the conversation with that text of its own: a whole body, a
paragraph or a line. A message replies to the earlier message that most of its
quoted words come from, level 1 first, the latest of equals. Following
replies gives each message's thread root and depth (path doubling: rounds grow
with the logarithm of the depth). Messages come out without quotes, numbered by
conversation, thread root and turn, so each reply stands after what it answers.

Originals are one row per conversation and hash (an aggregate with a map-side
part) and conversations are never gathered, so neither a line that everyone
writes nor a conversation of any length lands in one task.

Cases: null and empty texts have no passages and an empty body; a message of
quotes only keeps an empty body; quotes without an original, or of a later
message, link nothing; a null conv_id or turn links nothing; repeated rows are
separate messages with the same links; different messages on one turn are told
apart by a hash of the whole row, and of two that hold a passage first, the one with
the smaller hash is its original; an empty table gives none. Only the four
named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import with_positions
from ..sources.tables import read_table
from .common import store

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """Body without quotes; quoted (level, hash, words) of passages and their lines; hashes of own text."""
    body: list[str] = []
    quoted: list[tuple[int, int, int]] = []
    run: list[str] = []
    level = 0

    def close():
        pieces = [run, *([x] for x in run if len(run) > 1)]
        for piece in pieces:
            if normal := _normal(piece):
                quoted.append((level, _hash(normal), normal.count(" ") + 1))

    for line in (text or "").split("\n"):
        mark = _MARK.match(line)
        here = mark[1].count(">") if mark else 0
        if here != level:
            if level:
                close()
            run, level = [], here
        if here:
            run.append(line[mark.end():])
        else:
            body.append(line)
    if level:
        close()
    clean = "\n".join(body).strip("\n") if quoted else "\n".join(body)
    own = {_normal([clean])} | {_normal([x]) for x in body} | {_normal([x]) for x in clean.split("\n\n")}
    return clean, quoted, sorted(_hash(x) for x in own if x)


def _parse_pass(batches):
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        texts = batch.column(3).to_pylist()
        rows = [parse_quotes(t) for t in texts]
        names = [_hash(repr(x)) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), texts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), *batch.columns[:3], pa.array([r[0] for r in rows], pa.string()),
             pa.array([[dict(zip(("level", "hash", "words"), q)) for q in r[1]] for r in rows], kind),
             pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["id", "conv_id", "turn", "role", "text", "quoted", "own"])


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, parent_turn, root_turn, depth, position."""
    parsed = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text") \
        .mapInArrow(_parse_pass, "id long, conv_id long, turn long, role string, text string, "
                                 "quoted array<struct<level:int,hash:bigint,words:int>>, own array<bigint>")
    parsed = store(parsed, "quotes-parsed")
    quotes = parsed.where(F.size("quoted") > 0).select("id", "conv_id", "turn", F.explode("quoted").alias("q")) \
        .select("id", "conv_id", "turn", "q.level", "q.hash", "q.words")
    firsts = parsed.where("turn is not null").select("conv_id", F.struct("turn", "id").alias("at"), F.explode("own").alias("hash")) \
        .groupBy("conv_id", "hash").agg(F.min("at").alias("first"))
    votes = quotes.join(firsts, ["conv_id", "hash"]).where("first.turn < turn") \
        .groupBy("id", "first").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    parents = votes.groupBy("id").agg(
        F.max(F.struct((F.col("level") == 1).alias("direct"), "words", F.col("first").alias("up")))["up"].alias("up"))
    links = store(parents, "quotes-parents")
    paths = links.select("id", "up", F.lit(1).alias("hops"))
    while True:
        above = paths.select(F.col("id").alias("_at"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        paths = store(paths.join(above, F.col("up.id") == F.col("_at"), "left")
                      .select("id", F.coalesce("_up", "up").alias("up"),
                              (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                              F.col("_up").isNotNull().alias("moved")), "quotes-paths")
        if not paths.where("moved").limit(1).count():
            break
        paths = paths.drop("moved")
    roots = links.select("id", F.col("up.turn").alias("parent_turn")).join(
        paths.select("id", F.col("up.turn").alias("_root"), "hops"), "id")
    out = parsed.select("id", "conv_id", "turn", "role", "text", F.size("quoted").alias("n_quotes")) \
        .join(roots, "id", "left") \
        .select("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", F.coalesce("_root", "turn").alias("root_turn"),
                F.coalesce("hops", F.lit(0)).alias("depth"))
    return with_positions(out, ["conv_id", "root_turn", "turn", "role", "text"]).withColumnRenamed("_pos", "position")


def op3(spark, sf_dir: str) -> DataFrame:
    """Reply-ordered messages of all conversations, without quotes."""
    return link_quotes(read_table(spark, sf_dir, "conversations"))
