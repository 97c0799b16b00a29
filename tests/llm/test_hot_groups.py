"""Groups of copies, hubs and shared turns: time, partition sizes, and links against brute force."""

import collections
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from hearth.llm import components, exact_dedup, quotes


def test_a_task_with_a_million_copies_takes_seconds():
    def batches():
        for lo in range(0, 1_000_000, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 10_000)), pa.array([None, "same"] * 5_000)], names=["i", "t"])

    start, members, texts = time.perf_counter(), 0, []
    for out in exact_dedup._local_pass("max", 64 << 20)(batches()):
        here = out.column("n").is_valid()
        members += out.num_rows - here.true_count
        texts += out.filter(here).select(["keep", "n", "text"]).to_pylist()
    assert members == 1_000_000
    assert sorted((t["keep"], t["n"], t["text"]) for t in texts) == [(999_998, 500_000, b""), (999_999, 500_000, b"same")]
    assert time.perf_counter() - start < 60


def test_spilled_branches_keep_every_row(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 6)))) for i in range(3000)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), trie_bytes=600)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == \
        sorted((i, min(ids), len(ids)) for ids in groups.values() for i in ids)


def test_a_hub_is_dealt_over_tasks(spark):
    n = 100_000
    edges = spark.range(1, n + 1).select((F.col("id") + 7).alias("b"), F.lit(3).cast("long").alias("a"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = components._with_least(edges, least, n)
    parts = components.partitions(spark)
    dealt = joined.repartition(parts, "a", "salt").groupBy(F.spark_partition_id()).count().collect()
    assert joined.count() == n and sum(r["count"] for r in dealt) == n
    salts = joined.groupBy("salt").count().collect()
    assert len(salts) > parts and max(r["count"] for r in salts) < 1.3 * n / (components.HUB_SHARE * parts)
    found = components.components(edges).groupBy("root").count().collect()
    assert [(r["root"], r["count"]) for r in found] == [(3, n + 1)]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, top(x)) for x in root)


def _brute_links(rows):
    """Parent (turn) of every row by reading quotes line by line, without hashes or joins."""
    def norm(lines):
        return " ".join(" ".join(lines).lower().split())

    def read(text):
        own, quoted, run, level = [], [], [], 0
        for line in [*(text or "").split("\n"), None]:
            mark = re.match(r"[ \t]*((?:>[ \t]?)+)", line) if line is not None else None
            here = mark[1].count(">") if mark else 0 if line is not None else -1
            if here != level:
                if level > 0:
                    for piece in [run, *([x] for x in run if len(run) > 1)]:
                        if norm(piece):
                            quoted.append((level, norm(piece)))
                run, level = [], here
            if here > 0:
                run.append(line[mark.end():])
            elif line is not None:
                own.append(line)
        body = "\n".join(own).strip("\n") if quoted else "\n".join(own)
        return {norm([x]) for x in [body, *own, *body.split("\n\n")]} - {""}, quoted

    parsed = [read(r[3]) for r in rows]
    out = []
    for (conv, turn, _, _), (_, quoted) in zip(rows, parsed):
        votes = {}
        for level, words in quoted:
            firsts = [r[1] for r, (own, _) in zip(rows, parsed) if r[0] == conv and r[1] is not None and conv is not None and words in own]
            if firsts and turn is not None and min(firsts) < turn:
                at = votes.setdefault(min(firsts), [9, 0])
                at[0] = min(at[0], level)
                at[1] += words.count(" ") + 1
        out.append(max(((level == 1, n, first) for first, (level, n) in votes.items()), default=(0, 0, None))[2])
    return out


def test_quote_links_against_brute_force(spark):
    rng = random.Random(12)
    says = ["Shall we go?", "yes, at ten", "No.", "the weather\nis fine", "bring  bread", "OK"]
    rows = []
    for conv in range(40):
        bodies = []
        for turn in range(rng.randint(1, 9)):
            text = []
            for _ in range(rng.randint(0, 2)):
                if bodies:
                    level = rng.choice(["> ", ">", ">> ", "> > "])
                    text.append("\n".join(level + x for x in rng.choice(bodies).split("\n")))
            body = f"{rng.choice(says)}\n\n{rng.choice(says)} {conv} {turn}"
            text.insert(rng.randint(0, len(text)), body)
            bodies.append(body)
            rows.append((conv if conv else None, turn, rng.choice(["user", "bot"]), "\n".join(text)))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    links = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in got.collect()}
    assert len(links) == len(rows)
    want = {(r[0], r[1]): up for r, up in zip(rows, _brute_links(rows))}
    for (conv, turn), up in want.items():
        depth, root = 0, turn
        while want[conv, root] is not None:
            depth, root = depth + 1, want[conv, root]
        assert links[conv, turn] == (up, root, depth)
    assert sum(up is not None for up in want.values()) > 40


def test_messages_that_share_a_turn_link_apart(spark):
    rows = [(1, 0, "a", "hello there"), (1, 1, "b", "> hello there\nwell"), (1, 1, "c", "quoting nothing"),
            (1, 2, "d", "> quoting nothing\nindeed"), (1, 2, "d", "> quoting nothing\nindeed")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.role, r.parent_turn, r.root_turn, r.depth) for r in got if r.parent_turn is not None) == \
        [(1, "b", 0, 0, 1), (2, "d", 1, 1, 1), (2, "d", 1, 1, 1)]
    assert [(r.parent_turn, r.depth) for r in got if r.role == "c"] == [(None, 0)]
