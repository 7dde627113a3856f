"""The prefix trie against a trie built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from raterline.llm import conversation_trie
from raterline.llm.queries import ORACLE_SQL, QUERIES


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: turns.get(c - c % 5, [])[: h[c]] + own[h[c] :] for c, own in turns.items()}


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        cost = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    assert tuple(df.columns) == conversation_trie.NODE
    return sorted(map(tuple, df.collect()))


def table(n, seed=1, deep=12):
    """Conversations that share beginnings, whole copies, nulls, ties and turns that repeat."""
    rng = random.Random(seed)
    rows, past = [], [[]]
    for c in rng.sample(range(3 * n), n):
        base = list(rng.choice(past))[: rng.randint(0, deep)]
        new = base + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])) for _ in range(rng.choice([0, 0, 1, 2, rng.randint(1, deep)]))]
        past.append(new)
        rows += [(c, None if i == 0 and rng.random() < 0.5 else i - (i > 3 and rng.random() < 0.2), r, t) for i, (r, t) in enumerate(new)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tables(spark, seed):
    rows = [*table(60, seed), (None, 1, "user", "no id"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{SCHEMA}, depth int, least string")
    assert found(conversation_trie.prefix_trie(df)) == brute(rows)


def test_query_and_sql_name_the_same_columns(spark, sf_dir):
    got = QUERIES["op12_conversation_trie"](spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(got) == brute(rows)
    assert "op12_conversation_trie" in ORACLE_SQL


def test_long_conversations_in_chunks_over_partitions(spark, monkeypatch):
    """Conversations of many chunks, which the ranges cut, with others that leave them at many depths."""
    monkeypatch.setattr(conversation_trie, "CHUNK", 10)
    rng = random.Random(3)
    long = [("user", f"turn {i % 7}") for i in range(300)]
    rows = [(0, i, *t) for i, t in enumerate(long)]
    for c in range(1, 40):
        rows += [(c, i, *t) for i, t in enumerate(long[: rng.randint(0, 300)] + [("user", f"own {rng.randint(0, 3)}")] * rng.randint(0, 15))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(conversation_trie.prefix_trie(df)) == brute(rows)


def test_nested_chains(spark):
    """Each conversation leaves the one before it one turn later, so chains nest as deep as there are conversations."""
    ids = [c for c in range(0, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 0][:40]
    rows = [(c, i, "user", f"{min(k, i)}") for k, c in enumerate(ids) for i in range(50)]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_copies_and_turnless(spark, monkeypatch):
    """Hundreds of equal conversations end at one node; some have no turns left at all."""
    rows = [(c, i, "user", f"t{i}") for c in range(5, 400) if c % 5 for i in range(12)] + [(c, 0, "user", "gone") for c in range(1001, 1400, 3) if c % 5]
    want = brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(conversation_trie.prefix_trie(df)) == want
    only = [(1001, 0, "user", "gone"), (1003, 0, "user", "gone")]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(only, SCHEMA))) == brute(only)


def test_very_long_text(spark):
    rows = [(0, 0, "user", "é" * 2_000_000), (1, 0, "user", "é" * 2_000_000), (1, 1, None, None), (2, 0, "", "")]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert found(conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
