"""The trie against one built by hand."""

import hashlib
import random
import zlib

import pytest

from llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string, depth string, parent string"


def by_hand(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    out = set()
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        leaves = sum(not any(len(k) == len(m) + 1 and k[:len(m)] == m for k in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c, n in convs if n == len(node)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.add((min(c for c, _ in convs), len(node), parent, len(convs), sum(len(k) == len(node) + 1 for k in below), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(spark, rows):
    out = prefix_trie.conversation_trie(spark.createDataFrame(rows, DDL))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def invented(n, seed):
    rand = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 11 == 3:
            continue
        for turn in range(rand.choice((1, 1, 2, 4, 9, 14))):
            text = rand.choice(("é", "yes", "no", "", None)) if turn else "hello"
            rows.append((c, rand.choice((None, turn)) if turn == 0 else turn, ("user", "assistant", None)[turn % 3], text, "x", "y"))
    rows += [rows[5], rows[5], (None, 1, "user", "lost", None, None), (3, 0, "user", "z" * 50_000, None, None)]
    return rows


@pytest.fixture
def little(monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)


def test_one_shard(spark):
    rows = invented(60, 1)
    assert result(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_many_shards(spark, little, seed):
    rows = invented(150, seed)
    assert result(spark, rows) == by_hand(rows)


def test_one_conversation_many_times(spark, little):
    rows = [(c, t, "user", f"turn {t}", None, None) for c in range(90) for t in range(3)] + [(200, 0, "user", "other", None, None)]
    assert result(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_shards_cut_anywhere(cuts):
    """Shards and their joining without Spark, at every way to cut."""
    rand = random.Random(cuts)
    paths = sorted(([bytes([rand.randrange(2)]) * 16 for _ in range(rand.randrange(6))], c) for c in range(40))
    whole = {r[4:6] + r[6:7] + r[8:15] for r in _levels(paths, [0, len(paths)]) if r[0] == "node"}
    for first in range(1, 40, 3):
        at = sorted({0, first, *(rand.randrange(40) for _ in range(cuts)), 40})
        assert {r[8:9] + r[6:7] + r[10:14] for r in _levels(paths, at) if r[0] == "node"} == {w[3:4] + w[2:3] + w[5:9] for w in whole}


def _levels(paths, cuts):
    rows, fields = [], prefix_trie.ROWS.fieldNames()
    for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows += prefix_trie.in_shard(((c, p, [7] * len(p)) for p, c in paths[a:b]), shard)
    opened = [dict(zip(fields, r)) for r in rows if r[0] == "open"]
    while len({r["shard"] for r in opened}) > 1:
        groups = {}
        for r in opened:
            groups.setdefault(r["shard"] // 2, []).append(r)
        up = [r for g, own in groups.items() for r in prefix_trie.join_shards(own, g, len(groups) == 1)]
        rows += up
        opened = [dict(zip(fields, r)) for r in up if r[0] == "open"]
    if opened:
        rows += prefix_trie.join_shards(opened, 0, True)
    return rows


def test_queue_spills(monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAP_MESSAGES", 9)
    monkeypatch.setattr(prefix_trie.Messages, "BLOCK", 3)
    rand, queue, sent = random.Random(1), prefix_trie.Messages(2), []
    got = []
    for time in range(300):
        got += list(queue.pop_at(time))
        for _ in range(rand.randrange(4)):
            message = (time + 1 + rand.randrange(40), rand.randrange(1000))
            sent.append(message)
            queue.push(message)
    got += [m for time in range(300, 400) for m in queue.pop_at(time)]
    assert queue.runs and [m[0] for m in got] == sorted(m[0] for m in sent) and sorted(got) == sorted(sent)


def test_empty_table(spark):
    assert result(spark, []) == set()
