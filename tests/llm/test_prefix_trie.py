"""The prefix trie against a dictionary of all beginnings."""

import hashlib
import random
import re
import zlib

import pytest

from panelspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, words map<string,int>"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", {"a": 1}) for r in rows], SCHEMA).repartition(parts)


def named(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), named(role or "", text or ""), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for at in members:
        if at:
            children.setdefault(at[:-1], []).append(at)
    below = {at: [0, 0] for at in members}
    for at, m in members.items():
        saved = (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", at[-1][1])) if at else 0
        for d in range(len(at) + 1):
            below[at[:d]][0] += at not in children
            below[at[:d]][1] += saved
    return sorted(repr((
        min(m), len(at), min(members[at[:-1]]) if at else None, len(m), len(children.get(at, [])), *below[at],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(at)))).encode()).hexdigest())) for at, m in members.items())


def conversations(seed, n=300, hot=0.3):
    rng = random.Random(seed)
    said = [f"word{i} a\tb c " * (i % 4) for i in range(6)]
    rows = [(None, 0, "user", "lost"), (5000, None, None, None), (5000, None, "user", "x"), (5001, 0, "user", "é" * 5000), (5002, 0, "ab", "c"), (5003, 0, "a", "bc")]
    for c in rng.sample(range(1200), n):
        if rng.random() < hot:
            ts = [("user", "hot"), ("bot", "same  words"), ("user", "hot"), ("bot", "end")]
        else:
            ts = [(rng.choice(["user", "bot", None]), rng.choice([*said, None, ""])) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
        rows += [(c, t // rng.choice([1, 1, 1, 2]), *x) for t, x in enumerate(ts)]
    return rows


@pytest.mark.parametrize("seed, shards", [(1, None), (2, 1), (3, 7), (4, 40)])
def test_against_dictionary(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    rows = conversations(seed)
    found = prefix_trie.nodes(prefix_trie.rebuilt(frame(spark, rows)), shards).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows)


def test_one_path_in_many_shards(spark):
    rows = [(c * 20, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(c * 20, 3, "bot", "more") for c in range(0, 400, 3)]
    found = prefix_trie.nodes(prefix_trie.rebuilt(frame(spark, rows)), 12).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows) and len(found) == 5


def test_shortened_splitters_keep_their_order():
    rng = random.Random(1)
    paths = sorted((b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randint(0, 5))), rng.randrange(50)) for _ in range(300))
    splitters = paths[::10]
    short = prefix_trie.shortened(splitters)
    assert all(a < b <= c for a, b, c in zip(splitters, short[1:], splitters[1:])) or len(set(splitters)) < len(splitters)
    assert all(c.startswith(s) for (s, _), (c, _) in zip(short, splitters))


def test_empty(spark):
    assert prefix_trie.nodes(prefix_trie.rebuilt(frame(spark, []))).count() == 0
    assert prefix_trie.nodes(prefix_trie.rebuilt(frame(spark, [(None, 1, "user", "x")]))).count() == 0
