import hashlib
import random
import zlib

import pytest

from netlytics.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, d int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def brute(rows, every=None, heads=4):
    """Nodes as rows, from all prefixes of all conversations."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    if every:
        h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
        own = {c: own.get(c - c % every, [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len([w for w in "".join(" " if ch in "\t\n\v\f\r" else ch for ch in t).split(" ") if w])
    out = []
    for prefix, cs in members.items():
        d = len(prefix)
        below = [(p, m) for p, m in members.items() if p[:d] == prefix]
        childless = [p for p, _ in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(map(str, sorted(c for c in cs if len(own[c]) == d)))
        out.append((min(cs), d, min(members[prefix[:-1]]) if d else None, len(cs), sum(len(p) == d + 1 for p, _ in below), len(childless),
                    sum((len(m) - 1) * (words(p[-1][1]) if p else 0) for p, m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, local=4096, every=None):
    turns = prefix_trie.encode_turns(df)
    turns, convs = prefix_trie.graft_heads(turns, every=every) if every else (turns, None)
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs, local=local).collect()), key=str)


@pytest.mark.parametrize("local", [2, 9, 4096])
def test_random_conversations(spark, local):
    r = random.Random(local)
    rows = []
    for c in range(60):
        for t in range(r.choice([0, 1, 2, 3, 5])):
            rows.append((c * 3 - 20, None if r.random() < 0.05 else t, r.choice(["user", "bot", None]) if t else "user", r.choice(["a b", "a", "", None, "c\td e"])))
    rows += [(None, 0, "user", "left out"), rows[0], rows[0]]  # no id; repeated rows
    assert found(table(spark, rows), local) == brute(rows)


def test_heads_of_other_conversations(spark):
    r = random.Random(1)
    rows = [(c, t, "user", r.choice(["x", "y z"])) for c in range(90) if c != 40 for t in range(r.choice([1, 1, 2, 5]))]
    assert found(table(spark, rows), 5, every=20) == brute(rows, every=20)


def test_long_shared_runs(spark):
    """Turns that a bucket shares are skipped in one round, however many: three copies of 3000 turns, one of which goes on, and one long conversation."""
    run = [f"turn {t} of a long one" for t in range(3000)]
    rows = [(c, t, "user", x) for c in (1, 2, 5) for t, x in enumerate(run)] + [(5, 9000, "user", "more")] + [(7, t, "bot", "x " * (t % 5)) for t in range(5000)]
    got = found(table(spark, rows), 10)
    assert len(got) == 1 + 3000 + 1 + 5000
    at = {(c, d): rest for c, d, *rest in got}
    assert at[(1, 3000)][:5] == [1, 3, 1, 1, 2 * 6] and at[(5, 3001)][:3] == [1, 1, 0] and at[(7, 5000)][1:3] == [1, 0]
    assert at[(1, 0)][1:5] == [4, 2, 2, 2 * 6 * 3000]


def test_one_hot_start(spark):
    """A turn that a third of the conversations begin with, and many copies of one conversation."""
    rows = [(c, 0, "user", "hi") for c in range(400)] + [(c, 1, "bot", f"answer {c % 3}") for c in range(200)] + [(c, 0, "user", f"own {c}") for c in range(400, 900)]
    assert found(table(spark, rows), 50) == brute(rows)


def test_odd_tables(spark):
    assert found(table(spark, []).where("false")) == []
    assert found(table(spark, [(None, 1, "user", "a")])) == []
    long = "word " * 300_000
    rows = [(3, 1, None, long), (4, 1, "", long), (9, None, None, None)]
    assert found(table(spark, rows)) == brute(rows)
    turns, convs = prefix_trie.graft_heads(prefix_trie.encode_turns(table(spark, [(21, 0, "user", "a")])), every=20)  # 20 is absent: what is left may be no turn at all
    left = zlib.crc32(b"21") % 4
    assert len(prefix_trie.prefix_trie(turns, convs).collect()) == (1 if left else 2)
