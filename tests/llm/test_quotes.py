import random
import re

import pytest

from netlytics.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, level int, message string, found long"
MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")


def lines_of(text):
    """(level, key) of each line."""
    out = []
    for raw in re.split(r"\r?\n", text or ""):
        m = MARKS.match(raw)
        key = re.sub(r"[ \t\x0B\f]+", " ", raw[m.end() if m else 0 :]).strip(" ")
        out.append((m[1].count(">") if m else 0, "".join(c.lower() if "A" <= c <= "Z" else c for c in key)))
    return out


def runs_of(text):
    """(level, keys) of each run of lines of one level."""
    out, last = [], None
    for level, key in lines_of(text):
        if level != last:
            out.append((level, []))
        last = level
        if key:
            out[-1][1].append(key)
    return [r for r in out if r[1]]


def brute(rows):
    """What each message replies to and its counts, message by message."""
    convs = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            convs.setdefault(conv, {}).setdefault(turn, []).append(text)
    out = {}
    for conv, turns in convs.items():
        order = sorted(turns)
        own = {t: [keys for x in texts for level, keys in runs_of(x) if level == 0] for t, texts in turns.items()}
        for place, t in enumerate(order):
            quoted = linked = 0
            votes = {}
            for text in turns[t]:
                for level, keys in runs_of(text):
                    if not level:
                        continue
                    has = lambda run, part: any(run[i : i + len(part)] == part for i in range(len(run) - len(part) + 1))
                    latest = lambda part: max((e for e in order[:place] if any(has(run, part) for run in own[e])), default=None)  # noqa: B023, E731
                    whole = latest(keys)
                    for key in keys:
                        found = whole if whole is not None else latest([key])
                        quoted += 1
                        linked += found is not None
                        if found is not None and level == 1:
                            votes[found] = votes.get(found, 0) + 1
            reply = max(votes, key=lambda f: (votes[f], f)) if votes else order[place - 1] if place else None
            out[conv, t] = (reply, quoted, linked)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "clash", 9) for r in rows], SCHEMA).repartition(4)
    got = quotes.link_quotations(df).collect()
    want = brute(rows)
    kept = [r for r in rows if r[0] is not None and r[1] is not None]
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in got} == want
    assert len(got) == len(kept)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    """Nested quotes of what was said before, in part, changed, or twice; ties between originals; absent ids and texts; repeated rows."""
    r = random.Random(seed)
    rows = []
    for conv in range(300):
        said = []
        for turn in range(r.randint(1, 7)):
            text = []
            for _ in range(r.randint(1, 3)):
                if said and r.random() < 0.6:
                    source = r.choice(said).split("\n")
                    a = r.randrange(len(source))
                    text += [r.choice(["> ", ">", " >  "]) + (x.upper() if r.random() < 0.2 else x) for x in source[a : a + r.randint(1, 3)]]
                if r.random() < 0.1:
                    text.append("> nobody said this")
                text += [r.choice(["yes", "no", "the red car", "I agree.", "", "a  b"]) for _ in range(r.randint(0, 3))]
            said.append("\n".join(text))
            rows.append((conv, turn if r.random() < 0.97 else None, "user", None if r.random() < 0.03 else said[-1].replace("\n", "\r\n") if r.random() < 0.1 else said[-1]))
    rows += [(None, 0, "user", "> yes"), rows[0], rows[5], (1000, 3, None, "yes"), (1000, 3, None, "> yes"), (1000, -2, "user", "yes\nno")]
    got = check(spark, rows)
    assert sum(x.n_linked > 0 for x in got) > 200 and sum(x.n_quoted > x.n_linked for x in got) > 50


def test_passages_before_lines(spark):
    """A message that has the whole passage is its original, though a later one has one of the lines."""
    rows = [(1, 0, "a", "I agree.\nThe red car is fast."), (1, 3, "b", "I agree."), (1, 4, "c", "> I agree.\n> The red car is fast.\nSo do I.")]
    got = {r.turn: (r.reply_to, r.n_linked, r.text) for r in check(spark, rows)}
    assert got[4] == (0, 2, "So do I.")


def test_long_messages_and_empty_tables(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, 0, "a", long), (1, 1, "b", "> line 7\n> line 8\nwhy?"), (1, 2, "c", "x" * 1_000_000), (1, 3, "d", "> " + "x" * 1_000_000)]
    got = {r.turn: r.reply_to for r in check(spark, rows)}
    assert got == {0: None, 1: 0, 2: 1, 3: 2}
    assert quotes.link_quotations(spark.createDataFrame([], SCHEMA)).collect() == []
