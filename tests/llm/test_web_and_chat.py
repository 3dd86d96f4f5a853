import hashlib
import io
import random
import re
import zipfile

import pytest

from netlytics.llm import archives, decontamination, quotes


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same page " * 20 + "</p>"
    rows = [(1, "http://a/ü?x=1", big), (2, None, None), (3, "http://b", "small"), (4, "http://c", "small"), (5, "http://d", big), (6, "http://e", "<p>own</p>" * 50), (7, "bad\r\nurl", big), (None, "n", "no id " * 30), (8, "x", "é" * 50), (9, "y", "é" * 50), (10, "z", "é" * 49 + "a"), (11, "z", "é" * 49 + "a")]
    return spark.createDataFrame([(*r, "warc") for r in rows], "page_id long, url string, html string, archive string").repartition(3)


@pytest.mark.parametrize("size", [1 << 20, 600])
def test_round_trip(pages, size):
    got = {r.page_id: r for r in archives.round_trip(pages, archive_bytes=size).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        raw = (p.html or "").encode()
        first = min((q.page_id for q in rows if q.page_id and (q.html or "") == (p.html or "")), default=None)
        revisit = len(raw) >= 100 and first is not None and first != p.page_id
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_real_archives(tmp_path, spark, zip64):
    path = tmp_path / "a.zip"
    payloads = [f"page {i} ".encode() * i for i in range(30)]
    with open(path, "wb") as f:
        w = archives.PackageWriter(f, zip64)
        for i, p in enumerate(payloads):
            w.add(archives.warc_record(str(i), f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None), str(i), "response")
        w.close()
    with zipfile.ZipFile(path) as z:  # the standard library agrees
        assert z.testzip() is None and set(z.namelist()) == {archives.DATA, archives.INDEX}
    got = sorted(archives.read_package_files(spark.createDataFrame([(str(path),)], "path string"), payloads=True).collect(), key=lambda r: int(r.page_id))
    assert [bytes(r.payload) for r in got] == payloads


def test_foreign_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        record = archives.warc_record("5", "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
        z.writestr(archives.DATA, record)
        z.writestr(archives.INDEX, f"5 0 {len(record)} response\n")
        z.comment = b"a comment with PK\x05\x06 in it"
    raw = out.getvalue()
    reader = archives.PackageReader(archives.BufferRange(raw))
    assert [r["payload"] for r in reader.records()] == [b"hello"]
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.PackageReader(archives.BufferRange(b"nothing here"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(archives.DATA, record)
    with pytest.raises(ValueError, match="compressed"):
        archives.PackageReader(archives.BufferRange(packed.getvalue())).stored(archives.DATA)


def test_damaged_records():
    record = archives.warc_record("1", None, b"abc", hashlib.sha256(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        archives.parse_record(record)


def test_pages_with_ids_of_their_own_kind(spark):
    big = "<p>" + "same page " * 20 + "</p>"
    rows = [("b/ü 1", "u", big), ("a b", "u", big), ("a b", "v", big), ("", "u", big), (None, "u", big), ("c", "u", "long " * 500_000)]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), archive_bytes=1 << 20).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([("b/ü 1", "revisit", ""), ("a b", "revisit", ""), ("a b", "revisit", ""), ("", "response", None), (None, "revisit", ""), ("c", "response", None)], key=str)


def test_no_pages(spark):
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- quotations


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow is the weather?"),
        (1, 1, "assistant", "> how  IS the weather?\nSunny.\n>> deeper, unknown"),
        (1, 2, "user", ">Hello there\n>How is the weather?\nI meant tomorrow."),
        (1, 3, "user", "> > how is the weather?\n> Sunny.\nThanks"),
        (1, 4, "assistant", None),
        (2, 0, "user", "> Sunny.\nfrom another conversation"),
        (2, 1, "user", ""),
        (2, 1, "user", "twice"),
        (None, 1, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = sorted(tuple(r) for r in quotes.link_quotations(df).select("conv_id", "turn", "text", "reply_to", "n_quoted", "n_linked").collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 1)]
    by = {g[:2]: g[2:] for g in got}
    assert by[1, 0] == ("Hello there\nHow is the weather?", None, 0, 0)
    assert by[1, 1] == ("Sunny.", 0, 2, 1)
    assert by[1, 2] == ("I meant tomorrow.", 0, 2, 2)
    assert by[1, 3] == ("Thanks", 1, 2, 2)
    assert by[1, 4] == ("", 3, 0, 0)
    assert by[2, 0] == ("from another conversation", None, 1, 0)
    assert {g[2:4] for g in got if g[:2] == (2, 1)} == {("", 0), ("twice", 0)}
    messages = quotes.link_quotations(df)
    assert {(r.conv_id, r.turn): r.thread for r in quotes.threads(messages).collect()} == {(1, i): 0 for i in range(5)} | {(2, 0): 0, (2, 1): 0}


# ---------------------------------------------------------------- decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_contamination(texts, items, window):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(WORD, (t or "").translate(low))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault((n, tuple(w[i : i + n])), set()).add(str(item))
    out = {}
    for k, t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in {n for n, _ in windows}:
            for i in range(len(w) - n + 1):
                if (n, tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[n, tuple(w[i : i + n])]
        out[k] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, short):
    r = random.Random(4)
    vocabulary = ["a", "b", "Cc", "dé", "e1", "f", "G"]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, prose(r.randint(13, 40))) for i in range(12)] + [(20, "a a a " * 10), (21, None), (22, "...")]
    items += [(30, "Cc Cc b"), (31, "f"), (32, "f"), (33, prose(8)), (34, prose(12))] if short else []
    texts = [prose(r.randint(0, 60)) for _ in range(60)]
    for i in range(0, 60, 3):
        w = items[i % 12][1].split()
        at = r.randint(0, len(w) - 5)
        texts[i] = prose(r.randint(0, 5)) + " " + " ".join(w[at : at + r.randint(5, 30)]).upper() + " " + prose(3)
    texts += [None, "", "a " * 40, items[0][1], items[1][1] + " " + items[1][1] + " " + items[2][1], "..."]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, words string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"], x.contaminated) for x in decontamination.contamination(docs, benchmark).collect()}
    want = brute_contamination(list(enumerate(texts)), items, 13)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {k for k, v in want.items() if not v[3]}


def test_empty_sides(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    assert decontamination.contamination(no_docs, some).count() == 0
    out = decontamination.contamination(docs, none).collect()
    assert len(out) == len(texts) and not any(r.n_hit for r in out)
