"""Matches equal a plain Python scan without pruning."""

import re
from collections import Counter

from varloom.llm import licenses
from varloom.llm.queries import QUERIES


def bigrams(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", lowered)
    return words, Counter(zip(words, words[1:]))


def plain(text, templates, least):
    lines = (text or "").split("\n")
    spans = [(i, i) for i in range(len(lines))]
    first = None
    for i in range(len(lines) + 1):
        if i == len(lines) or lines[i] == "":
            if first is not None and i - 1 > first:
                spans.append((first, i - 1))
            first = None
        elif first is None:
            first = i
    spans.append((0, len(lines) - 1))
    out, seen = [], set()
    for a, b in spans:
        before = len(bigrams("\n".join(lines[:a]))[0])
        words, own = bigrams("\n".join(lines[a : b + 1]))
        n = sum(own.values())
        if n < 1 or (before, len(words)) in seen:
            continue
        scores = []
        for name, t in sorted(templates.items()):
            _, other = bigrams(t)
            m = sum(other.values())
            if m:
                scores.append((2 * sum((own & other).values()) / (n + m), name))
        score, name = max(scores, key=lambda x: x[0], default=(0, ""))
        if score >= least:
            seen.add((before, len(words)))
            out.append((name, score, a, b))
    return out


def test_query_equals_plain_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = sorted((d.doc_id, *x) for d in docs for x in plain(d.text, licenses.TEMPLATES, 0.9))
    got = sorted(map(tuple, QUERIES["op2_license_scan"](spark, folder).collect()))
    assert got == want and len(got) > 0


def test_edited_texts_nulls_and_clashing_names(spark):
    mit = licenses.TEMPLATES["MIT"]
    half = mit.replace(". ", ".\n").replace("Software", "Work", 2)
    rows = [
        (1, "intro\n\n" + half + "\n\nend"),
        (2, mit.upper()),
        (3, None),
        (4, ""),
        (5, "Released under the MIT License."),
        (5, "Released under the MIT License."),
        (6, "released, under\nthe MIT license!"),
        (7, "x " * 50000 + "\nLicensed under CC BY-NC 4.0.\n"),
        (8, "released under the mit"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license", "1 AS key")
    for least in (0.7, 0.9):
        got = sorted(map(tuple, licenses.scan(df, key="doc_id", least=least).collect()))
        assert got == sorted((k, *x) for k, t in rows for x in plain(t, licenses.TEMPLATES, least))
    assert licenses.scan(df.limit(0), key="doc_id").count() == 0
    assert licenses.scan(df, key="doc_id", templates={"one": "word"}).count() == 0


def all_windows(text, template, least):
    """The best window of words from every word on, by trying all of them."""
    words, _ = bigrams(text)
    pairs, other = list(zip(words, words[1:])), bigrams(template)[1]
    m, out = sum(other.values()), []
    for i in range(len(pairs)):
        best = (0.0, 0, 0)
        for j in range(i, min(len(pairs), i + 3 * m)):
            own = Counter(pairs[i : j + 1])
            best = max(best, (2 * sum((own & other).values()) / (j + 1 - i + m), -j, i))
        if best[0] >= least:
            out.append((best[0], best[2], -best[1]))
    chosen = []
    for score, i, j in sorted(out, key=lambda w: (-w[0], w[1])):
        if all(j + 1 < a or b + 1 < i for _, a, b in chosen):
            chosen.append((score, i, j))
    return sorted(chosen, key=lambda w: w[1])


def test_windows_equal_a_scan_of_all_windows(spark):
    import random

    r = random.Random(3)
    notice = licenses.TEMPLATES["CC-BY-4.0 notice"].split()
    texts = []
    for _ in range(40):
        words = []
        for _ in range(r.randint(1, 4)):
            words += r.choices(["this", "work", "is", "foo", "license", "4", "a"], k=r.randint(0, 9))
            own = list(notice)
            for _ in range(r.randint(0, 3)):
                own.insert(r.randint(0, len(own)), r.choice(["foo", "license", "a"]))
            words += own
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = {"CC": licenses.TEMPLATES["CC-BY-4.0 notice"]}
    for least in (0.6, 0.9):
        got = {i: [] for i in range(len(texts))}
        for x in licenses.scan(df, key="doc_id", templates=templates, least=least).collect():
            got[x.doc_id].append(x.score)
        for i, text in enumerate(texts):
            if not plain(text, templates, least):  # else the line itself stands for its windows
                assert sorted(got[i]) == sorted(w[0] for w in all_windows(text, templates["CC"], least))


def test_licences_inside_longer_texts(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 header"]
    three = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", apache))
    rows = [
        (1, "some prose before\n\n" + three + "\n\nand a good deal of prose behind " * 30),
        (2, "Copyright 2020 A. Person\n" + wrapped + "\nimport os\n" + "x = 1\n" * 200),
        (3, "this page is " + "rather " * 40 + "long; released under the MIT License. " + "more " * 40),
        (4, ("filler text here " * 20 + "\r\n \r\n" + mit + "\r\n \r\n") * 2 + "end " * 300),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in sorted(map(tuple, licenses.scan(df, key="doc_id").collect())):
        got.setdefault(x[0], []).append((x[1], x[3], x[4]))
    assert got[1] == [("MIT", 2, 6)]
    last = 1 + wrapped.count("\n")
    assert ("Apache-2.0 header", 1, last) in got[2]
    assert got[3] == [("MIT notice", 0, 0)]
    assert [x[0] for x in got[4]] == ["MIT", "MIT"]
