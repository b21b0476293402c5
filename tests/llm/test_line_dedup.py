"""Copies of lines held to brute force, with buckets split early."""

import random

from webloom.llm import line_dedup

LINE = "the quick brown fox jumps over the lazy dog and runs far away from the river bank"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(text, edits):
    for _ in range(edits):
        at, c = random.randrange(len(text)), random.choice("abc é😀")
        text = random.choice([text[:at] + c + text[at + 1 :], text[:at] + text[at + 1 :], text[:at] + c + text[at:]])
    return text


def brute(rows):
    seen, out = [], []
    for doc, text in rows:
        exact, near, gone = 0, 0, []
        lines = text.split("\n") if text is not None else []
        for pos, line in enumerate(lines):
            line = line.strip(" \t\n\v\f\r")
            if not line:
                continue
            long = len(line) >= line_dedup.MIN_CHARS
            earlier = seen[: seen.index(line)] if line in seen else seen
            if long and any(len(s) >= line_dedup.MIN_CHARS and distance(s, line) <= line_dedup.DISTANCE for s in earlier):
                near += 1
                gone.append(pos)
            elif line in seen:
                exact += 1
                gone.append(pos)
            if line not in seen:
                seen.append(line)
        out.append((doc, len(lines), exact, near, ",".join(map(str, gone))))
    return out


def test_wide_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "WIDE", 20)
    random.seed(4)
    rows = [(d, changed(LINE, d % 6) + "\n" + changed("x" * 24, d % 4) + " \nshort") for d in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\n"), (103, LINE), (104, LINE)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = sorted(tuple(r) for r in line_dedup.line_dedup(docs).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
