"""Recall of line dedup on passages of few lines that stand between other lines."""

import random
import re

from allelix.llm import line_chunks


def brute(rows):
    """Texts without the runs of two lines with words, or more, that occur earlier by (id, place)."""
    seen, want = set(), {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        for a, b in zip(full, full[1:]):
            if (lines[a], lines[b]) in seen:
                gone |= set(range(a, b + 1))
            seen.add((lines[a], lines[b]))
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return want


def test_passages_between_other_lines(spark):
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, passages = [], {}
    for n in range(1, 8):
        for _ in range(20):
            passage = [words(60 // n + 1) for _ in range(n)]
            if n > 1 and r.random() < 0.5:
                passage.insert(1, "")
            for _ in range(2):
                i = len(rows)
                passages[i] = passage
                rows.append((i, "\n".join([words(9) for _ in range(r.randint(1, 5))] + passage + [words(9) for _ in range(r.randint(1, 5))])))
    got = {x["doc_id"]: x["_kept"] for x in line_chunks.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: k["text"] for i, k in got.items()} == brute(rows)
    for i, passage in passages.items():
        long = sum(x != "" for x in passage) > 1
        assert got[i]["n_removed_lines"] == (len(passage) if i % 2 and long else 0)


def test_passages_of_documents(spark, docs, texts, odd, none):
    got = {x["doc_id"]: x["_kept"]["text"] for x in line_chunks.dedup_passages(docs).collect()}
    assert got == brute(list(texts.items())) and got != texts
    rows = line_chunks.dedup_passages(odd).collect()
    assert len(rows) == 13 and sum(x["text"] is None and x["_kept"]["text"] is None for x in rows) == 2
    assert all(x["_kept"]["n_lines"] == len((x["text"]).split("\n")) for x in rows if x["text"] is not None)
    assert line_chunks.dedup_passages(odd).columns == [*odd.columns, "_kept"] and line_chunks.dedup_passages(none).count() == 0
