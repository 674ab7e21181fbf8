"""The join against brute force: real documents, a dense group of near copies, odd rows."""

import random
import re

from tallymast.llm.ngram_jaccard import keep_one, near_duplicates

from .conftest import FOLDER, ODD


def sets(rows):
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        yield {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(n, smallest id reachable) of every row; rows are nodes."""
    own = list(sets(rows))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(doc, low.get(top(i), doc))
    return sorted(((d, len(s), low.get(top(i), d)) for i, ((d, _), s) in enumerate(zip(rows, own, strict=True))), key=str)


def found(df):
    return sorted(map(tuple, near_duplicates(df).collect()), key=str)


def test_real_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert found(df) == brute([tuple(r) for r in df.collect()])


def test_dense_group_around_the_threshold(spark):
    """Edits of one text from none to many, so that links fail and hold all around 3/4."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randrange(0, 14)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10_000)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:20] + [f"y{i}_{k}" for k in range(60)])) for i in range(40)]  # a shared passage is no link
    rows += [(3000 + i, " ".join(base)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert found(df) == want
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    assert found(odd) == brute(ODD)
    assert found(no_docs) == []
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
