import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallymast.llm import queries, runs

from .conftest import FOLDER


def brute(words, least, times):
    """Maximal stretches by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            smaller = any(all(words[x] == words[x + r] for x in range(s, e - r)) for r in range(1, q))
            if e - s >= max(least, times * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rnd = random.Random(11)
    for _ in range(400):
        least, times = rnd.choice([(24, 3), (6, 3), (4, 2), (8, 2), (9, 4)])
        texts = []
        for _ in range(rnd.randrange(1, 4)):
            n, k = rnd.randrange(90), rnd.choice([1, 2, 2, 3, 5])
            words = [rnd.randrange(k) for _ in range(n)]
            if n > 3 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = rnd.randrange(1, max(2, (n - a) // 3 + 1))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(words, np.int64))
        assert runs.find_runs(texts, least, times) == [brute(t.tolist(), least, times) for t in texts]


def test_the_shortest_prefix_of_a_run():
    assert runs.shortest_prefix() == 16
    assert runs.shortest_prefix(10, 2) == 5


def test_long_loops_are_not_quadratic():
    words = np.concatenate((np.arange(1000), np.tile(np.arange(7), 40_000)))
    assert runs.find_runs([words]) == [[(1000, 280_000, 7)]]
    assert runs.find_runs([np.zeros(200_000, np.int64)]) == [[(0, 200_000, 1)]]


def test_query_against_plain_python(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    looped = 0
    for doc_id, text in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, looped = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], looped + 1
        if len(words) > 1500:
            continue
        want = brute(words, 24, 3)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        r = rows[doc_id]
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
    assert looped


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    assert runs.periodic_runs(no_docs).count() == 0 and runs.with_loops(no_docs).count() == 0
    out = runs.periodic_runs(odd)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["runs"] == by[2]["runs"] == by[3]["runs"] == [] and by[1]["collapsed"] == by[3]["collapsed"] == ""
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 40_000, 1)] and by[4]["collapsed"] == "word"
    assert by[7]["collapsed"] == "é ☃ 🎉 \x00" and by[None]["collapsed"] == "no id here, only a text"
    assert [r["collapsed"] for r in rows if r["doc_id"] == 6] == ["one two three four five six"] * 2
    # a no-break space parts no words
    one = spark.createDataFrame([(1, "a b " * 30 + "\x0b\x0c c")], "doc_id long, text string")
    assert runs.periodic_runs(one).first()["collapsed"] == "a b c"
    digest = runs.periodic_runs(odd.where("doc_id = 1")).select(*runs.digest()).first()
    assert digest["n_runs"] == 0 and digest["start"] is None and digest["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert runs.with_loops(odd).where(F.col("doc_id").isNull()).first()["text"] == "no id here, only a text"
