import hashlib
import random

from pyspark.sql import functions as F

from tallymast.llm import merkle

from .conftest import FOLDER


def edited(rows):
    """{id: edited text} for different ids."""
    rows = sorted(rows)
    return {i: text[: len(text) - len(text) // 4] + rows[(k + 1) % len(rows)][1][: len(text) // 4] for k, (i, text) in enumerate(rows)}


def test_edited_texts(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").where("doc_id % 7 <> 3")
    texts = dict(map(tuple, df.collect()))
    want = edited(texts.items())
    rows = merkle.edited_fingerprints(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_chars"] == len(texts[r["doc_id"]])
        assert r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {}
    for r in rows:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({p for x in prints.values() for p in x}) == len(prints)


def test_branches_locate_an_edit(spark):
    rnd = random.Random(12)
    paragraphs = [" ".join(f"w{rnd.randrange(1000)}." for _ in range(20)) for _ in range(12)]
    a = "\n\n".join("\n".join(paragraphs[i : i + 3]) for i in range(0, 12, 3))
    b = a.replace(paragraphs[7], paragraphs[7] + " More.")
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint("a").alias("x"), merkle.fingerprint("b").alias("y"))
    places, near, same = df.select(merkle.changed_paragraphs("x", "y"), merkle.likeness("x", "y"), merkle.likeness("x", "x")).first()
    assert places == [7] and 0.9 < near < 1 and same == 1


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    assert merkle.edited_fingerprints(no_docs).count() == 0
    rows = merkle.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["n_chars"] == 0
    # a null id comes first, so the last id is followed by its row
    text = "é ☃ 🎉 \x00"
    assert by[7]["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 4] + "no id here"[: len(text) // 4]).encode()).hexdigest()
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert merkle.edited_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert merkle.edited_fingerprints(one.select("doc_id", F.lit(None).cast("string").alias("text"))).first()["n_chars"] == 0
