import corpus_pipeline
from tallymast.llm import decontaminate, pii, sentencepiece

from .conftest import FOLDER
from .test_ngram_jaccard import brute


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in stages.items():
        docs = out[name] = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(out[n].columns == columns for n in list(out)[:-1])
    rows = {n: {r["doc_id"]: r for r in df.collect()} for n, df in out.items()}

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = [q for i, q in labels.items() if i in rows["quality"]]
    gone = [q for i, q in labels.items() if i not in rows["quality"]]
    assert sum(kept) >= 0.95 * len(kept) and sum(gone) <= 0.3 * len(gone)

    before = [(i, r["text"]) for i, r in rows["quality"].items()]
    assert set(rows["ngram_jaccard"]) == {d for d, _, low in brute(before) if d == low}

    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dropped = set(rows["ngram_jaccard"]) - set(rows["decontamination"])
    leaks = {i for i, r in rows["ngram_jaccard"].items() if any(t in r["text"] for t in items)}
    assert leaks <= dropped
    index = decontaminate.Items(list(range(len(items))), 0.2).build(items)
    assert dropped == {i for i, r in rows["ngram_jaccard"].items() if index.search([r["text"]])[0]}

    for i, r in rows["decontamination"].items():
        clean = rows["pii"][i]["text"]
        assert rows["pii"][i]["n_chars"] == len(clean)
        assert not pii.base_spans(clean)
        if not pii._CENTRE.search(r["text"]):
            assert clean == r["text"]

    pieces = sentencepiece.Pieces.load()
    assert all(pieces.decode(list(r["token_ids"])) == rows["pii"][i]["text"] for i, r in rows["sentencepiece"].items())


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
