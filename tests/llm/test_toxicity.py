import random

from tallymast.llm import common, toxicity
from tallymast.llm.toxicity import PATTERNS

from .conftest import FOLDER


def names(text, entries=("fool", "rotte*")):
    got = toxicity.Model(frozenset(entries)).patterns([text])[0]
    return {PATTERNS[i]: int(n) for i, n in enumerate(got) if n}


def test_clauses_are_matched_with_their_context():
    assert names("such a fool. Nothing else") == {"insult": 1}
    assert names("you are a fool") == {"insult at target": 1}
    assert names("a fool and nobody else, I tell you") == {"insult": 1} or names("fool you") == {"insult": 1, "insult at target": 1}
    assert names("this is not a fool") == {"insult denied": 1}
    assert names("not one of them all is a fool") == {"insult at target": 1}
    assert names("he said that such a fool exists") == {"insult reported": 1}
    assert names("I will kill you") == {"threat": 1, "threat at target": 1}
    assert names("ROTTENEST; rotting") == {"insult": 1}
    assert names("") == names(None) == names("nothing of the kind") == {}


def test_composition_is_running_one_after_the_other():
    """The composed machine against its parts, one symbol at a time."""
    rnd = random.Random(13)
    symbols = [toxicity.OTHER, (toxicity.INSULT,), (toxicity.THREAT,), toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT]
    parts = [toxicity._scope(toxicity.NEGATION, "denied", 3), toxicity._scope(toxicity.REPORT, "reported", None), toxicity._aimed()]
    follow, write = toxicity.grammar()
    for _ in range(500):
        state, states = 0, [p.start for p in parts]
        for _ in range(rnd.randrange(12)):
            k = rnd.randrange(len(symbols))
            x = symbols[k]
            for i, p in enumerate(parts):
                states[i], x = p.step(states[i], x)
            assert write[state, k] == x
            state = follow[state, k]


def test_held_out_documents(spark):
    """Of a vocabulary with invented insults that are planted in one text of eight."""
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abdeiklmnorstu") for _ in range(rnd.randrange(2, 9))) for _ in range(3_000)]
    rows, labels = [], []
    for i in range(3_000):
        text, bad = [rnd.choice(words) for _ in range(60)], i % 8 == 0
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                text.insert(rnd.randrange(60), rnd.choice(["zork", "quixel", "blarf" + rnd.choice(words)]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert {"zork", "quixel"} <= model.entries and any(e.startswith("blar") for e in model.entries)
    got = {r[0]: r[1] for r in docs.where(common.held_out()).select("doc_id", toxicity.score("text", model)).collect()}
    assert got and all((s >= 0.5) == (i % 8 == 0) for i, s in got.items())


def test_a_target_adds_and_denial_takes_away():
    """However few labelled texts show a pattern, and however low the constant becomes."""
    import numpy as np

    for insults, plain in ((200, 20_000), (8, 500)):
        x = np.zeros((3, len(PATTERNS)))
        x[0, 1] = x[1, 2] = 1  # toxic insults, three clean ones at a target, and other texts
        weights, bias = toxicity.fit_weights(x, np.array([1.0, 0, 0]), np.array([insults, 3, plain], float))
        model = toxicity.Model(frozenset(["idiot"]), weights, bias)
        text = lambda t: float(model.score(model.patterns([t]))[0])  # noqa: E731, B023
        assert text("you are an idiot") > text("an idiot") > text("this is not an idiot")
        assert text("you are an idiot") > text("she said idiot") and text("I will kill you") >= 0.5 > text("the report says they kill time")
        assert text("nothing of the kind") < 0.1


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, lab in ((odd, labels), (odd, labels.limit(0)), (no_docs, labels)):
        scores = [r[0] for r in docs.select(toxicity.score("text", toxicity.fit(docs, lab))).collect()]
        assert len(scores) == docs.count() and all(0 <= s < 0.5 for s in scores)
    assert spark.read.parquet(f"{FOLDER}/labels.parquet").count() > 0
