import random
import re

from tallymast.llm import pii

from .conftest import ODD


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = sum(d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_base_spans_are_those_of_the_plain_patterns():
    rnd = random.Random(8)
    parts = ["a@b.c", "x.y@z", "@", "a@b.c@d.e", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44.20", " ", "-", ".", "word", "é", "+", "12", "0001.2.3.4", "\n"]
    for _ in range(3_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for run in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "1." * 100_000, "+" * 200_000):
        pii.base_spans(run)


def samples(rnd, n):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    for _ in range(n):
        number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
        thing = rnd.choice([f"{word()}.{number(2)}@{word()}.{word()}", ".".join(str(rnd.randrange(256)) for _ in range(4)), f"+1 ({number(3)}) {number(3)}-{number(4)}", number(4), f"v{number(1)}.{number(1)}"])
        yield " ".join([word() for _ in range(8)] + [thing] + [word() for _ in range(8)])


def test_network_learns_the_spans_and_base_spans_stay():
    rnd = random.Random(9)
    tagger = pii.train(list(samples(rnd, 900)), updates=300)
    texts = list(samples(rnd, 300))
    base = [pii.base_spans(t) for t in texts]
    alone = tagger.added(texts, [[] for _ in texts])
    want, got = ({(k, *s) for k, own in enumerate(spans) for s in own} for spans in (base, alone))
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)
    for own, more in zip(base, tagger.added(texts, base), strict=True):
        assert not any(a < e and s < b for a, _, b in own for s, _, e in more)


def test_paths_are_the_best_of_all():
    """Viterbi and its way out against trying every path, with transitions as large as the emissions."""
    import itertools

    import numpy as np

    draw = np.random.RandomState(5)
    tagger = pii.Tagger.fresh(3, 1)
    for _ in range(60):
        e, t = draw.normal(0, 1, (4, pii.LABELS)), draw.normal(0, draw.choice([0.1, 1, 3]), (pii.LABELS, pii.LABELS))
        e[:, 0] += draw.choice([0, 3, 9])
        tagger.weights["t"] = t
        score = lambda p: sum(e[k, a] for k, a in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(pii.LABELS), repeat=4), key=score)
        assert tuple(tagger.viterbi(e)) == best


def test_what_a_check_refuses_is_not_added(spark):
    """Numbers that look like cards and fail their check digit, in a corpus of such that hold."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))

    def number(holds):
        while True:
            digits = "".join(rnd.choice("0123456789") for _ in range(16))
            if pii.luhn(digits) == holds:
                return digits

    texts = [" ".join([word() for _ in range(rnd.choice([5, 4000]))] + [number(True), word()]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tagger = pii.fit(docs, updates=150)  # spans behind 20,000 characters count too
    wrong = [f"{word()} {number(False)} {word()}" for _ in range(50)]
    assert pii.Tagger.added(tagger, wrong, [[] for _ in wrong]) == [[] for _ in wrong]
    right = [f"{word()} {number(True)} {word()}" for _ in range(50)]
    assert sum(map(bool, tagger.added(right, [[] for _ in right]))) > 40


def test_gradient_is_that_of_the_likelihood():
    import numpy as np

    tagger = pii.Tagger.fresh(3, 1)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    draw = np.random.RandomState(2)
    x, y = draw.randint(0, pii.N_CLASSES, (4, 7)), draw.randint(0, pii.LABELS, (4, 7))
    _, grads = tagger.gradient(x, y)
    for name, weights in tagger.weights.items():
        at = tuple(draw.randint(0, n) for n in weights.shape) if name[1:] != "x" else (int(x[0, 3]), 2)
        weights[at] += 1e-3
        up, _ = tagger.gradient(x, y)
        weights[at] -= 2e-3
        down, _ = tagger.gradient(x, y)
        weights[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2, name


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    assert pii.redacted(no_docs).count() == 0
    assert {r["doc_id"]: r["text"] for r in pii.redacted(odd).collect()} == dict(ODD)
    some = spark.createDataFrame([(1, "mail a.b@c.org now", 18), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redacted(some).orderBy("doc_id").collect()] == [(1, "mail [email] now", 16), (2, None, None)]
