import random

from tallymast.llm import decontaminate as d

from .conftest import FOLDER


def plain_distance(item, stretch):
    """Least edits between the item and any part of the stretch, by the table."""
    row = [0] * (len(stretch) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(stretch, 1):
            row.append(min(before[j - 1] + (a != b or not a), before[j] + 1, row[j - 1] + 1))
    return min(row)


def test_bit_parallel_distance():
    rnd = random.Random(2)
    for _ in range(300):
        item, stretch = ([rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        stretch = stretch * 2 + [0] * rnd.randrange(3)
        assert d.edit_ends(item, stretch)[0] == plain_distance(item, stretch)


def test_exact_passages_and_recall_of_edited_ones(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    index = d.Items([i for i, _ in items], 0.2).build([t for _, t in items])
    got = {(docs[k][0], leak[0]) for k, own in enumerate(index.search([t for _, t in docs])) for leak in own}
    want = {(i, j) for i, text in docs for j, item in items if item in text}
    assert want and want <= got
    clean = {i for i, _ in docs} - {i for i, _ in want}
    assert len({i for i, _ in got} & clean) <= 2  # a passage that is cut short or edited still counts as a leak

    rnd = random.Random(3)
    words = [w for _, t in docs[:200] for w in t.split()]
    hit = total = 0
    for _ in range(200):
        j, item = rnd.choice(items)
        edited = item.split()
        for _ in range(int(0.2 * len(d.words_of(item)))):
            p, kind = rnd.randrange(len(edited)), rnd.randrange(3)
            if kind == 0:
                edited[p] = rnd.choice(words)
            elif kind == 1:
                edited.insert(p, rnd.choice(words))
            else:
                del edited[p]
        text = " ".join([rnd.choice(words) for _ in range(rnd.randrange(80))] + edited + [rnd.choice(words) for _ in range(30)])
        row = index.rows[[i for i, _ in items].index(j)]
        if plain_distance(row, [index.words.get(w, 0) for w in d.words_of(text)]) <= int(0.2 * len(row)):
            total += 1
            hit += any(leak[0] == j for leak in index.search([text])[0])
    assert total > 150 and hit >= 0.95 * total


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (4, "short"), (None, "word word word word word word")], "item_id long, text string")
    rows = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in d.leaks(odd, items).collect())
    assert rows == [(4, -1, 0), (5, 1, 0), (6, 1, 0), (6, 1, 0)]
    kept = d.keep_clean(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 7]
    assert d.leaks(no_docs, items).count() == 0 and d.leaks(odd, items.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = sorted(map(tuple, d.leaks(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_ITEMS", 15)
    assert want and sorted(map(tuple, d.leaks(docs, items).collect())) == want


WORDS = [f"w{i}" for i in range(3_000)]


def mixed(item, edits, rnd):
    """The item after so many replacements, insertions and deletions at random places."""
    out = list(item)
    for _ in range(edits):
        p, kind = rnd.randrange(len(out)), rnd.randrange(3)
        out[p : p + (kind != 1)] = [rnd.choice(WORDS)] * (kind != 2)
    return out


def recall(n, change, tries=60):
    """Share of equally long items found in documents that hold them changed, at random places."""
    rnd = random.Random(n)
    items = [[rnd.choice(WORDS) for _ in range(n)] for _ in range(tries)]
    index = d.Items(list(range(tries)), 0.2).build([" ".join(x) for x in items])
    texts = [" ".join([rnd.choice(WORDS) for _ in range(rnd.randrange(300))] + change(x, int(0.2 * n), rnd) + WORDS[:60]) for x in items]
    return sum(any(leak[0] == j for leak in index.search([t])[0]) for j, t in enumerate(texts)) / tries


def test_recall_does_not_fall_with_length():
    for n in (20, 50, 51, 76, 120, 200, 400):
        assert recall(n, mixed) >= 0.95, n


def spread(item, edits, rnd):
    """The item after so many replacements, each apart from the others: every one breaks two pairs."""
    out = list(item)
    for k in range(edits):
        out[min(len(out) - 1, int((k + 0.5) * len(out) / edits))] = f"x{rnd.getrandbits(40)}"
    return out


def test_equally_long_items_with_spread_replacements():
    for n in (20, 37, 50, 59, 76, 150, 400):
        assert recall(n, spread) >= 0.9, n


def test_items_of_few_words_and_scripts_without_spaces():
    long = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    index = d.Items([1, 2, 3, 4, 5], 0.2).build(["Short Item here", "solo", long, "ภาษาไทยไม่มีช่องว่าง", "  "])
    found = lambda *texts: [[leak[:2] for leak in own] for own in index.search(list(texts))]
    assert found("a short item, here is", "short item", "item here", "a solo b solo", "") == [[(1, 0)], [], [], [(2, 0)], []]
    assert index.search(["a b solo solo"]) == [[(2, 0, 1, 2)]]
    assert found("古诗" + long + "。", "x " + long.replace("鸟夜", "鸡夜") + " y", "这里ภาษาไทยไม่มีช่องว่าง", "春天来了") == [[(3, 0)], [(3, 1)], [(4, 0)], []]
