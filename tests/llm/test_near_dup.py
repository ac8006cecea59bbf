import random

import brute
from llm_rows import result
from mailsift.llm import near_dup
from test_repeats import made

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_given(spark, docs):
    df, rows = docs
    want = brute.op8(rows)
    assert sum(not r[3] for r in want) > 5
    assert result(near_dup.near_duplicates(df), *COLUMNS) == sorted(want, key=repr)


def test_groups(spark, odd):
    r = random.Random(9)
    rows = made(3)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(200)).split()
    for k in range(150):  # a large group of near copies, many of them not similar to each other
        t = list(base)
        for _ in range(r.randint(1, 8)):
            t[r.randrange(len(t))] = f"v{r.randrange(10 ** 6)}"
        rows.append((1000 + k, " ".join(t)))
    rows += odd[1]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(near_dup.near_duplicates(df), *COLUMNS) == sorted(brute.op8(rows), key=repr)


def test_distinct(spark, odd):
    df, rows = odd
    out = near_dup.distinct_documents(df)
    assert out.schema == df.schema
    components = {r[2] for r in brute.op8(rows) if r[1]}
    left = [r.doc_id for r in out.where("text rlike '[^\\\\s]'").collect()]
    assert set(left) == components and len(left) == len(components) + 1  # two rows of id 16 are no copies
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_contract(spark):
    r = random.Random(2)
    n = 300
    links = [(i, i + 1) for i in range(0, 120)] + [(200, i) for i in range(201, 260)] + [(r.randrange(260, n), r.randrange(260, n)) for _ in range(20)]
    r.shuffle(links)
    name = lambda i: (i * 7919 % 1000).to_bytes(4, "big")
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "u binary, v binary")
    empty = spark.createDataFrame([], "node binary, comp binary")
    first, second = df.limit(len(links) // 2), df.subtract(df.limit(len(links) // 2))
    got = {bytes(x.node): bytes(x.comp) for x in near_dup.contract(near_dup.contract(empty, first), second).collect()}
    root = {name(i): name(i) for i in range(n)}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        p, q = sorted((find(name(a)), find(name(b))))
        root[q] = p
    assert all(got.get(x, x) == find(x) for x in root)


def test_crowded_region(spark, monkeypatch):
    """A templated source: the few similar pairs lie far apart among many texts that are almost similar."""
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(200)], []

    def changed(words, n):
        words = list(words)
        for i in r.sample(range(0, 200, 4), n):
            words[i] = f"v{r.randrange(10 ** 9)}"
        return words

    for k in range(300):  # similarity about 0.75 to each other
        text = changed(base, 7)
        rows.append((2 * k, " ".join(text)))
        if k % 6 == 0:
            rows.append((2 * k + 1, " ".join(changed(text, 5))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name, value in (("TREES", 1), ("MIN_DEPTH", 0), ("LOOK", 2), ("NEIGHBOURS", 1)):  # one region, far over the look
        monkeypatch.setattr(near_dup, name, value)
    want = sorted(brute.op8(rows), key=repr)
    assert sum(not x[3] for x in want) > 40
    assert result(near_dup.near_duplicates(df), *COLUMNS) == want


def test_exact_join_of_templated_texts(spark):
    """Many texts of similarity 0.7 to each other and a few similar ones: the latter are found, the former not paired."""
    r = random.Random(6)
    base, rows = [f"w{i}" for i in range(100)], []

    def changed(places):
        return " ".join(f"v{r.randrange(10 ** 9)}" if i in places else w for i, w in enumerate(base))

    for k in range(60):
        rows.append((k, changed([10, 30, 50, 70])))
    rows += [(100, changed([40])), (101, changed([80])), (102, " ".join(base[:95]))]
    sets = {k.to_bytes(2, "big"): near_dup.Shingler()(t.encode()) for k, t in rows}
    crowd = spark.createDataFrame([(bytearray(k), bytearray(k)) for k in sets], "node binary, comp binary").repartition(3)
    held = spark.createDataFrame([(bytearray(k), bytearray(z.tobytes())) for k, z in sets.items()], "node binary, z binary")
    got = {(bytes(x.u), bytes(x.v)) for x in near_dup._exact(crowd, held, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and near_dup.similar(sets[a], sets[b], 80)}
    assert len(want) >= 3 and want <= got
    assert len(got) <= 4 * len(sets)  # not the square of the group
