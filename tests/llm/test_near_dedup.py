import random

from pyspark.sql import functions as F

from pagelens.llm import near_dedup as N
from pagelens.llm.components import connected_components
from pagelens.llm.queries import QUERIES
from pagelens.llm.simhash_kernel import fingerprint, shingle_hashes

SCHEMA = "doc_id long, text string, source string, fp long"


def _components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprint_matches_its_definition():
    import re

    import xxhash

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for text in ["", "  \t\n", "One", "One two", "A b C", "Ä ö Ü\x0bß x  y\tz", "the the the the", "w " * 5000 + "end", "a b"]:
        assert fingerprint(text.encode()) % (1 << 64) == plain(text)
    assert len(shingle_hashes(b"a b c d")) == 2


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            x = base
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    centre = rng.getrandbits(64)
    for i in range(64):
        fps.add(centre ^ (1 << i))
        fps.add(centre ^ (1 << i) ^ (1 << (i * 7 + 3) % 64))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    near = {tuple(sorted(p)) for p in near}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for hot_bucket in (512, 24, 6):
        got = {tuple(sorted(r)) for r in N.links(df, hot_bucket).collect()}
        assert got <= near
        assert _components(fps, got) == _components(fps, near)
    assert {p for p in near if (p[0] ^ p[1]) & 0xFFFFFFFF == 0 or (p[0] ^ p[1]) >> 32 == 0} <= {tuple(sorted(r)) for r in N.links(df).collect()}


def test_a_half_that_thousands_share_costs_few_rows(spark):
    rng = random.Random(9)
    fps = sorted({0x1234567800000000 | rng.getrandbits(32) for _ in range(3000)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert _components(fps, [tuple(r) for r in N.links(df).collect()]) == _components(fps, near)
    rows = N._signatures(df).where("shiftrightunsigned(key, 32) & 63 = 32").withColumn("equal", F.lit(True))
    assert N._sized(N._pieces(rows), "key", "piece").agg(F.max("members")).first()[0] < 100


def test_the_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    fps = {i: fingerprint((t or "").encode()) for i, t in docs}
    ids = sorted(fps)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3]
    want = {i: (f"{fps[i] & (2**64 - 1):016x}", c) for i, c in _components(ids, near).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()} == want


def test_documents_with_every_odd_case(spark):
    long = "word%d " * 1
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [
        (5, "alpha beta gamma delta epsilon zeta", "x", 1), (3, "Alpha BETA gamma delta epsilon zeta", None, 2), (9, None, "y", 3), (8, "", "y", 4),
        (7, " \n ", "y", 5), (1, long, "z", 6), (2, long + " extra", "z", 7), (4, "something else entirely, here and now", "z", 8), (4, "something else entirely, here and now", "z", 8),
        (None, "a row without an id at all", "z", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in N.near_duplicates(df).select("doc_id", "component_id").collect() if r[0] is not None)
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 3), (7, 7), (8, 7), (9, 7)]
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (1, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == _components({i for e in real for i in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
