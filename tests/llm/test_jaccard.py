import functools
import itertools
import random

from sessionlake.llm import jaccard, simhash


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {d: grams(t) for d, t in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {d for d in up if find(d) == d}


def ids(frame):
    return {r["doc_id"] for r in frame.collect()}


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def test_documents_that_share_a_passage_below_the_threshold_stay(spark):
    rng = random.Random(1)
    passage = [word(rng) for _ in range(124)]  # 120 of 193 shingles shared by all: similarity 0.45
    rows = [(i, " ".join(passage + [word(rng) for _ in range(73)])) for i in range(300)]
    rows += [(1000 + i, " ".join(word(rng) for _ in range(6))) for i in range(200)]  # two shingles each
    assert ids(simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string"))) == {d for d, _ in rows}


def pairs(rng, count):
    for i in range(count):
        n = rng.choice((9, 14, 49, 150, 800))
        one = [word(rng) for _ in range(n)]
        two, at = list(one), n - 1
        # A changed tail of d words costs d shingles a side: (s - d) / (s + d) >= 0.8 up to s / 9.
        for k in range((n - 4) // 9):
            two[at - k] = word(rng)
        yield [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]


def test_no_pair_at_the_threshold_is_lost(spark):
    rows = [r for p in pairs(random.Random(2), 400) for r in p]
    assert ids(simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string"))) == {2 * i for i in range(400)}


def test_groups_against_brute_force_whatever_the_chunks(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [word(rng) for _ in range(rng.choice((12, 60, 200)))]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randrange(0, 2 + len(t) // 12)):
                t[rng.randrange(len(t))] = word(rng)
            rows.append((len(rows), " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, load in ((8192, 1_000_000), (10, 2000)):
        assert ids(jaccard.kept_ids(frame, chunk=chunk, load=load)) == expected(rows)


def test_documents_against_brute_force(documents, texts):
    assert ids(jaccard.kept_ids(documents)) == expected(sorted(texts.items()))


def test_the_stage_links_by_covering_tables_and_checks_each_link(spark, monkeypatch):
    """Without the index of prefixes the covering tables still link every pair within their radius; the index adds
    what is further apart, and no link passes unchecked."""
    rng, rows = random.Random(8), []
    for i in range(120):
        w = [word(rng) for _ in range(400)]
        rows.append((2 * i, " ".join(w)))
        for k in range(i % 8):  # 0 to 7 changed words: similarity 1 to 0.84
            w[20 + 50 * k] = word(rng)
        rows.append((2 * i + 1, " ".join(w)))
    bits = {d: jaccard._fingerprint(jaccard.shingles(t, 5)) for d, t in rows}
    apart = {i: sum(int(x ^ y).bit_count() for x, y in zip(bits[2 * i].view("u8").tolist(), bits[2 * i + 1].view("u8").tolist())) for i in range(120)}
    within = {2 * i + 1 for i, n in apart.items() if n <= simhash.NEAR.reach}
    assert 20 < len(within) < 110
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(simhash.near_duplicates_removed(frame)) == expected(rows) == {2 * i for i in range(120)}
    monkeypatch.setattr(jaccard, "candidates", lambda points, chunk: points.select("h0", "h1", "h0", "h1").toDF("a0", "a1", "b0", "b1").where("false"))
    assert ids(simhash.near_duplicates_removed(frame)) == {d for d, _ in rows} - within
    monkeypatch.setattr(jaccard, "exact_stars", lambda sets: [])
    assert ids(simhash.near_duplicates_removed(frame)) == {d for d, t in rows if d % 2 == 0 or t != rows[d - 1][1]}


def test_a_passage_that_some_documents_share_makes_no_candidates_however_many_documents_there_are(spark, monkeypatch):
    """A passage in a tenth of the documents, whose number is large against the sample's: its holders are long and not
    similar, so they must not become one group of candidates."""
    rng = random.Random(9)
    known = [word(rng) for _ in range(5000)]
    passage = rng.choices(known, k=120)
    rows = [(i, " ".join(passage + rng.choices(known, k=rng.randrange(420, 440)))) for i in range(320)]
    rows += [(1000 + i, " ".join(rng.choices(known, k=10))) for i in range(2880)]
    monkeypatch.setattr(jaccard, "common", functools.partial(jaccard.common, sample=20))
    seen, similar = [], jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda docs, points, edges, words, load: seen.append(edges.count()) or similar(docs, points, edges, words, load))
    assert ids(jaccard.kept_ids(spark.createDataFrame(rows, "doc_id long, text string"))) == {d for d, _ in rows}
    assert seen[0] < 32


def test_a_set_of_a_large_group_is_compared_in_few_tasks(spark, monkeypatch, tmp_path):
    rng, rows = random.Random(10), []
    base = [word(rng) for _ in range(200)]
    for i in range(400):  # near copies of one text, in twenty chunks, and some that only a chain links
        t = list(base)
        for k in range(1 + i % 3 if i % 50 else 5):
            t[rng.randrange(len(t))] = word(rng)
        rows.append((i, " ".join(t)))
    log, solve = str(tmp_path / "compared"), jaccard.exact_stars

    def counted(sets):
        with open(log, "a") as f:
            f.write(f"{sum(map(len, sets))}\n")
        return solve(sets)

    monkeypatch.setattr(jaccard, "exact_stars", counted)
    assert ids(jaccard.kept_ids(spark.createDataFrame(rows, "doc_id long, text string"), load=4000)) == expected(rows)
    assert sum(map(int, open(log))) < 4 * 400 * 196
