import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import exact_dedup as E
from veriloom.llm import line_dedup as L
from veriloom.llm import near_dedup as N

#: doc_id, text, and columns whose names operators use inside.
WIDE = "doc_id long, text string, digest string, shard string, winner string, size string, body string, a string, line string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], WIDE)


ODD = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 300_000), (6, "b" * 300_000), (7, "a "), (7, "a "), (None, "a"), (8, "A")]


# ---- exact ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 3000])
def test_minimal_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    pilots, slot = E.build_pilots(keys)
    assert sorted(slot.tolist()) == list(range(n))
    assert (E.find_slots(keys, pilots, n) == slot).all()
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    at = E.find_slots(other, pilots, n)
    held = keys[np.argsort(slot)]
    assert ((at >= 0) & (at < n)).all() and not (held[at] == other).all(1).any()  # the byte check refuses nonmembers


def test_exact_against_plain(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + i, f"text {rng.randrange(40)}") for i in range(200)] + [(1000 + i, "hot") for i in range(150)]
    docs = wide(spark, rows)
    got = E.exact_dedup(*E.split_generations(docs)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted(((i, max(x for x in groups[t or ""] if x is not None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_generations(spark):
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c"), (5, "c")]))
    got = {r.doc_id: (r.keep_id, r.is_new) for r in E.exact_dedup(old, new).collect()}
    assert got == {1: (3, False), 2: (2, False), 3: (3, False), 4: (5, True), 5: (5, True)}
    far = spark.createDataFrame([(-5, "x"), (None, "x"), (None, "y"), ((1 << 62) + 1, "z"), (None, "z")], "doc_id long, text string")
    told = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(far, far.filter("doc_id < 0")).collect()), key=repr)
    top = (1 << 62) + 1
    assert told == sorted([(-5, -5, 3, True), (-5, -5, 3, True), (None, -5, 3, False), (None, None, 1, True), (top, top, 2, True), (None, top, 2, False)], key=repr)
    assert E.exact_dedup(old.limit(0), new).count() == 3 and E.exact_dedup(old, new.limit(0)).count() == 2
    assert E.exact_dedup(old.limit(0), new.limit(0)).count() == 0


def test_groups_come_from_the_slots(spark):
    """What the slots say is what is decided: a wrong locator in the index is a wrong winner."""
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(0, "a"), (4, "c")]))
    row = E._sharded(E.groups_of(E.digests(old)), 1).groupBy("shard").applyInPandas(E._build, E.INDEX_SCHEMA).toPandas()
    forged = row.assign(winners=[np.full(2, 77, np.int64).tobytes()])
    told = E._arrive(forged, E.groups_of(E.digests(new)).toPandas())
    assert sorted(zip(told["winner"], told["size"], told["is_new"])) == [(4, 1, True), (77, 1, False), (77, 2, False)]


def test_hot_groups_are_broadcast(spark, monkeypatch):
    from veriloom.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    test_exact_against_plain(spark)


# ---- lines ---------------------------------------------------------------------------------


def plain_lines(rows):
    """Contract of the query on (doc_id, text) rows with distinct ids."""
    trim, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.translate(low).strip(trim)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 2 and i != min(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_rows(n=120, seed=5):
    rng = random.Random(seed)
    pool = [f"Shared Line number {i} " + "x" * (i % 5) for i in range(30)] + ["short", "", "  padded line here\t", "PADDED LINE HERE", "été à la française", "ÉTÉ à la française"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {k}" for k in range(rng.randrange(9)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "one long line " * 20_000)]


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_lines_against_plain(spark):
    rows = line_rows()
    docs = wide(spark, rows)
    state = L.build(docs)
    assert result(L.apply(docs, L.drops(state))) == plain_lines(rows)


def test_hot_lines_take_the_other_way(spark, monkeypatch):
    rows = line_rows()
    docs = wide(spark, rows)
    monkeypatch.setattr(L, "HOT_LEAST", 3)
    assert result(L.apply(docs, L.drops(L.build(docs)), keep_text=False)) == plain_lines(rows)


def test_lines_are_reversible(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    early, late = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    state = L.insert(L.build(early), late)
    assert result(L.apply(docs, L.drops(state))) == plain_lines(rows)
    back = L.delete(state, late.select("doc_id"))
    kept = [(i, t) for i, t in rows if i % 3 > 0]
    assert result(L.apply(early, L.drops(back))) == plain_lines(kept)
    plain = L.build(early)
    key = lambda df: sorted((bytes(r.digest), r.refs, r.first, r.last) for r in df.collect())
    assert key(back.counts) == key(plain.counts)


def test_lines_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.apply(docs, L.drops(L.build(docs))).count() == 0


def test_cuckoo_filter():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(4000)), np.uint8).reshape(-1, 32)
    held = L.CuckooFilter.sized(2000)
    held.insert(keys[:2000])
    assert held.holds(keys[:2000]).all() and held.holds(keys[2000:]).mean() < 0.01
    held.delete(keys[:1000])
    assert held.holds(keys[1000:2000]).all() and held.holds(keys[:1000]).mean() < 0.01
    tight = L.CuckooFilter(512)  # 1,900 keys in 2,048 cells: found again, few in the stash
    tight.insert(keys[:1900])
    assert tight.holds(keys[:1900]).all() and len(tight.stash) < 20 and tight.load == 1900 / 2048
    full = L.CuckooFilter(2)  # overfull: what finds no cell goes to the stash
    full.insert(keys[:50])
    again = L.CuckooFilter(*full.row(0)[1:])
    assert again.holds(keys[:50]).all() and again.stash
    again.delete(keys[:50])
    assert not again.cells.any() and not again.stash


def test_filters_grow(spark, monkeypatch):
    """Inserts that double the state: shards are dealt anew or enlarged, decisions equal a fresh build."""
    monkeypatch.setattr(L, "SHARD_POSTINGS", 64)
    rows = [(i, "\n".join(f"line number {(i * 13 + k * k) % (40 + i)} of many" for k in range(6))) for i in range(192)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state, n = L.build(docs.filter("doc_id < 3")), 3
    first = state.shards
    while n < 192:
        state = L.insert(state, docs.filter(f"doc_id >= {n} and doc_id < {2 * n}"))
        n *= 2
        held = [L.CuckooFilter(r.buckets, r.cells, r.stash) for r in state.filters.collect()]
        assert all(x.load <= L.FULL and len(x.stash) < 8 for x in held)
    assert state.shards > first
    assert result(L.apply(docs, L.drops(state))) == plain_lines(rows)
    monkeypatch.setattr(L, "SHARD_POSTINGS", 1 << 20)  # one shard that can only be enlarged
    state = L.insert(L.build(docs.filter("doc_id < 6")), docs.filter("doc_id >= 6"))
    assert state.shards == 1 and state.filters.count() == 1 and result(L.apply(docs, L.drops(state))) == plain_lines(rows)


def test_lines_of_rows_without_telling_keys(spark):
    """Repeated doc_ids are one document; rows without doc_id neither count nor lose lines."""
    line = "a line that is shared"
    docs = spark.createDataFrame([(1, line), (1, line + "\nown line of the second"), (None, line), (None, "alone in a nameless row"), (2, "alone in a nameless row\n" + line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.apply(docs, L.drops(L.build(docs))).collect()), key=repr)
    assert got == sorted([(1, 1, 0, line), (1, 2, 0, line + "\nown line of the second"), (None, 1, 0, line), (None, 1, 0, "alone in a nameless row"), (2, 2, 1, "alone in a nameless row")], key=repr)


# ---- near ----------------------------------------------------------------------------------


def plain_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows(seed=1):
    """Copies edited once and repeatedly (chains whose ends differ), families around 0.75, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.randrange(20, 200))]
        now = base
        for _ in range(rng.randrange(1, 14)):
            now = list(base if rng.random() < 0.5 else now)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                now[rng.randrange(len(now))] = word()
            rows.append(" ".join(now))
    rng.shuffle(rows)
    odd = [None, "", " \n\t", "one two", "ONE  two", "one two three four five", "x " * 60_000, "x " * 60_000 + "y", "été É", "ÉTÉ é"]
    return list(enumerate(rows + odd))


@pytest.mark.parametrize("block", [512, 3])
def test_near_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "CHUNK", 2 if block == 3 else 256)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(wide(spark, rows)).collect()}
    assert got == plain_near(rows)


def template_rows(n, seed=4, words=60, own=14):
    """Pages of one template with a few words of their own: alike, but too little to link; some near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head = [word() for _ in range(words)]
    rows = []
    for i in range(n):
        mine = [word() for _ in range(own)]
        rows.append((i, " ".join(head + mine)))
        if i % 10 == 0:  # a copy with one word more
            rows.append((n + i, " ".join(head + mine + [word()])))
    return rows


def test_wide_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = template_rows(150, own=22) + [(900, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(wide(spark, rows)).collect()}
    want = plain_near(rows)
    assert got == want and len({c for _, c, _ in want.values()}) >= 150  # they do stay apart


def test_unlike_members_of_a_bucket_move_no_text(spark, monkeypatch):
    """A bucket of documents of one template, too unlike to link: signatures alone tell them apart."""
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = [(i, t) for i, t in template_rows(600, own=90) if i < 600]
    reps = N.signed(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    bucket = reps.select("doc_id", F.element_at("bands", 1).alias("bucket"))
    shared = bucket.select(F.lit(7).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("hub"), F.lit(600).cast("long").alias("size"), "doc_id")
    # all of them are put into one bucket, which takes the place of their first band
    reps = reps.withColumn("bands", F.transform("bands", lambda x, i: F.when(i == 0, F.lit(7).cast("long")).otherwise(x)))
    none = spark.createDataFrame([], "node long, component long")
    assert N._blocks(shared, none, reps).count() == 0


def test_near_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_dedup(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "A B")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_dedup(odd).collect()), key=repr)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_near_of_one_doc_id_with_several_texts(spark):
    """Each text links by itself under its doc_id."""
    text = lambda n, end="": " ".join(f"w{n}x{k}" for k in range(40)) + end
    rows = [(1, text(1)), (1, text(2)), (2, text(1, " more")), (3, text(2, " more")), (4, text(4)), (4, None), (4, text(4)), (0, text(4, " x")), (None, text(1)), (5, text(5)), (5, text(6)), (6, text(7))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(docs).collect()), key=repr)
    want = [(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 37, 1, False), (4, 36, 0, False), (4, 0, 4, True), (4, 36, 0, False), (0, 37, 0, True), (None, 36, None, True), (5, 36, 5, True), (5, 36, 5, True), (6, 36, 6, True)]
    assert got == sorted(want, key=repr)


def test_min_max_estimates():
    rng = np.random.default_rng(0)
    far = []
    for share in (0.75, 0.5):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = 1000
        over = round(2 * n * share / (1 + share))
        a, b = both[:n], np.concatenate([both[:over], both[n : 2 * n - over]])
        far.append((N.signature(a) == N.signature(b)).mean() - share)
    assert max(map(abs, far)) < 0.13
    assert (1 - 0.75**N.ROWS) ** N.BANDS < 2e-6


def test_components(spark):
    from veriloom.llm.components import components

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
