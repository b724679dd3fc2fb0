"""Vector codes, filter audit and byte-level BPE against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("veriloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from veriloom.llm import byte_bpe, filter_audit, vector_codes  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD_SPACE = " \t\n\x0b\x0c\r"


# ---- vector codes ----------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label). Results by position of the kept rows, and the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    if order:
        kept = [r for r in kept if len(r[1]) == len(order[0][1])]
        order = [r for r in order if len(r[1]) == len(order[0][1])]
    size = len(order[0][1]) // parts if order else 0
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[list(cut(v, p)) for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            met = {}
            for _, v, _ in kept:
                met.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for n, some in met.items():
                book[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    told = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        told.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, error, label in told:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums[label]) for i, code, error, label in told], books


def _codes(spark, rows, kind="float"):
    table = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, code string")
    told, books = vector_codes.compress(table)
    code = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    out = vector_codes.with_label_error(told).select("vec_id", code.alias("code"), "error", "label_error")
    return [tuple(r) for r in out.collect()], books


def test_codes_against_a_plain_version(spark):
    rng = random.Random(3)
    vec = lambda n=16: [round(rng.gauss(0, 0.3), 3) for _ in range(n)]
    rows = [(i, vec(), rng.choice([None, 0, 1, 2])) for i in range(120)]
    rows += [(200 + i, rows[5][1], 7) for i in range(40)]  # one hot vector
    rows += [(5, vec(), 1), (5, rows[5][1], 1), (None, vec(), None)]  # repeated and missing ids
    rows += [(300, None, 1), (301, [], 1), (302, [*vec(15), None], 1), (303, [*vec(15), float("nan")], 1), (304, [*vec(15), float("inf")], 1), (305, vec(12), 1), (306, vec(24), 1)]
    got, books = _codes(spark, rows, "double")
    # equal ids start in the order of packed components; the plain version takes them in the given order
    starting = sorted((r for r in rows if r[0] == 5), key=lambda r: np.array([math.floor(4096 * x) for x in r[1]], "<i4").tobytes())
    want, plain = plain_codes([r for r in rows if r[0] != 5] + starting)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert books.tolist() == plain


def test_codes_of_little(spark):
    assert _codes(spark, []) == ([], None)
    assert _codes(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)]) == ([], None)
    got, books = _codes(spark, [(2, [0.5] * 8, None), (1, [-0.25] * 8, None), (1, [-0.25] * 8, 4)])
    assert sorted(got, key=str) == [(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "02" * 8, 0, 0)] and books.shape == (8, 3, 1)
    far, _ = _codes(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)], "double")
    assert [r[2] for r in sorted(far)] == [0, 0]
    assert vector_codes.codebooks_text(None) == ""


def test_va_file_loses_no_nearest():
    rng = np.random.default_rng(4)
    for spread in (1, 3, 50, 100_000):
        entries = rng.integers(-spread, spread, (16, 8))
        entries[9] = entries[2]  # a tie goes to the lower index
        asked = np.concatenate([rng.integers(-2 * spread, 2 * spread, (5000, 8)), entries])
        which, error, refined = vector_codes.VaFile(entries).nearest(asked)
        exact = ((asked[:, None] - entries[None]) ** 2).sum(2)
        assert (which == exact.argmin(1)).all() and (error == exact.min(1)).all()
        lower, upper = vector_codes.VaFile(entries).bounds(asked)
        assert (lower <= exact).all() and (exact <= upper).all()
        assert refined < exact.size / 2 or spread == 1


def test_codes_query_against_plain_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = {r.vec_id: r for r in vector_codes.op11_vector_codes(spark, DATA).collect()}
    want, books = plain_codes([(r.vec_id, r.embedding, r.label) for r in rows])
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got.values()} == set(want) and {r.codebooks_sha256 for r in got.values()} == {digest}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert {tuple(r) for r in con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vector_codes.OP11_SQL})").fetchall()} == {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.values()}


# ---- filter audit ----------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if v[at] == 1 and i is not None} for at in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in WORD_SPACE else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and text in first and first[text] < i,
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = lambda r: any(r[1][g] for g in order[:step])  # noqa: B023, E731
                removed = [r for r in own if r[1][f] and not before(r)]
                shapley[f] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not any(r[1][g] for g in order[: step + 1]) for r in own), len(removed), sum(r[1][f] and before(r) for r in own),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed), f,
                ]
        for key, told in out.items():
            if key[0] == part:
                told[-1] = shapley[told[-1]]
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audited(spark, docs, labels):
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, part int, digest string")
    told = filter_audit.audit(filter_audit.flagged(table), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = told.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_a_plain_replay(spark):
    rng = random.Random(8)
    long = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    docs = [(i, rng.choice([long(rng.choice([3, 199, 200, 260])), "ab cd " * rng.choice([2, 120]), long(210) + rng.choice(["", " A", " #", " |", " " + "Z" * 60])]), rng.choice(["a", "b", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i][1], rng.choice(["a", "b"])) for i in range(20)]  # copies in other parts
    docs += [(3, docs[3][1], "a"), (3, docs[3][1], "a"), (None, docs[4][1], "a"), (None, docs[4][1], "b"), (200, None, "c"), (201, "", "c"), (202, " \t\n\x0b\x0c\r", "c"), (203, "a\x1cb\xa0c é" * 400, "c"), (204, "x " * 100_000, "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    got, want = _audited(spark, docs, labels), plain_audit(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})


def test_audit_of_nothing(spark):
    assert _audited(spark, [], []) == {}
    got = _audited(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_audit_query_against_plain(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.op12_filter_audit(spark, DATA).collect()}
    assert got == plain_audit(docs, labels)


# ---- byte-level BPE --------------------------------------------------------------------------


def _plain_encoder():
    import tiktoken

    path = byte_bpe.vocabulary(byte_bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=byte_bpe.ranks(path), special_tokens={}), path


def _hold_to_tiktoken(spark, texts):
    plain, path = _plain_encoder()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows, _ = byte_bpe.encode(table, path)
    got = byte_bpe.decode(rows, path).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        text = texts[r.doc_id] or ""
        want = plain.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want), text[:80]
        assert bytes(r.decoded) == text.encode()


ODD = [
    None, "", " ", "  ", "   ", "\n", " \n \n ", "a  b", "a   b", "a \n b", "a\n  b", "a\n \nb", "a \t  b ", " a", "a ", "a  ", "  a  ", "a   b", "x\x1c y\x85 z",
    "I'll don't 'S 's we've", "<|endoftext|> <|startoftext|>", "1234 5½ ²³ ٣٤", "naïve Straße été ñ 中文字 日本語 ไทย", "é ée", "👩‍👩‍👧 👍🏽", "\u0000 a\u0001", "a'b'sc 'real 're", "﻿x", "퟿", "tail \n",
]


def test_bpe_of_odd_texts(spark):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "中", "1", "½", " ", " ", " ", "\n", "\t", " ", "'s", "'", "!", "👍", "ll"]
    _hold_to_tiktoken(spark, ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400)])


def test_bpe_over_many_chunks_buckets_and_salts(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 500)
    monkeypatch.setattr(byte_bpe, "BUCKET_WORDS", 40)
    monkeypatch.setattr(byte_bpe, "BUCKET_CHUNKS", 3)
    rng = random.Random(6)
    words = ["the", "of", *(f"w{i}" for i in range(300))]
    _hold_to_tiktoken(spark, [" ".join(rng.choices(words, k=rng.randrange(0, 80))) for _ in range(150)] + ["ab" * 60_000, "the " * 40_000, None])


def test_bpe_keys_and_nothing(spark):
    plain, path = _plain_encoder()
    rows, chunks = byte_bpe.encode(spark.createDataFrame([(None, "one two"), (7, "one"), (7, "one"), (7, "two")], "doc_id long, text string"), path)
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows.collect()) == sorted((i, plain.encode_ordinary(t)) for i, t in [(0, "one two"), (7, "one"), (7, "one"), (7, "two")])
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path)[0].collect() == []
    given = spark.createDataFrame([(None,), (b"",), (np.array([10, 11], "<u4").tobytes(),)], "ids binary")
    back = byte_bpe.ranks(path)
    token = {i: t for t, i in back.items()}
    assert [r.decoded for r in byte_bpe.decode(given.coalesce(1), path).collect()] == [None, b"", token[10] + token[11]]
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(np.array([50_256], "<u4").tobytes(),)], "ids binary"), path).collect()


def test_bpe_query(spark):
    plain, _ = _plain_encoder()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = byte_bpe.op13_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
