import math
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from veriloom.functions import filters, ids, text, vectors

TEXTS = ["", None, "Hello World hello", "车灯检查 light 座椅", "été 12ab3", "a b c", "😀 灯", "灯 x 光"]


def plain_tokens(s):
    low = (s or "").lower()
    chars = re.findall("[一-鿿]", low)
    return chars + ["".join(p) for p in zip(chars, chars[1:])] + re.findall("[a-z0-9]+", low)


def test_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", text.tokens(F.col("t")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: plain_tokens(t) for i, t in enumerate(TEXTS)}


def test_text_expressions(spark):
    one = lambda e, v: spark.createDataFrame([(v,)], "t string").select(e(F.col("t"))).first()[0]
    assert one(text.squeeze, "  a b  c\t") == "a b c"
    assert one(text.body, "x\n正文：\n hi \n") == "hi" and one(text.body, " bare ") == "bare"
    assert one(text.embedding_text, "车型：A\n手册版本：2\n路径：b\n正文：\nc") == "路径：b\n正文：\nc"
    assert one(text.content_tag, "电池 安全") == "safety" and one(text.content_tag, "nothing") == "general" and one(text.content_tag, "座椅") == "comfort"
    assert one(text.normalized, "  车灯，  检查！ ") == "车灯 检查"
    assert one(text.nfkc, "ＡＢ①") == unicodedata.normalize("NFKC", "ＡＢ①")
    assert one(lambda c: text.expanded(c, {"灯": ["照明灯", "灯光"]}), "检查 灯") == "检查 灯 照明灯 灯光"
    assert one(lambda c: text.aliased(c, {"a.c": "x", "x": "y"}), "A.C abc") == "y abc"
    long = "字" * 400 + "。" + "文" * 400
    assert one(text.reference_body, long) == "字" * 400 + "。"
    assert one(text.reference_body, "字" * 800) == "字" * 700 + "…"


def test_ids(spark):
    names = ["m|1|t|a/b|1|h", "", "车灯"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows)


def plain_embedding(t, dim):
    import hashlib

    low = t.lower()
    dense = re.sub(r"\s+", "", low)
    v = [0.0] * dim
    for k in [dense[i : i + 2] for i in range(len(dense) - 1)] + re.findall("[a-z0-9]+", low):
        d = hashlib.sha256(k.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1 if d[4] % 2 == 0 else -1
    if not any(v):
        for i, b in enumerate(hashlib.sha256(t.encode()).digest()):
            v[i % dim] += (b - 127.5) / 127.5
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_hash_embedder(spark):
    texts = ["hello world", "", "灯", "车灯 light", "aaaa"]
    got = vectors.hash_embed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 64).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.embedding == pytest.approx(plain_embedding(texts[r.id], 64), abs=1e-6)


def test_cosine_and_summary(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    s = df.limit(1).select(vectors.summary(F.col("b")).alias("s")).first().s
    assert (s.dimension, s.min, s.max, s.mean, s.std, s.largest) == (2, 1.0, 1.0, 1.0, 0.0, [0, 1])


def test_filters(spark):
    rows = spark.createDataFrame([("a", "1", "x", "k1", "n", "t1"), ("a", "2", "x", None, None, "t2")], "manual_id string, snapshot_id string, vehicle_model string, manual_key string, manual_name string, topic_id string")
    count = lambda **f: rows.filter(filters.RetrievalFilters(**f).predicate()).count()
    assert (count(), count(manual_id="a"), count(snapshot_id="2"), count(manual_keys=["k1", "k2"]), count(topic_ids=["t9"])) == (2, 2, 1, 1, 0)
    f = spark.sql("select named_struct('manual_id', 'a', 'snapshot_id', '', 'vehicle_model', cast(null as string), 'manual_keys', array('k1'), 'manual_names', cast(array() as array<string>), 'topic_ids', cast(null as array<string>)) as filters")
    assert rows.crossJoin(f).filter(filters.batched()).count() == 1
