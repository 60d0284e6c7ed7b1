"""H5: canonical JSON equals the key-sorted dump of the parsed value."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from passforge.functions.canonical import canonical_json
from passforge.functions.ids import config_hash


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 7)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([0, -1, 7, 10**15, -10**25, 123456789012345678])
    if kind in (2, 3):
        return rng.choice([0.0, -0.0, 1.0, 0.1, 2.5, 1e-5, 1.5e-7, 1e16, 1e15, 123456.789, 1e22, 1.7976931348623157e308, 5e-324,
                           rng.random(), rng.random() * 10 ** rng.randint(-20, 20), -rng.random() / 1000])
    if kind in (4, 5, 6):
        signs = 'ab"\\/\n\t\r\b\f\x01\x0b\x1f\x7fé漢😀,:{}[]sn1.0 '
        return "".join(rng.choice(signs) for _ in range(rng.randint(0, 8)))
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {str(value(rng, 9)): value(rng, depth + 1) for _ in range(rng.randint(0, 5))}


def shuffled(rng, v):
    """The same value written with other key order, spacing and escapes."""
    if isinstance(v, dict):
        items = list(v.items())
        rng.shuffle(items)
        gap = rng.choice(["", " ", "\n  "])
        return "{" + gap + ("," + gap).join(shuffled(rng, k) + " :" + gap + shuffled(rng, x) for k, x in items) + "}"
    if isinstance(v, list):
        return "[" + " , ".join(shuffled(rng, x) for x in v) + " ]"
    if isinstance(v, float):
        return rng.choice([repr(v), f"{v:.17e}" if v else repr(v)])
    return json.dumps(v, ensure_ascii=rng.random() < 0.5)


def test_equals_sorted_dump(spark):
    rng = random.Random(11)
    values = [{"cfg": value(rng)} for _ in range(400)]
    values += [value(rng) for _ in range(300)]
    rows = [(i, shuffled(rng, v), json.dumps(v, sort_keys=True)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, text string, want string").select(
        "i", "text", "want", canonical_json("text").alias("got"), config_hash("text").alias("h")).collect()
    wrong = [(r["text"], r["want"], r["got"]) for r in got if r["got"] != r["want"]]
    assert not wrong, wrong[:3]
    assert all(r["h"] == hashlib.sha256(r["want"].encode()).hexdigest()[:12] for r in got)


def test_order_and_spacing_do_not_change_the_hash(spark):
    rows = [('{"b": {"y": 1, "x": [1.50, "é"]}, "a": null}',), ('{"a":null,"b":{"x":[1.5,"\\u00e9"],"y":1}}',)]
    assert spark.createDataFrame(rows, "c string").select(config_hash("c")).distinct().count() == 1


def test_text_that_is_no_json(spark):
    df = spark.createDataFrame([("{oops",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(canonical_json("c")).collect()] == [None, None, None]
    want = hashlib.sha256(b"{oops").hexdigest()[:12]
    assert df.select(config_hash(F.col("c"))).first()[0] == want


def test_config_hashes_are_dealt_to_all_tasks(spark, tmp_dir):
    """A part table of one small file is one split; its fingerprints are CPU-bound."""
    import os

    from passforge.plans.q_runlog import h5
    spark.range(40).selectExpr("id as p_partkey", "cast(id % 7 as int) as p_size", "concat('näme ', id) as p_name") \
        .coalesce(1).write.parquet(os.path.join(tmp_dir, "part.parquet"))
    out = h5(spark, tmp_dir)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {k: hashlib.sha256(json.dumps({"z": {"c": {}, "b": [k % 7, 2.5, f"é漢 näme {k}"], "a": None}, "k": k, "A": 1e-5},
                                         sort_keys=True).encode()).hexdigest()[:12] for k in range(40)}
    assert {r["p_partkey"]: r["config_hash"] for r in out.collect()} == want


def test_a_number_names_its_text_once(spark):
    """The digits of a number are found once, not at every place of the expression that needs them."""
    plan = spark.createDataFrame([("1.50",)], "t string").select(canonical_json("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("%.16e") <= 2, plan.count("%.16e")
