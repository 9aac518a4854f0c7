import os
import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from voxgrain.operators import aliases, fuzzy

TERMS = ["Kubernetes", "Wayland", "AppImage", "Svelte", "Terakeet", "kubectl", "Syncthing", "Tauri"]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def allowed(word, joined):
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 3 if joined and len(word) >= 12 else 2


def nearest(word, most):
    found = [(distance(word, t.lower()), k, t) for k, t in enumerate(TERMS)]
    return min((f for f in found if f[0] <= most), default=None)


def terms(spark):
    return spark.createDataFrame(list(enumerate(TERMS)), "line_no long, term string")


def spoiled(rnd, word, n):
    for _ in range(n):
        at = rnd.randrange(len(word) + 1)
        word = word[:at] + rnd.choice(["", "x", "é", "e"]) + word[at + rnd.randrange(2) :]
    return word


def test_near_terms_are_those_of_all_pairs(spark):
    rnd = random.Random(2)
    words = {spoiled(rnd, rnd.choice(TERMS).lower(), rnd.randrange(5)) for _ in range(600)} | {"", "a", "é"}
    rows = [(w, allowed(w, j)) for w in words for j in (False, True)]
    found = {(r.word, r.most): (r.edits, r.term) for r in fuzzy.near_terms(spark.createDataFrame(rows, "word string, most int"), terms(spark)).collect()}
    want = {(w, m): (f[0], f[2]) for w, m in rows if (f := nearest(w, m))}
    assert found == want and len(want) > 200
    plan = fuzzy.near_terms(spark.createDataFrame(rows, "word string, most int"), terms(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def repaired(spark, words, **how):
    rows = [("c", i, w, p) for i, (w, p) in enumerate(words)]
    df = spark.createDataFrame(rows, "clip string, index long, word string, confidence double")
    return [(r.word, r.n) for r in fuzzy.repair(df, terms(spark), "clip", **how).orderBy("index").collect()]


def test_repair(spark):
    low, high = 0.2, 0.9
    words = [("(kubernetis,", low), ("kubernetis", high), ("WAYLAND.", high), ("app", high), ("image!", high), ("sync", low), ("thang", low), ("sync", low), ("thang", high), ("tori", low), ("there", low), ("svelt", None), ("svelt", low), ("", low), ("—", low)]
    got = repaired(spark, words)
    assert got == [("(Kubernetes,", 1), ("kubernetis", 1), ("Wayland.", 1), ("AppImage!", 2), ("Syncthing", 2), ("sync", 1), ("thang", 1), ("tori", 1), ("there", 1), ("svelt", 1), ("Svelte", 1), ("", 1), ("—", 1)]
    assert repaired(spark, [("app", high), ("image,", high), ("app", high), ("image", high)]) == [("AppImage,", 2), ("AppImage", 2)]
    assert repaired(spark, [("app.", low), ("image", low)]) == [("app.", 1), ("image", 1)]  # a sentence ends in between
    assert repaired(spark, [("kubernetis", low), ("WAYLAND", low), ("app", high), ("image", high)], most_terms=3) == [("kubernetis", 1), ("Wayland", 1), ("AppImage", 2)]
    assert repaired(spark, []) == []


def sighting(spark, rows):
    return spark.createDataFrame([(h, m, datetime.fromtimestamp(1_700_000_000 + k, UTC)) for k, (h, m) in enumerate(rows)], "heard string, meant string, at timestamp")


def seen(store):
    return sorted((r.heard, r.meant, r.n) for r in store.pairs().collect())


def test_words_that_ask_for_no_term_are_spread(spark):
    """Their key in the join of near terms is null: they were all rows of one task."""
    own = spark.newSession()
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "8")):
        own.conf.set(key, value)
    words = own.range(4000).select((F.col("id") % 50).alias("clip"), F.col("id").alias("index"), F.lit("nothing").alias("word"), F.lit(0.9).alias("confidence"))
    found = fuzzy.repair(words, own.createDataFrame([(0, "Kubernetes")], "line_no long, term string"), "clip")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1200


def test_the_third_sighting_promotes(spark, tmp_path):
    store = aliases.AliasStore(spark, str(tmp_path / "store"))
    assert seen(store) == [] and store.aliases().count() == 0
    store.absorb(sighting(spark, [("gti", "git"), ("Gti ", "git"), ("same", "same"), (None, "x"), ("", "x"), ("x", None)]), 0)
    assert seen(store) == [("gti", "git", 2)] and store.aliases().count() == 0 and store.candidates().count() == 1
    for _ in range(3):  # the same batch again and again
        store.absorb(sighting(spark, [("gti", "git"), ("gti", "GTI"), ("gti", "GTI"), ("gti", "GTI"), ("cd..", "cd ..")]), 1)
        assert seen(store) == [("cd..", "cd ..", 1), ("gti", "GTI", 3), ("gti", "git", 3)]
    assert [tuple(r) for r in store.aliases().collect()] == [("gti", "GTI", 3)]  # as often, but later
    store.absorb(sighting(spark, []), 2)
    assert seen(store) == [("cd..", "cd ..", 1), ("gti", "GTI", 3), ("gti", "git", 3)] and store.versions() == [1, 2]
    words = spark.createDataFrame([("GTI",), ("cd..",), (None,)], "word string")
    assert [r.word for r in aliases.apply(words, store.aliases()).collect()] == ["GTI", "cd..", None]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The query stops before it notes that its last batch is done, and so repeats it when it starts again."""
    folder, store = str(tmp_path / "in"), aliases.AliasStore(spark, str(tmp_path / "store"))
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice("xyz")) for _ in range(60)]
    for k in range(0, 60, 20):
        sighting(spark, rows[k : k + 20]).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema("heard string, meant string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    aliases.learn(stream(), store, str(tmp_path / "checkpoint"))
    want = sorted((h, m, rows.count((h, m))) for h, m in set(rows))
    assert seen(store) == want and store.versions() == [1, 2]
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    aliases.learn(stream(), store, str(tmp_path / "checkpoint"))
    assert seen(store) == want and store.versions() == [1, 2]
    sighting(spark, [("a", "x")]).coalesce(1).write.mode("append").parquet(folder)
    aliases.learn(stream(), store, str(tmp_path / "checkpoint"))
    assert store.pairs().agg(F.sum("n")).first()[0] == 61
