import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_line_dedup, test_set_join
from tests.llm.test_mixing import targets
from voxgrain.llm.set_join import link_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, item = line(7), line(30)
    rows = []
    for i in range(60):
        text = "\n".join([common] * (i % 3 == 0) + [line(12) for _ in range(rnd.randint(2, 5))])
        if i % 10 == 1:
            text += "\n" + " ".join(item.split()[15:]) + "\n" + " ".join(item.split()[:15])
        rows.append((i, text, rnd.choice(["en", "de", None]), f"s{i % 4}", len(text)))
    for i, (of, change) in enumerate([(2, ""), (2, " more"), (5, ""), (11, " x")]):
        rows.append((100 + i, rows[of][1] + change, "en", "s0", len(rows[of][1])))
    rows += [(200, None, None, None, None), (201, "123 !", "en", "s1", 5), (202, "", "en", "s1", 0), (203, common, "en", "s2", len(common))]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    want = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "line_dedup":
            left = test_line_dedup.brute(list(want.items()))
            want = {i: new for (i, old), new in zip(want.items(), left) if new == old or new.split()}
        elif name == "near_duplicates":
            named = dict(tuple(eval(x)[::2]) for x in test_set_join.brute(list(want.items())))
            want = {i: t for i, t in want.items() if named[i] == i}
        elif name == "decontamination":
            words = set(item.split())
            want = {i: t for i, t in want.items() if len(words & set(t.split())) < 15}
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert {r.doc_id: r.text for r in docs.collect()} == want, name
    found = out.collect()
    sizes = {}
    for i, t in want.items():
        sizes[f"s{i % 4}" if i < 100 else dict((r[0], r[3]) for r in rows)[i]] = 0
    for r in found:
        sizes[r.source] += r["size"]
        assert r["size"] == len(want[r.doc_id].split())
    goal = targets(sizes, {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))})
    assert {r.source: round(r.target, 6) for r in found} == {s: round(v, 6) for s, v in goal.items()}
    assert sorted(r.doc_id for r in found) == sorted(want)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_components_of_stage_input(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in link_components(df.withColumn("x", F.lit(1))).collect()} == {1}


CLASHING = ["language_", "leak_", "row_", "of_", "id_", "node", "label", "fp", "a b", "text_", "key", "component", "h", "word", "bit", "size", "taken"]


def odd_documents(spark, n=30):
    """Null and empty texts, ids, sources and languages, repeated rows, equal ids, a very long text twice, and columns of the operators' own names."""
    rnd = random.Random(3)
    text = lambda k: " ".join(rnd.choice(["the", "of", "and", "house", "garden", "letters", "running", "under"]) + str(rnd.randrange(90)) for _ in range(k))
    long = text(60_000)
    rows = [(i, text(40), "en", f"s{i % 3}", 1) for i in range(n)] + [(1, long, "en", "s0", 1), (901, long, None, None, 1), (None, None, None, None, None), (902, "", "en", "s1", 0), (None, text(30), "en", "s1", 1), (2, "12 .", "en", "s1", 1)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    return docs


def test_stages_on_odd_tables(spark, tmp_path):
    """All stages behind each other, written between and not: the same rows, and all further columns."""
    spark.createDataFrame([(1, "an item of the benchmark that no document holds"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    chained, written = docs, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        chained = stage(spark, chained, str(tmp_path))
        stage(spark, written, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        written = spark.read.parquet(str(tmp_path / f"{k}"))
        assert written.columns == docs.columns and all(r[c] == c for r in written.select(*[f"`{c}`" for c in CLASHING]).distinct().collect() for c in CLASHING)
    key = lambda r: (str(r.doc_id), r.text, str(r.source))
    kept = sorted(map(key, written.select("doc_id", "text", "source").collect()))
    assert sorted(map(key, chained.select("doc_id", "text", "source").collect())) == kept
    assert len(kept) == 32 and sum(len(t) > 100_000 for _, t, _ in kept) == 1
    mixed = corpus_pipeline.STAGES[4][1](spark, written, str(tmp_path)).collect()
    assert len(mixed) == 32 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
