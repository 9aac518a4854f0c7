import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from voxgrain.llm.filter_audit import _Runs, audit, failures, op12_filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_fails(docs):
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(fails + "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)))
    return out


def brute(docs, labels):
    """Every order applied left to right, document by document."""
    fails = brute_fails(docs)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for (i, _, part), f in zip(docs, fails):
                row = rows.setdefault((part or "", order, step), Counter())
                gone, hit = any(x in f for x in order[: step - 1]), letter in f
                row["kept"] += not gone and not hit
                row["removed"] += hit and not gone
                row["redundant"] += hit and gone
                row["unique_fails"] += f == letter
                row["good_lost"] += hit and not gone and i in good
                row["toxic_lost"] += hit and not gone and i in toxic
                shapley[part or "", letter] += hit and not gone
    return sorted((*k, *(v[c] for c in COLUMNS[3:-1]), shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


def corpus():
    rnd = random.Random(4)
    texts = [None, "", " ", "A B C", "x # y", "w " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}" for i in range(49)), "é" * 300, "# " + "long " * 20_000, "a\tb\nc"]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice([None, "", "s1", "s2"])) for _ in range(150)]
    docs += [(100 + k // 2, "one large group of copies", "hot") for k in range(120)] + [(7, "again", "s1")] * 3 + [(-5, "again", "s2")]
    labels = [(i, rnd.choice([0, 1, None, 2]), rnd.choice([0, 1])) for i in range(0, 160, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, "m", 2) for d in docs], "doc_id long, text string, source string, mask int, part string, n int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_against_brute_force(spark):
    docs, labels = corpus()
    d, marks = frames(spark, docs, labels)
    found = [tuple(r[c] for c in COLUMNS) for r in audit(d.repartition(7), marks).collect()]
    assert sorted(found) == brute(docs, labels)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_copies_over_any_number_of_ranges(spark, ranges):
    docs, labels = corpus()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = Counter((r.doc_id, r.part, r.mask >> 4) for r in failures(frames(spark, docs, labels)[0]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == Counter((i, p or "", int("E" in f)) for (i, _, p), f in zip(docs, brute_fails(docs)))


def test_fingerprints_that_clash():
    """Sorted rows with few fingerprints, cut into ranges and batches anywhere: copies are those of whole texts."""
    rnd = random.Random(8)
    for _ in range(300):
        rows = [("abcd".index(t) % 2, t, rnd.randrange(12)) for t in rnd.choices("abcd", k=rnd.randrange(1, 40))]
        first = {t: min(i for _, u, i in rows if u == t) for _, t, _ in rows}
        # Ranges are of fingerprint and id; within one, rows lie by fingerprint, text and id.
        by_id = sorted((fp, i, t) for fp, t, i in rows)
        cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(3))
        got, edges, open_ = Counter(), {}, []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            part, runs = sorted((fp, t, i) for fp, i, t in by_id[a:b]), _Runs(16)
            size, out = rnd.choice([1, 2, 5, 100]), []
            for k in range(0, len(part), size):
                fps, texts, ids = zip(*part[k : k + size])
                out += runs.push(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts), pa.array([0] * len(ids), pa.int32()), pa.array(fps, pa.int64()), pa.array(texts)], ["doc_id", "part", "mask", "fp", "text"]))
            for r in (r for x in [*out, runs.finish()] for r in x.to_pylist()):
                if r["is_edge"]:
                    edges[r["text_key"]] = min(r["doc_id"], edges.get(r["text_key"], r["doc_id"]))
                elif r["text_key"]:
                    open_.append(r)
                else:
                    got[r["part"], r["doc_id"], r["mask"] > 0] += 1
        for r in open_:
            got[r["part"], r["doc_id"], r["doc_id"] > edges[r["text_key"]]] += 1
        assert got == Counter((t, i, i > first[t]) for _, t, i in rows)


def test_empty_tables(spark):
    docs, labels = corpus()
    d, marks = frames(spark, docs[:9], labels)
    assert audit(d.limit(0), marks).count() == 0
    assert sorted(tuple(r[c] for c in COLUMNS) for r in audit(d, marks.limit(0)).collect()) == brute(docs[:9], [])


def test_query(spark, tmp_path):
    docs, labels = corpus()
    for name, df in zip(("documents", "labels"), frames(spark, docs, labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in op12_filter_audit(spark, str(tmp_path)).collect()) == brute(docs, labels)
