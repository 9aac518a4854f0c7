import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voxgrain.llm import lexical
from voxgrain.llm.lexical import TERM, Queries, _block, _search, build_index, op11_lexical_search, search, terms_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Every document scored for every item, by the contract's formulas."""
    lists = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    df = Counter(t for _, x in lists for t in set(x))
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        found = []
        for i, terms in lists:
            tf, score = Counter(terms), 0
            for t in split(text):
                if tf[t]:
                    m = 100 - 75 + 75 * len(terms) * n_docs // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(6)
    words = ["The", "the", "é", "Éa", "K", "straße", "x1", "1", *(f"w{k}" for k in range(60))]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "\n", ", ", "\x00", "-", "_", "  "]) for _ in range(n))
    docs = [(i, text(rnd.choice([1, 5, 30, 200]))) for i in range(150)] + [(900, None), (901, ""), (902, " ,. "), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (903, "w4 " * 30_000 + text(50))]
    docs += [(1000 + i, "same words w5 w6 here") for i in range(60)]
    items = [(k, text(12)) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w1 W1 w1 w2"), (0, "w5 w6"), (24, "same"), (24, "same"), (None, "here w6")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = corpus()
    return spark.createDataFrame([(*d, "s", 1, 2) for d in docs], "doc_id long, text string, block string, rank int, item_id int"), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block_docs", "head", "query_chars"), [(4, 2, 10**6), (128, 1, 10**6), (1, 3, 200), (7, 1, 60)])
def test_ranks_against_brute_force(spark, frames, block_docs, head, query_chars):
    docs, items = corpus()
    index = build_index(frames[0].repartition(5), block_docs=block_docs)
    assert found(search(index, frames[1], head=head, query_chars=query_chars)) == brute(docs, items)


def test_other_tops_and_empty_tables(spark, frames):
    docs, items = corpus()
    index = build_index(frames[0], block_docs=16)
    assert found(search(index, frames[1], top=1)) == brute(docs, items, 1)
    assert found(search(index, frames[1], top=500)) == brute(docs, items, 500)
    assert found(search(index, frames[1].limit(0))) == []
    assert found(search(build_index(frames[0].limit(0)), frames[1])) == []
    assert found(search(build_index(frames[0].filter("doc_id in (900, 901, 902)")), frames[1])) == []


def test_query(spark, frames, tmp_path):
    for name, df in zip(("documents", "benchmark"), frames):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert found(op11_lexical_search(spark, str(tmp_path))) == brute(*corpus())


def test_terms():
    texts = ["A b-C", None, "", "é_É K 9", "\x00\x7f", "x" * 1000]
    hashes, of = terms_of(texts)
    assert Counter(of.tolist()) == Counter({k: n for k, t in enumerate(texts) if (n := len(split(t)))})
    by_term = defaultdict(set)
    for h, t in zip(hashes.tolist(), (t for x in texts for t in split(x))):
        by_term[t].add(h)
    assert all(len(x) == 1 for x in by_term.values()) and len({*by_term}) == len({h for x in by_term.values() for h in x})


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(2000)]
    passage = " ".join(rnd.choices(words, k=30))
    text = lambda n: " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(2000)], k=n))
    docs = [(i, f"{text(25)} {passage} {text(25)}" if i % 300 == 7 else text(80)) for i in range(4000)]
    blocks = [_block(*map(list, zip(*docs[i : i + 20]))) for i in range(0, 4000, 20)]
    asked = [passage, "w1700 w1800 w2"]
    queries = Queries(asked)
    df = Counter(t for _, x in docs for t in set(split(x)))
    hashes = {t: h for t in df for h in terms_of([t])[0].tolist()}
    queries.weigh(4000, 320_000, {k: df[t] for t, h in hashes.items() for k in np.flatnonzero(queries.terms == h).tolist()})
    scored, laid = [], lexical._Scores.of
    monkeypatch.setattr(lexical._Scores, "of", lambda self, q: scored.append(q) or laid(self, q))
    batch = pa.RecordBatch.from_pylist(blocks)
    least = SimpleNamespace(value=np.zeros(2, np.int64))
    out = [r for b in _search(SimpleNamespace(value=queries), least, 10)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["item"], r["doc_id"], r["score"]) for r in out) == sorted((i, d, s) for i, _, d, s in brute(docs, list(enumerate(asked))))
    assert all(scored.count(q) < 60 for q in range(2)), [scored.count(q) for q in range(2)]


def test_tasks_hold_few_blocks_at_once(spark, frames, monkeypatch):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000))) for i in range(120)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lexical, "ROW_GROUP", 1 << 18)
    index = build_index(docs, block_docs=1)
    groups = [f.row_group(g).total_byte_size for f in (pq.ParquetFile(p.removeprefix("file://")).metadata for p in index.inputFiles()) for g in range(f.num_row_groups)]
    assert len(groups) > 5 and max(groups) < 1 << 20
    usual, counted = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), lexical._frequencies

    def frequencies(sent, most=lexical.SENT):
        def count(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= most
                    yield batch

            return counted(sent)(few())

        return count

    monkeypatch.setattr(lexical, "_frequencies", frequencies)
    assert search(index, frames[1]).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual
