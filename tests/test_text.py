import random
import re

import pytest
from pyspark.sql import functions as F

from tests import models
from tests.goldens import PASSES, TERMS, WITH_TERMS
from voxgrain.functions import text as T
from voxgrain.operators import vocabulary as V


def apply(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r[1] for r in sorted(df.select("i", function(F.col("t"))).collect())]


@pytest.mark.parametrize("name", sorted({n for n, *_ in PASSES}))
def test_goldens(spark, name):
    cases = [(a, b) for n, a, b in PASSES if n == name]
    assert apply(spark, getattr(T, name), [a for a, _ in cases]) == [b for _, b in cases]
    assert apply(spark, getattr(T, name), [None]) == [None]


def test_repetitions_against_model(spark):
    rnd, words = random.Random(6), ["a", "A", "b", "é", "a,", "bb", "c\n", "a"]
    texts = [rnd.choice(["", " ", "\n"]) + "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    assert [(t, g, m) for t, g in zip(texts, apply(spark, T.clean_repetitions, texts)) if g != (m := models.repetitions(t))] == []


def cased(rnd, text):
    return rnd.choice([text, text.capitalize()])


def test_spoken_punctuation_of_items(spark):
    """Phrases among words become symbols; words that only contain a phrase, or hold it behind other white space, stay."""
    rnd, words = random.Random(6), ["a", "é", "period.", "newline", "commas", "x", "?", "dot"]
    cases = []
    for _ in range(2000):  # a symbol beside a phrase would hide it from a later pass, so words stand between phrases
        items = [x for _ in range(rnd.randrange(6)) for x in [cased(rnd, rnd.choice(T.SPOKEN)[0])] * (rnd.random() < 0.6) + [rnd.choice(words)] * rnd.randint(1, 2)]
        cases.append(models.spoken_items(items[rnd.randrange(2) :] + [cased(rnd, rnd.choice(T.SPOKEN)[0])] * (rnd.random() < 0.3)))
    assert [(t, g, w) for (t, w), g in zip(cases, apply(spark, T.spoken_punctuation, [t for t, _ in cases])) if g != w] == []


def test_contractions_of_items(spark):
    rnd, words = random.Random(6), ["a", "é", "bit", "isn't", "x'", "cannots", "knot", ";"]
    cases = []
    for _ in range(2000):
        items = []
        for _ in range(rnd.randrange(8)):
            items += [cased(rnd, rnd.choice(T.CONTRACTIONS)[0])] * (rnd.random() < 0.5) + [rnd.choice(words)]
        cases.append(models.contracted_items(items))
    assert [(t, g, w) for (t, w), g in zip(cases, apply(spark, T.restore_contractions, [t for t, _ in cases])) if g != w] == []


def test_capitals_are_the_first_letters(spark):
    """Only case changes, and only of letters that begin something and of the lone i; the result stays as it is."""
    rnd, words = random.Random(6), ["a", "é.", "i", "?", '"b', "1.2", ".", "-", "“c", "I'm", "i'd", "…", "\n", "Ab", "ix"]
    texts = [rnd.choice(["", " ", "\n"]) + "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    got = apply(spark, T.capitalize, texts)
    lone = re.compile(r"\bi\b")
    for text, out in zip(texts, got):
        alone = {m.start() for m in lone.finditer(text)}
        assert out == "".join(c.upper() if k in alone or c.isalpha() and models.is_first(text, k) else c for k, c in enumerate(text)), text
    assert apply(spark, T.capitalize, got) == got


def test_evaluation_words(spark):
    assert apply(spark, T.eval_tokens, ["It’s über-fine, 3x!", "", None]) == [["it's", "ber", "fine", "3x"], [], None]


def test_small_functions(spark):
    df = spark.createDataFrame([("Speaker 0: hi<|box_start|> there. speaker 1:ok", ["▁go", "od", None, "▁day"], "long text")], "d string, p array<string>, t string")
    r = df.select(
        T.flatten_diarised(F.col("d")).alias("d"), T.detokenise(F.col("p")).alias("p"), T.truncate(F.col("t"), 4).alias("t"), T.or_input(F.lit(" "), F.col("t")).alias("o"),
        T.apply_profile(F.lit("it is"), F.lit("Raw")).alias("raw"), T.assemble(F.array(F.lit(" a "), F.lit(""), F.lit("b"))).alias("a"), T.is_punctuation_piece(F.lit(",")).alias("c"),
        T.normaliser_prompt(F.col("t"), "Do.", F.lit("a"), F.lit("b"), F.lit("c")).alias("prompt"),
    ).first()
    assert (r.d, r.p, r.t, r.o, r.raw, r.a, r.c) == ("hi there. ok", "good day", "long...", "long text", "it is", "a\n\nb", True)
    assert r.prompt == "<|im_start|>system\nDo.<|im_end|>\n<|im_start|>user\n[Styling: a] [Structure: b] [Context: c]\nlong text<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def terms(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "line_no long, term string")


@pytest.mark.parametrize("limit", [V.MAP_LIMIT, 0])
def test_terms(spark, limit):
    cases = [
        (["Wayland"], "wayland WAYLAND, Wayland!", "Wayland Wayland, Wayland!"),
        (["Tauri"], "they're There their were where", "they're There their were where"),
        (["Tauri", "Torrey"], "Torrey", "Torrey"),
        (["Kubernetes"], "deploy to kubernetis, please.", "deploy to Kubernetes, please."),
        (["Kubernetes"], "line one\n\nline two — done.", "line one\n\nline two — done."),
        ([], "deploy to kubernetes, please.", "deploy to kubernetes, please."),
    ]
    for words, text, want in cases:
        df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, text string")
        got = {r.i: r.text for r in V.correct_terms(df, terms(spark, *words), map_limit=limit).collect()}
        assert got == {1: want, 2: None, 3: ""}
    df = spark.createDataFrame([(a,) for a, _ in WITH_TERMS], "text string")
    assert [r.text for r in V.fix_with_terms(df, terms(spark, *TERMS)).collect()] == [b for _, b in WITH_TERMS]


def test_term_file(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# names\nKubernetes\n\n  Svelte  \n# trailing\n")
    assert [r.term for r in V.read_terms(spark, str(tmp_path / "terms.txt")).orderBy("line_no").collect()] == ["Kubernetes", "Svelte"]
    assert V.read_terms(spark, str(tmp_path / "none.txt")).collect() == []
