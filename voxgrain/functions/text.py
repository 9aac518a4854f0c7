"""Transcript repair as Column functions: every pass is a built-in expression, so a chain of them stays in the JVM.

All of them keep null as null. Word characters, boundaries and white space are Unicode unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases after which a speaker starts over. What stands before one on the first line goes with it. In this order.
CORRECTIONS = [
    r"no,?\s+wait,?",
    r"no,?\s+actually,?",
    r"no,?\s+sorry,?",
    r"actually,?\s+never\s*mind,?",
    r"never\s*mind,?",
    r"i\s+mean,?",
    r"what\s+i\s+meant\s+(was|is),?",
    r"scratch\s+that,?",
    r"delete\s+that,?",
    r"forget\s+that,?",
    r"ignore\s+that,?",
    r"or\s+rather,?",
    r"or\s+actually,?",
    r"or\s+better\s+yet,?",
    r"let\s+me\s+rephrase,?",
    r"let\s+me\s+start\s+over,?",
    r"wait,?\s+no,?",
    r"hold\s+on,?",
    r"not\s+\w+,?\s+but",
]
# Hesitations, then phrases that only fill. In this order.
HESITATIONS = ["uh", "um", "umm", "erm", "er", "hmm", "hm", "ahh?", "ehh?"]
FILLERS = ["you know", "kinda", "sort of", "kind of", "basically"]
# Spoken punctuation and what it stands for. In this order.
SPOKEN = [
    ("exclamation point", "!"),
    ("exclamation mark", "!"),
    ("question mark", "?"),
    ("open quote", '"'),
    ("close quote", '"'),
    ("open paren", "("),
    ("close paren", ")"),
    ("full stop", "."),
    ("new line", "\n"),
    ("new paragraph", "\n\n"),
    ("ellipsis", "..."),
    ("period", "."),
    ("comma", ","),
    ("colon", ":"),
    ("semicolon", ";"),
    ("hyphen", "-"),
    ("dash", " — "),
]
# Phrases and their contractions. In this order.
CONTRACTIONS = [
    ("can not", "can't"),
    ("cannot", "can't"),
    ("could not", "couldn't"),
    ("did not", "didn't"),
    ("does not", "doesn't"),
    ("do not", "don't"),
    ("had not", "hadn't"),
    ("has not", "hasn't"),
    ("have not", "haven't"),
    ("is not", "isn't"),
    ("are not", "aren't"),
    ("was not", "wasn't"),
    ("were not", "weren't"),
    ("will not", "won't"),
    ("would not", "wouldn't"),
    ("should not", "shouldn't"),
    ("I am", "I'm"),
    ("I will", "I'll"),
    ("I would", "I'd"),
    ("you are", "you're"),
    ("we are", "we're"),
    ("they are", "they're"),
    ("it is", "it's"),
    ("that is", "that's"),
    ("there is", "there's"),
]
# Marks of a diarised transcript that are not speech.
SPECIAL_TOKENS = ["<|text_chunk_end|>", "<|object_ref_start|>", "<|object_ref_end|>", "<|box_start|>"]

WORD_PIECE_MARK = "▁"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, text)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s{2,}", " ")


def course_correction(text: Column) -> Column:
    """Drops what a speaker takes back: all before a correction phrase on the first line; then ``X no sorry Y`` becomes Y."""
    steps = [(rf"(?iUd)\A.*\b{phrase}\s+", "") for phrase in CORRECTIONS]
    return strip(_each(text, [*steps, (r"(?iU)\b(\w+)\s+no\s+sorry\s+(\w+)\b", "$2")]))


def _settled(text: Column, pattern: str) -> Column:
    """``pattern`` replaced by its first group again and again until nothing changes.

    A pass that changes anything removes a word, so as many passes as there are words always do; once a pass
    changes nothing, the others cost no matching.
    """
    def step(state: Column, _: Column) -> Column:
        again = bound(F.regexp_replace(state["t"], pattern, "$1"), lambda n: F.struct(n.alias("t"), (n == state["t"]).alias("done")))
        return F.when(state["done"], state).otherwise(again)

    def settle(t: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(F.split(t, r"(?U)\s+"))), F.struct(t.alias("t"), F.lit(False).alias("done")), step)["t"]

    return bound(text, settle)


def clean_repetitions(text: Column) -> Column:
    """Stutters: repeated runs of three words, of two, words said three times or more, words said twice; each until none is left."""
    for pattern in (r"(?iU)\b(\w+\s+\w+\s+\w+)(\s+\1)+\b", r"(?iU)\b(\w+\s+\w+)(\s+\1)+\b", r"(?iU)\b(\w+)(\s+\1){2,}\b", r"(?iU)\b(\w+)\s+\1\b"):
        text = _settled(text, pattern)
    return strip(one_space(text))


def remove_fillers(text: Column) -> Column:
    """Hesitations and filling phrases with a comma after them, and ``like`` where it only fills."""
    steps = [(rf"(?iU)\b{word}\b\s*,?\s*", " ") for word in HESITATIONS + FILLERS]
    steps += [(r"(?iU),\s*like\s*,", ","), (r"(?iU)\blike\s*,\s*(uh|um|so|you know)", ""), (r"(?iU)\Alike\s+", "")]
    return strip(one_space(_each(text, steps)))


def spoken_punctuation(text: Column) -> Column:
    """Spoken punctuation between ASCII white space or ends becomes its symbol, which attaches to the word before it."""
    steps = []
    for phrase, symbol in SPOKEN:
        alone = rf"(?i) ?(?<![^ \t\n\f\r]){phrase}(?![^ \t\n\f\r])"
        plain = symbol.strip(" ")
        if symbol.endswith("\n"):
            steps.append((rf"{alone} ?", symbol))
        elif symbol != plain:
            steps += [(rf"{alone}(?= )", f" {plain}"), (alone, symbol)]
        else:
            steps += [(rf"{alone}(?: ?\z|(?= ))", symbol), (alone, f"{symbol} ")]
    return _each(text, steps)


def capitalize(text: Column) -> Column:
    """First letters of the text, of sentences and of lines in upper case, and the lone i; nothing is put in lower case."""
    gap = r"[\s\"'(\[{“‘]{0,64}"
    # Most places are inside a word or before a blank: they fail at once, before anything looks back over a gap.
    begins = rf"(?U)(?<![\p{{IsAlphabetic}}\p{{N}}])(?=\p{{IsAlphabetic}})(?:(?<=[?!\n]{gap})|(?<=\.\s{gap})|(?<=\A{gap}))"
    parts = F.transform(F.split(text, begins, -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.regexp_replace(F.array_join(parts, ""), r"(?U)\bi\b", "I")


def restore_contractions(text: Column) -> Column:
    """Expanded phrases as contractions; the case of the first letter stays."""
    steps = []
    for phrase, short in CONTRACTIONS:
        first, rest = phrase[0], phrase[1:]
        for lead, out in ((first.upper(), short[0].upper() + short[1:]), (first.lower(), short)):
            steps.append((rf"(?<![\p{{IsAlphabetic}}\p{{N}}']){lead}(?i){rest}(?![\p{{IsAlphabetic}}\p{{N}}'])", out))
    return _each(text, steps)


def apply_profile(text: Column, profile: Column) -> Column:
    """The ``Long`` profile restores contractions; any other leaves the text alone."""
    return F.when(profile == "Long", restore_contractions(text)).otherwise(text)


def before_terms(text: Column) -> Column:
    """The passes that come before vocabulary terms are corrected."""
    return spoken_punctuation(remove_fillers(clean_repetitions(course_correction(text))))


def fix_transcription(text: Column) -> Column:
    """The whole chain, for an empty vocabulary."""
    return capitalize(before_terms(text))


def eval_tokens(text: Column) -> Column:
    """Words for evaluation: lower case, straight apostrophes, only a-z, 0-9 and ' left. ASCII by design."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[’']", "'"), "[^a-z0-9' ]+", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def detokenise(pieces: Column) -> Column:
    """Text of an array of word pieces: ``▁`` is a space, missing pieces are empty."""
    return strip(F.replace(F.array_join(pieces, "", ""), F.lit(WORD_PIECE_MARK), F.lit(" ")))


def is_punctuation_piece(piece: Column) -> Column:
    return (piece != "") & ~piece.rlike(r"[\p{IsAlphabetic}\p{N}]")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def assemble(texts: Column, separator: str = "\n\n") -> Column:
    """A transcript of an array of texts in order; blank ones are left out. Paragraphs by default, ``' '`` for live windows."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), separator)


def flatten_diarised(text: Column) -> Column:
    """Speech of a diarised answer, without speaker labels and special tokens."""
    text = F.regexp_replace(text, r"(?U)(?:^|(?<=[\s.,!?]))[Ss]peaker\s*\d+\s*:\s*", "")
    for token in SPECIAL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` characters, with three dots where any are missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def unwrap_prompt(raw: Column) -> Column:
    """The ``prompt`` of a JSON object if it is a string, else the text itself; both without white space at the ends."""
    text = strip(raw)
    prompt = F.try_variant_get(F.try_parse_json(text), "$.prompt", "variant")
    is_string = text.startswith("{") & F.coalesce(F.schema_of_variant(prompt) == "STRING", F.lit(False))
    return F.when(is_string, strip(F.try_variant_get(prompt, "$", "string"))).otherwise(text)


def normaliser_prompt(transcript: Column, instruction: str, styling: Column, structure: Column, context: Column) -> Column:
    """A chat prompt with a control line, for a text normaliser."""
    turn = F.lit("<|im_end|>\n<|im_start|>")
    return F.concat(
        F.lit(f"<|im_start|>system\n{instruction}"), turn, F.lit("user\n[Styling: "), styling, F.lit("] [Structure: "), structure, F.lit("] [Context: "), context,
        F.lit("]\n"), transcript, turn, F.lit("assistant\n<think>\n\n</think>\n\n"),
    )


def or_input(normalised: Column, text: Column) -> Column:
    """What a normaliser returned, or its input where that is missing or blank: it never loses a text."""
    return F.when(normalised.isNull() | is_blank(normalised), text).otherwise(normalised)
