"""What the passes must give, said of texts as a whole: for texts made of known items, and for each letter by what stands before it."""

import re

from voxgrain.functions.text import CONTRACTIONS, SPOKEN

GAP = re.compile(r"""[\s"'(\[{“‘]*\Z""")


def spoken_items(items):
    """The text of ``items`` joined by blanks, and what it becomes: a symbol follows its word, and a blank follows a symbol but not a line break."""
    symbols, out = dict(SPOKEN), ""
    for item in items:
        symbol = symbols.get(item.lower())
        if symbol is None:
            out += (" " if out and not out.endswith("\n") else "") + item
        else:
            out += symbol.rstrip(" ")
    if items and symbols.get(items[-1].lower(), "").endswith(" "):
        out += " "  # a dash at the end keeps its blank
    return " ".join(items), out


def contracted_items(items):
    """The text of ``items`` joined by blanks, and what it becomes: phrases contract with their first letter's case, other items stay."""
    short = {phrase.lower(): out for phrase, out in CONTRACTIONS}

    def one(item):
        out = short.get(item.lower())
        return item if out is None else (out[0].upper() if item[0].isupper() else out[0].lower()) + out[1:]

    return " ".join(items), " ".join(map(one, items))


def is_first(text, k):
    """Whether the letter at ``k`` begins the text, a sentence or a line, with blanks, quotes and brackets at most in between."""
    gap = GAP.search(text[:k])
    before = text[: gap.start()]
    return not before or "\n" in gap.group() or before[-1] in "?!" or before[-1] == "." and gap.group()[:1].isspace()


def _again(words, gaps, n):
    """The first place where ``n`` words stand twice in a row, in any case, with the same white space inside and any between; or None."""
    for i in range(len(words) - 2 * n + 1):
        inside = gaps[i + 1 : i + n], gaps[i + n + 1 : i + 2 * n]
        one, two = ([w.lower() for w in words[k : k + n]] for k in (i, i + n))
        if one == two and inside[0] == inside[1] and all(g.isspace() for g in (*inside[0], gaps[i + n])):
            return i
    return None


def repetitions(text):
    """A text is words, with a gap before each and one at the end. No three, two or single words may stand twice in a row: the second of them goes, with the gap before it."""
    pieces = re.split(r"(\w+)", text)
    words, gaps = pieces[1::2], pieces[::2]
    for n in (3, 2, 1):
        while (i := _again(words, gaps, n)) is not None:
            del words[i + n : i + 2 * n], gaps[i + n : i + 2 * n]
    joined = gaps[0] + "".join(w + g for w, g in zip(words, gaps[1:]))
    return "".join(" " if len(part) > 1 and part.isspace() else part for part in re.split(r"(\s+)", joined)).strip()
