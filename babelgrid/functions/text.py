"""String scalar functions (inventory C1-C11), all JVM-side expressions.

Python's ``str.strip`` / ``str.split`` treat a fixed set of code points as
white space; the same set is spelled out below so that Spark (Java regex) and
any SQL twin (RE2) agree character for character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Code points for which Python's str.isspace() is true (the white space that
# str.strip() removes and str.split() splits on), as a regex character class.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Most other characters, in three ranges.
LETTERS = r"[!-~\x{A1}-\x{167F}\x{3001}-\x{10FFFF}]"
# The articles removed by answer normalisation.
ARTICLES = ("a", "an", "the")
# ASCII punctuation removed by answer normalisation (Python string.punctuation).
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Prompt templates of the text-to-text tasks.
QA_PROMPT = ("question: ", "  context: ")
PAIR_PROMPT = ("xnli: premise: ", " hypothesis: ")
NER_PROMPT = "ner: "
NO_ENTITY_TARGET = "None"
# ---------------------------------------------------------------------------

# Most characters are none: a test of three ranges first, since the class costs some ten.
_WS_RUN = f"(?!{LETTERS}){WS_CLASS}++"
_EDGE_WS = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"
_PUNCT_CLASS = "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in ASCII_PUNCT) + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()`` (Unicode white space, not only spaces)."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def ws_tokens(c) -> Column:
    """Python ``str.split()``: split on white-space runs, no empty tokens."""
    return F.array_remove(F.split(_c(c), _WS_RUN), "")


def normalize_answer(c) -> Column:
    """Lower -> drop ASCII punctuation -> drop a/an/the -> collapse space."""
    s = F.lower(_c(c))
    s = F.regexp_replace(s, _PUNCT_CLASS, "")
    s = F.regexp_replace(s, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " ")
    return F.array_join(ws_tokens(s), " ")


def qa_prompt(question, context) -> Column:
    """``question: <q stripped>  context: <c>``."""
    return F.concat(F.lit(QA_PROMPT[0]), strip(question), F.lit(QA_PROMPT[1]), _c(context))


def pair_prompt(premise, hypothesis) -> Column:
    """``xnli: premise: <p> hypothesis: <h>``."""
    return F.concat(F.lit(PAIR_PROMPT[0]), _c(premise), F.lit(PAIR_PROMPT[1]), _c(hypothesis))


def ner_prompt(tokens) -> Column:
    """C4: ``ner: `` + tokens joined by one space."""
    return F.concat(F.lit(NER_PROMPT), F.array_join(_c(tokens), " "))


def first_answer(answers) -> Column:
    """First gold answer text, empty string when there is none."""
    return F.coalesce(F.get(_c(answers).getField("text"), 0), F.lit(""))


def tag_target(tag_names) -> Column:
    """Non-``O`` tags joined by a space, ``None`` when there are none."""
    kept = F.filter(_c(tag_names), lambda t: t != F.lit("O"))
    return F.when(F.size(kept) == 0, F.lit(NO_ENTITY_TARGET)).otherwise(F.array_join(kept, " "))


_NUMPY_ITEM = r"""'([^']*)'|"([^"]*)\""""


def parse_numpy_list(c) -> Column:
    """Parse a stringified numpy array such as ``['a' "b'c"]``.

    Each item is the single-quoted group if it matched, else the double-quoted
    group (an empty single-quoted item therefore falls back to the other group,
    which is empty too).
    """
    single = F.regexp_extract_all(_c(c), F.lit(_NUMPY_ITEM), 1)
    double = F.regexp_extract_all(_c(c), F.lit(_NUMPY_ITEM), 2)
    return F.zip_with(single, double, lambda a, b: F.when(a != F.lit(""), a).otherwise(b))


def char_slice(text, start, end) -> Column:
    """``text[start:end]`` on code points (0-based, end exclusive)."""
    return F.substring(_c(text), _c(start) + 1, _c(end) - _c(start))


def prefix_before(c, sep: str) -> Column:
    """C11: the part before the first ``sep`` (``s.split(sep, 1)[0]``)."""
    return F.substring_index(_c(c), sep, 1)


def language_filter(id_col, lang: str, mode: str = "equal") -> Column:
    """B1: rows of one language by the ``<lang>-...`` id.  ``equal`` compares
    the extracted prefix; ``prefix`` is the plain ``startswith`` test, under
    which ``en`` also matches ``english-...`` ids."""
    if mode == "prefix":
        return _c(id_col).startswith(lang)
    if mode == "equal":
        return prefix_before(id_col, "-") == F.lit(lang)
    raise ValueError(f"unknown language match mode {mode}")
