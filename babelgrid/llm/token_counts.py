"""Edit-aware token counts.

A text is cut by the tokenizer's pre-token pattern, and tokens never cross
pre-tokens, so counts add up.  Each document keeps a segment tree whose leaves
are runs of up to ``LEAF`` pre-tokens: sums of characters (to find a place)
and of tokens (to count).  An edit re-encodes the text from the start of the
leaf before it, as the pattern may look two characters ahead, to the first
leaf end behind it where old and new pre-tokens meet again; only the changed
leaves and the sums above them are updated.

State is columns (``chars``, ``tokens``: the trees), so a later batch of edits
joins to it by key.  Texts leave an Arrow batch ``PIECE`` at a time.  The
vocabulary file (``path``) must be readable under that name on every executor.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, tmp

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: Characters that the pattern may look at beyond a pre-token's end.
LOOK = 2
_CACHE = 200_000
_LONG = 1 << 20
#: Texts of an Arrow batch that are Python objects at a time, with their trees.
PIECE = 64
EDITS = "array<struct<start:int,stop:int,text:string>>"


class _Counts(dict):
    """Tokens of a pre-token, remembered for the most recent ones."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        n = self[piece] = len(self.encoding._encode_single_piece(piece))
        return n


@functools.lru_cache(2)
def counter(path: str = RANKS) -> _Counts:
    return _Counts(path)


_PRE = regex.compile(PATTERN)


def _leaves(text: str, of: _Counts) -> Iterator[tuple[int, int]]:
    """(characters, tokens) of each run of LEAF pre-tokens."""
    if len(text) > _LONG:
        run: list[str] = []
        for m in _PRE.finditer(text):
            run.append(m.group())
            if len(run) == LEAF:
                yield sum(map(len, run)), sum(map(of.__getitem__, run))
                run = []
        if run:
            yield sum(map(len, run)), sum(map(of.__getitem__, run))
        return
    pieces = _PRE.findall(text)
    for k in range(0, len(pieces), LEAF):
        run = pieces[k:k + LEAF]
        yield sum(map(len, run)), sum(map(of.__getitem__, run))


class Tree:
    """Sums of characters and tokens over leaves; node i has the children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, leaves: list[tuple[int, int]]) -> Tree:
        size = 1 << max(0, len(leaves) - 1).bit_length()
        both = []
        for side in (0, 1):
            t = [0] * size + [x[side] for x in leaves] + [0] * (size - len(leaves))
            for i in range(size - 1, 0, -1):
                t[i] = t[2 * i] + t[2 * i + 1]
            both.append(t)
        return cls(*both)

    @classmethod
    def of_text(cls, text: str, of: _Counts) -> Tree:
        return cls.of_leaves(list(_leaves(text, of)))

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in zip(self.chars[self.size:], self.tokens[self.size:], strict=True) if x[0]]


def edit(text: str, tree: Tree, start: int, stop: int, new: str, of: _Counts) -> tuple[str, Tree, int]:
    """Replace ``text[start:stop]``; the new text, its tree and how many pre-tokens were encoded."""
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    shift = len(new) - (stop - start)
    first, begin = tree.leaf_at(max(0, start - LOOK))
    if begin > max(0, start - LOOK):
        first, begin = 0, 0
    changed = text[:start] + new + text[stop:]
    leaf, end = first, begin + tree.chars[tree.size + first]  # the old leaf whose end may meet a new one
    runs, n = [[0, 0]], 0
    done = False
    for m in _PRE.finditer(changed, begin):
        piece = m.group()
        n += 1
        if n % LEAF == 1 and n > 1:
            runs.append([0, 0])
        runs[-1][0] += len(piece)
        runs[-1][1] += of[piece]
        at = m.end()
        while (end < stop or end + shift < at) and leaf + 1 < tree.size:
            leaf += 1
            end += tree.chars[tree.size + leaf]
        if end >= stop and end + shift == at:
            done = True
            break
    if not done:  # to the end of the text
        leaf = tree.size - 1
    if len(runs) <= leaf - first + 1:
        for k in range(first, leaf + 1):
            tree.put(k, *(runs[k - first] if k - first < len(runs) else (0, 0)))
    elif sum(r[0] for r in runs) and len(runs) <= 2 * (leaf - first + 1):
        # few more runs than leaves: the last leaf takes the rest
        room = leaf - first + 1
        rest = [sum(r[i] for r in runs[room - 1:]) for i in (0, 1)]
        for k, r in enumerate([*runs[:room - 1], rest]):
            tree.put(first + k, *r)
    else:  # a long insertion: new leaves, old sums
        old = list(zip(tree.chars[tree.size:], tree.tokens[tree.size:], strict=True))
        tree = Tree.of_leaves([x for x in [*old[:first], *map(tuple, runs), *old[leaf + 1:]] if x[0]])
    return changed, tree, n


_TREE = "chars: array<int>, tokens: array<int>, n_tokens: long"


def _arrays(trees: list[Tree]) -> list[pa.Array]:
    ints = pa.list_(pa.int32())
    return [pa.array([t.chars for t in trees], ints), pa.array([t.tokens for t in trees], ints),
            pa.array([t.tokens[1] for t in trees], pa.int64())]


def build(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``chars`` and ``tokens``, the trees
    of the whole text (null: as empty), and ``n_tokens``.  Input columns of
    these names are replaced."""
    @F.arrow_udf(f"struct<{_TREE}>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path)
        for a in texts:
            for k in range(0, len(a), PIECE):
                trees = [Tree.of_text(t.as_py() or "", count) for t in a.slice(k, PIECE)]
                yield pa.StructArray.from_arrays(_arrays(trees), names=["chars", "tokens", "n_tokens"])

    t = tmp("tree")
    new = ("chars", "tokens", "n_tokens")
    d = docs.select(*[column(docs, c) for c in docs.columns if c not in new], of(column(docs, text)).alias(t))
    return d.select(*[column(d, c) for c in d.columns if c != t], *[F.col(f"{t}.{c}").alias(c) for c in new])


def apply_edits(state: DataFrame, edits: str = "edits", text: str = "text", path: str = RANKS) -> DataFrame:
    """Rows of ``build`` with a column of edits to rows with the edited text and trees.

    ``edits`` has (start, stop, text): characters of the old text to replace.
    Edits of a text don't overlap and are applied from the last to the first;
    places beyond the text mean its end, null replacements nothing, null or
    empty lists no edit.  Adds ``n_encoded``, the pre-tokens that were encoded.
    """
    @F.arrow_udf(f"struct<text: string, {_TREE}, n_encoded: long>")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        count = counter(path)
        for columns in batches:
            for at in range(0, len(columns[0]), PIECE):
                changed, trees, encoded = [], [], []
                for row in zip(*[c.slice(at, PIECE) for c in columns], strict=True):
                    t, chars, tokens, es = (v.as_py() for v in row)
                    t, tree, n = t or "", Tree(chars, tokens), 0
                    es = [(e["start"], e["stop"], e["text"] or "") for e in es or []]
                    for a, b, new in sorted(es, key=lambda e: (e[0], e[1]), reverse=True):
                        t, tree, k = edit(t, tree, a, b, new, count)
                        n += k
                    changed.append(t)
                    trees.append(tree)
                    encoded.append(n)
                yield pa.StructArray.from_arrays(
                    [pa.array(changed, pa.string()), *_arrays(trees), pa.array(encoded, pa.int64())],
                    names=["text", "chars", "tokens", "n_tokens", "n_encoded"])

    r = tmp("edited")
    new = ("chars", "tokens", "n_tokens", "n_encoded")
    d = state.select(*[column(state, c) for c in state.columns if c not in new], of(
        column(state, text), F.col("chars"), F.col("tokens"),
        column(state, edits).cast(EDITS)).alias(r))
    keep = [F.col(f"{r}.text").alias(text) if c == text else column(d, c) for c in d.columns if c != r]
    return d.select(*keep, *[F.col(f"{r}.{c}").alias(c) for c in new])
