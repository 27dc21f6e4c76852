"""Token ids of whole texts, with a bounded memory of units that a tokenizer encodes alike wherever they stand."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken

#: Texts encoded together.
TOGETHER = 500
#: Units remembered in each of two generations, and the longest that is remembered (bytes).
GENERATION, LONGEST = 400_000, 64


class Units:
    """Units to their ids, as little-endian unsigned 32-bit integers. encode: the ids of many strings.

    Many lists of units are looked up at once, so that new units are learnt together. Two generations bound the
    memory: what was used since the last turn of generations stays. Units over LONGEST are not kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], lead: str = "", generation: int = GENERATION) -> None:
        self.encode, self.lead, self.generation = encode, lead, generation
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def each(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit."""
        long = self.learn(set(units))
        out = list(map(self.known.__getitem__, units))
        self.forget(long)
        return out

    def joined(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of units."""
        long = self.learn(set().union(*lists))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, units)) for units in lists]
        self.forget(long)
        return out

    def forget(self, long: list[bytes]) -> None:
        for u in long:
            del self.known[u]
        if len(self.known) > self.generation:
            self.known, self.before = {}, self.known

    def learn(self, units: set[bytes]) -> list[bytes]:
        """Make all units known; returns those to forget after use."""
        known, before = self.known, self.before
        new = units.difference(known)
        again = new & before.keys()
        known.update(zip(again, map(before.__getitem__, again)))
        new -= again
        want, ends, long = [], [], []
        for u in new:
            s = u.decode()
            if len(u) > LONGEST:
                long.append(u)
                want.append((u, s))
            elif s[-1:] in (",", ".") and s[-2:-1].lower().isalnum():  # a word and the mark after it are always two pieces
                ends.append((u, u[:-1], s[-1]))
            else:
                want.append((u, s))
        fresh = {u for u, _ in want}
        lone = [k for k in dict.fromkeys(k for _, k, _ in ends) if k not in known and k not in fresh]
        marks = sorted({m for _, _, m in ends})
        found = self.encode([self.lead + s for _, s in want] + [self.lead + k.decode() for k in lone] + marks)
        known.update(zip((u for u, _ in want), found))
        known.update(zip(lone, found[len(want) :]))
        mark = dict(zip(marks, found[len(found) - len(marks) :]))
        known.update([(u, known[k] + mark[m]) for u, k, m in ends])
        return long


def library(name: str) -> Callable[[list[str]], list[bytes]]:
    """encode of a tokenizers file: each string's ids as bytes, without special tokens added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(place(name))
    return lambda strings: [array("I", e.ids).tobytes() for e in t.encode_batch_fast(strings, add_special_tokens=False)]


def place(name: str) -> str:
    """A tokenizer's file: a path, or a name among the public ones."""
    return name if "/" in name else public_tokenizers.path(name)


#: Strings of Latin letters, digits and common marks: for these Python's classes and cases are the libraries'.
LATIN = re.compile(r"[\x00\x20-\x7e\xa1-\xac\xae-\u024f\u2013-\u201f\u2026\n\t]*")
END = "\0"


SPACE, LETTER, NUMBER, MARK, STOP = range(5)


def classes() -> np.ndarray:
    """The class of each character of two bytes, as patterns of words see it."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]
    out = np.array([{"L": LETTER, "N": NUMBER}.get(k, MARK) for k in kinds], np.uint8)
    out[[ord(c) for c in " \t\n"]], out[ord(END)] = SPACE, STOP
    return out


def ended(text: str, of: np.ndarray) -> str:
    """A Latin text in lower case without white space, END after each word: letters, one digit, other marks, or a contraction such as 's."""
    raw = np.frombuffer(text.lower().encode("utf-16-le"), "<u2")
    kind = of[raw]
    ends = np.append(kind[1:] != kind[:-1], True) | (kind == NUMBER)
    kept = kind != SPACE
    ends &= kept & (kind != STOP)
    at = np.nonzero(raw == ord("'"))[0]
    at = at[np.append(True, kind[:-1] != MARK)[at]] if len(at) else at
    if len(at):
        one, two = (np.append(raw, [0, 0])[at + k] for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        ends[at[short | long]] = False
        ends[at[short] + 1] = True
        ends[at[long] + 2] = True
    size = kept.astype(np.uint8) + ends
    to = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(to[-1]) if len(to) else 0, "<u2")
    out[(to - size)[kept]] = raw[kept]
    return out.tobytes().decode("utf-16-le")


class Merger:
    """encode of a byte-level BPE tokenizers file for Latin strings by its merges' ranks; other strings go to the library.

    A table of ranks serves as well as the file's list of merges, as each merge makes a token of its own. Where
    the last symbol of a word has an end mark, END stands for it, and joining the two comes before all merges.
    """

    def __init__(self, name: str) -> None:
        with open(place(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, self.name, self.rest = spec["model"], name, None
        suffix = model["end_of_word_suffix"] or ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        raw = lambda t: bytes(chars[c] for c in (t[: -len(suffix)] if suffix and t.endswith(suffix) else t)) + (END.encode() if suffix and t.endswith(suffix) else b"")
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in chars for c in t.removesuffix(suffix))}
        order = [bytes([b]) for b in range(256)]
        order += [b + END.encode() for b in order if suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order += [raw(a.removesuffix(suffix) + b) if suffix else raw(a + b) for a, b in pairs]
        if len(set(order)) != len(order):
            raise ValueError(f"two merges of {name} make one token")
        self.ids = np.array([vocab.get(b, 0) for b in order], "<u4")
        self.classes = classes() if suffix else None
        pieces = r"[^\x00]*\x00" if suffix else public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}\x00]").replace(r"(?!\S)", r"(?![^\s\x00])") + r"|\x00"
        self.core = tiktoken.Encoding(name, pat_str=pieces, mergeable_ranks={b: i for i, b in enumerate(order)}, special_tokens={})

    def __call__(self, strings: list[str]) -> list[bytes]:
        """All strings in one go, each ended by END, whose rank is 0; those with other characters by the library."""
        joined = END.join(strings)
        if strings and joined.count(END) == len(strings) - 1 and "<|" not in joined and LATIN.fullmatch(joined):
            return self.merged(strings)
        good = [LATIN.fullmatch(s) is not None and END not in s and "<|" not in s for s in strings]
        known = iter(self.merged([s for s, g in zip(strings, good) if g]))
        if self.rest is None:  # read where it is needed
            self.rest = library(self.name)
        other = iter(self.rest([s for s, g in zip(strings, good) if not g]))
        return [next(known if g else other) for g in good]

    def merged(self, strings: list[str]) -> list[bytes]:
        if not strings:
            return []
        text = END.join(strings) + END
        if self.classes is not None:
            text = ended(text, self.classes)
        ranks = np.array(self.core.encode_ordinary(text), np.int64)
        stops = np.nonzero(ranks == 0)[0]
        raw, at = self.ids[ranks].tobytes(), (4 * stops).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], at)]
