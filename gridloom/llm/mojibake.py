"""Garbled text from wrong character encoding: found, and restored where possible.

A multinomial classifier (naive Bayes with smoothed counts) over hashed byte bigrams predicts, line
by line, the exact chain of encodings that garbled a line, or that none did.  It is trained on a
bounded sample of the corpus's own lines, garbled synthetically by every chain that applies to their
script.  Predicted chains are inverted until the line no longer reads as garbled, and the result kept only
if each step decodes strictly and the whole chain garbles it back to the very line.

Only lines with non-ASCII characters are looked at: every chain leaves the others as they
are.  The classes are counted as tasks of their own.  Documents are rows of their own; nothing is shuffled, and the weights (a few MB, fixed by
the number of chains and BINS) are broadcast.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the training sample: documents, and lines of each script.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 6000, 6000
#: Hashed bigrams.
BINS = 1 << 14
#: Log-odds against clean text that make a line suspect, and that make a line of a UTF-8 chain a case though it doesn't invert.
LINE_ODDS, BROKEN_ODDS = 3.0, 20.0
#: Marks that a misread letter often looks like.
MISREAD = frozenset("¢£€¥ßﬀﬁ")
#: Log-odds by which Greek and Cyrillic words must read better.
BETTER_ODDS = 10.0
#: Log-odds of the distinct words of a document after a single-byte chain against those before that leave no doubt: if all words
#: before are such as text has (a chain may turn capitals into other letters), and if some are odd.
PAGE_ODDS, ODD_PAGE_ODDS = 15.0, 5.0
SMOOTHING = 0.3
#: Prior log-odds of a clean line.
PRIOR = 5.0
#: Words that a single-byte chain must mend in a document: so many with two different odd characters among them, or
#: so many with one (a misread letter makes the same odd character again and again).
MENDED_WORDS, MENDED_ALIKE = 2, 6

#: For each script, encodings that text was stored in and those it was mistaken for.
SCRIPTS = ("western", "polish", "greek", "cyrillic")
UTF8_MISTAKEN = ("latin-1", "cp1252", "cp437", "mac_roman", "cp1250", "cp1251", "cp850", "iso8859-2", "koi8-r", "cp866", "cp1253")
SINGLE = {
    "western": {"cp1252": ("cp850", "cp437", "mac_roman", "cp1250", "cp1251", "iso8859-2"), "cp850": ("cp1252", "mac_roman"), "cp437": ("cp1252",), "mac_roman": ("cp1252", "cp850")},
    "polish": {"cp1250": ("cp1252", "iso8859-2", "cp852", "cp850", "cp437", "mac_roman", "cp1251"), "iso8859-2": ("cp1252", "cp1250", "cp850"), "cp852": ("cp1252", "cp1250", "cp850")},
    "greek": {"cp1253": ("cp1252", "cp1251", "cp437", "cp850", "mac_roman"), "iso8859-7": ("cp1252",)},
    "cyrillic": {"cp1251": ("cp1252", "koi8-r", "cp866", "mac_roman", "cp850", "cp437"), "koi8-r": ("cp1251", "cp1252", "cp866"), "cp866": ("cp1251", "cp1252", "koi8-r", "cp437"), "iso8859-5": ("cp1251", "cp1252")},
}
#: Name of the chain of text that lost characters to U+FFFD when it was read as UTF-8.
LOSSY = "unknown>utf-8"


@cache
def _tables(name: str) -> tuple[dict[int, str], dict[int, str]]:
    """Decoding and encoding tables of a single-byte encoding, over characters of the byte's number; undefined bytes
    stand for the control characters of their number."""
    decode = {b: (bytes([b]).decode(name, "ignore") or chr(b)) for b in range(256)}
    encode: dict[int, str] = {b: "\uffff" for b in range(256)}  # has no place in Latin-1: an error below
    if name == "cp1252":  # Latin-1 differs from it only in the control characters
        encode |= {b: chr(b) for b in range(0x80, 0xA0)}
    return decode, encode | {ord(decode[b]): chr(b) for b in range(255, -1, -1)}


@cache
def _undefined(name: str) -> bytes:
    """The bytes an encoding has no character for."""
    return bytes(b for b in range(256) if not bytes([b]).decode(name, "ignore"))


def decode_as(raw: bytes, name: str) -> str:
    return raw.decode("latin-1").translate(_tables(name)[0])


def encode_as(text: str, name: str) -> bytes | None:
    """The bytes of a text in an encoding, None if it has none for a character."""
    try:
        return text.translate(_tables(name)[1]).encode("latin-1")
    except UnicodeEncodeError:
        return None


Chain = tuple[tuple[str, str], ...]


def chains_of(script: str) -> list[Chain]:
    """The chains (stored as, read as), innermost first, that can befall a script."""
    utf = [(("utf-8", w),) for w in UTF8_MISTAKEN]
    double = [(("utf-8", a), ("utf-8", b)) for a in ("latin-1", "cp1252") for b in ("latin-1", "cp1252")]
    single = [((n, w),) for n, read in SINGLE[script].items() for w in read]
    return utf + double + single


def garble(text: str, chain: Chain) -> str | None:
    """The text after the chain; None if an encoding lacks a character."""
    for stored, read in chain:
        raw = text.encode() if stored == "utf-8" else encode_as(text, stored)
        if raw is None:
            return None
        text = raw.decode("latin-1") if read == "latin-1" else decode_as(raw, read)
    return text


def restore(text: str, chain: Chain) -> str | None:
    """The text before the chain; None unless it decodes strictly and the chain leads back to ``text``."""
    out = text
    for stored, read in reversed(chain):
        try:
            raw = out.encode("latin-1") if read == "latin-1" else encode_as(out, read)
            if raw is None:
                return None
            if stored == "utf-8":
                out = raw.decode()
            elif raw.translate(None, _undefined(stored)) != raw:
                return None
            else:
                out = decode_as(raw, stored)
        except UnicodeError:
            return None
    return out if garble(out, chain) == text else None


_GREEK, _CYRILLIC, _POLISH = (re.compile(x) for x in ("[\u0370-\u03ff]", "[\u0400-\u052f]", "[ąćęłńśźżĄĆĘŁŃŚŹŻ]"))


def script_of(line: str) -> str:
    """The script a line's letters suggest."""
    if _GREEK.search(line):
        return "greek"
    if _CYRILLIC.search(line):
        return "cyrillic"
    return "polish" if _POLISH.search(line) else "western"


# -- features -----------------------------------------------------------------------------

_HASH = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32)


def _bigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams with a non-ASCII byte, and the number of the line each belongs to."""
    raw = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode(), dtype=np.uint8)
    high = raw > 127
    at = np.flatnonzero(high[:-1] | high[1:])
    line = np.cumsum(raw == 10)[at + 1] - 1 - (raw[at + 1] == 10)
    return _HASH[raw[at].astype(np.int32) * 256 + raw[at + 1]], line


def _letters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams of characters, not bytes, with a non-ASCII one, and the number of the line each belongs to."""
    code = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    at = np.flatnonzero((code[:-1] > 127) | (code[1:] > 127))
    line = np.cumsum(code == 10)[at + 1] - 1 - (code[at + 1] == 10)
    return (((code[at].astype(np.uint64) << np.uint64(21) | code[at + 1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32), line


#: Classes of the model: clean text of each script, then each script's chains.
CLASSES: list[tuple[str, Chain]] = [(s, ()) for s in SCRIPTS] + [(s, c) for s in SCRIPTS for c in chains_of(s)]
CountClasses = Callable[[dict[str, list[str]]], Iterable[tuple[int, np.ndarray]]]


def class_counts(k: int, lines: dict[str, list[str]]) -> np.ndarray:
    """Counts of the hashed bigrams in the lines of class k's script, garbled by its chain."""
    script, chain = CLASSES[k]
    own = lines.get(script, [])
    made = [g for g in (garble(x, chain) for x in own) if g is not None] if chain else own
    changed = [g for g in made if not g.isascii()]
    if not changed:
        return np.zeros(BINS, dtype=np.float32)
    # a chain that can store only a few of the lines still stands for a whole corpus
    return (np.bincount(_bigrams(changed)[0], minlength=BINS) * (len(own) / max(len(made), 1))).astype(np.float32)


def _count_here(lines: dict[str, list[str]]) -> Iterable[tuple[int, np.ndarray]]:
    return ((k, class_counts(k, lines)) for k in range(len(CLASSES)))


def count_on(spark: SparkSession) -> CountClasses:
    """Counts the classes as tasks of their own.  The lines sent out are bounded by SAMPLE_LINES, the counts by the number of classes."""

    def count(lines: dict[str, list[str]]) -> Iterable[tuple[int, np.ndarray]]:
        sent = spark.sparkContext.broadcast(lines)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([class_counts(k, sent.value).tobytes() for k in own], pa.binary())], names=["k", "counts"])

        rows = spark.range(0, len(CLASSES), 1, min(len(CLASSES), 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "k long, counts binary").collect()
        sent.destroy()
        return [(r["k"], np.frombuffer(r["counts"], dtype=np.float32)) for r in rows]

    return count


class Classifier:
    """Weights (BINS, classes) of a multinomial model; the first classes are clean text of each script, and ``letters``
    (BINS, scripts) weighs the bigrams of their characters."""

    def __init__(self, classes: list[tuple[str, Chain]], weights: np.ndarray, letters: np.ndarray):
        self.classes, self.weights, self.letters = classes, weights, letters
        self.clean = np.array([not chain for _, chain in classes])

    @classmethod
    def train(cls, lines: dict[str, list[str]], count: CountClasses | None = None) -> Classifier:
        """A model of the lines of each script; ``count`` may count the classes' bigrams elsewhere."""
        counts = np.zeros((BINS, len(CLASSES)), dtype=np.float32)
        for k, column in (count or _count_here)(lines):
            counts[:, k] = column
        log = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BINS)
        log[:, counts.sum(axis=0) == 0] = -20.0
        clean = np.stack([np.bincount(_letters(lines.get(s) or [""])[0], minlength=BINS) for s in SCRIPTS], axis=1)
        letters = np.log(clean + SMOOTHING) - np.log(clean.sum(axis=0) + SMOOTHING * BINS)
        letters[:, clean.sum(axis=0) == 0] = -20.0
        return cls(CLASSES, log.astype(np.float32), letters.astype(np.float32))

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log-likelihoods (lines, classes)."""
        out = np.zeros((len(lines), len(self.classes)), dtype=np.float32)
        if not lines:
            return out
        bins, owner = _bigrams(lines)
        for a in range(0, len(bins), 50_000):
            w, o = self.weights[bins[a : a + 50_000]], owner[a : a + 50_000]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            out[o[first]] += np.add.reduceat(w, first, axis=0)
        return out

    def gains(self, before: list[str], after: list[str], script: str) -> np.ndarray:
        """By how much each line reads better as clean text after a single-byte chain: log-odds.  Such a chain puts one
        character for another, so both have the same number of bigrams."""
        if script in ("greek", "cyrillic"):  # chains that swap the cases are no evidence
            before, after = [x.lower() for x in before], [x.lower() for x in after]
        out = []
        for lines in (before, after):
            bins, owner = _letters(lines)
            s = np.zeros((len(lines), len(SCRIPTS)), dtype=np.float64)
            np.add.at(s, owner, self.letters[bins])
            out.append(s.max(axis=1))
        return out[1] - out[0]

    def judge(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line the log-odds of its likeliest chain against clean text, that class, and the log-odds of every
        class without the prior."""
        s = self.scores(lines)
        s -= s[:, self.clean].max(axis=1, keepdims=True)
        s[:, self.clean] = -np.inf
        best = s.argmax(axis=1)
        return s[np.arange(len(lines)), best] - PRIOR, best, s


def train_on(texts: Iterable[str], count: CountClasses | None = None) -> Classifier:
    """A classifier from sample texts, most of which are clean: in a second turn, lines the first one calls garbled are left out."""
    # the first SAMPLE_LINES of each script by hash are a sample, not a prefix of the alphabet
    seen = {line.strip("\r") for t in texts for line in t.split("\n") if not line.isascii()}
    lines = [(x, script_of(x)) for _, x in sorted((zlib.crc32(x.encode()), x) for x in seen)]
    known: dict[str, bool] = {}

    def usable(x: str) -> bool:
        if x not in known:
            known[x] = "�" not in x and not any(_strictly_utf8(x, w) for w in UTF8_MISTAKEN)
        return known[x]

    def sample(model: Classifier | None) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {s: [] for s in SCRIPTS}
        for a in range(0, len(lines), 2048):
            block = [(x, s) for x, s in lines[a : a + 2048] if len(out[s]) < SAMPLE_LINES and usable(x)]
            odds = model.judge([x for x, _ in block])[0] if model is not None else np.full(len(block), -1.0)
            for (x, s), o in zip(block, odds, strict=True):
                if o < 0 and len(out[s]) < SAMPLE_LINES:
                    out[s].append(x)
        return out

    return Classifier.train(sample(Classifier.train(sample(None), count)), count)


def _strictly_utf8(line: str, read: str) -> bool:
    return restore(line, (("utf-8", read),)) not in (None, line)


# -- documents ------------------------------------------------------------------------------


def _core(word: str) -> str:
    """A word without the marks at its ends."""
    a, b = 0, len(word)
    while a < b and unicodedata.category(word[a])[0] == "P":
        a += 1
    while b > a and unicodedata.category(word[b - 1])[0] == "P":
        b -= 1
    return word[a:b]


def _plain_word(word: str) -> bool:
    """A word as text has it: letters of one script, in one of the usual cases, hyphens and apostrophes apart."""
    parts = [p for p in _JOINS.split(word) if p]
    if not parts or not all(p.isalpha() for p in parts):
        return False
    joined = "".join(parts)
    if not (joined.islower() or joined.isupper() or all(p[1:].islower() or len(p) == 1 for p in parts)):
        return False
    return len({_letter_script(c) for c in joined}) == 1


_JOINS = re.compile("[-'’⸗\xad­=¬]+")


def mended_words(before: str, after: str) -> tuple[list[str], int]:
    """The odd words of a line that a single-byte chain turns into plain words, and how many plain words it breaks."""
    good, bad = [], 0
    for a, b in zip(before.split(" "), after.split(" "), strict=False):
        if a == b or a.isascii() or "\xa0" in a:
            continue
        core, fixed = _core(a), _core(b)
        if not any(not c.isascii() and c.isalpha() for c in fixed) and "’" not in fixed:
            continue  # only marks changed
        natural, plain = _plain_word(core), _plain_word(fixed)
        variety = len(set(fixed.lower())) >= (2 if any(c.isalpha() for c in core) else 3)  # not a rule of dashes
        if plain and variety and not natural:
            good.append(core)
        elif natural and not plain:
            bad += 1
    return good, bad


def _read_better(model: Classifier, before: str, after: str, script: str) -> tuple[list[str], int]:
    """The words of a line that a chain turns into words of ``script``, if they read better so, whatever their case:
    such encodings mostly turn letters into other letters and may swap the cases."""
    pairs = [(_core(a), _core(b)) for a, b in zip(before.split(" "), after.split(" "), strict=False) if a != b]
    pairs = [(a, b) for a, b in pairs if a and b.isalpha() and len(set(b.lower())) >= 3 and all(_letter_script(c) == script for c in b)]
    if not pairs:
        return [], 0
    s = model.scores([" ".join(x).lower() for x in zip(*pairs, strict=True)])[:, model.clean].max(axis=1)
    return ([a for a, _ in pairs], 0) if s[1] - s[0] > BETTER_ODDS else ([], 0)


def _letter_script(c: str) -> str:
    return "greek" if "Ͱ" <= c < "Ѐ" else "cyrillic" if "Ѐ" <= c < "԰" else "latin"


def _mostly_utf8(line: str, read: str) -> bool:
    """Whether, read back as ``read``, most of what isn't ASCII is UTF-8, though some of it got lost."""
    raw = line.encode("latin-1", "ignore") if read == "latin-1" else line.translate(_tables(read)[1]).encode("latin-1", "ignore")
    back = raw.decode("utf-8", "replace")
    wrong = back.count("\ufffd")
    return sum(not c.isascii() for c in back) - wrong > wrong


def _mends(model: Classifier, odd: list[str], done: set[int], table: np.ndarray, script: str, chain: Chain) -> tuple[float, dict[int, str]] | None:
    """What a single-byte chain mends in the lines of a document that aren't done: (log-odds of the chain over its
    distinct words, lines put back); None if neither the words nor the odds speak for it.

    A document is accepted if enough odd words become plain ones, or if its distinct words, marks and all, read so
    much better that there is no doubt.
    """
    backs = {i: b for i, x in enumerate(odd) if i not in done and (b := restore(x, chain)) is not None and b != x}
    if not backs:
        return None
    gains = dict(zip(backs, model.gains([odd[i] for i in backs], list(backs.values()), script), strict=True))
    good: list[str] = []
    mended: dict[int, str] = {}
    pairs: dict[str, str] = {}
    for i, back in backs.items():
        words, bad = _read_better(model, odd[i], back, script) if script in ("greek", "cyrillic") else mended_words(odd[i], back)
        if len(words) > bad:
            good += words
            mended[i] = back
        if gains[i] > LINE_ODDS:
            pairs |= _changed_words(odd[i], back)
    weight = float(model.gains([" ".join(pairs)], [" ".join(pairs.values())], script)[0]) if pairs else 0.0
    marks = {c for w in good for c in w if not c.isascii()}
    broken = sum(_breaks(a, b) for a, b in pairs.items())
    words_say = bool(marks - MISREAD) and (len(good) >= MENDED_ALIKE or (len(good) >= MENDED_WORDS and len(marks) >= 2))
    words_say = words_say and sum(gains[i] for i in mended) > 0
    needed = PAGE_ODDS if all(_plain_word(_core(a)) for a in pairs) else ODD_PAGE_ODDS
    if not (words_say or (weight > needed and broken * 4 <= len(pairs))):
        return None
    for i, back in backs.items():
        if i not in mended and gains[i] > 0 and not _RULES.search(back):
            own = _changed_words(odd[i], back)
            if own and sum(_breaks(a, b) for a, b in own.items()) * 2 <= len(own):
                mended[i] = back
    if not mended:
        return None
    return max(weight, float(sum(table[i, model.classes.index((script, chain))] for i in mended))), mended


def _changed_words(before: str, after: str) -> dict[str, str]:
    """The words of a line that a chain changes, but for rules, no-break spaces and those that misread letters explain."""
    pairs = zip(before.split(" "), after.split(" "), strict=False)
    return {a: b for a, b in pairs if a != b and "\xa0" not in a and not _RULES.search(b) and {c for c in a if not c.isascii()} - MISREAD}


def _breaks(before: str, after: str) -> bool:
    """Whether a word that text has as it stands would get an odd form, or letters for its marks."""
    if any(c.isalpha() for c in before) and not _plain_word(_core(before)):
        return False
    return sum(c.isalpha() for c in after) > sum(c.isalpha() for c in before) or (after.upper() != after.lower() and not _plain_word(_core(after)))


#: Lines of boxes and control characters: no part of running text.
_RULES = re.compile("[\u2500-\u259f\x00-\x08\x0e-\x1f\x7f-\x9f]")


def decide(model: Classifier, lines: list[str], where: list[int], odd: list[str], odds: np.ndarray, best: np.ndarray, table: np.ndarray) -> tuple[str, str, float, int, int] | None:
    """What befell a text: (chain, restored text, log-odds, garbled lines, restored lines); None if nothing did.

    A line of a UTF-8 chain counts if it inverts strictly, or if its odds leave no doubt.  The odd characters of
    single-byte chains also occur in clean text, so such a chain must mend words all over the document.
    """
    lost = {i for i, x in enumerate(odd) if "�" in x}
    odds, best, table = odds.copy(), best.copy(), table.copy()
    todo = np.flatnonzero(odds > LINE_ODDS).tolist()
    if not (todo or lost):
        return None
    text = list(odd)  # each line as far as it is put back
    undone: dict[int, Chain] = {}  # what was undone in it, innermost first
    weights: dict[int, float] = {}
    broken: dict[int, Chain] = {}  # lines of a UTF-8 chain that doesn't invert
    turned: set[int] = set()  # lines of which a single-byte chain was undone

    def undo(i: int, back: str, chain: Chain, weight: float) -> None:
        text[i], undone[i], weights[i] = back, chain + undone.get(i, ()), weights.get(i, 0.0) + weight

    def again(changed: list[int]) -> list[int]:
        """The lines among those changed that still don't read as clean text."""
        if changed:
            odds[changed], best[changed], table[changed] = model.judge([text[i] for i in changed])
        return [i for i in changed if odds[i] > LINE_ODDS]

    while True:
        while todo:  # every inversion of UTF-8 shortens the line
            changed = []
            for i in todo:
                chain = model.classes[best[i]][1]
                if chain[0][0] != "utf-8":
                    continue
                likely = (model.classes[k][1] for k in np.argsort(-table[i]) if table[i, k] > LINE_ODDS + PRIOR)
                for c in dict.fromkeys([chain, *_KIN.get(chain, ()), *likely]):  # chains that give the same or a like line are told apart by which of them inverts
                    back = restore(text[i], c) if c[0][0] == "utf-8" else None
                    if back is not None and back != text[i]:
                        undo(i, back, c, float(odds[i]))
                        changed.append(i)
                        break
                else:
                    if odds[i] > BROKEN_ODDS and _mostly_utf8(text[i], chain[-1][1]):
                        broken[i] = chain
                        weights[i] = weights.get(i, 0.0) + float(odds[i])
            todo = again(changed)
        # of the single-byte chains with a vote, the one with the most evidence; what is left goes to the next
        done = lost | turned | set(broken)
        voted = {model.classes[best[i]] for i in np.flatnonzero(odds > LINE_ODDS) if i not in done}
        found = [(*f, chain) for script, chain in sorted(voted) if chain[0][0] != "utf-8" and (f := _mends(model, text, done, table, script, chain))]
        if not found:
            break
        weight, mended, chain = max(found, key=lambda f: f[0])
        for i, back in mended.items():
            undo(i, back, chain, weight / len(mended))
        turned |= set(mended)
        todo = again(list(mended))
    garbled = lost | set(broken) | set(undone)
    if not garbled:
        return None
    # a line that is still garbled, or from which no way leads back, stays as it is
    fixed = [i for i, chain in undone.items() if i not in broken and garble(text[i], chain) == odd[i]]
    votes: dict[Chain, float] = {}
    for i in undone | broken:
        chain = broken.get(i, ()) + undone.get(i, ())
        votes[chain] = votes.get(chain, 0.0) + weights[i]
    chain = max(votes, key=votes.__getitem__) if votes else None
    out = list(lines)
    for i in fixed:
        out[where[i]] = text[i] + ("\r" if lines[where[i]].endswith("\r") else "")
    name = "+".join(f"{a}>{b}" for a, b in chain) if chain else LOSSY
    return name, "\n".join(out), float(sum(votes.values())), len(garbled), len(fixed)


def _kin() -> dict[Chain, list[Chain]]:
    same = ("latin-1", "cp1252")
    out: dict[Chain, list[Chain]] = {}
    for w in same:
        out[(("utf-8", w),)] = [(("utf-8", v),) for v in same]
        for v in same:
            out[(("utf-8", w), ("utf-8", v))] = [(("utf-8", a), ("utf-8", b)) for a in same for b in same] + [(("utf-8", v),)]
    return out


_KIN = _kin()


def hash_bound(n: int) -> int:
    """The bound below which a 64-bit hash lies for SAMPLE_DOCUMENTS of n rows on average (for all, if there are fewer)."""
    return min((1 << 63) - 1, -(1 << 63) + (SAMPLE_DOCUMENTS << 64) // max(n, 1))


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which some line was decoded wrongly.

    Returns key, chain (the likeliest of its lines), restored (the text with every
    line put back that could be), log_odds, garbled_lines, restored_lines.  Null, empty and
    pure ASCII texts are no cases; a repeated row is a case each time.
    """
    spark = documents.sparkSession
    picked = documents.where(F.col(f"`{text}`").isNotNull() & (F.xxhash64(f"`{key}`") < F.lit(hash_bound(documents.count())))).select(f"`{text}`").limit(2 * SAMPLE_DOCUMENTS)
    model = train_on((r[0] for r in picked.toLocalIterator()), count_on(spark))
    sent = spark.sparkContext.broadcast((model.classes, model.weights, model.letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                hits = list(_inspect_many(own, texts[a : a + 256]))
                if hits:
                    index = pa.array([a + i for i, _ in hits])
                    columns = [pa.array([h[k] for _, h in hits], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *columns], names=[key, "chain", "restored", "log_odds", "garbled_lines", "restored_lines"])

    kind = dict(documents.dtypes)[key]
    return documents.where(F.col(f"`{text}`").isNotNull()).select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, chain string, restored string, log_odds double, garbled_lines long, restored_lines long")


def _inspect_many(model: Classifier, texts: list[str]):
    """The positions and findings of the garbled ones among some texts, whose lines are scored together."""
    parts, all_odd = [], []
    for i, t in enumerate(texts):
        if t.isascii():
            continue
        lines = t.split("\n")
        where = [k for k, x in enumerate(lines) if not x.isascii()]
        odd = [lines[k].rstrip("\r") for k in where]
        parts.append((i, lines, where, odd, len(all_odd)))
        all_odd += odd
    odds, best, table = model.judge(all_odd)
    for i, lines, where, odd, at in parts:
        found = decide(model, lines, where, odd, odds[at : at + len(odd)], best[at : at + len(odd)], table[at : at + len(odd)])
        if found:
            yield i, found
