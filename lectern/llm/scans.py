"""Problem 5: repair text from scanned pages.

The lines of a page are labelled as running header, page number, body or break
by a hidden Markov model over layout features (place on the page, likeness to
title, venue and authors, width, indent, case, punctuation); how far a likeness
can be trusted depends on the page's recognition confidence, so its tables are
kept for each level of that.  The model's tables are
counted on all pages whose repaired text is known, then refined by Viterbi
training on all scanned pages, whose counts Spark sums.  Words cut at line ends
and misread words are judged by the word counts of all pages, scanned and native: the
most frequent words are sent to all tasks, the others joined by a shuffle to the
pages that ask for them.  Body lines are put together to paragraphs; a word cut by a page end is joined with the next page by
an equi-join on the page number, so no task holds more than single pages.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import fold
from lectern.session import cut

HEADER, NUMBER, BODY, BREAK = range(4)
#: Marks that stand for a hyphen at a line end.
HYPHENS = "-‐‑¬\xad"
OUTER = ".,;:!?()[]{}\"“”'’‘«»…"
#: What a scanner reads for a letter.
LOOKS_LIKE = {"0": "o", "1": "li", "5": "s", "|": "il", "@": "a", "9": "g", "6": "b", "8": "b", "3": "e", "7": "t", "$": "s", "!": "il", "I": "l"}
PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("in", "m"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("n", "ri"))
#: Letters read for each other.
VISUAL = {"c": "eo", "e": "c", "i": "l", "l": "i", "t": "f", "f": "t", "u": "n", "n": "u", "h": "b", "b": "h", "o": "c", "g": "q", "q": "g", "v": "y", "y": "v", "a": "o"}
#: Fixed value: what stands for the venue of a paper without one.
NO_VENUE = "Working Paper Series"
SPECKS = "|~'.,`^*_:;\""
#: A page of at least this confidence is a sure one.
SURE = 0.75
NUMBER_LINE = re.compile(r"^\W*(?:(?:p|pp|pg|page|seite)\W{0,2}\s*)?(?:\d{1,5}|[ivxlc]{1,7}|(?=[lIOoSs|]*\d)[\dlIOoSs|]{1,5})(?:\s*(?:of|/|von|de)\s*\d{1,5})?\W*$", re.IGNORECASE)


# --- labelling of lines -----------------------------------------------------


def _letters(text: str) -> str:
    """Letters only, with what a scanner misreads put back."""
    text = fold(text).translate(str.maketrans("015|@", "olsia"))
    return "".join(c for c in text if c.isalpha())


def _grams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


@lru_cache(maxsize=4096)
def _running(title: str | None, venue: str | None, authors: tuple) -> tuple:
    """What may run at the top or bottom of a paper's pages: for each string its
    length in letters and where each of its letter triples first stands."""
    out = [_letters(title or ""), _letters(venue or NO_VENUE)]
    for a in authors:
        parts = re.findall(r"[^\W\d_]+", fold(a or ""))
        if parts:
            out += [_letters(parts[-1]) + "andothers", _letters(parts[-1]) + "etal", _letters("".join(parts))]
    return tuple((len(x), {x[i : i + 3]: i for i in range(len(x) - 3, -1, -1)}) for x in dict.fromkeys(out) if len(x) >= 4)


def _likeness(line: str, running: tuple) -> float:
    """Share of letter triples in common with the start of the likeliest string."""
    s = _letters(line)
    if len(s) < 4:
        return 0.0
    mine, best = _grams(s), 0.0
    for size, first in running:
        whole = len(mine) + max(1, min(size, len(s)) - 2)
        both = mine & first.keys()
        if 2 * len(both) > best * whole:
            best = max(best, 2 * sum(first[g] <= len(s) + 1 for g in both) / whole)
    return best


def sureness(confidence: float | None) -> int:
    """0 where the confidence of a page is unknown or out of range, 1 where it is
    below ``SURE``, else 2.  Confidences above 1 are percentages."""
    if confidence is None or not 0 <= confidence <= 100:
        return 0
    return 2 if (confidence if confidence <= 1 else confidence / 100) >= SURE else 1


def line_features(lines: list[str], running: tuple, sure: int = 0) -> list[tuple | None]:
    """Discrete features of each line; None for a blank one.  Lines far from
    both ends of the page share one value.  ``sure`` is the page's :func:`sureness`."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    out: list[tuple | None] = [None] * len(lines)
    if not full:
        return out
    widths = sorted(len(lines[i].strip()) for i in full)
    usual = widths[(len(widths) * 3) // 4] or 1
    last = len(full) - 1
    for n, i in enumerate(full):
        top, bottom = min(n, 3), min(last - n, 3)
        if top == 3 and bottom == 3:
            out[i] = ("inner",)
            continue
        raw = lines[i].rstrip("\r")
        s = raw.strip()
        tokens = s.split()
        width = len(s) / usual
        like = _likeness(s, running)
        alone = (i > 0 and not lines[i - 1].strip()) + 2 * (i + 1 < len(lines) and not lines[i + 1].strip())
        capitals = sum(t[:1].isupper() for t in tokens) / len(tokens)
        out[i] = (
            ("top", top), ("bottom", bottom),
            ("number", 2 if NUMBER_LINE.match(s) else 1 if re.match(r"^\d{1,4}\s{2,}|.*\s{3,}\d{1,4}$", s) else 0),
            ("like", 4 * sure + (3 if like >= 0.75 else 2 if like >= 0.55 else 1 if like >= 0.4 else 0)),
            ("width", 0 if width < 0.35 else 1 if width < 0.75 else 2 if width < 0.92 else 3),
            ("alone", alone), ("end", s[-1] in ".?!:;,"), ("lower", s[0].islower()),
            ("capitals", 2 if capitals > 0.8 else 1 if capitals > 0.4 else 0), ("indent", len(raw) - len(raw.lstrip()) >= 6),
        )
    return out


#: The features of a line near an end of its page, with how many values each has.
FEATURES = (("top", 4), ("bottom", 4), ("number", 3), ("like", 12), ("width", 4), ("alone", 4), ("end", 2), ("lower", 2), ("capitals", 3), ("indent", 2))
BLANK, INNER = -1, -2


def _code(feature: tuple | None) -> int:
    """The features of a line as one number."""
    if feature is None:
        return BLANK
    if feature == ("inner",):
        return INNER
    n = 0
    for (_, size), (_, value) in zip(FEATURES, feature):
        n = n * size + int(value)
    return n


def _decode(code: int) -> tuple | None:
    if code < 0:
        return None if code == BLANK else ("inner",)
    out = []
    for name, size in reversed(FEATURES):
        code, value = divmod(code, size)
        # likenesses compete with those of pages of the same sureness only
        out.append((f"like{value // 4}", value % 4) if name == "like" else (name, value))
    return tuple(out[::-1])


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    end: np.ndarray
    emit: dict  # (feature) -> log probabilities by state
    memo: dict = field(default_factory=dict)

    def scores(self, code: int) -> np.ndarray:
        e = self.memo.get(code)
        if e is None:
            feature, e = _decode(code), np.zeros(4)
            for f in [None] if feature is None else feature:
                e = e + self.emit.get(f, 0.0)
            self.memo[code] = e
        return e

    def label(self, pages: list[np.ndarray], block: int = 1024) -> list[np.ndarray]:
        """The likeliest states (Viterbi) of the coded lines of each page, for
        blocks of pages at once, longest first."""
        out: list = [np.zeros(0, np.int8)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: -len(pages[i]))
        for lo in range(0, len(order), block):
            mine = order[lo : lo + block]
            size = np.array([len(pages[i]) for i in mine])
            codes, at = np.unique(np.concatenate([pages[i] for i in mine]), return_inverse=True)
            emit = np.stack([self.scores(c) for c in codes.tolist()])[at]
            offset = np.cumsum(size) - size
            score = self.start + emit[offset]
            back = np.zeros((size[0], len(mine), 4), np.int8)
            for t in range(1, size[0]):
                m = int((size > t).sum())
                v = score[:m, :, None] + self.step
                back[t, :m] = v.argmax(1)
                score[:m] = v.max(1) + emit[offset[:m] + t]
            state = (score + self.end).argmax(1)
            path = np.zeros((size[0], len(mine)), np.int8)
            for t in range(size[0] - 1, -1, -1):
                m = int((size > t).sum())
                path[t, :m] = state[:m]
                state[:m] = back[t, np.arange(m), state[:m]]
            for n, i in enumerate(mine):
                out[i] = path[: size[n], n]
        return out


def tally(pages: list[np.ndarray], labels: list) -> Counter:
    """What the model counts on labelled pages: (what, key, state) -> n, for
    starts, ends, steps and coded lines."""
    out = Counter()
    for codes, states in zip(pages, labels):
        if not len(states):
            continue
        states = np.asarray(states, np.int64)
        out["start", 0, int(states[0])] += 1
        out["end", 0, int(states[-1])] += 1
        for x, n in enumerate(np.bincount(states[:-1] * 4 + states[1:], minlength=16).tolist()):
            if n:
                out["step", x // 4, x % 4] += n
        out.update(("line", c, s) for c, s in zip(codes.tolist(), states.tolist()))
    return out


def fit(counts: Counter, weight: float = 0.5, pooled: float = 2000) -> Model:
    """The tables of the model from what :func:`tally` counts, smoothed by
    ``weight``; those of one level of sureness by ``pooled`` lines that are
    spread as on all pages."""
    start, end, step = np.full(4, weight), np.full(4, weight), np.full((4, 4), weight)
    state_n = np.full(4, weight)
    values: dict = {}
    blank = np.full(4, 1e-3)
    for (what, key, s), n in sorted(counts.items()):
        if what == "start":
            start[s] += n
        elif what == "end":
            end[s] += n
        elif what == "step":
            step[key, s] += n
        else:
            state_n[s] += n
            feature = _decode(key)
            if feature is None:
                blank[s] += n
                continue
            for x in feature:
                values.setdefault(x, np.full(4, weight))[s] += n
    likes: dict = {}
    for (name, v), n in [x for x in values.items() if x[0][0].startswith("like")]:
        likes[v] = likes.get(v, 0) + n
    every = sum(likes.values()) if likes else 1.0
    for level in {x[0] for x in values if x[0].startswith("like")}:
        for v, n in likes.items():
            values[level, v] = values.get((level, v), 0) + n * pooled / every.sum() if likes else 0
    totals: dict = {}
    for x, n in values.items():
        totals[x[0]] = totals.get(x[0], 0) + n
    # features of one kind compete with each other; "inner" with all that are not inner
    inner = values.get(("inner",), np.full(4, weight))
    seen = totals.get("top", np.full(4, weight))
    emit = {x: np.log(n / totals[x[0]]) for x, n in values.items() if x != ("inner",)}
    for x in list(emit):
        if x[0] == "top":
            emit[x] = emit[x] + np.log(seen / (seen + inner))
    emit[("inner",)] = np.log(inner / (seen + inner))
    share = blank / state_n
    emit[None] = np.log(np.clip(share, 1e-6, 1 - 1e-6))
    rest = np.log(np.clip(1 - share, 1e-6, 1))
    for x in list(emit):
        if x is not None and x[0] in ("top", "inner"):
            emit[x] = emit[x] + rest
    log = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return Model(log(start), log(step), log(end), emit)


def known_labels(lines: list[str], repaired: str) -> list[int]:
    """Labels of lines by whether the repaired text of the page holds them."""
    whole = _letters(repaired)
    grams = {whole[i : i + 5] for i in range(len(whole) - 4)}
    out = []
    for x in lines:
        s = _letters(x)
        if not x.strip():
            out.append(BREAK)
        elif NUMBER_LINE.match(x.strip()):
            out.append(BODY if re.search(rf"(?m)^\s*{re.escape(x.strip())}\s*$", repaired) else NUMBER)
        elif len(s) >= 5:
            mine = [s[i : i + 5] for i in range(len(s) - 4)]
            out.append(BODY if sum(g in grams for g in mine) >= 0.4 * len(mine) else HEADER)
        else:
            out.append(BODY if x.strip() in repaired else HEADER)
    return out


# --- words ------------------------------------------------------------------


def _cut_end(line: str) -> str | None:
    """The last word of a line without its mark, if it ends in a hyphen mark."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return None
    return s.split()[-1][:-1]


def _first(line: str) -> str:
    return (line.split() or [""])[0]


def page_words(text: str) -> list[str]:
    """Lower-case words of a text as written; parts of words cut by line ends
    are left out."""
    out, skip = [], False
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        ends = tokens[-1][-1] in HYPHENS
        part = tokens[1:] if skip else tokens
        if ends:
            part = part[:-1]
        out += [t for t in (x.strip(OUTER) for x in part) if t and t[0].islower()]
        skip = ends
    return out


def lexicon(pages: DataFrame, bound: int = 200_000) -> tuple[dict[str, int], DataFrame | None]:
    """Counts of the words that ``pages`` (text) write in lower case: the
    ``bound`` most frequent ones, and a table (word, n) of all others if there
    are any."""

    def run(batches):
        for batch in batches:
            n = Counter()
            for t in batch.column("text").to_pylist():
                n.update(page_words(t))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    counted = pages.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted, "scan-words")
    head = [(r[0], r[1]) for r in counted.orderBy(F.desc("n"), "word").limit(bound).collect()]
    if len(head) < bound:
        return dict(head), None
    word, n = head[-1]
    return dict(head), counted.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > word))


def spellings(word: str) -> set[str]:
    """What ``word`` may be a misreading of, by marks and look-alikes."""
    low = word.lower()
    found = {"".join(c for c in low if c not in SPECKS), fold(low)}
    for c in {c for c in word if c in LOOKS_LIKE}:
        for to in LOOKS_LIKE[c]:
            found.add(word.replace(c, to).lower())
            i = word.index(c)
            found.add((word[:i] + to + word[i + 1 :]).lower())
    found.add("".join(LOOKS_LIKE.get(c, c)[0] if not c.isalpha() else c for c in low))
    for a, b in PAIRS:
        i = low.find(a)
        while i >= 0:
            found.add(low[:i] + b + low[i + len(a) :])
            i = low.find(a, i + 1)
    for i in range(len(low)):
        if not low[i].isalnum():
            found.add(low[:i] + low[i + 1 :])
    return found


def letter_spellings(low: str) -> list[str]:
    """Words that differ from ``low`` by one letter read for another."""
    return [low[:i] + to + low[i + 1 :] for i, c in enumerate(low) for to in VISUAL.get(c, "")]


def pair_words(left: str, right: str) -> set[str]:
    """The words that are asked about where ``left`` is cut and ``right`` follows."""
    right, left = right.rstrip("\r").strip(OUTER), left.lstrip(OUTER)
    out = {left + right, left + "-" + right, left, right, left.rstrip(HYPHENS) + right}
    return out | {left.rsplit("-", 1)[1] + right} if "-" in left else out


def asked_words(lines: list[str], labels: list[int]) -> set[str]:
    """The words that are asked about on a page."""
    out, body = set(), [x for x, s in zip(lines, labels) if s == BODY]
    for n, line in enumerate(body):
        out.update(t.strip(OUTER) for t in line.split())
        end = _cut_end(line)
        if end is not None:
            out |= pair_words(end, next((f for f in map(_first, body[n + 1 :]) if f), ""))
    return out


def rare_counts(asked: DataFrame, tail: DataFrame, head: dict[str, int]) -> DataFrame:
    """(paper_id, page_number, more): counts of the words of ``tail`` that decide
    about the ``form``s of ``asked`` (paper_id, page_number, form).

    A form in ``head`` is left out of ``asked``: only a word that is much more
    frequent corrects it, and such words are in ``head`` too."""
    shared = asked.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            form, word = [], []
            for f in batch.column("form").to_pylist():
                low = f.lower()
                mine = {low}
                if len(low) <= 40:
                    mine |= spellings(f)
                    mine.update(letter_spellings(low))
                mine.difference_update(shared.value)
                form += [f] * len(mine)
                word += mine
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(word, pa.string())], ["form", "word"])

    counts = asked.select("form").distinct().mapInArrow(run, "form string, word string").join(tail, "word")
    counts = counts.groupBy("form").agg(F.collect_list(F.struct("word", "n")).alias("more"))
    return asked.join(counts, "form").groupBy("paper_id", "page_number").agg(F.flatten(F.collect_list("more")).alias("more"))


class Speller:
    """Judges words by the counts of a lexicon."""

    def __init__(self, counts: dict[str, int], ratio: int = 12):
        self.counts, self.ratio, self.memo = counts, ratio, {}
        self.fine, self.bad, self.rare = set(), set(), set()

    def add(self, more: list[dict] | None) -> None:
        """Take in the rare words' counts that the next page needs."""
        if len(self.rare) > 500_000:
            for w in self.rare:
                del self.counts[w]
            self.rare.clear()
        for x in more or ():
            if x["word"] not in self.counts:
                self.counts[x["word"]] = x["n"]
                self.rare.add(x["word"])

    def misread(self, tokens: list[str]) -> bool:
        """Whether any token is a misread ordinary word.  Tokens are judged once
        and then looked up as sets."""
        if not self.bad.isdisjoint(tokens):
            return True
        for t in set(tokens).difference(self.fine):
            w = t.strip(OUTER)
            if w and self.fix(w):
                self.bad.add(t)
                return True
            if len(self.fine) > 1_000_000:
                self.fine.clear()
            self.fine.add(t)
        return False

    def fix(self, word: str) -> str | None:
        """The ordinary word that ``word`` is a misreading of, or None."""
        hit = self.memo.get(word, 0)
        if hit == 0:
            if len(self.memo) > 500_000:
                self.memo.clear()
            hit = self.memo[word] = self._fix(word)
        return hit

    def _fix(self, word: str) -> str | None:
        low = word.lower()
        if len(low) < 2 or len(low) > 40 or not any(c.isalpha() for c in low):
            return None
        own = self.counts.get(low, 0)
        found = spellings(word)
        best = max(((self.counts.get(f, 0), f) for f in found if f != low and len(f) > 1), default=(0, ""))
        if low.isalpha() and low.isascii():
            # a word of letters only may be another ordinary word
            need = 4 * self.ratio
            for x in letter_spellings(low):
                n = self.counts.get(x, 0)
                if n > best[0]:
                    best = (n, x)
        else:
            need = self.ratio
        return best[1] if best[0] >= need * max(1, own) else None

    def known(self, word: str) -> int:
        return self.counts.get(word.strip(OUTER).lower(), 0)

    def joins(self, left: str, right: str) -> bool:
        """Whether a word cut into ``left`` and ``right`` lost a mere line-end
        mark, rather than being written with a hyphen of its own."""
        right = right.rstrip("\r").strip(OUTER)
        left = left.lstrip(OUTER)
        if not left or not right or not right[0].isalpha() or not right[0].islower():
            return False
        whole, own = (left + right).lower(), (left + "-" + right).lower()
        a, b = self.counts.get(whole, 0), self.counts.get(own, 0)
        if a or b:
            return a >= b
        # a compound of more parts: its last part decides
        if "-" in left and self.joins_known(left.rsplit("-", 1)[1] + right):
            return True
        fixed, kept = self.fix(whole), self.fix(own)
        if fixed or kept:
            return self.counts.get(fixed or "", 0) >= self.counts.get(kept or "", 0) if kept else True
        return not (self.counts.get(left.lower(), 0) and self.counts.get(right.lower(), 0) and len(left) > 3 and len(right) > 3)

    def joins_known(self, word: str) -> bool:
        return self.counts.get(word.lower(), 0) > 0


def read_page(lines: list[str], labels: list[int], speller: Speller, scanned: bool = True):
    """Of a page with labelled lines, the lines whose last word must be joined within the
    page, the lines with misread words, the first body line and the end of the
    last body line as (line, word before the mark) if it is cut.  Of a native
    page only its ends are read."""
    body = [i for i, s in enumerate(labels) if s == BODY]
    joined, misread = [], set()
    for n, i in enumerate(body if scanned else ()):
        tokens = lines[i].split()
        skip_first = bool(n and joined and joined[-1] == body[n - 1])
        end = _cut_end(lines[i])
        nxt = lines[body[n + 1]] if n + 1 < len(body) else None
        if end is not None and nxt is not None and speller.joins(end, _first(nxt)):
            joined.append(i)
            right = _first(nxt).strip(OUTER)
            whole = end.lstrip(OUTER) + right
            fixed = speller.fix(whole)
            if fixed:
                same = 0
                low = whole.lower()
                while same < min(len(low), len(fixed)) and low[same] == fixed[same]:
                    same += 1
                misread.add(i if same < len(end.lstrip(OUTER)) else body[n + 1])
        part = tokens[1:] if skip_first else tokens
        if end is not None and part:
            part = part[:-1]
        if speller.misread(part):
            misread.add(i)
    first = _first(lines[body[0]]) if body else None
    cut_ = _cut_end(lines[body[-1]]) if body else None
    return joined, sorted(misread), first, (body[-1], cut_) if cut_ is not None else None


def prepare(ocr: DataFrame, papers: DataFrame, small: int = 100_000) -> DataFrame:
    """Pages with text, each once, with the title, venue and authors of their
    paper: (paper_id, page_number, scanned, text, lines), ``lines`` being the
    features of each line as a number.  ``scanned`` is status ``completed``; native pages stay because
    words run on into them.  Pages without a paper id or number, or whose text
    is null or blank, are left out.  Papers are sent to all tasks only if there
    are at most ``small`` of them."""
    pages = ocr.where("paper_id is not null and page_number is not null and trim(text) <> '' and status in ('completed', 'not_needed')")
    pages = pages.select("paper_id", "page_number", (F.col("status") == "completed").alias("scanned"), "text", "confidence").dropDuplicates(["paper_id", "page_number"])
    info = papers.where("paper_id is not null").select("paper_id", "title", "venue", "authors").dropDuplicates(["paper_id"])
    if info.limit(small + 1).count() <= small:
        info = F.broadcast(info)

    def run(batches):
        for batch in batches:
            col = [batch.column(n).to_pylist() for n in ("text", "title", "venue", "authors", "confidence")]
            codes = [[_code(f) for f in line_features(text.split("\n"), _running(title, venue, tuple(authors or ())), sureness(sure))] for text, title, venue, authors, sure in zip(*col)]
            left = batch.select(["paper_id", "page_number", "scanned", "text"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(codes, pa.list_(pa.int32()))], ["paper_id", "page_number", "scanned", "text", "lines"])

    joined = pages.join(info, "paper_id", "left").select("paper_id", "page_number", "scanned", "text", "title", "venue", "authors", "confidence")
    return joined.mapInArrow(run, "paper_id string, page_number int, scanned boolean, text string, lines array<int>")


def _codes(column: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(column.flatten(), dtype=np.int32)
    return np.split(flat, np.cumsum(np.asarray(column.value_lengths()))[:-1]) if len(column) else []


def _sum(counts: DataFrame) -> Counter:
    return Counter({(r[0], r[1], r[2]): r[3] for r in counts.groupBy("what", "key", "state").agg(F.sum("n")).collect()})


def _rows(n: Counter) -> pa.RecordBatch:
    what, key, state = zip(*n) if n else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(key, pa.int32()), pa.array(state, pa.int32()), pa.array(n.values(), pa.int64())], ["what", "key", "state", "n"])


COUNTS = "what string, key int, state int, n long"


def learn(pages: DataFrame, repaired: DataFrame, rounds: int = 2, small: int = 500, trust: int = 1500) -> Model:
    """The model from all pages with repaired text, refined in ``rounds`` of
    Viterbi training on all scanned pages.  These count together as ``trust``
    pages at most: labels the model gave itself must not outweigh known ones as
    the table grows.  Repaired pages are sent to all tasks only if there are at
    most ``small`` of them."""
    gold = repaired.where("repaired_text is not null").select("paper_id", "page_number", "repaired_text").dropDuplicates(["paper_id", "page_number"])
    if gold.limit(small + 1).count() <= small:
        gold = F.broadcast(gold)

    def known(batches):
        for batch in batches:
            labels = [known_labels(t.split("\n"), r) for t, r in zip(batch.column("text").to_pylist(), batch.column("repaired_text").to_pylist())]
            yield _rows(tally(_codes(batch.column("lines")), labels))

    sure = _sum(pages.join(gold, ["paper_id", "page_number"]).select("text", "lines", "repaired_text").mapInArrow(known, COUNTS))
    if not sure:
        # without any known page: a page number is a number at an end, all else body
        lines, text = "Title of it\n\nbody text goes on here.\nand here it\n12".split("\n"), "body text goes on here.\nand here it"
        sure = tally([np.array([_code(f) for f in line_features(lines, _running("Title of it", None, ()))])], [known_labels(lines, text)])
    model = fit(sure)
    for _ in range(rounds):
        shared = pages.sparkSession.sparkContext.broadcast(model)

        def more(batches, shared=shared):
            for batch in batches:
                codes = _codes(batch.column("lines"))
                yield _rows(tally(codes, shared.value.label(codes)))

        found = _sum(pages.where("scanned").select("lines").mapInArrow(more, COUNTS))
        share = min(1.0, trust / max(1, sum(n for (what, _, _), n in found.items() if what == "start")))
        model = fit(sure + Counter({x: n * share for x, n in found.items()}))
    return model


READ = "paper_id string, page_number int, scanned boolean, labels string, joined array<int>, misread array<int>, first string, last_line int, last_cut string, body array<string>"
MORE = "array<struct<word:string,n:bigint>>"


def read_pages(pages: DataFrame, model: Model, counts: dict[str, int], tail: DataFrame | None = None, with_body: bool = False) -> DataFrame:
    """What :func:`read_page` finds of every page; labels as one letter a line
    (H, N, B, and _ for a break), line numbers from 0; body lines on request,
    then with the counts of rare words (``more``) too."""
    shared = pages.sparkSession.sparkContext.broadcast((model, counts))

    def ask(batches):
        model, counts = shared.value
        for batch in batches:
            labels = model.label(_codes(batch.column("lines")))
            forms = [[f for f in asked_words(t.split("\n"), s.tolist()) if f and f.lower() not in counts] for t, s in zip(batch.column("text").to_pylist(), labels)]
            left = batch.select(["paper_id", "page_number"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(forms, pa.list_(pa.string()))], ["paper_id", "page_number", "form"])

    if tail is None:
        pages = pages.withColumn("more", F.lit(None).cast(MORE))
    else:
        asked = pages.where("scanned").select("paper_id", "page_number", "text", "lines").mapInArrow(ask, "paper_id string, page_number int, form array<string>")
        pages = pages.join(rare_counts(asked.withColumn("form", F.explode("form")), tail, counts), ["paper_id", "page_number"], "left")

    def run(batches):
        model, counts = shared.value
        speller = Speller(dict(counts))
        for batch in batches:
            out = []
            states = model.label(_codes(batch.column("lines")))
            for scanned, text, labels, more in zip(batch.column("scanned").to_pylist(), batch.column("text").to_pylist(), states, batch.column("more").to_pylist()):
                lines, labels = text.split("\n"), labels.tolist()
                speller.add(more)
                joined, misread, first, last = read_page(lines, labels, speller, scanned)
                body = None
                if with_body:
                    body = [("" if s == BREAK else x.strip()) for x, s in zip(lines, labels) if s in (BODY, BREAK)]
                out.append(("".join("HNB_"[s] for s in labels), joined, misread, first, last and last[0], last and last[1], body))
            cols = list(zip(*out)) if out else [[] for _ in range(7)]
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            left = batch.select(["paper_id", "page_number", "scanned"])
            more = batch.column("more") if with_body else pa.nulls(batch.num_rows, batch.column("more").type)
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)], more], ["paper_id", "page_number", "scanned", "labels", "joined", "misread", "first", "last_line", "last_cut", "body", "more"])

    return pages.select("paper_id", "page_number", "scanned", "text", "lines", "more").mapInArrow(run, f"{READ}, more {MORE}")


def across_pages(read: DataFrame, counts: dict[str, int], tail: DataFrame | None = None) -> DataFrame:
    """(paper_id, page_number, scanned, last_line, last_cut, next_first, more):
    cut ends of pages whose word goes on at the start of the next page."""
    ends = read.where("last_cut is not null").select("paper_id", "page_number", "scanned", "last_line", "last_cut")
    starts = read.where("first is not null").select("paper_id", (F.col("page_number") - 1).alias("page_number"), F.col("first").alias("next_first"))
    shared = read.sparkSession.sparkContext.broadcast(counts)

    def ask(batches):
        for batch in batches:
            forms = [[f for f in pair_words(a, b) if f and f.lower() not in shared.value] for a, b in zip(batch.column("last_cut").to_pylist(), batch.column("next_first").to_pylist())]
            left = batch.select(["paper_id", "page_number"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(forms, pa.list_(pa.string()))], ["paper_id", "page_number", "form"])

    def run(batches):
        speller = Speller(dict(shared.value))
        for batch in batches:
            keep = []
            for a, b, more in zip(*[batch.column(n).to_pylist() for n in ("last_cut", "next_first", "more")]):
                speller.add(more)
                keep.append(speller.joins(a, b))
            yield batch.filter(pa.array(keep, pa.bool_()))

    joined = ends.join(starts, ["paper_id", "page_number"]).select("paper_id", "page_number", "scanned", "last_line", "last_cut", "next_first")
    if tail is None:
        joined = joined.withColumn("more", F.lit(None).cast(MORE))
    else:
        asked = joined.mapInArrow(ask, "paper_id string, page_number int, form array<string>").withColumn("form", F.explode("form"))
        joined = joined.join(rare_counts(asked, tail, counts), ["paper_id", "page_number"], "left")
    return joined.mapInArrow(run, joined.schema)


def scan_noise(ocr: DataFrame, papers: DataFrame, repaired: DataFrame, bound: int = 200_000) -> DataFrame:
    """(paper_id, page_number, line_no, kind) of every scanned page: ``hyphen``,
    ``misread``, ``header``, ``page_number``; lines count from 1, blank ones
    too.  A repeated page counts once.  ``bound`` words are sent to all tasks."""
    pages = cut(prepare(ocr, papers), "scan-pages")
    counts, tail = lexicon(pages, bound=bound)
    model = learn(pages, repaired)
    read = cut(read_pages(pages, model, counts, tail).drop("body", "more"), "scan-read")
    scanned = read.where("scanned")
    label = scanned.select("paper_id", "page_number", F.posexplode(F.split("labels", "")).alias("at", "s")).where("s in ('H', 'N')").select("paper_id", "page_number", (F.col("at") + 1).alias("line_no"), F.when(F.col("s") == "H", "header").otherwise("page_number").alias("kind"))
    of = lambda column, kind: scanned.select("paper_id", "page_number", F.explode(column).alias("at")).select("paper_id", "page_number", (F.col("at") + 1).alias("line_no"), F.lit(kind).alias("kind"))
    over = across_pages(read, counts, tail).where("scanned").select("paper_id", "page_number", (F.col("last_line") + 1).alias("line_no"), F.lit("hyphen").alias("kind"))
    return label.unionByName(of("joined", "hyphen")).unionByName(of("misread", "misread")).unionByName(over)


def paragraphs(body: list[str], counts: Speller, skip_first: bool, tail: str | None) -> str:
    """Body lines ("" for a break) as paragraphs separated by an empty line, with
    cut words joined and misread words put right.  ``skip_first`` leaves out the
    first word, which the page before has taken; ``tail`` is what the next page
    gives to the last word."""
    out, words, carry = [], [], None
    lines = [x for x in body]
    last = max((i for i, x in enumerate(lines) if x), default=-1)
    right = lambda t: _mend(t, counts)
    for i, line in enumerate(lines):
        tokens = line.split()
        if skip_first and tokens:
            tokens, skip_first = tokens[1:], False
        if not line:
            if words and carry is None:
                out.append(" ".join(words))
                words = []
            continue
        if carry is not None and tokens:
            words.append(right(carry + tokens[0]))
            tokens, carry = tokens[1:], None
        end = _cut_end(line)
        nxt = next((x for x in lines[i + 1 :] if x), None)
        if end is not None and tokens and ((nxt is not None and counts.joins(end, _first(nxt))) or (i == last and tail)):
            words += [right(t) for t in tokens[:-1]]
            carry = tokens[-1].rstrip(HYPHENS)
            if i == last and tail:
                words.append(right(carry + tail))
                carry = None
        elif end is not None and tokens and nxt is not None and counts.known(end + "-" + _first(nxt)):
            words += [right(t) for t in tokens[:-1]]
            carry = tokens[-1]
        else:
            words += [right(t) for t in tokens]
    if carry is not None:
        words.append(carry)
    if words:
        out.append(" ".join(words))
    return "\n\n".join(out)


def _mend(token: str, counts: Speller) -> str:
    core = token.strip(OUTER)
    if not core:
        return token
    fixed = counts.fix(core)
    if not fixed:
        return token
    if core[0].isupper() or not core[0].isalpha() and token[:1].isupper():
        fixed = fixed[0].upper() + fixed[1:]
    return token.replace(core, fixed, 1)


def repair(ocr: DataFrame, papers: DataFrame, repaired: DataFrame, bound: int = 200_000) -> DataFrame:
    """(paper_id, page_number, repaired_text) of every scanned page.
    ``bound`` words are sent to all tasks."""
    pages = cut(prepare(ocr, papers), "scan-pages")
    counts, tail = lexicon(pages, bound=bound)
    model = learn(pages, repaired)
    read = cut(read_pages(pages, model, counts, tail, with_body=True), "scan-read")
    over = across_pages(read, counts, tail)
    gives = over.select("paper_id", "page_number", F.col("next_first").alias("tail"), F.col("more").alias("over"))
    takes = over.select("paper_id", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("skip_first"))
    shared = read.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        speller = Speller(dict(shared.value))
        for batch in batches:
            text = []
            for b, s, t, more, over in zip(*[batch.column(n).to_pylist() for n in ("body", "skip_first", "tail", "more", "over")]):
                speller.add((more or []) + (over or []))
                text.append(paragraphs(b or [], speller, bool(s), t))
            left = batch.select(["paper_id", "page_number"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(text, pa.string())], ["paper_id", "page_number", "repaired_text"])

    rows = read.where("scanned").select("paper_id", "page_number", "body", "more").join(gives, ["paper_id", "page_number"], "left").join(takes, ["paper_id", "page_number"], "left")
    return rows.mapInArrow(run, "paper_id string, page_number int, repaired_text string")
