"""Text of scanned pages into continuous, readable paragraphs.

Lines of a page are taken as one stream and decoded jointly: a lattice holds, for every token, its reading as it
stands, readings with wrongly recognised characters put right, its segmentations into words that ran together (each word
with slips of its own), and the union with one or two tokens after it (across a hyphen, a line end or stray spaces), again
with slips. The cheapest path under a unigram model of clean text decides all of them at once; what it did to each line
is its report. Running headers, footers and page numbers are set apart first. Paragraph boundaries are chosen by
dynamic programming over line ends.

The word model is counted over all clean text. Up to LEXICON words it is broadcast whole; beyond that every text is given
just the counts that reading it can ask for, by joins with the counts, so readings are the same at every size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.session import cut

#: Words up to which the model is broadcast (about 30 MB); a larger one is joined by the words that the texts ask for.
LEXICON = 400_000
#: What a recogniser writes, and what may stand there.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("@", "a"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("†", "t"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("€", "e"),
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("í", "i"), ("ì", "i"), ("cl", "d"), ("d", "cl"),
    ("tl", "tl"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("nn", "m"), ("iii", "m"), ("0", "d"), ("q", "g"), ("g", "q"), ("f", "t"), ("o", "a"), ("a", "o"), ("fi", "ﬁ"), ("b", "h"), ("h", "b"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"),
)
#: Letters read for digits in numbers.
DIGITS = str.maketrans({"o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "s": "5", "S": "5", "B": "8", "b": "6", "g": "9", "q": "9", "Z": "2", "z": "2", "†": "7"})
MARKS = "-‐‑¬\xad"
SOFT = "¬\xad"
ODD = "0123456789@!†|$€"

UNKNOWN, PER_CHAR, PER_SLIP, RUN_ON, STRAY_SPACE, KEPT_MARK = 17.0, 0.4, 3.5, 7.0, 8.0, 4.0
_EDGE = "\"'“”‘’.,;:?()[]{}<>…*"
_SHAPE = re.compile(r"[a-z]+|[A-Z]|[^\W\d_a-zA-Z]+|\d")


def shape(token: str) -> str:
    """Letters and digits by class: B29 is A99, 12th is 99a."""
    return _SHAPE.sub(lambda m: "9" if m.group().isdigit() else "A" if m.group().isupper() else "a", token)


def clean_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_counts(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(word, n) over all rows: tokens in lower case without punctuation at their edges; tokens with digits as shapes after '#'."""
    rows = None
    for df, text in parts:
        x = df.select(F.explode(clean_tokens(F.col(text))).alias("t"))
        rows = x if rows is None else rows.union(x)
    raw = rows.groupBy("t").agg(F.count("*").alias("n"))
    core = F.regexp_replace("t", r"^[\p{P}\p{S}&&[^$]]+|[\p{P}\p{S}&&[^%]]+$", "")
    raw = raw.select(core.alias("t"), "n").where("t <> ''")
    digits = F.translate(F.regexp_replace(F.regexp_replace("t", r"[a-z]+", "a"), r"[A-Z]", "A"), "0123456789", "9999999999")
    word = F.when(F.col("t").rlike(r"\d"), F.concat(F.lit("#"), digits)).otherwise(F.lower("t"))
    return raw.groupBy(word.alias("word")).agg(F.sum("n").alias("n"))


@dataclass
class WordModel:
    """Counts of all words, their sum and greatest length; packed holds them all if they are few enough to broadcast."""

    counts: DataFrame
    total: int
    longest: int
    packed: Broadcast | None


def word_model(counts: DataFrame, most: int = LEXICON) -> WordModel:
    n, total, longest = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
    packed = None
    if n <= most:
        packed = counts.sparkSession.sparkContext.broadcast("\n".join(f"{r[0]}\t{r[1]}" for r in counts.collect()))
    return WordModel(counts, total, longest, packed)


class Model:
    """What a worker knows of the words: all of them packed, or those of one text with total and longest of all.

    asked collects the words that were looked up and are not known here; a shallow model looks up tokens as they stand only.
    """

    def __init__(self, words: str | dict[str, int], total: int | None = None, longest: int | None = None, asked: set[str] | None = None, shallow: bool = False) -> None:
        self.n = words if isinstance(words, dict) else {w: int(c) for w, c in (x.split("\t") for x in words.split("\n") if x)}
        self.total = (sum(self.n.values()) if total is None else total) or 1
        self.longest = max(map(len, self.n), default=0) if longest is None else longest
        self.asked, self.shallow = asked, shallow
        self.memory: dict[str, list[Reading]] = {}
        self.parts: dict[str, Reading | None] = {}
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        for a, b in CONFUSIONS:
            if a != b:
                self.by_first.setdefault(a[0], []).append((a, b))

    def cost(self, word: str) -> float | None:
        n = self.n.get(word)
        if n is None:
            if self.asked is not None:
                self.asked.add(word)
            return None
        return math.log(self.total / n) + 1

    def known(self, core: str) -> float | None:
        """Cost of a token without its edges, if clean text has it."""
        low = core.lower()
        c = self.cost(low)
        if c is None and any(ch.isdigit() for ch in core):
            c = self.cost("#" + shape(core))
            if c is None and not any(ch.isalpha() for ch in core):
                c = 12.0
        if c is None and low.endswith(("'s", "’s")):
            c = self.cost(low[:-2])
        if c is None and "-" in low:
            parts = [self.cost(p) for p in low.split("-")]
            c = None if any(p is None for p in parts) else sum(parts) + KEPT_MARK
        return c

    def corrected(self, core: str, most: int = 2) -> tuple[float, str, tuple[int, ...]] | None:
        """The cheapest known reading with up to `most` confusions put right: (cost, reading, places in core)."""
        best = None
        if any(c.isdigit() for c in core):
            keep = re.match(r"[A-Z]{1,2}(?=[\dlIoO])", core)
            head = keep.end() if keep else 0
            fixed = core[:head] + core[head:].translate(DIGITS)
            if fixed != core and any(c.isdigit() for c in fixed):
                c = self.known(fixed)
                if c is not None and not any(ch.islower() for ch in fixed):
                    best = (c + 1.0, fixed, tuple(i for i, (x, y) in enumerate(zip(core, fixed, strict=True)) if x != y))
        low = core.lower()
        spots = [(i, a, b) for i, ch in enumerate(low) for a, b in self.by_first.get(ch, ()) if low.startswith(a, i)]
        must = [i for i, ch in enumerate(low) if ch in ODD or ch in "ﬁﬂ"]
        if max(map(len, low.split("-"))) > self.longest + 2 + 2 * most:
            spots = []  # no known word is as long, whatever is put right
        for k in range(1, most + 1):
            for some in combinations(spots, k):
                if must and not all(any(i <= m < i + len(a) for i, a, _ in some) for m in must):
                    continue
                if k == 2 and some[0][0] + len(some[0][1]) > some[1][0]:
                    continue
                word = low
                for i, a, b in reversed(some):
                    word = word[:i] + b + word[i + len(a) :]
                c = self.known(word)
                if c is not None and not any(ch.isdigit() for ch in word):
                    c += PER_SLIP * k - (2.5 * len(must) if must else 0)
                    if best is None or c < best[0]:
                        best = (c, word, tuple(i for i, _, _ in some))
            if best:
                break
        if best is None and len(must) > 2:
            word = low
            for a, b in (("0", "o"), ("1", "l"), ("!", "i"), ("@", "a"), ("5", "s"), ("9", "g"), ("6", "b"), ("†", "t"), ("ﬁ", "fi")):
                word = word.replace(a, b)
            c = self.known(word)
            if c is not None:
                best = (c + PER_SLIP, word, tuple(must))
        return best

    def part(self, core: str) -> Reading | None:
        """A word within a run of words: known, frequent enough not to be met by chance, with one slip at most."""
        if core not in self.parts:
            if len(self.parts) > 400_000:
                self.parts.clear()
            low, got = core.lower(), None
            c = self.cost(low)
            if c is not None and self.n[low] > 20:
                got = Reading(c, core, ())
            elif c is None and len(core) > 3 and any(ch in ODD for ch in core):
                fix = self.corrected(core, 1)
                if fix and self.n.get(fix[1], 0) > 20:
                    got = Reading(fix[0], _like(core, fix[1]), fix[2])
            self.parts[core] = got
        return self.parts[core]

    def segmented(self, core: str) -> Reading | None:
        """The cheapest cut of a token into two or more words, by dynamic programming over its characters.

        Where words are collected, every part is looked up, also behind one that is not known here: clean text may have it.
        """
        n, every = len(core), self.asked is not None
        if n > 4 * self.longest + 8:
            return None
        best: list[tuple[float, int, Reading | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * n
        for j in range(3, n + 1):
            for i in (0, *range(3, j - 2)):
                if j - i <= self.longest + 2 and (every or best[i][0] < math.inf) and (i or j < n) and (j == n or n - j > 2):
                    r = self.part(core[i:j])
                    if r is not None and best[i][0] + r.cost + RUN_ON * (i > 0) < best[j][0]:
                        best[j] = (best[i][0] + r.cost + RUN_ON * (i > 0), i, r)
        if best[n][0] == math.inf:
            return None
        words, slips, j = [], [], n
        while j:
            _, i, r = best[j]
            words.append(r.text)
            slips += [i + k for k in r.slips]
            j = i
        return Reading(best[n][0], " ".join(words[::-1]), tuple(sorted(slips)))

    def readings(self, core: str) -> list[Reading]:
        """Readings of one token, cheapest first."""
        got = self.memory.get(core)
        if got is None:
            got = self._readings(core)
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[core] = got
        return got

    def _readings(self, core: str) -> list[Reading]:
        c = self.known(core)
        if self.shallow or c is not None and not any(ch in "†@ﬁﬂ" for ch in core):
            return [Reading(0.0 if c is None else c, core, ())]
        letters = sum(ch.isalpha() for ch in core)
        plain = UNKNOWN + PER_CHAR * len(core)
        out = [Reading(plain, core, ())]
        fix = self.corrected(core) if letters or any(ch in ODD for ch in core) else None
        if fix:
            out.append(Reading(fix[0], _like(core, fix[1]), fix[2]))
        else:
            # no known reading: characters that no word holds are wrong all the same
            inner = tuple(i for i, ch in enumerate(core) if ch in "†@ﬁﬂ" or ch in "!|€" and 0 < i < len(core) - 1 or ch.isdigit() and letters >= 4 and i and (core[i - 1].islower() or core[i + 1 : i + 2].islower()))
            if inner and letters > len(inner):
                word = core
                for a, b in (("†", "t"), ("@", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("!", "i"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("|", "l")):
                    word = word.replace(a, b)
                out.append(Reading(plain - 1, word, inner))
        if len(core) >= 6 and not fix and core.replace("-", "").isalnum() and letters > len(core) // 2:
            apart = self.segmented(core)
            if apart:
                out.append(apart)
        return sorted(out, key=lambda r: r.cost)


@dataclass(frozen=True)
class Reading:
    cost: float
    text: str
    slips: tuple[int, ...]


def _like(core: str, word: str) -> str:
    """word in the case of core."""
    if core.isupper() and len(core) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if core[:1].isupper() else word


_EDGES = re.compile(rf"^([{re.escape(_EDGE)}]*)(.*?)([{re.escape(_EDGE)}%]*)$", re.S)


def _edges(token: str) -> tuple[str, str, str]:
    m = _EDGES.match(token)
    return m.group(1), m.group(2), m.group(3)


@dataclass
class Page:
    """What was done to a page: kinds of each line, and its paragraphs."""

    kinds: list[set[str]] = field(default_factory=list)
    paragraphs: list[str] = field(default_factory=list)


_NUMBER = r"[\dlIoO|S]{1,4}"
_FOOT = re.compile(rf"^\W*(?:[Pp]\S{{0,4}}\.?\s*)?{_NUMBER}\s*(?:(?:/|\b\S?[fF]\b|\b\S{{2}}\b)\s*{_NUMBER})?\W*$")
_HEAD_NUMBER = re.compile(rf"^\s*{_NUMBER}(?:\s{{2,}}|\s*\|\s*)|(?:\s{{2,}}|\s*\|\s*)(?:[Pp]\S{{0,4}}\.?\s*)?{_NUMBER}\s*(?:p\.?|pp\.?)?\s*$|\s*\|\s*\S{{1,4}}\s+\S{{1,4}}\s*$")


def is_page_number(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 24 and any(c.isdigit() or c in "lIoO" for c in s) and bool(_FOOT.match(s)) and not re.search(r"\d\.$|[$%]", s) and not re.fullmatch(r"[a-zA-Z]+\W*", s)


def furniture(lines: list[str]) -> set[int]:
    """Numbers of the lines that are a running header, footer or page number; only the outermost written lines can be."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    out: set[int] = set()
    if not at:
        return out
    if len(at) > 1 and is_page_number(lines[at[-1]]):
        out.add(at[-1])
    rest = [i for i in at if i not in out]
    if rest and len(at) > 1 and is_page_number(lines[rest[0]]):
        out.add(rest.pop(0))
    if len(rest) > 1:
        head, after = lines[rest[0]], lines[rest[1]]
        core = _HEAD_NUMBER.sub("", head).strip()
        ws = core.split()
        width = max(len(lines[i].rstrip()) for i in rest[1:])
        fits = len(core) + 4 + len(after.split()[0]) <= width  # lines with a mark at their end run over by a few characters
        titled = len(ws) > 1 and all(w[:1].isupper() or w[:1].isdigit() for w in ws)
        numbered = core != head.strip()
        broken = core[-1:] in MARKS
        if ws and len(ws) <= 8 and core[-1] not in ".,;:" and not broken and not re.search(r"\d{3}", core) and (numbered or len(ws) <= 6 and (titled or core.isupper() or (fits and len(core) < 0.85 * width) or rest[1] - rest[0] > 1)):
            out.add(rest[0])
        foot = lines[rest[-1]]
        if len(rest) > 2 and rest[-1] - rest[-2] > 1 and len(foot.split()) <= 8 and foot.strip()[-1] not in ".,;:?!" and lines[rest[-2]].strip()[-1:] in ".?!":
            out.add(rest[-1])
    return out


def decode(text: str, model: Model) -> Page:
    """Read one page."""
    lines = text.split("\n")
    page = Page([set() for _ in lines])
    out_of_body = furniture(lines)
    for i in out_of_body:
        page.kinds[i].add("furniture")
    tokens: list[tuple[str, int]] = []
    last_of: dict[int, int] = {}
    for i, line in enumerate(lines):
        if i not in out_of_body:
            for t in line.split():
                last_of[i] = len(tokens)
                tokens.append((t, i))
    n = len(tokens)
    split = [_edges(t) for t, _ in tokens]
    #: best[k]: cost of the first k tokens, with the step that led there: (tokens taken, text, [(line, kind)])
    best: list[tuple[float, int, str, list[tuple[int, str]]]] = [(0.0, 0, "", [])] + [(math.inf, 0, "", [])] * n
    for k in range(n):
        base = best[k][0]
        (token, line), (a, core, z) = tokens[k], split[k]
        if core:
            r = model.readings(core)[0]
            step = [(line, "misread")] if r.slips else []
            cost, shown = base + r.cost, a + r.text + z
        else:
            step, cost, shown = [], base + 1.0, token
        if cost < best[k + 1][0]:
            best[k + 1] = (cost, 1, shown, step)
        if k + 1 == n:
            if token[-1] in MARKS and len(core) > 1 and not core[:-1].isdigit() and model.cost(core[:-1].lower()) is None:
                best[k + 1] = (best[k + 1][0], 1, shown, [*step, (line, "hyphen")])
            continue
        (_, line2), (a2, core2, z2) = tokens[k + 1], split[k + 1]
        end_of_line = line2 != line
        if end_of_line and token[-1] in MARKS and len(core) > 1 and core2 and not a2:
            left = core[:-1] if core[-1] in MARKS else core
            soft = token[-1] in SOFT
            if any(c.isalpha() for c in left) or soft:
                joined = left + core2
                r = model.readings(joined)[0]
                steps = [(line, "hyphen")]  # slips in the parts of a broken word are mended, but only whole words are reported
                cost = base + r.cost + (0.0 if soft else 0.5)
                if left[-1:].isdigit() or core2[0].isdigit():
                    cost += 15
                if cost < best[k + 2][0]:
                    best[k + 2] = (cost, 2, a + r.text + z2, steps)
            if not soft:
                ra, rb = model.readings(left)[0], model.readings(core2)[0]
                whole = model.cost(f"{left}-{core2}".lower())
                cost = base + (whole + 0.5 if whole is not None else ra.cost + rb.cost + KEPT_MARK)
                if cost < best[k + 2][0]:
                    best[k + 2] = (cost, 2, f"{a}{ra.text}-{rb.text}{z2}", [])
        elif token[-1] not in MARKS and not z and not a2 and core and core2 and model.known(core) is None and model.known(core2) is None:
            # stray spaces: the union of two or three tokens, none of which is a word
            joined, took, shut = core, 1, ""
            while took < 3 and k + took < n and tokens[k + took][1] == line and not shut:
                head, more, shut = split[k + took]
                if head or not more or model.known(more) is not None or min(len(joined), len(more)) > 6:
                    break
                joined, took = joined + more, took + 1
                c = model.cost(joined.lower()) if joined.isalpha() else None
                fix = model.corrected(joined, 1) if c is None and any(ch in ODD for ch in joined) else None
                cost, shown = (c, joined) if c is not None else (fix[0], _like(joined, fix[1])) if fix else (math.inf, "")
                if base + cost + STRAY_SPACE * (took - 1) < best[k + took][0]:
                    best[k + took] = (base + cost + STRAY_SPACE * (took - 1), took, a + shown + shut, [])
    words: list[tuple[str, int]] = []
    k = n
    while k:
        _, took, shown, steps = best[k]
        for line, kind in steps:
            page.kinds[line].add(kind)
        words.append((shown, tokens[k - 1][1]))
        k -= took
    words.reverse()
    page.paragraphs = paragraphs(words, lines, out_of_body)
    return page


def paragraphs(words: list[tuple[str, int]], lines: list[str], out_of_body: set[int]) -> list[str]:
    """Paragraph boundaries by dynamic programming over line ends.

    Evidence for a boundary: a blank line, a line that ends early although the next word had room, an end of sentence,
    a capital or an indent after it. Evidence against it and paragraphs of a single line cost.
    """
    rows: list[list[str]] = []
    of: list[int] = []
    for w, i in words:
        if not of or of[-1] != i:
            of.append(i)
            rows.append([])
        rows[-1].append(w)
    n = len(of)
    if not n:
        return []
    width = max(len(lines[i].rstrip()) for i in of)
    gain = []
    for k in range(n - 1):
        here, after = lines[of[k]].rstrip(), lines[of[k + 1]]
        g = -4.0
        g += 5.0 if any(not lines[j].strip() for j in range(of[k] + 1, of[k + 1])) else 0.0
        g += 3.0 if here[-1:] in ".?!:" else -4.0
        g += 3.0 if len(here) + 1 + len(after.split()[0]) <= 0.9 * width else 0.0
        g += 0.5 if after.lstrip()[:1].isupper() else -3.0
        g += 2.0 if after[:2] in ("  ", "\t") else 0.0
        gain.append(g)
    best, cut_at = [0.0] + [-math.inf] * n, [0] * (n + 1)
    far, at = -math.inf, 0  # the best start two lines or more before e, and its place
    for e in range(1, n + 1):
        if e > 1:
            v = best[e - 2] + (gain[e - 3] if e > 2 else 0.0)
            if v > far:
                far, at = v, e - 2
        alone = best[e - 1] + (gain[e - 2] if e > 1 else 0.0) - 0.7
        best[e], cut_at[e] = (alone, e - 1) if alone > far else (far, at)
    out, e = [], n
    while e:
        out.append(" ".join(w for r in rows[cut_at[e] : e] for w in r))
        e = cut_at[e]
    return out[::-1]


_MODELS: dict[int, Model] = {}


def _worker_model(packed: Broadcast) -> Model:
    key = hash(packed.value)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(packed.value)
    return _MODELS[key]


def _whole(t: str) -> list[str]:
    return [t]


def _by_page(t: str, page_mark: str = "\f") -> list[str]:
    return [p.strip("\n") for p in t.split(page_mark)]


def _asked(df: DataFrame, text: str, model: WordModel, pieces: Callable[[str], list[str]], shallow: bool) -> DataFrame:
    """(__row, word, n) of the words that reading each text asks for and its __words do not hold, as far as clean text has them."""
    total, longest = model.total, model.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = Model(dict(known or ()), total, longest, set(), shallow)
                for p in pieces(t):
                    decode(p, m)
                if m.asked:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(m.asked), pa.int64()), pa.array(sorted(m.asked))], names=["__row", "word"])

    return df.select("__row", text, "__words").mapInArrow(run, "__row bigint, word string").join(model.counts, "word").select("__row", "word", "n")


def _with_words(df: DataFrame, text: str, scanned: Column, model: WordModel, pieces: Callable[[str], list[str]]) -> DataFrame:
    """df with __words, the counts that reading each text can ask for.

    Tokens as they stand are looked up first; with those known, the rest that a reading may ask for is recorded and looked
    up. An unknown word only opens further readings, and cuts of a token look up all its parts when recorded, so what is
    recorded is never too little.
    """
    rows = cut(df.withColumn("__scan", F.coalesce(scanned, F.lit(False))).withColumn("__row", F.monotonically_increasing_id()))
    kind = "map<string,bigint>"
    scans = rows.where("__scan").where(F.length(text) > 0).select("__row", text).withColumn("__words", F.lit(None).cast(kind))
    as_map = F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("__words")
    first = cut(_asked(scans, text, model, pieces, True))
    second = _asked(scans.drop("__words").join(first.groupBy("__row").agg(as_map), "__row", "left"), text, model, pieces, False)
    words = first.union(second).groupBy("__row").agg(as_map)
    return rows.join(words, "__row", "left").drop("__row")


def _reader(model: WordModel) -> Callable[[list | None], Model]:
    """Words of a text (null where the model is broadcast) to the model that reads it."""
    packed, total, longest = model.packed, model.total, model.longest
    return (lambda words: _worker_model(packed)) if packed is not None else (lambda words: Model(dict(words or ()), total, longest))


def line_reports(pages: DataFrame, model: WordModel, page_id: str, text: str) -> DataFrame:
    """(page_id, line_no, kind) with kind hyphen, furniture or misread; distinct. Null and empty texts report nothing."""
    kind = dict(pages.dtypes)[page_id]
    src = pages.select(page_id, text)
    if model.packed is None:
        src = _with_words(src, text, F.lit(True), model, _whole).select(page_id, text, "__words")
    reader = _reader(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("page_id", b.schema.field(0).type), ("line_no", pa.int32()), ("kind", pa.string())])
            words = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            rows = [{"page_id": i, "line_no": k, "kind": x} for i, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), words, strict=True) if t for k, s in enumerate(decode(t, reader(w)).kinds) for x in s]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return src.mapInArrow(run, f"page_id {kind}, line_no int, kind string").distinct()


def repaired(pages: DataFrame, model: WordModel, text: str, scanned: Column, page_mark: str = "\f") -> DataFrame:
    """pages with `repaired_text`: paragraphs of running text, a blank line between them.

    Rows for which `scanned` is not true keep their text; null texts stay null, empty ones empty. A text of several pages, with
    `page_mark` between them, is read page by page, and a paragraph that a page end interrupts is continued. All columns
    pass through; one named repaired_text is refused. Rows keep their number, repeats included.
    """
    if "repaired_text" in pages.columns:
        raise ValueError("the table has a column repaired_text already")
    keep = [c for c in pages.columns]
    at = keep.index(text)
    pieces = lambda t: _by_page(t, page_mark)
    src = pages.withColumn("__scan", F.coalesce(scanned, F.lit(False)))
    if model.packed is None:
        src = _with_words(pages, text, scanned, model, pieces).select(*keep, "__scan", "__words")
    schema = T.StructType([*pages.schema.fields, T.StructField("repaired_text", T.StringType())])
    reader = _reader(model)

    def mend(t: str, m: Model) -> str:
        out: list[str] = []
        for p in pieces(t):
            paras = decode(p, m).paragraphs
            if out and paras and out[-1][-1:] not in ".?!:" and paras[0][:1].islower():
                out[-1] += " " + paras.pop(0)
            out += paras
        return "\n\n".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(len(keep) + 1).to_pylist() if b.num_columns > len(keep) + 1 else [None] * b.num_rows
            new = [mend(t, reader(w)) if s and t else t for t, s, w in zip(b.column(at).to_pylist(), b.column(len(keep)).to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(new, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def clean_model(pages: DataFrame, records: DataFrame, most: int = LEXICON) -> WordModel:
    """The word model of all digital pages and of all records that are no scans."""
    digital = pages.where(F.col("extraction_method").isin("native", "pdf_text")).where("content_text is not null").dropDuplicates(["id"])
    unscanned = records.where("not coalesce(ocr_applied, false) and content_text is not null")
    return word_model(cut(word_counts([(digital, "content_text"), (unscanned, "content_text")])), most)
