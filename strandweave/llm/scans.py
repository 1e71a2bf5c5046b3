"""Problem 2: text from scanned pages, told apart and repaired into readable paragraphs.

Method: noisy-channel correction. The channel is a table of characters that scanners
confuse, all with one probability; the source is a character model (four signs of
context) counted over the whole corpus. Where every run of signs around a place is rare,
the line is decoded by Viterbi over what may have stood there; the decoding that differs
from the reading by more than the evidence margin is a misread character. Layout marks
are lines: a page number by itself, a running header (a short line that comes back on
other pages of its file, or stands beside a page number), a word or sentence broken over
lines.

Kept as they are: headings, tables, list items on their own lines, blank lines between
paragraphs, names nobody has seen before, codes that mix letters and digits.

Defined cases
    null or empty text -> no marks, repaired as it is
    null file          -> headers are found by their shape alone
    repeated rows      -> each is restored; keys are taken once where they are asked for
    very long text     -> processed whole
    empty table        -> empty result
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# What a scanner reads, what stood there. Several ways to read one sign are told by the source model.
LATIN_READ = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("O", "0"), ("5", "s"), ("9", "g"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"),
    ("m", "rn"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("I", "l"), ("l", "I"), ("8", "B"), ("0", "O"), ("1", "I"), ("5", "S"), ("6", "b"),
)
THAI_READ = (
    ("3", "ง"), ("1", "า"), ("ธ", "ร"), ("๊", "้"), ("'", "่"), ("บ", "น"), ("น", "บ"), ("ส", "ล"), ("ล", "ส"), ("ป", "บ"), ("บ", "ป"), ("ช", "ข"), ("ข", "ช"), ("ซ", "ช"), ("ช", "ซ"),
    ("ห", "ท"), ("ท", "ห"), ("ฟ", "พ"), ("พ", "ฟ"), ("ต", "ด"), ("ด", "ต"), ("ด", "ค"), ("ค", "ด"), ("ภ", "ถ"), ("ถ", "ภ"), ("ก", "ถ"), ("ฝ", "ผ"), ("ผ", "ฝ"), ("ร", "ธ"), ("ี", "ิ"), ("ิ", "ี"),
    ("ื", "ึ"), ("ึ", "ื"), ("้", "่"), ("่", "้"), ("0", "๐"), ("o", "๐"), ("ฃ", "ข"), ("ฅ", "ค"), ("ม", "น"), ("น", "ม"), ("ย", "ข"), ("อ", "ฮ"), ("๋", "้"), ("5", "ร"), ("s", "ร"), ("ำ", "า"), ("ๆ", "า"),
)
READ: dict[str, list[tuple[str, str]]] = {}
for _x, _y in LATIN_READ + THAI_READ:
    READ.setdefault(_x[0], []).append((_x, _y))
WORDS = "abcdefghijklmnopqrstuvwxyz"
#: Log probability of a confusion, and by how much a decoding must beat the reading.
SLIP, MARGIN = math.log(0.002), 3.0
FOUR, FIVE = 1 << 21, 1 << 22
_ALL = (1 << 64) - 1
#: Cells of the source model: its size is fixed, whatever the corpus holds.
CELLS = FOUR + FIVE
#: Signs around a place are rare up to this share of the corpus, and at least this count.
RARE, RARE_LEAST = 1.5e-6, 3
#: A stretch of more rare signs than this may be another language: what is put right there must become common.
LONG = 40
HYPHENS = "-‐‑¬­"
DIGIT = "0-9๐-๙OolI"

_page = re.compile(rf"[\s\[(—–-]*(?:(?:pag[ec]|p|s|seite|p[áa]gina|pág|หน้า(?:ที่)?)\.?\s*)?[{DIGIT}]{{1,4}}(?:\s*(?:/|of|von|de|sur|จาก)\s*[{DIGIT}]{{1,4}})?[\s\])—–-]*", re.I)
_beside = re.compile(r"(?:[0-9๐-๙]{1,4}\s{3,}(\S.*)|(\S.*?)\s{3,}[0-9๐-๙]{1,4})")
_kept = re.compile(r"\s*(?:#|\||[-•*–]\s|\(?[0-9๐-๙]{1,3}[.)]\s)")
_end = re.compile(r"[.!?:;…]['\"”’»)]*$")
_number_in_word = re.compile(r"(?<![\w-])(?=\w*[a-zà-ÿ]{2})[^\W\d_]+[0159]+[^\W\d_]+(?![\w-])|(?<![\w/-])[^\W\d_]{4,}[0159](?![\w/-])|(?<![\w/-])[0159][a-zà-ÿ]{4,}(?![\w/-])|(?<![\w-])[A-Z]{3,}[015][A-Z]+(?![\w-])")


def flat(text: str) -> str:
    """A text with its line breaks undone, for counting and scoring."""
    text = re.sub(rf"[{HYPHENS}]\r?\n\s*", "", text)
    text = re.sub(r"(?<=[ก-๛])\r?\n(?=[ก-๛])", "", text)
    return "   " + re.sub(r"\s+", " ", text).lower() + "   "


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hash4(c: np.ndarray) -> np.ndarray:
    h = c[:-3] * np.uint64(0x9E3779B97F4A7C15) + c[1:-2]
    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:-1]
    return h * np.uint64(0x165667B19E3779F9) + c[3:]


def _cells(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the runs of four and of five signs."""
    h4 = _hash4(c)
    h5 = h4[:-1] * np.uint64(0x27D4EB2F165667C5) + c[4:]
    spread = np.uint64(0xBF58476D1CE4E5B9)
    return (((h4 ^ (h4 >> np.uint64(32))) * spread) >> np.uint64(43)).astype(np.int64), (((h5 ^ (h5 >> np.uint64(32))) * spread) >> np.uint64(42)).astype(np.int64) + FOUR


def _cell_of(run: str) -> tuple[int, int]:
    """The same for a single run of five."""
    a, b, c, d, e = map(ord, run)
    h4 = (((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F + c) * 0x165667B19E3779F9 + d) & _ALL
    h5 = (h4 * 0x27D4EB2F165667C5 + e) & _ALL
    return (((h4 ^ (h4 >> 32)) * 0xBF58476D1CE4E5B9) & _ALL) >> 43, ((((h5 ^ (h5 >> 32)) * 0xBF58476D1CE4E5B9) & _ALL) >> 42) + FOUR


def run_counts(df: DataFrame, text: str) -> DataFrame:
    """(cell, n): how often every hashed run of four and five signs occurs in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = [flat(t) for t in batch["_t"] if t]
            for at in range(0, len(texts), 2000):
                codes = _codes("".join(texts[at : at + 2000]))
                if len(codes) > 5:
                    four, five = _cells(codes)
                    total[:FOUR] += np.bincount(four, minlength=FOUR)
                    total[FOUR:] += np.bincount(five - FOUR, minlength=FIVE)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    return df.select(F.col(text).alias("_t")).mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Source:
    """The source model: how likely a sign is after the four before it, and how rare a run is."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, float(counts[FOUR:].sum())
        self.rare, self.noise = max(RARE_LEAST, RARE * self.total), 1e-7 * self.total
        self._logs: dict[str, float] = {}

    @staticmethod
    def of(cells: pd.DataFrame) -> Source:
        counts = np.zeros(CELLS, np.float32)
        counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return Source(counts)

    def __reduce__(self):
        at = np.flatnonzero(self.counts)
        return Source._again, (at.astype(np.int32), self.counts[at])

    @staticmethod
    def _again(at: np.ndarray, n: np.ndarray) -> Source:
        counts = np.zeros(CELLS, np.float32)
        counts[at] = n
        return Source(counts)

    def log(self, run: str) -> float:
        """Log probability of the last of five signs after the first four."""
        got = self._logs.get(run)
        if got is None:
            four, five = _cell_of(run)
            got = math.log((float(self.counts[five]) + 0.02 + self.noise) / (float(self.counts[four]) + 1.0 + 50 * self.noise))
            if len(self._logs) > 400_000:
                self._logs.clear()
            self._logs[run] = got
        return got

    def rare_places(self, lines: list[str]) -> list[list[int]]:
        """Per flat line (four spaces on both sides) the places around which every run of five is rare."""
        out: list[list[int]] = [[] for _ in lines]
        if not lines:
            return out
        starts = np.cumsum([0] + [len(x) for x in lines])
        n = self.counts[_cells(_codes("".join(lines)))[1]]
        most = n[4:].copy()
        for k in range(4):
            np.maximum(most, n[k : len(n) - 4 + k], out=most)
        places = np.flatnonzero(most <= self.rare) + 4
        of = np.searchsorted(starts, places, side="right") - 1
        within = places - starts[of]
        inside = (within >= 4) & (within < starts[of + 1] - starts[of] - 4)
        for i, x in zip(of[inside].tolist(), within[inside].tolist(), strict=True):
            out[i].append(x)
        return out

    def decode(self, left: str, part: str, right: str, margin: float = MARGIN) -> tuple[str, float]:
        """The likeliest original of ``part`` between its neighbours, and its gain over the reading."""
        states: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(part) + 1)]
        states[0][left[-4:]] = (0.0, "")
        plain, ctx = 0.0, left[-4:]
        for c in part:
            plain += self.log(ctx + c)
            ctx = ctx[1:] + c
        for c in right[:4]:
            plain += self.log(ctx + c)
            ctx = ctx[1:] + c
        end, floor, log = len(part), plain + margin, self.log
        for i in range(end):
            best = states[i].items()
            if len(best) > 6:
                best = sorted(best, key=lambda x: -x[1][0])[:6]
            ways = [(part[i], part[i]), *[w for w in READ.get(part[i], ()) if len(w[0]) == 1 or part.startswith(w[0], i)]]
            for ctx, (score, out) in best:
                if score <= floor:
                    continue  # whatever follows, it can no longer beat the reading
                for read, true in ways:
                    s, c, to = (score + SLIP if read != true else score), ctx, i + len(read)
                    if to > end or s <= floor:
                        continue
                    for sign in true:
                        s += log(c + sign)
                        c = c[1:] + sign
                    at = states[to]
                    if c not in at or at[c][0] < s:
                        at[c] = (s, out + true)
        top, text = -1e18, part
        for ctx, (score, out) in states[len(part)].items():
            c = ctx
            for sign in right[:4]:
                score += self.log(c + sign)
                c = c[1:] + sign
            if score > top:
                top, text = score, out
        return text, top - plain

    def _still_rare(self, left: str, part: str, text: str, right: str) -> bool:
        """Whether the first or the last sign that was put right still has only rare runs around it."""
        short = min(len(part), len(text))
        head = next((i for i in range(short) if part[i] != text[i]), short)
        tail = next((i for i in range(short - head) if part[-1 - i] != text[-1 - i]), short - head)
        rare = set(self.rare_places([left + text + right])[0])
        return len(left) + head in rare or len(left) + len(text) - 1 - tail in rare

    def misread(self, s: str, places: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, original) of what was read wrongly around the rare places of a flat line."""
        out, k = [], 0
        while k < len(places):
            a = b = places[k]
            while k + 1 < len(places) and places[k + 1] - b <= 3:
                k += 1
                b = places[k]
            k += 1
            long = b - a > LONG
            a, b = max(4, a - 2), min(len(s) - 4, b + 3)
            part = s[a:b]
            text, gain = self.decode(s[a - 4 : a], part, s[b : b + 4])
            if text != part and gain > MARGIN and not (long and self._still_rare(s[a - 4 : a], part, text, s[b : b + 4])):
                out.append((a, b, text))
        return out

    def without_digits(self, line: str) -> tuple[str, bool]:
        """The line with words that hold a digit decoded, and whether in any the letter it may stand for is likelier."""
        out, at = [], 0
        for m in _number_in_word.finditer(line):
            word, low = m.group(), m.group().lower()
            if len(low) != len(word):
                continue
            around = "    " + line.lower() + "    "
            text, gain = self.decode(around[m.start() : m.start() + 4], low, around[m.end() + 4 : m.end() + 8], 0.0)
            if text != low and gain > 0:
                out += [line[at : m.start()], _in_case(word, low, text)]
                at = m.end()
        return "".join(out) + line[at:], at > 0

    def joined(self, before: str, after: str) -> bool:
        """Whether two ends belong to one run of signs: every run of five across the joint is common."""
        s = before[-4:] + after[:4]
        if len(s) < 8:
            return False
        return bool((self.counts[_cells(_codes(s))[1]] > self.rare).all())


def line_key(line: str) -> str:
    """What a running header has in common on all pages: its letters, with confusable ones made equal."""
    m = _beside.fullmatch(line.strip())
    t = (m[1] or m[2]) if m else line
    t = t.lower().replace("vv", "w").replace("rn", "m").translate(str.maketrans("10|5!9", "loislg"))
    t = re.sub(r"[^a-zà-ÿก-๛]", "", t).translate(str.maketrans("licefhtbsg", "iiccthtbsg")).replace("ri", "n").replace("ii", "u").replace("ci", "d")
    t = t.translate(str.maketrans("ธ๊บสปชหฟตดภฝซ", "ร้นลนขทพคคถผข"))
    return re.sub("[็-๎]", "", t)


def header_lines(text: str | None) -> list[str]:
    """Keys of the lines of a page that may be running headers."""
    if not text:
        return []
    lines = [x.strip() for x in re.split(r"\r?\n", text)]
    return sorted({k for x in lines if 4 < len(x) < 120 and not _kept.match(x) and not _page.fullmatch(x) and len(k := line_key(x)) > 4})


def file_headers(pages: DataFrame, page: str, file: str, text: str) -> DataFrame:
    """(page, headers): keys of lines that come back on another page of the same file. Counted map-side first; a hot file is many small groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, f, k) for p, f, t in zip(batch[page], batch[file], batch[text], strict=True) for k in header_lines(t)]
            yield pd.DataFrame(rows, columns=[page, file, "line"])

    kinds = dict(pages.dtypes)
    lines = pages.select(page, file, text).filter(F.col(file).isNotNull()).mapInPandas(run, f"`{page}` {kinds[page]}, `{file}` {kinds[file]}, line string").distinct()
    lines = cut(lines, "scan-lines")
    again = lines.groupBy(file, "line").agg(F.count("*").alias("n")).filter("n > 1").select(file, "line")
    return lines.join(again, [file, "line"]).groupBy(page).agg(F.collect_set("line").alias("headers"))


def _is_header(line: str, n: int, lines: list[str], known: set[str]) -> bool:
    t = line.strip()
    if not 4 < len(t) < 120 or _kept.match(t):
        return False
    if known and line_key(t) in known:
        return True
    if _beside.fullmatch(t) and not _end.search(t):
        return True
    letters = re.sub(r"[\W\d_]", "", t)
    if len(letters) > 8 and letters.isupper() and not re.search("[ก-๛]", letters) and any(x != line and re.search("[a-zà-ÿ]{4}", x) for x in lines):
        return True
    if re.search(r"[\d→|/=:]", t) or _end.search(t) or t[-1] in ",-" or not t[0].isalpha():
        return False
    alone = n > 0 and n + 1 < len(lines) and not lines[n - 1].strip() and not lines[n + 1].strip()
    if not alone:
        return False
    if re.search("[ก-๛]", t):
        return len(t) <= 45 and t.count(" ") == 1
    return len(t) <= 80 and t[0].isupper() and 3 <= len(t.split()) <= 9


def layout(text: str | None, known: set[str], source: Source) -> tuple[set[str], list[str]]:
    """The marks of the page a text bears, and its lines without them."""
    if not text:
        return set(), [] if text is None else [text]
    if "\n" not in text:
        return set(), [text]
    found: set[str] = set()
    lines, kept = re.split(r"\r?\n", text), []
    gone = False
    for n, line in enumerate(lines):
        if len(line) < 40 and line.strip() and _page.fullmatch(line) and any(c.isdigit() for c in line) and len(lines) > 1:
            found.add("page number")
            gone = True
        elif len(line) < 130 and line.strip() and _is_header(line, n, lines, known) and len(lines) > 1:
            found.add("header")
            gone = True
        else:
            kept.append((line.rstrip(), gone))
            gone = False
    out: list[str] = []
    blank = cutout = False
    for line, after_mark in kept:
        cutout = cutout or after_mark
        if not line.strip():
            blank = True
            continue
        last = out[-1] if out else ""
        glue = None
        if last and not _kept.match(line) and not re.match(r"\s*#", last):
            thai = "ก" <= line[0] <= "๛" and "ก" <= last[-1:] <= "๛"
            if not blank or cutout:
                if last and last[-1] in HYPHENS and len(last) > 1 and last[-2].isalpha() and line[:1].isalpha() and (line[:1].islower() or last[-1] in "¬­"):
                    glue = last[:-1]
                elif re.search(r"[^\W\d_,][,)\]]?$|,$", last[-2:]) and line[:1].islower() and not thai:
                    glue = last + " "
                elif thai and (source.joined(last[-4:].lower(), line[:4].lower()) or re.match("[ะ-ฺๅ็-๎]", line)):
                    glue = last
        if glue is not None and not _kept.match(last + " "):
            if not blank:
                found.add("break")
            out[-1] = glue + line
        elif glue is not None:
            if not blank:
                found.add("break")
            out[-1] = glue + line
        elif blank and out:
            out += ["", line]
        elif "break" in found and out and not _kept.match(line) and not re.match(r"\s*#", last) and not _end.search(last[-8:]) and last and len(last) < 120:
            out[-1] = last + ("" if "ก" <= line[0] <= "๛" and "ก" <= last[-1] <= "๛" else " ") + line
        else:
            out.append(line)
        blank = cutout = False
    return found, out


def marks(texts: list[str | None], known: list[set[str]], source: Source) -> list[tuple[set[str], str | None]]:
    """Of every text the marks of scanning it bears, and the text without them."""
    laid = [layout(t, k, source) for t, k in zip(texts, known, strict=True)]
    flat_lines = ["    " + line + "    " for _, lines in laid for line in lines]
    low_lines = [low if len(low := s.lower()) == len(s) else s for s in flat_lines]
    places, n, out = source.rare_places(low_lines), 0, []
    for text, (found, lines) in zip(texts, laid, strict=True):
        fixed = []
        for line in lines:
            if places[n] and (wrong := source.misread(low_lines[n], places[n])):
                found.add("misread")
                s, low, at, parts = flat_lines[n], low_lines[n], 0, []
                for a, b, original in wrong:
                    if a >= at:
                        parts += [s[at:a], _in_case(s[a:b], low[a:b], original)]
                        at = b
                line = ("".join(parts) + s[at:]).strip(" ")
            if places[n] and _number_in_word.search(line):
                line, wrong = source.without_digits(line)
                if wrong:
                    found.add("misread")
            fixed.append(line)
            n += 1
        out.append((found, None if text is None else "\n".join(fixed)))
    return out


def _in_case(read: str, low: str, true: str) -> str:
    """The original in the case of what was read."""
    if read == low:
        return true
    if read.upper() == read:
        return true.upper()
    k = next((i for i, (x, y) in enumerate(zip(low, true, strict=False)) if x != y), len(true))
    return read[:k] + true[k:] if len(true) != len(low) else "".join(t.upper() if r.isupper() else t for r, t in zip(read, true, strict=True))


def restore(pages: DataFrame, others: DataFrame, table: str, key: str, text: str, headers: DataFrame, header_key: str) -> DataFrame:
    """(table, key, marks, restored): every record of both tables with the marks it bears and its text without them.

    ``headers`` belong to pages only, so only pages are joined with them; the other texts
    are worked on where they are read. The source model is counted over all texts and has
    a fixed size. A row given twice comes out twice.
    """
    own = [F.col(table), F.col(key), F.col(text).alias("_t")]
    pages, others = pages.select(*own), others.select(*own)
    source = Source.of(run_counts(pages.unionByName(others), "_t").toPandas())
    kinds = dict(pages.dtypes)
    schema = f"`{table}` {kinds[table]}, `{key}` {kinds[key]}, marks array<string>, restored string"
    known = headers.select(F.col(header_key).alias(key), "headers")
    both = pages.join(known, key, "left").select(table, key, "_t", "headers").unionByName(others.withColumn("headers", F.lit(None).cast("array<string>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = marks(batch["_t"].tolist(), [set(h) if h is not None else set() for h in batch["headers"]], source)
            yield pd.DataFrame({table: batch[table], key: batch[key], "marks": [sorted(m) for m, _ in got], "restored": [t for _, t in got]})

    return both.mapInPandas(run, schema)
