"""Sentence units of texts in many languages and scripts, by their places in the text.

A text is cut into segments first, at blank lines, headings and list lines;
breaks of wrapped lines stay inside. In a segment every run of terminators,
every end of a quotation or bracket and, in Thai, every blank is a gap. Where
marks leave a gap of a spaceless script open (three dots, the end of speech),
word lattices segment the clauses beside it, over the words of a dictionary that
``lexicon`` counts in the corpus, and the words next to the gap classify it:
final particles and closing words on the left, opening, resuming and reporting
words on the right. Gaps of spaced scripts get a weight from the terminator, the
token before it and what comes after. A lattice over all gaps of the segment
then takes the best chain of units, in which no unit is without a letter or
digit where that can be avoided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.windows import code_points
from siftstone.llm.lexicon import CLAUSE, EDGE, Lexicon

# ---- fixed values: marks and words

TERMINATORS = ".!?…。！？．｡।॥؟۔"
HARD = "。！？｡।॥؟۔"
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "‹": "›", "“": "”", "„": "“”"}
CLOSERS = frozenset("".join(OPENERS.values()) + "\"")
BRACKETS = frozenset("([{（［【")
#: Opening marks that each mark may close.
PARTNERS = {ch: frozenset(o for o in [*OPENERS, '"'] if ch == o or ch in OPENERS.get(o, "")) for ch in {*OPENERS, *CLOSERS}}
DASHES = "—–―-"
#: Before a name: never the end of a sentence.
TITLES = frozenset("mr mrs ms dr prof capt rev st gen col lt sgt gov sen hon sr sra srta dra dn dña d mme mlle me mgr fr hr ing dipl г-н г-жа проф акад ул डॉ श्री د أ".split())
#: Before a number: not the end of a sentence.
REFERENCES = frozenset(
    "fig figs no nos nr vol sec ch p pp s abb bd kap art pág págs cap núm n° t гл рис стр с табл jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic janv févr avr juil déc mär okt dez approx aprox env ca circa etwa".split()
)
#: Always followed by more of the same sentence.
LINKS = frozenset("cf vs e.g i.e viz vgl z bzw ca approx aprox env ej p.ej ex p.ex al ee eeuu т.е напр см ср d.h u.a o.ä sog inkl zzgl".split())
#: Ends of lists; they end a sentence only where the next one begins.
LISTS = frozenset("etc usw usf и.т.д и.т.п др пр وغيرها इत्यादि आदि".split())
#: Words before a number with a point that make it an ordinal.
ORDINAL_LEADS = frozenset("am das der die den dem des im vom zum zur beim ein eine einen einem einer bis und ab seit dieses diese dieser ihr sein mein jedes jede jeder".split())
#: Reporting words after a quotation.
REPORTS = frozenset(
    "asked said wrote shouted replied cried answered whispered demanda répondit dit écria s'écria écrivit preguntó dijo escribió gritó respondió fragte sagte schrieb rief antwortete спросил спросила сказал сказала ответил ответила написал написала воскликнул قال قالت كتب كتبت صاح أجاب أجابت".split()
)
HINDI_REPORT = re.compile(r"\S+(?:\s\S+)?\sने\s(?:पूछा|कहा|लिखा|बताया|पुकारा|चिल्लाया|जवाब)")
RESUMING = frozenset("या अथवा शायद और लेकिन أو ربما بل لكن و".split())
#: Closed classes of the word lattice for spaceless scripts; all other words come from the corpus.
REPORTING_WORDS = frozenset("写道 问道 说道 喊道 答道 回答 表示 写 问 说 道 喊 答".split())
QUOTATIVES = frozenset("と って という との などと".split())
RESUMING_WORDS = frozenset("也许 或许 或者 可能 或 不 而是 いや あるいは または もしくは むしろ หรือ".split())
FINAL_WORDS = frozenset("た る だ です ます か よ ね い う く す つ ぬ む 了 吗 呢 吧 啊 的".split())
CONTINUING = ",，、،;；:：%&/+=)]}）］】」』»›”"

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_LIST = re.compile(r"[ \t 　]*(?:[-–—*•‣◦·▪●+]|\d{1,3}[.)]|\[\d{1,2}(?::\d{2})+\])[ \t 　]")
_FIELD = re.compile(r"[\W_]*[^\W\d_][\w.]*(?: [\w.]+){0,2}[\W_]{0,3}[:：]\s")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]")
#: A lower-case word that is not of mixed case, such as pH.
_GOES_ON = re.compile(r"[ \t]*(?:[a-zß-öø-ÿа-яё])(?![A-ZÀ-ÞА-Я])")
_RUN = re.compile(f"[{re.escape(TERMINATORS)}]+")
_EVENT = re.compile("[" + re.escape("".join(OPENERS) + "".join(CLOSERS)) + "]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
#: How a file or a site ends.
_EXTENSION = re.compile(r"\.(?:txt|csv|pdf|json|html?|com|org|net|example|xml|zip|md|py|jpg|png)\W*$", re.IGNORECASE)
_TOKEN = re.compile(r"\S*")
#: What an address is known by before its end.
_ADDRESS_START = re.compile(r"@|://|^www\.", re.IGNORECASE)
_WORDS = REPORTING_WORDS | QUOTATIVES | RESUMING_WORDS | FINAL_WORDS
#: Evidence of a final particle before three dots, of a resuming word after them, in the log odds of the corpus.
PARTICLE, RESUMED = 1.0, -2.0
#: A first line of at most this length without a terminator is a heading; wrapped lines are longer.
HEADING_CHARS = 40
NEVER, SURE = -8.0, 8.0
NO_LEXICON = Lexicon()
BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def spaceless(ch: str) -> bool:
    c = ord(ch)
    return 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x0E00 <= c <= 0x0E7F or 0x20000 <= c <= 0x323AF


def lattice_words(chars: str, dictionary: frozenset[str] = _WORDS) -> tuple[str, ...]:
    """Best path through the lattice of dictionary words; a run without any is one unknown word. Long words win over short ones and unknown characters."""
    n, longest = len(chars), max(EDGE, 5)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            known = chars[i:j] in dictionary or chars[i:j] in _WORDS
            cost = 1.0 if known else (1.6 if j == i + 1 else None)
            if cost is not None and best[i][0] + cost < best[j][0]:
                best[j] = (best[i][0] + cost, i)
    cuts, j = [], n
    while j:
        cuts.append((best[j][1], j))
        j = best[j][1]
    words: list[str] = []
    known = True
    for i, j in reversed(cuts):
        word = chars[i:j]
        here = word in dictionary or word in _WORDS
        if not here and not known:
            words[-1] += word
        else:
            words.append(word)
        known = here
    return tuple(words)


def _reported(right: str) -> bool:
    """Whether a quotation's reporter comes next: a quotative, or a short name and a reporting word before a mark."""
    part = re.match(r"[^\W\d_]{1,10}", right)
    if not part:
        return False
    if part[0].startswith(tuple(QUOTATIVES)):
        return True
    words = lattice_words(part[0])
    at, seen = 0, 0
    for word in words:
        seen += len(word)
        if word in REPORTING_WORDS and 0 < at <= 4:
            return right[seen : seen + 1] in ("，", "。", "：", ",", "、", "")
        at += len(word)
    return False


def _evidence(side: int, word: str, lexicon: Lexicon) -> float:
    """Log odds of a word beside three dots; an unknown run is judged by its longest known part at the gap."""
    table = lexicon.tails if side else lexicon.heads
    for k in range(min(len(word), EDGE), 0, -1):
        part = word[-k:] if side else word[:k]
        if part in table:
            return lexicon.odds(side, part)
    return 0.0


def _ellipsis_ends(left: str, right: str, lexicon: Lexicon) -> bool:
    """Three dots between two clauses without blanks: whether the words beside them speak for an end."""
    behind, ahead = lattice_words(left, lexicon.words), lattice_words(right, lexicon.words)
    score = 0.0
    if behind:
        score += _evidence(1, behind[-1], lexicon) + PARTICLE * (behind[-1] in FINAL_WORDS or left[-1:] in FINAL_WORDS)
    if ahead:
        score += _evidence(0, ahead[0], lexicon) + RESUMED * (ahead[0] in RESUMING_WORDS)
    return score > 0


class _Segment:
    """One stretch of text without hard breaks."""

    def __init__(self, text: str, start: int, end: int, cased: bool, lexicon: Lexicon = NO_LEXICON) -> None:
        self.text, self.start, self.end, self.cased, self.lexicon = text, start, end, cased, lexicon
        self.spans = self._spans()
        self.run = (start, start, end)
        self.token = (start, start, -1, False)

    def _spans(self) -> list[tuple[int, int]]:
        """Outermost matched quotations and brackets, both ends included; what has no partner counts as ordinary."""
        stack: list[tuple[str, int]] = []
        held = dict.fromkeys([*OPENERS, '"'], 0)  # of each opening mark, how many are on the stack; so a mark without a partner costs no search
        found: list[tuple[int, int]] = []
        text = self.text
        for m in _EVENT.finditer(text, self.start, self.end):
            ch, at = m[0], m.start()
            match = None
            if any(held[o] for o in PARTNERS[ch]):
                match = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in PARTNERS[ch])
            if ch == '"':
                if match is None:
                    stack.append((ch, at))
                    held[ch] += 1
                    continue
            elif ch in OPENERS and not (ch == "“" and match is not None and stack[match][0] == "„"):
                stack.append((ch, at))
                held[ch] += 1
                continue
            if match is not None:
                found.append((stack[match][1], at))
                for o, _ in stack[match:]:
                    held[o] -= 1
                del stack[match:]
        found.sort()
        outer: list[tuple[int, int]] = []
        for a, b in found:
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
        return outer

    def _skip(self, at: int) -> int:
        while at < self.end and self.text[at].isspace():
            at += 1
        return at

    def _kind(self, at: int) -> str:
        """What begins at a place: end, lower, opening, digit, more (marks that continue) or start (anything a sentence may begin with)."""
        text = self.text
        if at >= self.end:
            return "end"
        ch = text[at]
        if ch in DASHES and at + 1 < self.end:
            nxt = self._skip(at + 1)
            return "lower" if nxt < self.end and self.cased and text[nxt].islower() else "start"
        if ch in CONTINUING:
            return "more"
        if ch.isdigit():
            return "digit"
        if ch.islower():
            word = re.compile(r"\w+").match(text, at)[0]
            return "start" if len(word) > 1 and word[1].isupper() and not word.isupper() and self.cased else "lower"
        return "start"

    def _token(self, at: int, least: int | None = None) -> str:
        """The token that ends at a place and begins at ``least`` or later, without marks at its edges."""
        k, least = at, self.start if least is None else least
        while k > least and not self.text[k - 1].isspace() and at - k < 64:
            k -= 1
        return self.text[k:at].strip("".join(OPENERS) + "".join(CLOSERS) + ",;:'’")

    def _in_address(self, at: int) -> bool:
        """Whether an address begins before a place in its run of characters without blanks or spaceless scripts, however long; each run is read once."""
        if not self.run[0] < at <= self.run[1]:
            text, k, end = self.text, at, at
            while k > self.start and not text[k - 1].isspace() and not spaceless(text[k - 1]):
                k -= 1
            while end < self.end and not text[end].isspace() and not spaceless(text[end]):
                end += 1
            run = text[k:end].lstrip("".join(OPENERS) + "".join(CLOSERS) + ",;:'’")
            found = _ADDRESS_START.search(run)
            self.run = (k, end, end - len(run) + found.start() if found else end)
        return self.run[2] < at

    def _near_address(self, at: int) -> bool:
        """Whether the token around a place (up to blanks) ends as a file or site does, or has the mark of an address at most 64 characters before the place or after it; each token is read once."""
        if not self.token[0] < at <= self.token[1]:
            text, k, end = self.text, at, at
            while k > self.start and not text[k - 1].isspace():
                k -= 1
            end = _TOKEN.match(text, at).end()
            marks = max(text.rfind("@", k, end), text.rfind("://", k, end))
            tail = text[max(k, end - 80) : end].rstrip(".!?,;:")
            self.token = (k, end, marks, bool(_EXTENSION.search(tail)))
        return self.token[3] or self.token[2] >= max(self.token[0], at - 64)

    def _clauses(self, a: int, nxt: int) -> tuple[str, str]:
        """The whole clauses that end and begin at two places; empty where another script stands there."""
        k = a
        while k > self.start and CLAUSE.match(self.text[k - 1]):
            k -= 1
        right = CLAUSE.match(self.text, nxt, self.end)
        return self.text[k:a], right[0] if right else ""

    def _point(self, a: int, b: int, unit: int) -> float:
        """Weight of the end after the terminators a..b."""
        text = self.text
        run, nxt = text[a:b], self._skip(b)
        kind, close = self._kind(nxt), nxt == b
        if kind == "end":
            return SURE
        before, after = text[a - 1] if a > self.start else " ", text[nxt]
        if close and before.isdigit() and after.isdigit():
            return NEVER
        if any(c in HARD for c in run):
            return NEVER if kind == "more" else SURE
        if "…" in run or run.startswith(".."):
            if spaceless(after) and spaceless(before):
                return 3.0 if _ellipsis_ends(*self._clauses(a, nxt), self.lexicon) else NEVER
            if kind in ("lower", "more"):
                return NEVER
            return NEVER if text[nxt : nxt + 12].split(None, 1)[0] in RESUMING else 3.0
        if kind == "more":
            return NEVER
        if close:
            if self._in_address(a) or self._near_address(a):
                return NEVER
        if "!" in run or "?" in run:
            return NEVER if kind == "lower" else 4.0
        return self._full_stop(a, b, nxt, kind, close, unit)

    def _full_stop(self, a: int, b: int, nxt: int, kind: str, close: bool, unit: int) -> float:
        text, token = self.text, self._token(a, unit)
        bare = token.lower().rstrip(".")
        last = bare.rpartition(".")[2]
        if kind == "lower":
            return NEVER
        if close:
            if kind == "digit" or len(token) < 2 and not text[a - 1 : a].isdigit() and token.isalpha():
                return NEVER
            if text[nxt].isupper() and text[nxt + 1 : nxt + 2] in (".", ""):
                return NEVER
        if kind == "digit":
            return NEVER if bare in REFERENCES or bare in LINKS or bare in TITLES or last in REFERENCES else 2.0
        if bare in LISTS or last in LISTS:
            return 3.0
        if bare == "д" or bare == "п":  # и т. д., и т. п.
            return 3.0 if self._token(a - len(token) - 1, unit).lower().rstrip(".") == "т" else NEVER
        if bare == "г":
            return 2.0 if self._token(a - len(token) - 1, unit).isdigit() else NEVER
        if bare in TITLES or bare in LINKS:
            return NEVER
        if len(token) == 1 and token.isalpha() and (token.isupper() or not token.islower()) and not spaceless(token):
            return NEVER  # an initial
        if token.isdigit() and len(token) <= 2 and self.cased:
            lead = self._token(a - len(token) - 1, unit).lower()
            if lead in ORDINAL_LEADS and not (text[nxt] in OPENERS):
                return NEVER
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):  # a.m, p.m, U.S
            return 2.0
        if len(bare) == 1 and bare.isalpha() and bare.islower() and token.islower():
            return 2.0 if bare == "m" else NEVER  # last letter of an abbreviation in parts
        return 4.0

    def _closing(self, a: int, b: int, unit: int) -> float | None:
        """Weight of the end after the quotation or bracket a..b; None when no end can be there."""
        text = self.text
        k = b - 1
        while k > a and (text[k].isspace() or text[k] in CLOSERS):
            k -= 1
        if k <= a or text[k] not in TERMINATORS:
            return None
        nxt = self._skip(b + 1)
        if nxt < self.end and nxt == b + 1 and text[nxt] in TERMINATORS:
            return None
        kind = self._kind(nxt)
        if kind == "end":
            return SURE
        if kind in ("lower", "more"):
            return NEVER
        first = self._skip(unit)
        while first < a and (text[first] in DASHES + "*>#•" or text[first].isspace()):
            first += 1
        initial = first >= a
        if text[a] in BRACKETS:
            return 3.0 if initial else NEVER
        ahead = text[nxt : nxt + 40]
        if spaceless(ahead[0]):
            if ahead.startswith(tuple(QUOTATIVES)):
                return NEVER
            return NEVER if initial and _reported(ahead[:12]) else 3.0
        word = re.match(r"[\w'’]+", ahead)
        if initial and word and (word[0].lower() in REPORTS or HINDI_REPORT.match(ahead)):
            return NEVER
        return 3.0

    def gaps(self) -> list[tuple[int, float]]:
        """(place, weight) of each gap, in order; weights below zero are against an end."""
        out: list[tuple[int, float]] = []
        text, at, unit = self.text, self.start, self.start
        thai = any("฀" <= c <= "๿" for c in text[self.start : self.end])
        starts = {s for s, _ in self.spans}
        spans = iter([*self.spans, (self.end, self.end)])
        a, z = next(spans)
        run, blank, fresh = None, None, True  # each match is kept until it is passed
        while at < self.end:
            if fresh or run and run.start() < at:
                run = _RUN.search(text, at, a)
            if thai and (fresh or blank and blank.start() < at):
                blank = _THAI_GAP.search(text, at, a)
            fresh = False
            if blank and (not run or blank.start() < run.start()):
                left, right = text[blank.start() - 1 : blank.start()], text[blank.end() : blank.end() + 1]
                number = left.isdigit() or right.isdigit()
                if left and right and blank.start() > self.start and blank.end() < self.end:
                    out.append((blank.start(), NEVER if number else 4.0))
                    if not number:
                        unit = blank.end()
                at = blank.end()
                continue
            if run:
                start, end = run.span()
                weight = self._point(start, end, unit)
                while end < a and text[end] in CLOSERS and end not in starts:
                    end += 1
                out.append((end, weight))
                if weight > 0:
                    unit = end
                at = max(end, at + 1)
                continue
            if a >= self.end:
                break
            weight = self._closing(a, z, unit)
            if weight is not None:
                out.append((z + 1, weight))
                if weight > 0:
                    unit = z + 1
            at = z + 1
            a, z = next(spans)
            fresh = True
        return out

    def units(self) -> Iterator[tuple[int, int]]:
        yield from best_units(self.text, self.start, self.end, self.gaps())


def best_units(text: str, start: int, end: int, gaps: list[tuple[int, float]]) -> Iterator[tuple[int, int]]:
    """Best chain through the lattice of gaps.

    A chain gains the weights of the gaps it ends units at; a unit without a
    letter or digit costs more than any gap brings. Units that are not empty of
    such characters may come from any earlier gap, so one running maximum serves.
    """
    nodes = [(start, 0.0)] + [g for g in gaps if start < g[0] < end] + [(end, 0.0)]
    if len(nodes) == 2:
        yield start, end
        return
    score = [0.0] + [float("-inf")] * (len(nodes) - 1)
    source = [0] * len(nodes)
    top = last = 0  # best node before the last letter or digit; last such node
    after: int | None = None  # best node after it
    for j in range(1, len(nodes)):
        filled = any(c.isalnum() for c in text[nodes[j - 1][0] : nodes[j][0]])
        if filled:
            top = max((top, *range(last + 1, j)), key=lambda i: score[i])
            last, after = j - 1, None
            choice, value = top, score[top]
        else:
            choice, value = top, score[top]
            if j - 1 > last and (after is None or score[j - 1] > score[after]):
                after = j - 1
            if after is not None and score[after] - 3 * SURE > value:
                choice, value = after, score[after] - 3 * SURE
        score[j], source[j] = value + nodes[j][1], choice
    cuts, j = [], len(nodes) - 1
    while j:
        cuts.append((nodes[source[j]][0], nodes[j][0]))
        j = source[j]
    yield from reversed(cuts)


def _field_runs(text: str, lines: list[tuple[int, int]]) -> list[bool]:
    """For each line whether it and all that follow to the next blank line are named fields, two or more; one pass from the end."""
    out, n = [False] * len(lines), 0
    for k in range(len(lines) - 1, -1, -1):
        line = text[lines[k][0] : lines[k][1]]
        if not line.strip():
            n = 0
        elif n < 0 or not _FIELD.match(line):
            n = -1
        else:
            n += 1
        out[k] = n > 1
    return out


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between hard breaks: blank lines, headings, list lines and lines of named fields."""
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    fields = _field_runs(text, lines)
    start: int | None = None
    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        if not line.strip():
            if start is not None:
                yield start, lines[k - 1][1]
                start = None
            continue
        first = start is None
        if first:
            start = a
        if k + 1 == len(lines):
            break
        follows = text[lines[k + 1][0] : lines[k + 1][1]]
        ended = line.rstrip().rstrip("".join(CLOSERS)).rstrip()[-1:] in TERMINATORS
        marked = bool(_LIST.match(line))
        hard = (
            bool(_HEADING.match(line))
            or bool(_LIST.match(follows) or _HEADING.match(follows))
            or (marked and first and (len(line) <= HEADING_CHARS or not follows[:1].islower()))
            or (first and not ended and len(line.strip()) <= HEADING_CHARS and not _GOES_ON.match(follows))
            or fields[k]
        )
        if hard and follows.strip():
            yield start, b
            start = None
    if start is not None:
        yield start, len(text)


def _cased(part: str) -> bool:
    """Whether lower-case letters are no fewer than upper-case ones."""
    return sum(map(str.islower, part)) >= sum(map(str.isupper, part))


def sentences(text: str, lexicon: Lexicon = NO_LEXICON) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, without blanks at the edges; together they hold all other characters.

    Case tells something in every segment of a text with case, and in the
    segments with case of a text that is upper-case for the most part.
    """
    cased = _cased(text)
    out = []
    for a, b in segments(text):
        for s, e in _Segment(text, a, b, cased or _cased(text[a:b]), lexicon).units():
            unit = text[s:e]
            if stripped := unit.strip():
                s += len(unit) - len(unit.lstrip())
                out.append((s, s + len(stripped)))
    return out


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon = NO_LEXICON) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence of every row.

    A projection with one Arrow pass, no shuffle; ``lexicon``, of bounded size, is
    broadcast. Null texts and texts of blanks only give no row; repeated rows
    repeat their sentences.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s, e in sentences(text, words):
                    ids.append(i), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id bigint, start_char bigint, end_char bigint")


def coverage(units: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, covered, overlaps, blank_edges) of each document with a sentence: an audit of ``units`` against the texts.

    ``covered`` counts the characters other than blanks inside sentences, each as
    often as sentences hold it. Ids must be unique.
    """
    cut = units.groupBy("doc_id").agg(F.collect_list(F.struct("start_char", "end_char")).alias("at"))  # the sentences of one document
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("struct<covered: bigint, overlaps: bigint, blank_edges: int>")
    def audit(column: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(column, spans):
            places = np.array(sorted((u["start_char"], u["end_char"]) for u in at), dtype=np.int64)
            filled = ~np.isin(code_points(text), BLANKS)
            upto = np.concatenate([[0], np.cumsum(filled)])
            start, end = places[:, 0], places[:, 1]
            before = np.maximum.accumulate(end)[:-1]
            rows.append((int((upto[end] - upto[start]).sum()), int((before > start[1:]).sum()), int((~filled[start] | ~filled[end - 1]).sum())))
        return pd.DataFrame(rows, columns=["covered", "overlaps", "blank_edges"])

    return cut.join(texts, "doc_id").select("doc_id", audit("text", "at").alias("a")).select("doc_id", "a.*")
