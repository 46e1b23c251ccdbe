"""Personal information in free text, found by a semi-Markov conditional random field.

A text is searched for anchors (an at sign or its spellings, long numbers, words of streets, words
that ordinary text doesn't have). Around each a window of tokens is cut out and divided into
segments: single tokens that are nothing, or spans of an e-mail address, phone number, identity
number, street address or person. Every span that the classes of its tokens allow for a kind is a
candidate, bounded in length, and is scored as a whole (its shape, its word classes, what stands on
either side) together with the move from the kind found before it in the window to its own; the
best division of the window is found by dynamic programming over segments and the kind last found,
which chooses limits and kinds together. Weights are learned by pii_train.py as a CRF, by the
likelihood of the right division against all others, and kept in pii_model.json.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.splitter import current_marks
from ledgerloom.operators.current import current_texts
from ledgerloom.session import spread

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
MODEL = Path(__file__).with_name("pii_model.json")
MARGIN = 70

# Forms of address, and given names that are among the most common of many countries.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "monsieur", "madame", "sir"}
GIVEN = set(
    """
    ahmed aisha akira alexander ali alice amelia amina ana andrea andreas andrew angela anna anne anthony antonio anya arthur barbara
    ben benjamin bernd brian carlos carmen carol caroline catherine charles charlotte chen chloe chris christian christine claire claudia
    daniel david deborah diana diego dmitri donald dorothy edward elena elizabeth ella emily emma eric erik eva fatima felix fernando
    francesca francisco frank françois gabriel george giovanni giulia grace hans hannah haruto helen helga henry hiroshi hugo ibrahim ines
    ingrid isabel ivan jack jacques jakob james jan jane javier jean jennifer jessica jing joan johannes john jonas jose joseph juan julia
    julie karen karl kate kenji kevin khalid klaus laura lea leila leo leon li linda lisa louis lucas lucia luis lukas manuel marco margaret
    maria marie mark marta martin mary matteo matthew max maya mehmet mei michael michelle miguel mohammed monika nadia nancy natalia nicole
    nina noah nora oliver olga olivia omar pablo patricia patrick paul pedro peter petra philip pierre priya rachel rafael raj rebecca
    richard robert rosa ruth samuel sandra sara sarah simon sofia sophie stefan stephen susan thomas tim tom victoria wei william yuki yusuf zoe
    """.split()
)
STREETS = set("street st road rd avenue ave lane ln blvd boulevard drive court close terrace crescent quay rue calle avenida plaza via allee chemin ruelle impasse quai paseo viale piazza".split())
#: Ordinary words that are streets only where they are written large.
STREETS_LARGE = set("way place square row walk parkway route platz weg ring damm ufer markt corso camino".split())
STREET_ENDS = ("weg", "straße", "strasse", "str", "gasse", "platz", "allee", "ufer", "damm", "ring")
LINKS = {"de", "du", "des", "del", "la", "le", "les", "am", "im", "an", "der", "dem", "alten", "bis", "in", "zum", "zur", "van", "von"}

TOKEN = re.compile(r"\d+|[^\W\d_]+(?:['’][^\W\d_]+)*|\n|[^\s]|_")
AT = r"(?:@|＠|%40|\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+)"
DOT = r"(?:\.|．|\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+)"
AT_SIGNS = re.compile(r"@|＠|%40|[(\[]\s*at\s*[)\]]|\bat\s+[\w-]+\s*(?:[(\[]\s*dot\s*[)\]]|\bdot\b)", re.I)
NUMBER = re.compile(r"\d[\d ().\-/]{3,}\d")
NAMELIKE = re.compile(r"[A-ZÀ-ÖØ-ÞŁŚŽČ]?[a-zß-öø-ÿłśžčąęńżźćőűşğı]+(?:['’-][A-ZÀ-Þ]?[a-zß-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{2,}(?:[-'’][A-ZÀ-Þ]+)*")
#: A capitalised word, ordinary or not, behind a title or an initial.
CAPITALISED = re.compile(r" [A-ZÀ-Þ][a-zß-ÿ]+(?![\w/@])")
DIGIT = re.compile(r"\d")
#: What a number may be made of besides digits and capital letters, and its bounds in digits and in words.
NUMBER_SIGNS = set("+()-./‐‑–")
MOST_DIGITS, MOST_PARTS = 22, 9
#: A number the North American plan allows: neither area nor exchange begins with 0 or 1.
NANP = re.compile(r"1?[2-9]\d\d[2-9]\d{6}")
#: What joins the parts of an e-mail address.
MAIL_SIGNS = set("._+-'%")
KIND_NUMBER = {kind: k + 1 for k, kind in enumerate(KINDS)}
EDGES = ".,;:!?\"'()[]{}<>|=*`#…。、-"


class Model:
    """Weights by feature, and the ordinary words."""

    def __init__(self, weights: dict[str, float], common: set[str]):
        self.weights, self.common = weights, common
        self.seen: dict[str, tuple] = {}
        self.classes: dict[str, str] = {}
        self.learn_moves()

    def learn_moves(self) -> None:
        """[kind last found in the window, 0 for none][kind] -> weight of going from one to the other."""
        names = ("none", *KINDS)
        self.moves = [[0.0, *[self.weights.get(f"move:{a}>{b}", 0.0) for b in KINDS]] for a in names]
        self.most_moved = max(max(row) for row in self.moves)

    def marks_in(self, token: str) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
        """Of a blank-separated token the pieces that may be part of a name, those that are words of streets, and whether it is a title or an initial; remembered by token."""
        got = self.seen.get(token)
        if got is None:
            names, streets = [], []
            for piece in [token.strip(EDGES)] if token.strip(EDGES).isalpha() else re.split(r"[\s;:=\",(){}\[\]<>|]+", token):
                piece = piece.strip(EDGES)
                if (len(piece) > 2 or len(piece) == 2 and piece[0].isupper() and piece[1].islower()) and NAMELIKE.fullmatch(piece) and any(p.lower() not in self.common for p in re.split(r"['’-]", piece)):
                    names.append(piece)
                if piece.isalpha() and (self.class_of(piece) == "S" and piece.lower() not in ("st", "via") or piece in ("Box", "BOX", "St")):
                    streets.append(piece)
            said = token.lstrip("\"'([{<*")
            got = tuple(names), tuple(streets), len(said) == 2 and said[1] == "." and said[0].isupper() or said.rstrip(".").lower() in TITLES and said[:1].isupper()
            if len(self.seen) > 300_000:
                self.seen.clear()
            if len(token) < 100:
                self.seen[token] = got
        return got

    def class_of(self, token: str) -> str:
        """word_class() of a token, remembered."""
        got = self.classes.get(token)
        if got is None:
            got = word_class(token, self)
            if len(self.classes) > 300_000:
                self.classes.clear()
            if len(token) < 40:
                self.classes[token] = got
        return got


@lru_cache(maxsize=2)
def load(path: str = str(MODEL)) -> Model:
    kept = json.loads(Path(path).read_text())
    return Model(kept["weights"], set(kept["common"]))


def anchors(text: str, model: Model) -> list[tuple[int, int]]:
    """Places a window is cut out around."""
    found = []
    if "@" in text or "＠" in text or "%40" in text or " dot " in text or "dot)" in text or "dot]" in text or "at)" in text or "at]" in text:
        found += [m.span() for m in AT_SIGNS.finditer(text)]
    for m in NUMBER.finditer(text):
        run = m.group()
        if sum(map(str.isdigit, run)) >= 6 and not (run.count(".") == 1 and run.replace(".", "").isdigit()):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not before.islower() and not after.islower() and before not in ("_", "/", ".") or after == "x":
                found.append(m.span())
    names, streets, forms = set(), set(), set()
    for word in set(text.split()):
        named, paved, form = model.marks_in(word)
        if named:
            names.update(named)
        if paved:
            streets.update(paved)
        if form:
            forms.add(word)

    def places(piece: str, before: str = "_/.@", after: str = "_/@") -> Iterator[tuple[int, int]]:
        at = text.find(piece)
        while at >= 0:
            end = at + len(piece)
            if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in before)) and (end == len(text) or not (text[end].isalnum() or text[end] in after)):
                yield at, end
            at = text.find(piece, end)

    for name in names:
        found += places(name)
    for piece in streets:  # no address is without a number
        found += [(a, z) for a, z in places(piece) if DIGIT.search(text, max(0, a - MARGIN), min(len(text), z + MARGIN))]
    for piece in forms:
        found += [(a, z) for a, z in places(piece) if CAPITALISED.match(text, z)]
    return sorted(found)


def windows(text: str, model: Model) -> Iterator[tuple[int, int]]:
    """Stretches of text around anchors, joined where they meet, cut at blanks."""
    start = end = -1
    for a, z in anchors(text, model):
        a, z = max(0, a - MARGIN), min(len(text), z + MARGIN)
        if start >= 0 and a <= end:
            end = max(end, z)
            continue
        if start >= 0:
            yield start, end
        start, end = a, z
    if start >= 0:
        yield start, end


def word_class(token: str, model: Model) -> str:
    low = token.lower()
    if token.isdigit():
        return "Z" if len(token) == 5 else "N"
    if not token[0].isalpha():
        return token
    if low in TITLES:
        return "T"
    if low in STREETS or low == "str" or low in STREETS_LARGE and token[0].isupper() or low.endswith(STREET_ENDS) and len(low) > 4 and low not in model.common:
        return "S"
    if low in LINKS:
        return "L"
    kind = "G" if low in GIVEN else "k" if low in model.common else "u"
    if len(token) == 1:
        return "I" if token.isupper() else "i"
    form = "A" if token.isupper() else "C" if token[0].isupper() and token[1:].islower() else "l" if token.islower() else "m"
    return kind + form


def collapse(text: str) -> str:
    """Shape of a span: runs of digits by their length, letters as A or a."""
    return re.sub(r"[^\W\d_]+", lambda m: "A" * min(len(m.group()), 3) if m.group().isupper() else "a", re.sub(r"\d+", lambda m: f"<{len(m.group())}>", text))


class Window:
    """Tokens of a stretch of text and its candidate segments with their features."""

    def __init__(self, text: str, model: Model):
        self.text, self.model = text, model
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.tokens = [text[a:z] for a, z in self.spans]
        self.classes = [model.class_of(t) for t in self.tokens]
        self.beside: dict[int, str] = {}
        self.start_at = {a: k for k, (a, _) in enumerate(self.spans)}
        self.end_at = {z: k + 1 for k, (_, z) in enumerate(self.spans)}
        self.segments: list[tuple[int, int, str, list[str]]] = []
        seen = set()
        for i, j, kind in self.candidates():
            if (i, j, kind) not in seen:
                seen.add((i, j, kind))
                self.segments.append((i, j, kind, self.features(i, j, kind)))

    def candidates(self) -> Iterator[tuple[int, int, str]]:
        tokens, classes, n = self.tokens, self.classes, len(self.tokens)
        yield from self.mail_spans()
        yield from self.number_spans()
        for k in range(n):
            cue = classes[k]
            # a post code between a house number and a town speaks for a street of any name
            code = cue == "Z" and k > 1 and k + 1 < n and classes[k + 1][-1] == "C" and any(classes[i] in ("N", "Z") and classes[i - 1][-1] in "CA" for i in range(max(1, k - 4), k))
            if cue == "S" or code or tokens[k].lower() == "box" and k and tokens[k - 1] in ("O", "o", "."):
                lows = [i for i in range(max(0, k - 9 if code else k - 7), k + 1) if classes[i] in ("N", "Z", "S") or classes[i][-1] in "CAlm" or classes[i] in ("L", "I")]
                for i in lows:
                    if "\n" in tokens[i:k]:
                        continue
                    lines = 0
                    for j in range(k + 1, min(n, k + 18) + 1):
                        last = tokens[j - 1]
                        lines += last == "\n"
                        if lines > 2 or last == "\n" and tokens[j - 2] == "\n":  # an address may go on in the next line
                            break
                        if (classes[j - 1] in ("N", "Z", "S", "I", "i", "L") or classes[j - 1][-1] in "CAlm" or last == ".") and any(c in ("N", "Z") for c in classes[i:j]):
                            yield i, j, "address"
        fits = [self.nameable(k) for k in range(n)]
        inner = [f or t in (".", ",", "-") for f, t in zip(fits, tokens)]
        for k in range(n):
            if not fits[k] or (classes[k][0] not in "uG" or len(classes[k]) != 2) and not self.named(k):
                continue
            first = k  # names have no gap that can't be inside one
            while first > 0 and first > k - 5 and inner[first - 1]:
                first -= 1
            for i in range(first, k + 1):
                if not fits[i]:
                    continue
                for j in range(i + 1, min(n, i + 8) + 1):
                    if not inner[j - 1]:
                        break
                    if j > k and fits[j - 1] and (j - i > 1 or classes[i][-1] != "l"):  # one lower-case word is never a name by itself
                        yield i, j, "person"

    def glued(self, k: int) -> bool:
        """Whether token k follows the one before it without a gap."""
        return k > 0 and self.spans[k - 1][1] == self.spans[k][0]

    def mail_spans(self) -> Iterator[tuple[int, int, str]]:
        """Spans round an at sign, or its spellings, of words, numbers and the signs that join them; they may end after each part of the domain."""
        tokens, n = self.tokens, len(self.tokens)
        part = lambda k: tokens[k][0].isalnum() and tokens[k].isalnum()
        for k in range(1, n - 1):
            low = tokens[k].lower()
            if low in ("@", "＠") and self.glued(k) and self.glued(k + 1):
                a, z, spelled = k, k + 1, False
            elif low == "%" and tokens[k + 1] == "40" and self.glued(k):
                a, z, spelled = k, k + 2, False
            elif low == "at":
                bracket = tokens[k - 1] in "([" and tokens[k + 1] in ")]"
                a, z, spelled = (k - 1, k + 2, False) if bracket else (k, k + 1, True)
            else:
                continue
            if a < 1 or z >= n or not part(z):
                continue
            i = a - 1
            if tokens[i] == "_" or not (part(i) or tokens[i] in MAIL_SIGNS):
                continue
            while i > 0 and self.glued(i) and (tokens[i - 1] in MAIL_SIGNS or part(i - 1)):
                i -= 1
            while i < a - 1 and not part(i):
                i += 1
            if not part(i):
                continue
            j, dotted = z + 1, False
            if not spelled:
                yield i, j, "email"
            while j < n:
                if self.glued(j) and (tokens[j] in "-_" or part(j)) and j + 1 < n:
                    j += 1
                    if not (part(j - 1)):
                        continue
                elif tokens[j] in ".．" and self.glued(j) and j + 1 < n and self.glued(j + 1) and part(j + 1):
                    j += 2
                elif tokens[j].lower() == "dot" and j + 1 < n and part(j + 1):
                    j, dotted = j + 2, True
                elif tokens[j] in "([" and j + 3 < n and tokens[j + 1].lower() == "dot" and tokens[j + 2] in ")]" and part(j + 3):
                    j, dotted = j + 4, True
                else:
                    break
                if dotted or not spelled:
                    yield i, j, "email"

    def number_spans(self) -> Iterator[tuple[int, int, str]]:
        """Spans of whole parts (digits, capitals and the signs between them, single blanks between the parts) for phone and identity numbers."""
        tokens, spans, text, n = self.tokens, self.spans, self.text, len(self.tokens)

        def fits(k: int) -> bool:
            t = tokens[k]
            return t.isdigit() or t in NUMBER_SIGNS or t.isupper() and t.isalpha() and len(t) <= 6 or t in ("x", "ext") and k > 0 and k + 1 < n and tokens[k - 1].isdigit() and (self.glued(k + 1) or t == "ext")

        k = 0
        while k < n:
            if not fits(k):
                k += 1
                continue
            first = k
            while k < n and fits(k) and (k == first or spans[k][0] - spans[k - 1][1] <= 1 and text[spans[k - 1][1] : spans[k][0]] in ("", " ")):
                k += 1
            last = max(k, first + 1)
            k = last
            if sum(len(t) for t in tokens[first:last] if t.isdigit()) < 6:
                continue
            starts, ends = [], []
            for m in range(first, last):
                if m == first or not self.glued(m):
                    s = m
                    while s < last and not (tokens[s].isalnum() or tokens[s] in "+("):
                        s += 1
                    if s < last and not (s and self.glued(s) and (tokens[s - 1][-1].isalnum() or tokens[s - 1] == "_")):
                        starts.append(s)
                if m + 1 == last or not self.glued(m + 1):
                    e = m
                    while e >= first and not tokens[e].isalnum():
                        e -= 1
                    if e >= first and not (e + 1 < n and self.glued(e + 1) and (tokens[e + 1][0].isalnum() and tokens[e + 1] != "x" or tokens[e + 1] == "_")):
                        ends.append(e + 1)
            for i in starts:
                after = bisect_right(ends, i)
                for j in ends[after : after + MOST_PARTS]:
                    inside = tokens[i:j]
                    digits = sum(len(t) for t in inside if t.isdigit())
                    if digits < 5:
                        continue
                    if digits > MOST_DIGITS:
                        break
                    letters = [t for t in inside if t.isalpha()]
                    if 7 <= digits and all(t in ("x", "ext") for t in letters):
                        yield i, j, "phone"
                    if digits >= 6 or letters:
                        yield i, j, "id_number"

    def named(self, k: int) -> bool:
        """Whether an ordinary word stands where a name may: capitalised, after a title, an initial with its stop, or a given name."""
        if not self.capital(k):
            return False
        stop = k > 1 and self.tokens[k - 1] == "."
        before = k - 2 if stop else k - 1
        if before < 0:
            return False
        c = self.classes[before]
        return c == "T" and self.tokens[before][0].isupper() or c == "I" and stop or c == "GC" and not stop

    def capital(self, k: int) -> bool:
        return self.classes[k] == "kC" or self.classes[k] == "S" and self.tokens[k][0].isupper()

    def nameable(self, k: int) -> bool:
        c = self.classes[k]
        return c in ("T", "I", "L") or c == "S" and self.named(k) or len(c) == 2 and c[0] in "uGk" and c[1] in "CAl"

    def around(self, k: int) -> str:
        got = self.beside.get(k)
        if got is None:
            if k < 0 or k >= len(self.tokens):
                got = "<>"
            else:
                token = self.tokens[k]
                low = token.lower()
                got = "#" if token.isdigit() else low if low in self.model.common or not token[0].isalpha() or len(token) < 3 else self.classes[k]
            self.beside[k] = got
        return got

    def features(self, i: int, j: int, kind: str) -> list[str]:
        """What the whole span shows, for the kind it would be."""
        (a, _), (_, z) = self.spans[i], self.spans[j - 1]
        span = self.text[a:z]
        left, left2, right, right2 = self.around(i - 1), self.around(i - 2), self.around(j), self.around(j + 1)
        glued = ("l" if i and self.spans[i - 1][1] == a and self.tokens[i - 1] not in "\n" else "") + ("r" if j < len(self.spans) and self.spans[j][0] == z else "")
        k = kind[:2] + ":"
        out = [k, f"{k}L={left}", f"{k}R={right}", f"{k}L2={left2} {left}", f"{k}R2={right} {right2}", f"{k}LR={left}_{right}", f"{k}glue={glued}"]
        if kind in ("phone", "id_number"):
            shape = collapse(span)
            digits = sum(map(str.isdigit, span))
            out += [f"{k}s={shape}", f"{k}d={digits}", f"{k}parts={span.count(' ')}_{len(re.findall('[A-Z]', span))}", f"{k}h={shape[:3]}", f"{k}sep={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', span))))}", f"{k}t={shape[-4:]}", f"{k}sL={shape}_{left}", f"{k}nanp={bool(NANP.fullmatch(re.sub('[^0-9]', '', span.split('x')[0])))}_{digits}"]
        elif kind == "email":
            local, _, domain = re.split(rf"({AT})", span, maxsplit=1, flags=re.I)[:3]
            parts = re.split(DOT, domain, flags=re.I)
            out += [f"{k}dots={min(len(parts), 4) - 1}", f"{k}tld={'a' if parts[-1].isalpha() else '9'}", f"{k}at={re.search(AT, span, re.I).group().strip()[:1]}", f"{k}local={'git' if local.lower() == 'git' else collapse(local)[:8]}", f"{k}camel={bool(re.search('[a-z][A-Z]', span))}", f"{k}digits={'9' if parts[0].isdigit() else 'a'}", f"{k}next={right if right in ':/' else ''}"]
        elif kind == "address":
            classes = ["C" if c in ("uC", "GC", "kC", "uA", "kA", "GA") else "l" if c in ("ul", "kl", "Gl", "um", "km") else c for c in self.classes[i:j]]
            pattern = re.sub(r"(C )+", "C ", re.sub(r"(l )+", "l ", " ".join(classes) + " "))
            out += [f"{k}p={pattern}", f"{k}first={' '.join(classes[:2])}", f"{k}last={' '.join(classes[-2:])}", f"{k}n={min(j - i, 12)}", f"{k}comma={span.count(',')}", f"{k}lastR={classes[-1]}_{right}_{right2}", f"{k}firstL={classes[0]}_{left}"]
            cue = next((t.lower() for t, c in zip(self.tokens[i:j], self.classes[i:j]) if c == "S"), "box")
            at = next((q for q in range(i, j) if self.classes[q] == "S"), i)
            out += [f"{k}cue={cue if cue in STREETS else 'end'}", f"{k}near={' '.join(self.classes[max(i, at - 2) : at + 3])}", f"{k}cuepos={at - i}_{pattern[:3]}"]
            if at + 1 < len(self.tokens):
                out.append(f"{k}after={self.around(at + 1)}")
        else:
            pattern = " ".join(self.classes[i:j])
            loose = re.sub(r"[uk](?=[CAl])", "w", pattern)
            alone = (left in ("\n", "<>")) and (right in ("\n", "<>"))
            out += [f"{k}p={pattern}", f"{k}w={loose}", f"{k}pL={loose}_{left}", f"{k}pR={loose}_{right}", f"{k}alone={alone}_{loose}", f"{k}n={j - i}", f"{k}know={pattern.count('k')}_{pattern.count('u')}_{pattern.count('G')}", f"{k}pLR={pattern}_{left}_{right}"]
            out.append(f"{k}hyphen={left == '-' or right == '-'}")
            lengths = [len(t) for t, c in zip(self.tokens[i:j], self.classes[i:j]) if len(c) == 2]
            out.append(f"{k}len={min(max(lengths, default=0), 9)}")
        return out

    def score(self, features: list[str]) -> float:
        weights = self.model.weights
        return sum([weights[f] for f in features if f in weights])

    def decode(self) -> list[tuple[int, int, str]]:
        """The best division: (start, end, kind) in characters, left to right.

        A state is a place and the kind last found before it (0: none yet); a token that is nothing keeps it.
        """
        n, moves = len(self.tokens), self.model.moves
        by_end: dict[int, list[tuple[int, int, float]]] = {}
        for i, j, kind, features in self.segments:
            s = self.score(features)
            if s + self.model.most_moved > 0:  # what scores below nothing after any kind is never part of the best division
                by_end.setdefault(j, []).append((i, KIND_NUMBER[kind], s))
        if not by_end:
            return []
        low = float("-inf")
        best = [[0.0] + [low] * len(KINDS)]
        back: list[list] = [[None] * (len(KINDS) + 1)]
        for j in range(1, n + 1):
            row, came = list(best[j - 1]), [None] * (len(KINDS) + 1)
            for i, kind, s in by_end.get(j, ()):
                for before, value in enumerate(best[i]):
                    total = value + s + moves[before][kind]
                    if total > row[kind]:
                        row[kind], came[kind] = total, (i, before)
            best.append(row)
            back.append(came)
        out, j = [], n
        state = max(range(len(KINDS) + 1), key=lambda k: best[n][k])
        while j > 0:
            came = back[j][state]
            if came is None:
                j -= 1
            else:
                out.append((self.spans[came[0]][0], self.spans[j - 1][1], KINDS[state - 1]))
                j, state = came
        return out[::-1]


def find(text: str | None, model: Model | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text; none in a null or empty one."""
    if not text:
        return []
    model = model or load()
    found = []
    for a, z in windows(text, model):
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        for s, e, kind in Window(text[a:z], model).decode():
            if not found or a + s >= found[-1][1]:
                found.append((a + s, a + e, kind))
    return found


def redact(text: str | None, model: Model | None = None) -> str | None:
    """The text with each item replaced by the placeholder of its kind; all else is unchanged."""
    if not text:
        return text
    out, last = [], 0
    for a, z, kind in find(text, model):
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = z
    return "".join([*out, text[last:]])


def session_kinds(sessions: DataFrame, fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(session_id, field, kind): what the fields of each session's current row mention.

    All rows are searched where they lie and those of older versions dropped by their mark, so no
    text is shuffled; exact copies count once. Null and empty fields mention nothing.
    """
    rows = sessions.where(F.col("session_id").isNotNull()).select("session_id", "updated_at", F.xxhash64(*fields).alias("_tie"), *fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for field in fields:
                    kinds = {kind for _, _, kind in find(getattr(row, field), model)}
                    out += [(row.session_id, row.updated_at, row[2], field, kind) for kind in kinds]
            yield pd.DataFrame(out, columns=["session_id", "updated_at", "_tie", "field", "kind"])

    found = spread(rows).mapInPandas(run, f"session_id string, updated_at {dict(sessions.dtypes)['updated_at']}, _tie long, field string, kind string")
    marks = current_marks(sessions, fields).withColumnRenamed("updated_at", "_at").withColumnRenamed("_tie", "_of").withColumnRenamed("session_id", "_id")
    kept = found.join(marks, (found["session_id"] == marks["_id"]) & found["updated_at"].eqNullSafe(marks["_at"]) & (found["_tie"] == marks["_of"]), "left_semi")
    return kept.select("session_id", "field", "kind").distinct()


def redacted_sessions(sessions: DataFrame) -> DataFrame:
    """session_id, text and title of the current rows with placeholders for personal information; null and empty fields stay as they are."""
    rows = spread(current_texts(sessions, ["title"]).select("session_id", "text", "title"), sessions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(text=[redact(t, model) for t in batch["text"]], title=[redact(t, model) for t in batch["title"]])

    return rows.mapInPandas(run, "session_id string, text string, title string")
