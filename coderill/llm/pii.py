"""Problem 8: personal information in free text, by anchor expansion.

One Aho-Corasick automaton finds anchors in the lower-cased text: at-signs and their spelled-out and escaped forms, street words,
digits, cues of persons, and the words of the name lexicon.  Small deterministic parsers then expand each anchor to the left and
right, validate what they find and fix its bounds: an anchor's first digit may be preceded by the letters of a number, a plus sign
or a bracket.  No parser looks at a fixed number of characters: they end with the words, the line or the form that they read.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderill.session import spread

# ---------------------------------------------------------------------------------------------------- fixed values

AT_FORMS = ("@", "＠", "[at]", "(at)", "{at}", "<at>", " at ", " @ ", "&#64;", "&#x40;", "&commat;", "%40", "\\u0040")
SHARED = frozenset(
    """abuse accounting accounts admin administrator alerts all announce api automation billing bot bounce bounces build builds
    buildbot career careers ci community compliance contact cron daemon dev devs devops donotreply feedback finance git github
    gitlab hello help helpdesk hg hostmaster hr info inquiries it jenkins jobs legal list lists mail mailer mailer-daemon marketing
    members news newsletter no-reply no_reply nobody noc noreply notifications notify office ops orders postmaster press privacy
    root sales security service services spam ssh staff status subscribe support svn sysadmin system team updates
    unsubscribe webmaster www""".split()
)
STATED = frozenset("address alias email example first first.last firstname firstname.lastname foo foobar jane.doe john.doe me my.name myname name someone somebody test tester user username you your your.name yourname xxx".split())
PARTICLES = frozenset("van von de del della di da der den dos du la le ter ten".split())
# Given names and surnames that are common words too: alone they need a cue.
AMBIGUOUS = frozenset(
    """ada amber bill brook cedar crystal fern grant hazel heron iris jade jasper julia lily linden mark max may olive pascal
    rich robin rose rowan ruby sable sage vesper will wren anchor gantry marsh""".split()
)
# Capitalised words that stand before or after names and belong to none.
NO_NAME = frozenset(
    """a address adresse after all also an and anschrift app apt as ask at attention attn backup best bonjour branch build but by call cc
    clone co-authored-by co-written-with commit contact customer danke das dear der desde die dirección docs does
    el en file fix flat for from geht gemeldet gracias gruß grüße hallo hello hey hi hola how i id if il in informado insert is it
    joindre kind la le les liebe lieber llamar log looks los mails mail mark: merci mit my no note number of on open order para
    parece passport pinned please por reported reported-by reviewed-by row rückfragen saludos see seit send set signed-off-by
    signalé so steps street tel telefon telephone thank thanks that the then there this ticket to todo tél und une use vielen was
    we what when where which who why with works write you zeile january february march april may june july august september october november december
    monday tuesday wednesday thursday friday saturday sunday python java javascript typescript go css json yaml sql
    assignee reporter reviewer owner author regards cordialement atentamente""".split()
)
CUES_BEFORE = (
    "reviewed-by:", "signed-off-by:", "co-written-with:", "co-authored-by:", "reported-by:", "acked-by:", "tested-by:", "suggested-by:", "helped-by:", "author:",
    "thanks", "thank you", "danke", "merci", "gracias", "signalé par", "reported by", "gemeldet von", "informado por", "joindre", "llamar a", "ask",
    "rückfragen bitte an", "hi", "hello", "hallo", "bonjour", "hola", "dear", "assignee", "->", "agree with", "works for", "not for", "on call this week:", "backup",
    "customer row:", "attention", "attn:", "best", "regards", "cheers", "grüße", "gruß", "saludos", "cordialement", "cc", "full=", "name=", '"name":', '"full":', "values (", "contact:", "number is",
    "full_name", "fullname", "lives with", "spoke to", "written by", "maintained by", "owner:", "reporter:", "reviewer:", "|",
)
CUES_AFTER = (" said in", " wrote the", " paired on", ", 20", " lives at", " here.", " has approved", " approved", " reported", " asked", " merged")
STREET_EN = "Street|Avenue|Lane|Close|Road|Drive|Way|Court|Terrace|Place|Row|Hill|Gardens|Crescent|Square|Boulevard|Walk|Mews|Grove|Park|St|Ave|Ln|Cl|Rd|Dr|Ct|Pl|Sq|Blvd|Ter"
STREET_FR = "rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|passage|square"
STREET_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|chaussee|markt"
STREET_ES = "calle|c/|avenida|avda\\.?|plaza|pza\\.?|paseo|camino|ronda|travesía|carrer|pasaje"
STREET_ANCHORS = tuple(
    [f" {w.lower()}" for w in STREET_EN.split("|")] + [f"{w} " for w in STREET_FR.split("|")] + [w.replace("\\", "") for w in STREET_DE.split("|")] + ["calle ", "c/ ", "avenida ", "avda", "plaza ", "pza", "paseo ", "camino ", "ronda ", "travesía ", "carrer ", "pasaje "]
)

# ------------------------------------------------------------------------------------------------------- parsers

_U = r"\p{Lu}[\p{Ll}\p{M}]*(?:[’']?\p{L}\p{Ll}+)?"
_TOWN = rf"(?:,\s(?:\d{{4,5}}\s)?{_U}(?:-{_U})?)?"
_ADDRESS = re.compile(
    rf"""(?<![\w/.:-])(?:
      (?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|House)\s\d+\p{{L}}?,\s)?\d{{1,5}}\p{{L}}?\s(?:{_U}\s){{1,3}}(?:{STREET_EN})\b\.?(?:,\s(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w+)?{_TOWN}
    | \d{{1,5}}(?:\s?(?:bis|ter|quater))?,?\s(?:{STREET_FR})\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’]|la\s|le\s|les\s)?{_U}(?:[\s-]{_U})*{_TOWN}
    | \p{{Lu}}\p{{L}}*(?:{STREET_DE})\s\d{{1,4}}(?:\s?[a-z])?\b{_TOWN}
    | (?:\p{{Lu}}\p{{L}}+[\s-]){{1,2}}(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer)\s\d{{1,4}}(?:\s?[a-z])?\b{_TOWN}
    | (?i:{STREET_ES})\s?(?:de\s)?(?:las?\s|los\s|el\s|del\s)?{_U}(?:\s{_U})*,?\s(?:n[º°.]\s?)?\d{{1,4}}(?:,\s\d{{1,2}}[º°ª]\s?\p{{L}}?)?{_TOWN}
    )""",
    re.X,
)
_HOST = re.compile(r"\s?((?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s|&#46;))+\p{L}{2,})", re.I)
_NUMBER = re.compile(
    r"""(?<![\w.@/#%&+-])(?<![\w]['’])(?<!\d[\s.,:;/-])(?:
      (?P<phone>
        (?:\+|00)[1-9]\d{0,2}(?:[\s.-]?\(0\))?(?:[\s.-]?\(?\d{1,5}\)?){2,6}
      | 1[\s.-]\(?[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}
      | \(\d{2,5}\)\s?\d{3,4}[\s.-]?\d{3,4}
      | [2-9]\d{2}(?P<a>[.\s-])[2-9]\d{2}(?P=a)\d{4}
      | 0\d{1,4}[\s/-]\d{3,5}[\s-]\d{3,4}
      | 0\d{1,4}[\s/-]\d{6,8}
      | 0\d(?P<b>[\s.-])\d{2}(?P=b)\d{2}(?P=b)\d{2}(?P=b)\d{2}
      )(?:\s?(?:ext\.?|x|extension|poste|Durchwahl)\s?\d{1,5})?
    )(?![\w@/%]|[.-]\d)""",
    re.X,
)
_ID = re.compile(
    r"""(?<![\p{L}\p{N}_@/#.+-])(?<!\d[\s.,:;/-])(?:
      [A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]
    | \p{Lu}{1,2}\d{7,8}
    | (?:\d{8}|[XYZ]\d{7})-?[A-HJ-NP-TV-Z]
    | \d{3}(?P<c>[\s-])\d{2}(?P=c)\d{4}
    | \d{2}\s\d{3}\s\d{3}\s\d{3}
    | \d{11}
    | \d{4}(?P<d>[\s-])\d{4}(?P=d)\d{4}(?P=d)\d{1,7}
    | \d{15,16}
    | [12]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?
    | [A-Z]{2}\d{2}(?:\s?[A-Z\d]{4}){3,7}(?:\s?[A-Z\d]{1,3})?
    )(?![\p{L}\p{N}_@/]|[.-]\d)""",
    re.X,
)
_CARD = re.compile(r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}$")
_W = r"[\p{L}\p{M}]*(?:[’'][\p{L}\p{M}]+)*"
_TOKEN = re.compile(rf"\p{{Lu}}{_W}(?:-\p{{Lu}}{_W})*")
_TAIL = re.compile(rf"(?:[ ](\p{{Lu}})\.(?=[ ]\p{{Lu}}|[ ](?:van|von|de)[ ]))?(?:[ ](?:van|von|de|del|di|da|der|den|du|la|le|VAN|VON|DE|Van|Von))?(?:[ ](?:van|von|de|der|den|la)){{0,2}}[ ](\p{{Lu}}{_W}(?:-\p{{Lu}}{_W})*)(?<=..)")
_COMMA = re.compile(rf",[ ](\p{{Lu}}{_W}(?:-\p{{Lu}}{_W})*|\p{{Lu}}\.)(?![\p{{L}}-])")
_SHORT = re.compile(r"[ ]\p{Lu}\.(?!\p{L})")
_BACK = re.compile(r"(?<![\p{L}\p{N}_.-])(?:(\p{Lu}[\p{L}\p{M}’'-]*)(\.?)[ ])?(?:(\p{Lu})\.[ ])?(?:(?:van|von|de|del|der|den|la|le|VAN|VON|DE)[ ]){0,2}$")
_BEFORE_MAIL = re.compile(r"(?<![\p{L}.-])((?:(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}’'-]*,?)[ ](?:(?:van|von|de)[ ])?){0,3}(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}’'-]*))[ ][<(]$")
_BEFORE_CUE = re.compile(r"(?<![\p{L}-])((?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}’'-]+),?(?:[ ](?:van|von|de|\p{Lu}\.|\p{Lu}[\p{L}\p{M}’'-]+)){0,3})$")
_GAP = re.compile(r"""[ \t]*(?:,|:|!)?[ \t]*\n?[ \t]*['"(]?""")
_BREAK = re.compile("\n")
_SCHEME_BACK = re.compile(r"://\S*$")
_AND = re.compile(r"[ ](?:and|und|et|y|->|&)[ ]")


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fold(word: str) -> str:
    """Lower case without accents; a key for names."""
    word = word.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _words_back(text: str, at: int, low: int, n: int) -> int:
    """Where the ``n``-th word before ``at`` begins, not before ``low``."""
    for _ in range(n):
        blank = text.rfind(" ", low, at)
        if blank < 0:
            return low
        at = blank
    return at + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Finder:
    """The automaton over all anchors and the parsers that expand them; one per task."""

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.role: dict[str, set[str]] = {}
        self.machine = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}
        for form in AT_FORMS:
            anchors.setdefault(form, set()).add("at")
        for word in STREET_ANCHORS:
            anchors.setdefault(word, set()).add("street")
        for cue in CUES_BEFORE:
            anchors.setdefault(cue, set()).add("before")
        for cue in CUES_AFTER:
            anchors.setdefault(cue, set()).add("after")
        for word, role in lexicon:
            if word and word.strip():
                self.role.setdefault(fold(word), set()).add(role or "")
                anchors.setdefault(_lower(word.strip()), set()).add("word")
                anchors.setdefault(fold(word), set()).add("word")
        for digit in "0123456789":
            anchors.setdefault(digit, set()).add("digit")
        for text, kinds in anchors.items():
            self.machine.add_word(text, (text, tuple(kinds)))
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Occurrences as (start, end, kind), in order and without overlap."""
        if not text:
            return []
        low, spans, streets, runs = _lower(text), [], [], []
        words, before, after = [], [], []
        breaks = [m.start() for m in _BREAK.finditer(text)]
        run_end = -1
        for end, (form, kinds) in self.machine.iter(low):
            start = end + 1 - len(form)
            for kind in kinds:
                if kind == "digit":
                    if start != run_end:
                        runs.append(start)
                    run_end = start + 1
                elif kind == "at":
                    got = self._email(text, low, start, end + 1, form)
                    if got:
                        spans.append((*got, "email"))
                elif kind == "street":
                    streets.append((start, end + 1))
                elif kind == "word":
                    if text[start].isupper():
                        words.append(start)
                elif kind == "before":
                    before.append((start, end + 1))
                else:
                    after.append(start)
        if streets and runs:
            spans += self._addresses(text, streets, runs, breaks)
        taken = sorted(spans)
        for m in self._numbers(text, runs, _ID, 3):
            if self._identity(m.group()):
                taken.append((m.start(), m.end(), "id_number"))
        for m in self._numbers(text, runs, _NUMBER, 1):
            if self._phone(m.group()):
                open_end = m.group().endswith(")") and m.group().count(")") > m.group().count("(")
                taken.append((m.start(), m.end() - open_end, "phone"))
        emails = [s for s in spans if s[2] == "email"]
        taken += self._names(text, low, words, before, after, emails, breaks)
        order = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}
        out: list[tuple[int, int, str]] = []
        cover = bytearray(len(text) + 1)
        for s in sorted(set(taken), key=lambda s: (order[s[2]], s[0], -s[1])):
            if not any(cover[s[0] : s[1]]):
                cover[s[0] : s[1]] = b"\1" * (s[1] - s[0])
                out.append(s)
        return sorted(out)

    def _email(self, text: str, low: str, start: int, end: int, form: str) -> tuple[int, int] | None:
        left = start - 1 if start and text[start - 1] == " " and form.strip()[0] in "[({<" else start
        host = _HOST.match(text, end)
        if not host:
            return None
        first = left
        while first and (text[first - 1].isalnum() or text[first - 1] in "._%+'-"):
            first -= 1
        while first < left and not text[first].isalnum():
            first += 1
        if first == left:
            return None
        if form == " at " and not re.search(r"\sdot\s|\[dot\]|\(dot\)", host.group(), re.I):
            return None
        name = text[first:left].lower()
        stop = host.end()
        if name in SHARED or name in STATED or "placeholder" in low[stop : stop + 24]:
            return None
        if first and text[first - 1] in "/:" and _SCHEME_BACK.search(text[_words_back(text, first, 0, 1) : first]):
            return None
        if text[stop : stop + 1] == ":" and text[stop + 1 : stop + 2] not in ("", " ", "\n") or text[stop : stop + 1] == "/":
            return None
        if first and text[first - 1] in "@%":
            return None
        return first, stop

    @staticmethod
    def _numbers(text: str, runs: list[int], pattern: re.Pattern, before: int) -> Iterator[re.Match]:
        """What the pattern reads at the digit runs, from up to ``before`` characters ahead of them, leftmost first and without overlap."""
        reach = 0
        for run in runs:
            if run < reach:
                continue
            for start in range(max(reach, run - before), run + 1):
                if m := pattern.match(text, start):
                    yield m
                    reach = m.end()
                    break

    @staticmethod
    def _addresses(text: str, streets: list[tuple[int, int]], runs: list[int], breaks: list[int]) -> list[tuple[int, int, str]]:
        """Addresses around street words; a line with street words is read once, and the line after it for how an address goes on."""
        out, seen = [], -1
        lines: dict[int, list[tuple[int, int]]] = {}
        for start, end in streets:
            lines.setdefault(bisect.bisect_left(breaks, start), []).append((start, end))
        for k, words in lines.items():
            low, line_end = breaks[k - 1] + 1 if k else 0, breaks[k] if k < len(breaks) else len(text)
            stop = breaks[k + 1] if k + 1 < len(breaks) else len(text)
            r = bisect.bisect_left(runs, low)
            if r == len(runs) or runs[r] >= stop:
                continue
            for m in _ADDRESS.finditer(text, max(low, seen), stop):
                if m.start() > line_end:
                    break
                i = bisect.bisect_left(words, (m.start(), 0))
                if any(m.start() <= e and m.end() >= s for s, e in words[max(0, i - 1) : i + 2]):
                    out.append((m.start(), m.end(), "address"))
                    seen = m.end()
        return out

    @staticmethod
    def _identity(found: str) -> bool:
        digits = re.sub(r"\D", "", found)
        if _CARD.match(found):
            return 13 <= len(digits) <= 19 and _luhn(digits)
        return len(set(digits)) > 1

    @staticmethod
    def _phone(found: str) -> bool:
        digits = re.sub(r"\D", "", re.split(r"\s?(?:ext|x|poste|Durchwahl)", found)[0])
        return 7 <= len(digits) <= 16 and len(set(digits)) > 2

    # -- names

    def _kind(self, token: str) -> set[str]:
        return self.role.get(fold(token), set())

    def _name_at(self, text: str, start: int, cued: bool) -> tuple[int, int] | None:
        """The name that starts at ``start``: given or initial, middle initial, particle, surname; surname, given."""
        first = _TOKEN.match(text, start)
        if not first:
            return None
        a = first.group()
        if a.lower() in NO_NAME or (len(a) > 1 and a.isupper() and a.lower() in NO_NAME):
            return None
        at, initial = first.end(), False
        if len(a) == 1:
            if text[at : at + 1] != ".":
                return None
            at, initial = at + 1, True
        tail = _TAIL.match(text, at)
        if tail and tail.group(2).lower() not in NO_NAME:
            b = tail.group(2)
            known = "given" in self._kind(a) or "surname" in self._kind(b)
            same = a.isupper() == b.isupper() or initial
            if same and (known or cued) and not (initial and not cued and "surname" not in self._kind(b)):
                return start, tail.end()
        if initial:
            return None
        comma = _COMMA.match(text, at)
        if comma:
            b = comma.group(1)
            one, two = self._kind(a), self._kind(b)
            if b.lower() not in NO_NAME and ("surname" in one and ("given" in two or cued or b.endswith(".")) or cued and "given" not in one):
                return start, comma.end()
        short = _SHORT.match(text, at)
        if short and ("given" in self._kind(a) or cued):
            return start, short.end()
        if cued or ("given" in self._kind(a) and fold(a) not in AMBIGUOUS):
            return start, at
        return None

    def _names(self, text, low, words, before, after, emails, breaks):
        out: dict[int, int] = {}

        def back_from(at: int, n: int) -> int:
            k = bisect.bisect_left(breaks, at)
            return _words_back(text, at, breaks[k - 1] + 1 if k else 0, n)

        def put(got):
            if got:
                out[got[0]] = max(out.get(got[0], 0), got[1])

        for start, end in before:
            if start and (low[start - 1].isalnum() or low[start - 1] == "_") and low[start].isalnum():
                continue
            gap = _GAP.match(text, end)
            cue = low[start:end]
            if cue[-1].isalpha() and gap.end() == end:
                continue
            if "\n" in gap.group() and cue not in ("best", "regards", "cheers", "grüße", "gruß", "saludos", "cordialement"):
                continue
            at = gap.end()
            if cue in ("number is",):
                number = _NUMBER.match(text, at)
                at = number.end() if number else at
                at += 2 if text.startswith(", ", at) else 0
            got = self._name_at(text, at, True)
            if got and self._believe(text, low, cue, *got):
                put(got)
                more = _AND.match(text, got[1])
                if more:
                    put(self._name_at(text, more.end(), cue in ("assignee", "thanks", "danke", "merci", "gracias")))
        for start, _, _ in emails:
            m = _BEFORE_MAIL.search(text, back_from(start, 8), start)
            if m:
                at = m.start(1)
                while at < m.end(1) and (t := _TOKEN.match(text, at)) and t.group().lower() in NO_NAME:
                    at = t.end() + 1
                put(self._name_at(text, at, True))
        for start in after:
            m = _BEFORE_CUE.search(text, back_from(start, 6), start)
            if m:
                at = m.start(1)
                while at < start and (t := _TOKEN.match(text, at)) and t.group().lower() in NO_NAME:
                    at = t.end() + 1
                cue = low[start : start + 14]
                strong = cue.startswith((" said in", " wrote the", " paired on", " lives at")) or re.match(r", 20\d\d:", cue)
                got = self._name_at(text, at, bool(strong)) if at < start else None
                if got and got[1] == start:
                    put(got)
        for start in words:
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@-’'" and text[start - 2 : start - 1].isalnum()):
                continue
            token = _TOKEN.match(text, start)
            if not self._kind(token.group()) or text[token.end() : token.end() + 1] in ("_", "@"):
                continue
            back = _BACK.search(text, back_from(start, 6), start)
            done = False
            if back and back.group() and back.group(1) and (len(back.group(1)) > 1) == (back.group(2) == ""):
                if back.group(1).lower() not in NO_NAME:
                    got = self._name_at(text, back.start(), False)
                    if got and got[1] >= token.end():
                        put(got)
                        done = True
            if not done and "given" in self._kind(token.group()):
                put(self._name_at(text, start, False))
            elif not done:
                got = self._name_at(text, start, False)
                if got and got[1] > token.end():
                    put(got)
        return self._longest(out)

    def _believe(self, text: str, low: str, cue: str, start: int, end: int) -> bool:
        """Weak cues need more than one capitalised word after them."""
        got = text[start:end]
        full = " " in got
        known = any(self._kind(t) for t in _TOKEN.findall(got))
        if cue == "|":
            return full and text.startswith(" |", end)
        if cue in ("best", "cc", "->", "values (", "backup", "ask", "hi", "regards", "attention", "name=", "contact:", '"name":', "full_name", "fullname", "cheers"):
            return full or known or cue in ("hi", "cc") and low[end : end + 1] in (",", " ", "\n")
        if cue in ("thanks", "danke", "merci", "gracias", "works for", "not for", "agree with", "assignee", "author:", "owner:"):
            return full or known or low[end : end + 1] in (",", "!", ".", " ", "\n", "")
        return True

    @staticmethod
    def _longest(out: dict[int, int]) -> list[tuple[int, int, str]]:
        found, reach = [], -1
        for start, end in sorted(out.items(), key=lambda x: (x[0], -x[1])):
            if start >= reach:
                found.append((start, end, "name"))
                reach = end
            elif end > reach:
                reach = end
        return found


# ------------------------------------------------------------------------------------------------------ operators

_FOUND = "doc_id long, pii_kind string, start_char int, end_char int, occurrence string"


def find_pii(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence: doc_id, pii_kind, start_char, end_char (exclusive), occurrence.

    Null, empty and blank texts give no rows; a null key is kept.  Repeated rows give repeated occurrences.  The lexicon may be
    empty: names are then found by cues alone.  It is a reference list of bounded size; a list of more than
    ``MAX_LEXICON`` words is refused rather than sent to every task."""
    words = _words(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(words)
        for b in batches:
            rows = [(k, kind, s, e, t[s:e]) for k, t in zip(b["_k"], b["_t"]) for s, e, kind in finder.find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "start_char", "end_char", "occurrence"]).astype({"start_char": "int32", "end_char": "int32"})

    rows = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.length("_t") > 0)
    return spread(rows).mapInPandas(run, _FOUND)


MAX_LEXICON = 200_000


def _words(lexicon: DataFrame) -> list[tuple[str, str]]:
    rows = lexicon.select("word", "word_role").filter("word is not null").distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the name lexicon has more than {MAX_LEXICON} words")
    return [(r.word, r.word_role) for r in rows]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for every span."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact_pii(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``redacted_text`` and ``pii_count`` in place of the text, one row each in one pass; null stays null."""
    words = _words(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(words)
        for b in batches:
            spans = [finder.find(t) for t in b["_t"]]
            yield pd.DataFrame({"_k": b["_k"], "r": [None if t is None else mask(t, s) for t, s in zip(b["_t"], spans)], "n": [len(s) for s in spans]})

    rows = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = documents.schema[key].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"_k {kind}, r string, n int").select(F.col("_k").alias(key), F.col("r").alias("redacted_text"), F.col("n").alias("pii_count"))
